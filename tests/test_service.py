"""The service, the command line and the driver's helpers."""

import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest

from rastrel import cli, service, utils
from rastrel.config import ClassifyFirst, PrimitiveFirst
from rastrel.kernels import image_files, png


def picture(n=48, r=16):
    y, x = np.mgrid[:n, :n] + 0.5 - n / 2
    return np.where(np.hypot(x, y) <= r, 20, 240).astype(np.uint8)


def form(data, field="image"):
    head = f'--xyz\r\nContent-Disposition: form-data; name="{field}"; filename="disc.png"\r\nContent-Type: image/png\r\n\r\n'
    return "multipart/form-data; boundary=xyz", head.encode() + data + b"\r\n--xyz--\r\n"


def test_http_service():
    server = service.serve(service.Jobs(PrimitiveFirst()), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    get = lambda path: urllib.request.urlopen(base + path).read()

    def post(kind, body):
        return urllib.request.urlopen(urllib.request.Request(base + "/vectorize", body, {"Content-Type": kind})).read()

    try:
        assert json.loads(get("/health"))["busy"] is False
        done = json.loads(post(*form(png.encode(picture()))))
        assert done["ok"] and done["status"] == "completed" and done["image_name"] == "disc.png" and "<circle " in done["svg_content"]
        assert json.loads(get(f"/jobs/{done['job_id']}"))["svg_sha1_short"] == done["svg_sha1_short"]
        assert get(f"/jobs/{done['job_id']}/svg").decode() == done["svg_content"]
        for path, status in (("/jobs/abc", 404), ("/jobs/abc/svg", 404), ("/else", 404)):
            with pytest.raises(urllib.error.HTTPError) as e:
                get(path)
            assert e.value.code == status
        for kind, body in (form(b"nothing"), form(b""), form(b"x", "other"), ("text/plain", b"x")):
            with pytest.raises(urllib.error.HTTPError) as e:
                post(kind, body)
            assert e.value.code == 400
    finally:
        server.shutdown()


def test_unfinished_jobs_have_no_svg():
    jobs = service.Jobs()
    jobs._jobs["a1"] = {"status": "running"}
    jobs._jobs["a2"] = {"status": "completed", "svg_content": ""}
    for job_id, status in (("a1", 409), ("a2", 404)):
        with pytest.raises(service.Answer) as e:
            service.job_svg(jobs, job_id)
        assert e.value.status == status


def test_jobs_through_spark(spark, tmp_path):
    jobs = service.Jobs(spark=spark, table=str(tmp_path / "jobs"))
    done = jobs.run(png.encode(picture()), "a.png")
    assert done["ok"] and spark.read.parquet(str(tmp_path / "jobs")).count() == 1


def test_command_line(tmp_path, capsys):
    source, out = tmp_path / "disc.png", tmp_path / "out" / "disc.svg"
    source.write_bytes(png.encode(picture()))
    (tmp_path / "own.yaml").write_text("fill_color: '#ff0000'\nmin_region_area: 10\nunknown: 1\n")
    assert cli.main(["classify-first", str(source), "--output", str(out), "--config", str(tmp_path / "own.yaml"), "--no-preserve-narrow-gaps", "--background", "#ffffff"]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["num_shapes"] == 1 and 'fill="#ff0000"' in out.read_text() and 'fill="#ffffff"' in out.read_text()
    args = cli.parser().parse_args(["primitive-first", "x.png", "--threshold", "9", "--invert"])
    assert cli.settings_of(args) == PrimitiveFirst(threshold=9, invert=True)


def test_image_files():
    rgb = np.random.default_rng(1).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    ppm = b"P6\n# made here\n7 5\n255\n" + rgb.tobytes()
    assert (image_files.decode(ppm)[..., :3] == rgb).all()
    plain = ("P2 2 1 15\n0 15\n").encode()
    assert image_files.decode(plain)[0, :, 0].tolist() == [0, 255]
    rows = b"".join(r[:, ::-1].tobytes() + b"\0" * (-21 % 4) for r in rgb[::-1])
    bmp = b"BM" + (54 + len(rows)).to_bytes(4, "little") + b"\0" * 4 + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (7).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"\1\0" + b"\x18\0" + b"\0" * 24 + rows
    assert (image_files.decode(bmp)[..., :3] == rgb).all() and (image_files.decode(image_files.as_png(bmp))[..., :3] == rgb).all()
    for bad in (None, b"", b"P6 9", b"BM123", b"nothing"):
        with pytest.raises(ValueError):
            image_files.decode(bad)


def test_helpers(tmp_path):
    data = {"a": 1, "b": [1, "x y", None], "c": {"d": True, "e": "ü: #"}, "f": 2.5, "g": None, "h": [], "i": "1"}
    utils.dump_yaml(data, tmp_path / "deep" / "x.yaml")
    assert utils.load_yaml(tmp_path / "deep" / "x.yaml") == data and utils.parse_yaml("# none\n") == {}
    assert utils.parse_yaml("k: 'it''s'\nl:\n  - a\n  - 2\nm: yes it is # said\n") == {"k": "it's", "l": ["a", 2], "m": "yes it is"}
    utils.write_json({"é": 1}, tmp_path / "new" / "x.json")
    assert "é" in (tmp_path / "new" / "x.json").read_text()
    assert utils.resolve_path("a/b").is_absolute() and utils.relative_path(utils.ROOT / "a" / "b") == "a/b" and utils.relative_path("/else/x") == "/else/x"
    logger = utils.setup_logger("rastrel.test", tmp_path / "x.log")
    assert utils.setup_logger("rastrel.test", tmp_path / "x.log") is logger and len(logger.handlers) == 2
    utils.set_seed(3)
    a = np.random.random()
    utils.set_seed(3)
    assert np.random.random() == a and utils.rank() == 0
    with utils.timer() as t:
        pass
    assert 0 <= t.elapsed < 1 and utils.utc_now().endswith("+00:00")
    assert utils.default_output("x/y.png", "classify-first").name == "y.svg"


def test_settings_act():
    """Each group of settings changes what is drawn."""
    from rastrel.streaming.jobs import draw

    n = 96
    y, x = np.mgrid[:n, :n]
    grey = np.full((n, n), 235)
    grey[10:60, 15:80] = 40
    grey[25:35, 30:40] = 235
    grey[35:55, 60:62] = 235
    grey[(np.hypot(x - 60, y - 80) < 9)] = 90
    grey[70:80, 10:20] = 100
    data = png.encode(grey.astype(np.uint8))
    for base in (ClassifyFirst(), PrimitiveFirst()):
        plain = draw(data, base)[0]
        changes = [{"threshold": 60}, {"threshold_bias": 60}, {"invert": True}, {"target_size": 48}, {"min_region_area": 400}, {"min_hole_area": 400}, {"morph_close_iterations": 6}, {"fill_color": "#123456"}, {"background": "#eeeeee"}, {"subpixel_contours": False}]
        for change in changes:
            assert draw(data, type(base).from_dict(base.__dict__ | change))[0] != plain, change
    color = ClassifyFirst(vectorization_mode="color")
    rgb = np.stack([grey, np.where(x < 48, grey, 255 - grey), grey], -1).astype(np.uint8)
    rgb[40:56, 60:75] = (200, 40, 60)
    data = png.encode(rgb)
    layers = draw(data, color)[0]
    assert layers.count("<g ") >= 2
    for change in ({"max_colors": 2}, {"background_mode": "none"}, {"background_mode": "manual", "background_color": "#c8283c"}, {"color_distance_threshold": 250.0}):
        assert draw(data, ClassifyFirst.from_dict(color.__dict__ | change))[0] != layers, change
