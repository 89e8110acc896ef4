"""File sources and sinks, and the stream of uploads."""

import numpy as np

from rastrel.kernels import png
from rastrel.plans import pipelines
from rastrel.sources import files
from rastrel.streaming import jobs


def picture(n=48, r=16):
    y, x = np.mgrid[:n, :n] + 0.5 - n / 2
    return np.where(np.hypot(x, y) <= r, 20, 240).astype(np.uint8)


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2, "b": "é"}\n')
    rows = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a long, b string").collect()
    assert sorted((r.a, r.b) for r in rows) == [(1, None), (2, "é")]
    out = str(tmp_path / "out")
    frame = spark.createDataFrame([(1, None)], "a long, b string")
    files.write_jsonl(frame, out)
    files.write_jsonl(frame, out, append=True)
    assert files.read_jsonl(spark, out, "a long, b string").count() == 2


def test_svg_listing_and_sink(spark, tmp_path):
    for name in ("a.svg", "b.SVG", "c.txt"):
        (tmp_path / name).write_text("<svg></svg>")
    assert sorted(r.path[-5:] for r in files.svg_files(spark, str(tmp_path)).collect()) == ["a.svg", "b.SVG"]
    files.write_svg(spark.createDataFrame([(1, "<svg>\n</svg>")], "image_id long, svg string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_image_source_to_svg(spark, tmp_path):
    (tmp_path / "disc.png").write_bytes(png.encode(picture()))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    masks = pipelines.decode(files.read_images(spark, str(tmp_path)))
    svg = pipelines.to_svg(masks).collect()
    assert len(svg) == 1 and "<circle " in svg[0].svg and svg[0].svg.endswith("</svg>")


def test_images_by_settings(spark, tmp_path):
    """Rows of images and single files are drawn alike: resizing leads back to the original's coordinates, colours are reduced."""
    from rastrel.config import ClassifyFirst, PrimitiveFirst
    from rastrel.streaming.jobs import draw

    rng = np.random.default_rng(1)
    rgb = np.repeat(np.repeat(rng.integers(0, 256, (20, 20, 3)), 4, 0), 4, 1).astype(np.uint8)
    (tmp_path / "many.png").write_bytes(png.encode(rgb))
    images = files.read_images(spark, str(tmp_path))
    for settings in (
        ClassifyFirst(target_size=40, stroke_color="#123"), ClassifyFirst(vectorization_mode="color", max_colors=5, background="#fff"), ClassifyFirst(vectorization_mode="auto", min_region_area=10**6), PrimitiveFirst(target_size=40, invert=True),
    ):
        svg = pipelines.vectorize_images(images, settings).collect()
        assert len(svg) == 1 and svg[0].svg == draw(png.encode(rgb), settings)[0]
        assert svg[0].svg.count("<g ") == (len(set(pipelines.color_shapes(pipelines.decode(images, settings), settings).select("fill").toPandas().fill)) if settings.__dict__.get("vectorization_mode") == "color" else 0)


def test_many_colours_are_reduced(spark):
    """400 colours come out as eight at most, and values beyond a byte are an error."""
    import pytest
    from pyspark.sql import functions as F

    from rastrel.operators import pixels

    rng = np.random.default_rng(2)
    rgb = np.repeat(np.repeat(rng.integers(0, 256, (20, 20, 3)), 7, 0), 7, 1).astype(np.uint8)
    images = spark.createDataFrame([(1, 140, 140, bytearray(rgb.tobytes())), (2, 0, 0, None)], "image_id long, width int, height int, rgb binary")
    found = pipelines.color_shapes(images).select("fill").distinct().count()
    assert 1 < found <= 8 and pipelines.color_svg(images).count() == 2
    assert pipelines.statistics(pipelines.color_shapes(images)).first().num_fills == found
    cells = spark.range(300).select(F.lit(1).alias("image_id"), F.col("id").cast("int").alias("x"), F.lit(0).alias("y"), F.col("id").cast("int").alias("v"))
    with pytest.raises(Exception, match="does not fit a byte"):
        pixels.rasters(cells, value="v").collect()


def test_uploads(spark, tmp_path):
    uploads = tmp_path / "uploads"
    uploads.mkdir()
    (uploads / "disc.png").write_bytes(png.encode(picture()))
    (uploads / "bad.png").write_bytes(b"nothing")
    table = str(tmp_path / "jobs")
    for _ in range(2):  # a file that was listed isn't taken again
        jobs.start(spark, str(uploads), table, str(tmp_path / "state"), once=True).awaitTermination(60)
    got = {r.image_name: r for r in jobs.latest(spark, table).collect()}
    assert spark.read.parquet(table).count() == 2
    assert got["disc.png"].ok and got["disc.png"].svg_content.count("<circle ") == 1 and got["disc.png"].svg_char_length == len(got["disc.png"].svg_content)
    assert not got["bad.png"].ok and got["bad.png"].error == "not a PNG file"
    none = jobs.run_jobs(spark.createDataFrame([("/up/none.png", None)], "path string, content binary")).collect()
    assert [(r.image_name, r.ok, r.error) for r in none] == [("none.png", False, "empty image")]
