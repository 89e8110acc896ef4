"""Equal rasters are drawn once by a worker; results don't depend on it."""

import numpy as np
import pyarrow as pa

from rastrel.config import ClassifyFirst, PrimitiveFirst
from rastrel.kernels import raster
from rastrel.operators import images
from rastrel.plans import pipelines


def test_equal_planes_are_worked_on_once(monkeypatch):
    calls = []

    def make(plane, more):
        calls.append(more)
        return [{"v": int(plane.sum()) * more[0] + k} for k in range(int(plane[0, 0]))]

    planes = [np.full(shape, v, np.uint8) for shape, v in (((2, 3), 2), ((3, 2), 2), ((2, 3), 0), ((2, 3), 2), ((2, 3), 1))]
    given = [(p, (1,)) for p in planes] + [(planes[0], (10,))]
    want = [(k, int(p.sum()) * m[0] + j) for k, (p, m) in enumerate(given) for j in range(int(p[0, 0]))]
    schema = pa.schema([("v", pa.int64())])
    for bound, again in ((images.REMEMBERED, 0), (1, 5)):  # beyond the bound rasters of later batches are drawn anew
        monkeypatch.setattr(images, "REMEMBERED", bound)
        monkeypatch.setattr(images, "_known", {})
        for n in (5, again):
            calls.clear()
            found, rows = images.each_distinct("test", iter(given), make, schema)
            assert list(zip(rows.tolist(), found.column("v").to_pylist(), strict=True)) == want and len(calls) >= n
        assert (len(calls) == 0) == (again == 0)
    assert images.each_distinct("test", iter([]), make, schema)[0].num_rows == 0


def test_shapes_are_made_once_for_all_lines(spark):
    rgb = np.full((12, 12, 3), 255, np.uint8)
    rgb[2:10, 2:10] = (200, 0, 0)
    docs = spark.createDataFrame([(k, 12, 12, rgb.tobytes()) for k in range(3)], "image_id long, width int, height int, rgb binary")
    found = pipelines.color_shapes(docs)
    lines = pipelines.markups(found)
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    for r in pipelines.color_svg(docs).collect():
        assert r.svg.count("<g ") == r.svg.count("</g>") == 1 and r.svg.index("<g ") < r.svg.index("<", r.svg.index("<g ") + 1) < r.svg.index("</g>")


def test_documents_are_drawn_in_one_pass(spark):
    """Nothing is shuffled or joined on the way to a document, and it is what shapes and markup columns make."""
    y, x = np.mgrid[:40, :40]
    ring_, box = ((x - 19) ** 2 + (y - 19) ** 2 <= 200) & ((x - 19) ** 2 + (y - 19) ** 2 > 50), (abs(x - 12) < 9) & (abs(y - 20) < 12)
    masks = [ring_, box, ring_ & (x < 20), ring_ | box, np.zeros((40, 40), bool), ring_]
    rows = [(k, 40, 40, m.astype(np.uint8).tobytes()) for k, m in enumerate(masks)] + [(9, 0, 0, None), (None, 40, 40, box.astype(np.uint8).tobytes())]
    rasters = spark.createDataFrame(rows, "image_id long, width int, height int, data binary")
    for s in (ClassifyFirst(stroke_color='"#123"', background="#fff"), PrimitiveFirst()):
        got = pipelines.to_svg(rasters, s)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "Join" not in plan
        found = {r.image_id: r.svg for r in got.collect()}
        assert len(found) == len(rows) and found[0] == found[5] and found[None] == found[1]
        named = rasters.where("image_id is not null")
        want = {r.image_id: r.svg for r in pipelines._svg(pipelines.shapes(named, s), named, s, "image_id").collect()}
        assert want == {k: v for k, v in found.items() if k is not None}


def test_equal_planes_of_a_batch_are_masked_once(spark):
    grey = np.random.default_rng(5).integers(0, 256, (3, 6, 6)).astype(np.uint8)
    rows = [(k, 6, 6, grey[k % 3].tobytes()) for k in range(30)] + [(30, 6, 6, None), (31, 9, 4, grey[0].tobytes())]
    frame = spark.createDataFrame(rows, "image_id long, width int, height int, grey binary").coalesce(1)
    found = {r.image_id: r for r in images.masks(frame).collect()}
    for k in range(30):
        assert found[k].data == raster.foreground(grey[k % 3]).astype(np.uint8).tobytes()
    assert (found[30].width, len(found[30].data), found[31].width, found[31].height, len(found[31].data)) == (0, 0, 9, 4, 36)
    calls = []
    numbers = images.map_planes(frame, "grey", lambda p: (calls.append(1), {"n": len(calls)})[1], {"n": ("long", pa.int64())}, once=True).collect()
    assert len(numbers) == 32 and {r.n for r in numbers} == {1, 2, 3, 4, 5}
