"""Background and layers from votes by colour are those of labelled pixels, without a join of pixels."""

import pytest

from rastrel.operators import palette
from rastrel.plans import catalog


@pytest.mark.parametrize("name", ["background_detect", "color_layers"])
def test_no_pixel_is_joined(spark, sf_dir, name):
    assert "Join" not in catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_votes_agree_with_labels(spark):
    rows = [(k, x, y, (x * (k + 1) + y * y) % (2 + k), k, 0) for k in range(4) for x in range(5) for y in range(4)]
    cells = spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int")
    colours = palette.palette(cells)
    ground, votes = palette.background(palette.labels(cells, colours)), palette.edge_colours(cells, (5, 4))
    assert sorted(map(tuple, palette.background_of(votes).collect())) == sorted(map(tuple, ground.collect()))
    assert sorted(map(tuple, palette.layers_of(votes).collect())) == sorted(map(tuple, palette.layers(colours, ground.select("image_id", "background")).collect()))
