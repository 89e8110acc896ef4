"""The best candidate of a contour, without a join that could send a whole table to the driver."""

from rastrel.operators import candidates


def test_best_of_holes_and_unknown_contours(spark):
    contours = spark.createDataFrame([(1, False), (2, True), (3, False), (4, None), (None, False)], "contour long, is_hole boolean")
    rows = [(1, "star", 0.95), (1, "circle", 0.95), (2, "star", 0.99), (2, "ellipse", 0.9), (3, "circle", 0.5), (4, "star", 0.9), (4, "circle", 0.91), (9, "circle", 1.0), (None, "circle", 1.0), (1, "blob", 1.0)]
    got = candidates.best(spark.createDataFrame(rows, "contour long, kind string, confidence double"), contours, "contour")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "circle", 0.95), (2, "ellipse", 0.9), (3, "freeform", 1.0), (4, "circle", 0.91), (None, "freeform", 1.0)], key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
