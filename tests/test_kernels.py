"""Array kernels on small masks and rings, without Spark."""

import math

import numpy as np
import pytest

from rastrel.kernels import curves, geometry, png, raster, ring, topology, vectorize


def disc(n=64, r=20.0, hole=0.0):
    y, x = np.mgrid[:n, :n] + 0.5 - n / 2
    d = np.hypot(x, y)
    return (d <= r) & (d >= hole)


def flood(mask, eight):
    """Labels by plain flood fill in scan order."""
    out, name = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if out[y, x]:
            continue
        name += 1
        todo = [(y, x)]
        while todo:
            a, b = todo.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                out[a, b] = name
                todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if eight or not i or not j]
    return out


@pytest.mark.parametrize("eight", [False, True])
def test_components(eight):
    rng = np.random.default_rng(1)
    for share in (0.3, 0.5, 0.7):
        mask = rng.random((23, 31)) < share
        assert (raster.components(mask, eight) == flood(mask, eight)).all()


def test_specks_and_holes():
    mask = disc(40, 12)
    mask[0, 0], mask[20, 20] = True, False
    assert raster.remove_small(mask, 2).sum() == mask.sum() - 1 and raster.fill_holes(mask, 1).sum() == mask.sum() + 1
    assert not raster.fill_holes(mask, 1)[0, 1]


def test_borders_make_a_tree():
    mask = disc(64, 28, 20) | disc(64, 12, 6)
    got = raster.borders(mask)
    assert [(b["hole"], b["depth"]) for b in got] == [(False, 0), (True, 1), (False, 2), (True, 3)]
    for b in got:
        cells = np.array(b["cells"])
        assert mask[cells[:, 1], cells[:, 0]].all() and (np.abs(np.diff(np.vstack([cells, cells[:1]]), axis=0)).max(1) == 1).all()
    assert raster.borders(np.ones((1, 1), bool))[0]["cells"] == [(0, 0)] and raster.borders(np.zeros((2, 2), bool)) == []


def test_regions_have_signed_rings():
    found = vectorize.regions(disc(64, 28, 14))
    assert len(found) == 1 and len(found[0]["holes"]) == 1
    assert ring.area(found[0]["outer"]) > 0 > ring.area(found[0]["holes"][0])


def test_enclosing_circle_holds_all_points_and_is_least():
    rng = np.random.default_rng(2)
    for _ in range(30):
        p = rng.normal(size=(rng.integers(1, 40), 2)) * 10
        x, y, r = ring.enclosing_circle(p)
        away = np.hypot(p[:, 0] - x, p[:, 1] - y)
        assert away.max() <= r + 1e-6
        for _ in range(40):  # no nearby centre does better
            c = rng.normal(size=2) * 0.3
            assert np.hypot(p[:, 0] - x - c[0], p[:, 1] - y - c[1]).max() >= r - 1e-6


def test_simplify_stays_within_tolerance():
    t = np.linspace(0, 2 * math.pi, 200, endpoint=False)
    p = np.stack([30 * np.cos(t), 20 * np.sin(t)], 1)
    q = ring.simplify_closed(p, 0.5)
    near = np.min([ring._distance(p, a, b) for a, b in zip(q, np.roll(q, -1, axis=0), strict=True)], axis=0)
    assert len(q) < 40 and near.max() <= 0.5 + 1e-9


def test_curves_follow_the_ring():
    t = np.linspace(0, 2 * math.pi, 120, endpoint=False)
    p = np.stack([30 * np.cos(t), 20 * np.sin(t)], 1)
    found = curves.fit_closed(p, set(), 0.5)
    dense = curves.sample(found, 400)
    assert len(found) <= 12 and max(np.hypot(*(dense - q).T).min() for q in p) < 0.6
    assert curves.path(found).startswith("m 30 0 ") and curves.path(found).endswith(" z")


def test_numbers():
    assert [curves.number(v) for v in (0.125, 2.675, -0.001, 3.0, 1e-12, -1.5, 100.0)] == ["0.12", "2.67", "0", "3", "0", "-1.5", "100"]


@pytest.mark.parametrize(("mask", "kind"), [(disc(96, 40), "circle"), (disc(96, 40) & (np.abs(np.mgrid[:96, :96][0] - 48) < 18), None)])
def test_classes(mask, kind):
    found = vectorize.shapes(mask)
    assert len(found) == 1 and not found[0][0].holes and (kind is None or found[0][2] == kind)


def test_gate():
    square = np.array([[0, 0], [10, 0], [10, 10], [0, 10.0]])
    assert ring.passes_gate(square, square) and not ring.passes_gate(square * 0.9, square) and ring.passes_gate(square * 0.93, square, hole=True)
    assert topology.self_intersects(square[[0, 2, 1, 3]]) and not ring.passes_gate(square[:2], square)


def test_png_round_trip():
    rng = np.random.default_rng(3)
    for shape in ((5, 7), (4, 4, 3), (3, 9, 4)):
        pixels = rng.integers(0, 256, shape).astype(np.uint8)
        got = png.decode(png.encode(pixels))
        want = pixels if pixels.ndim == 3 else np.repeat(pixels[..., None], 3, axis=2)
        assert (got[..., : want.shape[2]] == want).all()
    for bad in (None, b"", b"GIF89a", png.encode(pixels)[:60]):
        with pytest.raises(ValueError):
            png.decode(bad)


def test_blurs_and_sizes():
    grey = np.full((9, 9), 77, np.uint8)
    assert (raster.gaussian(grey, 0.9) == 77).all() and (raster.bilateral(grey) >= 76).all()
    assert raster.resize_longest(np.arange(64, dtype=np.uint8).reshape(8, 8), 4).tolist()[0][0] == 5 and raster.resize_longest(grey, 20).shape == (20, 20)
    assert raster.otsu(grey) == 127
    labels, palette = raster.median_cut(np.array([[[0, 0, 0], [250, 0, 0]], [[0, 0, 2], [250, 4, 0]]]), 2)
    assert sorted(map(tuple, palette)) == [(0, 0, 1), (250, 2, 0)] and labels[0, 0] == labels[1, 0] != labels[0, 1]


def test_runs_around_a_ring():
    from rastrel.kernels import decompose

    flags = np.array([1, 1, 0, 1, 0, 0, 1], bool)
    assert decompose.runs(flags) == [(3, 1), (6, 3)] and decompose.runs(np.ones(4, bool)) == [] == decompose.runs(np.zeros(4, bool))


def test_half_ellipse_at_the_bottom():
    from rastrel.config import PrimitiveFirst
    from rastrel.kernels import decompose, primitive_first

    t = np.linspace(0, math.pi, 80)
    p = np.vstack([np.stack([50 + 40 * np.cos(t), 40 + 20 * np.sin(t)], 1), np.stack([np.linspace(10, 90, 60)[1:-1], np.full(58, 10.0)], 1)])
    found = decompose.bottom_ellipse(p, band=0.6)
    assert found and abs(found["rx"] - 40) < 1 and abs(found["ry"] - 20) < 1
    plan = primitive_first.decompose_contour(geometry.contour("c", p), PrimitiveFirst())
    loop = primitive_first.freeform(plan, PrimitiveFirst())
    assert plan.subshape and [x.kind for x in loop].count("E") == 1 and topology.validate_points(geometry.sample_loop(loop), p) and len(loop) < 40


def test_fillet_touches_both_edges():
    from rastrel.kernels import decompose

    f = decompose.fillet(np.array([0.0, 20]), np.array([0.0, 0]), np.array([20.0, 0]))
    assert f["start"][0] == 0 and f["end"][1] == 0 and abs(f["radius"] - f["trim"]) < 1e-9
    assert decompose.fillet(np.array([0.0, 0.5]), np.zeros(2), np.array([20.0, 0])) is None


def test_ellipse_curves_lie_on_the_ellipse():
    from rastrel.kernels import decompose

    q = curves.sample(decompose.ellipse_curves(3, 4, 10, 5, 30), 20) - (3, 4)
    t = math.radians(30)
    u, v = q[:, 0] * math.cos(t) + q[:, 1] * math.sin(t), q[:, 1] * math.cos(t) - q[:, 0] * math.sin(t)
    assert np.abs(np.hypot(u / 10, v / 5) - 1).max() < 1e-3


def test_settings():
    from rastrel.config import ClassifyFirst, PrimitiveFirst

    assert ClassifyFirst.from_dict({"threshold": 9, "unknown": 1}).threshold == 9 and PrimitiveFirst().smooth_iterations == 1
