"""Typed shapes: geometry, guard, fitting orders, colour mode, profiles and documents on arrays."""

import math
import xml.etree.ElementTree as ET

import numpy as np
import pytest

from rastrel.config import ClassifyFirst, PrimitiveFirst
from rastrel.kernels import color, curves, decode, decompose, document, fitting, geometry, primitive_first, profiles, ring, shadow, topology, vectorize

SQUARE = np.array([[0, 0], [10, 0], [10, 10], [0, 10.0]])


def ellipse(n=120, a=30.0, b=20.0, cx=0.0, cy=0.0):
    t = np.arange(n) * 2 * math.pi / n
    return np.stack([cx + a * np.cos(t), cy + b * np.sin(t)], 1)


def loops():
    p = geometry.Primitive
    return [p("circle", 5, 6, 4, 4), p("ellipse", 5, 6, 4, 2, 30), p("rectangle", 5, 6, 4, 2, 20), p("rounded_rectangle", 5, 6, 4, 3, 10, 1)]


def test_loops_lie_on_their_primitives():
    for p in loops():
        q = geometry.sample_loop(geometry.primitive_segments(p), 40)
        t = math.radians(p.rotation)
        u = np.stack([(q[:, 0] - p.cx) * math.cos(t) + (q[:, 1] - p.cy) * math.sin(t), (q[:, 1] - p.cy) * math.cos(t) - (q[:, 0] - p.cx) * math.sin(t)], 1)
        if p.kind in ("circle", "ellipse"):
            assert np.abs(np.hypot(u[:, 0] / p.rx, u[:, 1] / p.ry) - 1).max() < 1e-9
        else:
            assert np.abs(ring._box(u, p.rx, p.ry, p.radius)).max() < 1e-9
    q = geometry.sample_loop(geometry.circle_as_cubics(1, 2, 5), 20)
    assert np.abs(np.hypot(q[:, 0] - 1, q[:, 1] - 2) - 5).max() < 0.01


def test_scaling_and_mirroring_commute_with_sampling():
    for p in loops():
        segments = geometry.primitive_segments(p)
        plain = geometry.sample_loop(segments)
        assert np.allclose(geometry.sample_loop([geometry.scale_segment(s, 2, 2) for s in segments]), 2 * plain)
        mirrored = geometry.sample_loop(geometry.mirror_segments(segments, 3))
        assert {tuple(np.round(q, 6)) for q in mirrored} == {tuple(np.round((6 - x, y), 6)) for x, y in plain}
    wide = geometry.scale_primitive(loops()[0], 2, 1)
    assert (wide.kind, wide.rx, wide.ry) == ("ellipse", 8, 4) and geometry.needs_rescale(1, 2) and not geometry.needs_rescale(1, 1)
    region = geometry.Region("r", geometry.contour("o", SQUARE), [geometry.contour("h", SQUARE * 0.2, True)])
    scaled = geometry.scale_regions([region], 2, 3)[0]
    assert scaled.outer.area == 600 and scaled.outer.box.height == 30 and scaled.holes[0].perimeter == 20
    shape = geometry.assemble_shape("s", fitting.polyline(region.outer), [fitting.polyline(region.holes[0])])
    assert geometry.scale_layers([geometry.Layer("l", "#fff", [shape])], 2, 2)[0].shapes[0].outer.segments[0].end == (20, 0)


def test_path_text():
    text, cursor = geometry.path_data(geometry.primitive_segments(loops()[0]))
    assert text == "m 9 6 a 4 4 0 0 1 -8 0 a 4 4 0 0 1 8 0 z" and cursor == (9, 6)
    shape = geometry.assemble_shape("s", geometry.Loop("o", geometry.polyline_segments(SQUARE)), [geometry.Loop("h", [geometry.quadratic((1, 1), (2, 3), (3, 1)), geometry.line((3, 1), (1, 1))])])
    assert geometry.compound_path(shape) == "m 0 0 l 10 0 l 0 10 l -10 0 l 0 -10 z m 1 1 q 1 2 2 0 l -2 0 z"
    gap = geometry.path_data([geometry.line((0, 0), (1, 0)), geometry.line((2, 0), (0, 0))])[0]
    assert gap == "m 0 0 l 1 0 l 1 0 l -2 0 z" and geometry.path_data([]) == ("", None)
    lines = [geometry.line((0, 0), (5, 0)), geometry.line((5, 0), (9, 0.1)), geometry.line((9, 0.1), (9, 9))]
    assert len(geometry.merge_lines(lines)) == 2


def plain_meet(a, b, c, d):
    def way(p, q, r):
        x = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        return 0 if abs(x) <= 1e-8 else 1 if x < 0 else 2

    def on(p, q, r):
        return way(p, q, r) == 0 and all(min(p[k], q[k]) - 1e-8 <= r[k] <= max(p[k], q[k]) + 1e-8 for k in (0, 1))

    if any(math.dist(p, q) <= 1e-6 for p in (a, b) for q in (c, d)):
        return False
    return way(a, b, c) != way(a, b, d) and way(c, d, a) != way(c, d, b) or on(a, b, c) or on(a, b, d) or on(c, d, a) or on(c, d, b)


def test_crossings_match_brute_force():
    rng = np.random.default_rng(2)
    for k in range(60):
        p, q = (rng.integers(0, 9, (rng.integers(3, 12), 2)).astype(float) for _ in range(2))
        e, f = ([(r[i], r[(i + 1) % len(r)]) for i in range(len(r))] for r in (p, q))
        assert topology.polygons_intersect(p, q) == any(plain_meet(*x, *y) for x in e for y in f), k
        n = len(p)
        own = any(plain_meet(*e[i], *e[j]) for i in range(n) for j in range(i) if min(i - j, n - i + j) > 1)
        assert topology.self_intersects(p) == (own and n > 3), k
    for x, y in ((5, 5), (0, 5), (10, 10), (11, 5), (5, -1)):
        assert topology.point_in_polygon(np.array([x, y]), SQUARE) == (0 <= x <= 10 and 0 <= y <= 10)


def test_shape_topology():
    outer, hole = geometry.contour("o", SQUARE * 10), geometry.contour("h", SQUARE * 3 + 20, True)
    make = lambda *hs: geometry.assemble_shape("s", fitting.polyline(outer), list(hs))
    loop = fitting.polyline(hole)
    assert topology.validate_shape(make(loop), outer, [hole]) and topology.validate_shape(make(), outer, [])
    assert not topology.validate_shape(make(loop._replace(source="x")), outer, [hole])
    assert not topology.validate_shape(make(loop, loop._replace(segments=geometry.polyline_segments(SQUARE * 3 + 25))), outer, [hole])
    moved = geometry.contour("h", SQUARE * 3 + 85, True)
    assert not topology.validate_shape(make(fitting.polyline(moved)), outer, [moved])


@pytest.mark.parametrize("settings", [ClassifyFirst(), PrimitiveFirst()])
def test_orders_draw_every_region_within_the_guard(settings):
    y, x = np.mgrid[:128, :128]
    mask = (np.hypot(x - 40, y - 40) < 28) & ~(np.hypot(x - 40, y - 40) < 10) | (abs(x - 95) < 22) & (abs(y - 35) < 14) | (y > 80) & (y < 110) & (x > 10) & (x < 10 + 2 * (y - 75))
    found = vectorize.structure(mask, settings)
    assert len(found) == 3
    for region, _ in found:
        shape, valid, _ = vectorize.fit(region, settings)
        assert valid and topology.validate_shape(shape, region.outer, region.holes, topology.tolerances(settings))
        assert all(h.polarity == "negative" for h in shape.holes) and shape.outer.segments
    kinds = [vectorize.fit(r, settings)[2] for r, _ in found]
    assert "circle" in kinds and {"rectangle", "rounded_rectangle"} & set(kinds)


def test_dshape_takes_the_second_ladder():
    t = np.linspace(-math.pi / 2, math.pi / 2, 60)
    p = np.vstack([np.stack([30 * np.cos(t), 40 * np.sin(t)], 1), [[0, y] for y in np.linspace(40, -40, 40)[1:-1]]])
    loop = fitting.fit_contour(geometry.contour("c", p), ClassifyFirst(), {"kind": "dshape", "confidence": 0.9})
    assert loop.segments and topology.validate_loop(loop, geometry.contour("c", p))
    round_ = geometry.contour("c", ellipse(200, 20, 20))
    assert [s.kind for s in fitting.fit_contour(round_, ClassifyFirst(), {"kind": "dshape", "confidence": 0.9}).segments] == ["C"] * 4
    assert fitting.hole_classifications(geometry.Region("r", round_, [round_, round_]), ["circle"]) == ["circle", None]


def test_anchors_keep_their_distance():
    t = np.arange(200) * 2 * math.pi / 200
    r = 30 + 6 * np.sign(np.sin(9 * t))
    p = np.stack([r * np.cos(t), r * np.sin(t)], 1)
    found = fitting.anchors(p, ClassifyFirst())
    kept = fitting.prune_anchors(p, found)
    assert set(kept) <= set(found) and len(kept) <= 14
    assert all(fitting.distance_around(a, b, 200) >= 5 for a in kept for b in kept if a != b)
    assert fitting.too_coarse(ellipse(200, 100, 100), 2, True) and not fitting.too_coarse(ellipse(200, 5, 5), 1, True)


def test_colour_mode_reduces_and_numbers_anew():
    rng = np.random.default_rng(3)
    rgb = np.repeat(np.repeat(rng.integers(0, 256, (20, 20, 3)), 3, 0), 3, 1).astype(np.uint8)
    assert len(np.unique(rgb.reshape(-1, 3), axis=0)) > 300
    for method in color.METHODS:
        found = color.segment(rgb, None, 8, method, mode="none")
        assert 1 < len(found.palette) <= 8 and found.labels.max() < len(found.palette)
        assert sum(x.mask.sum() for x in found.layers) == 3600 and [x.colour.n for x in found.layers] == sorted((x.colour.n for x in found.layers), reverse=True)
    flat = np.full((10, 10, 3), 240, np.uint8)
    flat[3:6, 3:6] = 10
    found = color.segment(flat)
    assert found.background == 0 and [x.colour.hex for x in found.layers] == ["#0a0a0a"] and found.layers[0].layer_id == "layer_00_0a0a0a"
    assert color.segment(flat, mode="manual", colour="#000").background == 1 and color.segment(flat, mode="manual", colour="x").background is None
    half = np.zeros((10, 10), bool)
    half[:5] = True
    assert color.segment(flat, half).palette[0].n + color.segment(flat, half).palette[-1].n == 50 and color.segment(flat, ~half & half).layers == []
    assert np.allclose(color.membership(flat, np.array([[240] * 3, [10] * 3]), 0)[[0, 4], [0, 4]], [1, 0])


def test_preprocessing():
    rgba = np.full((6, 8, 4), 255, np.uint8)
    rgba[2:4, 2:5, :3], rgba[0, :, 3] = 0, 100
    got = decode.preprocess(rgba, ClassifyFirst(preblur_radius=0, bilateral_filter_diameter=1))
    assert got.mask[2:4, 2:5].all() and got.mask[5].all() and not got.mask[0].any() or got.field.max() == 1
    opaque = decode.preprocess(np.concatenate([rgba[..., :3], np.full((6, 8, 1), 255, np.uint8)], 2), ClassifyFirst(preblur_radius=0, bilateral_filter_diameter=1))
    assert opaque.mask.sum() == 6 and opaque.scale == (1, 1) and opaque.view_box == (0, 0, 8, 6) and opaque.row()["width"] == 8
    small = decode.preprocess(rgba, ClassifyFirst(target_size=4))
    assert small.working == (4, 3) and small.scale == (2, 2)
    assert PrimitiveFirst(threshold=7).as_classify_first().threshold == 7


def test_documents_are_xml():
    shapes = [geometry.assemble_shape("a", geometry.Loop("a", geometry.primitive_segments(p), primitive=p), [], '#"<', layer_id="l&", z=1) for p in loops()]
    holed = geometry.assemble_shape("b", geometry.Loop("b", geometry.polyline_segments(SQUARE)), [geometry.Loop("h", geometry.polyline_segments(SQUARE * 0.2))], "#111111", "#222222")
    d = document.assemble(20, 10, [*shapes, holed], {"viewBox_x": "1", "viewBox_width": "wide"})
    root = ET.fromstring(document.export(d, "#ffffff"))
    assert root.attrib["viewBox"] == "1 0 20 10" and len(root) == 4 and [c.tag.split("}")[1] for c in root[1]] == ["circle", "ellipse", "rect", "rect"]
    assert document.statistics(d) == {"num_shapes": 5, "num_holes": 1, "num_loops": 6, "num_segments": 24, "num_primitives": 24, "num_layers": 1, "num_fills": 2}


def test_shadows_and_pins():
    t = np.linspace(0, math.pi, 60)
    low = np.stack([50 * np.cos(t), 22 * np.sin(t)], 1)
    top = np.array([[-40, -4], [-25, -4], [-12, 2], [0, 8], [12, 2], [25, -4], [40, -4]], float)
    p = np.vstack([low, top])
    assert shadow.is_shadow_like(p) and not shadow.is_shadow_like(p, True) and not shadow.is_pin_like(p)
    marks = shadow.bridge_anchors(p)
    assert {int(np.argmax(p[:, 1]))} <= marks and len(marks) == 4 and shadow.structural_anchors(p) >= marks
    assert shadow.smoothing_strength(p, 0.8) == 0.26 and shadow.simplify_tolerance(p, 0.1) == 0.45 and shadow.simplify_tolerance(SQUARE, 0.1) == 0.2
    assert np.allclose(shadow.presmooth(p, {0, 5})[[0, 5]], p[[0, 5]]) and (shadow.presmooth(SQUARE, set()) == SQUARE).all()
    assert (shadow.steady_lower_mass(p, set())[p[:, 1] < 0] == p[p[:, 1] < 0]).all()
    loop = profiles.shadow_outline(geometry.contour("s", p), ClassifyFirst())
    assert loop and [x.kind for x in loop.segments[:2]] == ["L", "L"]
    curved = loop.segments[2:]
    assert len(curved) % 2 == 0 and curved[len(curved) // 2 :] == geometry.mirror_segments(curved[: len(curved) // 2], 0.0)
    pin = np.vstack([ellipse(60, 20, 20, 0, 20)[30:], [[20 * (1 - k / 20), 20 + 2.4 * k] for k in range(1, 20)], [[0, 70]], [[-20 * k / 20, 68 - 2.4 * k] for k in range(1, 20)]])
    assert shadow.is_pin_like(pin) and shadow.is_pin_body(pin, [ellipse(60, 7, 7, 0, 20)]) and not shadow.is_pin_body(pin, [])
    assert len(shadow.body_anchors(pin)) == 2
    body = profiles.pin_outline(geometry.contour("p", pin), ClassifyFirst())
    assert body and topology.validate_points(geometry.sample_loop(body.segments), pin, False, topology.Tolerances(0.2, 0.2, 0.6, 0.6))


def test_open_chains():
    t = np.linspace(0, 1, 40)
    control = np.array([[0, 0], [10, 30], [40, 30], [50, 0.0]])
    p = curves.evaluate(control, t)
    found, error, _ = profiles.fit_bezier(p, 3)
    assert error < 0.5 and np.allclose(found[[0, 3]], control[[0, 3]])
    bent = profiles.bezier(np.array([[0, 0], [20, 40], [40, 0.0]]), t)
    solved = profiles.solve(bent, t, 2)
    assert np.allclose(solved[1], [20, 40]) and profiles.largest_error(bent, t, solved)[0] < 1e-9
    assert profiles.solve(bent[:2], t[:2], 2) is None and profiles.fit_bezier(bent[:2], 3)[0] is None
    assert np.allclose(np.diff(profiles.resample(SQUARE, 4), axis=0)[:, 0] ** 2 + np.diff(profiles.resample(SQUARE, 4), axis=0)[:, 1] ** 2, 100)
    even = profiles.parameters(SQUARE), profiles.parameters(SQUARE, 0.5)
    assert profiles.parameter_shift(*even) < 1e-12 and profiles.parameters(SQUARE * 0).tolist() == [0, 1 / 3, 2 / 3, 1]
    assert (np.diff(profiles.refine(p, control)) > 0).all()
    for chain in (p, bent, ellipse(80)[:40]):
        out = profiles.fit_open_span(chain, ClassifyFirst())
        dense = np.concatenate([geometry.sample_segment(s, 60) for s in out])
        assert max(np.hypot(*(dense - q).T).min() for q in chain) < 1.2 and out[0].start == tuple(chain[0]) and out[-1].end == tuple(chain[-1])
    assert profiles.arc_span(ellipse(80, 30, 30)[:40], ClassifyFirst()).kind == "A" and profiles.arc_span(np.array([[0, 0], [1, 3], [2, -3], [3, 3], [4, 0.0]]), ClassifyFirst()) is None
    chain = profiles.catmull_rom_chain(p[::8])
    assert len(chain) == len(p[::8]) - 1 and len(profiles.limit_segments(chain, 2)) == 2
    assert profiles.split_place(np.array([[0, 0], [1, 1], [2, 5], [3, 1], [4, 0.0]])) == 2 and profiles.line_error(SQUARE) == 10
    assert abs(fitting.elliptical_arc(ellipse(120)[:100])["sweep"]) > 4


def test_rings_with_fillets():
    p = np.vstack([np.linspace(a, b, 12)[:-1] for a, b in zip(SQUARE * 6, np.roll(SQUARE * 6, -1, axis=0), strict=True)])
    out = profiles.fit_with_fillets(SQUARE * 6 + np.array([[0, 0], [6, 0], [0, 0], [-6, 0]]), ClassifyFirst(sharp_corner_angle_deg=60.0))
    assert {s.kind for s in out} == {"A", "C"} and sum(s.kind == "A" for s in out) == 4
    assert profiles.span_anchors(ellipse(40), ClassifyFirst()) == [0, 10, 20, 30] and len(profiles.fit_with_fillets(p, ClassifyFirst())) >= 4


def test_segments_by_name():
    assert [s.kind for s in profiles.segments_of("circle", {"cx": 0, "cy": 0, "r": 3})] == ["A", "A"]
    assert len(profiles.segments_of("star", {"outer": 4, "inner": 2, "n": 6})) == 12 and len(profiles.segments_of("triangle", {"points": [[0, 0], [1, 0], [0, 1]]})) == 3
    assert len(profiles.segments_of("rounded_rectangle", {"w": 8, "h": 6, "corner_radius": 1})) == 8 and profiles.segments_of("capsule", {}) == []
    with pytest.raises(ValueError):
        profiles.segments_of("blob", {})


def test_analysis_of_points():
    flat = ring.analyze([{"x": 0, "y": 0}, {"x": 1, "y": 0}])
    full = ring.analyze(geometry.contour("c", ellipse()))
    assert flat["area"] == 0 and set(flat) == set(full) and abs(full["area"] - math.pi * 600) < 5 and len(full["radial_signature"]) == 144
    assert decompose.bottom_ellipse(SQUARE) is None and primitive_first.attach(None, []) is None
