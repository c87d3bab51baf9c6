"""Hand figures for operators that need whole images, and round trips through files."""

import math
import os

import numpy as np
import pytest

from tectra.operators import borders as bd
from tectra.operators import linking as lk
from tectra.operators import per_image as one
from tectra.operators import raster as ops
from tectra.operators import shearlets
from tectra.operators import thinning as thins
from tectra.plans import lines
from tectra.sinks import files, formats
from tectra.sources import rasters as src


def mask(*rows):
    return np.array([[c == "#" for c in r] for r in rows])


LINE = mask(".......", ".#####.", ".......")
ELL = mask(".....", ".#...", ".#...", ".###.", ".....")
RING = mask(".....", "..#..", ".#.#.", "..#..", ".....")
PLUS = mask(".......", "...#...", "...#...", ".#####.", "...#...", "...#...", ".......")


@pytest.mark.parametrize("figure", [LINE, LINE.T, np.eye(5, dtype=bool)])
def test_a_line_is_one_free_edge(figure):
    edges = lk.link(figure)
    assert [t for t, _ in edges] == [0]
    assert len(edges[0][1]) == 5
    assert math.isclose(one.length(edges[0][1]), 4 * (math.sqrt(2) if figure.shape == (5, 5) else 1))


def test_link_covers_every_pixel_of_a_figure():
    for figure in (LINE, ELL, RING, PLUS):
        edges = lk.link(figure)
        assert {tuple(p) for _, e in edges for p in e} == {tuple(p) for p in np.argwhere(figure).tolist()}
        for _, e in edges:
            assert all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in zip(e, e[1:], strict=False))


def test_a_ring_is_a_loop():
    (kind, path), = lk.link(RING)
    assert kind == 5 and path[0] == path[-1] and len(path) == 5


def test_a_plus_has_four_ends():
    assert (lk.turns(PLUS)[PLUS] == 2).sum() == 4
    assert [t for t, _ in lk.link(PLUS)] == [lk.ENDED] * 4
    assert all(e[-1] == (3, 3) for _, e in lk.link(PLUS))


def test_neighbouring_junctions_have_an_edge_of_two_points():
    figure = mask("..#....", "..#....", "###....", "..##...", "...####", "...#...", "...#...")
    linker = lk.Linker(figure)
    edges = lk.link(figure)
    assert all(e[i] in linker.live for _, e in edges for i in range(len(e)))
    assert {p for _, e in edges for p in e} == linker.live


def test_a_walk_goes_straight_on():
    figure = mask(".......", "#######", "...#...", "...#...", ".......")
    assert lk.Linker(figure).walk((1, 0))[1][:3] == [(1, 0), (1, 1), (1, 2)]


def test_unit_vectors_have_length_one():
    assert math.isclose(math.hypot(*lk.unit((0, 0), (3, 4))), 1)


def test_no_edges_without_pixels():
    assert lk.link(np.zeros((3, 3), bool)) == []
    assert bd.borders(np.zeros((3, 3), bool)) == []


def test_skeleton_is_thin_and_connected():
    thick = np.zeros((12, 20), bool)
    thick[3:9, 2:18] = True
    thin = one.skeleton(thick)
    assert 0 < thin.sum() < thick.sum() / 3 and not (thin & ~thick).any()
    assert len(np.unique(one.components(thin)[thin])) == 1
    assert not (thin[:-1, :-1] & thin[1:, :-1] & thin[:-1, 1:] & thin[1:, 1:]).any()


def test_clean_joins_pairs_and_drops_short_ends():
    a, b, c = [(0, i) for i in range(5)], [(0, i) for i in range(4, 9)], [(9, 9), (9, 10)]
    assert lk.clean([a, b, c], 3) == [[(0, i) for i in range(9)]]


def test_clean_drops_the_shortest_spur_and_joins_the_rest():
    left, right = [(0, i) for i in range(6)], [(0, i) for i in range(5, 12)]
    spur = [(0, 5), (1, 5)]
    assert lk.clean([left, right, spur], 4) == [[(0, i) for i in range(12)]]
    cross = [[(5, 5), (5 + dy * k, 5 + dx * k)] for dy, dx, k in ((0, 5, 1), (5, 0, 1), (0, -5, 1), (-1, 0, 1))]
    assert lk.clean(cross, 3) == cross[:3]
    ring = [(0, 0), (0, 1), (1, 1), (0, 0)]
    assert lk.clean([ring], 9) == [] and lk.clean([ring], 1) == [ring]


def test_segment_and_simplify_keep_corners():
    path = np.array([(i, 0) for i in range(6)] + [(5, j) for j in range(1, 6)])
    assert [tuple(p) for p in bd.simplified(path, 0.5).tolist()] == [(0, 0), (5, 0), (5, 5)]
    assert [tuple(path[i]) for i in bd.segmented_places(path, 0.5)] == [(0, 0), (5, 0), (5, 5)]


def test_border_of_a_pixel_and_of_a_block_with_a_hole():
    dot = mask("...", ".#.", "...")
    assert [(a, p.tolist()) for _, a, p in bd.borders(dot)] == [(1, [[1, 1]])]
    block = mask("....", ".###", ".#.#", ".###")
    (_, outer, ring), (_, hole, inner) = bd.borders(block)
    assert (outer, hole, len(ring), len(inner)) == (9, -1, 8, 4)
    assert [tuple(p) for p in bd.corners(ring).tolist()] == [(3, 1), (3, 3), (1, 3), (1, 1)]


def test_shortest_goes_round_a_wall():
    cost = np.ones((5, 5))
    cost[1:5, 2] = 100
    for around in (one.AROUND, one.CROSS):
        status, _, path = one.trace(cost, (4, 0), (4, 4), around=around)
        assert status == "found" and path[0] == (4, 0) and path[-1] == (4, 4) and all(p == (0, 2) or p[1] != 2 for p in path)
    assert one.trace(cost, (4, 0), (4, 4), cap=2) == ("stopped", 3, [(4, 0)])
    assert one.trace(cost, (4, 0), (9, 9)) == ("none", 25, [(4, 0)])


def test_shearlet_edges_find_a_step():
    v = np.zeros((64, 64))
    v[:, 32:] = 255
    for image, want in ((v, 180.0), (v.T, 90.0)):
        score, turn = shearlets.edges(image)
        at = np.argwhere(score[16:48, 16:48] > 0.5)
        assert len(at) == 32 and len(set(at[:, 1 if want == 180 else 0].tolist())) == 1
        assert set(shearlets.degrees(turn)[16:48, 16:48][score[16:48, 16:48] > 0.5].round(6)) == {want}


def test_shears_of_all_levels():
    assert shearlets.cones(3) == ([0, 1, 2, 2, 1, 0, -1, -2, -2, -1], [3, 4, 5, 6, 7])
    assert shearlets.cones(2) == ([0, 1, 1, 0, -1, -1], [2, 3, 4])
    assert [len(shearlets.cones(k)[0]) for k in (2, 3, 4, 5)] == [6, 10, 18, 34]


def test_full_circle_has_opposite_directions():
    v = np.random.default_rng(1).random((16, 12)) * 255
    c = shearlets.full_circle(shearlets.transform(v, shearlets.edge_system(16, 12)))
    assert c.shape == (7, 20, 16, 12)
    assert np.allclose(np.sort(np.abs(c[:, :10]).ravel()), np.sort(np.abs(c[:, 10:]).ravel()))
    with pytest.raises(ValueError):
        shearlets.edges(v, mode="middle")


def test_medial_axis_and_thinning_keep_figures_whole():
    thick = np.zeros((14, 22), bool)
    thick[2:12, 2:20] = True
    thick[5:9, 8:12] = False
    for thin in (thins.thin(thick), thins.medial_axis(thick), one.skeleton(thick)):
        assert 0 < thin.sum() < thick.sum() / 2 and not (thin & ~thick).any()
        assert len(np.unique(one.components(thin)[thin])) == 1
        assert len(np.unique(one.components(~thin, [(-1, 0), (0, -1), (0, 1), (1, 0)])[~thin])) == 2


def _pixels(spark, a, image_id=1):
    return spark.createDataFrame([(image_id, y, x, int(v)) for (y, x), v in np.ndenumerate(a)], "image_id long, y int, x int, v int")


def test_passes_mirror_borders(spark):
    a = np.arange(20).reshape(4, 5) ** 2 % 17
    w = np.array([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0])
    for border, mode in (("reflect", "reflect"), ("replicate", "edge")):
        want = np.stack([np.convolve(r, w[::-1], "valid") for r in np.pad(a, ((0, 0), (3, 3)), mode)])
        want = np.stack([np.convolve(c, w[::-1], "valid") for c in np.pad(want, ((3, 3), (0, 0)), mode).T]).T
        found = ops.separable(_pixels(spark, a), w.tolist(), w.tolist(), border=border).collect()
        assert all(math.isclose(r.s, want[r.y, r.x]) for r in found) and len(found) == 20


def test_pass_of_a_single_pixel(spark):
    assert [r.s for r in ops.separable(_pixels(spark, np.array([[5]])), [1.0, 1.0, 1.0], [1.0, 1.0, 1.0]).collect()] == [45.0]


def test_resize_to_the_same_size_changes_nothing(spark):
    a = np.arange(12).reshape(3, 4) * 20
    assert {(r.y, r.x): r.v for r in ops.resize(_pixels(spark, a), 3, 4).collect()} == dict(np.ndenumerate(a))


def test_sharp_runs_cut_every_other_vertex(spark):
    zigzag = [(0, 0), (9, 1), (0, 2), (9, 3), (0, 4), (0, 30)]
    rows = spark.createDataFrame([(1, i, r, c) for i, (r, c) in enumerate(zigzag)], "edge_id int, i int, r int, c int")
    parts = [r.part for r in ops.angle_split(rows, 15, 90).orderBy("i").collect()]
    assert parts == [0, 0, 1, 1, 2, 3]


def test_strokes_need_a_press_and_a_commit(spark):
    kinds = ["release", "press", "release", "commit", "commit", "press"]
    rows = spark.createDataFrame([(1, i, k, i, 0) for i, k in enumerate(kinds)], "owner int, seq int, kind string, x int, y int")
    assert [tuple(r) for r in ops.fold_strokes(rows).collect()] == [(1, 0, 2, "1 0,2 0")]


def test_png_files_come_back(spark, tmp_path):
    a = np.arange(35).reshape(5, 7) * 7
    px = _pixels(spark, a).unionByName(_pixels(spark, a[:2, :3], 2))
    from pyspark.sql import functions as F

    done = files.write_files(files.encoded(px), str(tmp_path), F.concat(F.lit("i"), "image_id", F.lit(".png"))).collect()
    assert sorted(r.name for r in done) == sorted(os.listdir(tmp_path)) == ["i1.png", "i2.png"]
    (tmp_path / "broken.png").write_bytes(b"no image")
    read = src.image_pixels(src.images(spark, str(tmp_path))).filter("origin like '%i1.png'").collect()
    assert {(r.y, r.x): (r.b, r.g, r.r) for r in read} == {k: (v, v, v) for k, v in np.ndenumerate(a)}


def test_colour_order_of_decoded_files(spark, tmp_path):
    (tmp_path / "c.png").write_bytes(files.encode_png(np.array([[[10, 20, 30], [40, 50, 60]]])))
    read = src.image_pixels(src.images(spark, str(tmp_path))).orderBy("x").collect()
    assert [(r.r, r.g, r.b) for r in read] == [(10, 20, 30), (40, 50, 60)]


def test_tiff_has_its_pixels_last():
    data = files.encode_tiff(np.arange(6).reshape(2, 3))
    assert data[:4] == b"II*\0" and data[-6:] == bytes(range(6))


def test_empty_images_and_missing_values(spark):
    px = spark.createDataFrame([(1, 0, 0, None), (1, 0, 1, 300), (2, None, 0, 5)], "image_id long, y int, x int, v int")
    (row,) = files.encoded(px).collect()
    assert (row.image_id, row.height, row.width) == (1, 1, 2) and bytes(row.data) == files.encode_png(np.array([[0, 255]]))
    assert files.encoded(px.limit(0)).count() == 0


def test_svg_document_is_ordered(spark):
    rows = spark.createDataFrame([(1, 2, "M 1 1"), (1, 1, "M 0 0")], "page int, line_id int, path string")
    svg = files.svg_document(rows, 10, 20).first().svg
    assert svg.index("M 0 0") < svg.index("M 1 1") and svg.startswith("<svg") and svg.endswith("</svg>")


def test_formats_come_back():
    a = np.arange(48).reshape(6, 8) * 5
    transform = (2.5, 0.0, 100.0, 0.0, -3.0, 900.0)
    found, there, epsg = formats.decode_tiff(formats.encode_geotiff(a, transform, 32633))
    assert (found == a).all() and there == transform and epsg == 32633
    plain, none, _ = formats.decode_tiff(files.encode_tiff(a))
    assert (plain == a).all() and none is None
    with pytest.raises(ValueError):
        formats.decode_tiff(b"no image")
    lines = [[(0.0, 1.0), (2.5, 3.0)], [(9.0, 9.0), (8.0, 7.0), (6.0, 5.0)]]
    made = formats.encode_shapefile(lines, "X")
    assert formats.decode_shapefile(made["shp"]) == lines and sorted(made) == ["dbf", "prj", "shp", "shx"]
    assert int.from_bytes(made["shp"][24:28], "big") * 2 == len(made["shp"])
    assert formats.decode_shapefile(formats.encode_shapefile([])["shp"]) == []


def test_jpeg_of_a_ramp(spark, tmp_path):
    y, x = np.indices((21, 30))
    a = y * 4 + x * 5
    (tmp_path / "a.jpg").write_bytes(formats.encode_jpeg(a))
    read = src.image_pixels(src.images(spark, str(tmp_path), "*.jpg")).collect()
    assert len(read) == a.size and max(abs(int(a[r.y, r.x]) - r.b) for r in read) <= 6


def test_paths_with_all_commands(spark):
    rows = spark.createDataFrame([(1, "m 1 2 h 5 V 7 L 0 0 3 4 C 9 9 9 9 9 9 Z H 8"), (2, "")], "edge_id int, path string")
    found = sorted((r.i, r.x, r.y) for r in lines.parse_paths(rows).collect())
    assert [p[1:] for p in found] == [(1, 2), (5, 2), (5, 7), (0, 0), (3, 4), (1, 2), (8, 4)]


def test_crossing_sides_are_found():
    assert not one.is_simple([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)])
    assert one.is_simple([(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)])


def test_table_pass_takes_512_entries(spark):
    px = _pixels(spark, np.ones((2, 2)))
    with pytest.raises(ValueError):
        ops.table_pass(px, [0] * 511)
    assert {r.v for r in ops.table_pass(px, ops.rule_table(lambda p: p["c"])).collect()} == {1}


def test_thin_pass_keeps_lines(spark):
    px = _pixels(spark, LINE.astype(int))
    thin = ops.mark_and_erase(px, ops.rule_table(ops.is_border), ops.rule_table(ops.is_kept))
    assert {(r.y, r.x) for r in thin.filter("v = 1").collect()} == {tuple(p) for p in np.argwhere(LINE).tolist()}


def test_streamed_files_count_once(spark, tmp_path):
    from tectra.streaming import images as stream

    files_in, out = tmp_path / "in", str(tmp_path / "out")
    files_in.mkdir()
    for k in range(3):
        (files_in / f"{k}.png").write_bytes(files.encode_png(np.full((2, 3), 10 * k)))
        stream.write_statistics(spark, str(files_in), out, str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(out).orderBy("mean").collect()
    assert [(r.pixels, r.lo, r.hi, r.mean) for r in rows] == [(6, v, v, v) for v in (0.0, 10.0, 20.0)]
