import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lamina import model as D
from lamina.functions import expressions as X
from lamina.functions import kernels as K
from lamina.operators import clean, evaluate, graph, link, overlap, postproc, regions, resample
from lamina.session import cut


def voxels(spark, *stacks):
    """Voxels of dense stacks, one volume each."""
    rows = [(v, int(z), int(y), int(x), int(s[z, y, x])) for v, s in enumerate(stacks) for z, y, x in np.argwhere(s)]
    return spark.createDataFrame(rows, D.VOXEL)


def dense(df, shape, volume=0):
    out = np.zeros(shape, np.int64)
    for r in df.filter(F.col("volume") == volume).collect():
        if "x0" in r:
            out[r["z"], r["y"], r["x0"] : r["x1"]] = r["id"]
        else:
            out[r["z"], r["y"], r["x"]] = r["id"]
    return out


def stack(seed, shape=(6, 12, 14), ids=5, fill=0.5):
    rng = np.random.default_rng(seed)
    coarse = rng.integers(0, ids + 1, (shape[0], -(-shape[1] // 3), -(-shape[2] // 4)))
    big = np.repeat(np.repeat(coarse, 3, 1), 4, 2)[:, : shape[1], : shape[2]]
    return big * (rng.random(shape) < fill + 0.4)


def test_runs_and_voxels_are_inverse(spark):
    s, t = stack(1), stack(2)
    v = voxels(spark, s, t)
    back = D.to_voxels(D.to_runs(v))
    assert (dense(back, s.shape) == s).all() and (dense(back, t.shape, 1) == t).all()
    assert (dense(D.untransposed(D.transposed(v)), s.shape) == s).all()


def test_ids_above_the_limit_fail(spark):
    v = spark.createDataFrame([(0, 0, 0, 0, 70_000)], D.VOXEL)
    with pytest.raises(Exception, match="70000"):
        D.check_ids(v).collect()


def test_components_and_edges(spark):
    s = stack(3)
    parts = overlap.with_global_ids(regions.slice_components(D.to_runs(voxels(spark, s))))
    from lamina.functions.kernels import regions as label

    want, n = np.zeros(s.shape, int), []
    for z in range(len(s)):
        k = 0
        for i in np.unique(s[z][s[z] > 0]):
            lab = label(s[z] == i)
            want[z][lab > 0] = lab[lab > 0] + k
            k += lab.max()
        n.append(k)
    got = np.zeros(s.shape, int)
    for r in parts.collect():
        got[r["z"], r["y"], r["x0"] : r["x1"]] = r["c"]
        assert r["gid"] == sum(n[: r["z"]]) + r["c"]
    assert (got == want).all()
    for dz in (1, 2):
        edges = {(r["z"], r["c_src"], r["c_tgt"]): r for r in overlap.build_edges(parts, dzs=(dz,), min_px=2).collect()}
        count = {}
        for z in range(len(s) - dz):
            a, b = want[z], want[z + dz]
            for p, q in zip(a[(a > 0) & (b > 0)], b[(a > 0) & (b > 0)], strict=True):
                count[z, p, q] = count.get((z, p, q), 0) + 1
        assert {k: r["overlap_px"] for k, r in edges.items()} == {k: n for k, n in count.items() if n >= 2}
        for (z, p, q), r in edges.items():
            a, b = np.argwhere(want[z] == p), np.argwhere(want[z + dz] == q)
            dy, dx = b.mean(0) - a.mean(0)
            assert (r["area_src"], r["area_tgt"]) == (len(a), len(b)) and r["d_centroid"] == pytest.approx(np.hypot(dy, dx))
            assert r["IoU"] == pytest.approx(r["overlap_px"] / (len(a) + len(b) - r["overlap_px"]))


@pytest.mark.parametrize("connectivity", [1, 2, 3])
def test_volume_components(spark, connectivity):
    rng = np.random.default_rng(connectivity)
    s = (rng.random((5, 6, 7)) < 0.25) * rng.integers(1, 4, (5, 6, 7))
    got = dense(regions.volume_components(D.to_runs(voxels(spark, s)), connectivity), s.shape)
    want, n = np.zeros(s.shape, int), 0
    steps = [d for d in np.ndindex(3, 3, 3) if 0 < sum(abs(np.array(d) - 1)) <= connectivity]
    for p in np.argwhere(s > 0):
        if want[tuple(p)]:
            continue
        n += 1
        todo = [tuple(p)]
        want[tuple(p)] = n
        while todo:
            c = todo.pop()
            for d in steps:
                q = tuple(np.array(c) + d - 1)
                if all(0 <= q[i] < s.shape[i] for i in range(3)) and s[q] and not want[q]:
                    want[q] = n
                    todo.append(q)
    assert (got == want).all()


def test_connected_components_do_not_depend_on_edge_order(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    for _ in range(2):
        rng.shuffle(edges)
        turned = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges]
        got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(turned, "a long, b long")).collect()}
        assert got == {x: find(x) for x in root}


def test_tracks_branch_and_gaps_close(spark):
    s = np.zeros((6, 10, 20), int)
    s[0, 2:6, 2:12] = 1
    s[1, 2:6, 2:6], s[1, 2:6, 8:12] = 1, 2  # branches
    s[3, 2:6, 2:6] = 3  # after one missing slice
    s[4, 2:6, 2:6] = 3
    parts = overlap.with_global_ids(regions.slice_components(D.to_runs(voxels(spark, s))))
    edges = overlap.build_edges(parts, dzs=(1, 2)).withColumn("p_link", F.lit(0.9))
    tracks = graph.link_tracks(parts, edges.filter("dz = 1"), 0.5)
    assert sorted({(r["gid"], r["track"]) for r in tracks.collect()}) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    on = parts.join(tracks, ["volume", "gid"])
    forward, backward = overlap.endpoints(on), overlap.endpoints(on, forward=False)
    assert sorted((r["z"], r["c"]) for r in forward.collect()) == [(1, 1), (1, 2), (4, 1)]
    assert sorted((r["z"], r["c"]) for r in backward.collect()) == [(0, 1), (3, 1)]
    links = graph.gap_links(edges, forward, backward)
    assert [(r["gid_src"], r["gid_tgt"]) for r in links.collect()] == [(2, 4)]
    assert {r["track"] for r in graph.fill_gaps(tracks, links).collect()} == {1}


def test_equal_links_go_by_component_number(spark):
    edges = spark.createDataFrame([(0, 0, 2, s, t, s, 10 + t, 0.9, 0.0, 1.0) for s, t in ((2, 1), (1, 1), (2, 2))], "volume long, z int, dz int, c_src int, c_tgt int, gid_src long, gid_tgt long, p_link double, d_centroid double, area_ratio double")
    ends = lambda z: spark.createDataFrame([(0, z, 1), (0, z, 2)], "volume long, z int, c int")
    assert sorted((r["c_src"], r["c_tgt"]) for r in graph.gap_links(edges, ends(0), ends(2)).collect()) == [(1, 1), (2, 2)]


def scores_by_hand(gt, pred, t):
    g, p = np.unique(gt[gt > 0]), [i for i in np.unique(pred[pred > 0]) if ((pred == i) & (gt > 0)).any()]
    w = np.array([[((gt == a) & (pred == b)).sum() / ((gt == a) | (pred == b)).sum() for b in p] for a in g]).astype(np.float32)
    ok = w * (w >= t)
    tp = sum(ok[r, c] > 0 for r, c in graph.assign(ok.astype(float)))
    return int(tp), len(p) - int(tp), len(g) - int(tp)


def test_sweep_and_panoptic(spark):
    gt, pred = stack(7, ids=6), stack(7, ids=6)
    rng = np.random.default_rng(2)
    pred = np.where(rng.random(pred.shape) < 0.25, rng.permutation(7)[pred], pred)
    a, b = D.to_runs(voxels(spark, gt)), D.to_runs(voxels(spark, pred))
    for r in evaluate.threshold_sweep(a, b).collect():
        assert (r["TP"], r["FP"], r["FN"]) == scores_by_hand(gt, pred, r["IoU_threshold"])
    table = evaluate.panoptic_table(a, b).collect()
    tp, fp, fn = scores_by_hand(gt, pred, 0.5)
    assert [sum(r["Match"] == m for r in table) for m in ("TP", "FP", "FN")] == [tp, fp, fn]
    one = evaluate.summary(a, b, "g", "p").first()
    assert len(one) == 22 and one["TP_instances"] == tp


def test_a_volume_against_itself_is_perfect(spark):
    a = D.to_runs(voxels(spark, stack(9)))
    r = evaluate.panoptic(a, a).first()
    assert (r["PQ"], r["FP"], r["FN"]) == (1.0, 0, 0)
    s = evaluate.semantic(a, a).first()
    assert s["dice_full"] == s["prec_sparse"] == 1.0


def test_no_match_gives_zero_and_all_rows(spark):
    gt, pred = np.zeros((1, 4, 8), int), np.zeros((1, 4, 8), int)
    gt[0, 0, :8], pred[0, 0, 7:], pred[0, 1:, :] = 1, 5, 5
    a, b = D.to_runs(voxels(spark, gt)), D.to_runs(voxels(spark, pred))
    r = evaluate.panoptic(a, b).first()
    assert (r["PQ"], r["TP"], r["FP"], r["FN"]) == (0.0, 0, 1, 1)
    assert sorted(x["Match"] for x in evaluate.panoptic_table(a, b).collect()) == ["FN", "FP"]


def test_float_iou_at_the_threshold(spark):
    pairs = spark.createDataFrame([(0, 1, 1, 0.7), (0, 2, 2, 0.5)], "volume long, gt_id long, pred_id long, iou double")
    assert graph.match(pairs, 0.7).count() == 0  # 0.7 as a float lies below 0.7
    assert graph.match(pairs, 0.5).count() == 2


def test_expressions(spark):
    f = lambda *c: spark.range(1).select(*c).first()
    lit = lambda *v: [F.lit(x) for x in v]
    assert tuple(f(*X.corners(F.lit(0.1), F.lit(0.5), F.lit(0.3), F.lit(0.2), 100))) == (0, 40, 25, 60)
    assert f(X.bbox_iou(lit(0, 0, 4, 4), lit(2, 2, 6, 6)))[0] == pytest.approx(4 / 28)
    assert f(X.box_iou(lit(0, 0, 1, 1), lit(5, 5, 6, 6)))[0] == 0.0
    assert f(X.pair_score(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(None).cast("double"), 2))[0] == pytest.approx(1.5)
    names = spark.createDataFrame([("s10.png",), ("s2.png",), ("s1.png",)], "n string")
    assert [r["n"] for r in names.orderBy(X.natural_key(F.col("n"))).collect()] == ["s1.png", "s2.png", "s10.png"]


def test_missing_boxes(spark):
    s = np.zeros((4, 40, 40), int)
    s[0, 5:25, 5:25], s[2, 5:25, 5:25], s[3, 5:25, 5:25] = 1, 1, 1
    s[3, 28:38, 28:38] = 2  # missing on slices 1 and 2
    two, three = clean.missing_boxes(voxels(spark, s), min_area=50)
    box = lambda df: sorted((r["y0"], r["x0"], r["y1"], r["x1"]) for r in df.collect())
    assert box(two) == [(5, 5, 25, 25), (28, 28, 38, 38)] and box(three) == [(28, 28, 38, 38)]
    assert clean.missing_boxes(voxels(spark, s[:3]), min_area=50)[0].count() == 0
    names = spark.createDataFrame([(f"{z}.png", z) for z in range(4)], "image_name string, z int")
    old = spark.createDataFrame([("1.png", 1, 0, 0, 0, 9, 9)], D.BOX)
    new = clean.update_boxes(old, voxels(spark, s), names, min_area=50)
    assert sorted((r["image_name"], r["ord"]) for r in new.collect()) == [("1.png", 0), ("1.png", 1), ("1.png", 2)]


def joins(df):
    """Joins in a plan, whose sides Spark may broadcast by a guess."""
    return df._jdf.queryExecution().executedPlan().toString().count("Join")


@pytest.mark.parametrize("of", [(2, 1), (3, 2, 1)])
def test_windows_of_runs_over_chunks(spark, of):
    s = stack(7, shape=(2 * overlap.CHUNK + 5, 12, 14), fill=0.3)
    got = overlap.absent_from(D.to_runs(voxels(spark, s)), *of)
    assert not joins(got)
    at = {(r["z"], r["y"], x) for r in got.collect() for x in range(r["x0"], r["x1"])}
    on = lambda z, y, x: 0 <= z < len(s) and s[z, y, x] > 0
    want = {(z - of[0], y, x) for z, y, x in np.argwhere(s).tolist() if not any(on(z - of[0] + e, y, x) for e in of[1:])}
    assert at == want


def test_missing_boxes_of_runs_over_chunks(spark):
    s = np.zeros((2 * overlap.CHUNK + 6, 12, 30), int)
    s[::2, 1:6, 2:8] = 1  # on every other slice
    s[::3, 2:9, 12:20], s[1::3, 2:9, 22:28] = 2, 3
    two, three = clean.missing_boxes(D.to_runs(voxels(spark, s)), min_area=20)
    assert joins(two) <= 1  # only with the depth of a volume
    gone = lambda z, later, *earlier: (s[z + later] > 0) & ~(s[[z + e for e in earlier]] > 0).any(0)
    box = lambda m: {tuple(int(v) for v in K.box_of(labels == i)) for labels in [K.regions(m)] for i in range(1, labels.max() + 1)}
    for found, *masks in ((two, (2, 1), (3, 1), (3, 2, 1)), (three, (3, 2, 1))):
        want = {(z, *b) for z in range(len(s) - 3) for of in masks for b in box(gone(z, *of))}
        assert {(r["z"], r["y0"], r["x0"], r["y1"], r["x1"]) for r in found.collect()} == want


def test_neighbour_vote_of_runs(spark):
    s = stack(3, shape=(2, 14, 20), fill=0.5)
    got = overlap.neighbour_vote(D.to_runs(voxels(spark, s)))
    assert not joins(got)
    want = {}
    for z, i in {(z, s[z, y, x]) for z, y, x in np.argwhere(s).tolist()}:
        ring = K.dilate(s[z] == i, K.FOUR) & (s[z] > 0) & (s[z] != i)
        n = np.bincount(s[z][ring], minlength=1)
        if n.any():
            want[z, i] = int(np.argmax(n)), int(n.max())
    assert {(r["z"], r["id"]): (r["neighbour"], r["n"]) for r in got.collect()} == want


@pytest.mark.parametrize("connectivity", [1, 2, 3])
def test_components_over_slabs(spark, connectivity):
    s = (np.random.default_rng(connectivity).random((2 * regions.SLAB + 3, 5, 9)) < 0.25) * 1
    runs = D.to_runs(voxels(spark, s))
    parts = regions._components(runs, connectivity)[1]
    assert parts.count() < runs.count()  # the graph holds parts of slabs, not runs
    got = dense(regions.volume_components(runs, connectivity), s.shape)
    want, n = np.zeros_like(s), 0
    for start in np.argwhere(s).tolist():
        if want[tuple(start)]:
            continue
        n, todo = n + 1, [start]
        want[tuple(start)] = n
        while todo:
            at = todo.pop()
            for d in np.ndindex(3, 3, 3):
                p = tuple(a + k - 1 for a, k in zip(at, d, strict=True))
                if 0 < sum(k != 1 for k in d) <= connectivity and all(0 <= a < m for a, m in zip(p, s.shape, strict=True)) and s[p] and not want[p]:
                    want[p] = n
                    todo.append(p)
    assert (got == want).all()
    size = np.bincount(want.ravel())
    big = dense(regions.large_regions(runs, 12, connectivity), s.shape)
    assert (big == np.where(size[want] >= 12, want, 0)).all()


def test_shapes_of_chunks_of_slices(spark):
    s = stack(5, shape=(regions.SHAPE_SLICES + 2, 12, 14), fill=0.4)
    got = regions.shapes(D.to_runs(voxels(spark, s)))
    assert "_slices" in got._jdf.queryExecution().executedPlan().toString()  # not one group an object
    rows = {(r["z"], r["id"]): r for r in got.collect()}
    assert set(rows) == {(int(z), int(s[z, y, x])) for z, y, x in np.argwhere(s)}
    for (z, i), r in rows.items():
        mask = K.largest(s[z] == i)
        assert (r["area"], r["y0"], r["x0"], r["y1"], r["x1"]) == (int(mask.sum()), *K.box_of(mask))
        assert (r["cy"], r["cx"], r["solidity"], r["eccentricity"]) == pytest.approx((*K.centre(mask), K.solidity(mask), K.eccentricity(mask)))


@pytest.mark.parametrize("thresholds", [[0.1, 0.3, 0.5], [0.5]])
def test_matching_groups_blocks(spark, thresholds):
    rng = random.Random(4)
    rows = {(v, rng.randint(1, 40), rng.randint(1, 40)): rng.choice([0.05, 0.1, 0.2, 0.35, 0.5, 0.8]) for v in (0, 1) for _ in range(45)}
    pairs = spark.createDataFrame([(*k, x) for k, x in rows.items()], "volume long, gt_id long, pred_id long, iou double")
    found = graph.match_each(pairs, thresholds)
    assert "_group" in found._jdf.queryExecution().executedPlan().toString()  # not one group a block
    taken = [tuple(r) for r in found.collect()]
    for t in thresholds:
        for v in (0, 1):
            w = np.zeros((41, 41))
            for (u, g, p), x in rows.items():
                if u == v and np.float32(x) >= t:
                    w[g, p] = np.float32(x)
            mine = [r for r in taken if r[0] == v and r[4] == t]
            assert len({r[1] for r in mine}) == len({r[2] for r in mine}) == len(mine)
            assert sum(np.float32(r[3]) for r in mine) == pytest.approx(sum(w[a, b] for a, b in graph.assign(w)))


def test_summary_counts_voxels_of_pairs(spark):
    a, b = stack(1), stack(2)
    gt, pred = (cut(D.to_runs(voxels(spark, s))) for s in (a, b))
    assert cut(gt) is gt  # a stored table isn't stored again
    pairs = overlap.instance_pairs(gt, pred)
    assert [tuple(r) for r in evaluate.semantic_counts(gt, pred, pairs).collect()] == [(0, int(((a > 0) & (b > 0)).sum()), int(((a == 0) & (b > 0)).sum()), int(((a > 0) & (b == 0)).sum()))]


def test_edges_over_chunks_join_nothing(spark):
    """Components and edges come from groups of slices, and each end has its parent."""
    s = stack(13, shape=(2 * overlap.CHUNK + 5, 12, 14), fill=0.6)
    runs = regions.slice_components(D.to_runs(voxels(spark, s)))
    assert "_slices" in runs._jdf.queryExecution().executedPlan().toString()  # not one group a slice
    parts = cut(overlap.with_global_ids(runs))
    assert not joins(overlap.training_edges(parts, dzs=(1, 2)))
    owner = np.zeros(s.shape, int)
    for r in parts.collect():
        owner[r["z"], r["y"], r["x0"] : r["x1"]] = r["gid"]
    for z in range(len(s)):
        labels = [K.regions(s[z] == i) for i in np.unique(s[z][s[z] > 0])]
        assert len(np.unique(owner[z][owner[z] > 0])) == sum(int(m.max()) for m in labels)
    c = owner - np.maximum.accumulate(np.concatenate([[0], owner.max((1, 2))[:-1]]))[:, None, None]
    want = {}
    for dz in (1, 2):
        for z, y, x in np.argwhere((owner[:-dz] > 0) & (owner[dz:] > 0)).tolist():
            k = z, dz, int(c[z, y, x]), int(c[z + dz, y, x]), int(s[z, y, x]), int(s[z + dz, y, x]), int(s[z, y, x] == s[z + dz, y, x])
            want[k] = want.get(k, 0) + 1
    got = overlap.training_edges(parts, dzs=(1, 2), min_px=3).collect()
    names = ("z", "dz", "c_src", "c_tgt", "inst_src", "inst_tgt", "label_same")
    assert len(got) and {tuple(r[k] for k in names): r["overlap_px"] for r in got} == {k: n for k, n in want.items() if n >= 3}


@pytest.mark.parametrize("forward", [True, False])
def test_endpoints_over_chunks(spark, forward):
    s = stack(9, shape=(2 * overlap.CHUNK + 3, 9, 12), fill=0.2)
    runs = regions.slice_components(D.to_runs(voxels(spark, s))).withColumn("track", F.col("id") % 3)
    got = overlap.endpoints(runs, forward=forward)
    assert not joins(got)
    rows, step = runs.collect(), 1 if forward else -1
    at = {(r["z"], r["y"], x): r for r in rows for x in range(r["x0"], r["x1"])}
    going = {(r["z"], r["c"]) for (z, y, x), r in at.items() if (z + step, y, x) in at and at[z + step, y, x]["track"] == r["track"]}
    assert sorted((r["z"], r["c"]) for r in got.collect()) == sorted({(r["z"], r["c"]) for r in rows} - going)


def test_duplicate_boxes_first_come(spark):
    rows = [(0, 0, k, *b) for k, b in enumerate([(0, 0, 10, 10), (0, 0, 10, 9), (0, 0, 10, 7)])]
    kept = graph.drop_duplicate_boxes(spark.createDataFrame(rows, "volume long, z int, ord long, y0 int, x0 int, y1 int, x1 int"))
    assert sorted(r["ord"] for r in kept.collect()) == [0, 2]


def test_clean_slices(spark):
    s = np.zeros((1, 30, 30), int)
    s[0, 2:20, 2:20] = 1
    s[0, 8:12, 8:12] = 0
    s[0, 25:27, 25:27] = 1  # too small
    s[0, 9:11, 9:11] = 2  # smaller id's hole holds it; it is too small to stay
    out = dense(clean.clean_slices(D.to_runs(voxels(spark, s)), min_area=20), s.shape)
    assert (out[0, 2:20, 2:20] == 1).all() and out[0, 25, 25] == 0


def test_merge_filter_and_vote(spark):
    a, b = np.zeros((1, 3, 6), int), np.zeros((1, 3, 6), int)
    a[0, 0, :4], b[0, :2, :5] = 1, 2
    merged = dense(overlap.merge_volumes(voxels(spark, a), voxels(spark, b)), a.shape)
    assert (merged[0, 0] == [1, 1, 1, 1, 2, 0]).all()
    big = overlap.keep_large(D.to_runs(voxels(spark, merged)), 5)
    assert {r["id"] for r in big.collect()} == {2}
    vote = overlap.neighbour_vote(voxels(spark, merged)).filter("id = 1").first()
    assert (vote["neighbour"], vote["n"]) == (2, 5)


def test_upscale_drops_thin_objects(spark):
    s = np.zeros((3, 4, 4), int)
    s[0, 1:3, 1:3] = 1  # one slice
    s[:, 0, 3] = 2  # one pixel wide, wide enough when doubled
    v = voxels(spark, s)
    out = dense(resample.upscale_instances(v, (3, 4, 4), (3, 8, 8)), (3, 8, 8))
    assert set(np.unique(out)) == {0, 2} and (out[:, 0:2, 6:8] == 2).all()
    assert (dense(resample.upscale_instances(v, (3, 4, 4), (3, 8, 8), keep_thin=True), (3, 8, 8))[0, 2:6, 2:6] == 1).all()


def test_refine_adds_touching_regions_inside_the_box(spark):
    s = np.zeros((2, 8, 8), int)
    s[0, 2:4, 2:4], s[1, 2:7, 2:7] = 1, 1
    p = np.zeros(s.shape)
    p[0, 3, 3:8], p[0, 6, 5:7] = 0.99, 0.99  # one touches and leaves the box, one is apart
    rows = [(0, int(z), int(y), int(x), float(p[z, y, x])) for z, y, x in np.argwhere(p)]
    prob = spark.createDataFrame(rows, "volume long, z int, y int, x int, p double")
    out = dense(resample.refine(voxels(spark, s), prob), s.shape)
    assert (out[0, 3] == [0, 0, 1, 1, 1, 1, 1, 0]).all() and out[0, 6].sum() == 0


def test_resize_rules(spark):
    s = np.arange(1, 13).reshape(1, 3, 4)
    for rule, index in (("centre", lambda i, a, b: int((i + 0.5) * a // b)), ("floor", lambda i, a, b: i * a // b)):
        out = dense(resample.resize_slices(voxels(spark, s), (3, 4), (5, 3), rule), (1, 5, 3))
        assert (out[0] == [[s[0, index(i, 3, 5), index(j, 4, 3)] for j in range(3)] for i in range(5)]).all()


def test_repair_harmonize_and_absorb_by_volume(spark):
    s = np.zeros((7, 16, 16), int)
    s[:, 3:13, 3:13] = 4
    s[3] = 0
    s[4:][s[4:] == 4] = 6
    runs = D.to_runs(voxels(spark, s, s))
    out = postproc.harmonize_ids(runs)
    assert all((dense(out, s.shape, v)[:, 3:13, 3:13] == 4).all() for v in (0, 1))
    assert dense(postproc.harmonize_ids(D.to_runs(voxels(spark, s[:4]))), s[:4].shape).sum() == s[:4].sum()
    fixed, log = postproc.repair(voxels(spark, s), postproc.Repair(chunk_size=4, min_area=10))
    assert fixed.count() > 0 and set(log.columns) >= {"slice_index", "mode"}
    assert postproc.merge_repaired(voxels(spark, s), fixed, 5).count() > 0


def test_chunks_are_packed_alike_from_batches_of_any_size(spark):
    """Chunks are shuffled as packed rows; a chunk whose runs come in many batches is whole again."""
    rng = np.random.default_rng(3)
    s = np.kron(rng.integers(0, 4, (2, 5, 6, 7)), np.ones((1, 1, 2, 3), int))
    runs = D.to_runs(voxels(spark, *s))
    cfg = postproc.Repair(chunk_size=4, min_area=2, closing_radius=1, coverage_min=0.2, bbox_iou_min=0.1, solidity_min=0.3, eccentricity_max=1.0)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    found = []
    for size in ("10000", "5"):
        spark.conf.set(key, size)
        fixed, log = postproc.repair(runs, cfg)
        found.append((sorted(map(tuple, fixed.collect())), sorted(map(tuple, log.collect()))))
    spark.conf.unset(key)
    assert found[0] == found[1] and found[0][1]
    packed = postproc._chunks(runs, cfg, True)
    assert packed.count() == 2 * 6 and dict(packed.dtypes)["log"] == "binary"
    assert postproc._log_of(packed).columns == [c.split()[0] for c in postproc.LOG.split(", ")]


def test_chunks_of_the_forward_pass_agree_with_one_sweep_when_nothing_crosses(spark):
    s = np.zeros((8, 20, 20), int)
    y, x = np.mgrid[:20, :20]
    blob = (y - 10) ** 2 + (x - 10) ** 2 <= 49
    for z in range(8):
        s[z][blob] = 1 if z % 4 == 0 else 2
    cfg = lambda n: postproc.Repair(chunk_size=n)
    runs = D.to_runs(voxels(spark, s))
    whole = dense(postproc.forward_pass(runs, cfg(64))[0], s.shape)
    assert (whole == np.where(s > 0, 1, 0)).all()
    assert (dense(postproc.forward_pass(runs, cfg(4))[0], s.shape) == whole).all()
    assert (dense(postproc.forward_pass(runs, cfg(1))[0], s.shape) == whole).all()


def test_forest_is_better_than_chance(spark, tmp_path):
    from lamina.plans import fixture

    edges = overlap.training_edges(overlap.with_global_ids(regions.slice_components(fixture.pred_runs(spark, "/root/testdata/sf0.001"))))
    train, held = link.stratified_split(edges)
    assert train.count() + held.count() == edges.count() and train.join(held, ["volume", "z", "c_src", "c_tgt"], "left_semi").count() == 0
    model = link.train_forest(train, trees=10, depth=6)
    scored = link.score_edges(held, model)
    r = link.ranking_scores(scored).first()
    assert r["roc_auc"] > 0.7 and r["average_precision"] > 0.5
    assert sum(w for _, w in link.importances(model)) == pytest.approx(1.0) and link.classification_report(scored).count() == 2
    assert link.score_edges(edges.limit(0), model).columns[-1] == "p_link"
    link.save_model(model, f"file://{tmp_path}/forest")
    again = link.score_edges(held, link.load_model(f"file://{tmp_path}/forest"))
    assert link.ranking_scores(again).first()["roc_auc"] == pytest.approx(r["roc_auc"])
    with pytest.raises(ValueError):
        link.link_volume(None, model, "other")


def test_ranking_scores_by_hand(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.2)]
    r = link.ranking_scores(spark.createDataFrame(rows, "label_same int, p_link double")).first()
    assert r["roc_auc"] == pytest.approx((0.5 + 1 + 0 + 1) / 4) and r["average_precision"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)


def test_forest_grows_trees_as_rows_of_a_table_and_scores_by_their_mean(spark):
    from lamina.model import FEATURES
    from lamina.operators import forest

    rng = np.random.default_rng(3)
    x = np.round(rng.random((600, len(FEATURES))), 2)
    rows = pd.DataFrame(x, columns=FEATURES).assign(label_same=((x[:, 1] > 0.5) ^ (x[:, 3] > 0.3)).astype("int32"), n=np.arange(600))
    edges = spark.createDataFrame(pd.concat([rows, rows.iloc[:50]]))
    model = link.train_forest(edges, trees=40)
    trees = [[np.frombuffer(r[c], t) for c, t in (("feature", np.int8), ("bin", np.uint8), ("child", np.int32), ("p", np.float32))] for r in model.trees.orderBy("tree").collect()]
    assert len(trees) == 40 and len({t[0].tobytes() for t in trees}) > 30
    bins = forest.bins_of(forest.keys_of([rows[c].to_numpy() for c in FEATURES], model.cuts), len(FEATURES))
    want = np.mean([forest.walk(bins, *t) for t in trees], axis=0)
    for k in range(0, 600, 97):  # one row down one tree, step by step
        feature, place, child, p = trees[k % 40]
        node = 0
        while feature[node] >= 0:
            node = child[node] + int(bins[feature[node], k] > place[node])
        assert forest.walk(bins[:, k : k + 1], *trees[k % 40])[0] == p[node]
    got = link.score_edges(edges, model).toPandas()
    assert len(got) == 650 and np.allclose(got["p_link"], want[got["n"]])
    assert ((want > 0.5) == (rows["label_same"] == 1)).mean() > 0.95
    assert {c for c, _ in link.importances(model)[:2]} == {FEATURES[1], FEATURES[3]}


def test_a_tree_takes_the_best_split_and_keeps_its_leaves_and_depth():
    from lamina.operators import forest

    bins = np.array([[0, 1, 2, 3, 4, 5]], np.uint8)
    counts = np.array([[400, 400, 400, 0, 0, 0], [0, 0, 0, 400, 400, 400]])
    feature, place, child, p, gain = forest.grow(bins, counts, (1.0, 1.0), np.random.default_rng(0), depth=30, min_leaf=2)
    assert feature.tolist() == [0, -1, -1] and place[0] == 2 and child[0] == 1 and p[1:].tolist() == [0, 1] and gain[0] > 0
    assert forest.walk(bins, feature, place, child, p).tolist() == [0, 0, 0, 1, 1, 1]
    assert len(forest.grow(bins, counts, (1.0, 1.0), np.random.default_rng(0), depth=0, min_leaf=2)[0]) == 1
    assert len(forest.grow(bins, counts, (1.0, 1.0), np.random.default_rng(0), depth=30, min_leaf=2000)[0]) == 1
    keys = forest.keys_of([np.array([0.1, 0.5, 0.6, np.nan])], [[0.5]])
    assert forest.bins_of(keys, 1).tolist() == [[0, 0, 1, 1]]


def test_components_in_memory_and_in_rounds(spark, monkeypatch):
    """Groups of few edges are joined by one task each, others in rounds over the shared folder, alike."""
    rng = np.random.default_rng(3)
    rows = [(int(v), int(a), int(b)) for v, a, b in zip(rng.integers(0, 3, 120), rng.integers(0, 60, 120), rng.integers(0, 60, 120), strict=True)]
    edges = spark.createDataFrame(rows, "volume long, a long, b long")
    found = lambda: sorted(map(tuple, graph.connected_components(edges, keys=["volume"]).collect()))
    small = found()
    monkeypatch.setattr(graph, "GROUP_EDGES", 0)
    assert small == found() and len({(v, r) for v, _, r in small}) < len(small)
    assert graph.connected_components(edges.filter("a > 99"), keys=["volume"]).count() == 0


def test_linking_takes_components_as_they_are(spark, monkeypatch):
    """Runs that carry components aren't labelled again."""
    s = np.zeros((3, 12, 12), int)
    s[:, 2:8, 2:8] = 1
    parts = overlap.with_global_ids(regions.slice_components(D.to_runs(voxels(spark, s))))
    monkeypatch.setattr(link, "score_edges", lambda edges, model: edges.withColumn("p_link", F.lit(1.0)))
    monkeypatch.setattr(link, "slice_components", None)
    for linked in (link.link_full(parts, None)[1], link.link_iterative(parts, None)["linked"]):
        assert linked.select("id").distinct().count() == 1 and linked.count() == 18


def test_edges_and_training_edges_come_from_one_table_of_meetings(spark):
    rng = np.random.default_rng(5)
    s = np.kron(rng.integers(0, 4, (2, 20, 5, 6)), np.ones((1, 1, 3, 4), int))
    parts = overlap.with_global_ids(regions.slice_components(D.to_runs(voxels(spark, *s))))
    met = overlap.meetings(parts)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(overlap.build_edges(met, dzs=(1, 2), min_px=5)) == rows(overlap.build_edges(parts, dzs=(1, 2), min_px=5))
    assert rows(overlap.training_edges(met, dzs=(2,))) == rows(overlap.training_edges(parts, dzs=(2,)))
    assert rows(link._components(met)) == rows(parts.select("volume", "gid").distinct())


def test_iterative_linking_in_memory_and_over_tables(spark, monkeypatch):
    """Volumes of few pairs are linked by one task each, others by joins, alike; gaps, ends and ties included."""
    rng = np.random.default_rng(7)
    s = np.kron(rng.integers(0, 3, (3, 20, 6, 6)) * (rng.random((3, 20, 6, 6)) < 0.8), np.ones((1, 1, 3, 3), int))
    runs = D.to_runs(voxels(spark, *s))
    monkeypatch.setattr(link, "score_edges", lambda edges, model: edges.withColumn("p_link", F.round("IoU", 1)))
    shuffled = []
    monkeypatch.setattr(link, "endpoints", lambda *a, f=link.endpoints, **k: shuffled.append(1) or f(*a, **k))
    found = []
    for most in (graph.GROUP_EDGES, 0):
        monkeypatch.setattr(graph, "GROUP_EDGES", most)
        out = link.link_iterative(runs, None, min_px=3, p_dz1=0.5, p_dz2=0.2, d_max=5.0, ratio_min=0.2)
        found.append([sorted(map(tuple, out[k].collect())) for k in ("linked_a", "linked")])
        assert len(shuffled) == (0 if most else 2)
    assert found[0] == found[1] and found[0][0] != found[0][1]


@pytest.mark.parametrize("canvas", [1, 1 << 22])
def test_grown_slices_against_regions(canvas, monkeypatch):
    """A chunk grown at once equals each id grown alone, slice by slice."""
    from lamina.functions import kernels as K

    monkeypatch.setattr(resample, "CANVAS", canvas)
    for seed in range(12):
        rng = np.random.default_rng(seed)
        ids = np.kron(rng.integers(0, 5, (3, 5, 6)), np.ones((1, 4, 4), int)) * (rng.random((3, 20, 24)) < 0.7)
        sure, want = rng.random(ids.shape) < 0.5, ids.copy()
        box = {}
        for i in np.unique(ids[ids > 0]).tolist():
            _, y, x = np.nonzero(ids == i)
            box[i] = int(y.min()), int(x.min()), int(y.max()) + 1, int(x.max()) + 1
            inside = np.s_[box[i][0] : box[i][2], box[i][1] : box[i][3]]
            for z in range(3):
                labels = K.regions(sure[z][inside])
                hit = np.unique(labels[ids[z][inside] == i])
                want[z][inside] = np.maximum(want[z][inside], i * np.isin(labels, hit[hit > 0]))
        flat = lambda s: [c.astype(np.int64) for c in (lambda y, a, b, v: (y // 20 + 32, y % 20, a, b, v))(*K.runs(s.reshape(60, 24).astype(np.int64)))]  # noqa: B023, E731
        z, y, a, b, v = resample.grown(tuple(flat(ids)), tuple(flat(sure)), box)
        assert (K.paint((60, 24), (z - 32) * 20 + y, a, b, v) == want.reshape(60, 24)).all()


def test_alignment_takes_runs_and_pixels(spark):
    """Images given as runs are aligned like the same images given as pixels."""
    rng = np.random.default_rng(5)
    runs = [(z, y, 5, 5 + int(n), float(v)) for z in range(18) for y, n, v in zip(range(4, 14), rng.integers(1, 9, 10), rng.integers(1, 5, 10), strict=True)]
    moved = [(z, y + z % 3, a + 1, b + 1, v) for z, y, a, b, v in runs]
    lines = lambda rows: spark.createDataFrame(rows, "z int, y int, x0 int, x1 int, value double")
    points = lambda rows: spark.createDataFrame([(z, y, x, v) for z, y, a, b, v in rows for x in range(a, b)], "z int, y int, x int, value double")
    found = [[sorted(map(tuple, t.collect())) for t in resample.inverse_align(of(runs), of(moved), of(moved), (24, 20), (24, 20))] for of in (lines, points)]
    assert found[0] == found[1] and {z for z, *_ in found[0][1]} == set(range(18))
