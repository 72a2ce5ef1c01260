import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lamina import model as D
from lamina.operators.postproc import harmonize_ids
from lamina.plans import catalogue, workflow
from lamina.sources import codecs, readers
from lamina.sources.segmenter import PaintBoxes
from lamina.streaming.harmonize import harmonize_stream

from . import pixels


def test_slices_in_natural_order(spark, tmp_path):
    for name, value in (("2.png", 1), ("10.png", 2), ("._2.png", 9)):
        (tmp_path / name).write_bytes(codecs.write_png(np.full((2, 3), value, np.uint16)))
    got = readers.read_volume(spark, f"file://{tmp_path}").groupBy("z").agg(F.max("id").alias("id"), F.count("*").alias("n")).orderBy("z").collect()
    assert [tuple(r) for r in got] == [(0, 1, 6), (1, 2, 6)]
    with pytest.raises(FileNotFoundError):
        readers.read_volume(spark, f"file://{tmp_path}", pattern="*.jpg")


def test_stack_shape_and_tables(spark, tmp_path):
    stack = np.arange(24, dtype=np.uint16).reshape(2, 3, 4)
    (tmp_path / "a.tif").write_bytes(codecs.write_tiff(stack))
    v = readers.read_volume(spark, f"file://{tmp_path}", pattern="*.tif")
    assert v.count() == 23 and tuple(readers.read_shape(spark, f"file://{tmp_path}").first()) == (0, 2, 3, 4)
    readers.write_table(v, f"file://{tmp_path}/t")
    assert readers.load_volume(spark, f"file://{tmp_path}/t").count() == 23 and readers.load_volume(spark, v) is v
    for kind in ("png", "tif"):
        row = readers.encode_slices(v, (3, 4), kind).filter("z = 1").first()
        assert (readers.decode(bytes(row["content"]))[0] == stack[1]).all()


def test_yolo_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.5 0.5 0.2 0.2 0.9\n1 0.1 0.1 0.4 0.4\n\n0  0.25 0.5 0.1 0.1 0.5 7\n")
    (tmp_path / "b.txt").write_text("")
    boxes, rejected = readers.read_yolo(spark, f"file://{tmp_path}", image_size=100)
    assert [tuple(r) for r in boxes.orderBy("ord").collect()] == [("a.png", 0, 40, 40, 60, 60), ("a.png", 1, 20, 45, 30, 55)]
    assert {r["image_name"]: r["rejected"] for r in rejected.collect()} == {"a.png": 1}
    names = lambda *n: spark.createDataFrame(list(zip(n, range(len(n)), strict=True)), "image_name string, z int")
    with pytest.raises(KeyError, match="a.png"):
        readers.boxes_by_slice(boxes, names("c.png"))
    with pytest.raises(KeyError, match="b.png"):
        readers.boxes_by_slice(boxes, names("a.png", "b.png"))
    listed = readers.yolo_images(spark, f"file://{tmp_path}")
    assert readers.boxes_by_slice(boxes, names("a.png", "b.png"), listed).count() == 2
    with pytest.raises(KeyError, match="c.png"):
        readers.boxes_by_slice(boxes, names("a.png", "c.png"), listed)


def test_probabilities_and_edges(spark, tmp_path):
    (tmp_path / "p").mkdir()
    for z in (0, 1):
        np.savez(tmp_path / "p" / f"s{z}.npz", probabilities=np.stack([np.full((1, 2, 2), 0.25), np.full((1, 2, 2), 0.5 * z)]))
    p = readers.read_probabilities(spark, f"file://{tmp_path}/p")
    shape = spark.createDataFrame([(0, 2, 2, 2)], D.META)
    assert tuple(readers.probability_stats(p, shape).first()) == (0, 0.0, 0.5, 0.25)
    assert readers.read_probabilities(spark, f"file://{tmp_path}/p", above=0.4).count() == 4
    edges = spark.createDataFrame([(0, 1, 1, 2, 3, 9, 0.5)], "volume long, z int, dz int, c_src int, c_tgt int, overlap_px long, IoU double")
    readers.write_csv(edges, f"file://{tmp_path}/e")
    assert readers.read_edges(spark, f"file://{tmp_path}/e").collect() == edges.collect()


def boxes_of(spark):
    rows = [(f"{z}.png", z, 0, 10, 10, 40, 40) for z in range(5) if z != 2] + [("2.png", 2, 0, 60, 60, 90, 90)]
    names = spark.createDataFrame([(f"{z}.png", z) for z in range(5)], "image_name string, z int")
    return spark.createDataFrame(rows, D.BOX), names


def test_segmentation_loop_recovers_a_missing_object(spark):
    boxes, names = boxes_of(spark)
    runs, final = workflow.segmentation_loop(boxes, names, PaintBoxes(), (100, 100), iterations=2, update_after=(1,), min_area=50)
    assert runs.filter("z = 2 and x0 < 40").count() > 0 and final.count() > boxes.count()
    done = spark.createDataFrame([(0, z, 0, 0, 1) for z in range(5)], D.VOXEL)
    again, _ = workflow.segmentation_loop(boxes, names, PaintBoxes(), (100, 100), iterations=1, update_after=(), min_area=1, resume=[done])
    assert again.count() == 5  # nothing is segmented again
    empty = spark.createDataFrame([], D.VOXEL)
    slices = spark.range(5).select(F.col("id").cast("int").alias("z"))
    none, _ = workflow.segmentation_loop(boxes, None, PaintBoxes(), (100, 100), iterations=1, update_after=(), min_area=1, resume=[empty], finished=[slices])
    assert none.count() == 0  # finished slices may be empty


def test_segmentation_loop_stores_its_iterations(spark, tmp_path):
    boxes, names = boxes_of(spark)
    options = {"iterations": 2, "update_after": (1,), "min_area": 50, "store": f"file://{tmp_path}"}
    runs, final = workflow.segmentation_loop(boxes, names, PaintBoxes(), (100, 100), **options)
    want = sorted(map(tuple, runs.collect())), sorted(map(tuple, final.collect()))

    class Fails:
        def __call__(self, z, boxes, shape):
            raise AssertionError("segmented again")

    runs, final = workflow.segmentation_loop(boxes, names, Fails(), (100, 100), **options)
    assert (sorted(map(tuple, runs.collect())), sorted(map(tuple, final.collect()))) == want


def test_files_out(spark, tmp_path):
    stack = np.zeros((4, 6, 7), np.int64)
    stack[0, 1:3, 2:5], stack[2, 4, 4], stack[3, 5, 6] = 3, 70_000, 9
    v = spark.createDataFrame([(0, *map(int, p), int(stack[tuple(p)])) for p in np.argwhere(stack)], D.VOXEL)
    assert readers.write_slices(v.filter("id < 70000"), (6, 7), f"file://{tmp_path}/s", depth=4) == 4
    back = readers.read_volume(spark, f"file://{tmp_path}/s/0")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, v.filter("id < 70000").collect()))
    for big in (None, True):
        readers.write_stack(v, stack.shape, f"file://{tmp_path}/{big}.tif", big=big)
        assert (codecs.read_tiff((tmp_path / f"{big}.tif").read_bytes()) == stack).all()


def test_predictions_of_another_size(spark):
    v = spark.createDataFrame([(0, 0, 1, 1, 5)], D.VOXEL)
    assert readers.load_prediction(spark, v, (1, 2, 2), (1, 2, 2)) is v
    assert sorted((r["y"], r["x"]) for r in readers.load_prediction(spark, v, (1, 2, 2), (1, 4, 4)).collect()) == [(2, 2), (2, 3), (3, 2), (3, 3)]
    with pytest.raises(ValueError, match="3 slices"):
        readers.load_prediction(spark, v, (3, 2, 2), (1, 2, 2))


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from lamina import session

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_folder(Cluster)


def test_postprocessing_order(spark):
    y, x = np.mgrid[:24, :24]
    rows = [(0, z, int(a), int(b), 1 if z < 4 else 2) for z in range(8) for a, b in np.argwhere((y - 12) ** 2 + (x - 12) ** 2 <= 36)]
    out = workflow.postprocess(spark.createDataFrame(rows, D.VOXEL), (24, 24), target=24, min_area=3)
    assert {r["id"] for r in out["final"].collect()} == {1} and out["downsampled"].count() == len(rows)


def test_harmonize_as_a_stream(spark, tmp_path):
    s = np.zeros((8, 10, 10), int)
    s[:, 2:8, 2:8] = 4
    s[3] = 0
    s[5][s[5] > 0] = 9
    rows = [(0, int(z), int(a), int(b), int(s[z, a, b])) for z, a, b in np.argwhere(s)]
    runs = D.to_runs(spark.createDataFrame(rows, D.VOXEL)).coalesce(1)
    whole = {tuple(r[c] for c in ("z", "y", "x0", "x1", "id")) for r in harmonize_ids(runs).collect()}
    for k, (low, high) in enumerate(((0, 3), (4, 5), (6, 7))):
        runs.filter(f"z between {low} and {high}").write.mode("append").parquet(f"{tmp_path}/in")
        if not k:
            stream = harmonize_stream(spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 10).parquet(f"{tmp_path}/in"), (10, 10), 8)
            query = stream.writeStream.format("memory").queryName("fixed").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
        query.processAllAvailable()
    query.stop()
    assert {tuple(r[c] for c in ("z", "y", "x0", "x1", "id")) for r in spark.table("fixed").collect()} == whole


def test_catalogue(spark):
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_splits_and_scores_without_hot_tasks(spark, monkeypatch):
    from lamina.operators import link

    rows = [(i % 7, i % 5, 1, i, i + 1, int(i % 9 == 0)) for i in range(5000)]
    edges = spark.createDataFrame(rows, "volume long, z int, dz int, c_src int, c_tgt int, label_same int")
    train, held = link.stratified_split(edges, 0.2)
    by = {r["label_same"]: r["count"] for r in held.groupBy("label_same").count().collect()}
    assert by == {0: -(-sum(r[5] == 0 for r in rows) // 5), 1: -(-sum(r[5] for r in rows) // 5)} and train.count() + held.count() == 5000
    rng = np.random.default_rng(4)
    scored = [(int(y), float(np.round(rng.random() * 0.5 + 0.4 * y, 2))) for y in rng.integers(0, 2, 400)]
    got = link.ranking_scores(spark.createDataFrame(scored, "label_same int, p_link double")).first()
    pos, neg = [p for y, p in scored if y], [p for y, p in scored if not y]
    assert got["roc_auc"] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg))
    steps, last, ap = sorted({p for _, p in scored}, reverse=True), 0.0, 0.0
    for t in steps:
        tp, n = sum(p >= t for p in pos), sum(p >= t for _, p in scored)
        ap += (tp / len(pos) - last) * tp / n
        last = tp / len(pos)
    assert got["average_precision"] == pytest.approx(ap)


@pytest.fixture(scope="module")
def few_parts(spark, tmp_path_factory):
    """A folder like that of a scale factor, with some 30 parts of one volume."""
    path = tmp_path_factory.mktemp("few")
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").filter("p_partkey % 7 in (0, 3)").limit(36).coalesce(1).write.parquet(f"file://{path}/part.parquet")
    return str(path)


def pred_stack(spark, sf_dir):
    from lamina.plans import fixture

    out = {}
    for r in fixture.pred(spark, sf_dir).collect():
        out.setdefault(r["volume"], np.zeros(fixture.SHAPE, np.int64))[r["z"], r["y"], r["x"]] = r["id"]
    return out


def digest(stacks):
    out = {}
    for v, s in stacks.items():
        for z, y, x in np.argwhere(s).tolist():
            n = out.setdefault((v, int(s[z, y, x])), [0, 0, 0, 0])
            for k, c in enumerate((1, z, y, x)):
                n[k] += c
    return {k: tuple(n) for k, n in out.items()}


def test_order_dependent_queries_against_sets_of_pixels(spark, few_parts):
    sf = few_parts
    stacks = pred_stack(spark, sf)
    rows = lambda name: {(r["volume"], r["id"]): (r["n"], r["sz"], r["sy"], r["sx"]) for r in catalogue.queries()[name](spark, sf).collect()}
    assert rows("absorb_small_pieces") == digest({v: np.stack([pixels.absorb(z, 12) for z in s]) for v, s in stacks.items()})
    assert rows("harmonize_ids") == digest({v: pixels.harmonize(s[: int(np.flatnonzero(s.any((1, 2)))[-1]) + 1], 0.6)[0] for v, s in stacks.items()})
    done = {v: pixels.repaired(s[:, :, : int(np.flatnonzero(s.any((0, 1)))[-1]) + 1], catalogue._REPAIR) for v, s in stacks.items()}
    assert rows("repair_side_view") == digest({v: s for v, (s, _) in done.items()})
    log = sorted((r["volume"], r["slice_index"], r["prev_id"], r["candidate_ids"], r["mode"]) for r in catalogue.queries()["repair_log"](spark, sf).collect())
    assert log == sorted((v, *entry) for v, (_, entries) in done.items() for entry in entries)


def test_clean_slices_against_sets_of_pixels(spark, few_parts):
    sf = few_parts
    stacks = pred_stack(spark, sf)
    got = {(r["volume"], r["id"]): (r["n"], r["sz"], r["sy"], r["sx"]) for r in catalogue.queries()["clean_slices"](spark, sf).collect()}
    assert got == digest({v: np.stack([pixels.entangled(pixels.filled(z, 5), 2, 0.45) if z.any() else z for z in s]) for v, s in stacks.items()})


def test_inverse_alignment_undoes_the_shifts(spark):
    """The query moves slice z by (z % 3, z % 2); aligning must bring back the mass and say so."""
    from lamina.plans import fixture

    sf = "/root/testdata/sf0.001"
    want = {r["z"]: r["n"] for r in fixture.gt(spark, sf).groupBy((F.col("volume") * fixture.SHAPE[0] + F.col("z")).alias("z")).agg(F.count("*").alias("n")).collect()}
    got = {r["z"]: r for r in catalogue.queries()["inverse_alignment"](spark, sf).collect()}
    assert set(got) == set(want)
    for z, n in want.items():
        assert got[z]["dy"] == pytest.approx(-(z % 3), abs=0.35) and got[z]["dx"] == pytest.approx(-(z % 2), abs=0.35) and got[z]["mass"] == pytest.approx(n, rel=0.02)


def plain_shapes(image):
    from lamina.functions import kernels as K

    for i, owned in sorted(pixels.by_id(image).items()):
        top = max(pixels.split(owned), key=len)
        yield i, len(top), *pixels.box(top), *pixels.centre(top), len(top) / K.hull_area(pixels.mask(top)), K.eccentricity(pixels.mask(top))


def test_region_shapes_against_sets_of_pixels(spark, few_parts):
    from lamina.plans import fixture

    sf, want = few_parts, {}
    image = {}
    for r in fixture.gt(spark, sf).collect():
        image.setdefault((r["volume"], r["z"]), np.zeros(fixture.SHAPE[1:], np.int64))[r["y"], r["x"]] = r["id"]
    for key, s in image.items():
        for i, *rest in plain_shapes(s):
            want[(*key, i)] = rest
    got = {(r["volume"], r["z"], r["id"]): [r[c] for c in ("area", "y0", "x0", "y1", "x1", "cy", "cx", "solidity", "eccentricity")] for r in catalogue.queries()["region_shapes"](spark, sf).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("name", ["object_sizes", "pair_iou", "edges_dz1", "semantic_scores", "panoptic_scores", "missing_boxes", "duplicate_boxes", "gap_fill", "threshold_sweep", "matches_at_75", "panoptic_table", "evaluation_summary", "refine_touching", "fill_objects"])
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW part AS SELECT * FROM '/root/testdata/sf0.001/part.parquet'")
    got = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
    found = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in found.description]
    near = lambda v: round(v, 5) if isinstance(v, float) else v
    ordered = lambda rows: sorted(rows, key=repr)
    assert ordered(tuple(near(r[c]) for c in names) for r in got.collect()) == ordered(tuple(map(near, r)) for r in found.fetchall())
