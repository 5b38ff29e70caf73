import json
import math
import random
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import paths, values
from plumbline.operators import contracts, joins, kernels, metrics, runs, scoring, sequence, split
from plumbline.sources import files, sinks


def one(spark, column, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(column.alias("x")).first().x


def test_paths(spark):
    p = F.lit("data/thai_01/source_a/image.jpg")
    assert one(spark, paths.label_at(p, 1)) == "source_a" and one(spark, paths.label_at(p, 2)) == "thai_01" and one(spark, paths.label_at(F.lit("x.jpg"), 1)) is None
    assert one(spark, paths.source_id(F.lit("0/1__erode_k3_it1__aug_shift5.png"))) == "0/1"
    assert one(spark, paths.extensions(F.lit("PNG, .jpg,,png"))) == [".jpg", ".png"]
    assert one(spark, paths.drive_file_id(F.lit("https://d.example/file/d/abc_1/view"))) == "abc_1" and one(spark, paths.drive_file_id(F.lit("https://d.example/x"))) is None
    assert one(spark, paths.writer_id(F.lit("x/P-017.png"))) == "017" and one(spark, paths.writer_id(F.lit("x/w1.png"))) == "w1"
    assert one(spark, paths.member_code(F.lit("a-229-0F-3.png"))) == "229"
    assert one(spark, paths.escapes(F.lit("a/../b"))) and one(spark, paths.escapes(F.lit("/a"))) and not one(spark, paths.escapes(F.lit("a/b..c")))
    labels = spark.createDataFrame([(f"{i}_x",) for i in range(72)], "label string")
    assert [r.label for r in labels.orderBy(paths.numeric_prefix(F.col("label"))).collect()] == [f"{i}_x" for i in range(72)]


def test_characters_and_numbers(spark):
    assert [one(spark, values.thai_code(F.lit(c))) for c in ("ก", "ๅ", "๙", "7", "ab", "é", "\u0e3c")] == [161, 229, 249, 55, None, None, None]
    assert [one(spark, values.label_code(F.lit(c))) for c in ("0_ก", "55_ๅ", "161", "7", "3_ab", "ก", "1_2")] == [161, 229, 161, 7, None, None, 50]
    assert one(spark, values.marked(F.lit("ิ"))) == "◌ิ" and one(spark, values.marked(F.lit("ก"))) == "ก"
    p = one(spark, values.softmax(F.array(F.lit(1000.0), F.lit(1001.0))))
    assert math.isclose(sum(p), 1) and p[1] > p[0]
    assert one(spark, values.expand_box(F.lit(5), F.lit(5), F.lit(5), F.lit(9), F.lit(20), F.lit(20), 0.1)) is None
    with pytest.raises(ValueError):
        values.expand_box(*[F.lit(1)] * 6, 1.5)
    assert len(one(spark, values.corners(F.lit("0,0 8,0 8,9 0,9")))) == 4 and one(spark, values.corners(F.lit("0,0 1"))) is None
    assert one(spark, values.bin_of(F.lit(1.0))) == 3 and one(spark, values.conv_size(F.lit(32), 3, 2, 1)) == 16
    assert one(spark, values.html_escape(F.lit("<a&'\">"))) == "&lt;a&amp;&#x27;&quot;&gt;"


def test_top_k_with_two_classes(spark):
    s = spark.createDataFrame([("p", "a", 2.0), ("p", "b", 1.0)], "path string, predicted_label string, logit double")
    probs = scoring.probabilities(s, "path")
    r = scoring.flatten_top_k(scoring.top_k(probs, "path", 1), "path").first()
    assert r.prediction == "a" and r.margin is None and r.top2_label is None
    assert scoring.with_status(scoring.flatten_top_k(scoring.top_k(probs, "path", 9), "path"), r.confidence).first().status == "OK"
    with pytest.raises(ValueError):
        scoring.top_k(probs, "path", 0)


def test_suffix_scoring(spark):
    truth = spark.createDataFrame([("images/0_a/w1.png", "0_a", "w1"), ("images/1_b/w1.png", "1_b", "w1")], "path string, label string, writer_id string")
    pred = spark.createDataFrame([("/tmp/x/images/0_a/w1.png", "0_a", 0.9), ("/tmp/x/images/1_b/w1.png", "0_a", 0.6)], "path string, prediction string, confidence double")
    got = joins.score_predictions(truth, pred).select(F.col("label").alias("true_label"), F.col("prediction").alias("predicted_label"), "writer_id").cache()
    assert metrics.accuracy(got).first().accuracy == 0.5 and metrics.macro_recall_present(got).first().macro_recall == 0.5 and metrics.recall_by(got, "writer_id").first().recall == 0.5
    with pytest.raises(ValueError):
        joins.score_predictions(truth, pred.withColumn("path", F.lit("/tmp/x/other.png")))


def test_macro_variants_differ_on_an_absent_label(spark):
    pred = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "true_label string, predicted_label string")
    labels = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "label string, idx int")
    m = metrics.macro(pred, labels).first()
    assert math.isclose(m.macro_recall, 0.5) and m.minimum_per_class_recall == 0
    assert math.isclose(metrics.macro_recall_present(pred).first().macro_recall, 0.75)
    w = {r.label: r.weight for r in metrics.class_weights(spark.createDataFrame([("a",)] * 4 + [("b",)], "label string"), labels).collect()}
    assert math.isclose(w["b"] / w["a"], 2) and math.isclose(w["c"] / w["a"], 3) and math.isclose(sum(w.values()) / 3, 1)


def test_one_to_one(spark):
    a = spark.createDataFrame([("001", 1), ("002", 2)], "path string, x int")
    assert joins.one_to_one(a, a.withColumnRenamed("x", "y").orderBy(F.desc("path")), "path").count() == 2
    for bad in ([("001", 1), ("001", 2)], [("001", 1), ("003", 2)]):
        with pytest.raises(ValueError):
            joins.one_to_one(a, spark.createDataFrame(bad, "path string, y int"), "path")


def test_runs(spark):
    r = spark.createDataFrame([("x", "base", 42, 0, 0.90, 0.9, "complete"), ("y", "aug", 42, 1, 0.95, 0.9, "complete"), ("z", "aug", 43, 2, 0.99, 0.9, "failed")], "run_id string, candidate string, seed int, run_seq int, val_macro_f1 double, val_accuracy double, status string")
    r = r.withColumns({"parameter_count": F.lit(7), "training_seconds": F.lit(1.0)})
    assert [x.run_id for x in runs.rank(r).collect()] == ["z", "y", "x"]
    board = runs.leaderboard(r).collect()
    assert board[0].candidate == "aug" and board[1].std_macro_f1 is None
    assert runs.winner(r, [42, 43]).first().run_id == "y"
    h = spark.createDataFrame([("r", e, f, 0.5) for e, f in enumerate([0.1, 0.3, 0.3, 0.2, 0.2, 0.4], 1)], "run_id string, epoch int, val_macro_f1 double, val_accuracy double")
    assert runs.best_epochs(h).first().best_epoch == 6
    p = {x.epoch: (x.stale, x.stop_epoch) for x in runs.patience(h, 3).collect()}
    assert p[2] == (0, 5) and p[5] == (3, 5) and p[6] == (0, 5)
    assert [round(x.lr, 6) for x in runs.plateau(h, 1.0).orderBy("epoch").collect()] == [1, 1, 1, 1, 0.2, 0.2]
    trials = spark.createDataFrame([("COMPLETE",), ("PRUNED",), ("FAIL",)], "state string")
    assert runs.remaining_trials(trials, 5) == 3
    a, b = (spark.createDataFrame([("lr", "1"), ("augment", v)], "key string, value string") for v in ("no", "yes"))
    contracts.pair_protocol(a, b, "augment")
    with pytest.raises(ValueError):
        contracts.pair_protocol(a, a, "augment")
    best, tried = scoring.ablate({"augment": 0, "weights": 0}, {"augment": [1], "weights": [1]}, lambda c: c["augment"] - c["weights"])
    assert best == {"augment": 1, "weights": 0} and len(tried) == 3


@pytest.mark.parametrize("team", [6, 7])
def test_jobs_cover_everything_once(spark, team):
    assert sequence.job_coverage(sequence.jobs(spark, team, 7)).first().ok
    rows = sequence.allocated(spark.range(41).repartition(5), team, "id").collect()
    assert all(r.job == r.id + 1 and r.round == r.id // team + 1 and r.member == r.id % team + 1 for r in rows)
    with pytest.raises(ValueError):
        sequence.jobs(spark, 5, 7)


def test_reading_order(spark):
    b = spark.createDataFrame([(1, 0, 50.0, 0.0, 60.0, 10.0), (1, 1, 0.0, 2.0, 10.0, 12.0), (1, 2, 0.0, 40.0, 9.0, 50.0)], "page int, box_id int, x1 double, y1 double, x2 double, y2 double")
    assert [r.box_id for r in sequence.reading_order(b).orderBy("position").collect()] == [1, 0, 2]


def test_reading_order_against_plain_loops(spark):
    """Of many pages and a large one, of null pages and centres, in batches smaller than a page; no page is held as a group."""
    r = random.Random(3)
    boxes = [(p, i, float(r.randint(0, 60)), y := float(r.randint(0, 300)), 0.0, y + r.randint(0, 30)) for p in [None, *range(40)] for i in range(700 if p == 7 else r.randint(1, 30))]
    boxes[0:0] = [(8, 1000, 5.0, None, 9.0, 3.0), (8, 1001, 4.0, None, 9.0, 3.0)]
    want = {}
    for page in {b[0] for b in boxes}:
        rows = sorted((b[3] is None, ((b[3] or 0.0) + b[5]) / 2, b[2], b[1], max(1.0, b[5] - b[3]) if b[3] is not None else 1.0) for b in boxes if b[0] == page)
        near, lines = sum(x[4] for x in rows) / len(rows) * 0.6, []
        for lost, cy, x1, i, _ in rows:
            line = None if lost else next((n for n in lines if not n[0] and abs(cy - n[1] / n[2]) <= near), None)
            if line is None:
                lines.append(line := [lost, 0.0, 0, []])
            line[1:3] = line[1] + cy, line[2] + 1
            line[3].append((x1, cy, i))
        place = [(k, i) for k, line in enumerate(lines) for *_, i in sorted(line[3])]
        want |= {(page, i): (k, n) for n, (k, i) in enumerate(place)}
    df = spark.createDataFrame(boxes, "page int, box_id int, x1 double, y1 double, x2 double, y2 double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sequence.reading_order(df)
        assert {(x.page, x.box_id): (x.line, x.position) for x in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_kernels():
    assert np.allclose(kernels.homography([(0, 0), (640, 0), (640, 480), (0, 480)], 320, 240), [2, 0, 0, 0, 2, 0, 0, 0])
    with pytest.raises(ValueError):
        kernels.homography([(0, 0), (1, 1), (2, 2), (3, 3)], 10, 10)
    x = np.full((40, 60, 3), 255.0)
    x[10:20, 25:40] = 0
    assert kernels.ink_box(x.mean(2)) == (25, 10, 40, 20)
    assert kernels.resize_pad(x, 30).shape == (30, 30, 3) and np.allclose(kernels.denormalise(kernels.normalise(x, [0.5] * 3, [0.2] * 3), [0.5] * 3, [0.2] * 3), x)
    assert np.array_equal(kernels.random_affine(x, "a"), kernels.random_affine(x, "a"))
    assert np.allclose(kernels.hsv(np.array([[255, 0, 0], [0, 255, 0], [10, 10, 10]])), [[0, 1, 1], [120, 1, 1], [0, 0, 10 / 255]])


def test_ink_leaves_stray_pixels_out():
    grey = np.full((60, 60), 255.0)
    grey[10:20, 10:20] = 0
    grey[40, 35] = grey[50, 35] = 0
    assert kernels.ink_box(grey) == (10, 10, 20, 20)
    assert kernels.trim(np.repeat(grey[:, :, None], 3, 2)).shape == (14, 14, 3)
    wide = np.full((100, 300, 3), 255.0)
    wide[40:60, 100:200] = 0
    assert kernels.trim(wide).shape == (26, 130, 3)
    wide[70:80, 10:20] = (255, 255, 0)  # yellow is light
    assert kernels.trim(wide).shape == (26, 130, 3)
    with pytest.raises(ValueError):
        kernels.ink_box(np.full((9, 9), 255.0))


def test_views_and_cells():
    x = np.random.default_rng(1).uniform(0, 255, (12, 10, 3))
    views = kernels.tta(x)
    assert len(views) == 5 and np.array_equal(views[3][:, 1:], x[:, :-1]) and np.array_equal(views[4][:, :-1], x[:, 1:]) and (views[3][:, 0] == 255).all() and (views[4][:, -1] == 255).all()
    assert np.allclose(kernels.affine(x, 0, 0, 0, 1), x) and np.allclose(kernels.affine(x, 90, 0, 0, 1)[1:-1, 2:-2].shape, (10, 6, 3))
    half = kernels.affine(x, 0, 0.5, 0, 1)
    assert np.allclose(half[:, 1:], (x[:, 1:] + x[:, :-1]) / 2)
    boxes = kernels.grid_boxes(2400, 2700, 9)
    assert len(boxes) == 72 and boxes[0] == (21, 69, 279, 279) and boxes[9] == (321, 369, 579, 579)
    same = kernels.warp(x, kernels.homography([(0, 0), (10, 0), (10, 12), (0, 12)], 10, 12), 10, 12)
    assert np.allclose(same, x)
    ramp = np.repeat(np.arange(20.0)[None, :, None], 8, 0)
    double = kernels.warp(ramp, kernels.homography([(0, 0), (20, 0), (20, 8), (0, 8)], 40, 16), 40, 16)
    assert np.allclose(double[8, 8:32, 0], np.arange(8, 32) / 2 - 0.25)


def test_images_and_errors(spark, tmp_path):
    root = tmp_path / "data"
    files.sample_tree(str(root), 2, 3, 8)
    (root / "0" / "broken.png").write_bytes(b"no image")
    (root / "loose.png").write_bytes(files.png(4, 4, (1, 2, 3)))
    (root / ".hidden").mkdir()
    (root / ".hidden" / "x.png").write_bytes(files.png(4, 4, (1, 2, 3)))
    got = {r.path: r for r in files.images(spark, str(root)).collect()}
    assert len(got) == 8 and got["0/broken.png"].error == "corrupt" and got["loose.png"].error == "no label folder" and got["1/2.png"].width == 8 and got["1/2.png"].channels == 3
    (root / "0" / "new.webp").write_bytes(b"RIFF\x10\0\0\0WEBPVP8 1234567")
    assert {r.path: r.error for r in files.images(spark, str(root)).collect()}["0/new.webp"] == "unsupported"
    (root / "0" / "new.webp").unlink()
    img = spark.read.format("image").option("recursiveFileLookup", "true").load(str(root / "0"))
    t = kernels.tensors(img, 16, [0.5] * 3, [0.5] * 3).select(F.size("tensor").alias("n"), "error").collect()
    assert sorted((r.n or -1, r.error is None) for r in t)[-1] == (768, True) and sum(r.error is not None for r in t) == 1
    assert [r.path.rsplit("/", 1)[1] for r in files.discover(spark, str(root / "1")).collect()] == ["0.png", "1.png", "2.png"]


def test_archives_manifests_and_settings(spark, tmp_path, monkeypatch):
    z = tmp_path / "in" / "a.zip"
    z.parent.mkdir()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("wrap/x-229-0F-1.png", b"1")
    assert [(r.member, r.code) for r in files.archive_members(spark, str(z.parent)).collect()] == [("wrap/x-229-0F-1.png", "229")]
    assert files.image_root(str(z.parent), str(tmp_path / "w")).endswith("wrap")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as f:
        f.writestr("../x", b"1")
    with pytest.raises(ValueError):
        files.unpack(str(tmp_path / "bad.zip"), str(tmp_path / "bad"))
    (tmp_path / "full" / "a").mkdir(parents=True)
    (tmp_path / "full" / "b").mkdir()
    for x in "ab":
        (tmp_path / "full" / x / "1.PNG").write_bytes(files.png(2, 2, (1, 2, 3)))
    (tmp_path / "full" / "more.ZIP").write_bytes(z.read_bytes())
    assert files.image_root(str(tmp_path / "full"), str(tmp_path / "w2")) == str(tmp_path / "full")
    with zipfile.ZipFile(tmp_path / "gone.ZIP", "w") as f:
        f.writestr("gone/x/1.png", b"1")
        f.writestr("gone/y/1.png", b"1")
    assert files.image_root(str(tmp_path / "gone"), str(tmp_path / "w3")).endswith("w3/gone/gone")
    with pytest.raises(ValueError):
        files.image_root(str(tmp_path / "nothing"), str(tmp_path / "w4"))
    with pytest.raises(ValueError):
        files.discover(spark, str(tmp_path / "nothing"))
    assert [r.path for r in files.discover(spark, str(tmp_path / "bad.zip")).collect()] == [str(tmp_path / "bad.zip")]
    (tmp_path / "m.csv").write_text("path,label,sha256,source_id,more\na/1.png,001,,a/1,x\n")
    r = files.csv_manifest(spark, str(tmp_path / "m.csv")).first()
    assert r.label == "001" and r.sha256 == ""
    (tmp_path / "short.csv").write_text("path\na\n")
    with pytest.raises(ValueError, match="label"):
        files.csv_manifest(spark, str(tmp_path / "short.csv"))
    assert files.seen_hashes(spark, None).count() == 0
    (tmp_path / ".env").write_text("# c\nDATA_DIR='/x y'\n")
    assert files.setting("DATA_DIR", env_file=str(tmp_path / ".env")) == "/x y"
    monkeypatch.setenv("DATA_DIR", "/env")
    assert files.setting("DATA_DIR", env_file=str(tmp_path / ".env")) == "/env"
    (tmp_path / "l.json").write_text(json.dumps({"a": 0, "b": 2}))
    with pytest.raises(ValueError):
        files.label_map(str(tmp_path / "l.json"))
    with pytest.raises(ValueError):
        files.json_document(str(tmp_path / "none.json"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("001", "<b>"), ("002", None)], "label string, name string")
    sinks.write_csv(df, str(tmp_path / "t.csv"), "label", single=True)
    assert pd.concat(pd.read_csv(p, dtype=str) for p in (tmp_path / "t.csv").glob("*.csv")).label.tolist() == ["001", "002"]
    sinks.html_report("r", {"s": df}, str(tmp_path / "r.html"))
    assert "&lt;b&gt;" in (tmp_path / "r.html").read_text()
    sinks.write_json({"a": "ก"}, str(tmp_path / "a.json"))
    digest = sinks.freeze_copy(str(tmp_path / "a.json"), str(tmp_path / "f" / "a.json"))
    assert digest == sinks.freeze_copy(str(tmp_path / "a.json"), str(tmp_path / "f" / "a.json"))
    sinks.write_json({"a": 1}, str(tmp_path / "a.json"))
    with pytest.raises(ValueError):
        sinks.freeze_copy(str(tmp_path / "a.json"), str(tmp_path / "f" / "a.json"))
    assert [(r.sheet_row, r.sheet_col) for r in sinks.contact_sheet(spark.range(12), "id").collect()][-1] == (1, 1)
    assert sinks.experiment_notes(df, str(tmp_path / "n"), "label") and not sinks.experiment_notes(df, str(tmp_path / "n"), "label")
    cache = runs.Cache(str(tmp_path / "cache"))
    made = []
    for _ in range(2):
        assert cache.get(spark, {"k": 1}, lambda: made.append(1) or df).count() == 2
    assert made == [1]


def test_stream_keeps_first_of_content(spark, tmp_path):
    from plumbline.streaming import manifests

    df = spark.createDataFrame([("a", "h1"), ("b", "h1"), ("c", "h2")], "path string, sha256 string")
    df.write.parquet(str(tmp_path / "in"))
    s = manifests.first_of_content(manifests.manifest_stream(spark, str(tmp_path / "in"), df.schema))
    manifests.write_stream(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.sha256 for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["h1", "h2"]


def test_prediction_contract(spark):
    truth = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, label string")
    rows = lambda *x: spark.createDataFrame(list(x), "path string, true_label string, predicted_label string, confidence double")
    good = contracts.checked_predictions(truth, rows(("a", "1", "1", 0.5), ("b", "2", "1", 1.0))).orderBy("path").collect()
    assert [r.correct for r in good] == [True, False]
    for word, bad in (
        ("duplicates", rows(("a", "1", "1", 0.5), ("a", "1", "1", 0.5), ("b", "2", "1", 1.0))),
        ("coverage", rows(("a", "1", "1", 0.5))),
        ("truth", rows(("a", "2", "1", 0.5), ("b", "2", "1", 1.0))),
        ("confidence", rows(("a", "1", "1", 0.5), ("b", "2", "1", 1.5))),
        ("confidence", rows(("a", "1", "1", None), ("b", "2", "1", float("nan")))),
    ):
        with pytest.raises(ValueError, match=word):
            contracts.checked_predictions(truth, bad)


def test_config_and_frozen_folder(spark, tmp_path):
    known = {"size", "mean"}
    assert contracts.resolved_config({"mean": [1, 2]}, {"mean": (1, 2)}, known) == {"mean": [1, 2]}
    for word, a, b in (("size", {"size": 1}, {"size": 2}), ("usable", None, None), ("unknown", {"other": 1}, None)):
        with pytest.raises(ValueError, match=word):
            contracts.resolved_config(a, b, known)
    assert contracts.resolved_labels(None, {"a": "0", "b": 1}) == {"a": 0, "b": 1}
    for a, b in (({"a": 0}, {"a": 1}), ({"a": 1}, None), ({}, None), ({"a": "x"}, None)):
        with pytest.raises(ValueError):
            contracts.resolved_labels(a, b)
    scored = spark.createDataFrame([([1.0, 2.0],)], "logits array<double>")
    contracts.output_dimension(scored, 2)
    with pytest.raises(ValueError, match="3 labels"):
        contracts.output_dimension(scored, 3)
    assert not split.frozen_at(spark, str(tmp_path))
    for name in split.FROZEN:
        (tmp_path / name).write_text("{}")
    assert split.frozen_at(spark, str(tmp_path))
    (tmp_path / "val.csv").unlink()
    with pytest.raises(ValueError, match="val.csv"):
        split.frozen_at(spark, str(tmp_path))
