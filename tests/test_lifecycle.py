import json
import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from plumbline import runtime
from plumbline.operators import audit, protocol, runs, search, sequence, split
from plumbline.sources import sinks
from plumbline.streaming.statuses import StatusTable


def test_one_of_two_runs_gets_the_lock(spark, tmp_path):
    path = f"{tmp_path}/locks of/pair"
    with protocol.Lock(spark, path, "first") as lock:
        assert lock.holder() == "first"
        with pytest.raises(protocol.Locked, match="first"):
            protocol.Lock(spark, path, "second").acquire()
        protocol.Lock(spark, path, "second").release()  # not one's own
        assert lock.holder() == "first"
    second = protocol.Lock(spark, path, "second")
    second.acquire()
    assert second.holder() == "second"
    second.release()
    assert second.holder() is None


def test_many_threads_want_the_lock(spark, tmp_path):
    held, lost = [], []

    def want(i):
        try:
            protocol.Lock(spark, f"{tmp_path}/lock", str(i)).acquire()
            held.append(i)
        except protocol.Locked:
            lost.append(i)

    threads = [threading.Thread(target=want, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(held) + len(lost) == 6 and len(held) >= 1


def test_first_illegal_step(spark):
    log = [("ok", 1, "planned"), ("ok", 2, "first_running"), ("ok", 3, "first_done"), ("late", 5, "first_running"), ("late", 6, "planned"), ("skip", 2, "first_done"), ("skip", 1, "planned"), ("null", 1, "planned"), ("null", 2, None), ("null", 3, "planned")]
    got = protocol.first_illegal(spark.createDataFrame(log, "run_id string, seq int, state string"), protocol.transitions(spark, protocol.PAIR))
    assert sorted(map(tuple, got.collect())) == [("late", 5, None, "first_running"), ("null", 2, "planned", None), ("skip", 2, "planned", "first_done")]


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    r = random.Random(3)
    rows = [(f"r{r.randrange(20)}", i, r.choice(["a", "b"]), r.random()) for i in range(400)]
    batches = [rows[i::8] for i in range(8)]
    frame = lambda x: spark.createDataFrame(x, "run_id string, seq int, status string, score double")
    t = StatusTable(spark, f"{tmp_path}/statuses")
    for i, b in enumerate(batches):
        t.upsert(frame(b), i)
        if i in (2, 5):
            t.upsert(frame(batches[i]), i)
        if i == 4:
            t.compact(3)
            t.upsert(frame(batches[1]), 1)  # held by the base
    want = {}
    for row in sorted(rows, key=lambda x: x[1]):
        want[row[0]] = row
    assert sorted(map(tuple, t.read().collect())) == sorted(want.values())
    with pytest.raises(ValueError, match="no batch"):
        StatusTable(spark, f"{tmp_path}/nothing").read()


def test_a_batch_that_broke_off_is_not_read(spark, tmp_path):
    t = StatusTable(spark, f"{tmp_path}/s")
    frame = spark.createDataFrame([("r", 1, "a")], "run_id string, seq int, status string")
    t.upsert(frame, 0)
    frame.withColumn("seq", F.lit(9)).write.parquet(f"{tmp_path}/s/batch=1")
    (tmp_path / "s" / "batch=1" / "_SUCCESS").unlink()
    assert t.read().first().seq == 1


def counted(df):
    return df.groupBy("k").agg(F.count("*").alias("n"))


def test_cache_follows_inputs_settings_and_code(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "i int, k string")
    c = runs.Cache(f"{tmp_path}/cache")
    for _ in range(2):
        assert {r.k: r.n for r in c.get(spark, 1, counted, df.repartition(3)).collect()} == {"a": 2, "b": 1}
    assert c.computed == 1 and list(c.rows.values()) == [2]
    c.get(spark, 2, counted, df)
    c.get(spark, 1, counted, df.where("i < 3"))
    c.get(spark, 1, lambda d: d.groupBy("k").agg(F.max("i").alias("n")), df)
    assert c.computed == 4
    assert c.drop_but(spark, c.path(1, counted, df)) == 3
    c.get(spark, 1, counted, df)
    assert c.computed == 4


def test_audit_reads_its_scan_once(spark, tmp_path):
    opened = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            opened.add(len(b))
            yield b

    rows = [("a/1", "a", 3, "h1"), ("a/2", "a", 3, "h1"), ("b/1", "b", 4, "h2"), ("b/2", "b", -1, None), ("x", None, 5, "h3"), ("b/3", "b", None, None)]
    scan = spark.createDataFrame(rows, "path string, label string, width int, sha256 string").repartition(2)
    report = sinks.audit_to(scan.mapInPandas(look, scan.schema), f"{tmp_path}/audit")
    assert opened.value == len(rows)
    want = audit.summary(scan).first().asDict()
    assert report == want and json.loads((tmp_path / "audit" / "audit_report.json").read_text()) == want
    assert {p.name for p in (tmp_path / "audit").iterdir() if not p.name.startswith(".")} == {"scan.parquet", "class_counts.csv", "exact_duplicate_groups.csv", "corrupt_images.csv", "label_errors.csv", "audit_report.json"}


def test_frozen_split_names_what_changed(spark):
    base = spark.createDataFrame([(f"{i % 2}/{i}", str(i % 2), f"h{i}", f"s{i}", "train" if i % 3 else "validation") for i in range(30)], "path string, label string, sha256 string, source_id string, split string")
    keys = ("label_hash", "train_hash", "validation_hash")
    frozen = split.identity(base)
    changes = {None: base.repartition(7), "label_hash": base.withColumn("label", F.concat("label", F.lit("x"))), "train_hash": base.where("path <> '1/1'"), "validation_hash": base.withColumn("sha256", F.when(F.col("path") == "0/0", "other").otherwise(F.col("sha256")))}
    for what, df in changes.items():
        assert split.first_change(frozen, split.identity(df), *keys).first().first_change == what


def test_numbers_over_many_ranges(spark):
    df = spark.range(10_001).select((F.col("id") * 7919 % 10_001).alias("x"), F.lit("y").alias("y")).repartition(9)
    got = sequence.numbered(df, F.col("x").desc(), name="place").collect()
    assert len(got) == 10_001 and all(r.place == 10_000 - r.x for r in got)
    sheet = sinks.contact_sheet(df, "x", across=10)
    assert sheet.count() == 10_001 and sheet.where("x <> sheet_row * 10 + sheet_col").count() == 0


def test_suggestions_against_plain_loops(spark):
    r = random.Random(5)
    rows = [(s, i, r.gauss(s, 2.0), (r.random() - abs(i % 7 - 3)) if i % 9 else None) for s in (1, 2) for i in range(60)] + [(3, 1, 5.0, 1.0), (4, 1, 5.0, 1.0), (4, 2, 5.0, 0.5), (5, 1, float("nan"), 1.0)]
    scored = search.suggestions(spark.createDataFrame(rows, "s int, t int, x double, y double"), "s", "t", "x", "y", candidates=12).collect()
    assert {x.study for x in scored} == {1, 2}
    for s in (1, 2):
        mine = [(x, y) for a, _, x, y in rows if a == s and y is not None]
        cut = sorted(y for _, y in mine)[math.ceil(0.75 * len(mine)) - 1]
        low, high = min(x for x, _ in mine), max(x for x, _ in mine)

        def density(at, side, low=low, high=high):
            mean = sum(side) / len(side)
            sd = math.sqrt(sum((x - mean) ** 2 for x in side) / (len(side) - 1))
            h = max(1.06 * sd * len(side) ** -0.2, (high - low) / 100)
            return (sum(math.exp(-(((at - x) / h) ** 2) / 2) / (h * math.sqrt(2 * math.pi)) for x in side) + 1 / (high - low)) / (len(side) + 1)

        good, bad = [x for x, y in mine if y >= cut], [x for x, y in mine if y < cut]
        for c in (c for c in scored if c.study == s):
            assert low <= c.x <= high and abs(c.score - math.log(density(c.x, good) / density(c.x, bad))) < 1e-9
        best = search.next_trials(spark.createDataFrame(scored)).where(F.col("study") == s).first()
        assert best.score == max(c.score for c in scored if c.study == s)


def test_small_documents_on_any_storage(spark, tmp_path):
    path = f"file://{tmp_path}/new folder/doc.json"
    for text in ("first", "sécond"):
        runtime.write_text(spark, path, text)
        assert runtime.read_text(spark, path) == text
    assert sinks.freeze_copy(path, f"{tmp_path}/frozen") == sinks.freeze_copy(path, f"{tmp_path}/frozen")
    runtime.write_text(spark, path, "third")
    with pytest.raises(ValueError, match="frozen"):
        sinks.freeze_copy(path, f"{tmp_path}/frozen")
