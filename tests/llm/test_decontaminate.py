import random
import re

import pytest

from plumbline.llm import decontaminate, native
from tests.compare import rows
from tests.conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items):
    windows = {}
    for i, text in items:
        w = words(text)
        n = min(len(w), 10)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r.items)) for r in df.collect()), key=repr)


def test_query_matches_sql(spark, duck):
    assert rows(decontaminate.op7_decontaminate(spark, SF).toPandas()) == rows(duck.sql(decontaminate.OP7_SQL).df())


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, seed):
    r = random.Random(seed)
    vocabulary = ["a", "B", "É", "é", "c1", "日本", "d_e", "x'y"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "--"]) for _ in range(r.randint(0, n)))
    items = [(i, text(25)) for i in range(30)] + [(99, None), (98, ""), (3, "a b"), (97, "one word"), (96, "Zebra")]
    docs = [(i, text(60)) for i in range(80)] + [(500 + i, f"{text(9)} {items[i][1]} {text(9)}") for i in range(30)] + [(1, None), (2, "zebra crossing"), (2, "zebra crossing")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(decontaminate.contamination(a, b)) == brute(docs, items)


def test_a_shuffled_benchmark_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(native, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontaminate, "FILTER_WORDS", 1)
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert got(decontaminate.contamination(docs, items)) == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_odd_rows(spark, odd, none):
    items = [(1, "same text twice"), (2, "word " * 12), (None, "no id"), (4, None)]
    b = spark.createDataFrame(items, "item_id long, text string")
    found = got(decontaminate.contamination(odd, b))
    assert len(found) == odd.count() and sum(x[3] == ["1"] for x in found) == 3
    assert (None, 4, 2, []) in found  # an item without id hits, and is not listed
    assert decontaminate.contamination(none, b).count() == 0
    assert all(x[2] == 0 for x in got(decontaminate.contamination(odd, b.limit(0))))
    kept = decontaminate.drop_contaminated(odd, b)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 5


def test_items_without_id_in_query_and_sql(spark, duck, tmp_path):
    """They count as hits and are in no list, in both."""
    import duckdb

    docs = [(1, "one two three four"), (2, "five six seven"), (3, None), (4, "one two three, five six seven")]
    items = [(None, "two three"), (7, "six seven"), (None, "six")]
    con = duckdb.connect()
    for name, kind, data in (("documents", "doc_id long, text string", docs), ("benchmark", "item_id long, text string", items)):
        spark.createDataFrame(data, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = decontaminate.op7_decontaminate(spark, str(tmp_path))
    assert rows(found.toPandas()) == rows(con.sql(decontaminate.OP7_SQL).df())
    assert {r.doc_id: (r.n_hit, r.n_items) for r in found.collect()} == {1: (2, 0), 2: (2, 1), 3: (0, 0), 4: (4, 1)}
