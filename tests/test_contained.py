import random

import pytest

from plumbline.operators import joins


def brute(docs, items):
    return sorted((i, d) for i, t in items for d, text in docs if t and text and t in text)


def got(spark, docs, items):
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, joins.contained(*frames).collect()))


def test_short_texts_nulls_and_repeats(spark):
    docs = [(1, "one two three"), (2, "three"), (3, None), (4, ""), (5, "one two three"), (6, " "), (7, "a  b c")]
    items = [(1, "two"), (2, "three"), (3, "three"), (4, ""), (5, None), (6, "e t"), (7, "four"), (8, " "), (9, "  "), (10, "one two three"), (11, " two "), (12, "two three"), (13, "a  b")]
    assert got(spark, docs, items) == brute(docs, items)
    assert got(spark, docs, []) == [] and got(spark, [], items) == []


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abé ") for _ in range(r.randint(1, 4))) for _ in range(12)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 120)))) for i in range(60)]
    docs += [(100 + i, docs[3][1]) for i in range(20)]
    items = []
    for i in range(120):
        text = r.choice(docs)[1]
        at, n = r.randrange(len(text)), r.choice([1, 2, 7, 9, 30, 40, 90, 200])
        items.append((i, text[at : at + n] + ("" if r.random() < 0.7 else r.choice("xa "))))
    assert got(spark, docs, items) == brute(docs, items)


def test_long_words_and_texts(spark):
    docs = [(1, "x" * 300_000), (2, "ab" * 2000 + " " + "c" * 900), (3, "word " * 100_000)]
    items = [(1, "x" * 700), (2, "bab c"), (3, "b c"), (4, "c" * 900), (5, "c" * 901), (6, "word " * 30 + "w"), (7, "xy")]
    assert got(spark, docs, items) == brute(docs, items)


def test_nothing_is_collected_and_no_python_runs(spark, monkeypatch):
    docs = spark.range(1000).selectExpr("id AS doc_id", "concat('some words of text number ', id, ' and so on') AS text")
    items = spark.range(20).selectExpr("id AS item_id", "concat('of text number ', id, ' and') AS text")
    out = joins.contained(docs, items)
    assert "Python" not in out._jdf.queryExecution().toString()
    assert out.count() == 20
