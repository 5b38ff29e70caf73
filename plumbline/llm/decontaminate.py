"""Benchmark decontamination by winnowing; DataFrame functions only."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.native import let, longs, small_side
from plumbline.runtime import cut

#: Everything that is not in a word: ASCII other than digits and letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a benchmark window, and words of a hashed gram; any WINDOW shared words share a fingerprint.
WINDOW, GRAM = 10, 5
#: 64-bit words of a filter of the benchmark's hashes that plans carry at most (two megabytes), and bits set for a hash.
FILTER_WORDS, FILTER_BITS = 1 << 18, 3


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lowered; an empty array for null."""
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), GAPS), "")


def grams(hashes: Column, n: int) -> Column:
    """The hash of each n consecutive elements of a bound array."""
    each = F.transform(hashes, lambda x, i: F.xxhash64(F.lit(n), x, *[F.get(hashes, i + j) for j in range(1, n)]))
    return F.slice(each, F.lit(1), F.greatest(F.size(hashes) - (n - 1), F.lit(0)))


def winnowed(hashes: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """Fingerprints of a bound array of word hashes: the least gram hash of each `window` words, once each."""
    width = window - gram + 1
    least = lambda g: F.transform(g, lambda x, i: F.least(x, *[F.get(g, i + j) for j in range(1, width)]) if width > 1 else x)
    return F.array_distinct(let(grams(hashes, gram), lambda g: F.slice(least(g), F.lit(1), F.greatest(F.size(g) - (width - 1), F.lit(0)))))


def _filter(hashes: DataFrame, most: int = FILTER_WORDS):
    """A test of a long column or variable that passes every value of hashes.h, and few others while hashes are few.

    A Bloom filter of four words a hash while they fit, of a size bounded by FILTER_WORDS: of other values a million hashes
    pass one in 200, four million one in seven. Beyond that the exact joins after it have more to do, with the same result.
    """
    n = hashes.count()
    size = 1
    while size < most and size < n * 4:
        size *= 2
    # 20 bits of the hash on for each bit set, of which 18 + 6 choose a word and a bit in it
    word = lambda x, k: F.shiftrightunsigned(x, 20 * k + 6).bitwiseAND(F.lit(size - 1)).cast("int")
    bit = lambda x, k: F.shiftrightunsigned(x, 20 * k).bitwiseAND(F.lit(63)).cast("int")
    places = F.explode(F.array(*[F.struct(word(F.col("h"), k).alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("h"), k)).alias("b")) for k in range(FILTER_BITS)]))
    table = dict(map(tuple, hashes.select(places.alias("x")).groupBy("x.i").agg(F.bit_or("x.b")).collect()))
    bits = longs([table.get(i, 0) for i in range(size)])
    one = lambda x, k: F.call_function("shiftrightunsigned", F.get(bits, word(x, k)), bit(x, k)).bitwiseAND(F.lit(1)) == 1
    return lambda x: reduce(Column.__and__, [one(x, k) for k in range(FILTER_BITS)])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, items) for every row of docs.

    Windows are WINDOW consecutive words of an item, or a shorter item whole. n_hit counts the words
    inside an occurrence of a window; items lists, sorted, the ids (as strings) of items with one.

    Documents and items are winnowed: two texts that share WINDOW words share a fingerprint. Documents
    are read once; a filter of the fingerprints drops most of them. What is left is joined with the items'
    fingerprints by position, and each hit is extended to the windows around it, compared word by word.
    Items shorter than a window have no fingerprint but their own hash, which is looked for at every position.

    Null and wordless texts have no words and no hits. Repeated rows each get their result. Items with
    a null id count as hits but are not listed; repeated items are listed once; an empty benchmark gives
    no hits. Rows are told apart by id and text hash, so null and repeated ids do no harm; other
    columns are not read. Of a very long text nothing is held but its words, their hashes and the hits.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text_col)).alias("w")).where(F.size("w") > 0)
    items = cut(items.withColumn("hs", F.transform("w", lambda x: F.xxhash64(x))))
    short = sorted(r[0] for r in items.where(F.size("w") < WINDOW).select(F.size("w")).distinct().collect())
    own = [grams(F.col("hs"), n) for n in short]
    item_prints = F.explode(reduce(lambda a, i: F.when(F.size("w") == short[i], own[i]).otherwise(a), range(len(short)), let(F.col("hs"), lambda h: winnowed(h))))
    item_prints = cut(items.select(F.least(F.size("w"), F.lit(WINDOW)).alias("n"), item_prints.alias("h")).distinct())
    passes = _filter(item_prints)

    def prints(hashes: Column) -> Column:
        """What is looked up of a document: fingerprints, and grams of each short item's length."""
        return let(hashes, lambda h: F.concat(winnowed(h), *[grams(h, n) for n in short]))

    def placed(hashes: Column) -> Column:
        """Grams that pass the filter as (n, h, at): n words of a window, at the gram's first word."""
        at = lambda h, n, gram: F.filter(F.transform(grams(h, gram), lambda x, i: F.struct(F.lit(n).alias("n"), x.alias("h"), (i + 1).alias("at"))), lambda s: passes(s["h"]))
        return let(hashes, lambda h: F.concat(at(h, WINDOW, GRAM), *[at(h, n, n) for n in short]))

    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"), words_of(F.col(text_col)).alias("w"))
    likely = F.size(F.filter(prints(hashed("w")), passes)) > 0
    rows = cut(rows.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), F.when(likely, F.col("text")).alias("text")))

    key = ["doc_id", "text_hash"]
    found = rows.where("text is not null").dropDuplicates(key).select(*key, words_of(F.col("text")).alias("w"))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))
    met = found.select(*key, F.explode(placed(hashed("w"))).alias("x")).select(*key, "x.*").join(small_side(item_prints), ["n", "h"], "left_semi")
    met = met.groupBy(*key).agg(F.collect_list(F.struct("at", "n")).alias("met"))

    def around(x: Column) -> Column:
        """The windows that hold the gram of a hit, as start x 16 + length: those from up to WINDOW - GRAM words before; a short item's own."""
        first, last = F.greatest(F.lit(1), x["at"] - (WINDOW - GRAM)), F.least(x["at"], F.size("w") - (WINDOW - 1))
        starts = F.when(x["n"] < WINDOW, F.array(x["at"])).when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: at.cast("long") * 16 + x["n"])

    found = found.alias("f").join(met.alias("m"), same("f", "m")).select(F.col("f.doc_id").alias("doc_id"), F.col("f.text_hash").alias("text_hash"), "w", "met")
    extended = F.array_distinct(F.flatten(F.transform("met", around)))  # of numbers, as structs are not told apart by hash
    at, n = (lambda x: F.shiftright(x, 4).cast("int")), (lambda x: x.bitwiseAND(F.lit(15)).cast("int"))
    window = F.transform(extended, lambda x: F.struct(at(x).alias("at"), n(x).alias("n"), F.array_join(F.slice("w", at(x), n(x)), " ").alias("window")))
    found = found.select(*key, F.explode(window).alias("x")).select(*key, "x.*")

    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (WINDOW - 1)))
    windows = cut(items.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.lit(WINDOW)), " "))).alias("window")).distinct())
    hits = found.join(small_side(windows), "window").groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("hits"), F.array_sort(F.collect_set("item")).alias("items"))
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    more = lambda acc, x: F.struct(F.greatest(acc["end"], x["at"] + x["n"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["at"] + x["n"] - F.greatest(acc["end"], x["at"]))).alias("n"))
    hits = hits.select(*key, F.aggregate("hits", none, more, lambda acc: acc["n"]).alias("n_hit"), "items")
    out = rows.select(*key, "n_words").alias("r").join(hits.alias("h"), same("r", "h"), "left")
    return out.select("r.doc_id", "r.text_hash", "r.n_words", F.coalesce("h.n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("h.items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a word inside an occurrence of a benchmark window (see contamination()).

    Rows with null or empty texts stay, repeated rows stay or go together, whatever columns docs has come
    out as they were; an empty table, or an empty benchmark, changes nothing.
    """
    hit = contamination(docs, benchmark, id_col, text_col).where("n_hit > 0").select(F.col("doc_id").alias("__pl_id"), F.col("text_hash").alias("__pl_hash")).distinct()
    hit = small_side(cut(hit))
    return docs.join(hit, docs[id_col].eqNullSafe(hit["__pl_id"]) & (F.xxhash64(docs[text_col]) == hit["__pl_hash"]), "left_anti")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, m, i AS pos, array_to_string(w[i : i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)
), hit AS (
  SELECT doc_id, item_id, pos, dw.m FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + m)) AS p FROM (SELECT DISTINCT doc_id, pos, m FROM hit)) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(item) AS n_items, sha256(coalesce(string_agg(item, ',' ORDER BY item), '')) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
