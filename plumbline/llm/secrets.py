"""Secrets and multipart credentials; DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.native import let

#: Base kinds as listed, then what linking adds.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "weak_access", "weak_secret", "endpoint")
#: Parts of a credential lie within so many code points of one another.
SCOPE = 256

#: Kind: (pattern, what a hit must match to be kept, part of a credential). No pattern repeats a group, which Java's
#: matcher does by recursion: a repeated class of characters needs no stack, however long the text.
#: Hex and access runs of the least length are the maximal runs of at least that length, so the length is in the pattern.
_KEYS = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
_RULES = {
    "assign": (_KEYS + r"[A-Za-z0-9+/_.=-]+", _KEYS + r"[A-Za-z0-9+/_.=-]{12,}$", "secret"),
    "access": (r"AKIA[A-Z0-9]{14,}+", None, "id"),
    "hex": (r"[0-9a-f]{16,}+", None, None),
    "weak_access": (r"(?<![A-Z0-9])(?:AKIA[A-Z0-9]{8,13}|ASIA[A-Z0-9]{12,28})(?![A-Z0-9])", None, "id"),
    "weak_secret": (r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/]{40}={0,2}(?![A-Za-z0-9+/=_-]|\.\S)", None, "secret"),
    # a name with a dot inside, up to the last letter, digit or hyphen of the run, and its port
    "endpoint": (r"https?://[A-Za-z0-9-][A-Za-z0-9.-]*(?<!\.)(?::[0-9]+)?", r"https?://[A-Za-z0-9-]+\.", "endpoint"),
}
_HIT = "array<struct<kind:string,i:int,gap:int,len:int,ok:boolean>>"


def _hits(text: Column, kind: str) -> Column:
    """The matches of a kind in order, as the gap before each and its length; positions are sums of these."""
    pattern, keep, _ = _RULES[kind]
    every = let(
        F.split(text, pattern, -1),
        lambda parts: F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(parts, i)).alias("gap"), F.length(m).alias("len"), (m.rlike(f"^{keep}") if keep else F.lit(True)).alias("ok")),
        ),
    )
    return F.when(text.rlike(pattern), every).otherwise(F.array()).cast(_HIT)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, text_hash, spans) for every row of docs; spans is array<struct<start,end,order,kind>> in order.

    assign, access and hex are found wherever they match. Weak candidates (a short or temporary access
    identifier, a bare 40-character token, an endpoint) are interval-joined with the other parts of
    the row's text and reported only where complementary parts start within `scope` code points: an
    identifier with a secret, a secret with an identifier, an endpoint with both. Weak candidates that
    start within a base span are part of it.

    The join is by bins of `scope` code points: for a bin, its neighbours' first and last start of each
    part decide, so a text with many candidates costs no more than in proportion. Offsets are running
    sums, exact for texts of any length. Texts are read once and are in no shuffle.

    Null and empty texts have no spans. Rows are told apart by id and text hash: repeated rows are
    looked at once and each gets the result; null ids are ids like others; spans of one start are in the order of
    their kinds; an empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), text.alias("text"))
    row = F.array(F.struct(F.lit("").alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit(0).alias("len"), F.lit(True).alias("ok"))).cast(_HIT)
    key = ["doc_id", "text_hash"]
    rows = rows.select(*key, F.explode(F.concat(row, *[_hits(F.col("text"), k) for k in KINDS])).alias("x")).select(*key, "x.*")
    rows = rows.groupBy(*key, "kind", "i").agg(F.first("gap").alias("gap"), F.first("len").alias("len"), F.first("ok").alias("ok"), F.count("*").alias("copies"))

    line = Window.partitionBy(*key, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(line)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("len")).where("ok")
    rows = rows.withColumn("order", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int"))
    base = F.col("kind").isin(*BASE)
    so_far = Window.partitionBy(*key).orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.coalesce(F.max(F.when(base, F.col("end"))).over(so_far) > F.col("start"), F.lit(False)))
    rows = rows.where((F.col("kind") == "") | base | ~F.col("inside"))

    starts = lambda part: F.when(F.col("kind").isin(*[k for k, r in _RULES.items() if r[2] == part]), F.col("start"))
    rows = rows.withColumn("bin", F.floor(F.col("start") / scope))
    rows = rows.groupBy(*key, "bin").agg(
        F.max(F.when(F.col("kind") == "", F.col("copies"))).alias("copies"),
        F.collect_list(F.when(F.col("kind") != "", F.struct("start", "end", "order", "kind"))).alias("spans"),
        *[f(starts(part)).alias(f"{name}_{part}") for part in ("id", "secret") for name, f in (("first", F.min), ("last", F.max))],
    )
    by_bin = Window.partitionBy(*key).orderBy("bin")
    beside = lambda c, step: F.when(F.lag("bin", step).over(by_bin) == F.col("bin") - step, F.lag(c, step).over(by_bin))
    rows = rows.withColumns({f"{side}_{part}": beside(f"{end}_{part}", step) for part in ("id", "secret") for side, end, step in (("before", "last", 1), ("after", "first", -1))})
    near = lambda s, part: reduce(
        Column.__or__,
        [F.col(f"first_{part}").isNotNull(), F.coalesce(s["start"] - F.col(f"before_{part}") <= scope, F.lit(False)), F.coalesce(F.col(f"after_{part}") - s["start"] <= scope, F.lit(False))],
    )
    linked = lambda s: (
        s["kind"].isin(*BASE) | ((s["kind"] == "weak_access") & near(s, "secret")) | ((s["kind"] == "weak_secret") & near(s, "id")) | ((s["kind"] == "endpoint") & near(s, "secret") & near(s, "id"))
    )
    rows = rows.select(*key, "copies", F.filter("spans", linked).alias("spans"))
    rows = rows.groupBy(*key).agg(F.max("copies").alias("copies"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return rows.select(*key, "spans", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
