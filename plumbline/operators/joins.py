"""Joins with contracts, suffix joins, overlaps, lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import paths, values
from plumbline.runtime import cut


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The join on a key that must be unique and have the same values on both sides."""
    for side, df in (("left", left), ("right", right)):
        twice = df.groupBy(key).count().where("count > 1").first()
        if twice:
            raise ValueError(f"the {side} side repeats {key} {twice[0]!r}")
    for side, a, b in (("right", left, right), ("left", right, left)):
        lone = a.join(b.select(key), key, "left_anti").first()
        if lone:
            raise ValueError(f"the {side} side lacks {key} {lone[key]!r}")
    return left.join(right, key)


def suffix_join(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """truth joined with the predictions whose path equals theirs or ends with / and theirs.

    Each prediction path is taken apart into its suffixes, so that the join is an equi-join; the suffixes
    are few for each row.
    """
    p = predictions.withColumnRenamed("path", "prediction_path")
    p = p.withColumn("path", F.explode(paths.suffixes(F.col("prediction_path"))))
    return truth.join(p, "path")


def score_predictions(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """truth with prediction, confidence and correct. Every truth row must have exactly one prediction, and every path be there once."""
    for name, df in (("truth", truth), ("prediction", predictions)):
        if df.groupBy("path").count().where("count > 1").first():
            raise ValueError(f"{name} paths repeat")
    if truth.count() != predictions.count():
        raise ValueError("truth and predictions differ in number")
    joined = suffix_join(truth, predictions)
    matches = truth.select("path").join(joined.groupBy("path").agg(F.count("*").alias("n")), "path", "left").where("coalesce(n, 0) <> 1").first()
    if matches:
        raise ValueError(f"{matches['path']} has {matches['n'] or 0} predictions")
    return joined.withColumn("correct", F.col("prediction") == F.col("label"))


def overlaps(rows: DataFrame, excluded: DataFrame, *columns: str, key: str = "path") -> DataFrame:
    """Keys of rows any of whose hash columns is in excluded.sha256: one equi-join for each, rather than an OR."""
    out = None
    seen = excluded.select("sha256").where("sha256 is not null").distinct()
    for c in columns:
        one = rows.join(seen, rows[c] == seen["sha256"], "left_semi").select(key)
        out = one if out is None else out.union(one)
    return out.distinct()


def absent(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a whose key b lacks."""
    return a.join(b.select(key), key, "left_anti").select(*a.columns)


def lookup(df: DataFrame, names: DataFrame, key: str, value: str, default: Column | None = None) -> DataFrame:
    """df with names' value for its key, `default` (else null) where there is none. names must have one row a key."""
    out = df.join(names.select(key, value), key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(value, default))


def enrich(df: DataFrame, attributes: DataFrame, key: str) -> DataFrame:
    """df with the first row of attributes by key; columns that df has already are left out."""
    own = [c for c in attributes.columns if c == key or c not in df.columns]
    return df.join(attributes.select(*own).dropDuplicates([key]), key, "left")


def hash_mismatches(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, sha256, actual) where the content is not what the manifest says."""
    return manifest.where("nullif(sha256, '') is not null").select("path", "sha256").join(files.select("path", F.col("sha256").alias("actual")), "path").where("actual <> sha256")


def prioritised(*sources: DataFrame) -> DataFrame:
    """The union of the sources with `priority`, 0 for the first; see runs.first_n() to take rows by it."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("priority", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def override(base: DataFrame, own: DataFrame, key: str, value: str, domain: DataFrame | None = None) -> DataFrame:
    """(key, value): own's value where it has one, else base's; with a domain, a value outside it is an error."""
    b, o = base.select(key, F.col(value).alias("__b")), own.select(key, F.col(value).alias("__o"))
    out = b.join(o, key, "full_outer").select(key, F.coalesce("__o", "__b").alias(value))
    if domain is not None and (bad := out.join(domain.select(value), value, "left_anti").first()):
        raise ValueError(f"{value} {bad[value]!r} is unknown")
    return out


def decisions(members: DataFrame, selected: DataFrame, rules: list[tuple[str, list[str], str]], default: str = "LATER") -> DataFrame:
    """(family, decision, reason) by priority: RUN with its hypothesis if selected, else the first rule (decision, families, reason) that lists it, else default."""
    j = members.join(selected.select("family", "hypothesis"), "family", "left")
    decision, reason = F.lit(default), F.lit("represented")
    for what, names, why in reversed(rules):
        hit = F.col("family").isin(*names)
        decision, reason = F.when(hit, what).otherwise(decision), F.when(hit, why).otherwise(reason)
    run = F.col("hypothesis").isNotNull()
    return j.select("family", F.when(run, "RUN").otherwise(decision).alias("decision"), F.when(run, F.col("hypothesis")).otherwise(reason).alias("reason"))


def ordered_distinct(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, order): each value once, with the first place it is met at, in that order."""
    return df.groupBy(value).agg(F.min(order).alias(order)).orderBy(order)


def _pieces(text: Column) -> Column:
    """What stands between two blanks of a text: of a text that stands in another, all of these stand there one after another."""
    words = F.split(text, " ", -1)
    return F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))


def _grams(words: Column, k: int) -> Column:
    """The hash of every k words that follow one another."""
    places = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - k + 1)).otherwise(F.array().cast("array<int>"))
    return values.let(words, lambda w: F.transform(places, lambda i: F.xxhash64(F.lit(k), F.array_join(F.slice(w, i, k), " "))))


def _winnowed(hashes: Column, window: int) -> Column:
    """The least hash of every `window` that follow one another, each once: whatever so many are common, one of these is."""
    if window == 1:
        return F.array_distinct(hashes)
    places = F.when(F.size(hashes) >= window, F.sequence(F.lit(1), F.size(hashes) - window + 1)).otherwise(F.array().cast("array<int>"))
    return values.let(hashes, lambda h: F.array_distinct(F.transform(places, lambda i: F.array_min(F.slice(h, i, window)))))


def _characters(text: Column, k: int) -> Column:
    """The hash of every k characters that follow one another, each once a stretch. A text is taken in stretches, as finding a
    place in one takes time by its length."""
    stretches = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{STRETCH + k - 1}}})).{{1,{STRETCH}}}"), F.lit(1))
    places = lambda s: F.when(F.length(s) >= k, F.sequence(F.lit(1), F.length(s) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(stretches, lambda s: F.array_distinct(F.transform(places(s), lambda i: F.xxhash64(F.lit(-k), F.substring(s, i, F.lit(k))))))))


#: How texts are looked for, by how many words they surely share with a text that holds them: (least number, words hashed
#: together, window of hashes of which the least counts). Texts with none are looked for by characters, by the largest number they have.
BY_WORDS = ((15, 8, 8), (4, 4, 1), (1, 1, 1))
BY_CHARACTERS = (32, 8, 2, 1)
STRETCH = 256


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_col, id_col) of the items whose whole text stands in a document, each pair once for each row of both.

    Both sides are joined on hashes of a few words, of which an item gives the one that the fewest items have and a document
    those that winnowing keeps, and what meets is looked at as a whole. Equal texts are one on each side until
    then, and no text is on the driver. Empty and null texts are contained in nothing.
    """
    text = lambda df, c: df.select(F.col(c).alias("__id"), F.col(text_col).alias("t")).where("t <> ''").withColumns({"h1": F.xxhash64("t"), "h2": F.xxhash64(F.lit(1), "t")})
    wanted, held = cut(text(items, item_col)), text(docs, id_col)
    level = reduce(lambda rest, i: F.when(F.size("pieces") >= BY_WORDS[i][0], i).otherwise(rest), reversed(range(len(BY_WORDS))), reduce(lambda rest, i: F.when(F.length("t") >= BY_CHARACTERS[i], len(BY_WORDS) + i).otherwise(rest), reversed(range(len(BY_CHARACTERS))), F.lit(None).cast("int")))
    distinct = wanted.dropDuplicates(["h1", "h2"]).withColumn("pieces", _pieces(F.col("t"))).withColumn("level", level)
    distinct = cut(distinct.select("h1", "h2", "t", "pieces", "level"))
    pairs = None
    for i in [r[0] for r in distinct.select("level").distinct().collect()]:  # seven at most
        some = distinct.where(F.col("level") == i)
        if i < len(BY_WORDS):
            _, k, window = BY_WORDS[i]
            mine = _winnowed(_grams(F.col("pieces"), k), window)
            theirs = _winnowed(_grams(F.split("t", " ", -1), k), window)
        else:
            k = BY_CHARACTERS[i - len(BY_WORDS)]
            mine = _characters(F.col("t"), k)
            theirs = _characters(F.col("t"), k)
        keys = cut(some.select("h1", "h2", F.explode(mine).alias("key")))
        common = keys.groupBy("key").agg(F.count("*").alias("n"))
        keys = keys.join(common, "key").groupBy("h1", "h2").agg(F.min(F.struct("n", "key"))["key"].alias("key"))
        found = held.select(F.col("h1").alias("d1"), F.col("h2").alias("d2"), F.explode(theirs).alias("key")).join(keys, "key").select("h1", "h2", "d1", "d2")
        pairs = found if pairs is None else pairs.union(found)
    if pairs is None:
        return items.select(item_col).limit(0).crossJoin(docs.select(id_col).limit(0))
    pairs = cut(pairs.distinct())
    meet = held.select(F.col("__id").alias(id_col), F.col("t").alias("__text"), F.col("h1").alias("d1"), F.col("h2").alias("d2")).join(pairs, ["d1", "d2"])
    meet = meet.join(distinct.select("h1", "h2", "t"), ["h1", "h2"]).where(F.contains("__text", "t")).select("h1", "h2", id_col)
    return meet.join(wanted.select("h1", "h2", F.col("__id").alias(item_col)), ["h1", "h2"]).select(item_col, id_col)
