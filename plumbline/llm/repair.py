"""Repair of conversations: each distinct sequence of roles and faults is solved once, and its edits are replayed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.runtime import Stored, cut

#: Rows of a conversation that make one signature; a longer conversation is a chain of signatures.
BLOCK = 1024
#: Results that a worker remembers of each recursive function.
REMEMBERED = 200_000

# A repaired conversation is (s?(ua)+)?, read by an automaton with these states: nothing yet, after the
# system row, after a user row, after an assistant row.
NONE, SYSTEM, USER, ASSISTANT = range(4)
KEEP = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAME = {USER: "user", ASSISTANT: "assistant"}
INSERT, REROLE, DELETE, TRUNCATED = 5, 1, 2, 5
#: Costs of ending in each state: an open turn needs an assistant row, a system row both.
END = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "ua", "a", "")
FAR = 1 << 40

# An edit of a row is written as the roles inserted before it (u, a) and its own fate: K kept, U or A given
# another role, D deleted. AUDIT turns these into the initials of the edits.
AUDIT = str.maketrans({"u": "I", "a": "I", "K": "K", "U": "R", "A": "R", "D": "D"})


@lru_cache(REMEMBERED)
def _steps(symbol: str, state: int) -> tuple[tuple[int, str, int], ...]:
    """(cost, edit, next state) of every useful way to treat a row in a state. symbol: the initial of its role, in
    upper case if the row is truncated, or - if it must go."""
    out, spent, before = [], 0, ""
    for _ in range(3):
        out.append((spent + DELETE, before + "D", state))
        if symbol != "-":
            more = spent + (TRUNCATED if symbol.isupper() else 0)
            if (state, symbol.lower()) in KEEP:
                out.append((more, before + "K", KEEP[state, symbol.lower()]))
            out.append((more + REROLE, before + "UA"[NEXT[state] == ASSISTANT], NEXT[state]))
        state, spent, before = NEXT[state], spent + INSERT, before + "ua"[NEXT[state] == ASSISTANT]
    return tuple(out)


@lru_cache(REMEMBERED)
def costs(signature: str) -> tuple[tuple[int, ...], ...]:
    """The least cost of getting through a signature from each state (row) to each state (column); a long signature is
    the product of its halves, which other signatures share."""
    if len(signature) == 1:
        out = [[FAR] * 4 for _ in range(4)]
        for a in range(4):
            for cost, _, b in _steps(signature, a):
                out[a][b] = min(out[a][b], cost)
        return tuple(map(tuple, out))
    half = len(signature) // 2
    left, right = costs(signature[:half]), costs(signature[half:])
    return tuple(tuple(min(min(row[k] + right[k][b] for k in range(4)), FAR) for b in range(4)) for row in left)


def before(signature: str, end: tuple[int, ...]) -> tuple[int, ...]:
    """The costs to the end of the conversation from each state before a signature, from those after it."""
    return tuple(min(min(c + e for c, e in zip(row, end, strict=True)), FAR) for row in costs(signature))


@lru_cache(REMEMBERED)
def edits(signature: str, start: int, end: tuple[int, ...]) -> tuple[tuple[str, ...], int]:
    """The edits of each row of a cheapest repair, of those the one whose audit is least in ASCII, and the state after it."""
    if len(signature) == 1:
        best = min(((cost + end[state], edit.translate(AUDIT), edit, state) for cost, edit, state in _steps(signature, start)))
        return (best[2],), best[3]
    half = len(signature) // 2
    left, middle = edits(signature[:half], start, _level(before(signature[half:], end)))
    right, state = edits(signature[half:], middle, end)
    return left + right, state


def _level(costs_: tuple[int, ...]) -> tuple[int, ...]:
    """Costs less their minimum: what matters for a choice, and the same for many conversations."""
    least = min(costs_)
    return tuple(min(c - least, FAR) for c in costs_)


def _costs(signature: pd.Series) -> pd.Series:
    return signature.map(lambda s: [list(row) for row in costs(s)])


def _solved(signature: pd.Series, end: pd.Series) -> pd.Series:
    """For each state before the signature its edits and the state after it."""
    return pd.Series([[dict(zip(("edits", "state"), edits(s, start, tuple(map(int, e))), strict=True)) for start in range(4)] for s, e in zip(signature, end, strict=True)])


def _ends(blocks: pd.Series) -> pd.Series:
    """For the blocks of a conversation, in order and with their costs, the costs to the end after each."""

    def of(chain) -> list[dict]:
        end, out = END, []
        for b in reversed(chain):
            out.append({"block": b["block"], "end": list(_level(end))})
            end = tuple(min(min(int(c) + e for c, e in zip(row, end, strict=True)), FAR) for row in b["costs"])
        return out

    return blocks.map(of)


def _starts(blocks: pd.Series) -> pd.Series:
    """For the blocks of a conversation, in order and with the state after each from each state before, the state before each."""

    def of(chain) -> list[dict]:
        state, out = NONE, []
        for b in chain:
            out.append({"block": b["block"], "start": state})
            state = int(b["states"][state])
        return out

    return blocks.map(of)


def initial(role: Column) -> Column:
    """s, u or a by the first letter of a role, x for any other."""
    return F.when(F.substring(role, 1, 1).isin("s", "u", "a"), F.substring(role, 1, 1)).otherwise("x")


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, key, turn, role, text): rows with a fault planted in one of four by the CRC-32 of `conv_id:turn`, nulls as one
    space. Of twenty remainders 0 drops the row, 1 empties its text, 2 takes its sentence ends away, 3 repeats it, 4 makes its role user."""
    blank = F.lit(" ")
    rows = rows.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), blank).alias("key"), "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    code = F.crc32(F.concat("key", F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    rows = rows.withColumn("code", code).where("code <> 0").withColumn("copy", F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "key", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def _ordered(rows: DataFrame) -> Stored:
    """rows stored with `place`, which rises by conversation, turn (nulls first), role and text and by one between neighbours of a partition.

    Ranges of the whole order are dealt out, so that a conversation with many rows is held by many tasks; rows
    that are equal are told apart by where they were read.
    """
    order = ["key", F.col("turn").asc_nulls_first(), "role", "text", "_read"]
    rows = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_read")
    return Stored(rows.withColumn("place", F.monotonically_increasing_id()))


def _signatures(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, block, first, signature, roles, n_blank, ...) for each block of a conversation, up to BLOCK rows that stand together; (key, gaps)."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    same = [F.xxhash64(F.lit(i), "role", "text").alias(f"h{i}") for i in (1, 2)]
    faults = cut(rows.select("key", "turn", "place", initial(F.col("role")).alias("role"), blank.alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"), *same))
    first = faults.where("not blank").groupBy("key", "h1", "h2").agg(F.min("place").alias("first"))
    faults = faults.join(first, ["key", "h1", "h2"], "left").withColumn("duplicate", ~F.col("blank") & (F.col("place") > F.col("first")))
    faults = cut(faults.withColumn("truncated", F.col("truncated") & ~F.col("blank") & ~F.col("duplicate")).drop("first", "h1", "h2"))
    symbol = F.when(F.col("blank") | F.col("duplicate"), "-").when(F.col("truncated"), F.upper("role")).otherwise(F.col("role"))
    blocks = faults.groupBy("key", _block().alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("place", symbol.alias("symbol"), "role"))).alias("rows"), *[F.sum(F.col(c).cast("long")).alias(f"n_{c}") for c in ("blank", "duplicate", "truncated")]
    )
    turns = faults.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    signature, roles = (F.array_join(F.col(f"rows.{c}"), "") for c in ("symbol", "role"))
    return cut(blocks.select("key", "block", F.col("rows")[0]["place"].alias("first"), signature.alias("signature"), roles.alias("roles"), "n_blank", "n_duplicate", "n_truncated")), turns


def _block() -> Column:
    """The block of a row: its partition and its BLOCK rows there; a place has the row in its lower 33 bits."""
    return F.floor(F.col("place") / F.lit(BLOCK)).cast("long")


def _planned(blocks: DataFrame) -> DataFrame:
    """blocks with `edits`, an entry for each row, and `tail`, the roles inserted at the end of the conversation."""
    many = cut(blocks.groupBy("key").agg(F.count("*").alias("n"), F.max("block").alias("last")))
    blocks = blocks.join(many, "key")
    long = blocks.where("n > 1")

    # Where a conversation has several blocks: the costs after each, from the last to the first.
    solved = long.select("signature").distinct().withColumn("costs", F.pandas_udf(_costs, "array<array<bigint>>")("signature"))
    chain = long.join(solved, "signature").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "costs"))).alias("blocks"))
    ends = chain.select("key", F.explode(F.pandas_udf(_ends, "array<struct<block:bigint,end:array<bigint>>>")("blocks")).alias("e")).select("key", "e.block", "e.end")
    whole = F.array(*[F.lit(c).cast("long") for c in END])
    blocks = cut(blocks.join(ends, ["key", "block"], "left").withColumn("end", F.coalesce("end", whole)))

    solved = cut(blocks.select("signature", "end").distinct().withColumn("solved", F.pandas_udf(_solved, "array<struct<edits:array<string>,state:int>>")("signature", "end")))
    states = blocks.where("n > 1").join(solved, ["signature", "end"]).select("key", "block", F.transform("solved", lambda s: s["state"]).alias("states"))
    chain = states.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "states"))).alias("blocks"))
    starts = chain.select("key", F.explode(F.pandas_udf(_starts, "array<struct<block:bigint,start:int>>")("blocks")).alias("e")).select("key", "e.block", "e.start")
    blocks = blocks.join(starts, ["key", "block"], "left").withColumn("start", F.coalesce("start", F.lit(NONE)))
    best = F.get("solved", F.col("start"))
    tail = F.get(F.array(*map(F.lit, TAIL)), best["state"])
    out = blocks.join(solved, ["signature", "end"]).withColumn("edits", best["edits"]).withColumn("tail", F.when(F.col("block") == F.col("last"), tail).otherwise(""))
    return cut(out.drop("solved", "end", "start", "n", "last"))


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, repaired_sha256) from rows in the order of their conversations, a batch at a time."""
    key, digest, empty = None, None, True
    for batch in batches:
        out = []
        for k, role, text, edit, tail in zip(batch["key"], batch["role"], batch["text"], batch["edit"], batch["tail"], strict=True):
            if k != key:
                if digest is not None:
                    out.append((key, digest.hexdigest()))
                key, digest, empty = k, hashlib.sha256(), True
            for e in edit + tail:
                if e != "D":
                    name = role if e == "K" else "user" if e in "uU" else "assistant"
                    digest.update(f"{'' if empty else chr(10)}{name}:{'' if e in 'ua' else text}".encode())
                    empty = False
        yield pd.DataFrame(out, columns=["key", "repaired_sha256"])
    if digest is not None:
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "repaired_sha256"])


class Repair:
    """The cheapest repair of the conversations of rows (conv_id, key, turn, role, text) into (system? (user assistant)+)?.

    audit: a row for each conversation that has rows. lines: the repaired rows. A conversation is read by turn (nulls first),
    then role and text. Signatures hold BLOCK rows; a longer conversation is a chain of them, whose costs and
    states are passed along in one row of a few numbers a block, so that no task holds its texts.
    """

    def __init__(self, rows: DataFrame):
        self._rows = _ordered(rows)
        blocks, self._turns = _signatures(self._rows.df)
        self._blocks = _planned(blocks)

    def _edited(self) -> DataFrame:
        """The rows with their own edit, and on the last row of a conversation the roles inserted after it."""
        plan = self._blocks.select("key", "block", "first", "edits", "tail")
        index = (F.col("place") - F.col("first")).cast("int")
        rows = self._rows.df.withColumn("block", _block()).join(plan, ["key", "block"])
        return rows.select("conv_id", "key", "place", "role", "text", F.get("edits", index).alias("edit"), F.when(index == F.size("edits") - 1, F.col("tail")).otherwise("").alias("tail"))

    def lines(self) -> DataFrame:
        """(conv_id, place, part, role, text) of the repaired conversations, in the order of place and part; inserted rows have an empty text."""
        parts = F.split(F.concat("edit", "tail"), "")
        each = self._edited().select("*", F.posexplode(parts).alias("part", "e")).where("e not in ('D', '')")
        role = F.when(F.col("e") == "K", F.col("role")).when(F.lower("e") == "u", "user").otherwise("assistant")
        return each.select("conv_id", "place", "part", role.alias("role"), F.when(F.col("e").isin("u", "a"), "").otherwise(F.col("text")).alias("text"))

    def hashes(self) -> DataFrame:
        """(key, repaired_sha256) of `role:text` lines. A hash is taken in order, so the rows of a conversation pass through one task, in batches."""
        rows = self._edited().repartition("key").sortWithinPartitions("key", "place")
        return rows.select("key", "role", "text", "edit", "tail").mapInPandas(_hashed, "key string, repaired_sha256 string")

    def audit(self) -> DataFrame:
        """(key, gaps, blank, duplicate, truncated, illegal, cost, audit)."""
        chain = Window.partitionBy("key").orderBy("block")
        roles = F.concat(F.coalesce(F.lag(F.substring("roles", -1, 1)).over(chain), F.lit("")), "roles")
        pairs = F.greatest(F.length("ends") - 1, F.lit(0)) - F.regexp_count("ends", F.lit("s(?=u)|u(?=a)|a(?=u)"))
        edit = F.concat(F.array_join("edits", ""), "tail")
        audit = F.translate(edit, "uaUA", "IIRR")
        cost = INSERT * F.regexp_count("audit", F.lit("I")) + REROLE * F.regexp_count("audit", F.lit("R")) + DELETE * F.regexp_count("audit", F.lit("D")) + TRUNCATED * F.col("kept")
        faulty = F.size(F.filter("edits", lambda e, i: ~e.endswith("D") & F.substring(F.col("signature"), i + 1, F.lit(1)).isin("S", "U", "A", "X")))
        blocks = self._blocks.withColumns({"ends": roles, "audit": audit, "kept": faulty})
        blocks = blocks.withColumns({"illegal": pairs, "cost": cost})
        sums = [F.sum(f"n_{c}").alias(c) for c in ("blank", "duplicate", "truncated")] + [F.sum(c).cast("long").alias(c) for c in ("illegal", "cost")]
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda b: b["audit"]), "").alias("audit")
        out = blocks.groupBy("key").agg(*sums, joined)
        return out.join(self._turns, "key").withColumn("gaps", F.coalesce("gaps", F.lit(0)).cast("long"))


def repair_audit(conversations: DataFrame, fault: bool = True) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each conv_id of conversations.

    fault: damage() is applied first. A row is blank, else a duplicate of an earlier one of its conversation (role and
    text), else truncated (no sentence end). Nulls in role and text are one space, null ids one conversation of
    their own, null turns come first; rows of one turn are read by role and text, so ties and repeated rows give
    the same result in any order of the table. A conversation without rows left has zeros, an empty audit and
    the hash of nothing. Texts of any length; other columns are not read; an empty table gives an empty result.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    ids = rows.select("conv_id").distinct().withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    if fault:
        rows = damage(rows)
    else:
        blank = F.lit(" ")
        rows = rows.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), blank).alias("key"), "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    found = Repair(rows)
    out = ids.join(found.audit(), "key", "left").join(found.hashes(), "key", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    )


def op13_repair(spark, sf_dir: str) -> DataFrame:
    return repair_audit(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP13_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)
), coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS code
  FROM conversations, tab
), damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM coded WHERE code <> 0)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS c FROM damaged
), f AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS twice, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) = 1 AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
    coalesce(lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM placed)
), ins AS (
  SELECT * FROM (VALUES (0, 0, 0, '', []), (0, 1, 2, 'I', ['user:']), (0, 2, 3, 'II', ['user:', 'assistant:']), (1, 0, 1, '', []), (1, 1, 2, 'I', ['user:']), (1, 2, 3, 'II', ['user:', 'assistant:']),
    (2, 0, 2, '', []), (2, 1, 3, 'I', ['assistant:']), (2, 2, 2, 'II', ['assistant:', 'user:']), (3, 0, 3, '', []), (3, 1, 2, 'I', ['user:']), (3, 2, 3, 'II', ['user:', 'assistant:'])) t(a, k, b, audit, lines)
), ed AS (
  SELECT b AS a, c, e, z FROM (VALUES (0), (1), (2), (3)) s(b), (VALUES ('s'), ('u'), ('a'), ('x')) r(c), LATERAL (SELECT 'D' AS e, b AS z UNION ALL SELECT 'R', CASE WHEN b = 2 THEN 3 ELSE 2 END
    UNION ALL SELECT 'K', CASE c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END WHERE (b, c) IN ((0, 's'), (0, 'u'), (1, 'u'), (2, 'a'), (3, 'u')))
), dp(conv_id, i, st, cost, audit, lines) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), '', CAST([] AS VARCHAR[]) FROM f
  UNION ALL
  SELECT conv_id, i, z, cost, audit, lines FROM (
    SELECT f.conv_id, f.i, ed.z, dp.cost + 5 * ins.k + CASE ed.e WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN f.cut AND ed.e <> 'D' THEN 5 ELSE 0 END AS cost, dp.audit || ins.audit || ed.e AS audit,
      list_concat(dp.lines, ins.lines, CASE ed.e WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE ed.z WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text] END) AS lines
    FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 JOIN ins ON ins.a = dp.st JOIN ed ON ed.a = ins.b AND ed.c = f.c AND (ed.e = 'D' OR NOT f.blank AND NOT f.twice)
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, z ORDER BY cost, audit) = 1
), ended AS (
  SELECT dp.conv_id, dp.cost + 5 * k AS cost, dp.audit || ins.audit AS audit, list_concat(dp.lines, ins.lines) AS lines
  FROM dp JOIN (SELECT conv_id, max(i) AS n FROM f GROUP BY 1) m ON m.conv_id IS NOT DISTINCT FROM dp.conv_id AND m.n = dp.i JOIN ins ON ins.a = dp.st AND ins.b IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY dp.conv_id ORDER BY dp.cost + 5 * k, dp.audit || ins.audit) = 1
), counts AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (twice) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY 1
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM o.conv_id
"""
