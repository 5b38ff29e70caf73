import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from plumbline.llm import repair
from tests.conftest import SF

BLANKS = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def cheapest(rows):
    """rows: (initial, truncated, must go). Forward over all rows and states, keeping the least (cost, audit, repaired marks)."""
    steps = {"": "su", "s": "u", "u": "a", "a": "u"}

    def spread(best):
        for _ in range(2):
            for state, (cost, audit, marks) in list(best.items()):
                to = "a" if state == "u" else "u"
                new = (cost + 5, audit + "I", (*marks, (None, to)))
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        return best

    best = {"": (0, "", ())}
    for i, (role, truncated, gone) in enumerate(rows):
        new = {}
        for state, (cost, audit, marks) in spread(best).items():
            ways = [(cost + 2, audit + "D", state, marks)]
            if not gone:
                more = cost + 5 * truncated
                if role and role in steps[state]:
                    ways.append((more, audit + "K", role, (*marks, (i, None))))
                to = "a" if state == "u" else "u"
                ways.append((more + 1, audit + "R", to, (*marks, (i, to))))
            for c, a, s, m in ways:
                if s not in new or (c, a) < new[s][:2]:
                    new[s] = (c, a, m)
        best = new
    ends = spread(best)
    return min(ends[s] for s in ("", "a") if s in ends)


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, marks, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in mine:
            body = text.strip(BLANKS)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            marks.append((role[:1], fault == "truncated", fault in ("blank", "duplicate")))
        cost, audit, kept = cheapest(marks)
        name = {"u": "user", "a": "assistant"}
        lines = [f"{name[to]}:" if i is None else f"{name[to] if to else mine[i][2]}:{mine[i][3]}" for i, to in kept]
        turns = [r[1] for r in mine if r[1] is not None]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip([m[0] for m in marks], [m[0] for m in marks][1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def of(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


SCHEMA = "conv_id long, turn long, role string, text string, key string, place int, block string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "b") for r in rows], SCHEMA)


def test_query_against_plain_loops(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert of(repair.op13_repair(spark, SF)) == brute(rows)


def test_sql_against_plain_loops_and_query(spark):
    import duckdb

    r = random.Random(17)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No!", "cut off", "", " \n", None, "One. ", "é日本。"]
    rows = [(conv if conv else None, r.choice([*range(9), None]), r.choice(roles), r.choice(texts)) for conv in range(60) for _ in range(r.randint(1, 9))]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = brute(rows)
    got = {x[0]: x[1:] for x in con.sql(repair.OP13_SQL).fetchall()}
    assert got == want == of(repair.repair_audit(frame(spark, rows)))


def test_random_conversations_in_small_blocks(spark, monkeypatch):
    r = random.Random(7)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "s"], ["Yes.", "No!", "cut off", "", " \n", None, "One. ", "é日本。", "Yes."]
    rows = []
    for conv in range(150):
        rows += [(conv if conv else None, r.choice([*range(12), None]) if conv % 3 == 0 else t, r.choice(roles), r.choice(texts)) for t in range(r.randint(1, 14))]
    rows += [(1000, t, r.choice(roles[:4]), r.choice(["Yes.", f"text {t % 40}.", "open", ""])) for t in range(300)]
    want = brute(rows)
    assert of(repair.repair_audit(frame(spark, rows).repartition(5))) == want
    for block in (1, 4, 16):
        monkeypatch.setattr(repair, "BLOCK", block)
        assert of(repair.repair_audit(frame(spark, rows))) == want


def test_signatures_against_all_edits():
    symbols = "suax" + "SUAX" + "-"
    for n in (1, 2, 3):
        for s in product(symbols, repeat=n):
            marks = [(c.lower(), c.isupper(), c == "-") for c in s]
            edits, state = repair.edits("".join(s), repair.NONE, repair.END)
            cost, audit, _ = cheapest(marks)
            assert ("".join(edits) + repair.TAIL[state]).translate(repair.AUDIT) == audit
            assert repair.before("".join(s), repair.END)[repair.NONE] == cost


def test_repaired_rows_follow_the_pattern(spark):
    rows = repair.damage(spark.read.parquet(f"{SF}/conversations.parquet"))
    found = repair.Repair(rows)
    lines = {}
    for r in found.lines().collect():
        lines.setdefault(r.conv_id, []).append((r.place, r.part, r.role, r.text))
    hashes = {r.key: r.repaired_sha256 for r in found.hashes().collect()}
    assert lines
    for conv, mine in lines.items():
        mine.sort()
        assert re.fullmatch("s?(ua)+", "".join(role[0] for _, _, role, _ in mine))
        assert hashes[str(conv)] == hashlib.sha256("\n".join(f"{role}:{text}" for _, _, role, text in mine).encode()).hexdigest()


def test_equal_rows_and_empty_tables(spark):
    rows = [(1, 5, "user", "Same.")] * 3000 + [(2, None, None, None), (None, None, "user", "Hi."), (3, 0, "user", "x" * 3_000_000), (3, 1, "assistant", "y " * 500_000 + ".")]
    assert of(repair.repair_audit(frame(spark, rows).repartition(4))) == brute(rows)
    assert repair.repair_audit(frame(spark, [])).count() == 0


@pytest.mark.parametrize("conv", range(60))
def test_without_damage(conv):
    r = random.Random(conv)
    marks = [(r.choice("suax"), r.random() < 0.2, r.random() < 0.2) for _ in range(40)]
    signature = "".join("-" if gone else role.upper() if cut else role for role, cut, gone in marks)
    assert repair.before(signature, repair.END)[repair.NONE] == cheapest(marks)[0]
