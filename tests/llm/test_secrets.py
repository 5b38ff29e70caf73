import hashlib
import random
import re

from plumbline.llm import secrets
from tests.conftest import SF

KEY = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
PATTERNS = (("assign", rf"""({KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12), ("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16))


def brute(text):
    out = []
    for order, (kind, pattern, least) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                out.append((m.start(), order, m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(out)]


def spans(r, kinds=None):
    return [(x.kind, x.start, x.end) for x in r.spans if kinds is None or x.kind in kinds]


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = secrets.op10_secrets(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        want = brute(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[0] == k for x in want) for k, _, _ in PATTERNS]


def test_random_texts(spark):
    r = random.Random(3)
    parts = ["AKIA", "A", "Z9", "token", "Secret", "=", ":", " ", '"', "abcdef012345", "f", "0", "password", "APIKEY", "api_key", "x" * 12, ".", "\n", "é", "🙂", "-", "https://a.b", "AKIA" + "Q" * 10, "z" * 20 + "Z" * 20]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 40)))) for i in range(2000)]
    got = {x.doc_id: x for x in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert spans(got[i], secrets.BASE) == brute(text), text


def test_weak_candidates_need_their_complement(spark):
    short, bare, host = "AKIA" + "Q" * 10, "aB3" * 13 + "x", "https://api.example.com"
    gap = " pad" * 200
    rows = [(1, f"{short} then {bare} at {host}"), (2, short), (3, bare), (4, host), (5, f"{short}{gap}{bare}"), (6, f"{host} {short}"), (7, f"{short} password = abcdefghijkl"), (8, f"{bare} AKIA{'Z' * 16} {host}"), (9, f"{'x' * 250} {short} {'y' * 180} {bare}")]
    got = {x.doc_id: [k for k, _, _ in spans(x)] for x in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["weak_access", "weak_secret", "endpoint"], 2: [], 3: [], 4: [], 5: [], 6: [], 7: ["weak_access", "assign"], 8: ["weak_secret", "access", "endpoint"], 9: ["weak_access", "weak_secret"]}


def test_weak_secrets_of_env_files_and_sentences(spark):
    key, bare, host = "AKIA" + "Z" * 16, "aB3" * 13 + "x", "https://api.example.com"
    rows = [(1, f"{key} aws_secret_access_key={bare}"), (2, f"AWS_ACCESS_KEY_ID={key}\nAWS_SECRET_ACCESS_KEY={bare}\nURL={host}"), (3, f"{key} with {bare}. And"), (4, f"{key} with {bare}."), (5, f"{key} with {bare}.x"), (6, f"aws_secret_access_key={bare}")]
    got = {x.doc_id: [k for k, _, _ in spans(x)] for x in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["access", "weak_secret"], 2: ["access", "weak_secret", "endpoint"], 3: ["access", "weak_secret"], 4: ["access", "weak_secret"], 5: ["access"], 6: []}


def test_odd_rows(spark, odd, none):
    got = secrets.find_secrets(odd).collect()
    assert len(got) == odd.count() and all(spans(r) == [] for r in got)
    assert secrets.find_secrets(none).count() == 0
    rows = [(None, "token=abcdefghijklmno"), (None, "token=abcdefghijklmno"), (1, "passwd: " + "k" * 5000), (1, "other"), (1, "other")]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, spans(r)) for r in got), key=repr) == sorted([(i, brute(t)) for i, t in rows], key=repr)


def test_long_runs_need_no_stack(spark):
    """A hundred thousand dotted labels, and megabytes of one class of characters."""
    labels, many = "https://a" + ".a" * 100_000, 2_000_000
    rows = [(1, f"AKIA{'Z' * 16} token={'x' * 20} {labels}"), (2, "f" * many), (3, "AKIA" + "Z" * many), (4, "password=" + "a." * many), (5, "https://" + "z" * many), (6, "secret" + " " * many + "="), (7, "https://" + "." * many)]
    got = {x.doc_id: spans(x) for x in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    for i, text in rows:
        assert [x for x in got[i] if x[0] in secrets.BASE] == brute(text)
    assert ("endpoint", 48, 48 + len(labels)) in got[1] and got[5] == got[7] == []


def test_endpoints(spark):
    other = f"AKIA{'Z' * 16} token={'x' * 20} "
    rows = [(1, "https://api.example.com."), (2, "https://localhost/x"), (3, "http://a.b:8080/c"), (4, "https://-a.b-"), (5, "https://a..b "), (6, "https://.a.b")]
    docs = spark.createDataFrame([(i, other + t) for i, t in rows], "doc_id long, text string")
    got = {x.doc_id: [(other + rows[x.doc_id - 1][1])[s:e] for _, s, e in spans(x, ("endpoint",))] for x in secrets.find_secrets(docs).collect()}
    assert got == {1: ["https://api.example.com"], 2: [], 3: ["http://a.b:8080"], 4: ["https://-a.b-"], 5: ["https://a..b"], 6: []}
