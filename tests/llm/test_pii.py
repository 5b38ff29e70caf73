import random
import re

from plumbline.llm import pii
from tests.conftest import SF

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def base(text):
    return [x for x in pii.find(text) if x[0] in ("email", "ip", "card", "phone")]


def test_random_texts_match_the_patterns():
    r = random.Random(2)
    for _ in range(20000):
        alphabet = r.choice(["0123456789. -+", "a@.b-1", "0 4-", "+1 2(3).-", "12.", "1234567890 -+.@ab()٣é"])
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
        assert base(text) == brute(text), text


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = pii.op4_pii(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        want = brute(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in want) for k, _ in PATTERNS]
        assert all(f"{k}:{s}:{e}" in r.spans.split(",") for k, s, e in want)


def test_added_spans_and_masks():
    text = "IBAN: DE89 3704 0044 0532 0130 00 ssn 123-45-6789, account number 12345678901, https://bob:pw@h/x account of it"
    assert [(k, text[s:e]) for k, s, e in pii.find(text)] == [("account", "DE89 3704 0044 0532 0130 00"), ("account", "123-45-6789"), ("account", "12345678901"), ("address", "bob:pw@h")]
    assert pii.masked("mail bob@x.org or +1 (555) 123-4567.") == "mail <EMAIL> or <PHONE>."
    assert pii.masked("nothing 12 here") == "nothing 12 here" and pii.masked(None) is None


def test_odd_rows(spark, odd, none):
    assert pii.find_personal(odd).count() == odd.count() and pii.find_personal(none).count() == 0
    got = pii.mask_personal(odd)
    assert got.columns == odd.columns and got.exceptAll(odd).count() == 0
    assert pii.find("1" * 6000 + ".1.1.1") == [] and pii.find("0" * 5000 + "1.1.1.1")[0][0] == "ip"


def test_social_security_cues_in_title_case_and_with_number():
    for cue in ("Social Security number: ", "Social Security Number ", "social security no. ", "SOCIAL SECURITY NUMBER: ", "Social security ", "SSN number "):
        assert ("account", len(cue), len(cue) + 11) in pii.find(f"{cue}123-45-6789 end"), cue
