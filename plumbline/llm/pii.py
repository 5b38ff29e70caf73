"""Personal data found by Aho-Corasick anchors that local parsers expand and validate."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Kinds in the order in which spans are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "account", "address")
SPANS = "array<struct<kind:string,start:int,end:int>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")
#: After a cue: an optional type word and separators, then the identifier.
_IBAN = re.compile(r"[\x20:#=.-]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_SOCIAL = re.compile(r"(?:\x20?(?:[Nn]umber|NUMBER|[Nn]o\.?|[Nn]r\.?))?[\x20:#=.-]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_NUMBER = re.compile(r"(?:\x20?(?:number|no\.?|nr\.?))?[\x20:#=]{0,4}([0-9](?:[\x20-]?[0-9]){7,17})(?![0-9])")
_USER = re.compile(r"[A-Za-z0-9._%+-]+:[^\s/@:]+@[A-Za-z0-9.-]+(?::[0-9]+)?")
#: Cues and the parser for what follows them; fixed values.
CUES = {"iban": "iban", "ssn": "social", "social security": "social", "account": "number", "acct": "number", "konto": "number", "cuenta": "number", "compte": "number"}
_PARSERS = {"iban": _IBAN, "social": _SOCIAL, "number": _NUMBER}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i & 1:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def iban_ok(code: str) -> bool:
    """The check of an IBAN: its first four characters put last, letters as 10 to 35, the rest by 97 is 1."""
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("at", 1))
    a.add_word("://", ("scheme", 3))
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
        a.add_word(f"+{d}", ("plus", 2))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            a.add_word(form, (cue, len(form)))
    a.make_automaton()
    return a


_anchors: list[ahocorasick.Automaton] = []


def find(text: str | None) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of code points, end exclusive, by kind as in KINDS, then start.

    Email, ip, card and phone give exactly what a leftmost scan for their patterns gives, failing
    matches dropped: every match holds an anchor (an at-sign, a digit, a plus with a digit), and each
    parser knows where a scan would start and where its last match ended. The method adds `account`
    (IBAN, social security and account numbers after a cue, validated) and `address` (a URL's user
    info with its host, which may hold what is also an email).
    """
    if not text:
        return []
    if not _anchors:
        _anchors.append(_automaton())
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    cues, schemes = [], []
    email_end = ip_end = card_end = phone_end = run = 0
    for last, (what, size) in _anchors[0].iter(text):
        at = last - size + 1
        if what == "digit":
            if at >= run:  # a scan for an ip can start at the first digit of a run, or where a match ended within it
                m = _IP.match(text, at)
                if m:
                    run = ip_end = m.end()
                    if all(len(x) < 5 and int(x) <= 255 or int(x.lstrip("0")[:4] or 0) <= 255 and len(x.lstrip("0")) < 4 for x in m.groups()):
                        found["ip"].append((at, ip_end))
                else:
                    run = at + 1
                    while run < len(text) and "0" <= text[run] <= "9":
                        run += 1
            if at >= card_end:
                m = _CARD.match(text, at)
                if m:
                    card_end = m.end()
                    digits = _NO_DIGIT.sub("", m[0])
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append((at, card_end))
        elif what == "plus":
            if at >= phone_end:
                m = _PHONE.match(text, at)
                if m:
                    phone_end = m.end()
                    if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                        found["phone"].append((at, phone_end))
        elif what == "at":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            m = start < at and _DOMAIN.match(text, at + 1)
            if m:
                email_end = m.end()
                found["email"].append((start, email_end))
        elif what == "scheme":
            schemes.append(last + 1)
        else:
            cues.append((last + 1, CUES[what]))
    base = sorted(x for k in KINDS[:4] for x in found[k])
    if cues or schemes:
        _add(text, cues, schemes, base, found)
    return [(k, s, e) for k in KINDS for s, e in found[k]]


def _add(text: str, cues: list, schemes: list, base: list[tuple[int, int]], found: dict[str, list[tuple[int, int]]]) -> None:
    """Addresses (which may hold what looks like an email), and accounts clear of the base spans and of one another."""
    found["address"] += [(m.start(), m.end()) for at in schemes if (m := _USER.match(text, at))]
    got = []
    for at, parser in cues:
        m = _PARSERS[parser].match(text, at)
        if m and (parser != "iban" or iban_ok(m[1])):
            got.append((m.start(1), m.end(1)))
    i = end = 0
    for s, e in sorted(got):
        while i < len(base) and base[i][1] <= s:
            i += 1
        if s >= end and not any(b < e for b, _ in base[i : i + 1]):
            found["account"].append((s, e))
            end = e


def spans(text: Column) -> Column:
    """find() of a text column, null as the empty text."""

    @F.pandas_udf(SPANS)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in texts])

    return of(text)


def mask(text: Column) -> Column:
    """The text with <KIND> in place of each span; overlapping spans are masked as one, by the first one's kind. Null stays null."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([masked(t) for t in texts], dtype="object")

    return of(text)


def masked(text: str | None) -> str | None:
    hits = sorted((s, e, k) for k, s, e in find(text))
    if not hits:
        return text
    out, at, last = [], 0, 0
    for s, e, k in hits:
        if s >= last:
            out += [text[at:s], f"<{k.upper()}>"]
        at = last = max(last, e)
    return "".join([*out, text[at:]])


def find_personal(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `pii_spans`; row by row, whole texts.

    Null and empty texts have none; of spans that overlap within a kind the leftmost stands; repeated rows each get
    the same; an empty table stays empty; a column of docs called `pii_spans` is replaced, others come out as they were.
    """
    return docs.withColumn("pii_spans", spans(F.col(text_col)))


def mask_personal(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the personal data in text_col masked; all rows and other columns stay as they are, whatever their names.

    Null and empty texts stay so; repeated rows are masked alike; an empty table stays empty.
    """
    return docs.withColumn(text_col, mask(F.col(text_col)))


def op4_pii(spark, sf_dir: str) -> DataFrame:
    docs = find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    one = lambda kinds: F.array_join(F.transform(F.filter("pii_spans", lambda x: x["kind"].isin(*kinds)), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("pii_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return docs.select("doc_id", *map(count, KINDS[:4]), F.sha2(one(KINDS[:4]).cast("binary"), 256).alias("base_sha256"), one(KINDS).alias("spans"))
