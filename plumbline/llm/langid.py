"""Language identification by multilingual mixture inference.

Each document is a mixture of languages: every character trigram is drawn from one of them. Expectation
maximisation estimates the proportions, and the set of languages is the one of the best penalised likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Trigrams are hashed to so many buckets, so that the model's size is that times the languages.
BUCKETS = 1 << 15
#: Labelled rows of each language that the model is fitted on at most, taken by a hash of the id.
ROWS_PER_LANGUAGE = 20_000
#: Languages that a model may have; more is an error, not a cut.
MOST_LANGUAGES = 400
UNDETERMINED = "und"
#: Characters looked at in one step, so that texts of any length need bounded memory.
BLOCK = 1 << 19
_LETTER = regex.compile(r"\p{L}")
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashed trigrams of a whole text and how often each occurs. Letters are lowered, runs of anything else are one space."""
    table, total = _letter_table(), None
    tail = np.array([32], np.uint32)
    for at in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(table[codes], codes, np.uint32(32))
        codes = np.concatenate((tail, codes, [32] if at + BLOCK >= len(text) else [])).astype(np.uint32)
        codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
        h = codes[:-2] * np.uint32(2654435761) ^ codes[1:-1] * np.uint32(2246822519) ^ codes[2:] * np.uint32(3266489917)
        h = (h * np.uint32(668265263)) >> np.uint32(17)
        tail = codes[-2:]
        if len(text) <= BLOCK and len(h) < BUCKETS:
            return np.unique(h, return_counts=True)
        total = np.bincount(h, minlength=BUCKETS) + (0 if total is None else total)
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.flatnonzero(total)
    return found, total[found]


@dataclass
class Model:
    """likelihood[bucket, language]: the probability of a trigram in a language."""

    languages: list[str]
    likelihood: np.ndarray

    def mixture(self, text: str | None, penalty: float = 1.0, rounds: int = 30) -> tuple[str, float, list[tuple[str, float]]]:
        """(language of the largest share, score, shares by language from the largest).

        Sets of languages are tried in order of their shares in the full mixture, as long as the
        log-likelihood less `penalty` x half the logarithm of the number of trigrams for each language
        grows. The score is the share times the posterior of the language against each other one alone.
        Null and letterless texts give `und`, score 0 and no shares. Ties go to the language first in order.
        """
        if not text or not self.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0, []
        found, counts = trigrams(text)
        p, c = self.likelihood[found], counts.astype(np.float64)
        n = c.sum()
        alone = c @ np.log(p)
        best = int(alone.argmax())
        posterior = 1.0 / np.exp(np.maximum(alone - alone[best], -700.0)).sum()
        chosen, shares, value = [best], np.ones(1), alone[best] - penalty * 0.5 * np.log(n)
        if len(self.languages) > 1:
            full, _ = _em(p, c, n, rounds)
            order = [best, *(int(i) for i in np.argsort(-full, kind="stable") if i != best)]
            for k in range(2, len(order) + 1):
                if full[order[k - 1]] < 1e-3:
                    break
                some, loglik = _em(p[:, order[:k]], c, n, rounds)
                if loglik - penalty * 0.5 * k * np.log(n) <= value:
                    break
                chosen, shares, value = order[:k], some, loglik - penalty * 0.5 * k * np.log(n)
        top = int(shares.argmax())
        mix = sorted(((self.languages[i], float(s)) for i, s in zip(chosen, shares, strict=True)), key=lambda x: (-x[1], x[0]))
        sure = posterior if len(chosen) == 1 else 1.0
        return self.languages[chosen[top]], float(min(1.0, shares[top] * sure)), mix


def _em(p: np.ndarray, c: np.ndarray, n: float, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of the mixture of p's columns; stops when no proportion moves by 1e-4."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds):
        old = share
        share = share * ((c / (p @ share)) @ p) / n
        if np.abs(share - old).max() < 1e-4:
            break
    return share, float(c @ np.log(p @ share))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS_PER_LANGUAGE, smoothing: float = 0.05) -> Model:
    """The model of the labelled rows of docs: `rows` of each language, chosen by a hash of id and text; texts whole.

    Where a language has more rows, each is drawn with the chance that gives `rows` on the mean; rows equal in
    both are drawn together, and a language of which none is drawn is no language of the model.

    Rows with a null text or label are passed over. Without any labelled row the model has no language
    and finds every text undetermined. Counts are summed by bucket and language on the executors; what
    reaches the driver is bounded by BUCKETS x MOST_LANGUAGES whatever the input's size.
    """
    docs = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    docs = docs.where("text is not null and lang is not null")
    sizes = {r[0]: r[1] for r in docs.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)))
    small = [lang for lang in languages if sizes[lang] <= rows]
    chance = F.pmod(F.xxhash64(F.lit("language"), "id", "text"), F.lit(1 << 20))  # rows of one id are drawn one by one
    picked = F.col("lang").isin(small) if small else F.lit(False)
    for lang in languages:
        if lang not in small:
            picked = picked | ((F.col("lang") == lang) & (chance < round(rows / sizes[lang] * (1 << 20))))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                found, counts = trigrams(text)
                totals.setdefault(lang, np.zeros(BUCKETS, np.int64))[found] += counts
        for lang, total in totals.items():
            found = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": found, "n": total[found]})

    sums = docs.where(picked).select("text", "lang").mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(sums["lang"]))
    table = np.zeros((BUCKETS, len(languages)))
    table[sums["bucket"], pd.Categorical(sums["lang"], languages).codes] = sums["n"]
    table += smoothing
    return Model(languages, table / table.sum(0))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """struct<lang, score, mix> of the text column; see Model.mixture()."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang:string,score:double,mix:array<struct<lang:string,share:double>>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            got = [shared.value.mixture(t if isinstance(t, str) else None) for t in texts]
            yield pd.DataFrame({"lang": [x[0] for x in got], "score": [x[1] for x in got], "mix": [[{"lang": a, "share": b} for a, b in x[2]] for x in got]})

    return of(F.col(text_col))


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 2 by 4; false where the id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_mixture(docs: DataFrame, fitted_on: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """docs with `language` struct<lang, score, mix>, by a model of fitted_on (docs' rows that are not held out).

    Every row of docs stays, in any order and however often it is repeated; a column of docs called
    `language` is replaced. lang, source and id are no inputs of a prediction. Null, empty and letterless
    texts are undetermined (`und`) with score 0 and an empty mix; an empty table stays empty.
    """
    model = fit(docs.where(~held_out()) if fitted_on is None else fitted_on, text_col=text_col)
    return docs.withColumn("language", identify(docs, model, text_col))


def keep_identified(docs: DataFrame, least: float = 1 / 3) -> DataFrame:
    """docs without the rows whose language can't be told: `und`, or a main language of under `least` of the text.

    The model is fitted on docs' own labelled rows that are not held out. Null and letterless texts go;
    repeated rows stay or go together; an empty table stays empty. docs needs doc_id, text and lang;
    whatever other columns it has, one called `language` among them, come out as they were.
    """
    found = identify(docs, fit(docs.where(~held_out())))
    share = F.get(found["mix"], F.lit(0))["share"]
    return docs.where((found["lang"] != UNDETERMINED) & (share >= least))


def op1_language(spark, sf_dir: str) -> DataFrame:
    docs = language_mixture(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    return docs.select("doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.size("language.mix").alias("n_languages"))
