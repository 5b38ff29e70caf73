from pyspark.sql import functions as F

from plumbline.llm import langid
from tests.conftest import SF


def test_held_out_accuracy(spark):
    got = langid.op1_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").cache()
    assert got.count() == 200
    held = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held >= 0.95
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_mixture_of_two_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    text = {r.lang: r.text for r in docs.where("length(text) > 1500 and lang in ('de', 'fr')").orderBy("doc_id").collect()}
    lang, score, mix = model.mixture(text["de"][:1000] + " " + text["fr"][:1000])
    assert {m[0] for m in mix[:2]} == {"de", "fr"} and all(0.3 < m[1] < 0.7 for m in mix[:2])
    assert abs(sum(s for _, s in mix) - 1) < 1e-3
    assert model.mixture(text["de"])[0] == "de"


def test_blocks_do_not_change_counts(monkeypatch):
    text = "abc déf, ghi jkl! " * 50
    whole = {int(a): int(b) for a, b in zip(*langid.trigrams(text))}
    monkeypatch.setattr(langid, "BLOCK", 97)
    cut = {int(a): int(b) for a, b in zip(*langid.trigrams(text))}
    assert whole == cut


def test_odd_rows(spark, odd, none):
    got = langid.language_mixture(odd).select("doc_id", "text", "language.*").collect()
    assert len(got) == odd.count()
    for r in got:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert r.lang == "und" and r.score == 0 and r.mix == []
        else:
            assert r.lang in ("en", "fr")
    assert langid.language_mixture(none).count() == 0
    assert {r.lang for r in langid.language_mixture(odd.withColumn("lang", F.lit(None).cast("string"))).select("language.lang").collect()} == {"und"}
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and kept.where("text is null or text = ''").count() == 0


def test_a_column_called_language_stays(spark, odd):
    docs = odd.withColumn("language", F.concat(F.lit("mine "), F.coalesce("text", F.lit(""))))
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() > 0
    assert kept.where("language <> concat('mine ', coalesce(text, ''))").count() == 0


def test_mixture_against_plain_expectation_maximisation():
    """The shares and the set of languages, against loops over trigrams and over all orders of sets tried."""
    import math

    import numpy as np

    r = np.random.default_rng(4)
    like = r.dirichlet(np.full(langid.BUCKETS, 0.01), 3).T + 1e-9
    model = langid.Model(["a", "b", "c"], like / like.sum(0))
    for text in ("some words of a text " * 5, "other words, others still, and more of them " * 3, "x"):
        found, counts = langid.trigrams(text)
        rows = [([float(x) for x in model.likelihood[t]], int(n)) for t, n in zip(found, counts, strict=True)]
        total = sum(n for _, n in rows)

        def em(chosen, rows=rows, total=total):
            share = {i: 1 / len(chosen) for i in chosen}
            for _ in range(30):
                new = {i: 0.0 for i in chosen}
                for p, n in rows:
                    whole = sum(share[i] * p[i] for i in chosen)
                    for i in chosen:
                        new[i] += n * share[i] * p[i] / whole / total
                moved = max(abs(new[i] - share[i]) for i in chosen)
                share = new
                if moved < 1e-4:
                    break
            return share, sum(n * math.log(sum(share[i] * p[i] for i in chosen)) for p, n in rows)

        alone = [sum(n * math.log(p[i]) for p, n in rows) for i in range(3)]
        best = alone.index(max(alone))
        full, _ = em([0, 1, 2])
        order = [best, *sorted((i for i in range(3) if i != best), key=lambda i: -full[i])]
        chosen, value, shares = [best], alone[best] - 0.5 * math.log(total), {best: 1.0}
        for k in (2, 3):
            share, loglik = em(order[:k])
            if full[order[k - 1]] < 1e-3 or loglik - 0.5 * k * math.log(total) <= value:
                break
            chosen, value, shares = order[:k], loglik - 0.5 * k * math.log(total), share
        lang, score, mix = model.mixture(text)
        assert {m[0] for m in mix} == {"abc"[i] for i in chosen}
        assert all(abs(s - shares["abc".index(name)]) < 1e-6 for name, s in mix)
        assert lang == "abc"[max(chosen, key=lambda i: shares[i])] and 0 <= score <= 1
