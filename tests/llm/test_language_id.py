import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from listingmill.llm import language_id as lid


def brute_probability(texts, gram, alphabet, discount=lid.DISCOUNT):
    """Interpolated Kneser-Ney over plain dictionaries."""
    padded = ["   " + " ".join(t.lower().split()) + " " for t in texts]
    counts = {4: Counter(p[i : i + 4] for p in padded for i in range(len(p) - 3))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    p = 1 / alphabet
    for k in (1, 2, 3, 4):
        own, ctx = gram[4 - k :], gram[4 - k : 3]
        same = [n for g, n in counts[k].items() if g[:-1] == ctx]
        if same:
            p = max(counts[k][own] - discount, 0) / sum(same) + discount * len(same) / sum(same) * p
    return p


EN = ["the cat sat on the mat", "this is the house that jack built", "the  Quick brown fox", "that thing there"]
DE = ["der hund und die katze", "das ist nicht schön", "ich und du und der zug", "die straße ist schön"]


def fitted(docs):
    return lid.train(docs, F.lit(False))


def test_probabilities(docs_of):
    model = fitted(docs_of(EN).union(docs_of(DE, "de")))
    assert model.langs == ["de", "en"]
    alphabet = len(model.tables["g", 1][0]) + 1
    for gram in ("the ", " the", "   t", "cat ", "zzzz", "thez", "schö"):
        points = [ord(c) for c in gram]
        number = np.array([points[0] << 48 | points[1] << 32 | points[2] << 16 | points[3]])
        got = np.exp(model.log_probabilities(number))[0]
        for lang, texts in zip(model.langs, (DE, EN)):
            assert math.isclose(got[model.langs.index(lang)], brute_probability(texts, gram, alphabet), rel_tol=1e-4), (gram, lang)


def test_identify(docs_of, spark):
    rng = random.Random(2)
    rows = []
    for lang, words in (("en", " ".join(EN).split()), ("de", " ".join(DE).split())):
        rows += [(None, " ".join(rng.choices(words, k=12)), lang) for _ in range(60)]
    rows = [(i, t, lang) for i, (_, t, lang) in enumerate(rows)]
    rows += [(900, None, "en"), (901, "", "de"), (902, "123 !!", "en"), (903, "the mat " * 200_000, None), (None, "und die katze", None), (904, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("letters", F.lit("clash")).withColumn("gram", F.lit("clash"))
    out = {r.doc_id: r for r in lid.digest(docs).collect()}
    assert len(out) == len(rows)
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902))
    assert out[903].lang_pred == "en" and out[None].lang_pred == "de"
    held = [(out[i].lang_pred == lang) for i, _, lang in rows[:120] if out[i].held_out]
    assert len(held) > 20 and sum(held) == len(held)
    assert all(0 <= r.score <= 1 for r in out.values())
    empty = docs.filter("doc_id < 0")
    assert lid.digest(empty).count() == 0
    assert {r.lang_pred for r in lid.digest(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_pieces_do_not_change_entropy(docs_of, monkeypatch):
    model = fitted(docs_of(EN).union(docs_of(DE, "de")))
    texts = ["the cat and the hat " * 50, "a", "schön ist das"]
    whole = model.entropies(texts)
    monkeypatch.setattr(lid, "PIECE", 7)
    assert np.allclose(whole, model.entropies(texts), atol=1e-5)


def test_no_two_grams_share_an_entry(spark):
    grams = np.random.default_rng(6).integers(0, 1 << 62, 40_000) * 2
    rows = spark.createDataFrame([("g", 4, "l7", int(g), float(i % 1000) / 1000) for i, g in enumerate(grams)], "kind string, width int, lang string, gram long, value double")
    model = lid.Model.build(rows, [f"l{i}" for i in range(100)])
    assert np.allclose(model._look("g", 4, grams)[:, 7], np.arange(40_000) % 1000 / 1000)
    assert not model._look("g", 4, grams + 1).any()
