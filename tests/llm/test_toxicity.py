import random
import zlib

import numpy as np

from listingmill.llm import toxicity


def corpus(spark, n=900, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(("ra", "to", "li", "men", "su", "da"), k=rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(3, 60))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(("vexo", "grum" + word(), "Blarg")))
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, int(toxic)))
    rows += [(n, None, "en", "s"), (n + 1, "", "en", "s"), (None, "vexo blarg vexo", "en", "s"), (n + 2, "rato " * 30_000, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sig string, w string")
    return docs, spark.createDataFrame([*labels, (5, 0), (n, None)], "doc_id long, toxic int"), dict(labels)


def test_held_out_rows_are_found(spark):
    docs, labels, true = corpus(spark)
    rows = toxicity.digest(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(key.encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(true[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in true]
    assert len(held) > 150 and sum(a != b for a, b in held) <= 0.02 * len(held)
    by = {r.doc_id: r.predicted for r in rows}
    assert by[None] == 1 and by[900] == by[901] == by[902] == 0


def test_the_stage_keeps_clean_rows(spark):
    docs, labels, true = corpus(spark, 400)
    kept = toxicity.reject(docs, labels)
    assert kept.schema == docs.schema
    ids = {r.doc_id for r in kept.collect()}
    assert sum(i in ids for i, t in true.items() if t) <= 2 and sum(i not in ids for i, t in true.items() if not t) <= 2


def test_without_labels(spark):
    docs, labels, _ = corpus(spark, 40)
    for some in (labels.filter("false"), labels.filter("toxic = 0")):
        assert {r.score for r in toxicity.digest(docs, some).collect()} == {0.0}
    assert toxicity.digest(docs.filter("false"), labels).count() == 0


def test_label_model_finds_rates_and_copies():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.2
    rate = np.array([[0.01, 0.02, 0.01, 0.3], [0.6, 0.5, 0.7, 0.3]])
    votes = (rng.random((6000, 4)) < rate[y.astype(int)]).astype(float)
    votes = np.c_[votes[:, :3], votes[:, 0], votes[:, 3]]  # the fourth voter copies the first
    posterior, found, weight = toxicity.label_model(votes, 0.2, 4)
    assert np.allclose(found[1, :3], rate[1, :3], atol=0.12) and np.allclose(found[0, :3], rate[0, :3], atol=0.03)
    assert weight[0] < 0.6 and weight[3] < 0.6 and weight[1] > 0.9
    assert ((posterior > 0.5) == y).mean() > 0.93
