import random
import re

import numpy as np
from pyspark.sql import functions as F
from test_decontam import brute as brute_contamination
from test_minhash import sets_of
from test_toxicity import corpus

import corpus_pipeline
from listingmill.llm import decontam, ownership, pieces, simhash, toxicity
from listingmill.llm.planes import public_path

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def test_stages_equal_brute_force(spark, tmp_path):
    docs, labels, _ = corpus(spark, 300)
    rng = random.Random(9)
    item = " ".join(f"bench{i}" for i in range(20))
    filler = " ".join(rng.choices("ra to li men su da rali tosu".split(), k=60))
    extra = [
        (2000, f"{filler} unique one", "en", "a", 1), (2001, f"{filler} unique one", "en", "b", 1),
        (2002, f"rata {item} limen", "en", "a", 1), (2003, "x password = abcDEF123456 y token: zz", "en", "only", 1),
        *[(2010 + k, f"doc{k} word{k} other{k} api_key=SharedValue99 more{k}", "en", f"owner{k}", 1) for k in range(4)],
    ]
    base = docs.filter("doc_id is not null").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").alias("n_chars"))
    tables = base.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars int")).repartition(3)
    tables.write.parquet(f"{tmp_path}/documents.parquet")
    labels.dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "short one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    source = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.train(source, spark.read.parquet(f"{tmp_path}/labels.parquet"), toxicity.learnable())
    rows = {r.doc_id: r.text for r in source.collect()}
    rows = {i: t for i, t in rows.items() if model.score(t) < 0.3}
    # near-copies: exact 5-word Jaccard of 0.8 or more, by components
    order = sorted(rows)
    label, sets = {i: i for i in order}, dict(zip(order, sets_of([rows[i] or "" for i in order])))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for n, i in enumerate(order):
        for j in order[:n]:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    rows = {i: rows[i] for i in order if root(i) == i}
    found = brute_contamination(sorted(rows.items()), [(1, item), (2, "short one")])
    rows = {i: t for i, t in rows.items() if not found[i][3]}
    for i, t in rows.items():
        if t:
            rows[i] = re.sub(ASSIGN, lambda m: m[0] if len(m[1]) < 8 or m[1] == "SharedValue99" else "<SECRET>", t)
    own = pieces.Pieces.load(public_path("piece_bpe_32k.model"))

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in got} == rows and len(got) == len(rows)
    assert 2000 in rows and 2001 not in rows and 2002 not in rows and "<SECRET>" in rows[2003] and "SharedValue99" in rows[2011]
    for r in got:
        assert r.ids == own.encode(r.text).tolist() and r.exact and own.decode(np.array(r.ids, np.int32)) == (r.text or "")


def test_columns(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes and out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_keep_their_values(spark):
    """Every name that a stage uses inside may be a column of the table."""
    names = ("th", "cut", "_row", "_th", "_new", "_id", "_n", "_doc_id", "copies", "w", "k", "start", "hubs", "found")
    text = ", ".join(f"'{n}!' AS {n}" for n in names)
    docs = spark.sql(f"SELECT 1L AS doc_id, 'my password = abcDEF123456 ok' AS text, 'en' AS lang, 's' AS source, 28 AS n_chars, {text}")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for out in (decontam.clean(docs, items), ownership.redact(docs), simhash.keep_first(docs)):
        [row] = out.collect()
        assert out.dtypes == docs.dtypes and all(row[n] == f"{n}!" for n in names)
    assert ownership.redact(docs).first().text == "my <SECRET> ok"
