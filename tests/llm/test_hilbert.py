import zlib
from collections import Counter

from pyspark.sql import functions as F

from listingmill.llm import hilbert


def test_the_curve_is_one_walk(spark):
    for axes, bits in ((2, 4), (3, 3)):
        n = 1 << bits
        names = [f"a{k}" for k in range(axes)]
        df = spark.range(n**axes).select(*[(F.floor(F.col("id") / n**k) % n).cast("int").alias(x) for k, x in enumerate(names)])
        rows = sorted(tuple(r) for r in df.select(hilbert.curve_index(names, bits), *names).collect())
        assert [r[0] for r in rows] == list(range(n**axes))
        assert all(sum(abs(a - b) for a, b in zip(p[1:], q[1:])) == 1 for p, q in zip(rows, rows[1:]))


def test_shards(spark, docs_of):
    texts = [None, "", "é" * 40, *("same text" for _ in range(300)), *("x" * (i % 90) for i in range(200))]
    docs = docs_of([(i if i != 7 else None, t) for i, t in enumerate(texts)])
    for part_rows in (1 << 18, 16):
        rows = hilbert.shard_documents(docs, part_rows=part_rows).collect()
        assert len(rows) == len(texts)
        by_shard = {}
        for r in rows:
            by_shard.setdefault(r.shard, []).append(r)
            text = ((texts[r.doc_id] if r.doc_id is not None else texts[7]) or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 8, zlib.crc32(text), "rows", None)
        sizes = Counter(len(v) for v in by_shard.values())
        assert sorted(by_shard) == list(range(24)) and max(sizes) - min(sizes) <= 1
        cells = []
        for shard in range(24):
            own = sorted(by_shard[shard], key=lambda r: r.slot)
            assert [r.slot for r in own] == list(range(len(own)))
            cells += [r.cell for r in own]
        assert cells == sorted(cells)  # shards are runs of the curve


def test_few_rows(spark, docs_of):
    assert hilbert.shard_documents(docs_of([])).count() == 0
    rows = hilbert.shard_documents(docs_of([(1, "a"), (1, "a"), (2, "b")])).collect()
    assert len({r.shard for r in rows}) == 3 and {r.slot for r in rows} == {0}
