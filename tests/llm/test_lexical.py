import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from listingmill.llm import lexical


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, top=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in sorted({(i, t) for i, t in items if t is not None}, key=str):
        scored = []
        for doc, c in counted:
            m = 10 + 90 * c.total() * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def corpus(seed=2):
    rng = random.Random(seed)
    words = ["The", "a", "of", *(f"w{k}" for k in range(200)), "é", "Ⅳ", "x1"]
    weights = [1 / (k + 1) for k in range(len(words))]
    text = lambda n: rng.choice((" ", ", ", "-")).join(rng.choices(words, weights, k=n))
    docs = [(k, text(rng.randint(0, 80))) for k in range(500)]
    hot = text(60)
    docs += [(1000 + k, hot) for k in range(200)]  # a large group of copies
    docs += [(2000, None), (2001, ""), (2002, "..."), (2003, "w5 " * 30_000), (7, "w150 w151 w152"), (7, "w150 w151 w152"), (None, "w150 w151"), (None, "w150 w151")]
    items = [(k, text(rng.randint(1, 30))) for k in range(40)] + [(90, None), (91, ""), (92, "zzz unknown"), (3, "w150 W151"), (93, hot), (93, hot), (None, "w199 w198")]
    return docs, items


@pytest.mark.parametrize("sizes", [{}, {"segment": 50, "block": 7, "least": 3}, {"segment": 64, "block": 4, "least": 1, "item_bytes": 900}])
def test_equals_brute_force(spark, docs_of, sizes):
    docs, items = corpus()
    rows = lexical.search(docs_of(docs).repartition(3), spark.createDataFrame(items, "item_id long, text string"), **sizes)
    got = sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in rows.collect()], key=str)
    assert got == brute(docs, items)


def test_blocks_are_skipped(spark):
    """Documents of many topics, a query on one: most blocks of its common words are never read, and the best are right."""
    rng = np.random.default_rng(1)
    n_topics, per, size = 30, 64, 100
    topic = np.repeat(np.arange(n_topics), per)
    terms_of, impacts, starts = [], [], [0]
    for t in topic:
        own = np.unique(np.r_[rng.choice(20, 10, False) + 3 * t % 60, 90 + rng.choice(10, 6, False)])
        terms_of.append(own)
        impacts.append(np.where(own < 90, 10_000, 1_000) + rng.integers(0, 500, len(own)))
        starts.append(starts[-1] + len(own))
    flat, values = np.concatenate(terms_of), np.concatenate(impacts).astype(np.int64)
    cells = lexical.build_segment(list(range(len(topic))), np.array(starts), flat, values, lexical._signs(size), 32, 8)
    segment = lexical.Segment({k: pa.array(np.asarray(cells[k], lexical._NUMPY[t])) for k, t in lexical._SEGMENT.items()}, size)
    query = np.array([3, 4, 5, 6, 90, 91, 92, 93, 94, 95, 96, 97, 98, 99])
    best = lexical.Best(10)
    segment.search(query, best)
    scores = np.array([values[a:b][np.isin(flat[a:b], query)].sum() for a, b in zip(starts[:-1], starts[1:])])
    assert best.scores.tolist() == np.sort(scores)[::-1][:10].tolist()
    assert segment.skipped > segment.read


def test_empty_tables(spark, docs_of):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(docs_of([]), items).isEmpty() and lexical.search(docs_of(["a b"]), items.filter("false")).isEmpty()
    assert lexical.search(docs_of([None, "", "..."]), items).isEmpty()
    assert lexical.search(docs_of(["a b"]), items).columns == ["item_id", "rank", "doc_id", "score"]
