import hashlib
import random
import re

import pytest

from listingmill.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13):
    """doc_id -> n_words, n_hit, sorted ids, contaminated."""
    spans = [(i, w[s : s + window]) for i, t in items for w in [words(t)] if w for s in range(max(1, len(w) - window + 1))]
    out = {}
    for d, text in docs:
        own, hit, ids = words(text), set(), set()
        for i, win in spans:
            for s in range(len(own) - len(win) + 1):
                if own[s : s + len(win)] == win:
                    hit.update(range(s, s + len(win)))
                    ids.add(str(i))
        out[d] = (len(own), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(own))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(("Aa", "bb", "Éé", "éé", "c1", "d", "ee"))
    items = [(i, " ".join(word() for _ in range(rng.choice((1, 2, 3, 5, 13, 14, 30))))) for i in range(25)] + [(90, ""), (91, None), (92, "!!")]
    docs = []
    for i in range(60):
        own = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            t = rng.choice(items)[1] or ""
            own[rng.randint(0, len(own)) : 0] = t.upper().replace("É", "É").split() if rng.random() < 0.3 else t.split()
        docs.append((i, rng.choice((" ", ", ", "-")).join(own)))
    return [*docs, (500, None), (501, "..."), (502, "aa " * 20_000)], items


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, -1])
def test_equals_brute_force(spark, docs_of, limit):
    docs, items = corpus(1)
    items = [x for x in items if x[0] != 0]
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.contamination(docs_of(docs), table, broadcast_bytes=limit).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in rows}
    want = brute(docs, items)
    assert got == want


def test_rows(spark, docs_of):
    items = spark.createDataFrame([(7, "one two three"), (70, "one two three"), (None, "two three")], "item_id long, text string")
    docs = docs_of([(1, "One, two three four"), (1, "One, two three four"), (2, "clean text"), (None, "one two three")])
    rows = decontam.digest(docs, items).collect()
    assert len(rows) == 4
    one = [r for r in rows if r.doc_id == 1]
    assert len(one) == 2 and one[0] == one[1] and one[0].n_items == 2 and one[0].items_sha256 == hashlib.sha256(b"7,70").hexdigest()
    assert [r.doc_id for r in decontam.clean(docs, items).collect()] == [2]
    none = items.filter("false")
    assert {r.n_hit for r in decontam.digest(docs, none).collect()} == {0} and decontam.clean(docs, none).columns == docs.columns
    assert decontam.digest(docs_of([]), items).count() == 0
