import random

import numpy as np
import pytest
import xxhash

from listingmill.llm import simhash

NEAR = 4


def brute_components(fps, near=NEAR):
    names = sorted(set(fps))
    label = {f: f for f in names}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if (a ^ b).bit_count() <= near:
                label[root(a)] = root(b)
    return {f: root(f) for f in names}


def test_golay_keys_meet():
    parity, patterns, count = simhash._golay()
    assert sorted(set(count)) == [1, 6] and (count == 1).sum() == 1 + 23 + 253
    rng = random.Random(1)
    for _ in range(2000):
        v = rng.getrandbits(23)
        keys, n = simhash.fuzzy_keys(np.array([v]))
        for flips in (1, 2):
            u = v
            for p in rng.sample(range(23), flips):
                u ^= 1 << p
            other, m = simhash.fuzzy_keys(np.array([u]))
            assert set(keys[0, : n[0]]) & set(other[0, : m[0]])
            if flips == 1:
                assert other[0, 0] in keys[0, : n[0]]


def test_fingerprint_is_the_majority():
    text = "One two  three\nfour five Six"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 3)
    assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint(b"Ab c") == xxhash.xxh64_intdigest(b"ab c", 42)
    assert simhash.fingerprint("É x".encode()) != simhash.fingerprint("é x".encode())


def cluster(seed, centres=6, members=60):
    rng = random.Random(seed)
    fps = []
    for _ in range(centres):
        c = rng.getrandbits(64)
        fps.append(c)
        for _ in range(members):
            f = rng.choice(fps)
            for p in rng.sample(range(64), rng.randint(1, 5)):
                f ^= 1 << p
            fps.append(f)
    return fps + [rng.getrandbits(64) for _ in range(100)] + [0, 0]


@pytest.mark.parametrize("group", [1 << 14, 8])
def test_components_equal_brute_force(spark, group):
    fps = cluster(3 if group > 8 else 4)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    prints = spark.createDataFrame([(100 + i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.components(prints, group=group).collect()}
    label = brute_components(fps)
    first = {}
    for i, f in enumerate(fps):
        first.setdefault(label[f], 100 + i)
    assert got == {100 + i: first[label[f]] for i, f in enumerate(fps)}


def test_large_key_streams(monkeypatch):
    rng = random.Random(5)
    c = rng.getrandbits(64)
    fps = np.array(sorted({c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)}), np.uint64)
    a, b = simhash.forest(fps)
    assert len(a) == len(fps) - 1
    assert all((int(x) ^ int(y)).bit_count() <= 4 for x, y in zip(a, b))


def test_documents(docs_of):
    base = " ".join(f"w{i}" for i in range(400))
    docs = docs_of([(5, base), (3, base), (9, base + " tail"), (1, None), (7, ""), (None, "alone here"), (4, "other words")])
    rows = {r.doc_id: r for r in simhash.digest(docs).collect()}
    assert rows[5].component_id == rows[3].component_id == rows[9].component_id == 3
    assert rows[1].component_id == rows[7].component_id == 1 and rows[1].fingerprint == "0" * 16
    assert rows[None].component_id is None
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 4), (True, 0)]
    assert simhash.keep_first(docs_of([(1, "a b"), (1, "a b")])).count() == 1
    assert simhash.digest(docs_of([])).count() == 0


def test_the_stage_takes_the_fingerprints_candidates(docs_of, monkeypatch):
    """Without the bands, texts with near fingerprints still meet; those that differ in the exact check stay."""
    texts = [" ".join(f"w{i}" for i in range(300)), " ".join([*(f"w{i}" for i in range(299)), "other"]), "quite another text", "Quite  another text"]
    monkeypatch.setattr(simhash.minhash, "_candidates", lambda distinct: distinct.sparkSession.createDataFrame([], "seq long, hub long"))
    assert sorted(r.doc_id for r in simhash.keep_first(docs_of(texts)).collect()) == [0, 2]
    monkeypatch.setattr(simhash, "fingerprint", lambda *_: 0)
    assert sorted(r.doc_id for r in simhash.keep_first(docs_of(texts)).collect()) == [0, 2]
