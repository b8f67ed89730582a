import random

import numpy as np

from listingmill.llm import minhash, simhash


def sets_of(texts):
    """5-word shingles as plain sets."""
    out = []
    for t in texts:
        words = t.lower().split()
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    return out


def brute_kept(texts):
    sets = sets_of(texts)
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {root(i) for i in range(len(sets))}


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed=1):
    rng = random.Random(seed)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))]
        texts += [" ".join(base), *(edited(rng, base, max(1, len(base) * k // 200)) for k in (1, 2, 3, 4, 5, 8))]
    base = [f"hot{i}" for i in range(120)]
    return texts + [edited(rng, base, 2) for _ in range(60)] + ["a b", "A  b", "a c", "one two three four five", "one two three four six"]


def test_edited_copies_go(docs_of):
    texts = corpus()
    want = brute_kept(texts)
    assert 40 < len(want) < 200
    assert {r.doc_id for r in simhash.keep_first(docs_of(texts)).collect()} == want


def test_large_groups_meet_in_slices(docs_of, monkeypatch):
    monkeypatch.setattr(minhash, "SLICE", 4)
    monkeypatch.setattr(minhash, "PARTS", 3)
    texts = corpus(2)
    assert {r.doc_id for r in simhash.keep_first(docs_of(texts)).collect()} == brute_kept(texts)


def test_pairs_at_the_least_similarity_meet():
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(2000):
        own = rng.integers(0, 1 << 63, 120, np.uint64)  # 80 of 100 in common
        a, b = own[:90], np.r_[own[:80], own[110:120]]
        met += bool((minhash.band_keys(a) == minhash.band_keys(b)).any())
    assert met == 2000


def test_other_texts_of_one_id_stay(docs_of):
    rng = random.Random(5)
    texts = [[f"{k}x{i}" for i in range(80)] for k in range(8)]
    whole = [" ".join(t) for t in texts]
    near = [edited(rng, t, 1) for t in texts]
    docs = [(None, whole[0]), (None, whole[1]), (None, whole[1]), (None, whole[2]), (7, whole[3]), (7, whole[4]), (7, near[4]), (1, near[3]), (7, whole[5]), (2, near[0])]
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.keep_first(docs_of(docs)).collect())
    first = next(t for t in (whole[4], near[4]) if (7, t) in kept)  # which of the two copies under one id is up to the hash
    assert kept == sorted([(0, whole[0]), (0, whole[1]), (0, whole[2]), (1, near[3]), (7, first), (7, whole[5])])


def test_links_of_a_large_group_are_about_one_a_text(spark):
    """Each of n texts linked to many hubs: about n links are left, in the same components."""
    rng = random.Random(3)
    links = [(k, rng.choice(range(0, 40))) for k in range(40, 1500) for _ in range(12)] + [(5000, 4000), (5001, 4000)]
    left = minhash.contracted(spark.createDataFrame(links, "seq long, hub long")).collect()
    assert len(left) < 1500 + 40 * 40

    def parts(pairs):
        label = {}

        def root(x):
            while label.setdefault(x, x) != x:
                x = label[x]
            return x

        for a, b in pairs:
            label[max(root(a), root(b))] = min(root(a), root(b))
        return {x: root(x) for x in list(label)}

    assert parts((r.seq, r.hub) for r in left) == parts(links)
