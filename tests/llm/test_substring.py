import hashlib
import random

from listingmill.llm import substring


def brute(rows, window=20):
    """rows: (doc_id, text); the digest of each row, in order of doc_id."""
    split = [(i, (t or "").encode().split()) for i, t in sorted(rows, key=lambda r: r[0])]
    seen, out = set(), {}
    for i, words in split:
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = b" ".join(w for w, x in zip(words, gone) if not x)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab") * rng.randint(1, 9) + rng.choice("xyz")
    passages = [[word() for _ in range(n)] for n in (19, 20, 21, 26, 33, 60)]
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)
        rows.append((i * 7, "  ".join(words)))
    rows += [(1000 + k, rows[5][1]) for k in range(10)] + [(2000, None), (2001, " \n\t"), (2002, "a " * 500)]
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(docs_of):
    for seed, block in ((1, 1 << 20), (2, 600)):
        rows = corpus(seed)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(docs_of(rows), block_bytes=block, bucket_bytes=500).collect()}
        assert got == brute(rows)


def test_edges(docs_of):
    text = " ".join(f"w{i}" for i in range(40))
    rows = substring.dedup(docs_of([(None, text), (1, text), (1, text), (2, text + " more")])).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in rows) == [(False, 40), (False, 40), (False, 40), (True, 0)]
    assert substring.dedup(docs_of([])).count() == 0


def test_repeats_every_whitespace_byte(docs_of):
    text = " ".join("x" * 3 for _ in range(50))  # no ASCII white space: one word
    row = substring.dedup(docs_of([text])).first()
    assert (row.n_words, row.n_removed) == (1, 0)
