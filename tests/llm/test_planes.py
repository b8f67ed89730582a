import zlib

import numpy as np
import pytest

from listingmill.llm import blobs, planes


@pytest.mark.parametrize("bits", [False, True])
def test_file_round_trip(tmp_path, bits):
    rng = np.random.default_rng(1)
    docs = [(i if i else None, rng.integers(0, 49408, int(n)).astype("<u4")) for i, n in enumerate(rng.integers(1, 300, 40))]
    docs.append((99, rng.integers(0, 70000, 5000).astype("<u4")))
    writer = planes.Writer(block_ids=512, bits=bits)
    for i, ids in docs:
        writer.add(i, ids)
    body = writer.finish()
    blobs.write(f"{tmp_path}/a", body)
    file = planes.Reader(f"{tmp_path}/a", sum(map(len, body)))
    every = np.concatenate([ids for _, ids in docs])
    assert file.doc_ids == [i for i, _ in docs] and list(file.lengths) == [len(x) for _, x in docs]
    assert (np.concatenate(list(file.blocks())) == every).all() and file.n_ids == len(every)
    for a, b in ((0, 1), (500, 520), (511, 1024), (0, len(every)), (len(every) - 1, len(every)), (7, 7)):
        assert (file.slice(a, b) == every[a:b]).all()


def whole(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(planes.public_path("word_bpe_49k.json"))
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


ODD = ["", " ", "A\tb\r\nc\x0bd\x0ce\x1cf\x85g h i　j", "don't WE'LL I'M x's", "ΑΣ ΟΔΟΣ. İi ǅ", "é e ́x ́", "<|endoftext|> a<|endoftext|>b <|startoftext|>", "12345 a1b2", "!!?? *** a***b", "日本語 の文", "x" * 3000, "👍🏽 ok", "한 ᄒ ᅡ"]


def test_words_encode_like_whole_texts():
    encode = planes.WordEncoder(planes.public_path("word_bpe_49k.json"))
    encode.KEPT = 5
    for _ in range(2):
        got = [list(np.frombuffer(x, "<u4")) for x in encode([t.encode() for t in ODD])]
        assert got == whole(ODD)


def test_query(spark, docs_of, tmp_path):
    pairs = [(i * 3 % 101, f"{t} word{i} " * (i % 7)) for i, t in enumerate(ODD * 4)] + [(500, None), (None, "none here"), (501, "same"), (501, "same")]
    rows = planes.digest(spark, docs_of(pairs)).collect()
    assert len(rows) == len(pairs)
    ordered = sorted(rows, key=lambda r: r.start)
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in ordered]
    assert ids == [None, *sorted(i for i in ids if i is not None)]
    unique = {i: t for i, t in pairs}
    for r in rows:
        want = np.array([*whole([unique[r.doc_id] or ""])[0], 1], "<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(want), zlib.crc32(want.tobytes()))
    assert planes.digest(spark, docs_of([])).count() == 0
