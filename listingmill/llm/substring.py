"""Substring dedup with difference-cover anchors.

A window of 20 words repeats if the same words start earlier in the corpus. Anchors are runs of 8 words that start
at positions whose remainder modulo 13 lies in the difference cover {0, 1, 3, 9}: for any two positions some shift
below 13 brings both onto the cover, so two equal windows share an aligned anchor inside them. Only anchors are
exchanged first. Where one repeats, the windows around it are candidates; these extend it to 20 words, and of each
distinct window the first place in the corpus is found.

Texts are read once. Tasks cut them into blocks of bounded size, write each block's words to the shared folder, and
from then on exchange hashes only, collapsed inside a block: a passage that every document repeats is one entry for
each block. The three steps are (1) anchors by hash, back to their blocks where another block has them too; (2) hashes
of candidate windows with their first place in the block, back as one bit each: an earlier block place exists or not;
(3) removal and digest, block by block. Hash entries of a pair (bucket, block) travel as one packed row, and every
bucket and every block is one task's group of bounded size.

Anchors use 48 bits beside their bucket, where a collision only costs a needless candidate. Windows use 96 bits of two
independent hashes in place of the words.

NULL and empty texts have no words, texts of fewer words than a window are kept whole. Rows with equal doc_id are one
document's texts in hash order; a NULL id sorts first. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingmill.llm import blobs
from listingmill.llm.common import raw_texts
from listingmill.session import materialize, shared_dir

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
#: Bytes of text in a block, of one longer text at least.
BLOCK_BYTES = 4 << 20
#: Bytes of text for each bucket of the two exchanges.
BUCKET_BYTES = 24 << 20
#: Bytes of text for each task between the exchanges.
TASK_BYTES = 32 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_NO_ID = -(1 << 63)


class Block:
    """The words of a run of documents, their hashes and where each document starts."""

    def __init__(self, ids: np.ndarray, tie: np.ndarray, texts: list[bytes]):
        self.ids, self.tie = ids, tie
        split = [t.split() for t in texts]
        self.words = list(chain.from_iterable(split))
        self.counts = np.array([len(w) for w in split], np.int64)
        del split
        self.starts = np.r_[0, np.cumsum(self.counts)]
        self.hash = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.counts)
        # Position in the document, and the words from here to its end.
        self.at = np.arange(len(self.words), dtype=np.int32) - self.starts[:-1].astype(np.int32)[self.doc]
        self.after = self.counts.astype(np.int32)[self.doc] - self.at

    def runs(self, where: np.ndarray, length: int, base: int) -> np.ndarray:
        """A mixed polynomial hash of the ``length`` words from each position."""
        out = np.zeros(len(where), np.uint64)
        for k in range(length):
            out = out * _ODD[base] + self.hash[where + k]
        out ^= out >> np.uint64(32)
        out *= _ODD[(base + 1) % 3]
        return out ^ (out >> np.uint64(29))

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions on the cover with a whole anchor, and the anchors' hashes."""
        width = window - PERIOD + 1
        on = np.isin(np.arange(PERIOD), COVER)
        where = np.flatnonzero(on[self.at % PERIOD] & (self.after >= width))
        return where, self.runs(where, width, 0)

    def candidates(self, where: np.ndarray, window: int) -> np.ndarray:
        """Starts of windows that hold an anchor at one of ``where`` at an offset below the period."""
        mark = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(mark, np.maximum(where - (PERIOD - 1), self.starts[:-1][self.doc[where]]), 1)
        np.add.at(mark, where + 1, -1)
        return np.flatnonzero((np.cumsum(mark[:-1]) > 0) & (self.after >= window))


def _pack(ids: np.ndarray, tie: np.ndarray, texts: list[bytes]) -> bytes:
    body = b"\n".join(b" ".join(t.split()) for t in texts)
    return zstandard.compress(len(texts).to_bytes(8, "little") + ids.tobytes() + tie.tobytes() + body, 3)


def _unpack(data: bytes) -> Block:
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:8], "little")
    ids, tie = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n)
    return Block(ids, tie, raw[8 + 16 * n :].split(b"\n") if n else [])


def _low_bytes(values: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _from_bytes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel()


def _by_bucket(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices) over hashes; the bucket comes from the top 16 bits and, beyond 65536 buckets, from more."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(bucket[part[0]]), part


def _schema(ddl: str) -> tuple[str, pa.Schema]:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
    return ddl, pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


_SENT = _schema("bucket long, block string, body binary")
_BACK = _schema("block string, bucket long, body binary")
_OUT = _schema("doc_id long, n_words long, n_removed long, kept_sha256 string")


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Runs of rows with equal ``key`` from sorted input."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and rows[0][key] != row[key]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _write_blocks(folder: str, window: int, buckets: int, block_bytes: int):
    """Step 1a: blocks to files, and their distinct anchors to the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, number
            held.sort(key=lambda r: r[:2])
            ids, tie = np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int64)
            texts, name = [r[2] for r in held], f"{part:06d}-{number:04d}"
            blobs.write(f"{folder}/{name}", [_pack(ids, tie, texts)])
            block = Block(ids, tie, texts)
            held, size, number = [], 0, number + 1
            _, hashes = block.anchors(window)
            hashes = np.unique(hashes)
            rows = [(b, name, _low_bytes(hashes[i], 6)) for b, i in _by_bucket(hashes, buckets)]
            yield _batch(_SENT[1], [*rows, (-1, name, b"")])

        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            for i, text in zip(ids, raw_texts(batch.column("text"))):
                text = text or b""
                held.append((int(i), xxhash.xxh64_intdigest(text) >> 1, text))
                size += len(text) + 64
                if size >= block_bytes:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1b: each block gets back its anchors that another block has too. The marker row of a block passes through."""
    for rows in _grouped(batches, "bucket"):
        if rows[0]["bucket"] < 0:
            yield _batch(_BACK[1], [(r["block"], -1, b"") for r in rows])
            continue
        lists = [_from_bytes(r["body"], 6) for r in rows]
        values, counts = np.unique(np.concatenate(lists), return_counts=True)
        many = values[counts > 1]
        for row, own in zip(rows, lists):
            shared = own[np.isin(own, many, assume_unique=True)]
            if len(shared):
                yield _batch(_BACK[1], [(row["block"], row["bucket"], _low_bytes(shared, 6))])


def _window_rows(block: Block, repeated: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct candidate windows: first hash, second hash, first start; and for each candidate (start, which)."""
    where, hashes = block.anchors(window)
    values, counts = np.unique(hashes, return_counts=True)
    local = values[counts > 1]
    low = np.uint64((1 << 48) - 1)
    keep = np.isin(hashes, local) | np.isin(hashes & low, repeated)
    starts = block.candidates(where[keep], window)
    one, two = block.runs(starts, window, 1), block.runs(starts, window, 2)
    order = np.lexsort((starts, two, one))  # documents of a block are in id order, so starts are in corpus order
    new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])] if len(order) else np.zeros(0, bool)
    first = order[new]  # the least start of each distinct window
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    which = np.empty(len(order), np.int64)
    which[order] = rank[np.cumsum(new) - 1]
    first.sort()  # in corpus order, neighbours share id and follow in position, which compresses well
    return one[first], two[first], starts[first], np.stack([starts, which])


def _send_windows(folder: str, window: int, buckets: int):
    """Step 2a: the distinct candidate windows of a block with their first place, to the buckets; the candidates to a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "block"):
            name = rows[0]["block"]
            block = _unpack(blobs.read(f"{folder}/{name}"))
            repeated = np.concatenate([np.zeros(0, np.uint64), *(_from_bytes(r["body"], 6) for r in rows if r["bucket"] >= 0)])
            one, two, first, every = _window_rows(block, repeated, window)
            sent, order = [(-1, name, b"")], [np.zeros(0, np.int64)]
            doc = block.doc[first]
            for bucket, i in _by_bucket(one, buckets):
                place = _steps(np.stack([block.ids[doc[i]], block.tie[doc[i]], block.at[first[i]]]).astype(np.int64))
                body = len(i).to_bytes(4, "little") + _low_bytes(one[i], 7) + _low_bytes(two[i], 5) + zstandard.compress(_planes(place), 1)
                sent.append((bucket, name, body))
                order.append(i)
            kept = [len(first), _steps(np.concatenate(order)[None])[0], *_steps(every)]
            blobs.write(f"{folder}/{name}.w", [zstandard.compress(_planes(np.r_[tuple(kept)].astype(np.int32)), 1)])
            yield _batch(_SENT[1], sent)

    return run


def _steps(rows: np.ndarray) -> np.ndarray:
    """Each row's differences, so that ``cumsum`` gives it back."""
    return np.diff(rows, axis=1, prepend=0)


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal rank together: the high ones are mostly equal and vanish in compression."""
    flat = np.ascontiguousarray(values).ravel()
    return flat.view(np.uint8).reshape(-1, flat.itemsize).T.tobytes()


def _unplaned(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _first_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2b: a bit for each window of a block, in the order sent: set if its first place lies in another block."""
    for rows in _grouped(batches, "bucket"):
        if rows[0]["bucket"] < 0:
            yield _batch(_BACK[1], [(r["block"], -1, b"") for r in rows])
            continue
        rows.sort(key=lambda r: r["block"])  # settles ties of wholly equal rows
        counts = [int.from_bytes(r["body"][:4], "little") for r in rows]
        one = np.concatenate([_from_bytes(r["body"][4 : 4 + 7 * n], 7) for r, n in zip(rows, counts)])
        two = np.concatenate([_from_bytes(r["body"][4 + 7 * n : 4 + 12 * n], 5) for r, n in zip(rows, counts)])
        places = [_unplaned(zstandard.decompress(r["body"][4 + 12 * n :]), np.int64) for r in rows for n in [int.from_bytes(r["body"][:4], "little")]]
        place = np.concatenate([np.cumsum(p.reshape(3, -1), axis=1) for p in places], axis=1)
        owner = np.repeat(np.arange(len(rows)), counts)
        order = np.lexsort((owner, place[2], place[1], place[0], two, one))
        a, b = one[order], two[order]
        later = np.zeros(len(one), bool)
        later[order[1:]] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        for row, bits in zip(rows, np.split(later, np.cumsum(counts)[:-1])):
            yield _batch(_BACK[1], [(row["block"], row["bucket"], len(bits).to_bytes(4, "little") + np.packbits(bits).tobytes())])


def _remove(folder: str, window: int):
    """Step 3: per document the counts and the digest of what stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "block"):
            name = rows[0]["block"]
            block = _unpack(blobs.read(f"{folder}/{name}"))
            saved = _unplaned(zstandard.decompress(blobs.read(f"{folder}/{name}.w")), np.int32)
            n = saved[0]
            order, every = np.cumsum(saved[1 : 1 + n]), np.cumsum(saved[1 + n :].reshape(2, -1), axis=1)
            later = np.zeros(n, bool)
            sent = 0
            for row in sorted(rows, key=lambda r: r["bucket"]):  # buckets were sent in ascending order
                if row["bucket"] >= 0:
                    size = int.from_bytes(row["body"][:4], "little")
                    later[order[sent : sent + size]] = np.unpackbits(np.frombuffer(row["body"], np.uint8, offset=4), count=size)
                    sent += size
            starts, which = every
            seen = np.full(n, np.iinfo(np.int32).max, np.int32)
            np.minimum.at(seen, which, starts)
            gone = starts[later[which] | (starts > seen[which])]
            mark = np.zeros(len(block.words) + 1, np.int32)
            np.add.at(mark, gone, 1)
            np.add.at(mark, gone + window, -1)
            removed = np.cumsum(mark[:-1]) > 0
            out = []
            for d in range(len(block.ids)):
                lo, hi = block.starts[d], block.starts[d + 1]
                cut = removed[lo:hi]
                kept = block.words[lo:hi]
                if cut.any():
                    kept = [w for w, x in zip(kept, cut) if not x]
                key = int(block.ids[d])
                out.append((None if key == _NO_ID else key, int(hi - lo), int(cut.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
            for at in range(0, len(out), 10_000):
                yield _batch(_OUT[1], out[at : at + 10_000])

    return run


def dedup(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs``."""
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} words at least")
    spark = docs.sparkSession
    folder = shared_dir(spark, "blocks")
    blobs.make_folder(folder)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    buckets = size // bucket_bytes + 8

    tasks = size // TASK_BYTES + 1

    def step(df: DataFrame, fn, key: str, ddl: str) -> DataFrame:
        return df.repartition(tasks, key).sortWithinPartitions(key).mapInArrow(fn, ddl)

    anchors = docs.select("doc_id", "text").mapInArrow(_write_blocks(folder, window, buckets, block_bytes), _SENT[0])
    # The marker rows of all blocks share bucket -1: they are spread, and only need to reach their block.
    salted = anchors.withColumn("key", F.when(F.col("bucket") < 0, F.concat(F.lit("-"), "block")).otherwise(F.col("bucket").cast("string")))
    back = materialize(step(salted, _repeated, "key", _BACK[0]), shared_dir(spark, "anchors"))
    sent = step(back, _send_windows(folder, window, buckets), "block", _SENT[0])
    salted = sent.withColumn("key", F.when(F.col("bucket") < 0, F.concat(F.lit("-"), "block")).otherwise(F.col("bucket").cast("string")))
    bits = step(salted, _first_places, "key", _BACK[0])
    return step(bits, _remove(folder, window), "block", _OUT[0])


SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, s, md5(array_to_string(list_slice(w, s, s + 19), ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
dup AS (SELECT r, s FROM (SELECT r, s, row_number() OVER (PARTITION BY g ORDER BY r, s) AS n FROM win) WHERE n > 1),
cut AS (SELECT DISTINCT r, s + k AS p FROM dup, (SELECT unnest(range(0, 20)) AS k)),
kept AS (SELECT d.r, string_agg(x, ' ' ORDER BY d.p) AS t, count(*) AS n FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) d ANTI JOIN cut USING (r, p) GROUP BY d.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
