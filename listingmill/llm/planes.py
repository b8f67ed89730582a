"""Token ids as bit-plane shuffled binary files.

A file holds the ids of a run of documents, cut into blocks of a fixed number of ids. A block is transposed into
planes, one for each byte (or bit) of an id, so that equal-ranked bytes lie together, and every plane is compressed
with zstandard on its own. Behind the blocks follow the table of documents, the index of blocks and a footer:

    "BPS1" | block 0: plane 0, plane 1, ... | block 1: ... | documents | index | footer

The footer tells where documents and index lie; the index holds, for each block, its offset, its number of ids and
the sizes of its planes. A reader can thus take any range of ids without touching the rest of the file.

Documents are dealt to tasks by ranges of doc_id and sorted there, so files follow one another in ascending order;
each is written under its own name and renamed when whole, which makes repeated tasks harmless. NULL texts are empty,
every document ends in the end id, rows with equal doc_id follow one another in the order of their text's hash, a
NULL id comes first. Extra columns are ignored.

Words are encoded once per task and kept in a dictionary of bounded size: the tokenizer's pattern never crosses
ASCII white space, so a text's ids are those of its words one after the other.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from listingmill.llm import blobs
from listingmill.llm.common import raw_texts, slices
from listingmill.session import materialize, shared_dir

MAGIC = b"BPS1"
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 22
#: Bytes of text that one writing task should take.
TASK_BYTES = 32 << 20
END = 1
_FOOTER = struct.Struct("<QQQQQQB4s")  # documents at, length; index at, length; documents, ids; bit planes?; magic


def split_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The planes of little-endian 32-bit ids, the lowest first; planes above the highest id are left out."""
    top = int(ids.max()) if len(ids) else 0
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(max(1, (top.bit_length() + 7) // 8))]
    flags = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(flags[:, k], bitorder="little").tobytes() for k in range(max(1, top.bit_length()))]


def join_planes(planes: list[bytes], n: int, bits: bool = False) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    if not bits:
        for k, plane in enumerate(planes):
            out[:, k] = np.frombuffer(plane, np.uint8)
        return out.view("<u4").ravel()
    flags = np.zeros((n, 32), np.uint8)
    for k, plane in enumerate(planes):
        flags[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), bitorder="little", count=n)
    return np.packbits(flags, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Gathers documents and gives the bytes of one file."""

    def __init__(self, block_ids: int = BLOCK_IDS, bits: bool = False):
        self.block_ids, self.bits = block_ids, bits
        self.parts, self.at, self.index = [MAGIC], len(MAGIC), []
        self.ids, self.lengths, self.rest, self.waiting, self.total = [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids))
        self.rest.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= self.block_ids:
            self._blocks(self.block_ids)

    def _blocks(self, least: int) -> None:
        held = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        while len(held) >= max(1, least):
            now, held = held[: self.block_ids], held[self.block_ids :]
            packed = [zstandard.compress(p, 3) for p in split_planes(now, self.bits)]
            self.index.append((self.at, len(now), [len(p) for p in packed]))
            self.parts += packed
            self.at += sum(map(len, packed))
        self.rest, self.waiting = [held], len(held)

    def finish(self) -> list[bytes]:
        self._blocks(1)
        known = np.array([i is not None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], "<i8")
        documents = zstandard.compress(known.tobytes() + ids.tobytes() + np.array(self.lengths, "<u4").tobytes(), 3)
        index = zstandard.compress(b"".join(struct.pack(f"<QIB{len(s)}I", at, n, len(s), *s) for at, n, s in self.index), 3)
        tail = _FOOTER.pack(self.at, len(documents), self.at + len(documents), len(index), len(self.ids), self.total, self.bits, MAGIC)
        return [*self.parts, documents, index, tail]


class Reader:
    """One file, read piece by piece."""

    def __init__(self, uri: str, size: int):
        self.uri = uri
        d_at, d_len, i_at, i_len, self.n_docs, self.n_ids, bits, magic = _FOOTER.unpack(blobs.read(uri, size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} isn't a file of this format")
        self.bits = bool(bits)
        raw, n = zstandard.decompress(blobs.read(uri, d_at, d_len)), self.n_docs
        known, ids = np.frombuffer(raw, np.uint8, n), np.frombuffer(raw, "<i8", n, n)
        self.doc_ids = [int(i) if k else None for k, i in zip(known, ids)]
        self.lengths = np.frombuffer(raw, "<u4", n, 9 * n).astype(np.int64)
        raw, at, self.index = zstandard.decompress(blobs.read(uri, i_at, i_len)), 0, []
        while at < len(raw):
            where, n, planes = struct.unpack_from("<QIB", raw, at)
            self.index.append((where, n, struct.unpack_from(f"<{planes}I", raw, at + 13)))
            at += 13 + 4 * planes

    def blocks(self) -> Iterator[np.ndarray]:
        for number in range(len(self.index)):
            yield self.block(number)

    def block(self, number: int) -> np.ndarray:
        at, n, sizes = self.index[number]
        raw, cuts = blobs.read(self.uri, at, sum(sizes)), np.r_[0, np.cumsum(sizes)]
        return join_planes([zstandard.decompress(raw[a:b]) for a, b in zip(cuts, cuts[1:])], n, self.bits)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; only their blocks are read."""
        ends = np.cumsum([n for _, n, _ in self.index])
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
        got = [self.block(k) for k in range(first, min(last + 1, len(ends)))]
        base = ends[first] - self.index[first][1] if got else 0
        return np.concatenate([np.zeros(0, np.uint32), *got])[start - base : stop - base]


class WordEncoder:
    """Little-endian 32-bit ids of texts, as bytes.

    Ids of words are kept in a dictionary. A new word of Latin letters with ASCII marks behind them is made of those of its lower-case
    letters and of its marks, since the tokenizer lowers case and cuts between letters and marks; the apostrophe, which may belong
    to letters behind it, is left out of that. New parts are encoded many at a time as one text, with bars between them: the ids of a
    part are those between two bars. Parts that hold a bar themselves are told apart by their offsets.
    """

    KEPT, LONGEST, BAR = 1_000_000, 48, "|"
    PARTS = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # no part comes twice, so the library's own dictionary only costs
        bar = self.tokenizer.encode(self.BAR, add_special_tokens=False).ids
        self.bar = bar[0] if len(bar) == 1 else None

    def _spaced(self, parts: list[str]) -> list[bytes]:
        """The ids of each part, none of which holds white space, by the offsets of the whole."""
        out: list[bytes] = []
        for at in range(0, len(parts), 512):
            some = parts[at : at + 512]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            starts = np.r_[0, np.cumsum([len(p) + 1 for p in some])]
            firsts = np.fromiter((o[0] for o in got.offsets), np.int64, len(got.offsets))
            cuts = (4 * np.searchsorted(firsts, starts)).tolist()
            raw = np.array(got.ids, "<u4").tobytes()
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def _barred(self, parts: list[str]) -> list[bytes]:
        """The ids of each part, none of which holds white space or a bar, without offsets."""
        out: list[bytes] = []
        for at in range(0, len(parts), 512):
            some = parts[at : at + 512]
            [got] = self.tokenizer.encode_batch_fast([f" {self.BAR} ".join(some)], add_special_tokens=False)
            ids = np.array(got.ids, "<u4")
            bars = np.flatnonzero(ids == self.bar)
            if len(bars) != len(some) - 1:
                out += self._spaced(some)
                continue
            raw, starts, ends = ids.tobytes(), (4 * np.r_[0, bars + 1]).tolist(), (4 * np.r_[bars, len(ids)]).tolist()
            out += [raw[a:b] for a, b in zip(starts, ends)]
        return out

    def _parts(self, parts: dict[bytes, None]) -> dict[bytes, bytes]:
        """The ids of parts, from the dictionary where it has them."""
        found = {p: self.known[p] for p in parts if p in self.known}
        new = [p for p in parts if p not in found]
        plain = [p for p in new if self.bar is not None and b"|" not in p]
        odd = [p for p in new if self.bar is None or b"|" in p]
        for some, encode in ((plain, self._barred), (odd, self._spaced)):
            found.update(zip(some, encode([p.decode() for p in some])))
        return found

    def _encoded(self, words: list[bytes]) -> dict[bytes, bytes]:
        heads, marks = [], []
        for word in words:
            match = self.PARTS.fullmatch(word.decode())
            if match:
                head, mark = match.groups()
                heads.append(head.lower().encode())
                marks.append(mark.encode())
            else:
                heads.append(word)
                marks.append(b"")
        found, behind = self._parts(dict.fromkeys(heads)), self._parts(dict.fromkeys(m for m in marks if m))
        out = {word: found[head] + behind[mark] if mark else found[head] for word, head, mark in zip(words, heads, marks)}
        return {**found, **behind, **out}

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        new = list(set(chain.from_iterable(split)).difference(self.known))
        if new and len(self.known) > self.KEPT:
            self.known = {}
            new = list(set(chain.from_iterable(split)))
        self.known.update(self._encoded(new))
        ids = self.known.__getitem__
        out = [b"".join(map(ids, words)) for words in split]
        for word in new:
            if len(word) > self.LONGEST:
                self.known.pop(word, None)
        return out


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One for each worker, so that its dictionary serves all the worker's tasks."""
    return WordEncoder(path)


_MANIFEST = "file string, bytes long, part int, number int, first long, n_docs long, n_ids long"
_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_files(docs: DataFrame, folder: str, encoder: Callable, end: int = END, bits: bool = False, block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode ``docs`` into files below ``folder``; the manifest with the position ``base`` of each file's first id.

    ``encoder`` makes, in a task, a function from texts (bytes) to their ids as little-endian 32-bit bytes.
    """
    spark = docs.sparkSession
    blobs.make_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, encode = TaskContext.get().partitionId(), 0, encoder()
        tail = np.array([end], "<u4").tobytes()
        file = Writer(block_ids, bits)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal file, number
            if file.ids:
                name, body = f"{part:06d}-{number:04d}.bps", file.finish()
                blobs.write(f"{folder}/{name}", body)
                row = (name, sum(map(len, body)), part, number, file.ids[0], len(file.ids), file.total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], k) for v, k in zip(row, (pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 3))],
                    names=[f.split()[0] for f in _MANIFEST.split(", ")],
                )
            file, number = Writer(block_ids, bits), number + 1

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = [t or b"" for t in raw_texts(batch.column("text"))]
            lengths = np.array([len(t) for t in texts])
            for a, b in slices(lengths, 2 << 20):
                for doc_id, got in zip(ids[a:b], encode(texts[a:b])):
                    file.add(doc_id, np.frombuffer(got + tail, "<u4"))
                    if file.total >= file_ids:
                        yield from close()
        yield from close()

    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(size // TASK_BYTES + 1, "doc_id")
    rows = dealt.sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(run, _MANIFEST)
    rows = materialize(rows, shared_dir(spark, "manifest"))
    # One row for each file of some million ids: few rows, whatever the input.
    before = W.orderBy(F.col("first").asc_nulls_first(), "part", "number").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_documents(manifest: DataFrame, folder: str, tasks: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = Reader(f"{folder}/{row['file']}", row["bytes"])
                crcs, at, left, crc = [], 0, int(file.lengths[0]) if file.n_docs else 0, 0
                for block in file.blocks():
                    raw = memoryview(block.astype("<u4").tobytes())
                    while at < file.n_docs and len(raw) // 4 >= left:
                        crcs.append(zlib.crc32(raw[: 4 * left], crc))
                        raw, at, crc = raw[4 * left :], at + 1, 0
                        left = int(file.lengths[at]) if at < file.n_docs else 0
                        if not len(raw):
                            break
                    crc, left = zlib.crc32(raw, crc), left - len(raw) // 4
                starts = row["base"] + np.r_[0, np.cumsum(file.lengths)[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, pa.int64()) for v in (file.doc_ids, starts, file.lengths, crcs)], names=[f.split()[0] for f in _ROWS.split(", ")]
                )

    return manifest.select("file", "bytes", "base").repartition(tasks, "file").mapInArrow(run, _ROWS)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digest(spark: SparkSession, docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """The columns of the registered query; ``tokenizer`` is a file name of the public tokenizers or a path."""
    folder = shared_dir(spark, "planes")
    manifest = write_files(docs, folder, lambda: word_encoder(tokenizer if "/" in tokenizer else public_path(tokenizer)))
    manifest = materialize(manifest, shared_dir(spark, "files"))
    return read_documents(manifest, folder, max(1, manifest.count()))
