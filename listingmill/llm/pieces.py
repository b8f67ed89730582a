"""SentencePiece encoding by streaming Viterbi, and decoding.

Encoding maximises the sum of piece scores, read from a model file. The text goes through a window: at each character
the best score so far and its backpointer are kept, only as far back as the longest piece reaches. Whenever all
backpointer paths that can still win agree on a boundary, the ids before it are final and are given out, so the window
stays short however long the text is. No piece has a space mark behind another character, so a boundary before a space mark is always
such a meeting point, as are both sides of a line end and the
place between a letter and most marks; runs between such points are kept in a dictionary of bounded size.

As in the format's reference behaviour: spaces are the mark U+2581, one is put in front, a character without a piece
becomes its UTF-8 bytes, and no other normalisation takes place. Scores are those of the file for any kind of model, so
for a merge model the result is its best-scoring segmentation, not its merge order. Decoding joins the pieces, turns
marks into spaces and drops the one in front: it gives back the text, where U+2581 itself comes back as a space.

NULL texts have no ids and stay NULL, empty texts have none either. Every row is independent of the others, so
repeated rows repeat and extra columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
LATIN = "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
#: A character without a piece costs this much more than the lowest score.
UNKNOWN_COST = 10.0
KEPT_RUNS, LONGEST_RUN = 600_000, 64


class Runs(dict):
    """The ids of runs, found when first asked for; of bounded size, and without long runs."""

    def __init__(self, find: Callable[[str], bytes]):
        self.find = find

    def __missing__(self, run: str) -> bytes:
        got = self.find(run)
        if len(run) <= LONGEST_RUN:
            if len(self) >= KEPT_RUNS:
                self.clear()
            self[run] = got
        return got


class Pieces:
    """A vocabulary with scores: encoding and decoding of single texts."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        """``kinds``: n (ordinary), b (byte), u (unknown), c (control or unused)."""
        self.id_of = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "n"}
        self.score = {p: scores[i] for p, i in self.id_of.items()}
        self.longest = max(map(len, self.id_of), default=1)
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "b"}
        self.unknown = next((i for i, k in enumerate(kinds) if k == "u"), 0)
        self.penalty = min(self.score.values(), default=0.0) - UNKNOWN_COST
        self.prefixes = {p[:n] for p in self.id_of for n in range(1, len(p) + 1)}
        self.bytes_of = [b"" if k == "c" else bytes([int(p[3:5], 16)]) if k == "b" else p.replace(MARK, " ").encode() for p, k in zip(pieces, kinds)]
        if kinds and self.unknown < len(kinds) and kinds[self.unknown] == "u":
            self.bytes_of[self.unknown] = " ⁇ ".encode()
        inner = any(b == MARK and a != MARK for p in self.id_of for a, b in zip(p, p[1:]))
        # Line ends and tabs that no piece holds stand alone on every path, so paths also meet on both of their sides.
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in self.id_of))
        parts = f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|[{alone}]" if alone else "")
        # The same holds between a letter and a mark that follow each other in no piece.
        behind = {b for p in self.id_of for a, b in zip(p, p[1:]) if a.isascii() and a.isalpha() or a in LATIN}
        marks = "".join(re.escape(c) for c in string.punctuation if c not in behind)
        if marks:
            parts = f"{MARK}*[A-Za-z{LATIN}]++(?=[{marks}])|{parts}"
        self.runs = re.compile(parts if not inner else r"(?s).+")
        self.known = Runs(self._ids)
        # Pieces as bytes, then those without a space in front, for the first piece of a text.
        bare = [b.removeprefix(b" ") for b in self.bytes_of]
        self.table = pa.array([*self.bytes_of, *bare], pa.large_binary())
        self.silent = np.array([not b for b in self.bytes_of], bool)

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        kind = lambda i: "b" if sp.is_byte(i) else "u" if sp.is_unknown(i) else "c" if sp.is_control(i) or sp.is_unused(i) else "n"
        return cls([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], [kind(i) for i in range(n)])

    def stream(self, text: str) -> Iterator[str]:
        """The pieces of the best segmentation, given out as they become final.

        ``best[i - base]`` is the best score that ends at character i and ``back`` the start of its last piece. No piece reaches
        further than ``longest``, so the surviving paths are those of the next ``longest`` ends. Whether they agree on a boundary is
        looked up each time the window has grown by some pieces' lengths.
        """
        none, n, longest = float("-inf"), len(text), self.longest
        scores, prefixes, penalty = self.score, self.prefixes, self.penalty
        base, limit = 0, 8 * longest
        best, back = [0.0] + [none] * longest, [-1] * (longest + 1)
        for i in range(n):
            at = i - base
            here = best[at]
            best.append(none)
            back.append(-1)
            if here > none:
                size, top = 1, min(longest, n - i)
                while size <= top:
                    piece = text[i : i + size]
                    score = scores.get(piece)
                    if score is None:
                        if size == 1:
                            score = penalty
                        elif piece not in prefixes:
                            break
                    if score is not None and here + score > best[at + size]:
                        best[at + size], back[at + size] = here + score, i
                    if size == 1 and piece not in prefixes:
                        break
                    size += 1
            if at >= limit:
                meet = self._meeting(back, base, [e for e in range(i + 1, i + 1 + longest) if best[e - base] > none])
                if meet > base:
                    yield from self._path(text, back, base, meet)
                    best, back, base = best[meet - base :], back[meet - base :], meet
                limit = max(8 * longest, 2 * (i - base))
        if n > base:
            yield from self._path(text, back, base, n)

    @staticmethod
    def _meeting(back: list[int], base: int, live: list[int]) -> int:
        """The last boundary on the paths to all of ``live``."""
        at = set(live)
        while len(at) > 1:
            last = max(at)
            at.remove(last)
            at.add(max(back[last - base], base))
        return at.pop() if at else base

    @staticmethod
    def _path(text: str, back: list[int], base: int, end: int) -> list[str]:
        out = []
        while end > base:
            start = back[end - base]
            out.append(text[start:end])
            end = start
        return out[::-1]

    def _ids(self, run: str) -> bytes:
        out: list[int] = []
        for piece in self.stream(run):
            own = self.id_of.get(piece)
            if own is not None:
                out.append(own)
            elif self.byte_id:
                out += [self.byte_id[b] for b in piece.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, "<i4").tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        runs = self.runs.findall(MARK + text.replace(" ", MARK))
        return np.frombuffer(b"".join(map(self.known.__getitem__, runs)), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "replace").removeprefix(" ")

    def decode_all(self, lists: pa.ListArray) -> pa.Array:
        """The texts of a column of ids: pieces are gathered by Arrow, and their bytes cut at the ends of the texts."""
        starts = lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int32)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        firsts = starts[:-1][starts[1:] > starts[:-1]]
        if len(starts) - 1 != len(lists) or lists.flatten().null_count or self.silent[flat[firsts]].any():
            return self._decode_each(lists)  # a first piece without bytes: the space may stand in the next
        flat[firsts] += len(self.bytes_of)
        gathered = self.table.take(pa.array(flat))
        ends = np.frombuffer(gathered.buffers()[1], np.int64, len(flat) + 1) if len(flat) else np.zeros(1, np.int64)
        data = gathered.buffers()[2] or pa.py_buffer(b"")
        texts = pa.Array.from_buffers(pa.large_string(), len(lists), [None, pa.py_buffer(ends[starts].tobytes()), data])
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:  # bytes that are no text
            return self._decode_each(lists)
        return pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), texts.cast(pa.string()))

    def _decode_each(self, lists: pa.ListArray) -> pa.Array:
        return pa.array([None if x.as_py() is None else self.decode(x.values.to_numpy(zero_copy_only=False)) for x in lists], pa.string())


@lru_cache(maxsize=1)
def loaded(path: str) -> Pieces:
    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    return Pieces.load(path)


def _encoded(part: pa.RecordBatch, pieces: Pieces) -> pa.ListArray:
    ids = [pieces.encode(t.as_py()) for t in part.column("text")]
    offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int32), *ids])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Every row of ``docs`` with ``ids``: array<int>, empty for NULL and empty texts.

    Columns named ``ids`` in the input are replaced. The model file is read on every executor, once for each worker.
    """
    kept = docs.drop("ids")
    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, _encoded(part, pieces)], names=[*part.schema.names, "ids"])

    return kept.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Every row with ``ids`` turned into ``decoded``; the other columns stay."""
    kept = rows.drop("decoded")
    schema = T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, pieces.decode_all(part.column("ids"))], names=[*part.schema.names, "decoded"])

    return kept.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """``docs`` with ``ids``, ``decoded`` and ``exact``: what is decoded is the text, U+2581 read as a space.

    Both ways in one pass: two would hold two workers for each core at once, each with the vocabulary.
    """
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(" "))
    kept = docs.drop("ids", "decoded")
    made = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = _encoded(part, pieces)
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pieces.decode_all(ids)], names=[*part.schema.names, "ids", "decoded"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *made])).withColumn("exact", F.col("decoded") == plain)


def digest(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """The columns of the registered query."""
    rows = round_trip(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "decoded", "exact")
