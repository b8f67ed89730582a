"""Language identification by interpolated Kneser-Ney character models.

For each language, character 4-grams are counted over the whole training set; Spark derives the continuation counts
of the shorter ones and smooths by interpolated Kneser-Ney: absolute discounting at the highest order, continuation
counts below it, a uniform floor at the end. A model is sorted arrays of n-grams with, for each language that has it, the
discounted probability and the weight that a context hands down to the next shorter one, so a lookup serves all
languages. A text's language is the one with the lowest cross-entropy per character.

Rejection is calibrated on a tenth of the training rows, which the counts leave out: a temperature turns differences of
entropy into a probability (the one with the least log loss), and a text is accepted if its entropy is not above the
``1 - REJECT`` quantile of the rightly named ones. ``accepted`` tells; ``lang_pred`` is given in any case.

Sizes: counts are summed within batches before they are shuffled. An n-gram is a number of 16 bits a character
(characters beyond 16 bits are folded) and a key by itself: no two share an entry. So the model that goes to the driver and the
tasks grows with the distinct n-grams of each language, by 16 bytes
an n-gram and 8 for each language that has it. Texts are scored whole, in pieces.

NULL texts and texts without a letter are ``und`` with score 0. Training rows need a language; without any, every
text is ``und``. Repeated rows count as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingmill.llm.common import crc32_of_id
from listingmill.session import materialize, shared_dir

ORDER = 4
DISCOUNT = 0.75
REJECT = 0.01
#: Characters that are worked on at once.
PIECE = 1 << 18
TEMPERATURES = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0)
UNKNOWN = "und"
_BITS = 16


def grams(text: str) -> np.ndarray:
    """Every 4-gram of the text as a number: lower case, white space runs as one space, three spaces before and one behind."""
    points = np.frombuffer(("   " + " ".join(text.lower().split()) + " ").encode("utf-32-le"), np.uint32).astype(np.int64)
    points = (points & 0xFFFF) ^ (points >> _BITS)
    n = len(points) - ORDER + 1
    out = points[:n].copy()
    for k in range(1, ORDER):
        out = (out << _BITS) | points[k : k + n]
    return out


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(lang: str, held: list[np.ndarray]) -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(values), pa.array(n)], names=["lang", "gram", "n"])

        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                lang = lang.as_py()
                held.setdefault(lang, []).append(grams(text.as_py()))
                size[lang] = size.get(lang, 0) + len(held[lang][-1])
                if size[lang] >= 4 * PIECE:
                    yield counted(lang, held.pop(lang))
                    size[lang] = 0
        for lang, rest in held.items():
            yield counted(lang, rest)

    rows = docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def smoothed(counts: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """kind (g: gram, c: context), width, lang, gram, value: discounted probabilities and handed-down weights of all orders."""
    out = None
    rows = counts
    for width in range(ORDER, 0, -1):
        context = F.shiftrightunsigned("gram", _BITS)
        totals = rows.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
        own = rows.withColumn("context", context).join(totals, ["lang", "context"])
        probability = (F.col("n") - discount) / F.col("total")
        part = own.select(F.lit("g").alias("kind"), F.lit(width).alias("width"), "lang", "gram", probability.alias("value")).unionByName(
            totals.select(
                F.lit("c").alias("kind"), F.lit(width).alias("width"), "lang", F.col("context").alias("gram"), (discount * F.col("types") / F.col("total")).alias("value")
            )
        )
        out = part if out is None else out.unionByName(part)
        # The count of a shorter gram is the number of different grams that end in it.
        rows = rows.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << _BITS * (width - 1)) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    return out


class Model:
    """Of each table the sorted n-grams, where the entries of each begin, and the entries' languages and values."""

    def __init__(self, langs: list[str], tables: dict[tuple[str, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], alphabet: int):
        self.langs, self.tables = langs, tables
        self.floor = 1.0 / max(alphabet, 1)
        self.temperature, self.limit = 1.0, float("inf")

    @classmethod
    def build(cls, rows: DataFrame, langs: list[str]) -> Model:
        got = rows.select("kind", "width", "gram", "lang", F.col("value").cast("float").alias("value")).toArrow()
        kind, lang = (got[c].combine_chunks().dictionary_encode() for c in ("kind", "lang"))
        width, gram, value = (got[c].to_numpy() for c in ("width", "gram", "value"))
        column = np.array([langs.index(x) for x in lang.dictionary.to_pylist()], np.int32)[lang.indices.to_numpy()]
        kinds = np.array(kind.dictionary.to_pylist(), dtype="U1")[kind.indices.to_numpy()]
        tables = {}
        for k in "gc":
            for w in range(1, ORDER + 1):
                at = np.flatnonzero((kinds == k) & (width == w))
                at = at[np.argsort(gram[at], kind="stable")]
                keys, first = np.unique(gram[at], return_index=True)
                tables[k, w] = keys, np.r_[first, len(at)], column[at], value[at]
        return cls(langs, tables, len(tables["g", 1][0]) + 1)

    def _look(self, kind: str, width: int, gram: np.ndarray) -> np.ndarray:
        keys, first, langs, values = self.tables[kind, width]
        out = np.full((len(gram), len(self.langs)), 0.0 if kind == "g" else 1.0, np.float32)
        at = np.searchsorted(keys, gram)
        known = at < len(keys)
        known[known] = keys[at[known]] == gram[known]
        start = first[at[known]]
        n = first[at[known] + 1] - start
        entry = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        out[np.repeat(np.flatnonzero(known), n), langs[entry]] = values[entry]
        return out

    def log_probabilities(self, gram: np.ndarray) -> np.ndarray:
        """ln p(last character | the ones before it), a column for each language."""
        p = np.full((len(gram), len(self.langs)), self.floor, np.float32)
        for width in range(1, ORDER + 1):
            own = gram if width == ORDER else gram & ((1 << _BITS * width) - 1)
            context = (own >> _BITS) & ((1 << _BITS * (width - 1)) - 1)
            p = self._look("g", width, own) + self._look("c", width, context) * p
        return np.log(p)

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Nats per character, a row for each text and a column for each language."""
        total, length = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        held: list[tuple[int, np.ndarray]] = []

        def settle() -> None:
            flat = np.concatenate([g for _, g in held])
            values, where = np.unique(flat, return_inverse=True)
            logs = self.log_probabilities(values)[where]
            sizes = np.array([len(g) for _, g in held])
            sums = np.add.reduceat(logs, np.r_[0, np.cumsum(sizes)[:-1]], axis=0, dtype=np.float64)
            rows = np.array([i for i, _ in held])
            np.add.at(total, rows, -sums)
            np.add.at(length, rows, sizes)
            held.clear()

        waiting = 0
        for i, text in enumerate(texts):
            every = grams(text)
            for at in range(0, len(every), PIECE):
                held.append((i, every[at : at + PIECE]))
                waiting += len(held[-1][1])
                if waiting >= PIECE:
                    settle()
                    waiting = 0
        if held:
            settle()
        return total / np.maximum(length, 1)[:, None]


def _softmax(entropy: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp(-(entropy - entropy.min(1, keepdims=True)) / temperature)
    return e / e.sum(1, keepdims=True)


def _calibrate(model: Model, rows: DataFrame, reject: float) -> None:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            keep = [i for i, x in enumerate(langs) if x in own.langs]
            if not keep:
                continue
            entropy = own.entropies([texts[i] for i in keep])
            true = np.array([own.langs.index(langs[i]) for i in keep])
            at = np.arange(len(keep))
            loss = [-np.log(np.maximum(_softmax(entropy, t)[at, true], 1e-12)) for t in TEMPERATURES]
            best = np.where(entropy.argmin(1) == true, entropy.min(1), np.nan)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x) for x in loss), pa.array(best, from_pandas=True)], names=[*(f"t{k}" for k in range(len(TEMPERATURES))), "entropy"]
            )

    ddl = ", ".join([*(f"t{k} double" for k in range(len(TEMPERATURES))), "entropy double"])
    found = rows.select("text", "lang").mapInArrow(run, ddl)
    sums = [F.sum(f"t{k}").alias(f"t{k}") for k in range(len(TEMPERATURES))]
    row = found.agg(*sums, F.percentile_approx("entropy", 1 - reject, 10_000).alias("limit")).first()
    if row["t0"] is not None:
        model.temperature = TEMPERATURES[int(np.argmin([row[f"t{k}"] for k in range(len(TEMPERATURES))]))]
    if row["limit"] is not None:
        model.limit = row["limit"]
    shared.unpersist()


def train(rows: DataFrame, fold: Column, reject: float = REJECT) -> Model:
    """A model of the rows' ``text`` and ``lang``; rows where ``fold`` holds calibrate it and count nowhere."""
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = materialize(count_grams(rows.filter(~fold)), shared_dir(rows.sparkSession, "grams"))
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())  # names of languages
    model = Model.build(smoothed(counts), langs)
    if langs:
        _calibrate(model, rows.filter(fold), reject)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, entropy (nats per character) and accepted for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "lang_pred", "score", "entropy", "accepted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = len(texts)
            lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
            entropy, accepted = np.full(n, np.nan), np.zeros(n, bool)
            at = np.flatnonzero(batch.column("letters").to_numpy(zero_copy_only=False)) if own.langs else np.zeros(0, int)
            if len(at):
                found = own.entropies([texts[i] for i in at])
                best = found.argmin(1)
                lang[at] = np.array(own.langs, object)[best]
                score[at] = np.clip(_softmax(found, own.temperature)[np.arange(len(at)), best], 0, 1)
                entropy[at] = found.min(1)
                accepted[at] = entropy[at] <= own.limit
            columns = [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(accepted)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, entropy double, accepted boolean")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the registered query: learnt from two thirds of the documents, predicted for all."""
    fold = F.floor(crc32_of_id() / 3) % 10 == 0
    model = train(docs.filter(crc32_of_id() % 3 != 1), fold)
    held_out = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1).alias("held_out")
    return identify(docs, model).select("doc_id", held_out, "lang_pred", "score", "entropy", "accepted")
