"""Ranked lexical search over per-term blocks of similar documents.

The score of a document for an item is a sum of impacts, one for each term they share, and an impact depends on term and
document alone. Terms are numbered from the rarest to the commonest, and the documents that hold a term are cut into blocks:

* documents are sketched (random signs of their impacts), sorted by the signs of the sketch and cut into segments of
  ``SEGMENT`` neighbours;
* in a segment, the list of each term is clustered: its documents go to the nearest of a few representatives of the list, and
  each cluster is cut into blocks of at most ``BLOCK`` documents;
* a block of term t stores the coordinatewise maximum of its documents' impacts, over t and all terms commoner than t.

A document counts in the block of its rarest query term, so the sum of a block's maxima over the query's terms is at least the
score of every document that counts there. A block is skipped only if this sum is below the tenth best score found so far; at a
tie it is read. Lists below ``LEAST`` documents have one block without a summary, which is always read. A list whose terms
cannot reach the threshold by the segment's maxima (the same bound over all blocks of the list) is skipped before its summaries
are looked at. So the result is exact at every parameter.

Items come in slices of bounded size (``ITEM_BYTES`` of text), and an index holds the terms of a slice only: what is broadcast
to the tasks is bounded, and a slice is one pass over the documents. A segment is bounded by its documents and by ``ENTRIES``
postings; a term in every document is a list in every segment, never a group of its own. Every task hands on at most ten rows an item.

NULL and empty texts hold no terms and are in no result, as are items without terms. Rows of ``docs`` are documents of their
own, so repeated rows and repeated ids give several ranks; NULL ids come last among equal scores. Repeated (item_id, text) rows
are one item; other texts under the same id are items of their own. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from listingmill.llm.common import raw_texts
from listingmill.session import materialize, shared_dir

TOP = 10
SEGMENT = 2048
BLOCK = 256
LEAST = 64
ENTRIES = 1 << 19
ITEM_BYTES = 4 << 20
SKETCH = 32
_SEED = 11
#: A term is a run of digits, letters A-Z in either case, and anything beyond ASCII.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split(b" ")


def _counts(text: bytes) -> Counter:
    counts = Counter(terms_of(text))
    del counts[b""]
    return counts


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges [start, end), and where each range begins among them."""
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    return np.repeat(starts - first, sizes) + np.arange(int(sizes.sum())), first


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive ranges that begin at ``first``; an empty range gives 0."""
    total = np.r_[0, np.cumsum(values)]
    return total[np.r_[first[1:], len(values)]] - total[first] if len(first) else np.zeros(0, np.int64)


# ---------------------------------------------------------------------------
# vectors


_VECTOR = pa.schema([
    ("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())),
])


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], path: str) -> DataFrame:
    """Written once: kind 0, the counts of the vocabulary's terms in each document that holds one; kind 1, sums of each task:
    ``counts`` are the documents with a term, and for each of ``terms`` the documents that hold it; ``n`` the terms of all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_docs, n_terms = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            ids, sizes, terms, counts = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text"))):
                found = _counts(text or b"")
                if not found:
                    continue
                size = found.total()
                n_docs, n_terms = n_docs + 1, n_terms + size
                own = sorted((vocabulary[t], found[t]) for t in found.keys() & vocabulary.keys())
                if own:
                    own = np.array(own, np.int64)
                    held[own[:, 0]] += 1
                    ids.append(doc_id)
                    sizes.append(size)
                    terms.append(own[:, 0])
                    counts.append(own[:, 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(ids), np.int32)), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), _lists(terms, pa.int32()), _lists(counts, pa.int64())],
                schema=_VECTOR,
            )
        some = np.flatnonzero(held)
        sums = [[1], [None], [n_terms], [some.tolist()], [[n_docs, *held[some].tolist()]]]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(sums, _VECTOR)], schema=_VECTOR)

    ddl = "kind int, doc_id long, n long, terms array<int>, counts array<long>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, ddl)
    rows.write.mode("overwrite").partitionBy("kind").parquet(path)
    return docs.sparkSession.read.schema(ddl).parquet(path)


def statistics(rows: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and documents that hold each of the ``size`` terms of the vocabulary."""
    sums = rows.filter("kind = 1")
    n_docs, n_terms = sums.agg(F.sum(F.get("counts", F.lit(0))), F.sum("n")).first()
    lists = sums.select("terms", F.expr("slice(counts, 2, size(counts) - 1)").alias("held"))
    pairs = lists.select(F.explode(F.arrays_zip("terms", "held")).alias("p"))
    held = np.zeros(size, np.int64)
    for term, n in pairs.groupBy("p.terms").agg(F.sum("p.held")).collect():  # at most a row for each term of the slice
        held[term] = n
    return n_docs or 0, n_terms or 0, held


# ---------------------------------------------------------------------------
# index


def _signs(n_terms: int) -> np.ndarray:
    return np.random.default_rng(_SEED).choice(np.array([-1, 1], np.float32), (n_terms, SKETCH))


def _sketches(starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Unit vectors of ``SKETCH`` random projections, one for each document; every document has a term."""
    flat = np.add.reduceat(impacts.astype(np.float32)[:, None] * signs[terms], starts[:-1], axis=0)
    return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-9)


_SEGMENT = {
    "doc_ids": "long", "doc_start": "int", "doc_terms": "int", "doc_impacts": "long",
    "list_terms": "int", "list_max": "long", "list_start": "int",
    "block_start": "int", "members": "int", "sum_start": "int", "sum_terms": "int", "sum_max": "long",
}
_NUMPY = {"long": np.int64, "int": np.int32}
SEGMENT_DDL = ", ".join(f"{k} array<{v}>" for k, v in _SEGMENT.items())


def _clusters(members: np.ndarray, sketch: np.ndarray, block: int) -> list[np.ndarray]:
    """The documents of one list as blocks: nearest representative, then runs of at most ``block`` from the nearest outwards."""
    if len(members) <= block:
        return [members]
    own = sketch[members]
    near = own @ own[:: max(1, block // 2)].T
    best = near.argmax(axis=1)
    order = np.lexsort((-near[np.arange(len(own)), best], best))
    edges = np.flatnonzero(np.r_[True, best[order][1:] != best[order][:-1]])
    runs = [r for cluster in np.split(members[order], edges[1:]) for r in np.split(cluster, range(block, len(cluster), block))]
    packed: list[np.ndarray] = []  # small neighbours share a block
    for run in runs:
        if packed and len(packed[-1]) + len(run) <= block:
            packed[-1] = np.r_[packed[-1], run]
        else:
            packed.append(run)
    return packed


def build_segment(doc_ids: list, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, signs: np.ndarray, block: int, least: int) -> dict:
    """The arrays of one segment. Terms ascend in each document, and their numbers from the rarest to the commonest term."""
    sketch = _sketches(starts, terms, impacts, signs)
    doc = np.repeat(np.arange(len(doc_ids)), np.diff(starts))
    order = np.argsort(terms, kind="stable")
    first = np.flatnonzero(np.r_[True, terms[order][1:] != terms[order][:-1]])
    ends = np.r_[first[1:], len(order)]
    list_terms, list_max = terms[order][first], np.maximum.reduceat(impacts[order], first)
    best = np.zeros(len(signs), np.int64)
    blocks, list_start, sum_start, sum_terms, sum_max = [], [0], [0], [], []
    for term, a, b in zip(list_terms, first, ends):
        entries = order[a:b]
        if b - a < least:
            blocks.append(doc[entries])
            sum_start.append(sum_start[-1])
        else:
            at = np.zeros(len(doc_ids), np.int64)
            at[doc[entries]] = entries  # where the term stands in its document: commoner terms follow it
            for members in _clusters(doc[entries], sketch, block):
                spans, _ = _spans(at[members], starts[members + 1])
                np.maximum.at(best, terms[spans], impacts[spans])
                some = np.flatnonzero(best)
                blocks.append(members)
                sum_terms.append(some)
                sum_max.append(best[some])
                sum_start.append(sum_start[-1] + len(some))
                best[some] = 0
        list_start.append(len(blocks))
    joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return {
        "doc_ids": doc_ids, "doc_start": starts, "doc_terms": terms, "doc_impacts": impacts, "list_terms": list_terms, "list_max": list_max,
        "list_start": list_start, "block_start": np.r_[0, np.cumsum([len(m) for m in blocks])], "members": joined(blocks),
        "sum_start": sum_start, "sum_terms": joined(sum_terms), "sum_max": joined(sum_max),
    }


def by_rarity(held: np.ndarray) -> np.ndarray:
    """The number of each term of the vocabulary: 0 is the one that the fewest documents hold."""
    number = np.empty(len(held), np.int32)
    number[np.argsort(held, kind="stable")] = np.arange(len(held), dtype=np.int32)
    return number


def build_index(rows: DataFrame, n_docs: int, n_terms: int, held: np.ndarray, path: str, segment: int = SEGMENT, block: int = BLOCK, least: int = LEAST) -> DataFrame:
    """A row for each segment, written once; its terms are numbered ``by_rarity``."""
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in held], np.int64)
    number, size = by_rarity(held), len(held)

    def impacts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = _signs(size)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, counts = batch.column("terms"), batch.column("counts").flatten().to_numpy()
            starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat, doc = lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), np.diff(starts))
            m = 10 + (90 * n_docs * batch.column("n").to_numpy()) // n_terms
            value = weights[flat] * ((1_000_000_000 * counts) // (1000 * counts + 8 * m[doc]))
            order = np.lexsort((number[flat], doc))
            flat, value = number[flat][order], value[order]
            code = (_sketches(starts, flat, value, signs)[:, :15] > 0) @ (1 << np.arange(14, -1, -1))
            lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(v)) for v in (flat, value)]
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.int32()), batch.column("doc_id"), *lists], names=["code", "doc_id", "terms", "impacts"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = _signs(size)
        ids: list = []
        sizes: list[int] = []
        terms: list[np.ndarray] = []
        values: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            starts = np.r_[0, np.cumsum(sizes)]
            made = build_segment(ids, starts, np.concatenate(terms), np.concatenate(values), signs, block, least)
            kinds = {"long": pa.int64(), "int": pa.int32()}
            cells = [pa.array([made[k] if k == "doc_ids" else np.asarray(made[k], _NUMPY[t])], pa.list_(kinds[t])) for k, t in _SEGMENT.items()]
            return pa.RecordBatch.from_arrays(cells, names=list(_SEGMENT))

        for batch in batches:
            offsets = batch.column("terms").offsets.to_numpy()
            offsets = offsets - (offsets[0] if len(offsets) else 0)
            own_terms, own_values = batch.column("terms").flatten().to_numpy(), batch.column("impacts").flatten().to_numpy()
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                a, b = int(offsets[i]), int(offsets[i + 1])
                if ids and (len(ids) == segment or sum(sizes) + b - a > ENTRIES):
                    yield flush()
                    ids, sizes, terms, values = [], [], [], []
                ids.append(doc_id)
                sizes.append(b - a)
                terms.append(own_terms[a:b])
                values.append(own_values[a:b])
        if ids:
            yield flush()

    spark = rows.sparkSession
    weighed = rows.filter("kind = 0").mapInArrow(impacts, "code int, doc_id long, terms array<int>, impacts array<long>")
    most = -(-n_docs // segment)
    parts = max(1, min(most, max(int(spark.conf.get("spark.sql.shuffle.partitions")), most // 64)))
    spread = F.xxhash64("doc_id", "impacts")  # splits a code that many documents share
    near = weighed.withColumn("spread", spread).repartitionByRange(parts, "code", "spread").sortWithinPartitions("code", "spread")
    return materialize(near.select("doc_id", "terms", "impacts").mapInArrow(build, SEGMENT_DDL), path)


# ---------------------------------------------------------------------------
# search


class Best:
    """The best ``top`` (score, id) of one item, higher scores first, then smaller ids, NULL ids last."""

    def __init__(self, top: int):
        self.top = top
        self.scores, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def threshold(self) -> int:
        """A lower score can't enter any more."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = scores >= self.threshold
        if good.any():
            s, i, n = np.r_[self.scores, scores[good]], np.r_[self.ids, ids[good]], np.r_[self.null, null[good]]
            order = np.lexsort((i, n, -s))[: self.top]
            self.scores, self.ids, self.null = s[order], i[order], n[order]


class Segment:
    """One row of the index, searched for one item after another."""

    def __init__(self, cells: dict[str, pa.Array], size: int):
        self.null = cells["doc_ids"].is_null().to_numpy(zero_copy_only=False)
        self.ids = cells["doc_ids"].fill_null(0).to_numpy()
        for name in _SEGMENT:
            if name != "doc_ids":
                setattr(self, name, cells[name].to_numpy())
        self.wanted = np.zeros(size, bool)
        self.read = self.skipped = 0

    def _score(self, docs: np.ndarray, best: Best, seen: np.ndarray) -> None:
        docs = np.unique(docs)
        docs = docs[~seen[docs]]
        if len(docs):
            seen[docs] = True
            spans, first = _spans(self.doc_start[docs], self.doc_start[docs + 1])
            best.add(_sums(np.where(self.wanted[self.doc_terms[spans]], self.doc_impacts[spans], 0), first), self.ids[docs], self.null[docs])

    def search(self, query: np.ndarray, best: Best) -> None:
        """``query``: ascending term numbers."""
        at = np.searchsorted(self.list_terms, query)
        at = at[self.list_terms[np.minimum(at, len(self.list_terms) - 1)] == query]
        reach = np.cumsum(self.list_max[at][::-1])[::-1]  # of a document whose rarest query term has this list
        live = at[reach >= best.threshold]
        self.skipped += int((self.list_start[at + 1] - self.list_start[at]).sum() - (self.list_start[live + 1] - self.list_start[live]).sum())
        if not len(live):
            return
        self.wanted[query] = True
        seen = np.zeros(len(self.ids), bool)
        blocks, _ = _spans(self.list_start[live], self.list_start[live + 1])
        summed = self.sum_start[blocks + 1] > self.sum_start[blocks]
        self._read(blocks[~summed], best, seen)
        blocks = blocks[summed]
        spans, first = _spans(self.sum_start[blocks], self.sum_start[blocks + 1])
        bound = _sums(np.where(self.wanted[self.sum_terms[spans]], self.sum_max[spans], 0), first)
        order = np.argsort(-bound, kind="stable")
        blocks, bound, done, step = blocks[order], bound[order], 0, 1
        while done < len(blocks) and bound[done] >= best.threshold:
            some = slice(done, done + step)
            self._read(blocks[some][bound[some] >= best.threshold], best, seen)
            done, step = done + step, 2 * step
        self.skipped += max(0, len(blocks) - done)
        self.wanted[query] = False

    def _read(self, blocks: np.ndarray, best: Best, seen: np.ndarray) -> None:
        self.read += len(blocks)
        spans, _ = _spans(self.block_start[blocks], self.block_start[blocks + 1])
        self._score(self.members[spans], best, seen)


def search_index(index: DataFrame, items: list[tuple[int | None, np.ndarray]], size: int, top: int = TOP) -> DataFrame:
    """item, doc_id, score: of every item (a place in ``items``) the best documents of each task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in items]
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment({k: batch.column(k)[row].values for k in _SEGMENT}, size)
                for (_, query), own in zip(items, best):
                    segment.search(query, own)
        item = np.repeat(np.arange(len(items)), [len(b.scores) for b in best])
        join = lambda what, kind: np.concatenate([np.zeros(0, kind), *[getattr(b, what) for b in best]])
        ids = pa.array(join("ids", np.int64), mask=join("null", bool))
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids, pa.array(join("scores", np.int64))], names=["item", "doc_id", "score"])

    return index.mapInArrow(search, "item int, doc_id long, score long")


def _slices(items: DataFrame, item_bytes: int) -> tuple[DataFrame, int]:
    """Distinct items, dealt into slices of at most about ``item_bytes`` of text; a longer item is a slice of its own or shares one."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    rows = materialize(rows, shared_dir(items.sparkSession, "items"))
    total, count = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    n = max(1, -(-(total or 0) // item_bytes))
    while True:
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("text", "item_id"), F.lit(n)))
        most = dealt.groupBy("part").agg(F.sum(F.octet_length("text")).alias("b")).agg(F.max("b")).first()[0] or 0
        if most <= 2 * item_bytes or n >= 4 * max(1, count):
            return dealt, n
        n *= 2


def search(docs: DataFrame, items: DataFrame, top: int = TOP, item_bytes: int = ITEM_BYTES, segment: int = SEGMENT, block: int = BLOCK, least: int = LEAST) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of every item with a score above 0."""
    spark = docs.sparkSession
    dealt, n = _slices(items, item_bytes)
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in range(n):
        own = [(i, sorted(_counts((t or "").encode()))) for i, t in dealt.filter(F.col("part") == part).select("item_id", "text").collect()]
        own = [(i, terms) for i, terms in own if terms]
        names = sorted({t for _, terms in own for t in terms})
        if not names:
            continue
        root = shared_dir(spark, "lexical")
        rows = vectors(docs, {t: k for k, t in enumerate(names)}, f"{root}/vectors")
        n_docs, n_terms, held = statistics(rows, len(names))
        if not held.any():
            continue
        index = build_index(rows, n_docs, n_terms, held, f"{root}/index", segment, block, least)
        place = {t: k for t, k, n in zip(names, by_rarity(held), held) if n}
        queries = [(i, np.array(sorted(place[t] for t in terms if t in place), np.int64)) for i, terms in own]
        hits = search_index(index, queries, len(names), top)
        order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(queries)], "item int, item_id long")
        ranked = materialize(ranked.join(ids, "item").select("item_id", "rank", "doc_id", "score"), f"{root}/ranked")
        found = found.unionByName(ranked)
    return found


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return search(docs, items)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
f AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, w FROM d WHERE len(w) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM f),
tf AS (SELECT r, doc_id, n, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS t FROM f) GROUP BY ALL),
df AS (SELECT t, CAST(count(*) AS BIGINT) AS df FROM tf GROUP BY t),
imp AS (SELECT r, doc_id, t, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))) AS v
  FROM tf JOIN df USING (t), s),
b AS (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT k, item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS t
  FROM (SELECT row_number() OVER () AS k, * FROM b)),
sc AS (SELECT k, item_id, r, doc_id, CAST(sum(v) AS BIGINT) AS score FROM q JOIN imp USING (t) GROUP BY ALL HAVING sum(v) > 0),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM sc)
SELECT * FROM ranked WHERE rank <= 10
"""
