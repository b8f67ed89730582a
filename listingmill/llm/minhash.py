"""Near-duplicates by the Jaccard similarity of word shingles: candidates by MinHash bands, each then compared exactly.

A text's set holds the hashes of its 5-word shingles (lower case, split at white space; a shorter text is one shingle).
``BANDS`` keys of ``ROWS`` minima each make candidates: two texts of similarity s share a key with probability
1 - (1 - s ** ROWS) ** BANDS, so of pairs at 0.8 three in a million meet under no key, and fewer above. Texts of one key are
linked to its smallest, components of these links are the groups to look at, and within a group every pair counts: links
are a spanning forest of the pairs whose exact similarity is ``LEAST`` or more. Nothing else makes a link.

What grows: every distinct text gives ``BANDS`` rows of 16 bytes; sets are made again for texts that share a key only. A group
above ``SLICE`` texts is dealt into slices, and each two slices meet in a task of their own: a text is in ``PARTS`` - 1 tasks,
in more only above ``PARTS`` * ``BLOCK`` texts of one group, where tasks would otherwise outgrow their memory.

Texts are told apart by a 64-bit hash. NULL texts and texts without a word are copies of one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingmill.llm.common import raw_texts
from listingmill.operators.collapse import connected_components
from listingmill.session import materialize, shared_dir

WIDTH = 5
#: Least similarity, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 32, 5
SLICE, PARTS, BLOCK = 256, 16, 2048
_rng = np.random.default_rng(42)
_ODD = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2)
_PLACE = _rng.integers(0, 1 << 63, max(WIDTH, ROWS) + 1, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: bytes | None) -> np.ndarray:
    """The set of shingle hashes, sorted; that of a text without words has one hash as well."""
    words = text.lower().split() if text else []
    own = np.fromiter(map(xxhash.xxh64_intdigest, words or (b"",)), np.uint64, max(1, len(words)))
    width = min(WIDTH, len(own))
    total = np.full(len(own) - width + 1, width, np.uint64) * _PLACE[-1]  # texts of other lengths have other shingles
    for k in range(width):
        total += own[k : len(own) - width + 1 + k] * _PLACE[k]
    return np.unique(_mixed(total))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of a set."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, ((hashes[None, at : at + (1 << 12)] ^ _XOR[:, None]) * _ODD[:, None]).min(1))
    rows = _mixed(least).reshape(BANDS, ROWS)
    return _mixed((rows * _PLACE[:ROWS]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _PLACE[-1])


def similar(sets: list[np.ndarray], least: tuple[int, int] = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of a spanning forest of the graph whose edges join sets of similarity ``least`` or more."""
    sizes = np.array([len(s) for s in sets])
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.r_[0, np.cumsum(sizes)]
    own_codes = [code[s:e] for s, e in zip(starts[:-1], starts[1:])]
    owner = np.repeat(np.arange(len(sets)), sizes)
    alive, marked = np.ones(len(sets), bool), np.zeros(len(values), bool)
    held = len(sets)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first in range(len(sets)):
        if not alive[first]:
            continue
        alive[first] = False
        queue = [first]
        while queue and alive.any():
            at = queue.pop()
            if 2 * alive.sum() < held:  # found ones are compared no more
                keep = alive[owner]
                code, owner, held = code[keep], owner[keep], int(alive.sum())
            marked[own_codes[at]] = True
            common = np.bincount(owner[marked[code]], minlength=len(sets))
            marked[own_codes[at]] = False
            found = np.flatnonzero(alive & (least[1] * common >= least[0] * (sizes[at] + sizes - common)))
            alive[found] = False
            queue.extend(found.tolist())
            a.append(np.full(len(found), at))
            b.append(found)
    return np.concatenate(a), np.concatenate(b)


def text_hash(text: Column | str = "text") -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def contracted(links: DataFrame) -> DataFrame:
    """Links with the same components, about one a text: each text to its least hub, and its other hubs to that one.

    A text has a hub for each of its keys, so the links of a large group are many times its texts; the links between hubs
    coincide from text to text. The list of a text is no longer than its keys.
    """
    hubs = links.groupBy("seq").agg(F.array_sort(F.collect_set("hub")).alias("hubs"))
    least = F.get("hubs", F.lit(0))
    return hubs.select(F.explode(F.concat(F.array(F.col("seq")), F.slice("hubs", 2, F.size("hubs")))).alias("seq"), least.alias("hub")).distinct()


def _candidates(distinct: DataFrame) -> DataFrame:
    """(seq, hub): texts that share a key with the smallest text of it."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = hub = None
        for batch in batches:
            key, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "th"))
            if not len(key):
                continue
            starts = np.flatnonzero(np.r_[last is None or key[0] != last, key[1:] != key[:-1]])
            hubs = th[starts]
            if not len(starts) or starts[0]:  # the key of the last batch goes on
                starts, hubs = np.r_[0, starts], np.r_[hub, hubs]
            hubs_of = np.repeat(hubs, np.diff(np.r_[starts, len(key)]))
            last, hub = key[-1], hubs_of[-1]
            linked = hubs_of != th
            yield pa.RecordBatch.from_arrays([pa.array(th[linked]), pa.array(hubs_of[linked])], names=["seq", "hub"])

    keyed = distinct.select("th", F.explode("keys").alias("key")).repartition("key").sortWithinPartitions("key", "th")
    return contracted(keyed.mapInArrow(meet, "seq long, hub long"))


def _verified(texts: DataFrame) -> DataFrame:
    """(seq, hub) links of exact similarity within the groups ``component`` of (th, text, component)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([shingles(t).tobytes() for t in raw_texts(batch.column("text"))], pa.binary())
            columns = [batch.column("th"), batch.column("component"), batch.column("parts"), own]
            yield pa.RecordBatch.from_arrays(columns, names=["th", "component", "parts", "hashes"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, names, held = None, [], []

        def flush() -> pa.RecordBatch:
            a, b = similar(held) if len(held) > 1 else (np.zeros(0, np.int64),) * 2
            own = np.array(names, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(own[b])], names=["seq", "hub"])

        for batch in batches:
            for group in zip(*(batch.column(c).to_pylist() for c in ("component", "x", "y", "th", "hashes"))):
                if group[:3] != last:
                    if len(held) > 1:
                        yield flush()
                    last, names, held = group[:3], [], []
                names.append(group[3])
                held.append(np.frombuffer(group[4], np.uint64))
        if len(held) > 1:
            yield flush()

    made = texts.mapInArrow(sets, "th long, component long, parts int, hashes binary")
    own = F.pmod(F.xxhash64("th"), F.col("parts")).cast("int")
    other = F.expr("IF(parts = 1, array(0), filter(sequence(0, parts - 1), p -> p <> own))")
    dealt = made.withColumn("own", own).withColumn("other", F.explode(other))
    dealt = dealt.select("component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "th", "hashes")
    keys = ["component", "x", "y"]
    return contracted(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(meet, "seq long, hub long"))


def components(docs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(th, component) of every distinct text that is similar to another one, from ``th`` and ``text``.

    ``more``: candidates (seq, hub) found by other means; like those of the bands they are compared exactly.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [band_keys(shingles(t)).view(np.int64) for t in raw_texts(batch.column("text"))]
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("th"), lists], names=["th", "keys"])

    prints = docs.select("th", "text").mapInArrow(run, "th long, keys array<long>")
    distinct = materialize(prints.groupBy("th").agg(F.first("keys").alias("keys")), shared_dir(spark, "bands"))
    candidates = _candidates(distinct) if more is None else _candidates(distinct).unionByName(more)
    groups = connected_components(candidates).select(F.col("seq").alias("th"), "component")
    n = F.col("n")
    parts = F.when(n <= SLICE, 1).otherwise(F.greatest(F.lit(PARTS), F.ceil(n / BLOCK))).cast("int")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")).select("component", parts.alias("parts"))
    members = groups.join(sizes, "component")
    texts = docs.select("th", "text").dropDuplicates(["th"]).join(members, "th").select("th", "text", "component", "parts")
    return connected_components(_verified(texts)).select(F.col("seq").alias("th"), "component")
