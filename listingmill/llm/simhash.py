"""SimHash near-duplicates by Golay fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. With at most four differing bits, two of the
three segments differ in at most two bits together: their errors are (0, <=2), (<=2, 0) or (1, 1). A segment's
fuzzy keys are the codeword indices of the perfect binary Golay code to which the segment or a neighbour of it
decodes: one key within distance 2 of a codeword, six otherwise. Two segments at distance 2 or less share a key,
and at distance 1 the decoding of one is among the keys of the other. So pairs of segments meet by (exact, fuzzy),
(fuzzy, exact) and (decoding, fuzzy) keys, and the distance is then counted on the whole fingerprints.

Only distinct fingerprints take part, so copies never meet one another. Members of a key are linked by a sparse
forest instead of all pairs: each found member looks for the members not yet found. A key with more than
``GROUP`` members is passed on and resolved by the points within distance 2 of each member: two fingerprints share
such a point exactly if they differ in four bits or less, so the members of a point link to its smallest.

Texts that are NULL or have no words get fingerprint zero and are linked like any other. Repeated rows keep
their rows; a NULL doc_id is never a component's id unless nothing else is in it. Extra columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from listingmill.llm import minhash
from listingmill.llm.common import raw_texts
from listingmill.operators.collapse import connected_components
from listingmill.session import materialize, shared_dir

SEED = 42
NEAR = 4
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Members of one key that a task links by comparing; larger keys are resolved by points.
GROUP = 1 << 14
#: Up to so many members are compared pair by pair, several keys at once.
PAIRED = 8
_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """Bit b is set if over half of the shingles' hashes have it."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    spaced = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in spaced), np.uint64, len(spaced))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # the unpacked bits of a long text stay small
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, width) for t in raw_texts(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parity of each 12-bit message; for each syndrome its error patterns (nearest first) and their number."""
    parity = np.zeros(4096, np.int64)
    for m in range(4096):
        r = m << 11
        for bit in range(22, 10, -1):
            if r >> bit & 1:
                r ^= _GENERATOR << (bit - 11)
        parity[m] = r
    patterns = np.zeros((2048, 6), np.int64)
    count = np.zeros(2048, np.int64)
    for weight in range(5):
        for places in combinations(range(23), weight):
            e = sum(1 << p for p in places)
            s = (e & 2047) ^ int(parity[e >> 11])
            # Distance 4 counts only beside a leader of weight 3: such a segment has neighbours that decode elsewhere.
            if count[s] == 0 or weight == 4 and bin(patterns[s, 0]).count("1") == 3:
                patterns[s, count[s]] = e
                count[s] += 1
    return parity, patterns, count


def fuzzy_keys(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) codeword indices, the segment's own decoding first, and how many of them count."""
    parity, patterns, count = _golay()
    syndrome = (segment & 2047) ^ parity[segment >> 11]
    return (segment[:, None] ^ patterns[syndrome]) >> 11, count[syndrome]


def _key_rows(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fingerprint, role) rows. Role 1 seeks, 2 is sought, 3 is both; keys hold their kind in the top bits."""
    seg = [((fps >> np.uint64(low)) & np.uint64((1 << size) - 1)).astype(np.int64) for low, size in SEGMENTS]
    fuzzy = [fuzzy_keys(s) for s in seg]
    slot = np.arange(6)
    keys, owners, roles = [], [], []

    def emit(kind: int, key: np.ndarray, owner: np.ndarray, role: int) -> None:
        keys.append(key | (kind << 40))
        owners.append(owner)
        roles.append(np.full(len(key), role, np.int8))

    everyone = np.arange(len(fps))
    for number, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        for kind, exact, near in ((3 * number, a, b), (3 * number + 1, b, a)):
            keep = slot < fuzzy[near][1][:, None]
            emit(kind, ((seg[exact][:, None] << 12) | fuzzy[near][0])[keep], np.broadcast_to(everyone[:, None], keep.shape)[keep], 3)
        (ka, na), (kb, nb) = fuzzy[a], fuzzy[b]
        emit(3 * number + 2, (ka[:, 0] << 12) | kb[:, 0], everyone, 3)  # the own pair seeks and is among the sought
        keep = (slot < na[:, None])[:, :, None] & (slot < nb[:, None])[:, None, :]
        keep[:, 0, 0] = False
        emit(3 * number + 2, ((ka[:, :, None] << 12) | kb[:, None, :])[keep], np.broadcast_to(everyone[:, None, None], keep.shape)[keep], 2)
    return np.concatenate(keys), fps[np.concatenate(owners)], np.concatenate(roles)


def _near(a: np.ndarray | np.uint64, b: np.ndarray, near: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= near


def forest(fps: np.ndarray, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the graph whose edges join distinct fingerprints at ``near`` bits or fewer.

    Members are taken from the middle outwards: the ones nearest to the bitwise majority come first. A group of copies of one
    text thus gets the same parents under each of its keys, and their links coincide.
    """
    votes = np.unpackbits(fps.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    middle = np.packbits(2 * votes > len(fps), bitorder="little").view("<u8")[0]
    left = fps[np.lexsort((fps, np.bitwise_count(fps ^ middle)))]
    a, b = [], []
    while len(left):
        queue, left = deque([left[0]]), left[1:]
        while queue and len(left):
            at = queue.popleft()
            hit = _near(at, left, near)
            if hit.any():
                found = left[hit]
                a.append(np.full(len(found), at))
                b.append(found)
                queue.extend(found)
                left = left[~hit]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _rows(schema: pa.Schema, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)


def _link_groups(key: np.ndarray, fp: np.ndarray, role: np.ndarray, near: int, group: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole key groups, sorted by key. A group over ``group`` gives (fp, fp) rows: passed on."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    member = np.repeat(sizes, sizes)
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    small = (member > 1) & (member <= PAIRED)
    k, f, r = key[small], fp[small], role[small]
    lag = 1
    while lag < PAIRED:
        same = k[lag:] == k[:-lag] if lag < len(k) else np.zeros(0, bool)
        if not same.any():
            break
        # One of the two must seek and the other be sought.
        hit = same & ((r[lag:] | r[:-lag]) == 3) & (f[lag:] != f[:-lag])
        hit &= _near(f[lag:], f[:-lag], near)
        a.append(f[:-lag][hit])
        b.append(f[lag:][hit])
        lag += 1
    for s, n in zip(starts[sizes > PAIRED], sizes[sizes > PAIRED]):
        own = np.unique(fp[s : s + n])
        x, y = (own, own) if len(own) > group else forest(own, near)
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def links(distinct: DataFrame, near: int = NEAR, group: int = GROUP) -> DataFrame:
    """(a, b) links between the distinct fingerprints ``fp``, whose components are those of all pairs at ``near`` bits or fewer."""
    spark = distinct.sparkSession

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 2048):
                key, fp, role = _key_rows(fps[at : at + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64)), pa.array(role)], names=["key", "fp", "role"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, role = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8)
        hot = None  # a key whose members are handed on as they come

        def flush(key: np.ndarray, fp: np.ndarray, role: np.ndarray) -> Iterator[pa.RecordBatch]:
            passed = key == hot if hot is not None else np.zeros(len(key), bool)
            own = np.unique(fp[passed])
            yield _rows(_LINK, own, own)
            if not passed.all():
                yield _rows(_LINK, *_link_groups(key[~passed], fp[~passed], role[~passed], near, group))

        for batch in batches:
            key = np.r_[key, batch.column("key").to_numpy(zero_copy_only=False)]
            fp = np.r_[fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)]
            role = np.r_[role, batch.column("role").to_numpy(zero_copy_only=False)]
            last = np.searchsorted(key, key[-1]) if len(key) else 0  # the last key may go on in the next batch
            if not last and len(key) > 4 * group:
                hot, last = key[0], len(key)
            if last:
                yield from flush(key[:last], fp[:last], role[:last])
                key, fp, role = key[last:], fp[last:], role[last:]
        if len(key):
            yield from flush(key, fp, role)

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = [0, *(sum(1 << p for p in c) for w in range(1, near // 2 + 1) for c in combinations(range(64), w))]
        flips = np.array(flips, np.uint64)
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 64):
                own = fps[at : at + 64]
                yield _rows(pa.schema([("p", pa.int64()), ("fp", pa.int64())]), (own[:, None] ^ flips).ravel(), np.repeat(own, len(flips)))

    keyed = distinct.select("fp").mapInArrow(explode, "key long, fp long, role byte")
    met = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long")
    met = materialize(met, shared_dir(spark, "fuzzy"))
    large = met.filter(F.col("a") == F.col("b")).select(F.col("a").alias("fp")).distinct()
    found = met.filter(F.col("a") != F.col("b"))
    if large.isEmpty():
        return found.distinct()
    near_points = large.mapInArrow(points, "p long, fp long")
    least = materialize(near_points.groupBy("p").agg(F.min("fp").alias("b")), shared_dir(spark, "points"))
    # A point's members are found again from the point: every member links to the smallest of each of its points.
    stars = near_points.join(least, "p").filter(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b").distinct()
    return found.unionByName(stars).distinct()


def components(prints: DataFrame, near: int = NEAR, group: int = GROUP) -> DataFrame:
    """doc_id, fp, component_id for every row of ``fingerprints``."""
    spark = prints.sparkSession
    prints = materialize(prints, shared_dir(spark, "fingerprints"))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), shared_dir(spark, "distinct"))
    pairs = links(distinct, near, group).select(F.col("a").alias("seq"), F.col("b").alias("hub"))
    label = connected_components(pairs).select(F.col("seq").alias("fp"), "component")
    placed = distinct.join(label, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    first = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    return prints.join(placed.join(first, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    rows = components(fingerprints(docs))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def candidates(prints: DataFrame, near: int = NEAR, group: int = GROUP) -> DataFrame:
    """(seq, hub) links between the doc_ids of ``fingerprints``, whose components are those of all pairs at ``near`` bits or fewer."""
    spark = prints.sparkSession
    prints = materialize(prints, shared_dir(spark, "fingerprints"))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), shared_dir(spark, "distinct"))
    same = prints.join(distinct, "fp").select(F.col("doc_id").alias("seq"), F.col("first").alias("hub"))
    ends = [distinct.select(F.col("fp").alias(end), F.col("first").alias(name)) for end, name in (("a", "seq"), ("b", "hub"))]
    other = links(distinct, near, group).join(ends[0], "a").join(ends[1], "b").select("seq", "hub")
    return same.unionByName(other).filter(F.col("seq") != F.col("hub"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest (id, hash of the text) stays.

    Candidates are the links of the fingerprints, found by Golay keys as in the query, and those of the bands of ``minhash``, which reach
    further than four bits. An exact check follows for both: a component holds pairs of 5-word similarity 0.8 or more.
    Rows are told apart by id and text, so other texts under the same id or under NULL stay. Rows that share both are
    ordered by their hash, the first stays. A NULL id counts as the smallest number.
    """
    least = F.lit(-(1 << 63)).cast("long")
    # The row goes along as one column, so that no name of the table meets those of the stage.
    tagged = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce("doc_id", least).alias("_id"), minhash.text_hash().alias("_th"))
    texts = tagged.select(F.col("_th").alias("th"), F.col("_row.text").alias("text"))
    prints = fingerprints(texts.withColumnRenamed("th", "doc_id")).distinct()
    label = minhash.components(texts, candidates(prints)).withColumnRenamed("th", "_th")
    first = tagged.groupBy("_th").agg(F.min("_id").alias("_id")).join(label, "_th", "left")
    rows = first.groupBy(F.coalesce("component", "_th")).agg(F.min(F.struct("_id", "_th")).alias("least")).select("least.*")
    order = W.partitionBy("_id", "_th").orderBy(F.xxhash64("_row"))
    kept = tagged.join(rows, ["_id", "_th"], "left_semi").withColumn("_n", F.row_number().over(order))
    return kept.filter(F.col("_n") == 1).select("_row.*")
