"""Toxicity by weak supervision.

Voters are words and word beginnings (a lexicon found by its lift on labelled rows) and a few fixed patterns. Each
votes or abstains on a text. A generative label model, a two-class latent model fitted by expectation-maximisation,
estimates every voter's rates on either class, anchored on the labels at hand, and from the residuals the correlations of
voters: correlated ones share their weight instead of counting twice. Its posterior labels train a linear classifier
over the votes and their density, which scores any text. A last one-dimensional fit on labelled rows that took no part
before turns the score into a probability.

Fitting uses at most ``MAX_LABELLED`` labelled rows, those with the smallest hash of their id, so what reaches the driver
(votes of that sample, ``MAX_VOTERS`` voters) is bounded. Of texts that share their smallest 3-word shingle hash, one is
kept: copies are no independent evidence. Scoring reads whole texts.

NULL and empty texts score as texts without votes. Labels that are NULL are left out; of repeated labels of an id the
largest counts. Without two classes the score is the share of label 1. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingmill.llm.common import WORD, crc32_of_id
from listingmill.session import materialize, shared_dir

MAX_LABELLED = 20_000
MAX_VOTERS = 512
#: A voter fires on so many toxic texts of the sample at least, and the lower bound of its precision is so high.
LEAST_FIRED, LEAST_PRECISION = 5, 0.8
BEGINNINGS = (3, 4, 5, 6)
CORRELATED = 0.6
#: A feature votes once for occurring, once more for occurring twice, and so on.
LEVELS = 4
THRESHOLD = 0.3
_TOKEN = re.compile(r"[^\W_]+")
#: Patterns that vote beside the lexicon.
PATTERNS = {
    "shouting": re.compile(r"[A-Z]{3,}[^a-z]{20,}"),
    "exclaiming": re.compile(r"!{2,}"),
    "masked": re.compile(r"\b[A-Za-z][*@#$%]{2,}[A-Za-z]?"),
    "addressing": re.compile(r"\b(?:you|your|du|dein|tu|ton|vous|usted)\b", re.I),
    "stretched": re.compile(r"([A-Za-z])\1{3,}"),
}


def tokens(text: str | None) -> Counter:
    return Counter(_TOKEN.findall(text.lower())) if text else Counter()


def features(word: str) -> list[str]:
    """The word and its beginnings, which end in a star."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def named(feature: str, level: int) -> str:
    """A feature that occurs ``level`` times at least."""
    return feature if level == 1 else f"{feature}\u00d7{level}"


class Votes:
    """Turns texts into votes: the sorted numbers of the voters that fire, and the measures beside them."""

    KEPT = 300_000

    def __init__(self, lexicon: list[str]):
        self.n_lexicon, self.n_voters = len(lexicon), len(lexicon) + len(PATTERNS)
        self.levels: dict[str, list[tuple[int, int]]] = {}
        for i, name in enumerate(lexicon):
            feature, _, level = name.partition("\u00d7")
            self.levels.setdefault(feature, []).append((int(level or 1), i))
        self.known: dict[str, tuple[str, ...]] = {}

    def _of(self, word: str) -> tuple[str, ...]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= self.KEPT:
                self.known.clear()
            got = self.known[word] = tuple(f for f in features(word) if f in self.levels)
        return got

    def __call__(self, text: str | None) -> tuple[list[int], float, float]:
        words = tokens(text)
        found: dict[str, int] = {}
        for word, n in words.items():
            for feature in self._of(word):
                found[feature] = found.get(feature, 0) + n
        fired = [i for feature, n in found.items() for level, i in self.levels[feature] if n >= level]
        hits = len(fired)
        fired += [self.n_lexicon + k for k, p in enumerate(PATTERNS.values()) if text and p.search(text)]
        return sorted(fired), math.log1p(hits), hits / (words.total() + 5)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def label_model(votes: np.ndarray, prior: float, lexicon: int, known: np.ndarray | None = None, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row of a 0/1 matrix; the voters' rates (2 x voters) and
    weights under correlation.

    Rates come half from the posterior and half from ``known`` labels where these are given, which keeps a voter that
    often fires alone from making its own class. The start is those labels, or whether anything of the lexicon fires. A voter
    that doesn't fire abstains and says nothing, since lexicons of different languages exclude each other; that all of them are
    silent is a voter of its own, the last one. The weight of a voter is 1 / (1 + sum of its correlations above ``CORRELATED``
    with others), taken from the residuals of votes after the classes' means.
    """
    silent = ~votes[:, :lexicon].any(1)
    votes = np.c_[votes, silent]
    n, m = votes.shape
    q = np.where(silent, 0.02 * prior, 0.9) if known is None else 0.05 + 0.9 * known
    weight = np.ones(m)
    for stage in range(2):
        for _ in range(rounds):
            belief = q if known is None else (q + known) / 2
            rate = np.stack([(side[:, None] * votes).sum(0) + 0.05 for side in (1 - belief, belief)])
            rate /= np.array([[(1 - belief).sum() + 1.0], [belief.sum() + 1.0]])
            rate = np.clip(rate, 1e-4, 1 - 1e-4)
            on = np.log(rate[1] / rate[0])
            new = _sigmoid(math.log(prior / (1 - prior)) + votes @ (on * weight))
            moved, q = np.abs(new - q).max(), new
            if moved < 1e-5:
                break
        if stage == 0:
            residual = votes - (q[:, None] * rate[1] + (1 - q)[:, None] * rate[0])
            spread = np.sqrt((residual**2).mean(0)) + 1e-9
            corr = np.abs(residual.T @ residual / n / np.outer(spread, spread))
            np.fill_diagonal(corr, 0)
            weight = 1 / (1 + np.where(corr > CORRELATED, corr, 0).sum(1))
    return q, rate, weight


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression on soft targets, the last one for the constant; Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = _sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (p - target) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    def __init__(self, votes: Votes, base: float):
        self.votes, self.base = votes, base
        self.weights: np.ndarray | None = None
        self.scale, self.shift = 1.0, 0.0
        self.rates: np.ndarray | None = None

    def raw(self, text: str | None) -> float:
        fired, hits, density = self.votes(text)
        return float(self.weights[fired].sum() + self.weights[-3] * hits + self.weights[-2] * density + self.weights[-1])

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.base
        return float(_sigmoid(np.array(self.scale * self.raw(text) + self.shift)))


def _matrix(rows: list[tuple[list[int], float, float]], voters: int) -> np.ndarray:
    x = np.zeros((len(rows), voters + 2))
    for i, (fired, hits, density) in enumerate(rows):
        x[i, fired] = 1
        x[i, -2:] = hits, density
    return x


def labelled(docs: DataFrame, labels: DataFrame, learn: Column, most: int = MAX_LABELLED) -> DataFrame:
    """text, toxic (0 or 1) and ``fit``, the bounded sample of rows to learn from, one of each group of copies."""
    rows = labels.filter(learn & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    found = found.withColumn("w", words)
    found = found.withColumn("sig", F.array_min(F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))))
    # At most ``most`` ids; repeated rows of an id share their signature.
    first = found.groupBy("sig", "toxic").agg(F.min_by(F.struct("doc_id", "text"), F.struct("doc_id", "text")).alias("d"))
    return first.select("d.text", "toxic", (F.pmod(F.xxhash64("d.doc_id"), F.lit(5)) > 0).alias("fit"))


def find_voters(sample: DataFrame, most: int = MAX_VOTERS) -> list[str]:
    """Words and beginnings by their gain on label 1, the best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            names = list(seen)
            counts = np.array([seen[f] for f in names], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts[:, 1]), pa.array(counts[:, 0])], names=["feature", "pos", "neg"])

        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                found: Counter = Counter()
                for word, n in tokens(text.as_py()).items():
                    for f in features(word):
                        found[f] += n
                for f, n in found.items():
                    for level in range(1, min(n, LEVELS) + 1):
                        seen.setdefault(named(f, level), [0, 0])[toxic > 0] += 1
                if len(seen) > 1_000_000:
                    yield out()
                    seen = {}
        if seen:
            yield out()

    total = sample.agg(F.sum((F.col("toxic") > 0).cast("long")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    if not total["p"] or total["p"] == total["n"]:
        return []
    counts = sample.select("text", "toxic").mapInArrow(run, "feature string, pos long, neg long")
    counts = counts.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter(F.col("pos") >= LEAST_FIRED)
    n, share = F.col("pos") + F.col("neg"), F.col("pos") / (F.col("pos") + F.col("neg"))
    bound = (share + 0.5 / n - F.sqrt((share * (1 - share) + 0.25 / n) / n)) / (1 + 1 / n)  # Wilson, one standard error
    lift = F.log(bound * float(total["n"]) / float(total["p"]))
    best = counts.filter((bound >= LEAST_PRECISION) & (lift > 0)).orderBy((F.col("pos") * lift).desc(), "feature").limit(most)
    return [r["feature"] for r in best.collect()]


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> Model:
    sample = materialize(labelled(docs, labels, learn), shared_dir(docs.sparkSession, "labelled"))
    lexicon = find_voters(sample.filter("fit"))
    votes = Votes(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [votes(t.as_py()) for t in batch.column("text")]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.list_(pa.int32()), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("toxic"), batch.column("fit")], names=["fired", "hits", "density", "toxic", "fit"])

    got = sample.mapInArrow(run, "fired array<int>, hits double, density double, toxic int, fit boolean").collect()  # at most MAX_LABELLED rows
    got.sort(key=lambda r: (r["fit"], r["toxic"], r["hits"], r["density"], r["fired"]))
    gold = np.array([float(r["toxic"] > 0) for r in got])
    fit = np.array([r["fit"] for r in got], bool)
    model = Model(votes, float(gold.mean()) if len(gold) else 0.0)
    if not lexicon or not 0 < gold[fit].mean() < 1:
        return model
    x = _matrix([(r["fired"], r["hits"], r["density"]) for r in got], votes.n_voters)
    posterior, model.rates, _ = label_model(x[fit, :-2], float(gold[fit].mean()), len(lexicon), gold[fit])
    model.weights = fit_linear(x[fit], posterior)
    raw = np.c_[x, np.ones(len(x))] @ model.weights
    check = ~fit if 0 < gold[~fit].sum() < (~fit).sum() else fit
    scale, shift = fit_linear(raw[check][:, None], gold[check], ridge=1e-2)
    if scale > 0:
        model.scale, model.shift = float(scale), float(shift)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = [own.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def learnable() -> Column:
    return crc32_of_id() % 4 != 2


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    rows = scored(docs, train(docs, labels, learnable()))
    return rows.select("doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that score as toxic; all columns come back as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, learnable()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            yield batch.filter(pa.array([own.score(t.as_py()) < THRESHOLD for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
