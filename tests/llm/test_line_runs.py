import hashlib
import random

import pytest
from pyspark.sql import functions as F

from listingmill.llm import line_runs
from listingmill.session import shared_dir

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(docs, least=5):
    holders = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(float("-inf") if i is None else i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        here = float("-inf") if i is None else i
        kept = [x for x in lines if not (len(h := holders.get(key(x), ())) >= least and here < max(h))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=4):
    rng = random.Random(seed)
    common = [f"{c} common line of more than forty characters, number {k}" for k, c in enumerate("ABCDEÉxyz")]
    vary = lambda x: rng.choice(("", " ", "\t")) + rng.choice((x, x.upper() if x.isascii() else x, x)) + rng.choice(("", "  ", "\r"))
    docs = []
    for i in range(300):
        lines = [rng.choice((vary(rng.choice(common)), f"own line of document {i} that is quite long too, {rng.random()}", "short", "")) for _ in range(rng.randint(0, 12))]
        docs.append((rng.randint(0, 10**6), "\n".join(lines)))
    hot = "the line that a third of all documents hold, word for word"
    docs += [(10**7 + k, f"{hot}\nmore {k}") for k in range(150)]
    docs += [(1, None), (2, ""), (3, "\n\n"), (None, common[0]), (None, f"{common[0]}\nx"), (5, common[1]), (5, common[1]), (6, (common[2] + "\n") * 3000), (7, "x" * 39 + "\n" + "　" + "y" * 40)]
    return docs + [(20_000_000 + k % 4, f"four documents hold this line of forty characters or so {k % 2}") for k in range(8)]


@pytest.mark.parametrize("batches, fan", [(4, 2), (1, 2), (7, 3)])
def test_equals_brute_force(docs_of, batches, fan):
    docs = corpus()
    rows = line_runs.dedup(docs_of(docs).repartition(3), batches, fan)
    got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in rows.collect()]
    assert sorted(got, key=str) == brute(docs)
    digest = line_runs.digest(docs_of(docs)).collect() if batches == 4 else []
    assert sorted([tuple(r) for r in digest], key=str) == (brute(docs) if digest else [])


def test_runs(spark):
    """Each batch learns what no earlier one held; runs are compacted level by level; totals are those of all batches."""
    runs = line_runs.LineRuns(spark, shared_dir(spark, "runs-test"), fan=2, buckets=4)
    fresh = []
    for batch in range(5):
        ids = range(1000 - 100 * batch, 1000 - 100 * batch + 50)
        lines = spark.createDataFrame([(f"k{(i * 7) % (20 + 5 * batch)}".encode(), i) for i in ids], "h binary, doc long")
        fresh.append({bytes(r.h) for r in runs.add(lines).filter("top IS NOT NULL").collect()})
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert not set.intersection(fresh[0], fresh[1]) and len(set().union(*fresh)) == sum(map(len, fresh))
    totals = {bytes(r.h): (r.n_docs, r.top) for r in runs.totals().collect()}
    want = {}
    for batch in range(5):
        for i in range(1000 - 100 * batch, 1000 - 100 * batch + 50):
            n, top = want.get(k := f"k{(i * 7) % (20 + 5 * batch)}".encode(), (0, 0))
            want[k] = (n + 1, max(top, i))
    assert totals == want


def test_empty_table_and_columns(docs_of):
    assert line_runs.dedup(docs_of([])).isEmpty()
    assert line_runs.dedup(docs_of(["a"])).columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    plan = line_runs.lines_of(docs_of(["a"]).withColumn("doc", F.lit("x")).withColumn("h", F.lit("y"))).columns
    assert plan == ["doc", "th", "pos", "h"]
