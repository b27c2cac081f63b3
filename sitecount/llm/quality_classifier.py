"""Quality classifier from weak labels: heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer.

Each labeller votes good, bad or nothing on a document. Votes are counted by pattern over the whole corpus; there are at most
3 ** labellers patterns, so the counts are a small table however large the corpus is. Expectation-maximisation
on that table estimates how often each labeller votes what on good and on bad documents, and gives each pattern a posterior.

The scorer is a logistic regression on hashed features of words (the word, its ending and its shape), averaged over a
document's words, and one of how many of them repeat the one before. A document's score is the mean of its words' scores and that of its
echoes, passed through the logistic function. It is fitted to posteriors on
a bounded sample, ``SAMPLE`` different rows (id and text) at most, those with the least hashes, of which only hashed features reach the driver.
All documents are scored, whole.

Null text counts as empty; documents without words get score 0 and aren't kept. Repeated rows get the same score each. An
empty table gives no rows. Columns other than the id and the text aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import each
from .quality_rules import STOP_WORDS, SYMBOLS

#: Rows of the fitting sample at most; hashed features; passes of the two fits.
SAMPLE, FEATURES, EM_ROUNDS, FIT_ROUNDS = 3000, 1 << 15, 60, 250
_STOP = frozenset(w.encode() for w in STOP_WORDS)
_SYMBOL = frozenset(SYMBOLS.encode())


def _vote(good: bool, bad: bool) -> int:
    return -1 if bad else int(good)


def echoes(words: list[bytes]) -> float:
    """The part of the words that equal the one before."""
    return sum(map(bytes.__eq__, words, words[1:])) / len(words)


def votes(text: bytes) -> tuple[int, ...]:
    """1 for good, -1 for bad, 0 for nothing, of each labeller."""
    cased = text.split()
    words = text.lower().split()
    n = len(words)
    if not n:
        return (0,) * LABELLERS
    lines = [x for x in text.split(b"\n") if x.strip()]
    marked = sum(1 for w in words if _SYMBOL.intersection(w)) / n
    bars = words.count(b"|") / n
    stops = sum(1 for w in words if w in _STOP) / n
    mean = sum(map(len, words)) / n
    ended = sum(1 for x in lines if x.rstrip()[-1:] in b".!?") / len(lines)
    again = 1 - len(set(lines)) / len(lines)
    twice = echoes(words)
    loud = sum(1 for w in cased if w.isupper() and len(w) > 1) / n
    return (
        _vote(False, marked > 0.3),
        _vote(False, bars > 0.1),
        _vote(n >= 10 and stops > 0.1, n >= 20 and stops < 0.02),
        _vote(n >= 10 and 3 <= mean <= 8, n >= 10 and mean > 11),
        _vote(ended > 0.5, n >= 20 and ended < 0.05),
        _vote(False, len(lines) >= 4 and again > 0.4),
        _vote(False, n >= 10 and twice > 0.2),
        _vote(False, n >= 10 and loud > 0.4),
    )


LABELLERS = 8
#: Those that vote on bad documents only: that they don't vote says something too. Of the others, only votes count.
ONE_SIDED = (0, 1, 5, 6, 7)


def code(found: tuple[int, ...]) -> int:
    out = 0
    for v in found:
        out = out * 3 + v + 1
    return out


def decode(pattern: int) -> list[int]:
    out = []
    for _ in range(LABELLERS):
        out.append(pattern % 3 - 1)
        pattern //= 3
    return out[::-1]


def fit_labellers(counts: dict[int, int], rounds: int = EM_ROUNDS) -> tuple[dict[int, float], np.ndarray]:
    """The posterior of being good by pattern, and P(vote | class) as [labeller, class, vote + 1]. Starts at a weighted majority of votes."""
    patterns = sorted(counts)
    v = np.array([decode(p) for p in patterns]).reshape(-1, LABELLERS) + 1
    n = np.array([counts[p] for p in patterns], dtype=float)
    sided = np.isin(np.arange(LABELLERS), ONE_SIDED)
    good = 1 / (1 + np.exp(-1.0 - 2.0 * ((v - 1) * np.where(sided, 3, 1)).sum(axis=1)))
    table = np.full((LABELLERS, 2, 3), 1.0)
    for _ in range(rounds):
        w = np.stack([(1 - good) * n, good * n])
        prior = (w.sum(axis=1) + 1) / (n.sum() + 2)
        for j in range(LABELLERS):
            for c in range(2):
                seen = np.bincount(v[:, j], weights=w[c], minlength=3) + 0.1
                table[j, c] = seen / seen.sum()
                if not sided[j]:
                    table[j, c] = [seen[0] / (seen[0] + seen[2]), 1, seen[2] / (seen[0] + seen[2])]
        log = np.log(prior)[:, None] + np.array([[np.log(table[j, c][v[:, j]]) for j in range(LABELLERS)] for c in range(2)]).sum(axis=1)
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return dict(zip(patterns, good.tolist(), strict=True)), table


_SHAPE = ((re.compile(rb"[A-Z]{2,}"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"))


def features(word: bytes) -> tuple[int, int, int]:
    """Buckets of a word in lower case, its ending and its shape."""
    shape, low = word[:64], word.lower()
    for pattern, letter in _SHAPE:
        shape = pattern.sub(letter, shape)
    return tuple(xxhash.xxh64_intdigest(kind + x) % FEATURES for kind, x in ((b"w", low), (b"e", low[-3:]), (b"s", shape)))


def echo(words: list[bytes]) -> int:
    """A bucket for the part of the words that equal the one before, in twentieths."""
    return xxhash.xxh64_intdigest(b"r%d" % min(10, int(20 * echoes(words)))) % FEATURES


def fit_scorer(rows: list[tuple[list[int], list[float]]], target: np.ndarray, rounds: int = FIT_ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sparse rows (buckets, values), by Adam on the whole sample."""
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    bucket = np.concatenate([np.asarray(r[0], dtype=np.int64) for r in rows]) if rows else np.zeros(0, dtype=np.int64)
    value = np.concatenate([np.asarray(r[1]) for r in rows]) if rows else np.zeros(0)
    w, bias = np.zeros(FEATURES + 1), FEATURES
    m, s = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    for k in range(1, rounds + 1):
        z = np.bincount(at, weights=value * w[bucket], minlength=len(rows)) + w[bias]
        off = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / max(1, len(rows))
        g = np.bincount(bucket, weights=off[at] * value, minlength=FEATURES + 1)
        g[bias] = off.sum()
        g += 1e-6 * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.5 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
    return w[:FEATURES], float(w[bias])


class Scorer(dict):
    """Scores by word, remembered for a bounded number of words."""

    def __init__(self, weights: np.ndarray, limit: int = 300_000):
        super().__init__()
        self.weights, self.limit = weights, limit

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.limit:
            self.clear()
        x = self[word] = float(sum(self.weights[k] for k in features(word)))
        return x


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = Counter(code(votes(t or b"")) for t in each(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["pattern", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pattern, buckets, values = [], [], []
        for t in each(batch.column(0)):
            words = t.split() if t else []
            if not words:
                continue
            seen = Counter(k for w in words for k in features(w))
            pattern.append(code(votes(t)))
            buckets.append([*seen, echo(words)])
            values.append([*(c / len(words) for c in seen.values()), 1.0])
        yield pa.RecordBatch.from_arrays([pa.array(pattern, pa.int64()), pa.array(buckets, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float64()))], names=["pattern", "buckets", "v"])


def sampled(docs: DataFrame, total: int, sample: int, id_col: str, text: str) -> DataFrame:
    """(t) of at most ``sample`` different rows, those with the least hashes of id and text. Of ``total`` rows, only about as many as are wanted are
    brought together, however often a row is repeated and whether or not rows have ids."""
    t = F.col(f"`{text}`")
    rows = docs.select(F.xxhash64(F.col(f"`{id_col}`"), t).alias("place"), t.cast("binary").alias("t"))
    part = min(1.0, 1.1 * sample / max(1, total) + 1e-9)
    few = rows.where(F.shiftrightunsigned("place", 11).cast("double") / float(1 << 53) < part)
    return few.groupBy("place").agg(F.min("t").alias("t")).orderBy(F.shiftrightunsigned("place", 1), "place").limit(sample).select("t")


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights and bias of the scorer, and the labellers' table."""
    t = F.col(f"`{text}`").cast("binary").alias("t")
    counts = {r.pattern: r.n for r in docs.select(t).mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}  # at most 3 ** LABELLERS rows
    posterior, table = fit_labellers(counts) if counts else ({}, np.zeros((LABELLERS, 2, 3)))
    rows = sampled(docs, sum(counts.values()), sample, id_col, text).mapInArrow(_sampled, "pattern long, buckets array<long>, v array<double>").collect()
    rows.sort(key=lambda r: (r.pattern, r.buckets))
    target = np.array([posterior[r.pattern] for r in rows])
    weights, bias = fit_scorer([(r.buckets, r.v) for r in rows], target) if rows else (np.zeros(FEATURES), 0.0)
    return weights, bias, table


def score(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: the id, score (0 to 1, six digits) and kept."""
    light = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(light)
        for batch in batches:
            out = []
            for t in each(batch.column(1)):
                words = t.split() if t else []
                z = sum(map(scorer.__getitem__, words)) / len(words) + float(light[echo(words)]) + bias if words else -50.0
                out.append(round(1 / (1 + np.exp(-min(50.0, max(-50.0, z)))), 6) if words else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array([x >= 0.5 for x in out], pa.bool_())], names=["id", "score", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS id", f"CAST(`{text}` AS BINARY) AS t").mapInArrow(run, f"id {kind}, score double, kept boolean").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights, bias, _ = fit(docs)
    return score(docs, weights, bias)
