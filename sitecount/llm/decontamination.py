"""Benchmark decontamination: runs of a document within a small edit distance of a benchmark item, over words.

Candidates come from the q-gram lemma: an item of L words and a run within e edits share at least L - 2 - 3e runs of three words, so
the run holds as many starts of the item's own. Each document's runs of three words are looked up among those of all items, and an item
is a candidate wherever enough of its own stand close enough together to lie in one run of at most L + e words. That is counted for each item, so
nothing within the bound is missed, however long the item and whichever edits it has. Candidates are confirmed by exact
edit distance (with the best start and end).

Items travel in blocks of bounded size (``BLOCK_WORDS``), one at a time: it is built on the driver, broadcast, and gone before the next one. Documents are scanned
once for each block, whole, without a shuffle; where there are several, each scan's result is written. An item
allows ``floor(L / 5)`` edits, fewer where L < 10 and none where L < 6. ``leaks`` reports items by id and leaves out those with a null one; ``clean`` uses them too. Null and empty texts have no hits.
Repeated rows get the same hits each; repeated items are reported each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, drop, each, written

#: Words of a block of items; pairs of a place in a text and an item that are counted at once.
BLOCK_WORDS, AT_ONCE = 500_000, 2_000_000
_GRAM = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_BITS = 20


def allowed(words: int) -> int:
    """Edits that an item of so many words may have."""
    return max(0, min(words // 5, words // 3 - 1))


def grams(h: np.ndarray) -> np.ndarray:
    return h[:-2] * _GRAM[0] + h[1:-1] * _GRAM[1] + h[2:] * _GRAM[2] if len(h) >= 3 else h[:0]


def distances(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each end in ``text`` (0 to its length), the least edit distance of the item to a run of words that ends there."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for i, w in enumerate(item.tolist(), 1):
        best = row + 1
        best[0] = i
        best[1:] = np.minimum(best[1:], row[:-1] + (text != w))
        row = np.minimum.accumulate(best - steps) + steps
    return row


def anchored(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each end, the edit distance of the item to the whole of ``text`` up to it."""
    steps = np.arange(len(text) + 1)
    row = steps.copy()
    for i, w in enumerate(item.tolist(), 1):
        best = row + 1
        best[0] = i
        best[1:] = np.minimum(best[1:], row[:-1] + (text != w))
        row = np.minimum.accumulate(best - steps) + steps
    return row


def passages(item: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, end, distance) of runs within the item's bound that don't overlap: the nearest one to the item, then those of what is left and right of it.

    Of equally near ones the one at the middle comes first, so that a text of many copies is halved each time.
    """
    edits = allowed(len(item))
    least, todo = len(item) - edits, [(0, len(text))]
    own = np.unique(grams(item))
    starts = np.flatnonzero(np.isin(grams(text), own))
    while todo:
        low, high = todo.pop()
        # what is too short, or has too few of the item's grams, holds none
        if high - low < least or np.searchsorted(starts, high - 2) - np.searchsorted(starts, low) < len(item) - 2 - 3 * edits:
            continue
        row = distances(item, text[low:high])
        ends = np.flatnonzero(row == row.min())
        if row[ends[0]] > edits:
            continue
        middle = int(ends[np.abs(ends - (high - low) // 2).argmin()])
        end = low + int(ends[np.searchsorted(ends, middle - least, "right")])
        start = end - int(anchored(item[::-1], text[max(low, end - len(item) - edits) : end][::-1]).argmin())
        yield start, end, int(row[end - low])
        todo += [(low, start), (end, high)]


class Index:
    """A block of items, ready to be looked up; its size is that of the block."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        self.table = np.zeros(1 << _BITS, dtype=bool)
        #: Items of one or two words have no grams: the items by their first word.
        self.short: dict[int, list[int]] = defaultdict(list)
        for k, (_, h) in enumerate(items):
            if 0 < len(h) < 3:
                self.short[int(h[0])].append(k)
        self.heads = np.array(sorted(self.short), dtype=np.uint64)
        every = [np.unique(grams(h)) for _, h in items]
        flat = np.concatenate([np.zeros(0, dtype=np.uint64), *every])
        order = np.argsort(flat, kind="stable")
        self.grams, first = np.unique(flat[order], return_index=True)
        #: The items of gram k are owners[first[k] : first[k + 1]].
        self.first = np.append(first, len(flat))
        self.owners = np.repeat(np.arange(len(items)), list(map(len, every)))[order]
        self.table[self.grams >> np.uint64(64 - _BITS)] = True
        words = np.array([len(h) for _, h in items], dtype=np.int64)
        edits = np.array([allowed(n) for n in words.tolist()], dtype=np.int64)
        self.need, self.reach = words - 2 - 3 * edits, words + edits
        self.longest = int(self.reach.max(initial=0))

    def candidates(self, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, low, high): every run within the bound lies in one of the ranges of its item, which don't touch."""
        g = grams(h)
        maybe = np.flatnonzero(self.table[g >> np.uint64(64 - _BITS)])
        if not len(maybe):
            return
        gram = np.minimum(np.searchsorted(self.grams, g[maybe]), len(self.grams) - 1)
        true = self.grams[gram] == g[maybe]
        hits, gram = maybe[true], gram[true]
        many = self.first[gram + 1] - self.first[gram]
        total, a, found = np.append(0, np.cumsum(many)), 0, []
        while a < len(hits):
            b = max(a + 1, int(np.searchsorted(total, total[a] + AT_ONCE, "right")) - 1)
            c = int(np.searchsorted(hits, hits[b - 1] + self.longest))  # where runs that begin before b can end
            place = np.arange(total[a], total[c]) - np.repeat(total[a:c] - self.first[gram[a:c]], many[a:c])
            owner, at = self.owners[place], np.repeat(hits[a:c], many[a:c])
            order = np.argsort(owner, kind="stable")
            owner, at = owner[order], at[order]
            last = np.arange(len(owner)) + self.need[owner] - 1
            i = np.flatnonzero((last < len(owner)) & (at <= hits[b - 1]))
            j = last[i]
            i, j = (x[(owner[j] == owner[i]) & (at[j] - at[i] <= self.reach[owner[i]] - 3)] for x in (i, j))
            if len(i):
                m = owner[i]
                found.append((m, np.maximum(at[j] + 3 - self.reach[m], 0), np.minimum(at[i] + self.reach[m], len(h))))
            a = b
        if not found:
            return
        m, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(found) > 1:
            order = np.lexsort((low, m))
            m, low, high = m[order], low[order], high[order]
        new = np.flatnonzero(np.append(True, (m[1:] != m[:-1]) | (low[1:] > high[:-1])))
        for k, end in zip(new.tolist(), [*new[1:].tolist(), len(m)], strict=True):
            yield int(m[k]), int(low[k]), int(high[end - 1])

    def find(self, h: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, distance) of the hits, in words; those of an item don't overlap."""
        out = []
        for m, low, high in self.candidates(h):
            ident, item = self.items[m]
            out += [(ident, low + a, low + b, d) for a, b, d in passages(item, h[low:high])]
        return sorted(out + self.short_hits(h))

    def short_hits(self, h: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Hits of items of one or two words, exact and from the left."""
        out, free = [], defaultdict(int)
        for at in np.flatnonzero(np.isin(h, self.heads)).tolist() if len(self.heads) else ():
            for m in self.short[int(h[at])]:
                ident, item = self.items[m]
                end = at + len(item)
                if at >= free[m] and np.array_equal(h[at:end], item):
                    out.append((ident, at, end, 0))
                    free[m] = end
        return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text: str = "text", limit: int = BLOCK_WORDS, nameless: bool = False) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items with their word hashes, in blocks; the driver holds one block at a time. ``nameless`` items, those with a null id, get the id -1."""
    hashes, block, size = WordHash(), [], 0
    for ident, t in benchmark.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")).where((F.col(f"`{id_col}`").isNotNull() | F.lit(nameless)) & F.col(f"`{text}`").isNotNull()).toLocalIterator():
        found = t.encode().lower().split()
        if not found:
            continue
        if block and size + len(found) > limit:
            yield block
            block, size = [], 0
        block.append((-1 if ident is None else ident, hashes.of(found)))
        size += len(found)
    if block:
        yield block


def _passes(spark: SparkSession, benchmark: DataFrame, scan: Callable[[Broadcast], DataFrame], nameless: bool = False) -> Iterator[DataFrame]:
    """The result of ``scan`` for each block; that of the only one as a plan, those of several as written tables, with one block alive at a time."""
    found = blocks(benchmark, nameless=nameless)
    block, following = next(found, None), next(found, None)
    only = following is None
    while block is not None:
        shared = spark.sparkContext.broadcast(Index(block))
        out = scan(shared)
        if not only:
            out = written(out, "scanned")
            shared.destroy()
        yield out
        block, following = following, next(found, None)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs`` and item found in it: the id, item_id, n_hits, distance (the least), and spans ``start:end`` in words, comma-joined."""
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.selectExpr(f"`{id_col}` AS id", f"CAST(`{text}` AS BINARY) AS t")
    schema = f"id {kind}, item_id long, n_hits long, distance long, spans string"

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, index = WordHash(), shared.value
            for batch in batches:
                rows, take = [], []
                for k, t in enumerate(each(batch.column(1))):
                    found = index.find(hashes.of(t.lower().split())) if t else []
                    by_item = defaultdict(list)
                    for ident, a, b, d in found:
                        by_item[ident].append((a, b, d))
                    for ident, spans in sorted(by_item.items()):
                        take.append(k)
                        rows.append((ident, len(spans), min(s[2] for s in spans), ",".join(f"{a}:{b}" for a, b, _ in spans)))
                if rows:
                    cols = zip(*rows, strict=True)
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["id", "item_id", "n_hits", "distance", "spans"])

        return own.mapInArrow(run, schema)

    out = None
    for found in _passes(docs.sparkSession, benchmark, scan):
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with the columns of ``docs``."""
    at = docs.columns.index(text)

    left = docs

    def sift(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, index = WordHash(), shared.value
            for batch in batches:
                texts = each(batch.column(at).cast(pa.binary()))
                yield batch.filter(pa.array([not t or not index.find(hashes.of(t.lower().split())) for t in texts], pa.bool_()))

        return left.mapInArrow(run, docs.schema)

    for kept in _passes(docs.sparkSession, benchmark, sift, nameless=True):
        if left is not docs:
            drop(left)
        left = kept
    return left


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
