"""Token counts: greedy longest-match word pieces, counted by a linear automaton without building the pieces.

The vocabulary is a set of symbol strings: bytes, and one end-of-word symbol. Its trie gets failure links in the manner of
linear MaxMatch: where no edge leaves node v for the next symbol, the pieces that greedy matching would cut off the
string that v spells are popped, of which only their number is stored, and matching goes on at the node of the rest.
Each symbol of a word is then read once and each failure link followed at most once for each symbol read.

The vocabulary file is a parameter; it is read once, on the driver, and travels to the executors as a broadcast automaton whose
size is that of the vocabulary, not of the corpus. Words repeat, so a worker remembers counts of a bounded number of words.

A word that greedy matching can't finish counts as one unknown token. Null or empty text has no words and no tokens. The words
``[^\\x20\\x09-\\x0D]+`` of the whole text are lower-cased (A-Z) if ``lower`` is set.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import each

END = 256
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: Words that a worker remembers.
REMEMBERED = 200_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else one above 255 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str = VOCABULARY, end: str = "</w>") -> list[tuple[int, ...]]:
    """Symbol strings of a vocabulary with an end-of-word mark, from a tokenizer's JSON file; special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    letters, special = byte_letters(), {x["content"] for x in model.get("added_tokens", [])}
    out = []
    for piece in model["model"]["vocab"]:
        if piece in special:
            continue
        body = piece.removesuffix(end)
        if all(c in letters for c in body):
            symbols = (*(letters[c] for c in body), *((END,) if body != piece else ()))
            if symbols:
                out.append(symbols)
    return out


class Automaton:
    """Trie edges in one dict keyed by node * 512 + symbol; ``fail`` and ``popped`` by node (-1: no way on)."""

    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        edges: dict[int, int] = {}
        last = [False]
        for piece in pieces:
            node = 0
            for s in piece:
                node = edges.setdefault(node * 512 + s, len(last))
                if node == len(last):
                    last.append(False)
            last[node] = True
        children: list[list[tuple[int, int]]] = [[] for _ in last]
        for key, to in edges.items():
            children[key >> 9].append((key & 511, to))
        fail, popped = [-1] * len(last), [0] * len(last)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for s, to in children[node]:
                if last[to]:  # the whole string is a piece
                    fail[to], popped[to] = 0, 1
                else:
                    at, n = fail[node], popped[node]
                    while at >= 0 and at * 512 + s not in edges:
                        at, n = fail[at], n + popped[at]
                    if at >= 0:
                        fail[to], popped[to] = edges[at * 512 + s], n
                queue.append(to)
        self.edges, self.fail, self.popped = edges, fail, popped

    def count(self, symbols: Iterable[int]) -> int:
        """Pieces of greedy longest match; 1 if it gets stuck (one unknown token); 0 for no symbols."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node = n = 0
        empty = True
        for s in symbols:
            empty = False
            while (to := edges.get(node * 512 + s)) is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = to
        if empty:
            return 0
        while node > 0:
            n += popped[node]
            node = fail[node]
        return n if node == 0 else 1


class Counter(dict):
    """Pieces by word, remembered for a bounded number of words."""

    def __init__(self, automaton: Automaton, limit: int = REMEMBERED):
        super().__init__()
        self.automaton, self.limit = automaton, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        n = self.automaton.count((*word, END))
        if len(word) <= 256:
            self[word] = n
        return n


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = VOCABULARY, lower: bool = True) -> DataFrame:
    """One row per row of ``docs``: the id, n_words and n_tokens. Other columns aren't read."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(Automaton(read_vocabulary(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            n_words, n_tokens = [], []
            for t in each(batch.column(1)):
                found = (t.lower() if lower else t).split() if t else []
                n_words.append(len(found))
                n_tokens.append(sum(map(counter.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["id", "n_words", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.selectExpr(f"`{id_col}` AS id", f"CAST(`{text}` AS BINARY) AS t").mapInArrow(run, f"id {kind}, n_words long, n_tokens long")
    return rows.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Greedy matching done piece by piece: all pieces that start at each place of a word, then the longest one from place to place. ``chr(1)`` ends a word.
ORACLE = rf"""
WITH RECURSIVE file AS (SELECT content::JSON AS j FROM read_text('{VOCABULARY}')),
plain AS (SELECT b, b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255 AS prints FROM range(256) AS t(b)),
letters AS (SELECT list(CASE WHEN prints THEN chr(b::INT) ELSE chr((256 + other)::INT) END ORDER BY b) AS names FROM (SELECT *, count(*) FILTER (NOT prints) OVER (ORDER BY b) - 1 AS other FROM plain)),
pieces AS (SELECT DISTINCT regexp_replace(piece, '</w>$', chr(1)) AS piece FROM (SELECT unnest(json_keys(j->'model'->'vocab')) AS piece FROM file)
  WHERE piece NOT IN (SELECT unnest(from_json(j->'$.added_tokens[*].content', '["VARCHAR"]')) FROM file)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
each AS (SELECT r, unnest(w) AS word FROM d),
spelled AS (SELECT word, array_to_string(list_transform(range(1, octet_length(encode(word)) + 1), lambda i: names[('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::INT + 1]), '') || chr(1) AS s FROM (SELECT DISTINCT word FROM each), letters),
places AS (SELECT word, s, unnest(range(1, length(s) + 1)) AS i FROM spelled),
starts AS (SELECT word, i, s, unnest(range(1, least(length(s) - i + 1, (SELECT max(length(piece)) FROM pieces)) + 1)) AS n FROM places),
best AS (SELECT word, i, max(n) AS n FROM starts JOIN pieces ON substr(s, i, n) = piece GROUP BY ALL),
walk AS (SELECT word, s, 1::BIGINT AS i, 0 AS done FROM spelled UNION ALL SELECT w.word, w.s, w.i + b.n, done + 1 FROM walk AS w JOIN best AS b ON w.word = b.word AND w.i = b.i),
counted AS (SELECT word, coalesce(max(done) FILTER (i > length(s)), 1) AS n FROM walk GROUP BY word),
sums AS (SELECT r, sum(n) AS n FROM each JOIN counted USING (word) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_tokens FROM d LEFT JOIN sums USING (r)"""
