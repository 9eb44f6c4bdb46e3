"""Substring deduplication with suffix automata.

A stretch of at least 50 words that a document with a smaller id holds too is removed.  The reference, the segments
that may occur twice (see anchors), is dealt into shards by anchor.  Each shard's segments become one
suffix automaton over words, whose states carry the smallest document of the strings that they stand for.  The shard's
segments are then streamed through it: the matching statistics, at each word the longest match that ends there and its state,
give for each window the first document that holds it.  Shards replace a broadcast of all automata because the
reference grows with the corpus; an automaton never leaves the task that uses it.  There are as many shards as the reference's
words need, and an anchor with very many segments is split by what stands around it before its pieces are dealt out.

A document of fewer than 50 words, null and empty texts included, loses nothing.  A null doc_id counts as the largest; rows with
equal ids don't remove from each other.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import NONE, Shape, cover, keyed, occurrences, spans, verdict_rows, verdicts
from .shared import documents
from .text import chunks


class Automaton:
    """Suffix automaton of several strings; least[s] is the smallest label of the strings that hold what state s stands for."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [NONE]

    def _state(self, length: int, following: dict, link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.least.append(NONE)
        return len(self.next) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        """The state for the strings of q that p and symbol make."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def add(self, symbols: list[int], label: int) -> None:
        following, link, length = self.next, self.link, self.length
        last = 0
        for symbol in symbols:
            q = following[last].get(symbol)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, symbol, q)
            else:
                p, last = last, self._state(length[last] + 1, {}, 0)
                while p >= 0 and symbol not in following[p]:
                    following[p][symbol] = last
                    p = link[p]
                if p >= 0:
                    q = following[p][symbol]
                    link[last] = q if length[q] == length[p] + 1 else self._split(p, symbol, q)
            self.least[last] = min(self.least[last], label)

    def close(self) -> None:
        """Carries labels from longer strings to their suffixes."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if self.least[s] < self.least[up]:
                self.least[up] = self.least[s]

    def statistics(self, symbols: list[int], enough: int):
        """For each symbol the length of the longest match that ends there, and the smallest label of its last `enough` symbols (NONE if it is shorter)."""
        state, matched = 0, 0
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol in self.next[state]:
                state, matched = self.next[state][symbol], matched + 1
            if matched < enough:
                yield matched, NONE
                continue
            s = state
            while self.length[self.link[s]] >= enough:
                s = self.link[s]
            yield matched, self.least[s]


def firsts(width: int):
    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        automaton, out = Automaton(), []
        for words, first in zip(pdf["symbols"], pdf["first"].tolist()):
            automaton.add(np.frombuffer(words, np.int64).tolist(), first)
        automaton.close()
        for words, h, ctx in zip(pdf["symbols"], pdf["h"].tolist(), pdf["ctx"].tolist()):
            found = [label for _, label in automaton.statistics(np.frombuffer(words, np.int64).tolist(), width)][width - 1 :]
            out.append(verdict_rows(h, ctx, np.array(found, np.int64), NONE))
        return pd.DataFrame(out)

    return decide


def dedup(docs: DataFrame, width: int = 50, k: int = 25) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept (the words left, joined by one space)."""
    shape = Shape(True, width, k)
    docs = keyed(docs)
    found = occurrences(docs, shape)
    gone = spans(found, verdicts(found, docs, shape, firsts(width)), width, smaller=True)

    def keep(batches):
        for batch in batches:
            marks, total, lost, kept = batch.column(2).to_pylist(), [], [], []
            for chunk in chunks(batch.column(1)):
                words = chunk.words()
                raw = chunk.data.tobytes()
                for i, (lo, hi) in enumerate(zip(words.rows[:-1].tolist(), words.rows[1:].tolist())):
                    out = cover(hi - lo, marks[chunk.lo + i])
                    tokens = raw[chunk.offsets[i] : chunk.offsets[i + 1]].split()
                    total.append(hi - lo)
                    lost.append(int(out.sum()))
                    kept.append(b" ".join([t for t, gone in zip(tokens, out.tolist()) if not gone] if lost[-1] else tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    rows = docs.join(gone, "key", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(keep, rows.select("doc_id").withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept": F.lit("")}).schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))




OP1_SQL = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 49], ' ')) AS s FROM t, unnest(range(1, len(w) - 48)) AS u(i)),
f AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN f USING (s), range(0, 50) AS r(k) WHERE m < doc_id),
g AS (SELECT doc_id, list(p) AS g FROM gone GROUP BY doc_id),
k AS (SELECT doc_id, w, coalesce(len(g), 0) AS n_removed,
  CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(g, x[2])), lambda x: x[1]) END AS kept
  FROM t LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
