"""Suffix-array deduplication: every byte that a 400-byte string covers which also starts elsewhere is removed.

Segments that may repeat (see anchors) are dealt out by anchor.  A task cuts its segments into blocks of equal length, counted
from their anchors so that equal texts are cut alike, builds the suffix array of the block strings and from it the Burrows-Wheeler
transform.  Intervals of suffixes with a common prefix are expanded breadth first by backward extension, one block a
level, so prefix lengths come in increasing order; an interval that stands for one place is dropped, and the
expansion stops at the least length, the number of whole blocks that any 400 bytes hold.  Strings of 400
bytes around the places that remain are then compared exactly.  Segments are weighted by how often they occur, so copies are expanded once.
A passage in very many texts, whose anchor has more segments than a task should hold, is split by what stands around the anchor first.

Null and empty texts and those under 400 bytes lose nothing.  Rows that repeat are places of their own.  An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import NONE, Shape, cover, keyed, occurrences, spans, verdict_rows, verdicts
from .shared import documents
from .text import _WORD_BASE, byte_values, chunks, spans_hash


def suffix_array(symbols: np.ndarray, least: int) -> np.ndarray:
    """Positions by their suffixes, compared by `least` symbols at least (prefix doubling)."""
    rank, done = np.unique(symbols, return_inverse=True)[1].astype(np.int64), 1
    n = len(symbols)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - done] = rank[done:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (np.diff(key[order]) != 0).astype(np.int64)]))
        done *= 2
        if done >= least or rank[order[-1]] == n - 1:
            return order


def expand(symbols: np.ndarray, weight: np.ndarray, stops: int, least: int) -> np.ndarray:
    """Positions whose next `least` symbols occur in several places (by weight).  Symbols under `stops` end a string and occur once each."""
    order = suffix_array(symbols, least)
    before = symbols[order - 1]  # the transform; the first position is preceded by the last, a stop
    by = np.argsort(before, kind="stable")
    step = np.empty(len(order), np.int64)
    step[by] = np.arange(len(order))  # from a suffix to the one that is a symbol longer
    first = symbols[order]
    at = np.flatnonzero(first >= stops)
    interval = first[at]
    for _ in range(least - 1):
        at, interval = repeated(at, interval, weight[order])
        if not len(at):
            break
        more = before[at] >= stops
        symbol, to, interval = before[at][more], step[at[more]], interval[more]
        sort = np.argsort(to)
        at, symbol, interval = to[sort], symbol[sort], interval[sort]
        interval = np.cumsum(np.concatenate([[False], (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])])[: len(at)])
    at, _ = repeated(at, interval, weight[order])
    return order[at]


def repeated(at: np.ndarray, interval: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes whose interval stands for two places or more."""
    if not len(at):
        return at, interval
    lo = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
    keep = np.repeat(np.add.reduceat(weight[at], lo) > 1, np.diff(np.append(lo, len(at))))
    return at[keep], interval[keep]


def repeats(width: int, block: int):
    least = (width - block + 1) // block

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.frombuffer(b"".join(pdf["symbols"]), np.uint8)
        values = byte_values(data)
        ends = np.cumsum([len(x) for x in pdf["symbols"]])
        starts = np.concatenate([[0], ends[:-1]])
        head = starts + pdf["lead"].to_numpy() % block
        count = (ends - head) // block
        # blocks of all segments, each segment's followed by a stop of its own
        owner = np.repeat(np.arange(len(pdf)), count)
        base = np.concatenate([[0], np.cumsum(count)[:-1]])
        place = head[owner] + (np.arange(len(owner)) - base[owner]) * block
        names = np.unique(spans_hash(values, place, place + block, _WORD_BASE), return_inverse=True)[1] + len(pdf)
        slot = np.arange(len(owner)) + owner
        symbols, byte = np.empty(len(owner) + len(pdf), np.int64), np.zeros(len(owner) + len(pdf), np.int64)
        stops = base + count + np.arange(len(pdf))
        symbols[slot], byte[slot], symbols[stops] = names, place, np.arange(len(pdf))
        weight = np.zeros(len(symbols), np.int64)
        weight[slot] = pdf["n"].to_numpy()[owner]
        core = byte[np.sort(expand(symbols, weight, len(pdf), least))]
        # the windows whose first whole block is a core's
        window = (core[:, None] - np.arange(block)[None, :]).ravel()
        of = np.repeat(np.searchsorted(ends, core, side="right"), block)
        fits = (window >= starts[of]) & (window + width <= ends[of])
        window, of = window[fits], of[fits]
        first = np.full(len(data) + 1, NONE, np.int64)
        if len(window):
            which = np.unique(spans_hash(values, window, window + width, _WORD_BASE), return_inverse=True)[1]
            twice = np.bincount(which, weights=pdf["n"].to_numpy()[of])[which] > 1
            first[window[twice]] = 0
        return pd.DataFrame([verdict_rows(h, c, first[a : b - width + 1], NONE) for h, c, a, b in zip(pdf["h"].tolist(), pdf["ctx"].tolist(), starts, ends)])

    return decide


def dedup_bytes(docs: DataFrame, width: int = 400, k: int = 128) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes left)."""
    shape = Shape(False, width, k, shard=1 << 20)
    docs = keyed(docs).withColumn("doc", F.lit(0).cast("long"))
    found = occurrences(docs, shape)
    gone = spans(found, verdicts(found, docs, shape, repeats(width, max(1, width // 25))), width, smaller=False)

    def keep(batches):
        for batch in batches:
            marks, total, lost, runs, kept = batch.column(2).to_pylist(), [], [], [], []
            for chunk in chunks(batch.column(1)):
                for i, (lo, hi) in enumerate(zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist())):
                    out = cover(hi - lo, marks[chunk.lo + i])
                    total.append(hi - lo)
                    lost.append(int(out.sum()))
                    runs.append(int((out[1:] & ~out[:-1]).sum() + out[:1].sum()))
                    kept.append(chunk.data[lo:hi][~out].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (total, lost, runs)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = docs.join(gone, "key", "left").select("doc_id", "text", "spans")
    numbers = {c: F.lit(0).cast("long") for c in ("n_bytes", "n_removed", "n_spans")}
    return rows.mapInArrow(keep, rows.select("doc_id").withColumns(numbers | {"kept": F.lit(b"")}).schema)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n_bytes FROM t),
w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 800)) AS s FROM n, unnest(range(0, n_bytes - 399)) AS u(i)),
p AS (SELECT doc_id, i FROM w JOIN (SELECT s FROM w GROUP BY s HAVING count(*) > 1) USING (s)),
l AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM p),
g AS (SELECT doc_id, i, sum(CASE WHEN i <= last + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM l),
c AS (SELECT doc_id, span, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY 1, 2),
k AS (SELECT doc_id, h, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM c JOIN n USING (doc_id)),
o AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM k GROUP BY 1)
SELECT n.doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM n LEFT JOIN o USING (doc_id)
"""
