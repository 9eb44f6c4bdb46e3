"""Exact top-k search by inner product with MaxScore pruning, over shards of integer vectors.

A component is a term, a vector's entry its impact, a term's postings the shard's vectors with their impacts.  For a query, a vector's gain from a
term is what it adds over the least that any vector of the shard gets from it; a term's score bound is the largest gain.  Vectors are met
in blocks.  The threshold is the k-th best score so far; terms in order of their bounds are non-essential as long as their bounds together stay
under the threshold: no vector gets over it by them alone.  A block's essential postings are traversed; the vectors that the bounds of the
rest could lift over the threshold are probed in the non-essential postings, the largest bounds first, and dropped as soon as the bounds that are left can't
lift them any more.  After a block the threshold has risen and fewer terms are essential.  Shards' answers are exact and are merged.

Shards of vectors meet blocks of queries, each pair of them in a task, so a task holds a shard, a block and nothing else.

Vectors that are null, empty or hold null or non-finite components take no part, as query or candidate.  Vectors of
different lengths are compared as if the shorter ended in zeros.  Equal scores go to the smaller id.  Rows are
candidates one by one, so repeated ids stay separate; a query never meets rows of its own id.  Query rows of one id with different vectors are
merged in one ranking.  Scores are exact: sums that could reach 2**53 are made of Python's integers, and one beyond 63 bits raises OverflowError.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored

#: Most queries in a block, vectors in a shard, and vectors that are met between two updates of a threshold.
QUERIES, SHARD, MEET = 4096, 8192, 1024
#: Non-essential terms that are probed at once.
PROBE = 4


class Shard:
    """A shard's vectors, a column of postings for each term.  probed, skipped: postings that were looked at and that were not, of all queries."""

    def __init__(self, vectors: np.ndarray, owners: np.ndarray):
        self.vectors, self.owners = vectors, owners
        self.low, self.high = vectors.min(axis=0), vectors.max(axis=0)
        self.probed = self.skipped = 0

    def top(self, q: np.ndarray, own, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Owners and scores of the k best vectors for a query, in order; rows that `own` owns are left out."""
        if float((np.abs(q) * np.maximum(np.abs(self.low), np.abs(self.high))).sum()) >= 2**53:
            return self.whole(q, own, k)
        least = np.minimum(q * self.low, q * self.high)
        bound = np.maximum(q * self.low, q * self.high) - least
        order = np.argsort(bound, kind="stable")
        under = np.concatenate([[0.0], np.cumsum(bound[order])])  # of the terms with the smallest bounds, together
        base, threshold = least.sum(), -np.inf
        ids, scores = np.zeros(0, self.owners.dtype), np.zeros(0)
        for lo in range(0, len(self.owners), MEET):
            rows = lo + np.flatnonzero(self.owners[lo : lo + MEET] != own)
            # a gain equal to the threshold may still win by its id
            split = int(np.searchsorted(under, threshold - base, side="left")) - 1 if np.isfinite(threshold) else 0
            split = max(0, min(split, len(order)))
            essential = np.sort(order[split:])
            part = self.vectors[rows] @ q if split == 0 else self.vectors[np.ix_(rows, essential)] @ q[essential] + least[order[:split]].sum()
            self.probed += len(rows) * (len(order) - split)
            while split:
                alive = part + under[split] >= threshold
                rows, part = rows[alive], part[alive]
                self.skipped += int((~alive).sum()) * split
                first = max(0, split - PROBE)
                terms = order[first:split]
                part = part + self.vectors[np.ix_(rows, terms)] @ q[terms] - least[terms].sum()
                self.probed += len(rows) * len(terms)
                split = first
            ids, scores = np.concatenate([ids, self.owners[rows]]), np.concatenate([scores, part])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(scores) == k:
                threshold = scores[-1]
        return ids, np.rint(scores).astype(np.int64)

    def whole(self, q: np.ndarray, own, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same by Python's integers, without pruning."""
        rows = np.flatnonzero(self.owners != own)
        exact = [int(x) for x in q]
        scores = [sum(a * int(b) for a, b in zip(exact, v)) for v in self.vectors[rows]]
        best = sorted(range(len(rows)), key=lambda i: (-scores[i], self.owners[rows[i]]))[:k]
        return self.owners[rows[best]] if best else self.owners[:0], np.array([scores[i] for i in best], object).astype(np.int64)


def matrix(vectors, width: int) -> np.ndarray:
    m = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        m[i, : len(v)] = v
    return m


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, shard_rows: int = SHARD, block_rows: int = QUERIES) -> DataFrame:
    """vectors, queries (vec_id, embedding) -> query_id, rank, vec_id, score: each query's k best of `vectors`."""

    def whole(df):
        x = F.transform("embedding", lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("double"))
        bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
        return df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(~bad).select("vec_id", x.alias("v"))

    held, asked = stored(whole(vectors)), stored(whole(queries).dropDuplicates(["vec_id", "v"]))
    shards, blocks = max(1, -(-held.count() // shard_rows)), max(1, -(-asked.count() // block_rows))

    def dealt(df, own: str, n: int, other: str, m: int):
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id", "v"), F.lit(n))).withColumn(other, every).groupBy("shard", "block")

    def search(key, shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(shard) and len(block):
            width = max(shard["v"].map(len).max(), block["v"].map(len).max())
            order = np.argsort(shard["vec_id"].to_numpy(), kind="stable")
            held = Shard(matrix(shard["v"].tolist(), width)[order], shard["vec_id"].to_numpy()[order])
            for q, own in zip(matrix(block["v"].tolist(), width), block["vec_id"].tolist()):
                ids, scores = held.top(q, own, k)
                found.append((np.full(len(ids), own, np.int64), ids, scores))
        columns = zip(*found) if found else ((np.zeros(0, np.int64),),) * 3
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, columns))))

    # the stated query set against all rows: every block of queries meets every shard
    near = dealt(held, "shard", shards, "block", blocks).cogroup(dealt(asked, "block", blocks, "shard", shards)).applyInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id != c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
