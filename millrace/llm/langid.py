"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A run of three letters (a gap between words counts as a letter) is
bound into one vector, the product of the first letter's vector permuted twice, the second's permuted once and the
third's; a text is the sum of its runs' vectors, a language the sum of its texts.  A text gets the language whose
prototype has the largest cosine with it, the mean of all prototypes taken off both.  Texts are bundled many at once: counts of runs times the runs' vectors.

Null texts and texts without a letter get `und` and score 0; ties go to the language that sorts first; a text
without a known language (none learned) gets `und`.  Upper case counts as lower case.  The driver holds one vector per language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded, documents, fold
from .text import chunks, mix

DIMENSIONS = 1024
GAP = 0
_LETTER: list = []
_VECTORS: dict[int, np.ndarray] = {}


def letters() -> np.ndarray:
    """Of each code point its lower-case letter, or GAP."""
    if not _LETTER:
        table = np.zeros(0x110000, np.uint32)
        for c in range(len(table)):
            if chr(c).isalpha():
                table[c] = ord(chr(c).lower()[0])
        _LETTER.append(table)
    return _LETTER[0]


def letter_vector(letter: int) -> np.ndarray:
    """The letter's vector: bits of a hash of letter and dimension."""
    with np.errstate(over="ignore"):
        x = mix(np.uint64(letter + 1) * np.uint64(0x9E3779B97F4A7C15) + np.arange(DIMENSIONS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.where(mix(x) & np.uint64(1), 1, -1).astype(np.int8)


#: Letters whose vectors a worker holds at most.
LETTERS = 1 << 12


def run_vectors(runs: np.ndarray) -> np.ndarray:
    """Bound vectors of runs, each of three letters of 21 bits."""
    places = [runs >> 42, (runs >> 21) & 0x1FFFFF, runs & 0x1FFFFF]
    kinds, at = np.unique(np.concatenate(places), return_inverse=True)
    if len(_VECTORS) > LETTERS:
        _VECTORS.clear()
    for x in kinds.tolist():
        if x not in _VECTORS:
            _VECTORS[x] = letter_vector(x)
    plain = np.stack([_VECTORS[x] for x in kinds.tolist()])
    first, second, third = at.reshape(3, -1)
    return np.roll(plain, 2, axis=1)[first] * np.roll(plain, 1, axis=1)[second] * plain[third]


#: Runs whose vectors a worker holds at most (1 KB each), and runs of text that are bundled at once.
HELD, BUNDLE = 1 << 15, 1 << 15


class Runs:
    """Vectors of runs.  Those seen lately are held; when there are HELD of them, all go and are made anew as they are needed."""

    shared = None

    @classmethod
    def here(cls) -> "Runs":
        """This worker's: tasks that follow each other in a worker share what is held."""
        cls.shared = cls.shared or cls()
        return cls.shared

    def __init__(self):
        self.rows: dict[int, int] = {}
        self.table = np.zeros((1 << 12, DIMENSIONS), np.int8)

    def vectors(self, runs: np.ndarray) -> np.ndarray:
        """Vectors of distinct runs, BUNDLE at most."""
        if len(self.rows) + len(runs) > HELD:
            self.rows = {}
        at = np.array([self.rows.get(r, -1) for r in runs.tolist()], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(self.rows) + np.arange(len(new))
            self.rows.update(zip(runs[new].tolist(), at[new].tolist()))
            if len(self.rows) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(len(self.table), len(self.rows) - len(self.table)), DIMENSIONS), np.int8)])
            self.table[at[new]] = run_vectors(runs[new])
        return self.table[at].astype(np.float32)


def runs_of(chunk) -> tuple[np.ndarray, np.ndarray]:
    """The runs of a chunk's texts, and the number of each run's text; texts without letters have none."""
    points = np.frombuffer(chunk.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])[chunk.offsets]
    n = np.diff(heads)
    # each text between two gaps; then gaps in a row become one
    owner = np.repeat(np.arange(len(n)), n + 2)
    s, inside = np.zeros(len(owner), np.int64), np.ones(len(owner), bool)
    first = heads[:-1] + 2 * np.arange(len(n))
    inside[first] = inside[first + n + 1] = False
    s[inside] = letters()[points]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != GAP) | (s[:-1] != GAP) | (owner[1:] != owner[:-1])
    s, owner = s[keep], owner[keep]
    whole = owner[2:] == owner[:-2]
    return (s[:-2] << 42 | s[1:-1] << 21 | s[2:])[whole], owner[:-2][whole]


def text_vectors(column, runs: Runs):
    """For each chunk of the column: its first row, the vectors of its rows, and which of them have letters.  All sums are whole numbers, so exact."""
    for chunk in chunks(column, 1 << 18):
        code, owner = runs_of(chunk)
        n = chunk.hi - chunk.lo
        out = np.zeros((n, DIMENSIONS))
        for lo in range(0, len(code), BUNDLE):
            kinds, at = np.unique(code[lo : lo + BUNDLE], return_inverse=True)
            own = owner[lo : lo + BUNDLE]
            top, bottom = int(own[0]), int(own[-1]) + 1
            vectors = runs.vectors(kinds)
            for first in range(top, bottom, 64):
                mine = slice(*np.searchsorted(own, (first, first + 64)))
                if mine.start < mine.stop:
                    rows = min(64, bottom - first)
                    counts = np.bincount((own[mine] - first) * len(kinds) + at[mine], minlength=rows * len(kinds)).reshape(rows, -1)
                    out[first : first + rows] += counts.astype(np.float32) @ vectors
        yield chunk.lo, out, np.bincount(owner, minlength=n) > 0


def learn(labelled: DataFrame) -> dict[str, np.ndarray]:
    """labelled (lang, text) -> prototype of each language."""

    def bundle(batches):
        runs, sums = Runs.here(), {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lo, vectors, some in text_vectors(batch.column(1), runs):
                for i in np.flatnonzero(some).tolist():
                    sums[langs[lo + i]] = sums.get(langs[lo + i], 0) + vectors[i]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = labelled.filter("lang is not null").select("lang", "text").mapInArrow(bundle, "lang string, v array<double>")
    rows = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect()
    return {r["lang"]: np.array([x["x"] for x in r["v"]]) for r in rows}


class Predictor:
    """Tells languages by their prototypes, the mean of all taken off."""

    def __init__(self, prototypes: dict[str, np.ndarray]):
        self.names = sorted(prototypes)
        unit = np.array([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-9) for n in self.names]).reshape(-1, DIMENSIONS)
        middle = unit.mean(axis=0) if len(self.names) > 1 else np.zeros(DIMENSIONS)
        middle = middle / max(np.linalg.norm(middle), 1e-9)
        apart = unit - (unit @ middle)[:, None] * middle
        apart = apart / np.maximum(np.linalg.norm(apart, axis=1), 1e-9)[:, None]
        self.axes = np.concatenate([apart, middle[None]])

    def tell(self, column, runs: Runs) -> tuple[list[str], list[float]]:
        """Language and score (cosine, not under 0) of each text of a column."""
        langs, scores = [], []
        for _, vectors, some in text_vectors(column, runs):
            if not self.names:
                some = np.zeros(len(vectors), bool)
            along = vectors @ self.axes.T
            rest = np.sqrt(np.maximum((vectors * vectors).sum(axis=1) - along[:, -1] ** 2, 1e-9))
            best = along[:, :-1].argmax(axis=1) if self.names else np.zeros(len(vectors), int)
            langs += [self.names[b] if ok else "und" for b, ok in zip(best.tolist(), some.tolist())]
            scores += [min(1.0, max(0.0, x)) if ok else 0.0 for x, ok in zip((along[np.arange(len(best)), best] / rest).tolist(), some.tolist())]
        return langs, scores


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """docs with a text -> docs without it, with lang_pred and score."""
    keep, predictor = [c for c in docs.columns if c != "text"], Predictor(prototypes)

    def tell(batches):
        runs = Runs.here()
        for batch in batches:
            langs, scores = predictor.tell(batch.column(len(keep)), runs)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = docs.select(*keep).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return docs.select(*keep, "text").mapInArrow(tell, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang").withColumn("held_out", fold("doc_id", 3) == 1)
    return predict(docs.select("doc_id", "held_out", "text"), learn(docs.filter("not held_out"))).select("doc_id", "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.05) -> DataFrame:
    """docs without those whose language is not told: no letters, or a cosine under `least`.  Where no row names a language, only the former go."""
    bounded(docs.sparkSession)
    prototypes = learn(docs.select("lang", "text"))
    if not prototypes:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    predictor, at = Predictor(prototypes), docs.columns.index("text")

    def keep(batches):
        runs = Runs.here()
        for batch in batches:
            langs, scores = predictor.tell(batch.column(at), runs)
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
