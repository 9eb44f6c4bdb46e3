"""Candidates for long repeats: anchored segments.

A text is a sequence of symbols (words or bytes).  Of the k-grams of each window of `width` symbols, the one with the least
hash (the leftmost, of equals) is the window's anchor, so equal windows have equal anchors, wherever they stand.  Consecutive
windows of a document with one anchor form a segment: the text from the first window's start to the last's end.
Only windows whose anchor's k-gram occurs twice can occur twice.  Which k-grams do is found by one count, and kept as a
bitmap of fixed size; a k-gram that falls on another's bit is merely one more candidate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables, listed, shuffles, stored
from .text import _WORD_BASE, byte_values, chunks, mix, sliding_argmin, spans_hash

#: Bits of the bitmap: 16 MB whatever the input.
BITS = 27
PART = 16


@dataclass
class Shape:
    """How texts are cut: symbols are words or bytes, windows have `width` of them, anchors `k`."""

    words: bool
    width: int
    k: int
    #: Segments of one anchor, no two equal, that are judged unsplit.
    most: int = 256
    #: Symbols that a shard has on average, at most.
    shard: int = 1 << 17


def symbols(chunk, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's symbols as 64-bit numbers, and where each row's start."""
    if shape.words:
        words = chunk.words()
        return words.hashes, words.rows
    return byte_values(chunk.data), chunk.offsets


def segments(values: np.ndarray, rows: np.ndarray, shape: Shape):
    """row, h (hash of the anchor's k-gram), ctx (hash of the segment), start, end, anchor of each segment, counted from the chunk's start."""
    width, k, n = shape.width, shape.k, len(values)
    none = np.empty(0, np.int64)
    empty = (none, none.astype(np.uint64), none.astype(np.uint64), none, none, none)
    if n < width:
        return empty
    lo = np.arange(n - k + 1)
    grams = spans_hash(values, lo, lo + k, _WORD_BASE)
    anchor = sliding_argmin(grams, width - k + 1)
    inside = np.zeros(n + 1, np.int8)
    long_rows = np.flatnonzero(np.diff(rows) >= width)
    np.add.at(inside, rows[long_rows], 1)
    np.add.at(inside, rows[long_rows + 1] - width + 1, -1)
    at = np.flatnonzero(np.cumsum(inside, dtype=np.int8)[: n - width + 1])
    if not len(at):
        return empty
    of = anchor[at]
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)]))
    start, end = at[new], np.append(at[new[1:] - 1], at[-1]) + width
    return np.searchsorted(rows, start, side="right") - 1, grams[of[new]], spans_hash(values, start, end, _WORD_BASE), start, end, of[new]


def keyed(docs: DataFrame) -> DataFrame:
    """doc (the id; a null one counts as the largest), key (of id and text: rows that share it are alike), text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64("doc_id", "text").alias("key"), "text", "doc_id")


def repeated_anchors(docs: DataFrame, shape: Shape):
    """Broadcast bitmap of the anchors that occur in two segments or more."""

    def anchors(batches):
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                h = segments(*symbols(chunk, shape), shape)[1]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    def bits(key, pdf: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(1 << PART, bool)
        marks[pdf["bit"].to_numpy()] = True
        return pd.DataFrame({"part": [int(key[0])], "marks": [np.packbits(marks).tobytes()]})

    seen = docs.select("text").mapInArrow(anchors, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    slot = F.shiftrightunsigned("h", 64 - BITS)
    slots = seen.select(F.shiftright(slot, PART).alias("part"), slot.bitwiseAND(F.lit((1 << PART) - 1)).alias("bit")).distinct()
    table = np.zeros(1 << (BITS - 3), np.uint8)
    for row in slots.groupBy("part").applyInPandas(bits, "part long, marks binary").toLocalIterator():
        size = 1 << (PART - 3)
        table[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["marks"], np.uint8)
    return docs.sparkSession.sparkContext.broadcast(table)


def occurrences(docs: DataFrame, shape: Shape) -> DataFrame:
    """docs as keyed() -> h, ctx, doc, key, starts, length, lead: the segments of each document whose anchors may occur twice.

    A document's equal segments are one row, with all their starts; lead: symbols from start to anchor.  The result is stored.
    """
    held = repeated_anchors(docs, shape)

    def find(batches):
        table = held.value
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for chunk in chunks(batch.column(2)):
                values, rows = symbols(chunk, shape)
                row, h, ctx, start, end, anchor = segments(values, rows, shape)
                slot = h >> np.uint64(64 - BITS)
                some = np.flatnonzero(table[(slot >> np.uint64(3)).astype(np.int64)] & (np.uint8(128) >> (slot & np.uint64(7)).astype(np.uint8)))
                if not len(some):
                    continue
                some = some[np.lexsort((start[some], ctx[some], h[some], row[some]))]
                row, h, ctx, start, end, anchor = row[some], h[some], ctx[some], start[some], end[some], anchor[some]
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])]))
                starts = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(start - rows[row]))
                at = chunk.lo + row[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[first].view(np.int64)), pa.array(ctx[first].view(np.int64)), pa.array(ids[at]), pa.array(keys[at]), starts, pa.array(end[first] - start[first]), pa.array(anchor[first] - start[first])],
                    names=["h", "ctx", "doc", "key", "starts", "length", "lead"],
                )

    found = stored(docs.select("doc", "key", "text").mapInArrow(find, "h long, ctx long, doc long, key long, starts array<long>, length long, lead long"))
    held.unpersist()
    return found


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the stretches of equal values."""
    lo = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return lo, np.append(lo[1:], len(values))


def verdict_rows(h: int, ctx: int, first: np.ndarray, none: int) -> dict:
    """first: of each window the document that it is first found in (`none` if nowhere else)."""
    lo, hi = runs_of(first)
    keep = first[lo] != none
    return {"h": h, "ctx": ctx, "lo": lo[keep].tolist(), "hi": hi[keep].tolist(), "first": first[lo][keep].tolist()}


VERDICT = "h long, ctx long, lo array<long>, hi array<long>, first array<long>"
NONE = (1 << 63) - 1


def with_symbols(wanted: DataFrame, docs: DataFrame, shape: Shape) -> DataFrame:
    """wanted (h, ctx, n, first, lead, sample: a document's key, a start and a length) -> h, ctx, n, first, lead, symbols (8 bytes a word, or the bytes)."""
    asked = wanted.groupBy("sample.key").agg(F.collect_list(F.struct("h", "ctx", "n", "first", "lead", "sample.start", "sample.length")).alias("asked"))
    names = ["h", "ctx", "n", "first", "lead", "symbols"]

    def cut(batches):
        for batch in batches:
            wants, out = batch.column(1).to_pylist(), []
            for chunk in chunks(batch.column(0)):
                values, rows = symbols(chunk, shape)
                raw = values if shape.words else chunk.data
                for i in range(chunk.hi - chunk.lo):
                    for w in wants[chunk.lo + i]:
                        at = rows[i] + w["start"]
                        out.append((w["h"], w["ctx"], w["n"], w["first"], w["lead"], raw[at : at + w["length"]].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k == 5 else pa.int64()) for k, x in enumerate(zip(*out))], names=names)

    rows = docs.join(asked, "key").select("text", "asked").mapInArrow(cut, "h long, ctx long, n long, first long, lead long, symbols binary")
    return rows.dropDuplicates(["h", "ctx"])


def split(rows: DataFrame, shape: Shape, size: int) -> DataFrame:
    """rows (h, ctx, n, first, lead, symbols) -> h, ctx, off, g, c, n, first, lead, symbols: each segment in pieces, `off` symbols from its start.

    A piece has the segment's windows whose anchor stands in one of `size` consecutive places, counted from the window's start.  What all
    such windows hold, their common middle, is hashed into the piece's group g.  Equal windows have their anchor in the same
    place and equal middles, so they are in one group; c is the piece's own hash.  With size 1 a piece is one window and all of its middle.
    """
    width, names = shape.width, ["h", "ctx", "off", "g", "c", "n", "first", "lead", "symbols"]

    def cut(batches):
        for batch in batches:
            h, ctx, n, first, lead = (batch.column(i).to_numpy() for i in range(5))
            raw = batch.column(5).to_pylist()
            data = np.frombuffer(b"".join(raw), np.uint64 if shape.words else np.uint8)
            values = data if shape.words else byte_values(data)
            length = np.array([len(x) for x in raw], np.int64) // data.itemsize
            base, last = np.cumsum(length) - length, length - width
            low, high = (lead - last) // size, lead // size
            row = np.repeat(np.arange(len(raw)), high - low + 1)
            bucket = np.arange(len(row)) - np.searchsorted(row, row) + low[row]
            begin, end = np.maximum(0, lead[row] - (bucket + 1) * size + 1), np.minimum(last[row], lead[row] - bucket * size)
            middle = base[row] + lead[row] - bucket * size
            g = mix(spans_hash(values, middle, middle + width - size + 1, _WORD_BASE) ^ mix(h[row].view(np.uint64) + bucket.astype(np.uint64)))
            lo, hi = base[row] + begin, base[row] + end + width
            pieces = [data[x:y].tobytes() for x, y in zip(lo.tolist(), hi.tolist())]
            c = spans_hash(values, lo, hi, _WORD_BASE)
            cols = [h[row], ctx[row], begin, g.view(np.int64), c.view(np.int64), n[row], first[row], lead[row] - begin]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols), pa.array(pieces, pa.binary())], names=names)

    kind = ", ".join(f"{x} long" for x in names[:-1]) + ", symbols binary"
    return rows.select("h", "ctx", "n", "first", "lead", "symbols").mapInArrow(cut, kind)


def judge(cut: DataFrame, shape: Shape, decide, size: int, tables: Tables) -> DataFrame:
    """VERDICT rows for stored segments (h, ctx, n, first, lead, symbols), whose anchors stand in one of `size` places.

    Anchors are dealt to as many shards as their symbols need.  Those with more segments than `most` are split into pieces first; equal
    pieces become one, and pieces that stand alone in their group go, before the groups are judged in the same way.
    """
    hot = listed(tables.stored(cut.groupBy("h").count().filter(f"count > {shape.most}").select("h")))
    few = cut.join(hot, "h", "left_anti")
    total = cut.agg(F.sum(F.length("symbols"))).first()[0] or 0
    shards = max(shuffles(cut.sparkSession), -(-total // ((8 if shape.words else 1) * shape.shard)))
    out = few.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards))).groupBy("shard").applyInPandas(decide, VERDICT)
    if hot.isEmpty():
        return out
    size = max(1, size // 4)
    pieces = tables.stored(split(cut.join(hot, "h", "left_semi"), shape, size))
    merged = pieces.groupBy("g", "c").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.first("lead").alias("lead"), F.first("symbols").alias("symbols"))
    merged = tables.stored(merged.withColumnsRenamed({"g": "h", "c": "ctx"}))
    shared = tables.stored(merged.groupBy("h").agg(F.sum("n").alias("of_h")).filter("of_h > 1").select("h"))
    below = judge(tables.stored(merged.join(shared, "h")), shape, decide, size, tables)
    below = tables.stored(below.withColumnsRenamed({"h": "g", "ctx": "c"}))
    back = pieces.select("h", "ctx", "off", "g", "c").join(below, ["g", "c"])
    moved = [F.transform(x, lambda v: v + F.col("off")).alias(x) for x in ("lo", "hi")]
    return out.unionByName(back.select("h", "ctx", *moved, "first"))


def verdicts(found: DataFrame, docs: DataFrame, shape: Shape, decide) -> DataFrame:
    """VERDICT rows for the segments of occurrences(), stored.

    decide(pdf) judges the segments of some anchors together: h, ctx, n, first, lead, symbols -> VERDICT rows.  Every segment that
    shares its anchor with another occurrence goes there, copies of one segment as one with its number.
    """
    tables = Tables()
    sample = F.min(F.struct("doc", "key", F.element_at("starts", 1).alias("start"), "length")).alias("sample")
    kinds = tables.stored(found.groupBy("h", "ctx").agg(F.sum(F.size("starts")).cast("long").alias("n"), F.min("doc").alias("first"), F.first("lead").alias("lead"), sample))
    # stored, so that the join below reads two plain exchanges and Spark can split a common anchor
    anchors = tables.stored(kinds.groupBy("h").agg(F.sum("n").alias("of_h")).filter("of_h > 1").select("h"))
    cut = tables.stored(with_symbols(tables.stored(kinds.join(anchors, "h")), docs, shape))
    judged = stored(judge(cut, shape, decide, shape.width - shape.k + 1, tables))
    tables.drop()
    return judged


def spans(found: DataFrame, judged: DataFrame, width: int, smaller: bool) -> DataFrame:
    """key, spans (array of from, to): what repeated windows cover; smaller: only those first found in a smaller document."""
    runs = F.arrays_zip("lo", "hi", "first")
    rows = found.join(judged, ["h", "ctx"]).withColumn("runs", F.filter(runs, lambda r: r["first"] < F.col("doc")) if smaller else runs).filter("size(runs) > 0")
    one = F.flatten(F.transform("starts", lambda s: F.transform("runs", lambda r: F.struct((s + r["lo"]).alias("a"), (s + r["hi"] + (width - 1)).alias("b")))))
    return rows.select("key", one.alias("spans")).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def cover(n: int, found) -> np.ndarray:
    """Which of a document's n symbols the spans cover."""
    steps = np.zeros(n + 1, np.int64)
    if found is not None and len(found):
        a, b = np.array([x["a"] for x in found]), np.array([x["b"] for x in found])
        np.add.at(steps, a, 1)
        np.add.at(steps, b, -1)
    return np.cumsum(steps[:n]) > 0
