"""N-gram Jaccard join with PartEnum signatures.

Documents whose shingle sets have a Jaccard similarity of 0.75 or more are linked; classes are the connected components.

Two sets with sizes T together and that similarity differ in at most T / 7 shingles.  For each band of T the domain is cut into
n parts, more than 5 / 8 as many as the sets may differ in, and each part into three: some part then has differences in one of its
three at most, and the two others together, one of the three subsets of two that are enumerated, are alike in both sets.  A subset's content is a
signature.  A set belongs to the bands that its partners' sizes can lead to, one or two.  Sets
of few shingles use a part for each shingle.  An agreement of empty subsets says nothing, so a set signs its empty subsets only where
the agreements that are certain could all be empty.  That count of certain agreements also filters: a document with fewer signatures
that any other document has too can't have a link in the band and is left out before any pair is made; so is, after that, one with fewer than
3 in 4 of its shingles in others that remain.

Equal sets are one class from the start.  Of each group of documents with one signature, the pairs of its two most connected documents with
the others are verified exactly; then groups that are not yet one component are compared whole, across components.  No partner is dropped.

Documents without words, null or empty, have no shingles and are a component of their own.  Each row is a document; rows with equal ids
are linked by their texts alone.  A null id links with nothing and its component is null.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Tables, documents, listed, part_names, shuffles, stored
from .text import chunks, mix

N = 5
#: Of sets whose sizes sum to no more, each shingle is a part.
SMALL = 56


def sets_of(column):
    """For each row in turn its distinct shingles' hashes, sorted."""
    for chunk in chunks(column):
        words = chunk.words(lower=True)
        grams = words.grams(N)
        short = np.flatnonzero((np.diff(words.rows) < N) & (np.diff(words.rows) > 0))
        whole = dict(zip(short.tolist(), words.between(words.rows[short], words.rows[short + 1])))
        for i, (lo, hi) in enumerate(zip(words.rows[:-1].tolist(), words.rows[1:].tolist())):
            if hi - lo >= N:
                yield np.unique(grams[lo : hi - N + 1])
            else:
                yield np.array([whole[i]], np.uint64) if i in whole else np.empty(0, np.uint64)


def differ(total: int) -> int:
    """Most shingles that two sets with `total` in all may differ in."""
    return total // 7


def band(total: int) -> int:
    """0: a part for each shingle; b: 2**b parts of three."""
    return 0 if total <= SMALL else int(np.ceil(np.log2((1.25 * differ(total) + 1) / 2)))


def agreements(n: int, d: int) -> int:
    """Subsets, of three in each of n parts, that sets agree in at least if d shingles differ.

    A part's first difference leaves one of its subsets alike, a second one elsewhere in the part none.
    """
    return 3 * n - 2 * min(d, n) - max(0, d - n)


def bands(size: int) -> list[tuple[int, int]]:
    """The bands of a set, each with the largest sum of sizes that it may come to there."""
    least, most = size + -(-3 * size // 4), size + 4 * size // 3
    if size <= 0:
        return []
    out: dict[int, int] = {}
    t = most
    while t >= least:
        b = band(t)
        out.setdefault(b, t)
        if b == band(least):
            break
        lo, hi = least, t
        while lo < hi:  # the largest sum of a lower band
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if band(mid) < b else (lo, mid - 1)
        t = lo
    return list(out.items())


def signatures(s: np.ndarray, b: int, total: int) -> tuple[np.ndarray, int]:
    """The signatures of a set in a band, and how many of them each partner shares at least."""
    tag = np.uint64((b + 1) * 0x9E3779B97F4A7C15 % 2**64)
    if b == 0:
        return mix(s ^ tag), max(1, -(-3 * len(s) // 4))
    n = 1 << b
    with np.errstate(over="ignore"):
        third = ((s << np.uint64(b)) >> np.uint64(32)) * np.uint64(3) >> np.uint64(32)
        part = ((s >> np.uint64(64 - b)) * np.uint64(3) + third).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sums, held = np.zeros(3 * n, np.uint64), np.zeros(3 * n, np.int8)
        sums[part[new]], held[part[new]] = np.add.reduceat(mix(s + tag), new), 1
        # of each part the subsets of two: all but one of its three
        sums, held = sums.reshape(n, 3), held.reshape(n, 3)
        pair, full = (sums.sum(axis=1, keepdims=True) - sums).ravel(), (held.sum(axis=1, keepdims=True) > held).ravel()
        name = mix(np.arange(3 * n, dtype=np.uint64) + tag)
        found = mix(pair[full] ^ name[full])
        certain = agreements(n, differ(total)) - int((~full).sum())
        if certain < 1:
            found = np.concatenate([found, mix(name[~full] + np.uint64(1))])
            certain = 1
    return found, certain


#: A signature's owner, as it travels with its signatures: label and mass stand for what is known of it by then.
RUN = ("doc", "label", "mass", "common", "size", "band", "certain", "n")


def signed(docs: DataFrame, parts: int, single: bool = False) -> DataFrame:
    """docs (doc, text, label, mass, common) -> part, sigs (uint32 each), runs (RUN, one of `n` signatures each): signatures dealt out by value.

    single: one for each shingle, whatever the size.
    """

    spread = part_names(parts)

    def sign(batches):
        for batch in batches:
            ids, labels, masses, common = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 4))
            held, which, about = [], [], []
            size = 0
            for i, s in enumerate(sets_of(batch.column(1))):
                for b, total in [(0, 0)][: len(s)] if single else bands(len(s)):
                    found, certain = signatures(s, b, total)
                    held.append(found)
                    which.append(np.full(len(found), len(about), np.int32))
                    about.append((ids[i], labels[i], masses[i], common[i], len(s), b, certain))
                    size += len(found)
                if size > 1 << 21:
                    yield packed(held, which, about)
                    held, which, about, size = [], [], [], 0
            if held:
                yield packed(held, which, about)

    def packed(held, which, about):
        sig, who = np.concatenate(held), np.concatenate(which)
        about, squeeze = np.array(about, np.int64), zstandard.ZstdCompressor(level=1)
        to = (sig >> np.uint64(32)).astype(np.int64) % parts
        order = np.argsort(to * len(about) + who, kind="stable")
        to, who, sig = to[order], who[order], sig[order].astype(np.uint32)
        cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        names, sigs, runs = [], [], []
        for a, z in zip(cut, np.append(cut[1:], len(to))):
            lo = np.flatnonzero(np.concatenate([[True], who[a + 1 : z] != who[a : z - 1]]))
            names.append(int(spread[to[a]]))
            sigs.append(sig[a:z].tobytes())
            runs.append(squeeze.compress(np.column_stack([about[who[a:z][lo]], np.diff(np.append(lo, z - a))]).T.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sigs, pa.binary()), pa.array(runs, pa.binary())], names=["part", "sigs", "runs"])

    return docs.select("doc", "text", "label", "mass", "common").mapInArrow(sign, "part long, sigs binary, runs binary")


def unpacked(pdf: pd.DataFrame):
    """Signatures, sorted, as the number of each one's run, the runs (a dict of columns), and where groups of two documents or more begin and end."""
    expand = zstandard.ZstdDecompressor()
    sig = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["sigs"]])
    table = np.concatenate([np.frombuffer(expand.decompress(x), np.int64).reshape(len(RUN), -1) for x in pdf["runs"]], axis=1)
    runs = dict(zip(RUN, table))
    who = np.repeat(np.arange(table.shape[1]), runs["n"])
    order = np.argsort(sig.astype(np.int64) << 8 | runs["band"][who], kind="stable")
    sig, who = sig[order], who[order]
    b = runs["band"][who]
    lo = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (b[1:] != b[:-1])]))
    hi = np.append(lo[1:], len(sig))
    some = hi - lo > 1
    return who, runs, lo[some], hi[some]


def dealt(table: np.ndarray, names: np.ndarray) -> pd.DataFrame:
    """Rows of numbers, packed by a hash of the first column, so that a part gives a few rows and not one for each document."""
    to = (mix(table[:, 0].astype(np.uint64)) % np.uint64(len(names))).astype(np.int64)
    order = np.argsort(to, kind="stable")
    to, table = to[order], np.ascontiguousarray(table[order], np.int64)
    lo = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.empty(0, np.int64)
    return pd.DataFrame({"part": names[to[lo]], "rows": [table[a:z].tobytes() for a, z in zip(lo, np.append(lo[1:], len(to)))]})


def rows_of(pdf: pd.DataFrame, width: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, np.int64).reshape(-1, width) for x in pdf["rows"]])


def shared_counts(names: np.ndarray):
    """Of each document and band: signatures that others have too, and how many others have them in all."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        who, runs, lo, hi = unpacked(pdf)
        steps = np.zeros(len(who) + 1, np.int64)
        steps[lo] += hi - lo - 1
        steps[hi] -= hi - lo - 1
        others = np.cumsum(steps[:-1])
        n, mass = np.bincount(who[others > 0], minlength=len(runs["doc"])), np.bincount(who, weights=others, minlength=len(runs["doc"])).astype(np.int64)
        some = np.flatnonzero(n)
        return dealt(np.column_stack([runs["doc"][some], runs["band"][some], runs["certain"][some], n[some], mass[some]]), names)

    return count


def likely(pdf: pd.DataFrame) -> pd.DataFrame:
    """Documents that share as many signatures in a band as a link needs: doc, n and mass (of the band with most)."""
    t = rows_of(pdf, 5)
    t = t[np.lexsort((t[:, 1], t[:, 0]))]
    lo = np.flatnonzero(np.concatenate([[True], (t[1:, 0] != t[:-1, 0]) | (t[1:, 1] != t[:-1, 1])]))
    n, mass = np.add.reduceat(t[:, 3], lo), np.add.reduceat(t[:, 4], lo)
    enough = n >= t[lo, 2]
    out = pd.DataFrame({"doc": t[lo, 0][enough], "n": n[enough], "mass": mass[enough]})
    return out.groupby("doc", as_index=False).max()


def counted(texts: DataFrame, parts: int, single: bool = False) -> DataFrame:
    """likely() over texts (doc, text)."""
    zero = F.lit(0).cast("long")
    signs = signed(texts.select("doc", "text").withColumns({"label": zero, "mass": zero, "common": zero}), parts, single)
    return signs.groupBy("part").applyInPandas(shared_counts(part_names(parts)), "part long, rows binary").groupBy("part").applyInPandas(likely, "doc long, n long, mass long")


def paired(docs: DataFrame, pairs, parts: int) -> DataFrame:
    """Distinct pairs (a, b) of what pairs() gives for the parts of docs' signatures."""
    spread = part_names(parts)

    def unique(pdf: pd.DataFrame) -> pd.DataFrame:
        found = np.unique(rows_of(pdf, 2), axis=0)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        return dealt(pairs(pdf), spread)

    return signed(docs, parts).groupBy("part").applyInPandas(deal, "part long, rows binary").groupBy("part").applyInPandas(unique, "a long, b long")


#: Documents of a group that all its others are compared with first.
PIVOTS = 2


def groups_of(pdf: pd.DataFrame):
    """The groups of a part, no two alike: doc, label, size and common of their documents, most mass first."""
    who, runs, lo, hi = unpacked(pdf)
    seen = set()
    for a, z in zip(lo.tolist(), hi.tolist()):
        rows = np.unique(who[a:z])
        rows = rows[np.lexsort((runs["doc"][rows], -runs["mass"][rows]))]
        doc = runs["doc"][rows]
        if doc.tobytes() not in seen:
            seen.add(doc.tobytes())
            yield doc, runs["label"][rows], runs["size"][rows], runs["common"][rows]


def together(out: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([np.empty((0, 2), np.int64), *out]), axis=0)


def pivot_pairs(pdf: pd.DataFrame) -> np.ndarray:
    """Pairs a < b of the documents of most mass in each group with the others.

    Two sets with a link have 3 / 7 of their sizes' sum in common, so at least as many of each one's shingles are known to stand in others.
    Of near copies with changes of their own the one nearest to the original shares most signatures, so most mass means most links.
    """
    out = []
    for doc, _, size, common in groups_of(pdf):
        for i in range(min(PIVOTS, len(doc) - 1)):
            fits = 7 * np.minimum(common[i], common[i + 1 :]) >= 3 * (size[i] + size[i + 1 :])
            fits &= (4 * np.minimum(size[i], size[i + 1 :]) >= 3 * np.maximum(size[i], size[i + 1 :])) & (doc[i + 1 :] != doc[i])
            other = doc[i + 1 :][fits]
            out.append(np.column_stack([np.minimum(other, doc[i]), np.maximum(other, doc[i])]))
    return together(out)


def open_groups(pdf: pd.DataFrame) -> np.ndarray:
    """Groups that are not one component yet, without documents that can't have a link across; those that overlap are joined: each
    document of them with the smallest that it hangs together with here.

    A set of `size` with `common` shingles in others links with sets of up to 7 / 3 * common - size only, and none under 3 / 4 of its size.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for doc, label, size, common in groups_of(pdf):
        if (label == label[0]).all():
            continue
        reach = np.minimum(7 * common // 3 - size, 4 * size // 3)
        order = np.argsort(size, kind="stable")
        doc, label, size, reach = doc[order], label[order], size[order], reach[order]
        lo, hi = np.searchsorted(size, -(-3 * size // 4)), np.searchsorted(size, reach, side="right")
        tied = []
        for i in np.flatnonzero(hi > lo).tolist():
            a, z = lo[i], hi[i]
            if ((label[a:z] != label[i]) & (reach[a:z] >= size[i])).any():
                tied.append(int(doc[i]))
        for x in tied:
            parent.setdefault(x, x)
            a, b = root(tied[0]), root(x)
            parent[max(a, b)] = min(a, b)
    return together([np.array([(root(x), x) for x in parent if root(x) != x], np.int64).reshape(-1, 2)])


#: Bits of a set's sketch for each of its shingles, at least (a power of two in all).
SKETCH = 8


def sketch(s: np.ndarray) -> bytes:
    """A bitmap with the bits of the set's shingles.  A bit that x has and y hasn't stands for a shingle of x that isn't in y."""
    bits = max(64, 1 << int(SKETCH * len(s) - 1).bit_length())
    marks = np.zeros(bits, bool)
    marks[(mix(s) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(marks).tobytes()


def missing(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Of each x and y, the larger number of bits that one has and the other hasn't: so many shingles at least are not common (wider bitmaps are folded)."""
    out = np.zeros((len(x), len(y), 2), np.float32)
    wide = [np.array([8 * len(b) for b in side]) for side in (x, y)]
    for w in np.unique(wide[0]):
        for v in np.unique(wide[1]):
            n, rows = int(min(w, v)), []
            for side, size, width in ((x, wide[0], w), (y, wide[1], v)):
                m = np.unpackbits(np.frombuffer(b"".join(side[i] for i in np.flatnonzero(size == width)), np.uint8)).reshape(-1, width // n, n).any(axis=1)
                rows.append(m.astype(np.float32))
            both = rows[0] @ rows[1].T
            at = np.ix_(wide[0] == w, wide[1] == v)
            out[(*at, 0)] = rows[0].sum(axis=1)[:, None] - both
            out[(*at, 1)] = rows[1].sum(axis=1)[None, :] - both
    return out


#: Documents in a block of a cluster.
BLOCK = 512
def near_across(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs a < b of documents of different labels, one of each block of a cluster (i <= j: the blocks that meet here), whose sketches allow a link."""
    pdf = pdf.sort_values("doc")
    x, y = pdf[pdf["block"] == pdf["i"].iloc[0]], pdf[pdf["block"] == pdf["j"].iloc[0]]
    if not len(x) or not len(y):
        return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    apart = missing(x["sketch"].tolist(), y["sketch"].tolist()).astype(np.int64)
    sx, sy = x["size"].to_numpy()[:, None], y["size"].to_numpy()[None, :]
    both = np.minimum(sx - apart[..., 0], sy - apart[..., 1])
    near = (7 * both >= 3 * (sx + sy)) & (x["label"].to_numpy()[:, None] != y["label"].to_numpy()[None, :])
    r, c = np.nonzero(near)
    a, b = x["doc"].to_numpy()[r], y["doc"].to_numpy()[c]
    found = together([np.column_stack([np.minimum(a, b), np.maximum(a, b)])])
    return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})


def across(marked: DataFrame, parts: int, tables: Tables) -> DataFrame:
    """marked (doc, text, label, mass, common, shingles) -> links (a, b) between components.

    Groups that are not one component, joined where they overlap, make clusters.  A cluster's documents are dealt into blocks, and every two blocks
    meet in a task of their own, which compares all their sketches at once and returns the pairs that the sketches leave open, to be verified: no task holds a cluster.
    """
    near = tables.stored(paired(marked, open_groups, parts))
    clusters = components(near, tables).withColumnRenamed("label", "cluster")
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = marked.select("doc", "label", "size", "sketch").join(clusters, "doc").join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("doc"), "blocks"))
    met = placed.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    pairs = met.groupBy("cluster", "i", "j").applyInPandas(near_across, "a long, b long").distinct()
    return verified(tables.stored(pairs), marked.select("doc", "shingles"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked; sets: doc, shingles (binary)."""

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    x = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """links (a, b) -> doc, label: the smallest document of each linked document's component.

    Each document hangs itself on its smallest neighbour, chains are followed to their ends, and links between the ends make the next, smaller graph.
    """
    edges, labels = tables.stored(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), None
    while labels is None or edges.limit(1).count():
        ends = edges.select(F.col("a").alias("doc"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("doc"), F.col("a").alias("other")))
        up = tables.stored(ends.groupBy("doc").agg(F.min("other").alias("other")).select("doc", F.least("doc", "other").alias("label")))
        while True:
            further = up.select(F.col("doc").alias("label"), F.col("label").alias("further"))
            after = tables.stored(up.join(further, "label").select("doc", F.col("further").alias("label"), (F.col("further") != F.col("label")).alias("moved")))
            up = after.select("doc", "label")
            if not after.filter("moved").limit(1).count():
                break
        left, right = (up.select(F.col("doc").alias(x), F.col("label").alias(f"{x}_label")) for x in "ab")
        met = edges.join(left, "a").join(right, "b").filter("a_label != b_label")
        edges = tables.stored(met.select(F.least("a_label", "b_label").alias("a"), F.greatest("a_label", "b_label").alias("b")).distinct())
        if labels is None:
            labels = up
        else:
            step = up.select(F.col("doc").alias("label"), F.col("label").alias("further"))
            labels = tables.stored(labels.join(step, "label", "left").select("doc", F.coalesce("further", "label").alias("label")))
    return labels


def join(docs: DataFrame, of_result: Tables | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id.

    The result reads two stored tables, which of_result holds, to be dropped by whoever has done with it; all others are deleted here.
    """
    parts, tables = shuffles(docs.sparkSession), Tables()
    of_result = of_result or Tables()

    def describe(batches):
        for batch in batches:
            rows = []
            for s in sets_of(batch.column(2)):
                with np.errstate(over="ignore"):
                    rows.append((len(s), int(mix(s).sum().view(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], names=["doc_id", "doc", "n", "h1", "h2"])

    # a row's key names its document; copies of a set are stood for by the one with the smallest id
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("doc"), "text")
    about = of_result.stored(keyed.mapInArrow(describe, "doc_id long, doc long, n long, h1 long, h2 long"))
    classes = tables.stored(about.filter("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min(F.struct("doc_id", "doc")).alias("first")).select("n", "h1", "h2", F.col("first.doc_id").alias("first_id"), F.col("first.doc").alias("rep")))
    copies = tables.stored(about.join(classes, ["n", "h1", "h2"]).filter("doc != rep").select("doc").distinct())
    single = keyed.filter("doc_id is not null").select("doc", "text").join(listed(copies), "doc", "left_anti")
    chosen = tables.stored(counted(single, parts))
    # of a document with a link, 3 in 4 shingles at least are in another that is still in question
    known = single.join(listed(chosen.select("doc")), "doc")
    chosen = tables.stored(counted(known, parts, single=True).withColumnRenamed("n", "common"))

    def described(batches):
        for batch in batches:
            sets = list(sets_of(batch.column(1)))
            made = [pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)] + made, names=["doc", "text", "mass", "common", "size", "shingles", "sketch"])

    held = tables.stored(single.join(listed(chosen), "doc").select("doc", "text", "mass", "common").mapInArrow(described, "doc long, text string, mass long, common long, size long, shingles binary, sketch binary"))
    sets = held.select("doc", "shingles")
    first = paired(held.withColumn("label", F.lit(0).cast("long")), pivot_pairs, parts)
    labels = components(tables.stored(verified(first, sets)), tables)
    more = tables.stored(across(held.join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc")), parts, tables))
    if more.limit(1).count():
        # links between components: the labels are what is left to join
        of = {x: labels.select(F.col("doc").alias(x), F.col("label").alias(f"{x}_label")) for x in "ab"}
        between = more.join(of["a"], "a", "left").join(of["b"], "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
        step = components(between, tables).select(F.col("doc").alias("label"), F.col("label").alias("further"))
        seen = labels.unionByName(more.select(F.col("a").alias("doc"), F.col("a").alias("label"))).unionByName(more.select(F.col("b").alias("doc"), F.col("b").alias("label"))).groupBy("doc").agg(F.min("label").alias("label"))
        labels = tables.stored(seen.join(step, "label", "left").select("doc", F.coalesce("further", "label").alias("label")))
    told = tables.stored(classes.join(labels.withColumnRenamed("doc", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep")))
    least = tables.stored(told.groupBy("label").agg(F.min("first_id").alias("component_id")))
    told = of_result.stored(told.join(least, "label").select("n", "h1", "h2", "component_id"))
    tables.drop()
    return about.withColumn("linked", F.col("doc_id").isNotNull()).join(told.withColumn("linked", F.lit(True)), ["n", "h1", "h2", "linked"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without those that have a smaller document in their component (of rows with one id, all or none)."""
    tables = Tables()
    gone = stored(join(docs, tables).filter("component_id != doc_id").select("doc_id").distinct())
    tables.drop()
    return docs.join(listed(gone), "doc_id", "left_anti").select(*docs.columns)


OP2_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM t),
n AS (SELECT t.doc_id, count(sh) AS n FROM t LEFT JOIN s USING (doc_id) GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT r.doc_id, any_value(n.n) AS n_shingles, min(reach) AS component_id FROM r JOIN n USING (doc_id) GROUP BY 1
"""
