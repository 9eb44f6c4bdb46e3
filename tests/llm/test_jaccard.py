from pathlib import Path

import numpy as np
import plain
import pytest

from millrace.llm import decontaminate, jaccard, queries
from millrace.llm.shared import Tables
from millrace.storage import shared_dir


def near_copies(seed, n, base=60, changes=12):
    """Copies of a few originals with changed words, sizes from one word up, shared lines."""
    rng = np.random.default_rng(seed)
    originals = [[f"o{k}w{rng.integers(5000)}" for _ in range(size)] for k, size in enumerate((4, 5, 6, 9, 20, base, base, 3 * base))]
    line = [f"line{i}" for i in range(20)]
    out = []
    for _ in range(n):
        w = list(originals[rng.integers(len(originals))])
        for _ in range(rng.integers(0, changes)):
            w[rng.integers(len(w))] = f"x{rng.integers(100000)}"
        if rng.random() < 0.3:
            w = w + line
        out.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_join(spark, seed):
    rows = list(enumerate(near_copies(seed, 150)))
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, label long, mass string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()}
    assert got == plain.components(rows)


def test_chains_and_blocks(spark, monkeypatch):
    """Copies that drift: neighbours are linked, ends are not; small blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    w, rows = [f"w{i}" for i in range(80)], []
    for i in range(40):
        rows.append((i, " ".join(w)))
        w = w[2:] + [f"n{i}a", f"n{i}b"]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()}
    assert got == plain.components(rows) and {c for _, c in got.values()} == {0}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "A"), (5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (6, "word " * 20000), (7, "word " * 30000), (8, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (5, 1, 5), (5, 1, 5), (None, 1, None), (6, 1, 6), (7, 1, 6), (8, 1, 8)], key=str)
    assert jaccard.join(df.limit(0)).count() == 0


def test_bands_cover_all_partners():
    for x in list(range(1, 200)) + [999, 5000]:
        mine = dict(jaccard.bands(x))
        for y in range(-(-3 * x // 4), 4 * x // 3 + 1):
            b = jaccard.band(x + y)
            assert b in mine and b in dict(jaccard.bands(y)) and x + y <= mine[b]


def test_similar_sets_share_signatures():
    rng = np.random.default_rng(1)
    for size in (1, 3, 8, 30, 33, 60, 300, 2000):
        for _ in range(20):
            x = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            drop = rng.integers(0, len(x) // 4 + 1)
            y = np.sort(np.concatenate([rng.permutation(x)[drop:], rng.integers(0, 2**63, int(len(x) * 0.25) - int(drop) if drop < len(x) * 0.25 else 0, dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both < 75 * (len(x) + len(y) - both):
                continue
            b = jaccard.band(len(x) + len(y))
            (sx, cx), (sy, cy) = (jaccard.signatures(s, b, dict(jaccard.bands(len(s)))[b]) for s in (x, y))
            shared = len(np.intersect1d(sx, sy))
            assert shared >= cx and shared >= cy and shared >= 1


def test_agreements_are_the_worst_case():
    """Over all ways to put d differences into n parts of three."""
    from itertools import product

    left = {0: 3, 1: 1, 2: 0, 3: 0}
    for n in (1, 2, 3):
        for d in range(2 * n):
            places = product(range(3 * n), repeat=d)
            assert jaccard.agreements(n, d) == min(sum(left[len({p for p in at if p // 3 == k})] for k in range(n)) for at in places)


def test_signatures_are_subsets_of_two():
    """A shingle more changes two of its part's three signatures, and no other."""
    rng = np.random.default_rng(4)
    s = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2))
    b = jaccard.band(800)
    before, after = (jaccard.signatures(x, b, 800)[0] for x in (s, np.sort(np.append(s, s[100] + np.uint64(1)))))
    assert len(before) == len(after) and len(np.setdiff1d(after, before)) == 2


def test_sketches_never_hide_a_link():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, n).astype(np.uint64)) for n in (1, 5, 30, 40, 200, 250, 250)]
    found = jaccard.missing([jaccard.sketch(s) for s in sets], [jaccard.sketch(s) for s in sets])
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert found[i, j, 0] <= len(np.setdiff1d(x, y)) and found[i, j, 1] <= len(np.setdiff1d(y, x))
    assert found[4, 4].tolist() == [0, 0] and found[4, 5].min() > 0


def test_tables_are_deleted(spark):
    """Of a join stay the two tables that its result reads, and none once they are dropped; of one_of_each and clean the list of ids."""
    docs = spark.createDataFrame(list(enumerate(near_copies(5, 60))), "doc_id long, text string")
    folders = lambda: {p for p in Path(shared_dir(spark).removeprefix("file:")).rglob("*") if p.is_dir() and any(p.glob("*.parquet"))}
    before, tables = folders(), Tables()
    joined = jaccard.join(docs, tables)
    assert len(folders() - before) == 2 and joined.count() == 60
    tables.drop()
    assert folders() == before
    kept = jaccard.one_of_each(docs)
    assert len(folders() - before) == 1 and 0 < kept.count() < 60
    before = folders()
    left = decontaminate.clean(docs, spark.createDataFrame([(1, docs.first()["text"])], "item_id long, text string"))
    assert len(folders() - before) == 1 and left.count() < 60


def test_registered_query(spark, sf_dir, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op2_jaccard_join"](spark, sf_dir).collect()}
    assert got == plain.components(docs)
