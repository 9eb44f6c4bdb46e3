"""Substring and byte deduplication against plain versions."""

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from millrace.llm import bytes_dedup, queries, substring
from millrace.llm.anchors import Shape
from millrace.llm.text import chunks, sliding_argmin, spans_hash


def texts(seed, n, words=8, lengths=(0, 60)):
    """Texts of a few words, so that repeats are many, some periodic, some copies of parts of others."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        kind = rng.integers(5)
        if kind == 0 and out:
            src = out[rng.integers(len(out))].split(" ")
            a = rng.integers(0, max(1, len(src)))
            out.append(" ".join(src[a : a + rng.integers(1, 50)] + [f"w{rng.integers(words)}"]))
        elif kind == 1:
            out.append(" ".join(["ab", "cd"] * int(rng.integers(1, 30))))
        else:
            out.append(" ".join(f"w{rng.integers(words)}" for _ in range(rng.integers(*lengths))))
    return out


ODD = [(50, None), (51, ""), (52, "  \n\t "), (None, "w1 " * 30), (53, "é ü " * 25), (53, "é ü " * 25), (54, "x" * 3000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, doc int")


def test_words_and_hashes():
    import pyarrow as pa

    column = pa.array(["a b\u000bc", None, "", "é x  y\r\n", "a b c"])
    got = []
    for c in chunks(column, size=4):
        w = c.words()
        got += [[bytes(c.data[a:b]) for a, b in zip(w.starts[lo:hi], w.ends[lo:hi])] for lo, hi in zip(w.rows[:-1], w.rows[1:])]
    assert got == [plain.words(t) for t in column.to_pylist()]
    one = next(chunks(column)).words()
    assert (one.hashes[:3] == one.hashes[-3:]).all() and len(set(one.hashes[:3].tolist())) == 3
    lowered = next(chunks(pa.array(["AbÉ abÉ"]))).words(lower=True)
    assert lowered.hashes[0] == lowered.hashes[1]


def test_sliding_argmin():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 50, 300).astype(np.uint64) << np.uint64(40)
    for w in (1, 2, 7, 300):
        assert sliding_argmin(keys, w).tolist() == [i + int(np.argmin(keys[i : i + w])) for i in range(300 - w + 1)]
    assert len(sliding_argmin(keys, 301)) == 0


def test_least_key_does_not_depend_on_how_many_there_are():
    pair = np.array([1 << 20, 0], np.uint64)
    for n in (0, 1 << 10, 1 << 21):
        assert sliding_argmin(np.concatenate([pair, np.full(n, 1 << 63, np.uint64)]), 2)[0] == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring(spark, seed):
    rows = list(enumerate(texts(seed, 50))) + ODD
    got = substring.dedup(frame(spark, rows), width=10, k=5).collect()
    want = plain.substring(rows, 10)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], plain.sha(r["kept"].encode())) for r in got) == sorted((str(i), *w) for (i, _), w in zip(rows, want))


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed):
    rows = list(enumerate(texts(seed, 40))) + ODD
    got = bytes_dedup.dedup_bytes(frame(spark, rows), width=40, k=12).collect()
    want = plain.bytes_removed([t for _, t in rows], 40)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], plain.sha(bytes(r["kept"]))) for r in got) == sorted((str(i), *w) for (i, _), w in zip(rows, want))


def around(n, seed, before=12, after=12, size=14):
    """One passage in n texts, between words that are nowhere else alike."""
    passage = " ".join(f"p{i}" for i in range(size))
    rng = np.random.default_rng(seed)
    some = [[f"r{x}" for x in rng.integers(0, 1000, before + after)] for _ in range(n)]
    return [(i, " ".join([*w[:before], passage, *w[before:]])) for i, w in enumerate(some)]


@pytest.mark.parametrize("most", [1, 5])
def test_crowded_anchors_are_exact(spark, monkeypatch, most):
    """Anchors of many segments are split, more than once, until their pieces are few."""
    # copies, and texts that share half of the passage, among those that share it all
    rows = around(40, 5)
    rows += [(100 + i, t) for i, t in rows[:3]] + [(200 + i, " ".join(t.split(" ")[:19] + [f"x{i}"] * 12)) for i, t in rows[:5]]
    monkeypatch.setattr(Shape, "most", most)
    monkeypatch.setattr(Shape.__init__, "__defaults__", (most, 50))
    got = substring.dedup(frame(spark, rows), width=10, k=5).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], plain.sha(r["kept"].encode())) for r in got) == sorted((i, *w) for (i, _), w in zip(rows, plain.substring(rows, 10)))
    got = bytes_dedup.dedup_bytes(frame(spark, rows), width=40, k=12).collect()
    want = plain.bytes_removed([t for _, t in rows], 40)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], plain.sha(bytes(r["kept"]))) for r in got) == sorted((i, *w) for (i, _), w in zip(rows, want))


def test_passage_in_thousands_of_texts(spark):
    """At the production widths: far more variants of an anchor than a task judges unsplit."""
    rows = around(3000, 6, before=30, after=30, size=80)
    got = substring.dedup(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], plain.sha(r["kept"].encode())) for r in got) == sorted((i, *w) for (i, _), w in zip(rows, plain.substring(rows, 50)))
    rows = around(1000, 7, before=60, after=60, size=120)
    got = bytes_dedup.dedup_bytes(frame(spark, rows)).collect()
    want = plain.bytes_removed([t for _, t in rows], 400)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], plain.sha(bytes(r["kept"]))) for r in got) == sorted((i, *w) for (i, _), w in zip(rows, want))


def test_passages_of_over_50_words(spark):
    """Bytes count, not words: passages of 60 words in two texts, with the spaces beside them, go from 400 bytes on."""
    rows = []
    for size in (399, 400, 401):
        passage = " ".join(f"p{i:02}q{size % 10}" for i in range(60)).ljust(size - 2, "x")
        rows += [(2 * size + k, " ".join([f"{i}-{size}{side}" for i in range(100)] + [passage] + [f"{side}{size}-{i}" for i in range(100)])) for k, side in enumerate("lr")]
    got = bytes_dedup.dedup_bytes(frame(spark, rows)).collect()
    want = plain.bytes_removed([t for _, t in rows], 400)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], plain.sha(bytes(r["kept"]))) for r in got) == sorted((i, *w) for (i, _), w in zip(rows, want))
    assert [r["n_removed"] for r in sorted(got)] == [0, 0, 400, 400, 401, 401]


def test_repeat_in_a_text_of_a_megabyte(spark):
    """Two grams of this passage have hashes alike in their high 43 bits, both less than all others': its anchor is the same in a short text and in a long one."""
    left = "h    pbx lmiqjtsohqomnpyy wevqrut cme jbgvhubyda g krhfgstxtapnnj  auuizvzw wa rw f xniya yr ygr khhavxnozxpuy ubgijjeslkvlhlxvw"
    right = "yamyapksrs  nvophxvljbnghrlv  qqd o cjnli zjegmdgh bhynoxnnxvx be b rnmzpssvve mjel a ld rbnhgdkypojxqmnrrpvbwxm hmmqg c teobytf"
    rng = np.random.default_rng(1)
    other = lambda n: (rng.integers(0, 26, n) + 97).astype(np.uint8).tobytes().decode()
    passage = left + right + other(144)
    rows = [(1, other(20) + "1" + passage + "1" + other(20)), (2, other(1 << 20) + "2" + passage + "2" + other(20)), (3, other(2000))]
    got = sorted(bytes_dedup.dedup_bytes(frame(spark, rows)).collect())
    assert [(r["n_removed"], r["n_spans"]) for r in got] == [(400, 1), (400, 1), (0, 0)]
    assert [bytes(r["kept"]).decode() for r in got] == [t.replace(passage, "") for _, t in rows]


def test_pieces_keep_equal_windows_together():
    """Split at every size: equal windows share a group, each window is in one piece, and a piece of one place is a window."""
    from millrace.llm.anchors import segments, split

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, f, kind):  # noqa: N802
            return next(f(iter([self.batch])))

    rng = np.random.default_rng(8)
    values = rng.integers(0, 3, 400).astype(np.uint64)
    shape = Shape(True, 20, 6)
    _, h, ctx, start, end, anchor = segments(values, np.array([0, 400]), shape)
    import pyarrow as pa

    rows = Rows()
    ints = [x.astype(np.int64) if x.dtype != np.uint64 else x.view(np.int64) for x in (h, ctx, np.ones(len(h), np.int64), np.zeros(len(h), np.int64), anchor - start)]
    rows.batch = pa.RecordBatch.from_arrays([*map(pa.array, ints), pa.array([values[a:b].tobytes() for a, b in zip(start, end)], pa.binary())], names=["h", "ctx", "n", "first", "lead", "symbols"])
    for size in (15, 7, 3, 1):
        groups, seen = {}, 0
        for r in split(rows, shape, size).to_pylist():
            raw = np.frombuffer(r["symbols"], np.uint64)
            assert size > 1 or len(raw) == 20
            for w in range(len(raw) - 19):
                groups.setdefault(raw[w : w + 20].tobytes(), set()).add(r["g"])
                seen += 1
        assert seen == 400 - 19 and all(len(g) == 1 for g in groups.values())


@pytest.mark.parametrize("f", [substring.dedup, bytes_dedup.dedup_bytes])
def test_empty_tables(spark, f):
    assert f(frame(spark, [])).count() == 0
    assert f(frame(spark, [(1, None)])).first()["n_removed"] == 0


def test_automaton():
    rng = np.random.default_rng(3)
    strings = [[int(x) for x in rng.integers(0, 3, rng.integers(1, 25))] for _ in range(12)]
    a = substring.Automaton()
    for label, s in enumerate(strings):
        a.add(s, label)
    a.close()
    for s in strings + [[0, 1, 2, 0, 1, 9, 2, 2]]:
        for end, (n, least) in enumerate(a.statistics(s, 4), 1):
            longest = max(k for k in range(end + 1) if any(s[end - k : end] == t[j : j + k] for t in strings for j in range(len(t) - k + 1)))
            assert n == longest
            if n >= 4:
                assert least == min(i for i, t in enumerate(strings) if any(t[j : j + 4] == s[end - 4 : end] for j in range(len(t))))


def test_interval_expansion():
    rng = np.random.default_rng(4)
    for least in (1, 2, 5):
        parts = [rng.integers(0, 2, rng.integers(1, 30)) + 100 for _ in range(4)]
        symbols = np.concatenate([np.append(p, i) for i, p in enumerate(parts)])
        weight = np.ones(len(symbols), np.int64)
        got = set(bytes_dedup.expand(symbols, weight, 100, least).tolist())
        strings = [tuple(symbols[i : i + least]) for i in range(len(symbols) - least + 1)]
        want = {i for i, s in enumerate(strings) if min(s) >= 100 and strings.count(s) > 1}
        assert got == want


def test_span_hashes_do_not_depend_on_place():
    v = np.arange(50, dtype=np.uint64) % np.uint64(7)
    a = spans_hash(v, np.array([0, 7]), np.array([5, 12]), 3)
    assert a[0] == a[1]


def test_registered_queries(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_suffix_array_dedup"](spark, sf_dir).collect()}
    for (i, _), w in zip(docs, plain.bytes_removed([t for _, t in docs], 400)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == w
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_substring_dedup"](spark, sf_dir).collect()}
    for (i, _), w in zip(docs, plain.substring(docs, 50)):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == w
    assert F
