"""Language id, decontamination, WARC, personal data, search, mixing, language model."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import plain
import pytest

from millrace.llm import decontaminate, langid, language_model, maxscore, mixing, pii, queries, warc
from millrace.llm.shared import part_names, stored
from millrace.llm.text import places
from millrace.storage import shared_dir

# --- language id


def test_languages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").join(queries.QUERIES["op3_language_id"](spark, sf_dir), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1


def test_language_edges(spark):
    train = spark.createDataFrame([("en", "the thing that then"), ("en", None), (None, "zzz"), ("fr", "les eaux des îles")] * 3, "lang string, text string")
    prototypes = langid.learn(train)
    assert sorted(prototypes) == ["en", "fr"]
    rows = [(1, None), (2, ""), (3, "12 !? 34"), (4, "THAT thing"), (5, "des eaux"), (6, "the " * 50000), (7, "中文"), (None, "then")]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), prototypes).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0
    assert got[4]["lang_pred"] == "en" and got[5]["lang_pred"] == "fr" and got[6]["lang_pred"] == "en" and got[None]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in langid.predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), {}).collect()} == {"und"}
    assert langid.learn(train.limit(0)) == {}


def test_letters_of_the_highest_planes(spark):
    assert langid.letters()[0x30000] == 0x30000 and langid.letters()[0x31350] == 0x31350
    prototypes = langid.learn(spark.createDataFrame([("en", "the thing"), ("zh", "\U00030000\U00030001\U00031350" * 9)], "lang string, text string"))
    got = langid.predict(spark.createDataFrame([(1, "\U00030000\U00030001\U00031350")], "doc_id long, text string"), prototypes).first()
    assert got["lang_pred"] == "zh" and got["score"] > 0


def test_binding():
    """The vector of a run is the product of permuted letter vectors; unlike runs are nearly orthogonal."""
    runs = langid.Runs()
    a, b = langid.run_vectors(np.array([97 << 42 | 98 << 21 | 99, 99 << 42 | 98 << 21 | 97]))
    assert (a == np.roll(langid.letter_vector(97), 2) * np.roll(langid.letter_vector(98), 1) * langid.letter_vector(99)).all()
    assert abs(int(a.astype(int) @ b)) < 200
    import pyarrow as pa

    _, v, some = next(langid.text_vectors(pa.array(["ab"]), runs))
    want = langid.run_vectors(np.array([97 << 21 | 98, 97 << 42 | 98 << 21])).astype(int).sum(axis=0)
    assert (v[0] == want).all() and some.tolist() == [True]


def plain_vector(text):
    """The sum of a text's bound runs, letter by letter; None without letters."""
    s = [0, *(ord(c.lower()[0]) if c.isalpha() else 0 for c in text or ""), 0]
    s = [x for i, x in enumerate(s) if i == 0 or x or s[i - 1]]
    if not any(s):
        return None
    letter = {x: langid.letter_vector(x).astype(int) for x in set(s)}
    return sum(np.roll(letter[a], 2) * np.roll(letter[b], 1) * letter[c] for a, b, c in zip(s, s[1:], s[2:]))


def test_predictions_against_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(langid, "BUNDLE", 50)
    monkeypatch.setattr(langid, "HELD", 60)
    train = [("en", "the cat and the dog then sat"), ("de", "der Hund und die Katze saßen"), ("fr", "le chat et le chien étaient là"), ("en", "this that THOSE"), ("fr", None), (None, "xyz")]
    probes = ["the hound", "die Hündin", "les chiens", "", None, "123", "x", "日本 語", "a1b2 c3", "Then der là " * 30, "ﬁn İi ẞ"]
    unit = {}
    for lang in ("de", "en", "fr"):
        v = sum(plain_vector(t) for x, t in train if x == lang and t)
        unit[lang] = v / np.linalg.norm(v)
    middle = sum(unit.values()) / 3
    middle = middle / np.linalg.norm(middle)
    off = lambda v: (lambda w: w / np.linalg.norm(w))(v - (v @ middle) * middle)
    df = spark.createDataFrame(list(enumerate(probes)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in langid.predict(df, langid.learn(spark.createDataFrame(train, "lang string, text string"))).collect()}
    for i, t in enumerate(probes):
        v = plain_vector(t)
        if v is None:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        cosine = {lang: float(off(v) @ off(u)) for lang, u in unit.items()}
        best = max(sorted(cosine), key=cosine.get)
        assert got[i]["lang_pred"] == best and math.isclose(got[i]["score"], max(0.0, cosine[best]), abs_tol=1e-9), t


# --- decontamination


def test_contained(spark, sf_dir, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_found"]) for r in queries.QUERIES["op4_decontaminate"](spark, sf_dir).collect()}
    assert got == plain.contained(docs, items) and got


def test_partial_containment_and_edges(spark):
    rng = random.Random(1)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(n))) for k, n in enumerate((1, 3, 5, 6, 9, 20, 57, 130))] + [(90, None), (91, ""), (None, "a b c")]
    rows = []
    for i in range(60):
        w = items[rng.randrange(8)][1].split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"z{rng.random()}"
        rows.append((i, " ".join([f"a{rng.random()}" for _ in range(30)] + w + [f"b{rng.random()}" for _ in range(30)])))
    rows += [(100, None), (101, ""), (102, "i0w0"), (103, "I1W0 i1w1 i1w2"), (None, items[5][1]), (104, "x " * 40000)]
    d = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, item_id string").drop("item_id")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_found"]) for r in decontaminate.contained(d, b).collect()}
    assert got == plain.contained([r for r in rows if r[0] is not None], [x for x in items if x[0] is not None])
    assert decontaminate.contained(d.limit(0), b).count() == 0 and decontaminate.contained(d, b.limit(0)).count() == 0
    assert decontaminate.clean(d, b).count() == len(rows) - len({i for i, _ in got})


def test_clean_looks_for_items_without_id(spark):
    items = [(None, "one two three four five six"), (None, "red green blue white black grey"), (1, "a b c d e f")]
    rows = [(1, "x one two three four five six y"), (2, "x red green blue white black grey"), (3, "a b c d e f"), (4, "one two three red green blue")]
    left = decontaminate.clean(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert [r["doc_id"] for r in left.collect()] == [4]


def test_decontamination_runs_no_python(spark, sf_dir):
    plan = queries.QUERIES["op4_decontaminate"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- WARC


def test_archives(spark, sf_dir, tmp_path):
    pages = [(1, "http://a/ b", "x" * 200), (2, None, "x" * 200), (3, "u", "y" * 50), (4, "u", "y" * 50), (5, "u", None), (6, "u", ""), (7, "u", "é\r\n\r\n" * 100000), (0, "u\r\nX: y", "x" * 200), (0, "u", "x" * 200), (None, "u", "x" * 200)]
    df = spark.createDataFrame([(p, u, h, 9) for p, u, h in pages], "page_id long, url string, html string, digest int")
    archives = warc.write_archives(df, size=1000)
    assert archives.count() > 1
    rows = warc.read_archives(archives).collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"]) for r in rows) == sorted((str(p), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for p, _, h in pages)
    assert sorted((r["page_id"], r["refers_to"]) for r in rows if r["record_type"] == "revisit") == [(1, 0), (2, 0)]
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0
    files = warc.export(archives, str(tmp_path / "w"))
    back = [r for f in files for r in warc.read_archive(open(f, "rb").read())]
    assert len(back) == len(pages) and sum(len(r.payload) for r in back if r.headers["warc-type"] == "response") == sum(len((h or "").encode()) for p, _, h in pages if p not in (1, 2))


def test_damaged_archives():
    one = warc.page_member(1, "http://a", b"payload" * 20, None)
    assert [r.payload for r in warc.read_archive(one + one)] == [b"payload" * 20] * 2
    with pytest.raises(ValueError):
        list(warc.read_archive(one + one[:-5]))
    with pytest.raises(ValueError):
        list(warc.read_archive(one[:40] + bytes([one[40] ^ 1]) + one[41:]))
    bad = warc.member([("WARC-Type", "response"), ("WARC-Block-Digest", "sha256:00")], b"x")
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_archive(bad))
    for bad in (b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n", b"WARC/1.1\r\nContent-Length: 2\r\n\r\nabc\r\n\r\n", b"WARC/1.1\r\n\r\nabc\r\n\r\n", b"GET /\r\n\r\n", b"WARC/1.1\r\nConte"):
        with pytest.raises(ValueError):
            list(warc.read_archive(gzip.compress(bad)))
    with pytest.raises(ValueError):
        list(warc.read_archive(b"not gzip"))
    assert list(warc.read_archive(b"")) == []


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_records_are_framed_by_length_across_members(monkeypatch, piece):
    """Two records in a member, a record over two members, and one over many pieces; blocks that look like headers."""
    monkeypatch.setattr(warc, "PIECE", piece)
    blocks = [b"one", b"", b"a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nb", bytes(range(256)) * 9]
    raw = [zlib.decompress(warc.member([("WARC-Type", "resource"), ("WARC-Record-ID", f"<{i}>"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(b).hexdigest()}")], b), 31) for i, b in enumerate(blocks)]
    whole = b"".join(raw)
    cut = len(raw[0]) + len(raw[1]) + len(raw[2]) // 2
    for data in (gzip.compress(whole), gzip.compress(raw[0] + raw[1]) + gzip.compress(raw[2] + raw[3]), gzip.compress(whole[:cut]) + gzip.compress(whole[cut:]), b"".join(map(gzip.compress, raw))):
        assert [(r.headers["warc-record-id"], r.block) for r in warc.read_archive(data)] == [(f"<{i}>", b) for i, b in enumerate(blocks)]
        with pytest.raises(ValueError):
            list(warc.read_archive(data[:-9]))


def test_files_of_any_writer(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", "x" * (90 * i)) for i in range(12)], "page_id long, url string, html string")
    warc.export(warc.write_archives(pages, size=500), str(tmp_path))
    other = b"".join(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 2\r\nWARC-Block-Digest: sha1:ABC\r\n\r\nhi\r\n\r\n" for _ in range(2))
    (tmp_path / "other.warc.gz").write_bytes(gzip.compress(other))
    rows = warc.read_files(spark, str(tmp_path)).collect()
    assert sorted(len(r["payload"]) for r in rows) == sorted([90 * i for i in range(12)] + [2, 2])
    assert [r["place"] for r in rows if r["path"].endswith("other.warc.gz")] == [0, 1] and all(r["payload_digest"] == hashlib.sha256(r["payload"]).hexdigest() for r in rows)


# --- personal data

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base_plain(text):
    def luhn(d):
        return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = []
    for n, kind in enumerate(BASE):
        for m in BASE[kind].finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((n, m.start(), m.end()))
    return out


def test_patterns_on_random_text():
    rng = random.Random(7)
    alphabet = ["@", ".", "+", "-", " ", "a", "B", "_", "é", "1", "9", "0", "4", "(", ")", "255", "300", "1.2.3.4", "a@b.co", "4111 1111 1111 1111", "+1 (555) 123-4567", "\n"]
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 25)))
        assert pii.base_spans(t) == base_plain(t), t


def test_personal_data_query(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_personal_data"](spark, sf_dir).collect()}
    for i, t in docs:
        base, r = base_plain(t or ""), got[i]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == n for x in base) for n in range(4)]
        assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(filter(None, pii.joined(base).split(","))) <= set(r["spans"].split(","))


def test_field():
    field = pii.trained()
    table = pii.examples(300, seed=77)
    got = field.decode([w for w, _ in table])
    assert sum(a == b for a, (_, b) in zip(got, table)) >= 0.95 * len(table)
    text = "call +1 (269) 555-3296 4524132264652876 now, or x.71@mail0.example.com. 3.5 of 12"
    base, every = next(pii.found([text], field))
    kinds = Counter(k for k, _, _ in every)
    assert set(base) <= set(every) and kinds[2] == 1 and kinds[3] == 1 and kinds[0] == 1
    assert field.decode([]) == [] and pii.windows("no digits here") == []


def test_viterbi_is_the_best_path():
    import itertools

    field = pii.trained(pii.examples(60))
    words = ["to", "+1", "(555)", "123-4567"]
    ids, there, free = field.table([words])
    e, m = field.scores(ids, free)[0], field.moves + pii.allowed()
    e[0, 2::2] = -np.inf
    best = max(itertools.product(range(pii.STATES), repeat=4), key=lambda p: sum(e[i, s] for i, s in enumerate(p)) + sum(m[a, b] for a, b in zip(p, p[1:])))
    assert field.decode([words])[0] == list(best)


#: Forms that the labelled table does not make, each with its kind and the span that a reader would mark; and numbers that are no personal data.
OTHER_FORMS = [
    ('Please ring 020 7946 0958 after six', 'phone', '020 7946 0958'),
    ('Fax: 555.867.5309, ask for Ann', 'phone', '555.867.5309'),
    ('Tel 030/1234567 in Berlin', 'phone', '030/1234567'),
    ('her number is 415-555-2671 I think', 'phone', '415-555-2671'),
    ('call 1-800-555-0199 toll free', 'phone', '1-800-555-0199'),
    ('+33 1 42 68 53 00 is the Paris desk', 'phone', '+33 1 42 68 53 00'),
    ('(0)171 555 0123 works too', 'phone', '(0)171 555 0123'),
    ('write to john.doe@company.co.uk today', 'email', 'john.doe@company.co.uk'),
    ('contact <info@museum.org> for tickets', 'email', 'info@museum.org'),
    ('mailto:sales@shop.io?subject=hi', 'email', 'sales@shop.io'),
    ('root@localhost got the log', 'email', 'root@localhost'),
    ("Bob's is bob(at)example.org, 2 of them", 'email', 'bob(at)example.org'),
    ('server 10.0.0.1:8080 is down', 'ip', '10.0.0.1'),
    ('ping 192.168.1.254/24 twice', 'ip', '192.168.1.254'),
    ('from [172.16.0.9] at 12:30', 'ip', '172.16.0.9'),
    ('fe80::1ff:fe23:4567:890a is link local', 'ip', 'fe80::1ff:fe23:4567:890a'),
    ('Visa 4111-1111-1111-1111 exp 12/27', 'card', '4111-1111-1111-1111'),
    ('amex 3782 822463 10005 on file', 'card', '3782 822463 10005'),
    ('card: 5500 0000 0000 0004 please', 'card', '5500 0000 0000 0004'),
    ('pan 6011000990139424, cvv 123', 'card', '6011000990139424'),
]
OTHER_NUMBERS = [
    'It rained on 14 days in 2021 and 365.25 is a year',
    'see pages 123-145 of vol. 12, 1998',
    'ISBN 978-3-16-148410-0 costs $29.99',
    'at 12:30:45 on 2024-05-17 we left',
    'the score was 3-2, 101-99 and 7.5',
    'version 2.10.3 fixes issue #4521',
    'room 4021, floor 12, gate B17',
    'population 1,234,567 in 1990',
    'pi is 3.14159265358979',
    'order 00012345678 shipped',
]


def test_forms_that_the_table_does_not_make():
    """Patterns find 10 of the 20, the field two more; it marks one of ten sentences without personal data (figures in the README)."""
    field, hits = pii.trained(), []
    for text, kind, span in OTHER_FORMS:
        base, every = next(pii.found([text], field))
        a = text.index(span)
        hits.append([any(k == pii.KINDS.index(kind) and lo <= a and a + len(span) <= hi for k, lo, hi in spans) for spans in (base, every)])
    assert sum(base for base, _ in hits) == 10 and sum(every for _, every in hits) >= 12
    assert sum(bool(next(pii.found([text], field))[1]) for text in OTHER_NUMBERS) <= 1


def test_windows():
    """Runs are the words near those with digits, and a word more on each side."""
    rng = random.Random(5)
    for _ in range(300):
        text = " ".join(rng.choice(["a", "b,", "é", "7"] if rng.random() < 0.3 else ["a", "b,", "é"]) for _ in range(rng.randrange(0, 60)))
        words = [(m.start(), m[0]) for m in re.finditer("[^ ]+", text)]
        hot = [i for i, (_, w) in enumerate(words) if w == "7"]
        near = [i for i in range(len(words)) if any(abs(i - h) <= pii.REACH + 1 for h in hot)]
        runs = pii.windows(text)
        assert [w for run in runs for w in run] == [words[i] for i in near]
        assert len(runs) == sum(i - 1 not in near for i in near)


def test_long_runs_are_decoded_in_bounded_memory(monkeypatch):
    import tracemalloc

    field, texts = pii.trained(), ["12 " * 3000] + ["call 5 +1 (269) 555-3296 y"] * 511
    tracemalloc.start()
    got = list(pii.found(texts, field))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64 << 20
    assert [i for part in pii.batches([3, 9, 1]) for i in part] == [2, 0, 1] and list(pii.batches([])) == []
    monkeypatch.setattr(pii, "CELLS", 1)  # each run by itself
    assert list(pii.found(texts[:20], field)) == got[:20]


def test_masking(spark):
    rows = [(1, "mail a.b@c.de now", "en", "s", 17), (2, None, None, None, None), (3, "nothing", "en", "s", 7), (3, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = pii.masked(df).orderBy("doc_id", "n_chars").collect()
    assert [r["text"] for r in got] == ["mail [EMAIL] now", None, "", "nothing"] and got[0]["n_chars"] == 16 and got[1]["n_chars"] is None
    assert pii.masked(df.limit(0)).count() == 0 and pii.personal_data(df.limit(0)).count() == 0


# --- search


@pytest.mark.parametrize("shard_rows", [7, 1000])
def test_top_k(spark, shard_rows):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    rows += [(60, rows[0][1]), (61, [1.0, None]), (62, None), (63, [float("nan")] * 6), (64, [float("inf")] * 6), (65, []), (66, [2.0, 2.0]), (0, [0.5] * 6), (None, [9.0] * 6), (67, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    got = {}
    for r in maxscore.top_k(df, df.filter("vec_id % 10 = 3"), 5, shard_rows=shard_rows).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = {}
    for q, v in good:
        if q % 10 == 3:
            best = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in good if i != q)[:5]
            want[q] = [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert {q: sorted(x) for q, x in got.items()} == want
    assert maxscore.top_k(df.limit(0), df).count() == 0 and maxscore.top_k(df, df.limit(0)).count() == 0
    few = df.filter("vec_id in (3, 4)")
    assert maxscore.top_k(few, few, 5).count() == 2


def test_essential_terms(monkeypatch):
    """Against all scores, with ties; non-essential postings of vectors that can't win are not probed."""
    monkeypatch.setattr(maxscore, "MEET", 50)
    rng = np.random.default_rng(5)
    skew = rng.integers(-2, 3, (1500, 24)).astype(float)
    skew[:, :4] = rng.integers(-300, 300, (1500, 4))
    for vectors in (skew, rng.integers(-3, 4, (400, 8)).astype(float), np.zeros((60, 5)), np.ones((5, 3))):
        owners = np.sort(rng.integers(0, 2000, len(vectors)))
        shard = maxscore.Shard(vectors, owners)
        for q in [*vectors[:20], -vectors[1] * 3]:
            ids, scores = shard.top(q, owners[3], 10)
            every = sorted((-int(v @ q), int(i)) for v, i in zip(vectors, owners) if i != owners[3])[:10]
            assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist())] == every
        assert [x.tolist() for x in shard.whole(vectors[0], owners[3], 10)] == [x.tolist() for x in shard.top(vectors[0], owners[3], 10)]
        if vectors is skew:
            assert shard.skipped > 2 * shard.probed


def test_scores_beyond_doubles():
    vectors = np.array([[2.0**29, 1.0], [2.0**29, 2.0], [-(2.0**29), 5.0]])
    ids, scores = maxscore.Shard(vectors, np.array([1, 2, 3])).top(np.array([2.0**29, 1.0]), 0, 2)
    assert ids.tolist() == [2, 1] and scores.tolist() == [2**58 + 2, 2**58 + 1]
    with pytest.raises(OverflowError):
        maxscore.Shard(np.array([[2.0**40]]), np.array([1])).top(np.array([2.0**40]), 0, 1)


def test_blocks_of_queries_meet_every_shard(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [sorted(map(tuple, maxscore.top_k(df, df.filter("vec_id % 3 = 0"), 4, shard_rows=s, block_rows=b).collect())) for s, b in ((1000, 1000), (20, 7))]
    assert got[0] == got[1] and len(got[0]) == 120


# --- mixing


def test_targets():
    assert mixing.targets({"a": 100}) == {"a": 100.0}
    t = mixing.targets({"b": 1000, "a": 10, None: 500, "c": 490})
    assert t["a"] == 30 and abs(sum(t.values()) - 2000) < 1e-9 and all(t[s] <= 3 * n for s, n in {"b": 1000, "a": 10, None: 500, "c": 490}.items())
    assert abs(t["b"] / t["c"] - 2) < 1e-9
    assert mixing.targets({"a": 0, "b": 0}) == {"a": 0.0, "b": 0.0} and mixing.targets({}) == {}


def test_schedule(spark):
    shares, n = [0.5, 0.2, 0.3], 200_000
    rows = mixing.schedule(spark, n, shares).toPandas().sort_values("slot")
    assert rows["slot"].tolist() == list(range(n))
    ends = np.cumsum(shares)
    points = [((i + 1) * mixing.GOLDEN % 2**64) / 2**64 for i in range(0, n, 997)]
    assert rows["source"].tolist()[::997] == [int(min(np.searchsorted(ends, p, side="right"), 2)) for p in points]
    for s, share in enumerate(shares):
        ranks = rows.loc[rows["source"] == s, "rank"].tolist()
        assert ranks == list(range(len(ranks))) and abs(len(ranks) - share * n) < 10


def test_mix(spark, sf_dir):
    rows = queries.QUERIES["op8_mix_sources"](spark, sf_dir).collect()
    sizes = {r["doc_id"]: len(plain.words(r["text"])) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    taken, aim, own = Counter(), {}, Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        own[r["source"]] += r["size"]
        aim[r["source"]] = (r["target"], r["source_size"])
    want = mixing.targets(dict(own))
    for s, (target, size) in aim.items():
        assert size == own[s] and target == want[s] and abs(taken[s] - target) <= 3 * 128
    again = queries.QUERIES["op8_mix_sources"](spark, sf_dir).collect()
    assert {r["doc_id"]: r["taken"] for r in rows} == {r["doc_id"]: r["taken"] for r in again}


def plain_mix(spark, rows, per_bucket=256):
    """(id, source, words) -> words taken of each row, by laying out each source's line and going through the slots one by one."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, s, n) for i, s, n in rows], "doc_id long, source string, size long")
    at = [r["at"] for r in df.coalesce(1).select(F.xxhash64("doc_id", "size", F.lit(7)).alias("at")).collect()]
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    aims, names = mixing.targets(dict(sizes)), sorted(sizes, key=lambda s: (s is None, s or ""))
    total, buckets = sum(sizes.values()), -(-len(rows) // per_bucket)
    lines = {s: [k for k in sorted(range(len(rows)), key=lambda k: (at[k] % buckets, at[k], rows[k][0])) if rows[k][1] == s for _ in range(rows[k][2])] * 3 for s in names}
    ends, so_far = [], 0.0
    for s in names:
        so_far += aims[s]
        ends.append(so_far)
    used, taken = Counter(), Counter()
    for i in range(-(-total // 128)):
        point = (i + 1) * 0x9E3779B97F4A7C15 % 2**64
        s = next((s for s, e in zip(names, ends) if point < int(e / so_far * 2**64)), names[-1])
        taken.update(lines[s][128 * used[s] : 128 * used[s] + 128])
        used[s] += 1
    return [taken[k] for k in range(len(rows))]


def test_mix_against_a_plain_version(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["web", "web", "web", "books", "code", None]), rng.choice([0, 1, 5, 40, 127, 128, 129, 700])) for i in range(700)] + [(900, "tiny", 50)]
    docs = spark.createDataFrame([(i, s, "w " * n, f"about {i}", n) for i, s, n in rows], "doc_id long, source string, text string, size string, row long")
    got = {r["doc_id"]: r for r in mixing.mix_sources(docs).collect()}
    assert [got[i]["taken"] for i, _, _ in rows] == plain_mix(spark, rows)
    texts = {r["doc_id"]: (r["taken"], r["text"], r["row"]) for r in mixing.mix_sources(docs, keep=("text", "row")).collect()}
    assert texts == {i: (got[i]["taken"], "w " * n, n) for i, _, n in rows}


def test_sums_ahead(spark):
    rows = [(g, i * 3, (i * 7) % 5) for g in "ab" for i in range(100)]
    got = mixing.summed_ahead(spark.createDataFrame(rows, "g string, o long, v long"), ["g"], "o", "v", "s", width=16).collect()
    assert sorted((r["g"], r["o"], r["s"]) for r in got) == sorted((g, o, sum(v for h, p, v in rows if h == g and p < o)) for g, o, _ in rows)


def test_mix_edges(spark):
    schema = "doc_id long, source string, text string, block int"
    rows = [(1, "a", "x " * 3000, 1), (2, "a", None, 1), (3, None, "y " * 2000, 1), (3, None, "y " * 2000, 1), (None, "b", "z", 1), (5, "", "w " * 10, 1)]
    got = mixing.mix_sources(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6 and all(r["taken"] <= 3 * r["size"] for r in got)
    assert {r["source"]: r["source_size"] for r in got} == {"a": 3000, None: 4000, "b": 1, "": 10}
    assert mixing.mix_sources(spark.createDataFrame([], schema)).count() == 0
    assert [r["taken"] for r in mixing.mix_sources(spark.createDataFrame([(1, "a", None, 1)], schema)).collect()] == [0]


def test_small_sources_get_whole_slots(spark):
    sizes = {"a": 100, "b": 5000, "c": 130, "d": 10, "e": 100, "f": 129, "g": 3000, "h": 257, "i": 1}
    rows = [(i, s, "w " * n) for i, (s, n) in enumerate(sizes.items())]
    got = {r["source"]: r["taken"] for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    aims, names = mixing.targets(sizes), sorted(sizes)
    slots = Counter(names[r["source"]] for r in mixing.schedule(spark, -(-sum(sizes.values()) // 128), [aims[s] for s in names]).collect())
    assert got == {s: min(128 * slots[s], 3 * n) for s, n in sizes.items()}


# --- language model


def test_scores(spark, sf_dir, docs):
    rows = queries.QUERIES["op10_language_model"](spark, sf_dir)
    got = {r["doc_id"]: r for r in rows.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    tokens = {i: plain.words(t, lower=True) + [None] for i, t in docs}
    count = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, kinds = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + kinds + 1)) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0
    p = {r["held_out"]: r for r in language_model.perplexity(rows).collect()}
    assert p[True]["perplexity"] < 0.9 * p[True]["base_perplexity"]


def words_and_contexts(texts):
    import pyarrow as pa

    parts = list(language_model.pieces([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])], 0))
    return [np.concatenate(x) for x in zip(*((w, language_model.contexts_of(w, f), r) for w, r, f in parts))]


class PlainModel:
    """The seating of a learned model, gathered in dictionaries, and its predictions worked out pair by pair."""

    def __init__(self, model, texts):
        w, u, _ = words_and_contexts(texts)
        self.m, self.count, self.counts = model, Counter(zip(u.tolist(), w.tolist())), Counter(w.tolist())
        several = sorted((int(model.part_of(np.array([b], np.uint64), np.array([a], np.uint64))[0]), b >> 62, b, a) for (a, b), n in self.count.items() if n > 1)
        names, seats = part_names(model.parts), {(r["part"], r["n"]): language_model.unsqueezed(bytes(r["u"])).tolist() for r in model.seats.collect()}
        self.tables, self.of, self.customers, self.opened = [], [], [], []
        for k, state in enumerate(model.kept):
            t = {pair: 1 for pair in self.count}
            for part, slice in sorted({x[:2] for x in several}):
                mine = [x[2:] for x in several if x[:2] == (part, slice)]
                got = seats[int(names[part]), (k + 1) * language_model.SLICES + slice]
                assert len(got) == len(mine)
                t |= {(a, b): n for (b, a), n in zip(mine, got)}
            assert all(1 <= t[x] <= self.count[x] for x in t)
            of, customers = Counter(), Counter()
            for (a, b), n in t.items():
                of[a] += n
                customers[b] += n
            known = sorted(customers)
            opened = dict(zip(known, model.seat_root(state, np.array(known, np.uint64), np.array([customers[b] for b in known])).tolist())) if known else {}
            assert model.root_customers[state] == sum(customers.values()) and model.root_tables[state] == sum(opened.values())
            self.tables.append(t)
            self.of.append(of)
            self.customers.append(customers)
            self.opened.append(opened)

    def probability(self, u, w):
        (d0, d1), (s0, s1), m, p = self.m.discounts, self.m.strengths, self.m, 0
        for k, state in enumerate(m.kept):
            parent = (self.customers[k].get(w, 0) - d0 * self.opened[k].get(w, 0) + (s0 + d0 * m.root_tables[state]) / (m.kinds + 1)) / (s0 + m.root_customers[state])
            own = self.count.get((u, w), 0) - d1 * self.tables[k].get((u, w), 0)
            p += (own + (s1 + d1 * self.of[k].get(u, 0)) * parent) / (s1 + self.counts.get(u, 0))
        return p / m.samples


def some_texts(seed, n=60, words="abcdefg"):
    rng = random.Random(seed)
    return ["the " * rng.randrange(0, 400) + " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


def test_scores_against_a_plain_model(spark):
    """Probabilities sum to one after every context, and what Spark sums for a text are their logarithms."""
    texts = [*some_texts(2), None, ""]
    model = language_model.learn(spark.createDataFrame([(t,) for t in texts], "text string"), 3)
    assert len(model.common)
    plain_model = PlainModel(model, texts)
    assert max(plain_model.count.values()) > language_model.EXACT
    end, unseen = int(language_model.END), 12345
    for u in {*plain_model.counts, unseen}:
        assert abs(sum(plain_model.probability(u, w) for w in [*plain_model.counts, unseen]) - 1) < 1e-9
    probes = ["", "a", "a b", "never a never never b the", "the the", "g f e d c b a", "new words only"]
    rows = [(k, 0, t) for k, t in enumerate(probes)] + [(1000 + k, 1, t) for k, t in enumerate(texts)]
    out = {r["key"]: r["score"] for r in language_model.score(spark.createDataFrame(rows, "key long, learned long, text string"), model).collect()}
    for k, _, t in rows:
        w, u, _ = words_and_contexts([t])
        want = sum(math.log10(plain_model.probability(a, b)) for a, b in zip(u.tolist(), w.tolist()))
        assert math.isclose(out[k], want, rel_tol=1e-9), (k, t)
    assert end in plain_model.counts


def test_scores_do_not_depend_on_partitions(spark):
    rows = [(i, t) for i, t in enumerate(some_texts(3, 80, "abcdefghijklmnopqrstuvwxyz"))] + [(500, "x y z"), (501, "unheard of")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [{r["doc_id"]: (r["score"], r["base_score"], r["n_known"]) for r in language_model.score_documents(docs.repartition(n), parts=parts).collect()} for n, parts in ((1, 4), (5, 16), (3, 211))]
    for other in got[1:]:
        for i, (score, base, known) in got[0].items():
            assert math.isclose(other[i][0], score, rel_tol=1e-9) and math.isclose(other[i][1], base, rel_tol=1e-9) and other[i][2] == known


def test_common_words_are_dealt_out_by_context():
    m = language_model.Model(8, 8000, 10, np.array([7], np.uint64), np.array([6000]))
    u = np.arange(1000, dtype=np.uint64)
    parts = m.part_of(np.full(1000, 7, np.uint64), u)
    assert m.shares[0] == 24 and len(set(parts.tolist())) > 4 and (parts == m.part_of(np.full(1000, 7, np.uint64), u)).all()
    assert set(m.part_of(np.full(1000, 9, np.uint64), u).tolist()) == {1}


def test_every_context_has_a_restaurant(spark):
    # more contexts than 16-bit numbers could name
    texts = [" ".join(f"c{i} d{i}" for i in range(lo, lo + 500)) for lo in range(0, 35000, 500)] * 2
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    model = language_model.learn(train, 3)
    customers = {}
    for r in model.totals.collect():
        u = np.frombuffer(r["u"], np.uint64)
        customers |= dict(zip(u.tolist(), np.frombuffer(r["sums"], np.int64).reshape(-1, len(u))[0].tolist()))
    assert len(customers) == 70001 and sum(customers.values()) == 2 * 70 * 1001
    assert sorted(Counter(customers.values()).items()) == [(2, 70000), (140, 1)]
    # each pair was seen twice: after its own context a word is far likelier than after another
    probes = [f"c{i} d{i}" for i in range(0, 35000, 700)] + [f"c{i} d{i + 1}" for i in range(0, 34999, 700)]
    rows = [(k, 0, t) for k, t in enumerate(probes)] + [(1000 + k, 1, t) for k, t in enumerate(texts[:70])] + [(2000 + k, 1, t) for k, t in enumerate(texts[70:])]
    out = {r["key"]: r["score"] for r in language_model.score(spark.createDataFrame(rows, "key long, learned long, text string"), model).collect()}
    assert all(out[k] > out[50 + k] + 2 for k in range(50))


def test_contexts_of_learned_texts_are_not_looked_for_again(spark):
    texts = some_texts(4, 80, "abcdefghijklmnopqrstuvwxyz")
    model = language_model.learn(spark.createDataFrame([(t,) for t in texts], "text string"), 5)
    w, u, _ = words_and_contexts(texts)
    names, rare = part_names(5), ~model.is_common(u)[0]
    want = {(int(names[p]), int(b) >> 63, int(a)) for p, a, b in zip(model.part_of(w, u), u, w)}
    rows = [(r["n"] // 2, r["n"] % 2, int(a)) for r in model.asked.collect() for a in np.frombuffer(r["c0"], np.uint64)]
    common = set(u[~rare].tolist())
    assert common and sorted(x for x in rows if x[2] not in common) == sorted(x for x in want if x[2] not in common)  # each once
    assert set(rows) <= want
    # what is asked besides comes from texts that were not learned: none here, and the scores are those of the plain model
    out = {r["key"]: r["score"] for r in language_model.score(spark.createDataFrame([(k, 1, t) for k, t in enumerate(texts)], "key long, learned long, text string"), model).collect()}
    plain_model = PlainModel(model, texts)
    for k, t in list(enumerate(texts))[::9]:
        w, u, _ = words_and_contexts([t])
        assert math.isclose(out[k], sum(math.log10(plain_model.probability(a, b)) for a, b in zip(u.tolist(), w.tolist())), rel_tol=1e-9)


def test_places():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50000):
        some = rng.integers(0, 2**64, max(1, n // 10), dtype=np.uint64)
        alike = (rng.integers(0, 8, n).astype(np.uint64) << np.uint64(61)) | rng.integers(0, 1000, n).astype(np.uint64)  # the same leading bits
        for keys in (rng.integers(0, 2**64, n, dtype=np.uint64), some[rng.integers(0, len(some), n)], alike, np.full(n, 2**64 - 1, np.uint64)):
            group = rng.integers(0, 51, n)
            assert (places(keys) == np.argsort(keys, kind="stable")).all() and (places(keys, group) == np.lexsort((keys, group))).all()
            assert (language_model.pair_places(keys, alike) == np.lexsort((alike, keys))).all()


def drawn(count, weight, rest=0.0, strength=1.0, discount=0.8, n=40000):
    key = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return language_model.tables(np.full(n, count), np.full(n, rest), np.full(n, weight), strength, discount, key, 7)


def test_seating():
    count = np.array([0, 1, 2, 5, 256, 257, 5000, 10**7])
    key, rest = np.arange(8, dtype=np.uint64), np.zeros(8)
    low, high = (language_model.tables(count, rest, np.full(8, w), 1.0, 0.8, key, 1) for w in (1e-12, 1e15))
    assert low.tolist() == [0, 1, 1, 1, 1, 1, 1, 1] and high.tolist() == count.tolist()
    # two customers: apart with weight (s + d) * w against 1 - d
    t = drawn(2, 0.3, strength=0.7, discount=0.5)
    assert abs((t == 2).mean() - 0.36 / (0.36 + 0.5)) < 0.01
    # a few customers: all ways to seat them, by hand: the first table's opening is common to all ways
    s, d, w = 1.5, 0.4, 0.2
    ways = {1: (1 - d) * (2 - d), 2: 3 * (1 - d) * (s + d) * w, 3: (s + d) * w * (s + 2 * d) * w}
    t = drawn(3, w, strength=s, discount=d)
    for k, x in ways.items():
        assert abs((t == k).mean() - x / sum(ways.values())) < 0.01
    # tables of other dishes add to the weight of opening one
    t = drawn(2, 0.01, rest=50.0)
    assert abs((t == 2).mean() - 0.01 * (1 + 0.8 * 51) / (0.01 * (1 + 0.8 * 51) + 0.2)) < 0.01


@pytest.mark.parametrize("count", [200, 250])
@pytest.mark.parametrize("weight", [0.0005, 0.01, 0.2, 5.0])
def test_seating_of_many_customers_is_close_to_the_exact_conditional(monkeypatch, weight, count):
    """Means of the tables, with all Stirling numbers and by each of the other ways, differ by less than 3 %."""
    exact = drawn(count, weight, rest=20.0, n=20000)
    monkeypatch.setattr(language_model, "EXACT", 64)
    other = drawn(count, weight, rest=20.0, n=20000)
    assert abs(other.mean() / exact.mean() - 1) < 0.03
    if exact.mean() > 2:
        assert abs(other.std() / exact.std() - 1) < 0.1


def test_ratios_of_stirling_numbers_beyond_the_table(monkeypatch):
    far = language_model.far(0.8)
    rows = int(round(math.log(4) / language_model.STEP_OF_LOG))
    exact = language_model.stirling(0.8, 4 * language_model.FAR, 40)[4 * language_model.FAR, 1:]
    assert np.allclose(far[rows, :40], exact - exact[0], atol=0.05)


def test_language_model_edges(spark):
    schema = "doc_id long, text string, key int"
    rows = [(1, None, 0), (2, "", 0), (3, "a b", 0), (3, "a b", 0), (None, "A B c", 0), (4, "word " * 50000, 0)]
    got = language_model.score_documents(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted([("1", 1), ("2", 1), ("3", 3), ("3", 3), ("None", 4), ("4", 50001)])
    assert language_model.score_documents(spark.createDataFrame([], schema)).count() == 0
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:1]
    only = language_model.score_documents(spark.createDataFrame([(held[0], "a", 0)], schema)).first()
    assert only["train_tokens"] == 0 and only["n_known"] == 0


# --- shared


def test_each_part_has_a_partition(spark):
    from pyspark.sql import functions as F

    for n in (1, 4, 51, 211):
        names = part_names(n)
        df = spark.createDataFrame([(int(x),) for x in names], "part long").repartition(n, "part").select(F.spark_partition_id().alias("p"))
        assert df.distinct().count() == n


def test_stored_tables(spark):
    df = stored(spark.range(5))
    assert df.count() == 5 and df._stored_at.startswith(shared_dir(spark))
