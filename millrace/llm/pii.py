"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds to them.

Patterns find e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers.  The field labels the words around every
word with a digit or an @ (only there may a label other than O stand) with B/I tags of the four kinds.  Its features are
the shapes of a word and its neighbours.  It is trained on the driver on a small labelled table (`examples`, SENTENCES
rows by default) and decoded by Viterbi, many windows at once.  What it finds is added unless it overlaps a pattern's find.

Null texts are empty; an empty text has no spans.  Rows are judged one by one, so repeated ids repeat their rows.
An empty table gives no rows; other columns are ignored.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import itertools
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded, documents
from .text import chunks

KINDS = ("email", "ip", "card", "phone")
#: Rows of the labelled table that the field is trained on.
SENTENCES = 500
#: Words on each side of one with a digit or an @ that may have a label.
REACH = 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match that fails from the first digit of a run fails from the others too, so a start within a run need not be tried
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(int(x) <= 255 for x in m[0].split(".") if len(x.lstrip("0")) < 4) and all(len(x.lstrip("0")) < 4 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


# --- the field


def shape(word: str) -> tuple[str, str]:
    """Fine shape (letters as one a or A, runs of digits by their length) and coarse shape of a word without the marks after it."""
    core = word.rstrip(".,;:!?\"'")
    fine = re.sub(r"[0-9]+", lambda m: f"<{min(len(m[0]), 20)}>", re.sub(r"[^\W\d_]+", lambda m: "A" if m[0][0].isupper() else "a", core))[:40]
    digits = sum(c.isdigit() for c in core)
    coarse = ("@" if "@" in core else "") + ("n" if digits == len(core) and core else "m" if digits else "w") + ("+" if core.startswith("+") else "(" if core.startswith("(") else "") + ("." if core.count(".") == 3 else "-" if "-" in core else "")
    return fine, coarse


def loaded(word: str) -> bool:
    return "@" in word or any("0" <= c <= "9" for c in word)


STATES = 1 + 2 * len(KINDS)  # O, then B and I of each kind


def allowed() -> np.ndarray:
    """Log of which state may follow which."""
    t = np.zeros((STATES, STATES))
    for k in range(len(KINDS)):
        t[:, 2 + 2 * k] = -np.inf
        t[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return t


def examples(n: int = SENTENCES, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """The labelled table: sentences of invented words with personal data, and with numbers that are none."""
    rng = np.random.Generator(np.random.PCG64(seed))
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    letters = lambda lo, hi: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(lo, hi)))
    pick = lambda *x: x[rng.integers(len(x))]()
    octet = lambda: str(rng.integers(1, 256))

    def card() -> str:
        head = "4" + digits(14)
        return next(head + str(d) for d in range(10) if luhn(head + str(d)))

    def grouped(gap: str) -> str:
        c = card()
        return gap.join(c[i : i + 4] for i in range(0, 16, 4))

    made = {
        0: lambda: pick(lambda: f"{letters(3, 9)}.{digits(2)}@mail{digits(1)}.example.com", lambda: f"{letters(3, 9)}@{letters(3, 8)}.{letters(2, 4)}", lambda: f"{letters(2, 6)}_{letters(2, 6)}+{digits(1)}@{letters(3, 8)}.{letters(2, 4)}.{letters(2, 3)}"),
        1: lambda: f"{octet()}.{octet()}.{octet()}.{octet()}",
        2: lambda: pick(card, lambda: grouped(" "), lambda: grouped("-")),
        3: lambda: pick(lambda: f"+1 ({digits(3)}) 555-{digits(4)}", lambda: f"({digits(3)}) 555-{digits(4)}", lambda: f"+44 20 {digits(4)} {digits(4)}", lambda: f"+49-{digits(3)}-{digits(7)}"),
    }
    plain = (
        lambda: digits(rng.integers(1, 6)), lambda: f"{digits(1)}.{digits(2)}", lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}",
        lambda: f"{letters(2, 6)}{digits(2)}", lambda: f"{digits(1)}.", lambda: f"\"{digits(3)}{letters(3, 5)}{digits(8)}{letters(1, 3)}{digits(4)}\"", lambda: f"{digits(2)}:{digits(2)}",
        lambda: f"({digits(1)})", lambda: f"({digits(4)})", lambda: f"${digits(2)}.{digits(2)}", lambda: digits(rng.integers(8, 13)), lambda: f"@{letters(3, 8)}", lambda: f"{digits(3)}-{digits(2)}", lambda: f"v{digits(1)}.{digits(1)}.{digits(1)}.{letters(1, 3)}",
    )
    filler = lambda: pick(lambda: letters(1, 10), lambda: letters(2, 8).capitalize(), lambda: letters(2, 8) + ",", lambda: letters(2, 8) + ".", lambda: "|", lambda: "=")
    table = []
    for _ in range(n):
        words, tags = [], []
        for _ in range(rng.integers(2, 5)):
            for _ in range(rng.integers(0, 4)):
                words.append(filler())
                tags.append(0)
            if rng.random() < 0.5:
                k = int(rng.integers(len(KINDS)))
                parts = (made[k]() + ("." if rng.random() < 0.15 else "")).split(" ")
                words += parts
                tags += [1 + 2 * k] + [2 + 2 * k] * (len(parts) - 1)
            else:
                words.append(pick(*plain))
                tags.append(0)
        table.append((words, tags))
    return table


class Field:
    def __init__(self, names: dict[str, int]):
        self.names = names
        self.weights = np.zeros((len(names) + 1, STATES))
        self.moves = np.zeros((STATES, STATES))

    @staticmethod
    def features(words: list[str]):
        """Of each word in turn its features."""
        shapes = itertools.chain([("^", "^")], map(shape, words), [("$", "$")])
        around = deque(itertools.islice(shapes, 2), maxlen=3)
        for following in shapes:
            around.append(following)
            before, here, after = around
            yield [f"{p}{f}" for p, (fine, coarse) in zip("<0>", around) for f in (f"f{fine}", f"c{coarse}")] + [f"b{before[1]}|{here[1]}", f"n{here[1]}|{after[1]}"]

    def table(self, sentences: list[list[str]]):
        """Feature numbers, whether a word is there, and whether it may have a label, padded to the longest sentence."""
        long = max(map(len, sentences))
        ids = np.full((len(sentences), long, 8), len(self.names), np.int32)
        there, free = np.zeros((len(sentences), long), bool), np.zeros((len(sentences), long), bool)
        for s, words in enumerate(sentences):
            there[s, : len(words)] = True
            for i, fs in enumerate(self.features(words)):
                ids[s, i] = [self.names.get(f, len(self.names)) for f in fs]
            for i, w in enumerate(words):
                if loaded(w):
                    free[s, max(0, i - REACH) : i + REACH + 1] = True
        return ids, there, free & there

    def scores(self, ids, free) -> np.ndarray:
        e = self.weights[ids[..., 0]]
        for k in range(1, ids.shape[2]):
            e += self.weights[ids[..., k]]
        e[~free] = -np.inf
        e[~free, 0] = 0
        return e

    def train(self, sentences, tags, rounds: int = 80, rate: float = 0.25, decay: float = 1e-4):
        """Gradient ascent on the likelihood, with steps scaled by the gradients so far."""
        ids, there, free = self.table(sentences)
        gold = np.zeros(there.shape, int)
        for s, t in enumerate(tags):
            gold[s, : len(t)] = t
        can, (rows, long) = allowed(), there.shape
        seen_w, seen_m = np.full(self.weights.shape, 1e-8), np.full(self.moves.shape, 1e-8)
        one = np.eye(STATES)[gold] * there[..., None]
        pairs = np.zeros((STATES, STATES))
        np.add.at(pairs, (gold[:, :-1][there[:, 1:]], gold[:, 1:][there[:, 1:]]), 1)
        begin = np.where(np.arange(STATES) % 2 == 0, -np.inf, 0.0)
        begin[0] = 0
        for _ in range(rounds):
            e, m = self.scores(ids, free), self.moves + can
            e[:, 0] += begin
            ahead, back = np.empty_like(e), np.zeros_like(e)
            ahead[:, 0] = e[:, 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                for i in range(1, long):
                    ahead[:, i] = np.where(there[:, i, None], lse(ahead[:, i - 1, :, None] + m, 1) + e[:, i], ahead[:, i - 1])
                for i in range(long - 2, -1, -1):
                    back[:, i] = np.where(there[:, i + 1, None], lse(m + (e[:, i + 1] + back[:, i + 1])[:, None, :], 2), 0)
                z = lse(ahead[:, -1], 1)
                p = np.exp(ahead + back - z[:, None, None]) * there[..., None]
                expected = np.zeros_like(pairs)
                for i in range(1, long):
                    q = ahead[:, i - 1, :, None] + m + (e[:, i] + back[:, i])[:, None, :] - z[:, None, None]
                    expected += np.exp(q[there[:, i]]).sum(axis=0)
            gw = np.zeros_like(self.weights)
            diff = (one - p) * free[..., None]
            for k in range(ids.shape[2]):
                np.add.at(gw, ids[..., k], diff)
            gw = gw / rows - decay * self.weights
            gm = (pairs - expected) / rows - decay * self.moves
            seen_w += gw**2
            seen_m += gm**2
            self.weights += rate * gw / np.sqrt(seen_w)
            self.moves += rate * gm / np.sqrt(seen_m)
            self.weights[-1] = 0
        return self

    def decode(self, sentences: list[list[str]]) -> list[list[int]]:
        """The likeliest tags of each sentence (Viterbi over all sentences at once)."""
        if not sentences:
            return []
        ids, there, free = self.table(sentences)
        e, m = self.scores(ids, free), self.moves + allowed()
        e[:, 0, 2::2] = -np.inf
        rows, long = there.shape
        best, came = e[:, 0], np.zeros((rows, long, STATES), np.int8)
        for i in range(1, long):
            step = best[:, :, None] + m
            came[:, i] = np.where(there[:, i, None], step.argmax(axis=1), np.arange(STATES))
            best = np.where(there[:, i, None], step.max(axis=1) + e[:, i], best)
        at, out = best.argmax(axis=1), np.zeros((rows, long), np.int8)
        for i in range(long - 1, -1, -1):
            out[:, i] = at
            at = came[np.arange(rows), i, at]
        return [out[s, : len(w)].tolist() for s, w in enumerate(sentences)]


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.maximum(x.max(axis=axis, keepdims=True), -1e300)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def trained(table=None) -> Field:
    """A field trained on the labelled table: rows of words and tags."""
    table = table or examples()
    names: dict[str, int] = {}
    for words, _ in table:
        for fs in Field.features(words):
            for f in fs:
                names.setdefault(f, len(names))
    return Field(names).train([w for w, _ in table], [t for _, t in table])


def windows(text: str) -> list[list[tuple[int, str]]]:
    """The words that may have a label, in runs, with one more word on each side: where each word starts, and the word."""
    runs, end = [], 0
    recent: deque[tuple[int, str]] = deque(maxlen=REACH + 1)
    for i, m in enumerate(_WORD.finditer(text)):
        word = m.start(), m[0]
        if loaded(word[1]):
            since = max(i - end, 0)
            if not runs or since > len(recent):
                runs.append([*recent, word])
            else:
                runs[-1] += [*itertools.islice(recent, len(recent) - since, None), word]
            end = i + REACH + 2
        elif i < end:
            runs[-1].append(word)
        recent.append(word)
    return runs


def added(words: list[tuple[int, str]], tags: list[int]) -> list[tuple[int, int, int]]:
    """Spans of the tags, without marks before and after."""
    out, i = [], 0
    while i < len(tags):
        if tags[i] % 2 == 0:
            i += 1
            continue
        k, j = (tags[i] - 1) // 2, i + 1
        while j < len(tags) and tags[j] == tags[i] + 1:
            j += 1
        (first, head), (last, tail) = words[i], words[j - 1]
        a = first + len(head) - len(head.lstrip("\"'<[{,;"))
        b = last + len(tail.rstrip(".,;:!?\"'>]}"))
        if a < b:
            out.append((k, a, b))
        i = j
    return out


#: Words, with those that pad shorter runs, that are decoded at once; a longer run is decoded by itself.
CELLS = 1 << 14


def batches(lengths: list[int]):
    """The numbers of runs in batches, runs of like length together."""
    part: list[int] = []
    for r in sorted(range(len(lengths)), key=lengths.__getitem__):
        if part and (len(part) + 1) * lengths[r] > CELLS:
            yield part
            part = []
        part.append(r)
    if part:
        yield part


def found(texts: list[str], field: Field):
    """Of each text its pattern spans and all its spans, by kind, then start."""
    runs, owner = [], []
    for t, text in enumerate(texts):
        for run in windows(text):
            runs.append(run)
            owner.append(t)
    more: dict[int, list] = {}
    for part in batches([len(run) for run in runs]):
        for r, tags in zip(part, field.decode([[w for _, w in runs[r]] for r in part])):
            more.setdefault(owner[r], []).extend(added(runs[r], tags))
    for t, text in enumerate(texts):
        base = base_spans(text)
        extra = [x for x in more.get(t, []) if not any(x[1] < b and a < x[2] for _, a, b in base)]
        yield base, sorted(base + extra)


def loaded_rows(column):
    """For the rows in turn, some 1 MB at once: each one's text if it has a digit or an @, else None."""
    mark = np.zeros(256, bool)
    mark[[*range(0x30, 0x3A), 0x40]] = True
    for chunk in chunks(column):
        some = np.concatenate([[0], np.cumsum(mark[chunk.data])])[chunk.offsets]
        yield [chunk.data[a:z].tobytes().decode("utf-8", "replace") if some[i + 1] > some[i] else None for i, (a, z) in enumerate(zip(chunk.offsets[:-1], chunk.offsets[1:]))]


def each(column, field: Field):
    """Pattern spans and all spans of each row in turn."""
    for rows in loaded_rows(column):
        some = iter(found([t for t in rows if t is not None], field))
        for t in rows:
            yield ([], []) if t is None else next(some)


def personal_data(docs: DataFrame, table=None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, the number of pattern finds of each kind, base (their spans), spans (all)."""
    field = trained(table)

    def find(batches):
        for batch in batches:
            rows = [([sum(k == x[0] for x in base) for k in range(4)], joined(base), joined(every)) for base, every in each(batch.column(1), field)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[0][k] for r in rows], pa.int64()) for k in range(4)), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    schema = docs.select("doc_id").withColumns({f"n_{k}": F.lit(0).cast("long") for k in KINDS} | {"base": F.lit(""), "spans": F.lit("")}).schema
    return docs.select("doc_id", "text").mapInArrow(find, schema)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir)).select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def masked(docs: DataFrame, table=None) -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets, n_chars (if there) to match."""
    bounded(docs.sparkSession)
    field, at = trained(table), docs.columns.index("text")

    def hide(batches):
        for batch in batches:
            texts = []
            for text, (_, spans) in zip(batch.column(at).to_pylist(), each(batch.column(at), field)):
                if spans:
                    parts, end = [], 0
                    for k, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
                        if b <= end:
                            continue
                        parts += [text[end : max(a, end)], f"[{KINDS[k].upper()}]" if a >= end else ""]
                        end = b
                    text = "".join(parts) + text[end:]
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    out = docs.mapInArrow(hide, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

