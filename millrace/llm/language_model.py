"""Language-model scoring with a hierarchical Pitman-Yor model.

The tree of restaurants: one for each word of the training texts as context, and one for the start of a text, all with the root restaurant
of single words as parent, whose base is uniform over the known words and one unknown.  There is one level of contexts; every context seen has
its restaurant.  After a word never seen in training the root decides.  Customers are the training texts' words.

Seating is sampled by Gibbs, over tables' counts: a sweep draws for every dish of every restaurant its number of tables from its conditional, given
the totals of all restaurants and of the root as the sweep before left them.  These totals are exact sums over all tasks, carried between sweeps in
stored tables.  A dish with one customer has one table and needs no drawing.  After `burn` sweeps, `samples` more are kept, and a word's
probability is the mean of their predictive probabilities, which sum to one.  Random numbers are hashes of context, word and sweep, so the
result is a function of the documents alone: neither the number of partitions nor a task's retry changes it.

Dishes are dealt out by word; a word with more than a quarter of a part's share of all tokens is dealt out by word and context, and its totals are kept
by the driver, which there are at most four of for each part.  Parts are as many as the texts' bytes ask for.  Scoring deals the words of all texts
out the same way and sums logarithms by document.  All words count.

The conditional of a dish's tables is worked out from generalised Stirling numbers: all of them for up to EXACT customers; for more, those of up to WIDE
tables, beyond FAR customers carried on by the equation that their ratios obey.  Where about WIDE / 2 tables or more are expected of more than EXACT customers, the
conditional is the normal distribution with its saddle point's mean and variance (tests bound the differences).

Words are those of the lower-cased (A-Z) text, then one end.  Null texts are empty: one end.  A repeated row is learned from as often as it stands
and scored each time; a null id is in the fold of the text ''.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, drop, fold, part_names, shuffles, stored
from .text import chunks, mix, places

END = np.uint64(0x0123456789ABCDEF)
#: Customers up to which all Stirling numbers are held; tables that are held for more customers, and customers up to which these are exact.
EXACT, WIDE, FAR = 256, 96, 1 << 14
#: Bytes of text in a part.
PART_BYTES = 24 << 20
#: Parts for each node, where contexts are summed: each part has a row for each node in a sweep.
FAN = 4
#: A word is common from so many times the tokens of a part.
COMMON = 0.25
#: Bytes of text whose words are found at once: what is worked out for each byte stays in a processor's cache.
AT_ONCE = 1 << 18


def entries(batch_column):
    """Chunks as (rows lo..hi, words, row of each word, whether it is a text's first): each text's words and an end."""
    for chunk in chunks(batch_column, AT_ONCE):
        words = chunk.words(lower=True)
        sizes = np.diff(words.rows) + 1
        at = np.cumsum(sizes)
        out = np.empty(at[-1] if len(at) else 0, np.uint64)
        ends = np.zeros(len(out), bool)
        ends[at - 1] = True
        out[ends], out[~ends] = END, words.hashes
        first = np.zeros(len(out), bool)
        first[at - sizes] = True
        yield chunk.lo, chunk.hi, out, np.repeat(np.arange(len(sizes)), sizes), first


#: Words that are dealt out at once, and slices of a part that a task works on one after the other.
PIECE, SLICES = 600_000, 4


def pieces(batches, at: int, keep: tuple = ()):
    """Several texts at once: words, row of each, whether it is a text's first, and the rows' values of the columns in keep."""
    held, rows, n = [], 0, 0
    for batch in batches:
        for lo, hi, words, row, first in entries(batch.column(at)):
            held.append((words, row + rows, first, *(batch.column(k).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for k in keep)))
            rows, n = rows + hi - lo, n + len(words)
            if n >= PIECE:
                yield [np.concatenate(x) for x in zip(*held)]
                held, rows, n = [], 0, 0
    if n:
        yield [np.concatenate(x) for x in zip(*held)]


def contexts_of(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The restaurant of each word: the word before, END at a text's start."""
    before = np.concatenate([np.array([END], np.uint64), words[:-1]])[: len(words)]
    before[first] = END
    return before


def starts_of(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def pair_places(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """np.lexsort((contexts, words))."""
    order = places(words)
    w = words[order]
    rank = np.zeros(len(w), np.int64)
    rank[1:] = np.cumsum(w[1:] != w[:-1])
    return order[places(contexts[order], rank)]


def squeezed(x: np.ndarray) -> bytes:
    """Whole numbers in few bytes: how many distinct values, these, and each entry's place among them; or 0 and 16 bits each."""
    if not len(x) or x.max() < 1 << 16:
        return np.int64(0).tobytes() + x.astype(np.uint16).tobytes()
    x = x.astype(np.uint64)
    order = places(x)
    new = np.ones(len(x), bool)
    new[1:] = x[order[1:]] != x[order[:-1]]
    values, at = x[order[new]], np.empty(len(x), np.int64)
    at[order] = np.cumsum(new) - 1
    return np.int64(len(values)).tobytes() + values.tobytes() + at.astype(np.uint16 if len(values) <= 1 << 16 else np.uint32).tobytes()


def unsqueezed(x: bytes) -> np.ndarray:
    n = int(np.frombuffer(x, np.int64, 1)[0])
    rest = np.frombuffer(x, np.uint16 if n <= 1 << 16 else np.uint32, offset=8 + 8 * n)
    return np.frombuffer(x, np.uint64, n, 8)[rest] if n else rest


def dealt(words: np.ndarray, names: np.ndarray, columns: list[np.ndarray], extra=None, squeeze: bool = False, to: np.ndarray | None = None):
    """A record batch: part (one of the names), w (distinct words), n (entries of each), and the columns' values, all as bytes.  to: the number of each entry's part (by word if not given)."""
    to = (words % np.uint64(len(names))).astype(np.int64) if to is None else to
    order = places(words, to)
    words, to, columns = words[order], to[order], [c[order] for c in columns]
    cut = starts_of(to)
    rows = []
    for a, z in zip(cut, np.append(cut[1:], len(to))):
        lo = starts_of(words[a:z])
        rows.append((int(names[to[a]]), words[a:z][lo].tobytes(), np.diff(np.append(lo, z - a)).astype(np.uint32).tobytes(), *(squeezed(c[a:z]) if squeeze else c[a:z].tobytes() for c in columns), *(() if extra is None else (extra,))))
    kinds = [pa.int64()] + [pa.binary()] * (len(rows[0]) - 1)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", *(f"c{i}" for i in range(len(kinds) - 1))])


def sliced(pdf: pd.DataFrame, kinds: tuple, owned: bool = False):
    """The rows of dealt(), slice by slice of the words' range: number, words (one for each entry), the columns of those kinds (None: squeezed), and (owned) the row of each entry's blob."""
    words, n = [np.frombuffer(x, np.uint64) for x in pdf["c0"]], [np.frombuffer(x, np.uint32) for x in pdf["c1"]]
    columns = [[np.frombuffer(x, kind) if kind else unsqueezed(x) for x in pdf[f"c{i + 2}"]] for i, kind in enumerate(kinds)]
    ends = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in n]
    edges = [int(k * 2**64 / SLICES) for k in range(1, SLICES)]
    cuts = [np.concatenate([[0], np.searchsorted(w, np.array(edges, np.uint64)), [len(w)]]) for w in words]
    for k in range(SLICES):
        bounds = [(c[k], c[k + 1]) for c in cuts]
        if all(a == z for a, z in bounds):
            continue
        w = np.concatenate([np.repeat(w[a:z], m[a:z]) for w, m, (a, z) in zip(words, n, bounds)])
        out = [np.concatenate([x[e[a] : e[z]] for x, e, (a, z) in zip(c, ends, bounds)]) for c in columns]
        yield k, w, *out, *([np.repeat(np.arange(len(words), dtype=np.int32), [e[z] - e[a] for e, (a, z) in zip(ends, bounds)])] * owned)


def blobs(column, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype) for x in column])


# --- seating


@lru_cache(maxsize=4)
def stirling(discount: float, customers: int = EXACT, width: int = EXACT) -> np.ndarray:
    """log S(c, t), generalised Stirling numbers of that discount, for c up to customers and t up to width."""
    s = np.full((customers + 1, width + 1), -np.inf)
    s[1, 1] = 0
    t = np.arange(1, width + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, customers):
            s[c + 1, 1:] = np.logaddexp(s[c, :-1], s[c, 1:] + np.log(np.maximum(c - discount * t, 0)))
    return s


#: Steps of the logarithm of customers in far().
STEP_OF_LOG = 0.02


@lru_cache(maxsize=4)
def far(discount: float) -> np.ndarray:
    """log S(c, t) - log S(c, 1) for c = FAR * exp(STEP_OF_LOG * row), t up to WIDE.

    Q(t) = S(c, t) / S(c, 1) * (t - 1)! * discount ** (t - 1) obeys dQ(t) / d log c = discount * (t - 1) * (Q(t - 1) - Q(t)) for c far above t.
    """
    t = np.arange(1, WIDE + 1)
    scale = np.cumsum(np.log(np.maximum(t - 1, 1) * np.where(t > 1, discount, 1)))
    row = stirling(discount, FAR, WIDE)[FAR, 1:]
    q, out = np.exp(row - row[0] + scale), []

    def slope(x):
        return discount * (t - 1) * (np.concatenate([[0], x[:-1]]) - x)

    for _ in range(2000):
        out.append(np.log(q) - scale)
        a = slope(q)
        b = slope(q + STEP_OF_LOG / 2 * a)
        c = slope(q + STEP_OF_LOG / 2 * b)
        q = q + STEP_OF_LOG / 6 * (a + 2 * b + 2 * c + slope(q + STEP_OF_LOG * c))
    return np.array(out)


def expected(count, pull, discount: float) -> np.ndarray:
    """Tables expected of many customers where a new table has the weight pull: at the saddle point of the tables' generating function."""
    lo, hi = np.full(len(count), -700.0), np.zeros(len(count))  # log y, with pull * y ** (discount - 1) * (1 - y) = count
    for _ in range(60):
        mid = (lo + hi) / 2
        above = np.log(pull) + (discount - 1) * mid + np.log1p(-np.exp(np.minimum(mid, -1e-16))) > np.log(count)
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return 1 + pull / discount * -np.expm1(discount * lo)


def uniform(key: np.ndarray, draw: int) -> np.ndarray:
    """A number of [0, 1) for each key, another one for each draw."""
    with np.errstate(over="ignore"):
        return (mix(key + np.uint64((draw + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)) * 2.0**-53


def tables(count: np.ndarray, rest: np.ndarray, weight: np.ndarray, strength: float, discount: float, key: np.ndarray, draw: int) -> np.ndarray:
    """Tables drawn for dishes with `count` customers in a restaurant with `rest` tables of other dishes, whose parent serves the dish with probability `weight`.

    The chance of t tables goes as S(count, t) times the weights of opening them: (strength + discount * (rest + i)) * weight for i under t.
    """
    out = np.minimum(count, 1).astype(np.int64)
    head = np.minimum(count, EXACT)
    s, log_weight, chance = stirling(discount), np.log(np.maximum(weight, 1e-300)), uniform(key, draw)
    order = np.argsort(head, kind="stable")
    cuts = np.searchsorted(head[order], np.arange(2, EXACT + 2))
    for c in range(2, EXACT + 1):
        every = order[cuts[c - 2] : cuts[c - 1]]
        for lo in range(0, len(every), (1 << 20) // c):
            rows = every[lo : lo + (1 << 20) // c]
            opened = np.log(strength + discount * (rest[rows, None] + np.arange(c))) + log_weight[rows, None]
            weights = np.cumsum(opened, axis=1) + s[c, 1 : c + 1]
            weights = np.cumsum(np.exp(weights - weights.max(axis=1, keepdims=True)), axis=1)
            out[rows] = 1 + (weights < (chance[rows] * weights[:, -1])[:, None]).sum(axis=1)
    big = np.flatnonzero(count > EXACT)
    if not len(big):
        return out
    c, r, w = count[big].astype(float), rest[big], weight[big]

    def opening(t):
        return (strength + discount * (r + t)) * w

    mean = np.ones(len(big))
    for _ in range(25):
        mean = np.minimum(expected(c, opening(mean), discount), c)
    many = mean > WIDE / 2
    few = np.flatnonzero(~many)
    near, beyond = (stirling(discount, FAR, WIDE), far(discount)) if len(few) else (None, None)
    for lo in range(0, len(few), 8192):
        at = few[lo : lo + 8192]
        held = np.where((c[at] <= FAR)[:, None], near[np.minimum(c[at], FAR).astype(np.int64), 1:], beyond[np.clip(np.rint(np.log(c[at] / FAR) / STEP_OF_LOG), 0, len(beyond) - 1).astype(np.int64)])
        weights = np.cumsum(np.log(strength + discount * (r[at, None] + np.arange(WIDE))) + np.log(np.maximum(w[at], 1e-300))[:, None], axis=1) + held
        weights = np.cumsum(np.exp(weights - weights.max(axis=1, keepdims=True)), axis=1)
        out[big[at]] = 1 + (weights < (chance[big[at]] * weights[:, -1])[:, None]).sum(axis=1)
    if many.any():
        c, r, w, mean = c[many], r[many], w[many], mean[many]
        spread = (expected(c, opening(mean) * 1.01, discount) - expected(c, opening(mean) * 0.99, discount)) / 0.02
        spread = 1 / np.maximum(1 / np.maximum(spread, 1e-9) - discount * w / opening(mean), 1e-9)
        normal = np.sqrt(-2 * np.log1p(-chance[big[many]])) * np.cos(2 * np.pi * uniform(key[big[many]], draw + 1))
        out[big[many]] = np.clip(np.rint(mean + normal * np.sqrt(spread)), 1, c).astype(np.int64)
    return out


def dish_keys(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(words) + contexts)


#: Draws that a sweep may take for a dish, and from where on the root's are.
DRAWS, ROOT_DRAWS = 4, 1 << 40


class Model:
    """What all tasks know.  totals (part, u, sums): of the contexts of a part, in order, and by rows, customers and the tables of each kept sample.

    asked (part, n, c0): contexts of the part's totals that stand before learned words of another part, which n names (twice its name, and the half of the words' hashes).

    common: words dealt out by context too, in order, with the number of their shares and their counts; of these the model holds what other words' tasks hold.
    root_tables, root_customers: of each state of the seating, the first with one table for each dish.  kept: the states that are averaged.
    """

    def __init__(self, parts: int, tokens: int, kinds: int, common: np.ndarray, counts: np.ndarray, discounts=(0.75, 0.8), strengths=(1.0, 1.0), burn: int = 2, samples: int = 3, seed: int = 5):
        self.parts, self.nodes, self.tokens, self.kinds, self.common, self.counts = parts, -(-parts // FAN), tokens, kinds, common, counts
        self.shares = np.maximum(1, np.ceil(counts / max(1.0, COMMON * tokens / parts))).astype(np.uint64)
        self.discounts, self.strengths, self.samples, self.seed = discounts, strengths, samples, seed
        self.kept = list(range(burn + 1, burn + samples + 1))
        #: Whether a common word begins with these 16 bits.
        self.leading = np.zeros(1 << 16, bool)
        self.leading[(common >> np.uint64(48)).astype(np.int64)] = True
        self.root_tables, self.root_customers = [], []
        #: Of common words, by state: customers and tables in the root, and tables of their own restaurants.
        self.customers, self.tables, self.opened = [], [], []
        self.totals = self.seats = self.asked = None

    def __getstate__(self):
        return self.__dict__ | {"totals": None, "seats": None, "asked": None}

    def is_common(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether words are common, and the places of those that are among the common."""
        hit, at = self.leading[(words >> np.uint64(48)).astype(np.int64)], np.zeros(len(words), np.int64)
        maybe = np.flatnonzero(hit)
        if len(maybe):
            w = words[maybe]
            at[maybe] = np.minimum(np.searchsorted(self.common, w), len(self.common) - 1)
            hit[maybe] = self.common[at[maybe]] == w
        return hit, at

    def part_of(self, words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        to = words % np.uint64(self.parts)
        hit, at = self.is_common(words)
        if hit.any():
            with np.errstate(over="ignore"):
                to[hit] = mix(words[hit] + mix(contexts[hit]) % self.shares[at[hit]] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.parts)
        return to.astype(np.int64)

    def seat_root(self, state: int, words: np.ndarray, customers: np.ndarray) -> np.ndarray:
        """Tables of words in the root in a state, given those of all words in the state before."""
        before = self.root_tables[state - 1] if state else self.kinds
        n = len(words)
        return tables(customers, np.full(n, float(before)), np.full(n, 1 / (self.kinds + 1)), self.strengths[0], self.discounts[0], mix(words + np.uint64(self.seed)), ROOT_DRAWS + state * DRAWS)

    def parent(self, state: int, customers, opened) -> np.ndarray:
        """Probability of words in the root, with those customers and tables there."""
        d, s = self.discounts[0], self.strengths[0]
        return (customers - d * opened + (s + d * self.root_tables[state]) / (self.kinds + 1)) / (s + self.root_customers[state])

    def seat(self, state: int, words, contexts, count, before, all_before, parent) -> np.ndarray:
        """Tables of dishes in the next state: of their tables, their restaurants' tables and their parents' probabilities in this one."""
        with np.errstate(over="ignore"):
            key = dish_keys(words, contexts) + np.uint64(self.seed)
        return tables(count, (all_before - before).astype(float), parent, self.strengths[1], self.discounts[1], key, (state + 1) * DRAWS)

    def probability(self, k: int, count, opened, totals, parent) -> np.ndarray:
        """Predictive probability, in kept sample k, of words with those customers and tables in a context of those totals."""
        d, s = self.discounts[1], self.strengths[1]
        return (count - d * opened + (s + d * totals[1 + k]) * parent) / (s + totals[0])


# --- restaurants' totals


def summed(u: np.ndarray, sums: np.ndarray):
    """Distinct contexts in order, and the sums of their columns."""
    if not len(u):
        return u, sums
    order = places(u)
    lo = starts_of(u[order])
    return u[order][lo], np.add.reduceat(sums[:, order], lo, axis=1)


def gathered(pdf: pd.DataFrame, rows: int):
    """Contexts in order and their totals, out of rows (u, sums), the sums of 32 or 64 bits."""
    if not len(pdf):
        return np.zeros(0, np.uint64), np.zeros((rows, 0), np.int64)
    sums = [np.frombuffer(x, np.int64 if len(x) == len(u) * rows else np.int32).reshape(rows, -1) for u, x in zip(pdf["u"], pdf["sums"])]
    return summed(blobs(pdf["u"], np.uint64), np.concatenate(sums, axis=1, dtype=np.int64))


def found(context: np.ndarray, u: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Totals of each context: 0 for those not in u."""
    out = np.zeros((len(sums), len(context)), np.int64)
    if len(u):
        at = np.minimum(np.searchsorted(u, context), len(u) - 1)
        known = u[at] == context
        out[:, known] = sums[:, at[known]]
    return out


def totals_rows(to: np.ndarray, u: np.ndarray, sums: np.ndarray, names: np.ndarray) -> list[tuple]:
    """Rows (part, u, sums), of contexts dealt out to the parts of those numbers."""
    order = places(u, to)
    to, u, sums = to[order], u[order], sums[:, order]
    cut = starts_of(to)
    return [(int(names[to[a]]), u[a:z].tobytes(), sums[:, a:z].tobytes()) for a, z in zip(cut, np.append(cut[1:], len(to)))]


TOTALS = "part long, u binary, sums binary"


def free(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that are no longer in use."""
    spark.range(1).count()  # Spark holds the last query until the next
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def word_table(train: DataFrame, names: np.ndarray) -> DataFrame:
    """part, words, counts (as bytes): how often each word stands in the training texts, dealt out to the parts of those names."""

    def count(batches):
        for words, _, _ in pieces(batches, 0):
            kinds, n = np.unique(words, return_counts=True)
            yield dealt(kinds, names, [n.astype(np.uint32)])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        w, n = blobs(pdf["c0"], np.uint64), blobs(pdf["c2"], np.uint32)
        order = places(w)
        lo = starts_of(w[order])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "words": [w[order][lo].tobytes()], "counts": [np.add.reduceat(n[order].astype(np.int64), lo).tobytes()]})

    sent = train.select("text").mapInArrow(count, "part long, c0 binary, c1 binary, c2 binary")
    return stored(sent.groupBy("part").applyInPandas(add, "part long, words binary, counts binary"))


#: Rows between the steps of learning: kind says what the bytes are.
STEP = "part long, kind int, n long, b0 binary, b1 binary, b2 binary, b3 binary, b4 binary"
STATIC, SEATS, CONTEXTS, WORDS, ANSWERS, SINGLES, ROOT, SUMS, TOTAL, ASKED = range(10)


def step_row(part: int, kind: int, n: int = 0, *blobs_: bytes) -> tuple:
    return (part, kind, n, *blobs_, *[None] * (5 - len(blobs_)))


def steps(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["part", "kind", "n", "b0", "b1", "b2", "b3", "b4"])


def sent(kind: int, origin: int, keys: np.ndarray, values: np.ndarray, names: np.ndarray) -> list[tuple]:
    """Rows that carry values of contexts or words to where they are summed, with the part that they come from."""
    to = (keys % np.uint64(len(names))).astype(np.int64)
    order = places(keys, to)
    to, keys, values = to[order], keys[order], values[order]
    cut = starts_of(to)
    return [step_row(int(names[to[x]]), kind, origin, keys[x:y].tobytes(), squeezed(values[x:y])) for x, y in zip(cut, np.append(cut[1:], len(to)))]


class Dishes:
    """Of a part: words, how many contexts they have stood in once, and their dishes with several customers: word (its place), context, count."""

    def __init__(self, words: np.ndarray, singles: np.ndarray, several: np.ndarray, contexts: np.ndarray, count: np.ndarray):
        self.words, self.singles, self.several, self.contexts, self.count = words, singles.astype(np.int64), several.astype(np.int64), contexts, count.astype(np.int64)
        self.word = np.repeat(np.arange(len(words)), self.several)

    def blobs(self) -> tuple:
        return self.words.tobytes(), squeezed(self.singles), squeezed(self.several), self.contexts.tobytes(), squeezed(self.count)

    @classmethod
    def read(cls, row) -> "Dishes":
        return cls(np.frombuffer(row.b0, np.uint64), unsqueezed(row.b1), unsqueezed(row.b2), np.frombuffer(row.b3, np.uint64), unsqueezed(row.b4))

    def customers(self, seats: np.ndarray) -> np.ndarray:
        return self.singles + np.bincount(self.word, weights=seats, minlength=len(self.words)).astype(np.int64)

    def report(self, m: Model, part: int, state: int, seats: np.ndarray, names: np.ndarray) -> list[tuple]:
        """Rows that say how a state of the seating is: the seats by slices, tables of contexts, customers of common words, sums of the root's others."""
        w = self.words[self.word]
        edges = [*np.searchsorted(w, np.array([int(k * 2**64 / SLICES) for k in range(SLICES)], np.uint64)), len(w)]
        rows = [step_row(part, SEATS, k, squeezed(seats[x:y])) for k, (x, y) in enumerate(zip(edges[:-1], edges[1:]))]
        u, at = np.unique(self.contexts, return_inverse=True)
        rows += sent(CONTEXTS, part, u, np.bincount(at, weights=seats, minlength=len(u)).astype(np.int64), names) if len(u) else []
        customers, (common, _) = self.customers(seats), m.is_common(self.words)
        rows += sent(WORDS, part, self.words[common], customers[common], names) if common.any() else []
        opened = m.seat_root(state, self.words[~common], customers[~common])
        return [*rows, step_row(part, ROOT, 0, np.array([opened.sum(), customers[~common].sum()], np.int64).tobytes())]


def learn(train: DataFrame, parts: int, **settings) -> Model:
    """train (text) -> the model."""

    def sums(batches):
        for batch in batches:
            n = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x.sum() for x in n], pa.int64()), pa.array([len(x) for x in n], pa.int64())], names=["tokens", "kinds"])

    spark, spread = train.sparkSession, part_names(parts)
    nodes = spread[: -(-parts // FAN)]
    table = word_table(train, nodes)
    total = table.select("counts").mapInArrow(sums, "tokens long, kinds long").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).first()
    tokens, kinds = int(total["tokens"] or 0), int(total["kinds"] or 0)
    least = max(2.0, COMMON * tokens / parts)

    def frequent(batches):
        for batch in batches:
            for words, counts in zip(batch.column(0), batch.column(1)):
                w, n = np.frombuffer(words.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(w[n >= least].view(np.int64)), pa.array(n[n >= least])], names=["w", "n"])

    # at most parts / COMMON words have so many of all tokens
    top = table.select("words", "counts").mapInArrow(frequent, "w long, n long").toPandas()
    common = top["w"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(common)
    m = Model(parts, tokens, kinds, common[order], top["n"].to_numpy(np.int64)[order], **settings)

    def send(batches):
        for words, _, first in pieces(batches, 0):
            u = contexts_of(words, first)
            order = pair_places(words, u)
            u, words = u[order], words[order]
            lo = starts_of(words, u)
            n = np.diff(np.append(lo, len(u)))
            u, words = u[lo], words[lo]
            yield dealt(words, spread, [u, n], squeeze=True, to=start.value.part_of(words, u))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        m, part = start.value, int(pdf["part"].iloc[0])
        made, halves = [], []
        for k, w, u, n in sliced(pdf, (None, None)):
            u = u.astype(np.uint64)
            order = pair_places(w, u)
            w, u, n = w[order], u[order], n[order].astype(np.int64)
            lo = starts_of(w, u)
            w, u, n = w[lo], u[lo], np.add.reduceat(n, lo)
            at = starts_of(w)
            size = np.diff(np.append(at, len(w)))
            several = n > 1
            most = np.add.reduceat(several.astype(np.int64), at)
            made.append((w[at], size - most, most, u[several], n[several], *np.unique(u[~several], return_counts=True)))
            halves.append(2 * k // SLICES)
        dishes = Dishes(*(np.concatenate([x[k] for x in made]) for k in range(5)))
        rows = [step_row(part, STATIC, 0, *dishes.blobs())]
        for half in sorted(set(halves)):
            mine = [x for x, h in zip(made, halves) if h == half]
            alone, times = summed(np.concatenate([x[5] for x in mine]), np.concatenate([x[6] for x in mine])[None, :])
            rest = np.setdiff1d(np.concatenate([x[3] for x in mine]), alone)
            rest = rest[~m.is_common(rest)[0]]
            rows += sent(SINGLES, 2 * part + half, alone, times[0], nodes) if len(alone) else []
            rows += sent(ASKED, 2 * part + half, rest, np.zeros(len(rest), np.int64), nodes) if len(rest) else []
        return steps(rows + dishes.report(m, part, 0, np.ones(len(dishes.count), np.int64), nodes))

    def sweep(state: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            m, part = held.value, int(pdf["part"].iloc[0])
            by = {k: list(x.sort_values("n").itertuples()) for k, x in pdf.groupby("kind")}
            if STATIC not in by:
                return steps([])
            dishes = Dishes.read(by[STATIC][0])
            seats = np.concatenate([unsqueezed(x.b0) for x in by[SEATS]]).astype(np.int64)
            customers, (common, at) = dishes.customers(seats), m.is_common(dishes.words)
            opened = np.zeros(len(customers), np.int64)
            opened[~common] = m.seat_root(state, dishes.words[~common], customers[~common])
            customers[common], opened[common] = m.customers[state][at[common]], m.tables[state][at[common]]
            parent = m.parent(state, customers, opened)
            told = by.get(ANSWERS, [])
            u = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.b0, np.uint64) for x in told)])
            sums = np.concatenate([np.zeros(0, np.int64), *(unsqueezed(x.b1).astype(np.int64) for x in told)])
            order = np.argsort(u)
            every = found(dishes.contexts, u[order], sums[order][None, :])[0]
            common, at = m.is_common(dishes.contexts)
            every[common] = m.opened[state][at[common]]
            after = m.seat(state, dishes.words[dishes.word], dishes.contexts, dishes.count, seats, every, parent[dishes.word])
            return steps(dishes.report(m, part, state + 1, after, nodes))

        return run

    def node(keep: bool):
        """Sums what parts say of contexts and common words, answers each part's contexts, and hands the common ones to the driver."""

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            m, part = held.value, int(pdf["part"].iloc[0])
            by = {k: list(x.itertuples()) for k, x in pdf.groupby("kind")}
            rows = []
            for kind in (CONTEXTS, WORDS):
                said = by.get(kind, [])
                given = by.get(TOTAL, []) if kind == CONTEXTS else []
                if not said and not given:
                    continue
                keys = [np.frombuffer(x.b0, np.uint64) for x in said]
                u, sums = summed(np.concatenate([*keys, *(np.frombuffer(x.b0, np.uint64) for x in given)]), np.concatenate([*(unsqueezed(x.b1).astype(np.int64) for x in said), *(unsqueezed(x.b1).astype(np.int64) for x in given)])[None, :])
                common, _ = m.is_common(u)
                if common.any():
                    rows.append(step_row(-1, SUMS, kind, u[common].tobytes(), sums[0][common].tobytes()))
                if kind == CONTEXTS:
                    for x, mine in zip(said, keys):
                        mine = mine[~m.is_common(mine)[0]]
                        if len(mine):
                            rows.append(step_row(int(x.n), ANSWERS, part, mine.tobytes(), squeezed(found(mine, u, sums)[0])))
                    if keep:
                        rows.append(step_row(part, TOTAL, 0, u.tobytes(), squeezed(sums[0])))
            return steps(rows)

        return run

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        """Tables of dishes with one customer, by context; every context of the part is in."""
        u, n = blobs(pdf["b0"], np.uint64), np.concatenate([unsqueezed(x).astype(np.int64) for x in pdf["b1"]])
        u, n = summed(u, n[None, :])
        return steps([step_row(int(pdf["part"].iloc[0]), TOTAL, 0, u.tobytes(), squeezed(n[0]))])

    start = spark.sparkContext.broadcast(m)
    pairs = train.select("text").mapInArrow(send, "part long, " + ", ".join(f"c{i} binary" for i in range(4)))
    told = stored(pairs.groupBy("part").applyInPandas(count, STEP))
    free(spark)
    static, singles = told.filter(F.col("kind") == STATIC), stored(told.filter(F.col("kind") == SINGLES).groupBy("part").applyInPandas(alone, STEP))
    first, seats, totals, said, spent = told, [], [], None, [table, told, singles]
    for state in range(m.kept[-1] + 1):
        root = told.filter(F.col("kind") == ROOT).select("b0").toPandas()["b0"]
        inner = sum((np.frombuffer(x, np.int64) for x in root), np.zeros(2, np.int64))
        held = spark.sparkContext.broadcast(m)
        before, said = said, stored(told.filter(F.col("kind").isin(CONTEXTS, WORDS)).unionByName(singles).groupBy("part").applyInPandas(node(state in m.kept), STEP))
        both = {CONTEXTS: np.zeros(len(m.common), np.int64), WORDS: np.zeros(len(m.common), np.int64)}
        for row in said.filter(F.col("kind") == SUMS).select("n", "b0", "b1").collect():
            both[row["n"]][m.is_common(np.frombuffer(row["b0"], np.uint64))[1]] = np.frombuffer(row["b1"], np.int64)
        m.customers.append(both[WORDS])
        m.opened.append(both[CONTEXTS])
        m.tables.append(m.seat_root(state, m.common, both[WORDS]))
        m.root_tables.append(float(inner[0] + m.tables[-1].sum()))
        m.root_customers.append(float(inner[1] + both[WORDS].sum()))
        if before is not None and state - 1 not in m.kept:
            drop(before)
        if state in m.kept:
            spent += [told, said]
            seats.append(told.filter(F.col("kind") == SEATS).withColumn("n", F.col("n") + (len(seats) + 1) * SLICES))
            totals.append(said.filter(F.col("kind") == TOTAL).withColumn("n", F.lit(len(totals) + 1).cast("long")))
        if state < m.kept[-1]:
            held.unpersist()
            held = spark.sparkContext.broadcast(m)
            seated = static.unionByName(told.filter(F.col("kind") == SEATS)).unionByName(said.filter(F.col("kind") == ANSWERS))
            told, last = stored(seated.groupBy("part").applyInPandas(sweep(state), STEP)), told
            if last is not first and state not in m.kept:
                drop(last)
            free(spark)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        """A part's contexts with their customers (a context has as many as the word stands in the texts) and the tables of each kept sample."""
        rows = list(pdf.sort_values("n").itertuples())
        if rows[0].n:
            return pd.DataFrame({"part": [], "u": [], "sums": []})
        u, counts = np.frombuffer(rows[0].b0, np.uint64), np.frombuffer(rows[0].b1, np.int64)
        out = np.zeros((m.samples + 1, len(u)), np.int64)
        out[0] = counts
        for x in rows[1:]:
            out[x.n] = found(u, np.frombuffer(x.b0, np.uint64), unsqueezed(x.b1).astype(np.int64)[None, :])[0]
        return pd.DataFrame({"part": [rows[0].part], "u": [u.tobytes()], "sums": [out.tobytes()]})

    counted = table.select("part", F.lit(0).cast("long").alias("n"), F.col("words").alias("b0"), F.col("counts").alias("b1"))
    for x in totals:
        counted = counted.unionByName(x.select("part", "n", "b0", "b1"))
    m.totals = stored(counted.groupBy("part").applyInPandas(whole, TOTALS))
    every = None
    for x in seats:
        x = x.select("part", "n", F.col("b0").alias("u"), F.lit(None).cast("binary").alias("sums"))
        every = x if every is None else every.unionByName(x)
    m.seats = stored(every)
    # scoring asks for the totals of these contexts; it need not read the learned texts for them again
    m.asked = stored(first.filter(F.col("kind").isin(SINGLES, ASKED)).select("part", "n", F.col("b0").alias("c0")))
    for x in spent:
        drop(x)
    return m


DOC = np.dtype([("key", "<i8"), ("n", "<i4"), ("known", "<i4"), ("base", "<f8"), ("score", "<f8")])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (key, learned, text) -> key, n_tokens, n_known, base_score, score; rows of one key must be alike, and those learned the model's.

    The words go in two rounds, the lower half of the hashes first: a round's shuffle files are deleted before the next.
    """
    parts = model.parts
    held, spread = docs.sparkSession.sparkContext.broadcast(model), part_names(parts)
    number = {int(name): k for k, name in enumerate(spread)}

    def send(batches, half: int):
        for words, row, first, keys, learned in pieces(batches, 2, (0, 1)):
            u, here = contexts_of(words, first), words >> np.uint64(63) == half
            if here.any():
                about = keys.astype(np.int64).tobytes() + learned.astype(np.uint8).tobytes()
                w, u = words[here], u[here]
                yield dealt(w, spread, [u, row[here]], about, squeeze=True, to=held.value.part_of(w, u))

    def ask(batches, half: int):
        """Contexts of texts that were not learned, dealt out like the totals, with the numbers of the parts that have words after them; the model has those of common words."""
        for words, _, first in pieces(batches, 0):
            here = words >> np.uint64(63) == half
            w, u = words[here], contexts_of(words, first)[here]
            rare = ~held.value.is_common(u)[0]
            w, u = w[rare], u[rare]
            if not len(u):
                continue
            to = held.value.part_of(w, u).astype(np.uint32)
            order = pair_places(u, to.astype(np.uint64))
            u, to = u[order], to[order]
            lo = starts_of(u, to)
            yield dealt(u[lo], spread[: held.value.nodes], [to[lo]], squeeze=True)

    def reply(asked: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(asked) and len(totals):
            of = [(np.frombuffer(u, np.uint64), n, c1, c2) for n, u, c1, c2 in zip(asked["n"], asked["c0"], asked["c1"], asked["c2"])]
            to = np.concatenate([unsqueezed(c2).astype(np.int64) if n < 0 else np.full(len(u), number[n // 2]) for u, n, _, c2 in of])
            u = np.concatenate([np.repeat(u, np.frombuffer(c1, np.uint32)) if n < 0 else u for u, n, c1, _ in of])
            rare = ~held.value.is_common(u)[0]
            u, to = u[rare], to[rare]
            order = places(u, to)
            u, to = u[order], to[order]
            lo = starts_of(to, u)
            u, to = u[lo], to[lo]
            sums = found(u, *gathered(totals, held.value.samples + 1))
            seen = sums[0] > 0
            if seen.any():
                sums = sums[:, seen]
                rows = totals_rows(to[seen], u[seen], sums.astype(np.int32) if sums.max() < 1 << 31 else sums, spread)
        return pd.DataFrame([(p, 0, u, x) for p, u, x in rows], columns=["part", "n", "u", "sums"])

    def judge(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """told: answers on contexts (n = 0), and the seats of kept samples by slices (n = sample * SLICES + slice, from SLICES on)."""
        if not len(pdf):
            return pd.DataFrame({"part": [], "docs": []})
        m = held.value
        known = gathered(told[told["n"] == 0], m.samples + 1)
        seats = {int(n): x for n, x in zip(told["n"], told["u"]) if n}
        texts = np.array([len(x) // 9 for x in pdf["c4"]])
        key = np.concatenate([np.frombuffer(x[: 8 * n], np.int64) for x, n in zip(pdf["c4"], texts)])
        learned = np.concatenate([np.frombuffer(x[8 * n :], np.uint8) for x, n in zip(pdf["c4"], texts)])
        shift = np.concatenate([[0], np.cumsum(texts)[:-1]])
        out = np.zeros(len(key), DOC)
        out["key"] = key
        for s, w, u, row, blob in sliced(pdf, (None, None), owned=True):
            u, row = u.astype(np.uint64), (row + shift[blob]).astype(np.int32)
            del blob
            order = pair_places(w, u)
            w, u, row = w[order], u[order], row[order]
            lo = starts_of(w, u)
            which = np.repeat(np.arange(len(lo), dtype=np.int32), np.diff(np.append(lo, len(w))))
            count = np.add.reduceat(learned[row].astype(np.int64), lo)
            w, u = w[lo], u[lo]
            at_word = starts_of(w)
            word = np.repeat(np.arange(len(at_word)), np.diff(np.append(at_word, len(w))))
            kinds, c = w[at_word], np.add.reduceat(count, at_word)
            common, place = m.is_common(kinds)
            c[common] = m.counts[place[common]]
            totals, (hot, at) = found(u, *known), m.is_common(u)
            totals[0, hot] = m.counts[at[hot]]
            several, seen = count > 1, np.flatnonzero((c > 0) & ~common)
            singles, p = np.bincount(word, weights=count == 1, minlength=len(kinds)).astype(np.int64), np.zeros(len(w))
            for k, state in enumerate(m.kept):
                seated = unsqueezed(seats[(k + 1) * SLICES + s]).astype(np.int64) if several.any() else np.zeros(0, np.int64)
                if len(seated) != several.sum():
                    raise ValueError(f"{len(seated)} dishes were seated, {several.sum()} are scored")
                opened = np.minimum(count, 1)
                opened[several] = seated
                customers = singles + np.bincount(word[several], weights=seated, minlength=len(kinds)).astype(np.int64)
                in_root = np.zeros(len(kinds), np.int64)
                in_root[seen] = m.seat_root(state, kinds[seen], customers[seen])
                customers[common], in_root[common] = m.customers[state][place[common]], m.tables[state][place[common]]
                totals[1 + k, hot] = m.opened[state][at[hot]]
                p += m.probability(k, count, opened, totals, m.parent(state, customers, in_root)[word])
            n = len(out)
            out["n"] += np.bincount(row, minlength=n).astype(np.int32)
            out["known"] += np.bincount(row, weights=(c[word] > 0)[which], minlength=n).astype(np.int32)
            out["base"] += np.bincount(row, weights=np.log10((c[word] + 1) / (m.tokens + m.kinds + 1))[which], minlength=n)
            out["score"] += np.bincount(row, weights=np.log10(p / m.samples)[which], minlength=n)
        out = out[out["n"] > 0]
        to = out["key"] % parts
        order = np.argsort(to, kind="stable")
        to, out = to[order], out[order]
        cut = starts_of(to)
        return pd.DataFrame({"part": spread[to[cut]], "docs": [out[a:z].tobytes() for a, z in zip(cut, np.append(cut[1:], len(to)))]})

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        x = blobs(pdf["docs"], DOC)
        # logarithms are added in one order, whatever the order of the parts
        with np.errstate(over="ignore"):
            x = x[pair_places(x["key"].view(np.uint64), mix(mix(x["score"].view(np.uint64)) + x["base"].view(np.uint64)))]
        lo = starts_of(x["key"])
        return pd.DataFrame({"key": x["key"][lo], "n_tokens": np.add.reduceat(x["n"], lo, dtype=np.int64), "n_known": np.add.reduceat(x["known"], lo, dtype=np.int64), "base_score": np.add.reduceat(x["base"], lo), "score": np.add.reduceat(x["score"], lo)})

    def judged(half: int) -> DataFrame:
        sent = docs.select("key", "learned", "text").mapInArrow(lambda x: send(x, half), "part long, " + ", ".join(f"c{i} binary" for i in range(5)))
        asked = docs.filter("learned = 0").select("text").mapInArrow(lambda x: ask(x, half), "part long, c0 binary, c1 binary, c2 binary").withColumn("n", F.lit(-1).cast("long"))
        asked = asked.unionByName(model.asked.filter(F.col("n") % 2 == half), allowMissingColumns=True)
        replies = asked.groupBy("part").cogroup(model.totals.groupBy("part")).applyInPandas(reply, "part long, n long, u binary, sums binary")
        mine = F.floor(F.pmod("n", F.lit(SLICES)) * 2 / F.lit(SLICES)) == half
        told = replies.unionByName(model.seats.filter(mine))
        return stored(sent.groupBy("part").cogroup(told.groupBy("part")).applyInPandas(judge, "part long, docs binary"))

    halves = []
    for half in range(2):
        halves.append(judged(half))
        free(docs.sparkSession)
    return halves[0].union(halves[1]).groupBy("part").applyInPandas(gather, "key long, n_tokens long, n_known long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity by fold of what op10 returns."""
    return scored.groupBy("held_out").agg(F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"), F.pow(F.lit(10.0), -F.sum("base_score") / F.sum("n_tokens")).alias("base_perplexity"))


def part_count(docs: DataFrame) -> int:
    """Parts for the texts: as many as Spark's shuffles have partitions, or a multiple, so that a part holds no more than PART_BYTES or so."""
    n, size = shuffles(docs.sparkSession), docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return n * max(1, -(-size // (PART_BYTES * n)))


def score_documents(docs: DataFrame, parts: int | None = None, **settings) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.  parts: of the work; the result doesn't depend on it."""
    parts = parts or part_count(docs)
    docs = docs.select("doc_id", "text", (fold("doc_id", 7) == 2).alias("held_out"), F.xxhash64("doc_id", "text").alias("key"))
    model = learn(docs.filter("not held_out"), parts, **settings)
    free(docs.sparkSession)
    scored = score(docs.withColumn("learned", F.expr("if(held_out, 0L, 1L)")), model)
    many = docs.groupBy("doc_id", "held_out", "key").agg(F.count("*").alias("rows"))
    out = many.join(scored, "key").withColumn("each", F.explode(F.expr("sequence(1L, rows)")))
    whole = {c: F.expr(f"cast({c} div rows as long)") for c in ("n_tokens", "n_known")}
    return out.withColumns(whole | {c: F.col(c) / F.col("rows") for c in ("base_score", "score")} | {"train_tokens": F.lit(model.tokens).cast("long")}).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
