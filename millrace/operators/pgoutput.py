"""The binary protocol of logical replication into change events.

A message's place depends on those before it: relations are announced once, and a transaction's changes are events only at its
commit.  So a slot's messages are read in order, by one decoder; slots are independent of each other.  In batch, a partition's slots are streamed
through decoders message by message; in a stream the decoder's state is kept by Spark (millrace.streaming.decoding).
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from ..errors import DecodeError
from ..functions.scalars import PG_EPOCH_MS
from .transforms import compact

#: Most events of a transaction.
MOST_EVENTS = 10_000
EVENT = "op string, before string, after string, db string, schema_name string, table_name string, lsn string, tx_id string, ts_ms long, id string, error string"
# Type ids of booleans, integers, floats, exact numbers, bytes and JSON.
BOOL, INTEGERS, FLOATS, NUMERIC, BYTEA, JSON = 16, {20, 21, 23, 26}, {700, 701}, 1700, 17, {114, 3802}


class Reader:
    """Big-endian values of a buffer, one after the other."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise DecodeError(f"{n} bytes wanted at {self.at}, the message has {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str) -> int:
        return struct.unpack(">" + form, self.take(struct.calcsize(">" + form)))[0]

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise DecodeError("a text without an end")
        try:
            out = self.take(end - self.at).decode()
        except UnicodeDecodeError as e:
            raise DecodeError("a text that isn't UTF-8") from e
        self.at += 1
        return out


def guessed(raw: bytes):
    """The value of a column's text by its look alone: a whole number, a number, else text (bytes that aren't UTF-8 in hex)."""
    import re

    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return "\\x" + raw.hex()
    if re.fullmatch(r"[+-]?[0-9]+", text) and -(2**63) <= int(text) < 2**63:
        return int(text)
    if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", text):
        value = float(text)
        if abs(value) != float("inf"):
            return value
    return text


def typed(raw: bytes, oid: int):
    """The value of a column's text by its declared type; exact numbers stay text, so that no digit is lost."""
    import json
    import math

    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return "\\x" + raw.hex()
    try:
        if oid == BOOL and text in ("t", "f"):
            return text == "t"
        if oid in INTEGERS:
            return int(text)
        if oid in FLOATS:
            return float(text) if math.isfinite(float(text)) else text
        if oid in JSON:
            return json.loads(text)
    except ValueError:
        pass
    return text


@dataclass
class Decoder:
    """State of one slot: relations by id, and the changes of the transaction that is open."""

    db: str
    values: str = "typed"  # or guessed
    relations: dict = field(default_factory=dict)
    open: dict | None = None
    pending: list = field(default_factory=list)
    unknown: int = 0

    def decode(self, data: bytes) -> list[dict]:
        """Events of the transactions that end in these bytes (one message or several)."""
        r, out = Reader(data), []
        while r.at < len(data):
            tag = chr(r.number("B"))
            if tag == "B":
                lsn, ts, xid = r.number("q"), r.number("q"), r.number("i")
                self.open, self.pending = {"lsn": lsn, "ts": ts, "xid": xid}, []
            elif tag == "R":
                self._relation(r)
            elif tag in "IUD":
                self._change(tag, r)
            elif tag == "C":
                out += self._commit(r)
            elif tag == "Y":
                r.number("i"), r.text(), r.text()
            elif tag == "O":
                r.number("q"), r.text()
            elif tag == "T":
                n = r.number("i")
                r.number("b"), r.take(4 * n)
            else:
                # nothing tells where the next message begins
                self.unknown += 1
                break
        return out

    def _relation(self, r: Reader) -> None:
        oid, schema, table = r.number("i"), r.text(), r.text()
        r.number("b")
        n = r.number("h")
        if n < 0:
            raise DecodeError("a relation with a negative number of columns")
        columns = []
        for _ in range(n):
            r.number("b")
            columns.append((r.text(), r.number("i")))
            r.number("i")
        self.relations[oid] = [schema, table, columns]

    def _change(self, tag: str, r: Reader) -> None:
        oid = r.number("i")
        if oid not in self.relations:
            raise DecodeError(f"a change of the unknown relation {oid}")
        if len(self.pending) >= MOST_EVENTS:
            raise DecodeError(f"a transaction of more than {MOST_EVENTS} events")
        kind, before, after = chr(r.number("B")), None, None
        if tag == "I":
            if kind not in "NK":
                raise DecodeError(f"unexpected tuple {kind!r} of an insert")
            after = self._tuple(r, oid)
        elif tag == "U":
            if kind in "KO":
                before = self._tuple(r, oid)
                # servers mark the new tuple; some writers leave the mark out
                if r.data[r.at : r.at + 1] == b"N":
                    r.at += 1
            elif kind != "N":
                raise DecodeError(f"unexpected tuple {kind!r} of an update")
            after = self._tuple(r, oid)
        else:
            if kind not in "KO":
                raise DecodeError(f"unexpected tuple {kind!r} of a delete")
            before = self._tuple(r, oid)
        self.pending.append([{"I": "c", "U": "u", "D": "d"}[tag], oid, before, after])

    def _tuple(self, r: Reader, oid: int) -> dict:
        n, columns, out = r.number("h"), self.relations[oid][2], {}
        if n < 0:
            raise DecodeError("a tuple with a negative number of columns")
        for i in range(n):
            name, kind = columns[i] if i < len(columns) else (f"__col_{i}", 0)
            tag = chr(r.number("B"))
            if tag in "nu":
                out[name] = None
            elif tag == "t":
                size = r.number("i")
                out[name] = None if size < 0 else typed(r.take(size), kind) if self.values == "typed" else guessed(r.take(size))
            else:
                raise DecodeError(f"unexpected column {tag!r}")
        return out

    def _commit(self, r: Reader) -> list[dict]:
        r.number("b")
        lsn, _, ts = r.number("q"), r.number("q"), r.number("q")
        if self.open is None:
            raise DecodeError("a commit without a begin")
        out = [self._event(p, lsn, ts, str(i)) for i, p in enumerate(self.pending)]
        self.open, self.pending = None, []
        return out

    def flush(self) -> list[dict]:
        """Events of the open transaction, which then is closed; their ids end in `flush`."""
        out = [self._event(p, self.open["lsn"], self.open["ts"], "flush") for p in self.pending] if self.open else []
        self.open, self.pending = None, []
        return out

    def _event(self, p: list, lsn: int, ts: int, idx: str) -> dict:
        op, oid, before, after = p
        schema, table, _ = self.relations[oid]
        lsn &= 2**64 - 1
        where, xid = f"{lsn >> 32:X}/{lsn & 0xFFFFFFFF:08X}", str(self.open["xid"] & 0xFFFFFFFF)
        ms = max(0, (-(-ts // 1000) if ts < 0 else ts // 1000) + PG_EPOCH_MS)
        return {"op": op, "before": None if before is None else compact(before), "after": None if after is None else compact(after), "db": self.db, "schema_name": schema, "table_name": table, "lsn": where, "tx_id": xid, "ts_ms": ms, "id": f"{where}:{xid}:{idx}", "error": None}


FIELDS = [x.split()[0] for x in EVENT.split(", ")]


def decode_step(decoder: Decoder, payload: bytes | None) -> list[dict]:
    """Events of a message; a message that can't be read ends the open transaction and gives one row with the error."""
    if not payload:
        return []
    try:
        return decoder.decode(bytes(payload))
    except DecodeError as e:
        decoder.flush()
        return [dict.fromkeys(FIELDS) | {"db": decoder.db, "error": str(e)}]


def decode(payloads: DataFrame, db: str, values: str = "typed", emit_uncommitted: bool = False) -> DataFrame:
    """payloads (slot, seq, payload) -> slot, seq and EVENT: each slot's messages in order of seq.

    Slots are sorted within partitions and streamed, so memory holds a batch and a transaction, however long a slot is.
    """

    def run(batches):
        slot, decoder, last = None, None, None

        def rows(made, slot, seq):
            return [(slot, seq, *(e[f] for f in FIELDS)) for e in made]

        for pdf in batches:
            out = []
            for s, seq, payload in zip(pdf["slot"], pdf["seq"], pdf["payload"]):
                if decoder is None or s != slot:
                    if decoder is not None and emit_uncommitted:
                        out += rows(decoder.flush(), slot, last)
                    slot, decoder = s, Decoder(db, values)
                out += rows(decode_step(decoder, payload), s, int(seq))
                last = int(seq)
            yield pd.DataFrame(out, columns=["slot", "seq", *FIELDS])
        if decoder is not None and emit_uncommitted:
            yield pd.DataFrame(rows(decoder.flush(), slot, last), columns=["slot", "seq", *FIELDS])

    sorted_ = payloads.select("slot", "seq", "payload").repartition("slot").sortWithinPartitions("slot", "seq")
    return sorted_.mapInPandas(run, "slot string, seq long, " + EVENT)


# --- writing messages, for tests and round trips


def begin(lsn: int, us: int, xid: int) -> bytes:
    return struct.pack(">cqqi", b"B", lsn, us, xid)


def relation(oid: int, schema: str, table: str, columns: list[tuple[str, int]]) -> bytes:
    body = b"".join(struct.pack(">b", 0) + n.encode() + b"\0" + struct.pack(">ii", t, -1) for n, t in columns)
    return struct.pack(">ci", b"R", oid) + schema.encode() + b"\0" + table.encode() + b"\0" + struct.pack(">bh", 100, len(columns)) + body


def row(values: list) -> bytes:
    parts = [b"n" if v is None else b"t" + struct.pack(">i", len(b := v if isinstance(v, bytes) else str(v).encode())) + b for v in values]
    return struct.pack(">h", len(values)) + b"".join(parts)


def insert(oid: int, values: list) -> bytes:
    return struct.pack(">cic", b"I", oid, b"N") + row(values)


def update(oid: int, values: list, old: list | None = None, marked: bool = True) -> bytes:
    head = b"" if old is None else b"K" + row(old)
    return struct.pack(">ci", b"U", oid) + head + (b"N" if old is None or marked else b"") + row(values)


def delete(oid: int, old: list) -> bytes:
    return struct.pack(">cic", b"D", oid, b"K") + row(old)


def commit(lsn: int, us: int) -> bytes:
    return struct.pack(">cbqqq", b"C", 0, lsn, lsn, us)


def type_name(oid: int, schema: str, name: str) -> bytes:
    return struct.pack(">ci", b"Y", oid) + schema.encode() + b"\0" + name.encode() + b"\0"


def origin(lsn: int, name: str) -> bytes:
    return struct.pack(">cq", b"O", lsn) + name.encode() + b"\0"


def truncate(*oids: int) -> bytes:
    return struct.pack(f">cib{len(oids)}i", b"T", len(oids), 0, *oids)
