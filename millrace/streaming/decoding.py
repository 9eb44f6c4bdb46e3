"""The binary log as a stream: a decoder for each slot, its state kept by Spark, so that a restart goes on where the last run ended.

A slot's messages are one sequence, so a slot is one task, and its messages of a micro-batch are sorted in that task's memory: bound a micro-batch
with stream_payloads(files_per_trigger=...).  The state between batches is the relations and the open transaction.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.pgoutput import EVENT, FIELDS, Decoder, decode_step

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SlotDecoder(StatefulProcessor):
    """State: relations and the open transaction, as JSON text, read and written once a batch."""

    def __init__(self, db: str, values: str):
        self.db, self.values = db, values

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("decoder", "state string")

    def handleInputRows(self, key, rows, timerValues):
        decoder = Decoder(self.db, self.values)
        if self.state.exists():
            kept = json.loads(self.state.get()[0])
            decoder.relations = {int(k): [v[0], v[1], [tuple(c) for c in v[2]]] for k, v in kept["relations"].items()}
            decoder.open, decoder.pending = kept["open"], kept["pending"]
        messages = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = [(key[0], int(seq), *(e[f] for f in FIELDS)) for seq, payload in zip(messages["seq"], messages["payload"]) for e in decode_step(decoder, payload)]
        self.state.update((json.dumps({"relations": decoder.relations, "open": decoder.open, "pending": decoder.pending}),))
        yield pd.DataFrame(out, columns=["slot", "seq", *FIELDS])

    def close(self) -> None:
        pass


def decode_stream(payloads: DataFrame, db: str, values: str = "typed") -> DataFrame:
    """Streaming payloads (slot, seq, payload) -> events, as operators.pgoutput.decode does in batch.  Messages of a slot must come in order of seq over batches."""
    payloads.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return payloads.select("slot", "seq", "payload").groupBy("slot").transformWithStateInPandas(SlotDecoder(db, values), "slot string, seq long, " + EVENT, "Append", "None")
