"""Filter, map and mask steps over events, and the pipeline that runs them.

Each step becomes column expressions when the pipeline is built, so a pipeline is one projection and filter to Catalyst.  Steps work on typed
images; JSON text is made when events are written.  Where the images' type isn't known (JSON text of many tables), masks fall back to a pandas function.
"""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, TransformError
from ..functions.json_text import value_json
from ..functions.scalars import hmac_sha256
from ..schema import COLUMNS, known_op
from .predicates import Test, keeps

#: Fixed value: what a redacted field reads.
REDACTED = "***REDACTED***"
STRATEGIES = ("redact", "hash", "null")


def envelope_error(source: Column, id: Column, op: Column | None = None) -> Column:
    """What is wrong with an event, else null: an empty id, database, schema or table, in that order; then an unknown operation.

    A row event of a binlog has no schema by nature, so an empty one is an error only without a binlog file.
    """

    def blank(c: Column) -> Column:
        return c.isNull() | (c == "")

    out = F.when(blank(id), "event id is empty").when(blank(source["db"]), "source.db is empty")
    out = out.when(blank(source["schema"]) & source["binlog_file"].isNull(), "source.schema is empty").when(blank(source["table"]), "source.table is empty")
    return out.when(op.isNull() | ~known_op(op), "invalid operation code") if op is not None else out


# --- masks


def good_path(path: str) -> bool:
    return bool(path) and all(path.split("."))


def clean_paths(paths: Iterable[str]) -> list[str]:
    """Paths in order, once each, without those with an empty part and those under a path that is masked before."""
    out: list[str] = []
    for path in sorted(set(filter(good_path, paths))):
        if not any(path.startswith(p + ".") for p in out):
            out.append(path)
    return out


def mask_image(image: Column, kind: T.StructType, paths: Iterable[str], strategy: str, key: bytes | None) -> tuple[Column, Column]:
    """The masked image, and whether a field was there to mask."""
    hits: list[Column] = []
    out = masked_struct(image, kind, [p.split(".") for p in clean_paths(paths)], strategy, key, hits, image.isNotNull())
    hit = F.lit(False)
    for h in hits:
        hit = hit | h
    return out, hit


def masked_struct(c: Column, kind: T.StructType, paths: list[list[str]], strategy: str, key, hits: list[Column], there: Column) -> Column:
    for f in kind.fields:
        own = [p for p in paths if p[0] == f.name]
        if not own:
            continue
        if [f.name] in own:
            hits.append(there)
            c = c.withField(f"`{f.name}`", masked_value(c.getField(f.name), f.dataType, strategy, key))
        elif isinstance(f.dataType, T.StructType):
            inner = c.getField(f.name)
            c = c.withField(f"`{f.name}`", masked_struct(inner, f.dataType, [p[1:] for p in own], strategy, key, hits, there & inner.isNotNull()))
    return c


def masked_value(c: Column, kind: T.DataType, strategy: str, key) -> Column:
    if strategy == "redact":
        return F.lit(REDACTED)
    if strategy == "hash":
        return hmac_sha256(value_json(c, kind), key)
    return F.lit(None).cast(T.StringType() if isinstance(kind, T.StructType) else kind)


def mask_json(text: Column, paths: Iterable[str], strategy: str, key: bytes | None) -> Column:
    """The same for images of JSON text of any shape: struct(image, hit).  Arrow batches go to Python for this one."""
    wanted = sorted(set(filter(good_path, paths)))

    def walk(value, parts: list[str]) -> bool:
        for p in parts[:-1]:
            if not isinstance(value, dict) or not isinstance(value.get(p), dict):
                return False
            value = value[p]
        if not isinstance(value, dict) or parts[-1] not in value:
            return False
        old = value[parts[-1]]
        if strategy == "redact":
            value[parts[-1]] = REDACTED
        elif strategy == "hash":
            value[parts[-1]] = hmac.new(key, compact(old).encode(), hashlib.sha256).hexdigest()
        else:
            value[parts[-1]] = None
        return True

    @F.pandas_udf("image string, hit boolean")
    def mask(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            value = None if t is None else json.loads(t)
            hit = [walk(value, p.split(".")) for p in wanted] if value is not None else []
            rows.append((compact(value) if any(hit) else t, any(hit)))
        return pd.DataFrame(rows, columns=["image", "hit"])

    return mask(text)


def compact(value) -> str:
    """Canonical JSON text of a Python value: sorted keys, no spaces."""

    def render(v) -> str:
        if isinstance(v, float):
            size = abs(v)
            if v == 0 or 1e-5 <= size < 1e16:
                text = format(Decimal(repr(v)), "f")
                return text if "." in text else text + ".0"
            return repr(v).replace("e+", "e").replace("e-0", "e-").replace(".0e", "e")
        if isinstance(v, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{render(v[k])}" for k in sorted(v)) + "}"
        if isinstance(v, list):
            return "[" + ",".join(map(render, v)) + "]"
        return json.dumps(v, ensure_ascii=False)

    return render(value)


# --- steps


@dataclass
class Filter:
    test: Test
    kind: str = "filter"


@dataclass
class Map:
    """change: from the event's columns by name to new columns by name."""

    change: Callable[[dict[str, Column]], dict[str, Column]]
    kind: str = "map"


@dataclass
class Mask:
    paths: list[str]
    strategy: str = "redact"
    key: bytes | None = None
    kind: str = "mask"

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ConfigError(f"unknown mask strategy {self.strategy!r}: one of {', '.join(STRATEGIES)}")
        if self.strategy == "hash" and not self.key:
            raise ConfigError("a hash mask needs a key")


def conformed(c: Column, old: T.DataType, new: T.DataType) -> Column:
    """A value of a type as a value of another, field by field; a field that it hasn't got is null."""
    if old == new:
        return c
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        fields = {f.name: f.dataType for f in old.fields}
        inner = F.struct(*((conformed(c.getField(f.name), fields[f.name], f.dataType) if f.name in fields else F.lit(None).cast(f.dataType)).alias(f.name) for f in new.fields))
        return F.when(c.isNotNull(), inner)
    return c.cast(new)


def routed(kind: str, failed: Column, fail_closed: bool) -> Column:
    """What becomes of an event that a step fails on: pass, or reject."""
    if kind == "filter" or (kind == "map" and not fail_closed):
        return F.when(failed, "pass")
    return F.when(failed, "reject")


@dataclass
class Pipeline:
    """Steps in order.  fail_closed: a map that makes a broken event rejects it instead of letting the original pass."""

    steps: list = field(default_factory=list)
    fail_closed: bool = False

    def run(self, events: DataFrame) -> DataFrame:
        """Events with _outcome (pass, modified, dropped, rejected), _error and _step (of the last that said anything but pass)."""
        out = events.select(*COLUMNS).withColumns({"_outcome": F.lit("pass"), "_error": F.lit(None).cast("string"), "_step": F.lit(None).cast("int")})
        for number, step in enumerate(self.steps):
            live = ~F.col("_outcome").isin("dropped", "rejected")
            if isinstance(step, Filter):
                gone = live & ~keeps(step.test, out)
                out = out.withColumns({"_step": F.when(gone, number).otherwise(F.col("_step")), "_outcome": F.when(gone, "dropped").otherwise(F.col("_outcome"))})
            elif isinstance(step, Map):
                out = self._map(out, step, number, live)
            elif isinstance(step, Mask):
                out = self._mask(out, step, number, live)
            else:
                raise ConfigError(f"unknown step {step!r}")
        return out

    def _map(self, out: DataFrame, step: Map, number: int, live: Column) -> DataFrame:
        new = {c: F.col(c) for c in COLUMNS} | step.change({c: F.col(c) for c in COLUMNS})
        unknown = set(new) - set(COLUMNS)
        if unknown:
            raise TransformError(f"a map made columns that an event hasn't got: {', '.join(sorted(unknown))}")
        tried = out.withColumns({f"_new_{c}": v for c, v in new.items()})
        error = envelope_error(F.col("_new_source"), F.col("_new_id"), F.col("_new_op"))
        tried = tried.withColumn("_why", F.when(F.col("_outcome").isin("dropped", "rejected"), None).otherwise(error))
        ok = live & F.col("_why").isNull()
        changed = {c: F.when(ok, F.col(f"_new_{c}")).otherwise(conformed(F.col(c), tried.schema[c].dataType, tried.schema[f"_new_{c}"].dataType)) for c in COLUMNS}
        fate = routed("map", F.col("_why").isNotNull(), self.fail_closed)
        notes = {
            "_outcome": F.when(fate == "reject", "rejected").when(ok, "modified").otherwise(F.col("_outcome")),
            "_error": F.coalesce("_why", "_error"),
            "_step": F.when(F.col("_why").isNotNull() | ok, number).otherwise(F.col("_step")),
        }
        return tried.select(*(changed[c].alias(c) for c in COLUMNS), *(v.alias(c) for c, v in notes.items()))

    def _mask(self, out: DataFrame, step: Mask, number: int, live: Column) -> DataFrame:
        columns, hit = {}, F.lit(False)
        for image in ("after", "before"):
            kind = out.schema[image].dataType
            if isinstance(kind, T.StructType):
                masked, own = mask_image(F.col(image), kind, step.paths, step.strategy, step.key)
            else:
                made = mask_json(F.col(image), step.paths, step.strategy, step.key)
                masked, own = made["image"], made["hit"]
            columns[image], hit = masked, hit | own
        hit = live & hit
        return out.withColumns(columns | {"_outcome": F.when(hit, "modified").otherwise(F.col("_outcome")), "_step": F.when(hit, number).otherwise(F.col("_step"))})

    def apply(self, events: DataFrame) -> DataFrame:
        """The events that come through."""
        return self.run(events).filter(~F.col("_outcome").isin("dropped", "rejected")).select(*COLUMNS)

    def dead_letters(self, events: DataFrame) -> DataFrame:
        """The events that were rejected, with the reason."""
        return self.run(events).filter(F.col("_outcome") == "rejected").select(*COLUMNS, F.col("_error").alias("error"), F.col("_step").alias("step"))


def mapped(function: Callable[[dict], dict], events: DataFrame) -> DataFrame:
    """The way out for a change that columns can't express: a Python function over each event (a dict, images as Python values).

    events and result have images of JSON text.  What the function raises, or returns that is no event, goes to _error and leaves the event as it was.
    """
    from ..sources.files import event_problem

    @F.pandas_udf("json string, error string")
    def call(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                made = function(json.loads(t))
                problem = event_problem(made)
                rows.append((None, problem) if problem else (compact(made), None))
            except Exception as e:  # noqa: BLE001  whatever the user's code raises
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["json", "error"])

    from ..functions.json_text import json_of_event
    from ..schema import envelope

    tried = events.withColumn("_made", call(json_of_event()))
    made = F.from_json(F.col("_made.json"), envelope())
    # absent optional fields come back as nulls, images as the text that they were
    return tried.withColumn("_event", made).select(*(F.coalesce(F.col(f"_event.{c}"), F.col(c)).alias(c) if c not in ("before", "after") else F.when(F.col("_event").isNotNull(), F.col(f"_event.{c}")).otherwise(F.col(c)).alias(c) for c in COLUMNS), F.col("_made.error").alias("_error"))


def check_expression(spark, schema: T.StructType, expression: str) -> str | None:
    """What keeps a filter's SQL text from being analysed over events of a schema; None if nothing does."""
    from pyspark.errors import AnalysisException, ParseException

    try:
        kind = spark.createDataFrame([], schema).selectExpr(f"({expression}) AS x").schema["x"].dataType
    except (AnalysisException, ParseException) as e:
        return str(e).strip().splitlines()[0]
    return None if isinstance(kind, T.BooleanType) else f"a filter must be boolean, this is {kind.simpleString()}"


def pipeline_from_config(table: dict, key: bytes | None = None) -> Pipeline:
    """A pipeline from its configuration: {"failClosed": bool, "pipeline": [{"type": "filter" | "map" | "mask", ...}]}.

    A filter has `expression` (SQL over the event), a map `set` (column or image field -> SQL), a mask `fields` and `strategy` (redact by default).
    """
    steps = []
    for i, item in enumerate(table.get("pipeline", [])):
        kind = item.get("type")
        if kind == "filter":
            steps.append(Filter(Test(lambda _, e=item["expression"]: F.expr(e))))
        elif kind == "map":
            steps.append(Map(lambda e, s=item.get("set", {}): set_fields(e, s)))
        elif kind == "mask":
            steps.append(Mask(item.get("fields", []), item.get("strategy", "redact"), key))
        else:
            raise ConfigError(f"pipeline[{i}]: unknown type {kind!r}")
    return Pipeline(steps, bool(table.get("failClosed", False)))


def set_fields(event: dict[str, Column], values: dict[str, str]) -> dict[str, Column]:
    """New columns from SQL by name; a name with a dot sets a field of a struct column."""
    out: dict[str, Column] = {}
    for name, sql in values.items():
        column, dot, path = name.partition(".")
        out[column] = out.get(column, event[column]).withField(path, F.expr(sql)) if dot else F.expr(sql)
    return out
