"""Filters over events, with the outcomes of a script that looks at a JSON event.

An absent row image makes a test an error, and an error lets the event pass; a missing or null field of an image that is there makes a
comparison false.  So a test has three outcomes, true, false and null for error, and `keeps` turns null into true.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Test:
    """A test of events: build(schema) is its column, null for an error."""

    build: object

    def column(self, events: DataFrame) -> Column:
        return self.build(events.schema)

    # as in a script, the right side isn't looked at if the left one decides, and an error on the left is the outcome
    def __and__(self, other: "Test") -> "Test":
        return Test(lambda s: F.when(self.build(s).isNull(), F.lit(None).cast("boolean")).when(~self.build(s), F.lit(False)).otherwise(other.build(s)))

    def __or__(self, other: "Test") -> "Test":
        return Test(lambda s: F.when(self.build(s).isNull(), F.lit(None).cast("boolean")).when(self.build(s), F.lit(True)).otherwise(other.build(s)))

    def __invert__(self) -> "Test":
        return Test(lambda s: ~self.build(s))


class Field:
    """A field of an image, by a path of names.  Comparisons make tests."""

    def __init__(self, image: str, path: str):
        self.image, self.path = image, path.split(".")

    def value(self, schema: T.StructType) -> Column | None:
        """The field's column; None if the image's type hasn't got it."""
        kind, c = schema[self.image].dataType, F.col(self.image)
        if isinstance(kind, T.StringType):
            return F.get_json_object(c, "$" + "".join(f"['{p}']" for p in self.path))
        for p in self.path:
            if not isinstance(kind, T.StructType) or p not in kind.fieldNames():
                return None
            c, kind = c.getField(p), kind[p].dataType
        return c

    def _test(self, compare) -> Test:
        def build(schema):
            value = self.value(schema)
            outcome = F.lit(False) if value is None else F.coalesce(compare(value), F.lit(False))
            return F.when(F.col(self.image).isNotNull(), outcome)

        return Test(build)

    def __eq__(self, other):
        return self._test(lambda c: c == other)

    def __ne__(self, other):
        # a missing field differs from any value
        return ~(self == other)

    def __gt__(self, other):
        return self._test(lambda c: self._number(c, other) > other)

    def __ge__(self, other):
        return self._test(lambda c: self._number(c, other) >= other)

    def __lt__(self, other):
        return self._test(lambda c: self._number(c, other) < other)

    def __le__(self, other):
        return self._test(lambda c: self._number(c, other) <= other)

    def isin(self, *values) -> Test:
        return self._test(lambda c: c.isin(*values))

    __hash__ = None

    @staticmethod
    def _number(c: Column, other) -> Column:
        return c.try_cast("double") if isinstance(other, int | float) else c


def after(path: str) -> Field:
    return Field("after", path)


def before(path: str) -> Field:
    return Field("before", path)


def where(condition: Column | str) -> Test:
    """A test from a column or SQL text over the envelope; its null is an error."""
    return Test(lambda _: F.expr(condition) if isinstance(condition, str) else condition)


def op_is(*ops: str) -> Test:
    return Test(lambda _: F.col("op").isin(*ops))


def op_is_not(*ops: str) -> Test:
    return Test(lambda _: ~F.col("op").isin(*ops))


def keeps(test: Test, events: DataFrame) -> Column:
    """Whether a filter keeps an event: what fails the test goes, what can't be tested stays."""
    return F.coalesce(test.column(events), F.lit(True))


def outcome(test: Test, events: DataFrame) -> Column:
    """pass, dropped or error."""
    c = test.column(events)
    return F.when(c.isNull(), "error").when(c, "pass").otherwise("dropped")


def subscribed(events: DataFrame, tables: list[str] = (), ops: list[str] = (), after_position: tuple | None = None, position: list[str] = ()) -> DataFrame:
    """Events of those tables (schema.table) and operations, after a position; an empty list asks for all.

    position: the columns that order events; after_position: their values at the last event seen.
    """
    out = events
    if tables:
        out = out.filter(F.concat_ws(".", "source.schema", "source.table").isin(*tables))
    if ops:
        out = out.filter(F.col("op").isin(*ops))
    if after_position is not None:
        terms = []
        for i, c in enumerate(position):
            same = [F.col(p) == v for p, v in zip(position[:i], after_position)]
            terms.append(reduce(lambda a, b: a & b, [*same, F.col(c) > after_position[i]]))
        out = out.filter(reduce(lambda a, b: a | b, terms))
    return out
