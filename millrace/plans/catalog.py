"""What is known of tables: a cache of their columns, dropped when a statement changes them."""

from __future__ import annotations

import re
from collections.abc import Callable

from ..functions.scalars import DDL

Columns = list[tuple[str, str, bool]]


class SchemaCache:
    """Columns of (database, table), read once and kept until a DDL statement or a call drops them."""

    def __init__(self, read: Callable[[str, str], Columns]):
        self.read, self.held = read, {}

    def get(self, db: str, table: str) -> Columns:
        if (db, table) not in self.held:
            self.held[(db, table)] = self.read(db, table)
        return self.held[(db, table)]

    def invalidate(self, db: str, table: str) -> None:
        self.held.pop((db, table), None)

    def invalidate_db(self, db: str) -> None:
        self.held = {k: v for k, v in self.held.items() if k[0] != db}

    def saw(self, schema: str, statement: str) -> tuple[str, str] | None:
        """Drops what a statement changes; (database, table), or None if it changes none."""
        m = re.match(DDL, statement)
        if not m:
            return None
        changed = (m[2] or schema, m[3])
        self.invalidate(*changed)
        return changed


def from_jdbc(spark, url: str, properties: dict | None = None) -> Callable[[str, str], Columns]:
    """Reads columns from a database's information_schema."""

    def read(db: str, table: str) -> Columns:
        query = f"(SELECT column_name, data_type, is_nullable, ordinal_position FROM information_schema.columns WHERE table_schema = '{db.replace(chr(39), chr(39) * 2)}' AND table_name = '{table.replace(chr(39), chr(39) * 2)}') AS c"
        rows = spark.read.jdbc(url, query, properties=properties or {}).orderBy("ordinal_position").collect()
        return [(r[0], r[1], r[2] == "YES") for r in rows]

    return read
