"""Configuration: a TOML file of sections, checked all at once."""

from __future__ import annotations

import dataclasses
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from ..errors import ConfigError, InputOutputError

SSL_MODES = ("disable", "require", "verify-ca", "verify-full")


def identifier_error(name: str, what: str) -> str | None:
    """Letters and digits of any script, _ and . only, and at least one of them."""
    if not name:
        return f"{what} must not be empty"
    if not all(c.isalnum() or c in "_." for c in name):
        return f"{what} {name!r} contains invalid characters: only letters, digits, underscore and dot are allowed"
    return None


@dataclass
class Source:
    host: str = "localhost"
    port: int = 5432
    dbname: str = ""
    user: str = ""
    password: str = field(default="", repr=False)
    slot_name: str = "millrace_slot"
    publication: str = "millrace_publication"
    tables: list[str] = field(default_factory=list)
    plugin: str = "pgoutput"
    ssl_mode: str = "disable"

    def problems(self) -> list[str]:
        out = [f"source.{n} is required" for n in ("dbname", "user", "password") if not getattr(self, n)]
        out += [f"source.{n} must not contain null bytes" for n in ("dbname", "user") if "\0" in getattr(self, n)]
        names = [(self.slot_name, "source.slotName"), (self.publication, "source.publication"), *((t, f"source.tables[{i}]") for i, t in enumerate(self.tables)), (self.plugin, "source.plugin")]
        out += filter(None, (identifier_error(*x) for x in names))
        if self.ssl_mode not in SSL_MODES:
            out.append(f"invalid sslMode {self.ssl_mode!r}: expected {', '.join(SSL_MODES)}")
        return out


@dataclass
class MySqlSource:
    host: str = "localhost"
    port: int = 3306
    dbname: str = ""
    user: str = ""
    password: str = field(default="", repr=False)
    tables: list[str] = field(default_factory=list)
    server_id: int = 12345
    binlog_file: str | None = None
    binlog_offset: int | None = None
    binlog_retention_warning_threshold: int = 86_400

    def problems(self) -> list[str]:
        out = [f"mysqlSource.{n} is required" for n in ("host", "dbname", "user", "password") if not getattr(self, n)]
        if self.server_id == 0:
            out.append("mysqlSource.serverId must be > 0")
        return out + list(filter(None, (identifier_error(t, f"mysqlSource.tables[{i}]") for i, t in enumerate(self.tables))))

    def redacted_url(self) -> str:
        return f"mysql://{self.user}:****@{self.host}:{self.port}/{self.dbname}"


@dataclass
class Sink:
    host: str = "0.0.0.0"
    port: int = 8080
    max_buffer_size: int = 1000
    heartbeat_interval_ms: int = 30_000
    api_key: str | None = field(default=None, repr=False)


@dataclass
class CaptureSettings:
    from_lsn: str | None = None
    snapshot: bool = True
    max_batch_size: int = 100
    flush_interval_ms: int = 1000


@dataclass
class SnapshotSettings:
    batch_size: int = 1000
    num_workers: int = 4
    tables: list[str] = field(default_factory=list)

    def problems(self) -> list[str]:
        out = ["snapshot.batchSize must be > 0"] if self.batch_size <= 0 else []
        if self.num_workers < 1:
            out.append("snapshot.numWorkers must be > 0")
        return out + list(filter(None, (identifier_error(t, f"snapshot.tables[{i}]") for i, t in enumerate(self.tables))))


@dataclass
class StateSettings:
    path: str = ".millrace/state"
    max_backup_size_kb: int = 10_240


@dataclass
class Logging:
    format: str = "json"
    level: str = "info"
    file: str | None = None


SECTIONS = {"sink": Sink, "capture": CaptureSettings, "snapshot": SnapshotSettings, "state": StateSettings, "logging": Logging}


@dataclass
class Config:
    source: Source
    sink: Sink
    capture: CaptureSettings
    snapshot: SnapshotSettings
    state: StateSettings
    logging: Logging
    mysql_source: MySqlSource | None = None

    def check(self) -> "Config":
        problems = (self.mysql_source or self.source).problems() + self.snapshot.problems()
        if problems:
            raise ConfigError(f"config validation failed: {'; '.join(problems)}")
        return self


def snake(name: str) -> str:
    return re.sub(r"(?<!^)([A-Z])", r"_\1", name).lower()


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p.capitalize() for p in rest)


def section(kind, values: dict):
    """A section of camelCase keys; others are ignored, a value of the wrong type is an error."""
    known, out = {camel(f.name): f for f in dataclasses.fields(kind)}, {}
    for key, value in values.items():
        f = known.get(key)
        if f is None:
            continue
        types = {"str": str, "int": int, "bool": bool, "list[str]": list, "str | None": str, "int | None": int}
        want = types[f.type]
        if not isinstance(value, want) or (want is int and isinstance(value, bool)):
            raise ConfigError(f"{key}: {value!r} is not of type {f.type}")
        out[f.name] = value
    return kind(**out)


def parse(text: str) -> Config:
    try:
        table = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"Failed to parse config: {e}") from e
    missing = [s for s in SECTIONS if s not in table]
    if missing:
        raise ConfigError(f"missing sections: {', '.join(missing)}")
    parts = {name: section(kind, table[name]) for name, kind in SECTIONS.items()}
    mysql = table.get("mysql_source")
    return Config(source=section(Source, table.get("source", {})), mysql_source=None if mysql is None else section(MySqlSource, mysql), **parts)


def load(path: str) -> Config:
    try:
        text = Path(path).read_text()
    except OSError as e:
        raise InputOutputError(f"{path}: {e}") from e
    return parse(text).check()


def normalized(options: dict) -> dict:
    """Options of a program's call with their keys in snake case, nested ones too."""
    return {snake(k): normalized(v) if isinstance(v, dict) else v for k, v in options.items()}


def from_uri(uri: str | None = None, **fields) -> dict:
    """Connection fields of a URI (scheme://user:password@host:port/db); fields that are given win over it."""
    out = {}
    if uri:
        m = re.fullmatch(r"(\w+)://(?:([^:@/]*)(?::([^@]*))?@)?([^:/?]+)(?::(\d+))?(?:/([^?]*))?(?:\?.*)?", uri)
        if not m:
            raise ConfigError("not a connection URI")
        out = {"user": m[2], "password": m[3], "host": m[4], "port": int(m[5]) if m[5] else None, "dbname": m[6]}
        out = {k: v for k, v in out.items() if v is not None}
    return out | {k: v for k, v in fields.items() if v is not None}


def as_toml(config: Config) -> str:
    """The configuration as a file that load() reads."""
    lines = []
    for f in dataclasses.fields(config):
        part = getattr(config, f.name)
        if part is None:
            continue
        lines.append(f"[{f.name}]")
        for g in dataclasses.fields(part):
            value = getattr(part, g.name)
            if value is not None:
                text = str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, int) else "[" + ", ".join(map(quoted, value)) + "]" if isinstance(value, list) else quoted(value)
                lines.append(f"{camel(g.name)} = {text}")
        lines.append("")
    return "\n".join(lines)


def quoted(text: str) -> str:
    import json

    return json.dumps(text)
