import json

import pytest

from millrace.errors import ConfigError, DecodeError, InputOutputError
from millrace.plans import cli, config, inspect

GOOD = '[source]\ndbname = "d"\nuser = "u"\npassword = "p"\ntables = ["public.t"]\n[sink]\n[capture]\n[snapshot]\n[state]\n[logging]\n'


def test_defaults():
    c = config.parse(GOOD).check()
    assert (c.sink.port, c.sink.heartbeat_interval_ms, c.snapshot.batch_size, c.snapshot.num_workers, c.capture.snapshot) == (8080, 30000, 1000, 4, True)
    assert "p" not in repr(c.source).split("password")[0][-3:] and "password" not in repr(c.source)


def test_round_trip():
    c = config.parse(GOOD)
    assert config.parse(config.as_toml(c)) == c


@pytest.mark.parametrize("text", ["[", "[source]\n", GOOD.replace("[state]\n", ""), GOOD + "format = 5\n"])
def test_bad_files(text):
    with pytest.raises(ConfigError):
        config.parse(text)


def test_all_problems_at_once():
    with pytest.raises(ConfigError) as e:
        config.parse(GOOD.replace('"d"', '""').replace('"u"', '""').replace("public.t", "bad;name").replace("[snapshot]", "[snapshot]\nbatchSize = 0")).check()
    for part in ("source.dbname is required", "source.user is required", "source.tables[0]", "snapshot.batchSize"):
        assert part in str(e.value)


def test_unknown_and_snake_keys_are_ignored():
    c = config.parse(GOOD.replace("[sink]", "[sink]\nmax_buffer_size = 5\nmaxBufferSize = 7\nwhat = 1"))
    assert c.sink.max_buffer_size == 7


def test_mysql_section():
    c = config.parse(GOOD + "[mysql_source]\nserverId = 0\n")
    with pytest.raises(ConfigError, match="mysqlSource.serverId"):
        c.check()
    assert c.mysql_source.redacted_url() == "mysql://:****@localhost:3306/"


def test_identifiers():
    assert config.identifier_error("public.übung_1", "x") is None
    assert config.identifier_error("", "x") and config.identifier_error("a-b", "x") and config.identifier_error("a b", "x")


def test_uris_and_options():
    assert config.from_uri("postgres://bob:pw@h:5433/shop", host="other") == {"user": "bob", "password": "pw", "host": "other", "port": 5433, "dbname": "shop"}
    assert config.normalized({"slotName": 1, "nested": {"apiKey": 2}}) == {"slot_name": 1, "nested": {"api_key": 2}}
    with pytest.raises(ConfigError):
        config.from_uri("nonsense")


TABLES = {"public.users": [("id", "integer", False), ("e_mail", "text", True), ("tags", "ARRAY", True), ("j", "jsonb", True), ("ok", "boolean", False)]}


def test_inspection():
    text = inspect.typescript(TABLES)
    assert "export interface PublicUsers {\n  id: number;\n  e_mail?: string;\n  tags?: unknown[];\n  j?: any;\n  ok: boolean;\n}" in text and "ChangeEvent" in text
    schema = inspect.json_schema(TABLES)["public.users"]
    assert schema["required"] == ["id", "ok"] and schema["properties"]["tags"]["type"] == "string"
    assert json.loads(inspect.json_schema_text(TABLES))


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["init", "--dbname", "d", "--user", "u", "--password", "p"]) == 0
    assert cli.main(["init"]) == ConfigError.exit_code
    assert cli.main(["init", "--force", "--dbname", "d", "--user", "u", "--password", "p"]) == 0
    assert (tmp_path / ".millrace/config.toml").stat().st_mode & 0o777 == 0o600
    data = tmp_path / "data"
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string").write.parquet(str(data / "t.parquet"))
    out = str(tmp_path / "events")
    assert cli.main(["capture", "--data", str(data), "--keys", '{"t": ["id"]}', "--output", out]) == 0
    assert cli.main(["capture", "--data", str(data), "--keys", '{"t": ["id"]}', "--output", out]) == 0  # complete: nothing is read again
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["snap:public.t:id=1", "snap:public.t:id=2"]
    assert cli.main(["inspect", "--data", str(data), "--format", "json", "--output", str(tmp_path / "s.json")]) == 0
    assert "t" in json.loads((tmp_path / "s.json").read_text())
    assert cli.main(["inspect", "--data", str(data), "--tables", "none"]) == ConfigError.exit_code
    (tmp_path / "bad.json").write_text("{}")
    assert cli.main(["test", "--file", "bad.json"]) == DecodeError.exit_code
    assert cli.main(["test", "--file", "gone.json"]) == InputOutputError.exit_code
    assert cli.main(["test", "--list"]) == 0


def test_schema_cache():
    from millrace.plans.catalog import SchemaCache

    reads = []
    c = SchemaCache(lambda db, t: reads.append((db, t)) or [("id", "integer", False)])
    c.get("shop", "t"), c.get("shop", "t"), c.get("shop", "u")
    assert len(reads) == 2
    assert c.saw("shop", "ALTER TABLE `t` ADD x int") == ("shop", "t") and c.saw("shop", "SELECT 1") is None
    c.get("shop", "t")
    assert len(reads) == 3
    c.invalidate_db("shop")
    assert c.held == {}
