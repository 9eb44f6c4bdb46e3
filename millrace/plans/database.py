"""A table in a database that the driver and every executor can read: an embedded one, in a file of the shared folder.

A Java process has an embedded database in memory for itself, and locks one in a folder.  One that lies in a jar is
read only, and any number of processes may open it.
"""

from __future__ import annotations

import json
import shutil
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigError, SnapshotError
from ..storage import new_folder

KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE"}


def mounted(spark: SparkSession, path: str) -> Path:
    """A path of Spark's as one that the database can open."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    if uri.getScheme() != "file":
        raise ConfigError(f"an embedded database can't lie in {path}: spark.checkpoint.dir must be a folder that is mounted on all machines")
    return Path(uri.getPath())


def in_database(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """The rows (of numbers) as a table of a database that is read only; its URL.

    Tasks write them as text, the driver's database reads these files itself: rows neither pass through Spark's driver nor are held in memory.
    """
    if odd := [f"{c} {kind}" for c, kind in rows.dtypes if kind not in KINDS]:
        raise SnapshotError(f"no column type for {', '.join(odd)}")
    path = new_folder(spark)
    folder = mounted(spark, path)
    rows.write.option("compression", "none").csv(f"{path}/text")
    manager, url = spark.sparkContext._jvm.java.sql.DriverManager, f"jdbc:derby:{folder}/db"
    connection = manager.getConnection(f"{url};create=true")
    try:
        columns = ", ".join(f'"{c}" {KINDS[kind]}' for c, kind in rows.dtypes)
        connection.createStatement().execute(f"CREATE TABLE {name} ({columns})")
        load = connection.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, NULL, NULL, 'UTF-8', 0)")
        for part in sorted((folder / "text").glob("part-*")):
            load.setString(1, name.upper())
            load.setString(2, str(part))
            load.execute()
    finally:
        connection.close()
        _shut(manager, url)
    # a process that opens the jar makes a folder for temporary files: beside the jar, as its own place for them may be gone by then
    settings = folder / "db/service.properties"
    settings.write_bytes(f"derby.storage.tempDirectory={json.dumps(f'{folder}/open')[1:-1]}\n".encode() + settings.read_bytes())
    # not compressed, so that a page is found without reading those before it
    with zipfile.ZipFile(folder / "db.jar", "w", zipfile.ZIP_STORED) as jar:
        for p in sorted((folder / "db").rglob("*")):
            jar.write(p, p.relative_to(folder))
    for made in ("text", "db"):
        shutil.rmtree(folder / made)
    return f"jdbc:derby:jar:({folder}/db.jar)db"


def _shut(manager, url: str) -> None:
    """Ends a database, which it reports as an error."""
    try:
        manager.getConnection(f"{url};shutdown=true")
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":
            raise
