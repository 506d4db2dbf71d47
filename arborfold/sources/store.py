"""The entry store as written tables: puts, reads, checks, versioned folders and a URL for each kind of place."""

from __future__ import annotations

import contextlib
import gc
import re
import sqlite3
from collections.abc import Iterator
from urllib.parse import parse_qsl, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborfold.operators.skew import positions
from arborfold.plans.cut import Cut, _delete

FORMAT_VERSION = 1


def get(entries: DataFrame, entry_id: str) -> DataFrame:
    """The rows of one entry; none if it is not there. The filter reaches the scan."""
    return entries.where(F.col("entry_id") == entry_id)


def put(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """stored (tree_id, entry_id, status) with what arrives: an id that is there stays as it is, a new one is unverified."""
    new = arriving.select("tree_id", "entry_id").dropDuplicates(["entry_id"]).join(stored.select("entry_id"), "entry_id", "left_anti")
    return stored.unionByName(new.withColumn("status", F.lit(2)))


def ordered(rows: DataFrame, *within: str) -> DataFrame:
    """rows with their position in canonical order (height, then id), from 1, within the given columns."""
    return positions(rows, within, ("height", "entry_id"))


def membership(entries: DataFrame, wanted: DataFrame, tree_id: str) -> DataFrame:
    """entry_id and state of wanted entries: ok, not_found or not_in_tree."""
    known = entries.select("entry_id", F.col("tree_id").alias("_t"))
    state = F.when(F.col("_t").isNull(), "not_found").when(F.col("_t") != tree_id, "not_in_tree").otherwise("ok")
    return wanted.join(known, "entry_id", "left").select("entry_id", state.alias("state"))


def save(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """Writes the tables and the format version they have into a folder."""
    for name, df in tables.items():
        df.write.format(form).mode("overwrite").save(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(FORMAT_VERSION, form)], "version int, form string").write.mode("overwrite").parquet(f"{folder}/_version")


def load(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame] | None:
    """The tables of a saved folder; None if nothing was saved there; an error for another format version."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{folder}/_version")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    version = spark.read.parquet(f"{folder}/_version").first()
    if version["version"] != FORMAT_VERSION:
        raise ValueError(f"format version {version['version']}, not {FORMAT_VERSION}")
    return {n: spark.read.format(version["form"]).load(f"{folder}/{n}") for n in names}


def set_metadata(spark: SparkSession, folder: str, values: dict[str, str]) -> None:
    """Replaces the one row of metadata of a folder."""
    spark.createDataFrame([(values,)], "metadata map<string,string>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/_metadata")


def get_metadata(spark: SparkSession, folder: str) -> dict[str, str]:
    return spark.read.parquet(f"{folder}/_metadata").first()["metadata"]


class UnknownPlace(ValueError):
    """A URL that names no place for tables."""


def reader(spark: SparkSession, url: str):  # noqa: ANN201
    """A function from table name to DataFrame for a place.

    parquet:FOLDER, json:FOLDER, orc:FOLDER; sqlite:FILE (read by ranges of rows); postgres://... and jdbc:URL (a driver
    must be there; what only the driver's process can reach is read at once, see read_embedded()); memory: (temporary
    views). Anything else is an error that says what would do.
    """
    kind, sep, rest = url.partition(":")
    if kind in ("parquet", "json", "orc") and rest:
        return lambda name: spark.read.format(kind).load(f"{rest.removeprefix('//')}/{name}")
    if kind == "sqlite" and rest:
        return lambda name: read_sqlite(spark, rest.removeprefix("//"), name)
    if kind in ("postgres", "postgresql") and rest:
        parts = urlsplit(url)
        options = {"url": f"jdbc:postgresql://{parts.hostname}:{parts.port or 5432}{parts.path}", "user": parts.username or "", "password": parts.password or ""}
        return lambda name: spark.read.format("jdbc").options(dbtable=name, **options).load()
    if kind == "jdbc" and rest:
        parts = urlsplit(rest)
        options = dict(parse_qsl(parts.query))
        plain = f"jdbc:{rest.split('?')[0]}"
        if _embedded(spark, plain):
            return lambda name: read_embedded(spark, dict(url=plain, dbtable=name, **options))
        return lambda name: spark.read.format("jdbc").options(url=plain, dbtable=name, **options).load()
    if kind == "memory" and sep:
        return spark.table
    hint = {"http": "services are no tables", "unix": "a socket is no table; read the database's own place", "": "the place is missing"}.get(kind, f"{kind!r} is not known" if sep else "a kind and a colon come first")
    raise UnknownPlace(f"{url!r}: {hint}; expected parquet:FOLDER, json:FOLDER, orc:FOLDER, sqlite:FILE, postgres://HOST/NAME, jdbc:URL or memory:")


_SQLITE_TYPES = {"INTEGER": "bigint", "INT": "bigint", "BIGINT": "bigint", "REAL": "double", "DOUBLE": "double", "BLOB": "binary", "BOOLEAN": "boolean"}


def read_sqlite(spark: SparkSession, file: str, name: str, range_rows: int = 500_000) -> DataFrame:
    """A table of an SQLite file that all executors can open, read in ranges of row numbers."""
    quoted = '"' + name.replace('"', '""') + '"'
    with contextlib.closing(sqlite3.connect(f"file:{file}?mode=ro", uri=True)) as con:
        columns = [(r[1], _SQLITE_TYPES.get(r[2].upper(), "string")) for r in con.execute(f"pragma table_info({quoted})")]
        low, high = con.execute(f"select min(rowid), max(rowid) from {quoted}").fetchone()
    if not columns:
        raise UnknownPlace(f"{file!r} has no table {name!r}")
    schema = ", ".join(f"`{c}` {t}" for c, t in columns)
    if low is None:
        return spark.createDataFrame([], schema)
    arrow = {"bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    names = [c for c, _ in columns]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with contextlib.closing(sqlite3.connect(f"file:{file}?mode=ro", uri=True)) as con:
            for batch in batches:
                for a in batch.column(0).to_pylist():
                    rows = con.execute(f"select * from {quoted} where rowid >= ? and rowid < ?", (a, a + range_rows))
                    while part := rows.fetchmany(20_000):
                        data = [[(bool(v) if t == "boolean" else str(v) if t == "string" else v) if v is not None else None for v in column] for column, (_, t) in zip(zip(*part), columns)]
                        yield pa.RecordBatch.from_arrays([pa.array(d, arrow[t]) for d, (_, t) in zip(data, columns)], names)

    n = (high - low) // range_rows + 1
    return spark.range(low, high + 1, range_rows, min(n, 10_000)).mapInArrow(read, schema)


def write_jdbc(df: DataFrame, url: str, name: str, mode: str = "append") -> None:
    """A table of a database by JDBC, written in parallel; by the driver alone if no other process can reach the database.

    The driver then takes written files of EMBEDDED_ROWS rows one after the other.
    """
    spark = df.sparkSession
    if not _embedded(spark, url):
        df.write.format("jdbc").options(url=url, dbtable=name).mode(mode).save()
        return
    jvm = spark.sparkContext._jvm
    utils, options, dialect = _jdbc(spark, {"url": url, "dbtable": name})
    with contextlib.closing(dialect.createConnectionFactory(options).apply(-1)) as con:
        kept = mode == "ignore" and utils.tableExists(con, options)
    if kept:
        return
    spark.createDataFrame([], df.schema).write.format("jdbc").options(url=url, dbtable=name).mode(mode).save()  # no rows, no tasks: the table is made here
    with contextlib.closing(dialect.createConnectionFactory(options).apply(-1)) as con:
        there = utils.getSchemaOption(con, options)
    schema = df._jdf.schema()
    statement = utils.getInsertStatement(name, schema, there, spark.conf.get("spark.sql.caseSensitive") == "true", dialect)
    cut = Cut(spark)
    df.write.option("maxRecordsPerFile", EMBEDDED_ROWS).parquet(f"{cut.base}/rows")
    context = getattr(getattr(jvm.org.apache.spark, "TaskContext$"), "MODULE$")
    for file in spark.read.schema(df.schema).parquet(f"{cut.base}/rows").inputFiles():  # a transaction each
        rows = spark.read.schema(df.schema).parquet(file)._jdf.collectAsList()
        context.setTaskContext(context.empty())  # it counts the rows there; no job can run in a thread that has one
        try:
            utils.savePartition(name, jvm.scala.jdk.javaapi.CollectionConverters.asScala(rows.iterator()), schema, statement, options.batchSize(), dialect, options.isolationLevel(), options)
        finally:
            context.unset()
        del rows
        gc.collect()  # Python's handles of Java objects are in cycles; till these are gone the JVM keeps the rows
    _delete(spark, cut.base)


#: Rows that the driver holds at a time on their way into or out of an embedded database.
EMBEDDED_ROWS = 100_000


def _embedded(spark: SparkSession, url: str) -> bool:
    """Whether the database runs in the driver's process (Derby without a server) and the executors are other processes."""
    return re.match("jdbc:derby:(?!//)", url) is not None and not spark.sparkContext._jsc.sc().isLocal()


def _jdbc(spark: SparkSession, options: dict[str, str]):  # noqa: ANN202
    """Spark's functions, options and dialect for a table."""
    jvm = spark.sparkContext._jvm
    jdbc = jvm.org.apache.spark.sql.execution.datasources.jdbc
    return jdbc.JdbcUtils, jdbc.JdbcOptionsInWrite(jvm.PythonUtils.toScalaMap(options)), jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(options["url"])


def read_embedded(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """A table of a database in the driver's process as it is now: the driver reads it and executors get it as a written table."""
    to_java = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    schema = spark.read.format("jdbc").options(**options).load().schema
    place = f"{Cut(spark).base}/embedded"
    none = spark.createDataFrame([], schema)
    none.write.parquet(place)
    utils, jdbc_options, dialect = _jdbc(spark, options)
    with contextlib.closing(dialect.createConnectionFactory(jdbc_options).apply(-1)) as con:
        rows = con.createStatement().executeQuery(f"select * from {options['dbtable']}")
        groups = utils.resultSetToRows(rows, none._jdf.schema()).grouped(EMBEDDED_ROWS)
        while groups.hasNext():
            part = spark._jsparkSession.createDataFrame(to_java(groups.next()), none._jdf.schema())
            DataFrame(part, spark).coalesce(1).write.mode("append").parquet(place)
            del part
            gc.collect()  # see write_jdbc()
    return spark.read.schema(schema).parquet(place)


def upsert(stored: DataFrame, arriving: DataFrame, keys: list[str]) -> DataFrame:
    """stored with arriving rows, which take the place of stored ones with the same keys; several of one key: any of them."""
    new = arriving.dropDuplicates(keys)
    return stored.join(new.select(*keys), keys, "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns))
