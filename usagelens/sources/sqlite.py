"""A read-only SQLite table as a Spark source: rowid ranges are partitions, comparisons are pushed down.

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite").option("path", p).option("table", "session").option("partitions", 8).load()

With ``spark.sql.python.filterPushdown.enabled`` the filters reach SQLite. The file must be readable by all executors.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import DataType, DoubleType, LongType, StringType, StructField, StructType

_OPS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def kind(declared: str) -> DataType:
    """By SQLite's affinity rules: INT anywhere is an integer, then text, then real; a blob or nothing declared stays text."""
    d = declared.upper()
    if "INT" in d:
        return LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")) or not d or "BLOB" in d:
        return StringType()
    return DoubleType() if any(x in d for x in ("REAL", "FLOA", "DOUB")) else StringType()


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    """Read-only with a busy timeout; where the write-ahead log can't be mapped, a normal open that only queries. No file is ever made."""
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    try:
        db = sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=5)
        db.execute("select 1 from sqlite_master limit 1").fetchall()
        return db
    except sqlite3.OperationalError:
        db = sqlite3.connect(f"file:{path}?mode=rw", uri=True, timeout=5)
        db.execute("pragma query_only = on")
        return db


def declared(path: str, table: str) -> dict[str, DataType]:
    """The columns of a table and their types."""
    with opened(path) as db:
        return {r[1]: kind(r[2]) for r in db.execute(f"pragma table_info({quoted(table)})")}


class Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.table, self.n, self.schema = options["path"], options["table"], int(options.get("partitions", "1")), schema
        self.where: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _OPS and len(f.attribute) == 1:
                self.where.append((f.attribute[0], f"{_OPS[type(f)]} ?", (f.value,)))
            elif isinstance(f, In) and len(f.attribute) == 1:
                self.where.append((f.attribute[0], f"in ({', '.join('?' * len(f.value))})", tuple(f.value)))
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1:
                self.where.append((f.attribute[0], "is not null", ()))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        with opened(self.path) as db:
            lo, hi = db.execute(f"select min(rowid), max(rowid) from {quoted(self.table)}").fetchone()
        if lo is None:
            return [Range(0, 0)]
        step = -(-(hi - lo + 1) // self.n)
        return [Range(a, min(a + step, hi + 1)) for a in range(lo, hi + 1, step)]

    def statement(self, partition: Range) -> tuple[str, list]:
        """What SQLite is asked for a range, and the values in it."""
        columns = ", ".join(quoted(f.name) for f in self.schema.fields)
        where = "".join(f" and {quoted(c)} {op}" for c, op, _ in self.where)
        values = [v for _, _, vs in self.where for v in vs]
        return f"select {columns} from {quoted(self.table)} where rowid >= ? and rowid < ?{where}", [partition.lo, partition.hi, *values]

    def read(self, partition: Range) -> Iterator[tuple]:
        db = opened(self.path)
        try:
            yield from db.execute(*self.statement(partition))
        finally:
            db.close()


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        return StructType([StructField(n, k) for n, k in declared(self.options["path"], self.options["table"]).items()])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)
