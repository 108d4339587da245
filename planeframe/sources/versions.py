"""Versions of a table of rows with ids, in a folder that engines share.

Rows are dealt into buckets by a hash of their id. A version names, for each
bucket, its files and a digest of its rows; the version itself is the digest of
these digests, so equal content has one version however it came about. A change
rewrites the buckets of its ids and no others. Commits are numbered files that
can be created once: of two engines that write at a time one wins, the other
reads what was committed and tries again. A commit also holds the idempotency
key of its change, so a key is known exactly if its change is.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StructField, StructType

from ..errors import IdempotencyConflictError, SnapshotUnavailableError, VersionConflictError
from ..model import digest, now

#: Buckets of a new table. A bucket is what the smallest change rewrites.
BUCKETS = 64


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this text unless there is one; whether it was created. It appears whole or not at all."""
    jvm, part = spark.sparkContext._jvm, f"{path}.{uuid.uuid4().hex}.tmp"
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file":
        local = urlparse(path).path if path.startswith("file:") else path
        os.makedirs(os.path.dirname(local), exist_ok=True)
        own = f"{local}.{uuid.uuid4().hex}.tmp"
        with open(own, "w") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(own, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True
    temp = jvm.org.apache.hadoop.fs.Path(part)
    fs.mkdirs(where.getParent())
    out = fs.create(temp, False)
    out.write(bytearray(text.encode()))
    out.close()
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(temp, where, none)
    except Exception as e:
        fs.delete(temp, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def _names(spark: SparkSession, folder: str) -> list[str]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def _text(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    file = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(file)).decode()
    finally:
        file.close()


def row_mark(schema: StructType) -> Column:
    """A digest of a row's values: columns by name, maps by key."""
    told = [F.array_sort(F.map_entries(f.name)).alias(f.name) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in sorted(schema.fields, key=lambda f: f.name)]
    return F.sha2(F.to_json(F.struct(*told), {"ignoreNullFields": "false"}), 256)


def sum_marks(mark: Column) -> Column:
    """One digest of many, whatever their order and partitions: sums of four parts of them."""
    parts = [F.coalesce(F.sum(F.conv(F.substring(mark, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for i in range(4)]
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), *parts), 256)


@dataclass(frozen=True)
class Commit:
    """One entry of the log. ``buckets`` has (folder of files, digest) by bucket; buckets without rows aren't there."""

    number: int
    version: str
    at: datetime
    buckets: dict[int, tuple[str, str]]
    key: str | None = None
    mark: str | None = None
    before: str | None = None
    more: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "at": self.at.isoformat(), "key": self.key, "mark": self.mark, "before": self.before, "buckets": {str(b): list(x) for b, x in sorted(self.buckets.items())}, "more": self.more})

    @classmethod
    def of(cls, number: int, text: str) -> Commit:
        d = json.loads(text)
        return cls(number, d["version"], datetime.fromisoformat(d["at"]), {int(b): tuple(x) for b, x in d["buckets"].items()}, d["key"], d["mark"], d["before"], d["more"])


class Versions:
    """The versions of one table. Every call reads what has been committed since the last one, by any engine."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, id_col: str):
        self.spark, self.folder, self.schema, self.id_col = spark, folder.rstrip("/"), schema, id_col
        self.commits: list[Commit] = []
        self.count = 0
        if self.log():
            self.count = self.commits[0].more["buckets"]

    @classmethod
    def create(cls, rows: DataFrame, folder: str, id_col: str, buckets: int = BUCKETS, at: datetime | None = None, **more) -> Versions:
        """The table in ``folder``, which holds these rows first. If another engine made it already it is taken as it is."""
        self = cls(rows.sparkSession, folder, rows.schema, id_col)
        if not self.commits:
            self.count = buckets
            written = self._written(rows)
            put_new(self.spark, self._file(0), Commit(0, _root(written), at or now(), written, more={"buckets": buckets, **more}).to_json())
            self.log()
            self.count = self.commits[0].more["buckets"]
        return self

    def _file(self, number: int) -> str:
        return f"{self.folder}/log/{number:012d}.json"

    def log(self) -> list[Commit]:
        """All commits, first to last."""
        for name in _names(self.spark, f"{self.folder}/log"):
            if name.endswith(".json") and int(name[:-5]) == len(self.commits):
                self.commits.append(Commit.of(len(self.commits), _text(self.spark, self._file(len(self.commits)))))
        return self.commits

    def head(self) -> Commit:
        return self.log()[-1]

    def at(self, version: str) -> Commit:
        for c in reversed(self.log()):
            if c.version == version:
                return c
        raise SnapshotUnavailableError(f"there is no version {version}")

    def receipt(self, key: str) -> Commit | None:
        """The commit that a key stands for."""
        return next((c for c in self.log() if c.key == key), None)

    def bucket(self, c: Column | str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.count)).cast("int")

    def rows(self, commit: Commit | None = None, buckets=None) -> DataFrame:
        """The rows of a commit's version, of some buckets only if these are named."""
        have = (commit or self.head()).buckets
        paths = [f"{self.folder}/{have[b][0]}" for b in sorted(have) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _written(self, rows: DataFrame) -> dict[int, tuple[str, str]]:
        part = f"data/{uuid.uuid4().hex}"
        rows.select(*[f"`{n}`" for n in self.schema.names]).withColumn("_bucket", self.bucket(self.id_col)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{part}")
        read = self.spark.read.schema(StructType([*self.schema.fields, StructField("_bucket", IntegerType())])).parquet(f"{self.folder}/{part}")
        marks = read.groupBy("_bucket").agg(sum_marks(row_mark(self.schema)).alias("mark")).collect()
        return {r["_bucket"]: (f"{part}/_bucket={r['_bucket']}", r["mark"]) for r in marks}

    def commit(self, ids: DataFrame, change: Callable[[DataFrame, Commit], DataFrame], key: str, mark: str, base: str | None = None, at: datetime | None = None, more: dict | None = None) -> tuple[Commit, bool]:
        """(commit, whether it was there before): the rows of the buckets of ``ids`` become what ``change`` makes of them.

        ``change`` gets the present rows of these buckets and the commit they are
        of, and is called again if another engine commits meanwhile; all ids of
        rows that it adds, alters or leaves out are in ``ids``. With a ``base``
        the change is refused on any other version. A key that stands for
        another change is refused.
        """
        touched = {r[0] for r in ids.select(self.bucket(ids.columns[0])).distinct().collect()}
        while True:
            if (old := self.receipt(key)) is not None:
                if old.mark != mark:
                    raise IdempotencyConflictError(f"{key} stands for another change")
                return old, True
            head = self.commits[-1]
            if base is not None and base != head.version:
                raise VersionConflictError(f"the table is at {head.version}, the change at {base}")
            written = self._written(change(self.rows(head, touched), head))
            same = {b: x for b, x in head.buckets.items() if b not in touched or written.get(b, ("", ""))[1] == x[1]}
            buckets = {**{b: x for b, x in written.items() if b not in same}, **same}
            done = Commit(head.number + 1, _root(buckets), at or now(), buckets, key, mark, head.version, {**head.more, **(more or {})})
            if put_new(self.spark, self._file(done.number), done.to_json()):
                self.log()
                return done, False


def _root(buckets: dict[int, tuple[str, str]]) -> str:
    return "sha256:" + digest({str(b): x[1] for b, x in sorted(buckets.items())})
