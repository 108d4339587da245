"""Relational tables: one read-only SQL statement."""

from __future__ import annotations

import re
import threading
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ExecutionError, SnapshotUnavailableError
from ..model import EffectLevel, SnapshotRef, SourceDescriptor, SourceKind, SourceRef, digest, now
from ..operators import Relation, evidence_frame, with_order
from ..operators.relation import IDS, ORDER, evidence_id
from .base import Source, SourceResult

#: Nodes of a parsed statement that only read; a statement with any other node is refused.
READS = frozenset(
    "Project Filter Aggregate UnresolvedHaving Sort GlobalLimit LocalLimit Limit Offset Distinct Deduplicate Join LateralJoin AsOfJoin SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedWith"
    " CTE CTERelationDef CTERelationRef Union Intersect Except UnresolvedInlineTable LocalRelation OneRowRelation UnresolvedRelation Generate Window WithWindowDefinition Pivot UnresolvedPivot Unpivot"
    " UnresolvedUnpivot Sample UnionLoop UnionLoopRef UnresolvedTableValuedFunction UnresolvedTVFAliases Range Expand NameParameterizedQuery GroupingSets UnresolvedHint ResolvedHint Subquery RelationTimeTravel".split()
)
#: Names of the one language there is; statements in all of them are Spark SQL.
LANGUAGES = ("sql", "spark", "sqlite")
_HEAD = re.compile(r"^[\s:|+-]*'?([A-Za-z]+)")
_UNSAFE = re.compile(r"\b(reflect|java_method|try_reflect)\b", re.IGNORECASE)


def check_read_only(spark: SparkSession, statement: str, tables) -> None:
    """Refuse what isn't one reading statement over the given tables: the whole parsed tree must be of reading nodes."""
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement).treeString()
    except Exception as e:
        raise ExecutionError(f"can't parse the statement: {str(e)[:300]}") from None
    if _UNSAFE.search(statement):
        raise ExecutionError("the statement calls a function that runs foreign code")
    names = {t.lower() for t in tables}
    ctes = {m.lower() for m in re.findall(r"(?i)(?:\bwith\s+(?:recursive\s+)?|,\s*)`?(\w+)`?\s*(?:\([^()]*\)\s*)?as\s*\(", statement)}
    for line in tree.splitlines():
        m = _HEAD.match(line)
        if not m or m[1].endswith("subquery"):
            continue
        if m[1] not in READS:
            raise ExecutionError(f"only reading statements are allowed, not {m[1]}")
        if m[1] == "UnresolvedRelation":
            own = re.search(r"UnresolvedRelation \[([^\]]*)\]", line)
            name = own[1].lower().replace("`", "") if own else "?"
            if name not in names | ctes:
                raise ExecutionError(f"no table {name}")


def files_mark(spark: SparkSession, path: str) -> str:
    """A fingerprint of a table's files: names, sizes, times of change."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, at = [], fs.listFiles(where, True)
    while at.hasNext():
        f = at.next()
        found.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return digest(sorted(found))


class TableSource(Source):
    """Tables by name (frames, or paths of Parquet). A query returns at most ``row_limit`` rows, all of them if that is None.

    Without a given one the version is a fingerprint of the schemas and of the
    files behind paths, taken anew whenever it is asked for. A result with a
    limit is read at once, so its value, rows and evidence are the same rows,
    and refused if the files changed meanwhile; one without a limit stays lazy,
    and says so when it is finalized.
    """

    _lock = threading.Lock()

    def __init__(self, spark: SparkSession, source_id: str, tables: Mapping[str, DataFrame | str], row_limit: int | None = 1000, version: str | None = None):
        self.spark, self.row_limit = spark, row_limit
        self.tables = {n: spark.read.parquet(t) if isinstance(t, str) else t for n, t in tables.items()}
        self.paths = {n: t for n, t in tables.items() if isinstance(t, str)}
        self.ref, self.given = SourceRef(source_id, SourceKind.TABLE), version
        version = self._version()
        self.descriptor = SourceDescriptor(self.ref, frozenset({"query"}), EffectLevel.READ, version, {n: t.schema.jsonValue() for n, t in self.tables.items()})
        self._snapshot = SnapshotRef(self.ref, version, None, now())

    def _version(self) -> str:
        if self.given:
            return self.given
        return "data:" + digest({n: t.schema.jsonValue() for n, t in self.tables.items()}, {n: files_mark(self.spark, p) for n, p in self.paths.items()})[:16]

    def latest(self) -> SnapshotRef:
        version = self._version()
        if version != self._snapshot.version:
            self.tables |= {n: self.spark.read.parquet(p) for n, p in self.paths.items()}
            self._snapshot = SnapshotRef(self.ref, version, None, now())
        return self._snapshot

    def frame(self, statement: str, parameters: Mapping | None = None) -> DataFrame:
        """The statement's whole result, lazily."""
        check_read_only(self.spark, statement, self.tables)
        with self._lock:  # names are resolved when the statement is analysed, so views need live no longer
            for name, t in self.tables.items():
                t.createOrReplaceTempView(name)
            try:
                df = self.spark.sql(statement, args=dict(parameters or {}))
            finally:
                for name in self.tables:
                    self.spark.catalog.dropTempView(name)
        if len(set(df.columns)) < len(df.columns):
            raise ExecutionError(f"columns need distinct names: {df.columns}")
        return df

    def query(self, op, context) -> SourceResult:
        snap = self.snapshot(context)
        if op.language.lower() not in LANGUAGES:
            raise ExecutionError(f"no language {op.language}")
        whole = self.frame(op.statement, op.parameters)
        names = whole.columns
        quoted = [f"`{n}`" for n in names]
        first, more = whole, False
        if self.row_limit is not None:
            got = whole.limit(self.row_limit + 1).toArrow()
            more = got.num_rows > self.row_limit
            first = self.spark.createDataFrame(got.slice(0, self.row_limit), schema=whole.schema) if got.num_rows else whole.sparkSession.createDataFrame([], whole.schema)
            if self._version() != snap.version:
                raise SnapshotUnavailableError(f"{self.ref.source_id} changed while it was read")
        # without an order of its own a row is known by its content and how many like it came before
        content = F.to_json(F.struct(*sorted(quoted)), {"ignoreNullFields": "false"})
        rows = first.withColumn("_content", content).withColumn(ORDER, F.monotonically_increasing_id())
        if self.row_limit is not None:
            rows = with_order(rows, F.col(ORDER))
        rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_content").orderBy(ORDER)) - 1)
        locator = F.concat(F.lit(f"table://{self.ref.source_id}/query/{digest(op.statement)[:16]}#row="), F.substring(F.sha2("_content", 256), 1, 16), F.lit("."), F.col("_nth").cast("string"))
        evidence = evidence_frame(rows, op.op_id, "table", self.ref.source_id, snap.version, locator, F.col("_content"), metadata=F.create_map(F.lit("row_index"), F.col(ORDER).cast("string")))
        bound = rows.select(*quoted, ORDER, F.array(evidence_id(op.op_id, locator, F.lit(snap.version))).alias(IDS))

        def truncated() -> str | None:
            return f"more than {self.row_limit} rows; the rest was left out" if more else None

        def changed() -> str | None:
            return None if self._version() == snap.version else f"{self.ref.source_id} has changed since {snap.version}"

        return SourceResult(first, Relation(tuple(names), bound, evidence), snap, partial=(truncated, changed))
