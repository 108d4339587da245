"""Queries over the driver's tables, one for each operator and feature, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .engine import Catalog, Engine
from .functions.text import lower_letters, quoted, upper_letters
from .model import Budget, ScopeRef
from .operators import Relation, compose_evidence, filter_rows, fuse, join_pairs, join_rows, project
from .operators.relation import IDS, ORDER, col, evidence_frame, ranked, with_order
from .plans import Binding, Filter, Fuse, Join, Plan, Project, Query, Ref, Search, Traverse
from .sources import DocumentSource, GraphSource, SkillSource, SkillSpec, TableSource
from .sources.document import apply_changes, search_frame
from .sources.graph import paths
from .sources.memory import close_and_append, conflict_pairs, recall_frame, visible
from .sources.skill import resolve_frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(df: DataFrame, key: str, *fields: str) -> Relation:
    """A table as a relation whose order is a unique number column; its evidence ids are that number."""
    fields = fields or tuple(df.columns)
    return Relation(tuple(fields), df.select(*fields, F.col(key).cast("long").alias(ORDER), F.array(F.col(key).cast("string")).alias(IDS)))


# --- documents

FOLD = "replace(lower({c}), 'ß', 'ss')"
SCORE = (
    "round(greatest(len(list_intersect([{tokens}], list_distinct(regexp_extract_all(" + FOLD + ", '[\\p{{L}}\\p{{N}}_]+'))))::DOUBLE / {n}, CASE WHEN contains(" + FOLD + ", '{phrase}') THEN 1.0 ELSE 0.0 END), 8)"
)


def score_sql(column: str, text: str) -> str:
    tokens = sorted(set(text.lower().split()))
    return SCORE.format(c=column, tokens=", ".join(f"'{t}'" for t in tokens), n=len(tokens), phrase=text.lower())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("content"), F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"))


def _search_sql(text: str, frm: str, ident: str, column: str, where: str = "true", limit: int = 20) -> str:
    return f"SELECT document_id, score FROM (SELECT {ident} AS document_id, {score_sql(column, text)} AS score FROM {frm} WHERE {where}) WHERE score > 0 ORDER BY score DESC, document_id LIMIT {limit}"


@query(_search_sql("the and zzz", "documents", "doc_id::VARCHAR", "text"))
def search_documents(spark, sf_dir):
    return search_frame(documents(spark, sf_dir), "the and zzz", 20).select("document_id", "score")


@query(_search_sql("heat tion stupid", "documents", "doc_id::VARCHAR", "text", "lang = 'en' AND source = 'src3'"))
def search_filtered(spark, sf_dir):
    return search_frame(documents(spark, sf_dir), "heat tion stupid", 20, {"lang": "en", "source": "src3"}).select("document_id", "score")


@query(_search_sql("of the", "documents", "doc_id::VARCHAR", "text", "true", 50))
def search_phrase(spark, sf_dir):
    return search_frame(documents(spark, sf_dir), "of the", 50).select("document_id", "score")


@query(_search_sql("weiß und nicht", "documents", "doc_id::VARCHAR", "text", "true", 50).replace("weiß", "weiss"))
def search_folded(spark, sf_dir):
    return search_frame(documents(spark, sf_dir), "weiß und nicht", 50).select("document_id", "score")


@query(_search_sql("the", "documents", "doc_id::VARCHAR", "text", "false"))
def search_missing_key(spark, sf_dir):
    """A null filter value matches documents without the key: here each has a language, so none."""
    return search_frame(documents(spark, sf_dir), "the", 20, {"lang": None}).select("document_id", "score")


@query(_search_sql("track blog nav", "pages", "page_id::VARCHAR", "html"))
def search_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("document_id"), F.col("html").alias("content"), F.create_map().cast("map<string,string>").alias("metadata"))
    return search_frame(p, "track blog nav", 20).select("document_id", "score")


@query(_search_sql("how the answer", "conversations", "conv_id || '/' || turn", "text", "role = 'user'"))
def search_conversations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("document_id"), F.col("text").alias("content"), F.create_map(F.lit("role"), "role").alias("metadata"))
    return search_frame(c, "how the answer", 20, {"role": "user"}).select("document_id", "score")


# --- tables


def warehouse(spark: SparkSession, sf_dir: str) -> TableSource:
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels", "documents")
    return TableSource(spark, "warehouse", {n: f"{sf_dir}/{n}.parquet" for n in names})


def _sql(name: str, spark_sql: str, duck: str | None = None, parameters: dict | None = None) -> None:
    def run(spark, sf_dir):
        return warehouse(spark, sf_dir).frame(spark_sql, parameters)

    QUERIES[name], ORACLE_SQL[name] = run, duck or spark_sql


_sql("query_params", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > :low AND o_orderstatus = :st", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'", {"low": 200000, "st": "F"})
_sql("query_groupby", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, count(DISTINCT l_suppkey) AS suppliers, round(avg(l_discount), 6) AS disc FROM lineitem GROUP BY l_returnflag, l_linestatus")
_sql("query_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12")
_sql("query_filtered_agg", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, round(sum(value) FILTER (WHERE value <= 50), 4) AS low FROM events GROUP BY event_type")
_sql("query_join", "SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
_sql("query_left_join", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
_sql("query_full_join", "SELECT n.n_nationkey AS nation, s.s_suppkey AS supplier FROM (SELECT * FROM nation WHERE n_regionkey < 3) n FULL OUTER JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON n.n_nationkey = s.s_nationkey")
_sql("query_semi_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
_sql("query_theta_join", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_sql("query_window", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders")
_sql("query_window_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n3, max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top, ntile(4) OVER (PARTITION BY user_id ORDER BY ts) AS q FROM events")
_sql("query_rollup", "SELECT o_orderstatus, o_orderpriority, grouping(o_orderpriority) AS g, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_sql("query_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_sql("query_setops", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 UNION SELECT s_nationkey AS k FROM supplier EXCEPT SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1")
_sql("query_intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'")
_sql("query_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
_sql("query_subquery", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) * 1.2 FROM part)")
_sql("query_case_null", "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, nullif(o_orderstatus, 'F') AS st, coalesce(nullif(o_orderstatus, 'F'), 'none') AS st2 FROM orders")
_sql("query_cte_recursive", "WITH RECURSIVE t(n, s) AS (SELECT 1, 1 UNION ALL SELECT n + 1, s + n + 1 FROM t WHERE n < 20) SELECT n, s, n_name FROM t JOIN nation ON n_nationkey = n")
_sql("query_json", "SELECT cast(get_json_object(props, '$.k') AS int) AS k, count(*) AS n FROM events GROUP BY cast(get_json_object(props, '$.k') AS int)", "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY ALL")
_sql("query_dates", "SELECT date_format(o_orderdate, 'yyyy-MM') AS month, count(*) AS n FROM orders GROUP BY date_format(o_orderdate, 'yyyy-MM')", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL")
_sql("query_strings", "SELECT p_partkey, upper(p_name) AS u, length(p_name) AS n, substring(p_brand, 1, 5) AS b, replace(p_type, ' ', '_') AS t, p_name LIKE '%a%' AS has_a FROM part")
_sql("query_hash", "SELECT event_id, sha2(concat(cast(event_id AS string), '|', event_type), 256) AS h FROM events", "SELECT event_id, sha256(event_id::VARCHAR || '|' || event_type) AS h FROM events")

_sql("query_subquery_rows", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
_sql("query_right_join", "SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') o RIGHT JOIN customer ON o_custkey = c_custkey")
_sql("query_range_join", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON b.n_nationkey BETWEEN a.n_nationkey + 1 AND a.n_nationkey + 3")
_sql("query_null_logic", "SELECT o_orderkey, o_orderstatus NOT IN ('F', nullif(o_orderstatus, 'P')) AS a, nullif(o_orderstatus, 'F') IS NULL AS b, nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM nullif(o_orderpriority, '1-URGENT') AS c FROM orders")
_sql("query_empty_aggregate", "SELECT sum(o_totalprice) AS s, count(o_totalprice) AS n, max(o_orderdate) AS d, coalesce(cast(sum(o_totalprice) AS double), cast(0 AS double)) AS t FROM orders WHERE o_orderkey < 0")
_sql("query_string_agg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
_sql("query_division", "SELECT o_orderkey, o_custkey div 7 AS whole, o_custkey / 7 AS part, -o_custkey div 7 AS negative, o_custkey % 7 AS rest FROM orders", "SELECT o_orderkey, o_custkey // 7 AS whole, o_custkey / 7 AS part, -o_custkey // 7 AS negative, o_custkey % 7 AS rest FROM orders")
_sql("query_division_by_zero", "SELECT o_orderkey, try_divide(o_totalprice, o_custkey % 5) AS ratio FROM orders", "SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice / (o_custkey % 5) END AS ratio FROM orders")
_sql("query_concat", "SELECT n_name || '-' || n_nationkey AS a, concat(n_name, n_regionkey) AS b, n_name || nullif(n_name, 'FRANCE') AS c FROM nation")
_sql("query_string_functions", "SELECT p_partkey, substr(p_name, -3) AS tail, instr(p_name, 'a') AS place, trim(BOTH 'x' FROM p_name) AS t, hex(p_brand) AS h, format_string('%05d', p_size) AS f, ascii(p_type) AS a, char(65 + p_size % 26) AS c FROM part", "SELECT p_partkey, substr(p_name, -3) AS tail, instr(p_name, 'a') AS place, trim(p_name, 'x') AS t, hex(p_brand) AS h, printf('%05d', p_size) AS f, ascii(p_type) AS a, chr(65 + p_size % 26) AS c FROM part")
_sql("query_patterns", "SELECT p_partkey, p_name ILIKE '%A%' AS i, p_type RLIKE '^[A-Z]+ ' AS r FROM part", "SELECT p_partkey, p_name ILIKE '%A%' AS i, regexp_matches(p_type, '^[A-Z]+ ') AS r FROM part")
_sql("query_scalar_max", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN greatest(o_custkey, o_orderkey % 1000) END AS hi, least(o_custkey, o_orderkey % 1000) AS lo FROM orders")
_sql("query_math", "SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS a, round(l_extendedprice, 1) AS r, floor(l_quantity / 3) AS f, ceil(l_quantity / 3) AS c, round(sqrt(l_extendedprice), 6) AS q, round(power(l_discount, 2), 8) AS p, round(ln(l_quantity), 8) AS n, sign(l_tax - 0.04) AS s FROM lineitem", "SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS a, round(l_extendedprice, 1) AS r, floor(l_quantity / 3)::BIGINT AS f, ceil(l_quantity / 3)::BIGINT AS c, round(sqrt(l_extendedprice), 6) AS q, round(power(l_discount, 2), 8) AS p, round(ln(l_quantity), 8) AS n, sign(l_tax - 0.04)::DOUBLE AS s FROM lineitem")
_sql("query_casts", "SELECT p_partkey, try_cast(substr(p_brand, -2) AS int) AS n, try_cast(p_name AS int) AS none, cast(p_size AS string) AS s, cast(p_retailprice AS bigint) AS b, cast('7' AS int) + p_size AS sum FROM part", "SELECT p_partkey, try_cast(substr(p_brand, -2) AS int) AS n, try_cast(p_name AS int) AS none, cast(p_size AS varchar) AS s, trunc(p_retailprice)::BIGINT AS b, cast('7' AS int) + p_size AS sum FROM part")
_sql("query_months", "SELECT o_orderkey, cast(add_months(o_orderdate, 1) AS string) AS next, datediff(DATE '2000-01-01', cast(o_orderdate AS date)) AS days, cast(trunc(o_orderdate, 'MM') AS string) AS first, extract(YEAR FROM o_orderdate) AS y FROM orders", "SELECT o_orderkey, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE::VARCHAR AS next, date_diff('day', o_orderdate::DATE, DATE '2000-01-01') AS days, date_trunc('month', o_orderdate)::DATE::VARCHAR AS first, extract(YEAR FROM o_orderdate) AS y FROM orders")
_sql("query_row_values", "SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_orderpriority) = ('F', '1-URGENT') OR struct(o_custkey, 'x') = struct(cast(7 AS bigint), 'x')", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') OR o_custkey = 7")
_sql("query_arrays", "SELECT o_custkey, size(collect_set(o_orderstatus)) AS kinds, array_join(array_sort(collect_set(o_orderstatus)), '') AS told, array_contains(collect_list(o_orderpriority), '1-URGENT') AS urgent FROM orders GROUP BY o_custkey", "SELECT o_custkey, len(list(DISTINCT o_orderstatus)) AS kinds, array_to_string(list_sort(list(DISTINCT o_orderstatus)), '') AS told, list_contains(list(o_orderpriority), '1-URGENT') AS urgent FROM orders GROUP BY o_custkey")
_sql("query_cross_join", "SELECT r_name, n FROM region CROSS JOIN (VALUES (1), (2)) t(n)")


@query("SELECT doc_id, upper(substr(text, 1, 40)) AS u, lower(substr(text, 1, 40)) AS l FROM documents WHERE lang IN ('fr', 'es') AND text IS NOT NULL")
def query_case_folding(spark, sf_dir):
    """The first letters of texts in both cases, letter by letter like the SQL: Spark's own upper and lower may make several letters of one."""
    d = warehouse(spark, sf_dir).frame("SELECT doc_id, substr(text, 1, 40) AS t FROM documents WHERE lang IN ('fr', 'es') AND text IS NOT NULL")
    return d.select("doc_id", upper_letters("t").alias("u"), lower_letters("t").alias("l"))


# --- dataflow


@query("SELECT o_orderstatus AS o_orderstatus, o_orderkey FROM orders")
def project_bindings(spark, sf_dir):
    return project(rows_of(table(spark, sf_dir, "orders"), "o_orderkey"), ("o_orderstatus", "o_orderkey")).rows.select("o_orderstatus", "o_orderkey")


def _filter(op: str, field: str, value, where: str) -> None:
    def run(spark, sf_dir):
        o = table(spark, sf_dir, "orders").withColumn("status", F.expr("nullif(o_orderstatus, 'F')"))
        r = rows_of(o, "o_orderkey", "o_orderkey", "o_custkey", "status", "o_totalprice", "o_orderpriority")
        return filter_rows(r, field, op, value).rows.select("o_orderkey", "status", "o_totalprice")

    QUERIES[f"filter_{op}"] = run
    ORACLE_SQL[f"filter_{op}"] = f"SELECT o_orderkey, status, o_totalprice FROM (SELECT *, nullif(o_orderstatus, 'F') AS status FROM orders) WHERE {where}"


_filter("eq", "status", None, "status IS NULL")
_filter("ne", "status", "O", "status IS DISTINCT FROM 'O'")
_filter("lt", "o_totalprice", 50000, "o_totalprice < 50000")
_filter("le", "o_custkey", 100, "o_custkey <= 100")
_filter("gt", "o_totalprice", 250000, "o_totalprice > 250000")
_filter("ge", "o_orderpriority", "3", "o_orderpriority >= '3'")
_filter("in", "status", ["P", None], "status = 'P' OR status IS NULL")
_filter("contains", "o_orderpriority", "URGENT", "contains(o_orderpriority, 'URGENT')")


@query("SELECT l_orderkey, l_partkey, o_custkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_bindings(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.lit(0).cast("long").alias(ORDER), F.array().cast("array<string>").alias(IDS))
    o = rows_of(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderkey", "o_custkey", "o_orderstatus")
    j = join_rows(Relation(("l_orderkey", "l_partkey"), l), o, ["l_orderkey"], ["o_orderkey"], "l", "o", ordered=False)
    return j.rows.select(*[col(n).alias(n.split(".")[1]) for n in ("l.l_orderkey", "l.l_partkey", "o.o_custkey", "o.o_orderstatus")])


@query("SELECT e.event_id, n, first_id FROM events e JOIN (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY user_id, event_type) t ON e.user_id = t.user_id AND e.event_type = t.event_type")
def join_multi_key(spark, sf_dir):
    """Every event with the number and the first of its user's events of its type."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    t = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
    j = join_rows(rows_of(e, "event_id"), rows_of(t, "first_id"), ["user_id", "event_type"], ["user_id", "event_type"], "e", "t", ordered=False)
    return j.rows.select(*[col(n).alias(n.split(".")[1]) for n in ("e.event_id", "t.n", "t.first_id")])


@query(
    "SELECT l.l_orderkey, l_linenumber, l.l_suppkey, lines, quantity FROM lineitem l"
    " JOIN (SELECT l_orderkey, l_suppkey, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_orderkey, l_suppkey) t ON l.l_orderkey = t.l_orderkey AND l.l_suppkey = t.l_suppkey"
)
def join_multi_key_whole(spark, sf_dir):
    """Every line with what its supplier delivers of its order: both tables whole, one row for each line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    sums = lines.groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    a = rows_of(lines, "l_orderkey", "l_orderkey", "l_linenumber", "l_suppkey")
    j = join_rows(a, rows_of(sums, "l_orderkey"), ["l_orderkey", "l_suppkey"], ["l_orderkey", "l_suppkey"], "l", "t", ordered=False)
    return j.rows.select(*[col(n).alias(n.split(".")[1]) for n in ("l.l_orderkey", "l.l_linenumber", "l.l_suppkey", "t.lines", "t.quantity")])


@query("SELECT c.c_custkey AS c, s.s_suppkey AS s FROM (SELECT *, nullif(c_nationkey, 3) AS k FROM customer) c JOIN (SELECT *, nullif(s_nationkey, 3) AS k FROM supplier) s ON c.k = s.k")
def join_null_keys(spark, sf_dir):
    """Each customer with each supplier of the same nation, none of nation 3: few keys, so pairs grow with the square of the tables."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.expr("nullif(c_nationkey, 3)").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.expr("nullif(s_nationkey, 3)").alias("k"))
    return join_pairs(c, s, "k", "c", "s")


@query("SELECT row_number() OVER (ORDER BY a.n_nationkey, b.r_regionkey) - 1 AS place, n_name, r_name FROM nation a JOIN region b ON n_regionkey = r_regionkey")
def join_ordered(spark, sf_dir):
    n, r = rows_of(table(spark, sf_dir, "nation"), "n_nationkey"), rows_of(table(spark, sf_dir, "region"), "r_regionkey")
    rows = with_order(join_rows(n, r, ["n_regionkey"], ["r_regionkey"]).rows, F.col(ORDER), name="place")
    return rows.select("place", col("left.n_name").alias("n_name"), col("right.r_name").alias("r_name"))


@query("SELECT d.doc_id, lang, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def doc_label_join(spark, sf_dir):
    d = rows_of(table(spark, sf_dir, "documents"), "doc_id", "doc_id", "lang")
    lab = rows_of(table(spark, sf_dir, "labels"), "doc_id")
    return join_rows(d, lab, ["doc_id"], ["doc_id"], "d", "l", ordered=False).rows.select(col("d.doc_id").alias("doc_id"), col("d.lang").alias("lang"), col("l.quality").alias("quality"), col("l.toxic").alias("toxic"))


def by_price() -> tuple[Column, ...]:
    """A coarse order, and the order: dearest orders first."""
    return -F.floor(F.col("o_totalprice") / 100), F.desc("o_totalprice"), F.col("o_orderkey")


def by_cheapness() -> tuple[Column, ...]:
    return F.floor(F.col("o_totalprice") / 100), F.col("o_totalprice"), F.col("o_orderkey")


def by_date() -> tuple[Column, ...]:
    return F.datediff(F.lit("2100-01-01"), "o_orderdate"), F.desc("o_orderdate"), F.col("o_orderkey")


def by_key() -> tuple[Column, ...]:
    return F.shiftright(F.col("o_orderkey").cast("long"), 16), F.col("o_orderkey")


def _ranked(spark, sf_dir, bucket: Column, *order: Column) -> DataFrame:
    """All orders as evidence, ranked."""
    o = ranked(table(spark, sf_dir, "orders"), bucket, *order).withColumn(ORDER, F.col("_rank") - 1)
    return evidence_frame(o, "op", "table", "warehouse", "v1", F.col("o_orderkey").cast("string"), F.col("o_orderstatus"))


def _rrf(orders: list[str]) -> str:
    parts = " UNION ALL ".join(f"SELECT {i} AS b, o_orderkey AS k, row_number() OVER (ORDER BY {o}) AS rk FROM orders" for i, o in enumerate(orders))
    return f"SELECT k::VARCHAR AS locator, round(sum(1.0::DOUBLE / (60 + rk)), 12) AS score FROM ({parts}) GROUP BY k ORDER BY sum(1.0::DOUBLE / (60 + rk)) DESC, min(struct_pack(b := b, rk := rk)) LIMIT 20"


@query(_rrf(["o_totalprice DESC, o_orderkey", "o_orderdate DESC, o_orderkey"]))
def fuse_rrf_two(spark, sf_dir):
    return fuse([_ranked(spark, sf_dir, *by_price()), _ranked(spark, sf_dir, *by_date())]).select("locator", "score")


@query(_rrf(["o_totalprice DESC, o_orderkey", "o_orderdate DESC, o_orderkey", "o_orderkey"]))
def fuse_rrf_three(spark, sf_dir):
    return fuse([_ranked(spark, sf_dir, *by_price()), _ranked(spark, sf_dir, *by_date()), _ranked(spark, sf_dir, *by_key())]).select("locator", "score")


@query("SELECT o_orderkey::VARCHAR AS locator FROM orders")
def compose_union(spark, sf_dir):
    return compose_evidence([_ranked(spark, sf_dir, *by_price()), _ranked(spark, sf_dir, *by_cheapness()), _ranked(spark, sf_dir, *by_key())]).select("locator")


for _name in ("fuse_rrf_two", "fuse_rrf_three", "compose_union"):  # the names of a time when the first ones had row limits
    QUERIES[f"{_name}_whole"], ORACLE_SQL[f"{_name}_whole"] = QUERIES[_name], ORACLE_SQL[_name]


# --- graph


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers live in nations, nations lie in regions."""
    part = lambda t, e, s, p, k, r, w: table(spark, sf_dir, t).select(F.concat(F.lit(e), s).alias("edge_id"), F.concat(F.lit(p), s).alias("source_id"), F.concat(F.lit(r), k).alias("target_id"), F.lit({"n": "lives_in", "r": "lies_in"}[r]).alias("relation"), w.alias("weight"))
    c = part("customer", "ec", "c_custkey", "c", "c_nationkey", "n", F.lit(1.0))
    s = part("supplier", "es", "s_suppkey", "s", "s_nationkey", "n", F.lit(2.0))
    n = part("nation", "en", "n_nationkey", "n", "n_regionkey", "r", F.lit(0.5))
    return c.unionByName(s).unionByName(n)


EDGES = (
    "e AS (SELECT 'ec' || c_custkey AS e, 'c' || c_custkey AS s, 'n' || c_nationkey AS t, 'lives_in' AS r, 1.0::DOUBLE AS w FROM customer"
    " UNION ALL SELECT 'es' || s_suppkey, 's' || s_suppkey, 'n' || s_nationkey, 'lives_in', 2.0 FROM supplier"
    " UNION ALL SELECT 'en' || n_nationkey, 'n' || n_nationkey, 'r' || n_regionkey, 'lies_in', 0.5 FROM nation)"
)


def _walk(starts: str, hops: int, step: str = "SELECT s, t, r, e, w FROM e", least: int = 1, tail: str = "") -> str:
    return (
        f"WITH RECURSIVE {EDGES}, k AS ({step}), p AS (SELECT s AS st, t AS node, [s, t] AS path, [e] AS ep, [struct_pack(r := r, e := e, t := t)] AS bfs, 1 AS hops, w AS sw FROM k WHERE s IN ({starts}) AND s <> t"
        f" UNION ALL SELECT p.st, k.t, list_append(p.path, k.t), list_append(p.ep, k.e), list_append(p.bfs, struct_pack(r := k.r, e := k.e, t := k.t)), hops + 1, sw + k.w FROM p JOIN k ON k.s = p.node WHERE hops < {hops} AND NOT list_contains(p.path, k.t))"
        f" SELECT st AS start_id, node AS end_id, hops, array_to_string(path, '>') AS node_path, array_to_string(ep, '>') AS edge_path, round(sw / hops, 8) AS score FROM p WHERE hops >= {least} {tail}"
    )


def _told(df: DataFrame) -> DataFrame:
    return df.select("start_id", "end_id", "hops", F.array_join("node_path", ">").alias("node_path"), F.array_join("edge_path", ">").alias("edge_path"), F.round("score", 8).alias("score"))


def _starts(spark, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "start_id string")


BOTH = "SELECT s, t, r, e, w FROM e UNION ALL SELECT t, s, r, e, w FROM e WHERE s <> t"


@query(_walk("'c1', 'c2', 's3'", 3))
def traverse_out(spark, sf_dir):
    return _told(paths(_starts(spark, "c1", "c2", "s3"), edges(spark, sf_dir), "out", (), 1, 3, None))


@query(_walk("'r1'", 2, "SELECT t AS s, s AS t, r, e, w FROM e"))
def traverse_in(spark, sf_dir):
    return _told(paths(_starts(spark, "r1"), edges(spark, sf_dir), "in", (), 1, 2, None))


@query(_walk("'n5', 'c7'", 2, BOTH))
def traverse_both(spark, sf_dir):
    return _told(paths(_starts(spark, "n5", "c7"), edges(spark, sf_dir), "both", (), 1, 2, None))


@query(_walk("'n5', 'c7'", 3, "SELECT * FROM (" + BOTH + ") WHERE r = 'lives_in'", 2))
def traverse_min_hops(spark, sf_dir):
    return _told(paths(_starts(spark, "n5", "c7"), edges(spark, sf_dir), "both", ("lives_in",), 2, 3, None))


@query(_walk("'r1', 'r2'", 2, "SELECT t AS s, s AS t, r, e, w FROM e", 1, "ORDER BY hops, st, bfs LIMIT 30"))
def traverse_limit(spark, sf_dir):
    found = paths(_starts(spark, "r2", "r1"), edges(spark, sf_dir), "in", (), 1, 2, 30)
    return _told(found.orderBy("hops", "start_id", "_bfs").limit(30))


@query(_walk("SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 9900", 2))
def traverse_from_query(spark, sf_dir):
    starts = warehouse(spark, sf_dir).frame("SELECT concat('c', c_custkey) AS start_id FROM customer WHERE c_acctbal > 9900")
    return _told(paths(starts, edges(spark, sf_dir), "out", (), 1, 2, None))


# --- memory


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as memories: each is known until the same user's next one of its type."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    none = F.lit(None).cast("timestamp")
    return e.withColumns({"_to": F.lead("ts").over(w), "_prev": F.lag("event_id").over(w)}).select(
        F.concat(F.lit("m"), "event_id").alias("memory_id"), F.when(F.col("event_id") % 3 == 0, "fact").otherwise("experience").alias("kind"), F.struct(F.lit("principal").alias("kind"), F.col("user_id").cast("string").alias("scope_id")).alias("scope"),
        F.concat_ws(" ", "event_type", F.lit("of user"), "user_id", F.lit("with"), "props").alias("content"), F.col("ts").alias("recorded_from"), F.col("_to").alias("recorded_to"), (F.col("ts") - F.expr("interval 1 day")).alias("valid_from"), none.alias("valid_to"),
        F.struct(F.lit("imported").alias("channel"), F.lit(None).cast("string").alias("trace_id")).alias("origin"), F.lit(None).cast("string").alias("mutation_id"), F.array().cast("array<string>").alias("evidence"),
        F.when(F.col("_prev").isNotNull() & (F.col("event_id") % 2 == 0), F.array(F.struct(F.lit("contradicts").alias("kind"), F.concat(F.lit("m"), "_prev").alias("target_id")))).otherwise(F.array()).cast("array<struct<kind:string,target_id:string>>").alias("links"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )


MEMORIES = (
    "m AS (SELECT 'm' || event_id AS memory_id, CASE WHEN event_id % 3 = 0 THEN 'fact' ELSE 'experience' END AS kind, user_id::VARCHAR AS scope_id, event_type || ' of user ' || user_id || ' with ' || props AS content,"
    " ts AS rf, lead(ts) OVER w AS rt, ts - INTERVAL 1 DAY AS vf, CASE WHEN event_id % 2 = 0 THEN 'm' || lag(event_id) OVER w END AS contra FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))"
)
AT = datetime(2024, 1, 10, tzinfo=UTC)
EARLY = datetime(2024, 1, 5, tzinfo=UTC)


@query(f"WITH {MEMORIES} SELECT memory_id, kind, scope_id FROM m WHERE rf <= TIMESTAMP '2024-01-10' AND (rt IS NULL OR TIMESTAMP '2024-01-10' < rt) AND vf <= TIMESTAMP '2024-01-10'")
def recall_asof(spark, sf_dir):
    return visible(memories(spark, sf_dir), AT, AT).select("memory_id", "kind", F.col("scope.scope_id").alias("scope_id"))


@query(f"WITH {MEMORIES} SELECT memory_id FROM m WHERE rf <= TIMESTAMP '2024-01-10' AND (rt IS NULL OR TIMESTAMP '2024-01-10' < rt) AND vf <= TIMESTAMP '2024-01-05'")
def recall_valid_time(spark, sf_dir):
    return visible(memories(spark, sf_dir), AT, EARLY).select("memory_id")


_CLICK = score_sql("content", "click of user zzz")


@query(
    f"WITH {MEMORIES} SELECT memory_id, score FROM (SELECT memory_id, {_CLICK} AS score FROM m WHERE rf <= TIMESTAMP '2024-01-10' AND (rt IS NULL OR TIMESTAMP '2024-01-10' < rt) AND vf <= TIMESTAMP '2024-01-10' AND scope_id IN ('1', '2', '3', '4') AND kind = 'experience') WHERE score > 0 ORDER BY score DESC, memory_id LIMIT 10"
)
def recall_scoped(spark, sf_dir):
    scopes = [ScopeRef("principal", str(i)) for i in (1, 2, 3, 4)]
    return recall_frame(memories(spark, sf_dir), "click of user zzz", scopes, ("experience",), AT, AT, 10).select("memory_id", "score")


@query(f"WITH {MEMORIES} SELECT DISTINCT least(a.memory_id, b.memory_id) AS id_a, greatest(a.memory_id, b.memory_id) AS id_b FROM m a JOIN m b ON a.contra = b.memory_id")
def recall_conflicts(spark, sf_dir):
    return conflict_pairs(memories(spark, sf_dir))


LATE = datetime(2030, 1, 1, tzinfo=UTC)


def _new_memory(spark, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    m = spark.createDataFrame(rows, "memory_id string, kind string, user string, content string")
    none = F.lit(None).cast("timestamp")
    return m.select(
        "memory_id", "kind", F.struct(F.lit("principal").alias("kind"), F.col("user").alias("scope_id")).alias("scope"), "content", F.lit(LATE).alias("recorded_from"), none.alias("recorded_to"), none.alias("valid_from"), none.alias("valid_to"),
        F.struct(F.lit("system").alias("channel"), F.lit("t").alias("trace_id")).alias("origin"), F.lit("p").alias("mutation_id"), F.array().cast("array<string>").alias("evidence"), F.array().cast("array<struct<kind:string,target_id:string>>").alias("links"), F.create_map().cast("map<string,string>").alias("metadata"),
    )


def _open(df: DataFrame) -> DataFrame:
    return df.select("memory_id", F.col("scope.scope_id").alias("scope_id"), "content", F.col("recorded_to").isNull().alias("is_open"))


@query(f"WITH {MEMORIES} SELECT memory_id, scope_id, content, rt IS NULL AND memory_id NOT IN ('m1', 'm2') AS is_open FROM m UNION ALL SELECT 'new1', '1', 'changed', true")
def memory_supersede(spark, sf_dir):
    old = memories(spark, sf_dir)
    return _open(close_and_append(old, old.where("memory_id IN ('m1', 'm2')").select("memory_id"), _new_memory(spark, [("new1", "fact", "1", "changed")]), LATE))


@query(f"WITH {MEMORIES} SELECT memory_id, scope_id, content, rt IS NULL AND memory_id <> 'm7' AS is_open FROM m")
def memory_retract(spark, sf_dir):
    old = memories(spark, sf_dir)
    return _open(close_and_append(old, old.where("memory_id = 'm7'").select("memory_id"), _new_memory(spark, []), LATE))


@query(f"WITH {MEMORIES} SELECT memory_id, scope_id, content, rt IS NULL AS is_open FROM m UNION ALL SELECT 'new2', '9', 'added', true")
def memory_assert(spark, sf_dir):
    old = memories(spark, sf_dir)
    return _open(close_and_append(old, old.where("false").select("memory_id"), _new_memory(spark, [("new2", "fact", "9", "added")]), LATE))


# --- skills, catalog, change sets, evidence


def skills(spark: SparkSession) -> SkillSource:
    label = SkillSpec("risk-label", "1.0.0", "Label a risk level in upper case", input_schema={"required": ["risk"], "properties": {"risk": {"type": "string"}}}, output_schema={"properties": {"label": {"type": "string"}}})
    review = SkillSpec("review-policy", "1.0.0", "Review a policy for open risk", "Read it twice.", "instruction")
    return SkillSource(spark, "skills", [(label, lambda a, c: {"label": a["risk"].upper()}), (review, None)], {"risk-label": lambda risk: F.upper(risk)})


@query("SELECT * FROM (VALUES ('risk-label', '1.0.0', 3.0::DOUBLE), ('review-policy', '1.0.0', 0.5::DOUBLE)) t(name, version, score)")
def resolve_skill(spark, sf_dir):
    return resolve_frame(skills(spark).registry().withColumn("description", F.when(F.col("name") == "risk-label", "a risk-label for it").otherwise("a risk-label")).where("name = 'risk-label'"), "risk-label", 5).select("name", "version", "score").unionByName(
        resolve_frame(skills(spark).registry(), "review zzz", 5).where("name = 'review-policy'").select("name", "version", "score")
    )


@query("SELECT event_id, upper(event_type) AS output FROM events")
def invoke_skill(spark, sf_dir):
    s = skills(spark)
    return s.apply(table(spark, sf_dir, "events").select("event_id", "event_type"), s.skills["risk-label", "1.0.0"][0].ref, risk=F.col("event_type")).select("event_id", "output")


@query("SELECT * FROM (VALUES ('graph', 'graph'), ('kb', 'document'), ('skills', 'skill'), ('warehouse', 'table')) t(source_id, kind)")
def discover_sources(spark, sf_dir):
    return Catalog(warehouse(spark, sf_dir), skills(spark), _Named("kb", "document"), _Named("graph", "graph")).frame(spark).select("source_id", "kind")


class _Named:
    """A catalog entry without data, for listing."""

    def __init__(self, source_id: str, kind: str):
        from .model import SnapshotRef, SourceDescriptor, SourceKind, SourceRef

        ref = SourceRef(source_id, SourceKind(kind))
        self.descriptor = SourceDescriptor(ref, frozenset())
        self.latest = lambda: SnapshotRef(ref, "v1")


@query("SELECT 'warehouse' AS source_id, * FROM (VALUES ('r_name'), ('r_regionkey')) t(field)")
def describe_source(spark, sf_dir):
    d = warehouse(spark, sf_dir).descriptor
    return spark.createDataFrame([(d.ref.source_id, f["name"]) for f in d.schema["region"]["fields"]], "source_id string, field string")


CHANGED = (
    "SELECT doc_id::VARCHAR AS document_id, CASE WHEN doc_id % 10 = 2 THEN 'new ' || lang ELSE text END AS content, lang FROM documents WHERE doc_id % 10 <> 1"
    " UNION ALL SELECT 'added-' || n_nationkey, n_name, 'en' FROM nation"
)


@query(CHANGED)
def sync_add_update_delete(spark, sf_dir):
    base = documents(spark, sf_dir)
    ident = F.col("document_id").cast("long")
    gone = base.where(ident % 10 == 1).select(F.lit("delete").alias("kind"), "document_id", F.lit(None).cast("string").alias("content"), "metadata")
    new = base.where(ident % 10 == 2).select(F.lit("update").alias("kind"), "document_id", F.concat(F.lit("new "), F.col("metadata")["lang"]).alias("content"), "metadata")
    more = table(spark, sf_dir, "nation").select(F.lit("add").alias("kind"), F.concat(F.lit("added-"), "n_nationkey").alias("document_id"), F.col("n_name").alias("content"), F.create_map(F.lit("lang"), F.lit("en")).alias("metadata"))
    return apply_changes(base, gone.unionByName(new).unionByName(more)).select("document_id", "content", F.col("metadata")["lang"].alias("lang"))


@query("SELECT doc_id::VARCHAR AS document_id, n_chars FROM documents")
def snapshot_pinned_read(spark, sf_dir):
    """After a change set the version before it reads as it was."""
    base = documents(spark, sf_dir)
    source = DocumentSource("kb", base, "v1")
    one = spark.createDataFrame([("add", "zzz", "new text", {})], "kind string, document_id string, content string, metadata map<string,string>")
    source.sync(one)
    return source.versions["v1"][0].select("document_id", F.length("content").cast("long").alias("n_chars"))


@query("SELECT event_id, sha256('op' || chr(31) || 'table://warehouse/' || replace(event_type, ' ', '%20') || '/' || event_id || chr(31) || 'v1') AS evidence_id, 'table://warehouse/' || replace(event_type, ' ', '%20') || '/' || event_id AS locator FROM events")
def evidence_locator_hash(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn(ORDER, F.col("event_id").cast("long"))
    locator = F.concat(F.lit("table://warehouse/"), quoted("event_type"), F.lit("/"), F.col("event_id").cast("string"))
    return evidence_frame(e, "op", "table", "warehouse", "v1", locator, F.col("props")).select(F.col(ORDER).alias("event_id"), "evidence_id", "locator")


# --- whole plans


@query(
    f"WITH hits AS ({_search_sql('the and of', 'documents', 'doc_id::VARCHAR', 'text', 'true', 50)}), agg AS (SELECT doc_id::VARCHAR AS id, quality, toxic FROM labels)"
    " SELECT document_id, score, quality, toxic FROM hits JOIN agg ON document_id = id WHERE quality = 1"
)
def plan_search_query_join(spark, sf_dir):
    """Documents that match a text, joined with a filtered table, as one plan."""
    kb, wh = DocumentSource("kb", documents(spark, sf_dir), "v1"), TableSource(spark, "warehouse", {"labels": f"{sf_dir}/labels.parquet"}, row_limit=None)
    plan = Plan(
        (
            Search(op_id="s", source=kb.ref, query="the and of", limit=50),
            Query(op_id="q", source=wh.ref, statement="SELECT cast(doc_id AS string) AS id, quality, toxic FROM labels"),
            Project(op_id="ps", inputs=(Ref("s"),), fields=("document_id", "score")),
            Project(op_id="pq", inputs=(Ref("q"),), fields=("id", "quality", "toxic")),
            Filter(op_id="f", inputs=(Ref("pq"),), field="quality", operator="eq", value=1),
            Join(op_id="j", inputs=(Ref("ps"), Ref("f")), left_on=("document_id",), right_on=("id",), left_alias="d", right_alias="l"),
        ),
        Ref("j"),
        budget=Budget(max_actions=10),
    )
    out = Engine(spark, Catalog(kb, wh)).execute(plan).relation.rows
    return out.select(*[col(n).alias(n.split(".")[1]) for n in ("d.document_id", "d.score", "l.quality", "l.toxic")])


@query(_walk("'n3'", 1, "SELECT t AS s, s AS t, r, e, w FROM e"))
def plan_bound_traversal(spark, sf_dir):
    """A query's one row gives a traversal its start."""
    e = edges(spark, sf_dir)
    ids = e.select(F.col("source_id").alias("node_id")).union(e.select("target_id")).distinct()
    g, wh = GraphSource("graph", ids, e), warehouse(spark, sf_dir)
    plan = Plan(
        (
            Query(op_id="q", source=wh.ref, statement="SELECT concat('n', n_nationkey) AS id FROM nation WHERE n_nationkey = :k", parameters={"k": 3}),
            Traverse(op_id="t", source=g.ref, start_binding=Binding(Ref("q"), "id"), direction="in", max_hops=1, limit=None),
        ),
        Ref("t"),
    )
    return _told(Engine(spark, Catalog(g, wh)).execute(plan).relation.rows)


@query(
    f"WITH a AS ({_search_sql('the and', 'documents', 'doc_id::VARCHAR', 'text', 'true', 20)}), b AS ({_search_sql('of the', 'documents', 'doc_id::VARCHAR', 'text', 'true', 20)}),"
    " u AS (SELECT 0 AS b, document_id AS k, row_number() OVER (ORDER BY score DESC, document_id) AS rk FROM a UNION ALL SELECT 1, document_id, row_number() OVER (ORDER BY score DESC, document_id) FROM b)"
    " SELECT 'document://kb/' || k AS locator, round(sum(1.0::DOUBLE / (60 + rk)), 12) AS score FROM u GROUP BY k ORDER BY sum(1.0::DOUBLE / (60 + rk)) DESC, min(b * 1000 + rk) LIMIT 10"
)
def plan_fused_searches(spark, sf_dir):
    kb = DocumentSource("kb", documents(spark, sf_dir), "v1")
    plan = Plan((Search(op_id="a", source=kb.ref, query="the and", limit=20), Search(op_id="b", source=kb.ref, query="of the", limit=20), Fuse(op_id="f", inputs=(Ref("a"), Ref("b")), limit=10)), Ref("f"))
    return Engine(spark, Catalog(kb)).execute(plan).evidence.select("locator", "score")


