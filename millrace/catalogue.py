"""The driver's queries: every operator of the engine over the test tables, with SQL beside it."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, own_session
from .http_api import Service
from .operators import checksum, stats
from .plans import request
from .plans.problems import Invalid
from .sources import colfile, logs
from .sources.csv_copy import CopyFailed

# Short forms for the request grammar.


def col(name: str, table: str | None = None) -> dict:
    return {"columnName": name} | ({"tableName": table} if table else {})


def lit(value: object) -> dict:
    return {"value": value}


def fn(name: str, *args: dict) -> dict:
    return {"functionName": name, "arguments": list(args)}


def op(name: str, left: dict, right: dict | None = None) -> dict:
    if right is None:
        return {"operator": name, "operand": left}
    return {"operator": name, "leftOperand": left, "rightOperand": right}


def _select(table: str | None, columns: list[tuple[str, dict]], where=None, order=None, limit=None) -> Callable:
    """A query: a SELECT over one test table, its columns named for the comparison."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        definition: dict = {"columnClauses": [c for _, c in columns]}
        if table:
            engine.attach(table, f"{sf_dir}/{table}.parquet")
            # The table has to be named somewhere; the first reference does it.
            definition = _named(definition, table)
        if where is not None:
            definition["whereClause"] = where
        if order is not None:
            definition["orderByClause"] = [{"columnIndex": i, "ascending": up} for i, up in order]
        if limit is not None:
            definition["limitClause"] = {"limit": limit}
        return engine.select(definition).toDF(*[n for n, _ in columns])

    return run


def _named(definition: dict, table: str) -> dict:
    done = False

    def walk(e):
        nonlocal done
        if isinstance(e, dict):
            if "columnName" in e and not done:
                done = True
                return e | {"tableName": table}
            return {k: walk(v) for k, v in e.items()}
        return [walk(x) for x in e] if isinstance(e, list) else e

    return walk(definition)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, run: Callable, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


ORDERS = [("o_orderkey", col("o_orderkey")), ("o_custkey", col("o_custkey"))]

_add(
    "scan_project",
    _select("customer", [("c_custkey", col("c_custkey")), ("c_name", col("c_name"))]),
    "SELECT c_custkey, c_name FROM customer",
)
_add(
    "scan_all",
    _select("nation", [(n, col(n)) for n in ("n_nationkey", "n_name", "n_regionkey")]),
    "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation",
)
_add(
    "literal_row",
    _select(None, [("a", lit(7)), ("b", lit("x")), ("c", lit(True))]),
    "SELECT CAST(7 AS BIGINT) AS a, 'x' AS b, true AS c",
)
_add(
    "literal_row_filtered_out",
    _select(None, [("a", lit(7))], where=op("LESS_THAN", lit(2), lit(1))),
    "SELECT CAST(7 AS BIGINT) AS a WHERE 2 < 1",
)
_add(
    "literal_per_row",
    _select("nation", [("one", lit(1)), ("n_name", col("n_name"))], where=op("GREATER_THAN", col("n_nationkey"), lit(12))),
    "SELECT CAST(1 AS BIGINT) AS one, n_name FROM nation WHERE n_nationkey > 12",
)
for _name, _sql in (
    ("EQUAL", "="), ("NOT_EQUAL", "<>"), ("LESS_THAN", "<"), ("LESS_EQUAL", "<="), ("GREATER_THAN", ">"), ("GREATER_EQUAL", ">="),
):
    _add(
        f"filter_int_{_name.lower()}",
        _select("orders", ORDERS, where=op(_name, col("o_custkey"), lit(70))),
        f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey {_sql} 70",
    )
    _add(
        f"filter_varchar_{_name.lower()}",
        _select("orders", [ORDERS[0], ("p", col("o_orderpriority"))], where=op(_name, col("o_orderpriority"), lit("3-MEDIUM"))),
        f"SELECT o_orderkey, o_orderpriority AS p FROM orders WHERE o_orderpriority {_sql} '3-MEDIUM'",
    )
_add(
    "filter_and_or_not",
    _select(
        "orders", ORDERS,
        where=op("OR", op("AND", op("LESS_THAN", col("o_orderpriority"), lit("3")), op("GREATER_EQUAL", col("o_orderkey"), lit(100))),
                 op("NOT", op("LESS_EQUAL", col("o_orderstatus"), lit("O")))),
    ),
    "SELECT o_orderkey, o_custkey FROM orders WHERE (o_orderpriority < '3' AND o_orderkey >= 100) OR NOT (o_orderstatus <= 'O')",
)
_K, _C = col("o_orderkey"), col("o_custkey")
_add(
    "arithmetic",
    _select("orders", [
        ("k", _K), ("added", op("ADD", _K, _C)), ("less", op("SUBTRACT", _C, _K)), ("times", op("MULTIPLY", _K, _C)),
        ("parts", op("DIVIDE", op("SUBTRACT", _C, lit(700)), lit(7))), ("minus", op("MINUS", _K)),
    ]),
    """SELECT o_orderkey AS k, o_orderkey + o_custkey AS added, o_custkey - o_orderkey AS less, o_orderkey * o_custkey AS times,
              CAST(trunc((o_custkey - 700) / 7) AS BIGINT) AS parts, -o_orderkey AS minus FROM orders""",
)
_add(
    "integer_wraps",
    _select("nation", [
        ("up", op("ADD", lit(2**63 - 1), col("n_nationkey"))), ("twice", op("MULTIPLY", lit(2**62), op("ADD", col("n_nationkey"), lit(2)))),
        ("low", op("MINUS", lit(-(2**63)))),
    ]),
    """SELECT CAST(CASE WHEN n_nationkey = 0 THEN 9223372036854775807::HUGEINT
                   ELSE 9223372036854775807::HUGEINT + n_nationkey - 18446744073709551616::HUGEINT END AS BIGINT) AS up,
              CAST(CASE (n_nationkey + 2) % 4 WHEN 0 THEN 0::HUGEINT WHEN 1 THEN 4611686018427387904::HUGEINT
                   WHEN 2 THEN -9223372036854775808::HUGEINT ELSE -4611686018427387904::HUGEINT END AS BIGINT) AS twice,
              (-9223372036854775808)::BIGINT AS low FROM nation""",
)
_add(
    "strlen",
    _select("documents", [("doc_id", col("doc_id")), ("n", fn("STRLEN", col("text")))]),
    "SELECT doc_id, strlen(text) AS n FROM documents",
)
_add(
    "concat",
    _select("customer", [("c_custkey", col("c_custkey")), ("x", fn("CONCAT", col("c_name"), lit("-"), col("c_mktsegment"), lit("")))]),
    "SELECT c_custkey, concat(c_name, '-', c_mktsegment, '') AS x FROM customer",
)
_add(
    "replace",
    _select("documents", [
        ("doc_id", col("doc_id")), ("x", fn("REPLACE", col("text"), lit("th"), lit("TH"))),
        ("same", fn("REPLACE", col("lang"), lit(""), lit("-"))), ("own", fn("REPLACE", col("source"), col("lang"), lit("?"))),
    ]),
    "SELECT doc_id, replace(text, 'th', 'TH') AS x, lang AS same, replace(source, lang, '?') AS own FROM documents",
)
_add(
    "upper",
    _select("documents", [("doc_id", col("doc_id")), ("x", fn("UPPER", col("text")))]),
    "SELECT doc_id, replace(upper(text), 'ẞ', 'ß') AS x FROM documents",
)
_add(
    "lower",
    _select("documents", [("doc_id", col("doc_id")), ("x", fn("LOWER", col("text")))]),
    "SELECT doc_id, lower(text) AS x FROM documents",
)
_add(
    "nested_functions",
    _select(
        "part", [("p_partkey", col("p_partkey")), ("x", fn("CONCAT", fn("UPPER", col("p_name")), lit("_"), fn("LOWER", col("p_brand"))))],
        where=op("GREATER_THAN", op("ADD", fn("STRLEN", fn("CONCAT", col("p_type"), lit("!!!"))), col("p_size")), lit(40)),
    ),
    """SELECT p_partkey, concat(upper(p_name), '_', lower(p_brand)) AS x FROM part
       WHERE strlen(concat(p_type, '!!!')) + p_size > 40""",
)
_add(
    "bool_output",
    _select("orders", [ORDERS[0], ("b", op("LESS_THAN", _C, lit(100)))]),
    "SELECT o_orderkey, o_custkey < 100 AS b FROM orders",
)
_add(
    "order_by_bool",
    _select("orders", [("b", op("LESS_THAN", _C, lit(100))), ("k", _K)], order=[(0, False), (1, True)], limit=200),
    "SELECT o_custkey < 100 AS b, o_orderkey AS k FROM orders ORDER BY b DESC, k LIMIT 200",
)
_add(
    "sort_varchar",
    _select("customer", [("s", col("c_mktsegment")), ("c_custkey", col("c_custkey"))], order=[(0, True), (1, False)]),
    "SELECT c_mktsegment AS s, c_custkey FROM customer ORDER BY s, c_custkey DESC",
)
_add(
    "topk",
    _select("orders", [("c", _C), ("k", _K)], order=[(0, False), (1, True)], limit=25),
    "SELECT o_custkey AS c, o_orderkey AS k FROM orders ORDER BY c DESC, k LIMIT 25",
)
_add(
    "topk_filtered",
    _select("lineitem", [("k", col("l_orderkey")), ("n", col("l_linenumber")), ("p", col("l_partkey"))],
            where=op("EQUAL", col("l_returnflag"), lit("R")), order=[(2, False), (0, True), (1, True)], limit=100),
    """SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R'
       ORDER BY p DESC, k, n LIMIT 100""",
)
_add("sort_ties_keep_order", _select("customer", [("s", col("c_nationkey")), ("k", col("c_custkey"))], order=[(0, True)], limit=50),
     "SELECT CAST(c_nationkey AS BIGINT) AS s, c_custkey AS k FROM customer ORDER BY s, k LIMIT 50")
_add(
    "limit_unordered",
    _select("documents", [("doc_id", col("doc_id")), ("lang", col("lang"))], limit=10),
    "SELECT doc_id, lang FROM documents LIMIT 10",
)
_add(
    "limit_zero",
    _select("documents", [("doc_id", col("doc_id"))], limit=0),
    "SELECT doc_id FROM documents LIMIT 0",
)
_add(
    "limit_beyond",
    _select("nation", [("k", col("n_nationkey"))], limit=1000),
    "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation LIMIT 1000",
)


def full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.attach("supplier", f"{sf_dir}/supplier.parquet")
    return engine.scan("supplier")


_add("full_scan", full_scan, "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier")


def full_scan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.attach("supplier", f"{sf_dir}/supplier.parquet")
    return engine.scan("supplier", 7)


_add(
    "full_scan_limit", full_scan_limit,
    "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier LIMIT 7",
)


def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-1 to AGG-4 over the integer and string columns of a table."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "n_chars")
    return stats.column_stats(df)


_add(
    "column_stats", column_stats,
    r"""SELECT count(*) AS rows, avg(doc_id) AS doc_id_mean,
       CAST(sum(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))) AS BIGINT) AS text_ascii_bytes,
       CAST(sum(strlen(text)) AS BIGINT) AS text_bytes,
       CAST(sum(length(regexp_replace(lang, '[^\x00-\x7F]', '', 'g'))) AS BIGINT) AS lang_ascii_bytes,
       CAST(sum(strlen(lang)) AS BIGINT) AS lang_bytes, avg(n_chars) AS n_chars_mean FROM documents""",
)


_HELD: list[tempfile.TemporaryDirectory] = []


def _folder(spark: SparkSession) -> str:
    """A new folder for a query's tables, in the shared folder. Only where driver and executors
    are one process it may be a local one, which goes when the process ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        name = f"{shared.removeprefix('file://')}/millrace-{uuid.uuid4().hex}"
        os.makedirs(name)
        return name
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    _HELD.append(tempfile.TemporaryDirectory(prefix="millrace-"))
    return _HELD[-1].name


def copy_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table is written as CSV, loaded by COPY into a new table, and selected."""
    folder = _folder(spark)
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    source.coalesce(1).write.option("quoteAll", True).option("escape", '"').csv(f"{folder}/csv")
    engine = Engine(spark, f"{folder}/engine")
    engine.catalog.create("copied", [("lang", "VARCHAR"), ("doc_id", "INT64"), ("text", "VARCHAR")])
    engine.copy(request.Copy(f"{folder}/csv", "copied", ("doc_id", "text", "lang")))
    columns = ("doc_id", "text", "lang")
    return engine.select({"columnClauses": [col(c, "copied") for c in columns]}).toDF(*columns)


_add("copy_roundtrip", copy_roundtrip, "SELECT doc_id, text, lang FROM documents")


def copy_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads into one table; a limit takes the first load's rows first."""
    folder = _folder(spark)
    for i, where in enumerate(("n_nationkey < 15", "n_nationkey >= 15")):
        part = spark.read.parquet(f"{sf_dir}/nation.parquet").where(where).select("n_nationkey", "n_name")
        part.coalesce(1).write.option("header", True).csv(f"{folder}/csv{i}")
    engine = Engine(spark, f"{folder}/engine")
    engine.catalog.create("nations", [("k", "INT64"), ("n", "VARCHAR")])
    for i in range(2):
        engine.copy(request.Copy(f"{folder}/csv{i}", "nations", header=True))
    return engine.select({"columnClauses": [col("k", "nations"), col("n")], "limitClause": {"limit": 20}}).toDF("k", "n")


_add("copy_appends", copy_appends, "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS n FROM nation WHERE n_nationkey < 20")


def colfile_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table goes to the columnar file format and comes back, two of its columns only."""
    colfile.register(spark)
    folder = _folder(spark)
    source = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")
    source.write.format(colfile.FORMAT).option("path", f"{folder}/t").mode("append").save()
    return spark.read.format(colfile.FORMAT).option("columns", "c_custkey,c_mktsegment").load(f"{folder}/t")


_add("colfile_roundtrip", colfile_roundtrip, "SELECT c_custkey, c_mktsegment FROM customer")


def generated_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated log table, summed up: rows, range of values, hosts and levels."""
    df = logs.logs(spark, start=0)
    return df.agg(
        F.count("*").alias("n"), F.max("timestamp").alias("last"), (F.min("value") >= 0).alias("low"), (F.max("value") < 10_000).alias("high"),
        F.countDistinct("host").alias("hosts"), F.countDistinct("log_level").alias("levels"),
    )


_add(
    "generated_logs", generated_logs,
    """SELECT CAST(100000 AS BIGINT) AS n, CAST(99999 AS BIGINT) AS "last", true AS low, true AS high,
       CAST(5 AS BIGINT) AS hosts, CAST(4 AS BIGINT) AS levels""",
)


def logs_in_a_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated log table goes to column files, and its statistics come from them."""
    colfile.register(spark)
    folder = _folder(spark)
    logs.logs(spark, start=1000).write.format(colfile.FORMAT).option("path", f"{folder}/logs").mode("append").save()
    found = stats.column_stats(spark.read.format(colfile.FORMAT).load(f"{folder}/logs"))
    sizes = [F.col(f"{c}_bytes") / F.col("rows") for c in ("host", "log_level")]
    return found.select(
        "rows", "timestamp_mean", F.round("value_mean", -2).alias("value_mean"),
        *[F.round(s, 1).alias(f"{c}_size") for s, c in zip(sizes, ("host", "log_level"))],
        *[(F.col(f"{c}_ascii_bytes") == F.col(f"{c}_bytes")).alias(f"{c}_ascii") for c in ("host", "log_level")],
    )


_add(
    "logs_in_a_file", logs_in_a_file,
    """SELECT CAST(100000 AS BIGINT) AS rows, CAST(50999.5 AS DOUBLE) AS timestamp_mean, CAST(5000 AS DOUBLE) AS value_mean,
       CAST(round((11 + 8 + 9 + 9 + 11) / 5.0, 1) AS DOUBLE) AS host_size, CAST(round((4 + 4 + 5 + 5) / 4.0, 1) AS DOUBLE) AS log_level_size,
       true AS host_ascii, true AS log_level_ascii""",
)


def batch_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of several sizes through two column files; none spans both."""
    rows = sorted(map(tuple, spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").collect()))
    folder, out = _folder(spark), []
    paths = [f"{folder}/{i}{colfile.SUFFIX}" for i in range(2)]
    for path, part in zip(paths, (rows[:15], rows[15:])):
        columns = [("k", colfile.INT64_TAG, [k for k, _ in part]), ("n", colfile.VARCHAR_TAG, [n.encode() for _, n in part])]
        with open(path, "wb") as f:
            f.write(colfile.dump(columns))
    for size in (4, 10, 100):
        for i, b in enumerate(colfile.read_batches(paths, size)):
            out.append((size, i, len(b["k"]), int(b["k"][0]), b["n"][-1].decode()))
    return spark.createDataFrame(out, "size bigint, batch bigint, rows bigint, first bigint, last string")


_add(
    "batch_reader", batch_reader,
    """WITH s AS (SELECT unnest([4, 10, 100]) AS size),
       r AS (SELECT size, n_nationkey AS k, n_name AS n, n_nationkey >= 15 AS file, (n_nationkey - 15 * (n_nationkey >= 15)::INT) // size AS part
             FROM s, nation)
       SELECT CAST(size AS BIGINT) AS size, row_number() OVER (PARTITION BY size ORDER BY file, part) - 1 AS batch, count(*) AS rows,
              CAST(min(k) AS BIGINT) AS "first", max_by(n, k) AS "last" FROM r GROUP BY size, file, part""",
)


# An engine's answers, as rows.


def _answers(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "step bigint, asked string, answer string")


def _answers_sql(rows: list[tuple[str, str]]) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(a)}, {quoted(b)})" for i, (a, b) in enumerate(rows))
    return f"SELECT CAST(step AS BIGINT) AS step, asked, answer FROM (VALUES {values}) AS t(step, asked, answer)"


def _plain(value: object) -> str:
    """JSON without the times in ids."""
    return re.sub(r"_\d{15,}", "_N", json.dumps(value))


_PEOPLE = [{"name": "id", "type": "INT64"}, {"name": "name", "type": "VARCHAR"}]


def api_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session over the interface: tables, a load, queries, results, errors, and a table's end."""
    folder = _folder(spark)
    with open(f"{folder}/people.csv", "w") as f:
        f.write("1,ann\n2,bob\n3,cy\n")
    engine = Engine(spark, f"{folder}/engine", folder)
    service, out = Service(engine), []

    def call(method: str, path: str, body: object = None) -> object:
        status, value = service.answer(method, path, b"" if body is None else json.dumps(body).encode())
        if isinstance(value, dict):
            value = {k: v for k, v in value.items() if k != "uptime"}
        out.append((_plain(f"{method} {path}")[1:-1], _plain([status, value])))
        return value

    def query(definition: dict) -> str:
        job = call("POST", "/query", {"queryDefinition": definition})
        engine.wait(job)
        return job

    call("GET", "/system/info")
    call("GET", "/tables")
    people = call("PUT", "/table", {"name": "people", "columns": _PEOPLE})
    call("PUT", "/table", {"name": "people", "columns": _PEOPLE})
    call("PUT", "/table", {"name": "odd", "columns": [{"name": "a", "type": "FLOAT"}, {"name": "a", "type": "INT64"}]})
    call("GET", "/tables")
    call("GET", f"/table/{people}")
    call("GET", "/table/nobody")
    load = query({"sourceFilepath": "people.csv", "destinationTableName": "people"})
    call("GET", f"/query/{load}")
    call("GET", f"/result/{load}")
    names = query({"columnClauses": [col("id", "people"), fn("UPPER", col("name"))], "orderByClause": [{"columnIndex": 0, "ascending": False}]})
    call("GET", f"/result/{names}")
    call("GET", f"/result/{names}", {"rowLimit": 2})
    call("GET", f"/error/{names}")
    call("GET", "/queries")
    call("GET", f"/result/{names}", {"flushResult": True})
    call("GET", f"/result/{names}")
    failed = query({"columnClauses": [op("DIVIDE", lit(1), op("SUBTRACT", col("id", "people"), lit(2)))]})
    call("GET", f"/result/{failed}")
    call("GET", f"/error/{failed}")
    call("POST", "/query", {"queryDefinition": {"columnClauses": [col("x", "people")], "orderByClause": [{"columnIndex": 7}]}})
    call("DELETE", f"/table/{people}")
    call("DELETE", f"/table/{people}")
    call("GET", "/tables")
    engine.close()
    return _answers(spark, out)


_N = "people_N"
_add(
    "api_session", api_session,
    _answers_sql([
        ("GET /system/info", '[200, {"author": "millrace", "version": "1.0.0", "interfaceVersion": "2.1.0"}]'),
        ("GET /tables", "[200, []]"),
        ("PUT /table", f'[200, "{_N}"]'),
        ("PUT /table", '[400, {"problems": [{"error": "table people already exists"}]}]'),
        ("PUT /table", '[400, {"problems": [{"error": "Invalid column type: FLOAT"}, {"error": "Duplicate column name: a"}]}]'),
        ("GET /tables", f'[200, [{{"tableId": "{_N}", "name": "people"}}]]'),
        (f"GET /table/{_N}", f'[200, {{"name": "people", "columns": {json.dumps(_PEOPLE)}}}]'),
        ("GET /table/nobody", '[404, {"message": "Table not found"}]'),
        ("POST /query", '[200, "COPY_N"]'),
        ("GET /query/COPY_N", '[200, {"queryId": "COPY_N", "status": "COMPLETED", "queryDefinition": {"sourceFilepath": "people.csv", "destinationTableName": "people"}, "isResultAvailable": true}]'),
        ("GET /result/COPY_N", '[400, {"message": "COPY queries do not return a result set"}]'),
        ("POST /query", '[200, "SELECT_N"]'),
        ("GET /result/SELECT_N", '[200, [{"rowCount": 3, "columns": [[3, 2, 1], ["CY", "BOB", "ANN"]]}]]'),
        ("GET /result/SELECT_N", '[200, [{"rowCount": 2, "columns": [[3, 2], ["CY", "BOB"]]}]]'),
        ("GET /error/SELECT_N", '[400, {"message": "Query did not fail"}]'),
        ("GET /queries", '[200, [{"queryId": "COPY_N", "status": "COMPLETED"}, {"queryId": "SELECT_N", "status": "COMPLETED"}]]'),
        ("GET /result/SELECT_N", '[200, [{"rowCount": 3, "columns": [[3, 2, 1], ["CY", "BOB", "ANN"]]}]]'),
        ("GET /result/SELECT_N", '[404, {"message": "Query not found"}]'),
        ("POST /query", '[200, "SELECT_N"]'),
        ("GET /result/SELECT_N", '[400, {"message": "Query is in state FAILED"}]'),
        ("GET /error/SELECT_N", '[200, {"problems": [{"error": "division by zero"}]}]'),
        ("POST /query", '[400, {"problems": [{"error": "column x not found in table people"}, {"error": "invalid column index: 7", "context": "OrderByClause 0"}]}]'),
        (f"DELETE /table/{_N}", "[200, null]"),
        (f"DELETE /table/{_N}", '[404, {"message": "Table not found"}]'),
        ("GET /tables", "[200, []]"),
    ]),
)


def failing_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads that fail, and that they leave nothing."""
    folder = _folder(spark)
    engine = Engine(spark, f"{folder}/engine", folder)
    engine.catalog.create("t", [("id", "INT64"), ("name", "VARCHAR")])
    out = []

    def load(name: str, text: str | None, columns: tuple[str, ...] | None = None, header: bool = False) -> None:
        if text is not None:
            with open(f"{folder}/{name}.csv", "w") as f:
                f.write(text)
        try:
            engine.copy(request.Copy(f"{name}.csv", "t", columns, header))
            answer = "loaded"
        except CopyFailed as e:
            answer = str(e)
        out.append((name, answer))

    load("not a number", "1,a\nx,b\n")
    load("a fraction", "1.5,a\n")
    load("a blank before", " 1,a\n")
    load("beyond 64 bits", "9223372036854775808,a\n")
    load("too few fields", "1,a\n2\n")
    load("too many fields", "1,a\n2,b,c\n")
    load("empty", "")
    load("header only", "id,name\n", header=True)
    load("unknown column", "1,a\n", ("id", "nope"))
    load("missing", None)
    out.append(("batches", str(len(engine.catalog.by_name("t").batches))))
    out.append(("files", str(len(os.listdir(f"{folder}/engine/tables")))))
    load("good", "1,a\n-9223372036854775808,\"x,\"\"y\"\"\"\n")
    out.append(("rows", str(sorted(map(tuple, engine.select({"columnClauses": [col("id", "t"), col("name")]}).collect())))))
    engine.close()
    return _answers(spark, out)


_add(
    "failing_copies", failing_copies,
    _answers_sql([
        ("not a number", "row 1, col id: invalid INT64"), ("a fraction", "row 0, col id: invalid INT64"),
        ("a blank before", "row 0, col id: invalid INT64"), ("beyond 64 bits", "row 0, col id: invalid INT64"),
        ("too few fields", "row 1 has 1 columns, expected 2"), ("too many fields", "row 1 has 3 columns, expected 2"),
        ("empty", "empty CSV, no data imported"), ("header only", "empty CSV, no data imported"),
        ("unknown column", "column nope from CSV mapping not found in table definition"),
        ("missing", "failed to open the CSV file: no such file"), ("batches", "0"), ("files", "0"), ("good", "loaded"),
        ("rows", "[(-9223372036854775808, 'x,\"y\"'), (1, 'a')]"),
    ]),
)


def failing_selects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that aren't valid, with all their problems, and some that fail when they run."""
    engine = Engine(spark)
    engine.attach("nation", f"{sf_dir}/nation.parquet")
    out = []

    def ask(name: str, definition: dict) -> None:
        try:
            job = engine.wait(engine.submit(request.select(definition)))
            out.append((name, f"{job.state} {job.error}"))
        except Invalid as e:
            out.append((name, _plain(e.report())))

    key, name = col("n_nationkey", "nation"), col("n_name")
    ask("division by zero", {"columnClauses": [op("DIVIDE", key, op("SUBTRACT", key, key))]})
    ask("booleans compared", {"columnClauses": [op("EQUAL", op("LESS_THAN", key, lit(3)), lit(True))]})
    ask("no columns", {"columnClauses": []})
    ask("no table", {"columnClauses": [col("a")]})
    ask("unknown table", {"columnClauses": [col("a", "nowhere")]})
    ask("all at once", {
        "columnClauses": [key, col("a"), op("ADD", name, lit(1))], "whereClause": key,
        "orderByClause": [{"columnIndex": 3}], "limitClause": {"limit": -1},
    })
    ask("held batches", {"columnClauses": [op("ADD", lit(len(engine.catalog._held)), lit("x"))]})
    engine.close()
    return _answers(spark, out)


_add(
    "failing_selects", failing_selects,
    _answers_sql([
        ("division by zero", "FAILED [('division by zero', '')]"),
        ("booleans compared", "FAILED [('comparison not implemented for this type', '')]"),
        ("no columns", '{"problems": [{"error": "No columns specified for SELECT"}]}'),
        ("no table", '{"problems": [{"error": "no table name specified and query contains column references"}]}'),
        ("unknown table", '{"problems": [{"error": "table nowhere does not exist"}]}'),
        ("all at once", '{"problems": [{"error": "column a not found in table nation"}, {"error": "operator ADD requires INT64, got 1 and 0"}, '
                        '{"error": "where expression must return boolean", "context": "WhereClause"}, '
                        '{"error": "invalid column index: 3", "context": "OrderByClause 0"}, {"error": "limit must be non-negative"}]}'),
        ("held batches", '{"problems": [{"error": "operator ADD requires INT64, got 0 and 1"}]}'),
    ]),
)


def catalog_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a new engine over the same folder knows, and when a dropped table's files go."""
    folder = _folder(spark)
    with open(f"{folder}/in.csv", "w") as f:
        f.write("1\n2\n")
    first = Engine(spark, f"{folder}/engine", folder)
    first.catalog.create("kept", [("a", "INT64")])
    first.catalog.create("gone", [("b", "VARCHAR")])
    for name in ("kept", "gone", "kept"):
        first.copy(request.Copy("in.csv", name))
    first.close()
    engine = Engine(spark, f"{folder}/engine", folder)
    files = lambda: str(len(os.listdir(f"{folder}/engine/tables")))
    rows = lambda: str([r[0] for r in engine.select({"columnClauses": [col("a", "kept")]}).collect()])
    out = [("tables", ",".join(n for _, n in engine.catalog.tables())), ("files", files()), ("rows", rows())]
    snapshot = engine.catalog.acquire("gone")
    engine.catalog.drop(engine.catalog.by_name("gone").id)
    out += [("tables after a drop", ",".join(n for _, n in engine.catalog.tables())), ("files while they are read", files())]
    engine.catalog.release(snapshot)
    out += [("files afterwards", files()), ("rows afterwards", rows())]
    engine.close()
    return _answers(spark, out)


_add(
    "catalog_restart", catalog_restart,
    _answers_sql([
        ("tables", "kept,gone"), ("files", "3"), ("rows", "[1, 2, 1, 2]"), ("tables after a drop", "kept"),
        ("files while they are read", "3"), ("files afterwards", "2"), ("rows afterwards", "[1, 2, 1, 2]"),
    ]),
)


# CRC-64 bit by bit: eight steps of division for each byte of s, from its relation (k, s) of ASCII strings.
def _crc_sql(relation: str) -> str:
    return f"""RECURSIVE src AS ({relation}), crc(k, s, j, c) AS (
        SELECT k, s, 0, 0::UBIGINT FROM src
        UNION ALL
        SELECT k, s, j + 1, CASE WHEN x >> 63 = 1 THEN xor((x & 9223372036854775807::UBIGINT) << 1, {checksum.POLYNOMIAL}::UBIGINT) ELSE x << 1 END
        FROM (SELECT k, s, j, CASE WHEN j % 8 = 0 THEN xor(c, ascii(substr(s, j // 8 + 1, 1))::UBIGINT << 56) ELSE c END AS x
              FROM crc WHERE j < 8 * length(s)))"""


def crc64_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    return df.select("p_partkey", checksum.crc64_hex("p_name").alias("crc"))


_add(
    "crc64_strings", crc64_strings,
    f"""WITH {_crc_sql("SELECT p_partkey AS k, p_name AS s FROM part")}
        SELECT k AS p_partkey, format('{{:016x}}', c) AS crc FROM crc WHERE j = 8 * length(s)""",
)


def crc64_block_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of 1000 bytes in blocks of 105: in order, alternating with the last odd blocks held at the start, and without them."""
    folder = _folder(spark)
    with open(f"{folder}/letters", "wb") as f:
        f.write(bytes(97 + (i * i * 7 + i) % 26 for i in range(1000)))
    kinds = {"in order": (False, True), "alternating, held": (True, True), "alternating, left out": (True, False)}
    out = [checksum.file_checksums(spark, f"{folder}/letters", 105, *how).select(F.lit(k).alias("blocks"), "crc64") for k, how in kinds.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


_add(
    "crc64_block_orders", crc64_block_orders,
    "WITH " + _crc_sql("""
        SELECT kind AS k, string_agg(substr(s, greatest(place, 0) + 1, 105), '' ORDER BY i) AS s
        FROM (SELECT kind, i, CASE WHEN kind = 'in order' OR i % 2 = 0 THEN i * 105 ELSE 1000 - (i + 1) * 105 END AS place
              FROM (SELECT unnest(['in order', 'alternating, held', 'alternating, left out']) AS kind), (SELECT unnest(range(0, 10)) AS i)),
             (SELECT string_agg(chr((97 + (i * i * 7 + i) % 26)::INT), '' ORDER BY i) AS s FROM (SELECT unnest(range(0, 1000)) AS i))
        WHERE place >= 0 OR kind <> 'alternating, left out' GROUP BY kind""")
    + " SELECT k AS blocks, format('{:016x}', c) AS crc64 FROM crc WHERE j = 8 * length(s)",
)


def crc64_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select("doc_id", checksum.crc64_hex("text").alias("crc"))


_add("crc64_text", crc64_text)


def crc64_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's checksum in order and with alternating blocks."""
    path = f"{sf_dir}/customer.parquet"
    plain = checksum.file_checksums(spark, path, 4096).withColumn("blocks", F.lit("in order"))
    other = checksum.file_checksums(spark, path, 4096, alternating=True).withColumn("blocks", F.lit("alternating"))
    return plain.unionByName(other).select("blocks", "crc64")


_add("crc64_file", crc64_file)


def zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The integer codec's mapping as a column expression; the last two bits of each code and the way back."""
    df = own_session(spark).read.parquet(f"{sf_dir}/orders.parquet")
    n = F.col("o_custkey") - F.lit(700)
    code = F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))
    back = F.shiftrightunsigned(code, 1).bitwiseXOR(-code.bitwiseAND(F.lit(1).cast("bigint")))
    return df.select("o_orderkey", code.alias("code"), back.alias("back"))


_add(
    "zigzag", zigzag,
    """SELECT o_orderkey, CASE WHEN o_custkey >= 700 THEN 2 * (o_custkey - 700) ELSE -2 * (o_custkey - 700) - 1 END AS code,
       o_custkey - 700 AS back FROM orders""",
)


def entry(spark: SparkSession) -> DataFrame:
    """A scan, a filter, a function, a sort and a limit over orders."""
    definition = {
        "columnClauses": [col("o_orderkey", "orders"), fn("CONCAT", col("o_orderstatus"), lit("-"), col("o_orderpriority"))],
        "whereClause": op("LESS_THAN", col("o_custkey"), lit(100)),
        "orderByClause": [{"columnIndex": 0, "ascending": True}],
        "limitClause": {"limit": 20},
    }
    engine = Engine(spark)
    engine.attach("orders", "/root/testdata/sf0.001/orders.parquet")
    return engine.select(definition).toDF("o_orderkey", "status")
