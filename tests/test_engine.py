"""Catalog, COPY, SELECT, jobs and HTTP."""

import json
import os
import threading
import urllib.request

import pytest

from millrace import engine as engine_module
from millrace import http_api
from millrace.catalogue import col, fn, lit, op
from millrace.engine import COMPLETED, FAILED, Engine
from millrace.plans import request
from millrace.plans.problems import Invalid, Malformed
from millrace.sources.catalog import Batch, Catalog
from millrace.sources.csv_copy import CopyFailed


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "engine"), str(tmp_path))
    yield e
    e.close()


def load(engine, tmp_path, text, columns, header=False, mapping=None, name="t"):
    if engine.catalog.by_name(name) is None:
        engine.catalog.create(name, columns)
    path = tmp_path / "in.csv"
    path.write_bytes(text.encode())
    return engine.copy(request.Copy(str(path), name, mapping, header))


def rows(engine, definition):
    job = engine.wait(engine.submit(request.query({"queryDefinition": definition})))
    if job.state == FAILED:
        raise AssertionError(job.error)
    return engine.result(job.id)


TWO = [("id", "INT64"), ("name", "VARCHAR")]


def test_catalog_survives_a_restart(tmp_path):
    c = Catalog(str(tmp_path))
    i = c.create("users", TWO)
    c.append("users", Batch("somewhere", 3))
    again = Catalog(str(tmp_path))
    assert again.tables() == [(i, "users")]
    assert again.by_id(i).columns == dict(TWO)
    assert again.by_name("users").batches == [Batch("somewhere", 3)]
    assert again.drop(i) and not again.drop(i)
    assert Catalog(str(tmp_path)).tables() == []


def test_dropped_files_go_when_no_reader_holds_them(tmp_path):
    c = Catalog(str(tmp_path))
    i = c.create("t1", [("a", "INT64")])
    data = tmp_path / "data"
    data.write_text("x")
    c.append("t1", Batch(str(data)))
    with c.snapshot("t1"), c.snapshot("t1"):
        c.drop(i)
        assert data.exists()
    assert not data.exists()
    with pytest.raises(Invalid, match="table t1 does not exist"):
        c.acquire("t1")


def test_create_reports_all_problems():
    c = Catalog()
    with pytest.raises(Invalid) as e:
        c.create("t", [("a", "FLOAT"), ("a", "INT64"), ("b", "BOOLEAN")])
    assert [p for p, _ in e.value.problems] == ["Invalid column type: FLOAT", "Duplicate column name: a", "Invalid column type: BOOLEAN"]
    with pytest.raises(Invalid, match="at least one column"):
        c.create("t", [])
    c.create("t", TWO)
    with pytest.raises(Invalid, match="already exists"):
        c.create("t", TWO)


def test_copy_keeps_text_and_order(engine, tmp_path):
    text = '1,"a,b"\n-2,"line\nend"\n\n+3," ""q"" "\n007,\n'
    assert load(engine, tmp_path, text, TWO) == 4
    got = rows(engine, {"columnClauses": [col("id", "t"), col("name")]})
    assert got == {"rowCount": 4, "columns": [[1, -2, 3, 7], ["a,b", "line\nend", ' "q" ', ""]]}


def test_copy_header_and_permutation(engine, tmp_path):
    assert load(engine, tmp_path, "x,y\nann,1\nbob,2\n", TWO, True, ("name", "id")) == 2
    assert rows(engine, {"columnClauses": [col("id", "t"), col("name")]})["columns"] == [[1, 2], ["ann", "bob"]]


@pytest.mark.parametrize(
    ("text", "header", "mapping", "message"),
    [
        ("1,a\nx,b\n", False, None, "row 1, col id: invalid INT64"),
        ("1.5,a\n", False, None, "row 0, col id: invalid INT64"),
        (" 1,a\n", False, None, "row 0, col id: invalid INT64"),
        (",a\n", False, None, "row 0, col id: invalid INT64"),
        ("9223372036854775808,a\n", False, None, "row 0, col id: invalid INT64"),
        ("1,a\n2\n", False, None, "row 1 has 1 columns, expected 2"),
        ("1,a\n2,b,c\n", False, None, "row 1 has 3 columns, expected 2"),
        ("", False, None, "empty CSV, no data imported"),
        ("id,name\n", True, None, "empty CSV, no data imported"),
        ("1,a\n", False, ("id", "nope"), "column nope from CSV mapping not found"),
        ("1,a\n", False, ("id",), "must name every column"),
        ("1,a\n", False, ("id", "id"), "must name every column"),
    ],
)
def test_copy_is_all_or_nothing(engine, tmp_path, text, header, mapping, message):
    engine.catalog.create("t", TWO)
    with pytest.raises(CopyFailed, match=message.replace("(", r"\(")):
        load(engine, tmp_path, text, TWO, header, mapping)
    assert engine.catalog.by_name("t").batches == []
    assert os.listdir(tmp_path / "engine" / "tables") == []
    assert rows(engine, {"columnClauses": [col("id", "t")]}) == {"rowCount": 0, "columns": []}


def test_copy_stays_inside_the_data_folder(engine):
    engine.catalog.create("t", TWO)
    with pytest.raises(CopyFailed, match="outside the data folder"):
        engine.copy(request.Copy("/etc/passwd", "t"))
    with pytest.raises(CopyFailed, match="no such file"):
        engine.copy(request.Copy("missing.csv", "t"))


@pytest.fixture
def two_files(engine, tmp_path):
    """ids 0 to 14 in one load, 15 to 19 in another; name is row<id>."""
    for part in (range(15), range(15, 20)):
        load(engine, tmp_path, "".join(f"{i},row{i}\n" for i in part), TWO)
    return engine


def test_results_keep_the_order_of_loads(two_files):
    got = rows(two_files, {"columnClauses": [col("id", "t")]})
    assert got["columns"] == [list(range(20))]
    got = rows(two_files, {"columnClauses": [col("id", "t"), col("name")], "limitClause": {"limit": 17}})
    assert got["columns"] == [list(range(17)), [f"row{i}" for i in range(17)]]
    where = op("GREATER_THAN", col("id"), lit(12))
    got = rows(two_files, {"columnClauses": [col("id", "t")], "whereClause": where, "limitClause": {"limit": 4}})
    assert got["columns"] == [[13, 14, 15, 16]]


def parquet(engine, spark, tmp_path, parts=6, rows=10):
    """A table t of several files, ids ascending by file."""
    for i in range(parts):
        part = spark.range(i * rows, (i + 1) * rows).selectExpr("id", "concat('row', id) AS name")
        part.coalesce(1).write.parquet(str(tmp_path / f"made{i}"))
        (found,) = (tmp_path / f"made{i}").glob("*.parquet")
        (tmp_path / "many").mkdir(exist_ok=True)
        found.rename(tmp_path / "many" / f"part-{i}.parquet")
    engine.attach("t", str(tmp_path / "many"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_limit_opens_only_the_files_it_needs(engine, spark, tmp_path):
    parquet(engine, spark, tmp_path)
    for limit, files in ((0, 0), (1, 1), (10, 1), (11, 2), (25, 3), (60, 6), (99, 6)):
        df = engine.select({"columnClauses": [col("id", "t")], "limitClause": {"limit": limit}})
        assert sorted(r[0] for r in df.collect()) == list(range(min(limit, 60)))
        assert len({f for f in df.inputFiles()}) == files
        assert "Sort" not in plan_of(df) and "Exchange" not in plan_of(df) and "TakeOrdered" not in plan_of(df)
    assert [r.id for r in engine.scan("t", 12).collect()] == list(range(12))


def test_limited_matches_end_early(engine, spark, tmp_path, monkeypatch):
    parquet(engine, spark, tmp_path)
    steps, plain = [], engine_module.select.frame
    monkeypatch.setattr(engine_module.select, "frame", lambda s, p, hidden=False, pieces=None: (steps.append(pieces and len(pieces)), plain(s, p, hidden, pieces))[1])
    where = op("GREATER_EQUAL", col("id"), lit(8))
    for limit, want in ((1, [1]), (2, [1]), (3, [1, 4]), (42, [1, 4]), (43, [1, 4, 1]), (100, [1, 4, 1, 0])):
        steps.clear()
        got = rows(engine, {"columnClauses": [col("id", "t")], "whereClause": where, "limitClause": {"limit": limit}})
        assert got["columns"] == [list(range(8, min(60, 8 + limit)))] and [s or 0 for s in steps] == want
    assert rows(engine, {"columnClauses": [col("id", "t")], "whereClause": where, "limitClause": {"limit": 0}})["rowCount"] == 0


def test_results_are_kept_in_the_folder(two_files, tmp_path):
    kept = tmp_path / "engine" / "results"
    job = two_files.wait(two_files.submit(request.select({"columnClauses": [col("id", "t")], "orderByClause": [{"columnIndex": 0}]})))
    assert len(os.listdir(kept)) == 1
    assert two_files.result(job.id, 3)["columns"] == [[19, 18, 17]]
    assert two_files.result(job.id, flush=True)["columns"] == [list(range(19, -1, -1))]
    assert os.listdir(kept) == []


@pytest.mark.parametrize(
    ("order", "limit", "expected"),
    [
        ([{"columnIndex": 0, "ascending": True}], {"limit": 3}, [0, 1, 2]),
        ([{"columnIndex": 0}], {"limit": 3}, [19, 18, 17]),  # descending unless it says otherwise
        ([{"columnIndex": 1, "ascending": True}], {"limit": 3}, [0, 3, 6]),  # ties in the order of rows
        ([{"columnIndex": 1}, {"columnIndex": 0}], {"limit": 3}, [17, 14, 11]),
        ([{"columnIndex": 2}, {"columnIndex": 0, "ascending": True}], {"limit": 2}, [11, 12]),
        ([{}], {"limit": 1}, [19]),
        ([{"columnIndex": 0}], {}, []),
        ([{"columnIndex": 0, "ascending": True}], {"limit": 100}, list(range(20))),
    ],
)
def test_order_and_limit(two_files, order, limit, expected):
    three = op("SUBTRACT", col("id"), op("MULTIPLY", op("DIVIDE", col("id"), lit(3)), lit(3)))
    big = op("GREATER_THAN", col("id"), lit(10))
    got = rows(two_files, {"columnClauses": [col("id", "t"), three, big], "orderByClause": order, "limitClause": limit})
    assert (got["columns"] or [[]])[0] == expected


def test_predicate_names_do_not_shadow_columns(engine, tmp_path):
    load(engine, tmp_path, "1,a\n2,b\n", [("result", "INT64"), ("literal", "VARCHAR")])
    got = rows(engine, {"columnClauses": [col("result", "t"), col("literal")], "whereClause": op("EQUAL", col("result"), lit(2))})
    assert got["columns"] == [[2], ["b"]]


def test_queries_without_a_table(engine):
    assert rows(engine, {"columnClauses": [lit(1), lit("x"), lit(True)]}) == {"rowCount": 1, "columns": [[1], ["x"], [True]]}
    assert rows(engine, {"columnClauses": [lit(1)], "whereClause": lit(False)})["rowCount"] == 0
    assert rows(engine, {"columnClauses": [lit(1)], "whereClause": None, "limitClause": {"limit": 0}})["rowCount"] == 0


def test_table_named_in_where_repeats_literals(two_files):
    got = rows(two_files, {"columnClauses": [lit("x")], "whereClause": op("LESS_THAN", col("id", "t"), lit(3))})
    assert got["columns"] == [["x"] * 3]


@pytest.mark.parametrize(
    ("definition", "expected"),
    [
        ({"columnClauses": []}, [("No columns specified for SELECT", "")]),
        ({"columnClauses": [col("id")]}, [("no table name specified and query contains column references", "")]),
        ({"columnClauses": [col("id", "nope")]}, [("table nope does not exist", "")]),
        (
            {
                "columnClauses": [col("id", "t"), col("a"), op("ADD", col("name"), lit(1))],
                "whereClause": col("id"), "orderByClause": [{"columnIndex": 3}, {"columnIndex": -1}], "limitClause": {"limit": -1},
            },
            [
                ("column a not found in table t", ""), ("operator ADD requires INT64, got 1 and 0", ""),
                ("where expression must return boolean", "WhereClause"), ("invalid column index: 3", "OrderByClause 0"),
                ("invalid column index: -1", "OrderByClause 1"), ("limit must be non-negative", ""),
            ],
        ),
    ],
)
def test_select_reports_all_problems(engine, definition, expected):
    engine.catalog.create("t", TWO)
    with pytest.raises(Invalid) as e:
        engine.submit(request.query({"queryDefinition": definition}))
    assert e.value.problems == expected
    assert engine.jobs() == [] and engine.catalog._held == {}


@pytest.mark.parametrize(
    "definition",
    [
        {}, {"columnClauses": [lit(1)], "sourceFilepath": "x"}, {"columnClauses": [{"value": 1, "more": 2}]}, {"columnClauses": [{"operator": "ADD"}]},
        {"columnClauses": [{"operator": "ADD", "leftOperand": lit(1)}]}, {"columnClauses": [{}]}, {"columnClauses": lit(1)},
        {"columnClauses": [lit(1)], "having": 1}, {"sourceFilepath": "", "destinationTableName": "t"}, {"sourceFilepath": "x"},
    ],
)
def test_malformed_requests(definition):
    with pytest.raises(Malformed):
        request.query({"queryDefinition": definition})


def test_failed_job_tells_why(two_files):
    job = two_files.wait(two_files.submit(request.select({"columnClauses": [op("DIVIDE", lit(1), col("id", "t"))]})))
    assert (job.state, job.error) == (FAILED, [("division by zero", "")])
    assert two_files.catalog._held == {}


def test_running_select_outlives_its_table(two_files):
    snapshot = two_files.catalog.acquire("t")
    two_files.catalog.drop(two_files.catalog.by_name("t").id)
    assert all(os.path.exists(b.path) for b in snapshot.batches)
    two_files.catalog.release(snapshot)
    assert not any(os.path.exists(b.path) for b in snapshot.batches)


@pytest.fixture
def call(engine):
    server = http_api.server(engine, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def run(method, path, body=None, raw=False):
        data = None if body is None else body if isinstance(body, bytes) else json.dumps(body).encode()
        r = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data, method=method)
        try:
            with urllib.request.urlopen(r, timeout=60) as answer:
                status, text = answer.status, answer.read()
        except urllib.error.HTTPError as e:
            status, text = e.code, e.read()
        return status, text.decode() if raw else json.loads(text) if text else None

    yield run
    server.shutdown()
    server.server_close()


def test_http(call, engine, tmp_path):
    assert call("GET", "/tables") == (200, [])
    status, table = call("PUT", "/table", {"name": "t", "columns": [{"name": "id", "type": "INT64"}, {"name": "name", "type": "VARCHAR"}]})
    assert status == 200 and table.startswith("t_")
    assert call("GET", "/tables")[1] == [{"tableId": table, "name": "t"}]
    assert call("GET", f"/table/{table}")[1]["columns"][1] == {"name": "name", "type": "VARCHAR"}
    assert call("GET", "/table/nope") == (404, {"message": "Table not found"})
    assert call("PUT", "/table", {"name": "u", "columns": []})[1] == {"problems": [{"error": "Table must have at least one column"}]}
    assert call("PUT", "/table", {"columns": []}) == (400, "required field 'name' is zero value.")
    assert call("PUT", "/table", b"{")[0] == 400
    assert call("PUT", "/table", {"name": "u", "columns": [], "x": 1})[0] == 400

    (tmp_path / "a.csv").write_text("1,ann\n2,bob\n3,cy\n")
    copy = {"sourceFilepath": "a.csv", "destinationTableName": "t"}
    status, job = call("POST", "/query", {"queryDefinition": copy})
    assert status == 200 and job.startswith("COPY_")
    engine.wait(job)
    assert call("GET", f"/query/{job}") == (200, {"queryId": job, "status": COMPLETED, "queryDefinition": copy, "isResultAvailable": True})
    assert call("GET", f"/result/{job}") == (400, {"message": "COPY queries do not return a result set"})
    assert call("POST", "/query", {"queryDefinition": copy | {"destinationTableName": "u"}}) == (400, {"problems": [{"error": "table u does not exist"}]})

    select = {"columnClauses": [col("id", "t"), fn("UPPER", col("name"))]}
    job = call("POST", "/query", {"queryDefinition": select})[1]
    engine.wait(job)
    assert {"queryId": job, "status": COMPLETED} in call("GET", "/queries")[1]
    assert call("GET", f"/result/{job}") == (200, [{"rowCount": 3, "columns": [[1, 2, 3], ["ANN", "BOB", "CY"]]}])
    assert call("GET", f"/result/{job}", {"rowLimit": 2}) == (200, [{"rowCount": 2, "columns": [[1, 2], ["ANN", "BOB"]]}])
    assert call("GET", f"/error/{job}") == (400, {"message": "Query did not fail"})
    assert call("GET", f"/result/{job}", {"flushResult": True})[0] == 200
    assert call("GET", f"/result/{job}") == (404, {"message": "Query not found"})
    assert call("GET", f"/query/{job}")[0] == call("GET", f"/error/{job}")[0] == 404

    bad = call("POST", "/query", {"queryDefinition": {"columnClauses": [col("x", "t")], "orderByClause": [{"columnIndex": 7}]}})
    assert bad == (400, {"problems": [{"error": "column x not found in table t"}, {"error": "invalid column index: 7", "context": "OrderByClause 0"}]})
    job = call("POST", "/query", {"queryDefinition": {"columnClauses": [op("DIVIDE", lit(1), lit(0))]}})[1]
    engine.wait(job)
    assert call("GET", f"/result/{job}")[0] == 400
    assert call("GET", f"/error/{job}") == (200, {"problems": [{"error": "division by zero"}]})

    assert call("DELETE", f"/table/{table}") == (200, None)
    assert call("DELETE", f"/table/{table}")[0] == 404
    assert call("GET", "/system/info")[1]["interfaceVersion"] == "2.1.0"
    assert call("GET", "/nowhere")[0] == 404 and call("DELETE", "/tables")[0] == 405
    status, spec = call("GET", "/api/openapi.json")
    assert status == 200 and sorted(spec["paths"]["/table/{id}"]) == ["delete", "get"] and "post" in spec["paths"]["/query"]
    assert call("GET", "/swagger", raw=True) == (200, http_api.Service(engine).page())
