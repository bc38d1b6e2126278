"""Expression trees over a small batch, and the typing rules."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.catalogue import col, fn, lit, op
from millrace.engine import own_session
from millrace.functions.expressions import Binder
from millrace.plans import request
from millrace.plans.problems import Invalid

COLUMNS = {"id": "INT64", "value": "INT64", "name": "VARCHAR"}
ROWS = [(1, 10, "alice"), (2, 20, "bob"), (3, 30, "charlie")]


@pytest.fixture(scope="module")
def batch(spark):
    return own_session(spark).createDataFrame(ROWS, "id long, value long, name string").coalesce(1)


def evaluate(df, e):
    bound = Binder("t", COLUMNS).bind(request.expression(e))
    return [r[0] for r in df.select(bound.build()).collect()]


def problems(e):
    with pytest.raises(Invalid) as info:
        Binder("t", COLUMNS).bind(request.expression(e))
    return [p for p, _ in info.value.problems]


@pytest.mark.parametrize(
    ("e", "expected"),
    [
        (op("MULTIPLY", op("ADD", col("id"), lit(5)), col("value")), [60, 140, 240]),
        (op("GREATER_THAN", fn("STRLEN", col("name")), lit(3)), [True, False, True]),
        (fn("CONCAT", fn("UPPER", col("name")), lit("_suffix")), ["ALICE_suffix", "BOB_suffix", "CHARLIE_suffix"]),
        (fn("REPLACE", col("name"), lit("a"), lit("X")), ["Xlice", "bob", "chXrlie"]),
        (
            op(
                "AND",
                op(
                    "AND",
                    op("GREATER_EQUAL", op("ADD", fn("STRLEN", fn("CONCAT", fn("UPPER", col("name")), lit("!!!"))), col("id")), lit(9)),
                    op("OR", lit(True), lit(False)),
                ),
                op("AND", op("NOT", op("EQUAL", col("id"), lit(0))), op("NOT_EQUAL", fn("LOWER", col("name")), lit("empty"))),
            ),
            [True, False, True],
        ),
        (op("DIVIDE", op("SUBTRACT", lit(0), col("value")), lit(7)), [-1, -2, -4]),
        (op("ADD", lit(2**63 - 1), col("id")), [-(2**63), -(2**63) + 1, -(2**63) + 2]),
        (op("MINUS", lit(-(2**63))), [-(2**63)] * 3),
        (op("DIVIDE", lit(-(2**63)), lit(-1)), [-(2**63)] * 3),
        (fn("STRLEN", lit("é€😀")), [9] * 3),
        (fn("UPPER", lit("straße ŉ ǰ ﬁ ᾳ é")), ["STRAßE ŉ ǰ ﬁ ᾼ É"] * 3),
        (fn("LOWER", lit("ΑΣ İ É")), ["ας".replace("ς", "σ") + " i é"] * 3),
        (fn("REPLACE", lit("aaa"), lit("aa"), lit("b")), ["ba"] * 3),
        (fn("REPLACE", lit("abc"), lit(""), lit("-")), ["abc"] * 3),
        (op("LESS_THAN", lit("Z"), lit("a")), [True] * 3),
        (op("LESS_THAN", lit("z"), lit("é")), [True] * 3),
        (lit(5.0), [5] * 3),
    ],
)
def test_values(batch, e, expected):
    assert evaluate(batch, e) == expected


def test_division_by_zero_fails_only_where_it_runs(batch):
    e = op("DIVIDE", lit(10), op("SUBTRACT", col("id"), lit(2)))
    with pytest.raises(Exception, match="division by zero"):
        evaluate(batch, e)
    assert evaluate(batch.where("id <> 2"), e) == [-10, 10]


def test_booleans_pass_the_type_check_and_fail_to_compare(batch):
    with pytest.raises(Exception, match="comparison not implemented for this type"):
        evaluate(batch, op("EQUAL", lit(True), lit(True)))


@pytest.mark.parametrize(
    ("e", "expected"),
    [
        (op("ADD", lit(1), lit("x")), ["operator ADD requires INT64, got 0 and 1"]),
        (op("EQUAL", lit(1), lit("x")), ["comparison EQUAL requires the same types, got 0 and 1"]),
        (op("AND", lit(True), lit(1)), ["logical operator AND requires BOOLEAN"]),
        (op("NOT", lit(1)), ["NOT operator requires BOOLEAN, got 0"]),
        (op("MINUS", lit("x")), ["MINUS operator requires INT64, got 1"]),
        (op("XOR", lit(1), lit(1)), ["unknown binary operator: XOR"]),
        (op("ABS", lit(1)), ["unknown unary operator: ABS"]),
        (fn("STRLEN"), ["STRLEN expects 1 argument, got 0"]),
        (fn("STRLEN", lit(1)), ["STRLEN argument must be VARCHAR, got 0"]),
        (fn("CONCAT", lit("x")), ["CONCAT expects at least 2 arguments"]),
        (fn("CONCAT", lit("x"), lit(True)), ["CONCAT argument 1 must be VARCHAR, got 2"]),
        (fn("UPPER", lit(1)), ["UPPER expects 1 VARCHAR argument"]),
        (fn("LOWER"), ["LOWER expects 1 VARCHAR argument"]),
        (fn("REPLACE", lit("x")), ["REPLACE expects 3 arguments (source, old, new)"]),
        (fn("REPLACE", lit("x"), lit("y"), lit(1)), ["REPLACE arguments must be VARCHAR"]),
        (fn("SQRT", lit(1)), ["unknown function: SQRT"]),
        (col("id", "u"), ["column id refers to table u, but query is on table t"]),
        (col("ID"), ["column ID not found in table t"]),
        (lit(1.5), ["unsupported literal type: float (value: 1.5)"]),
        (lit(None), ["unsupported literal type: NoneType (value: None)"]),
        (lit(2**63), [f"unsupported literal type: int (value: {2**63})"]),
        # Problems of all parts; an operator's own only if its parts are fine.
        (op("ADD", col("a"), fn("CONCAT", col("b"), col("c"))), [f"column {c} not found in table t" for c in "abc"]),
    ],
)
def test_problems(e, expected):
    assert problems(e) == expected


INTS = st.integers(-(2**63), 2**63 - 1)


def wrapped(n):
    return (n + 2**63) % 2**64 - 2**63


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(INTS, INTS), min_size=1, max_size=30))
def test_integers_wrap_as_64_bits(batch, pairs):
    df = batch.sparkSession.createDataFrame(pairs, "id long, value long").coalesce(1)
    for name, f in (("ADD", lambda a, b: a + b), ("SUBTRACT", lambda a, b: a - b), ("MULTIPLY", lambda a, b: a * b)):
        assert evaluate(df, op(name, col("id"), col("value"))) == [wrapped(f(a, b)) for a, b in pairs]
