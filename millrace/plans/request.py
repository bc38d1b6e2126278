"""The request grammar: JSON to syntax trees, without unknown fields."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from .problems import Malformed


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class ColumnRef:
    column: str
    table: str = ""


@dataclass(frozen=True)
class Call:
    function: str
    arguments: tuple[Expr, ...]


@dataclass(frozen=True)
class Binary:
    operator: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Unary:
    operator: str
    operand: Expr


Expr = Literal | ColumnRef | Call | Binary | Unary


@dataclass(frozen=True)
class OrderBy:
    index: int = 0
    ascending: bool = False


@dataclass(frozen=True)
class Select:
    columns: tuple[Expr, ...]
    where: Expr | None = None
    order_by: tuple[OrderBy, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class Copy:
    path: str
    table: str
    columns: tuple[str, ...] | None = None
    header: bool = False


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: tuple[ColumnDef, ...] = field(default=())


def load(body: bytes | str) -> object:
    try:
        return json.loads(body)
    except (ValueError, RecursionError) as e:
        raise Malformed(f"invalid JSON: {e}") from e


_ZERO = {str: "", int: 0, bool: False, list: [], dict: None}


def _get(data: dict, name: str, kind: type, required: bool = False):
    """A field of a kind; absent and null are its zero value, which a required field mustn't be."""
    value = data.get(name)
    if value is None:
        value = _ZERO[kind]
    elif not isinstance(value, kind) or kind is int and isinstance(value, bool):
        raise Malformed(f"field '{name}' must be of type {kind.__name__}")
    if required and value in ("", None):
        raise Malformed(f"required field '{name}' is zero value.")
    return value


def _object(data: object, what: str, *names: str) -> dict:
    if not isinstance(data, dict):
        raise Malformed(f"{what} must be an object")
    for name in data:
        if name not in names:
            raise Malformed(f'json: unknown field "{name}"')
    return data


def _int32(data: dict, name: str) -> int:
    value = _get(data, name, int)
    if not -(2**31) <= value < 2**31:
        raise Malformed(f"field '{name}' is out of range")
    return value


def expression(data: object) -> Expr:
    """An expression's kind follows from its keys: value, functionName, columnName, then operator."""
    if not isinstance(data, dict):
        raise Malformed("invalid column expression, cannot determine type")
    if "value" in data:
        _object(data, "Literal", "value")
        if isinstance(data["value"], list | dict):
            raise Malformed("invalid Literal: a number, string or boolean is needed")
        return Literal(data["value"])
    if "functionName" in data:
        _object(data, "Function", "functionName", "arguments")
        return Call(_get(data, "functionName", str), tuple(map(expression, _get(data, "arguments", list))))
    if "columnName" in data:
        _object(data, "ColumnReferenceExpression", "tableName", "columnName")
        return ColumnRef(_get(data, "columnName", str), _get(data, "tableName", str))
    if "operator" in data:
        if "leftOperand" in data:
            _object(data, "ColumnarBinaryOperation", "operator", "leftOperand", "rightOperand")
            return Binary(_get(data, "operator", str), expression(data["leftOperand"]), expression(data.get("rightOperand")))
        if "operand" in data:
            _object(data, "ColumnarUnaryOperation", "operator", "operand")
            return Unary(_get(data, "operator", str), expression(data["operand"]))
        raise Malformed("invalid operator")
    raise Malformed("invalid column expression, cannot determine type")


def select(data: object) -> Select:
    data = _object(data, "SELECT", "columnClauses", "whereClause", "orderByClause", "limitClause")
    where = data.get("whereClause")
    orders = []
    for o in _get(data, "orderByClause", list):
        o = _object(o, "orderByClause", "columnIndex", "ascending")
        orders.append(OrderBy(_int32(o, "columnIndex"), _get(o, "ascending", bool)))
    limit = data.get("limitClause")
    return Select(
        tuple(map(expression, _get(data, "columnClauses", list))),
        None if where is None else expression(where),
        tuple(orders),
        None if limit is None else _int32(_object(limit, "limitClause", "limit"), "limit"),
    )


def copy(data: object) -> Copy:
    data = _object(data, "COPY", "sourceFilepath", "destinationTableName", "destinationColumns", "doesCsvContainHeader")
    columns = data.get("destinationColumns")
    if columns is not None and not (isinstance(columns, list) and all(isinstance(c, str) for c in columns)):
        raise Malformed("field 'destinationColumns' must be a list of names")
    return Copy(
        _get(data, "sourceFilepath", str, True),
        _get(data, "destinationTableName", str, True),
        None if columns is None else tuple(columns),
        _get(data, "doesCsvContainHeader", bool),
    )


def query(data: object) -> Select | Copy:
    """The kind of a query follows from its keys; keys of both kinds are an error."""
    definition = _object(data, "request", "queryDefinition").get("queryDefinition")
    if not isinstance(definition, dict):
        raise Malformed("required field 'queryDefinition' is zero value.")
    is_select = "columnClauses" in definition
    is_copy = "sourceFilepath" in definition or "destinationTableName" in definition
    if is_select and is_copy:
        raise Malformed("the query definition is both SELECT and COPY")
    if is_select:
        return select(definition)
    if is_copy:
        return copy(definition)
    raise Malformed("cannot determine the type of the query definition")


def table(data: object) -> TableDef:
    data = _object(data, "table", "name", "columns")
    name = _get(data, "name", str, True)
    if data.get("columns") is None:
        raise Malformed("required field 'columns' is zero value.")
    columns = []
    for c in _get(data, "columns", list):
        c = _object(c, "column", "name", "type")
        columns.append(ColumnDef(_get(c, "name", str, True), _get(c, "type", str, True)))
    return TableDef(name, tuple(columns))


def result_options(body: bytes | str) -> tuple[int, bool]:
    """(row limit, whether to flush) of the optional body of a result request."""
    if not body.strip():
        return 0, False
    data = _object(load(body) or {}, "request", "rowLimit", "flushResult")
    return _int32(data, "rowLimit"), _get(data, "flushResult", bool)
