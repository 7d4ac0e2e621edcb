"""Expressions as Spark columns, where the semantics differ from Spark's own: errors are null, never exceptions."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import Agg, Call, Expr, Lit, Node, Path, QueryError, Quant

Resolve = Callable[[Expr], Column]

_KINDS = {"=": "boolean", "!=": "boolean", ">": "boolean", "AND": "boolean", "OR": "boolean", "NOT": "boolean", "BOUND": "boolean", "REGEX": "boolean"}
_STRING = {"CONCAT", "SUBSTR", "STRBEFORE", "STRAFTER", "REPLACE", "UCASE", "LCASE", "ENCODE_FOR_URI", "STR", "MD5", "SHA1", "SHA256", "SHA384", "SHA512", "LANG", "TIMEZONE", "TZ"}
_NUMBER = {"+", "-", "*", "/", "ABS", "ROUND", "CEIL", "FLOOR", "POWER", "RAND", "STRLEN", "YEAR", "MONTH", "DAY", "HOURS", "MINUTES", "SECONDS"}


def kind(e: Expr) -> str | None:
    """string, number, boolean, date, dateTime or iri; None if it is not known before the query runs."""
    match e:
        case Lit(bool()):
            return "boolean"
        case Lit(int() | float() | Decimal()):
            return "number"
        case Lit(str()) | Lit(None):
            return "string"
        case Lit(datetime()):
            return "dateTime"
        case Lit(date()):
            return "date"
        case Node():
            return "iri"
        case Path():
            return e.prop.kind if e.prop is not None else "iri"
        case Agg():
            return "number" if e.name in ("COUNT", "SUM", "AVG") else kind(e.arg)
        case Call(name, args):
            if name in _STRING:
                return "string"
            if name in _NUMBER:
                return "number"
            if name == "NOW":
                return "dateTime"
            if name in ("IRI", "URI"):
                return "iri"
            if name in ("COALESCE", "IF"):
                kinds = {kind(a) for a in (args if name == "COALESCE" else args[1:])}
                return kinds.pop() if len(kinds) == 1 else None
            return _KINDS.get(name)
    return None


def comparable(a: str | None, b: str | None) -> bool:
    return a is None or b is None or a == b or {a, b} == {"date", "dateTime"}


def literal(value) -> Column:
    return F.lit("" if value is None else value)


def _aligned(args: tuple[Expr, ...], columns: list[Column]) -> list[Column]:
    """Date properties compare as dates: a moment beside one becomes its day."""
    kinds = {kind(a) for a in args}
    if kinds == {"date", "dateTime"}:
        return [c.cast("date") for c in columns]
    return columns


def _flagged(pattern: Column | str, flags: str) -> str:
    return f"(?{flags})" if flags else ""


def compile(e: Expr, resolve: Resolve) -> Column:  # noqa: A001
    """resolve: columns of paths, quantifiers, aggregates and context values."""
    match e:
        case Lit(value):
            return literal(value)
        case Node(id_):
            return F.lit(id_)
        case Call():
            return _call(e, resolve)
    return resolve(e)


def _call(e: Call, resolve: Resolve) -> Column:
    name, args = e.name, e.args
    if name in ("ISIRI", "ISURI", "ISLITERAL", "ISBLANK", "ISNUMERIC", "DATATYPE", "LANG"):
        return _term(e, resolve)
    c = [compile(a, resolve) for a in args]
    if name in ("=", "!=", ">", ">=", "<", "<=", "IN", "NOTIN", "SAMETERM"):
        if not all(comparable(kind(args[0]), kind(a)) for a in args[1:]):
            return F.lit(None).cast("boolean")
        c = _aligned(args, c)
    match name:
        case "=" | "SAMETERM":
            return c[0] == c[1]
        case "!=":
            return c[0] != c[1]
        case ">":
            return c[0] > c[1]
        case ">=":
            return c[0] >= c[1]
        case "<":
            return c[0] < c[1]
        case "<=":
            return c[0] <= c[1]
        case "IN":
            return c[0].isin(c[1:]) if c[1:] else F.lit(False)
        case "NOTIN":
            # An empty list matches all that have a value.
            return ~c[0].isin(c[1:]) if c[1:] else F.when(c[0].isNotNull(), F.lit(True))
        case "AND" | "OR":
            out = c[0]
            for x in c[1:]:
                out = out & x if name == "AND" else out | x
            return out
        case "NOT":
            return ~c[0]
        case "BOUND":
            return c[0].isNotNull()
        case "COALESCE":
            return F.coalesce(*c)
        case "IF":
            return F.when(c[0].isNull(), None).when(c[0], c[1]).otherwise(c[2])
        case "+":
            return F.try_add(c[0], c[1])
        case "-":
            return F.try_subtract(c[0], c[1])
        case "*":
            return F.try_multiply(c[0], c[1])
        case "/":
            return F.try_divide(c[0], c[1])
        case "POWER":
            out = c[0]
            for _ in range(args[1].value - 1):
                out = F.try_multiply(out, c[0])
            return out
        case "ABS":
            return F.abs(c[0])
        case "ROUND":
            return F.floor(c[0] + F.lit(0.5)).cast("double")  # halves go up
        case "CEIL":
            return F.ceil(c[0]).cast("double")
        case "FLOOR":
            return F.floor(c[0]).cast("double")
        case "RAND":
            return F.rand()
        case "CONCAT":
            return F.concat(*(x.cast("string") for x in c))
        case "CONTAINS":
            return F.contains(c[0], c[1])
        case "STRSTARTS":
            return F.startswith(c[0], c[1])
        case "STRENDS":
            return F.endswith(c[0], c[1])
        case "SUBSTR":
            # Positions below 1 count towards the length but hold nothing.
            start = c[1].cast("int")
            if len(c) == 2:
                return F.substr(c[0], F.greatest(start, F.lit(1)))
            end = start + c[2].cast("int")
            first = F.greatest(start, F.lit(1))
            return F.substr(c[0], first, F.greatest(end - first, F.lit(0)))
        case "STRBEFORE":
            at = F.position(c[1], c[0])
            return F.when(at > 0, F.substr(c[0], F.lit(1), at - 1)).when(at == 0, F.lit(""))
        case "STRAFTER":
            at = F.position(c[1], c[0])
            return F.when(at > 0, F.substr(c[0], at + F.char_length(c[1]))).when(at == 0, F.lit(""))
        case "REPLACE":
            flags = _flagged(c[1], args[3].value if len(args) > 3 else "")
            return F.regexp_replace(c[0], F.concat(F.lit(flags), c[1]), c[2])
        case "REGEX":
            flags = _flagged(c[1], args[2].value if len(args) > 2 else "")
            return F.regexp_like(c[0], F.concat(F.lit(flags), c[1]))
        case "UCASE":
            return F.upper(c[0])
        case "LCASE":
            return F.lower(c[0])
        case "STRLEN":
            return F.char_length(c[0]).cast("bigint")
        case "ENCODE_FOR_URI":
            out = F.url_encode(c[0])
            for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
                out = F.replace(out, F.lit(a), F.lit(b))
            return out
        case "LANGMATCHES":
            return F.when(c[1] == "*", c[0] != "").otherwise((F.lower(c[0]) == F.lower(c[1])) | F.startswith(F.lower(c[0]), F.concat(F.lower(c[1]), F.lit("-"))))
        case "YEAR" | "MONTH" | "DAY" | "HOURS" | "MINUTES":
            return {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOURS": F.hour, "MINUTES": F.minute}[name](c[0]).cast("bigint")
        case "SECONDS":
            return F.extract(F.lit("SECOND"), c[0].cast("timestamp")).cast("double")
        case "TIMEZONE":
            return F.when(c[0].isNotNull(), F.lit("PT0S"))
        case "TZ":
            return F.when(c[0].isNotNull(), F.lit("Z"))
        case "NOW":
            return F.current_timestamp()
        case "STR" | "IRI" | "URI":
            return _lexical(args[0], c[0])
        case "STRDT" | "STRLANG":
            return c[0]
        case "MD5":
            return F.md5(c[0].cast("binary"))
        case "SHA1":
            return F.sha1(c[0].cast("binary"))
        case "SHA256" | "SHA384" | "SHA512":
            return F.sha2(c[0].cast("binary"), int(name[3:]))
        case "UUID":
            return F.concat(F.lit("urn:uuid:"), F.uuid())
        case "STRUUID":
            return F.uuid()
        case "BNODE":
            return F.concat(F.lit("_:"), c[0] if c else F.uuid())
    raise QueryError(f"unknown function {name!r}")


def _lexical(e: Expr, c: Column) -> Column:
    if kind(e) == "dateTime":
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return c.cast("string")


def _term(e: Call, resolve: Resolve) -> Column:
    """Tests of what kind a term is: known from declared types, and for nodes from their ids."""
    arg = e.args[0]
    c, what = compile(arg, resolve), kind(arg)
    blank = F.startswith(c.cast("string"), F.lit("_:"))
    test = {
        "ISIRI": ~blank if what == "iri" else F.lit(False),
        "ISURI": ~blank if what == "iri" else F.lit(False),
        "ISBLANK": blank if what == "iri" else F.lit(False),
        "ISLITERAL": F.lit(what != "iri"),
        "ISNUMERIC": F.lit(what == "number"),
        "LANG": F.lit(None if what == "iri" else "").cast("string"),
    }
    if e.name == "DATATYPE":
        declared = arg.prop.datatype if isinstance(arg, Path) and arg.prop is not None and not arg.prop.is_relation else {"number": "double"}.get(what, what)
        test["DATATYPE"] = F.lit(None if what in (None, "iri") else "http://www.w3.org/2001/XMLSchema#" + (declared or "string"))
    return F.when(c.isNotNull(), test[e.name])


def conjuncts(e: Expr | None) -> list[Expr]:
    if e is None:
        return []
    if isinstance(e, Call) and e.name == "AND":
        return [x for a in e.args for x in conjuncts(a)]
    return [e]


def has_aggregate(e: Expr) -> bool:
    if isinstance(e, Agg):
        return True
    return isinstance(e, Call) and any(map(has_aggregate, e.args))


def has_quantifier(e: Expr) -> bool:
    if isinstance(e, Quant):
        return True
    return isinstance(e, Call) and any(map(has_quantifier, e.args))
