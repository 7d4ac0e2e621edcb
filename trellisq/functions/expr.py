"""Expressions as data, with a fluent interface.

Reference names in camelCase work beside snake_case ones (``startsWith``, ``starts_with``);
``and``, ``or`` and ``not`` are written ``and_``, ``or_``, ``not_`` or as ``&``, ``|`` and ``~``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime
from typing import Any

from ..shapes import DEFAULT, Property, Shape, ShapeError


class QueryError(ValueError):
    pass


#: Functions by name with the least and most arguments; nothing else can be called.
FUNCTIONS = {
    "+": (2, 2), "-": (2, 2), "*": (2, 2), "/": (2, 2), "=": (2, 2), "!=": (2, 2), ">": (2, 2), ">=": (2, 2), "<": (2, 2), "<=": (2, 2),
    "AND": (2, 99), "OR": (2, 99), "NOT": (1, 1), "IN": (1, 9999), "NOTIN": (1, 9999),
    "ABS": (1, 1), "ROUND": (1, 1), "CEIL": (1, 1), "FLOOR": (1, 1), "POWER": (2, 2), "RAND": (0, 0),
    "CONCAT": (1, 99), "CONTAINS": (2, 2), "STRSTARTS": (2, 2), "STRENDS": (2, 2), "SUBSTR": (2, 3), "STRBEFORE": (2, 2), "STRAFTER": (2, 2),
    "REPLACE": (3, 4), "REGEX": (2, 3), "UCASE": (1, 1), "LCASE": (1, 1), "STRLEN": (1, 1), "ENCODE_FOR_URI": (1, 1), "LANGMATCHES": (2, 2),
    "YEAR": (1, 1), "MONTH": (1, 1), "DAY": (1, 1), "HOURS": (1, 1), "MINUTES": (1, 1), "SECONDS": (1, 1), "TIMEZONE": (1, 1), "TZ": (1, 1), "NOW": (0, 0),
    "BOUND": (1, 1), "COALESCE": (1, 99), "IF": (3, 3), "LANG": (1, 1), "DATATYPE": (1, 1), "STR": (1, 1), "IRI": (1, 1), "URI": (1, 1),
    "ISIRI": (1, 1), "ISURI": (1, 1), "ISLITERAL": (1, 1), "ISBLANK": (1, 1), "ISNUMERIC": (1, 1), "SAMETERM": (2, 2), "STRDT": (2, 2), "STRLANG": (2, 2),
    "MD5": (1, 1), "SHA1": (1, 1), "SHA256": (1, 1), "SHA384": (1, 1), "SHA512": (1, 1), "UUID": (0, 0), "STRUUID": (0, 0), "BNODE": (0, 1),
}
AGGREGATES = ("COUNT", "MIN", "MAX", "SUM", "AVG", "SAMPLE", "GROUP_CONCAT")


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m[1].lower(), name)


def wrap(value: Any) -> Expr:
    if isinstance(value, Expr):
        return value
    if isinstance(value, dict):
        if set(value) == {"id"}:
            return Node(value["id"])
        raise QueryError(f"not a value: {value!r}")
    if value is None or isinstance(value, str | int | float | bool | date | datetime):
        return Lit(value)
    raise QueryError(f"not a value: {value!r}")


class Expr:
    """Base of all expressions; comparisons and functions make new ones."""

    def __getattr__(self, name: str):
        other = snake(name)
        if name.startswith("_") or other == name:
            raise AttributeError(name)
        return getattr(self, other)

    __hash__ = object.__hash__

    # Comparison
    def eq(self, x): return Call.of("=", self, x)
    def neq(self, x): return Call.of("!=", self, x)
    def gt(self, x): return Call.of(">", self, x)
    def gte(self, x): return Call.of(">=", self, x)
    def lt(self, x): return Call.of("<", self, x)
    def lte(self, x): return Call.of("<=", self, x)
    equals, not_equals, greater_than, greater_than_or_equal, less_than, less_than_or_equal = eq, neq, gt, gte, lt, lte
    __gt__, __ge__, __lt__, __le__ = gt, gte, lt, lte
    def __eq__(self, x): return self.eq(x)  # type: ignore[override]
    def __ne__(self, x): return self.neq(x)  # type: ignore[override]
    def one_of(self, xs): return Call.of("IN", self, *xs)
    def not_one_of(self, xs): return Call.of("NOTIN", self, *xs)

    # Logic
    def and_(self, x): return Call.of("AND", self, x)
    def or_(self, x): return Call.of("OR", self, x)
    def not_(self): return Call.of("NOT", self)
    __and__, __or__, __invert__ = and_, or_, not_
    def __bool__(self): raise QueryError("an expression has no truth value here; use & | ~")
    def is_defined(self): return Call.of("BOUND", self)
    def is_not_defined(self): return Call.of("BOUND", self).not_()
    def default_to(self, x): return Call.of("COALESCE", self, x)

    # Numbers
    def plus(self, x): return Call.of("+", self, x)
    def minus(self, x): return Call.of("-", self, x)
    def times(self, x): return Call.of("*", self, x)
    def divide(self, x): return Call.of("/", self, x)
    __add__, __sub__, __mul__, __truediv__ = plus, minus, times, divide
    def abs(self): return Call.of("ABS", self)
    def round(self): return Call.of("ROUND", self)
    def ceil(self): return Call.of("CEIL", self)
    def floor(self): return Call.of("FLOOR", self)

    def power(self, n: int):
        if not isinstance(n, int) or isinstance(n, bool) or not 1 <= n <= 20:
            raise QueryError("power takes a whole number from 1 to 20")
        return Call.of("POWER", self, n)

    # Text
    def concat(self, *xs): return Call.of("CONCAT", self, *xs)
    def contains(self, x): return Call.of("CONTAINS", self, x)
    def starts_with(self, x): return Call.of("STRSTARTS", self, x)
    def ends_with(self, x): return Call.of("STRENDS", self, x)
    def substr(self, start, length=None): return Call.of("SUBSTR", self, start, *([] if length is None else [length]))
    def before(self, x): return Call.of("STRBEFORE", self, x)
    def after(self, x): return Call.of("STRAFTER", self, x)
    def replace(self, pattern, by, flags=""): return Call.of("REPLACE", self, pattern, by, *([flags] if flags else []))
    def matches(self, pattern, flags=""): return Call.of("REGEX", self, pattern, *([flags] if flags else []))
    def ucase(self): return Call.of("UCASE", self)
    def lcase(self): return Call.of("LCASE", self)
    def strlen(self): return Call.of("STRLEN", self)
    def encode_for_uri(self): return Call.of("ENCODE_FOR_URI", self)

    # Dates
    def year(self): return Call.of("YEAR", self)
    def month(self): return Call.of("MONTH", self)
    def day(self): return Call.of("DAY", self)
    def hours(self): return Call.of("HOURS", self)
    def minutes(self): return Call.of("MINUTES", self)
    def seconds(self): return Call.of("SECONDS", self)
    def timezone(self): return Call.of("TIMEZONE", self)
    def tz(self): return Call.of("TZ", self)

    # Terms and hashes
    def str(self): return Call.of("STR", self)
    def iri(self): return Call.of("IRI", self)
    def lang(self): return Call.of("LANG", self)
    def datatype(self): return Call.of("DATATYPE", self)
    def is_iri(self): return Call.of("ISIRI", self)
    def is_literal(self): return Call.of("ISLITERAL", self)
    def is_blank(self): return Call.of("ISBLANK", self)
    def is_numeric(self): return Call.of("ISNUMERIC", self)
    def md5(self): return Call.of("MD5", self)
    def sha256(self): return Call.of("SHA256", self)
    def sha512(self): return Call.of("SHA512", self)

    # Aggregates; a count is of distinct values
    def count_distinct(self): return Agg("COUNT", self)
    def min(self): return Agg("MIN", self)
    def max(self): return Agg("MAX", self)
    def sum(self): return Agg("SUM", self)
    def avg(self): return Agg("AVG", self)


@dataclass(frozen=True, eq=False)
class Lit(Expr):
    value: Any


@dataclass(frozen=True, eq=False)
class Node(Expr):
    id: Any


@dataclass(frozen=True, eq=False)
class Ctx(Expr):
    """A value of the query context, resolved when the query runs; path: labels from it."""

    key: str
    steps: tuple = ()
    shape: Shape | None = None
    start: Shape | None = None

    def __getattr__(self, name: str):
        shape = object.__getattribute__(self, "shape")
        if shape is not None and not name.startswith("_") and (p := shape.find(name)):
            return Ctx(self.key, (*self.steps, name), shape.value_shape(p), self.start or shape)
        return super().__getattr__(name)


@dataclass(frozen=True, eq=False)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]

    @staticmethod
    def of(name: str, *args) -> Call:
        if name not in FUNCTIONS:
            raise QueryError(f"unknown function {name!r}")
        least, most = FUNCTIONS[name]
        if not least <= len(args) <= most:
            raise QueryError(f"{name} takes {least} to {most} arguments")
        if name in ("REPLACE", "REGEX") and len(args) == FUNCTIONS[name][1]:
            flags = args[-1].value if isinstance(args[-1], Lit) else args[-1]
            if not isinstance(flags, str) or not set(flags) <= set("ims"):
                raise QueryError(f"flags may be i, m and s, not {flags!r}")
        return Call(name, tuple(map(wrap, args)))


@dataclass(frozen=True, eq=False)
class Agg(Expr):
    name: str
    arg: Expr


@dataclass(frozen=True, eq=False)
class Quant(Expr):
    """some, every or none of the nodes at the end of a path."""

    kind: str
    path: Path
    scope: Scope
    body: Expr

    def not_(self):
        return Quant("none" if self.kind == "some" else "some", self.path, self.scope, self.body) if self.kind != "every" else Call.of("NOT", self)

    __invert__ = not_


@dataclass(frozen=True, eq=False)
class Scope:
    """What paths start from: the root of a query, or the member of a quantifier or filter."""

    shape: Shape | None


@dataclass(frozen=True)
class Step:
    label: str
    cast: str | None = None
    scope: Scope | None = None
    where: Expr | None = field(default=None)

    @property
    def key(self) -> tuple:
        return self.label, id(self.where) if self.where is not None else None


@dataclass(frozen=True, eq=False)
class Path(Expr):
    """A traced path: attributes named like properties go on, others are methods."""

    scope: Scope
    steps: tuple[Step, ...]
    shape: Shape | None
    prop: Property | None = None

    def __getattr__(self, name: str):
        shape = object.__getattribute__(self, "shape")
        if not name.startswith("_") and shape is not None and shape.find(name) is not None:
            return self._to(name)
        return super().__getattr__(name)

    def __getattribute__(self, name: str):
        # A property named like a method (``count``, ``min``) is still the property.
        if not name.startswith("_") and name not in ("scope", "steps", "shape", "prop"):
            shape = object.__getattribute__(self, "shape")
            if shape is not None and name in shape.properties:
                return object.__getattribute__(self, "_to")(name)
        return object.__getattribute__(self, name)

    def _to(self, label: str) -> Path:
        shape = object.__getattribute__(self, "shape")
        if shape is None:
            if label != "$type":
                raise QueryError(f"nothing is known of what {label!r} is read from")
            from ..shapes import TYPE as p
        else:
            try:
                p = shape.property(label)
            except ShapeError as e:
                raise QueryError(str(e)) from None
        to = shape.value_shape(p) if shape is not None else None
        return Path(self.scope, (*self.steps, Step(label)), to, p)

    def type_(self):
        return self._to("$type")

    def as_(self, shape: Shape | str):
        if not self.steps:
            raise QueryError("only a relation can be cast")
        shape = (self.scope.shape.catalog if self.scope.shape and self.scope.shape.catalog else DEFAULT).shape(shape)
        last = self.steps[-1]
        return Path(self.scope, (*self.steps[:-1], Step(last.label, shape.name, last.scope, last.where)), shape, self.prop)

    def where(self, condition: Callable) -> Path:
        if not self.steps or self.steps[-1].where is not None:
            raise QueryError("a path takes one filter on its last step")
        scope = Scope(self.shape)
        body = wrap(condition(Path(scope, (), self.shape, self.prop)))
        last = self.steps[-1]
        return Path(self.scope, (*self.steps[:-1], Step(last.label, last.cast, scope, body)), self.shape, self.prop)

    def _quantified(self, kind: str, condition: Callable) -> Quant:
        scope = Scope(self.shape)
        return Quant(kind, self, scope, wrap(condition(Path(scope, (), self.shape, self.prop))))

    def some(self, condition): return self._quantified("some", condition)
    def every(self, condition): return self._quantified("every", condition)
    def none(self, condition): return self._quantified("none", condition)

    def size(self): return Agg("COUNT", self)

    def eq(self, x):
        if self.steps and self.prop is not None and self.prop.is_relation and not self.prop.single:
            # A set of nodes equals a node if some of them does.
            return self.some(lambda m: Call.of("=", m, x))
        return Call.of("=", self, x)

    equals = eq
    def __eq__(self, x): return self.eq(x)  # type: ignore[override]
    __hash__ = object.__hash__

    def select(self, fields=None):
        from ..plans.query import SubSelect

        return SubSelect.of(self, fields)

    def select_all(self):
        from ..plans.query import SubSelect

        return SubSelect.of(self, list(self.shape.properties))

    def preload_for(self, component):
        """The fields of a component (anything with ``query`` or ``fields``) as a nested selection."""
        from ..plans.query import SubSelect, fields_of_component

        return SubSelect(self, fields_of_component(component, self))

    def limit(self, n):
        raise QueryError("a limit needs a nested selection: path.select(...).limit(n)")

    def labels(self) -> tuple[str, ...]:
        return tuple(s.label for s in self.steps)


class E:
    """Functions that start an expression."""

    now = staticmethod(lambda: Call.of("NOW"))
    not_ = staticmethod(lambda x: wrap(x).not_())
    count = staticmethod(lambda: Agg("COUNT", Node(None)))

    @staticmethod
    def concat(*xs):
        if len(xs) < 2:
            raise QueryError("concat takes two parts at least")
        return Call.of("CONCAT", *xs)

    @staticmethod
    def first_defined(*xs):
        if len(xs) < 2:
            raise QueryError("first_defined takes two values at least")
        return Call.of("COALESCE", *xs)

    @staticmethod
    def if_then(condition, then, otherwise):
        return Call.of("IF", condition, then, otherwise)

    firstDefined, ifThen = first_defined, if_then


def walk(e: Expr):
    """e and everything in it, quantifier bodies and step filters not included."""
    yield e
    if isinstance(e, Call):
        for a in e.args:
            yield from walk(a)
    elif isinstance(e, Agg):
        yield from walk(e.arg)
