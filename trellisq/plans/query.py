"""Queries as immutable builders: select, grouped select, count, ask, field sets and triples reads."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from ..functions.compile import has_aggregate
from ..functions.expr import Agg, Ctx, Expr, Node, Path, QueryError, Scope, Step, snake, wrap
from ..shapes import DEFAULT, Shape


@dataclass(frozen=True, eq=False)
class SubSelect:
    """Fields of the nodes at the end of a path; order, limit and offset are per parent."""

    path: Path
    fields: list
    order: tuple = ()
    limit_: int | None = None
    offset_: int | None = None

    @staticmethod
    def of(path: Path, fields) -> SubSelect:
        scope = Scope(path.shape)
        inner = Path(scope, (), path.shape, path.prop)
        return SubSelect(path, named(inner, fields))

    def order_by(self, key: Callable, direction: str = "ASC") -> SubSelect:
        return replace(self, order=(*self.order, (wrap(key(Path(Scope(self.path.shape), (), self.path.shape))), direction.upper())))

    def limit(self, n: int) -> SubSelect:
        return replace(self, limit_=n)

    def offset(self, n: int) -> SubSelect:
        return replace(self, offset_=n)

    orderBy = sortBy = order_by


@dataclass(frozen=True, eq=False)
class Field:
    """A named thing to return: a path, a nested selection, or an expression."""

    name: str
    what: Any
    custom: bool = False


def traced(root: Path, label: str) -> Path:
    """A dotted path of labels from a root; ``as(Shape)`` narrows."""
    out = root
    for part in label.split("."):
        if part.startswith("as(") and part.endswith(")"):
            out = out.as_(part[3:-1])
        else:
            out = object.__getattribute__(out, "_to")(part)
    return out


def call_name(e: Expr) -> str:
    if isinstance(e, Agg):
        base = ".".join(e.arg.labels()) if isinstance(e.arg, Path) else "value"
        return f"{base}_{'size' if e.name == 'COUNT' else e.name.lower()}"
    first = next((a for a in getattr(e, "args", ()) if isinstance(a, Path)), None)
    return f"{'_'.join(first.labels()) if first is not None else 'value'}_{getattr(e, 'name', 'expr').lower()}"


def named(root: Path, fields) -> list[Field]:
    """Fields from whatever a select was given: a function of the root, a list, a mapping, labels, or field sets."""
    if callable(fields) and not isinstance(fields, Expr | FieldSet | SubSelect):
        fields = fields(root)
    if fields is None:
        return []
    if isinstance(fields, FieldSet):
        return fields.of(root)
    if isinstance(fields, dict):
        out = []
        for name, value in fields.items():
            value = traced(root, value) if isinstance(value, str) else value
            out.append(Field(name, value if isinstance(value, SubSelect) else wrap(value), True))
        return _unique(out)
    if isinstance(fields, str | Expr | SubSelect) or not isinstance(fields, Iterable):
        fields = [fields]
    out = []
    for f in fields:
        if isinstance(f, str):
            f = traced(root, f)
        if isinstance(f, dict | FieldSet):
            out += named(root, f)
        elif isinstance(f, SubSelect):
            out.append(Field(f.path.labels()[-1], f))
        elif isinstance(f, Path):
            out.append(Field(f.labels()[-1] if f.labels() else "id", f))
        else:
            name, k = call_name(wrap(f)), 1
            while any(x.name == name for x in out):
                k += 1
                name = f"{call_name(wrap(f))}_{k}"
            out.append(Field(name, wrap(f)))
    return _unique(out)


def _unique(fields: list[Field]) -> list[Field]:
    seen = [f.name for f in fields if f.custom]
    if len(set(seen)) < len(seen):
        raise QueryError("two fields have one name")
    return fields


def fields_of_component(component, path: Path) -> list[Field]:
    what = component if isinstance(component, Select) else getattr(component, "query", None) or getattr(component, "fields", None) or component
    inner = Path(Scope(path.shape), (), path.shape, path.prop)
    if isinstance(what, Select):
        return rescoped(what.fields, what.root, inner)
    return named(inner, what)


def rescoped(fields: list[Field], old: Path, new: Path) -> list[Field]:
    """The fields read from another root, by their labels."""

    def move(e):
        if isinstance(e, SubSelect):
            return replace(e, path=move(e.path))
        if isinstance(e, Path):
            return Path(new.scope, e.steps, e.shape, e.prop) if e.scope is old.scope else e
        if isinstance(e, Agg):
            return Agg(e.name, move(e.arg))
        if hasattr(e, "args"):
            return replace(e, args=tuple(map(move, e.args)))
        return e

    return [Field(f.name, move(f.what), f.custom) for f in fields]


class FieldSet:
    """A reusable list of labels (dotted), with set operations."""

    def __init__(self, shape: Shape, entries: Iterable = ()):
        self.shape, self.entries = shape, tuple(entries)

    @staticmethod
    def for_(shape: Shape, entries) -> FieldSet:
        return FieldSet(shape, entries if not isinstance(entries, str) else [entries])

    @staticmethod
    def all(shape: Shape, depth: int = 1) -> FieldSet:
        out = []
        for label, p in shape.properties.items():
            to = shape.value_shape(p)
            out += [f"{label}.{x}" for x in FieldSet.all(to, depth - 1).entries] if depth > 1 and to is not None else [label]
        return FieldSet(shape, out)

    def merge(self, *others: FieldSet) -> FieldSet:
        return FieldSet(self.shape, dict.fromkeys([*self.entries, *(e for o in others for e in o.entries)]))

    def select(self, entries) -> FieldSet:
        return self.merge(FieldSet(self.shape, entries))

    def add(self, *entries: str) -> FieldSet:
        return self.merge(FieldSet(self.shape, entries))

    def remove(self, *labels: str) -> FieldSet:
        return FieldSet(self.shape, [e for e in self.entries if e not in labels])

    def set(self, entries) -> FieldSet:
        return FieldSet(self.shape, entries)

    def pick(self, *labels: str) -> FieldSet:
        return FieldSet(self.shape, [e for e in self.entries if e in labels])

    def paths(self) -> list[str]:
        return [str(e) for e in self.entries]

    labels = paths

    def of(self, root: Path) -> list[Field]:
        return named(root, list(self.entries))

    def to_json(self) -> dict:
        return {"shape": self.shape.iri, "fields": list(self.entries)}

    @staticmethod
    def from_json(data: dict, catalog=DEFAULT) -> FieldSet:
        return FieldSet(catalog.shape(data["shape"]), data["fields"])


@dataclass(eq=False)
class Select:
    """A query for nodes of a shape. Each call returns a changed copy."""

    shape: Shape
    fields: list[Field] = field(default_factory=list)
    condition: Expr | None = None
    minuses: tuple = ()
    order: tuple = ()
    limit_: int | None = None
    offset_: int | None = None
    subject: Any = None
    subjects: tuple | None = None
    null_subject: bool = False
    one_: bool = False
    graphs: tuple[str, ...] | None = None
    kind: str = "select"
    keys: tuple[str, ...] | None = None
    havings: tuple = ()
    group_order: tuple = ()
    tx_id: str | None = None

    def __post_init__(self):
        self.root = Path(Scope(self.shape), (), self.shape)

    def __getattr__(self, name: str):
        other = snake(name)
        if name.startswith("_") or other == name:
            raise AttributeError(name)
        return getattr(self, other)

    def _with(self, **changes) -> Select:
        out = copy.copy(self)
        out.__dict__.update(changes)
        return out

    def select(self, fields=None) -> Select:
        return self._with(fields=named(self.root, fields))

    def select_all(self) -> Select:
        return self._with(fields=named(self.root, list(self.shape.properties)))

    def where(self, condition: Callable) -> Select:
        """Replaces an earlier condition."""
        return self._with(condition=wrap(condition(self.root)))

    def minus(self, what: Shape | Callable) -> Select:
        if isinstance(what, Shape):
            return self._with(minuses=(*self.minuses, ("shape", what)))
        got = what(self.root)
        paths = got if isinstance(got, list | tuple) else [got]
        if all(isinstance(p, Path) for p in paths):
            return self._with(minuses=(*self.minuses, ("paths", tuple(paths))))
        return self._with(minuses=(*self.minuses, ("condition", wrap(got))))

    def order_by(self, key: Callable, direction: str = "ASC") -> Select:
        got = key(self.root)
        keys = tuple((wrap(k), direction.upper()) for k in (got if isinstance(got, list | tuple) else [got]))
        if direction.upper() not in ("ASC", "DESC"):
            raise QueryError("a direction is ASC or DESC")
        if any(has_aggregate(k) for k, _ in keys):
            raise QueryError("rows cannot be ordered by an aggregate")
        return self._with(order=keys)

    sort_by = order_by

    def limit(self, n: int) -> Select:
        return self._with(limit_=_count(n))

    def offset(self, n: int) -> Select:
        return self._with(offset_=_count(n))

    def for_(self, node) -> Select:
        if node is None:
            return self._with(null_subject=True)
        return self._with(subject=node if isinstance(node, Ctx) else id_of(node))

    by_id = for_

    def for_all(self, nodes) -> Select:
        return self._with(subjects=tuple(id_of(n) for n in nodes))

    def one(self) -> Select:
        return self._with(one_=True, limit_=1)

    def from_(self, *graphs: str) -> Select:
        return self._with(graphs=graphs or None)

    def count(self) -> Select:
        return self._with(kind="count", fields=[], order=(), limit_=None, offset_=None)

    def exists(self) -> Select:
        return self._with(kind="ask", fields=[], order=(), limit_=None, offset_=None)

    def preload(self, label: str, component) -> Select:
        path = traced(self.root, label)
        return self._with(fields=[*self.fields, Field(label.split(".")[-1], SubSelect(path, fields_of_component(component, path)))])

    def group_by(self, *keys: str) -> Select:
        """Rows become groups, named by the key fields; every other field has to be an aggregate."""
        if self.order or self.subject is not None or self.one_ or self.null_subject:
            raise QueryError("a grouped select has no order, subject or one() from before")
        if not all(f.custom for f in self.fields):
            raise QueryError("every field of a grouped select needs a name")
        names = {f.name: f for f in self.fields}
        for k in keys:
            if k not in names or not isinstance(names[k].what, Path):
                raise QueryError(f"{k!r} is no key: keys are fields that are paths")
        for f in self.fields:
            if f.name not in keys and not (isinstance(f.what, Expr) and has_aggregate(f.what)):
                raise QueryError(f"{f.name!r} is neither a key nor an aggregate")
        return self._with(keys=keys)

    def having(self, name: str, condition: Callable) -> Select:
        f = next((f for f in self.fields if f.name == name), None)
        if self.keys is None or f is None:
            raise QueryError(f"{name!r} is no field of a grouped select")
        return self._with(havings=(*self.havings, wrap(condition(f.what))))

    def group_order_by(self, name: str, direction: str = "ASC") -> Select:
        if self.keys is None or name not in {f.name for f in self.fields}:
            raise QueryError(f"{name!r} is no field of a grouped select")
        return self._with(group_order=(*self.group_order, (name, direction.upper())))

    # Running
    def df(self, source, context: dict | None = None):
        from .planner import Planner

        return Planner(source, context).frame(self)

    def run(self, source, context: dict | None = None):
        """Rows as dictionaries; one row or None for a single subject; a number or truth value for count and exists."""
        from .planner import Planner

        return Planner(source, context).run(self)

    def to_json(self) -> dict:
        from .wire import select_to_json

        return select_to_json(self)


def _count(n: int) -> int:
    if not isinstance(n, int) or isinstance(n, bool) or n < 0:
        raise QueryError("limit and offset take whole numbers from 0 on")
    return n


def id_of(node) -> Any:
    if isinstance(node, dict):
        return node["id"]
    return node.id if isinstance(node, Node) else node


@dataclass(frozen=True)
class Triples:
    """A read of plain triples: fixed positions, graphs, and a limit."""

    subject: str | None = None
    predicate: str | None = None
    object: str | None = None
    graphs: tuple[str, ...] | None = None
    limit_: int | None = None
    objects: tuple[str, ...] | None = None
    predicates: tuple[str, ...] | None = None

    def for_node(self, id_: str) -> Triples: return replace(self, subject=id_)
    def to_node(self, id_) -> Triples: return replace(self, objects=tuple(id_)) if isinstance(id_, list | tuple) else replace(self, object=id_)
    def with_predicate(self, id_) -> Triples: return replace(self, predicates=tuple(id_)) if isinstance(id_, list | tuple) else replace(self, predicate=id_)
    def from_(self, *graphs: str) -> Triples: return replace(self, graphs=graphs)
    def limit(self, n: int) -> Triples: return replace(self, limit_=_count(n))

    def _checked(self):
        if self.subject and self.predicate and self.object:
            raise QueryError("a triples read leaves a position open")
        if not (self.subject or self.object or self.objects or self.graphs):
            raise QueryError("a triples read needs a node or graphs")
        return self

    def df(self, source):
        """(subject, predicate, object, object_kind, datatype, language, graph), in no order."""
        from pyspark.sql import functions as F

        self._checked()
        q = source.scoped(self.graphs)
        for column, value in (("s", self.subject), ("p", self.predicate)):
            q = q if value is None else q.where(F.col(column) == value)
        if self.object:
            q = q.where((F.col("o_kind") != "literal") & (F.col("o_value") == self.object))
        out = q.select(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o_value").alias("object"), F.col("o_kind").alias("object_kind"), F.col("o_datatype").alias("datatype"), F.col("o_lang").alias("language"), F.col("g").alias("graph"))
        return out if self.limit_ is None else out.limit(self.limit_)

    def which_exist(self, source):
        """(term): those of the listed objects or predicates that occur."""
        from pyspark.sql import functions as F

        if (self.objects is None) == (self.predicates is None):
            raise QueryError("list either objects or predicates")
        column, terms = ("o_value", self.objects) if self.objects is not None else ("p", self.predicates)
        rest = replace(self, objects=None, predicates=None)
        q = source.scoped(self.graphs)
        for c, value in (("s", rest.subject), ("p", rest.predicate)):
            q = q if value is None else q.where(F.col(c) == value)
        if column == "o_value":
            q = q.where("o_kind <> 'literal'")
        listed = source.spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")
        return listed.join(q.select(F.col(column).alias("term")), "term", "left_semi")

    whichExist, forNode, toNode, withPredicate = which_exist, for_node, to_node, with_predicate
