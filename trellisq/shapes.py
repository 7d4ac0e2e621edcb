"""Shapes: declared schemas over classes, their properties and catalogs."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from .paths import PathExpr, Ref, parse

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
SUBCLASS = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
RESERVED = {"and", "or", "not"}
#: Datatypes and the value kind that comparisons go by.
KINDS = {
    "string": "string", "boolean": "boolean", "integer": "number", "long": "number", "decimal": "number", "double": "number",
    "float": "number", "date": "date", "dateTime": "dateTime", "time": "string", "duration": "string", "gYear": "string",
}


class ShapeError(ValueError):
    pass


@dataclass(frozen=True)
class Property:
    label: str
    path: PathExpr
    datatype: str | None = None
    shape: str | None = None
    node_kind: str | None = None
    min_count: int = 0
    max_count: int | None = 1
    contains: bool = False
    one_of: tuple | None = None
    class_: str | None = None
    min_inclusive: Any = None
    max_inclusive: Any = None
    min_exclusive: Any = None
    max_exclusive: Any = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    flags: str = ""
    has_value: Any = None
    less_than: str | None = None
    less_than_or_equals: str | None = None
    equals: str | None = None
    disjoint: str | None = None
    language_in: tuple[str, ...] | None = None
    unique_lang: bool = False
    default: Any = None
    severity: str = "Violation"

    @property
    def is_relation(self) -> bool:
        return self.shape is not None or self.class_ is not None or self.node_kind in ("IRI", "BlankNode", "BlankNodeOrIRI") and self.datatype is None

    @property
    def single(self) -> bool:
        return self.max_count is not None and self.max_count <= 1

    @property
    def kind(self) -> str | None:
        return "iri" if self.is_relation else KINDS.get(self.datatype or "string", "string")


def literal(label: str, path: str | PathExpr | None = None, datatype: str = "string", *, many: bool = False, base: str = "", **constraints) -> Property:
    constraints.setdefault("max_count", None if many else 1)
    return Property(label, parse(path or label, base=base), datatype=datatype, **constraints)


def relation(label: str, path: str | PathExpr | None = None, shape: str | None = None, *, many: bool = True, base: str = "", **constraints) -> Property:
    constraints.setdefault("max_count", None if many else 1)
    constraints.setdefault("node_kind", "IRI")
    return Property(label, parse(path or label, base=base), shape=shape, **constraints)


TYPE = Property("$type", Ref(RDF_TYPE), node_kind="IRI", max_count=None)


@dataclass(eq=False)
class Shape:
    """A node shape; queries start from it (``Person.select(lambda p: p.name)``)."""

    name: str
    target_class: str | None = None
    own: list[Property] = field(default_factory=list)
    extends: Shape | None = None
    iri: str = ""
    closed: bool = False
    deactivated: bool = False
    severity: str = "Violation"
    default_read_graphs: tuple[str, ...] | None = None
    catalog: Catalog | None = None

    def __post_init__(self):
        self.iri = self.iri or f"urn:shape:{self.name}"
        for p in self.own:
            if p.label.startswith("$") or p.label in RESERVED:
                raise ShapeError(f"{p.label!r} cannot be a property label")
            self._tightens(p)
        (self.catalog or DEFAULT).register(self)

    def _tightens(self, p: Property) -> None:
        """An override of an inherited property may only be stricter."""
        old = self.extends.find(p.label) if self.extends else None
        if old is None:
            return
        if old.max_count is not None and (p.max_count is None or p.max_count > old.max_count):
            raise ShapeError(f"{self.name}.{p.label} loosens maxCount")
        if p.min_count < old.min_count:
            raise ShapeError(f"{self.name}.{p.label} loosens minCount")
        if old.datatype != p.datatype and old.datatype is not None:
            raise ShapeError(f"{self.name}.{p.label} changes the datatype")

    @property
    def properties(self) -> dict[str, Property]:
        """By label; a shape's own go before inherited ones."""
        out = dict(self.extends.properties) if self.extends else {}
        return out | {p.label: p for p in self.own}

    def find(self, label: str) -> Property | None:
        return TYPE if label == "$type" else self.properties.get(label)

    def property(self, label: str) -> Property:
        found = self.find(label)
        if found is None:
            raise ShapeError(f"{self.name} has no property {label!r}")
        return found

    def target(self) -> str:
        shape = self
        while shape:
            if shape.target_class:
                return shape.target_class
            shape = shape.extends
        raise ShapeError(f"{self.name} has no target class")

    def value_shape(self, p: Property) -> Shape | None:
        catalog = self.catalog or DEFAULT
        if p.shape:
            return catalog.shape(p.shape)
        return catalog.by_class(p.class_) if p.class_ else None

    def __repr__(self) -> str:
        return f"Shape({self.name})"

    # Starting points of queries.
    def select(self, fields: Callable | Iterable | None = None):
        from .plans.query import Select

        return Select(self).select(fields)

    def select_all(self):
        from .plans.query import Select

        return Select(self).select_all()

    def count(self, where: Callable | None = None):
        from .plans.query import Select

        out = Select(self)
        return (out.where(where) if where else out).count()

    def create(self, data):
        from .plans.mutations import Create

        return Create(self, data)

    def update(self, data):
        from .plans.mutations import Update

        return Update(self, data)

    def upsert(self, data):
        from .plans.mutations import Upsert

        return Upsert(self, data)

    def delete(self, ids):
        from .plans.mutations import Delete

        return Delete(self, ids if isinstance(ids, list | tuple) else [ids])

    def delete_all(self):
        from .plans.mutations import Delete

        return Delete(self, mode="all")

    def delete_where(self, condition):
        from .plans.mutations import Delete

        return Delete(self, mode="where").where(condition)

    selectAll, deleteAll, deleteWhere = select_all, delete_all, delete_where


class Catalog:
    """Shapes by name, IRI and class, and the class hierarchy."""

    def __init__(self):
        self.shapes: dict[str, Shape] = {}
        self.super_classes: dict[str, set[str]] = {}
        self.version = 0

    def register(self, shape: Shape) -> None:
        if shape.name in self.shapes and self.shapes[shape.name] is not shape:
            warnings.warn(f"the shape {shape.name} is registered anew", stacklevel=3)
        self.shapes[shape.name] = shape
        self.version += 1

    def shape(self, name: str | Shape) -> Shape:
        if isinstance(name, Shape):
            return name
        if name in self.shapes:
            return self.shapes[name]
        for s in self.shapes.values():
            if s.iri == name:
                return s
        raise ShapeError(f"unknown shape {name!r}")

    def by_class(self, iri: str) -> Shape | None:
        return next((s for s in self.shapes.values() if s.target_class == iri), None)

    def declare_subclass(self, sub: str, super_: str) -> None:
        self.super_classes.setdefault(sub, set()).add(super_)
        self.version += 1

    def classes_under(self, iri: str, inference: str = "ontology") -> set[str]:
        """The class and, by the declared hierarchy (and, for ``shapes``, by what shapes extend), all classes below it."""
        if inference == "none":
            return {iri}
        links = {(a, b) for a, bs in self.super_classes.items() for b in bs}
        if inference == "shapes":
            links |= {(s.target_class, s.extends.target()) for s in self.shapes.values() if s.extends and s.target_class}
        out, new = {iri}, {iri}
        while new:
            new = {a for a, b in links if b in new} - out
            out |= new
        return out

    def related(self, name: str) -> set[str]:
        """Names of the shapes above and below a shape, itself included."""
        shape = self.shape(name)
        up, s = {shape.name}, shape.extends
        while s:
            up.add(s.name)
            s = s.extends

        def below(x: Shape) -> bool:
            while x:
                if x is shape:
                    return True
                x = x.extends
            return False

        return up | {s.name for s in self.shapes.values() if below(s)}


DEFAULT = Catalog()
