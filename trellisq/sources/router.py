"""Queries to sources by shape; graphs by shape."""

from __future__ import annotations

from typing import Any

from ..functions.compile import has_aggregate
from ..functions.expr import Expr, QueryError
from ..plans.query import Select, Triples
from ..shapes import DEFAULT, Catalog, Shape
from .base import Source


class Router:
    """shape name to source, with a default; shapeless reads go to all sources and are put together."""

    def __init__(self, default: Source, by_shape: dict[str, Source] | None = None, graphs: dict[str, str] | None = None, catalog: Catalog = DEFAULT):
        self.default, self.by_shape, self.graphs, self.catalog = default, dict(by_shape or {}), dict(graphs or {}), catalog

    def source(self, shape: Shape | None) -> Source:
        while shape is not None:
            if shape.name in self.by_shape:
                return self.by_shape[shape.name]
            shape = shape.extends
        return self.default

    def sources(self) -> list[Source]:
        return list(dict.fromkeys([self.default, *self.by_shape.values()]))

    def read_graphs(self, shape: Shape) -> tuple[str, ...] | None:
        """The graphs of a shape: its own, those of shapes below it and of shapes that own it."""
        if shape.name not in self.graphs:
            return None
        out = {self.graphs[s] for s in self.catalog.related(shape.name) if s in self.graphs}
        for other in self.catalog.shapes.values():
            if any(p.contains and p.shape == shape.name for p in other.own) and other.name in self.graphs:
                out.add(self.graphs[other.name])
        return tuple(sorted(out))

    @staticmethod
    def required(q: Select) -> set[str]:
        need = {"count": {"count"}, "ask": {"ask"}}.get(q.kind, set())
        if q.keys is not None:
            need = need | {"groupBy"}
        if q.graphs:
            need = need | {"graphs"}
        return need

    def run(self, q: Any, context: dict | None = None):
        if isinstance(q, Triples):
            return self.triples(q)
        if isinstance(q, Select):
            source = self.source(q.shape)
            missing = self.required(q) - source.supports
            if missing == {"ask"}:
                return q._with(kind="select", limit_=1).run(source, context) not in (None, [])
            if missing:
                raise QueryError(f"the source of {q.shape.name} cannot answer {sorted(missing)}")
            if q.kind != "select" and isinstance(q.condition, Expr) and has_aggregate(q.condition) and "aggregateWhere" in getattr(source, "refuses", ()):
                raise QueryError("this source counts no groups")
            routed = self.read_graphs(q.shape) if q.graphs is None else None
            return (q._with(graphs=routed) if routed else q).run(source, context)
        source = self.source(q.shape)
        if q.graph is None and q.shape is not None and q.shape.name in self.graphs:
            q = q._with(graph=self.graphs[q.shape.name])
        return source.apply(q, context)

    def triples(self, t: Triples):
        out = None
        for s in self.sources():
            df = t.df(s)
            out = df if out is None else out.unionByName(df)
        return out
