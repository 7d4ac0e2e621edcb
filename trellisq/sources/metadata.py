"""Shapes and class hierarchies as quads and Turtle, synced into named graphs; registries of graphs; sources from a configuration.

All of this is metadata: as large as a schema, so it is built on the driver and written as one small graph.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import QueryError
from ..paths import Alt, Inverse, PathExpr, Ref, Repeat, Seq
from ..plans.mutations import Store, put
from ..shapes import RDF_TYPE, XSD, Catalog, Property, Shape
from .quads import GRAPH_KIND, REGISTRY, SUBCLASS, QuadSource, quads_frame, read_ntriples
from .router import Router

#: The W3C vocabularies.
SH, RDF, OWL = "http://www.w3.org/ns/shacl#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2002/07/owl#"
GRAPH_HASH = "graph:hash"
#: Constraints of a property by their names in SHACL.
_CONSTRAINTS = {
    "min_count": "minCount", "max_count": "maxCount", "min_inclusive": "minInclusive", "max_inclusive": "maxInclusive", "min_exclusive": "minExclusive",
    "max_exclusive": "maxExclusive", "min_length": "minLength", "max_length": "maxLength", "pattern": "pattern", "flags": "flags",
}
Row = tuple[str | None, str, str, str, str, str | None, str | None]


def _iri(s: str, p: str, o: str, blank: bool = False) -> Row:
    return (None, s, p, "blank" if blank else "iri", o, None, None)


def _value(s: str, p: str, v) -> Row:
    kind = "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "double" if isinstance(v, float) else "string"
    return (None, s, p, "literal", str(v).lower() if kind == "boolean" else str(v), XSD + kind, None)


class _Blanks:
    """Blank nodes named by what they are for, so equal catalogs give equal rows."""

    def __init__(self, stem: str):
        self.stem, self.n = stem, 0

    def __call__(self) -> str:
        self.n += 1
        return f"_:{self.stem}{self.n}"


def _list(items: list[tuple[str, bool]], blank: _Blanks) -> tuple[str, list[Row]]:
    rows, after = [], (RDF + "nil", False)
    for item, is_blank in reversed(items):
        node = blank()
        rows += [_iri(node, RDF + "first", item, is_blank), _iri(node, RDF + "rest", *after)]
        after = (node, True)
    return after[0], rows


def _path(path: PathExpr, blank: _Blanks) -> tuple[str, bool, list[Row]]:
    """(node, whether it is blank, rows) of a property path."""
    match path:
        case Ref(iri):
            return iri, False, []
        case Seq(parts) | Alt(parts):
            made = [_path(p, blank) for p in parts]
            head, rows = _list([(n, b) for n, b, _ in made], blank)
            rows = [r for *_, some in made for r in some] + rows
            if isinstance(path, Seq):
                return head, True, rows
            node = blank()
            return node, True, [*rows, _iri(node, SH + "alternativePath", head, True)]
        case Inverse(part):
            name = "inversePath"
        case Repeat(part, least, bounded):
            name = "zeroOrOnePath" if bounded else "oneOrMorePath" if least else "zeroOrMorePath"
        case _:
            raise QueryError(f"SHACL has no such path: {path!r}")
    of, is_blank, rows = _path(part, blank)
    node = blank()
    return node, True, [*rows, _iri(node, SH + name, of, is_blank)]


def _property_rows(shape: Shape, p: Property, catalog: Catalog) -> Iterator[Row]:
    node = f"{shape.iri}/{p.label}"
    blank = _Blanks("".join(c if c.isalnum() else "x" for c in f"{shape.name}-{p.label}-"))
    to, is_blank, rows = _path(p.path, blank)
    yield _iri(shape.iri, SH + "property", node)
    yield _iri(node, RDF_TYPE, SH + "PropertyShape")
    yield _iri(node, SH + "path", to, is_blank)
    yield from rows
    yield _value(node, SH + "name", p.label)
    if p.is_relation:
        if p.node_kind:
            yield _iri(node, SH + "nodeKind", SH + p.node_kind)
        if p.shape:
            yield _iri(node, SH + "node", catalog.shape(p.shape).iri)
        if p.class_:
            yield _iri(node, SH + "class", p.class_)
    else:
        yield _iri(node, SH + "datatype", XSD + (p.datatype or "string"))
    for name, sh in _CONSTRAINTS.items():
        v = getattr(p, name)
        if v not in (None, "") and not (name == "min_count" and v == 0):
            yield _value(node, SH + sh, v)


def shape_rows(catalog: Catalog) -> list[Row]:
    """The shapes of a catalog in SHACL, as rows of quads."""
    out: list[Row] = []
    for shape in catalog.shapes.values():
        out.append(_iri(shape.iri, RDF_TYPE, SH + "NodeShape"))
        if shape.target_class:
            out.append(_iri(shape.iri, SH + "targetClass", shape.target_class))
        if shape.extends:
            out.append(_iri(shape.iri, SH + "node", shape.extends.iri))
        for flag in ("closed", "deactivated"):
            if getattr(shape, flag):
                out.append(_value(shape.iri, SH + flag, True))
        for p in shape.own:
            out += _property_rows(shape, p, catalog)
    return list(dict.fromkeys(out))


def ontology_rows(catalog: Catalog) -> list[Row]:
    """The classes of a catalog and what they are below."""
    classes = {s.target_class for s in catalog.shapes.values() if s.target_class} | set(catalog.super_classes) | {c for up in catalog.super_classes.values() for c in up}
    links = {(a, b) for a, up in catalog.super_classes.items() for b in up}
    return [_iri(c, RDF_TYPE, OWL + "Class") for c in sorted(classes)] + [_iri(a, SUBCLASS, b) for a, b in sorted(links)]


def _escaped(text: str) -> str:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(a, b)
    return f'"{text}"'


def to_turtle(rows: list[Row]) -> str:
    """Turtle with whole IRIs, a paragraph for each subject."""
    name = lambda x: x if x.startswith("_:") else f"<{x}>"
    by: dict[str, list[str]] = {}
    for _, s, p, kind, value, datatype, lang in rows:
        term = _escaped(value) + (f"@{lang}" if lang else f"^^<{datatype}>" if datatype and datatype != XSD + "string" else "") if kind == "literal" else name(value)
        by.setdefault(s, []).append(f"{name(p)} {term}")
    return "\n".join(f"{name(s)} " + " ;\n    ".join(said) + " .\n" for s, said in by.items())


def shapes_to_turtle(catalog: Catalog) -> str:
    return to_turtle(shape_rows(catalog))


#: Kinds of named graphs that the registry knows.
KINDS = ("data", "ontology", "shapes", "components", "draft")


class Graphs:
    """The named graphs of a store, by kind; what a graph holds is read and written as quads."""

    def __init__(self, store: Store, kind: str = "data"):
        if kind not in KINDS:
            raise QueryError(f"{kind!r} is no kind of graph")
        self.store, self.kind = store, kind

    def _records(self, p: str) -> DataFrame:
        return self.store.quads.where((F.col("g") == REGISTRY) & (F.col("p") == p))

    def df(self) -> DataFrame:
        """(graph): the graphs of this kind."""
        return self._records(GRAPH_KIND).where(F.col("o_value") == self.kind).select(F.col("s").alias("graph"))

    def exists(self, graph: str) -> bool:
        return not self.df().where(F.col("graph") == graph).isEmpty()

    def read(self, graph: str) -> DataFrame:
        return self.store.quads.where(F.col("g") == graph)

    def create(self, graph: str, quads: DataFrame | None = None) -> None:
        self.store.graph_create(graph, quads, self.kind)

    def replace(self, graph: str, quads: DataFrame) -> None:
        self.store.graph_replace(graph, quads, self.kind)

    def patch(self, graph: str, add: DataFrame | None = None, remove: DataFrame | None = None) -> None:
        self.store.graph_patch(graph, add, remove)

    def drop(self, graph: str) -> None:
        self.store.graph_drop(graph)

    def publish(self, draft: str, graph: str, kind: str = "data") -> None:
        """A draft becomes the content of another graph and goes."""
        self.store.graph_replace(graph, self.read(draft), kind)
        self.store.graph_drop(draft)

    def sync(self, graph: str, rows: list[Row]) -> bool:
        """The graph holds these rows afterwards; nothing is written if it was synced from equal rows before. Whether it wrote."""
        now = hashlib.sha256("\n".join(sorted(map(repr, rows))).encode()).hexdigest()
        if not self._records(GRAPH_HASH).where((F.col("s") == graph) & (F.col("o_value") == now)).isEmpty():
            return False
        spark = self.store.spark
        self.replace(graph, quads_frame(spark, rows))
        self.store._swap(put(self.store.quads, quads_frame(spark, [(REGISTRY, graph, GRAPH_HASH, "literal", now, XSD + "string", None)]), few=True))
        return True


def sync_shapes(store: Store, graph: str, catalog: Catalog | None = None) -> bool:
    return Graphs(store, "shapes").sync(graph, shape_rows(catalog or store.catalog))


def sync_ontology(store: Store, graph: str, catalog: Catalog | None = None) -> bool:
    return Graphs(store, "ontology").sync(graph, ontology_rows(catalog or store.catalog))


def load_sources(spark: SparkSession, config: dict, catalog: Catalog) -> Router:
    """A router from {"sources": {name: {"format": "parquet" or "ntriples", "path": ..., "writable": bool}}, "default": name, "shapes": {shape: name}, "graphs": {shape: graph}}."""
    made: dict[str, QuadSource] = {}
    for name, c in config.get("sources", {}).items():
        unknown = set(c) - {"format", "path", "writable", "inference"}
        if unknown or "path" not in c:
            raise QueryError(f"source {name!r}: {f'unknown settings {sorted(unknown)}' if unknown else 'no path'}")
        match c.get("format", "parquet"):
            case "parquet":
                quads = spark.read.parquet(c["path"])
            case "ntriples":
                quads = read_ntriples(spark, c["path"])
            case other:
                raise QueryError(f"source {name!r}: no format {other!r}")
        made[name] = (Store if c.get("writable") else QuadSource)(quads, catalog, c.get("inference", "ontology"))
    wanted = {config.get("default"), *config.get("shapes", {}).values()}
    if missing := sorted(map(str, wanted - set(made))):
        raise QueryError(f"no source is named {', '.join(missing)}")
    for shape in (*config.get("shapes", {}), *config.get("graphs", {})):
        catalog.shape(shape)
    return Router(made[config["default"]], {s: made[n] for s, n in config.get("shapes", {}).items()}, config.get("graphs"), catalog)
