"""A table of quads as a source, and text formats of quads."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shapes import DEFAULT, RDF_TYPE, SUBCLASS, XSD, Catalog, Shape
from .base import Source

SCHEMA = "g string, s string, p string, o_kind string, o_value string, o_datatype string, o_lang string"
COLUMNS = ("g", "s", "p", "o_kind", "o_value", "o_datatype", "o_lang")
REGISTRY, UNION, ALL_ONTOLOGIES, ALL_SHAPES, DEFAULT_GRAPH = "graph:registry", "graph:union", "graph:all-ontologies", "graph:all-shapes", "graph:default"
GRAPH_KIND = "graph:kind"


class QuadSource(Source):
    """quads: g (null: the default graph), s, p, o_kind (iri, blank or literal), o_value, o_datatype, o_lang.

    Partition a stored table by g (and p): scans then read only the graphs and predicates a query names.
    """

    def __init__(self, quads: DataFrame, catalog: Catalog = DEFAULT, inference: str = "ontology"):
        self.quads, self.catalog, self.inference = quads, catalog, inference
        self.spark = quads.sparkSession

    def resolve(self, graphs: tuple[str, ...] | None) -> tuple[str, ...] | None:
        """Portable names resolved: the registry records what kind each graph is of."""
        if graphs is None or UNION in graphs:
            return None
        out = set(graphs)
        for name, kind in ((ALL_ONTOLOGIES, "ontology"), (ALL_SHAPES, "shapes")):
            if name in out:
                out.remove(name)
                recorded = self.quads.where((F.col("g") == REGISTRY) & (F.col("p") == GRAPH_KIND) & (F.col("o_value") == kind)).select("s").distinct()
                out |= {r["s"] for r in recorded.toLocalIterator()}
        return tuple(sorted(out))

    def scoped(self, graphs: tuple[str, ...] | None) -> DataFrame:
        graphs = self.resolve(graphs)
        if graphs is None:
            return self.quads.where("g is null or g <> 'graph:registry'")
        named = [g for g in graphs if g != DEFAULT_GRAPH]
        inside = F.col("g").isin(named) if named else F.lit(False)
        return self.quads.where(inside | F.col("g").isNull() if DEFAULT_GRAPH in graphs else inside)

    def scan(self, shape: Shape, graphs=None) -> DataFrame:
        classes = sorted(self.catalog.classes_under(shape.target(), self.inference))
        return self.scoped(graphs).where((F.col("p") == RDF_TYPE) & F.col("o_value").isin(classes)).select(F.col("s").alias("id")).distinct()

    def terms(self, iri: str, graphs=None) -> DataFrame:
        return self._terms(self.scoped(graphs).where(F.col("p") == iri))

    def predicate(self, iri: str, graphs=None) -> DataFrame:
        return self.terms(iri, graphs).distinct()

    @staticmethod
    def _terms(df: DataFrame, *more: str) -> DataFrame:
        return df.select("s", F.col("o_value").alias("o"), F.col("o_kind").alias("kind"), F.col("o_datatype").alias("datatype"), F.col("o_lang").alias("lang"), *more)

    def all_predicates(self, graphs=None) -> DataFrame:
        return self._terms(self.scoped(graphs), "p")

    def nodes(self, graphs=None) -> DataFrame:
        q = self.scoped(graphs)
        return q.select(F.col("s").alias("id")).unionByName(q.where("o_kind <> 'literal'").select(F.col("o_value").alias("id"))).distinct()

    def learn_classes(self) -> None:
        """Takes the class hierarchy that the quads state into the catalog. Hierarchies are metadata, far smaller than data."""
        for r in self.quads.where(F.col("p") == SUBCLASS).select("s", "o_value").distinct().toLocalIterator():
            self.catalog.declare_subclass(r["s"], r["o_value"])


_IRI, _BLANK = r"<([^>]*)>", r"(_:[^\s]+)"
_LINE = rf"^\s*(?:{_IRI}|{_BLANK})\s+<([^>]*)>\s+(?:{_IRI}|{_BLANK}|\"((?:[^\"\\]|\\.)*)\"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*(?:<([^>]*)>)?\s*\.\s*(?:#.*)?$"


def _unescaped(c):
    """Escapes of a literal undone; a doubled backslash is parked while the others are replaced."""
    out = F.replace(c, F.lit("\\\\"), F.lit("\u0000"))
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.replace(out, F.lit("\u0000"), F.lit("\\"))


def read_ntriples(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """N-Triples or N-Quads files as quads, line by line on the executors; lines that are neither are an error when read."""
    line = F.col("value")
    part = lambda k: F.nullif(F.regexp_extract(line, _LINE, k), F.lit(""))
    lines = spark.read.text(path).where(~line.rlike(r"^\s*(#.*)?$"))
    literal = F.lit(True) & part(4).isNull() & part(5).isNull()
    return lines.select(
        F.coalesce(part(9), F.lit(graph)).alias("g"),
        F.coalesce(part(1), part(2), F.raise_error(F.concat(F.lit("not a statement: "), line))).alias("s"),
        part(3).alias("p"),
        F.when(part(4).isNotNull(), "iri").when(part(5).isNotNull(), "blank").otherwise("literal").alias("o_kind"),
        F.coalesce(part(4), part(5), _unescaped(F.regexp_extract(line, _LINE, 6))).alias("o_value"),
        F.when(literal, F.coalesce(part(7), F.when(part(8).isNull(), F.lit(XSD + "string")))).alias("o_datatype"),
        part(8).alias("o_lang"),
    )


_TURTLE = re.compile(r"""\s+|\#[^\n]*|(?P<t><[^>]*>|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|@[A-Za-z-]+|\^\^|_:[\w.-]*\w|[+-]?\d+\.\d+(?:[eE][+-]?\d+)?|[+-]?\d+|[A-Za-z_][\w.-]*:[\w-]*(?:\.[\w-]+)*|:[\w-]+|[A-Za-z]+|[;,.\[\]])""")


def parse_turtle(text: str, graph: str | None = None) -> list[tuple]:
    """Quads of a small Turtle document (metadata such as shapes or ontologies; data goes through N-Triples)."""
    tokens, at = [], 0
    while at < len(text):
        m = _TURTLE.match(text, at)
        if not m:
            raise ValueError(f"not Turtle: {text[at : at + 40]!r}")
        at = m.end()
        if m["t"]:
            tokens.append(m["t"])
    prefixes, out, place, blanks = {}, [], 0, 0

    def iri(t: str) -> str:
        if t.startswith("<"):
            return t[1:-1]
        if t == "a":
            return RDF_TYPE
        prefix, _, local = t.partition(":")
        if prefix not in prefixes:
            raise ValueError(f"unknown prefix {prefix!r}")
        return prefixes[prefix] + local

    def value() -> tuple:
        nonlocal place, blanks
        t = tokens[place]
        place += 1
        if t == "[":
            blanks += 1
            name = f"_:b{blanks}"
            if tokens[place] != "]":
                described(name)
            place += 1
            return "blank", name, None, None
        if t[0] in "\"'":
            body = t[1:-1].encode().decode("unicode_escape").encode("latin-1", "surrogatepass").decode("utf-8", "replace") if "\\" in t else t[1:-1]
            if place < len(tokens) and tokens[place] == "^^":
                place += 2
                return "literal", body, iri(tokens[place - 1]), None
            if place < len(tokens) and tokens[place].startswith("@"):
                place += 1
                return "literal", body, None, tokens[place - 1][1:]
            return "literal", body, XSD + "string", None
        if re.fullmatch(r"[+-]?\d+", t):
            return "literal", t, XSD + "integer", None
        if re.fullmatch(r"[+-]?\d.*", t):
            return "literal", t, XSD + ("double" if "e" in t.lower() else "decimal"), None
        if t in ("true", "false"):
            return "literal", t, XSD + "boolean", None
        return ("blank", t, None, None) if t.startswith("_:") else ("iri", iri(t), None, None)

    def described(subject: str) -> None:
        nonlocal place
        while True:
            p = iri(tokens[place])
            place += 1
            while True:
                out.append((graph, subject, p, *value()))
                if tokens[place] != ",":
                    break
                place += 1
            while tokens[place] == ";":
                place += 1
            if tokens[place] in (".", "]"):
                return

    while place < len(tokens):
        if tokens[place].lower() in ("@prefix", "prefix"):
            prefixes[tokens[place + 1].rstrip(":")] = tokens[place + 2][1:-1]
            place += 3
            place += place < len(tokens) and tokens[place] == "."
            continue
        described(value()[1])
        place += 1
    return out


def quads_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def to_ntriples(quads: DataFrame) -> DataFrame:
    """(value): one N-Quads line a quad, for ``write.text``."""
    node = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    body = F.col("o_value")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(a), F.lit(b))
    suffix = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), "o_datatype", F.lit(">"))).otherwise("")
    literal = F.concat(F.lit('"'), body, F.lit('"'), suffix)
    o = F.when(F.col("o_kind") == "literal", literal).otherwise(node(F.col("o_value")))
    graph = F.coalesce(F.concat(F.lit(" <"), "g", F.lit(">")), F.lit(""))
    return quads.select(F.concat(node(F.col("s")), F.lit(" <"), "p", F.lit("> "), o, graph, F.lit(" .")).alias("value"))
