"""Ordinary tables mapped to shapes: a table's columns are a node's single values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..paths import Ref
from ..shapes import DEFAULT, RDF_TYPE, Catalog, Property, Shape
from .base import Source


@dataclass
class Mapping:
    """id: a key column, or None for tables without one (a hash of the whole row, never shown as a key).

    columns: property label to column; inverse: relation label to (shape name, its relation back).
    """

    table: DataFrame
    id: str | None
    columns: dict[str, str]
    inverse: dict[str, tuple[str, str]] = field(default_factory=dict)


class MappedSource(Source):
    """Several properties of one table are one scan: the planner reads ``node`` and prunes columns, and filters reach the files."""

    def __init__(self, mappings: dict[str, Mapping], catalog: Catalog = DEFAULT, inference: str = "ontology"):
        self.mappings, self.catalog, self.inference = mappings, catalog, inference
        self.spark = next(iter(mappings.values())).table.sparkSession

    def _mapping(self, shape: Shape) -> Mapping:
        s = shape
        while s and s.name not in self.mappings:
            s = s.extends
        if s is None:
            raise KeyError(f"no table is mapped to {shape.name}")
        return self.mappings[s.name]

    def _id(self, m: Mapping):
        return F.col(m.id) if m.id else F.xxhash64(*m.table.columns)

    def scan(self, shape: Shape, graphs=None) -> DataFrame:
        m = self._mapping(shape)
        return m.table.select(self._id(m).alias("id"))

    def inline(self, shape: Shape, label: str) -> bool:
        return label in self._mapping(shape).columns

    def node(self, shape: Shape) -> DataFrame:
        m = self._mapping(shape)
        return m.table.select(self._id(m).alias("id"), *(F.col(c).alias(label) for label, c in m.columns.items()))

    def edge_node(self, shape: Shape, label: str) -> DataFrame | None:
        m = self._mapping(shape)
        if label not in m.inverse or label in m.columns:
            return None
        name, back = m.inverse[label]
        other = self.mappings[name]
        return other.table.select(F.col(other.columns[back]).alias("s"), self._id(other).alias("o"), *(F.col(c).alias(x) for x, c in other.columns.items())).where("s is not null")

    def edge(self, shape: Shape, prop: Property, graphs=None) -> DataFrame:
        m = self._mapping(shape)
        if prop.label == "$type":
            classes = [shape.target()]
            return m.table.select(self._id(m).alias("s"), F.explode(F.lit(classes)).alias("o"))
        if prop.label in m.columns:
            return m.table.select(self._id(m).alias("s"), F.col(m.columns[prop.label]).alias("o")).where("o is not null")
        if prop.label in m.inverse:
            name, back = m.inverse[prop.label]
            other = self.mappings[name]
            return other.table.select(F.col(other.columns[back]).alias("s"), self._id(other).alias("o")).where("s is not null")
        if not isinstance(prop.path, Ref):
            return self.step(prop.path).select("s", "o").distinct()
        raise KeyError(f"{shape.name}.{prop.label} is mapped to no column")

    def _columns(self):
        for name, m in self.mappings.items():
            shape = self.catalog.shape(name)
            for label, column in m.columns.items():
                p = shape.property(label)
                if isinstance(p.path, Ref):
                    yield p.path.iri, p, m.table.select(self._id(m).alias("s"), F.col(column).alias("o")).where("o is not null")

    @staticmethod
    def _terms(df: DataFrame, p: Property) -> DataFrame:
        kind = "iri" if p.is_relation else "literal"
        return df.select("s", "o", F.lit(kind).alias("kind"), F.lit(None if p.is_relation else p.datatype).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))

    def predicate(self, iri: str, graphs=None) -> DataFrame:
        out = None
        for name, p, df in self._columns():
            if name == iri:
                out = self._terms(df, p) if out is None else out.unionByName(self._terms(df, p))
        if out is None:
            raise KeyError(f"no column is mapped to {iri}")
        return out.distinct()

    def nodes(self, graphs=None) -> DataFrame:
        out = None
        for m in self.mappings.values():
            ids = m.table.select(self._id(m).alias("id"))
            out = ids if out is None else out.unionByName(ids)
        return out.distinct()

    def quads(self) -> DataFrame:
        """All mapped columns as quads; ids become ``urn:<shape>:<key>``."""
        name_of = lambda shape, c: F.concat(F.lit(f"urn:{shape}:"), c.cast("string"))
        out = None
        for name, m in self.mappings.items():
            shape = self.catalog.shape(name)
            s = name_of(name, self._id(m))
            facts = [F.struct(F.lit(RDF_TYPE).alias("p"), F.lit("iri").alias("o_kind"), F.lit(shape.target()).alias("o_value"), F.lit(None).cast("string").alias("o_datatype"))]
            for label, column in m.columns.items():
                p = shape.property(label)
                if isinstance(p.path, Ref):
                    value = name_of(p.shape, F.col(column)) if p.is_relation else F.col(column).cast("string")
                    facts.append(F.struct(F.lit(p.path.iri).alias("p"), F.lit("iri" if p.is_relation else "literal").alias("o_kind"), value.alias("o_value"), F.lit(None if p.is_relation else p.datatype).cast("string").alias("o_datatype")))
            rows = m.table.select(s.alias("s"), F.explode(F.array(*facts)).alias("f")).where("f.o_value is not null")
            rows = rows.select(F.lit(None).cast("string").alias("g"), "s", "f.p", "f.o_kind", "f.o_value", "f.o_datatype", F.lit(None).cast("string").alias("o_lang"))
            out = rows if out is None else out.unionByName(rows)
        return out
