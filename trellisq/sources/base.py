"""What the planner asks of a source of shaped data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.closure import transitive_closure
from ..paths import Alt, Inverse, Negated, PathExpr, Ref, Repeat, Seq
from ..shapes import DEFAULT, Catalog, Property, Shape

SPARK_TYPES = {
    "string": "string", "boolean": "boolean", "integer": "bigint", "long": "bigint", "decimal": "double", "double": "double",
    "float": "double", "date": "date", "dateTime": "timestamp", "time": "string", "duration": "string", "gYear": "string",
}
FEATURES = frozenset({"groupBy", "min", "max", "ask", "count", "triples", "triplesPattern", "triplesTerms", "shapelessDelete", "transactions", "graphs"})


class Source:
    """scan, edge and (optionally) node give plain tables; everything else is Spark's."""

    catalog: Catalog = DEFAULT
    inference: str = "ontology"
    supports: frozenset[str] = FEATURES

    def scan(self, shape: Shape, graphs: tuple[str, ...] | None = None) -> DataFrame:
        """(id): the nodes of the shape's class, once each."""
        raise NotImplementedError

    def inline(self, shape: Shape, label: str) -> bool:
        """Whether ``node`` has the property as a column, at most one value a node."""
        return False

    def node(self, shape: Shape) -> DataFrame | None:
        """(id, a column for each inline property)."""
        return None

    def edge_node(self, shape: Shape, label: str) -> DataFrame | None:
        """(s, o, a column for each inline property of o), if a relation's members keep the way back in their own table: edge and node are one scan."""
        return None

    def step(self, path: PathExpr, graphs: tuple[str, ...] | None = None) -> DataFrame:
        """(s, o, kind, datatype, lang) along one predicate or several, as a set."""
        match path:
            case Ref(iri):
                return self.predicate(iri, graphs)
            case Seq(parts):
                out = self.step(parts[0], graphs)
                for p in parts[1:]:
                    nxt = self.step(p, graphs).withColumnRenamed("s", "m")
                    left = out.where("kind <> 'literal'").select("s", F.col("o").alias("m"))
                    out = left.join(nxt, "m").select("s", "o", "kind", "datatype", "lang").distinct()
                return out
            case Alt(parts):
                out = self.step(parts[0], graphs)
                for p in parts[1:]:
                    out = out.unionByName(self.step(p, graphs))
                return out.distinct()
            case Inverse(part):
                back = self.step(part, graphs).where("kind <> 'literal'")
                return back.select(F.col("o").alias("s"), F.col("s").alias("o"), F.lit("iri").alias("kind"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))
            case Repeat(part, least, bounded):
                once = self.step(part, graphs)
                links = once.where("kind <> 'literal'").select("s", "o")
                reached = links if bounded else transitive_closure(links)
                term = lambda df: df.select("s", "o", F.lit("iri").alias("kind"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))
                out = term(reached)
                # Literals end a path, so they come one step after a node that is reached.
                ends = once.where("kind = 'literal'")
                out = out.unionByName(ends)
                if not bounded:
                    out = out.unionByName(reached.withColumnRenamed("o", "m").join(ends.withColumnRenamed("s", "m"), "m").select("s", "o", "kind", "datatype", "lang"))
                if not least:
                    nodes = self.nodes(graphs)
                    out = out.unionByName(term(nodes.select(F.col("id").alias("s"), F.col("id").alias("o"))))
                return out.distinct()
            case Negated(forward, backward):
                parts = []
                if forward or not backward:
                    parts.append(self.all_predicates(graphs).where(~F.col("p").isin(list(forward))).drop("p"))
                if backward:
                    back = self.all_predicates(graphs).where(~F.col("p").isin(list(backward)) & (F.col("kind") != "literal"))
                    parts.append(back.select(F.col("o").alias("s"), F.col("s").alias("o"), F.lit("iri").alias("kind"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang")))
                out = parts[0]
                for p in parts[1:]:
                    out = out.unionByName(p)
                return out.distinct()
        raise TypeError(f"not a path: {path!r}")

    def predicate(self, iri: str, graphs: tuple[str, ...] | None = None) -> DataFrame:
        raise NotImplementedError

    def terms(self, iri: str, graphs: tuple[str, ...] | None = None) -> DataFrame:
        """As ``predicate``, but rows may be repeated."""
        return self.predicate(iri, graphs)

    def all_predicates(self, graphs: tuple[str, ...] | None = None) -> DataFrame:
        raise NotImplementedError

    def nodes(self, graphs: tuple[str, ...] | None = None) -> DataFrame:
        raise NotImplementedError

    def edge(self, shape: Shape, prop: Property, graphs: tuple[str, ...] | None = None) -> DataFrame:
        """(s, o): the values of a property, of its declared type; what has another type is no value."""
        # One predicate is made a set once, at the end.
        found = self.terms(prop.path.iri, graphs) if isinstance(prop.path, Ref) else self.step(prop.path, graphs)
        if prop.is_relation:
            links = found.where("kind <> 'literal'").select("s", "o")
            return links.distinct() if isinstance(prop.path, Ref) else links
        kind = SPARK_TYPES.get(prop.datatype or "string", "string")
        value = F.col("o") if kind == "string" else F.col("o").try_cast(kind)
        return found.where("kind = 'literal'").select("s", value.alias("o")).where("o is not null").distinct()
