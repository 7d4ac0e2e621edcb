"""Queries to DataFrames.

The conditions of a query are evaluated on a flat *frame*: the root's id and a
column for each node and value that a condition reads.  A path's hops are
inner joins there (what a condition walks must exist) and its last value an outer one.
Quantifiers become semi and anti joins, or a joined mark where they stand
under ``or`` or ``not``.  Pages are cut from root ids before any values fan out.  Then results are
assembled bottom up: each relation is aggregated on its own and joined to its parent
one to one, so two multi-valued relations never multiply.  A relation that the
condition walked is assembled from the frame, so it shows only what the condition kept.

Where a source keeps single values as columns, they are read from the one scan.
"""

from __future__ import annotations

from itertools import count as counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compile import compile, conjuncts, has_aggregate, has_quantifier
from ..functions.expr import Agg, Call, Ctx, Expr, Lit, Node, Path, QueryError, Quant, Scope, Step, walk
from ..shapes import TYPE, Property, Shape
from .query import Field, Select, SubSelect


class UnresolvedContext(LookupError):
    pass


class Frame:
    """Flat bindings: df, and the columns of nodes and values by (scope, steps)."""

    def __init__(self, planner: Planner, df: DataFrame, scope: Scope, id_: str, shape: Shape | None, graphs):
        self.planner, self.df, self.graphs = planner, df, graphs
        self.ids: dict[tuple, str] = {(scope, ()): id_}
        self.shapes: dict[tuple, Shape | None] = {(scope, ()): shape}
        self.required: set[tuple] = {(scope, ())}
        self.values: dict[tuple, str] = {}
        self.inlined: dict[tuple, dict[str, str]] = {}
        self.fans_out = False

    def fresh(self) -> str:
        return f"v{next(self.planner.names)}"

    def copy(self) -> Frame:
        out = Frame.__new__(Frame)
        out.__dict__.update(self.__dict__)
        out.ids, out.shapes, out.required, out.values, out.inlined = dict(self.ids), dict(self.shapes), set(self.required), dict(self.values), {k: dict(v) for k, v in self.inlined.items()}
        return out

    def columns_of(self, key: tuple) -> dict[str, str]:
        """The inline values of a node as columns, joined at most once; unused ones are pruned by Spark."""
        if key not in self.inlined:
            table = self.planner.source.node(self.shapes[key])
            names = {c: self.fresh() for c in table.columns}
            self.df = self.df.join(table.select(*(F.col(c).alias(n) for c, n in names.items())), F.col(self.ids[key]) == F.col(names["id"]), "left").drop(names["id"])
            names.pop("id")
            self.inlined[key] = names
        return self.inlined[key]

    def hop(self, scope: Scope, steps: tuple[Step, ...], how: str) -> str:
        """The id column of the node at the end of the steps."""
        key = (scope, tuple(s.key for s in steps))
        if key in self.ids:
            if steps and how == "inner" and key not in self.required:
                self.hop(scope, steps[:-1], how)
                self.df = self.df.where(F.col(self.ids[key]).isNotNull())
                self.required.add(key)
            return self.ids[key]
        parent_key = (scope, tuple(s.key for s in steps[:-1]))
        parent = self.hop(scope, steps[:-1], how)
        shape, step = self.shapes[parent_key], steps[-1]
        prop = self.planner.property(shape, step.label)
        self.shapes[key] = self.planner.value_shape(shape, prop, step)
        if step.where is None and shape is not None and self.planner.source.inline(shape, step.label):
            column = self.columns_of(parent_key)[step.label]
            if how == "inner":
                self.df = self.df.where(F.col(column).isNotNull())
        else:
            column, s = self.fresh(), self.fresh()
            edge, names = self.planner.edge_and_node(shape, prop, step, self.graphs, s, column)
            self.df = self.df.join(edge, F.col(parent) == F.col(s), how).drop(s)
            if names is not None:
                self.inlined[key] = names
            self.fans_out = True
        self.ids[key] = column
        if how == "inner":
            self.required.add(key)
        return column

    def value(self, path: Path, how: str = "inner", last: str = "left") -> Column:
        """The value at the end of a path: hops joined by ``how``, the last property by ``last``."""
        if not path.steps:
            return F.col(self.ids[(path.scope, ())])
        parent_key = (path.scope, tuple(s.key for s in path.steps[:-1]))
        key = (path.scope, tuple(s.key for s in path.steps))
        if key in self.ids:
            return F.col(self.hop(path.scope, path.steps, "inner") if last == "inner" else self.ids[key])
        parent = self.hop(path.scope, path.steps[:-1], how)
        if key not in self.values:
            shape, step = self.shapes[parent_key], path.steps[-1]
            prop = self.planner.property(shape, step.label)
            if step.where is None and shape is not None and self.planner.source.inline(shape, step.label):
                self.values[key] = self.columns_of(parent_key)[step.label]
            else:
                column, s = self.fresh(), self.fresh()
                edge = self.planner.edge(shape, prop, step, self.graphs).select(F.col("s").alias(s), F.col("o").alias(column))
                self.df = self.df.join(edge, F.col(parent) == F.col(s), "left").drop(s)
                self.values[key] = column
                self.fans_out = True
            if prop.is_relation:
                self.ids[key] = self.values[key]
                self.shapes[key] = self.planner.value_shape(shape, prop, step)
        if last == "inner":
            self.df = self.df.where(F.col(self.values[key]).isNotNull())
        return F.col(self.values[key])


class Planner:
    def __init__(self, source, context: dict | None = None):
        self.source, self.context, self.names = source, context or {}, counter()
        self.everything = False  # whether the roots are all nodes of their shape

    # Schema
    def property(self, shape: Shape | None, label: str) -> Property:
        if label == "$type":
            return TYPE
        if shape is None:
            raise QueryError(f"nothing is known of what {label!r} is read from")
        return shape.property(label)

    def value_shape(self, shape: Shape | None, prop: Property, step: Step) -> Shape | None:
        if step.cast:
            return self.source.catalog.shape(step.cast)
        return shape.value_shape(prop) if shape is not None else None

    def edge(self, shape: Shape | None, prop: Property, step: Step, graphs) -> DataFrame:
        """(s, o), narrowed by the step's filter; the filter's own properties may be missing, its hops may not."""
        if step.where is None:
            return self.source.edge(shape, prop, graphs)
        plain, names = self.edge_and_node(shape, prop, Step(step.label, step.cast), graphs, "fs", "fo")
        frame = Frame(self, plain, step.scope, "fo", self.value_shape(shape, prop, step), graphs)
        if names is not None:
            frame.inlined[(step.scope, ())] = names
        self.filter(frame, step.where)
        return frame.df.select(F.col("fs").alias("s"), F.col("fo").alias("o")).distinct()

    def edge_and_node(self, shape: Shape | None, prop: Property, step: Step, graphs, s: str, o: str) -> tuple[DataFrame, dict[str, str] | None]:
        """(s, o) by the names given and, where edge and node are one table, the columns of the node's inline values."""
        table = self.source.edge_node(shape, step.label) if step.where is None and step.cast is None and shape is not None and graphs is None else None
        if table is None:
            return self.edge(shape, prop, step, graphs).select(F.col("s").alias(s), F.col("o").alias(o)), None
        names = {c: f"v{next(self.names)}" for c in table.columns if c not in ("s", "o")}
        return table.select(F.col("s").alias(s), F.col("o").alias(o), *(F.col(c).alias(n) for c, n in names.items())), names

    # Context
    def resolved(self, ctx: Ctx):
        if ctx.key not in self.context or self.context[ctx.key] is None:
            raise UnresolvedContext(ctx.key)
        value = self.context[ctx.key]
        return value["id"] if isinstance(value, dict) else value

    def context_value(self, frame: Frame, ctx: Ctx) -> Column:
        id_ = self.resolved(ctx)
        if not ctx.steps:
            return F.lit(id_)
        # A property of the context node: one row joined to every other.
        shape = self.source.catalog.shape(self.context[ctx.key]["shape"]) if isinstance(self.context[ctx.key], dict) and "shape" in self.context[ctx.key] else ctx.start or ctx.shape
        scope, column = Scope(shape), frame.fresh()
        inner = Frame(self, self.source.spark.createDataFrame([(id_,)], ["cid"]), scope, "cid", shape, frame.graphs)
        value = inner.value(Path(scope, tuple(Step(x) for x in ctx.steps), None), "inner", "inner")
        frame.df = frame.df.join(F.broadcast(inner.df.select(value.alias(column)).limit(1)))
        return F.col(column)

    # Conditions
    def filter(self, frame: Frame, condition: Expr | None, required: bool = False, negated: bool = False) -> None:
        """Keeps the rows for which the condition is true. required: its properties must exist (bodies of quantifiers and minus)."""
        if condition is None:
            return
        parts = [condition] if negated else conjuncts(condition)
        late = []
        for part in parts:
            if isinstance(part, Quant) and not negated:
                self.quantified(frame, part, part.kind == "some")
            else:
                late.append(part)
        for part in late:
            column = self.column(frame, part, required)
            frame.df = frame.df.where(~column if negated else column)

    def column(self, frame: Frame, e: Expr, required: bool = False, how: str = "inner") -> Column:
        last = "inner" if required else "left"
        resolved: dict[int, Column] = {}

        def resolve(x: Expr) -> Column:
            if id(x) not in resolved:
                match x:
                    case Path():
                        resolved[id(x)] = frame.value(x, how, last)
                    case Quant():
                        resolved[id(x)] = self.mark(frame, x)
                    case Ctx():
                        resolved[id(x)] = self.context_value(frame, x)
                    case Agg():
                        resolved[id(x)] = self.counted(frame, x)
                    case _:
                        raise QueryError(f"not an expression: {x!r}")
            return resolved[id(x)]

        return compile(e, resolve)

    def _body(self, frame: Frame, q: Quant) -> tuple[DataFrame, list[str]]:
        """Rows of a quantifier's body that satisfy it (for every: that do not), with the outer columns it depends on."""
        first = frame.hop(q.path.scope, (), "inner") if not q.path.steps[:-1] else frame.hop(q.path.scope, q.path.steps[:-1], "inner")
        outer = [first]
        known = {k: v for k, v in frame.ids.items()}
        for e in _read(q.body):
            if isinstance(e, Path) and (e.scope, ()) in known:
                column = frame.value(e)
                name = frame.fresh()
                frame.df = frame.df.withColumn(name, column)
                frame.values[(e.scope, tuple(s.key for s in e.steps))] = name
                outer.append(name)
        parent_key = (q.path.scope, tuple(s.key for s in q.path.steps[:-1]))
        shape, step = frame.shapes[parent_key], q.path.steps[-1]
        prop = self.property(shape, step.label)
        keys = {c: frame.fresh() for c in outer}
        member = frame.fresh()
        if len(keys) == 1:
            # The body depends on nothing but where the edge starts: it is evaluated on the edges themselves.
            start, names = self.edge_and_node(shape, prop, step, frame.graphs, keys[first], member)
        else:
            rows = frame.df.select(*(F.col(c).alias(n) for c, n in keys.items())).distinct()
            edge, names = self.edge_and_node(shape, prop, step, frame.graphs, "qs", member)
            start = rows.join(edge, F.col(keys[first]) == F.col("qs")).drop("qs")
        body = Frame(self, start, q.scope, member, self.value_shape(shape, prop, step), frame.graphs)
        if names is not None:
            body.inlined[(q.scope, ())] = names
        for (scope, steps), column in {**frame.ids, **frame.values}.items():
            if column in keys and column != first or (scope, steps) == (q.path.scope, ()) and column == first:
                body.values.setdefault((scope, steps), keys[column])
                body.ids.setdefault((scope, steps), keys[column])
        self.filter(body, q.body, required=True, negated=q.kind == "every")
        return body.df.select(*keys.values()).distinct(), list(keys.items())

    def quantified(self, frame: Frame, q: Quant, wanted: bool) -> None:
        rows, keys = self._body(frame, q)
        on = [F.col(a).eqNullSafe(F.col(b)) if k else F.col(a) == F.col(b) for k, (a, b) in enumerate(keys)]
        frame.df = frame.df.join(rows, on, "left_semi" if wanted else "left_anti")

    def mark(self, frame: Frame, q: Quant) -> Column:
        rows, keys = self._body(frame, q)
        name = frame.fresh()
        on = [F.col(a).eqNullSafe(F.col(b)) if k else F.col(a) == F.col(b) for k, (a, b) in enumerate(keys)]
        frame.df = frame.df.join(rows.withColumn(name, F.lit(True)), on, "left").drop(*(b for _, b in keys))
        found = F.coalesce(F.col(name), F.lit(False))
        return found if q.kind == "some" else ~found

    def counted(self, frame: Frame, a: Agg) -> Column:
        """An aggregate inside a condition: per root, joined back."""
        root = next(iter(frame.ids.values()))
        base = Frame(self, frame.df.select(F.col(root).alias("ar")).distinct(), next(iter(frame.ids))[0], "ar", next(iter(frame.shapes.values())), frame.graphs)
        value = self.column(base, a.arg, how="inner")
        key, name = frame.fresh(), frame.fresh()
        rows = base.df.groupBy(F.col("ar").alias(key)).agg(aggregate(a.name, value).alias(name))
        frame.df = frame.df.join(rows, F.col(root) == F.col(key), "left" if not _hops(a.arg) else "inner").drop(key)
        return F.coalesce(F.col(name), F.lit(0)) if a.name == "COUNT" else F.col(name)

    # Roots
    def roots(self, q: Select) -> Frame:
        graphs = q.graphs or q.shape.default_read_graphs
        scope = q.root.scope
        frame = Frame(self, self.source.scan(q.shape, graphs), scope, "id", q.shape, graphs)
        table = self.source.node(q.shape)
        if table is not None:
            names = {c: frame.fresh() for c in table.columns if c != "id"}
            frame.df = table.select("id", *(F.col(c).alias(n) for c, n in names.items()))
            frame.inlined[(scope, ())] = names
        if q.subject is not None:
            frame.df = frame.df.where(F.col("id") == F.lit(self.resolved(q.subject) if isinstance(q.subject, Ctx) else q.subject))
        if q.subjects is not None:
            frame.df = frame.df.where(F.col("id").isin(list(q.subjects)) if q.subjects else F.lit(False))
        self.filter(frame, q.condition)
        for kind, what in q.minuses:
            self.minus(frame, q, kind, what, graphs)
        return frame

    def minus(self, frame: Frame, q: Select, kind: str, what, graphs) -> None:
        if kind == "shape":
            gone = self.source.scan(what, graphs).select(F.col("id").alias("gone"))
        else:
            inner = Frame(self, self.source.scan(q.shape, graphs), q.root.scope, "id", q.shape, graphs)
            if kind == "paths":
                for p in what:
                    inner.value(p, "inner", "inner")
            else:
                self.filter(inner, what, required=True)
            gone = inner.df.select(F.col("id").alias("gone"))
        frame.df = frame.df.join(gone, F.col("id") == F.col("gone"), "left_anti")

    # Results
    def frame(self, q: Select) -> DataFrame:
        if q.kind == "count":
            roots = self.roots(q)
            # A scan gives each node once; only joins that fan out repeat it.
            return roots.df.agg((F.count_distinct("id") if roots.fans_out else F.count("*")).alias("count"))
        if q.kind == "ask":
            return self.roots(q).df.limit(1).agg((F.count("*") > 0).alias("exists"))
        if q.keys is not None:
            return self.grouped(q)
        frame = self.roots(q)
        self.everything = q.condition is None and not q.minuses and q.subject is None and q.subjects is None and q.limit_ is None and q.offset_ is None
        # What a computed field walks must exist; its last value may be missing.
        computed = {}
        for f in q.fields:
            if isinstance(f.what, Expr) and not isinstance(f.what, Path):
                if has_aggregate(f.what):
                    computed[f.name] = None
                    for a in (x for x in walk(f.what) if isinstance(x, Agg) and isinstance(x.arg, Path)):
                        if a.arg.steps[:-1]:
                            frame.hop(a.arg.scope, a.arg.steps[:-1], "inner")
                else:
                    name = frame.fresh()
                    column = self.column(frame, f.what)
                    frame.df = frame.df.withColumn(name, column)
                    computed[f.name] = name
        base, keys = self.paged(q, frame)
        out = self.assembled(q, frame, base, computed, keys)
        if keys:
            out = out.orderBy(*(F.col(k).asc_nulls_last() if d == "ASC" else F.col(k).desc_nulls_last() for k, d in keys), F.col("id").asc()).drop(*(k for k, _ in keys))
        elif q.limit_ is not None or q.offset_ is not None:
            out = out.orderBy("id")
        return out

    def paged(self, q: Select, frame: Frame) -> tuple[DataFrame, list[tuple[str, str]]]:
        """The rows of the page's roots (one a root), with a column for each sort key."""
        inline = frame.inlined.get((q.root.scope, ()), {})
        keys = []
        df = frame.df
        # One row a root: values of the scan are the same on all its rows.
        if frame.fans_out:
            df = df.groupBy("id").agg(*(F.first(c).alias(c) for c in inline.values())) if inline else df.select("id").distinct()
        for e, direction in q.order:
            name = f"sort{next(self.names)}"
            if isinstance(e, Path) and len(e.steps) == 1 and e.steps[0].where is None and e.steps[0].label in inline:
                df = df.withColumn(name, F.col(inline[e.steps[0].label]))
            elif isinstance(e, Path) and not e.steps:
                df = df.withColumn(name, F.col("id"))
            else:
                own = Frame(self, df.select(F.col("id").alias("si")), q.root.scope, "si", q.shape, frame.graphs)
                value = self.column(own, e, how="left")
                best = (F.min if direction == "ASC" else F.max)(value).alias(name)
                df = df.join(own.df.groupBy("si").agg(best), F.col("id") == F.col("si"), "left").drop("si")
            keys.append((name, direction))
        if q.subject is None and (q.limit_ is not None or q.offset_ is not None):
            df = df.orderBy(*(F.col(k).asc_nulls_last() if d == "ASC" else F.col(k).desc_nulls_last() for k, d in keys), F.col("id").asc())
            df = df.offset(q.offset_) if q.offset_ else df
            df = df.limit(q.limit_) if q.limit_ is not None else df
        return df, keys

    def assembled(self, q: Select, frame: Frame, base: DataFrame, computed: dict, keys) -> DataFrame:
        inline = frame.inlined.get((q.root.scope, ()), {})
        have = {label: c for label, c in inline.items() if c in base.columns}
        for name, column in computed.items():
            if column is not None:
                one = frame.df.groupBy(F.col("id").alias("ci")).agg(F.min(column).alias(f"x_{column}")) if frame.fans_out else None
                base = base.join(one, F.col("id") == F.col("ci"), "left").drop("ci") if one is not None else base.withColumn(f"x_{column}", F.col(column))
        bound = {k[1]: c for k, c in frame.ids.items() if k[0] is q.root.scope and k[1] and k in frame.required}
        bound |= {k[1]: c for k, c in frame.values.items() if k[0] is q.root.scope and frame.fans_out and c not in inline.values()}
        fields = self.fields(base, ["id"], q.shape, q.fields, frame.graphs, have, (frame, bound, ()), {n: f"x_{c}" for n, c in computed.items() if c})
        return fields.select("id", *dict.fromkeys(self._names(q.fields)), *(k for k, _ in keys))

    @staticmethod
    def _names(fields: list[Field]) -> list[str]:
        return [f.name if f.custom or not isinstance(f.what, Path) or len(f.what.steps) < 2 else f.what.steps[0].label for f in fields]

    def fields(self, base: DataFrame, keys: list[str], shape: Shape | None, fields: list[Field], graphs, have: dict, flat=None, computed: dict | None = None) -> DataFrame:
        """base (one row per keys; the last key is the node) with a column for each field."""
        out, nested = base, {}
        for f in fields:
            what = f.what
            if isinstance(what, Path) and len(what.steps) >= 2 and not f.custom:
                # Plain paths with a common beginning share one nested node.
                first = what.steps[0]
                slot = nested.setdefault((f.name if f.custom else first.label, first.key), (first, []))
                rest = Path(Scope(None), what.steps[1:], what.shape, what.prop)
                slot[1].append(Field(what.steps[-1].label, rest))
            elif isinstance(what, SubSelect) and len(what.path.steps) > 1:
                first = what.path.steps[0]
                slot = nested.setdefault((f.name if f.custom else first.label, first.key), (first, []))
                slot[1].append(Field(f.name, SubSelect(Path(Scope(None), what.path.steps[1:], what.path.shape, what.path.prop), what.fields, what.order, what.limit_, what.offset_)))
        done: set[str] = set()
        for f in fields:
            what, name = f.what, f.name
            if isinstance(what, Path) and len(what.steps) >= 2 and f.custom:
                out = self.leaf(out, keys, shape, what, name, graphs)
            elif isinstance(what, Path | SubSelect) and len((what.path if isinstance(what, SubSelect) else what).steps) >= 2:
                name = name if f.custom else (what.path if isinstance(what, SubSelect) else what).steps[0].label
                if name not in done:
                    first = next(v for k, v in nested.items() if k[0] == name)
                    out = self.relation(out, keys, shape, first[0], name, first[1], graphs, have, flat, None)
            elif isinstance(what, SubSelect):
                out = self.relation(out, keys, shape, what.path.steps[0], name, what.fields, graphs, have, flat, what)
            elif isinstance(what, Path) and not what.steps:
                if name != keys[-1]:
                    out = out.withColumn(name, F.col(keys[-1]))
            elif isinstance(what, Path):
                out = self.relation(out, keys, shape, what.steps[0], name, None, graphs, have, flat, None)
            elif computed and name in computed:
                out = out.withColumnRenamed(computed[name], name)
            else:
                out = self.per_node(out, keys, shape, what, name, graphs)
            done.add(name)
        return out

    def leaf(self, out: DataFrame, keys: list[str], shape: Shape | None, path: Path, name: str, graphs) -> DataFrame:
        """A named path's values: one if every step has at most one, else a list."""
        scope = Scope(shape)
        own = Frame(self, out.select(F.col(keys[-1]).alias("li")).distinct(), scope, "li", shape, graphs)
        value = own.value(Path(scope, path.steps, path.shape, path.prop), "left")
        single, at = True, shape
        for s in path.steps:
            p = self.property(at, s.label)
            single, at = single and p.single, self.value_shape(at, p, s)
        agg = F.min(value) if single else F.array_sort(F.collect_set(value))
        return out.join(own.df.groupBy("li").agg(agg.alias(name)), F.col(keys[-1]) == F.col("li"), "left").drop("li")

    def per_node(self, out: DataFrame, keys: list[str], shape: Shape | None, e: Expr, name: str, graphs) -> DataFrame:
        """A computed value for each node; counts of what is not there are 0."""
        paths = [x for x in walk(e) if isinstance(x, Path)]
        scope = paths[0].scope if paths else Scope(shape)
        own = Frame(self, out.select(F.col(keys[-1]).alias("pi")).distinct(), scope, "pi", shape, graphs)
        aggs: dict[int, Column] = {}
        plain = []
        if has_aggregate(e):
            for a in (x for x in walk(e) if isinstance(x, Agg)):
                value = F.col("pi") if isinstance(a.arg, Node) else self.column(own, a.arg, how="left")
                aggs[id(a)] = aggregate(a.name, value).alias(f"g{len(plain)}")
                plain.append((a, f"g{len(plain)}"))
            rows = own.df.groupBy("pi").agg(*aggs.values())
            column = compile(e, lambda x: next(F.col(n) for a, n in plain if a is x))
            rows = rows.select("pi", column.alias(name))
        else:
            value = self.column(own, e, how="left")
            rows = own.df.select("pi", value.alias(name)).groupBy("pi").agg(F.min(name).alias(name))
        out = out.join(rows, F.col(keys[-1]) == F.col("pi"), "left").drop("pi")
        return out.withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("bigint"))) if isinstance(e, Agg) and e.name == "COUNT" else out

    def relation(self, out: DataFrame, keys: list[str], shape: Shape | None, step: Step, name: str, children: list[Field] | None, graphs, have: dict, flat, sub: SubSelect | None) -> DataFrame:
        """A property as a column: a value or a node, or a list of them, sorted."""
        prop = self.property(shape, step.label)
        to = self.value_shape(shape, prop, step)
        node = keys[-1]
        place = (*(flat[2] if flat else ()), step.key)
        is_bound = flat is not None and place in flat[1]
        stored = step.where is None and shape is not None and self.source.inline(shape, step.label)
        if stored and not is_bound or stored and step.label in have:
            if step.label not in have:
                table = self.source.node(shape).select(F.col("id").alias("hi"), *(F.col(c).alias(f"h_{c}_{node}") for c in self.source.node(shape).columns if c != "id"))
                out = out.join(table, F.col(node) == F.col("hi"), "left").drop("hi")
                have |= {c[2 : -len(node) - 1]: c for c in table.columns if c != "hi"}
            column = have[step.label]
            if not prop.is_relation:
                return out.withColumn(name, F.col(column) if prop.single else F.when(F.col(column).isNotNull(), F.array(column)))
            if not children:
                value = F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("id")))
                return out.withColumn(name, value if prop.single else F.when(value.isNotNull(), F.array(value)))
            tree = self.simple(to, children)
            if tree is not None:
                out, value = self.struct_of(out, column, to, tree)
                return out.withColumn(name, value if prop.single else F.when(value.isNotNull(), F.array(value)))
            # A reference kept as a column: the node it names is described once for each id.
            member = f"m{next(self.names)}"
            ids = out.select(F.col(column).alias(member)).where(F.col(member).isNotNull()).distinct()
            inner = self.fields(ids, [member], to, children, graphs, {})
            body = F.struct(F.col(member).alias("id"), *(F.col(x) for x in dict.fromkeys(self._names(children))))
            rows = inner.select(F.col(member).alias("ri"), body.alias("rv"))
            out = out.join(rows, F.col(column) == F.col("ri"), "left").drop("ri")
            return out.withColumn(name, F.col("rv") if prop.single else F.when(F.col("rv").isNotNull(), F.array("rv"))).drop("rv")
        member, member_has = f"m{next(self.names)}", None
        if is_bound:
            frame, bound, at = flat
            carried = [frame.ids[(next(iter(frame.ids))[0], ())], *(bound[at[: k + 1]] for k in range(len(at)))]
            parent = [f"k{next(self.names)}" for _ in carried]
            pairs = frame.df.select(*(F.col(c).alias(n) for c, n in zip(carried, parent, strict=True)), F.col(bound[place]).alias(member)).where(F.col(member).isNotNull()).distinct()
            on = keys[-len(parent) :] if len(keys) >= len(parent) else keys
            flat_ = (frame, bound, place)
        else:
            on = [node]
            parent = [f"k{next(self.names)}"]
            pairs, names = self.edge_and_node(shape, prop, step, graphs, parent[0], member)
            member_has = names
            if not self.everything or node != "id":
                # Only what hangs on the nodes at hand is aggregated.
                pairs = pairs.join(out.select(F.col(node).alias("pk")), F.col(parent[0]) == F.col("pk"), "left_semi")
            flat_ = None
        if children or prop.is_relation:
            if not children:
                value = F.struct(F.col(member).alias("id"))
            elif is_bound or member_has is not None:
                pairs = self.fields(pairs, [*parent, member], to, children, graphs, dict(member_has or {}), flat_)
                value = F.struct(F.col(member).alias("id"), *(F.col(x) for x in dict.fromkeys(self._names(children))))
            else:
                inner = self.fields(pairs.select(F.col(member).alias("ni")).distinct(), ["ni"], to, children, graphs, {})
                names = list(dict.fromkeys(self._names(children)))
                pairs = pairs.join(inner.select("ni", *names), F.col(member) == F.col("ni")).drop("ni")
                value = F.struct(F.col(member).alias("id"), *(F.col(x) for x in names))
        else:
            value = F.col(member)
        if sub is not None and (sub.limit_ is not None or sub.offset_ is not None or sub.order):
            pairs = self.windowed(pairs, parent, member, to, sub, graphs)
        if prop.single:
            agg = F.min_by(value, F.col(member))
        elif sub is not None and sub.order:
            agg = F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank"), value.alias("v")))), lambda x: x["v"])
        else:
            agg = F.transform(F.array_sort(F.collect_list(F.struct(F.col(member).alias("k"), value.alias("v")))), lambda x: x["v"]) if children or prop.is_relation else F.array_sort(F.collect_set(value))
        rows = pairs.groupBy(*parent).agg(agg.alias(f"r_{name}"))
        out = out.join(rows, [F.col(a) == F.col(b) for a, b in zip(on, parent, strict=True)], "left").drop(*parent)
        return out.withColumn(name, F.col(f"r_{name}") if prop.single else F.coalesce(F.col(f"r_{name}"), F.array().cast(dict(rows.dtypes)[f"r_{name}"]))).drop(f"r_{name}")

    def simple(self, shape: Shape | None, fields: list[Field]) -> list[tuple] | None:
        """(name, step, property, nested) of fields that are all single inline values, nested ones too; else None."""
        if shape is None:
            return None
        slots: dict[str, tuple] = {}
        for f in fields:
            what = f.what
            path, inner = (what.path, what.fields) if isinstance(what, SubSelect) else (what, None)
            if not isinstance(path, Path) or not path.steps or isinstance(what, SubSelect) and (what.order or what.limit_ is not None or what.offset_ is not None):
                return None
            step = path.steps[0]
            if step.where is not None or not self.source.inline(shape, step.label) or len(path.steps) > 1 and f.custom:
                return None
            rest = None
            if len(path.steps) > 1:
                below = Path(Scope(None), path.steps[1:], path.shape, path.prop)
                rest = [Field(path.steps[-1].label, below if inner is None else SubSelect(below, inner))]
            elif inner is not None:
                rest = list(inner)
            name = f.name if len(path.steps) == 1 else step.label
            known = slots.get(name)
            if known is not None and rest is not None and known[1] is not None:
                known[1].extend(rest)
            else:
                slots[name] = (step, rest)
        out = []
        for name, (step, rest) in slots.items():
            prop = self.property(shape, step.label)
            nested = None if rest is None else self.simple(self.value_shape(shape, prop, step), rest)
            if rest is not None and nested is None:
                return None
            out.append((name, step, prop, nested))
        return out

    def struct_of(self, out: DataFrame, column: str, shape: Shape, tree: list[tuple]) -> tuple[DataFrame, Column]:
        """The node that a column names as a struct: its table joined by its key, one row for one row."""
        table = self.source.node(shape)
        names = {c: f"v{next(self.names)}" for c in table.columns}
        out = out.join(table.select(*(F.col(c).alias(n) for c, n in names.items())), F.col(column) == F.col(names["id"]), "left").drop(names["id"])
        parts = []
        for name, step, prop, nested in tree:
            here = F.col(names[step.label])
            if nested is not None:
                out, value = self.struct_of(out, names[step.label], self.value_shape(shape, prop, step), nested)
            else:
                value = F.when(here.isNotNull(), F.struct(here.alias("id"))) if prop.is_relation else here
            parts.append((value if prop.single else F.when(here.isNotNull(), F.array(value))).alias(name))
        return out, F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("id"), *parts))

    def windowed(self, pairs: DataFrame, parent: list[str], member: str, to: Shape | None, sub: SubSelect, graphs) -> DataFrame:
        order = []
        for e, direction in sub.order:
            name = f"w{next(self.names)}"
            path = next(x for x in walk(e) if isinstance(x, Path))
            own = Frame(self, pairs.select(F.col(member).alias("wi")).distinct(), path.scope, "wi", to, graphs)
            value = self.column(own, e, how="left")
            pairs = pairs.join(own.df.groupBy("wi").agg((F.min if direction == "ASC" else F.max)(value).alias(name)), F.col(member) == F.col("wi"), "left").drop("wi")
            order.append(F.col(name).asc_nulls_last() if direction == "ASC" else F.col(name).desc_nulls_last())
        rank = F.row_number().over(Window.partitionBy(*parent).orderBy(*order, F.col(member).asc()))
        pairs = pairs.withColumn("rank", rank)
        lo = sub.offset_ or 0
        pairs = pairs.where(F.col("rank") > lo)
        return pairs if sub.limit_ is None else pairs.where(F.col("rank") <= lo + sub.limit_)

    def fans(self, a: Agg) -> frozenset[tuple]:
        """The many-valued relations that an aggregate walks: each path up to its last one."""
        out = set()
        for path in (x for x in walk(a.arg) if isinstance(x, Path)):
            shape, until = path.scope.shape, 0
            for k, step in enumerate(path.steps):
                if shape is None or shape.find(step.label) is None:
                    until = k + 1
                    break
                prop = shape.property(step.label)
                until = until if prop.single else k + 1
                shape = self.source.catalog.shape(step.cast) if step.cast else shape.value_shape(prop)
            out.add(tuple(step.key for step in path.steps[:until]))
        return frozenset(out - {()})

    def grouped(self, q: Select) -> DataFrame:
        """Aggregates that walk different relations are grouped apart and joined by the keys: relations never multiply each other.

        This changes nothing, as an aggregate is one of the set of values, or of (member, value) pairs, that a group holds.
        """
        aggs: list[tuple[Agg, str]] = []
        for e in (*(f.what for f in q.fields if f.name not in q.keys), *q.havings):
            for a in (x for x in walk(e) if isinstance(x, Agg)):
                if not any(a is b for b, _ in aggs):
                    aggs.append((a, f"a{len(aggs)}"))
        by: dict[frozenset, list] = {}
        for a in aggs:
            by.setdefault(self.fans(a[0]), []).append(a)
        parts = list(by.values()) if sum(map(bool, by)) > 1 else [aggs]
        keys = [f"gk{k}" for k in range(sum(f.name in q.keys for f in q.fields))]
        out = self.grouped_part(q, parts[0])
        for part in parts[1:]:
            other = self.grouped_part(q, part).withColumnsRenamed({k: f"o_{k}" for k in keys})
            out = out.join(other, [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in keys] or F.lit(True)).drop(*(f"o_{k}" for k in keys))
        named = dict(zip((f.name for f in q.fields if f.name in q.keys), keys, strict=True))
        find = lambda x: next(F.col(n) for a, n in aggs if a is x)
        for h in q.havings:
            out = out.where(compile(h, find))
        out = out.select(*(F.col(named[f.name]).alias(f.name) if f.name in q.keys else compile(f.what, find).alias(f.name) for f in q.fields))
        if q.group_order:
            out = out.orderBy(*(F.col(n).asc_nulls_last() if d == "ASC" else F.col(n).desc_nulls_last() for n, d in q.group_order))
        if q.offset_:
            out = out.offset(q.offset_)
        return out if q.limit_ is None else out.limit(q.limit_)

    def grouped_part(self, q: Select, aggs: list[tuple[Agg, str]]) -> DataFrame:
        """The group keys (gk0, ...) and some aggregates by name."""
        frame = self.roots(q)
        keys = [(f.name, self.column(frame, f.what, how="left")) for f in q.fields if f.name in q.keys]
        columns = []
        for a, name in aggs:
            value = F.col("id") if isinstance(a.arg, Node) or isinstance(a.arg, Path) and not a.arg.steps else self.column(frame, a.arg, how="left")
            columns.append((name, a.name, value, a))
        df = frame.df
        named = [(n, f"gk{k}") for k, (n, _) in enumerate(keys)]
        df = df.select("*", *(c.alias(g) for (_, c), (_, g) in zip(keys, named, strict=True)), *(v.alias(f"v_{n}") for n, _, v, _ in columns))
        sums = [(n, a) for n, kind, _, a in columns if kind in ("SUM", "AVG")]
        members = lambda a: isinstance(a.arg, Node) or isinstance(a.arg, Path) and not a.arg.steps

        def total(kind: str, n: str, a: Agg) -> Column:
            return F.count("*") if kind == "COUNT" and members(a) and not frame.fans_out else aggregate(kind, F.col(f"v_{n}"))

        now = [total(kind, n, a).alias(n) for n, kind, _, a in columns if kind not in ("SUM", "AVG") or not frame.fans_out]
        out = df.groupBy(*(g for _, g in named)).agg(*(now or [F.count("*").alias("unused")]))
        if frame.fans_out:
            # Sums are over (member, value) pairs, not over rows that other paths have multiplied.
            for n, a in sums:
                once = df.select(*(g for _, g in named), "id", f"v_{n}").distinct().groupBy(*(F.col(g).alias(f"j_{g}") for _, g in named)).agg(aggregate(a.name, F.col(f"v_{n}")).alias(n))
                out = out.join(once, [F.col(g).eqNullSafe(F.col(f"j_{g}")) for _, g in named] or F.lit(True), "left").drop(*(f"j_{g}" for _, g in named))
        return out.drop("unused")

    def run(self, q: Select):
        if q.null_subject:
            return {"count": 0, "ask": False}.get(q.kind)
        try:
            df = self.frame(q)
        except UnresolvedContext:
            return None
        rows = [plain(r.asDict(recursive=True)) for r in df.toLocalIterator()]
        if q.kind in ("count", "ask"):
            got = rows[0]["count" if q.kind == "count" else "exists"] if len(rows) == 1 else None
            if not isinstance(got, bool if q.kind == "ask" else int) or got < 0:
                raise QueryError(f"a source answered a {q.kind} with {rows!r}")
            return got
        if q.one_ or q.subject is not None:
            return rows[0] if rows else None
        return rows


def plain(x):
    return x


def aggregate(name: str, value: Column) -> Column:
    """Counts are of distinct values."""
    return {"COUNT": F.count_distinct, "MIN": F.min, "MAX": F.max, "SUM": F.sum, "AVG": F.avg, "SAMPLE": F.any_value, "GROUP_CONCAT": lambda v: F.array_join(F.array_sort(F.collect_set(v.cast("string"))), " ")}[name](value)


def _hops(e: Expr) -> bool:
    return any(isinstance(x, Path) and len(x.steps) > 1 for x in walk(e))


def _read(e: Expr):
    """Paths read anywhere in a body, nested quantifiers included."""
    for x in walk(e):
        yield x
        if isinstance(x, Quant):
            yield x.path
            yield from _read(x.body)
