"""Create, update, upsert and delete: a store is a version number and a quad table; a mutation makes the next version.

Deletions are anti joins against what goes, insertions a union, and the result is
a set again.  Nothing is changed in place, so readers keep their version and
a transaction is a snapshot that is swapped in if nobody was faster.
"""

from __future__ import annotations

import copy
import functools
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, date, datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.compile import kind
from ..functions.expr import Ctx, Expr, Lit, Node, Path, QueryError, Scope, wrap
from ..operators.closure import transitive_closure
from ..operators.cut import cut
from ..operators.validate import assert_valid
from ..paths import Ref
from ..shapes import DEFAULT, RDF_TYPE, XSD, Catalog, Property, Shape
from ..sources.quads import ALL_ONTOLOGIES, ALL_SHAPES, COLUMNS, GRAPH_KIND, REGISTRY, QuadSource, quads_frame
from .planner import Frame, Planner
from .query import id_of

DATA_ROOT = "urn:data:"


def predicate_of(p: Property) -> str:
    if not isinstance(p.path, Ref):
        raise QueryError(f"{p.label} is a path, so it cannot be written")
    return p.path.iri


def term(p: Property, v: Any) -> tuple[str, str, str | None, str | None]:
    """(kind, value, datatype, language) of a value written to a property."""
    if isinstance(v, dict):
        id_ = str(v["id"])
        return "blank" if id_.startswith("_:") else "iri", id_, None, None
    declared = p.datatype or "string"
    if isinstance(v, bool):
        return "literal", "true" if v else "false", XSD + "boolean", None
    if isinstance(v, datetime):
        moment = v if v.tzinfo else v.replace(tzinfo=UTC)
        text = moment.astimezone(UTC).strftime("%Y-%m-%d" if declared == "date" else "%Y-%m-%dT%H:%M:%S.%f")
        return "literal", text if declared == "date" else text[:-3] + "Z", XSD + declared, None
    if isinstance(v, date):
        return "literal", v.isoformat(), XSD + "date", None
    if isinstance(v, float) and v.is_integer() and declared in ("integer", "long"):
        v = int(v)
    return "literal", str(v), XSD + (declared if not isinstance(v, str) or declared != "integer" else "string"), None


def _is_nested(v: Any) -> bool:
    return isinstance(v, dict) and set(v) != {"id"} and not set(v) & {"add", "remove"}


@dataclass
class Mutation:
    shape: Shape | None
    data: Any = None
    ids: list = field(default_factory=list)
    mode: str = "for"
    condition: Expr | None = None
    graph: str | None = None
    keep_incoming: bool = False
    tx_id: str | None = None
    op: str = ""

    def _with(self, **changes):
        out = copy.copy(self)
        out.__dict__.update(changes)
        return out

    def into(self, graph: str):
        return self._with(graph=graph)

    def run(self, store: Store, context: dict | None = None) -> Any:
        return store.apply(self, context)

    def to_json(self) -> dict:
        return mutation_to_json(self)


class Create(Mutation):
    def __init__(self, shape: Shape, data: dict):
        if any(isinstance(v, Expr) and not isinstance(v, Ctx) for v in data.values()):
            raise QueryError("a create takes no computed values: there is nothing to compute from")
        super().__init__(shape, data, op="create")


class Update(Mutation):
    def __init__(self, shape: Shape, data: dict | Callable):
        self.root = Path(Scope(shape), (), shape)
        super().__init__(shape, data(self.root) if callable(data) else data, op="update")

    def for_(self, node) -> Update: return self._with(ids=[node if isinstance(node, Ctx) else id_of(node)], mode="for")
    by_id = for_
    def for_all(self) -> Update: return self._with(mode="forAll")
    def where(self, condition: Callable) -> Update: return self._with(mode="where", condition=wrap(condition(self.root)))
    forAll = for_all


class Upsert(Mutation):
    def __init__(self, shape: Shape, data: dict):
        if any(isinstance(v, Expr) and not isinstance(v, Ctx) for v in data.values()):
            raise QueryError("an upsert takes no computed values: the node may not be there yet")
        super().__init__(shape, data, op="upsert")

    def for_(self, node) -> Upsert: return self._with(ids=[id_of(node)])
    by_id = for_


class Delete(Mutation):
    def __init__(self, shape: Shape | None, ids: list | tuple = (), mode: str = "ids"):
        self.root = Path(Scope(shape), (), shape) if shape else None
        super().__init__(shape, ids=[i if isinstance(i, Ctx) else id_of(i) for i in ids], mode=mode, op="delete")

    def all(self) -> Delete: return self._with(mode="all")
    def where(self, condition: Callable) -> Delete: return self._with(mode="where", condition=wrap(condition(self.root)))
    def keep_links(self) -> Delete: return self._with(keep_incoming=True)

    @staticmethod
    def shapeless(ids: list) -> Delete:
        return Delete(None, ids, "shapeless")


def put(base: DataFrame, new: DataFrame, few: bool) -> DataFrame:
    """base, a set of quads, with those of new that it lacks; base is not shuffled if new is few.

    What is fresh is computed once and kept, so base stands in the new version's plan once.
    """
    side = F.broadcast if few else (lambda df: df)
    rows = new.distinct().select(*(F.col(c).alias(f"d_{c}") for c in COLUMNS))
    same = [F.col(c).eqNullSafe(F.col(f"d_{c}")) for c in COLUMNS]
    known = base.join(side(rows), same, "left_semi")
    fresh = rows.join(side(known), same, "left_anti").select(*(F.col(f"d_{c}").alias(c) for c in COLUMNS))
    return base.unionByName(cut(fresh))


class Conflict(RuntimeError):
    """Another transaction was committed first."""


class Store(QuadSource):
    """A quad source that can be changed; each change is a new version, its lineage cut every ``cut_after`` changes."""

    def __init__(self, quads: DataFrame, catalog: Catalog = DEFAULT, inference: str = "ontology", cut_after: int = 8, mint: Callable[[], str] | None = None):
        super().__init__(quads, catalog, inference)
        self.version, self.cut_after, self.mint = 0, cut_after, mint or (lambda: DATA_ROOT + uuid.uuid4().hex)
        self.listeners: list[Callable] = []
        self.transactions: dict[str, Transaction] = {}

    # Versions
    def _swap(self, quads: DataFrame) -> None:
        self.version += 1
        self.quads = cut(quads) if self.version % self.cut_after == 0 else quads

    def begin(self, idle: float = 30.0) -> Transaction:
        tx = Transaction(self, idle)
        self.transactions[tx.id] = tx
        return tx

    def apply(self, m: Mutation, context: dict | None = None):
        if m.tx_id is not None:
            if m.tx_id not in self.transactions:
                raise QueryError(f"no transaction {m.tx_id!r}")
            return self.transactions[m.tx_id].apply(m._with(tx_id=None), context)
        quads, result = Writer(self, context).write(m)
        self._swap(quads)
        for listener in list(self.listeners):
            listener(m, result)
        return result

    # Graphs
    def graph_replace(self, graph: str, quads: DataFrame, kind_: str = "data") -> None:
        """The graph's content becomes these quads; the registry records it."""
        rest = self.quads.where(~F.coalesce(F.col("g") == graph, F.lit(False)) & ~F.coalesce((F.col("g") == REGISTRY) & (F.col("s") == graph), F.lit(False)))
        record = quads_frame(self.spark, [(REGISTRY, graph, GRAPH_KIND, "literal", kind_, XSD + "string", None)])
        self._swap(rest.unionByName(quads.withColumn("g", F.lit(graph)).select(*COLUMNS).distinct()).unionByName(record))

    def graph_create(self, graph: str, quads: DataFrame | None = None, kind_: str = "data") -> None:
        if not self.quads.where((F.col("g") == REGISTRY) & (F.col("s") == graph)).isEmpty():
            raise QueryError(f"the graph {graph} exists")
        self.graph_replace(graph, quads if quads is not None else quads_frame(self.spark, []), kind_)

    def graph_patch(self, graph: str, add: DataFrame | None = None, remove: DataFrame | None = None) -> None:
        out, key = self.quads, [c for c in COLUMNS if c != "g"]
        if remove is not None:
            gone = remove.select(*(F.col(c).alias(f"d_{c}") for c in key)).distinct()
            out = out.join(gone, [F.col("g") == graph, *(F.col(c).eqNullSafe(F.col(f"d_{c}")) for c in key)], "left_anti")
        if add is not None:
            out = put(out, add.withColumn("g", F.lit(graph)).select(*COLUMNS), few=False)
        self._swap(out)

    def graph_drop(self, graph: str) -> None:
        self._swap(self.quads.where(~F.coalesce(F.col("g") == graph, F.lit(False)) & ~F.coalesce((F.col("g") == REGISTRY) & (F.col("s") == graph), F.lit(False))))


class Transaction:
    """A snapshot; commit swaps it in if the store still has the version it began with."""

    def __init__(self, store: Store, idle: float):
        self.id, self.store, self.idle, self.used = f"tx-{uuid.uuid4().hex[:12]}", store, idle, time.monotonic()
        self.snapshot = Store(store.quads, store.catalog, store.inference, store.cut_after, store.mint)
        self.began, self.log, self.open = store.version, [], True

    def _check(self) -> None:
        if not self.open or time.monotonic() - self.used > self.idle:
            self.rollback()
            raise QueryError(f"the transaction {self.id} is over")
        self.used = time.monotonic()

    def apply(self, m: Mutation, context: dict | None = None):
        self._check()
        result = self.snapshot.apply(m, context)
        self.log.append((m, result))
        return result

    def run(self, query, context: dict | None = None):
        self._check()
        return query.run(self.snapshot, context)

    def commit(self) -> None:
        self._check()
        if self.store.version != self.began:
            self.rollback()
            raise Conflict(self.id)
        self.rollback()
        self.store._swap(self.snapshot.quads)
        for m, result in self.log:
            for listener in list(self.store.listeners):
                listener(m, result)

    def rollback(self) -> None:
        self.open = False
        self.store.transactions.pop(self.id, None)


class Writer:
    def __init__(self, store: Store, context: dict | None):
        self.store, self.planner = store, Planner(store, context)
        #: Existing nodes that this change links as owned: id, property, the classes it may have.
        self.owned_links: list[tuple[str, str, frozenset[str]]] = []

    def write(self, m: Mutation) -> tuple[DataFrame, Any]:
        if any(isinstance(i, Ctx) for i in m.ids):
            m = m._with(ids=[self.planner.resolved(i) if isinstance(i, Ctx) else i for i in m.ids])
        out = getattr(self, m.op)(m)
        self.check_owned_links()
        return out

    def check_owned_links(self) -> None:
        """An owner takes what it owns along when it goes, so a node of another class may not be linked as owned; one without a class may."""
        if not self.owned_links:
            return
        wanted = sorted({i for i, _, _ in self.owned_links})
        typed = self.store.quads.where((F.col("p") == RDF_TYPE) & F.col("s").isin(wanted)).groupBy("s").agg(F.collect_set("o_value").alias("classes"))
        classes = {r["s"]: set(r["classes"]) for r in typed.toLocalIterator()}  # as many as the change names
        for i, label, accepted in self.owned_links:
            if classes.get(i) and not classes[i] & accepted:
                raise QueryError(f"{label} owns its values, and {i} is of another class: {', '.join(sorted(classes[i]))}")

    def rows(self, shape: Shape, id_: str, data: dict, graph: str | None, out: list) -> dict:
        """Appends the quads of a description and its nested ones; returns it with ids."""
        out.append((graph, id_, RDF_TYPE, "iri", shape.target(), None, None))
        echo: dict = {"id": id_}
        for label, value in data.items():
            if label in ("__id", "__shape", "id") or value is None:
                continue
            p = shape.property(label)
            values = [self.node(shape, p, v, graph, out) for v in (value if isinstance(value, list) else [value])]
            out += [(graph, id_, predicate_of(p), *term(p, v)) for v in values]
            echo[label] = values if isinstance(value, list) else values[0]
        return echo

    def node(self, shape: Shape, p: Property, v: Any, graph: str | None, out: list) -> Any:
        """A value as it is stored: nested descriptions become nodes of their own, context values ids."""
        if isinstance(v, Ctx):
            v = {"id": self.planner.resolved(v)}
        elif isinstance(v, Node):
            v = {"id": v.id}
        if not _is_nested(v):
            to = shape.value_shape(p)
            if p.contains and isinstance(p.path, Ref) and to is not None and to.target_class and isinstance(v, dict):
                catalog = self.store.catalog
                accepted = {c for x in (to.target_class, p.class_) if x for c in catalog.classes_under(x, self.store.inference)}
                self.owned_links.append((v["id"], p.label, frozenset(accepted)))
            return v
        to = self.store.catalog.shape(v["__shape"]) if "__shape" in v else shape.value_shape(p)
        if to is None:
            raise QueryError(f"{p.label} has no shape to create a node of")
        id_ = v.get("__id") or ("_:" + uuid.uuid4().hex if p.node_kind == "BlankNode" else self.store.mint())
        self.rows(to, id_, v, graph, out)
        return {"id": id_}

    def inserted(self, base: DataFrame, rows: list) -> DataFrame:
        return put(base, quads_frame(self.store.spark, rows), few=True) if rows else base

    def create(self, m: Mutation):
        plain = {k: v for k, v in m.data.items() if not isinstance(v, Expr)}
        assert_valid(m.shape, plain, "partial" if len(plain) < len(m.data) else "complete")
        rows: list = []
        echo = self.rows(m.shape, m.data.get("__id") or self.store.mint(), m.data, m.graph, rows)
        return self.inserted(self.store.quads, rows), echo

    def upsert(self, m: Mutation):
        return self._update(m, typed=False)

    def update(self, m: Mutation):
        return self._update(m, typed=True)

    def targets(self, m: Mutation) -> Frame:
        scope = m.root.scope if getattr(m, "root", None) is not None else Scope(m.shape)
        if m.mode in ("for", "ids"):
            ids = self.store.spark.createDataFrame([(i,) for i in m.ids], "id string")
            typed = self.store.quads.where(F.col("p") == RDF_TYPE).select(F.col("s").alias("id"))
            df = ids.join(typed.distinct(), "id", "left_semi") if m.op == "update" else ids
            return Frame(self.planner, df, scope, "id", m.shape, None)
        frame = Frame(self.planner, self.store.scan(m.shape), scope, "id", m.shape, None)
        self.planner.filter(frame, m.condition, required=m.op == "delete")
        return frame

    def _update(self, m: Mutation, typed: bool):
        shape = m.shape
        plain = {k: v for k, v in m.data.items() if not isinstance(v, Expr)}
        assert_valid(shape, {k: v for k, v in plain.items() if v is not None}, "partial")
        frame = self.targets(m)
        ids = cut(frame.df.select("id").distinct())
        quads, rows, echo, owned = self.store.quads, [], {}, []
        gone, added = [], []  # (predicate, value or None), (predicate, kind, value, datatype, language)
        computed = []
        for label, value in m.data.items():
            if label in ("id", "__id"):
                continue
            p = shape.property(label)
            iri = predicate_of(p)
            if isinstance(value, Expr) and not isinstance(value, Ctx | Node | Lit):
                computed.append((p, iri, value))
                continue
            if isinstance(value, Lit):
                value = value.value
            if isinstance(value, dict) and set(value) & {"add", "remove"} and set(value) <= {"add", "remove"}:
                more = [self.node(shape, p, v, m.graph, rows) for v in value.get("add") or []]
                less = [v if isinstance(v, dict) else {"id": v} if p.is_relation else v for v in value.get("remove") or []]
                gone += [(iri, term(p, v)[1]) for v in less]
                added += [(iri, *term(p, v)) for v in more]
                echo[label] = {"added": more, "removed": less}
                continue
            values = [] if value is None else [self.node(shape, p, v, m.graph, rows) for v in (value if isinstance(value, list) else [value])]
            gone.append((iri, None))
            if p.contains:
                owned.append((iri, [term(p, v)[1] for v in values]))
            added += [(iri, *term(p, v)) for v in values]
            echo[label] = {"updatedTo": values} if isinstance(value, list) else values[0] if values else None
        new = None
        for p, iri, e in computed:
            own = Frame(self.planner, frame.df.select(F.col("id")).distinct(), m.root.scope, "id", shape, None)
            column = self.planner.column(own, e, how="left")
            text = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if kind(e) == "dateTime" else column.cast("string")
            part = own.df.select(F.lit(m.graph).cast("string").alias("g"), F.col("id").alias("s"), F.lit(iri).alias("p"), F.lit("iri" if p.is_relation else "literal").alias("o_kind"), text.alias("o_value"), F.lit(None if p.is_relation else XSD + (p.datatype or "string")).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang")).where("o_value is not null")
            # What cannot be computed leaves nothing to insert; the old value goes all the same.
            new = part if new is None else new.unionByName(part)
            gone.append((iri, None))
            echo[p.label] = None
        if new is not None:
            new = cut(new)
        for iri, keep in owned:
            left = quads.where(F.col("p") == iri).join(ids, F.col("s") == F.col("id"), "left_semi")
            left = left.where(~F.col("o_value").isin(keep)) if keep else left
            quads = self.without_nodes(quads, left.select(F.col("o_value").alias("id")).distinct(), False)
        if gone:
            dropped = F.lit(False)
            for p in {p for p, _ in gone}:
                values = [v for q, v in gone if q == p]
                dropped = dropped | ((F.col("p") == p) & (F.lit(True) if None in values else F.col("o_value").isin(values)))
            quads = quads.join(ids, (F.col("s") == F.col("id")) & dropped, "left_anti")
        more = []
        if added:
            names = ("p", "o_kind", "o_value", "o_datatype", "o_lang")
            written = F.array(*(F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(names, x, strict=True))) for x in added))
            more.append(ids.select(F.lit(m.graph).cast("string").alias("g"), F.col("id").alias("s"), F.explode(written).alias("x")).select("g", "s", "x.*").select(*COLUMNS))
        if not typed:
            rows.append((m.graph, m.ids[0], RDF_TYPE, "iri", shape.target(), None, None))
        if new is not None:
            more.append(new)
        few = m.mode in ("for", "ids")
        if few:
            echo = {"id": m.ids[0]} | echo
            if typed and ids.isEmpty():
                rows = []
        else:
            echo = {"count": ids.count()}
        if rows:
            more.append(quads_frame(self.store.spark, rows))
        return put(quads, functools.reduce(DataFrame.unionByName, more), few) if more else quads, echo

    def owned_edges(self) -> DataFrame:
        """(s, o) along owning predicates and to blank nodes."""
        owning = {predicate_of(p) for s in self.store.catalog.shapes.values() for p in s.own if p.contains}
        q = self.store.quads
        return q.where((F.col("o_kind") == "blank") | (F.col("p").isin(sorted(owning)) & (F.col("o_kind") != "literal") if owning else F.lit(False))).select("s", F.col("o_value").alias("o"))

    def without_nodes(self, quads: DataFrame, ids: DataFrame, incoming: bool) -> DataFrame:
        """quads without the nodes, what they own (also through cycles) and, if wanted, links to any of these."""
        below = transitive_closure(self.owned_edges(), ids.select(F.col("id").alias("s"))).select(F.col("o").alias("id"))
        every = cut(ids.select("id").unionByName(below).distinct())
        out = quads.join(every, F.col("s") == F.col("id"), "left_anti")
        dead = every if incoming else every.join(ids, "id", "left_anti")
        return out.join(dead.select(F.col("id").alias("dead")), (F.col("o_value") == F.col("dead")) & (F.col("o_kind") != "literal"), "left_anti")

    def delete(self, m: Mutation):
        quads = self.store.quads
        if m.keep_incoming and m.mode not in ("ids", "shapeless"):
            raise QueryError("links can only be kept when ids are deleted")
        if m.mode == "shapeless":
            guarded = {REGISTRY, *(self.store.resolve((ALL_ONTOLOGIES,)) or ()), *(self.store.resolve((ALL_SHAPES,)) or ())}
            kept = quads.where(F.col("g").isin(sorted(guarded)))
            ids = self.store.spark.createDataFrame([(i,) for i in m.ids], "id string")
            rest = quads.where(F.col("g").isNull() | ~F.col("g").isin(sorted(guarded))).join(ids, F.col("s") == F.col("id"), "left_anti")
            if not m.keep_incoming:
                rest = rest.join(ids, (F.col("o_value") == F.col("id")) & (F.col("o_kind") != "literal"), "left_anti")
            return rest.unionByName(kept), {"deleted": list(m.ids), "count": len(m.ids)}
        if m.mode == "ids":
            asked = self.store.spark.createDataFrame([(i,) for i in m.ids], "id string")
            ids = cut(asked.join(self.store.scan(m.shape), "id", "left_semi").distinct())
            found = [r["id"] for r in ids.toLocalIterator()]
            return self.without_nodes(quads, ids, not m.keep_incoming), {"deleted": [i for i in m.ids if i in found], "count": len(found)}
        ids = cut(self.targets(m).df.select("id").distinct())
        return self.without_nodes(quads, ids, False), {"deleted": [], "count": ids.count()}


# Wire form


def _data_json(v):
    from .wire import value_json

    if isinstance(v, Expr):
        return value_json(v)
    if isinstance(v, dict):
        if set(v) == {"id"}:
            return {"@id": v["id"]}
        if set(v) <= {"add", "remove"} and v:
            return {f"@{k}": [_data_json(x) for x in xs] for k, xs in v.items()}
        return {k: _data_json(x) for k, x in v.items()}
    if isinstance(v, list):
        return {"@list": [_data_json(x) for x in v]}
    if v is None:
        return {"@unset": True}
    return value_json(Lit(v))


def mutation_to_json(m: Mutation) -> dict:
    from .wire import VERSION, condition_json, value_json

    out: dict = {"v": VERSION, "op": m.op}
    if m.shape is not None:
        out["shape"] = m.shape.iri
    ids = [value_json(i) if isinstance(i, Ctx) else i for i in m.ids]
    if m.op in ("create", "update", "upsert"):
        out["data"] = {k: v if k in ("__id", "__shape") else _data_json(v) for k, v in m.data.items()}
    if m.op in ("update", "upsert"):
        out["mode"] = m.mode
        if m.mode == "for":
            out["targetId"] = ids[0]
    if m.op == "delete":
        out["mode"] = m.mode
        if m.mode in ("ids", "shapeless"):
            out["ids"] = ids
        if m.keep_incoming:
            out["keepIncoming"] = True
    if m.condition is not None:
        out["where"] = condition_json(m.condition)
    if m.tx_id:
        out["txId"] = m.tx_id
    return out


def mutation_from_json(j: dict, catalog: Catalog = DEFAULT, refuse_keep_incoming: bool = False) -> Mutation:
    from .wire import Reader

    reader, mode = Reader(catalog), j.get("mode", "for")
    if mode == "shapeless":
        if "shape" in j:
            raise QueryError("a shapeless delete names no shape")
        shape = None
    else:
        shape = catalog.shape(j["shape"])
    if j.get("keepIncoming") not in (None, False, True) or j.get("keepIncoming") and (refuse_keep_incoming or mode not in ("ids", "shapeless")):
        raise QueryError("keepIncoming is refused here")

    def data(root, v):
        if isinstance(v, dict):
            if "@list" in v:
                return [data(root, x) for x in v["@list"]]
            if v.get("@unset"):
                return None
            if "@add" in v or "@remove" in v:
                return {k[1:]: [data(root, x) for x in xs] for k, xs in v.items()}
            if set(v) == {"@id"}:
                return {"id": v["@id"]}
            if "@date" in v:
                return reader.value(root, v).value
            if any(k.startswith("@") for k in v):
                return reader.value(root, v)
            return {k: x if k.startswith("__") else data(root, x) for k, x in v.items()}
        return reader.value(root, v) if isinstance(v, list) else v

    target = lambda v: reader.value(None, v) if isinstance(v, dict) else v
    if j["op"] == "create":
        root = Path(Scope(shape), (), shape)
        out = Create(shape, data(root, j["data"]))
    elif j["op"] == "update":
        out = Update(shape, {})
        out.data = data(out.root, j["data"])
        out.mode = mode
    elif j["op"] == "upsert":
        out = Upsert(shape, data(Path(Scope(shape), (), shape), j["data"]))
    else:
        out = Delete(shape, [], mode)
        out.ids = [target(i) for i in j.get("ids", ())]
        out.keep_incoming = bool(j.get("keepIncoming"))
    if j["op"] in ("update", "upsert") and mode == "for":
        out.ids = [target(j["targetId"])]
    if "where" in j:
        out.condition = reader.condition(out.root, j["where"])
    out.tx_id = j.get("txId")
    return out
