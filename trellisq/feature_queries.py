"""Registered queries for single features: paths that repeat, node terms, changes, graphs, routing, validation; each with its SQL twin."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.expr import Ctx, E
from .paths import parse
from .plans.mutations import Delete, Store
from .plans.query import Triples
from .queries import _quads, _store, query
from .shapes import RDF_TYPE, Catalog, Shape, literal, relation
from .sources.quads import QuadSource
from .sources.router import Router
from .sources.warehouse import shape

_IRI = "'urn:Nation:' || "


def _chain(src) -> QuadSource:
    """Quads that link each nation to the one of twice its key, modulo 25."""
    node = lambda c: F.concat(F.lit("urn:Nation:"), c.cast("string"))
    key, null = F.col("key"), F.lit(None).cast("string")
    rows = src.node(shape("Nation")).select(null.alias("g"), node(key).alias("s"), F.lit("urn:x:next").alias("p"), F.lit("iri").alias("o_kind"), node(key * 2 % 25).alias("o_value"), null.alias("o_datatype"), null.alias("o_lang"))
    return QuadSource(rows, src.catalog)


_STEPS = "e AS (SELECT n_nationkey AS s, (n_nationkey * 2) % 25 AS o FROM nation), c AS (SELECT s, o FROM e UNION SELECT c.s, e.o FROM c JOIN e ON c.o = e.s)"


def _walk(src, path: str) -> DataFrame:
    return _chain(src).step(parse(path, base="urn:x:")).select("s", "o")


@query(f"WITH RECURSIVE {_STEPS} SELECT {_IRI} s AS s, {_IRI} o AS o FROM c")
def path_one_or_more(src):
    return _walk(src, "next+")


@query(f"WITH RECURSIVE {_STEPS} SELECT {_IRI} s AS s, {_IRI} o AS o FROM (SELECT s, o FROM c UNION SELECT s, s FROM e)")
def path_zero_or_more(src):
    return _walk(src, "next*")


@query(f"SELECT {_IRI} s AS s, {_IRI} o AS o FROM (SELECT n_nationkey AS s, (n_nationkey * 2) % 25 AS o FROM nation UNION SELECT n_nationkey, n_nationkey FROM nation)")
def path_zero_or_one(src):
    return _walk(src, "next?")


@query("SELECT 'urn:Region:' || n_regionkey AS s, 'urn:Nation:' || n_nationkey AS o FROM nation")
def path_negated_inverse(src):
    return _quads(src, "Nation").step(parse(f"!(^<{RDF_TYPE}>)", base="urn:w:")).select("s", "o")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey = 7")
def one_subject(src):
    return shape("Nation").select(lambda n: n.name).for_(7).df(src)


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey = 3")
def node_equality(src):
    return shape("Customer").select().where(lambda c: c.nation.equals({"id": 3})).df(src)


@query("SELECT DISTINCT c_nationkey AS id FROM customer WHERE c_custkey = 5")
def member_equality(src):
    return shape("Nation").select().where(lambda n: n.customers.equals({"id": 5})).df(src)


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def quantifier_negated(src):
    return shape("Customer").select().where(lambda c: ~c.orders.some(lambda o: o.total.gt(100000.0))).df(src)


@query("SELECT s_suppkey AS id FROM supplier WHERE s_nationkey = 4")
def context_reference(src):
    return shape("Supplier").select().where(lambda s: s.nation.equals(Ctx("home"))).df(src, {"home": {"id": 4}})


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def minus_shape(src):
    return shape("Document").select().minus(shape("Label")).df(src)


@query("SELECT p_partkey AS id FROM part WHERE NOT p_size < 10 AND NOT p_retailprice > 1000")
def minus_chained(src):
    return shape("Part").select().minus(lambda p: p.size.lt(10)).minus(lambda p: p.price.gt(1000.0)).df(src)


@query("SELECT p_partkey AS id, p_name AS name FROM part ORDER BY p_retailprice * p_size DESC, p_partkey LIMIT 20")
def page_by_computed_key(src):
    return shape("Part").select(lambda p: p.name).order_by(lambda p: p.price * p.size, "DESC").limit(20).df(src)


@query("SELECT o_orderkey AS id, o_totalprice AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def first_of_order(src):
    return shape("Order").select(lambda o: o.total).order_by(lambda o: o.total, "DESC").one().df(src)


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, priority LIMIT 3 OFFSET 1")
def grouped_page(src):
    q = shape("Order").select(lambda o: {"priority": o.priority, "n": E.count()}).group_by("priority")
    return q.group_order_by("n", "DESC").group_order_by("priority").offset(1).limit(3).df(src)


@query("SELECT o_orderstatus AS status, round(max(o_totalprice) - min(o_totalprice), 2) AS span FROM orders GROUP BY 1")
def grouped_arithmetic(src):
    df = shape("Order").select(lambda o: {"status": o.status, "span": o.total.max().minus(o.total.min())}).group_by("status").df(src)
    return df.withColumn("span", F.round("span", 2))


@query("SELECT count(*) AS count FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) > 12)")
def count_where_aggregate(src):
    return shape("Customer").select().where(lambda c: c.orders.size().gt(12)).count().df(src)


@query("SELECT n_nationkey AS id, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def cast_to_shape(src):
    return shape("Nation").select(lambda n: n.region.as_("Region").name).df(src).select("id", F.col("region.name").alias("region"))


@query("SELECT r_regionkey AS id, r_regionkey AS key, r_name AS name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region")
def everything_selected(src):
    return shape("Region").select_all().df(src).select("id", "key", "name", F.size("nations").cast("bigint").alias("n"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderpriority END AS priority FROM orders")
def inline_filter_of_a_value(src):
    return shape("Order").select(lambda o: o.priority.where(lambda p: p.equals("1-URGENT"))).df(src)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority >= '3'")
def comparisons_of_text(src):
    return shape("Order").select().where(lambda o: o.status.neq("F") & o.priority.gte("3")).df(src)


@query("SELECT p_partkey AS id, replace(url_encode(p_name), '+', '%20') AS uri, sha256(p_name) AS h FROM part")
def uris_and_hashes(src):
    return shape("Part").select(lambda p: {"uri": p.name.encode_for_uri(), "h": p.name.sha256()}).df(src)


@query("SELECT n_nationkey AS id, true AS iri, true AS literal, true AS number, false AS blank, CAST(n_nationkey AS VARCHAR) AS text FROM nation")
def kinds_of_terms(src):
    return shape("Nation").select(lambda n: {"iri": n.region.is_iri(), "literal": n.name.is_literal(), "number": n.key.is_numeric(), "blank": n.region.is_blank(), "text": n.key.str()}).df(src)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate < now() AND o_orderdate >= TIMESTAMP '1997-06-01'")
def dates_before_now(src):
    return shape("Order").select().where(lambda o: o.date.lt(E.now()) & o.date.gte(datetime(1997, 6, 1))).df(src)


@query("SELECT 'urn:Nation:' || n_nationkey AS id FROM nation WHERE 'urn:Nation:' || n_nationkey > 'urn:Nation:2' ORDER BY 1 LIMIT 5")
def page_by_cursor(src):
    return shape("Nation").select().where(lambda n: n.str().gt("urn:Nation:2")).order_by(lambda n: n).limit(5).df(_quads(src, "Nation"))


@query("SELECT 'urn:Nation:' || n_nationkey AS subject FROM nation WHERE n_regionkey = 2")
def triples_to_a_node(src):
    return Triples().to_node("urn:Region:2").with_predicate("urn:w:region").df(_quads(src, "Nation")).select("subject")


@query("SELECT 'urn:w:name' AS predicate, r_name AS object FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'urn:w:region', 'urn:Region:1' FROM nation WHERE n_nationkey = 1")
def triples_of_two_sources(src):
    router = Router(_quads(src, "Nation"), {"Region": _quads(src, "Region")}, catalog=src.catalog)
    region = router.triples(Triples().for_node("urn:Region:1").with_predicate("urn:w:name"))
    return region.unionByName(router.triples(Triples().for_node("urn:Nation:1").with_predicate("urn:w:region"))).select("predicate", "object")


# Changes


def _named(src) -> tuple[Store, Shape]:
    """The nations as quads that can change, and a shape whose name has many values."""
    c = Catalog()
    Named = Shape("Named", "urn:w:Nation", [literal("name", base="urn:w:", many=True), literal("key", "long", base="urn:w:")], catalog=c)
    return Store(_quads(src, "Nation").quads, c), Named


@query("SELECT id, name FROM (SELECT 'urn:Nation:' || n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey <> 4 UNION ALL VALUES ('urn:Nation:3', 'extra'), ('urn:Nation:4', 'other'))")
def update_of_sets(src):
    store, Named = _named(src)
    Named.update({"name": {"add": ["extra"]}}).for_("urn:Nation:3").run(store)
    Named.update({"name": {"add": ["other"], "remove": ["NATION_4"]}}).for_("urn:Nation:4").run(store)
    return Named.select(lambda n: n.name).df(store).select("id", F.explode("name").alias("name"))


@query("SELECT 'urn:Nation:' || n_nationkey AS id, CASE WHEN n_nationkey < 10 THEN n_name END AS name FROM nation")
def update_unsets(src):
    store, Nation = _store(src, "Nation"), shape("Nation")
    Nation.update({"name": None}).where(lambda n: n.key.gte(10)).run(store)
    return Nation.select(lambda n: n.name).df(store)


@query("SELECT 'urn:Region:' || r_regionkey AS id, CASE WHEN r_regionkey = 1 THEN 'ONE' ELSE r_name END AS name FROM region UNION ALL SELECT 'urn:Region:77', 'NEW'")
def upsert_old_and_new(src):
    store, Region = _store(src, "Region"), shape("Region")
    Region.upsert({"name": "ONE"}).for_("urn:Region:1").run(store)
    Region.upsert({"name": "NEW"}).for_("urn:Region:77").run(store)
    return Region.select(lambda r: r.name).df(store)


@query("SELECT 'urn:Nation:' || n_nationkey AS s FROM nation WHERE n_regionkey = 1")
def delete_keeps_links(src):
    store = _store(src, "Region", "Nation")
    shape("Region").delete("urn:Region:1").keep_links().run(store)
    return Triples().to_node("urn:Region:1").df(store).select(F.col("subject").alias("s"))


@query("SELECT 0 AS left_over, count(*) AS nations FROM nation")
def delete_all_of_a_shape(src):
    store = _store(src, "Region", "Nation")
    shape("Region").delete_all().run(store)
    left = shape("Region").select().count().df(store).withColumnRenamed("count", "left_over")
    return left.crossJoin(shape("Nation").select().count().df(store).withColumnRenamed("count", "nations")).withColumn("left_over", F.col("left_over").cast("int"))


@query("SELECT 'urn:Region:' || r_regionkey AS id, r_name AS name FROM region WHERE r_regionkey <> 2")
def delete_without_a_shape(src):
    store = _store(src, "Region")
    Delete.shapeless(["urn:Region:2"]).run(store)
    return shape("Region").select(lambda r: r.name).df(store)


@query("SELECT 'urn:Nation:' || n_nationkey AS id, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'urn:Nation:new', 'MU'")
def create_nested(src):
    store = _store(src, "Region", "Nation")
    shape("Nation").create({"__id": "urn:Nation:new", "name": "N", "key": 99, "region": {"__id": "urn:Region:new", "name": "MU", "key": 98}}).run(store)
    return shape("Nation").select(lambda n: n.region.name).df(store).select("id", F.col("region.name").alias("region"))


@query("SELECT 'urn:Region:' || r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 'urn:Region:tx', 'IN'")
def transaction_committed(src):
    store, Region = _store(src, "Region"), shape("Region")
    tx = store.begin()
    tx.apply(Region.create({"__id": "urn:Region:tx", "name": "IN", "key": 50}))
    tx.commit()
    return Region.select(lambda r: r.name).df(store)


@query("SELECT 'urn:Region:' || r_regionkey AS id, CASE WHEN r_regionkey <> 3 THEN r_name END AS name FROM region")
def graph_patched(src):
    store = _store(src, "Nation")
    regions = _quads(src, "Region").quads
    store.graph_create("urn:g:regions", regions)
    store.graph_patch("urn:g:regions", remove=regions.where("s = 'urn:Region:3' and p = 'urn:w:name'"))
    return shape("Region").select(lambda r: r.name).from_("urn:g:regions").df(store)


@query("SELECT 'urn:Region:' || r_regionkey AS id FROM region WHERE r_regionkey >= 2")
def graph_replaced_and_dropped(src):
    store = _store(src, "Nation")
    regions = _quads(src, "Region").quads
    store.graph_create("urn:g:old", regions)
    store.graph_create("urn:g:new", regions)
    store.graph_replace("urn:g:new", regions.where("cast(substring_index(s, ':', -1) as int) >= 2"))
    store.graph_drop("urn:g:old")
    return shape("Region").select().df(store)


@query("SELECT 'urn:Nation:' || n_nationkey AS id FROM nation WHERE n_nationkey NOT BETWEEN 10 AND 19")
def graphs_together(src):
    q = _quads(src, "Nation").quads
    graph = F.concat(F.lit("urn:g:"), F.floor(F.substring_index("s", ":", -1).cast("int") / 10).cast("string"))
    return shape("Nation").select().from_("urn:g:0", "urn:g:2").df(QuadSource(q.withColumn("g", graph), src.catalog))


@query("""SELECT 'urn:Nation:' || n_nationkey AS focus, component FROM (
    SELECT n_nationkey, 'min_length' AS component FROM nation WHERE length(n_name) < 9
    UNION ALL SELECT n_nationkey, 'pattern' FROM nation WHERE NOT regexp_matches(n_name, '[02468]$')
    UNION ALL SELECT n_nationkey, 'minCount' FROM nation)""")
def validation_of_text_and_counts(src):
    from .operators.validate import validate_source

    c = Catalog()
    strict = Shape("Strict", "urn:w:Nation", [literal("name", base="urn:w:", min_length=9, pattern="[02468]$"), relation("king", base="urn:w:", shape="Strict", many=False, min_count=1)], catalog=c)
    return validate_source(QuadSource(_quads(src, "Nation").quads, c), strict).select("focus", "component")
