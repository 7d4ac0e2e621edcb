"""The registered queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expr import E
from .sources.warehouse import shape, warehouse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function of the source; sql: its twin, or None."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(warehouse(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _cents(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles rounded, as the order of additions is not fixed."""
    return df.withColumns({c: F.round(c, 2) for c in columns})


@query("""SELECT o_orderstatus AS status, count(DISTINCT o_orderkey) AS n, max(o_orderdate) AS last FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3' OR n_name < 'N' GROUP BY 1 HAVING count(DISTINCT o_orderkey) > 1""")
def grouped_by_status(src):
    Order = shape("Order")
    return (Order.select(lambda o: {"status": o.status, "n": E.count(), "last": o.date.max()})
            .where(lambda o: o.customer.nation.name.equals("NATION_3") | o.customer.nation.name.lt("N"))
            .group_by("status").having("n", lambda n: n.gt(1)).group_order_by("n", "DESC").df(src))


@query("SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS extended, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(src):
    q = shape("LineItem").select(lambda x: {"flag": x.returnFlag, "status": x.lineStatus, "quantity": x.quantity.sum(), "extended": x.extended.sum(), "discount": x.discount.avg(), "n": E.count()})
    df = q.where(lambda x: x.shipped.lte(datetime(1998, 9, 2))).group_by("flag", "status").df(src)
    return _cents(df, "quantity", "extended").withColumn("discount", F.round("discount", 6))


@query("SELECT n_name AS nation, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1")
def revenue_by_nation(src):
    q = shape("LineItem").select(lambda x: {"nation": x.order.customer.nation.name, "revenue": (x.extended * x.discount.times(-1).plus(1)).sum()})
    return _cents(q.where(lambda x: x.order.customer.nation.region.name.equals("ASIA")).group_by("nation").df(src), "revenue")


@query("SELECT c_custkey AS id, c_name AS name, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'BUILDING'")
def nested_paths(src):
    df = shape("Customer").select(lambda c: [c.name, c.nation.name, c.nation.region.name]).where(lambda c: c.segment.equals("BUILDING")).df(src)
    return df.select("id", "name", F.col("nation.name").alias("nation"), F.col("nation.region.name").alias("region"))


@query("SELECT c_custkey AS id, count(o_orderkey) AS n, min(o_orderkey) AS first_key FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def relation_lists(src):
    df = shape("Customer").select(lambda c: c.orders.select(lambda o: [o.status])).df(src)
    return df.select("id", F.size("orders").cast("bigint").alias("n"), F.get("orders", F.lit(0))["id"].alias("first_key"))


@query("SELECT c_custkey AS id, (SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer")
def size_per_node(src):
    return shape("Customer").select(lambda c: {"n_orders": c.orders.size()}).df(src)


@query("SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 100000)")
def quantifier_some(src):
    return shape("Customer").select().where(lambda c: c.orders.some(lambda o: o.priority.equals("1-URGENT") & o.total.gt(100000.0))).df(src)


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT (o_totalprice > 5000))")
def quantifier_every(src):
    return shape("Customer").select().where(lambda c: c.orders.every(lambda o: o.total.gt(5000.0))).df(src)


@query("SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def quantifier_none(src):
    return shape("Order").select().where(lambda o: o.lineItems.none(lambda x: x.returnFlag.equals("R"))).df(src)


@query("SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 50))")
def nested_quantifiers(src):
    return shape("Customer").select().where(lambda c: c.orders.some(lambda o: o.lineItems.some(lambda x: x.quantity.gte(50.0)))).df(src)


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def quantifier_under_or(src):
    return shape("Customer").select().where(lambda c: c.balance.lt(0.0) | c.orders.some(lambda o: o.total.gt(400000.0))).df(src)


@query("SELECT c_custkey AS id FROM customer WHERE (SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_custkey = c_custkey) > 12")
def aggregate_condition(src):
    return shape("Customer").select().where(lambda c: c.orders.size().gt(12)).df(src)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def minus_existence(src):
    return shape("Order").select().minus(lambda o: o.lineItems).df(src)


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def minus_condition(src):
    return shape("Document").select().minus(lambda d: d.label.quality.equals(1)).df(src)


@query("SELECT d.doc_id AS id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 0")
def inline_filter(src):
    df = shape("Document").select(lambda d: d.label.where(lambda x: x.quality.equals(0)).quality).df(src)
    return df.select("id", F.col("label.quality").alias("quality"))


@query("SELECT d.doc_id AS id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL")
def is_not_defined(src):
    return shape("Document").select().where(lambda d: d.label.is_not_defined()).df(src)


@query("SELECT c_custkey AS id, o_orderkey AS order_id FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 450000")
def implicit_some(src):
    df = shape("Customer").select(lambda c: c.orders.total).where(lambda c: c.orders.total.gt(450000.0)).df(src)
    return df.select("id", F.explode("orders").alias("o")).select("id", F.col("o.id").alias("order_id"))


@query("SELECT o_orderkey AS id, o_totalprice AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def page_ordered(src):
    return shape("Order").select(lambda o: o.total).order_by(lambda o: o.total, "DESC").limit(25).offset(10).df(src)


@query("SELECT doc_id AS id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, doc_id LIMIT 500")
def page_missing_last(src):
    df = shape("Document").select(lambda d: d.label.quality).order_by(lambda d: d.label.quality, "DESC").limit(500).df(src)
    return df.select("id", F.col("label.quality").alias("quality"))


@query("SELECT c_custkey AS id FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY max(o_totalprice) DESC NULLS LAST, 1 LIMIT 20")
def page_by_relation(src):
    return shape("Customer").select().order_by(lambda c: c.orders.total, "DESC").limit(20).df(src)


@query("SELECT id, order_id, rank FROM (SELECT o_custkey AS id, o_orderkey AS order_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def page_within_parent(src):
    df = shape("Customer").select(lambda c: c.orders.select(lambda o: [o.total]).order_by(lambda o: o.total, "DESC").limit(3)).df(src)
    return df.select("id", F.posexplode("orders").alias("p", "o")).select("id", F.col("o.id").alias("order_id"), (F.col("p") + 1).cast("bigint").alias("rank"))


@query("SELECT count(DISTINCT o_orderkey) AS count FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'")
def count_where(src):
    return shape("Order").select().where(lambda o: o.customer.segment.equals("MACHINERY")).count().df(src)


@query("SELECT count(*) > 0 AS exists FROM part WHERE p_size > 49")
def ask_exists(src):
    return shape("Part").select().where(lambda p: p.size.gt(49)).exists().df(src)


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey IN (1, 3, 5)")
def listed_subjects(src):
    return shape("Supplier").select(lambda s: s.name).for_all([1, 3, 5]).df(src)


@query("SELECT r_name AS region, count(DISTINCT s_suppkey) AS suppliers, count(DISTINCT c_custkey) AS customers FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def grouped_counts(src):
    return shape("Region").select(lambda r: {"region": r.name, "suppliers": r.nations.suppliers.size(), "customers": r.nations.customers.size()}).group_by("region").df(src)


@query("SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > c_acctbal * 40")
def theta_filter(src):
    return shape("Order").select().where(lambda o: o.total.gt(o.customer.balance.times(40))).df(src)


@query("""SELECT p_partkey AS id, upper(p_name) AS u, lower(p_name) AS l, length(p_name) AS n, p_name || '-' || p_brand AS c, contains(p_type, 'E') AS has, starts_with(p_brand, 'Brand') AS st,
ends_with(p_type, 'N') AS en, substr(p_name, 2, 3) AS sub, CASE WHEN instr(p_name, '_') > 0 THEN substr(p_name, 1, instr(p_name, '_') - 1) ELSE '' END AS before,
CASE WHEN instr(p_name, '_') > 0 THEN substr(p_name, instr(p_name, '_') + 1) ELSE '' END AS after, regexp_replace(p_name, '[0-9]+', '#', 'g') AS r, regexp_matches(p_name, '(?i)part') AS m,
md5(p_name) AS h, sha256(p_name) AS s FROM part""")
def text_functions(src):
    return shape("Part").select(lambda p: {
        "u": p.name.ucase(), "l": p.name.lcase(), "n": p.name.strlen(), "c": p.name.concat("-", p.brand), "has": p.type.contains("E"), "st": p.brand.starts_with("Brand"), "en": p.type.ends_with("N"),
        "sub": p.name.substr(2, 3), "before": p.name.before("_"), "after": p.name.after("_"), "r": p.name.replace("[0-9]+", "#"), "m": p.name.matches("part", "i"), "h": p.name.md5(), "s": p.name.sha256()}).df(src)


@query("""SELECT c_custkey AS id, abs(c_acctbal) AS a, floor(c_acctbal + 0.5) AS r, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, c_acctbal + 1 AS plus, c_acctbal - 1 AS minus, c_acctbal * 2 AS times,
c_acctbal / 4 AS divided, c_acctbal * c_acctbal AS p, CASE WHEN c_acctbal > 0 THEN 'credit' ELSE 'debit' END AS i FROM customer""")
def number_functions(src):
    return shape("Customer").select(lambda c: {
        "a": c.balance.abs(), "r": c.balance.round(), "c": c.balance.ceil(), "f": c.balance.floor(), "plus": c.balance + 1, "minus": c.balance - 1, "times": c.balance * 2, "divided": c.balance / 4,
        "p": c.balance.power(2), "i": E.if_then(c.balance.gt(0), "credit", "debit")}).df(src)


@query("SELECT event_id AS id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, extract(microseconds FROM ts) / 1000000.0 AS s, 'Z' AS tz FROM events")
def date_functions(src):
    return shape("Event").select(lambda e: {"y": e.time.year(), "m": e.time.month(), "d": e.time.day(), "h": e.time.hours(), "mi": e.time.minutes(), "s": e.time.seconds(), "tz": e.time.tz()}).df(src)


@query("SELECT d.doc_id AS id, coalesce(l.quality, -1) AS q, coalesce(l.toxic, l.quality, 7) AS t FROM documents d JOIN labels l USING (doc_id)")
def defaults(src):
    return shape("Document").select(lambda d: {"q": d.label.quality.default_to(-1), "t": E.first_defined(d.label.toxic, d.label.quality, 7)}).df(src)


@query("SELECT n_nationkey AS id FROM nation WHERE n_name IN ('NATION_1', 'NATION_2', 'NATION_24') AND n_name NOT IN ('NATION_2')")
def membership(src):
    return shape("Nation").select().where(lambda n: n.name.one_of(["NATION_1", "NATION_2", "NATION_24"]) & n.name.not_one_of(["NATION_2"])).df(src)


@query("""SELECT CAST(window_start AS TIMESTAMP) AS start, event_type AS type, count(*) AS n, round(sum(value), 2) AS total
FROM (SELECT *, time_bucket(INTERVAL '1 hour', ts) AS window_start FROM events) GROUP BY 1, 2""")
def windows_of_events(src):
    from .streaming.windows import tumbling

    return _cents(tumbling(src.node(shape("Event")).select("time", "type", "value"), "time", "1 hour", ["type"]), "total")


# Over quads: the same tables as RDF-style statements, so paths, triples, graphs and changes have something to work on.


def _quads(src, *shapes: str):
    from .sources.mapped import MappedSource
    from .sources.quads import QuadSource

    some = MappedSource({s: src.mappings[s] for s in shapes}, src.catalog)
    return QuadSource(some.quads(), src.catalog)


def _store(src, *shapes: str):
    from .plans.mutations import Store

    return Store(_quads(src, *shapes).quads, src.catalog)


@query("SELECT 'urn:Nation:' || n_nationkey AS id, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def quads_nested_paths(src):
    df = shape("Nation").select(lambda n: [n.name, n.region.name]).df(_quads(src, "Region", "Nation"))
    return df.select("id", "name", F.col("region.name").alias("region"))


@query("SELECT 'urn:Region:' || r_regionkey AS s, 'urn:Customer:' || c_custkey AS o FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey")
def path_sequence_of_inverses(src):
    from .paths import parse

    return _quads(src, "Region", "Nation", "Customer").step(parse("^region/^nation", base="urn:w:")).select("s", "o")


@query("SELECT DISTINCT 'urn:Nation:' || n_nationkey AS s, o FROM (SELECT n_nationkey, n_name AS o FROM nation UNION ALL SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) FROM nation)")
def path_alternative(src):
    from .paths import parse

    return _quads(src, "Nation").step(parse("name|key", base="urn:w:")).select("s", "o")


@query("SELECT 'urn:Nation:' || n_nationkey AS s, 'urn:Region:' || n_regionkey AS o FROM nation UNION ALL SELECT 'urn:Nation:' || n_nationkey, 'urn:t' FROM nation WHERE false")
def path_negated(src):
    from .paths import parse

    out = _quads(src, "Nation").step(parse("!(name|key|<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>)", base="urn:w:"))
    return out.select("s", "o")


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS s, (n_nationkey * 2) % 25 AS o FROM nation), c AS (SELECT s, o FROM e UNION SELECT c.s, e.o FROM c JOIN e ON c.o = e.s)
SELECT CAST(s AS BIGINT) AS s, CAST(o AS BIGINT) AS o FROM c""")
def path_closure(src):
    from .operators.closure import transitive_closure

    n = src.node(shape("Nation")).select(F.col("key").cast("bigint").alias("s"), (F.col("key") * 2 % 25).cast("bigint").alias("o"))
    return transitive_closure(n)


@query("SELECT 'urn:w:' || 'region' AS predicate, 'urn:Region:' || n_regionkey AS object FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'urn:w:name', n_name FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'urn:w:key', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:w:Nation'")
def triples_of_a_node(src):
    from .plans.query import Triples

    return Triples().for_node("urn:Nation:7").df(_quads(src, "Nation")).select("predicate", "object")


@query("SELECT 'urn:Region:' || r_regionkey AS term FROM region WHERE r_regionkey IN (1, 3)")
def terms_that_exist(src):
    from .plans.query import Triples

    return Triples().to_node(["urn:Region:1", "urn:Region:3", "urn:Region:99"]).which_exist(_quads(src, "Nation"))


@query("SELECT CASE WHEN r = 1 THEN 'urn:w:Nation' ELSE 'urn:w:Supplier' END AS type, n FROM (SELECT 1 AS r, count(*) AS n FROM nation UNION ALL SELECT 2, count(*) FROM supplier)")
def grouped_by_type(src):
    q = _quads(src, "Nation", "Supplier")
    parts = [shape(s).select(lambda x: {"type": x.type_(), "n": E.count()}).group_by("type").df(q) for s in ("Nation", "Supplier")]
    return parts[0].unionByName(parts[1])


@query("SELECT o_orderstatus AS status, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def grouped_by_many_values(src):
    return shape("Customer").select(lambda c: {"status": c.orders.status, "customers": E.count()}).where(lambda c: c.orders.is_defined()).group_by("status").df(src)


@query("SELECT 'urn:Supplier:' || s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN upper(s_name) ELSE s_name END AS name FROM supplier")
def update_where_computed(src):
    store, Supplier = _store(src, "Supplier"), shape("Supplier")
    Supplier.update(lambda s: {"name": s.name.ucase()}).where(lambda s: s.balance.lt(0.0)).run(store)
    return Supplier.select(lambda s: s.name).df(store)


@query("SELECT 'urn:Supplier:' || s_suppkey AS id, s_name AS name FROM supplier WHERE s_acctbal >= 0")
def delete_where_condition(src):
    store, Supplier = _store(src, "Supplier"), shape("Supplier")
    Supplier.delete_where(lambda s: s.balance.lt(0.0)).run(store)
    return Supplier.select(lambda s: s.name).df(store)


@query("SELECT 'urn:Nation:' || n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN NULL ELSE 'urn:Region:' || n_regionkey END AS region FROM nation")
def delete_takes_links_along(src):
    store = _store(src, "Region", "Nation")
    shape("Region").delete("urn:Region:1").run(store)
    return shape("Nation").select(lambda n: n.region).df(store).select("id", F.col("region.id").alias("region"))


@query("SELECT 'urn:Region:' || r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 'urn:Region:new', 'ATLANTIS'")
def create_and_read_back(src):
    store, Region = _store(src, "Region"), shape("Region")
    Region.create({"__id": "urn:Region:new", "name": "ATLANTIS", "key": 99}).run(store)
    return Region.select(lambda r: r.name).df(store)


@query("SELECT 'urn:Supplier:' || s_suppkey AS focus, CAST(s_acctbal AS VARCHAR) AS value FROM supplier WHERE s_acctbal < 0")
def validation_report(src):
    from .operators.validate import validate_source
    from .shapes import Catalog, Shape, literal

    strict = Shape("Solvent", "urn:w:Supplier", [literal("balance", datatype="double", base="urn:w:", min_inclusive=0.0)], catalog=Catalog())
    return validate_source(_quads(src, "Supplier"), strict).select("focus", "value")


@query("SELECT 'urn:Nation:' || n_nationkey AS id FROM nation WHERE n_nationkey >= 10")
def graph_scope(src):
    from .sources.quads import QuadSource

    q = _quads(src, "Nation").quads
    graph = F.when(F.substring_index("s", ":", -1).cast("int") >= 10, "urn:g:high").otherwise("urn:g:low")
    return shape("Nation").select().from_("urn:g:high").df(QuadSource(q.withColumn("g", graph), src.catalog))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal > 9000 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') ORDER BY c_name DESC LIMIT 10")
def wire_envelope(src):
    from .plans.wire import from_json

    return from_json({
        "v": "1.8", "shape": "urn:shape:Customer", "fields": ["name"], "where": {"balance": {">": 9000}, "orders.some": {"status": "F"}}, "sortBy": [{"name": "DESC"}], "limit": 10,
    }, src.catalog).df(src)


@query("SELECT s_suppkey AS id, s_name AS name, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def field_sets_and_preload(src):
    from .plans.query import FieldSet

    card = FieldSet.for_(shape("Nation"), ["key", "name"]).remove("key")
    df = shape("Supplier").select(["name"]).preload("nation", card).df(src)
    return df.select("id", "name", F.col("nation.name").alias("nation"))


@query("SELECT doc_id AS id, lang FROM documents WHERE regexp_matches(source, '^src1[0-9]$') AND NOT (lang = 'en') AND n_chars BETWEEN 500 AND 5000")
def documents_by_condition(src):
    return shape("Document").select(lambda d: d.lang).where(lambda d: d.source.matches("^src1[0-9]$") & ~d.lang.equals("en") & d.chars.gte(500) & d.chars.lte(5000)).df(src)


@query("SELECT lang, count(*) AS documents, count(DISTINCT source) AS sources, max(n_chars) AS longest FROM documents GROUP BY 1")
def documents_grouped(src):
    return shape("Document").select(lambda d: {"lang": d.lang, "documents": E.count(), "sources": d.source.count_distinct(), "longest": d.chars.max()}).group_by("lang").df(src)


@query("SELECT user_id AS id, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 20")
def events_by_user_and_type(src):
    return shape("Event").select(lambda e: {"id": e.user, "type": e.type, "n": E.count()}).group_by("id", "type").having("n", lambda n: n.gt(20)).df(src)


@query("SELECT p_partkey AS id, p_brand AS brand FROM part WHERE p_size >= 10 AND p_size < 20 AND (p_retailprice > 990 OR p_type LIKE '%D')")
def boolean_conditions(src):
    return shape("Part").select(lambda p: p.brand).where(lambda p: (p.size >= 10) & (p.size < 20) & (p.price.gt(990.0) | p.type.ends_with("D"))).df(src)
