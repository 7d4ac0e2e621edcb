"""Shapes over the order-processing tables, and the source that maps them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..shapes import Catalog, Shape, literal, relation
from .mapped import MappedSource, Mapping

BASE = "urn:w:"


def _l(label, datatype="string"):
    return literal(label, datatype=datatype, base=BASE)


def _r(label, shape, many=False):
    return relation(label, shape=shape, many=many, base=BASE)


def _catalog() -> Catalog:
    c = Catalog()
    Shape("Region", BASE + "Region", [_l("key", "long"), _l("name"), _r("nations", "Nation", True)], catalog=c)
    Shape("Nation", BASE + "Nation", [_l("key", "long"), _l("name"), _r("region", "Region"), _r("customers", "Customer", True), _r("suppliers", "Supplier", True)], catalog=c)
    Shape("Customer", BASE + "Customer", [_l("key", "long"), _l("name"), _l("balance", "double"), _l("segment"), _r("nation", "Nation"), _r("orders", "Order", True), _r("events", "Event", True)], catalog=c)
    Shape("Supplier", BASE + "Supplier", [_l("key", "long"), _l("name"), _l("balance", "double"), _r("nation", "Nation"), _r("lineItems", "LineItem", True)], catalog=c)
    Shape("Part", BASE + "Part", [_l("key", "long"), _l("name"), _l("brand"), _l("type"), _l("size", "integer"), _l("price", "double"), _r("lineItems", "LineItem", True)], catalog=c)
    Shape("Order", BASE + "Order", [_l("key", "long"), _l("status"), _l("total", "double"), _l("date", "dateTime"), _l("priority"), _r("customer", "Customer"), _r("lineItems", "LineItem", True)], catalog=c)
    Shape("LineItem", BASE + "LineItem", [
        _l("number", "integer"), _l("quantity", "double"), _l("extended", "double"), _l("discount", "double"), _l("tax", "double"), _l("returnFlag"), _l("lineStatus"),
        _l("shipped", "dateTime"), _r("order", "Order"), _r("part", "Part"), _r("supplier", "Supplier")], catalog=c)
    Shape("Event", BASE + "Event", [_l("key", "long"), _l("time", "dateTime"), _l("type"), _l("value", "double"), _l("props"), _r("user", "Customer")], catalog=c)
    Shape("Document", BASE + "Document", [_l("key", "long"), _l("text"), _l("lang"), _l("source"), _l("chars", "long"), _r("label", "Label")], catalog=c)
    Shape("Label", BASE + "Label", [_l("key", "long"), _l("quality", "integer"), _l("toxic", "integer"), _r("document", "Document")], catalog=c)
    return c


CATALOG = _catalog()

#: table, id, columns by label, inverse relations by label.
TABLES = {
    "Region": ("region", "r_regionkey", {"key": "r_regionkey", "name": "r_name"}, {"nations": ("Nation", "region")}),
    "Nation": ("nation", "n_nationkey", {"key": "n_nationkey", "name": "n_name", "region": "n_regionkey"}, {"customers": ("Customer", "nation"), "suppliers": ("Supplier", "nation")}),
    "Customer": ("customer", "c_custkey", {"key": "c_custkey", "name": "c_name", "balance": "c_acctbal", "segment": "c_mktsegment", "nation": "c_nationkey"}, {"orders": ("Order", "customer"), "events": ("Event", "user")}),
    "Supplier": ("supplier", "s_suppkey", {"key": "s_suppkey", "name": "s_name", "balance": "s_acctbal", "nation": "s_nationkey"}, {"lineItems": ("LineItem", "supplier")}),
    "Part": ("part", "p_partkey", {"key": "p_partkey", "name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "price": "p_retailprice"}, {"lineItems": ("LineItem", "part")}),
    "Order": ("orders", "o_orderkey", {"key": "o_orderkey", "status": "o_orderstatus", "total": "o_totalprice", "date": "o_orderdate", "priority": "o_orderpriority", "customer": "o_custkey"}, {"lineItems": ("LineItem", "order")}),
    # (order, number) is no key of this table; whole rows are.
    "LineItem": ("lineitem", None, {
        "number": "l_linenumber", "quantity": "l_quantity", "extended": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "returnFlag": "l_returnflag",
        "lineStatus": "l_linestatus", "shipped": "l_shipdate", "order": "l_orderkey", "part": "l_partkey", "supplier": "l_suppkey"}, {}),
    "Event": ("events", "event_id", {"key": "event_id", "time": "ts", "type": "event_type", "value": "value", "props": "props", "user": "user_id"}, {}),
    "Document": ("documents", "doc_id", {"key": "doc_id", "text": "text", "lang": "lang", "source": "source", "chars": "n_chars"}, {"label": ("Label", "document")}),
    "Label": ("labels", "doc_id", {"key": "doc_id", "quality": "quality", "toxic": "toxic", "document": "doc_id"}, {}),
}


def warehouse(spark: SparkSession, sf_dir: str) -> MappedSource:
    return MappedSource({name: Mapping(spark.read.parquet(f"{sf_dir}/{table}.parquet"), id_, columns, inverse) for name, (table, id_, columns, inverse) in TABLES.items()}, CATALOG)


def shape(name: str) -> Shape:
    return CATALOG.shape(name)
