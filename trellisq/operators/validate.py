"""Validation against shapes: of single descriptions in Python, and of whole sources as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shapes import Property, Shape


@dataclass(frozen=True)
class Result:
    focus: Any
    path: str
    value: Any
    shape: str
    component: str
    severity: str
    message: str


@dataclass(frozen=True)
class Report:
    results: tuple[Result, ...]

    @property
    def conforms(self) -> bool:
        return not self.results


class ValidationError(ValueError):
    def __init__(self, report: Report):
        super().__init__("; ".join(f"{r.path}: {r.message}" for r in report.results))
        self.report = report


_CHECKS = {
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "decimal": lambda v: isinstance(v, int | float | Decimal) and not isinstance(v, bool),
    "date": lambda v: isinstance(v, date) or isinstance(v, str) and bool(re.fullmatch(r"\d{4}-\d\d-\d\d", v)),
    "dateTime": lambda v: isinstance(v, datetime) or isinstance(v, str) and bool(re.match(r"\d{4}-\d\d-\d\dT\d\d:\d\d", v)),
    "time": lambda v: isinstance(v, str) and bool(re.fullmatch(r"\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?", v)),
}
_CHECKS |= {"long": _CHECKS["integer"], "double": _CHECKS["decimal"], "float": _CHECKS["decimal"]}


def _is_reference(v: Any) -> bool:
    return isinstance(v, dict) and set(v) == {"id"}


def problems(p: Property, v: Any) -> Iterator[tuple[str, str]]:
    """(component, message) for each constraint on a single value that it breaks."""
    if p.is_relation:
        if not isinstance(v, dict):
            yield "nodeKind", "a node is expected"
        elif _is_reference(v) and p.node_kind == "BlankNode" and not str(v["id"]).startswith("_:"):
            yield "nodeKind", "a blank node is expected"
        elif _is_reference(v) and p.node_kind == "IRI" and str(v["id"]).startswith("_:"):
            yield "nodeKind", "an IRI is expected"
        return
    if isinstance(v, dict | list):
        yield "nodeKind", "a literal is expected"
        return
    if p.datatype in _CHECKS and not _CHECKS[p.datatype](v):
        yield "datatype", f"{v!r} is no {p.datatype}"
        return
    for name, bad in (("min_inclusive", lambda a, b: a < b), ("max_inclusive", lambda a, b: a > b), ("min_exclusive", lambda a, b: a <= b), ("max_exclusive", lambda a, b: a >= b)):
        bound = getattr(p, name)
        if bound is not None and bad(v, bound):
            yield name, f"{v!r} is outside the bound {bound!r}"
    text = v if isinstance(v, str) else str(v)
    if p.min_length is not None and len(text) < p.min_length:
        yield "min_length", f"shorter than {p.min_length}"
    if p.max_length is not None and len(text) > p.max_length:
        yield "max_length", f"longer than {p.max_length}"
    if p.pattern is not None and not re.search(p.pattern, text, sum(getattr(re, f.upper()) for f in p.flags if f in "ims")):
        yield "pattern", f"does not match {p.pattern}"
    if p.one_of is not None and v not in p.one_of:
        yield "in", f"not one of {list(p.one_of)}"


def validate(shape: Shape, data: dict, mode: str = "complete", focus: Any = None) -> Report:
    """mode: complete (a whole description) or partial (only what is given)."""
    out: list[Result] = []
    focus = focus or data.get("__id") or data.get("id")

    def add(path, value, component, message, severity="Violation"):
        out.append(Result(focus, path, value, shape.name, component, severity, message))

    properties = shape.properties
    for label in data:
        if label not in properties and label not in ("__id", "__shape", "id", "$type"):
            add(label, data[label], "closed", "the shape has no such property")
    for label, p in properties.items():
        value = data.get(label)
        values = value if isinstance(value, list) else [] if value is None else [value]
        if isinstance(value, dict) and set(value) & {"add", "remove"}:
            values = list(value.get("add") or [])
        elif mode == "complete" or label in data:
            if len(values) < p.min_count:
                add(label, value, "minCount", f"fewer than {p.min_count} values", p.severity)
            if p.max_count is not None and len(values) > p.max_count:
                add(label, value, "maxCount", f"more than {p.max_count} values", p.severity)
        for v in values:
            for component, message in problems(p, v):
                add(label, v, component, message, p.severity)
            to = shape.value_shape(p)
            if isinstance(v, dict) and not _is_reference(v) and to is not None:
                out += validate(to, v, "complete").results
    return Report(tuple(out))


def assert_valid(shape: Shape, data: dict, mode: str = "complete") -> None:
    report = validate(shape, data, mode)
    if not report.conforms:
        raise ValidationError(report)


REPORT = "focus string, path string, value string, shape string, component string, severity string, message string"


def validate_source(source, shape: Shape, graphs=None) -> DataFrame:
    """The report of all nodes of a shape as a DataFrame (see REPORT); counts are one aggregation a property, the rest filters."""
    nodes = source.scan(shape, graphs)
    parts = []

    def add(df, path, component, message, severity):
        parts.append(df.select(F.col("s").cast("string").alias("focus"), F.lit(path).alias("path"), F.col("o").cast("string").alias("value"), F.lit(shape.name).alias("shape"), F.lit(component).alias("component"), F.lit(severity).alias("severity"), F.lit(message).alias("message")))

    for label, p in shape.properties.items():
        edges = source.edge(shape, p, graphs)
        if p.min_count or p.max_count is not None:
            counts = nodes.join(edges.groupBy("s").agg(F.count("*").alias("n")), F.col("id") == F.col("s"), "left").select(F.col("id").alias("s"), F.coalesce("n", F.lit(0)).alias("o"))
            if p.min_count:
                add(counts.where(F.col("o") < p.min_count), label, "minCount", f"fewer than {p.min_count} values", p.severity)
            if p.max_count is not None:
                add(counts.where(F.col("o") > p.max_count), label, "maxCount", f"more than {p.max_count} values", p.severity)
        own = edges.join(nodes, F.col("s") == F.col("id"), "left_semi")
        o = F.col("o")
        for name, broken in (("min_inclusive", lambda b: o < b), ("max_inclusive", lambda b: o > b), ("min_exclusive", lambda b: o <= b), ("max_exclusive", lambda b: o >= b)):
            if getattr(p, name) is not None:
                add(own.where(broken(F.lit(getattr(p, name)))), label, name, "outside the bound", p.severity)
        if p.min_length is not None:
            add(own.where(F.char_length(o.cast("string")) < p.min_length), label, "min_length", f"shorter than {p.min_length}", p.severity)
        if p.max_length is not None:
            add(own.where(F.char_length(o.cast("string")) > p.max_length), label, "max_length", f"longer than {p.max_length}", p.severity)
        if p.pattern is not None:
            flags = "".join(f for f in p.flags if f in "ims")
            add(own.where(~o.cast("string").rlike((f"(?{flags})" if flags else "") + p.pattern)), label, "pattern", f"does not match {p.pattern}", p.severity)
        if p.one_of is not None:
            add(own.where(~o.isin(list(p.one_of))), label, "in", f"not one of {list(p.one_of)}", p.severity)
        if p.class_ is not None and source.catalog.by_class(p.class_) is not None:
            members = source.scan(source.catalog.by_class(p.class_), graphs)
            add(own.join(members.select(F.col("id").alias("member")), o == F.col("member"), "left_anti"), label, "class", f"not of the class {p.class_}", p.severity)
    out = source.spark.createDataFrame([], REPORT)
    for part in parts:
        out = out.unionByName(part)
    return out


def single_owner_violations(source, graphs=None) -> DataFrame:
    """(id, owners): nodes that more than one node owns through ``contains`` relations."""
    links = None
    for shape in source.catalog.shapes.values():
        for p in shape.own:
            if p.contains:
                part = source.edge(shape, p, graphs)
                links = part if links is None else links.unionByName(part)
    if links is None:
        return source.spark.createDataFrame([], "id string, owners long")
    return links.distinct().groupBy(F.col("o").alias("id")).agg(F.count_distinct("s").alias("owners")).where("owners > 1")
