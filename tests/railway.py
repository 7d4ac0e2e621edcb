"""A small railway: stops in a loop with a branch, lines that call at them, companies."""

from trellisq.shapes import RDF_TYPE, XSD, Catalog, Shape, literal, relation
from trellisq.sources.quads import QuadSource, quads_frame

P, T, ENT = "urn:rail:", "urn:kind:", "urn:at:"


def catalog() -> Catalog:
    c = Catalog()
    Stop = Shape(
        "Stop", T + "Stop",
        [
            literal("title", f"<{P}title>"), literal("zone", f"<{P}zone>", "integer"), literal("opened", f"<{P}opened>", "dateTime"),
            literal("staffed", f"<{P}staffed>", "boolean"), literal("aliases", f"<{P}alias>", many=True), relation("next", f"<{P}next>", "Stop"),
            relation("hub", f"<{P}hub>", "Stop", many=False), relation("onward", f"<{P}next>+", "Stop"), relation("feeders", f"^<{P}hub>", "Stop"),
        ],
        catalog=c,
    )
    Shape("Terminus", T + "Terminus", [literal("platforms", f"<{P}platforms>", "integer")], Stop, catalog=c)
    c.declare_subclass(T + "Terminus", T + "Stop")
    Line = Shape(
        "Line", T + "Line",
        [literal("title", f"<{P}title>"), relation("calls", f"<{P}calls>", "Stop"), relation("starts", f"<{P}calls>", "Stop", many=False), relation("runBy", f"<{P}runBy>", "Company", many=False)],
        catalog=c,
    )
    Shape("NightLine", T + "NightLine", [literal("until", f"<{P}until>", "integer")], Line, catalog=c)
    Shape("Company", T + "Company", [literal("title", f"<{P}title>"), relation("lines", f"^<{P}runBy>", "Line")], catalog=c)
    return c


def _rows():
    out = []

    def node(name, types, **values):
        out.extend((None, ENT + name, RDF_TYPE, "iri", T + t, None, None) for t in types)
        for label, given in values.items():
            for v in given if isinstance(given, list) else [given]:
                if isinstance(v, str) and v.startswith("@"):
                    out.append((None, ENT + name, P + label, "iri", ENT + v[1:], None, None))
                else:
                    kind = "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "dateTime" if v.endswith("Z") else "string"
                    out.append((None, ENT + name, P + label, "literal", str(v).lower() if kind == "boolean" else str(v), XSD + kind, None))

    node("a", ["Stop"], title="Ash", zone=1, opened="1871-06-01T00:00:00Z", staffed=True, alias=["Old Ash", "Ashes"], next=["@b", "@f"], hub="@c")
    node("b", ["Stop"], title="Birch", zone=1, staffed=False, next="@c", hub="@c")
    node("c", ["Stop"], title="Cedar", zone=2, next="@d")
    node("d", ["Terminus"], title="Dogwood", zone=3, platforms=4, next="@b", hub="@a")
    node("f", ["Stop"], title="Fir")
    node("red", ["Line"], title="Red", calls=["@a", "@b", "@c"], runBy="@k")
    node("owl", ["NightLine", "Line"], title="Owl", calls=["@c", "@d"], until=5)
    node("k", ["Company"], title="Kestrel")
    node("m", ["Company"], title="Merlin")
    return out


ROWS = _rows()


def source(spark, rows=None) -> QuadSource:
    return QuadSource(quads_frame(spark, ROWS if rows is None else rows).coalesce(1), catalog())


def short(x):
    """Ids without their prefix, at any depth."""
    if isinstance(x, dict):
        return {k: short(v) for k, v in x.items()}
    if isinstance(x, list):
        return [short(v) for v in x]
    return x.removeprefix(ENT) if isinstance(x, str) else x
