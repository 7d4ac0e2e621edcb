from datetime import datetime

import pytest

from trellisq.functions.expr import Ctx, E, QueryError
from trellisq.plans.mutations import Delete
from trellisq.plans.query import Triples
from trellisq.plans.wire import from_json, triples_to_json
from trellisq.paths import PathError, Ref, parse, render

from .railway import ENT, source


@pytest.fixture(scope="module")
def src(spark):
    return source(spark)


@pytest.fixture(scope="module")
def Stop(src):
    return src.catalog.shape("Stop")


def selects(S):
    return [
        S.select(lambda s: [s.title, s.next, s.hub.title]),
        S.select(lambda s: s.next.where(lambda n: n.title.equals("Birch") & n.zone.equals(1)).title),
        S.select(lambda s: {"n": s.next.size(), "len": s.title.strlen().plus(1)}),
        S.select(lambda s: s.next.select(lambda n: [n.title, n.hub.select(lambda h: {"x": h.title})]).order_by(lambda n: n.zone).limit(2)),
        S.select(lambda s: s.next.as_("Terminus").platforms),
        S.select().where(lambda s: s.next.some(lambda n: n.title.equals("Cedar")) | ~s.zone.equals(3)),
        S.select().where(lambda s: s.next.every(lambda n: n.title.neq("Fir"))).order_by(lambda s: s.zone, "DESC").limit(3).offset(1),
        S.select().where(lambda s: s.next.size().gt(1) & s.zone.one_of([1, 4])),
        S.select().where(lambda s: s.opened.lt(datetime(1900, 1, 1, 12))),
        S.select().where(lambda s: s.zone.default_to(0).equals(0)),
        S.select().where(lambda s: s.hub.equals(Ctx("home"))).one(),
        S.select(lambda s: s.title).for_all([ENT + "a", ENT + "d"]),
        S.select().minus(lambda s: [s.zone, s.hub.title]).minus(lambda s: s.title.equals("x")),
        S.select(lambda s: {"zone": s.zone, "n": E.count(), "last": s.opened.max()}).group_by("zone").having("n", lambda n: n.gte(1)).group_order_by("n", "DESC"),
        S.select().where(lambda s: s.zone.is_defined()).count(),
        S.select().where(lambda s: s.title.starts_with("D")).exists(),
        S.select(lambda s: s.type_()).order_by(lambda s: s),
    ]


def test_selects_survive_the_round_trip(src, Stop):
    for q in selects(Stop):
        first = q.to_json()
        again = from_json(first, src.catalog)
        assert again.to_json() == first
        context = {"home": {"id": ENT + "c"}}
        a, b = (sorted(x, key=str) if isinstance(x, list) else x for x in (q.run(src, context), again.run(src, context)))
        assert a == b, first


def test_hand_written_envelopes(src, Stop):
    run = lambda **j: from_json({"v": "1.0", "shape": Stop.iri, **j}, src.catalog).run(src)
    ids = lambda rows: "".join(sorted(r["id"].removeprefix(ENT) for r in rows))
    assert ids(run(where={"next.title": "Birch"})) == "ad"
    assert ids(run(where={"next.some": {"title": "Birch"}, "zone": {"!=": 3}})) == "a"
    assert ids(run(where={"title.strlen()": {">": 3, "<": 7}})) == "bc"
    assert ids(run(where=["<", ["+", ["strlen", {"@path": "title"}], 10], 14])) == "af"
    assert ids(run(where={"next.size()": {">=": 2}})) == "a"
    assert ids(run(where={"title": {"in": {"@list": ["Cedar"]}}})) == "c"
    assert ids(run(where={"not": {"zone": 1}})) == "cd"
    rows = run(fields=[{"next": {"as": "after", "where": {"title": "Fir"}, "fields": ["title"]}}, {"as": "len", "value": {"@path": "title.strlen()"}}], subject=ENT + "a")
    assert rows["after"][0]["title"] == "Fir" and rows["len"] == 3
    for bad in ({"where": {}}, {"where": {"title": {"?": 1}}}, {"op": "odd"}, {"requires": ["odd"]}, {"txId": ""}, {"where": ["EVIL", 1]}, {"fields": ["nothing"]}):
        with pytest.raises(QueryError):
            run(**bad)
    with pytest.raises(QueryError):
        from_json({"v": "2.0", "shape": Stop.iri}, src.catalog)


def test_mutations_and_triples(src, Stop):
    for m in (
        Stop.create({"__id": "urn:x", "title": "A", "hub": {"title": "B"}, "next": [{"id": "urn:y"}], "opened": datetime(2020, 1, 1)}),
        Stop.update({"zone": None, "next": {"add": [{"id": "urn:y"}], "remove": [{"id": "urn:z"}]}}).for_("urn:x"),
        Stop.update(lambda s: {"title": s.hub.title.ucase()}).where(lambda s: s.title.equals("x")),
        Stop.update({"zone": 1}).for_all(),
        Stop.upsert({"zone": 1}).for_("urn:x"),
        Stop.delete(["urn:x"]).keep_links(),
        Stop.delete_all(),
        Stop.delete_where(lambda s: s.zone.equals(1)),
        Delete.shapeless(["urn:x"]),
    ):
        first = m.to_json()
        assert from_json(first, src.catalog).to_json() == first
    with pytest.raises(QueryError):
        from_json(Stop.delete(["urn:x"]).keep_links().to_json(), src.catalog, refuse_keep_incoming=True)
    t = Triples(object="urn:x", graphs=("urn:g",), limit_=3)
    assert from_json(triples_to_json(t)) == t


def test_paths():
    for text in ("a/b", "a|b/c", "^a", "(a/b)+", "a*/b?", "!(a|^b)", "^(a|b)"):
        assert parse(render(parse(text, base="urn:"))) == parse(text, base="urn:")
    assert parse("x:y", {"x": "urn:x:"}) == Ref("urn:x:y")
    for bad in ("", "a//b", "(a", "a b", "x:y", "a)"):
        with pytest.raises(PathError):
            parse(bad)
