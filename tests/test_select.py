import functools

import pytest

from trellisq.functions.expr import Ctx, E, QueryError
from trellisq.plans.query import FieldSet

from .railway import ENT, short, source


@pytest.fixture(scope="module")
def src(spark):
    s = source(spark)
    s.quads.cache()
    yield s
    s.quads.unpersist()


@pytest.fixture(scope="module")
def Stop(src):
    return src.catalog.shape("Stop")


def ids(rows):
    return sorted(short(r["id"]) for r in rows)


def by_id(rows):
    return {short(r["id"]): short({k: v for k, v in r.items() if k != "id"}) for r in rows}


def test_a_shape_reads_its_subclasses(src, Stop):
    assert by_id(Stop.select(lambda s: s.title).run(src)) == {k: {"title": t} for k, t in zip("abcdf", ("Ash", "Birch", "Cedar", "Dogwood", "Fir"), strict=True)}


def test_values_of_each_kind(src, Stop):
    rows = by_id(Stop.select(lambda s: [s.next, s.hub, s.opened, s.staffed, s.aliases, s.zone]).run(src))
    assert rows["a"]["next"] == [{"id": "b"}, {"id": "f"}] and rows["f"]["next"] == []
    assert rows["b"]["hub"] == {"id": "c"} and rows["c"]["hub"] is None
    assert rows["a"]["opened"].year == 1871 and rows["b"]["opened"] is None
    assert [rows[k]["staffed"] for k in "abc"] == [True, False, None]
    assert rows["a"]["aliases"] == ["Ashes", "Old Ash"] and rows["d"]["zone"] == 3


def test_one_subject_or_several(src, Stop):
    q = Stop.select(lambda s: s.title)
    assert short(q.for_(ENT + "d").run(src)) == {"id": "d", "title": "Dogwood"}
    assert q.for_("urn:nowhere").run(src) is None and q.for_(None).run(src) is None
    assert ids(q.for_all([ENT + "f", ENT + "b", "urn:nowhere"]).run(src)) == ["b", "f"]
    assert short(q.where(lambda s: s.equals({"id": ENT + "c"})).one().run(src))["title"] == "Cedar"


def test_paths_through_relations(src, Stop):
    rows = by_id(Stop.select(lambda s: [s.title, s.next.title, s.hub.title, s.hub.zone]).run(src))
    assert rows["a"]["next"] == [{"id": "b", "title": "Birch"}, {"id": "f", "title": "Fir"}]
    assert rows["b"]["hub"] == {"id": "c", "title": "Cedar", "zone": 2} and rows["c"]["hub"] is None
    twice = by_id(Stop.select(lambda s: s.next.next.title).run(src))
    assert twice["a"]["next"] == [{"id": "b", "next": [{"id": "c", "title": "Cedar"}]}, {"id": "f", "next": []}]


def test_selects_within_selects(src, Stop):
    rows = by_id(Stop.select(lambda s: s.next.select(lambda n: {"title": n.title, "n": n.next.size()})).run(src))
    assert rows["a"]["next"] == [{"id": "b", "title": "Birch", "n": 1}, {"id": "f", "title": "Fir", "n": 0}]
    rows = by_id(Stop.select(lambda s: s.next.select(lambda n: n.hub.select(lambda h: [h.title]))).run(src))
    assert rows["a"]["next"][0]["hub"] == {"id": "c", "title": "Cedar"} and rows["c"]["next"][0]["hub"] == {"id": "a", "title": "Ash"}


def test_filters_within_paths_keep_the_parents(src, Stop):
    rows = by_id(Stop.select(lambda s: s.next.where(lambda n: n.title.equals("Fir")).title).run(src))
    assert rows["a"]["next"] == [{"id": "f", "title": "Fir"}] and rows["d"]["next"] == [] and len(rows) == 5
    rows = by_id(Stop.select(lambda s: s.zone.where(lambda z: z.equals(2))).run(src))
    assert rows["c"]["zone"] == 2 and rows["a"]["zone"] is None
    with pytest.raises(QueryError):
        Stop.select(lambda s: s.next.where(lambda n: n.zone.equals(1)).where(lambda n: n.zone.equals(2)))


CONDITIONS = [
    ("a", lambda s: s.title.equals("Ash")),
    ("ad", lambda s: s.next.title.equals("Birch")),
    ("b", lambda s: s.next.some(lambda n: n.title.equals("Cedar"))),
    ("adf", lambda s: s.next.every(lambda n: n.title.equals("Birch") | n.title.equals("Fir"))),
    ("bcf", lambda s: s.next.none(lambda n: n.title.equals("Birch"))),
    ("bcf", lambda s: ~s.next.some(lambda n: n.title.equals("Birch"))),
    ("a", lambda s: s.next.size().equals(2)),
    ("ab", lambda s: s.hub.equals({"id": ENT + "c"})),
    ("a", lambda s: s.next.equals({"id": ENT + "f"})),
    ("cd", lambda s: s.zone.one_of([2, 3])),
    ("cd", lambda s: s.zone.not_one_of([1])),
    ("", lambda s: s.zone.one_of([])),
    ("abcd", lambda s: s.zone.not_one_of([])),
    ("f", lambda s: s.zone.is_not_defined()),
    ("f", lambda s: s.zone.default_to(9).equals(9)),
    ("df", lambda s: s.title.equals("Fir") | s.zone.equals(3)),
    ("a", lambda s: s.next.some(lambda n: n.title.equals("Fir")) & s.zone.equals(1)),
    ("bf", lambda s: s.next.some(lambda n: n.title.equals("Cedar")) | s.title.equals("Fir")),
    # A hop that a condition walks has to exist, under or and not as well.
    ("ab", lambda s: s.title.equals("Cedar") | s.hub.title.equals("Cedar")),
    ("", lambda s: s.hub.title.is_not_defined()),
    # Bodies of quantifiers need all their properties: Fir has no zone.
    ("c", lambda s: s.next.some(lambda n: n.title.equals("Fir") | n.zone.equals(3))),
    # A member compared with the outer node.
    ("d", lambda s: s.next.some(lambda n: n.title.strlen().lt(s.title.strlen()))),
    # Types that cannot be compared match nothing.
    ("", lambda s: s.title.equals(3)),
    ("", lambda s: s.title.neq(3)),
]


@pytest.mark.parametrize("k", range(len(CONDITIONS)))
def test_conditions(src, Stop, k):
    want, condition = CONDITIONS[k]
    assert "".join(ids(Stop.select().where(condition).run(src))) == want


def test_a_walked_condition_narrows_what_is_shown(src, Stop):
    rows = by_id(Stop.select(lambda s: s.next.title).where(lambda s: s.next.title.equals("Birch")).run(src))
    assert rows == {k: {"next": [{"id": "b", "title": "Birch"}]} for k in "ad"}
    rows = by_id(Stop.select(lambda s: s.next.title).where(lambda s: s.next.some(lambda n: n.title.equals("Birch"))).run(src))
    assert len(rows["a"]["next"]) == 2
    rows = by_id(Stop.select(lambda s: s.next.next.title).where(lambda s: s.next.next.title.equals("Dogwood")).run(src))
    assert rows == {"b": {"next": [{"id": "c", "next": [{"id": "d", "title": "Dogwood"}]}]}}


def test_computed_fields_and_counts(src, Stop):
    rows = by_id(Stop.select(lambda s: {"n": s.next.size(), "len": s.title.strlen()}).run(src))
    assert rows["a"] == {"n": 2, "len": 3} and rows["f"] == {"n": 0, "len": 3}
    # What a computed field walks must exist: Fir leads nowhere.
    assert by_id(Stop.select(lambda s: {"n": s.next.next.size()}).run(src)) == {k: {"n": 1} for k in "abcd"}
    assert by_id(Stop.select(lambda s: {"u": s.hub.title.ucase()}).run(src)) == {"a": {"u": "CEDAR"}, "b": {"u": "CEDAR"}, "d": {"u": "ASH"}}
    assert by_id(Stop.select(lambda s: {"is": s.hub.equals({"id": ENT + "c"})}).run(src))["d"]["is"] is False
    assert Stop.select().where(lambda s: s.zone.is_defined()).count().run(src) == 4 and Stop.count().run(src) == 5
    assert Stop.select().exists().run(src) is True and Stop.select().where(lambda s: s.zone.gt(3)).exists().run(src) is False


def test_minus(src, Stop):
    minus = lambda *ws: "".join(ids(functools.reduce(lambda q, w: q.minus(w), ws, Stop.select()).run(src)))
    assert minus(lambda s: s.zone) == "f" and minus(lambda s: [s.zone, s.aliases]) == "bcdf"
    assert minus(lambda s: [s.hub.title]) == "cf" and minus(lambda s: s.zone.equals(1)) == "cdf"
    assert minus(src.catalog.shape("Terminus"), lambda s: s.title.equals("Ash")) == "bcf"


def test_order_and_pages(src, Stop):
    order = lambda q: "".join(short(r["id"]) for r in q.run(src))
    q = Stop.select(lambda s: s.title)
    assert order(q.order_by(lambda s: s.title, "DESC").limit(2)) == "fd"
    assert order(q.order_by(lambda s: s.zone)) == "abcdf" and order(q.order_by(lambda s: s.zone, "DESC")) == "dcabf"
    assert order(q.offset(1).limit(2)) == "bc"
    assert order(q.order_by(lambda s: s.next.title, "DESC")) == "acbdf"
    assert order(q.order_by(lambda s: s.title.strlen(), "DESC").limit(1)) == "d"
    rows = by_id(Stop.select(lambda s: s.next.select(lambda n: [n.title]).order_by(lambda n: n.zone).limit(1)).run(src))
    assert rows["a"]["next"] == [{"id": "b", "title": "Birch"}] and rows["c"]["next"] == [{"id": "d", "title": "Dogwood"}]
    # A page counts nodes, not the rows of a condition.
    assert len(Stop.select(lambda s: s.next.title).where(lambda s: s.next.title.neq("x")).limit(2).run(src)) == 2


def test_casts_types_and_paths(src, Stop):
    Line, Terminus, Night = (src.catalog.shape(x) for x in ("Line", "Terminus", "NightLine"))
    rows = by_id(Line.select(lambda x: [x.calls.as_(Terminus).platforms, x.starts]).run(src))
    assert rows["owl"]["calls"] == [{"id": "c", "platforms": None}, {"id": "d", "platforms": 4}] and rows["red"]["starts"] == {"id": "a"}
    assert [t["id"] for t in by_id(Night.select(lambda x: x.type_()).run(src))["owl"]["$type"]] == ["urn:kind:Line", "urn:kind:NightLine"]
    rows = by_id(Stop.select(lambda s: [s.onward, s.feeders]).run(src))
    reach = lambda k, of: "".join(r["id"] for r in rows[k][of])
    assert reach("a", "onward") == "bcdf" and reach("d", "onward") == "bcd" and reach("c", "feeders") == "ab"


def test_groups(src, Stop):
    q = Stop.select(lambda s: {"zone": s.zone, "n": E.count(), "next": s.next.size()}).group_by("zone")
    assert {r["zone"]: (r["n"], r["next"]) for r in q.run(src)} == {1: (2, 3), 2: (1, 1), 3: (1, 1), None: (1, 0)}
    assert [r["zone"] for r in q.having("n", lambda n: n.gt(1)).run(src)] == [1]
    assert [r["n"] for r in q.group_order_by("n", "DESC").limit(1).run(src)] == [2]
    with pytest.raises(QueryError):
        Stop.select(lambda s: {"zone": s.zone, "title": s.title}).group_by("zone")


def test_two_relations_of_a_group_are_counted_by_themselves(src, Stop):
    """Stops of a group that lead to several stops and are hubs of several others: no product of the two."""
    q = Stop.select(lambda s: {"zone": s.zone, "n": E.count(), "next": s.next.size(), "fed": s.feeders.title.count_distinct(), "last": s.next.title.max()}).group_by("zone")
    got = {r["zone"]: (r["n"], r["next"], r["fed"], r["last"]) for r in q.run(src)}
    assert got == {1: (2, 3, 1, "Fir"), 2: (1, 1, 2, "Dogwood"), 3: (1, 1, 0, "Birch"), None: (1, 0, 0, None)}


def test_context_preload_and_field_sets(src, Stop):
    q = Stop.select(lambda s: s.title).where(lambda s: s.hub.equals(Ctx("home")))
    assert ids(q.run(src, {"home": {"id": ENT + "a"}})) == ["d"] and q.run(src) is None
    q = Stop.select(lambda s: s.title).where(lambda s: s.next.some(lambda n: n.title.equals(Ctx("home", (), Stop).title)))
    assert ids(q.run(src, {"home": {"id": ENT + "f"}})) == ["a"]
    card = Stop.select(lambda s: [s.title, s.zone])
    assert by_id(Stop.select(lambda s: s.hub.preload_for(card)).run(src))["b"]["hub"] == {"id": "c", "title": "Cedar", "zone": 2}
    fields = FieldSet.for_(Stop, ["title"]).add("zone").remove("title").merge(FieldSet(Stop, ["hub.title"]))
    assert by_id(Stop.select(fields).run(src))["b"] == {"zone": 1, "hub": {"id": "c", "title": "Cedar"}}
    assert set(by_id(Stop.select_all().run(src))["a"]) == set(Stop.properties)
