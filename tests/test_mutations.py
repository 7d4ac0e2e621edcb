import pytest

from trellisq.functions.expr import QueryError
from trellisq.operators.validate import ValidationError, single_owner_violations, validate, validate_source
from trellisq.plans.mutations import Conflict, Delete, Store
from trellisq.plans.query import Triples
from trellisq.shapes import Catalog, Shape, literal, relation
from trellisq.sources.quads import quads_frame, read_ntriples, to_ntriples, parse_turtle
from trellisq.streaming.live import LiveQueries, dependencies, effects, effects_from_json, effects_to_json

from .railway import ENT, ROWS, catalog, short


@pytest.fixture
def store(spark):
    n = iter(range(1000))
    return Store(quads_frame(spark, ROWS).coalesce(1), catalog(), cut_after=1, mint=lambda: f"{ENT}new{next(n)}")


def stop(store):
    return store.catalog.shape("Stop")


def get(store, id_, fields):
    return short(stop(store).select(fields).for_(ENT + id_).run(store))


def test_create_update_delete(store):
    S = stop(store)
    made = S.create({"title": "Gorse", "next": [{"id": ENT + "a"}, {"title": "Hazel"}]}).run(store)
    assert short(made)["next"][0] == {"id": "a"} and {n["title"] for n in get(store, short(made["id"]), ["next.title"])["next"]} == {"Ash", "Hazel"}
    assert S.update({"zone": 5, "aliases": ["X", "Y"]}).for_(ENT + "b").run(store)["aliases"] == {"updatedTo": ["X", "Y"]}
    assert get(store, "b", ["zone", "aliases"]) == {"id": "b", "zone": 5, "aliases": ["X", "Y"]}
    S.update({"next": {"add": [{"id": ENT + "d"}], "remove": [{"id": ENT + "f"}]}, "zone": None}).for_(ENT + "a").run(store)
    assert get(store, "a", ["zone", "next"]) == {"id": "a", "zone": None, "next": [{"id": "b"}, {"id": "d"}]}
    S.update({"next": {"add": [{"id": ENT + "d"}]}}).for_(ENT + "a").run(store)  # it is a set
    assert store.quads.count() == store.quads.distinct().count()
    S.update(lambda s: {"title": s.hub.title.ucase()}).for_(ENT + "d").run(store)
    assert get(store, "d", ["title"])["title"] == "ASH"
    S.update({"zone": 7}).for_(ENT + "nowhere").run(store)
    assert S.select().for_(ENT + "nowhere").run(store) is None
    S.upsert({"title": "Up"}).for_(ENT + "nowhere").run(store)
    assert get(store, "nowhere", ["title"])["title"] == "Up"
    assert S.update({"zone": 8}).where(lambda s: s.title.equals("Fir")).run(store) == {"count": 1}
    assert S.delete([ENT + "b", ENT + "red"]).run(store) == {"deleted": [ENT + "b"], "count": 1}
    assert get(store, "a", ["next"])["next"] == [{"id": "d"}]
    assert S.delete_where(lambda s: s.zone.equals(8)).run(store)["count"] == 1
    assert S.delete_all().run(store)["count"] >= 4 and S.count().run(store) == 0
    with pytest.raises(ValidationError):
        S.create({"title": 3}).run(store)
    with pytest.raises(QueryError):
        S.create({"title": S.select().root.title.ucase()})


def test_owned_nodes_go_with_their_owner(spark):
    c = Catalog()
    Shape("Photo", "urn:t:Photo", [literal("caption", "<urn:p:caption>"), relation("next", "<urn:p:next>", "Photo", many=False, contains=True)], catalog=c)
    Album = Shape("Album", "urn:t:Album", [relation("cover", "<urn:p:cover>", "Photo", many=False, contains=True)], catalog=c)
    s = Store(quads_frame(spark, []), c, cut_after=1)
    a = Album.create({"__id": "urn:a", "cover": {"__id": "urn:c", "caption": "x", "next": {"__id": "urn:n", "next": {"id": "urn:c"}}}}).run(s)
    assert a["cover"] == {"id": "urn:c"} and c.shape("Photo").count().run(s) == 2
    # Only nodes of the owned class, or of none that is known, are linked as owned.
    Other = Shape("Other", "urn:t:Other", [literal("caption", "<urn:p:caption>")], catalog=c)
    Other.create({"__id": "urn:o"}).run(s)
    for refused in (Album.create({"cover": {"id": "urn:o"}}), Album.update({"cover": {"id": "urn:o"}}).for_("urn:a")):
        with pytest.raises(QueryError):
            refused.run(s)
    Album.create({"__id": "urn:a2", "cover": {"id": "urn:unknown"}}).run(s)
    Album.delete("urn:a2").run(s)
    Other.delete("urn:o").run(s)
    Album.update({"cover": {"caption": "y"}}).for_("urn:a").run(s)
    assert [r["caption"] for r in c.shape("Photo").select(["caption"]).run(s)] == ["y"]
    Album.delete("urn:a").run(s)
    assert s.quads.count() == 0
    assert single_owner_violations(s).count() == 0


def test_transactions(store):
    S = stop(store)
    tx, other = store.begin(), store.begin()
    tx.apply(S.create({"title": "In"}))
    assert tx.run(S.count()) == 6 and S.count().run(store) == 5
    tx.commit()
    assert S.count().run(store) == 6
    other.apply(S.create({"title": "Late"}))
    with pytest.raises(Conflict):
        other.commit()
    with pytest.raises(QueryError):
        store.begin(idle=-1).run(S.count())


def test_triples_graphs_and_text(store, spark, tmp_path):
    assert short(Triples().for_node(ENT + "c").with_predicate("urn:rail:title").df(store).first()["object"]) == "Cedar"
    assert Triples().to_node(ENT + "c").df(store).count() == 5
    assert [r["term"] for r in Triples().to_node(["urn:kind:Stop", "urn:kind:None"]).which_exist(store).collect()] == ["urn:kind:Stop"]
    with pytest.raises(QueryError):
        Triples(predicate="urn:rail:title").df(store)
    to_ntriples(store.quads).write.text(str(tmp_path / "q"))
    again = read_ntriples(spark, str(tmp_path / "q"))
    assert sorted(map(str, again.collect())) == sorted(map(str, store.quads.collect()))
    more = quads_frame(spark, parse_turtle('@prefix r: <urn:rail:> . @prefix e: <urn:at:> . e:z a <urn:kind:Stop> ; r:title "Zelkova\\n" , "Z"@en ; r:zone 3 .'))
    assert more.count() == 4
    store.graph_create("urn:g", more)
    S = stop(store)
    assert S.select().from_("urn:g").count().run(store) == 1 and S.count().run(store) == 6
    with pytest.raises(QueryError):
        store.graph_create("urn:g")
    store.graph_patch("urn:g", add=more.limit(2), remove=more.where("o_lang = 'en'"))
    assert Triples(graphs=("urn:g",)).df(store).count() in (3, 4) and store.quads.count() == store.quads.distinct().count()
    Delete.shapeless(["urn:at:z"]).run(store)
    store.graph_drop("urn:g")
    assert S.count().run(store) == 5


def test_validation(store):
    S = stop(store)
    report = validate(S, {"title": 3, "next": ["x"], "odd": 1}, "partial")
    assert {r.component for r in report.results} == {"datatype", "nodeKind", "closed"}
    assert validate_source(store, store.catalog.shape("Terminus")).count() == 0
    c = Catalog()
    Strict = Shape("Strict", "urn:kind:Stop", [literal("title", "<urn:rail:title>", min_length=4, pattern="^[A-C]"), literal("zone", "<urn:rail:zone>", "integer", min_count=1), literal("alias", "<urn:rail:alias>")], catalog=c)
    found = {(short(r["focus"]), r["path"], r["component"]) for r in validate_source(Store(store.quads, c), Strict).collect()}
    assert found == {("a", "title", "min_length"), ("f", "title", "min_length"), ("f", "title", "pattern"), ("f", "zone", "minCount"), ("a", "alias", "maxCount")}


def test_live_queries(store, spark, tmp_path):
    S, Line = stop(store), store.catalog.shape("Line")
    d = dependencies(S.select(lambda s: [s.title, s.next.size()]).where(lambda s: s.hub.zone.equals(1)))
    assert d.narrow == {"urn:rail:title"} and d.hidden == {"urn:rail:next"} and d.filter == {"urn:rail:hub", "urn:rail:zone"} and d.unbound
    live, seen = LiveQueries(store), []
    end = live.subscribe(S.select(lambda s: s.title).where(lambda s: s.zone.equals(6)), seen.append)
    live.subscribe(S.count(), lambda n: seen.append(n))
    assert seen == [[], 5]
    S.update({"zone": 6}).for_(ENT + "f").run(store)
    assert short(seen[-1]) == [{"id": "f", "title": "Fir"}] and len(seen) == 3
    Line.update({"runBy": {"id": ENT + "m"}}).for_(ENT + "red").run(store)
    assert len(seen) == 3
    S.create({"title": "New"}).run(store)
    assert seen[-1] == 6
    end()
    e = effects(S.create({"title": "x", "hub": {"title": "y"}}))
    assert effects_from_json(effects_to_json(e)) == e and e.membership == {"Stop"}
    # A stream of changes drives the same matcher.
    changes = tmp_path / "changes"
    spark.createDataFrame([(effects_to_json(effects(S.delete_all())),)], "change string").write.parquet(str(changes))
    ran = []
    live.publish = lambda *es: ran.append(len(es))
    stream = live.follow(spark.readStream.schema("change string").parquet(str(changes)), str(tmp_path / "cp"))
    stream.processAllAvailable()
    stream.stop()
    assert ran == [1]
