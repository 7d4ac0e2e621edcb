import pytest

from trellisq.functions.expr import QueryError
from trellisq.plans.mutations import Store
from trellisq.sources.metadata import SH, Graphs, load_sources, ontology_rows, shape_rows, shapes_to_turtle, sync_ontology, sync_shapes
from trellisq.sources.quads import SUBCLASS, parse_turtle, quads_frame

from .railway import ENT, ROWS, P, T, catalog


def test_shapes_survive_turtle():
    rows = shape_rows(catalog())
    again = parse_turtle(shapes_to_turtle(catalog()))
    plain = lambda rs: sorted((s, p, k, o, d if k == "literal" else None) for _, s, p, k, o, d, _ in rs)
    assert plain(again) == plain(rows)
    said = {(s, p, o) for _, s, p, _, o, _, _ in rows}
    assert ("urn:shape:Stop", SH + "targetClass", T + "Stop") in said and ("urn:shape:Terminus", SH + "node", "urn:shape:Stop") in said
    assert ("urn:shape:Stop/zone", SH + "maxCount", "1") in said and ("urn:shape:Stop/hub", SH + "node", "urn:shape:Stop") in said
    (feeds,) = [o for s, p, o in said if (s, p) == ("urn:shape:Stop/feeders", SH + "path")]
    assert (feeds, SH + "inversePath", P + "hub") in said
    assert (T + "Terminus", SUBCLASS, T + "Stop") in {(s, p, o) for _, s, p, _, o, _, _ in ontology_rows(catalog())}


def test_graphs_and_syncs(spark):
    store = Store(quads_frame(spark, ROWS).coalesce(1), catalog(), cut_after=1)
    assert sync_shapes(store, "urn:g:shapes") and not sync_shapes(store, "urn:g:shapes")
    assert sync_ontology(store, "urn:g:classes")
    assert Graphs(store, "shapes").exists("urn:g:shapes") and not Graphs(store, "ontology").exists("urn:g:shapes")
    assert Graphs(store, "shapes").read("urn:g:shapes").count() == len(shape_rows(catalog()))
    drafts = Graphs(store, "draft")
    drafts.create("urn:g:draft", quads_frame(spark, [r for r in ROWS if r[1] == ENT + "f"]))
    drafts.publish("urn:g:draft", "urn:g:live")
    assert Graphs(store).exists("urn:g:live") and not drafts.exists("urn:g:draft") and Graphs(store).read("urn:g:live").count() == 2
    with pytest.raises(QueryError):
        Graphs(store, "odd")


def test_sources_from_a_configuration(spark, tmp_path):
    quads_frame(spark, ROWS).write.parquet(f"{tmp_path}/q")
    config = {"sources": {"main": {"path": f"{tmp_path}/q", "writable": True}}, "default": "main", "shapes": {"Line": "main"}}
    c = catalog()
    router = load_sources(spark, config, c)
    assert router.run(c.shape("Stop").count()) == 5 and router.run(c.shape("Line").count()) == 2
    for bad in ({**config, "default": "other"}, {"sources": {"x": {"format": "odd", "path": "p"}}, "default": "x"}, {"sources": {"x": {"odd": 1, "path": "p"}}, "default": "x"}):
        with pytest.raises(QueryError):
            load_sources(spark, bad, c)
