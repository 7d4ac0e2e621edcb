"""The pipeline and each of its stages against brute force."""

import collections
import importlib.util
import random

import pytest

from . import corpus

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("the pipeline is not here", allow_module_level=True)

import corpus_pipeline  # noqa: E402


def clean(k):
    r = random.Random(k)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(60))


ITEM = clean(999)
SCHEMA = "doc_id long, text string, lang string, source string, size string, copies string, extra array<string>"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pipeline"))
    rows = [(k, clean(k)) for k in range(40)]
    rows += [(100, clean(3)), (101, clean(4) + " more"), (102, clean(5) + " " + ITEM[:200]), (103, "too short"), (104, None), (105, ""), (106, "a b c d e " * 20), (None, clean(6))]
    rows += [(107, clean(77)), (107, clean(78))]
    docs = [(k, t, "en", ["a", "b", None][n % 3], "x", "x", ["y"]) for n, (k, t) in enumerate(rows)]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def ids(df):
    return collections.Counter(r["doc_id"] for r in df.collect())


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    all_ids = ids(docs)
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality", "near_duplicates", "decontaminate", "mix", "shard"]
    kept = stage["quality"](spark, docs, folder)
    assert kept.columns == docs.columns and ids(kept) == all_ids - collections.Counter([103, 104, 105, 106])
    # Judged on its own input, each: near copies of 3 and 4 go; of the rows that share an id the least text stays; rows without an id stay.
    kept = stage["near_duplicates"](spark, docs, folder)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert ids(kept) == all_ids - collections.Counter([100, 101, 107])
    assert [r["text"] for r in kept.where("doc_id = 107").collect()] == [min(clean(77), clean(78))]
    assert ids(stage["decontaminate"](spark, docs, folder)) == all_ids - collections.Counter([102])
    mixed = stage["mix"](spark, docs, folder)
    assert mixed.columns == docs.columns and max(ids(mixed.where("doc_id != 107")).values()) <= 3
    sharded = stage["shard"](spark, docs, folder)
    assert ids(sharded) == all_ids and sharded.columns == [c for c in docs.columns if c != "size"] + ["size", "law", "shard", "slot"]
    assert {r["doc_id"]: r["size"] for r in sharded.collect()}[0] == len(clean(0)) + 1


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    got = {r["doc_id"] for r in out}
    assert got <= {None, *range(40), 107} and len(got) > 20 and len({(r["shard"], r["slot"]) for r in out}) == len(out)
    texts = collections.Counter(r["text"] for r in out)
    assert max(texts.values()) <= 6  # three copies, and a row without an id that has the text of another
    words = sum(len(corpus.words(t)) * n for t, n in texts.items())
    assert 0.9 * 42 * 60 <= words <= 1.1 * 42 * 60


def test_empty(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
