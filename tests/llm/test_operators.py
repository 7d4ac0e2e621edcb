import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellisq.llm import decontaminate, lines, mixing, near_duplicates, personal, quality, secrets, sharding, substrings, suffixes
from trellisq.llm.arrays import Words, mix

from . import corpus


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus.rows(), corpus.SCHEMA).repartition(3).cache()
    df.count()
    yield df
    df.unpersist()


@pytest.fixture(scope="module")
def rows():
    return corpus.rows()


def named(rows):
    return [(r[0], r[1]) for r in rows if r[0] is not None]


def test_near_duplicates(docs, rows):
    got = near_duplicates.linked(docs).collect()
    assert len(got) == len(rows)
    want = corpus.near_components(named(rows))
    for r in got:
        if r["id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["id"]]
    kept = near_duplicates.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    assert ids == collections.Counter({i: 1 for i, (_, c) in want.items() if c == i} | {None: 1})


def test_links_within_components(docs, rows, monkeypatch):
    """Every link between different texts is counted, in one block or several."""
    sets = {}
    for i, t in named(rows):
        w = corpus.words(corpus.lower(t))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    different = {s for s in sets.values() if s}
    want = {i: sum(100 * len(s & o) >= 80 * len(s | o) for o in different if o != s) if s else 0 for i, s in sets.items()}
    assert max(want.values()) > 2
    for least in (near_duplicates.LINK_SETS, 2):
        monkeypatch.setattr(near_duplicates, "LINK_SETS", least)
        for r in near_duplicates.linked(docs, count_links=True).collect():
            assert r["n_links"] == (None if r["id"] is None else want[r["id"]])


def test_parity_parts_lose_no_pair():
    """Any two sets within the allowed difference share a key, whatever their sizes."""
    rng = np.random.Generator(np.random.PCG64(1))
    rarity = rng.integers(0, 50, 1 << near_duplicates.SLOT_BITS)

    def sets(*arrays):
        s = near_duplicates.Sets([])
        s.size = np.array([len(a) for a in arrays])
        s.shingles, s.doc = np.concatenate([np.sort(a) for a in arrays]), np.repeat(np.arange(len(arrays)), s.size)
        s.first = np.concatenate([[0], np.cumsum(s.size)])
        return s

    for n in [*range(1, 40), 63, 64, 65, 100, 127, 128, 200, 500, 1023, 1024]:
        for _ in range(12):
            a = mix(rng.integers(0, 2**63, n, dtype=np.uint64))
            cut, more = int(rng.integers(0, n // 5 + 1)), int(rng.integers(0, n // 4 + 1))
            b = np.concatenate([a[cut:], mix(rng.integers(0, 2**63, more, dtype=np.uint64))])
            if 100 * (n - cut) >= 80 * (n + more) and cut + more:
                text, key = sets(a, b).keys(rarity, 80, np.ones(2, bool))
                assert set(key[text == 0].tolist()) & set(key[text == 1].tolist()), (n, cut, more)


def test_quality(docs, rows, spark):
    measured = quality.with_features(docs)
    for r in measured.collect():
        assert tuple(r[quality.PREFIX + x] for x in quality.FEATURES[:5]) == corpus.quality(r["text"])
    labels = spark.createDataFrame([(r[0], 1) for r in rows if r[0] is not None] + [(1, None), (None, 1), (9999, 0)], "doc_id long, quality int")
    judged = quality.judge(docs, labels)
    assert judged.where("base_failed and kept").isEmpty() and judged.where("not base_failed and not kept").isEmpty()
    # With many labels a rule is learned that keeps the promised share of good documents.
    many = [(k, ("word " * 3 + f"w{k} x{k * 7} y{k % 11} ") * 3 + ("# " * 30 if k % 5 == 0 else ""), "en") for k in range(2000)]
    frame = spark.createDataFrame(many, "doc_id long, text string, lang string")
    label = spark.createDataFrame([(k, int(k % 5 != 0)) for k, _, _ in many], "doc_id long, quality int")
    out = {r["doc_id"]: r["kept"] for r in quality.judge(frame, label, s=quality.Settings(max_repeat_percent=100)).select("doc_id", "kept").collect()}
    assert not any(v for k, v in out.items() if k % 5 == 0) and all(v for k, v in out.items() if k % 5)


def test_binomial_bound():
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05**0.01, abs=1e-6)
    assert quality.upper_bound(5, 50, 0.025) == pytest.approx(0.21814, abs=1e-4)
    assert quality.upper_bound(3, 3, 0.05) == 1.0


def test_substrings(docs, rows):
    want = corpus.without_windows(named(rows))
    for bits in (26, 8):  # a Bloom filter that is far too small changes nothing
        out = substrings.without_repeats(docs, bloom=bits)
        assert out.columns == [c for c in docs.columns if c != "n_words"] + ["n_words", "n_removed", "kept_text"]
        for r in out.collect():
            if r["doc_id"] is None:
                assert r["n_removed"] == 0
            else:
                assert (r["n_words"], r["n_removed"], r["kept_text"]) == want[r["doc_id"]]
    for p, cover in substrings.COVERS.items():
        assert {(a - b) % p for a in cover for b in cover} == set(range(p))


def test_decontamination(docs, rows, spark):
    items = [(1, rows[0][1]), (2, rows[5][1]), (3, rows[0][1]), (4, "one"), (5, ""), (6, None), (None, "one two"), (2, "la la la la la la la la la")]
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = collections.defaultdict(set)
    for i, t in items:
        w = re.findall(pattern, corpus.lower(t))
        if w and i is not None:
            for k in range(max(1, len(w) - 7)):
                windows[tuple(w[k : k + 8])].add(str(i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (16 << 20, 50):
        for r in decontaminate.annotate(docs, bench, block_bytes=block).collect():
            w, hit, found = re.findall(pattern, corpus.lower(r["text"])), set(), set()
            for size in {len(x) for x in windows}:
                for k in range(len(w) - size + 1):
                    if ids := windows.get(tuple(w[k : k + size])):
                        hit.update(range(k, k + size))
                        found |= ids
            assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (len(w), len(hit), sorted(found), len(found) >= 2)
    assert decontaminate.annotate(docs, bench.limit(0)).where("n_hit > 0").isEmpty()


def test_secrets(docs):
    for r in secrets.scanned(docs).select("text", secrets._joined(F.col("base")).alias("b"), secrets._joined(F.col("spans")).alias("s")).collect():
        assert r["b"] == corpus.secrets(r["text"])
        assert set(filter(None, r["b"].split(","))) <= set(r["s"].split(","))


def test_secret_model(spark):
    """Held-out random strings are told from held-out identifiers."""
    import random

    r = random.Random(3)
    rand = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    plain = ["alpha", "request", "handler", "config", "total", "index", "value", "user", "token", "order", "item", "count"]
    name = lambda: "_".join(r.choice(plain) for _ in range(4))
    train = [(k, f"api_key = {rand(32)}") for k in range(150)] + [(1000 + k, " ".join(name() for _ in range(20))) for k in range(150)]
    test = [(5000 + k, f"see {rand(30)}7a now") for k in range(40)] + [(6000 + k, f"see {name()}_{name()}2 now") for k in range(40)]
    out = {x["doc_id"]: x["n_model"] for x in secrets.scanned(spark.createDataFrame(train + test, "doc_id long, text string")).collect()}
    assert sum(out[5000 + k] for k in range(40)) >= 36 and sum(out[6000 + k] for k in range(40)) <= 2


def test_secret_model_short_and_inside(spark):
    """Keys of 12 to 19 characters, of letters alone, inside paths, and beside base spans are scored by themselves."""
    import random

    r = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    rand = lambda n, of=letters + "0123456789": "".join(r.choice(of) for _ in range(n))
    plain = ["alpha", "request", "handler", "config", "total", "index", "value", "user", "order", "item", "count"]
    name = lambda n: "_".join(r.choice(plain) for _ in range(n))
    train = [(k, f"api_key = {rand(32)}") for k in range(150)] + [(1000 + k, " ".join(name(4) for _ in range(20))) for k in range(150)]
    kinds = {
        2000: lambda: f"see {rand(16)} now", 3000: lambda: f"see {rand(18, letters)} now", 4000: lambda: f"{name(8)}/{rand(20)}/{name(8)}",
        5000: lambda: f"{rand(20)}/secret={rand(16)}", 6000: lambda: f"see {name(5)} and {name(2)}/{name(3)}",
    }
    test = [(k + j, make()) for k, make in kinds.items() for j in range(40)]
    frame = spark.createDataFrame(train + test, "doc_id long, text string")
    out = {x["doc_id"]: x["n_model"] for x in secrets.scanned(frame).collect()}
    hit = {k: sum(out[k + j] > 0 for j in range(40)) for k in kinds}
    assert all(hit[k] >= 32 for k in (2000, 3000, 4000, 5000)) and hit[6000] <= 2, hit


def test_sharding(docs, rows):
    out = sharding.sharded(docs, shards=4).collect()
    assert len(out) == len(rows)
    slots, group, load = collections.defaultdict(list), collections.defaultdict(set), collections.Counter()
    for r in out:
        body = (r["text"] or "").encode()
        assert r["size"] == len(body) + 1 and r["text_crc32"] == zlib.crc32(body) and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        group[r["text"] or ""].add(r["shard"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in group.values())
    small = docs.where("length(text) < 5000")
    loads = [x["n"] for x in sharding.sharded(small, shards=3).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    largest = small.agg(F.max(F.octet_length("text"))).first()[0]
    assert len(loads) == 3 and max(loads) - min(loads) <= 2 * largest


def test_personal(docs):
    for r in personal.sanitised(docs).select("text", "sanitised", personal.joined(F.col("base")).alias("b"), "n_email", "n_card").collect():
        assert r["b"] == corpus.personal(r["text"])
        if r["n_email"]:
            assert "<EMAIL>" in r["sanitised"] and "@b.co" not in r["sanitised"]
        if r["text"] is None:
            assert r["sanitised"] is None


def test_disclosing_terms(spark):
    known = [(k, f"word{k} zebrafeld meets jane@x.org in town number {k} " + "the usual talk " * 5) for k in range(6)]
    rest = [(100 + k, f"the usual talk in town about nothing {k}") for k in range(30)] + [(200, "only zebrafeld here")]
    out = {r["doc_id"]: r for r in personal.sanitised(spark.createDataFrame(known + rest, "doc_id long, text string")).collect()}
    assert out[200]["n_term"] == 1 and out[200]["sanitised"] in ("only <TERM> here", "only  here")
    assert all(out[100 + k]["n_term"] == 0 for k in range(30))


def test_terms_of_entities_of_few_texts(spark):
    """An entity of one text is disclosed by terms of this text alone, however far away; one of two texts by terms of both."""
    talk = "the usual talk " * 10
    rows = [(1, f"zebrafeld {talk} jane@x.org and bob@x.org met"), (2, f"quorn {talk} ann@y.org"), (3, f"{talk} quorn ann@y.org bob@x.org"), (4, f"met {talk}"), (5, "tal quorn-zebra")]
    out = {r["doc_id"]: r for r in personal.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = lambda k: [rows[k - 1][1][s["start"] : s["end"]] for s in out[k]["spans"] if s["kind"] == "term"]
    assert hit(1) == ["zebrafeld", "and"] and hit(2) == ["quorn"] and hit(3) == ["quorn"] and hit(4) == [] and hit(5) == ["quorn"]
    # Brute force over many texts and entities.
    import random

    r = random.Random(5)
    many = [(k, " ".join([r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 9) for _ in range(12)] + [f"u{r.randint(0, 30)}@x.org" for _ in range(r.randint(0, 3))])) for k in range(80)]
    words = {k: {w for w in t.split() if "@" not in w} for k, t in many}
    names = {k: {w for w in t.split() if "@" in w} for k, t in many}
    want = {w for w in set().union(*words.values()) for e in set().union(*names.values()) if sum(w in words[k] and e in names[k] for k in words) * 2 >= sum(w in words[k] for k in words) + 1}
    for x in personal.sanitised(spark.createDataFrame(many, "doc_id long, text string")).collect():
        assert x["n_term"] == sum(w in want for w in x["text"].split())
    assert want


def test_mixing(docs, rows):
    out = mixing.mixed(docs).collect()
    assert len(out) == len(rows)
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in out:
        assert r["size"] == len(corpus.words(r["text"])) and r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    left, free, want = sum(size.values()), list(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level > 3 * size[s]]
        for s in full or free:
            want[s] = 3 * size[s] if full else weight[s] * level
        left -= sum(want[s] for s in full)
        free = [s for s in free if s not in full] if full else []
    for s in order:
        assert target[s] == pytest.approx(want[s])
    again = mixing.mixed(docs.repartition(5)).collect()
    key = lambda rs: sorted((str(r["doc_id"]), str(r["source"]), r["taken"]) for r in rs)
    assert key(again) == key(out)


def test_suffixes(docs, rows):
    texts = [(r[1] or "").encode() for r in rows]
    want = collections.Counter(corpus.without_strings(texts))
    out = suffixes.without_repeated_strings(docs).select("n_bytes", "n_removed", "n_spans", "kept_bytes").collect()
    assert collections.Counter((a, b, c, bytes(d)) for a, b, c, d in out) == want
    few = suffixes.without_repeated_strings(docs, most=2, bloom=10).select("n_bytes", "n_removed", "n_spans", "kept_bytes").collect()
    assert collections.Counter((a, b, c, bytes(d)) for a, b, c, d in few) == want


def test_shared_passages(spark):
    """Passages too short to go are told if another text has them, and only then."""
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, own, copy, twice = text(330), text(330), text(300), text(500)
    texts = [text(500) + passage + text(400), text(90) + passage, text(200) + own + text(100) + own, copy, copy, text(200), None]
    texts += [text(50) + twice + text(50), twice + text(30) + twice, own[:249] + text(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    has = [{(t or "")[k : k + 250] for k in range(len(t or "") - 249)} for t in texts]
    want = {}
    for i, t in enumerate(texts):
        others = set().union(*(x for j, x in enumerate(has) if j != i))
        want[i] = len({b for k in range(len(t or "") - 249) if t[k : k + 250] in others for b in range(k, k + 250)})
    gone = [x[:3] for x in corpus.without_strings([(t or "").encode() for t in texts])]
    for settings in ({}, {"most": 1, "bloom": 12}):
        got = {x["doc_id"]: x for x in suffixes.without_repeated_strings(df, passage=250, **settings).collect()}
        assert {i: x["n_shared"] for i, x in got.items()} == want
        assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) for i in range(len(texts))] == gone
    assert (want[0], want[1], want[2], want[3], gone[0][1]) == (330, 330, 0, 300, 0)


def test_suffix_order():
    r = np.random.Generator(np.random.PCG64(5))
    raw = r.integers(97, 99, 400).astype(np.uint8)
    from trellisq.llm.arrays import prefix_sums

    start = np.sort(r.choice(380, 60, replace=False))
    group = np.sort(r.integers(0, 4, 60))
    end = np.minimum(start + 50, 400)
    order = suffixes.suffix_order(raw, prefix_sums(raw), group, start, end)
    text = [raw[start[k] : end[k]].tobytes() for k in order]
    assert all(group[order[k]] == group[k] for k in range(60))
    assert all(text[k] <= text[k + 1] for k in range(59) if group[k] == group[k + 1])


def test_lines(spark):
    page = lambda *ls: "<html><body><p>" + "</p><p>".join(ls) + "</p><script>x</script></body></html>"
    rows = [(k, f"https://www.a.org/{k}", page("menu", f"text {k}", "menu", "half" if k % 2 else "other")) for k in range(6)]
    rows += [(10, "http://b.org", page("menu")), (11, None, page("menu")), (12, "odd", None), (13, "http://u@A.org:80/x", ""), (10, "http://b.org", page("menu"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    out = collections.defaultdict(list)
    for r in lines.without_boilerplate(df, lines.host_of(F.col("url")), lines.html_lines(F.col("html"))).collect():
        out[r["page_id"]].append((r["host"], r["n_lines"], r["n_removed"], r["kept_text"]))
    assert out[0] == [("www.a.org", 4, 2, "text 0\nother")] and out[1] == [("www.a.org", 4, 2, "text 1\nhalf")]
    assert out[10] == [("b.org", 1, 0, "menu")] * 2 and out[11] == [("", 1, 0, "menu")] and out[12] == [("", 0, 0, "")] and out[13] == [("a.org", 0, 0, "")]


def test_page_stored_twice(spark):
    """A page is not compared with itself: stored twice it keeps its text, and it does not outvote the other pages of its host."""
    rows = [(1, "a", "only", {"k": 1})] * 2 + [(2, "b", "x\ny", {})] * 3 + [(3, "b", "z", None), (4, "b", "z w", None), (5, "c", None, None), (None, "c", "m", None), (5, "c", "m", None)]
    df = spark.createDataFrame(rows, "page_id long, site string, body string, more map<string,int>")
    body = F.filter(F.split(F.coalesce("body", F.lit("")), "\n"), lambda x: x != "")
    got = lambda **more: sorted((r["page_id"] or 0, r["n_lines"], r["n_removed"]) for r in lines.without_boilerplate(df, F.col("site"), body, **more).collect())
    assert got() == [(0, 1, 1), (1, 1, 0), (1, 1, 0), (2, 2, 0), (2, 2, 0), (2, 2, 0), (3, 1, 0), (4, 1, 0), (5, 0, 0), (5, 1, 1)]
    assert got(repeats=True) == [(0, 1, 1), (1, 1, 1), (1, 1, 1), (2, 2, 2), (2, 2, 2), (2, 2, 2), (3, 1, 0), (4, 1, 0), (5, 0, 0), (5, 1, 1)]


def test_empty_tables(docs, spark):
    none = docs.limit(0)
    labels, bench = spark.createDataFrame([], "doc_id long, quality int"), spark.createDataFrame([], "item_id long, text string")
    for out in (
        near_duplicates.linked(none), quality.judge(none, labels), substrings.without_repeats(none), decontaminate.annotate(none, bench), secrets.scanned(none),
        sharding.sharded(none), personal.sanitised(none), mixing.mixed(none), suffixes.without_repeated_strings(none),
    ):
        assert out.count() == 0


def test_words_of_blocks():
    texts = [b"a  b\n", b"", b" c", b"\xc3\xa9t\xc3\xa9 x"]
    w = Words(texts)
    assert [w.raw[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)] == [b"a", b"b", b"c", b"\xc3\xa9t\xc3\xa9", b"x"]
    assert w.first.tolist() == [0, 2, 2, 3, 5] and w.doc.tolist() == [0, 0, 2, 3, 3]
