"""Near duplicates by word shingles: a join of parity sketches.

A document is its set of shingles.  Each shingle is hashed into one of k parts
and XORed there, so a part is a linear sketch over GF(2), and a shingle that
only one of two sets holds changes one part at most: the number of parts that
differ is a lower bound of the symmetric difference.  Sets of sizes a and b
that reach the similarity t differ in at most d = (a + b)(1 - t) / (1 + t)
shingles, so all but d of their parts are equal.

* Size bands: k is fixed for sizes from 2**i up to 2**(i + 1); a set whose partner
  may be in the next band is sketched there too.
* Pigeonhole: of the filled parts of a set, any d + 1 include one that its
  partner has.  Both sides take the d + 1 first in one common order, rarest
  first by counts of all shingles of the corpus, so passages that very many documents share
  are the last to be joined on.  The few sets that fill no more than d parts
  meet under one key of their band, so nothing is lost.
* Filter: each set also has a plain bit sketch, one bit flipped for each shingle;
  its Hamming distance bounds the difference again.
* Verify: the sets of 64-bit shingle hashes, rebuilt from the texts, are compared.

Equal sets (by 128 bits) are one class from the start.  Within a key's class list the pairs
are not written out: members are first verified against one hub of the list, the links
found join classes to components, and only classes whose components differ
are compared, sketch by sketch in blocks of bounded size.  So large groups of
near copies cost a row per member, and no link between components is lost.

Links within components are counted on demand: two similar sets are of one component,
so the shingle sets of a component are dealt to blocks of bounded size, every pair meets in one block, and
what leaves a block is a count for each set, not the pairs.

Edge cases: words are lower-cased (A-Z); a text with fewer words than a shingle
is one shingle; null and empty texts are linked with nothing; rows without an
id come back with component_id (and n_links) null; rows that share an id are
one document whose links are those of all its rows; no rows give no rows;
columns of the input named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays as A
from .components import components
from .shared import any_columns, documents, joined_small, stored

SHINGLE = 5
PERCENT = 80
SLOT_BITS = 16
CHUNK = 1024
HUB_ROUNDS = 2
#: Sets, and shingles, that a chunk of a component's sets holds on average.
LINK_SETS = 256
LINK_SHINGLES = 1 << 18


def difference(a, b, percent: int):
    """The most shingles in which sets of these sizes differ if intersection * 100 >= union * percent."""
    return (a + b) * (100 - percent) // (100 + percent)


class Sets:
    """The distinct shingle hashes of each text of a block, in the order of the texts."""

    def __init__(self, texts: list[bytes], n: int = SHINGLE):
        w = A.Words(texts, lower=True)
        hashed = w.hashes()
        at = w.whole(n)
        shingles, doc = (w.windows(hashed, n)[at] if len(at) else np.zeros(0, np.uint64)), w.doc[at]
        size = np.diff(w.first)
        few = np.flatnonzero((size > 0) & (size < n))
        if len(few):
            short = np.array([A.mix(np.array([self._short(hashed[w.first[d] : w.first[d + 1]])], np.uint64))[0] for d in few], np.uint64)
            shingles, doc = np.concatenate([shingles, short]), np.concatenate([doc, few])
        order = np.lexsort((shingles, doc))
        self.shingles, self.doc = shingles[order], doc[order]
        first = np.ones(len(order), bool)
        first[1:] = (self.shingles[1:] != self.shingles[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.shingles, self.doc = self.shingles[first], self.doc[first]
        self.size = np.bincount(self.doc, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.size)])

    @staticmethod
    def _short(words: np.ndarray) -> int:
        out = len(words)
        for x in words.tolist():
            out = (out * 0x9E3779B97F4A7C15 + x) & ((1 << 64) - 1)
        return out

    def prints(self) -> list[np.ndarray]:
        out = []
        for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(A.mix(self.shingles ^ np.uint64(salt)), dtype=np.uint64)])
            out.append(A.mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.size.astype(np.uint64)))
        return out

    def sketches(self) -> list[bytes]:
        """A bit per two shingles of the band's largest set at least, 256 at least; a wider sketch folds to a narrower one by XOR."""
        out = []
        for a, b in zip(self.first[:-1], self.first[1:], strict=True):
            width = max(256, 1 << int(b - a).bit_length())
            out.append(np.packbits((np.bincount((self.shingles[a:b] & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(bool), bitorder="little").tobytes())
        return out

    def keys(self, rarity: np.ndarray, percent: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, key) of the parts to join on. rarity: by the shingles' leading bits. wanted: which texts."""
        texts, keys = [], []
        band = np.array([int(x).bit_length() for x in self.size.tolist()])
        most = self.size * 100 // percent
        reach = difference(self.size, most, percent)
        for up in (0, 1):
            here = wanted & (self.size > 0) & (reach > 0)
            if up:  # partners in the next band
                here &= most >= 1 << np.minimum(band, 62)
            if not here.any():
                continue
            scheme = band + up
            parts = np.maximum(3 * (1 << np.minimum(scheme, 62)) // 8, 32)
            own = here[self.doc]
            shingles, doc = self.shingles[own], self.doc[own]
            spread = A.mix(shingles ^ np.uint64(0x2545F4914F6CDD1D))
            part = ((spread >> np.uint64(32)) * parts[doc].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((part, doc))
            doc, part, shingles = doc[order], part[order], shingles[order]
            start = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])]))
            xor = np.bitwise_xor.reduceat(shingles, start)
            rare = np.minimum.reduceat(rarity[shingles >> np.uint64(64 - SLOT_BITS)], start)
            doc, part = doc[start], part[start]
            key = A.mix(xor ^ A.mix((part + (scheme[doc] << 40)).astype(np.uint64)))
            order = np.lexsort((key, rare, doc))
            doc, key = doc[order], key[order]
            filled = np.bincount(doc, minlength=len(self.size))
            rank = np.arange(len(doc)) - (np.cumsum(filled) - filled)[doc]
            chosen = rank <= reach[doc]
            crowded = np.flatnonzero(here & (filled <= reach))
            texts += [doc[chosen], crowded]
            keys += [key[chosen], A.mix((scheme[crowded] | (1 << 62)).astype(np.uint64))]
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        text = np.concatenate(texts)
        order = np.argsort(text, kind="stable")
        return text[order], np.concatenate(keys)[order]


def _rarity(docs: DataFrame) -> np.ndarray:
    """How many shingles of the corpus begin with each SLOT_BITS bits: a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, np.int64)
        for _, texts in A.blocks(batches, "text"):
            w = A.Words(texts, lower=True)
            at = w.whole(SHINGLE)
            if len(at):
                counts += np.bincount((w.windows(w.hashes(), SHINGLE)[at] >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield A.table(slot=pa.array(seen.astype(np.int32)), n=counts[seen])

    out = np.zeros(1 << SLOT_BITS, np.int64)
    got = docs.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


def _sketched(docs: DataFrame, percent: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(_rarity(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for part, texts in A.blocks(batches, "text"):
            sets = Sets(texts)
            one, two = sets.prints()
            # Copies within a task give their keys once; rows without an id take no part.
            wanted = np.zeros(len(texts), bool)
            for k in np.flatnonzero(part.column(0).is_valid().to_numpy(zero_copy_only=False)).tolist():
                x = (int(one[k]), int(two[k]))
                wanted[k] = x not in seen
                seen.add(x)
            if len(seen) > 1 << 20:
                seen.clear()
            doc, key = sets.keys(sent.value, percent, wanted)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]).astype(np.int32)
            yield A.table(id=part.column(0), n=sets.size.astype(np.int64), c1=A.signed(one), c2=A.signed(two), sketch=pa.array(sets.sketches(), pa.binary()), keys=pa.ListArray.from_arrays(pa.array(offsets), pa.array(A.signed(key))))

    found = stored(docs.mapInArrow(run, "id long, n long, c1 long, c2 long, sketch binary, keys array<long>"))
    # Different sets of equal first hashes (a few pairs in 10**10 sets) get names of both hashes.
    clash = stored(found.where("n > 0").groupBy("c1").agg(F.min("c2").alias("lo"), F.max("c2").alias("hi")).where("lo < hi").select("c1", "lo"))
    if not clash.limit(1).count():
        return found.withColumn("c", F.col("c1"))
    return joined_small(found, clash, ["c1"], "left").withColumn("c", F.when(F.col("c2") != F.col("lo"), F.xxhash64("c1", "c2")).otherwise(F.col("c1"))).drop("lo")


def _of_class(sets: Sets, part: pa.RecordBatch) -> np.ndarray:
    """Which rows are of their class. part: c, c1, c2, ..."""
    one, two = sets.prints()
    return (A.signed(one) == part.column(1).to_numpy()) & (A.signed(two) == part.column(2).to_numpy())


def _near(na: int, a: bytes, nb: int, b: bytes, percent: int) -> bool:
    """Whether sizes and sketches allow the similarity."""
    if percent * max(na, nb) > 100 * min(na, nb):
        return False
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    m = min(len(x), len(y))
    apart = int(np.bitwise_count(_fold(x, m) ^ _fold(y, m)).sum())
    return apart <= difference(na, nb, percent)


def _fold(x: np.ndarray, m: int) -> np.ndarray:
    return x if len(x) == m else np.bitwise_xor.reduce(x.reshape(-1, m), axis=0)


def _filtered(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that their sketches allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, sa, nb, sb = (x.to_pylist() for x in batch.columns)
            keep = [k for k in range(len(a)) if _near(na[k], sa[k], nb[k], sb[k], percent)]
            yield A.table(a=pa.array([a[k] for k in keep], pa.int64()), b=pa.array([b[k] for k in keep], pa.int64()))

    side = lambda x: classes.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose shingle sets are similar. The texts of the classes at hand alone are moved."""
    pairs = stored(pairs)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    ids = stored(classes.join(ends, "c").select(F.col("least").alias("id"), "c", "c1", "c2"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows that share an id, those that are of the class."""
        for part, texts in A.blocks(batches, "text"):
            kept = part.filter(pa.array(_of_class(Sets(texts), part)))
            yield A.table(c=kept.column(0), text=kept.column(3))

    texts = stored(joined_small(docs, ids, ["id"], "inner").select("c", "c1", "c2", "text").mapInArrow(own, "c long, text string").dropDuplicates(["c"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def shingles(c: int, text: str) -> np.ndarray:
            if c not in held:
                if sum(map(len, held.values())) > 1 << 22:
                    held.clear()
                held[c] = Sets([text.encode()]).shingles
            return held[c]

        for batch in batches:
            out = []
            for a, b, ta, tb in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                x, y = shingles(a, ta), shingles(b, tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append((a, b))
            yield A.table(a=pa.array([x for x, _ in out], pa.int64()), b=pa.array([x for _, x in out], pa.int64()))

    side = lambda x: texts.select(F.col("c").alias(x), F.col("text").alias(f"t{x}"))
    return stored(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"))


def _blocks_within(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a key and whose sketches are near, compared in blocks of at most two chunks.

    members: key, size (of the key's list), c, label, n, sketch.
    """
    chunks = F.ceil(F.col("size") / F.lit(CHUNK)).cast("int")
    mine = F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int")
    dealt = (
        members.withColumn("chunks", chunks)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "c", "label", "n", "sketch")
    )

    def compare(rows: list[tuple]) -> set[tuple[int, int]]:
        i, j = rows[0][1], rows[0][2]
        c, label, n = (np.array([r[k] for r in rows], np.int64) for k in (4, 5, 6))
        mine = np.array([r[3] for r in rows])
        width = min(len(r[7]) for r in rows) // 8
        sketch = np.stack([_fold(np.frombuffer(r[7], np.uint64), width) for r in rows])
        out = set()
        for k in np.flatnonzero(mine == i):
            if i == j:
                to = np.arange(k + 1, len(rows))
            else:
                to = np.flatnonzero(mine == j)
            to = to[(label[to] != label[k]) & (percent * np.maximum(n[to], n[k]) <= 100 * np.minimum(n[to], n[k]))]
            if len(to):
                apart = np.bitwise_count(sketch[to] ^ sketch[k]).sum(axis=1)
                for m in to[apart <= difference(n[to], n[k], percent)]:
                    if _near(int(n[k]), rows[k][7], int(n[m]), rows[m][7], percent):
                        out.add((int(min(c[k], c[m])), int(max(c[k], c[m]))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        found: set[tuple[int, int]] = set()
        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and held[0][:3] != row[:3]:
                    found |= compare(held)
                    held = []
                held.append(row)
            yield A.table(a=pa.array([x for x, _ in found], pa.int64()), b=pa.array([x for _, x in found], pa.int64()))
            found = set()
        if held:
            found = compare(held)
            yield A.table(a=pa.array([x for x, _ in found], pa.int64()), b=pa.array([x for _, x in found], pa.int64()))

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "c").mapInArrow(run, "a long, b long").distinct()


def _link_counts(named: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(c, n_links): for classes with links, to how many other classes. named: c, least, label (similar classes have one label)."""
    sized = named.join(classes.select("c", "c1", "c2", "n"), "c")
    chunks = F.greatest(F.ceil(F.count("*") / F.lit(LINK_SETS)), F.ceil(F.sum("n") / F.lit(LINK_SHINGLES))).cast("int").alias("chunks")
    several = sized.groupBy("label").agg(F.count("*").alias("m"), chunks).where("m > 1").drop("m")
    ids = stored(sized.join(several, "label").select(F.col("least").alias("id"), "c", "c1", "c2", "label", "chunks"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in A.blocks(batches, "text"):
            sets = Sets(texts)
            keep = np.flatnonzero(_of_class(sets, part))
            held = pa.array([A.signed(sets.shingles[sets.first[k] : sets.first[k + 1]]) for k in keep.tolist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(keep)) for k in (0, 3, 4)), held], names=["c", "label", "chunks", "shingles"])

    sets = joined_small(docs, ids, ["id"], "inner").select("c", "c1", "c2", "label", "chunks", "text").mapInArrow(own, "c long, label long, chunks int, shingles array<long>")
    dealt = (
        stored(sets.dropDuplicates(["c"]))
        .withColumn("mine", F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("label", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "c", "shingles")
    )

    def compare(rows: list[tuple]) -> pa.RecordBatch:
        rows = sorted(rows, key=lambda r: len(r[5]))
        apart, mine = rows[0][1] != rows[0][2], np.array([r[3] for r in rows])
        size = np.array([len(r[5]) for r in rows])
        first = np.concatenate([[0], np.cumsum(size)])
        known, dense = np.unique(np.concatenate([r[5] for r in rows]), return_inverse=True)
        mark, n_links = np.zeros(len(known), bool), np.zeros(len(rows), np.int64)
        for k in range(len(rows) - 1):
            hi = int(np.searchsorted(size, size[k] * 100 // percent, side="right"))
            if hi <= k + 1:
                continue
            own = dense[first[k] : first[k + 1]]
            mark[own] = True
            both = np.add.reduceat(mark[dense[first[k + 1] : first[hi]]], first[k + 1 : hi] - first[k + 1], dtype=np.int64)
            mark[own] = False
            near = 100 * both >= percent * (size[k] + size[k + 1 : hi] - both)
            if apart:
                near &= mine[k + 1 : hi] != mine[k]
            n_links[k] += near.sum()
            n_links[k + 1 : hi] += near
        some = np.flatnonzero(n_links)
        return A.table(c=np.array([r[4] for r in rows], np.int64)[some], n_links=n_links[some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            plain, shingles = [x.to_pylist() for x in batch.columns[:5]], batch.column(5)
            for k, row in enumerate(zip(*plain, strict=True)):
                if held and held[0][:3] != row[:3]:
                    yield compare(held)
                    held = []
                held.append((*row, np.array(shingles[k].values.to_numpy())))
        if held:
            yield compare(held)

    counts = dealt.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(run, "c long, n_links long")
    return counts.groupBy("c").agg(F.sum("n_links").alias("n_links"))


def linked(docs: DataFrame, text: str = "text", id_: str = "doc_id", percent: int = PERCENT, count_links: bool = False) -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs; with count_links also n_links, the number of other shingle sets that are similar to the row's."""
    docs = docs.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("text"))
    sketched = _sketched(docs, percent)
    real = sketched.where("id is not null and n > 0")
    classes = stored(real.groupBy("c").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("c1").alias("c1"), F.first("c2").alias("c2")))
    keys = real.where(F.size("keys") > 0).select(F.explode("keys").alias("key"), "c")
    whole = Window.partitionBy("key")
    members = stored(keys.withColumns({"lo": F.min("c").over(whole), "hi": F.max("c").over(whole)}).where("lo < hi").select("key", "c").distinct())
    weight = members.groupBy("c").count().withColumnRenamed("count", "weight")
    members = stored(members.join(weight, "c"))
    links, tested, labels = None, None, None
    for step in range(HUB_ROUNDS):
        now = members if labels is None else members.join(labels, members.c == labels.node, "left").select("key", "c", "weight", F.coalesce("label", "c").alias("label"))
        now = now if labels is not None else now.withColumn("label", F.col("c"))
        rank = F.struct("weight", "c", "label") if step == 0 else F.struct(F.xxhash64("c", F.lit(step)), "c", "label")
        hubs = now.groupBy("key").agg(F.max(rank).alias("hub")).select("key", F.col("hub.c").alias("hub"), F.col("hub.label").alias("hub_label"))
        pairs = now.join(hubs, "key").where("label != hub_label").select(F.least("c", "hub").alias("a"), F.greatest("c", "hub").alias("b")).distinct()
        pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs)
        tested = pairs if tested is None else stored(tested.unionAll(pairs))
        found = _verified(_filtered(pairs, classes, percent), classes, docs, percent)
        links = found if links is None else links.unionAll(found)
        labels = components(links)
    now = members.join(labels, members.c == labels.node, "left").select("key", "c", F.coalesce("label", "c").alias("label"))
    mixed = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("key", "size")
    now = stored(now.join(mixed, "key").join(classes.select("c", "n", "sketch"), "c"))
    pairs = stored(_blocks_within(now, percent).join(tested, ["a", "b"], "left_anti"))
    links = links.unionAll(_verified(pairs, classes, docs, percent))
    # Rows that share an id are one document.
    of_id = real.groupBy("id").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a < b").drop("b")
    labels = components(links.unionAll(real.join(of_id, "id").select("a", F.col("c").alias("b"))))
    named = classes.join(labels, classes.c == labels.node, "left").select("c", "least", F.coalesce("label", "c").alias("label"))
    named = stored(named) if count_links else named
    component = named.join(named.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("c", "component_id")
    rows = sketched.select("id", "n", F.when(F.col("n") > 0, F.col("c")).alias("c"))
    more = []
    if count_links:
        component = component.join(_link_counts(named, classes, docs, percent), "c", "left")
        more = [F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0).cast("long"))).alias("n_links")]
    return rows.join(component, "c", "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"), *more)


@any_columns("text", "id_")
def deduplicated(docs: DataFrame, text: str = "text", id_: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """docs without those that are linked, directly or not, to one with a smaller id; of rows that share an id the one with the least text stays."""
    gone = stored(linked(docs, text, id_, percent).where("component_id != id").select(F.col("id").alias("_nd_id")).distinct())
    rest = joined_small(docs.withColumn("_nd_id", F.col(id_).cast("long")), gone, ["_nd_id"], "left_anti")
    twice = stored(rest.where("_nd_id is not null").groupBy("_nd_id").count().where("count > 1").select("_nd_id"))
    if twice.limit(1).count():
        once = joined_small(rest, twice, ["_nd_id"], "left_anti")
        several = joined_small(rest, twice, ["_nd_id"], "inner")
        of = F.min_by(F.struct(*docs.columns), F.struct(F.col(text), F.xxhash64(*docs.columns))).alias("row")
        rest = once.select(*docs.columns).unionByName(several.groupBy("_nd_id").agg(of).select("row.*"))
    return rest.select(*docs.columns)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(documents(spark, sf_dir), count_links=True).withColumnRenamed("id", "doc_id")
