"""N-gram Jaccard join: a size-aware heavy-light join of word shingle sets, and its linked groups.

Two sets of sizes a and b link when their overlap is at least ``c = ceil(t / (1 + t) * (a + b))``. Equal sets
are one class from the start, so copies are never compared. Classes are then treated by size, with a boundary
``x`` chosen from the histogram of sizes so that the cost of both parts together is least:

* light, both sets up to ``x``: all subsets of the fixed size c are enumerated, for each c that a partner's
  size can ask for; sets that link share such a subset, so the subset's hash is a join key;
* heavy, the larger set above ``x``: inverted lists. A list of a single shingle may be as long as the corpus,
  so the key of a list is the content of a block of shingles: a set's shingles are dealt by hash into
  ``d + 1`` blocks and some to spare, where d is the largest difference that two linked sets of this band of sizes can
  have. Each differing shingle spoils one block at most, so linked sets have one more in common than there are to
  spare; sets with more empty blocks than that list the empty ones too. Bands are as wide as the threshold, so
  partners are in the same band or the next, and sets are listed in both.

Lists and subsets with a single class are dropped. Of the others a set leaves its longest ones, as many as it
has common blocks to spare (less its empty ones). All sets order lists alike, by length and key, so
the shortest list that two linked sets have in common is among the longest of neither: the pair is kept, and
the lists that a frequent shingle makes long lose most of their classes.

In each list the class that shares most lists is the hub, and all classes that have a list in common with a
hub are its members. Members are first compared with their hub: one row each, so a group of near copies of one
text costs a comparison each. Where members are still not connected, directly or not, they are compared with
each other: members are dealt into blocks of at most ``BLOCK``, a task gets two blocks, counts overlaps in
matrices of bounded size, and returns a forest of the links it has found, so pairs are never rows. Both
comparisons first count the lists in common, of which linked sets have as many as their sizes leave unspoiled;
only sets that pass with some partner are made from their texts again and compared by shingles. Overlaps are
exact and no link between different texts is lost. Groups, links and labels are stored tables; none is
collected.

Lists are written once, with the sets, and matched in ``RANGES`` ranges of their keys in turn, so that the
shuffle files of one range are there at a time. A class has a key of 64 bits; where two sets have one key, they
are told apart by 64 further bits.

Texts without words and null texts have the empty set, link with nothing and are components of their own.
Rows that repeat a ``doc_id`` get a row each, with the component of their own text.
Empty input gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_stored, released, sliced, stored, texts

#: Sizes whose shingles are kept for the light part; the boundary is at most this.
LIGHT = 40
#: Blocks beyond the pigeonhole's, so that empty ones and the longest lists can be left out.
SPARE = 4
#: Ranges of list keys, matched one after the other.
RANGES = 4
#: Members of a block; a task compares two blocks at a time.
BLOCK = 500
#: What a list entry costs against a subset: it also brings comparisons that may fail.
LIST_COST = 2.0

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9))


@dataclass(frozen=True)
class Rule:
    gram: int = 3
    num: int = 90  # link when den * intersection >= num * union
    den: int = 100
    bits: int = 64  # of a class's key

    def overlap(self, a: int, b: int) -> int:
        return -(-self.num * (a + b) // (self.num + self.den))

    def largest(self, n: int) -> int:
        """The size of the largest partner."""
        return self.den * n // self.num

    def smallest(self, n: int) -> int:
        return -(-self.num * n // self.den)


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _D
        h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""

    def __init__(self, gram: int, most: int = 500_000):
        self.gram, self.most, self.table = gram, most, {}

    def __call__(self, raw: bytes) -> np.ndarray:
        import xxhash

        own = raw.lower().split()  # of ASCII letters and white space only
        if len(self.table) > self.most:
            self.table = {}
        table = self.table
        for w in set(own):
            if w not in table:
                table[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array([table[w] for w in own], np.uint64)
        if not len(h):
            return h
        n = min(self.gram, len(h))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - n + 1, n, np.uint64)
            for k in range(n):
                out = mix(out * _A + h[k : len(h) - n + 1 + k] + _B)
        return np.unique(out)


def class_key(shingles: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """The key of a set, and 64 further bits that tell apart sets of one key."""
    import xxhash

    both = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return both >> 64 >> (64 - bits), (both & (1 << 64) - 1) - (1 << 63)


def bands(rule: Rule, upto: int) -> list[int]:
    """First sizes of the bands; partners of a size in one band are in it or in a neighbour."""
    out = [1]
    while out[-1] <= upto:
        out.append(rule.largest(out[-1]) + 1)
    return out


def differences(rule: Rule, last: int) -> int:
    """Most shingles that two linked sets of up to ``last`` ones do not share."""
    return 2 * last * (rule.den - rule.num) // (rule.den + rule.num)


def spare_blocks(rule: Rule, last: int) -> int:
    return SPARE + differences(rule, last) // 16


def n_blocks(rule: Rule, last: int) -> int:
    """Blocks for a band whose largest size is ``last``."""
    return differences(rule, last) + 1 + spare_blocks(rule, last)


def block_keys(shingles: np.ndarray, band: int, last: int, rule: Rule) -> tuple[np.ndarray, int]:
    """Keys of the lists that a set is in: its blocks' contents, in this band; and how many it may leave."""
    blocks, spare = n_blocks(rule, last), spare_blocks(rule, last)
    with np.errstate(over="ignore"):
        block = (mix(shingles + _B) % np.uint64(blocks)).astype(np.int64)
        total = np.zeros(blocks, np.uint64)
        np.add.at(total, block, mix(shingles ^ _C))
        held = np.bincount(block, minlength=blocks) > 0
        keys = mix(total + np.uint64(band) * _A + np.arange(blocks, dtype=np.uint64) * _B + np.uint64(1))
    empty = int((~held).sum())
    return (keys, 0) if empty > spare else (keys[held], spare - empty)


def subset_keys(shingles: np.ndarray, rule: Rule, x: int) -> np.ndarray:
    """Hashes of the subsets of a light set, of every size that a light partner can ask for."""
    n = len(shingles)
    sizes = {rule.overlap(n, b) for b in range(rule.smallest(n), min(x, rule.largest(n)) + 1)}
    with np.errstate(over="ignore"):
        each = mix(shingles ^ _D)
        total, out = each.sum(dtype=np.uint64), []
        for c in sorted(s for s in sizes if s <= n):
            left = [int(sum(each[list(i)].tolist())) % (1 << 64) for i in combinations(range(n), n - c)]
            out.append(mix(total - np.array(left, np.uint64) + np.uint64(c) * _C))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def boundary(sizes: dict[int, int], rule: Rule, light: int = LIGHT) -> int:
    """The x of least cost; ``sizes`` has the classes of each size up to ``light``."""

    def subsets(n: int, x: int) -> int:
        return sum(comb(n, c) for c in {rule.overlap(n, b) for b in range(rule.smallest(n), min(x, rule.largest(n)) + 1)} if c <= n)

    def lists(n: int) -> float:
        return LIST_COST * 2 * n_blocks(rule, rule.largest(n))

    def cost(x: int) -> float:
        mixed = sum(k * lists(n) for n, k in sizes.items() if n <= x < rule.largest(n))
        return sum(k * (subsets(n, x) if n <= x else lists(n)) for n, k in sizes.items()) + mixed

    return min(range(1, light + 1), key=lambda x: (cost(x), x))


def shingle_sets(docs: DataFrame, rule: Rule, *, remembered: int = 200_000) -> DataFrame:
    """doc_id, n, key and check of the set; the list keys of its own band and of the next one, and how many of them it may leave; the shingles of a light set.

    ``unspoiled``: the lists of its own band that it shares with a linked set that is no larger, were no shingle different.
    Of the copies that a task meets only the first has lists and shingles; ``remembered`` bounds the task's memory.
    """

    def kernel(batches):
        import pyarrow as pa

        shingler, first, seen = Shingler(rule.gram), bands(rule, 1 << 24), set()
        kind = pa.list_(pa.int64())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), kind, pa.int32(), kind, pa.int32(), kind)
        for batch in sliced(batches):
            out: list[list] = [[] for _ in kinds]
            for raw in texts(batch):
                s = shingler(raw)
                n = len(s)
                key = check = unspoiled = own = own_spare = after = after_spare = light = None
                if n:
                    key, check = class_key(s, rule.bits)
                    key -= 1 << 63
                    if (key, check) not in seen:
                        if len(seen) >= remembered:
                            seen.clear()
                        seen.add((key, check))
                        band = int(np.searchsorted(first, n, "right")) - 1
                        own, own_spare = block_keys(s, band, first[band + 1] - 1, rule)
                        unspoiled = differences(rule, first[band + 1] - 1) + 1 + own_spare
                        if rule.largest(n) >= first[band + 1]:
                            after, after_spare = block_keys(s, band + 1, first[band + 2] - 1, rule)
                        light = s if n <= LIGHT else None
                row = (n, key, check, unspoiled, *[x if x is None or isinstance(x, int) else x.view(np.int64) for x in (own, own_spare, after, after_spare, light)])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n", "key", "check", "unspoiled", "own", "own_spare", "next", "next_spare", "light"])

    schema = "doc_id long, n long, key long, check long, unspoiled long, own array<long>, own_spare int, next array<long>, next_spare int, light array<long>"
    return docs.select("doc_id", "text").mapInArrow(kernel, schema)


def told_apart(sets: DataFrame) -> DataFrame:
    """``sets`` with another key for those that share theirs with a different set."""
    twice = sets.filter("n > 0").groupBy("key").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo <> hi").select(F.col("key").alias("t_key"))
    twice = stored(twice, "join-twice", narrow=True)
    if not twice.limit(1).count():
        drop_stored(twice)
        return sets
    new = F.when(F.col("t_key").isNotNull(), F.xxhash64("key", "check")).otherwise(F.col("key"))
    return sets.join(twice, F.col("key") == F.col("t_key"), "left").select(*[new.alias(c) if c == "key" else c for c in sets.columns])


def shared_lists(sets: DataFrame, rule: Rule, x: int, ranges: int = RANGES) -> tuple[DataFrame, DataFrame]:
    """(sig, key) of the lists and subsets with several classes, without those that a set can leave; and (key, sigs) with them."""
    first = bands(rule, x + 2)
    # a band's lists serve the pairs whose larger set is in it and above the boundary
    heavy = next(b for b in range(len(first) - 1) if first[b + 1] - 1 > x) if x else 0
    n = F.col("n")

    def enumerate_subsets(batches):
        import pyarrow as pa

        for batch in batches:
            keys, sigs = [], []
            for key, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = subset_keys(np.array(shingles, np.int64).view(np.uint64), rule, x).view(np.int64)
                keys += [key] * len(own)
                sigs.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64)), pa.array(keys, pa.int64())], ["sig", "key"])

    def listed(name: str, least: int, part: int) -> DataFrame:
        return sets.filter((n >= least) & F.col(name).isNotNull()).select(F.explode(name).alias("sig"), "key", F.lit(part).alias("part"), F.col(f"{name}_spare").alias("spare"))

    entries = listed("own", first[heavy], 0).union(listed("next", first[heavy - 1] if heavy else 1, 1))
    small = sets.filter((n <= x) & F.col("light").isNotNull()).select("key", "light").distinct()
    light = stored(small.mapInArrow(enumerate_subsets, "sig long, key long"), "join-subsets").select("sig", "key", F.lit(2).alias("part"), F.lit(0).alias("spare"))
    found = []
    for r in range(ranges):
        own = entries.union(light).filter(F.pmod("sig", F.lit(ranges)) == r)
        several = own.groupBy("sig").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo <> hi").select(F.col("sig").alias("s_sig"))
        found.append(stored(own.join(several, F.col("sig") == F.col("s_sig"), "left_semi").distinct(), "join-shared"))
        released(sets.sparkSession)
    drop_stored(light)
    groups = found[0]
    for g in found[1:]:
        groups = groups.union(g)
    length = groups.groupBy(F.col("sig").alias("l_sig")).agg(F.count("*").alias("length"))
    longest = W.partitionBy("key", "part").orderBy(F.col("length").desc(), F.col("sig").desc())
    left = groups.join(length, F.col("sig") == F.col("l_sig")).withColumn("place", F.row_number().over(longest)).filter("place > spare")
    left = stored(left.select("sig", "key"), "join-groups")
    every = stored(groups.groupBy("key").agg(F.collect_set("sig").alias("sigs")), "join-lists")  # a set's own lists at most
    for g in found:
        drop_stored(g)
    released(sets.sparkSession)
    return left, every


def needed(rule: Rule, x: int, a, b, of_larger, largest, ceil, where):
    """Lists that linked sets of sizes a and b have in common at least; for columns and arrays alike."""
    d = a + b - 2 * ceil(rule.num * (a + b) / (rule.num + rule.den))
    return where(largest(a, b) <= x, 1, largest(of_larger - d, 1))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (a, b) is connected with.

    Minima pass along the edges; from the third round on labels also jump to their own labels, so that the
    rounds grow with the logarithm of a component's diameter. Every round is a stored table.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "join-edges", narrow=True)
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label"))
    labels, rounds = stored(labels, "join-labels", narrow=True), 0
    while True:
        rounds += 1
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        old = [labels]
        if rounds > 2:
            step = stored(step, "join-step", narrow=True)
            old.append(step)
            far = step.select(F.col("node").alias("j"), F.col("label").alias("far"))
            step = step.join(far, F.col("label") == F.col("j")).select("node", "was", F.least("label", "far").alias("label"))
        step = stored(step, "join-labels", narrow=True)
        for x in old:
            drop_stored(x)
        labels = step.select("node", "label")
        if not step.filter("label <> was").limit(1).count():
            drop_stored(both)
            return labels


def sets_of(docs: DataFrame, wanted: DataFrame, rule: Rule, repeated: bool) -> DataFrame:
    """(key, shingles) of the classes in ``wanted`` (key, check, doc_id of one document).

    ``repeated``: whether a doc_id can have several rows.
    """
    wanted = stored(wanted.select(F.col("doc_id").alias("w_doc"), F.col("key").alias("w_key"), F.col("check").alias("w_check")), "join-wanted", narrow=True)
    # ids of several classes, or none, do not lead to a text; there the set itself does
    unclear = wanted.groupBy(F.col("w_doc").alias("u_doc")).count().filter("count > 1 or u_doc is null").select("u_doc")
    several = unclear.limit(1).count() > 0
    plain = wanted.join(unclear, F.col("w_doc").eqNullSafe(F.col("u_doc")), "left_anti") if several else wanted

    def kernel(batches):
        import pyarrow as pa

        shingler = Shingler(rule.gram)
        for batch in sliced(batches):
            own = [shingler(raw) for raw in texts(batch)]
            checks = [class_key(s, rule.bits)[1] for s in own]
            arrays = [pa.array(checks, pa.int64()), pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*arrays, *batch.columns[1:]], ["check", "shingles", *batch.schema.names[1:]])

    # by sorting at every size, as the table of wanted classes grows with the documents
    chosen = docs.select("doc_id", "text").join(plain.hint("merge"), F.col("doc_id") == F.col("w_doc")).select("text", "w_key", "w_check")
    sets = chosen.mapInArrow(kernel, "check long, shingles array<long>, w_key long, w_check long").filter("check = w_check")
    sets = sets.select(F.col("w_key").alias("key"), "shingles")
    if several:
        rows = docs.select("doc_id", "text").join(unclear, F.col("doc_id").eqNullSafe(F.col("u_doc")), "left_semi").select("text")
        by_set = rows.mapInArrow(kernel, "check long, shingles array<long>").dropDuplicates(["check"]).join(wanted, F.col("check") == F.col("w_check"))
        sets = sets.union(by_set.select(F.col("w_key").alias("key"), "shingles"))
    if several or repeated:
        sets = sets.dropDuplicates(["key"])
    sets = stored(sets, "join-sets")
    drop_stored(wanted)
    released(docs.sparkSession)
    return sets


def in_blocks(members: DataFrame, block: int) -> DataFrame:
    """``members`` (hub, key, label) of hubs with several labels, dealt to pairs (i, j) of blocks."""
    per = members.groupBy("hub").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m")).filter("lo <> hi")
    per = per.select(F.col("hub").alias("o_hub"), F.ceil(F.col("m") / F.lit(block)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    dealt = members.join(per, F.col("hub") == F.col("o_hub")).withColumn("mine", mine).withColumn("yours", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("hub", F.least("mine", "yours").alias("i"), F.greatest("mine", "yours").alias("j"), "mine", "key", "label")


def link_classes(docs: DataFrame, classes: DataFrame, groups: DataFrame, lists: DataFrame, rule: Rule, x: int, repeated: bool = True, block: int = BLOCK) -> DataFrame:
    """(key, label) of the classes that link with another one.

    classes: key, check, doc_id of one document, n, unspoiled; groups: (sig, key); lists: (key, sigs).
    """
    spark = docs.sparkSession
    degree = groups.groupBy("key").agg(F.count("*").alias("degree"))
    hub = F.max_by("key", F.struct("degree", "key"))
    hubs = groups.join(degree, "key").groupBy("sig").agg(hub.alias("hub")).select(F.col("sig").alias("h_sig"), "hub")
    pairs = stored(groups.join(hubs, (F.col("sig") == F.col("h_sig")) & (F.col("hub") != F.col("key"))).select("hub", "key").distinct(), "join-pairs", narrow=True)
    lists = stored(lists.join(classes.select("key", "n", "unspoiled"), "key"), "join-known")
    # members that share enough lists with their hub
    of_hub = lists.select(F.col("key").alias("k_hub"), F.col("n").alias("n_hub"), F.col("unspoiled").alias("u_hub"), F.col("sigs").alias("s_hub"))
    a, b = F.col("n"), F.col("n_hub")
    least = needed(rule, x, a, b, F.when(a >= b, F.col("unspoiled")).otherwise(F.col("u_hub")), lambda p, q: F.greatest(p, F.lit(q) if isinstance(q, int) else q), F.ceil, lambda c, p, q: F.when(c, F.lit(p)).otherwise(q))
    fits = (rule.den * F.least(a, b) >= rule.num * F.greatest(a, b)) & (F.size(F.array_intersect("sigs", "s_hub")) >= least)
    close = stored(pairs.join(lists, "key").join(of_hub, F.col("hub") == F.col("k_hub")).filter(fits).select("hub", "key"), "join-close", narrow=True)
    released(spark)
    there = stored(close.select("key").union(close.select("hub")).distinct(), "join-there", narrow=True)
    sets = sets_of(docs, there.join(classes, "key"), rule, repeated)
    of_hub = sets.select(F.col("key").alias("k_hub"), F.col("shingles").alias("s_hub"))
    own, other = F.size("shingles"), F.size("s_hub")
    shared = F.size(F.array_intersect("shingles", "s_hub"))
    near = close.join(sets, "key").join(of_hub, F.col("hub") == F.col("k_hub")).filter(rule.den * shared >= rule.num * (own + other - shared))
    links = stored(near.select(F.col("hub").alias("a"), F.col("key").alias("b")), "join-links")
    released(spark)
    labels = stored(components(links).select(F.col("node").alias("key"), "label"), "join-labels", narrow=True)
    # members of hubs that are not all connected yet, in blocks: first by their lists
    members = pairs.union(pairs.select("hub", F.col("hub").alias("key")).distinct())
    marked = members.join(labels, "key", "left").select("hub", "key", F.coalesce("label", "key").alias("label"))
    crowded = marked.groupBy("hub").count().filter("count > 2").select(F.col("hub").alias("c_hub"))
    marked = stored(marked.join(crowded, F.col("hub") == F.col("c_hub")).select("hub", "key", "label"), "join-marked", narrow=True)
    rows = in_blocks(marked, block).join(lists, "key").select("hub", "i", "j", "mine", "key", "label", "n", "unspoiled", "sigs")

    def partners(batches):
        import pyarrow as pa

        found = [(g.hub, k) for g in runs(batches) for k in g.with_partners(rule, x)]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["p_hub", "p_key"])

    by = ("hub", "i", "j")
    some = rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(partners, "p_hub long, p_key long").distinct()
    some = stored(marked.join(some, (F.col("hub") == F.col("p_hub")) & (F.col("key") == F.col("p_key"))).select("hub", "key", "label"), "join-open")
    drop_stored(marked)
    released(spark)
    if not some.limit(1).count():
        return labels
    more = some.select("key").distinct().join(there, "key", "left_anti")
    sets = sets.union(sets_of(docs, more.join(classes, "key"), rule, repeated))
    rows = in_blocks(some, block).join(sets, "key").select("hub", "i", "j", "mine", "key", "label", F.size("shingles").cast("long").alias("n"), F.lit(0).cast("long").alias("unspoiled"), "shingles")

    def compare(batches):
        import pyarrow as pa

        found = [link for g in runs(batches) for link in g.forest(rule)]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    more = stored(rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, "a long, b long").distinct(), "join-links")
    drop_stored(sets)
    released(spark)
    if not more.limit(1).count():
        return labels
    return components(links.union(more)).select(F.col("node").alias("key"), "label")


def runs(batches):
    """The :class:`Pairing` of each (hub, i, j), from rows in this order."""
    at, group = None, []
    for batch in batches:
        hub, i, j, mine, key, label, n, unspoiled = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(8))
        lists = batch.column(8)
        values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        for r in range(batch.num_rows):
            if (now := (hub[r], i[r], j[r])) != at:
                if group:
                    yield Pairing(int(at[0]), bool(at[1] == at[2]), group)
                at, group = now, []
            group.append((int(key[r]), int(label[r]), int(mine[r]), int(n[r]), int(unspoiled[r]), values[offsets[r] : offsets[r + 1]].copy()))
    if group:
        yield Pairing(int(at[0]), bool(at[1] == at[2]), group)


class Pairing:
    """A block of a hub's members with itself (``within``), or two blocks with each other."""

    def __init__(self, hub: int, within: bool, group: list[tuple]):
        self.hub, self.within = hub, within
        self.keys, self.labels, side, sizes, unspoiled = (list(c) for c in zip(*[x[:5] for x in group], strict=True))
        self.side, self.sizes, self.unspoiled = np.array(side), np.array(sizes), np.array(unspoiled)
        self.lists = [x[5] for x in group]

    def shared(self, width: int = 4096) -> np.ndarray:
        """Elements that each two of the lists have in common."""
        m = len(self.lists)
        owner = np.repeat(np.arange(m), [len(x) for x in self.lists])
        _, column, count = np.unique(np.concatenate(self.lists), return_inverse=True, return_counts=True)
        often = count > 1
        keep = often[column]
        column, owner = (np.cumsum(often) - 1)[column][keep], owner[keep]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        out = np.zeros((m, m), np.float32)
        for at in range(0, int(often.sum()), width):
            lo, hi = np.searchsorted(column, (at, at + width))
            part = np.zeros((m, width), np.float32)
            part[owner[lo:hi], column[lo:hi] - at] = 1
            out += part @ part.T
        return out.astype(np.int64)  # whole numbers below 2 ** 24

    def across(self) -> np.ndarray:
        """The pairs that this pairing is for: no label in common, and of different blocks if there are two."""
        label = np.unique(self.labels, return_inverse=True)[1]
        pairs = label[:, None] != label[None, :]
        return pairs if self.within else pairs & (self.side[:, None] != self.side[None, :])

    def with_partners(self, rule: Rule, x: int) -> list[int]:
        """Keys of the members that share as many lists with another as linked ones do."""
        pairs = self.across()
        if not pairs.any():
            return []
        a, b = self.sizes[:, None], self.sizes[None, :]
        of_larger = np.where(a >= b, self.unspoiled[:, None], self.unspoiled[None, :])
        least = needed(rule, x, a, b, of_larger, np.maximum, np.ceil, np.where)
        pairs &= (rule.den * np.minimum(a, b) >= rule.num * np.maximum(a, b)) & (self.shared() >= least)
        return [self.keys[k] for k in np.nonzero((pairs | pairs.T).any(axis=1))[0]]

    def forest(self, rule: Rule) -> list[tuple[int, int]]:
        """Links that connect what is not connected yet."""
        pairs = self.across()
        if not pairs.any():
            return []
        shared = self.shared()
        linked = np.triu(pairs & (rule.den * shared >= rule.num * (self.sizes[:, None] + self.sizes[None, :] - shared)), 1)
        root = {x: x for x in self.labels}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for x, y in zip(*np.nonzero(linked), strict=True):
            a, b = find(self.labels[x]), find(self.labels[y])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((self.keys[x], self.keys[y]))
        return out


def jaccard_components(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id, class_key and class_check (equal for equal sets) and component_key (of linked classes) of every document."""
    spark = docs.sparkSession
    signatures = stored(shingle_sets(docs, rule), "join-signatures")
    sets = told_apart(signatures)
    members = stored(sets.select("doc_id", "n", "key", "check", "unspoiled"), "join-members", narrow=True)
    classes = members.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("check").alias("check"), F.max("unspoiled").alias("unspoiled"))
    narrow = stored(classes, "join-narrow", narrow=True)
    histogram = narrow.filter(F.col("n") <= LIGHT).groupBy("n").agg(F.count("*").alias("k")).collect()  # LIGHT rows at most
    x = boundary({r["n"]: r["k"] for r in histogram}, rule)
    groups, lists = shared_lists(sets, rule, x)
    drop_stored(signatures)
    del sets, signatures, classes
    released(spark)
    repeated = members.filter("n > 0").groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    labels = link_classes(docs, narrow, groups, lists, rule, x, repeated)
    # the smallest document of each class, then of each component
    of_class = narrow.join(labels, "key", "left").select("key", "doc_id", F.coalesce("label", "key").alias("label"))
    ids = of_class.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    final = of_class.join(ids, "label").select(F.col("key").alias("c_key"), "component_id", F.col("label").alias("component_key"))
    return members.join(final, F.col("key") == F.col("c_key"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("key").alias("class_key"), F.col("check").alias("class_check"), "component_key")


def one_of_each(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row of each component of ``docs``: of its smallest ``doc_id``, and there of the smallest set.

    Rows without shingles all stay. Rows that repeat a ``doc_id``, or have none, are told apart by their sets.
    """
    linked = stored(jaccard_components(docs, rule).select("doc_id", "class_check", "component_key"), "join-linked", narrow=True)
    released(docs.sparkSession)
    first = linked.filter("class_check is not null").groupBy("component_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class_check")).alias("f"))
    first = stored(first.select(F.col("component_key").alias("__of"), F.col("f.doc_id").alias("__first"), F.col("f.class_check").alias("__check")), "join-first", narrow=True)
    other = ~(F.col("doc_id").eqNullSafe(F.col("__first")) & (F.col("class_check") == F.col("__check")))
    gone = stored(linked.join(first, F.col("component_key") == F.col("__of")).filter(other).select(F.col("doc_id").alias("__gone")).distinct(), "join-gone", narrow=True)
    again = stored(linked.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select(F.col("doc_id").alias("__again")), "join-again", narrow=True)
    if not again.limit(1).count():
        return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    same = F.col("doc_id").eqNullSafe(F.col("__again"))
    rows = stored(docs.join(again, same, "left_semi").withColumn("__row", F.monotonically_increasing_id()), "join-repeated")
    sets = stored(shingle_sets(rows.select(F.col("__row").alias("doc_id"), "text"), rule).select(F.col("doc_id").alias("__row"), F.col("check").alias("__set")), "join-repeated-sets")
    own = rows.select("__row", "doc_id").join(sets, "__row").join(first, F.col("__set") == F.col("__check")).filter(F.col("doc_id").eqNullSafe(F.col("__first")))
    stay = own.groupBy("__check").agg(F.min("__row").alias("__stay")).select("__stay").union(sets.filter("__set is null").select("__row"))
    once = docs.join(again, same, "left_anti").join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    return once.unionByName(rows.join(stay, F.col("__row") == F.col("__stay"), "left_semi").drop("__row"))
