"""Suffix-array deduplication: bytes covered by a string of ``size`` bytes that occurs elsewhere too.

Finding every repeat with one suffix array over the corpus does not scale, so the array is cut into shards
that are complete by construction:

1. Anchors. In every ``size``-byte string the leftmost ``gram``-byte string of smallest hash is its anchor.
   Equal strings have equal anchors at equal places, so two occurrences can only match if their anchors
   do. All strings with one anchor start in one range of positions; the bytes they cover, the anchor's
   context, are what has to be compared. An anchor is chosen about once in ``size / 2`` bytes.
2. Counts by (anchor, context) and by anchor. A context that occurs twice repeats as a whole. An anchor
   with a single context has nothing else to match. So frequent copies are counted, and never compared.
3. Where an anchor has several contexts, one text of each goes to the anchor's task. The suffixes that start
   at the anchor are sorted there, forwards and backwards, and the common prefixes of neighbours tell how far
   any string that repeats can reach; contexts are cut to that, and counted again as in 2. Those that still
   differ go to a shard of bounded bytes. It has a suffix array, refined from 8 bytes on by doubling as
   Larsson and Sadakane do (only groups that are still unsorted are sorted again), common prefixes by Kasai's
   algorithm, run in step over all contexts, and the strings with a common prefix of ``size`` bytes with a
   neighbour repeat.
4. An anchor whose contexts fill several shards has its shards merged by binary search: the suffixes of a
   new shard are looked up in the arrays of the earlier ones.
5. An anchor with more than ``most`` bytes of contexts is not left to one task. Equal strings have the anchor
   at one place, so its contexts are cut by ranges of that place, and the bytes that all strings of a range
   cover are the new key: a quarter of the range at a time, down to single strings, whose counts decide.

Spans of a document are then united and removed. Matches never cross documents, as contexts do not.

Null and empty texts, and those shorter than ``size``, have nothing removed. Rows that repeat a ``doc_id``
are documents of their own, told apart by the text's digest; if that repeats too, they are equal and get
equal results. Empty tables give no rows. Only ``doc_id`` and ``text`` are read, so further columns may have
any name.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import groupby, pairwise
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, released, sliced, stored, texts


@dataclass(frozen=True)
class Cut:
    size: int = 400  # bytes that have to repeat
    gram: int = 32  # bytes of an anchor
    shard: int = 1 << 20  # bytes of a suffix array
    most: int = 1 << 22  # bytes of an anchor's contexts that a task compares


MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(a: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each position on, by doubling."""
    with np.errstate(over="ignore"):
        part, length = a.astype(np.uint64) + np.uint64(1), 1
        out, done = None, 0
        power = int(MIX)
        while True:
            if gram & length:
                if out is None:
                    out, done = part, length
                else:
                    n = min(len(out), len(part) - done)
                    out = out[:n] * np.uint64(pow(int(MIX), length, 1 << 64)) + part[done : done + n]
                    done += length
            if 2 * length > gram:
                break
            n = len(part) - length
            part = part[:n] * np.uint64(power) + part[length : length + n]
            power = power * power % (1 << 64)
            length *= 2
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def anchors(a: np.ndarray, cut: Cut) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the anchors, the first and last start of the strings that have them, and their places."""
    none = np.zeros(0, np.int64)
    if len(a) < cut.size:
        return none.astype(np.uint64), none, none, none
    h = gram_hashes(a, cut.gram)
    window = cut.size - cut.gram + 1
    low = np.uint64((1 << 20) - 1)
    out_key, out_from, out_to, out_place = [], [], [], []
    step = 1 << 19
    for at in range(0, len(h) - window + 1, step):  # so that a position fits beside the hash
        part = h[at : at + step + window - 1]
        # the leftmost of the smallest: high bits of the hash, then the position
        m = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= window:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < window:
            m = np.minimum(m[: len(m) - (window - width)], m[window - width :])
        place = (m & low).astype(np.int64)
        new = np.concatenate([[True], place[1:] != place[:-1]])
        first = np.nonzero(new)[0]
        out_key.append(part[place[first]])
        out_from.append(first + at)
        out_place.append(place[first] + at)
        out_to.append(np.concatenate([first[1:] - 1, [len(place) - 1]]) + at)
    return tuple(np.concatenate(x) for x in (out_key, out_from, out_to, out_place))


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions in the order of their suffixes' first ``depth`` bytes at least; ranks before the last round.

    The ranks are equal where suffixes share that many bytes (the last item), which is half of ``depth`` or
    more. Suffixes of fewer than 8 zero bytes may tie.

    Larsson-Sadakane refinement: suffixes are in groups of equal prefixes, a group's rank is the place of
    its last member, and a round doubles the prefix by sorting each open group by the ranks that follow.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + n]
    order = np.argsort(key)  # a suffix that ends ties with one that goes on with zero bytes; what follows decides
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if n else np.zeros(0, bool)
    rank = np.zeros(n, np.int64)

    def number(places: np.ndarray, fresh: np.ndarray) -> None:
        """places: positions in the order that are open; fresh: which of them begin a group."""
        group = np.cumsum(fresh) - 1
        last = np.concatenate([np.nonzero(fresh)[0][1:] - 1, [len(places) - 1]])
        rank[order[places]] = places[last][group]

    if n:
        number(np.arange(n), new)
    h, before, known = 8, rank, 8
    open_ = np.arange(n)
    while h < depth and len(open_):
        before, known = rank.copy() if 2 * h >= depth else rank, h
        top = rank[order[open_]]
        size = np.bincount(top, minlength=n)[top]
        open_ = open_[size > 1]
        if not len(open_):
            break
        at = order[open_]
        group = rank[at]
        follow = np.where(at + h < n, rank[np.minimum(at + h, n - 1)], -1)
        both = group * (n + 1) + follow + 1
        by = np.argsort(both)
        order[open_] = at[by]
        both = both[by]
        number(open_, np.concatenate([[True], both[1:] != both[:-1]]))
        h *= 2
    return order, before, known


def common_prefixes(data: np.ndarray, order: np.ndarray, begins: np.ndarray, depth: int, rank: np.ndarray | None = None, known: int = 0) -> np.ndarray:
    """For each place in the order, the length of the prefix it shares with the place before, up to ``depth``.

    With ``rank``, neighbours of equal rank share ``known`` bytes at least, and for others 0 is returned.

    Kasai's algorithm: going from a suffix to the next one in the text, the shared length drops by one at
    most. All contexts (``begins``: their first positions) go along in step.
    """
    n = len(data)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    before = np.where(inverse > 0, order[np.maximum(inverse - 1, 0)], -1)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    if rank is not None:
        apart = np.ones(n, bool)
        apart[order[1:]] = rank[order[1:]] != rank[order[:-1]]
        before[apart] = -1
    out = np.zeros(n, np.int32)
    ends = np.concatenate([begins[1:], [n]])
    at, shared = begins.copy(), np.zeros(len(begins), np.int64)
    live = np.arange(len(begins))
    while len(live):
        i = at[live]
        j = before[i]
        have = np.where(j >= 0, shared[live], 0)
        room = np.minimum(depth, np.where(j >= 0, n - np.maximum(i, j), 0))
        have = np.minimum(np.maximum(have, known), room)
        todo = np.nonzero(have < room)[0]
        while len(todo):  # 8 bytes at a time
            x, y = i[todo] + have[todo], j[todo] + have[todo]
            same = np.cumprod(words[x] == words[y], axis=1).sum(axis=1)
            have[todo] += np.minimum(same, room[todo] - have[todo])
            todo = todo[(same == 8) & (have[todo] < room[todo])]
        out[inverse[i]] = have
        # suffixes alike up to the depth are in no true order, so nothing follows for the next ones
        shared[live] = np.where(have < depth, np.maximum(have - 1, 0), 0)
        at[live] += 1
        live = live[at[live] < ends[live]]
    return out


class Shard:
    """The suffix array of some contexts; ``starts`` are the positions whose strings count."""

    def __init__(self, contexts: list[bytes], cut: Cut):
        self.cut = cut
        self.data = np.frombuffer(b"".join(contexts), np.uint8)
        lengths = np.array([len(c) for c in contexts], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        counts = lengths - cut.size + 1
        self.owner = np.repeat(np.arange(len(contexts)), counts)
        self.starts = np.repeat(self.begins, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.order, rank, known = suffix_array(self.data, cut.size)
        valid = np.zeros(len(self.data), bool)
        valid[self.starts] = True
        self.lcp = common_prefixes(self.data, self.order, self.begins, cut.size, rank, known)
        # runs of places whose strings are equal; only strings that lie in one context count
        run = np.cumsum(self.lcp < cut.size)
        mine = valid[self.order]
        count = np.bincount(run[mine], minlength=run[-1] + 1 if len(run) else 0)
        self.repeated = np.zeros(len(self.data), bool)
        self.repeated[self.order[mine]] = count[run[mine]] > 1
        self.sorted = self.order[mine]

    def marked(self) -> np.ndarray:
        return self.repeated[self.starts]

    def strings(self, starts: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.data, self.cut.size)[starts]

    def bound(self, keys: np.ndarray, upper: bool) -> np.ndarray:
        """Binary search of strings (rows of bytes) in this array, all in step."""
        lo, hi = np.zeros(len(keys), np.int64), np.full(len(keys), len(self.sorted))
        while (lo < hi).any():
            mid = np.minimum((lo + hi) // 2, len(self.sorted) - 1)
            own = self.strings(self.sorted[mid])
            at = (own != keys).argmax(axis=1)
            each = np.arange(len(keys))
            x, y = own[each, at].astype(np.int16), keys[each, at].astype(np.int16)
            right = (x <= y if upper else x < y) & (lo < hi)
            hi = np.where(right | (lo >= hi), hi, mid)
            lo = np.where(right, mid + 1, lo)
        return lo

    def find(self, other: Shard, block: int = 4096) -> None:
        """Marks, in both, the strings that both have, by binary search of the other's in this array."""
        if not len(self.sorted):
            return
        hits = np.zeros(len(self.sorted) + 1, np.int64)
        for at in range(0, len(other.starts), block):
            starts = other.starts[at : at + block]
            keys = other.strings(starts)
            lo, hi = self.bound(keys, False), self.bound(keys, True)
            other.repeated[starts[hi > lo]] = True
            np.add.at(hits, lo, hi > lo)
            np.add.at(hits, hi, -(hi > lo).astype(np.int64))
        self.repeated[self.sorted[np.cumsum(hits)[:-1] > 0]] = True


def resolve(rows, cut: Cut):
    """(tag, first, last) of the repeated starts, from (anchor, tag, context) in order of anchor.

    Contexts of many anchors share a shard; those of one anchor that fill several are merged.
    """
    contexts, tags, size, key, done = [], [], 0, None, []

    def flush(keep: bool):
        nonlocal contexts, tags, size
        if contexts:
            shard = Shard(contexts, cut)
            for earlier, _ in done:
                earlier.find(shard)
            done.append((shard, tags))
            contexts, tags, size = [], [], 0
        if not keep:
            for shard, own in done:
                marked = shard.marked()
                owner = shard.owner[marked]
                offset = shard.starts[marked] - shard.begins[owner]
                if len(owner):
                    new = np.nonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)]))[0]
                    end = np.concatenate([new[1:] - 1, [len(owner) - 1]])
                    for a, b in zip(new, end, strict=True):
                        yield own[owner[a]], int(offset[a]), int(offset[b])
            done.clear()

    for anchor, tag, context in rows:
        if contexts and size + len(context) > cut.shard:
            yield from flush(keep=anchor == key)
        elif done and anchor != key:
            yield from flush(keep=False)
        key = anchor
        contexts.append(context)
        tags.append(tag)
        size += len(context)
    yield from flush(keep=False)


def unite(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def signed(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64)


def with_digest(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))


ROW = "anchor long, doc_id long, digest long, first int, n long, place int, context binary"


def batch_of(rows: list[tuple], schema: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [f for f, _ in fields])


def narrowed(row: tuple, width: int, cut: Cut):
    """The parts of a context by where the anchor lies in its strings, ``width`` places each, under keys of the bytes they share."""
    anchor, doc, digest, first, n, place, context = row
    starts = len(context) - cut.size + 1
    for k in range((place - starts + 1) // width, place // width + 1):
        lo, hi = max(k * width, place - starts + 1), min((k + 1) * width - 1, place)  # places of the anchor in the strings
        a, b = place - hi, place - lo + cut.size
        common = context[place - k * width : place - (k + 1) * width + 1 + cut.size]  # what all strings of the range cover
        key = hashlib.blake2b(common, digest_size=8, key=(anchor & (1 << 64) - 1).to_bytes(8, "little"), salt=(k % (1 << 16)).to_bytes(2, "little")).digest()
        yield int.from_bytes(key, "little", signed=True), doc, digest, first + a, n, hi, context[a:b]


def shared_prefix(a: bytes, b: bytes) -> int:
    """The length of the common prefix of two strings."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def reaches(contexts: list[bytes], places: list[int]) -> tuple[list[int], list[int]]:
    """How many bytes before the anchor, and from it on, each context shares with another one at most.

    The suffixes that start at the anchor are sorted, and neighbours compared; the bytes before it likewise, backwards.
    """
    out = []
    for parts in ([c[:p][::-1] for c, p in zip(contexts, places, strict=True)], [c[p:] for c, p in zip(contexts, places, strict=True)]):
        most = [0] * len(parts)
        by = sorted(range(len(parts)), key=parts.__getitem__)
        for i, j in pairwise(by):
            shared = shared_prefix(parts[i], parts[j])
            most[i], most[j] = max(most[i], shared), shared
        out.append(most)
    return out[0], out[1]


def trimmed(rows, cut: Cut, whole: list):
    """(anchor, tag, context) of what one anchor's contexts, which differ, can share; rows are (anchor, tag, place, context), in order of anchor.

    A string that two contexts have lies within what each shares with another on both sides of the anchor.
    Cut to that, contexts that are alike repeat as a whole, and go to ``whole`` as (tag, first, last); one of
    each is left, with a count that says so, if others are left beside it.
    """
    for anchor, group in groupby(rows, key=itemgetter(0)):
        tags, places, contexts = zip(*[row[1:] for row in group], strict=True)
        left: dict[tuple[int, bytes], list[tuple]] = {}
        for (doc, digest, first, n), place, context, before, after in zip(tags, places, contexts, *reaches(contexts, places), strict=True):
            if before + after >= cut.size:
                left.setdefault((before, context[place - before : place + after]), []).append((doc, digest, first + place - before, n))
        for (_, context), own in left.items():
            if len(own) > 1:
                whole += [(tag, 0, len(context) - cut.size) for tag in own]
            if len(left) > 1:
                doc, digest, first, n = own[0]
                yield anchor, (doc, digest, first, n if len(own) == 1 else n + len(own)), context


def compared(rows: DataFrame, cut: Cut) -> DataFrame:
    """(doc_id, digest, a, b) of what repeats of contexts that occur once, a task for each anchor."""

    def kernel(batches):
        def ordered():
            for batch in batches:
                for anchor, doc, digest, first, n, place, context in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                    yield anchor, (doc, digest, first, n), place, context

        whole: list = []
        found = [*resolve(trimmed(ordered(), cut, whole), cut), *whole]
        yield batch_of([(doc, digest, first + a, first + b + cut.size) for (doc, digest, first, n), a, b in found if n == 1], "doc_id long, digest long, a int, b int")

    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(kernel, "doc_id long, digest long, a int, b int")


def repeated_spans(docs: DataFrame, cut: Cut = Cut()) -> DataFrame:
    """(doc_id, digest) -> ``spans``, for the documents that have repeated bytes; spans may overlap."""
    spark = docs.sparkSession

    def find(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            out: list[list] = [[] for _ in range(7)]
            for doc, raw, digest in zip(batch.column(0).to_pylist(), texts(batch), batch.column(2).to_pylist(), strict=True):
                keys, first, last, place = anchors(np.frombuffer(raw, np.uint8), cut)
                if not len(keys):
                    continue
                out[0] += [doc] * len(keys)
                out[1] += [digest] * len(keys)
                out[2].append(signed(keys))
                out[3] += [hashlib.blake2b(raw[a : b + cut.size], digest_size=12).digest() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                out[4].append(first)
                out[5].append(last)
                out[6].append(place - first)
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (out[2], *out[4:])]
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(flat[0]), pa.array(out[3], pa.binary()), *[pa.array(x.astype(np.int32)) for x in flat[1:]]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "digest", "anchor", "context", "first", "last", "place"])

    found = stored(with_digest(docs).mapInArrow(find, "doc_id long, digest long, anchor long, context binary, first int, last int, place int"), "suffix-anchors")
    at = F.struct("doc_id", "digest", "first", "last", "place")
    # one row for each context, with one of its places
    contexts = stored(found.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(at).alias("at")), "suffix-contexts")
    # contexts that occur twice repeat as a whole
    many = contexts.filter("n > 1").select(F.col("anchor").alias("m_anchor"), F.col("context").alias("m_context"))
    whole = found.join(many, (F.col("anchor") == F.col("m_anchor")) & (F.col("context") == F.col("m_context"))).select("doc_id", "digest", F.col("first").alias("a"), (F.col("last") + cut.size).alias("b"))
    spans = [stored(whole, "suffix-whole")]
    drop_stored(found)
    released(spark)
    # anchors with several contexts, of which one at least occurs once
    several = contexts.groupBy("anchor").agg(F.count("*").alias("n_contexts"), F.min("n").alias("least")).filter("n_contexts > 1 and least = 1").select(F.col("anchor").alias("s_anchor"))
    chosen = contexts.join(several, F.col("anchor") == F.col("s_anchor")).select("anchor", "n", "at.*")
    wanted = chosen.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("anchor", "n", "first", "last", "place")).alias("want"))
    wanted = stored(wanted.select(F.col("doc_id").alias("w_doc"), F.col("digest").alias("w_digest"), "want"), "suffix-wanted")
    drop_stored(contexts)
    released(spark)

    def cut_out(batches):
        before = None
        for batch in sliced(batches, 64):
            rows = []
            for doc, raw, digest, want in zip(batch.column(0).to_pylist(), texts(batch), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if (doc, digest) != before:  # equal rows are side by side
                    rows += [(w["anchor"], doc, digest, w["first"], w["n"], w["place"], raw[w["first"] : w["last"] + cut.size]) for w in want]
                before = doc, digest
            yield batch_of(rows, ROW)

    own = F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("digest") == F.col("w_digest"))
    text_of = with_digest(docs).join(wanted.hint("merge"), own).select("doc_id", "text", "digest", "want")
    rows = stored(text_of.mapInArrow(cut_out, ROW), "suffix-shipped")
    drop_stored(wanted)
    released(spark)
    width = cut.size - cut.gram + 1
    while True:
        hot = rows.groupBy(F.col("anchor").alias("h_anchor")).agg(F.sum(F.length("context")).alias("bytes")).filter(F.col("bytes") > cut.most).select("h_anchor")
        hot = stored(hot, "suffix-hot", narrow=True)
        if not hot.limit(1).count():
            break
        width = -(-width // 4)
        spans.append(stored(compared(rows.join(hot, F.col("anchor") == F.col("h_anchor"), "left_anti"), cut), "suffix-partial"))

        def divide(batches, width=width):
            for batch in sliced(batches, 256):
                parts = [part for row in zip(*[x.to_pylist() for x in batch.columns], strict=True) for part in narrowed(row, width, cut)]
                yield batch_of([(*p, hashlib.blake2b(p[-1], digest_size=16).digest()) for p in parts], ROW + ", mark binary")

        parts = stored(rows.join(hot, F.col("anchor") == F.col("h_anchor"), "left_semi").mapInArrow(divide, ROW + ", mark binary"), "suffix-parts")
        drop_stored(rows)
        drop_stored(hot)
        at = F.struct("doc_id", "digest", "first", "place", "context")
        same = stored(parts.groupBy("anchor", "mark").agg(F.sum("n").alias("n"), F.min(at).alias("at")), "suffix-same")
        twice = same.filter("n > 1").select(F.col("anchor").alias("t_anchor"), F.col("mark").alias("t_mark"))
        again = parts.filter("n = 1").join(twice, (F.col("anchor") == F.col("t_anchor")) & (F.col("mark") == F.col("t_mark")))
        spans.append(stored(again.select("doc_id", "digest", F.col("first").alias("a"), (F.col("first") + F.length("context")).cast("int").alias("b")), "suffix-again"))
        drop_stored(parts)
        several = same.groupBy("anchor").agg(F.count("*").alias("k"), F.min("n").alias("least")).filter("k > 1 and least = 1").select(F.col("anchor").alias("s_anchor"))
        left = same.join(several, F.col("anchor") == F.col("s_anchor"), "left_semi")
        rows = stored(left.select("anchor", "at.doc_id", "at.digest", "at.first", "n", "at.place", "at.context"), "suffix-shipped")
        drop_stored(same)
        released(spark)
    spans.append(stored(compared(rows, cut), "suffix-partial"))
    drop_stored(rows)
    released(spark)
    every = spans[0]
    for x in spans[1:]:
        every = every.unionByName(x)
    out = stored(every.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "suffix-spans")
    for x in spans:
        drop_stored(x)
    released(spark)
    return out


def remove_repeats(docs: DataFrame, cut: Cut = Cut(), *, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and has_repeat; with ``keep_text`` also spans and remaining bytes."""
    spans = repeated_spans(docs, cut).select(F.col("doc_id").alias("s_doc"), F.col("digest").alias("s_digest"), "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, has_repeat boolean" + ", removed array<struct<a int, b int>>, kept binary" * keep_text

    def kernel(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            rows = []
            for doc, raw, found in zip(batch.column(0).to_pylist(), texts(batch), batch.column(2).to_pylist(), strict=True):
                own = unite([(x["a"], x["b"]) for x in found or []])
                kept, at = [], 0
                for a, b in own:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                rows.append((doc, len(raw), len(raw) - len(kept), len(own), hashlib.sha256(kept).hexdigest(), bool(own)) + ([{"a": a, "b": b} for a, b in own], kept) * keep_text)
            kinds = [*[pa.int64()] * 4, pa.string(), pa.bool_()] + [pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.binary()] * keep_text
            names = [x.split()[0] for x in schema.replace("<a int, b int>", "").split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    own = F.col("doc_id").eqNullSafe(F.col("s_doc")) & F.col("digest").eqNullSafe(F.col("s_digest"))
    return with_digest(docs).join(spans, own, "left").select("doc_id", "text", "spans").mapInArrow(kernel, schema)
