"""Best-fit packing of token sequences, in bulk-synchronous steps.

Documents become token ids, each ended by one more id; only documents over the capacity are cut, into
pieces of the capacity with a shorter last one. Pieces are then packed best-fit decreasing:

1. Pieces and gaps are in order of size. As sizes are whole numbers up to the capacity, a size class is
   one entry with a count, and the pieces of a class are told apart by rank only; so a sweep works on at
   most ``capacity`` entries, however many pieces there are.
2. A superstep takes the next class of pieces, longest first, and matches it to the successor in the gaps
   (the smallest gap that holds it). Pieces that want the same gap are served by rank: the i-th piece goes
   to the i-th gap of the class, and those left over go on to the next larger gap, or open new sequences.
3. The gaps are updated, and the next superstep begins.

The sweeps give runs (length, first rank, last rank) -> (first sequence, pieces in each, offset); pieces
get their ranks in a distributed pass (counts by length and salt, then a window inside a salt; as many salts
as the commonest length asks for) and look up their run. The only state on the driver is the histogram of
lengths and the runs, both bounded by the capacity and not by the data. Pieces of the whole capacity need no
match and take no part.

Words of any length are encoded whole, long ones in time that grows as their length and its logarithm.
Null and empty texts are one piece that is the end id alone. Repeated rows are separate documents with
pieces of their own. Empty input gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from bisect import bisect_left, insort
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import sliced, stored, texts

CAPACITY, END = 4096, 1
#: Pieces of one length that a window ranks, about; a length with more is dealt to several.
WINDOW = 200_000
#: Parts that every length is dealt to at least.
SALTS = 64
TOKENIZER = "word_bpe_49k.json"
#: Words kept in a worker's tables of encoded words: a table of half as many, and the one before it.
CACHED_WORDS = 1_000_000


#: Byte-level vocabularies write a byte that is no visible Latin-1 sign as the next sign from 256 on.
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
BYTE_SIGNS = {b: 256 + n for n, b in enumerate(_HIDDEN)}


class Merges:
    """Byte-pair merges applied to many words at once.

    Each step merges, in every word, the leftmost of its pairs of lowest rank, as a queue of one word
    would; words of similar length share a matrix, a word in each column.
    """

    NONE = np.int64(1 << 40)
    #: In place of an id, what no pair has.
    OUTSIDE = np.int64((1 << 20) - 1)
    #: Bytes from which on a word goes through a queue of its own, as a matrix looks through its whole column at each merge.
    LONG = 400

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        signs = [chr(BYTE_SIGNS.get(b, b)) for b in range(256)]
        self.inner = np.array([vocab[c] for c in signs], np.int64)
        self.last = np.array([vocab[c + suffix] for c in signs], np.int64)
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        merged = self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # rank and result of a pair in one number; an open table of 2 ** bits places finds it
        self.bits = 18
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.values = np.full((1 << self.bits) + 64, self.NONE, np.int64)
        self.pairs: dict[int, int] = {}
        for key, value in zip((left << 20 | right).tolist(), (np.arange(len(pairs)) << 20 | merged).tolist(), strict=True):
            at = self.home(key)
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.values[at] = key, value
            self.pairs[key] = value

    def home(self, key):
        return (key * 11400714819323 >> 20) % (1 << self.bits)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = self.home(key)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], self.NONE)
        rows = np.nonzero((found != key) & (found >= 0))[0]  # few: most places hold the pair or nothing
        while len(rows):
            at[rows] += 1
            found = self.keys[at[rows]]
            hit = found == key[rows]
            out[rows[hit]] = self.values[at[rows[hit]]]
            rows = rows[~hit & (found >= 0)]
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        short = int(np.searchsorted(lengths[order], self.LONG, "right"))
        for i in order[short:].tolist():
            out[i] = self.queue(words[i])
        order = order[:short]
        at = 0
        while at < len(order):
            width = int(lengths[order[at]])
            width = max(4, width + width // 4)
            end = int(np.searchsorted(lengths[order], width, "right"))
            end = min(end, at + max(1, 400_000 // width))
            part = order[at:end]
            for i, code in zip(part.tolist(), self.matrix([words[i] for i in part.tolist()], lengths[part]), strict=True):
                out[i] = code
            at = end
        return out

    def queue(self, word: bytes) -> bytes:
        """One word's ids, by a heap of its pairs and links to what stands left and right of each."""
        raw = np.frombuffer(word, np.uint8)
        codes = self.inner[raw]
        codes[-1] = self.last[raw[-1]]
        first = self.ranks(codes[:-1], codes[1:])
        n, ids, none, get = len(codes), codes.tolist(), int(self.NONE), self.pairs.get
        pair = [*first.tolist(), none]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [v >> 20 << 32 | i for i, v in enumerate(pair) if v < none]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            if pair[i] >> 20 != top >> 32:
                continue  # one of the two has gone into another pair
            ids[i] = pair[i] & 0xFFFFF
            gone = right[i]
            ids[gone], pair[gone] = -1, none
            after = right[i] = right[gone]
            pair[i] = none
            if after < n:
                left[after] = i
                pair[i] = v = get(ids[i] << 20 | ids[after], none)
                if v < none:
                    heappush(heap, v >> 20 << 32 | i)
            before = left[i]
            if before >= 0:
                pair[before] = v = get(ids[before] << 20 | ids[i], none)
                if v < none:
                    heappush(heap, v >> 20 << 32 | before)
        codes = np.array(ids, np.int64)
        return codes[codes >= 0].astype("<u4").tobytes()

    def matrix(self, words: list[bytes], length: np.ndarray) -> list[bytes]:
        """Words in columns: a merge writes the places it touches, and links lead past those that are gone."""
        n, width = len(words), int(length.max())
        if not width:
            return [b""] * n
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width).T
        # one more row stands for what is outside of a word, and makes no pair
        ids = np.full((width + 1, n), self.OUTSIDE)
        place = np.arange(width)[:, None]
        inside = place < length
        ids[:-1][inside] = self.inner[raw][inside]
        some = np.nonzero(length)[0]
        ids[length[some] - 1, some] = self.last[raw[length[some] - 1, some]]
        alive = inside.copy()
        right = np.where(inside, place + 1, width).astype(np.int16)
        right[length[some] - 1, some] = width
        left = np.repeat(np.where(place > 0, place - 1, width), n, axis=1).astype(np.int16)
        left = np.concatenate([left, np.full((1, n), width, np.int16)])
        # rank and place of each pair in one number, so that the least one is the leftmost of lowest rank
        none = np.int32(1 << 30)
        pair = np.full((width + 1, n), none)
        pair[: width - 1] = self.placed(self.ranks(ids[: width - 1].ravel(), ids[1:width].ravel()).reshape(width - 1, n), place[:-1], none)
        columns = np.arange(n)
        while True:
            best = pair[:width].min(axis=0) if len(columns) == n else pair[:width, columns].min(axis=0)
            live = best < none
            columns, best = columns[live], best[live]
            if not len(columns):
                break
            j = (best & 511).astype(np.intp)
            new = self.merged[best >> 9]
            gone = right[j, columns].astype(np.intp)
            after, before = right[gone, columns].astype(np.intp), left[j, columns].astype(np.intp)
            ids[j, columns] = new
            alive[gone, columns] = False
            pair[gone, columns] = none
            right[j, columns] = after
            left[after, columns] = j
            pair[j, columns] = self.placed(self.ranks(new, ids[after, columns]), j, none)
            pair[before, columns] = self.placed(self.ranks(ids[before, columns], new), before, none)
        flat = ids[:-1].T[alive.T].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(axis=0) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def placed(self, values: np.ndarray, place: np.ndarray, none: np.int32) -> np.ndarray:
        return np.where(values < self.NONE, (values >> 20 << 9) | place, none).astype(np.int32)


class WordEncoder:
    """Ids as little-endian 32-bit bytes, by a tokenizer that never joins across a space or line feed.

    Each distinct word is encoded once. A plain word (ASCII signs and Latin-1 letters) is lower-cased and cut
    into runs of letters, single digits and runs of other signs, as the tokenizer does, and its merges
    are applied to all new runs together; every other word, and a text that holds the name of a special
    token, goes through the whole tokenizer.
    """

    #: The tokenizer's own split, for lower-case plain words; a line feed ends a word.
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|\n|[^\na-z0-9\xdf-\xf6\xf8-\xff]+")
    #: For each line, letters and signs of which a run is a part of its own after letters, and what else there is.
    SIMPLE = re.compile("^([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]*)([.,;:!?]*)(.*)$", re.MULTILINE)
    PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}
        sample = [w.encode() for w in "Don't we'LL go to 1,234.5 (x_y) <<a>> ab'cd! \xc9t\xe9 \xdcber \xd1 \xf8\xff-\xdf unbelievably end., what?! a.b. No:".split()]
        self.learn(sample)
        if any(self.table[w] != self.ids(w.decode()) for w in sample):
            raise ValueError(f"{path} does not split and merge words as this encoder does")

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: list[bytes]) -> None:
        simple, heads, marks, plain = [], [], [], []
        for raw, (head, mark, rest) in zip(new, self.SIMPLE.findall(b"\n".join(new).decode()) if new else [], strict=True):
            if head and not rest:
                simple.append(raw)
                heads.append(head)
                marks.append(mark)
            elif self.PLAIN.fullmatch(word := f"{head}{mark}{rest}"):
                plain.append((raw, word))
            else:
                self.table[raw] = self.ids(word)
        found = self.PARTS.findall("".join([f"{w}\n" for _, w in plain]).lower())
        letters = "\n".join(heads).lower().split("\n") if heads else []
        parts = self.parts
        fresh = [p for p in {*found, *letters, *marks} if p not in parts and p != "\n"]
        parts.update(zip(fresh, self.merges.encode([p.encode() for p in fresh]), strict=True))
        self.table.update(zip(simple, [parts[a] + parts[m] for a, m in zip(letters, marks, strict=True)], strict=True))
        code, words = b"", iter(plain)
        for part in found:
            if part == "\n":
                self.table[next(words)[0]] = code
                code = b""
            else:
                code += parts[part]

    def encode(self, raw: list[bytes]) -> list[bytes]:
        if len(self.table) + len(self.parts) > CACHED_WORDS // 2:
            self.older, self.table, self.parts = self.table, {b"": b""}, {"": b""}
        get, cut, new = self.table.get, [], set()
        for r in raw:
            if any(s in r for s in self.special):
                cut.append(None)
                continue
            words = r.replace(b"\n", b" ").split(b" ")
            codes = list(map(get, words))
            open_ = [k for k, c in enumerate(codes) if c is None]
            missing = [words[k] for k in open_]
            new.update(missing)
            cut.append((codes, open_, missing))
        again = {w: c for w in new if (c := self.older.get(w)) is not None}
        self.table.update(again)
        self.learn([w for w in new if w not in again])
        out = []
        for r, c in zip(raw, cut, strict=True):
            if c is None:
                out.append(self.ids(r.decode()))
                continue
            codes, open_, missing = c
            for k, w in zip(open_, missing, strict=True):
                codes[k] = self.table[w]
            out.append(b"".join(codes))
        return out


@cache
def encoder_of(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker, with the words it knows by then."""
    return WordEncoder(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, and ``ids`` if kept.

    tokenizer: a file that every executor has; by default that of the installed vocabulary package.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    last = int(end).to_bytes(4, "little")

    def kernel(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = encoder_of(tokenizer or tokenizer_path())
        for batch in sliced(batches):
            gc.disable()  # nothing here is in a cycle, and a collection walks the tables
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts(batch)), strict=True):
                ids += last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)) + (np.frombuffer(part, "<u4"),) * keep_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * keep_ids
            names = [x.split()[0] for x in schema.split(", ")]
            gc.enable()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(kernel, schema)


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, rank, n, sequence, each, offset), by best-fit decreasing on classes.

    Pieces ``rank .. rank + n - 1`` of this length go to sequences from ``sequence`` on, ``each`` to a
    sequence, side by side from ``offset``. Pieces of one length are packed as they would be one by one.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    sizes: list[int] = []  # of gaps, in order
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> (first sequence, how many)
    opened = 0

    def add(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in gaps:
                insort(sizes, size)
                gaps[size] = []
            gaps[size].append((first, n))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                size = sizes[at]
                first, n = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size]
                    sizes.pop(at)
                fresh = False
            else:
                size, first, n, fresh = capacity, opened, -(-left // (capacity // length)), True
                opened += n
            each = size // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, capacity - size))
                add(size - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and left:  # the last sequence of this length is not filled by it
                runs.append((length, rank, left, first, left, capacity - size))
                add(size - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            if n and not fresh:
                add(size, first, n)
    return runs


def place(parts: DataFrame, *, capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """``parts`` (doc_id, piece, start, length and more) with ``sequence_id`` and ``offset``.

    ``parts`` must be a stored table: it is read several times, and ranks have to agree. Pieces of the whole
    capacity are sequences of their own, with negative numbers.
    """
    spark = parts.sparkSession
    full = parts.filter(F.col("length") == capacity).select("*", (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = parts.filter(F.col("length") < capacity)
    by_length = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}  # ``capacity`` at most
    salts = max(SALTS, 1 + max(by_length.values(), default=0) // window)
    salted = rest.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    before = stored(counts.select(F.col("length").alias("b_length"), F.col("salt").alias("b_salt"), before.alias("before")), "pack-ranks", narrow=True)
    runs = sorted(sweep(by_length, capacity))
    keys = np.array([length << 44 | rank for length, rank, *_ in runs], np.int64)
    table = np.array([(rank, first, each, offset) for _, rank, _, first, each, offset in runs], np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast((keys, table))  # a few runs for each length

    def kernel(batches):
        import pyarrow as pa

        keys, table = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)
            length, rank = get("length"), get("rank")
            first, sequence, each, offset = table[np.searchsorted(keys, length << 44 | rank, "right") - 1].T
            k = rank - first
            kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n != "rank"]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(sequence + k // each), pa.array(offset + k % each * length)], [n for n, _ in kept] + ["sequence_id", "offset"])

    own = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", *[c for c in ("ids_crc32",) if c in parts.columns]))
    ranked = salted.withColumn("rank", own - 1).join(before, (F.col("length") == F.col("b_length")) & (F.col("salt") == F.col("b_salt")))
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).select(*parts.columns, "rank")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return full.unionByName(ranked.mapInArrow(kernel, f"{fields}, sequence_id long, offset long"))


def pack(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of ``docs``."""
    return place(stored(pieces(docs, tokenizer=tokenizer, capacity=capacity, end=end), "pack-pieces"), capacity=capacity)
