"""Subword lattice likelihood: the probability of a text, over all ways to cut it into pieces.

The pieces are those of an existing vocabulary with word ends; each has a score, the logarithm of its
probability. A word's probability is the sum over all its segmentations of the product of the pieces'
probabilities, found by a forward recursion in log space; a text is its words and then one end, which is a
piece of its own, so its probability is the product of those. Pieces with a word end close a word, so nothing
is counted twice, and the probabilities of all texts add up to at most 1.

Scores start from the vocabulary's own order (a piece of rank r weighs 1 / (r + 1)) and are then fitted to
the training documents by expectation steps: all their distinct words, weighted by their counts, pass through
the forward and backward recursions in parallel, and only sums for each piece (bounded by the vocabulary)
reach the driver. What is shuffled are word counts, which grow with the corpus.

A word's count and probability are computed once for each distinct word. Documents look them up in two
ways: words with at least ``1 / heavy`` of all tokens are at most ``heavy`` words by pigeonhole, so they
are broadcast and resolved where the document is read, and no frequent word is ever a join key; each of
the other words is a small share of all tokens and joins by its text.

Null and empty texts are the end alone. Repeated rows are documents each on its own for training; for
scoring, rows that repeat a ``doc_id`` get a row each, kept apart by a row number. Empty input gives no rows;
without a training document all pieces are alike. Words of any length are scored whole, in time in proportion to
it. Only ``doc_id`` and ``text`` are read, so further columns may have any name.
"""

from __future__ import annotations

import gc
import json
import math
from collections import Counter
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, stored, texts

VOCABULARY = "word_bpe_49k.json"
HEAVY, STEPS = 40_000, 3
NEVER = -1e30
#: Distinct words in a worker's counter, and bytes of text read into it, before it is passed on.
FLUSH, FLUSH_BYTES = 200_000, 64_000_000
#: Bytes of a word from which on it has a recursion of its own.
LONG = 256


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


class Pieces:
    """The vocabulary: byte strings, inside a word or at its end, found by a polynomial hash."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, inner: list[bytes], last: list[bytes], order_inner: list[int], order_last: list[int]):
        self.size = len(inner) + len(last)
        ranks = np.array(order_inner + order_last, float)
        self.start = -np.log(ranks + 1)
        self.longest = max(map(len, inner + last))
        self.tables = []
        at = 0
        for group in (inner, last):
            hashes = np.array([self.hash(p) for p in group], np.uint64)
            order = np.argsort(hashes)
            if len(np.unique(hashes)) < len(hashes):
                raise ValueError("two pieces have one hash")
            maybe = np.zeros(1 << 20, bool)  # by the high bits, to skip most spans that are no piece
            maybe[hashes >> np.uint64(44)] = True
            self.tables.append((hashes[order], (order + at).astype(np.int64), maybe))
            at += len(group)

    @classmethod
    def load(cls, path: str) -> Pieces:
        from .packing import BYTE_SIGNS

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix, back = model["end_of_word_suffix"], {chr(BYTE_SIGNS.get(b, b)): b for b in range(256)}
        groups: list[dict[bytes, int]] = [{}, {}]
        for piece, rank in model["vocab"].items():
            end = piece.endswith(suffix) and piece != suffix
            groups[end].setdefault(bytes(back[c] for c in (piece[: -len(suffix)] if end else piece)), rank)
        return cls(*map(list, groups), *(list(g.values()) for g in groups))

    def hash(self, piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(self.BASE) + b + 1) % (1 << 64)
        return h

    def find(self, hashes: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """Where the hashes are those of pieces, and the ids of these."""
        known, ids, maybe = self.tables[last]
        some = np.nonzero(maybe[hashes >> np.uint64(44)])[0]
        wanted = hashes[some]
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        hit = known[at] == wanted
        return some[hit], ids[at[hit]]


@cache
def pieces_of(path: str) -> Pieces:
    """One table for all tasks of a worker."""
    return Pieces.load(path)


def lattice(words: list[bytes], pieces: Pieces):
    """Batches (places, matrix of letters, length) of the words that have the same length."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) < LONG:
            by.setdefault(len(w), []).append(i)
    for length, places in sorted(by.items()):
        step = max(1, 2_000_000 // (length * min(length, pieces.longest)))
        for at in range(0, len(places), step):
            part = places[at : at + step]
            letters = np.frombuffer(b"".join([words[i] for i in part]), np.uint8).reshape(len(part), length)
            yield np.array(part), letters, length


def edges(letters: np.ndarray, length: int, pieces: Pieces) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """For each span (i, j) that some word has a piece for: these words' rows, and the ids of the pieces."""
    found = {}
    prefix = np.zeros((length + 1, len(letters)), np.uint64)
    power = np.ones(length + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(length):
            prefix[j + 1] = prefix[j] * pieces.BASE + letters[:, j] + np.uint64(1)
            power[j + 1] = power[j] * pieces.BASE
        for j in range(1, length + 1):
            for i in range(max(0, j - pieces.longest), j):
                rows, ids = pieces.find(prefix[j] - prefix[i] * power[j - i], j == length)
                if len(rows):
                    found[i, j] = rows, ids
    return found


def forward(found, n: int, length: int, score: np.ndarray) -> np.ndarray:
    alpha = np.full((length + 1, n), NEVER)
    alpha[0] = 0
    for (i, j), (rows, ids) in sorted(found.items(), key=lambda x: x[0][1]):
        alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + score[ids])
    return alpha


class Chain:
    """The lattice of one long word: its pieces as arrays, in order of their ends."""

    def __init__(self, word: bytes, pieces: Pieces):
        self.length = n = len(word)
        base, h, prefix = int(pieces.BASE), 0, [0]
        for c in word:
            h = (h * base + c + 1) % (1 << 64)
            prefix.append(h)
        prefix, parts = np.array(prefix, np.uint64), []
        for k in range(1, min(n, pieces.longest) + 1):
            with np.errstate(over="ignore"):
                spans = prefix[k:] - prefix[:-k] * np.uint64(pow(base, k, 1 << 64))
            for part, last, at in ((spans[:-1], False, 0), (spans[-1:], True, n - k)):
                i, ids = pieces.find(part, last)
                parts.append((i + at, i + at + k, ids))
        start, end, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(end, kind="stable")
        self.start, self.end, self.ids = start[order], end[order], ids[order]

    def recursion(self, weight: list[float], pairs) -> list[float]:
        out = [NEVER] * (self.length + 1)
        out[pairs[0][0]] = 0.0
        for (i, j), w in zip(pairs[1], weight, strict=True):
            a, b = out[j], out[i] + w
            out[j] = max(a, b) + math.log1p(math.exp(-min(700.0, abs(a - b))))
        return out

    def alpha(self, score: np.ndarray) -> list[float]:
        return self.recursion(score[self.ids].tolist(), ((0,), zip(self.start.tolist(), self.end.tolist(), strict=True)))

    def uses(self, score: np.ndarray) -> np.ndarray:
        """Expected uses of each of the word's pieces."""
        back = np.argsort(-self.start, kind="stable")
        alpha = np.array(self.alpha(score))
        beta = np.array(self.recursion(score[self.ids[back]].tolist(), ((self.length,), zip(self.end[back].tolist(), self.start[back].tolist(), strict=True))))
        return np.exp(np.minimum(alpha[self.start] + score[self.ids] + beta[self.end] - alpha[-1], 0))


def log_probability(words: list[bytes], pieces: Pieces, score: np.ndarray) -> np.ndarray:
    """The natural logarithm of each word's marginal probability."""
    out = np.zeros(len(words))
    for places, letters, length in lattice(words, pieces):
        out[places] = forward(edges(letters, length, pieces), len(places), length, score)[length]
    for k, w in enumerate(words):
        if len(w) >= LONG:
            out[k] = Chain(w, pieces).alpha(score)[-1]
    return out


def expected(words: list[bytes], counts: np.ndarray, pieces: Pieces, score: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, over all segmentations of the words."""
    out = np.zeros(pieces.size)
    for places, letters, length in lattice(words, pieces):
        found = edges(letters, length, pieces)
        alpha = forward(found, len(places), length, score)
        beta = np.full((length + 1, len(places)), NEVER)
        beta[length] = 0
        for (i, j), (rows, ids) in sorted(found.items(), key=lambda x: -x[0][0]):
            beta[i, rows] = np.logaddexp(beta[i, rows], beta[j, rows] + score[ids])
        for (i, j), (rows, ids) in found.items():
            uses = np.exp(np.minimum(alpha[i, rows] + score[ids] + beta[j, rows] - alpha[length, rows], 0)) * counts[places[rows]]
            np.add.at(out, ids, uses)
    for k, w in enumerate(words):
        if len(w) >= LONG:
            chain = Chain(w, pieces)
            np.add.at(out, chain.ids, chain.uses(score) * counts[k])
    return out


def tokens(raw: bytes) -> list[bytes]:
    return raw.lower().split()  # of ASCII letters and white space only


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), n (times in training documents), for every distinct word of ``docs``."""

    def kernel(batches):
        import pyarrow as pa

        def out(counter):
            return pa.RecordBatch.from_arrays([pa.array(list(counter), pa.binary()), pa.array(list(counter.values()), pa.int64())], ["word", "n"])

        counter: Counter = Counter()
        size = 0
        for batch in sliced(batches):
            for raw, held in zip(texts(batch), batch.column(1).to_pylist(), strict=True):
                own = tokens(raw)
                if held:
                    for w in set(own):
                        counter[w] += 0
                else:
                    counter.update(own)
                size += len(raw)
                if len(counter) > FLUSH or size > FLUSH_BYTES:
                    yield out(counter)
                    counter, size = Counter(), 0
        if counter:
            yield out(counter)

    rows = docs.select("text", held_out(F.col("doc_id")).alias("held")).mapInArrow(kernel, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def path_of(vocabulary: str | None) -> str:
    import public_tokenizers

    return vocabulary or public_tokenizers.path(VOCABULARY)


def fit_scores(counts: DataFrame, ends: int, *, vocabulary: str | None = None, steps: int = STEPS) -> np.ndarray:
    """Log probabilities of the pieces and, as the last one, of the end, from the word counts of training."""
    spark = counts.sparkSession
    pieces = pieces_of(path_of(vocabulary))
    score = pieces.start - np.logaddexp.reduce(pieces.start)
    for _ in range(steps):
        shared = spark.sparkContext.broadcast(score)

        def kernel(batches, shared=shared):
            import pyarrow as pa

            pieces, total = pieces_of(path_of(vocabulary)), None
            for batch in batches:
                words = batch.column(0).to_pylist()
                if words:
                    part = expected(words, batch.column(1).to_numpy().astype(float), pieces, shared.value)
                    total = part if total is None else total + part
            if total is not None:
                used = np.nonzero(total > 0)[0]
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "uses"])

        sums = counts.filter("n > 0").select("word", "n").mapInArrow(kernel, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
        uses = np.full(pieces.size + 1, 0.01)  # so that no piece, and no word, becomes impossible
        uses[sums["piece"].to_numpy()] += sums["uses"].to_numpy()
        uses[-1] += ends
        score = np.log(uses / uses.sum())
        shared.unpersist()
    return score


def score_documents(docs: DataFrame, *, vocabulary: str | None = None, heavy: int = HEAVY, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    counts = stored(word_counts(docs), "lm-counts")
    ends = docs.select(held_out(F.col("doc_id")).alias("h")).filter("not h").count()
    total = counts.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    n, v = (total["n"] or 0) + ends, total["v"] + (ends > 0)
    score = fit_scores(counts, ends, vocabulary=vocabulary, steps=steps)
    end_score = float(score[-1])
    ln10, floor = float(np.log(10)), n + v + 1
    shared = spark.sparkContext.broadcast(score)

    def rate(batches):
        import pyarrow as pa

        pieces = pieces_of(path_of(vocabulary))
        for batch in batches:
            words, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            own = log_probability(words, pieces, shared.value) / ln10
            base = np.log10((c + 1) / floor)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base), pa.array(own)], ["word", "n", "base", "own"])

    rated = stored(counts.select("word", "n").mapInArrow(rate, "word binary, n long, base double, own double"), "lm-words")
    limit = max(1, -(-n // heavy))  # at most ``heavy`` words have as many tokens
    top = rated.filter(F.col("n") >= limit).toArrow()
    common = dict(zip(top["word"].to_pylist(), zip(top["n"].to_pylist(), top["base"].to_pylist(), top["own"].to_pylist(), strict=True), strict=True))
    words = spark.sparkContext.broadcast(common)
    end_base = float(np.log10((ends + 1) / floor))

    schema = "row long, doc_id long, word binary, k long, n_tokens long, n_known long, base double, own double"

    def split(batches):
        """A row with what is known of a document, without a word, and a row for each of its other words."""
        import pyarrow as pa
        from pyspark import TaskContext

        known, row = words.value, TaskContext.get().partitionId() << 40
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for batch in sliced(batches):
            gc.disable()  # nothing here is in a cycle, and a collection walks all that is kept
            out: list[list] = [[] for _ in kinds]
            for doc, raw in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                row += 1
                n_tokens, n_known, base, own = 1, int(ends > 0), end_base, end_score / ln10
                rest, times = [], []
                for w, k in Counter(tokens(raw)).items():
                    n_tokens += k
                    found = known.get(w)
                    if found is None:
                        rest.append(w)
                        times.append(k)
                    else:
                        c, b, o = found
                        n_known, base, own = n_known + k * (c > 0), base + k * b, own + k * o
                none = [None] * len(rest)
                for column, first, more in zip(out, (row, doc, None, 0, n_tokens, n_known, base, own), ([row] * len(rest), none, rest, times, none, none, none, none), strict=True):
                    column.append(first)
                    column += more
            gc.enable()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    # stored, so that row numbers agree
    rows = stored(docs.select("doc_id", "text").mapInArrow(split, schema), "lm-rows")
    whole = rows.filter("word is null").select("row", "doc_id", "n_tokens", "n_known", "base", "own")
    rare = rated.filter(F.col("n") < limit).select(F.col("word").alias("w"), F.col("n").alias("c"), F.col("base").alias("b"), F.col("own").alias("o"))
    k = F.col("k")
    joined = rows.filter("word is not null").select("row", "word", "k").join(rare, F.col("word") == F.col("w"))
    rest = joined.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_tokens"), F.when(F.col("c") > 0, k).otherwise(F.lit(0)).alias("n_known"), (k * F.col("b")).alias("base"), (k * F.col("o")).alias("own"))
    out = whole.unionByName(rest).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("own").alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
