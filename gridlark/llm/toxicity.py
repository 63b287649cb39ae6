"""Toxicity by multiple-instance learning.

A document is a bag of sentences; only documents have labels. A sentence's score is a logistic function
of its words, and a document's is the noisy-or of its sentences, ``1 - prod(1 - p)``. The loss on the
document labels is minimised by gradient steps through the noisy-or, so that single sentences learn what
makes a bag positive; they then point out the offending ones.

Features of a sentence are its distinct words and their beginnings of 4 to 8 bytes, so that inflected
forms share what they have learned. Labels are learned from ``sample`` labelled documents at most, the first in
the order of a seeded hash of their ids (all, if there are fewer): their texts are stored once, features whose
share of bags differs between the labels by ``least`` standard errors of the log odds are kept, all of them, and
the weights are fitted. Scoring covers all documents and whole texts. Only texts are inputs of a score.

Null and empty texts have no sentences and score 0. Labels without a document, or null, are left out;
with no positive or no negative label every score is 0. A document with several labels is toxic if one says so; of
documents that share a sampled ``doc_id`` the smallest text is learned from. Scoring is row by row, so repeated
rows get a row each. Empty documents give no rows, and empty labels a score of 0. Only ``doc_id``, ``text`` and
``toxic`` are read, so further columns may have any name.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, sliced, stored, texts

SENTENCE_END = re.compile(rb"(?<=[.!?])[\x20\x09-\x0D]+|\n+")
STRIP = b".,;:!?\"'()[]{}|*#$%&<>-"
SAMPLE, LEAST, THRESHOLD = 12_000, 3.0, 0.3
#: Features in a worker's counter before it is passed on.
FLUSH = 300_000
PREFIXES = range(4, 9)


def sentences(raw: bytes) -> list[tuple[int, int]]:
    """Byte spans of the sentences that have a word."""
    out, at = [], 0
    for m in SENTENCE_END.finditer(raw):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(raw)))
    return [(a, b) for a, b in out if raw[a:b].strip()]


def word_features(word: bytes) -> list[bytes]:
    word = word.strip(STRIP)
    return [word, *[word[:k] + b"*" for k in PREFIXES if len(word) >= k]] if word else []


def features(sentence: bytes) -> set[bytes]:
    return {f for w in set(sentence.lower().split()) for f in word_features(w)}


class Model:
    """Weights of features, and what a sentence without any scores."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias, self.table = weights, bias, {}

    def known(self, word: bytes) -> tuple[bytes, ...]:
        found = self.table.get(word)
        if found is None:
            if len(self.table) > 300_000:
                self.table.clear()
            found = self.table[word] = tuple(f for f in word_features(word) if f in self.weights)
        return found

    def active(self, sentence: bytes) -> list[bytes]:
        """The sentence's features that have weights, in order."""
        return sorted({f for w in set(sentence.lower().split()) for f in self.known(w)})

    def sentence(self, sentence: bytes) -> float:
        z = self.bias + sum(self.weights[f] for f in self.active(sentence))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def fit(bags, rest, labels, n_features: int, *, steps: int = 400, rate: float = 0.05, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias.

    bags: an Arrow array of the documents' sentences that have features, lists of these; rest: how many of its sentences have none.
    """
    y, empty = np.asarray(labels, float), np.asarray(rest, float)
    if not len(y) or y.min() == y.max():
        return np.zeros(n_features), -30.0
    sentence = bags.flatten()
    columns = sentence.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    n = len(sentence)
    rows = np.repeat(np.arange(n, dtype=np.int32), sentence.value_lengths().to_numpy(zero_copy_only=False))
    owner = np.repeat(np.arange(len(y), dtype=np.int32), bags.value_lengths().to_numpy(zero_copy_only=False))
    w, bias = np.zeros(n_features), -6.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    log_keep = lambda p: np.log1p(-np.minimum(p, 1 - 1e-12))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(rows, w[columns], minlength=n), -30, 30)))
        p0 = 1 / (1 + np.exp(-max(-30.0, min(30.0, bias))))
        keep = np.exp(np.bincount(owner, log_keep(p), minlength=len(y)) + empty * log_keep(p0))  # prod(1 - p)
        bag = np.clip(1 - keep, 1e-9, 1 - 1e-9)
        pull = -(y - bag) / bag / len(y)  # d loss / d z of a sentence is its p times this
        g = pull[owner] * p
        gw = np.bincount(columns, g[rows], minlength=n_features) + l2 * w / len(y) / 100
        gb = g.sum() + (pull * empty).sum() * p0
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        step = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        bias -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-10)
    return w, float(bias)


def held_out(doc_id):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, least: float = LEAST, seed: str = "mil-1") -> Model:
    marked = labels.select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("toxic")).filter("l_id is not null and toxic in (0, 1)").filter(~held_out(F.col("l_id")))
    marked = marked.groupBy("l_id").agg(F.max("toxic").alias("toxic"))
    some = marked.withColumn("o", F.xxhash64(F.lit(seed), "l_id")).orderBy("o", "l_id").limit(sample).select("l_id", "toxic")
    picked = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("l_id")).filter("text is not null")  # ``sample`` rows
    picked = stored(picked.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "mil-sample")

    def count(batches):
        import pyarrow as pa

        def out(table):
            return pa.RecordBatch.from_arrays([pa.array(list(table), pa.binary()), *[pa.array([x[k] for x in table.values()], pa.int64()) for k in (0, 1)]], ["feature", "n0", "n1"])

        table: dict[bytes, list[int]] = {}
        for batch in sliced(batches):
            for raw, label in zip(texts(batch), batch.column(1).to_pylist(), strict=True):
                table.setdefault(b"", [0, 0])[label] += 1  # no feature: the bags themselves
                for f in features(raw):
                    table.setdefault(f, [0, 0])[label] += 1
                if len(table) > FLUSH:
                    yield out(table)
                    table = {}
        if table:
            yield out(table)

    counts = picked.select("text", "toxic").mapInArrow(count, "feature binary, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter("n0 + n1 > 1 or feature = x''")
    counts = stored(counts, "mil-counts")
    bags = counts.filter(F.col("feature") == F.lit(b"")).first()
    if bags is None or not bags["n0"] or not bags["n1"]:
        return Model({}, -30.0)
    a, b = F.col("n1") + 0.5, F.col("n0") + 0.5
    odds = F.log(a / (bags["n1"] + 1 - a)) - F.log(b / (bags["n0"] + 1 - b))
    z = F.abs(odds) / F.sqrt(1 / a + 1 / b)
    chosen = counts.filter((F.col("feature") != F.lit(b"")) & (z >= least)).select("feature")
    names = sorted(bytes(r["feature"]) for r in chosen.collect())  # from the sample's texts only
    place = {f: i for i, f in enumerate(names)}
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def bag(batches):
        import pyarrow as pa

        place = shared.value
        model = Model(dict.fromkeys(place, 0.0), 0.0)
        for batch in sliced(batches):
            found, empty = [], []
            for raw in texts(batch):
                own = [[place[f] for f in model.active(raw[a:b])] for a, b in sentences(raw)]
                found.append([s for s in own if s])
                empty.append(sum(not s for s in own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.list_(pa.int32()))), pa.array(empty, pa.int32())], ["doc_id", "toxic", "bag", "rest"])

    found = picked.select("doc_id", "text", "toxic").mapInArrow(bag, "doc_id long, toxic int, bag array<array<int>>, rest int").toArrow().sort_by("doc_id")  # ``sample`` rows
    drop_stored(counts)
    drop_stored(picked)
    w, bias = fit(found.column("bag").combine_chunks(), found.column("rest").to_numpy(), found.column("toxic").to_numpy(), len(names))
    return Model({f: float(w[i]) for f, i in place.items() if abs(w[i]) > 1e-3}, bias)


def score_documents(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, and the offending sentence: its place, byte span and score.

    ``offenders`` counts the sentences that reach the threshold on their own.
    """
    schema = "doc_id long, score double, predicted int, n_sentences int, offenders int, worst int, worst_start int, worst_end int, worst_score double"
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # from the sample only

    def kernel(batches):
        import pyarrow as pa

        model = Model(*shared.value)
        for batch in sliced(batches):
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                spans = sentences(raw)
                p = np.array([model.sentence(raw[a:b]) for a, b in spans])
                score = float(1 - np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0
                worst = int(p.argmax()) if len(p) else None
                a, b, top = (*spans[worst], float(p[worst])) if len(p) else (None, None, None)
                rows.append((doc, score, int(score >= threshold), len(p), int((p >= threshold).sum()), worst, a, b, top))
            kinds = [pa.int64(), pa.float64(), *[pa.int32()] * 6, pa.float64()]
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(kernel, schema)
