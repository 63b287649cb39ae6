"""Language of documents by a convolutional network over bytes.

The UTF-8 bytes of a lower-cased text are cut into windows of ``size`` bytes, each beginning ``widest - 1`` bytes before
the end of the one before, so that every run of ``widest`` bytes is in a window; the last one is filled up with zero
bytes. A window's bytes are embedded, filters of several widths run over them, each filter's largest response
(after a rectifier) is kept, and a softmax over the languages follows. A document's probabilities are the mean of its
windows', weighted by their bytes; ``score`` is that of the language with the largest one, the first by name at a tie.

The network is trained in numpy by Adam on crops of random length, so short texts are learned too. What it learns from
is bounded: of every language ``PER_LANG`` documents at most, the first in the order of a seeded hash, and ``CROPS``
crops of ``size`` bytes from each, at places that the same hash gives. Only hashes are ranked, and each task keeps its first
ones before the shuffle, so a language that most documents have is no burden. Prediction covers all documents and whole
texts, a bounded number of windows at a time.

Only rows that are not held out are learned from, and only their text and language. Null texts and texts without a letter
are ``und`` with score 0, and so is every text if there is nothing to learn from; with one language all else is that one.
Rows are predicted one by one, so repeated rows get a row each; an empty table gives no rows. Only ``doc_id``, ``text`` and
``lang`` are read, so further columns may have any name.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_stored, sliced, stored

UNKNOWN = "und"
PER_LANG, CROPS = 1000, 4
#: Windows that are computed at once.
BLOCK = 512


@dataclass(frozen=True)
class Shape:
    size: int = 256  # bytes of a window
    embedding: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 24  # of each width
    seed: int = 1

    @property
    def stride(self) -> int:
        return self.size - max(self.widths) + 1


def windows(raw: bytes, s: Shape) -> np.ndarray:
    """The windows of a text, a row each; one of zero bytes if it is empty."""
    n = max(1, -(-(len(raw) - s.size) // s.stride) + 1)
    whole = np.frombuffer(raw + bytes((n - 1) * s.stride + s.size - len(raw)), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(whole, s.size)[:: s.stride]


def window_bytes(length: int, s: Shape) -> np.ndarray:
    """How many bytes of a text of this length are in each of its windows."""
    n = max(1, -(-(length - s.size) // s.stride) + 1)
    return np.minimum(s.size, length - s.stride * np.arange(n))


class Network:
    """Embedding, filters of several widths, max pooling over places, and a softmax."""

    def __init__(self, shape: Shape, n_out: int, parts: dict[str, np.ndarray] | None = None):
        self.shape = shape
        rng = np.random.default_rng(shape.seed)
        draw = lambda *d, scale: (rng.standard_normal(d) * scale).astype(np.float32)
        self.parts = parts or {
            "embed": draw(256, shape.embedding, scale=0.5),
            **{f"w{w}": draw(w * shape.embedding, shape.filters, scale=(2 / (w * shape.embedding)) ** 0.5) for w in shape.widths},
            **{f"b{w}": np.zeros(shape.filters, np.float32) for w in shape.widths},
            "out": draw(len(shape.widths) * shape.filters, n_out, scale=0.1),
            "bias": np.zeros(n_out, np.float32),
        }

    def runs(self, x: np.ndarray, w: int) -> np.ndarray:
        """The embedded runs of ``w`` bytes: windows, places, values."""
        e = self.parts["embed"][x]
        n, size, d = e.shape
        return np.lib.stride_tricks.as_strided(e, (n, size - w + 1, w * d), (e.strides[0], e.strides[1], e.itemsize)).reshape(-1, w * d)

    def pooled(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        out = []
        for w in self.shape.widths:
            runs = self.runs(x, w)
            z = (runs @ self.parts[f"w{w}"]).reshape(len(x), -1, self.shape.filters)
            top = z.max(axis=1) + self.parts[f"b{w}"]
            if keep is not None:
                keep.append((w, runs, z.argmax(axis=1), top))
            out.append(np.maximum(top, 0))
        return np.concatenate(out, axis=1)

    def log_odds(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.parts["out"] + self.parts["bias"]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.log_odds(self.pooled(x)).astype(np.float64))

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted mean cross entropy, and its derivatives."""
        keep: list = []
        pooled = self.pooled(x, keep)
        p = softmax(self.log_odds(pooled))
        loss = float(-(weight * np.log(np.maximum(p[np.arange(len(y)), y], 1e-12))).sum())
        d = p.copy()
        d[np.arange(len(y)), y] -= 1
        d *= weight[:, None].astype(d.dtype)
        g = {"out": pooled.T @ d, "bias": d.sum(axis=0), "embed": np.zeros_like(self.parts["embed"])}
        back = d @ self.parts["out"].T
        f, dim = self.shape.filters, self.shape.embedding
        for i, (w, runs, at, top) in enumerate(keep):
            dz = np.where(top > 0, back[:, i * f : (i + 1) * f], 0).astype(top.dtype)
            runs = runs.reshape(len(x), -1, w * dim)
            which = np.take_along_axis(runs, at[:, :, None], axis=1)  # windows, filters, values: the runs that won
            g[f"w{w}"] = np.einsum("nfv,nf->vf", which, dz)
            g[f"b{w}"] = dz.sum(axis=0)
            spread = dz[:, :, None] * self.parts[f"w{w}"].T[None]  # d loss / d value of these runs
            for k in range(w):
                byte = np.take_along_axis(x, at + k, axis=1).ravel()
                part = spread[:, :, k * dim : (k + 1) * dim].reshape(-1, dim)
                for c in range(dim):
                    g["embed"][:, c] += np.bincount(byte, part[:, c], minlength=256).astype(np.float32)
        return loss, g


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(crops: list[bytes], labels: np.ndarray, n_out: int, shape: Shape = Shape(), *, steps: int = 600, batch: int = 96, rate: float = 0.01) -> Network:
    """A network fitted to labelled crops; every language counts alike."""
    net, rng = Network(shape, n_out), np.random.default_rng(shape.seed)
    if n_out < 2:
        return net
    per = 1 / np.maximum(np.bincount(labels, minlength=n_out), 1)
    share = (per[labels] / per[labels].sum()).cumsum()
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.parts.items()}
    for t in range(1, steps + 1):
        picked = np.minimum(np.searchsorted(share, rng.random(batch)), len(crops) - 1)
        x = np.zeros((batch, shape.size), np.uint8)
        for i, k in enumerate(picked.tolist()):
            raw = crops[k]
            n = min(len(raw), int(shape.size ** rng.random() * 8) if i % 2 else shape.size)
            at = int(rng.integers(0, len(raw) - n + 1))
            x[i, :n] = np.frombuffer(raw[at : at + n], np.uint8)
        _, g = net.gradient(x, labels[picked], np.full(batch, 1 / batch, np.float32))
        step = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        for k, (m, v) in moments.items():
            m += 0.1 * (g[k] - m)
            v += 0.01 * (g[k] ** 2 - v)
            net.parts[k] -= (step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return net


def held_out(doc_id):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


HAS_LETTER = r"\p{L}"


def sample(docs: DataFrame, *, per_lang: int = PER_LANG, crops: int = CROPS, shape: Shape = Shape(), seed: str = "cnn-1") -> tuple[list[str], list[bytes], np.ndarray]:
    """Languages, crops of their documents, and each crop's language: ``per_lang * crops`` crops a language at most."""
    own = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(HAS_LETTER)).filter(~held_out(F.col("doc_id")))
    own = own.select("lang", F.xxhash64(F.lit(seed), "doc_id", "text").alias("o"), "text")
    # only hashes are ranked, so a language's task never sees texts; rows with one hash are repeated rows
    ranked = own.select("lang", "o").withColumn("r", F.dense_rank().over(W.partitionBy("lang").orderBy("o"))).filter(F.col("r") <= per_lang)
    last = ranked.groupBy(F.col("lang").alias("l_lang")).agg(F.max("o").alias("l_o"))  # a row for each language
    first = own.join(last, (F.col("lang") == F.col("l_lang")) & (F.col("o") <= F.col("l_o"))).groupBy("lang", "o").agg(F.min("text").alias("text"))

    def cut(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            langs, pieces, order = [], [], []
            for lang, o, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = text.lower().encode()
                for k in range(crops):
                    at = zlib.crc32(b"%d:%d" % (o, k)) % max(1, len(raw) - shape.size + 1)
                    langs.append(lang)
                    pieces.append(raw[at : at + shape.size])
                    order.append(o)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(pieces, pa.binary()), pa.array(order, pa.int64())], ["lang", "crop", "o"])

    cuts = stored(first.select("lang", "o", "text").mapInArrow(cut, "lang string, crop binary, o long"), "cnn-crops", narrow=True)
    rows = sorted((r["lang"], r["o"], bytes(r["crop"])) for r in cuts.collect())
    drop_stored(cuts)
    names = sorted({r[0] for r in rows})
    place = {name: i for i, name in enumerate(names)}
    return names, [r[2] for r in rows], np.array([place[r[0]] for r in rows], np.int64)


def learn(docs: DataFrame, *, shape: Shape = Shape(), **how) -> tuple[list[str], Network]:
    names, crops, labels = sample(docs, shape=shape, **how)
    return names, train(crops, labels, len(names), shape)


def predict(docs: DataFrame, names: list[str], net: Network) -> DataFrame:
    """doc_id, held_out, lang_pred, score and n_windows of every document."""
    schema = "doc_id long, lang_pred string, score double, n_windows long"
    shape, shared = net.shape, docs.sparkSession.sparkContext.broadcast(net.parts)  # a few thousand numbers

    def kernel(batches):
        import pyarrow as pa

        net = Network(shape, len(names), shared.value)
        for batch in sliced(batches):
            raws = [t.lower().encode() if ok else None for t, ok in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            known = [i for i, raw in enumerate(raws) if raw is not None and names]
            mean, n_windows = np.zeros((len(raws), max(1, len(names)))), [0] * len(raws)
            queue, owner, weight, held = [], [], [], 0

            def flush():
                p = net.probabilities(np.concatenate(queue))  # noqa: B023
                np.add.at(mean, np.concatenate(owner), p * np.concatenate(weight)[:, None])  # noqa: B023

            for i in known:
                cut, share = windows(raws[i], shape), window_bytes(len(raws[i]), shape)
                n_windows[i] = len(cut)
                for at in range(0, len(cut), BLOCK):
                    part = cut[at : at + BLOCK]
                    queue.append(part)
                    owner.append(np.full(len(part), i))
                    weight.append(share[at : at + BLOCK] / share.sum())
                    held += len(part)
                    if held >= BLOCK:
                        flush()
                        queue, owner, weight, held = [], [], [], 0
            if held:
                flush()
            best = mean.argmax(axis=1)
            lang = [UNKNOWN] * len(raws)
            for i in known:
                lang[i] = names[best[i]]
            score = np.minimum(mean[np.arange(len(raws)), best], 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n_windows, pa.int64())], [c.split()[0] for c in schema.split(", ")])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(HAS_LETTER), F.lit(False)).alias("letters")).mapInArrow(kernel, schema)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_windows")


def predict_languages(docs: DataFrame, **how) -> DataFrame:
    """Learns from the documents' own labels, and predicts the language of all of them."""
    names, net = learn(docs, **how)
    return predict(docs, names, net)
