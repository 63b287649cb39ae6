"""The byte network against plain loops, its derivatives, held-out accuracy and edge cases."""

import zlib

import numpy as np
import pytest

from gridlark.llm import byte_cnn

SCHEMA = "doc_id long, text string, lang string, source string, score string, o long, letters string"
SMALL = byte_cnn.Shape(size=16, embedding=3, widths=(2, 3), filters=5)


def plain_probabilities(net, window):
    s, out = net.shape, []
    for w in s.widths:
        best = [-np.inf] * s.filters
        for t in range(s.size - w + 1):
            run = np.concatenate([net.parts["embed"][window[t + k]] for k in range(w)]).astype(float)
            for f in range(s.filters):
                best[f] = max(best[f], float(run @ net.parts[f"w{w}"][:, f]) + float(net.parts[f"b{w}"][f]))
        out += [max(0.0, b) for b in best]
    z = np.array(out) @ net.parts["out"].astype(float) + net.parts["bias"]
    return np.exp(z - z.max()) / np.exp(z - z.max()).sum()


def test_forward_is_the_plain_one():
    net = byte_cnn.Network(SMALL, 3)
    x = np.random.default_rng(1).integers(0, 256, (7, 16)).astype(np.uint8)
    assert np.allclose(net.probabilities(x), [plain_probabilities(net, row) for row in x], atol=1e-5)


def test_derivatives():
    net = byte_cnn.Network(SMALL, 3)
    net.parts = {k: v.astype(np.float64) for k, v in net.parts.items()}
    rng = np.random.default_rng(2)
    x, y, weight = rng.integers(0, 256, (6, 16)).astype(np.uint8), rng.integers(0, 3, 6), rng.random(6)
    _, g = net.gradient(x, y, weight)
    for name, part in net.parts.items():
        places = [tuple(rng.integers(0, n) for n in part.shape) for _ in range(12)] if name != "embed" else [(int(b), int(rng.integers(0, 3))) for b in x[0]]
        for at in places:
            old, values = part[at], []
            for d in (1e-6, -1e-6):
                part[at] = old + d
                values.append(net.gradient(x, y, weight)[0])
            part[at] = old
            assert g[name][at] == pytest.approx((values[0] - values[1]) / 2e-6, abs=1e-5), name


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 29, 30, 31, 500])
def test_windows_cover_every_run(n):
    raw = bytes(np.random.default_rng(n).integers(1, 256, n).astype(np.uint8))
    cut, share = byte_cnn.windows(raw, SMALL), byte_cnn.window_bytes(n, SMALL)
    assert len(cut) == len(share) and b"".join(w.tobytes()[: len(w) if i + 1 == len(cut) else SMALL.stride] for i, w in enumerate(cut)).rstrip(b"\0") == raw
    found = {w.tobytes()[i : i + 3] for w in cut for i in range(14)}
    assert all(raw[i : i + 3] in found for i in range(n - 2))
    assert [int((w > 0).sum()) for w in cut] == share.tolist()


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return byte_cnn.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_held_out_accuracy(spark, sf_dir, model):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = byte_cnn.predict(docs, *model).collect()
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    own = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in own) >= 0.95 * len(own) > 0


def test_documents_are_the_mean_of_plain_windows(spark, model):
    names, net = model
    text = "Ça va bien, et vous? The end of it. " * 40
    (got,) = byte_cnn.predict(spark.createDataFrame([(1, text, None, "s", "x", 1, "l")], SCHEMA), names, net).collect()
    raw = text.lower().encode()
    cut, share = byte_cnn.windows(raw, net.shape), byte_cnn.window_bytes(len(raw), net.shape)
    p = sum(n * net.probabilities(w[None])[0] for w, n in zip(cut, share, strict=True)) / share.sum()
    assert got.lang_pred == names[p.argmax()] and got.score == pytest.approx(p.max(), abs=1e-5) and got.n_windows == len(cut)


def test_edges(spark, model):
    long = "Der Hund und die Katze gehen in das Haus. " * 30_000  # 1.2 MB
    rows = [(1, None), (2, ""), (3, "12 34 -- !!"), (4, "日本語"), (5, "a"), (6, long), (6, long), (None, "the cat"), (7, "\u0000" * 300 + "x")]
    df = spark.createDataFrame([(d, t, None, "s", "x", 1, "l") for d, t in rows], SCHEMA)
    got = byte_cnn.predict(df, *model).collect()
    assert len(got) == len(rows) and {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 3)} == dict.fromkeys((1, 2, 3), ("und", 0.0))
    assert all(r.lang_pred in model[0] for r in got if r.doc_id not in (1, 2, 3))
    assert byte_cnn.predict(df.limit(0), *model).collect() == []
    # nothing to learn from, and one language only
    assert {r.lang_pred for r in byte_cnn.predict_languages(df).collect()} == {"und"}
    one = spark.createDataFrame([(d, t, "xx", "s", "x", 1, "l") for d, t in rows], SCHEMA)
    assert {(r.lang_pred, r.score) for r in byte_cnn.predict_languages(one).collect()} == {("und", 0.0), ("xx", 1.0)}


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = [(i, f"word{i} text", "aa" if zlib.crc32(str(i).encode()) % 3 != 1 else "zz", "s", "x", 1, "l") for i in range(60)]
    names, crops, labels = byte_cnn.sample(spark.createDataFrame(rows, SCHEMA), per_lang=5, crops=2)
    assert names == ["aa"] and len(crops) == 10 and set(labels.tolist()) == {0}
