"""Very long texts: no crash, no square; and surrogates over a whole table against a plain reading."""

import random
import time
from collections import defaultdict

import regex
from pyspark.sql import functions as F

from gridlark.llm import packing, pii, quality, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __pii string, h string"
#: The pattern that recursed, for short texts.
PLAIN_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, "s", len(t or ""), "x", "y") for d, t in rows], SCHEMA)


def timed(df, seconds):
    began = time.time()
    rows = df.collect()
    assert time.time() - began < seconds
    return rows


def test_addresses_are_found_as_before(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a", "b1", ".", ".", "-", "@", "@", "co", "com", " ", "x-y", "..", "9", "é"]) for _ in range(rng.randrange(1, 24))) for _ in range(12_000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
    got = df.select("t", found(pii.EMAIL).alias("new"), found(PLAIN_EMAIL).alias("old")).collect()
    assert sum(len(r.old) for r in got) > 200 and all(r.new == r.old for r in got)


LONG = {
    "dotted": "x@" + "a." * 500_000 + "com", "dotted without end": "x@" + "a." * 500_000, "labels": "x@" + "ab." * 300_000 + "c", "local": "a." * 500_000 + "@b.com", "at": "a@" * 500_000, "digits": "1" * 1_000_000, "groups": "123-" * 250_000,
    "octets": "1." * 500_000, "plus": "+1 " * 300_000, "hex": "abcdef" * 160_000, "spaces": " " * 1_000_000, "capitals": "A" * 1_000_000, "quotes": "O'" * 500_000, "titles": "Mr. " * 250_000, "equals": "token=" * 160_000,
}


def test_surrogates_of_a_megabyte(spark):
    """Long runs, a long secret, a long digest and many names, each a document, in one call."""
    rng = random.Random(5)
    secret = "".join(rng.choice("abcXYZ019_%é😀") for _ in range(1_000_000))
    digest = "aB3" * 300_000
    names = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(7)).capitalize() for _ in range(5000)})
    called = " ".join(f"Mrs {n} came." for n in names) + " Then " + " and ".join(names) + "; O'Neil's, " + "'".join(names[:3]) + "'s end. Mr O'Neil"
    texts = [*LONG.values(), f"password={secret} end", f"token={digest} end", called]
    got = {r.doc_id: r for r in timed(pii.with_surrogates(frame(spark, list(enumerate(texts))).repartition(4)), 240)}
    for i, name in enumerate(LONG):
        assert name not in ("dotted", "local") or (got[i].pii_count == 1 and got[i].text != LONG[name])
        assert name not in ("spaces", "dotted without end") or got[i].text == LONG[name]
    a, b, c = (got[len(LONG) + i] for i in range(3))
    new = a.text.removeprefix("password=").removesuffix(" end")
    assert new != secret and a.pii_count == 1 and all((x.isdigit() and y.isdigit()) or (x.isalpha() and y.isalpha()) or x == y for x, y in zip(secret, new, strict=True))
    new = b.text.removeprefix("token=").removesuffix(" end")
    assert b.pii_count == 1 and new != digest and all(x.isupper() or not y.isupper() for x, y in zip(digest, new, strict=True))
    left = set(regex.findall(r"[\p{L}'-]+", c.text))
    assert c.pii_count == 2 * len(names) + 5 and not left & set(names) and "Neil" not in c.text
    first = regex.findall(r"Mrs (\w+) came", c.text)
    assert len(set(first)) == len(names) and c.text.split(" Then ")[1].split(";")[0].split(" and ") == first


def test_quality_of_a_megabyte(spark):
    got = timed(quality.quality_rules(frame(spark, [(i, t + ".") for i, t in enumerate(LONG.values())]).repartition(4)), 60)
    assert len(got) == len(LONG)


def test_surrogates_of_a_table(spark, sf_dir):
    """Every mention of every document, by the patterns alone: one surrogate for an entity, one entity for a surrogate, none left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    entity = regex.compile(pii.ENTITY.replace("\\x22", '"'))
    person = regex.compile(pii.PERSON)
    old = {r.doc_id: r.text for r in docs.collect()}
    kind = {}
    for r in docs.select(F.explode(pii.mentions(F.col("text"))).alias("m")).distinct().select("m", pii.units(F.col("m")).alias("u")).collect():
        kind[r.m] = [(u.kind, u.name) for u in r.u]
    made, seen = defaultdict(set), 0
    for r in pii.with_surrogates(docs).collect():
        ms = entity.findall(old[r.doc_id] or "")
        if not ms:
            assert r.text == old[r.doc_id] and r.pii_count == 0
            continue
        if any(person.fullmatch(m) for m in ms):
            assert r.pii_count >= len(ms)
            continue
        pieces = entity.split(old[r.doc_id])
        shape = regex.compile("(.+?)".join(map(regex.escape, pieces)), regex.DOTALL)
        new = shape.fullmatch(r.text)
        assert new and r.pii_count == len(ms) and r.n_chars == len(r.text)
        for m, s in zip(ms, new.groups(), strict=True):
            ((k, n),) = kind[m]
            made[k, n].add(regex.sub("[^0-9]", "", s)[-len(n) :] if k in ("phone", "card", "ssn") else s.lower() if k in ("email", "hex") else s)
            seen += 1
    assert seen > 20 and all(len(s) == 1 for s in made.values())
    by = defaultdict(set)
    for (k, n), (s,) in made.items():
        by["secret" if k == "hex" else k, s].add(n)
    assert all(len(x) == 1 for x in by.values())
    real = {("secret" if k == "hex" else k, n) for us in kind.values() for k, n in us}
    assert not real & set(by)


def test_rows_that_share_an_id(spark):
    """Open entities of rows without an id, or with a common one, stay with their own text."""
    rows = [(None, f"token={i} password=****") for i in range(10)] + [(7, f"token={i} and {i}") for i in range(10)] * 2 + [(None, None), (None, "")]
    got = pii.with_surrogates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    made = defaultdict(set)
    for r in got:
        if r.text:
            made[r.text.split()[0]].add((r.doc_id, r.text))
    tokens = {t for t in made if t.startswith("token=")}
    assert len(tokens) == 10 and not tokens & {f"token={i}" for i in range(10)}
    assert all({d for d, _ in made[t]} == {None, 7} for t in tokens)


def test_token_counts_of_long_runs(spark):
    import public_tokenizers

    encoding, lengths = token_counts.load_encoding(public_tokenizers.path(token_counts.TOKENIZER))
    n = token_counts.LONG_RUN
    for blank in (" ", "\t", " \n", "　 ", "\r\n\x0b"):
        for tail in ("", "x", " x", "é", "."):
            for k in (n - 1, n, n + 1, 2 * n):
                text = "ab." + (blank * k)[:k] + tail + "  y" + " " * (n + 3)
                assert token_counts.encoded(encoding, text) == encoding.encode_ordinary(text)
    mixed = "a\n" + " " * 1_000_000 + "b\n" + "\t" * 1_000_000 + "\n" * 300_000 + " \n" * 200_000 + "c"
    rows = timed(token_counts.attributed_tokens(frame(spark, [(1, mixed)])), 60)
    assert len(rows) == mixed.count("\n") + 1 and sum(r.n_tokens for r in rows) == len(token_counts.encoded(encoding, mixed))


def test_token_counts_of_a_table(spark, sf_dir):
    """Every section of every document, token by token."""
    import public_tokenizers

    encoding, _ = token_counts.load_encoding(public_tokenizers.path(token_counts.TOKENIZER))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = defaultdict(list)
    for r in token_counts.attributed_tokens(docs).collect():
        got[r.doc_id].append((r.section, r.char_start, r.char_end, r.n_tokens, r.n_crossing, round(r.share, 6)))
    for r in docs.select("doc_id", "text").collect():
        text = r.text or ""
        char = [i for i, c in enumerate(text) for _ in c.encode()]
        ends, at, b = [], 0, 0
        for line in text.split("\n"):
            ends.append((at, at + len(line)))
            at += len(line) + 1
        line_of = [k for k, (x, y) in enumerate(ends) for _ in range(y - x + 1)]
        out = [[k, *e, 0, 0, 0.0] for k, e in enumerate(ends)]
        for token in encoding.encode_ordinary(text):
            n = len(encoding.decode_single_token_bytes(token))
            lo, hi = char[b], char[b + n - 1] + 1
            b += n
            held = {}
            for c in range(lo, hi):
                if c < ends[line_of[c]][1]:
                    held[line_of[c]] = held.get(line_of[c], 0) + 1
            owner = max(held, key=lambda k: (held[k], -k)) if held else line_of[lo]
            out[owner][3] += 1
            out[owner][5] += (hi - lo - sum(held.values())) / (hi - lo)
            for k, x in held.items():
                out[k][5] += x / (hi - lo)
                out[k][4] += x < hi - lo
        assert sorted(got[r.doc_id]) == [(*x[:5], round(x[5], 6)) for x in out]


def test_long_words(spark):
    import public_tokenizers

    encoder = packing.WordEncoder(public_tokenizers.path(packing.TOKENIZER))
    rng = random.Random(9)
    for n in (1, 2, 399, 400, 401, 3000):
        for signs in ("a", "ab", "theing", "abcdefghijklmnopqrstuvwxyz", "éaè"):
            word = "".join(rng.choice(signs) for _ in range(n))
            assert encoder.merges.queue(word.encode()) == encoder.ids(word) == encoder.encode([word.encode()])[0]
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    rows = timed(packing.pack(frame(spark, [(1, word), (2, "a" * 1_000_000)])), 120)
    assert sum(r.length for r in rows) == sum(len(encoder.ids(w)) // 4 + 1 for w in (word, "a" * 1_000_000))


def test_names_with_apostrophes_before_a_possessive(spark):
    """A name with an apostrophe inside goes where 's follows it, too; plain names and other words as before."""
    texts = ["Mr O'Neil came. O'Neil's car, O'Neil, O'Neil's; O'Nei's", "Mrs Smith's and Smith's, Smithson's", "Mr O'Neil's house is O'Neil's, not Neil's"]
    got = {r.doc_id: r for r in pii.with_surrogates(frame(spark, list(enumerate(texts)))).collect()}
    new = regex.match(r"Mr (\p{L}+) came\.", got[0].text)[1]
    assert got[0].text == f"Mr {new} came. {new}'s car, {new}, {new}'s; O'Nei's" and got[0].pii_count == 4
    smith = regex.match(r"Mrs (\p{L}+)'s", got[1].text)[1]
    assert smith != "Smith" and got[1].text == f"Mrs {smith}'s and {smith}'s, Smithson's" and got[1].pii_count == 2
    assert got[2].text == f"Mr {new}'s house is {new}'s, not Neil's" and got[2].pii_count == 2


def test_words_stay_known_when_a_table_is_full(monkeypatch):
    """A word that comes again and again is encoded once, however many others fill the tables; ids are the tokenizer's."""
    monkeypatch.setattr(packing, "CACHED_WORDS", 600)
    encoder, rng = packing.WordEncoder(packing.tokenizer_path()), random.Random(3)
    learned, learn = [], encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda new: (learned.extend(new), learn(new)))
    for _ in range(40):
        texts = ["common words, again! " + " ".join("".join(rng.choice("abcdeÉßX.'9\n") for _ in range(rng.randrange(1, 9))) for _ in range(60)) for _ in range(2)]
        assert encoder.encode([t.encode() for t in texts]) == [encoder.ids(t) for t in texts]
        assert len(encoder.table) + len(encoder.older) <= 600 + 300
    assert len(learned) > 2000 and all(learned.count(w) == 1 for w in (b"common", b"words,", b"again!"))
