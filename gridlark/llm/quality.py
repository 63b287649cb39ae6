"""Line-first quality rules, in DataFrame functions only.

Each line with a word is judged by itself and removed if a rule fails:

* punctuation: five words or more without any end mark, or more than 3 symbols ``#*$%&|<>`` in 10 words,
  or an ``!!`` for every third word;
* navigation: separators ``|`` for every fifth word at least;
* boilerplate: a phrase of licences, cookie notices, sign-ups and page scaffolding.

A document is then rejected if the lines removed held more than ``max_loss`` percent of its text (counted
in characters of words), or if it fails the base rule: fewer than 50 words, or more than half of the words
in repeated 3-word windows.

Null and empty texts have no words and fail the base rule; an empty table gives no rows. Rows are independent, so repeated rows, ties
and further columns of the input do not matter. Texts are judged whole, in time that grows as
``n log n`` with the words of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, words

MAX_LOSS = 30
SYMBOLS = r"[#*$%&|<>]"
END_MARKS = "[.!?…]"
BOILERPLATE = (
    r"(?i)all rights reserved|licen[sc]ed under|under the .{0,40}licen[sc]e|permission is hereby granted|copyright (?:\(c\)|©|[0-9])"
    r"|accept (?:all )?cookies|uses cookies|cookie policy|privacy policy|terms of (?:use|service)|enable javascript"
    r"|click here|sign up|log in to|subscribe to|skip to (?:main )?content|lorem ipsum"
)


def size_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def repeated_window_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more, each counted once.

    Only if some window's hash repeats are the windows sorted; neighbours must then be equal word by word.
    """

    def exact(h: Column) -> Column:
        at = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def same(a: Column, b: Column) -> Column:
            i, j = a["i"], b["i"]
            return F.coalesce((a["h"] == b["h"]) & (w[i] == w[j]) & (w[i + 1] == w[j + 1]) & (w[i + 2] == w[j + 2]), F.lit(False))

        def covered(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
            places = F.sort_array(F.transform(twice, lambda x: x["i"]))
            start = F.struct(F.lit(-9).alias("last"), F.lit(0).alias("n"))
            step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"))
            return F.aggregate(places, start, step, lambda acc: acc["n"])

        return let(at, covered)

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(h))))


def line_fails(line: Column) -> Column:
    """Whether a line, which has a word, fails a rule."""
    n = F.size(words(line))
    marks = F.length(line) - size_without(line, SYMBOLS)
    bangs = (F.length(line) - size_without(line, "!!")) / 2
    bars = F.length(line) - size_without(line, r"\|")
    punctuation = ((n >= 5) & ~line.rlike(END_MARKS)) | ((marks >= 3) & (10 * marks > 3 * n)) | ((n >= 3) & (3 * bangs >= n))
    navigation = (bars >= 2) & (5 * bars >= n)
    return punctuation | navigation | line.rlike(BOILERPLATE)


def judged(docs: DataFrame, *, max_loss: int = MAX_LOSS) -> DataFrame:
    """``docs`` with ``__quality``, a struct of the counts, ``cleaned`` (the text left) and ``kept``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), x.rlike(r"[^\x20\x09-\x0D]").alias("has")))

    def facts(x: Column) -> Column:
        fails = F.when(x["has"], line_fails(x["line"])).otherwise(F.lit(False))
        return F.struct(x["line"].alias("line"), x["has"].alias("has"), fails.alias("fails"), size_without(x["line"], SPACE).alias("chars"))

    def of_lines(ls: Column) -> Column:
        own = F.transform(F.filter(ls, lambda x: x["has"]), lambda x: x["line"])
        lost = F.aggregate(F.filter(ls, lambda x: x["fails"]), F.lit(0), lambda a, x: a + x["chars"])
        total = F.aggregate(ls, F.lit(0), lambda a, x: a + x["chars"])
        left = F.array_join(F.transform(F.filter(ls, lambda x: ~x["fails"]), lambda x: x["line"]), "\n")
        return F.struct(
            total.cast("long").alias("word_chars"),
            let(own, lambda o: F.size(o) - F.size(F.array_distinct(o))).cast("long").alias("n_dup_lines"),
            F.size(own).cast("long").alias("n_lines"),
            F.size(F.filter(ls, lambda x: x["fails"])).cast("long").alias("n_failed_lines"),
            lost.cast("long").alias("lost_chars"),
            left.alias("cleaned"),
        )

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_window_words(w).cast("long").alias("n_repeat_words"))

    symbols = (F.length(text) - size_without(text, SYMBOLS)).cast("long")
    w, ls = let(words(F.col("text")), of_words), let(F.transform(lines, facts), of_lines)
    parts = F.struct(w.alias("w"), ls.alias("l"))

    def verdict(p: Column) -> Column:
        n, r = p["w"]["n_words"], p["w"]["n_repeat_words"]
        base = (n < 50) | (100 * r > 50 * n)
        kept = ~base & (100 * p["l"]["lost_chars"] <= max_loss * p["l"]["word_chars"])
        inner = [p["l"][c].alias(c) for c in ("word_chars", "n_dup_lines", "n_lines", "n_failed_lines", "lost_chars", "cleaned")]
        return F.struct(n.alias("n_words"), r.alias("n_repeat_words"), symbols.alias("n_symbols"), *inner, base.alias("base_failed"), kept.alias("kept"))

    return docs.withColumn("__quality", let(parts, verdict))


def quality_rules(docs: DataFrame, *, max_loss: int = MAX_LOSS) -> DataFrame:
    """A row for each document: its counts and the verdict."""
    q = judged(docs.select("doc_id", "text"), max_loss=max_loss)
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "lost_chars")
    return q.select("doc_id", *[F.col("__quality")[c].alias(c) for c in columns])


def cleaned_documents(docs: DataFrame, *, max_loss: int = MAX_LOSS) -> DataFrame:
    """The documents kept, without the lines that fail; ``n_chars``, if there, counts the text left."""
    out = judged(docs, max_loss=max_loss).filter("__quality.kept")
    text = F.when(F.col("__quality.n_failed_lines") > 0, F.col("__quality.cleaned")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.when(F.col("__quality.n_failed_lines") > 0, F.length("__quality.cleaned").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[new[c].alias(c) if new.get(c) is not None else F.col(c) for c in docs.columns])


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o) AS g, lead(word, 2) OVER o IS NOT NULL AS whole FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) > 1 AS twice FROM g WHERE whole),
c AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r WHERE twice) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
k AS (SELECT doc_id, line, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n,
  length(line) - length(regexp_replace(line, '{SYMBOLS}', '', 'g')) AS marks, (length(line) - length(replace(line, '!!', ''))) / 2 AS bangs,
  length(line) - length(replace(line, '|', '')) AS bars, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT *, (n >= 5 AND NOT regexp_matches(line, '{END_MARKS}')) OR (marks >= 3 AND 10 * marks > 3 * n) OR (n >= 3 AND 3 * bangs >= n)
  OR (bars >= 2 AND 5 * bars >= n) OR regexp_matches(line, '{BOILERPLATE}') AS fails FROM k),
s AS (SELECT doc_id, CAST(sum(chars) AS BIGINT) AS word_chars, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) AS n_lines,
  count(*) FILTER (fails) AS n_failed_lines, CAST(coalesce(sum(chars) FILTER (fails), 0) AS BIGINT) AS lost_chars FROM f GROUP BY doc_id),
a AS (SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(s.word_chars, 0) AS word_chars, CAST(length(d.text) - length(regexp_replace(d.text, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(lost_chars, 0) AS lost_chars
  FROM d JOIN w USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= {MAX_LOSS} * word_chars AS kept, n_lines, n_failed_lines, lost_chars
FROM a
"""
