"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

A source's target is its share by weight of ``budget`` times all sizes, clamped at ``max_epochs`` times
its own size; what is cut off is reshared by weight among the sources below their clamp until none is
above. With sources in order of clamp / weight this ends at one water level, found here with two running
sums over the (few) sources.

A target of ``e`` epochs takes every document ``floor(e)`` times whole. The rest is a fractional
repetition: documents in the order of a seeded hash are taken once more until the rest is used up, the
last one in part. No window runs over a whole source: sums by (source, hash bucket) show the bucket in
which the rest ends, only that bucket is put in order, and the result is one cut ``(hash, doc_id)`` for
each source.

Null text has size 0; a null source is a source of its own, in last place; sources of size 0 have target
0. Rows that repeat a ``doc_id`` share one place in the order and, at the cut, the remainder in
proportion to their sizes. Empty input gives no rows. Only ``doc_id``, ``text`` and ``source`` are read,
so further columns do not clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, words

WEIGHTS = (5, 2, 1)
BUDGET, MAX_EPOCHS, SEED = 1.5, 2.0, "mix-1"


def n_words(text):
    """The count of words; 0 if the text is null."""
    return F.size(words(text)).cast("long")


def order_key(doc_id, seed: str):
    return F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("?"))))


def targets(totals: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``totals`` (source, source_size) with weight, target, whole and rest; one row for each source."""
    ranked = totals.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = ranked.withColumn("weight", weight).withColumn("clamp", max_epochs * F.col("source_size"))
    x = x.withColumn("budget", budget * F.sum("source_size").over(everything))
    order = W.orderBy(F.col("clamp") / F.col("weight"), "rank")
    filled = F.coalesce(F.sum("clamp").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    x = x.withColumn("level", (F.col("budget") - filled) / open_weight)
    # the level of the first source that stays below its clamp; none if all are clamped
    first = F.min(F.when(F.col("clamp") > F.col("level") * F.col("weight"), F.struct((F.col("clamp") / F.col("weight")).alias("ratio"), "rank", "level"))).over(everything)
    x = x.withColumn("target", F.when(first.isNull(), F.col("clamp")).otherwise(F.least(F.col("clamp"), first["level"] * F.col("weight"))))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    x = x.withColumn("whole", whole)
    return x.select("source", "source_size", "weight", "target", "whole", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("long").alias("rest"))


def plan(sized: DataFrame, *, weights=WEIGHTS, budget=BUDGET, max_epochs=MAX_EPOCHS, digits: int = 3) -> DataFrame:
    """For each source its target and its cut; ``sized`` has doc_id, source, size and the hash ``h``.

    digits: hex digits of the hash that make a bucket (16 ** digits buckets for each source).
    """
    totals = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, max_epochs), "mix-targets")
    bucketed = sized.withColumn("b", F.substring("h", 1, digits))
    sums = bucketed.groupBy("source", "b").agg(F.sum("size").alias("s"))
    before = F.sum("s").over(W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("s")
    t = totals.select(F.col("source").alias("t_source"), "rest")
    cut = (
        sums.withColumn("before", before)
        .join(t, F.col("source").eqNullSafe(F.col("t_source")))
        .filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("s")))
        .select(F.col("source").alias("c_source"), F.col("b").alias("c_b"), (F.col("rest") - F.col("before")).alias("left"))
    )
    keys = (
        bucketed.join(cut, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("b") == F.col("c_b")))
        .groupBy("source", "h", "doc_id", "left")
        .agg(F.sum("size").alias("s"))
    )
    upto = F.sum("s").over(W.partitionBy("source").orderBy("h", F.col("doc_id").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow))
    found = (
        keys.withColumn("before", upto - F.col("s"))
        .filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("s")))
        .select(F.col("source").alias("c_source"), F.col("h").alias("cut_h"), F.col("s").alias("cut_size"), (F.col("left") - F.col("before")).alias("cut_left"))
    )
    return stored(
        totals.join(found, F.col("source").eqNullSafe(F.col("c_source")), "left").select(*[F.col(c).alias(f"m_{c}") for c in ("source", "source_size", "target", "whole", "rest")], "cut_h", "cut_size", "cut_left"),
        "mix-plan",
    )


def taken(sized: DataFrame, mix: DataFrame) -> DataFrame:
    """``sized`` with the columns of its source's plan and ``taken``, the words that the mix takes."""
    x = sized.join(mix, F.col("source").eqNullSafe(F.col("m_source")))
    # without a cut, the rest is nothing or everything
    once_more = (
        F.when(F.col("cut_h").isNull(), F.when(F.col("m_rest") > 0, F.col("size")).otherwise(F.lit(0)))
        .when(F.col("h") < F.col("cut_h"), F.col("size"))
        .when(F.col("h") == F.col("cut_h"), F.floor(F.col("cut_left") * F.col("size") / F.col("cut_size")))
        .otherwise(F.lit(0))
    )
    return x.withColumn("taken", (F.col("m_whole") * F.col("size") + once_more).cast("long"))


def sized_table(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The narrow table that the plan works on, made in one pass over the texts."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), order_key(F.col("doc_id"), seed).alias("h"))


def mix_sources(docs: DataFrame, *, weights=WEIGHTS, budget=BUDGET, max_epochs=MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document."""
    sized = stored(sized_table(docs, seed), "mix-sized")
    mix = plan(sized, weights=weights, budget=budget, max_epochs=max_epochs)
    return taken(sized, mix).select("doc_id", "source", "size", F.col("m_source_size").alias("source_size"), F.col("m_target").alias("target"), "taken")


def mixed_documents(docs: DataFrame, *, weights=WEIGHTS, budget=BUDGET, max_epochs=MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken, the last copy at a cut in part.

    Columns are those of ``docs``; a part is its first words, joined by spaces, and has its own
    ``n_chars`` if there is such a column. Documents without words are kept once.
    """
    columns = docs.columns
    sized = stored(sized_table(docs, seed), "mix-sized")
    mix = plan(sized, weights=weights, budget=budget, max_epochs=max_epochs)
    own = docs.select(F.struct(*columns).alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"), order_key(F.col("doc_id"), seed).alias("h"))
    x = taken(own, mix)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.ceil(F.col("taken") / F.col("size"))).cast("int")
    x = x.filter(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    part = F.when(F.col("size") > 0, F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    text = F.when(part < F.col("size"), first_words(F.col("row.text"), part)).otherwise(F.col("row.text"))
    x = x.withColumn("new_text", text)
    out = {"text": F.col("new_text"), "n_chars": F.when(part < F.col("size"), F.length("new_text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in columns else None}
    return x.select(*[out[c].alias(c) if out.get(c) is not None else F.col("row")[c].alias(c) for c in columns])


def first_words(text, count):
    """The text up to the end of its ``count``-th word."""
    return F.array_join(F.slice(words(text), 1, F.greatest(count, F.lit(0)).cast("int")), " ")
