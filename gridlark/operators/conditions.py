"""Boundary rules as a table: what each channel obeys on each face of the domain.

A table has the columns of :data:`RULES`, one row for each channel and face; a face without a row is free. A target is a number
as text, or the name of a function of a node's place. Such a table is as long as the channels have faces, so it is read on
the driver, checked there, and broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mesh as M
from . import tree as T
from .boundary import ONE_SIDED_KINDS, Face, Rules, kind_class, target_at

#: face: 2 * axis + side; what is null has its default (target 0, speed 1, strength 1).
RULES = "channel string, face int, kind string, target string, speed double, strength double"


def conditions(rules: DataFrame, channels: list[str], targets: Mapping[str, Callable[..., Column]] | None = None) -> dict[str, Rules]:
    """The rules of each channel, as ghost filling and evaluation take them.

    Unknown channels, faces, kinds or targets and a second rule for a face are errors. Channels without a row have no rules.
    """
    out: dict[str, Rules] = {c: {} for c in channels}
    for r in rules.select("channel", "face", "kind", "target", "speed", "strength").collect():
        if r.channel not in out or r.face not in range(2 * T.DIMS):
            raise ValueError(f"no face {r.face} of a channel {r.channel}")
        face = (r.face // 2, r.face % 2)
        if face in out[r.channel]:
            raise ValueError(f"two rules for face {r.face} of {r.channel}")
        kind_class(r.kind)
        target = 0.0 if r.target is None else (targets or {}).get(r.target)
        out[r.channel][face] = Face(r.kind, float(r.target) if target is None else target, 1.0 if r.speed is None else r.speed, 1.0 if r.strength is None else r.strength)
    return out


def rule_table(spark: SparkSession, rules: Mapping[str, Rules]) -> DataFrame:
    """(channel, face, kind, strength): a row for every face of each channel; ``channel`` is its number."""
    faces = [(a, s) for a in range(T.DIMS) for s in (0, 1)]
    rows = [(k, 2 * a + s, own.get((a, s), Face()).kind, float(own.get((a, s), Face()).strength)) for k, own in enumerate(rules.values()) for a, s in faces]
    return spark.createDataFrame(rows, "channel int, face int, kind string, strength double")


def block_conditions(leaves: DataFrame, rules: Mapping[str, Rules]) -> DataFrame:
    """(path, channel, face, kind): a channel's own kind on faces of the domain, ``custom`` on those that leaves share."""
    names = F.array(*[F.lit(c) for c in rules])
    outer = T.boundary_faces(leaves).withColumn("__outer", F.lit(True))
    every = leaves.select("path", F.explode(F.sequence(F.lit(0), F.lit(2 * T.DIMS - 1))).alias("face")).join(outer, ["path", "face"], "left")
    x = every.join(F.broadcast(rule_table(leaves.sparkSession, rules)), "face")  # a row for each channel and face
    return x.select("path", names[F.col("channel")].alias("channel"), "face", F.when(F.col("__outer"), F.col("kind")).otherwise("custom").alias("kind"))


def face_nodes(leaves: DataFrame, width: int) -> DataFrame:
    """(path, i, j, face): the nodes on faces of the domain; where faces meet, a row for each."""
    x = T.boundary_faces(leaves).select("path", "face", F.explode(F.sequence(F.lit(0), F.lit(width))).alias("__k"))
    at = lambda axis: F.when(F.floor(F.col("face") / 2) == axis, F.col("face") % 2 * width).otherwise(F.col("__k")).cast("int")
    return x.select("path", at(0).alias("i"), at(1).alias("j"), "face")


def face_targets(leaves: DataFrame, width: int, rules: Mapping[str, Rules]) -> DataFrame:
    """(path, i, j, face, channel, kind, strength, target) of every node on a face of the domain, for each channel."""
    x = face_nodes(leaves, width).join(F.broadcast(rule_table(leaves.sparkSession, rules)), "face")  # a row for each channel and face
    place = [M.position(a, width) for a in range(T.DIMS)]
    target = F.lit(0.0)
    for k, own in enumerate(rules.values()):
        for (axis, side), rule in own.items():
            target = F.when((F.col("channel") == k) & (F.col("face") == 2 * axis + side), target_at(rule, *place)).otherwise(target)
    return x.withColumn("target", target.cast("double"))


def with_face_conditions(nodes: DataFrame, leaves: DataFrame, width: int, rules: Mapping[str, Rules], rates: Mapping[str, str] | None = None) -> DataFrame:
    """``nodes`` (path, i, j) with all channels' values and rates as their faces ask, in one join.

    A channel is its target on strong Dirichlet faces and 0 on odd ones; where several of these meet, the last face counts. Its
    rate, in the column that ``rates`` names, pulls towards the target on weak Dirichlet faces; a node where one-sided faces
    meet belongs to one of them, lower sides first. Radiative rates need neighbours: see :func:`evaluation.apply`.
    """
    rates = rates or {}
    t = face_targets(leaves, width, rules)
    wanted = []
    for k, u in enumerate(rules):
        mine = F.col("channel") == k
        value = F.when(F.col("kind") == "antisymmetric", F.lit(0.0)).otherwise(F.col("target"))
        wanted.append(F.max(F.when(mine & F.col("kind").isin("antisymmetric", "strong_dirichlet"), F.struct("face", value.alias("v")))).alias(f"__v{k}"))
        if u in rates:
            order = F.struct((F.col("face") % 2).alias("side"), "face", "kind", "strength", "target")
            wanted.append(F.min(F.when(mine & F.col("kind").isin(*ONE_SIDED_KINDS), order)).alias(f"__r{k}"))
    x = nodes.join(t.groupBy("path", "i", "j").agg(*wanted), ["path", "i", "j"], "left")
    for k, u in enumerate(rules):
        x = x.withColumn(u, F.when(F.col(f"__v{k}").isNotNull(), F.col(f"__v{k}.v")).otherwise(F.col(u)))
        if u in rates:
            own = F.col(f"__r{k}")
            x = x.withColumn(rates[u], F.when(own["kind"] == "weak_dirichlet", own["strength"] * (own["target"] - F.col(u))).otherwise(F.col(rates[u])))
    return x.select(*nodes.columns)
