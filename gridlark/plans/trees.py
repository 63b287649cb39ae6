"""Queries on boxes, halves, directions, index spaces and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import tree as T
from .nodes import SQL, points

QUERIES: dict = {}
ORACLE_SQL: dict = {}
DEEP, MOST = 5, 40


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


@query("SELECT CAST(s AS INTEGER) AS split, s % 2 = 1 AS b0, s // 2 % 2 = 1 AS b1, s // 4 % 2 = 1 AS b2, CAST(s | 2 AS INTEGER) AS set1, CAST(xor(s, 1) AS INTEGER) AS toggle0, CAST(s & ~4 AS INTEGER) AS clear2 FROM (SELECT unnest(range(0, 8)) AS s)")
def split_bits(spark, sf_dir):
    s = F.col("split")
    return G.splits(spark, 3).select("split", *[b.alias(f"b{a}") for a, b in enumerate(G.unpack(s, 3))], G.set_bit(s, 1).alias("set1"), G.toggle_bit(s, 0).alias("toggle0"), G.clear_bit(s, 2).alias("clear2"))


@query("SELECT CAST(r AS INTEGER) AS region, CAST(r % 3 AS INTEGER) AS s0, CAST(r // 3 % 3 AS INTEGER) AS s1, CAST(8 - r AS INTEGER) AS reversed, CAST((r % 3 <> 1)::INT + (r // 3 % 3 <> 1)::INT AS INTEGER) AS adjacency FROM (SELECT unnest(range(0, 9)) AS r)")
def region_table(spark, sf_dir):
    r = F.col("region")
    return G.regions(spark, 2).select("region", G.side(r, 0).alias("s0"), G.side(r, 1).alias("s1"), G.reverse_region(r, 2).cast("int").alias("reversed"), G.adjacency(r, 2).alias("adjacency"))


@query("SELECT CAST(f AS INTEGER) AS face, CAST(f // 2 AS INTEGER) AS axis, CAST(xor(f, 1) AS INTEGER) AS reversed, CAST([3, 5, 1, 7][f + 1] AS INTEGER) AS region FROM (SELECT unnest(range(0, 4)) AS f)")
def face_table(spark, sf_dir):
    f = F.col("face")
    return G.faces(spark, 2).select("face", G.face_axis(f).alias("axis"), G.face_reversed(f).cast("int").alias("reversed"), G.region_of_face(f, 2).cast("int").alias("region"))


@query("""SELECT CAST(s AS INTEGER) AS split, CAST(r AS INTEGER) AS region,
(r % 3 = 1 OR (r % 3 = 2) <> (s % 2 = 1)) AND (r // 3 = 1 OR (r // 3 = 2) <> (s // 2 = 1)) AS inner_step, (r % 3 = 1 OR (r % 3 = 2) = (s % 2 = 1)) AND (r // 3 = 1 OR (r // 3 = 2) = (s // 2 = 1)) AS touches,
CAST(CASE r % 3 WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE s % 2 END + 2 * CASE r // 3 WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE s // 2 END AS INTEGER) AS outer_half,
CAST(CASE r % 3 WHEN 0 THEN 1 WHEN 2 THEN 0 ELSE s % 2 END + 2 * CASE r // 3 WHEN 0 THEN 1 WHEN 2 THEN 0 ELSE s // 2 END AS INTEGER) AS inner_half
FROM (SELECT unnest(range(0, 4)) AS s), (SELECT unnest(range(0, 9)) AS r)""")
def split_regions(spark, sf_dir):
    s, r = F.col("split"), F.col("region")
    x = G.splits(spark, 2).join(G.regions(spark, 2), F.lit(True))
    return x.select(s, r, G.is_inner_region(s, r, 2).alias("inner_step"), G.split_touches_region(s, r, 2).alias("touches"), G.as_outer_region(s, r, 2).cast("int").alias("outer_half"), G.as_inner_region(s, r, 2).cast("int").alias("inner_half"))


@query("SELECT CAST(r AS INTEGER) AS region FROM (SELECT unnest(range(0, 9)) AS r) WHERE r % 3 IN (0, 1) AND r // 3 IN (1, 2)")
def mask_regions(spark, sf_dir):
    return G.regions_of_mask(spark, 0b1001, 2)


@query("SELECT CAST(f AS INTEGER) AS face, CAST(s AS INTEGER) AS split, (f // 2 = 0 AND s % 2 = f % 2) OR (f // 2 = 1 AND s // 2 = f % 2) AS touches FROM (SELECT unnest(range(0, 4)) AS f), (SELECT unnest(range(0, 4)) AS s)")
def face_splits(spark, sf_dir):
    x = G.faces(spark, 2).join(G.splits(spark, 2), F.lit(True))  # four rows each
    return x.select("face", "split", G.split_touches_face(F.col("split"), F.col("face"), 2).alias("touches"))


@query("SELECT CAST(r AS INTEGER) AS region, CAST(f AS INTEGER) AS face FROM (SELECT unnest(range(0, 9)) AS r), (SELECT unnest(range(0, 4)) AS f) WHERE CASE f WHEN 0 THEN r % 3 = 0 WHEN 1 THEN r % 3 = 2 WHEN 2 THEN r // 3 = 0 ELSE r // 3 = 2 END")
def region_faces(spark, sf_dir):
    return G.regions(spark, 2).select("region", F.explode(G.faces_of_region(F.col("region"), 2)).alias("face"))


@query("SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(CASE WHEN i = 0 THEN 0 WHEN j = 0 THEN 2 WHEN i = 6 THEN 1 WHEN j = 4 THEN 3 END AS INTEGER) AS face FROM (SELECT unnest(range(0, 7)) AS i), (SELECT unnest(range(0, 5)) AS j)")
def owning_faces(spark, sf_dir):
    """Every border node belongs to one face."""
    return G.index_space(spark, [7, 5], ["i", "j"]).select("i", "j", G.owning_face([F.col("i"), F.col("j")], [6, 4]).alias("face"))


@query("SELECT CAST(n AS BIGINT) AS linear, CAST(n % 7 AS INTEGER) AS i, CAST(n // 7 % 5 AS INTEGER) AS j, CAST(n // 35 AS INTEGER) AS k FROM (SELECT unnest(range(0, 105)) AS n)")
def index_decompose(spark, sf_dir):
    return G.index_space(spark, [7, 5, 3], ["i", "j", "k"])


@query("SELECT CAST(n AS BIGINT) AS linear, CAST(n % 7 AS INTEGER) AS i, CAST(n // 7 AS INTEGER) AS j, CAST(n AS BIGINT) AS back FROM (SELECT unnest(range(0, 35)) AS n) WHERE n % 7 = 6 AND n // 7 = 0")
def index_border(spark, sf_dir):
    """The corner that faces upper x and lower y, and the way back to a linear index."""
    x = G.border_window(G.index_space(spark, [7, 5], ["i", "j"]), ["i", "j"], [7, 5], F.lit(2))
    return x.withColumn("back", G.linear([F.col("i"), F.col("j")], [7, 5]).cast("long"))


_BOX = "SELECT p_partkey, x, y, CAST(p_partkey % 4 AS INTEGER) AS split FROM (" + SQL["points"] + ")"


@query(f"""SELECT p_partkey, greatest(x - 0.25e0, 0e0) AS sx, greatest(y - 0.5e0, 0e0) AS sy, x / 2 AS cx, x BETWEEN 0.25 AND 0.75 AND y BETWEEN 0.5 AND 1 AS inside, 0.25e0 + 0.5e0 * x AS gx, (y - 0.5e0) / 0.5e0 AS ly,
CASE WHEN split % 2 = 1 THEN 0.25e0 + 0.25e0 ELSE 0.25e0 END AS kx, CASE WHEN split // 2 = 1 THEN 0.5e0 + 0.25e0 ELSE 0.5e0 END AS ky FROM ({_BOX})""")
def boxes(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    o, s = [F.lit(0.25), F.lit(0.5)], [F.lit(0.5), F.lit(0.5)]
    kids, _ = G.subdivide(o, s, (F.col("p_partkey") % 4).cast("int"))
    _, size = G.box_from_corners(o, [x, y])
    return points(spark, sf_dir).select(
        "p_partkey", size[0].alias("sx"), size[1].alias("sy"), G.center([F.lit(0.0)], [x])[0].alias("cx"), G.contains(o, s, [x, y]).alias("inside"),
        G.local_to_global(o, s, [x, y])[0].alias("gx"), G.global_to_local(o, s, [x, y])[1].alias("ly"), kids[0].alias("kx"), kids[1].alias("ky"),
    )


def sql_path(x: str, y: str, level: str) -> str:
    return f"array_to_string(list_transform(range(0, {level}), lambda l: CAST(({x} // CAST(power(2, {level} - 1 - l) AS BIGINT)) % 2 + 2 * (({y} // CAST(power(2, {level} - 1 - l) AS BIGINT)) % 2) AS INTEGER)), '')"


def sql_cell(v: str) -> str:
    return f"CAST(greatest(least(ceil({v} * {1 << DEEP}e0) - 1, {(1 << DEEP) - 1}), 0) AS BIGINT)"


_PATHS = f"SELECT p_partkey, {sql_path('a', 'b', str(DEEP))} AS path FROM (SELECT p_partkey, {sql_cell('(x * x)')} AS a, {sql_cell('(y * y)')} AS b FROM ({SQL['points']}))"
_LEAVES = f"""p AS ({_PATHS}), n AS (SELECT substr(path, 1, l) AS z, count(*) AS c FROM p, (SELECT unnest(range(0, {DEEP + 1})) AS l) GROUP BY 1),
s AS (SELECT z FROM n WHERE c > {MOST} AND length(z) < {DEEP}), kids AS (SELECT z || d AS z FROM s, (SELECT unnest(['0', '1', '2', '3']) AS d) UNION SELECT ''),
leaves AS (SELECT z AS path, length(z) AS level FROM kids WHERE z NOT IN (SELECT z FROM s)),
xy AS (SELECT path, level, list_reduce(list_prepend(0, list_transform(string_split(path, ''), lambda d: CAST(d AS INTEGER) % 2)), lambda a, b: 2 * a + b) AS cx,
  list_reduce(list_prepend(0, list_transform(string_split(path, ''), lambda d: CAST(d AS INTEGER) // 2)), lambda a, b: 2 * a + b) AS cy FROM leaves)"""


def paths(spark, sf_dir):
    """Squared coordinates, so that points crowd near the origin and the tree is uneven."""
    p = points(spark, sf_dir)
    return p.select("p_partkey", T.path_of([T.lattice(F.col(c) * F.col(c), DEEP) for c in ("x", "y")], DEEP).alias("path"))


def leaves(spark, sf_dir):
    return T.leaves_of_points(paths(spark, sf_dir), DEEP, MOST)


@query(_PATHS)
def morton_cells(spark, sf_dir):
    return paths(spark, sf_dir)


@query(f"WITH {_LEAVES} SELECT path, CAST(level AS INTEGER) AS level, cx / power(2e0, level) AS x0, (cx + 1) / power(2e0, level) AS x1, cy / power(2e0, level) AS y0, (cy + 1) / power(2e0, level) AS y1 FROM xy")
def tree_leaves(spark, sf_dir):
    (x0, x1), (y0, y1) = T.bounds_of(F.col("path"))
    return leaves(spark, sf_dir).select("path", T.level_of(F.col("path")).alias("level"), x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))


@query(f"""WITH {_LEAVES} SELECT substr(path, 1, k) AS path, CAST(k AS INTEGER) AS level, CASE WHEN k > 0 THEN substr(path, 1, k - 1) END AS parent, bool_or(k = level) AS leaf, count(*) AS n_leaves
FROM (SELECT path, level, unnest(range(0, level + 1)) AS k FROM leaves) GROUP BY 1, 2, 3""")
def tree_nodes(spark, sf_dir):
    return T.nodes_of(leaves(spark, sf_dir))


@query(f"WITH {_LEAVES} SELECT path, row_number() OVER (ORDER BY path) - 1 AS id FROM leaves")
def leaf_numbers(spark, sf_dir):
    return T.numbered(leaves(spark, sf_dir)).select("path", "id")


@query(f"WITH {_LEAVES} SELECT p.p_partkey, leaves.path AS leaf FROM p JOIN leaves ON starts_with(p.path, leaves.path)")
def cell_from_point(spark, sf_dir):
    return T.locate(paths(spark, sf_dir), leaves(spark, sf_dir)).select("p_partkey", "leaf")


@query(f"""WITH {_LEAVES} SELECT path, CAST(f AS INTEGER) AS face FROM xy, (SELECT unnest(range(0, 4)) AS f) WHERE (f = 0 AND cx = 0) OR (f = 1 AND cx = power(2, level) - 1) OR (f = 2 AND cy = 0) OR (f = 3 AND cy = power(2, level) - 1)""")
def boundary_faces(spark, sf_dir):
    return T.boundary_faces(leaves(spark, sf_dir))


# boxes in units of the deepest level
_TOUCH = f"""{_LEAVES}, b AS (SELECT path, level, cx * CAST(power(2, {DEEP} - level) AS BIGINT) AS x0, (cx + 1) * CAST(power(2, {DEEP} - level) AS BIGINT) AS x1, cy * CAST(power(2, {DEEP} - level) AS BIGINT) AS y0, (cy + 1) * CAST(power(2, {DEEP} - level) AS BIGINT) AS y1 FROM xy),
t AS (SELECT a.path, a.level, c.path AS neighbor, c.level AS nlevel, (CASE WHEN c.x1 = a.x0 THEN 0 WHEN c.x0 = a.x1 THEN 2 ELSE 1 END) + 3 * (CASE WHEN c.y1 = a.y0 THEN 0 WHEN c.y0 = a.y1 THEN 2 ELSE 1 END) AS region
  FROM b a JOIN b c ON a.path <> c.path AND a.x0 <= c.x1 AND c.x0 <= a.x1 AND a.y0 <= c.y1 AND c.y0 <= a.y1)"""


@query(f"""WITH {_LEAVES} SELECT a.path, CAST(r AS INTEGER) AS region, c.path AS neighbor FROM xy a, (SELECT unnest([0, 1, 2, 3, 5, 6, 7, 8]) AS r), xy c
WHERE a.cx + r % 3 - 1 >= 0 AND a.cx + r % 3 - 1 < power(2, a.level) AND a.cy + r // 3 - 1 >= 0 AND a.cy + r // 3 - 1 < power(2, a.level) AND c.level <= a.level
AND (a.cx + r % 3 - 1) // CAST(power(2, a.level - c.level) AS BIGINT) = c.cx AND (a.cy + r // 3 - 1) // CAST(power(2, a.level - c.level) AS BIGINT) = c.cy""")
def neighbors_region(spark, sf_dir):
    """The leaf of the same or a coarser level that a step in each direction leads to."""
    return T.coarser_neighbors(leaves(spark, sf_dir))


@query(f"WITH {_TOUCH} SELECT path, neighbor FROM t WHERE nlevel < level")
def coarse_neighbors(spark, sf_dir):
    return T.coarse_edges(leaves(spark, sf_dir))


@query(f"WITH {_TOUCH} SELECT DISTINCT path, neighbor FROM t")
def leaf_neighborhood(spark, sf_dir):
    return T.all_neighbors(leaves(spark, sf_dir)).select("path", "neighbor").distinct()


@query(f"WITH {_TOUCH}, per AS (SELECT path, max(nlevel - level) AS finest, min(nlevel - level) AS coarsest FROM t GROUP BY path) SELECT path, CAST(finest AS INTEGER) AS finest, CAST(coarsest AS INTEGER) AS coarsest FROM per")
def level_jumps(spark, sf_dir):
    x = T.all_neighbors(leaves(spark, sf_dir)).withColumn("d", F.length("neighbor") - F.length("path"))
    return x.groupBy("path").agg(F.max("d").alias("finest"), F.min("d").alias("coarsest"))


def flagged(spark, sf_dir):
    """A flag for some of the leaves near the deepest level."""
    return leaves(spark, sf_dir).withColumn("flag", (F.length("path") >= DEEP - 1) & (F.col("path") < "2"))


_FLAG = f"f AS (SELECT path, level, level >= {DEEP - 1} AND path < '2' AS flag FROM leaves)"


@query(f"WITH {_LEAVES}, {_FLAG} SELECT path, row_number() OVER o - 1 AS old_id, CAST(coalesce(sum(CASE WHEN flag THEN 4 ELSE 1 END) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_id FROM f WINDOW o AS (ORDER BY path)")
def refine_map(spark, sf_dir):
    return T.refine_map(flagged(spark, sf_dir))


@query(f"WITH {_LEAVES}, {_FLAG} SELECT path FROM f WHERE NOT flag UNION ALL SELECT path || d FROM f, (SELECT unnest(['0', '1', '2', '3']) AS d) WHERE flag")
def refine(spark, sf_dir):
    return T.refine(flagged(spark, sf_dir))


@query(f"WITH {_LEAVES} SELECT path || d AS path FROM leaves, (SELECT unnest(['0', '1', '2', '3']) AS d)")
def refine_global(spark, sf_dir):
    return T.refine(leaves(spark, sf_dir).withColumn("flag", F.lit(True)))


@query(f"WITH {_TOUCH}, {_FLAG} SELECT DISTINCT t.path FROM t JOIN f a ON a.path = t.path AND a.flag JOIN f c ON c.path = t.neighbor AND NOT c.flag WHERE t.nlevel < t.level")
def check_refine_flags(spark, sf_dir):
    x = flagged(spark, sf_dir)
    return T.unbalanced(x, T.coarse_edges(x))


@query(f"WITH RECURSIVE {_TOUCH}, {_FLAG}, r AS (SELECT path FROM f WHERE flag UNION SELECT t.neighbor FROM r JOIN t ON t.path = r.path WHERE t.nlevel < t.level) SELECT path, path IN (SELECT path FROM r) AS flag FROM f")
def balance_flags(spark, sf_dir):
    x = flagged(spark, sf_dir)
    return T.balance_refine(x, T.coarse_edges(x), DEEP)


@query(f"WITH {_LEAVES}, q AS (SELECT substr(path, 1, level - 1) AS p FROM leaves WHERE level = {DEEP} GROUP BY 1 HAVING count(*) = 4) SELECT DISTINCT CASE WHEN level = {DEEP} AND substr(path, 1, level - 1) IN (SELECT p FROM q) THEN substr(path, 1, level - 1) ELSE path END AS path FROM leaves")
def coarsen_deepest(spark, sf_dir):
    """All sibling sets at the deepest level; nothing finer is beside them."""
    x = leaves(spark, sf_dir).withColumn("flag", F.length("path") == DEEP)
    return T.coarsen(T.balance_coarsen(x, T.coarse_edges(x), 1))


@query(f"""WITH {_LEAVES}, q AS (SELECT substr(path, 1, level - 1) AS p FROM leaves WHERE level = {DEEP} GROUP BY 1 HAVING count(*) = 4), m AS (SELECT path, CASE WHEN level = {DEEP} AND substr(path, 1, level - 1) IN (SELECT p FROM q) THEN substr(path, 1, level - 1) ELSE path END AS z FROM leaves)
SELECT path, row_number() OVER (ORDER BY path) - 1 AS old_id, dense_rank() OVER (ORDER BY z) - 1 AS new_id FROM m""")
def coarsen_map(spark, sf_dir):
    x = leaves(spark, sf_dir).withColumn("flag", F.length("path") == DEEP)
    kept = T.complete_siblings(x).withColumn("z", F.when(F.col("flag"), T.parent(F.col("path"))).otherwise(F.col("path")))
    new = T.numbered(kept.select("z").distinct(), "z", name="new_id").select(F.col("z").alias("nz"), "new_id")
    return T.numbered(kept, "path", name="old_id").join(new, F.col("z") == F.col("nz")).select("path", "old_id", "new_id")


@query(f"WITH {_LEAVES}, v AS (SELECT level, count(*) AS n FROM leaves GROUP BY level) SELECT CAST(level AS INTEGER) AS level, n, CAST(sum(n) OVER (ORDER BY level) - n AS BIGINT) AS first FROM v")
def level_offsets(spark, sf_dir):
    """Cells of each level, and where the level starts in breadth-first order."""
    from pyspark.sql import Window as W

    s = leaves(spark, sf_dir).groupBy(F.length("path").alias("level")).agg(F.count("*").alias("n"))
    return s.withColumn("first", F.sum("n").over(W.orderBy("level").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n"))
