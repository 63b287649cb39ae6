"""Queries on uneven meshes: flags, regridding, and exchange between levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import weights as K
from ..operators import blocks as BL
from ..operators import boundary as B
from ..operators import conditions as C
from ..operators import evaluation as V
from ..operators import mesh as M
from ..operators import tree as T
from ..operators import wavelets as WA
from .nodes import SQL, num, points
from .trees import _LEAVES, DEEP, leaves, sql_cell, sql_path

QUERIES: dict = {}
ORACLE_SQL: dict = {}
WIDTH, GHOST = 6, 3


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _digits(half: str) -> str:
    return f"list_reduce(list_prepend(0, list_transform(string_split(z, ''), lambda d: CAST(coalesce(TRY_CAST(d AS INTEGER), 0) {half} AS INTEGER))), lambda a, b: 2 * a + b)"


# b: the balanced leaves; t: touching ones, as boxes in units of the deepest level
_BALANCED = f"""{_LEAVES}, dirs AS (SELECT dx, dy FROM (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)),
bd(level, x, y) AS (SELECT length(z), {_digits('% 2')}, {_digits('// 2')} FROM s UNION SELECT level - 1, (x + dx) // 2, (y + dy) // 2 FROM bd, dirs
  WHERE level >= 1 AND x + dx >= 0 AND x + dx < power(2, level) AND y + dy >= 0 AND y + dy < power(2, level)),
k AS (SELECT level + 1 AS level, 2 * x + g AS x, 2 * y + h AS y FROM bd, (SELECT unnest([0, 1]) AS g), (SELECT unnest([0, 1]) AS h)),
b AS (SELECT {sql_path('x', 'y', 'level')} AS path, level, x, y FROM k WHERE NOT EXISTS (SELECT 1 FROM bd WHERE bd.level = k.level AND bd.x = k.x AND bd.y = k.y)),
e AS (SELECT path, level, x * CAST(power(2, {DEEP} - level) AS BIGINT) AS x0, (x + 1) * CAST(power(2, {DEEP} - level) AS BIGINT) AS x1, y * CAST(power(2, {DEEP} - level) AS BIGINT) AS y0, (y + 1) * CAST(power(2, {DEEP} - level) AS BIGINT) AS y1 FROM b),
t AS (SELECT a.path, a.level, c.path AS neighbor, c.level AS nlevel, (CASE WHEN c.x1 = a.x0 THEN 0 WHEN c.x0 = a.x1 THEN 2 ELSE 1 END) + 3 * (CASE WHEN c.y1 = a.y0 THEN 0 WHEN c.y0 = a.y1 THEN 2 ELSE 1 END) AS region
  FROM e a JOIN e c ON a.path <> c.path AND a.x0 <= c.x1 AND c.x0 <= a.x1 AND a.y0 <= c.y1 AND c.y0 <= a.y1)"""
_R = f"path < '1' AND level < {DEEP}"
_C = "path >= '1'"
# r: refined leaves; c0: wanted to coarsen, not beside a refined one; stay: those that may not
_FLAGS = f"""{_BALANCED}, r AS (SELECT path FROM b WHERE {_R} UNION SELECT t.neighbor FROM r JOIN t ON t.path = r.path WHERE t.nlevel < t.level),
c0 AS (SELECT path, level, left(path, level - 1) AS up FROM b WHERE {_C} AND path NOT IN (SELECT path FROM r) AND path NOT IN (SELECT t.neighbor FROM t JOIN r ON r.path = t.path WHERE t.nlevel <= t.level)),
g AS (SELECT path, neighbor FROM t WHERE nlevel < level UNION ALL SELECT a.path, c.path FROM b a JOIN b c ON a.level = c.level AND left(a.path, a.level - 1) = left(c.path, c.level - 1)),
stay AS (SELECT path FROM b WHERE path NOT IN (SELECT path FROM c0) OR left(path, level - 1) NOT IN (SELECT up FROM c0 GROUP BY up HAVING count(*) = 4) UNION SELECT g.neighbor FROM stay JOIN g ON g.path = stay.path),
f AS (SELECT path, level, x, y, path IN (SELECT path FROM r) AS refine, path NOT IN (SELECT path FROM stay) AS coarsen FROM b)"""
_CHANGES = f"""{_FLAGS}, m AS (SELECT path, CASE WHEN refine THEN 'refine' WHEN coarsen THEN 'coarsen' ELSE 'keep' END AS change,
  unnest(CASE WHEN refine THEN [path || '0', path || '1', path || '2', path || '3'] WHEN coarsen THEN [left(path, level - 1)] ELSE [path] END) AS new FROM f)"""


def even(spark, sf_dir):
    return M.settled(M.balanced(leaves(spark, sf_dir), DEEP))


def wanted(spark, sf_dir):
    """Refine a quarter of the domain, coarsen the rest."""
    return even(spark, sf_dir).withColumn("refine", (F.col("path") < "1") & (F.length("path") < DEEP)).withColumn("coarsen", F.col("path") >= "1")


def flagged(spark, sf_dir):
    return M.balance_flags(wanted(spark, sf_dir), DEEP)


@query(f"WITH RECURSIVE {_BALANCED} SELECT path, CAST(level AS INTEGER) AS level FROM b")
def balanced_leaves(spark, sf_dir):
    return M.balanced(leaves(spark, sf_dir), DEEP).select("path", T.level_of(F.col("path")).alias("level"))


@query(f"WITH RECURSIVE {_BALANCED}, f0 AS (SELECT path FROM b WHERE path < '03'), f1 AS (SELECT path FROM f0 UNION SELECT t.neighbor FROM t JOIN f0 ON f0.path = t.path), f2 AS (SELECT path FROM f1 UNION SELECT t.neighbor FROM t JOIN f1 ON f1.path = t.path) SELECT path, path IN (SELECT path FROM f2) AS refine FROM b")
def buffer_flags(spark, sf_dir):
    return M.buffered(even(spark, sf_dir).withColumn("refine", F.col("path") < "03"), 2)


@query(f"WITH RECURSIVE {_BALANCED} SELECT path, path < '2' AND level < 4 AS refine, path >= '2' AND level > 2 AS coarsen FROM b")
def limit_flags(spark, sf_dir):
    return M.limited(even(spark, sf_dir).withColumn("refine", F.col("path") < "2").withColumn("coarsen", F.col("path") >= "2"), 2, 4)


@query(f"WITH RECURSIVE {_BALANCED} SELECT path, (x + 0.5e0) / power(2e0, level) < 0.4e0 AND level < 4 AS refine, (x + 0.5e0) / power(2e0, level) < 0.4e0 AND level > 4 AS coarsen FROM b")
def radius_flags(spark, sf_dir):
    return M.flags_in_radius(even(spark, sf_dir), 0.4, 4)


@query(f"WITH RECURSIVE {_BALANCED} SELECT path, path = (SELECT arg_min(path, ((x + 0.5e0) / power(2e0, level), path)) FROM b) AS flag FROM b")
def innermost_flag(spark, sf_dir):
    return M.innermost(even(spark, sf_dir))


@query(f"WITH RECURSIVE {_FLAGS} SELECT path, refine, coarsen FROM f")
def mesh_balance_flags(spark, sf_dir):
    return flagged(spark, sf_dir)


@query(f"WITH RECURSIVE {_BALANCED} SELECT path FROM b a WHERE {_C} AND ((SELECT count(*) FROM b c WHERE c.level = a.level AND c.{_C} AND left(c.path, c.level - 1) = left(a.path, a.level - 1)) < 4 OR EXISTS (SELECT 1 FROM t WHERE t.neighbor = a.path AND t.level > t.nlevel AND NOT t.{_C}))")
def check_coarsen_flags(spark, sf_dir):
    x = wanted(spark, sf_dir)
    return M.unfit_to_coarsen(x, T.coarse_edges(x))


@query(f"WITH RECURSIVE {_FLAGS} SELECT count(*) FILTER (refine) AS n_refine, count(*) FILTER (coarsen) AS n_coarsen, count(*) FILTER (refine OR coarsen) > 0 AS needed FROM f")
def flag_counts(spark, sf_dir):
    return M.flag_counts(flagged(spark, sf_dir))


@query(f"WITH RECURSIVE {_CHANGES} SELECT path, change, new FROM m")
def regrid_map(spark, sf_dir):
    return M.regrid(flagged(spark, sf_dir))


@query(f"""WITH RECURSIVE {_BALANCED} SELECT path, CAST(q AS INTEGER) AS region, CAST(CASE WHEN q % 3 = 0 AND x = 0 THEN 0 WHEN q % 3 = 2 AND x = power(2, level) - 1 THEN 2 ELSE 1 END
+ 3 * CASE WHEN q // 3 = 0 AND y = 0 THEN 0 WHEN q // 3 = 2 AND y = power(2, level) - 1 THEN 2 ELSE 1 END AS INTEGER) AS crossed FROM b, (SELECT unnest(range(0, 9)) AS q)""")
def boundary_regions(spark, sf_dir):
    return M.boundary_regions(even(spark, sf_dir))


#: A cubic, which interpolation of order 4 keeps.
def cubic(x, y):
    return 0.7310585 * x * x * x - 1.3719261 * x * y * y + 0.4175512 * x * y + 0.2689414 * y


_CUBIC = "0.7310585e0 * x * x * x - 1.3719261e0 * x * y * y + 0.4175512e0 * x * y + 0.2689414e0 * y"


def field(spark, sf_dir, cells=None):
    x = M.nodes_of(even(spark, sf_dir) if cells is None else cells, WIDTH)
    return x.withColumn("u", cubic(M.position(0, WIDTH), M.position(1, WIDTH)))


_SPAN = f"(SELECT unnest(range(-{GHOST}, {WIDTH + GHOST + 1})) AS i), (SELECT unnest(range(-{GHOST}, {WIDTH + GHOST + 1})) AS j)"


@query(f"""WITH RECURSIVE {_BALANCED} SELECT path, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round({_CUBIC}, 7) AS u FROM
(SELECT path, i, j, (x + i / {WIDTH}e0) / power(2e0, level) AS x, (y + j / {WIDTH}e0) / power(2e0, level) AS y FROM b, {_SPAN} WHERE i BETWEEN CASE WHEN x = 0 THEN 0 ELSE -{GHOST} END AND CASE WHEN x = power(2, level) - 1 THEN {WIDTH} ELSE {WIDTH + GHOST} END
  AND j BETWEEN CASE WHEN y = 0 THEN 0 ELSE -{GHOST} END AND CASE WHEN y = power(2, level) - 1 THEN {WIDTH} ELSE {WIDTH + GHOST} END)""")
def fill_boundary(spark, sf_dir):
    """Ghosts from neighbours of all levels; those of a cubic have its values."""
    cells = even(spark, sf_dir)
    return M.fill_boundary(field(spark, sf_dir, cells), cells, WIDTH, GHOST).select("path", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.round("u", 7).alias("u"))


@query(f"""WITH RECURSIVE {_BALANCED}, v AS (SELECT path, i, j, CASE WHEN x < 0 THEN -1e0 ELSE 1e0 END AS s, abs(x) AS x, y FROM
(SELECT path, i, j, (x + i / {WIDTH}e0) / power(2e0, level) AS x, (y + j / {WIDTH}e0) / power(2e0, level) AS y FROM b, {_SPAN} WHERE i <= CASE WHEN x = power(2, level) - 1 THEN {WIDTH} ELSE {WIDTH + GHOST} END
  AND j BETWEEN CASE WHEN y = 0 THEN 0 ELSE -{GHOST} END AND CASE WHEN y = power(2, level) - 1 THEN {WIDTH} ELSE {WIDTH + GHOST} END))
SELECT path, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(s * CASE WHEN x = 0 THEN 0e0 ELSE {_CUBIC} END, 7) + 0e0 AS u FROM v""")
def fill_with_parity(spark, sf_dir):
    """The same with an odd face at x = 0: corners beyond it mirror the ghosts beside them."""
    cells = even(spark, sf_dir)
    x = M.fill_boundary(field(spark, sf_dir, cells), cells, WIDTH, GHOST, rules={(0, 0): B.Face("antisymmetric")})
    return x.select("path", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), (F.round("u", 7) + 0.0).alias("u"))


@query(f"""WITH RECURSIVE {_CHANGES}, w AS (SELECT DISTINCT new AS z FROM m), l AS (SELECT z AS path, length(z) AS level, {_digits('% 2')} AS cx, {_digits('// 2')} AS cy FROM w)
SELECT path, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round({_CUBIC}, 7) AS u FROM (SELECT path, i, j, (cx + i / {WIDTH}e0) / power(2e0, level) AS x, (cy + j / {WIDTH}e0) / power(2e0, level) AS y FROM l, (SELECT unnest(range(0, {WIDTH + 1})) AS i), (SELECT unnest(range(0, {WIDTH + 1})) AS j))""")
def transfer_system(spark, sf_dir):
    """A cubic on the old leaves, moved to the new ones."""
    changes = M.settled(M.regrid(flagged(spark, sf_dir)))
    x = M.transfer(field(spark, sf_dir, changes.select("path").distinct()), changes, WIDTH)
    return x.select("path", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.round("u", 7).alias("u"))


@query(f"WITH RECURSIVE {_BALANCED} SELECT path, 1 / (power(2e0, level) * {WIDTH}) AS h, (SELECT 1 / (power(2e0, max(level)) * {WIDTH}) FROM b) AS finest FROM b")
def leaf_spacing(spark, sf_dir):
    return M.spacing(even(spark, sf_dir), WIDTH)


@query(f"""WITH RECURSIVE {_BALANCED}, q AS (SELECT path, bool_or(region = 3) AS w, bool_or(region = 5) AS o, bool_or(region = 1) AS s, bool_or(region = 7) AS n FROM t WHERE nlevel > level GROUP BY path)
SELECT b.path, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, 1 / (power(2e0, level) * {WIDTH}) / CASE WHEN (i = 0 AND w) OR (i = {WIDTH} AND o) OR (j = 0 AND s) OR (j = {WIDTH} AND n) THEN 2 ELSE 1 END AS h
FROM b LEFT JOIN q ON q.path = b.path, (SELECT unnest(range(0, {WIDTH + 1})) AS i), (SELECT unnest(range(0, {WIDTH + 1})) AS j)""")
def vertex_spacing(spark, sf_dir):
    return M.spacing_of_vertices(even(spark, sf_dir), WIDTH)


@query(f"""WITH RECURSIVE {_BALANCED}, a AS (SELECT path, CAST(q AS INTEGER) AS face, (q = 1 AND x = power(2, level) - 1) OR (q = 3 AND y = power(2, level) - 1) AS o FROM b, (SELECT unnest(range(0, 4)) AS q))
SELECT path, face, CASE WHEN o THEN 'one_sided' ELSE 'ghost' END AS class, NOT bool_or(o) OVER (PARTITION BY path) AS interior FROM a""")
def boundary_classes(spark, sf_dir):
    """The upper faces of the domain have one-sided stencils."""
    return M.boundary_classes(even(spark, sf_dir), (1, 3))


@query(f"""WITH RECURSIVE {_BALANCED}, q AS (SELECT b.*, dx, dy, x + dx AS tx, y + dy AS ty FROM b, dirs WHERE (dx <> 0 OR dy <> 0) AND x + dx BETWEEN 0 AND power(2, level) - 1 AND y + dy BETWEEN 0 AND power(2, level) - 1),
met AS (SELECT q.path, q.x, q.y, q.dx, q.dy, c.path AS neighbor, c.level - q.level AS step, c.x AS cx, c.y AS cy FROM q JOIN b c ON (c.level = q.level AND c.x = tx AND c.y = ty) OR (c.level = q.level - 1 AND c.x = tx // 2 AND c.y = ty // 2)
  OR (c.level = q.level + 1 AND c.x // 2 = tx AND c.y // 2 = ty AND (dx = 0 OR (c.x % 2 = 1) = (dx = -1)) AND (dy = 0 OR (c.y % 2 = 1) = (dy = -1)))),
box AS (SELECT *, CASE dx WHEN -1 THEN -{GHOST} WHEN 1 THEN {WIDTH} + (step = 1)::INT ELSE (step = 1 AND cx % 2 = 1)::INT * {WIDTH // 2} END AS d0, CASE dx WHEN -1 THEN -(step = 1)::INT WHEN 1 THEN {WIDTH + GHOST} ELSE {WIDTH} - (step = 1 AND cx % 2 = 0)::INT * {WIDTH // 2} END AS e0,
  CASE dy WHEN -1 THEN -{GHOST} WHEN 1 THEN {WIDTH} + (step = 1)::INT ELSE (step = 1 AND cy % 2 = 1)::INT * {WIDTH // 2} END AS d1, CASE dy WHEN -1 THEN -(step = 1)::INT WHEN 1 THEN {WIDTH + GHOST} ELSE {WIDTH} - (step = 1 AND cy % 2 = 0)::INT * {WIDTH // 2} END AS e1 FROM met)
SELECT path, CAST(dx + 1 + 3 * (dy + 1) AS INTEGER) AS region, neighbor, CASE step WHEN 0 THEN 'direct' WHEN 1 THEN 'fine' ELSE 'coarse' END AS kind, CAST(d0 AS INTEGER) AS d0, CAST(e0 - d0 + 1 AS INTEGER) AS n0, CAST(d0 + {WIDTH} * x - {WIDTH} * cx * power(2e0, -step) AS INTEGER) AS s0,
CAST(d1 AS INTEGER) AS d1, CAST(e1 - d1 + 1 AS INTEGER) AS n1, CAST(d1 + {WIDTH} * y - {WIDTH} * cy * power(2e0, -step) AS INTEGER) AS s1 FROM box""")
def exchange_boxes(spark, sf_dir):
    return M.exchange_boxes(even(spark, sf_dir), WIDTH, GHOST)


@query(f"SELECT p_partkey, round({_CUBIC}, 7) AS u FROM (SELECT p_partkey, x * x AS x, y * y AS y FROM ({SQL['points']}))")
def interpolate_points(spark, sf_dir):
    """A cubic at scattered points, from the nodes of their leaves."""
    cells = even(spark, sf_dir)
    x = points(spark, sf_dir).select("p_partkey", (F.col("x") * F.col("x")).alias("x"), (F.col("y") * F.col("y")).alias("y"))
    x = x.withColumn("path", T.path_of([T.lattice(F.col(c), DEEP) for c in ("x", "y")], DEEP))
    return M.values_at(x, field(spark, sf_dir, cells), cells, WIDTH).select("p_partkey", F.round("u", 7).alias("u"))


@query(f"SELECT path, i, j, round(({_CUBIC}) * h / finest, 7) AS u FROM (SELECT v.path, v.i, v.j, v.h, (b.x + v.i / {WIDTH}e0) / power(2e0, b.level) AS x, (b.y + v.j / {WIDTH}e0) / power(2e0, b.level) AS y, f.finest FROM ({ORACLE_SQL['vertex_spacing']}) v JOIN (WITH RECURSIVE {_BALANCED} SELECT path, level, x, y FROM b) b ON b.path = v.path, (SELECT min(h) AS finest FROM ({ORACLE_SQL['leaf_spacing']})) f)")
def adaptive_steps(spark, sf_dir):
    """Rates scaled by how long a step their node allows."""
    cells = even(spark, sf_dir)
    x = M.scaled_steps(field(spark, sf_dir, cells), cells, WIDTH)
    return x.select("path", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.round("u", 7).alias("u"))


@query(f"WITH RECURSIVE {_BALANCED} SELECT path, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, cell, flag FROM (SELECT path, row_number() OVER (ORDER BY path) - 1 AS cell, CAST({_R} AS INTEGER) AS flag FROM b), (SELECT unnest(range(0, {WIDTH + 1})) AS i), (SELECT unnest(range(0, {WIDTH + 1})) AS j)")
def node_owners(spark, sf_dir):
    return M.node_owners(wanted(spark, sf_dir), WIDTH)


#: Added before rounding, as values that end in 5 would round either way.
ASIDE = 1e-9


def _partials(x: str, y: str) -> dict[str, str]:
    """The cubic and its derivatives at a place, in SQL."""
    return {
        "u": _CUBIC.replace("x", "#").replace("y", y).replace("#", x), "ux": f"(2.1931755e0 * {x} * {x} - 1.3719261e0 * {y} * {y} + 0.4175512e0 * {y})", "uy": f"(-2.7438522e0 * {x} * {y} + 0.4175512e0 * {x} + 0.2689414e0)",
        "uxy": f"(-2.7438522e0 * {y} + 0.4175512e0)", "lap": f"(4.386351e0 * {x} - 2.7438522e0 * {x})",
    }


_EVERY_NODE = f"""SELECT path, level, b.x AS cx, b.y AS cy, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, (b.x + i / {WIDTH}e0) / power(2e0, level) AS x, (b.y + j / {WIDTH}e0) / power(2e0, level) AS y, 1 / (power(2e0, level) * {WIDTH}) AS h
FROM b, (SELECT unnest(range(0, {WIDTH + 1})) AS i), (SELECT unnest(range(0, {WIDTH + 1})) AS j)"""
_AT = _partials("x", "y")


@query(f"WITH RECURSIVE {_BALANCED} SELECT path, i, j, " + ", ".join(f"round({_AT[k]} + {ASIDE}, 6) AS {k}" for k in ("ux", "uy", "uxy", "lap")) + f" FROM ({_EVERY_NODE})")
def mesh_apply(spark, sf_dir):
    """Derivatives on all leaves: centred, and one-sided on the edge of the domain; those of a cubic are exact."""
    cells = even(spark, sf_dir)
    f = lambda e: {"ux": e.derivative("u", 0), "uy": e.derivative("u", 1), "uxy": e.mixed_derivative("u", 0, 1), "lap": e.second_derivative("u", 0) + e.second_derivative("u", 1)}
    x = V.apply(field(spark, sf_dir, cells), cells, WIDTH, f, {"u": {}})
    return x.select("path", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), *[F.round(F.col(c) + ASIDE, 6).alias(c) for c in ("ux", "uy", "uxy", "lap")])


_IN = _partials("x", "(y - h)")
_WAVE = "1.5e0 * ({u} - 0.1e0 + x * {ux} + {y} * {uy})"
_OWN_WAVE, _IN_WAVE = _WAVE.format(**_AT, y="y"), _WAVE.format(**_IN, y="(y - h)")


@query(f"""WITH RECURSIVE {_BALANCED}, nd AS ({_EVERY_NODE}), nq AS (SELECT *, sqrt(x * x + y * y) AS r, sqrt(x * x + (y - h) * (y - h)) AS s, cx = power(2, level) - 1 AND i = {WIDTH} AS east, cy = power(2, level) - 1 AND j = {WIDTH} AS north,
  (cx = 0 AND i = 0) OR (cy = 0 AND j = 0) AS low FROM nd)
SELECT path, i, j, round({ASIDE} + CASE WHEN low THEN {_AT['lap']} WHEN east THEN 2e0 * (0.5e0 - ({_AT['u']})) WHEN north THEN -{_OWN_WAVE} / r + s * s * s * ({_IN['lap']} + {_IN_WAVE} / s) / (r * r * r) ELSE {_AT['lap']} END, 6) AS u,
  round({_AT['ux']} + {ASIDE}, 6) AS slope FROM nq""")
def mesh_rates(spark, sf_dir):
    """A rate that is pulled towards a target on the east face and leaves through the north face; free faces in the west and south own their corners."""
    cells = even(spark, sf_dir)
    rules = {(0, 1): B.Face("weak_dirichlet", target=0.5, strength=2.0), (1, 1): B.Face("radiative", target=0.1, speed=1.5)}
    f = lambda e: {"u": e.second_derivative("u", 0) + e.second_derivative("u", 1), "slope": e.derivative("u", 0)}
    x = V.apply(field(spark, sf_dir, cells), cells, WIDTH, f, {"u": rules})
    return x.select("path", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), *[F.round(F.col(c) + ASIDE, 6).alias(c) for c in ("u", "slope")])


@query(f"""WITH RECURSIVE {_BALANCED} SELECT path, i, j, round(CASE WHEN cx = 0 AND i = 0 THEN 0.25e0 ELSE {_AT['u']} END, 7) AS u FROM ({_EVERY_NODE})""")
def strong_faces(spark, sf_dir):
    """Nodes on a face of the domain take the target."""
    cells = even(spark, sf_dir)
    x = M.fill_boundary(field(spark, sf_dir, cells), cells, WIDTH, GHOST, rules={(0, 0): B.Face("strong_dirichlet", target=0.25)})
    x = x.filter(F.col("i").between(0, WIDTH) & F.col("j").between(0, WIDTH))
    return x.select("path", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.round("u", 7).alias("u"))


def _weights(cells: int, order: int, buffer: int) -> str:
    rows = WA.diagonal_weights(cells, order, buffer)
    return ", ".join(f"({cells}, {k}, {p}, {x!r}e0)" if "e" not in repr(x) else f"({cells}, {k}, {p}, {x!r})" for k, row in rows for p, x in enumerate(row) if p % 2 == 0)


_BUFFER = 2 * (GHOST // 2)
_SECOND = "0.25e0 * x * x * y - 0.125e0 * y * y * y + x"
LOWER, UPPER = 1e-5, 1e-3


def second(x, y):
    return 0.25 * x * x * y - 0.125 * y * y * y + x


_PLACE = f"(c.x + ({{0}} - (c.cells - {WIDTH}) / 2) / {WIDTH}e0) / power(2e0, c.level) AS x, (c.y + ({{1}} - (c.cells - {WIDTH}) / 2) / {WIDTH}e0) / power(2e0, c.level) AS y"


@query(f"""WITH RECURSIVE {_BALANCED}, w(cells, k, p, a) AS (VALUES {_weights(WIDTH, 1, 0)}, {_weights(WIDTH + 2 * _BUFFER, 2, _BUFFER)}),
c AS (SELECT path, CASE WHEN x = 0 OR y = 0 OR x = power(2, level) - 1 OR y = power(2, level) - 1 THEN {WIDTH} ELSE {WIDTH + 2 * _BUFFER} END AS cells, x, y, level FROM b),
o AS (SELECT c.path, s.k AS ki, v.k AS kj, s.a * v.a AS a, {_PLACE.format('s.p', 'v.p')} FROM c JOIN w s ON s.cells = c.cells JOIN w v ON v.cells = c.cells
  UNION ALL SELECT c.path, s.k, v.k, -1e0, {_PLACE.format('s.k', 'v.k')} FROM c JOIN (SELECT DISTINCT cells, k FROM w) s ON s.cells = c.cells JOIN (SELECT DISTINCT cells, k FROM w) v ON v.cells = c.cells),
d AS (SELECT path, max(greatest(abs(du), abs(dv))) AS detail FROM (SELECT path, sum(a * ({_CUBIC})) AS du, sum(a * ({_SECOND})) AS dv FROM o GROUP BY path, ki, kj) GROUP BY path)
SELECT path, round(detail + {ASIDE}, 8) AS detail, detail >= {UPPER} AS refine, detail <= {LOWER} AS coarsen FROM d""")
def mesh_wavelet_flags(spark, sf_dir):
    """Two channels; leaves on the faces of the domain have no buffer."""
    cells = even(spark, sf_dir)
    x = field(spark, sf_dir, cells).withColumn("v", second(M.position(0, WIDTH), M.position(1, WIDTH)))
    found = WA.flag_wavelets(x, cells, WIDTH, GHOST, {"u": {}, "v": {}}, order=2, lower=LOWER, upper=UPPER)
    return found.select("path", F.round(F.col("detail") + ASIDE, 8).alias("detail"), "refine", "coarsen")


_BLOCKS = f"""{_BALANCED}, r1 AS (SELECT *, y - row_number() OVER (PARTITION BY level, x ORDER BY y) AS run FROM b), r2 AS (SELECT level, x, run, min(y) AS c1, count(*) AS n1 FROM r1 GROUP BY ALL),
r3 AS (SELECT *, x - row_number() OVER (PARTITION BY level, c1, n1 ORDER BY x) AS stack FROM r2), r4 AS (SELECT level, c1, n1, stack, min(x) AS c0, count(*) AS n0 FROM r3 GROUP BY ALL),
bk AS (SELECT row_number() OVER (ORDER BY {sql_path('c0', 'c1', 'level')}) - 1 AS block_id, level, c0, c1, n0, n1 FROM r4)"""


@query(f"WITH RECURSIVE {_BLOCKS} SELECT CAST(block_id AS INTEGER) AS block_id, CAST(level AS INTEGER) AS level, CAST(c0 AS INTEGER) AS c0, CAST(c1 AS INTEGER) AS c1, CAST(n0 AS INTEGER) AS n0, CAST(n1 AS INTEGER) AS n1 FROM bk")
def mesh_blocks(spark, sf_dir):
    return BL.block_tables(spark, even(spark, sf_dir))[0]


@query(f"WITH RECURSIVE {_BLOCKS} SELECT b.path, CAST(block_id AS INTEGER) AS block_id, CAST(x - c0 AS INTEGER) AS p0, CAST(y - c1 AS INTEGER) AS p1 FROM b JOIN bk ON bk.level = b.level AND x BETWEEN c0 AND c0 + n0 - 1 AND y BETWEEN c1 AND c1 + n1 - 1")
def block_cells(spark, sf_dir):
    return BL.block_tables(spark, even(spark, sf_dir))[1]


@query(f"""WITH RECURSIVE {_BLOCKS}, nn AS (SELECT block_id, (n0 * {WIDTH} + 1 + 2 * {GHOST}) * (n1 * {WIDTH} + 1 + 2 * {GHOST}) AS nodes FROM bk)
SELECT CAST(block_id AS INTEGER) AS block_id, CAST(sum(nodes) OVER (ORDER BY block_id) - nodes AS BIGINT) AS start, CAST(sum(nodes) OVER (ORDER BY block_id) AS BIGINT) AS "end" FROM nn""".replace(' AS "end"', " AS stop"))
def block_node_ranges(spark, sf_dir):
    return BL.node_ranges(BL.block_tables(spark, even(spark, sf_dir))[0], WIDTH, GHOST).withColumnRenamed("end", "stop")


@query(f"""WITH bx AS ({ORACLE_SQL['exchange_boxes']}), nb AS (SELECT path, region, neighbor, row_number() OVER (ORDER BY path || ' ' || region || ' ' || neighbor) - 1 AS interface_id FROM bx),
lf AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS cell FROM ({ORACLE_SQL['balanced_leaves']})),
pl AS (SELECT bx.*, d0 + a AS i, d1 + c AS j FROM bx, (SELECT unnest(range(0, {WIDTH + 2 * GHOST + 1})) AS a), (SELECT unnest(range(0, {WIDTH + 2 * GHOST + 1})) AS c) WHERE a < n0 AND c < n1),
ch AS (SELECT * FROM pl QUALIFY row_number() OVER (PARTITION BY path, i, j ORDER BY length(neighbor), neighbor, region) = 1),
ms AS (SELECT * FROM ch WHERE NOT (kind = 'direct' AND path <= neighbor AND i BETWEEN 0 AND {WIDTH} AND j BETWEEN 0 AND {WIDTH}))
SELECT l.path, CAST(s.i AS INTEGER) AS i, CAST(s.j AS INTEGER) AS j, coalesce(o.cell, -1) AS neighbor_id, coalesce(nb.interface_id, -1) AS interface_id FROM lf l CROSS JOIN (SELECT i, j FROM {_SPAN}) s LEFT JOIN ms ON ms.path = l.path AND ms.i = s.i AND ms.j = s.j
LEFT JOIN lf o ON o.path = ms.neighbor LEFT JOIN nb ON nb.path = ms.path AND nb.region = ms.region AND nb.neighbor = ms.neighbor""")
def interface_fields(spark, sf_dir):
    """Which leaf and which box fill each ghost and each shared node, over all levels."""
    return M.interface_fields(even(spark, sf_dir), WIDTH, GHOST)


#: Of degree 6 on both axes, which interpolation of order 4 does not keep: centred and one-sided rows differ.
def sextic(x, y):
    return 531.25 * x * x * x * x * x * x - 728.5 * y * y * y * y * y * y * x + 212.75 * x * x * x * y


_SEXTIC = "531.25e0 * x * x * x * x * x * x - 728.5e0 * y * y * y * y * y * y * x + 212.75e0 * x * x * x * y"


def _rows() -> str:
    """(kind, x, k, a): weights of nodes k for half step x, centred and one-sided."""
    kernel, out = K.interpolation(4), []
    for x in range(2 * WIDTH + 1):
        p, q = x // 2, WIDTH - 1 - x // 2
        centred = {p: 1.0} if x % 2 == 0 else {p + o: w for o, w in kernel.interior.items()}
        edge = centred if x % 2 == 0 or min(p, q) > 1 else dict(enumerate(kernel.left[p])) if p < 2 else {WIDTH - k: w for k, w in enumerate(kernel.left[q])}
        out += [f"({kind}, {x}, {k}, {num(w)})" for kind, row in ((True, centred), (False, edge)) for k, w in row.items()]
    return ", ".join(out)


def _beyond(c: str) -> str:
    return f"CASE WHEN {c} % 2 = 1 AND {c} // 2 < 2 THEN -1 WHEN {c} % 2 = 1 AND {WIDTH - 1} - {c} // 2 < 2 THEN 1 ELSE 0 END"


def _range(n: str) -> str:
    return f"{n} BETWEEN CASE d{n} WHEN -1 THEN -{GHOST} WHEN 0 THEN 0 ELSE {WIDTH + 1} END AND CASE d{n} WHEN -1 THEN -1 WHEN 0 THEN {WIDTH} ELSE {WIDTH + GHOST} END"


@query(f"""WITH RECURSIVE {_BALANCED}, wt(centred, hx, k, a) AS (VALUES {_rows()}),
av AS (SELECT path, dx AS sx, dy AS sy FROM b, dirs WHERE x + dx BETWEEN 0 AND power(2, level) - 1 AND y + dy BETWEEN 0 AND power(2, level) - 1 AND NOT EXISTS (SELECT 1 FROM b c WHERE c.level = b.level - 1 AND c.x = (b.x + dx) // 2 AND c.y = (b.y + dy) // 2)),
pr AS (SELECT b.path, b.x AS px, b.y AS py, dx AS di, dy AS dj, c.path AS source, c.level AS up, c.x AS cx, c.y AS cy FROM b, dirs, b c WHERE (dx <> 0 OR dy <> 0) AND b.x + dx BETWEEN 0 AND power(2, b.level) - 1 AND b.y + dy BETWEEN 0 AND power(2, b.level) - 1
  AND c.level = b.level - 1 AND c.x = (b.x + dx) // 2 AND c.y = (b.y + dy) // 2),
tg AS (SELECT *, px * {WIDTH} + i - 2 * cx * {WIDTH} AS hx, py * {WIDTH} + j - 2 * cy * {WIDTH} AS hy FROM pr, {_SPAN} WHERE {_range('i')} AND {_range('j')}),
sd AS (SELECT *, {_beyond('hx')} AS sx, {_beyond('hy')} AS sy FROM tg),
ok AS (SELECT sd.*, a.path IS NOT NULL AS o0, c.path IS NOT NULL AS o1, d.path IS NOT NULL AS o2 FROM sd LEFT JOIN av a ON a.path = source AND a.sx = sd.sx AND a.sy = 0 LEFT JOIN av c ON c.path = source AND c.sx = 0 AND c.sy = sd.sy LEFT JOIN av d ON d.path = source AND d.sx = sd.sx AND d.sy = sd.sy),
vs AS (SELECT ok.path, i, j, u.a * v.a AS a, (cx + u.k / {WIDTH}e0) / power(2e0, up) AS x, (cy + v.k / {WIDTH}e0) / power(2e0, up) AS y FROM ok JOIN wt u ON u.hx = ok.hx AND u.centred = (o0 AND (o2 OR NOT o1)) JOIN wt v ON v.hx = ok.hy AND v.centred = (o1 AND (o2 OR NOT o0)))
SELECT path, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(a * ({_SEXTIC})) + {ASIDE}, 6) AS u FROM vs GROUP BY path, i, j""")
def staged_ghosts(spark, sf_dir):
    """Ghosts beside coarser leaves, interpolated on the ghosts that those have by then."""
    cells = even(spark, sf_dir)
    x = M.nodes_of(cells, WIDTH).withColumn("u", sextic(M.position(0, WIDTH), M.position(1, WIDTH)))
    side = lambda n: F.when(F.col(n) < 0, 0).when(F.col(n) > WIDTH, 2).otherwise(1)
    coarse = T.coarser_neighbors(cells).filter(F.length("neighbor") < F.length("path")).select("path", "region")
    x = M.fill_boundary(x, cells, WIDTH, GHOST).withColumn("region", side("i") + 3 * side("j")).join(coarse, ["path", "region"], "left_semi")
    return x.select("path", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.round(F.col("u") + ASIDE, 6).alias("u"))


def ramp(x, y):
    return 1.0 + 0.5 * x + y * y


_RAMP = "(1e0 + 0.5e0 * x + y * y)"
#: Two channels with different kinds on their faces; faces without a row are free.
_TWO = [
    ("u", 0, "strong_dirichlet", "ramp", None, None), ("u", 1, "weak_dirichlet", "ramp", None, 2.0), ("u", 2, "antisymmetric", None, None, None),
    ("v", 1, "strong_dirichlet", "0.25", None, None), ("v", 2, "weak_dirichlet", "ramp", None, 0.5), ("v", 3, "symmetric", None, None, None),
]
_KINDS = "(VALUES ('u', 0, 'strong_dirichlet'), ('u', 1, 'weak_dirichlet'), ('u', 2, 'antisymmetric'), ('u', 3, 'free'), ('v', 0, 'free'), ('v', 1, 'strong_dirichlet'), ('v', 2, 'weak_dirichlet'), ('v', 3, 'symmetric'))"


def two_channels(spark):
    return C.conditions(spark.createDataFrame(_TWO, C.RULES), ["u", "v"], {"ramp": ramp})


@query(f"""WITH RECURSIVE {_BALANCED} SELECT path, channel, CAST(face AS INTEGER) AS face, CASE WHEN (CASE face WHEN 0 THEN x = 0 WHEN 1 THEN x = power(2, level) - 1 WHEN 2 THEN y = 0 ELSE y = power(2, level) - 1 END) THEN kind ELSE 'custom' END AS kind
FROM b, {_KINDS} AS k(channel, face, kind)""")
def face_rules(spark, sf_dir):
    """The kind of each leaf's faces, by channel; faces between leaves are custom."""
    return C.block_conditions(even(spark, sf_dir), two_channels(spark))


@query(f"""WITH RECURSIVE {_BALANCED}, nq AS (SELECT *, cx = 0 AND i = 0 AS west, cx = power(2, level) - 1 AND i = {WIDTH} AS east, cy = 0 AND j = 0 AS south FROM ({_EVERY_NODE})),
f AS (SELECT *, {_CUBIC} AS u0, x * y AS v0, CASE WHEN south THEN 0e0 WHEN west THEN {_RAMP} ELSE {_CUBIC} END AS fu, CASE WHEN east THEN 0.25e0 ELSE x * y END AS fv FROM nq)
SELECT path, i, j, round(fu + {ASIDE}, 7) AS u, round(fv + {ASIDE}, 7) AS v, round({ASIDE} + CASE WHEN east AND NOT west THEN 2e0 * ({_RAMP} - fu) ELSE u0 END, 7) AS du, round({ASIDE} + CASE WHEN south AND NOT west THEN 0.5e0 * ({_RAMP} - fv) ELSE v0 END, 7) AS dv FROM f""")
def face_conditions(spark, sf_dir):
    """Values and rates of two channels as a table of rules asks, with a target that changes along a face."""
    cells = even(spark, sf_dir)
    x = field(spark, sf_dir, cells).withColumn("v", M.position(0, WIDTH) * M.position(1, WIDTH)).withColumn("du", F.col("u")).withColumn("dv", F.col("v"))
    out = C.with_face_conditions(x, cells, WIDTH, two_channels(spark), {"u": "du", "v": "dv"})
    return out.select("path", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), *[F.round(F.col(c) + ASIDE, 7).alias(c) for c in ("u", "v", "du", "dv")])


@query(f"""WITH RECURSIVE {_BALANCED} SELECT path, i, j, round({ASIDE} + CASE WHEN (cx = 0 AND i = 0) OR (cy = 0 AND j = 0) THEN {_AT['lap']} WHEN cx = power(2, level) - 1 AND i = {WIDTH} THEN 2e0 * ({_RAMP} - ({_AT['u']}))
  WHEN cy = power(2, level) - 1 AND j = {WIDTH} THEN 0.5e0 - ({_AT['u']}) ELSE {_AT['lap']} END, 6) AS u FROM ({_EVERY_NODE})""")
def table_rates(spark, sf_dir):
    """A rate on a whole mesh with rules from a table, one of its targets a function of place."""
    cells = even(spark, sf_dir)
    rows = [("u", 1, "weak_dirichlet", "ramp", None, 2.0), ("u", 3, "weak_dirichlet", "0.5", None, None)]
    rules = C.conditions(spark.createDataFrame(rows, C.RULES), ["u"], {"ramp": ramp})
    x = V.apply(field(spark, sf_dir, cells), cells, WIDTH, lambda e: {"u": e.second_derivative("u", 0) + e.second_derivative("u", 1)}, rules)
    return x.select("path", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.round(F.col("u") + ASIDE, 6).alias("u"))


def _fitted(t: str, k: str) -> str:
    """The weight of node k of 7 for the nearest quadratic at t, both from the middle node on, by discrete orthogonal polynomials."""
    return f"(1 / 7e0 + {t} * {k} / 28e0 + ({t} * {t} - 4) * ({k} * {k} - 4) / 84e0)"


@query(f"""WITH RECURSIVE {_BALANCED}, placed AS (SELECT p_partkey, level, b.x AS cx, b.y AS cy, (p.x * power(2e0, level) - b.x) * {WIDTH} - 3 AS s, (p.y * power(2e0, level) - b.y) * {WIDTH} - 3 AS t FROM ({SQL['points']}) p
  JOIN b ON {sql_cell('p.x')} // CAST(power(2, {DEEP} - level) AS BIGINT) = b.x AND {sql_cell('p.y')} // CAST(power(2, {DEEP} - level) AS BIGINT) = b.y),
weighed AS (SELECT p_partkey, {_fitted('s', 'k')} * {_fitted('t', 'l')} AS w, (cx + (k + 3) / {WIDTH}e0) / power(2e0, level) AS x, (cy + (l + 3) / {WIDTH}e0) / power(2e0, level) AS y FROM placed, (SELECT unnest(range(-3, 4)) AS k), (SELECT unnest(range(-3, 4)) AS l))
SELECT p_partkey, round(sum(w * ({_CUBIC})) + {ASIDE}, 7) AS u FROM weighed GROUP BY p_partkey""")
def interpolate_low_order(spark, sf_dir):
    """A cubic at scattered points, by the quadratic that is nearest to it on each point's leaf; on a border that is the lower one's."""
    cells = even(spark, sf_dir)
    p = points(spark, sf_dir).withColumn("path", T.path_of([T.lattice(F.col(c), DEEP) for c in "xy"], DEEP))
    return M.values_at(p, field(spark, sf_dir, cells), cells, WIDTH, order=2).select("p_partkey", F.round(F.col("u") + ASIDE, 7).alias("u"))
