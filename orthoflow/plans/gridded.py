"""Grid-changing operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from orthoflow.functions import raster as R
from orthoflow.operators import gridding as G
from orthoflow.plans.fixtures import GRID, LAYER, SIDE, TILES, grid, layer, table, tiles
from orthoflow.plans.registry import query


@query(f"WITH {LAYER} SELECT r, c, c * 10.0::DOUBLE + 300000.0 AS x, r * -10.0::DOUBLE + 4900020.0 AS y FROM layer")
def pixel2geo(spark, sf_dir):
    return layer(spark, sf_dir).select(
        "r", "c", R.pixel_to_map(F.col("c"), 300000.0, 10.0).alias("x"), R.pixel_to_map(F.col("r"), 4900020.0, -10.0).alias("y")
    )


@query("""SELECT DISTINCT CAST(trunc((l_extendedprice - 5000) / 10.0) AS INTEGER) AS col, CAST(trunc((9000 - l_extendedprice) / 10.0) AS INTEGER) AS row FROM lineitem""")
def world_to_pixel(spark, sf_dir):
    x = F.col("l_extendedprice")
    y = F.lit(14000.0) - x
    return table(spark, sf_dir, "lineitem").select(
        R.map_to_pixel(x, 5000.0, 10.0).alias("col"), R.map_to_pixel(y, 5000.0, 10.0).alias("row")
    ).distinct()


@query(f"WITH {GRID} SELECT k, r // 4 AS r, c // 4 AS c, round(avg(ew), 6) AS ew, CAST(round_even(avg(cc), 0) AS INTEGER) AS cc FROM grid GROUP BY ALL")
def zoom_area(spark, sf_dir):
    out = G.zoom_out(grid(spark, sf_dir), 4, ["ew"], ["cc"], ["k"])
    return out.select("k", "r", "c", F.round("ew", 6).alias("ew"), "cc")


@query(f"""WITH {GRID}, b AS (SELECT r, c, max(cc) FILTER (k = 1) AS b2, max(cc) FILTER (k = 2) AS b3, max(cc) FILTER (k = 3) AS b4 FROM grid GROUP BY r, c)
SELECT r, c, CAST(round_even(CAST(b2 * 2 + b3 * 4 + b4 * 4 AS DOUBLE) / 10, 0) AS INTEGER) AS pan FROM b WHERE b2 + b3 + b4 IS NOT NULL""")
def pan_synthesis(spark, sf_dir):
    band = lambda k: F.max(F.when(F.col("k") == k, F.col("cc")))
    b = grid(spark, sf_dir).groupBy("r", "c").agg(band(1).alias("b2"), band(2).alias("b3"), band(3).alias("b4"))
    return b.select("r", "c", G.pan(F.col("b2"), F.col("b3"), F.col("b4")).alias("pan")).where("pan is not null")


def _area_sql(scale: float, n: int) -> str:
    touch = lambda x, t: f"least({x} + 1, ({t} + 1) * {scale}::DOUBLE) - greatest({x}, {t} * {scale}::DOUBLE)"
    return f"""WITH {GRID}, target AS (SELECT CAST(a AS INTEGER) AS t FROM range({n}) x(a)),
w AS (SELECT k, i.t AS r, j.t AS c, ({touch('g.r', 'i.t')}) * ({touch('g.c', 'j.t')}) AS w, ew, CAST(cc > 100 AS INTEGER) AS low
  FROM grid g JOIN target i ON g.r + 1 > i.t * {scale}::DOUBLE AND g.r < (i.t + 1) * {scale}::DOUBLE JOIN target j ON g.c + 1 > j.t * {scale}::DOUBLE AND g.c < (j.t + 1) * {scale}::DOUBLE)
SELECT k, r, c, round(sum(w * ew) / sum(w), 6) AS ew, sum(w * low) / sum(w) > 0.5 AS low FROM w WHERE w > 1e-12 GROUP BY k, r, c"""


def _resampled(scale: float, n: int):
    def run(spark, sf_dir):
        cells = grid(spark, sf_dir).select("k", "r", "c", "ew", (F.col("cc") > 100).alias("low"))
        out = G.area_resample(cells, scale, scale, n, n, ["ew"], ["low"], ["k"])
        return out.select("k", "r", "c", F.round("ew", 6).alias("ew"), "low")

    return run


@query(_area_sql(2.5, 26))
def area_shrink(spark, sf_dir):
    """All layers at two and a half times their cell size, with a mask by area."""
    return _resampled(2.5, 26)(spark, sf_dir)


@query(_area_sql(0.3, 213))
def area_grow(spark, sf_dir):
    """All layers at three tenths of their cell size, with a mask by area."""
    return _resampled(0.3, 213)(spark, sf_dir)


CANVAS = "(SELECT CAST(a AS INTEGER) AS r, CAST(b AS INTEGER) AS c FROM range({0}) t(a), range({1}) u(b))"


@query(f"""WITH {LAYER}, target AS {CANVAS.format(40, 40)}
SELECT t.r, t.c, coalesce(l.cc, -1) AS v FROM target t LEFT JOIN layer l
ON l.r = CAST(floor(t.r * 1.5::DOUBLE + 0.75) AS INTEGER) AND l.c = CAST(floor(t.c * 1.5::DOUBLE + 0.75) AS INTEGER)""")
def regrid_near(spark, sf_dir):
    src = layer(spark, sf_dir).select("r", "c", F.col("cc").alias("v"))
    at = lambda n: F.floor(F.col(n) * 1.5 + 0.75).cast("int")
    return G.gather(G.canvas(src, 40, 40), src, at("r"), at("c")).select("r", "c", F.coalesce("got", F.lit(-1)).alias("v"))


def weight_sql(d: str, a: float) -> str:
    x = f"abs({d})"
    return (f"CASE WHEN {x} <= 1 THEN (({a + 2}::DOUBLE * {x} - {a + 3}::DOUBLE) * {x} * {x} + 1) WHEN {x} < 2 "
            f"THEN (({a}::DOUBLE * {x} - {5 * a}::DOUBLE) * {x} + {8 * a}::DOUBLE) * {x} - {4 * a}::DOUBLE ELSE 0 END")  # fmt: skip


def cubic_sql(asked: str, source: str, a: float, clamp: int | None = None) -> str:
    """Sum over taps for `asked` (r, c, y, x) from `source` (r, c, v)."""
    place = lambda x: f"greatest(0, least({x}, {clamp - 1}))" if clamp else x
    return f"""SELECT q.r, q.c, sum({weight_sql('q.y - q.tr', a)} * {weight_sql('q.x - q.tc', a)} * coalesce(s.v, 0)) AS got
FROM (SELECT r, c, y, x, CAST(floor(y) AS INTEGER) + i AS tr, CAST(floor(x) AS INTEGER) + j AS tc
      FROM {asked}, generate_series(-1, 2) AS g(i), generate_series(-1, 2) AS h(j)) q
LEFT JOIN {source} s ON s.r = {place('q.tr')} AND s.c = {place('q.tc')} GROUP BY q.r, q.c"""


@query(f"""WITH {LAYER}, src AS (SELECT r, c, cc AS v FROM layer),
asked AS (SELECT r, c, r * 1.5::DOUBLE + 0.25 AS y, c * 1.5::DOUBLE + 0.25 AS x FROM {CANVAS.format(40, 40)}), got AS ({cubic_sql('asked', 'src', -0.5)})
SELECT r, c, round(got, 6) AS v FROM got""")
def regrid_cubic(spark, sf_dir):
    src = layer(spark, sf_dir).select("r", "c", F.col("cc").alias("v"))
    at = lambda n: F.col(n) * 1.5 + 0.25
    return G.cubic(G.canvas(src, 40, 40), src, at("r"), at("c"), a=-0.5).select("r", "c", F.round("got", 6).alias("v"))


TILE_MEANS = TILES + ", src AS (SELECT r, c, round(avg(v), 6) AS v FROM tiles GROUP BY r, c)"


@query(f"""WITH {TILE_MEANS}, asked AS (SELECT r, c, (r + 0.5::DOUBLE) / 4 - 0.5 AS y, (c + 0.5::DOUBLE) / 4 - 0.5 AS x FROM {CANVAS.format(32, 32)}),
got AS ({cubic_sql('asked', 'src', -0.75, 8)}) SELECT r, c, round(got, 8) AS v FROM got""")
def zoom_in_cubic(spark, sf_dir):
    """Upsampling of a correction surface, here the mean tile."""
    src = tiles(spark, sf_dir).groupBy("r", "c").agg(F.round(F.avg("v"), 6).alias("v"))
    return G.zoom_in(src, 4, 8, 8).select("r", "c", F.round("got", 8).alias("v"))


TURN = G.rotation(SIDE, SIDE, 12.0)
_A, _B, _C, _D, _E, _F = TURN.inverse
TURN_SQL = f"""turned AS (SELECT r, c, CAST(floor({_C!r}::DOUBLE * c + {_D!r}::DOUBLE * r + {_F!r}::DOUBLE + 0.5) AS INTEGER) AS sr,
  CAST(floor({_A!r}::DOUBLE * c + {_B!r}::DOUBLE * r + {_E!r}::DOUBLE + 0.5) AS INTEGER) AS sc FROM {CANVAS.format(TURN.rows, TURN.cols)})"""


@query(f"WITH {LAYER}, {TURN_SQL} SELECT t.r, t.c, coalesce(l.cc, -255) AS v FROM turned t LEFT JOIN layer l ON l.r = sr AND l.c = sc")
def rotate_near(spark, sf_dir):
    src = layer(spark, sf_dir).select("r", "c", F.col("cc").alias("v"))
    return G.rotate(src, SIDE, SIDE, 12.0).select("r", "c", F.coalesce("got", F.lit(-255)).alias("v"))


SHIFTS = "src AS (SELECT r, c, cc * 100 AS v FROM layer), shifts AS (SELECT r, c, ew / 8.0::DOUBLE AS px, ns / 8.0::DOUBLE AS py FROM layer)"


def shifts(spark, sf_dir):
    one = layer(spark, sf_dir)
    return one.select("r", "c", (F.col("cc") * 100).alias("v")), one.select("r", "c", (F.col("ew") / 8).alias("px"), (F.col("ns") / 8).alias("py"))


@query(f"""WITH {LAYER}, {SHIFTS} SELECT t.r, t.c, coalesce(s.v, 0) AS v FROM shifts t LEFT JOIN src s
ON s.r = CAST(round_even(t.r + t.py, 0) AS INTEGER) AND s.c = CAST(round_even(t.c + t.px, 0) AS INTEGER)""")
def remap_near(spark, sf_dir):
    return G.remap(*shifts(spark, sf_dir), nearest=True)


@query(f"""WITH {LAYER}, {SHIFTS}, asked AS (SELECT r, c, r + py AS y, c + px AS x FROM shifts), got AS ({cubic_sql('asked', 'src', -0.75)})
SELECT r, c, CAST(((CAST(round_even(got, 0) AS BIGINT) % 65536) + 65536) % 65536 AS INTEGER) AS v FROM got""")
def remap_cubic(spark, sf_dir):
    return G.remap(*shifts(spark, sf_dir))
