"""Two-dimensional moving windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orthoflow.functions.raster import stretch
from orthoflow.operators import windows as W
from orthoflow.plans.fixtures import GRID, LAYER, TILES, grid, layer, tiles
from orthoflow.plans.registry import query


def signed(spark, sf_dir):
    """The grid's ew, with the sign of backward (even) layers turned and large values masked."""
    v = F.when(F.col("k") % 2 == 0, -F.col("ew")).otherwise(F.col("ew"))
    return grid(spark, sf_dir).select("r", "c", "k", F.when(F.abs("ew") <= 6, v).alias("v"))


SIGNED = GRID + ", stack AS (SELECT r, c, k, CASE WHEN abs(ew) <= 6 THEN CASE WHEN k % 2 = 0 THEN -ew ELSE ew END END AS v FROM grid)"
NEAR = "generate_series(-1, 1) AS i(dr), generate_series(-1, 1) AS j(dc)"


@query(f"""WITH {SIGNED}, cells AS (SELECT DISTINCT r, c FROM grid)
SELECT a.r, a.c, round(avg(b.v), 6) AS filtered FROM cells a JOIN stack b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.r, a.c""")
def block_mean(spark, sf_dir):
    out = W.block_mean(signed(spark, sf_dir), "v", 1)
    return out.select("r", "c", F.round("filtered", 6).alias("filtered"))


@query(f"""WITH {SIGNED}, cells AS (SELECT DISTINCT r, c FROM grid)
SELECT a.r, a.c, quantile_cont(b.v, 0.5) AS filtered FROM cells a JOIN stack b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.r, a.c""")
def block_median(spark, sf_dir):
    return W.block_median(signed(spark, sf_dir), "v", 1)


def _morph_sql() -> str:
    """Closing with radius 1, then opening with radius 2, of a disk."""
    out, last = [], "a0"
    for i, (agg, n) in enumerate([("max", 1), ("min", 1), ("min", 2), ("max", 2)], 1):
        out.append(f"""a{i} AS (SELECT a.r, a.c, {agg}(b.v) AS v FROM {last} a JOIN {last} b
  ON (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= {n * n} AND b.r BETWEEN a.r - {n} AND a.r + {n} GROUP BY a.r, a.c)""")
        last = f"a{i}"
    return ", ".join(out)


@query(f"WITH {LAYER}, a0 AS (SELECT r, c, CAST(cc > 100 AS INTEGER) AS v FROM layer), {_morph_sql()} SELECT r, c, v FROM a4")
def morph_close_open(spark, sf_dir):
    mask = layer(spark, sf_dir).select("r", "c", (F.col("cc") > 100).cast("int").alias("v"))
    return W.close_open(mask, 10, 20, resolution=10)


@query(f"""WITH {TILES} SELECT tile, r, c, CAST(coalesce(floor((v - min(v) OVER w) * 255.0::DOUBLE / nullif(max(v) OVER w - min(v) OVER w, 0)), 0) AS INTEGER) AS v
FROM tiles WINDOW w AS (PARTITION BY tile)""")
def stretch_uint8(spark, sf_dir):
    w = Window.partitionBy("tile")
    return tiles(spark, sf_dir).select("tile", "r", "c", stretch(F.col("v"), F.min("v").over(w), F.max("v").over(w)).alias("v"))


def _mirrored(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN -({x}) WHEN {x} > 7 THEN 14 - ({x}) ELSE {x} END"


@query(f"""WITH {TILES}, frames AS (SELECT tile // 3 AS stack, tile % 3 AS k, r, c, v FROM tiles),
whole AS (SELECT stack, min(v) AS low, max(v) AS high FROM frames GROUP BY stack HAVING count(*) = 192),
y AS MATERIALIZED (SELECT stack, k, r, c, (v - low) / (high - low) * 255 AS v FROM frames JOIN whole USING (stack)),
padded AS MATERIALIZED (SELECT stack, k, pr, pc, y.v FROM y JOIN (SELECT a AS pr, {_mirrored('CAST(a AS INTEGER)')} AS r FROM range(-3, 11) t(a)) USING (r)
  JOIN (SELECT a AS pc, {_mirrored('CAST(a AS INTEGER)')} AS c FROM range(-3, 11) t(a)) USING (c)),
pixels AS (SELECT stack, r, c FROM y WHERE k = 1),
steps AS (SELECT dr, dc, a, b FROM range(-2, 3) t(dr), range(-2, 3) u(dc), range(-1, 2) v(a), range(-1, 2) w(b)),
asked AS MATERIALIZED (SELECT stack, r, c, dr, dc, r + a AS mr, c + b AS mc, r + dr + a AS fr, c + dc + b AS fc FROM pixels, steps),
own AS MATERIALIZED (SELECT q.*, v AS mv FROM asked q JOIN (SELECT stack, pr AS mr, pc AS mc, v FROM padded WHERE k = 1) USING (stack, mr, mc)),
apart AS MATERIALIZED (SELECT stack, r, c, k, dr, dc, sum((mv - v) * (mv - v)) / 9 AS d FROM own JOIN (SELECT stack, k, pr AS fr, pc AS fc, v FROM padded) USING (stack, fr, fc) GROUP BY ALL),
mixed AS (SELECT stack, r, c, sum(exp(-d / 4.0) * v) / sum(exp(-d / 4.0)) AS v FROM (SELECT *, r + dr AS pr, c + dc AS pc FROM apart) JOIN (SELECT stack, k, pr, pc, v FROM padded) USING (stack, k, pr, pc) GROUP BY ALL)
SELECT stack, r, c, round(v / 255 * (high - low) + low, 6) AS v FROM mixed JOIN whole USING (stack)""")
def nlm_denoise(spark, sf_dir):
    """Non-local means over stacks of three tiles."""
    rows = tiles(spark, sf_dir).groupBy("tile", "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda s: s["v"]).alias("row"))
    frames = rows.groupBy("tile").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "row"))), lambda s: s["row"]).alias("data"))
    stacks = frames.groupBy(F.floor(F.col("tile") / 3).alias("stack")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("tile", "data"))), lambda s: s["data"]).alias("frames")
    )
    done = W.denoise_frames(stacks.where(F.size("frames") == 3), "stack", search=5, patch=3)
    cells = done.select("stack", F.posexplode("data").alias("r", "row")).select("stack", "r", F.posexplode("row").alias("c", "v"))
    return cells.select("stack", "r", "c", F.round("v", 6).alias("v"))
