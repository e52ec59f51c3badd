"""Dense matching of layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from orthoflow.operators import matching as M
from orthoflow.plans.fixtures import GRID, grid
from orthoflow.plans.registry import query


def _match_sql(first: str, second: str, search: int, radius: int, least: float) -> str:
    full, side = 0.5 * (2 * radius + 1) ** 2, 2 * search + 1
    return f"""WITH {GRID}, halved AS (SELECT k, r // 2 AS r, c // 2 AS c, CAST(sum(cc) AS DOUBLE) AS v, CAST(sum(abs(ew)) % 5 AS DOUBLE) AS noise FROM grid GROUP BY k, r // 2, c // 2),
a AS ({first}), b AS ({second}),
o AS (SELECT CAST(y AS INTEGER) - {search} AS dy, CAST(x AS INTEGER) - {search} AS dx FROM range({side}) t(y), range({side}) u(x)),
met AS (SELECT k, a.r, a.c, dy, dx, a.v AS a, b.v AS b FROM a CROSS JOIN o JOIN b USING (k) WHERE b.r = a.r + dy AND b.c = a.c + dx),
near AS (SELECT CAST(y AS INTEGER) - {radius} AS y, CAST(x AS INTEGER) - {radius} AS x FROM range({2 * radius + 1}) t(y), range({2 * radius + 1}) u(x)),
spread AS (SELECT k, r + y AS r, c + x AS c, dy, dx, a, b FROM met, near),
sums AS (SELECT k, r, c, dy, dx, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab FROM spread GROUP BY ALL),
cc AS (SELECT k, r, c, dy, dx, (n * ab - s.a * s.b) / (sqrt(n * aa - s.a * s.a) * sqrt(n * bb - s.b * s.b)) AS cc FROM sums s JOIN met USING (k, r, c, dy, dx)
  WHERE n > {full} AND n * aa - s.a * s.a > 0 AND n * bb - s.b * s.b > 0),
top AS (SELECT * FROM cc QUALIFY row_number() OVER (PARTITION BY k, r, c ORDER BY round(cc, 9) DESC, abs(dy) + abs(dx), dy, dx) = 1),
sides AS (SELECT t.k, t.r, t.c, t.dy, t.dx, t.cc, {", ".join(f"max(u.cc) FILTER (u.dy - t.dy = {i} AND u.dx - t.dx = {j}) AS n{i + 1}{j + 1}" for i in (-1, 0, 1) for j in (-1, 0, 1))}
  FROM top t JOIN cc u ON u.k = t.k AND u.r = t.r AND u.c = t.c AND abs(u.dy - t.dy) <= 1 AND abs(u.dx - t.dx) <= 1 GROUP BY t.k, t.r, t.c, t.dy, t.dx, t.cc),
bent AS (SELECT *, (n21 - n01) / 2 AS gy, (n12 - n10) / 2 AS gx, n01 - 2 * cc + n21 AS yy, n10 - 2 * cc + n12 AS xx, (n22 - n20 - n02 + n00) / 4 AS xy FROM sides),
solved AS (SELECT *, yy * xx - xy * xy AS det, (xy * gx - xx * gy) / nullif(yy * xx - xy * xy, 0) AS y, (xy * gy - yy * gx) / nullif(yy * xx - xy * xy, 0) AS x FROM bent),
told AS (SELECT *, coalesce(yy < 0 AND det > 0 AND abs(y) <= 1 AND abs(x) <= 1, false) AS sound FROM solved)
SELECT k, r, c, round(dy + CASE WHEN sound THEN y WHEN yy < 0 AND n01 <= cc AND n21 <= cc THEN (n01 - n21) / (2 * yy) ELSE 0 END, 3) AS py,
round(dx + CASE WHEN sound THEN x WHEN xx < 0 AND n10 <= cc AND n12 <= cc THEN (n10 - n12) / (2 * xx) ELSE 0 END, 3) AS px,
CAST(greatest(0, least(255, round_even(cc * 128 + 127, 0))) AS INTEGER) AS cc FROM told WHERE cc >= {least}"""


def _told(found):
    return found.select("k", "r", "c", F.round("py", 3).alias("py"), F.round("px", 3).alias("px"), M.cc_byte(F.col("cc")).alias("cc"))


def _halved(spark, sf_dir):
    """All layers on 32 by 32 cells, whose sums are whole numbers: k, r, c, v, noise."""
    half = lambda n: F.floor(F.col(n) / 2).cast("int").alias(n)
    sums = F.sum("cc").cast("double").alias("v"), (F.sum(F.abs("ew")) % 5).cast("double").alias("noise")
    return grid(spark, sf_dir).groupBy("k", half("r"), half("c")).agg(*sums)


@query(_match_sql("SELECT k, r, c, v FROM halved WHERE k < 5", "SELECT k - 1 AS k, r, c, v FROM halved WHERE k BETWEEN 2 AND 5", 2, 2, 0.2))
def dense_match(spark, sf_dir):
    """Layers 1 to 4 each matched with the next one."""
    g = _halved(spark, sf_dir)
    first, second = g.where("k < 5"), g.where("k BETWEEN 2 AND 5").withColumn("k", F.col("k") - 1)
    return _told(M.dense_match(first, second, 2, 2, 0.2, keys=["k"]))


@query(_match_sql("SELECT k, r, c, v FROM halved", "SELECT k, r + 1 AS r, c - 2 AS c, v + noise AS v FROM halved", 3, 3, 0.9))
def planted_shift(spark, sf_dir):
    """All layers matched with themselves, moved one cell down and two to the left, with some noise."""
    first = _halved(spark, sf_dir)
    second = first.select("k", (F.col("r") + 1).alias("r"), (F.col("c") - 2).alias("c"), (F.col("v") + F.col("noise")).alias("v"))
    return _told(M.dense_match(first, second, 3, 3, 0.9, keys=["k"]))
