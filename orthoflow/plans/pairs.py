"""Scene pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from orthoflow.operators import pairing
from orthoflow.plans.fixtures import SCENES, scenes, table
from orthoflow.plans.registry import query

FLAT = "a.scene_id AS ref_id, CAST(a.date AS VARCHAR) AS ref_date, b.scene_id AS sec_id, CAST(b.date AS VARCHAR) AS sec_date"
RANKED = f"WITH {SCENES}, ranked AS (SELECT *, row_number() OVER (ORDER BY date, scene_id) AS rn FROM scenes)"
FORWARD = "SELECT " + FLAT + " FROM ranked a JOIN ranked b ON b.rn - a.rn BETWEEN 1 AND "


def dated(pairs):
    """Flat pairs with dates as text."""
    return texts(pairing.flat(pairs), "ref_date", "sec_date")


def texts(df, *columns):
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


@query(RANKED + " SELECT scene_id, CAST(date AS VARCHAR) AS date, CAST(rn AS INTEGER) AS rn FROM ranked")
def order_by_dates(spark, sf_dir):
    return pairing.by_date(scenes(spark, sf_dir)).select("scene_id", F.col("date").cast("string").alias("date"), "rn")


@query(RANKED + f" SELECT {FLAT} FROM ranked a JOIN ranked b ON a.scene_id <> b.scene_id WHERE a.rn = 1")
def pairs_star(spark, sf_dir):
    s = scenes(spark, sf_dir)
    first = pairing.by_date(s).where("rn = 1").first()["date"]
    return dated(pairing.star_pairs(s, first))


@query(f"""WITH {SCENES} SELECT {FLAT} FROM scenes a JOIN scenes b ON a.scene_id <> b.scene_id
WHERE a.date = (SELECT min(date) FROM scenes WHERE date >= DATE '1997-03-01')""")
def pairs_star_by_date(spark, sf_dir):
    s = scenes(spark, sf_dir)
    day = s.where(F.col("date") >= F.lit("1997-03-01").cast("date")).agg(F.min("date")).first()[0]
    return dated(pairing.star_pairs(s, day))


@query(RANKED + ", fwd AS (" + FORWARD + "3) SELECT * FROM fwd UNION ALL SELECT sec_id, sec_date, ref_id, ref_date FROM fwd")
def pair_sequence(spark, sf_dir):
    return dated(pairing.sequence_pairs(scenes(spark, sf_dir), 3))


@query(RANKED + " " + FORWARD + "2")
def ordered_pairs(spark, sf_dir):
    return dated(pairing.sequence_pairs(scenes(spark, sf_dir), 2, backward=False))


@query(f"""WITH {SCENES}, fwd AS (SELECT {FLAT} FROM scenes a, scenes b WHERE a.date < DATE '1998-01-01' AND b.date >= DATE '1998-01-01')
SELECT * FROM fwd UNION ALL SELECT sec_id, sec_date, ref_id, ref_date FROM fwd""")
def pairs_before_after(spark, sf_dir):
    return dated(pairing.before_after_pairs(scenes(spark, sf_dir), F.lit("1998-01-01").cast("date"), backward=True))


@query(RANKED + ", fwd AS (" + FORWARD + "2) SELECT ref_id AS first_id, sec_id AS second_id FROM fwd")
def forward_backward_match(spark, sf_dir):
    return pairing.forward_backward(pairing.sequence_pairs(scenes(spark, sf_dir), 2))


PAIRED = """pairs AS (SELECT l_orderkey AS ref_id, l_partkey AS sec_id, CAST(l_shipdate AS DATE) AS sec_date, CAST(o_orderdate AS DATE) AS ref_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _paired(spark, sf_dir):
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("ref_id"), F.to_date("o_orderdate").alias("ref_date"),
        F.col("l_partkey").alias("sec_id"), F.to_date("l_shipdate").alias("sec_date"),
    )


@query(f"WITH {PAIRED} SELECT ref_id, CAST(ref_date AS VARCHAR) AS ref_date, sec_id, CAST(sec_date AS VARCHAR) AS sec_date FROM pairs WHERE ref_date <> sec_date")
def multitemp_filter(spark, sf_dir):
    return texts(pairing.multitemporal(_paired(spark, sf_dir)), "ref_date", "sec_date")


@query(f"""WITH {PAIRED} SELECT CAST(min(least(ref_date, sec_date)) AS VARCHAR) AS start, CAST(max(greatest(ref_date, sec_date)) AS VARCHAR) AS "end",
CAST(datediff('day', min(least(ref_date, sec_date)), max(greatest(ref_date, sec_date))) AS INTEGER) AS days FROM pairs""")
def series_bounds(spark, sf_dir):
    return texts(pairing.series_bounds(_paired(spark, sf_dir)), "start", "end")
