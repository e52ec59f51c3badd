"""Statistics of masked values: one-pass aggregates and fix-point fits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthoflow.sources.scratch import stored

#: Quantile of a 99 % confidence interval, and the factor of the biweight's scale.
SIGMAS, TUNE = 2.575, 6.9460


def stage_statistics(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """mean, std (population), rmse, max, min and n of the values that are not null."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.sqrt(F.avg(v * v)).alias("rmse"),
        F.max(v).alias("max"), F.min(v).alias("min"), F.count(v).alias("n"),
    )


def stack_std(stack: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Population deviation over the layers of each pixel."""
    return stack.groupBy(*keys, "r", "c").agg(F.stddev_pop(value).alias("std"))


@dataclass
class Clip:
    """What a sigma clip ends with; bounds are exclusive and apply to the original values."""

    mu: float | None
    sigma: float | None
    rmse: float | None
    n: int
    low: float
    high: float
    rounds: int

    @property
    def rmse_text(self) -> str:
        return f"{self.rmse:.3f}"


def gaussian_clip(df: DataFrame, value: str, rounds: int = 100, change: float = 0.005, sigmas: float = SIGMAS) -> Clip:
    """Mean and deviation after clipping at mu +- sigmas * sigma until sigma changes by less than `change`.

    One aggregate a round over the original column; only bounds are carried, and
    they only narrow. df is read in each round, so callers store what is costly.
    """
    v = F.col(value).cast("double")
    low, high = float("-inf"), float("inf")

    def fit():
        kept = df.where((v > low) & (v < high)) if low > float("-inf") else df.where(v.isNotNull())
        return kept.agg(F.avg(v), F.stddev_pop(v), F.sqrt(F.avg(v * v)), F.count(v)).first()

    mu, sigma, rmse, n = fit()
    done = 0
    while n and done < rounds:
        low, high = max(low, mu - sigmas * sigma), min(high, mu + sigmas * sigma)
        before = sigma
        found = fit()
        done += 1
        if not found[3]:
            n = 0
            break
        mu, sigma, rmse, n = found
        if before - sigma < change:
            break
    return Clip(mu, sigma, rmse, n, low, high, done)


@dataclass
class Plane:
    """z = a x + b y + c, and the median of absolute residuals before each step and after the last."""

    a: float
    b: float
    c: float
    trace: list[float] = field(default_factory=list)

    def at(self, x: Column, y: Column) -> Column:
        return F.lit(self.a) * x + F.lit(self.b) * y + F.lit(self.c)


def solve3(m: Sequence[Sequence[float]], v: Sequence[float]) -> list[float]:
    """Solution of three linear equations by Cramer's rule; an error if they have none."""
    def det(q):
        return (
            q[0][0] * (q[1][1] * q[2][2] - q[1][2] * q[2][1])
            - q[0][1] * (q[1][0] * q[2][2] - q[1][2] * q[2][0])
            + q[0][2] * (q[1][0] * q[2][1] - q[1][1] * q[2][0])
        )

    d = det(m)
    if not d:
        raise ValueError("the points do not span a plane")
    return [det([[v[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]) / d for k in range(3)]


def exact_median(df: DataFrame, value: Column, most: int = 20_000) -> float | None:
    """The exact median of a column over any number of rows; null values do not count.

    Each round brackets the lower middle by two approximate quantiles and counts
    their ranks exactly, which leaves about 1/300 of the values, until at most
    `most` are left to sort. No task or driver ever holds all of them.
    """
    m = F.col("m")
    rows = df.select(value.cast("double").alias("m")).where(m.isNotNull())
    n = rows.count()
    if not n:
        return None
    inside, left, rank = rows, n, (n - 1) // 2
    found = None
    while found is None and left > most:
        q = rank / (left - 1)
        low, high = inside.agg(F.percentile_approx(m, F.array(F.lit(max(0.0, q - 1.5e-3)), F.lit(min(1.0, q + 1.5e-3))), F.lit(10_000))).first()[0]
        below, at_low, upto = inside.agg(F.count_if(m < low), F.count_if(m == low), F.count_if(m <= high)).first()
        if rank < below:
            inside, left = inside.where(m < low), below
        elif rank < below + at_low:
            found = low
        elif rank >= upto:
            inside, left, rank = inside.where(m > high), left - upto, rank - upto
        else:
            inside, left, rank = inside.where((m > low) & (m <= high)), upto - below - at_low, rank - below - at_low
    if found is None:
        found = sorted(r[0] for r in inside.collect())[rank]
    if n % 2:
        return found
    upto, above = rows.agg(F.count_if(m <= found), F.min(F.when(m > found, m))).first()
    return found if upto > n // 2 else (found + above) / 2


#: Values of a key that one task may hold, and the parts that a bracket of more is cut into.
HELD, PARTS = 100_000, 4_096


def sizes(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """keys, n, low, high of the values that are not null, stored."""
    v = value.cast("double")
    return stored(df.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")), "sizes")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: Column, q: float = 0.5, held: int = HELD, of: DataFrame | None = None) -> DataFrame:
    """The exact quantile m (interpolated; null over no value) of every key at once: keys, m.

    Keys of at most `held` values are sorted in a task. For the others, a bracket
    that holds the wanted rank is cut into PARTS equal parts, whose values are
    counted by an aggregate; the part with the rank, from its least to its greatest
    value, is the next bracket, until it holds at most `held` values or one value
    only. So no task holds a key, and each round reads the rows once, for all
    keys. of: sizes() of the same rows, if known; df should be cheap to read again.
    Keys must not be null.
    """
    keys, v = list(keys), value.cast("double")
    of = sizes(df, keys, value) if of is None else of
    many = of.where(F.col("n") > held)
    rows = df.select(*keys, v.alias("_v")).where("_v IS NOT NULL")
    if many.isEmpty():
        return of.select(*keys).join(rows.groupBy(*keys).agg(F.percentile("_v", F.lit(q)).alias("m")), keys, "left")
    few = of.where(F.col("n") <= held).select(*keys).join(rows.join(many.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.percentile("_v", F.lit(q)).alias("m")), keys, "left")
    place = (F.col("n") - 1) * F.lit(float(q))
    start = many.select(*keys, "low", "high", F.floor(place).alias("rank"), F.col("n").alias("left"))
    open_, done = stored(start, "brackets"), None
    between = F.col("_v").between(F.col("low"), F.col("high"))
    over = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        ready = open_.where((F.col("left") <= held) | (F.col("low") == F.col("high")))
        done = ready if done is None else done.unionByName(ready)
        open_ = open_.where((F.col("left") > held) & (F.col("low") < F.col("high")))
        if open_.isEmpty():
            break
        # halves, as the whole width may be beyond the greatest double
        share = (F.col("_v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        part = F.least(F.floor(share * PARTS).cast("int"), F.lit(PARTS - 1))
        counted = rows.join(open_, keys).where(between).groupBy(*keys, part.alias("part"), "rank").agg(
            F.count(F.lit(1)).alias("left"), F.min("_v").alias("low"), F.max("_v").alias("high")
        )
        before = counted.withColumn("before", F.coalesce(F.sum("left").over(over), F.lit(0)))
        kept = before.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("left")))
        open_ = stored(kept.select(*keys, "low", "high", (F.col("rank") - F.col("before")).alias("rank"), "left"), "brackets")
    one = done.where(F.col("low") == F.col("high")).select(*keys, F.col("low").alias("at"))
    some = rows.join(done.where(F.col("low") < F.col("high")), keys).where(between)
    sorted_ = some.groupBy(*keys, "rank").agg(F.sort_array(F.collect_list("_v")).alias("_vs"))
    found = stored(one.unionByName(sorted_.select(*keys, F.get("_vs", F.col("rank").cast("int")).alias("at"))), "ranked")
    # the next value up, where the quantile lies between two ranks
    upto, above = F.count_if(F.col("_v") <= F.col("at")), F.min(F.when(F.col("_v") > F.col("at"), F.col("_v")))
    next_ = rows.join(found, keys).groupBy(*keys, "at").agg(upto.alias("upto"), above.alias("above")).join(many.select(*keys, "n"), keys)
    up = F.when(F.col("upto") > F.floor(place) + 1, F.col("at")).otherwise(F.coalesce("above", "at"))
    part_ = place - F.floor(place)
    m = F.when(part_ == 0, F.col("at")).otherwise(F.col("at") * (1 - part_) + up * part_)
    return few.unionByName(next_.select(*keys, m.alias("m")))


def exact_modes(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """The commonest value m of every key, the smallest of equals: keys, m. Values are counted first, so no task holds a key."""
    counted = df.select(*keys, value.alias("_v")).groupBy(*keys, "_v").agg(F.count("_v").alias("_n"))
    return counted.groupBy(*keys).agg(F.max_by("_v", F.struct("_n", -F.col("_v"))).alias("m"))


def averages(df: DataFrame, keys: Sequence[str], value: str, option: str) -> DataFrame:
    """mean, median, or mode (of 3 decimals, the smallest of equals) of every key: keys, m."""
    if option not in ("mean", "median", "mode"):
        raise ValueError(f"unknown average: {option}")
    if option == "mean":
        return df.groupBy(*keys).agg(F.avg(value).alias("m"))
    if option == "median":
        return exact_quantiles(df, keys, F.col(value))
    return exact_modes(df, keys, F.round(value, 3))


def fit_plane(df: DataFrame, iterations: int = 10, tol: float = 1e-5, tune: float = TUNE) -> Plane:
    """Robust plane through rows x, y, z (null z is left out) by iterated biweights.

    Weights are (1 - u^2)^2 for u = |r| / (tune * median |r|) up to 1, and 0
    beyond and for a residual of exactly 0. Each step is one aggregate of nine
    sums and one exact median; only these scalars come to the driver.
    """
    rows = df.where(F.col("z").isNotNull()).select("x", "y", "z")
    x, y, z = F.col("x"), F.col("y"), F.col("z")

    def least_squares(w: Column) -> Plane:
        s = rows.agg(
            *[F.sum(w * t) for t in (x * x, x * y, x, y * y, y, F.lit(1.0), x * z, y * z, z)]
        ).first()
        if s[0] is None:
            raise ValueError("no row has a value")
        return Plane(*solve3([[s[0], s[1], s[2]], [s[1], s[3], s[4]], [s[2], s[4], s[5]]], s[6:9]))

    def residual(p: Plane) -> Column:
        return F.abs(p.at(x, y) - z)

    def middle(p: Plane) -> float:
        return exact_median(rows, residual(p))

    p = least_squares(F.lit(1.0))
    trace = [middle(p)]
    for _ in range(iterations):
        if trace[-1] < tol:
            break
        u = residual(p) / F.lit(tune * trace[-1])
        w = F.when((u > 1) | (u == 0), 0.0).otherwise((1 - u * u) * (1 - u * u))
        p = least_squares(w)
        trace.append(middle(p))
    p.trace = trace
    return p


def fit_planes(df: DataFrame, key: str, iterations: int = 10, tol: float = 1e-5, tune: float = TUNE) -> DataFrame:
    """fit_plane() of every key at once: key, a, b, c, and m, the median of absolute residuals after the last step.

    A key whose median is below tol keeps its plane. Planes are null where the
    weighted points span none. Medians are exact, see exact_quantiles().
    """
    rows = df.where(F.col("z").isNotNull()).select(key, "x", "y", "z")
    many = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HELD)
    large = not many.isEmpty()  # residuals of a key are as many in each step
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    terms = {"sxx": x * x, "sxy": x * y, "sx": x, "syy": y * y, "sy": y, "n": F.lit(1.0), "sxz": x * z, "syz": y * z, "sz": z}
    m = [[F.col(k) for k in row] for row in (("sxx", "sxy", "sx"), ("sxy", "syy", "sy"), ("sx", "sy", "n"))]
    v = [F.col("sxz"), F.col("syz"), F.col("sz")]

    def det(q):
        return (
            q[0][0] * (q[1][1] * q[2][2] - q[1][2] * q[2][1])
            - q[0][1] * (q[1][0] * q[2][2] - q[1][2] * q[2][0])
            + q[0][2] * (q[1][0] * q[2][1] - q[1][1] * q[2][0])
        )

    def least_squares(weighted: DataFrame) -> DataFrame:
        s = weighted.groupBy(key).agg(*[F.sum(F.col("w") * e).alias(k) for k, e in terms.items()])
        d = det(m)
        solved = [det([[v[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]) for k in range(3)]
        return s.select(key, *[F.when(d != 0, n / d).alias(k) for k, n in zip("abc", solved)])

    residual = F.abs(F.col("a") * x + F.col("b") * y + F.col("c") - z)

    def with_median(planes: DataFrame) -> DataFrame:
        met = rows.join(planes, key)
        middle = exact_quantiles(met, [key], residual) if large else met.groupBy(key).agg(F.percentile(residual, F.lit(0.5)).alias("m"))
        # a row for each key, without lineage, which would grow by a power with the steps
        return stored(planes.join(middle, key), "planes")

    planes = with_median(stored(least_squares(rows.withColumn("w", F.lit(1.0))), "fitted"))
    for _ in range(iterations):
        u = residual / (F.lit(tune) * F.col("m"))
        w = F.when((u > 1) | (u == 0), 0.0).otherwise((1 - u * u) * (1 - u * u))
        fitted = stored(least_squares(rows.join(planes.where(F.col("m") >= tol), key).withColumn("w", w)), "fitted")
        planes = stored(planes.where(F.col("m").isNull() | (F.col("m") < tol)).unionByName(with_median(fitted)), "planes")
    return planes


def gaussian_clips(df: DataFrame, key: str, value: str, rounds: int = 100, change: float = 0.005, sigmas: float = SIGMAS) -> DataFrame:
    """gaussian_clip() of every key at once: key, mu, sigma, n; keys stop one by one."""
    v = F.col(value).cast("double")
    rows = df.select(key, v.alias("_v")).where("_v is not null")
    fit = [F.avg("_v").alias("mu"), F.stddev_pop("_v").alias("sigma"), F.count("_v").alias("n")]
    inf = float("inf")
    state = stored(rows.groupBy(key).agg(*fit).withColumns({"low": F.lit(-inf), "high": F.lit(inf), "open": F.lit(True)}), "clips")
    for _ in range(rounds):
        if state.where("open").isEmpty():
            break
        low = F.greatest("low", F.col("mu") - sigmas * F.col("sigma"))
        high = F.least("high", F.col("mu") + sigmas * F.col("sigma"))
        bounds = state.where("open").select(key, low.alias("low"), high.alias("high"), F.col("mu").alias("mu0"), F.col("sigma").alias("s0"))
        new = rows.join(bounds, key).where("_v > low and _v < high").groupBy(key).agg(*fit)
        some = F.col("n").isNotNull()
        new = bounds.join(new, key, "left").select(
            key, F.coalesce("mu", "mu0").alias("mu"), F.coalesce("sigma", "s0").alias("sigma"), F.coalesce("n", F.lit(0)).alias("n"),
            "low", "high", (some & (F.col("s0") - F.col("sigma") >= change)).alias("open"),
        )
        state = stored(state.where("not open").unionByName(new), "clips")
    return state.select(key, "mu", "sigma", "n")


def tile_planes(df: DataFrame, key: str) -> DataFrame:
    """Least-squares plane of every tile at once, in closed form: key, a, b, c.

    They are null where the points span no plane (a determinant up to 1e-9).
    """
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    names = {"sxx": x * x, "sxy": x * y, "sx": x, "syy": y * y, "sy": y, "sxz": x * z, "syz": y * z, "sz": z}
    s = df.where(z.isNotNull()).groupBy(key).agg(F.count(z).alias("n"), *[F.sum(e).alias(k) for k, e in names.items()])
    m = [[F.col(k) for k in row] for row in (("sxx", "sxy", "sx"), ("sxy", "syy", "sy"), ("sx", "sy", "n"))]
    v = [F.col("sxz"), F.col("syz"), F.col("sz")]

    def det(q):
        return (
            q[0][0] * (q[1][1] * q[2][2] - q[1][2] * q[2][1])
            - q[0][1] * (q[1][0] * q[2][2] - q[1][2] * q[2][0])
            + q[0][2] * (q[1][0] * q[2][1] - q[1][1] * q[2][0])
        )

    d = det(m)
    solved = lambda k: det([[v[i] if j == k else m[i][j] for j in range(3)] for i in range(3)])
    part = lambda k: F.when(F.abs(d) > 1e-9, solved(k) / d)
    return s.select(key, part(0).alias("a"), part(1).alias("b"), part(2).alias("c"))


def outlier_mask(value: Column, sigma: float | Column, mu: float | Column = 0.0, sigmas: float = SIGMAS) -> Column:
    """value, or null at mu +- sigmas * sigma and beyond."""
    mu, k = (x if isinstance(x, Column) else F.lit(float(x)) for x in (mu, sigma))
    return F.when((value > mu - sigmas * k) & (value < mu + sigmas * k), value)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 100) -> DataFrame:
    """bin (1..bins) and n of the values in low..high."""
    v = F.col(value)
    inside = df.where(v.between(low, high))
    return inside.groupBy(F.least(F.width_bucket(v, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def rmse_xy(df: DataFrame, clip1: Clip, clip2: Clip) -> DataFrame:
    """Root mean square of px1, px2 together over the pixels where both are inside mu +- k sigma."""
    a = outlier_mask(F.col("px1"), clip1.sigma, clip1.mu)
    b = outlier_mask(F.col("px2"), clip2.sigma, clip2.mu)
    both = df.select(a.alias("a"), b.alias("b")).where("a is not null and b is not null")
    return both.agg(F.sqrt(F.avg(F.col("a") * F.col("a") + F.col("b") * F.col("b"))).alias("rmse_xy"), F.count(F.lit(1)).alias("n"))


def most_common(df: DataFrame, value: str) -> DataFrame:
    """The commonest value; the smallest of those that are equally common."""
    return df.agg(F.mode(value, True).alias(value))


def regression(df: DataFrame, y: str, x: str) -> DataFrame:
    """Slope, intercept and R^2 of y on x."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))
