"""Grouped statistics of labelled pixels, mergeable throughout.

What is stored per region and channel is the sum, the sum of squares, the
extremes and the count; means and deviations are projected from those, so
partial tables merge by grouping them again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = ("min_x", "max_x", "min_y", "max_y")


def raster_index(width: int = 1 << 20) -> Column:
    return F.col("y").cast("long") * width + F.col("x")


def segment_table(pixels: DataFrame, value: str = "v", by: Sequence[str] = ("z", "label")) -> DataFrame:
    """Area, extremes, mean and box per label, background included."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    return pixels.groupBy(*by).agg(
        F.count("*").alias("area"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        F.avg(value).alias("mean_value"),
        F.min("x").alias("min_x"),
        F.max("x").alias("max_x"),
        F.min("y").alias("min_y"),
        F.max("y").alias("max_y"),
    )


def moments(pixels: DataFrame, by: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """``area`` and ``sum_, sumsq_, min_, max_`` per channel; extremes ignore NaN."""
    aggs = [F.count("*").alias("area")]
    for c in channels:
        v = F.col(c).cast("double")
        real = F.when(~F.isnan(v), v)
        aggs += [F.sum(v).alias(f"sum_{c}"), F.sum(v * v).alias(f"sumsq_{c}"), F.min(real).alias(f"min_{c}"), F.max(real).alias(f"max_{c}")]
    return pixels.groupBy(*by).agg(*aggs)


def merge_moments(parts: DataFrame, by: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Partial moment tables to one: sums add up, extremes of extremes."""
    aggs = [F.sum("area").alias("area")]
    for c in channels:
        aggs += [F.sum(f"sum_{c}").alias(f"sum_{c}"), F.sum(f"sumsq_{c}").alias(f"sumsq_{c}"), F.min(f"min_{c}").alias(f"min_{c}"), F.max(f"max_{c}").alias(f"max_{c}")]
    return parts.groupBy(*by).agg(*aggs)


def mean_of(c: str, n: str = "area") -> Column:
    return F.when(F.col(n) > 0, F.col(f"sum_{c}") / F.col(n)).otherwise(0.0)


def std_of(c: str, n: str = "area") -> Column:
    """Population deviation from moments, never the root of a negative; 0 where empty."""
    mean = mean_of(c, n)
    return F.when(F.col(n) > 0, F.sqrt(F.greatest(F.col(f"sumsq_{c}") / F.col(n) - mean * mean, F.lit(0.0)))).otherwise(0.0)


def reductions(table: DataFrame, channels: Sequence[str]) -> DataFrame:
    out = table
    for c in channels:
        out = out.withColumn(f"mean_{c}", mean_of(c)).withColumn(f"std_{c}", std_of(c))
    return out.drop(*[f"{p}_{c}" for c in channels for p in ("sum", "sumsq")])


def extremum(pixels: DataFrame, by: Sequence[str], value: str, channels: Sequence[str] = (), largest: bool = False, place: Sequence[str] = ("y", "x")) -> DataFrame:
    """Where the extreme is, first in raster order, and every channel there."""
    at = F.struct(*[F.col(p) for p in place], F.col(value).alias("ext_value"), *[F.col(c).alias(f"ext_{c}") for c in channels])
    v = F.col(value) if not largest else -F.col(value)
    key = F.struct(F.when(~F.isnan(v.cast("double")), v), *[F.col(p) for p in place])
    got = pixels.filter(~F.isnan(F.col(value).cast("double"))).groupBy(*by).agg(F.min_by(at, key).alias("__e"))
    names = {p: f"ext_{p}" for p in place}
    return got.select(*by, *[F.col(f"__e.{p}").alias(n) for p, n in names.items()], F.col("__e.ext_value"), *[F.col(f"__e.ext_{c}") for c in channels])


def window_sample(pixels: DataFrame, points: DataFrame, channels: Sequence[str], radius: int, by: Sequence[str] = ("z",)) -> DataFrame:
    """Mean of the channels in the clamped square around ``ext_y, ext_x`` of each point.

    Points are spread over the square and joined by place, so no range join is needed.
    """
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)])
    spread = points.withColumn("__s", F.explode(steps)).withColumn("y", F.col("ext_y") + F.col("__s.dy")).withColumn("x", F.col("ext_x") + F.col("__s.dx"))
    met = spread.join(pixels.select(*by, "y", "x", *[F.col(c).alias(f"__{c}") for c in channels]), [*by, "y", "x"])
    return met.groupBy(*points.columns).agg(*[F.avg(f"__{c}").alias(f"win_{c}") for c in channels])


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin of a fixed range; values outside go to the end bins, NaN and null to none."""
    at = F.floor((value - low) * bins / (high - low))
    return F.when(~F.isnan(value.cast("double")), F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int"))


def histogram_shares(pixels: DataFrame, by: Sequence[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """``hist00_, hist01_ ...``: share of a group's pixels per bin."""
    b = bin_of(F.col(value), low, high, bins)
    return pixels.groupBy(*by).agg(*[(F.count_if(b == k) / F.count("*")).alias(f"hist{k:02d}_{value}") for k in range(bins)])


def histogram_counts(pixels: DataFrame, by: Sequence[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Long form ``by, bin, n``; merges by grouping again."""
    return pixels.withColumn("bin", bin_of(F.col(value), low, high, bins)).filter("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count("*").alias("n"))


def relevance(low: Column, high: Column, floor: Column, ceiling: Column) -> Column:
    """``(high - low) / (low + (ceiling - floor))``; 0/0 is 0 and x/0 infinite."""
    top, bottom = high - low, low + (ceiling - floor)
    return F.when(bottom != 0, F.try_divide(top, bottom)).when(top == 0, 0.0).otherwise(F.lit(float("inf")))


def slice_range(pixels: DataFrame, value: str, q: float, by: Sequence[str] = ("z",)) -> DataFrame:
    """Linear percentiles ``q`` and ``1 - q`` of a slice's finite values."""
    p = F.percentile(value, F.array(F.lit(q), F.lit(1 - q)))
    return pixels.filter(~F.isnan(F.col(value).cast("double"))).groupBy(*by).agg(p.alias("__p")).select(*by, F.col("__p")[0].alias("floor"), F.col("__p")[1].alias("ceiling"))


LADDER = (0.01, 0.1, 1, 5, 10, 25, 50, 75, 90, 95, 99, 99.9, 99.99)


def percentile_ladder(df: DataFrame, value: str, by: Sequence[str] = (), ladder: Sequence[float] = LADDER) -> DataFrame:
    """Count, extremes, mean, population deviation and the percentiles of finite values."""
    name = lambda q: f"p{q:g}".replace(".", "_")
    got = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.percentile(value, F.array(*[F.lit(q / 100) for q in ladder])).alias("__p"),
    )
    return got.select(*by, "n", "min", "max", "mean", "std", *[F.col("__p")[k].alias(name(q)) for k, q in enumerate(ladder)])


def label_summary(pixels: DataFrame, by: Sequence[str], value: str = "v") -> DataFrame:
    """Pixel count, extremes, mean and median per label."""
    return pixels.groupBy(*by).agg(F.count("*").alias("pixel_count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.median(value).alias("median"))


def parameter_summary(df: DataFrame, factor: str, parameters: Sequence[str]) -> DataFrame:
    """Per factor and parameter: n, mean, sample deviation, median, extremes, quartiles."""
    long = df.select(factor, F.explode(F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).cast("double").alias("value")) for p in parameters])).alias("p")).select(factor, "p.*")
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    got = long.groupBy(factor, "parameter").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), q.alias("__q"), F.min("value").alias("min"), F.max("value").alias("max"))
    return got.select(factor, "parameter", "n", "mean", "sd", F.col("__q")[1].alias("median"), "min", F.col("__q")[0].alias("q25"), F.col("__q")[2].alias("q75"), "max")


def error_summary(errors: DataFrame, by: Sequence[str], error: str = "error", reference: str = "reference") -> DataFrame:
    """Mean, deviation and median error, MAE, RMSE, relative error in percent, tail quantiles and the worst."""
    q = F.percentile(error, F.array(*[F.lit(x) for x in (0.025, 0.25, 0.5, 0.75, 0.975)]))
    e = F.col(error)
    got = errors.groupBy(*by).agg(
        F.count(error).alias("n"), F.avg(e).alias("mean_error"), F.stddev_samp(e).alias("sd_error"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.try_divide(F.abs(e), F.abs(F.col(reference)))) * 100).alias("relative_percent"), q.alias("__q"), F.max(F.abs(e)).alias("worst"),
    )
    return got.select(
        *by, "n", "mean_error", "sd_error", F.col("__q")[2].alias("median_error"), "mae", "rmse", "relative_percent",
        F.col("__q")[0].alias("q025"), F.col("__q")[1].alias("q25"), F.col("__q")[3].alias("q75"), F.col("__q")[4].alias("q975"), "worst",
    )


def fold_summary(folds: DataFrame, metrics: Sequence[str], cells: Sequence[str], model: str = "model") -> DataFrame:
    """Mean and deviation of each metric over folds, confusion cells added up, best first."""
    aggs = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return folds.groupBy(model).agg(*aggs, *[F.sum(c).alias(c) for c in cells]).orderBy(F.desc(f"{metrics[0]}_mean"), model)


def heaviest(pixels: DataFrame, by: Sequence[str], label: str = "label") -> DataFrame:
    """The label with most pixels per group; ties go to the smallest label."""
    sizes = pixels.groupBy(*by, label).agg(F.count("*").alias("voxels"))
    return sizes.groupBy(*by).agg(F.min_by(F.struct(label, "voxels"), F.struct(-F.col("voxels"), F.col(label))).alias("__m")).select(*by, "__m.*")


def tissue_fractions(cells: DataFrame, tiles: DataFrame, scale: int, value: str = "tissue") -> DataFrame:
    """Mean of a coarse map under each tile ``tile, y0, y1, x0, x1`` (fine pixels), at least one cell.

    Tiles are spread over the coarse cells they cover and joined by place.
    """
    lo = lambda c: F.floor(F.col(c) / scale)
    hi = lambda c, d: F.greatest(F.ceil(F.col(c) / scale) - 1, lo(d))
    rows = tiles.select("tile", F.explode(F.sequence(lo("y0"), hi("y1", "y0"))).alias("y"), "x0", "x1").select("tile", "y", F.explode(F.sequence(lo("x0"), hi("x1", "x0"))).alias("x"))
    return rows.join(cells.select("y", "x", value), ["y", "x"]).groupBy("tile").agg(F.avg(value).alias("fraction"), F.count("*").alias("n_cells"))


def zscores(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ("z",), floor: float = 1e-12) -> DataFrame:
    """Whole-slice z-scores with a floor under the spread."""
    w = Window.partitionBy(*by)
    out = rows
    for c in columns:
        out = out.withColumn(f"z_{c}", (F.col(c) - F.avg(c).over(w)) / F.greatest(F.stddev_pop(c).over(w), F.lit(floor)))
    return out


def per_slice_reductions(components: DataFrame, by: Sequence[str], columns: Sequence[str] = ("area", "bbox_w", "bbox_h")) -> DataFrame:
    """Mean, extremes and deviation over the components of a feature."""
    aggs = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_pop))]
    return components.groupBy(*by).agg(*aggs)
