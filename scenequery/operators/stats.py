"""Statistics of pixel values by group: moments, histograms, contrast limits, exact ranks.

Ranges and totals are aggregated first (partial sums on the map side) and joined back by group; the join is a broadcast
where the groups are few. Walks over a histogram run per group on its bins, never on pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def moments(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """count, min, max, mean and population std of the valid values of each group."""
    v = F.col(value)
    return pixels.where(v.isNotNull()).groupBy(*keys).agg(F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def bin_index(v: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal bins over [low, high]; values outside go to the edge bins, an empty range has bins of width 1."""
    width = F.when(high > low, (high - low) / bins).otherwise(1.0)
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((v - low) / width))).cast("int")


def histogram(pixels: DataFrame, keys: list[str], bins: int = 256, value: str = "v", limits: tuple[float, float] | None = None) -> DataFrame:
    """Counts per group and bin that hold values, with the group's range: keys, bin, n, low, high, total."""
    valid = pixels.where(F.col(value).isNotNull())
    if limits:
        ranged = valid.withColumn("low", F.lit(float(limits[0]))).withColumn("high", F.lit(float(limits[1])))
    else:
        ranged = valid.join(valid.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high")), keys)
    counts = ranged.groupBy(*keys, "low", "high", bin_index(F.col(value), F.col("low"), F.col("high"), bins).alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))


def full_histogram(pixels: DataFrame, keys: list[str], bins: int, **more) -> DataFrame:
    """As histogram, with a row also for each empty bin: keys, bin, n, left_edge."""
    found = histogram(pixels, keys, bins, **more)
    groups = found.select(*keys, "low", "high").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / bins).otherwise(1.0)
    return groups.join(found.select(*keys, "bin", "n"), [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"), (F.col("low") + F.col("bin") * width).alias("left_edge"))


def walk(counts: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Adds cum (values up to and with the bin) and the bin's width to a histogram."""
    up_to = Window.partitionBy(*keys).orderBy("bin")
    width = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / bins).otherwise(1.0)
    return counts.withColumn("cum", F.sum("n").over(up_to)).withColumn("width", width)


def binned_median(pixels: DataFrame, keys: list[str], bins: int = 256, value: str = "v") -> DataFrame:
    """Middle of the first bin at which more than half of the values (rounded down) have passed."""
    passed = walk(histogram(pixels, keys, bins, value), keys, bins).where(F.col("cum") > F.floor(F.col("total") / 2))
    return passed.groupBy(*keys).agg(F.min(F.col("low") + (F.col("bin") + 0.5) * F.col("width")).alias("median"))


def contrast_limits(pixels: DataFrame, keys: list[str], low: float = 2, high: float = 98, bins: int = 256, value: str = "v") -> DataFrame:
    """Left edge of the bin where ``low`` per cent have passed, right edge of that where ``high`` per cent have."""
    walked = walk(histogram(pixels, keys, bins, value), keys, bins)
    at_low = F.col("cum") > F.floor(F.col("total") * low / 100)
    at_high = F.col("cum") > F.least(F.floor(F.col("total") * high / 100), F.col("total") - 1)
    return walked.groupBy(*keys).agg(
        F.min(F.when(at_low, F.col("low") + F.col("bin") * F.col("width"))).alias("low_limit"),
        F.min(F.when(at_high, F.col("low") + (F.col("bin") + 1) * F.col("width"))).alias("high_limit"),
    )


def ranked_values(pixels: DataFrame, keys: list[str], shares: dict[str, float], value: str = "v") -> DataFrame:
    """Exact order statistics: the value at index floor(n * share) of each group's sorted valid values.

    Ranks come from counts of equal values, so a group's rows meet only as one row a distinct value.
    """
    distinct = pixels.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("x")).agg(F.count("*").alias("n"))
    ranked = distinct.withColumn("cum", F.sum("n").over(Window.partitionBy(*keys).orderBy("x"))).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    return ranked.groupBy(*keys).agg(*(F.min(F.when(F.col("cum") > F.floor(F.col("total") * share), F.col("x"))).alias(name) for name, share in shares.items()))


#: How scenes of each type are toned: method, gamma, local contrast (or its strength), low and high share.
TONES = {"urban": ("adaptiveLog", 0.4, 0.2, None, None), "water": ("percentileGamma", 0.6, None, 0.05, 0.95), "uniform": ("localContrast", 0.5, 0.4, None, None), "mixed": ("hybrid", 0.45, 0.25, None, None)}


def analyse_scene(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """p10, p50, p90, cv, dynamic_range and scene_type (urban, water, uniform, mixed) of the positive values, with the method, gamma,
    local_contrast, low and high that suit it; a scene without such values is empty and has no figures."""
    ranks = ranked_values(pixels, keys, {"p10": 0.1, "p50": 0.5, "p90": 0.9}, value)
    spread = moments(pixels, keys, value).select(*keys, (F.col("std") / F.col("mean")).alias("cv"))
    both = pixels.select(*keys).distinct().join(ranks.join(spread, keys), keys, "left").withColumn("dynamic_range", F.col("p90") / F.col("p10"))
    kind = F.when(F.col("p10").isNull(), "empty").when(F.col("dynamic_range") > 100, "urban").when(F.col("p50") < 2 * F.col("p10"), "water").when(F.col("cv") < 0.5, "uniform").otherwise("mixed")
    told = both.withColumn("scene_type", kind)
    tone = lambda i: F.coalesce(*(F.when(F.col("scene_type") == t, F.lit(v[i])) for t, v in TONES.items()))
    return told.withColumns({n: tone(i).cast("string" if i == 0 else "double") for i, n in enumerate(("method", "gamma", "local_contrast", "low", "high"))})
