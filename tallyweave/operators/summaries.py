"""Aggregates, reshaping and plot data over count tables.

A group (sample, feature or factor level) may hold a large share of all rows, so totals are aggregated first and
joined back, and medians come from counted values, instead of windows over whole groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.ranking import counted_values, global_index, quantiles, quantiles_of_counts


def sample_sums(abund: DataFrame, out: str = "total") -> DataFrame:
    return abund.groupBy("sample_id").agg(F.sum("count").alias(out))


def taxa_sums(abund: DataFrame, out: str = "total") -> DataFrame:
    return abund.groupBy("feature_id").agg(F.sum("count").alias(out))


def class_prevalence(abund: DataFrame, meta: DataFrame, is_neg: str = "is_neg") -> DataFrame:
    """Per feature: number of negative and of other samples it occurs in."""
    flags = meta.select("sample_id", F.col(is_neg).alias("_neg"))
    return (
        abund.filter(F.col("count") > 0)
        .join(flags, "sample_id")
        .groupBy("feature_id")
        .agg(F.count_if(~F.col("_neg")).alias("pa_pos"), F.count_if(F.col("_neg")).alias("pa_neg"))
    )


def presence(abund: DataFrame) -> DataFrame:
    return abund.withColumn("count", (F.col("count") > 0).cast("int"))


def relative_abundance(abund: DataFrame, scale: float = 1.0, out: str = "rel") -> DataFrame:
    """Count over library size, times ``scale`` (100 for percent)."""
    sums = sample_sums(abund, "_total")
    return abund.join(sums, "sample_id").withColumn(out, F.col("count") / F.col("_total") * F.lit(scale)).drop("_total")


def tally(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def contingency(df: DataFrame, rows: Sequence[str], column: str, levels: Sequence) -> DataFrame:
    """Counts by row keys with one column per level; empty cells stay null."""
    return df.groupBy(*rows).pivot(column, list(levels)).agg(F.count(F.lit(1)))


def observed_features(abund: DataFrame, meta: DataFrame, *by: str) -> DataFrame:
    seen = abund.filter(F.col("count") > 0).groupBy("sample_id").agg(F.count(F.lit(1)).alias("num_features"))
    return seen.join(meta.select("sample_id", *by), "sample_id")


def feature_summary(abund: DataFrame) -> DataFrame:
    """Total, number of samples, mean and median count over the samples that have the feature."""
    nonzero = abund.filter(F.col("count") > 0)
    stats = nonzero.groupBy("feature_id").agg(
        F.sum("count").alias("tot_counts"),
        F.count(F.lit(1)).alias("num_samples"),
        F.avg("count").alias("av_per_sample"),
    )
    return stats.join(quantiles(nonzero, ["feature_id"], "count", [0.5], ["med_per_sample"]), "feature_id")


def feature_summary_by_type(abund: DataFrame, meta: DataFrame, by: str = "sample_type") -> DataFrame:
    """Per feature and sample class, samples without the feature counted as zero.

    ``overall_rank`` orders by median x prevalence (ties: total, then names); ``within_type_rank`` does so per class.
    """
    percent = relative_abundance(abund.filter(F.col("count") > 0), 100.0, "pct")
    classes = meta.join(abund.select("sample_id").distinct(), "sample_id", "left_semi").select("sample_id", by)
    sizes = classes.groupBy(by).agg(F.count(F.lit(1)).alias("n_type"))
    typed = percent.join(classes, "sample_id")
    sums = typed.groupBy("feature_id", by).agg(
        F.sum("count").alias("count_in_type"), F.count(F.lit(1)).alias("num_samples_in_type"), F.sum("pct").alias("_pct")
    )
    level_list = sizes.agg(F.collect_list(F.struct(by, "n_type"))).scalar()
    grid = abund.select("feature_id").distinct().select("feature_id", F.inline(level_list))
    full = grid.join(sums, ["feature_id", by], "left").na.fill(0, ["count_in_type", "num_samples_in_type", "_pct"])
    zeros = full.select(
        "feature_id", by, F.lit(0.0).alias("pct"), (F.col("n_type") - F.col("num_samples_in_type")).alias("n")
    ).filter(F.col("n") > 0)
    counted = counted_values(typed, ["feature_id", by], "pct").unionByName(zeros)
    medians = quantiles_of_counts(counted, ["feature_id", by], "pct", [0.5], ["med_abund_in_type"])
    out = full.join(medians, ["feature_id", by]).select(
        "feature_id",
        by,
        "count_in_type",
        "num_samples_in_type",
        (F.col("_pct") / F.col("n_type")).alias("av_abund_in_type"),
        "med_abund_in_type",
    )
    score = F.round(F.col("med_abund_in_type") * F.col("num_samples_in_type"), 9)
    order = [score.desc(), F.col("count_in_type").desc(), F.col("feature_id").asc(), F.col(by).asc()]
    ranked = global_index(out, order, "overall_rank")
    per_type = Window.partitionBy("_k", by).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    band = F.floor((F.col("overall_rank") - 1) / 65536)
    ranked = ranked.withColumn("_band", band).withColumn("_k", F.lit(0))
    bands = ranked.groupBy("_k", by, "_band").agg(F.count(F.lit(1)).alias("_n"))
    bands = bands.select("_k", by, "_band", F.coalesce(F.sum("_n").over(per_type), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_k", by, "_band").orderBy("overall_rank"))
    return (
        ranked.join(bands, ["_k", by, "_band"])
        .withColumn("within_type_rank", F.col("_base") + inside)
        .drop("_k", "_band", "_base")
    )


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, *by: str) -> DataFrame:
    """Counts in equal bins over [low, high]; values outside are left out, ``high`` belongs to the last bin."""
    width = (high - low) / bins
    position = F.floor((F.col(value) - F.lit(low)) / F.lit(width)).cast("int")
    return (
        df.filter(F.col(value).between(low, high))
        .withColumn("bin", F.least(position, F.lit(bins - 1)))
        .groupBy(*by, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bin_low", F.lit(low) + F.col("bin") * F.lit(width))
    )


def box_stats(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Minimum, quartiles, maximum and size per group."""
    names = ["min", "q1", "median", "q3", "max"]
    stats = quantiles(df, list(by), value, [0.0, 0.25, 0.5, 0.75, 1.0], names)
    return stats.join(df.groupBy(*by).agg(F.count(value).alias("n")), list(by))


def running_total(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Cumulative sum in time order. Meant for result tables with one row per group and time point."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))


def consecutive(df: DataFrame, first: str, second: str, levels: Sequence) -> DataFrame:
    """Keep rows whose two time points are neighbours among the ordered levels."""
    pairs = [x for a, b in zip(levels, levels[1:]) for x in (F.lit(a), F.lit(b))]
    return df.filter(F.try_element_at(F.create_map(*pairs), F.col(first)) == F.col(second))


def nest(df: DataFrame, key: str, size: int = 1000) -> DataFrame:
    """Rows of each key as arrays of structs, in numbered cells of about ``size`` rows.

    Keys are counted first and get as many cells as they need. Equal rows are counted too, so that they leave as one row: it begins at
    the cell its hash names and deals its copies in turn. Cells follow from the rows alone, not from partitions; cells without rows are absent.
    """
    rest = [c for c in df.columns if c != key]
    counted = df.groupBy(key, *rest).agg(F.count(F.lit(1)).alias("_n"))
    cells = counted.groupBy(F.col(key).alias("_key")).agg(F.ceil(F.sum("_n") / F.lit(size)).alias("_cells"))
    met = counted.join(cells, F.col(key).eqNullSafe(F.col("_key"))).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least("_n", "_cells") - 1)))
    copies = F.floor(F.col("_n") / F.col("_cells")) + (F.col("_i") < F.col("_n") % F.col("_cells")).cast("bigint")
    cell = F.pmod(F.pmod(F.xxhash64(*rest), F.col("_cells")) + F.col("_i"), F.col("_cells")).cast("int")
    dealt = met.select(key, cell.alias("cell"), F.array_repeat(F.struct(*rest), copies.cast("int")).alias("_rows"))
    return dealt.groupBy(key, "cell").agg(F.array_sort(F.flatten(F.collect_list("_rows"))).alias("data"))


def unnest(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.inline("data"))


def to_wide(abund: DataFrame, features: Sequence[str]) -> DataFrame:
    """One column per listed feature; absent cells are zero."""
    wide = abund.groupBy("sample_id").pivot("feature_id", list(features)).agg(F.sum("count"))
    return wide.na.fill(0)


def to_long(wide: DataFrame, keep_zero: bool = False) -> DataFrame:
    long = wide.unpivot("sample_id", [c for c in wide.columns if c != "sample_id"], "feature_id", "count")
    return long if keep_zero else long.filter(F.col("count") > 0)


def agglomerate(abund: DataFrame, tax: DataFrame, ranks: Sequence[str]) -> DataFrame:
    """Sum counts by lineage down to the last given rank."""
    return abund.join(tax.select("feature_id", *ranks), "feature_id").groupBy("sample_id", *ranks).agg(F.sum("count").alias("count"))


def read_tracking(events: DataFrame, sample: str, stage: str, stages: Sequence[str]) -> DataFrame:
    """Reads per sample after each stage, with the overall share kept."""
    wide = events.groupBy(sample).pivot(stage, list(stages)).agg(F.count(F.lit(1))).na.fill(0)
    kept = F.try_divide(F.col(stages[-1]).cast("double"), F.col(stages[0]).cast("double"))
    return wide.withColumn("kept", kept)


def composition(abund: DataFrame, meta: DataFrame, tax: DataFrame, condition: Column, ranks: Sequence[str]) -> DataFrame:
    """Summed relative abundance per feature and lineage over the chosen samples."""
    chosen = abund.join(meta.filter(condition).select("sample_id"), "sample_id", "left_semi")
    rel = relative_abundance(chosen)
    totals = rel.groupBy("feature_id").agg(F.sum("rel").alias("tot_abund"))
    return totals.join(tax.select("feature_id", *ranks), "feature_id", "left")


def class_membership(abund: DataFrame, meta: DataFrame, classes: Sequence[str], by: str = "sample_type") -> DataFrame:
    """Per feature: which sample classes it occurs in, one flag per class."""
    seen = abund.filter(F.col("count") > 0).join(meta.select("sample_id", by), "sample_id")
    return seen.groupBy("feature_id").agg(*[F.max(F.col(by) == c).alias(f"in_{c}") for c in classes])


def stage_comparison(stages: dict[str, DataFrame]) -> DataFrame:
    """Features, samples, smallest and summed depth of a count table at each cleaning stage."""
    out = None
    for name, abund in stages.items():
        depth = sample_sums(abund).agg(
            F.count(F.lit(1)).alias("samples"), F.min("total").alias("min_depth"), F.sum("total").alias("reads")
        )
        features = abund.agg(F.count_distinct("feature_id").alias("n")).scalar()
        row = depth.select(F.lit(name).alias("stage"), features.alias("features"), "samples", "min_depth", "reads")
        out = row if out is None else out.unionByName(row)
    return out
