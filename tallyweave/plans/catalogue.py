"""Named group comparisons as a table: which design cells form the two sides of each comparison."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.countset import CountSet
from tallyweave.operators import distance, permanova
from tallyweave.plans.explore import PARTS, explore
from tallyweave.session import checkpointed


@dataclass(frozen=True)
class Comparison:
    """``sides`` maps a level (reference first) to the design cells it pools.

    Of a comparison's samples, features stay with more than ``min_total`` counts in more than ``min_prevalence`` samples.
    """

    name: str
    variable: str
    sides: tuple[tuple[str, tuple[tuple, ...]], ...]
    min_total: int = 0
    min_prevalence: int = 0

    @property
    def levels(self) -> list[str]:
        return [level for level, _ in self.sides]


def trial_catalogue() -> list[Comparison]:
    """The vaccine and challenge questions A to G; design cells are (vaccine, challenge, day after challenge)."""
    mock_before = (("Mock", "Mock", -1), ("Mock", "Reading", -1))
    vaccines = {"BBS866": "F", "AVIPRO": "G"}
    infantis = {v: ((v, "Infantis", 10),) for v in ("Mock", "BBS866", "AVIPRO")}
    before = {v: ((v, "Reading", -1),) for v in vaccines}
    out = [
        Comparison(f"A{i}", "vaccine", (("Mock", mock_before), (v, before[v]))) for i, v in enumerate(vaccines, 1)
    ]
    pooled = tuple(cell for v in vaccines for cell in before[v])
    out.append(Comparison("A3", "vaccinated", (("Mock", mock_before), ("Vaccinated", pooled))))
    out.append(Comparison("B1", "challenge", (("Mock", (("Mock", "Mock", 14),)), ("Infantis", infantis["Mock"]))))
    for letter, v in zip("CD", vaccines):
        out.append(Comparison(f"{letter}1", "vaccine", (("Mock", infantis["Mock"]), (v, infantis[v]))))
    days = (2, 7, 14, 21)
    for i, day in enumerate(days, 1):
        sides = (("Mock", (("Mock", "Mock", day),)), ("Reading", (("Mock", "Reading", day),)))
        out.append(Comparison(f"E{i}", "challenge", sides, min_prevalence=5))
    for v, letter in vaccines.items():
        for i, day in enumerate(days, 1):
            sides = (("Mock", (("Mock", "Reading", day),)), (v, ((v, "Reading", day),)))
            out.append(Comparison(f"{letter}{i}", "vaccine", sides, min_prevalence=5))
    return out


def as_table(spark: SparkSession, comparisons: Sequence[Comparison], types: str) -> DataFrame:
    """One row per (comparison, level, design cell), with the comparison's limits."""
    rows = [(c.name, c.variable, level, c.min_total, c.min_prevalence, *cell) for c in comparisons for level, cells in c.sides for cell in cells]
    return spark.createDataFrame(rows, f"comparison string, variable string, grp string, min_total bigint, min_prevalence bigint, {types}")


def members(catalogue: DataFrame, meta: DataFrame, on: Sequence[str]) -> DataFrame:
    """``(comparison, sample_id, grp)`` for all comparisons at once."""
    return catalogue.join(meta, list(on)).select("comparison", "sample_id", "grp")


def pruned(catalogue: DataFrame, abund: DataFrame, meta: DataFrame, on: Sequence[str]) -> DataFrame:
    """``comparison, grp, sample_id, feature_id, count``: the counts of each comparison's samples without its rare features.

    All comparisons at once: one grouped count per (comparison, feature), joined back.
    """
    own = catalogue.join(meta, list(on)).select("comparison", "sample_id", "grp", "min_total", "min_prevalence")
    counts = own.join(abund.filter(F.col("count") > 0), "sample_id")
    seen = counts.groupBy("comparison", "feature_id").agg(
        F.sum("count").alias("_total"), F.count_distinct("sample_id").alias("_samples"), F.first("min_total").alias("_t"), F.first("min_prevalence").alias("_p")
    )
    kept = seen.filter((F.col("_total") > F.col("_t")) & (F.col("_samples") > F.col("_p"))).select("comparison", "feature_id")
    return counts.join(kept, ["comparison", "feature_id"]).select("comparison", "grp", "sample_id", "feature_id", "count")


def permanova_all(counts: DataFrame, permutations: int = 999, seed: int | str = 1) -> DataFrame:
    """A permutation test of every comparison of ``pruned`` counts on distances of its own features, in one job."""
    one = F.concat_ws("/", "comparison", "sample_id").alias("sample_id")
    counts = checkpointed(counts)
    dist = distance.bray_curtis(counts.select("comparison", one, "feature_id", "count"), ["comparison"])
    return permanova.permanova(checkpointed(dist.drop("comparison")), counts.select("comparison", one, "grp").distinct(), permutations, seed, walk=True)


def explore_all(cs: CountSet, comparisons: Sequence[Comparison], on: Sequence[str], types: str, parts: Sequence[str] = PARTS, **options) -> dict[str, DataFrame]:
    """``explore`` for each comparison of a catalogue on its pruned counts; parts of all comparisons in one table with ``comparison`` in front.

    A catalogue is a short list written by hand: its comparisons are planned one after the other, each as Spark jobs over its rows.
    """
    spark = cs.abund.sparkSession
    counts = checkpointed(pruned(as_table(spark, comparisons, types), cs.abund, cs.meta, on))
    out: dict[str, DataFrame] = {}
    for c in comparisons:
        own = counts.filter(F.col("comparison") == c.name)
        # a comparison's level takes the place of any column of that name
        # columns of their own beside the counts, from which they come as well
        level = own.select(F.col("sample_id").alias("sample_id"), F.col("grp").alias(c.variable)).distinct()
        meta = level.join(cs.meta.drop(c.variable), "sample_id")
        found = explore(CountSet(own.select("sample_id", "feature_id", "count"), meta, cs.tax), c.variable, c.levels, parts=parts, **options)
        for part, df in found.items():
            named = df.withColumnRenamed(c.variable, "grp").select(F.lit(c.name).alias("comparison"), "*")
            out[part] = named if part not in out else out[part].unionByName(named)
    return out
