"""The bundle of counts, sample metadata and taxonomy."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CountSet:
    """``abund(sample_id, feature_id, count)`` with zeros absent, ``meta`` by sample, ``tax`` by feature."""

    abund: DataFrame
    meta: DataFrame
    tax: DataFrame

    @classmethod
    def aligned(cls, abund: DataFrame, meta: DataFrame, tax: DataFrame) -> CountSet:
        """Keep only samples and features known to all three tables."""
        abund = abund.filter(F.col("count") > 0)
        abund = abund.join(meta.select("sample_id"), "sample_id", "left_semi")
        abund = abund.join(tax.select("feature_id"), "feature_id", "left_semi")
        return cls(
            abund,
            meta.join(abund.select("sample_id").distinct(), "sample_id", "left_semi"),
            tax.join(abund.select("feature_id").distinct(), "feature_id", "left_semi"),
        )

    # -- pruning -------------------------------------------------------------------------------------------------

    def keep_samples(self, condition: Column) -> CountSet:
        """Keep samples whose metadata satisfy the condition; their counts follow."""
        meta = self.meta.filter(condition)
        return replace(self, meta=meta, abund=self.abund.join(meta.select("sample_id"), "sample_id", "left_semi"))

    def drop_samples(self, ids: DataFrame) -> CountSet:
        """Drop the samples listed in the ``sample_id`` column of ``ids``."""
        ids = ids.select("sample_id")
        return replace(
            self,
            meta=self.meta.join(ids, "sample_id", "left_anti"),
            abund=self.abund.join(ids, "sample_id", "left_anti"),
        )

    def keep_features(self, ids: DataFrame) -> CountSet:
        """Keep the features listed in the ``feature_id`` column of ``ids``."""
        ids = ids.select("feature_id")
        return replace(
            self,
            abund=self.abund.join(ids, "feature_id", "left_semi"),
            tax=self.tax.join(ids, "feature_id", "left_semi"),
        )

    def keep_by_total(self, more_than: int) -> CountSet:
        """Keep features whose summed count exceeds a bound."""
        totals = self.abund.groupBy("feature_id").agg(F.sum("count").alias("total"))
        return self.keep_features(totals.filter(F.col("total") > more_than))

    def keep_by_prevalence(self, more_than: int) -> CountSet:
        """Keep features detected in more than the given number of samples."""
        seen = self.abund.groupBy("feature_id").agg(F.count_if(F.col("count") > 0).alias("n"))
        return self.keep_features(seen.filter(F.col("n") > more_than))

    def with_read_depth(self, out: str = "read_depth") -> CountSet:
        """Store the current library size of each sample in the metadata."""
        sums = self.abund.groupBy("sample_id").agg(F.sum("count").alias(out))
        return replace(self, meta=self.meta.drop(out).join(sums, "sample_id", "left"))

    # -- combination ---------------------------------------------------------------------------------------------

    def merge(self, *others: CountSet) -> CountSet:
        """Union of bundles. A cell, sample or feature of several bundles is kept once; it must be the same in all."""
        abund, meta, tax = self.abund, self.meta, self.tax
        for other in others:
            abund = abund.unionByName(other.abund)
            meta = meta.unionByName(other.meta, allowMissingColumns=True)
            tax = tax.unionByName(other.tax, allowMissingColumns=True)
        cells = abund.groupBy("sample_id", "feature_id").agg(F.max("count").alias("count"), F.min("count").alias("_least"))
        meta, tax = meta.distinct(), tax.distinct()
        twice = lambda df, key: df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        for name, bad in (("counts", cells.filter("count <> _least")), ("samples", twice(meta, "sample_id")), ("features", twice(tax, "feature_id"))):
            if not bad.isEmpty():
                raise ValueError(f"bundles disagree about {name}, such as {bad.first().asDict()}")
        return CountSet(cells.drop("_least"), meta, tax)

    def melt(self) -> DataFrame:
        """One row per non-zero cell with all metadata and ranks."""
        return self.abund.join(self.meta, "sample_id").join(self.tax, "feature_id")

    # -- checks and storage --------------------------------------------------------------------------------------

    def unknown_samples(self) -> DataFrame:
        """Samples that have counts but no metadata; empty when the bundle is sound."""
        return self.abund.select("sample_id").distinct().join(self.meta, "sample_id", "left_anti")

    def save(self, path: str, mode: str = "errorifexists") -> None:
        for name in ("abund", "meta", "tax"):
            getattr(self, name).write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CountSet:
        return cls(*(spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in ("abund", "meta", "tax")))
