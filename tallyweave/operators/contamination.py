"""Contaminant features from their prevalence in negative controls."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.countset import CountSet
from tallyweave.functions.distributions import hypergeometric_mid_upper, normal_upper
from tallyweave.operators.summaries import class_prevalence
from tallyweave.session import checkpointed


def prevalence_scores(
    abund: DataFrame, meta: DataFrame, threshold: float = 0.1, method: str = "auto", is_neg: str = "is_neg"
) -> DataFrame:
    """Small p means: seen in controls more often than chance allows.

    ``fisher`` is the one-sided exact test with half the weight of the observed table; ``chisq`` the one-sided test of
    two proportions with continuity correction; ``auto`` uses the latter unless an expected cell is below 5. Features in
    one sample only have no score and pass. The test runs once per distinct 2 x 2 table, not per feature.
    """
    seen = class_prevalence(abund, meta, is_neg)
    classes = meta.join(abund.select("sample_id").distinct(), "sample_id", "left_semi")
    n_neg = classes.agg(F.count_if(F.col(is_neg)).alias("n")).scalar()
    n_all = classes.agg(F.count(F.lit(1)).alias("n")).scalar()
    tables = seen.select("pa_neg", "pa_pos").distinct().withColumns({"nn": n_neg, "na": n_all})
    k, both, nn, na = F.col("pa_neg"), F.col("pa_neg") + F.col("pa_pos"), F.col("nn"), F.col("na")
    share = both / na
    smallest = F.least(share, 1 - share) * F.least(nn, na - nn)
    diff = k / nn - F.col("pa_pos") / (na - nn)
    inv = F.lit(1.0) / nn + F.lit(1.0) / (na - nn)
    yates = F.least(F.lit(0.5), F.abs(diff) / inv)
    chisq = F.lit(0.0)
    for count, n in ((k, nn), (F.col("pa_pos"), na - nn)):
        off = F.greatest(F.abs(count - n * share) - yates, F.lit(0.0))
        chisq = chisq + F.try_divide(off * off, n * share) + F.try_divide(off * off, n * (1 - share))
    tables = tables.withColumns(
        {
            "exact": hypergeometric_mid_upper(k, nn, both, na),
            "normal": normal_upper(F.signum(diff) * F.sqrt(chisq)),
        }
    )
    use_exact = {"fisher": F.lit(True), "chisq": F.lit(False), "auto": smallest < 5}[method]
    p = (
        F.when((both <= 1) | (nn == 0) | (nn == na), F.lit(None))
        .when(both == na, F.lit(0.5))
        .otherwise(F.when(use_exact, F.col("exact")).otherwise(F.col("normal")))
    )
    scored = tables.select("pa_neg", "pa_pos", p.cast("double").alias("p"))
    out = seen.join(scored, ["pa_neg", "pa_pos"])
    return out.withColumn("contaminant", F.coalesce(F.col("p") < threshold, F.lit(False)))


def clean(
    cs: CountSet,
    bad_samples: DataFrame,
    threshold: float = 0.1,
    method: str = "auto",
    drop_types: Sequence[str] = ("neg", "mock"),
    sample_type: str = "sample_type",
) -> CountSet:
    """Bad samples out, singletons out, contaminants out, controls out, singletons out again; the order matters.

    Every step reads the counts it prunes twice, so the counts are stored between the steps.
    """

    def stored(s: CountSet) -> CountSet:
        return replace(s, abund=checkpointed(s.abund))

    kept = stored(cs.drop_samples(bad_samples).keep_by_total(1))
    scores = prevalence_scores(kept.abund, kept.meta, threshold, method)
    kept = stored(kept.keep_features(scores.filter(~F.col("contaminant"))))
    return kept.keep_samples(~F.col(sample_type).isin(list(drop_types))).keep_by_total(1)
