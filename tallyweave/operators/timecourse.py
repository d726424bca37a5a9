"""Views of a pairwise permutation table whose groups are (room, day) sets.

Input columns: ``pairs, room1, day1, room2, day2, f_model, r2, p_value``. Adjustment runs over the family named in
each view, before any later filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.ranking import benjamini_hochberg
from tallyweave.operators import distance, permanova
from tallyweave.operators.cleaning import add_baseline
from tallyweave.operators.summaries import consecutive, running_total
from tallyweave.session import stored


def _reference_first(is_reference_1: Column) -> dict[str, Column]:
    """Order the two sides so that the reference is on the left."""
    pick = lambda a, b: F.when(is_reference_1, F.col(a)).otherwise(F.col(b))
    return {
        "ref_room": pick("room1", "room2"),
        "comp_room": pick("room2", "room1"),
        "ref_day": pick("day1", "day2"),
        "comp_day": pick("day2", "day1"),
    }


def within_day(pairwise: DataFrame, rooms: Sequence[str] = ()) -> DataFrame:
    """Pairs of rooms on the same day; the room earlier in ``rooms`` is the reference."""
    same = pairwise.filter(F.col("day1") == F.col("day2"))
    out = benjamini_hochberg(same, "p_value", out="fdr")
    if not rooms:
        return out.withColumns(_reference_first(F.lit(True)))
    rank = F.create_map(*[x for i, r in enumerate(rooms) for x in (F.lit(r), F.lit(i))])
    place = lambda c: F.coalesce(F.try_element_at(rank, F.col(c)), F.lit(len(rooms)))
    return out.withColumns(_reference_first(place("room1") <= place("room2")))


def within_day_against(pairwise: DataFrame, reference: str) -> DataFrame:
    """Same-day pairs that involve the reference room, adjusted over these pairs."""
    family = pairwise.filter(
        (F.col("day1") == F.col("day2")) & ((F.col("room1") == reference) | (F.col("room2") == reference))
    )
    out = benjamini_hochberg(family, "p_value", out="fdr")
    return out.withColumns(_reference_first(F.col("room1") == reference))


def within_room_against(pairwise: DataFrame, baseline: int) -> DataFrame:
    """Each room against its own baseline day, plus one constant baseline row per room."""
    family = pairwise.filter(
        (F.col("room1") == F.col("room2")) & ((F.col("day1") == baseline) | (F.col("day2") == baseline))
    )
    out = benjamini_hochberg(family, "p_value", out="fdr").withColumns(_reference_first(F.col("day1") == baseline))
    out = out.select("pairs", F.col("ref_room").alias("room"), F.col("comp_day").alias("day"), "f_model", "r2", "p_value", "fdr")
    out = add_baseline(out, ["room"], {"day": F.lit(baseline), "fdr": F.lit(1.0), "f_model": F.lit(1.0)})
    return out.withColumn("sig", F.when(F.col("fdr") < 0.05, F.lit(True)))


def cumulative_change(pairwise: DataFrame, days: Sequence[int]) -> DataFrame:
    """Consecutive days of each room with running F, adjusted over all within-room pairs."""
    family = pairwise.filter(F.col("room1") == F.col("room2"))
    out = benjamini_hochberg(family, "p_value", out="fdr").select(
        "pairs",
        F.col("room1").alias("room"),
        F.least("day1", "day2").alias("day1"),
        F.greatest("day1", "day2").alias("day2"),
        "f_model",
        "r2",
        "p_value",
        "fdr",
    )
    out = running_total(consecutive(out, "day1", "day2", list(days)), "f_model", ["room"], ["day1"], "cumulative_f")
    return out.withColumn("period", F.concat_ws(" vs ", F.col("day1").cast("string"), F.col("day2").cast("string")))




def rarefied_course(
    abund: DataFrame, meta: DataFrame, group: str, time: str, depth: int | None = None, iterations: int = 100, permutations: int = 9999, seed: int = 1
) -> DataFrame:
    """The pairwise table of all (group, time) sets on distances averaged over ``iterations`` rarefactions; every view above takes it.

    Reads are drawn cell by cell and permuted labels are computed by the samples themselves, so neither orders a whole sample or comparison.
    """
    averaged = stored(distance.average_rarefied_distance_by_cells(abund, depth, iterations, seed), "course-distances")
    known = meta.join(abund.select("sample_id").distinct(), "sample_id", "left_semi")
    return stored(permanova.pairwise_permanova(averaged, known, group, time, permutations=permutations, seed=seed, walk=True), "course-pairs")
