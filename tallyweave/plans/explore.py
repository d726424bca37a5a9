"""One comparison end to end: ordination, permutation tests, alpha diversity and differential abundance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.countset import CountSet
from tallyweave.operators import diffabund, diversity, models, ordination, permanova, rarefaction
from tallyweave.session import checkpointed


PARTS = ("ordination", "permanova", "alpha", "alpha_model", "differential")


def explore(
    cs: CountSet,
    variable: str,
    levels: Sequence[str],
    permutations: int = 999,
    seed: int = 1,
    alpha: float | None = 0.05,
    min_lfc: float = 0.5,
    parts: Sequence[str] = PARTS,
) -> dict[str, DataFrame]:
    """Results keyed by name; ``parts`` picks which ones to compute.

    ``ordination``    rarefied samples on two axes with the centre of their group
    ``permanova``     every pair of levels on distances of unrarefied counts
    ``alpha``         diversity of counts rarefied with another seed, with metadata
    ``alpha_model``   Shannon against the variable
    ``differential``  one block of features per non-reference level, shrunken, annotated and filtered
    """
    cs = cs.keep_samples(F.col(variable).isin(list(levels)))
    cs = CountSet(checkpointed(cs.abund), cs.meta, cs.tax)
    out: dict[str, DataFrame] = {}
    if "ordination" in parts:
        points = ordination.ordinate(rarefaction.rarefy(cs.abund, seed=f"{seed}/ordination"))
        out["ordination"] = ordination.centroids(points.join(cs.meta, "sample_id"), [variable], ["axis1", "axis2"])
    if "permanova" in parts:
        out["permanova"] = permanova.pairwise_permanova(None, cs.meta, variable, permutations=permutations, seed=seed, abund=cs.abund)
    if "alpha" in parts or "alpha_model" in parts:
        thin = rarefaction.rarefy(cs.abund, seed=f"{seed}/alpha")
        out["alpha"] = diversity.richness(thin).join(cs.meta, "sample_id", "left")
        out["alpha_model"] = models.one_way(out["alpha"], "shannon", variable, levels)
    if "differential" in parts:
        design, names = diffabund.factor_design(cs.meta, variable, levels)
        tested = diffabund.shrink(diffabund.wald_tests(cs.abund, design, names))
        out["differential"] = diffabund.annotate(tested, cs.tax, alpha, min_lfc, "log2fc_shrunk")
    return {name: out[name] for name in PARTS if name in parts}
