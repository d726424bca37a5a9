"""Scalar expressions used when cleaning ids, factors, taxonomy and result tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANKS = ["domain", "phylum", "class", "order", "family", "genus", "species"]


def _c(col) -> Column:
    return col if isinstance(col, Column) else F.col(col)


def normalise_id(col) -> Column:
    """Every dash becomes an underscore."""
    return F.translate(_c(col), "-", "_")


def replace_first(col, pattern: str, replacement: str) -> Column:
    """Replace the first match only. ``$1`` etc. in the replacement refer to groups of ``pattern``."""
    shifted = re.sub(r"\$(\d+)", lambda m: f"${int(m.group(1)) + 1}", replacement)
    rest = f"${re.compile(pattern).groups + 2}"
    return F.regexp_replace(_c(col), rf"(?s)\A(.*?)(?:{pattern})(.*)\z", "$1" + shifted + rest)


def extract(col, pattern: str, group: int = 1) -> Column:
    """The given capture group of the first match; null when nothing matches."""
    return F.when(_c(col).rlike(pattern), F.regexp_extract(_c(col), pattern, group))


def classify(col, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """First matching regular expression decides the label."""
    out = None
    for pattern, label in rules:
        hit = _c(col).rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(default) if out is None else out.otherwise(default)


def keep_if(condition: Column, col, otherwise) -> Column:
    return F.when(condition, _c(col)).otherwise(F.lit(otherwise))


def group_key(*cols, sep: str = "_") -> Column:
    """Join values with a separator; a null shows as NA."""
    return F.concat_ws(sep, *[F.coalesce(_c(c).cast("string"), F.lit("NA")) for c in cols])


def parse_coefficient(col) -> Column:
    """``variable_level_vs_reference`` to a struct of its three parts."""
    parts = F.split(F.regexp_replace(_c(col), "_vs_", "_"), "_")
    return F.struct(
        F.get(parts, F.lit(0)).alias("variable"),
        F.get(parts, F.lit(1)).alias("level"),
        F.get(parts, F.lit(2)).alias("reference"),
    )


def recode(col, mapping: Mapping[str, str]) -> Column:
    """Exact-value recode; values outside the mapping stay."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _c(col)), _c(col))


def significant(col, digits: int = 2) -> Column:
    """Round to significant digits; zero stays zero."""
    x = _c(col).cast("double")
    shift = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    up = F.pow(F.lit(10.0), F.greatest(shift, F.lit(0)))
    down = F.pow(F.lit(10.0), F.greatest(-shift, F.lit(0)))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * up / down, 0) / up * down)


def significant_all(df: DataFrame, digits: int = 2) -> DataFrame:
    """Apply :func:`significant` to every floating-point column."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: significant(n, digits) for n in floats})


def flag_below(p, alpha: float = 0.05, otherwise=False) -> Column:
    return F.when(_c(p) < alpha, F.lit(True)).otherwise(F.lit(otherwise).cast("boolean"))


def null_unclassified(col) -> Column:
    return F.when(~F.startswith(_c(col), F.lit("unclassified_")), _c(col))


def pick_ranks(rank_names, taxa, ranks: Sequence[str] = RANKS) -> list[Column]:
    """Two parallel arrays (rank name, taxon) to one column per wanted rank."""
    lookup = F.map_from_arrays(_c(rank_names), _c(taxa))
    return [F.try_element_at(lookup, F.lit(r)).alias(r) for r in ranks]


def backfill_lineage(tax: DataFrame, ranks: Sequence[str] = RANKS) -> DataFrame:
    """Fill empty ranks from their parent: ``<parent>_unclassified``, never doubled."""
    filled = {ranks[0]: F.coalesce(F.col(f"`{ranks[0]}`"), F.lit("unclassified"))}
    parent = filled[ranks[0]]
    for rank in ranks[1:]:
        raw = F.coalesce(F.col(f"`{rank}`"), F.concat(parent, F.lit("_unclassified")))
        filled[rank] = parent = replace_first(raw, "unclassified_unclassified", "unclassified")
    return tax.withColumns(filled)


def level_index(col, levels: Sequence[str]) -> Column:
    """Position of a value among ordered factor levels; the first level (0) is the reference."""
    pairs = [x for i, v in enumerate(levels) for x in (F.lit(v), F.lit(i))]
    return F.try_element_at(F.create_map(*pairs), _c(col))


def ordered_pair(a, b) -> Column:
    return F.struct(F.least(_c(a), _c(b)).alias("low"), F.greatest(_c(a), _c(b)).alias("high"))


def direction(lfc, level, reference) -> Column:
    return F.when(_c(lfc) > 0, _c(level)).otherwise(_c(reference))
