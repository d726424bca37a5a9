"""Queries over contamination, linear models and differential abundance."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tallyweave.countset import CountSet
from tallyweave.functions import ranking as R
from tallyweave.operators import chunkmodels, cleaning, contamination, diffabund, distance, diversity, models, outliers, permanova, regularised, summaries
from tallyweave.plans import catalogue, standin
from tallyweave.plans.explore import explore
from tallyweave.plans.queries_diversity import _bray_sql, _permanova_sql
from tallyweave.plans.registry import query
from tallyweave.plans.standin import with_
from tallyweave.session import checkpointed, scratch_path
from tallyweave.sources.delimited import write_by_key

REGIONS = ["R0", "R1", "R2", "R3", "R4"]
SEGMENTS = ["BUILDING", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _r(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _t_p(t: str, df: str) -> str:
    """Two-sided t tail for whole degrees of freedom, as the finite trigonometric series."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    even = (
        f"1 - sin({angle}) * list_sum(list_transform(range(0, ({df} - 2) // 2 + 1), "
        f"lambda k: exp(lgamma(k + 0.5e0) - lgamma(k + 1.0e0) - lgamma(0.5e0)) * pow(cos({angle}), 2 * k)))"
    )
    odd = (
        f"1 - 2 / pi() * ({angle} + CASE WHEN {df} > 1 THEN sin({angle}) * list_sum(list_transform(range(0, ({df} - 3) // 2 + 1), "
        f"lambda k: exp(lgamma(k + 1.0e0) + lgamma(1.5e0) - lgamma(k + 1.5e0)) * pow(cos({angle}), 2 * k + 1))) ELSE 0 END)"
    )
    return f"CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END"


# -- contamination ------------------------------------------------------------------------------------------------

_FISHER = """, seen AS (SELECT feature_id, count(*) FILTER (is_neg) AS k, count(*) FILTER (NOT is_neg) AS kp
      FROM {abund} JOIN meta USING (sample_id) GROUP BY 1),
    ns AS (SELECT count(*) FILTER (is_neg) AS nn, count(*) AS na FROM meta WHERE sample_id IN (SELECT sample_id FROM {abund})),
    tabs AS (SELECT DISTINCT k, kp, nn, na FROM seen, ns),
    lf AS (SELECT k, kp, nn, na, list_transform(range(k, least(nn, k + kp) + 1), lambda j:
      CASE WHEN nn - j > na - k - kp THEN 0 ELSE exp(lgamma(k + kp + 1.0e0) - lgamma(j + 1.0e0) - lgamma(k + kp - j + 1.0e0)
      + lgamma(na - k - kp + 1.0e0) - lgamma(nn - j + 1.0e0) - lgamma(na - k - kp - nn + j + 1.0e0)
      - lgamma(na + 1.0e0) + lgamma(nn + 1.0e0) + lgamma(na - nn + 1.0e0)) END) AS pr FROM tabs),
    scores AS (SELECT feature_id, s.kp AS pa_pos, s.k AS pa_neg, CASE WHEN s.k + s.kp <= 1 THEN NULL WHEN s.k + s.kp = na THEN 0.5e0
      ELSE list_sum(pr) - pr[1] / 2 END AS p FROM seen s JOIN lf USING (k, kp))"""


@query(
    "m1_prevalence_contaminants",
    with_("sparse", "meta") + _FISHER.format(abund="sparse")
    + " SELECT feature_id, pa_pos, pa_neg, round(p, 9) AS p, coalesce(p < 0.1, false) AS contaminant FROM scores",
)
def m1(spark, sf):
    out = contamination.prevalence_scores(standin.sparse(spark, sf), standin.meta(spark, sf), 0.1, "fisher")
    return _r(out, 9, "p").select("feature_id", "pa_pos", "pa_neg", "p", "contaminant")


@query("m1_prevalence_contaminants_auto")
def m1_auto(spark, sf):
    out = contamination.prevalence_scores(standin.sparse(spark, sf), standin.meta(spark, sf), 0.5)
    return _r(out, 9, "p")


@query(
    "m2_clean",
    with_("sparse", "meta")
    + """, good AS (SELECT * FROM sparse WHERE sample_id NOT IN (SELECT sample_id FROM meta WHERE depth_hint < 0)),
    k1 AS (SELECT * FROM good WHERE feature_id IN (SELECT feature_id FROM good GROUP BY 1 HAVING sum(count) > 1))"""
    + _FISHER.format(abund="k1")
    + """, k2 AS (SELECT k1.* FROM k1 JOIN meta USING (sample_id) WHERE sample_type = 'exp'
       AND feature_id IN (SELECT feature_id FROM scores WHERE NOT coalesce(p < 0.1, false)))
    SELECT * FROM k2 WHERE feature_id IN (SELECT feature_id FROM k2 GROUP BY 1 HAVING sum(count) > 1)""",
)
def m2(spark, sf):
    meta = standin.meta(spark, sf)
    cs = CountSet(standin.sparse(spark, sf), meta, standin.tax(spark, sf))
    return contamination.clean(cs, meta.filter(F.col("depth_hint") < 0), 0.1, "fisher").abund


# -- linear models ------------------------------------------------------------------------------------------------

_CELLS = """, st AS (SELECT {keys} {grp} AS g, count(*) AS n, avg({y}) AS m, var_pop({y}) * count(*) AS ss FROM {src} WHERE {y} IS NOT NULL GROUP BY ALL),
    po AS (SELECT {keys} CAST(sum(n) - count(*) AS BIGINT) AS df, sqrt(sum(ss) / (sum(n) - count(*))) AS s FROM st GROUP BY ALL)"""

_ONE_WAY = """, terms AS (SELECT {keys} CASE WHEN st.g = '{ref}' THEN '(Intercept)' ELSE '{factor}' || st.g END AS term,
      CASE WHEN st.g = '{ref}' THEN st.m ELSE st.m - r.m END AS estimate,
      s * sqrt(1.0e0 / st.n + CASE WHEN st.g = '{ref}' THEN 0 ELSE 1.0e0 / r.n END) AS std_error, df
    FROM st JOIN po {using} JOIN (SELECT * FROM st WHERE g = '{ref}') r {using})"""


@query(
    "m6_one_way_model",
    with_("assay") + _CELLS.format(keys="", grp="grp", y="value", src="assay")
    + _ONE_WAY.format(keys="", ref="BUILDING", factor="grp", using="ON true")
    + f""" SELECT term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error, df,
    round(estimate / std_error, 7) AS statistic, round({_t_p("estimate / std_error", "df")}, 8) AS p_value FROM terms""",
)
def m6(spark, sf):
    out = models.one_way(standin.assay(spark, sf), "value", "grp", SEGMENTS).drop("conf_low", "conf_high")
    return _r(_r(_r(out, 6, "estimate", "std_error"), 7, "statistic"), 8, "p_value")


@query("m6_one_way_intervals")
def m6_intervals(spark, sf):
    out = models.one_way(standin.assay(spark, sf), "value", "grp", SEGMENTS)
    return _r(out.select("term", "estimate", "conf_low", "conf_high"), 6, "estimate", "conf_low", "conf_high")


@query(
    "m4_imputation_sensitivity",
    with_("assay")
    + """, runs AS (SELECT seed, grp, log10(coalesce(value, 1 + CAST('0x' || substr(md5(seed || '/' || id), 1, 8) AS BIGINT) % 20)) AS y
      FROM (SELECT id, grp, CASE WHEN value > 0 THEN value END AS value FROM assay), range(1, 101) s(seed))"""
    + _CELLS.format(keys="seed,", grp="grp", y="y", src="runs")
    + _ONE_WAY.format(keys="seed,", ref="BUILDING", factor="grp", using="USING (seed)")
    + f""" SELECT seed, term, round(estimate, 7) AS estimate, round(std_error, 7) AS std_error, df,
    round(estimate / std_error, 6) AS statistic, round({_t_p("estimate / std_error", "df")}, 7) AS p_value FROM terms""",
)
def m4(spark, sf):
    assay = standin.assay(spark, sf).withColumn("value", F.when(F.col("value") > 0, F.col("value")))
    out = models.imputation_sensitivity(assay, "value", "grp", SEGMENTS, ["id"]).drop("conf_low", "conf_high")
    return _r(_r(_r(out, 7, "estimate", "std_error"), 6, "statistic"), 7, "p_value")


_SHANNON_DENSE = with_("dense", "meta") + """, y AS (SELECT d.sample_id, grp, ln(sum(count)) - sum(count * ln(count)) / sum(count) AS shannon
    FROM dense d JOIN meta USING (sample_id) GROUP BY 1, 2)"""

_SHANNON_COURSE = with_("course", "course_meta") + """, y AS (SELECT c.sample_id, room, day, ln(sum(count)) - sum(count * ln(count)) / sum(count) AS shannon
    FROM course c JOIN course_meta USING (sample_id) GROUP BY 1, 2, 3)"""


def _shannon_course(spark, sf):
    return diversity.shannon(standin.course(spark, sf)).join(standin.course_meta(spark, sf), "sample_id")


@query(
    "m9_pairwise_contrasts",
    _SHANNON_DENSE + _CELLS.format(keys="", grp="grp", y="shannon", src="y")
    + f""", ct AS (SELECT a.g || ' - ' || b.g AS contrast, a.m - b.m AS estimate, s * sqrt(1.0e0 / a.n + 1.0e0 / b.n) AS std_error, df
      FROM st a JOIN st b ON a.g < b.g JOIN po ON true),
    tp AS (SELECT *, estimate / std_error AS statistic, {_t_p("estimate / std_error", "df")} AS p FROM ct)
    SELECT contrast, round(estimate, 9) AS estimate, round(std_error, 9) AS std_error, df, round(statistic, 6) AS statistic, round(p, 7) AS p_value,
    round(least(min(raw) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 7) AS adj_p_value
    FROM (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS raw FROM tp)""",
)
def m9(spark, sf):
    alpha = diversity.shannon(standin.dense(spark, sf)).join(standin.meta(spark, sf), "sample_id")
    out = models.pairwise_contrasts(alpha, "shannon", "grp", REGIONS)
    return _r(_r(_r(out, 9, "estimate", "std_error"), 6, "statistic"), 7, "p_value", "adj_p_value")


_BY_DAY = (
    _SHANNON_COURSE
    + """, st AS (SELECT day, room AS g, count(*) AS n, avg(shannon) AS m, var_pop(shannon) * count(*) AS ss FROM y GROUP BY 1, 2),
    po AS (SELECT CAST(sum(n) - count(*) AS BIGINT) AS df, sqrt(sum(ss) / (sum(n) - count(*))) AS s FROM st),
    ct AS (SELECT a.day, a.g || ' - ' || b.g AS contrast, a.m - b.m AS estimate, s * sqrt(1.0e0 / a.n + 1.0e0 / b.n) AS std_error, df
      FROM st a JOIN st b ON a.day = b.day AND a.g < b.g JOIN po ON true),"""
    + f" tp AS (SELECT *, {_t_p('estimate / std_error', 'df')} AS p FROM ct)"
)


@query(
    "m9_contrasts_within_day",
    _BY_DAY + """ SELECT day, contrast, round(estimate, 9) AS estimate, round(std_error, 9) AS std_error, df, round(p, 7) AS p_value,
    round(least(min(raw) OVER (PARTITION BY day ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 7) AS adj_p_value
    FROM (SELECT *, p * count(*) OVER (PARTITION BY day) / count(*) OVER (PARTITION BY day ORDER BY p) AS raw FROM tp)""",
)
def m9_day(spark, sf):
    out = models.pairwise_contrasts(_shannon_course(spark, sf), "shannon", "room", REGIONS, by=["day"]).drop("statistic")
    return _r(_r(out, 9, "estimate", "std_error"), 7, "p_value", "adj_p_value")


@query(
    "m16_pooled_fdr",
    _BY_DAY + """, sets AS (SELECT * FROM tp WHERE NOT (day = 6 AND contrast = 'R0 - R1')),
    raws AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS raw FROM sets),
    adj AS (SELECT *, least(min(raw) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS fdr FROM raws)
    SELECT 'D' || day AS comparison, contrast, round(estimate, 9) AS estimate, round(p, 7) AS p_value, round(fdr, 7) AS fdr FROM adj WHERE fdr < 0.999""",
)
def m16(spark, sf):
    sets = models.pairwise_contrasts(_shannon_course(spark, sf), "shannon", "room", REGIONS, by=["day"])
    sets = sets.filter(~((F.col("day") == 6) & (F.col("contrast") == "R0 - R1"))).drop("adj_p_value")
    pooled = R.benjamini_hochberg(checkpointed(sets), "p_value", out="fdr").filter(F.col("fdr") < 0.999)
    out = pooled.select(F.concat(F.lit("D"), F.col("day").cast("string")).alias("comparison"), "contrast", "estimate", "p_value", "fdr")
    path = scratch_path(spark, "m16")
    write_by_key(_r(_r(out, 9, "estimate"), 7, "p_value", "fdr"), path)
    return spark.read.csv(
        path, sep="\t", header=True, schema="contrast string, estimate double, p_value double, fdr double, comparison string"
    )


@query(
    "m7_two_way_model",
    _SHANNON_COURSE
    + f""", st AS (SELECT day, room AS g, count(*) AS n, avg(shannon) AS m, var_pop(shannon) * count(*) AS ss FROM y GROUP BY 1, 2),
    po AS (SELECT CAST(sum(n) - count(*) AS BIGINT) AS df, sqrt(sum(ss) / (sum(n) - count(*))) AS s FROM st),
    c AS (SELECT st.*, a.n AS na, a.m AS ma, b.n AS nb, b.m AS mb, z.n AS nz, z.m AS mz, df, s FROM st
      JOIN (SELECT * FROM st WHERE g = 'R0') a ON a.day = st.day JOIN (SELECT * FROM st WHERE day = 0) b ON b.g = st.g
      JOIN (SELECT * FROM st WHERE day = 0 AND g = 'R0') z ON true JOIN po ON true),
    e AS (SELECT CASE WHEN day = 0 AND g = 'R0' THEN '(Intercept)' WHEN g = 'R0' THEN 'day' || day WHEN day = 0 THEN 'room' || g
        ELSE 'day' || day || ':room' || g END AS term, df,
      CASE WHEN day = 0 AND g = 'R0' THEN m WHEN day = 0 OR g = 'R0' THEN m - mz ELSE m - ma - mb + mz END AS estimate,
      s * sqrt(CASE WHEN day = 0 AND g = 'R0' THEN 1.0e0 / n WHEN day = 0 OR g = 'R0' THEN 1.0e0 / n + 1.0e0 / nz
        ELSE 1.0e0 / n + 1.0e0 / na + 1.0e0 / nb + 1.0e0 / nz END) AS std_error FROM c)
    SELECT term, df, round(estimate, 9) AS estimate, round(std_error, 9) AS std_error, round({_t_p("estimate / std_error", "df")}, 7) AS p_value FROM e""",
)
def m7(spark, sf):
    out = models.two_way(_shannon_course(spark, sf), "shannon", "day", list(range(7)), "room", REGIONS)
    out = out.select("term", "df", "estimate", "std_error", "p_value")
    return _r(_r(out, 9, "estimate", "std_error"), 7, "p_value")


@query(
    "m8_marginal_means",
    _SHANNON_COURSE
    + """, st AS (SELECT day, room, count(*) AS n, avg(shannon) AS m, var_pop(shannon) * count(*) AS ss FROM y GROUP BY 1, 2)
    SELECT room, day, round(m, 9) AS emmean, round((SELECT sqrt(sum(ss) / (sum(n) - count(*))) FROM st) / sqrt(n), 9) AS se,
    (SELECT CAST(sum(n) - count(*) AS BIGINT) FROM st) AS df FROM st""",
)
def m8(spark, sf):
    out = models.marginal_means(_shannon_course(spark, sf), "shannon", ["room", "day"])
    return _r(out, 9, "emmean", "se").drop("lower_cl", "upper_cl")


@query("m8_marginal_mean_limits")
def m8_limits(spark, sf):
    out = models.marginal_means(_shannon_course(spark, sf), "shannon", ["room", "day"])
    return _r(out, 7, "emmean", "se", "lower_cl", "upper_cl")


# -- counts -------------------------------------------------------------------------------------------------------

_POOLED = """, pooled_counts AS (SELECT grp AS sample_id, feature_id, CAST(sum(count) AS BIGINT) AS count
    FROM dense JOIN meta USING (sample_id) GROUP BY 1, 2)"""


def _pooled_counts(spark, sf):
    joined = standin.dense(spark, sf).join(standin.meta(spark, sf).select("sample_id", "grp"), "sample_id")
    return joined.groupBy(F.col("grp").alias("sample_id"), "feature_id").agg(F.sum("count").alias("count"))


_RATIO = """, n AS (SELECT count(DISTINCT sample_id) AS n FROM {t}),
    g AS (SELECT feature_id, sum(ln(count)) / any_value(n) AS lg, count(*) AS seen, any_value(n) AS n FROM {t}, n GROUP BY 1),
    sf AS (SELECT sample_id, quantile_cont(ln(count) - lg, 0.5) AS lf FROM {t} JOIN g USING (feature_id) WHERE {cond} GROUP BY 1)"""


@query(
    "m5_size_factors",
    with_("dense", "meta") + _POOLED + _RATIO.format(t="pooled_counts", cond="seen = n")
    + " SELECT sample_id, round(exp(lf), 9) AS size_factor FROM sf",
)
def m5(spark, sf):
    return _r(diffabund.size_factors(_pooled_counts(spark, sf), "ratio"), 9, "size_factor")


@query(
    "m5_size_factors_positive_counts",
    with_("sparse") + _RATIO.format(t="sparse", cond="true")
    + " SELECT sample_id, round(exp(lf - (SELECT avg(lf) FROM sf)), 9) AS size_factor FROM sf",
)
def m5_pos(spark, sf):
    return _r(diffabund.size_factors(standin.sparse(spark, sf), "poscounts"), 9, "size_factor")


@query(
    "m13_stabilised",
    with_("course") + _RATIO.format(t="course", cond="true")
    + " SELECT sample_id, feature_id, round(log2(count / exp(lf - (SELECT avg(lf) FROM sf)) + 0.5e0), 7) AS value FROM course JOIN sf USING (sample_id)",
)
def m13(spark, sf):
    abund = standin.course(spark, sf)
    return _r(diffabund.stabilised(abund, diffabund.size_factors(abund, "poscounts")), 7, "value")


def _wald(spark, sf):
    meta = standin.course_meta(spark, sf)
    design, names = diffabund.factor_design(meta, "room", REGIONS)
    return diffabund.wald_tests(standin.course(spark, sf), design, names)


@query("m10_wald_tests")
def m10(spark, sf):
    return _r(_wald(spark, sf), 5, "base_mean", "dispersion", "log2fc", "lfc_se", "statistic", "p_value", "padj")


@query("m10_wald_covariate")
def m10_covariate(spark, sf):
    """Against a continuous covariate, one sample per supplier."""
    design, names = diffabund.covariate_design(standin.meta(spark, sf), "depth_hint")
    design = design.withColumn("x", F.transform("x", lambda v, i: F.when(i == 0, v).otherwise(v / 10000)))
    out = diffabund.wald_tests(standin.dense(spark, sf), design, names)
    return _r(out, 5, "base_mean", "dispersion", "log2fc", "lfc_se", "statistic", "p_value", "padj")


@query("m12_shrunken_fold_changes")
def m12(spark, sf):
    return _r(diffabund.shrink(_wald(spark, sf)), 5, "log2fc", "lfc_se", "log2fc_shrunk").select(
        "feature_id", "coefficient", "log2fc", "lfc_se", "log2fc_shrunk"
    )


# group means, moment dispersions drawn to a trend: the one-way model with equal size factors, of the samples and rooms in dg
_GROUP_MODEL = """, gn AS (SELECT room, count(*) AS n FROM dg GROUP BY 1),
    al AS (SELECT sum(n) AS nn, count(*) AS p FROM gn),
    fg AS (SELECT feature_id, room, n, coalesce(t, 0) AS t, coalesce(t2, 0) AS t2 FROM (SELECT DISTINCT feature_id FROM course WHERE sample_id IN (SELECT sample_id FROM dg)) CROSS JOIN gn
      LEFT JOIN (SELECT feature_id, room, sum(count) AS t, sum(count * count) AS t2 FROM course JOIN dg USING (sample_id) GROUP BY 1, 2) USING (feature_id, room)),
    mo AS (SELECT feature_id, base_mean, greatest((ss / (nn - p) - base_mean) / (base_mean * base_mean), 1e-4) AS moment FROM (
      SELECT feature_id, sum(t) / CAST(any_value(nn) AS DOUBLE) AS base_mean, sum(t2) - sum(t * t / CAST(n AS DOUBLE)) AS ss, any_value(nn) AS nn, any_value(p) AS p FROM fg, al GROUP BY 1)),
    ft AS (SELECT greatest(coalesce(covar_samp(moment, 1 / base_mean) / nullif(var_samp(1 / base_mean), 0), 0), 0) AS a1, avg(moment) AS m, avg(1 / base_mean) AS mi FROM mo),
    ds AS (SELECT feature_id, base_mean, exp((nn - p) / (nn - p + 10.0e0) * ln(moment) + (1 - (nn - p) / (nn - p + 10.0e0)) * ln(greatest(m - a1 * mi, 1e-3) + a1 / base_mean)) AS dispersion
      FROM mo, ft, al),
    gm AS (SELECT feature_id, room, t / CAST(n AS DOUBLE) AS mu, n FROM fg)"""
_ONE_WAY = (
    with_("course", "course_meta") + ", dg AS (SELECT sample_id, room FROM course_meta)" + _GROUP_MODEL
    + """, wg AS (SELECT *, n * mu / (1 + dispersion * mu) AS w, min(mu) OVER (PARTITION BY feature_id) AS least FROM gm JOIN ds USING (feature_id))
    SELECT a.feature_id, 'room_' || b.room || '_vs_R0' AS coefficient, round(a.base_mean, 4) AS base_mean, round(a.dispersion, 4) AS dispersion,
    round(log2(b.mu / a.mu), 4) AS log2fc, round(sqrt(1 / a.w + 1 / b.w) / ln(2), 4) AS lfc_se
    FROM wg a JOIN wg b ON a.feature_id = b.feature_id AND a.room = 'R0' AND b.room <> 'R0' WHERE a.least > 0"""
)


@query("m10_wald_one_way", _ONE_WAY)
def m10_one_way(spark, sf):
    """Groups alone and equal size factors, for features met in every group: the case with a closed form."""
    meta, abund = standin.course_meta(spark, sf), standin.course(spark, sf)
    design, names = diffabund.factor_design(meta, "room", REGIONS)
    factors = meta.select("sample_id", F.lit(1.0).alias("size_factor"))
    out = chunkmodels.wald_tests(abund, design, names, factors, chunk=64)
    everywhere = abund.join(meta, "sample_id").groupBy("feature_id").agg(F.count_distinct("room").alias("rooms")).filter(F.col("rooms") == len(REGIONS))
    out = out.join(everywhere, "feature_id", "left_semi")
    return _r(out, 4, "base_mean", "dispersion", "log2fc", "lfc_se").select("feature_id", "coefficient", "base_mean", "dispersion", "log2fc", "lfc_se")


# two against one coefficient over three rooms: the p-value of two degrees of freedom is exp(-statistic / 2)
_THREE_ROOMS = (
    with_("course", "course_meta") + ", dg AS (SELECT sample_id, room FROM course_meta WHERE room IN ('R0', 'R1', 'R2'))" + _GROUP_MODEL
    + """, lr AS (SELECT feature_id, base_mean, dispersion, greatest(2 * (sum(t * ln(greatest(mu, 1e-300)) - (t + n / dispersion) * ln(1 + dispersion * mu))
      - (sum(t) * ln(base_mean) - (sum(t) + sum(n) / dispersion) * ln(1 + dispersion * base_mean))), 0) AS statistic
      FROM gm JOIN fg USING (feature_id, room, n) JOIN ds USING (feature_id) GROUP BY 1, 2, 3 HAVING min(mu) > 0),
    pv AS (SELECT *, exp(-statistic / 2) AS p FROM lr)"""
)


def _three_rooms(spark, sf):
    meta, abund = standin.course_meta(spark, sf), standin.course(spark, sf)
    rooms = REGIONS[:3]
    design, names = diffabund.factor_design(meta, "room", rooms)
    out = chunkmodels.likelihood_ratio_tests(abund, design, names, 1, meta.select("sample_id", F.lit(1.0).alias("size_factor")), chunk=64)
    met = abund.join(meta.filter(F.col("room").isin(rooms)), "sample_id").groupBy("feature_id").agg(F.count_distinct("room").alias("rooms"))
    return out.join(met.filter(F.col("rooms") == len(rooms)), "feature_id", "left_semi")


@query(
    "m11_one_way_ratio_tests",
    _THREE_ROOMS + " SELECT feature_id, round(base_mean, 4) AS base_mean, round(dispersion, 4) AS dispersion, round(statistic, 4) AS statistic, round(p, 5) AS p_value FROM pv",
)
def m11_one_way(spark, sf):
    out = _r(_three_rooms(spark, sf), 4, "base_mean", "dispersion", "statistic")
    return _r(out, 5, "p_value").select("feature_id", "base_mean", "dispersion", "statistic", "p_value")


@query(
    "m10_independent_filter",
    _THREE_ROOMS
    + f""", th AS (SELECT unnest(generate_series(0, 49)) AS step, unnest(q) AS lim
      FROM (SELECT quantile_cont(base_mean, [{", ".join(f"{0.95 * i / 49!r}e0" for i in range(50))}]) AS q FROM pv)),
    rk AS (SELECT step, lim, p, count(*) OVER (PARTITION BY step ORDER BY p RANGE UNBOUNDED PRECEDING) AS r, count(*) OVER (PARTITION BY step) AS m
      FROM th JOIN pv ON base_mean >= lim),
    hs AS (SELECT step, lim, coalesce(max(r) FILTER (WHERE p * m / r <= 0.5e0), 0) AS hits FROM rk GROUP BY 1, 2),
    bs AS (SELECT lim, hits FROM hs ORDER BY hits DESC, step LIMIT 1),
    rw AS (SELECT feature_id, p, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS raw FROM pv, bs WHERE base_mean >= lim),
    aj AS (SELECT feature_id, least(min(raw) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING), 1.0e0) AS padj FROM rw)
    SELECT feature_id, round(base_mean, 4) AS base_mean, round(lim, 4) AS mean_limit, round(p, 5) AS p_value, round(padj, 5) AS padj
    FROM pv LEFT JOIN aj USING (feature_id), bs""",
)
def m10_filtered(spark, sf):
    """Features of low mean left out at the limit that leaves most hits, at a false-discovery rate of one half (the stand-in groups hardly differ)."""
    out = outliers.independent_filter(_three_rooms(spark, sf).withColumn("coefficient", F.lit("room")), alpha=0.5)
    out = _r(_r(out, 4, "base_mean", "limit"), 5, "p_value", "padj")
    return out.select("feature_id", "base_mean", F.col("limit").alias("mean_limit"), "p_value", "padj")


@query("m10_without_outliers")
def m10_replaced(spark, sf):
    design, names = diffabund.factor_design(standin.course_meta(spark, sf), "room", REGIONS)
    out = outliers.wald_without_outliers(standin.course(spark, sf), design, names, chunk=64)
    return _r(out, 5, "log2fc", "lfc_se", "padj").select("feature_id", "coefficient", "log2fc", "lfc_se", "padj", "replaced", "unclear")


@query("m13_regularised_log")
def m13_regularised(spark, sf):
    design, names = diffabund.factor_design(standin.course_meta(spark, sf), "room", REGIONS)
    return _r(regularised.regularised_log(standin.course(spark, sf), design, len(names), chunk=64), 6, "value")


@query("m11_chunked_ratio_tests")
def m11_chunked(spark, sf):
    meta = standin.course_meta(spark, sf)
    design, names, reduced = diffabund.interaction_design(meta, "room", REGIONS, "day")
    out = chunkmodels.likelihood_ratio_tests(standin.course(spark, sf), design, names, reduced, chunk=64)
    return _r(out, 5, "base_mean", "dispersion", "statistic", "log2fc", "p_value", "padj")


@query("m12_heavy_tailed_fold_changes")
def m12_heavy(spark, sf):
    return _r(chunkmodels.shrink_heavy_tailed(_wald(spark, sf)), 5, "log2fc", "lfc_se", "log2fc_shrunk", "lfc_sd").select(
        "feature_id", "coefficient", "log2fc", "lfc_se", "log2fc_shrunk", "lfc_sd"
    )


def _ratio_tests(spark, sf, levels):
    meta = standin.course_meta(spark, sf)
    design, names, reduced = diffabund.interaction_design(meta, "room", levels, "day")
    return diffabund.likelihood_ratio_tests(standin.course(spark, sf), design, names, reduced)


@query("m11_likelihood_ratio_tests")
def m11(spark, sf):
    return _r(_ratio_tests(spark, sf, REGIONS), 5, "base_mean", "dispersion", "statistic", "log2fc", "p_value", "padj")


def _time_cells(spark, sf):
    return diffabund.design_cells(standin.course_meta(spark, sf), "room", "day")


def _profiles(spark, sf):
    abund = standin.course(spark, sf)
    values = diffabund.stabilised(abund, diffabund.size_factors(abund, "poscounts"))
    return diffabund.profiles(values, standin.course_meta(spark, sf), "room", "day", _time_cells(spark, sf))


@query(
    "m14_profiles",
    with_("course", "course_meta") + _RATIO.format(t="course", cond="true")
    + """, v AS (SELECT sample_id, feature_id, log2(count / exp(lf - (SELECT avg(lf) FROM sf)) + 0.5e0) AS value FROM course JOIN sf USING (sample_id)),
    cs AS (SELECT room, day, count(*) AS n FROM course_meta GROUP BY 1, 2),
    nz AS (SELECT feature_id, room, day, count(*) AS k, sum(value) AS s FROM v JOIN course_meta USING (sample_id) GROUP BY 1, 2, 3),
    m AS (SELECT f.feature_id, cs.room, cs.day, (coalesce(s, 0) - (cs.n - coalesce(k, 0))) / cs.n AS m
      FROM (SELECT DISTINCT feature_id FROM v) f JOIN cs ON true LEFT JOIN nz ON nz.feature_id = f.feature_id AND nz.room = cs.room AND nz.day = cs.day)
    SELECT feature_id, room, day, round((m - avg(m) OVER (PARTITION BY feature_id)) / stddev_samp(m) OVER (PARTITION BY feature_id), 6) AS z FROM m""",
)
def m14_profiles(spark, sf):
    points = _profiles(spark, sf).select("feature_id", F.posexplode("profile").alias("cell", "z"))
    named = points.join(_time_cells(spark, sf), "cell")
    return named.select("feature_id", F.col("group").alias("room"), F.col("time").alias("day"), F.round("z", 6).alias("z"))


@query("m14_pattern_clusters")
def m14(spark, sf):
    return diffabund.pattern_clusters(_profiles(spark, sf)).select("feature_id", "cluster", "size")


@query("m14_cluster_profiles")
def m14_summary(spark, sf):
    return _r(diffabund.cluster_summary(diffabund.pattern_clusters(_profiles(spark, sf)), _time_cells(spark, sf)), 5, "z")


@query("m15_interesting_clusters")
def m15(spark, sf):
    """Clusters that fall over time in the reference room, with taxonomy, tallied by family over three comparisons."""
    clusters = diffabund.pattern_clusters(_profiles(spark, sf))
    falling = diffabund.cluster_summary(clusters, _time_cells(spark, sf)).filter(F.col("group") == "R0")
    slope = falling.groupBy("cluster").agg(F.covar_samp("time", "z").alias("slope")).filter(F.col("slope") < 0)
    chosen = clusters.join(slope, "cluster").select("feature_id")
    changed = {
        name: _ratio_tests(spark, sf, levels).join(chosen, "feature_id", "left_semi").filter(F.col("p_value") < 0.5).select("feature_id")
        for name, levels in (("E", ["R0", "R1"]), ("F", ["R0", "R2"]), ("G", ["R0", "R3"]))
    }
    named = cleaning.stack(changed, tag="comp").join(standin.tax_dense(spark, sf), "feature_id", "left")
    by_feature = summaries.tally(named, "feature_id").select(F.lit("feature").alias("level"), F.col("feature_id").alias("name"), "n")
    by_family = summaries.tally(named, "phylum").select(F.lit("phylum").alias("level"), F.col("phylum").alias("name"), "n")
    return by_feature.unionByName(by_family).orderBy(F.col("n").desc(), "name")


# -- composites ---------------------------------------------------------------------------------------------------


def _explored(spark, sf, part):
    cs = CountSet.aligned(
        standin.dense(spark, sf),
        standin.meta(spark, sf),
        standin.tax_dense(spark, sf),
    )
    return explore(cs, "grp", ["R2", "R3", "R4"], permutations=999, alpha=None, parts=[part])[part]


@query("m17_explore_differential")
def m17_differential(spark, sf):
    out = _explored(spark, sf, "differential")
    return _r(out.select("feature_id", "coefficient", "log2fc_shrunk", "padj", "enriched_in", "phylum"), 5, "log2fc_shrunk", "padj")


@query(
    "m17_explore_permanova",
    with_("dense", "meta", "tax_dense")
    + """, kept AS (SELECT * FROM dense WHERE sample_id IN (SELECT sample_id FROM meta WHERE grp IN ('R2', 'R3', 'R4'))
      AND feature_id IN (SELECT feature_id FROM tax_dense)),
    own AS (SELECT sample_id, grp FROM meta WHERE grp IN ('R2', 'R3', 'R4') AND sample_id IN (SELECT sample_id FROM kept))"""
    + _bray_sql("kept")
    + """, sides AS (SELECT a.grp AS grp1, b.grp AS grp2, a.grp || ' vs ' || b.grp AS pairs
      FROM (SELECT DISTINCT grp FROM own) a JOIN (SELECT DISTINCT grp FROM own) b ON a.grp < b.grp)"""
    + _permanova_sql("SELECT pairs AS comparison, sample_id, grp FROM sides JOIN own ON grp IN (grp1, grp2)", 999, "1")
    + """, adjusted AS (SELECT s.*, df, sums_of_sqs, f_model, r2, p_value,
      CASE WHEN p_value IS NOT NULL THEN least(p_value * count(p_value) OVER (), 1.0e0) END AS p_adj FROM tested t JOIN sides s ON s.pairs = t.comparison)
    SELECT pairs, grp1, grp2, df, round(sums_of_sqs, 6) AS sums_of_sqs, round(f_model, 6) AS f_model, round(r2, 6) AS r2,
    round(p_value, 6) AS p_value, round(p_adj, 6) AS p_adjusted,
    CASE WHEN p_adj <= 0.0001 THEN '***' WHEN p_adj <= 0.001 THEN '**' WHEN p_adj <= 0.01 THEN '*' WHEN p_adj <= 0.05 THEN '.' ELSE '' END AS sig
    FROM adjusted""",
)
def m17_permanova(spark, sf):
    return _r(_explored(spark, sf, "permanova"), 6, "sums_of_sqs", "f_model", "r2", "p_value", "p_adjusted")


@query("m17_explore_alpha")
def m17_alpha(spark, sf):
    return _r(_explored(spark, sf, "alpha_model"), 6, "estimate", "std_error", "statistic", "p_value", "conf_low", "conf_high")


@query("m17_explore_ordination")
def m17_ordination(spark, sf):
    out = _explored(spark, sf, "ordination").select("sample_id", "grp", "axis1", "axis2", "centroid_axis1", "centroid_axis2")
    return _r(out, 6, "axis1", "axis2", "centroid_axis1", "centroid_axis2")


def _room_catalogue() -> list[catalogue.Comparison]:
    """The same shape as the trial's questions: one room against the reference on each day, and all rooms lumped."""
    out = [
        catalogue.Comparison(f"{r}_D{d}", "room", (("R0", (("R0", d),)), (r, ((r, d),)))) for r in REGIONS[1:] for d in range(7)
    ]
    others = tuple((r, 0) for r in REGIONS[1:])
    return [*out, catalogue.Comparison("lumped_D0", "any", (("R0", (("R0", 0),)), ("other", others)))]


_CATALOGUE_SQL = """, members AS (SELECT r.room || '_D' || m.day AS comparison, sample_id, m.room AS grp FROM course_meta m
      JOIN (VALUES ('R1'), ('R2'), ('R3'), ('R4')) r(room) ON m.room IN ('R0', r.room)
      UNION ALL SELECT 'lumped_D0', sample_id, CASE WHEN room = 'R0' THEN 'R0' ELSE 'other' END FROM course_meta WHERE day = 0)"""


@query("m18_comparison_members", with_("course_meta") + _CATALOGUE_SQL + " SELECT * FROM members")
def m18(spark, sf):
    table = catalogue.as_table(spark, _room_catalogue(), "room string, day int")
    return catalogue.members(table, standin.course_meta(spark, sf), ["room", "day"])


@query(
    "m18_compare_all",
    with_("course", "course_meta") + _bray_sql("course")
    + _permanova_sql(_CATALOGUE_SQL.removeprefix(", members AS (").removesuffix(")"), 999, "18")
    + """ SELECT comparison, df, round(sums_of_sqs, 6) AS sums_of_sqs, round(f_model, 6) AS f_model, round(r2, 6) AS r2,
    round(p_value, 6) AS p_value FROM tested""",
)
def m18_all(spark, sf):
    """Every comparison of the catalogue through one permutation-test job."""
    dist = checkpointed(distance.bray_curtis(standin.course(spark, sf)))
    out = permanova.permanova(dist, m18(spark, sf), permutations=999, seed=18)
    return _r(out, 6, "sums_of_sqs", "f_model", "r2", "p_value")


def _limited_catalogue() -> list[catalogue.Comparison]:
    return [replace(c, min_total=5, min_prevalence=3) for c in _room_catalogue()]


_PRUNED = (
    with_("course", "course_meta") + _CATALOGUE_SQL
    + """, mc AS (SELECT comparison, grp, sample_id, feature_id, count FROM members JOIN course USING (sample_id)),
    pruned AS (SELECT * FROM mc WHERE (comparison, feature_id) IN (SELECT (comparison, feature_id) FROM mc
      GROUP BY comparison, feature_id HAVING sum(count) > 5 AND count(DISTINCT sample_id) > 3))"""
)


@query("m18_pruned_counts", _PRUNED + " SELECT * FROM pruned")
def m18_pruned(spark, sf):
    table = catalogue.as_table(spark, _limited_catalogue(), "room string, day int")
    return catalogue.pruned(table, standin.course(spark, sf), standin.course_meta(spark, sf), ["room", "day"])


@query(
    "m18_permanova_pruned",
    _PRUNED
    + """, ts AS (SELECT comparison, grp, sample_id, CAST(sum(count) AS DOUBLE) AS t FROM pruned GROUP BY 1, 2, 3),
    sh AS (SELECT a.comparison, a.sample_id AS x, b.sample_id AS y, sum(least(a.count, b.count)) AS s FROM pruned a JOIN pruned b
      ON a.comparison = b.comparison AND a.feature_id = b.feature_id AND a.sample_id < b.sample_id GROUP BY 1, 2, 3),
    dd AS (SELECT a.comparison, a.grp AS ga, b.grp AS gb, pow(1 - 2.0e0 * coalesce(s, 0) / (a.t + b.t), 2) AS d2 FROM ts a JOIN ts b ON a.comparison = b.comparison
      AND a.sample_id < b.sample_id LEFT JOIN sh ON sh.comparison = a.comparison AND x = a.sample_id AND y = b.sample_id),
    gn AS (SELECT comparison, grp, count(*) AS n FROM ts GROUP BY 1, 2), cn AS (SELECT comparison, sum(n) AS n, count(*) AS g FROM gn GROUP BY 1),
    wi AS (SELECT comparison, sum(s / n) AS ssw FROM (SELECT comparison, ga AS grp, sum(d2) AS s FROM dd WHERE ga = gb GROUP BY 1, 2) JOIN gn USING (comparison, grp) GROUP BY 1),
    al AS (SELECT comparison, sum(d2) AS s FROM dd GROUP BY 1)
    SELECT comparison, g - 1 AS df, round(s / n - ssw, 6) AS sums_of_sqs, round(((s / n - ssw) / (g - 1)) / (ssw / (n - g)), 6) AS f_model,
    round((s / n - ssw) / (s / n), 6) AS r2 FROM cn JOIN wi USING (comparison) JOIN al USING (comparison)""",
)
def m18_permanova(spark, sf):
    """The observed statistics of every comparison on its own pruned features; ``permanova_all`` adds p-values."""
    return _r(catalogue.permanova_all(m18_pruned(spark, sf), permutations=0).drop("p_value"), 6, "sums_of_sqs", "f_model", "r2")
