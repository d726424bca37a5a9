"""Queries over aggregates, reshaping and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.countset import CountSet
from tallyweave.functions import ranking as R
from tallyweave.functions.columns import normalise_id
from tallyweave.operators import cleaning, summaries
from tallyweave.plans import standin
from tallyweave.plans.registry import query
from tallyweave.plans.standin import table, with_


def _r(df, **digits):
    return df.withColumns({n: F.round(n, d) for n, d in digits.items()})


@query("a1_sample_sums", with_("sparse") + " SELECT sample_id, CAST(sum(count) AS BIGINT) AS read_depth FROM sparse GROUP BY 1")
def a1(spark, sf):
    return summaries.sample_sums(standin.sparse(spark, sf), "read_depth")


@query("a2_taxa_sums", with_("sparse") + " SELECT feature_id, CAST(sum(count) AS BIGINT) AS total FROM sparse GROUP BY 1")
def a2(spark, sf):
    return summaries.taxa_sums(standin.sparse(spark, sf))


@query(
    "a3_class_prevalence",
    with_("sparse", "meta")
    + """ SELECT feature_id, count(*) FILTER (NOT is_neg) AS pa_pos, count(*) FILTER (is_neg) AS pa_neg
    FROM sparse JOIN meta USING (sample_id) GROUP BY 1""",
)
def a3(spark, sf):
    return summaries.class_prevalence(standin.sparse(spark, sf), standin.meta(spark, sf))


@query(
    "a4_relative_abundance",
    with_("sparse") + """ SELECT sample_id, feature_id, 1 AS present,
    round(100.0e0 * count / sum(count) OVER (PARTITION BY sample_id), 9) AS pct FROM sparse""",
)
def a4(spark, sf):
    pct = summaries.relative_abundance(standin.sparse(spark, sf), 100.0, "pct")
    return summaries.presence(pct).select("sample_id", "feature_id", F.col("count").alias("present"), F.round("pct", 9).alias("pct"))


@query("a5_tally", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def a5(spark, sf):
    return summaries.tally(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_linenumber")


@query(
    "a6_contingency",
    """SELECT o_orderpriority, year(o_orderdate) AS yr, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS "F",
    nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS "O", nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS "P"
    FROM orders GROUP BY 1, 2""",
)
def a6(spark, sf):
    o = table(spark, sf, "orders").withColumn("yr", F.year("o_orderdate"))
    return summaries.contingency(o, ["o_orderpriority", "yr"], "o_orderstatus", ["F", "O", "P"])


@query(
    "a7_observed_features",
    with_("sparse", "meta")
    + " SELECT sample_id, grp, count(*) AS num_features FROM sparse JOIN meta USING (sample_id) GROUP BY 1, 2",
)
def a7(spark, sf):
    return summaries.observed_features(standin.sparse(spark, sf), standin.meta(spark, sf), "grp")


@query(
    "a8_feature_summary",
    with_("sparse") + """ SELECT feature_id, CAST(sum(count) AS BIGINT) AS tot_counts, count(*) AS num_samples,
    round(avg(count), 6) AS av_per_sample, quantile_cont(count, 0.5) AS med_per_sample FROM sparse GROUP BY 1""",
)
def a8(spark, sf):
    return _r(summaries.feature_summary(standin.sparse(spark, sf)), av_per_sample=6)


@query(
    "a9_feature_summary_by_type",
    with_("dense", "meta")
    + """, pct AS (SELECT sample_id, feature_id, count, 100.0e0 * count / sum(count) OVER (PARTITION BY sample_id) AS pct FROM dense),
    full_grid AS (SELECT f.feature_id, m.sample_type, coalesce(p.count, 0) AS count, coalesce(p.pct, 0.0e0) AS pct
      FROM (SELECT DISTINCT feature_id FROM dense) f
      JOIN (SELECT * FROM meta WHERE sample_id IN (SELECT sample_id FROM dense)) m ON true
      LEFT JOIN pct p ON p.feature_id = f.feature_id AND p.sample_id = m.sample_id),
    s AS (SELECT feature_id, sample_type, CAST(sum(count) AS BIGINT) AS count_in_type,
      count(*) FILTER (count > 0) AS num_samples_in_type, round(avg(pct), 7) AS av_abund_in_type,
      quantile_cont(pct, 0.5) AS med FROM full_grid GROUP BY 1, 2)
    SELECT feature_id, sample_type, count_in_type, num_samples_in_type, av_abund_in_type, round(med, 7) AS med_abund_in_type,
    row_number() OVER (ORDER BY round(med * num_samples_in_type, 9) DESC, count_in_type DESC, feature_id, sample_type) AS overall_rank,
    row_number() OVER (PARTITION BY sample_type ORDER BY round(med * num_samples_in_type, 9) DESC, count_in_type DESC, feature_id) AS within_type_rank
    FROM s""",
)
def a9(spark, sf):
    out = summaries.feature_summary_by_type(standin.dense(spark, sf), standin.meta(spark, sf))
    return _r(out, av_abund_in_type=7, med_abund_in_type=7)


@query("a10_sort", with_("sparse") + " SELECT sample_id, CAST(sum(count) AS BIGINT) AS total FROM sparse GROUP BY 1 ORDER BY total DESC, sample_id")
def a10(spark, sf):
    return summaries.sample_sums(standin.sparse(spark, sf)).orderBy(F.col("total").desc(), "sample_id")


@query(
    "a11_top_rows",
    with_("sparse") + " SELECT feature_id, CAST(sum(count) AS BIGINT) AS total FROM sparse GROUP BY 1 ORDER BY total DESC, feature_id LIMIT 100",
)
def a11(spark, sf):
    return summaries.taxa_sums(standin.sparse(spark, sf)).orderBy(F.col("total").desc(), "feature_id").limit(100)


@query("a12_frequency_table", with_("amplicon") + " SELECT length(seq) AS seq_length, count(*) AS n FROM amplicon GROUP BY 1")
def a12(spark, sf):
    lengths = standin.amplicon(spark, sf).select(F.length("seq").cast("bigint").alias("seq_length"))
    return summaries.tally(lengths, "seq_length")


@query(
    "a13_histogram",
    """SELECT l_returnflag, CAST(least(floor((l_extendedprice - 0) / 3000.0e0), 49) AS INTEGER) AS bin, count(*) AS n,
    least(floor((l_extendedprice - 0) / 3000.0e0), 49) * 3000.0e0 AS bin_low
    FROM lineitem WHERE l_extendedprice BETWEEN 0 AND 150000 GROUP BY 1, 2, 4""",
)
def a13(spark, sf):
    return summaries.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 0.0, 150000.0, 50, "l_returnflag")


@query(
    "a14_box_stats",
    """SELECT o_orderpriority, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 6) AS q1,
    round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.75), 6) AS q3,
    max(o_totalprice) AS max, count(*) AS n FROM orders GROUP BY 1""",
)
def a14(spark, sf):
    return _r(summaries.box_stats(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority"), q1=6, median=6, q3=6)


_COURSE_TOTALS = with_("course", "course_meta") + """, t AS (SELECT room, day, CAST(sum(count) AS BIGINT) AS total
    FROM course JOIN course_meta USING (sample_id) GROUP BY 1, 2)"""


def _course_totals(spark, sf):
    joined = standin.course(spark, sf).join(standin.course_meta(spark, sf), "sample_id")
    return joined.groupBy("room", "day").agg(F.sum("count").alias("total"))


@query("a15_running_total", _COURSE_TOTALS + " SELECT *, CAST(sum(total) OVER (PARTITION BY room ORDER BY day) AS BIGINT) AS cumulative FROM t")
def a15(spark, sf):
    return summaries.running_total(_course_totals(spark, sf), "total", ["room"], ["day"], "cumulative")


@query(
    "a16_consecutive_times",
    _COURSE_TOTALS
    + """ SELECT a.room, a.day AS day1, b.day AS day2, b.total - a.total AS change FROM t a JOIN t b
    ON a.room = b.room AND ((a.day = 0 AND b.day = 1) OR (a.day = 1 AND b.day = 3) OR (a.day = 3 AND b.day = 6))""",
)
def a16(spark, sf):
    t = _course_totals(spark, sf)
    later = t.select("room", F.col("day").alias("day2"), F.col("total").alias("total2"))
    both = t.withColumnRenamed("day", "day1").join(later, "room")
    return summaries.consecutive(both, "day1", "day2", [0, 1, 3, 6]).select(
        "room", "day1", "day2", (F.col("total2") - F.col("total")).alias("change")
    )


@query("a17_nest_unnest", _COURSE_TOTALS + " SELECT room, day, total FROM t")
def a17(spark, sf):
    return summaries.unnest(summaries.nest(_course_totals(spark, sf), "room"), "room")


@query(
    "a18_wide_and_long",
    """SELECT CAST(user_id AS VARCHAR) AS sample_id, event_type AS feature_id, count(*) AS count FROM events GROUP BY 1, 2""",
)
def a18(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("sample_id"), F.col("event_type").alias("feature_id"), F.lit(1).alias("count")
    )
    return summaries.to_long(summaries.to_wide(events, ["click", "error", "purchase", "signup", "view"]))


@query(
    "a19_melt",
    with_("sparse", "meta", "tax")
    + """ SELECT sample_id, feature_id, count, grp, sample_type, domain, phylum, "class", genus
    FROM sparse JOIN meta USING (sample_id) JOIN tax USING (feature_id)""",
)
def a19(spark, sf):
    cs = CountSet(standin.sparse(spark, sf), standin.meta(spark, sf), standin.tax(spark, sf))
    return cs.melt().select("sample_id", "feature_id", "count", "grp", "sample_type", "domain", "phylum", "class", "genus")


@query(
    "a20_agglomerate",
    with_("sparse", "tax")
    + """ SELECT sample_id, domain, phylum, "class", CAST(sum(count) AS BIGINT) AS count
    FROM sparse JOIN tax USING (feature_id) GROUP BY 1, 2, 3, 4""",
)
def a20(spark, sf):
    return summaries.agglomerate(standin.sparse(spark, sf), standin.tax(spark, sf), ["domain", "phylum", "class"])


@query(
    "a21_read_tracking",
    """SELECT user_id, view, click, signup, error, purchase, round(purchase / nullif(CAST(view AS DOUBLE), 0), 9) AS kept FROM (
      SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click,
      count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'error') AS error,
      count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1)""",
)
def a21(spark, sf):
    stages = ["view", "click", "signup", "error", "purchase"]
    return _r(summaries.read_tracking(table(spark, sf, "events"), "user_id", "event_type", stages), kept=9)


_BH = """SELECT {keys}, p, round(least(min(raw) OVER (PARTITION BY {fam} ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0e0), 9) AS fdr
  FROM (SELECT *, p * count(*) OVER (PARTITION BY {fam}) / count(*) OVER (PARTITION BY {fam} ORDER BY p) AS raw FROM x)"""

_PVALUES = """x AS (SELECT o_orderkey, o_orderpriority, o_orderstatus,
    pow(CAST('0x' || substr(md5('p/' || o_orderkey), 1, 8) AS BIGINT) / 4294967296.0e0, 3) AS p FROM orders)"""


def _pvalues(spark, sf):
    from tallyweave.functions.draws import draw_int

    p = F.pow(draw_int("p", "o_orderkey") / F.lit(4294967296.0), F.lit(3))
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", p.alias("p"))


@query("a22_fdr_within_family", "WITH " + _PVALUES + " " + _BH.format(keys="o_orderkey, o_orderpriority", fam="o_orderpriority"))
def a22(spark, sf):
    out = R.benjamini_hochberg(_pvalues(spark, sf), "p", ["o_orderpriority"], "fdr")
    return _r(out, fdr=9).select("o_orderkey", "o_orderpriority", "p", "fdr")


@query("a22_fdr_global", "WITH " + _PVALUES + " " + _BH.format(keys="o_orderkey", fam="1"))
def a22_global(spark, sf):
    return _r(R.benjamini_hochberg(_pvalues(spark, sf), "p", out="fdr"), fdr=9).select("o_orderkey", "p", "fdr")


@query(
    "a22_bonferroni",
    "WITH " + _PVALUES + """ SELECT o_orderkey, round(least(p * count(*) OVER (), 1.0e0), 9) AS p_all,
    round(least(p * count(*) OVER (PARTITION BY o_orderstatus), 1.0e0), 9) AS p_status FROM x""",
)
def a22_bonf(spark, sf):
    out = R.bonferroni(_pvalues(spark, sf), "p", out="p_all")
    out = R.bonferroni(out, "p", ["o_orderstatus"], "p_status")
    return _r(out, p_all=9, p_status=9).select("o_orderkey", "p_all", "p_status")


@query(
    "a23_control_composition",
    with_("sparse", "meta", "tax")
    + """, chosen AS (SELECT s.* FROM sparse s JOIN meta USING (sample_id) WHERE sample_type = 'mock'),
    rel AS (SELECT feature_id, count / CAST(sum(count) OVER (PARTITION BY sample_id) AS DOUBLE) AS rel FROM chosen)
    SELECT feature_id, phylum, "class", "order", family, genus, round(sum(rel), 9) AS tot_abund
    FROM rel JOIN tax USING (feature_id) GROUP BY 1, 2, 3, 4, 5, 6 ORDER BY tot_abund DESC""",
)
def a23(spark, sf):
    ranks = ["phylum", "class", "order", "family", "genus"]
    mock = F.col("sample_type") == "mock"
    out = summaries.composition(standin.sparse(spark, sf), standin.meta(spark, sf), standin.tax(spark, sf), mock, ranks)
    return _r(out, tot_abund=9).orderBy(F.col("tot_abund").desc())


@query(
    "a24_class_membership",
    with_("sparse", "meta")
    + """ SELECT feature_id, bool_or(sample_type = 'mock') AS in_mock, bool_or(sample_type = 'neg') AS in_neg,
    bool_or(sample_type = 'exp') AS in_exp FROM sparse JOIN meta USING (sample_id) GROUP BY 1""",
)
def a24(spark, sf):
    return summaries.class_membership(standin.sparse(spark, sf), standin.meta(spark, sf), ["mock", "neg", "exp"])


@query(
    "a25_before_after_cleaning",
    with_("sparse", "meta")
    + """, post AS (SELECT s.* FROM sparse s JOIN meta USING (sample_id) WHERE sample_type = 'exp'),
    stages AS (SELECT 'post' AS stage, * FROM post UNION ALL SELECT 'pre', * FROM sparse),
    depth AS (SELECT stage, sample_id, sum(count) AS total FROM stages GROUP BY 1, 2)
    SELECT d.stage, f.features, count(*) AS samples, CAST(min(total) AS BIGINT) AS min_depth, CAST(sum(total) AS BIGINT) AS reads
    FROM depth d JOIN (SELECT stage, count(DISTINCT feature_id) AS features FROM stages GROUP BY 1) f USING (stage) GROUP BY 1, 2""",
)
def a25(spark, sf):
    cs = CountSet(standin.sparse(spark, sf), standin.meta(spark, sf), standin.tax(spark, sf))
    return summaries.stage_comparison({"pre": cs.abund, "post": cs.keep_samples(F.col("sample_type") == "exp").abund})


@query("a26_levels", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def a26(spark, sf):
    return table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority").distinct()


# -- joins --------------------------------------------------------------------------------------------------------


@query(
    "j1_results_to_taxonomy",
    with_("sparse", "tax")
    + """, t AS (SELECT feature_id, CAST(sum(count) AS BIGINT) AS total FROM sparse GROUP BY 1)
    SELECT t.feature_id, total, domain, phylum, genus FROM t LEFT JOIN (SELECT * FROM tax WHERE family IS NOT NULL) x USING (feature_id)""",
)
def j1(spark, sf):
    named = standin.tax(spark, sf).filter(F.col("family").isNotNull()).select("feature_id", "domain", "phylum", "genus")
    return summaries.taxa_sums(standin.sparse(spark, sf)).join(named, "feature_id", "left")


@query(
    "j2_results_to_metadata",
    with_("sparse", "meta") + """, d AS (SELECT sample_id, count(*) AS observed FROM sparse GROUP BY 1)
    SELECT d.*, grp, sample_type FROM d LEFT JOIN meta USING (sample_id)""",
)
def j2(spark, sf):
    d = standin.sparse(spark, sf).groupBy("sample_id").agg(F.count(F.lit(1)).alias("observed"))
    return d.join(standin.meta(spark, sf).select("sample_id", "grp", "sample_type"), "sample_id", "left")


@query(
    "j3_attach_assay",
    """SELECT o_orderkey, c_custkey IS NOT NULL AS matched, c_acctbal AS cfu FROM orders LEFT JOIN
    (SELECT * FROM customer WHERE c_acctbal >= 0) c ON o_custkey = c_custkey AND replace(o_orderpriority, '-', '_') =
      CASE c_mktsegment WHEN 'BUILDING' THEN '1_URGENT' WHEN 'MACHINERY' THEN '5_LOW' ELSE c_mktsegment END""",
)
def j3(spark, sf):
    assay = table(spark, sf, "customer").filter(F.col("c_acctbal") >= 0).withColumns(
        {"cfu": F.col("c_acctbal"), "matched": F.lit(True)}
    )
    out = cleaning.attach_assay(
        table(spark, sf, "orders"),
        assay,
        [F.col("o_custkey"), normalise_id("o_orderpriority")],
        [F.col("c_custkey"), F.col("c_mktsegment")],
        ["cfu", "matched"],
        {"c_mktsegment": {"BUILDING": "1_URGENT", "MACHINERY": "5_LOW"}},
    )
    return out.select("o_orderkey", F.coalesce("matched", F.lit(False)).alias("matched"), "cfu")


@query(
    "j4_align_tables",
    with_("sparse", "meta", "tax")
    + """ SELECT s.* FROM sparse s WHERE sample_id IN (SELECT sample_id FROM meta WHERE depth_hint > 0)
    AND feature_id IN (SELECT feature_id FROM tax WHERE domain IS NOT NULL)""",
)
def j4(spark, sf):
    return CountSet.aligned(
        standin.sparse(spark, sf),
        standin.meta(spark, sf).filter(F.col("depth_hint") > 0),
        standin.tax(spark, sf).filter(F.col("domain").isNotNull()),
    ).abund


@query(
    "j5_group_pairs",
    with_("course_meta")
    + """, g AS (SELECT room, day, count(*) AS n FROM course_meta GROUP BY 1, 2)
    SELECT a.room AS room1, a.day AS day1, a.n AS n1, b.room AS room2, b.day AS day2, b.n AS n2
    FROM g a JOIN g b ON (a.room, a.day) < (b.room, b.day)""",
)
def j5(spark, sf):
    groups = summaries.tally(standin.course_meta(spark, sf), "room", "day")
    pairs = R.pairs_of_groups(groups, [F.col("room"), F.col("day")])
    return pairs.select(
        F.col("_l.room").alias("room1"), F.col("_l.day").alias("day1"), F.col("_l.n").alias("n1"),
        F.col("_r.room").alias("room2"), F.col("_r.day").alias("day2"), F.col("_r.n").alias("n2"),
    )


@query(
    "j7_replicates",
    with_("assay") + """ SELECT seed, grp, count(*) AS n,
    CAST(sum(coalesce(value, 1 + CAST('0x' || substr(md5(seed || '/' || id), 1, 8) AS BIGINT) % 20) * 100) AS BIGINT) AS total
    FROM assay, range(1, 101) s(seed) GROUP BY 1, 2""",
)
def j7(spark, sf):
    from tallyweave.operators.models import replicate

    runs = replicate(standin.assay(spark, sf), 100)
    filled = cleaning.impute_missing(runs, "value", ["id"], seed=F.col("seed"))
    return filled.groupBy("seed", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("total")
    )
