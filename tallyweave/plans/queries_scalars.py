"""Queries over scalar functions, filters and set logic."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.countset import CountSet
from tallyweave.functions import columns as C
from tallyweave.functions.ranking import global_index
from tallyweave.operators import cleaning
from tallyweave.plans import standin
from tallyweave.plans.registry import query
from tallyweave.plans.standin import table, with_


@query("p1_select_columns", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def p1(spark, sf):
    return cleaning.reorder(table(spark, sf, "customer"), first=["c_custkey"], drop_prefix="c_name")


@query(
    "p2_transmute",
    "SELECT c_custkey AS turkey_id, c_mktsegment AS room, c_acctbal * 2 AS doubled FROM customer",
)
def p2(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("turkey_id"), F.col("c_mktsegment").alias("room"), (F.col("c_acctbal") * 2).alias("doubled")
    )


@query("p3_mutate", "SELECT *, o_totalprice / 2 AS half, year(o_orderdate) AS order_year FROM orders")
def p3(spark, sf):
    return table(spark, sf, "orders").withColumns(
        {"half": F.col("o_totalprice") / 2, "order_year": F.year("o_orderdate")}
    )


@query("p4_normalise_id", "SELECT o_orderkey, replace(o_orderpriority, '-', '_') AS priority FROM orders")
def p4(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", C.normalise_id("o_orderpriority").alias("priority"))


@query(
    "p5_replace_first",
    r"""SELECT c_custkey, regexp_replace(c_name, '0', 'o') AS once,
    regexp_replace(c_name, '^(.*)#0*(.*)$', '\2_\1') AS swapped,
    CASE WHEN regexp_matches(c_name, '#0*([0-9]+)$') THEN regexp_extract(c_name, '#0*([0-9]+)$', 1) END AS trailing
    FROM customer""",
)
def p5(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        C.replace_first("c_name", "0", "o").alias("once"),
        C.replace_first("c_name", "^(.*)#0*(.*)$", "$2_$1").alias("swapped"),
        C.extract("c_name", "#0*([0-9]+)$").alias("trailing"),
    )


@query("p6_regex_predicate", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(small|blue) .*g')")
def p6(spark, sf):
    return table(spark, sf, "part").filter(F.col("p_name").rlike("^(small|blue) .*g")).select("p_partkey", "p_name")


@query(
    "p7_classify",
    """SELECT event_id, CASE WHEN regexp_matches(event_type, 'err') THEN 'neg'
    WHEN regexp_matches(event_type, 'sign') THEN 'mock' ELSE 'exp' END AS sample_type FROM events""",
)
def p7(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", C.classify("event_type", [("err", "neg"), ("sign", "mock")], "exp").alias("sample_type")
    )


@query(
    "p8_keep_if",
    with_("meta") + " SELECT sample_id, CASE WHEN sample_type = 'exp' THEN grp ELSE 'none' END AS grp FROM meta",
)
def p8(spark, sf):
    m = standin.meta(spark, sf)
    return m.select("sample_id", C.keep_if(F.col("sample_type") == "exp", "grp", "none").alias("grp"))


@query("p9_negative_flag", with_("meta") + " SELECT sample_id, sample_type = 'neg' AS flag FROM meta")
def p9(spark, sf):
    return standin.meta(spark, sf).select("sample_id", (F.col("sample_type") == "neg").alias("flag"))


@query(
    "p10_group_key",
    with_("tax") + """ SELECT feature_id,
    coalesce(domain, 'NA') || '_' || coalesce(phylum, 'NA') || '_' || coalesce("order", 'NA') AS k FROM tax""",
)
def p10(spark, sf):
    return standin.tax(spark, sf).select("feature_id", C.group_key("domain", "phylum", "order").alias("k"))


@query(
    "p11_parse_coefficient",
    """SELECT p_partkey, p_brand AS variable, split_part(p_name, ' ', 1) AS level, p_type AS reference FROM part""",
)
def p11(spark, sf):
    coef = F.concat("p_brand", F.lit("_"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("_vs_"), "p_type")
    return table(spark, sf, "part").select("p_partkey", C.parse_coefficient(coef).alias("s")).select("p_partkey", "s.*")


@query(
    "p12_recode",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Mock' WHEN 'MACHINERY' THEN 'BBS' ELSE c_mktsegment END
    AS segment FROM customer""",
)
def p12(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", C.recode("c_mktsegment", {"BUILDING": "Mock", "MACHINERY": "BBS"}).alias("segment")
    )


@query(
    "p13_cast_numeric",
    "SELECT event_id, try_cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k, "
    "try_cast(event_type AS DOUBLE) AS bad FROM events",
)
def p13(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        F.regexp_extract("props", "([0-9]+)", 1).try_cast("double").alias("k"),
        F.col("event_type").try_cast("double").alias("bad"),
    )


@query("p14_log10", with_("assay") + " SELECT id, round(log10(value + 1), 9) AS log10_value FROM assay")
def p14(spark, sf):
    return standin.assay(spark, sf).select("id", F.round(F.log10(F.col("value") + 1), 9).alias("log10_value"))


@query(
    "p15_significant_digits",
    """SELECT o_orderkey, round(CASE WHEN x = 0 THEN 0.0e0 ELSE round(x * up / down) / up * down END, 9) AS x2 FROM (
      SELECT o_orderkey, x, pow(10.0e0, greatest(1 - floor(log10(abs(x))), 0)) AS up,
             pow(10.0e0, greatest(floor(log10(abs(x))) - 1, 0)) AS down
      FROM (SELECT o_orderkey, o_totalprice / 7.0e0 / (1 + o_custkey) AS x FROM orders))""",
)
def p15(spark, sf):
    x = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 7.0 / (1 + F.col("o_custkey"))).alias("x2"))
    return C.significant_all(x, 2).withColumn("x2", F.round("x2", 9))


@query(
    "p16_flag_below",
    """SELECT l_orderkey, l_linenumber, l_discount < 0.05e0 AS sig,
    CASE WHEN l_discount < 0.05e0 THEN true END AS sig_or_null FROM lineitem""",
)
def p16(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        C.flag_below("l_discount").alias("sig"),
        C.flag_below("l_discount", otherwise=None).alias("sig_or_null"),
    )


@query("p17_sequence_length", with_("amplicon") + " SELECT read_id, length(seq) AS n FROM amplicon")
def p17(spark, sf):
    return standin.amplicon(spark, sf).select("read_id", F.length("seq").cast("bigint").alias("n"))


@query(
    "p18_null_unclassified",
    """SELECT p_partkey, CASE WHEN NOT starts_with(t, 'unclassified_') THEN t END AS t FROM
    (SELECT p_partkey, CASE WHEN p_size > 25 THEN 'unclassified_' ELSE '' END || p_type AS t FROM part)""",
)
def p18(spark, sf):
    t = F.concat(F.when(F.col("p_size") > 25, "unclassified_").otherwise(""), "p_type")
    return table(spark, sf, "part").select("p_partkey", C.null_unclassified(t).alias("t"))


@query(
    "p19_pick_ranks",
    """SELECT p_partkey, p_type AS domain, CASE WHEN p_size > 25 THEN p_brand END AS phylum,
    CAST(NULL AS VARCHAR) AS genus FROM part""",
)
def p19(spark, sf):
    big = F.col("p_size") > 25
    names = F.when(big, F.array(F.lit("root"), F.lit("phylum"), F.lit("domain"))).otherwise(F.array(F.lit("domain")))
    taxa = F.when(big, F.array(F.lit("Root"), F.col("p_brand"), F.col("p_type"))).otherwise(F.array("p_type"))
    return table(spark, sf, "part").select("p_partkey", *C.pick_ranks(names, taxa, ["domain", "phylum", "genus"]))


def _backfill_sql(columns: str) -> str:
    levels = C.RANKS
    sql = f"SELECT feature_id, sequence, coalesce(domain, 'unclassified') AS domain, {', '.join(chr(34) + r + chr(34) for r in levels[1:])} FROM tax"
    for i, rank in enumerate(levels[1:], 1):
        cols = [f'"{r}"' for r in levels]
        cols[i] = (
            f"""regexp_replace(coalesce("{rank}", "{levels[i - 1]}" || '_unclassified'), """
            f"""'unclassified_unclassified', 'unclassified') AS "{rank}\""""
        )
        sql = f"SELECT feature_id, sequence, {', '.join(cols)} FROM ({sql})"
    return f"SELECT {columns} FROM ({sql})"


@query("p20_lineage_backfill", with_("tax") + " " + _backfill_sql("*"))
def p20(spark, sf):
    return C.backfill_lineage(standin.tax(spark, sf))


_SURROGATE = """surrogate AS (SELECT feature_id, total,
  'ASV_' || row_number() OVER (ORDER BY total DESC, feature_id) AS asv
  FROM (SELECT feature_id, CAST(sum(count) AS BIGINT) AS total FROM sparse GROUP BY 1))"""


def _surrogate(spark, sf):
    totals = standin.sparse(spark, sf).groupBy("feature_id").agg(F.sum("count").alias("total"))
    ranked = global_index(totals, [F.col("total").desc(), F.col("feature_id").asc()])
    return ranked.select("feature_id", "total", F.concat(F.lit("ASV_"), F.col("idx").cast("string")).alias("asv"))


@query("p21_surrogate_id", with_("sparse") + ", " + _SURROGATE + " SELECT * FROM surrogate")
def p21(spark, sf):
    return _surrogate(spark, sf)


@query(
    "p22_rename_features",
    with_("sparse") + ", " + _SURROGATE + " SELECT sample_id, asv, count FROM sparse JOIN surrogate USING (feature_id)",
)
def p22(spark, sf):
    return standin.sparse(spark, sf).join(_surrogate(spark, sf), "feature_id").select("sample_id", "asv", "count")


@query("p23_named_rows", with_("tax") + " SELECT feature_id AS asv, phylum FROM tax")
def p23(spark, sf):
    return standin.tax(spark, sf).select(F.col("feature_id").alias("asv"), "phylum")


@query(
    "p24_level_index",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS level_idx FROM orders""",
)
def p24(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", C.level_index("o_orderstatus", ["P", "O", "F"]).alias("level_idx"))


@query(
    "p25_z_score",
    """SELECT s_suppkey, round((s_acctbal - avg(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER (), 6) AS z,
    round((s_acctbal - avg(s_acctbal) OVER (PARTITION BY s_nationkey))
      / nullif(stddev_samp(s_acctbal) OVER (PARTITION BY s_nationkey), 0), 6) AS z_nation FROM supplier""",
)
def p25(spark, sf):
    s = table(spark, sf, "supplier")
    out = cleaning.z_score(s, "s_acctbal", out="z")
    out = cleaning.z_score(out, "s_acctbal", ["s_nationkey"], out="z_nation")
    return out.select("s_suppkey", F.round("z", 6).alias("z"), F.round("z_nation", 6).alias("z_nation"))


@query(
    "p26_ordered_pair",
    "SELECT l_orderkey, l_linenumber, least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high FROM lineitem",
)
def p26(spark, sf):
    pair = C.ordered_pair("l_partkey", "l_suppkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", pair.alias("p")).select("l_orderkey", "l_linenumber", "p.*")


@query("p27_direction", "SELECT event_id, CASE WHEN value > 5 THEN event_type ELSE 'ref' END AS side FROM events")
def p27(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", C.direction(F.col("value") - 5, "event_type", F.lit("ref")).alias("side")
    )


# -- filters and set logic ----------------------------------------------------------------------------------------


def _set(spark, sf) -> CountSet:
    return CountSet(standin.sparse(spark, sf), standin.meta(spark, sf), standin.tax(spark, sf))


@query(
    "f1_row_filter",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND (l_returnflag IN ('A', 'R') OR l_discount = 0)",
)
def f1(spark, sf):
    hit = (F.col("l_quantity") > 10) & (F.col("l_returnflag").isin("A", "R") | (F.col("l_discount") == 0))
    return table(spark, sf, "lineitem").filter(hit).select("l_orderkey", "l_linenumber")


@query(
    "f2_keep_samples",
    with_("sparse", "meta") + " SELECT s.* FROM sparse s JOIN meta m USING (sample_id) WHERE sample_type = 'exp' AND grp <> 'R2'",
)
def f2(spark, sf):
    return _set(spark, sf).keep_samples((F.col("sample_type") == "exp") & (F.col("grp") != "R2")).abund


@query(
    "f3_drop_samples",
    with_("sparse", "meta") + " SELECT * FROM sparse WHERE sample_id NOT IN (SELECT sample_id FROM meta WHERE depth_hint < 0)",
)
def f3(spark, sf):
    low = standin.meta(spark, sf).filter(F.col("depth_hint") < 0)
    return _set(spark, sf).drop_samples(low).abund


@query(
    "f4_keep_by_total",
    with_("sparse") + """ SELECT * FROM sparse WHERE feature_id IN
    (SELECT feature_id FROM sparse GROUP BY 1 HAVING sum(count) > 30)""",
)
def f4(spark, sf):
    return _set(spark, sf).keep_by_total(30).abund


@query(
    "f5_keep_by_prevalence",
    with_("sparse") + """ SELECT * FROM sparse WHERE feature_id IN
    (SELECT feature_id FROM sparse GROUP BY 1 HAVING count(*) > 25)""",
)
def f5(spark, sf):
    return _set(spark, sf).keep_by_prevalence(25).abund


@query(
    "f6_keep_features",
    with_("sparse", "tax") + " SELECT * FROM sparse WHERE feature_id IN (SELECT feature_id FROM tax WHERE genus IS NOT NULL)",
)
def f6(spark, sf):
    good = standin.tax(spark, sf).filter(F.col("genus").isNotNull())
    return _set(spark, sf).keep_features(good).abund


@query("f7_length_band", with_("amplicon") + " SELECT sample_id, read_id, seq FROM amplicon WHERE length(seq) BETWEEN 18 AND 26")
def f7(spark, sf):
    return cleaning.length_band(standin.amplicon(spark, sf), 18, 26)


@query("f8_no_domain", with_("tax") + " SELECT feature_id FROM tax WHERE domain IS NULL")
def f8(spark, sf):
    return standin.tax(spark, sf).filter(F.col("domain").isNull()).select("feature_id")


@query(
    "f9_merge_bundles",
    with_("sparse", "meta")
    + " SELECT s.* FROM sparse s JOIN meta m USING (sample_id) WHERE grp IN ('R0', 'R1') OR depth_hint > 5000",
)
def f9(spark, sf):
    cs = _set(spark, sf)
    return cs.keep_samples(F.col("grp").isin("R0", "R1")).merge(cs.keep_samples(F.col("depth_hint") > 5000)).abund


@query(
    "f10_stack_with_fill",
    """SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal, CAST(NULL AS VARCHAR) AS segment, 'S' AS comp FROM supplier
    UNION ALL SELECT c_custkey, c_name, CAST(NULL AS DOUBLE), c_mktsegment, 'C' FROM customer""",
)
def f10(spark, sf):
    left = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    right = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return cleaning.stack({"S": left, "C": right}, tag="comp")


@query(
    "f11_intersect_ids",
    """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (
      SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_discount < 0.05e0
      INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount < 0.05e0)""",
)
def f11(spark, sf):
    items = table(spark, sf, "lineitem")
    low = items.filter(F.col("l_discount") < 0.05)
    both = cleaning.in_both(
        low.filter(F.col("l_returnflag") == "A"), low.filter(F.col("l_returnflag") == "R"), "l_partkey"
    )
    return items.join(both, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("f12_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem")
def f12(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_tax").distinct()


@query(
    "f13_baseline_rows",
    with_("course_meta") + """ SELECT room, day, CAST(count(*) AS DOUBLE) AS f_model, 0.5e0 AS p FROM course_meta GROUP BY 1, 2
    UNION ALL SELECT DISTINCT room, -1, 1.0e0, 1.0e0 FROM course_meta""",
)
def f13(spark, sf):
    rows = standin.course_meta(spark, sf).groupBy("room", "day").agg(F.count(F.lit(1)).cast("double").alias("f_model"))
    rows = rows.withColumn("p", F.lit(0.5))
    return cleaning.add_baseline(rows, ["room"], {"day": F.lit(-1), "f_model": F.lit(1.0), "p": F.lit(1.0)})


@query(
    "f14_unknown_samples",
    with_("sparse", "meta") + """ SELECT DISTINCT sample_id FROM sparse WHERE sample_id NOT IN
    (SELECT sample_id FROM meta WHERE depth_hint >= 0)""",
)
def f14(spark, sf):
    known = standin.meta(spark, sf).filter(F.col("depth_hint") >= 0)
    return CountSet(standin.sparse(spark, sf), known, standin.tax(spark, sf)).unknown_samples()


@query(
    "m3_impute_missing",
    with_("assay")
    + """ SELECT id, grp, coalesce(value, CAST(1 + CAST('0x' || substr(md5('10/' || id), 1, 8) AS BIGINT) % 20 AS DOUBLE)) AS value
    FROM assay""",
)
def m3(spark, sf):
    return cleaning.impute_missing(standin.assay(spark, sf), "value", ["id"], seed=10, high=20)


@query(
    "m19_phase_label",
    with_("course_meta") + " SELECT sample_id, CASE WHEN day > 0 THEN 'POSTINFECTION' ELSE 'PREINFECTION' END AS phase FROM course_meta",
)
def m19(spark, sf):
    return standin.course_meta(spark, sf).select("sample_id", cleaning.phase_label("day").alias("phase"))


