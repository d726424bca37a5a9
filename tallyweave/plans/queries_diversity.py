"""Queries over rarefaction, diversity, distances, permutation tests and ordination."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions.columns import significant_all
from tallyweave.operators import distance, diversity, ordination, permanova, rarefaction, scaling, timecourse
from tallyweave.plans import standin
from tallyweave.plans.registry import query
from tallyweave.plans.standin import with_
from tallyweave.session import checkpointed


def _r(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _rarefy_sql(table: str, seed: str = "'1'", keys: str = "") -> str:
    return f"""SELECT {keys} sample_id, feature_id, count(*) AS count FROM (
      SELECT {keys} sample_id, feature_id, row_number() OVER (PARTITION BY {keys} sample_id
        ORDER BY md5({seed} || '/' || sample_id || '/' || feature_id || '/' || i)) AS rk
      FROM (SELECT *, unnest(range(1, count + 1)) AS i FROM {table}))
    WHERE rk <= (SELECT min(t) FROM (SELECT sum(count) AS t FROM dense GROUP BY sample_id)) GROUP BY ALL"""


@query("d1_rarefy", with_("dense") + " " + _rarefy_sql("dense"))
def d1(spark, sf):
    return rarefaction.rarefy(standin.dense(spark, sf))


@query(
    "d1_rarefy_with_replacement",
    with_("dense")
    + """, sums AS (SELECT sample_id, CAST(sum(count) AS BIGINT) AS total FROM dense GROUP BY 1),
    ranges AS (SELECT sample_id, feature_id, count,
      CAST(sum(count) OVER (PARTITION BY sample_id ORDER BY md5(feature_id)) AS BIGINT) - count AS lo FROM dense),
    drawn AS (SELECT sample_id, CAST('0x' || substr(md5('1/' || sample_id || '/' || i), 1, 12) AS BIGINT) % total AS pos
      FROM (SELECT *, unnest(range(1, (SELECT min(total) FROM sums) + 1)) AS i FROM sums))
    SELECT r.sample_id, r.feature_id, count(*) AS count FROM drawn d JOIN ranges r
    ON r.sample_id = d.sample_id AND d.pos >= r.lo AND d.pos < r.lo + r.count GROUP BY 1, 2""",
)
def d1_replace(spark, sf):
    return rarefaction.rarefy_with_replacement(standin.dense(spark, sf))


_RARE = ", ".join(f"CAST(count(*) FILTER (count = {i}) AS DOUBLE) AS a{i}" for i in range(1, 11))
_SR = " + ".join(f"a{i}" for i in range(1, 11))
_NR = " + ".join(f"a{i} * {i}" for i in range(1, 11))
_MR = " + ".join(f"a{i} * {i * (i - 1)}" for i in range(1, 11))


@query(
    "d2_richness",
    with_("sparse")
    + f""", s0 AS (SELECT sample_id, CAST(count(*) AS DOUBLE) AS s, CAST(sum(count) AS DOUBLE) AS n, {_RARE},
      sum(count * ln(count)) AS xlnx, sum(CAST(count AS DOUBLE) * count) AS xx FROM sparse GROUP BY 1),
    s1 AS (SELECT *, {_SR} AS sr, {_NR} AS nr, {_MR} AS mr FROM s0),
    s2 AS (SELECT *, CASE WHEN nr > 0 AND a1 < nr THEN 1 - a1 / nr END AS cv FROM s1),
    s3 AS (SELECT *, greatest(coalesce(sr * mr / nullif(cv * nr * (nr - 1), 0) - 1, 0), 0) AS gam FROM s2)
    SELECT sample_id, CAST(s AS BIGINT) AS observed, round(s + a1 * (a1 - 1) / (2 * (a2 + 1)), 6) AS chao1,
    round(s - sr + sr / cv + a1 / cv * gam, 6) AS ace,
    round(ln(n) - xlnx / n, 9) AS shannon, round(1 - xx / (n * n), 9) AS simpson, round(n * n / xx, 6) AS inv_simpson,
    CASE WHEN a1 = 0 THEN 0 WHEN a2 > 0 THEN round(sqrt(a1 * (a1 - 1) / (2 * (a2 + 1)) + a1 * pow(2 * a1 - 1, 2) / (4 * pow(a2 + 1, 2))
      + a1 * a1 * a2 * pow(a1 - 1, 2) / (4 * pow(a2 + 1, 4))), 6) END AS se_chao1
    FROM s3""",
)
def d2(spark, sf):
    out = diversity.richness(standin.sparse(spark, sf)).drop("fisher", "se_ace")
    return _r(_r(out, 6, "chao1", "se_chao1", "ace", "inv_simpson"), 9, "shannon", "simpson")


@query("d2_richness_model_based")
def d2_rest(spark, sf):
    return _r(diversity.richness(standin.sparse(spark, sf)).select("sample_id", "ace", "se_ace", "fisher"), 6, "ace", "se_ace", "fisher")


_BRAY = """ pairs AS (SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, a.t AS ta, b.t AS tb FROM sums a JOIN sums b ON a.sample_id < b.sample_id),
    shared AS (SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, sum(least(a.count, b.count)) AS sh
      FROM {t} a JOIN {t} b ON a.feature_id = b.feature_id AND a.sample_id < b.sample_id GROUP BY 1, 2),
    dist AS (SELECT sample_a, sample_b, 1 - 2.0e0 * coalesce(sh, 0) / (ta + tb) AS d FROM pairs LEFT JOIN shared USING (sample_a, sample_b))"""


def _bray_sql(t: str) -> str:
    return f", sums AS (SELECT sample_id, CAST(sum(count) AS DOUBLE) AS t FROM {t} GROUP BY 1)," + _BRAY.format(t=t)


@query("d3_bray_curtis", with_("dense") + _bray_sql("dense") + " SELECT sample_a, sample_b, round(d, 9) AS d FROM dist")
def d3(spark, sf):
    return _r(distance.bray_curtis(standin.dense(spark, sf)), 9, "d")


@query("d3_bray_curtis_sparse", with_("sparse") + _bray_sql("sparse") + " SELECT sample_a, sample_b, round(d, 9) AS d FROM dist")
def d3_sparse(spark, sf):
    return _r(distance.bray_curtis(standin.sparse(spark, sf)), 9, "d")


@query(
    "d4_average_rarefied_distance",
    with_("dense")
    + ", runs AS (SELECT it, d.* FROM dense d, range(1, 6) r(it)), thin AS ("
    + _rarefy_sql("runs", "'7/' || it", "it,")
    + """), sums AS (SELECT it, sample_id, CAST(sum(count) AS DOUBLE) AS t FROM thin GROUP BY ALL),
    pairs AS (SELECT a.it, a.sample_id AS sample_a, b.sample_id AS sample_b, a.t + b.t AS both_t FROM sums a JOIN sums b
      ON a.it = b.it AND a.sample_id < b.sample_id),
    shared AS (SELECT a.it, a.sample_id AS sample_a, b.sample_id AS sample_b, sum(least(a.count, b.count)) AS sh
      FROM thin a JOIN thin b ON a.it = b.it AND a.feature_id = b.feature_id AND a.sample_id < b.sample_id GROUP BY ALL)
    SELECT sample_a, sample_b, round(avg(1 - 2.0e0 * coalesce(sh, 0) / both_t), 9) AS d
    FROM pairs LEFT JOIN shared USING (it, sample_a, sample_b) GROUP BY 1, 2""",
)
def d4(spark, sf):
    return _r(distance.average_rarefied_distance(standin.dense(spark, sf), iterations=5, seed=7), 9, "d")


@query("d1_rarefy_cells")
def d1_cells(spark, sf):
    return rarefaction.rarefy_cells(standin.dense(spark, sf), seed=7).drop("iteration")


@query("d4_average_distance_by_cells")
def d4_cells(spark, sf):
    return _r(distance.average_rarefied_distance_by_cells(standin.dense(spark, sf), iterations=100, seed=7), 9, "d")


@query(
    "j6_sample_pairs",
    with_("dense") + """ SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, CAST(sum(least(a.count, b.count)) AS BIGINT) AS shared
    FROM dense a JOIN dense b ON a.feature_id = b.feature_id AND a.sample_id < b.sample_id GROUP BY 1, 2""",
)
def j6(spark, sf):
    abund = standin.dense(spark, sf)
    return distance.shared_counts(abund).filter(F.col("shared") > 0).drop("both")


@query(
    "j8_nearest_control",
    with_("dense", "meta") + _bray_sql("dense")
    + """, both_ways AS (SELECT sample_a AS sample_id, sample_b AS control, round(d, 12) AS d FROM dist
       UNION ALL SELECT sample_b, sample_a, round(d, 12) FROM dist),
    ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.sample_id ORDER BY d, control) AS rk FROM both_ways b
       WHERE control IN (SELECT sample_id FROM meta WHERE is_neg) AND sample_id NOT IN (SELECT sample_id FROM meta WHERE is_neg))
    SELECT sample_id, control, round(d, 9) AS d FROM ranked WHERE rk = 1""",
)
def j8(spark, sf):
    controls = standin.meta(spark, sf).filter("is_neg").select("sample_id")
    return _r(distance.nearest_control(standin.dense(spark, sf), controls), 9, "d")


def _permanova_sql(members: str, permutations: int, seed: str) -> str:
    """``members(comparison, sample_id, grp)`` and ``dist`` must be defined before."""
    return f""", members AS ({members}),
    slots AS (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY grp, sample_id) AS pos FROM members),
    perms AS (SELECT s.comparison, s.sample_id, p.perm, row_number() OVER (PARTITION BY s.comparison, p.perm
       ORDER BY md5('{seed}/' || p.perm || '/' || s.sample_id)) AS pos
       FROM slots s, range(1, {permutations + 1}) p(perm)),
    labels AS (SELECT comparison, sample_id, 0 AS perm, grp FROM slots UNION ALL
       SELECT p.comparison, p.sample_id, p.perm, s.grp FROM perms p JOIN slots s USING (comparison, pos)),
    sizes AS (SELECT comparison, grp, count(*) AS n_g FROM members GROUP BY 1, 2),
    overall AS (SELECT comparison, CAST(sum(n_g) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS g FROM sizes GROUP BY 1),
    dd AS (SELECT m.comparison, sample_a, sample_b, d * d AS d2 FROM dist JOIN members m ON m.sample_id = sample_a
       JOIN members k ON k.sample_id = sample_b AND k.comparison = m.comparison),
    total AS (SELECT comparison, sum(d2) / any_value(n) AS sst FROM dd JOIN overall USING (comparison) GROUP BY 1),
    within AS (SELECT a.comparison, a.perm, sum(d2 / n_g) AS ssw FROM dd JOIN labels a ON a.comparison = dd.comparison AND a.sample_id = sample_a
       JOIN labels b ON b.comparison = dd.comparison AND b.sample_id = sample_b AND b.perm = a.perm AND a.grp = b.grp
       JOIN sizes z ON z.comparison = dd.comparison AND z.grp = a.grp GROUP BY 1, 2),
    filled AS (SELECT comparison, perm, coalesce(ssw, 0) AS ssw FROM (SELECT DISTINCT comparison, perm FROM labels) LEFT JOIN within USING (comparison, perm)),
    stats AS (SELECT comparison, perm, sst - ssw AS ssa, (sst - ssw) / nullif(sst, 0) AS r2, g - 1 AS df,
       round(((sst - ssw) / nullif(g - 1, 0)) / nullif(ssw / nullif(n - g, 0), 0), 9) AS f FROM filled JOIN total USING (comparison) JOIN overall USING (comparison)),
    tested AS (SELECT o.comparison, CAST(o.df AS BIGINT) AS df, o.ssa AS sums_of_sqs, o.f AS f_model, o.r2,
       CASE WHEN o.f IS NOT NULL THEN (1 + (SELECT count(*) FROM stats s WHERE s.comparison = o.comparison AND s.perm > 0 AND s.f >= o.f)) / {permutations + 1}.0e0 END AS p_value
       FROM stats o WHERE perm = 0)"""


@query(
    "d5_permanova",
    with_("dense", "meta") + _bray_sql("dense")
    + _permanova_sql("SELECT 'all' AS comparison, sample_id, grp FROM meta WHERE sample_id IN (SELECT sample_id FROM dense)", 999, "5")
    + " SELECT comparison, df, round(sums_of_sqs, 7) AS sums_of_sqs, round(f_model, 6) AS f_model, round(r2, 7) AS r2, round(p_value, 9) AS p_value FROM tested",
)
def d5(spark, sf):
    abund, meta = standin.dense(spark, sf), standin.meta(spark, sf)
    out = permanova.permanova_of_counts(abund, permanova.single_comparison(meta, "grp"), permutations=999, seed=5)
    return _r(_r(out, 7, "sums_of_sqs", "r2"), 6, "f_model").withColumn("p_value", F.round("p_value", 9))


def _course_dist(spark, sf):
    return checkpointed(distance.bray_curtis(standin.course(spark, sf)))


_COURSE_PAIRS = """course_pairs AS (SELECT a.room AS room1, a.day AS day1, b.room AS room2, b.day AS day2,
      a.room || '_' || a.day || ' vs ' || b.room || '_' || b.day AS pairs
    FROM (SELECT DISTINCT room, day FROM course_meta) a JOIN (SELECT DISTINCT room, day FROM course_meta) b
    ON (a.room, a.day) < (b.room, b.day))"""

_PAIRWISE = (
    with_("course", "course_meta") + _bray_sql("course") + ", " + _COURSE_PAIRS
    + _permanova_sql(
        """SELECT p.pairs AS comparison, sample_id, m.room || '/' || lpad(CAST(m.day + 100 AS VARCHAR), 5, '0') AS grp FROM course_pairs p
        JOIN course_meta m ON (m.room = p.room1 AND m.day = p.day1) OR (m.room = p.room2 AND m.day = p.day2)""",
        999,
        "6",
    )
    + """, pairwise AS (SELECT c.*, df, sums_of_sqs, f_model, r2, p_value,
       CASE WHEN p_value IS NOT NULL THEN least(p_value * count(p_value) OVER (), 1.0e0) END AS p_adjusted FROM tested t JOIN course_pairs c ON c.pairs = t.comparison)"""
)


def _pairwise(spark, sf):
    out = permanova.pairwise_permanova(
        _course_dist(spark, sf), standin.course_meta(spark, sf), "room", "day", permutations=999, seed=6
    )
    return checkpointed(out)


@query(
    "d6_pairwise_permanova",
    _PAIRWISE
    + """ SELECT pairs, room1, day1, room2, day2, df, round(sums_of_sqs, 7) AS sums_of_sqs, round(f_model, 6) AS f_model,
    round(r2, 7) AS r2, round(p_value, 9) AS p_value, round(p_adjusted, 9) AS p_adjusted,
    CASE WHEN p_adjusted <= 0.0001 THEN '***' WHEN p_adjusted <= 0.001 THEN '**' WHEN p_adjusted <= 0.01 THEN '*'
      WHEN p_adjusted <= 0.05 THEN '.' ELSE '' END AS sig FROM pairwise""",
)
def d6(spark, sf):
    out = _pairwise(spark, sf)
    return _r(_r(_r(out, 7, "sums_of_sqs", "r2"), 6, "f_model"), 9, "p_value", "p_adjusted")


@query("d6_pairwise_walked")
def d6_walked(spark, sf):
    """All pairs of rooms and days with the time course's 9,999 permutations."""
    out = permanova.pairwise_permanova(_course_dist(spark, sf), standin.course_meta(spark, sf), "room", "day", permutations=9999, seed=6, walk=True)
    return _r(_r(_r(out, 7, "sums_of_sqs", "r2"), 6, "f_model"), 9, "p_value", "p_adjusted")


def _bh_sql(source: str) -> str:
    return f"""SELECT *, CASE WHEN p_value IS NOT NULL THEN
        least(min(raw) OVER (ORDER BY p_value ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0e0) END AS fdr
      FROM (SELECT *, p_value * count(p_value) OVER () / count(p_value) OVER (ORDER BY p_value) AS raw FROM pairwise WHERE {source})"""


@query(
    "d7_within_day",
    _PAIRWISE + ", v AS (" + _bh_sql("day1 = day2") + """)
    SELECT pairs, day1 AS day, CASE WHEN room2 = 'R3' THEN room2 ELSE room1 END AS ref_room,
    CASE WHEN room2 = 'R3' THEN room1 ELSE room2 END AS comp_room, round(f_model, 6) AS f_model, round(p_value, 9) AS p_value,
    round(fdr, 9) AS fdr FROM v""",
)
def d7_day(spark, sf):
    out = timecourse.within_day(_pairwise(spark, sf), ["R3", "R0", "R1", "R2", "R4"])
    out = out.select("pairs", F.col("ref_day").alias("day"), "ref_room", "comp_room", "f_model", "p_value", "fdr")
    return _r(_r(out, 6, "f_model"), 9, "p_value", "fdr")


@query(
    "d7_within_day_against_reference",
    _PAIRWISE + ", v AS (" + _bh_sql("day1 = day2 AND (room1 = 'R2' OR room2 = 'R2')") + """)
    SELECT pairs, day1 AS day, CASE WHEN room1 = 'R2' THEN room2 ELSE room1 END AS room, round(f_model, 6) AS f_model,
    round(p_value, 9) AS p_value, round(fdr, 9) AS fdr FROM v""",
)
def d7_ref(spark, sf):
    out = timecourse.within_day_against(_pairwise(spark, sf), "R2")
    out = out.select("pairs", F.col("comp_day").alias("day"), F.col("comp_room").alias("room"), "f_model", "p_value", "fdr")
    return _r(_r(out, 6, "f_model"), 9, "p_value", "fdr")


@query(
    "d7_within_room_against_baseline",
    _PAIRWISE + ", v AS (" + _bh_sql("room1 = room2 AND (day1 = 0 OR day2 = 0)") + """)
    SELECT pairs, room1 AS room, greatest(day1, day2) AS day, round(f_model, 6) AS f_model, round(r2, 7) AS r2,
    round(p_value, 9) AS p_value, round(fdr, 9) AS fdr, CASE WHEN fdr < 0.05 THEN true END AS sig FROM v
    UNION ALL SELECT DISTINCT NULL, room1, 0, 1.0e0, NULL, NULL, 1.0e0, NULL FROM v""",
)
def d7_room(spark, sf):
    out = timecourse.within_room_against(_pairwise(spark, sf), 0)
    return _r(_r(_r(out, 6, "f_model"), 9, "p_value", "fdr"), 7, "r2")


@query(
    "d7_cumulative_change",
    _PAIRWISE + ", v AS (" + _bh_sql("room1 = room2") + """)
    SELECT pairs, room1 AS room, day1, day2, round(f_model, 6) AS f_model, round(p_value, 9) AS p_value, round(fdr, 9) AS fdr,
    round(sum(f_model) OVER (PARTITION BY room1 ORDER BY day1), 6) AS cumulative_f, day1 || ' vs ' || day2 AS period
    FROM v WHERE day2 = day1 + 1""",
)
def d7_cumulative(spark, sf):
    out = timecourse.cumulative_change(_pairwise(spark, sf), list(range(7))).drop("r2")
    return _r(_r(out, 6, "f_model", "cumulative_f"), 9, "p_value", "fdr")


@query("d7_rarefied_course")
def d7_rarefied(spark, sf):
    """From counts to the running change of each room: 100 rarefactions, their mean distances, 9,999 permutations of every pair of sets."""
    pairs = timecourse.rarefied_course(standin.course(spark, sf), standin.course_meta(spark, sf), "room", "day", seed=6)
    out = timecourse.cumulative_change(pairs, list(range(7))).drop("r2")
    return _r(_r(out, 6, "f_model", "cumulative_f"), 9, "p_value", "fdr")


def _two_digits_sql(x: str) -> str:
    up, down = f"pow(10.0e0, greatest(1 - floor(log10(abs({x}))), 0))", f"pow(10.0e0, greatest(floor(log10(abs({x}))) - 1, 0))"
    return f"CASE WHEN {x} = 0 THEN 0.0e0 WHEN {x} IS NOT NULL THEN round({x} * {up} / {down}) / {up} * {down} END AS {x}"


@query(
    "d7_report_table",
    _PAIRWISE + ", v AS (" + _bh_sql("day1 = day2") + """),
    nine AS (SELECT pairs, round(f_model, 9) AS f_model, round(r2, 9) AS r2, round(p_value, 9) AS p_value, round(fdr, 9) AS fdr FROM v)
    SELECT pairs, """ + ", ".join(_two_digits_sql(x) for x in ("f_model", "r2", "p_value", "fdr")) + " FROM nine",
)
def d7_report(spark, sf):
    """The within-day table as reported: two significant digits."""
    out = timecourse.within_day(_pairwise(spark, sf)).select("pairs", "f_model", "r2", "p_value", "fdr")
    return significant_all(_r(out, 9, "f_model", "r2", "p_value", "fdr"), 2)


@query(
    "d8_dispersion",
    with_("course", "course_meta") + _bray_sql("course")
    + """, g AS (SELECT sample_id, room || '_' || day AS grp FROM course_meta),
    inside AS (SELECT a.grp, sample_a, sample_b, d * d AS d2 FROM dist JOIN g a ON a.sample_id = sample_a JOIN g b ON b.sample_id = sample_b AND a.grp = b.grp),
    n AS (SELECT grp, count(*) AS n FROM g GROUP BY 1),
    rs AS (SELECT grp, sample_id, sum(d2) AS s FROM (SELECT grp, sample_a AS sample_id, d2 FROM inside UNION ALL SELECT grp, sample_b, d2 FROM inside) GROUP BY 1, 2),
    al AS (SELECT grp, sum(d2) AS s FROM inside GROUP BY 1)
    SELECT g.sample_id, g.grp, round(sqrt(greatest(coalesce(rs.s, 0) / n - coalesce(al.s, 0) / (n * n), 0)), 7) AS distance
    FROM g JOIN n USING (grp) LEFT JOIN rs ON rs.sample_id = g.sample_id LEFT JOIN al ON al.grp = g.grp""",
)
def d8(spark, sf):
    meta = standin.course_meta(spark, sf)
    meta = meta.withColumn("grp", F.concat_ws("_", "room", F.col("day").cast("string")))
    return _r(permanova.dispersion(_course_dist(spark, sf), meta, "grp"), 7, "distance")


@query(
    "d8_centred_distances",
    with_("course") + _bray_sql("course")
    + """, sq AS (SELECT sample_a, sample_b, d * d AS d2 FROM dist),
    rs AS (SELECT sample_id, sum(d2) / (SELECT count(*) FROM sums) AS r FROM (SELECT sample_a AS sample_id, d2 FROM sq UNION ALL SELECT sample_b, d2 FROM sq) GROUP BY 1),
    al AS (SELECT avg(r) AS m FROM rs)
    SELECT sample_a, sample_b, round(-0.5 * (d2 - a.r - b.r + m), 9) AS value
    FROM (FROM sq UNION ALL SELECT sample_id, sample_id, 0.0e0 FROM sums) JOIN rs a ON a.sample_id = sample_a JOIN rs b ON b.sample_id = sample_b, al""",
)
def d8_centred(spark, sf):
    return _r(scaling.centred(_course_dist(spark, sf)), 9, "value")


@query("d8_median_dispersion")
def d8_median(spark, sf):
    meta = standin.course_meta(spark, sf)
    meta = meta.withColumn("grp", F.concat_ws("_", "room", F.col("day").cast("string")))
    return _r(scaling.median_dispersion(_course_dist(spark, sf), meta, "grp"), 6, "distance")


@query("d9_nonmetric_scaling")
def d9_nonmetric(spark, sf):
    points, _ = scaling.nonmetric(_course_dist(spark, sf), tolerance=1e-4)
    return _r(points, 6, "axis1", "axis2")


def _ordination_sql(t: str, digits: int, squarings: int = 12) -> str:
    """Axes from the samples' Gram matrix: powers by repeated squaring give the first, the same without it the second."""

    def axis(k: int, source: str) -> str:
        parts = [f"p{k}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {source} WHERE i = j) AS v FROM {source})"]
        for n in range(squarings):
            parts.append(f"q{k}_{n} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM p{k}_{n} a JOIN p{k}_{n} b ON a.j = b.i GROUP BY 1, 2)")
            parts.append(f"p{k}_{n + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM q{k}_{n} WHERE i = j) AS v FROM q{k}_{n})")
        last = f"p{k}_{squarings}"
        return ", ".join(parts) + f""", c{k} AS MATERIALIZED (SELECT i, v FROM {last} WHERE j = (SELECT i FROM {last} WHERE i = j ORDER BY v DESC, i LIMIT 1)),
    u{k} AS MATERIALIZED (SELECT i, v / (SELECT sqrt(sum(v * v)) FROM c{k}) AS u FROM c{k}),
    e{k} AS MATERIALIZED (SELECT sum(a.u * g.v * b.u) AS e FROM {source} g JOIN u{k} a ON a.i = g.i JOIN u{k} b ON b.i = g.j),
    l{k} AS (SELECT feature_id, (sum(x * u) - any_value(m) * (SELECT sum(u) FROM u{k})) / sqrt((SELECT e FROM e{k})) AS l
      FROM val JOIN mu USING (feature_id) JOIN u{k} ON i = sample_id GROUP BY 1),
    s{k} AS MATERIALIZED (SELECT sign(l) AS s FROM l{k} ORDER BY round(abs(l), 9) DESC, feature_id DESC LIMIT 1)"""

    return (
        with_(t)
        + f""", tot AS (SELECT sample_id, sum(count) AS t FROM {t} GROUP BY 1),
    val AS MATERIALIZED (SELECT sample_id, feature_id, sqrt(count / t) AS x FROM {t} JOIN tot USING (sample_id)),
    mu AS MATERIALIZED (SELECT feature_id, sum(x) / (SELECT count(*) FROM tot) AS m FROM val GROUP BY 1),
    r AS MATERIALIZED (SELECT sample_id AS i, sum(x * m) AS r FROM val JOIN mu USING (feature_id) GROUP BY 1),
    dots AS (SELECT a.sample_id AS i, b.sample_id AS j, sum(a.x * b.x) AS v FROM val a JOIN val b USING (feature_id) GROUP BY 1, 2),
    gram AS MATERIALIZED (SELECT a.i, b.i AS j, coalesce(v, 0) - a.r - b.r + (SELECT sum(m * m) FROM mu) AS v
      FROM r a JOIN r b ON true LEFT JOIN dots d ON d.i = a.i AND d.j = b.i), """
        + axis(1, "gram")
        + """, gram2 AS MATERIALIZED (SELECT g.i, g.j, g.v - (SELECT e FROM e1) * a.u * b.u AS v FROM gram g JOIN u1 a ON a.i = g.i JOIN u1 b ON b.i = g.j), """
        + axis(2, "gram2")
        + f""" SELECT a.i AS sample_id, round(a.u * sqrt((SELECT e FROM e1)) * (SELECT s FROM s1), {digits}) AS axis1,
    round(b.u * sqrt((SELECT e FROM e2)) * (SELECT s FROM s2), {digits}) AS axis2 FROM u1 a JOIN u2 b ON a.i = b.i"""
    )


@query("d9_ordination", _ordination_sql("dense", 6))
def d9(spark, sf):
    return _r(ordination.ordinate(standin.dense(spark, sf)), 6, "axis1", "axis2")


@query("d9_ordination_wide", _ordination_sql("sparse", 5))
def d9_wide(spark, sf):
    return _r(ordination.ordinate(standin.sparse(spark, sf)), 5, "axis1", "axis2")


_POINTS = (
    with_("course", "course_meta")
    + """, pts AS (SELECT c.sample_id, room, day, ln(sum(count)) - sum(count * ln(count)) / sum(count) AS x,
       ln(CAST(count(*) AS DOUBLE)) + ln(sum(count)) AS y FROM course c JOIN course_meta m USING (sample_id) GROUP BY 1, 2, 3)"""
)


def _points(spark, sf):
    abund = standin.course(spark, sf)
    y = abund.groupBy("sample_id").agg((F.ln(F.count(F.lit(1))) + F.ln(F.sum("count"))).alias("y"))
    pts = diversity.shannon(abund, "x").join(y, "sample_id")
    return pts.join(standin.course_meta(spark, sf), "sample_id")


@query(
    "d10_centroids",
    _POINTS + """ SELECT sample_id, room, day, round(x, 7) AS x, round(y, 7) AS y, round(avg(x) OVER (PARTITION BY room, day), 7) AS centroid_x,
    round(avg(y) OVER (PARTITION BY room, day), 7) AS centroid_y FROM pts""",
)
def d10(spark, sf):
    out = ordination.centroids(_points(spark, sf), ["room", "day"], ["x", "y"])
    return _r(out, 7, "x", "y", "centroid_x", "centroid_y")


@query(
    "d11_ellipses",
    _POINTS + """, st AS (SELECT room, avg(x) AS cx, avg(y) AS cy, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS cxy FROM pts GROUP BY 1)
    SELECT room, CAST(step AS INTEGER) AS step, round(cx + cos(step * 2 * pi() / 100) * sqrt(vx), 7) AS x,
    round(cy + cos(step * 2 * pi() / 100) * cxy / sqrt(vx) + sin(step * 2 * pi() / 100) * sqrt(greatest(vy - cxy * cxy / vx, 0)), 7) AS y
    FROM st, range(0, 101) r(step)""",
)
def d11(spark, sf):
    return _r(ordination.ellipses(_points(spark, sf), ["room"], "x", "y"), 7, "x", "y")


@query(
    "d12_trajectories",
    _POINTS + """, c AS (SELECT room, day, avg(x) AS x, avg(y) AS y FROM pts GROUP BY 1, 2)
    SELECT room, day, round(x, 7) AS x, round(y, 7) AS y,
    round(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 7) AS step_length
    FROM c WINDOW w AS (PARTITION BY room ORDER BY day)""",
)
def d12(spark, sf):
    return _r(ordination.trajectories(_points(spark, sf), "room", "day", ["x", "y"]), 7, "x", "y", "step_length")
