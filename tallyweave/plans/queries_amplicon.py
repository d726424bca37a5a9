"""Queries over reads. Amplicons are the nucleotide letters of whole document sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions.columns import null_unclassified
from tallyweave.operators import amplicon as A
from tallyweave.operators import denoising, descent
from tallyweave.plans import reads_to_counts, standin
from tallyweave.plans.registry import query
from tallyweave.plans.standin import table, with_
from tallyweave.session import parallel_scan


def _r(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(
    "r1_quality_profile",
    with_("reads")
    + """ SELECT sample_id, mate, cycle, count(*) AS reads, round(avg(q), 7) AS mean_q, quantile_cont(q, 0.25) AS q25,
    quantile_cont(q, 0.5) AS q50, quantile_cont(q, 0.75) AS q75
    FROM (SELECT sample_id, mate, CAST(unnest(range(1, len(qual) + 1)) AS INTEGER) AS cycle, unnest(qual) AS q FROM reads) GROUP BY 1, 2, 3""",
)
def r1(spark, sf):
    return _r(A.quality_profile(standin.reads(spark, sf)), 7, "mean_q")


def _contaminant(spark, sf):
    text = F.regexp_replace(F.upper("text"), "[^ACGT]", "")
    return table(spark, sf, "benchmark").select(text.alias("seq"))


_FILTERED = with_("reads") + """, t0 AS (SELECT *, list_position(list_transform(qual, lambda q: q <= 2), true) AS low FROM reads),
    t1 AS (SELECT *, CASE WHEN low > 0 THEN low - 1 ELSE length(seq) END AS size, CASE mate WHEN 1 THEN 9 ELSE 8 END AS target FROM t0),
    t2 AS (SELECT sample_id, read_id, mate, substr(seq, 1, target) AS seq, qual[1:target] AS qual FROM t1 WHERE size > 0 AND size >= target),
    t3 AS (SELECT * FROM t2 WHERE list_sum(list_transform(qual, lambda q: pow(10.0e0, q / -10.0e0))) <= CASE mate WHEN 1 THEN 1.5e0 ELSE 2.0e0 END),
    bk AS (SELECT DISTINCT substr(seq, CAST(i AS INTEGER), 8) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 6)) AS i
      FROM (SELECT unnest([seq, reverse(translate(seq, 'ACGT', 'TGCA'))]) AS seq FROM (SELECT regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM benchmark)))),
    rk AS (SELECT DISTINCT sample_id, read_id, mate, substr(seq, CAST(i AS INTEGER), 8) AS kmer FROM (SELECT *, unnest(range(1, length(seq) - 6)) AS i FROM t3)),
    bad AS (SELECT DISTINCT sample_id, read_id FROM (SELECT sample_id, read_id, mate, count(*) AS c FROM rk JOIN bk USING (kmer) GROUP BY 1, 2, 3) WHERE c >= 2),
    t4 AS (SELECT t3.* FROM t3 WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.sample_id = t3.sample_id AND bad.read_id = t3.read_id)),
    kept AS (SELECT * FROM t4 WHERE (sample_id, read_id) IN (SELECT (sample_id, read_id) FROM t4 GROUP BY sample_id, read_id HAVING count(*) = 2))"""


@query(
    "r2_filter_and_trim",
    _FILTERED + " SELECT sample_id, read_id, mate, seq, array_to_string(qual, ' ') AS quals FROM kept",
)
def r2(spark, sf):
    out = A.filter_and_trim(
        standin.reads(spark, sf), {1: 9, 2: 8}, {1: 1.5, 2: 2.0}, contaminant=_contaminant(spark, sf), contaminant_k=8
    )
    return out.select("sample_id", "read_id", "mate", "seq", F.array_join(F.col("qual").cast("array<string>"), " ").alias("quals"))


_UNIQUES = with_("amplicon") + ", u AS (SELECT sample_id, seq, count(*) AS count FROM amplicon GROUP BY 1, 2)"


def _uniques(spark, sf):
    return A.dereplicate(standin.amplicon(spark, sf))


@query("r3_dereplicate", _UNIQUES + " SELECT * FROM u")
def r3(spark, sf):
    return _uniques(spark, sf)


_PARENTS = """, pool AS (SELECT seq, CAST(sum(count) AS BIGINT) AS n, length(seq) AS len FROM u GROUP BY 1),
    cand AS (SELECT c.seq, p.seq AS parent, row_number() OVER (PARTITION BY c.seq ORDER BY p.n DESC, p.seq) AS rk
      FROM pool c JOIN pool p ON p.len = c.len AND p.n >= 2 * c.n WHERE hamming(c.seq, p.seq) = 1),
    parents AS (SELECT seq, parent FROM cand WHERE rk = 1)"""


def _parents_of(mate: int) -> str:
    """The parents of one mate's reads as ``parents<mate>``."""
    own = _PARENTS.replace("pool", f"pool{mate}").replace("cand", f"cand{mate}").replace("parents", f"parents{mate}").replace("FROM u GROUP", f"FROM u{mate} GROUP")
    return f", u{mate} AS (SELECT sample_id, seq, count(*) AS count FROM reads WHERE mate = {mate} GROUP BY 1, 2)" + own


def _rates_of(mate: int) -> str:
    return f"""SELECT {mate} AS mate, ref, obs, q, count(*) AS n FROM (SELECT unnest(string_split(coalesce(parent, seq), '')) AS ref,
      unnest(string_split(seq, '')) AS obs, unnest(qual) AS q FROM reads LEFT JOIN parents{mate} USING (seq) WHERE mate = {mate}) GROUP BY ALL"""


@query("r4_error_rates", with_("reads") + _parents_of(1) + _parents_of(2) + " " + _rates_of(1) + " UNION ALL " + _rates_of(2))
def r4(spark, sf):
    return A.error_rates(standin.reads(spark, sf))


_CHAINS = (
    (_UNIQUES + _PARENTS).replace("WITH ", "WITH RECURSIVE ", 1)
    + """, chain AS (SELECT seq, parent AS variant FROM parents UNION ALL SELECT c.seq, p.parent FROM chain c JOIN parents p ON p.seq = c.variant),
    roots AS (SELECT seq, variant FROM chain WHERE variant NOT IN (SELECT seq FROM parents))"""
)


@query(
    "r5_denoise",
    _CHAINS + " SELECT sample_id, coalesce(variant, seq) AS seq, CAST(sum(count) AS BIGINT) AS count FROM u LEFT JOIN roots USING (seq) GROUP BY 1, 2",
)
def r5(spark, sf):
    return A.denoise(_uniques(spark, sf))


_CUT = with_("reads") + """, cut AS (SELECT sample_id, read_id, mate, substr(seq, 1, t) AS seq, qual[1:t] AS qual
      FROM (SELECT *, CASE mate WHEN 1 THEN 12 ELSE 10 END AS t FROM reads) WHERE length(seq) >= t)"""
_PART = lambda i: f"substr(seq, CAST(floor(length(seq) * {i} / 5.0e0) AS INTEGER) + 1, CAST(floor(length(seq) * {i + 1} / 5.0e0) - floor(length(seq) * {i} / 5.0e0) AS INTEGER)) AS p{i}"


def _cut_reads(spark, sf, first=12, second=10):
    size = F.when(F.col("mate") == 1, first).otherwise(second)
    reads = standin.reads(spark, sf).filter(F.length("seq") >= size)
    return reads.withColumns({"seq": F.substring("seq", F.lit(1), size), "qual": F.slice("qual", F.lit(1), size)})


@query(
    "r5_split_step",
    _CUT
    + f""", un AS (SELECT mate, seq, count(*) AS n FROM cut GROUP BY 1, 2),
    mq AS (SELECT mate, seq, list(w ORDER BY pos) AS w FROM (
      SELECT mate, seq, pos, greatest(1e-7, least(0.25e0, pow(10.0e0, round(avg(q)) / -10.0e0) / 3.0e0)) AS w
      FROM (SELECT mate, seq, unnest(range(1, len(qual) + 1)) AS pos, unnest(qual) AS q FROM cut) GROUP BY 1, 2, 3) GROUP BY 1, 2),
    us AS (SELECT mate, seq, md5(seq) AS id, n, w, {", ".join(_PART(i) for i in range(5))} FROM un JOIN mq USING (mate, seq)),
    fol AS (SELECT DISTINCT c.mate, c.id FROM us c JOIN us o ON o.mate = c.mate AND o.n >= 2 AND c.n >= 2 AND (o.n > c.n OR (o.n = c.n AND o.id < c.id))
      AND {" + ".join(f"CAST(o.p{i} <> c.p{i} AS INTEGER)" for i in range(5))} <= 2),
    lead AS (SELECT mate, id AS centre, seq AS centre_seq, n AS size FROM us WHERE n >= 2 AND (mate, id) NOT IN (SELECT (mate, id) FROM fol)),
    li AS (SELECT us.mate, us.id, us.n, us.seq, us.w, lead.centre, centre_seq, lead.size, hamming(us.seq, centre_seq) AS different
      FROM us JOIN lead ON us.mate = lead.mate WHERE hamming(us.seq, centre_seq) <= 2),
    lr AS (SELECT *, list_sum(list_transform(range(1, length(seq) + 1), lambda i: ln(CASE WHEN seq[i] = centre_seq[i] THEN 1 - 3 * w[i] ELSE w[i] END))) AS log_rate FROM li),
    be AS (SELECT *, size * exp(log_rate) AS mu, row_number() OVER (PARTITION BY mate, id ORDER BY id = centre DESC, round(ln(size) + log_rate, 9) DESC, centre DESC) AS rk FROM lr)
    SELECT mate, id, centre, CAST(different AS BIGINT) AS different, round(log_rate, 6) AS log_rate, size, n, CASE WHEN id = centre OR n <= 1 THEN 0.0e0 ELSE
      round(least(0.0e0, n * ln(mu) - mu - lgamma(n + 1) - ln(1 - exp(-mu))
        + ln(list_sum(list_transform(range(0, 500), lambda j: exp(j * ln(mu) - lgamma(n + j + 1) + lgamma(n + 1)))))), 6) END AS log_p FROM be WHERE rk = 1""",
)
def r5_step(spark, sf):
    steps = []
    for mate in (1, 2):
        uniques = denoising.unique_reads(_cut_reads(spark, sf).filter(F.col("mate") == mate))
        steps.append(denoising.first_step(uniques, denoising.nominal_rates()).select(F.lit(mate).alias("mate"), "*"))
    return _r(steps[0].union(steps[1]), 6, "log_rate", "log_p")


@query("r5_divisive")
def r5_divisive(spark, sf):
    return denoising.denoised(_cut_reads(spark, sf, 20, 16), rounds=2).groupBy("sample_id", "mate", "seq").agg(F.count(F.lit(1)).alias("count"))


_MERGED = with_("reads") + """, pr AS (SELECT a.sample_id, a.read_id, a.seq AS f, reverse(translate(b.seq, 'ACGT', 'TGCA')) AS r
      FROM reads a JOIN reads b ON a.sample_id = b.sample_id AND a.read_id = b.read_id AND a.mate = 1 AND b.mate = 2),
    ov AS (SELECT *, list_max(list_filter(range(12, least(length(f), length(r)) + 1),
      lambda o: right(f, CAST(o AS INTEGER)) = left(r, CAST(o AS INTEGER)))) AS overlap FROM pr),
    merged AS (SELECT sample_id, read_id, f || substr(r, CAST(overlap AS INTEGER) + 1) AS seq, CAST(overlap AS INTEGER) AS overlap FROM ov WHERE overlap IS NOT NULL)"""


@query("r6_merge_pairs", _MERGED + " SELECT * FROM merged")
def r6(spark, sf):
    return A.merge_pairs(standin.reads(spark, sf))


@query("r7_sequence_table", _MERGED + " SELECT sample_id, seq, count(*) AS count FROM merged GROUP BY 1, 2")
def r7(spark, sf):
    return A.dereplicate(A.merge_pairs(standin.reads(spark, sf)))


_FLAGS = _UNIQUES + """, w AS (SELECT sample_id, seq, count AS n, length(seq) AS len FROM u),
    ends AS (SELECT *, left(seq, CAST(i AS INTEGER)) AS px, right(seq, CAST(i AS INTEGER)) AS sx
       FROM (SELECT *, unnest(range(1, len + 1)) AS i FROM w)),
    lcp AS (SELECT c.sample_id, c.seq, c.len, p.seq AS parent, max(c.i) AS span FROM ends c JOIN ends p
       ON p.sample_id = c.sample_id AND p.i = c.i AND p.px = c.px AND p.n >= 2 * c.n AND p.seq <> c.seq WHERE c.i < c.len GROUP BY 1, 2, 3, 4),
    lcs AS (SELECT c.sample_id, c.seq, p.seq AS parent, max(c.i) AS span FROM ends c JOIN ends p
       ON p.sample_id = c.sample_id AND p.i = c.i AND p.sx = c.sx AND p.n >= 2 * c.n AND p.seq <> c.seq WHERE c.i < c.len GROUP BY 1, 2, 3),
    hit AS (SELECT DISTINCT a.sample_id, a.seq FROM lcp a JOIN lcs b ON a.sample_id = b.sample_id AND a.seq = b.seq
       WHERE a.parent <> b.parent AND a.span + b.span >= a.len)"""


@query(
    "r8_chimera_flags",
    _FLAGS + " SELECT w.sample_id, w.seq, hit.seq IS NOT NULL AS chimeric FROM w LEFT JOIN hit ON w.sample_id = hit.sample_id AND w.seq = hit.seq",
)
def r8(spark, sf):
    return A.chimera_flags(_uniques(spark, sf))


@query(
    "r8_remove_chimeras",
    _FLAGS
    + """, votes AS (SELECT w.seq, count(hit.seq) AS flagged, count(*) AS samples FROM w LEFT JOIN hit ON w.sample_id = hit.sample_id AND w.seq = hit.seq GROUP BY 1)
    SELECT * FROM u WHERE seq NOT IN (SELECT seq FROM votes WHERE flagged > 0 AND (flagged >= samples OR flagged >= (samples - 1) * 0.9))""",
)
def r8_remove(spark, sf):
    return A.remove_chimeras(_uniques(spark, sf))


_CLASSIFY = """WITH rk AS (SELECT DISTINCT lineage, substr(text, CAST(i AS INTEGER), 8) AS kmer FROM
      (SELECT lang || ';' || source AS lineage, text, unnest(range(1, length(text) - 6)) AS i FROM documents)),
    lt AS (SELECT count(DISTINCT lang || ';' || source) AS t FROM documents),
    wt AS (SELECT kmer, CAST(round(1000.0e0 * ln(any_value(t) / CAST(count(*) AS DOUBLE))) AS BIGINT) AS weight FROM rk, lt GROUP BY 1),
    asked AS (SELECT conv_id || '.' || turn AS id, text FROM conversations UNION ALL SELECT 'short', 'abc'),
    qk AS (SELECT DISTINCT id, CAST('0x' || substr(md5('1/' || kmer), 1, 8) AS BIGINT) % 20 AS subset, kmer FROM
      (SELECT id, substr(text, CAST(i AS INTEGER), 8) AS kmer FROM (SELECT *, unnest(range(1, length(text) - 6)) AS i FROM asked))),
    fi AS (SELECT id, count(DISTINCT subset) AS filled FROM qk LEFT JOIN wt USING (kmer) WHERE weight IS NULL OR weight > 0 GROUP BY 1),
    sc AS (SELECT id, subset, lineage, sum(weight) AS score
      FROM qk JOIN rk USING (kmer) JOIN wt USING (kmer) WHERE weight > 0 GROUP BY 1, 2, 3),
    wn AS (SELECT id, subset, lineage, row_number() OVER (PARTITION BY id, subset ORDER BY score DESC, lineage) AS rk FROM sc),
    vo AS (SELECT id, lineage, count(*) AS votes FROM wn WHERE rk = 1 GROUP BY 1, 2),
    be AS (SELECT id, lineage AS best FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, lineage) AS rk FROM vo) WHERE rk = 1),
    sh AS (SELECT id, best, sum(CASE WHEN split_part(lineage, ';', 1) = split_part(best, ';', 1) THEN votes ELSE 0 END) / CAST(any_value(filled) AS DOUBLE) AS lang_confidence,
      sum(CASE WHEN lineage = best THEN votes ELSE 0 END) / CAST(any_value(filled) AS DOUBLE) AS source_confidence FROM vo JOIN be USING (id) JOIN fi USING (id) GROUP BY 1, 2),
    al AS (SELECT id, best, coalesce(lang_confidence, 0) AS lang_confidence, coalesce(source_confidence, 0) AS source_confidence FROM (SELECT DISTINCT id FROM asked) LEFT JOIN sh USING (id))
    SELECT id, CASE WHEN lang_confidence >= 0.6e0 THEN split_part(best, ';', 1) ELSE 'unclassified_root' END AS lang,
    CASE WHEN source_confidence >= 0.6e0 THEN split_part(best, ';', 2) ELSE 'unclassified_' || coalesce(split_part(best, ';', 1), 'root') END AS source,
    lang_confidence, source_confidence FROM al"""


def _classified(spark, sf):
    asked = parallel_scan(table(spark, sf, "conversations")).select(
        F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("seq")
    )
    asked = asked.union(spark.createDataFrame([("short", "abc")], "id string, seq string"))  # too short for a k-mer
    known = parallel_scan(table(spark, sf, "documents")).select("lang", "source", F.col("text").alias("seq"))
    return A.classify(asked, known, ["lang", "source"])


@query("r9_classify", _CLASSIFY)
def r9(spark, sf):
    return _classified(spark, sf)


@query(
    "r10_unclassified",
    "SELECT id, nullif(lang, 'unclassified_root') AS lang, CASE WHEN NOT starts_with(source, 'unclassified_') THEN source END AS source FROM ("
    + _CLASSIFY + ") WHERE starts_with(source, 'unclassified_')",
)
def r10(spark, sf):
    out = _classified(spark, sf).withColumns({"lang": null_unclassified("lang"), "source": null_unclassified("source")})
    return out.filter(F.col("source").isNull()).select("id", "lang", "source")


def _descent_level(level: int, frontier: str) -> str:
    """Votes of the queries standing in ``frontier(id, node)`` as ``won<level>(id, winner, share)``."""
    return f""", sc{level} AS (SELECT id, subset, child, sum(weight) AS score FROM qk JOIN {frontier} USING (id) JOIN chosen USING (node, kmer) GROUP BY ALL),
    bs{level} AS (SELECT id, subset, child FROM (SELECT *, row_number() OVER (PARTITION BY id, subset ORDER BY score DESC, child) AS rk FROM sc{level}) WHERE rk = 1),
    vo{level} AS (SELECT id, child, count(*) AS votes FROM bs{level} GROUP BY 1, 2),
    won{level} AS (SELECT id, child AS winner, votes / CAST(al AS DOUBLE) AS share FROM (SELECT *, sum(votes) OVER (PARTITION BY id) AS al,
      row_number() OVER (PARTITION BY id ORDER BY votes DESC, child) AS rk FROM vo{level}) WHERE rk = 1)"""


_DESCENT = (
    """WITH rk AS (SELECT lang, source, substr(text, CAST(i AS INTEGER), 8) AS kmer FROM (SELECT lang, source, text, unnest(range(1, length(text) - 6)) AS i FROM documents)),
    lv AS (SELECT '' AS node, lang AS child, kmer, count(*) AS n FROM rk GROUP BY ALL UNION ALL
      SELECT lang AS node, lang || ';' || source AS child, kmer, count(*) AS n FROM rk GROUP BY ALL),
    cn AS (SELECT *, sum(n) OVER (PARTITION BY node, child) AS cs, sum(n) OVER (PARTITION BY node, kmer) AS ks, sum(n) OVER (PARTITION BY node) AS ns FROM lv),
    ra AS (SELECT *, ln(((n + 0.5e0) / (cs + 1.0e0)) / ((ks - n + 0.5e0) / (ns - cs + 1.0e0))) AS ratio FROM cn WHERE cs < ns),
    chosen AS MATERIALIZED (SELECT node, child, kmer, weight FROM (SELECT *, row_number() OVER (PARTITION BY node, child ORDER BY round(n * ratio, 6) DESC, kmer) AS place
      FROM (SELECT *, CAST(round(1000.0e0 * ratio) AS BIGINT) AS weight FROM ra WHERE ratio >= ln(2.0e0))) WHERE place <= 200),
    asked AS (SELECT conv_id || '.' || turn AS id, text FROM conversations UNION ALL SELECT 'short', 'abc'),
    qk AS MATERIALIZED (SELECT DISTINCT id, CAST('0x' || substr(md5('1/' || kmer), 1, 8) AS BIGINT) % 20 AS subset, kmer FROM
      (SELECT id, substr(text, CAST(i AS INTEGER), 8) AS kmer FROM (SELECT *, unnest(range(1, length(text) - 6)) AS i FROM asked))
      WHERE kmer IN (SELECT kmer FROM chosen)),
    f1 AS (SELECT DISTINCT id, '' AS node FROM asked)"""
    + _descent_level(1, "f1")
    + ", f2 AS (SELECT id, winner AS node FROM won1 WHERE share >= 0.6e0)"
    + _descent_level(2, "f2")
    + """ SELECT f1.id, coalesce(f2.node, 'unclassified_root') AS lang,
    CASE WHEN won2.share >= 0.6e0 THEN split_part(won2.winner, ';', 2) ELSE 'unclassified_' || coalesce(f2.node, 'root') END AS source,
    coalesce(won1.share, 0) AS lang_confidence, coalesce(won2.share, 0) AS source_confidence
    FROM f1 LEFT JOIN won1 USING (id) LEFT JOIN f2 USING (id) LEFT JOIN won2 USING (id)"""
)


@query("r9_tree_descent", _DESCENT)
def r9_descent(spark, sf):
    asked = parallel_scan(table(spark, sf, "conversations")).select(
        F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("seq")
    )
    asked = asked.union(spark.createDataFrame([("short", "abc")], "id string, seq string"))  # too short for a k-mer
    known = parallel_scan(table(spark, sf, "documents")).select("lang", "source", F.col("text").alias("seq"))
    return descent.classify(asked, known, ["lang", "source"])


# -- from reads to a bundle ----------------------------------------------------------------------------------------

_TRIMMED = with_("reads").replace("WITH ", "WITH RECURSIVE ", 1) + """, t0 AS (SELECT *, list_position(list_transform(qual, lambda q: q <= 2), true) AS low FROM reads),
    t1 AS (SELECT *, CASE WHEN low > 0 THEN low - 1 ELSE length(seq) END AS size, CASE mate WHEN 1 THEN 12 ELSE 10 END AS target FROM t0),
    t2 AS (SELECT sample_id, read_id, mate, substr(seq, 1, target) AS seq, qual[1:target] AS qual FROM t1 WHERE size > 0 AND size >= target),
    t3 AS (SELECT * FROM t2 WHERE list_sum(list_transform(qual, lambda q: pow(10.0e0, q / -10.0e0))) <= 2.0e0),
    kept AS (SELECT * FROM t3 WHERE (sample_id, read_id) IN (SELECT (sample_id, read_id) FROM t3 GROUP BY sample_id, read_id HAVING count(*) = 2))"""


def _corrected_sql(mate: int) -> str:
    return _parents_of(mate).replace("FROM reads", "FROM kept") + f""",
    chain{mate} AS (SELECT seq, parent AS variant FROM parents{mate} UNION ALL SELECT c.seq, p.parent FROM chain{mate} c JOIN parents{mate} p ON p.seq = c.variant),
    roots{mate} AS (SELECT seq, variant FROM chain{mate} WHERE variant NOT IN (SELECT seq FROM parents{mate})),
    m{mate} AS (SELECT sample_id, read_id, coalesce(variant, seq) AS seq FROM kept LEFT JOIN roots{mate} USING (seq) WHERE mate = {mate})"""


_PROCESSED = _TRIMMED + _corrected_sql(1) + _corrected_sql(2) + """,
    pr AS (SELECT a.sample_id, a.read_id, a.seq AS f, reverse(translate(b.seq, 'ACGT', 'TGCA')) AS r FROM m1 a JOIN m2 b USING (sample_id, read_id)),
    ov AS (SELECT *, list_max(list_filter(range(4, least(length(f), length(r)) + 1), lambda o: right(f, CAST(o AS INTEGER)) = left(r, CAST(o AS INTEGER)))) AS o FROM pr),
    merged AS (SELECT sample_id, f || substr(r, CAST(o AS INTEGER) + 1) AS seq FROM ov WHERE o IS NOT NULL),
    u AS (SELECT sample_id, seq, count(*) AS count FROM merged WHERE length(seq) BETWEEN 14 AND 18 GROUP BY 1, 2)""" + _FLAGS.removeprefix(_UNIQUES) + """,
    votes AS (SELECT w.seq, count(hit.seq) AS flagged, count(*) AS samples FROM w LEFT JOIN hit ON w.sample_id = hit.sample_id AND w.seq = hit.seq GROUP BY 1),
    final AS (SELECT * FROM u WHERE seq NOT IN (SELECT seq FROM votes WHERE flagged > 0 AND (flagged >= samples OR flagged >= (samples - 1) * 0.9)))"""


def _processed(spark, sf):
    return reads_to_counts.process(standin.reads(spark, sf), {1: 12, 2: 10}, 2.0, min_overlap=4, lengths=(14, 18))


@query("r7_reads_to_counts", _PROCESSED + " SELECT * FROM final")
def r7_counts(spark, sf):
    return _processed(spark, sf).counts


@query(
    "r7_reads_tracked",
    _PROCESSED + """ SELECT sample_id, CAST(sum(i) AS BIGINT) AS input, CAST(sum(k) AS BIGINT) AS filtered, CAST(sum(m) AS BIGINT) AS merged,
    CAST(sum(b) AS BIGINT) AS banded, CAST(sum(c) AS BIGINT) AS nonchimeric FROM (
      SELECT sample_id, 1 AS i, 0 AS k, 0 AS m, 0 AS b, 0 AS c FROM reads WHERE mate = 1 UNION ALL SELECT sample_id, 0, 1, 0, 0, 0 FROM kept WHERE mate = 1
      UNION ALL SELECT sample_id, 0, 0, 1, 0, 0 FROM merged UNION ALL SELECT sample_id, 0, 0, 0, count, 0 FROM u UNION ALL SELECT sample_id, 0, 0, 0, 0, count FROM final)
    GROUP BY 1""",
)
def r7_track(spark, sf):
    return _processed(spark, sf).track


@query("r9_reads_to_bundle")
def r9_bundle(spark, sf):
    docs = parallel_scan(table(spark, sf, "documents"))
    meta = docs.groupBy(F.col("source").alias("sample_id")).agg(F.count(F.lit(1)).alias("documents"))
    known = docs.select("lang", "source", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))
    return reads_to_counts.bundle(_processed(spark, sf), meta, known, ["lang", "source"]).melt()
