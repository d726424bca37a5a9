"""Count-table views of the star-schema test tables, as DataFrames and as SQL text of the same meaning.

``dense``       supplier x (brand/type), number of line items
``sparse``      supplier x part, number of line items
``meta``        supplier with region as group and sample class
``tax``         part with ranks derived from type, brand, name and size; some ranks empty
``tax_dense``   brand/type features with ranks
``course``      (nation, year) x (brand/type): a time course; ``course_meta`` has region and day
``assay``       customer balance as a measured value by market segment; negative means not detected
``amplicon``    the nucleotide letters of every sentence of every document; sample = document source
``reads``       two overlapping reads per amplicon with derived qualities
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.session import parallel_scan

CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "dense": (
        """SELECT CAST(l_suppkey AS VARCHAR) AS sample_id, p_brand || '/' || p_type AS feature_id, count(*) AS count
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
        (),
    ),
    "sparse": (
        """SELECT CAST(l_suppkey AS VARCHAR) AS sample_id, CAST(l_partkey AS VARCHAR) AS feature_id, count(*) AS count
        FROM lineitem GROUP BY 1, 2""",
        (),
    ),
    "meta": (
        """SELECT CAST(s_suppkey AS VARCHAR) AS sample_id, 'R' || n_regionkey AS grp, s_acctbal AS depth_hint,
        CASE n_regionkey WHEN 0 THEN 'neg' WHEN 1 THEN 'mock' ELSE 'exp' END AS sample_type,
        n_regionkey = 0 AS is_neg
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
        (),
    ),
    "tax": (
        """SELECT CAST(p_partkey AS VARCHAR) AS feature_id, p_name AS sequence, nullif(p_type, 'PROMO') AS domain,
        nullif(p_brand, 'Brand#1') AS phylum, split_part(p_name, ' ', 1) AS class,
        nullif(split_part(p_name, ' ', 2), 'ring') AS "order",
        CASE WHEN p_size <= 25 THEN 'size' || p_size END AS family,
        CASE WHEN p_size <= 10 THEN 'fine' || p_size END AS genus, CAST(NULL AS VARCHAR) AS species FROM part""",
        (),
    ),
    "tax_dense": (
        """SELECT DISTINCT p_brand || '/' || p_type AS feature_id, p_type AS domain, p_brand AS phylum FROM part""",
        (),
    ),
    "course": (
        """SELECT s_nationkey || '/' || year(l_shipdate) AS sample_id, p_brand || '/' || p_type AS feature_id,
        count(*) AS count
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
        (),
    ),
    "course_meta": (
        """SELECT DISTINCT s_nationkey || '/' || year(l_shipdate) AS sample_id, 'R' || n_regionkey AS room,
        CAST(year(l_shipdate) - 1995 AS INTEGER) AS day
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
        (),
    ),
    "assay": (
        """SELECT c_custkey AS id, c_mktsegment AS grp, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS value
        FROM customer""",
        (),
    ),
    "amplicon": (
        """SELECT sample_id, read_id, seq FROM (
          SELECT source AS sample_id, doc_id || '.' || i AS read_id,
                 regexp_replace(upper(parts[i]), '[^ACGT]', '', 'g') AS seq
          FROM (SELECT source, doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
                FROM (SELECT source, doc_id, string_split_regex(text, '[.\\n]') AS parts FROM documents)))
        WHERE length(seq) > 0""",
        (),
    ),
    "reads": (
        """SELECT sample_id, read_id, mate, seq,
          list_transform(range(1, length(seq) + 1),
            lambda i: CAST(1 + (ascii(seq[i]) * 7 + i * 13 + length(seq) * mate) % 40 AS INTEGER)) AS qual
        FROM (SELECT sample_id, read_id, 1 AS mate, substr(seq, 1, CAST(ceil(length(seq) * 0.75e0) AS INTEGER)) AS seq
              FROM amplicon
              UNION ALL
              SELECT sample_id, read_id, 2 AS mate,
                substr(reverse(translate(seq, 'ACGT', 'TGCA')), 1, CAST(ceil(length(seq) * 0.75e0) AS INTEGER)) AS seq
              FROM amplicon)""",
        ("amplicon",),
    ),
}


def with_(*names: str) -> str:
    """``WITH`` clause holding the named views and what they need."""
    chosen: list[str] = []

    def add(name: str) -> None:
        for dep in CTES[name][1]:
            add(dep)
        if name not in chosen:
            chosen.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in chosen)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_brand", "p_type").alias("feature_id")
    )
    return (
        items.join(parts, "l_partkey")
        .groupBy(F.col("l_suppkey").cast("string").alias("sample_id"), "feature_id")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").cast("string").alias("sample_id"), F.col("l_partkey").cast("string").alias("feature_id"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = F.col("n_regionkey")
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").cast("string").alias("sample_id"),
            F.concat(F.lit("R"), region.cast("string")).alias("grp"),
            F.col("s_acctbal").alias("depth_hint"),
            F.when(region == 0, "neg").when(region == 1, "mock").otherwise("exp").alias("sample_type"),
            (region == 0).alias("is_neg"),
        )
    )


def tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("feature_id"),
        F.col("p_name").alias("sequence"),
        F.nullif(F.col("p_type"), F.lit("PROMO")).alias("domain"),
        F.nullif(F.col("p_brand"), F.lit("Brand#1")).alias("phylum"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("class"),
        F.nullif(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("ring")).alias("order"),
        F.when(F.col("p_size") <= 25, F.concat(F.lit("size"), size)).alias("family"),
        F.when(F.col("p_size") <= 10, F.concat(F.lit("fine"), size)).alias("genus"),
        F.lit(None).cast("string").alias("species"),
    )


def tax_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .select(F.concat_ws("/", "p_brand", "p_type").alias("feature_id"), F.col("p_type").alias("domain"), F.col("p_brand").alias("phylum"))
        .distinct()
    )


def _course_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_suppkey", "l_partkey", F.year("l_shipdate").alias("year"))
        .join(suppliers, "l_suppkey")
        .withColumn("sample_id", F.concat_ws("/", F.col("s_nationkey").cast("string"), F.col("year").cast("string")))
    )


def course(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_brand", "p_type").alias("feature_id")
    )
    return (
        _course_items(spark, sf_dir)
        .join(parts, "l_partkey")
        .groupBy("sample_id", "feature_id")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def course_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    return (
        _course_items(spark, sf_dir)
        .select("sample_id", "s_nationkey", "year")
        .distinct()
        .join(nations, "s_nationkey")
        .select(
            "sample_id",
            F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("room"),
            (F.col("year") - 1995).alias("day"),
        )
    )


def assay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_mktsegment").alias("grp"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("value"),
    )


def amplicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        parallel_scan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
        .select(F.col("source").alias("sample_id"), "doc_id", F.posexplode(F.split("text", r"[.\n]")).alias("i", "part"))
        .select(
            "sample_id",
            F.concat(F.col("doc_id").cast("string"), F.lit("."), (F.col("i") + 1).cast("string")).alias("read_id"),
            F.regexp_replace(F.upper("part"), "[^ACGT]", "").alias("seq"),
        )
        .filter(F.length("seq") > 0)
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.ceil(F.length("seq") * 0.75).cast("int")
    mates = amplicon(spark, sf_dir).select(
        "sample_id",
        "read_id",
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("mate"), F.substring("seq", F.lit(1), cut).alias("read")),
                F.struct(F.lit(2).alias("mate"), F.substring(F.reverse(F.translate("seq", "ACGT", "TGCA")), F.lit(1), cut).alias("read")),
            )
        ),
    )
    letters = F.split("read", "")
    qual = F.transform(
        letters, lambda ch, i: 1 + (F.ascii(ch) * 7 + (i + 1) * 13 + F.length("read") * F.col("mate")) % 40
    )
    return mates.select("sample_id", "read_id", "mate", F.col("read").alias("seq"), qual.alias("qual"))
