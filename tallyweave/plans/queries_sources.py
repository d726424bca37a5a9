"""Queries over readers and writers. Tables make a round trip through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.countset import CountSet
from tallyweave.plans import standin
from tallyweave.plans.registry import query
from tallyweave.plans.standin import table, with_
from tallyweave.session import scratch_path
from tallyweave.sources import cache, delimited
from tallyweave.sources import reads as read_files

_CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("s1_read_tsv", "SELECT * FROM customer")
def s1(spark, sf):
    path = scratch_path(spark, "s1")
    delimited.write_tsv(table(spark, sf, "customer"), path)
    return delimited.read_tsv(spark, path, _CUSTOMER)


@query("s2_read_csv", "SELECT id, grp, value FROM (" + standin.CTES["assay"][0] + ")")
def s2(spark, sf):
    path = scratch_path(spark, "s2")
    delimited.write_csv(standin.assay(spark, sf), path)
    return delimited.read_csv(spark, path, "id bigint, grp string, value double")


@query(
    "s3_read_lab_sheet",
    'SELECT id AS "Bird_ID", grp AS "Group_name", value AS "CFU_in_1_g" FROM (' + standin.CTES["assay"][0] + ")",
)
def s3(spark, sf):
    path = scratch_path(spark, "s3")
    sheet = standin.assay(spark, sf).toDF("Bird ID#", "Group\n(name)", "CFU \nin 1/g")
    delimited.write_tsv(sheet, path, lineSep="\r\n")
    return delimited.read_lab_sheet(spark, path, {"Bird_ID": "bigint", "CFU_in_1_g": "double"})


@query("s4_write_tsv", with_("meta") + " SELECT * FROM meta")
def s4(spark, sf):
    path = scratch_path(spark, "s4")
    delimited.write_tsv(standin.meta(spark, sf), path)
    return delimited.read_tsv(
        spark, path, "sample_id string, grp string, depth_hint double, sample_type string, is_neg boolean"
    )


@query("s5_write_by_key", with_("assay") + " SELECT id, value, grp AS comparison FROM assay")
def s5(spark, sf):
    path = scratch_path(spark, "s5")
    delimited.write_by_key(standin.assay(spark, sf).withColumnRenamed("grp", "comparison"), path)
    return spark.read.csv(path, sep="\t", header=True, schema="id bigint, value double, comparison string")


@query(
    "s6_save_load_bundle",
    with_("sparse", "meta", "tax")
    + """ SELECT sample_type, count(*) AS cells, CAST(sum(count) AS BIGINT) AS total, count(domain) AS with_domain
    FROM sparse JOIN meta USING (sample_id) JOIN tax USING (feature_id) GROUP BY 1""",
)
def s6(spark, sf):
    path = scratch_path(spark, "s6")
    CountSet.aligned(standin.sparse(spark, sf), standin.meta(spark, sf), standin.tax(spark, sf)).save(path)
    melted = CountSet.load(spark, path).melt()
    return melted.groupBy("sample_type").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("count").alias("total"), F.count("domain").alias("with_domain")
    )


@query(
    "s7_compute_once",
    with_("dense") + " SELECT sample_id, CAST(sum(count) AS BIGINT) AS total FROM dense GROUP BY 1",
)
def s7(spark, sf):
    root = scratch_path(spark, "s7")

    def build():
        return standin.dense(spark, sf).groupBy("sample_id").agg(F.sum("count").alias("total"))

    inputs = [standin.table(spark, sf, "lineitem"), standin.table(spark, sf, "part")]
    cache.compute_once(spark, root, "depth", {"by": "sample"}, build, inputs)
    return cache.compute_once(spark, root, "depth", {"by": "sample"}, build, inputs)


@query(
    "s8_list_read_files",
    with_("reads") + " SELECT DISTINCT sample_id, mate FROM reads",
)
def s8(spark, sf):
    path = scratch_path(spark, "s8")
    read_files.write_fastq(standin.reads(spark, sf), path)
    return read_files.list_read_files(spark, path).select("sample_id", "mate").distinct()


@query(
    "s9_read_fastq",
    with_("reads")
    + """ SELECT sample_id, read_id, mate, seq, CAST(list_sum(qual) AS BIGINT) AS qual_total,
    array_to_string(qual, ' ') AS quals FROM reads""",
)
def s9(spark, sf):
    path = scratch_path(spark, "s9")
    read_files.write_fastq(standin.reads(spark, sf), path)
    out = read_files.read_fastq(spark, path)
    return out.select(
        "sample_id",
        "read_id",
        "mate",
        "seq",
        F.aggregate("qual", F.lit(0).cast("bigint"), lambda a, q: a + q).alias("qual_total"),
        F.array_join(F.transform("qual", lambda q: q.cast("string")), " ").alias("quals"),
    )


@query(
    "s10_write_fasta",
    with_("tax") + " SELECT '>' || feature_id AS line FROM tax WHERE domain IS NULL UNION ALL "
    "SELECT sequence FROM tax WHERE domain IS NULL",
)
def s10(spark, sf):
    path = scratch_path(spark, "s10")
    read_files.write_fasta(standin.tax(spark, sf).filter(F.col("domain").isNull()), path)
    return spark.read.text(path).withColumnRenamed("value", "line")
