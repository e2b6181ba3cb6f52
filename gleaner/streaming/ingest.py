"""Pages that arrive as files: each micro-batch joins the stored pages of its sources,
and their chunks are made anew from all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.plans.retrieve import chunks_of
from gleaner.sources.files import PAGE, clean_pages
from gleaner.sources.tables import save


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(PAGE).json(folder)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.parquet(path)


def chunk_stream(pages: DataFrame, out: str, checkpoint: str):
    """Starts a query that keeps ``out`` (chunks) and ``out``-pages (the pages they are
    made of), both partitioned by source.  A batch replaces the pages it brings (by
    source and page) and keeps the others; then it rewrites the chunks of its sources.
    A replayed batch writes the same again.  Pages without a source go by the empty one."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        named = batch.withColumn("source", F.coalesce("source", F.lit(""))).withColumn("part", F.concat(F.lit("s-"), F.col("source")))
        fresh = save(named.dropDuplicates(["source", "page"]), "batch")
        if fresh.isEmpty():
            return
        old = _stored(spark, out + "-pages")
        if old is not None:
            touched = old.join(fresh.select("part").distinct(), "part", "left_semi")
            fresh = save(fresh.unionByName(touched.select(*fresh.columns).join(fresh.select("source", "page"), ["source", "page"], "left_anti")), "merged")
        for rows, path in ((fresh, out + "-pages"), (chunks_of(clean_pages(fresh.drop("part"))).withColumn("part", F.concat(F.lit("s-"), F.col("source"))), out)):
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)

    return pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
