"""The driver's tables in the shapes that the operators expect. plans/oracle.py has the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Passages that are broadcast, at most.
SMALL_QUERIES = 10_000
TYPES = ("fact", "layout", "semantic", "navigation")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages of their source, without their texts: page_idx is the place by doc_id."""
    idx = (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("int")
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), idx.alias("page_idx"), F.col("doc_id").alias("src_id"))


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least, where a scan of few and small files has fewer."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages of their source; num_boxes is the number of lines. Pages are numbered without their texts."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("src_id"), F.col("text").alias("ocr_text"))
    rows = texts.join(page_numbers(spark, sf_dir), "src_id")
    return rows.select("doc_id", "page_idx", "src_id", "ocr_text", F.size(F.split("ocr_text", "\n")).alias("num_boxes"))


def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with the text taken as clean already."""
    return pages(spark, sf_dir).withColumnRenamed("ocr_text", "ocr_text_clean").withColumn("ocr_text_clean_len", F.length("ocr_text_clean"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as documents with true neighbours: doc_id conv_id, page_idx turn."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_idx"), "text", "role")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark passages as queries of four types; the query's vector is that with vec_id = query_id."""
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("item_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_en"), kind.alias("query_type"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return queries(spark, sf_dir).select("query_id").join(v, "query_id")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src_id"), "embedding")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """queries with the first document, as a page, that holds the passage; queries without one are left out."""
    q = queries(spark, sf_dir)
    d = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("src_id"), "text"))
    passages = q.select("query_id", "query_en")
    few = passages.limit(SMALL_QUERIES + 1).count() <= SMALL_QUERIES
    first = d.join(F.broadcast(passages) if few else passages, F.expr("contains(text, query_en)")).groupBy("query_id").agg(F.min("src_id").alias("src_id"))
    p = page_numbers(spark, sf_dir).select(F.col("doc_id").alias("gold_doc_id"), F.col("page_idx").alias("gold_page_idx"), "src_id")
    return q.join(first, "query_id").join(p, "src_id").drop("src_id")


def as_pages(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    """hits with src_id as hits with (doc_id, page_idx)."""
    p = page_numbers(spark, sf_dir)
    return hits.join(p, "src_id").drop("src_id")


def turn_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second turn of every conversation as the gold page of a query of its own."""
    t = turns(spark, sf_dir).where("page_idx = 1")
    return t.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_en"), F.col("role").alias("query_type"), F.col("doc_id").alias("gold_doc_id"), F.col("page_idx").alias("gold_page_idx"))
