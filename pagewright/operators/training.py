"""Data side of training: splits, weights, losses, pooling, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T


def balanced_weights(df: DataFrame, by: str = "query_type") -> DataFrame:
    sizes = df.groupBy(by).agg((1.0 / F.count("*")).alias("weight"))
    return df.join(sizes, by)


def weighted_draw(df: DataFrame, n: int, seed: int = 0, weight: str = "weight") -> DataFrame:
    """n rows drawn with replacement in proportion to the weights: each draw falls into the row whose range of cumulated weight holds it.

    Ranges are laid out per part of the rows' hash values and shifted by the sums of the parts before, so no single task
    sees all rows and a repeated task lays out the same."""
    spark = df.sparkSession
    part = df.withColumn("_part", F.pmod(F.xxhash64(F.lit("part"), *df.columns), F.lit(4 * spark.sparkContext.defaultParallelism))).withColumn("_in", F.sum(weight).over(Window.partitionBy("_part").orderBy(F.xxhash64(*df.columns)).rowsBetween(Window.unboundedPreceding, 0)))
    sums = part.groupBy("_part").agg(F.sum(weight).alias("w")).select("_part", (F.sum("w").over(Window.orderBy("_part")) - F.col("w")).alias("_before"), F.sum("w").over(Window.partitionBy(F.lit(1))).alias("_all"))
    rows = part.join(F.broadcast(sums), "_part").withColumn("_hi", F.col("_before") + F.col("_in")).withColumn("_lo", F.col("_hi") - F.col(weight))
    draws = spark.range(n).select("id", (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 40)) / float(1 << 40)).alias("_u"))
    at = rows.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") / F.col("_all") * n), F.floor(F.col("_hi") / F.col("_all") * n))))
    hit = draws.withColumn("_cell", F.floor(F.col("_u") * n)).join(at, "_cell").where("_u * _all >= _lo and _u * _all < _hi")
    return hit.select(*df.columns)


def split_by_query(df: DataFrame, ratio: float = 0.2, min_val: int = 1, seed: int = 42) -> DataFrame:
    """df with is_val: whole queries, in the order of md5(query_id, seed); at least one and never all of them."""
    ids = df.select("query_id").distinct()
    n = ids.count()
    n_val = max(1, min(n - 1, max(min_val, int(n * ratio))))
    ids = ids.withColumn("o", F.md5(F.concat(F.col("query_id").cast("string"), F.lit(str(seed))))).withColumn("head", F.substring("o", 1, 3))
    sizes = {r["head"]: r["count"] for r in ids.groupBy("head").count().collect()}  # 4,096 rows at most
    taken, edge = 0, None
    for edge in sorted(sizes, reverse=True):  # whole heads are taken but for the last, of which the highest are
        if taken + sizes[edge] >= n_val:
            break
        taken += sizes[edge]
    rest = ids.where(F.col("head") == edge).orderBy(F.col("o").desc(), "query_id").limit(max(n_val - taken, 0))
    val = ids.where(F.col("head") > edge).unionAll(rest).select("query_id", F.lit(True).alias("is_val"))
    return df.join(val, "query_id", "left").withColumn("is_val", F.coalesce("is_val", F.lit(False)))


def hinge_loss(triples: DataFrame, margin: float = 0.2) -> DataFrame:
    """triples (q, p, n): mean of max(0, margin - q.p + q.n)."""
    return triples.agg(F.round(F.avg(F.greatest(F.lit(0.0), margin - T.dot(F.col("q"), F.col("p")) + T.dot(F.col("q"), F.col("n")))), 6).alias("loss"))


def info_nce(batches: DataFrame, temperature: float = 0.07) -> DataFrame:
    """batches (batch, i, q, p): symmetric contrastive loss of each batch; all pairs of a batch meet, a batch being small."""
    left = batches.select("batch", "i", "q")
    right = batches.select("batch", F.col("i").alias("j"), "p")
    s = left.join(right, "batch").select("batch", "i", "j", (T.dot(F.col("q"), F.col("p")) / temperature).alias("s"))
    half = lambda by: s.groupBy("batch", by).agg((F.max("s") + F.log(F.sum(F.exp("s")) / F.exp(F.max("s"))) - F.max(F.when(F.col("i") == F.col("j"), F.col("s")))).alias("l")).groupBy("batch").agg(F.avg("l").alias(f"loss_{by}"))
    return half("i").join(half("j"), "batch").select("batch", F.round((F.col("loss_i") + F.col("loss_j")) / 2, 6).alias("loss"))


def combined_loss(nce: Column, margin: Column, weight: float = 0.25) -> Column:
    return nce + weight * margin


def batch_losses(triples: DataFrame, margin: float = 0.2, weight: float = 0.25, temperature: float = 0.07) -> DataFrame:
    """triples (batch, i, q, p, n): (batch, nce, margin_loss, loss) of each batch."""
    m = F.greatest(F.lit(0.0), margin - T.dot(F.col("q"), F.col("p")) + T.dot(F.col("q"), F.col("n")))
    hinge = triples.groupBy("batch").agg(F.avg(m).alias("margin_loss"))
    both = info_nce(triples.select("batch", "i", "q", "p"), temperature).withColumnRenamed("loss", "nce").join(hinge, "batch")
    return both.select("batch", "nce", F.round("margin_loss", 6).alias("margin_loss"), F.round(combined_loss(F.col("nce"), F.col("margin_loss"), weight), 6).alias("loss"))


def best_epoch(history: DataFrame) -> DataFrame:
    return history.agg(F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_epoch"), F.min("val_loss").alias("best_val_loss"))


def position_pool(vectors: Column, mask: Column | None = None) -> Column:
    """Mean of token vectors with weights that rise evenly from 1 to 2, masked ones out."""
    n = F.size(vectors)
    step = F.when(n > 1, F.lit(1.0) / (n - 1)).otherwise(0.0)
    w = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lit(1.0) + i * step)
    if mask is not None:
        w = F.zip_with(w, mask, lambda a, m: a * m.cast("double"))
    total = F.greatest(F.aggregate(w, F.lit(0.0), lambda a, x: a + x), F.lit(1e-6))
    scaled = F.zip_with(w, vectors, lambda a, v: F.transform(v, lambda x: x.cast("double") * a / total))
    zero = F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0))
    return F.aggregate(scaled, zero, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def summarize_pairs(df: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Rows, queries, counts by type and source; with a listing of files (path), how many image paths are missing."""
    counts = lambda c: value_counts(df, c).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"{c}_counts"))
    out = df.agg(F.count("*").alias("rows"), F.count_distinct("query_id").alias("query_count")).crossJoin(counts("query_type"))
    if "neg_source" in df.columns:
        out = out.crossJoin(counts("neg_source"))
    if files is not None:
        for side in ("pos", "neg"):
            gone = df.select(F.col(f"{side}_image_path").alias("path")).join(files.select("path"), "path", "left_anti")
            out = out.crossJoin(gone.agg(F.count("*").alias(f"missing_{side}_images")))
    return out


def pairs_per_query(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_pairs"), F.count_distinct("query_id").alias("n_queries"), F.bround(F.count("*") / F.count_distinct("query_id"), 2).alias("pairs_per_query"))
