"""Measuring runs: hits against gold pages, summaries, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HITS = ("top1_doc_hit", "top1_exact_hit", "top5_doc_hit", "top5_exact_hit")


def ordered(name: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(name).alias("x")))), lambda s: s["x"])


def evaluate(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """One row per gold query (query_id, query_en, query_type, gold_doc_id, gold_page_idx): top 1, hit flags, ranked lists. Without hits: null top 1, false flags, empty lists."""
    j = gold.join(hits, "query_id", "left")
    doc = F.coalesce(F.col("doc_id") == F.col("gold_doc_id"), F.lit(False))
    exact = doc & F.coalesce(F.col("page_idx") == F.col("gold_page_idx"), F.lit(False))
    one = F.col("rank") == 1
    some = F.struct("rank", "doc_id", "page_idx", "score")
    ranked = F.array_sort(F.filter(F.collect_list(some), lambda s: s["rank"].isNotNull()))
    out = j.groupBy("query_id", "query_en", "query_type", "gold_doc_id", "gold_page_idx").agg(
        ranked.alias("r"), *[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in zip(HITS, (doc & one, exact & one, doc, exact))]
    )
    first = F.get("r", F.lit(0))
    lists = {"retrieved_doc_ids": "doc_id", "retrieved_page_idxs": "page_idx", "retrieved_scores": "score"}
    return out.select(
        "query_id", "query_en", "query_type", "gold_doc_id", "gold_page_idx", first["doc_id"].alias("top1_doc_id"), first["page_idx"].alias("top1_page_idx"), first["score"].alias("top1_score"), *HITS,
        *[F.to_json(F.col(f"r.{f}")).alias(n) for n, f in lists.items()],
    )


RATES = {"top1_exact_acc": "top1_exact_hit", "top5_exact_recall": "top5_exact_hit", "top1_doc_acc": "top1_doc_hit", "top5_doc_recall": "top5_doc_hit"}


def rates() -> list[Column]:
    return [F.round(F.coalesce(F.avg(F.col(h).cast("int")), F.lit(0.0)), 6).alias(n) for n, h in RATES.items()]


def summarize(details: DataFrame) -> DataFrame:
    """Overall (query_type '(all)') and by query type."""
    parts = details.groupingSets([[], ["query_type"]], "query_type").agg(F.grouping("query_type").alias("g"), F.count("*").alias("num_queries"), *rates())
    return parts.withColumn("query_type", F.when(F.col("g") == 1, "(all)").otherwise(F.col("query_type"))).drop("g")


def summary_json(details: DataFrame) -> DataFrame:
    """One row, one JSON document: the overall figures and a list by query type."""
    s = summarize(details)
    figures = ["num_queries", *RATES]
    total = s.where("query_type = '(all)'").select(*figures)
    by = s.where("query_type <> '(all)'").agg(F.array_sort(F.collect_list(F.struct("query_type", *figures))).alias("by_query_type"))
    return total.crossJoin(by).select(F.to_json(F.struct(*figures, "by_query_type")).alias("summary"))


def failures(details: DataFrame) -> DataFrame:
    return details.where(~F.col("top1_exact_hit") | ~F.col("top5_exact_hit")).select("query_id", "query_type", "query_en", "gold_doc_id", "gold_page_idx", "top1_doc_id", "top1_page_idx", *HITS)


def union_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """All runs by column name, with run_name; columns that a run lacks are null there."""
    out = None
    for name, df in runs.items():
        df = df.withColumn("run_name", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no run to compare")
    return out


def compare_runs(runs: DataFrame) -> DataFrame:
    return runs.groupBy("run_name").agg(F.count("*").alias("num_queries"), *rates())


def best_by_query(runs: DataFrame) -> DataFrame:
    worth = 4 * F.col("top1_exact_hit").cast("int") + 2 * F.col("top5_exact_hit").cast("int") + F.col("top1_doc_hit").cast("int")
    w = Window.partitionBy("query_id").orderBy(worth.desc(), "run_name")
    return runs.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def apply_labels(starter: DataFrame, hits: DataFrame) -> DataFrame:
    """starter (query_id, directive): 'rank=N' takes the N-th hit, 'doc,page' names a page, 'skip' and anything else skips."""
    d = F.trim(F.coalesce("directive", F.lit("")))
    rank = F.regexp_extract(d, r"^rank=\s*(\d+)$", 1).try_cast("int")
    page = F.regexp_extract(d, r"^[^,]*,\s*(-?\d+)\s*$", 1).try_cast("int")
    chosen = hits.select("query_id", F.col("rank").alias("chosen_rank"), F.col("doc_id").cast("string").alias("hit_doc"), F.col("page_idx").alias("hit_page"))
    j = starter.withColumn("chosen_rank", rank).join(chosen, ["query_id", "chosen_rank"], "left")
    by_rank, manual = F.col("hit_doc").isNotNull(), F.col("chosen_rank").isNull() & page.isNotNull() & (F.lower(d) != "skip")
    return j.select(
        "query_id", F.when(by_rank, F.col("hit_doc")).when(manual, F.trim(F.substring_index(d, ",", 1))).otherwise("").alias("gold_doc_id"),
        F.when(by_rank, F.col("hit_page")).when(manual, page).otherwise(-1).alias("gold_page_idx"),
        F.when(by_rank, F.concat(F.lit("bm25_top"), F.col("chosen_rank").cast("string"))).when(manual, "manual").otherwise("skip").alias("label_source"),
    )
