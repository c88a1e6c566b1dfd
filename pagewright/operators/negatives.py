"""Hard negatives and training pairs. gold: query_id, query_en, query_type, gold_doc_id, gold_page_idx."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright import lexicons as L
from pagewright.functions import text as T

PAIR_KEY = ["query_id", "pos_doc_id", "pos_page_idx", "neg_doc_id", "neg_page_idx"]


def first_wrong(hits: DataFrame, gold: DataFrame, source: str, k: int = 10) -> DataFrame:
    """(query_id, neg_doc_id, neg_page_idx, neg_source): the best ranked page that isn't the gold one, none if all k are."""
    wrong = hits.where(F.col("rank") <= k).join(gold.select("query_id", "gold_doc_id", "gold_page_idx"), "query_id").where(~((F.col("doc_id") == F.col("gold_doc_id")) & (F.col("page_idx") == F.col("gold_page_idx"))))
    best = wrong.groupBy("query_id").agg(F.min_by(F.struct("doc_id", "page_idx"), "rank").alias("w"))
    return best.select("query_id", F.col("w.doc_id").alias("neg_doc_id"), F.col("w.page_idx").alias("neg_page_idx"), F.lit(source).alias("neg_source"))


def _neighbours(gold: DataFrame, pages: DataFrame) -> DataFrame:
    """Both neighbours of each gold page that exist, found by key, not by order: page numbers may have gaps."""
    each = gold.select("query_id", "gold_doc_id", F.explode(F.array(F.struct(F.lit("adjacent_prev").alias("s"), (F.col("gold_page_idx") - 1).alias("p")), F.struct(F.lit("adjacent_next").alias("s"), (F.col("gold_page_idx") + 1).alias("p")))).alias("n"))
    wanted = each.select("query_id", F.col("gold_doc_id").alias("neg_doc_id"), F.col("n.p").alias("neg_page_idx"), F.col("n.s").alias("neg_source")).where("neg_page_idx >= 0")
    there = pages.select(F.col("doc_id").alias("neg_doc_id"), F.col("page_idx").alias("neg_page_idx"))
    return wanted.join(there, ["neg_doc_id", "neg_page_idx"], "left_semi").select("query_id", "neg_doc_id", "neg_page_idx", "neg_source")


def adjacent_negatives(gold: DataFrame, pages: DataFrame | None = None, mode: str = "prev_else_next") -> DataFrame:
    """mode: prev_else_next; both; unchecked (the page before, else the one after, whether or not it exists)."""
    if mode == "unchecked":
        first = F.col("gold_page_idx") > 0
        return gold.select("query_id", F.col("gold_doc_id").alias("neg_doc_id"), F.when(first, F.col("gold_page_idx") - 1).otherwise(F.col("gold_page_idx") + 1).alias("neg_page_idx"), F.when(first, "adjacent_prev").otherwise("adjacent_next").alias("neg_source"))
    found = _neighbours(gold, pages)
    if mode == "both":
        return found
    w = Window.partitionBy("query_id").orderBy(F.col("neg_page_idx"))
    return found.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def far_negative(gold: DataFrame, pages: DataFrame) -> DataFrame:
    """The page of the gold document that lies farthest away; the smaller number at equal distance."""
    ends = pages.groupBy("doc_id").agg(F.min("page_idx").alias("first"), F.max("page_idx").alias("last"))  # no other page can lie farthest
    g = F.col("gold_page_idx")
    j = gold.select("query_id", F.col("gold_doc_id").alias("doc_id"), "gold_page_idx").join(ends, "doc_id").where((F.col("first") != g) | (F.col("last") != g))
    far = F.when(F.abs(F.col("first") - g) >= F.abs(F.col("last") - g), F.col("first")).otherwise(F.col("last"))
    return j.select("query_id", F.col("doc_id").alias("neg_doc_id"), far.alias("neg_page_idx"), F.lit("same_doc_far").alias("neg_source"))


def pairs(gold: DataFrame, negatives: DataFrame, suffix: str | None = None, root: str = "data/pages") -> DataFrame:
    """Training pairs of one kind of negative; suffix of the sample id, the negative's source if none."""
    n = negatives.join(gold, "query_id")
    zh = F.col("query_zh") if "query_zh" in gold.columns else F.col("query_en")
    return n.select(
        F.concat_ws("_", F.col("query_id").cast("string"), F.lit(suffix) if suffix else F.col("neg_source")).alias("sample_id"), "query_id", "query_en", zh.alias("query_zh"), "query_type",
        F.col("gold_doc_id").alias("pos_doc_id"), F.col("gold_page_idx").alias("pos_page_idx"), T.page_path(root, F.col("gold_doc_id").cast("string"), F.col("gold_page_idx")).alias("pos_image_path"),
        "neg_doc_id", "neg_page_idx", T.page_path(root, F.col("neg_doc_id").cast("string"), F.col("neg_page_idx")).alias("neg_image_path"), "neg_source",
    )


def keep_first(parts: list[DataFrame], key: list[str] = PAIR_KEY) -> DataFrame:
    """Union in order; of rows with one key the one of the earliest part stays (within a part, the smallest sample id)."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("part", "sample_id")
    return out.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth", "part")


def keeps_pair() -> Column:
    en, zh = (F.lower(T.strip(F.coalesce(c, F.lit("")))) for c in ("query_en", "query_zh"))
    return ~(T.holds(en, L.COPIED_EN) | T.holds(zh, L.COPIED_ZH) | T.holds(en, L.WEAK_TITLES) | T.holds(zh, L.WEAK_TITLES))


def trainset(stage: str, gold: DataFrame, pages: DataFrame, lexical: DataFrame, vision: DataFrame | None = None, dense: DataFrame | None = None, both: DataFrame | None = None, base: DataFrame | None = None) -> DataFrame:
    """The stages of the pair table.

    v1: lexical, vision and unchecked neighbour per query; large: lexical, neighbour, farthest; v2: base and vision
    negatives; v3: base without copied or weak queries; v4: base and gold pairs of four sources."""
    if stage == "v1":
        parts = [pairs(gold, first_wrong(lexical, gold, "bm25_hard"), "bm25"), pairs(gold, first_wrong(vision, gold, "vision_hard"), "vision"), pairs(gold, adjacent_negatives(gold, mode="unchecked"))]
    elif stage == "large":
        parts = [pairs(gold, first_wrong(lexical, gold, "bm25_hard"), "bm25"), pairs(gold, adjacent_negatives(gold, pages)), pairs(gold, far_negative(gold, pages))]
    elif stage == "v2":
        parts = [base, pairs(gold, first_wrong(vision, gold, "vision_hard"), "vision")]
    elif stage == "v3":
        return base.where(keeps_pair())
    elif stage == "v4":
        named = {"gold_bm25": lexical, "gold_siglip_v1": dense, "gold_two_stage": both}
        near = adjacent_negatives(gold, pages, "both").withColumn("neg_source", F.concat(F.lit("gold_"), "neg_source"))
        parts = [base, *[pairs(gold, first_wrong(h, gold, s, 5)) for s, h in named.items() if h is not None], pairs(gold, near)]
    else:
        raise ValueError(stage)
    return keep_first(parts)
