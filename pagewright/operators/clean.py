"""From extracted page texts to the page index: boilerplate removal, summaries, joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.lexicons import HEADER_LINES

#: Documents whose boilerplate lines are broadcast, at most; beyond it Spark chooses the join.
SMALL_DOCUMENTS = 20_000


def normal_lines(text: Column) -> Column:
    """The lines of a page that say something, normalised, in order."""
    return F.filter(F.transform(T.lines(text), T.normal_line), lambda x: x != "")


def line_stats(pages: DataFrame, column: str = "ocr_text") -> DataFrame:
    """(doc_id, key, n_pages): pages of a document that hold a line, in lower case. A page's lines are made distinct in its row."""
    keys = F.array_distinct(F.transform(normal_lines(F.col(column)), F.lower))
    return pages.select("doc_id", F.explode(keys).alias("key")).groupBy("doc_id", "key").agg(F.count("*").alias("n_pages"))


def boilerplate(pages: DataFrame, column: str = "ocr_text", least: int = 8, share: float = 0.08) -> DataFrame:
    """(doc_id, boiler): lines that so many pages of a document hold. Their number is under 1 / share times a page's lines."""
    size = pages.groupBy("doc_id").agg(F.count("*").alias("doc_pages"))
    often = line_stats(pages, column).where(F.col("n_pages") >= least).join(size, "doc_id").where(F.col("n_pages") / F.col("doc_pages") >= share)
    return often.groupBy("doc_id").agg(F.collect_set("key").alias("boiler"))


def clean_pages(pages: DataFrame, column: str = "ocr_text", headers=HEADER_LINES, **limits) -> DataFrame:
    """pages with ocr_text_clean and the length columns: of each page the lines that are first there, no header and no boilerplate.

    Only counts of lines are shuffled; pages are cleaned in their row."""
    boiler = boilerplate(pages, column, **limits)
    if pages.select("doc_id").distinct().limit(SMALL_DOCUMENTS + 1).count() <= SMALL_DOCUMENTS:
        boiler = F.broadcast(boiler)
    rows = pages.join(boiler, "doc_id", "left").withColumn("_lines", normal_lines(F.col(column)))
    rows = rows.withColumn("_keys", F.transform("_lines", F.lower))
    drop = F.concat(F.array(*map(F.lit, headers)) if headers else F.array().cast("array<string>"), F.coalesce("boiler", F.array().cast("array<string>")))
    rows = rows.withColumn("_drop", drop)
    pairs = F.arrays_zip(F.col("_lines").alias("line"), F.col("_keys").alias("key"))
    first = F.filter(pairs, lambda x, i: (F.array_position("_keys", x["key"]) == i + 1) & ~F.array_contains("_drop", x["key"]))
    out = rows.withColumn("ocr_text_clean", F.array_join(F.transform(first, lambda x: x["line"]), "\n"))
    return with_lengths(out.drop("boiler", "_lines", "_keys", "_drop"), column)


def with_lengths(pages: DataFrame, column: str = "ocr_text") -> DataFrame:
    raw, clean = F.length(F.coalesce(column, F.lit(""))), F.length("ocr_text_clean")
    return pages.withColumns({"ocr_text_len": raw, "ocr_text_clean_len": clean, "ocr_reduction": raw - clean})


def nonempty(pages: DataFrame, column: str = "ocr_text_clean") -> DataFrame:
    return pages.where(F.coalesce(F.length(column), F.lit(0)) > 0)


def filled(df: DataFrame, column: str) -> Column:
    """Whether a text column holds anything; false where there is no such column."""
    return F.coalesce(F.length(column), F.lit(0)) > 0 if column in df.columns else F.lit(False)


# The keys of both summaries.
def clean_summary(pages: DataFrame) -> DataFrame:
    return pages.agg(
        F.count("*").alias("rows"), F.count_distinct("doc_id").alias("documents"), F.count_if(F.col("ocr_text_len") > 0).alias("non_empty_raw_pages"),
        F.count_if(F.col("ocr_text_clean_len") > 0).alias("non_empty_clean_pages"), F.count_if(filled(pages, "error")).alias("error_pages"),
        F.round(F.coalesce(F.avg("ocr_text_clean_len"), F.lit(0.0)), 6).alias("avg_clean_length"), F.round(F.coalesce(F.avg("ocr_reduction"), F.lit(0.0)), 6).alias("avg_reduction"),
    )


def left_with_suffix(left: DataFrame, right: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """Left outer join on those keys that both sides have; other names that clash get the suffix on the right."""
    on = [k for k in keys if k in left.columns and k in right.columns]
    renamed = right.select(*[F.col(c).alias(f"{c}{suffix}" if c in left.columns and c not in on else c) for c in right.columns])
    return left.join(renamed, on, "left")


def build_page_index(manifest: DataFrame, ocr: DataFrame, documents: DataFrame) -> DataFrame:
    out = left_with_suffix(manifest, ocr, ["page_id", "doc_id", "page_idx", "image_path"], "_ocr")
    out = left_with_suffix(out, documents, ["doc_id"], "_doc")
    return out.withColumns({"has_ocr_text": filled(out, "ocr_text"), "has_clean_text": filled(out, "ocr_text_clean"), "has_ocr_error": filled(out, "error")})


def document_ids(index: DataFrame) -> DataFrame:
    """The ids of an index as rows, for indexes whose list of documents is too long for one."""
    return index.where("doc_id is not null").select(F.col("doc_id").cast("string").alias("doc_id")).distinct()


def page_index_summary(index: DataFrame) -> DataFrame:
    """One row; doc_ids is the sorted list of all documents, of which there are far fewer than pages (see document_ids)."""
    return index.agg(
        F.count_distinct("doc_id").alias("documents"), F.count("*").alias("pages"), F.count_if("has_ocr_text").alias("pages_with_ocr_text"), F.count_if("has_clean_text").alias("pages_with_clean_text"),
        F.count_if("has_ocr_error").alias("pages_with_ocr_error"), F.array_sort(F.collect_set(F.col("doc_id").cast("string"))).alias("doc_ids"),
    )


def flatten_ocr(json: Column) -> Column:
    """struct(ocr_text, avg_score, num_boxes) of an OCR result; the result may be wrapped in `res`. Texts and scores pair up as far as both go."""
    shape = "rec_texts array<string>, rec_scores array<string>, rec_boxes array<array<int>>"
    outer = F.from_json(json, f"res struct<{shape}>, {shape}")
    pick = lambda f, t: F.coalesce(outer["res"][f], outer[f], F.array().cast(t))
    texts, scores, boxes = pick("rec_texts", "array<string>"), pick("rec_scores", "array<string>"), pick("rec_boxes", "array<array<int>>")
    n = F.least(F.size(texts), F.size(scores))
    pairs = F.arrays_zip(F.slice(texts, 1, n).alias("t"), F.slice(scores, 1, n).alias("s"))
    pairs = F.filter(F.transform(pairs, lambda p: F.struct(T.strip(p["t"]).alias("t"), p["s"].try_cast("double").alias("s"))), lambda p: F.coalesce(p["t"], F.lit("")) != "")
    good = F.filter(F.transform(pairs, lambda p: p["s"]), lambda s: s.isNotNull())
    mean = F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda a, s: a + s) / F.size(good)).otherwise(0.0)
    return F.struct(F.array_join(F.transform(pairs, lambda p: p["t"]), "\n").alias("ocr_text"), mean.alias("avg_score"), F.size(boxes).alias("num_boxes"))
