"""Table sources and sinks: CSV as the workflow's scripts write it, Parquet for our own tables, JSON summaries, caches."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "documents": "doc_id string, pdf_name string, pdf_path string, page_dir string, page_count int, dpi int, file_size_bytes bigint",
    "manifest": "page_id string, doc_id string, pdf_name string, pdf_path string, page_idx int, image_name string, image_path string, image_rel_path string, dpi int",
    "page_texts": "page_id string, doc_id string, page_idx int, image_path string, ocr_json_path string, num_boxes int, avg_score double, ocr_text string, error string",
    "query_gold": "query_id string, query_zh string, query_en string, query_type string, cand_doc_id string, cand_page_idx int, confidence string, why_this_page string, label_status string, final_doc_id string, final_page_idx int, annotator_note string",
    "train_pairs": "sample_id string, query_id string, query_en string, query_zh string, query_type string, pos_doc_id string, pos_page_idx int, pos_image_path string, neg_doc_id string, neg_page_idx int, neg_image_path string, neg_source string",
    "eval_details": "query_id string, query_zh string, query_en string, query_type string, gold_doc_id string, gold_page_idx int, top1_doc_id string, top1_page_idx int, top1_score double, top1_doc_hit boolean, top1_exact_hit boolean, top5_doc_hit boolean, top5_exact_hit boolean, retrieved_doc_ids string, retrieved_page_idxs string, retrieved_scores string",
}


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Cells may hold line breaks, and quotes doubled within quotes, as in the JSON lists of run details."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(SCHEMAS.get(schema, schema)).csv(path) if schema else reader.csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def require(df: DataFrame, *columns: str) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing required columns: {missing}")
    return df


def exists(spark: SparkSession, path: str) -> bool:
    """Asks the path's own file system, wherever that is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def optional(spark: SparkSession, paths: dict[str, str], schema: str | None = None) -> dict[str, DataFrame]:
    """Those of the named sources that are there; an error if none is."""
    found = {n: read_csv(spark, p, schema) for n, p in paths.items() if exists(spark, p)}
    if not found:
        raise FileNotFoundError(f"none of {sorted(paths)} exists")
    return found


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, stem, length, mtime) of non-empty files; contents aren't read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", F.col("modificationTime").alias("mtime"))
    return df.where("length > 0").withColumn("stem", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))


def restrict(df: DataFrame, order: list[str], limit: int | None = None, **equal) -> DataFrame:
    """The restrictions that scripts take as arguments: equal values or lists of them, and a limit in a stated order."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return df.orderBy(*order).limit(limit) if limit is not None else df


def confirmed(df: DataFrame, column: str = "label_status") -> DataFrame:
    """Rows that an annotator has confirmed; a blank or missing status is none."""
    return df.where(F.col(column) == "confirmed")


def asked(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(query_id, query_en) of questions typed in, blank ones left out, in their order: the source of an interactive search."""
    return spark.createDataFrame([(i, t.strip()) for i, t in enumerate(t for t in texts if t.strip())], "query_id long, query_en string")


def labelled(spark: SparkSession, said: dict[str, str]) -> DataFrame:
    """(query_id, directive) of an annotator's answers, as evaluate.apply_labels takes them."""
    return spark.createDataFrame(list(said.items()), "query_id string, directive string")


def save_model(spark: SparkSession, path: str, config: dict, weights: dict[str, bytes]) -> None:
    """A model's configuration (as JSON) and its weights by name, as one table that any executor can read."""
    rows = [("config", json.dumps(config, sort_keys=True, ensure_ascii=False), None), *[(n, None, bytearray(b)) for n, b in sorted(weights.items())]]
    spark.createDataFrame(rows, "name string, config string, weights binary").write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str, **defaults) -> tuple[dict, dict[str, bytes]]:
    """(configuration, weights) of save_model; `defaults` stand for what the configuration doesn't say."""
    rows = spark.read.parquet(path).collect()  # one row for each array of one model
    config = next(json.loads(r["config"]) for r in rows if r["config"] is not None)
    return defaults | config, {r["name"]: bytes(r["weights"]) for r in rows if r["weights"] is not None}


def fingerprint(path: Column, mtime_ns: Column, size: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("::", path, mtime_ns.cast("string"), size.cast("string")), 256), 1, 16)


def cache_valid(info: DataFrame, expected: dict) -> bool:
    """Whether a cache's one-row info has the expected values, null equal to null. No or unreadable info is no cache."""
    try:
        cond = F.lit(True)
        for k, v in expected.items():
            cond = cond & F.col(k).eqNullSafe(F.lit(v))
        return info.where(cond).limit(1).count() == 1
    except Exception as e:
        from pyspark.errors import AnalysisException

        if isinstance(e, AnalysisException):
            return False
        raise


def load_config(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))
