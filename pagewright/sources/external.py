"""Where models and renderers plug in. Each takes a callable factory, called once per partition, so that a model is loaded once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators.clean import flatten_ocr

MANIFEST = "page_id string, doc_id string, pdf_name string, pdf_path string, page_idx int, image_name string, image_path string, image_rel_path string, dpi int, error string"


def render_pages(pdfs: DataFrame, renderer: Callable[[], Callable[[str, int], Iterator[str]]], dpi: int = 160) -> DataFrame:
    """pdfs (path, stem) -> one row per page; a document that fails gives one row with the error. renderer()(path, dpi) yields image paths."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = renderer()
        for b in batches:
            rows = []
            for path, doc in zip(b["path"], b["stem"]):
                try:
                    for i, image in enumerate(render(path, dpi)):
                        name = f"page_{i:04d}.png"
                        rows.append((f"{doc}:{i:04d}", doc, path.rsplit("/", 1)[-1], path, i, name, image, f"{doc}/{name}", dpi, None))
                except Exception as e:  # a broken file is a row, not a failed job
                    rows.append((None, doc, path.rsplit("/", 1)[-1], path, None, None, None, None, dpi, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MANIFEST.split(", ")])

    return pdfs.select("path", "stem").mapInPandas(run, MANIFEST)


def run_ocr(manifest: DataFrame, recogniser: Callable[[], Callable[[str], str]]) -> DataFrame:
    """manifest (page_id, doc_id, page_idx, image_path) -> page texts. recogniser()(image_path) gives the result as JSON; failures give empty text and the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = recogniser()
        for b in batches:
            out, errors = [], []
            for p in b["image_path"]:
                try:
                    out.append(read(p))
                    errors.append("")
                except Exception as e:
                    out.append("{}")
                    errors.append(str(e))
            yield b.assign(ocr_json=out, error=errors)

    raw = manifest.select("page_id", "doc_id", "page_idx", "image_path").mapInPandas(run, "page_id string, doc_id string, page_idx int, image_path string, ocr_json string, error string")
    return raw.withColumn("r", flatten_ocr(F.col("ocr_json"))).select("page_id", "doc_id", "page_idx", "image_path", "r.num_boxes", "r.avg_score", "r.ocr_text", "error", "ocr_json")


def write_ocr_json(pages: DataFrame, path: str) -> None:
    """Raw OCR results (doc_id, page_idx, ocr_json) as text files, one folder a document; rows in page order within a file."""
    out = pages.select("doc_id", "page_idx", "ocr_json").repartition("doc_id").sortWithinPartitions("doc_id", "page_idx")
    out.select("doc_id", F.col("ocr_json").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def load_images(spark: SparkSession, folder: str, decoder: Callable[[], Callable[[bytes], bytes]], pattern: str = "*.png") -> DataFrame:
    """(path, image): files of a folder, each through decoder()(content), for example to raw RGB."""

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decode = decoder()
        for b in batches:
            yield b.map(decode)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).where("length > 0")
    return files.select("path", decoded("content").alias("image"))


def stitch(groups: DataFrame, stitcher: Callable[[], Callable[[list[str], str], str]], folder: str) -> DataFrame:
    """groups (query_id, image_paths) with stitched_path: what stitcher()(paths, target) gives, one picture a query; null where there are no pages."""

    @F.pandas_udf("string")
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        join = stitcher()
        for ids, paths in batches:
            yield pd.Series([join(list(p), f"{folder}/{i}.png") if p is not None and len(p) else None for i, p in zip(ids, paths)], dtype=object)

    return groups.withColumn("stitched_path", made(F.col("query_id").cast("string"), "image_paths"))


def generate(asked: DataFrame, generator: Callable[[], Callable[[list[str], str], str]], images: str = "image_paths", prompt: str = "prompt", out: str = "raw_answer") -> DataFrame:
    """asked with what generator()(image paths, prompt) answers, trimmed. The model is loaded once per partition; a call that fails gives null and the error in `error`."""

    @F.pandas_udf("answer string, error string")
    def answers(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = generator()
        for paths, prompts in batches:
            rows = []
            for p, q in zip(paths, prompts):
                try:
                    rows.append((model(list(p) if p is not None else [], q).strip(), None))
                except Exception as e:  # one page that can't be read mustn't end the job
                    rows.append((None, str(e)))
            yield pd.DataFrame(rows, columns=["answer", "error"])

    return asked.withColumn("_r", answers(images, prompt)).withColumns({out: F.col("_r.answer"), "error": F.col("_r.error")}).drop("_r")


def encode(df: DataFrame, encoder: Callable[[], Callable[[list[str]], list]], column: str, out: str = "embedding", batch: int = 16) -> DataFrame:
    """df with the L2-normalised vectors that encoder()(inputs) gives for a column, `batch` inputs at a time."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for b in batches:
            got: list = []
            for i in range(0, len(b), batch):
                got += list(model(b.iloc[i : i + batch].tolist()))
            yield pd.Series([list(map(float, v)) for v in got])

    return df.withColumn(out, vectors(F.col(column))).withColumn(out, T.normalised(F.col(out)))
