"""Page rules on streams. Scoring and typing are stateless and run unchanged; corpus statistics are recomputed per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from pagewright.lexicons import Lexicon
from pagewright.operators.candidates import score_pages
from pagewright.operators.clean import clean_pages


def score_stream(pages: DataFrame, lex: Lexicon | None = None) -> DataFrame:
    """pages: a streaming frame with ocr_text_clean, ocr_text_clean_len and num_boxes."""
    return score_pages(pages, lex or Lexicon())


def clean_stream(pages: DataFrame, sink: Callable[[DataFrame, int], None], **limits) -> DataStreamWriter:
    """Cleaning needs the line frequencies of whole documents: each micro-batch must hold whole documents, and is cleaned by itself."""
    return pages.writeStream.foreachBatch(lambda batch, epoch: sink(clean_pages(batch, **limits), epoch))
