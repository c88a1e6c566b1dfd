"""Ordered steps over named tables: each step takes the tables so far and gives one more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Step = tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]


def run(steps: list[Step], tables: dict[str, DataFrame], keep_going: bool = False) -> tuple[dict[str, DataFrame], dict[str, Exception]]:
    """(tables, errors). A step's plan is built when its turn comes; without keep_going the first error ends the run."""
    out, errors = dict(tables), {}
    for name, step in steps:
        try:
            out[name] = step(out)
        except Exception as e:
            errors[name] = e
            if not keep_going:
                break
    return out, errors


def data_rebuild() -> list[Step]:
    """From a manifest, page texts and documents to the page index and its summary."""
    from pagewright.operators import clean

    return [
        ("page_texts_clean", lambda t: clean.clean_pages(t["page_texts"])),
        ("page_index", lambda t: clean.build_page_index(t["manifest"], t["page_texts_clean"], t["documents"])),
        ("summary", lambda t: clean.page_index_summary(t["page_index"])),
    ]


def retrieval_baseline(k: int = 5) -> list[Step]:
    """From pages (doc_id, page_idx, ocr_text_clean) and gold queries to lexical hits, details, their summary and the failures."""
    from pagewright.operators import evaluate, rank

    key = ["doc_id", "page_idx"]
    return [
        ("hits", lambda t: rank.bm25_topk(t["pages"], t["gold"], k, key, "ocr_text_clean")),
        ("details", lambda t: evaluate.evaluate(t["hits"], t["gold"])),
        ("summary", lambda t: evaluate.summarize(t["details"])),
        ("failures", lambda t: evaluate.failures(t["details"])),
    ]


PIPELINES: dict[str, Callable[[], list[Step]]] = {"data_rebuild": data_rebuild, "retrieval_baseline": retrieval_baseline}


def run_named(name: str, tables: dict[str, DataFrame], keep_going: bool = False) -> tuple[int, dict[str, DataFrame], dict[str, Exception]]:
    """(return code, tables, errors): 0 where all steps went through, else 1. An unknown name is an error that lists the known ones."""
    if name not in PIPELINES:
        raise ValueError(f"unknown pipeline {name!r}; there are {sorted(PIPELINES)}")
    out, errors = run(PIPELINES[name](), tables, keep_going)
    return int(bool(errors)), out, errors
