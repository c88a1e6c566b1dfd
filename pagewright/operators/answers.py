"""Answer texts: extraction, quality, confidence, choice between strategies, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright import lexicons as L
from pagewright.functions import text as T

NUMBER = r"[0-9]+(?:\.[0-9]+)?"


def _within(c: Column, pattern: str) -> Column:
    """The first group of the pattern, trimmed, where it matches; else the text."""
    return F.when(F.coalesce(c.rlike(pattern), F.lit(False)), T.strip(F.regexp_extract(c, pattern, 1))).otherwise(c)


def extract(c: Column) -> Column:
    t = T.once(T.strip(F.coalesce(c, F.lit(""))), lambda t: _within(t, r"(?is)<one concise answer>\s*(.*?)\s*(?:</one(?:\s+concise\s+answer)?>|<confidence>|\z)"))
    t = T.once(t, lambda t: _within(t, r"(?is)answer\s*:\s*(.*?)(?:\n\s*confidence\s*:|\z)"))
    for p in (r"(?is)</?one\s+concise\s+answer>", r"(?is)</?confidence>", r"(?im)^answer\s*:\s*", rf"(?im)^confidence\s*:\s*{NUMBER}\s*$", rf"(?im)^{NUMBER}\s*$"):
        t = F.regexp_replace(t, p, "")
    some = F.filter(F.transform(T.lines(t), T.strip), lambda x: (x != "") & ~x.rlike(rf"(?i)\Aconfidence\s*:?\s*{NUMBER}\z"))
    return T.strip(F.array_join(T.once(some, _first_of_each), "\n"))


def _first_of_each(some: Column) -> Column:
    """The lines without those that came before in whatever case. Sorting finds them, in other than quadratic time."""
    by_text = F.array_sort(F.transform(some, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x"))))
    first = lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["low"] != x["low"]))
    kept = F.array_sort(F.transform(T.once(by_text, first), lambda x: F.struct(x["i"].alias("i"), x["x"].alias("x"))))
    return F.when(F.size(F.array_distinct(F.transform(some, F.lower))) == F.size(some), some).otherwise(F.transform(kept, lambda x: x["x"]))


def without_confidence(c: Column) -> Column:
    some = F.filter(T.lines(T.strip(F.coalesce(c, F.lit("")))), lambda x: ~T.strip(x).rlike(rf"(?i)\Aconfidence\s*:\s*{NUMBER}\z") & (T.strip(x) != ""))
    return T.strip(F.array_join(some, "\n"))


def quality(answer: Column, question: Column) -> Column:
    plus = lambda cond, w: F.when(cond, w).otherwise(0.0)

    def total(a: Column, low: Column) -> Column:
        return (
            plus(F.length(a) > 0, 0.25) + plus(F.length(a) >= 20, 0.2) + plus(F.length(a) >= 60, 0.15) + plus(~low.isin("yes", "no", "unknown"), 0.1)
            + plus(~T.strip(F.coalesce(answer, F.lit(""))).rlike(rf"(?i)\Aconfidence\s*:\s*{NUMBER}\z"), 0.2)
            + plus(~(low.contains("<one concise answer>") | low.contains("<confidence>")), 0.05)
            + plus(~(low.contains("cannot confidently answer") | low.contains("answer is uncertain")), 0.05)
            + plus(T.holds(F.coalesce(question, F.lit("")), L.FACT_HINTS) & a.rlike(r"(?U)\d"), 0.1) - plus(T.holds(low, L.BAD_ANSWERS), 0.4)
        )

    each = T.once(extract(without_confidence(answer)), lambda a: T.once(F.lower(a), lambda low: total(a, low)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), each))


def blend(conf: Column, retrieval: Column, quality_score: Column) -> Column:
    return 0.45 * conf + 0.25 * F.greatest(retrieval, F.lit(0.0)) + 0.30 * quality_score


def select_answer(df: DataFrame, known: dict[str, Column] | None = None) -> DataFrame:
    """df (query_id, question, single, stitched, per_page, per_page_blend, joint): the strategy with the highest score, the first of equals.

    known: the quality of answers for which df has it already."""
    q = lambda c: known[c] if known and c in known else quality(F.col(c), F.col("question"))
    options = [
        ("single_page", "single", 0.30 + 0.70 * q("single")), ("stitched", "stitched", 0.35 + 0.70 * q("stitched")),
        ("per_page_weighted", "per_page", 0.10 + 0.60 * F.col("per_page_blend") + 0.30 * q("per_page")), ("multi_image_joint", "joint", 0.35 + 0.75 * q("joint")),
    ]
    each = F.array(*[F.struct(F.round(s, 6).alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("strategy"), F.col(c).alias("answer")) for i, (n, c, s) in enumerate(options)])
    best = F.array_max(F.transform(each, lambda x: F.struct(x["s"].alias("s"), x["o"].alias("o"), x["strategy"].alias("strategy"), F.coalesce(x["answer"], F.lit("")).alias("answer"))))
    return df.withColumn("_best", best).select("query_id", F.col("_best.strategy").alias("selected_strategy"), F.col("_best.answer").alias("selected_answer"), F.col("_best.s").alias("selection_score"))


def stitched_size(pages: DataFrame, by: str = "doc_id") -> DataFrame:
    """pages (by, width, height): size of the picture that shows all of one `by` side by side, each widened to the greatest height."""
    tallest = pages.groupBy(by).agg(F.max("height").alias("height"))
    scaled = F.when(F.col("height") == F.col("tall"), F.col("width")).otherwise(F.floor(F.col("width") * (F.col("tall") / F.col("height"))))
    rows = pages.join(tallest.withColumnRenamed("height", "tall"), by)
    return rows.groupBy(by, F.col("tall").alias("height")).agg(F.sum(scaled).alias("width")).select(by, "width", "height")


def prompt(question: Column, mode: str) -> Column:
    return F.concat(F.lit(f"{L.PROMPT_BASE}\n{L.PROMPT_MODES[mode]}Question: "), F.coalesce(question, F.lit("")))
