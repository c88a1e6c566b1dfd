"""Scoring, classing and selecting candidate pages."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.lexicons import UNIT, Lexicon

REFERENCE = Lexicon()


def features(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    heads = F.slice(F.filter(F.transform(T.lines(t), T.strip), lambda x: x != ""), 1, 8)
    return {
        "units": F.regexp_count(t, F.lit(rf"(?iU)\b{UNIT}\b")),
        "numbers": F.regexp_count(t, F.lit(r"(?U)\b\d+(\.\d+)?\b")),
        "bullets": F.regexp_count(t, F.lit("[•·▪◦]")),
        "titles": F.size(F.filter(heads, lambda x: F.length(x).between(6, 60) & x.rlike(r"(?U)\A[A-Z0-9\s\-&()/]+\z"))),
    }


def score(text: Column, boxes: Column, lex: Lexicon = REFERENCE) -> tuple[Column, Column]:
    """(page_score, score_reasons): eight additive features, and the names of those that counted."""
    t, n = F.coalesce(text, F.lit("")), F.length(F.coalesce(text, F.lit("")))
    f, high, low = features(text), T.found(t, lex.high), T.found(t, lex.low)
    legal, cert = T.holds(t, lex.legal), T.holds(t, (lex.certificate,)) & (n < 1200)
    least = lambda x, m, w: F.least(x, F.lit(m)).cast("double") * w
    first4 = lambda a: F.array_join(F.slice(a, 1, 4), ",")
    size = F.when(n < 50, -5.0).when(n < 120, -1.0).when(n <= 3500, 3.0).otherwise(1.0)
    total = (
        size + F.when(boxes >= 20, 3.0).when(boxes >= 8, 2.0).otherwise(0.0) + least(f["units"], 6, 0.6) + least(f["numbers"], 20, 0.08) + least(f["bullets"], 8, 0.25)
        + least(F.size(high), 8, 1.2) - least(F.size(low), 6, 1.5) + least(f["titles"], 3, 0.4) - F.when(legal, 4.0).otherwise(0.0) - F.when(cert, 2.0).otherwise(0.0)
    )
    # The names of the reasons.
    say = lambda cond, *parts: F.when(cond, F.concat(*parts))
    reasons = F.concat_ws(
        ";",
        F.when(n < 50, "too_short").when(n < 120, "short").when(n <= 3500, "good_length").otherwise("very_long"),
        F.when(boxes >= 8, "dense_boxes"), F.when(boxes >= 20, "very_dense_boxes"),
        say(f["units"] > 0, F.lit("unit_hits="), f["units"].cast("string")), say(f["numbers"] >= 5, F.lit("number_hits="), f["numbers"].cast("string")), say(f["bullets"] > 0, F.lit("bullet_hits="), f["bullets"].cast("string")),
        say(F.size(high) > 0, F.lit("high_value="), first4(high)), say(F.size(low) > 0, F.lit("low_value="), first4(low)), say(f["titles"] > 0, F.lit("upper_titles="), f["titles"].cast("string")),
        F.when(legal, "legal_page"), F.when(cert, "certificate_page"),
    )
    return F.round(total, 6), reasons


def page_type(text: Column, lex: Lexicon = REFERENCE) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.when(T.holds(t, lex.layout), "layout").when(T.holds(t, lex.fact), "fact").when(T.holds(t, lex.semantic), "semantic").when(T.holds(t, lex.navigation), "navigation").otherwise("generic")


def score_pages(pages: DataFrame, lex: Lexicon = REFERENCE) -> DataFrame:
    """pages (doc_id, page_idx, ocr_text_clean, ocr_text_clean_len, num_boxes, ...) with score, type, reasons and the legal flag."""
    t = F.col("ocr_text_clean")
    total, reasons = score(t, F.col("num_boxes"), lex)
    return pages.withColumns({"page_score": total, "page_type": page_type(t, lex), "score_reasons": reasons, "is_strong_low_value": T.holds(F.coalesce(t, F.lit("")), lex.legal)})


def settle(counts: dict, total: int, low: int, high: int) -> dict:
    """Quotas in proportion to page counts, within bounds, moved by ones until they add up or none can move."""
    pages = sum(counts.values())
    quota = {d: max(low, min(high, round(total * (n / pages)))) for d, n in counts.items()}
    while (gap := sum(quota.values()) - total) != 0:
        step, by = (-1, quota) if gap > 0 else (1, counts)
        movable = [d for d in sorted(by, key=by.get, reverse=True) if low < quota[d] or step > 0]
        movable = [d for d in movable if step < 0 or quota[d] < high][: abs(gap)]
        if not movable:
            break
        for d in movable:
            quota[d] += step
    return quota


def allocate_quotas(pages: DataFrame, total: int = 500, low: int = 25, high: int = 90) -> DataFrame:
    """(doc_id, selected_quota). The page counts of at most total / low documents can get a quota above the lower bound at
    the expense of others, yet each document gets one; the counts come to the driver, one number a document."""
    spark = pages.sparkSession
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    # Documents whose proportional quota is at the lower bound and stays there needn't come to the driver.
    n_docs, n_pages = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_docs * low >= total:  # the sum can only come down to the bound, so every quota ends there once the excess is taken off
        small = F.bround(F.lit(float(total)) * F.col("n") / F.lit(float(max(n_pages, 1))))
        above = [(r["doc_id"], r["n"]) for r in counts.where(small > low).orderBy("doc_id").collect()]  # fewer than total / low
        over = {d: min(high, round(total * n / n_pages)) for d, n in above}
        excess = sum(over.values()) + (n_docs - len(over)) * low - total
        while excess > 0 and any(q > low for q in over.values()):
            for d in sorted(over, key=over.get, reverse=True):
                if over[d] > low and excess > 0:
                    over[d], excess = over[d] - 1, excess - 1
        quota = F.create_map(*[F.lit(x) for d, q in over.items() for x in (d, q)]) if over else None
        return counts.select("doc_id", F.coalesce(quota[F.col("doc_id")] if quota is not None else F.lit(None).cast("int"), F.lit(low)).cast("int").alias("selected_quota"))
    found = {r["doc_id"]: r["n"] for r in counts.orderBy("doc_id").collect()}  # fewer than total / low documents
    return spark.createDataFrame(list(settle(found, total, low, high).items()), f"doc_id {pages.schema['doc_id'].dataType.simpleString()}, selected_quota int") if found else counts.select("doc_id", F.lit(low).alias("selected_quota"))


def best_first() -> list[Column]:
    return [F.col("page_score").desc(), F.col("ocr_text_clean_len").desc(), F.col("doc_id").asc(), F.col("page_idx").asc()]


def select_candidates(scored: DataFrame, quotas: DataFrame, total: int = 500, nav_share: float = 0.1) -> DataFrame:
    """Best pages per document under quotas with a cap on navigation pages, back-filled; then cut or filled to the total."""
    by_doc = Window.partitionBy("doc_id").orderBy(*best_first())
    sub = scored.where(~F.col("is_strong_low_value")).join(quotas, "doc_id")
    nav = F.col("page_type") == "navigation"
    sub = sub.withColumn("nav", nav).withColumn("in_kind", F.row_number().over(Window.partitionBy("doc_id", "nav").orderBy(*best_first())))
    cap = F.greatest(F.lit(2), F.ceil(F.col("selected_quota") * nav_share))
    sub = sub.withColumn("nav_taken", F.coalesce(F.sum((F.col("nav") & (F.col("in_kind") <= cap)).cast("int")).over(Window.partitionBy("doc_id")), F.lit(0)))
    turn = F.when(F.col("nav") & (F.col("in_kind") <= cap), 1).when(~F.col("nav") & (F.col("in_kind") <= F.greatest(F.col("selected_quota") - F.col("nav_taken"), F.lit(0))), 0).otherwise(2)
    ranked = sub.withColumn("turn", turn).withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("turn", *best_first())))
    top = ranked.where("place <= selected_quota").select(*scored.columns, "selected_quota")
    best = top.orderBy(*best_first()).limit(total)
    fill = scored.join(top.select("doc_id", "page_idx"), ["doc_id", "page_idx"], "left_anti").orderBy(*best_first()).limit(total).withColumn("selected_quota", F.lit(None).cast("int"))
    both = best.withColumn("late", F.lit(0)).unionByName(fill.select(*best.columns).withColumn("late", F.lit(1)))
    return both.orderBy("late", *best_first()).limit(total).drop("late")


def keeps(lex: Lexicon = REFERENCE, nav_score: float = 10) -> Column:
    t, n = F.coalesce("ocr_text_clean", F.lit("")), F.coalesce("ocr_text_clean_len", F.length(F.coalesce("ocr_text_clean", F.lit(""))))
    kind = F.col("page_type")
    drop = (n < 120) | T.holds(t, lex.legal) | ((kind == "navigation") & T.holds(t, lex.noisy_navigation)) | (T.holds(t, (lex.certificate,)) & (n < 1200))
    return ~drop & (kind.isin("fact", "semantic", "layout") | (kind.isin("navigation", "generic") & (F.col("page_score") >= nav_score)))


def refine_candidates(df: DataFrame, lex: Lexicon = REFERENCE) -> DataFrame:
    return df.where(keeps(lex))


def nav_cap(quota: int, share: float = 0.1) -> int:
    return max(2, math.ceil(quota * share))
