"""Queries out of candidate pages, and the rules that filter them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright import lexicons as L
from pagewright.functions import text as T

REFERENCE = L.Lexicon()


def headings(text: Column) -> Column:
    some = F.filter(F.transform(T.lines(F.coalesce(text, F.lit(""))), T.collapse), lambda x: F.length(x) >= 3)
    return F.slice(F.filter(F.slice(some, 1, 12), lambda x: F.length(x).between(4, 80)), 1, 5)


def first_unit(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?iU)\b{L.UNIT}\b", 0), F.lit(""))


def _filled(template: str, values: dict[str, Column]) -> Column:
    parts: list[Column] = []
    while "{" in template:
        head, _, rest = template.partition("{")
        parts += [F.lit(head), values[rest[0]]]
        template = rest[2:]
    return F.concat(*parts, F.lit(template))


def _family(text: Column, kind: str, lex: L.Lexicon, heading: Column) -> Column:
    """Array of (zh, en, source) of a page type's template family."""
    low = F.coalesce(text, F.lit(""))
    words = {"fact": lex.fact_keywords, "semantic": lex.semantic_keywords}.get(kind, ())
    kw = T.first_found(low, words) if words else F.lit(None).cast("string")
    zh = F.coalesce(F.create_map(*[F.lit(x) for kv in lex.keyword_zh.items() for x in kv])[kw], kw) if lex.keyword_zh else kw
    has_heading = F.coalesce(heading, F.lit("")) != ""
    values = {"k": kw, "z": zh, "n": first_unit(text), "h": F.substring(heading, 1, 40)}
    when = {
        "fact": [("fact_keyword", kw.isNotNull()), ("fact_page_lookup", kw.isNotNull()), ("fact_number_unit", values["n"].isNotNull()), ("fact_heading", has_heading)],
        "layout": [("layout_workspace", T.holds(low, lex.workspace)), ("layout_dimensions", T.holds(low, lex.dimensions)), ("layout_schematic", T.holds(low, lex.schematic)), ("layout_7dof", T.holds(low, lex.seven_dof)), ("layout_heading", has_heading)],
        "semantic": [("semantic_keyword", kw.isNotNull()), ("semantic_topic", kw.isNotNull()), ("semantic_heading", has_heading)],
        "navigation": [("navigation_emstop", T.holds(low, lex.emergency)), ("navigation_contents", T.holds(low, lex.contents)), ("navigation_heading", has_heading)],
        "generic": [("generic_heading", has_heading), ("generic_topic", F.lit(True))],
    }[kind]
    made = lambda s: F.struct(T.collapse(_filled(L.TEMPLATES[s][0], values)).alias("zh"), T.collapse(_filled(L.TEMPLATES[s][1], values)).alias("en"), F.lit(s).alias("source"))
    some = F.filter(F.array(*[F.when(c, made(s)) for s, c in when]), lambda x: x.isNotNull())
    if kind != "generic":
        some = F.when(F.size(some) == 0, F.array(made(f"{kind}_fallback"), made(f"{kind}_fallback2"))).otherwise(some)
    return F.slice(some, 1, 3 if kind in ("fact", "layout") else 2)


def sums_before(df: DataFrame, key: str, value: str, parts: int = 256) -> DataFrame:
    """(key, before): the sum of the values of all smaller keys; df has one row a key. Ranges of keys are summed by themselves, between some `parts` keys that a hash picks."""
    n = df.count()
    splits = sorted(r[0] for r in df.where(F.pmod(F.xxhash64(key), F.lit(max(1, n // parts))) == 0).select(key).limit(8 * parts).collect() if r[0] is not None)
    ranged = df.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, splits)), lambda s: s <= F.col(key))) if splits else F.lit(0))
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))  # a row a range
    heads = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_head"))
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy(key)) - F.col(value)
    return ranged.withColumn("_inside", inside).join(F.broadcast(heads), "_range").select(key, (F.col("_head") + F.col("_inside")).alias("before"))


def generate_queries(pages: DataFrame, lex: L.Lexicon = REFERENCE) -> DataFrame:
    """One row per query, numbered over pages in order before repeats go. The running number is a prefix sum of per-document counts."""
    t = F.col("ocr_text_clean")
    with_heading = pages.withColumn("anchor_heading", F.coalesce(F.get(headings(t), F.lit(0)), F.lit("")))
    kind, h = F.col("page_type"), F.col("anchor_heading")
    made = F.when(kind == "fact", _family(t, "fact", lex, h))
    for k in ("layout", "semantic", "navigation"):
        made = made.when(kind == k, _family(t, k, lex, h))
    made = made.otherwise(_family(t, "generic", lex, h))
    rows = with_heading.withColumn("made", made).withColumn("n", F.size("made"))
    per_doc = rows.groupBy("doc_id").agg(F.sum("n").alias("doc_n"))
    offset = sums_before(per_doc, "doc_id", "doc_n")
    in_doc = F.sum("n").over(Window.partitionBy("doc_id").orderBy("page_idx")) - F.col("n")
    numbered = rows.withColumn("in_doc", in_doc).join(offset, "doc_id")
    each = numbered.select("*", F.posexplode("made").alias("ord", "q"))
    out = each.select(
        F.format_string("auto_%05d", (F.col("before") + F.col("in_doc") + F.col("ord") + 1).cast("long")).alias("query_id"), "doc_id", "page_idx", "page_type", F.col("q.zh").alias("query_zh"), F.col("q.en").alias("query_en"),
        F.col("q.source").alias("query_source"), "anchor_heading", "ocr_text_clean_len", "page_score", "ord",
    )
    once = Window.partitionBy("doc_id", "page_idx", "query_zh", "query_en").orderBy("ord")
    return out.withColumn("nth", F.row_number().over(once)).where("nth = 1").drop("nth", "ord")


def keeps_query() -> Column:
    clean = lambda c: F.lower(T.strip(F.coalesce(c, F.lit(""))))
    zh, en, source, heading, kind = (clean(c) for c in ("query_zh", "query_en", "query_source", "anchor_heading", "page_type"))
    return ~(
        (T.holds(heading, L.BAD_HEADINGS) & source.isin("layout_heading", "fact_heading", "generic_heading")) | source.isin("generic_topic", "generic_heading")
        | T.holds(zh, L.BROAD_ZH) | T.holds(en, L.BROAD_EN) | ((kind == "navigation") & ~source.isin("navigation_emstop", "navigation_heading"))
        | (source.isin("semantic_keyword", "semantic_topic") & T.holds(heading, L.WEAK_HEADINGS))
    )


def filter_queries(df: DataFrame, per_page: int = 3) -> DataFrame:
    rank_of = F.create_map(*[F.lit(x) for kv in L.PRIORITY.items() for x in kv])
    kept = df.where(keeps_query()).withColumn("source_priority", F.coalesce(rank_of[F.col("query_source")], F.lit(99)))
    w = Window.partitionBy("doc_id", "page_idx").orderBy("source_priority", F.col("page_score").desc(), F.col("ocr_text_clean_len").desc(), "query_id")
    return kept.withColumn("rank_in_page", F.row_number().over(w)).where(F.col("rank_in_page") <= per_page)


def retrieval_filter(queries: DataFrame, hits: DataFrame, page_top: int = 20, doc_top: int = 5) -> DataFrame:
    """Queries (query_id, doc_id, page_idx) whose page is among the first page_top hits or whose document is among those of the first doc_top."""
    gold = queries.select("query_id", F.col("doc_id").alias("g_doc"), F.col("page_idx").alias("g_page"))
    near = hits.join(gold, "query_id").groupBy("query_id").agg(F.bool_or((F.col("doc_id") == F.col("g_doc")) & (((F.col("page_idx") == F.col("g_page")) & (F.col("rank") <= page_top)) | (F.col("rank") <= doc_top))).alias("ok"))
    return queries.join(near.where("ok"), "query_id", "left_semi")
