"""Operator 7: mixing sources to target weights by iterative proportional fitting. DataFrame functions only.

Token counts of (source, language, topic) cells are raked: the weights of the cells are scaled, one margin after the
other, until each margin has its target share. Documents are then sampled with probabilities in proportion to their
cell's weight, by a hash of their id, so that the same documents come out whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import cut

ROUNDS = 5
FRACTION = 0.5
#: Cells are broadcast up to this number (about 10 MB), and joined by a shuffle beyond it.
BROADCAST_CELLS = 50_000
MARGINS = ("source", "lang", "topic")
#: Share of a margin's value in proportion to its tokens to this power, where no targets are given.
TEMPER = 0.5
WORD = r"[^\x09-\x0D\x20]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: str = "text") -> Column:
    """What a text is made of, by marks in it; stands for a topic where there is no column for it."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.when(t.contains(" | "), "table").when(t.contains("***") | t.contains("%%%"), "symbols").when(F.lower(t).contains("license"), "license").otherwise("prose")


def margin_targets(cells: DataFrame, margin: str, temper: float = TEMPER) -> DataFrame:
    """(margin, share): tempered shares of tokens."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("t"))
    raised = sums.select(margin, F.pow(F.col("t").cast("double"), F.lit(temper)).alias("p"))
    total = raised.agg(F.sum("p").alias("all"))
    return raised.crossJoin(F.broadcast(total)).select(margin, (F.col("p") / F.col("all")).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """cells (margins, tokens) with `weight`: after raking, each margin's weighted tokens have the target shares of all tokens.

    A value of a margin without a target keeps no weight; a target without tokens has no effect. Cells without tokens keep weight 1."""
    total = cells.agg(F.sum("tokens").cast("double").alias("total"))  # one row
    w = cells.crossJoin(F.broadcast(total)).withColumn("weight", F.lit(1.0))
    for m in MARGINS:
        shares = (targets or {}).get(m)
        if shares is None:
            shares = margin_targets(cells, m)
        w = w.join(shares.select(m, F.col("share").alias(f"share_{m}")), m, "left").fillna(0.0, [f"share_{m}"])
    for _ in range(rounds):
        for m in MARGINS:
            held = F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy(m))
            w = w.withColumn("weight", F.when(held > 0, F.col("weight") * F.col(f"share_{m}") * F.col("total") / held).otherwise(F.col("weight")))
    return w.select(*MARGINS, "tokens", "weight")


def draw(id_column: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and seed alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_column).cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def misses(cells: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(margin, value, target, share): what share of the raked weight each value of a margin gets. A target that no cells can meet shows here."""
    w = rake(cells, targets, rounds)
    out = None
    for m in MARGINS:
        shares = ((targets or {}).get(m) if (targets or {}).get(m) is not None else margin_targets(cells, m)).select(F.col(m).alias("value"), F.col("share").alias("target"))
        got = w.groupBy(F.col(m).alias("value")).agg(F.sum(F.col("tokens") * F.col("weight")).alias("held"))
        total = got.agg(F.sum("held").alias("all"))
        part = got.crossJoin(F.broadcast(total)).join(shares, "value", "full").select(F.lit(m).alias("margin"), "value", "target", F.coalesce(F.col("held") / F.col("all"), F.lit(0.0)).alias("share"))
        out = part if out is None else out.unionAll(part)
    return out


def mix(docs: DataFrame, topic: Column | None = None, targets: dict[str, DataFrame] | None = None, fraction: float = FRACTION, seed: int = 7, id_column: str = "doc_id", text_column: str = "text", tokens: Column | None = None) -> DataFrame:
    """docs with mix_tokens (`tokens`, for instance counted by operator 9, or else words), mix_weight, mix_probability (fraction x weight, 1 at most), mix_sampled and mix_copies.

    mix_due is fraction x weight, how often a row is drawn on average, and mix_copies how often it is drawn, that number
    rounded up or down by a hash of the id. Cells whose probability is cut off at 1 are repeated, so the copies have the
    raked margins, while rows that are sampled once at most can't reach them. mix_copies is 0 where mix_sampled is false,
    and 1 at most for a row without tokens.

    A null source, language or topic is a value of its own, shown as ''. Null and empty texts have no tokens; they are
    sampled like others. Rows of one id are sampled alike. Columns of these names, and of the margins' helper names
    mix_source, mix_lang and mix_topic, are replaced."""
    named = {m: F.coalesce(c.cast("string"), F.lit("")) for m, c in zip(MARGINS, (F.col("source"), F.col("lang"), topic if topic is not None else topic_of(text_column)))}
    rows = docs.withColumns({"mix_tokens": F.coalesce(tokens.cast("long"), F.lit(0)) if tokens is not None else word_count(text_column), **{f"mix_{m}": c for m, c in named.items()}})
    cells = rows.groupBy(*[F.col(f"mix_{m}").alias(m) for m in MARGINS]).agg(F.sum("mix_tokens").alias("tokens"))
    cells = cut(cells)
    weights = rake(cells, targets).select(*[F.col(m).alias(f"mix_{m}") for m in MARGINS], F.col("weight").alias("mix_weight"))
    if cells.count() <= BROADCAST_CELLS:
        weights = F.broadcast(weights)
    joined = rows.join(weights, [f"mix_{m}" for m in MARGINS], "left")
    p = F.least(F.lit(1.0), F.lit(float(fraction)) * F.col("mix_weight"))
    due = F.lit(float(fraction)) * F.col("mix_weight")
    copies = F.when(F.col("mix_tokens") > 0, F.floor(due) + (draw(id_column, seed) < due - F.floor(due)).cast("long")).otherwise(F.col("mix_sampled").cast("long"))
    return joined.withColumn("mix_due", due).withColumn("mix_probability", p).withColumn("mix_sampled", draw(id_column, seed) < F.col("mix_probability")).withColumn("mix_copies", copies)


def oracle(rounds: int = ROUNDS, fraction: float = FRACTION, seed: int = 7) -> str:
    """The same in DuckDB's SQL."""
    steps, last = [], "w0"
    for r in range(rounds):
        for m in MARGINS:
            name = f"w{r}_{m}"
            steps.append(f"{name} AS (SELECT source, lang, topic, tokens, total, share_source, share_lang, share_topic, CASE WHEN sum(tokens * weight) OVER (PARTITION BY {m}) > 0 THEN weight * share_{m} * total / sum(tokens * weight) OVER (PARTITION BY {m}) ELSE weight END AS weight FROM {last})")
            last = name
    shares = ", ".join(f"s_{m} AS (SELECT {m}, pow(sum(tokens)::DOUBLE, {TEMPER}) / sum(pow(sum(tokens)::DOUBLE, {TEMPER})) OVER () AS share FROM cells GROUP BY {m})" for m in MARGINS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), '***') OR contains(coalesce(text, ''), '%%%') THEN 'symbols' WHEN contains(lower(coalesce(text, '')), 'license') THEN 'license' ELSE 'prose' END AS topic,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x20]+'))::BIGINT AS tokens FROM documents),
cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL), {shares},
w0 AS (SELECT c.*, (SELECT sum(tokens) FROM cells) AS total, s.share AS share_source, l.share AS share_lang, t.share AS share_topic, 1.0::DOUBLE AS weight
    FROM cells c JOIN s_source s USING (source) JOIN s_lang l USING (lang) JOIN s_topic t USING (topic)), {', '.join(steps)}
SELECT doc_id, source, lang, topic, d.tokens AS n_tokens, round(weight, 6) AS weight, round(least(1.0, {fraction} * weight), 6) AS probability, drawn < least(1.0, {fraction} * weight) AS sampled,
    round({fraction} * weight, 6) AS due, CASE WHEN d.tokens > 0 THEN floor({fraction} * weight)::BIGINT + (drawn < {fraction} * weight - floor({fraction} * weight))::BIGINT ELSE (drawn < least(1.0, {fraction} * weight))::BIGINT END AS copies
FROM (SELECT *, ('0x' || substr(md5('{seed}:' || doc_id), 1, 12))::BIGINT / {1 << 48}.0::DOUBLE AS drawn FROM d) d JOIN {last} USING (source, lang, topic)"""
