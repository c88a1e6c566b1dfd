"""Ranking pages for queries: lexical (BM25), dense, late interaction, two stages.

Ties: score rounded to six decimals first, then the page's keys in ascending order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Distinct terms of all queries are broadcast up to this number.
SMALL_TERMS = 200_000
#: Queries are broadcast while their vectors hold no more numbers than this (128 MB in double precision).
SMALL_NUMBERS = 1 << 24


def corpus_terms(corpus: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """((term, df), (n_pages, avgdl)) over non-empty pages, from one reading of the texts.

    A page gives its distinct terms and one row without a term, which carries its length; only sums are shuffled."""
    t = corpus.where(F.coalesce(F.length(text), F.lit(0)) > 0).select(T.tokens(F.col(text)).alias("t"))
    each = t.select(F.size("t").alias("dl"), F.explode(F.concat(F.array_distinct("t"), F.array(F.lit(None).cast("string")))).alias("term"))
    sums = each.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("dl"))
    return sums.where("term is not null").select("term", "df"), sums.where("term is null").select(F.col("df").alias("n_pages"), (F.col("dl") / F.col("df")).alias("avgdl"))


def term_counts(corpus: DataFrame, key: list[str], text: str, terms: DataFrame) -> DataFrame:
    """(key, dl, term, tf) of the given terms in non-empty pages."""
    t = corpus.where(F.coalesce(F.length(text), F.lit(0)) > 0).select(*key, T.tokens(F.col(text)).alias("t"))
    each = t.select(*key, F.size("t").alias("dl"), F.explode("t").alias("term")).join(terms, "term", "left_semi")
    return each.groupBy(*key, "dl", "term").agg(F.count("*").alias("tf"))


def term_idf(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, avgdl, idf): negative values become a share of the mean over all terms, negatives included."""
    n = F.col("n_pages")
    raw = df.crossJoin(F.broadcast(stats)).select("term", "avgdl", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("term", "avgdl", F.when(F.col("raw") < 0, F.col("mean_idf") * EPSILON).otherwise(F.col("raw")).alias("idf"))


def query_terms(queries: DataFrame, text: str) -> DataFrame:
    return queries.select("query_id", F.explode(T.tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25_scores(corpus: DataFrame, queries: DataFrame, key: list[str], text: str = "text", query_text: str = "query_en") -> DataFrame:
    """(query_id, key, score) of pages that share a term with the query. Terms of no query are dropped before the scoring join, after they have counted in the statistics."""
    idf = term_idf(*corpus_terms(corpus, text))
    asked = query_terms(queries, query_text)
    terms = asked.select("term").distinct()
    tf = term_counts(corpus, key, text, F.broadcast(terms) if terms.count() <= SMALL_TERMS else terms)
    q = asked.join(idf, "term")
    f = F.col("tf").cast("double")
    part = F.col("qtf") * F.col("idf") * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return tf.join(q, "term").groupBy("query_id", *key).agg(F.round(F.sum(part), 6).alias("score"))


def top_k(scores: DataFrame, k: int, key: list[str], per: str = "query_id") -> DataFrame:
    w = Window.partitionBy(per).orderBy(F.col("score").desc(), *[F.col(c).asc() for c in key])
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_topk(corpus: DataFrame, queries: DataFrame, k: int, key: list[str], text: str = "text", query_text: str = "query_en", backfill: bool = True) -> DataFrame:
    """(query_id, rank, key, score). backfill: where fewer than k pages match, pages without a match follow by key with score 0."""
    hits = top_k(bm25_scores(corpus, queries, key, text, query_text), k, key)
    if not backfill:
        return hits
    short = queries.select("query_id").distinct().join(hits.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("query_id")
    # Of the first 2k pages by key at most k are hits of a short query, so k others are among them.
    first = corpus.where(F.coalesce(F.length(text), F.lit(0)) > 0).select(*key).orderBy(*key).limit(2 * k)
    fill = short.crossJoin(F.broadcast(first)).join(hits.select("query_id", *key), ["query_id", *key], "left_anti").select("query_id", *key, F.lit(0.0).alias("score"))
    return top_k(hits.drop("rank").unionByName(fill), k, key)


def _stacked(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(all vectors below one another, how many each row has) of rows that are a vector or a list of vectors."""
    rows = column.tolist()
    many = [len(r) if len(r) and not np.isscalar(r[0]) else 1 for r in rows]
    flat = [v for r, n in zip(rows, many) for v in (r if len(r) and not np.isscalar(r[0]) else [r])]
    return np.array([np.asarray(v, dtype=np.float64) for v in flat]), np.array(many, dtype=np.int64)


def _best_of_batches(pages: DataFrame, asked: pd.DataFrame, k: int, key: list[str], id_type: str) -> DataFrame:
    """Of each batch of pages, the k best for each query and whatever rounding may put level with them."""
    sent = pages.sparkSession.sparkContext.broadcast((asked["query_id"].to_numpy(), *_stacked(asked["query_vector"])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q, many = sent.value
        starts = np.cumsum(many) - many
        for b in batches:
            for a in range(0, len(b), 1024):
                part = b.iloc[a : a + 1024]
                x, n = _stacked(part["embedding"])
                for lo in range(0, len(ids), 1024):
                    hi = min(lo + 1024, len(ids))
                    first, last = starts[lo], starts[hi - 1] + many[hi - 1]
                    s = np.add.reduceat(np.maximum.reduceat(x @ q[first:last].T, np.cumsum(n) - n, axis=0), starts[lo:hi] - first, axis=1)
                    least = np.partition(s, -k, axis=0)[-k] if len(s) > k else np.full(s.shape[1], -np.inf)
                    page, query = np.nonzero(s >= least - 2e-6)
                    yield part[key].iloc[page].assign(query_id=ids[lo:hi][query], score=s[page, query])[["query_id", *key, "score"]]

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.where("embedding is not null").select(*key, "embedding").mapInPandas(run, ", ".join([f"query_id {id_type}", *[f"`{c}` {kinds[c]}" for c in key], "score double"]))


def dense_topk(pages: DataFrame, queries: DataFrame, k: int, key: list[str]) -> DataFrame:
    """pages (key, embedding), queries (query_id, query_vector): the stated queries against all pages.

    Vectors that are lists of vectors are compared by late interaction: for each vector of the query the best inner
    product with one of the page's, summed. The queries are broadcast in blocks whose numbers are bounded; each batch of
    pages meets a block by one matrix product where it lies, and only its k best per query are shuffled."""
    one = F.col("query_vector")
    nested = queries.schema["query_vector"].dataType.elementType.simpleString().startswith("array")
    size = F.aggregate(one, F.lit(0), lambda n, v: n + F.size(v)) if nested else F.size(one)
    asked = queries.where("query_vector is not null").select("query_id", "query_vector")
    numbers = asked.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    id_type, blocks = queries.schema["query_id"].dataType.simpleString(), 2 * (numbers // SMALL_NUMBERS) + 1
    scored = None
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else asked
        got = block.toPandas()
        if not len(got) and i + 1 < blocks:
            continue
        best = _best_of_batches(pages, got, k, key, id_type) if len(got) else pages.select(F.lit(None).cast(id_type).alias("query_id"), *key, F.lit(0.0).alias("score")).limit(0)
        scored = best if scored is None else scored.unionAll(best)
    return top_k(scored.withColumn("score", F.round("score", 6)), k, key)


def max_sim(q: Column, d: Column) -> Column:
    """Sum over the query's vectors of the best dot product with one of the page's; for pairs that are given."""
    best = F.transform(q, lambda x: F.array_max(F.transform(d, lambda y: T.dot(x, y))))
    return F.aggregate(best, F.lit(0.0), lambda a, x: a + x)


def maxsim_topk(pages: DataFrame, queries: DataFrame, k: int, key: list[str]) -> DataFrame:
    return dense_topk(pages, queries, k, key)


def two_stage(recall: DataFrame, embeddings: DataFrame, queries: DataFrame, key: list[str], k: int = 5) -> DataFrame:
    """Recalled pages that have an embedding, ranked again by it; with the size of the pool each query had."""
    pool = recall.select("query_id", *key).join(embeddings.select(*key, "embedding"), key)
    scored = pool.join(queries.select("query_id", "query_vector"), "query_id").select("query_id", *key, F.round(T.dot(F.col("query_vector"), F.col("embedding")), 6).alias("score"))
    sized = scored.withColumn("candidate_pool_size", F.count("*").over(Window.partitionBy("query_id")))
    return top_k(sized, k, key)
