"""Operator 5: SimHash near-duplicates by pigeonhole blocks.

A fingerprint's 64 bits are cut into k blocks; two fingerprints that differ in at most d bits agree in at least k - d
of them, so each fingerprint is keyed by every choice of k - d blocks and only fingerprints with an equal key are
compared, by their whole Hamming distance. k grows with the number of distinct fingerprints, so that a key is rarely
shared by chance. Equal fingerprints are one row from the start. A key shared by very many fingerprints is dealt out
in pairs of blocks of bounded size; a block emits a spanning forest of its links, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import bounded_batches, cut, grouped, partitions, spread_join
from pagewright.llm.components import components, forest

SHINGLE_WORDS, MAX_BITS, SEED = 4, 4, 42
#: Fingerprints of one key that a task compares with as many others at most.
BLOCK = 4096


def fingerprint(text: str | None, words_each: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash over word shingles; 0 for no words. Only A-Z are lower-cased; words end at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= words_each:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[: 1 - words_each].tolist(), ends[words_each - 1 :].tolist())], dtype=np.uint64)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp) with the fingerprint as a signed long. Null texts count as empty."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_column).alias("id"), fingerprint_udf()(F.col(text_column)).alias("fp"))


def fingerprint_udf():
    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t if isinstance(t, str) else None) for t in batch], dtype=np.uint64).view(np.int64))

    return fp


def block_count(n: int, max_bits: int = MAX_BITS) -> int:
    """The fewest blocks for which a key has at least as many values as there are fingerprints."""
    for k in range(max_bits + 2, 3 * max_bits + 1):
        if 64 * (k - max_bits) // k >= np.log2(max(n, 2)):
            return k
    return 3 * max_bits


def keys(fp, n: int, max_bits: int = MAX_BITS):
    """Array of (choice, key) structs of a fingerprint column."""
    k = block_count(n, max_bits)
    edges = [64 * i // k for i in range(k + 1)]
    out = []
    for c, chosen in enumerate(combinations(range(k), k - max_bits)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        mask -= (mask >> 63) << 64
        out.append(F.struct(F.lit(c).alias("choice"), fp.bitwiseAND(F.lit(mask)).alias("key")))
    return F.array(*out)


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Spanning links (a, b) of distinct fingerprints (column fp) that differ in at most max_bits bits: same components as all links."""
    n = fps.count()
    keyed = fps.select("fp", F.explode(keys(F.col("fp"), n, max_bits)).alias("k")).select("fp", "k.choice", "k.key")
    shared = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
    dealt = (
        keyed.join(shared, ["choice", "key"])
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("choice", "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp")
    )
    by = ["choice", "key", "lo", "hi"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out_a, out_b = [], []
        for g in grouped(batches, by):
            fp = np.sort(g["fp"].to_numpy())
            if len(fp) < 2:
                continue
            x = fp.view(np.uint64)
            left, right = [], []
            for s in range(0, len(x), 1024):  # a table of distances stays under 8 MB
                i, j = np.nonzero(np.bitwise_count(x[s : s + 1024, None] ^ x[None, :]) <= max_bits)
                i += s
                left += i[i < j].tolist()
                right += j[i < j].tolist()
            root = forest(len(fp), left, right)
            child = [i for i, r in enumerate(root) if r != i]
            out_a += fp[child].tolist()
            out_b += fp[[root[i] for i in child]].tolist()
            if len(out_a) > 50_000:
                yield pd.DataFrame({"a": out_a, "b": out_b}, dtype=np.int64)
                out_a, out_b = [], []
        yield pd.DataFrame({"a": out_a, "b": out_b}, dtype=np.int64)

    spread = dealt.repartition(partitions(fps.sparkSession), *by).sortWithinPartitions(*by)
    return spread.mapInPandas(run, "a long, b long")


def simhash_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: id, fp (signed long), component_id: the smallest id reachable by links of fingerprints.

    Null and empty texts have fingerprint 0 and link like any other; repeated ids and rows come out once each. Rows
    without an id link too; a group of which no row has an id has a null component_id. Other columns aren't read."""
    rows = cut(fingerprints(docs, id_column, text_column))
    first = cut(rows.groupBy("fp").agg(F.min("id").alias("id")))
    of = cut(with_roots(first, max_bits))
    least = of.groupBy("root").agg(F.min("id").alias("component_id"))
    group = cut(spread_join(of.select("fp", "root"), least, ["root"]).select("fp", "component_id"))
    return spread_join(rows, group, ["fp"]).select(F.col("id").alias(id_column), "fp", "component_id")


def with_roots(first: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """A table of distinct fingerprints (column fp) with root, the smallest fingerprint of each one's component."""
    roots = components(links(first.select("fp"), max_bits))
    return first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def group_representatives(docs: DataFrame, columns: list[str], id_column: str = "doc_id", text_column: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The given columns of one row of docs for each group of fingerprints.

    It is the row with the smallest id; rows without an id come after all others. Rows of one id that differ in other
    columns are told apart by a 128-bit hash of all given columns, and rows that are equal in all of them are one. Only
    hashes, ids and fingerprints go through the grouping; texts are shuffled once, to meet the rows that stay."""
    content = [F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns]), *columns]
    keyed = docs.select(*columns, F.xxhash64(F.lit(1), *content).alias("_k1"), F.xxhash64(F.lit(2), *content).alias("_k2"))
    bounded_batches(docs.sparkSession)
    fp = fingerprint_udf()
    rows = cut(keyed.select(F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), "_k1", "_k2").alias("row"), fp(F.col(text_column)).alias("fp")))
    first = cut(rows.groupBy("fp").agg(F.min("row").alias("row")))
    kept = with_roots(first, max_bits).groupBy("root").agg(F.min("row").alias("row")).select("row._k1", "row._k2")
    found = keyed.join(kept, ["_k1", "_k2"], "left_semi")
    once = Window.partitionBy("_k1", "_k2").orderBy(F.lit(1))  # as the join has dealt them
    return found.withColumn("_nth", F.row_number().over(once)).where("_nth = 1").select(*columns)
