"""Operator 10: removal of repeated word passages by suffix automata of reference shards.

Two documents are only ever compared where they may agree. Every window of 20 words has an anchor, the least hash among
its grams of 8 words; windows with one anchor in a row form a run, and runs are dealt out by anchor. A run whose anchor
occurs nowhere else holds no repeat. Runs with equal anchor and equal words repeat as a whole. Where one anchor has
runs of different words, the words themselves decide: the earlier runs are the reference shard, held in a suffix
automaton, and each later run is streamed through it; the matching statistics tell which of its windows it holds.
Broadcasting each shard to all documents instead, as the plain form of the method has it, would read the corpus once
for each shard. Anchors with so many different runs that one shard can't hold them are settled window by window.

Anchors that a sample of the documents shows to be very common are dealt out in parts: equal runs are settled within
each part, and of each part only the first of a kind meets the other parts'. The result is the same without the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.automaton import SuffixAutomaton
from pagewright.llm.common import bounded_batches, buffered, cut, grouped, partitions, spread_join

WINDOW, GRAM = 20, 8
#: Runs of one anchor that one automaton holds at most (about 26 words each).
SHARD_RUNS = 2000
CACHE_WORDS = 500_000
#: Parts of a very common anchor, such anchors at most, and one in how many documents is looked at to find them.
PARTS, COMMON_ANCHORS, SAMPLED = 64, 1000, 64
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so each has an inverse modulo 2 ** 64
_NO_ID = -(1 << 63)


class WordHashes:
    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def words_of(text) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []


class _Ranges:
    """Hashes of any ranges of a sequence, equal wherever equal words stand."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(n, base, dtype=np.uint64))), dtype=np.uint64)
            self.back = np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64))), dtype=np.uint64)
            self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values * power[:-1], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * self.back[start]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        return x ^ (x >> np.uint64(29))


def runs(hashes: np.ndarray, owner: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (anchor hash, content hash, first window, windows). owner: the document of each word; documents lie one after another."""
    n, wide = len(hashes), window - gram + 1
    count = n - window + 1
    if count <= 0:
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    first = _Ranges(hashes, _B1)
    at = np.arange(n - gram + 1)
    value = _mixed(first.of(at, at + gram))
    least, span = value, 1
    while span < wide:  # sliding minimum by doubling
        step = min(span, wide - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    least = least[:count]
    place = np.zeros(count, dtype=np.int64)
    for k in range(wide - 1, -1, -1):
        np.copyto(place, np.arange(k, k + count), where=value[k : k + count] == least)
    whole = owner[:count] == owner[window - 1 :]
    new = np.ones(count, dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | ~whole[:-1]
    start = np.flatnonzero(new & whole)
    bounds = np.append(np.flatnonzero(new | ~whole), count)
    windows = bounds[np.searchsorted(bounds, start, side="right")] - start
    content = _mixed(_Ranges(_mixed(hashes), _B2).of(start, start + windows + window - 1))
    return least[start], content, start, windows


def _runs_of(docs: DataFrame) -> DataFrame:
    """(anchor, content, doc, copy, start, windows, gone). gone: an equal run lies earlier in the same batch, so this one repeats for certain; it gets a scattered anchor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = WordHashes()
        for b in buffered(batches):
            words = [words_of(t) for t in b["text"]]
            size = np.array([len(w) for w in words], dtype=np.int64)
            owner = np.repeat(np.arange(len(b)), size)
            flat = hashed([w for ws in words for w in ws])
            anchor, content, start, windows = runs(flat, owner)
            row = owner[start]
            offset = np.concatenate(([0], np.cumsum(size)))[row]
            out = pd.DataFrame({
                "anchor": anchor.view(np.int64), "content": content.view(np.int64), "doc": b["doc"].to_numpy()[row], "copy": b["copy"].to_numpy()[row],
                "start": (start - offset).astype(np.int32), "windows": windows.astype(np.int32),
            })
            order = np.lexsort((out["start"], out["copy"], out["doc"], out["content"], out["anchor"]))
            out = out.iloc[order].reset_index(drop=True)
            gone = np.zeros(len(out), dtype=bool)
            gone[1:] = (out["anchor"].to_numpy()[1:] == out["anchor"].to_numpy()[:-1]) & (out["content"].to_numpy()[1:] == out["content"].to_numpy()[:-1])
            scattered = _mixed((out["doc"].to_numpy() * 1_000_003 + out["start"].to_numpy()).astype(np.uint64)).view(np.int64)
            out["anchor"] = np.where(gone, scattered, out["anchor"])
            out["gone"] = gone
            yield out

    return docs.mapInPandas(run, "anchor long, content long, doc long, copy int, start int, windows int, gone boolean")


def _words_at(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The word hashes of runs, out of their documents: (anchor, runs, doc, copy, start, windows, words)."""
    lists = wanted.groupBy("doc", "copy").agg(F.collect_list(F.struct("anchor", "runs", "start", "windows")).alias("at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = WordHashes()
        for b in batches:
            out = []
            for doc, copy, text, at in zip(b["doc"], b["copy"], b["text"], b["at"]):
                h = hashed(words_of(text)).view(np.int64)
                out += [(r["anchor"], r["runs"], doc, copy, r["start"], r["windows"], h[r["start"] : r["start"] + r["windows"] + WINDOW - 1]) for r in at]
            yield pd.DataFrame(out, columns=["anchor", "runs", "doc", "copy", "start", "windows", "words"])

    return docs.join(lists, ["doc", "copy"]).select("doc", "copy", "text", "at").mapInPandas(run, "anchor long, runs long, doc long, copy int, start int, windows int, words array<long>")


def _by_automaton(held: DataFrame) -> DataFrame:
    """Windows of later runs that an earlier run of the same anchor holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for g in grouped(batches, ["anchor"]):
            shard = SuffixAutomaton()
            for k, (doc, copy, start, words) in enumerate(zip(g["doc"].tolist(), g["copy"].tolist(), g["start"].tolist(), g["words"])):
                words = words.tolist()
                if k:
                    out += [(doc, copy, start + e - WINDOW + 1, 1) for e, n in enumerate(shard.matching(words)) if n >= WINDOW]
                if k < len(g) - 1:
                    shard.add(words)
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["doc", "copy", "start", "windows"])
                out = []
        yield pd.DataFrame(out, columns=["doc", "copy", "start", "windows"]).astype({"doc": "int64", "copy": "int32", "start": "int32", "windows": "int32"})

    dealt = held.repartition(partitions(held.sparkSession), "anchor").sortWithinPartitions("anchor", "doc", "copy", "start")
    return dealt.select("anchor", "doc", "copy", "start", "words").mapInPandas(run, "doc long, copy int, start int, windows int")


def _by_window(crowded: DataFrame) -> DataFrame:
    """The same for anchors with too many runs: every window by itself, the first occurrence of each stays."""
    each = crowded.select("doc", "copy", "start", "words", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("k"))
    each = each.select("doc", "copy", (F.col("start") + F.col("k")).alias("start"), F.sha2(F.concat_ws(",", F.slice("words", F.col("k") + 1, WINDOW).cast("array<string>")), 256).alias("key"))
    first = each.groupBy("key").agg(F.min(F.struct("doc", "copy", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return spread_join(each, cut(first), ["key"]).where(F.struct("doc", "copy", "start") != F.col("first")).select("doc", "copy", "start", F.lit(1).alias("windows"))


def common_anchors(docs: DataFrame) -> DataFrame:
    """(anchor, common): anchors that hold more than one in 2,000 of the runs of a sample of the documents, COMMON_ANCHORS at most."""
    some = _runs_of(docs.where(F.pmod(F.xxhash64("doc", "copy"), F.lit(SAMPLED)) == 0)).where("not gone").groupBy("anchor").agg(F.count("*").alias("common"))
    some = cut(some)
    total = some.agg(F.coalesce(F.sum("common"), F.lit(0))).first()[0]
    return cut(some.where(F.col("common") > max(total // 2000, 2)).orderBy(F.col("common").desc(), "anchor").limit(COMMON_ANCHORS))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc, copy, start, windows): ranges of window starts whose words also start earlier. docs: doc, copy, text."""
    n = partitions(docs.sparkSession)
    common = common_anchors(docs)
    part = F.when(F.col("common").isNotNull(), F.pmod(F.xxhash64("doc", "copy"), F.lit(PARTS))).otherwise(0).cast("int")
    dealt = _runs_of(docs).join(F.broadcast(common), "anchor", "left").withColumn("part", part).repartition(n, "anchor", "part")
    same = Window.partitionBy("anchor", "part", "content").orderBy("doc", "copy", "start")
    of = Window.partitionBy("anchor", "part")
    ranked = dealt.withColumn("rank", F.row_number().over(same))
    ranked = ranked.withColumn("runs", F.sum((F.col("rank") == 1).cast("long")).over(of))
    row = ["anchor", "content", "doc", "copy", "start", "windows", "common", (F.col("gone") | (F.col("rank") > 1)).alias("whole"), "runs"]
    found = cut(ranked.where("gone or rank > 1 or runs > 1 or common is not null").select(*row))
    open_ = found.where("not whole")
    # Of a common anchor each part has brought one run of a kind: PARTS of a kind at most are left.
    kind = Window.partitionBy("anchor", "content").orderBy("doc", "copy", "start")
    left = cut(open_.where("common is not null").drop("runs").withColumn("rank", F.row_number().over(kind)))
    kinds = left.where("rank = 1").groupBy("anchor").agg(F.count("*").alias("runs"))  # COMMON_ANCHORS rows at most
    left = left.join(F.broadcast(kinds), "anchor")
    repeats = found.where("whole").select("doc", "copy", "start", "windows").unionAll(left.where("rank > 1").select("doc", "copy", "start", "windows"))
    single = open_.where("common is null").drop("whole").unionByName(left.where("rank = 1 and runs > 1").drop("whole", "rank"))
    words = cut(_words_at(docs, single.select("anchor", "runs", "doc", "copy", "start", "windows")))
    return repeats.unionAll(_by_automaton(words.where(F.col("runs") <= SHARD_RUNS))).unionAll(_by_window(words.where(F.col("runs") > SHARD_RUNS)))


def drop_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_text: the words that no repeated window covers, joined by a blank.

    Null texts have no words. Rows of one id are told apart by their text's order and count as documents one after
    another; a null id comes before all others. Texts shorter than a window lose nothing."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID)).alias("doc"), F.col(text_column).alias("text"))
    if rows.groupBy("doc").count().where("count > 1").isEmpty():
        rows = rows.withColumn("copy", F.lit(0))
    else:
        rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc").orderBy("text")))
    rows = rows.select("doc", "copy", "text")
    lists = repeated_windows(rows).groupBy("doc", "copy").agg(F.collect_list(F.struct("start", "windows")).alias("at"))

    @F.pandas_udf("n_words long, n_removed long, kept_text string")
    def kept(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, ats in batches:
            out = []
            for text, at in zip(texts, ats):
                words = words_of(text)
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                for r in at if at is not None else ():
                    edge[r["start"]] += 1
                    edge[r["start"] + r["windows"] + WINDOW - 1] -= 1
                stay = np.cumsum(edge)[:-1] == 0
                left = [w for w, s in zip(words, stay.tolist()) if s]
                out.append((len(words), len(words) - len(left), b" ".join(left).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text"])

    out = rows.join(lists, ["doc", "copy"], "left").select("doc", kept("text", "at").alias("r"))
    return out.select(F.when(F.col("doc") != _NO_ID, F.col("doc")).cast(kind).alias(id_column), "r.n_words", "r.n_removed", "r.kept_text")
