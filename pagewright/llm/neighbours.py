"""Operator 8: approximate nearest neighbours by NN-descent.

Equal vectors are one node. Nodes are numbered by bucket: random planes, fitted on a bounded sample, cut the table into
buckets of nodes that lie near each other, and a node's number begins with its bucket. First lists come from leaves:
in each of several draws of planes a bucket is halved again and again at its median until a leaf holds LEAF nodes at
most, and the nodes of a leaf are compared with each other. Then, round by round, each node brings some of its
neighbours and of those that name it together, others each time, and they learn of each other: a Spark join of
neighbours of neighbours. Rounds go on until few list entries change. Queries walk the graph greedily from their own
lists, opening the nearest nodes that aren't open yet, until all they hold are open. The way is the same at every size.

A vector is sent once to each group of numbers that needs it, in 16-bit steps of its largest number (an inner product is off by
some 0.00001 of the vectors' lengths); what comes out at the end is measured again in double precision.

The lists (KEEP), the neighbours that meet (MEET), the nodes opened at a time (OPEN) and held (HELD) are the method's
parameters: it is approximate, and its recall is measured against brute force in the tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import bounded_batches, cut, partitions, spread_join
from pagewright.llm.vector_dedup import matrix, usable

KEEP, MEET = 40, 16
#: Rounds end when no more than this share of the list entries is new.
SETTLED = 0.05
DRAWS, LEAF = 8, 256
#: Nodes of a bucket, and numbers in a bucket's vectors, at most.
BUCKET, BUCKET_NUMBERS = 4096, 1 << 19
#: Bits of a number within a group: 256 nodes that follow each other meet their guests in one group, 2,048 are looked up by queries in one.
MEETING, LOOKUP = 8, 11
#: The sample that planes are fitted on: rows for each bucket, and rows and numbers at most.
BUCKET_SAMPLE, SAMPLE_ROWS, SAMPLE_NUMBERS = 256, 1 << 16, 1 << 24
OPEN, HELD = 120, 120
#: Bits of a node's number within its bucket.
PLACE = 32
LIST = "key long, nbr array<long>, sim array<float>"
CARRIED = "x binary, turn long"


def _packed(x: np.ndarray) -> list[bytes]:
    scale = np.maximum(np.abs(x).max(axis=1, initial=0), np.finfo(np.float32).tiny).astype(np.float32) / np.float32(32767)
    steps = np.rint(x / scale[:, None]).clip(-32767, 32767).astype(np.int16)
    return [s.tobytes() + r.tobytes() for s, r in zip(scale, steps)]


def _column(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    c = table.column(name)
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _numbers(table, name: str) -> np.ndarray:
    return _column(table, name).to_numpy(zero_copy_only=False)


def _vectors(table, name: str = "x") -> np.ndarray:
    """Single-precision vectors of a column of packed ones."""
    rows = _column(table, name).to_pylist()
    raw = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1)
    return raw[:, 4:].copy().view(np.int16).astype(np.float32) * raw[:, :4].copy().view(np.float32)


def _lists(table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(row of each entry, entry) of a list column."""
    c = _column(table, name)
    size = np.diff(c.offsets.to_numpy())
    return np.repeat(np.arange(len(c)), size), c.flatten().to_numpy()


def _list_rows(key: np.ndarray, nbr: np.ndarray, sim: np.ndarray, **more: np.ndarray) -> pa.Table:
    """Rows of LIST out of entries that are sorted by key; `more` holds an entry's further numbers, summed by key."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    offsets = pa.array(np.append(first, len(key)).astype(np.int32))
    lists = {n: pa.ListArray.from_arrays(offsets, pa.array(v)) for n, v in (("nbr", nbr.astype(np.int64)), ("sim", sim.astype(np.float32)))}
    sums = {n: pa.array(np.add.reduceat(v.astype(np.int64), first) if len(first) else np.zeros(0, dtype=np.int64)) for n, v in more.items()}
    return pa.table({"key": pa.array(key[first].astype(np.int64)), **lists, **sums})


def _nearest(key: np.ndarray, nbr: np.ndarray, sim: np.ndarray, keep: int, old: np.ndarray | None = None) -> pa.Table:
    """Entries as lists: each neighbour once, the nearest `keep` of each key, ties to the smaller number; with `fresh`, how many of them no old entry had."""
    order = np.lexsort((-sim, nbr, key))
    key, nbr, sim = key[order], nbr[order], sim[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (nbr[1:] != nbr[:-1])
    first = np.flatnonzero(new)
    was = np.logical_or.reduceat(old[order], first) if old is not None and len(first) else np.zeros(len(first), dtype=bool)
    key, nbr, sim = key[first], nbr[first], sim[first]
    order = np.lexsort((nbr, -sim, key))
    key, nbr, sim, was = key[order], nbr[order], sim[order], was[order]
    head = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1)) if len(key) else np.zeros(0, dtype=np.int64)
    nth = np.arange(len(key)) - np.repeat(head, np.diff(np.append(head, len(key))))
    few = nth < keep
    more = {} if old is None else {"fresh": ~was[few]}
    return _list_rows(key[few], nbr[few], sim[few], **more)


def merged(lists: DataFrame, keep: int, carried: str = "") -> DataFrame:
    """One list per key, the `keep` nearest of all its rows, and `fresh`, how many of them are new. A key has a bounded number of rows.

    lists: LIST, `old` (whether a row is what the key had before; one such row a key) and the carried columns (as in a
    schema), which are handed on from the old row."""
    names = [c.split()[0] for c in carried.split(", ") if c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            key = _numbers(t, "key")
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on in the next batch
            held = t.slice(whole)
            if whole:
                yield from settle(t.slice(0, whole))
        if held is not None and len(held):
            yield from settle(held)

    def settle(t: pa.Table) -> list[pa.RecordBatch]:
        t = t.combine_chunks()
        old = _numbers(t, "old").astype(bool)
        (row, nbr), (_, sim), at = _lists(t, "nbr"), _lists(t, "sim"), np.flatnonzero(old)
        key = _numbers(t, "key")
        found = _nearest(key[row], nbr, sim, keep, old[row])
        if names:  # a key may have no neighbour at all
            place = np.searchsorted(_numbers(found, "key"), key[at])
            given = np.isin(key[at], _numbers(found, "key"))
            found = pa.table({"key": pa.array(key[at]), **{n: _either(found, n, place, given) for n in found.column_names[1:]}})
            found = pa.table({**{n: found.column(n) for n in found.column_names}, **{n: t.column(n).take(pa.array(at)) for n in names}})
        return found.combine_chunks().to_batches()

    rows = lists.repartition(partitions(lists.sparkSession), "key").sortWithinPartitions("key")
    return rows.mapInArrow(run, ", ".join([LIST, "fresh long", *([carried] if carried else [])]))


def _either(t: pa.Table, name: str, place: np.ndarray, given: np.ndarray) -> pa.ChunkedArray:
    """A column's values at the places, and empty or zero where none is given."""
    c = t.column(name)
    empty = pa.array([[]] if pa.types.is_list(c.type) else [0], type=c.type)
    return pa.chunked_array([*c.chunks, empty]).take(pa.array(np.where(given, place, len(c))))


class Planes:
    """Random directions, one a draw and level, and where each halves the sample's part that the levels above it leave."""

    def __init__(self, sample: np.ndarray, draws: int, depth: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.depth = depth
        self.ways = rng.standard_normal((draws, sample.shape[1], depth)).astype(np.float32)
        self.cuts = np.zeros((draws, 1 << depth), dtype=np.float32)
        for d in range(draws):
            along, code = sample @ self.ways[d], np.ones(len(sample), dtype=np.int64)
            for level in range(depth):
                order = np.lexsort((along[:, level], code))
                ends = np.searchsorted(code[order], np.arange(1 << level, (2 << level) + 1))
                for c in range(1 << level):
                    a, b = ends[c], ends[c + 1]
                    if b > a:
                        self.cuts[d, (1 << level) + c] = along[order[(a + b) // 2], level]
                code = code * 2 + (along[:, level] >= self.cuts[d, code])

    def buckets(self, x: np.ndarray, draw: int) -> np.ndarray:
        code, along = np.ones(len(x), dtype=np.int64), x @ self.ways[draw]
        for level in range(self.depth):
            code = code * 2 + (along[:, level] >= self.cuts[draw, code])
        return code - (1 << self.depth)


def bucket_depth(n: int, dim: int, leaf: int) -> int:
    """How often the table is halved until a bucket has the size wanted; but the largest sample has to leave 16 rows a bucket."""
    size = max(leaf, min(BUCKET, BUCKET_NUMBERS // dim))
    most = min(SAMPLE_ROWS, SAMPLE_NUMBERS // dim) // 16
    return max(0, int(np.ceil(np.log2(min(max(n, 1) / size, max(most, 1))))))


def halved(x: np.ndarray, leaf: int, seed: int) -> list[np.ndarray]:
    """Rows dealt out to leaves of `leaf` rows at most, by halving at the median along random directions: however close rows lie, no leaf stays crowded."""
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(x))]
    while len(parts[0]) > leaf:
        way = rng.standard_normal(x.shape[1]).astype(np.float32)
        parts = [h for p in parts for h in np.array_split(p[np.argsort(x[p] @ way, kind="stable")], 2)]
    return parts


def numbered(nodes: DataFrame, planes: Planes, dim: int) -> DataFrame:
    """nodes (v, copies) with x, the packed vector, and key, a number that begins with the bucket in the first draw."""

    @F.pandas_udf("x binary, bucket long, beside long")
    def pack(v: pd.Series) -> pd.DataFrame:
        x = matrix(v, dim)
        single = x.astype(np.float32)
        return pd.DataFrame({"x": _packed(x), "bucket": planes.buckets(single, 0), "beside": planes.buckets(single, len(planes.ways) - 1)})

    rows = cut(nodes.select("v", "copies", pack("v").alias("p")).select("v", "copies", "p.*"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("beside", "copies", "v"))  # those that follow each other are near in a second draw too
    return rows.select("v", "copies", "x", (F.shiftleft("bucket", PLACE) + place).alias("key"))


def leaf_lists(nodes: DataFrame, planes: Planes, keep: int, draws: int, leaf: int) -> DataFrame:
    """First lists (LIST), one per node and draw."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = _vectors(b)
                for d in range(draws):
                    yield pa.RecordBatch.from_pydict({"draw": pa.array(np.full(len(x), d, dtype=np.int32)), "bucket": pa.array(planes.buckets(x, d)), "key": b.column("key"), "x": b.column("x")})

    def compare(t: pa.Table) -> pa.Table:
        key, x = _numbers(t, "key"), _vectors(t)
        order = np.argsort(key)  # the same leaves whatever order rows come in
        key, x = key[order], x[order]
        out = []
        for part in halved(x, leaf, int(_numbers(t, "draw")[0]) * 7919 + int(_numbers(t, "bucket")[0])):
            if len(part) < 2:
                continue
            s = x[part] @ x[part].T
            np.fill_diagonal(s, -np.inf)
            k = min(keep, len(part) - 1)
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            out.append((np.repeat(key[part], k), key[part][top].ravel(), np.take_along_axis(s, top, 1).ravel()))
        if not out:
            return _list_rows(*(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.float32)))
        return _list_rows(*(np.concatenate(c) for c in zip(*out)))

    dealt = nodes.select("key", "x").mapInArrow(deal, "draw int, bucket long, key long, x binary")
    return dealt.groupBy("draw", "bucket").applyInArrow(compare, LIST)


def _some(names: Column, key: Column, take: int, turn: Column) -> Column:
    """`take` of an array of node numbers, others in another turn."""
    drawn = F.array_sort(F.transform(names, lambda v: F.struct(F.xxhash64(turn, key, v).alias("h"), v.alias("v"))))
    return F.transform(F.slice(drawn, 1, take), lambda s: s["v"])


def reverse(graph: DataFrame, take: int, of: int, turn: Column) -> DataFrame:
    """(u, v): for each node u, `take` of the nodes v that have it among `of` of their neighbours; others in another turn."""
    named = graph.select(F.explode(_some(F.col("nbr"), F.col("key"), of, turn)).alias("u"), F.col("key").alias("v"), turn.alias("turn"))
    w = Window.partitionBy("u").orderBy(F.xxhash64("u", "v", "turn"))  # limited before the shuffle as well
    return named.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= take).select("u", "v")


def _marks(key: np.ndarray) -> np.ndarray:
    """16-bit marks of node numbers."""
    with np.errstate(over="ignore"):
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def marked(lists: Column) -> Column:
    """A list's marks, for those who learn to leave out what it holds. Of what it doesn't hold, one in 1,600 is left out as well at 40 entries."""

    @F.pandas_udf("binary")
    def marks(rows: pd.Series) -> pd.Series:
        size = rows.map(len).to_numpy()
        flat = _marks(np.concatenate(rows.tolist()) if size.sum() else np.zeros(0, dtype=np.int64)).tobytes()
        ends = 2 * np.cumsum(size)
        return pd.Series([flat[a:b] for a, b in zip((ends - 2 * size).tolist(), ends.tolist())], dtype=object)

    return marks(lists)


def descend(graph: DataFrame, keep: int, meet: int) -> DataFrame:
    """One round: whoever meets at a node and is nearer than the last of its own list joins that list.

    graph: LIST, x and turn, the number of the round. A guest's vector goes once to each group of hosts in which it meets others."""
    turn = F.col("turn") * 2  # a column, not a literal, so that a round's plan is compiled once
    forward = graph.select(F.col("key").alias("u"), F.explode(_some(F.col("nbr"), F.col("key"), meet, turn)).alias("v"))
    there = forward.unionAll(reverse(graph, meet, meet, turn + 1))
    hosts = there.groupBy(F.shiftright("u", MEETING).alias("group"), F.col("v").alias("key")).agg(F.collect_set("u").alias("at"))
    last = F.when(F.size("nbr") >= keep, F.element_at("sim", -1)).otherwise(F.lit(float("-inf"))).cast("float")
    guests = hosts.join(graph.select("key", "x", last.alias("last"), marked("nbr").alias("known")), "key")

    def learn(t: pa.Table) -> pa.Table:
        key, x, last = _numbers(t, "key"), _vectors(t), _numbers(t, "last")
        mark, known = _marks(key), np.zeros((len(key), keep), dtype=np.int32) - 1
        for r, b in enumerate(_column(t, "known").to_pylist()):
            known[r, : len(b) // 2] = np.frombuffer(b, dtype=np.uint16)
        guest, host = _lists(t, "at")
        order = np.lexsort((key[guest], host))
        guest, host = guest[order], host[order]
        first = np.flatnonzero(np.concatenate(([True], host[1:] != host[:-1])))
        size = np.diff(np.append(first, len(host)))
        found = []
        together = max(1, (1 << 22) // (int(size.max()) * max(x.shape[1], int(size.max()))))  # a table of products stays under 16 MB
        for start in range(0, len(first), together):
            f, s = first[start : start + together], size[start : start + together]
            place = np.arange(int(s.max()))
            there = place < s[:, None]
            at = guest[np.minimum(f[:, None] + place, len(guest) - 1)]
            who = x[at]
            near = who @ who.transpose(0, 2, 1)
            good = (near > last[at][:, :, None]) & there[:, :, None] & there[:, None, :] & (place[:, None] != place)
            h, i, j = np.nonzero(good)
            a, b, s = at[h, i], at[h, j], near[h, i, j]
            new = np.concatenate([~(known[a[c : c + 100_000]] == mark[b[c : c + 100_000], None]).any(axis=1) for c in range(0, len(a), 100_000)] or [np.zeros(0, dtype=bool)])
            found.append((key[a[new]], key[b[new]], s[new]))
        return _nearest(*(np.concatenate(c) for c in zip(*found)), keep)

    learned = guests.groupBy("group").applyInArrow(learn, LIST)
    before = graph.select("key", "nbr", "sim", F.lit(True).alias("old"), "x", (F.col("turn") + 1).alias("turn"))
    return merged(before.unionByName(learned.withColumn("old", F.lit(False)), allowMissingColumns=True), keep, CARRIED)


def neighbour_graph(nodes: DataFrame, planes: Planes, n: int, keep: int, meet: int, draws: int, leaf: int) -> DataFrame:
    """LIST and x of all nodes, brought together until a round changes few entries. Lists only get nearer, so it ends."""
    none = nodes.select("key", F.array().cast("array<long>").alias("nbr"), F.array().cast("array<float>").alias("sim"), F.lit(True).alias("old"), "x", F.lit(0).cast("long").alias("turn"))
    leaves = leaf_lists(nodes, planes, keep, draws, leaf).withColumn("old", F.lit(False))
    graph, new = cut(merged(none.unionByName(leaves, allowMissingColumns=True), keep, CARRIED)), n * keep
    while new > SETTLED * n * min(keep, max(n - 1, 1)):
        graph = cut(descend(graph, keep, meet))
        new = graph.agg(F.coalesce(F.sum("fresh"), F.lit(0))).first()[0]
    return graph


def search(graph: DataFrame, queries: DataFrame, open_: int, held: int) -> DataFrame:
    """LIST with up to `held` nodes for each query node (queries: key), by greedy search from its own list until every
    node it holds has been opened."""
    back = reverse(graph, KEEP, KEEP, F.col("turn")).groupBy(F.col("u").alias("key")).agg(F.collect_list("v").alias("nbr"))
    links = graph.select("key", "nbr").unionAll(back).groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("nbr"))).alias("to"))
    links = cut(links.withColumnRenamed("key", "f"))
    nodes = graph.select(F.shiftright("key", LOOKUP).alias("group"), "key", "x")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per query and group that it has candidates in."""
        for b in batches:
            row, c = _lists(b, "to")
            order = np.lexsort((c, row))
            row, c = row[order], c[order]
            group = c >> LOOKUP
            first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (group[1:] != group[:-1])))) if len(c) else np.zeros(0, dtype=np.int64)
            at = pa.array(row[first])
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(c)).astype(np.int32)), pa.array(c))
            yield pa.RecordBatch.from_pydict({"group": pa.array(group[first]), "key": b.column("key").take(at), "x": b.column("x").take(at), "last": b.column("last").take(at), "to": lists})

    def score(asked: pa.Table, there: pa.Table) -> pa.Table:
        out = []
        if len(asked):
            key, x = _numbers(there, "key"), _vectors(there)
            order = np.argsort(key)
            key, x = key[order], x[order]
            ask, last, q = _numbers(asked, "key"), _numbers(asked, "last"), _vectors(asked)
            row, c = _lists(asked, "to")
            for a in range(0, len(c), 100_000):
                r, k = row[a : a + 100_000], c[a : a + 100_000]
                s = np.einsum("ij,ij->i", q[r], x[np.searchsorted(key, k)])
                good = s > last[r]
                out.append((ask[r[good]], k[good], s[good]))
        if not out:
            return _list_rows(*(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.float32)))
        return _nearest(*(np.concatenate(c) for c in zip(*out)), held)

    state = graph.select("key", "nbr", "sim", "x").join(queries, "key").withColumn("opened", F.array().cast("array<long>"))
    while True:
        front = F.slice(F.array_except("nbr", "opened"), 1, open_)
        state = cut(state.select("key", "nbr", "sim", "x", "opened", front.alias("front")))
        if state.where(F.size("front") > 0).isEmpty():
            return state.select("key", "nbr", "sim")
        met = state.select("key", F.explode("front").alias("f")).join(links, "f")  # a row of links is small, so a hot node's queries can be split at run time
        last = F.when(F.size("nbr") >= held, F.element_at("sim", -1)).otherwise(F.lit(float("-inf"))).cast("float")
        new = met.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("to"))).alias("to")).join(state.select("key", "x", "nbr", last.alias("last")), "key")
        asked = new.select("key", "x", "last", F.array_except(F.array_except("to", "nbr"), F.array("key")).alias("to"))
        dealt = asked.mapInArrow(deal, "group long, key long, x binary, last float, to array<long>")
        scored = dealt.groupBy("group").cogroup(nodes.groupBy("group")).applyInArrow(score, LIST)
        before = state.select("key", "nbr", "sim", F.lit(True).alias("old"), "x", F.concat("opened", "front").alias("opened"))
        state = merged(before.unionByName(scored.withColumn("old", F.lit(False)), allowMissingColumns=True), held, "x binary, opened array<long>")


def _inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)).cast("double") * F.coalesce(y, F.lit(0.0)).cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", leaf: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row of `is_query` (a condition on the id column named id), nearest first, ties to the smaller id.

    Vectors that are null, empty, zero or hold a null or non-finite number take no part, nor do rows without an id.
    Vectors of different lengths are compared as if the shorter went on with zeros. Fewer than k other rows give fewer
    results. Rows that repeat an id with the same vector count once; an id with several vectors stands for as many
    rows and queries, which don't find each other. Other columns aren't read."""
    bounded_batches(vectors.sparkSession)
    leaf = leaf or LEAF
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).where(usable("v") & F.col("id").isNotNull())
    # A node's k + 1 smallest ids are all that can be among anyone's k nearest of its copies.
    few = rows.distinct().withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("nth") <= k + 1)
    nodes = cut(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("copies")))
    n, dim = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
    dim = dim or 1
    depth = bucket_depth(n, dim, leaf)
    most = min(BUCKET_SAMPLE << depth, max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // dim)))
    cell = F.pmod(F.xxhash64(F.lit("planes"), "v"), F.lit(1 << 30))
    drawn = nodes.where(cell <= int((1 << 30) * min(1.0, most / max(n, 1)))).limit(most).select("v").toPandas()["v"]
    sample = matrix(drawn, dim).astype(np.float32) if len(drawn) else np.zeros((1, dim), dtype=np.float32)
    planes = Planes(sample, DRAWS, depth)
    full = cut(numbered(nodes, planes, dim))
    asking = cut(spread_join(cut(rows.where(is_query).select(F.col("id").alias("query_id"), "v").distinct()), full.select("v", "key"), ["v"]).select("query_id", "key"))
    graph = neighbour_graph(full.select("key", "x"), planes, n, KEEP, MEET, DRAWS, leaf)
    held = max(HELD, 2 * k)
    found = search(graph, asking.select("key").distinct(), OPEN, held)
    near = F.slice("nbr", 1, 2 * k + 24)  # those whose order single steps of 16 bits could change
    pairs = found.select("key", F.explode(near).alias("c")).unionAll(asking.select("key", F.col("key").alias("c")).distinct())
    exact = pairs.join(full.select(F.col("key").alias("c"), F.col("v").alias("v_c"), "copies"), "c").join(full.select("key", "v"), "key")
    each = exact.select("key", _inner(F.col("v"), F.col("v_c")).alias("score"), F.explode("copies").alias("vec_id"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("vec_id").asc()))
    top = each.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("top"))
    mine = spread_join(asking, cut(top), ["key"])
    others = F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k)
    ranked = mine.select("query_id", F.posexplode(others).alias("at", "t"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), "t.vec_id", "t.score")
