"""Operator 1: near-duplicate embeddings by spherical k-means cells.

Equal vectors are one row from the start. Every vector has a home cell, its nearest centre's, and visits each further
cell that might hold a partner: if two vectors are within the angle d of each other, at least one of them lies within
d / 2 of the plane between their two centres, so it is enough that this one visits the other's cell, and no link is
lost. In a cell, home vectors meet home vectors and visitors in blocks of bounded size, by matrix products in double
precision; a block gives counts of links and a spanning forest of them, never the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bounded_batches, cut, grouped, partitions, spread_join
from pagewright.llm.components import components

#: Vectors that the centres are fitted on, at most (on the driver: 16,000 of 1,000 numbers are 128 MB).
SAMPLE_ROWS = 16_000
MAX_CELLS = 4096
#: Cells: the root of the number of vectors over this. More cells prune more but are visited more.
CELL_ROOT = 16
#: Home vectors, and guests, of one block.
BLOCK, GUESTS = 4096, 16384


def usable(embedding: str | Column) -> Column:
    """Neither null nor empty nor zero, and all its numbers finite."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    good = F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce(good & F.exists(e, lambda x: x != 0), F.lit(False))


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled up with zeros."""
    rows = column.tolist()
    if all(len(r) == dim for r in rows):
        return np.array(rows, dtype=np.float64).reshape(len(rows), dim)
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very small or large numbers stay finite
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def centres(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Spherical k-means on unit vectors; empty cells keep their old centre."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        c = np.where((size > 1e-9)[:, None], sums / np.maximum(size, 1e-9)[:, None], c)
    return c


class Cells:
    def __init__(self, c: np.ndarray, cosine: float):
        self.c = c
        self.apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))
        self.margin = np.sin(np.arccos(cosine) / 2) + 1e-9

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home cell of each unit vector, and a boolean row of the cells that it visits."""
        s = x @ self.c.T
        home = s.argmax(axis=1)
        visits = s[np.arange(len(x)), home][:, None] - s <= self.margin * self.apart[home]
        visits[np.arange(len(x)), home] = False
        return home, visits


def groups(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component numbers of the rows and columns of a hit matrix, -1 without a hit."""
    rows, cols = np.full(hits.shape[0], -1), np.full(hits.shape[1], -1)
    n = 0
    for r in np.flatnonzero(hits.any(axis=1)):
        if rows[r] >= 0:
            continue
        rows[r] = n
        fresh = np.array([r])
        while len(fresh):
            reached = np.flatnonzero(hits[fresh].any(axis=0) & (cols < 0))
            cols[reached] = n
            fresh = np.flatnonzero(hits[:, reached].any(axis=1) & (rows < 0))
            rows[fresh] = n
        n += 1
    return rows, cols


def vector_groups(vectors: DataFrame, cosine: float = 0.9, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per row of vectors: id, n_links (other rows linked directly), component_id (smallest id reachable), kept (id = component_id).

    Vectors that are null, empty, zero or hold a null or non-finite number link with nothing. Vectors of different
    lengths are compared as if the shorter went on with zeros. Rows that repeat an id are counted as rows, and those of
    the smallest id are all kept. Rows without an id link and are counted like others, but give no component its id: they
    are kept only in a component without any id, whose component_id is null. Other columns aren't read."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    all_rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v")).withColumn("v", F.when(usable("v"), F.col("v")))
    # Distinct vectors have a number of their own, stable once it is written: ids may be null, repeated or no numbers.
    good = cut(all_rows.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("key", F.monotonically_increasing_id()))
    m, dim = good.agg(F.count("*"), F.max(F.size("v"))).first()
    lone = lambda df: df.select(F.col("id").alias(id_column), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not m:
        return lone(all_rows)
    k = int(min(MAX_CELLS, max(1, round(np.sqrt(m) / CELL_ROOT))))
    share = min(1.0, SAMPLE_ROWS * 0.95 / m)
    picked = good.where(F.pmod(F.xxhash64(F.lit("centres"), "v"), F.lit(1 << 20)) < int((1 << 20) * share) + 1).orderBy("v").limit(SAMPLE_ROWS).select("v").toPandas()["v"]
    sample = unit(matrix(picked, dim)) if len(picked) else np.eye(1, dim)
    k = min(k, len(sample))
    kind = np.dtype(np.float32 if good.schema["v"].dataType.elementType.simpleString() == "float" else np.float64)
    cells = Cells(centres(sample, k), cosine)

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        homes, guests = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
        for b in batches:
            if len(b):
                home, visits = cells.of(unit(matrix(b["v"], dim)))
                homes += np.bincount(home, minlength=k)
                guests += visits.sum(axis=0)
        yield pd.DataFrame({"cell": np.arange(k), "homes": homes, "guests": guests})

    found = good.select("v").mapInPandas(sizes, "cell int, homes long, guests long").groupBy("cell").agg(F.sum("homes"), F.sum("guests")).collect()
    blocks = np.zeros((k, 2), dtype=np.int64)  # at most MAX_CELLS rows came
    for cell, h, g in found:
        blocks[cell] = -(-h // BLOCK), -(-g // GUESTS)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each pair of blocks (lo, hi) of a cell that the vector has to do with. Blocks of homes come first, then blocks of guests."""
        for b in batches:
            if not len(b):
                continue
            x, draw = matrix(b["v"], dim), b["draw"].to_numpy()
            home, visits = cells.of(unit(x))
            packed = pd.DataFrame({"home": home.astype(np.int32), "key": b["key"].to_numpy(), "draw": draw, "n": b["n"].to_numpy(), "visits": [m.tobytes() for m in np.packbits(visits, axis=1)], "x": [r.tobytes() for r in x.astype(kind)]})
            h, g = blocks[home, 0], blocks[home, 1]
            row = np.repeat(np.arange(len(b)), h + g)
            other = np.arange(len(row)) - np.repeat(np.cumsum(h + g) - (h + g), h + g)
            mine = (draw % h)[row]
            guest, cell = np.nonzero(visits & (blocks[None, :, 0] > 0))
            times = blocks[cell, 0]
            guest, cell, at = np.repeat(guest, times), np.repeat(cell, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row_all = np.concatenate((row, guest))
            keys = {
                "cell": np.concatenate((home[row], cell)), "lo": np.concatenate((np.minimum(mine, other), at)),
                "hi": np.concatenate((np.maximum(mine, other), blocks[cell, 0] + draw[guest] % np.maximum(blocks[cell, 1], 1))),
            }
            own = np.arange(len(row_all)) < len(row)
            for s in range(0, len(row_all), 20_000):
                part = slice(s, s + 20_000)
                yield pd.DataFrame({k: v[part].astype(np.int32) for k, v in keys.items()} | {"own": own[part]}).join(packed.iloc[row_all[part]].reset_index(drop=True))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in grouped(batches, ["cell", "lo", "hi"]):
            cell, lo, hi = (int(g[c].iloc[0]) for c in ("cell", "lo", "hi"))
            homes, own = blocks[cell, 0], g["own"].to_numpy()
            guests, same = hi >= homes, lo == hi
            block = g["draw"].to_numpy() % homes
            a = g[own & (block == lo)]
            b = a if same else g[~own] if guests else g[own & (block == hi)]
            if not len(a) or not len(b):
                continue
            x, y = (np.frombuffer(b"".join(p["x"]), dtype=kind).reshape(len(p), dim) for p in (a, b))
            x32, y32 = unit(x).astype(np.float32), unit(y).astype(np.float32)
            for s in range(0, len(b), 2048):
                near = x32 @ y32[s : s + 2048].T >= cosine - 1e-4  # single precision rules out; double precision decides
                r, c = np.flatnonzero(near.any(axis=1)), s + np.flatnonzero(near.any(axis=0))
                if not len(r):
                    continue
                left, right = a.iloc[r], b.iloc[c]
                ids_a, ids_b = left["key"].to_numpy(), right["key"].to_numpy()
                hits = unit(x[r].astype(np.float64)) @ unit(y[c].astype(np.float64)).T >= cosine
                if same:
                    hits &= ids_a[:, None] != ids_b[None, :]
                if guests:  # a pair that both cells see counts where the guest's home has the smaller number
                    visits = np.unpackbits(np.frombuffer(b"".join(left["visits"]), dtype=np.uint8).reshape(len(left), -1), axis=1).astype(bool)
                    of = right["home"].to_numpy()
                    hits &= ~((of > cell)[None, :] & visits[:, of])
                if not hits.any():
                    continue
                ids, add, component = ids_a, hits @ right["n"].to_numpy(), np.concatenate(groups(hits))
                least = np.full(component.max() + 1, np.iinfo(np.int64).max)
                linked = component >= 0
                np.minimum.at(least, component[linked], np.concatenate((ids_a, ids_b))[linked])
                if same:
                    linked, component = linked[: len(ids_a)], component[: len(ids_a)]
                else:
                    ids, add = np.concatenate((ids, ids_b)), np.concatenate((add, hits.T @ left["n"].to_numpy()))
                yield pd.DataFrame({"key": ids[linked], "links": add[linked], "root": least[component[linked]]})

    dealt = good.select("key", "n", "v", F.pmod(F.xxhash64("key"), F.lit(1 << 30)).alias("draw"))
    rows = dealt.mapInPandas(deal, "cell int, lo int, hi int, own boolean, home int, key long, draw long, n long, visits binary, x binary")
    by = ["cell", "lo", "hi"]
    linked = cut(rows.repartition(partitions(spark), *by).sortWithinPartitions(*by).mapInPandas(compare, "key long, links long, root long"))
    counts = linked.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(linked.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "key")
    of = good.join(counts, "key", "left").join(roots, "key", "left")
    of = cut(of.select("v", "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "key").alias("root")))
    least = of.groupBy("root").agg(F.min("id").alias("component_id"))
    per = cut(spread_join(of, least, ["root"]).select("v", "n_links", "component_id"))
    out = spread_join(all_rows.where("v is not null"), per, ["v"])
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return out.select(F.col("id").alias(id_column), "n_links", "component_id", kept.alias("kept")).unionAll(lone(all_rows.where("v is null")))
