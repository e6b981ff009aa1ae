"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Rows lie in cells, by the nearest of centroids fitted on a bounded sample. A vector less its cell's centroid is turned by a
random matrix with orthonormal rows into a space of several dimensions for each of its own; the signs there, packed into 64-bit
words, are its code, and two scalars correct for it: its length, and how well the code points along it. A query, turned and cut
into four bit planes, meets packed codes by AND and population counts only; with the scalars that gives an unbiased estimate of
the inner product and an error bound. In each block of candidates a query computes the exact product first for those with the
best estimates, and then for every vector whose upper bound reaches the k-th best product known: that of the block so far, or
that among a small pilot sample. So bounds decide how many are reranked, never a fixed number.

Every row is in a cell and is searched from there. How many cells a query looks into is the least number that finds TARGET of
the sample's neighbours, so it is small where vectors cluster, and most cells where they don't. A candidate travels once to its
cell's block (once for every QUERY_BLOCK queries there), a query once to each block that it looks into; neither is broadcast.
Broadcast are the centroids and the pilot, whose sizes have constant bounds.

Equal vectors are one candidate, which carries its k + 1 least ids, as no others can be among the k nearest of anything; equal
queries are searched once. Defined results: ids are whole numbers; vectors that are null or zero, or hold null or non-finite
components, take no part; a query's neighbours are vectors of its own dimension, and dimensions are searched one by one; of rows
that repeat an id the one with the least vector counts; equal scores order by id; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomscan.llm.common import written

K = 20
#: Error bounds are so many standard deviations of the estimate wide.
BOUND = 3.0
SEED = 20240501
#: Code bits for each dimension (rounded up to whole words), and bits of a query's coordinate.
CODE_BITS = 4
QUERY_BITS = 4
#: Rows of a cell that are aimed at, and the most cells; rows of the sample that cells are fitted on, and of the pilot.
CELL_ROWS = 4096
MAX_CELLS = 2048
SAMPLE_ROWS = 65536
PILOT_ROWS = 4096
#: Share of the sample's neighbours that the cells looked into must hold.
TARGET = 0.97
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 16384


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random matrix with orthonormal rows, from dim to so many dimensions as a code has bits."""
    bits = -(-CODE_BITS * dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))
    return np.ascontiguousarray((q * np.sign(np.diag(r))).T)


def codes(rest: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes as 64-bit words, lengths, and the inner products of code and direction, of vectors less their centroids."""
    turned = rest @ turn
    length = np.sqrt((rest**2).sum(axis=1))
    along = np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1]) / np.where(length > 0, length, 1)
    packed = np.packbits(turned > 0, axis=1, bitorder="little").view("<u8")
    return packed, length, np.where(length > 0, along, 1.0)


def planes(turned: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Bit planes (QUERY_BITS, words) of a turned query, and the least value and step of its coordinates."""
    low, high = float(turned.min()), float(turned.max())
    step = (high - low) / ((1 << QUERY_BITS) - 1) or 1.0
    level = np.rint((turned - low) / step).astype(np.uint8)
    return np.stack([np.packbits(level >> p & 1, bitorder="little").view("<u8") for p in range(QUERY_BITS)]), low, step


@dataclass
class Candidates:
    """A block of candidates of one cell."""

    keys: np.ndarray
    vectors: np.ndarray
    words: np.ndarray
    length: np.ndarray
    along: np.ndarray
    centre: np.ndarray

    def __post_init__(self):
        self.words = np.ascontiguousarray(self.words.T)
        self.ones = np.bitwise_count(self.words).sum(axis=0, dtype=np.int64)
        self.factor = self.length / self.along
        bits = 64 * len(self.words)
        self.root, self.spread = np.sqrt(bits), np.sqrt(np.maximum(1 - self.along**2, 0) / max(bits - 1, 1))

    def estimates(self, query: np.ndarray, turned: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products with a query, and their bounds of error."""
        bit_planes, low, step = planes(turned)
        sums = np.zeros(len(self.keys), dtype=np.int64)
        for p, plane in enumerate(bit_planes):
            count = np.zeros(len(self.keys), dtype=np.uint16)
            for codes_word, word in zip(self.words, plane, strict=True):
                count += np.bitwise_count(codes_word & word)
            sums += count.astype(np.int64) << p
        level_sum = sum(int(np.bitwise_count(x).sum()) << p for p, x in enumerate(bit_planes))
        # twice the sum over set bits less the sum over all, of the coordinates as the planes have them
        product = (2 * (low * self.ones + step * sums) - (low * len(turned) + step * level_sum)) / self.root
        estimate = product * self.factor + query @ self.centre
        size = np.sqrt(query @ query)
        error = bound * self.factor * np.sqrt(self.spread**2 * size**2 + step**2 / 12) + 1e-9 * (np.abs(estimate) + size)
        return estimate, error

    def search(self, query: np.ndarray, turned: np.ndarray, key: int, floor: float, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact inner products of all that can be among the k + 1 nearest ids; floor: what the k-th best is at least."""
        estimate, error = self.estimates(query, turned, bound)
        if len(estimate) <= 2 * k:
            some = np.arange(len(estimate))
            return some, (self.vectors * query).sum(axis=1)
        first = np.argpartition(-estimate, 2 * k)[: 2 * k]
        exact = (self.vectors[first] * query).sum(axis=1)
        others = np.sort(exact[self.keys[first] != key])
        reach = max(floor, float(others[-k]) if len(others) >= k else -np.inf)
        wanted = (estimate + error >= reach) | (self.keys == key)
        wanted[first] = False
        more = np.flatnonzero(wanted)
        return np.concatenate([first, more]), np.concatenate([exact, (self.vectors[more] * query).sum(axis=1)])


class Cells:
    """Centroids of a sample, how many cells to look into, and a pilot that bounds the k-th best from below."""

    def __init__(self, keys: np.ndarray, sample: np.ndarray, total: int, k: int = K, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.k = k
        n = int(min(max(1, round(total / CELL_ROWS)), MAX_CELLS, max(1, len(sample) // 16)))
        self.centroids = sample[np.sort(rng.choice(len(sample), n, replace=False))].astype(np.float64) if n > 1 else sample.mean(axis=0, keepdims=True)
        for _ in range(10 if n > 1 else 0):
            cell = self.of(sample)
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, cell, sample)
            count = np.bincount(cell, minlength=n)
            self.centroids[count > 0] = sums[count > 0] / count[count > 0][:, None]
        pilot = np.sort(rng.choice(len(sample), min(PILOT_ROWS, len(sample)), replace=False))
        self.pilot_keys, self.pilot = keys[pilot], sample[pilot].astype(np.float64)
        self.probes = self._probes(sample, rng)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The nearest centroid of each vector."""
        half = (self.centroids**2).sum(axis=1) / 2
        return np.concatenate([(vectors[at : at + 4096] @ self.centroids.T - half).argmax(axis=1) for at in range(0, len(vectors), 4096)]) if len(vectors) else np.zeros(0, dtype=np.int64)

    def _probes(self, sample: np.ndarray, rng: np.random.Generator) -> int:
        """The least number of cells that hold TARGET of the nearest in the sample, over queries from it."""
        n = len(self.centroids)
        if n == 1:
            return 1
        cell = self.of(sample)
        ranks = []
        for q in rng.choice(len(sample), min(256, len(sample)), replace=False):
            score = sample @ sample[q]
            score[q] = -np.inf
            best = np.argpartition(-score, min(self.k, len(score) - 1))[: self.k]
            rank = np.empty(n, dtype=np.int64)
            rank[np.argsort(-(self.centroids @ sample[q]), kind="stable")] = np.arange(n)
            ranks.append(rank[cell[best]])
        found = np.cumsum(np.bincount(np.concatenate(ranks), minlength=n)) / sum(map(len, ranks))
        return int(min(n, np.searchsorted(found, TARGET) + 1))

    def look_into(self, queries: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells of each query, and what its k-th best inner product is at least."""
        cells = np.argsort(-(queries @ self.centroids.T), axis=1, kind="stable")[:, : self.probes]
        score = queries @ self.pilot.T
        score[keys[:, None] == self.pilot_keys[None]] = -np.inf
        if score.shape[1] < self.k:
            return cells, np.full(len(queries), -np.inf)
        floor = -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1]
        return cells, floor - 1e-9 * (np.abs(floor) + 1)


def nearest_ids(scores: np.ndarray, ids: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k ids of candidates that each stand for several, by score, then id."""
    flat, score = np.concatenate(ids), np.repeat(scores, [len(x) for x in ids])
    order = np.lexsort((flat, -score))[:k]
    return flat[order], score[order]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(finite & F.exists("v", lambda x: x != 0)).groupBy("id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, is_query: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, bound: float = BOUND, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query, found by codes and reranked by the original vectors. is_query is over the column id."""
    spark = vectors.sparkSession
    is_query = F.col("id") % 20 == 0 if is_query is None else is_query
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    rows = written(usable(vectors, id_col, vector_col))
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count_if(is_query).alias("q")).orderBy("d").collect()
    parts = [_nearest(rows.filter(F.size("v") == r["d"]), int(r["d"]), "<f4" if single else "<f8", is_query, k, bound, seed) for r in dims if r["q"]]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")


def _stacked(column: pa.Array | pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), width)


def _nearest(rows: DataFrame, dim: int, kind: str, is_query: Column, k: int, bound: float, seed: int) -> DataFrame:
    """nearest() over the usable rows of one dimension."""
    spark, turn = rows.sparkSession, rotation(dim, seed)

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").values.to_numpy(zero_copy_only=False).reshape(-1, dim).astype(kind) + 0.0  # no negative zeros
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in v.astype(kind)], type=pa.binary())], names=["id", "raw"])

    raw = rows.mapInArrow(to_bytes, "id bigint, raw binary")
    few = raw.withColumn("n", F.row_number().over(Window.partitionBy("raw").orderBy("id"))).filter(F.col("n") <= k + 1)
    distinct = written(few.groupBy("raw").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("key"), "ids", "raw"))
    total = distinct.count()
    share = F.lit(int(min(1.0, SAMPLE_ROWS / 1.1 / total) * ((1 << 62) - 1)))
    sample = distinct.filter(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 62)) <= share).select("key", "raw").toArrow()
    order = np.argsort(sample.column("key").to_numpy())
    cells = Cells(sample.column("key").to_numpy()[order], _stacked(sample.column("raw"), kind, dim)[order].astype(np.float64), total, k, seed)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _stacked(batch.column("raw"), kind, dim).astype(np.float64)
            cell = cells.of(v)
            packed, length, along = codes(v - cells.centroids[cell], turn)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, type=pa.int32()), pa.array([x.tobytes() for x in packed], type=pa.binary()), pa.array(length), pa.array(along)], names=[*batch.schema.names, "cell", "code", "length", "along"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found, floor = cells.look_into(_stacked(part.column("raw"), kind, dim).astype(np.float64), part.column("key").to_numpy())
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("raw"), pa.array(found.tolist(), type=pa.list_(pa.int32())), pa.array(floor)], names=["key", "raw", "cells", "floor"])

    coded = written(distinct.mapInArrow(encode, "key bigint, ids array<bigint>, raw binary, cell int, code binary, length double, along double"))
    members = written(raw.filter(is_query).join(distinct.select("raw", "key"), "raw").select(F.col("id").alias("query_id"), "key"))
    asked = distinct.select("key", "raw").join(members.select("key").distinct(), "key").select("key", "raw")
    looking = written(asked.mapInArrow(look, "key bigint, raw binary, cells array<int>, floor double").select("key", "raw", F.explode("cells").alias("cell"), "floor"))
    # blocks of each cell; there are no more than MAX_CELLS of them
    counts = {r[0]: r[1] for r in coded.groupBy("cell").count().collect()}
    asking = {r[0]: r[1] for r in looking.groupBy("cell").count().collect()}
    sizes = [(c, -(-n // CANDIDATE_BLOCK), -(-asking[c] // QUERY_BLOCK)) for c, n in counts.items() if c in asking]
    blocks = F.broadcast(spark.createDataFrame(sizes, "cell int, n_c int, n_q int"))
    place = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    candidates = coded.join(blocks, "cell").select("key", "ids", "raw", "cell", "code", "length", "along", place("n_c").alias("c"), every("n_q").alias("q"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("ids", "array<bigint>"), ("code", "binary"), ("along", "double"))]
    queries = looking.join(blocks, "cell").select("key", none[0], "raw", "cell", none[1], F.col("floor").alias("length"), none[2], every("n_c").alias("c"), place("n_q").alias("q"))

    def block(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = pc.is_null(table.column("code"))
        mine, others = table.filter(asks), table.filter(pc.invert(asks))
        out: tuple[list, list, list] = ([np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)])
        if len(mine) and len(others):
            vectors = _stacked(others.column("raw"), kind, dim).astype(np.float64)
            held = Candidates(others.column("key").to_numpy(), vectors, _stacked(others.column("code"), "<u8", turn.shape[1] // 64), others.column("length").to_numpy(), others.column("along").to_numpy(), cells.centroids[others.column("cell")[0].as_py()])
            lists = others.column("ids").combine_chunks()
            flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
            starts = np.concatenate([[0], ends[:-1]])
            own, asked = mine.column("key").to_numpy(), _stacked(mine.column("raw"), kind, dim).astype(np.float64)
            turned, floor = asked @ turn, mine.column("length").to_numpy()
            for i, key in enumerate(own.tolist()):
                some, scores = held.search(asked[i], turned[i], key, floor[i], k, bound)
                if len(scores) > k + 1:  # with all ties
                    at = scores >= np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                    some, scores = some[at], scores[at]
                ids, best = nearest_ids(scores, [flat[starts[j] : ends[j]] for j in some.tolist()], k + 1)
                out[0].append(np.full(len(ids), key))
                out[1].append(ids)
                out[2].append(best)
        return pa.table([pa.array(np.concatenate(x)) for x in out], names=["key", "vec_id", "score"])

    best = candidates.unionByName(queries).groupBy("cell", "c", "q").applyInArrow(block, "key bigint, vec_id bigint, score double")
    ranked = best.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= k + 1)
    lists = ranked.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    kept = members.join(lists, "key").select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return kept.select("query_id", F.posexplode("found").alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), "x.vec_id", "x.score")
