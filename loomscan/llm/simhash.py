"""SimHash fingerprints of word shingles, linked by covering locality-sensitive hashing.

Radius r needs 2^(r+1) - 1 tables. Bit i has a non-zero code word c(i) of r+1 bits, and table v keeps the bits whose code word
has an odd inner product with v. The bits in which two fingerprints differ give at most r equations over r+1 unknown bits, so
some v that isn't zero solves all of them: in that table the two keep equal bits. No pair within the radius is missed.

Equal fingerprints collapse to one row (with their least id) before the tables are made, so copies never meet in a bucket.
Buckets of two are decided in the JVM; in larger ones a search that drops what it has linked emits a spanning set of links,
fewer than the bucket has fingerprints. A bucket of more than LARGE fingerprints is dealt anew: they agree on its mask, so a
second covering family over the other bits, about half of them, again has a table for every pair within the radius. What agrees
on both differs in no more than 16 bits, so that the search never has more than 2^16 fingerprints in hand, however many rows
there are. Components follow by distributed star steps. All joins but that with the masks merge, so that the driver never holds
rows whose number grows with the table.

Defined results: ids are whole numbers; null and empty texts have no shingle and the fingerprint zero, which links like any other; fewer words than
a shingle has give one shingle of them all; repeated rows share a fingerprint; rows with a null id get a fingerprint, link
nothing and have a null component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.llm.common import lots, own_prefix, partitions, written
from loomscan.llm.components import components

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
BITS = 64
#: A bucket of more fingerprints is dealt over a second covering family.
LARGE = 4096


def fingerprint(text: bytes | None, size: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit SimHash of a text's shingles, repeats included."""
    found = (text or b"").lower().split()
    n = len(found)
    if not n:
        return 0
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if n <= size:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=n) + 1)
    starts = ends - 1
    begin = [0, *ends[: n - size].tolist()]
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begin, starts[size - 1 :].tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        block = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def covering(places: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the bits at places, as unsigned numbers: any so many of these bits are all outside one of the masks."""
    words = (1 << (radius + 1)) - 1
    codes = {bit: 1 + i * 11 % words for i, bit in enumerate(places)}
    return [sum(1 << bit for bit, c in codes.items() if (c & v).bit_count() % 2) for v in range(1, words + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The bit masks of the covering tables, as signed 64-bit numbers."""
    return [signed(m) for m in covering(list(range(bits)), radius)]


def second_masks(radius: int = RADIUS, bits: int = BITS) -> list[tuple[int, int, int]]:
    """(table, second table, mask as a signed number) over the bits that the table's mask leaves out."""
    out = []
    for t, m in enumerate(covering(list(range(bits)), radius)):
        out += [(t, w, signed(x)) for w, x in enumerate(covering([i for i in range(bits) if not m >> i & 1], radius))]
    return out


def spanning_links(prints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (indices) that connect what the radius connects among fingerprints: one number each, or a row of numbers."""
    left = np.arange(len(prints))
    links: list[tuple[int, int]] = []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            apart = np.bitwise_count(prints[left] ^ prints[at])
            near = (apart if apart.ndim == 1 else apart.sum(axis=1)) <= radius
            got = left[near].tolist()
            links += [(at, x) for x in got]
            queue += got
            left = left[~near]
    return links


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp bigint) of each row: the fingerprint's 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            prints = np.array([fingerprint(t, size) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], names=["doc_id", "fp"])

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id bigint, fp bigint")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """nodes (node, fp) with distinct fp: pairs (a, b) of nodes that connect whatever the radius connects."""
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks(radius))]))
    # fingerprints are distinct, so they deal evenly; each makes as many rows as there are tables
    spread = nodes.repartition(partitions(nodes.sparkSession), "fp")
    rows = spread.select("node", "fp", tables.alias("x")).select("node", "fp", "x.t", "x.k")
    buckets = rows.groupBy("t", "k").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b"), F.min("fp").alias("p"), F.max("fp").alias("q")).filter("n > 1")
    two = buckets.filter((F.col("n") == 2) & (F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= radius)).select("a", "b")
    some = rows.join(buckets.filter(f"n > 2 AND n <= {LARGE}").select("t", "k").hint("merge"), ["t", "k"]).groupBy("t", "k")
    second = F.broadcast(nodes.sparkSession.createDataFrame(second_masks(radius), "t int, w int, m bigint"))  # 31 times 31 rows
    parts = rows.join(buckets.filter(f"n > {LARGE}").select("t", "k").hint("merge"), ["t", "k"]).join(second, "t")
    large = parts.groupBy("t", "k", "w", F.col("fp").bitwiseAND(F.col("m")).alias("k2"))
    lists = [F.collect_list("node").alias("nodes"), F.collect_list("fp").alias("fps")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches):
            a, b = [], []
            for ids, prints in zip(batch.column("nodes"), batch.column("fps"), strict=True):
                ids = ids.values.to_numpy(zero_copy_only=False)
                for i, j in spanning_links(prints.values.to_numpy(zero_copy_only=False).view(np.uint64), radius):
                    a.append(ids[i])
                    b.append(ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])

    found = some.agg(*lists).select("nodes", "fps").union(large.agg(*lists).select("nodes", "fps").filter("size(nodes) > 1"))
    return two.union(found.mapInArrow(run, "a bigint, b bigint")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of each row; component_id is the least id that links reach, the row's own included."""
    prints = written(fingerprints(docs, id_col, text_col, size))
    nodes = written(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(nodes, radius))
    labels = nodes.join(found.hint("merge"), "node", "left").select(F.col("fp").alias("fp"), F.coalesce("component", "node").alias("component_id"))
    joined = prints.join(labels.hint("merge"), "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row with the least id stays. Rows with a null id stay."""
    heads = near_duplicates(docs, id_col, text_col, size, radius).filter("doc_id = component_id").select(F.col("doc_id").alias(own_prefix(docs) + "head")).distinct()
    kept = docs.filter(F.col(id_col).isNotNull()).join(heads, F.col(id_col).cast("bigint") == F.col(heads.columns[0]), "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))
