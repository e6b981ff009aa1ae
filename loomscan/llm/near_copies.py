"""Removal of near copies: SimHash with covering tables finds the candidates, the Jaccard similarity of whole sets decides.

Two texts are near copies if the sets of their shingles have a Jaccard similarity of at least the threshold. A bit of their
SimHash fingerprints differs with probability acos(2J / (1 + J)) / pi, 0.15 at 0.8, so that radius 4 over 64 bits is far too
narrow. A fingerprint has 1,024 bits here, in 32 parts of 32 bits. Each part has its own covering family of radius 2, 7 masks (see
simhash). Two fingerprints within 95 bits differ in at most 2 bits of some part, so that they always meet in one of the 224 tables
(95 bits: Jaccard 0.92). Beyond that meeting is likely instead of certain: a pair at exactly 0.8 is missed with probability
2e-4, one at 0.85 with 2e-6. What meets is a candidate only within 40 of the first 128 bits, 5 standard deviations above the mean of
a pair at 0.8. Texts that share nothing pass that once in 100,000, so that their links grow with the square of the texts and join
ever larger groups by chance. Only links within 24 of these bits, 7 standard deviations below such texts' mean, are sure enough to
stand; a wider one also has to be within 220 of all 1,024 bits, 6 standard deviations above the mean of a pair at 0.8 (152) and 18
below that of texts that share nothing (512). Nothing is a near copy by its fingerprint alone: every link is checked over the two
whole sets.

Equal sets collapse to one node before the tables. Rows of a table's bucket stand side by side in a task, sorted. In a bucket of up
to RUN nodes all are compared, in a larger one a search drops what it has linked, and in one that goes on beyond an Arrow batch
with more than LARGE nodes all link to its first node, compared or not: links are only candidates, so none is lost. A task thins
its sure links to spanning forests, each node with the least one that it reaches there, so that links grow with its rows and not with
the pairs of a large group, and drops wider ones inside a tree. What these links connect is a group. A group of up to GROUP nodes meets in one task, which compares whole sets and drops what it has linked, so it emits fewer links than the group has members. In a larger group
each node is first compared with the least one, in blocks; only those that aren't alike to it are then compared with all the
group, block by block, again with fewer links than the two blocks have members, which tasks thin to forests too. So no task holds
more than two blocks, and no pair that could link two components is left out. Components of the checked links follow by distributed star steps.

Defined results: ids are whole numbers; shingles stand as 64-bit hashes of lower-case words; fewer words than a shingle has give
one shingle of them all; null and empty texts have none and are copies of each other only; rows are told apart by id and text,
so another text under the same id is a document of its own; of each component the row with the least id stays (then the least
hash of its text), once if it is repeated; rows with a null id stay; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.llm import simhash
from loomscan.llm.common import NULL_KEY, drop_shuffles, lots, own_prefix, row_key, written
from loomscan.llm.components import components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
SEED = 42
#: Words of 64 bits of a fingerprint; bits of a part, and the radius that its tables cover.
WORDS = 16
PART_BITS = 32
PART_RADIUS = 2
#: The first words, and the bits of them in which what is linked may differ.
CHECK_WORDS = 2
CHECK_RADIUS = 40
#: Within how many of these bits a link needs no further check of fingerprints, and in how many of all bits others may differ.
SURE_RADIUS = 24
WHOLE_RADIUS = 220
#: A bucket of more nodes is searched instead of compared pair by pair; one of which more than LARGE would be held for the next batch links to its first node.
RUN = 64
LARGE = 4096
#: Nodes of a group that meet in one task, and nodes of a block of a larger group.
GROUP = 1000
GROUP_BLOCK = 500
#: Links that a task holds before it thins them; what is left of them goes out if it is more than half.
HELD = 1 << 20
#: Shingles whose bits are counted at once, as many as a byte can count.
BLOCK = 255

#: Nodes at the ends of links, and which of the links are sure.
Link = tuple[np.ndarray, np.ndarray, np.ndarray]


def shingles(text: bytes | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order of size."""
    found = (text or b"").lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if n <= size:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=n) + 1)
    begin = [0, *ends[: n - size].tolist()]
    stop = (ends[size - 1 :] - 1).tolist()
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begin, stop, strict=True)), dtype=np.uint64, count=n - size + 1))


def fingerprint(found: np.ndarray, n_words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The SimHash of distinct shingle hashes, in words of 64 bits: each word takes its bits from hashes of its own."""
    salts = np.random.default_rng(seed).integers(0, 1 << 64, size=n_words, dtype=np.uint64)
    counts = np.zeros(64 * n_words, dtype=np.int64)
    for at in range(0, len(found), BLOCK):
        x = found[at : at + BLOCK, None] ^ salts
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
        counts += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(found), bitorder="little").view("<u8")


def keys(prints: np.ndarray) -> np.ndarray:
    """prints (rows, words): the key of each row in each table, which holds the table's number and the bits that its mask keeps."""
    masks = np.array(simhash.covering(list(range(PART_BITS)), PART_RADIUS), dtype=np.uint64)
    parts = prints.view(f"<u{PART_BITS // 8}").astype(np.uint64)[:, :, None] & masks
    tables = np.arange(parts.shape[1] * len(masks), dtype=np.uint64) << np.uint64(PART_BITS)
    return parts.reshape(len(prints), -1) | tables


def meetings(k: np.ndarray, nodes: np.ndarray, prints: np.ndarray) -> list[Link]:
    """Rows in order of k, prints as wide as what is checked: links that connect what has equal k and is within SURE_RADIUS, and pairs within CHECK_RADIUS that these leave apart."""
    links = []
    begin = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    sizes = np.diff(np.r_[begin, len(k)])
    few = np.repeat(sizes <= RUN, sizes)
    for d in range(1, RUN):
        at = np.flatnonzero((k[d:] == k[:-d]) & few[d:])
        if not len(at):
            break
        bits = np.bitwise_count(prints[at] ^ prints[at + d]).sum(axis=1)
        at, bits = at[bits <= CHECK_RADIUS], bits[bits <= CHECK_RADIUS]
        links.append((nodes[at], nodes[at + d], bits <= SURE_RADIUS))
    for first, n in zip(begin[sizes > RUN].tolist(), sizes[sizes > RUN].tolist(), strict=True):
        own, mine = nodes[first : first + n], prints[first : first + n]
        found = np.array(simhash.spanning_links(mine, SURE_RADIUS), dtype=np.int64).reshape(-1, 2)
        links.append((own[found[:, 0]], own[found[:, 1]], np.ones(len(found), dtype=bool)))
        tree = reached(np.arange(n), forest([(found[:, 0], found[:, 1])]))
        largest = np.bincount(tree).argmax()
        for i in np.flatnonzero(tree != largest).tolist():  # of two trees one is not the largest
            at = np.flatnonzero((np.bitwise_count(mine ^ mine[i]).sum(axis=1) <= CHECK_RADIUS) & (tree != tree[i]))
            links.append((own[at], np.full(len(at), own[i]), np.zeros(len(at), dtype=bool)))
    return links


def forest(links: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least nodes): links that connect what the links connect, one of each node but the least that it reaches."""
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def reached(nodes: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least node that each node reaches in a forest."""
    if not len(found[0]):
        return nodes
    at = np.minimum(np.searchsorted(found[0], nodes), len(found[0]) - 1)
    return np.where(found[0][at] == nodes, found[1][at], nodes)


def thin(links: Iterable[Link]) -> Iterator[pa.RecordBatch]:
    """Links (a, b, sure), a > b: forests of the sure ones as in forests, and each of the others whose ends they leave apart, of what is held at a time."""

    def batch(trees: tuple[np.ndarray, np.ndarray], wide: np.ndarray) -> pa.RecordBatch:
        a, b = np.concatenate([trees[0], wide[:, 0]]), np.concatenate([trees[1], wide[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.arange(len(a)) < len(trees[0]))], names=["a", "b", "sure"])

    def thinned(sure: list[tuple[np.ndarray, np.ndarray]], wide: list[np.ndarray]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        trees, rows = forest(sure), np.concatenate(wide)
        rows = rows[reached(rows[:, 0], trees) != reached(rows[:, 1], trees)]
        return trees, np.unique(rows, axis=0)

    none = np.zeros(0, dtype=np.int64)
    start = lambda: ([(none, none)], [none.reshape(0, 2)], 0)
    sure, wide, n = start()
    for a, b, flag in links:
        if len(a):
            sure.append((a[flag], b[flag]))
            wide.append(np.stack([np.maximum(a, b)[~flag], np.minimum(a, b)[~flag]], axis=1))
            n += len(a)
        if n > HELD:
            trees, rows = thinned(sure, wide)
            sure, wide, n = [trees], [rows], len(trees[0]) + len(rows)
            if 2 * n > HELD:
                yield batch(trees, rows)
                sure, wide, n = start()
    if n:
        yield batch(*thinned(sure, wide))


def forests(links: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that connect what all the links connect, in forests of what is held at a time."""
    held, n = [], 0
    for link in links:
        if len(link[0]):
            held.append(link)
            n += len(link[0])
        if n > HELD:
            held = [forest(held)]
            n = len(held[0][0])
            if 2 * n > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["a", "b"])
                held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(held)], names=["a", "b"])


def spanning_links(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links (indices) that connect what the similarity connects; sets are compared whole."""
    links: list[tuple[int, int]] = []
    if not sets:
        return links
    sizes = np.array([len(x) for x in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    mine = [flat[b - n : b] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    marks = np.zeros(len(flat), dtype=bool)
    left, owner = np.ones(len(sets), dtype=bool), np.repeat(np.arange(len(sets)), sizes)
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first], queue = False, [first]
        while queue:
            at = queue.pop()
            keep = left[owner]
            if 2 * keep.sum() < len(keep):
                flat, owner = flat[keep], owner[keep]
            marks[mine[at]] = True
            shared = np.bincount(owner[marks[flat]], minlength=len(sets))
            marks[mine[at]] = False
            near = np.flatnonzero(left & (shared > 0) & (shared >= similarity * (sizes + sizes[at] - shared) - 1e-9)).tolist()
            left[near] = False
            links += [(at, x) for x in near]
            queue += near
    return links


def candidates(nodes: DataFrame) -> DataFrame:
    """nodes (node, print): links (a, b) that connect the nodes that meet in a table and are within the checked radii."""
    checks = [f"c{i}" for i in range(CHECK_WORDS)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches):
            prints = np.frombuffer(b"".join(batch.column("print").to_pylist()), dtype="<u8").reshape(batch.num_rows, -1)
            k = keys(prints)
            columns = [k.reshape(-1), np.repeat(batch.column("node").to_numpy(), k.shape[1])]
            columns += [np.repeat(prints[:, i], k.shape[1]) for i in range(CHECK_WORDS)]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], names=["k", "node", *checks])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[Link]:
        held = np.zeros((0, 2 + CHECK_WORDS), dtype=np.int64)  # rows of the last key, which the next batch may go on with
        hub = None  # (key, first node) of a bucket that is too large to hold
        for batch in batches:
            now = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
            if hub:
                n = int(np.searchsorted(now[:, 0], hub[0], side="right"))
                yield now[:n, 1], np.full(n, hub[1]), np.ones(n, dtype=bool)
                now, hub = now[n:], hub if n == len(now) else None
            if not len(now):
                held = now
                continue
            last = int(np.searchsorted(now[:, 0], now[-1, 0]))
            held, now = now[last:].copy(), now[:last]
            yield from meetings(now[:, 0], now[:, 1], now[:, 2:].view(np.uint64))
            if len(held) > LARGE:
                hub = (held[0, 0], held[0, 1])
                yield held[1:, 1], np.full(len(held) - 1, hub[1]), np.ones(len(held) - 1, dtype=bool)
                held = held[:0]
        yield from meetings(held[:, 0], held[:, 1], held[:, 2:].view(np.uint64))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from thin(met(batches))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u8").reshape(batch.num_rows, -1) for c in ("p", "q"))
            near = np.bitwise_count(one ^ two).sum(axis=1) <= WHOLE_RADIUS
            yield batch.select(["a", "b"]).filter(pa.array(near))

    schema = "k bigint, node bigint, " + ", ".join(f"{c} bigint" for c in checks)
    rows = nodes.select("node", "print").mapInArrow(deal, schema).repartition("k").sortWithinPartitions("k")
    found = written(rows.mapInArrow(meet, "a bigint, b bigint, sure boolean"))
    drop_shuffles(nodes.sparkSession)
    sure, wide = (found.filter(x).select("a", "b").distinct() for x in ("sure", "NOT sure"))
    one, two = nodes.select(F.col("node").alias("a"), F.col("print").alias("p")), nodes.select(F.col("node").alias("b"), F.col("print").alias("q"))
    checked = wide.hint("merge").join(one, "a").hint("merge").join(two, "b").select("a", "b", "p", "q").mapInArrow(within, "a bigint, b bigint")
    return sure.union(checked).distinct()


def _links(texts: DataFrame, groups: DataFrame, size: int, similarity: float) -> DataFrame:
    """texts (node, component, text), one of a node: links (a, b) of nodes that connect what the similarity connects in each component."""
    read = lambda column: [shingles(t, size) for t in column.cast(pa.binary()).to_pylist()]

    def linked(ids: np.ndarray, found: list[tuple[int, int]]) -> pa.Table:
        return pa.table({"a": pa.array([ids[i] for i, _ in found], type=pa.int64()), "b": pa.array([ids[j] for _, j in found], type=pa.int64())})

    def check(table: pa.Table) -> pa.Table:
        return linked(table.column("node").to_numpy(), spanning_links(read(table.column("text")), similarity))

    def with_least(table: pa.Table) -> pa.Table:
        """The nodes of a block and what of them is alike to the component's least node."""
        nodes, least = table.column("node").to_numpy(), table.column("component")[0].as_py()
        sets = read(table.column("text"))
        first = sets[int(np.flatnonzero(nodes == least)[0])]
        alike = []
        for x in sets:
            shared = len(np.intersect1d(x, first, assume_unique=True))
            alike.append(shared > 0 and shared >= similarity * (len(x) + len(first) - shared) - 1e-9)
        return pa.table({"node": pa.array(nodes), "component": pa.array(np.full(len(nodes), least)), "alike": pa.array(alike)})

    counts = groups.groupBy("component").agg(F.count("*").alias("n"))
    sized = written(texts.join(counts, "component"))  # once, as all texts are dealt for it
    drop_shuffles(texts.sparkSession)
    small = sized.filter(F.col("n") <= GROUP).groupBy("component").applyInArrow(check, "a bigint, b bigint")
    large = sized.filter(F.col("n") > GROUP)
    if large.isEmpty():
        return small
    n_blocks = F.ceil(F.col("n") / GROUP_BLOCK).cast("int")
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    others = large.filter("node <> component").withColumn("block", place(n_blocks))
    least = large.filter("node = component").withColumn("block", every(n_blocks))
    alike = written(others.unionByName(least).groupBy("component", "block").applyInArrow(with_least, "node bigint, component bigint, alike boolean"))
    near = alike.filter("alike AND node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    far = alike.filter("NOT alike").groupBy("component", "node").agg(F.lit(1).alias("__far")).select("component", "node")
    n_far = far.groupBy("component").agg(F.count("*").alias("n_far"))
    rest = large.join(n_far, "component").withColumn("far_blocks", F.ceil(F.col("n_far") / GROUP_BLOCK).cast("int"))
    whole = rest.select("component", "node", "text", every(F.col("far_blocks")).alias("u"), place(n_blocks).alias("g"))
    apart = rest.join(far, ["component", "node"], "left_semi").select("component", "node", "text", place(F.col("far_blocks")).alias("u"), n_blocks.alias("__n")).select("component", "node", "text", "u", every(F.col("__n")).alias("g"))

    def across(table: pa.Table) -> pa.Table:
        nodes, at = np.unique(table.column("node").to_numpy(), return_index=True)
        return linked(nodes, spanning_links(read(table.column("text").take(pa.array(at))), similarity))

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from forests((x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches)

    found = whole.unionByName(apart).groupBy("component", "u", "g").applyInArrow(across, "a bigint, b bigint")
    return small.union(near).union(found.mapInArrow(thinned, "a bigint, b bigint"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, row, component_id, component_row) of each row; component_id and component_row tell the least row that links reach, its own included. row: see row_key."""
    source = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    drop_shuffles(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches):
            sets = [shingles(t, size) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            same = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], type=pa.binary())
            prints = pa.array([fingerprint(x).tobytes() for x in sets], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("row"), same, prints], names=["key", "row", "shingles", "print"])

    signed = written(source.mapInArrow(sign, "key bigint, row bigint, shingles binary, print binary"))
    distinct = signed.filter(F.col("key") > NULL_KEY).groupBy("shingles").agg(F.min(F.struct("key", "row")).alias("head"), F.first("print").alias("print"))
    nodes = written(distinct.withColumn("node", F.monotonically_increasing_id()))  # numbered once, as it is written
    groups = written(components(candidates(nodes)))
    wanted = nodes.join(groups, "node").select("node", "component", "head.key", "head.row")
    texts = wanted.join(source, ["key", "row"]).dropDuplicates(["key", "row"]).select("node", "component", "text")
    found = components(_links(texts, groups, size, similarity))
    labels = nodes.select("shingles", "node", "head").join(found, "node", "left").withColumn("label", F.coalesce("component", "node"))
    heads = labels.groupBy("label").agg(F.min("head").alias("first"))
    joined = signed.select("key", "row", "shingles").join(labels.join(heads, "label").select("shingles", "first"), "shingles", "left")
    own = F.col("key") > NULL_KEY
    return joined.select(F.when(own, F.col("key")).alias("doc_id"), "row", F.when(own, F.col("first.key")).alias("component_id"), F.when(own, F.col("first.row")).alias("component_row"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs without near copies: of each component the row with the least id stays. Rows with a null id stay."""
    found = near_copies(docs, id_col, text_col, size, similarity)
    k, r = (own_prefix(docs) + x for x in ("key", "row"))
    heads = found.filter("doc_id = component_id AND row = component_row").select(F.col("doc_id").alias(k), F.col("row").alias(r)).distinct()
    key, row = row_key(id_col, text_col)
    keyed = docs.select("*", key.alias(k), row.alias(r))
    kept = keyed.filter(F.col(k) > NULL_KEY).join(heads, [k, r], "left_semi").dropDuplicates([k, r])
    return kept.unionByName(keyed.filter(F.col(k) == NULL_KEY)).drop(k, r)
