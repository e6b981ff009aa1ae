"""Exact removal of repeated word windows, by super-k-mer partitioning.

A window is k consecutive words. Its minimiser is the least hash of the m-word runs in it; consecutive windows that share one
make a super-k-mer, whose words travel as one packed string to the bucket of the minimiser. Equal windows have equal
minimisers, so a bucket sees all places of its windows; there it sorts them, compares equal hashes word by word, and returns
the places of all windows but the first. Each task sends a string once, with its first place: a later place of the same
string in the task is a repeat for certain and skips the bucket, so what a bucket gets of one string is bounded by the number
of tasks, however many documents hold it. Strings for one bucket travel together, compressed.

A minimiser can be frequent in strings that differ, such as a phrase that a third of all documents hold in other contexts. The
windows of such hot minimisers travel one by one to the bucket of their own hash, which deals them evenly. Which minimisers are
hot is read from a sample of rows; every task uses the same list, so equal windows meet whatever the sample says, and results
don't depend on it.

Marks are kept by row, told by the id and a hash of the text, so rows that repeat an id with another text are judged by what
they hold. Defined results: ids are whole numbers; null and empty texts have no words; texts shorter than a window keep all
words; "earlier" compares (id, word position), a null id before all others, so of equal places in rows that share an id none is
earlier; an empty table gives no rows; columns named like the added ones are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.llm.common import lots, own_prefix, partitions, row_key, written

WINDOW_WORDS = 20
MINIMISER_WORDS = 4
#: Buckets for each shuffle partition, and bytes of strings that a task gathers before it sends them.
BUCKETS_PER_PARTITION = 8
GATHER_BYTES = 24 << 20
#: How hard strings and places are compressed.
LEVEL = 5
#: One row in so many is sampled for hot minimisers: those with more than HOT_SHARE of a partition's share of all strings, and at least HOT_LEAST.
SAMPLE_ROWS = 64
HOT_LEAST = 20
HOT_SHARE = 0.25
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_FOUND = pa.schema([("key", pa.int64()), ("row", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _numbered(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of the words whose separators stand at ends, and the words (with a separator) that the numbers stand for."""
    offsets = np.concatenate([[0], ends + 1]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


class Texts:
    """The words of many texts: one buffer in which each word is followed by one space, and a hash of each word."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        before = np.concatenate([[True], space[:-1]])
        last = np.flatnonzero(space & ~before)
        ends_of_texts = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1) - 1
        #: Where the words of text i begin among all words: first[i] to first[i + 1].
        self.first = np.concatenate([[0], np.searchsorted(last, ends_of_texts, side="right")])
        data = raw[~(space & before)].copy()
        ends = np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)))
        data[ends] = 32
        self.data = data.tobytes()
        #: Where each word begins in data.
        self.at = np.concatenate([[0], ends + 1])
        if len(ends):
            numbers, words = _numbered(data, ends)
            self.hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), dtype=np.uint64, count=len(words))[numbers]
        else:
            self.hashes = np.zeros(0, dtype=np.uint64)


def super_kmers(hashes: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each super-k-mer of a text's word hashes (at least k)."""
    runs = len(hashes) - m + 1
    grams = np.zeros(runs, dtype=np.uint64)
    for j in range(m):
        grams = grams * _ODD + hashes[j : j + runs]
    grams = _mixed(grams)
    view = np.lib.stride_tricks.sliding_window_view(grams, k - m + 1)
    at = view.argmin(axis=1)
    at += np.arange(len(at))
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return first, np.diff(np.append(first, len(at))), grams[at[first]]


def single_windows(first: np.ndarray, count: np.ndarray, least: np.ndarray, hot: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers with those of hot minimisers (in order) taken apart: each of their windows stands alone, under its own hash."""
    apart = np.isin(least, hot)
    if not apart.any():
        return first, count, least
    times = np.where(apart, count, 1)
    place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    starts, apart_now = np.repeat(first, times) + place, np.repeat(apart, times)
    counts, under = np.where(apart_now, 1, np.repeat(count, times)), np.repeat(least, times)
    own = np.zeros(int(apart_now.sum()), dtype=np.uint64)
    for j in range(k):
        own = own * _ODD + hashes[starts[apart_now] + j]
    under[apart_now] = _mixed(own)
    return starts, counts, under


def merged(keys: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """Intervals of words, with those that touch or overlap inside a row as one."""
    order = np.lexsort((starts, rows, keys))
    keys, rows, starts, ends = keys[order], rows[order], starts[order], ends[order]
    if len(keys):
        other = np.ones(len(keys), dtype=bool)
        other[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
        # how far the intervals of a row reach so far: rows are told apart by shifting each beyond the one before
        shift = np.cumsum(other) * (int(ends.max()) + 1)
        reach = np.maximum.accumulate(ends + shift)
        new = other.copy()
        new[1:] |= starts[1:] + shift[1:] > reach[:-1]
        head = np.flatnonzero(new)
        keys, rows, starts, ends = keys[head], rows[head], starts[head], np.maximum.reduceat(ends, head)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, rows, starts, ends)], schema=_FOUND)


def repeats(contents: list[bytes], keys: np.ndarray, rows: np.ndarray, starts: np.ndarray, k: int) -> pa.RecordBatch:
    """The intervals covered by windows whose words also start earlier, among the strings of a bucket."""
    data = np.frombuffer(b"\n".join(contents) + b"\n", dtype=np.uint8).copy()
    ends = np.flatnonzero((data == 32) | (data == 10))
    last = np.flatnonzero(data[ends] == 10)
    lengths = np.diff(np.concatenate([[-1], last]))
    data[ends] = 32
    ids, words = _numbered(data, ends)
    hashes = _mixed((np.arange(1, len(words) + 1, dtype=np.uint64)) * _ODD)[ids]
    powers = np.multiply.accumulate(np.full(len(ids), _ODD))
    inverse = np.multiply.accumulate(np.full(len(ids), _INVERSE))
    hashes *= powers
    del powers, data
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes, dtype=np.uint64)])
    base = np.cumsum(lengths) - lengths
    counts = lengths - k + 1
    owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = base[owner] + inside
    value = (sums[at + k] - sums[at]) * inverse[at]
    del hashes, inverse, sums
    order = np.argsort(value, kind="stable")
    equal = value[order[1:]] == value[order[:-1]]
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    some = order[twice]
    if not len(some):
        return merged(*[np.zeros(0, dtype=np.int64)] * 4)
    group, key, start = value[some], keys[owner[some]], starts[owner[some]] + inside[some]

    def firsts(group):
        order = np.lexsort((start, key, group))
        g = group[order]
        new = np.ones(len(g), dtype=bool)
        new[1:] = g[1:] != g[:-1]
        return order, order[np.flatnonzero(new)[np.cumsum(new) - 1]]

    def same(order, first):
        for lo in range(0, len(order), 1 << 16):
            a, b = at[some[order[lo : lo + (1 << 16)]]], at[some[first[lo : lo + (1 << 16)]]]
            if any((ids[a + j] != ids[b + j]).any() for j in range(k)):
                return False
        return True

    order, first = firsts(group)
    if not same(order, first):  # two windows share a hash: compare by the words themselves
        spelled = ids[at[some][:, None] + np.arange(k)]
        order, first = firsts(np.unique(spelled, axis=0, return_inverse=True)[1].reshape(-1).astype(np.uint64))
    later = (key[order] != key[first]) | (start[order] != start[first])
    got = order[later]
    return merged(key[got], rows[owner[some[got]]], start[got], start[got] + k)


def hot_minimisers(source: DataFrame, k: int, m: int) -> np.ndarray:
    """Minimisers, in order, that a sample of rows (key, row, text) holds more often than a shuffle partition's share."""
    share = partitions(source.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches):
            texts, found = Texts(batch.column("text").cast(pa.binary()).to_pylist()), Counter()
            for lo, hi in zip(texts.first[:-1].tolist(), texts.first[1:].tolist(), strict=True):
                if hi - lo >= k:
                    found.update(super_kmers(texts.hashes[lo:hi], k, m)[2].view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), type=pa.int64()), pa.array(list(found.values()), type=pa.int64())], names=["h", "n"])

    sample = source.filter((F.pmod(F.xxhash64("key", "row"), F.lit(SAMPLE_ROWS)) == 0) & F.col("text").isNotNull())
    sums = written(sample.mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")))
    total = sums.select("n").agg(F.sum("n")).first()[0] or 0
    rows = sums.filter(F.col("n") >= max(HOT_LEAST, HOT_SHARE * total / share)).select("h").collect()  # no more than four for each partition
    return np.sort(np.array([r["h"] for r in rows], dtype=np.int64).view(np.uint64))


def repeated_intervals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW_WORDS, m: int = MINIMISER_WORDS) -> DataFrame:
    """(key, row, s, e): word intervals [s, e) to remove from the rows with that key and row (see row_key)."""
    spark = docs.sparkSession
    n_buckets = BUCKETS_PER_PARTITION * partitions(spark)
    sent_schema = "bucket int, packed binary, places binary, done binary"
    source = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    hot = hot_minimisers(source, k, m)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, list]] = {}
        done, gathered = [], 0
        packer = zstandard.ZstdCompressor(level=LEVEL)

        def flush() -> pa.RecordBatch:
            by: dict[int, list] = {}
            for content, (bucket, places) in seen.items():
                by.setdefault(bucket, []).extend((content, place) for place in places)
            rows = [(b, packer.compress(b"\n".join(x[0] for x in xs)), packer.compress(np.array([x[1] for x in xs], dtype=np.int64).T.tobytes()), b"") for b, xs in by.items()]
            if done:
                parts = merged(*np.array(done, dtype=np.int64).T)
                rows.append((abs(int(done[0][1])) % n_buckets, b"", b"", np.array([parts.column(i).to_numpy() for i in range(4)]).tobytes()))
            seen.clear()
            done.clear()
            cols = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(cols[0], type=pa.int32()), *(pa.array(c, type=pa.binary()) for c in cols[1:])], names=["bucket", "packed", "places", "done"])

        for batch in lots(batches):
            texts = Texts([x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()])
            data, at = texts.data, texts.at
            for key, row, lo, hi in zip(batch.column("key").to_pylist(), batch.column("row").to_pylist(), texts.first[:-1].tolist(), texts.first[1:].tolist(), strict=True):
                if hi - lo < k:
                    continue
                first, count, least = super_kmers(texts.hashes[lo:hi], k, m)
                if len(hot):
                    first, count, least = single_windows(first, count, least, hot, texts.hashes[lo:hi], k)
                begin, end = at[lo + first].tolist(), (at[lo + first + count + k - 1] - 1).tolist()
                for s, n, a, b, bucket in zip(first.tolist(), count.tolist(), begin, end, (least % np.uint64(n_buckets)).tolist(), strict=True):
                    content = data[a:b]
                    old = seen.get(content)
                    if old is None:
                        seen[content] = (bucket, [(key, row, s)])
                        gathered += b - a
                        continue
                    old_key, _, old_s = old[1][0]
                    if (key, s) < (old_key, old_s):
                        done += [(*place, place[2] + n + k - 1) for place in old[1]]
                        seen[content] = (bucket, [(key, row, s)])
                    elif (key, s) > (old_key, old_s):
                        done.append((key, row, s, s + n + k - 1))
                    elif (key, row, s) not in old[1]:  # the same place of another row with the id
                        old[1].append((key, row, s))
                if gathered > GATHER_BYTES or len(done) > 200_000:
                    yield flush()
                    gathered = 0
        if seen or done:
            yield flush()

    def bucket(table: pa.Table) -> pa.Table:
        opener, contents, places, out = zstandard.ZstdDecompressor(), [], [], []
        for packed, place, done in zip(*(table.column(c).to_pylist() for c in ("packed", "places", "done")), strict=True):
            if done:
                out.append(pa.RecordBatch.from_arrays([pa.array(x) for x in np.frombuffer(done, dtype=np.int64).reshape(4, -1)], schema=_FOUND))
            if packed:
                contents.append(opener.decompress(packed))
                places.append(np.frombuffer(opener.decompress(place), dtype=np.int64).reshape(3, -1))
        if contents:
            out.append(repeats(contents, *np.concatenate(places, axis=1), k))
        return pa.Table.from_batches(out, schema=_FOUND)

    return source.mapInArrow(send, sent_schema).groupBy("bucket").applyInArrow(bucket, "key bigint, row bigint, s bigint, e bigint")


def without(text: bytes, drop: np.ndarray) -> bytes:
    """The text without the words marked; what parts kept neighbours stays, a gap becomes a line end if it held one, else a space."""
    spans = [m.span() for m in _WORD.finditer(text)]
    keep = np.flatnonzero(~drop)
    if not len(keep):
        return b""
    out, end = [], None
    for run in np.split(keep, np.flatnonzero(np.diff(keep) > 1) + 1):
        a, b = spans[run[0]][0], spans[run[-1]][1]
        if end is not None:
            out.append(b"\n" if b"\n" in text[end:a] else b" ")
        out.append(text[a:b])
        end = b
    return b"".join(out)


ADDED = ["n_words", "n_removed", "kept_text"]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW_WORDS, m: int = MINIMISER_WORDS) -> DataFrame:
    """The columns of docs with n_words, n_removed and kept_text (null text: empty)."""
    docs = docs.drop(*[c for c in ADDED if c != text_col])
    key_col, row_col, marks_col = (own_prefix(docs) + x for x in ("key", "row", "marks"))
    marks = repeated_intervals(docs, id_col, text_col, k, m).groupBy(F.col("key").alias(key_col), F.col("row").alias(row_col)).agg(F.collect_list(F.struct("s", "e")).alias(marks_col))
    key, row = row_key(id_col, text_col)
    joined = docs.select("*", key.alias(key_col), row.alias(row_col)).join(marks, [key_col, row_col], "left").drop(key_col, row_col)
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches):
            total, gone, kept = [], [], []
            for text, marks in zip(batch.column(text_col).cast(pa.binary()).to_pylist(), batch.column(marks_col).to_pylist(), strict=True):
                text = text or b""
                n, drop = len(text.split()), None
                if marks:
                    drop = np.zeros(n, dtype=bool)
                    for x in marks:
                        drop[x["s"] : x["e"]] = True
                total.append(n)
                gone.append(0 if drop is None else int(drop.sum()))
                kept.append((text if drop is None else without(text, drop)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(total, type=pa.int64()), pa.array(gone, type=pa.int64()), pa.array(kept, type=pa.string())], names=[*names, *ADDED])

    return joined.mapInArrow(apply, f"{kinds}, n_words bigint, n_removed bigint, kept_text string")
