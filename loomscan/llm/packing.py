"""Sum-of-squares packing of tokenised documents into fixed windows.

Each document is tokenised, an end token follows it, and whole windows are cut off. The rest of it is placed online: of all
fill levels that still hold it, into the one that makes the sum of squared counts of partially filled windows smallest. The
counts are a level array. Every partition packs its own rows, so nothing is shuffled. Windows that no document has completed
when a partition ends can't be completed online: they fill each other (their pieces are marked as settled), and the single
window then left is cut into windows whose lengths are powers of two, which need no padding. A partition holds the ids of its
open windows, in two bytes each where they fit; they are fewer than the tokens of one input partition, which
spark.sql.files.maxPartitionBytes bounds.

Defined results: null text counts as empty (its one token is the end token); repeated rows are packed as often as they come;
an empty table gives no rows; other columns of the input are ignored; a null id stays null.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.llm.common import lots

CAPACITY = 1024


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def byte_bpe(ranks_path: str, json_path: str):
    """A function from a text to its ids: the ranks encode, and the tokenizer of the JSON file stands in where that fails."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        try:
            return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
        except (KeyboardInterrupt, SystemExit, MemoryError):
            raise
        except BaseException:  # the encoder's engine panics on some extreme runs; its panics aren't plain exceptions
            return np.asarray(json_tokenizer(json_path).encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


@lru_cache(maxsize=2)
def json_tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


class LevelPacker:
    """Online packing by the sum of squares; pieces are (key, start, ids, doc_tokens), windows lists of pieces."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}

    def choose(self, size: int) -> int:
        """The fill level (0: a new window) whose use gives the least sum of squares; ties go to the fullest."""
        top = self.capacity - size
        have, then = self.levels[: top + 1], self.levels[size:]
        cost = 2 * (then - have) + 2
        cost[top] -= 2 * then[top] + 1  # a full window leaves the array
        usable = have > 0
        if top:
            cost[0] = 2 * then[0] + 1
        else:
            cost[0] = 0
        usable[0] = True
        cost[~usable] = np.iinfo(np.int64).max
        return int(top - np.argmin(cost[::-1]))

    def add(self, key, ids: np.ndarray) -> Iterator[list]:
        """Place one document; yields the windows that are full now."""
        total, whole = len(ids), len(ids) // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            yield [(key, at, ids[at : at + self.capacity], total)]
        if whole == total:
            return
        size, rest = total - whole, ids[whole:]
        level = self.choose(size)
        window = self._take(level) if level else []
        window.append((key, whole, rest.astype(np.uint16 if rest.max() < 1 << 16 else np.uint32), total))
        if level + size == self.capacity:
            yield window
        else:
            self._put(level + size, window)

    def _take(self, level: int) -> list:
        self.levels[level] -= 1
        return self.open[level].pop()

    def _put(self, level: int, window: list) -> None:
        self.levels[level] += 1
        self.open.setdefault(level, []).append(window)

    def settle(self) -> Iterator[list]:
        """Open windows fill each other: the emptiest ones are cut to complete the fullest. One window at most stays open."""
        queue = [[level, w] for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open = {}
        self.levels[:] = 0
        low, high = len(queue) - 1, 0
        while high < low:
            level, window = queue[high]
            while level < self.capacity and high < low:
                gap = self.capacity - level
                key, start, ids, total = queue[low][1].pop()
                if len(ids) > gap:
                    queue[low][1].append((key, start, ids[:-gap], total))
                    start, ids = start + len(ids) - gap, ids[-gap:]
                window.append((key, start, ids, total))
                level += len(ids)
                queue[low][0] -= len(ids)
                if not queue[low][0]:
                    low -= 1
            queue[high][0] = level
            if level == self.capacity:
                yield window
                high += 1
        if high == low and queue[high][0]:
            level, window = queue[high]
            if level == self.capacity:
                yield window
            else:
                self._put(level, window)

    def finish(self) -> Iterator[list]:
        """Settle, then cut the last window into windows of power-of-two lengths."""
        yield from self.settle()
        for level, windows in self.open.items():
            pieces, left = list(windows[0]), level
            while left:
                size = 1 << (left.bit_length() - 1)
                left -= size
                window, have = [], 0
                while have < size:
                    key, start, ids, total = pieces.pop(0)
                    if len(ids) > size - have:
                        pieces.insert(0, (key, start + size - have, ids[size - have :], total))
                        ids = ids[: size - have]
                    window.append((key, start, ids, total))
                    have += len(ids)
                yield window
        self.open = {}
        self.levels[:] = 0


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, ranks_path: str | None = None, json_path: str | None = None) -> DataFrame:
    """One row per piece: id, start in the document, length, ids (packed little-endian unsigned 32-bit), tokens of the document, sequence, offset in it, tokens of the sequence, whether the sequence was settled at a partition's end."""
    ranks_path = ranks_path or vocabulary_path()
    json_path = json_path or vocabulary_path("byte_bpe_50k.json")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = byte_bpe(ranks_path, json_path), LevelPacker(capacity)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        end, id_type = np.array([end_id], dtype="<u4"), None
        rows: list[tuple] = []

        def flush():
            cols = list(zip(*rows, strict=True)) or [()] * 9
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            out = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "settled"])
            rows.clear()
            return out

        def emit(windows, settled=False):
            nonlocal sequence
            for window in windows:
                tokens, offset = sum(len(p[2]) for p in window), 0
                for key, start, ids, total in window:
                    rows.append((key, start, len(ids), ids.astype("<u4").tobytes(), total, sequence, offset, tokens, settled))
                    offset += len(ids)
                sequence += 1

        for batch in lots(batches):
            id_type = batch.schema.field("doc_id").type
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                emit(packer.add(key, np.concatenate([encode(text), end]) if text else end))
                if len(rows) >= 2000:
                    yield flush()
        if id_type is not None:
            emit(packer.finish(), True)
            yield flush()

    return source.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_tokens bigint, settled boolean")
