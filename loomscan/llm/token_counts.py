"""Token counts that follow edits.

A document's pre-tokens (the pieces that a byte-level vocabulary encodes one by one) lie in leaves of a segment tree; every
node holds the characters and tokens below it. An edit finds its leaves by descending on characters, splits anew only from a
little before it (three characters, as far as the splitting pattern looks ahead) up to the first place where new and old
pieces end together, counts those pieces and updates the sums on the paths above. The rest keeps its counts.

Defined results: null texts count as empty, with no tokens; edits of a document apply in order, each to the text as the ones
before left it, and places beyond its ends are clipped; repeated rows are counted each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.llm.common import lots
from loomscan.llm.packing import byte_bpe, vocabulary_path

#: Pieces in one leaf, and characters before an edit on which the split of what follows can depend.
LEAF = 64
CONTEXT = 3
Edit = tuple[int, int, str]


class PieceCounts(dict):
    """Tokens of a piece, counted once while it is remembered."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        if len(self) > 300_000:
            self.clear()
        n = self[piece] = len(self.encode(piece))
        return n


class DocumentTree:
    def __init__(self, text: str, split: Callable[[str], list[str]], counts: PieceCounts, leaf: int = LEAF):
        self.split, self.counts = split, counts
        pieces = split(text)
        self.leaves = [pieces[i : i + leaf] for i in range(0, len(pieces), leaf)] or [[]]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars = np.zeros(2 * self.size, dtype=np.int64)
        self.tokens = np.zeros(2 * self.size, dtype=np.int64)
        self.recounted = 0
        at = np.arange(0, max(len(pieces), 1), leaf)
        if pieces:
            self.chars[self.size : self.size + len(at)] = np.add.reduceat(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)), at)
            self.tokens[self.size : self.size + len(at)] = np.add.reduceat(np.array([counts[p] for p in pieces], dtype=np.int64), at)
        level = self.size
        while level > 1:
            half = level >> 1
            for sums in (self.chars, self.tokens):
                sums[half:level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
            level = half

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character (the last leaf with any for the end of the text, the first for an empty one) and where it starts."""
        if not self.chars[1]:
            return 0, 0
        node, start = 1, 0
        char = max(0, min(char, int(self.chars[1]) - 1))
        while node < self.size:
            node *= 2
            if char - start >= self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node - self.size, start

    def _update(self, leaf: int) -> None:
        node = leaf + self.size
        self.chars[node] = sum(map(len, self.leaves[leaf]))
        self.tokens[node] = sum(self.counts[p] for p in self.leaves[leaf])
        while node > 1:
            node >>= 1
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters [start, end) by new."""
        total = int(self.chars[1])
        start = max(0, min(start, total))
        end = max(start, min(end, total))
        first, offset = self._leaf_at(start - CONTEXT)
        pieces = self.leaves[first]
        keep, at = 0, offset
        while keep < len(pieces) and at + len(pieces[keep]) <= start - CONTEXT:
            at += len(pieces[keep])
            keep += 1
        head, last = pieces[:keep], first
        # old pieces from at on, up to the end of the edit and then leaf by leaf until the ends agree
        old = pieces[keep:]
        reach = at + sum(map(len, old))
        while reach < end and last + 1 < len(self.leaves):
            last += 1
            old = old + self.leaves[last]
            reach += int(self.chars[last + self.size])
        while True:
            joined = "".join(old)
            fresh = joined[: start - at] + new + joined[end - at :]
            shift = len(new) - (end - start)
            more = last + 1
            while more < len(self.leaves) and not self.leaves[more]:
                more += 1
            final = more >= len(self.leaves)
            ahead = "" if final else "".join(self.leaves[more])
            made = self.split(fresh + ahead)
            ends = set()
            p = at
            for x in old:
                p += len(x)
                if p >= end:
                    ends.add(p + shift)
            if end == at and not old:
                ends.add(at + shift)
            p, cut = at, None
            for i, x in enumerate(made):
                if p in ends and p >= start + len(new):
                    cut = i
                    break
                p += len(x)
            if cut is None and final:
                cut, p = len(made), at + len(fresh)
            if cut is not None:
                break
            last = more
            old = old + self.leaves[last]
        rest, q = [], at + shift
        for i, x in enumerate(old):
            if q >= p and q - shift >= end:
                rest = old[i:]
                break
            q += len(x)
        self.recounted += cut
        self.leaves[first] = head + made[:cut] + (rest if last == first else [])
        for leaf in range(first + 1, last):
            self.leaves[leaf] = []
        if last != first:
            self.leaves[last] = rest
        for leaf in range(first, last + 1):
            self._update(leaf)


_PRIVATE = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\b\d(?:[ -]?\d){6,}\b")


def redactions(text: str) -> list[Edit]:
    """Edits that mask addresses and long numbers and delete lines equal to an earlier one, last place first."""
    edits: list[Edit] = [(m.start(), m.end(), "<masked>") for m in _PRIVATE.finditer(text)]
    seen: set[str] = set()
    lines: list[tuple[int, int]] = []
    at = 0
    for line in text.split("\n"):
        end = at + len(line)
        if line.strip():
            if line in seen:
                lines.append((at, min(end + 1, len(text))))
            seen.add(line)
        at = end + 1
    i, starts = 0, [a for a, _ in lines]
    kept = []
    for e in edits:
        while i < len(lines) and lines[i][1] <= e[0]:
            i += 1
        if i >= len(lines) or e[1] <= starts[i]:
            kept.append(e)
    return sorted([*kept, *((a, b, "") for a, b in lines)], reverse=True)


def count_tokens(docs: DataFrame, edits: Callable[[str], list[Edit]] | None = redactions, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None, ranks_path: str | None = None, json_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_after, n_pieces, n_recounted, edited_text) of each row. Edits come from a column of structs (start, end, new), or from a function of the text."""
    ranks_path, json_path = ranks_path or vocabulary_path(), json_path or vocabulary_path("byte_bpe_50k.json")
    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")] + ([F.col(edits_col).alias("edits")] if edits_col else [])
    source = docs.select(*columns)
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ["n_tokens", "n_edits", "n_tokens_after", "n_pieces", "n_recounted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from public_tokenizers import PATTERN

        split, counts = regex.compile(PATTERN).findall, PieceCounts(byte_bpe(ranks_path, json_path))
        for batch in lots(batches):
            out: list[tuple] = []
            texts = batch.column("text").to_pylist()
            given = [[(e["start"], e["end"], e["new"] or "") for e in x or ()] for x in batch.column("edits").to_pylist()] if edits_col else None
            for i, text in enumerate(texts):
                text = text or ""
                tree = DocumentTree(text, split, counts)
                before, pieces = tree.total, sum(map(len, tree.leaves))
                todo = given[i] if given is not None else edits(text) if edits else []
                for e in todo:
                    tree.edit(*e)
                out.append((before, len(todo), tree.total, pieces, tree.recounted, tree.text() if todo else text))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, type=pa.int64()) for c in cols[:5]), pa.array(cols[5], type=pa.string())], names=["doc_id", *names, "edited_text"])

    return source.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names) + ", edited_text string")
