"""N-best segmentation over a SentencePiece vocabulary, and its inverse.

Of a text, white space is escaped as the vocabulary does it and the lattice of all pieces is searched in two passes: Viterbi
scores forward, then A* from the end backward, for which those scores are the exact cost of what is left, so that complete
segmentations come out best first. No piece crosses certain places (checked against the vocabulary when it is loaded), so a
text falls into segments whose lattices are independent. Their Viterbi scores, forward and backward, are worked out for many
segments at once as arrays, and remembered; they give each segment's best score and its loss to the second best. For the n
best of a text only segments whose loss is no more than the (n - 1)-th smallest can differ from their best; those are searched
by A*, and their lists are merged from left to right.

Segmentations stand in one order everywhere: by score, and equal scores by the longer of the last pieces that differ. The order
of a text's follows from those of its segments, read from the last. Scores are summed as whole numbers (of 2^-20, if they aren't
whole), so that equal ones are equal in whatever order they are summed.

A character without a piece takes its byte pieces, at a score below every piece but such placeholders. Control pieces are never used. Decoding
joins the pieces' bytes and drops the leading space that encoding put.

Defined results: null and empty texts have one segmentation, of no piece, with score 0; a text with fewer than n
segmentations gives those it has; equal scores order by the longer of the last pieces that differ; repeated rows are encoded
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.llm.common import lots

N_BEST = 3
SPACE = "▁"
REMEMBERED = 150_000
#: Characters of texts encoded together, segments solved together, and the longest segment that is solved so.
CHARS = 1_000_000
ARRAY_ROWS = 2048
ARRAY_LENGTH = 40
MULTIPLIER = 0x9E3779B97F4A7C15
SPREAD = 0xD6E8FEB86659FD93
FIRST_BITS = 18
#: Steps of one that scores are rounded to if they aren't whole; NEVER is below all sums over a segment that is solved in arrays.
UNIT = 1 << 20
NEVER = -(1 << 61)
#: Pieces with scores of this and less stand in the vocabulary only so that every text has pieces.
PLACEHOLDER = -1e8


class Tail:
    """The end of a segmentation, from a place on: its first piece and what comes after. Of two the one with the longer last differing piece comes first.

    Each knows one more end of its own (jump), far enough away that any is reached in few steps; so two are compared in a time
    that grows with the logarithm of their pieces.
    """

    __slots__ = ("after", "at", "depth", "ids", "jump")

    def __init__(self, at: int, depth: int, ids: tuple[int, ...], after: Tail | None):
        self.at, self.depth, self.ids, self.after = at, depth, ids, after
        if after is None:
            self.jump = self
        else:
            far = after.jump
            self.jump = far.jump if after.depth - far.depth == far.depth - far.jump.depth else after

    def cut(self, depth: int) -> Tail:
        """The end of so many pieces."""
        x = self
        while x.depth > depth:
            x = x.jump if x.jump.depth >= depth else x.after
        return x

    def __lt__(self, other: Tail) -> bool:
        depth = min(self.depth, other.depth)
        a, b = self.cut(depth), other.cut(depth)
        if a is b:
            return self.depth > other.depth
        while a.after is not b.after:
            if a.jump is b.jump:
                a, b = a.after, b.after
            else:
                a, b = a.jump, b.jump
        return a.at < b.at  # both end at the same place, so the one that begins earlier is longer


class Pieces:
    """A vocabulary: pieces with scores, byte pieces, and where a text may be cut."""

    def __init__(self, pieces: list[tuple[str, float, bool]]):
        """pieces: (piece, score, usable) by id; byte pieces are written <0xNN>."""
        self.ids: dict[str, tuple[int, int]] = {}
        self.bytes: list[int] = [0] * 256
        self.surface: list[bytes] = []
        scores = [s for p, s, ok in pieces if ok and not re.fullmatch("<0x[0-9A-F]{2}>", p)]
        self.unit = 1 if all(s == round(s) for s in scores) else UNIT
        self.penalty = round((min((s for s in scores if s > PLACEHOLDER), default=0.0) - 10.0) * self.unit)
        for i, (p, s, ok) in enumerate(pieces):
            if re.fullmatch("<0x[0-9A-F]{2}>", p):
                self.bytes[int(p[3:5], 16)] = i
                self.surface.append(bytes([int(p[3:5], 16)]))
                continue
            self.surface.append(p.replace(SPACE, " ").encode() if ok else b"")
            if ok:
                self.ids[p] = (i, round(s * self.unit))
        self.lengths = np.array([len(x) for x in self.surface], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.surface) or b" ", dtype=np.uint8)
        self.longest = max(map(len, self.ids), default=1)
        # the finest of these cuts that no piece crosses
        for pattern in (rf"{SPACE}*[^\W\d_]+|{SPACE}*[^\w{SPACE}]+|{SPACE}*[\d_]+|{SPACE}+", rf"{SPACE}*[^{SPACE}]+|{SPACE}+", r"(?s:.+)"):
            self.cut = re.compile(pattern)
            if all(self.cut.fullmatch(p) for p in self.ids):
                break

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        return Pieces([(model.id_to_piece(i), model.get_score(i), not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))) for i in range(n)])

    def lattice(self, text: str) -> tuple[list[list[tuple[int, int, tuple[int, ...]]]], list[int]]:
        """By end: (start, score, ids) of each edge, the longest first; by position: the best score from the start."""
        n, get, longest = len(text), self.ids.get, self.longest
        into: list[list[tuple[int, int, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        best: list = [0] + [-np.inf] * n
        for i in range(n):
            here = best[i]
            for j in range(i + 1, min(n, i + longest) + 1):
                found = get(text[i:j])
                if found is None:
                    if j > i + 1:
                        continue
                    data = text[i].encode("utf-8", "replace")
                    score, ids = self.penalty * len(data), tuple(self.bytes[b] for b in data)
                else:
                    score, ids = found[1], (found[0],)
                into[j].append((i, score, ids))
                if here + score > best[j]:
                    best[j] = here + score
        return into, best

    def n_best(self, text: str, n: int) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(score, ids, lengths of the pieces from the last) of the n best segmentations of one segment, in order, by A* from its end.

        The agenda orders ends of equal promise as whole segmentations of equal score are ordered, so they come out in order.
        A place need not be left more than n times, as no more of what follows it can be among the n best.
        """
        into, best = self.lattice(text)
        agenda: list = [(-best[-1], Tail(len(text), 0, (), None))]
        left, out = [0] * (len(text) + 1), []
        while agenda and len(out) < n:
            promise, tail = heapq.heappop(agenda)
            at = tail.at
            if left[at] == n:
                continue
            left[at] += 1
            if at == 0:
                ids: list[int] = []
                lengths: list[int] = []
                step = tail
                while step.after is not None:
                    ids += step.ids
                    lengths.append(step.after.at - step.at)
                    step = step.after
                out.append((-promise, tuple(ids), tuple(reversed(lengths))))
                continue
            done = -promise - best[at]
            for start, score, piece in into[at]:
                heapq.heappush(agenda, (-(best[start] + score + done), Tail(start, tail.depth + 1, piece, tail)))
        return out

    def decode(self, ids) -> str:
        """The text of ids: the pieces' bytes one after the other, gathered at once."""
        ids = np.asarray(ids, dtype=np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        data = self.flat[np.arange(total) + np.repeat(self.starts[ids] - ends + lengths, lengths)].tobytes()
        return data.decode("utf-8", "replace").removeprefix(" ")


class Solved:
    """Best segmentations of many segments at once."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        hashes = np.array([self._hash(p) for p in pieces.ids], dtype=np.uint64) * np.uint64(SPREAD)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        assert (np.diff(self.hashes) > 0).all(), "two pieces share a hash"
        # where the hashes with the same first bits begin, and how many at most share them
        first = (self.hashes >> np.uint64(64 - FIRST_BITS)).astype(np.int64)
        self.begin = np.searchsorted(first, np.arange(1 << FIRST_BITS)).astype(np.int32)
        self.most = int(np.bincount(first).max()) if len(first) else 0
        values = list(pieces.ids.values())
        self.ids = np.array([v[0] for v in values], dtype=np.int32)[order]
        self.scores = np.array([v[1] for v in values], dtype=np.int64)[order]

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * MULTIPLIER + ord(c) + 1) & (1 << 64) - 1
        return h

    def _look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the sorted hashes, and whether the hash is there."""
        h, last = h * np.uint64(SPREAD), len(self.hashes) - 1
        at = np.minimum(self.begin[(h >> np.uint64(64 - FIRST_BITS)).astype(np.int64)], last)
        hit = self.hashes[at] == h
        for _ in range(self.most - 1):
            more = np.minimum(at + ~hit, last)
            at = more
            hit = self.hashes[at] == h
        return at, hit

    def __call__(self, segments: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Segments in groups with, of each, the best score, its pieces, the loss to the second best, and all ids of the best segmentations one after the other."""
        by_length: dict[int, list[str]] = {}
        for s in segments:
            by_length.setdefault(len(s), []).append(s)
        for length, group in by_length.items():
            if length > ARRAY_LENGTH:
                for s in group:
                    two = self.pieces.n_best(s, 2)
                    loss = two[0][0] - two[1][0] if len(two) > 1 else -NEVER
                    yield [s], np.array([two[0][0]]), np.array([len(two[0][1])]), np.array([loss]), np.array(two[0][1], dtype="<i4")
                continue
            for at in range(0, len(group), ARRAY_ROWS):
                part = group[at : at + ARRAY_ROWS]
                yield part, *self._solve(part, length)

    def _solve(self, group: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n, longest = len(group), min(self.pieces.longest, length)
        codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(n, length).T.astype(np.uint64) + np.uint64(1)
        edges, found = {}, {}  # by piece length, for those that are found: scores and ids, by start and segment
        h = np.zeros((length, n), dtype=np.uint64)
        for size in range(1, longest + 1):
            h = h[: length - size + 1] * np.uint64(MULTIPLIER) + codes[size - 1 :]
            at, hit = self._look_up(h)
            if size > 1 and not hit.any():
                continue
            score, ids = np.where(hit, self.scores[at], NEVER), np.where(hit, self.ids[at], -1)
            if size == 1:
                point = codes - np.uint64(1)
                width = 1 + (point > 0x7F).astype(int) + (point > 0x7FF) + (point > 0xFFFF)
                score = np.where(hit, score, self.pieces.penalty * width)
            edges[size], found[size] = score, ids
        sizes = sorted(edges, reverse=True)
        ahead, taken = np.full((length + 1, n), NEVER), np.zeros((length + 1, n), dtype=np.int64)
        ahead[0] = 0
        for j in range(1, length + 1):
            for size in sizes:
                if size > j:
                    continue
                cost = ahead[j - size] + edges[size][j - size]
                better = cost > ahead[j]
                ahead[j][better] = cost[better]
                taken[j][better] = size
        behind = np.full((length + 1, n), NEVER)
        behind[length] = 0
        for i in range(length - 1, -1, -1):
            for size in sizes:
                if size <= length - i:
                    np.maximum(behind[i], edges[size][i] + behind[i + size], out=behind[i])
        # the best segmentation, from its end; by start, the length of its piece there
        best_ids, count = np.full((n, length), -1, dtype="<i4"), np.zeros(n, dtype=np.int64)
        where, on_path = np.full((n, length), -1, dtype=np.int64), np.zeros((length, n), dtype=np.int64)
        rows, end = np.arange(n), np.full(n, length)
        while len(rows):
            size = taken[end, rows]
            start = end - size
            count[rows] += 1
            where[rows, length - count[rows]] = start
            on_path[start, rows] = size
            more = start > 0
            rows, end = rows[more], start[more]
        second = np.full(n, NEVER)
        for size in sizes:
            score = ahead[: length - size + 1] + edges[size] + behind[size:]
            mine = on_path[: length - size + 1] == size
            score[mine] = NEVER
            np.maximum(second, score.max(axis=0), out=second)
            start, row = np.nonzero(mine)
            on_path[start, row] = -2 - found[size][start, row]  # done with: the id, -1 for none, as a number below zero
        begins = on_path.T != 0
        best_ids[np.arange(length) >= length - count[:, None]] = (-2 - on_path.T)[begins]
        loss = np.where(second > NEVER // 2, ahead[length] - second, -NEVER)
        odd = np.flatnonzero(((best_ids < 0) & (where >= 0)).any(axis=1)).tolist()
        if odd:  # characters without a piece take their bytes' pieces
            rows = [best_ids[k, length - count[k] :] for k in range(n)]
            for k in odd:
                full: list[int] = []
                for i, at in zip(rows[k].tolist(), where[k, length - count[k] :].tolist(), strict=True):
                    full += [i] if i >= 0 else [self.pieces.bytes[b] for b in group[k][at].encode("utf-8", "replace")]
                rows[k] = np.array(full, dtype="<i4")
                count[k] = len(full)
            return ahead[length], count, loss, np.concatenate(rows)
        return ahead[length], count, loss, best_ids[np.arange(length) >= length - count[:, None]]


class Segmenter:
    """n-best segmentations of texts, with what is known of segments kept for the texts to come."""

    def __init__(self, pieces: Pieces, n: int):
        self.pieces, self.n = pieces, n
        self.solved = Solved(pieces)
        self.searched: dict[str, list[tuple[int, int, np.ndarray]]] = {}
        self._forget()

    def _forget(self) -> None:
        """By number of a segment: score, pieces and loss of its best segmentation, and where its ids begin in ids."""
        self.known: dict[str, int] = {}
        self.scores = self.counts = self.losses = self.starts = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype="<i4")

    def segments(self, text: str | None) -> list[str]:
        return self.pieces.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode_all(self, texts: list[str | None]) -> Iterator[list[tuple[float, np.ndarray, int]]]:
        """For each text (score, ids as little-endian 32-bit numbers, pieces) of its n best segmentations."""
        split = [self.segments(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self._forget()
        if len(self.searched) > REMEMBERED:
            self.searched.clear()
        self._learn(list(set().union(*split).difference(self.known)))
        for segments in split:
            yield self._merge(segments)

    def _learn(self, segments: list[str]) -> None:
        names, columns = [], [[self.scores], [self.counts], [self.losses], [self.ids]]
        for group, *found in self.solved(segments):
            names += group
            for column, x in zip(columns, found, strict=True):
                column.append(x)
        self.scores, self.counts, self.losses, self.ids = (np.concatenate(x) for x in columns)
        self.starts = np.cumsum(self.counts) - self.counts
        self.known.update(zip(names, range(len(self.known), len(self.known) + len(names)), strict=True))

    def encode(self, text: str | None) -> list[tuple[float, np.ndarray, int]]:
        return next(self.encode_all([text]))

    def _search(self, segment: str) -> list[tuple[int, int, np.ndarray]]:
        """(loss, place among the n by the longer last differing piece, ids) of the n best, in order."""
        found = self.searched.get(segment)
        if found is None:
            best = self.pieces.n_best(segment, self.n)
            by = sorted(range(len(best)), key=lambda i: [-x for x in best[i][2]])
            place = {i: p for p, i in enumerate(by)}
            found = self.searched[segment] = [(best[0][0] - s, place[i], np.array(ids, dtype="<i4")) for i, (s, ids, _) in enumerate(best)]
        return found

    def _near(self, segments: list[str], losses: np.ndarray) -> list[int]:
        """The segments that can differ from their best in one of the n best, in order."""
        n = self.n
        if len(losses) <= n - 1:
            return list(range(len(losses)))
        limit = int(np.partition(losses, n - 2)[n - 2])
        below, tied = np.flatnonzero(losses < limit).tolist(), np.flatnonzero(losses == limit).tolist()
        if len(below) + len(tied) <= 2 * n:
            return sorted(below + tied)
        if limit == 0:
            # all of the n best are ties, and what leaves its best only in segments before another's comes before it
            return tied[: n - 1]
        # of the n best at most one tied segment differs. If the difference puts it later, n - 1 of them further left come before
        # it; if it puts it earlier, n - 1 of them further right do.
        later, earlier = [], []
        for at in tied:
            found = self._search(segments[at])
            if len(later) < n - 1 and any(loss == limit and place > found[0][1] for loss, place, _ in found[1:]):
                later.append(at)
            if any(loss == limit and place < found[0][1] for loss, place, _ in found[1:]):
                earlier.append(at)
        return sorted({*below, *later, *earlier[len(earlier) - n + 1 if len(earlier) >= n else 0 :]})

    def _merge(self, segments: list[str]) -> list[tuple[float, np.ndarray, int]]:
        if not segments:
            return [(0.0, self.ids[:0], 0)]
        rows = np.fromiter(map(self.known.__getitem__, segments), dtype=np.int64, count=len(segments))
        counts = self.counts[rows]
        ends = np.cumsum(counts)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.starts[rows] - ends + counts, counts)]
        scores = self.scores[rows]
        base = int(scores.sum()) if self.pieces.unit == 1 else sum(scores.tolist())
        if self.n == 1:
            return [(base / self.pieces.unit, ids, len(ids))]
        # best first, the n best of the segments so far: (loss, the segments that aren't at their best, from the last, and which of theirs they take)
        now: list[tuple[int, tuple]] = [(0, ())]
        for at in self._near(segments, self.losses[rows]):
            found = self._search(segments[at])
            grown = sorted((loss + found[j][0], found[j][1], rank, j) for rank, (loss, _) in enumerate(now) for j in range(len(found)))[: self.n]
            now = [(loss, ((at, j), now[rank][1]) if j else now[rank][1]) for loss, _, rank, j in grown]
        out = []
        for loss, picks in now:
            parts, right = [], len(ids)
            while picks:
                (at, j), picks = picks
                parts += [ids[ends[at] : right], self.searched[segments[at]][j][2]]
                right = ends[at] - counts[at]
            mine = np.concatenate([ids[:right], *reversed(parts)]) if parts else ids
            out.append(((base - loss) / self.pieces.unit, mine, len(mine)))
        return out


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, decoded: bool = False) -> DataFrame:
    """(doc_id, rank, score, n_pieces, ids binary: little-endian 32-bit) of the n best segmentations of each row; decoded: and what decode() makes of the ids, in the same pass."""
    path = model_path or vocabulary_path()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(Pieces.load(path), n)
        for batch in lots(batches):
            texts, lo = batch.column("text").to_pylist(), 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and size < CHARS:
                    size += len(texts[hi] or "")
                    hi += 1
                rows = [(i, rank, *x) for i, found in enumerate(segmenter.encode_all(texts[lo:hi]), lo) for rank, x in enumerate(found, 1)]
                columns = {"doc_id": batch.column("doc_id").take(pa.array([r[0] for r in rows], type=pa.int64())), "rank": pa.array([r[1] for r in rows], type=pa.int32()), "score": pa.array([r[2] for r in rows], type=pa.float64()), "n_pieces": pa.array([r[4] for r in rows], type=pa.int64()), "ids": pa.array([r[3].tobytes() for r in rows], type=pa.binary())}
                if decoded:
                    columns["decoded"] = pa.array([segmenter.pieces.decode(r[3]) for r in rows], type=pa.string())
                yield pa.RecordBatch.from_pydict(columns)
                lo = hi

    return source.mapInArrow(run, f"doc_id {kind}, rank int, score double, n_pieces bigint, ids binary{', decoded string' * decoded}")


def decode(encoded: DataFrame, ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """The columns of encoded with decoded: the text of its ids (null ids: null)."""
    path = model_path or vocabulary_path()
    source = encoded.drop("decoded") if ids_col != "decoded" else encoded
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(path)
        for batch in lots(batches):
            texts = [None if x is None else pieces.decode(np.frombuffer(x, dtype="<i4")) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, type=pa.string())], names=[*batch.schema.names, "decoded"])

    return source.mapInArrow(run, f"{kinds}, decoded string")
