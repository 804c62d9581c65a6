"""Packing of tokenised documents into sequences, shortest pack first over the length histogram.

Documents are tokenised and cut at multiples of ``size``; full cuts are
sequences of their own.  The histogram of the remainders (at most ``size - 1``
lengths, so bounded whatever the corpus) is packed on the driver: lengths are
placed longest first, each into the packs with the smallest total that still
have room, and equal packs are kept as one pattern with a count.  Patterns are
joined back to documents by rank: the r-th document of a length takes the
r-th slot of that length.  Ranks come from per-partition counters and a
prefix sum over partitions, never from one global sort.

So the algorithm decides every placement; what it can't decide is how to use
the room that is left.  Patterns with more than ``max_gap`` of a sequence
empty are filled, fullest first, with the documents of the emptiest patterns:
only those are cut, at the binary digits of their length, and as many as the
room needs.  ``Plan.cut_share`` says how many that are.  Pieces that remain
are powers of two and fill sequences of their own, but for the last one.

Defined cases: null text is empty and is one end-of-document id; texts are
tokenised whole; repeated rows and equal ids are packed row by row; extra
columns are ignored; an empty table gives no pieces; documents of the same
length take their places in the order in which they are read.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _util

_SPECIAL = "<|endoftext|>"


class _Blanks(Exception):
    """A space before another blank: cutting there could part a pre-token."""


class ByteTokenizer:
    """Ids of the public byte-level BPE as little-endian 32-bit words.

    A space that follows a non-blank always starts a pre-token, so text is cut
    at spaces and the ids of a chunk are cached (the cache is bounded); texts
    with a space before another blank, or special strings, are encoded whole.
    """

    def __init__(self, path: str, max_chunks: int = 800_000):
        self.path, self.slow = path, None
        self.max_chunks, self.cache = max_chunks, {}
        self.fast = self._ranks(path)

    def _ranks(self, path: str):
        """The same vocabulary through the faster rank-file library, where its file stands beside."""
        import base64
        import os

        import public_tokenizers
        import tiktoken

        beside = os.path.splitext(path)[0] + ".tiktoken"
        if not os.path.exists(beside):
            return None
        with open(beside, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bytes:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _fast(self, text: str) -> bytes:
        return array("I", self.fast.encode_ordinary(text)).tobytes()

    def _miss(self, chunk: str) -> bytes:
        """Ids of a space and the chunk after it."""
        if not chunk or chunk[0].isspace():
            raise _Blanks
        got = self._fast(" " + chunk)
        if len(chunk) <= 64:
            if len(self.cache) >= self.max_chunks:
                self.cache.clear()
            self.cache[chunk] = got
        return got

    def encode(self, text: str) -> bytes:
        if _SPECIAL in text or self.fast is None:
            return self.plain(text)
        first, *rest = text.split(" ")
        get, miss = self.cache.get, self._miss
        try:
            return self._fast(first) + b"".join([get(c) or miss(c) for c in rest])
        except _Blanks:
            return self._fast(text)


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Shortest-pack-first: ``(lengths of a pack, number of such packs)``, from length -> count."""
    by_total: dict[int, list[list]] = defaultdict(list)
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left = counts[length]
        while left:
            total = min((t for t, p in by_total.items() if p and t + length <= size), default=None)
            if total is None:
                # one pack opened at a time, and filled before the next is: so many full ones, and the rest
                k = size // length
                if left >= k:
                    by_total[k * length].append([(length,) * k, left // k])
                if left % k:
                    by_total[left % k * length].append([(length,) * (left % k), 1])
                break
            pattern, count = by_total[total].pop()
            used = min(left, count)
            if count > used:
                by_total[total].append([pattern, count - used])
            by_total[total + length].append([(*pattern, length), used])
            left -= used
    return [(tuple(p), c) for packs in by_total.values() for p, c in packs]


class Plan:
    """Where the r-th piece of each length goes; sizes depend on ``size`` alone."""

    def __init__(self, counts: dict[int, int], size: int, max_gap: float):
        self.size = size
        self.base = 0
        rest = {n: c for n, c in counts.items() if 0 < n < size}
        whole, open_ = [], []
        for pattern, count in pack_histogram(rest, size):
            total = sum(pattern)
            full = size - total <= max_gap * size or total & (total - 1) == 0
            (whole if full else open_).append((pattern, count))
        filled, cut, left = self._fill(sorted(open_, key=lambda p: (-sum(p[0]), p)), int(max_gap * size))
        #: share of the documents' last pieces that are cut once more
        self.cut_share = sum(len(p) * c for p, c in cut) / max(1, sum(rest.values()))
        #: length -> rows (first rank, sequence of the first, offset); cuts have the first ranks of the digits instead
        self.slots: dict[int, list[list[int]]] = defaultdict(list)
        self.cuts: dict[int, list[list[int]]] = defaultdict(list)
        self.halves: dict[int, list[list[int]]] = defaultdict(list)
        ranks: dict[int, int] = defaultdict(int)
        used: dict[int, int] = defaultdict(int)
        self._place(whole, self.slots, ranks)
        for pattern, digits, count in filled:
            base = self.base
            self._place([(pattern, count)], self.slots, ranks)
            self.base = base
            self._place([(digits, count)], self.halves, used, sum(pattern))
        digit: dict[int, int] = defaultdict(int)
        for pattern, count in cut:
            for length in pattern:
                row = [ranks[length]]
                for b in range(size.bit_length()):
                    row.append(digit[b])
                    digit[b] += count if length >> b & 1 else 0
                self.cuts[length].append(row)
                ranks[length] += count
        self._place(pack_histogram(left, size), self.halves, used)
        self.first_full = self.base

    def _fill(self, packs: list, slack: int) -> tuple[list, list, dict[int, int]]:
        """``(pattern, digits, count)`` filled, ``(pattern, count)`` cut, and the digits that remain.

        ``packs`` are in order of their totals; the last ones are cut to fill
        the first.  A group of packs is handled at once, so the steps don't
        grow with counts.
        """
        packs = [[p, sum(p), c] for p, c in packs]
        pool: dict[int, int] = defaultdict(int)
        filled, cut = [], []

        def dissolve(pack: list, k: int) -> None:
            cut.append((pack[0], k))
            pack[2] -= k
            for length in pack[0]:
                for b in range(length.bit_length()):
                    if length >> b & 1:
                        pool[1 << b] += k

        first, last = 0, len(packs) - 1
        while first <= last:
            pack = packs[first]
            pattern, total, count = pack
            if not count:
                first += 1
                continue
            gap, digits, room = self.size - total, [], self.size - total
            for d in sorted((d for d, n in pool.items() if n), reverse=True):
                k = min(room // d, pool[d])
                digits += [d] * k
                room -= d * k
            if room <= slack:
                k = min([count, *(pool[d] // digits.count(d) for d in set(digits))])
                for d in digits:
                    pool[d] -= k
                filled.append((pattern, tuple(digits), k))
                pack[2] -= k
                continue
            missing = gap * count - sum(d * n for d, n in pool.items())
            if missing > 0 and last > first:
                if not packs[last][2]:
                    last -= 1
                else:
                    dissolve(packs[last], min(packs[last][2], -(-missing // packs[last][1])))
            elif missing > 0 and count > 1:  # the last group fills itself
                dissolve(pack, min(count - 1, max(1, -(-missing // self.size))))
            else:  # its digits don't fit the room
                dissolve(pack, count)
        return filled, cut, {d: n for d, n in pool.items() if n}

    def _place(self, patterns, slots, ranks, offset: int = 0) -> None:
        for pattern, count in patterns:
            at = offset
            for length in pattern:
                slots[length].append([ranks[length], self.base, at])
                ranks[length] += count
                at += length
            self.base += count

    @staticmethod
    def _find(rows: list[list[int]], rank: int) -> list[int]:
        import bisect

        return rows[bisect.bisect_right(rows, rank, key=lambda r: r[0]) - 1]

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """``(start within the piece, length, sequence, offset)`` of every part."""
        if length == self.size:
            return [(0, length, self.first_full + rank, 0)]
        whole = self.slots.get(length)
        cuts = self.cuts.get(length)
        if cuts and rank >= cuts[0][0]:
            row, at, out = self._find(cuts, rank), 0, []
            for b in reversed(range(length.bit_length())):
                if length >> b & 1:
                    r = row[1 + b] + rank - row[0]
                    slot = self._find(self.halves[1 << b], r)
                    out.append((at, 1 << b, slot[1] + r - slot[0], slot[2]))
                    at += 1 << b
            return out
        slot = self._find(whole, rank)
        return [(0, length, slot[1] + rank - slot[0], slot[2])]


_PIECES = "doc_id {kind}, start long, length int, doc_tokens long, crcs array<long>, part int, local_rank long"


def _pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, size: int, end_id: int) -> DataFrame:
    """Pieces cut at multiples of ``size``; ``crcs`` holds that of the piece and those of its binary cuts."""
    kind = dict(docs.dtypes)[id_col]
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        tok = _tokenizer(tokenizer)
        for batch in batches:
            rows, start, length, total, crcs, rank = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = tok.encode(text.as_py() or "") + end
                n = len(ids) // 4
                for a in range(0, n, size):
                    piece = ids[4 * a : 4 * (a + size)]
                    m = len(piece) // 4
                    rows.append(i)
                    start.append(a)
                    length.append(m)
                    total.append(n)
                    own, at = [zlib.crc32(piece)], 0
                    if m < size:
                        for b in reversed(range(m.bit_length())):
                            if m >> b & 1:
                                own.append(zlib.crc32(piece[4 * at : 4 * (at + (1 << b))]))
                                at += 1 << b
                    crcs.append(own)
                    rank.append(seen[m])
                    seen[m] += 1
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(total, pa.int64()),
                        pa.array(crcs, pa.list_(pa.int64())), pa.array([part] * len(rows), pa.int32()), pa.array(rank, pa.int64()),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "crcs", "part", "local_rank"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, _PIECES.format(kind=kind))


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 1024,
    end_id: int = 0,
    max_gap: float = 0.01,
) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = docs.sparkSession
    pieces = _util.materialise(_pieces(docs, id_col, text_col, tokenizer, size, end_id))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    bases = counts.select(F.col("part").alias("p"), F.col("length").alias("l"), before.alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    plan = spark.sparkContext.broadcast(Plan(histogram, size, max_gap))
    ranked = pieces.join(bases, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l"))).select(
        "doc_id", "start", "length", "doc_tokens", "crcs", (F.col("base") + F.col("local_rank")).alias("rank")
    )

    def run(batch):
        p = plan.value
        rows, start, length, crc, seq, off = [], [], [], [], [], []
        starts, lengths, crcs, ranks = (batch.column(k).to_pylist() for k in (1, 2, 4, 5))
        for i in range(batch.num_rows):
            parts = p.place(lengths[i], ranks[i])
            for k, (at, n, s, o) in enumerate(parts):
                rows.append(i)
                start.append(starts[i] + at)
                length.append(n)
                crc.append(crcs[i][0 if len(parts) == 1 else 1 + k])
                seq.append(s)
                off.append(o)
        take = pa.array(rows, pa.int64())
        return batch.column(0).take(take), start, length, crc, batch.column(3).take(take), seq, off

    kind = dict(docs.dtypes)[id_col]
    return _util.arrow_map(ranked, run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long")
