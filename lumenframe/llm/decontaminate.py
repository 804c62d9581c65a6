"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items.  Words of the items are
numbered, windows are offsets into one array of those numbers, and a document
is searched as numbers, too.  For every pattern length ``m`` a block of
``B = min(2, m)`` words is hashed into the shift table, whose cell holds the
least shift of the blocks that fall into it: a block that no pattern contains
lets the scan skip ``m - B + 1`` words, a word that no item contains lets it
skip ``m``.  A zero shift selects the run of windows that end in that block
and begin with the words in question (suffix and prefix hash), and a direct
comparison with the words of the document confirms an occurrence.

A block of items is bounded by what its tables take, building included, from
counts of words that are measured before.  Blocks are searched one after the
other, each in a job of its own; every worker builds the tables of a block once
and drops those of the block before.

Defined cases: null or wordless text has no words and no hits; an item with
fewer words than the window is a single window; an item with null text or no
words has none; a null item id is ignored; equal windows of several items
report all of those items; an empty benchmark hits nothing; an empty table
gives no rows; repeated rows are judged one by one.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import _util

#: ASCII upper case becomes lower case; other ASCII than letters and digits separates words; the rest stays.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a whole text, as UTF-8."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


#: Multipliers of the shift table's hash, and the greatest size of the table.
_P, _Q, _MOST = 0x9E3779B1, 0x85EBCA6B, 1 << 24


class WuManber:
    """Search of many windows of one length ``m``; words are numbers from 1, 0 is an unknown word."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, owners: np.ndarray, m: int):
        """``words``: all numbers in one array; ``starts``: where windows begin; ``owners``: the item of each."""
        self.m, self.block = m, min(2, m)
        self.default = m - self.block + 1
        w = words.astype(np.int64)
        self.text = words.astype("<i4").tobytes()
        suffix, prefix = self._pair(w, starts + m - self.block), self._pair(w, starts)
        # equal windows become neighbours: one entry each, with the items that have it
        rows = np.stack([words[starts + k] for k in range(m)], axis=1) if len(starts) else np.zeros((0, m), np.int32)
        order = np.lexsort([owners, *[rows[:, k] for k in reversed(range(m))], prefix, suffix])
        rows, owners, starts, suffix, prefix = rows[order], owners[order], starts[order], suffix[order], prefix[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        fresh = new.copy()
        fresh[1:] |= owners[1:] != owners[:-1]
        group = (np.cumsum(new) - 1)[fresh]
        self.owners = array("i", owners[fresh].astype(np.int32).tobytes())
        self.owned = array("i", np.searchsorted(group, np.arange(len(first) + 1)).astype(np.int32).tobytes())
        self.first = array("i", starts[first].astype(np.int32).tobytes())
        self.suffix = array("q", suffix[first].tobytes())
        self.prefix = array("q", prefix[first].tobytes())
        size = 1 << 10
        while size < min(_MOST, 8 * m * max(1, len(first))):
            size <<= 1
        self.mask = size - 1
        shift = np.full(size, self.default, np.uint8)
        for end in range(self.block, m + 1):
            pair = self._pair(w, starts[first] + end - self.block)
            np.minimum.at(shift, self._cell(pair >> 32, pair & 0xFFFFFFFF), np.uint8(m - end))
        self.shift = shift.tobytes()

    def _pair(self, w: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (w[at] << 32) | w[at + 1] if self.block == 2 else w[at] << 32

    def _cell(self, a, b):
        return ((a * _P) ^ (b * _Q)) & self.mask

    def search(self, w: array, raw: bytes):
        """Yields (start, index of the window) of every occurrence; ``raw`` are the bytes of ``w``."""
        m, default, shift, mask, two = self.m, self.default, self.shift, self.mask, self.block == 2
        suffix, prefix, first, text = self.suffix, self.prefix, self.first, self.text
        end, n = m, len(w)
        while end <= n:
            b = w[end - 1]
            if not b:
                end += m
                continue
            if two:
                a = w[end - 2]
                if not a:
                    end += default
                    continue
                s = shift[((a * _P) ^ (b * _Q)) & mask]
                key = a << 32 | b
            else:
                s = shift[(b * _P) & mask]
                key = b << 32
            if s:
                end += s
                continue
            low = bisect_left(suffix, key)
            if low < len(suffix) and suffix[low] == key:
                high = bisect_right(suffix, key, low)
                head = w[end - m] << 32 | w[end - m + 1] if two else key
                low = bisect_left(prefix, head, low, high)
                while low < high and prefix[low] == head:
                    at = first[low]
                    if text[4 * at : 4 * (at + m)] == raw[4 * (end - m) : 4 * end]:
                        yield end - m, low
                        break  # windows differ from each other
                    low += 1
            end += 1


class Searcher:
    """The tables of one block of items, for all window lengths that occur."""

    def __init__(self, items: list[tuple], window: int):
        number: dict[bytes, int] = {}
        text, self.names = array("i"), []
        by_length: dict[int, tuple[list[np.ndarray], list[int]]] = {}
        for item_id, item in items:
            if item_id is None or not (w := words(item)):
                continue
            size, at = min(window, len(w)), len(text)
            text.extend([number.setdefault(x, len(number) + 1) for x in w])
            starts, own = by_length.setdefault(size, ([], []))
            starts.append(np.arange(at, at + len(w) - size + 1))
            own.append(len(self.names))
            self.names.append(str(item_id))
        self.number = number
        every = np.frombuffer(text, np.int32) if len(text) else np.zeros(0, np.int32)
        self.searchers = [
            WuManber(every, np.concatenate(starts), np.repeat(np.array(own), [len(s) for s in starts]), m)
            for m, (starts, own) in sorted(by_length.items())
        ]

    def find(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Occurrence intervals (merged, end exclusive) and item ids."""
        get = self.number.get
        ids = array("i", [get(x, 0) for x in w])
        raw = ids.tobytes()
        spans, found = [], set()
        for s in self.searchers:
            for start, k in s.search(ids, raw):
                spans.append((start, start + s.m))
                found.update(s.owners[s.owned[k] : s.owned[k + 1]])
        return _merge(spans), {self.names[i] for i in found}


#: The tables that this worker built last.
_BUILT: dict[str, Searcher] = {}


def _built(block: str, rows, window: int) -> Searcher:
    if block not in _BUILT:
        _BUILT.clear()
        _BUILT[block] = Searcher(rows.value, window)
    return _BUILT[block]


#: Bytes that building the tables takes at most: for each word of the items, for each distinct word, and in any case.
WORD_BYTES, DISTINCT_BYTES, FIXED_BYTES = 200, 240, 20 << 20


def table_size(words: int, distinct: int, blocks: int = 1) -> int:
    """Upper bound of a worker's memory for one of so many equal blocks of items."""
    own = -(-words // blocks)
    return FIXED_BYTES + WORD_BYTES * own + DISTINCT_BYTES * min(distinct, own)


def blocks_needed(words: int, distinct: int, table_bytes: int) -> int:
    """The least number of blocks whose tables are within the bound."""
    low, high = 1, 1
    while table_size(words, distinct, high) > max(table_bytes, FIXED_BYTES + WORD_BYTES + DISTINCT_BYTES) and high < max(1, words):
        low, high = high, high * 2
    while low < high:
        mid = (low + high) // 2
        if table_size(words, distinct, mid) > table_bytes:
            low = mid + 1
        else:
            high = mid
    return max(1, min(high, words))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    table_bytes: int = 1 << 28,
    carry: bool = False,
) -> DataFrame:
    """Word spans of benchmark windows in every document.

    Returns ``id_col, n_words, hits array<struct<start,end>> (word positions,
    merged), items array<string>`` and, with ``carry``, the other columns of
    ``docs``.  The benchmark is the stated pattern set.  Its words and distinct
    words are counted first, and it is searched in blocks of items whose
    tables take at most about ``table_bytes`` in a worker, building included.
    One block is one map over the documents; several are a job each, so that
    a worker never holds the tables of two.  Documents are not shuffled.
    """
    bench = benchmark.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("item_text"))
    bench = bench.where("item_id is not null and item_text is not null")
    each = bench.select(F.explode(F.split("item_text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).alias("w"))
    size = each.agg(F.count("*").alias("words"), F.count_distinct("w").alias("distinct")).first()
    n_blocks = blocks_needed(size["words"], size["distinct"], table_bytes)
    out_cols = docs.columns if carry else [id_col]
    work = docs.select(*out_cols, *([] if text_col in out_cols else [text_col]))
    if n_blocks == 1:
        found = _searched(work, _sent(bench), text_col, window, list(work.columns), keep_all=True)
    else:
        found = _by_blocks(work, bench, n_blocks, text_col, window)
    return found.select(*out_cols, F.col("__n").alias("n_words"), F.col("__h").alias("hits"), F.col("__i").alias("items"))


def _sent(block: DataFrame):
    """The items of a block, broadcast: bounded as its tables are."""
    return block.sparkSession.sparkContext.broadcast([(r["item_id"], r["item_text"]) for r in block.toLocalIterator()])


_HITS = "array<struct<start:long,end:long>>"


def _by_blocks(work: DataFrame, bench: DataFrame, n_blocks: int, text_col: str, window: int) -> DataFrame:
    """The search of a benchmark whose tables exceed the bound, block by block.

    Every block is a job of its own over the documents, which are written once:
    a worker holds the tables of the block that it searches, the driver the
    items of that block.  A job writes what it hits, by place; all hits of a
    place then come back to where its row lies.
    """
    rows = _util.held(_counted(_util.places(work), text_col))
    hits = None
    for k in range(n_blocks):
        items = _sent(bench.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(n_blocks)) == k))
        some = _util.materialise(_searched(rows.select("__part", "__at", text_col), items, text_col, window, ["__part", "__at"], keep_all=False).drop("__n"))
        items.destroy()
        hits = some if hits is None else hits.unionByName(some)
    hits = hits.groupBy("__part", "__at").agg(F.flatten(F.collect_list("__h")).alias("__h"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__i")))).alias("__i"))
    found = _util.returned(rows, hits.select("__part", "__at", F.struct(_merged("__h").alias("__h"), F.col("__i").alias("__i")).alias("__both")), "__both")
    none = lambda c, kind: F.coalesce(F.col(f"__both.{c}"), F.expr(f"cast(array() as {kind})")).alias(c)
    return found.select(*[c for c in rows.columns if c not in ("__part", "__at")], none("__h", _HITS), none("__i", "array<string>"))


def _merged(spans: str):
    """Overlapping and touching spans made one, as in ``_merge``."""
    empty = F.expr(f"cast(array() as {_HITS})")

    def step(out, x):
        last = F.try_element_at(out, F.lit(-1))
        one = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(out) > 0) & (x["start"] <= last["end"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(one))).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.array_sort(spans), empty, step)


def _counted(work: DataFrame, text_col: str) -> DataFrame:
    """``work`` with ``__n``, the number of words."""
    import pyarrow as pa

    at, schema = work.columns.index(text_col), StructType([*work.schema.fields, StructField("__n", LongType())])

    def run(batches):
        for batch in batches:
            n = pa.array([len(words(t.as_py())) for t in batch.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], names=[*batch.schema.names, "__n"])

    return work.mapInArrow(run, schema)


def _searched(work: DataFrame, rows, text_col: str, window: int, keep: list[str], keep_all: bool) -> DataFrame:
    """``keep``, ``__n``, ``__h`` and ``__i`` of the rows, or of those with a hit only; one block of items."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([*[f for f in work.schema.fields if f.name in keep], StructField("__n", LongType()), *_EXTRA])
    out = to_arrow_schema(schema)
    at, kept, block = work.columns.index(text_col), [i for i, c in enumerate(work.columns) if c in keep], uuid.uuid4().hex

    def run(batches):
        searcher = _built(block, rows, window)
        for batch in batches:
            n, h, i, some = [], [], [], []
            for k, text in enumerate(batch.column(at)):
                w = words(text.as_py())
                spans, items = searcher.find(w)
                if keep_all or spans:
                    some.append(k)
                    n.append(len(w))
                    h.append([{"start": a, "end": b} for a, b in spans])
                    i.append(sorted(items))
            own = batch if keep_all else batch.take(pa.array(some, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[own.column(c) for c in kept], pa.array(n, pa.int64()), pa.array(h, out.field("__h").type), pa.array(i, out.field("__i").type)], names=out.names)

    return work.mapInArrow(run, schema)


_EXTRA = [
    StructField("__h", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))),
    StructField("__i", ArrayType(StringType())),
]


def _merge(spans):
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from the operator's spans and items."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        id_col,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; columns kept."""
    work, (own_id, own_text), names = _util.plain(docs, id_col, text_col)
    found = decontaminate(work, benchmark, id_col=own_id, text_col=own_text, carry=True, **options)
    return _util.restored(found.where(F.size("hits") == 0), names)


def brute(docs: list[tuple], items: list[tuple], window: int = 10) -> dict:
    """Plain model for tests: every window against every position."""
    out = {}
    for doc_id, text in docs:
        w, hit, got = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            size = min(window, len(v))
            for i in range(len(v) - size + 1 if v and item_id is not None else 0):
                for j in range(len(w) - size + 1):
                    if w[j : j + size] == v[i : i + size]:
                        hit.update(range(j, j + size))
                        got.add(str(item_id))
        out[doc_id] = (len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit))
    return out


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, {_SQL_WORDS} AS w FROM documents
), b AS (
  SELECT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL
), p AS (
  SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0), unnest(range(1, len(w) - m + 2)) AS t(i)
), x AS (
  SELECT rn, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
  FROM d, (SELECT DISTINCT m FROM p), unnest(range(1, len(w) - m + 2)) AS t(i) WHERE len(w) >= m
), h AS (
  SELECT rn, i, x.m AS m, item_id FROM x JOIN p ON x.m = p.m AND x.g = p.g
), hits AS (
  SELECT rn, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT rn, i, m FROM h), unnest(range(i, i + m)) AS u(q) GROUP BY rn
), items AS (
  SELECT rn, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT rn, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY rn
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rn) LEFT JOIN items USING (rn)
"""
