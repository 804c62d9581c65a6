"""Phrase collocations: suffix-sigma counting of n-grams, then scores from the counts of their parts.

Texts are lower-cased (A-Z), cut into pieces and pieces into words.  Every
word position gives the suffix of its piece, truncated to ``max_n`` words.
Suffixes are shuffled by language and first word, sorted in reverse
lexicographic order, and one stack counts all their prefixes: a suffix shares
the words that are on the stack already, the others are popped, each with its
count added to its parent's, and its new words are pushed.  The empty prefix
counts all words of a language.

A suffix ends before the first word with which it can't be frequent: a phrase
has its least count only if all its parts have.  Those that may have are marked
in a bitmap for each length, by hash of language and words, from counts of
all documents and phrases whose parts are marked; it has ``1 << bits`` bits, is built by Spark and sent to the
workers, and its chance collisions only leave a suffix longer than need be.
Equal suffixes are counted before they are shuffled, within a chunk of texts, within
a task and then over all, so a hot phrase is a row of each task and then one row;
the suffixes of a first word are dealt by their second word into ``SALTS`` groups, whose counts of the one-word prefix are
added up.  Parts meet phrases in equi-joins, whose skewed sides Spark splits.

Scores are whole numbers from exact decimals: ``floor(10^6 a a / (l r))``.

Defined cases: a null or empty text has no words; a null language is ``und``;
a language without candidates has no rows; repeated rows count each; an empty
table gives no rows; words may hold any sign but blanks, tabs and those that
cut; a count beyond 10^18 is an error; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import materialise

#: A-Z become a-z, signs that cut become line feeds, tabs become blanks; the rest stays.
_CUTS = b".,;:!?\x0a\x0b\x0c\x0d"
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in _CUTS else 32 if b == 9 else b for b in range(256))
#: Groups that the suffixes of one first word are dealt into, and about how many bytes of text are counted at once.
SALTS, CHUNK = 256, 4 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Words:
    """The words of some texts as numbers: ``word`` (into ``names``), ``lang`` (into ``langs``), and ``piece`` of every position."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.langs = sorted(set(langs))
        number = {x: i for i, x in enumerate(self.langs)}
        raw = np.frombuffer(b"\n".join([*texts, b""]).translate(_BYTES), np.uint8)
        sign = (raw != 32) & (raw != 10)
        edge = np.flatnonzero(np.diff(sign.astype(np.int8), prepend=0, append=0))
        start, end = edge[::2], edge[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.lang = np.array([number[x] for x in langs], np.int64)[np.searchsorted(ends, start, "right")]
        self.piece = np.searchsorted(np.flatnonzero(raw == 10), start)
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
        every = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[sign])])
        coded = every.dictionary_encode()
        self.word, self.names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()

    def hashes(self) -> np.ndarray:
        """64 bits of language and word for every position; the same in all workers."""
        import xxhash

        word = np.array([xxhash.xxh64_intdigest(x) for x in self.names], np.uint64)
        lang = np.array([xxhash.xxh64_intdigest(x, 1) for x in self.langs], np.uint64)
        return word[self.word] ^ lang[self.lang] if len(self.word) else np.zeros(0, np.uint64)

    def joined(self, n: int) -> np.ndarray:
        """Whether the position and its ``n - 1`` followers are of one piece."""
        out = np.zeros(len(self.piece), bool)
        if len(out) >= n:
            out[: len(out) - n + 1] = self.piece[: len(out) - n + 1] == self.piece[n - 1 :]
        return out


def buckets(hashes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bit of the ``n`` words from every position on; the last ``n - 1`` positions mean nothing."""
    out = np.zeros(len(hashes), np.uint64)
    for k in range(n):
        out = (out ^ np.concatenate([hashes[k:], np.zeros(min(k, len(hashes)), np.uint64)])) * _M1
        out ^= out >> np.uint64(29)
    return ((out * _M2) >> np.uint64(64 - bits)).astype(np.int64)


def supported(words: Words, hashes: np.ndarray, maps: list[np.ndarray], bits: int, n: int) -> np.ndarray:
    """Positions whose ``n`` words are of one piece, all their parts of up to ``len(maps)`` words marked."""
    out = words.joined(n)
    for m in range(1, min(n, len(maps)) + 1):
        at = buckets(hashes, m, bits)
        good = (maps[m - 1][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        for k in range(n - m + 1):
            out &= np.concatenate([good[k:], np.zeros(min(k, len(good)), bool)])
    return out


def _chunks(batches) -> Iterator[Words]:
    for batch in batches:
        texts, langs, held = [], [], 0
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            if raw := (text.as_py() or "").encode():
                texts.append(raw)
                langs.append(lang.as_py())
                held += len(raw)
            if held >= CHUNK:
                yield Words(texts, langs)
                texts, langs, held = [], [], 0
        if texts:
            yield Words(texts, langs)


#: Bits of a part of a bitmap: what a task counts goes out as one row for each part.
PART = 1 << 15


def _frequent(docs: DataFrame, n: int, maps: list, bits: int, least: int) -> np.ndarray:
    """The bitmap of phrases of ``n`` words that may occur ``least`` times.

    A task counts into one array of ``1 << bits`` small numbers, up to
    ``least``, and sends places and counts packed, part by part; the parts of all tasks are
    added up where they meet, and only the bitmap comes to the driver.
    """
    kind = np.min_scalar_type(least)
    size = min(PART, 1 << bits)

    def count(batches):
        held = np.zeros(1 << bits, kind)
        for words in _chunks(batches):
            hashes = words.hashes()
            found = supported(words, hashes, [m.value for m in maps], bits, n)
            at, times = np.unique(buckets(hashes, n, bits)[found], return_counts=True)
            held[at] = np.minimum(held[at] + times, least).astype(kind)
        rows = []
        for part in range(len(held) // size):
            own = held[part * size : (part + 1) * size]
            if len(at := np.flatnonzero(own)):
                rows.append((part, at.astype("<u2").tobytes(), own[at].tobytes()))
        if rows:
            part, at, times = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(at, pa.binary()), pa.array(times, pa.binary())], names=["part", "at", "times"])

    def add(batches):
        part, held = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.packbits(held >= least, bitorder="little").tobytes()], pa.binary())], names=["part", "map"])

        for batch in batches:
            for p, at, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    if part is not None:
                        yield out()
                    part, held = p, np.zeros(size, np.int64)
                held[np.frombuffer(at, "<u2")] += np.frombuffer(times, kind)
        if part is not None:
            yield out()

    counts = docs.mapInArrow(count, "part long, at binary, times binary").repartition("part").sortWithinPartitions("part")
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for r in counts.mapInArrow(add, "part long, map binary").collect():  # the bitmap, whatever the corpus
        own = np.frombuffer(bytes(r["map"]), np.uint8)
        whole[r["part"] * size // 8 :][: len(own)] = own
    return whole


def suffixes(docs: DataFrame, max_n: int, maps: list, bits: int) -> DataFrame:
    """``lang, words, n``: the truncated suffixes, equal ones of a chunk counted; ``docs`` is ``text, lang``."""

    def run(batches):
        for words in _chunks(batches):
            hashes, own = words.hashes(), [m.value for m in maps]
            length = np.zeros(len(words.word), np.int64)
            for n in range(1, max_n + 1):
                length[supported(words, hashes, own, bits, n)] = n
            # one number for each distinct suffix so far, made longer word by word
            key, base = words.lang * (max_n + 1) + length, len(words.names) + 1
            for k in range(max_n):
                key = np.unique(key, return_inverse=True)[1] * base
                long = np.flatnonzero(length > k)
                key[long] += words.word[long + k] + 1
            _, first, count = np.unique(key, return_index=True, return_counts=True)
            size = length[first]
            ends = np.concatenate([[0], np.cumsum(size)])
            at = np.repeat(first, size) + np.arange(ends[-1]) - np.repeat(ends[:-1], size)
            names = pa.array(words.names, pa.binary()).cast(pa.string())
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(words.word[at])))
            langs = pa.array(words.langs, pa.string()).take(pa.array(words.lang[first]))
            yield pa.RecordBatch.from_arrays([langs, listed, pa.array(count)], names=["lang", "words", "n"])

    return docs.mapInArrow(run, "lang string, words array<string>, n long")


class Stack:
    """The open prefix of sorted suffixes, and the counts of its own prefixes so far."""

    def __init__(self, least: int):
        self.least, self.lang, self.words, self.counts = least, None, [], [0]

    def pop(self, depth: int) -> Iterator[tuple[str, list[str], int]]:
        """Closes the prefixes longer than ``depth``; counts of no or one word are partial and all go out."""
        while len(self.words) > depth:
            n = self.counts.pop()
            if n >= self.least or len(self.words) == 1:
                yield self.lang, list(self.words), n
            self.counts[-1] += n
            self.words.pop()

    def push(self, lang: str, words: list[str], n: int) -> Iterator[tuple[str, list[str], int]]:
        if lang != self.lang:
            yield from self.close()
            self.lang = lang
        same = 0
        while same < len(words) and same < len(self.words) and words[same] == self.words[same]:
            same += 1
        yield from self.pop(same)
        self.words.extend(words[same:])
        self.counts.extend([0] * (len(words) - same))
        self.counts[-1] += n

    def close(self) -> Iterator[tuple[str, list[str], int]]:
        yield from self.pop(0)
        if self.counts[0]:
            yield self.lang, [], self.counts[0]
        self.counts = [0]


def phrase_counts(docs: DataFrame, *, max_n: int = 3, least: int = 10, bits: int = 26, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, words, n``: exact counts of all phrases of 2 to ``max_n`` words with ``least`` occurrences, of all their words, and of no word (all positions)."""
    spark = docs.sparkSession
    own = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    maps = []
    for n in range(1, max_n + 1):
        maps.append(spark.sparkContext.broadcast(_frequent(own, n, maps, bits, least)))
    # equal suffixes of all documents are one row, before any is sorted
    dealt = suffixes(own, max_n, maps, bits).groupBy("lang", "words").agg(F.sum("n").alias("n"))
    first, second = F.get("words", F.lit(0)), F.get("words", F.lit(1))
    dealt = dealt.repartition(F.col("lang"), first, F.pmod(F.xxhash64(second), F.lit(SALTS)))
    dealt = dealt.sortWithinPartitions(F.desc("lang"), F.desc("words"))

    def run(batches):
        def out(rows):
            lang, words, n = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(words, pa.list_(pa.string())), pa.array(n, pa.int64())], names=["lang", "words", "n"])

        stack, rows = Stack(least), []
        for batch in batches:
            for lang, words, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows.extend(stack.push(lang, words, n))
            if len(rows) >= 10_000:
                yield out(rows)
                rows = []
        rows.extend(stack.close())
        if rows:
            yield out(rows)

    counted = materialise(dealt.mapInArrow(run, "lang string, words array<string>, n long"))
    short = counted.where(F.size("words") < 2).groupBy("lang", "words").agg(F.sum("n").alias("n"))
    return counted.where(F.size("words") >= 2).unionByName(short)


def collocations(
    docs: DataFrame,
    *,
    max_n: int = 3,
    least: int = 10,
    inside: int = 50,
    top: int = 2000,
    scale: int = 1_000_000,
    bits: int = 26,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to ``max_n`` words.

    The lowest-scoring cut of a phrase counts.  A phrase inside a longer one
    that has at least ``inside`` percent of its occurrences is left out.
    """
    counted = materialise(phrase_counts(docs, max_n=max_n, least=least, bits=bits, text_col=text_col, lang_col=lang_col))
    phrases = counted.where(F.size("words") >= 2).select("lang", "words", F.col("n").alias("a"))
    known = counted.where(F.size("words") >= 1)

    def part(name: str) -> DataFrame:
        return known.select(F.col("lang").alias(f"{name}_lang"), F.col("words").alias(f"{name}_words"), F.col("n").alias(name))

    cut = phrases.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cut.select("*", F.slice("words", F.lit(1), F.col("k")).alias("head"), F.slice("words", F.col("k") + 1, F.size("words")).alias("tail"))
    for name, column in (("l", "head"), ("r", "tail")):
        cut = cut.join(part(name), (F.col("lang") == F.col(f"{name}_lang")) & (F.col(column) == F.col(f"{name}_words"))).drop(f"{name}_lang", f"{name}_words")
    whole = {c: f"cast({c} as decimal(18,0))" for c in "alr"}
    cut = cut.withColumn("score", F.expr(f"(cast({scale} as decimal(38,0)) * ({whole['a']} * {whole['a']})) div ({whole['l']} * {whole['r']})"))
    scored = cut.groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # parts of longer phrases, each with the most occurrences that one of those has
    size = F.size("words")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("words", i, m))))
    longer = phrases.where(size > 2).select("lang", F.col("a").alias("most"), F.explode(spans).alias("in_words")).groupBy(F.col("lang").alias("in_lang"), "in_words").agg(F.max("most").alias("most"))
    left = scored.join(longer, (F.col("lang") == F.col("in_lang")) & (F.col("words") == F.col("in_words")), "left")
    left = left.where(F.col("most").isNull() | (100 * F.col("most") < inside * F.col("a")))
    left = left.select("lang", F.array_join("words", " ").alias("phrase"), "a", "best.l", "best.r", "best.score")
    # the best of parts of a language first, so that no task sorts all its phrases
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("salt")
    some = left.select("*", salt).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = counted.where(F.size("words") == 0).select(F.col("lang").alias("n_lang"), "n")
    return ranked.join(total, F.col("lang") == F.col("n_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows: list[tuple], max_n: int = 3, least: int = 10, inside: int = 50, top: int = 2000) -> list[tuple]:
    """Plain model for tests, of ``(lang, text)`` rows."""
    import re
    from collections import Counter, defaultdict

    counts, total = Counter(), Counter()
    for lang, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            counts.update((lang or "und", tuple(w[i : i + n])) for n in range(1, max_n + 1) for i in range(len(w) - n + 1))
    frequent = {x: n for x, n in counts.items() if n >= least and len(x[1]) > 1}
    out = defaultdict(list)
    for (lang, w), a in frequent.items():
        cuts = [(1_000_000 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if not any(lg == lang and len(v) > len(w) and 100 * n >= inside * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (lg, v), n in frequent.items()):
            out[lang].append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM p)
), g AS (
  SELECT lang, m, g, count(*) AS f FROM (
    SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(list_slice(w, i, i + m - 1), ' '))) AS g
    FROM w, (VALUES (1), (2), (3)) AS t(m) WHERE len(w) >= m
  ) GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang
), c AS (
  SELECT lang, m, g, f AS a FROM g WHERE m > 1 AND f >= 10
), k AS (
  SELECT h.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT c.*, k, array_to_string(list_slice(string_split(g, ' '), 1, k), ' ') AS head, array_to_string(list_slice(string_split(g, ' '), k + 1, m), ' ') AS tail FROM c, (VALUES (1), (2)) AS t(k) WHERE k < m) h
  JOIN g x ON x.lang = h.lang AND x.g = h.head JOIN g y ON y.lang = h.lang AND y.g = h.tail
), b AS (
  SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), o AS (
  SELECT lang, array_to_string(list_slice(string_split(c.g, ' '), i, i + 1), ' ') AS g, max(a) AS most FROM c, (VALUES (1), (2)) AS t(i) WHERE m = 3 GROUP BY ALL
), r AS (
  SELECT b.lang, b.g AS phrase, a, l, r, score FROM b LEFT JOIN o ON o.lang = b.lang AND o.g = b.g
  WHERE most IS NULL OR 100 * most < 50 * a
), z AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM r
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM z JOIN n USING (lang) WHERE rank <= 2000
"""
