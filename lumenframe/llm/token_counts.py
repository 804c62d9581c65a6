"""Token counts under a unigram vocabulary, by dynamic programming on a trie.

Text is cut at spaces into chunks (a chunk carries its leading space), chunks
into pre-tokens.  Distinct pre-tokens enter a trie of bytes; the unigram
forward score of a node - the best log probability of any segmentation of
the path from the root - depends on that path alone, so it is computed once
for every shared prefix, and a terminal node stores the token count of its
best segmentation.  Documents then only sum stored counts.

The vocabulary is a public rank file; a piece of rank r has the Zipf score
``-log(r + 1)``, normalised over the vocabulary.  Nothing is trained.  Every
single byte is a piece, hence every pre-token can be segmented.  Of equal
scores the segmentation with the longer last piece wins.

Pre-tokens of more than ``LONG`` bytes are scored by the same rule in a ring
as long as the longest piece, so neither a text nor a corpus grows the trie
beyond its bound.

Defined cases: null or empty text counts 0; texts are processed whole, in
linear time; repeated rows are counted row by row; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import math
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from . import _util

#: Letters, digits and other signs part; a leading space belongs to what follows.
_PRETOKEN = re.compile(r" ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+")


@lru_cache(maxsize=2)
def load_scores(path: str) -> dict[bytes, float]:
    """Zipf log probabilities of the pieces of a rank file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    norm = math.log(math.fsum(1 / (r + 1) for r in ranks.values()))
    return {p: -math.log(r + 1) - norm for p, r in ranks.items()}


#: Pre-tokens of more bytes are scored without nodes of their own.
LONG = 1024


class Pieces:
    """The vocabulary as a trie of reversed pieces: from an end, one walk meets all pieces that end there."""

    def __init__(self, scores: dict[bytes, float]):
        #: node * 256 + byte -> node
        self.child: dict[int, int] = {}
        self.score: list[float | None] = [None]
        self.longest = max(map(len, scores))
        for piece, score in scores.items():
            node = 0
            for b in reversed(piece):
                key = node << 8 | b
                if (node := self.child.get(key, 0)) == 0:
                    node = self.child[key] = len(self.score)
                    self.score.append(None)
            self.score[node] = score


class CountTrie:
    """Trie of pre-tokens with forward scores; emptied when it holds ``max_nodes``."""

    def __init__(self, scores: dict[bytes, float], max_nodes: int = 600_000):
        self.pieces, self.max_nodes = Pieces(scores), max_nodes
        self.clear()

    def clear(self) -> None:
        #: node * 256 + byte -> node
        self.child: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]
        self.terminal: dict[int, int] = {}

    def insert(self, word: bytes) -> int:
        """Token count of ``word``; scores only the nodes that are new."""
        if len(word) > LONG:
            return self._long(word)
        if len(self.best) > self.max_nodes:
            self.clear()
        child, best, tokens = self.child, self.best, self.tokens
        walk, score = self.pieces.child.get, self.pieces.score
        path, node = [0], 0
        for i, b in enumerate(word):
            nxt = child.get(node << 8 | b)
            if nxt is None:
                top, count, start, at = -math.inf, 0, i + 1, 0
                while start and (at := walk(at << 8 | word[start - 1])):
                    start -= 1
                    if (s := score[at]) is not None and (s := s + best[path[start]]) >= top:  # the longer piece of equal ones
                        top, count = s, tokens[path[start]] + 1
                nxt = child[node << 8 | b] = len(best)
                best.append(top)
                tokens.append(count)
            node = nxt
            path.append(node)
        if node not in self.terminal:
            self.terminal[node] = tokens[node]
        return self.terminal[node]

    def _long(self, word: bytes) -> int:
        """The same scores in a ring as long as the longest piece; nothing is kept."""
        walk, score, ring = self.pieces.child.get, self.pieces.score, self.pieces.longest + 1
        best, tokens = [0.0] * ring, [0] * ring
        for end in range(1, len(word) + 1):
            top, count, start, at = -math.inf, 0, end, 0
            while start and (at := walk(at << 8 | word[start - 1])):
                start -= 1
                if (s := score[at]) is not None and (s := s + best[start % ring]) >= top:
                    top, count = s, tokens[start % ring] + 1
            best[end % ring], tokens[end % ring] = top, count
        return tokens[len(word) % ring]


class Counter(dict):
    """Chunk after a space -> pre-tokens * 2^32 + tokens; a bounded cache over the trie."""

    def __init__(self, scores: dict[bytes, float], max_chunks: int = 500_000):
        super().__init__()
        self.trie, self.max_chunks = CountTrie(scores), max_chunks

    def _count(self, chunk: str) -> int:
        pre = _PRETOKEN.findall(chunk)
        return (len(pre) << 32) + sum(self.trie.insert(p.encode()) for p in pre)

    def __missing__(self, chunk: str) -> int:
        if len(self) >= self.max_chunks:
            self.clear()
        out = self._count(" " + chunk)
        if len(chunk) <= 64:
            self[chunk] = out
        return out

    def count(self, text: str | None) -> tuple[int, int]:
        if not text:
            return 0, 0
        first, *rest = text.split(" ")
        return divmod(self._count(first) + sum(map(self.__getitem__, rest)), 1 << 32)


def token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_pretokens, n_tokens`` of every row; one map, no shuffle."""

    def counts(batch):
        counter = _counter(vocabulary)
        got = [counter.count(t) for t in batch.column(1).to_pylist()]
        return batch.column(0), [x[0] for x in got], [x[1] for x in got]

    kind = dict(docs.dtypes)[id_col]
    return _util.arrow_map(docs.select(id_col, text_col), counts, f"`{id_col}` {kind}, n_pretokens long, n_tokens long")


@lru_cache(maxsize=1)
def _counter(vocabulary: str) -> Counter:
    return Counter(load_scores(vocabulary))


def brute_count(text: str | None, scores: dict[bytes, float]) -> tuple[int, int]:
    """Plain model for tests: Viterbi on each pre-token, nothing shared."""
    first, *rest = (text or "").split(" ")
    pre = [p for c in [first, *(" " + x for x in rest)] for p in _PRETOKEN.findall(c)]
    total = 0
    for word in (p.encode() for p in pre):
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                if (s := scores.get(word[start:end])) is not None and best[start][0] + s > best[end][0]:
                    best[end] = (best[start][0] + s, best[start][1] + 1)
        total += best[-1][1]
    return len(pre), total
