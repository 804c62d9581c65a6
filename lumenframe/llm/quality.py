"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades come from the ``labels`` table: 0 for toxic text, 1 for junk
(``quality = 0``), 2 for sound and clean text.  Toxic is the lowest grade
because abusive words add up without a bound, while the signs of junk are
shares of the text and can be held in the middle.  The model is
``P(grade <= k) = logistic(t_k - w.x)`` with one weight vector ``w`` shared
by all grades and ordered thresholds ``t_0 < t_1`` (``t_1 = t_0 + exp(d)``),
fitted by full-batch Adam on the penalised likelihood.  ``x`` are hashed
text features of the whole text; their weights may have either sign.  The
ridge on buckets that go with higher grades is the stronger one, as sound
texts are longer and hold more of any word: without it length alone would
outweigh a few abusive words.  Scoring gives the expected grade and the
tail probability ``P(grade >= 2)``, by which documents are selected.

The model is fitted on a bounded sample: the ``sample`` labelled ids with the
least hash (documented parameter).  Statistics of the features are those of
that sample; scoring covers all rows in one map without a shuffle.

Defined cases: null text is empty and has the bias alone; unlabelled or
half-labelled rows don't train; of several labels of an id the lowest grade
counts; with fewer than two grades in the sample, every document is kept with
the grade that there is; repeated rows are scored one by one and train once;
an empty table gives no rows; extra columns are ignored by ``score`` and kept
by ``select``.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util

DIMENSIONS = 1 << 18
#: Dense features: shape of the text, on top of the hashed words.
DENSE = 6
_ODD = re.compile(r"[^\w\s.,;:'\"()/@+-]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_WORD = re.compile(r"[^\W\d_]+")
GRADES = 3


def dense(text: str, n_words: int, n_distinct: int) -> list[float]:
    n = max(1, len(text))
    letters = sum(map(len, _WORD.findall(text)))
    upper = len(_UPPER.findall(text))
    odd = len(_ODD.findall(text))
    return [1.0, letters / n, upper / n, min(1.0, 10 * odd / n), n_distinct / max(1, n_words), min(1.0, n_words / 20)]


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % DIMENSIONS


def buckets(word: str) -> list[int]:
    """Of the word itself and of its proper prefixes of 3 to 7 letters."""
    return [bucket(word), *(bucket(word[:k] + "~") for k in range(3, min(8, len(word))))]


class Model:
    """Weights of the hashed words that the sample supports, dense weights and thresholds."""

    def __init__(self, weights: np.ndarray, dense_weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.dense_weights, self.thresholds = weights, dense_weights, thresholds
        self.cache: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def latent(self, text: str | None) -> float:
        text = text or ""
        words = _WORD.findall(text.lower())
        distinct = set(words)
        cache, get = self.cache, self.cache.get
        if len(cache) > 400_000:
            cache.clear()
        hits: set[int] = set()
        for w in distinct:
            if (own := get(w)) is None:
                own = tuple(b for b in buckets(w) if self.weights[b])
                if len(w) <= 64:
                    cache[w] = own
            if own:
                hits.update(own)
        return float(self.weights[sorted(hits)].sum(dtype=np.float64)) + float(np.dot(self.dense_weights, dense(text, len(words), len(distinct))))

    def probabilities(self, latent: np.ndarray) -> np.ndarray:
        """Rows of P(grade = 0), ..., P(grade = 2)."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - latent[:, None], -40, 40)))
        edges = np.concatenate([np.zeros((len(latent), 1)), below, np.ones((len(latent), 1))], axis=1)
        return np.diff(edges, axis=1)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def objective(theta: np.ndarray, col: np.ndarray, own: np.ndarray, x: np.ndarray, grades: np.ndarray, weight: np.ndarray, ridge: np.ndarray) -> tuple[float, np.ndarray]:
    """Penalised negative log likelihood and its gradient.

    ``theta``: bucket weights, dense weights, ``t_0`` and ``d``.  Row
    ``own[i]`` holds bucket ``col[i]``; ``ridge`` is for all weights.
    """
    n, used = len(grades), len(theta) - DENSE - 2
    w, a = theta[:used], theta[used:-2]
    t = np.array([theta[-2], theta[-2] + np.exp(theta[-1])])
    z = np.bincount(own, w[col], n) + x @ a
    f0, f1 = logistic(t[0] - z), logistic(t[1] - z)
    d0, d1 = f0 * (1 - f0), f1 * (1 - f1)
    p = np.maximum(np.choose(grades, [f0, f1 - f0, 1 - f1]), 1e-9)
    dz = weight * np.choose(grades, [d0, d1 - d0, -d1]) / p
    g0 = -weight * np.choose(grades, [d0, -d0, 0 * d0]) / p
    g1 = -weight * np.choose(grades, [0 * d1, d1, -d1]) / p
    grad = np.concatenate([np.bincount(col, dz[own], used), x.T @ dz, [(g0 + g1).sum(), g1.sum() * np.exp(theta[-1])]])
    grad[:-2] += ridge * theta[:-2]
    return float(-(weight * np.log(p)).sum() + 0.5 * (ridge * theta[:-2] ** 2).sum()), grad


def fit(
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    *,
    min_share: float = 0.004,
    least_chi2: float = 18.0,
    penalty: float = 1e-4,
    raising_penalty: float = 1e-2,
    rounds: int = 300,
    balance: float = 0.5,
) -> Model:
    """Fits the cumulative-link model on ``(word buckets, dense features, grade)`` rows.

    Buckets take part that ``min_share`` of the rows hold (four at least) and
    that depend on the grade by their chi-square (two degrees of freedom).
    ``penalty`` is the ridge of all weights but those of buckets whose rows
    have a higher mean grade, which is ``raising_penalty``.
    """
    grades = np.array([g for _, _, g in rows], np.int64)
    present = np.unique(grades)
    if len(present) < 2:
        top = int(present[0]) if len(present) else GRADES - 1
        cut = np.where(np.arange(GRADES - 1) < top, -40.0, 40.0)
        return Model(np.zeros(DIMENSIONS, np.float32), np.zeros(DENSE), cut)
    # counts of buckets by grade, from a few hundred rows at a time: the rows are never concatenated whole
    n = len(rows)
    by_grade = np.zeros((GRADES, DIMENSIONS), np.int64)
    for at in range(0, n, 256):
        for g in present:
            if some := [b for b, _, h in rows[at : at + 256] if h == g]:
                by_grade[g] += np.bincount(np.concatenate(some), minlength=DIMENSIONS)
    support = by_grade.sum(axis=0)
    chi2 = np.zeros(DIMENSIONS)
    for g in present:
        expected = support * (grades == g).mean()
        chi2 += np.divide((by_grade[g] - expected) ** 2, expected, out=np.zeros(DIMENSIONS), where=expected > 0)
    used = np.flatnonzero((support >= max(4, min_share * n)) & (chi2 >= least_chi2))
    raising = np.arange(GRADES) @ by_grade[:, used] >= support[used] * grades.mean()
    ridge = np.concatenate([np.where(raising, raising_penalty, penalty), np.full(DENSE, penalty)])
    column = np.full(DIMENSIONS, -1)
    column[used] = np.arange(len(used))
    held = [c[c >= 0] for c in (column[b] for b, _, _ in rows)]
    col, own = np.concatenate(held), np.repeat(np.arange(n), [len(c) for c in held])
    x = np.stack([d for _, d, _ in rows])
    weight = np.bincount(grades, minlength=GRADES)[grades] ** -balance
    weight /= weight.sum()
    theta = np.zeros(len(used) + DENSE + 2)
    theta[-2], theta[-1] = -1.0, np.log(2.0)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        _, grad = objective(theta, col, own, x, grades, weight, ridge)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[used] = theta[: len(used)]
    return Model(weights, theta[len(used) : -2], np.array([theta[-2], theta[-2] + np.exp(theta[-1])]))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> list:
    """Features of the sampled labelled rows; at most ``sample`` ids and their rows' first texts."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    known = labels.select(F.col("doc_id").alias("label_id"), grade.alias("grade")).where("label_id is not null and grade is not null")
    known = known.groupBy("label_id").agg(F.min("grade").alias("grade"))
    # bounded by `sample` rows of two numbers, hence safe to broadcast
    known = _util.least_hashed(known, "label_id", sample)
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), F.col("id") == F.col("label_id"))
    schema = "id {k}, grade int, buckets array<int>, dense array<double>".format(k=dict(docs.dtypes)[id_col])

    def run(batches):
        for batch in batches:
            found, values = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                words = _WORD.findall(text.lower())
                distinct = set(words)
                found.append(sorted({b for w in distinct for b in buckets(w)}))
                values.append(dense(text, len(words), len(distinct)))
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(found, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=["id", "grade", "buckets", "dense"])

    got, seen = [], set()
    table = joined.select("id", "text", "grade").mapInArrow(run, schema).toArrow()
    for batch in table.sort_by("id").to_batches():
        for i in range(batch.num_rows):
            if (key := batch.column(0)[i].as_py()) not in seen:  # repeated rows train once
                seen.add(key)
                got.append((batch.column(2)[i].values.to_numpy(), batch.column(3)[i].values.to_numpy(), batch.column(1)[i].as_py()))
    return got


def score(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = 6_000, threshold: float = 0.5, carry: bool = False
) -> DataFrame:
    """``id_col, expected_grade, p_top, keep`` of every row; ``keep`` is ``p_top >= threshold``."""
    model = fit(training_rows(docs, labels, id_col, text_col, sample))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB of weights, whatever the corpus
    columns = docs.columns if carry else [id_col]
    work = docs.select(*columns, *([] if text_col in columns else [text_col]))
    at, n = work.columns.index(text_col), len(columns)
    schema = docs.select(*columns).schema
    for c in ("expected_grade", "p_top"):
        schema = schema.add(f"__{c}", "double")

    def run(batches):
        model = shared.value
        for batch in batches:
            if batch.num_rows:
                latent = np.array([model.latent(t.as_py()) for t in batch.column(at)])
                p = model.probabilities(latent)
                names = [*batch.schema.names[:n], "__expected_grade", "__p_top"]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(p @ np.arange(GRADES)), pa.array(p[:, -1].copy())], names=names)

    out = work.mapInArrow(run, schema)
    return out.select(*columns, F.col("__expected_grade").alias("expected_grade"), F.col("__p_top").alias("p_top"), (F.col("__p_top") >= threshold).alias("keep"))


def select(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are kept; columns as they were."""
    work, (own_id, own_text), names = _util.plain(docs, options.pop("id_col", "doc_id"), options.pop("text_col", "text"))
    kept = score(work, labels, id_col=own_id, text_col=own_text, carry=True, **options).where("keep")
    return _util.restored(kept, names)
