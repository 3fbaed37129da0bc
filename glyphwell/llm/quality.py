"""Quality classifier by Bradley-Terry pairwise ranking.

A document's score is linear in style features of its whole text: shares of
capitals, digits, symbols, marks, line ends and repeated words, and word length.
The weights come from preference pairs, one for every labelled good and every
labelled bad document of the sample: the probability that the good one is
preferred is the logistic of the score difference, so the loss is logistic on
feature differences, without an intercept. Newton's method minimises it over all
pairs; gradient and Hessian need only sums over rows and columns of the pairs'
probabilities, which are made in blocks.

The threshold is a quantile of the scores of all documents. Its level is the one,
of every 0.01 %, that separates the labelled documents best in balanced accuracy,
and the lowest of equals, so that no fixed share of good documents is lost.

The model is fitted on at most ``LABELLED_ROWS`` labelled documents, the first by
a hash of the id, counted after labels and documents are joined; scoring and
quantiles cover all documents.

Defined results: a null or empty text has no score and is rejected. A null label
is no label. If either class has no labelled document nothing can be ranked, and
every document with text is kept with score 0. Repeated label rows count as often
as they come; equal documents have equal scores; a score at the threshold is kept.
A very long text is one slice of its own. Of an empty table nothing is kept.
Other columns pass through ``drop_poor``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphwell.llm import kernels
from glyphwell.llm.arrow import map_batches, pieces
from glyphwell.session import cut

LABELLED_ROWS = 20_000
#: Pairs whose probabilities are in memory at once.
_BLOCK = 1 << 22
LEVELS = 10_000
RIDGE = 1e-3

FEATURES = ("capitals", "digits", "symbols", "marks", "line_ends", "word_length", "repeated", "repeated_apart")
#: Added to every count's denominator, so that a short text's shares are near the usual ones.
_SHRINK = 20.0

_UPPER, _LETTER, _DIGIT, _SYMBOL, _MARK = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT[48:58] = True
_SYMBOL[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = True
_MARK[list(b"!?:;\"'()")] = True


def _sums(mask: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def features(column: pa.Array) -> np.ndarray:
    """The features (rows, 8) of a text column."""
    out = np.zeros((len(column), len(FEATURES)))
    raw, starts = kernels.string_buffer(column)
    for first, last in kernels.slices(starts):
        part, at = raw[starts[first] : starts[last]], starts[first : last + 1] - starts[first]
        n = last - first
        letters, size = _sums(_LETTER[part], at), np.diff(at)
        low = kernels.LOWER[part]
        begin, end, row = kernels.word_spans(low, at)
        words = np.bincount(row, minlength=n)
        h = kernels.span_hashes(low, begin, end)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        apart = np.zeros(len(h), bool)
        apart[2:] = (h[2:] == h[:-2]) & (row[2:] == row[:-2]) & ~same[2:]
        block = out[first:last]
        block[:, 0] = _sums(_UPPER[part], at) / (letters + _SHRINK)
        for k, members in ((1, _DIGIT), (2, _SYMBOL), (3, _MARK)):
            block[:, k] = _sums(members[part], at) / (size + _SHRINK)
        block[:, 4] = _sums(part == 10, at) / (words + _SHRINK)
        block[:, 5] = np.bincount(row, weights=end - begin, minlength=n) / (words + _SHRINK / 4)
        block[:, 6] = np.bincount(row, weights=same, minlength=n) / (words + _SHRINK)
        block[:, 7] = np.bincount(row, weights=apart, minlength=n) / (words + _SHRINK)
    return out


def rank(good: np.ndarray, bad: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Bradley-Terry weights from features of preferred and other documents: the minimum of the mean loss of all pairs."""
    scale = np.vstack((good, bad)).std(axis=0)
    scale[scale < 1e-12] = 1.0
    g, b = good / scale, bad / scale
    pairs, step_rows = len(g) * len(b), max(1, _BLOCK // len(b))
    w = np.zeros(g.shape[1])
    for _ in range(100):
        gradient, hessian = -ridge * w, ridge * np.eye(len(w))
        column, column_q = np.zeros(len(b)), np.zeros(len(b))
        against = (b @ w).astype(np.float32)
        for at in range(0, len(g), step_rows):
            own = g[at : at + step_rows]
            p = np.subtract.outer((own @ w).astype(np.float32), against)
            np.clip(p, -80, 80, out=p)
            np.exp(p, out=p)
            p += 1
            np.reciprocal(p, out=p)  # how far each pair is from being preferred
            gradient += own.T @ p.sum(axis=1, dtype=np.float64) / pairs
            column += p.sum(axis=0, dtype=np.float64)
            p -= p * p
            row_q = p.sum(axis=1, dtype=np.float64)
            column_q += p.sum(axis=0, dtype=np.float64)
            cross = own.T @ (p @ b.astype(np.float32)).astype(np.float64)
            hessian += ((own * row_q[:, None]).T @ own - cross - cross.T) / pairs
        gradient -= b.T @ column / pairs
        hessian += (b * column_q[:, None]).T @ b / pairs
        step = np.linalg.solve(hessian, gradient)
        w += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-5:
            break
    return w / scale


def labelled(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``rows`` labelled documents with text."""
    known = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    order = (F.xxhash64("doc_id"), "doc_id", "quality")
    # At most ``rows`` short rows: small enough to broadcast whatever the corpus.
    few = F.broadcast(known.orderBy(*order).limit(rows))
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).where(F.length("text") > 0).join(few, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            f = features(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(f.ravel()), len(FEATURES)).cast(pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["f", "quality", "doc_id"])

    # Ids that several documents share bring more rows than labels, so the bound holds after the join.
    table = found.select("text", "quality", "doc_id").mapInArrow(run, "f array<double>, quality int, doc_id bigint").orderBy(*order, "f").limit(rows).toArrow()
    x = np.array(table.column("f").combine_chunks().flatten(), float).reshape(-1, len(FEATURES))
    return x, table.column("quality").to_numpy()


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id`` and ``score`` of every text; a narrow step."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(features(batch.column(1)) @ weights)], ["doc_id", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, score double")


def at_least(docs: DataFrame, weights: np.ndarray, least: float) -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` or more; a narrow step."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(features(batch.column(batch.schema.names.index("text"))) @ weights >= least))

    return map_batches(docs, run, docs.schema)


def threshold(scores: DataFrame, x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float | None:
    """The quantile of the column ``score`` that separates the labelled documents best."""
    levels = [k / LEVELS for k in range(LEVELS)]
    found = scores.agg(F.percentile_approx("score", levels, 50_000).alias("q")).first()["q"]
    if found is None:
        return None
    s = x @ weights
    good, bad = np.sort(s[y > 0]), np.sort(s[y <= 0])
    q = np.array(found)
    # Kept are scores of at least the threshold.
    balanced = (1 - np.searchsorted(good, q, side="left") / len(good)) + np.searchsorted(bad, q, side="left") / len(bad)
    return float(q[int(np.argmax(balanced))])


def kept(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """``doc_id`` and ``score`` of the documents that are good enough."""
    x, y = labelled(docs, labels, rows)
    slim = docs.where(F.length("text") > 0).select("doc_id", "text")
    if not (y > 0).any() or not (y <= 0).any():
        return slim.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(0.0).alias("score"))
    weights = rank(x[y > 0], x[y <= 0])
    scores = cut(scored(slim, weights))
    return scores.where(F.col("score") >= F.lit(threshold(scores, x, y, weights)))


def drop_poor(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """``docs`` without those of too low a score, columns as they came. Texts are read again rather than shuffled."""
    x, y = labelled(docs, labels, rows)
    worded = docs.where(F.length("text") > 0)
    if not (y > 0).any() or not (y <= 0).any():
        return worded
    weights = rank(x[y > 0], x[y <= 0])
    least = threshold(scored(worded, weights), x, y, weights)
    return worded if least is None else at_least(worded, weights, least)


def query(spark, sf_dir: str) -> DataFrame:
    return kept(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
