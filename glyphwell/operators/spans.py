"""Segments of a document against its runs, where the document is: nothing is shuffled, and no row is made of a segment.

``runs`` is an array of ``start``, ``stop`` (and ``font``) in code points, in order and
disjoint. ``relations`` has the same joins for tokens and runs that are tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from glyphwell.functions import kernel

#: Most bytes of an Arrow batch that are worked on at once.
BATCH_BYTES = 8 << 20
_SPACE = np.zeros(0x3002, bool)
_SPACE[[ord(c) for c in kernel._SPACES]] = True


def slices(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows, so that none but a single long row is far over ``most`` bytes."""
    most = most or BATCH_BYTES
    for batch in batches:
        step = max(1, batch.num_rows * most // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _texts(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    """The texts of a batch, and where each begins when they are joined; the last number is where all end."""
    texts = [t or "" for t in batch.column("text").to_pylist()]
    return texts, np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def _runs(batch: pa.RecordBatch, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StructArray]:
    """Document, first and last character of every run that begins in its text, in the joined texts; and the runs."""
    column = batch.column("runs")
    flat = column.flatten()  # without those of a null
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(counts)), counts)
    first, last = (pc.struct_field(flat, name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("start", "stop"))
    inside = first < at[doc + 1] - at[doc]
    doc, first, last = doc[inside], first[inside], last[inside]
    return doc, at[doc] + first, np.minimum(at[doc] + last, at[doc + 1]), flat.filter(pa.array(inside))


def _segments(texts: list[str], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of every run of words and gaps of the joined texts; none goes over a text's end."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    space = _SPACE[np.minimum(points, 0x3001)]
    opens = np.ones(len(points), bool)
    opens[1:] = space[1:] != space[:-1]
    opens[at[:-1][at[:-1] < len(points)]] = True
    first = np.flatnonzero(opens)
    return first, np.append(first[1:], len(points))


def _next(flags: np.ndarray) -> np.ndarray:
    """The least index from each on at which a flag is set; their number if there is none."""
    n = len(flags)
    found = np.where(flags, np.arange(n), n)
    return np.append(np.minimum.accumulate(found[::-1])[::-1], n)


def font_counts(docs: DataFrame) -> DataFrame:
    """``font``, ``n``: how many segments of ``text`` have a font, which is any legacy one in ``runs`` over the segment, else the first named."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, at = _texts(batch)
            _, run_first, run_last, runs = _runs(batch, at)
            first, last = _segments(texts, at)
            if not len(first):
                continue
            fonts = pc.struct_field(runs, "font").dictionary_encode()
            names = fonts.dictionary.to_pylist()
            of = pc.fill_null(fonts.indices, -1).to_numpy(zero_copy_only=False)
            legacy = np.array([*map(kernel.legacy_font, names), False], bool)[of]
            low, high = np.searchsorted(run_last, first, "right"), np.searchsorted(run_first, last, "left")
            best, named = _next(legacy)[low], _next(of >= 0)[low]
            run = np.where(best < high, best, np.where(named < high, named, len(of)))
            counts = np.bincount(np.append(of, -1)[run] + 1, minlength=len(names) + 1)
            rows = [(name, int(n)) for name, n in zip([None, *names], counts) if n]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["font", "n"])

    return docs.select("text", "runs").mapInArrow(count, "font string, n bigint").groupBy("font").agg(F.sum("n").alias("n"))


def texts_of_runs(docs: DataFrame, changes: Callable[[str], list[tuple[int, int, str]]], key: str = "doc_id") -> DataFrame:
    """``key``, ``start``, ``text`` of each run after conversion: what doesn't change in its part, what does whole where it begins.

    ``changes`` gives first and last character and new text of what changes in a
    text, in order; no text at all has no runs.
    """
    kind = dict(docs.dtypes)[key]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, at = _texts(batch)
            doc, run_first, run_last, runs = _runs(batch, at)
            found = [(at[k] + a, at[k] + b, new) for k, t in enumerate(texts) for a, b, new in changes(t)]
            a, b = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
            joined, done, cursor = "".join(texts), [], 0
            for first, last, new in found:
                done += [joined[cursor:first], new]
                cursor = last
            out = "".join([*done, joined[cursor:]])
            longer = np.append(0, np.cumsum([len(new) for _, _, new in found] - (b - a)).astype(np.int64))

            def placed(p: np.ndarray) -> np.ndarray:
                """Where characters are afterwards; one within a changed piece is at that piece's end."""
                k = np.searchsorted(a, p, "left")
                return np.maximum(p, np.append(0, b)[k]) + longer[k]

            cuts = [out[x:y] for x, y in zip(placed(run_first).tolist(), placed(run_last).tolist())]
            columns = [batch.column(key).take(pa.array(doc)), pc.struct_field(runs, "start").cast(pa.int64()), pa.array(cuts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [key, "start", "text"])

    return docs.select(key, "text", "runs").mapInArrow(cut, f"`{key}` {kind}, start bigint, text string")
