"""Substring dedup by content-defined chunking.

A text is first normalised to lower-case words with single spaces, so that other
line breaks, punctuation or case hide no repeat. A gear hash rolls over its bytes:
at every byte it shifts left by one and adds the byte's random number, so that it
depends on the last ``WINDOW`` bytes only. A place is a cut if its hash is the
least of some ``SPAN`` consecutive ones (the first of equals; places before a
word come before places inside one), so two cuts are at most ``SPAN`` apart, and
equal passages have equal cuts from ``WINDOW + SPAN`` bytes after their beginning
on, whatever was inserted before. Cuts less than ``LEAST`` bytes apart form a
chain, of which the first counts and then each that is ``LEAST`` further on; so
periodic text has few.

At every cut begins a chunk, which ends at the first cut that is at least ``RUN``
bytes on. A chunk is thus a whole passage, and no run of unrelated common phrases
passes for one. Chunks are deduplicated by a 128-bit digest: of equal chunks that
of the least key stays (in one text the first), and every other one is a repeat;
repeats that overlap or touch are joined. A passage of ``WINDOW + 2 * SPAN + RUN``
normalised bytes and more is always found, a shorter one if its cuts allow.

Chunks are cut twice: once to find the least key of each digest, with map-side
combining, so that a chunk in a third of all documents costs each task one row;
and once to be joined with the digests that several documents have, a hash join
whose stream side Spark splits where it is skewed. Repeats of equal rows are
combined before the last shuffle, so no group is larger than one text.

Defined results: null, empty and wordless texts, and those of less than ``RUN``
normalised bytes, have no chunks. In a report, rows without ``doc_id`` are left
out; rows that agree in ``doc_id`` don't repeat each other, and each different
text of theirs is reported. ``drop_repeats`` orders documents by a hash of id and
text; rows that agree in both count as one and stay alike, and a text of which
nothing but whitespace is left goes. A very long text is one slice of its own. Of
an empty table nothing is reported or kept. Other columns pass through, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphwell.llm import kernels
from glyphwell.llm.arrow import map_batches, pieces, record
from glyphwell.llm.normal import Normalised
from glyphwell.session import free_names

WINDOW = 16
SPAN = 80
LEAST = 12
#: Normalised bytes that a repeated passage must have.
RUN = 100

_GEAR = kernels.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
_INSIDE, _NEVER = np.uint32(1 << 31), np.uint32(0xFFFFFFFF)

_CHUNK = {"h1": pa.int64(), "h2": pa.int64(), "key": pa.int64(), "key2": pa.int64(), "start": pa.int32(), "stop": pa.int32(), "again": pa.bool_()}
_CHUNK_SQL = "h1 bigint, h2 bigint, key bigint, key2 bigint, start int, stop int, again boolean"


def rolling(raw: np.ndarray) -> np.ndarray:
    """The gear hash of the last WINDOW bytes at each byte; fewer at the beginning."""
    h = _GEAR[raw]
    for k in (1, 2, 4, 8):  # the hash of 2k bytes from two of k
        h[k:] += h[:-k] << np.uint32(k)
    return h


def cuts(raw: np.ndarray, starts: np.ndarray, span: int = SPAN, least: int = LEAST) -> np.ndarray:
    """The cuts of the rows, with every row's begin and end, in order."""
    n = len(raw)
    if n < span + WINDOW:
        return np.unique(starts)
    rank = rolling(raw) >> np.uint32(1)
    after = np.append(raw[1:], 0)
    rank[after != 32] |= _INSIDE
    rank[(after & 0xC0) == 0x80] = _NEVER
    best = (rank.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    size = 1
    while size < span:  # the least of 2k places from two of k
        step = min(size, span - size)
        best = np.minimum(best[:-step], best[step:])
        size += step
    # Only windows of places that lie in one row, and whose hashes do.
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.arange(len(best))
    inner = best[(row[: len(best)] == row[span - 1 :]) & (at - starts[row[: len(best)]] >= WINDOW - 1)]
    inner = (inner & np.uint64(0xFFFFFFFF)).astype(np.int64) + 1
    inner = inner[np.append(True, inner[1:] != inner[:-1])] if len(inner) else inner
    inner = inner[inner < n]
    row = row[inner - 1]
    head = np.flatnonzero(np.append(True, (np.diff(inner) >= least) | (row[1:] != row[:-1]))[: len(inner)])
    last = np.append(head[1:], len(inner))
    taken = [inner[head]]
    while len(head):
        at = np.searchsorted(inner, inner[head] + least)
        more = at < last
        head, last = at[more], last[more]
        taken.append(inner[head])
    return np.unique(np.concatenate((starts, *taken)))


def passages(edges: np.ndarray, starts: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of the chunks: from each cut to the first one at least ``run`` bytes on in the row."""
    begin = edges[:-1]
    row = np.searchsorted(starts, begin, side="right") - 1
    to = np.searchsorted(edges, begin + run)
    inside = to < len(edges)
    end = edges[np.minimum(to, len(edges) - 1)]
    inside &= end <= starts[np.minimum(row + 1, len(starts) - 1)]
    return begin[inside], end[inside], row[inside]


def seen_before(row: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which chunks have an equal one earlier in their row."""
    order = np.lexsort((h2, h1, row))
    out = np.zeros(len(row), bool)
    r, a, b = row[order], h1[order], h2[order]
    out[order[1:]] = (r[1:] == r[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])  # the sort is stable
    return out


def chunk_table(docs: DataFrame, key: str, key2: str, text: str = "text", run_bytes: int = RUN) -> DataFrame:
    """``h1``, ``h2``, ``key``, ``key2``, ``start``, ``stop`` and ``again`` of every chunk, in bytes of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keys, keys2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            raw, starts = kernels.string_buffer(batch.column(2))
            for first, last in kernels.slices(starts):
                at = starts[first : last + 1] - starts[first]
                n = Normalised(raw[starts[first] : starts[last]], at)
                begin, end, row = passages(cuts(n.bytes, n.starts), n.starts, run_bytes)
                if not len(begin):
                    continue
                h1, h2 = (kernels.span_hasher(n.bytes, k)(begin, end) for k in (0, 1))
                start = np.where(begin == n.starts[row], 0, n.origin(begin) - at[row])
                stop = np.where(end == n.starts[row + 1], at[row + 1], n.origin(end)) - at[row]
                yield record(_CHUNK, h1=h1.view(np.int64), h2=h2.view(np.int64), key=keys[first + row], key2=keys2[first + row], start=start.astype(np.int32), stop=stop.astype(np.int32), again=seen_before(row, h1, h2))

    slim = docs.select(F.col(key).cast("bigint").alias("key"), F.col(key2).alias("key2"), F.col(text).alias("text")).where(F.length("text") > 0)
    return slim.mapInArrow(run, _CHUNK_SQL)


def repeated_runs(chunks: DataFrame) -> DataFrame:
    """``key``, ``key2``, ``start``, ``stop``, ``first_key``: repeated chunks, joined where they overlap or touch."""
    shared = chunks.where("not again").groupBy("h1", "h2").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("h1", "h2", "first")
    found = chunks.join(shared.hint("shuffle_hash"), ["h1", "h2"], "left").where("again or key > first")
    found = found.groupBy("key", "key2", "start").agg(F.max("stop").alias("stop"), F.min(F.coalesce("first", "key")).alias("first_key"))
    order = Window.partitionBy("key", "key2").orderBy("start")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("run", F.sum(F.coalesce(before < F.col("start"), F.lit(True)).cast("int")).over(order))
    return marked.groupBy("key", "key2", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("first_key", "start").alias("first_key")).drop("run")


def repeats(docs: DataFrame, run: int = RUN) -> DataFrame:
    """``doc_id``, ``start``, ``stop``, ``first_doc_id``: repeated passages, in bytes of the UTF-8 text, and the document with the first copy."""
    named = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    found = repeated_runs(chunk_table(named, "doc_id", "text_key", run_bytes=run))
    return found.select(F.col("key").alias("doc_id"), "start", "stop", F.col("first_key").alias("first_doc_id"))


def without(text: str, spans: list[dict]) -> str:
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    for s in sorted(spans, key=lambda s: s["start"]):
        out.append(raw[at : s["start"]])
        at = s["stop"]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def row_keys() -> tuple[Column, Column]:
    """Two independent hashes of id and text: 128 bits that name a document."""
    return F.xxhash64("doc_id", "text"), F.xxhash64(F.lit("second"), "doc_id", "text")


def drop_repeats(docs: DataFrame, run: int = RUN) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``, and ``n_chars``, if there is one, to match.

    Rows whose text is cut to nothing but whitespace are left out; all others
    stay, in the columns as they came.
    """
    key, key2, spans = free_names(docs, "row_key", "row_key2", "spans")
    one, two = row_keys()
    keyed = docs.withColumn(key, one).withColumn(key2, two)
    runs = repeated_runs(chunk_table(keyed, key, key2, run_bytes=run))
    grouped = runs.groupBy("key", "key2").agg(F.collect_list(F.struct("start", "stop")).alias(spans)).withColumnsRenamed({"key": key, "key2": key2})

    names = docs.columns

    def cut_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(batch.num_columns - 1)
        batch = batch.select(names)
        hit = lists.is_valid()
        if lists.null_count == len(lists):
            return batch
        at = batch.schema.names.index("text")
        old = batch.column(at)
        new = [without(old[k].as_py(), s) if (s := lists[k].as_py()) is not None else None for k in range(len(lists))]
        keep = pa.array([t is None or not t.isspace() and t != "" for t in new])
        new = pa.array(new, old.type)
        batch = batch.set_column(at, batch.schema.field(at), pc.if_else(hit, new, old))
        if "n_chars" in names:
            n = batch.schema.names.index("n_chars")
            batch = batch.set_column(n, batch.schema.field(n), pc.if_else(hit, pc.utf8_length(new).cast(batch.column(n).type), batch.column(n)))
        return batch.filter(keep)

    joined = keyed.join(grouped, [key, key2], "left").select(*(F.col(f"`{c}`") for c in docs.columns), spans)
    return map_batches(joined, cut_out, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
