"""Benchmark decontamination with one Aho-Corasick automaton.

Test questions and answers are normalised to lower-case words with single spaces
between them, and every word is a symbol. A document repeats an item if they
share ``WINDOW`` words in a row, or all the words of an item that has fewer. Any
``WINDOW`` words of an item hold one of its aligned blocks of ``(WINDOW + 1) // 2``
words, so the patterns of the automaton are these blocks and the shorter items as
wholes: no more symbols than the items have words. It reads each document once;
a block that is found is extended to either side, and the shared words are a span
if they are ``WINDOW`` or more. Words are looked up by a hash, so spans are held
against the words themselves. Spans are mapped back to code points of the
document as it was; those of an item that overlap are one.

ASCII and Latin-1 letters are folded to lower case; ASCII punctuation, U+00A0 to
U+00BF, U+2000 to U+207F and U+3000 to U+303F separate words.

The automaton is built once in each worker from the items, which travel with the
task. Building it took 150 MB for 17.7 MB of items, and it grows in proportion. The
size of the benchmark is counted before anything is collected. Up to
``ITEM_BYTES`` there is one automaton; a larger table is dealt to several, each
of which reads all texts, with the same result.

Defined results: null, empty and wordless documents have no hits; null and
wordless items, and items without an id, are never found; equal items are each
reported, whatever their length; ``least`` leaves out items of fewer words.
Repeated documents are each reported, and a document without ``doc_id`` without
it. A very long text is one slice of its own. An empty table has no hits, and an
empty benchmark leaves all documents. Other columns pass through, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphwell.llm import kernels
from glyphwell.llm.arrow import map_batches, pieces, record
from glyphwell.llm.automaton import Automaton
from glyphwell.llm.normal import Normalised

WINDOW = 13
#: Words that an item must have; fewer are left out.
LEAST = 1
#: Bytes of items that one automaton holds.
ITEM_BYTES = 64 << 20

_HITS = {"doc_id": pa.int64(), "item_id": pa.int64(), "start": pa.int64(), "stop": pa.int64()}
_HITS_SQL = "doc_id bigint, item_id bigint, start bigint, stop bigint"


def normalise(texts: list[str | None]) -> list[str]:
    """Each text's words with single spaces between them."""
    raw, starts = kernels.string_buffer(pa.array(texts, pa.string()))
    return [line.strip(" ") for line in Normalised(raw, starts).text().split("\n")[:-1]]


def word_hashes(n: Normalised) -> np.ndarray:
    return kernels.span_hashes(n.bytes, n.at + 1, n.at + 1 + n.last - n.first)


class Items:
    """Distinct normalised texts with their ids; in a worker, their words' numbers and the automaton."""

    def __init__(self, rows: list[tuple[int, str]], window: int = WINDOW, least: int = LEAST) -> None:
        by_text: dict[str, list[int]] = {}
        for item, text in sorted(rows):
            if text and len(text.split(" ")) >= least:
                by_text.setdefault(text, []).append(item)
        self.texts, self.ids, self.window = list(by_text), list(by_text.values()), window
        self.name = hash((tuple(self.texts), tuple(map(tuple, self.ids)), window))

    def build(self) -> None:
        raw, starts = kernels.string_buffer(pa.array(self.texts, pa.string()))
        hashes, counts = [], []
        for first, last in kernels.slices(starts):
            n = Normalised(raw[starts[first] : starts[last]], starts[first : last + 1] - starts[first])
            hashes.append(word_hashes(n))
            counts.append(np.bincount(n.row, minlength=last - first))
        hashes = np.concatenate(hashes)
        self.vocabulary = np.unique(hashes)
        self.numbers = np.searchsorted(self.vocabulary, hashes).astype(np.int32)
        self.begin = np.append(0, np.cumsum(np.concatenate(counts)))
        size = np.diff(self.begin)
        block = (self.window + 1) // 2
        whole = size < self.window
        pieces = np.where(whole, 1, size // block)
        item = np.repeat(np.arange(len(size)), pieces)
        length = np.where(whole, size, block)[item]
        at = (np.arange(len(item)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
        table = np.full((len(item), max(block, self.window - 1)), -1, np.int32)
        for k in range(table.shape[1]):
            inside = length > k
            table[inside, k] = self.numbers[(self.begin[item] + at)[inside] + k]
        patterns, which = np.unique(table, axis=0, return_inverse=True)
        which = which.ravel()
        order = np.argsort(which, kind="stable")
        self.place_item, self.place_at = item[order], at[order]
        self.places = np.searchsorted(which[order], np.arange(len(patterns) + 1))
        self.size = (patterns >= 0).sum(axis=1)
        self.shortest = int(self.size.min())
        self.automaton = Automaton(patterns, self.size, len(self.vocabulary))


_built: dict[int, Items] = {}


def built(items: Items) -> Items:
    """The items with their automaton, which a worker builds once."""
    if items.name not in _built:
        _built.clear()
        items.build()
        _built[items.name] = items
    return _built[items.name]


def _shared(items: Items, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Item, its first word, and first and last word (exclusive) of each run that it shares with words[low:high] of a sequence."""
    reached: dict[tuple[int, int], int] = {}  # where the last run of an item and an offset ends
    ends, which = items.automaton.find(words, low, high)
    sequence = np.searchsorted(low, ends, side="left") - 1
    for stop, p, q in zip(ends.tolist(), which.tolist(), sequence.tolist()):
        size, least, most = int(items.size[p]), int(low[q]), int(high[q])
        start = stop - size
        for k, at in zip(items.place_item[items.places[p] : items.places[p + 1]].tolist(), items.place_at[items.places[p] : items.places[p + 1]].tolist()):
            if start < reached.get((k, start - at), 0):
                continue
            own = items.numbers[items.begin[k] : items.begin[k + 1]]
            a, i = start, at
            while a > least and i > 0 and words[a - 1] == own[i - 1]:
                a, i = a - 1, i - 1
            b, j = stop, at + size
            while b < most and j < len(own) and words[b] == own[j]:
                b, j = b + 1, j + 1
            reached[k, start - at] = b
            if b - a >= min(items.window, len(own)):
                yield k, i, a, b


def scan(column: pa.Array, items: Items) -> Iterator[tuple[int, int, int, int]]:
    """Row, item, start and stop in code points of each span of the texts."""
    if not items.texts:
        return
    items = built(items)
    raw, starts = kernels.string_buffer(column)
    for first, last in kernels.slices(starts):
        part, at = raw[starts[first] : starts[last]], starts[first : last + 1] - starts[first]
        n = Normalised(part, at)
        if not len(n.first):
            continue
        hashes = word_hashes(n)
        number = np.searchsorted(items.vocabulary, hashes)
        number[number == len(items.vocabulary)] = 0
        known = items.vocabulary[number] == hashes
        # Runs of words of the vocabulary in one row; only those that are long enough are read.
        edge = np.flatnonzero(np.append(True, (known[1:] != known[:-1]) | (n.row[1:] != n.row[:-1])))
        size = np.diff(np.append(edge, len(known)))
        long = known[edge] & (size >= items.shortest)
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for k, i, a, b in _shared(items, number, edge[long], (edge + size)[long]):
            spans.setdefault((int(n.row[a]), k), []).extend(_verified(items, n, k, i, a, b))
        chars: dict[int, np.ndarray] = {}
        for (row, k), own in spans.items():
            if row not in chars:
                chars[row] = np.cumsum((part[at[row] : at[row + 1]] & 0xC0) != 0x80)
            merged: list[list[int]] = []
            for a, b in sorted(own):
                if merged and a < merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                start, stop = int(chars[row][n.first[a] - at[row]]) - 1, int(chars[row][n.last[b - 1] - 1 - at[row]])
                for item in items.ids[k]:
                    yield first + row, item, start, stop


def _verified(items: Items, n: Normalised, k: int, i: int, a: int, b: int) -> list[tuple[int, int]]:
    """The runs of words [a, b) of a slice that are the item's words from ``i`` on, letter by letter; all, unless hashes collide."""
    text = lambda w: n.bytes[n.at[w] + 1 : n.at[w] + 1 + n.last[w] - n.first[w]].tobytes()
    own = [w.encode() for w in items.texts[k].split(" ")]
    differ = [a - 1, *(w for w in range(a, b) if text(w) != own[i + w - a]), b]
    return [(x + 1, y) for x, y in zip(differ, differ[1:]) if y - x - 1 >= min(items.window, len(own))]


def item_groups(benchmark: DataFrame, window: int = WINDOW, least: int = LEAST, id_col: str = "item_id", text: str = "text") -> list[Items]:
    """The items, normalised; as many groups as their counted size asks for, of which each is collected by itself."""
    rows = benchmark.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null and length(text) > 0")
    groups = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES))
    out = []
    for g in range(groups):
        own = (rows if groups == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(groups)) == g)).toArrow()
        out.append(Items(list(zip(own.column(0).to_pylist(), normalise(own.column(1).to_pylist()))), window, least))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST, key: str = "doc_id") -> DataFrame:
    """Columns ``doc_id``, ``item_id``, ``start``, ``stop``: the spans of documents that repeat an item.

    Offsets count code points of the text from 0; ``stop`` is past the last.
    """
    out = None
    for items in item_groups(benchmark, window, least):

        def run(batch: pa.RecordBatch, items: Items = items) -> pa.RecordBatch | None:
            hits = list(scan(batch.column(1), items))
            if not hits:
                return None
            row, item, start, stop = map(list, zip(*hits))
            return record(_HITS, doc_id=batch.column(0).take(pa.array(row)), item_id=item, start=start, stop=stop)

        found = map_batches(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col("text").alias("text")), run, _HITS_SQL)
        out = found if out is None else out.union(found)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """``docs`` without those that repeat a benchmark item; columns and other rows as they came."""
    for items in item_groups(benchmark, window, least):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                clean = np.ones(batch.num_rows, bool)
                clean[[h[0] for h in scan(batch.column(batch.schema.names.index("text")), items)]] = False
                yield batch if clean.all() else batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\x{A0}-\x{BF}\x{2000}-\x{207F}\x{3000}-\x{303F}"


def _grams(table: str, key: str) -> str:
    """Runs of WINDOW words of a table's texts with their first and last code points."""
    return f"""SELECT {key}, gram, start, stop FROM (
        SELECT {key}, start, string_agg(w, ' ') OVER ahead AS gram, max(stop) OVER ahead AS stop, count(*) OVER ahead AS n FROM (
            SELECT {key}, k, lower(s) AS w, s, stop - length(s) AS start, stop FROM (
                SELECT {key}, k, s, sum(length(s)) OVER (PARTITION BY {key} ORDER BY k)::BIGINT AS stop FROM (
                    SELECT {key}, unnest(ss) AS s, generate_subscripts(ss, 1) AS k FROM (
                        SELECT {key}, regexp_extract_all(text, '[^{_GAP}]+|[{_GAP}]+') AS ss FROM {table})))
            WHERE regexp_matches(s, '^[^{_GAP}]'))
        WINDOW ahead AS (PARTITION BY {key} ORDER BY k ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)) WHERE n = {WINDOW}"""


#: For benchmarks of which no item has fewer than WINDOW words, and ids that name one document each.
ORACLE = f"""
    WITH docs AS ({_grams("documents", "doc_id")}), items AS ({_grams("benchmark", "item_id")}),
    hits AS (SELECT DISTINCT doc_id, item_id, docs.start, docs.stop FROM docs JOIN items USING (gram)),
    marked AS (SELECT *, CASE WHEN start < max(stop) OVER (PARTITION BY doc_id, item_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM hits),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, item_id ORDER BY start) AS run FROM marked)
    SELECT doc_id, item_id, min(start) AS start, max(stop) AS stop FROM runs GROUP BY doc_id, item_id, run
"""
