"""Verification of a corpus of files: fingerprints, invariants of a conversion, a report that can be resumed.

A file is converted and checked in one task; the report holds a row for each file
and is appended to, so an interrupted run goes on with the files it lacks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphwell.functions import kernel, text as X
from glyphwell.functions.judge import Judge
from glyphwell.operators import classify, relations as R
from glyphwell.sources import office

REPORT = "in_hash string, path string, kind string, status string, converted bigint, untouched bigint, fonts bigint, out_hash string, out_entries_hash string, detail string"
DEFECTS = ("FAILED", "PANICKED")
_OFFICE, _LEGACY = ("docx", "xlsx", "pptx"), ("doc", "xls", "ppt")
_TEXT = tuple("txt csv tsv md json html htm py yaml yml ipynb sample rev idx pack".split())


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def entries(files: DataFrame) -> DataFrame:
    """``path``, ``at``, ``name``, ``sha``, ``size``, ``error`` of every entry of containers (``path``, ``content``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [(path, k, name, _sha(data), len(data), None) for k, (name, data) in enumerate(office.parts(content))]
                except Exception as e:  # a bad file is a row
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "at", "name", "sha", "size", "error"]).astype({"at": "Int64", "size": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, at bigint, name string, sha string, size bigint, error string")


def fingerprints(listed: DataFrame) -> DataFrame:
    """``path``, ``fingerprint``: one hash of the names and hashes of a container's entries, whatever their order or compression."""
    line = F.concat("name", F.lit("\0"), "sha", F.lit("\n"))
    return listed.where("name is not null").groupBy("path").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256).alias("fingerprint"))


def entry_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path``, ``name``, ``change``: entries that are missing, added, changed or identical."""
    a = before.where("name is not null").select("path", "name", F.col("sha").alias("old"))
    b = after.where("name is not null").select("path", "name", F.col("sha").alias("new"))
    change = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "added").when(F.col("old") == F.col("new"), "identical").otherwise("changed")
    return a.join(b, ["path", "name"], "full_outer").select("path", "name", change.alias("change"))


def entries_match(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path``, ``same_names``, ``all_identical``."""
    changes = entry_changes(before, after).groupBy("path")
    return changes.agg((F.count_if(F.col("change").isin("missing", "added")) == 0).alias("same_names"), (F.count_if(F.col("change") != "identical") == 0).alias("all_identical"))


def _joined(document: bytes) -> str:
    return _text_of(office.parts(document))


def _text_of(entries: Iterable[tuple[str, bytes]]) -> str:
    return "".join(t for name, xml in entries if office._TEXT_PART.match(name) for t, _ in office.runs_of_part(xml))


def legacy_fonts(document: bytes) -> list[str]:
    """The parts of a container that still name a legacy font where fonts are named."""
    return _legacy_fonts(office.parts(document))


def _legacy_fonts(entries: Iterable[tuple[str, bytes]]) -> list[str]:
    left = []
    for name, xml in entries:
        if office._TEXT_PART.match(name) or office._FONT_PART.match(name):
            made = office.rename_fonts(xml, "x")[1]
        elif name == X.METADATA_PART:
            made = office.rename_listed_fonts(xml, "x")[1]
        else:
            continue
        if made.fonts:
            left.append(name)
    return left


def check_office(content: bytes, judge: Judge, negative: bool = False, font: str = "Kalpurush") -> tuple:
    """Status, counts, hashes and detail of a container's conversion; ``negative``: no word may be converted."""
    bad = lambda why: ("FAILED", 0, 0, 0, "", "", why)
    try:
        old = list(office.parts(content))
        before = _text_of(old)
    except Exception as e:
        return bad(f"could not be read: {e}")
    try:
        out, made = office.convert_container(content, judge, font)
    except Exception as e:
        return bad(f"conversion failed: {e}")
    if negative and made.converted:
        return bad(f"{made.converted} words converted in a document that should stay as it is")
    try:
        new = list(office.parts(out))
        after = _text_of(new)
    except Exception as e:
        return bad(f"the converted file could not be read again: {e}")
    if not made.changed and old != new:
        return bad("nothing was converted, yet an entry differs")
    words = [t.split() for t in (before, after)]
    if len(words[0]) != len(words[1]):
        return bad(f"words changed: {len(words[0])} became {len(words[1])}")
    spaces = [len(t) - sum(map(len, own)) for t, own in zip((before, after), words)]
    if spaces[0] != spaces[1]:
        return bad(f"whitespace changed: {spaces[0]} became {spaces[1]}")
    if [n for n, _ in old] != [n for n, _ in new] or any(a != b and not (office._TEXT_PART.match(n) or office._FONT_PART.match(n) or n == X.METADATA_PART) for (n, a), (_, b) in zip(old, new)):
        return bad("entries changed that hold neither text nor fonts")
    if left := _legacy_fonts(new):
        return bad(f"a legacy font is left in {', '.join(left)}")
    if again := sum(made.converted for _, _, made in office.converted_parts(new, judge, font)):
        return bad(f"a second pass converted {again} more words")
    entries_hash = _sha("".join(sorted(f"{n}\0{_sha(b)}\n" for n, b in new)).encode())
    return ("ok" if made.converted else "untouched", made.converted, made.untouched, made.fonts, _sha(out), entries_hash, "")


def check_text(content: bytes, judge: Judge, negative: bool = False) -> tuple:
    text, _ = kernel.decode(content)
    out, converted, untouched = judge.convert(text)
    if negative and converted:
        return "FAILED", 0, 0, 0, "", "", f"{converted} words converted in text that should stay as it is"
    if not converted and out != text:
        return "FAILED", 0, 0, 0, "", "", "no word was converted, yet the text differs"
    return "ok" if converted else "untouched", converted, untouched, 0, _sha(out.encode()), "", ""


def check_bytes(content: bytes, kind: str, judge: Judge, negative: bool = False) -> tuple:
    if not content:
        return "unsupported", 0, 0, 0, "", "", "the file is empty"
    if kind in _OFFICE:
        return check_office(content, judge, negative)
    if kind in _TEXT:
        return check_text(content, judge, negative)
    return "unsupported", 0, 0, 0, "", "", "old Office formats are not read" if kind in _LEGACY else "not a kind that is converted"


def check_files(files: DataFrame, known: DataFrame, negative: bool = False) -> DataFrame:
    """A report row for each file (``path``, ``content``); a check that breaks is a row as well."""
    judge = classify.judge_of(known)
    if judge is None:
        raise ValueError(f"files are checked with word lists of at most {classify.BROADCAST_WORDS} entries")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                content, kind = bytes(content or b""), path.rpartition("/")[2].rpartition(".")[2].lower()
                try:
                    status, converted, untouched, fonts, out, out_entries, detail = check_bytes(content, kind, judge, negative)
                except Exception as e:  # a bad file is a row
                    status, converted, untouched, fonts, out, out_entries, detail = "PANICKED", 0, 0, 0, "", "", f"{type(e).__name__}: {e}"
                rows.append((_sha(content), path, kind, status, converted, untouched, fonts, out, out_entries, detail))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in REPORT.split(", ")])

    return files.select("path", "content").mapInPandas(run, REPORT)


def read_report(spark: SparkSession, folder: str) -> DataFrame:
    """The report in a folder; an empty one if there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(REPORT).parquet(folder) if there else spark.createDataFrame([], REPORT)


def verify(spark: SparkSession, files: DataFrame, known: DataFrame, folder: str, negative: bool = False) -> DataFrame:
    """Checks the files whose content the report in ``folder`` lacks, appends their rows, and returns tallies by kind and status.

    Of files of one content the first path is checked.
    """
    hashed = files.select("path", "content", F.sha2("content", 256).alias("in_hash"))
    first = hashed.groupBy("in_hash").agg(F.min("path").alias("path"))
    todo = R.not_yet_verified(first, read_report(spark, folder))
    check_files(files.join(todo.select("path"), "path", "left_semi"), known, negative).write.mode("append").parquet(folder)
    return tally(read_report(spark, folder))


def record_batches(stream: DataFrame, known: DataFrame, folder: str, checkpoint: str):
    """A streaming query that checks files as they come and appends a batch's rows at once."""

    def write(batch: DataFrame, _: int) -> None:
        check_files(batch, known).write.mode("append").parquet(folder)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def tally(report: DataFrame) -> DataFrame:
    return report.groupBy("kind", "status").agg(F.count("*").alias("files"), F.sum("converted").alias("converted"), F.sum("untouched").alias("untouched"), F.sum("fonts").alias("fonts"))


def defects(report: DataFrame) -> DataFrame:
    return report.where(F.col("status").isin(*DEFECTS))
