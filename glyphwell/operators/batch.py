"""Batches of files: what is found, where each one goes, why one is refused, and the run over all of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from glyphwell.functions import text as X

SIX = ("docx", "xlsx", "pptx", "doc", "xls", "ppt")


def _name(path: X.C) -> Column:
    return F.regexp_extract(X._c(path), r"([^/]*)$", 1)


def destination(path: X.C, out: str | None = None, in_place: bool = False, folder: str | None = None) -> Column:
    """Where a file's conversion goes: ``out``, then in place, then a folder, then beside it; null for what isn't converted.

    Old formats never go in place of themselves.
    """
    path, kind = X._c(path), X.kind_of(path)
    if out is not None:
        return F.when(kind.isNotNull(), F.lit(out))
    beside = X.derived_name(path)
    made = F.concat(F.lit(folder.rstrip("/") + "/"), _name(beside)) if folder is not None else beside
    return F.when(kind == "office", path if in_place else made).when(kind == "legacy", F.lit(None).cast("string") if in_place else made)


def refusal(path: X.C) -> Column:
    """Why a file isn't converted, by its name alone; null if it is."""
    e = X.extension(path)
    return (
        F.when(X.kind_of(path) == "office", F.lit(None).cast("string"))
        .when(X.kind_of(path) == "legacy", "old Office formats are not read")
        .when(e == "json", "a data file, in which text is not told from keys")
        .when(e == "pdf", "pages are drawn, and their text has no order to convert")
        .otherwise("not a kind that is converted")
    )


def discover(paths: DataFrame) -> DataFrame:
    """``extension``, ``found``, ``skipped``: files of the six kinds, and lock files and our own results left out, in each folder of ``path``."""
    name = _name("path")
    left_out = name.startswith("~$") | F.contains(name, F.lit(".unicode."))
    rows = paths.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), X.extension("path").alias("extension"), left_out.alias("skip"))
    counted = rows.groupBy("folder", "extension").agg(F.count_if(~F.col("skip")).alias("found"), F.count_if("skip").alias("skipped"))
    return counted.where(F.col("extension").isin(*SIX) | (F.col("skipped") > 0))


def subfolders(paths: DataFrame, folder: str) -> DataFrame:
    """``folder``, ``subfolders``: how many folders with files are right below a folder."""
    below = F.regexp_extract(F.col("path"), "^" + _quoted(folder.rstrip("/")) + "/([^/]+)/", 1)
    return paths.select(below.alias("s")).where("s <> ''").agg(F.countDistinct("s").alias("subfolders")).select(F.lit(folder).alias("folder"), "subfolders")


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def plan(files: DataFrame, existing: DataFrame | None = None, force: bool = False, **where) -> DataFrame:
    """``path``, ``destination``, ``reason``: null reasons are files to convert. ``existing`` (``path``) holds names already taken.

    A destination that two files share is refused for both. A name already taken is refused unless ``force``; ``out`` and in-place results may replace.
    """
    rows = files.select("path", destination("path", **where).alias("destination"), refusal("path").alias("reason"))
    shared = rows.where("destination is not null").groupBy("destination").agg(F.count("*").alias("inputs")).where("inputs > 1")
    rows = rows.join(shared, "destination", "left")
    reason = F.coalesce("reason", F.when(F.col("inputs") > 1, "another file would be written to the same name"))
    if existing is not None and not force and not where.get("in_place") and where.get("out") is None:
        taken = existing.select(F.col("path").alias("destination"), F.lit(True).alias("taken")).distinct()
        rows = rows.join(taken, "destination", "left")
        reason = F.coalesce(reason, F.when(F.col("taken"), "the name is already taken"))
    return rows.select("path", "destination", reason.alias("reason"))


def run(files: DataFrame, known: DataFrame, existing: DataFrame | None = None, font: str = "Kalpurush", **where) -> DataFrame:
    """``path``, ``destination``, ``document``, counts and ``reason`` of every file of ``files`` (``path``, ``content``).

    Like a checking run this writes nothing; ``write_documents`` does. If any two
    files share a destination nothing is converted and a ValueError names one.
    """
    from glyphwell.sources import office

    planned = plan(files, existing, **where)
    if twice := planned.where("reason = 'another file would be written to the same name'").first():
        raise ValueError(f"more than one file would be written to {twice.destination}")
    todo = planned.where("reason is null")
    made = office.convert_files(files.join(todo.select("path"), "path", "left_semi"), known, font)
    found = planned.join(made, "path", "left")
    return found.select("path", "destination", "document", "converted", "untouched", "fonts_changed", F.coalesce("reason", "error").alias("reason"))


def tally(results: DataFrame) -> DataFrame:
    """One row: files converted, left as they were, and refused, with the words of all."""
    done = F.col("reason").isNull()
    return results.agg(
        F.count_if(done & (F.col("converted") > 0)).alias("files_converted"), F.count_if(done & (F.col("converted") == 0)).alias("files_unchanged"), F.count_if(~done).alias("files_refused"),
        F.coalesce(F.sum("converted"), F.lit(0)).alias("words_converted"), F.coalesce(F.sum("untouched"), F.lit(0)).alias("words_untouched"), F.coalesce(F.sum("fonts_changed"), F.lit(0)).alias("fonts_changed"),
    )


def write_documents(results: DataFrame) -> DataFrame:
    """Writes each ``document`` to its ``destination`` from the task that has it, by a name of its own that is then renamed; ``destination``, ``bytes``."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        for batch in batches:
            rows = []
            for destination, document in zip(batch["destination"], batch["document"]):
                where, path = fs.FileSystem.from_uri(destination if ":" in destination.split("/")[0] else f"file://{destination}")
                part = f"{path}.{uuid.uuid4().hex}.part"
                with where.open_output_stream(part) as out:
                    out.write(bytes(document))
                where.move(part, path)
                rows.append((destination, len(document)))
            yield pd.DataFrame(rows, columns=["destination", "bytes"])

    ready = results.where("reason is null and document is not null")
    return ready.select("destination", "document").mapInPandas(put, "destination string, bytes bigint")
