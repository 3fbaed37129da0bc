"""Text sources: undecoded bytes, labelled tokens, word lists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphwell.functions import kernel, text as X

LABELLED = ("split", "doc", "label", "font", "token")


def decode(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with ``text`` and ``encoding``: UTF-8 where it is valid, else Windows-1252, of which five bytes have no character."""

    @F.pandas_udf("string")
    def western(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else kernel.from_windows_1252(bytes(b)))

    raw = F.col(content)
    valid = F.is_valid_utf8(raw.cast("string"))
    text = F.when(valid, F.regexp_replace(raw.cast("string"), "^\\uFEFF", "")).otherwise(western(F.when(~valid, raw)))
    return df.withColumn("text", text).withColumn("encoding", F.when(valid, "utf-8").when(raw.isNotNull(), "windows-1252"))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled tokens from tab-separated lines; the token comes last and may hold tabs. Another header is an error."""
    rows = spark.read.text(path)
    header = rows.first()
    if header is None or header[0].split("\t") != list(LABELLED):
        raise ValueError(f"the first line must be {LABELLED}")
    parts = F.split("value", "\t", 5)
    named = [F.get(parts, k).alias(n) for k, n in enumerate(LABELLED)]
    return rows.where(F.col("value") != "\t".join(LABELLED)).select(*named).withColumn("doc", F.col("doc").cast("bigint")).withColumn("font", F.when(F.col("font") != "", F.col("font")))


def word_list(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """The distinct entries of word lists, one a line, as they are looked up."""
    word = X.clean_bengali("value") if lang == "bn" else X.clean_english("value")
    return spark.read.text(path).select(word.alias("word"), F.lit(lang).alias("lang")).where("word is not null").distinct()


def write_labelled(tokens: DataFrame, path: str) -> None:
    """Labelled tokens as ``read_labelled`` reads them; every file begins with the header."""
    value = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in LABELLED))

    def headed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["\t".join(LABELLED)]})
        yield from batches

    tokens.select(value.alias("value")).mapInPandas(headed, "value string").write.text(path)


def write_dictionary(words: DataFrame, path: str) -> None:
    """The entries (``word``, ``lang``) once each, in the order of their bytes within a file and over all files."""
    words.select("word", "lang").distinct().orderBy("lang", "word").write.parquet(path)
