"""Word by word: legacy, not legacy or uncertain; and the conversion of what is legacy.

Documents are converted where they are: a text without a sign of the legacy range
has no legacy word and stays in native expressions, and any other is judged in one
Arrow batch step with the word lists at hand, so nothing is shuffled. Word lists
beyond ``BROADCAST_WORDS`` entries are joined to the distinct words instead.
Features and verdicts of words, for diagnosis, are columns of the distinct words.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from glyphwell.functions import judge as J, kernel, tables, text as X
from glyphwell.session import free_names

CONTEXT = J.CONTEXT
#: Largest lexicon that is broadcast, in entries; a longer one is joined by shuffle.
BROADCAST_WORDS = 2_000_000
#: Bytes of a batch's texts that Python works on at once.
SLICE_BYTES = 1 << 20


def lexicon(spark: SparkSession, bengali: list[str] | None = None, english: list[str] | None = None) -> DataFrame:
    """``word``, ``lang``: the shipped stems and guarded words and any further lists."""
    rows = [(w, "bn") for w in {*tables.words("stem"), *(bengali or [])}] + [(w, "en") for w in {*tables.words("guard"), *(english or [])}]
    df = spark.createDataFrame(rows, "word string, lang string")
    clean = F.when(F.col("lang") == "bn", X.clean_bengali("word")).otherwise(X.clean_english("word"))
    return df.select(clean.alias("word"), "lang").where("word is not null").distinct()


def _small(words: DataFrame) -> DataFrame:
    return F.broadcast(words) if words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS else words


def judge_of(known: DataFrame) -> J.Judge | None:
    """The judge of a lexicon, or None if that is too large to be at hand everywhere; its size is counted first."""
    if known.limit(BROADCAST_WORDS + 1).count() > BROADCAST_WORDS:
        return None
    rows = known.collect()
    return J.Judge(*(frozenset(r.word for r in rows if r.lang == lang) for lang in ("bn", "en")))


def struct_column(f: Callable[[str], tuple], fields: dict[str, str]) -> Callable[[Column], Column]:
    """``f`` over a string column in Arrow batches as a struct; null stays null. Equal values of a batch are worked out once."""
    return struct_column_of_all(lambda values: [f(v) for v in values], fields)


def struct_column_of_all(f: Callable[[list[str]], list[tuple]], fields: dict[str, str]) -> Callable[[Column], Column]:
    """The same of an ``f`` that takes many distinct values at once: those of a slice of a batch, so that memory follows the slice."""
    names = list(fields)
    kinds = {"string": pa.string(), "bigint": pa.int64(), "float": pa.float32()}
    made = pa.struct([(name, kinds[kind]) for name, kind in fields.items()])
    nothing = dict.fromkeys(names)

    @F.arrow_udf(f"struct<{', '.join(f'{name}: {kind}' for name, kind in fields.items())}>")
    def run(values: pa.Array) -> pa.Array:
        out = []
        step = max(1, len(values) * SLICE_BYTES // max(values.nbytes, 1))
        for at in range(0, len(values), step):
            own = values.slice(at, step).to_pylist()
            distinct = list(dict.fromkeys(v for v in own if v is not None))
            known = {v: dict(zip(names, row)) for v, row in zip(distinct, f(distinct))}
            out.append(pa.array([nothing if v is None else known[v] for v in own], made))
        return pa.concat_arrays(out) if out else pa.array([], made)

    return run.asNondeterministic()


def segments(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``at``, ``segment``, ``is_word`` of every run of words and gaps."""
    return docs.select(F.col(key), F.posexplode(X.segments(text)).alias("at", "segment")).withColumn("is_word", ~F.col("segment").rlike(f"^[{X.SPACE}]"))


def english_core() -> tuple[Column, Column]:
    word = F.col("word")
    core = F.regexp_replace(word, r"[‘’“”–—]+$", "")
    return core, core != word


def features(words: DataFrame, known: DataFrame) -> DataFrame:
    """The features of the distinct strings of the column ``word``, in one pass over them."""
    word = F.col("word")
    core, stripped = english_core()
    english = _small(known.where("lang = 'en'").select(F.col("word").alias("bare"), F.lit(True).alias("listed")))
    native = words.select("word").where("word is not null").distinct().select(
        "word",
        word.rlike(f"[{X.BENGALI}]").alias("has_bengali"),
        (~word.rlike(rf"[\p{{IsAlphabetic}}\p{{N}}{X.BIJOY}]")).alias("inert"),
        word.rlike(f"[{X.BIJOY}]").alias("has_exotic"),
        X.two_distinct(word, X.BIJOY).alias("two_exotic"),
        (X.count_of(word, X.BIJOY) * 10 >= F.length(word)).alias("dense"),
        F.length(F.regexp_replace(word, r"[^\p{IsAlphabetic}\p{N}]", "")).alias("alphanumeric"),
        X.roman_marker(word).alias("roman"),
        X.sub_or_superscript(word).alias("scripts"),
        X.lone_conjunct(word).alias("conjunct"),
        X.english_bare(core).alias("bare"),
        stripped.alias("stripped"),
        X.count_of(core, "A-Za-z").alias("core_letters"),
    )
    listed = native.join(english, "bare", "left")
    member = F.coalesce("listed", F.lit(False)) & (F.length("bare") >= 2)
    is_english = F.when(F.col("stripped"), (F.col("core_letters") >= 4) & member).otherwise(member)
    stop = F.col("has_bengali") | F.col("inert") | F.col("english") | F.col("roman") | F.col("scripts") | F.col("conjunct")
    judged = listed.withColumn("english", is_english).drop("bare", "listed", "stripped", "core_letters").withColumn("hard_stop", stop)
    # Words with a hard stop are null to the conversion, which passes them over.
    tried = judged.withColumn("converted", kernel.column_of_all(kernel.convert_all)(F.when(~F.col("hard_stop"), word)))
    bengali = _small(known.where("lang = 'bn'").select(F.col("word").alias("entry"), F.lit(True).alias("listed")))
    tried = tried.withColumn("entry", X.canonical(X.trim_to_bengali("converted"))).join(bengali, "entry", "left")
    plausible = F.coalesce(X.well_formed("converted") & X.opens_like_bengali("converted"), F.lit(False))
    return tried.withColumn("is_entry", F.coalesce("listed", F.lit(False))).withColumn("plausible", plausible).drop("entry", "listed")


def rule_name() -> Column:
    """The first rule that decides a word's features."""
    c = F.col
    return (
        F.when(c("has_bengali") | c("inert"), "hard_stop_unicode_or_inert")
        .when(c("english"), "hard_stop_english")
        .when(c("roman"), "hard_stop_roman_numeral_marker")
        .when(c("scripts"), "hard_stop_sub_or_superscript")
        .when(c("conjunct"), "hard_stop_lone_conjunct_glyph")
        .when(c("is_entry") & c("has_exotic"), "legacy_byte_and_dictionary")
        .when(c("dense") & c("two_exotic") & c("plausible"), "legacy_density")
        .when(c("is_entry") & (c("alphanumeric") >= 2), "uncertain_dictionary_word")
        .when(c("has_exotic") & c("plausible"), "uncertain_plausible")
        .when(c("is_entry"), "alphanumeric_floor")
        .otherwise("not_a_dictionary_word_and_not_plausible")
    )


def verdict(rule: Column) -> Column:
    return F.when(rule.startswith("legacy_"), "legacy").when(rule.startswith("uncertain_"), "uncertain").otherwise("not_legacy")


def word_table(words: DataFrame, known: DataFrame) -> DataFrame:
    """``word``, ``rule``, ``alone``, ``converted`` of the distinct words."""
    return features(words, known).select("word", rule_name().alias("rule"), "converted").withColumn("alone", verdict(F.col("rule")))


def with_context(rows: DataFrame, keys: list[str], order: str, alone: str = "alone", reach: int = CONTEXT) -> DataFrame:
    """``legacy``: legacy alone, or uncertain with a word within ``reach`` that is legacy alone."""
    near = Window.partitionBy(*keys).orderBy(order).rowsBetween(-reach, reach)
    seen = F.max((F.col(alone) == "legacy").cast("int")).over(near) == 1
    return rows.withColumn("legacy", (F.col(alone) == "legacy") | ((F.col(alone) == "uncertain") & seen))


def pieces(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``at``, ``out``, ``changed``, ``is_word``: every segment with its text after conversion, and whether that changed it."""
    if (judge := judge_of(known)) is None:
        return pieces_by_join(docs, known, key, text)
    return docs.select(key, F.posexplode(judged_pieces(judge)(F.col(text))).alias("at", "p")).select(key, "at", "p.segment", "p.out", "p.changed", "p.is_word")


def judged_pieces(judge: J.Judge) -> Callable[[Column], Column]:
    @F.pandas_udf("array<struct<segment string, out string, changed boolean, is_word boolean>>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else [dict(zip(("segment", "out", "changed", "is_word"), p)) for p in judge.pieces(v)])

    return run


def pieces_by_join(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same for a lexicon of any size: words without a sign of the legacy range stay out of the join in documents that have none."""
    parts = segments(docs, key, text)
    some = docs.where(F.col(text).rlike(f"[{X.BIJOY}]"))
    words = segments(some, key, text).where("is_word")
    table = word_table(words.select(F.col("segment").alias("word")), known)
    judged = with_context(words.join(table, F.col("segment") == F.col("word")), [key], "at")
    changed = judged.select(key, "at", "segment", F.when(F.col("legacy"), F.col("converted")).otherwise(X.compose_vowels("segment")).alias("out"), F.col("legacy").alias("changed"), F.lit(True).alias("is_word"))
    gaps = segments(some, key, text).where("not is_word")
    rest = segments(docs.where(~F.col(text).rlike(f"[{X.BIJOY}]")), key, text)
    same = lambda df: df.select(key, "at", "segment", F.when(F.col("is_word"), X.compose_vowels("segment")).otherwise(F.col("segment")), F.lit(False), "is_word")
    return changed.union(same(gaps)).union(same(rest))


def convert_documents(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``text``, ``converted``, ``untouched``: the documents with their legacy words in Unicode. A null or empty text has no words."""
    value = F.coalesce(F.col(text), F.lit(""))
    if (judge := judge_of(known)) is None:
        return convert_by_join(docs, known, key, text)
    some = value.rlike(f"[{X.BIJOY}]")
    made = struct_column(judge.convert, {"text": "string", "converted": "bigint", "untouched": "bigint"})(F.when(some, value))
    done = docs.select(F.col(key), value.alias("_text"), some.alias("_some"), made.alias("_made"))
    plain = F.size(X.words("_text")).cast("bigint")
    pick = lambda name, other: F.when(F.col("_some"), F.col(f"_made.{name}")).otherwise(other).alias(name)
    return done.select(key, pick("text", X.compose_vowels("_text")), pick("converted", F.lit(0).cast("bigint")), pick("untouched", plain))


def convert_by_join(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``convert_documents`` for a lexicon of any size; ``key`` names a document."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "out"))), lambda p: p["out"]), "")
    counts = [F.count_if("changed").alias("converted"), F.count_if(F.col("is_word") & ~F.col("changed")).alias("untouched")]
    found = pieces_by_join(docs, known, key, text).groupBy(key).agg(joined.alias("text"), *counts)
    empty = docs.where(F.coalesce(F.length(text), F.lit(0)) == 0).select(key, F.lit(""), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))
    return found.union(empty)


def convert_by_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``text``, ``lines``, ``lines_converted``, ``dominant``: whole documents judged line by line. Nulls stay null."""
    made = struct_column(J.convert_by_lines, {"text": "string", "lines": "bigint", "lines_converted": "bigint", "dominant": "string"})
    return docs.select(key, made(F.col(text)).alias("_made")).select(key, "_made.*")


def convert_if_legacy(df: DataFrame, text: str = "text") -> DataFrame:
    """``detect_lines`` of the column and ``converted``: its conversion if it is legacy as a whole, else as it is."""
    found = detect_lines(df, text)
    legacy = F.col("encoding") == "legacy"
    return found.withColumn("converted", F.when(legacy, kernel.column_of_all(kernel.convert_all)(F.when(legacy, F.col(text)))).otherwise(F.col(text)))


def looks_legacy(text: X.C) -> Column:
    """Whether a fragment may be legacy in a document that has legacy text."""

    @F.pandas_udf("boolean")
    def run(values: pd.Series) -> pd.Series:
        known = {v: J.looks_legacy(v) for v in values.dropna().unique()}
        return values.map(lambda v: None if v is None else known[v])

    return run(X._c(text))


def convert_counted(text: X.C) -> Column:
    """A struct of the forced conversion ``text`` and of ``guesses``, the vowel signs chosen without evidence."""
    return struct_column_of_all(kernel.convert_all_counted, {"text": "string", "guesses": "bigint"})(X._c(text))


def detect(text: X.C) -> dict[str, Column]:
    """A line's encoding by its characters alone, and the ratios behind it; trial conversions are left to ``detect_lines``."""
    text = X._c(text)
    considered = F.length(F.regexp_replace(text, f"[{X.SPACE}0-9]", ""))
    bengali = X.count_of(text, X.BENGALI)
    visible = F.length(F.regexp_replace(F.regexp_replace(text, f"[{X.SPACE}0-9]", ""), f"[^\\x21-\\x7E{X.SIGNAL}]", ""))
    exotic = F.length(F.regexp_replace(F.regexp_replace(text, f"[{X.SPACE}]", ""), f"[^{X.SIGNAL}]", ""))
    dense = (exotic * 10 >= considered) & X.two_distinct(F.regexp_replace(text, f"[{X.SPACE}]", ""), X.SIGNAL) & ~X.reads_as_english(text) & ~X.typography_only(text)
    return {"considered": considered, "bengali": bengali, "legacy_range": visible, "exotic": exotic, "dense": dense}


def detect_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``encoding``, ``confidence``, ``bengali_ratio`` and ``legacy_ratio`` of its text, in one pass over each line.

    The strict trial conversion runs where density doesn't decide. ``detect`` has the parts as columns.
    """
    fields = {"encoding": "string", "confidence": "float", "bengali_ratio": "float", "legacy_ratio": "float"}
    (found,) = free_names(df, "_found")
    made = df.withColumn(found, struct_column_of_all(J.detect_all, fields)(F.col(text)))
    values = {name: F.col(f"{found}.{name}") for name in fields}
    return made.withColumns(values | {"encoding": F.coalesce(values["encoding"], F.lit("not_bangla"))}).drop(found)
