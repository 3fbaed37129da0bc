"""Evaluation: round trips, the character grid, dictionary hits, misspellings, detection by label, gates.

Every measure is a DataFrame of one row or of one row a group; words are converted
once each, and only counts meet on one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from glyphwell.functions import judge as J, kernel, text as X
from glyphwell.operators import classify, spans

LABELS = ("legacy", "legacy_ascii", "unicode", "english", "inert")
_MUST_NOT = ("unicode", "english", "inert")
#: Measure, whether a value should be at least or at most, and how much.
GATES = (("word_accuracy", "at_least", 0.99), ("grid_accuracy", "at_least", 1.0), ("recall", "at_least", 0.99), ("false_positives", "at_most", 0.001), ("false_positives_english", "at_most", 0.001))


def _ratio(hits: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(hits / total)


def _only(words: DataFrame, *flags: str) -> DataFrame:
    """``word`` is null where a flag isn't set; such rows stay, to be counted."""
    return words.select(F.when(F.col(flags[0]) & F.col(flags[1]), F.col("word")).alias("word"), *flags)


def trips(words: DataFrame) -> DataFrame:
    """``word``, ``got``, ``exact`` (but for nukta spellings), ``canonical``, ``size``, ``distance`` of each row of ``word``, and its other columns."""
    made = words.select("*", kernel.column_of_all(lambda values: kernel.convert_all([kernel.to_legacy(v) for v in values]))("word").alias("got"))
    a, b = X.canonical("word"), X.canonical("got")
    return made.select("*", (X.compose_nukta("word") == X.compose_nukta("got")).alias("exact"), (a == b).alias("canonical"), F.length(a).alias("size"), F.when(a == b, 0).otherwise(F.levenshtein(a, b)).alias("distance"))


def _accuracy(tried: DataFrame, **excluded: Column) -> DataFrame:
    """Sums over the rows with a ``word``, and counts of those rows of ``tried`` that were left out for a reason; one pass."""
    sums = tried.agg(*(F.count_if(c).alias(name) for name, c in excluded.items()), F.count("word").alias("words"), F.count_if("exact").alias("exact"), F.count_if("canonical").alias("right"), F.coalesce(F.sum("size"), F.lit(0)).alias("characters"), F.coalesce(F.sum("distance"), F.lit(0)).alias("wrong_characters"))
    wrong = F.least("wrong_characters", "characters")
    out = sums.withColumns({"word_accuracy": _ratio(F.col("right"), F.col("words")), "exact_accuracy": _ratio(F.col("exact"), F.col("words")), "character_accuracy": _ratio(F.col("characters") - wrong, F.col("characters"))})
    return out.select(*(c for c in out.columns if c not in excluded), *excluded)


def round_trip_accuracy(words: DataFrame) -> DataFrame:
    """Of a word list: accuracy of words and characters, with the words left out as of mixed scripts or ill formed."""
    listed = words.select("word").distinct().select("word", X.testable("word").alias("_in"), X.well_formed("word").alias("_well"))
    return _accuracy(trips(_only(listed, "_in", "_well")), mixed=~F.col("_in"), malformed=F.col("_in") & ~F.col("_well"))


def leading_mark(token: X.C) -> Column:
    """Whether a token opens with a mark, which no letter carries."""
    return X._c(token).rlike(f"^[{X.KAR}{X.HALANT}ঁ-ঃ]")


def grid(consonants: DataFrame, signs: DataFrame) -> DataFrame:
    """``word``: every consonant or conjunct with every sign; both lists are short and broadcast."""
    return consonants.select(F.col("word").alias("c")).crossJoin(F.broadcast(signs.select(F.col("word").alias("s")))).select(F.concat("c", "s").alias("word"))


def grid_accuracy(tokens: DataFrame) -> DataFrame:
    """Of a grid's tokens, but for those that open with a mark or are ill formed."""
    own = tokens.select("word", (~leading_mark("word")).alias("_in"), X.well_formed("word").alias("_well"))
    return _accuracy(trips(_only(own, "_in", "_well")), leading=~F.col("_in"), malformed=F.col("_in") & ~F.col("_well"))


def preserved(misspellings: DataFrame) -> DataFrame:
    """How many misspelt words come out of a round trip as they were; blank and mixed ones don't count."""
    word = F.regexp_replace("word", f"^[\\uFEFF{X.SPACE}]+|[{X.SPACE}]+$", "")
    return _accuracy(trips(misspellings.select(word.alias("word")).where((F.col("word") != "") & X.testable("word"))))


def dictionary_hits(tokens: DataFrame, wide: DataFrame, narrow: DataFrame, split: str = "test", times: str | None = None) -> DataFrame:
    """Of the legacy tokens of a split, how many are words of either list (``word``) after conversion. A row counts once, or ``times`` over."""
    made = tokens.where((F.col("split") == split) & (F.col("label") == "legacy")).groupBy("token").agg(_rows(times).alias("n"))
    made = made.withColumn("entry", X.canonical(X.trim_to_bengali(kernel.column_of_all(kernel.convert_all)("token")))).where("entry <> ''")
    lists = [known.select(F.col("word").alias("entry"), F.lit(True).alias(name)).distinct() for known, name in ((wide, "wide"), (narrow, "narrow"))]
    found = made.join(lists[0], "entry", "left").join(lists[1], "entry", "left")
    sums = found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in (("tokens", F.col("n")), ("in_wide", F.when(F.col("wide"), F.col("n"))), ("in_narrow", F.when(F.col("narrow"), F.col("n"))))))
    return sums.withColumns({"wide_rate": _ratio(F.col("in_wide"), F.col("tokens")), "narrow_rate": _ratio(F.col("in_narrow"), F.col("tokens"))})


def _rates(judged: DataFrame, times: str | None = None) -> DataFrame:
    """Recall, precision, F1 and false positives of ``flagged`` by ``label``; pure ASCII legacy stands apart. A row counts once, or ``times`` over."""
    n = F.col(times) if times else F.lit(1).cast("bigint")
    legacy, others = F.col("label") == "legacy", F.col("label").isin(*_MUST_NOT)
    count = lambda c, name: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("bigint").alias(name)
    sums = judged.agg(
        count(legacy & F.col("flagged"), "hits"), count(legacy, "legacy"), count(others & F.col("flagged"), "wrong"), count(others, "others"),
        count((F.col("label") == "english") & F.col("flagged"), "wrong_english"), count(F.col("label") == "english", "english"),
        count((F.col("label") == "legacy_ascii") & F.col("flagged"), "ascii_hits"), count(F.col("label") == "legacy_ascii", "ascii"),
    )
    c = F.col
    recall, precision = _ratio(c("hits"), c("legacy")), _ratio(c("hits"), c("hits") + c("wrong"))
    return sums.withColumns({
        "recall": recall, "precision": precision, "f1": F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0),
        "false_positives": _ratio(c("wrong"), c("others")), "false_positives_english": _ratio(c("wrong_english"), c("english")), "ascii_recall": _ratio(c("ascii_hits"), c("ascii")),
    })


def _of_split(tokens: DataFrame, split: str) -> DataFrame:
    return tokens.where((F.col("split") == split) & F.col("label").isin(*LABELS))


def _rows(times: str | None) -> Column:
    return F.sum(times) if times else F.count("*")


def detection(tokens: DataFrame, split: str = "test", times: str | None = None) -> DataFrame:
    """The line detector on single tokens (``split``, ``label``, ``token``), each distinct one judged once. A row counts once, or ``times`` over."""
    counted = _of_split(tokens, split).groupBy("label", "token").agg(_rows(times).alias("n"))
    judged = classify.detect_lines(counted, "token").withColumn("flagged", F.col("encoding") == "legacy")
    return _rates(judged, "n")


def judged_in_context(tokens: DataFrame, known: DataFrame, split: str = "test") -> DataFrame:
    """The tokens of a split with ``rule``, ``alone``, ``converted`` and ``flagged``; tokens of other labels are no context."""
    own = _of_split(tokens, split)
    table = classify.word_table(own.select(F.col("token").alias("word")), known)
    rows = own.join(table, F.col("token") == F.col("word")).drop("word")
    return classify.with_context(rows, ["doc"], "pos").withColumnRenamed("legacy", "flagged")


def judged_documents(docs: DataFrame, labels: Callable[[list[str]], list[str]], known: DataFrame, split: str = "test") -> DataFrame:
    """``label``, ``rule``, ``flagged``, ``n``: the words of a split's documents (``split``, ``text``) as ``judged_in_context`` has them, counted where the document is.

    ``labels`` gives those of a document's words. Neither a word nor a document is
    shuffled; a lexicon too large for that needs the table of tokens.
    """
    if (judge := classify.judge_of(known)) is None:
        raise ValueError(f"documents are judged with word lists of at most {classify.BROADCAST_WORDS} entries")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.slices(batches):
            counts: Counter = Counter()
            for text in batch.column("text").to_pylist():
                words = J.words(text or "")
                own = [(label, word) for label, word in zip(labels(words), words) if label in LABELS]
                rules = judge.rules([word for _, word in own])
                near = J.in_context({k: rule.startswith("legacy_") for k, rule in enumerate(rules) if rule.startswith(("legacy_", "uncertain_"))})
                counts.update((label, rule, k in near) for k, ((label, _), rule) in enumerate(zip(own, rules)))
            rows = [(*key, n) for key, n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.bool_(), pa.int64()))], ["label", "rule", "flagged", "n"])

    made = docs.where(F.col("split") == split).select("text").mapInArrow(count, "label string, rule string, flagged boolean, n bigint")
    return made.groupBy("label", "rule", "flagged").agg(F.sum("n").alias("n"))


def detection_with_context(judged: DataFrame, times: str | None = None) -> DataFrame:
    return _rates(judged, times)


def refused_by(judged: DataFrame, times: str | None = None) -> DataFrame:
    """``rule``, ``n``, ``share``: what kept pure ASCII legacy tokens from being converted. A row counts once, or ``times`` over."""
    lost = judged.where((F.col("label") == "legacy_ascii") & ~F.col("flagged")).groupBy("rule").agg(_rows(times).alias("n"))
    total = lost.agg(F.sum("n").alias("total"))
    return lost.crossJoin(F.broadcast(total)).select("rule", "n", (F.col("n") / F.col("total")).alias("share"))


def most_often(judged: DataFrame, label: str, flagged: bool, k: int = 20) -> DataFrame:
    """The ``k`` tokens of a label most often converted, or not, with what they would become."""
    own = judged.where((F.col("label") == label) & (F.col("flagged") == flagged)).groupBy("token").agg(F.count("*").alias("n"))
    return own.orderBy(F.desc("n"), "token").limit(k).withColumn("becomes", kernel.column_of_all(kernel.convert_all)("token"))


def gates(measures: DataFrame, wanted: tuple[tuple[str, str, float], ...] = GATES) -> DataFrame:
    """``gate``, ``value``, ``bound``, ``met`` of each column of a one-row table that has a gate."""
    have = [g for g in wanted if g[0] in measures.columns]
    rows = [F.struct(F.lit(n).alias("gate"), F.lit(how).alias("how"), F.col(n).cast("double").alias("value"), F.lit(b).alias("bound"), (F.col(n) >= b if how == "at_least" else F.col(n) <= b).alias("met")) for n, how, b in have]
    return measures.select(F.explode(F.array(*rows)).alias("g")).select("g.*")
