"""The judge of words and lines against its vectors, and against the same rules as column expressions."""

import time

import pytest

from glyphwell.functions import judge as J, kernel as K, tables
from glyphwell.operators import classify
from glyphwell.plans import catalog

BENGALI = ["কর্মসূচি", "প্রতিবেদন", "স্বাক্ষর", "নাম", "সাপ্তাহিক"]
ENGLISH = ["report", "total", "data", "year", "programme", "operations", "review", "team"]


@pytest.fixture(scope="module")
def known(spark):
    return classify.lexicon(spark, bengali=BENGALI, english=ENGLISH)


@pytest.fixture(scope="module")
def judge(known):
    return classify.judge_of(known)


@pytest.mark.parametrize("word,rule", {
    "প্রতিবেদন": "hard_stop_unicode_or_inert", "12.5%": "not_a_dictionary_word_and_not_plausible", "(a)": "not_a_dictionary_word_and_not_plausible", "...": "hard_stop_unicode_or_inert", "Report,": "hard_stop_english", "The": "hard_stop_english",
    "iv)": "hard_stop_roman_numeral_marker", "(vi)": "hard_stop_roman_numeral_marker", "(SO₂)": "hard_stop_sub_or_superscript", "²": "hard_stop_lone_conjunct_glyph",
    "Kg©m~wP": "legacy_byte_and_dictionary", "cÖwZ†e`b": "legacy_byte_and_dictionary", "¯^vÿi": "legacy_byte_and_dictionary", "bvg": "uncertain_dictionary_word", "report”": "hard_stop_english", "climax": "not_a_dictionary_word_and_not_plausible",
}.items())
def test_words_alone(judge, word, rule):
    got = judge.alone(word)[0]
    assert got == rule or rule.startswith("not_a") and not got.startswith(("legacy", "uncertain"))


def test_words_in_context(judge):
    assert [w is not None for w in judge.legacy(["Kg©m~wP", "bvg", "cÖwZ†e`b"])] == [True] * 3
    assert judge.legacy(["Programme", "operations", "bvg", "review", "team"]) == [None] * 5
    assert judge.legacy(["bvg"] * 5) == [None] * 5
    for apart in (5, 6, 7):  # six words away at most
        words = ["Kg©m~wP", *["1"] * (apart - 1), "bvg"]
        assert (judge.legacy(words)[-1] is not None) == (apart <= 6) and (judge.legacy(words[::-1])[0] is not None) == (apart <= 6)


def test_columns_agree_with_the_judge(spark, known, judge):
    words = [*catalog.CORNERS, *ENGLISH, "don’t", "Report”", "café—", "ab”", "naïve", "ñandú", "über", "1½", "Ⅳ.", "a\u0301b"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    words += [w for r in docs.collect() for w in (r.text or "").split()]
    table = classify.word_table(spark.createDataFrame([(w,) for w in words], "word string"), known).collect()
    assert len(table) == len(set(words))
    for r in table:
        rule, made = judge.alone(r.word)
        assert (r.rule, r.converted) == (rule, made), r.word


def test_documents_agree_with_the_join(spark, known):
    rows = [(k, t) for k, t in enumerate([None, "", " \n", "Kg©m~wP bvg  cÖwZ†e`b\n", "the bvg 1 2 3 4 5 6 7 Kg©m~wP bvg", "ক\u09c7\u09be plain", "কর্মসূচি café bvg", "bvg " * 20 + "¯^vÿi" + " bvg" * 20])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id between 100 and 140"))
    read = lambda df: sorted(tuple(r) for r in df.select("doc_id", "text", "converted", "untouched").collect())
    narrow = read(classify.convert_documents(docs, known))
    assert narrow == read(classify.convert_by_join(docs, known)) and sum(r[2] for r in narrow) > 20
    every = lambda df: sorted(tuple(r) for r in df.select("doc_id", "at", "segment", "out", "changed", "is_word").collect())
    assert every(classify.pieces(docs, known)) == every(classify.pieces_by_join(docs, known))


def test_conversion_moves_no_rows(spark, known):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = classify.convert_documents(docs, known)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1 and "ArrowEvalPython" in plan


def test_lines_agree_with_columns(spark):
    lines = [x for x in catalog.CORNER_LINES] + ["", "123", "The plan of the office is “done”", "Awd†mi bvgt", "Awd†mi bvgt Kg©m~wP", "কর্মসূচি and more of the English that there is", "E1: “Q1-Q18”"]
    got = classify.detect_lines(spark.createDataFrame([(x,) for x in lines], "line string"), "line").collect()
    for r in got:
        encoding, confidence, bengali, legacy = J.detect(r.line)
        assert r.encoding == encoding, r.line
        assert (r.confidence, r.bengali_ratio, r.legacy_ratio) == pytest.approx((confidence, bengali, legacy), abs=1e-5), r.line
    assert {r.encoding for r in got} == {"legacy", "unicode", "not_bangla"}


def test_documents_by_lines(spark):
    body = "Awd†mi bvgt Kg©m~wP cÖwZ‡e`b Ges"
    text = f"{body}\nAwd†mi bvgt\tE1: \"Q1-Q18\"\nThe plan of the office is done and was made\n•\n\nঅনিুযায়ী কর্মসূচি এবং\n"
    out, lines, converted, dominant = J.convert_by_lines(text)
    parts = J.lines(out)
    assert parts[0] == K.convert(body) and parts[2] == K.convert("Awd†mi bvgt") and parts[4] == 'E1: "Q1-Q18"' and "•" in parts
    assert "অনুযায়ী" in out and "The plan of the office is done and was made" in out and lines == len(parts) == len(J.lines(text)) and converted == 2
    assert J.convert_by_lines("") == ("", 0, 0, "not_bangla") and J.convert_by_lines("Awd†mi bvgt")[0] == "Awd†mi bvgt"
    assert J.convert_by_lines("The plan of the office is done")[3] == "not_bangla" and J.convert_by_lines("কর্মসূচি প্রতিবেদন")[3] == "unicode" and J.convert_by_lines(body)[3] == "legacy"
    rows = classify.convert_by_lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")).collect()
    assert [tuple(r) for r in rows] == [(1, out, lines, converted, dominant), (2, None, None, None, None), (3, "", 0, 0, "not_bangla")]


def test_fragments_that_look_legacy(spark):
    rows = {"Awd†mi bvgt": True, "the and of": False, "": False, "Kg©m~wP": True, "plain words": False, "ä": True, "£40": True, "123": False}
    got = spark.createDataFrame([(x,) for x in rows], "line string").select("line", classify.looks_legacy("line").alias("v")).collect()
    assert {r.line: r.v for r in got} == rows


def test_conversion_if_legacy_and_guesses(spark):
    df = spark.createDataFrame([("Awd†mi bvgt Kg©m~wP",), ("The plan of the office",), ("কর্মসূচি",)], "text string")
    got = {r.text: r.converted for r in classify.convert_if_legacy(df).collect()}
    assert got == {"Awd†mi bvgt Kg©m~wP": K.convert("Awd†mi bvgt Kg©m~wP"), "The plan of the office": "The plan of the office", "কর্মসূচি": "কর্মসূচি"}
    words = [K.to_legacy(w) for w in tables.words("stem")] + ["wKv", "Kzv"]
    counted = spark.createDataFrame([(w,) for w in words], "word string").select("word", classify.convert_counted("word").alias("c")).collect()
    assert all((r.c.text, r.c.guesses) == K.convert_counted(r.word) for r in counted) and sum(r.c.guesses for r in counted) >= 1


def test_long_words_cost_in_proportion():
    def seconds(n):
        text = "†K©v" * n
        began = time.process_time()
        K.rearrange(K._apply(text, "main"))
        return time.process_time() - began

    seconds(500)
    assert seconds(20_000) < 8 * seconds(5_000) + 0.2
