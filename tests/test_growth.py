"""What made queries outgrow their input: repeated work, and steps that cost more than they need."""

import random
import time

import regex

from glyphwell.functions import judge as J, kernel as K, tables, text as X
from glyphwell.operators import evaluate as E, relations as R, spans
from glyphwell.plans import catalog


def some_texts(n=400):
    """Texts of pieces that rules and repairs act on, with the batch's own separator in one of them."""
    rng = random.Random(3)
    every = [s for t in ("pre", "main", "corrections", "post") for pair in tables.rules(t) for s in pair] + [*tables.words("stem"), *"্ঁিাে \n", "a  b", "x"]
    return ["", "", "Kg©m~wP", *("".join(rng.choices(every, k=rng.randint(1, 9))) for _ in range(n))]


def test_batches_agree_with_single_texts():
    texts = some_texts()
    for t in ("pre", "main", "corrections", "post"):
        assert K.apply_all(texts, t) == [K._apply(s, t) for s in texts]
    assert K.convert_all_counted(texts) == [K.convert_counted(s) for s in texts]
    assert K.stem_hits_all(texts) == [sum(stem in K.decompose_nukta(s) for stem in K._stems()) for s in texts]
    assert K.apply_all([], "main") == K.convert_all([]) == K.stem_hits_all([]) == []
    assert len(list(K.together(["a" * K._TOGETHER, "b", "c"]))) == 2


def test_batches_search_once():
    """A rule costs one search a batch; one a word was ten times as long."""
    words = [f"{a}{b}{k}" for k, a in enumerate("abcdefghij" * 20) for b in "klmnopqrst"]
    began = time.process_time()
    one = [K._apply(w, "main") for w in words]
    middle = time.process_time()
    assert K.apply_all(words, "main") == one
    assert time.process_time() - middle < (middle - began) / 2


def test_words_of_every_space(spark):
    texts = ["", None, " ", "　", "a", *("x" + c + "y" + c + c + "z" + c for c in K._SPACES), "​not​space ﻿"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.words("t").alias("w")).collect()
    assert all(r.w == (None if r.t is None else regex.findall(f"[^{X.SPACE}]+", r.t)) for r in got) and len(got) == len(texts)



def test_filters_stay_behind_the_distinct_words(spark):
    """The rules run once over distinct words: a filter on their result once moved before that, to every word of every document, and ran them again."""
    d = "/root/testdata/sf0.001"
    words = catalog.bengali(spark, d).select("b")
    for made in (R.round_trip(catalog.bengali(spark, d).select(catalog.F.col("b").alias("word"))), E.preserved(words.withColumnRenamed("b", "word")), E.round_trip_accuracy(words.withColumnRenamed("b", "word"))):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        lines = plan.split("\n")
        generate = next(k for k, line in enumerate(lines) if "Generate" in line)
        first_distinct = max(k for k, line in enumerate(lines[:generate]) if "Aggregate" in line)
        assert not any("apply_all" in line or "replace(" in line.lower() or "EvalPython" in line or "RLIKE" in line for line in lines[first_distinct:]), plan[:3000]
        assert sum("Generate" in line for line in lines) <= 2  # the documents' words and the corner words, once each


def test_spans_agree_with_the_joins(spark):
    """In the documents as between tables: runs of every length and font, words over several runs, runs beyond the text, changed pieces over a run's end."""
    rng = random.Random(5)
    rows = []
    for k in range(60):
        text = None if k == 0 else "".join(rng.choices(["th", "a", "é", "𝒳", " ", " ", "\n", "this", "bath "], k=rng.randint(0, 40)))
        runs, at = [], 0
        for _ in range(rng.randint(0, 9)):
            stop = at + rng.randint(1, 12)
            runs.append((at, stop, rng.choice([None, "Arial", "SutonnyMJ", "+SutonnyMJ", "Bijoy", "SutonnyOMJ"])))
            at = stop + rng.choice([0, 0, 3])
        rows.append((k, text, None if k == 1 else runs))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs array<struct<start bigint, stop bigint, font string>>").repartition(3)
    tokens = spark.createDataFrame([(k, m.start(), m.end(), m.group()) for k, t, _ in rows for m in regex.finditer(f"[{X.SPACE}]+|[^{X.SPACE}]+", t or "")], "doc_id bigint, start bigint, stop bigint, segment string")
    length = {k: len(t or "") for k, t, _ in rows}
    runs = spark.createDataFrame([(k, *r) for k, _, rs in rows for r in rs or [] if r[0] < length[k]], "doc_id bigint, start bigint, stop bigint, font string")
    F = catalog.F
    want = {r.font: r.n for r in R.font_of_tokens(tokens.drop("segment"), runs, ["doc_id"]).groupBy("font").agg(F.count("*").alias("n")).collect()}
    assert {r.font: r.n for r in spans.font_counts(docs).collect()} == want and len(want) > 4
    changed = F.col("segment").startswith("th")
    pieces = tokens.select("doc_id", "start", "stop", changed.alias("changed"), F.when(changed, F.concat(F.upper("segment"), F.lit("!"))).otherwise(F.col("segment")).alias("text"))
    want = {(r.doc_id, r.start): r.out for r in R.text_of_runs(pieces, runs.drop("font"), ["doc_id"]).collect()}
    words = lambda t: [(*m.span(), m.group().upper() + "!") for m in regex.finditer(f"(?<![^{X.SPACE}])th[^{X.SPACE}]*", t)]
    got = spans.texts_of_runs(docs, words)
    assert {(r.doc_id, r.start): r.text for r in got.collect()} == want and any("!" in t for t in want.values())
    for made in (got, spans.font_counts(docs)):  # a document's segments are no rows
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Window" not in plan and "Generate" not in plan


def test_no_legacy_word_is_passed_over(spark):
    """Words that aren't converted at first are never legacy alone; the tables behind that move no consonant."""
    assert all(J.bones(a) == J.bones(b) for a, b in tables.rules("post"))
    stems = [s for s in tables.words("stem") if len(s) >= 2]
    judge = J.Judge(frozenset(K.compose_vowels(K.compose_nukta(s)) for s in stems), frozenset())
    rng = random.Random(9)
    glyphs = [a for a, _ in tables.rules("main") if a.strip()]
    words = [w for w in {*catalog.CORNERS, *map(K.to_legacy, stems), *("“" + K.to_legacy(s) + "”" for s in stems), *("".join(rng.choices(glyphs, k=rng.randint(1, 6))) for _ in range(4000))} if J._BIJOY.search(w)]
    may = judge.may_be_legacy(words)
    sure = [judge._alone(w)[0].startswith("legacy") for w in words]
    assert all(m for m, s in zip(may, sure) if s) and sum(sure) > 100 and not all(may)
    plain = [w for w, m in zip(words, may) if not m]
    made = dict(zip(words, K.convert_all(words)))
    assert all(J.bones(made[w]) == J.bones(K._apply(K._apply(K._apply(w, "pre"), "main"), "corrections")) for w in words) and plain


def test_lines_detected_together(spark):
    lines = [*catalog.CORNER_LINES, *some_texts(150), "1 2 3", "ß ü", "a" * 30 + "ÿ"]
    together = J.detect_all(lines)
    for line, (encoding, *shares) in zip(lines, together):
        one = J.detect(line)
        assert encoding == one[0] and all(abs(a - b) < 1e-6 for a, b in zip(shares, one[1:])), line


def test_tokens_judged_in_their_documents(spark):
    """Labels, rules and context as the table of tokens has them, and no row for a word."""
    F = catalog.F
    rng = random.Random(4)
    fonts = [None, "SutonnyMJ", "Arial", "Bijoy", "+SutonnyMJ", "SutonnyOMJ"]
    pool = [*catalog.CORNERS, *["bvg"] * 400, *["Kg©m~wP"] * 200, "the", "Avwg", "x", "1", "é1é"]
    some = [(w, f) for w in {*pool} for f in fonts]
    rows = spark.createDataFrame(some, "token string, font string").select("token", "font", X.token_label("token", "font").alias("label")).collect()
    assert all(J.token_label(r.token, r.font) == r.label for r in rows) and {r.label for r in rows} >= {*E.LABELS, "font_disputed", "other_legacy", "unknown_font"}
    texts = [None, "", *(" ".join(rng.choices(pool, k=rng.randint(1, 40))) for _ in range(60))]
    docs = spark.createDataFrame([(k, "test" if k % 5 else "tune", t) for k, t in enumerate(texts)], "doc bigint, split string, text string").repartition(3)
    label = lambda k, w: J.token_label(w, fonts[k % 3])
    tokens = spark.createDataFrame([(s, d, k, label(k, w), w) for d, s, t in docs.collect() for k, w in enumerate(J.words(t or ""))], "split string, doc bigint, pos int, label string, token string")
    known = catalog.classify.lexicon(spark, bengali=catalog._LEXICON_WORDS)
    want = {tuple(r) for r in E.judged_in_context(tokens, known).groupBy("label", "rule", "flagged").count().collect()}
    made = E.judged_documents(docs, lambda words: [label(k, w) for k, w in enumerate(words)], known)
    assert {tuple(r) for r in made.select("label", "rule", "flagged", "n").collect()} == want and len({w[2] for w in want}) == 2
    assert E.detection_with_context(made, "n").first() == E.detection_with_context(E.judged_in_context(tokens, known)).first()
    for name in ("refused_by", "context_window_6", "label_table_counts"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "SortMergeJoin" not in plan, name


def test_office_steps_give_back_pieces(spark, monkeypatch):
    """Texts of files are joined where they are read, in bounded pieces, and a container's conversion isn't run again to read it."""
    F = catalog.F
    files = spark.createDataFrame([(f"/{k}.docx", bytearray(catalog.office.write_docx(t))) for k, t in enumerate(["one\ttwo\nthree", "", "é\n\n"])] + [("/bad.docx", bytearray(b"-"))], "path string, content binary")
    got = {r.path: (r.text, r.error is None) for r in catalog.office.texts(files).collect()}
    assert got == {"/0.docx": ("onetwo\nthree\n", True), "/1.docx": ("\n", True), "/2.docx": ("é\n\n\n", True), "/bad.docx": (None, False)}
    assert {r.path: r.t for r in files.select("path", catalog.office.first_run("content").alias("t")).collect()} == {"/0.docx": "one", "/1.docx": "\n", "/2.docx": "é", "/bad.docx": None}
    plan = lambda name: catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan("office_rewrite").count("MapInPandas") == 1 and "Aggregate" not in plan("office_runs")
