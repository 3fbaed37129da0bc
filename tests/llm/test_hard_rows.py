"""Every operator and pipeline stage: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphwell.llm import chunks, decontaminate, embedding, licenses, packing, quality, sharding, simhash, toxicity, urls

LONG = " ".join(f"word{k} stands here, alone." for k in range(30_000))
PROSE = "The river ran slowly past the old mill while the farmers carried their grain to the market in the morning light. "
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ITEM = "Which of the seven northern rivers carries the most water past the capital every year of all"


def rows():
    clean = [(k, PROSE.replace("river", f"stream number {k}") + f"It was the day {k} of a month that nobody counted.", "en", "a", 100) for k in range(1, 6)]
    bad = [(k, "$$$ BUY %%% NOW ### " * 12 + str(k), "en", "a", 100) for k in range(11, 15)]
    odd = [(None, "No number at all.", None, None, None), (20, None, "en", "a", 0), (21, "", "en", "a", 0), (22, "!!! ...", "en", "a", 7), (23, "日本語のテキスト", "ja", "a", 8), (24, " \n\t ", "en", "a", 4)]
    repeated = [(30, PROSE * 2, "en", "a", 1), (30, PROSE * 2, "en", "a", 1), (31, PROSE * 2, "en", None, 1)]
    return clean + bad + odd + repeated + [(40, LONG, "en", "a", len(LONG)), (41, f"Before. {ITEM}? After.", "en", "a", 1), (42, "you stupid worthless idiot, pathetic loser and moron, scum", "en", "a", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).cache()


@pytest.fixture(scope="module")
def labels(spark):
    known = [(k, 1, 0) for k in (1, 2, 3, 41, 30)] + [(k, 0, 0) for k in (11, 12, 13)] + [(42, 1, 1), (42, 1, 1), (None, 1, 1), (5, None, None), (999, 0, 1)]
    return spark.createDataFrame(known, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM + "?"), (2, ITEM), (3, None), (4, ""), (5, "Yes."), (None, ITEM)], "item_id bigint, text string")


def operators(docs, labels, benchmark):
    return {
        "quality": lambda d: quality.kept(d, labels),
        "drop_poor": lambda d: quality.drop_poor(d, labels),
        "packing": packing.pack,
        "chunks": chunks.repeats,
        "drop_repeats": chunks.drop_repeats,
        "leaks": lambda d: decontaminate.leaks(d, benchmark),
        "drop_leaks": lambda d: decontaminate.drop_leaks(d, benchmark),
        "licenses": licenses.detections,
        "sharding": sharding.place,
        "toxicity": lambda d: toxicity.toxic(d, labels),
        "simhash": simhash.near_copies,
        "drop_near": simhash.drop_near_copies,
    }


NAMES = list(operators(None, None, None))


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(name, spark, docs, labels, benchmark):
    assert operators(docs, labels, benchmark)[name](docs.where("false")).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_hard_rows_and_clashing_names(name, docs, labels, benchmark):
    """Extra columns with the names that operators use inside change nothing."""
    f = operators(docs, labels, benchmark)[name]
    names = ["key", "u", "v", "n", "row_key", "spans", "shard", "slot", "score", "start", "k", "Tie", "f0", "head", "words", "digest", "quality", "toxic"]
    wide = docs.select("*", *(F.lit("x").alias(c) for c in names))
    plain, extra = f(docs), f(wide)
    if plain.columns == docs.columns:
        assert extra.columns == wide.columns
    same = [c for c in plain.columns if c not in ("n_chars",)]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, plain.select(*same).collect())) == sorted(map(key, extra.select(*same).collect()))


@pytest.mark.parametrize("name", NAMES)
def test_only_nulls(name, spark, docs, labels, benchmark):
    f = operators(docs, labels, benchmark)[name]
    out = f(spark.createDataFrame([(None, None, None, None, None)] * 3, DOCS))
    kept = {"sharding": 3, "drop_leaks": 3, "drop_repeats": 3, "drop_near": 3}
    assert out.count() == kept.get(name, 0)


def ids(df, column="doc_id"):
    return sorted((r[0] for r in df.select(column).collect()), key=lambda x: (x is None, x))


def test_defined_results(docs, labels, benchmark):
    good = ids(quality.drop_poor(docs, labels))
    assert not {11, 12, 13, 14, 20, 21} & set(good) and {1, 2, 3, 4, 5, 40, 41, 42} <= set(good) and good.count(30) == 2
    assert {r.doc_id: r.duplicate_of for r in simhash.near_copies(docs).collect()}[31] == 30
    left = chunks.drop_repeats(docs).collect()
    assert {r.doc_id for r in left} >= {None, 1, 20, 21, 22, 23, 24, 40} and all(r.text == LONG for r in left if r.doc_id == 40)
    hits = decontaminate.leaks(docs, benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in hits) == [(41, 1), (41, 2)]
    text = next(r[1] for r in rows() if r[0] == 41)
    assert all(text[r.start : r.stop] == ITEM for r in hits)
    assert ids(decontaminate.drop_leaks(docs, benchmark)).count(41) == 0
    assert set(ids(toxicity.toxic(docs, labels))) == {42}
    assert ids(packing.pack(docs).where("doc_id in (20, 21, 24)")) == []
    assert packing.pack(docs).where("doc_id = 40").count() > 50


def test_labels_of_one_class_or_none(docs, labels, spark):
    for some in (labels.where("false"), labels.where("quality = 1")):
        assert quality.kept(docs, some).count() == docs.where("length(text) > 0").count()
        assert quality.drop_poor(docs, some).count() == docs.where("length(text) > 0").count()
    assert toxicity.toxic(docs.where("doc_id < 10"), labels.where("false")).count() == 0


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    table = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0]), (11, [3.0]), (None, [1.0, 0.0]), (12, [1.0, 0.1]), (12, [1.0, 0.1]), (13, [-1.0, 0.0]), (14, [1e-38, 1e-39])]
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<float>").select("*", *(F.lit(1).alias(c) for c in ("key", "v", "dim", "cell", "home")))
    out = {r.vec_id: r.duplicate_of for r in embedding.near_copies(df).collect()}
    assert out == {2: 1, 12: 1, 14: 1, 11: 10}
    assert embedding.near_copies(df.where("false")).count() == 0


def test_urls(spark):
    table = [(1, None), (2, ""), (3, "no host at all"), (4, "HTTPS://user:pw@Example.COM:80/A?b#c"), (None, "http://a.example/"), (5, "http://" + "x" * 100_000), (6, "http://ä.example/ö"), (6, "http://ä.example/ö")]
    df = spark.createDataFrame(table, "page_id bigint, url string").select("*", F.lit(1).alias("host"), F.lit(2).alias("path"))
    out = urls.judge(df).collect()
    assert len(out) == len(table) and not any(r.blocked for r in out if r.page_id in (1, 2))
    assert urls.judge(df.where("false")).count() == 0
    assert urls.parts_of("HTTPS://user:pw@Example.COM:80/A?b#c") == ("^example.com$", "^/a?b$")


def test_stages_keep_columns(spark, docs, labels, benchmark, tmp_path):
    """Each stage on hard rows and on no rows; all but the last return the columns of documents."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.where("false"), docs.limit(1).selectExpr("doc_id", "cast(null as string) text", "lang", "source", "n_chars")):
            out = stage(spark, table, str(tmp_path))
            if name != "harmonic_packing":
                assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
                assert out.count() <= table.count()
            elif table is not docs:
                assert out.count() == 0


def test_stages_pass_extra_columns(spark, docs, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["row_key", "row_key2", "spans", "key", "h1", "toxic", "quality", "turn", "n", "Again"]
    wide = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(names)))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, str(tmp_path))
        assert out.columns == wide.columns and {tuple(r[c] for c in names) for r in out.collect()} == {tuple(range(len(names)))}


def test_pipeline_of_no_documents(spark, docs, labels, benchmark, tmp_path):
    docs.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.where("false").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark, docs, labels, benchmark, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    found = set(ids(corpus_pipeline.run(spark, str(tmp_path))))
    assert {1, 40, 42} <= found and not {11, 31, 41, 20} & found  # 2 to 5 are near copies of 1
