"""The operators against slow versions that state the same thing directly."""

import collections
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphwell.llm import automaton, chunks, components, decontaminate, embedding, kernels, licenses, packing, quality, sharding, simhash, toxicity, urls
from glyphwell.llm.normal import Normalised

WORDS = [f"{a}{b}{c}" for a in ("ba", "ce", "di", "fo", "gu", "hé") for b in ("l", "rn", "st", "m") for c in ("a", "in", "or", "et")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_span_hashes_do_not_depend_on_place():
    raw = np.frombuffer(b"abc xyz abc", np.uint8)
    h = kernels.span_hashes(raw, np.array([0, 4, 8]), np.array([3, 7, 11]))
    assert h[0] == h[2] != h[1]


def test_normalised_round_trip():
    texts = ["Hello,  WORLD!\nÉté «oui»", None, "", "...", "a—b", "日本 語"]
    raw, starts = kernels.string_buffer(pa.array(texts, pa.string()))
    n = Normalised(raw, starts)
    assert n.text().split("\n")[:-1] == [" hello world été oui ", " ", " ", " ", " a b ", " 日本 語 "]
    assert [raw[a:b].tobytes().decode() for a, b in zip(n.first, n.last)] == ["Hello", "WORLD", "Été", "oui", "a", "b", "日本", "語"]
    assert (n.origin(n.at + 1) == n.first).all() and n.starts[-1] == len(n.bytes)


@pytest.mark.parametrize("dim,tile", [(3, 40), (16, 64), (64, 1000)])
def test_embedding_pairs_are_all_found(spark, dim, tile):
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(120, dim))
    x = np.vstack((base, base[:40] + rng.normal(size=(40, dim)) * 0.1, base[:10] * 3))
    df = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x.astype(np.float32))], "vec_id bigint, embedding array<float>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= embedding.COSINE
    want = {}
    for k in range(len(x)):
        seen, todo = {k}, [k]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if j not in seen:
                    seen.add(int(j))
                    todo.append(int(j))
        if min(seen) < k:
            want[k] = min(seen)
    got = {r.vec_id: r.duplicate_of for r in embedding.near_copies(df, tile_rows=tile).collect()}
    assert got == want and len(want) >= 10


def groups_of(near):
    """The least member of each later member's component."""
    out, n = {}, len(near)
    for k in range(n):
        seen, todo = {k}, [k]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if j not in seen:
                    seen.add(int(j))
                    todo.append(int(j))
        if min(seen) < k:
            out[k] = min(seen)
    return out


def test_crowded_boxes_are_dealt_to_tiles(spark):
    """Vectors of one cell of the grid, of which a third are near copies of each other, and a few in other cells."""
    rng = np.random.default_rng(11)
    middle = rng.normal(size=24)
    x = np.vstack((middle + rng.normal(size=(90, 24)) * 0.12, middle + rng.normal(size=(120, 24)) * 0.45, rng.normal(size=(30, 24))))
    x = np.vstack((x, x[200:] + rng.normal(size=(40, 24)) * 0.05))
    df = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x.astype(np.float32))], "vec_id bigint, embedding array<float>")
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert {r.vec_id: r.duplicate_of for r in embedding.near_copies(df, tile_rows=15).collect()} == groups_of(unit @ unit.T >= embedding.COSINE)


def test_boxes_cover_the_grid():
    rng = np.random.default_rng(1)
    places = rng.integers(0, embedding.GRID, (500, 2))
    places[:80] = places[0]
    cell, count = np.unique(places @ [embedding.GRID, 1], return_counts=True)
    boxes = embedding.Boxes(cell, count, 2, 50)
    home = boxes.home(places)
    assert len(boxes.blocks) > 5 and max(boxes.blocks) == 2
    x = (places + 0.5) * (2 / embedding.GRID) - 1
    rows, leaves = boxes.within(x, 0.01)
    pairs = set(zip(rows.tolist(), leaves.tolist()))
    assert set(enumerate(home.tolist())) <= pairs
    leaf = {n: k for k, n in enumerate(boxes.leaf) if n >= 0}
    for i in range(0, 500, 17):
        for n, k in leaf.items():
            low, high = boxes.low[k] * (2 / embedding.GRID) - 1, boxes.high[k] * (2 / embedding.GRID) - 1
            assert ((np.maximum(0, np.maximum(low - x[i], x[i] - high)) ** 2).sum() <= 0.01) == ((i, n) in pairs)


def slow_features(text):
    words = re.findall(r"[^\W_]+", text)
    words = re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", text)
    low, raw = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in words], text.encode()
    share = lambda members: sum(chr(b) in members for b in raw) / (len(raw) + 20)
    same = [k > 0 and low[k] == low[k - 1] for k in range(len(low))]
    apart = [k > 1 and low[k] == low[k - 2] and not same[k] for k in range(len(low))]
    letters = sum(c.isascii() and c.isalpha() for c in text)
    return [
        sum(c.isascii() and c.isupper() for c in text) / (letters + 20), share("0123456789"), share("#$%&*+/<=>@[\\]^_`{|}~"), share("!?:;\"'()"),
        text.count("\n") / (len(words) + 20), sum(len(w.encode()) for w in words) / (len(words) + 5), sum(same) / (len(words) + 20), sum(apart) / (len(words) + 20),
    ]


def quality_texts():
    rng = random.Random(5)
    good = [prose(rng, rng.randint(20, 200)).capitalize() + "." for _ in range(60)]
    bad = [f(prose(rng, rng.randint(20, 200))) for _ in range(15) for f in (str.upper, lambda t: t.replace(" ", "$$$ "), lambda t: " ".join(w for x in t.split() for w in [x] * 9), lambda t: t.replace(" ", "\n1 "))]
    return good, bad


def test_quality_features_and_held_out_accuracy():
    good, bad = quality_texts()
    x, y = quality.features(pa.array(good)), quality.features(pa.array(bad))
    for text, f in zip([*good, *bad], [*x, *y]):
        assert list(f) == pytest.approx(slow_features(text))
    w = quality.rank(x[:30], y[:30])
    s, t = x[30:] @ w, y[30:] @ w
    assert (s[:, None] > t[None, :]).mean() > 0.99
    # The weights are the minimum of the loss of every pair.
    scale = np.vstack((x[:30], y[:30])).std(axis=0)
    scale[scale < 1e-12] = 1
    d = (x[:30, None] - y[None, :30]).reshape(-1, 8)
    loss = lambda v: np.logaddexp(0, -d @ v).mean() + quality.RIDGE / 2 * ((v * scale) ** 2).sum()
    assert all(loss(w) < loss(w + e * step / scale) for step in np.eye(8) for e in (0.05, -0.05))


def test_quality_query_against_its_definition(spark, tmp_path):
    good, bad = quality_texts()
    texts = [t for pair in zip(good, bad) for t in pair]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1 - k % 2) for k in range(40)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r.score for r in quality.query(spark, str(tmp_path)).collect()}
    f = np.array([slow_features(t) for t in texts])
    w = quality.rank(f[0:40:2], f[1:40:2])
    score = f @ w
    best = None
    for level in range(quality.LEVELS):
        q = np.sort(score)[max(int(np.ceil(level / quality.LEVELS * len(score))) - 1, 0)]
        balanced = (score[0:40:2] >= q).mean() + (score[1:40:2] < q).mean()
        if best is None or balanced > best[0] + 1e-12:
            best = balanced, q
    want = {k for k in range(len(texts)) if score[k] >= best[1] - 1e-9}
    assert set(got) == want and all(got[k] == pytest.approx(score[k], rel=1e-3, abs=1e-3) for k in got)


def test_quality_threshold_is_a_quantile(spark):
    scores = spark.createDataFrame([(float(k),) for k in range(1000)], "score double")
    x, y = np.arange(1000.0)[:, None], (np.arange(1000) >= 300).astype(int)
    assert quality.threshold(scores, x, y, np.ones(1)) == 300


def test_url_held_out_accuracy():
    hosts = sorted({urls.parts_of(u)[0] for u, _ in urls.LABELLED})
    held = {h for k, h in enumerate(hosts) if k % 5 == 0}
    model = urls.train([(u, y) for u, y in urls.LABELLED if urls.parts_of(u)[0] not in held])
    test = [(u, y) for u, y in urls.LABELLED if urls.parts_of(u)[0] in held]
    h, p = zip(*(urls.parts_of(u) for u, _ in test))
    blocked, y = model.probability(pa.array(h), pa.array(p)) >= model.block_at, np.array([y > 0 for _, y in test])
    assert blocked[y].mean() > 0.8 and blocked[~y].mean() < 0.03


def test_urls_that_the_table_lacks(spark):
    bad = ["http://www.mega-casino-bonus77.example.com/en/4.html", "https://m.hot-porn-videos.example.net/x", "http://cheap-viagra-rx.example.org/de/5", "https://poker-slots-royal.club/"]
    good = ["https://github.com/a/b", "https://stackoverflow.com/questions/1", "https://www.town-museum.example.org/en/3", "https://onlinesbi.sbi/", "https://www.sussex.ac.uk/", "https://news.ycombinator.com/item?id=3"]
    assert not {urls.parts_of(u)[0] for u in bad} & {urls.parts_of(u)[0] for u, _ in urls.LABELLED}
    out = urls.judge(spark.createDataFrame(list(enumerate(bad + good)), "page_id bigint, url string")).collect()
    assert [r.blocked for r in sorted(out, key=lambda r: r.page_id)] == [True] * len(bad) + [False] * len(good)
    tie = urls.judge(spark.createDataFrame([(1, bad[0])], "page_id bigint, url string"), block_at=next(r.unwanted for r in out if r.page_id == 0)).first()
    assert tie.blocked


def test_url_model_against_dense_regression():
    """The n-grams by a loop, and the loss at its minimum."""
    table = urls.LABELLED[::97]
    y = np.array([label for _, label in table], float)
    model = urls.fit([u for u, _ in table], y, 1e-3)
    names, rows = {}, []
    for u, _ in table:
        rows.append({names.setdefault((side, part[i : i + n]), len(names)) for side, part in enumerate(urls.parts_of(u)) for n in urls.SIZES for i in range(len(part) - n + 1)})
    x = np.zeros((len(rows), len(names)))
    for k, own in enumerate(rows):
        x[k, list(own)] = 1
    x *= np.log((1 + len(x)) / (1 + x.sum(axis=0))) + 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mass = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(4000):
        e = mass * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w, b = w - 3 * (x.T @ e + 1e-3 * w), b - 3 * e.sum()
    h, p = zip(*(urls.parts_of(u) for u, _ in table))
    assert model.probability(pa.array(h), pa.array(p)) == pytest.approx(1 / (1 + np.exp(-(x @ w + b))), abs=5e-3)


def test_url_grams():
    row, bucket = urls.grams(pa.array(["^ab$", ""]), pa.array(["^/$", "^/$"]))
    assert collections.Counter(row.tolist()) == {0: 2 + 1 + 1, 1: 1} and len(set(zip(row.tolist(), bucket.tolist()))) == len(row) and bucket[row == 1][0] in bucket[row == 0]


@pytest.mark.parametrize("capacity,classes,lane", [(10, 4, 1000), (64, 8, 7)])
def test_packing(spark, capacity, classes, lane):
    rng = random.Random(capacity)
    texts = [(k, " ".join("w" for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 25, 64, 130])))) for k in range(60)]
    texts += [(7, "a b c")] * 40 + [(None, "x y")] * 2 + [(8, "other words here")] * 2  # copies, and equal ids and lengths
    out = packing.pack(spark.createDataFrame(texts, "doc_id bigint, text string"), capacity, classes, lane).collect()
    bins, whole = collections.defaultdict(list), collections.Counter()
    for r in out:
        bins[r.lane, r["class"], r.bin].append(r)
        whole[r.doc_id] += r.words
    want = collections.Counter()
    for k, t in texts:
        want[k] += len(t.split())
    assert dict(whole) == {k: n for k, n in want.items() if n}
    for (_, k, _), rows in bins.items():
        assert sum(r.words for r in rows) <= capacity and len(rows) <= k and sorted(r.slot for r in rows) == list(range(len(rows)))
        assert all(r.words * k <= capacity and (k == classes or r.words * (k + 1) > capacity) for r in rows)
    short = collections.Counter((lane_, k) for (lane_, k, _), rows in bins.items() if len(rows) < k)
    assert all(n == 1 for n in short.values())
    lanes = collections.Counter(r.lane for r in out if r.doc_id == 7 and r.words == 3)
    assert max(lanes.values()) - min(lanes.values()) <= 1 and len(lanes) == max(1, -(-len(texts) // lane))


def test_shards_are_written_whole(spark, tmp_path):
    docs = spark.createDataFrame([(k % 7, f"t{k}", k) for k in range(200)], "doc_id bigint, text string, turn int")
    sharding.write_shards(docs, f"{tmp_path}/out", shards=3, file_rows=20)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.doc_id, r.text, r.turn) for r in out.collect()) == sorted((k % 7, f"t{k}", k) for k in range(200))
    where = {r.doc_id: r.shard for r in sharding.place(docs, shards=3).collect()}
    assert all(where[r.doc_id] == r.shard for r in out.collect())
    assert out.select("shard", "_metadata.file_path").distinct().count() > 3


def slow_cuts(data, span, least):
    gear = [int(g) for g in chunks._GEAR]
    rank = {}
    for i in range(chunks.WINDOW - 1, len(data)):
        h = 0
        for b in data[i - chunks.WINDOW + 1 : i + 1]:
            h = ((h << 1) + gear[b]) & 0xFFFFFFFF
        after = data[i + 1] if i + 1 < len(data) else 0
        rank[i] = (2, 0, i) if after & 0xC0 == 0x80 else (after != 32, h >> 1, i)
    chosen = sorted({min(range(p, p + span), key=rank.get) + 1 for p in range(chunks.WINDOW - 1, len(data) - span + 1)} - {len(data)})
    out, before, cut = {0, len(data)}, None, None
    for p in chosen:
        if before is None or p - before >= least or p - cut >= least:
            out.add(p)
            cut = p
        before = p
    return out


def test_chunks_against_a_rolling_loop():
    rng = random.Random(9)
    texts = [prose(rng, 300), "x", prose(rng, 5), "in " * 200, "日本語" * 100, prose(rng, 25), ""]
    data = [t.encode() for t in texts]
    raw, starts = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    edges = chunks.cuts(raw, starts)
    begin, end, row = chunks.passages(edges, starts)
    for k, d in enumerate(data):
        own = {int(e - starts[k]) for e in edges if starts[k] <= e <= starts[k + 1]}
        assert own == slow_cuts(d, chunks.SPAN, chunks.LEAST)
        for e in own:
            d[:e].decode()
        want = {(a, min(e for e in own if e >= a + chunks.RUN)) for a in own if any(e >= a + chunks.RUN for e in own)}
        assert {(int(a - starts[k]), int(b - starts[k])) for a, b, r in zip(begin, end, row) if r == k} == want


def test_passages_of_any_place_are_found():
    """A passage of WINDOW + 2 SPAN + RUN bytes between other words shares a chunk with itself, and most of 51 words do."""
    rng, hits = random.Random(6), 0
    for _ in range(60):
        own = []
        passage = prose(rng, 51)
        for _ in range(2):
            text = prose(rng, rng.randint(10, 90)) + " " + passage + " " + prose(rng, 60)
            raw = np.frombuffer(text.encode(), np.uint8)
            begin, end, _ = chunks.passages(chunks.cuts(raw, np.array([0, len(raw)])), np.array([0, len(raw)]))
            own.append({text.encode()[a:b] for a, b in zip(begin, end)})
        hits += bool(own[0] & own[1])
        assert own[0] & own[1] or len(passage.encode()) < chunks.WINDOW + 2 * chunks.SPAN + chunks.RUN
    assert hits >= 58


def repeat_table():
    rng = random.Random(2)
    passage = [prose(rng, 55) for _ in range(8)]
    table = [(k, prose(rng, 40) + ".\n" + passage[k % 8].capitalize() + ("!\n" if k % 2 else ", ") + prose(rng, 60), "en", "s", 0) for k in range(40)] + [(100 + k, prose(rng, 150), "en", "s", 0) for k in range(40)]
    twice = passage[0] + ". " + prose(rng, 30)
    return table + [(200, twice + " " + prose(rng, 9) + " " + twice, "en", "s", 0), (201, passage[3], "en", "s", 0), (201, passage[4], "en", "s", 0), (202, table[5][1], "en", "s", 0), (202, table[5][1], "en", "s", 0), (203, "Été " * 90, "fr", "s", 0), (204, "x " + "Été " * 90, "fr", "s", 0)]


def test_repeats_against_their_definition(spark):
    """Offsets and first documents, from the chunks' own texts."""
    table = repeat_table()
    docs = spark.createDataFrame(table, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(tuple(r) for r in chunks.repeats(docs).select("doc_id", "start", "stop", "first_doc_id").collect())
    first, every = {}, []
    for doc, text, *_ in set(table):
        raw, starts = kernels.string_buffer(pa.array([text]))
        n = Normalised(raw, starts)
        begin, end, _ = chunks.passages(chunks.cuts(n.bytes, n.starts), n.starts)
        seen = set()
        for a, b in zip(begin.tolist(), end.tolist()):
            words = n.bytes[a:b].tobytes()
            start = 0 if a == 0 else int(n.origin(np.array([a]))[0])
            stop = len(raw) if b == len(n.bytes) else int(n.origin(np.array([b]))[0])
            every.append((doc, text, start, stop, words, words in seen))
            seen.add(words)
            first[words] = min(first.get(words, doc), doc)
    want = []
    for key in {(e[0], e[1]) for e in every}:
        own = sorted((start, stop, first[w]) for doc, text, start, stop, w, again in every if (doc, text) == key and (again or first[w] < doc))
        runs = []
        for start, stop, source in own:
            if runs and start <= runs[-1][1]:
                runs[-1][1] = max(stop, runs[-1][1])
            else:
                runs.append([start, stop, source])
        want += [(key[0], *r) for r in runs]
    assert got == sorted(want) and len({d for d, *_ in got} & set(range(8, 40))) >= 31 and not {d for d, *_ in got} & set(range(100, 140))


def test_repeated_passages_are_found_and_cut(spark):
    table = repeat_table()[:80]
    docs = spark.createDataFrame(table, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    text = {r[0]: r[1] for r in table}
    out = chunks.repeats(docs).collect()
    assert len({r.doc_id for r in out}) >= 31 and {r.doc_id for r in out} <= set(range(8, 40)) and all(r.first_doc_id < r.doc_id and r.first_doc_id % 8 == r.doc_id % 8 for r in out)
    for r in out:
        assert text[r.doc_id].encode()[r.start : r.stop].decode()
    left = {r.doc_id: r for r in chunks.drop_repeats(docs).collect()}
    assert all(left[k].text == text[k] for k in range(100, 140)) and all(r.n_chars == len(r.text) for r in left.values() if r.n_chars)
    windows = collections.Counter(w for r in left.values() for w in {tuple(x[i : i + 50]) for x in [re.findall(r"\w+", r.text.lower())] for i in range(len(x) - 49)})
    assert max(windows.values()) == 1


def test_equal_hashes_of_documents_do_no_harm(spark, monkeypatch):
    """All documents share the first hash of their names; the second one tells them apart."""
    one = F.lit(5).cast("bigint")
    monkeypatch.setattr(chunks, "row_keys", lambda: (one, F.xxhash64("doc_id", "text")))
    monkeypatch.setattr(simhash, "row_keys", lambda: (one, F.xxhash64("doc_id", "text")))
    rng = random.Random(3)
    passage, other = prose(rng, 80), prose(rng, 90)
    table = [(1, "é" * 9 + " " + passage + " " + passage), (2, prose(rng, 100)), (3, other), (4, other)]
    docs = spark.createDataFrame(table, "doc_id bigint, text string")
    left = {r.doc_id: r.text for r in chunks.drop_repeats(docs).collect()}
    assert {k: left[k] for k in (2, 3, 4)} == dict(table[1:]) and len(left[1]) < len(table[0][1])
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == [1, 2, 3]


def slow_leaks(text, items, window, least):
    words = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
    out = set()
    for item, own in items:
        own = own.split()
        if len(own) < least:
            continue
        grams = {tuple(own[i : i + window]) for i in range(max(1, len(own) - window + 1))}
        n = min(window, len(own))
        spans = []
        for i in range(len(words) - n + 1):
            if tuple(w for w, _, _ in words[i : i + n]) in grams:
                if spans and words[i][1] <= spans[-1][1]:
                    spans[-1][1] = words[i + n - 1][2]
                else:
                    spans.append([words[i][1], words[i + n - 1][2]])
        out |= {(item, a, b) for a, b in spans}
    return out


@pytest.mark.parametrize("window,least", [(8, 4), (13, 1), (6, 2), (2, 1)])
def test_leaks_against_windows(window, least):
    rng = random.Random(4)
    items = [(k, prose(rng, rng.choice([1, 2, 3, 5, 8, 13, 30]))) for k in range(30)]
    items += [(99, items[4][1]), (100, "in in in in in in in in in in in in in in in in")]
    texts = ["in " * 40, "", None]
    for _ in range(60):
        parts = [prose(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            words = rng.choice(items)[1].split()
            a = rng.randint(0, max(0, len(words) - 14))
            parts += [rng.choice([" ", ", ", "\n"]).join(words[a:]).upper().replace("É", "é"), prose(rng, rng.randint(0, 9))]
        texts.append(" – ".join(parts))
    got = collections.defaultdict(set)
    for row, item, a, b in decontaminate.scan(pa.array(texts), decontaminate.Items(items, window, least)):
        got[row].add((item, a, b))
    for k, t in enumerate(texts):
        assert got[k] == slow_leaks(t or "", items, window, least)
    assert sum(map(len, got.values())) > 20


def test_equal_hashes_of_words_do_no_harm(monkeypatch):
    """Words are told apart by their length alone; spans are held against the letters."""
    monkeypatch.setattr(decontaminate, "word_hashes", lambda n: (n.last - n.first).astype(np.uint64))
    items = decontaminate.Items([(1, "one two six ten big"), (2, "red")], 5, 1)
    found = set(decontaminate.scan(pa.array(["one two six ten big", "one two six ten bag", "a red", "one red six ten big"]), items))
    assert found == {(0, 1, 0, 19), (2, 2, 2, 5), (3, 2, 4, 7)}


def test_automaton_against_substrings():
    rng = np.random.default_rng(3)
    patterns = sorted({tuple(rng.integers(0, 3, rng.integers(1, 6)).tolist()) for _ in range(40)})
    table = np.full((len(patterns), 5), -1, np.int32)
    for k, p in enumerate(patterns):
        table[k, : len(p)] = p
    text = rng.integers(0, 3, 3000)
    first, last = np.array([0, 700, 701, 2999]), np.array([700, 701, 2990, 3000])
    ends, which = automaton.Automaton(table, np.array(list(map(len, patterns))), 3).find(text, first, last)
    want = {(b, k) for f, l in zip(first, last) for k, p in enumerate(patterns) for b in range(f + len(p), l + 1) if tuple(text[b - len(p) : b].tolist()) == p}
    assert set(zip(ends.tolist(), which.tolist())) == want and len(ends) == len(want)


def test_any_number_of_automata_gives_the_same(monkeypatch, spark):
    rng = random.Random(1)
    items = [(k, prose(rng, n)) for k, n in enumerate([1, 3, 20, 40, 12, 13, 14])]
    bench = spark.createDataFrame([*items, (50, items[3][1]), (51, None), (52, "...")], "item_id bigint, text string")
    docs = spark.createDataFrame([(k, prose(rng, 20) + " " + items[k % 7][1] + ", " + prose(rng, 3)) for k in range(30)], "doc_id bigint, text string")
    rows = lambda: sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    left = lambda: sorted(r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect())
    assert len(decontaminate.item_groups(bench)) == 1
    whole, kept = rows(), left()
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 100)
    assert len(decontaminate.item_groups(bench)) > 3
    assert rows() == whole and left() == kept and len(whole) > 30


LICENSES = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under the Apache License,\nVersion 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "All rights reserved.": "Proprietary",
    "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0",
    "// SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
    "See https://www.gnu.org/licenses/lgpl-2.1 for more.": "LGPL-2.1",
    "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
    "This is free and unencumbered software released into the public domain.": "Unlicense",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "MIT",
    "available under the Creative Commons Attribution-ShareAlike 4.0 International license": "CC-BY-SA-4.0",
    "the Mozilla Public License 2.0": "MPL-2.0",
    "https://creativecommons.org/licenses/by-sa/3.0/": "CC-BY-SA-3.0",
    "under the GNU Affero General Public License v3.0": "AGPL-3.0",
}


@pytest.mark.parametrize("text,license", LICENSES.items())
def test_licenses(text, license):
    found = licenses.scan(f"Some words before. {text} And some after.")
    assert {licenses.RULES[n].license for *_, n in found} == {license}


def test_license_rules(spark):
    assert len(licenses.RULES) >= 300 and len({r.name for r in licenses.RULES}) == len(licenses.RULES)
    texts = list(LICENSES) + ["nothing here", "It is permitted to walk.", "licence to kill", "in the public\ndomain", "released into the public\u00a0domain", "COPYRIGHT (C) 1999-2004 Someone"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = collections.defaultdict(set)
    for r in licenses.detections(docs).collect():
        got[r.doc_id].add((r.license, r.rule, r.start, r.stop))
    compiled = [(n, rule, pattern) for _, rules in licenses._compiled() for n, rule, pattern in rules]
    for k, t in enumerate(texts):  # every rule over every text, without prefilters, and suppression by definition
        hits = [(r.priority, m.start(), m.end(), n) for n, r, p in compiled for m in p.finditer(t)]
        rank = {h: i for i, h in enumerate(sorted(hits, key=lambda h: (h[0], h[1] - h[2], h[1], h[3])))}
        alive = set()
        for h in sorted(hits, key=rank.get):
            if not any(a[1] <= h[1] and h[2] <= a[2] for a in alive):
                alive.add(h)
        assert got[k] == {(licenses.RULES[n].license, licenses.RULES[n].name, a, b) for _, a, b, n in alive}


def test_many_detections_in_one_text():
    """Suppression by definition, and four times the hits in less than eight times the time."""
    rng = random.Random(7)
    found = [(rng.choice([10, 20, 40]), a, a + rng.randint(1, 30), k) for k, a in enumerate(rng.choices(range(200), k=300))]
    kept = []
    for h in sorted(found, key=lambda h: (h[0], h[1] - h[2], h[1], h[3])):
        if not any(a[1] <= h[1] and h[2] <= a[2] for a in kept):
            kept.append(h)
    assert licenses.resolve(found) == sorted(kept, key=lambda h: (h[1], h[2], h[3]))

    def seconds(n):
        text = "Copyright (c) 2020 by someone, all rights reserved.\n" * n
        began = time.process_time()
        assert len(licenses.scan(text)) == 2 * n
        return time.process_time() - began

    seconds(100)
    assert seconds(8_000) < 8 * seconds(2_000) + 0.2


@pytest.mark.parametrize("shards,slots", [(1, 2), (3, 7), (7, 101), (50, 997)])
def test_table_is_filled_in_turns(shards, slots):
    names = sharding.shard_names(shards)
    table = sharding.fill(names, slots)
    orders = [[(sharding._number(f"offset/{n}") + j * (sharding._number(f"skip/{n}") % (slots - 1) + 1)) % slots for j in range(slots)] for n in names]
    want, turn = {}, 0
    while len(want) < slots:
        k = turn % shards
        want[next(s for s in orders[k] if s not in want)] = k
        turn += 1
    assert table == [want[s] for s in range(slots)]
    share = collections.Counter(table).values()
    assert max(share) - min(share) <= 1


def test_few_keys_move_with_a_new_shard():
    a, b = sharding.fill(sharding.shard_names(20), 10_007), sharding.fill(sharding.shard_names(21), 10_007)
    assert sum(x != y for x, y in zip(a, b)) / len(a) < 0.15


def test_label_model_finds_rates_and_correlations():
    rng = np.random.default_rng(0)
    n, v = 40_000, len(toxicity.VOTERS)
    y = rng.random(n) < 0.1
    fire = np.zeros((n, v), bool)
    fire[:, 0] = rng.random(n) < np.where(y, 0.8, 0.02)
    fire[:, 1] = np.where(rng.random(n) < 0.9, fire[:, 0], rng.random(n) < 0.1)  # a near copy of the first
    for k in (2, 3, 4):
        fire[:, k] = rng.random(n) < np.where(y, 0.7, 0.01)
    fire[:, -1] = rng.random(n) < np.where(y, 0.1, 0.9)
    masks = (fire.astype(np.int64) << np.arange(v)).sum(axis=1)
    patterns, counts = np.unique(masks, return_counts=True)
    model = toxicity.LabelModel(patterns, counts)
    assert model.rates[1, 2] == pytest.approx(0.7, abs=0.06) and model.rates[0, 2] == pytest.approx(0.01, abs=0.01) and model.prior == pytest.approx(0.1, abs=0.02)
    assert model.correlation[0, 1] > 0.5 > abs(model.correlation[2, 3])
    # The copy depends on the first voter, and given its vote hardly on the class.
    child, parent = (1, 0) if model.parent[1] == 0 else (0, 1)
    assert model.parent[child] == parent and model.parent[2] == -1
    assert abs(np.diff(np.log(model.given[:, child, 1]))[0]) < 0.3 < abs(np.diff(np.log(model.rates[:, child]))[0])
    assert ((model.posterior(masks) >= 0.5) == y).mean() > 0.97


def slow_votes(text):
    words = re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", text.lower())
    hits, out = 0, set()
    for name, entries in toxicity.LEXICONS.items():
        for entry in {tuple(e.split("-")) for e in entries.split()}:
            found = sum(tuple(words[i : i + len(entry)]) == entry for i in range(len(words)))
            if found:
                out.add(name)
    every = {tuple(e.split("-")) for entries in toxicity.LEXICONS.values() for e in entries.split()}
    hits = sum(tuple(words[i : i + len(e)]) == e for e in every for i in range(len(words)))
    letters = sum("a" <= c <= "z" for c in text.lower())
    for name, fires in (("several_insults", hits >= 3), ("dense_insults", hits >= 2 and hits * 50 >= len(words)), ("shouting", letters >= 40 and 2 * sum("A" <= c <= "Z" for c in text) > letters and hits > 0), ("sparse_insults", hits * 120 <= len(words))):
        if fires:
            out.add(name)
    return out


def test_votes_against_word_lists():
    rng = random.Random(12)
    entries = [e.replace("-", " ") for entries in toxicity.LEXICONS.values() for e in entries.split()]
    texts = ["", "YOU ARE STUPID, GO TO HELL NOW AND NEVER EVER COME BACK HERE AGAIN", "Va te faire, enculé!", "you you idiot"]
    texts += [" ".join(rng.choice([rng.choice(WORDS), rng.choice(WORDS), rng.choice(entries)]) for _ in range(rng.choice([3, 20, 300]))) for _ in range(60)]
    texts += [" ".join(rng.choice(WORDS) for _ in range(300)) + " idiot"]
    got = toxicity.votes(pa.array(texts))
    for text, mask in zip(texts, got):
        assert {n for k, n in enumerate(toxicity.VOTERS) if mask >> k & 1} == slow_votes(text), text[:80]


def test_label_model_against_enumeration():
    """The posterior is Bayes' rule over the product of each voter's rate given class and parent."""
    rng = np.random.default_rng(2)
    patterns = np.unique(rng.integers(1, 1 << len(toxicity.VOTERS), 300))
    model = toxicity.LabelModel(patterns, rng.integers(1, 50, len(patterns)))
    for pattern, got in zip(patterns[:40], model.posterior(patterns[:40])):
        bit = [int(pattern) >> k & 1 for k in range(len(toxicity.VOTERS))]
        odds = []
        for c in (0, 1):
            p = (1 - model.prior, model.prior)[c]
            for k, parent in enumerate(model.parent):
                rate = model.given[c, k, bit[parent] if parent >= 0 else 0]
                p *= rate if bit[k] else 1 - rate
            odds.append(p)
        assert got == pytest.approx(odds[1] / sum(odds), rel=1e-6, abs=1e-12)


def test_soft_logistic_regression_is_at_its_minimum():
    rng = np.random.default_rng(4)
    x = rng.random((60, 12)) < 0.3
    row, bucket = np.nonzero(x)
    target, weight = rng.random(60), rng.random(60)
    w, b = toxicity.fit(row, bucket * 11, target, weight, ridge=1e-2, rounds=200)
    loss = lambda w, b: ((np.logaddexp(0, x @ w + b) - target * (x @ w + b)) * weight / weight.sum()).sum() + 5e-3 * w @ w
    own = w[np.arange(12) * 11].astype(float)
    assert all(loss(own + e * s, b) >= loss(own, b) - 1e-7 for s in np.eye(12) for e in (0.05, -0.05)) and loss(own, b + 0.05) > loss(own, b) < loss(own, b - 0.05)


def test_toxicity_of_held_out_documents(spark):
    rng = random.Random(8)
    insults = ["idiot", "moron", "loser", "scum", "worthless", "pathetic", "zorgabla", "zorgabli"]
    table, labels = [], []
    for k in range(600):
        words = prose(rng, rng.randint(10, 80)).split()
        bad = k % 6 == 0
        for _ in range(rng.randint(2, 5) if bad else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(insults if k % 12 else insults[-2:]))
        table.append((k, " ".join(words)))
        if k < 300:
            labels.append((k, 1, int(bad)))
    docs = spark.createDataFrame(table, "doc_id bigint, text string")
    got = {r.doc_id for r in toxicity.toxic(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    want = {k for k in range(600) if k % 6 == 0}
    held = {k for k in want if k >= 300}
    assert len(got & held) >= 0.9 * len(held) and len(got - want) <= 5


@pytest.mark.parametrize("task_rows", [10_000, 15, 4])
def test_near_fingerprints_are_all_found(spark, task_rows):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, (150, 4), dtype=np.uint64)
    near = base[:60].copy()
    for row in near:
        for bit in rng.choice(64, rng.integers(0, simhash.RADIUS + 1), replace=False):
            row[0] ^= np.uint64(1) << np.uint64(bit)
    crowd = np.repeat(base[:1], 130, axis=0)  # near copies and others of one part's value
    for row in crowd:
        for bit in rng.choice(np.arange(8, 64), rng.integers(0, 14), replace=False):
            row[0] ^= np.uint64(1) << np.uint64(bit)
    f = np.unique(np.vstack((base, near, crowd)), axis=0)
    rows = [(k, *map(int, r.view(np.int64))) for k, r in enumerate(f)]
    df = spark.createDataFrame(rows, "key bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")
    how = simhash.plan(df, task_rows=task_rows)
    assert any(how.blocks) == (task_rows < 20)
    edges = simhash.near_edges(df, how).collect()
    first = np.bitwise_count(f[:, None, 0] ^ f[None, :, 0])
    every = np.bitwise_count(f[:, None] ^ f[None]).sum(axis=2)
    pairs = np.argwhere((first <= simhash.RADIUS) & (every <= simhash.FULL_RADIUS))
    joined = simhash.Forest(len(f))
    joined.add(*np.array([(e.u, e.v) for e in edges], int).reshape(-1, 2).T)
    roots = joined.root(np.arange(len(f)))
    assert (roots[pairs[:, 0]] == roots[pairs[:, 1]]).all() and len(pairs) > len(f)
    assert all(every[e.u, e.v] <= simhash.FULL_RADIUS for e in edges)
    assert all(first[e.u, e.v] <= simhash.RADIUS for e in edges)


def test_link_compares_each_pair_once(monkeypatch):
    """rows are sorted once and not for each mask, and no pair is compared from both sides; the trees are those of all near pairs."""
    rng = np.random.default_rng(11)
    bits, part_radius = tuple(range(16)), 2
    f = rng.integers(0, 2**63, (3000, 4), dtype=np.uint64)
    f[:, 0] &= ~np.uint64(0xFE0E)  # few values, so that they are crowded
    f[2000:2400] = f[:400]
    f[2400:] = f[0]
    for row in f[2000:]:
        for bit in rng.choice(64, rng.integers(0, simhash.RADIUS + 3), replace=False):
            row[0] ^= np.uint64(1) << np.uint64(bit)
    value = simhash.part_value(f[:, 0], bits)
    own = value % 2 == 0
    apart = np.bitwise_count(value[:, None] ^ value[None])
    first, every = np.bitwise_count(f[:, None, 0] ^ f[None, :, 0]), np.bitwise_count(f[:, None] ^ f[None]).sum(axis=2)
    candidate = np.triu((apart <= part_radius) & (own[:, None] | own[None]), 1)
    near = (first <= simhash.RADIUS) & (every <= simhash.FULL_RADIUS)
    i, j = np.nonzero(candidate & near)

    work = collections.Counter()
    count, sort = np.bitwise_count, np.lexsort
    monkeypatch.setattr(np, "bitwise_count", lambda x: work.update(compared=x.size) or count(x))
    monkeypatch.setattr(np, "lexsort", lambda keys: work.update(sorts=1) or sort(keys))
    got = simhash.link(f, own, bits, part_radius, simhash.RADIUS, simhash.FULL_RADIUS)
    monkeypatch.undo()
    assert (got.root(i) == got.root(j)).all() and len(i) > 1000
    assert all(near[u, v].all() for u, v in got.edges)
    assert work["sorts"] <= 10 and work["compared"] < 1.2 * candidate.sum() + (1 << 16)


def test_fewest_rows_are_sent(spark):
    """sub-cubes are as many as send the fewest rows, and a row isn't sent to a task of its own block alone."""
    rng = np.random.default_rng(5)
    f = rng.integers(0, 2**63, (2000, 4), dtype=np.uint64).view(np.int64)
    df = spark.createDataFrame([(k, *map(int, r)) for k, r in enumerate(f)], "key bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")
    how = simhash.plan(df, task_rows=100)
    sent = simhash.send(df, how)
    want = 0
    for bits, radius in zip(how.parts, how.radii):
        if radius >= 0:
            values, counts = np.unique(simhash.part_value(f[:, 0].view(np.uint64), bits), return_counts=True)
            want += min(simhash.rows_sent(values.astype(int), counts, cube, radius, 100)[radius] for cube in range(9))
    got = sent.groupBy("part", "cube", "tile").count().toPandas()
    assert got["count"].sum() == want < 2000 * 45
    assert got["count"].max() < 300


def test_simhash_against_counted_bits():
    rng = random.Random(13)
    texts = [prose(rng, n) for n in (1, 2, 7, 300, 600)] + ["Ba ba BA", "", "!!!", "日本語 と 英語", prose(rng, 40).upper() + ".\n"]
    prints, worded = simhash.simhashes(pa.array(texts))
    for text, own, has in zip(texts, prints, worded):
        words = {re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", text)}
        assert has == bool(text)
        if not words:
            continue
        for k, seed in enumerate(simhash._SEEDS):
            count = np.zeros(64, int)
            for w in words:
                raw = np.frombuffer(w.encode(), np.uint8)
                h = kernels.span_hashes(raw, np.zeros(1, np.int64), np.array([len(raw)]))
                h = int((kernels.mix64(h + seed) if k else h)[0])
                count += [h >> b & 1 for b in range(64)]
            assert int(own[k]) == sum(1 << b for b in range(64) if 2 * count[b] > len(words))


def test_one_row_of_each_group_stays(spark):
    """Groups of the fingerprints by brute force; the least id stays, nulls last, and one of equal rows."""
    rng = random.Random(21)
    base = [prose(rng, 120) for _ in range(12)]
    table = []
    for k in range(60):
        words = base[k % 12].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        table.append((None if k in (3, 30) else 60 - k, " ".join(words)))
    table += [table[5], table[5], (None, table[3][1]), (90, ""), (91, None), (90, "")]
    docs = spark.createDataFrame(table, "doc_id bigint, text string")
    prints, worded = simhash.simhashes(pa.array([t for _, t in table]))
    first, every = np.bitwise_count(prints[:, None, 0] ^ prints[None, :, 0]), np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    near = (first <= simhash.RADIUS) & (every <= simhash.FULL_RADIUS) & worded[:, None] & worded[None]
    head = groups_of(near)
    groups = collections.defaultdict(list)
    for k in np.flatnonzero(worded).tolist():
        groups[head.get(k, k)].append(table[k][0])
    want = sorted(min(own, key=lambda i: (i is None, i)) or -1 for own in groups.values())
    got = [r.doc_id for r in simhash.drop_near_copies(docs).where("length(text) > 0").collect()]
    assert sorted(-1 if i is None else i for i in got) == want and 10 <= len(got) < 20
    assert simhash.drop_near_copies(docs).count() == len(got) + 3


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5), (20, 21), *[(k, k + 1) for k in range(100, 150)]]
    out = {r.u: r.v for r in components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert out == {2: 1, 3: 1, 8: 7, 9: 7, 21: 20} | {k: 100 for k in range(101, 151)}
    assert components.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
