"""Nulls, empty and long texts, repeats, empty tables and clashing columns for every operator."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, licenses, linededup, lmscore, media, neardup, pieces, warc, webp
from tidemark.llm.components import connected_components
from tidemark.llm.scratch import new_path

LONG = " ".join(f"word{i % 977} tail" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, score string, n_lines string, label string"
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away\nReleased under the MIT License.", "en", "x", "y", "z"),
    (2, "The quick brown fox jumps over the lazy dog and runs away\nReleased under the MIT License.", "en", "x", "y", "z"),
    (2, "The quick brown fox jumps over the lazy dog and runs away\nReleased under the MIT License.", "en", "x", "y", "z"),
    (3, None, None, None, None, None), (4, "", "de", "x", "y", "z"), (5, " \t\n ", "fr", "x", "y", "z"), (6, "123 !!! ...", None, "x", "y", "z"),
    (None, "le renard brun saute par dessus le chien et le chat", "fr", "x", "y", "z"), (7, "é▁ 中文 \U0001f600 one", "fr", "x", "y", "z"), (8, LONG, "en", "x", "y", "z"),
    (9, "only four words here", "en", "x", "y", "z"), (10, "only four words here", "en", "x", "y", "z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_language(docs, none):
    model = language.fit(docs)
    out = language.identify(docs, model, spans=True)
    assert out.count() == len(ROWS) and out.schema["score"].dataType.simpleString() == "double"
    got = by_id(out)
    assert [got[i]["lang_pred"] for i in (3, 4, 5, 6)] == ["und"] * 4 and got[3]["score"] == 0
    assert got[1]["lang_pred"] in model.languages and sum(s["n_words"] for s in got[1]["lang_spans"]) == 17
    empty = language.fit(none)
    assert empty.languages == () and language.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, empty).collect()} == {"und"}


def test_mixed_text_has_a_span_for_each_language(spark):
    rows = [(i, " ".join(f"the thing was here number{i}" for _ in range(20)), "en") for i in range(5)] + [(9 + i, " ".join(f"être où déjà très français élan{i}" for _ in range(20)), "fr") for i in range(5)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    mixed = spark.createDataFrame([(1, "the thing was here the thing was here être où déjà très français être où déjà")], "doc_id long, text string")
    row = language.identify(mixed, language.fit(train), spans=True).first()
    assert [s["lang"] for s in row["lang_spans"]] == ["en", "fr"]


def test_viterbi_against_brute_force():
    import itertools

    rng = np.random.default_rng(0)
    model = language.LanguageModel(("a", "b", "c"), None, None, None, 1.5)
    scores = rng.normal(size=(11, 3)).astype(np.float32)
    first = np.array([0, 5, 5, 11])
    got = model.viterbi(scores, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b > a:
            value = lambda path: sum(scores[a + k, p] for k, p in enumerate(path)) - 1.5 * sum(x != y for x, y in zip(path, path[1:], strict=False))  # noqa: B023, E731
            assert value(got[a:b]) == pytest.approx(max(map(value, itertools.product(range(3), repeat=b - a))), abs=1e-4)


def test_line_dedup(docs, none):
    out = linededup.dedup(docs)
    assert out.columns == [*docs.columns[:4], "label", "n_lines", "n_kept"]
    got = by_id(out)
    assert got[1]["n_kept"] == 2 and got[2]["n_kept"] == 0 and got[2]["text"] == "" and got[3]["text"] is None
    assert got[10]["text"] == "" and got[9]["n_kept"] == 1 and got[5]["text"] == " \t\n " and got[8]["text"] == LONG
    assert linededup.dedup(none).count() == 0


def test_fuzzy_lines_meet(spark):
    base = "a fairly long line of text that says the same thing again and again until it ends somewhere beyond the hill"
    rows = [(1, base), (2, base.replace("hill", "hills")), (3, "something else entirely, which shares nothing with that other line at all")]
    got = by_id(linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i]["n_kept"] for i in (1, 2, 3)] == [1, 0, 1]


def test_one_word_edits_meet(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    rows, pairs = [], 0
    for size in range(40, 151, 2):
        for _ in range(4):
            left, right = (" ".join(word(5) for _ in range(size // 6 + 1))[: (size - 7) // 2] for _ in range(2))
            rows += [f"{left} {word(5)} {right}", f"{left} {word(5)} {right}"]
            pairs += 1
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in rows]
    want = [len(p & q) >= 0.6 * len(p | q) for p, q in zip(sets[::2], sets[1::2], strict=True)]  # brute force
    got = by_id(linededup.dedup(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")))
    met = [got[2 * i + 1]["n_kept"] == 0 for i in range(pairs)]
    assert sum(want) >= 0.95 * pairs and not any(m and not w for m, w in zip(met, want, strict=True))
    assert sum(met) >= 0.98 * sum(want)


def test_line_components_against_all_pairs(spark):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(60)]
    lines = [" ".join(rng.choice(words, rng.integers(5, 30))) for _ in range(40)]
    for _ in range(260):  # edited copies of edited copies, and one large group
        line = (lines[int(rng.integers(len(lines)))] if rng.random() < 0.5 else lines[0]).split(" ")
        for _ in range(int(rng.integers(1, 5))):
            line[int(rng.integers(len(line)))] = str(rng.choice(words))
        lines.append(" ".join(line))
    texts = ["\n".join(lines[i : i + 3]) for i in range(0, len(lines), 3)]
    flat = [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n"))]
    sets = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for _, _, x in flat]
    parent = list(range(len(flat)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(flat)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if flat[a][2] == flat[b][2] or both >= 0.6 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = by_id(linededup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), chunk_bytes=2000))
    # Rows of a key have one text, so places are in the order of keys and line numbers.
    wrong = 0
    for i, t in enumerate(texts):
        want = [x for n, (j, _, x) in enumerate(flat) if j == i and find(n) == n]
        wrong += len(set(want) ^ set(got[i]["text"].split("\n")) - {""})
    assert wrong <= 2  # the bands lose a few pairs at the threshold


def test_lines_with_clashing_names_and_text_keys(spark):
    rows = [("b", "the same line of text here", 1, 2, 3, 4, 5, 6), (None, "the same line of text here", 1, 2, 3, 4, 5, 6), ("a", "another line of text, quite unlike\nx", 1, 2, 3, 4, 5, 6)]
    names = "_id", "_row_hash", "gone", "id", "row_hash", "`a.b`"
    docs = spark.createDataFrame(rows, "key string, text string, " + ", ".join(f"{n} long" for n in names))
    out = linededup.dedup(docs, key="key")
    assert out.columns == [*docs.columns, "n_lines", "n_kept"]
    got = {r["key"]: r for r in out.collect()}
    assert (got[None]["n_kept"], got["b"]["n_kept"], got["a"]["n_kept"]) == (1, 0, 2)
    assert all(tuple(r)[2:8] == (1, 2, 3, 4, 5, 6) for r in got.values())


def test_near_duplicates(docs, none):
    out = neardup.link(docs)
    assert out.count() == len(ROWS)
    got = by_id(out)
    assert (got[2]["component_id"], got[10]["component_id"], got[9]["n_shingles"]) == (1, 9, 1)
    assert all(got[i]["component_id"] == i and got[i]["n_shingles"] == 0 for i in (3, 4, 5)) and got[None]["component_id"] is None and got[None]["kept"]
    assert neardup.link(none).count() == 0


def test_near_duplicates_at_the_threshold(spark):
    base = [f"w{i}" for i in range(104)]  # 100 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[:79])), (3, " ".join(base[:78]))]  # 75 and 74 of them
    got = by_id(neardup.link(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[2]["component_id"] == 1 and got[3]["component_id"] == 1  # 74 of 75 link the third through the second


def test_edited_group_is_one_component(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        text = list(base)
        for k in rng.integers(0, 200, rng.integers(0, 8)):
            text[k] = f"x{i}_{k}"
        rows.append((i, " ".join(text)))
    got = by_id(neardup.link(spark.createDataFrame(rows, "doc_id long, text string")))
    from tests.llm.test_queries import brute_components

    assert {i: r["component_id"] for i, r in got.items()} == {i: c for i, (_, c) in brute_components(dict(rows)).items()}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_leaks(spark, docs, none):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "nothing of this sort stands in any text whatever")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(1, 1), (2, 1)}
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0


def test_paraphrase_is_caught_and_fragment_is_not(spark):
    item = "the ancient harbour town exports copper salt and timber through three narrow canals. Which canal carries most copper northward"
    filler = " ".join(f"filler{i} of the town" for i in range(60))
    near = item.replace("narrow", "slim").replace("exports", "ships")
    rows = [(1, f"{filler} {near} {filler}"), (2, f"{filler} ancient harbour town {filler}"), (3, filler)]
    got = {r["doc_id"] for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1}


def test_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 5, 30).tolist(), tuple(rng.integers(0, 5, 12).tolist())
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == table[-1][-1]


def test_licenses(docs, none):
    got = by_id(licenses.scan(docs))
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["base_labels"], got[1]["score"]) == (1, 13, "mit", 1.0)
    assert (got[3]["n_words"], got[3]["n_base"], got[3]["first_word"], got[3]["labels"], got[3]["score"]) == (0, 0, None, "", 0.0)
    assert licenses.scan(docs).count() == len(ROWS) and licenses.scan(none).count() == 0


def test_wrapped_notices(spark):
    import textwrap

    long_ones = [t for t in licenses.TEMPLATES if len(t.text) > 80]
    rows = [(i, textwrap.fill("some words before it " + t.text + " and some after", width, initial_indent=" * ", subsequent_indent=" * ")) for i, (t, width) in enumerate((t, w) for t in long_ones for w in (40, 72, 80))]
    rows.append((99, "Permission is\n\nnothing like a notice\nof any kind"))
    got = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert len(long_ones) >= 4 and all(long_ones[i // 3].label in got[i]["labels"].split(",") for i in range(3 * len(long_ones)))
    assert (got[99]["labels"], got[99]["score"]) == ("", 0.0)


def test_lm_scores(docs, none):
    out = lmscore.score(docs, F.col("doc_id") != 9, steps=5)
    got = by_id(out)
    assert out.count() == len(ROWS) and (got[3]["n_tokens"], got[4]["n_tokens"], got[8]["n_tokens"]) == (1, 1, 60_001)
    assert got[3]["score"] == pytest.approx(got[4]["score"]) and all(np.isfinite(r["score"]) for r in got.values())
    assert lmscore.score(none, F.lit(True), steps=2).count() == 0
    assert {r["n_known"] for r in lmscore.score(docs, F.lit(False), steps=2).collect()} == {0}


def test_attention_windows_score_each_subword_once():
    from tidemark.llm import attention

    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = rng.integers(0, 90, 6)
        first = np.concatenate(([0], np.cumsum(lengths)))
        ids = rng.integers(0, 9, first[-1])
        _, _, where = attention.windows(ids, first, np.arange(10), 5)
        assert sorted(where[where >= 0].tolist()) == list(range(first[-1]))


def test_attention_is_a_distribution_and_learns():
    from tidemark.llm import attention

    rng = np.random.default_rng(0)
    ids = np.tile(np.arange(6), 400)
    first = np.array([0, len(ids)])
    places = np.arange(7)
    x, target, where = attention.windows(ids, first, places, 6)
    w = attention.train(x, target, where >= 0, 8, 7, steps=150)
    model = attention.AttentionModel(places, 6, np.zeros(7, np.float32), w)
    assert model.log_probabilities(ids, first).mean() > -0.3
    head = ids[:20]
    total = sum(np.exp(model.log_probabilities(np.append(head, k), np.array([0, 21]))[-1]) for k in range(7))
    assert total == pytest.approx(1, abs=1e-4)
    del rng


def test_pieces(docs, none):
    counted = by_id(pieces.token_counts(docs))
    assert (counted[3]["n_pieces"], counted[3]["best_score"], counted[4]["n_pieces"]) == (0, 0.0, 0)
    drawn = pieces.encode_sampled(docs, digest=True)
    assert drawn.count() == len(ROWS) and drawn.filter("not lossless").count() == 0
    one = {r["doc_id"]: r["piece_ids"] for r in pieces.encode_sampled(docs).collect()}
    two = {r["doc_id"]: r["piece_ids"] for r in pieces.encode_sampled(docs.repartition(5)).collect()}
    assert one == two and one[4] == []
    assert {r["doc_id"]: r["piece_ids"] for r in pieces.encode_sampled(docs, seed=5).collect()}[8] != one[8]
    assert pieces.encode_sampled(none).count() == 0 and pieces.token_counts(none).count() == 0


def test_sampler_draws_in_proportion():
    import pyarrow as pa

    vocabulary = pieces.Vocabulary((b" ", b"a", b"b", b"ab", b" a"), np.arange(5, dtype=np.int32), np.array([-1.0, -1.0, -1.5, -1.0, -0.5]), np.arange(5, 261, dtype=np.int32), tuple([b" ", b"a", b"b", b"ab", b" a"] + [bytes([i]) for i in range(256)]))
    machine = pieces.Automaton(vocabulary)
    n = 6000
    ids, first = pieces.sample(machine, pieces.segments(pa.array(["ab"] * n)), np.arange(n, dtype=np.uint64) * np.uint64(7919), 1.0)
    seen = {}
    for a, b in zip(first[:-1], first[1:], strict=True):
        seen[tuple(ids[a:b].tolist())] = seen.get(tuple(ids[a:b].tolist()), 0) + 1
    weight = {(0, 1, 2): np.exp(-3.5), (0, 3): np.exp(-2.0), (4, 2): np.exp(-2.0)}
    total = sum(weight.values())
    assert set(seen) == set(weight) and all(abs(seen[k] / n - w / total) < 0.03 for k, w in weight.items())


def test_webp_round_trip(spark, docs, none):
    stored = media.to_webp(docs)
    out = media.read_webp(stored, pixels=True)
    assert out.count() == len(ROWS)
    got = by_id(out)
    assert got[4]["payload_bytes"] == 64 and got[3]["media_sha256"] == got[4]["media_sha256"] and got[1]["media_sha256"] == got[2]["media_sha256"]
    raw = np.array(got[8]["images"][0]["argb"], np.int32).view(np.uint32).astype(">u4").tobytes()
    assert raw.rstrip(b"\0").decode() == LONG
    assert media.read_webp(media.to_webp(none)).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_webp_features(seed):
    rng = np.random.default_rng(seed)
    w, h, n = int(rng.integers(1, 24)), int(rng.integers(1, 18)), int(rng.choice([1, 2, 3, 4, 9, 16, 17, 200]))
    pixels = rng.choice(rng.integers(0, 2**32, n, dtype=np.uint32), w * h)
    transforms, copies = [], []
    if seed % 2:
        transforms.append((webp.PREDICTOR, 2, rng.integers(0, 14, (-(-w >> 2)) * (-(-h >> 2))).astype(np.uint32) << 8))
    if seed % 3 == 0:
        transforms.append((webp.CROSS_COLOUR, 3, rng.integers(0, 2**24, (-(-w >> 3)) * (-(-h >> 3))).astype(np.uint32)))
    if seed % 5 == 0:
        transforms.append((webp.SUBTRACT_GREEN,))
    if seed % 4 == 2:
        transforms = [(webp.PALETTE,)]
    if not transforms and w * h > 40:
        pixels[20:33] = pixels[5:18]
        copies = [(20, 13, 15)]
    options = webp.Options(int(rng.choice([0, 1, 4, 11])), copies, transforms)
    ((gw, gh, got),) = webp.decode([webp.encode(pixels, w, options)])
    assert (gw, gh) == (w, h) and (got == pixels).all()


def test_webp_refuses_damage():
    data = webp.encode(np.arange(64, dtype=np.uint32), 8)
    with pytest.raises(ValueError):
        webp.decode([b"RIFX" + data[4:]])
    assert webp.NEAR[:4] == [(0, 1), (1, 0), (1, 1), (-1, 1)] and webp.NEAR[-1] == (8, 7) and len(webp.NEAR) == 120


def test_warc(spark):
    big = "x" * 150 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/", big, 0), (2, None, big, 0), (3, "http://c/\r\nX: y", "small", 0), (4, "d", "small", 0), (5, "e", None, 0), (6, "f", "", 0), (9, "g", big + "é", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes long")
    path = new_path(spark, "warc-test")
    warc.write_archives(warc.plan_captures(pages), path, records_per_file=5)
    records = warc.read_archives(spark, path)
    whole = warc.assemble(records)
    assert records.count() == 21 and whole.filter("request is null or metadata is null").count() == 0
    got = {r["page_id"]: r for r in warc.digest(whole).collect()}
    assert [got[i]["record_type"] for i in (1, 2, 3, 4, 5, 6, 9)] == ["response", "revisit", *["response"] * 5]
    assert got[2]["refers_to"] == 1 and got[2]["payload_bytes"] == got[1]["payload_bytes"] == len(big)
    stored = {r["response"]["payload_digest"]: bytes(r["response"]["payload"]) for r in whole.collect() if r["response"]["record_type"] == "response"}
    assert (big + "é").encode() in stored.values()
    empty = new_path(spark, "warc-empty")
    warc.write_archives(warc.plan_captures(pages.limit(0)), empty)
    assert warc.digest(warc.assemble(warc.read_archives(spark, empty))).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        assert out.columns[:5] == pipeline.COLUMNS and 0 < out.count() <= docs.count()
        if name == "near_dedup":
            assert neardup.link(out).filter("not kept").count() == 0
        docs = out
    assert decontaminate.leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_benchmark_paraphrases_and_text_keys(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    vocabulary = [word() for _ in range(400)]
    text = lambda n: [str(w) for w in rng.choice(vocabulary, n)]
    items = {f"item-{i}": [word() if rng.random() < 0.5 else w for w in text(30)] for i in range(20)}
    rows, planted = [], set()
    for i in range(120):
        words = text(200)
        if i < 60:
            name = f"item-{i % 20}"
            copy = [w if rng.random() > 0.2 else str(rng.choice(vocabulary)) for w in items[name][:22]] + items[name][22:]
            at = int(rng.integers(0, 170))
            words[at : at + 30] = copy
            planted.add((f"doc {i}", name))
        rows.append((f"doc {i}", " ".join(words)))
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id string, text string")
    got = {(r[0], r[1]) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id string, text string"), bench).select("doc_id", "item_id").collect()}
    assert len(got & planted) >= 0.9 * len(planted) and got <= planted


def test_closest_window_is_exact():
    rng = np.random.default_rng(4)
    for _ in range(200):
        item, text = tuple(rng.integers(0, 8, 7).tolist()), rng.integers(0, 12, 40).tolist()
        size = -(-3 * len(item) // 2)
        best = max(decontaminate.common_subsequence(text[a : a + size], item) for a in range(len(text)))
        assert decontaminate.common_subsequence(decontaminate.closest(text, item), item) == best


def test_line_dedup_identical_rows_and_nulls(spark):
    rows = [(1, "one line of text\nanother line"), (1, "one line of text\nanother line"), (None, None), (2, "")]
    got = [tuple(r) for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [(None, None, 0, 0), (1, rows[0][1], 2, 2), (1, rows[0][1], 2, 2), (2, "", 0, 0)]


def test_language_fit_takes_rows_without_keys(spark):
    rows = [(None, "der hund und die katze", "de"), (None, "the dog and the cat", "en"), (None, "der hund und die katze", "de"), (1, None, "de")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ("de", "en")


def test_words_held_near_a_passage_are_those_of_the_plain_count():
    """Pairs of passages and items are bounded together, in blocks, as each would be alone."""
    rng = np.random.default_rng(5)
    sizes = np.array([7, 20, 3])
    times = rng.integers(0, 3, (30, 3)).astype(np.uint8)
    rows = [np.sort(rng.choice(400, n, replace=False)) for n in (90, 0, 150)]
    words = [rng.integers(0, 30, len(r)) for r in rows]
    opens = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    row, start, item = rng.integers(0, 3, 200), 32 * rng.integers(0, 12, 200), rng.integers(0, 3, 200)
    got = decontaminate._held_near(np.concatenate(rows), np.concatenate(words), opens, row, start, item, times, sizes, most=64)
    for r, s, i, n in zip(row, start, item, got, strict=True):
        near = words[r][(rows[r] >= s - sizes[i]) & (rows[r] < s + decontaminate.SIZE + sizes[i])]
        assert n == times[np.unique(near), i].sum()


def test_sparse_products_are_those_of_sums():
    rng = np.random.default_rng(6)
    opens = np.array([0, 3, 3, 10, 11])
    feature = np.concatenate([rng.choice(12, n, replace=False) for n in np.diff(opens)])
    value, table = rng.random(11).astype(np.float32), rng.random((12, 5)).astype(np.float32)
    want = [sum((value[i] * table[feature[i]] for i in range(a, b)), np.zeros(5)) for a, b in zip(opens[:-1], opens[1:], strict=True)]
    for widest, most in ((0, 1), (12, 1), (12, 24), (12, 1 << 20)):
        assert np.allclose(decontaminate._product(opens, feature, value, table, widest, most), want)
    assert decontaminate._product(np.zeros(1, np.int64), feature[:0], value[:0], table).shape == (0, 5)


def test_every_training_row_and_window_is_learned_from(docs, monkeypatch):
    seen, averaged = [], lmscore._averaged
    monkeypatch.setattr(lmscore, "_averaged", lambda rows, *rest: seen.append(rows.count()) or averaged(rows, *rest))
    assert lmscore.score(docs, F.lit(True), steps=2).count() == len(ROWS)
    assert seen == [sum(r[1] is not None for r in ROWS)]
    from tidemark.llm import attention

    n = 300
    x = np.repeat(np.arange(n), attention.WINDOW).reshape(n, -1)
    target, scored = x % 5, np.ones(x.shape, bool)
    start = attention.train(x[:0], target[:0], scored[:0], n, 5)
    end = attention.train(x, target, scored, n, 5, steps=3, batch=128, start=start)
    assert (start["E"] != end["E"]).any(1).all()


def test_payloads_are_written_with_copies_and_transforms():
    """Repeated runs become back-references, few colours a palette; all come back as they were."""
    rng = np.random.default_rng(8)
    noise = rng.integers(0, 256, 4096, np.uint8).tobytes()
    grey = np.repeat(rng.integers(0, 256, (1024, 1), np.uint8), 4, 1).tobytes()
    payloads = [noise, noise * 2, noise + noise[256:1280] + noise[:64] * 9, bytes(64), bytes(1 << 15), b"abcd" * 1600, grey, (b"one line of a text\n" * 700)[:12800], noise * 300]
    files = [webp.encode_payload(x) for x in payloads]
    for x, stored in zip(payloads, files, strict=True):
        assert webp.payload_of(webp.decode(list(webp.files(stored)))) == x
    at_once = iter(webp.decode([f for stored in files for f in webp.files(stored)]))
    assert [webp.payload_of([next(at_once) for _ in webp.files(stored)]) for stored in files] == payloads
    assert len(files[1]) < 1.1 * len(files[0]) and len(files[7]) < 500 and len(files[5]) < 200
    kinds = [[t[0] for t in webp.read_header(webp.chunk(f)).transforms] for f in files]
    assert kinds[5] == [webp.PALETTE] and kinds[6] == [webp.SUBTRACT_GREEN] and kinds[0] == []
    assert webp.back_references(np.frombuffer(noise * 2, ">u4").astype(np.uint32)) == [(1024, 1024, 1024)]


def test_code_lengths_are_those_of_a_heap():
    """The two queues join the same nodes as a heap of (count, node), ties included."""
    import heapq

    def heaped(counts):
        used = sorted((c, s) for s, c in counts.items() if c)
        heap = [(c, i) for i, (c, _) in enumerate(used)]
        inside = {i: [i] for i in range(len(used))}
        depth = [0] * len(used)
        for node in range(len(used), 2 * len(used) - 1):
            (c, a), (d, b) = heapq.heappop(heap), heapq.heappop(heap)
            inside[node] = inside[a] + inside[b]
            for i in inside[node]:
                depth[i] += 1
            heapq.heappush(heap, (c + d, node))
        return {s: depth[i] for i, (_, s) in enumerate(used)}

    rng = np.random.default_rng(5)
    for size in (2, 3, 40, 250):
        for most in (1, 3, 30):
            counts = dict(enumerate(rng.integers(1, most + 1, size).tolist()))
            assert webp.code_lengths(counts, 64) == heaped(counts)


def test_band_values_do_not_depend_on_blocks(monkeypatch):
    """Lines are taken in blocks of about BLOCK shingles; a longer line is a block of its own."""
    rng = np.random.default_rng(6)
    points = rng.integers(32, 3000, 4000).astype(np.uint32)
    cuts = np.concatenate(([0], np.sort(rng.choice(np.arange(1, 3000), 60, replace=False)), [4000]))
    first, last = (x[np.diff(cuts) >= linededup.PROBE] for x in (cuts[:-1], cuts[1:]))
    whole = linededup.band_values(points, first, last)
    alone = np.concatenate([linededup.band_values(points[a:b], np.array([0]), np.array([b - a])) for a, b in zip(first, last, strict=True)])
    assert (whole == alone).all()
    for block in (1, 100):
        monkeypatch.setattr(linededup, "BLOCK", block)
        assert (linededup.band_values(points, first, last) == whole).all()


def test_training_does_not_depend_on_blocks(monkeypatch):
    """Outputs are worked on in blocks of BLOCK rows; steps are those of all rows at once."""
    from tidemark.llm import attention

    rng = np.random.default_rng(7)
    x, target = rng.integers(0, 12, (40, attention.WINDOW)), rng.integers(0, 6, (40, attention.WINDOW))
    scored = rng.random(x.shape) < 0.7
    got = []
    for block in (5, 1 << 20):
        monkeypatch.setattr(attention, "BLOCK", block)
        got.append(attention.flat(attention.train(x, target, scored, 12, 6, steps=8, batch=16)))
    np.testing.assert_allclose(*got, atol=1e-3)


def test_words_met_before_are_not_split_again(monkeypatch):
    """The kept ids are those of a fresh split, with one word a slot, with all words in few slots, and after the pool was full."""
    import pyarrow as pa

    from tidemark.llm import textbytes as tb

    with open(lmscore.default_ranks(), "rb") as file:
        ranks = file.read()
    texts = ["Some words, some WORDS again", None, "", "\u3000 \u00a0x\u00a0 \u2028 1234567 don't", "\ud55c\uad6d\uc5b4 e\u0301 " + "z" * 5000, *(f"w{i} x{i % 7}" for i in range(300))]
    (_, _, buf, offsets), *_ = tb.runs(pa.array(texts, pa.string()))
    words = lmscore._words(buf, offsets)
    low, starts, ends, hashes, first = words
    alone = lmscore.Subwords(ranks)
    want = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        for s, e in zip(starts[a:b], ends[a:b], strict=True):
            want += alone.split(low[s:e].tobytes(), np.array([0, e - s]))[0].tolist()
        want.append(alone.size - 1)
    for kept, pool in ((lmscore.KEPT, lmscore.POOL), (2, lmscore.POOL), (lmscore.KEPT, 0)):
        monkeypatch.setattr(lmscore, "KEPT", kept)
        monkeypatch.setattr(lmscore, "POOL", pool)
        reader, split = lmscore.Subwords(ranks), []
        fresh = reader.split
        monkeypatch.setattr(reader, "split", lambda body, at, fresh=fresh, split=split: split.append(len(at) - 1) or fresh(body, at))
        for _ in range(2):
            ids, row_first, begins = lmscore._text_ids(reader, *words)
            assert ids.tolist() == want and len(begins) == len(starts) + len(texts) and row_first[-1] == len(ids)
        assert split[0] == len(np.unique(hashes)) and sum(split[1:]) < split[0] or kept == 2 or pool == 0
    assert len(lmscore.Places(np.unique(hashes)).of(hashes)) == len(hashes)
    assert (np.unique(hashes)[lmscore.Places(np.unique(hashes)).of(hashes)] == hashes).all()


def test_overlaps_of_windows_do_not_change_scores(monkeypatch):
    """Queries are left out where a window overlaps the one before: each id has the score that its window gives it alone."""
    from tidemark.llm import attention

    rng = np.random.default_rng(8)
    n = 3 * attention.WINDOW
    ids, places = rng.integers(0, 9, n), np.arange(10)
    x, target, where = attention.windows(ids, np.array([0, n]), places, 5)
    model = attention.AttentionModel(places, 5, np.zeros(10, np.float32), attention.train(x, target, where >= 0, 11, 6, steps=20))
    got, w = model.log_probabilities(ids, np.array([0, n])), model.weights
    for row in range(len(x)):
        e = w["E"][x[row]] + w["P"]
        a = np.exp((e @ w["Wq"]) @ (e @ w["Wk"]).T / 4) * np.tril(np.ones((attention.WINDOW, attention.WINDOW)))
        z = (e + (a / a.sum(1, keepdims=True)) @ (e @ w["Wv"]) @ w["Wo"]) @ w["U"] + w["b"]
        all_ = z - np.log(np.exp(z).sum(1, keepdims=True))
        held = where[row] >= 0
        np.testing.assert_allclose(got[where[row][held]], all_[held, target[row][held]], atol=1e-4)


def test_probe_hashes_do_not_depend_on_pieces(monkeypatch):
    """Shingles are hashed in pieces of POINTS code points; those that begin in one piece and end in the next are whole."""
    rng = np.random.default_rng(9)
    points = rng.integers(32, 3000, 500).astype(np.uint32)
    whole = linededup.probe_hashes(points)
    n = len(points) - linededup.PROBE + 1
    alone = [linededup.probe_hashes(points[i : i + linededup.PROBE])[0] for i in range(n)]
    assert len(whole) == len(points) and whole[:n].tolist() == alone
    for piece in (1, 7, 100, 500):
        monkeypatch.setattr(linededup, "POINTS", piece)
        assert (linededup.probe_hashes(points) == whole).all()
    assert len(linededup.probe_hashes(points[:0])) == 0


def test_line_dedup_splits_a_text_once(spark):
    out = linededup.dedup(spark.createDataFrame([(n, "one line that stands twice\nanother line of text %d" % n) for n in range(3)], "doc_id long, text string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan and "lambdafunction(split(" not in plan  # else a text is split again for each of its lines


def test_sets_of_lines_are_those_of_each():
    lines = ["", "a", "abc", "zürich " * 40, "日本語のテキスト" * 9, "x" * 500, "hello world hello world", *["".join(chr(97 + (i * j * j + i) % 7) for j in range(i)) for i in range(60)]]
    values, cuts = linededup.sets_of(pa.array(lines))
    assert len(cuts) == len(lines) + 1
    for n, line in enumerate(lines):
        if line:
            assert values[cuts[n] : cuts[n + 1]].tolist() == linededup.line_sets(line).tolist()


def test_notes_name_every_line_with_a_shared_band(spark):
    """Lines that the second reading leaves out share no band with another line, within a chunk or across chunks."""
    base = [" ".join(f"w{(i * 37 + j * 11) % 101}x{j}" for j in range(12)) for i in range(40)]
    texts = base + [x.replace("x5", "y5") for x in base[:10]] + ["\n".join((x, x.replace("x7", "z7"))) for x in base[20:25]]
    rows = [(i // 9, x) for i, x in enumerate(texts)]
    asked = linededup.ask(spark.createDataFrame(rows, "chunk long, text string").repartition(3, "chunk").sortWithinPartitions("chunk"), 4)
    named: dict[int, set[int]] = {}
    for row in linededup.answer(asked).collect():
        named.setdefault(row["chunk"], set()).update(np.frombuffer(row["notes"], "<u2").tolist())
    lines: dict[int, set[int]] = {}
    held = []
    for chunk, text in rows:
        for _, _, _, _, hashes, long, values, _, _ in linededup._read(pa.array([text])):
            held += [(chunk, int(hashes[n]), v) for n, v in zip(long, values, strict=True)]
            for n, v in zip(long, values, strict=True):
                for x in v.tolist():
                    lines.setdefault(x, set()).add(int(hashes[n]))
    shared = [(chunk, line) for chunk, line, v in held if any(len(lines[x]) > 1 for x in v.tolist())]
    assert len(shared) > 20
    assert all(int(linededup.note(np.array([line], np.uint64))[0]) in named[chunk] for chunk, line in shared)
