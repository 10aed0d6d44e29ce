"""The contracts of the registered queries, held against plain Python on the small tables."""

import collections
import hashlib
import math
import re
import zlib

import pytest

from tidemark.llm import licenses, queries
from tidemark.llm.queries import QUERIES

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode().translate(LOWER))


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}


def result(spark, sf, name, key="doc_id"):
    rows = QUERIES[name](spark, sf).collect()
    found = {r[key]: r for r in rows}
    assert len(found) == len(rows)
    return found


def test_op1_scores(spark, sf, docs):
    got = result(spark, sf, "op1_lm_scores")
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    tokens = {i: [*words(d["text"]), None] for i, d in docs.items()}
    counts = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9)
        assert got[i]["score"] < 0
    assert sum(got[i]["score"] for i in held if held[i]) > sum(got[i]["base_score"] for i in held if held[i])


def test_op2_warc(spark, sf):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i]["html"] or "", i)
    got = result(spark, sf, "op2_warc", "page_id")
    assert set(got) == set(pages)
    for i, p in pages.items():
        raw = (p["html"] or "").encode()
        again = len(raw) >= 100 and first[p["html"] or ""] != i
        want = (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[p["html"]] if again else None)
        assert tuple(got[i])[1:] == want


def test_op3_counts_are_the_public_decoders(spark, sf, docs):
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as proto

    from tidemark.llm import pieces

    vocabulary = pieces.Vocabulary.load(pieces.default_model())
    model = proto.ModelProto()
    with open(pieces.default_model(), "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for i, score in zip(vocabulary.ids.tolist(), vocabulary.scores.tolist(), strict=True):
        model.pieces[i].score = score
    public = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    got = result(spark, sf, "op3_token_counts")
    assert {i: r["n_pieces"] for i, r in got.items()} == {i: len(public.encode(d["text"] or "")) for i, d in docs.items()}


def test_op4_finds_planted_items_alone(spark, sf, docs):
    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    items = {r["item_id"]: plain(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(i, k) for i, d in docs.items() for k, t in items.items() if t and f" {t} " in f" {plain(d['text'])} "}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op4_benchmark_leaks"](spark, sf).collect()}
    assert got == want


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_op5_components(spark, sf, docs):
    want = brute_components({i: d["text"] for i, d in docs.items()})
    got = result(spark, sf, "op5_near_duplicates")
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i][1]) for i, r in got.items())


def test_op6_keeps_one_line_of_equals(spark, sf, docs):
    got = result(spark, sf, "op6_line_dedup")
    seen = collections.Counter(line for r in got.values() for line in (r["text"] or "").split("\n") if line.strip())
    assert max(seen.values()) == 1
    for i, d in docs.items():
        left = iter((d["text"] or "").split("\n"))
        assert all(any(line == x for x in left) for line in (got[i]["text"] or "").split("\n") if line)


def test_op7_accuracy_on_held_out(spark, sf, docs):
    got = result(spark, sf, "op7_language_id")
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 3 == 1}
    assert {i for i, r in got.items() if r["held_out"]} == held
    right = [got[i]["lang_pred"] == docs[i]["lang"] for i in held if docs[i]["lang"]]
    assert sum(right) / len(right) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_op8_licenses(spark, sf, docs):
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    upper = str.maketrans(licenses._UPPER, licenses._LOWER)
    got = result(spark, sf, "op8_licenses")
    for i, d in docs.items():
        text = (d["text"] or "").translate(upper)
        w, at, base = token.findall(text), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            here = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += here
            base |= {label} if here else set()
        labels, best = set(base), 1.0 if at else 0.0
        for line in text.split("\n"):
            held = set(token.findall(line))
            for t in licenses.TEMPLATES:
                share = len(held & set(t.words)) / len(t.words)
                if share >= 0.8:
                    labels.add(t.label)
                    best = max(best, share)
        want = (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best)
        assert tuple(got[i])[1:] == want


def test_op9_payloads(spark, sf, docs):
    got = result(spark, sf, "op9_webp")
    for i, d in docs.items():
        raw = (d["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_op10_is_lossless_and_reproducible(spark, sf, docs):
    got = result(spark, sf, "op10_sampled_pieces")
    assert set(got) == set(docs) and all(r["lossless"] for r in got.values())
    again = result(spark, sf, "op10_sampled_pieces")
    assert {i: r["piece_crc32"] for i, r in got.items()} == {i: r["piece_crc32"] for i, r in again.items()}


def test_remainder_of_a_null_key(spark):
    row = spark.createDataFrame([(None,), (7,)], "k long").select(queries.remainder("k", 10).alias("r")).collect()
    assert [r["r"] for r in row] == [0, zlib.crc32(b"7") % 10]
