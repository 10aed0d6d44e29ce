"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of `SIZE` words, one every `STRIDE` words, over their whole length. TF-IDF vectors of the
passages over the benchmark's words (document frequencies are counted over all passages) go through a distributed
randomised SVD (every second passage: side by side they cover the texts); the latent space is spanned by the leading RANK singular
vectors alone. Passages of enough cosine to an item in it are candidates, which the longest common
subsequence with the item and a check of its answer (the last sentence) confirm on the text around the passage.

Benchmarks are worked through in blocks of `block` items; a block's vectors are the only thing that is broadcast.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textbytes as tb
from tidemark.llm.scratch import remove, written
from tidemark.llm.vectors import added

SIZE, STRIDE = 64, 32
RANK = 64
#: Words in more than this share of passages have no weight, but for items that have fewer than three others: those are searched by
#: themselves, with all words weighed.
COMMON_SHARE = 0.02


_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")
_SENTENCE = re.compile(r"[.?!]\s")


@dataclass(frozen=True)
class Item:
    item_id: object
    words: tuple[int, ...]  # feature numbers in order
    answer: tuple[int, ...]  # those of the last sentence if it has five or more, else of the last quarter (five at least)


@dataclass(frozen=True)
class Features:
    """The benchmark's words: sorted hashes, and a table over their upper bits to look a hash up quickly."""

    hashes: np.ndarray
    table: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray) -> Features:
        hashes = np.unique(hashes)
        return cls(hashes, np.searchsorted(hashes >> np.uint64(48), np.arange(65537, dtype=np.uint64)).astype(np.int32))

    def find(self, values: np.ndarray) -> np.ndarray:
        """The feature of each hash, or -1."""
        out = np.full(len(values), -1, np.int32)
        if not len(self.hashes):
            return out
        high = (values >> np.uint64(48)).astype(np.int64)
        at = self.table[high]
        some = np.flatnonzero(at < self.table[high + 1])
        at = at[some]
        for _ in range(int((self.table[1:] - self.table[:-1]).max())):
            same = (at < len(self.hashes)) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == values[some])
            out[some[same]] = at[same]
            at = at + 1
        return out


def _words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, each row's first word) for runs of rows. Words are runs of letters and digits;
    Latin capitals count as small letters."""
    for begin, end, buf, offsets in tb.runs(texts):
        low = tb.lower_latin(buf)
        starts, ends, first = tb.spans(low, offsets, tb.ALNUM)
        yield begin, end, tb.span_hash(low, starts, ends), first


def read_items(rows: list[tuple[object, str | None]]) -> tuple[Features, list[Item]]:
    """Features and items of (item_id, text); an item without words can't be found and is left out."""
    texts = pa.array([t for _, t in rows], pa.string())
    hashes: list[np.ndarray] = []
    for _, _, values, first in _words(texts):
        hashes += [values[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    features = Features.of(np.concatenate([np.zeros(0, np.uint64), *hashes]))
    items = []
    for (item_id, text), values in zip(rows, hashes, strict=True):
        if not len(values):
            continue
        words = tuple(features.find(values).tolist())
        cut = max(-(-len(words) // 4), min(5, len(words)))
        sentences = [len(_WORD.findall(x)) for x in _SENTENCE.split(text or "")]
        last = next((n for n in reversed(sentences) if n), 0)
        if 5 <= last < len(words):
            cut = last
        items.append(Item(item_id, words, words[-cut:]))
    return features, items


def _distinct(rows: np.ndarray, columns: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, column), in order; small keys sort in half the time."""
    keys = rows.astype(np.int64) * width + columns
    if len(keys) and keys.max() < 2**31:
        keys = keys.astype(np.int32)
    keys.sort()
    row, column = np.divmod(keys[np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]))], max(width, 1))
    return row.astype(np.int64), column.astype(np.int64)


def passages(count: np.ndarray) -> np.ndarray:
    """Passages of texts of so many words."""
    return np.maximum(1, -(-count // STRIDE) - 1)


def _members(rows: np.ndarray, at: np.ndarray, first_passage: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word (row, position) the one or two passages that hold it: (passage, index of the word)."""
    own = at // STRIDE
    late, early = own < many[rows], own > 0
    index = np.arange(len(at))
    return np.concatenate(((first_passage[rows] + own)[late], (first_passage[rows] + own - 1)[early])), np.concatenate((index[late], index[early]))


def find_words(docs: DataFrame, features: Features, key: str, text: str) -> DataFrame:
    """(id, row_hash, n_words, at, feature): each document's occurrences of benchmark words, as little-endian int32
    positions and feature numbers; documents without one are left out. `df` holds, on one further row (null n_words) a
    task, how many passages hold each feature, and n_passages their number."""
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("row_hash"), F.col(text).alias("text"))
    id_type = docs.schema[key].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = held.value
        m = len(features.hashes)
        df, seen = np.zeros(m, np.int64), 0
        names = ["id", "row_hash", "n_words", "at", "feature", "df", "n_passages"]
        id_arrow = None
        for batch in batches:
            id_arrow = batch.column(0).type
            for begin, end, values, first in _words(batch.column(2)):
                count = np.diff(first)
                many = passages(count)
                seen += int(many[count > 0].sum())
                feature = features.find(values)
                hit = np.flatnonzero(feature >= 0)
                row = np.searchsorted(first, hit, side="right") - 1
                at, feature = hit - first[row], feature[hit]
                first_passage = np.concatenate(([0], np.cumsum(many)))[:-1]
                passage, index = _members(row, at, first_passage, many)
                df += np.bincount(_distinct(passage, feature[index], m)[1], minlength=m) if m else 0
                limits = np.searchsorted(row, np.arange(end - begin + 1))
                some = np.flatnonzero(np.diff(limits))
                raw_at, raw_feature = at.astype("<i4").tobytes(), feature.astype("<i4").tobytes()
                part = batch.slice(begin, end - begin)
                take = pa.array(some)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(take), part.column(1).take(take), pa.array(count[some], pa.int64()),
                    pa.array([raw_at[4 * limits[i] : 4 * limits[i + 1]] for i in some.tolist()], pa.binary()),
                    pa.array([raw_feature[4 * limits[i] : 4 * limits[i + 1]] for i in some.tolist()], pa.binary()),
                    pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.int64()),
                ], names=names)
        if id_arrow is not None:
            yield pa.RecordBatch.from_arrays([
                pa.nulls(1, id_arrow), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                pa.array([df.astype("<i8").tobytes()], pa.binary()), pa.array([seen], pa.int64()),
            ], names=names)

    return rows.mapInArrow(tb.lean(run), f"id {id_type}, row_hash long, n_words long, at binary, feature binary, df binary, n_passages long")


def _weigh(batch: pa.RecordBatch, weights: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit TF-IDF rows of a batch's passages: (passage, feature, value) and each row's first passage. With a stride of
    SIZE the passages lie side by side. A passage without a weighted word has no entries."""
    count = batch.column(2).to_numpy()
    at = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in batch.column(3)), "<i4").astype(np.int64)
    feature = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in batch.column(4)), "<i4").astype(np.int64)
    sizes = np.array([len(x.as_buffer()) // 4 for x in batch.column(3)], np.int64)
    row = np.repeat(np.arange(len(count)), sizes)
    many = passages(count) if stride == STRIDE else np.maximum(1, -(-count // SIZE))
    first = np.concatenate(([0], np.cumsum(many)))
    keep = np.flatnonzero(weights[feature] > 0)
    row, at, feature = row[keep], at[keep], feature[keep]
    passage, index = _members(row, at, first[:-1], many) if stride == STRIDE else (first[row] + at // SIZE, slice(None))
    m = len(weights)
    passage, feature = _distinct(passage, feature[index], m)
    value = weights[feature]
    norm = np.sqrt(np.bincount(passage, weights=value**2, minlength=int(first[-1])))
    return passage, feature, value / norm[passage], first


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, len(batch), rows):
            yield batch.slice(begin, rows)


def _product(opens: np.ndarray, feature: np.ndarray, value: np.ndarray, table: np.ndarray, widest: int = 1 << 13, most: int = 1 << 19) -> np.ndarray:
    """Sparse rows times a float table. Row r holds the entries from opens[r] to opens[r + 1], a feature once. Up to `widest` features, dense
    blocks of at most `most` values are several times quicker than sums over entries."""
    out = np.zeros((len(opens) - 1, table.shape[1]), table.dtype)
    m = len(table)
    if m > widest:
        some = np.flatnonzero(np.diff(opens))
        if len(some):
            out[some] = np.add.reduceat(table[feature] * value[:, None].astype(table.dtype), opens[:-1][some], axis=0)
        return out
    row = np.repeat(np.arange(len(out)), np.diff(opens))
    step = max(1, most // max(m, 1))
    for begin in range(0, len(out), step):
        end = min(len(out), begin + step)
        part = slice(int(opens[begin]), int(opens[end]))
        dense = np.zeros((end - begin, m), table.dtype)
        dense[row[part] - begin, feature[part]] = value[part]
        np.matmul(dense, table, out=out[begin:end])
    return out


def _project(passage: np.ndarray, feature: np.ndarray, value: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passages that have entries, and their rows times the basis."""
    opens = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1], [True])))
    return passage[opens[:-1]], _product(opens, feature, value, basis)


def _sliced(passage: np.ndarray, most: int = 1 << 15) -> Iterator[tuple[int, int]]:
    """Runs of entries that end with their passage."""
    begin = 0
    while begin < len(passage):
        end = min(len(passage), begin + most)
        if end < len(passage):
            end = int(np.searchsorted(passage, passage[end], side="left"))
            if end <= begin:
                end = int(np.searchsorted(passage, passage[begin], side="right"))
        yield begin, end
        begin = end


def singular_vectors(hits: DataFrame, weights: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """Leading right singular vectors of the passages' TF-IDF matrix A, from one distributed product Y = A'(A R) with a
    Gaussian R and the Nystrom form Y (R'Y)^-1 Y'."""
    m = len(weights)
    rank = min(rank, m)
    spark = hits.sparkSession
    gauss = np.random.default_rng(seed).standard_normal((m, rank)).astype(np.float32)
    held = spark.sparkContext.broadcast((weights, gauss))
    parts = np.array_split(np.arange(m), max(1, m // 512))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, gauss = held.value
        total = np.zeros((m, rank))
        for batch in _parts(batches):
            passage, feature, value, _ = _weigh(batch, weights, SIZE)
            for begin, end in _sliced(passage):
                p, f, v = passage[begin:end], feature[begin:end], value[begin:end]
                present, made = _project(p, f, v, gauss)
                order = np.argsort(f, kind="stable")
                opens = np.flatnonzero(np.concatenate(([True], f[order][1:] != f[order][:-1])))
                spread = made[np.searchsorted(present, p[order])] * v[order][:, None].astype(np.float32)
                total[f[order][opens]] += np.add.reduceat(spread, opens, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int32()), pa.array([total[x].tobytes() for x in parts], pa.binary())], names=["part", "value"])

    product = added(hits.filter("n_words is not null").mapInArrow(tb.lean(run), "part int, value binary"), "<f8").reshape(m, rank)
    inner = gauss.astype(float).T @ product
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    good = values > 1e-9 * max(values.max(), 1e-300)
    half = product @ (vectors[:, good] / np.sqrt(values[good]))
    basis, spread, _ = np.linalg.svd(half, full_matrices=False)
    return basis[:, spread > 1e-9 * max(spread.max(initial=0), 1e-300)]


def common_subsequence(text: list[int], item: tuple[int, ...]) -> int:
    """Length of the longest common subsequence, a machine word of the item's places at a time."""
    places: dict[int, int] = {}
    for i, word in enumerate(item):
        places[word] = places.get(word, 0) | 1 << i
    row = (1 << len(item)) - 1
    whole = row
    for word in text:
        if hit := places.get(word):
            taken = row & hit
            row = ((row + taken) | (row - taken)) & whole
    return len(item) - row.bit_count()


def closest(text: list[int], item: tuple[int, ...]) -> list[int]:
    """The first stretch of text, half as long again as the item, of the longest common subsequence with it, over all starts. Matches
    strewn over a longer text say nothing.

    Only stretches that start at a word of the item can be longest, and those that hold no more of its words than the best
    common subsequence so far can't be longer.
    """
    size = -(-3 * len(item) // 2)
    held = [word in item_words for item_words in (set(item),) for word in text]
    upto = [0, *itertools.accumulate(held)]
    best, found = -1, text[:size]
    for start, here in enumerate(held):
        if here and upto[min(len(text), start + size)] - upto[start] > best:
            length = common_subsequence(text[start : start + size], item)
            if length > best:
                best, found = length, text[start : start + size]
    return found


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    cosine: float = 0.25, lcs: float = 0.6, answer: float = 0.5, block: int = 256,
) -> DataFrame:
    """(key, item, cosine, lcs_share, answer_share): documents that hold an item, with each item's best passage.

    A passage counts if its cosine to the item in the latent space is at least `cosine`, the longest common subsequence
    of the words around it with the item has at least `lcs` of the item's words, and that with the item's answer
    at least `answer` of the answer's. Words are runs of letters and digits, Latin capitals as small letters; null and empty texts
    hold nothing, items without words are never found, and equal items are found alike. Rows that share a key share findings. Keys may be of
    any type; an empty table gives no row.
    """
    spark = docs.sparkSession
    id_type = docs.schema[key].dataType.simpleString()
    item_type = benchmark.schema[item_key].dataType.simpleString()
    out = spark.createDataFrame([], f"{key} {id_type}, {item_key} {item_type}, cosine double, lcs_share double, answer_share double")
    source = benchmark.select(F.col(item_key), F.col(item_text)).orderBy(item_key, item_text).toLocalIterator()
    while True:
        rows = [tuple(r) for r in itertools.islice(source, block)]
        if not rows:
            return out
        out = out.unionByName(_leaks_of(docs, rows, key, text, item_key, item_type, cosine, lcs, answer))
        if len(rows) < block:
            return out


def _occurrences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and features of a batch's occurrences, one row after another, and each row's first."""
    at, feature = (np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in batch.column(c)), "<i4") for c in (3, 4))
    return at, feature, np.concatenate(([0], np.cumsum([len(x.as_buffer()) // 4 for x in batch.column(3)], dtype=np.int64)))


def _held_near(at: np.ndarray, feature: np.ndarray, opens: np.ndarray, row: np.ndarray, start: np.ndarray, item: np.ndarray, times: np.ndarray, sizes: np.ndarray, most: int = 1 << 13) -> np.ndarray:
    """How many of its words each item (repeated ones each) has among those that stand around a passage (row, start): as many
    words before it and after it as the item has. No more can be in common."""
    wide = int(at.max(initial=0)) + SIZE + 2 * int(sizes.max(initial=0)) + 2
    key = np.repeat(np.arange(len(opens) - 1), np.diff(opens)) * wide + at
    out = np.zeros(len(row), np.int64)
    for begin in range(0, len(row), most):
        r, s, i = row[begin : begin + most], start[begin : begin + most], item[begin : begin + most]
        low = np.searchsorted(key, r * wide + np.maximum(s - sizes[i], 0))
        many = np.searchsorted(key, r * wide + np.minimum(s + SIZE + sizes[i], wide - 1)) - low
        pair = np.repeat(np.arange(len(r)), many)
        word = feature[tb.ranges(low, many)]
        held = np.flatnonzero(times[word, i[pair]])
        pair, word = _distinct(pair[held], word[held], len(times))
        out[begin : begin + most] = np.bincount(pair, weights=times[word, i[pair]], minlength=len(r))
    return out


def _candidates(hits: DataFrame, weights: np.ndarray, items: list[Item], chosen: list[int], id_type: str, cosine: float, lcs: float, rank: int = RANK) -> DataFrame:
    """(id, row_hash, start, item, cosine): passages close to one of the chosen items in the latent space, whose surroundings hold
    enough of its words."""
    spark = hits.sparkSession
    m = len(weights)
    numbers, items = np.array(chosen), [items[n] for n in chosen]
    queries = np.zeros((len(items), m), np.float64)
    for i, item in enumerate(items):
        queries[i, list(set(item.words))] = weights[list(set(item.words))]
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-300)
    basis = singular_vectors(hits, weights, rank).astype(np.float32)
    targets = (queries @ basis).astype(np.float32)
    targets /= np.maximum(np.linalg.norm(targets, axis=1, keepdims=True), 1e-30)
    sizes = np.array([len(i.words) for i in items])
    times = np.zeros((m, len(items)), np.uint8 if max(sizes, default=0) < 256 else np.uint16)  # how often each item holds each word
    for i, item in enumerate(items):
        np.add.at(times[:, i], list(item.words), 1)
    held = spark.sparkContext.broadcast((weights, basis, targets, times, sizes))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, basis, targets, times, sizes = held.value
        least = np.ceil(lcs * sizes - 1e-9)
        for batch in _parts(batches):
            # No more of an item's words can be in common than those that the document holds somewhere.
            words = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in batch.column(4)), "<i4").astype(np.int64)
            row = np.repeat(np.arange(len(batch)), [len(x.as_buffer()) // 4 for x in batch.column(4)])
            row, words = _distinct(row, words, len(weights))
            opens = np.searchsorted(row, np.arange(len(batch) + 1))
            able = _product(opens, words, np.ones(len(words), np.float32), times.astype(np.float32)) >= least
            batch, able = batch.filter(pa.array(able.any(1))), able[able.any(1)]
            if not len(batch):
                continue
            passage, feature, value, first = _weigh(batch, weights)
            held_at, held_words, opens = _occurrences(batch)
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            for begin, end in _sliced(passage):
                present, made = _project(passage[begin:end], feature[begin:end], value[begin:end], basis)
                row = np.searchsorted(first, present, side="right") - 1
                norm = np.linalg.norm(made, axis=1)
                close = (made @ targets.T) / np.maximum(norm, 1e-30)[:, None]
                p, i = np.nonzero((close >= cosine) & able[row])
                start = (present[p] - first[row[p]]) * STRIDE
                good = _held_near(held_at, held_words, opens, row[p], start, i, times, sizes) >= least[i]
                found.append((row[p][good], start[good], i[good], close[p, i][good]))
            if found:
                row, start, item, close = map(np.concatenate, zip(*found, strict=True))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(start, pa.int32()), pa.array(numbers[item], pa.int32()), pa.array(close, pa.float64())], names=["id", "row_hash", "start", "item", "cosine"])

    return hits.filter("n_words is not null").mapInArrow(tb.lean(search), f"id {id_type}, row_hash long, start int, item int, cosine double")


def _leaks_of(docs: DataFrame, rows: list[tuple], key: str, text: str, item_key: str, item_type: str, cosine: float, lcs: float, answer: float) -> DataFrame:
    spark = docs.sparkSession
    id_type = docs.schema[key].dataType.simpleString()
    features, items = read_items(rows)
    m = len(features.hashes)
    hits, hits_path = written(find_words(docs, features, key, text), "benchmark-words")
    totals = hits.filter("df is not null")
    df = added(totals.select(F.lit(0).alias("part"), F.col("df").alias("value")), "<i8").astype(float) if m else np.zeros(0)
    df = df if len(df) == m else np.zeros(m)
    whole = totals.agg(F.sum("n_passages")).first()[0] or 0
    plain = np.log((1 + whole) / (1 + df)) + 1
    common = df > COMMON_SHARE * whole
    poor = [len({w for w in item.words if not common[w]}) < 3 for item in items]
    candidates = None
    for weights, chosen in ((np.where(common, 0.0, plain), [n for n, p in enumerate(poor) if not p]), (plain, [n for n, p in enumerate(poor) if p])):
        if chosen:
            one = _candidates(hits, weights, items, chosen, id_type, cosine, lcs)
            candidates = one if candidates is None else candidates.unionByName(one)
    if candidates is None:
        candidates = spark.createDataFrame([], f"id {id_type}, row_hash long, start int, item int, cosine double")
    candidates = candidates.groupBy("id", "row_hash").agg(F.collect_list(F.struct("start", "item", "cosine")).alias("found"))  # at most a passage's items a passage
    candidates, _ = written(candidates, "candidates")
    remove(spark, hits_path)
    source = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_row"), F.col(text).alias("text"))
    # Texts are picked by the candidates' keys alone, which are few, so that other texts need not move.
    same = lambda left, right: left["_id"].eqNullSafe(right["id"]) & (left["_row"] == right["row_hash"])
    keys = candidates.select("id", "row_hash")
    source = source.join(keys, same(source, keys), "left_semi")
    joined = source.join(candidates, same(source, candidates)).select("id", "text", "found")
    held_items = spark.sparkContext.broadcast((features, items))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, items = held_items.value
        for batch in batches:
            ids, made = [], []
            row_of: list[np.ndarray] = []
            for _, _, values, first in _words(batch.column(1)):
                feature = features.find(values)
                row_of += [feature[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
            for r, (words, found) in enumerate(zip(row_of, batch.column(2).to_pylist(), strict=True)):
                best: dict[int, tuple[float, float, float]] = {}
                for spot in sorted(found, key=lambda x: -x["cosine"]):
                    item = items[spot["item"]]
                    if spot["item"] in best and best[spot["item"]][1] == 1.0:
                        continue
                    n = len(item.words)
                    around = words[max(0, spot["start"] - n) : spot["start"] + SIZE + n].tolist()
                    around = closest(around, item.words)
                    share = common_subsequence(around, item.words) / n
                    if share < lcs:
                        continue
                    answered = common_subsequence(around, item.answer) / len(item.answer)
                    if answered >= answer:
                        best[spot["item"]] = max(best.get(spot["item"], (0.0, 0.0, 0.0)), (spot["cosine"], share, answered), key=lambda x: (x[1], x[2], x[0]))
                for i, values in best.items():
                    ids.append(r)
                    made.append((i, *values))
            if ids:
                columns = list(zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.float64()) for c in columns[1:]]], names=[key, "item", "cosine", "lcs_share", "answer_share"])

    confirmed = joined.mapInArrow(tb.lean(verify), f"{key} {id_type}, item int, cosine double, lcs_share double, answer_share double")
    found_ids = spark.createDataFrame([(n, item.item_id) for n, item in enumerate(items)], f"item int, item_id {item_type}")
    out = confirmed.join(F.broadcast(found_ids), "item")
    out = out.groupBy(key, F.col("item_id").alias(item_key)).agg(F.max_by(F.struct("cosine", "lcs_share", "answer_share"), F.struct("lcs_share", "answer_share", "cosine")).alias("b"))
    return out.select(key, item_key, "b.*")
