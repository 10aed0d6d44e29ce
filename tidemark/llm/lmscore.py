"""Language-model scores of whole texts: a word unigram base and a causal self-attention model over subword ids.

Corpus counts cover every training row. Documents are dealt into chunks; each chunk asks for the counts of its distinct
words, in sorted pieces of the hash range; one reduction a piece adds up the training counts and answers every chunk. A
chunk's answers and its documents then meet in one sorted partition, answers first, so scoring streams over documents
and holds one chunk's words. Words are known by 64-bit hashes.

The model's probability of a word mixes the unigram share with that of its subwords under the attention model:
`mixture` and 1 - `mixture`. Subword counts (all training rows) choose its vocabulary and the shares of rare subwords. Its
weights start from a fit on `sample_docs` training documents, at most `sample_windows` windows of each, and then learn from every window of
every training document: each task takes steps over its own, and the tasks' weights are averaged by their windows. A task holds one batch of
windows and one set of weights.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import attention
from tidemark.llm import textbytes as tb
from tidemark.llm.scratch import remove, written
from tidemark.llm.vectors import added

EMBEDDED, HEADS = 1023, 127
#: Bits of the number of words whose subwords a worker keeps, and the most ids that it keeps for them.
KEPT, POOL = 21, 1 << 22
#: The end of a text, as a word hash of its own.
END = int(tb.mix(np.array([0x454E44], np.uint64))[0])
SMOOTHING = 0.1


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Subwords:
    """Subword ids of words, each read with a space before it. The end of a text has an id of its own.

    A word's ids don't depend on the words around it, so those met before are kept by their hash, one word a slot: `pool` holds
    ids, the end's first. What has no slot is split again."""

    def __init__(self, ranks: bytes):
        import public_tokenizers
        import tiktoken

        self.table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.table, special_tokens={})
        self.size = max(self.table.values()) + 2
        self.opens = np.zeros(self.size, bool)
        self.opens[[i for raw, i in self.table.items() if raw[:1] == b" "]] = True
        self.forget()

    def forget(self) -> None:
        self.pool, self.used = np.full(1 << 16, self.size - 1, np.int32), 1
        self.words = np.zeros(1 << KEPT, np.uint64)
        self.words[0] = ~np.uint64(0)  # as no word stands in another's slot, these are in none
        self.begins, self.sizes = np.zeros(1 << KEPT, np.int32), np.zeros(1 << KEPT, np.int32)

    def find(self, hashes: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in `pool` the ids of each word [start, end) of buf begin, and their number; until the next call."""
        if self.used > POOL:
            self.forget()
        slots = (hashes >> np.uint64(64 - KEPT)).astype(np.int64)
        begins, sizes = self.begins[slots].astype(np.int64), self.sizes[slots].astype(np.int64)
        fresh = np.flatnonzero(self.words[slots] != hashes)
        if not len(fresh):
            return begins, sizes
        words, sample, which = np.unique(hashes[fresh], return_index=True, return_inverse=True)
        body, at = tb.span_bytes(buf, starts[fresh[sample]], ends[fresh[sample]])
        ids, cuts = self.split(body.tobytes(), at)
        if self.used + len(ids) > len(self.pool):
            grown = np.empty(max(2 * len(self.pool), self.used + len(ids)), np.int32)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        self.pool[self.used : self.used + len(ids)] = ids
        new, size = self.used + cuts[:-1], np.diff(cuts)
        self.used += len(ids)
        begins[fresh], sizes[fresh] = new[which], size[which]
        slots = (words >> np.uint64(64 - KEPT)).astype(np.int64)
        last = np.append(slots[1:] != slots[:-1], True)  # of words that want the same slot
        slots = slots[last]
        self.words[slots], self.begins[slots], self.sizes[slots] = words[last], new[last], size[last]
        return begins, sizes

    def split(self, body: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and each word's first (n + 1 values). body has no ASCII white space, so an id
        that starts with a space starts a word."""
        if len(offsets) == 1:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        raw = np.frombuffer(body, np.uint8)
        text = np.insert(raw, offsets[:-1], 0x20).tobytes().decode("utf-8", "replace")
        ids = np.array(self.encoding.encode_ordinary(text), np.int32)
        return ids, np.append(np.flatnonzero(self.opens[ids]), len(ids))


_subwords: dict[int, Subwords] = {}


def _reader(ranks: bytes) -> Subwords:
    key = hash(ranks)
    if key not in _subwords:
        _subwords[key] = Subwords(ranks)
    return _subwords[key]


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buffer in lower case, the words' starts, ends and hashes, and each row's first word."""
    low = tb.lower_ascii(buf)
    starts, ends, first = tb.spans(low, offsets)
    return low, starts, ends, tb.span_hash(low, starts, ends), first


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    words = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(words, kind="stable")
    words = words[order]
    opens = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1]))) if len(words) else np.zeros(0, np.int64)
    return words[opens], (np.add.reduceat(counts[order], opens) if len(words) else counts)


def ask(dealt: DataFrame, ranks, pieces: int) -> DataFrame:
    """(piece, chunk, words, counts, subwords) of (chunk, text, training): each chunk's distinct words in a piece of the
    hash range (sorted uint64), with their counts in its training rows (int64); also a row a task with the subword counts of its
    training rows (null chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(ranks.value)
        subwords = np.zeros(reader.size, np.int64)
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            chunks = batch.column(0).to_numpy()
            for chunk in np.unique(chunks).tolist():
                mine = pa.array(chunks == chunk)
                texts, training = batch.column(1).filter(mine), batch.column(2).filter(mine).to_numpy(zero_copy_only=False)
                for begin, end, buf, offsets in tb.runs(texts, 1 << 20):
                    low, starts, ends, hashes, first = _words(buf, offsets)
                    counted = np.repeat(training[begin:end], np.diff(first))
                    at, sizes = reader.find(hashes[counted], low, starts[counted], ends[counted])
                    subwords += np.bincount(reader.pool[tb.ranges(at, sizes)], minlength=reader.size)
                    rows = int(training[begin:end].sum())
                    subwords[-1] += rows
                    parts, others = held.setdefault(chunk, []), np.unique(hashes[~counted])
                    parts += [np.unique(hashes[counted], return_counts=True), (np.append(others, np.uint64(END)), np.append(np.zeros(len(others), np.int64), rows))]
                    if len(parts) > 16:
                        held[chunk] = [_merged(parts)]
        width = -(-(1 << 64) // pieces)  # a chunk asks only in pieces where it has words, so rows are never more than words
        edges = np.array([min(i * width, (1 << 64) - 1) for i in range(1, pieces)], np.uint64)
        for chunk, parts in held.items():
            words, counts = _merged(parts)
            cuts = [0, *np.searchsorted(words, edges).tolist(), len(words)]
            some = [i for i in range(pieces) if cuts[i + 1] > cuts[i]]
            yield pa.RecordBatch.from_arrays([
                pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int64()),
                pa.array([words[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary()),
                pa.array([counts[cuts[i] : cuts[i + 1]].astype(np.int64).tobytes() for i in some], pa.binary()),
                pa.nulls(len(some), pa.binary()),
            ], names=["piece", "chunk", "words", "counts", "subwords"])
        yield pa.RecordBatch.from_arrays([
            pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([subwords.tobytes()], pa.binary()),
        ], names=["piece", "chunk", "words", "counts", "subwords"])

    return dealt.select("chunk", "text", "training").mapInArrow(tb.lean(run), "piece int, chunk long, words binary, counts binary, subwords binary")


def answer(asked: DataFrame) -> DataFrame:
    """(chunk, piece, words, counts, tokens, types): each question with the counts of all training rows; one row a piece
    carries the piece's training tokens and distinct training words."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        words = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["words"]]
        counts = [np.frombuffer(x.as_buffer(), np.int64) for x in table["counts"]]
        known, sums = _merged(list(zip(words, counts, strict=True)))
        found = [sums[np.searchsorted(known, w)] for w in words]
        rest = len(words) - 1
        return pa.table({
            "chunk": table["chunk"], "piece": table["piece"], "words": table["words"],
            "counts": pa.array([f.astype(np.int64).tobytes() for f in found], pa.binary()),
            "tokens": pa.array([int(sums.sum())] + [0] * rest, pa.int64()), "types": pa.array([int((sums > 0).sum())] + [0] * rest, pa.int64()),
        })

    return asked.filter("chunk is not null").select("piece", "chunk", "words", "counts").groupBy("piece").applyInArrow(run, "chunk long, piece int, words binary, counts binary, tokens long, types long")


def fit(rows: DataFrame, ranks, subwords: np.ndarray, sample_docs: int, sample_windows: int, steps: int, rate: float) -> attention.AttentionModel:
    """Fit on (key, text): first on the rows of smallest hash, as a start, then on all rows."""
    # A row goes by its own hash, so rows without a key, and many rows of one key, are chosen like others.
    named = rows.filter(F.col("text").isNotNull()).select("text", F.xxhash64("key", "text").alias("_hash"))
    sample = named.orderBy("_hash", "text").limit(sample_docs).select("text").repartition(4)
    order = np.argsort(-subwords, kind="stable")
    places = np.full(len(subwords), EMBEDDED, np.int64)
    places[order[:EMBEDDED]] = np.arange(EMBEDDED)
    outside = np.where(places < HEADS, 0, subwords + 0.1)
    tail = np.log(np.maximum(outside, 1e-300) / outside.sum()).astype(np.float32)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(ranks.value)
        for batch in batches:
            for _, _, buf, offsets in tb.runs(batch.column(0)):
                ids, first, _ = _text_ids(reader, *_words(buf, offsets))
                x, target, where = attention.windows(ids, first, places, HEADS)
                row = np.searchsorted(first, where.max(1), side="right")
                rng = np.random.default_rng(int(first[-1]))
                mixed = rng.permutation(len(x))
                mixed = mixed[np.argsort(row[mixed], kind="stable")]
                opens = np.searchsorted(row[mixed], row[mixed], side="left")
                keep = mixed[np.arange(len(mixed)) - opens < sample_windows]
                flat = lambda m: pa.array([r.astype(np.int32).tobytes() for r in m[keep]], pa.binary())
                yield pa.RecordBatch.from_arrays([flat(x), flat(target), flat(where >= 0)], names=["x", "target", "scored"])

    found = sample.mapInArrow(tb.lean(cut), "x binary, target binary, scored binary").collect()  # at most sample_docs * sample_windows windows
    found.sort(key=lambda r: (bytes(r["x"]), bytes(r["target"])))  # the order of arrival must not matter
    table = lambda n: np.array([np.frombuffer(r[n], np.int32) for r in found], np.int64).reshape(-1, attention.WINDOW)
    weights = attention.train(table("x"), table("target"), table("scored") > 0, EMBEDDED + 2, HEADS + 1, steps)
    start = attention.AttentionModel(places, HEADS, tail, weights)
    return _averaged(named.select("text"), ranks, start, rate)


def _averaged(rows: DataFrame, ranks, model: attention.AttentionModel, rate: float, batch: int = 128) -> attention.AttentionModel:
    """model after every task took steps from it over all windows of its rows (text): the mean of the tasks' weights, by windows."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, model = _reader(ranks.value), held.value
        weights, seen = model.weights, 0
        for part in batches:
            for _, _, buf, offsets in tb.runs(part.column(0), 1 << 18):
                ids, first, _ = _text_ids(reader, *_words(buf, offsets))
                x, target, where = attention.windows(ids, first, model.places, model.heads)
                if len(x):
                    weights = attention.train(x, target, where >= 0, EMBEDDED + 2, HEADS + 1, max(1, -(-len(x) // batch)), batch, rate, seed=seen + 1, start=weights)
                    seen += len(x)
        if seen:
            moved = (attention.flat(weights) - attention.flat(model.weights)) * seen
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.append(moved, seen).astype("<f8").tobytes()], pa.binary())], names=["part", "value"])

    total = added(rows.mapInArrow(tb.lean(learn), "part int, value binary"), "<f8")
    if not len(total):
        return model
    weights = attention.unflat(attention.flat(model.weights) + total[:-1] / total[-1], model.weights)
    return attention.AttentionModel(model.places, model.heads, model.tail, weights)


def _text_ids(reader: Subwords, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subword ids of the rows, each with its end, each row's first, and where each token (a row's words, then its end) begins."""
    begins, sizes = reader.find(hashes, low, starts, ends)
    begins, sizes = np.insert(begins, first[1:], 0), np.insert(sizes, first[1:], 1)
    whole = reader.pool[tb.ranges(begins, sizes)]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    rows = first + np.arange(len(first))  # a row has one token more than words
    return whole, starts[rows], starts[:-1]


class Places:
    """Where words stand among sorted distinct hashes, by their first bits."""

    def __init__(self, words: np.ndarray):
        self.words, self.shift = words, np.uint64(64 - max(1, min(24, len(words).bit_length())))
        self.heads = np.searchsorted(words, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift)
        self.most = int(np.diff(np.append(self.heads, len(words))).max())

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each of `hashes`, all of which are among the words."""
        at = np.minimum(self.heads[(hashes >> self.shift).astype(np.int64)], len(self.words) - 1)
        late = np.arange(len(at))
        for _ in range(self.most):
            late = late[self.words[at[late]] != hashes[late]]
            if not len(late):
                break
            at[late] += 1
        return at


def score(
    docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", ranks: str | None = None, chunk_bytes: int = 16 << 20,
    piece_bytes: int = 512 << 20, mixture: float = 0.5, sample_docs: int = 1500, sample_windows: int = 16, steps: int = 500,
    rate: float = 3e-3,
) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    training says which rows are learned from (null: not). Tokens are words (runs of bytes other than ASCII white space, A-Z
    lower-cased) and one end; a null or empty text has the end alone. base_score sums log10((c + 0.1) / (N + 0.1 * (V + 1))) over
    tokens, with c, N and V over all training rows; n_known counts tokens with c > 0. score is the model's log10
    probability of the text. Without a training row every c is 0. Repeated rows are scored and counted each.
    """
    spark = docs.sparkSession
    with open(ranks or default_ranks(), "rb") as file:
        held_ranks = spark.sparkContext.broadcast(file.read())
    key_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    # A text goes by its own hash, so one hot key or source fills no chunk.
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("key", "text"), F.lit(chunks)))
    parts = max(chunks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked, asked_path = written(ask(dealt.repartition(parts, "chunk"), held_ranks, max(16, -(-total // piece_bytes))), "word-questions")
    subwords = added(asked.filter("subwords is not null").select(F.lit(0).alias("part"), F.col("subwords").alias("value")), "<i8")
    answers, _ = written(answer(asked), "word-answers")
    sums = answers.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    n_total, types = sums["n"] or 0, sums["v"] or 0
    remove(spark, asked_path)
    size = _reader(held_ranks.value).size
    model = fit(rows.filter("training"), held_ranks, subwords if len(subwords) else np.zeros(size, np.int64), sample_docs, sample_windows, steps, rate)
    held = spark.sparkContext.broadcast(model)
    none = lambda kind: F.lit(None).cast(kind)
    left = answers.select("chunk", F.col("piece").alias("kind"), "words", "counts", none(key_type).alias("key"), none("string").alias("text"))
    right = dealt.select("chunk", F.lit(2**31 - 1).alias("kind"), none("binary").alias("words"), none("binary").alias("counts"), "key", "text")
    both = left.union(right).repartition(parts, "chunk").sortWithinPartitions("chunk", "kind")
    low = np.log(mixture), np.log1p(-mixture)
    bottom = np.log(n_total + SMOOTHING * (types + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, model = _reader(held_ranks.value), held.value
        chunk, parts, places, base, known = None, [], None, None, None
        for batch in batches:
            chunks, is_answer = batch.column(0).to_numpy(), np.asarray(batch.column(2).is_valid())
            begin = 0
            while begin < len(batch):
                # Runs of rows of one chunk and kind.
                differs = np.flatnonzero((chunks[begin:] != chunks[begin]) | (is_answer[begin:] != is_answer[begin]))
                end = begin + int(differs[0]) if len(differs) else len(batch)
                part = batch.slice(begin, end - begin)
                if chunks[begin] != chunk:
                    chunk, parts, places = chunks[begin], [], None
                if is_answer[begin]:
                    parts += [(np.frombuffer(w.as_buffer().to_pybytes(), np.uint64), np.frombuffer(c.as_buffer().to_pybytes(), np.int64)) for w, c in zip(part.column(2), part.column(3), strict=True)]
                else:
                    if places is None:
                        words, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
                        places, parts = Places(words), []
                        base, known = np.log(counts + SMOOTHING) - bottom, counts > 0
                    yield from scored(part, reader, model, places, base, known)
                begin = end

    def scored(part: pa.RecordBatch, reader: Subwords, model: attention.AttentionModel, places: Places, base: np.ndarray, known: np.ndarray) -> Iterator[pa.RecordBatch]:
        end_at = places.of(np.array([END], np.uint64))[0]
        for begin, end, buf, offsets in tb.runs(part.column(5), 1 << 20):
            low_case, *words, hashes, first = _words(buf, offsets)
            place = np.insert(places.of(hashes), first[1:], end_at)
            rows = (first + np.arange(len(first)))[:-1]
            token_base = base[place]
            ids, row_first, starts = _text_ids(reader, low_case, *words, hashes, first)
            token_model = np.add.reduceat(model.log_probabilities(ids, row_first).astype(np.float64), starts)
            mixed = np.logaddexp(low[0] + token_base, low[1] + token_model)
            count = np.diff(first) + 1
            yield pa.RecordBatch.from_arrays([
                part.column(4).slice(begin, end - begin), pa.array(count, pa.int64()), pa.array(np.add.reduceat(known[place].astype(np.int64), rows)),
                pa.array(np.full(end - begin, n_total), pa.int64()), pa.array(np.add.reduceat(token_base, rows) / np.log(10)), pa.array(np.add.reduceat(mixed, rows) / np.log(10)),
            ], names=[key, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return both.mapInArrow(tb.lean(run), f"{key} {key_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
