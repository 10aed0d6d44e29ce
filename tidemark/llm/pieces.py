"""A unigram view of a public piece vocabulary: an Aho-Corasick automaton over its bytes, Viterbi piece counts, and
forward-filtering backward-sampling over the lattice of pieces.

A text is a sequence of segments, each a run of spaces with the non-spaces that follow; a space is prepended, and no
piece crosses from a non-space to a space, so segments are independent. All distinct segments of a batch advance
through the automaton together, one byte at a time. In the vocabulary a piece's U+2581 stands for a space; a U+2581 in
a text is an ordinary character without a piece, which keeps decoding lossless.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textbytes as tb

#: What the public unigram decoder takes off the lowest score for a character without a piece.
UNKNOWN_PENALTY = 10.0
#: Scores are multiples of this, so sums below 2^20 are exact in single and double precision alike.
GRAIN = 16


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as bytes (with a space for U+2581), their ids and scores, and the ids of the 256 byte pieces."""

    pieces: tuple[bytes, ...]
    ids: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray
    table: tuple[bytes, ...]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a SentencePiece model file. Scores of a merge-ranked (BPE) model become -ln(rank + 10), rounded to a
        multiple of 1/16, as under Zipf's law; its own scores are ranks and no log-probabilities."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        byte_ids = np.zeros(256, np.int32)
        table: list[bytes] = [b""] * size
        pieces, ids = [], []
        for i in range(size):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(text[3:5], 16)] = i
                table[i] = bytes([int(text[3:5], 16)])
            elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
                table[i] = text.replace("▁", " ").encode()
                pieces.append(table[i])
                ids.append(i)
        rank = np.arange(len(pieces))
        scores = -np.round(GRAIN * np.log(rank + 10)) / GRAIN
        return cls(tuple(pieces), np.array(ids, np.int32), scores, byte_ids, tuple(table))


class Automaton:
    """Aho-Corasick over bytes with a full transition table and, per state, the chain of pieces that end there."""

    def __init__(self, vocabulary: Vocabulary):
        children: list[dict[int, int]] = [{}]
        piece = [-1]
        depth = [0]
        for index, text in enumerate(vocabulary.pieces):
            state = 0
            for byte in text:
                found = children[state].get(byte)
                if found is None:
                    found = len(children)
                    children[state][byte] = found
                    children.append({})
                    piece.append(-1)
                    depth.append(depth[state] + 1)
                state = found
            piece[state] = index
        n = len(children)
        self.piece, self.depth = np.array(piece, np.int32), np.array(depth, np.int32)
        self.step = np.zeros((n, 256), np.uint16 if n < 65536 else np.int32)
        self.first = np.zeros(n, np.int32)  # the state itself if a piece ends there, else the next shorter one that does; 0: none
        self.next = np.zeros(n, np.int32)
        fail = np.zeros(n, np.int64)
        level = [0]
        while level:
            below: list[int] = []
            for state in level:
                if state:
                    self.step[state] = self.step[fail[state]]
                    self.next[state] = self.first[fail[state]]
                    self.first[state] = state if piece[state] >= 0 else self.next[state]
                for byte, child in children[state].items():
                    fail[child] = self.step[fail[state], byte] if state else 0
                    below.append(child)
                if children[state]:
                    self.step[state, list(children[state])] = list(children[state].values())
            level = below
        self.score = np.where(self.piece >= 0, vocabulary.scores[self.piece], 0.0)
        self.unknown = float(vocabulary.scores.min()) - UNKNOWN_PENALTY
        self.vocabulary = vocabulary


_built: dict[int, Automaton] = {}


def automaton(vocabulary: Vocabulary) -> Automaton:
    """One automaton for each vocabulary and Python process."""
    key = hash((vocabulary.pieces, vocabulary.scores.tobytes()))
    if key not in _built:
        _built[key] = Automaton(vocabulary)
    return _built[key]


@dataclass
class Segments:
    """Distinct segments of some rows (longest first) and where each row's occurrences are."""

    data: np.ndarray  # bytes of the distinct segments, one after another
    begin: np.ndarray
    length: np.ndarray
    which: np.ndarray  # of each occurrence, the distinct segment
    first: np.ndarray  # of each row, its first occurrence (n + 1 values)

    @property
    def node(self) -> np.ndarray:
        """The first lattice node of each distinct segment; it has length + 1 nodes."""
        return self.begin + np.arange(len(self.begin))


def segments(texts: pa.Array) -> Segments:
    raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
    none = pa.scalar(b"", pa.large_binary())
    full = pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), raw, none)
    full = pc.if_else(pc.equal(pc.binary_length(raw), 0), none, full)  # an empty text has no segment
    _, offsets, data = full.buffers()
    at = np.frombuffer(offsets, np.int64)[full.offset : full.offset + len(full) + 1]
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    space = buf == 0x20
    opens = space.copy()
    opens[1:] &= ~space[:-1]
    opens[at[:-1][np.diff(at) > 0]] = True
    starts = np.flatnonzero(opens)
    ends = np.append(starts[1:], len(buf))[: len(starts)]
    _, sample, which = np.unique(tb.span_hash(buf, starts, ends), return_index=True, return_inverse=True)
    order = np.argsort(-(ends - starts)[sample], kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    sample = sample[order]
    body, begin = tb.span_bytes(buf, starts[sample], ends[sample])
    return Segments(body, begin[:-1], np.diff(begin), place[which], np.searchsorted(starts, at))


def walk(machine: Automaton, seg: Segments) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Edges of all lattices in an order that dynamic programming can follow: (bytes so far, target nodes, source
    nodes, states, or -1 for a character without a piece, and the edges' byte lengths). At one target, longer pieces come first."""
    node, data = seg.node, seg.data
    steps = int(seg.length[0]) if len(seg.length) else 0
    active = np.searchsorted(-seg.length, -np.arange(steps), side="left")
    state = np.zeros(len(node), np.int64)
    last = np.zeros(len(node), np.int64)  # where the character that is being read began
    for t in range(steps):
        k = int(active[t])
        at = seg.begin[:k] + t
        byte = data[at]
        last[:k] = np.where((byte & 0xC0) != 0x80, t, last[:k])
        state[:k] = machine.step[state[:k], byte]
        width = t + 1 - last[:k]
        single = np.zeros(k, bool)
        rows, here = np.arange(k), machine.first[state[:k]]
        while True:
            held = np.flatnonzero(here)
            if not len(held):
                break
            rows, here = rows[held], here[held]
            size = machine.depth[here]
            target = node[rows] + t + 1
            single[rows] |= size == width[rows]
            yield t + 1, target, target - size, here, size
            here = machine.next[here]
        closed = np.ones(k, bool)
        more = seg.length[:k] > t + 1
        closed[more] = (data[at[more] + 1] & 0xC0) != 0x80
        bare = np.flatnonzero(closed & ~single)
        if len(bare):
            target = node[bare] + t + 1
            yield t + 1, target, target - width[bare], np.full(len(bare), -1), width[bare]


def count_best(machine: Automaton, seg: Segments) -> tuple[np.ndarray, np.ndarray]:
    """Best score and piece count of each distinct segment. Of equal scores the first one met stays, so the longest
    last piece wins, as in the public unigram decoder; a character without a piece falls back to its bytes."""
    total = len(seg.data) + len(seg.begin)
    best = np.full(total, -np.inf)
    count = np.zeros(total, np.int64)
    best[seg.node] = 0.0
    for _, target, source, states, size in walk(machine, seg):
        unknown = states[0] < 0
        score = best[source] + (machine.unknown if unknown else machine.score[states])
        better = score > best[target]
        target, source = target[better], source[better]
        best[target] = score[better]
        count[target] = count[source] + (size[better] if unknown else 1)
    end = seg.node + seg.length
    return best[end], count[end]


def sample(machine: Automaton, seg: Segments, seeds: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """One segmentation for each row, drawn with probability proportional to exp(theta * score): piece ids of all rows,
    and each row's first (n + 1 values). seeds: a 64-bit value a row."""
    total = len(seg.data) + len(seg.begin)
    alpha = np.full(total, -np.inf)
    alpha[seg.node] = 0.0
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for _, target, source, states, size in walk(machine, seg):
        weight = alpha[source] + theta * (machine.unknown if states[0] < 0 else machine.score[states])
        alpha[target] = np.logaddexp(alpha[target], weight)
        found.append((target, size.astype(np.int32), states.astype(np.int32), weight))
    occurrences = len(seg.which)
    if not occurrences:
        return np.zeros(0, np.int32), np.zeros(len(seg.first), np.int64)
    target, size, states, weight = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(target, kind="stable")
    target, size, states, weight = target[order], size[order], states[order], weight[order]
    begin = np.searchsorted(target, np.arange(total + 1))
    share = np.exp(weight - alpha[target])
    running = np.cumsum(share)
    upto = running - np.concatenate(([0.0], running))[begin[target]]
    upto[begin[1:][begin[1:] > begin[:-1]] - 1] = 2.0  # rounding never leaves a draw without an edge
    # Backward sampling: all occurrences draw their last piece, then the one before, until each is at its start.
    per_row = np.diff(seg.first)
    ordinal = np.arange(occurrences) - np.repeat(seg.first[:-1], per_row)
    seed = tb.mix(np.repeat(seeds.astype(np.uint64), per_row) + ordinal.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    home, here, alive = seg.node[seg.which], (seg.node + seg.length)[seg.which], np.arange(occurrences)
    drawn: list[tuple[np.ndarray, np.ndarray]] = []
    while len(alive):
        seed[alive] = tb.mix(seed[alive] + np.uint64(0xD1B54A32D192ED03))
        uniform = (seed[alive] >> np.uint64(11)).astype(np.float64) * 2.0**-53
        edge = begin[here[alive]].copy()
        late = np.flatnonzero(uniform >= upto[edge])
        while len(late):
            edge[late] += 1
            late = late[uniform[late] >= upto[edge[late]]]
        drawn.append((alive, edge))
        here[alive] -= size[edge]
        alive = alive[here[alive] > home[alive]]
    pieces = np.zeros(occurrences, np.int64)
    for rows, edge in drawn:
        pieces[rows] += np.where(states[edge] < 0, size[edge], 1)
    stop = np.cumsum(pieces)
    ids = np.empty(int(stop[-1]), np.int32)
    fill = stop.copy()
    end = (seg.begin + seg.length)[seg.which]
    vocabulary = machine.vocabulary
    for rows, edge in drawn:
        plain = states[edge] >= 0
        some = rows[plain]
        fill[some] -= 1
        ids[fill[some]] = vocabulary.ids[machine.piece[states[edge[plain]]]]
        bare, width = rows[~plain], size[edge[~plain]]
        for back in range(1, 5):
            held = width >= back
            ids[fill[bare[held]] - back] = vocabulary.byte_ids[seg.data[end[bare[held]] - back]]
        fill[bare] -= width
        end[rows] -= size[edge]
    return ids, np.concatenate(([0], stop))[seg.first]


def decode(ids: np.ndarray, first: np.ndarray, vocabulary: Vocabulary) -> list[bytes]:
    """Each row's bytes again: its pieces one after another without the prepended space."""
    sizes = np.array([len(x) for x in vocabulary.table])
    begins = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    body = np.frombuffer(b"".join(vocabulary.table), np.uint8)
    data = body[tb.ranges(begins[ids], sizes[ids])].tobytes()
    ends = np.concatenate(([0], np.cumsum(sizes[ids])))[first]
    return [data[a + 1 : b] if b > a else b"" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _parts(column: pa.Array, max_bytes: int) -> Iterator[pa.Array]:
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(column):
        below = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, below + max_bytes, side="right")))
        yield column.slice(first, end - first)
        first = end


def token_counts(docs: DataFrame, text: str = "text", model: str | None = None, max_bytes: int = 4 << 20) -> DataFrame:
    """All columns of docs, then n_pieces and best_score: the piece count and score of the best unigram segmentation.

    A null or empty text has 0 pieces and score 0. Columns of docs that bear an output's name give way to it.
    """
    vocabulary = Vocabulary.load(model or default_model())
    docs = docs.drop("n_pieces", "best_score")
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_pieces", T.LongType()), T.StructField("best_score", T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(held.value)
        for batch in batches:
            counts, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
            for part in _parts(batch.column(at), max_bytes):
                seg = segments(part)
                best, count = count_best(machine, seg)
                counts.append(np.diff(np.concatenate(([0], np.cumsum(count[seg.which])))[seg.first]))
                scores.append(np.diff(np.concatenate(([0.0], np.cumsum(best[seg.which])))[seg.first]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(counts)), pa.array(np.concatenate(scores))], names=[*batch.schema.names, "n_pieces", "best_score"])

    return docs.mapInArrow(tb.lean(run), schema)


def encode_sampled(
    docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None, theta: float = 1.0, seed: int = 0,
    digest: bool = False, max_bytes: int = 1 << 20,
) -> DataFrame:
    """All columns of docs, then piece_ids: one segmentation of each text, drawn by forward filtering and backward
    sampling with probability proportional to exp(theta * score).

    The draw depends on the key, the seed and the text alone, so it is the same on every run and partitioning; rows of
    equal key and text get equal pieces. A null or empty text has no pieces. With digest, n_pieces, piece_crc32 (of the
    ids as little-endian int32) and lossless (decoding gives the text's bytes again) take the place of piece_ids.
    Columns of docs that bear an output's name give way to it.
    """
    vocabulary = Vocabulary.load(model or default_model())
    added = [T.StructField("n_pieces", T.LongType()), T.StructField("piece_crc32", T.LongType()), T.StructField("lossless", T.BooleanType())] if digest else [T.StructField("piece_ids", T.ArrayType(T.IntegerType()))]
    docs = docs.drop(*(f.name for f in added))
    at, width = docs.columns.index(text), len(docs.columns)
    schema = T.StructType([*docs.schema.fields, *added])
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    seeded = docs.select("*", F.xxhash64(F.lit(seed), F.col(key)).alias("__seed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        machine = automaton(held.value)
        for batch in batches:
            done = 0
            for part in _parts(batch.column(at), max_bytes):
                rows = batch.slice(done, len(part))
                done += len(part)
                seeds = rows.column(width).to_numpy(zero_copy_only=False).view(np.uint64)
                ids, first = sample(machine, segments(part), seeds, theta)
                if digest:
                    back = decode(ids, first, held.value)
                    raw = part.cast(pa.binary()).to_pylist()
                    crc = [zlib.crc32(ids[a:b].astype("<i4").tobytes()) for a, b in zip(first[:-1], first[1:], strict=True)]
                    new = [pa.array(np.diff(first)), pa.array(crc, pa.int64()), pa.array([(x or b"") == y for x, y in zip(raw, back, strict=True)], pa.bool_())]
                else:
                    new = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))]
                yield pa.RecordBatch.from_arrays([*rows.columns[:width], *new], names=[f.name for f in schema.fields])

    return seeded.mapInArrow(tb.lean(run), schema)
