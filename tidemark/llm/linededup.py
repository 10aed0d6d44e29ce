"""Fuzzy line deduplication: character-shingle MinHash, banding, exact confirmation, union-find, one line kept a component.

Equal lines become one node by their hash first. Lines are alike where their sets of distinct shingles of `SHINGLE`
characters have a Jaccard similarity of THRESHOLD: one replaced word of five letters keeps a line of 40 characters linked.
Candidates agree in all ROWS minima of one of BANDS bands. The minima run over longer shingles of `PROBE` characters, of which
unlike lines share few, so bands stay selective. An edited line shares fewer of them too: with one word of five letters replaced,
0.42 at 40 characters and 0.5 at 50, where a pair is met with probability 0.95 and 0.995; more beyond.

Most lines share no band with another. Which values are shared is found on packed arrays: texts are dealt into chunks of
about `chunk_bytes`; each chunk asks for its distinct values in pieces of the hash range; one reduction a piece sorts a bounded
number of values, of which a hot one counts once a chunk, and answers with those that two chunks or two lines have. Only lines
with a shared value become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.llm import textbytes as tb
from tidemark.llm.components import connected_components
from tidemark.llm.neardup import fine_bits, pairs_apart
from tidemark.llm.scratch import remove, written

SHINGLE, PROBE, BANDS, ROWS = 5, 9, 40, 3
THRESHOLD = 0.6

_rng = np.random.default_rng(20240301)
_ODD = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_TAG = _rng.integers(0, 2**63, BANDS + 1, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Notes on values, see `ask`.
OWN, TWICE = 65534, 65535
#: Bits of a line's marks, see `_marked`.
CORE, REST = 1024, 1024
#: Shingles whose minima are taken at once, and code points whose shingles are hashed at once.
BLOCK = 1 << 16
POINTS = 1 << 15


def character_shingles(points: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """At each code point the hash of the `size` points (SHINGLE or PROBE) from there on (0 beyond the end), by doubling."""

    def followed(head: np.ndarray, tail: np.ndarray, at: int) -> np.ndarray:
        """The hashes of `head`, each with that of `tail` from `at` points on behind it."""
        factor = _STEP
        for _ in range(1, at if tail is head else 1):
            factor = np.multiply(factor, _STEP)
        out = head * factor
        out[: max(0, len(out) - at)] += tail[at:]
        return out

    one = tb.mix(points.astype(np.uint64) + np.uint64(1))
    two = followed(one, one, 1)
    four = followed(two, two, 2)
    if size == SHINGLE:
        return followed(four, one, 4)
    eight = followed(four, four, 4)
    return followed(eight, one, 8)


def line_sets(text: str) -> np.ndarray:
    """Distinct shingles of one line, in order; a line shorter than a shingle has one, its whole."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.unique(character_shingles(points)[: max(1, len(points) - SHINGLE + 1)])


def sets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The `line_sets` of lines one after another, and their n + 1 offsets."""
    buf, _ = tb.joined(texts)
    points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    first, last = _lines(points)
    hashes = np.empty(len(points), np.uint64)
    for at in range(0, len(points), POINTS):
        hashes[at : at + POINTS] = character_shingles(points[at : at + POINTS + SHINGLE - 1])[:POINTS]
    counts = np.maximum(1, last - first - SHINGLE + 1)
    out = hashes[tb.ranges(first, counts)]
    cuts = np.concatenate(([0], np.cumsum(counts)))
    for n in np.flatnonzero(last - first < SHINGLE):
        out[cuts[n]] = character_shingles(points[first[n] : last[n]])[0] if last[n] > first[n] else 0
    for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        out[begin:end].sort()
    new = np.concatenate(([True], out[1:] != out[:-1])) if len(out) else np.zeros(0, bool)
    new[cuts[:-1]] = True
    return out[new], np.concatenate(([0], np.cumsum(new)))[cuts]


def _lines(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the lines of joined texts, each of which ends with a line feed."""
    ends = np.flatnonzero(points == 10)
    return np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends, ends


def probe_hashes(points: np.ndarray) -> np.ndarray:
    """32 bits of the hash of the PROBE points from each code point on, worked out in pieces that stay in a core's cache."""
    out = np.empty(len(points), np.uint32)
    for at in range(0, len(points), POINTS):
        hashes = tb.mix(character_shingles(points[at : at + POINTS + PROBE - 1], PROBE))
        hashes >>= np.uint64(32)
        out[at : at + POINTS] = hashes[:POINTS]
    return out


def band_values(points: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A row of BANDS 64-bit values for each line [first, last) of code points, none of which is shorter than PROBE."""
    counts = last - first - PROBE + 1
    hashes = probe_hashes(points)
    least = np.empty((BANDS, ROWS, len(first)), np.uint32)
    ends = np.cumsum(counts)
    begin = 0
    while begin < len(first):  # lines of about BLOCK shingles, which stay in a core's cache
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + BLOCK, side="right")))
        low = hashes[tb.ranges(first[begin:end], counts[begin:end])]
        at = ends[begin:end] - counts[begin:end] - (ends[begin - 1] if begin else 0)
        turned = np.empty_like(low)
        for k, rows in enumerate(least):
            for r, row in enumerate(rows):
                np.multiply(low, _ODD[ROWS * k + r], out=turned)  # multiplication by an odd number permutes the hashes
                np.minimum.reduceat(turned, at, out=row[begin:end])
        begin = end
    joint = np.repeat(_TAG[:BANDS, None], len(first), axis=1)
    for r in range(ROWS):
        joint *= _STEP
        joint += least[:, r]
        joint = tb.mix(joint)
    return np.ascontiguousarray(joint.T)


def note(lines: np.ndarray) -> np.ndarray:
    """16 bits of each line's hash, none of them OWN or TWICE."""
    return (lines % np.uint64(OWN)).astype(np.uint16)


def _read(texts: pa.Array, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: (first row, rows' line counts, row, number, hash of each counted line, which of them have bands, their
    values, the buffer, the lines' starts and ends in it). A line counts if it has a character other than white space. Of equal
    lines of a run the first has bands, and only if wanted, where given, holds its note."""
    for begin, end, buf, offsets in tb.runs(texts):
        starts, ends = _lines(buf)  # in bytes
        row = np.searchsorted(offsets, starts, side="right") - 1
        points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        first, last = _lines(points)  # the same lines in characters
        held = np.maximum.reduceat(buf, starts) > 32 if len(starts) else np.zeros(0, bool)
        number = np.arange(len(starts)) - np.searchsorted(starts, offsets[:-1])[row]
        starts, ends, first, last, row, number = (x[held] for x in (starts, ends, first, last, row, number))
        hashes = tb.span_hash(buf, starts, ends)
        long = np.sort(np.unique(hashes, return_index=True)[1])
        long = long[last[long] - first[long] >= PROBE]
        if wanted is not None:
            long = long[wanted[note(hashes[long])]]
        lengths = last[long] - first[long]
        begins = np.cumsum(lengths) - lengths
        values = band_values(points[tb.ranges(first[long], lengths)], begins, begins + lengths)
        yield begin, np.bincount(row, minlength=end - begin), row, number, hashes, long, values, buf, np.stack((starts, ends))


def dealt(docs: DataFrame, key: str, text: str, chunk_bytes: int) -> tuple[DataFrame, str, int]:
    """(chunk, id, row_hash, text) as a table, its path, and the bytes of all texts. A chunk is a run of rows of one task, of
    about chunk_bytes at the mean length of a text."""
    seen = Observation()
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("row_hash"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("number"))
    table, path = written(rows.observe(seen, F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")), "dealt-lines")
    total = seen.get["bytes"] or 0
    each = max(1, chunk_bytes * seen.get["n"] // max(1, total))
    inside = F.col("number").bitwiseAND((1 << 33) - 1)
    chunk = (F.col("number") - inside).bitwiseOR(F.floor(inside / each).cast("long"))
    return table.select("id", "row_hash", "text", chunk.alias("chunk")), path, total


def ask(chunks: DataFrame, pieces: int) -> DataFrame:
    """(piece, chunk, words, notes, both) of (chunk, text): a chunk's distinct values in a piece of the hash range, sorted, and a
    note on each: TWICE where the chunk has it on two lines that differ, or, for a line's own value, in two places; OWN for another
    line's own value; else 16 bits of the hash of its only line. both holds these bits of the lines of values that two of them have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        edges = np.array([i * -(-(1 << 64) // pieces) for i in range(1, pieces)], np.uint64)

        def packed(chunk: int) -> pa.RecordBatch:
            lines, places = np.unique(np.concatenate([h for h, _, _ in held]), return_counts=True)
            own = tb.mix(lines ^ _TAG[BANDS])
            banded, at = np.unique(np.concatenate([h[long] for h, long, _ in held]), return_index=True)
            values = np.concatenate([v for _, _, v in held])[at].ravel()
            held.clear()
            notes = np.concatenate((np.where(places > 1, TWICE, OWN), np.repeat(note(banded), BANDS))).astype("<u2")
            values = np.concatenate((own, values))
            order = np.argsort(values)  # values that stand twice get one note, whichever comes first
            values, notes = values[order], notes[order]
            again = values[1:] == values[:-1]
            both = np.unique(notes[np.concatenate((again, [False])) | np.concatenate(([False], again))])
            opens = np.flatnonzero(np.concatenate(([True], ~again)))
            notes[opens[:-1][np.diff(opens) > 1]] = TWICE
            if len(opens) and opens[-1] < len(values) - 1:
                notes[opens[-1]] = TWICE
            values, notes = values[opens], notes[opens]
            cuts = [0, *np.searchsorted(values, edges).tolist(), len(values)]
            some = [i for i in range(pieces) if cuts[i + 1] > cuts[i]]
            cut = lambda x: pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary())
            told = pa.array([both.tobytes(), *[b""] * (len(some) - 1)], pa.binary())  # once a chunk
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int64()), cut(values), cut(notes), told], names=["piece", "chunk", "words", "notes", "both"])

        chunk = None
        for batch in batches:
            chunks = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist(), len(chunks)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if held and chunks[begin] != chunk:
                    yield packed(chunk)
                chunk = int(chunks[begin])
                held += [(hashes, long, values) for _, _, _, _, hashes, long, values, _, _ in _read(batch.column(1).slice(begin, end - begin)) if len(hashes)]
        if held:
            yield packed(chunk)

    return chunks.select("chunk", "text").mapInArrow(tb.lean(run), "piece int, chunk long, words binary, notes binary, both binary")


def answer(asked: DataFrame) -> DataFrame:
    """(chunk, words, notes): of each question the values of two lines that differ, and the own values of lines in two places; and
    the notes of these values and of `both`, among which are those of all lines of the chunk with a shared band."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        words = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["words"]]
        notes = [np.frombuffer(x.as_buffer(), "<u2") for x in table["notes"]]
        whole = np.sort(np.concatenate(words))
        again = np.unique(whole[1:][whole[1:] == whole[:-1]])
        del whole
        least, most = np.full(len(again), OWN, np.uint16), np.zeros(len(again), np.uint16)
        for w, n in zip(words, notes, strict=True) if len(again) else ():
            at = np.minimum(np.searchsorted(again, w), len(again) - 1)
            some = again[at] == w
            least[at[some]] = np.minimum(least[at[some]], n[some])  # a question has a value once
            most[at[some]] = np.maximum(most[at[some]], n[some])
        shared = np.unique(np.concatenate([again[(least < most) | (most >= OWN)], *[w[n == TWICE] for w, n in zip(words, notes, strict=True)]]))
        found, told = [], []
        for w, n, both in zip(words, notes, table["both"], strict=True):
            held = shared[np.minimum(np.searchsorted(shared, w), len(shared) - 1)] == w if len(shared) else np.zeros(len(w), bool)
            found.append(w[held].tobytes())
            told.append(np.unique(np.concatenate((n[held], np.frombuffer(both.as_buffer(), "<u2")))).tobytes())
        some = pa.array([len(x) > 0 for x in told], pa.bool_())
        return pa.table({"chunk": table["chunk"], "words": pa.array(found, pa.binary()), "notes": pa.array(told, pa.binary())}).filter(some)

    return asked.groupBy("piece").applyInArrow(run, "chunk long, words binary, notes binary")


def spots_of(chunks: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """(id, row_hash, n_lines) of each row, and (id, row_hash, line_no, line, bands, text) of each of its lines that has a shared
    value. line is a 64-bit hash of its bytes; bands (its shared values) and text stand on a line's first place of a run."""
    id_type = chunks.schema["id"].dataType.simpleString()
    none = lambda kind: F.lit(None).cast(kind)
    left = answers.select("chunk", F.lit(0).alias("kind"), "words", "notes", none(id_type).alias("id"), none("long").alias("row_hash"), none("string").alias("text"))
    right = chunks.select("chunk", F.lit(1).alias("kind"), none("binary").alias("words"), none("binary").alias("notes"), "id", "row_hash", "text")
    both = left.union(right).repartition(parts, "chunk").sortWithinPartitions("chunk", "kind")
    names = ["id", "row_hash", "n_lines", "line_no", "line", "bands", "text"]

    def found(part: pa.RecordBatch, shared: np.ndarray, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
        is_shared = lambda v: shared[np.minimum(np.searchsorted(shared, v), len(shared) - 1)] == v if len(shared) else np.zeros(v.shape, bool)
        for begin, counts, row, number, hashes, long, values, buf, spans in _read(part.column(4), wanted):
            rows = part.slice(begin, len(counts))
            yield pa.RecordBatch.from_arrays([
                rows.column(2), rows.column(3), pa.array(counts.astype(np.int64)), pa.nulls(len(counts), pa.int32()), pa.nulls(len(counts), pa.int64()),
                pa.nulls(len(counts), pa.list_(pa.int64())), pa.nulls(len(counts), pa.string()),
            ], names=names)
            own = is_shared(tb.mix(hashes ^ _TAG[BANDS]))
            hit = is_shared(values.ravel()).reshape(values.shape)
            banded = np.zeros(len(hashes), bool)
            banded[long] = hit.any(1)
            chosen = np.flatnonzero(own | banded)  # further places of a banded line are in own
            if not len(chosen):
                continue
            spells = banded[chosen]
            at_long = np.searchsorted(long, chosen[spells])
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(np.bincount(np.flatnonzero(spells), weights=hit[at_long].sum(1), minlength=len(chosen))))).astype(np.int32)),
                pa.array(values[at_long][hit[at_long]].view(np.int64)), mask=pa.array(~spells),
            )
            body, offsets = tb.span_bytes(buf, *spans[:, chosen[spells]])
            text = pa.StringArray.from_buffers(int(spells.sum()), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body))
            slots = np.full(len(chosen), -1, np.int64)
            slots[spells] = np.arange(spells.sum())
            take = pa.array(row[chosen])
            yield pa.RecordBatch.from_arrays([
                rows.column(2).take(take), rows.column(3).take(take), pa.nulls(len(chosen), pa.int64()), pa.array(number[chosen].astype(np.int32)),
                pa.array(hashes[chosen].view(np.int64)), lists, text.take(pa.array(slots, mask=slots < 0)),
            ], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts, shared, wanted = None, [], None, np.zeros(1 << 16, bool)
        for batch in batches:
            chunks, is_answer = batch.column(0).to_numpy(), batch.column(1).to_numpy() == 0
            cuts = [0, *(np.flatnonzero((chunks[1:] != chunks[:-1]) | (is_answer[1:] != is_answer[:-1])) + 1).tolist(), len(chunks)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if chunks[begin] != chunk:
                    chunk, parts, shared, wanted = chunks[begin], [], None, np.zeros(1 << 16, bool)
                part = batch.slice(begin, end - begin)
                if is_answer[begin]:
                    parts += [np.frombuffer(w.as_buffer().to_pybytes(), np.uint64) for w in part.column(2)]
                    for n in part.column(3):
                        wanted[np.frombuffer(n.as_buffer(), "<u2")] = True
                    continue
                if shared is None:
                    shared, parts = np.sort(np.concatenate([np.zeros(0, np.uint64), *parts])), []
                part = pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(4), part.column(5), part.column(6)], names=["chunk", "kind", "id", "row_hash", "text"])
                yield from found(part, shared, wanted)

    return both.mapInArrow(tb.lean(run), f"id {id_type}, row_hash long, n_lines long, line_no int, line long, bands array<long>, text string")


def _sets(texts: DataFrame) -> DataFrame:
    """(id, shingles) of (line, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in tb.splits_by(batch.column(0), 256):
                values, cuts = sets_of(batch.column(1).slice(begin, end - begin))
                sets = [values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return texts.select("line", "text").mapInArrow(tb.lean(run), "id long, shingles binary")


def confirm(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose lines' character-shingle sets have a Jaccard similarity of threshold or more."""
    joined = pairs.join(texts.select(F.col("line").alias("a"), F.col("text").alias("ta")), "a")
    joined = joined.join(texts.select(F.col("line").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for begin, end in tb.splits_by(batch.column(0), 256):
                part = batch.slice(begin, end - begin)
                lines = np.concatenate((part.column(0).to_numpy(), part.column(1).to_numpy()))
                _, first, at = np.unique(lines, return_index=True, return_inverse=True)
                values, cuts = sets_of(pa.concat_arrays([part.column(2), part.column(3)]).take(pa.array(first)))
                sizes = np.diff(cuts)
                for x, y in at.reshape(2, -1).T.tolist():
                    both = sizes[x] + sizes[y]
                    if min(sizes[x], sizes[y]) < threshold * max(sizes[x], sizes[y]):
                        keep.append(False)
                        continue
                    joint = np.concatenate((values[cuts[x] : cuts[x + 1]], values[cuts[y] : cuts[y + 1]]))
                    joint.sort()
                    shared = int(np.count_nonzero(joint[1:] == joint[:-1]))
                    keep.append(shared >= threshold * (both - shared))
            chosen = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(chosen), batch.column(1).filter(chosen)], names=["a", "b"])

    return joined.mapInArrow(tb.lean(run), "a long, b long")


def linked(lines: DataFrame, threshold: float) -> DataFrame:
    """(id, component) of the lines (line, copies, bands, text) that are alike with another.

    Hub rounds confirm lines against a few lines of each band, in a number that grows with the lines: first its line of most
    copies (in a group of edited lines likely the original), and both lines of a band of two; then, in bands whose lines are still
    apart, the shortest and the longest line, and the line of most copies outside the largest label. Last come the pairs that
    share a band and are still apart, of which bits of further minima leave those near the threshold.
    """
    spark = lines.sparkSession
    banded = lines.filter("bands is not null")
    texts = banded.select("line", "text")
    each = banded.select("line", F.explode("bands").alias("band"))
    shared, shared_path = written(each.groupBy("band").agg(F.min("line").alias("a"), F.max("line").alias("b"), F.count("*").alias("n")).filter("n > 1"), "shared-bands")
    # Most bands have two lines. Only those of the others become postings.
    wide = banded.select("line", "copies", F.length("text").alias("size"), F.explode("bands").alias("band")).join(shared.filter("n > 2").select("band"), "band")
    posted, posted_path = written(wide.select("line", "copies", "size", "band"), "bands")
    hubs = posted.groupBy("band").agg(F.max_by("line", F.struct("copies", "line")).alias("hub"))
    star = posted.join(hubs, "band").filter("hub <> line").groupBy(F.col("line").alias("a"), F.col("hub").alias("b")).agg(F.count("*").alias("met"))
    star = star.withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("met"), "b"))).filter("nth <= 3").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    star, star_path = written(star.union(shared.filter("n = 2").select("a", "b")).distinct(), "star")
    remove(spark, shared_path)
    first, first_path = written(confirm(star, texts, threshold), "links")
    labels, labels_path = written(connected_components(first), "labels")
    seen = star
    paths = [posted_path, star_path, first_path, labels_path]

    def still_open(posted: DataFrame, labels: DataFrame) -> DataFrame:
        """The postings of bands whose lines have several labels."""
        labelled = posted.select("line", "copies", "size", "band").join(labels.withColumnRenamed("id", "line"), "line", "left").withColumn("label", F.coalesce("component", "line")).drop("component")
        apart = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("band")
        found, path = written(labelled.join(apart, "band"), "open")
        paths.append(path)
        return found

    open_ = posted
    for _ in range(2):
        open_ = still_open(open_, labels)  # a band of one label keeps one
        sizes = open_.groupBy("band", "label").agg(F.count("*").alias("n"), F.max(F.struct("copies", "line")).alias("most"))
        largest = sizes.groupBy("band").agg(F.max(F.struct("n", "label")).alias("largest")).select("band", F.col("largest.label").alias("main"))
        second = sizes.join(largest, "band").filter("label <> main").groupBy("band").agg(F.max("most").alias("most")).select("band", F.col("most.line").alias("hub"))
        ends = open_.groupBy("band").agg(F.min(F.struct("size", "line")).alias("lo"), F.max(F.struct("size", "line")).alias("hi"))
        hubs = second.union(ends.select("band", "lo.line")).union(ends.select("band", "hi.line")).distinct()
        hubs = hubs.join(open_.select("band", F.col("line").alias("hub"), F.col("label").alias("hub_label")), ["band", "hub"])
        more = open_.join(hubs, "band").filter("label <> hub_label").select(F.least("line", "hub").alias("a"), F.greatest("line", "hub").alias("b")).distinct().join(seen, ["a", "b"], "left_anti")
        more, more_path = written(more, "star")
        found, found_path = written(confirm(more, texts, threshold), "links")
        seen = seen.union(more)
        labels, path = written(_joined(labels, found), "labels")
        paths += [more_path, found_path, path]
    open_ = still_open(open_, labels).select(F.col("band").alias("token"), F.col("line").alias("id"), "label", "copies")
    marked, marks_path = _marked(open_, texts)
    open_, core_path = written(marked, "open")
    fine, fine_path = written(fine_bits(_sets(texts.join(open_.select(F.col("id").alias("line")).distinct(), "line", "left_semi"))), "bits")
    met = pairs_apart(open_, fine, round(threshold * 1000), 1000).join(seen, ["a", "b"], "left_anti")
    last, last_path = written(confirm(met, texts, threshold), "links")
    out, _ = written(_joined(labels, last), "line-components")
    remove(spark, *paths, marks_path, core_path, fine_path, last_path)
    return out


def _marked(open_: DataFrame, texts: DataFrame, small: int = 32) -> tuple[DataFrame, str]:
    """(token, id, label, marks, more) of the postings, which bound how far two lines of a band overlap, and a path that it reads.

    In a band of more than `small` lines, a line is marked against the set of the band's hub (the line that stands in most
    bands): a bit for each of the hub's first CORE shingles that it has, and one for each of REST buckets that hold others of its
    shingles which stand in another line around that hub. `more` counts what has no bit of its own: further shingles of the hub
    and second ones of a bucket. Lines overlap by at most the bits that both have and the lesser `more`. Bands of up to `small` lines have no marks
    (null): their pairs are a fixed number a posting.
    """
    # Hubs that stand in many bands serve most of them, so a line is marked against few.
    degrees = open_.groupBy("id").agg(F.count("*").alias("degree"))
    bands = open_.join(degrees, "id").groupBy("token").agg(F.max_by("id", F.struct("degree", "copies", "id")).alias("hub"), F.count("*").alias("n")).filter(F.col("n") > small).select("token", "hub")
    around = open_.join(bands, "token")
    members = around.select("id", "hub").distinct().join(texts.select(F.col("line").alias("id"), "text"), "id").join(texts.select(F.col("line").alias("hub"), F.col("text").alias("core")), "hub")
    listed = lambda x: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32)), pa.array(np.concatenate(x).view(np.int64)))
    packed = lambda bits: listed(list(np.packbits(bits, axis=1, bitorder="little").view(np.int64)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingles outside the hub's set are told apart by hub, too."""
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            for begin, end in tb.splits_by(batch.column(0), 256):
                part = batch.slice(begin, end - begin)
                bits, more, others = np.zeros((len(part), CORE), np.uint8), np.zeros(len(part), np.int64), []
                for n, (hub, text, spelled) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3), strict=True)):
                    if hub not in known:
                        if len(known) > 2048:
                            known.clear()
                        known[hub] = line_sets(spelled.as_py())
                    mine = line_sets(text)
                    at = np.searchsorted(known[hub], mine)
                    held = known[hub].take(at, mode="clip") == mine
                    bits[n, at[held & (at < CORE)]] = 1
                    more[n] = np.count_nonzero(held & (at >= CORE))
                    others.append(tb.mix(mine[~held] ^ np.array([hub], np.int64).view(np.uint64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed(bits), pa.array(more), listed(others)], names=["id", "hub", "marks", "more", "others"])

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in tb.splits_by(batch.column(0), 256):
                part = batch.slice(begin, end - begin)
                bits, more = np.zeros((len(part), REST), np.uint8), part.column(3).to_numpy().copy()
                for n, (others, alone) in enumerate(zip(part.column(4), part.column(5), strict=True)):
                    held = others.values.to_numpy()
                    if alone.is_valid:
                        held = np.setdiff1d(held, alone.values.to_numpy(), assume_unique=True)
                    bits[n, held % REST] = 1
                    more[n] += len(held) - np.count_nonzero(bits[n])
                marks = np.concatenate((part.column(2).flatten().to_numpy().reshape(len(part), CORE // 64), np.packbits(bits, axis=1, bitorder="little").view(np.int64)), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), listed(list(marks)), pa.array(more)], names=["id", "hub", "marks", "more"])

    spark = open_.sparkSession
    members, path = written(members.select("id", "hub", "text", "core").mapInArrow(tb.lean(split), "id long, hub long, marks array<long>, more long, others array<long>").withColumn("nth", F.monotonically_increasing_id()), "cores")
    alone = members.select("nth", F.explode("others").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("nth").alias("nth")).filter("n = 1")
    alone = alone.groupBy("nth").agg(F.collect_list("shingle").alias("alone"))  # a line's own
    known = members.join(alone, "nth", "left").select("id", "hub", "marks", "more", "others", "alone")
    known, known_path = written(known.mapInArrow(tb.lean(bucketed), "id long, hub long, marks array<long>, more long"), "marks")
    remove(spark, path)
    large = around.join(known, ["id", "hub"]).select("token", "id", "label", "marks", "more")
    return open_.join(bands.select("token"), "token", "left_anti").select("token", "id", "label", F.lit(None).cast("array<long>").alias("marks"), F.lit(None).cast("long").alias("more")).union(large), known_path


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, component) after further links (a, b), of which only those between labels matter."""
    of = lambda side: labels.select(F.col("id").alias(side), F.col("component").alias(f"{side}_label"))
    bridges = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).filter("a <> b")
    bridges, path = written(bridges, "bridges")
    if bridges.isEmpty():
        remove(labels.sparkSession, path)
        return labels
    joint = connected_components(bridges)
    remove(labels.sparkSession, path)
    joint = joint.select(F.col("id").alias("component"), F.col("component").alias("whole"))
    out = labels.join(joint, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
    alone = joint.join(labels.select(F.col("id").alias("component")), "component", "left_anti").select(F.col("component").alias("id"), F.col("whole").alias("component"))
    return out.union(alone)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, chunk_bytes: int = 8 << 20, piece_values: int = 1 << 22) -> DataFrame:
    """All columns of docs with the text rid of repeated lines, then n_lines and n_kept.

    Lines end at line feeds; those without a character other than white space are never dropped nor counted. Equal
    lines, and lines linked through similarities of at least `threshold`, keep one occurrence: that of the smallest key,
    row hash and line number; a null key comes first. A line of fewer than PROBE characters is like its equals alone. n_lines
    counts a text's lines, n_kept those that stay. A null text stays null with 0 lines. Identical rows are one document and get
    the same text. Columns named like an output give way to it; any other name may stand in docs. Keys may be of any type
    that can be sorted.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_kept")
    chunks, chunks_path, total = dealt(docs, key, text, chunk_bytes)
    pieces = max(8, (BANDS + 1) * total // (128 * piece_values))  # lines are longer than that as a rule
    answers, answers_path = written(answer(ask(chunks, pieces)), "shared-values")
    parts = max(-(-total // chunk_bytes) // 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spots, spots_path = written(spots_of(chunks, answers, parts), "lines")
    remove(spark, chunks_path, answers_path)

    place = F.struct("id", "row_hash", "line_no")
    some = spots.filter("line is not null")
    spelled = lambda c: F.first(c, ignorenulls=True).alias(c)  # noqa: E731  the same wherever it stands
    lines, lines_path = written(some.groupBy("line").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("copies"), spelled("bands"), spelled("text")), "distinct-lines")
    components = linked(lines, threshold)

    # The occurrence that each repeated line keeps.
    joined = lines.join(components.withColumnRenamed("id", "line"), "line", "left").select("line", "first", "last", "component")
    kept = joined.filter("component is not null").groupBy("component").agg(F.min("first").alias("keep"))
    kin = joined.filter("component is not null").join(kept, "component").select("line", "keep")
    alone = joined.filter("component is null and not (first <=> last)").select("line", F.col("first").alias("keep"))
    gone = some.select("id", "row_hash", "line_no", "line").join(kin.union(alone), "line").filter(~place.eqNullSafe(F.col("keep")))
    gone = gone.groupBy("id", "row_hash").agg(F.collect_set("line_no").alias("gone"))
    counted = spots.filter("line is null").groupBy("id", "row_hash").agg(F.max("n_lines").alias("n_lines"))
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["row_hash"] == b["row_hash"])
    known, _ = written(counted.join(gone, same(counted, gone), "left").select(counted["id"], counted["row_hash"], "n_lines", "gone"), "dropped-lines")
    remove(spark, spots_path, lines_path)

    # The columns of docs travel in a struct, so none of them can clash with one of these.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(key).alias("id"), F.xxhash64(text).alias("row_hash"))
    body = F.col("doc")[text]
    rows = rows.join(known.hint("shuffle_hash"), same(rows, known), "left").select("doc", "n_lines", "gone", F.when(F.col("gone").isNotNull(), F.split(body, "\n")).alias("parts"))
    # A projection that is used twice stays one, so a text is split once, not once a line.
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    rest = F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "\n")
    columns = [F.when(F.col("gone").isNull(), body).otherwise(rest).alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns]
    n_kept = F.col("n_lines") - F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return rows.select(*columns, "n_lines", n_kept.alias("n_kept"))
