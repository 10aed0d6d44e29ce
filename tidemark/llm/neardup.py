"""Near-duplicate documents over word shingles: a signature-coordinate inverted join with exact confirmation.

Each document's set of distinct five-word shingles gets a MinHash signature of `K` coordinates; equal sets become one
node first. Nodes are posted under each (coordinate, value) pair. Coordinates are ordered by how many nodes share them:
a pair that shares at least `T` of the `K` coordinates shares one among the K - T + 1 rarest of either (the prefix), so
only those are posted; values that no other node has need no posting at all, and a node with fewer than `T` shared
values has no partner. Collisions are counted in the prefix, the rest of a pair's coordinates is looked at only where the
count can still reach `T` (the skip), and pairs that reach it are confirmed on their full sets.

A pair of Jaccard similarity 0.75 shares 48 of 64 coordinates on average, with a deviation of 3.5, so T = 29 loses
one in about 10^7 such pairs. Components do not need all pairs of a group: a first round confirms each node against one
or a few hubs, and the second looks only at pairs that this left in different components, and of these at
those whose sets share enough with any other and whose further `BITS` one-bit minima agree often enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import textbytes as tb
from tidemark.llm.components import connected_components
from tidemark.llm.scratch import remove, written

SHINGLE, K, T = 5, 64, 29

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 2**32, K, dtype=np.uint32)
_ODD = _rng.integers(0, 2**32, K, dtype=np.uint32) | np.uint32(1)
BITS = 1024
_FINE_XOR = _rng.integers(0, 2**32, BITS, dtype=np.uint32)
_FINE_ODD = _rng.integers(0, 2**32, BITS, dtype=np.uint32) | np.uint32(1)
_PLACE = tb.mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the rows' shingles (with repeats) and each row's first (n + 1 values). A row of one to four words
    has one shingle, its whole sequence."""
    low = tb.lower_ascii(buf)
    starts, ends, first = tb.spans(low, offsets)
    words = tb.span_hash(low, starts, ends)
    padded = np.concatenate((words, np.zeros(SHINGLE, np.uint64)))
    total = np.zeros(len(words), np.uint64)
    for place in range(SHINGLE):
        total += padded[place : place + len(words)] * _PLACE[place]
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    for row in short:
        n = counts[row]
        total[first[row]] = (words[first[row] : first[row] + n] * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)
    made = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    return tb.mix(total[tb.ranges(first[:-1], made)]), np.concatenate(([0], np.cumsum(made)))


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each row's distinct shingles, in order."""
    values, first = shingles(buf, offsets)
    return [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of K minima for each set; an empty set has zeros."""
    out = np.zeros((len(sets), K), np.uint32)
    sizes = np.array([len(s) for s in sets])
    some = np.flatnonzero(sizes)
    if len(some):
        low = (np.concatenate([sets[i] for i in some]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
        for k in range(K):
            out[some, k] = np.minimum.reduceat((low ^ _XOR[k]) * _ODD[k], starts)
    return out


def sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n_shingles, set_id, sig): set_id is a 128-bit hash of the sorted set, sig its signature (null: no set)."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for begin, end, buf, offsets in tb.runs(batch.column(1)):
                sets = shingle_sets(buf, offsets)
                sizes = np.array([len(s) for s in sets], np.int64)
                sigs = signatures(sets).view(np.int32)
                held = sizes > 0
                sig = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(held, K, 0)))).astype(np.int32)), pa.array(sigs[held].ravel()))
                sig = pa.compute.if_else(pa.array(held), sig, pa.scalar(None, sig.type))
                ids = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(sizes), pa.array(ids, pa.binary()), sig], names=["id", "n_shingles", "set_id", "sig"])

    return rows.mapInArrow(tb.lean(run), "id long, n_shingles long, set_id binary, sig array<int>")


def _sets(docs: DataFrame) -> DataFrame:
    """(id, n, shingles) of (id, text): the sorted set as 64-bit integers one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, buf, offsets in tb.runs(batch.column(1)):
                sets = shingle_sets(buf, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

    return docs.mapInArrow(tb.lean(run), "id long, shingles binary")


def confirm(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) whose sets meet denominator * |a ∩ b| >= numerator * |a ∪ b|."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                keep.append(shared > 0 and denominator * shared >= numerator * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return joined.mapInArrow(tb.lean(run), "a long, b long")


def _token(place: F.Column, value: F.Column) -> F.Column:
    return F.shiftleft(place.cast("long"), 32).bitwiseOR(value.cast("long").bitwiseAND(0xFFFFFFFF))


def prefixes(nodes: DataFrame) -> DataFrame:
    """(id, n, sig, m, token): the posted coordinates of each node that can have a partner, rarest first; m is how many
    of its K coordinates it shares with any other node."""
    postings = nodes.select("id", F.posexplode("sig").alias("place", "value")).select("id", _token(F.col("place"), F.col("value")).alias("token"))
    shared = postings.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    held = postings.join(shared, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("by_df")).filter(F.size("by_df") >= T)
    posted = held.select("id", F.size("by_df").alias("m"), F.explode(F.slice("by_df", F.lit(1), F.size("by_df") - (T - 1))).alias("p"))
    return posted.select("id", "m", F.col("p.token").alias("token")).join(nodes.select("id", "n", "sig"), "id")


def _plausible(numerator: int, denominator: int) -> F.Column:
    """Length filter and skip: sizes that allow the similarity, and T equal coordinates over the whole signatures."""
    sizes = (F.least("na", "nb") * denominator >= F.greatest("na", "nb") * numerator)
    matches = F.size(F.filter(F.zip_with("ga", "gb", lambda x, y: x == y), lambda x: x))
    return sizes & (matches >= T)


def reach_of(sets: DataFrame, labels: DataFrame, numerator: int, denominator: int, rounds: int = 2) -> DataFrame:
    """(id, n, reach) of (id, shingles) and (id, label): the set's size and how many of its shingles stand in a set of
    another label, which no overlap with one can exceed.

    Sets whose reach is below numerator / denominator of their size have no partner of another label; they are left
    out, which lowers the reach of others, for up to `rounds` rounds.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in tb.splits_by(batch.column(0), 256):
                part = batch.slice(begin, end - begin)
                values = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)]
                rows = np.repeat(np.arange(len(part)), [len(v) for v in values])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(np.concatenate(values))], names=["id", "shingle"])

    spark = sets.sparkSession
    each, path = written(sets.mapInArrow(tb.lean(split), "id long, shingle long").join(labels, "id"), "open-shingles")
    reach, reach_path = None, None
    left = None
    for _ in range(rounds):
        held = each if reach is None else each.join(reach.select("id"), "id", "left_semi")
        common = held.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("shingle", F.lit(1).alias("held"))
        following = held.join(common, "shingle", "left").groupBy("id").agg(F.count("*").alias("n"), F.count("held").alias("reach"))
        following, next_path = written(following.filter(F.col("reach") * denominator >= F.col("n") * numerator), "reach")
        if reach_path:
            remove(spark, reach_path)
        reach, reach_path = following, next_path
        count = reach.count()
        if left is not None and count > 0.98 * left:
            break
        left = count
    remove(spark, path)
    return reach


def fine_bits(sets: DataFrame) -> DataFrame:
    """(id, n, bits) of (id, shingles): the set's size and one bit of each of BITS further minima, in 64-bit words. Sets of
    similarity s agree in a bit with probability (1 + s) / 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in tb.splits_by(batch.column(0), 64):
                part = batch.slice(begin, end - begin)
                values = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column(1)]
                sizes = np.array([len(v) for v in values], np.int64)
                low = (np.concatenate(values) >> np.uint64(32)).astype(np.uint32)
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                bits = np.zeros((len(values), BITS), np.uint8)
                for k in range(BITS):
                    bits[:, k] = (np.minimum.reduceat((low ^ _FINE_XOR[k]) * _FINE_ODD[k], starts) >> np.uint32(5)) & np.uint32(1)
                words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * (BITS // 64)), pa.array(words.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), lists], names=["id", "n", "bits"])

    return sets.mapInArrow(tb.lean(run), "id long, n long, bits array<long>")


def pairs_apart(posted: DataFrame, fine: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(a, b) with a < b: nodes of different labels that share a token of (id, token, label), whose sizes, and reach if
    given, allow the similarity and whose bits (id, n, bits) agree as often as at the similarity, less 5.3 standard
    deviations.

    A pair comes from the first token that both have alone, so it is looked at, and made, once. Postings may have `marks`, bits in
    64-bit words, and `more`: no overlap exceeds the bits that both have and the lesser `more` together. Null marks bound nothing.
    Few pairs pass that, so each token makes its own, which keeps the lists of tokens out of the join.
    """
    chance = (1 + numerator / denominator) / 2
    least = int(BITS * chance - 5.3 * (BITS * chance * (1 - chance)) ** 0.5)
    words = [F.col("bits")[i].alias(f"w{i}") for i in range(BITS // 64)]
    bounds = [c for c in ("marks", "more") if c in posted.columns]
    if not bounds:
        fine = fine.join(posted.groupBy("id").agg(F.sort_array(F.collect_set("token")).alias("tokens")), "id")  # a bounded number a node
    side = posted.select("id", "token", "label", *bounds).join(fine.select("id", "n", *words, *[c for c in ("reach", "tokens") if c in fine.columns]), "id")
    named = lambda x: side.select(*[F.col(c).alias(f"{x}_{c}") for c in side.columns])
    sizes = F.least("a_n", "b_n") * denominator >= F.greatest("a_n", "b_n") * numerator
    if "reach" in fine.columns:
        sizes &= F.least("a_reach", "b_reach") * (numerator + denominator) >= (F.col("a_n") + F.col("b_n")) * numerator
    differ = sum((F.bit_count(F.col(f"a_w{i}").bitwiseXOR(F.col(f"b_w{i}"))) for i in range(BITS // 64)), F.lit(0))
    apart = (F.col("a_token") == F.col("b_token")) & (F.col("a_id") < F.col("b_id")) & (F.col("a_label") != F.col("b_label"))
    near = apart & sizes & (differ <= BITS - least)
    if bounds:
        most = F.least("a_more", "b_more") + F.aggregate(F.zip_with("a_marks", "b_marks", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda n, w: n + w)
        near &= F.coalesce(most * (numerator + denominator) >= (F.col("a_n") + F.col("b_n")) * numerator, F.lit(True))
    else:
        near &= F.array_intersect("a_tokens", "b_tokens")[0] == F.col("a_token")  # sorted arrays meet in order
    met = named("a").join(named("b"), near).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return met.distinct() if bounds else met


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", numerator: int = 75, denominator: int = 100) -> DataFrame:
    """(key, n_shingles, component_id, kept): one row a row of docs.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A document's set holds its distinct 5-word
    shingles, or its whole sequence where it has fewer words; null, empty and blank texts have an empty set and are
    linked with nothing. Documents whose sets meet denominator * |∩| >= numerator * |∪| are linked; component_id is the
    smallest key reachable and kept marks it. Rows that share a key are one document with the links of all. A null key
    is linked with nothing, has a null component and is kept. Sets are compared by 64-bit hashes of their shingles.
    """
    spark = docs.sparkSession
    sketches, _ = written(sketch(docs, key, text), "sketches")
    groups = sketches.filter("set_id is not null and id is not null").groupBy("set_id").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    groups, _ = written(groups, "sets")
    nodes = groups.select(F.col("rep").alias("id"), "n", "sig")
    posted, posted_path = written(prefixes(nodes), "postings")
    wanted = posted.select("id").distinct()
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sets, sets_path = written(_sets(rows.join(wanted, "id", "left_semi")), "shingles")

    # First round: each node against up to three hubs. A token's hub is the node with most shared coordinates, which in
    # a group of edited copies is one of the least edited ones.
    best = F.struct(F.col("m"), -F.col("id"))
    hubs = posted.groupBy("token").agg(F.max_by(F.struct("id", "n", "sig"), best).alias("hub"), F.count("*").alias("c")).filter("c > 1").drop("c")
    star = posted.join(hubs, "token").filter(F.col("hub.id") != F.col("id"))
    star = star.groupBy(F.col("id").alias("a"), F.col("hub.id").alias("b")).agg(
        F.count("*").alias("met"), F.first("n").alias("na"), F.first("sig").alias("ga"), F.first("hub.n").alias("nb"), F.first("hub.sig").alias("gb"),
    )
    star = star.filter(_plausible(numerator, denominator)).withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("met"), "b")))
    star, star_path = written(star.filter("nth <= 3").select("a", "b"), "star")
    first, first_path = written(confirm(star, sets, numerator, denominator), "links")
    labels = connected_components(first)

    # Second round: pairs that share a posted coordinate and are still apart.
    labelled = posted.drop("sig").join(labels.withColumnRenamed("component", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    labelled, labelled_path = written(labelled, "labelled")
    apart = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token")
    open_, open_path = written(labelled.join(apart, "token"), "open")
    open_labels = open_.select("id", "label").distinct()
    reach = reach_of(sets.join(open_labels, "id", "left_semi"), open_labels, numerator, denominator)
    fine, fine_path = written(fine_bits(sets.join(reach.select("id"), "id", "left_semi")).join(reach.select("id", "reach"), "id"), "bits")
    met = pairs_apart(open_, fine, numerator, denominator)
    met = met.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    second, second_path = written(confirm(met, sets, numerator, denominator), "links")

    # A key that stands on rows of different sets ties them together.
    tied = sketches.filter("set_id is not null and id is not null").groupBy("id").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).filter("lo <> hi").select("id")
    tied = sketches.join(tied, "id").join(groups.select("set_id", "rep"), "set_id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found, _ = written(connected_components(first.union(second).union(tied)), "components")
    remove(spark, posted_path, sets_path, star_path, first_path, labelled_path, open_path, fine_path, second_path)
    by_set = groups.select("set_id", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component"))
    out = sketches.select("id", "n_shingles", "set_id").join(by_set, "set_id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
