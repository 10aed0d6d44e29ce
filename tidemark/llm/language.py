"""Language identification of whole texts, with spans for mixed-language text.

Script ranges of the letters narrow each word's candidate languages; a word's score under a language is its
naive-Bayes log-likelihood over byte bigrams and trigrams; Viterbi over the words with a penalty for each
change of language labels spans. The model is fitted on a bounded sample of labelled rows (`per_language`);
prediction reads the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textbytes as tb

#: UTF-8 lead bytes of each script's ranges; a word belongs to the script of its first letter.
SCRIPTS = {
    "latin": [*range(0x61, 0x7B), *range(0xC3, 0xCA)],
    "greek": [0xCD, 0xCE, 0xCF],
    "cyrillic": [0xD0, 0xD1, 0xD2, 0xD3],
    "semitic": [0xD6, 0xD7, 0xD8, 0xD9, 0xDA, 0xDB],
    "indic": [0xE0],
    "asian": [0xE1, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xEB, 0xEC, 0xED],
}
_SCRIPT = np.full(256, len(SCRIPTS), dtype=np.int8)
for _i, _leads in enumerate(SCRIPTS.values()):
    _SCRIPT[_leads] = _i

#: Bytes that stay in a word: lower-case letters and everything beyond ASCII; all else parts words.
_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_LETTER = _FOLD != 0x20

TRIGRAMS = 1 << 15


def _folded(buf: np.ndarray) -> np.ndarray:
    return _FOLD[tb.lower_latin(buf)]


def _grams(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At each byte: the code of the bigram and the bucket of the trigram that end there."""
    wide = buf.astype(np.int32)
    before = np.concatenate((np.array([0x20], np.int32), wide[:-1]))
    two = before * 256 + wide
    three = (np.concatenate((np.array([0x20], np.int32), before[:-1])) * 65536 + two).astype(np.uint32)
    return two, ((three * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)).astype(np.int32)


@dataclass(frozen=True)
class LanguageModel:
    """languages, log-likelihoods by (gram, language), and which languages each script admits."""

    languages: tuple[str, ...]
    two: np.ndarray
    three: np.ndarray
    allowed: np.ndarray
    penalty: float

    def word_scores(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per word the scores by language and its length; per row the index of its first word."""
        low = _folded(buf)
        starts, ends, first = tb.spans(low, offsets, _LETTER)
        if not len(starts):
            return np.zeros((0, len(self.languages)), np.float32), np.zeros(0, np.int64), first
        two, three = _grams(low)
        at = self.two[two]
        at += self.three[three]
        # The byte after a word closes it, so each reduction runs from the word's first byte to that one.
        edges = np.empty(2 * len(starts), dtype=np.int64)
        edges[0::2], edges[1::2] = starts, np.minimum(ends + 1, len(low) - 1)
        scores = np.add.reduceat(at, edges, axis=0)[0::2]
        scores += self.allowed[_SCRIPT[low[starts]]]
        return scores, ends - starts, first

    def viterbi(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best label of each word; rows advance together, longest first."""
        n = len(scores)
        labels = np.zeros(n, dtype=np.int8)
        lengths = np.diff(first)
        order = np.argsort(-lengths, kind="stable")
        begin, lengths = first[:-1][order], lengths[order]
        steps = int(lengths[0]) if len(lengths) else 0
        if not steps:
            return labels
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")
        if len(self.languages) == 1:
            return labels
        switched = np.zeros((n, len(self.languages)), dtype=bool)
        came = np.zeros(n, dtype=np.int8)
        best = scores[begin[: active[0]]].copy()
        finals = np.zeros(len(lengths), dtype=np.int8)
        for t in range(1, steps + 1):
            k = int(active[t]) if t < steps else 0
            if k < len(best):
                finals[k : len(best)] = best[k:].argmax(1)
                best = best[:k]
            if not k:
                break
            at = begin[:k] + t
            top = best.argmax(1)
            change = best[np.arange(k), top][:, None] - self.penalty
            switched[at] = best < change
            came[at] = top
            best = np.maximum(best, change) + scores[at]
        label = finals
        for t in range(steps - 1, -1, -1):
            k = int(active[t])
            at = begin[:k] + t
            labels[at] = label[:k]
            if t:
                label[:k] = np.where(switched[at, label[:k]], came[at], label[:k])
        return labels


def fit(
    rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 600,
    penalty: float = 8.0, min_script_share: float = 0.01,
) -> LanguageModel:
    """Fit on at most `per_language` distinct rows of each language, those of smallest hash of key and text (a null key is a value like others);
    rows without a label or text are left out. No labelled row at all gives a model that knows no language.

    A language's rows are thinned by a hash threshold from its count before any order is taken, so no task sees more than a few times
    `per_language` hashes of one language, however many rows it has.
    """
    named = rows.select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), F.xxhash64(F.col(key), F.col(text)).alias("_hash"))
    named = named.filter(F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    counts = named.groupBy("_lang").agg(F.count("*").alias("_rows"))
    even = F.pmod(F.xxhash64("_hash"), F.lit(1 << 30)) / float(1 << 30)
    few = named.select("_lang", "_hash").join(F.broadcast(counts), "_lang").filter(even * F.col("_rows") < 6.0 * per_language)  # a row a language
    order = Window.partitionBy("_lang").orderBy("_hash")
    chosen = few.select("_lang", "_hash").distinct().withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_language).select("_lang", "_hash")
    sample = named.join(F.broadcast(chosen), ["_hash", "_lang"], "left_semi").groupBy("_hash", "_lang").agg(F.first("_text").alias("_text"))
    schema = "lang string, two binary, three binary, script binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for value in set(batch.column(0).to_pylist()):
                texts = batch.column(1).filter(pa.compute.equal(batch.column(0), value))
                sums = held.setdefault(value, [np.zeros(65536, np.int64), np.zeros(TRIGRAMS, np.int64), np.zeros(len(SCRIPTS) + 1, np.int64)])
                for _, _, buf, offsets in tb.runs(texts):
                    low = _folded(buf)
                    two, three = _grams(low)
                    inside = _LETTER[low]
                    inside[1:] |= inside[:-1]
                    sums[0] += np.bincount(two[inside], minlength=65536)
                    sums[1] += np.bincount(three[inside], minlength=TRIGRAMS)
                    starts, _, _ = tb.spans(low, offsets, _LETTER)
                    sums[2] += np.bincount(_SCRIPT[low[starts]], minlength=len(SCRIPTS) + 1)
        if held:
            yield pa.RecordBatch.from_pydict({"lang": list(held), **{n: [v[i].tobytes() for v in held.values()] for i, n in enumerate(("two", "three", "script"))}})

    found = sample.select("_lang", "_text").repartition(8).mapInArrow(tb.lean(count), schema).collect()  # at most 8 rows a language
    languages = tuple(sorted({r["lang"] for r in found}))
    sums = {n: np.zeros((size, len(languages))) for n, size in (("two", 65536), ("three", TRIGRAMS), ("script", len(SCRIPTS) + 1))}
    for r in found:
        for n, table in sums.items():
            table[:, languages.index(r["lang"])] += np.frombuffer(r[n], np.int64)

    def log_share(table: np.ndarray) -> np.ndarray:
        return np.log((table + 0.5) / (table.sum(0) + 0.5 * len(table))).astype(np.float32) if languages else table.astype(np.float32)

    share = sums["script"] / np.maximum(sums["script"].sum(0), 1)
    admitted = share >= min_script_share
    admitted[~admitted.any(1)] = True  # a script that no language uses narrows nothing
    # Bigrams and trigrams of the same letters say much the same, so each counts half.
    return LanguageModel(languages, log_share(sums["two"]) / 2, log_share(sums["three"]) / 2, np.where(admitted, 0, -1e4).astype(np.float32), penalty)


SPANS = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first_word", T.IntegerType()), T.StructField("n_words", T.IntegerType())]))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", spans: bool = False) -> DataFrame:
    """All columns of docs, then lang_pred, score and, on request, lang_spans.

    lang_pred is the language with most letters over the Viterbi spans (a tie goes to the first by name), score
    its share of them; `und` with score 0 for a null text, a text without letters or a model that knows no language.
    Words are runs of letters. Columns of docs that bear an output's name give way to it.
    """
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())] + ([T.StructField("lang_spans", SPANS)] if spans else [])
    docs = docs.drop(*(f.name for f in added))
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *added])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            langs: list[str] = []
            shares: list[float] = []
            found: list[list[dict]] = []
            column = batch.column(at)
            for begin, end in tb.splits_by(column, 4096):
                part = column.slice(begin, end - begin)
                pieces = [model.word_scores(buf, offsets) for _, _, buf, offsets in tb.runs(part)] if model.languages else []
                if not pieces:
                    langs += ["und"] * len(part)
                    shares += [0.0] * len(part)
                    found += [[] for _ in range(len(part))]
                    continue
                scores = np.concatenate([p[0] for p in pieces])
                letters = np.concatenate([p[1] for p in pieces])
                counts = np.concatenate([np.diff(p[2]) for p in pieces])
                first = np.concatenate(([0], np.cumsum(counts)))
                labels = model.viterbi(scores, first)
                row = np.repeat(np.arange(len(part)), counts)
                many = len(model.languages)
                mass = np.bincount(row * many + labels, weights=letters, minlength=len(part) * many).reshape(len(part), many)
                whole = mass.sum(1)
                top = mass.argmax(1)
                share = np.where(whole > 0, mass.max(1) / np.maximum(whole, 1), 0.0)
                known = np.array([_lettered(x) for x in part], dtype=bool)
                good = (whole > 0) & known
                langs += [model.languages[t] if g else "und" for t, g in zip(top, good, strict=True)]
                shares += np.where(good, share, 0.0).tolist()
                if spans:
                    found += [_spans(labels[first[i] : first[i + 1]], model.languages) if good[i] else [] for i in range(len(part))]
            arrays = [*batch.columns, pa.array(langs, pa.string()), pa.array(shares, pa.float64())]
            names = [*batch.schema.names, "lang_pred", "score"]
            if spans:
                arrays.append(pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))))
                names.append("lang_spans")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(tb.lean(predict), schema)


def _lettered(text: pa.Scalar) -> bool:
    """Whether the text has a letter; ASCII ones settle it without a look at every character."""
    if not text.is_valid:
        return False
    raw = np.frombuffer(text.as_buffer(), np.uint8)[:4096]
    if ((raw >= 0x61) & (raw <= 0x7A)).any():
        return True
    return any(map(str.isalpha, text.as_py()))


def _spans(labels: np.ndarray, languages: tuple[str, ...]) -> list[dict]:
    begin = np.concatenate(([0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]))
    return [{"lang": languages[labels[a]], "first_word": int(a), "n_words": int(b - a)} for a, b in zip(begin[:-1], begin[1:], strict=True) if b > a]
