"""Substring deduplication with sliding spans of sentences.

Sentences end at . ! ? (or another script's mark) or a line's end. They are cut further
where a word's hash is the least of `window` words in a row, so cuts depend on words
and not on places, and each window inside a sentence has one. From every sentence a
span runs over as many consecutive sentences as make `sentences` and `words` at least.
Two texts that share words + 3 * window - 2 words in a row (51) share a span, wherever
these words start in either. Spans are hashed and joined over the whole corpus; of equal spans the
first in order of doc_id and place stays, and every sentence under any other one is
removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import likely_in, mix, placed_words, plain_marks, settle, shared_dir, text_slices, unspaced, words_by_letters

SPANS = "doc_id long, text_hash long, hash long, first int, last int"


@dataclass(frozen=True)
class Spans:
    sentences: int = 2
    words: int = 20
    window: int = 11


def least_of(words: np.ndarray, heads: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash (the last of equal ones) of every `window` words in a row between two heads."""
    if len(words) < window:
        return np.zeros(0, np.int64)
    inside = np.repeat(np.append(heads[1:], len(words)), np.diff(np.append(heads, len(words))))  # where a word's sentence ends
    at = np.flatnonzero(np.arange(len(words)) + window <= inside)
    key = words & np.uint64(~63 & (1 << 64) - 1)
    least = np.full(len(at), (1 << 64) - 1, np.uint64)
    for j in range(window):
        np.minimum(least, key[at + j] | np.uint64(window - 1 - j), out=least)
    return at + (window - 1) - (least & np.uint64(63)).astype(np.int64)


def sentences(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Of a run of texts: word hashes, their bounds by row, first bytes and ends, and for each word whether a sentence begins there."""
    data = plain_marks(data)
    words, bounds, starts, stops = placed_words(data, offsets, words_by_letters(), unspaced(data))
    fresh = np.ones(len(words), bool)
    if len(words):
        ends = np.zeros(len(data) + 1, np.int64)
        np.cumsum(np.isin(data, np.frombuffer(b".!?\n", np.uint8)), out=ends[1:])
        fresh[1:] = ends[starts[1:]] > ends[stops[:-1]]
        fresh[bounds[:-1][bounds[:-1] < len(words)]] = True
        fresh[least_of(words, np.flatnonzero(fresh), window)] = True
    return words, bounds, starts, stops, fresh


def spans(words: np.ndarray, heads: np.ndarray, how: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first sentence, last) of each span of one text; heads: where its sentences begin."""
    n = len(heads)
    ends = np.append(heads[1:], len(words))
    last = np.maximum(np.searchsorted(ends, heads + how.words), np.arange(n) + how.sentences - 1)
    first = np.flatnonzero(last < n)
    last = last[first]
    # A span's hash from prefix sums over its words, each times a power of an odd base.
    up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(words), 0x9E3779B97F4A7C15 | 5, np.uint64)])
    down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(words), pow(0x9E3779B97F4A7C15 | 5, -1, 1 << 64), np.uint64)])
    sums = np.r_[np.uint64(0), np.cumsum(words * up[:-1])]
    a, b = heads[first], ends[last]
    return mix(mix((sums[b] - sums[a]) * down[a]) + (b - a).astype(np.uint64)), first, last


def sentence_spans(docs: DataFrame, how: Spans) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_slices(batch, "text"):
                words, bounds, _, _, fresh = sentences(data, offsets, how.window)
                found = [spans(words[a:b], np.flatnonzero(fresh[a:b]), how) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                rows = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                own = [batch.column(k).slice(row, len(found)).take(pa.array(rows)) for k in (0, 2)]
                h, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([*own, pa.array(h.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["doc_id", "text_hash", "hash", "first", "last"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    return rows.mapInArrow(work, SPANS)


def repeated_spans(docs: DataFrame, how: Spans = Spans()) -> DataFrame:
    """Every span that isn't the first of its kind: SPANS, first_doc_id.

    The first is that of the least doc_id (null before others), text hash and place. Null
    texts have no spans; rows equal in doc_id and text have the same spans, so none of them
    repeats the other. Other columns are ignored; an empty table gives an empty result.
    """
    found = sentence_spans(docs, how)
    place = F.struct("doc_id", "text_hash", "first")
    # The least place is a partial aggregate, so a span of very many documents is one row a task.
    # Of copies of a row all count here, but none has another place than the least.
    known = found.groupBy("hash").agg(F.min(place).alias("place"), F.count("*").alias("rows")).where("rows > 1").select("hash", "place")
    # As a written table it is shuffled for the join like the spans, and a hot span is split.
    known = settle(known, shared_dir(docs.sparkSession))
    return found.join(known, "hash").where(place != F.col("place")).select("doc_id", "text_hash", "hash", "first", "last", F.col("place.doc_id").alias("first_doc_id"))


def remove_repeats(docs: DataFrame, how: Spans = Spans()) -> DataFrame:
    """The documents of docs (doc_id, text) that lose sentences, with what is left of them.

    Returns doc_id, first_doc_id (the least document that a removed span repeats, the
    document itself if it repeats its own), n_sentences, n_removed, removed_words
    (long), text.

    Words are compared without case (A-Z) and punctuation (ASCII and other scripts'
    sentence marks); each Han or kana character is a word. What is removed runs from a
    sentence's first word to the next one's, so punctuation goes with the sentence
    before it. Null texts have no sentences. Rows equal in doc_id and text count
    as one document, and each has its row; doc_id null comes before others. Other columns are ignored. An empty
    table gives an empty result.
    """
    base = shared_dir(docs.sparkSession)
    over = F.array_distinct(F.flatten(F.collect_list(F.sequence("first", "last"))))
    ranges = repeated_spans(docs, how).groupBy("doc_id", "text_hash").agg(F.min("first_doc_id").alias("first_doc_id"), F.sort_array(over).alias("gone"))
    ranges = settle(ranges, f"{base}/ranges")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")).where("text is not null")
    rows = rows.where(likely_in(ranges, "text_hash")(F.col("text_hash")))  # few other texts go through the join
    hit = rows.join(ranges.withColumnRenamed("doc_id", "id").withColumnRenamed("text_hash", "h"), F.expr("doc_id <=> id and text_hash = h")).select("doc_id", "first_doc_id", "text", "gone")

    @F.pandas_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("words", T.LongType()), T.StructField("text", T.StringType())]))
    def cleaned(texts, gone):
        import pandas as pd

        out = []
        for body, own in zip(texts, gone, strict=True):
            raw = body.encode()
            words, _, starts, _, fresh = sentences(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), how.window)
            heads = np.flatnonzero(fresh)
            edges = np.append(starts[heads], len(raw))
            keep = np.ones(len(heads), bool)
            keep[own] = False
            lengths = np.diff(np.append(heads, len(words)))
            left = raw[: edges[0]] + b"".join(raw[edges[k] : edges[k + 1]] for k in np.flatnonzero(keep))
            out.append((len(heads), int(lengths[~keep].sum()), left.decode()))
        return pd.DataFrame(out, columns=["n", "words", "text"])

    return hit.withColumn("c", cleaned("text", "gone")).select("doc_id", "first_doc_id", F.col("c.n").alias("n_sentences"), F.size("gone").cast("long").alias("n_removed"), F.col("c.words").alias("removed_words"), F.col("c.text").alias("text"))
