"""Benchmark decontamination by template canonicalisation.

Texts become sequences of tokens in which numbers, names and units are typed
placeholders (runs of one type are one token) and other words have no case (ASCII and
Latin-1), so a question and its variant with other parameters share templates. Windows
of tokens are hashed and joined with the windows of the benchmark's items. Where windows
of an item and a document agree along one alignment, their slots are compared: each
value of the item stands for one value of the document and the other way round, by
majority, and windows with other values don't count. A document is contaminated by an
item if the windows that count cover enough of it.

Windows that are mostly placeholders say little, so they are not looked up. An item
that has many of those is also looked up by windows of its words as they are, so that
it is found verbatim, however dense in numbers and names it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, hash_of, in_bitmap, mix, placed_words, settle, shared_dir, text_slices, unspaced, unused, without, words_by_letters

#: Units that make a placeholder after a number.
UNITS = "mm cm m km in ft mi mg g kg lb oz t ml l s sec seconds min minutes h hours days weeks months years percent usd eur dollars euros cents meters metres kilometers kilograms grams liters litres miles degrees watts volts".split()
NUMBER, NAME, UNIT = (np.uint64(x) for x in (11, 12, 13))
#: Bits of the map of item windows that is sent to tasks (512 KB, whatever the benchmark).
MAP_BITS = 22
#: Windows, with how many the text has in all of that size.
WINDOWS = "id long, text_hash long, hash long, at int, slots array<long>, size int, total int"


@dataclass(frozen=True)
class Match:
    """window: tokens of a window; literal: of these not placeholders, at least;
    share: part of an item's windows that must be found, in per cent; dense: an item of
    which fewer windows have enough literals, in per cent, is looked up by words, too."""

    window: int = 8
    literal: int = 5
    share: int = 30
    dense: int = 90


def canonical(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per row: the template's tokens, for each placeholder its value (0 for literals), and the words as they are."""
    between = words_by_letters()
    folded = data.copy()  # placed_words folds A-Z; in UTF-8 this folds the capitals of Latin-1
    accented = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    folded[1:][accented] += 0x20
    words, bounds, starts, stops = placed_words(folded, offsets, between, unspaced(data))
    if not len(words):
        for _ in range(len(offsets) - 1):
            yield words, words, words
        return
    first = data[starts]
    number = (first >= 48) & (first <= 57)
    # A capital and no other after it, not at the beginning of a sentence.
    ends = np.zeros(len(data) + 1, np.int64)
    np.cumsum(np.isin(data, np.frombuffer(b".!?\n", np.uint8)), out=ends[1:])
    fresh = np.ones(len(words), bool)
    fresh[1:] = ends[starts[1:]] > ends[stops[:-1]]
    rows = bounds[:-1][bounds[:-1] < len(words)]
    fresh[rows] = True
    upper = lambda at: ((data[at] >= 65) & (data[at] <= 90)) | ((data[at] == 0xC3) & (data[np.minimum(at + 1, len(data) - 1)] >= 0x80) & (data[np.minimum(at + 1, len(data) - 1)] <= 0x9E))
    after = np.minimum(starts + 1 + (first >= 0xC0), len(data) - 1)
    name = upper(starts) & ~upper(after) & ~fresh & (stops - starts > 1)
    unit = np.isin(words, np.array([hash_of(u) for u in UNITS], np.uint64))
    unit[1:] &= number[:-1]
    unit[0] = False
    unit[rows] = False
    kind = np.select([number, name, unit], [NUMBER, NAME, UNIT], np.uint64(0))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if a == b:
            yield words[:0], words[:0], words[:0]
            continue
        k, w = kind[a:b], words[a:b]
        heads = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (k[1:] == 0)])
        values = np.add.reduceat(mix(w + np.arange(len(w), dtype=np.uint64) - np.repeat(heads, np.diff(np.r_[heads, len(w)])).astype(np.uint64)), heads)
        k = k[heads]
        yield np.where(k == 0, w[heads], k), np.where(k == 0, np.uint64(0), values), w


def windows(tokens: np.ndarray, sizes: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of `sizes` the hashes of all windows of so many tokens, by position."""
    out = np.zeros(len(tokens), np.uint64)
    for j in range(max(sizes, default=0)):
        if len(tokens) <= j:
            return
        out = mix(out[: len(tokens) - j] * np.uint64(0x9E3779B97F4A7C15) + tokens[j:])
        if j + 1 in sizes:
            yield j + 1, mix(out + np.uint64(j + 1))


def rich(values: np.ndarray, size: int, literal: int) -> np.ndarray:
    """Positions of the windows of `size` tokens with enough literals."""
    plain = np.cumsum(np.r_[0, values == 0])
    return np.flatnonzero(plain[size:] - plain[:-size] >= literal)


def _rows(found: list[tuple]) -> pa.RecordBatch:
    """found: (id, text hash, hashes, positions, slots of each, size, total)."""
    n = [len(f[2]) for f in found]
    lists = [x for f in found for x in f[4]]
    flat = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
    bounds = np.cumsum(np.r_[0, [len(x) for x in lists]]).astype(np.int32)
    cat = lambda k, t: np.concatenate([f[k] for f in found]).astype(t) if found else np.zeros(0, t)
    each = lambda k, t: pa.array([f[k] for f in found], t).take(pa.array(np.repeat(np.arange(len(found)), n)))
    columns = [each(0, pa.int64()), each(1, pa.int64()), pa.array(cat(2, np.uint64).view(np.int64)), pa.array(cat(3, np.int32)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.view(np.int64))), each(5, pa.int32()), each(6, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in WINDOWS.split(", ")])


def item_sizes(values: np.ndarray, words: np.ndarray, how: Match) -> list[int]:
    """What an item is looked up by: windows of its template (their size), and of its words as they are (negative)."""
    size, n = min(how.window, len(values)), len(values) - min(how.window, len(values)) + 1
    some = len(rich(values, size, how.literal)) if size else 0
    return [size] * (some > 0) + [-min(how.window, len(words))] * (len(words) > 0 and 100 * some < how.dense * n)


def _windows(table: DataFrame, key: str, how: Match, sizes: list[int] | None = None, known=None) -> DataFrame:
    """WINDOWS of whole texts: of `sizes` and in the map of `known`, or else those that items have."""

    def of(tokens: np.ndarray, values: np.ndarray, words: np.ndarray) -> Iterator[tuple]:
        own = item_sizes(values, words, how) if sizes is None else sizes
        for part, sign in ((tokens, 1), (words, -1)):
            for size, hashes in windows(part, {s * sign for s in own if s * sign > 0}):
                at = rich(values, size, how.literal) if sign > 0 else np.arange(len(hashes))
                total, hashes = len(hashes), hashes[at]
                if known is not None:
                    keep = in_bitmap(known.value, hashes >> np.uint64(64 - MAP_BITS))
                    hashes, at = hashes[keep], at[keep]
                if len(hashes):
                    yield hashes, at, [values[p : p + size] if sign > 0 else values[:0] for p in at], sign * size, total

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_slices(batch, "text"):
                ids, texts = (batch.column(k).slice(row, len(offsets) - 1).to_pylist() for k in (0, 2))
                yield _rows([(i, t, *found) for i, t, parts in zip(ids, texts, canonical(data, offsets), strict=True) for found in of(*parts)])

    text = F.col("text").cast("string")
    return table.select(F.col(key).cast("long"), text.alias("text"), F.xxhash64(text).alias("text_hash")).where("text is not null").mapInArrow(work, WINDOWS)


def _agreeing(met: DataFrame, line: list[str]) -> DataFrame:
    """Of matching windows those whose slots agree with the alignment's majority: (*line, item_at, at, same).

    Of an item's value the commonest value against it counts, and of a document's value
    the commonest that it counts for; ties go to the least hash. same: all slots have
    the item's own values.
    """
    zipped = F.filter(F.arrays_zip("slots", "item_slots"), lambda s: s["item_slots"] != 0)
    met = met.select(*line, "item_at", "at", zipped.alias("zipped"))
    plain = met.where(F.size("zipped") == 0).select(*line, "item_at", "at", F.lit(True).alias("same"))
    slots = met.where(F.size("zipped") > 0).select(*line, "item_at", "at", F.explode("zipped").alias("s")).select(*line, "item_at", "at", F.col("s.slots").alias("own"), F.col("s.item_slots").alias("its"))
    counts = slots.groupBy(*line, "its", "own").agg(F.count("*").alias("n"))
    best = lambda by, other: F.row_number().over(Window.partitionBy(*line, by).orderBy(F.desc("n"), other))
    counts = counts.withColumn("place", best("its", "own")).where("place = 1").withColumn("place", best("own", "its")).where("place = 1")
    chosen = counts.select(*line, "its", "own", F.lit(True).alias("agrees"))
    judged = slots.join(chosen, [*line, "its", "own"], "left")
    windows_ = judged.groupBy(*line, "item_at", "at").agg(F.bool_and(F.coalesce("agrees", F.lit(False))).alias("agrees"), F.bool_and(F.expr("own = its")).alias("same"))
    return plain.unionByName(windows_.where("agrees").drop("agrees"))


def contaminated(docs: DataFrame, benchmark: DataFrame, how: Match = Match()) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains, or a variant of which it contains.

    docs (doc_id, text) and benchmark (item_id, text) give doc_id, text_hash (xxhash64 of
    the text), item_id, n_windows (of the item), n_found (of these in the document, along
    alignments and with slots that agree), exact (all slots have the item's own values),
    at (the first matching token).

    An item of fewer tokens than a window is a window by itself. Windows with fewer
    literals than how.literal count as not found; items with many of those are looked up
    by windows of their words as they are, too, and the better of both figures is
    given (then `at` counts words). Items without words or id are never found. Null texts
    hold nothing. Rows are told apart by doc_id (null is a value like others) and text;
    equal rows count as one. Other columns are ignored. Empty tables give an empty
    result.
    """
    spark, base = docs.sparkSession, shared_dir(docs.sparkSession)
    items = settle(_windows(benchmark.where("item_id is not null"), "item_id", how), f"{base}/items")
    # Rows that repeat an item_id with other texts are items of their own.
    items = items.select(F.col("id").alias("item_id"), F.col("text_hash").alias("item_hash"), "hash", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), "size", F.col("total").alias("n_windows")).distinct()
    sizes = [r["size"] for r in items.select("size").distinct().collect()]  # at most 2 * window
    known = spark.sparkContext.broadcast(bitmap(items.select(F.shiftrightunsigned("hash", 64 - MAP_BITS).alias("slot")), MAP_BITS)[0])
    found = _windows(docs, "doc_id", how, sizes, known).withColumnRenamed("id", "doc_id").drop("total")
    met = settle(found.join(items, ["hash", "size"]).withColumn("doc", F.coalesce("doc_id", F.lit(0))).withColumn("no_id", F.col("doc_id").isNull()), f"{base}/met")
    met = met.withColumn("shift", F.col("at") - F.col("item_at"))
    pair = ["doc", "no_id", "text_hash", "item_id", "item_hash", "size", "n_windows"]
    lines = _agreeing(met, [*pair, "shift"])
    pairs = lines.groupBy(*pair).agg(F.countDistinct("item_at").alias("n_found"), F.bool_and("same").alias("exact"), F.min("at").cast("long").alias("at"))
    pairs = pairs.where(100 * F.col("n_found") >= how.share * F.col("n_windows"))
    best = F.max(F.struct((F.col("n_found") / F.col("n_windows")).alias("part"), "size", F.col("n_windows").cast("long").alias("n_windows"), "n_found", "exact", F.col("at").alias("at"))).alias("b")
    pairs = pairs.groupBy("doc", "no_id", "text_hash", "item_id").agg(best)
    return pairs.select(F.when(~F.col("no_id"), F.col("doc")).alias("doc_id"), "text_hash", "item_id", "b.n_windows", "b.n_found", "b.exact", "b.at")


def clean_documents(docs: DataFrame, benchmark: DataFrame, how: Match = Match()) -> DataFrame:
    """The rows of docs, with all their columns, that contain no item of the benchmark.

    Rows are told apart by doc_id (null is a value like others) and text, so of rows that
    repeat an id only those go whose text contains an item. Null texts stay.
    """
    i, t = unused(docs, "doc"), unused(docs, "hash")
    found = settle(contaminated(docs, benchmark, how).select(F.col("doc_id").alias(i), F.col("text_hash").alias(t)).distinct(), shared_dir(docs.sparkSession))
    own = F.xxhash64(F.col("text").cast("string"))
    return without(docs, found, own, t, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (own == F.col(t)))
