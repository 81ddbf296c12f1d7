"""Quality rules: measures of each text, and lines that recur across a host's documents.

Everything is DataFrame expressions. Lines are normalised and hashed; a line's
frequency is the number of documents (doc_id) of a host (the column source) that hold
it. Lines above the limits are removed, and documents of which too little is left
are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, null_safe_text, settle, shared_dir, unused, without

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Limits:
    """min_words and repeat_percent make base_failed; the rest concern recurring lines."""

    min_words: int = 10
    repeat_percent: int = 20
    #: A line is removed if it is in so many documents of its host ...
    line_documents: int = 10
    #: ... and in more than this part of them, in per cent.
    line_percent: int = 2
    #: A document is rejected if less than this part of its words is left, in per cent.
    left_percent: int = 30


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(_SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE))


def _let(value: Column, use) -> Column:
    """Evaluate `value` once, and `use` it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words lie in 5-word windows that occur twice or more in `words`."""
    window = lambda w, i: F.xxhash64(*(F.get(w, i + j) for j in range(5)))
    hashes = lambda w: F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 5, F.lit(0))), lambda i: window(w, i))).otherwise(F.array().cast("array<long>"))

    def covered(hs: Column) -> Column:
        def count(at: Column) -> Column:  # at: (hash, position), sorted
            like = lambda x, i: F.coalesce(x["h"] == F.get(at, i)["h"], F.lit(False))
            again = F.sort_array(F.transform(F.filter(at, lambda x, i: like(x, i - 1) | like(x, i + 1)), lambda x: x["p"]))
            return _let(again, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x))

        return _let(F.sort_array(F.transform(hs, lambda h, p: F.struct(h.alias("h"), p.alias("p")))), count)

    return _let(hashes(words), lambda hs: F.when(F.size(hs) == F.size(F.array_distinct(hs)), F.lit(0)).otherwise(covered(hs))).cast("long")


def line_key(line: Column) -> Column:
    """What two lines have in common that count as one: case, digits and spacing are folded."""
    return F.xxhash64(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), WHITE, " "))


def _judged(docs: DataFrame, limits: Limits) -> DataFrame:
    """The rows of quality(), with _s and _t: what tells rows of one doc_id apart."""
    text = null_safe_text().cast("string")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), text.alias("text"), F.xxhash64(text).alias("t"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "")
    measured = rows.select(
        "doc_id",
        "source",
        "t",
        words_of(F.col("text")).alias("words"),
        F.regexp_count("text", F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    measured = measured.select("doc_id", "source", "t", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols", "n_dup_lines", repeated_words(F.col("words")).alias("n_repeat_words"))
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))

    # Every line with its place and words; a line counts once for each document of a host.
    held = rows.select("doc_id", "source", "t", F.posexplode(lines).alias("at", "line")).select("doc_id", "source", "t", "at", line_key(F.col("line")).alias("line"), F.size(words_of(F.col("line"))).cast("long").alias("n"))
    common = held.select("source", "line", "doc_id").distinct().groupBy("source", "line").agg(F.count("*").alias("n_documents")).where(F.col("n_documents") >= limits.line_documents)
    hosts = rows.select("source", "doc_id").distinct().groupBy(F.col("source").alias("host")).agg(F.count("*").alias("n_host"))
    above = common.join(hosts, F.expr("source <=> host")).where(100 * F.col("n_documents") > limits.line_percent * F.col("n_host")).select(F.col("source").alias("s"), F.col("line").alias("l"))
    above = settle(above, shared_dir(docs.sparkSession))  # now its size is known to the planner
    # Rows equal in all three columns meet here, each with all its lines.
    removed = held.join(above, F.expr("source <=> s and line = l")).groupBy("doc_id", "source", "t").agg((F.sum("n") * F.countDistinct("at") / F.count("*")).cast("long").alias("gone"))
    removed = removed.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("t").alias("k"), "gone")
    out = measured.join(removed, F.expr("doc_id <=> d and source <=> s and t = k"), "left").withColumn("removed_words", F.coalesce("gone", F.lit(0)).cast("long"))
    depleted = 100 * (F.col("n_words") - F.col("removed_words")) < limits.left_percent * F.col("n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "removed_words", F.col("source").alias("_s"), F.col("t").alias("_t"))


def quality(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Measures and verdict for every row of docs (doc_id, text, source).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, kept (boolean), removed_words (long: words of removed lines).

    A null text has no words and fails. Null doc_id or source are values like others.
    Rows that share a doc_id count once in the line frequencies of a host; rows equal in
    doc_id, text and source get equal results. Other columns are ignored. An empty table
    gives an empty result.
    """
    return _judged(docs, limits).drop("_s", "_t")


def kept_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that quality() keeps, whole and with all their columns.

    Null doc_id and source are values like others; null texts fail and go. Rows equal in
    doc_id, source and text share a verdict. An empty table gives an empty result.
    """
    i, s, t = (unused(docs, name) for name in ("doc", "host", "hash"))
    rejected = _judged(docs, limits).where("not kept").select(F.col("doc_id").alias(i), F.col("_s").alias(s), F.col("_t").alias(t)).distinct()
    rejected = settle(rejected, shared_dir(docs.sparkSession))
    own = F.xxhash64(null_safe_text().cast("string"))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (own == F.col(t)) & F.col("source").cast("string").eqNullSafe(F.col(s))
    return without(docs, rejected, own, t, same)
