"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import contextlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words everywhere in this package: the pattern and the bytes.
WHITE = r"[\x20\x09-\x0D]+"
WHITE_BYTES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, with its rows dealt out to all cores if its files have fewer splits than there are cores."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only in local mode the setting may be absent: then a temporary folder of this machine
    serves. Folders are removed when the process ends, or by release().
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _local_base()
    if not _made:
        atexit.register(release, spark)
    _made.append(f"{base.rstrip('/')}/{uuid.uuid4().hex}")
    return _made[-1]


@cache
def _local_base() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def mark() -> int:
    """What release() takes to leave the folders made so far."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: str = "") -> None:
    """Remove the folders made after `since`, but not one below which `keep` lies. No plan may still read them."""
    gone = [f for f in _made[since:] if not keep.startswith(f)]
    with contextlib.suppress(Exception):  # at the end of the process the JVM may be gone
        for folder in gone:
            discard(spark, folder)
    _made[since:] = [f for f in _made[since:] if f not in gone]


def settle(df: DataFrame, path: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends here."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go when the query ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that no plan still reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def null_safe_text(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column), F.lit(""))


def text_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows of about `most` bytes.

    Yields (first row, bytes of the run, offsets of its rows in those bytes); null
    counts as empty. Whole texts stay together, so a longer text is a run by itself.
    """
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64, over uint64 arrays."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE_BYTES)] = True
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[ord("A") : ord("Z") + 1] += np.uint64(32)  # A-Z read as a-z
_BYTE = mix((_FOLD + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) <= n:
        for name, x in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 16) + 1, x, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a run of texts, A-Z lowered, in order.

    Returns (hashes, bounds): the words of row i are hashes[bounds[i]:bounds[i + 1]].
    """
    return placed_words(data, offsets, _IS_WHITE)[:2]


def placed_words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray, begins: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """As word_hashes, for words that bytes marked in `between` separate; also first bytes and ends.

    Words begin at the places `begins`, too, with nothing between them and what is before. A word's hash is a polynomial over its bytes, taken from prefix sums.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    white = between[data]
    first = np.empty(len(data), bool)
    first[0], first[1:] = True, white[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True  # a row's first byte
    if begins is not None:
        first[begins] = True
    starts = np.flatnonzero(first & ~white)
    last = np.empty(len(data), bool)
    last[-1], last[:-1] = True, white[1:]
    ends = offsets[1:]
    last[ends[ends > 0] - 1] = True
    if begins is not None:
        last[begins[begins > 0] - 1] = True
    stops = np.flatnonzero(last & ~white) + 1
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    words = (sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64)
    return mix(words), np.searchsorted(starts, offsets), starts, stops


def words_by_letters() -> np.ndarray:
    """What separates words where punctuation doesn't count: all ASCII but letters and digits."""
    between = np.zeros(256, bool)
    between[[b for b in range(128) if not chr(b).isalnum()]] = True
    return between


#: Sentence marks and white space beyond ASCII.
_MARKS = "。！？｡．…‼⁇⁈⁉؟۔।॥።፧။៕։܀"
_SPACES = "\u00a0\u0085\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_PLAIN = {c.encode(): ord(x) for own, x in ((_MARKS, "."), (_SPACES, " "), ("\u2028\u2029", "\n")) for c in own}
_LEADS = np.zeros(256, bool)
_LEADS[[c[0] for c in _PLAIN]] = True


def plain_marks(data: np.ndarray) -> np.ndarray:
    """UTF-8 in which the bytes of sentence marks, spaces and line ends beyond ASCII are . or space or \\n; of the same length."""
    at = np.flatnonzero(_LEADS[data])
    if not len(at):
        return data
    padded = np.append(data, np.zeros(2, np.uint8)).astype(np.uint32)
    two = padded[at] << 8 | padded[at + 1]
    three = two << 8 | padded[at + 2]
    out = data.copy()
    for c, plain in _PLAIN.items():
        for k in range(len(c)):
            out[at[(two if len(c) == 2 else three) == int.from_bytes(c)] + k] = plain
    return out


def unspaced(data: np.ndarray) -> np.ndarray:
    """Where a Han or kana character begins in UTF-8, or the character after one: these scripts have no spaces."""
    at = np.flatnonzero((data >= 0xE3) & (data <= 0xF0))
    if not len(at):
        return at
    padded = np.append(data, np.zeros(1, np.uint8))
    lead, second = data[at], padded[at + 1]
    han = (lead >= 0xE4) & (lead <= 0xE9) | (lead == 0xE3) & (second >= 0x81) & (second != 0x84) & (second != 0x85) & (second != 0x86)
    han |= (lead == 0xEF) & (second >= 0xA4) & (second <= 0xAB) | (lead == 0xF0) & (second >= 0xA0) & (second <= 0xB3)
    both = np.concatenate([at[han], at[han] + np.where(lead[han] == 0xF0, 4, 3)])
    return both[both < len(data)]


def hash_of(word: str) -> int:
    """The hash that word_hashes gives a word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(data, np.array([0, len(data)]))[0][0])


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of `size` words; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    n = min(size, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - n + 1 + j])
    return mix(out + np.uint64(n))


def bitmap(slots: DataFrame, bits: int, *marks: F.Column) -> list[np.ndarray]:
    """Bitmaps of 2**bits bits over `slots` (slot: long below 2**bits), one per mark (boolean).

    Spark sets the bits; only the maps, whose size is fixed, come to the driver.
    """
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(*(F.bit_or(F.when(m, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{i}") for i, m in enumerate(marks or (F.lit(True),)))).toPandas()
    maps = []
    for name in words.columns[1:]:
        out = np.zeros(1 << (bits - 6), np.uint64)
        out[words["word"].to_numpy(np.int64)] = words[name].to_numpy(np.int64).view(np.uint64)
        maps.append(out)
    return maps


def in_bitmap(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which slots (uint64) are set."""
    return (bits[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1) > 0


#: Bits of the map that likely_in puts into a plan (32 KB, whatever the input).
LIKELY_BITS = 18


def likely_in(values: DataFrame, column: str) -> Callable[[F.Column], F.Column]:
    """A test for a value that all of `values` (column) pass, and few others.

    It is a bitmap, made by Spark and put into the plan as a literal of fixed size; an
    exact join behind it gets fewer rows. DataFrame expressions only.
    """
    slot = lambda v: F.pmod(F.xxhash64(v), F.lit(1 << LIKELY_BITS))
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    rows = values.select(slot(F.col(column)).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    words = [0] * (1 << (LIKELY_BITS - 6))
    for r in rows:
        words[r["word"]] = r["bits"]
    bits = F.from_json(F.lit(json.dumps(words)), "array<bigint>")
    shifted = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(63).cast("int"))
    hit = lambda k: F.get(bits, F.shiftright(k, 6).cast("int")).bitwiseAND(shifted(k)) != 0
    return lambda v: F.get(F.transform(F.array(slot(v)), lambda k: hit(k)), F.lit(0))


def without(docs: DataFrame, gone: DataFrame, value: F.Column, column: str, same: F.Column) -> DataFrame:
    """The rows of docs that have no partner in `gone` (a written table) under the condition `same`.

    `value` of docs and `column` of gone are equal where `same` holds; only rows whose
    value is likely in gone go through the join, with their texts.
    """
    maybe = likely_in(gone, column)(value)
    return docs.where(~maybe).unionByName(docs.where(maybe).join(gone, same, "left_anti").select(*docs.columns))
