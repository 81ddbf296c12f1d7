"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word n-grams, held as 64-bit hashes. The
hashes have one global order: rare before frequent, then by value. If two sets of
n grams are similar enough, at most n - o grams of either can be missing in the
other (o: the least overlap), so the grams of a prefix hold some that are shared.

* A rare gram is a signature by itself.
* Frequent grams are signatures only in combinations of k, so a prefix is extended
  until it holds n - o + 1 grams beyond the k - 1 of each class that could be
  shared without a combination. To keep the combinations of long prefixes few, a
  class is cut into G subclasses by the hash's low bits. G is a power of two that
  grows with the set; of two similar sets one has at most twice the other's, and
  prefixes are extended for 2 G, so both form every combination of the finer cut.
* Sets too small for that (o below 7) meet through plain prefixes, too.

With a signature goes how many grams of the set come before its last one, not counting
the k - 1 of each class that may be shared without a combination. Two similar sets have
a first shared signature, and what they can share is at most n less that number, in
either set. This bounds the sizes of a member's partners in a bucket.

Documents that share a signature are verified, but not each against each: all members
of a bucket against one of it, its hub, and in further rounds against other hubs of
other components. What this joins to components needs no other pair; at the end
only members of different components in one bucket are paired, in large buckets by signatures
made anew from the counts of all their grams, and by classes of the sizes that these allow. That is exact for the components and linear for a large
group of copies, and documents of one template that differ too much are not paired
at all: what tells them apart is rare and comes first. Pairs are dropped early if their
sizes, or the Hamming distance of 512-bit parity sketches (a lower bound of the
symmetric difference), exclude the threshold.

Which grams are frequent only decides how many candidates arise, never which links
are found, so it may live in a bitmap of fixed size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, discard, in_bitmap, mix, settle, shared_dir, shingle_hashes, short_lived_shuffles, text_slices, unused, without, word_hashes
from .components import connected_components, grown

#: The bitmap of frequent grams has 2**MAP_BITS bits (8 MB), whatever the input.
MAP_BITS = 26
#: A gram is frequent from this many prefixes on, or from so many that fewer than
#: 2**(MAP_BITS - 4) grams can be; very frequent at VERY times as many.
FREQUENT, VERY = 12, 1024
#: A set with at least this overlap always has room for the combinations (1 + 2 * 1 + 2 * 2).
ROOM = 7
#: After the first round, buckets of several components get other hubs: so many different
#: ones over all buckets of a group. Rounds only save pairs; what they leave is compared.
ROUNDS = (4, 16)
#: Most bits of the map of documents that a verification reads (16 MB); beyond some 10**8
#: documents it thins out less, and the join behind it does the rest.
WANTED_BITS = 27
#: Members of a bucket that are paired as they are; larger buckets go by counts of whole sets.
PAIRED = 128
#: Sizes of one class are within this factor of each other.
CLASS = 1.05
#: Sketches of 512 bits tell sets of up to so many grams apart; larger sets have a finer one, too.
COARSE = 256
#: Signatures go through their joins in slices, one after the other, so that only one slice's
#: shuffles are on disk at once: one for so many counted grams, and at most so many, as a power of 2.
SLICE, SLICES = 1 << 24, 16


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    for batch in batches:
        for row, data, offsets in text_slices(batch, "text"):
            words, bounds = word_hashes(data, offsets)
            yield batch, row, [np.unique(shingle_hashes(words[a:b], size)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _least(n: int, threshold: int) -> int:
    """The least overlap of a set of n with any similar one."""
    return -(-threshold * n // 100)


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    bounds = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(_signed(np.concatenate(arrays)) if arrays else np.zeros(0, np.int64)))


def _sketch(s: np.ndarray, width: int = 512) -> np.ndarray:
    bits = np.bincount((s >> np.uint64(11)).astype(np.int64) & (width - 1), minlength=width).astype(np.uint8) & 1
    return np.packbits(bits).view(np.uint64)


def _fine(s: np.ndarray) -> np.ndarray:
    """The parity bits of a large set, two or more for each gram; a power of 2 of them."""
    return _sketch(s, 1 << (2 * len(s) - 1).bit_length()) if len(s) > COARSE else s[:0]


def _ids(batch: pa.RecordBatch, row: int, n: int) -> pa.Array:
    return batch.column(batch.schema.get_field_index("doc_id")).slice(row, n)


def _reach(n, threshold: int):
    """How many of a set's lowest grams are counted: half as many again as a plain prefix has."""
    return 3 * (n - _least(n, threshold) + 1) // 2 + 2


def profiles(docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """doc_id, n, (hi, lo): digest of the set, sketch: its parity bits, fine: more of them if the set is large."""

    def work(batches):
        for batch, row, sets in _sets(batches, size):
            digests = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [_ids(batch, row, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), _lists([_sketch(s) for s in sets]), _lists([_fine(s) for s in sets])],
                names=["doc_id", "n", "hi", "lo", "sketch", "fine"],
            )

    return _plain(docs).mapInArrow(work, "doc_id long, n long, hi long, lo long, sketch array<long>, fine array<long>")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _counted(known: DataFrame, threshold: int, whole: bool = False) -> int:
    """How many grams frequent_maps() counts in sets with the profiles `known`."""
    return int(known.agg(F.sum("n" if whole else F.expr(f"3 * (n - ceil({threshold} * n / 100) + 1) div 2 + 2"))).first()[0] or 0)


def frequent_maps(docs: DataFrame, total: int, size: int, threshold: int, whole: bool = False, thin: Callable = iter) -> list[np.ndarray]:
    """Bitmaps, by a gram's top MAP_BITS bits, of frequent and of very frequent grams.

    Counted are, over all of docs (doc_id, text) that `thin` leaves, the lowest grams of each,
    as few prefixes reach further; or all grams of whole sets. They are about `total`.
    """

    def work(batches):
        for _, _, sets in _sets(thin(batches), size):
            low = sets if whole else [s[: _reach(len(s), threshold)] for s in sets]
            grams, times = np.unique(np.concatenate(low), return_counts=True)  # near copies add up here already
            yield pa.RecordBatch.from_arrays([pa.array(_signed(grams)), pa.array(times)], names=["gram", "times"])

    least = max(FREQUENT, total >> (MAP_BITS - 4))
    counts = docs.mapInArrow(work, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("count")).where(F.col("count") >= least)
    return bitmap(counts.withColumn("slot", F.shiftrightunsigned("gram", 64 - MAP_BITS)), MAP_BITS, F.lit(True), F.col("count") >= VERY * least)


def _in_map(bits: np.ndarray, s: np.ndarray) -> np.ndarray:
    return in_bitmap(bits, s >> np.uint64(64 - MAP_BITS))


def signatures(s: np.ndarray, threshold: int, some: np.ndarray, very: np.ndarray, placed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of one set (sorted uint64 grams), and if placed how many grams count before each one's last."""
    n = len(s)
    if not n:
        return s, np.zeros(0, np.int64)
    least = _least(n, threshold)
    need = n - least + 1
    k = 1 + _in_map(some, s).astype(np.int8)
    k[_in_map(very, s)] = 3
    order = np.argsort(k, kind="stable")  # by class, then by value
    s, k = s[order], k[order]
    small_limit = 100 * max((m for m in range(1, 3 * ROOM) if _least(m, threshold) < ROOM), default=0) // threshold
    out = [(mix(s[:need] ^ np.uint64(0xA5A5)), np.arange(need))] if n <= small_limit else []
    if least >= ROOM:
        if k[need - 1] == 1:
            out.append((mix(s[:need]), np.arange(need)))
        else:
            cut = 1 << (max(1, min(need // 2, (least - 1) // 6)).bit_length() - 1)
            fine = (s & np.uint64(2 * cut - 1)).astype(np.int64) + (k.astype(np.int64) << 40)
            by = np.argsort(fine, kind="stable")
            fresh = np.r_[True, np.diff(fine[by]) != 0]
            rank = np.empty(n, np.int64)
            rank[by] = np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            counted = rank >= k - 1
            p = int(np.flatnonzero(np.cumsum(counted) == need)[0]) + 1
            s, k, before = s[:p], k[:p], np.cumsum(counted)[:p] - counted[:p]
            out.append((mix(s[k == 1]), before[k == 1]))
            for size in (2, 3):
                grams, at = s[k == size], before[k == size]
                group = (grams & np.uint64(cut - 1)).astype(np.int64)
                by = np.argsort(group, kind="stable")
                for own in np.split(by, np.flatnonzero(np.diff(group[by])) + 1):
                    if len(own) >= size:  # in the order of the prefix, so the last gram is the last index
                        a, b = np.triu_indices(len(own), 1)
                        combined, last = mix(mix(grams[own[a]] + np.uint64(size)) + grams[own[b]]), b
                        if size == 3:
                            x, c = np.nonzero(b[:, None] < np.arange(len(own))[None, :])
                            combined, last = mix(combined[x] + grams[own[c]]), c
                        out.append((combined, at[own[last]] if placed else at[:0]))
    if not out:
        return s[:0], np.zeros(0, np.int64)
    if not placed:
        return np.unique(np.concatenate([x for x, _ in out])), s[:0]
    sigs, first = np.unique(np.concatenate([x for x, _ in out]), return_index=True)
    return sigs, np.concatenate([x for _, x in out])[first]


def _similar(threshold: int, size_a: str, size_b: str, both: str) -> str:
    """SQL: `both` shared of two sets reach the threshold."""
    return f"{both} * {100 + threshold} >= {threshold} * ({size_a} + {size_b})"


def _likely(docs: DataFrame, wanted: DataFrame, n: int) -> tuple[DataFrame, Callable]:
    """doc_id, text, slot of docs, and a step that leaves out most that aren't among the n or 2 n of `wanted` (doc_id).

    It goes by a map of bounded size, within the Python worker that reads the texts; an
    exact join has to follow.
    """
    bits = max(16, min(WANTED_BITS, (32 * n + 1).bit_length()))
    slot = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits)
    seen = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(slot.alias("slot")), bits)[0])

    def thin(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(seen.value, batch.column("slot").to_numpy().view(np.uint64)))).drop_columns("slot")

    return _plain(docs).withColumn("slot", slot), thin


def verified(pairs: DataFrame, docs: DataFrame, known: DataFrame, size: int, threshold: int) -> DataFrame:
    """The links among `pairs` (a, b). Sizes and two sketches rule out most; the rest compare whole sets."""
    side = lambda x: known.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    apart = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {threshold} * greatest(n_a, n_b)")
    sized = sized.withColumn("apart", apart).where(_similar(threshold, "n_a", "n_b", "(n_a + n_b - apart) / 2")).select("a", "b", "n_a", "n_b")
    # Of similar sets the finer sketch of the larger has as many bits or twice as many, and is folded then.
    finer = lambda x: known.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("fine").alias(f"f_{x}"))
    width = F.least(F.size("f_a"), F.size("f_b"))
    fold = lambda x: F.when(F.size(x) > width, F.zip_with(F.slice(x, 1, width), F.slice(x, width + 1, width), lambda i, j: i.bitwiseXOR(j))).otherwise(F.col(x))
    apart = F.aggregate(F.zip_with(fold("f_a"), fold("f_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    sized = sized.join(finer("a"), ["a", "n_a"]).join(finer("b"), ["b", "n_b"]).withColumn("apart", apart)
    left = settle(sized.where(_similar(threshold, "n_a", "n_b", "(n_a + n_b - apart) / 2")).select("a", "b", "n_a", "n_b").distinct(), shared_dir(docs.sparkSession))
    wanted = left.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    rows, thin = _likely(docs, wanted, left.count())

    def work(batches):
        for batch, row, sets in _sets(thin(batches), size):
            yield pa.RecordBatch.from_arrays([_ids(batch, row, len(sets)), _lists(sets)], names=["doc_id", "grams"])

    sets = rows.mapInArrow(work, "doc_id long, grams array<long>").join(wanted, "doc_id", "left_semi")
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("grams").alias(f"g_{x}"))
    shared = F.size(F.array_intersect("g_a", "g_b")).cast("long")
    return left.join(side("a"), "a").join(side("b"), "b").withColumn("shared", shared).where(_similar(threshold, "n_a", "n_b", "shared")).select("a", "b", "shared")


def _check(threshold: int) -> None:
    if not 50 <= threshold <= 100:
        raise ValueError("threshold: 50 to 100")


def _signed_rows(some: DataFrame, total: int, docs: DataFrame, size: int, threshold: int, path: str) -> DataFrame:
    """sig, doc_id, before: the signatures of some of docs (doc_id, text), by the counts of all grams of docs, about `total`."""
    maps = docs.sparkSession.sparkContext.broadcast(frequent_maps(docs, total, size, threshold, True))

    def sign(batches):
        for batch, row, sets in _sets(batches, size):
            sigs, before = zip(*(signatures(s, threshold, *maps.value) for s in sets), strict=True)
            yield pa.RecordBatch.from_pydict({"doc_id": _ids(batch, row, len(sets)), "sigs": _lists(list(sigs)), "before": _lists([b.astype(np.int64) for b in before])})

    signed = settle(some.mapInArrow(sign, "doc_id long, sigs array<long>, before array<long>"), path)
    return signed.select(F.explode(F.arrays_zip("sigs", "before")).alias("s"), "doc_id").select(F.col("s.sigs").alias("sig"), "doc_id", F.col("s.before").alias("before"))


def _sliced_rows(docs: DataFrame, thin: Callable, total: int, size: int, threshold: int, path: str) -> list[DataFrame]:
    """Slices of sig, doc_id: the signatures of what `thin` leaves of docs, by the counts of its lowest grams, `total`.

    Each slice has all documents of its signatures, and is a column of the written table.
    """
    maps = docs.sparkSession.sparkContext.broadcast(frequent_maps(docs, total, size, threshold, False, thin))
    slices = min(SLICES, 1 << (total // SLICE).bit_length())
    names = [f"sigs{i}" for i in range(slices)]

    def sign(batches):
        for batch, row, sets in _sets(thin(batches), size):
            sigs = [signatures(s, threshold, *maps.value, False)[0] for s in sets]
            parts = [s & np.uint64(slices - 1) for s in sigs]
            own = {name: _lists([s[p == i] for s, p in zip(sigs, parts, strict=True)]) for i, name in enumerate(names)}
            yield pa.RecordBatch.from_pydict({"doc_id": _ids(batch, row, len(sets))} | own)

    signed = settle(docs.mapInArrow(sign, ", ".join(["doc_id long", *(f"{name} array<long>" for name in names)])), path)
    return [signed.select(F.explode(name).alias("sig"), "doc_id") for name in names]


def jaccard_components(docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """Components of the documents whose word `size`-gram sets have 100 J >= threshold (50 to 100).

    Returns a row per row of docs: doc_id, n_shingles, component_id (the smallest
    doc_id reachable by links, its own included).

    Null or blank texts have empty sets and link with nothing. Rows with the same
    doc_id count as one node that has the links of each; rows without doc_id get a
    null component_id. Other columns are ignored, whatever their names. An empty
    table gives an empty result.
    """
    _check(threshold)
    with short_lived_shuffles(docs.sparkSession):
        return _components(docs, size, threshold)


def _components(docs: DataFrame, size: int, threshold: int) -> DataFrame:
    spark, base = docs.sparkSession, shared_dir(docs.sparkSession)
    known = settle(profiles(docs, size, threshold), f"{base}/profiles")
    # Of equal sets only the first goes on (a hub always is one); the others hang below it, and few of them have signatures.
    same = known.where("n > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = settle(same.select(F.col("first").alias("doc_id")).distinct(), f"{base}/firsts")
    copies = known.select("doc_id", "hi", "lo").join(same.where("first <> last"), ["hi", "lo"]).where("doc_id <> first").select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    own = known.where("n > 0").select("doc_id", "n", "sketch", "fine").join(firsts, "doc_id", "left_semi")
    some, thin = _likely(docs.where("doc_id is not null"), firsts, firsts.count())
    met = []
    for i, rows in enumerate(_sliced_rows(some, thin, _counted(own, threshold), size, threshold, f"{base}/signed")):
        hubs = rows.groupBy("sig").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("top")).where("hub <> top").select("sig", "hub")
        met.append(settle(rows.join(hubs, "sig").join(firsts, "doc_id", "left_semi").select("sig", "doc_id", "hub"), f"{base}/met{i}"))
    discard(spark, f"{base}/signed")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    edges = lambda pairs: verified(pairs, docs, own, size, threshold).select(F.col("a").alias("u"), F.col("b").alias("v"))
    links = edges(_union(met).where("doc_id <> hub").select(*pair("doc_id", "hub")).distinct())
    labels = connected_components(links)
    live = []
    for i, rows in enumerate(met):
        live.append(settle(_divided(rows.select("sig", "doc_id"), labels), f"{base}/divided{i}"))
        discard(spark, f"{base}/met{i}")
    live = _union(live)
    for k, hubs_each in enumerate(ROUNDS):
        if k:
            live = settle(_divided(live, labels), f"{base}/live{k}")
        hub = F.min(F.struct(F.xxhash64("doc_id", F.pmod("sig", F.lit(hubs_each))).alias("x"), F.col("doc_id").alias("hub"), F.col("c").alias("hub_c")))
        chosen = live.groupBy("sig").agg(hub.alias("h")).select("sig", "h.hub", "h.hub_c")
        labels = grown(labels, edges(live.join(chosen, "sig").where("c <> hub_c").select(*pair("doc_id", "hub")).distinct()))
        live = live.select("sig", "doc_id")
    # What is left in buckets of several components: members of one against those of others.
    live = settle(_divided(live, labels), f"{base}/left")
    large = settle(live.groupBy("sig").agg(F.count("*").alias("m")).where(F.col("m") > PAIRED).select("sig"), f"{base}/large")
    labels = grown(labels, edges(_paired(live.join(large, "sig", "left_anti").join(own, "doc_id"), threshold, f"{base}/small")))
    # A similar pair that no small bucket holds has both of its members in large ones. Their
    # grams are counted wholly, and the signatures by these counts find the pair again.
    members = settle(live.join(large, "sig", "left_semi").select("doc_id").distinct(), f"{base}/members")
    if not members.isEmpty():
        some, thin = _likely(docs, members, members.count())
        some = settle(some.mapInArrow(thin, "doc_id long, text string").join(members, "doc_id", "left_semi"), f"{base}/some")
        again = _signed_rows(some, _counted(known.join(members, "doc_id", "left_semi"), threshold, True), some, size, threshold, f"{base}/signed_again")
        labels = grown(labels, edges(_by_size(_divided(again, labels).join(own, "doc_id"), threshold, f"{base}/again")))
    labels = grown(labels, copies)
    labels = labels.select(F.col("node").alias("doc_id"), "component")
    return known.select("doc_id", "n").join(labels, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _classes(low, high):
    """The classes of the sizes from low to high (SQL); none if there is no such size."""
    place = lambda n: f"cast(floor(ln({n}) / ln({CLASS})) as int)"
    return F.expr(f"case when {low} <= {high} then sequence({place(low)}, {place(high)}) else cast(array() as array<int>) end")


def _sketches() -> list:
    return [F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(8)]


def _fitting(threshold: int) -> str:
    """SQL: sizes n and n_ and the distance of sketches s0.. and s0_.. don't exclude the threshold."""
    apart = " + ".join(f"bit_count(s{i} ^ s{i}_)" for i in range(8))
    return f"100 * least(n, n_) >= {threshold} * greatest(n, n_) and {_similar(threshold, 'n', 'n_', f'(n + n_ - ({apart})) / 2')}"


def _paired(live: DataFrame, threshold: int, path: str) -> DataFrame:
    """Pairs (a, b) of members (sig, doc_id, c, n, sketch) of one bucket that may be similar, of different components."""
    live = settle(live.select("sig", "doc_id", "c", "n", *_sketches()), path)
    other = live.select("sig", *(F.col(x).alias(f"{x}_") for x in live.columns if x != "sig"))
    return live.join(other, "sig").where(f"doc_id < doc_id_ and c <> c_ and {_fitting(threshold)}").select(F.col("doc_id").alias("a"), F.col("doc_id_").alias("b")).distinct()


def _by_size(live: DataFrame, threshold: int, path: str) -> DataFrame:
    """As _paired, for buckets of any size, of members that also have `before`.

    n - before of either member bounds what the pair shares; so of both, the larger is
    matched with those classes of sizes that its own bound allows.
    """
    most = F.expr(f"(n - before) * {100 + threshold} div {threshold} - n")  # the largest partner
    live = settle(live.select("sig", "doc_id", "c", "n", most.alias("most"), *_sketches()), path)
    smaller = live.withColumn("class", F.explode(_classes("n", "n")))
    larger = live.withColumn("class", F.explode(_classes(f"cast(ceil({threshold} * n / 100) as long)", "least(n, most)")))
    larger = larger.select("sig", "class", *(F.col(x).alias(f"{x}_") for x in live.columns if x != "sig"))
    fits = f"(n < n_ or n = n_ and doc_id < doc_id_) and c <> c_ and n_ <= most and n <= most_ and {_fitting(threshold)}"
    return smaller.join(larger, ["sig", "class"]).where(fits).select(F.least("doc_id", "doc_id_").alias("a"), F.greatest("doc_id", "doc_id_").alias("b")).distinct()


def similar_pairs(docs: DataFrame, size: int = 5, threshold: int = 80) -> tuple[DataFrame, DataFrame]:
    """The join itself: all links between different sets, and which documents have which set.

    Returns (a, b, n_a, n_b, shared), a row per pair of different sets with 100 J >= threshold,
    each named by its smallest doc_id (a < b), and members (doc_id, first), a row per row
    of docs that has words and an id. Documents of one set link with each other, and with
    all members of a linked set. Every link is a row here, so the result of a group of m
    near copies that are all similar has m * m / 2 rows; jaccard_components does without.

    Rows that repeat a doc_id count by their first set in order of its digest. Null or
    blank texts link with nothing. Other columns are ignored. Empty tables give empty results.
    """
    _check(threshold)
    spark, base = docs.sparkSession, shared_dir(docs.sparkSession)
    docs = docs.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"])
    docs = settle(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), f"{base}/docs")
    known = settle(profiles(docs, size, threshold), f"{base}/profiles").where("n > 0")
    same = known.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"))
    members = settle(known.join(same, ["hi", "lo"]).select("doc_id", "first"), f"{base}/members")
    firsts = members.select(F.col("first").alias("doc_id")).distinct()
    rows = _signed_rows(docs.join(firsts, "doc_id", "left_semi"), _counted(known, threshold, True), docs, size, threshold, f"{base}/signed")
    own = known.select("doc_id", "n", "sketch", "fine").join(firsts, "doc_id", "left_semi")
    pairs = _by_size(rows.withColumn("c", F.col("doc_id")).join(own, "doc_id"), threshold, f"{base}/live")
    links = verified(pairs, docs, own, size, threshold)
    side = lambda x: own.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"))
    return links.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "shared"), members


def _divided(met: DataFrame, labels: DataFrame) -> DataFrame:
    """Of bucket members (sig, doc_id, ...) those in buckets of several components, with theirs: c."""
    placed = met.join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select(*met.columns, F.coalesce("component", "doc_id").alias("c"))
    several = placed.groupBy("sig").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("sig")
    return placed.join(several, "sig", "left_semi")


def one_of_each(docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of docs without near duplicates: of each component the document with the smallest id.

    All columns stay. Rows without words or without id link with nothing and stay; of
    rows that repeat an id, one stays.
    """
    found = jaccard_components(docs, size, threshold).where("doc_id is not null and n_shingles > 0")
    gone = found.groupBy("doc_id").agg(F.min("component_id").alias("component"), F.count("*").alias("rows")).where("component <> doc_id or rows > 1")
    i = unused(docs, "doc")
    gone = settle(gone.select(F.col("doc_id").alias(i), F.expr("component = doc_id").alias("first")), shared_dir(docs.sparkSession))
    plain = without(docs, gone.select(i), F.col("doc_id").cast("long"), i, F.col("doc_id").cast("long") == F.col(i))
    first = gone.where("first").select(i)
    if first.isEmpty():  # no id is repeated
        return plain
    return plain.unionByName(docs.join(first, F.col("doc_id").cast("long") == F.col(i), "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns))
