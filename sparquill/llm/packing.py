"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document is cut at every full window; those pieces fill windows by themselves.
What remains of it is cut into pieces of at most `piece` tokens. Batches of such
pieces are dealt to m windows, m being the least that could hold them: every piece
begins as a partial partition of one filled and m - 1 empty windows, and the two with
the largest imbalance merge, the fullest window of one with the emptiest of the
other, until one is left. If its largest window exceeds the capacity, m rises by one.

Batches are cut within a partition of the input, so nothing is shuffled, and a lost
task packs its rows again to the same result.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: At most so many words are remembered with their ids.
WORDS = 200_000
_RUN = re.compile(r"\s\s|\s$")
_encoders: dict[tuple, object] = {}


def control_strings(tokenizer_path: str) -> dict[str, int]:
    """The added tokens of a `tokenizers` file: strings that are one id wherever a text holds them."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def encoder(path: str, control: Mapping[str, int] | None = None):
    """A function from a text to its ids, for a file of byte-level BPE ranks.

    A text is cut at the strings of `control`, which have ids of their own; without them
    they are ordinary text. Where single spaces separate words, the ids of a part are
    those of its words, each with the space before it: they are remembered, and other
    parts are encoded whole.
    """
    own = dict(control or {})
    key = (path, *sorted(own.items()))
    if key not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        whole = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        known: dict[str, list[int]] = {}

        def plain(text: str) -> list[int]:
            if _RUN.search(text):
                return whole(text)
            if len(known) > WORDS:
                known.clear()
            first, *words = text.split(" ")
            ids = whole(first)
            for w in words:
                own = known.get(w)
                if own is None:
                    own = whole(" " + w)
                    if len(w) <= 40:
                        known[w] = own
                ids += own
            return ids

        if not own:
            _encoders[key] = plain
            return plain
        cuts = re.compile("(" + "|".join(re.escape(c) for c in sorted(own, key=len, reverse=True)) + ")")

        def encode(text: str) -> list[int]:
            if not any(c in text for c in own):
                return plain(text)
            return [i for k, part in enumerate(cuts.split(text)) for i in ([own[part]] if k % 2 else plain(part))]

        _encoders[key] = encode
    return _encoders[key]


def differencing(sizes: list[int], m: int) -> list[list[int]]:
    """Deal items of the given sizes to m sets of nearly equal sums; the sets' items."""
    heap = [(-s, k, [s] + [0] * (m - 1), [[k]] + [[] for _ in range(m - 1)]) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    for k in range(len(sizes), 2 * len(sizes) - 1):
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        both = sorted(((p + q, u + v) for p, q, u, v in zip(a, reversed(b), x, reversed(y), strict=True)), key=lambda w: -w[0])
        least = both[-1][0]  # only differences matter
        heapq.heappush(heap, (least - both[0][0], k, [s - least for s, _ in both], [w for _, w in both]))
    return heap[0][3]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows that differencing finds, none above the capacity."""
    m = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = differencing(sizes, m)
        if max(sum(sizes[k] for k in w) for w in dealt) <= capacity:
            return [w for w in dealt if w]
        m += 1


def pack(docs: DataFrame, ranks_path: str, capacity: int = 2048, piece: int = 512, batch: int = 256, end_id: int = 1, control: Mapping[str, int] | None = None) -> DataFrame:
    """Pieces of the token sequences of docs (doc_id, text), and where each is packed.

    Returns per piece: doc_id, start, length, ids_crc32 (of little-endian unsigned
    32-bit ids), doc_tokens (with end_id), sequence_id, offset. Every id of a document
    lies in one piece; the pieces of a sequence have no gaps from offset 0. Sequences
    hold at most `capacity` tokens and are to be padded to that, except where their
    length is a power of two. Strings in `control` are encoded as the ids given there.

    A null text is empty, and is end_id alone. Null or repeated doc_ids are packed
    like others, a row at a time. Other columns are ignored. An empty table gives an
    empty result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequence = encoder(ranks_path, control), TaskContext.get().partitionId() << 40
        rest: list[tuple] = []
        out: list[tuple] = []

        def deal(items: list[tuple]) -> None:
            nonlocal sequence
            for w in windows([x[2] for x in items], capacity):
                offset = 0
                for k in sorted(w):
                    out.append((*items[k], sequence, offset))
                    offset += items[k][2]
                sequence += 1

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=SCHEMA.replace(" long", "").split(", "))

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                at, n = 0, len(ids)
                while at < n:
                    if n - at >= capacity:
                        size = capacity
                    else:  # as many pieces as needed, of equal sizes
                        size = -(-(n - at) // -(-(n - at) // piece))
                    item = (doc_id, at, size, zlib.crc32(ids[at : at + size].tobytes()), n)
                    if size == capacity:
                        out.append((*item, sequence, 0))
                        sequence += 1
                    else:
                        rest.append(item)
                    at += size
                while len(rest) >= batch:
                    deal(rest[:batch])
                    del rest[:batch]
                if len(out) >= 20_000:
                    yield rows()
        if rest:
            deal(rest)
        yield rows()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, SCHEMA)
