"""Best-fit packing into sequences of a fixed capacity, bulk-synchronously (operator 10).

1. Tokenize: one row for each piece of a document (doc_id, piece, start, length, CRC-32 of its ids), as a table.
2. Range-sort the pieces by length; a piece's rank within its length is its place in its partition plus the counts
   of that length in the partitions before. A range partition holds few lengths, so these counts are about as many
   as partitions plus lengths. Pieces of one length are interchangeable, and so are gaps of one size, so both are
   kept as runs: of pieces (length, first rank, count) and of gaps (size, first sequence, count).
3. Supersteps. Runs are dealt by ranges of sizes: the pieces of over half, a quarter, an eighth ... of the capacity. All
   ranges sweep at once, each on its executor: in order of rank, longest pieces first, each run of pieces looks up its
   successor, the smallest gap that holds it, and a gap takes as many equal pieces as it holds. The gaps are updated; those
   that no piece of the range fits any more go to the range of their size or the next lower one for the next superstep.
   In superstep k range k opens sequences for what is left, as all gaps of the longer pieces have come down to it. What
   a sweep decides is a record: pieces from rank a on go k at a time to sequences [s, s + n) at an offset.
4. Each piece finds its record by binary search on (length, rank). The records are broadcast. Their number is bounded by
   CAPACITY alone: a length ends within at most two runs of gaps, so there are at most 8 x CAPACITY runs of gaps, and a
   run that is filled leaves gaps of less than half its size, so it gives at most log2(CAPACITY) records.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from helixmill.llm.common import forget, prepare, trimmed, written

CAPACITY, END_ID = 2048, 0
#: Pre-tokens whose ids a worker keeps.
CACHE = 500_000
#: Code points whose pre-tokens a worker holds at once; a longer text comes alone.
SLICE = 1 << 22
#: Tasks of a superstep; what they hold is bounded by the capacity.
TASKS = 4
#: Text in which the split pattern of ByteLevel means the same to any engine: up to Latin Extended-B, no odd blanks.
_ODD = re.compile(r"[^\x00-\x1b\x20-\x84\x86-\u024f]")
_LETTER, _NUMBER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
_SPLIT = re.compile(rf" ?[{_LETTER}]+| ?[{_NUMBER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")
_encoders: dict[str, "PieceEncoder"] = {}


class PieceEncoder:
    """Ids of texts by the tokenizers library, as little-endian unsigned 32-bit integers. Byte-level BPE merges inside
    the matches of its split pattern only, so of a batch each new match is encoded once and remembered; texts with
    characters on which engines may differ, or with an added token of the tokenizer's, go to the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.merger = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merger.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # for single matches
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [None if _ODD.search(t) or any(a in t for a in self.added) else _SPLIT.findall(t) for t in texts]
        seen = set().union(*(p for p in parts if p))
        new = list(seen - self.known.keys())
        if len(self.known) + len(new) > CACHE:
            self.known = {p: self.known[p] for p in seen if p in self.known}
        self.known.update(zip(new, self._ids(self.merger, new)))
        get = self.known.__getitem__
        return [self._ids(self.tokenizer, [t])[0] if p is None else b"".join(map(get, p)) for t, p in zip(texts, parts)]


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def slices(texts: list[str], size: int = SLICE) -> Iterator[tuple[int, int]]:
    """(start, stop) of consecutive texts of together at most `size` code points, or of one longer text."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > size:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole ones of capacity, what is over in the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece. A null text counts as empty; each document ends with
    END_ID, so even an empty one has a piece of length 1."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            texts = [t or "" for t in b.column(1).to_pylist()]
            made = (ids for start, stop in slices(texts) for ids in enc.encode(texts[start:stop]))
            for d, ids in zip(b.column(0).to_pylist(), made):
                ids += END_ID.to_bytes(4, "little")
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    for r, v in zip(rows, (d, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))):
                        r.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(lambda it: trimmed(run(it)), "doc_id long, piece int, start long, length long, ids_crc32 long")


def band(size: int, capacity: int = CAPACITY) -> int:
    """The range of a size: 0 for over half of the capacity, 1 for over a quarter, and so on."""
    k = 0
    while size <= capacity >> (k + 1):
        k += 1
    return k


def sweep(pieces: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], capacity: int, opens_at: int | None = None) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """One sweep over runs of pieces (length, first rank, count), longest first, each into its successor, the smallest gap that holds
    it, and runs of gaps (size, first sequence, count). With opens_at sequences from that number on are opened for what has
    no gap. Records (length, rank, n, k, first sequence, offset): k pieces each; runs of pieces and of gaps that are left."""
    by_size: dict[int, list[tuple[int, int]]] = {}
    for size, first, n in gaps:
        by_size.setdefault(size, []).append((first, n))
    sizes = sorted(by_size)
    records, left = [], []

    def put_gap(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in by_size:
                by_size[size] = []
                insort(sizes, size)
            by_size[size].append((first, n))

    for length, rank, count in sorted(pieces, reverse=True):
        while count:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                if opens_at is None:
                    left.append((length, rank, count))
                    break
                n = -(-count // (capacity // length))
                put_gap(capacity, opens_at, n)
                opens_at += n
                continue
            size = sizes[at]
            first, n = by_size[size].pop()
            if not by_size[size]:
                del by_size[size], sizes[at]
            k = size // length
            full = min(n, count // k)
            fill = [(full, k)] + ([(1, count % k)] if full < n and count % k and full == count // k else [])
            for used, each in fill:
                if used:
                    records.append((length, rank, used, each, first, capacity - size))
                    put_gap(size - each * length, first, used)
                    rank, count, first, n = rank + used * each, count - used * each, first + used, n - used
            put_gap(size, first, n)
    return records, left, [(size, first, n) for size in sizes for first, n in by_size[size]]


_STATE = "kind int, band int, size long, at long, n long, k long, sequence long, offset long"
_PIECES, _GAPS, _RECORDS = 0, 1, 2


def _superstep(rows: pd.DataFrame, step: int, bands: list[int], capacity: int) -> pd.DataFrame:
    """One range of sizes in one superstep: state in, state and records out."""
    own = int(rows["band"].iloc[0])
    runs = {kind: list(zip(*(rows.loc[rows["kind"] == kind, c].tolist() for c in ("size", "at", "n")))) for kind in (_PIECES, _GAPS)}
    records, left, gaps = sweep(runs[_PIECES], sorted(runs[_GAPS]), capacity, (step + 1) << 44 if own == step else None)
    out = [(_RECORDS, own, length, rank, n, k, first, offset) for length, rank, n, k, first, offset in records]
    out += [(_PIECES, own, length, rank, n, 0, 0, 0) for length, rank, n in left]
    for size, first, n in gaps:
        to = bisect_left(bands, max(own + 1, band(size, capacity)))  # the next range that has pieces
        if to < len(bands):
            out.append((_GAPS, bands[to], size, first, n, 0, 0, 0))
    return pd.DataFrame(out, columns=["kind", "band", "size", "at", "n", "k", "sequence", "offset"])


def plan(spark, counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Records (length, first rank, n, k, first sequence, offset) for so many pieces of each length. Between supersteps the driver
    holds the runs, whose number is bounded by the capacity; it looks at none of them."""
    bands = sorted({band(x, capacity) for x in counts})
    if not bands:
        return []
    state = spark.createDataFrame([(_PIECES, band(x, capacity), x, 0, n, 0, 0, 0) for x, n in sorted(counts.items())], _STATE)
    records = []

    def at(step: int):
        return lambda rows: _superstep(rows, step, bands, capacity)

    for step in bands:
        made = state.repartition(min(len(bands), TASKS), "band").groupBy("band").applyInPandas(at(step), _STATE).toArrow()
        found = pc.equal(made["kind"], _RECORDS)
        records += list(zip(*(made.filter(found)[c].to_pylist() for c in ("size", "at", "n", "k", "sequence", "offset"))))
        state = spark.createDataFrame(made.filter(pc.invert(found)), _STATE)
    return records


def pack(cut_up: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of `cut_up` (doc_id, piece, start, length, ids_crc32; length from 1 to capacity) with sequence_id and
    offset: in a sequence the pieces follow without gaps from 0 and are `capacity` together at most. Equal rows
    stay separate pieces; a null doc_id is packed like any other; no rows give no rows."""
    spark = cut_up.sparkSession
    prepare(spark)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            ranks = []
            for x in b.column(3).to_pylist():
                seen[x] = seen.get(x, -1) + 1
                ranks.append(seen[x])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(ranks), pa.int32()), pa.array(ranks, pa.int64())], [*columns, "part", "rank"])

    placed = written(cut_up.select(*columns).repartitionByRange("length", "doc_id", "piece").mapInArrow(lambda it: trimmed(ranked(it)), f"{kinds}, part int, rank long"), "packing-ranked")
    # a range partition is a stretch of (length, doc_id, piece): the counts are about partitions + lengths
    counts = placed.groupBy("length", "part").agg(F.count("*").alias("n")).collect()
    base, total = {}, {}
    for r in sorted(counts, key=lambda r: (r.length, r.part)):
        base[r.length, r.part] = total.get(r.length, 0)
        total[r.length] = base[r.length, r.part] + r.n
    grouped: dict[int, list] = {}
    for x, *rest in plan(spark, total, capacity):
        grouped.setdefault(x, []).append(rest)
    by_length = {x: np.array(sorted(rows), dtype=np.int64) for x, rows in grouped.items()}
    shared = spark.sparkContext.broadcast((by_length, base))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length, base = shared.value
        for b in batches:
            length, part, rank = (b.column(i).to_numpy() for i in (3, 5, 6))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                i = np.flatnonzero(length == x)
                rows = by_length[int(x)]
                full = rank[i] + np.array([base[int(x), int(p)] for p in part[i]], dtype=np.int64)
                own = rows[np.searchsorted(rows[:, 0], full, "right") - 1]
                turn, place = np.divmod(full - own[:, 0], own[:, 2])
                sequence[i], offset[i] = own[:, 3] + turn, own[:, 4] + place * int(x)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    return placed.mapInArrow(lambda it: trimmed(final(it)), f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """pieces() as a table, then pack(). A null text counts as empty, of one token; rows of a null doc_id and repeated rows are packed like
    any other, each for itself; ties are interchangeable, so their places are any of the best. A text of any length is
    cut into pieces. An empty table gives no rows."""
    made = written(pieces(docs, tokenizer, capacity), "packing-pieces")
    out = pack(made, capacity)
    forget(made)
    return out
