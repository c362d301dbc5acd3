"""Byte-level BPE with a local rank file: encode whole texts, decode to raw bytes (operator 1), and the exact
histogram of encoded lengths (operator 6).

Texts longer than `chunk` code points are cut only where the split pattern always ends a match: between a
character that is no white space and a following space or newline. No alternative of the pattern runs from a
non-space into white space and none looks back, so the matches of the parts are the matches of the whole.
Where no such place comes soon (one run of a million letters or blanks), the matches of that stretch are found
one by one and merged singly, which needs neither deep recursion nor a second copy of the text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F

from helixmill.llm.common import prepare, written

CHUNK = 8192
_BOUNDARY = re.compile(r"(?<=\S)(?=[ \n])")
_codecs: dict[tuple, "ByteBPE"] = {}


class ByteBPE:
    def __init__(self, rank_file: str, pattern: str, chunk: int = CHUNK):
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.core = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # the same white space as in the pattern's own engine
        self.one = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.chunk = chunk

    def encode(self, text: str | None) -> list[int]:
        text = text or ""
        n, at, ids = len(text), 0, []
        while n - at > self.chunk:
            found = _BOUNDARY.search(text, at + self.chunk - 256, min(n, at + self.chunk + 1))
            if found:
                ids += self.core.encode_ordinary(text[at : found.start()])
                at = found.start()
                continue
            later = _BOUNDARY.search(text, at + self.chunk + 1)
            end = later.start() if later else n
            for match in self.one.finditer(text, at, end):
                ids += self.core._encode_single_piece(match.group())
            at = end
        return ids + self.core.encode_ordinary(text[at:]) if ids else self.core.encode_ordinary(text[at:])

    def decode(self, ids: list[int]) -> bytes:
        """The raw bytes: ids may end inside a character, so nothing is forced into UTF-8."""
        return self.core.decode_bytes(ids)


def codec(rank_file: str, pattern: str, chunk: int = CHUNK) -> ByteBPE:
    """One codec a process: building it costs a fraction of a second."""
    key = (rank_file, pattern, chunk)
    if key not in _codecs:
        _codecs[key] = ByteBPE(*key)
    return _codecs[key]


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """docs' doc_id and `ids` array<int>. A null text counts as empty: no ids. Rows that repeat, null doc_ids
    and further columns make no difference; an empty table gives an empty result."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(rank_file, pattern)
        for b in batches:
            ids = pa.array([bpe.encode(x.as_py()) for x in b.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and `bytes` binary of rows with `ids` (null: no bytes)."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(rank_file, pattern)
        for b in batches:
            out = pa.array([bpe.decode(x.as_py() or []) for x in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), out], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """encode() and decode() of each text in one pass, as digests: doc_id, n_tokens, ids_sha256, decoded_sha256.
    The ids never leave the worker, so nothing is shuffled and a batch holds one text's ids at a time."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(rank_file, pattern)
        said = [str(i) for i in range(bpe.core.n_vocab)].__getitem__
        for b in batches:
            rows = []
            for x in b.column(1):
                ids = bpe.encode(x.as_py())
                rows.append((len(ids), hashlib.sha256(" ".join(map(said, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            n, a, d = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


#: Lengths are summed up in blocks of so many, so that no task orders all distinct lengths.
BLOCK = 64


def encoded_lengths(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(rank_file, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(bpe.encode(x.as_py())) for x in b.column(1)], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row for each distinct encoded length L: n_tokens = L, docs with it, and for the context limit L
    docs_ge (documents of at least L), tokens_ge (their tokens), total_tokens, truncated_tokens (the sum of
    min(length, L)) and quantile (the share of documents of at most L).

    Partial sums come before the shuffle, so a length that a third of all documents share is one row a task. The counts
    are written, as blocks and lengths both read them: documents are encoded once. The suffix sums run in blocks of
    BLOCK lengths; only the blocks' totals, one row each, meet in one task. Null lengths take no part; no rows give
    no rows."""
    hist = written(lengths.where("n_tokens is not null").groupBy("n_tokens").agg(F.count("*").alias("docs")), "lengths").withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    tokens = F.col("docs") * F.col("n_tokens")
    later, whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = hist.groupBy("block").agg(F.sum("docs").alias("d"), F.sum(tokens).alias("t"))
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("later_tokens"), F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("total_tokens"))
    here = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    sums = hist.join(blocks, "block").select("n_tokens", "docs", (F.sum("docs").over(here) + F.col("later_docs")).alias("docs_ge"), (F.sum(tokens).over(here) + F.col("later_tokens")).alias("tokens_ge"), "total_tokens", "all_docs")
    return sums.select("n_tokens", "docs", "docs_ge", "tokens_ge", "total_tokens", (F.col("total_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_tokens"), ((F.col("all_docs") - F.col("docs_ge") + F.col("docs")) / F.col("all_docs")).alias("quantile"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents and tokens in all, the documents longer than it, and the tokens left
    after truncation. Exact for every limit; the limits are the caller's few values, so they are broadcast. An empty histogram
    gives no rows."""
    wanted = F.broadcast(histogram.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long"))
    cut = F.col("docs") * (F.col("n_tokens") - F.col("context_limit"))
    over = F.col("n_tokens") > F.col("context_limit")
    tokens = F.col("docs") * F.col("n_tokens")
    return histogram.join(wanted).groupBy("context_limit").agg(F.sum("docs").alias("docs"), F.sum(tokens).alias("tokens"), F.sum(F.when(over, F.col("docs")).otherwise(0)).alias("docs_over"), (F.sum(tokens) - F.sum(F.when(over, cut).otherwise(0))).alias("kept_tokens"))
