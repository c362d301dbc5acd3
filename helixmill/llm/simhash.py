"""SimHash near-duplicates by multi-index hashing (operator 4).

Fingerprints link at RADIUS or fewer differing bits. A fingerprint is cut into segments with radii r_i whose r_i + 1
sum to RADIUS + 1: if two fingerprints differed in more than r_i bits in each segment i, they would differ in more
than RADIUS bits. So it is enough to look up, for each segment, the keys of the Hamming ball of radius r_i in a table
of segment keys, and to verify the complete distance of what is found.

Copies share a fingerprint and are counted before anything else. A segment key that more than CROWD fingerprints
share would pair them all, so such keys are left out of the table, and every fingerprint that would have looked one
up is linked another way, just as exact: two fingerprints are at distance <= 4 if and only if some point lies within 2
of both, so each of these names the 2081 points of its ball of radius 2, and a point links those that name it to the
smallest of them. Both ways cost a bounded number of rows for each fingerprint, whatever the group's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from helixmill.llm.common import own_names, prepare, written
from helixmill.llm.components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: (shift, bits, radius): three segments, of 45 lookups a fingerprint, while a key has few fingerprints by chance (32 at the
#: bound); two of 32 bits, of 562 lookups, beyond. Both are exact.
FEW, MANY, MANY_FROM = ((0, 21, 1), (21, 21, 1), (42, 22, 0)), ((0, 32, 2), (32, 32, 1)), 1 << 26
CROWD = 400
_BLOCK = 1 << 16


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: a bit is 1 where it is set in over half of the XXH64 of the word shingles."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    pairs = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in pairs], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _BLOCK):
        ones += np.unpackbits(h[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(h)).tolist()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text) and fp, the fingerprint as a signed long. Null text: no words."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py() or b"") for x in b.column(2).cast(pa.binary())), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fp long")


def ball(bits: int, radius: int) -> list[int]:
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def _xor(key: Column, masks: list[int]) -> Column:
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.explode(F.transform(F.array(*map(F.lit, signed)), lambda m: m.bitwiseXOR(key)))


def _key(fp: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1))


def links(distinct: DataFrame, n: int) -> DataFrame:
    """(u, v): links that connect what the pairs of fingerprints (column fp, each once, n in all) within RADIUS do."""
    segments = FEW if n < MANY_FROM else MANY
    tag = lambda k: F.lit(k << 33)  # noqa: E731  a segment's keys, told from the other segments'
    own = [_key(F.col("fp"), s, b).bitwiseOR(tag(k)) for k, (s, b, _) in enumerate(segments)]
    index = distinct.select(F.explode(F.array(*own)).alias("key"), "fp")
    crowded = written(index.groupBy("key").count().where(F.col("count") > CROWD).select("key"), "crowded")

    probes = None
    for k, (s, b, r) in enumerate(segments):
        one = distinct.select(_xor(_key(F.col("fp"), s, b).bitwiseOR(tag(k)), ball(b, r)).alias("key"), F.col("fp").alias("u"))
        probes = one if probes is None else probes.union(one)
    table = index.join(crowded, "key", "left_anti").select("key", F.col("fp").alias("v"))
    # merge: the planner's estimate doesn't know how many rows a ball makes, so it would send them all through the driver for a broadcast
    found = probes.join(table.hint("merge"), "key").where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)).select("u", "v")
    # those that would look up a crowded key: their own key lies in its ball
    near = None
    for k, (s, b, r) in enumerate(segments):
        one = crowded.where(F.shiftrightunsigned("key", 33) == k).select(_xor(F.col("key"), ball(b, r)).alias("key"))
        near = one if near is None else near.union(one)
    dense = written(index.join(near.distinct(), "key", "left_semi").select("fp").distinct(), "dense")
    points = dense.select("fp", _xor(F.col("fp"), ball(64, 2)).alias("point"))
    hubs = points.groupBy("point").agg(F.min("fp").alias("v"), F.max("fp").alias("m")).where("v < m").select("point", "v")
    stars = points.join(hubs.hint("merge"), "point").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return found.union(stars).distinct()


def labelled(prints: DataFrame) -> DataFrame:
    """prints (doc_id, text_hash, fp; a table) with component_id: the smallest doc_id that links reach from the row, its
    own included. A null doc_id is never the smallest while there is another; a component of nulls has null. Equal
    rows stay. Texts without words have fingerprint zero and link like any other."""
    once = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    found = components(links(once.select("fp"), once.count()))
    rooted = once.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(least, "root").drop("root"), "fp")


def components_of(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs."""
    prints = written(fingerprints(docs), "prints")
    return labelled(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, that of the smallest doc_id (then of the smallest text hash; one of equal rows;
    null doc_ids last), with all columns. An empty table stays empty."""
    columns, docs = docs.columns, own_names(docs, "doc_id", "text")
    prints = written(fingerprints(docs), "prints")
    first = labelled(prints).groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("f")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")).alias("k"))
    first = first.select(F.col("k.doc_id").alias("__hm_id"), F.col("k.text_hash").alias("__hm_hash"))
    keyed = docs.withColumn("__hm_text", F.xxhash64("text"))
    kept = keyed.join(first, F.col("doc_id").eqNullSafe(F.col("__hm_id")) & (F.col("__hm_text") == F.col("__hm_hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__hm_text"]).drop("__hm_text").toDF(*columns)
