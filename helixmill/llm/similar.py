"""Near-duplicates of similarity 0.8 and more by SimHash with multi-index hashing: the pipeline's form of operator 4.

The similarity is the exact Jaccard index of the sets of five-word shingles, and it alone decides a link. Fingerprints
only find candidates. Two texts of similarity 0.8 differ in about 15 % of the bits of their fingerprints, too many for
balls in 64 bits, so fingerprints are longer: as many segments as it takes for such a pair to meet, with a probability
of 0.99 or more, in one. Segments have about as many keys as there are fingerprints. A segment's table is dealt out by
the top bits of its keys, and each fingerprint goes to one part of each table, so it is sent once a table and no more.
Inside a part, the ball of radius 1 around the other bits is enumerated and looked up, and those that differ in MOST_BITS of
the first COMPARED words or fewer, three standard deviations above the mean of such a pair, are candidates. The number
of rows chooses segments, so the ways to find a candidate, but neither this distance nor what is linked. Of each component of
candidates the texts are read again, and all its pairs of Jaccard index 0.8 or more are linked.

What is sent is 52 bytes a table: 24 tables for 200,000 fingerprints, 52 for 12 million, 143 for a billion. Equal sets of
shingles are one fingerprint from the start. Keys that more than CROWD fingerprints share are linked by a search
through the group that compares new members only with those not reached yet, so a group of near copies gives as many
links as it has members, and the groups, not the members, are compared across keys. A part sends one link for each
member of a group, to its smallest.

A task that verifies holds the shingle hashes, 8 bytes each, of a whole component of candidates if they are at most PART, else of
one or two blocks of it: a large component is dealt into blocks twice, by two hashes, and what the blocks find joins nearly all of a
group of near copies. The texts outside the component's largest group then meet every block of it, so each pair of texts
that isn't linked through others by then is compared, in tasks of the same bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from helixmill.llm.common import own_names, prepare, trimmed, written
from helixmill.llm.components import components

SHINGLE, SEED = 5, 42
#: The Jaccard index that links, as a fraction.
SHARED, OF = 4, 5
#: Of a pair at that similarity: the share of differing bits; the chance not to meet; the share of bits up to which it is a candidate.
DIFFERING, MISSED, MOST_BITS = 0.15, 0.01, 0.21
#: Words of 64 bits of a fingerprint that are compared, whatever the number of rows.
COMPARED = 5
MIN_BITS, SHARD_ROWS, CROWD = 20, 250_000, 64
#: Shingles of a block of a component of candidates.
PART = 1 << 21
#: Fingerprints that are dealt at once.
HELD = 1 << 15
_BLOCK = 1 << 16


def shape(n: int) -> tuple[int, int, int, int]:
    """For n fingerprints: bits of a segment, segments, words of 64 bits, and top bits by which a table is dealt out. The size
    decides how candidates are found, never which texts are linked."""
    bits, top = min(40, max(MIN_BITS, math.ceil(math.log2(max(n, 2))))), 0
    while n / 2**top > SHARD_ROWS:
        top += 1
    q, low = 1 - DIFFERING, bits - top
    meets = q**top * (q**low + low * DIFFERING * q ** (low - 1))
    tables = math.ceil(math.log(MISSED) / math.log(1 - meets))
    return bits, tables, -(-bits * tables // 64), top


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    h = h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The hashes of the set of word shingles, ascending; none for a text without words."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    size = min(size, len(parts))
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.sort(np.fromiter({digest(joined[a:b], SEED) for a, b in zip(starts[: len(parts) - size + 1].tolist(), ends[size - 1 :].tolist())}, np.uint64))


def fingerprint(h: np.ndarray, words: int) -> np.ndarray:
    """`words` times 64 bits over a set of shingles; all zero for an empty one."""
    ones, at_once = np.zeros(64 * words, np.int64), max(1, _BLOCK // words)
    for at in range(0, len(h), at_once):
        m = np.stack([_mixed(h[at : at + at_once], k) for k in range(words)], 1).astype("<u8")
        ones += np.unpackbits(m.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8").astype(np.uint64)


def _keys(fps: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """fingerprints x tables."""
    spread = np.unpackbits(np.ascontiguousarray(fps.astype("<u8")).view(np.uint8), axis=1, bitorder="little")[:, : bits * tables]
    return (spread.reshape(len(fps), tables, bits).astype(np.int64) << np.arange(bits)).sum(2)


def _search(fps: np.ndarray, most: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The group of each fingerprint, as its first member, and links that hold the groups together."""
    group, links = np.full(len(fps), -1), []
    left = np.arange(len(fps))
    while len(left):
        first, left = left[0], left[1:]
        group[first] = first
        waiting = [first]
        while waiting and len(left):
            x = waiting.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]).sum(1, dtype=np.int64) <= most
            if near.any():
                found = left[near]
                group[found] = first
                links += [(int(x), int(y)) for y in found]
                waiting += found.tolist()
                left = left[~near]
    return group, links


def _across(a: np.ndarray, b: np.ndarray, most: int) -> list[tuple[int, int]]:
    """For each group of b that some of a are near: links of those to one of its members each."""
    groups, _ = _search(b, most)
    links = []
    for g in np.unique(groups).tolist():
        members = np.flatnonzero(groups == g)
        rest = np.arange(len(a))
        for m in members.tolist():
            near = np.bitwise_count(a[rest] ^ b[m]).sum(1, dtype=np.int64) <= most
            links += [(int(x), m) for x in rest[near]]
            rest = rest[~near]
            if not len(rest):
                break
    return links


def _linked(blobs: list[bytes], low_bits: int, words: int, most: int) -> pd.DataFrame:
    """One part of a table: links (u, v) between fingerprints whose keys differ in one bit at most."""
    parts = []
    for blob in blobs:
        n = len(blob) // (12 + 8 * words)
        parts.append((np.frombuffer(blob, "<i4", n), np.frombuffer(blob, "<i8", n, 4 * n), np.frombuffer(blob, "<u8", n * words, 12 * n).reshape(n, words)))
    low, ids, fps = (np.concatenate(x) for x in zip(*parts))
    by = np.lexsort((ids, low))
    low, ids, fps = low[by], ids[by], fps[by]
    n = len(low)
    nothing = pd.DataFrame({"u": pd.Series([], dtype="int64"), "v": pd.Series([], dtype="int64")})
    keys, start, size = np.unique(low, return_index=True, return_counts=True)
    crowded = keys[size > CROWD]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for mask in (0, *(1 << i for i in range(low_bits))):
        who, key = np.arange(n), low ^ np.int32(mask)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        who, at, key = who[hit], at[hit], key[hit]
        many = np.isin(key, crowded)
        for k in np.unique(key[many]).tolist():
            b = int(np.searchsorted(keys, k))
            members = np.arange(start[b], start[b] + size[b])
            mine = who[key == k]
            links = _search(fps[members], most)[1] if mask == 0 else _across(fps[mine], fps[members], most)
            if links:
                u, v = np.array(links).T
                found.append((ids[(members if mask == 0 else mine)[u]], ids[members[v]]))
        who, at = who[~many], at[~many]
        count = size[at]
        for s in range(0, len(who), 50_000):
            c = count[s : s + 50_000]
            u = np.repeat(who[s : s + 50_000], c)
            v = np.repeat(start[at[s : s + 50_000]], c) + np.arange(len(u)) - np.repeat(np.cumsum(c) - c, c)
            ok = ids[u] < ids[v]
            u, v = u[ok], v[ok]
            near = np.bitwise_count(fps[u] ^ fps[v]).sum(1, dtype=np.int64) <= most
            found.append((ids[u[near]], ids[v[near]]))
    if not found:
        return nothing
    u, v = (np.concatenate(x) for x in zip(*found))
    return _stars(u, v)


def _stars(u: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    """The same groups with one link for each member: to the group's smallest."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(names))
    return pd.DataFrame({"u": names[own], "v": names[label[own]]})


def _grouped(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first one that links of Jaccard index SHARED / OF or more reach. A set that is linked to x has
    SHARED / OF of its shingles, so it has one of the rarest others and one more: only such sets are compared."""
    size = np.array([len(s) for s in sets], np.int64)
    start = np.cumsum(size) - size
    code, names = pd.factorize(np.concatenate(sets))
    owner = np.repeat(np.arange(len(sets)), size)
    group, left, has = np.arange(len(sets)), size > 0, np.zeros(len(names), bool)
    indexed, remain = 0, int(left.sum())
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first] = False
        remain -= 1
        waiting = [first]
        while waiting and remain:
            if not indexed or 2 * remain < indexed:  # anew over those that are left
                rows = np.flatnonzero(left[owner])
                rows = rows[np.argsort(code[rows], kind="stable")]
                holders, often = owner[rows], np.bincount(code[rows], minlength=len(names))
                begin, indexed = np.cumsum(often) - often, remain
            x = waiting.pop()
            own = code[start[x] : start[x] + size[x]]
            rare = own[np.argsort(often[own], kind="stable")][: size[x] - -(-SHARED * size[x] // OF) + 1]
            hit = np.zeros(len(sets), bool)
            for s in rare.tolist():
                hit[holders[begin[s] : begin[s] + often[s]]] = True
            who = np.flatnonzero(hit & left & (OF * size >= SHARED * size[x]) & (SHARED * size <= OF * size[x]))
            if not len(who):
                continue
            has[own] = True
            at = np.cumsum(size[who]) - size[who]
            places = np.repeat(start[who] - at, size[who]) + np.arange(int(size[who].sum()))
            both = np.add.reduceat(has[code[places]].astype(np.int64), at)
            has[own] = False
            found = who[OF * both >= SHARED * (size[who] + size[x] - both)]
            group[found] = first
            left[found] = False
            remain -= len(found)
            waiting += found.tolist()
    return group


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, text), those of a key together: (id, least), the smallest id of the key that an id is linked with, if smaller."""

    def out(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        ids = np.array(sorted(sets), np.int64)
        least = ids[_grouped([sets[i] for i in ids.tolist()])] if len(ids) else ids
        return pa.RecordBatch.from_arrays([pa.array(ids[least < ids]), pa.array(least[least < ids])], ["id", "least"])

    key, sets = None, {}
    for b in batches:
        for k, i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
            if k != key:
                if len(sets) > 1:
                    yield out(sets)
                key, sets = k, {}
            if i not in sets:
                sets[i] = shingles(text.as_py() or b"")
    if len(sets) > 1:
        yield out(sets)


def _dealt(batches: Iterator[pa.RecordBatch], bits: int, tables: int, words: int, top: int) -> Iterator[pa.RecordBatch]:
    """(part, blob): for each table the fingerprints of each part of it, HELD of them at a time: keys, ids, words."""
    low_bits = bits - top

    def out(ids: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        fine = fps.any(1)  # texts without words are like no other
        ids, fps = ids[fine], fps[fine]
        keys, kept = _keys(fps, bits, tables), fps[:, :COMPARED]
        for t in range(tables):
            high, low = keys[:, t] >> low_bits, (keys[:, t] & ((1 << low_bits) - 1)).astype("<i4")
            by = np.argsort(high, kind="stable")
            at = np.searchsorted(high[by], np.arange((1 << top) + 1))
            own = [(h, by[at[h] : at[h + 1]]) for h in range(1 << top) if at[h] < at[h + 1]]
            blobs = [b"".join((low[k].tobytes(), ids[k].astype("<i8").tobytes(), kept[k].astype("<u8").tobytes())) for _, k in own]
            yield pa.RecordBatch.from_arrays([pa.array([t << top | h for h, _ in own], pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        if b.num_rows:
            held.append((b.column(0).to_numpy().copy(), np.asarray(b.column(1).flatten()).astype(np.int64).view(np.uint64).reshape(-1, words)))
        if sum(len(x) for x, _ in held) >= HELD:
            yield from out(*map(np.concatenate, zip(*held)))
            held = []
    if held:
        yield from out(*map(np.concatenate, zip(*held)))


def _compared(keyed: DataFrame) -> DataFrame:
    """(key, id, text): the links (id, least) of each key's texts."""
    together = keyed.select("key", "id", "text").repartition("key").sortWithinPartitions("key")
    return written(together.mapInArrow(lambda it: trimmed(_verified(it)), "id long, least long"), "wide-alike")


def _alike(members: DataFrame, texts: DataFrame) -> DataFrame:
    """members: (root, id, n) of the components of candidates; texts: (root, id, text). Returns (id, least) for each id that isn't
    the smallest of its group of linked texts."""
    big = written(members.groupBy("root").agg(F.ceil(F.sum("n") / PART).alias("parts")).where("parts > 1"), "wide-big")
    if big.isEmpty():
        return _compared(texts.withColumnRenamed("root", "key"))

    def block(k: int, parts: str) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(k)), F.col(parts))

    texts = texts.join(big, "root", "left")
    twice = F.array(*(F.array("root", F.lit(k).cast("long"), block(k, "parts")) for k in (1, 2)))
    once = F.array(F.array("root", F.lit(0).cast("long"), F.lit(0).cast("long")))
    first = _compared(texts.withColumn("key", F.explode(F.when(F.col("parts").isNull(), once).otherwise(twice))))
    mine = written(members.select("root", "id", "n").join(big, "root"), "wide-mine")
    small = first.join(mine.select("id"), "id", "left_anti")
    links = first.join(mine.select("id"), "id", "left_semi").select(F.col("id").alias("u"), F.col("least").alias("v"))
    found = components(links)
    labels = found.select(F.col("node").alias("id"), F.col("root").alias("label"))
    mine = mine.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    groups = mine.groupBy("root", "label").agg(F.sum("n").alias("s")).groupBy("root").agg(F.max(F.struct("s", "label")).alias("most"), F.sum("s").alias("s"))
    rest = groups.select("root", F.col("most.label").alias("most"), F.ceil((F.col("s") - F.col("most.s")) / PART).alias("others")).where("others > 0")
    mine = written(mine.join(rest, "root").select("id", "root", "parts", "others", (F.col("label") != F.col("most")).alias("other")), "wide-rest")
    if not mine.isEmpty():
        all_of = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        met = F.transform(all_of("others"), lambda b: F.array("root", b, block(1, "parts")))
        asks = F.transform(all_of("parts"), lambda b: F.array("root", block(3, "others"), b))
        keys = mine.select("id", F.array_distinct(F.when(F.col("other"), F.concat(met, asks)).otherwise(met)).alias("keys"))
        again = _compared(texts.select("id", "text").join(keys, "id").withColumn("key", F.explode("keys")))
        found = components(links.union(again.select("id", "least")))
    return small.union(found.select("node", "root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each group of linked documents the one of the smallest doc_id (then of the smallest text hash; one of equal rows;
    null doc_ids last), with all columns. Texts without words are copies of each other; an empty table stays empty."""
    spark = docs.sparkSession
    prepare(spark)
    columns = docs.columns
    docs = own_names(docs, "doc_id", "text")
    bits, tables, words, top = shape(docs.count())

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, fps = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int64), []
            for k, x in enumerate(b.column(2).cast(pa.binary())):
                h = shingles(x.as_py() or b"")
                ids[k] = xxhash.xxh64_intdigest(h.tobytes(), SEED)
                sizes[k] = len(h)
                fps.append(fingerprint(h, words).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids.view(np.int64)), pa.array(sizes), pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "text_hash", "id", "n", "words"])

    made = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(lambda it: trimmed(prints(it)), "doc_id long, text_hash long, id long, n long, words array<long>")
    made = written(made, "wide-prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash"))
    once = written(made.groupBy("id").agg(first.alias("first"), F.min("n").alias("n"), F.min("words").alias("words")), "wide-once")
    dealt = once.select("id", "words").mapInArrow(lambda it: trimmed(_dealt(it, bits, tables, words, top)), "part int, blob binary")
    most = round(MOST_BITS * 64 * COMPARED)
    links = dealt.groupBy("part").applyInPandas(lambda rows: _linked(rows["blob"].tolist(), bits - top, COMPARED, most), "u long, v long")
    found = components(links)
    members = found.select("node", "root").union(found.select(F.col("root").alias("node"), "root").distinct())
    members = once.join(members, F.col("id") == F.col("node")).select("root", "id", "n", F.col("first.doc_id").alias("__hm_id"), F.col("first.text_hash").alias("__hm_hash"))
    members = written(members, "wide-members")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("__hm_text"))
    texts = texts.join(members, F.col("doc_id").eqNullSafe(F.col("__hm_id")) & (F.col("__hm_text") == F.col("__hm_hash"))).select("root", "id", "text")
    alike = _alike(members, texts)
    rooted = once.select("id", "first").join(alike, "id", "left").select(F.coalesce("least", "id").alias("root"), "first")
    keep = rooted.groupBy("root").agg(F.min("first").alias("k")).select(F.col("k.doc_id").alias("__hm_id"), F.col("k.text_hash").alias("__hm_hash"))
    keyed = docs.withColumn("__hm_text", F.xxhash64("text"))
    kept = keyed.join(keep, F.col("doc_id").eqNullSafe(F.col("__hm_id")) & (F.col("__hm_text") == F.col("__hm_hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__hm_text"]).drop("__hm_text").toDF(*columns)
