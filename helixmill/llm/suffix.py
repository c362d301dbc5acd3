"""Suffix-array removal of repeated passages, exact in bytes (operator 5).

A byte goes if it is covered by a string of SPAN bytes that also starts in a document with a smaller doc_id.

1. Each window of SPAN bytes is put under its minimizer, the smallest hash of the GRAM-byte strings in it. Equal windows
   have equal minimizers. Stretches of windows with one minimizer are runs; a run's tag is 32 bits of the hash.
2. Tags go to buckets by hash, as compact blobs, and a bucket finds the tags that occur in several documents. What a
   batch has twice itself is known to be shared there and then, and reaches the bucket as one marker with a count, so
   a tag of a third of all documents is one row a batch. Where there are more than FAN buckets, blobs go to FAN ranges of
   buckets first and are cut up there by many at a time, so that they stay large and their number grows with the text.
3. The runs of shared tags (most text has none) are cut from the texts, reduced to the first document of each distinct
   string in the batch, and sent to shards by tag; what the others lose is decided and goes straight to their documents.
   Of a tag that more than HOT documents share, each window is sent by its own hash instead, so that its many different
   surroundings spread over all shards.
4. A shard builds the suffix array of its strings by induced sorting and their permuted common prefixes; neighbours
   that share SPAN bytes are one group, and the group's smallest doc_id decides which windows go.
5. The intervals return to their documents, and what they cover is removed.

Steps 1 and 2 only leave out windows whose minimizer no second document has; they decide nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from helixmill.llm.common import own_names, prepare, trim, trimmed, written
from helixmill.llm.sais import permuted_lcp, suffix_array

SPAN, GRAM = 50, 20
#: Tags of a bucket and text bytes behind a shard, about; documents that make a tag hot; the most hot tags, most
#: frequent first (they are broadcast, 4 bytes each); buckets that a batch deals to, and tags that are cut up at once
#: where there are more.
BUCKET_TAGS, SHARD_TEXT, HOT, MAX_HOT, FAN, HELD_TAGS = 1_000_000, 6_000_000, 20_000, 500_000, 512, 4_000_000
#: Bytes that are hashed at once.
BLOCK = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: One odd factor for each of the four words of a gram, and one to mix their sum.
_WORDS = tuple(np.uint64(int(_FACTOR) * k % (1 << 64) | 1) for k in (1, 0x2545F491, 0x5851F42D, 0x14057B7E))


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, from the words of eight bytes that cover them."""
    n = len(data) - GRAM + 1
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,)).copy()
    out = words[:n] * _WORDS[0]
    for k, at in enumerate([*range(8, GRAM - 8, 8), GRAM - 8], 1):
        out += words[at : at + n] * _WORDS[k]
    out ^= out >> np.uint64(31)
    out *= _FACTOR
    out ^= out >> np.uint64(29)
    return out


def _window_minimum(h: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    return np.minimum(h[: len(h) - (width - k)], h[width - k :]) if k < width else h


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end (text i is data[offsets[i]:offsets[i + 1]]): for each run of windows its text, first
    window (a place in the text), number of windows and mixed minimizer hash. A run never crosses texts; those
    longer than a block are cut into stretches that share SPAN - 1 bytes."""
    parts = []
    i, n = 0, len(offsets) - 1
    while i < n:
        j = i + 1
        while j < n and offsets[j + 1] - offsets[i] <= BLOCK:
            j += 1
        for at in range(int(offsets[i]), max(int(offsets[i]) + 1, int(offsets[j]) - SPAN + 1), BLOCK):
            stop = int(offsets[j]) if j - i > 1 else min(int(offsets[j]), at + BLOCK + SPAN - 1)
            if stop - at < SPAN:
                break
            least = _window_minimum(_grams(data[at:stop]), SPAN - GRAM + 1)
            fine = np.zeros(len(least) + 1, np.int32)
            starts = np.maximum(offsets[i:j], at) - at
            ends = np.minimum(offsets[i + 1 : j + 1], stop) - at - SPAN + 1
            ok = ends > starts
            np.add.at(fine, starts[ok], 1)
            np.add.at(fine, ends[ok], -1)
            v = np.flatnonzero(np.cumsum(fine[:-1]))
            if not len(v):
                continue
            m = least[v]
            new = np.flatnonzero(np.concatenate(([True], (np.diff(v) != 1) | (m[1:] != m[:-1]))))
            first = v[new]
            text = np.searchsorted(offsets, first + at, "right") - 1
            parts.append((text, first + at - offsets[text], np.diff(np.append(new, len(v))), m[new]))
            if j - i > 1:
                break
        i = j
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text, first, n_windows, m = (np.concatenate(x) for x in zip(*parts))
    return text, first, n_windows, _mixed(m)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The data of a string or binary column and its offsets, both from 0."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one blob: their sizes, then their bytes."""
    return b"".join([np.array([len(arrays), *(a.nbytes for a in arrays)], np.uint32).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def _squeezed(blob: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(blob)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.uint32, len(kinds) + 1)[1:]
    at, out = 4 * (len(kinds) + 1), []
    for kind, size in zip(kinds, sizes.tolist()):
        out.append(np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _sorted_set(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _split(key: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts by key, and where the part of each of `keys` begins and ends in it. Keys that don't occur cost
    nothing, so what a batch does doesn't grow with the number of buckets or shards."""
    by = np.argsort(key, kind="stable")
    ordered = key[by]
    return by, np.searchsorted(ordered, keys), np.searchsorted(ordered, keys, "right")


def _distinct_documents(tag: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tags, each entry's tag index, and the number of documents of each tag."""
    tags, group = np.unique(tag, return_inverse=True)
    pair = _sorted_set(group.astype(np.int64) << 32 | doc)
    return tags, group, np.bincount(pair >> 32, minlength=len(tags))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")


def _bucket(tag: np.ndarray, buckets: int) -> np.ndarray:
    return ((_mixed(tag.astype(np.uint64) + np.uint64(55)) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _tag_blobs(kinds: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], marks: np.ndarray, marked: np.ndarray, buckets: int, per: int) -> pa.RecordBatch:
    """A blob for each range of `per` buckets that gets anything. kinds, twice: documents (id, hash), and for each tag its
    document, ascending, and the tag; the second time of tags that are known to be shared. marks: (tag, documents)."""
    keys = [_bucket(tag, buckets) // per for tag in (*(tag for _, _, _, tag in kinds), marks)]
    there_are = np.unique(np.concatenate(keys))
    *cut, (mark_by, mark_start, mark_stop) = (_split(key, there_are) for key in keys)
    numbers, blobs = there_are.tolist(), []
    for r in range(len(numbers)):
        k, parts = mark_by[mark_start[r] : mark_stop[r]], []
        for (ids, hashes, owner, tag), (by, start, stop) in zip(kinds, cut):
            mine = by[start[r] : stop[r]]  # in order of documents still
            there, n = np.unique(owner[mine], return_counts=True)
            parts += [ids[there], hashes[there], n.astype(np.uint32), tag[mine]]
        blobs.append(_pack(*parts, marks[k].astype(np.uint32), marked[k].astype(np.uint32)))
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _tags(batches: Iterator[pa.RecordBatch], buckets: int, per: int) -> Iterator[pa.RecordBatch]:
    """Step 1. For each range of buckets a blob: the documents (id, hash, number of tags), their tags; documents with tags that
    are known to be shared, which any bucket may pass on; markers (tag, documents)."""
    for batch in batches:
        ids, hashes = (batch.column(k).to_numpy() for k in (0, 1))
        text, _, _, m = runs(*_bytes(batch.column(2)))
        if not len(m):
            continue
        same = np.unique(ids, return_inverse=True)[1]
        whole, group, documents = _distinct_documents(m, same[text])
        local, tag = documents[group] > 1, m.astype(np.uint32)
        yield _tag_blobs([(ids, hashes, text[w], tag[w]) for w in (~local, local)], whole[documents > 1].astype(np.uint32), documents[documents > 1], buckets, per)


def _tags_again(batches: Iterator[pa.RecordBatch], buckets: int, per: int) -> Iterator[pa.RecordBatch]:
    """Blobs of ranges, those of a range together, to blobs of their buckets: HELD_TAGS of a range at a time."""

    def out(parts: list) -> pa.RecordBatch:
        ids, hashes, n, tags, ids2, hashes2, n2, tags2, marks, marked = (np.concatenate(x) for x in zip(*parts))
        kinds = [(i, h, np.repeat(np.arange(len(i)), k.astype(np.int64)), t) for i, h, k, t in ((ids, hashes, n, tags), (ids2, hashes2, n2, tags2))]
        return _tag_blobs(kinds, marks, marked, buckets, 1)

    own, parts, size = None, [], 0
    for batch in batches:
        for r, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if parts and (r != own or size > HELD_TAGS):
                yield out(parts)
                parts, size = [], 0
            own = r
            parts.append(_unpack(blob, *_TAG_KINDS))
            size += sum(len(parts[-1][k]) for k in (3, 7, 8))
    if parts:
        yield out(parts)


_TAG_KINDS = ("<i8", "<i8", "<u4", "<u4", "<i8", "<i8", "<u4", "<u4", "<u4", "<u4")


def _owned(ids: np.ndarray, hashes: np.ndarray, owner: np.ndarray, values: np.ndarray, width: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """For each bucket of documents a blob: ids, hashes, numbers of values, values (`width` for each entry of owner, which
    ascends). A document's bucket follows from its id and hash, so copies spread."""
    first = np.flatnonzero(np.concatenate(([True], np.diff(owner) != 0))) if len(owner) else np.zeros(0, np.int64)
    docs = owner[first]
    n = np.diff(np.append(first, len(owner)))
    bucket = (_mixed(ids[docs].astype(np.uint64) ^ hashes[docs].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    there = np.unique(bucket)
    by, start, stop = _split(bucket, there)
    value_by, value_start, value_stop = _split(np.repeat(bucket, n), there)
    for i, b in enumerate(there.tolist()):
        k = by[start[i] : stop[i]]
        yield b, _pack(ids[docs[k]], hashes[docs[k]], (n[k] * width).astype(np.uint32), values[value_by[value_start[i] : value_stop[i]]].astype(np.uint32))


_OWNED_KINDS = ("<i8", "<i8", "<u4", "<u4")


def _gathered(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket of documents: (doc_id, hash, found), all values of a document as one blob."""
    ids, hashes, n, values = (np.concatenate(x) for x in zip(*(_unpack(b, *_OWNED_KINDS) for b in rows["blob"])))
    by = np.lexsort((hashes, ids))
    new = np.concatenate(([True], (np.diff(ids[by]) != 0) | (np.diff(hashes[by]) != 0)))
    group = np.empty(len(ids), np.int64)
    group[by] = np.cumsum(new) - 1
    n = n.astype(np.int64)
    raw = values[np.argsort(np.repeat(group, n), kind="stable")].tobytes()
    at = (np.concatenate(([0], np.cumsum(np.bincount(group, n).astype(np.int64)))) * 4).tolist()
    return pd.DataFrame({"doc_id": ids[by[new]], "hash": hashes[by[new]], "found": [raw[a:b] for a, b in zip(at, at[1:])]})


def _shared(rows: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Step 2, one bucket of tags: blobs of documents' shared tags; hot tags as rows without a bucket: (tag, documents)."""
    parts = [_unpack(b, *_TAG_KINDS) for b in rows["blob"]]
    ids, hashes, n, tags, ids2, hashes2, n2, tags2, marks, marked = (np.concatenate(x) for x in zip(*parts))
    rank = np.empty(len(ids), np.int64)
    order = np.argsort(ids, kind="stable")
    rank[order] = np.arange(len(ids))  # rows with one doc_id are neighbours
    ids, hashes, n_of = ids[order], hashes[order], n.astype(np.int64)
    same = np.cumsum(np.concatenate(([True], np.diff(ids) != 0))) if len(ids) else np.zeros(0, np.int64)
    pair = _sorted_set(tags.astype(np.uint64) << np.uint64(32) | np.repeat(rank, n_of).astype(np.uint64))
    tag, row = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], np.diff(tag) != 0))) if len(tag) else np.zeros(0, np.int64)
    new_doc = np.ones(len(tag), np.int64)
    new_doc[1:] = (tag[1:] != tag[:-1]) | (same[row[1:]] != same[row[:-1]])
    distinct = tag[first]
    documents = np.add.reduceat(new_doc, first) if len(first) else np.zeros(0, np.int64)
    known, weight, twice = _sorted_set(marks).astype(np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    if len(known):
        weight = np.bincount(np.searchsorted(known, marks), marked, len(known)).astype(np.int64)
        at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
        in_both = known[at] == distinct
        documents = documents + np.where(in_both, weight[at], 0)
        twice = np.zeros(len(known), bool)
        twice[at[in_both]] = True
    keep = np.repeat(documents > 1, np.diff(np.append(first, len(tag))))
    by_row = np.sort(row[keep] << 32 | tag[keep])
    out = list(_owned(ids, hashes, by_row >> 32, by_row & 0xFFFFFFFF, 1, buckets))
    out += _owned(ids2, hashes2, np.repeat(np.arange(len(ids2)), n2.astype(np.int64)), tags2, 1, buckets)
    hot = list(zip(distinct[documents > HOT].tolist(), documents[documents > HOT].tolist()))
    alone = ~twice & (weight > HOT)
    hot += zip(known[alone].tolist(), weight[alone].tolist())
    return pd.DataFrame({"bucket": pd.array([b for b, _ in out] + [None] * len(hot), "Int32"), "tag": pd.array([None] * len(out) + [t for t, _ in hot], "Int64"), "documents": pd.array([None] * len(out) + [d for _, d in hot], "Int64"), "blob": [x for _, x in out] + [None] * len(hot)})


def _strings(batches: Iterator[pa.RecordBatch], shards: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Step 3. Rows of doc_id, hash, text, tags (a list of blobs) to blobs for shards: strings (their lengths and bytes),
    and occurrences (doc_id, hash, place, string). Of equal strings in the batch, documents after the first lose all
    windows; these spans need no shard: they go under -1 less their bucket of documents."""
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column(3)))
        ids, hashes = (batch.column(k).to_numpy() for k in (0, 1))
        data, offsets = _bytes(batch.column(2))
        text, first, n_windows, m = runs(data, offsets)
        wanted = [np.frombuffer(x.as_py(), np.uint32) for x in batch.column(3)]
        pairs = _sorted_set(np.repeat(np.arange(len(wanted), dtype=np.int64), [len(x) for x in wanted]) << 32 | np.concatenate(wanted)) if wanted else np.zeros(0, np.int64)
        tag = m.astype(np.uint32).astype(np.int64)
        own = text << 32 | tag
        k = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
        keep = pairs[k] == own if len(pairs) else np.zeros(len(own), bool)
        text, first, n_windows, tag = text[keep], first[keep], n_windows[keep], tag[keep]
        if not len(text):
            continue
        shard = _mixed(tag.astype(np.uint64) + np.uint64(77)) % np.uint64(shards)
        if len(hot) and (is_hot := np.isin(tag, hot)).any():
            again = np.repeat(np.flatnonzero(is_hot), n_windows[is_hot])
            step = np.arange(len(again)) - np.repeat(np.cumsum(n_windows[is_hot]) - n_windows[is_hot], n_windows[is_hot])
            text, first, n_windows = np.concatenate([text[~is_hot], text[again]]), np.concatenate([first[~is_hot], first[again] + step]), np.concatenate([n_windows[~is_hot], np.ones(len(again), np.int64)])
            shard = np.concatenate([shard[~is_hot], np.full(len(again), shards, np.uint64)])
        start = (offsets[text] + first).tolist()
        raw = data.tobytes()
        cut = [raw[a : a + w] for a, w in zip(start, (n_windows + SPAN - 1).tolist())]
        number: dict[bytes, int] = {}
        of = np.array([number.setdefault(x, len(number)) for x in cut], np.int64)
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, of, ids[text])
        gone = np.flatnonzero(ids[text] > least[of])
        gone = gone[np.argsort(text[gone], kind="stable")]
        if len(gone):
            direct = list(_owned(ids, hashes, text[gone], np.stack([first[gone], first[gone] + n_windows[gone] + SPAN - 1], 1), 2, shards))
            yield pa.RecordBatch.from_arrays([pa.array([-1 - b for b, _ in direct], pa.int32()), pa.array([x for _, x in direct], pa.binary())], ["shard", "blob"])
        stays = np.ones(len(text), bool)
        stays[gone] = False
        text, first, of, shard = text[stays], first[stays], of[stays], shard[stays]
        distinct = list(number)
        string_shard = np.zeros(len(distinct), np.int64)
        string_shard[of] = shard.astype(np.int64)
        for i in np.flatnonzero(string_shard == shards).tolist():  # a hot window, by itself
            string_shard[i] = int.from_bytes(hashlib.blake2b(distinct[i], digest_size=6).digest()) % shards
        there = np.unique(string_shard)
        by, start, stop = _split(string_shard, there)
        position = np.empty(len(by), np.int64)
        position[by] = np.arange(len(by))
        occ_by, occ_start, occ_stop = _split(string_shard[of], there)
        for i, s in enumerate(there.tolist()):
            mine, occ = by[start[i] : stop[i]], occ_by[occ_start[i] : occ_stop[i]]
            local = position[of[occ]] - start[i]
            texts = [distinct[x] for x in mine.tolist()]
            docs, which = np.unique(text[occ], return_inverse=True)
            blob = _squeezed(_pack(np.fromiter(map(len, texts), np.uint32, len(texts)), np.frombuffer(b"".join(texts), np.uint8), ids[docs], hashes[docs], which.astype(np.uint16), first[occ].astype(np.uint32), local.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([blob], pa.binary())], ["shard", "blob"])


_STRING_KINDS = ("<u4", "u1", "<i8", "<i8", "<u2", "<u4", "<i4")


def _removed(rows: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Step 4, one shard: blobs of documents' spans, pairs of the first byte and the end of what goes. What is under a negative
    number is such blobs already."""
    if rows["shard"].iloc[0] < 0:
        return pd.DataFrame({"bucket": -1 - rows["shard"], "blob": rows["blob"]})
    number: dict[bytes, int] = {}
    ids, hashes, place, string = [], [], [], []
    for blob in rows["blob"]:
        lengths, data, doc_ids, doc_hashes, which, first, local = _unpack(zstandard.ZstdDecompressor().decompress(blob), *_STRING_KINDS)
        raw, ends = data.tobytes(), np.cumsum(lengths.astype(np.int64)).tolist()
        mine = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip([0, *ends[:-1]], ends)], np.int64)
        ids.append(doc_ids[which])
        hashes.append(doc_hashes[which])
        place.append(first.astype(np.int64))
        string.append(mine[local])
    doc, key, place, string = (np.concatenate(x) for x in (ids, hashes, place, string))
    strings = list(number)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    least = np.full(len(strings), np.iinfo(np.int64).max)
    np.minimum.at(least, string, doc)
    # strings end to end: the bytes that occur are 2 and more, in their order, 1 ends a string, 0 the whole
    joined = np.frombuffer(b"\0".join(strings) + b"\0\0", np.uint8)
    count = np.bincount(joined, minlength=256)
    count[0] -= len(strings) + 1
    symbol = np.cumsum(count > 0) + 1
    sigma = int(symbol[-1]) + 1
    joined = symbol.astype(np.uint8 if sigma <= 256 else np.uint16)[joined]
    ends = np.cumsum(sizes + 1) - 1
    joined[ends], joined[-1] = 1, 0
    sa = suffix_array(joined, sigma, ends=True)
    whole = np.zeros(len(joined), bool)  # places where a whole window starts
    whole[: ends[-1] + 1] = np.repeat(ends, sizes + 1) - np.arange(ends[-1] + 1) >= SPAN
    lcp = permuted_lcp(joined, sa, whole)
    owner = np.repeat(np.arange(len(strings), dtype=np.int32), sizes + 1)
    order = sa[whole[sa]]
    new = np.flatnonzero(lcp[order] < SPAN) if len(order) else np.zeros(0, np.int64)
    if len(new) and new[0]:
        new = np.insert(new, 0, 0)
    group_least = np.minimum.reduceat(least[owner[order]], new)
    first_doc = np.zeros(len(joined), np.int64)
    first_doc[order] = np.repeat(group_least, np.diff(np.append(new, len(order))))
    # each occurrence's windows, in order of document and place
    n, base = sizes[string] - SPAN + 1, ends[string] - sizes[string]
    which = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    goes = first_doc[base[which] + step] < doc[which]
    which, step = which[goes], step[goes]
    doc, key, at = doc[which], key[which], place[which] + step
    by = np.lexsort((at, key, doc))
    doc, key, at = doc[by], key[by], at[by]
    if not len(doc):
        return pd.DataFrame({"bucket": pd.Series([], dtype="int32"), "blob": []})
    other = np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(key) != 0)))
    start = np.flatnonzero(other | np.concatenate(([True], np.diff(at) > 1)))
    last = np.append(start[1:], len(at)) - 1
    spans = np.stack([at[start], at[last] + SPAN], 1)
    owner = (np.cumsum(other) - 1)[start]
    out = list(_owned(doc[other], key[other], owner, spans, 2, buckets))
    return pd.DataFrame({"bucket": pd.array([b for b, _ in out], "Int32"), "blob": [x for _, x in out]})


def _freeing(rows: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """_shared(); what it took is given back before the next bucket comes."""
    out = _shared(rows, buckets)
    trim()
    return out


def intervals(docs: DataFrame) -> DataFrame:
    """docs' doc_id, hash, text and spans: a blob of (first byte, end) pairs that go, in no order, overlapping maybe; null
    where nothing goes."""
    spark = docs.sparkSession
    prepare(spark)
    keyed = _keyed(docs)
    usable = keyed.where(f"doc_id is not null and octet_length(text) >= {SPAN}")
    total = docs.where(f"doc_id is not null and octet_length(text) >= {SPAN}").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, shards = max(8, -(-total * 2 // (SPAN - GRAM + 2) // BUCKET_TAGS)), max(8, -(-total // SHARD_TEXT))
    per = -(-buckets // FAN)  # buckets of a range
    entries = usable.mapInArrow(lambda it: trimmed(_tags(it, buckets, per)), "bucket int, blob binary")
    if per > 1:  # a range is dealt to several tasks, each of which gets stretches of it
        salted = entries.withColumn("salt", F.pmod(F.xxhash64("blob"), F.lit(-(-total // (1 << 26)) // FAN + 1)))
        again = salted.repartition(max(FAN, total >> 26), "bucket", "salt").sortWithinPartitions("bucket").select("bucket", "blob")
        entries = again.mapInArrow(lambda it: trimmed(_tags_again(it, buckets, per)), "bucket int, blob binary")
    shared = written(entries.groupBy("bucket").applyInPandas(lambda rows: _freeing(rows, shards), "bucket int, tag long, documents long, blob binary"), "shared-tags")
    hot = shared.where("bucket is null").groupBy("tag").agg(F.sum("documents").alias("n")).orderBy(F.desc("n"), "tag").limit(MAX_HOT).collect()
    hot_tags = spark.sparkContext.broadcast(np.sort(np.array([r.tag for r in hot], np.int64)))
    found = "doc_id long, hash long, found binary"
    tags = shared.where("bucket is not null").select("bucket", "blob").groupBy("bucket").applyInPandas(_gathered, found)
    # a left join like the last one, so that one exchange of the texts serves both
    text = keyed.join(tags.hint("shuffle_hash"), ["doc_id", "hash"], "left").select("doc_id", "hash", "text", "found")
    strings = text.mapInArrow(lambda it: trimmed(_strings(it, shards, hot_tags.value)), "shard int, blob binary")
    spans = strings.groupBy("shard").applyInPandas(lambda rows: _removed(rows, shards), "bucket int, blob binary")
    spans = spans.groupBy("bucket").applyInPandas(_gathered, found).withColumnRenamed("found", "spans")
    return keyed.join(spans.hint("shuffle_hash"), ["doc_id", "hash"], "left").select("doc_id", "hash", "text", "spans")


def merged(blob: bytes | None) -> list[tuple[int, int]]:
    """Maximal removed stretches from pairs of first byte and end; ones that touch or overlap are one."""
    if not blob:
        return []
    pairs = np.frombuffer(blob, "<u4").reshape(-1, 2).astype(np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate(([True], pairs[1:, 0] > reach[:-1]))
    start = np.flatnonzero(new)
    return list(zip(pairs[start, 0].tolist(), reach[np.append(start[1:], len(reach)) - 1].tolist()))


def _kept(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in gone:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row. A null text counts as empty; a document with a null
    doc_id neither removes nor loses anything; rows with one doc_id never remove each other's text, equal or not; an
    empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, blob in zip(b.column(1).cast(pa.binary()), b.column(2)):
                raw = t.as_py() or b""
                gone = merged(blob.as_py())
                rows.append((len(raw), sum(e - a for a, e in gone), len(gone), hashlib.sha256(_kept(raw, gone)).hexdigest()))
            n, r, s, h = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(h, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return intervals(docs).select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated passages cut out of text (a character of which a part goes, goes), n_chars, where there is
    one, its new length. Documents that lose their whole text go; those that had none stay. A document with a null doc_id neither
    removes nor loses anything, nor do rows of one doc_id remove each other's text; repeated rows stay, each cut
    alike. An empty table stays empty."""
    columns, docs = docs.columns, own_names(docs, "doc_id", "text", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, blob in zip(b.column(2).cast(pa.binary()), b.column(3)):
                raw = t.as_py()
                gone = merged(blob.as_py()) if raw else []
                texts.append(_kept(raw, gone).decode("utf-8", "ignore") if gone else raw if raw is None else raw.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pc.is_valid(b.column(3))], ["__hm_id", "__hm_hash", "__hm_text", "__hm_cut"])

    cut = intervals(docs).mapInArrow(run, "__hm_id long, __hm_hash long, __hm_text string, __hm_cut boolean").where("__hm_cut").dropDuplicates(["__hm_id", "__hm_hash"])
    keyed = docs.withColumn("__hm_own", F.xxhash64("text"))
    both = keyed.join(cut, (F.col("doc_id") == F.col("__hm_id")) & (F.col("__hm_own") == F.col("__hm_hash")), "left").where("__hm_cut is null or __hm_text <> ''")
    new = F.when(F.col("__hm_cut"), F.col("__hm_text")).otherwise(F.col("text"))
    return both.select(*(new.alias("text") if c == "text" else F.when(F.col("__hm_cut"), F.length("__hm_text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns)).toDF(*columns)
