"""Language identification by interpolated Kneser-Ney character models (operator 7).

Symbols are lower-cased letters; a run of anything else is one word boundary (0). A gram is a symbol with the four
before it in the same word, filled up with boundaries. Training counts the grams of the training documents, but for those
held back to calibrate (CALIBRATION_DOCS of them, at most a share of CALIBRATION_SHARE); the model of a language is built from all its grams, none left out, and kept as sorted arrays of 64-bit hashes. So it grows
with the distinct grams of five letters, not with the documents. A text gets the language of the lowest cross-entropy
per symbol.

Rejection is calibrated on a sample of training documents that the models have not seen. How far a text's cross-entropy
lies above the mean of its language, in standard deviations for a text of its length, is compared with theirs: its
tail share is the part of the sample that lies as far or further (beyond the sample an exponential tail goes on). The score
is a power of the tail share that is 1/2 at REJECTED; a text with less is rejected, so about that part of documents
like those learnt from is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from helixmill.llm.common import forget, own_names, prepare, trimmed, written

ORDER = 5
#: Labelled documents used to calibrate, and the most that they are of all; the part of such documents to be rejected.
CALIBRATION_DOCS, CALIBRATION_SHARE, REJECTED = 3_000, 0.2, 0.001
UNKNOWN = "und"
HELD_OUT = 2
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """By code point: the lower-cased letter, or 0."""
    global _letters
    if _letters is None:
        table = np.zeros(0x110000, np.uint32)
        for i in range(0x32000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _letters = table
    return _letters


#: Code points that are turned into grams at once.
SLICE = 1 << 19


def pieces(texts: list[str | None]) -> Iterator[tuple[list[tuple[str, int, bool]], list[int]]]:
    """All texts in groups of about SLICE code points: pieces, and the text each is of. A piece is code points, how many of them
    come first for context only, and whether its last word ends with it. A longer text is cut at a blank, or, where none
    comes within another SLICE, anywhere; then the next piece repeats what its first grams look back on."""
    group, owners, size = [], [], 0
    for i, t in enumerate(texts):
        t, at, lead = t or "", 0, 0
        while at < len(t):
            end = blank = len(t)
            if end - at > SLICE:
                blank = t.find(" ", at + SLICE, at + 2 * SLICE)
                end = blank if blank > 0 else min(end, at + 2 * SLICE)
            ends = end in (blank, len(t))
            group.append((t[at - lead : end], lead, ends))
            owners.append(i)
            size += end - at
            at, lead = end, 0 if ends else ORDER - 1
            if size >= SLICE:
                yield group, owners
                group, owners, size = [], [], 0
    if group:
        yield group, owners


def symbols(group: list[tuple[str, int, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of all pieces, each piece's words ended by a 0, the piece each symbol is of, and whether it counts (not if it
    is context, or a 0 that only keeps pieces apart)."""
    parts = [np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32) for t, _, _ in group]
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    points, counts = np.zeros(int(sizes.sum()), np.uint32), np.ones(int(sizes.sum()), bool)
    for a, p, (_, lead, ends) in zip((np.cumsum(sizes) - sizes).tolist(), parts, group):
        points[a : a + len(p)] = p
        counts[a : a + lead] = False
        counts[a + len(p)] = ends
    sym = letters()[np.minimum(points, 0x10FFFF)]
    keep = sym != 0
    keep[1:] |= sym[:-1] != 0  # of a run of boundaries the first, which ends a word
    keep[0] = sym[0] != 0
    return sym[keep], np.repeat(np.arange(len(parts), dtype=np.int32), sizes)[keep], counts[keep]


def grams(sym: np.ndarray) -> np.ndarray:
    """ORDER x n: the symbol last, before it those before it in its word, then 0."""
    out = np.zeros((ORDER, len(sym)), np.uint32)
    out[ORDER - 1] = sym
    alive = np.ones(len(sym), bool)
    for k in range(1, ORDER):
        if len(sym) > k:
            before = np.zeros(len(sym), np.uint32)
            before[k:] = sym[:-k]
            alive &= before != 0
            out[ORDER - 1 - k] = np.where(alive, before, 0)
    return out


def hashed(rows: np.ndarray, order: int) -> np.ndarray:
    """64-bit hashes of columns of symbols: of the last `order` rows."""
    h = np.full(rows.shape[1], order + 1, np.uint64)
    for r in rows[len(rows) - order :] if order else []:
        h = (h ^ r.astype(np.uint64)) * _FACTOR
        h ^= h >> np.uint64(29)
    return h


class Model:
    """Interpolated Kneser-Ney of one language: for each order sorted gram hashes with probabilities, and sorted context
    hashes with the weight of the lower order. rows: ORDER x n distinct grams; counts: how often each occurs."""

    def __init__(self, rows: np.ndarray, counts: np.ndarray):
        self.floor = 1.0 / (len(np.unique(rows[-1])) + 1)
        self.orders = []
        levels = []  # (rows, counts) of each order, from the highest
        for order in range(ORDER, 0, -1):
            levels.append((rows, counts, order))
            if order > 1:
                # a lower order counts what stands before it; at a word's start nothing varies there, so occurrences
                h, first, group = np.unique(hashed(rows, order - 1), return_index=True, return_inverse=True)
                left = np.bincount(group, minlength=len(h)).astype(np.float64)
                often = np.bincount(group, weights=counts, minlength=len(h))
                rows = rows[:, first]
                counts = np.where(rows[ORDER - order + 1] == 0, often, left) if order > 2 else left
        below: tuple | None = None
        for rows, counts, order in reversed(levels):
            context, group = np.unique(hashed(rows[:-1], order - 1), return_inverse=True)
            total = np.bincount(group, weights=counts)
            kinds = np.bincount(group).astype(np.float64)
            one, two = float((counts == 1).sum()), float((counts == 2).sum())
            discount = min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5
            weight = discount * kinds / total
            lower = np.full(len(counts), self.floor) if below is None else below[1][np.searchsorted(below[0], hashed(rows, order - 1))]
            p = np.maximum(counts - discount, 0) / total[group] + weight[group] * lower
            h = hashed(rows, order)
            by = np.argsort(h)
            below = (h[by], p[by])
            self.orders.append((h[by], p[by].astype(np.float32), context, weight.astype(np.float32)))

    def cost(self, rows: np.ndarray) -> np.ndarray:
        """-log p of each gram."""
        p = np.full(rows.shape[1], self.floor)
        for order, (known, probability, context, weight) in enumerate(self.orders, 1):
            h, c = hashed(rows, order), hashed(rows[:-1], order - 1)
            k = np.minimum(np.searchsorted(known, h), len(known) - 1)
            j = np.minimum(np.searchsorted(context, c), len(context) - 1)
            p = np.where(known[k] == h, probability[k], np.where(context[j] == c, weight[j], 1.0) * p)
        return -np.log(np.maximum(p, 1e-12))


def folded(docs: DataFrame) -> DataFrame:
    """docs' doc_id, text, lang and fold: crc32 of the doc_id as text, modulo 4 (null for a null doc_id)."""
    return docs.select("doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string")) % 4).alias("fold"))


def count_grams(training: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of training. A task sums up before it sends anything, so a frequent gram or
    language is one row a task."""
    prepare(training.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def merged(parts: list) -> tuple:
            h, rows, n = (np.concatenate([p[i] for p in parts], axis=-1) for i in range(3))
            code, distinct = pd.factorize(h)
            first = np.zeros(len(distinct), np.int64)
            first[code[::-1]] = np.arange(len(h) - 1, -1, -1)
            return distinct, rows[:, first], np.bincount(code, weights=n, minlength=len(distinct)).astype(np.int64)

        def out(lang: str, part: tuple) -> pa.RecordBatch:
            texts = np.ascontiguousarray(part[1].T.astype("<u4")).tobytes().decode("utf-32-le", "replace")
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(part[0])), pa.array([texts[i : i + ORDER] for i in range(0, len(texts), ORDER)]), pa.array(part[2])], ["lang", "gram", "n"])

        for b in batches:
            langs = b.column(1).to_pylist()
            texts = b.column(0).to_pylist()
            for lang in set(langs):
                for group, _ in pieces([t for t, x in zip(texts, langs) if x == lang]):
                    sym, _, counts = symbols(group)
                    rows = grams(sym)[:, counts]
                    if not rows.shape[1]:
                        continue
                    parts = held.setdefault(lang, [])
                    parts.append(merged([(hashed(rows, ORDER), rows, np.ones(rows.shape[1], np.int64))]))
                    if len(parts) > 8:
                        parts[:] = [merged(parts)]
                        if len(parts[0][0]) > 400_000:
                            yield out(lang, parts.pop())
        for lang, parts in held.items():
            if parts:
                yield out(lang, merged(parts))

    made = training.select("text", "lang").mapInArrow(lambda it: trimmed(run(it)), "lang string, gram string, n long")
    return made.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Identifier:
    """Models by language; for each the mean, standard deviation and variance a symbol of calibration texts; and the ascending
    deviations of all calibration texts."""

    def __init__(self, models: dict[str, Model], calibration: dict[str, tuple[float, float, float]] | None = None, tail: np.ndarray | None = None):
        self.languages = sorted(models)
        self.models = [models[x] for x in self.languages]
        self.calibration = calibration or {}
        self.tail = np.zeros(0) if tail is None else tail

    def deviations(self, best: np.ndarray, mean: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Standard deviations above the mean of language number `best`, for a text of n symbols."""
        mu, sd, one = np.array([self.calibration.get(x, (0.0, 1e9, 0.0)) for x in self.languages]).T[:, best]
        return (mean - mu) / np.maximum(np.sqrt(sd * sd + one / np.maximum(n, 1)), 1e-6)

    def scores(self, z: np.ndarray) -> np.ndarray:
        """The score of deviations: the tail share to the power that makes REJECTED 1/2; 1 without a calibration."""
        m = len(self.tail)
        if not m:
            return np.ones(len(z))
        share = (m - np.searchsorted(self.tail, z) + 1) / (m + 1)
        top = self.tail[-max(1, m // 50) :]
        beyond = np.maximum(z - top[-1], 0) / max(float((top - top[0]).mean()), 0.25)
        return (share * np.exp(-np.minimum(beyond, 500))) ** (np.log(2) / -np.log(REJECTED))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of each text, cross-entropies (text x language) and variances of the costs (text x language)."""
        n = np.zeros(len(texts))
        mean, spread = np.zeros((len(texts), len(self.models))), np.zeros((len(texts), len(self.models)))
        for group, owners in pieces(texts):
            sym, part, counts = symbols(group)
            if not counts.any():
                continue
            owner = np.array(owners)[part[counts]]
            n += np.bincount(owner, minlength=len(texts))
            rows = grams(sym)[:, counts]
            code, distinct = pd.factorize(hashed(rows, ORDER))
            first = np.zeros(len(distinct), np.int64)
            first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            rows = rows[:, first]
            for k, m in enumerate(self.models):
                cost = m.cost(rows)
                mean[:, k] += np.bincount(owner, cost[code], len(texts))
                spread[:, k] += np.bincount(owner, (cost * cost)[code], len(texts))
        each = np.maximum(n, 1)[:, None]
        mean /= each
        return n, mean, np.maximum(spread / each - mean**2, 0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n, mean, _ = self.entropies(texts)
        if not self.models:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best, k = mean.argmin(1), np.arange(len(texts))
        score = np.where(n > 0, self.scores(self.deviations(best, mean[k, best], n)), 0.0)
        return [self.languages[k] if m else UNKNOWN for k, m in zip(best.tolist(), n.tolist())], score


def for_calibration(n: int) -> Column:
    """Which of n training documents calibrate."""
    return F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5 <= min(CALIBRATION_SHARE, CALIBRATION_DOCS / max(n, 1))


def fit(docs: DataFrame) -> Identifier:
    """Learn from text and non-null lang of the documents that are not held out; documents with a null doc_id have no
    fold and teach nothing. No such documents: an identifier that knows no language."""
    training = folded(docs).where(f"fold <> {HELD_OUT} and lang is not null and text is not null")
    # a bounded sample of the training documents, by hash, is kept from the models to calibrate them
    sizes = {r.lang: r["count"] for r in training.groupBy("lang").count().collect()}
    sampled = for_calibration(sum(sizes.values()))
    models: dict[str, Model] = {}

    def learn(part: DataFrame) -> None:
        counted = written(count_grams(part), "grams")
        for r in counted.select("lang").distinct().orderBy("lang").collect():
            rows = counted.where(F.col("lang") == r.lang).select("gram", "n").orderBy("gram").toArrow()
            points = [np.frombuffer("".join(c.to_pylist()).encode("utf-32-le"), np.uint32) for c in rows["gram"].chunks]
            models[r.lang] = Model(np.ascontiguousarray(np.concatenate(points).reshape(-1, ORDER).T), rows["n"].to_numpy().astype(np.float64))
        forget(counted)

    learn(training.where(~sampled))
    if left := sorted(sizes.keys() - models.keys()):  # languages that only sampled documents have
        learn(training.where(F.col("lang").isin(left)))
    known = Identifier(models)
    if not models:
        return known
    shared = training.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, mean, spread = shared.value.entropies(b.column(0).to_pylist())
            i = np.flatnonzero(size > 0)
            best = mean[i].argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(best.astype(np.int32)), *(pa.array(x) for x in (mean[i, best], spread[i, best], size[i]))], ["best", "mean", "spread", "n"])

    seen = training.where(sampled).select("text").mapInArrow(lambda it: trimmed(run(it)), "best int, mean double, spread double, n double").toPandas()
    shared.destroy()
    measure = lambda t: (float(t["mean"].mean()), max(float(t["mean"].std(ddof=0)), 0.02), float(t["spread"].mean()))
    calibration = {}
    for k, lang in enumerate(known.languages):
        own = seen[seen["best"] == k]
        # the middle, so that a few odd documents don't widen the measure
        mid = own[own["mean"] <= own["mean"].quantile(0.95)] if len(own) >= 20 else own
        if len(mid) >= 5 or len(seen):
            calibration[lang] = measure(mid if len(mid) >= 5 else seen)
    known = Identifier(models, calibration)
    return Identifier(models, calibration, np.sort(known.deviations(seen["best"].to_numpy(), seen["mean"].to_numpy(), seen["n"].to_numpy())))


def _predicted(docs: DataFrame, known: Identifier, columns: list[str]) -> DataFrame:
    """`columns` of docs (any columns), then __hm_lang and __hm_score."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = shared.value.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score)], [*b.schema.names, "__hm_lang", "__hm_score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    picked = docs.select(*columns)
    return picked.mapInArrow(lambda it: trimmed(run(it)), StructType([*picked.schema.fields, StructField("__hm_lang", StringType()), StructField("__hm_score", DoubleType())]))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row. `und` with score 0 where the text is null or has no letter (or no
    language could be learnt); a null doc_id is not held out. Equal rows stay; an empty table gives no rows."""
    known = fit(docs)
    out = _predicted(docs.select("doc_id", "text"), known, ["doc_id", "text"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("__hm_lang").alias("lang_pred"), F.col("__hm_score").alias("score"))


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language is known and whose score is not below 1/2 (see the calibration), with their columns; a null
    lang becomes the predicted one. An empty table stays empty; rows with a null doc_id stay or go like any other."""
    columns, docs = docs.columns, own_names(docs, "doc_id", "text", "lang")
    out = _predicted(docs, fit(docs), docs.columns).where((F.col("__hm_lang") != UNKNOWN) & (F.col("__hm_score") >= 0.5))
    return out.select(*(F.coalesce("lang", "__hm_lang").alias("lang") if c == "lang" else F.col(c) for c in docs.columns)).toDF(*columns)
