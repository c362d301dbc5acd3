"""SentencePiece encoding and decoding of merge-type (BPE) models with byte fallback (operator 12).

The encoding of a text's prefix ends in one token only. A table keeps that token for every prefix: an automaton over all
pieces names those that end at a place, and of these exactly one is right, the one that is compatible with the last token of
what stands before it. Two tokens are compatible if merging their joined characters yields just these two; a sequence is
the encoding if all its neighbours are compatible. From the last prefix the tokens are read off backwards. The work is linear
in the text, whatever its words are.

Compatibility is decided by undoing merges: of the two tokens' inner edges, the one merged later is taken apart, and
if the pieces that then meet would have merged before that, the two are not compatible. This needs models in which no piece is
made of pieces of a worse score, which is checked on loading.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from helixmill.llm.common import prepare

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Limits of what is remembered of words, and the characters of a text that are cut into words at a time; no result depends on them.
KEPT_LENGTH, KEPT_WORDS, STRETCH = 40, 600_000, 1 << 16
EDGE = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")
_codecs: dict[str, "MergePieces"] = {}


class MergePieces:
    """Encoder of one model file. Raises ValueError for models that it can't encode exactly: other types than BPE, no byte
    fallback, pieces defined by the user or unused, or pieces made of worse ones."""

    def __init__(self, model_file: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("only merge-type models with byte fallback")
        if {p.type for p in model.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("no pieces that are unused or defined by the user")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if {c for p in self.ids for c in p} - self.ids.keys():
            raise ValueError("every character of a piece must be a piece")
        self.text = [p.piece for p in model.pieces]
        self.size = [len(p) for p in self.text]
        order = {s: k for k, s in enumerate(sorted({p.score for p in model.pieces if p.type == NORMAL}, reverse=True))}
        #: Earlier merges have smaller ranks; characters are there from the start.
        self.rank = [-1 if len(p.piece) == 1 else order.get(p.score, -1) for p in model.pieces]
        self.parts: list[tuple[int, int] | None] = [None] * len(self.text)
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) > 1:
                self.parts[i] = self._last_merge(piece)
            if len(piece) == 1 or self.parts[i]:  # others never come out of merging
                self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        if any(parts and max(self.rank[p] for p in parts) > self.rank[i] for i, parts in enumerate(self.parts)):
            raise ValueError("a piece is made of pieces of a worse score")
        self.shift = len(self.text).bit_length()
        self.compatible = _Pairs(self)
        self.kept = _Words(self)
        #: Spaces begin a word.
        self.apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.words = re.compile(self._word_pattern()).findall

    def _word_pattern(self) -> str:
        """Words that can be encoded singly, as no piece runs from one into the next: spaces and then characters that pieces
        join, directly or through others. The whole text, if a piece runs from another character into a space."""
        if not self.apart:
            return "(?s).+"
        kind: dict[str, set[str]] = {}
        joined = set()
        for piece in self.ids:
            chars = piece.lstrip(SPACE)
            for c in chars:
                kind.setdefault(c, {c})
            for c, d in zip(chars, chars[1:]):
                joined |= {c, d}
                if kind[c] is not kind[d]:
                    small, large = sorted((kind[c], kind[d]), key=len)
                    large |= small
                    for x in small:
                        kind[x] = large
        kinds = {id(kind[c]): kind[c] for c in joined}.values()
        return f"(?s){SPACE}*(?:" + "|".join(f"[{re.escape(''.join(sorted(k)))}]+" for k in sorted(kinds, key=len, reverse=True)) + f"|[^{SPACE}])|{SPACE}+"

    def _last_merge(self, piece: str) -> tuple[int, int] | None:
        """The two tokens that merge into the piece in the end; None if its characters end up otherwise."""
        now, last = [self.ids[c] for c in piece], None
        while len(now) > 1:
            made = [self.ids.get(self.text[a] + self.text[b]) for a, b in zip(now, now[1:])]
            found = [(self.rank[m], k) for k, m in enumerate(made) if m is not None]
            if not found:
                return None
            k = min(found)[1]
            last = now[k], now[k + 1]
            now[k : k + 2] = [made[k]]
        return last

    def are_compatible(self, left: int, right: int) -> bool:
        """Whether merging the characters of both gives just these two tokens."""
        text, rank, parts, ids = self.text, self.rank, self.parts, self.ids
        if text[left] + text[right] in ids:
            return False
        while parts[left] or parts[right]:
            # of equal ranks the left one is merged first, so the right one is undone first
            undone = rank[left] if rank[left] > rank[right] else rank[right]
            of_left = rank[left] > rank[right]
            if of_left:
                left = parts[left][1]
            else:
                right = parts[right][0]
            crossing = ids.get(text[left] + text[right])
            if crossing is not None and (rank[crossing] < undone or rank[crossing] == undone and not of_left):
                return False
        return True

    def word(self, word: str) -> tuple[int, ...]:
        """Token ids of a normalized text, by the table of its prefixes' last tokens."""
        last, size, compatible, shift = [-1] * len(word), self.size, self.compatible, self.shift
        for end, token in self.automaton.iter(word):
            if last[end] < 0:
                before = end - size[token]
                if before < 0 or (p := last[before]) < 0 or compatible[p << shift | token]:
                    last[end] = token
        ids, at = [], len(word) - 1
        while at >= 0:
            token = last[at]
            if token < 0:  # a character of no piece: nothing merges with it
                ids += [self.byte_ids[b] for b in reversed(word[at].encode())]
                at -= 1
            else:
                ids.append(token)
                at -= size[token]
        return tuple(reversed(ids))

    def encode(self, text: str | None) -> list[int]:
        ids, at, text = [], 0, self.library.normalize(text) if text else ""
        while at < len(text):
            edge = self.apart and EDGE.search(text, at + STRETCH)
            end = edge.start() if edge else len(text)
            ids += chain.from_iterable(map(self.kept.__getitem__, self.words(text, at, end)))
            at = end
        return ids

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


class _Pairs(dict):
    """Compatibility by left << shift | right, decided when first asked for; at most 2^20 pairs are remembered."""

    def __init__(self, codec: MergePieces):
        super().__init__()
        self.codec = codec

    def __missing__(self, key: int) -> bool:
        if len(self) >= 1 << 20:
            self.clear()
        shift = self.codec.shift
        found = self[key] = self.codec.are_compatible(key >> shift, key & (1 << shift) - 1)
        return found


class _Words(dict):
    """Token ids by word. Words of up to KEPT_LENGTH characters are remembered; at KEPT_WORDS all are forgotten."""

    def __init__(self, codec: MergePieces):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self.codec.word(word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = found
        return found


def codec(model_file: str) -> MergePieces:
    """One codec a process: its tables take a second to build."""
    if model_file not in _codecs:
        _codecs[model_file] = MergePieces(model_file)
    return _codecs[model_file]


def encode(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """docs' doc_id and `ids` array<int>, without begin and end ids. A null or empty text has no ids. Rows that repeat, null
    doc_ids and further columns make no difference; an empty table gives an empty result."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(model_file)
        for b in batches:
            ids = pa.array([pieces.encode(x.as_py()) for x in b.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id and `text` of rows with `ids` (null: empty text)."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(model_file)
        for b in batches:
            texts = pa.array([pieces.decode(x.as_py() or []) for x in b.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_file: str) -> DataFrame:
    """encode() and decode() of each text in one pass, as digests: doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by
    commas), decoded_sha256. Cases as in encode(). The ids never leave the worker, so nothing is shuffled and a batch holds
    one text's ids at a time."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(model_file)
        said = [str(i) for i in range(len(pieces.text))].__getitem__
        for b in batches:
            rows = []
            for x in b.column(1):
                ids = pieces.encode(x.as_py())
                rows.append((len(ids), hashlib.sha256(",".join(map(said, ids)).encode()).hexdigest(), hashlib.sha256(pieces.decode(ids).encode()).hexdigest()))
            n, a, d = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
