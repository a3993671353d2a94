"""SentencePiece encoding and decoding by a Viterbi search over an Aho-Corasick automaton.

The automaton holds all pieces. One pass over the characters follows its output links, and each
piece that ends at a position relaxes the best score of a segmentation up to there. The score is
what SentencePiece defines for the kind of model. For a unigram model it is the sum of the pieces'
scores. The scores of a merge (BPE) model are merge priorities, and their sum means nothing: there,
the score is minus the number of seams that merging would not leave, where a seam between two
pieces is left if merging their characters by priority gives just these two. The segmentation that
merging itself gives is the only one of score 0. Characters that no piece covers become their
UTF-8 bytes.

No piece holds a space mark after another character, so a text falls apart before each run of space
marks, and each distinct part is searched once for as long as a worker remembers it.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches
from .words import by_bytes

SPACE = "▁"
#: What a character without a piece costs below the least score.
UNKNOWN_PENALTY = 10.0
#: Parts that a worker keeps with their ids, about 200 bytes each, and seams, about 100 each.
MEMO_PARTS, MEMO_SEAMS = 500_000, 300_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, raw[at : at + size]
        at += size


def is_merge_model(raw: bytes) -> bool:
    """Whether a model file's trainer section (field 2) has the model type (field 3) BPE (2)."""
    return any((3, 2) in _fields(value) for field, value in _fields(raw) if field == 2)


class Codec:
    """Encodes and decodes with the pieces and scores of a SentencePiece model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self._automaton, self._scores = ahocorasick.Automaton(), {}
        self.search = self.search_merges if is_merge_model(model.serialized_model_proto()) else self.search_sums
        self._bytes, self._unknown, least = [-1] * 256, model.unk_id(), 0.0
        raw: list[bytes] = []
        self._names = [model.id_to_piece(i) for i in range(n)]
        for i, piece in enumerate(self._names):
            if model.is_byte(i):
                self._bytes[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                raw.append(b" \xe2\x81\x87 " if model.is_unknown(i) else b"")
            else:
                raw.append(piece.replace(SPACE, " ").encode())
                score = model.get_score(i)
                least = min(least, score)
                self._scores[piece] = score
                self._automaton.add_word(piece, (i, len(piece), score))
        self._automaton.make_automaton()
        self._cost = least - UNKNOWN_PENALTY
        self._raw = raw
        self._flat = np.frombuffer(b"".join(raw), np.uint8)
        self._ends = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        if any(SPACE in p.lstrip(SPACE) for p in self._automaton.keys()):  # noqa: SIM118
            raise ValueError("a piece holds a space after another character")
        self._follows: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self._at: dict[str, int] = {}
        self._ids, self._bounds = array("i"), array("q", [0])
        if len(self._follows) > MEMO_SEAMS:
            self._follows.clear()

    def _merged(self, text: str) -> list[str]:
        """Characters merged by priority, the leftmost first of equal ones."""
        parts = list(text)
        while True:
            pairs = [(-self._scores[x], i) for i, x in enumerate(map(str.__add__, parts, parts[1:])) if x in self._scores]
            if not pairs:
                return parts
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _may_follow(self, before: int, piece: int) -> bool:
        """Whether merging leaves the two side by side; before is a piece, a character beyond the pieces, or -1 for none."""
        key = before * (len(self._raw) + 1) + piece
        if key not in self._follows:
            pair = [self._name(x) for x in (before, piece) if x != -1]
            self._follows[key] = self._merged("".join(pair)) == pair
        return self._follows[key]

    def _name(self, piece: int) -> str:
        return self._names[piece] if piece < len(self._raw) else chr(piece - len(self._raw))

    def search_merges(self, part: str) -> list[int]:
        """Ids of the segmentation of the best score: minus the number of its seams that merging would not leave.

        Each piece that ends at a position relaxes its score. No score is above 0, so a position that
        has reached it is settled; merging itself leaves all its seams, and no other segmentation does.
        """
        n, known, width = len(self._raw), self._follows.get, len(self._raw) + 1
        best, last, sizes, done = [0] + [-len(part) - 1] * len(part), [-1] * (len(part) + 1), [1] * (len(part) + 1), 0
        for end, (piece, size, _) in self._automaton.iter(part):
            while done < end:  # a character that no piece settles stands alone
                done += 1
                if best[done] < best[done - 1]:
                    best[done], last[done], sizes[done] = best[done - 1], n + ord(part[done - 1]), 1
            at = end + 1
            if best[at] == 0:
                continue
            before = last[at - size]
            fits = known(before * width + piece)
            if fits is None:
                fits = self._may_follow(before, piece)
            score = best[at - size] if fits else best[at - size] - 1
            if score > best[at]:
                best[at], last[at], sizes[at] = score, piece, size
        out: list[int] = []
        at = len(part)
        while at:
            piece = last[at]
            if 0 <= piece < n:
                out.append(piece)
            else:
                out.extend(reversed(self._bytes_of(part[at - 1])))
            at -= sizes[at]
        return out[::-1]

    def _bytes_of(self, char: str) -> list[int]:
        known = [self._bytes[b] for b in char.encode()]
        return known if -1 not in known else [self._unknown]

    def search_sums(self, part: str) -> list[int]:
        """Ids of the segmentation of the largest sum of scores; of equal ones, that whose last piece is the longest."""
        n = len(part)
        best, back = [0.0] + [-1e300] * n, [(self._unknown, 1)] * (n + 1)
        done = 0

        def settle(upto: int) -> None:
            nonlocal done
            while done < upto:
                score = best[done] + self._cost
                if score > best[done + 1]:
                    best[done + 1], back[done + 1] = score, (self._unknown, 1)
                done += 1

        for end, (piece, size, score) in self._automaton.iter(part):
            settle(end)
            score += best[end + 1 - size]
            if score > best[end + 1]:
                best[end + 1], back[end + 1] = score, (piece, size)
        settle(n)
        out: list[int] = []
        while n:
            piece, size = back[n]
            out.extend(reversed(self._bytes_of(part[n - 1])) if piece == self._unknown else [piece])
            n -= size
        return out[::-1]

    def _learn(self, parts: list[str]) -> None:
        for p in parts:
            if p not in self._at:
                self._at[p] = len(self._bounds) - 1
                self._ids.extend(self.search(p))
                self._bounds.append(len(self._ids))

    def _known(self, parts: list[str]) -> list[int]:
        self._learn(parts)
        return [i for p in parts for i in self._ids[self._bounds[self._at[p]] : self._bounds[self._at[p] + 1]]]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of whole texts; none for null and empty ones."""
        texts = pc.fill_null(texts, "")
        if len(self._at) > MEMO_PARTS:
            self.forget()
        # spaces in a row, a space in front and the mark itself change where a text falls apart
        odd = pc.or_(pc.starts_with(texts, " "), pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE))).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        parts = [SPACE + w for w in coded.dictionary.to_pylist()]
        self._learn(parts)
        rows = np.fromiter(map(self._at.__getitem__, parts), np.int64, len(parts))
        bounds = np.array(self._bounds, np.int64)
        first, sizes = bounds[rows], bounds[rows + 1] - bounds[rows]
        which = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(sizes[which])))
        table = np.array(self._ids, np.int32)
        ids = table[np.repeat(first[which] - ends[:-1], sizes[which]) + np.arange(ends[-1])]
        cuts = ends[at - at[0]]
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd | empty):
            marked = (SPACE + texts[int(i)].as_py()).replace(" ", SPACE) if not empty[i] else ""
            out[i] = np.array(self._known(re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", marked)), np.int32)
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of all pieces in turn, spaces for their marks, without the space that encoding puts first."""
        sizes = np.diff(self._ends)[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        raw = self._flat[np.repeat(self._ends[ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        return raw[1:] if raw.startswith(b" ") else raw

    def decode(self, ids: np.ndarray) -> str:
        """The text; bytes that are no UTF-8 become replacement characters."""
        return self.decode_bytes(np.asarray(ids, np.int64)).decode(errors="replace")


@functools.cache
def _codec(path: str) -> Codec:
    """A worker's codec outlives its tasks."""
    return Codec(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids, round_trip): the ids of every whole text.

    model: the place of the model file on every machine. round_trip says whether decoding the ids
    gives the text again, which fails only for a text that holds the space mark itself, as that is
    decoded as a space. Null and empty texts have no ids. Rows that repeat an id are encoded each;
    null ids are returned; an empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in by_bytes(batches, 2 << 20):
            ids = codec.encode(batch.column(1))
            sizes = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate([*ids, np.zeros(0, np.int32)])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat, pa.int32()))
            raw = pc.fill_null(batch.column(1), "").cast(pa.binary()).to_pylist()
            same = pa.array([codec.decode_bytes(x) == r for x, r in zip(ids, raw, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), lists, same], ["id", "n_tokens", "ids", "round_trip"])
        codec.forget()  # a worker does other work as well

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids array<int>, round_trip boolean").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, model: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id_col, text): the texts of id lists. Null lists give null; null ids within a list are passed over."""
    bounded_batches(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array([i for i in x if i is not None], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
