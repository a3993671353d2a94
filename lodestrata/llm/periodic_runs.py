"""Runs of words that repeat a sequence four times or more, and texts with each run collapsed to its first sequence.

For every period q up to a quarter of a text, the text is probed at the points of a grid of step 2q,
which makes about n log n / 2 pairs of a period and a point in all (a harmonic sum). Prefix hashes of
the words tell for all pairs at once whether the q words at a point come again q words later, which
must be so at some point of the grid in every run. From there the longest common extensions to both
sides are found by binary search over the hashes, for all pairs at once. The runs found are held
against the words themselves, and of equal stretches the one of the smallest period stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches
from .words import by_bytes

#: Words of a run at least, and times that it repeats its period at least.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Bytes of text that a worker looks at together, and pairs of a period and a point at once.
BATCH_BYTES, PAIRS = 2 << 20, 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class _Words:
    """The words of many texts, end to end, with prefix hashes.

    ids: equal for equal words; at: where each text's words begin, and the end; read: the least
    period of each stretch (start, end) that has been held against the words.
    """

    def __init__(self, ids: np.ndarray, at: np.ndarray) -> None:
        self.ids, self.at, self.read = ids, at, {}
        values = np.random.default_rng(13).integers(1, 1 << 63, int(ids.max(initial=0)) + 1, dtype=np.uint64)
        self.powers = np.ones(len(ids) + 1, np.uint64)
        np.multiply.accumulate(np.full(len(ids), _BASE), out=self.powers[1:])
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(values[ids] * self.powers[:-1], out=self.sums[1:])

    def again(self, g: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from g on have the hash of those q words later."""
        return (self.sums[g + n] - self.sums[g]) * self.powers[q] == self.sums[g + q + n] - self.sums[g + q]

    def reach(self, g: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words, up to most, from g on (back: before g) equal those q words later, by their hashes."""
        low, high = np.zeros_like(g), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            n = (low[open_] + high[open_] + 1) // 2
            equal = self.again(g[open_] - n if back else g[open_], q[open_], n)
            low[open_] = np.where(equal, n, low[open_])
            high[open_] = np.where(equal, high[open_], n - 1)
        return low

    def exact(self, g: int, q: int, first: int, last: int) -> tuple[int, int]:
        """The stretch around g whose words equal those q words later, read word by word."""
        equal = self.ids[first : last - q] == self.ids[first + q : last]
        other = np.flatnonzero(~equal)
        k = np.searchsorted(other, g - first)
        if not equal[g - first]:
            return g, g
        start = first + (other[k - 1] + 1 if k else 0)
        return int(start), int(first + (other[k] if k < len(other) else len(equal)) + q)


def _points(words: _Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(g, q, text): points of the grid at which the next q words come again, in chunks; the points of one text and period are together."""
    sizes = np.diff(words.at)
    periods = np.where(sizes >= LEAST_WORDS, sizes // LEAST_TIMES, 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = sizes[text] // (2 * q)
    ends = np.cumsum(points)
    begin = 0
    while begin < len(q):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        number = points[begin:end]
        which = np.repeat(np.arange(begin, end), number)
        step = np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)
        g = words.at[text[which]] + 2 * q[which] * step
        hit = words.again(g, q[which], q[which])
        if hit.any():
            yield g[hit], q[which[hit]], text[which[hit]]
        begin = end


def _stretches(words: _Words, g: np.ndarray, q: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Rows (start, end, q) of the stretches of period q around points, once for all points that one holds."""
    found = []
    while len(g):
        # a point goes by the one before it if the words between come again too, as both then lie in one stretch
        next_ = np.zeros(len(g), bool)
        next_[1:] = (text[1:] == text[:-1]) & (q[1:] == q[:-1])
        next_[next_] = words.again(g[:-1][next_[1:]], q[next_], g[next_] - g[:-1][next_[1:]])
        lead = ~next_
        point, period, of = g[lead], q[lead], text[lead]
        start = point - words.reach(point, period, point - words.at[of], back=True)
        end = point + period + words.reach(point, period, words.at[of + 1] - point - period, back=False)
        rows = np.column_stack([start, end, period])
        for i in _unlike(words, rows):  # two sequences of words with one hash
            rows[i, :2] = words.exact(int(point[i]), int(period[i]), int(words.at[of[i]]), int(words.at[of[i] + 1]))
        found.append(rows)
        # points whose hashes agree with the one before them, but which its stretch does not hold, go on by themselves
        by = np.cumsum(lead) - 1
        left = next_ & (g + q > rows[by, 1] - 1)
        g, q, text = g[left], q[left], text[left]
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def _unlike(words: _Words, rows: np.ndarray) -> list[int]:
    """Numbers of the rows (start, end, q), if long enough for runs, whose words do not have the period q, read word by word.

    Hashes never make a stretch too short. One that was read with a period has its multiples as
    well, and is not read again for them; periods come in rising order.
    """
    long = rows[:, 1] - rows[:, 0] >= np.maximum(LEAST_WORDS, LEAST_TIMES * rows[:, 2])
    wrong = []
    for i in np.flatnonzero(long).tolist():
        s, e, q = rows[i].tolist()
        if q % words.read.get((s, e), q + 1) and not np.array_equal(words.ids[s : e - q], words.ids[s + q : e]):
            wrong.append(i)
        else:
            words.read.setdefault((s, e), q)
    return wrong


def find(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows (start, end, period), by start and period, of all runs in the texts whose words are ids[at[k]:at[k + 1]]."""
    words = _Words(ids, at)
    found = [_stretches(words, *chunk) for chunk in _points(words)]
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    length = rows[:, 1] - rows[:, 0]
    rows = rows[length >= np.maximum(LEAST_WORDS, LEAST_TIMES * rows[:, 2])]
    # a stretch of several periods four times over has the least of them as a divisor of the others
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """ids of all words, where each text's begin, and the words by id."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    at = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False)
    real = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[ids] if len(ids) else np.zeros(0, bool)
    return ids[real], np.concatenate(([0], np.cumsum(real)))[at - at[0]], coded.dictionary


def _collapsed(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Per text: number of words, runs, and the words that stay, joined by spaces."""
    ids, at, names = _split(texts)
    rows = find(ids, at)
    of = np.searchsorted(at, rows[:, 0], "right") - 1
    fields = [rows[:, 0] - at[of], rows[:, 1] - rows[:, 0], rows[:, 2]]
    structs = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in fields], ["start", "length", "period"])
    each = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(texts))))).astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(each), structs)
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, rows[:, 0] + rows[:, 2], 1)
    np.add.at(edges, rows[:, 1], -1)
    kept = np.cumsum(edges[:-1]) == 0
    offsets = np.concatenate(([0], np.cumsum(kept)))[at].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), names.take(pa.array(ids[kept])))
    return pa.array(np.diff(at)), runs, pc.binary_join(lists, " ")


def collapse(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, n_words, runs, collapsed) of every whole text.

    Words are what ASCII white space separates, as they are written. runs are all stretches of at
    least LEAST_WORDS words and LEAST_TIMES times their smallest period that no neighbouring word
    extends, by start (a word number from 0) and period. collapsed joins by a space the words that
    no run holds after its first period. A null or empty text, or one of white space, has no words,
    no runs and an empty collapsed text. Runs may overlap; one that is another's part with another
    period counts by itself. Rows that repeat an id, null ones too, are handled each; an empty table
    gives no rows; other columns are ignored. A worker holds some hundred bytes for each word of the
    texts before it, BATCH_BYTES of them or one whole text.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), *_collapsed(batch.column(1))], ["id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_words bigint, runs {RUNS}, collapsed string").withColumnRenamed("id", id_col)
