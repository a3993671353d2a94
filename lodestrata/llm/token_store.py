"""Token ids in binary shard files with keyed access through a minimal perfect hash index.

A shard file holds the raw ids of its documents in ascending key order, and these sections after
them: where each document starts, its key, and the index. The index hashes a key to a bucket, whose
displacement sends it to one of exactly as many slots as there are distinct keys; the slot has the
document's row and a 32-bit fingerprint of the key, which turns away nearly all keys that are not there.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import bounded_batches, materialise, new_path
from .words import by_bytes, mix

MAGIC = b"LSTOK\x00\x00\x01"
#: magic, bytes of an id, documents, documents with a null key, distinct keys, ids, buckets
HEADER = struct.Struct("<8sIQQQQQ")
#: Words that a worker keeps with their ids, about 200 bytes each.
MEMO_WORDS = 1_200_000
#: Bytes of text that a task writes, and ids and documents at which a file ends whatever their keys.
TASK_BYTES, SHARD_IDS, SHARD_DOCS = 256 << 20, 8_000_000, 1_000_000
#: While all of it is less than a full load of every core, tasks are smaller, down to this many bytes.
LEAST_BYTES = 8 << 20
#: Files whose key ranges one search holds (about 150 bytes each with their names); more are searched in turns.
SEARCHED_FILES = 200_000
#: Marks at a word's end that a vocabulary may split off.
MARKS = ".,;:!?"
_KEY, _MARK = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


class Encoder:
    """Ids of whole texts by the tokenizers library.

    by_word: for vocabularies that drop white space and never join across it, the ids of a text are
    those of its words in turn, and a word is encoded once for as long as a worker remembers it.
    Where the vocabulary also splits off marks at a word's end and folds A-Z, which is tried first,
    `Word,` is looked up as `word` and `,`. Otherwise texts are encoded as they are.
    """

    def __init__(self, path: str, by_word: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._encoder, self._by_word = Tokenizer.from_file(path), by_word
        one = lambda x: self._encode([x])[0]
        self._folds = all(one(f"Ab{m}") == one("ab") + one(m) for m in [*MARKS, MARKS])
        mark = json.loads(self._encoder.to_str())["model"].get("end_of_word_suffix")
        names = self._encoder.get_vocab(with_added_tokens=True)
        self._last = np.zeros(max(names.values()) + 1, bool)
        self._last[[i for x, i in names.items() if mark and x.endswith(mark)]] = True
        self._forget()

    def _forget(self) -> None:
        self._at: dict[str, int] = {"": 0}
        self._ids, self._bounds = array("I"), array("q", [0, 0])

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._encoder.encode_batch_fast(texts, add_special_tokens=False)]

    def _put(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        start = len(self._bounds) - 1
        self._at.update(zip(words, range(start, start + len(words)), strict=True))
        self._bounds.frombytes((self._bounds[-1] + np.cumsum(sizes, dtype=np.int64)).tobytes())
        self._ids.frombytes(ids.astype(np.uint32).tobytes())

    def _put_each(self, words: list[str]) -> None:
        ids = self._encode(words)
        self._put(words, np.fromiter(itertools.chain.from_iterable(ids), np.uint32), np.array([len(x) for x in ids], np.int64))

    def _put_joined(self, words: list[str]) -> None:
        """Words of letters, many to a text: where the vocabulary marks the last id of a word, the ids fall apart again."""
        for i in range(0, len(words), 20_000):
            parts = [words[k : k + 500] for k in range(i, min(i + 20_000, len(words)), 500)]
            for part, e in zip(parts, self._encoder.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                ends = np.flatnonzero(self._last[ids]) + 1
                if len(ends) == len(part) and ends[-1] == len(ids):
                    self._put(part, ids, np.diff(ends, prepend=0))
                else:
                    self._put_each(part)

    def _learn(self, words: list[str]) -> None:
        """Remembers words that are not known yet."""
        parts: dict[str, tuple[str, str]] = {}
        plain: dict[str, None] = {}
        for w in words:
            core = w.rstrip(MARKS) if self._folds else ""
            low = core.lower()
            if low != w and core.isascii() and core.isalnum():
                parts[w] = (low, w[len(core) :])
                plain[low] = None
                plain[w[len(core) :]] = None
            else:
                plain[w] = None
        fresh = [w for w in plain if w not in self._at]
        letters = [w for w in fresh if w.isalpha()]
        self._put_joined(letters)
        self._put_each([w for w in fresh if not w.isalpha()])
        known = lambda w: self._ids[self._bounds[self._at[w]] : self._bounds[self._at[w] + 1]] if w else array("I")
        joined = [known(a) + known(b) for a, b in parts.values()]
        self._put(list(parts), np.frombuffer(b"".join(joined), np.uint32), np.array([len(x) for x in joined], np.int64))

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        if not self._by_word:
            return [np.array(x, np.uint32) for x in self._encode(texts.to_pylist())]
        lists = pc.ascii_split_whitespace(texts)
        at = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if not words:
            return [np.zeros(0, np.uint32)] * len(texts)
        if len(self._at) > MEMO_WORDS:
            self._forget()
        self._learn([w for w in words if w not in self._at])
        rows = np.fromiter(map(self._at.__getitem__, words), np.int64, len(words))
        bounds = np.array(self._bounds, np.int64)
        first, sizes = bounds[rows], bounds[rows + 1] - bounds[rows]
        which = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(sizes[which])))
        table = np.array(self._ids, np.uint32)
        ids = table[np.repeat(first[which] - ends[:-1], sizes[which]) + np.arange(ends[-1])]
        cuts = ends[at - at[0]]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@functools.cache
def _encoder(path: str, by_word: bool) -> Encoder:
    """A worker's encoder outlives its tasks."""
    return Encoder(path, by_word)


def _hashed(keys: np.ndarray, salt: np.uint64) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) + salt)


def _slots(hashes: np.ndarray, displaced: np.ndarray, n: int) -> np.ndarray:
    return mix(hashes ^ mix(displaced.astype(np.uint64))) % np.uint64(max(n, 1))


def _slot_of(hashes: np.ndarray, displacements: np.ndarray, n: int) -> np.ndarray:
    d = displacements.astype(np.int64)
    return np.where(d < 0, -1 - d, _slots(hashes, np.maximum(d, 0), n).astype(np.int64))


@dataclass
class PerfectHash:
    """Distinct keys to 0 .. n-1. A bucket of one key stores its slot itself, as a negative displacement."""

    displacements: np.ndarray
    n: int

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        buckets = -(-n // 3)
        hashes = _hashed(keys, _KEY)
        bucket = (hashes % np.uint64(max(buckets, 1))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=buckets)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        displacements, taken = np.zeros(buckets, np.int64), np.zeros(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            own = hashes[order[starts[b] : starts[b + 1]]]
            if len(own) < 2:
                break
            first = 0
            while True:
                tries = np.arange(first, first + 64)
                at = np.sort(_slots(own[None, :], tries[:, None], n).astype(np.int64), axis=1)
                good = ~taken[at].any(axis=1) & (np.diff(at, axis=1) != 0).all(axis=1)
                if good.any():
                    hit = int(np.argmax(good))
                    displacements[b], first = tries[hit], -1
                    taken[at[hit]] = True
                    break
                first += 64
        alone = np.flatnonzero(sizes == 1)
        displacements[alone] = -1 - np.flatnonzero(~taken)[: len(alone)]
        return cls(displacements, n)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key; one that was not indexed gets any."""
        if not self.n:
            return np.full(len(keys), -1, np.int64)
        hashes = _hashed(keys, _KEY)
        return _slot_of(hashes, self.displacements[(hashes % np.uint64(len(self.displacements))).astype(np.int64)], self.n)


def _prints(keys: np.ndarray) -> np.ndarray:
    return (_hashed(keys, _MARK) >> np.uint64(32)).astype(np.uint32)


def shard_bytes(keys: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    """The file of documents in ascending key order, nulls first. Rows may repeat a key: the index leads to the first.

    After the header, in this order: where each row's ids start (and the last end), each row's key,
    the displacement of each bucket, the fingerprint and the row of each slot, and the ids.
    """
    nulls = sum(k is None for k in keys)
    real = np.array([k for k in keys if k is not None], np.int64)
    distinct, rows = np.unique(real, return_index=True)
    index = PerfectHash.of(distinct)
    at = index.slot(distinct)
    prints, lead = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.uint32)
    prints[at], lead[at] = _prints(distinct), rows + nulls
    payload = np.concatenate(ids).astype(f"<u{width}") if ids else np.zeros(0, f"<u{width}")
    starts = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype("<u8")
    stored = np.concatenate((np.zeros(nulls, np.int64), real)).astype("<i8")
    head = HEADER.pack(MAGIC, width, len(keys), nulls, len(distinct), len(payload), len(index.displacements))
    return b"".join([head, *(x.tobytes() for x in (starts, stored, index.displacements.astype("<i8"), prints, lead, payload))])


class Shard:
    """A shard file, of which only what is asked for is read."""

    def __init__(self, source) -> None:
        """source: a seekable file."""
        self._source = source
        self.bytes_read = 0
        magic, self._width, self.n, self.nulls, self.distinct, self.total, self._buckets = HEADER.unpack(self._part(0, HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self._at = list(itertools.accumulate((HEADER.size, 8 * (self.n + 1), 8 * self.n, 8 * self._buckets, 4 * self.distinct, 4 * self.distinct)))

    def _part(self, at: int, size: int) -> bytes:
        self.bytes_read += size
        self._source.seek(at)
        return self._source.read(size)

    def _section(self, k: int, kind: str, first: int, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.frombuffer(self._part(self._at[k] + first * size, n * size), kind)

    def find(self, key: int) -> np.ndarray | None:
        """The ids of a key's first row, by the index: the same few reads however large the file is."""
        if not self.distinct:
            return None
        one = np.array([key], np.int64)
        bucket = int(_hashed(one, _KEY)[0] % np.uint64(self._buckets))
        slot = int(_slot_of(_hashed(one, _KEY), self._section(2, "<i8", bucket, 1), self.distinct)[0])
        if self._section(3, "<u4", slot, 1)[0] != _prints(one)[0]:
            return None
        row = int(self._section(4, "<u4", slot, 1)[0])
        return self.ids(row, 1)[1] if self._section(1, "<i8", row, 1)[0] == key else None

    def rows_in_key_order(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows and their keys: the null ones, then each distinct key's rows from the one that the index leads to."""
        stored = self._section(1, "<i8", 0, self.n)
        keys, times = np.unique(stored[self.nulls :], return_counts=True)
        index = PerfectHash(self._section(2, "<i8", 0, self._buckets), self.distinct)
        at = index.slot(keys)
        prints, lead = (self._section(k, "<u4", 0, self.distinct)[at] for k in (3, 4))
        if (prints != _prints(keys)).any():
            raise ValueError("the index does not know its keys")
        ends = np.cumsum(times)
        rows = np.repeat(lead.astype(np.int64) - (ends - times), times) + np.arange(len(stored) - self.nulls)
        return np.concatenate([np.arange(self.nulls), rows]), np.concatenate([stored[: self.nulls], np.repeat(keys, times)])

    def starts(self) -> np.ndarray:
        return self._section(0, "<u8", 0, self.n + 1).astype(np.int64)

    def ids(self, row: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends, and ids, of n rows."""
        starts = self._section(0, "<u8", row, n + 1).astype(np.int64)
        return starts, self._section(5, f"<u{self._width}", int(starts[0]), int(starts[-1] - starts[0])).astype("<u4")


def write(
    docs: DataFrame, vocabulary: str, end_id: int, by_word: bool, id_col: str = "doc_id", text: str = "text", path: str | None = None
) -> DataFrame:
    """Encodes whole texts, each followed by end_id, and writes them as shard files in ascending id order.

    Returns one row for each file, in order. Each attempt of a task writes files of its own, and
    only those of the attempt that succeeded are in the returned table, so lost executors and
    repeated tasks do no harm. Rows of one id, null too, are dealt to as many tasks and files as
    they need: they lie in the order of their texts' hashes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path, width = path or new_path(spark, "shards"), 2 if max(vocabulary_size(vocabulary), end_id + 1) <= 1 << 16 else 4
    fields = [("partition", pa.int32()), ("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part, held, encoder = TaskContext.get(), 0, 0, _encoder(vocabulary, by_word)
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        keys: list[int | None] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            name = f"shard-{task.partitionId():06d}-{part:04d}-{task.taskAttemptId()}.bin"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(shard_bytes(keys, ids, width))
            real = [k for k in keys if k is not None]
            row = [task.partitionId(), part, f"{path}/{name}", len(keys), sum(map(len, ids)), min(real, default=None), max(real, default=None)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip(row, fields, strict=True)], [n for n, _ in fields])

        for batch in by_bytes(batches, 12 << 20):
            for k, x in zip(batch.column(0).to_pylist(), encoder(batch.column(1)), strict=True):
                if keys and (held >= SHARD_IDS or len(keys) >= SHARD_DOCS):
                    yield flush()
                    part, held = part + 1, 0
                    keys.clear()
                    ids.clear()
                keys.append(k)
                ids.append(np.append(x, np.uint32(end_id)).astype(f"<u{width}"))
                held += len(x) + 1
        if keys:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    # the last key tells copies of one row apart, so that no id or text is too much for one task
    order = ["id", "mark", "copy"]
    rows = rows.withColumn("mark", F.xxhash64("text")).withColumn("copy", F.monotonically_increasing_id())
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0] or 0
    parts = max(1, -(-size // TASK_BYTES), min(2 * spark.sparkContext.defaultParallelism, -(-size // LEAST_BYTES)))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "text")
    schema = "partition int, part int, file string, n_docs long, n_ids long, first long, last long"
    files = materialise(ordered.mapInArrow(put, schema), "files")
    return materialise(_with_starts(files), "manifest")


def _with_starts(files: DataFrame) -> DataFrame:
    """files with `before`, the ids of all files before, summed in two levels: within a thousand partitions, and over the thousands."""
    grouped = files.withColumn("thousand", F.floor(F.col("partition") / 1000))
    within = Window.partitionBy("thousand").orderBy("partition", "part").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("thousand").rowsBetween(Window.unboundedPreceding, -1)
    sums = grouped.groupBy("thousand").agg(F.sum("n_ids").alias("n")).select("thousand", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    inner = grouped.withColumn("inner", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    return inner.join(sums, "thousand").withColumn("before", F.col("inner") + F.col("base")).drop("thousand", "inner", "base")


def open_shard(file: str) -> Shard:
    store, at = fs.FileSystem.from_uri(file)
    return Shard(store.open_input_file(at))


def read(files: DataFrame, shards: int) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, read from the files by way of their indexes.

    Each distinct key's row is the one that the index leads to. Rows that repeat a key follow the
    first, and rows with a null key, which no index holds, are the first of a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = open_shard(file)
                rows, keys = shard.rows_in_key_order()
                starts, ids = shard.ids(0, shard.n)
                first, n = starts[rows], starts[rows + 1] - starts[rows]
                sums = [zlib.crc32(ids[a : a + k]) for a, k in zip(first.tolist(), n.tolist(), strict=True)]
                null = np.arange(len(keys)) < shard.nulls
                columns = [pa.array(keys, mask=null), pa.array(first + before), pa.array(n), pa.array(sums, pa.int64())]
                for k in range(0, len(keys), 65_536):
                    yield pa.RecordBatch.from_arrays([c.slice(k, 65_536) for c in columns], ["id", "start", "n_tokens", "ids_crc32"])

    dealt = files.select("file", "before").repartition(max(1, shards), "file")
    return dealt.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def lookup(files: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """(id, ids) of the keys that are stored, by way of the index of the file whose key range holds them.

    The file of a key is found by a search in the files' sorted key ranges, SEARCHED_FILES at a time, and of the file only the header, the key's index entry and its ids are read.
    Null keys and absent ones give no rows; a key that is asked twice or stored twice gives its first ids for each asking.
    """
    asked = keys.select(F.col(key).cast("long").alias("id")).where("id is not null")
    # a key's rows may run over several files; ranges whose last key is that of a range before hold nothing new
    ranges = files.where("last is not null").groupBy("last").agg(F.min(F.struct("partition", "part", "file")).alias("f"), F.min("first").alias("first"))
    ranges = materialise(ranges.select("first", "last", "f.partition", "f.part", "f.file"), "ranges")
    found = None
    for turn in range(max(1, -(-ranges.count() // SEARCHED_FILES))):
        mine = ranges.orderBy("last").offset(turn * SEARCHED_FILES).limit(SEARCHED_FILES)
        each = _found(asked, mine)
        found = each if found is None else found.unionByName(each)
    return found


def _found(asked: DataFrame, ranges: DataFrame) -> DataFrame:
    bounds = ranges.select("first", "last", "file").toArrow().sort_by("last").combine_chunks()
    first, last = (bounds.column(c).to_numpy() for c in ("first", "last"))
    held = asked.sparkSession.sparkContext.broadcast((first, last, bounds.column("file").combine_chunks()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, highs, names = held.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            at = np.searchsorted(highs, ids)
            inside = np.flatnonzero(at < len(highs))
            inside = inside[lows[at[inside]] <= ids[inside]]
            yield pa.RecordBatch.from_arrays([pa.array(ids[inside]), names.take(pa.array(at[inside]))], ["id", "file"])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            for k, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file != at:
                    at, shard = file, open_shard(file)
                ids = shard.find(k)
                if ids is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([ids.astype(np.int64)])], ["id", "ids"])

    placed = asked.mapInArrow(place, "id long, file string")
    return placed.repartition("file").sortWithinPartitions("file").mapInArrow(take, "id long, ids array<long>")


def store_and_read(docs: DataFrame, vocabulary: str, end_id: int, by_word: bool) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of docs after encoding, writing and reading them.

    Null and empty texts have the end id alone. Documents are stored in ascending doc_id order,
    null ids first; rows that repeat an id are stored one after another, in the order of their texts'
    hashes. An empty table gives no rows; other columns are ignored.
    """
    files = write(docs, vocabulary, end_id, by_word)
    return read(files, files.count()).withColumnRenamed("id", "doc_id")


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()
