"""Words, shingles and MinHash signatures of Arrow batches of texts, as flat numpy arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_FOLD = np.uint64(0x9E3779B97F4A7C15)


def by_bytes(batches: Iterable[pa.RecordBatch], most_bytes: int = 8 << 20, text: int | str = 1) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about most_bytes of text each, and one row at least.

    Memory stays bounded for very long texts, and short ones are handled many at a time.
    """
    held: list[pa.RecordBatch] = []
    size = 0

    def together() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(sizes.tolist()):
            if size and size + n > most_bytes:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield together()
                held, size, start = [], 0, i
            size += n
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield together()
    held.clear()
    release_memory()


def release_memory() -> None:
    """Returns what this process no longer uses to the machine, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, split at ASCII white space) and the offset of each row's words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    at = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    ids = flat.indices.to_numpy(zero_copy_only=False)
    names = flat.dictionary.to_pylist()
    if not names:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    real = np.array([w != "" for w in names])[ids]
    kept = np.concatenate(([0], np.cumsum(real)))
    return table[ids][real], kept[at - at[0]]


def shingle_sets(texts: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's n-word shingles, flat, and offsets.

    A row with fewer words has its whole sequence as one shingle; one without words has none.
    """
    words, at = word_hashes(texts)
    span = max(0, len(words) - n + 1)
    rolled = np.zeros(span, np.uint64)
    for k in range(n):
        rolled = mix(rolled * _FOLD + words[k : k + span])
    out = []
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi - lo >= n:
            out.append(np.unique(rolled[lo : hi - n + 1]))
        elif hi > lo:
            whole = np.full(1, hi - lo, np.uint64)
            for w in words[lo:hi]:
                whole = mix(whole * _FOLD + w)
            out.append(whole)
        else:
            out.append(words[:0])
    sizes = np.array([len(x) for x in out], np.int64)
    return (np.concatenate(out) if out else words[:0]), np.concatenate(([0], np.cumsum(sizes)))


def signatures(flat: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """MinHash values, 32 bits each, of the non-empty sets: one row each, k coordinates."""
    rows = at[:-1][np.diff(at) > 0]
    rng = np.random.default_rng(20240229)
    factors = rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, k, dtype=np.uint64)
    out = np.empty((len(rows), k), np.int64)
    for j in range(k if len(rows) else 0):
        out[:, j] = np.minimum.reduceat((flat * factors[j] + shifts[j]) >> np.uint64(32), rows)
    return out
