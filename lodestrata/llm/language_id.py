"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's vector is the mean of the embeddings of its hashed byte n-grams, and a linear layer with a
softmax names the language. Embeddings and layer are trained together by stochastic gradient
descent in numpy, on a bounded sample of labelled rows, and on texts in no language that are made
from them: with their letters shuffled, or exchanged for others. These have an outlet of their own,
so what looks like no learned language leaves little for any. Part of the sample is held back: it
sets the temperature that calibrates the scores and the score under which a text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches
from .words import by_bytes, release_memory

#: Hash buckets, embedding size, and lengths of the n-grams in bytes.
BUCKETS, DIM, GRAMS = 1 << 14, 16, (2, 3, 4)
#: Labelled rows that a model is fitted on, at most, and of one language, at most.
SAMPLE_ROWS, LANGUAGE_ROWS = 2000, 500
#: Texts in no language that are made for each labelled one, on average.
STRANGE = 0.5
#: Mixtures of texts of two languages, in which each counts a half, that are made for each labelled one.
MIXED = 0.25
EPOCHS, RATE, HELD_BACK = 6, 0.05, 0.25
#: Share of the correctly named held-back texts that the rejection score may turn away, and share of the strange ones that it shall.
REJECTED, CAUGHT = 0.002, 0.99
UNKNOWN = "und"
#: Bytes of text that a worker holds the n-grams of at once, in about forty times the memory.
BATCH_BYTES = 2 << 20
_SPACE = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint8)


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Per text: where its bytes start and how many; and for each length, the bucket of the n-gram at
    each byte, BUCKETS where it would leave the text. Letters are lower-cased, the rest of ASCII is space."""
    padded = pc.binary_join_element_wise(" ", pc.utf8_lower(pc.fill_null(texts, "")), " ", "")
    raw = np.frombuffer(b"".join(padded.cast(pa.binary()).to_pylist()), np.uint8)
    sizes = pc.binary_length(padded).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    clean = _SPACE[raw].astype(np.uint32)
    out = []
    for n in GRAMS:
        code = np.full(len(raw), BUCKETS, np.int32)
        if len(raw) >= n:
            packed = np.zeros(len(raw) - n + 1, np.uint32)
            for k in range(n):
                packed |= clean[k : len(raw) - n + 1 + k] << np.uint32(8 * k)
            code[: len(packed)] = (packed * np.uint32(2654435761) + np.uint32(n)) * np.uint32(2246822519) >> np.uint32(18)
            for k in range(1, n):
                code[ends - k] = BUCKETS
        out.append(code)
    return ends - sizes, sizes, out


@dataclass
class Model:
    """languages; a row of logits for each bucket, one for no language after those of the languages, and a last row of zeros; the layer's offsets; 1 / temperature; the least probability of all languages together to accept."""

    languages: list[str]
    table: np.ndarray
    offsets: np.ndarray
    sharpness: float = 1.0
    accept: float = 0.0

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Calibrated probabilities of the languages, one row for each text; what is left to 1 is that of no language."""
        starts, sizes, grams = _grams(texts)
        total, count = np.zeros((len(starts), len(self.languages) + 1)), np.zeros(len(starts))
        for n, code in zip(GRAMS, grams, strict=True):
            for j in range(total.shape[1]):
                total[:, j] += np.add.reduceat(self.table[:, j][code], starts)
            count += np.maximum(sizes - n + 1, 0)
        return _softmax((total / np.maximum(count, 1)[:, None] + self.offsets) * self.sharpness)[:, :-1]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


#: First letters of the blocks that letters are exchanged for: Latin, Greek, Cyrillic, Hebrew, Devanagari, CJK.
_BLOCKS = (0x61, 0x3B1, 0x430, 0x5D0, 0x915, 0x4E00)


def _strange(text: str, seed: int) -> str:
    """The text with its letters shuffled, or each letter exchanged for another one of some block."""
    rng = np.random.default_rng(seed)
    points = np.array([ord(c) for c in text.lower()], np.int64)
    letters = np.flatnonzero([c.isalpha() for c in text.lower()])
    if rng.random() < 0.5:
        points[letters] = rng.permutation(points[letters])
    elif len(letters):
        known, which = np.unique(points[letters], return_inverse=True)
        base = int(rng.choice(_BLOCKS))
        points[letters] = (base + rng.permutation(max(24, len(known)))[: len(known)] % (26 if base == 0x61 else 4096))[which]
    return "".join(map(chr, points))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text, mark) to (lang, mark, strange, buckets, weights): the distinct n-grams of each text and their shares."""
    for batch in by_bytes(batches, BATCH_BYTES):
        langs, texts, marks = (batch.column(c).to_pylist() for c in range(3))
        rows = [(x, m, False, t) for x, t, m in zip(langs, texts, marks, strict=True)]
        rows += [(x, m, True, _strange(t, m % (1 << 63))) for x, m, _, t in rows if m % 1000 < 1000 * STRANGE]
        starts, sizes, grams = _grams(pa.array([r[3] for r in rows], pa.string()))
        out = []
        for s, n in zip(starts, sizes, strict=True):
            found, times = np.unique(np.concatenate([g[s : s + n] for g in grams]), return_counts=True)
            inside = found < BUCKETS
            out.append((found[inside], times[inside] / max(1, times[inside].sum())))
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.float32()))
        columns = [[r[i] for r in rows] for i in range(3)] + [[x[i] for x in out] for i in range(2)]
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["lang", "mark", "strange", "buckets", "weights"])


def _mixed(rows: list[tuple[int, np.ndarray, np.ndarray]], languages: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """rows (outlet, buckets, weights) with shares of outlets for outlets, and mixtures of two languages besides."""
    one = np.eye(languages + 1)
    out = [(one[t], at, share) for t, at, share in rows]
    real = [r for r in rows if r[0] < languages]
    for _ in range(int(MIXED * len(real))):
        (s, a, x), (t, b, y) = (real[i] for i in rng.integers(0, len(real), 2))
        if s != t:
            at, where = np.unique(np.concatenate([a, b]), return_inverse=True)
            out.append(((one[s] + one[t]) / 2, at, np.bincount(where, np.concatenate([x, y]) / 2)))
    return out


def _descend(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], outlets: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings and layer by stochastic gradient descent over (shares of outlets, buckets, weights); returned as logits for each bucket."""
    embeddings = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    layer, offsets = np.zeros((DIM, outlets)), np.zeros(outlets)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            truth, at, share = rows[i]
            rate, done = RATE * (1 - done / steps), done + 1
            vector = share @ embeddings[at]
            error = _softmax(vector @ layer + offsets)
            error -= truth
            back = layer @ error
            layer -= rate * 20 * np.outer(vector, error)
            offsets -= rate * 0.1 * error
            embeddings[at] -= rate * 20 * share[:, None] * back
    return embeddings @ layer, offsets


def _sample(rows: DataFrame) -> DataFrame:
    """(lang, text, mark) of at most LANGUAGE_ROWS rows of each language and SAMPLE_ROWS in all, whichever machine reads them.

    Each language's rows fall into LANGUAGE_ROWS strata by a hash of key and text, and the least
    hash of a stratum is taken, so copies of a row count once. Where there are more languages than
    the sample has room for, the strata are filled in turn.
    """
    marked = rows.select("lang", "text", F.xxhash64(F.lit("sample"), "key", "text").alias("mark"))
    stratum = F.pmod(F.xxhash64("mark"), F.lit(LANGUAGE_ROWS)).alias("stratum")
    least = marked.groupBy("lang", stratum).agg(F.min("mark").alias("mark"))
    picked = [(r.lang, r.mark) for r in least.orderBy("stratum", "lang").limit(SAMPLE_ROWS).collect()]
    wanted = rows.sparkSession.createDataFrame(picked, "lang string, mark long")
    return marked.join(F.broadcast(wanted), ["lang", "mark"], "left_semi").select("lang", "text", "mark").dropDuplicates(["lang", "mark"])


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id") -> Model:
    """A model of the languages of docs' labelled rows, fitted on whole texts of at most SAMPLE_ROWS of them.

    Rows are picked by the hash of key and text, as many for each language, whatever their number
    and order; null languages and null texts are passed over. Without labelled rows the model knows
    no language.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    schema = "lang string, mark long, strange boolean, buckets array<int>, weights array<float>"
    counted = _sample(rows).mapInArrow(_counted, schema).toArrow().sort_by([(c, "ascending") for c in ("lang", "mark", "strange")])
    languages = sorted(pc.unique(counted.column("lang")).to_pylist())
    if not languages:
        return Model([], np.zeros((BUCKETS + 1, 1)), np.zeros(1))
    columns = (counted.column(c).combine_chunks() for c in ("lang", "strange", "buckets", "weights"))
    data = []
    for x, strange, b, w in zip(*columns, strict=True):
        if len(b):
            truth = len(languages) if strange.as_py() else languages.index(x.as_py())
            data.append((truth, b.values.to_numpy(), w.values.to_numpy()))
    rng = np.random.default_rng(7)
    mixed = [data[i] for i in rng.permutation(len(data))]
    held = mixed[: int(len(mixed) * HELD_BACK)]
    table, offsets = _descend(_mixed(mixed[len(held) :], len(languages), rng), len(languages) + 1, rng)
    model = Model(languages, np.vstack([table, np.zeros(len(languages) + 1)]), offsets)
    if held:
        logits = np.stack([share @ table[at] + offsets for _, at, share in held])
        _calibrate(model, logits, np.array([r[0] for r in held]))
    del counted, data, mixed, held
    release_memory()
    return model


def _calibrate(model: Model, logits: np.ndarray, truth: np.ndarray) -> None:
    """Sets the temperature and the rejection score by held-back texts."""
    # one more error than was seen, so that a faultless sample does not make every score 1
    doubt = 1 / (len(truth) + 2)
    target = np.full(logits.shape, doubt / logits.shape[1])
    target[np.arange(len(truth)), truth] += 1 - doubt
    losses = {t: -(target * np.log(_softmax(logits * t) + 1e-12)).sum(1).mean() for t in np.geomspace(0.0001, 10, 101)}
    model.sharpness = float(min(losses, key=losses.get))
    scored = _softmax(logits * model.sharpness)[:, :-1]
    real = truth < len(model.languages)
    right, strange = scored[real & (scored.argmax(1) == truth)].sum(1), scored[~real].sum(1)
    if not len(right):
        return
    # between what strange texts reach and what texts of the languages fall to, on the scale of logits, and nearer to the
    # strange ones, as short texts and rare words have little to show
    low, high = np.quantile(strange, CAUGHT) if len(strange) else 0.0, np.quantile(right, REJECTED)
    logit = lambda p: np.log(max(p, 1e-9) / max(1 - p, 1e-9))
    model.accept = float(high if low >= high else 1 / (1 + np.exp(-(3 * logit(low) + logit(high)) / 4)))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, accepted) of every whole text.

    lang_pred is a language of the model, or `und` with score 0 if the text is null or has no letter
    or the model knows no language. score is the calibrated probability of lang_pred. accepted says
    whether the probability of all languages together reaches the model's rejection score, so that a
    text in two languages is no stranger than one in one; `und` is never accepted. Rows that repeat an id are judged each; null ids are returned;
    an empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in by_bytes(batches, BATCH_BYTES):
            known = batch.column(2).to_numpy(zero_copy_only=False) & bool(model.languages)
            if model.languages:
                scores = model.scores(batch.column(1))
                best, top, whole = scores.argmax(1), scores.max(1), scores.sum(1)
            else:
                best, top, whole = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            best, top = np.where(known, best, len(model.languages)), np.where(known, top, 0.0)
            columns = [batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(top), pa.array(known & (whole >= model.accept))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, accepted boolean")
    return out.withColumnRenamed("id", id_col)


def keep_accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose language `predict` accepts."""
    bounded_batches(docs.sparkSession)
    letters = "letters_" + "_".join(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, BATCH_BYTES, text):
            texts, known = batch.column(text), batch.column(letters).to_numpy(zero_copy_only=False)
            whole = model.scores(texts).sum(1) if model.languages else np.full(batch.num_rows, -1.0)
            yield batch.drop_columns([letters]).filter(pa.array(known & (whole >= model.accept)))

    found = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(letters)
    return docs.select("*", found).mapInArrow(run, docs.schema)
