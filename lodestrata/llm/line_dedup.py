"""Dropping of lines that many documents share.

Lines are exploded, normalised and hashed; distinct documents are counted per hash; the places of
lines whose hash reaches the threshold are found by a join, and each text is put together by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise

#: ASCII white space, as in the contract of a line's key.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table of dropped hashes is broadcast up to this many rows (16 bytes each, about 16 MB); beyond it, it is shuffled.
BROADCAST_ROWS = 1_000_000


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return _lower(F.btrim(line, F.lit(SPACES)))


def _lower(x: Column) -> Column:
    """A-Z lower-cased; plain ASCII takes the faster function."""
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))


def _hashes(lines: Column, least_chars: int) -> Column:
    """128-bit hashes of the lines' keys, null for those that are too short to count.

    Spark takes the hash of one argument as the seed of the next, so the constant stands first:
    with it behind the line, the second half would follow from the first.
    """
    trimmed = F.transform(lines, lambda x: F.btrim(x, F.lit(SPACES)))
    keys = F.transform(trimmed, _lower)
    one = lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("line"), x).alias("h2"))
    return F.transform(keys, lambda x: F.when(F.char_length(x) >= least_chars, one(x)))


def _often_repeated(rows: DataFrame, lines: str, min_docs: int, least_chars: int) -> DataFrame:
    """(h1, h2, no_id) of every line key that is found in at least min_docs rows, no_id of them without an id.

    Repeated lines of one text are folded before the shuffle, and counts are combined on the map
    side, so a line of a third of all documents is no hot key. A document may have several rows,
    so there are no fewer of these keys than of those of min_docs documents.
    """
    own = F.array_distinct(_hashes(F.col(lines), least_chars))
    found = rows.select("id", F.explode_outer(own).alias("h")).where("h is not null")
    counted = found.groupBy(F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2")).agg(F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("no_id"))
    return counted.where(F.col("n") >= min_docs).select("h1", "h2", "no_id")


def _joinable(hashes: DataFrame) -> DataFrame:
    return F.broadcast(hashes) if hashes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else hashes


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = 10, least_chars: int = 1
) -> DataFrame:
    """One row for each row of docs: (id_col, n_lines, n_dropped, kept_text).

    docs: rows of one id are one document, however many they are and whatever their texts, and each
    gets a result of its own; a row with a null id is a document of its own. A null or empty text is
    one empty line. Lines shorter than least_chars code points after normalisation always stay. An
    empty table gives no rows; other columns are ignored. When all lines of a text are dropped,
    kept_text is empty.
    """
    out = _reassembled(docs, id_col, text, min_docs, least_chars)
    return out.select(F.col("id").alias(id_col), "n_lines", "n_dropped", "kept_text")


def without_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = 10, least_chars: int = 1
) -> DataFrame:
    """docs with all their columns, text replaced by what `drop_repeated_lines` keeps of it."""
    out = _reassembled(docs, id_col, text, min_docs, least_chars)
    names = [(c, F.col("kept_text") if c == text else F.col("row").getField(c)) for c in docs.columns]
    return out.select(*(x.alias(c) for c, x in names))


def _reassembled(docs: DataFrame, id_col: str, text: str, min_docs: int, least_chars: int) -> DataFrame:
    others = [F.col(c) for c in docs.columns if c != text]
    rows = docs.select(F.struct(*others).alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    keyed = rows.select("row", "id", F.xxhash64("id", "t").alias("key"), F.split("t", "\n", -1).alias("lines"))
    often = _joinable(materialise(_often_repeated(keyed, "lines", min_docs, least_chars), "lines"))
    # an inner explode would have the hashes computed once more for a filter
    exploded = keyed.select("id", "key", F.posexplode_outer(_hashes(F.col("lines"), least_chars)).alias("pos", "h"))
    exploded = exploded.select("id", "key", "pos", F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"))
    places = materialise(exploded.join(often, ["h1", "h2"]), "places")
    # distinct documents in two steps, so that the documents of one line are counted by many tasks
    pairs = places.groupBy("h1", "h2", "id").agg(F.max("no_id").alias("no_id"))
    documents = F.count("id") + F.max("no_id")
    frequent = pairs.groupBy("h1", "h2").agg(documents.alias("n")).where(F.col("n") >= min_docs).select("h1", "h2")
    frequent = _joinable(materialise(frequent, "frequent"))
    gone = places.join(frequent, ["h1", "h2"], "left_semi").groupBy("id", "key").agg(F.collect_set("pos").alias("gone"))
    gone = gone.select(F.col("id").alias("gone_id"), F.col("key").alias("gone_key"), "gone")
    same = (F.col("key") == F.col("gone_key")) & F.col("id").eqNullSafe(F.col("gone_id"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.transform(left, lambda i: F.get(F.col("lines"), i))
    return keyed.join(gone, same, "left").select(
        "row",
        "id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept), "\n").alias("kept_text"),
    )
