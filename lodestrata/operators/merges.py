"""Aggregations that summarise, merge and deduplicate. Order never decides a result by accident: ties have columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flows(events: DataFrame, keys: Sequence[str], time: str, size: str, flags: Sequence[str] = ()) -> DataFrame:
    """One row per key: packets, bytes, first and last time, and whether any packet has each flag."""
    return events.groupBy(*keys).agg(
        F.count("*").alias("packets"),
        F.sum(size).alias("bytes"),
        F.min(time).alias("first_seen"),
        F.max(time).alias("last_seen"),
        *(F.bool_or(f).alias(f) for f in flags),
    )


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def last_by_priority(df: DataFrame, keys: Sequence[str], priority: Sequence[str]) -> DataFrame:
    """The row of each key with the highest priority."""
    return first_seen(df, keys, [F.desc(p) for p in priority])


def distinct_counts(df: DataFrame, group: Sequence[str], conditions: dict[str, Column], value: str) -> DataFrame:
    """(group, a count for each condition): distinct non-blank values with a row under it.

    Each value is one row of flags first, so any number of conditions shuffles each value once.
    """
    flags = [F.bool_or(F.coalesce(c & (F.col(value) != ""), F.lit(False))).alias(n) for n, c in conditions.items()]
    each = df.groupBy(*group, F.col(value).alias("_value")).agg(*flags)
    return each.groupBy(*group).agg(*(F.count_if(n).alias(n) for n in conditions))


def sum_where(conditions: dict[str, Column], value: str) -> list[Column]:
    """Aggregates: sums under each condition, 0 where none holds."""
    return [F.coalesce(F.sum(F.when(c, F.col(value))), F.lit(0)).alias(n) for n, c in conditions.items()]


def count_where(conditions: dict[str, Column]) -> list[Column]:
    """Aggregates: rows under each condition."""
    return [F.count_if(c).alias(n) for n, c in conditions.items()]


def distribution(df: DataFrame, group: Sequence[str], key: str, member: str | None = None, weight: str | None = None) -> DataFrame:
    """(group, key, n): distinct members of each key (A7), or the sum of weights."""
    known = df.where(F.coalesce(F.col(key), F.lit("")) != "")
    n = F.count_distinct(member) if member else F.sum(weight) if weight else F.count("*")
    return known.groupBy(*group, key).agg(n.alias("n"))


def as_map(dist: DataFrame, group: Sequence[str], key: str, name: str) -> DataFrame:
    """A distribution as one map per group, with its number of keys."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n"))))
    return dist.groupBy(*group).agg(entries.alias(name), F.count("*").alias(f"{name}_keys"))


def top_shares(dist: DataFrame, group: Sequence[str], key: str, k: int, first: str | None = None) -> DataFrame:
    """(group, key, n, place, share) of the k largest keys; ties by first, the place of the first encounter, then by key."""
    whole = Window.partitionBy(*group)
    ties = [F.col(first)] if first else []
    place = F.row_number().over(whole.orderBy(F.desc("n"), *ties, F.col(key)))
    share = F.try_divide(F.col("n").cast("double"), F.sum("n").over(whole))
    return dist.withColumn("place", place).withColumn("share", share).where(F.col("place") <= k)


def fan_out(df: DataFrame, group: Sequence[str], name: str, answers: str) -> DataFrame:
    """Average and most distinct answers for each name."""
    each = df.select(*group, name, F.explode_outer(answers).alias("_a")).groupBy(*group, name).agg(F.count_distinct("_a").alias("_n"))
    return each.groupBy(*group).agg(F.avg("_n").alias("avg_answers"), F.max("_n").alias("max_answers"))


#: Characters that are kept of a snippet.
SNIPPET = 500


def merged_findings(df: DataFrame, keys: Sequence[str], file: str, rank: str, layer: str, pos: str, details: str, subtype: str, snippet: str) -> DataFrame:
    """Findings of one key as one row.

    Occurrences, distinct files, the highest rank; file and the start of the snippet of the lowest
    layer, the first of equal ones; the first subtype; details merged, the last value of each winning.
    """
    entries = df.select(*keys, F.col(pos).alias("_pos"), F.explode(details).alias("_k", "_v"))
    entries = entries.groupBy(*keys, "_k").agg(F.max_by("_v", F.struct("_pos", "_v")).alias("_v"))  # combines before the shuffle
    merged = entries.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("details"))
    best = F.min_by(F.struct(F.col(file).alias("file"), F.col(snippet).alias("snippet")), F.struct(layer, pos))
    out = df.groupBy(*keys).agg(
        F.count("*").alias("occurrences"),
        F.count_distinct(file).alias("files"),
        F.max(rank).alias("rank"),
        best.alias("_best"),
        F.min_by(subtype, pos).alias("subtype"),
    )
    out = joined_by(out, merged, keys).withColumn("details", F.coalesce("details", F.create_map().cast("map<string,string>")))
    return out.select(*keys, "occurrences", "files", "rank", "_best.file", F.substring("_best.snippet", 1, SNIPPET).alias("snippet"), "subtype", "details")


def joined_by(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """left with the other columns of right, which has a row for a key at most; null keys are equal."""
    named = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(named, same, "left").drop(*(f"_r_{k}" for k in keys))


def merged_components(df: DataFrame, keys: Sequence[str], flags: Sequence[str], counts: Sequence[str], version: str, source: str, pos: str) -> DataFrame:
    """Detections of one component: flags or-ed, counts summed, the first version, `both` of several sources."""
    sources = F.when(F.count_distinct(source) > 1, "both").otherwise(F.min(source))
    return df.groupBy(*keys).agg(
        *(F.bool_or(f).alias(f) for f in flags),
        *(F.sum(c).alias(c) for c in counts),
        F.min_by(version, F.when(F.col(version).isNotNull(), F.col(pos))).alias(version),
        sources.alias(source),
    )


def best_candidate(df: DataFrame, keys: Sequence[str], value: str, valid: Column, order: Sequence[Column]) -> DataFrame:
    """The first valid candidate of each key by order."""
    return first_seen(df.where(valid), keys, order).select(*keys, value)


def united(df: DataFrame, keys: Sequence[str], sets: Sequence[str], category: str, pos: str, low: str, high: str) -> DataFrame:
    """Rows of one key: sorted unions of arrays, the first known category, the span of levels, a confidence by sources."""
    known = F.when(~F.coalesce(F.col(category), F.lit("")).isin("", "unknown"), F.col(pos))
    out = df.groupBy(*keys).agg(
        F.coalesce(F.min_by(category, known), F.lit("unknown")).alias(category),
        F.min(low).alias(low),
        F.max(high).alias(high),
    )
    for s in sets:  # members are made distinct before they are gathered, so a row holds a set and never all lists
        members = df.select(*keys, F.explode(s).alias("_m")).where("_m is not null").distinct()
        out = joined_by(out, members.groupBy(*keys).agg(F.array_sort(F.collect_list("_m")).alias(s)), keys)
        out = out.withColumn(s, F.coalesce(s, F.array().cast(df.schema[s].dataType)))
    n = F.size(sets[0])
    return out.select(*keys, *sets, category, low, high).withColumn("confidence", F.when(n >= 3, "VERY_HIGH").when(n == 2, "HIGH").otherwise("MEDIUM"))


def version_span(df: DataFrame, keys: Sequence[str], level: str) -> DataFrame:
    """Sorted distinct levels with the least and the most."""
    out = df.groupBy(*keys).agg(F.array_sort(F.collect_set(level)).alias("levels"))
    return out.select(*keys, "levels", F.array_min("levels").alias("least"), F.array_max("levels").alias("most"))


def conflict_merge(df: DataFrame, key: str, fields: Sequence[str], dataset: str, priority: str) -> DataFrame:
    """Rules of several datasets by key: by priority the first non-blank of each field, all datasets, whether they conflict."""
    filled = lambda f: F.when(F.coalesce(F.col(f), F.lit("")) != "", F.col(priority))
    return df.groupBy(key).agg(
        *(F.min_by(f, filled(f)).alias(f) for f in fields),
        F.array_join(F.array_sort(F.collect_set(dataset)), ";").alias("datasets"),
        F.count("*").alias("rows"),
        (F.count_distinct(F.nullif(F.col(fields[0]), F.lit(""))) > 1).alias("conflict"),
    )


def component_evidence(df: DataFrame, keys: Sequence[str], flags: Sequence[str], file: str, identifier: str, version: str, good: Column, trust: str, pos: str) -> DataFrame:
    """Evidence of one component as one row.

    Flags or-ed, distinct files, the first non-blank identifier, and the good version of the most
    trusted source, the first of equal ones; `primary` is manifest if any evidence is from there.
    """
    filled = lambda c, order: F.when(F.coalesce(F.col(c), F.lit("")) != "", order)
    return df.groupBy(*keys).agg(
        *(F.bool_or(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags),
        F.count_distinct(F.nullif(F.col(file), F.lit(""))).alias("files"),
        F.min_by(identifier, filled(identifier, F.col(pos))).alias(identifier),
        F.max_by(version, F.when(good, F.struct(F.col(trust), -F.col(pos)))).alias(version),
        F.when(F.bool_or(F.coalesce(F.col(flags[0]), F.lit(False))), "manifest").otherwise("code").alias("primary"),
    )


def provider_stats(df: DataFrame, provider: str, ident: str, verified: Column) -> DataFrame:
    """(provider, detectors, patterns, verified) of pattern rules named `detector_n`, the providers of most patterns first."""
    detector = F.regexp_replace(ident, "_[^_]*$", "")
    out = df.groupBy(provider).agg(F.count_distinct(detector).alias("detectors"), F.count("*").alias("patterns"), F.count_if(verified).alias("verified"))
    return out.orderBy(F.desc("patterns"), provider)


def profile(df: DataFrame, group: Sequence[str], columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(group, rows, distinct values of each column, rows without a key part, repeated keys): what was imported, by artifact."""
    blank = F.lit(False)
    for k in keys:
        blank = blank | (F.coalesce(F.col(k).cast("string"), F.lit("")) == "")
    rows = df.groupBy(*group).agg(F.count("*").alias("rows"), *(F.count_distinct(c).alias(f"distinct_{c}") for c in columns), F.count_if(blank).alias("blank_keys"))
    again = df.groupBy(*group, *keys).agg(F.count("*").alias("_n")).groupBy(*group).agg(F.count_if(F.col("_n") > 1).alias("repeated_keys"))
    return joined_by(rows, again, group)


def joined_set(column: str, separator: str = ";") -> Column:
    """Aggregate: sorted distinct texts in one."""
    return F.array_join(F.array_sort(F.collect_set(column)), separator)


def frequent(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent values, ties by value."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def longest(df: DataFrame, text: str, ties: Sequence[str], n: int) -> DataFrame:
    """The n rows of the longest texts, then by the text and ties."""
    return df.orderBy(F.desc(F.length(text)), text, *ties).limit(n)


def percent(part: Column, whole: Column) -> Column:
    """One decimal, 0 of nothing."""
    return F.coalesce(F.round(F.try_divide(100 * part, whole).cast("decimal(18,6)"), 1), F.lit(0)).cast("decimal(18,1)")


def exploded_counts(df: DataFrame, column: str, separator: str) -> DataFrame:
    """Rows for each member of a delimited text."""
    return df.select(F.explode(F.split(column, separator)).alias("member")).where("member <> ''").groupBy("member").agg(F.count("*").alias("n"))


def capped(df: DataFrame, group: Sequence[str], first: Column, order: Sequence[str], n: int) -> DataFrame:
    """At most n rows of each group, those for which first is true before the others (T4)."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.when(first, 0).otherwise(1), *order))
    return df.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def bursts(df: DataFrame, keys: Sequence[str], time: str, gap_seconds: float, slice_seconds: float = 86_400) -> DataFrame:
    """Runs of events of a key that follow each other within a gap: (keys, burst, events, first_seen, last_seen).

    Each slice of a key's time is cut into runs by itself. The first and last times of the slices
    then tell which of them go on from one to the next, and by how much their runs are numbered
    higher, so that no task sees more than a slice, or one row for each slice of a key. Events
    without a time are left out.
    """
    seconds = F.col(time).cast("timestamp").cast("double")
    rows = df.where(F.col(time).isNotNull()).withColumn("_t", seconds).withColumn("_slice", F.floor(seconds / slice_seconds))
    own = Window.partitionBy(*keys, "_slice").orderBy("_t")
    apart = F.when(F.col("_t") - F.lag("_t").over(own) > gap_seconds, 1).otherwise(0)
    runs = rows.withColumn("_s", apart).withColumn("_run", F.sum("_s").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*keys, "_slice", "_run").agg(
        F.count("*").alias("events"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.min("_t").alias("_from"), F.max("_t").alias("_to")
    )
    slices = runs.groupBy(*keys, "_slice").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.max("_run").alias("_breaks"))
    order = Window.partitionBy(*keys).orderBy("_slice")
    new = F.when(F.col("_from") - F.lag("_to").over(order) <= gap_seconds, 0).otherwise(1) + F.coalesce(F.lag("_breaks").over(order), F.lit(0))
    slices = slices.withColumn("_new", new).select(*keys, "_slice", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_before"))
    out = joined_by(runs, slices, [*keys, "_slice"]).withColumn("burst", F.col("_run") + F.col("_before"))
    return out.groupBy(*keys, "burst").agg(F.sum("events").alias("events"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def nulls_as_empty(*columns: str) -> list[Column]:
    """Sort keys with null as the empty text (K3, T5)."""
    return [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
