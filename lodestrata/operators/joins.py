"""Lookup joins. Every one is an equi-join on exploded keys followed by a choice of the best match.

Rule tables are joined as they are, for Spark to broadcast by its own measure of their size; pass a
rule table through `F.broadcast` where its size is known. Values are looked up once each: the
distinct probe values are joined and the results brought back. Ties are broken by explicit columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.net import block_key, clean_name, ip_key, masked, private_key
from ..functions.versions import in_any_range
from ..tables import written
from .grams import containing, starting
from .ranges import narrowest

#: Patterns that one expression holds at most.
MOST_PATTERNS = 10_000


def as_literals(rules: DataFrame, *columns: str) -> list[tuple]:
    """The distinct rows of a table of patterns, which become parts of an expression; raises ValueError beyond MOST_PATTERNS."""
    rows = sorted(map(tuple, rules.select(*columns).distinct().limit(MOST_PATTERNS + 1).collect()), key=repr)
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    return rows


def _best(found: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return found.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def _bring_back(df: DataFrame, column: str, found: DataFrame, key: str = "_probe") -> DataFrame:
    return df.join(found, df[column].eqNullSafe(found[key]), "left").drop(key)


def longest_suffix(df: DataFrame, column: str, rules: DataFrame, suffix: str) -> DataFrame:
    """df with the columns of the rule whose suffix is the longest label-aligned suffix of a name.

    Names are compared in lower case without dots at the ends; blank names match nothing.
    """
    probes = df.select(F.col(column).alias("_probe")).where(F.col(column).isNotNull()).distinct()
    labels = F.split(clean_name(F.col("_probe")), r"\.")
    keys = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = probes.where(clean_name(F.col("_probe")).isNotNull()).select("_probe", F.posexplode(keys).alias("_at", "_key"))
    known = rules.withColumn("_suffix", clean_name(F.col(suffix)))
    found = keyed.join(known, F.col("_key") == F.col("_suffix"))
    best = _best(found, ["_probe"], [F.col("_at"), F.col(suffix)])
    return _bring_back(df, column, best.drop("_at", "_key", "_suffix"))


def two_tier(df: DataFrame, column: str, primary: DataFrame, secondary: DataFrame, suffix: str, fields: Sequence[str], always: Sequence[str] = ()) -> DataFrame:
    """Longest-suffix matches of two rule tables: the primary's non-blank fields win, one by one; always: fields of the secondary alone."""
    first = primary.select(suffix, *(F.col(f).alias(f"_p_{f}") for f in fields)).withColumn("_p", F.lit(True))
    second = secondary.select(suffix, *(F.col(f).alias(f"_s_{f}") for f in (*fields, *always))).withColumn("_s", F.lit(True))
    both = longest_suffix(longest_suffix(df, column, first, suffix).drop(suffix), column, second, suffix).drop(suffix)
    merged = [F.coalesce(F.nullif(F.col(f"_p_{f}"), F.lit("")), F.col(f"_s_{f}")).alias(f) for f in fields] + [F.col(f"_s_{f}").alias(f) for f in always]
    return both.select(*df.columns, (F.col("_p").isNotNull() | F.col("_s").isNotNull()).alias("matched"), *merged)


def longest_prefix(df: DataFrame, column: str, rules: DataFrame, prefix: str, boundary: bool = False) -> DataFrame:
    """df with the columns of the rule of the longest prefix of a lower-cased value.

    boundary: the prefix must end the value or be followed by `.` or `/`.
    """
    known = rules.withColumn("_prefix", F.lower(prefix))
    probes = df.select(F.col(column).alias("_probe")).where(F.col(column).isNotNull()).distinct().withColumn("_low", F.lower("_probe"))
    found = starting(probes, "_low", known, "_prefix")
    if boundary:
        after = F.length("_prefix") + 1
        found = found.where((F.length("_low") < after) | F.substring(F.col("_low"), after, F.lit(1)).isin(".", "/"))
    best = _best(found, ["_probe"], [F.desc(F.length("_prefix")), F.col("_prefix")])
    return _bring_back(df, column, best.drop("_low", "_prefix"))


def resolve_name(df: DataFrame, column: str, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """df with `resolved`: the exact name, else the first owner of the exact alias, else the name of the longest prefix, else the value.

    names (name, prefix, pos); aliases (alias, name, pos).
    """
    owners = _best(aliases.select(F.col("alias").alias("_alias"), F.col("name").alias("_by_alias"), "pos"), ["_alias"], ["pos"]).drop("pos")
    exact = names.select(F.col("name").alias("_by_name")).distinct()
    known = names.select(F.col("name").alias("_by_prefix"), "prefix")
    out = df.join(exact, df[column] == exact["_by_name"], "left").join(owners, df[column] == owners["_alias"], "left")
    out = longest_prefix(out, column, known, "prefix", boundary=True)
    resolved = F.coalesce("_by_name", "_by_alias", "_by_prefix", F.col(column))
    return out.withColumn("resolved", resolved).select(*df.columns, "resolved")


def best_contained(df: DataFrame, column: str, rules: DataFrame, pattern: str, pos: str) -> DataFrame:
    """df with the rule whose pattern the value contains, whatever the case: the longest, then the first by pos."""
    probes = df.select(F.col(column).alias("_probe")).where(F.col(column).isNotNull()).distinct().withColumn("_low", F.lower("_probe"))
    found = containing(probes, "_low", rules.withColumn("_pattern", F.lower(pattern)), "_pattern").drop("_low", "_pattern")
    return _bring_back(df, column, _best(found, ["_probe"], [F.desc(F.length(pattern)), F.col(pos)]))


def cidr_lookup(df: DataFrame, column: str, rules: DataFrame, block: str, pos: str) -> DataFrame:
    """df with the rule of an IPv4 or IPv6 address: the exact one, else the first CIDR block that holds it.

    Addresses and blocks are joined by the fixed bits of the blocks, once for each number of bits that rules have.
    """
    known = written(rules.withColumn("_block", block_key(F.col(block))).select("*", F.col("_block.bits").alias("_bits"), F.col("_block.low").alias("_low")).drop("_block"), "blocks").where("_bits is not null")
    bits = sorted(r[0] for r in known.select("_bits").distinct().collect())  # 129 at most
    probes = _address_keys(df, column).where("_key is not null")
    probes = probes.withColumn("_bits", F.explode(F.array(*map(F.lit, bits)).cast("array<int>"))).withColumn("_low", masked(F.col("_key"), F.col("_bits")))
    best = _best(probes.join(known, ["_bits", "_low"]), ["_probe"], [(F.col("_bits") < 128).cast("int"), F.col(pos)])
    return _bring_back(df, column, best.drop("_key", "_low", "_bits"))


def _address_keys(df: DataFrame, column: str) -> DataFrame:
    """(_probe, _key) of the distinct addresses, written, as what asks for a key would otherwise work it out anew."""
    return written(df.select(F.col(column).alias("_probe")).distinct().withColumn("_key", ip_key(F.col("_probe"))), "addresses")


def range_lookup(df: DataFrame, column: str, ranges: DataFrame, low: str, high: str) -> DataFrame:
    """df with the range (IPv4 or IPv6 addresses low to high) that holds a public address; the narrowest of several.

    Of ranges with the same bounds, the first by their other columns counts.
    """
    known = ranges.select(ip_key(F.col(low)).alias("_low"), ip_key(F.col(high)).alias("_high"), F.struct(*ranges.columns).alias("_range"))
    # conditions on keys come after writing, as they would else work keys out once more
    known = written(known.groupBy("_low", "_high").agg(F.min("_range").alias("_range")), "ranges").where("_low <= _high")
    probes = _address_keys(df, column).where(~private_key(F.col("_key")))
    found = narrowest(probes, known).select("_probe", "_range.*")
    return df.join(found, df[column] == found["_probe"], "left").drop("_probe")


#: Rows of one token that a task handles, at least; and tokens of more rows, at most, as they are broadcast.
HOT_TOKEN, MOST_HOT = 100_000, 10_000
#: Pairs that a task makes, at least; tasks of so many pairs, at most; and tokens that are broadcast to leave out rows of all others.
TASK_PAIRS, MOST_TASKS, KNOWN_TOKENS = 10_000_000, 2_000, 200_000


def token_candidates(
    items: DataFrame, item: str, tokens: str, products: DataFrame, product: str, keys: Sequence[str], residual: Column | None = None,
    equal: Sequence[tuple[Column, Column]] = (),
) -> DataFrame:
    """Pairs of items and product rows that share a token, once for each item and keys.

    equal: columns of items and of products that have to be equal as well; pairs that differ in
    them are never made. residual: any further condition, asked of each pair. Tokens are counted on
    both sides, and so are items and keys, so items are best given as a written table. The items of
    a token that very many have, or of which very many pairs are made, are dealt into parts, and so
    are its products; each part of the one side meets each of the other by itself, and a task has no
    more than HOT_TOKEN rows of a token on a side and makes about TASK_PAIRS pairs of it; where
    there are more than MOST_TASKS times that, these grow instead. An item and a product that are
    each in one row meet once at most; only the pairs of the others are made distinct, so that not
    all pairs are shuffled.
    """
    on = ["_token", *(f"_e{n}" for n in range(len(equal)))]
    items = items.withColumns({"_token": F.array_distinct(tokens)} | {f"_e{n}": a for n, (a, _) in enumerate(equal)})
    products = products.withColumns({"_token": F.col(product)} | {f"_e{n}": b for n, (_, b) in enumerate(equal)})
    many, again = _repeated(items, [item]), _repeated(products, keys)
    known, how, tasks = _token_parts(items.withColumn("_token", F.explode("_token")), products, on)

    def met(some: DataFrame, listed: DataFrame, tasks: int = 0) -> DataFrame:
        left, right = _dealt(some.withColumn("_token", F.explode("_token")), on, known, how, "_i", "_m", "_j", "_k"), _dealt(listed, on, known, how, "_j", "_k", "_i", "_m")
        if tasks:  # by bytes, Spark would make a few tasks of them
            left, right = (df.repartition(tasks, *on, "_i", "_j") for df in (left, right))
        right = right.select(*(F.col(c).alias(f"_p{c}") if c in (*on, "_i", "_j") else F.col(c) for c in right.columns))
        same = reduce(Column.__and__, (F.col(c) == F.col(f"_p{c}") for c in (*on, "_i", "_j")))
        right = right.hint("merge") if tasks else right
        return left.join(right, same if residual is None else same & residual).drop(*(f"{p}{c}" for p in ("", "_p") for c in (*on, "_i", "_j")))

    single = _among(items, many, [item], "left_anti") if many else items
    out = met(single, _among(products, again, keys, "left_anti") if again else products, tasks)
    rest = [met(_among(items, many, [item], "left_semi"), products)] if many else []
    rest += [met(single, _among(products, again, keys, "left_semi"))] if again else []
    return out.unionByName(reduce(DataFrame.unionByName, rest).dropDuplicates([item, *keys])) if rest else out


def _repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The keys of more than one row, written; None if there are none."""
    found = written(df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys), "repeated")
    return None if found.isEmpty() else found


def _among(df: DataFrame, found: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """The rows whose keys are (left_semi) or are not (left_anti) among the found ones; nulls are equal."""
    named = found.select(*(F.col(k).alias(f"_f{i}") for i, k in enumerate(keys)))
    return df.join(named, reduce(Column.__and__, (df[k].eqNullSafe(named[f"_f{i}"]) for i, k in enumerate(keys))), how)


def _token_parts(spread: DataFrame, listed: DataFrame, on: Sequence[str]) -> tuple[DataFrame, str, int]:
    """(on, _m, _k): the parts of the items and products of tokens; how to join them; and the tasks for all pairs, 0 for Spark to choose.

    All tokens that both sides have, for an inner join, or of too many those of several parts, for
    a left join. Of these, MOST_HOT have many rows of a side and MOST_TASKS many pairs, at most.
    """
    a, b = spread.groupBy(*on).agg(F.count("*").alias("_a")), listed.groupBy(*on).agg(F.count("*").alias("_b"))
    both = written(a.join(b, list(on)), "tokens")
    pairs = F.col("_a").cast("double") * F.col("_b")
    n, n_a, n_b, n_pairs = (x or 0 for x in both.agg(F.count("*"), F.sum("_a"), F.sum("_b"), F.sum(pairs)).first())
    least = lambda c, total: F.ceil(F.col(c) / max(HOT_TOKEN, total / MOST_HOT))
    each = max(TASK_PAIRS, n_pairs / MOST_TASKS)
    of_pairs = F.ceil(pairs / each)
    # the larger side in more parts, as each row is there once for each part of the other side
    m = F.greatest(least("_a", n_a), F.least(of_pairs, F.ceil(F.sqrt(of_pairs * F.col("_a") / F.col("_b")))))
    parts = both.withColumn("_m", m.cast("int")).withColumn("_k", F.greatest(least("_b", n_b), F.ceil(of_pairs / F.col("_m"))).cast("int")).drop("_a", "_b")
    tasks = max(int(n_pairs // each) + 1, -(-(n_a + n_b) // (10 * HOT_TOKEN))) if n_pairs > TASK_PAIRS else 0
    return (F.broadcast(parts), "inner", tasks) if n <= KNOWN_TOKENS else (F.broadcast(parts.where("_m > 1 or _k > 1")), "left", tasks)


def _dealt(df: DataFrame, on: Sequence[str], known: DataFrame, how: str, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
    """df with own, the part of each row among those of its token, once for each part (other) of the other side."""
    df = df.join(known, list(on), how)
    n = F.coalesce(n_own, F.lit(1))
    place = F.when(n > 1, F.pmod(F.xxhash64(F.monotonically_increasing_id()), n)).otherwise(0).cast("int")
    meets = F.sequence(F.lit(0), F.coalesce(n_other, F.lit(1)) - 1)
    return df.withColumn(own, place).withColumn(other, F.explode(meets)).drop("_m", "_k")


def expanded_aliases(items: DataFrame, column: str, tokens: str, aliases: DataFrame) -> DataFrame:
    """items whose tokens are joined by those of every alias row whose `starts` begins the column."""
    extra = starting(items.select(F.col(column).alias("_probe")).distinct(), "_probe", aliases, "starts")
    extra = extra.groupBy("_probe").agg(F.flatten(F.collect_list("also")).alias("_also"))
    joined = _bring_back(items, column, extra)
    merged = F.array_sort(F.array_union(tokens, F.coalesce("_also", F.array().cast("array<string>"))))
    return joined.withColumn(tokens, merged).drop("_also")


def version_matches(pairs: DataFrame, version: str, ranges: str) -> DataFrame:
    """The pairs whose version lies in one of the ranges."""
    return pairs.where(in_any_range(F.col(version), F.col(ranges)))


def dimension(df: DataFrame, on: str, table: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """df with fields {name: default} of a table with unique keys."""
    named = table.select(F.col(key).alias("_key"), *(F.col(f).alias(f"_d_{f}") for f in fields))
    joined = df.join(named, df[on] == named["_key"], "left")
    return joined.select(*df.columns, *(F.coalesce(F.col(f"_d_{f}"), F.lit(d)).alias(f) for f, d in fields.items()))


def two_hops(df: DataFrame, on: str, first: DataFrame, second: DataFrame, name: str, default: str = "Unknown") -> DataFrame:
    """df with name: df.on -> first(key, value) -> second(key, value), default when either misses."""
    a = first.select(F.col("key").alias("_k1"), F.col("value").alias("_v1"))
    b = second.select(F.col("key").alias("_k2"), F.col("value").alias("_v2"))
    joined = df.join(a, df[on] == a["_k1"], "left").join(b, F.col("_v1") == F.col("_k2"), "left")
    return joined.select(*df.columns, F.coalesce("_v2", F.lit(default)).alias(name))


def on_every_side(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Inner join of several tables by one key."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, key)
    return out


def only_in(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of left that right lacks."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")


def common(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys that both tables have."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_semi")


def is_subset(part: Column, whole: Column) -> Column:
    """Whether an array has no member that another lacks (U5); null if either is."""
    return F.size(F.array_except(part, whole)) == 0


def compared(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key of two tables with `side`: only_left, only_right or both."""
    a = left.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "only_left").otherwise("only_right")
    return a.join(b, list(keys), "full").withColumn("side", side).drop("_a", "_b")


def overlaid(base: DataFrame, over: DataFrame, key: str, texts: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """Rows of both by key: non-blank texts of over win field by field, flags are or-ed."""
    o = over.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_o_{c}") for c in (*texts, *flags)))
    joined = base.join(o, base[key] == o["_key"], "full")
    text = [F.coalesce(F.nullif(F.col(f"_o_{c}"), F.lit("")), base[c]).alias(c) for c in texts]
    flag = [(F.coalesce(F.col(f"_o_{c}"), F.lit(False)) | F.coalesce(base[c], F.lit(False))).alias(c) for c in flags]
    return joined.select(F.coalesce(base[key], F.col("_key")).alias(key), *text, *flag)


def cascade(df: DataFrame, levels: Sequence[tuple[str, DataFrame]], keyword_on: str | None = None, keywords: DataFrame | None = None) -> DataFrame:
    """df with `category` of the first level whose rules (pattern, category) agree.

    levels: (column, rules) from the most specific. A pattern with conflicting categories counts as
    none at its level, and so do keyword rules, which are regular expressions over keyword_on.
    """
    out, found = df, []
    for i, (column, rules) in enumerate(levels):
        agreed = rules.groupBy("pattern").agg(F.min("category").alias(f"_c{i}"), F.count_distinct("category").alias("_n")).where("_n = 1")
        agreed = agreed.select(F.col("pattern").alias(f"_k{i}"), f"_c{i}")
        out = out.join(agreed, out[column] == agreed[f"_k{i}"], "left")
        found.append(F.col(f"_c{i}"))
    if keywords is not None:
        low = F.lower(keyword_on)
        met = F.array_distinct(F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(c)) for p, c in as_literals(keywords, "pattern", "category")))))
        out = out.withColumn("_ck", F.when(F.size(met) == 1, F.get(met, F.lit(0))))
        found.append(F.col("_ck"))
    return out.select(*df.columns, F.coalesce(*found, F.lit("unknown")).alias("category"))


def filled_blanks(df: DataFrame, on: str, table: DataFrame, key: str, pos: str, fields: Sequence[str], defaults: dict[str, str] | None = None) -> DataFrame:
    """df whose blank fields, and those that equal their default, are filled from the first row of the name."""
    first = _best(table.select(F.col(key).alias("_key"), F.col(pos).alias("_pos"), *(F.col(f).alias(f"_f_{f}") for f in fields)), ["_key"], ["_pos"])
    joined = df.join(first, df[on] == first["_key"], "left")
    blank = lambda f: (F.coalesce(F.col(f), F.lit("")) == "") | (F.col(f) == F.lit((defaults or {}).get(f)))
    filled = {f: F.when(F.coalesce(blank(f), F.lit(False)), F.coalesce(F.col(f"_f_{f}"), F.col(f))).otherwise(F.col(f)) for f in fields}
    return joined.select(*(filled[c].alias(c) if c in filled else F.col(c) for c in df.columns))


def not_done(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not among the finished ones."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


#: Files of apps that a task takes on.
TASK_FILES = 250_000


def preferred_splits(files: DataFrame, preferences: DataFrame) -> DataFrame:
    """Files (app, abi, name) without an ABI, and of each app those of the first preferred ABI (abi, rank) that it has.

    Files are counted and dealt out by app in as many tasks as they need, and meet there.
    """
    ranked = files.where("abi is not null and app is not null").join(preferences, "abi").repartition(-(-files.count() // TASK_FILES) or 1, "app")
    chosen = ranked.withColumn("_first", F.min("rank").over(Window.partitionBy("app"))).where("rank = _first").select(*files.columns)
    return files.where("abi is null").unionByName(chosen)
