"""Text quality by a sparse ensemble of rules over statistics of the whole text.

Small trees are grown one on the errors of another, each on half of the rows. Every path from a root
to a node is a rule: a conjunction of comparisons of statistics with thresholds. A logistic model of
the rules is fitted with an absolute penalty on their weights (lasso), which leaves few of them, and
these are compiled into one Spark column expression. Statistics are column expressions as well, each
linear in the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise

#: Labelled rows of each label that a model is fitted on, at most.
LABEL_ROWS = 4000
#: Trees, their depth, the share of rows that one sees, its weight in the sum, and the thresholds of a statistic.
TREES, DEPTH, SEEN, STEP, THRESHOLDS = 60, 3, 0.5, 0.2, 32
#: Rows of a node at least, as a share of all.
LEAST = 0.005
#: Penalties that are tried, in shares of the one that leaves no rule, and the share of the rows that chooses among them.
PENALTIES, HELD_BACK = np.geomspace(0.3, 0.0005, 12), 0.25
TURNS = 300

#: What the text is without all but some of its characters; the counts of those follow.
_ONLY = {"letters": r"\P{L}+", "capitals": r"\P{Lu}+", "digits": r"\P{Nd}+", "stops": r"[^.,;:?!'\"()-]+"}
#: Sets of characters that are counted one by one, which is several times faster.
_COUNTED = {"ends": ".?!", "bangs": "!", "bars": "|", "breaks": "\n", "blanks": " \n\t\r"}
STATISTICS = [
    "log_words", "word_chars", "letter_share", "capital_share", "digit_share", "stop_share", "mark_share", "ends_by_word", "bangs_by_word",
    "bars_by_word", "breaks_by_word", "distinct_words", "distinct_lines",
]


def statistics(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, mark, STATISTICS) of every whole text, written to the shared folder: thirteen doubles, never null, for each.

    mark is a hash of the text. A null text is like an empty one, whose statistics are all 0.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    chars = F.char_length("t")
    number = lambda of: sum((chars - F.char_length(F.replace("t", F.lit(c), F.lit(""))) for c in of), F.lit(0))
    counts = [F.char_length(F.regexp_replace("t", p, "")).alias(n) for n, p in _ONLY.items()] + [number(of).alias(n) for n, of in _COUNTED.items()]
    spaced = F.col("t")
    for blank in "\n\t\r":
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    parts = [F.array_remove(F.split(c, by), "").alias(n) for n, c, by in (("w", spaced, " "), ("l", F.col("t"), "\n"))]
    rows = rows.select("id", F.xxhash64("t").alias("mark"), *counts, chars.alias("chars"), *parts)
    sizes = [F.size(c).alias(f"n_{c}") for c in "wl"] + [F.size(F.array_distinct(c)).alias(f"d_{c}") for c in "wl"]
    rows = rows.select(*(c for c in rows.columns if c not in ("w", "l")), *sizes).withColumn("ink", F.col("chars") - F.col("blanks"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).cast("double")
    rows = rows.withColumn("marks", F.col("ink") - F.col("letters") - F.col("digits") - F.col("stops"))
    values = [
        F.log1p("n_w"), share("ink", "n_w"), share("letters", "ink"), share("capitals", "letters"), share("digits", "ink"), share("stops", "ink"), share("marks", "ink"), share("ends", "n_w"), share("bangs", "n_w"),
        share("bars", "n_w"), share("breaks", "n_w"), share("d_w", "n_w"), share("d_l", "n_l"),
    ]
    return materialise(rows.select("id", "mark", *(v.alias(s) for v, s in zip(values, STATISTICS, strict=True))), "statistics")


#: A comparison: number of the statistic, threshold, and whether values over it (or else those up to it) are meant.
Comparison = tuple[int, float, bool]


@dataclass
class Model:
    """The log odds of label 1: an offset, and a weight for each rule that holds."""

    offset: float
    rules: list[tuple[tuple[Comparison, ...], float]]

    def score(self) -> Column:
        """The probability of label 1 as a column expression over STATISTICS."""
        total = F.lit(self.offset)
        for rule, weight in self.rules:
            total = total + F.when(_holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _holds(rule: tuple[Comparison, ...]) -> Column:
    out = F.lit(True)
    for s, threshold, over in rule:
        out = out & ((F.col(STATISTICS[s]) > threshold) if over else (F.col(STATISTICS[s]) <= threshold))
    return out


def _kept(x: np.ndarray, rule: tuple[Comparison, ...]) -> np.ndarray:
    return np.logical_and.reduce([(x[:, s] > t) == over for s, t, over in rule])


def _tree(codes: np.ndarray, edges: list[np.ndarray], target: np.ndarray, weight: np.ndarray, least: float) -> list[tuple[tuple[Comparison, ...], np.ndarray, float]]:
    """The nodes of a tree by least squares on target: the path, the rows, the mean; the leaves are those without a later node under them."""
    out = []

    def grow(rows: np.ndarray, path: tuple[Comparison, ...]) -> None:
        w, y = weight[rows], target[rows]
        out.append((path, rows, float((w * y).sum() / w.sum())))
        if len(path) == DEPTH:
            return
        best = (1e-12, 0, 0)
        for s, cuts in enumerate(edges):
            if len(cuts):
                mass = np.cumsum(np.bincount(codes[rows, s], w, len(cuts) + 1))[:-1]
                sums = np.cumsum(np.bincount(codes[rows, s], w * y, len(cuts) + 1))[:-1]
                right, rest = w.sum() - mass, (w * y).sum() - sums
                fits = (mass >= least) & (right >= least)
                gain = np.where(fits, sums**2 / np.maximum(mass, 1e-12) + rest**2 / np.maximum(right, 1e-12), 0) - (w * y).sum() ** 2 / w.sum()
                k = int(gain.argmax())
                if fits[k] and gain[k] > best[0]:
                    best = (float(gain[k]), s, k)
        gain, s, k = best
        if gain > 1e-12:
            over = codes[rows, s] > k
            for side in (False, True):
                grow(rows[over == side], (*path, (s, float(edges[s][k]), side)))

    grow(np.arange(len(target)), ())
    return out


def _plain(path: tuple[Comparison, ...]) -> tuple[Comparison, ...]:
    """The path with one comparison of each kind, in order, so that equal rules are equal."""
    tight: dict[tuple[int, bool], float] = {}
    for s, t, over in path:
        tight[s, over] = (max if over else min)(t, tight.get((s, over), t))
    return tuple(sorted((s, t, over) for (s, over), t in tight.items()))


def _paths(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[tuple[Comparison, ...]]:
    """The distinct rules of all trees."""
    rng = np.random.default_rng(11)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, THRESHOLDS + 2)[1:-1], method="lower")) for c in x.T]
    codes = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    total = np.full(len(y), 0.0)
    rules: dict[tuple[Comparison, ...], None] = {}
    for _ in range(TREES):
        seen = np.flatnonzero(rng.random(len(y)) < SEEN)
        if not len(seen):
            continue
        error = y - 1 / (1 + np.exp(-total))
        nodes = _tree(codes[seen], edges, error[seen], weight[seen], LEAST * weight.sum())
        for path, _rows, mean in nodes[1:]:
            rules[_plain(path)] = None
            if len(path) == DEPTH or not any(p[: len(path)] == path and len(p) > len(path) for p, _, _ in nodes):
                total[_kept(x, path)] += STEP * 4 * mean
    return list(rules)


def _lasso(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, start: np.ndarray) -> np.ndarray:
    """Offset and weights of the logistic model with the least loss and penalty, by accelerated proximal steps."""
    design = np.column_stack([np.ones(len(z)), z])
    share = weight / weight.sum()
    step = 4 / np.linalg.norm(design * np.sqrt(share)[:, None], 2) ** 2
    at, ahead, t = start.copy(), start.copy(), 1.0
    for _ in range(TURNS):
        slope = design.T @ (share * (1 / (1 + np.exp(-np.clip(design @ ahead, -500, 500))) - y))
        new = ahead - step * slope
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        at, ahead = new, new + (was - 1) / t * (new - at)
    return at


def _loss(z: np.ndarray, y: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> tuple[float, float]:
    """The mean loss and its standard error."""
    odds = beta[0] + z @ beta[1:]
    each = weight / weight.mean() * np.logaddexp(0, np.where(y > 0, -odds, odds))
    return float(each.mean()), float(each.std() / np.sqrt(len(each)))


def learn(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """The model of labels y (0 or 1) of rows of STATISTICS x, which count by weight."""
    if not len(y):
        return Model(0.0, [])
    ones = float((weight * y).sum())
    alone = Model(float(np.log((ones + 0.5) / (weight.sum() - ones + 0.5))), [])
    rules = _paths(x, y, weight) if len(set(y.tolist())) == 2 else []
    if not rules:
        return alone
    # of rules that hold for the same rows, the first and so the shortest
    columns = {_kept(x, r).tobytes(): r for r in sorted(rules, key=len, reverse=True)}
    rules = list(columns.values())
    z = np.column_stack([_kept(x, r) for r in rules]).astype(float)
    rng = np.random.default_rng(5)
    held = rng.random(len(y)) < HELD_BACK
    start = np.append(alone.offset, np.zeros(len(rules)))
    most = np.abs(z.T @ (weight * (y - ones / weight.sum()))).max() / weight.sum()
    tried, beta = [], start
    for share in PENALTIES if held.any() and not held.all() else ():
        beta = _lasso(z[~held], y[~held], weight[~held], share * most, beta)
        tried.append((*_loss(z[held], y[held], weight[held], beta), share * most))
    # the largest penalty whose loss is within a quarter of a standard error of the least: fewer rules, as good
    enough = min(tried)[0] + min(tried)[1] / 4 if tried else 0.0
    penalty = max((p for loss, _, p in tried if loss <= enough), default=PENALTIES[0] * most)
    beta = _lasso(z, y, weight, penalty, start)
    return Model(float(beta[0]), [(r, float(b)) for r, b in zip(rules, beta[1:], strict=True) if abs(b) > 1e-4])


def fit(counted: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> Model:
    """A model of labels' column label for the ids of counted, a table of `statistics`.

    It is fitted on at most LABEL_ROWS ids of each label, the least hash of each of that many
    strata, and counts labels by their shares among all labelled ids. Labels but 0 and 1, null ids
    and ids without a text are passed over; an id with both labels has label 0; of texts that
    repeat an id, the one of the least hash counts. Without labels every score is one half; with
    one label alone, or one text, the score is the label's smoothed share.
    """
    ids = labels.where(F.col(label).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
    ids = ids.where("id is not null").groupBy("id").agg(F.min("label").alias("label")).withColumn("at", F.xxhash64(F.lit("quality"), "id"))
    stratum = F.pmod(F.xxhash64("at"), F.lit(LABEL_ROWS)).alias("stratum")
    picked = ids.groupBy("label", stratum).agg(F.min_by("id", "at").alias("id"), F.count("*").alias("of"))  # 2 * LABEL_ROWS rows at most
    met = counted.join(F.broadcast(picked.drop("stratum")), "id")
    one = met.groupBy("id", "label", "of").agg(F.min_by(F.array(*STATISTICS), "mark").alias("x"))
    rows = one.orderBy("label", F.xxhash64("id"), "id").collect()
    y, of = np.array([r.label for r in rows], int), np.array([r.of for r in rows], float)
    by_label = [of[y == k].mean() if (y == k).any() else 0.0 for k in (0, 1)]
    return learn(np.array([r.x for r in rows]), y.astype(float), np.array(by_label)[y] if rows else of)


def score(counted: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id_col, score, predicted) of every row of counted, a table of `statistics`.

    score is the probability of label 1, and predicted is 1 where it is one half or more, for null
    and empty texts too. Rows that repeat an id, null ones too, are scored each; an empty table
    gives no rows.
    """
    scored = counted.select(F.col("id").alias(id_col), model.score().alias("score"))
    return scored.select("*", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
