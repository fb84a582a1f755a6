"""Quality classifier: a sparse rule ensemble over text statistics, scored by Spark column expressions.

Small trees are grown on random parts of a bounded labelled sample; every path from a root is a conjunctive rule.
A lasso logistic regression weighs the rules, and those that keep a weight become one column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import held_out, join_small, table, training_ids

#: Rows learned from for each label, trees and their depth, rows and features seen by a tree, lasso weight, steps.
SAMPLE, TREES, DEPTH, TREE_ROWS, TREE_FEATURES, LASSO, STEPS, SEED = 4000, 40, 3, 1500, 5, 0.002, 400, 5
CUTS = 24


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text. Null and empty texts are one empty word on one empty line: words, line_words, distinct_words
    and distinct_lines are 1, all else 0. Every share is taken of at least one."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text).cast("double")
    words, lines = F.split(text, r"[\x20\x09-\x0D]+"), F.split(text, "\n")
    per_char, per_word = F.greatest(chars, F.lit(1.0)), F.size(words).cast("double")
    return {
        "chars": chars,
        "words": per_word,
        "word_length": chars / per_word,
        "line_words": per_word / F.size(lines),
        "distinct_words": F.size(F.array_distinct(words)) / per_word,
        "distinct_lines": F.size(F.array_distinct(lines)).cast("double") / F.size(lines),
        "capitals": _count(text, "[A-Z]") / per_char,
        "digits": _count(text, "[0-9]") / per_char,
        "marks": _count(text, "[!?]") / per_char,
        "stops": _count(text, "[.,;:]") / per_word,
        "symbols": _count(text, r"[#$%&*+=<>^~@_\\|{}\[\]/]") / per_char,
        "bars": _count(text, "[|]") / per_word,
        "beyond_ascii": _count(text, r"[^\x00-\x7F]") / per_char,
    }


Rule = tuple[tuple[str, bool, float], ...]  # (statistic, above, cut) conditions that all hold


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def score(self) -> Column:
        """The probability of label 1 as an expression over the statistics' columns."""
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            holds = None
            for name, above, cut in rule:
                part = F.col(name) > cut if above else F.col(name) <= cut
                holds = part if holds is None else holds & part
            total = total + F.when(holds, w).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], rng: np.random.Generator, path: Rule, depth: int, out: list[Rule]) -> None:
    """Adds the paths of a tree to `out`: splits by Gini gain, at quantiles of the rows that reach the node."""
    if depth == 0 or len(y) < 20 or y.min() == y.max():
        return
    best = (1e-4, None)
    for f in rng.choice(len(names), min(TREE_FEATURES, len(names)), replace=False):
        cuts = np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1]))
        low = x[:, f][None] <= cuts[:, None]
        n = low.sum(1)
        ones = (low & (y == 1)).sum(1)
        fit = (n >= 5) & (n <= len(y) - 5)
        if not fit.any():
            continue
        a, b = ones / np.maximum(n, 1), (y.sum() - ones) / np.maximum(len(y) - n, 1)
        mean = y.mean()
        gain = mean * (1 - mean) - (n * a * (1 - a) + (len(y) - n) * b * (1 - b)) / len(y)
        gain[~fit] = 0
        if gain.max() > best[0]:
            best = (gain.max(), (f, float(cuts[gain.argmax()])))
    if best[1] is None:
        return
    f, cut = best[1]
    for above in (False, True):
        rows = (x[:, f] > cut) == above
        rule = (*path, (names[f], above, cut))
        out.append(rule)
        _grow(x[rows], y[rows], names, rng, rule, depth - 1, out)


def _holds(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, cut in rule:
        column = x[:, names.index(name)]
        out &= column > cut if above else column <= cut
    return out


def fit(x: np.ndarray, y: np.ndarray, share: np.ndarray, names: list[str]) -> RuleEnsemble:
    """x: statistics by column; y: 0 and 1; share: each row's weight. Nothing to learn from gives score 0.5."""
    if not len(y):
        return RuleEnsemble([], [], 0.0)
    rng = np.random.default_rng(SEED)
    rules: list[Rule] = []
    for _ in range(TREES):
        part = np.concatenate([rng.choice(np.flatnonzero(y == k), TREE_ROWS // 2) for k in (0, 1) if (y == k).any()])
        _grow(x[part], y[part], names, rng, (), DEPTH, rules)
    seen: dict[bytes, Rule] = {}
    for rule in sorted(set(rules), key=lambda r: (len(r), r)):
        holds = _holds(rule, x, names)
        if 0 < holds.sum() < len(y):
            seen.setdefault(np.packbits(holds).tobytes(), rule)
    kept = list(seen.values())
    a = np.stack([_holds(r, x, names) for r in kept], axis=1).astype(float) if kept else np.zeros((len(y), 0))
    share = share / share.sum()
    w, mean = np.zeros(a.shape[1]), np.clip((share * y).sum(), 1e-3, 1 - 1e-3)
    bias = float(np.log(mean / (1 - mean)))
    wide = np.hstack([a, np.ones((len(y), 1))])
    rate = 4 / np.linalg.eigvalsh(wide.T @ (wide * share[:, None])).max()
    v, vb, t = w, bias, 1.0
    for _ in range(STEPS):  # accelerated proximal gradient
        slope = share * (1 / (1 + np.exp(-(a @ v + vb))) - y)
        new = v - rate * (a.T @ slope)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * LASSO, 0)
        new_bias, new_t = vb - rate * slope.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / new_t * (new - w), new_bias + (t - 1) / new_t * (new_bias - bias)
        w, bias, t = new, new_bias, new_t
    used = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleEnsemble([kept[i] for i in used], w[used].tolist(), float(bias))


def learn(docs: DataFrame, labels: DataFrame) -> RuleEnsemble:
    """Learns from a bounded sample of labelled documents outside the held-out fifth; only statistics reach the driver.

    The sample holds up to SAMPLE rows of each label; weights restore the labels' shares.
    """
    ids = training_ids(labels.where("quality in (0, 1)"), "quality", SAMPLE)
    found = join_small(docs.select("doc_id", "text"), ids, ["doc_id"])
    stats = statistics(F.col("text"))
    each = F.min(F.struct(*(c.alias(k) for k, c in stats.items()))).alias("s")  # one row for each sampled id and label, however many it has
    rows = found.groupBy("doc_id", "label").agg(each).select("doc_id", "label", "s.*").toPandas().sort_values(["doc_id", *stats])
    whole = {r["quality"]: r["n"] for r in labels.where("quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("quality").agg(F.count("*").alias("n")).collect()}
    y = rows.label.to_numpy()
    share = np.array([whole[k] / max(1, (y == k).sum()) for k in y]) if len(y) else np.zeros(0)
    return fit(rows[list(stats)].to_numpy(float), y, share, list(stats))


def quality(docs: DataFrame, model: RuleEnsemble, limit: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of documents (doc_id, text), a row for each row.

    Null and empty texts are scored like any other by their `statistics`, very long ones whole. Repeated rows give repeated results, an
    empty table an empty one; other columns are not looked at.
    """
    stats = statistics(F.col("text"))
    scored = docs.select("doc_id", *(c.alias(k) for k, c in stats.items())).select("doc_id", model.score().alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
