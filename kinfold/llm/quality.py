"""Quality rules as a learned decision list.

Sequential covering: a rule grows one threshold condition at a time by information gain on two thirds of a labelled
sample, is pruned on the other third, and takes the rows it covers out of the sample; rules follow until none is
precise enough. The list is emitted as one ordered Spark conditional expression over the statistics of a text.

Defined results: a null or empty text has no words, so every count is 0 and the base rule rejects it. A list learnt
from no labelled row, or from rows of one class, has no rule and keeps what the base rule keeps. Conditions of equal gain
are settled by the order of ``FEATURES``, then by the lower threshold; the first rule that matches decides. Texts of any
length are measured whole. Repeated rows get the same verdict each; an empty table gives an empty one. Input columns with
the name of a statistic or verdict are replaced by it.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_text

SYMBOLS = "#*$%&|<>"
STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
#: Labelled rows that a list is learnt from, at most.
SAMPLE_ROWS = 20_000


def text_statistics(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word)."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode().split()  # on bytes: exactly 0x20 and 0x09-0x0D separate
    n = len(words)
    if not n:
        return 0, 0, sum(map(text.count, SYMBOLS)), 0, 0, 0
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        end = 0  # the first word not yet counted
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def with_statistics(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) and the statistics of every whole text."""
    keep = df.columns if keep is None else keep
    return map_text(df, text, keep, STATISTICS, lambda texts: list(zip(*map(text_statistics, texts), strict=True)))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: What conditions are on, as Spark expressions over the statistics. None is null for a text with words.
FEATURES: dict[str, str] = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "dup_lines_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "n_words": "n_words",
}


@dataclass
class Rule:
    """A conjunction of (feature, above, threshold): above means value >= threshold, else value < threshold."""

    conditions: list[tuple[str, bool, float]]
    covered: int = 0
    right: int = 0

    def expression(self) -> Column:
        made = F.lit(True)
        for name, above, t in self.conditions:
            x = F.expr(FEATURES.get(name, name)).cast("double")
            made = made & ((x >= F.lit(t)) if above else (x < F.lit(t)))
        return made

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>=' if a else '<'} {t:.6g}" for n, a, t in self.conditions)


@dataclass
class DecisionList:
    """Ordered rules of which each rejects; what none covers is kept."""

    rules: list[Rule] = field(default_factory=list)

    def verdict(self) -> Column:
        """True (keep) unless a rule matches, as ordered conditions."""
        made = None
        for r in self.rules:
            made = F.when(r.expression(), F.lit(False)) if made is None else made.when(r.expression(), F.lit(False))
        return F.lit(True) if made is None else made.otherwise(F.lit(True))

    def which(self) -> Column:
        """The number of the rule that decided, from 1; 0 where none did."""
        made = None
        for i, r in enumerate(self.rules, 1):
            made = F.when(r.expression(), F.lit(i)) if made is None else made.when(r.expression(), F.lit(i))
        return F.lit(0) if made is None else made.otherwise(F.lit(0))


def _holds(x: np.ndarray, condition: tuple[int, bool, float]) -> np.ndarray:
    j, above, t = condition
    return x[:, j] >= t if above else x[:, j] < t


def _gain(p: np.ndarray, n: np.ndarray, p0: int, n0: int) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, g, -np.inf)


def _grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray]) -> list[tuple[int, bool, float]]:
    rule: list[tuple[int, bool, float]] = []
    inside = np.ones(len(y), bool)
    while len(rule) < 6:
        xs, ys = x[inside], y[inside]
        p0, n0 = int(ys.sum()), int((~ys).sum())
        if not p0 or not n0:
            break
        best, most = None, 1e-9
        for j, at in enumerate(cuts):
            if not len(at):
                continue
            slot = np.searchsorted(at, xs[:, j], side="right")
            below_p = np.cumsum(np.bincount(slot[ys], minlength=len(at) + 1))[:-1]
            below_n = np.cumsum(np.bincount(slot[~ys], minlength=len(at) + 1))[:-1]
            for above, p, n in ((True, p0 - below_p, n0 - below_n), (False, below_p, below_n)):
                g = _gain(p, n, p0, n0)
                k = int(np.argmax(g))
                if g[k] > most:
                    best, most = (j, above, float(at[k])), float(g[k])
        if best is None:
            break
        rule.append(best)
        inside &= _holds(x, best)
    return rule


def _prune(rule: list[tuple[int, bool, float]], x: np.ndarray, y: np.ndarray) -> list[tuple[int, bool, float]]:
    """The shortest beginning of the rule with the best (p - n) / (p + n) on rows it did not grow on."""
    best, most, inside = rule, -np.inf, np.ones(len(y), bool)
    for k, c in enumerate(rule, 1):
        inside = inside & _holds(x, c)
        p, n = int(y[inside].sum()), int((~y[inside]).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > most:
            best, most = rule[:k], worth
    return best


def learn(x: np.ndarray, rejected: np.ndarray, names: list[str], *, cuts: int = 128, least_precision: float = 0.9, least_covered: int = 3, most_rules: int = 16, seed: int = 7) -> DecisionList:
    """Sequential covering over rows ``x`` (a column for each name) for the class ``rejected``.

    ``cuts`` candidate thresholds a feature lie midway between neighbouring distinct values at even ranks of the
    rejected and of the kept rows. A rule stands if at least ``least_precision`` of what it covers in all remaining
    rows is rejected and it covers ``least_covered`` of them; so kept documents are left alone.
    """
    x, rejected = np.asarray(x, float), np.asarray(rejected, bool)
    left = np.ones(len(rejected), bool)
    part = np.random.default_rng(seed).random(len(rejected)) < 2 / 3
    rules: list[Rule] = []
    while len(rules) < most_rules and rejected[left].any() and (~rejected[left]).any():
        grow, prune = left & part, left & ~part
        at = []
        for j in range(x.shape[1]):
            values = np.unique(x[grow, j])
            picks = [np.quantile(x[grow & own, j], np.linspace(0, 1, cuts // 2), method="nearest") for own in (rejected, ~rejected) if (grow & own).any()]
            k = np.unique(np.searchsorted(values, np.concatenate(picks))) if picks else np.array([], int)
            k = np.unique(np.concatenate([k, k - 1]))
            k = k[(k >= 0) & (k < len(values) - 1)]
            at.append((values[k] + values[k + 1]) / 2)
        rule = _grow(x[grow], rejected[grow], at)
        if not rule:
            break
        if prune.any():
            rule = _prune(rule, x[prune], rejected[prune])
        inside = left.copy()
        for c in rule:
            inside &= _holds(x, c)
        covered, right = int(inside.sum()), int((inside & rejected).sum())
        if right < least_covered or right < least_precision * covered:
            break
        rules.append(Rule([(names[j], above, t) for j, above, t in rule], covered, right))
        left &= ~inside
    return DecisionList(rules)


def learn_from(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """Fit on at most ``sample_rows`` labelled documents, those of smallest hashed id; only their texts are measured.

    ``label`` 0 means reject. Rows that the base rule rejects are left out, as the list never sees them.
    """
    sample = labels.select(F.col(doc_id).alias("__id"), F.col(label).alias("__label")).dropna().orderBy(F.xxhash64("__id"), "__id", "__label").limit(sample_rows)
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__t")).join(F.broadcast(sample), "__id")
    measured = with_statistics(rows, "__t", ["__id", "__label"]).filter(~base_failed())
    names = list(FEATURES)
    got = measured.select("__id", "__label", *[F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()]).orderBy(F.xxhash64("__id"), "__id", "__label", *names).limit(sample_rows).toPandas()
    return learn(got[names].to_numpy(), (got["__label"] == 0).to_numpy(), names)


def judged(df: DataFrame, rules: DecisionList) -> DataFrame:
    """Add base_failed, rule (the number of the deciding rule) and kept to rows with statistics."""
    return df.withColumns({"base_failed": base_failed(), "rule": rules.which(), "kept": ~base_failed() & rules.verdict()})
