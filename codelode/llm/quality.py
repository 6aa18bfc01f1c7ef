"""Quality rules: a decision list learned by sequential covering.

Every text becomes a row of statistics (one Arrow function, one pass). Rules that mark the bad class are grown on
labelled rows condition by condition (FOIL gain over thresholds), pruned on rows set apart, and kept while they are
right more often than not there; rows they cover leave the training set. The list is emitted as one ordered Spark
conditional expression, so it is applied by the JVM.

The list may be learned from at most ``MAX_LABELLED`` labelled rows, the first by a seeded digest; everything is applied
to all rows. Nulls and empty texts have all statistics 0. A null label or id is not learned from; of repeated labels the
lowest counts. Thresholds lie between at most 200 quantiles of a statistic. Three words in a row are compared by numbers of
21 bits each, which is exact for texts of up to 2,097,152 different words. An input column named as a result is replaced.
With no labelled rows, or one class, the list is empty and keeps every row. Equal texts get equal verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import seeded_digest, tidy

MAX_LABELLED = 20_000
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_line_words", "n_upper", "n_digits", "n_distinct", "n_stops", "max_word"]


def text_counts(text: str) -> tuple[int, ...]:
    """The ``COUNTS`` of one text; words are runs without ASCII white space."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = distinct = 0
    if n:
        ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
        distinct = len(ids)
        if n >= 4:
            at = np.fromiter(map(ids.__getitem__, words), np.int64, n)
            key = (at[:-2] * distinct + at[1:-1]) * distinct + at[2:]
            _, place, count = np.unique(key, return_inverse=True, return_counts=True)
            twice = count[place] >= 2
            if twice.any():
                covered = np.zeros(n, bool)
                for k in range(3):
                    covered[k : n - 2 + k] |= twice
                repeated = int(covered.sum())
    return (
        n,
        len(text) - (len(data) - len(data.translate(None, SPACE))),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        max((x.count(b" ") + 1 for x in lines), default=0),
        len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        len(data) - len(data.translate(None, b"0123456789")),
        distinct,
        sum(w[-1:] in b".!?" for w in words),
        max(map(len, words), default=0),
    )


_STRUCT = pa.struct([(c, pa.int64()) for c in COUNTS])


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
@tidy
def counts_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        rows = np.array([text_counts(t.as_py() or "") for t in texts], np.int64).reshape(-1, len(COUNTS))
        yield pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(COUNTS))], fields=list(_STRUCT))


def with_counts(docs: DataFrame, text_col: str = "text", out: str = "counts") -> DataFrame:
    return docs.withColumn(out, counts_udf(F.col(text_col)))


def features(counts: Column) -> dict[str, Column]:
    """Numbers that thresholds are learned over; ratios of an empty text are 0."""
    c = {name: counts[name].cast("double") for name in COUNTS}
    per = lambda a, b: F.when(c[b] > 0, c[a] / c[b]).otherwise(0.0)
    return {
        "n_words": c["n_words"],
        "word_length": per("word_chars", "n_words"),
        "symbol_rate": per("n_symbols", "word_chars"),
        "dup_line_rate": per("n_dup_lines", "n_lines"),
        "repeat_rate": per("n_repeat_words", "n_words"),
        "line_words": per("n_words", "n_lines"),
        "upper_rate": per("n_upper", "word_chars"),
        "digit_rate": per("n_digits", "word_chars"),
        "distinct_rate": per("n_distinct", "n_words"),
        "stop_rate": per("n_stops", "n_words"),
        "max_word": c["max_word"],
    }


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, table: pd.DataFrame) -> np.ndarray:
        x = table[self.name].to_numpy()
        return x > self.threshold if self.above else x <= self.threshold

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.name] > self.threshold if self.above else of[self.name] <= self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def holds(self, table: pd.DataFrame) -> np.ndarray:
        hit = np.ones(len(table), bool)
        for c in self.conditions:
            hit &= c.holds(table)
        return hit

    def column(self, of: dict[str, Column]) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column(of)
        return out


def _grow(table: pd.DataFrame, bad: np.ndarray, names: list[str], max_conditions: int) -> list[Condition]:
    chosen: list[Condition] = []
    inside = np.ones(len(table), bool)
    while len(chosen) < max_conditions:
        p, n = int((bad & inside).sum()), int((~bad & inside).sum())
        if not p or not n:
            break
        best, gain = None, 1e-9
        for name in names:
            x = table[name].to_numpy()[inside]
            cuts = np.unique(np.quantile(x, np.linspace(0.002, 0.998, 200)))
            order = np.argsort(x, kind="stable")
            below = np.searchsorted(x[order], cuts, side="right")
            bad_below = np.concatenate([[0], np.cumsum(bad[inside][order])])[below]
            for above, pp, all_ in ((False, bad_below, below), (True, p - bad_below, len(x) - below)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where((pp > 0) & (all_ < len(x)), pp * (np.log2(pp / all_) - np.log2(p / (p + n))), -1)
                k = int(np.argmax(g))
                if g[k] > gain:
                    best, gain = Condition(name, above, float(cuts[k])), g[k]
        if best is None:
            break
        x = table[best.name].to_numpy()[inside]
        # Half way to the next value, so that no rule hugs the rows it was learned from.
        best = Condition(best.name, best.above, float((x[x <= best.threshold].max() + x[x > best.threshold].min()) / 2))
        chosen.append(best)
        inside &= best.holds(table)
    return chosen


def _worth(conditions: list[Condition], table: pd.DataFrame, bad: np.ndarray) -> float:
    hit = Rule(tuple(conditions)).holds(table)
    p, n = int((bad & hit).sum()), int((~bad & hit).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn_rules(table: pd.DataFrame, bad: np.ndarray, max_rules: int = 24, max_conditions: int = 4, min_precision: float = 0.8, seed: int = 0) -> list[Rule]:
    """Ordered rules for the bad class; ``table`` has one row a labelled text and one column a feature."""
    names, rng, rules = list(table.columns), np.random.default_rng(seed), []
    while len(rules) < max_rules and bad.sum() >= 3:
        aside = np.zeros(len(table), bool)
        for side in (bad, ~bad):
            own = np.flatnonzero(side)
            aside[rng.permutation(own)[: len(own) // 3]] = True
        grown = _grow(table[~aside], bad[~aside], names, max_conditions)
        if not grown:
            break
        # Drop final conditions as long as the rule does no worse on the rows set apart.
        cuts = [(_worth(grown[:k], table[aside], bad[aside]), -k) for k in range(1, len(grown) + 1)]
        worth, k = max(cuts)
        rule = Rule(tuple(grown[:-k]))
        if worth < 2 * min_precision - 1:
            break
        hit = rule.holds(table)
        rules.append(rule)
        table, bad = table[~hit], bad[~hit]
    return rules


def verdict(rules: list[Rule], of: dict[str, Column]) -> Column:
    """True where no rule marks the row, as one ordered conditional expression."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].column(of), F.lit(False))
    for rule in rules[1:]:
        out = out.when(rule.column(of), F.lit(False))
    return out.otherwise(F.lit(True))


def learn_from(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 11) -> list[Rule]:
    """The decision list of ``labels`` (doc_id, quality 0 or 1) over the texts of ``docs``."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = known.orderBy(seeded_digest(seed, F.col("doc_id")), "doc_id").limit(max_labelled)
    # The sample is bounded by max_labelled rows of two numbers, so it is broadcast.
    counted = with_counts(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"))
    found = features(F.col("counts"))
    table = counted.select("doc_id", "quality", *[c.alias(n) for n, c in found.items()]).toPandas().sort_values(["doc_id", *found]).reset_index(drop=True)
    return learn_rules(table[list(found)], (table["quality"] == 0).to_numpy())


def judge_quality(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The input with ``counts``, ``base_failed`` and ``kept``."""
    counted = with_counts(docs, text_col)
    c = F.col("counts")
    failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules, features(c)))
