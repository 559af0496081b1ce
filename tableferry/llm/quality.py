"""Quality rules: base statistics of whole texts and a learned decision list over them.

The list is grown by sequential covering: a conjunction of thresholds is grown literal
by literal on one part of the labelled sample (information gain), pruned from its end on
the other part, and the rows it covers are set aside before the next rule is sought. The
result is an ordered Spark conditional; no Python runs when it is applied.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tableferry.llm.common import fold, labelled_sample

SYMBOLS = b"#*$%&|<>"
BLANKS = b"\t\n\x0b\x0c\r "
WINDOW = 5
#: Labelled documents of each class that are collected for learning, at most.
SAMPLE_PER_CLASS = 4_000

STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_chars", "n_lines", "n_short_lines", "n_long_words", "n_capitals", "n_digits", "n_ends",
)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five words whose content is in the text twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():  # equal windows would have equal hashes
        return 0
    windows = list(zip(*(words[i : i + n] for i in range(WINDOW)), strict=True))
    seen = Counter(windows)
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + WINDOW - max(i, upto)
            upto = i + WINDOW
    return covered


def statistics(text: str | None) -> tuple[int, ...]:
    """The figures named in ``STATISTICS``; NULL counts as no words."""
    if text is None:
        return (0,) * len(STATISTICS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    blanks = int(counts[list(BLANKS)].sum())
    seen, repeated, short, lines = set(), 0, 0, 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            repeated += line in seen
            short += len(line) < 40
            seen.add(line)
    return (
        len(words), len(text) - blanks, int(counts[list(SYMBOLS)].sum()), repeated, repeated_words(words),
        len(text), lines, short, sum(len(w) > 20 for w in words),
        int(counts[65:91].sum()), int(counts[48:58].sum()), int(counts[list(b".!?")].sum()),
    )


def with_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the statistics of each row, by Arrow batches; rows are kept as they are."""

    def batches(frames):
        for batch in frames:
            rows = [statistics(t) for t in batch.column(len(keep)).to_pylist()]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], [*keep, *STATISTICS])

    narrow = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    kept = [f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep]
    return narrow.mapInArrow(batches, ", ".join([*kept, *(f"{s} bigint" for s in STATISTICS)]))


#: What rules may test: shares of the statistics, so that texts of any length compare.
FEATURES = {
    "words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "short_line_share": ("n_short_lines", "n_lines"),
    "long_word_share": ("n_long_words", "n_words"),
    "capital_share": ("n_capitals", "n_chars"),
    "digit_share": ("n_digits", "n_chars"),
    "ends_per_word": ("n_ends", "n_words"),
}


def feature(name: str) -> Column:
    """A feature as an expression; 0 where its denominator is 0."""
    top, bottom = FEATURES[name]
    if bottom is None:
        return F.col(top).cast("double")
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Literal:
    name: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        values = x[:, list(FEATURES).index(self.name)]
        return values > self.threshold if self.above else values <= self.threshold

    def column(self) -> Column:
        value = feature(self.name)
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    literals: tuple[Literal, ...]

    def covers(self, x: np.ndarray) -> np.ndarray:
        held = np.ones(len(x), dtype=bool)
        for literal in self.literals:
            held &= literal.holds(x)
        return held

    def column(self) -> Column:
        out = self.literals[0].column()
        for literal in self.literals[1:]:
            out = out & literal.column()
        return out

    def __str__(self) -> str:
        return " and ".join(f"{l.name} {'>' if l.above else '<='} {l.threshold:.6g}" for l in self.literals)


def _best_literal(x: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray]) -> tuple[float, Literal | None]:
    """The literal of largest information gain for ``bad`` rows, over given thresholds."""
    p, n = bad.sum(), len(bad)
    before, best = math.log2(p / n), (0.0, None)
    for i, name in enumerate(FEATURES):
        order = np.argsort(x[:, i], kind="stable")
        values, positives = x[order, i], np.concatenate([[0], np.cumsum(bad[order])])
        at = np.searchsorted(values, cuts[i], side="right")
        for above, covered, hits in ((False, at, positives[at]), (True, n - at, p - positives[at])):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(hits > 0, hits * (np.log2(hits / covered) - before), 0.0)
            k = int(np.argmax(gain)) if len(gain) else 0
            if len(gain) and gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), Literal(name, above, float(cuts[i][k])))
    return best


def learn(
    x: np.ndarray, bad: np.ndarray, max_rules: int = 12, max_literals: int = 4, precision: float = 0.95, least: int = 5
) -> list[Rule]:
    """An ordered list of rules whose rows are bad; all other rows are good.

    Two of three rows grow a rule, the third prunes it. A rule has to be right on
    ``precision`` of what it covers and to cover ``least`` bad rows, else the list ends.
    No rule comes of an empty sample or one without a bad or without a good row.
    """
    if not len(x) or bad.all() or not bad.any():
        return []
    cuts = []
    for i in range(x.shape[1]):
        points = np.unique(np.quantile(x[:, i], np.linspace(0, 1, 101), method="nearest"))
        cuts.append((points[1:] + points[:-1]) / 2)
    grow, rules, left = np.arange(len(x)) % 3 != 2, [], np.ones(len(x), dtype=bool)
    while len(rules) < max_rules and bad[left & grow].any():
        literals: list[Literal] = []
        inside = left & grow
        while len(literals) < max_literals and not bad[inside].all():
            _, literal = _best_literal(x[inside], bad[inside], cuts)
            if literal is None:
                break
            literals.append(literal)
            inside = inside & literal.holds(x)
        if not literals:
            break
        held_out = left & ~grow
        scores = []
        for k in range(1, len(literals) + 1):
            covered = Rule(tuple(literals[:k])).covers(x) & held_out
            p, n = (covered & bad).sum(), (covered & ~bad).sum()
            scores.append((p - n) / (p + n) if p + n else -1.0)
        rule = Rule(tuple(literals[: int(np.argmax(scores)) + 1]))
        covered = rule.covers(x) & left
        if (covered & bad).sum() < least or (covered & bad).sum() < precision * covered.sum():
            break
        rules.append(rule)
        left &= ~covered
    return rules


def learn_rules(
    docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS
) -> list[Rule]:
    """Rules for documents labelled 0, from a bounded sample outside fold 1."""
    sample = with_statistics(labelled_sample(docs, labels, label, per_class), ["doc_id", "_label"])
    rows = sample.select("_label", *[feature(n).alias(n) for n in FEATURES], "doc_id").toPandas()
    rows = rows.sort_values(["doc_id", *FEATURES], kind="stable")
    return learn(rows[list(FEATURES)].to_numpy(dtype=float), rows["_label"].to_numpy() == 0)


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(rule.column(), F.lit(i)) if out is None else out.when(rule.column(), F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def apply_rules(docs: DataFrame, rules: list[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics, ``base_failed``, ``rule`` and ``kept`` of every row.

    ``rule`` is the number of the rule that speaks against the row, 0 if none. NULL and
    empty texts have no words and fail the base test. Repeated rows stay; an empty table gives no
    rows; other columns are left out.
    """
    rated = with_statistics(docs, [key], text).withColumns(
        {
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "rule": verdict(rules),
        }
    )
    return rated.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def held_out(key: str = "doc_id") -> Column:
    return fold(key) == 1
