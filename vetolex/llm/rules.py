"""Quality rules as a learned decision list.

Per-document statistics are counted over whole texts.  Sequential covering then learns, from
labelled statistics, an ordered list of conjunctions of thresholds that each describe rejected
documents: a rule is grown condition by condition on one part of the rows, pruned on the other,
and kept while it is precise there.  The list is emitted as one ordered Spark conditional.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, shingles, stash, text_bytes

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower",
          "n_digits", "n_marks")
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?"
#: Bound on the labelled rows that rules are learned from, taken by hash of doc_id.
MAX_LABELLED = 20_000


def repeated_words(h: np.ndarray, k: int = 3) -> int:
    """Words that lie in a k-word window found at two or more places."""
    g = shingles(h, k)
    if len(g) < 2:
        return 0
    s = np.sort(g)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(g, twice))
    cover = np.zeros(len(h) + 1, np.int32)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def counts_of(raw: bytes, hashes: WordHashes) -> tuple:
    """The COUNTS of one text, in order."""
    chars = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    space = int(chars[9:14].sum() + chars[32])
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(words), int(chars.sum() - chars[128:192].sum()) - space, int(chars[list(SYMBOLS)].sum()),
            len(lines) - len(set(lines)), repeated_words(hashes.array(words)), len(lines), int(chars[65:91].sum()),
            int(chars[97:123].sum()), int(chars[48:58].sum()), int(chars[list(MARKS)].sum()))


def statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, COUNTS...)`` per document; null and empty texts count zero."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = [counts_of(x.as_py(), hashes) for x in batch.column(1)]
            columns = np.array(rows, np.int64).reshape(-1, len(COUNTS)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in columns]], ["doc_id", *COUNTS])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(count, schema)


#: Interpretable statistics that rules may test, from the counts.
FEATURES = {
    "n_words": ("n_words", None), "mean_word": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"),
    "marks_per_word": ("n_marks", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"), "upper_per_char": ("n_upper", "word_chars"),
    "lower_per_char": ("n_lower", "word_chars"), "digits_per_char": ("n_digits", "word_chars"),
}


def feature(name: str) -> Column:
    top, bottom = FEATURES[name]
    return F.col(top).cast("double") if bottom is None else F.col(top) / F.greatest(F.col(bottom), F.lit(1))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = x[self.feature]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        return feature(self.feature) > self.threshold if self.above else feature(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def _covers(rule: list[Condition], x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, open_: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> list[Condition]:
    """Add the condition of greatest information gain until the rule covers no good row."""
    rule, covered = [], open_.copy()
    while len(rule) < most and (~bad[covered]).any():
        p, n = bad[covered].sum(), (~bad[covered]).sum()
        before = np.log2(p / (p + n))
        best, gain = None, 1e-9
        for name, thresholds in cuts.items():
            v = x[name][covered]
            b = bad[covered]
            order = np.argsort(v, kind="stable")
            upto = np.searchsorted(v[order], thresholds, side="right")
            low_p = np.r_[0, np.cumsum(b[order])][upto]
            low_n = upto - low_p
            for above, ps, ns in ((False, low_p, low_n), (True, p - low_p, n - low_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(ps > 0, ps * (np.log2(ps / (ps + ns)) - before), 0.0)
                i = int(np.argmax(g))
                if g[i] > gain:
                    best, gain = Condition(name, above, float(thresholds[i])), g[i]
        if best is None:
            break
        rule.append(best)
        covered &= best.holds(x)
    return rule


def _worth(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray, open_: np.ndarray) -> float:
    c = _covers(rule, x) & open_
    p, n = int(bad[c].sum()), int((~bad[c]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, max_rules: int = 12, max_conditions: int = 4,
          n_cuts: int = 64) -> list[list[Condition]]:
    """Sequential covering; two thirds of the rows grow rules, every third row prunes and judges."""
    n = len(bad)
    judge = np.arange(n) % 3 == 2
    cuts = {f: np.unique(np.quantile(v, np.linspace(0, 1, n_cuts + 1)[:-1])) for f, v in x.items()} if n else {}
    open_, rules = np.ones(n, bool), []
    while len(rules) < max_rules and (bad & open_ & ~judge).any():
        rule = _grow(x, bad, open_ & ~judge, cuts, max_conditions)
        while len(rule) > 1 and _worth(rule[:-1], x, bad, open_ & judge) >= _worth(rule, x, bad, open_ & judge):
            rule = rule[:-1]
        if not rule or _worth(rule, x, bad, open_ & judge) < 2 * precision - 1:
            break
        rules.append(rule)
        open_ &= ~_covers(rule, x)
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """True: keep.  The first rule that holds rejects; without one the document is kept."""
    out = F.lit(True)
    for rule in reversed(rules):
        holds = rule[0].column()
        for c in rule[1:]:
            holds &= c.column()
        out = F.when(holds, F.lit(False)).otherwise(out)
    return out


def learn_rules(stats: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> list[list[Condition]]:
    """Rules from at most ``max_labelled`` labelled rows (label 0: rejected), taken by hash of doc_id.

    Only numbers of these rows reach the driver.  Without labelled rows there are no rules."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("__label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id", "__label").limit(max_labelled)
    rows = (stats.join(some, "doc_id").select(F.xxhash64("doc_id").alias("h"), "doc_id", "__label", *[feature(f).alias(f"f_{f}") for f in FEATURES])
            .orderBy("h", "doc_id", "__label").toPandas())
    return learn({f: rows[f"f_{f}"].to_numpy(float) for f in FEATURES}, rows["__label"].to_numpy() == 0)


def judge_documents(docs: DataFrame, labels: DataFrame, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """``(doc_id, COUNTS..., base_failed, kept)`` per document.

    ``base_failed``: fewer than ``min_words`` words, or more than that share of repeated words.
    The rest is decided by the learned list.  Null and empty texts fail the base; repeated rows
    get equal verdicts; an empty table gives an empty result.  Texts are read once, only counts
    are written, and nothing is shuffled but the labelled sample."""
    stats = stash(statistics(docs), "statistics")
    rules = learn_rules(stats, labels)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))
