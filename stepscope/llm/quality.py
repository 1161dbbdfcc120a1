"""Quality by weak supervision (operator 2).

Rules look at one measure each and vote good, vote bad or abstain. How far each rule
can be trusted is estimated without labels by expectation-maximisation over the counts
of vote patterns in the whole corpus; a text is kept if its posterior probability of
being good reaches a threshold. A text need not pass every rule.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepscope.llm.common import aside, back, map_texts, stored, table

MIN_WORDS = 10
MAX_REPEATED = 20  # percent of words in repeated windows
WINDOW = 5
KEEP_AT = 0.5  # posterior probability of good

WHITE = b"\t\n\x0b\x0c\r "
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
FOLLOWING = bytes(range(128, 192))  # UTF-8 bytes that do not begin a code point
ENDS = (b".", b"!", b"?")

MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_lower", "n_digits", "n_punct", "n_distinct", "n_ends", "n_marks", "n_stutter",
]


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of `size` words that occur twice or more, first ones included."""
    if len(words) <= size:
        return 0
    windows = list(zip(*[words[i:] for i in range(size)]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    often = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(often), 1)
    np.add.at(covered, np.flatnonzero(often) + size, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def measure(text: bytes | None) -> tuple:
    """The measures of one text in the order of MEASURES; null counts as without words."""
    if not text:
        return (0,) * len(MEASURES)

    def count(kind: bytes) -> int:
        return len(text) - len(text.translate(None, kind))

    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - count(WHITE) - count(FOLLOWING),
        count(SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        count(UPPER),
        count(LOWER),
        count(DIGITS),
        count(PUNCTUATION),
        len(set(words)),
        sum(w.endswith(ENDS) for w in words),
        len(words) - len(text.translate(None, PUNCTUATION).split()),  # words of marks alone
        sum(map(eq, words, words[1:])),  # words equal to the one before
    )


@dataclass(frozen=True)
class Rule:
    """Bad at or beyond `bad`, good up to `good`, abstains between and below `least` words."""

    name: str
    value: Callable[[dict], np.ndarray]
    good: float
    bad: float
    least: int = 1

    def vote(self, m: dict) -> np.ndarray:
        x, up = self.value(m), self.bad > self.good
        bad = x >= self.bad if up else x <= self.bad
        good = x <= self.good if up else x >= self.good
        return np.where(m["n_words"] < self.least, 0, np.where(bad, -1, np.where(good, 1, 0)))


def _per(top: str, bottom: str) -> Callable[[dict], np.ndarray]:
    return lambda m: m[top] / np.maximum(m[bottom], 1)


RULES = [
    Rule("symbols", _per("n_symbols", "n_words"), 0.02, 0.1),
    Rule("punctuation", _per("n_punct", "n_words"), 0.35, 0.7),
    Rule("marks", _per("n_marks", "n_words"), 0.03, 0.2),
    Rule("capitals", lambda m: m["n_upper"] / np.maximum(m["n_upper"] + m["n_lower"], 1), 0.15, 0.4),
    Rule("word_length", lambda m: np.abs(m["word_chars"] / np.maximum(m["n_words"], 1) - 5.5), 2.5, 5.5),
    Rule("repeated", _per("n_repeat_words", "n_words"), 0.05, 0.2),
    Rule("stutter", _per("n_stutter", "n_words"), 0.05, 0.2),
    Rule("lines", _per("n_dup_lines", "n_lines"), 0.02, 0.4, least=20),
    Rule("variety", _per("n_distinct", "n_words"), 0.25, 0.1, least=50),
    Rule("sentences", lambda m: np.abs(m["n_ends"] / np.maximum(m["n_words"], 1) - 0.12), 0.11, 0.4, least=20),
    Rule("digits", _per("n_digits", "word_chars"), 0.05, 0.25),
    Rule("length", lambda m: m["n_words"], 30, MIN_WORDS - 1, least=0),
]


def votes(m: dict, rules: list[Rule] = RULES) -> np.ndarray:
    """One number per text that holds all votes, three values a rule."""
    code = np.zeros(len(m["n_words"]), np.int64)
    for rule in reversed(rules):
        code = code * 3 + rule.vote(m) + 1
    return code


def opened(codes: np.ndarray, n: int) -> np.ndarray:
    """Votes from codes: 0 bad, 1 none, 2 good."""
    return codes[:, None] // 3 ** np.arange(n) % 3


def fit(counts: dict[int, int], n: int = len(RULES), rounds: int = 100) -> dict[int, float]:
    """Posterior probability of good for each vote pattern seen.

    Rules are taken as independent given the class, and an abstention says nothing.
    Each has a rate of bad votes per class, smoothed by one vote each way. Junk of one kind fails few of
    the rules, so the start is not the majority: a text without a bad vote is likely
    good, one with two is likely bad. A rule whose bad votes turn out to be commoner
    among good texts loses its say. With no texts there are no patterns.
    """
    if not counts:
        return {}
    codes = np.array(sorted(counts))
    weight = np.array([counts[c] for c in codes], float)
    cast = opened(codes, n)
    good = np.array([0.95, 0.5, 0.05])[np.minimum((cast == 0).sum(1), 2)]
    one = cast[:, :, None] == np.array([0, 2])
    for _ in range(rounds):
        seen = [np.einsum("p,prv->rv", p * weight, one) + 1 for p in (good, 1 - good)]
        rates = [x / x.sum(1, keepdims=True) for x in seen]
        useful = rates[0][:, 0] < rates[1][:, 0]
        log = [
            np.log((p * weight).sum() + 1) + np.einsum("prv,rv->p", one, np.log(rate) * useful[:, None])
            for p, rate in zip((good, 1 - good), rates)
        ]
        new = 1 / (1 + np.exp(np.clip(log[1] - log[0], -500, 500)))
        moved, good = np.abs(new - good).max(), new
        if moved < 1e-7:
            break
    return dict(zip(codes.tolist(), good.tolist(), strict=True))


FIELDS = [T.StructField(n, T.LongType()) for n in [*MEASURES, "votes"]]


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Measures and votes of each text, beside the kept columns."""

    def work():
        def of(texts):
            rows = np.array([measure(t) for t in texts], np.int64).reshape(-1, len(MEASURES))
            m = dict(zip(MEASURES, rows.T, strict=True))
            return m | {"votes": votes(m)}

        return of

    return map_texts(docs, work, FIELDS, keep, text, raw=True)


def verdicts(rows: DataFrame, posterior: dict[int, float], keep_at: float = KEEP_AT) -> DataFrame:
    """Add base_failed, quality (the posterior) and kept to measured rows."""
    spark = rows.sparkSession
    known = spark.createDataFrame(
        list(posterior.items()), "votes long, quality double"
    )  # at most 3 ** number of rules rows, far fewer in fact
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")
    )
    return (
        rows.join(F.broadcast(known), "votes", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.coalesce("quality", F.lit(0.0)) >= keep_at))
    )


def patterns(rows: DataFrame) -> dict[int, int]:
    """How often each vote pattern occurs in the corpus."""
    return {r["votes"]: r["n"] for r in rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = stored(measured(docs, ["doc_id"]), "quality")
    return verdicts(rows, fit(patterns(rows))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "quality",
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that the verdict keeps, with their columns.

    Votes are counted in a first pass and worked out again in the second, which is
    cheaper than storing every text once more.
    """
    posterior = fit(patterns(measured(docs, [])))
    own, names = aside(docs)
    judged = verdicts(measured(own, [*names.values()], names["text"]), posterior)
    return judged.where("kept").select(*back(names))
