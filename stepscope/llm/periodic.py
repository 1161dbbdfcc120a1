"""Periodic runs of words (operator 11).

A run is a stretch of words with smallest period q that no neighbouring word extends and
that holds at least four periods and six words. Runs come from an online sparse dynamic
program: a word that repeats an earlier occurrence makes the diagonal of their distance
(its lag) one match longer, and a diagonal that does not grow ends there and gives its
run, if it is long enough.

Only few earlier occurrences can matter. A run of period q has at least 3q matches in a
row, so for lags of 2^k up to 2^(k+1) a word counts as repeated only if the 2^(k+1) words
that end with it repeat. Occurrences that close overlap each other, so all of them but
one lie at multiples of the distance r to the nearest one. At those multiples the run of
period r has the same ends, so r is their smallest period. That leaves at most one earlier
occurrence for each word and k, and n log n steps for texts of any kind.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepscope.llm.common import map_texts, table

PERIODS = 4  # least length of a run in periods
WORDS = 6  # and in words
BLOCK = 200_000  # words taken together; a longer text is a block of its own

Run = tuple[int, int, int]  # start, length, period


def needed(period: int) -> int:
    """Matches in a row that make a run of this period."""
    return max(WORDS - period, (PERIODS - 1) * period)


def repeats(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word the lags at which it may carry on or start a run.

    `words` holds numbers; texts that follow each other share none, so nothing repeats
    across their border. `longest` is the length of the longest text. Returns places,
    lags and how many matches end there at least, ordered by place.
    """
    found = []
    symbol = words.astype(np.int64)  # of the `size` words that end here, -1 if they do not repeat
    size = 1
    while PERIODS * size <= longest:
        # Both halves have to repeat for the whole to repeat.
        ends = np.flatnonzero((symbol[size:] >= 0) & (symbol[:-size] >= 0)) + size
        if not len(ends):
            break
        pair = symbol[ends - size] * (int(symbol.max()) + 1) + symbol[ends]
        order = np.argsort(pair, kind="stable")
        pair, ends = pair[order], ends[order]
        same = pair[1:] == pair[:-1]
        again = np.concatenate([[False], same])
        group = np.cumsum(~again) - 1
        more = again | np.concatenate([same, [False]])
        symbol = np.full(len(words), -1, np.int64)
        symbol[ends[more]] = group[more]

        least, size = size, 2 * size  # lags from `least`, below `size`
        near = np.zeros(len(ends), np.int64)
        near[1:] = np.where(same, ends[1:] - ends[:-1], 0)
        at = np.flatnonzero((near >= least) & (near < size))
        found.append((ends[at], near[at], np.full(len(at), size)))
        at = np.flatnonzero((near > 0) & (near < least))
        if len(at):
            width = len(words) + size
            line = group * width + ends
            far = ends[np.searchsorted(line, group[at] * width + np.maximum(ends[at] - size + 1, 0))]
            lag = ends[at] - far
            other = (lag > size - near[at]) & (lag % near[at] != 0)
            found.append((ends[at][other], lag[other], np.full(int(other.sum()), size)))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    place, lag, matches = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(place, kind="stable")
    return place[order], lag[order], matches[order]


def diagonals(words: np.ndarray, longest: int) -> list[Run]:
    """All runs of numbered words, in no particular order."""
    runs: list[Run] = []

    def end(ended: dict[int, int], last: int) -> None:
        for lag, matches in ended.items():
            if matches >= needed(lag):
                runs.append((last - matches - lag + 1, matches + lag, lag))

    active: dict[int, int] = {}  # lag -> matches up to the word before, not longer yet
    grown: dict[int, int] = {}  # lag -> matches up to this word
    here = -1
    for place, lag, least in zip(*(x.tolist() for x in repeats(words, longest)), strict=True):
        if place != here:
            end(active, here - 1)
            if place == here + 1:
                active = grown
            else:
                end(grown, here)
                active = {}
            grown, here = {}, place
        grown[lag] = active.pop(lag, least - 1) + 1
    end(active, here - 1)
    end(grown, here)
    return runs


def runs_of(texts: list[list[bytes]]) -> list[list[Run]]:
    """Runs of each text, given as words, by start and then period."""
    number: count = count()
    flat = []
    for words in texts:
        ids: dict[bytes, int] = defaultdict(number.__next__)
        flat.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
    sizes = np.array([len(x) for x in flat], np.int64)
    begin = np.cumsum(sizes) - sizes
    found: list[list[Run]] = [[] for _ in texts]
    runs = sorted(diagonals(np.concatenate([*flat, np.zeros(0, np.int64)]), int(sizes.max(initial=0))))
    # Texts without words share their begin with the next one, which owns the run.
    owners = np.searchsorted(begin, [r[0] for r in runs], side="right") - 1
    for (start, length, period), i in zip(runs, owners.tolist(), strict=True):
        found[i].append((start - int(begin[i]), length, period))
    return [sorted(rows, key=lambda r: (r[0], r[2])) for rows in found]


def strongest(runs: list[Run]) -> Run | None:
    """The run with most periods, compared exactly; ties go to start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)])


RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
FIELDS = [
    T.StructField("runs", T.ArrayType(RUN)),
    T.StructField("strongest", RUN),
    T.StructField("collapsed", T.StringType()),
]


def periodic_runs(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Add all runs of each text, the strongest and the text without repeats to kept columns.

    Words are what white space in ASCII parts. Null, empty and wordless texts have no
    runs, a null strongest run and the collapsed text "". Of runs equally strong that with
    the smallest start, then period, is the strongest. Rows are independent: repeated rows
    get equal results, an empty table gives an empty one, and very long texts are read
    whole. A kept column with the name of a new one gives way.
    """

    def work():
        def of(texts):
            split = [(t or b"").split() for t in texts]
            runs, at = [], 0
            while at < len(split):
                upto, n = at, 0
                while upto < len(split) and (n == 0 or n + len(split[upto]) <= BLOCK):
                    n += len(split[upto])
                    upto += 1
                runs += runs_of(split[at:upto])
                at = upto

            def row(run):
                return None if run is None else dict(zip(RUN.names, run, strict=True))

            return {
                "runs": [[row(r) for r in found] for found in runs],
                "strongest": [row(strongest(found)) for found in runs],
                "collapsed": [collapsed(w, r).decode() for w, r in zip(split, runs, strict=True)],
            }

        return of

    return map_texts(docs, work, FIELDS, keep, text, raw=True)


def edited(text: Column, doc_id: Column) -> Column:
    """The contract's text: that of every tenth document or so is made periodic from some word on.

    A text without an id stays as it is, and one without words too.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(w, a + i % p))
        return F.when(n > 0, F.concat_ws(" ", F.slice(w, 1, a), tail)).otherwise("")

    # A list of one, so that the words are worked out once.
    return F.when(h % 10 == 0, F.transform(F.array(words), repeat)[0]).otherwise(text)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document's (edited) words as counts and digests.

    Null texts have no words and no runs: n_runs 0, nulls for the strongest run, digests
    of empty texts.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", edited(F.col("text"), F.col("doc_id")).alias("text"))
    lines = F.transform(
        "runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])
    )
    top = F.col("strongest")
    return periodic_runs(docs, ["doc_id"]).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"),
        top["length"].alias("length"),
        top["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
