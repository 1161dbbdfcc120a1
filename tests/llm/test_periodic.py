"""Periodic runs against brute force (operator 11)."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepscope.llm import periodic

DATA = "/root/testdata/sf0.001"


def brute(words: list) -> list[periodic.Run]:
    """Runs by trying every period at every place."""
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            length = i - start
            if length >= max(6, 4 * q) and not any(
                all(words[j] == words[j - d] for j in range(start + d, i)) for d in range(1, q)
            ):
                found.append((start, length, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id: int | None, text: str | None) -> tuple:
    words = (text or "").encode().split()
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return (
        len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
        hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


blocks = st.lists(
    st.tuples(st.text("abc", min_size=1, max_size=9), st.integers(1, 7), st.integers(1, 40)), max_size=5
)


@given(st.lists(blocks, min_size=1, max_size=3))
def test_runs_equal_brute_force(texts):
    """Texts of repeated blocks, many taken together, give the runs of every single one."""
    words = [[c.encode() for s, times, cut in text for c in (s * times)[:cut]] for text in texts]
    assert periodic.runs_of(words) == [brute(w) for w in words]


def test_runs_of_random_words():
    rng = random.Random(5)
    for letters in ("a", "ab", "abcd"):
        for _ in range(150):
            words = [rng.choice(letters).encode() for _ in range(rng.randrange(90))]
            assert periodic.runs_of([words]) == [brute(words)]


@pytest.mark.parametrize("kind", ["one word", "two words", "two lines", "nested"])
def test_long_texts_of_few_words_take_little_time(kind):
    rng = random.Random(6)
    n = 200_000
    words = {
        "one word": lambda: [b"a"] * n,
        "two words": lambda: [rng.choice([b"a", b"b"]) for _ in range(n)],
        "two lines": lambda: [w for _ in range(n // 4) for w in rng.choice([(b"a", b"b", b"c"), (b"d", b"e", b"f", b"g")])],
        "nested": lambda: ([b"a"] * 50 + [b"b"]) * (n // 51),
    }[kind]()
    start = time.perf_counter()
    (runs,) = periodic.runs_of([words])
    assert time.perf_counter() - start < 10
    if kind == "one word":
        assert runs == [(0, n, 1)]
    if kind == "nested":
        assert (0, len(words), 51) in runs and len(runs) == n // 51 + 1


def test_strongest_is_exact_and_ties_go_to_start_then_period():
    big = 10**16  # as floating-point numbers the two quotients are equal
    assert periodic.strongest([(0, 3 * big, big), (5, 3 * big + 1, big)]) == (5, 3 * big + 1, big)
    assert periodic.strongest([(0, 8, 2), (0, 16, 4), (3, 8, 2)]) == (0, 8, 2)
    assert periodic.strongest([]) is None


def test_collapsed_text_keeps_the_first_period():
    words = b"x a b a b a b a b y".split()
    (runs,) = periodic.runs_of([words])
    assert runs == [(1, 8, 2)]
    assert periodic.collapsed(words, runs) == b"x a b y"


def test_odd_rows(spark):
    rows = [
        (1, None, "r"), (None, "q q q q q q q", "r"), (2, "", "r"), (2, "", "r"),
        (3, " \n\t\x0b\x0c\r ", None), (4, "é é " * 9, "r"), (5, "w " * 70_000 + "v", "r"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    made = periodic.periodic_runs(docs, ["doc_id", "runs"])
    assert made.columns == ["doc_id", "runs", "strongest", "collapsed"]
    got = {r["doc_id"]: r for r in made.collect()}
    assert got[1]["runs"] == [] and got[1]["strongest"] is None and got[1]["collapsed"] == ""
    assert got[None]["collapsed"] == "q"
    assert got[4]["collapsed"] == "é é"  # a no-break space parts no words
    assert [tuple(r) for r in got[5]["runs"]] == [(0, 70_000, 1)]
    assert made.count() == 7
    assert periodic.periodic_runs(docs.limit(0), ["doc_id"]).collect() == []


def test_query_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 2500")
    extra = [(10**6 + i, "a b c " * (i % 9) + "d e " * (i % 5)) for i in range(300)]
    extra += [(None, "u u u u u u u"), (7, None), (8, "")]
    more = spark.createDataFrame(extra, "doc_id long, text string")
    path = f"{tmp_path}/documents.parquet"
    docs.select("doc_id", "text").unionByName(more).write.parquet(path)
    got = sorted(map(repr, (tuple(r) for r in periodic.op11_periodic_runs(spark, str(tmp_path)).collect())))
    want = [(r["doc_id"], *brute_row(r["doc_id"], r["text"])) for r in spark.read.parquet(path).collect()]
    assert got == sorted(map(repr, want))
    assert sum(r[1] > 0 for r in want) > 50
    changed = spark.read.parquet(path).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
    assert changed.count() > 20
