"""Phrase counts and collocations against brute force (operator 12)."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stepscope.llm import phrases


def brute_counts(rows, least):
    found, sizes = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, 5):
                found.update((lang, " ".join(words[i : i + k])) for i in range(len(words) - k + 1))
    return {k: n for k, n in found.items() if n >= least}, {k: n for k, n in sizes.items() if n}


def brute(rows, least=30, top=2000):
    f, sizes = brute_counts(rows, 1)
    candidates = {(lang, p): a for (lang, p), a in f.items() if " " in p and a >= least}
    around = Counter()
    for (lang, p), a in candidates.items():
        w = p.split(" ")
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                key = lang, " ".join(w[i : i + size])
                around[key] = max(around[key], a)
    rows = []
    for (lang, p), a in candidates.items():
        if 100 * around[lang, p] >= 80 * a:
            continue
        w = p.split(" ")
        cuts = [(f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])], k) for k in range(1, len(w))]
        score, _, left, right = min((2000000 * a // (x + y), k, x, y) for x, y, k in cuts)
        rows.append((lang, -score, -a, p.encode(), left, right))
    out, place = [], Counter()
    for lang, score, a, p, left, right in sorted(rows):
        place[lang] += 1
        if place[lang] <= top:
            out.append((lang, place[lang], p.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


ODD = [
    ("en", "The cat. the CAT, the cat\tsat; cat sat on\nthe é É mat " * 9),
    ("en", None), (None, "und words und words " * 20), ("und", "und words"), ("fr", ""), ("fr", " \t..\n"),
    ("fr", "x y z w x y z w " * 15), ("fr", "x y z w x y z w " * 15), ("de", "a " * 70_000), ("de", "ÿ \xa0   b"),
    ("d\ne", "k l m\x0bk l m\x0ck l m " * 12), ("", "k l m " * 40),
]


@pytest.mark.parametrize("budget", [phrases.BUDGET, 6, 1])
def test_counts_equal_brute_force(spark, budget, monkeypatch):
    """Whatever fits into a group: prefixes are extended by up to three words."""
    monkeypatch.setattr(phrases, "HOT", 10**9)
    words = [f"v{i % 7}" for i in range(3000)] + [f"t{i * i % 13} " for i in range(2000)]
    rows = [*ODD, ("en", " ".join(words))]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got, sizes = phrases.phrase_counts(docs, least=5, budget=budget)
    want, want_sizes = brute_counts(rows, 5)
    made = [((r["lang"], r["phrase"]), r["f"]) for r in got.collect()]
    assert len(made) == len(dict(made)) and dict(made) == want
    assert {r["lang"]: r["n"] for r in sizes.collect()} == want_sizes


def test_collocations_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text")
    docs = docs.unionByName(spark.createDataFrame(ODD, "lang string, text string"))
    rows = [tuple(r) for r in docs.collect()]
    counts = [df.cache() for df in phrases.phrase_counts(docs, least=4)]
    for top in (2000, 3):
        got = phrases.collocations(*counts, least=4, top=top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, 4, top)


def test_empty_tables(spark, folder, none, odd):
    assert phrases.op12_collocations(spark, folder(none)).collect() == []
    assert phrases.op12_collocations(spark, folder(odd.limit(3))).collect() == []


def test_scores_beyond_64_bits_are_exact(spark):
    big = 10**13 + 7
    rows = [("en", "a b", big), ("en", "a", 3 * big + 1), ("en", "b", big)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, f long")
    sizes = spark.createDataFrame([("en", 9 * big)], "lang string, n long")
    (row,) = phrases.collocations(counts, sizes).collect()
    assert row["score"] == 2000000 * big // (4 * big + 1)


def test_long_texts_are_cut_at_borders_only(monkeypatch):
    monkeypatch.setattr(phrases, "LONG", 10)
    text = b"one two three four, five. six" + b"x" * 40 + b"\nend"
    parts = list(phrases.stretches(text))
    assert len(parts) > 2 and b"".join(parts) == text.translate(phrases.TABLE)
    assert all(p.startswith(phrases.BORDER) for p in parts[1:])


def test_filters_hold_what_is_frequent(spark):
    rng = np.random.default_rng(3)
    words = [f"wörd{i}" for i in rng.zipf(1.3, 30_000) % 5000]
    docs = spark.createDataFrame([("en", " ".join(words[i : i + 100])) for i in range(0, 30_000, 100)], "lang string, text string")
    docs = docs.repartition(6)
    for bits in (16, 18):
        rows = phrases.scan(docs, phrases.bucket_counts([], bits, 30), phrases.COUNTS)
        made = phrases.filter_of(rows, bits, 30)
        keys = {w: xxhash.xxh64_intdigest(w.encode(), xxhash.xxh64_intdigest(b"en")) for w in set(words)}
        total = Counter()
        for w, n in Counter(words).items():
            total[keys[w] >> (64 - bits)] += n
        order = sorted(keys)
        passed = made.passes(np.array([keys[w] for w in order], np.uint64))
        assert passed.tolist() == [total[keys[w] >> (64 - bits)] >= 30 for w in order]


def test_hot_prefixes_are_extended(spark):
    rows = [("en", "p", f"a{i}", f"b{i % 3}", "", 1) for i in range(50)] + [("en", "p", "a", f"c{i}", f"d{i}", 2) for i in range(50)]
    leaves = spark.createDataFrame(rows, "lang string, w1 string, w2 string, w3 string, w4 string, f long")
    dealt, upper = phrases.grouped(leaves, 20)
    depth = {(r["w2"], r["w3"]): r["depth"] for r in dealt.collect()}
    assert depth["a1", "b1"] == 2 and depth["a", "c1"] == 3
    assert [[tuple(r) for r in inner.collect()] for inner in upper] == [[("en", "p", 150)], [("en", "p a", 100)]]
    assert dealt.groupBy("group").count().agg(F.max("count")).first()[0] < 50
