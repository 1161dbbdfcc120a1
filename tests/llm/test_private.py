"""Personal data against plain patterns and hand-made cases (operator 13)."""

from __future__ import annotations

import hashlib
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stepscope.llm import private

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind: str, found: str) -> bool:
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
        return 13 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text: str | None) -> list[tuple[str, int, int]]:
    return [
        (kind, m.start(), m.end())
        for kind, pattern in PLAIN.items()
        for m in re.finditer(pattern, text or "")
        if valid(kind, m[0])
    ]


def base(text: str | None) -> list[tuple[str, int, int]]:
    _, spans = private.proposed(None if text is None else text.encode())
    return [(private.KINDS[s.kind], s.start, s.end) for s in spans if s.base]


PARTS = st.sampled_from(
    ["a", "x.y", "@", ".", "1", "22", "255", "256", "007", "+", "-", " ", "(", ")", "4111111111111111", "é", "日",
     "a@b.c", "1.2.3.4", "+1 (348) 555-4265", "4111 1111 1111 1111", "%", "_", "\n", "0" * 30, " at ", " dot ", "[at]", "::"]
)


@settings(max_examples=1500, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_base_spans_equal_plain_patterns(text):
    assert base(text) == brute(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_proposals_overlap_no_base_span_and_votes_fit(text):
    text, spans = private.proposed(text.encode())
    taken = [(s.start, s.end) for s in spans if s.base]
    assert all(s.end <= a or s.start >= z for s in spans if not s.base for a, z in taken)
    for code, features in private.vote(text, spans):
        assert 0 <= code < 3 ** len(private.LABELERS) and features == sorted(set(features))


@pytest.mark.parametrize("part", ["a", "@", "a@", "1", "1.", "1 ", "+1", "+1 ", "1-", "a.", " at ", "[at]", "::", "a@b.c ", "1.2.3.4 ", "(1) "])
def test_long_texts_take_linear_time(part):
    start = time.perf_counter()
    text, spans = private.proposed(("9" * 14 + " dot @ :: +9 [at] at] " + part * (1_000_000 // len(part))).encode())
    private.vote(text, spans)
    assert time.perf_counter() - start < 40


def test_reliabilities_find_the_good_labeler():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.6
    votes = np.zeros((4000, len(private.LABELERS)), int)
    for j, right in enumerate([0.95, 0.9, 0.85, 0.55]):
        votes[:, j] = np.where(rng.random(4000) < right, truth, ~truth) * 2 - 1
    codes, weight = np.unique((votes + 1) @ 3 ** np.arange(len(private.LABELERS)), return_counts=True)
    right, yes = private.reliabilities(codes, weight.astype(float))
    assert np.abs(right[:4] - [0.95, 0.9, 0.85, 0.55]).max() < 0.04
    known = dict(zip(codes.tolist(), yes, strict=True))
    hit = [(known[c] >= 0.5) == t for c, t in zip(((votes + 1) @ 3 ** np.arange(len(private.LABELERS))).tolist(), truth)]
    assert np.mean(hit) > 0.93


ADDED = {
    "reach john [at] example [dot] com today": ("email", "john [at] example [dot] com"),
    "mail: bob(at)example.com": ("email", "bob(at)example.com"),
    "my phone: 555-123-4567 ok": ("phone", "555-123-4567"),
    "host 2001:4860:4860::8888 is up at 12:30:45": ("ip", "2001:4860:4860::8888"),
}
LEFT = [
    "order 123456789012 shipped", "look at home.Then dot the i", "isbn 978-3-16-148410-0", "the 9807915762804490 words",
    "at 12:30:45 and 1::", "version 2.14.300.9", "sum 1234567890",
]


def test_method_adds_spans_and_leaves_others(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    cases = [*ADDED, *LEFT]
    more = spark.createDataFrame([(10**7 + i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    rows = private.private_spans(docs.unionByName(more), ["doc_id", "text"]).collect()
    assert len(rows) == docs.count() + len(cases)
    for r in rows:
        got = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]]
        assert got == brute(r["text"])
        added = [(s["kind"], r["text"][s["start"] : s["end"]]) for s in r["spans"] if not s["base"]]
        assert added == ([ADDED[r["text"]]] if r["text"] in ADDED else [])


def test_query_equals_plain_patterns(spark, folder, odd, none):
    more = spark.createDataFrame(
        [(20, "x a@b.co 1.2.3.4 y", "en", "s", 5), (20, "x a@b.co 1.2.3.4 y", "en", "s", 5), (21, "é +1 (348) 555-4265 4111 1111 1111 1111", "en", "s", 5),
         (22, "a@b.co " * 30_000, "en", "s", 5)],
        odd.schema,
    )
    docs = odd.unionByName(more).withColumn("spans", odd["source"])
    got = private.op13_private_spans(spark, folder(docs)).collect()
    assert got[0].asDict().keys() == {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}
    want = []
    for r in docs.collect():
        spans = brute(r["text"])
        text = ",".join(f"{k}:{a}:{z}" for k, a, z in spans)
        want.append((r["doc_id"], *(sum(s[0] == k for s in spans) for k in PLAIN), hashlib.sha256(text.encode()).hexdigest(), text))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert private.op13_private_spans(spark, folder(none)).collect() == []


def test_overlapping_additions_keep_the_likeliest():
    model = private.Model(np.zeros(private.DIMS + 1), {})
    model.weights[1], model.weights[2] = 3, 1

    def span(start, end, feature):
        return {"kind": 3, "start": start, "end": end, "base": False, "votes": 0, "features": [feature]}

    found = [span(0, 5, 2), span(4, 9, 1), span(8, 12, 2), span(12, 15, 2), span(12, 15, 2)]
    assert [(s["start"], s["end"]) for s in private.decided(found, model)] == [(4, 9), (12, 15)]
    assert private.decided([], model) == []
