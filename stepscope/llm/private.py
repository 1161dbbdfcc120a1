"""Personal data by weak supervision (operator 13).

Broad patterns propose spans. Labelers of three sorts vote on each or abstain: patterns
look at its form, gazetteers at its parts (domain endings, calling codes, card prefixes,
reserved networks), context labelers at what stands around it. How far each labeler can
be trusted is estimated without labels by expectation-maximisation over the counts of
vote patterns in the whole corpus. The posteriors then train a span classifier on
features of span and context, whose probability decides about every span that is not of
the base patterns; those always stay.
"""

from __future__ import annotations

import ipaddress
import re
import zlib
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stepscope.llm.common import map_texts, stored, table

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "form", "gazetteer", "words", "borders", "company", "digits")
REPORT_AT = 0.5  # probability of the classifier
SAMPLE = 4000  # distinct spans of each kind and likely label that the classifier learns from
DIMS = 4096  # hashed features
NEAR = 60  # characters of context
SMOOTH = 20.0  # votes that a labeler is taken to have cast at the start

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NON_DIGITS = re.compile("[^0-9]+")
NO_NAME = re.compile("[^A-Za-z0-9-]+")
DIGITS = b"0123456789"

# Broad patterns; all repeats are bounded.
AT = re.compile(r"(?: ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?| at )")
SPELT = re.compile(
    r"[A-Za-z0-9-]{1,63}(?:(?: ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| dot |\.)[A-Za-z0-9-]{1,63}){1,6}"
)
SIX = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
NATIONAL = re.compile(
    r"(?<![0-9A-Za-z+.,/-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])[0-9]{3,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z+.,/-])[0-9]{9,12}(?![0-9A-Za-z])"
)

# Gazetteers and context words of the labelers.
ENDINGS = {
    "com", "org", "net", "edu", "gov", "int", "info", "biz", "io", "eu", "de", "fr", "es", "it", "uk", "us",
    "ca", "at", "ch", "nl", "be", "pt", "mx", "ar", "br", "jp", "cn", "in", "au", "se", "no", "dk", "pl",
}
FILES = {"png", "jpg", "jpeg", "gif", "svg", "css", "js", "py", "html", "txt", "pdf", "zip", "md", "json"}
CALLING = (
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47",
    "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81",
    "82", "84", "86", "90", "91", "92", "93", "94", "95", "98", "21", "22", "23", "24", "25", "26", "29",
    "35", "37", "38", "42", "50", "59", "67", "68", "69", "80", "85", "88", "96", "97", "99",
)
CARDS = (  # prefixes from, to, lengths
    ("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)),
    ("37", "37", (15,)), ("6011", "6011", (16,)), ("65", "65", (16,)), ("3528", "3589", (16,)),
    ("300", "305", (14,)), ("36", "36", (14,)), ("38", "39", (14,)), ("62", "62", (16, 17, 18, 19)),
    ("50", "50", (13, 14, 15, 16, 17, 18, 19)),
)
SPEAKS_FOR = {
    "email": {"mail", "email", "e-mail", "contact", "write", "reach", "correo", "kontakt", "courriel", "contacto"},
    "ip": {"ip", "ipv4", "ipv6", "host", "server", "address", "from", "client", "adresse", "dirección"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "karte", "kreditkarte", "carte", "tarjeta", "pan"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "handy", "téléphone", "teléfono", "móvil", "whatsapp"},
}
SPEAKS_AGAINST = {
    "version", "release", "isbn", "issn", "order", "invoice", "commit", "sha", "page", "pages", "chapter",
    "section", "part", "build", "serial", "score", "year", "price", "total", "line", "row", "build", "item",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def small(part: str) -> bool:
    """Whether digits of any number say at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


@dataclass
class Span:
    kind: int
    start: int
    end: int
    base: bool
    digits: str = ""
    tail: str = ""  # the last part of a domain


def emails(text: str) -> Iterator[Span]:
    """Base spans around each @, in time linear in the text."""
    done, at = 0, text.find("@")
    before = -1
    while at >= 0:
        left = max(done, before + 1)
        start = left + len(text[left:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield Span(0, start, done, True, tail=domain[0].rpartition(".")[2])
        before, at = at, text.find("@", at + 1)


def spelt_emails(text: str) -> Iterator[Span]:
    """Addresses whose @ and dots are written out; words alone need a written dot too."""
    for m in AT.finditer(text):
        own = text[max(0, m.start() - 64) : m.start()]
        size = len(own) - len(own.rstrip(LOCAL))
        domain = SPELT.match(text, m.end())
        if size and domain and (m[0] != " at " or " dot " in domain[0]):
            yield Span(0, m.start() - size, domain.end(), False, tail=NO_NAME.split(domain[0])[-1])


def proposed(raw: bytes | None) -> tuple[str, list[Span]]:
    """The text and all its spans by kind and start; those not of the base overlap none of it."""
    if not raw:
        return "", []
    n_digits = len(raw) - len(raw.translate(None, DIGITS))
    has_at, spelt = b"@" in raw, b" dot " in raw or b"at]" in raw or b"at)" in raw or b"AT" in raw
    if not has_at and not spelt and n_digits < 4 and b"::" not in raw:
        return "", []
    text = raw.decode()
    spans = list(emails(text)) if has_at else []
    other = list(spelt_emails(text)) if spelt else []
    if n_digits >= 4 and b"." in raw:
        for m in IP.finditer(text):
            if all(small(part) for part in m[0].split(".")):
                spans.append(Span(1, m.start(), m.end(), True, m[0]))
    if b":" in raw:
        for m in SIX.finditer(text):
            try:
                ipaddress.IPv6Address(m[0])
            except ValueError:
                continue
            other.append(Span(1, m.start(), m.end(), False, m[0]))
    if n_digits >= 13:
        for m in CHAIN.finditer(text):
            if m.end() - m.start() >= 13:
                digits = NON_DIGITS.sub("", m[0])
                if 13 <= len(digits) <= 19:
                    base = luhn(digits)
                    (spans if base else other).append(Span(2, m.start(), m.end(), base, digits))
    if n_digits >= 9:
        if b"+" in raw:
            for m in PHONE.finditer(text):
                digits = NON_DIGITS.sub("", m[0])
                if 9 <= len(digits) <= 15:
                    spans.append(Span(3, m.start(), m.end(), True, digits))
        for m in NATIONAL.finditer(text):
            digits = NON_DIGITS.sub("", m[0])
            if 9 <= len(digits) <= 12:
                other.append(Span(3, m.start(), m.end(), False, digits))
    taken = sorted((s.start, s.end) for s in spans)
    starts = np.array([a for a, _ in taken])
    reach = np.maximum.accumulate([z for _, z in taken]) if taken else starts
    for s in other:
        at = int(np.searchsorted(starts, s.end)) - 1
        if at < 0 or reach[at] <= s.start:
            spans.append(s)
    return text, sorted(spans, key=lambda s: (s.kind, s.start, s.end, not s.base))


def gazetteer(s: Span) -> int:
    if s.kind == 0:
        tail = s.tail.lower()
        return 1 if tail in ENDINGS else -1 if tail in FILES or tail.isdigit() else 0
    if s.kind == 1:
        if ":" in s.digits:
            return 1 if ipaddress.IPv6Address(s.digits).is_global else 0
        first = int(s.digits.split(".")[0].lstrip("0")[:3] or 0)
        return -1 if first in (0, 127) or first >= 224 else 1
    if s.kind == 2:
        known = any(len(s.digits) in sizes and a <= s.digits[: len(a)] <= z for a, z, sizes in CARDS)
        return 1 if known else -1
    return 0 if not s.base else 1 if s.digits.startswith(CALLING) else -1


def form(s: Span, own: str) -> int:
    """Whether the span is written as such things usually are."""
    if s.kind == 0:
        if not s.base:  # brackets are put there on purpose
            return 1 if any(c in own for c in "[({<") else 0
        return 1 if ".." not in own and own[0] not in ".-" else 0
    if s.kind == 1 and not s.base:
        return 1 if sum(map(bool, own.split(":"))) >= 3 else -1
    if s.kind == 1:
        return -1 if any(len(p) > 1 and p[0] == "0" for p in own.split(".")) else 1
    groups = [len(g) for g in re.split("[^0-9]+", own) if g]
    if s.kind == 2:
        return 1 if groups in ([4] * 4, [4, 6, 5]) else 0 if len(groups) == 1 else -1
    return 1 if len(groups) >= 3 and groups[-1] in (2, 3, 4) else 0


def vote(text: str, spans: list[Span]) -> list[tuple[int, list[int]]]:
    """For each span a number that holds all votes, three values a labeler, and its features."""
    base = np.sort([s.start for s in spans if s.base])
    made = []
    for s in spans:
        own = text[s.start : s.end]
        before, after = text[max(0, s.start - NEAR) : s.start], text[s.end : s.end + NEAR]
        said = [w.lower().strip(".,:;()[]#'\"") for w in before.split()[-5:]]
        kind = KINDS[s.kind]
        speaks = 1 if SPEAKS_FOR[kind].intersection(said) else -1 if SPEAKS_AGAINST.intersection(said) else 0
        left, right = before[-1:], after[:1]
        glued = (left.isalnum() or left in tuple("/_=@-+")) or (right.isalnum() or right in tuple("/_=@"))
        near = np.searchsorted(base, s.start + 200) - np.searchsorted(base, s.start - 200) - s.base
        odd = s.kind in (2, 3) and len(set(s.digits)) < 3 or s.kind == 2 and not s.base
        votes = (
            1 if s.base else -1, form(s, own), gazetteer(s), speaks,
            -1 if glued else 0, 1 if near > 0 else 0, -1 if odd else 0,
        )
        shape = re.sub("[A-Za-z]+", "a", re.sub("[0-9]", "9", own))[:40]
        features = [
            f"shape {shape}", f"length {min(len(own), 40)}", f"left {left}", f"right {right}", f"tail {s.tail.lower()}",
            f"first {s.digits[:2]}", f"digits {len(s.digits)}", *(f"said {w}" for w in said), *(f"next {w.lower()}" for w in after.split()[:2]),
            *(f"{name} {v}" for name, v in zip(LABELERS, votes, strict=True)),
        ]
        code = 0
        for v in reversed(votes):
            code = code * 3 + v + 1
        made.append((code, sorted({zlib.crc32(f"{kind} {f}".encode()) % DIMS for f in features})))
    return made


SPAN = T.StructType(
    [T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
     T.StructField("base", T.BooleanType()), T.StructField("votes", T.IntegerType()), T.StructField("features", T.ArrayType(T.IntegerType()))]
)


def candidates(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Add to the kept columns `found`: proposed spans with votes and features."""

    def work():
        def row(raw):
            text, spans = proposed(raw)
            return [
                {"kind": s.kind, "start": s.start, "end": s.end, "base": s.base, "votes": code, "features": features}
                for s, (code, features) in zip(spans, vote(text, spans), strict=True)
            ]

        return lambda texts: {"found": [row(t) for t in texts]}

    return map_texts(docs, work, [T.StructField("found", T.ArrayType(SPAN))], keep, text, raw=True)


def opened(codes: np.ndarray) -> np.ndarray:
    """Votes from codes: -1, 0 or 1 for each labeler."""
    return np.asarray(codes)[:, None] // 3 ** np.arange(len(LABELERS)) % 3 - 1


def reliabilities(codes: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """How often each labeler is right, and the posterior of every vote pattern.

    A labeler is right equally often whatever the truth; an abstention says nothing. It
    starts from the labelers' majority and from the belief, worth SMOOTH votes, that they
    are right four times in five. None is taken to be worse than a guess. Before any vote
    a span is as likely personal as not: how many proposals are says nothing about the rest.
    """
    votes = opened(codes)
    yes = 1 / (1 + np.exp(-1.4 * votes.sum(1)))
    for _ in range(rounds):
        agrees = (votes == 1) * yes[:, None] + (votes == -1) * (1 - yes)[:, None]
        cast = (votes != 0) * weight[:, None]
        right = ((agrees * weight[:, None]).sum(0) + 0.8 * SMOOTH) / (cast.sum(0) + SMOOTH)
        right = np.clip(right, 0.5, 0.99)
        new = 1 / (1 + np.exp(-votes @ np.log(right / (1 - right))))
        moved, yes = np.abs(new - yes).max(initial=0), new
        if moved < 1e-7:
            break
    return right, yes


@dataclass
class Model:
    weights: np.ndarray  # of the hashed features, the last is the bias
    reliability: dict[str, dict[str, float]]  # by kind and labeler

    def probability(self, features: list[list[int]]) -> np.ndarray:
        z = np.array([self.weights[f].sum() + self.weights[-1] for f in features])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(features: list[list[int]], truth: np.ndarray, epochs: int = 30, seed: int = 3) -> np.ndarray:
    """Logistic regression on soft labels."""
    w, heat = np.zeros(DIMS + 1), np.full(DIMS + 1, 0.1)
    rows = [np.array([*f, DIMS]) for f in features]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            ids = np.concatenate([rows[i] for i in pick])
            owner = np.repeat(np.arange(len(pick)), [len(rows[i]) for i in pick])
            z = np.bincount(owner, w[ids], len(pick))
            slip = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - truth[pick]
            g = np.bincount(ids, slip[owner], DIMS + 1) + 1e-4 * w
            heat += g * g
            w -= 0.3 * g / np.sqrt(heat)
    return w


def fit(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """Estimate the labelers on all spans and train the classifier on a bounded sample.

    The driver gets counts of vote patterns (at most 3 to the power of seven for each of
    four kinds) and at most `sample` distinct spans of each kind and likely label, chosen
    by a hash. Without spans the classifier reports none.
    """
    spans = rows.select(F.explode("found").alias("s")).select("s.*")
    counts = spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).toPandas()
    posterior, reliability = [], {}
    for kind, own in counts.sort_values(["kind", "votes"]).groupby("kind"):
        right, yes = reliabilities(own["votes"].to_numpy(), own["n"].to_numpy(float))
        reliability[KINDS[kind]] = dict(zip(LABELERS, right.tolist(), strict=True))
        posterior += [(int(kind), int(v), float(y)) for v, y in zip(own["votes"], yes, strict=True)]
    if not posterior:
        return Model(np.append(np.zeros(DIMS), -30.0), {})
    known = rows.sparkSession.createDataFrame(posterior, "kind int, votes int, yes double")
    # Copies of a span count once, so that no page that is copied often leads the fit.
    each = spans.join(F.broadcast(known), ["kind", "votes"]).select("kind", "yes", "features").distinct()
    each = stored(each, "distinct-spans")
    order = [F.xxhash64("features"), "features", "yes"]
    sides = [
        each.where((F.col("kind") == kind) & ((F.col("yes") >= 0.5) == likely)).orderBy(*order).limit(sample)
        for kind in range(len(KINDS))
        for likely in (True, False)
    ]
    chosen = reduce(DataFrame.unionByName, sides).toPandas()
    return Model(train([list(f) for f in chosen["features"]], chosen["yes"].to_numpy(float)), reliability)


FOUND = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
     T.StructField("base", T.BooleanType()), T.StructField("score", T.DoubleType())]
)


def decided(found: list[dict], model: Model, report_at: float = REPORT_AT) -> list[dict]:
    """Base spans and those the classifier reports; of such that overlap the likeliest stays."""
    if not found:
        return []
    score = model.probability([s["features"] for s in found])
    kept = [(s, float(p)) for s, p in zip(found, score) if s["base"]]
    other = [(s, float(p)) for s, p in zip(found, score) if not s["base"] and p >= report_at]
    taken: list[tuple[int, int]] = []  # in order, none overlap
    for s, p in sorted(other, key=lambda x: (-x[1], x[0]["start"], -x[0]["end"], x[0]["kind"])):
        at = bisect(taken, (s["start"], s["end"]))
        if (at == 0 or taken[at - 1][1] <= s["start"]) and (at == len(taken) or taken[at][0] >= s["end"]):
            taken.insert(at, (s["start"], s["end"]))
            kept.append((s, p))
    kept.sort(key=lambda x: (x[0]["kind"], x[0]["start"], x[0]["end"]))
    return [
        {"kind": KINDS[s["kind"]], "start": s["start"], "end": s["end"], "base": s["base"], "score": p} for s, p in kept
    ]


def spans_of(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Turn `found` into `spans`: kind, start, end (code points), base and probability."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("spans", T.ArrayType(FOUND))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [decided(found or [], shared.value) for found in batch.column(len(keep)).to_pylist()]
            arrays = [batch.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(made, arrow.field(len(keep)).type)], schema=arrow)

    return rows.select(*keep, "found").mapInArrow(run, schema)


def private_spans(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Add `spans` of personal data to the kept columns, learnt from these documents alone.

    Null and empty texts have no spans. Rows are independent but for the fit, in which
    copies count once each way; repeated rows get equal results. Of added spans that
    overlap the likeliest stays, then the first, then the longest. An empty table gives an
    empty one; long texts are read whole. A kept column named `found` or `spans` gives way.
    """
    keep = [c for c in keep if c not in ("found", "spans")]
    rows = stored(candidates(docs, keep, text), "private")
    return spans_of(rows, fit(rows), keep)


def op13_private_spans(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document as counts, a digest of the base spans and all spans.

    Null texts count as empty: no spans, the digest of an empty text.
    """
    rows = private_spans(table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("spans", lambda s: s["base"])

    def listed(spans: Column) -> Column:
        each = F.transform(spans, lambda s: F.format_string("%s:%d:%d", s["kind"], s["start"], s["end"]))
        return F.array_join(each, ",")

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    digest = F.sha2(listed(base), 256).alias("base_sha256")
    return rows.select("doc_id", *map(number, KINDS), digest, listed(F.col("spans")).alias("spans"))
