"""Language of a text by error-correcting output codes (operator 1).

Every language has a codeword. One linear classifier per bit, on hashed byte trigrams,
predicts the bits of a text; the codeword with the least loss, weighted by how well
each classifier did in training, names the language. A small lead over the second
codeword flags the text as ambiguous.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepscope.llm.common import arrow_limits, balanced_sample, fold, map_texts

BUCKETS = 4096
PER_LANGUAGE = 400  # documents of each language to learn from; at most 1.5 times as many
LETTER = re.compile(r"[^\W\d_]")
# Everything in ASCII but small letters parts words.
PARTS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
FIELDS = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("ambiguous", T.BooleanType()),
    T.StructField("runner_up", T.StringType()),
]


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, +1 / -1
    weights: np.ndarray  # (buckets + 1) x bits; the last row is the bias
    bit_trust: np.ndarray  # weight of each bit's loss
    sharpness: float = 4.0
    lead: float = 0.2  # share of probability the winner must lead by


def codewords(n: int) -> np.ndarray:
    """All ways to split few languages in two; for many, random splits with equal halves."""
    if n < 2:
        return np.ones((n, 1), np.float32)
    if n <= 5:
        splits = [[1] + [1 if s >> i & 1 else -1 for i in range(n - 1)] for s in range(2 ** (n - 1) - 1)]
        return np.array(splits, np.float32).T
    rng = np.random.default_rng(n)
    bits = int(np.ceil(10 * np.log2(n)))
    half = np.where(np.arange(n) < n // 2, 1, -1)
    best, widest = None, -1
    for _ in range(50):
        code = np.stack([rng.permutation(half) for _ in range(bits)], 1)
        apart = (bits - (code @ code.T - 2 * bits * np.eye(n, dtype=int))) // 2
        if apart.min() > widest:
            best, widest = code, apart.min()
    return best.astype(np.float32)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Share of each trigram bucket per text, root taken and scaled; and which have letters."""
    rows = np.zeros((len(texts), BUCKETS + 1), np.float32)
    letters = np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        if not text or not LETTER.search(text):
            continue
        letters[i] = True
        words = text.lower().encode().translate(PARTS).split()
        b = np.frombuffer(b"  " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
        grams = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(20)
        rows[i, :BUCKETS] = np.bincount(grams, minlength=BUCKETS)
    rows = np.sqrt(rows)
    norm = np.sqrt((rows * rows).sum(1, keepdims=True))
    rows /= np.maximum(norm, 1e-9)
    rows[:, BUCKETS] = 1
    return rows, letters


def fit_bits(rows: np.ndarray, which: np.ndarray, codes: np.ndarray, rounds: int = 300) -> tuple:
    """One logistic classifier per bit, all at once; languages count alike."""
    target = codes[which]
    count = np.bincount(which, minlength=len(codes))
    share = (1 / count[which] / len(codes)).astype(np.float32)[:, None]
    w = np.zeros((rows.shape[1], codes.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        margin = np.clip(target * (rows @ w), -30, 30)
        g = rows.T @ (-target * share / (1 + np.exp(margin))) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    right = (share * (target * (rows @ w) > 0)).sum(0)
    error = np.clip(1 - right, 0.001, 0.499)
    trust = 0.5 * np.log((1 - error) / error)
    return w, (trust / trust.sum()).astype(np.float32)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, key: str = "doc_id") -> Model:
    """Learn from a bounded sample: rows without text or lang are left out.

    Texts become trigram shares on the executors; the driver gets 4097 numbers for each
    of about `per_language` documents of every language.
    """
    arrow_limits(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = balanced_sample(labelled.select(key, "lang", "text"), "lang", key, per_language, seed=1)

    def features():
        def of(texts):
            rows, letters = trigrams(texts)
            return {"x": [r.astype(np.float16).tobytes() if ok else None for r, ok in zip(rows, letters)]}

        return of

    got = map_texts(sample, features, [T.StructField("x", T.BinaryType())], ["lang"])
    got = got.where("x is not null").toPandas()
    languages = sorted(got["lang"].unique()) if len(got) else []
    codes = codewords(len(languages))
    if len(languages) < 2:
        flat = np.zeros((BUCKETS + 1, codes.shape[1]), np.float32)
        flat[-1] = 1
        return Model(languages, codes, flat, np.ones(codes.shape[1], np.float32))
    rows = np.stack([np.frombuffer(x, np.float16) for x in got["x"]]).astype(np.float32)
    which = np.searchsorted(languages, got["lang"].to_numpy(str))
    return Model(languages, codes, *fit_bits(rows, which, codes))


def decode(model: Model, rows: np.ndarray) -> np.ndarray:
    """Probabilities of the languages: soft nearest codeword by weighted logistic loss."""
    margin = rows @ model.weights
    loss = np.stack([(np.log1p(np.exp(-np.clip(margin * c, -30, 30))) * model.bit_trust).sum(1) for c in model.codes], 1)
    near = np.exp(-model.sharpness * (loss - loss.min(1, keepdims=True)))
    return near / near.sum(1, keepdims=True)


def classify(model: Model, texts: list[str | None]) -> dict:
    rows, letters = trigrams(texts)
    if not model.languages:
        letters[:] = False
    n = len(texts)
    out = {"lang_pred": ["und"] * n, "score": [0.0] * n, "ambiguous": [True] * n, "runner_up": [None] * n}
    if not letters.any():
        return out
    p = decode(model, rows)
    order = np.argsort(-p, 1, kind="stable")
    for i in np.flatnonzero(letters):
        first, second = order[i, 0], order[i, min(1, p.shape[1] - 1)]
        out["lang_pred"][i] = model.languages[first]
        out["score"][i] = float(p[i, first])
        out["ambiguous"][i] = bool(first != second and p[i, first] - p[i, second] < model.lead)
        out["runner_up"][i] = model.languages[second] if first != second else None
    return out


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Add lang_pred, score, ambiguous and runner_up to the kept columns.

    Null, empty and letterless texts get `und` with score 0. With one learned language
    all texts with letters get it, with none all get `und`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        return lambda texts: classify(shared.value, texts)

    return map_texts(docs, work, FIELDS, keep)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = docs.withColumn("held_out", fold("doc_id", 3) == 1)
    model = train(held.where(~F.col("held_out")))
    return predict(held, model, ["doc_id", "held_out"])
