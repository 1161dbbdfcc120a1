"""Toxicity by a convolutional text classifier (operator 3).

A word's embedding is the sum of hashed parts: the word and its first letters, so that
unseen endings of a known stem count. Filters of several widths run over the words, the
largest response of each is pooled and a logistic layer scores the text. Training is
plain numpy; thresholds are set for each predicted language, by all labelled documents
that the network has not learned from, and moved to 0.3 of the score.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepscope.llm import langid
from stepscope.llm.common import aside, arrow_limits, back, balanced_sample, fold, map_texts, stored, table

SAMPLE = 2500  # documents of each label to learn from, at most 1.5 times as many
LONGEST = 2000  # words; longer documents are scored whole but not learned from
STEP = 0.01  # of a logit, by which scores are counted for the thresholds
AIM = 0.3  # where the thresholds are put
WIDTH = 8  # of an embedding
SPANS = (1, 2, 3)  # widths of the filters in words
FILTERS = 8  # of each width
STEMS = (4, 5, 6, 7)  # first letters that count as parts of a word
CACHE = 150_000  # words a task remembers
CHUNK = 60_000  # words convolved at a time

FIELDS = [T.StructField("logit", T.DoubleType()), T.StructField("lang_pred", T.StringType())]


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words of letters; everything else in ASCII parts them."""
    return text.lower().encode().translate(langid.PARTS).split() if text else []


def parts_of(word: bytes) -> list[int]:
    """Hashes of a word and its stems; a short word stands in for its stems."""
    letters = word.decode(errors="replace")
    return [zlib.crc32(word)] + [
        zlib.crc32(letters[:k].encode(), 7 + k) if len(letters) >= k else 0 for k in STEMS
    ]


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of the parts seen in training
    table: np.ndarray  # their embeddings; all others are zero
    filters: list[np.ndarray]  # per width: words x embedding x filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    threshold: dict[str, float] = field(default_factory=dict)  # by language, "" for any

    def embed(self, words: list[bytes]) -> np.ndarray:
        hashes = np.array([parts_of(w) for w in words], np.uint32).reshape(len(words), -1)
        if not len(self.keys):
            return np.zeros((len(words), WIDTH), np.float32)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        known = (self.keys[at] == hashes) & (hashes != 0)
        return (self.table[at] * known[..., None]).sum(1)

    def project(self, words: list[bytes]) -> np.ndarray:
        """What each word gives to each filter at each place: one row a word."""
        e = self.embed(words)
        return np.concatenate([e @ k for f in self.filters for k in f], 1)


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word rows of texts one after the other, three empty words (row 0) behind each.

    Also returns begin and end of each text; the first empty word belongs to it, so that
    every text has a place to look at and no filter reaches into the next text.
    """
    size = np.array([len(t) for t in texts])
    begin = np.concatenate([[0], np.cumsum(size + len(SPANS))[:-1]]).astype(np.int64)
    ids = np.zeros(int((size + len(SPANS)).sum()), np.int64)
    for t, b in zip(texts, begin, strict=True):
        ids[b : b + len(t)] = t
    return ids, np.stack([begin, begin + size + 1], 1)


def responses(rows: np.ndarray) -> list[np.ndarray]:
    """Responses of the filters of each width at every place, from projections."""
    out, at = [], 0
    for span in SPANS:
        total = rows[:, at : at + FILTERS].copy()
        for j in range(1, span):
            at += FILTERS
            total[:-j] += rows[j:, at : at + FILTERS]
        at += FILTERS
        out.append(total)
    return out


def pooled(projected: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """Largest response of each filter in each text; long texts go through in pieces.

    A piece ends with the words that its last windows reach into. Only the last piece of a
    text has windows that run out of words, so pieces change nothing.
    """
    pieces, owner, places = [], [], []
    for i, t in enumerate(texts):
        for at in range(0, max(len(t), 1), CHUNK):
            pieces.append(t[at : at + CHUNK + len(SPANS) - 1])
            owner.append(i)
            places.append(CHUNK if at + CHUNK < len(t) else len(t) - at + 1)
    found, at = [], 0
    while at < len(pieces):
        upto, n = at, 0
        while upto < len(pieces) and (n == 0 or n + len(pieces[upto]) <= CHUNK):
            n += len(pieces[upto]) + len(SPANS)
            upto += 1
        ids, ends = laid_out(pieces[at:upto])
        ends[:, 1] = ends[:, 0] + places[at:upto]
        each = responses(projected[ids])
        found.append(np.concatenate([np.maximum.reduceat(x, ends.ravel(), axis=0)[::2] for x in each], 1))
        at = upto
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    return np.maximum.reduceat(np.concatenate(found), starts, axis=0)


def fit(texts: list[str], toxic: np.ndarray, epochs: int = 6, seed: int = 7) -> Model:
    """Train the network; labels 0 and 1 both have to occur."""
    rng = np.random.default_rng(seed)
    split = [words_of(t) for t in texts]
    vocabulary = sorted(set().union(*split))
    place = {w: i + 1 for i, w in enumerate(vocabulary)}
    docs = [np.array([place[w] for w in words], np.int64) for words in split]
    hashes = np.array([parts_of(w) for w in vocabulary], np.uint32).reshape(-1, 1 + len(STEMS))
    keys = np.unique(hashes[hashes != 0])
    parts = np.where(hashes != 0, np.searchsorted(keys, hashes) + 1, 0)
    parts = np.concatenate([np.zeros((1, parts.shape[1]), np.int64), parts])

    # The first value of an embedding starts as the log-odds of the part's presence.
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()])
    seen = np.zeros((len(keys) + 1, 2))
    for ids, y in zip(docs, toxic, strict=True):
        seen[np.unique(parts[np.unique(ids)]), y] += 1
    odds = np.log((seen[:, 1] + 0.5) / (n[1] + 1)) - np.log((seen[:, 0] + 0.5) / (n[0] + 1))
    odds *= seen.sum(1) / (seen.sum(1) + 4)
    table = rng.normal(0, 0.02, (len(keys) + 1, WIDTH)).astype(np.float32)
    table[:, 0] = odds / 8
    table[0] = 0
    filters = [rng.normal(0, 0.1, (s, WIDTH, FILTERS)).astype(np.float32) for s in SPANS]
    filters[0][0, 0, 0] = 2.0
    bias = np.zeros(len(SPANS) * FILTERS, np.float32)
    out = rng.normal(0, 0.1, len(bias)).astype(np.float32)
    out[0], out_bias = 2.0, -2.0
    share = np.where(toxic == 1, 0.5 / max(n[1], 1), 0.5 / max(n[0], 1)) * len(docs)

    heat = np.full(len(table), 0.1, np.float32)
    dense = [*filters, bias, out]
    heats = [np.full_like(x, 0.1) for x in dense]
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            ids, ends = laid_out([docs[i] for i in pick])
            words, ids = np.unique(ids, return_inverse=True)
            e = table[parts[words]].sum(1)
            rows = np.concatenate([e @ k for f in filters for k in f], 1)[ids]
            each = responses(rows)
            where = [np.stack([b + x[b:z].argmax(0) for b, z in ends]) for x in each]
            top = np.concatenate([np.take_along_axis(x, w, 0) for x, w in zip(each, where)], 1)
            h = np.maximum(top + bias, 0)
            z = np.clip(h @ out + out_bias, -30, 30)
            dz = (share[pick] * (1 / (1 + np.exp(-z)) - toxic[pick]) / len(pick)).astype(np.float32)
            dh = dz[:, None] * out * (h > 0)
            grads = [np.zeros_like(x) for x in filters] + [dh.sum(0), h.T @ dz + 1e-4 * out]
            de = np.zeros_like(e)
            for s, (f, w) in enumerate(zip(filters, where, strict=True)):
                d = dh[:, s * FILTERS : (s + 1) * FILTERS]
                for j in range(len(f)):
                    at_word = ids[w + j]
                    grads[s][j] = np.einsum("df,dfe->ef", d, e[at_word]) + 1e-4 * f[j]
                    np.add.at(de, at_word, d[..., None] * f[j].T[None])
            out_bias -= 0.1 * float(dz.sum())
            for x, g, a in zip(dense, grads, heats, strict=True):
                a += g * g
                x -= 0.05 * g / np.sqrt(a)
            touched = np.flatnonzero(np.abs(de).sum(1) > 0)
            for slot in parts[words[touched]].T:
                g = de[touched] * (slot > 0)[:, None]
                np.add.at(heat, slot, (g * g).mean(1))
                np.add.at(table, slot, -0.02 * g / np.sqrt(heat[slot])[:, None])
    return Model(keys, table[1:], filters, bias, out, out_bias)


def cut_point(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold with the best weighted F1, in the middle of the widest gap that has it."""
    order = np.argsort(z, kind="stable")
    z, y, weight = z[order], y[order], weight[order]
    hit = np.cumsum((weight * y)[::-1])[::-1]
    flagged = np.cumsum(weight[::-1])[::-1]
    f1 = 2 * hit / (flagged + (weight * y).sum())
    low = np.concatenate([[z[0] - 2], z[:-1]])
    fit = np.where(z > low, f1, -1)
    best = np.flatnonzero(fit >= fit.max() - 1e-12)
    i = best[np.argmax((z - low)[best])]
    return float((z[i] + low[i]) / 2)


def train(
    docs: DataFrame, labels: DataFrame, language: langid.Model, sample: int = SAMPLE
) -> Model:
    """Train the network on a bounded, balanced sample; set thresholds by all labelled documents.

    See `trained` and `with_thresholds`. The documents are scored for the thresholds only.
    """
    known = known_labels(labels)
    model, learned = trained(docs, known, sample)
    judged = scored(docs.where("text is not null"), model, language, ["doc_id"])
    return with_thresholds(model, judged, known, learned)


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): one label of 0 or 1 a document; others are left out."""
    return labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def trained(docs: DataFrame, known: DataFrame, sample: int = SAMPLE) -> tuple[Model, DataFrame | None]:
    """The network, trained on two thirds of a bounded sample, and the doc_id it learned from.

    Without both labels nothing is flagged and there is nothing to set thresholds by; the
    second value is None then.
    """
    arrow_limits(docs.sparkSession)
    chosen = balanced_sample(known, "toxic", "doc_id", sample, seed=2)
    short = docs.where("text is not null").where(F.size(F.split("text", r"\s+")) <= LONGEST)
    # At most three times `sample` rows are broadcast and come to the driver.
    got = short.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy("doc_id").toPandas()
    y = got["toxic"].to_numpy(np.int64)
    nothing = Model(
        np.zeros(0, np.uint32), np.zeros((0, WIDTH), np.float32),
        [np.zeros((s, WIDTH, FILTERS), np.float32) for s in SPANS],
        np.zeros(len(SPANS) * FILTERS, np.float32), np.zeros(len(SPANS) * FILTERS, np.float32),
        0.0, {"": 4.0},
    )
    if len(np.unique(y)) < 2:
        return nothing, None
    texts = got["text"].tolist()
    checks = np.array([zlib.crc32(str(i).encode()) // 8 % 3 == 0 for i in got["doc_id"]])
    if len(np.unique(y[checks])) < 2 or len(np.unique(y[~checks])) < 2:
        checks[:] = False
    model = fit([t for t, c in zip(texts, checks) if not c], y[~checks])
    learned = got.loc[~checks, ["doc_id"]] if checks.any() else got.loc[checks, ["doc_id"]]
    return model, docs.sparkSession.createDataFrame(learned, T.StructType([docs.schema["doc_id"]]))


def with_thresholds(model: Model, judged: DataFrame, known: DataFrame, learned: DataFrame | None) -> Model:
    """The model with thresholds set by all labelled documents that it has not learned from.

    judged(doc_id, logit, lang_pred) as `scored` gives them, of documents with a text. Each
    counts for the threshold of its predicted language, if there are five of either label;
    the other languages share one. Only scores are joined to labels, never texts.
    """
    if learned is None:
        return model
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rest = judged.join(F.broadcast(learned), "doc_id", "left_anti")
    bins = binned(rest.join(known, "doc_id")).toPandas()
    of_label = np.bincount(bins["toxic"], bins["n"], 2)
    share = np.array([total[0], total[1]]) / of_label
    bins["weight"] = bins["n"] * share[bins["toxic"]]

    def best(rows) -> float:
        # Half a step up: the end of the lower bin is at most the beginning of the upper one.
        z, y = rows["bin"].to_numpy() * STEP, rows["toxic"].to_numpy()
        return cut_point(z, y, rows["weight"].to_numpy()) + STEP / 2

    model.threshold[""] = best(bins)
    for name, own in bins.groupby("lang_pred"):
        if np.bincount(own["toxic"], own["n"], 2).min() >= 5:
            model.threshold[str(name)] = best(own)
    return model


def binned(judged: DataFrame) -> DataFrame:
    """(lang_pred, toxic, bin, n): all documents counted by their logit in steps of STEP.

    The counts are as many as there are bins, whatever the number of documents.
    """
    at = F.floor(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), "logit")) / STEP).cast("int")
    return judged.groupBy("lang_pred", F.col("toxic").cast("int").alias("toxic"), at.alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


class Scorer:
    """Scores texts and remembers the projections of words."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[bytes, int] = {}
        self.rows = np.zeros((1, FILTERS * sum(SPANS)), np.float32)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        missing = sorted(set().union(*split) - self.known.keys())
        first = len(self.known) + 1
        lookup = {w: first + i for i, w in enumerate(missing)}
        if first + len(missing) > len(self.rows):
            grown = np.zeros((first + len(missing) + 4096, self.rows.shape[1]), np.float32)
            grown[:first] = self.rows[:first]
            self.rows = grown
        for at in range(0, len(missing), 8192):
            part = missing[at : at + 8192]
            self.rows[first + at : first + at + len(part)] = self.model.project(part)
        if first + len(missing) <= CACHE:
            self.known |= lookup
            lookup = self.known
        elif missing:
            lookup = self.known | lookup  # for these texts only
        else:
            lookup = self.known
        ids = [np.array([lookup[w] for w in words], np.int64) for words in split]
        h = np.maximum(pooled(self.rows, ids) + self.model.bias, 0) if ids else np.zeros((0, len(self.model.bias)))
        return h @ self.model.out + self.model.out_bias


def scored(docs: DataFrame, model: Model, language: langid.Model, keep: list[str], text: str = "text") -> DataFrame:
    """Add logit, before any threshold, and lang_pred to the kept columns.

    Null, empty and wordless texts are scored like a text in which no filter fires.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, language))

    def work():
        scorer, language = Scorer(shared.value[0]), shared.value[1]

        def of(texts):
            return {
                "logit": scorer.logits(texts).astype(np.float64),
                "lang_pred": langid.classify(language, texts)["lang_pred"],
            }

        return of

    return map_texts(docs, work, FIELDS, keep, text)


def judged_by(rows: DataFrame, model: Model) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.3 on) by the threshold of the predicted language."""
    limit = dict(model.threshold)
    off = F.lit(limit.pop(""))
    if limit:
        own = F.create_map(*[F.lit(x) for pair in limit.items() for x in pair])
        off = F.coalesce(own[F.col("lang_pred")], off)
    z = F.col("logit") - off + float(np.log(AIM / (1 - AIM)))
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))
    rows = rows.withColumn("score", 1 / (1 + F.exp(-z)))
    return rows.withColumn("predicted", (F.col("score") >= AIM).cast("int")).drop("logit", "lang_pred")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every text is scored once; the scores lie in the shared folder and are joined to labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", fold("doc_id", 4) == 2).withColumn("_written", F.col("text").isNotNull())
    known = known_labels(table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2))
    seen = docs.where("not held_out")
    language = langid.train(seen)
    model, learned = trained(seen, known)
    rows = stored(scored(docs, model, language, ["doc_id", "held_out", "_written"]), "scores")
    with_thresholds(model, rows.where("not held_out and _written").drop("held_out"), known, learned)
    return judged_by(rows, model).drop("_written")


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their columns.

    They are stored with their scores once, so that no text is scored twice or shuffled.
    """
    known = known_labels(labels)
    language = langid.train(docs)
    model, learned = trained(docs, known)
    own, names = aside(docs)
    rows = stored(scored(own, model, language, [*names.values()], names["text"]), "scores")
    judged = rows.where(F.col(names["text"]).isNotNull())
    with_thresholds(model, judged.select(F.col(names["doc_id"]).alias("doc_id"), *[f.name for f in FIELDS]), known, learned)
    return judged_by(rows, model).where("predicted = 0").select(*back(names))
