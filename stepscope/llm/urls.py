"""URL verdicts: rules first, gradient-boosted trees on lexical features for the rest (operator 4).

The trees learn from labelled URLs, here those that a rule decides. Features are lengths,
depth, shares of digits and other characters, entropy, parameter counts and the statistics
of the host's suffix in the labelled URLs. Trees are grown on feature histograms in numpy.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepscope.llm.common import arrow_limits, balanced_sample, map_texts, table

# Verdicts and rules of the query, host and beginning of the path.
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
SAMPLE = 20_000  # labelled URLs of each verdict to learn from, at most 1.5 times as many
SUFFIX_BUCKETS = 4096
TREES, DEPTH, BINS, RATE = 60, 4, 32, 0.2


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for null and for urls without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits; meant for short lists, one comparison each."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def suffixes(host: str, path: str) -> list[int]:
    """Hash buckets of the host's last label, its last two, and these with the first folder."""
    labels = host.split(":")[0].split(".")
    one, two = (".".join(labels[-n:]) for n in (1, 2))
    folder = "/".join(path.split("/")[:2])
    return [zlib.crc32(s.encode()) % SUFFIX_BUCKETS for s in (one, two, two + folder)]


FEATURES = (
    "length", "host_length", "path_length", "depth", "labels", "digit_share", "host_digits",
    "entropy", "parameters", "query_length", "hyphens", "escapes", "longest_label", "marks",
    "secure", "suffix_rate", "suffix_seen", "domain_rate", "domain_seen", "folder_rate", "folder_seen",
)


def features(url: str | None, rates: np.ndarray) -> list[float]:
    url = url or ""
    rest = url.partition("://")[2]
    host = rest.partition("#")[0].partition("?")[0].partition("/")[0].lower()
    tail = rest[len(host) :].partition("#")[0]
    path, _, query = tail.partition("?")
    codes = np.frombuffer(url.encode(), np.uint8)
    n = max(len(codes), 1)
    share = np.bincount(codes, minlength=1)
    share = share[share > 0] / n
    digits = int(((codes >= 48) & (codes <= 57)).sum())
    labels = host.split(".")
    statistics = rates[suffixes(host, path)].ravel()
    return [
        len(url), len(host), len(path), path.count("/"), len(labels), digits / n,
        sum(c.isdigit() for c in host), float(-(share * np.log2(share)).sum()),
        query.count("=") + query.count("&"), len(query), host.count("-"), url.count("%"),
        max(map(len, labels)), sum(url.count(c) for c in "@_~;,"), url.startswith("https"),
        *statistics,
    ]


@dataclass
class Model:
    rates: np.ndarray  # suffix bucket -> share of blocked labelled URLs, log of how many
    edges: list[np.ndarray]  # bin edges per feature
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # features, bins, leaf values
    base: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)], 1)

    def chance(self, x: np.ndarray) -> np.ndarray:
        """Probability of block."""
        b, z = self.binned(x), np.full(len(x), self.base)
        for tree in self.trees:
            z += tree[2][leaf_of(tree, b)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def leaf_of(tree: tuple, b: np.ndarray) -> np.ndarray:
    """Leaf of each row in a complete tree of DEPTH levels; node k has children 2k+1, 2k+2."""
    at = np.zeros(len(b), np.int64)
    for _ in range(DEPTH):
        at = 2 * at + 1 + (b[np.arange(len(b)), tree[0][at]] > tree[1][at])
    return at - (2**DEPTH - 1)


def grow(b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
    """One tree by second-order gain over histograms, level by level."""
    inner = 2**DEPTH - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
    at = np.zeros(len(b), np.int64)
    for level in range(DEPTH):
        first, width = 2**level - 1, 2**level
        local = at - first
        best = np.full(width, 1e-6)
        for f in range(b.shape[1]):
            slot = local * BINS + b[:, f]
            gs = np.bincount(slot, g, width * BINS).reshape(width, BINS).cumsum(1)
            hs = np.bincount(slot, h, width * BINS).reshape(width, BINS).cumsum(1)
            gt, ht = gs[:, -1:], hs[:, -1:]
            gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
            gain[(hs < 1) | (ht - hs < 1)] = 0
            top = gain.argmax(1)
            better = gain[np.arange(width), top] > best
            nodes = np.flatnonzero(better)
            best[nodes] = gain[nodes, top[nodes]]
            feature[first + nodes], cut[first + nodes] = f, top[nodes]
        at = 2 * at + 1 + (b[np.arange(len(b)), feature[at]] > cut[at])
    leaf = at - inner
    value = -np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
    return feature, cut, RATE * value


def fit(x: np.ndarray, y: np.ndarray, rates: np.ndarray) -> Model:
    """Boost trees on the logistic loss; with one class only, the model says its share."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    prior = (y.sum() + 0.5) / (len(y) + 1)
    if not len(y):
        prior = 0.01  # nothing is known: allow
    model = Model(rates, edges, [], float(np.log(prior / (1 - prior))))
    if len(np.unique(y)) < 2:
        return model
    b, z = model.binned(x), np.full(len(y), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        tree = grow(b, p - y, p * (1 - p))
        model.trees.append(tree)
        z += tree[2][leaf_of(tree, b)]
    return model


def suffix_rates(labelled: DataFrame) -> np.ndarray:
    """Share of block and log count per suffix bucket, over all labelled rows of host, path and blocked."""
    labels = F.split(F.split("host", ":")[0], r"\.")
    last = F.element_at(labels, -1)
    two = F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(last)
    folder = F.concat(two, F.array_join(F.slice(F.split("path", "/"), 1, 2), "/"))
    buckets = [F.crc32(c.cast("binary")) % SUFFIX_BUCKETS for c in (last, two, folder)]
    rows = labelled.select("blocked", F.explode(F.array(*buckets)).alias("bucket"))
    # At most SUFFIX_BUCKETS rows, whatever the number of hosts.
    seen = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("blocked").cast("long")).alias("k"))
    total = np.zeros((SUFFIX_BUCKETS, 2))
    for r in seen.collect():
        total[r["bucket"]] = r["k"], r["n"]
    k, n = total[:, 0], total[:, 1]
    overall = (k.sum() + 0.5) / (n.sum() + 1)
    return np.stack([(k + 5 * overall) / (n + 5), np.log1p(n)], 1)


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from rows of url, host, path and blocked (boolean).

    Suffix statistics count all of them, the trees see a bounded sample of each verdict.
    """
    arrow_limits(labelled.sparkSession)
    rates = suffix_rates(labelled)
    got = balanced_sample(labelled.select("url", "blocked"), "blocked", "url", sample, seed=3).orderBy("url").toPandas()
    x = np.array([features(u, rates) for u in got["url"]], float).reshape(-1, len(FEATURES))
    return fit(x, got["blocked"].to_numpy(float), rates)


def predict(pages: DataFrame, model: Model, keep: list[str], url: str = "url") -> DataFrame:
    """Add risk, the probability that a URL is to be blocked; a null url is scored as empty."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def work():
        def of(urls):
            model = shared.value
            x = np.array([features(u, model.rates) for u in urls], float)
            return {"risk": model.chance(x.reshape(-1, len(FEATURES)))}

        return of

    return map_texts(pages, work, [T.StructField("risk", T.DoubleType())], keep, url)


def judge(pages: DataFrame, rules=RULES, keep: list[str] = ["page_id"]) -> DataFrame:
    """Host, path, rule, verdict and risk of each url, beside the kept columns.

    The rule's verdict stands where one fits; the trees learn from these URLs and judge
    the others, block from a risk of one half on.
    """
    host, path = split_url(F.col("url"))
    parted = pages.select(*keep, "url").withColumns({"host": host, "path": path})
    ruled = parted.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for word, rule in rules:
        verdict = F.when(F.col("rule") == rule, word).otherwise(verdict)
    ruled = ruled.withColumn("_said", verdict)
    labelled = ruled.where("_said is not null").select("url", "host", "path", (F.col("_said") == "block").alias("blocked"))
    scored = predict(ruled, train(labelled), [*keep, "host", "path", "rule", "_said"])
    learned = F.when(F.col("risk") >= 0.5, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce("_said", learned)).drop("_said")


def op4_url_verdicts(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
