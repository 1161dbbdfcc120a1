"""Collocated phrases from suffix subtrees (operator 12).

All phrases of up to four words with their counts are a suffix tree cut off at depth four.
It is built in the manner of ERA: the first words of suffixes are prefixes, a prefix with
more leaves than fit the memory budget is extended by a word, and prefixes are put into
groups within the budget. Each group's subtree is built on its own from its sorted leaves,
and the count of a phrase is the total of the leaves below its node.

Phrases that occur too rarely need no node. Before suffixes are shuffled, three passes
count words, pairs and triples in hashed buckets; a filter of fixed size holds the buckets
that reach the least count, and suffixes end where it lets them go no further. A filter
lets a rare phrase pass now and then, but never loses a frequent one, so counts stay exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepscope.llm.common import arrow_limits, stored, table

DEPTH = 4  # words of a phrase at most
LEAST = 30  # occurrences of a candidate
BUDGET = 250_000  # leaves of a group's subtree
HOT = 100_000  # prefixes of one length that are extended, at most
TOP = 2000  # phrases reported for each language
WITHIN = 80  # a phrase goes if a longer one around it has this percent of its count
FILTER_BITS = (16, 27)  # a filter has 2^16 to 2^27 bits, at most 16 MB
WORD_BITS = 24
SLOT = 1 << 16  # buckets whose counts travel together

CHUNK_WORDS = 2_000_000  # words a task numbers before it hands on counts
CHUNK_DISTINCT = 400_000
LONG = 4 << 20  # bytes; a longer text goes through in stretches of whole pieces
ROWS_OUT = 20_000

BORDER = b"\xff"  # in no UTF-8 text
TABLE = bytes.maketrans(
    bytes(range(65, 91)) + b"\t.,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + b" " + BORDER * 10
)
WORDS = [f"w{i + 1}" for i in range(DEPTH)]


def stretches(text: bytes) -> Iterator[bytes]:
    """The text, lower-cased and with borders marked; long ones cut at borders."""
    text = text.translate(TABLE)
    at = 0
    while len(text) - at > LONG:
        cut = text.find(BORDER, at + LONG)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class Chunk:
    """Words of a stretch of rows as numbers; number 0 is a border of a piece."""

    def __init__(self):
        self.next = count(1)
        self.by_lang: dict[bytes, dict[bytes, int]] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: bytes, text: bytes) -> None:
        known = self.by_lang.get(lang)
        if known is None:
            known = self.by_lang[lang] = defaultdict(self.next.__next__, {BORDER: 0})
        words = text.replace(BORDER, b" \xff ").split()
        if words:
            self.parts += [np.fromiter(map(known.__getitem__, words), np.int64, len(words)), np.zeros(1, np.int64)]
            self.size += len(words)

    def full(self) -> bool:
        return self.size > CHUNK_WORDS or sum(map(len, self.by_lang.values())) > CHUNK_DISTINCT

    def close(self) -> None:
        self.ids = np.concatenate([*self.parts, np.zeros(1, np.int64)])
        rows = sorted((i, lang, w) for lang, known in self.by_lang.items() for w, i in known.items() if i)
        self.langs = [b"", *(lang for _, lang, _ in rows)]
        self.words = [b"", *(w for _, _, w in rows)]

    def hashes(self) -> np.ndarray:
        """A hash of each (language, word)."""
        of = xxhash.xxh64_intdigest
        seeds = {lang: of(lang) for lang in self.by_lang} | {b"": of(b"")}
        return np.array([of(w, seeds[lang]) for lang, w in zip(self.langs, self.words)], np.uint64)

    def texts(self, ids: np.ndarray, langs: bool = False) -> pa.Array:
        return pa.array(self.langs if langs else self.words, pa.binary()).take(pa.array(ids)).cast(pa.string())


def scan(docs: DataFrame, work: Callable[[Chunk], dict[str, pa.Array]], schema: str) -> DataFrame:
    """Run a function of numbered words over all rows (lang, text), chunk by chunk.

    It gives columns of any number of rows. Nothing is shuffled.
    """
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(chunk: Chunk) -> Iterator[pa.RecordBatch]:
            chunk.close()
            made = pa.table(work(chunk))
            yield from made.to_batches(max_chunksize=ROWS_OUT)

        chunk = Chunk()
        for batch in batches:
            langs, texts = (batch.column(i).cast(pa.binary()) for i in range(2))
            for i in range(batch.num_rows):
                lang = langs[i].as_py()
                for text in stretches(texts[i].as_py()):
                    chunk.add(lang, text)
                    if chunk.full():
                        yield from closed(chunk)
                        chunk = Chunk()
        yield from closed(chunk)

    return docs.select("lang", "text").mapInArrow(run, schema)


@dataclass
class Filter:
    """Hashed buckets of phrases that may reach the least count."""

    bits: int
    held: np.ndarray  # a bit for each bucket

    def passes(self, keys: np.ndarray) -> np.ndarray:
        bucket = buckets(keys, self.bits)
        return (self.held[bucket >> 3] >> (bucket & 7).astype(np.uint8) & 1).astype(bool)


def buckets(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def phrase_keys(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the phrase of `size` words at each place, from the hashes of words."""
    x = hashes[at]
    for d in range(1, size):
        x = (x * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[at + d]
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x


def passing(chunk: Chunk, filters: list[Filter]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hashes of the words in order, and for each size where a phrase passes its filter."""
    own = chunk.hashes()
    hashes = own[chunk.ids]
    found = []
    for size, one in enumerate(filters, 1):
        if size == 1:
            ok = (chunk.ids > 0) & one.passes(own)[chunk.ids]
        else:
            ok = np.zeros(len(hashes), bool)
            at = np.flatnonzero(found[-1][:-1] & found[-1][1:])
            ok[at[one.passes(phrase_keys(hashes, at, size))]] = True
        found.append(ok)
    return hashes, found


def bucket_counts(filters: list[Filter], bits: int, most: int) -> Callable:
    """Counts of the buckets of phrases one word longer than the filters have.

    Comes in rows of a slot each: places in the slot, then counts, which stop at `most`.
    With no filters yet, rows with slot -1 say how many words a language has.
    """
    kind = np.uint8 if most < 256 else np.uint32

    def work(chunk: Chunk) -> dict[str, pa.Array]:
        langs, words = [], []
        if filters:
            hashes, found = passing(chunk, filters)
            at = np.flatnonzero(found[-1][:-1] & found[-1][1:])
            bucket, n = np.unique(buckets(phrase_keys(hashes, at, len(filters) + 1), bits), return_counts=True)
        else:
            each = np.bincount(chunk.ids, minlength=len(chunk.words))[1:]
            bucket, place = np.unique(buckets(chunk.hashes()[1:], bits), return_inverse=True)
            n = np.bincount(place, each, len(bucket)).astype(np.int64)
            for lang, known in chunk.by_lang.items():
                langs.append(lang.decode())
                words.append(int(each[np.fromiter(known.values(), np.int64, len(known))[1:] - 1].sum()))
        first = np.flatnonzero(np.diff(bucket // SLOT, prepend=-1))
        ends = [*first[1:].tolist(), len(bucket)]
        places, counts = (bucket % SLOT).astype(np.uint16), np.minimum(n, most).astype(kind)
        payload = [places[a:z].tobytes() + counts[a:z].tobytes() for a, z in zip(first.tolist(), ends)]
        return {
            "slot": pa.array([*(bucket[first] // SLOT).tolist(), *[-1] * len(langs)], pa.int64()),
            "counts": pa.array([*payload, *[b""] * len(langs)], pa.binary()),
            "lang": pa.array([None] * len(payload) + langs, pa.string()),
            "n": pa.array([None] * len(payload) + words, pa.int64()),
        }

    return work


COUNTS = "slot long, counts binary, lang string, n long"


def filter_of(rows: DataFrame, bits: int, least: int) -> Filter:
    """Add up the slots; the driver gets a bit for each bucket, 16 MB at most."""
    kind = np.uint8 if least < 256 else np.uint32
    width = 2 + np.dtype(kind).itemsize

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, counts in zip(*(c.to_pylist() for c in batch.columns)):
                size = len(counts) // width
                if slot not in total:
                    total[slot] = np.zeros(SLOT, np.int64)
                places = np.frombuffer(counts, np.uint16, size)
                total[slot][places] += np.frombuffer(counts, kind, size, 2 * size)
        held = [np.packbits(t >= least, bitorder="little").tobytes() for t in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int64()), pa.array(held, pa.binary())], ["slot", "held"])

    dealt = rows.where("slot >= 0").select("slot", "counts").repartition("slot")
    out = np.zeros(max(1 << bits, SLOT) // 8, np.uint8)
    for row in dealt.mapInArrow(added, "slot long, held binary").collect():
        at = row["slot"] * SLOT // 8
        out[at : at + SLOT // 8] = np.frombuffer(row["held"], np.uint8)
    return Filter(bits, out)


def bits_for(n: int) -> int:
    low, high = FILTER_BITS
    return min(max(int(n).bit_length(), low), high)


def suffixes(filters: list[Filter]) -> Callable:
    """Suffixes with their counts, each as long as its phrases pass, four words at most."""

    def work(chunk: Chunk) -> dict[str, pa.Array]:
        _, found = passing(chunk, filters)
        for _ in range(len(found), DEPTH):
            more = found[-1].copy()
            more[:-1] &= found[-1][1:]
            more[-1] = False
            found.append(more)
        start = np.flatnonzero(found[0])
        ids = np.concatenate([chunk.ids, np.zeros(DEPTH, np.int64)])
        window = [np.where(ok[start], ids[start + d], 0) for d, ok in enumerate(found)]
        order = np.lexsort(window[::-1])
        window = [w[order] for w in window]
        new = np.ones(len(order), bool)
        new[1:] = np.any([w[1:] != w[:-1] for w in window], axis=0)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(order)))
        window = [w[first] for w in window]
        made = {"lang": chunk.texts(window[0], True)}
        made |= {name: chunk.texts(w) for name, w in zip(WORDS, window, strict=True)}
        return made | {"f": pa.array(n.astype(np.int64))}

    return work


def subtree(leaves: pa.Table, least: int) -> pa.Table:
    """Nodes of a group's subtree that have the least count.

    Leaves are put in order; a node is a stretch of leaves with equal first words, and its
    count is their total. A node above the group's prefix has leaves elsewhere too and is
    left to the pass that extended it.
    """
    leaves = leaves.sort_by([(c, "ascending") for c in ["lang", *WORDS]])
    f, prefix = (leaves[c].to_numpy() for c in ("f", "depth"))
    new = np.zeros(len(f), bool)
    new[0] = True
    found = []
    for depth, word in enumerate(["lang", *WORDS]):
        column = leaves[word].combine_chunks()
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        if depth == 0:
            continue
        first = np.flatnonzero(new)
        total = np.add.reduceat(f, first)
        own = first[(total >= least) & (prefix[first] <= depth)]
        own_total = total[(total >= least) & (prefix[first] <= depth)]
        there = pc.not_equal(column.take(pa.array(own)), "").to_numpy(zero_copy_only=False)
        at = pa.array(own[there])
        parts = [leaves[c].combine_chunks().take(at) for c in WORDS[:depth]]
        found.append(
            pa.table(
                {
                    "lang": leaves["lang"].combine_chunks().take(at),
                    "phrase": pc.binary_join_element_wise(*parts, " "),
                    "f": pa.array(own_total[there].astype(np.int64)),
                }
            )
        )
    return pa.concat_tables(found)


def grouped(leaves: DataFrame, budget: int) -> tuple[DataFrame, list[DataFrame]]:
    """Leaves with the length of their prefix and their group, and nodes above the prefixes.

    A prefix is extended while more leaves than the budget lie below it. At most HOT
    prefixes of a length can, as the budget is at least one HOTth of all leaves, so they
    are broadcast. Prefixes are dealt to twice as many groups as the budget asks for, and
    to as many as there are shuffle partitions.
    """
    total = leaves.count()
    budget = max(budget, -(-total // HOT))
    depth: Column = F.lit(1)
    inner, upper = leaves, []
    for d in range(1, DEPTH):
        key = ["lang", *WORDS[:d]]
        below = inner.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("f"))
        hot = stored(below.where(F.col("n") > budget), "hot")
        if hot.isEmpty():
            break
        upper.append(hot.select("lang", F.concat_ws(" ", *WORDS[:d]).alias("phrase"), "f"))
        marks = F.broadcast(hot.select(*key, F.lit(True).alias(f"hot{d}")))
        leaves = leaves.join(marks, key, "left")
        inner = leaves.where(F.col(f"hot{d}"))
        depth = F.when(F.col(f"hot{d}"), F.lit(d + 1)).otherwise(depth)
    groups = max(-(-2 * total // budget), int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    prefix = [F.when(F.col("depth") > i, F.col(w)).otherwise("") for i, w in enumerate(WORDS)]
    group = F.pmod(F.xxhash64("lang", *prefix), F.lit(groups))
    return leaves.withColumn("depth", depth.cast("long")).withColumn("group", group), upper


def phrase_counts(
    docs: DataFrame, least: int = LEAST, budget: int = BUDGET
) -> tuple[DataFrame, DataFrame]:
    """Counts of all phrases of one to four words that occur `least` times or more.

    `docs` has lang and text. Returns (lang, phrase, f) and (lang, n), n counting all words.
    A null language counts as `und`, a null text has no words. Repeated rows count each
    time; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(scan(docs, bucket_counts([], WORD_BITS, least), COUNTS), "words")
    sizes = rows.where("slot < 0").groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0")
    bits = bits_for((sizes.agg(F.sum("n")).first()[0] or 0) // 4)
    filters = [filter_of(rows, WORD_BITS, least)]
    for _ in range(2, DEPTH):
        rows = scan(docs, bucket_counts(filters, bits, least), COUNTS)
        filters = [*filters, filter_of(rows, bits, least)]

    columns = ", ".join(f"{w} string" for w in ["lang", *WORDS])
    leaves = scan(docs, suffixes(filters), f"{columns}, f long")
    leaves = stored(leaves.groupBy("lang", *WORDS).agg(F.sum("f").alias("f")), "leaves")
    dealt, upper = grouped(leaves, budget)
    nodes = dealt.select("group", "depth", "lang", *WORDS, "f").groupBy("group").applyInArrow(
        lambda rows: subtree(rows, least), "lang string, phrase string, f long"
    )
    for more in upper:
        nodes = nodes.unionByName(more.where(F.col("f") >= least))
    return stored(nodes, "phrases"), sizes


def collocations(
    phrases: DataFrame, sizes: DataFrame, least: int = LEAST, top: int = TOP, within: int = WITHIN
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase scores by its weakest cut (ties: the earliest), in exact integers, and goes if
    a longer one around it has nearly its count. Ties of the score go to the larger count,
    then to the phrase in byte order.
    """
    words = F.split("phrase", " ")
    sized = phrases.withColumn("w", words).withColumn("size", F.size("w"))
    candidates = sized.where((F.col("size") >= 2) & (F.col("f") >= least))

    def sub(begin: Column | int, size: Column | int) -> Column:
        return F.array_join(F.slice("w", begin, size), " ")

    # Each cut asks for the counts of its two parts.
    cuts = candidates.select(
        "lang", "phrase", F.col("f").alias("a"),
        F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(
            k.alias("k"),
            F.array(sub(F.lit(1), k), sub(k + 1, F.col("size") - k)).alias("parts"),
        ))).alias("cut"),
    ).select("lang", "phrase", "a", "cut.k", F.posexplode("cut.parts").alias("side", "part"))
    known = phrases.select("lang", F.col("phrase").alias("part"), "f")
    l, r = (F.max(F.when(F.col("side") == s, F.col("f"))).alias(n) for s, n in ((0, "l"), (1, "r")))
    cut = cuts.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(l, r)
    exact = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div cast(l + r as decimal(20,0))")
    weakest = F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("c")
    scored = cut.groupBy("lang", "phrase", "a").agg(weakest)

    inside = candidates.where("size > 2").select(
        "lang", F.col("f").alias("longer"),
        F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda size: F.transform(
            F.sequence(F.lit(1), F.col("size") - size + 1), lambda begin: sub(begin, size)
        )))).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    around = F.coalesce(F.col("longer"), F.lit(0))
    left = scored.join(inside, ["lang", "phrase"], "left").where(100 * around < within * F.col("a"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    left = left.select("lang", "phrase", "a", "c.*").withColumn("lot", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    for key in (["lang", "lot"], ["lang"]):  # a language's best are among the best of its lots
        place = F.expr("row_number()").over(Window.partitionBy(*key).orderBy(*order))
        left = left.withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    return left.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of all documents by language.

    Null languages are `und`, null texts empty; repeated documents count each time and an
    empty table gives no rows.
    """
    return collocations(*phrase_counts(table(spark, sf_dir, "documents")))


OP12_SQL = r"""
WITH docs AS (
    SELECT coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs),
words AS (
    SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM places, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE i + k - 1 <= len(w)
),
freq AS (SELECT lang, k AS size, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM freq WHERE size = 1 GROUP BY lang),
candidates AS (
    SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE size >= 2 AND f >= 30
),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM candidates),
scored AS (
    SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
        (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
    FROM cuts c
    JOIN freq x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
    JOIN freq y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
),
weakest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
),
spans AS (
    SELECT lang, a, w, size, unnest(range(2, size)) AS part FROM candidates WHERE size > 2
),
inner_phrases AS (
    SELECT lang, a, w, part, unnest(range(1, size - part + 2)) AS i FROM spans
),
longer AS (
    SELECT lang, array_to_string(w[i:i + part - 1], ' ') AS phrase, max(a) AS most FROM inner_phrases GROUP BY ALL
),
ranked AS (
    SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) AS rank,
        phrase, a, l, r, score
    FROM weakest s LEFT JOIN longer USING (lang, phrase) WHERE 100 * coalesce(most, 0) < 80 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
