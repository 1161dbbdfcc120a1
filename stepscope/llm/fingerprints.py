"""SimHash fingerprints of documents, in DataFrame operations only (operator 9).

The terms of a text are its distinct pairs of neighbouring words, or its only word. A pair
of two long words weighs twice as much as others, since short words say little. The hash
of each term votes on 128 signed bits with the term's weight; a bit is set if more than
half of the weight says so. Votes are summed two bits to a long, 32 bits each, so that 64
sums carry all 128.

Fingerprints within a Hamming radius are found with block tables: the bits are cut into
more blocks than may differ, so that some blocks agree; for every choice of these a table
holds the fingerprints with the chosen blocks in front, as the key to join on.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepscope.llm.common import stored, table

BITS = 128
LONG = 4  # letters of a long word
WHITE = r"[\x20\x09-\x0D]+"
LANES = 0x0000000100000001  # the lowest bits of both halves of a long
HALVES = ("high", "low")
RADIUS, BLOCKS = 3, 4
ROWS = 4096  # documents of a bucket, at the least
BUCKETS = 65_536  # buckets of documents, at the most
STEPS = 64  # quantiles of the ids that buckets are laid out by
HOT_IDS = 1000  # ids with more than one HOT_IDS-th of the rows are split, each into
SHARES = 64  # buckets by the hash of the text


def terms(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """The key and t, hashes of the distinct terms; the lowest bit is set for a double weight.

    Each array has a column of its own, so that none is worked out twice.
    """
    marked = lambda h, heavy: h.bitwiseAND(F.lit(-2)).bitwiseOR(heavy.cast("long"))
    words = F.transform(
        F.filter(F.split(F.col(text), WHITE), lambda w: w != ""),
        lambda w: marked(F.xxhash64(w), F.char_length(w) >= LONG),
    )
    pairs = F.zip_with(
        F.slice("w", 1, F.size("w") - 1),
        F.slice("w", 2, F.size("w") - 1),
        lambda a, b: marked(F.xxhash64(a, b), a.bitwiseAND(b).bitwiseAND(F.lit(1))),
    )
    hashed = texts.select(*key, words.alias("w"))
    paired = hashed.select(*key, F.when(F.size("w") > 1, pairs).otherwise(F.col("w")).alias("t"))
    return paired.select(*key, F.array_distinct("t").alias("t"))


def _sums(hashes: dict[str, Column]) -> list[Column]:
    return [
        F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LANES)) * F.col("weight")).alias(f"{name}{k}")
        for name, h in hashes.items()
        for k in range(32)
    ]


def _half(name: str) -> Column:
    """64 bits from the sums: bit k from the lower half of sum k, bit k + 32 from the upper."""
    bits = F.lit(0).cast("long")
    for k in range(32):
        total = F.coalesce(F.col(f"{name}{k}"), F.lit(0))
        lower, upper = total.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(total, 32)
        for bit, votes in ((k, lower), (k + 32, upper)):
            set_bit = F.when(votes * 2 > F.col("weight"), F.shiftleft(F.lit(1).cast("long"), bit))
            bits = bits.bitwiseOR(F.coalesce(set_bit, F.lit(0).cast("long")))
    return bits


def simhash(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """Fingerprint, as longs high and low, for each row of (key, text); keys must be unique.

    A text without terms, and a null one, has no set bit. Sums of weights stay below 2^32
    for texts of up to a billion words.
    """
    each = terms(texts, key, text).select(*key, F.explode_outer("t").alias("t"))
    each = each.select(
        *key,
        F.coalesce(F.col("t").bitwiseAND(F.lit(1)) + 1, F.lit(0).cast("long")).alias("weight"),
        F.xxhash64("t", F.lit(0)).alias("a"),
        F.xxhash64("t", F.lit(1)).alias("b"),
    )
    hashes = dict(zip(HALVES, (F.col("a"), F.col("b"))))
    votes = each.groupBy(*key).agg(F.sum("weight").alias("weight"), *_sums(hashes))
    return votes.select(*key, *[_half(h).alias(h) for h in HALVES])


def shown(high: Column, low: Column) -> Column:
    """32 hexadecimal digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in (high, low)]))


def apart(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Number of differing bits."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)), F.lit(0))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """1 for equal fingerprints, 0 from half of the bits on: the cosine that the bits estimate."""
    return F.greatest(F.lit(0.0), F.cos(apart(a, b) * F.lit(3.141592653589793 / BITS)))


def block_keys(high: Column, low: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """Array of (table, key): for each choice of blocks that may all agree, their bits in front.

    Blocks are equal cuts of the 128 bits; with `blocks` blocks and `radius` bits apart at
    least blocks - radius of them agree.
    """
    if blocks <= radius or BITS % blocks or 64 % (BITS // blocks):
        raise ValueError("blocks must divide the bits and outnumber the radius")
    size = BITS // blocks
    mask = F.lit((1 << size) - 1 if size < 63 else -1)
    cut = []
    for i in range(blocks):
        half, shift = (high, low)[i * size // 64], i * size % 64
        cut.append(F.shiftrightunsigned(half, shift).bitwiseAND(mask))
    tables = combinations(range(blocks), blocks - radius)
    return F.array(
        *[F.struct(F.lit(t).alias("table"), F.array(*[cut[i] for i in chosen]).alias("front")) for t, chosen in enumerate(tables)]
    )


def find_near(queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs of distinct fingerprints within the radius: query_high, query_low, high, low, bits.

    Both sides have columns high and low; copies should be gathered to one row before. A
    pair is found in several tables and is reported by the first one that holds it.
    """
    q = queries.select(F.col("high").alias("query_high"), F.col("low").alias("query_low")).distinct()
    q = q.withColumn("k", F.explode(block_keys(F.col("query_high"), F.col("query_low"), radius, blocks)))
    x = index.select("high", "low").distinct()
    x = x.withColumn("k", F.explode(block_keys(F.col("high"), F.col("low"), radius, blocks)))
    bits = apart((F.col("query_high"), F.col("query_low")), (F.col("high"), F.col("low")))
    ours = block_keys(F.col("query_high"), F.col("query_low"), radius, blocks)
    theirs = block_keys(F.col("high"), F.col("low"), radius, blocks)
    shared = F.array_intersect(ours, theirs)  # in order of tables
    first = F.element_at(shared, 1)["table"] == F.col("table")
    q = q.select("query_high", "query_low", F.col("k.table").alias("table"), F.col("k.front").alias("front"))
    x = x.select("high", "low", F.col("k.table").alias("x_table"), F.col("k.front").alias("x_front"))
    on = (F.col("table") == F.col("x_table")) & (F.col("front") == F.col("x_front")) & (bits <= radius) & first
    return q.join(x, on).select("query_high", "query_low", "high", "low", bits.alias("bits"))


def in_order(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add bucket, place within it and the text that follows in order of the key, text breaking ties.

    Buckets are ranges of the key: equal steps between the quantiles of the ids, so that
    neither gaps nor outliers fill one. The last of a bucket is followed by the first of
    the next one, the very last by the very first. Null keys come first. An id that very
    many rows share, null or not, has buckets of its own; its texts are in order of their
    hash first, so that they spread over these. Texts must not be null.
    """
    spark = docs.sparkSession
    stats = docs.agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx(key, [i / STEPS for i in range(STEPS + 1)], 10_000).alias("q"),
    ).first()
    sizes = docs.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    often = sizes.where(F.col("n") > max(ROWS, stats["n"] // HOT_IDS)).collect()  # at most HOT_IDS
    hot = sorted(r["id"] for r in often if r["id"] is not None)
    bounds = sorted({*(stats["q"] or [0]), *hot, *(i + 1 for i in hot)})
    parts = max(1, min(BUCKETS, stats["n"] // ROWS) // max(len(bounds), 1) + 1)
    lows = F.array(*[F.lit(b).cast("long") for b in bounds])
    width = F.array(*[F.lit(max(1, -(-(b - a) // parts))).cast("long") for a, b in zip(bounds, [*bounds[1:], bounds[-1] + 1])])
    step = F.greatest(F.size(F.filter(lows, lambda b: b <= F.col(key))), F.lit(1))
    inside = F.least(F.lit(parts - 1), F.floor((F.col(key) - F.element_at(lows, step)) / F.element_at(width, step)))
    numbered = step.cast("long") * parts + F.greatest(inside, F.lit(0))
    numbered = F.when(F.col(key).isNull(), F.lit(-1).cast("long")).otherwise(numbered)
    unnamed = F.lit(any(r["id"] is None for r in often))
    shared = F.when(F.col(key).isNull(), unnamed).otherwise(F.col(key).isin(hot))
    tie = F.when(shared, F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    share = F.when(shared, F.shiftright("tie", 64 - SHARES.bit_length() + 1) + SHARES // 2).otherwise(0)
    docs = docs.withColumn("tie", tie)
    bucket = numbered * SHARES + share

    # Which bucket follows which: ids only, at most BUCKETS + STEPS + HOT_IDS * (SHARES + 2) rows.
    begins = docs.select(key, "tie").groupBy(bucket.alias("bucket")).agg(F.min(key).alias("first")).collect()
    begins = sorted((r["bucket"], r["first"]) for r in begins)
    pairs = [(b, last[0]) for last, (b, _) in zip([begins[-1], *begins[:-1]], begins)] if begins else []
    after = F.broadcast(spark.createDataFrame(pairs, "b long, previous long"))
    heads = F.broadcast(spark.createDataFrame(begins, "b long, least long"))

    order = Window.partitionBy("bucket").orderBy(key, "tie", "text")
    rows = docs.withColumn("bucket", bucket).withColumns(
        {"place": F.row_number().over(order), "next": F.lead("text").over(order), "inner": F.lead(F.lit(True)).over(order)}
    )
    firsts = (
        docs.withColumn("b", bucket)
        .join(heads, "b")
        .where(F.col(key).eqNullSafe(F.col("least")))
        .groupBy("b")
        .agg(F.min(F.struct("tie", F.coalesce("text", F.lit("")))).alias("first"))
        .join(after, "b")
        .select("previous", F.col("first.col2").alias("first_text"))
    )
    joined = rows.join(firsts, (rows["bucket"] == firsts["previous"]) & F.col("inner").isNull(), "left")
    return joined.withColumn(
        "next", F.coalesce(F.when(F.col("inner"), F.coalesce("next", F.lit(""))).otherwise(F.col("first_text")), F.lit(""))
    ).drop("inner", "previous", "first_text", "tie")


def followed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Add next_<column> of the row that follows, for stored rows of (bucket, place)."""
    order = Window.partitionBy("bucket").orderBy("place")
    lead = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    begins = rows.where("place = 1").select("bucket", *[F.col(c).alias(f"first_{c}") for c in columns])
    # One row per bucket: their order is a matter of bucket numbers alone.
    around = Window.orderBy("bucket")
    firsts = begins.withColumn("previous", F.lag("bucket").over(around))
    last = F.max("bucket").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.withColumn("previous", F.coalesce("previous", last)).drop("bucket")
    end = F.col(f"next_{columns[0]}").isNull()
    joined = lead.join(firsts, (lead["bucket"] == firsts["previous"]) & end, "left")
    filled = {f"next_{c}": F.coalesce(f"next_{c}", f"first_{c}") for c in columns}
    return joined.withColumns(filled).drop("previous", *[f"first_{c}" for c in columns])


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Stored rows of doc_id, bucket, place, n_chars, edited_sha256, high, low, edited_high, edited_low.

    In the edited text the last quarter of the code points is replaced by as many of the
    next document's first ones, or by all it has. Null texts count as empty.
    """
    rows = in_order(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - quarter), F.substr("next", F.lit(1), quarter))
    digest = F.sha2(edited.cast("binary"), 256)
    # The key of the votes is made of longs, which hash fast: the digest is four of them.
    parts = {f"s{i}": F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("long") for i in range(4)}
    key = ["bucket", "place", "doc_id", "n_chars", *parts]
    rows = rows.select(
        "bucket", F.col("place").cast("long").alias("place"), "doc_id", n.cast("long").alias("n_chars"),
        *[c.alias(k) for k, c in parts.items()],
        F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("text")) for k, c in ((0, F.col("text")), (1, edited))])).alias("v"),
    )
    prints = simhash(rows.select(*key, "v.kind", "v.text"), [*key, "kind"], "text")
    pick = lambda kind, half: F.max(F.when(F.col("kind") == kind, F.col(half)))
    both = prints.groupBy(*key).agg(
        *[pick(0, h).alias(h) for h in HALVES], *[pick(1, h).alias(f"edited_{h}") for h in HALVES]
    )
    shown_digest = F.lower(F.concat(*[F.lpad(F.hex(k), 16, "0") for k in parts]))
    return stored(both.withColumn("edited_sha256", shown_digest).drop(*parts), "fingerprints")


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and for documents whose id is divisible by 50 n_near: how many
    other fingerprints lie within the radius, found with the block tables."""
    rows = edited_pairs(table(spark, sf_dir, "documents"))
    near = (
        find_near(rows.where("doc_id % 50 = 0"), rows)
        .where("bits > 0")
        .groupBy("query_high", "query_low")
        .agg(F.count(F.lit(1)).alias("found"))
    )
    own, edited, following = [tuple(F.col(f"{p}{h}") for h in HALVES) for p in ("", "edited_", "next_")]
    lined = followed(rows, ["high", "low"])
    asked = (F.col("doc_id") % 50 == 0) & (F.col("high") == F.col("query_high")) & (F.col("low") == F.col("query_low"))
    return lined.join(near, asked, "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(*own).alias("fingerprint"),
        shown(*edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"),
        likeness(own, following).alias("near_next"),
        F.when(F.col("doc_id") % 50 == 0, F.coalesce("found", F.lit(0))).alias("n_near"),
    )
