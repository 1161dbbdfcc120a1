"""Near duplicates by SimHash, compared exactly in tiles (operator 8).

Every distinct fingerprint lies in a cell given by the population counts of its four
16-bit quarters; a cell with many of them is cut into tiles. Two fingerprints within the
radius have counts that differ by no more than the radius in sum, so only such tile pairs
are compared, whole, with exclusive-or and bit counts in numpy. Each tile hands on a
spanning forest of what it linked, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepscope.llm.common import arrow_limits, aside, back, map_texts, stored, table
from stepscope.operators.components import components

SHINGLE = 3  # words
RADIUS = 2  # differing bits
SEED = 42
TILE = 32_768  # fingerprints of a tile
ROWS, COLUMNS = 512, 4096  # compared at a time
QUARTERS = 4
SIDE = 17  # population counts of 16 bits


def hashes(text: bytes | None, shingle: int = SHINGLE) -> bytes:
    """XXH64 of each word shingle, eight bytes each; a text of fewer words is one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return b""
    if len(words) < shingle:
        return xxhash.xxh64_digest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_digest, b" ".join
    return b"".join([digest(join(s), SEED) for s in zip(*[words[i:] for i in range(shingle)])])


def fingerprint(digests: bytes) -> int:
    """Majority of the hashes' bits, as a signed number; zero without hashes."""
    bits = np.frombuffer(digests, np.uint8)
    count = np.zeros(64, np.int64)
    for at in range(0, len(bits), 1 << 19):
        count += np.unpackbits(bits[at : at + (1 << 19)]).reshape(-1, 64).sum(0, dtype=np.int64)
    set_bits = count * 2 > len(bits) // 8
    return int(np.packbits(set_bits).view(">i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Add fp, the fingerprint as a signed long, to the kept columns."""

    def work():
        return lambda texts: {"fp": [fingerprint(hashes(t)) for t in texts]}

    return map_texts(docs, work, [T.StructField("fp", T.LongType())], keep, text, raw=True)


def cells(fps: np.ndarray) -> np.ndarray:
    """Population counts of the quarters of each fingerprint."""
    return np.stack(
        [np.bitwise_count(fps >> np.uint64(16 * q) & np.uint64(0xFFFF)) for q in range(QUARTERS)], 1
    ).astype(np.int64)


def offsets(radius: int) -> np.ndarray:
    """Differences of counts that two fingerprints within the radius can have."""
    return np.array(
        [d for d in product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, d)) <= radius]
    )


class Tiles:
    """Where the tiles lie: tile numbers follow each other in order of cells."""

    def __init__(self, counts: dict[int, int], radius: int, tile: int):
        need = np.zeros(SIDE**QUARTERS, np.int64)
        for cell, n in counts.items():
            need[cell] = -(-n // tile)
        self.need, self.radius = need, radius
        self.first = np.cumsum(need) - need

    def visits(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of each visit, the tile visited, and whether it is the fingerprint's own.

        Of two tiles to compare the one with the smaller number visits the other.
        """
        count = cells(fps)
        weights = SIDE ** np.arange(QUARTERS)
        home_cell = count @ weights
        spread = (fps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        home = self.first[home_cell] + (spread.astype(np.int64) % np.maximum(self.need[home_cell], 1))
        rows, tiles = [np.arange(len(fps))], [home]
        for d in offsets(self.radius):
            there = count + d
            inside = ((there >= 0) & (there < SIDE)).all(1)
            cell = np.where(inside, there @ weights, 0)
            n = np.where(inside, self.need[cell], 0)
            row = np.repeat(np.arange(len(fps)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            tile = self.first[cell][row] + step
            ahead = tile > home[row]
            rows.append(row[ahead])
            tiles.append(tile[ahead])
        row, tile = np.concatenate(rows), np.concatenate(tiles)
        return row, tile, np.arange(len(row)) < len(fps)


def settle(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Give linked members one label, the least of theirs."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label = label[label]
        i, j = i[apart], j[apart]


def near(x: np.ndarray, y: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius, block by block."""
    for i in range(0, len(x), ROWS):
        for j in range(0, len(y), COLUMNS):
            apart = np.bitwise_count(x[i : i + ROWS, None] ^ y[None, j : j + COLUMNS])
            a, b = np.nonzero(apart <= radius)
            if len(a):
                yield a + i, b + j


class Linker:
    """Compares the rows of one tile, its own fingerprints first, then its visitors."""

    def __init__(self, radius: int):
        self.radius, self.own, self.label = radius, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def begin(self, own: np.ndarray) -> None:
        self.own, self.label = own, np.arange(len(own))
        for i, j in near(own, own, self.radius):
            self.label = settle(self.label, i, j)

    def visit(self, guests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of guests to one near member each; members with a guest in common join."""
        found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        anchor = np.full(len(guests), -1)
        for j, i in near(guests, self.own, self.radius):
            fresh, at = np.unique(j, return_index=True)
            at, fresh = at[anchor[fresh] < 0], fresh[anchor[fresh] < 0]
            anchor[fresh] = i[at]
            found[0].append(fresh)
            found[1].append(anchor[fresh])
            self.label = settle(self.label, i, anchor[j])
        return guests[np.concatenate(found[0])], self.own[np.concatenate(found[1])]

    def end(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(self.label != np.arange(len(self.own)))
        return self.own[moved], self.own[self.label[moved]]


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints: a forest with all components of the near pairs."""
    arrow_limits(distinct.sparkSession)
    fp = F.col("fp")
    quarter = [F.bit_count(F.shiftrightunsigned(fp, 16 * q).bitwiseAND(F.lit(0xFFFF))) for q in range(QUARTERS)]
    cell = sum((q.cast("int") * SIDE**i for i, q in enumerate(quarter)), F.lit(0))
    # At most 17 ** 4 rows, whatever the size of the corpus.
    counts = distinct.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()
    shared = distinct.sparkSession.sparkContext.broadcast(
        Tiles({r["cell"]: r["n"] for r in counts}, radius, tile)
    )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            row, at, own = shared.value.visits(fps)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array((~own).astype(np.int32)), pa.array(fps[row].view(np.int64))],
                names=["tile", "guest", "fp"],
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linker, now, own = Linker(radius), None, []

        def made(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
            )

        def begin() -> None:
            nonlocal own
            if own:
                linker.begin(np.concatenate(own))
                own = []

        for batch in batches:
            at, guest = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fps = batch.column(2).to_numpy().view(np.uint64)
            cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(guest) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(at)]):
                if at[lo] != now:
                    if now is not None:
                        begin()
                        yield made(*linker.end())
                    now = at[lo]
                    linker.begin(np.zeros(0, np.uint64))
                if guest[lo]:
                    begin()
                    yield made(*linker.visit(fps[lo:hi]))
                else:
                    own.append(fps[lo:hi])
        if now is not None:
            begin()
            yield made(*linker.end())

    sent = distinct.select("fp").mapInArrow(send, "tile long, guest int, fp long")
    dealt = sent.repartition("tile").sortWithinPartitions("tile", "guest")
    return dealt.mapInArrow(compare, "a long, b long")


def linked(rows: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """Components of stored rows of (key, fp): columns fp, root_key and root_fp.

    The root is the member with the smallest key, null keys last; of rows with equal
    keys the one with the smallest fingerprint. Equal fingerprints are one row here, so
    copies cost nothing after the first aggregate, however many they are.
    """
    distinct = stored(rows.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    found = components(links(distinct, radius))
    member = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    member = stored(member, "members")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("root")
    roots = member.groupBy("component").agg(first)
    return member.join(roots, "component").select(
        "fp", F.col("root.least").alias("root_key"), F.col("root.fp").alias("root_fp")
    )


def op8_simhash_tiles(spark, sf_dir: str) -> DataFrame:
    rows = stored(fingerprints(table(spark, sf_dir, "documents"), ["doc_id"]), "fingerprints")
    return rows.join(linked(rows), "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("root_key").alias("component_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near duplicates of a smaller id, with their columns.

    Of repeated rows with one id and one fingerprint one stays; documents without an id
    stay only where no member of their group has one.
    """
    own, names = aside(docs)
    key = names["doc_id"]
    rows = stored(fingerprints(docs, ["doc_id"]), "fingerprints")
    root = F.struct(F.col("root_key").alias("key"), F.col("root_fp").alias("fp"))
    roots = linked(rows).select(root.alias("_root")).distinct()
    # Join and repeats go by one column, null keys equal in it, so that texts are shuffled once.
    marked = fingerprints(own, [*names.values()], names["text"])
    marked = marked.withColumn("_root", F.struct(F.col(key).alias("key"), "fp")).drop("fp")
    return marked.join(roots, "_root").dropDuplicates(["_root"]).select(*back(names))
