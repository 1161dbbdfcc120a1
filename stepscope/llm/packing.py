"""Packing documents into training sequences by a linear grouping scheme (operator 6).

Documents become token pieces of at most one sequence. The packing is planned on the
histogram of piece lengths, which has no more entries than a sequence has tokens:

1. large lengths are sorted and cut into groups of equal cardinality, and each is rounded
   up to the longest of its group, so that few sizes remain;
2. configurations of these sizes, the ways to fill a sequence, are optimised as a linear
   program by column generation and rounded down;
3. the places of each configuration are given to actual lengths of the group, the last one
   to the longest length of any group that still fits;
4. sequences that stay too empty are opened again, and their lengths, what is left over and
   the small lengths go best-fit into the room that remains. How empty a sequence may stay
   is chosen from a few bounds by the number of sequences.

Pieces then find their places by their number among the pieces of their length.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepscope.llm.common import arrow_limits, map_texts, stored, table

CAPACITY = 1024
END = 2  # id behind each document
GROUPS = 128
SMALL = 8  # lengths up to capacity / SMALL are small
ROUNDS = 1000  # of column generation, at most
EMPTY = (0, 1 / 128, 1)  # shares of a sequence that may stay empty before best fit, tried in turn
CALL = 4096  # chunks of one call of the library
SPACE = "\u0120"  # how the byte-level alphabet writes a space
CACHE = 400_000  # chunks a worker remembers, about 200 bytes each


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts as little-endian 32-bit numbers, by the tokenizers library.

    The byte-level pattern begins a new word at every space between two characters that
    are not white, and no merge crosses its words. So texts are split at such spaces, each
    distinct chunk is encoded once, with its space, and remembered. A text in which white
    characters meet a space goes through the library as a whole, and so does one that holds
    the content of an added token, which the library cuts out before it looks for words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        names = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
        self.spaced = np.array([n is not None and n.startswith(SPACE) for n in names])

    def ids(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in made]

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk with a space before it, many chunks to a call.

        A chunk's first id is the only one that begins with a space.
        """
        out = []
        for at in range(0, len(chunks), CALL):
            part = chunks[at : at + CALL]
            ids = np.frombuffer(self.ids([" " + " ".join(part)])[0], np.uint32)
            cut = [*np.flatnonzero(self.spaced[ids]).tolist(), len(ids)]
            if len(cut) != len(part) + 1:
                raise ValueError("chunks and ids do not match")
            data = ids.tobytes()
            out += [data[4 * a : 4 * z] for a, z in zip(cut, cut[1:])]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        split = [[t] if any(a in t for a in self.added) else t.split(" ") for t in texts]
        heads = self.ids([s[0] for s in split])
        found = [list(map(known.get, s[1:])) for s in split]
        missing = {c for s, f in zip(split, found) if None in f for c, v in zip(s[1:], f) if v is None}
        regular = [c for c in missing if c and not c[0].isspace() and not c[-1].isspace()]
        fresh = dict(zip(regular, self.chunks(regular), strict=True))
        room = max(CACHE - len(known), 0)
        known |= fresh if len(fresh) <= room else {c: fresh[c] for c in regular[:room]}
        out = []
        for text, s, head, f in zip(texts, split, heads, found):
            if None in f:
                f = [fresh.get(c) if v is None else v for c, v in zip(s[1:], f)]
            if f and (None in f or not s[0] or s[0][-1].isspace()):
                out += self.ids([text])
            else:
                out.append(head + b"".join(f))
        return out


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One encoder with its memory for all tasks of a worker."""
    return Encoder(path)


def pieces(docs: DataFrame, keep: list[str], path: Callable[[], str] = tokenizer_path, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """Rows per piece: the kept columns, piece, start, length, ids_crc32, part and number.

    A document longer than `capacity` is cut from its end, so that only the first piece
    is shorter. Null texts count as empty; every document has at least its end id.
    `part` and `number` count the pieces of one length within a task.
    """

    def work():
        encoder, seen = encoder_of(path()), {}
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        end = array("I", [END]).tobytes()

        def of(texts):
            out = {"_row": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "part": [], "number": []}
            for row, ids in enumerate(encoder.encode([t or "" for t in texts])):
                ids += end
                n = len(ids) // 4
                bounds = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, z) in enumerate(zip(bounds, bounds[1:])):
                    seen[z - a] = seen.get(z - a, -1) + 1
                    made = (row, k, a, z - a, zlib.crc32(ids[4 * a : 4 * z]), part, seen[z - a])
                    for values, value in zip(out.values(), made, strict=True):
                        values.append(value)
            return out

        return of

    fields = [
        T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        T.StructField("part", T.IntegerType()), T.StructField("number", T.LongType()),
    ]
    return map_texts(docs, work, fields, keep, text)


def best_configuration(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits: an unbounded knapsack."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = np.searchsorted(sizes, room, "right")
        best[room] = best[room - 1]
        if fits:
            gain = values[:fits] + best[room - sizes[:fits]]
            top = int(gain.argmax())
            if gain[top] > best[room] + 1e-12:
                best[room], last[room] = gain[top], top
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if last[room] < 0 or best[room] == best[room - 1]:
            room -= 1
        else:
            pattern[last[room]] += 1
            room -= sizes[last[room]]
    return float(best[capacity]), pattern


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (rows) and how often to use each, from the linear program.

    The basis starts with the configurations of one size alone and is improved column
    by column. Any basis is a valid packing, so stopping early only costs room.
    """
    basis = np.diag(capacity // sizes).astype(float)
    x = np.linalg.solve(basis, need.astype(float))
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(len(sizes)))
        worth, pattern = best_configuration(price, sizes, capacity)
        if worth <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, pattern.astype(float))
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = pattern
        x = np.maximum(np.linalg.solve(basis, need.astype(float)), 0)
    return basis.T.round().astype(np.int64), x


@dataclass
class Bins:
    """`count` sequences with the same content: (length, how many) in order."""

    count: int
    room: int
    items: list[tuple[int, int]] = field(default_factory=list)

    def split(self, n: int) -> Bins:
        self.count -= n
        return Bins(n, self.room, list(self.items))

    def put(self, length: int, times: int) -> None:
        self.items.append((length, times))
        self.room -= length * times


def grouped(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths, longest first, cut into groups with about equally many pieces.

    A length stays whole, so that a frequent one is a group of its own.
    """
    total, out, held = sum(counts.values()), [[]], 0
    for length in sorted(counts, reverse=True):
        if out[-1] and held + counts[length] / 2 > total / groups:
            out.append([])
            held = 0
        out[-1].append((length, counts[length]))
        held += counts[length]
    return out if out[0] else []


def substituted(
    parts: list[list[tuple[int, int]]], rows: np.ndarray, times: np.ndarray, capacity: int
) -> tuple[list[Bins], dict[int, int]]:
    """Sequences with actual lengths for the configurations, and the pieces left over.

    A place gets the longest length left in its group. Lengths below the rounded size leave
    room, so the last place gets the longest length of any group that fits.
    """
    left = {length: n for p in parts for length, n in p}
    names = sorted(left)
    low, high = [p[-1][0] for p in parts], [p[0][0] for p in parts]
    done: list[Bins] = []

    def longest(upto: int, least: int, held: dict[int, int]) -> int | None:
        at = bisect_right(names, upto) - 1
        while at >= 0 and names[at] >= least:
            if left[names[at]] > held.get(names[at], 0):
                return names[at]
            at -= 1  # at most as often as there are places in a sequence
        return None

    for row, often in sorted(zip(rows.tolist(), times.tolist()), key=lambda r: (-r[1], r[0])):
        often = int(often + 1e-9)
        places = [g for g in range(len(parts) - 1, -1, -1) for _ in range(row[g])]
        while often > 0:
            # A run of sequences gets the same lengths, as long as they last.
            held: dict[int, int] = {}
            room = capacity
            for g in places[:-1]:
                length = longest(high[g], low[g], held)
                if length is None:
                    break
                held[length] = held.get(length, 0) + 1
                room -= length
            else:
                length = longest(room, 1, held)
            if length is None:
                break
            held[length] = held.get(length, 0) + 1
            run = min(often, *(left[k] // n for k, n in held.items()))
            bins = Bins(run, capacity)
            for k, n in held.items():
                bins.put(k, n)
                left[k] -= n * run
                if not left[k]:
                    names.pop(bisect_left(names, k))
            done.append(bins)
            often -= run
    return done, {k: n for k, n in left.items() if n}


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Bins]:
    """Bins that hold exactly `counts[length]` pieces of every length."""
    counts = {k: n for k, n in counts.items() if n}
    parts = grouped({k: n for k, n in counts.items() if k > capacity // SMALL}, groups)[::-1]
    small = {k: n for k, n in counts.items() if k <= capacity // SMALL}
    if not parts:
        return best_fit([], small, capacity)
    sizes = np.array([p[0][0] for p in parts])  # smallest sizes first
    need = np.array([sum(n for _, n in p) for p in parts])
    rows, times = configurations(sizes, need, capacity)
    plans = []
    for share in EMPTY:
        done, left = substituted(parts, rows, times, capacity)
        left |= small
        for b in done:
            if b.room > share * capacity:
                for length, n in b.items:
                    left[length] = left.get(length, 0) + n * b.count
        plans.append(best_fit([b for b in done if b.room <= share * capacity], left, capacity))
    return min(plans, key=lambda bins: sum(b.count for b in bins))


def best_fit(done: list[Bins], left: dict[int, int], capacity: int) -> list[Bins]:
    """Put pieces into sequences, longest first: the tightest room that takes it, else a new one."""
    rooms = sorted({b.room for b in done})
    by_room: dict[int, list[Bins]] = {}
    for b in done:
        by_room.setdefault(b.room, []).append(b)

    def add(b: Bins) -> None:
        if b.room not in by_room or not by_room[b.room]:
            if b.room not in by_room:
                insort(rooms, b.room)
            by_room.setdefault(b.room, [])
        by_room[b.room].append(b)

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(rooms, length)
            while at < len(rooms) and not by_room[rooms[at]]:
                at += 1
            if at == len(rooms):
                each = min(capacity // length, n)
                b = Bins(max(n // each, 1), capacity)
            else:
                b = by_room[rooms[at]].pop()
                each = min(b.room // length, n)
                if b.count > n // each:
                    rest, b = b, b.split(max(n // each, 1))
                    add(rest)
            b.put(length, each)
            n -= each * b.count
            add(b)
    return [b for bins in by_room.values() for b in bins]


class Places:
    """Looks up sequence and offset by length and number of a piece."""

    def __init__(self, bins: list[Bins]):
        runs: dict[int, list[tuple]] = {}
        used: dict[int, int] = {}
        sequence = 0
        for b in bins:
            offset = 0
            for length, times in b.items:
                first = used.get(length, 0)
                runs.setdefault(length, []).append((first, sequence, offset, times))
                used[length] = first + b.count * times
                offset += length * times
            sequence += b.count
        self.sequences = sequence
        self.runs = {k: np.array(v, np.int64).T for k, v in runs.items()}

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for rows in np.split(order, cuts) if len(order) else []:
            size = int(length[rows[0]])
            first, begin, shift, times = self.runs[size]
            run = np.searchsorted(first, number[rows], "right") - 1
            local = number[rows] - first[run]
            sequence[rows] = begin[run] + local // times[run]
            offset[rows] = shift[run] + local % times[run] * size
        return sequence, offset


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to stored pieces; drops part and number.

    The driver sees the histogram of lengths only, `capacity` numbers at the most.
    """
    arrow_limits(cut.sparkSession)
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    total = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = cut.sparkSession.sparkContext.broadcast(Places(plan(total, capacity)))
    kept = [c for c in cut.columns if c not in ("part", "number")]
    numbered = cut.join(shifts, ["part", "length"]).select(*kept, (F.col("number") + F.col("shift")).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            sequence, offset = shared.value.find(length, batch.column(len(kept)).to_numpy())
            arrays = [batch.column(i) for i in range(len(kept))] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "sequence_id", "offset"])

    new = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return numbered.mapInArrow(run, T.StructType([cut.schema[c] for c in kept] + new))


def packed_documents(docs: DataFrame) -> DataFrame:
    return pack(stored(pieces(docs, ["doc_id"]), "pieces"))


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
