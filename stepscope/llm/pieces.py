"""SentencePiece encoding and decoding for merge-type vocabularies (operator 7).

Adjacent symbols whose concatenation is a piece stand in an agenda ordered by the piece's
score, then by place; the best pair is merged until none is left. Symbols outside the
vocabulary become bytes. No piece goes on past a space mark or holds a line break, so a
text falls into segments that are encoded once each and remembered. The agendas of many
short segments are worked off together, as rows of a numpy table; a long segment has a
heap of its own. Every new segment of a batch is checked against the sentencepiece
library.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stepscope.llm.common import map_texts, table

SPACE = "▁"
CACHE = 600_000  # segments a worker remembers, about 400 bytes each
SHORT = 48  # characters of a segment that goes through the table
CELLS = 1 << 18  # of the table
NEVER = np.iinfo(np.int32).max  # rank of a pair that makes no piece


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary of a merge-type model, and its encoder."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        self.byte = {}
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i, name in enumerate(names):
            if sp.is_byte(i):
                self.byte[int(name[3:5], 16)] = i
            elif sp.is_unused(i):
                raise ValueError("unused pieces are not supported")
            elif not sp.is_control(i) and not sp.is_unknown(i):
                self.ids[name] = i
                self.score[name] = -sp.get_score(i)
        self.unknown = sp.unk_id()
        self.parted = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids)
        self.number = list(range(size))
        self.known: dict[str, tuple[str, tuple[int, ...]]] = {}
        self._pairs(size)

    def _pairs(self, size: int) -> None:
        """The pairs of symbols that make a piece: sorted keys, the pieces and their ranks.

        Symbols are numbered like pieces, characters outside the vocabulary after these.
        """
        self.letter = np.arange(size, size + 0x110000, dtype=np.int64)
        for name, i in self.ids.items():
            if len(name) == 1:
                self.letter[ord(name)] = i

        def number(part: str) -> int | None:
            return int(self.letter[ord(part)]) if len(part) == 1 else self.ids.get(part)

        levels = {s: r for r, s in enumerate(sorted(set(self.score.values())))}
        rows = []
        for name, i in self.ids.items():
            for k in range(1, len(name)):
                a, b = number(name[:k]), number(name[k:])
                if a is not None and b is not None:
                    rows.append(((a + 1) << 32 | (b + 1), i, levels[self.score[name]]))
        rows.append((np.iinfo(np.int64).max, 0, NEVER))
        rows.sort()
        self.key, self.makes, self.rank = (np.array(c, np.int64) for c in zip(*rows))
        self.size = size

    def _looked_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (a + 1) << 32 | (b + 1)
        at = np.searchsorted(self.key, key)
        return self.makes[at], np.where(self.key[at] == key, self.rank[at], NEVER)

    def _table(self, segments: list[str]) -> list[list[int]]:
        """Ids of short segments: a row each, the best pair of every row merged per round."""
        length = np.array([len(s) for s in segments])
        n, width = len(segments), int(length.max()) + 1
        symbol = np.full((n, width), -1, np.int64)
        codes = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        symbol[np.arange(width) < length[:, None]] = self.letter[codes]
        makes, rank = self._looked_up(symbol[:, :-1], symbol[:, 1:])
        rows, cols = np.arange(n), np.arange(width - 1)
        out = symbol.copy()
        while len(rows):
            best = rank.argmin(1)
            left = np.arange(len(rows))
            busy = rank[left, best] < NEVER
            if not busy.all():  # rows whose agenda is empty are done
                out[rows[~busy]] = symbol[~busy]
                rows, symbol, makes, rank, best = (x[busy] for x in (rows, symbol, makes, rank, best))
                left = np.arange(len(rows))
            if not len(rows):
                break
            merged = makes[left, best]
            behind = cols > best[:, None]
            symbol[:, :-1] = np.where(behind, symbol[:, 1:], symbol[:, :-1])
            symbol[:, -1] = -1
            symbol[left, best] = merged
            for x, last in ((makes, 0), (rank, NEVER)):
                x[:, :-1] = np.where(behind[:, :-1], x[:, 1:], x[:, :-1])
                x[:, -1] = last
            for at in (best, best - 1):
                inside = at >= 0
                r, c = left[inside], at[inside]
                makes[r, c], rank[r, c] = self._looked_up(symbol[r, c], symbol[r, c + 1])
        count = (out >= 0).sum(1)
        ids = [row[:k] for row, k in zip(out.tolist(), count.tolist())]
        for i in np.flatnonzero((out >= self.size).any(1)):
            ids[i] = list(chain.from_iterable(self._outside(s) if s >= self.size else [s] for s in ids[i]))
        return ids

    def _outside(self, symbol: int) -> list[int]:
        if not self.byte:
            return [self.unknown]
        return [self.byte[b] for b in chr(symbol - self.size).encode()]

    def merge_all(self, segments: list[str]) -> list[list[int]]:
        """Ids of many segments, short ones of like length together."""
        made: list = [None] * len(segments)
        order = sorted(range(len(segments)), key=lambda i: len(segments[i]))
        at = 0
        while at < len(order) and len(segments[order[at]]) <= SHORT:
            upto = at
            while upto < len(order) and len(segments[order[upto]]) <= SHORT and (
                (upto + 1 - at) * (len(segments[order[upto]]) + 1) <= CELLS
            ):
                upto += 1
            for i, ids in zip(order[at:upto], self._table([segments[i] for i in order[at:upto]])):
                made[i] = ids
            at = upto
        for i in order[at:]:
            made[i] = self.merge(segments[i])
        return made

    def split(self, text: str) -> list[str]:
        """Segments of the text behind its space mark; none for an empty text."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        return re.findall(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+", text) if self.parted else [text]

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment by an agenda in a heap."""
        symbol, score = list(segment), self.score
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            s = score.get(symbol[i] + symbol[i + 1])
            if s is not None:
                agenda.append((s, i, i + 1, 2))
        heapify(agenda)
        while agenda:
            _, left, right, size = heappop(agenda)
            a, b = symbol[left], symbol[right]
            if not a or not b or len(a) + len(b) != size or after[left] != right:
                continue  # one of the two has been merged since
            symbol[left] = both = a + b
            symbol[right] = ""
            follow = after[left] = after[right]
            if follow < n:
                before[follow] = left
                longer = both + symbol[follow]
                s = score.get(longer)
                if s is not None:
                    heappush(agenda, (s, left, follow, len(longer)))
            lead = before[left]
            if lead >= 0:
                longer = symbol[lead] + both
                s = score.get(longer)
                if s is not None:
                    heappush(agenda, (s, lead, left, len(longer)))
        ids, get = [], self.ids.get
        for s in symbol:
            if s:
                i = get(s)
                if i is not None:
                    ids.append(i)
                elif self.byte:
                    ids += [self.byte[b] for b in s.encode()]
                else:
                    ids.append(self.unknown)
        return ids

    def check(self, segments: list[str], made: list[list[int]]) -> None:
        """Compare with the library; a line break stands beside each segment to close it off."""
        if not self.parted:
            asked = [s[1:] for s in segments]
            cut = [(0, None)] * len(asked)
        else:
            asked = [s[1:] + "\n" if s[0] == SPACE else "\n" + s for s in segments]
            cut = [(0, -1) if s[0] == SPACE else (2, None) for s in segments]
        for s, ids, (a, z), mine in zip(segments, self.library.encode(asked, num_threads=1), cut, made):
            if ids[a:z] != mine:
                raise ValueError(f"the library encodes {s!r} as {ids[a:z]}, not {mine}")

    def encode(self, texts: list[str]) -> list[tuple[str, list[int]]]:
        """Ids of each text, as text joined by commas and as a list."""
        split = [self.split(t) for t in texts]
        known = self.known
        found = [list(map(known.get, s)) for s in split]
        missing = list({c for s, f in zip(split, found) if None in f for c, v in zip(s, f) if v is None})
        made = self.merge_all(missing)
        self.check(missing, made)
        same = self.number.__getitem__  # one object per id, however often it is remembered
        fresh = {s: (",".join(map(str, ids)), tuple(map(same, ids))) for s, ids in zip(missing, made)}
        room = CACHE - len(known)
        if len(fresh) <= room:
            known |= fresh
        elif room > 0:
            known |= dict(zip(missing[:room], map(fresh.__getitem__, missing[:room])))
        out = []
        for segments, got in zip(split, found):
            if None in got:
                got = [fresh[s] if v is None else v for s, v in zip(segments, got)]
            out.append((",".join([g[0] for g in got]), list(chain.from_iterable([g[1] for g in got]))))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids)


@lru_cache(1)
def pieces_of(path: str) -> Pieces:
    """One vocabulary with its memory for all tasks of a worker."""
    return Pieces(path)


FIELDS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
]


def round_trip(docs: DataFrame, keep: list[str], path: Callable[[], str] = model_path, text: str = "text") -> DataFrame:
    """Encode and decode each text: count and digests beside the kept columns.

    A null text counts as empty: no ids, the digests of the empty text.
    """

    def work():
        pieces = pieces_of(path())
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()

        def of(texts):
            n, ids_digest, decoded_digest = [], [], []
            for at in range(0, len(texts), 512):  # id lists are large
                made = pieces.encode([t or "" for t in texts[at : at + 512]])
                n += [len(ids) for _, ids in made]
                ids_digest += [digest(joined) for joined, _ in made]
                decoded_digest += [digest(s) for s in pieces.decode([ids for _, ids in made])]
            return {"n_tokens": n, "ids_sha256": ids_digest, "decoded_sha256": decoded_digest}

        return of

    return map_texts(docs, work, FIELDS, keep, text)


def encoded(docs: DataFrame, keep: list[str], path: Callable[[], str] = model_path, text: str = "text") -> DataFrame:
    """Add ids, an array of each text's ids, to the kept columns."""

    def work():
        pieces = pieces_of(path())
        return lambda texts: {"ids": [ids for _, ids in pieces.encode([t or "" for t in texts])]}

    return map_texts(docs, work, [T.StructField("ids", T.ArrayType(T.IntegerType()))], keep, text)


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), ["doc_id"])
