"""Secrets in texts, confirmed by their structure (operator 10).

Base patterns find assignments, access keys and long hex runs. The method decodes base64
and hex candidates and parses what they claim to be: private keys in DER, whose nested
lengths must fit to the byte, OpenSSH keys, whose length-prefixed fields must, and signed
tokens, whose header must be a JSON object that names an algorithm.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepscope.llm.common import aside, map_texts, table

KINDS = ("assign", "access", "hex", "key", "jwt")
BASE = 3  # so many kinds are base kinds
REDACTED = "[REDACTED]"

ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
# Marks every byte that is a hex digit, so that long runs are found by a plain search.
HEX_MAP = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
HEX_RUN = b"h" * 24

# A DER sequence in base64 begins with M, an OpenSSH key with its magic word. White space
# or breaks, real or written out as in JSON, may part the lines of a key and stand before it.
FIRST = re.compile(r"(?:(?<![A-Za-z0-9+/])|(?<=\\[rnt]))(?:M[A-P]|b3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/]{30,}")
LINE = re.compile(r"[A-Za-z0-9+/]+")
BREAK = re.compile(r"(?:[ \t\r\n]|\\+[rnt])+")
PADDING = re.compile(r"={0,2}")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{46,}(?![0-9A-Fa-f])")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])ey[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
MAGIC = b"openssh-key-v1\0"
MOST_FIELDS = 64  # in one level of a key; known formats have fewer than twelve


Read = Callable[[int, int], bytes]  # bytes of a candidate from one place to another


def fields(read: Read, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tags, begins and ends of the DER values that fill a stretch to the last byte, else None."""
    found = []
    while at < end:
        head = read(at, min(at + 6, end))
        if len(head) < 2 or len(found) == MOST_FIELDS:
            return None
        tag, size, at = head[0], head[1], at + 2
        if size > 127:
            more = size - 128
            if not 1 <= more <= 4 or len(head) < 2 + more:
                return None
            size, at = int.from_bytes(head[2 : 2 + more]), at + more
        if at + size > end:
            return None
        found.append((tag, at, at + size))
        at += size
    return found


def private_key(read: Read, size: int) -> bool:
    """Whether the bytes are one private key: PKCS#1, PKCS#8, SEC1 or DSA in DER, or OpenSSH.

    Reads tags and sizes only, never the whole.
    """
    if read(0, min(size, len(MAGIC))) == MAGIC:
        return openssh_size(read, size) == size
    top = fields(read, 0, size)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = fields(read, *top[0][1:])
    if not inner or len(inner) < 2 or inner[0][0] != 2 or read(inner[0][1], min(inner[0][1] + 2, inner[0][2])) not in (b"\0", b"\1"):
        return False
    tags = [t for t, _, _ in inner]
    if tags[1] == 0x30 and len(tags) > 2 and tags[2] == 4:  # PKCS#8: algorithm, then the key
        algorithm = fields(read, *inner[1][1:])
        return bool(algorithm) and algorithm[0][0] == 6
    if tags[1] == 4:  # SEC1
        return inner[1][2] - inner[1][1] >= 16
    return len(tags) >= 5 and all(t in (2, 0x30) for t in tags)  # RSA or DSA numbers


def openssh_size(read: Read, most: int) -> int | None:
    """Bytes of an OpenSSH key by the sizes of its fields, None if they do not fit into `most`.

    Behind the magic word: three texts, a count, so many public keys, the private part.
    """
    at, keys = len(MAGIC), 1
    place = 0
    while place <= 4 + keys:
        if at + 4 > most:
            return None
        size, at = int.from_bytes(read(at, at + 4)), at + 4
        if place == 3:
            keys = size
            if not 1 <= keys <= MOST_FIELDS:
                return None
        else:
            at += size
        place += 1
    return at if at <= most else None


class Lines:
    """Base64 lines that follow each other in a text, with the count of characters before each.

    They are looked up, not joined: bytes are decoded from the few characters that hold them.
    """

    def __init__(self, text: str, at: int):
        self.text = text
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.before = [0]
        line = LINE.match(text, at)
        while line:
            self.starts.append(line.start())
            self.ends.append(line.end())
            self.before.append(self.before[-1] + line.end() - line.start())
            gap = BREAK.match(text, line.end())
            line = LINE.match(text, gap.end()) if gap else None
        self.end = self.ends[-1]

    def reader(self, first: int) -> tuple[Read, int]:
        """Bytes from the line on, and how many there are."""
        zero = self.before[first]
        chars = self.before[-1] - zero

        def read(a: int, z: int) -> bytes:
            if a >= z:
                return b""
            begin, end = zero + a // 3 * 4, zero + -(-z * 8 // 6)
            at = bisect_right(self.before, begin) - 1
            parts = []
            while begin < end:
                stop = min(end, self.before[at + 1])
                shift = self.starts[at] - self.before[at]
                parts.append(self.text[begin + shift : stop + shift])
                begin, at = stop, at + 1
            chunk = "".join(parts)
            return base64.b64decode(chunk + "=" * (-len(chunk) % 4))[a % 3 : a % 3 + z - a]

        return read, chars * 6 // 8

    def key_end(self, first: int) -> int | None:
        """Where the private key ends that starts with this line, None if there is none.

        A key fills whole lines, and its own sizes say how many bytes it has, so its end
        has to be the end of a line.
        """
        read, most = self.reader(first)
        head = read(0, min(6, most))
        if len(head) < 6:
            return None
        if head[0] == 0x30:
            more = head[1] - 128
            if more < 0:
                size = 2 + head[1]
            elif 1 <= more <= 4:
                size = 2 + more + int.from_bytes(head[2 : 2 + more])
            else:
                return None
        else:
            size = openssh_size(read, most)
        if size is None or size > most:
            return None
        chars = -(-size * 8 // 6)
        last = bisect_left(self.before, self.before[first] + chars)
        if self.before[last] != self.before[first] + chars or not private_key(read, size):
            return None
        end = self.ends[last - 1]
        return end + min(len(PADDING.match(self.text, end)[0]), -chars % 4)


def json_part(chunk: str) -> object:
    try:
        return json.loads(base64.urlsafe_b64decode(chunk + "=" * (-len(chunk) % 4)))
    except (ValueError, RecursionError):
        return None


def keys_in(text: str) -> list[tuple[int, int]]:
    spans = []
    lines = None
    for m in FIRST.finditer(text):  # goes on at the next line, whatever this one was
        if not spans or m.start() >= spans[-1][1]:
            if lines is None or m.start() >= lines.end:
                lines = Lines(text, m.start())
            first = bisect_left(lines.starts, m.start())
            if lines.starts[first : first + 1] != [m.start()]:  # behind a written-out break
                lines = Lines(text, m.start())
                first = 0
            end = lines.key_end(first)
            if end is not None:
                spans.append((m.start(), end))
    for m in HEX_KEY.finditer(text):
        if len(m.group()) % 2 == 0:
            data = bytes.fromhex(m.group())
            if private_key(lambda a, z: data[a:z], len(data)):
                spans.append(m.span())
    return spans


def tokens_in(text: str) -> list[tuple[int, int]]:
    spans = []
    for m in TOKEN.finditer(text):
        head, body, _ = m.group().split(".")
        header = json_part(head)
        if isinstance(header, dict) and isinstance(header.get("alg"), str):
            if "enc" in header or isinstance(json_part(body), dict):
                spans.append(m.span())
    return spans


def find(raw: bytes | None) -> list[tuple[int, int, int]]:
    """Spans as (start, number of the kind, end) in code points, in that order."""
    if not raw:
        return []
    low = raw.lower()
    has = [
        any(w in low for w in WORDS), b"AKIA" in raw, HEX_RUN in raw.translate(HEX_MAP),
        b"M" in raw or b"b3Bl" in raw or b"30" in raw, b"ey" in raw,
    ]
    if not any(has):
        return []
    text, spans = raw.decode(), []
    if has[0]:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if has[1]:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if has[2]:
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if has[3]:
        spans += [(a, 3, z) for a, z in keys_in(text)]
    if has[4]:
        spans += [(a, 4, z) for a, z in tokens_in(text)]
    return sorted(spans)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def redact(raw: bytes | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with every stretch of overlapping spans replaced by one mark."""
    if raw is None:
        return None
    text, out, at, stop = raw.decode(), [], 0, -1
    for a, _, z in spans:
        if a >= stop:
            out += [text[max(at, stop, 0) : a], REDACTED]
        stop = max(stop, z)
    return "".join(out) + text[max(stop, 0) :]


FIELDS = [
    T.StructField("n_assign", T.LongType()),
    T.StructField("n_access", T.LongType()),
    T.StructField("n_hex", T.LongType()),
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
]


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Add counts of base kinds, their digest and all spans to the kept columns.

    Null and empty texts have no spans: counts 0, the digest of an empty text, spans "".
    """

    def work():
        def of(texts):
            found = [find(t) for t in texts]
            base = [[s for s in spans if s[1] < BASE] for spans in found]
            return {
                **{f"n_{KINDS[k]}": [sum(s[1] == k for s in b) for b in base] for k in range(BASE)},
                "base_sha256": [hashlib.sha256(listed(b).encode()).hexdigest() for b in base],
                "spans": [listed(spans) for spans in found],
            }

        return of

    return map_texts(docs, work, FIELDS, keep, text, raw=True)


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), ["doc_id"])


def redacted_documents(docs: DataFrame) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars, if there, follows where the text changed.

    Null and empty texts stay. Rows are independent: repeated rows change alike, long texts
    are read whole, an empty table gives an empty one.
    """

    def work():
        def of(texts):
            found = [find(t) for t in texts]
            return {"_clean": [redact(t, s) for t, s in zip(texts, found)], "_hit": [bool(s) for s in found]}

        return of

    new = [T.StructField("_clean", T.StringType()), T.StructField("_hit", T.BooleanType())]
    own, names = aside(docs)
    made = map_texts(own, work, new, [n for c, n in names.items() if c != "text"], names["text"], raw=True)
    changed = {"text": F.col("_clean")}
    if "n_chars" in names:
        count = F.char_length("_clean").cast("long")
        changed["n_chars"] = F.when(F.col("_hit"), count).otherwise(F.col(names["n_chars"]))
    return made.select(*[changed.get(c, F.col(n)).alias(c) for c, n in names.items()])
