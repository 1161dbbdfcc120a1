"""Archives, packing, encoding, fingerprints and secrets: round trips and brute force."""

import base64
import gzip
import hashlib
import io
import json
import math
import random
import re
import time
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stepscope.llm import catalog, fingerprints, packing, pieces, secrets, tiles, warc
from stepscope.operators.components import components

PARTS = st.sampled_from(
    [" ", "  ", "the", "a", "é", "x", "'s", "ing", "\n", "日", "🎉", "tion", "0", "123", ",", "\t", "\r\n", "　", "\xa0", "▁", "<s>", "<|endoftext|>", "\x00", "A"]
)
TEXTS = st.lists(PARTS, max_size=30).map("".join)


# Archives


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")


def test_archives_hold_every_page(spark, folder, none):
    rows = [
        (1, "http://a/ b\n", "same", "mine"), (5, None, "same", "mine"), (3, "http://c", "same", "mine"),
        (7, "http://d", None, "mine"), (2, "http://e", "", "mine"), (None, "http://f", "öther\r\n\r\nWARC/1.1", "mine"),
        (9, "http://g", "x" * 3_000_000, "mine"), (None, None, "alone", "mine"), (None, None, "alone", "mine"),
        (4, "http://h", "twice", "mine"), (4, "http://h", "twice", "mine"),
    ]
    got = catalog.QUERIES["op5_warc_normalise"](spark, folder(none, pages=pages_of(spark, rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        owner = [x for x in rows if base64.b32encode(hashlib.sha1((x[2] or "").encode()).digest()).decode() == r["payload_digest"]]
        assert r["payload_bytes"] == len((owner[0][2] or "").encode())
        top = max((x[0] for x in owner if x[0] is not None), default=None)
        assert r["record_type"] == ("response" if r["page_id"] == top else "revisit")
        assert r["refers_to"] == (None if r["page_id"] == top else top)
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(x[0]) for x in rows)
    empty = pages_of(spark, rows).limit(0)
    assert catalog.QUERIES["op5_warc_normalise"](spark, folder(none, pages=empty)).count() == 0


def test_small_payloads_are_never_revisits(spark):
    rows = warc.decided(pages_of(spark, [(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abc", ""), (4, "u", "abc", "")]), 3)
    assert {r["page_id"] for r in rows.collect() if r["revisit"]} == {3}


def test_normaliser_writes_members_and_offsets():
    records = [warc.record(i, f"http://x/{i}", bytes([65 + i]) * (i * 50_000), None, False) for i in range(5)]
    for whole in (gzip.compress(b"".join(records)), b"".join(gzip.compress(r) for r in records)):
        out = io.BytesIO()
        index = warc.normalise_file(io.BytesIO(whole).read, out.write)
        data = out.getvalue()
        assert [zlib.decompress(data[x["offset"] : x["offset"] + x["length"]], 31) for x in index] == records
        assert index[0]["offset"] == 0 and sum(x["length"] for x in index) == len(data)
    with pytest.raises(EOFError):
        warc.normalise_file(io.BytesIO(gzip.compress(b"".join(records))[:-20]).read, out.write)
    with pytest.raises(EOFError):
        warc.normalise_file(io.BytesIO(gzip.compress(records[4][:-10])).read, out.write)


# Packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), max_size=40))
def test_plan_holds_every_piece(counts):
    bins = packing.plan(counts, capacity=64, groups=8)
    held = {}
    for b in bins:
        assert b.count > 0 and sum(length * k for length, k in b.items) + b.room == 64 and b.room >= 0
        for length, k in b.items:
            held[length] = held.get(length, 0) + k * b.count
    assert held == counts
    low = math.ceil(sum(k * n for k, n in counts.items()) / 64)
    assert sum(b.count for b in bins) <= 2 * low


def decreasing(counts, capacity):
    """Sequences that best-fit decreasing takes."""
    rooms, n = [], 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            at = bisect_left(rooms, length)
            n += at == len(rooms)
            insort(rooms, (rooms.pop(at) if at < len(rooms) else capacity) - length)
    return n


@pytest.mark.parametrize("kind", ["documents", "few", "spread", "halves", "thirds"])
def test_plan_is_no_worse_than_best_fit_decreasing(kind, documents):
    rng = random.Random(11)
    if kind == "documents":
        encoder = packing.encoder_of(packing.tokenizer_path())
        texts = [r["text"] or "" for r in documents.select("text").collect()]
        sizes = [len(ids) // 4 + 1 for ids in encoder.encode(texts)]
        sizes = [1024] * sum(n // 1024 for n in sizes) + [n % 1024 for n in sizes if n % 1024]
    else:
        low, high, n = {"few": (100, 1024, 300), "spread": (1, 1024, 3000), "halves": (450, 560, 2000), "thirds": (250, 520, 2000)}[kind]
        sizes = [rng.randint(low, high) for _ in range(n)]
    counts = dict(Counter(sizes))
    made = sum(b.count for b in packing.plan(counts))
    assert math.ceil(sum(sizes) / 1024) <= made <= decreasing(counts, 1024)


def test_plan_is_tight_on_a_large_corpus():
    rng = np.random.default_rng(1)
    lengths = np.minimum(1024, rng.lognormal(6, 1, 200_000).astype(int) + 1)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    n = sum(b.count for b in packing.plan(counts))
    assert n <= 1.01 * lengths.sum() / 1024 + 1


@settings(max_examples=40, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=5))
def test_ids_equal_the_library(texts):
    encoder = packing.encoder_of(packing.tokenizer_path())
    for text, ids in zip(texts, encoder.encode(texts)):
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want


def packed(spark, path, docs):
    rows = catalog.QUERIES["op6_best_fit_packing"](spark, path).toPandas()
    tokenizer = packing.encoder_of(packing.tokenizer_path()).tokenizer
    want = []
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        head = len(ids) % 1024 or 1024
        bounds = [0, *range(head, len(ids) + 1, 1024)]
        for k, (a, z) in enumerate(zip(bounds, bounds[1:])):
            want.append((r["doc_id"] if r["doc_id"] is not None else -1, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())))
    rows["doc_id"] = rows["doc_id"].fillna(-1).astype(int)
    got = rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)
    assert sorted(got) == sorted(want)
    ends = {}
    for r in rows.sort_values(["sequence_id", "offset"]).itertuples():
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values(), default=0) <= 1024
    return rows


def test_packing_of_documents(spark, folder, documents, odd, none, clashing):
    rows = packed(spark, folder(documents), documents)
    assert rows["sequence_id"].nunique() <= 1.1 * rows["length"].sum() / 1024 + 1
    for docs in (odd, clashing):
        packed(spark, folder(docs), docs)
    assert catalog.QUERIES["op6_best_fit_packing"](spark, folder(none)).count() == 0


def test_added_tokens_as_the_library_reads_them(spark, folder):
    fresh = Tokenizer.from_file(packing.tokenizer_path())
    end = "<|endoftext|>"
    texts = [f"one {end} two", end, f" {end}", f"{end} two three", f"a{end}b {end}{end}  c", f"one two\n{end} ", "one <|endoftext| > two", f"one {end[:-1]} two"]
    want = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [505, 220, 50256, 734]
    for found in (packing.Encoder(packing.tokenizer_path()).encode(texts), [i for t in texts for i in packing.Encoder(packing.tokenizer_path()).encode([t])]):
        assert [np.frombuffer(i, "<u4").tolist() for i in found] == want
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = catalog.QUERIES["op6_best_fit_packing"](spark, folder(docs)).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == [
        (i, 0, 0, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())) for i, ids in enumerate(want)
    ]


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=5))
def test_ids_equal_a_fresh_library(texts):
    fresh = Tokenizer.from_file(packing.tokenizer_path())
    for text, ids in zip(texts, packing.encoder_of(packing.tokenizer_path()).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids


# SentencePiece


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_agenda_equals_the_library(text):
    p = pieces.pieces_of(pieces.model_path())
    joined, ids = p.encode([text])[0]
    assert ids == p.library.encode(text)
    assert joined == ",".join(map(str, ids))
    for s in p.split(text):
        assert p.merge(s) == p.merge_all([s])[0]


def test_round_trip_of_odd_rows(spark, folder, odd, none, clashing):
    library = pieces.pieces_of(pieces.model_path()).library
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for docs in (odd, clashing):
        want = []
        for r in docs.collect():
            ids = library.encode(r["text"] or "")
            want.append((str(r["doc_id"]), len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
        got = catalog.QUERIES["op7_sentencepiece"](spark, folder(docs)).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert catalog.QUERIES["op7_sentencepiece"](spark, folder(none)).count() == 0


# SimHash in tiles


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", low) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=2):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def same_groups(spark, path, docs):
    rows = docs.collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    root = brute_components(fps)
    least = {}
    for r, c in zip(rows, root):
        ids = [x for x in (least.get(c), r["doc_id"]) if x is not None]
        least[c] = min(ids) if ids else None
    want = sorted((str(r["doc_id"]), f"{f:016x}", str(least[c])) for r, f, c in zip(rows, fps, root))
    got = catalog.QUERIES["op8_simhash_tiles"](spark, path).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    return len(set(root))


def test_near_duplicates_equal_brute_force(spark, folder, documents, odd, none, clashing):
    same_groups(spark, folder(documents), documents)
    for docs in (odd, clashing):
        groups = same_groups(spark, folder(docs), docs)
        kept = tiles.one_of_each(docs)
        assert kept.columns == docs.columns and kept.count() == groups
    assert catalog.QUERIES["op8_simhash_tiles"](spark, folder(none)).count() == 0
    assert tiles.one_of_each(none).count() == 0


def test_deduplication_shuffles_texts_once(spark):
    rows = [(i // 2, f"text number {i // 3} of a few words") for i in range(60)]
    docs = spark.createDataFrame([*rows, (None, "text number 1 of a few words")], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = tiles.one_of_each(docs)
        plan = spark._jvm.PythonSQLUtils.explainString(kept._jdf.queryExecution(), "formatted").split("\n\n")
        assert sorted(r["text"] for r in kept.collect()) == sorted({t for _, t in rows})
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [n for n in plan if ") Exchange" in n.lstrip().split("\n")[0] and ("_in1#" in n or "first" in n)]
    assert len(dealt) == 1, dealt


@pytest.mark.parametrize("tile", [3, 16, 32_768])
def test_links_hold_all_components(spark, tile):
    rng = random.Random(tile)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(200):  # chains of near fingerprints, across tiles
        fps.append(fps[rng.randrange(len(fps))] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = sorted(set(fps) | {0, 1, 3, 2**64 - 1})
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    found = components(tiles.links(spark.createDataFrame(signed, "fp long"), tile=tile)).collect()
    label = {r["node"]: r["component"] for r in found}
    got = [label.get(s[0], s[0]) for s in signed]
    want = brute_components(fps)
    assert len(set(zip(got, want))) == len(set(want)) == len(set(got))


# Fingerprints


def test_edited_texts_and_neighbours(spark, folder, documents, odd, none, clashing):
    for docs in (documents, odd, clashing):
        rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
        got = catalog.QUERIES["op9_fingerprints"](spark, folder(docs)).collect()
        want = []
        for i, (doc, text) in enumerate(rows):
            after, n = rows[(i + 1) % len(rows)][1], len(text)
            edited = text[: n - n // 4] + after[: n // 4]
            want.append((str(doc), n, hashlib.sha256(edited.encode()).hexdigest()))
        assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
        by_text = {}
        for r in got:
            by_text.setdefault(r["edited_sha256"], set()).add(r["edited_fingerprint"])
        assert all(len(v) == 1 for v in by_text.values())
    assert catalog.QUERIES["op9_fingerprints"](spark, folder(none)).count() == 0


@pytest.mark.parametrize("hot", [77, None])
def test_an_id_of_a_third_of_all_rows_is_spread(spark, hot):
    rng = random.Random(5)
    rows = [(i, f"text {i} {rng.random()}") for i in range(20_000)]
    rows += [(hot, f"hot {rng.randrange(9000)}") for _ in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = fingerprints.in_order(docs).collect()
    sizes = Counter(r["bucket"] for r in made)
    assert len(made) == 30_000 and max(sizes.values()) < 1500
    of_hot = [r for r in made if r["text"].startswith("hot")]
    assert len({r["bucket"] for r in of_hot}) >= 60
    # One round through all rows: each row's next text is the text of the row behind it.
    made.sort(key=lambda r: (r["bucket"], r["place"]))
    assert all(a["next"] == b["text"] for a, b in zip(made, [*made[1:], made[0]]))
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in made]
    assert ids == sorted(ids)


def test_votes_equal_brute_force(spark):
    from pyspark.sql import functions as F

    texts = ["", " one ", "a b a b a", "The cat, the longer dog; the Cat", "x\ty\nz" * 40, "alpha beta"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    hashed = lambda rows, kind: {
        r[0]: r[1] for r in spark.createDataFrame(sorted(set(rows)), kind).select(F.struct("*") if "," in kind else "*", F.xxhash64("*")).collect()
    }
    split = [[w for w in re.split(r"[\x20\x09-\x0d]+", t) if w] for t in texts]
    word = hashed([(w,) for ws in split for w in ws], "w string")
    code = lambda w: word[w] & -2 | (len(w) >= 4)
    pairs = [{(code(a), code(b)) for a, b in zip(ws, ws[1:])} for ws in split]
    of_pair = {tuple(k): v for k, v in hashed([p for ps in pairs for p in ps], "a long, b long").items()}
    terms = [{of_pair[p] & -2 | (p[0] & p[1] & 1) for p in ps} or {code(w) for w in ws} for ps, ws in zip(pairs, split)]
    bits = {tuple(k): v % 2**64 for k, v in hashed([(t, s) for ts in terms for t in ts for s in (0, 1)], "t long, s int").items()}
    for r in fingerprints.simhash(rows, ["k"], "text").collect():
        weight = {t: 1 + (t & 1) for t in terms[r["k"]]}
        for s, name in ((0, "high"), (1, "low")):
            want = sum(1 << b for b in range(64) if 2 * sum(w for t, w in weight.items() if bits[t, s] >> b & 1) > sum(weight.values()))
            assert r[name] % 2**64 == want


def test_block_tables_find_all(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(128) for _ in range(40)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(1, 5))) for p in prints * 3]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    rows = [(signed(p >> 64), signed(p & (2**64 - 1))) for p in prints]
    frame = spark.createDataFrame(rows + rows[:5], "high long, low long")
    found = fingerprints.find_near(frame, frame).collect()
    got = sorted((r[0] % 2**64 << 64 | r[1] % 2**64, r[2] % 2**64 << 64 | r[3] % 2**64) for r in found)
    want = sorted((a, b) for a in set(prints) for b in set(prints) if (a ^ b).bit_count() <= 3)
    assert got == want


# Secrets


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2)
    return bytes([tag]) + size + body


def number(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1))


RSA = der(0x30, number(0), *[number(random.Random(i).getrandbits(512)) for i in range(8)])
PKCS8 = der(0x30, number(0), der(0x30, der(6, b"\x2a\x86\x48"), der(5)), der(4, RSA))
FIELD = lambda b: len(b).to_bytes(4) + b
SSH = b"openssh-key-v1\0" + FIELD(b"none") + FIELD(b"none") + FIELD(b"") + (1).to_bytes(4) + FIELD(b"p" * 51) + FIELD(b"q" * 90)
JWT = ".".join(
    base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256"}', b'{"sub":"me"}', b"signature")
)


def kinds(text):
    return [secrets.KINDS[k] for _, k, _ in secrets.find(text.encode())]


def test_structures_are_confirmed():
    for key in (RSA, PKCS8, SSH):
        b64 = base64.b64encode(key).decode()
        assert kinds(f"see {b64} there") == ["key"]
        lines = "\n".join(b64[i : i + 64] for i in range(0, len(b64), 64))
        text = f"-----BEGIN KEY-----\n{lines}\n-----END KEY-----\nand more words"
        ((a, _, z),) = secrets.find(text.encode())
        assert text[a:z] == lines
        assert kinds(f"x {base64.b64encode(key[:-1]).decode()} y") == []
    assert kinds(RSA.hex()) == ["hex", "key"] and kinds(RSA.hex().upper()) == ["key"]
    assert kinds(RSA.hex()[:-2]) == ["hex"]
    assert kinds(f"Bearer {JWT}") == ["jwt"]
    assert kinds("eyJub3QiOiJvbmUifQ.eyJhIjoxfQ.c2ln") == []  # no algorithm
    assert kinds("M" + "A" * 80) == []


def wrapped(key, gap="\n", width=64):
    b64 = base64.b64encode(key).decode().rstrip("=")
    return gap.join(b64[i : i + width] for i in range(0, len(b64), width))


@pytest.mark.parametrize("key", [RSA, PKCS8, SSH])
@pytest.mark.parametrize("gap", ["\n", "\r\n", "\\n", "\\r\\n", "\\\\n", "\n    ", "\r\n\t", "  \n", " ", "\\n  "])
def test_keys_in_lines_parted_in_any_way(key, gap):
    body = wrapped(key, gap)
    for text in (f"-----BEGIN KEY-----{gap}{body}{gap}-----END KEY-----{gap}more", f"{gap}{body}{gap}and words behind"):
        ((a, k, z),) = secrets.find(text.encode())
        assert secrets.KINDS[k] == "key" and text[a:z] == body
    account = json.dumps({"type": "service_account", "private_key": f"-----BEGIN PRIVATE KEY-----\n{wrapped(key)}\n-----END PRIVATE KEY-----\n"})
    for text in (account, json.dumps(account)):
        assert kinds(text) == ["key"]


def test_keys_behind_keys_and_other_lines():
    other = base64.b64encode(der(0x30, der(0x30, b"\1" * 150), der(3, b"\2" * 40))).decode().rstrip("=")  # no key, yet DER
    keys = [base64.b64encode(k).decode().rstrip("=") for k in (RSA, PKCS8, SSH)]
    for gap in ("\n", "\\n", "\n  "):
        for before in ([], [other], ["MAAA" + "A" * 60], ["M" + "B" * 63, other]):
            text = gap.join([*before, *keys, other, keys[0]])
            spans = secrets.find(text.encode())
            assert [text[a:z] for a, _, z in spans] == [*keys, keys[0]]
            assert secrets.redact(text.encode(), spans).count(secrets.REDACTED) == 4
    padded = base64.b64encode(RSA + b"").decode()
    assert kinds(f"{padded}\n{padded}\n{other}") == ["key", "key"]
    assert kinds(f"{keys[0]}A\n{keys[1][:-4]}\nwords") == []  # no key fits to the byte


def test_long_runs_of_base64_are_read_once():
    rng = random.Random(3)
    lines = [base64.b64encode(b"0" + rng.randbytes(47)).decode() for _ in range(20_000)]
    assert kinds("\n".join([*lines, wrapped(RSA)])) == ["key"]


@pytest.mark.parametrize(
    "head",
    [b"\x30\x83\x00\xc0\x00", b"\x30\x82\x90\x00", b"\x30\x82\x8f\xfc\x02\x01\x00\x02\x82\x8f\xf0", b"\x30\x82\x8f\xfc\x02\x01\x00" + b"\x05\0" * 20,
     b"openssh-key-v1\0" + b"\0\0\0\1a\0\0\0\1b\0\0\0\0\0\0\0\x3f"],
)
def test_lines_that_all_claim_long_keys_take_little_time(head):
    """A megabyte of lines whose sizes end at the ends of later lines."""
    rng = random.Random(4)
    lines = [base64.b64encode((head + rng.randbytes(48))[:48]).decode() for _ in range(16_000)]
    start = time.perf_counter()
    assert kinds("\n".join([*lines, wrapped(RSA)])) == ["key"]
    assert time.perf_counter() - start < 5


def test_redaction_without_a_count_of_characters(spark):
    frame = spark.createDataFrame([(1, "token=abcdefgh")], "doc_id long, text string")
    (row,) = secrets.redacted_documents(frame).collect()
    assert row.asDict() == {"doc_id": 1, "text": secrets.REDACTED}


def test_base_patterns():
    assert kinds("API_KEY = 'abcdef' token:short password=12345") == ["assign"]
    assert kinds("AKIA" + "Z" * 15 + " AKIA" + "Z" * 16) == ["access"]
    assert kinds("0" * 23 + " " + "f" * 24) == ["hex"]
    assert kinds("pa\u017fsword=abcdef \u212aey") == []  # not an ASCII letter
    text = "é token=aaaaaa " + "0" * 24
    assert secrets.listed(secrets.find(text.encode())) == "assign:2:14,hex:15:39"


def test_scan_and_redaction_of_odd_rows(spark, folder, odd, none, clashing):
    for docs in (odd, clashing):
        rows = catalog.QUERIES["op10_secret_scan"](spark, folder(docs)).collect()
        assert len(rows) == 12 and all(r["spans"] == "" for r in rows)
        assert {r["base_sha256"] for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert catalog.QUERIES["op10_secret_scan"](spark, folder(none)).count() == 0
    text = f"ü token={'0' * 24} then {JWT}"
    frame = spark.createDataFrame([(1, text, None, None, len(text)), (2, None, None, None, None), (3, "ok", None, None, 7)], odd.schema)
    got = {r["doc_id"]: r for r in secrets.redacted_documents(frame).collect()}
    assert got[1]["text"] == f"ü {secrets.REDACTED} then {secrets.REDACTED}" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] is None and got[2]["n_chars"] is None and got[3]["n_chars"] == 7
    assert json.dumps(kinds(got[1]["text"])) == "[]"
