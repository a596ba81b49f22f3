"""Operators 11 to 13 against brute force, and on nulls, empties, ties, repeats, empty tables and extra columns."""

import hashlib
import heapq
import itertools
import random
import uuid
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chartwright.llm import conversations, negatives, queries, warc

DATA = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, text string, digest string"
TURNS = "conv_id long, turn long, role string, text string, copies string, gaps long"


# 11


def plain_negatives(rows):
    """Every result row, by scores of all pairs."""
    usable = []
    for i, v, label in rows:
        if v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        usable.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, tuple(int(np.floor(256 * float(x))) for x in v)))
    out, order = [], lambda r: (-r[1], r[0] is None, r[0] or 0)
    for a, mine, v in sorted(set(r for r in usable if r[0] is not None and r[0] % 50 == 0)):
        scored = [(i, sum(x * y for x, y in zip(v, w)), label) for i, label, w in usable if len(w) == len(v)]
        for p, score, _ in sorted((r for r in scored if r[2] == mine and r[0] != a), key=order)[:5]:
            fits = [r for r in scored if r[2] != mine and 50 * score <= 100 * r[1] <= 95 * score]
            out += [(a, p, k + 1, r[0], score, r[1]) for k, r in enumerate(sorted(fits, key=order)[:3])]
    return sorted(out, key=str)


def mined(df, **more):
    found = negatives.hard_negatives(df, **more)
    return sorted(map(tuple, found.drop("blocks_read", "blocks_skipped").collect()), key=str)


def test_negatives_of_the_given_vectors(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    want = plain_negatives([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])
    assert mined(df) == want and len(want) > 50
    assert sorted(map(tuple, queries.op11_hard_negatives(spark, DATA).collect()), key=str) == want


def test_blocks_are_skipped_and_nothing_is_lost(spark, monkeypatch):
    """Clustered vectors in small blocks: zone maps rule out most blocks, results stay those of all pairs."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 6))
    rows = [(i, [float(x) for x in centres[i % 12] * 3 + rng.standard_normal(6) * 0.2], int(i % 12 % 4)) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    real = negatives.candidate_files
    monkeypatch.setattr(negatives, "candidate_files", lambda *a: real(*a, block_rows=16))
    found = negatives.hard_negatives(df).cache()
    assert sorted(map(tuple, found.drop("blocks_read", "blocks_skipped").collect()), key=str) == plain_negatives(rows)
    read = found.groupBy("anchor_id").agg(F.first("blocks_read").alias("r"), F.first("blocks_skipped").alias("s")).agg(F.sum("r"), F.sum("s")).first()
    assert read[1] > read[0]


def test_negatives_of_odd_rows(spark):
    rng = np.random.default_rng(9)
    near = lambda: [float(x) for x in np.ones(4) + 0.3 * rng.standard_normal(4)]
    rows = [(i, near(), int(i % 3)) for i in range(0, 220)]
    rows += [(50, near(), 1), (None, near(), 0), (None, near(), 1), (300, None, 1), (350, [1.0, float("nan"), 0.0, 0.0], 1), (400, near(), None), (450, [], 1), (451, [], 2), (452, [], 1)]
    rows += [(500, [1.0, 1.0], 0), (501, [1.0, 1.0], 0), (503, [0.9, 0.9], 1), (550, [0.0] * 4, 2), (600, [None, 1.0, 0.0, 0.0], 1)]
    rows += [(700 + i, [1.0, 1.0, 1.0, 1.0], 5) for i in range(60)] + [(800, [1.0, 1.0, 1.0, 1.0], 5)] * 40 + [(901 + i, [0.8, 0.8, 0.8, 0.8], 6) for i in range(9)] + [(903, [0.8, 0.8, 0.8, 0.8], 6)] * 9
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, label int, dim string, key int")
    assert mined(df) == plain_negatives(rows)
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id % 50 <> 0")) == []
    huge = spark.createDataFrame([(0, [1e300], 1), (1, [2.0], 1), (2, [1.0], 1), (3, [1.5], 2)], "vec_id long, embedding array<double>, label int")
    assert mined(huge) == []  # the anchor's scores leave 64 bits
    large = [(50, [3e5, 1.0], 1), (1, [3e5, 7.0], 1), (2, [2.5e5, 9.0], 2), (3, [2.4e5, 1.0], 2)]
    assert mined(spark.createDataFrame(large, "vec_id long, embedding array<double>, label int")) == plain_negatives(large) != []


def test_hilbert_neighbours_touch():
    for d, bits in ((2, 3), (3, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        walk = cells[np.array(sorted(range(len(cells)), key=lambda i: negatives.hilbert_keys(cells, bits)[i]))]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(0, 10**6))
def test_bounds_hold(d, seed):
    rng = np.random.default_rng(seed)
    a, rows = rng.integers(-300, 300, (4, d)), rng.integers(-300, 300, (9, d))
    low, high = negatives.bounds(np.maximum(a, 0).astype(float), np.maximum(-a, 0).astype(float), rows.min(0)[None].astype(float), rows.max(0)[None].astype(float))
    scores = negatives.inner(a, rows, 1e6, 1e6)
    assert (scores == a @ rows.T).all() and (scores >= low).all() and (scores <= high).all()


# 12


def least_edits(codes):
    """(cost, audit) by a search over all edits in order of cost, then letters."""
    queue, seen = [(0, "", 0, 0)], set()
    while queue:
        cost, letters, i, q = heapq.heappop(queue)
        if i == len(codes) and q in (conversations.START, conversations.ASSISTANT):
            return cost, letters
        if (i, q) in seen:
            continue
        seen.add((i, q))
        initial, fault = divmod(codes[i], 4) if i < len(codes) else (None, None)
        after = {0: 2, 1: 2, 2: 3, 3: 2}[q]
        heapq.heappush(queue, (cost + 5, letters + "I", i, after))
        if initial is None:
            continue
        heapq.heappush(queue, (cost + 2, letters + "D", i + 1, q))
        if fault >= 2:
            continue
        cut = 5 * (fault == 1)
        heapq.heappush(queue, (cost + 1 + cut, letters + "R", i + 1, after))
        kept = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}.get((q, initial))
        if kept is not None:
            heapq.heappush(queue, (cost + cut, letters + "K", i + 1, kept))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 15), max_size=21))
def test_auction_finds_the_least_of_the_cheapest(codes):
    assert conversations.Solver().edits(bytes(codes)) == least_edits(codes)


def test_auction_of_long_conversations_is_linear():
    rng = random.Random(3)
    codes = bytes(rng.choice([4, 8, 4, 8, 5, 9, 6, 11, 0, 12]) for _ in range(60_000))
    cost, audit = conversations.Solver().edits(codes)
    assert cost > 0 and len(audit) - audit.count("I") == len(codes)


def plain_repair(rows):
    """Results by conversation, all rows in memory."""
    space, initials = " \t\n\x0b\x0c\r", {("s", "u"), ("u", "a"), ("a", "u")}
    seen = lambda t: t.strip(space)
    by_conv = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = by_conv.setdefault(conv, [])
        if kind == 0:
            continue
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        said = hashlib.sha1("\x00".join(["" if conv is None else f"={conv}", str(len(role)), role, text]).encode()).digest()
        own += [(turn is not None, turn or 0, role, said, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in by_conv.items():
        own.sort()
        faults, heard = [], set()
        for _, _, role, _, text in own:
            faults.append(2 if not seen(text) else 3 if (role, text) in heard else 1 if seen(text)[-1] not in ".!?" else 0)
            heard.add((role, text))
        firsts = ["sua".find(r[2][:1]) if r[2] else 3 for r in own]
        codes = [4 * (3 if f < 0 else f) + fault for f, fault in zip(firsts, faults)]
        cost, audit = least_edits(codes)
        made, q, i = [], 0, 0
        after = {0: 2, 1: 2, 2: 3, 3: 2}
        for letter in audit:
            if letter == "I":
                q = after[q]
                made.append(("user:" if q == 2 else "assistant:"))
                continue
            if letter == "R":
                q = after[q]
                made.append(("user:" if q == 2 else "assistant:") + own[i][4])
            elif letter == "K":
                q = 1 + "sua".index(own[i][2][0])
                made.append(own[i][2] + ":" + own[i][4])
            i += 1
        turns = [r[1] for r in own if r[0]]
        illegal = sum((a[2][:1], b[2][:1]) not in initials for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults.count(2), faults.count(3), faults.count(1), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def repaired(df):
    rows = [tuple(r) for r in conversations.repair(conversations.damaged(df)).collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r[1:] for r in rows}


def test_repair_of_the_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = plain_repair([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert repaired(df) == want
    assert all(any(letter in r[6] for r in want.values()) for letter in "DKR")


def test_repair_of_odd_rows(spark, monkeypatch):
    rng = random.Random(1)
    roles, texts = ["user", "assistant", "system", None, "", "tool", "User"], ["Hello.", "Hi there", "", None, " \t ", "a. ", "ok!\n", "é?", "x" * 3000 + "."]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(40)]), rng.choice(roles), rng.choice(texts)) for _ in range(300)]
    rows += [(None, 5, "user", "Same.")] * 200 + [(7, t, "user", "Again.") for t in range(200)] + [(8, None, "user", "No turn."), (8, None, "assistant", "None.")]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in range(20, 60) for t in range(4)] + [(9, 0, "user", "Words. " * 100_000), (9, 1, "assistant", "Fine.")]
    gone = [(c, t) for c in range(100, 200) for t in (0,) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    rows += [(c, t, "user", "Dropped.") for c, t in gone]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)
    want = plain_repair(rows)
    assert gone and want[gone[0][0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert repaired(df) == want
    assert repaired(df.limit(0)) == {}


# 13


def archived(spark, df, **more):
    folder, manifest = warc.write_archive(df, **more)
    return folder, manifest, warc.read_archive(spark, manifest)


def plain_archive(rows):
    first = {}
    for page_id, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100:
            first[body] = min(first.get(body, (True, 0)), (page_id is None, page_id or 0))
    out, taken = [], set()
    for page_id, _, html in rows:
        body = (html or "").encode()
        leads = len(body) < 100 or ((page_id is None, page_id or 0) == first[body] and body not in taken)
        if len(body) >= 100 and leads:
            taken.add(body)
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "response" if leads else "revisit", None if leads or first[body][0] else first[body][1]))
    return sorted(out, key=str)


def digest(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_archive_of_the_given_pages(spark):
    df = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in df.collect()]
    rows += [(i + 1000, u, h) for i, u, h in rows[:20]] + [(-5, u, h) for _, u, h in rows[:1]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, manifest, back = archived(spark, df, file_bytes=20_000)
    assert digest(back) == plain_archive(rows)
    files = manifest.orderBy("file").collect()
    assert len(files) > 2 and sum(r["n_records"] for r in files) == len(rows)
    ids = [r["record_id"] for r in back.select("record_id").collect()]
    assert len(set(ids)) == len(ids)
    # the same table dealt otherwise gives the same files
    _, again, _ = archived(spark, df.repartition(3, "html"), file_bytes=20_000)
    assert [(r["file"], r["sha256"]) for r in again.orderBy("file").collect()] == [(r["file"], r["sha256"]) for r in files]
    assert sorted(map(tuple, queries.op13_warc(spark, DATA).collect()), key=str) == plain_archive(rows[:50])


def test_archive_of_odd_rows(spark):
    long = "<p>" + "word " * 60
    rows = [(1, "http://a/", long), (None, None, long), (None, "http://b/\r\nX: y é", long), (2, None, None), (2, None, None), (3, "u", ""), (4, "u", "é" * 50), (5, "u", "é" * 50), (6, "u", "é" * 49), (7, "u", "é" * 49)]
    rows += [(None, None, long + "!")] * 30 + [(9, "v", long + "?")] * 30 + [(0, "w", long + "?")] * 3 + [(11, "z", "\r\n\r\n" + "x" * 200_000), (12, "z", "x" * 40)] + [(13, "t", "tiny")] * 25
    df = spark.createDataFrame([(*r, "t", "d") for r in rows], PAGES).repartition(5)
    _, manifest, back = archived(spark, df, file_bytes=2_000)
    assert digest(back) == plain_archive(rows) and manifest.count() > 3
    _, manifest, back = archived(spark, df.limit(0))
    assert (manifest.count(), back.count()) == (0, 0)


def test_archive_damage_is_found(spark):
    df = spark.createDataFrame([(i, "u", f"{i} " * 100) for i in range(20)], "page_id long, url string, html string")
    _, manifest, _ = archived(spark, df)
    path, sha256 = manifest.select("path", "sha256").first()
    local = path.removeprefix("file:").replace("///", "/")
    data = open(local, "rb").read()
    records = [(f, b) for f, b in warc.file_records(path, sha256)]
    assert len(records) == 21 and records[0][0]["WARC-Type"] == "warcinfo" and all(uuid.UUID(f["WARC-Record-ID"][10:-1]) for f, _ in records)
    for broken in (data[:-3], data[: len(data) // 2] + bytes([data[len(data) // 2] ^ 1]) + data[len(data) // 2 + 1 :]):
        with open(local, "wb") as f:
            f.write(broken)
        with pytest.raises((ValueError, zlib.error)):
            list(warc.file_records(path, sha256))
