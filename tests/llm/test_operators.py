"""Training-data operators against brute force on small tables, and on nulls, empties, ties, repeats and extra columns."""

import uuid
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chartwright.llm import bpe, decontaminate, graph, html, lm, packing, quality, queries, records, simhash, tokens, toxicity, vectors
from chartwright.llm.common import materialize

DATA = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "a  b\n\n c\t d  ", "  lead", "it's we'll\n", "x\x1cy", "a\xa0b \xa0c", "日本 語", "one", "a\nb c.\nD e", " ", "one", "end. " * 700]
DOCS = "doc_id long, text string, row_id long, fp long"


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i if i != 3 else None, t, 0, 0) for i, t in enumerate(TEXTS)], DOCS)


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab \n\t.,é\xa0'1|"), max_size=20)), max_size=5))
def test_encoder_is_the_tokenizer(texts):
    t = Tokenizer.from_file(VOCABULARY) if not hasattr(test_encoder_is_the_tokenizer, "t") else test_encoder_is_the_tokenizer.t
    test_encoder_is_the_tokenizer.t = t
    ids, bounds = bpe.Encoder.open(VOCABULARY).encode_batch(pa.array(texts, pa.string()), 0)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [t.encode(s or "", add_special_tokens=False).ids + [0] for s in texts]


def test_histogram_answers(spark, odd, whole):
    lengths = [len(whole(t)) + 1 for t in TEXTS]
    hist = materialize(tokens.length_histogram(tokens.encoded_lengths(odd, VOCABULARY)), "hist")
    for r in tokens.suffix_totals(hist).collect():
        n = r["length"]
        assert r["docs_from"] == sum(x >= n for x in lengths) and r["tokens_to"] == sum(x for x in lengths if x <= n)
        assert r["truncated_tokens"] == sum(min(x, n) for x in lengths) and r["truncated_docs"] == sum(x > n for x in lengths)
    for r in tokens.answer_limits(hist, [1, 5, 10**6]).collect():
        assert r["truncated_tokens"] == sum(min(x, r["context_limit"]) for x in lengths)
    assert tokens.suffix_totals(hist.limit(0)).count() == 0
    ordered = sorted(lengths)
    for r in tokens.quantile_lengths(tokens.suffix_totals(hist), [0.1, 0.5, 1.0, 1.5]).collect():
        assert r["share"] <= 1 and r["length"] == ordered[int(np.ceil(r["share"] * len(ordered))) - 1]


def test_added_tokens_are_cut_out(spark):
    t = Tokenizer.from_file(VOCABULARY)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "plain", "<|endoftext"]
    ids, bounds = bpe.Encoder.open(VOCABULARY).encode_batch(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [t.encode(s, add_special_tokens=False).ids for s in texts]


def test_empty_tables(spark):
    docs, labels, bench = documents(spark), spark.read.parquet(f"{DATA}/labels.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    none = docs.limit(0)
    assert decontaminate.contaminated_pairs(none, bench).count() == 0 == decontaminate.drop_contaminated(none, bench).count()
    assert toxicity.score_severity(none, toxicity.fit_toxicity(none, labels)).count() == 0
    assert queries.packed_digest(none).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(5, 60))
def test_fullest_multiset_is_the_best(counts, capacity):
    pick = packing.fullest_multiset(counts, capacity)
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= capacity}
    assert sum(k * v for k, v in pick.items()) == max(sums) and all(v <= counts[k] for k, v in pick.items())


@pytest.mark.parametrize("lengths", [[600] * 7, [1024, 2048, 1], [5], [], [300] * 10 + [124] * 3 + [1023, 1025, 0, None], [1] * 50])
def test_pieces_are_whole_and_gapless(spark, lengths):
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)], "row_id long, n_tokens long, start string")
    rows = packing.pack(df).collect()
    for i, n in enumerate(lengths):
        own = sorted((r["start"], r["length"]) for r in rows if r["row_id"] == i)
        assert sum(k for _, k in own) == (n or 0) and all(a + k == b for (a, k), (b, _) in zip(own, own[1:])) and (not own or own[0][0] == 0)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(parts, parts[1:]))
        full = sum(parts[-1])
        assert full <= 1024 and full & (full - 1) == 0


def test_packed_ids(spark, odd, whole):
    rows = queries.packed_digest(odd).collect()
    texts = {(i if i != 3 else None): t for i, t in enumerate(TEXTS)}
    for r in rows:
        ids = [*whole(texts[r["doc_id"]]), 0]
        cut = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(cut.tobytes()) and r["doc_tokens"] == len(ids)


def test_records_round_trip(spark, odd, whole):
    folder, manifest = records.write_records(odd, VOCABULARY, files=3)
    back = records.read_records(spark, manifest).collect()
    texts = sorted(((i if i != 3 else -1, t) for i, t in enumerate(TEXTS)), key=lambda x: x[0])
    at = 0
    for r, (i, t) in zip(sorted(back, key=lambda r: -1 if r["doc_id"] is None else r["doc_id"]), texts, strict=True):
        ids = [*whole(t), 0]
        assert (r["start"], np.frombuffer(r["ids"], "<u4").tolist()) == (at, ids) and (r["doc_id"] if r["doc_id"] is not None else -1) == i
        at += len(ids)
    _, none = records.write_records(odd.limit(0), VOCABULARY)
    assert records.read_records(spark, none).count() == 0


def test_damaged_record_is_found():
    data = bytearray(records.frame(records.pack_ids(7, np.array([1, 70000], "<u4"))))
    read = lambda at, n: bytes(data[at : at + n])
    assert records.unpack_ids(records.unframe(read, 0))[1].tolist() == [1, 70000]
    data[20] ^= 1
    with pytest.raises(ValueError):
        records.unframe(read, 0)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_of(ids, linked):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    return root


def test_simhash_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = [" ".join(rng.choice(list("abcdefgh"), 60)) for _ in range(30)]
    texts = base + [" ".join([*t.split()[:-1], "zz"]) for t in base] + base[:5] + ["", None, "one", "one two"]
    docs = spark.createDataFrame([(100 - i, t, 0, 0) for i, t in enumerate(texts)], DOCS)
    fps = {100 - i: plain_fingerprint(t) for i, t in enumerate(texts)}
    root = classes_of(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    got = simhash.simhash_classes(docs).collect()
    assert {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in got} == {i: (fps[i], root[i]) for i in fps}
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root.values()))
    assert simhash.simhash_classes(docs.limit(0)).count() == 0


def test_representatives_of_null_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    a, b, c, d, e, f = (" ".join(rng.choice(list("abcdefgh"), 60)) for _ in range(6))
    rows = [(None, a), (None, a), (None, b), (7, c), (None, c), (7, d), (5, e), (6, e), (6, f), (None, f), (3, None), (None, "")]
    docs = spark.createDataFrame([(i, t, n, 0) for n, (i, t) in enumerate(rows)], DOCS)
    docs = docs.withColumns({x: F.lit(0) for x in ("k", "f", "n", "own_key", "Kept_FP", "component")})
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(None, a), (None, b), (7, c), (7, d), (5, e), (6, f), (3, None)], key=str)


def test_rows_without_ids_link(spark):
    fps = {1: 0x0, None: 0xF, 2: 0xFF, 3: 0xFF << 40}  # 1 and 2 meet over the row without an id
    rows = spark.createDataFrame([(i, f) for i, f in fps.items()], "doc_id long, fp long")
    before, simhash.fingerprints = simhash.fingerprints, lambda *_: rows
    try:
        got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_classes(rows.withColumn("text", F.lit(""))).collect()}
    finally:
        simhash.fingerprints = before
    assert got == {1: 1, None: 1, 2: 1, 3: 3}


def test_multi_index_loses_no_link():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b ^= 1 << int(bit)
        gaps = [((a ^ b) >> low & ((1 << width) - 1)).bit_count() <= radius for low, width, radius in simhash.SEGMENTS]
        assert any(gaps)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((150, 16))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.standard_normal((150, 16))
    v = np.concatenate([base, base + 0.35 * noise / np.linalg.norm(noise, axis=1, keepdims=True), base[:10] * 3])
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [None] * 16, 0), (1004, [1.0, 0.0], 0), (1005, [1.0, 0.0], 0), (1006, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    root = classes_of(range(len(v)), list(zip(*np.nonzero(near))))
    for spread in (3.0, None):
        got = {r["id"]: r for r in vectors.vector_links(df, cell_rows=40, spread=spread).collect()}
        assert len(got) == len(rows) and got[1000]["n_links"] == 0 and got[1003]["kept"] and got[1006]["kept"]
        assert got[1004]["n_links"] == 1 and got[1005]["component_id"] == 1004 and not got[1005]["kept"]
        counts = np.array([got[i]["n_links"] for i in range(len(v))])
        assert (counts <= near.sum(1)).all() and counts.sum() >= 0.97 * near.sum()
        if spread is None:
            assert counts.tolist() == near.sum(1).tolist() and all(got[i]["component_id"] == root[i] for i in root)
    assert vectors.vector_links(df.where("vec_id = 1000")).count() == 1


def test_vectors_without_ids_or_with_repeated_ones(spark):
    a, b, c, d = [1.0, 0.0, 0.0], [0.95, 0.312, 0.0], [0.8, 0.6, 0.0], [0.0, 0.0, 1.0]
    rows = [(9, a), (None, b), (4, c), (7, d), (7, d), (None, d), (None, [0.0, -1.0, 0.0]), (None, None)]  # a-b and b-c link, a-c doesn't
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, rep int, n_links string")
    got = sorted(map(tuple, vectors.vector_links(df, spread=None, cell_rows=2).collect()), key=str)
    want = [(9, 1, 4, False), (None, 2, 4, False), (4, 1, 4, True), (7, 2, 7, True), (7, 2, 7, True), (None, 2, 7, False), (None, 0, None, False), (None, 0, None, False)]
    assert got == sorted(want, key=str)
    assert vectors.vector_links(df.limit(0)).count() == 0


def test_dense_cell_is_dealt_on_both_sides(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.standard_normal((200, 8)), np.ones(8) + 0.2 * rng.standard_normal((200, 8))])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(400, dtype=bool)
    root = classes_of(range(400), list(zip(*np.nonzero(near))))
    real = vectors._compare

    def noted(vec, rep, *rest):
        (tmp_path / f"{len(rep)}-{uuid.uuid4().hex}").touch()
        return real(vec, rep, *rest)

    monkeypatch.setattr(vectors, "_compare", noted)  # goes to the workers with the function that calls it
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r["id"]: r for r in vectors.vector_links(df, spread=None, block_rows=20).collect()}
    held = [int(x.name.split("-")[0]) for x in tmp_path.iterdir()]
    assert len(held) >= 100 and max(held) < 200
    assert [got[i]["n_links"] for i in range(400)] == near.sum(1).tolist() and all(got[i]["component_id"] == root[i] for i in root)


@pytest.mark.parametrize("cell_rows", [None, 1000])
def test_pairs_across_a_cell_boundary(spark, tmp_path, cell_rows):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((1500, 64)) / 8
    v[:, 0] += np.where(np.arange(1500) % 2, 0.3, -0.3)
    pairs = rng.standard_normal((60, 64)) / 8
    pairs[:, 0] = 0
    pairs *= np.sqrt(1 - 0.22**2) / np.linalg.norm(pairs, axis=1, keepdims=True)
    v = np.concatenate([v, pairs + 0.22 * np.eye(64)[0], pairs - 0.22 * np.eye(64)[0]])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op7_vectors(spark, str(tmp_path)) if cell_rows is None else vectors.vector_links(df, cell_rows=cell_rows, spread=None).withColumnRenamed("id", "vec_id")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    links = {r["vec_id"]: r["n_links"] for r in got.collect()}
    assert near.sum() >= 120 and [links[i] for i in range(len(u))] == near.sum(1).tolist()


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text("abc ", min_size=1, max_size=40), st.text("abc ", max_size=60), st.sampled_from([0.0, 0.1, 0.3]))
def test_edit_matches_are_those_of_brute_force(item, text, rate):
    wanted, seen = decontaminate.normal(item), decontaminate.normal(text)
    found = decontaminate.Matcher([(1, item)], rate).find(text)
    best = plain_distance(wanted, seen)
    if wanted and seen and best <= int(len(wanted) * rate):
        assert [(a, b) for a, b, _ in found] == [(1, best)]
    else:
        assert found == []


def test_contaminated_documents(spark):
    item = "the quick brown fox jumps over the lazy dog and runs home again"
    docs = spark.createDataFrame([(1, f"x {item.upper()} y", 0, 0), (2, f"before {item.replace('quick', 'quack')} after", 0, 0), (3, "clean text", 0, 0), (4, None, 0, 0), (5, "", 0, 0), (1, f"x {item} y", 0, 0)], DOCS)
    bench = spark.createDataFrame([(9, item), (10, ""), (11, None)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.contaminated_pairs(docs, bench).collect())
    assert got == [(1, 9, 0), (1, 9, 0), (2, 9, 1)]
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5]
    assert decontaminate.contaminated_pairs(docs, bench.limit(0)).count() == 0


def test_ordinal_gradient_and_order():
    rng = np.random.default_rng(0)
    counted = [([f"w{j}" for j in rng.choice(12, 4, replace=False)], [1, 1, 2, 1]) for _ in range(300)]
    data = toxicity.SparseRows(counted, [f"w{j}" for j in range(12)])
    grades = np.array([min(3, sum(w in ("w0", "w1", "w2") for w in words)) for words, _ in counted])
    model = toxicity.OrdinalModel.fit(data, grades)
    assert sorted(model.thresholds) == model.thresholds and len(set(model.thresholds)) == 3
    guess = [sum(p >= 0.5 for p in model.at_least(" ".join(words))) for words, _ in counted]
    assert np.mean(np.array(guess) == grades) > 0.9
    assert toxicity.OrdinalModel.fit(data, np.zeros(300, int)).at_least("w0") == [0.0]


def test_toxicity_on_held_out_rows(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels.where("doc_id % 2 = 0"))
    got = toxicity.score_severity(docs, model).join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "label"), "doc_id").toPandas()
    assert (got["toxic"] == (got["label"] == 1)).mean() > 0.98
    assert ((got["expected_severity"] >= 0) & (got["expected_severity"] <= 3)).all()
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r["toxic"] for r in toxicity.score_severity(odd, model).collect()] == [False, False]
    assert toxicity.fit_toxicity(docs, labels.limit(0)).at_least("idiot") == [0.0]


@pytest.mark.parametrize(("sf", "least"), [("sf0.001", 0.2), ("sf0.01", 0.6)])
def test_toxicity_on_held_out_rows_of_small_tables(spark, sf, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    caught, toxic, false, clean = 0, 0, 0, 0
    for fold in range(4):
        model = toxicity.fit_toxicity(docs, labels.where(f"doc_id % 4 <> {fold}"))
        held = docs.join(labels.where(f"doc_id % 4 = {fold} and toxic is not null").withColumnRenamed("toxic", "label"), "doc_id").select("label", "text").collect()
        hits = [(r["label"], model.at_least(r["text"])[0] >= 0.5) for r in held]
        caught, toxic = caught + sum(h for y, h in hits if y), toxic + sum(y for y, _ in hits)
        false, clean = false + sum(h for y, h in hits if not y), clean + sum(not y for y, _ in hits)
    print(f"{sf}: {caught} of {toxic} caught, {false} of {clean} false")
    assert caught >= least * toxic and false <= 0.02 * clean


def test_telling_features_by_chance():
    rng = np.random.default_rng(2)
    a, b = rng.binomial(10, 0.2, 3000), rng.binomial(90, 0.2, 3000)  # as frequent in both: none tells
    assert (toxicity.dependence(a, b, 10, 90) >= toxicity.least_dependence(a, b, np.ones(3000), 10, 90)).sum() <= 1
    a, b, many = [5, *a], [0, *b], np.ones(3001)
    assert toxicity.dependence(5, 0, 10, 90) >= toxicity.least_dependence(a, b, many, 10, 90)
    assert toxicity.least_dependence([1], [1], [40], 10, 90) == float("inf")


def test_gumbel_top_k(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.Resampler(docs, labels)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    raw = np.zeros(quality.BUCKETS)
    for t in rows.values():
        raw += np.bincount(quality.ngram_buckets(t), minlength=quality.BUCKETS)
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    target = sum(np.bincount(quality.ngram_buckets(rows[i]), minlength=quality.BUCKETS) for i in good)
    ratios = np.log((target + 0.5) / (target + 0.5).sum()) - np.log((raw + 0.5) / (raw + 0.5).sum())
    assert np.allclose(model.ratios, ratios)
    weights = {i: float(np.bincount(quality.ngram_buckets(t), minlength=quality.BUCKETS) @ ratios) for i, t in rows.items()}
    drawn = {r["doc_id"]: r for r in quality.resample(docs, labels, len(rows)).collect()}
    assert all(drawn[i]["log_weight"] == pytest.approx(w, abs=1e-6) for i, w in weights.items())
    ranked = sorted(drawn, key=lambda i: -drawn[i]["key"])
    for k in (1, 50, 150):
        assert {r["doc_id"] for r in quality.resample(docs, labels, k).collect()} == set(ranked[:k])
    known = labels.where("quality is not null").count()
    share = len(good) / known
    k = int(np.ceil(len(rows) * (share + 2 * np.sqrt(share * (1 - share) / known))))
    assert {r["doc_id"] for r in quality.keep_sampled(docs, labels).collect()} == set(ranked[:k])
    kept = quality.keep_sampled(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    odd = spark.createDataFrame([(None, None, 0, 0), (None, "a b", 0, 0), (1, "", 0, 0), (1, "", 0, 0), (2, "a b " * 50_000, 0, 0)], DOCS)
    assert quality.resample(odd, labels).count() == 5 and len({r["key"] for r in quality.resample(odd, labels).collect()}) == 4
    assert quality.resample(odd.limit(0), labels).count() == quality.keep_sampled(odd.limit(0), labels.limit(0)).count() == 0


def test_draws_follow_the_weights(spark):
    weights, seeds = np.array([0.0, 1.0, -1.0, 0.5, -3.0]), 4000
    df = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "i long, w double").crossJoin(spark.range(seeds).withColumnRenamed("id", "s"))
    keys = df.withColumn("key", F.col("w") + quality.gumbel(F.col("i"), F.col("s"))).toPandas().pivot(index="s", columns="i", values="key").to_numpy()
    first, second = np.argsort(-keys, axis=1)[:, :2].T
    p = np.exp(weights) / np.exp(weights).sum()
    pairs = np.array([[p[a] * p[b] / (1 - p[a]) if a != b else 0.0 for b in range(5)] for a in range(5)])  # drawn one after another
    got = np.bincount(first * 5 + second, minlength=25).reshape(5, 5) / seeds
    assert np.abs(got - pairs).max() < 0.025 and np.abs(got.sum(1) - p).max() < 0.025


def test_kth_largest_with_ties(spark):
    values = [float(i // 3) for i in range(30000)]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 3, 4, 15000, 30000):
        assert quality.kth_largest(df, "key", k) == sorted(values, reverse=True)[k - 1]


def test_main_text():
    page = '<html><head><title>T</title></head><body><header>Site</header><nav><a href="/">Home</a></nav><div class="cookie-notice">Cookies, yes?</div><article><h1>Title &amp; more</h1><p><b>One, two.<br><p>Three  four,\n five.</p><script>var a="</p>";</script><div class="ad">Buy</div><section id="comments"><p>Nice one, really.</p></section></article><aside>Side</aside><form>go</form><footer>&copy; me</footer></body></html>'
    assert html.main_text(page) == "Title & more One, two. Three four, five."
    assert [html.main_text(x) for x in (None, "", "<p></p>", "<nav>a</nav>")] == [""] * 4
    assert html.main_text("<p>plain <i>in</i>line &#233;") == "plain inline é"


def test_names_of_topics_and_layout_stay():
    text = "One, two. Three, four, five."
    for page in (
        f"<body><article><h2 id='search'>About search</h2><p>{text}</p></article></body>",
        f"<body><article><section id='form-and-function'><h2 id='legal-basis'>About search</h2><p>{text}</p></section></article></body>",
        f"<body><article><header class='article-header'><h1>About search</h1></header><p>{text}</p></article></body>",
        f"<body><div class='content no-sidebar'><div><h1>About search</h1><p>{text}</p></div><div class='sidebar-left'>Links</div></div></body>",
        f"<body><div class='widget'><div><h1>About search</h1><p>{text}</p></div></div><div class='ad'>Buy</div></body>",
    ):
        assert html.main_text(page).endswith(text) and "Buy" not in html.main_text(page) and "Links" not in html.main_text(page)
        assert html.main_text(page).startswith("About search") or "<article" not in page
    long = "Nice, really. " * 40
    assert html.main_text(f"<body><article><p>{text}</p><div class='comments-list'>{long}</div></article></body>") == text


def labelled_pages():
    """(html, article text) of pages in layouts with and without article or main; prose and labels are drawn."""
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefghilmnorstu"), rng.integers(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words, n))
    prose = lambda: " ".join(f"{say(int(rng.integers(4, 9)))}, {say(int(rng.integers(3, 9)))}." for _ in range(int(rng.integers(1, 6)))).capitalize()
    links = lambda n, cls: f"<div class='{cls}'>" + "".join(f"<a href='/{i}'>{say(2)}</a> " for i in range(n)) + "</div>"
    out = []
    for i in range(120):
        title, parts = say(5), [prose() for _ in range(int(rng.integers(3, 12)))]
        parts[1] = say(1)  # a very short paragraph
        body = "".join(f"<p>{x}</p>" if j != 2 else f"<h2>{x}</h2>" for j, x in enumerate(parts))
        before = f"<div class='c{i % 5}'>{say(3)}</div>" + links(8, f"m{i % 7}") + "<header>Site</header>" + f"<nav>{links(5, 'x')}</nav>"
        after = links(6, "r1") + f"<div class='sidebar'>{links(4, 'y')}<p>{say(6)}</p></div><div class='cookie-notice'>{say(9)}.</div><footer>{say(12)}. {say(7)}.</footer>"
        ad, talk = f"<div class='ad-box'>{say(7)}.</div>", f"<section class='comments'><p>{prose()}</p><p>{prose()}</p></section><form>{say(3)}</form>"
        inner = {
            0: f"<article><h1>{title}</h1>{body}{ad}{talk}</article>",
            1: f"<main><header><h1>{title}</h1></header><div>{body}</div>{talk}</main>",
            2: f"<div class='post'><h1>{title}</h1><div class='txt'>{body}{ad}</div></div>{talk}",
            3: f"<h1>{title}</h1>{body}{ad}{talk}",
            4: f"<table><tr><td>{links(9, 'z')}</td><td class='w'><h1>{title}</h1>{body}</td></tr></table>",
        }[i % 5]
        head = "<head><title>t</title><script>var a='</p>';</script>" + ("" if i % 3 == 0 else "</head>")  # its end may be left out
        out.append((f"<!DOCTYPE html><html>{head}<body>{before}{inner}{after}</body></html>", " ".join([title, *parts])))
    return out


def test_main_text_of_labelled_pages(spark, monkeypatch):
    pages, right, got, want, same = labelled_pages(), 0, 0, 0, 0
    for page, text in pages:
        found, own = Counter(html.main_text(page).split()), Counter(text.split())
        right, got, want = right + (found & own).total(), got + found.total(), want + own.total()
        same += html.main_text(page) == text
    print(f"precision {right / got:.4f}, recall {right / want:.4f}, {same} of {len(pages)} exact")
    assert right / got > 0.98 and right / want > 0.98 and same >= 0.9 * len(pages)
    real = [html.main_text(page) for page, _ in pages]
    with monkeypatch.context() as m:
        m.setattr(html, "path_scores", lambda blocks: {b.path: 1.0 for b in blocks})
        assert sum(html.main_text(page) != text for (page, _), text in zip(pages, real, strict=True)) > 0.8 * len(pages)  # the ratios decide
    odd = spark.createDataFrame([(1, None, "own"), (1, "", "own"), (1, "", "own"), (2, "<p>" + "one, two. " * 200_000, None)], "page_id long, html string, Text string")
    rows = html.extract_main_text(odd).collect()
    assert [r["text_"] for r in rows[:3]] == [""] * 3 and len(rows[3]["text_"]) == 200_000 * 10 - 1 and [r["Text"] for r in rows] == ["own"] * 3 + [None]
    assert html.extract_main_text(odd.limit(0)).count() == 0


def test_open_head_and_slugs():
    text = "One, two. Three, four, five."
    assert html.main_text(f"<html><head><title>x</title><body><p>{text}</p>") == text
    assert html.main_text(f"<html><head><meta charset=u><title>x</title><p>{text}</p>") == text
    assert html.main_text(f"<article><h2>a</h2><section class='side-effects'><p>{text}</p></section><div class='search-history'><p>{text}</p></div></article>") == f"a {text} {text}"


def plain_words(text):
    return (text or "").encode().lower().split()


def test_words_of_slices(monkeypatch):
    monkeypatch.setattr(lm, "SLICE", 40)
    texts = ["A b\x0b c ", None, "", "é\u2006x Ÿ", "one " * 30, " É\u00a0b\x0c\x1cZ", "x"] * 3
    got = [[] for _ in texts]
    for at, _, text, place, words in lm.text_words(pa.array(texts, pa.string())):
        for t, w in zip(text, place, strict=True):
            got[at + t].append(words[int(w)].as_py().encode())
    assert got == [plain_words(t) for t in texts]


def plain_log10(model, ids, words, counts, rare_norm):
    """log10 probability of a text by full softmaxes over all classes and all units of a class, one token at a time."""
    p, total, before = model.params, 0.0, [1] * model.context
    for w in [*words, None]:
        unit = 1 if w is None else ids.get(w, 0)
        q = np.append(sum(p["word"][b].astype(float) * p["mix"][i] for i, b in enumerate(before)), 1.0)
        e = np.exp(p["class"].astype(float) @ q)
        total += np.log10(e[model.classes[unit]] / e.sum())
        if unit >= model.first:
            inside = np.flatnonzero(model.classes == model.classes[unit])
            e = np.exp(p["unit"][inside - model.first].astype(float) @ q)
            total += np.log10(e[list(inside).index(unit)] / e.sum())
        if unit == 0:
            total += np.log10(counts[w] + 0.5) - rare_norm
        before = [unit, *before[:-1]]
    return total


def test_language_model(spark, monkeypatch):
    docs, models, learn = documents(spark), [], lm.learn_model
    monkeypatch.setattr(lm, "learn_model", lambda *a: models.append(learn(*a)) or models[-1])
    rows = {r["doc_id"]: plain_words(r["text"]) for r in docs.collect()}
    train = Counter(w for i, ws in rows.items() if not lm.is_held_out(i) for w in [*ws, lm.END.encode()])
    total, norm = sum(train.values()), np.log10(sum(train.values()) + 0.5 * (len(train) + 1))
    got = lm.fit_and_score(docs, vocabulary=300, head=400).collect()
    assert len(got) == len(rows)
    own = sorted((w for w in train if w != b" "), key=lambda w: (-train[w], w))[:300]
    ids = {w: i + 2 for i, w in enumerate(own)}
    rare = total - train[b" "] - sum(train[w] for w in own)
    rare_norm = np.log10(rare + 0.5 * (len(train) - 1 - len(own) + 1))
    for n, r in enumerate(sorted(got, key=lambda r: r["doc_id"])):
        words = [*rows[r["doc_id"]], lm.END.encode()]
        assert r["n_tokens"] == len(words) and r["train_tokens"] == total and r["n_known"] == sum(train[w] > 0 for w in words)
        assert r["base_score"] == pytest.approx(sum(np.log10(train[w] + 0.5) - norm for w in words))
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        if n % 20 == 0:
            assert r["score"] == pytest.approx(plain_log10(models[0], ids, words[:-1], train, rare_norm), rel=1e-4)
    odd = spark.createDataFrame([(1, None, 0, 0), (None, "a b", 0, 0), (1, None, 0, 0), (2, "Long \x0b word " * 300_000, 0, 0)], DOCS)
    assert sorted(r["n_tokens"] for r in lm.fit_and_score(odd).collect()) == [1, 1, 3, 600_001]
    assert lm.fit_and_score(odd.limit(0)).count() == 0


def test_language_model_beats_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = [
        lm.fit_and_score(d).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()  # log10, negative
        for d in (docs, docs.repartition(16))
    ]
    print("held-out score and base:", sums)
    assert all(score > base * 0.95 for score, base in sums)
    assert sums[0][0] == pytest.approx(sums[1][0], rel=1e-6)  # the number of tasks changes nothing


def test_shards_are_averaged_by_how_often_a_row_is_met():
    start = lm.LogBilinear(5.0, 5.0, np.array([9.0, 8, 7, 6]), size=4, alone=1)
    import copy

    a, b, out = copy.deepcopy(start), copy.deepcopy(start), copy.deepcopy(start)
    a.learn(a.contexts(np.tile([2, 3], 40)), np.tile([2, 3], 40), seed=1)
    b.learn(b.contexts(np.tile([4, 5, 2], 40)), np.tile([4, 5, 2], 40), seed=2)
    out.moved(a.changes(start) + b.changes(start))
    for k in start.params:
        wa, wb = a.met[k][:, None], b.met[k][:, None]
        want = start.params[k] + (wa * (a.params[k] - start.params[k]) + wb * (b.params[k] - start.params[k])) / np.maximum(wa + wb, 1)
        assert np.allclose(out.params[k], want, atol=1e-5)


def test_bilinear_probabilities_add_up_and_learn():
    model = lm.LogBilinear(1.0, 1.0, np.ones(9), size=8, alone=2)
    units = np.tile([2, 3, 8], 4000)
    contexts = model.contexts(units)
    one = np.repeat(contexts[:, 10:11], 11, axis=1)
    before = model.log_probs(contexts, units).mean()
    for seed in range(3):
        model.learn(contexts, units, noise=(8, 8), batch=256, seed=seed)
    assert np.exp(model.log_probs(one, np.arange(11))).sum() == pytest.approx(1.0, abs=1e-5)
    assert model.log_probs(contexts, units).mean() > before + 0.5
