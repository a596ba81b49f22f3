"""Items and rows that are there very often: counted once, dealt over files, nothing collected for them."""

import itertools

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from chartwright.llm import decontaminate, graph, lm, records, simhash

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_repeated_and_empty_items_are_counted_not_sent(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "aa needle in a haystack bb"), (2, "nothing"), (None, "needle in a haystock")], "doc_id long, text string")
    many = spark.range(30_000).select(F.lit(7).cast("long").alias("item_id"), F.when(F.col("id") % 3 == 0, "Needle in a haystack").when(F.col("id") % 3 == 1, "  \n").alias("text"))
    bench = many.unionByName(spark.createDataFrame([(8, "needle in a haystack"), (None, "Needle in a haystack"), (9, "other words here")], "item_id long, text string"))
    sent = []
    real = decontaminate.Matcher.__init__
    monkeypatch.setattr(decontaminate.Matcher, "__init__", lambda self, items, rate: (sent.append(len(items)), real(self, items, rate))[1])
    items, texts, blocks = decontaminate._items(bench)
    assert (items.count(), texts.count(), blocks) == (4, 3, 1) and items.agg(F.max("copies")).first()[0] == 10_000
    got = decontaminate.contaminated_pairs(docs, bench).groupBy("doc_id", "item_id", "distance").count().collect()
    want = {(d, i, 0 if d else 1): n for d in (1, None) for i, n in ((7, 10_000), (8, 1), (None, 1))}
    assert {(r["doc_id"], r["item_id"], r["distance"]): r["count"] for r in got} == want
    assert sorted(r["text"] for r in decontaminate.drop_contaminated(docs, bench).collect()) == ["nothing"]


def test_blocks_of_items_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 500)
    bench = spark.range(60).select(F.col("id").alias("item_id"), F.concat(F.lit("words of item number "), F.col("id").cast("string"), F.lit(" and so on")).alias("text"))
    _, texts, blocks = decontaminate._items(bench)
    sizes = [r["n"] for r in texts.groupBy("block").agg(F.sum(F.length("text")).alias("n")).collect()]
    assert len(sizes) == blocks > 3 and max(sizes) <= 500 + 40
    docs = bench.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("x "), "text", F.lit(" y")).alias("text"))
    got = decontaminate.contaminated_pairs(docs, bench).where("distance = 0").select("doc_id", "item_id").collect()
    assert sorted(tuple(r) for r in got) == [(i, i) for i in range(60)]


def test_one_row_however_often_fills_several_files(spark):
    docs = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text")).repartition(8)
    docs = docs.unionByName(spark.createDataFrame([(1, "one"), (1, "one"), (0, "two words")], "doc_id long, text string"))
    _, manifest = records.write_records(docs, VOCABULARY, files=6)
    rows = manifest.select("n_records").collect()
    assert len(rows) > 3 and max(r["n_records"] for r in rows) < 20_000 and sum(r["n_records"] for r in rows) == 40_003
    back = records.read_records(spark, manifest).select("doc_id", "start", F.expr("length(ids) / 4").cast("long").alias("n")).orderBy("start").collect()
    assert [r["start"] for r in back] == [0, *[sum_ for sum_ in itertools.accumulate(r["n"] for r in back)][:-1]]
    assert [r["doc_id"] for r in back[-3:]] == [0, 1, 1]


def test_crowded_simhash_keys_lose_no_link(spark):
    rng = np.random.default_rng(11)
    fps = [int(x) for x in rng.integers(0, 1 << 64, 700, dtype=np.uint64)]
    fps += [(0x2ABCD << 42) | int(x) for x in rng.integers(0, 1 << 42, 700, dtype=np.uint64)]  # a third share a segment
    fps += [(0x155555 << 21) | (int(h) << 42) | int(x) for h, x in zip(rng.integers(0, 4, 500), rng.integers(0, 1 << 12, 500), strict=True)]  # parts too
    for base in fps[::7]:
        fps.append(base ^ sum(1 << int(b) for b in rng.choice(64, 4, replace=False)))  # at the limit
        fps.append(base ^ sum(1 << int(b) for b in rng.choice(64, 5, replace=False)))  # beyond it
    bits = np.array(sorted(set(fps)), np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None]) <= 4
    want = np.arange(len(bits))
    while True:
        low = np.where(near, want[None], len(bits)).min(axis=1)
        if (low == want).all():
            break
        want = low
    rows = spark.createDataFrame([(int(x), i) for i, x in enumerate(bits.view(np.int64))], "fp long, rep long")
    for most in (40, 1 << 15):
        assert simhash._crowded(rows, most).any() == (most == 40)
        links = simhash.near_links(rows, most).collect()
        assert all(near[r["a"], r["b"]] for r in links)
        pairs = np.array([(r["a"], r["b"]) for r in links])
        root = graph.union_roots(np.arange(len(bits)), pairs[:, 0], pairs[:, 1])
        assert (root == want).all()
    finer = spark.range(1000).select(F.lit(1 << 24).alias("key"), F.col("id").alias("fp"), F.col("id").alias("rep"))
    dealt = simhash._in_blocks(finer, 40).groupBy("key").agg(F.count("*").alias("n"), F.collect_set("fp").alias("fps")).collect()
    assert len(dealt) > 100 and max(r["n"] for r in dealt) < 100
    assert len({(a, b) for r in dealt for a in r["fps"] for b in r["fps"]}) == 1_000_000


def test_long_texts_keep_their_fingerprint(monkeypatch):
    rng = np.random.default_rng(5)
    for width in (1, 4, 5):
        for n in (0, 1, 3, 4, 50, 400):
            text = b"".join(bytes(rng.choice(list(b"aBc"), rng.integers(1, 9)).tolist()) + bytes(rng.choice(list(b" \t\n\x0b"), rng.integers(1, 3)).tolist()) for _ in range(n))
            monkeypatch.setattr(simhash, "SLICE", 1 << 22)
            whole = simhash.fingerprint(text, width)
            for size in (1, 7, 30):
                monkeypatch.setattr(simhash, "SLICE", size)
                assert simhash.fingerprint(text, width) == whole


def test_pieces_of_long_texts_know_what_is_before_them():
    rng = np.random.default_rng(2)
    model = lm.LogBilinear(3.0, 2.0, np.arange(60, 0, -1.0), size=8, alone=8)
    texts = [rng.integers(0, 62, n).astype("<u2") for n in (1, 90, 3, 1, 41, 7)]
    want = np.concatenate([model.contexts(t.astype(np.int64)) for t in texts], axis=1)
    for most in (1, 3, 10, 1000):
        got = list(model.pieces(texts, most))
        assert np.array_equal(np.concatenate([c for c, _, _ in got], axis=1), want)
        assert np.array_equal(np.concatenate([u for _, u, _ in got]), np.concatenate(texts))
        assert np.array_equal(np.concatenate([i for _, _, i in got]), np.repeat(np.arange(6), [len(t) for t in texts]))
        assert max(len(u) for _, u, _ in got) < most + 90
    assert list(model.pieces([], 5)) == []


def test_long_words_are_counted_by_their_digest(spark):
    word = "Ab" * 200_000
    texts = [f"x {word}", f"{word} y {word}", word.lower(), f"{word}c", None, "x y"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = {r["word"]: (r["c"], r["seen"]) for r in lm.word_counts(docs).collect()}
    assert max(len(w) for w in counts) <= lm.LONGEST and len(counts) == 5
    assert counts[lm.long_word(word.lower().encode()).decode()] == (4 - sum((1, 2, 1)[i] for i in range(3) if lm.is_held_out(i)), 4)
    train = [w for i, t in enumerate(texts) if not lm.is_held_out(i) for w in [*(t or "").lower().split(), " "]]
    norm = np.log10(len(train) + 0.5 * (len(set(train)) + 1))
    for r in lm.fit_and_score(docs, vocabulary=2, head=2).collect():
        words = [*(texts[r["doc_id"]] or "").lower().split(), " "]
        assert abs(r["base_score"] - sum(np.log10(train.count(w) + 0.5) - norm for w in words)) < 1e-9
        assert r["n_tokens"] == len(words) and r["n_known"] == sum(w in train for w in words)
