"""Log-bilinear language model with noise-contrastive estimation (operator 6).

The model predicts a word from the bilinear form of its vector with a mix of the vectors of the words before
it. Its output is factored into classes, so that it stays normalised over a large vocabulary at the cost of
about its square root: the class first, then the word in it. The most frequent words, the end of a text and
the rest of all words are classes of their own; a word of the rest is predicted by its smoothed count there.

Texts are walked twice, to count words and to turn them into the vocabulary's ids, which learning and scoring
read. Learning goes in synchronous rounds: the training texts are dealt by id into shards of a like number of
tokens, the shards of a round learn from the same start, and each vector's change is averaged over the shards
by how often they met it. Shards and rounds depend on the data alone, not on how many tasks there are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartwright.llm.common import materialize, partitions

#: The end of a text; no word has a blank.
END = " "
#: A longer word, in bytes, goes by a blank and its SHA-256, so that what is counted and broadcast is bounded in bytes.
LONGEST = 256
#: Units scored in one piece, about; a longer text goes on from its last units.
PIECE = 250_000
#: Distinct words kept before a task hands its partial counts on.
PARTIAL = 400_000
#: Bytes of text cut into words at a time; a longer text is cut alone.
SLICE = 4 << 20
#: Training tokens of a shard, about; shards of a round at least; rounds of a pass and passes at most.
SHARD_TOKENS, ROUND_SHARDS, MAX_ROUNDS, MAX_PASSES = 2_000_000, 6, 8, 8
#: Tokens learnt from in all at least: small tables are walked several times.
LEAST_TOKENS = 16_000_000


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def long_word(word: bytes) -> bytes:
    """What a word of more than LONGEST bytes is counted as; no other word starts with a blank."""
    return b" " + hashlib.sha256(word).hexdigest().encode()


def text_words(texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, object]]:
    """(first text, number of texts, each word's text, each word's place in names, names) of slices of an Arrow array.

    Words lie between ASCII white space, A-Z lower-cased, long ones as long_word(); null texts have none.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, side="right")))
        part = texts.take(pa.array(np.arange(at, to)))  # a copy: ascii_lower reads a slice's bytes from the wrong place
        part = pc.fill_null(part.cast(pa.large_string()), "")
        pieces = pc.ascii_split_whitespace(pc.ascii_lower(part))
        flat, sizes = pieces.flatten(), np.diff(pieces.offsets.to_numpy())
        some = pc.greater(pc.binary_length(flat), 0)
        coded = flat.filter(some).dictionary_encode()
        text = np.repeat(np.arange(to - at), sizes)[some.to_numpy(zero_copy_only=False)]
        words = coded.dictionary
        if (pc.max(pc.binary_length(words)).as_py() or 0) > LONGEST:
            words = pa.array([w if len(w) <= LONGEST else long_word(w) for w in words.cast(pa.large_binary()).to_pylist()], pa.large_binary()).cast(pa.large_string())
        yield at, to - at, text, coded.indices.to_numpy().astype(np.int64), words
        at = to


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, seen): occurrences in the training rows of (doc_id, text) and in all rows, each text's end included.

    Tasks add up their own words first.
    """

    def run(batches):
        import pyarrow as pa

        names = ["word", "c", "seen"]
        held, rows = [], 0

        def merged():
            table = pa.concat_tables(held).group_by("word").aggregate([("c", "sum"), ("seen", "sum")])
            return table.rename_columns(names) if table.column_names[0] == "word" else table.select(["word", "c_sum", "seen_sum"]).rename_columns(names)

        def add(words, c, seen):
            held.append(pa.table([words, pa.array(c), pa.array(seen)], names=names))

        for batch in batches:
            train = np.array([not is_held_out(d) for d in batch.column(0).to_pylist()], bool)
            add(pa.array([END], pa.large_string()), [int(train.sum())], [len(train)])
            for at, _, text, place, words in text_words(batch.column(1)):
                k = len(words)
                seen = np.bincount(place, minlength=k)
                add(words, np.bincount(place[train[at + text]], minlength=k), seen)
                rows += k
                if rows > PARTIAL:
                    table = merged()
                    held, rows = [table], table.num_rows
                    if rows > PARTIAL // 2:
                        yield from table.cast(pa.schema([("word", pa.string()), ("c", pa.int64()), ("seen", pa.int64())])).to_batches()
                        held, rows = [], 0
        if held:
            yield from merged().cast(pa.schema([("word", pa.string()), ("c", pa.int64()), ("seen", pa.int64())])).to_batches()

    return docs.mapInArrow(run, "word string, c long, seen long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def head_count(counts: DataFrame, col: str, head: int) -> int:
    """A count that at most `head` words reach, from a histogram over eighths of powers of two."""
    size = F.floor(F.log2(col) * 8).cast("int")
    seen, out = 0, None
    for r in sorted(counts.groupBy(size.alias("size")).agg(F.count("*").alias("n"), F.min(col).alias("c")).collect(), key=lambda r: -r["size"]):
        seen += r["n"]
        if seen > head:
            return out if out is not None else r["c"] + 1
        out = r["c"]
    return out if out is not None else 1


class LogBilinear:
    """Parameters and probabilities over unit ids: 0 all words out of the vocabulary, 1 the end, 2.. the vocabulary."""

    def __init__(self, rest: float, ends: float, counts: np.ndarray, size: int = 16, context: int = 4, alone: int = 32, seed: int = 3):
        """counts: of the vocabulary's words, falling. The first `alone` are classes of their own; the others are cut
        in order of frequency into as many classes as one has words."""
        rng, mass = np.random.default_rng(seed), np.concatenate(([rest, ends], counts)) + 0.5
        units = len(mass)
        self.context, self.first = context, min(units, alone + 2)
        inside = units - self.first
        groups = int(np.ceil(np.sqrt(inside)))
        self.cuts = np.arange(groups + 1) * inside // max(1, groups)  # of the units after the first ones
        self.classes = np.arange(units)
        self.classes[self.first :] = self.first + np.searchsorted(self.cuts, np.arange(inside), side="right") - 1
        by_class = np.bincount(self.classes, weights=mass)
        self.noise = {"class": by_class / by_class.sum(), "unit": mass[self.first :] / max(mass[self.first :].sum(), 1e-300)}

        def output(p):
            return np.concatenate((rng.standard_normal((len(p), size)) * 0.1, np.log(np.maximum(p, 1e-30))[:, None]), axis=1).astype(np.float32)

        self.params = {
            "word": (rng.standard_normal((units, size)) * 0.1).astype(np.float32),
            "mix": np.repeat(1 / np.arange(1, context + 1), size).reshape(context, size).astype(np.float32),
            "class": output(self.noise["class"]),  # the last column is the bias
            "unit": output(self.noise["unit"]),
        }
        self.grown = {k: np.full(len(x), 1e-2, np.float32) for k, x in self.params.items()}
        self.met = {k: np.zeros(len(x)) for k, x in self.params.items()}

    def contexts(self, units: np.ndarray) -> np.ndarray:
        """The units before each of a text's, nearest first, a row a position; ends stand before a text."""
        padded = np.concatenate((np.ones(self.context, np.int64), units))
        return np.stack([padded[self.context - 1 - i : len(padded) - 1 - i] for i in range(self.context)])

    def pieces(self, texts: list[np.ndarray], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(contexts, units, text of each unit) of whole texts, `most` units at a time and a text's more; a text of
        more than `most` is cut, and its pieces know the units before them."""
        held: list[tuple] = []
        size = 0
        for i, text in enumerate(texts):
            for at in range(0, len(text), most):
                before = min(at, self.context)
                units = text[at - before : at + most].astype(np.int64)
                held.append((self.contexts(units)[:, before:], units[before:], np.full(len(units) - before, i)))
                size += len(units) - before
                if size >= most:
                    yield tuple(np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
                    held, size = [], 0
        if held:
            yield tuple(np.concatenate(x, axis=-1) for x in zip(*held, strict=True))

    def predict(self, contexts: np.ndarray) -> np.ndarray:
        """Predicted vectors, with a last column of ones for the bias."""
        word, mix = self.params["word"], self.params["mix"]
        out = np.ones((contexts.shape[1], word.shape[1] + 1), np.float32)
        q = out[:, :-1]
        np.multiply(word[contexts[0]], mix[0], out=q)
        for i in range(1, self.context):
            q += word[contexts[i]] * mix[i]
        return out

    def log_probs(self, contexts: np.ndarray, units: np.ndarray, block: int = 1024) -> np.ndarray:
        """Normalised natural log-probabilities by blocked products, classes first, then units inside each class."""
        q, out = self.predict(contexts), np.empty(len(units))
        classes, table = self.classes[units], np.ascontiguousarray(self.params["class"].T)

        def add(rows, table, own):
            for at in range(0, len(rows), block):
                r = rows[at : at + block]
                scores = np.minimum(q[r] @ table, 80)
                mine = scores[np.arange(len(r)), own[at : at + block]]
                np.exp(scores, out=scores)
                out[r] += mine - np.log(scores @ np.ones(scores.shape[1], np.float32))

        out[:] = 0
        add(np.arange(len(units)), table, classes)
        inside = np.flatnonzero(units >= self.first)
        inside = inside[np.argsort(classes[inside].astype(np.uint16), kind="stable")]
        edges = np.searchsorted(classes[inside], self.first + np.arange(len(self.cuts)))
        for g, (at, to) in enumerate(zip(edges, edges[1:], strict=False)):
            if to > at:
                rows = inside[at:to]
                add(rows, self.params["unit"][self.cuts[g] : self.cuts[g + 1]].T, units[rows] - self.first - self.cuts[g])
        return out

    def _step(self, name: str, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
        """Adagrad with one sum of squares a row; gradients of a repeated row are added up."""
        order = np.argsort(rows.astype(np.uint16), kind="stable")
        rows = rows[order]
        at = np.flatnonzero(np.diff(rows, prepend=-1))
        grad, rows, grown = np.add.reduceat(grad[order], at), rows[at], self.grown[name]
        grown[rows] += np.einsum("ij,ij->i", grad, grad) / grad.shape[1]
        self.params[name][rows] -= rate * grad / np.sqrt(grown[rows])[:, None]
        self.met[name][rows] += np.diff(at, append=len(order))

    def _contrast(self, name: str, q: np.ndarray, own: np.ndarray, noise: int, thin: int, rng, rate: float) -> np.ndarray:
        """One step against `noise` shared draws; the gradient of q. The noise term is taken on every thin-th row,
        weighed by thin, so that its expectation stays."""
        p, mass, n = self.params[name], self.noise[name], len(own)
        drawn = np.minimum(np.searchsorted(np.cumsum(mass), rng.random(noise)), len(mass) - 1)
        log_noise = np.log(noise * mass).astype(np.float32)
        thin = thin if n >= 8 * thin else 1
        some = slice(int(rng.integers(thin)), None, thin)
        pull = -1 / (1 + np.exp(np.einsum("nd,nd->n", q, p[own]) - log_noise[own]))
        push = q[some] @ p[drawn].T
        np.exp(log_noise[drawn] - push, out=push)
        np.divide(np.float32(thin), push + 1, out=push)
        back = pull[:, None] * p[own]
        back[some] += push @ p[drawn]
        grad = np.concatenate((pull[:, None] * q, push.T @ q[some]))
        self._step(name, np.concatenate((own, drawn)), grad, rate)
        return back

    def learn(self, contexts: np.ndarray, units: np.ndarray, rate: float = 0.07, noise: tuple[int, int] = (64, 128), thin: int = 4, batch: int = 2048, seed: int = 5) -> None:
        """Noise-contrastive estimation of classes, and of units inside classes. A batch moves the context vectors of
        one position, in turn."""
        rng, turn = np.random.default_rng(seed), 0
        for at in range(0, len(units), batch):
            c, t = contexts[:, at : at + batch], units[at : at + batch]
            q = self.predict(c)
            back = self._contrast("class", q, self.classes[t], noise[0], thin, rng, rate)
            inside = np.flatnonzero(t >= self.first)
            if len(inside):
                back[inside] += self._contrast("unit", q[inside], t[inside] - self.first, noise[1], thin, rng, rate)
            back, turn = back[:, :-1], (turn + 1) % self.context
            mixed = np.einsum("nd,nd->d", back, self.params["word"][c[turn]])
            self._step("word", c[turn], back * self.params["mix"][turn], rate)
            self._step("mix", np.array([turn]), mixed[None], rate * 0.1)

    def changes(self, start: LogBilinear) -> np.ndarray:
        """Changes of all rows since `start`, times how often the row was met, and those numbers, in one flat array."""
        flat = []
        for k, x in self.params.items():
            flat += [((x - start.params[k]) * self.met[k][:, None]).ravel(), (self.grown[k] - start.grown[k]) * self.met[k], self.met[k]]
        return np.concatenate(flat).astype(np.float64)

    def moved(self, flat: np.ndarray) -> None:
        """Add summed changes(), averaged row by row."""
        at = 0
        for k, x in self.params.items():
            change, at = flat[at : at + x.size].reshape(x.shape), at + x.size
            grown, at = flat[at : at + len(x)], at + len(x)
            met, at = np.maximum(flat[at : at + len(x)], 1), at + len(x)
            self.params[k] = (x + change / met[:, None]).astype(np.float32)
            self.grown[k] = (self.grown[k] + grown / met).astype(np.float32)


def learning_plan(tokens: int) -> tuple[int, int, int]:
    """(shards, rounds of a pass, passes) for so many training tokens."""
    shards = max(1, -(-tokens // SHARD_TOKENS))
    return shards, min(MAX_ROUNDS, max(1, shards // ROUND_SHARDS)), min(MAX_PASSES, max(1, -(-LEAST_TOKENS // max(1, tokens))))


def _learning_round(texts: DataFrame, model: LogBilinear, shards: int, seed: int) -> LogBilinear:
    """The model after each shard of (shard, doc_id, ids) has learnt from `model`, in order of doc_id and ids.

    A shard returns what has the size of the model; at most 8 sums of them reach the driver.
    """
    spark = texts.sparkSession
    shared, schema = spark.sparkContext.broadcast(model), "g int, flat binary"

    def run(batches):
        import copy

        import pyarrow as pa

        own, now, held, size = None, None, [], 0

        def learn():
            for contexts, units, _ in own.pieces([np.frombuffer(x, "<u2") for x in held], 1 << 19):
                own.learn(contexts, units, seed=hash((seed, now)) % (1 << 32))

        def done():
            if held:
                learn()
            return pa.record_batch([pa.array([now % 8], pa.int32()), pa.array([own.changes(shared.value).tobytes()], pa.binary())], names=["g", "flat"])

        for batch in batches:
            for shard, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != now:
                    if now is not None:
                        yield done()
                    own, now, held, size = copy.deepcopy(shared.value), shard, [], 0
                held.append(ids)
                size += len(ids)
                if size > 1 << 20:
                    learn()
                    held, size = [], 0
        if now is not None:
            yield done()

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, flat in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[g] = sums.get(g, 0.0) + np.frombuffer(flat)
        for g, flat in sums.items():
            yield pa.record_batch([pa.array([g], pa.int32()), pa.array([flat.tobytes()], pa.binary())], names=["g", "flat"])

    dealt = texts.repartition(min(shards, partitions(spark)), "shard").sortWithinPartitions("shard", "doc_id", "ids").select("shard", "ids")
    parts = dealt.mapInArrow(run, schema).repartition(8, "g").sortWithinPartitions("g", "flat").mapInArrow(add, schema).collect()
    if parts:
        model.moved(sum(np.frombuffer(r["flat"]) for r in sorted(parts, key=lambda r: r["g"])))
    shared.unpersist()
    return model


def learn_model(texts: DataFrame, model: LogBilinear, tokens: int) -> LogBilinear:
    """The model after all passes over the training rows of (shard, doc_id, held_out, ids)."""
    shards, rounds, passes = learning_plan(tokens)
    train = texts.where("not held_out").select("shard", "doc_id", "ids")
    for n in range(rounds * passes):
        model = _learning_round(train.where(F.col("shard") % rounds == n % rounds), model, -(-shards // rounds), n)
    return model


def fit_and_score(docs: DataFrame, vocabulary: int = 8192, head: int = 150_000, size: int = 16, context: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    base_score: log10 probability under smoothed unigram counts; score: under the log-bilinear model over the
    `vocabulary` most frequent training words (65,000 at most) and the class of all others. Null texts count as
    empty: they have an end only. Null ids aren't held out. Repeated rows are scored each. Empty input: no rows.
    Counts of the `head` words that occur most often in all rows are broadcast, so that any other word is rare;
    those are counted within their text and joined to their counts, so no list of all words is in one place.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = materialize(word_counts(rows), "words")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    total, types = sums["n"], sums["v"]
    top = counts.where(F.col("seen") >= head_count(counts, "seen", max(head, vocabulary + 1))).toArrow()  # head rows at most
    known = sorted(zip(top.column("word").to_pylist(), top.column("c").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    ends = next((c for w, c in known if w == END), 0)
    known = [(w, c) for w, c in known if w != END]
    own = [c for _, c in known[:vocabulary] if c > 0]
    rare_tokens, rare_types = total - ends - sum(own), types - (ends > 0) - len(own)
    model = LogBilinear(rare_tokens, ends, np.array(own, float), size, context)
    base_norm, rare_norm = np.log10(total + 0.5 * (types + 1)), np.log10(rare_tokens + 0.5 * (rare_types + 1))
    n_own, shards = len(own), learning_plan(total)[0]
    shared = spark.sparkContext.broadcast({w: i for i, (w, _) in enumerate(known)})
    log_counts = spark.sparkContext.broadcast(np.log10(np.array([c for _, c in known], float) + 0.5))
    seen_counts = spark.sparkContext.broadcast(np.array([c > 0 for _, c in known], bool))

    def encode(batches):
        """One row a text with what the broadcast words decide and its unit ids, and one for each of its other words."""
        import pyarrow as pa
        from pyspark import TaskContext

        place_of, log_c, is_known, row = shared.value, log_counts.value, seen_counts.value, TaskContext.get().partitionId() << 36
        end_base = np.log10(ends + 0.5) - base_norm
        for batch in batches:
            for at, n, text, place, words in text_words(batch.column(1)):
                ids = batch.column(0).slice(at, n)
                held = np.array([is_held_out(d) for d in ids.to_pylist()], bool)
                spot = np.fromiter((place_of.get(w, -1) for w in words.to_pylist()), np.int64, len(words))[place]
                common = spot >= 0
                where, what = text[common], spot[common]
                base = np.bincount(where, weights=log_c[what] - base_norm, minlength=n) + end_base
                seen = np.bincount(where, weights=is_known[what], minlength=n).astype(np.int64) + int(ends > 0)
                out = what >= n_own
                more = np.bincount(where[out], weights=log_c[what[out]] - rare_norm, minlength=n).astype(float)
                size = np.bincount(text, minlength=n) + 1
                stops = np.cumsum(size)
                units = np.ones(stops[-1], "<u2")
                units[np.arange(len(text)) + text] = np.where(common & (spot < n_own), spot + 2, 0)
                data = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.concatenate(([0], stops)) * 2), pa.py_buffer(units)])
                columns = [np.arange(row, row + n), ids, held, size, seen, base, more, data.cast(pa.binary())]
                nulls = [pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())]
                yield pa.record_batch([*(x if isinstance(x, pa.Array) else pa.array(x) for x in columns), *nulls], names=names)
                code, times = np.unique(text[~common] * len(words) + place[~common], return_counts=True)
                if len(code):
                    k = len(code)
                    empty = [pa.nulls(k, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())]
                    yield pa.record_batch([pa.array(row + code // len(words)), *empty, words.take(pa.array(code % len(words))).cast(pa.string()), pa.array(times)], names=names)
                row += n

    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "more", "ids", "word", "times"]
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, more double, ids binary, word string, times long"
    parts = materialize(rows.mapInArrow(encode, schema), "units")
    texts = parts.where("word is null").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    if total:
        model = learn_model(texts, model, total)
    fitted = spark.sparkContext.broadcast(model)

    def score(batches):
        import pyarrow as pa

        model, natural = fitted.value, np.log(10)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for contexts, units, text in model.pieces([np.frombuffer(x.as_buffer(), "<u2") for x in batch.column(7)], PIECE):
                out += np.bincount(text, weights=model.log_probs(contexts, units) / natural, minlength=len(out))
            yield pa.record_batch([*(batch.column(i) for i in range(6)), pa.array(out + batch.column(6).to_numpy())], names=[*names[:6], "score"])

    scored = parts.where("word is null").select(*names[:8]).mapInArrow(score, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    lifted = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    rest = parts.where("word is not null").select("row", "word", "times").join(counts.select("word", "c"), "word", "left")
    rest = rest.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * (lifted - float(base_norm))).alias("base_rest"),
        F.sum(F.col("times") * (lifted - float(rare_norm))).alias("score_rest"),
    )

    def plus(a: str, b: str) -> Column:
        return F.col(a) + F.coalesce(b, F.lit(0))

    return scored.join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "known").cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), plus("base", "base_rest").alias("base_score"), plus("score", "score_rest").alias("score")
    )
