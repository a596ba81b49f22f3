"""Page parsing in linear time, comments by structure, ratios against an independent version; severity against a plain fit."""

import math
import time
import tracemalloc
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartwright.llm import html, toxicity

DATA = "/root/testdata/sf0.001"
PROSE = "Prose goes on, as it does here. " * 15
BYLINE = "<div class=item><span class=author>Al {0}</span><time>1 May</time><p>I do think so, really, and more of it. {0}</p></div>"


def thread(name, entry=BYLINE, n=3):
    return f"<div class='{name}'>" + "".join(entry.format(i) for i in range(n)) + "</div>"


@pytest.mark.parametrize("page", [
    "<div>" * 20_000, "<font>" * 20_000, "<b a='" * 20_000, "<b '>'" * 20_000, "<" * 100_000, "<ul>" + "<div><li>" * 20_000, "<!x" * 40_000, "<a href=x>t" * 20_000, "<div>word, x. " * 20_000,
    "".join(f"<div class=c{i}>t. " for i in range(20_000)), "<p>" + "<script>" * 20_000, "<b a=\"'" * 20_000 + ">",
], ids=range(12))
def test_odd_pages_take_linear_time(page):
    began = time.time()
    html.main_text(page)
    assert time.time() - began < 2.5
    tracemalloc.start()
    html.main_text(page[: len(page) // 8])
    assert tracemalloc.get_traced_memory()[1] < 25e6
    tracemalloc.stop()


def test_scanner_reads_tags_and_quotes():
    def tags(page):
        scanner, at, out = html._Scanner(page), 0, []
        while found := scanner.next(at):
            out.append(found[2:])
            at = found[1]
        return out

    assert tags("<a href='x>y'>t</a><br/><!-- <b> --><!x><?y>") == [("", "a", " href='x>y'"), ("/", "a", ""), ("", "br", "/"), ("", "", ""), ("", "", ""), ("", "", "")]
    assert tags("<b a='>x</b>") == [("", "b", " a='"), ("/", "b", "")]  # an open quote doesn't swallow the page
    assert tags("1 < 2 <3> <b") == [] and tags("<!-- no end <b>") == [("", "", "")]


def test_chapters_stay_and_threads_go():
    paper = f"<article><h1>Paper</h1><p>{PROSE}</p><section id='NAME'><h2>Discussion</h2><p>{PROSE}</p></section></article>"
    for name in ("discussion", "responses", "response", "forum"):
        assert html.main_text(paper.replace("NAME", name)).count("Prose") == 30, name
    for found in (thread("responses"), thread("x1"), thread("discussion", BYLINE.replace("<span class=author>", "<span>")), thread("x2", BYLINE.replace("div", "article")), thread("comments"), f"<section id=comments><p>{PROSE}</p></section>"):
        for page in (f"<body><article><h1>T</h1><p>{PROSE}</p>{found}</article></body>", f"<body><div class=post><h1>T</h1><p>{PROSE}</p></div>{found}</body>"):
            assert html.main_text(page) == "T " + PROSE.strip(), found
    dated = "<ul class=timeline>" + "".join(f"<li><time>19{i}</time><p>Something happened then, as told. {i}</p></li>" for i in range(10, 20)) + "</ul>"
    assert html.main_text(f"<article><h1>T</h1><p>{PROSE}</p>{dated}</article>").count("happened") == 10  # events have no writers
    assert html.main_text(f"<body><main>{thread('posts', BYLINE.replace('I do think so, really, and more of it.', PROSE))}</main></body>").count("Prose") == 45  # the page is its entries


class Plain(HTMLParser):
    """Blocks of a well-formed page of div, p, h1 and a, by the library's parser."""

    def __init__(self):
        super().__init__()
        self.path, self.blocks, self.text, self.linked, self.a = [], [], [], 0, 0

    def cut(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((tuple(self.path), text, self.linked))
        self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.a += 1
            return
        self.cut()
        name = dict(attrs).get("class")
        self.path.append(f"{tag}.{name}" if name else tag)

    def handle_endtag(self, tag):
        if tag == "a":
            self.a -= 1
            return
        self.cut()
        self.path.pop()

    def handle_data(self, data):
        self.text.append(data)
        self.linked += len(data.strip()) if self.a else 0


def plain_ratios(blocks):
    """Fused ratios of paths: means by path, smoothed over the blocks, multiplied, averaged by path, times log of its text."""
    def smooth(v):
        out = []
        for i in range(len(v)):
            near = [(math.exp(-0.5 * d * d), v[i + d]) for d in range(-2, 3) if 0 <= i + d < len(v)]
            out.append(math.sqrt(v[i] * sum(k * x for k, x in near) / sum(k for k, _ in near)))
        return out

    by_path = {}
    for path, text, linked in blocks:
        own = max(0, len(text) - linked)
        by_path.setdefault(path, []).append((own, sum(c in ".,;:!?" for c in text) * own / len(text)))
    mean = {p: np.mean(v, axis=0) for p, v in by_path.items()}
    size, marks = smooth([mean[p][0] for p, _, _ in blocks]), smooth([mean[p][1] for p, _, _ in blocks])
    fused = {}
    for (p, _, _), s, m in zip(blocks, size, marks):
        fused.setdefault(p, []).append(s * (1 + m))
    return {p: np.mean(v) * math.log1p(sum(x for x, _ in by_path[p])) for p, v in fused.items()}


def test_ratios_are_those_of_an_independent_version():
    rng = np.random.default_rng(6)
    for _ in range(20):
        part = lambda: " ".join(rng.choice(["word", "more,", "end.", "a <a>link here</a>", "x &amp; y"], int(rng.integers(1, 30))))  # noqa: E731, B023
        page = "<div>" + "".join(f"<div class=c{rng.integers(3)}><h1>{part()}</h1><p>{part()}</p><p>{part()}</p></div>" for _ in range(int(rng.integers(1, 9)))) + "</div>"
        plain = Plain()
        plain.feed(page)
        plain.cut()
        blocks, paths = html.text_blocks(page)
        assert [(b.text, b.linked) for b in blocks] == [(t, n) for _, t, n in plain.blocks]
        own = {}
        for b, (path, _, _) in zip(blocks, plain.blocks):
            own[b.path] = path
        got, want = html.path_scores(blocks), plain_ratios(plain.blocks)
        assert {own[p]: pytest.approx(v) for p, v in got.items()} == want


def test_repeated_ids_are_one_labelled_row(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    least = labels.where("toxic is not null").agg(F.min("doc_id")).first()[0]
    many = spark.range(100_000).select(F.lit(least).alias("doc_id"), F.lit("zz again").alias("text"))
    plain, known = (toxicity.labelled_words(d, labels, "toxic") for d in (docs, docs.unionByName(many)))
    assert known.count() == plain.count() > 50
    assert known.where("array_contains(words, 'zz')").count() == 0 or docs.where(f"doc_id = {least} and text < 'zz again'").count() == 0


def test_severity_is_that_of_a_plain_fit():
    """The penalised likelihood written out row by row and maximised by Newton's method with numeric derivatives."""
    rng = np.random.default_rng(12)
    m, n, penalty = 4, 160, 1e-2
    counts = rng.poisson(0.8, (n, m))
    grades = np.digitize(np.log1p(counts) @ np.array([2.0, 1.0, -1.0, 0.0]) + rng.logistic(size=n), [1.0, 2.5])
    data = toxicity.SparseRows([([f"w{j}" for j in range(m) if r[j]], [int(r[j]) for j in range(m) if r[j]]) for r in counts], [f"w{j}" for j in range(m)])
    model = toxicity.OrdinalModel.fit(data, grades, penalty)
    x = np.log1p(counts)

    def loss(p):
        cuts = [p[m], p[m] + math.exp(p[m + 1])]
        total = 0.0
        for row, g in zip(x, grades):
            up = [1.0, *[1 / (1 + math.exp(c - float(row @ p[:m]))) for c in cuts], 0.0]
            total -= math.log(up[g] - up[g + 1])
        return total / n + penalty / 2 * float(p[:m] @ p[:m])

    p, h, eye = np.array([0.0] * m + [1.0, 0.0]), 1e-4, np.eye(m + 2)
    for _ in range(12):
        grad = np.array([(loss(p + h * e) - loss(p - h * e)) / (2 * h) for e in eye])
        hess = np.array([[(loss(p + h * (a + b)) - loss(p + h * (a - b)) - loss(p - h * (a - b)) + loss(p - h * (a + b))) / (4 * h * h) for b in eye] for a in eye])
        p = p - np.linalg.solve(hess + 1e-9 * np.eye(m + 2), grad)
    cuts = [p[m], p[m] + math.exp(p[m + 1])]
    for row in counts[:40]:
        text = " ".join(" ".join([f"w{j}"] * int(k)) for j, k in enumerate(row))
        want = [1 / (1 + math.exp(c - float(np.log1p(row) @ p[:m]))) for c in cuts]
        assert model.at_least(text) == pytest.approx(want, abs=0.02)
