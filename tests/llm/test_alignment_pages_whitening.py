"""Token alignment, main text of pages and whitening against brute force, odd rows included."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cabledger.llm import main_text, queries, token_alignment, whitening
from llm_fixtures import SF, docs_of, documents  # noqa: F401

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "plain words", "plain words", "Héllo 漢😀 wörld  two\n\ttab <|endoftext|> <s> ﬁ é ①", "▁under▁bar", "\0nul",
         "😀" * 300 + "漢字仮名" * 50, " " * 500 + "x", "a" * 3000, "trailing  ", "é é", "ab\r\ncd", "AbC d漢 " * 20_000]


# -- Alignment

def brute_align(rows):
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    letters, spare = {}, 256
    for b in range(256):
        if chr(b).isprintable() and b > 32 and b != 0xAD:
            letters[chr(b)] = b
    for b in range(256):
        if b not in letters.values():
            letters[chr(spare)] = b
            spare += 1
    docs = []
    for i, text in rows:
        groups = []
        if text:
            a = one.encode(" " + text, add_special_tokens=False)
            xs = [(k, bytes(letters[c] for c in t)) for k, t in zip(a.ids, a.tokens)]
            ys = [(k, bytes([int(two.id_to_piece(k)[3:5], 16)]) if two.is_byte(k) else two.id_to_piece(k).replace("▁", " ").encode())
                  for k in two.encode(text)]
            whole = (" " + text).encode()
            if b"".join(b for _, b in xs) == whole == b"".join(b for _, b in ys):
                p = q = 0
                left, right = [], []
                xs, ys = xs[::-1], ys[::-1]
                while xs or ys:
                    if p <= q:
                        k, b = xs.pop()
                        left.append(k)
                        p += len(b)
                    else:
                        k, b = ys.pop()
                        right.append(k)
                        q += len(b)
                    if p == q:
                        groups.append((left, right))
                        left, right = [], []
        docs.append((i, groups, Counter((x, y) for l, r in groups for x in l for y in r)))
    count = Counter(p for _, _, links in docs for p in links)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    for i, groups, links in docs:
        yield (i, sum(len(l) for l, _ in groups), sum(len(r) for _, r in groups), len(groups), sum(links.values()),
               ";".join(",".join(map(str, l)) + "|" + ",".join(map(str, r)) for l, r in groups),
               sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items()))


@pytest.mark.parametrize("head", [token_alignment.HEAD, 300, 0])
def test_alignment_equals_brute_force(docs_of, head, monkeypatch):
    for name, value in () if head > 300 else (("WIDE", 20), ("REMEMBERED", 7), ("ROW_CHARS", 50), ("SLICE_CHARS", 200)):
        monkeypatch.setattr(token_alignment, name, value)
    rows = [*enumerate(TEXTS), (None, "a null id"), (3, "plain words")]
    docs = docs_of(rows).withColumns({"row": F.lit(1), "n_a": F.lit("x"), "codes": F.lit(None).cast("string")})
    got = token_alignment.align(docs, A, B, head=head)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_align(rows), key=repr)
    assert token_alignment.align(docs.limit(0), A, B).count() == 0


def test_segments_equal_whole_texts():
    rng = random.Random(6)
    pool = list("aZ é漢😀.;'\"){}1\r\n\t  \u00a0\u3000\x1c\x85\u2028") + ["the", "'s", " and", "   ", "\r\n", "<s>", "▁"]
    cut, whole = token_alignment.Aligner(A, B), token_alignment.Aligner(A, B)
    assert cut.segments
    whole.segments = False
    texts = ["".join(rng.choices(pool, k=rng.randint(1, 40))) for _ in range(3000)]
    for x, y, t in zip(cut.align(texts), whole.align(texts), texts):
        assert x[:5] == y[:5] and all((i == j).all() for i, j in zip(x[5:], y[5:])), repr(t)


def test_registered_alignment(spark, documents):
    want = sorted(brute_align([tuple(r) for r in documents.collect()]))
    got = queries.op11_token_alignment(spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    digest = lambda g: g and hashlib.sha256(g.encode()).hexdigest()
    assert sorted(map(tuple, got.collect())) == [(*w[:5], digest(w[5]), *w[6:]) for w in want]


# -- Pages

def test_best_region_equals_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        scores = [rng.choice([-3, -1, -0.5, 0, 1, 2]) for _ in range(rng.randint(0, 25))]
        a, b = main_text.best_region(scores)
        most = max((sum(scores[i:j]) for i in range(len(scores) + 1) for j in range(i, len(scores) + 1)))
        assert sum(scores[a:b]) == most and (most > 0 or a == b)


def plain_article(page):
    """The text of the only article of a generated page."""
    inner = re.search("<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split("</?(?:p|h1)>", inner.replace("<br>", " "))
    texts = (" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_registered_main_text(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op12_main_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain_article(pages[r.page_id].html), len(r.text))


def test_unmarked_pages(spark):
    """Held out: pages whose article and other parts lost their marks."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    costs = main_text.learn(pages[::2])
    right = 0
    for page in pages[1::2]:
        want = plain_article(page)
        soup = re.sub("<(article|nav|footer|div class=\"ad\")>", "<div>", page)
        soup = re.sub("</(article|nav|footer)>", "</div>", soup)
        right += main_text.main_text(soup, costs) == want
        assert main_text.main_text(re.sub("(</?)article>", r"\1div>", page), costs) == want
    assert right >= 0.95 * len(pages[1::2])


RICH = """<html><head><title>No</title></head><body class="has-sidebar menu-open"><header><h1>Site name of no use</h1></header>
<div class="cookie-notice">We use cookies, do you mind them at all?</div><div class="main-menu"><a href=x>Home</a> <a href=y>News</a></div>
<form><label>Search</label><input><button>Go now</button></form>
<main><article class="post-12"><header><h2>Title &amp; more</h2></header><p>First <i>par</i>a<b>graph</b>,&nbsp; with
 <a href="a>b">a link</a>.<p class="lead">Second &lt;tag&gt; &amp;amp; x<ul><li>one<li>two</ul><script>if (a < b) { nothing("</p>") }</script>
<div class='ad-slot'>Buy our things today and tomorrow</div><table><tr><td>cell a<td>cell b</table><!-- <p>gone</p> -->
<aside>Beside the point, as it were</aside><pre>x  &#x27; y</pre><p>End<p style="display:none">unseen</p></article>
<section id="comments"><article><p>I disagree with all of this, and I have many more words than the writer had, at length, again and again, and
then some more, so that comments outweigh everything else in this page by far.</p></article></section></main>
<div id="sidebar"><p>Most read: a, b, c, d, e, f, g, h</p></div><footer>Imprint and so on</footer></body></html>"""
RICH_TEXT = "Title & more\nFirst paragraph, with a link.\nSecond <tag> &amp; x\none\ntwo\ncell a\ncell b\nx ' y\nEnd"


def test_parts_left_out(spark):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    for costs in (main_text.learn(pages), main_text.Costs()):
        assert main_text.main_text(RICH, costs) == RICH_TEXT
        body = RICH.split("</header>", 1)[1]
        for cut in ("<main>", "</main>"):
            body = body.replace(cut, "")
        assert main_text.main_text(body, costs) == RICH_TEXT
        assert main_text.main_text("<nav>a b c</nav><footer>d e f</footer>", costs) == ""
        assert main_text.main_text("just words < here > and there", costs) == "just words < here > and there"


def test_odd_pages(spark):
    html = [None, "", " \n ", "<", "<>", "</", "<p", "<!--", "<p>x", "a<b", "<script>never shut", "<p>" * 5000 + "deep", "<div>" * 50_000 + "x",
            "<a \"" * 50_000, "<a x=\"" * 50_000, "<!--" * 50_000, "</div>" * 50_000, "&amp;&#0;&#xD800;&bogus;", "<article>a<article>b</article></article>"]
    rows = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(html)] + [(None, None, "<p>x")], "page_id bigint, url string, html string")
    rows = rows.withColumns({"text": F.lit(1), "_0": F.lit(2), "n_chars": F.lit("x")})
    began = time.time()
    got = {r.id: r for r in main_text.extract(rows).collect()}
    assert time.time() - began < 60
    assert len(got) == len(html) + 1 and got[None].url is None and got[None].text == "x"
    assert [got[i].text for i in (0, 1, 2, 8, 9)] == ["", "", "", "x", "a"]
    assert got[18].text == "a\nb" and all(len(r.text) == r.n_chars for r in got.values())
    assert main_text.extract(rows.limit(0)).count() == 0


# -- Whitening

def brute_whiten(rows, k=32):
    """{id: (n, deviation, whitened per component)}, shares, for rows of one length."""
    x = np.array([[int(np.floor(float(c) * 64)) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(0)
    centred = np.array((n * x - s) / n, dtype=float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:k]
    white = centred @ vectors[:, order] / np.sqrt(values[order])
    return [(i, n, int(((n * row - s) ** 2).sum()), w) for (i, _), row, w in zip(rows, x, white)], values[order] / values.sum()


def check_whitened(got, want, shares):
    by_row = defaultdict(list)
    for r in got:
        by_row[r.id].append(r)
    assert len(got) == sum(len(w[3]) for w in want) and len({r.identity_error for r in got}) == 1
    assert all(r.identity_error <= 1e-8 for r in got)
    sign = None
    for i, n, deviation, white in want:
        mine = sorted(by_row[i], key=lambda r: r.component)[:len(white)]
        assert [r.component for r in mine] == list(range(1, len(white) + 1)) and {(r.n, r.deviation) for r in mine} == {(n, deviation)}
        found = np.array([r.whitened for r in mine])
        sign = np.sign(found * white) if sign is None else sign
        assert np.allclose(found, white * sign, rtol=1e-6, atol=1e-6) and np.allclose([r.explained for r in mine], shares)


def test_registered_whitening(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op13_whitening(spark, SF).withColumnRenamed("vec_id", "id").collect()
    check_whitened(got, *brute_whiten(rows))


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 8)
    monkeypatch.setattr(whitening, "BLOCKS_A_TASK", 2)
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(60)]
    odd = [(100, None), (101, []), (102, [1.0] * 4), (103, [None] + [1.0] * 4), (104, [float("nan")] + [1.0] * 4), (105, [float("inf")] * 5)]
    frame = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").repartition(5).withColumns(
        {"n": F.lit("x"), "block": F.lit(1), "m": F.lit(2)})
    check_whitened(whitening.whiten(frame).collect(), *brute_whiten(rows))
    assert whitening.whiten(frame.limit(0)).count() == 0 and whitening.whiten(frame.filter("vec_id = 104")).count() == 0
    same = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    flat = whitening.whiten(same).collect()
    assert len(flat) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in flat} == {(3, 0, None, None, 0.0)}
    line = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "vec_id bigint, embedding array<double>")
    assert {(r.component, r.whitened is None) for r in whitening.whiten(line).collect()} == {(1, False), (2, True)}
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])], "vec_id bigint, embedding array<double>")
    first = whitening.whiten(huge).filter("component = 1").collect()
    assert {r.id: r.deviation for r in first} == {1: None, 2: None, 3: 64 ** 2 * 3 ** 2} and all(r.whitened is not None for r in first)
