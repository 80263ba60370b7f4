"""Main text on pages of several layouts, and the n-gram model against plain counting."""

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestack.llm import html_text, ngram
from lodestack.llm.common import checkpoint_dir, checkpointed
from lodestack.llm.elias_fano import EliasFano

LONG = "This paragraph is long enough to count as the text of an article, and it goes on for a while."


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_layouts():
    cases = {
        "": "",
        "plain text &amp; more": "plain text & more",
        f"<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><a href=x>Home</a></nav><aside>Side</aside><article class='post'><header><h1>Head</h1></header><p>{LONG}</p>\n<p>Short</p><form>Mail<input></form><div class='ad-box ad'>Buy</div><p>a<b>b</b>c  d\n e<br>f</p></article><section id=comments><p>{LONG}</p></section><footer>&copy; F</footer></body></html>": f"Head {LONG} Short abc d e f",
        f"<body><div class='cookie-notice'>We use cookies {LONG}</div><main><p>{LONG}</p><article class='comment'>Nice {LONG}</article></main></body>": LONG,
        f"<ul><li><a href=1>One</a><li><a href=2>Two</a></ul><p>{LONG}</p><p>Mid</p><p>{LONG}</p><div class=sidebar>{LONG}</div><script>var a='<p>no</p>'</script><div id='footer'>End</div>": f"{LONG} Mid {LONG}",
        f"<article><p>{LONG}</p><p>cut &am": f"{LONG} cut &am",
        f"<article><p>{LONG}</p><script>if (a < b": LONG,
        f"<article><p>{LONG} 1 < 2</p></arti": f"{LONG} 1 < 2",
        f"<div role=main>{LONG}<!-- <p>hidden</p> --></div><div role='complementary'>{LONG}</div>": LONG,
    }
    for html, want in cases.items():
        assert html_text.main_text(html) == want


def test_names_and_quotes_of_real_pages():
    cases = {
        f"<article><p>Teaser</p></article><div><p>{LONG}</p><p>{LONG}</p><p>Short one</p><p>{LONG}</p></div>": f"{LONG} {LONG} Short one {LONG}",
        f"<article><p>{LONG}</p><section class='review'><p>{LONG} a</p></section><div class='social-history'><p>{LONG} b</p></div><div class='social-links'>Share</div></article>": f"{LONG} {LONG} a {LONG} b",
        f"<article class=review><p>{LONG}</p></article>": LONG,
        **{f"<article><p>{LONG}</p><div class='{name}'>{LONG} no</div></article>": LONG for name in ("google-ads", "widget_recent_entries", "blog-sidebar", "main-nav", "site-footer", "social", "related-posts", "search-form", "legal_notice", "my-newsletter")},
        **{f"<article><p>{LONG}</p><div class='{name}'>{LONG} yes</div></article>": f"{LONG} {LONG} yes" for name in ("legal-history", "form-of-government", "side-effects", "alert-levels", "adventure", "menace", "intro")},
        f"<article><p>{LONG}</p><div class='user-reviews'><article class='review'>{LONG}</article></div></article>": LONG,
        f"<article><p>{LONG} <a href=\"foo>link</a> more</p><p class=\"x\">{LONG}</p></article>": f"{LONG} link more {LONG}",
        f"<article><p title=don't>{LONG}</p><p title=\"it's > that\">{LONG}</p></article>": f"{LONG} {LONG}",
        f"<article><p>{LONG}</p><p class='open>{LONG}": f"{LONG} {LONG}",
    }
    for html, want in cases.items():
        assert html_text.main_text(html) == want


def test_windows_find_the_article_without_its_mark(spark):
    kept = lost = more = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        want, got = (Counter(html_text.main_text(h).split()) for h in (r["html"], re.sub(r"(</?)article\b", r"\1div", r["html"])))
        kept, lost, more = kept + (want & got).total(), lost + (want - got).total(), more + (got - want).total()
    assert kept / (kept + lost) >= 0.95 and kept / (kept + more) >= 0.95


def test_very_long_pages():
    import time

    began = time.time()
    assert html_text.main_text("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>") == " ".join([LONG] * 20_000)
    assert html_text.main_text("<article><p>" + "x" * 2_000_000) == "x" * 2_000_000
    assert html_text.main_text(f"<article><p>{LONG}</p>" + "<a href=\"" * 5_000) == LONG
    assert html_text.main_text("<div>" * 20_000 + f"<p>{LONG}</p>") == LONG
    assert time.time() - began < 120


def test_windows_decide_on_marked_pages():
    body = f"<div><p>{LONG * 5}</p><p>{LONG * 6}</p></div>"
    assert html_text.main_text(f"<main><h1>Head</h1></main>{body}") == f"Head {LONG * 5} {LONG * 6}"  # the mark misses the body
    lists = "<ul><li>one</li><li>two</li><li>three</li><li>four</li></ul>"
    assert html_text.main_text(f"<div>Tagline</div><article>{lists}<p>{LONG}</p>{lists}</article><div>Tagline</div>") == f"one two three four {LONG} one two three four"
    beside = "<div>Up</div><div>Down</div><div>Left</div>"
    assert html_text.main_text(f"<article><p>{LONG}</p></article>{beside}<article>Tiny</article>{beside}") == LONG  # past the dive point


def test_pages_query(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r["page_id"]: r for r in rows(html_text.extract(pages))}
    for r in rows(pages):
        body = r["html"].split("<article>")[1].split("</article>")[0]
        parts = re.split(r"</?(?:p|h1|br)>", body if "</article>" in r["html"] else re.sub(r"<[^<]*$", "", body))
        want = " ".join(x for x in (" ".join(html_text.unescape(re.sub("</?b>", "", p)).split()) for p in parts) if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)
    odd = spark.createDataFrame([(1, "u", None, 5), (None, None, "", 5), (1, "u", None, 5)], "page_id long, url string, html string, text long").selectExpr("*", "text n_chars", "text _1", "url as doc_id")
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in rows(html_text.extract(odd))) == [("1", "", 0), ("1", "", 0), ("None", "", 0)]
    assert rows(html_text.extract(odd.limit(0))) == []


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) + [None]


def brute_scores(table, order):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    train = [["\n", *tokens(r["text"])] for r in table if not held(r["doc_id"])]
    c = {k: Counter(tuple(d[i : i + k]) for d in train for i in range(len(d) - k + 1)) for k in range(1, order + 1)}
    marks = c[1].pop(("\n",), 0)
    n, v = sum(c[1].values()), len(c[1])

    def p(h, w):
        if not h:
            return (c[1][(w,)] + 0.1) / (n + 0.1 * (v + 1))
        seen, shorter = (marks if h == ("\n",) else c[len(h)][h]), p(h[1:], w)
        m = ngram.prior(np.array([float(seen)]), len(h) + 1)[0]
        return (c[len(h) + 1][(*h, w)] + m * shorter) / (seen + m) if seen else shorter

    for r in table:
        d = ["\n", *tokens(r["text"])]
        score = sum(math.log10(p(tuple(d[max(0, i - order + 1) : i]), d[i])) for i in range(1, len(d)))
        yield str(r["doc_id"]), held(r["doc_id"]), len(d) - 1, sum(c[1][(w,)] > 0 for w in d[1:]), n, sum(math.log10(p((), w)) for w in d[1:]), score


@pytest.mark.parametrize("order", [2, 3, 4])
def test_ngram_scores(spark, documents, odd, nothing, order, monkeypatch):
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for docs, shard, buffer in ((documents, 3_000_000, 2_000_000), (documents, 4000, 7000), (odd, 3_000_000, 2_000_000)):
        monkeypatch.setattr(ngram, "SHARD_TOKENS", shard)
        for size in ("BUFFER", "SCORED", "BLOCK"):
            monkeypatch.setattr(ngram, size, buffer)
        got = sorted((str(r["doc_id"]), *(r[k] for k in names[1:])) for r in rows(ngram.scores(docs, order=order)))
        for a, b in zip(got, sorted(brute_scores(rows(docs), order)), strict=True):
            assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) and abs(a[6] - b[6]) < 1e-3 * b[2]
    assert rows(ngram.scores(nothing, order=order)) == []


def test_longer_contexts_score_better(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    total = {order: sum(r["score"] for r in rows(ngram.scores(docs, order=order)) if r["held_out"]) for order in (2, 3)}
    base = sum(r["base_score"] for r in rows(ngram.scores(docs)) if r["held_out"])
    assert base < total[2] < total[3]


def test_trie_files_and_their_folder(spark, documents, tmp_path):
    trie = ngram.Trie(str(tmp_path), 3)
    training = documents.select("doc_id", "text").where("text is not null")
    read = checkpointed(ngram.blocks(training, 1 << 40))
    ngram.build_words(read, trie)
    ids = checkpointed(ngram.encoded(read, trie))
    for k in (2, 3):
        ngram.build_level(ids, trie, k)
    for k in (2, 3):
        for s in range(trie.shards[k]):
            nodes = ngram.Nodes(f"{tmp_path}/level{k}-{s}")
            contexts = nodes.contexts.n
            first, end = nodes.children.bucket(np.arange(contexts))
            assert first[0] == 0 and end[-1] == nodes.children.n and (first[1:] == end[:-1]).all() and (end > first).all()
            assert nodes.children.bits / nodes.children.n < nodes.children.low + 3 and nodes.children.low == trie.low
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    scored = ngram.scores(documents)
    assert not [x for x in set(os.listdir(folder)) - before if x.startswith("ngram-")] and scored.count() == documents.count()


def test_elias_fano():
    rng = np.random.default_rng(3)
    for high in (1, 10, 1 << 20, 1 << 63):
        for n in (0, 1, 2, 500, 100_000):
            values = np.unique(rng.integers(0, high, n, dtype=np.uint64))
            ef = EliasFano(EliasFano.build(values))
            asked = np.concatenate([values, rng.integers(0, high, 300, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
            place, found = ef.successor(asked)
            assert place.tolist() == np.searchsorted(values, asked).tolist() and found.tolist() == np.isin(asked, values).tolist()
            if len(values) > 1000:
                assert ef.bits / len(values) < ef.low + 3  # 64 bits each as they come
    runs = np.concatenate([np.arange(70_000, dtype=np.uint64), np.array([1 << 40, (1 << 40) + 5], np.uint64)])  # one bucket has nearly all
    ef = EliasFano(EliasFano.build(runs, 20))
    assert ef.successor(runs)[0].tolist() == list(range(len(runs))) and ef.successor(runs + np.uint64(1))[0].tolist() == np.searchsorted(runs, runs + np.uint64(1)).tolist()


def test_columns_and_spread():
    rng = np.random.default_rng(4)
    values = np.sort(rng.integers(0, 1 << 32, 1000).astype("<u4"))
    assert ngram.unpack(ngram.pack(values, True), "<u4", True).tolist() == ngram.unpack(ngram.pack(values, False), "<u4", False).tolist() == values.tolist()
    n = np.array([0, 1, 32_767, 32_768, 100_000, 10**9, 10**12])
    assert np.abs(ngram.decoded(ngram.log_codes(n)) - n).max() <= 1e-3 * 10**12 and ngram.decoded(ngram.log_codes(n))[:4].tolist() == [0, 1, 32_767, 32_768]
    one = ngram.spread(np.full(10_000, 7 << 30, np.uint64), np.arange(10_000), 80)
    assert len(np.unique(one)) == 10 and np.bincount(one).max() < 1200
