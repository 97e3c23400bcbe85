"""Each operator against a brute-force version, a round trip or held-out accuracy, and on odd input."""

import collections
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarry.llm import binary_output, decontaminate, exact_dedup, html_extract, license_scan, near_dedup, packing, quality, token_counts, toxicity
from quarry.llm.common import KeyFilter, materialize
from quarry.llm.words import hash_words, shingles

SCHEMA = "doc_id long, text string, lang string, source string, row string, id string, spans string"
ODD = [(None, "null id"), (1, None), (2, ""), (3, " \n\t "), (4, "x" * 70_000), (5, "same text"), (5, "same text"), (6, "SAME text"), (7, "日本語 \x1c ß"), (8, "w " * 30_000), (9, "a <|endoftext|> b<|startoftext|>")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "r", "i", "p") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


def rand_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- token counts ---------------------------------------------------------------------


def greedy(s, pieces):
    n = 0
    while s:
        k = next((k for k in range(len(s), 0, -1) if s[:k] in pieces), 0)
        if not k:
            return -1
        s, n = s[k:], n + 1
    return n


def test_longest_match_counts_equal_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        pieces = {"▁"[: rng.randrange(2)] + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(3, 25))} | {"▁"}
        a = token_counts.Automaton(sorted(pieces))
        for _ in range(100):
            s = "▁" + "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 10)))
            assert a.count(s) == greedy(s, pieces)


def test_vocabularies_that_begin_alike_do_not_share_counts(spark):
    begin = ["▁", *(chr(0x4E00 + k) for k in range(70))]
    d = frame(spark, [(1, "ab ab")])
    of = lambda pieces: d.select(token_counts.token_counts(F.col("text"), begin + pieces).alias("c")).first().c.n_tokens
    assert of(["▁ab", "a"]) == 2 and of(["a", "b"]) == 6


def test_token_counts_on_odd_rows(spark, odd):
    got = token_counts.count_documents(odd, public_tokenizers.path("piece_bpe_32k.model"))
    rows = got.collect()
    assert len(rows) == len(ODD) and got.columns == ["doc_id", "n_words", "n_tokens", "n_unknown"]
    assert {(r.n_words, r.n_tokens) for r in rows if r.doc_id in (1, 2, 3)} == {(0, 0)}
    assert next(r.n_words for r in rows if r.doc_id == 8) == 30_000
    assert token_counts.count_documents(odd.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_pieces_of_a_long_text_cut_no_word(monkeypatch):
    rng = random.Random(47)
    text = "".join(rng.choice("ab é,\n\u2003") for _ in range(5000)) + "z" * 400
    want = token_counts._WORDS.findall(text)
    for piece in (1, 7, 333, 10_000):
        monkeypatch.setattr(token_counts, "PIECE", piece)
        assert [w for part in token_counts._pieces(text) for w in token_counts._WORDS.findall(part)] == want
        assert "".join(token_counts._pieces(text)) == text


# --- decontamination ------------------------------------------------------------------


def smith_waterman(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, n))] for n in (12, 25))
        score, lo, hi = decontaminate.align(np.array(a), np.array(b))
        assert score == smith_waterman(a, b)
        assert not score or smith_waterman(a, b[lo:hi]) == score
    several = [([rng.randrange(4) for _ in range(rng.randrange(1, 15))], [rng.randrange(4) for _ in range(rng.randrange(1, 30))]) for _ in range(50)]
    together = decontaminate.align_all([np.array(a, dtype=np.uint64) for a, _ in several], [np.array(b, dtype=np.uint64) for _, b in several])
    assert together == [decontaminate.align(np.array(a), np.array(b)) for a, b in several]


def zipf(rng, n, vocabulary):
    """Text as it is used: few words make up most of it."""
    return " ".join(f"w{int(len(vocabulary) ** rng.random())}" for _ in range(n))


@pytest.mark.parametrize("edit", [3, 4, 5, "added"])
def test_dense_edits_are_found_in_natural_text(spark, edit):
    rng = random.Random(23)
    vocabulary = range(20_000)
    items = [(k, zipf(rng, 40, vocabulary)) for k in range(150)]
    docs = [(k, zipf(rng, 400, vocabulary)) for k in range(300)]
    for k, text in items[:40]:
        words = text.split()
        if edit == "added":
            words = [x for j, w in enumerate(words) for x in ([w, f"new{j}"] if j % 4 == 3 else [w])]
        else:
            words = [f"new{j}" if j % edit == k % edit else w for j, w in enumerate(words)]
        docs.append((1000 + k, f"{zipf(rng, 100, vocabulary)} {' '.join(words)} {zipf(rng, 100, vocabulary)}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(frame(spark, docs), bench).collect()}
    of = {i: t.lower().split() for i, t in items}
    want = {(1000 + k, k) for k in range(40) if smith_waterman(of[k], dict(docs)[1000 + k].split()) >= len(of[k])}
    assert len(want) >= 25 and len(got & want) >= 0.95 * len(want) and {d for d, _ in got} <= set(range(1000, 1040))


def test_frequent_pairs_cost_no_meetings():
    rng = np.random.default_rng(29)
    p = 1 / np.arange(1, 5001)
    text = lambda n: " ".join(f"w{k}" for k in rng.choice(5000, n, p=p / p.sum()))
    items = decontaminate.Items(list(range(400)), [text(40) for _ in range(400)])
    words = hash_words([text(400) for _ in range(400)])
    hashes, doc, _ = decontaminate._document_pairs(words)
    at, number, _ = decontaminate.Members(items.different).find(hashes)
    holding = np.bincount(np.unique(doc[at] * len(items.different) + number) % len(items.different), minlength=len(items.different))
    seeds = items.seeds(holding, 400)
    df = dict(zip(items.different.tolist(), holding.tolist(), strict=True))
    often = [h for h in seeds.hashes.tolist() if df[h] > decontaminate.FREQUENT_DOCUMENTS]
    assert min(df[h] for h in seeds.hashes.tolist()) > 0 and len(often) < 0.1 * len(seeds.hashes)
    leaked = items.seeds(np.full_like(holding, 300), 400)  # all pairs are frequent
    assert (np.bincount(leaked.item, minlength=400) == decontaminate.LEAST_SEEDS).all()
    assert sum(1 for _ in decontaminate._stretches(seeds, words)) < 0.02 * 400 * 400  # of all pairs of documents and items


def test_a_long_text_of_many_copies(spark):
    rng = random.Random(31)
    item = rand_text(rng, 40, 3000)
    docs = [(1, " ".join([item, rand_text(rng, 5, 3000)] * 4000)), (2, rand_text(rng, 200_000, 3000) + " " + item)]
    got = decontaminate.contamination(frame(spark, docs), spark.createDataFrame([(1, item), (2, rand_text(rng, 40, 3000))], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.score) for r in got} == {(1, 1, 1.0), (2, 1, 1.0)}
    assert next(r.start_word for r in got if r.doc_id == 2) == 200_000


def test_leaks_are_found_and_clean_documents_left(spark):
    rng = random.Random(7)
    items = [(k, rand_text(rng, 40, 3000)) for k in range(12)]
    edited = items[3][1].split()
    for k in range(4, 40, 7):
        edited[k] = "changed"
    docs = [(k, rand_text(rng, 300, 3000)) for k in range(40)]
    docs += [(100 + k, f"{rand_text(rng, 50, 3000)} {items[1][1]} {rand_text(rng, 90, 3000)}") for k in range(30)]  # a frequent leak keeps its seeds
    docs += [(200, rand_text(rng, 100, 3000) + " " + " ".join(edited) + "."), (201, items[2][1].upper()), (202, None), (203, "")]
    items += [(50, None), (51, ""), (1, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(frame(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(100 + k, 1) for k in range(30)} | {(200, 3), (201, 2)}
    assert all(r.score == 1 for r in got if r.doc_id != 200) and len(got) == 62  # the repeated item gives its own hits


@pytest.mark.parametrize("verbatim", [0, 20])
def test_edited_leaks_are_found(spark, verbatim):
    rng = random.Random(11)
    items = [(k, rand_text(rng, n, 3000)) for k, n in enumerate((16, 25, 40, 55) * 6)]
    docs, want = [], set()
    for k, text in items:
        for step in (3, 4, 5, 6):
            edited = text.split()
            for at in range(rng.randrange(step), len(edited), step):
                edited[at] = f"changed{rng.randrange(10**6)}"
            if smith_waterman(text.split(), edited) >= len(edited):  # half of the score of a perfect copy
                want.add((len(docs), k))
            docs.append((len(docs), f"{rand_text(rng, 60, 3000)} {' '.join(edited)} {rand_text(rng, 60, 3000)}"))
    assert len(want) > 60
    for k, text in items:
        for _ in range(verbatim):
            want.add((len(docs), k))
            docs.append((len(docs), f"{rand_text(rng, 30, 3000)} {text} {rand_text(rng, 30, 3000)}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contamination(frame(spark, docs), bench).collect()} == want


def test_long_passages_of_longer_items_are_found(spark):
    rng = random.Random(17)
    items = [(k, rand_text(rng, n, 3000)) for k, n in enumerate((200, 200, 1000, 200, 60))]
    part = lambda k, a, b: " ".join(items[k][1].split()[a:b])
    docs = [(k, f"{rand_text(rng, 80, 3000)} {p} {rand_text(rng, 80, 3000)}") for k, p in enumerate([part(0, 70, 160), part(1, 0, 52), part(2, 940, 1000), part(3, 20, 60), part(4, 0, 25)])]
    got = decontaminate.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 0), (1, 1), (2, 2)}
    assert next(r.score for r in got if r.doc_id == 0) == pytest.approx(0.45, abs=0.03)


def test_contamination_on_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "same text"), (2, None)], "item_id long, text string")
    got = decontaminate.contamination(odd, bench).collect()
    assert sorted(r.doc_id for r in got) == [5, 5, 6]
    assert decontaminate.contamination(odd, bench.limit(0)).count() == 0


# --- HTML -----------------------------------------------------------------------------

TREE = html_extract.train_tree()
PLAIN = [" ".join(f"word{k}" for k in range(a, a + 60)) for a in (0, 100)]


@pytest.mark.parametrize(
    "begin,end",
    [
        ('<article class="category-social-media">', "</article>"),
        ('<article class="post tag-advertising hentry">', "</article>"),
        ('<article class="newsletter cookies">', "</article>"),
        ('<div class="post category-promotions">', "</div>"),
        ('<main><section class="privacy-notice">', "</section></main>"),
        ('<div id="menu-content">', "</div>"),
        ('<form id="aspnetForm" action="x"><input type="hidden" value="y"><div id="main"><article>', "</article></div></form>"),
        ("<form><div>", f"<p>{PLAIN[0]}</p></div></form>"),
        ('<div class="social"><div>', "</div></div>"),
    ],
)
def test_a_topic_or_a_wrapper_does_not_hide_the_article(begin, end):
    menu = '<nav><a href="/">Home</a> <a href="/x">More</a></nav>'
    third = f" {PLAIN[0]}" if "<p>" in end else ""
    for page in (f"{begin}<p>{PLAIN[0]}</p><p>{PLAIN[1]}</p>{end}", f"<body>{menu}{begin}<p>{PLAIN[0]}</p><p>{PLAIN[1]}</p>{end}<footer>All rights</footer></body>"):
        assert html_extract.main_text(page, TREE) == f"{PLAIN[0]} {PLAIN[1]}{third}"


@pytest.mark.parametrize(
    "other",
    [
        f'<section class="comments"><p>{PLAIN[1]}</p><p>{PLAIN[1]}</p><p>{PLAIN[1]}</p></section>',
        f'<div id="cookie-notice"><p>{PLAIN[1]}</p></div>',
        f'<form><p>Name</p><input name="a"><textarea></textarea><p>{PLAIN[1]}</p></form>',
        f'<div class="ad tag-x"><p>{PLAIN[1]}</p></div>',
    ],
)
def test_names_and_forms_beside_an_article_still_hide(other):
    for wrap in ("<article><p>%s</p></article>", '<div class="post tag-news"><p>%s</p></div>'):
        assert html_extract.main_text(wrap % PLAIN[0] + other, TREE) == PLAIN[0]


def test_a_page_of_unclosed_forms_is_read_once():
    assert html_extract.main_text("<form><p>a" * 50_000, TREE) == ""


def test_main_text_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><header><h2>Site</h2></header>
    <nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice">We use cookies &amp; more of them every day.</div><div class=ad>Buy one of these now.</div>
    <article><h1>The&nbsp;head   line</h1><p>One <b>bold<br>claim</b> &lt;here&gt; with <a href=x>a link</a> in it, and a few more words.<p>Of.</p><form><input> Sign up please</form><aside>Related reading here</aside>
    <blockquote>A &#8220;quote&#8221;</blockquote><section class="comments"><p>Reader: I disagree with all of this, at some length, as readers do.</p></section></article>
    <!-- <p>hidden</p> --><footer>&copy; 2024 Someone</footer></body></html>"""
    assert html_extract.main_text(page, TREE) == "The head line One bold claim <here> with a link in it, and a few more words. Of. A “quote”"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<a b='", "<!--", "</x></y>", "<script>", "plain", "<p>" * 3000, "a < b > c", "<div class='" + "x" * 5000])
def test_malformed_pages_do_not_raise(page):
    assert isinstance(html_extract.main_text(page, TREE), str)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><div class="entry-header"><h1>The head line</h1></div><p>Some text of the article.</p></article>', "The head line Some text of the article."),
        ('<article><div class="left-side"><p>Some text of the article.</p><p>And more of it here.</p></div></article>', "Some text of the article. And more of it here."),
        ('<article><h1>Head</h1><div class="discussion-section"><p>Some text of the article.</p></div></article>', "Head Some text of the article."),
        ('<article><p>Some text.</p><p class="legal">The court has ruled on it.</p></article>', "Some text. The court has ruled on it."),
        ('<article><p>Some text.</p></article><div class="sidebar">' + "<div>" * 10_050 + "Buy this" + "</div>" * 10_050 + "</div>", "Some text."),
        ('<article><p>Some text.</p><section class="comments"><p>Reader: no.</p></section></article>', "Some text."),
        ('<div class="site-header">My Site</div><main><p>Some text of it.</p></main><div class="alert">Read me now</div><div class="legal">All rights reserved</div>', "Some text of it."),
        ('<article><p>One.</p></nav></div></section><p>Two.</p></article>', "One. Two."),
    ],
)
def test_names_are_weak_where_they_may_mean_layout(page, text):
    assert html_extract.main_text(page, TREE) == text


def test_stray_tags_take_linear_time():
    begun = time.perf_counter()
    html_extract.blocks_of("<div>" * 100_000 + "<p>x" + "</section></i>" * 60_000 + "</div>" * 100_000)
    assert time.perf_counter() - begun < 8


def held_out_pages(n):
    """Pages made from other parts than the tree's table, with the text that an editor would take."""
    rng = random.Random(43)
    words = lambda a, b: " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(a, b))).capitalize() + "."
    link = lambda: f"<a href=/x>{words(1, 4)}</a>"
    before = [
        lambda: f"<nav class=primary><ul>{''.join(f'<li>{link()}</li>' for _ in range(6))}</ul></nav>",
        lambda: f"<div id='top-menu'>{link()} | {link()} | {link()}</div>",
        lambda: f"<header role=banner><a href=/>{words(1, 3)}</a><p>{words(4, 9)}</p></header>",
        lambda: f"<div class='cookie-consent'>{words(15, 30)}</div>",
        lambda: f"<div class='breadcrumb'>{link()} &gt; {link()}</div>",
        lambda: f"<table class=masthead><tr><td>{words(2, 5)}</td></tr></table>",
    ]
    after = [
        lambda: f"<footer><p>{words(5, 25)}</p>{link()}</footer>",
        lambda: f"<aside><h3>{words(1, 3)}</h3>{link()}{link()}</aside>",
        lambda: f"<div class='related-posts'><h2>{words(1, 3)}</h2><p>{words(20, 60)}</p></div>",
        lambda: f"<section id='comments'><div class='comment'><p>{words(10, 80)}</p></div></section>",
        lambda: f"<form action=/s><label>{words(2, 6)}</label><input></form>",
        lambda: f"<div class='social-share'>{link()}{link()}</div>",
        lambda: f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(5))}</ul>",
    ]
    wrappers = ["<article>{}</article>", "<main id=main>{}</main>", "<div class='post-content'>{}</div>", "<div class='left-side'>{}</div>", "<div>{}</div>", "<article class='has-sidebar'><div class='entry-body'>{}</div></article>"]
    for _ in range(n):
        parts, out = [], []
        head = words(3, 9)
        parts.append(rng.choice(["<h1>{}</h1>", "<div class='entry-header'><h1>{}</h1></div>", "<h1 class=title>{}</h1>"]).format(head))
        out.append(head)
        for _ in range(rng.randrange(3, 8)):
            t = words(20, 90)
            parts.append(rng.choice(["<p>{}</p>", "<p>{}", "<p class=lead>{}</p>", "<blockquote>{}</blockquote>"]).format(t))
            out.append(t)
        body = rng.choice(wrappers).format("\n".join(parts))
        page = "<html><body>" + "".join(f() for f in rng.sample(before, 3)) + body + "".join(f() for f in rng.sample(after, 3)) + "</body></html>"
        yield page, " ".join(out)


def test_main_text_of_held_out_pages():
    right = shared = wanted = taken = 0
    for page, text in held_out_pages(200):
        got = html_extract.main_text(page, TREE)
        right += got == text
        a, b = collections.Counter(got.split()), collections.Counter(text.split())
        shared, wanted, taken = shared + sum((a & b).values()), wanted + sum(b.values()), taken + sum(a.values())
    print(f"whole pages {right / 200:.3f}, words found {shared / wanted:.4f}, words right {shared / taken:.4f}")
    assert right >= 170 and shared / wanted > 0.99 and shared / taken > 0.97


def test_tree_fits_its_table():
    assert (TREE.predict(html_extract.LABELLED[:, :-1]) == html_extract.LABELLED[:, -1]).all()


def test_extract_pages(spark):
    p = spark.createDataFrame([(1, "u", "<article><p>Hi &amp; bye</p></article>"), (2, None, None), (None, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html_extract.extract_pages(p).collect()) == [("1", "Hi & bye", 8), ("2", "", 0), ("None", "", 0)]


# --- toxicity -------------------------------------------------------------------------


def test_toxicity_held_out_accuracy_and_spans(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for k in range(600):
        parts = [rand_text(rng, 12, 200) for _ in range(rng.randrange(1, 30))]
        bad = k % 5 == 0
        if bad:
            parts[rng.randrange(len(parts))] += " " + " ".join(rng.sample(["vilefoo", "vilebar", "crudword", "vilequx"], 2))
        rows.append((k, ". ".join(parts)))
        labels.append((k, int(bad)))
    got = toxicity.score_documents(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    texts = dict(rows)
    for r in got:
        if truth[r.doc_id] and r.spans:
            assert any(re.search("vile|crud", texts[r.doc_id][s.start : s.end]) for s in r.spans)


def test_toxicity_on_odd_rows_and_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score_documents(odd, none).collect()
    assert len(rows) == len(ODD) and all(r.predicted == 0 and 0 <= r.score <= 1 for r in rows)
    some = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (4, 0)], "doc_id long, toxic int")
    assert toxicity.score_documents(odd, some).count() == len(ODD)


def test_toxicity_scores_do_not_depend_on_letters_that_grow(spark):
    model = toxicity.Model(-4.0, {"vileword": 8.0})
    (plain, spans), (odd, odd_spans) = (model.score(t) for t in ("you VILEWORD", "you VILEWORD İ"))
    assert plain == odd > 0.9 and spans[0][:2] == (0, 12) and odd_spans[0][:2] == (0, 14)
    assert toxicity.lowered("İI") == "ii"


def test_training_rows_are_one_an_id_and_bounded(spark):
    rows = [(k % 50, "text " * (k % 7 + 1)) for k in range(400)] + [(None, "x"), (7, None)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.training_rows(frame(spark, rows), labels, "doc_id", "text", "toxic", 1000).collect()
    assert len(got) == len({r._id for r in got}) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(50))
    few = toxicity.training_rows(frame(spark, rows), labels, "doc_id", "text", "toxic", 1000, max_chars=300).collect()
    assert 0 < len(few) < len(got) and sum(len(r._text) for r in few) <= 300


# --- licenses -------------------------------------------------------------------------


@pytest.mark.parametrize("block", [200, 9])
def test_licenses_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(license_scan, "BLOCK_TEMPLATES", block)
    rng = random.Random(13)
    rows = []
    for k in range(30):
        name, text = rng.choice(sorted(license_scan.TEMPLATES.items()))
        words = text.split()
        if k % 3 == 0 and len(words) > 40:
            words[len(words) // 2] = "altered"
        rows.append((k, " ".join([rand_text(rng, rng.randrange(0, 90))] + words + [rand_text(rng, rng.randrange(0, 90))])))
    rows += [(90, rand_text(rng, 200)), (91, "MIT License"), (92, None)]
    got = {(r.doc_id, r.license_id) for r in license_scan.scan(frame(spark, rows), license_scan.default_templates(spark)).collect()}

    def grams(t):
        w = re.findall(r"[a-z0-9\x80-￿]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = {(k, n) for k, t in rows for n, x in license_scan.TEMPLATES.items() if len(grams(x) & grams(t)) >= 0.8 * len(grams(x))}
    assert got == want


def test_licenses_on_odd_rows(spark, odd):
    assert license_scan.scan(odd, license_scan.default_templates(spark)).count() == 0
    assert license_scan.scan(odd, license_scan.default_templates(spark).limit(0)).count() == 0


# --- exact duplicates -----------------------------------------------------------------


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_duplicates_equal_brute_force(spark, keep):
    rows = ODD + [(k, f"copy {k % 4}".upper() if k % 3 else f"copy {k % 4}") for k in range(20, 60)] + [(70, "É"), (71, "é"), (72, "é")]
    groups = collections.defaultdict(list)
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    for i, t in rows:
        groups[lower(t)].append(i)
    pick = max if keep == "max" else min
    want = sorted((str(i), str(pick([x for x in groups[lower(t)] if x is not None], default=None)), len(groups[lower(t)])) for i, t in rows)
    got = exact_dedup.exact_dedup(frame(spark, rows), keep=keep).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exact_dedup.exact_dedup(frame(spark, rows).limit(0)).count() == 0


def test_index_probes_and_merges_later_runs(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", fanout=3)
    rows = lambda x: spark.createDataFrame(x, "digest binary, id long")
    index.flush(rows([(b"\x01" * 32, 5), (b"\x01" * 32, 7), (b"\xf0" * 32, 1)]))
    index.flush(rows([(b"\x01" * 32, 6), (b"\xaa" * 32, 9)]))
    assert [r.level for r in index.runs] == [0, 0]
    probe = index.probe(spark.createDataFrame([(b"\x01" * 32,), (b"\x02" * 32,)], "digest binary")).collect()
    assert [(r.best, r.size) for r in probe] == [(7, 3)]
    assert [bytes(r.digest) for r in index.hits().collect()] == [b"\x01" * 32]
    index.flush(rows([(b"\xf0" * 32, 4)]))  # the third run fills the level
    assert [r.level for r in index.runs] == [1]
    index.flush(rows([(b"\xbb" * 32, 2)]))
    assert [r.level for r in index.runs] == [1, 0]
    assert {bytes(r.digest)[0] for r in index.hits().collect()} == {0x01, 0xF0}
    assert sorted((r.best, r.size) for r in index.compact().collect()) == [(2, 1), (4, 2), (7, 3), (9, 1)]
    assert len(index.runs) == 1


def test_filters_turn_most_other_keys_away(spark):
    keys = materialize(spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k")), "keys")
    f = KeyFilter(keys, "k")
    others = spark.range(20_000, 60_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    assert f.maybe(keys, "k").count() == 20_000 and f.never(keys, "k").count() == 0
    passed = f.maybe(others, "k").count()
    assert passed < 40_000 / 32 and f.never(others, "k").count() == 40_000 - passed
    none = KeyFilter(materialize(keys.limit(0), "keys"), "k")
    assert none.maybe(keys, "k").count() == 0 and none.never(keys, "k").count() == 20_000


def test_memtables_do_not_change_the_result(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_MEMTABLES", 6)
    rows = [(k, f"text {k % 37}") for k in range(120)]
    few, many = (sorted(map(tuple, exact_dedup.exact_dedup(frame(spark, rows), memtable_rows=m).collect())) for m in (1000, 20))
    assert few == many and {r[2] for r in few} == {3, 4}


def test_what_stays_is_what_compaction_kept(spark, monkeypatch):
    rows = [(k, f"text {k % 5}") for k in range(40)] + [(100, "alone")]
    kept = lambda: {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()}
    assert kept() == {k: (35 + k % 5, 8) for k in range(40)} | {100: (100, 1)}
    monkeypatch.setattr(exact_dedup.DigestIndex, "_best", lambda self, col: F.min(col))
    assert kept() == {k: (k % 5, 8) for k in range(40)} | {100: (100, 1)}


def test_texts_that_share_a_digest_are_split_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "digest_of", lambda norm: F.unhex(F.sha2(F.substring(norm, 1, 2), 256)))
    rows = [(1, "ab"), (2, "AB"), (3, "abc"), (4, "abc"), (5, "abd"), (6, "x"), (7, "x"), (8, "y")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (4, 2, False), 4: (4, 2, True), 5: (5, 1, True), 6: (7, 2, False), 7: (7, 2, True), 8: (8, 1, True)}


# --- near duplicates ------------------------------------------------------------------


def bag(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def test_signatures_are_unbiased_for_weighted_jaccard():
    rng = random.Random(17)
    m = 64
    errors = []
    for _ in range(60):
        a = [rng.randrange(1, 30) for _ in range(12)]
        b = [x if rng.random() < 0.5 else rng.randrange(1, 30) for x in a]
        h = np.array([rng.getrandbits(64) for _ in a] * 2, dtype=np.uint64)
        doc = np.repeat([0, 1], 12)
        sig = near_dedup.signatures(doc, h, np.array(a + b), 2, m)
        true = sum(map(min, a, b)) / sum(map(max, a, b))
        errors.append((sig[0] == sig[1]).mean() - true)
    assert abs(np.mean(errors)) < 4 * 0.5 / np.sqrt(60 * m)


def test_classes_equal_brute_force(spark):
    rng = random.Random(19)
    rows, k = [], 0
    for _ in range(25):
        base = rand_text(rng, rng.randrange(30, 200)).split()
        for _ in range(rng.randrange(1, 7)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(99)}"
            rows.append((k, " ".join(w)))
            k += 1
    rows += [(k, "a b c " * 40), (k + 1, "a b c " * 46), (k + 2, "a b c " * 20), (k + 3, "!!!"), (k + 4, "!!!"), (k + 5, None), (k + 6, "one two")]
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(bags[i], bags[j]) >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    want = {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_open_buckets_are_joined_in_blocks(spark, monkeypatch):
    # A chain: neighbours are alike, ends are not; small blocks must not lose a link.
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 300)
    rng = random.Random(23)
    w = rand_text(rng, 150).split()
    rows = []
    for k in range(40):
        w[(k * 7) % 150] = f"new{k}"
        rows.append((k, " ".join(w)))
    bags = [bag(t) for _, t in rows]
    linked = all(any(jaccard(bags[i], bags[j]) >= 0.8 for j in range(i)) for i in range(1, 40))
    assert linked and jaccard(bags[0], bags[-1]) < 0.8
    assert {r.class_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()} == {0}


def test_near_duplicates_on_odd_rows(spark, odd):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {r.class_id for r in got if r.doc_id in (5, 6)} == {5}
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_shingle_hashes_follow_the_words():
    texts = ["A b c d e f", "b C d e f g", "x", "", "a-b c.d e f", "é ß"]
    words = hash_words(texts)
    assert words.counts.tolist() == [6, 6, 1, 0, 6, 2]
    s, doc = shingles(words, 5)
    assert doc.tolist() == [0, 0, 1, 1, 2, 4, 4, 5] and s[1] == s[2] and s[0] == s[5]


# --- token files ----------------------------------------------------------------------


def test_token_files_round_trip(spark, odd, tmp_path):
    path, uri = public_tokenizers.path("word_bpe_49k.json"), f"{tmp_path}/files"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    manifest = binary_output.write_token_files(odd, uri, path, end_id=1, file_bytes=200)
    got = sorted(binary_output.read_token_files(spark, uri).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in ODD), key=lambda x: -1 if x is None else x)
    texts, start = collections.defaultdict(list), 0
    for i, t in ODD:
        texts[i].append(tok.encode(t or "", add_special_tokens=False).ids + [1])
    for r in got:
        assert r.ids in texts[r.doc_id] and r.start == start and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert manifest.count() > 1
    name = next(r.file for r in manifest.collect() if r.frames)
    reader = binary_output.open_reader(f"{uri}/{name}")
    assert np.frombuffer(reader.frame(0), "<u4")[-1] == 1 and reader.find(123456) is None
    raw = bytearray(open(f"{uri}/{name}", "rb").read())
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(bytes(raw), read_across_frames=True).read()[:4] == reader.frame(0)[:4]
    raw[10] ^= 255
    broken = binary_output.FileReader(lambda at, n: bytes(raw[at : at + n]), len(raw))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        broken.frame(0)


# --- packing --------------------------------------------------------------------------


def best_fit(counts, size):
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [g for g in gaps if g >= length]
            g = min(fits) if fits else size
            if fits:
                gaps.remove(g)
            gaps.append(g - length)
    return len(gaps)


def check_plan(spark, counts, size):
    """Whether the plan is whole and without overlap; how many sequences it takes."""
    used, placed = collections.defaultdict(list), collections.defaultdict(list)
    for p in packing.plan(spark.createDataFrame(sorted(counts.items()), "length long, n long"), size):
        for r in range(p.lo, p.hi):
            used[p.sequence + (r - p.lo) // p.per].append((p.offset + (r - p.lo) % p.per * p.size, p.size))
            placed[p.size].append(r)
    assert {k: sorted(v) for k, v in placed.items()} == {k: list(range(n)) for k, n in counts.items()}
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(used) == list(range(len(used)))
    return len(used)


@pytest.mark.parametrize("seed", range(3))
def test_plan_is_valid_and_as_good_as_best_fit(spark, seed):
    rng = random.Random(29 + seed)
    size = rng.randrange(20, 120)
    counts = {k: rng.randrange(1, 30) for k in rng.sample(range(1, size + 1), rng.randrange(5, 18))}
    assert check_plan(spark, counts, size) <= best_fit(counts, size) + 1


def test_plan_of_one_length_and_of_none(spark):
    assert check_plan(spark, {7: 1000}, 64) == -(-1000 // 9)
    assert check_plan(spark, {64: 3, 1: 5}, 64) == 4
    assert packing.plan(spark.createDataFrame([], "length long, n long"), 64) == []
    with pytest.raises(ValueError):
        packing.plan(spark.createDataFrame([(65, 1)], "length long, n long"), 64)


def test_packed_documents(spark, odd):
    got = packing.pack_documents(odd, public_tokenizers.path("byte_bpe_50k.json"), max_len=64, with_ids=True).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in ODD:
        if i not in (5,):
            parts = sorted(by_doc[i], key=lambda r: r.piece)
            assert b"".join(r.ids for r in parts) == np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
            assert all(r.length == 64 for r in parts[1:])


# --- quality --------------------------------------------------------------------------


def test_quality_held_out_accuracy(spark):
    rng = random.Random(31)
    rows, labels = [], []
    for k in range(500):
        good = k % 4 != 0
        text = ". ".join(rand_text(rng, 9) for _ in range(6)) if good else " | ".join(rng.choice(["###", "AAA", "$$"]) for _ in range(60))
        rows.append((k, text))
        labels.append((k, int(good)))
    got = quality.score_documents(frame(spark, rows), spark.createDataFrame(labels[:350], "doc_id long, quality int")).collect()
    truth = dict(labels)
    unseen = [r for r in got if r.held_out or r.doc_id >= 350]
    assert sum(r.predicted == truth[r.doc_id] for r in unseen) >= 0.97 * len(unseen)


def test_the_surest_of_many_tasks(spark):
    rng = np.random.default_rng(41)
    x = np.zeros((4000, quality.TEXT_FEATURES), dtype=np.float32)
    x[:, 0] = rng.random(4000)
    rows = [(k, v.tolist(), "en", "s", 100, 2) for k, v in enumerate(x)]
    pool = materialize(spark.createDataFrame(rows, f"id long, x array<float>, {quality.META}").repartition(1000), "pool")
    w = np.zeros(quality.TEXT_FEATURES)
    w[0] = 40.0
    views = [quality.Logistic(np.zeros(len(w)), np.ones(len(w)), w, -20.0), quality._constant(quality.META_FEATURES, 0.5)]
    with_many = {(view, kind): ids for view, kind, ids, _ in quality.unlabelled(pool)(views, {1.0: 50, 0.0: 30}, set())}
    order = np.argsort(x[:, 0], kind="stable")
    assert set(with_many[0, 1.0]) == set(order[-50:].tolist()) and set(with_many[0, 0.0]) == set(order[:30].tolist())


def test_one_long_labelled_text_does_not_empty_the_training_set(spark):
    rng = random.Random(43)
    rows = [(k, rand_text(rng, 5)) for k in range(80)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, toxic int")
    first = frame(spark, rows).where(~toxicity.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).first()["doc_id"]
    short = toxicity.training_rows(frame(spark, rows), labels, "doc_id", "text", "toxic", 1000, 1_500).count()
    with_long = frame(spark, [(k, "long " * 5000 if k == first else t) for k, t in rows])
    got = toxicity.training_rows(with_long, labels, "doc_id", "text", "toxic", 1000, 1_500)
    assert got.count() >= short - 1 > 20 and got.where(F.col("_id") == first).count() == 0
    assert toxicity.training_rows(with_long, labels, "doc_id", "text", "toxic", 1000).where(F.col("_id") == first).count() == 1


def test_quality_on_odd_rows(spark, odd):
    rows = quality.score_documents(odd.drop("lang").withColumn("source", F.lit(None).cast("string")), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(rows) == len(ODD) and len({round(r.score, 9) for r in rows}) == 1


def test_pseudo_labels_are_the_surest_of_all_documents(spark):
    rng = np.random.default_rng(37)
    rows = [(int(k), rng.random(quality.TEXT_FEATURES).astype(np.float32).tolist(), "en", "s", 100, 2) for k in range(500)]
    pool = spark.createDataFrame(rows, f"id long, x array<float>, {quality.META}").repartition(7)
    w = rng.normal(size=quality.TEXT_FEATURES) * 4
    views = [quality.Logistic(np.zeros(len(w)), np.ones(len(w)), w, -float(w.sum()) / 2), quality._constant(quality.META_FEATURES, 0.5)]
    taken = {3, 5, 8}
    got = quality.unlabelled(materialize(pool, "pool"))(views, {1.0: 12, 0.0: 7}, taken)
    p = {r[0]: 1 / (1 + np.exp(-views[0].logit(np.array(r[1])[None])[0])) for r in rows if r[0] not in taken}
    for view, kind, ids, both in got:
        want = sorted((i for i in p if (p[i] if kind else 1 - p[i]) >= quality.SURE), key=lambda i: -p[i] if kind else p[i])[: 12 if kind else 7] if view == 0 else []
        assert ids == want and both[0].shape == (len(ids), quality.TEXT_FEATURES)


# --- all of them ----------------------------------------------------------------------


def labelled(spark, column):
    return spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None)], f"doc_id long, {column} int")


def operators(spark, tmp_path):
    """Every operator as a function of documents (or pages) alone."""
    bench = spark.createDataFrame([(1, "same text"), (None, None), (2, "")], "item_id long, text string")

    def files(d):
        uri = f"{tmp_path}/files-{random.random()}"
        binary_output.write_token_files(d, uri, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
        return binary_output.read_token_files(spark, uri)

    return {
        "token counts": lambda d: token_counts.count_documents(d, public_tokenizers.path("piece_bpe_32k.model")),
        "decontamination": lambda d: decontaminate.contamination(d, bench),
        "html": lambda d: html_extract.extract_pages(d, "doc_id", "source", "text"),
        "toxicity": lambda d: toxicity.score_documents(d, labelled(spark, "toxic")),
        "clean": lambda d: toxicity.keep_clean(d, labelled(spark, "toxic")),
        "licenses": lambda d: license_scan.scan(d, license_scan.default_templates(spark)),
        "exact": exact_dedup.exact_dedup,
        "near": near_dedup.near_duplicates,
        "files": files,
        "packing": lambda d: packing.pack_documents(d, public_tokenizers.path("byte_bpe_50k.json")),
        "quality": lambda d: quality.score_documents(d, labelled(spark, "quality")),
    }


NAMES = ["token counts", "decontamination", "html", "toxicity", "clean", "licenses", "exact", "near", "files", "packing", "quality"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_empty_tables(spark, tmp_path, odd, name):
    assert operators(spark, tmp_path)[name](odd.limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for n in NAMES if n not in ("decontamination", "licenses", "packing")])
def test_each_row_counts_whatever_other_columns_there_are(spark, tmp_path, odd, name):
    clashing = odd
    for c in ("key", "label", "score", "digest", "norm", "best", "_text", "_id", "x", "n_tokens", "kept", "bucket"):
        clashing = clashing.withColumn(c, F.lit("other"))
    assert operators(spark, tmp_path)[name](clashing).count() == len(ODD)
