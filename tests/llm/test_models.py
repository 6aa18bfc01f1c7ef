"""Learned operators: toxicity, quality rules, HTML; held-out accuracy and defined results for odd rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from codelode.llm import quality, toxicity
from codelode.llm.html_text import FEATURES, extract_main_text, main_text, trained_tree

WORDS = [a + b for a in ("tion", "the", "an", "ver", "ou", "re") for b in ("s", "ing", "er", "le", "om", "ka")]
BAD = ["idiot", "moron", "scumbag", "loweist", "loweian"]


def texts(n, seed, toxic):
    rng = random.Random(seed)
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 150))]
        if toxic:
            for _ in range(max(2, len(words) // 40)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        yield " ".join(words)


def labelled(spark, n=160):
    rows = [(i, t, 0) for i, t in enumerate(texts(n, 1, False))] + [(10_000 + i, t, 1) for i, t in enumerate(texts(n, 2, True))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, k, 1) for i, _, k in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, toxic int, quality int")


def test_toxicity_on_held_out_texts(spark):
    docs, labels = labelled(spark)
    model = toxicity.learn_toxicity(docs, labels)
    new = [(i, t) for i, t in enumerate(texts(60, 3, False))] + [(1000 + i, t) for i, t in enumerate(texts(60, 4, True))] + [(None, None), (-1, ""), (-2, " \n"), (-3, "!!! ???")]
    out = toxicity.score_toxicity(spark.createDataFrame(new, "doc_id long, text string").withColumn("score", F.lit("clash")), model).collect()
    hits = {r.doc_id: r.predicted for r in out}
    assert sum(hits[i] for i in range(60)) <= 1 and sum(hits[1000 + i] for i in range(60)) >= 57
    odd = [r.score for r in out if r.doc_id is None or r.doc_id < 0]
    assert len(odd) == 4 and all(0 <= x < 0.7 for x in odd) and len(set(odd)) == 1


def test_an_unknown_suffix_of_a_rare_expression_counts(spark):
    docs, labels = labelled(spark)
    model = toxicity.learn_toxicity(docs, labels)
    plain = " ".join(WORDS)
    assert model.evidence(plain + " loweiung") > 5 * abs(model.evidence(plain + " qqzzung"))


def test_toxicity_does_not_follow_the_cap(spark):
    rows = [(i, t, 0) for i, t in enumerate(texts(400, 7, False))] + [(10_000 + i, t + " rareword" * (i == 3), 1) for i, t in enumerate(texts(40, 8, True))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id long, toxic int")
    whole, capped = toxicity.learn_toxicity(docs, labels), toxicity.learn_toxicity(docs, labels, max_labelled=15)
    # All texts but the curve's are counted, however few the curve takes.
    assert len(capped.seen) >= len(whole.seen)
    # The curve keeps the labels' share of one in eleven, as without a cap.
    assert toxicity.fit_curve(np.zeros(30), np.repeat([0.0, 1.0], 15), weight=np.repeat([10.0, 1.0], 15))[1] == pytest.approx(-np.log(10), abs=1e-3)
    plain = " ".join(WORDS)
    score = [m.score(m.evidence(plain)) for m in (whole, capped)]
    assert abs(score[0] - score[1]) < 0.1


def test_unlabelled_texts_count_in_the_lower_orders(spark):
    docs, labels = labelled(spark, 60)
    more = docs.unionByName(spark.createDataFrame([(90_000 + i, t) for i, t in enumerate(texts(60, 9, False))], docs.schema))
    one, two = toxicity.learn_toxicity(docs, labels), toxicity.learn_toxicity(more.withColumn("text", F.concat("text", F.when(F.col("doc_id") >= 90_000, " zzideo wwidiotic").otherwise(""))), labels)
    assert (one.seen == two.seen).all() and not np.allclose(one.seen_llr, two.seen_llr)


def brute_kneser_ney(keys, gram, order):
    """The probability of the last byte of ``gram`` after the ones before, by plain loops over the n-grams of the next order."""
    kinds = {k[-order:] for k in keys}
    count = {g: len({k[-order - 1 :] for k in keys if k[-order:] == g}) for g in kinds}
    if order == 1:
        return (count[gram] + 0.5) / (sum(count.values()) + 128)
    same = {g: n for g, n in count.items() if g[:-1] == gram[:-1]}
    below = brute_kneser_ney(keys, gram[1:], order - 1)
    return (max(count[gram] - 0.75, 0) + 0.75 * len(same) * below) / sum(same.values())


def test_shared_probability(spark):
    found = np.unique(toxicity.informative(toxicity.grams(toxicity.document_words("the cat and the dog and thé cow ran then"))))
    frame = spark.createDataFrame([(int(x),) for x in found.view(np.int64)], "gram long")
    got = {r.gram: r.p for r in toxicity.shared_probability(frame, frame).collect()}
    keys = [int(x).to_bytes(8, "big") for x in found]
    assert len(got) == len(keys)
    for key in keys:
        assert got[int.from_bytes(key, "big", signed=True)] == pytest.approx(brute_kneser_ney(keys, key[1:], 7))


def test_word_ratio_and_evidence_by_hand(spark):
    """One word in all toxic texts, another in all: the ratio of the first, and what a text makes of it."""
    rows = [(i, "calm abcd" if i % 2 else "calm", i % 2) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.learn_toxicity(docs, spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id long, toxic int"))
    keys = sorted({int(x).to_bytes(8, "big") for t in ("calm", "abcd") for x in toxicity.informative(toxicity.grams(toxicity.padded([t])))})
    p = {k: brute_kneser_ney(keys, k[1:], 7) for k in keys}
    start_a, start_c = b"       a", b"       c"
    # After seven blanks: 20 toxic texts go on with a, 20 with c; 20 ordinary ones with c. Each count loses 3 to the backoff.
    want_a = np.log(((20 - 3) / 40 + 6 / 40 * p[start_a]) / (3 / 20 * p[start_a]))
    want_c = np.log(((20 - 3) / 40 + 6 / 40 * p[start_c]) / ((20 - 3) / 20 + 3 / 20 * p[start_c]))
    llr = {int(k).to_bytes(8, "big"): v for k, v in zip(model.seen, model.seen_llr[0])}
    assert llr[start_a] == pytest.approx(want_a, abs=1e-4) and llr[start_c] == pytest.approx(want_c, abs=1e-4)
    ratios = model.word_ratios(["abcd", "calm"])
    assert ratios[0] > 0 > ratios[1]
    share = toxicity.SHARE
    want = sum(np.log(1 - share + share * np.exp(min(x, 30))) for x in ratios) / (2 + toxicity.FEW)
    assert model.evidence("Abcd calm") == pytest.approx(want)


def test_no_labels(spark):
    docs, labels = labelled(spark, 5)
    model = toxicity.learn_toxicity(docs, labels.filter("toxic = 0"))
    assert {r.predicted for r in toxicity.score_toxicity(docs, model).collect()} == {0}
    assert quality.learn_from(docs, labels.filter("false")) == []


def brute_counts(text):
    import re

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_counts():
    rng = random.Random(0)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", " ", "\n", "é", "#", "\t", "\xa0", "c d e ", "\x0b", "\x1f", "|"]) for _ in range(rng.randint(0, 60)))
        assert quality.text_counts(text)[:5] == brute_counts(text), repr(text)


def test_rules_on_held_out_rows(spark):
    rng = np.random.default_rng(1)
    n = 3000
    t = pd.DataFrame({"a": rng.random(n), "b": rng.random(n), "c": rng.random(n)})
    bad = ((t.a > 0.8) & (t.b < 0.4)) | (t.c > 0.95)
    noisy = (bad ^ (rng.random(n) < 0.01)).to_numpy()
    rules = quality.learn_rules(t[:2000], noisy[:2000])
    hit = np.zeros(1000, bool)
    for r in rules:
        hit |= r.holds(t[2000:])
    assert (hit == bad[2000:].to_numpy()).mean() > 0.95
    df = spark.createDataFrame(t[2000:])
    kept = [r.k for r in df.select(quality.verdict(rules, {c: F.col(c) for c in t}).alias("k")).collect()]
    assert sorted(kept) == sorted((~hit).tolist())


def test_quality_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "word " * 60), (4, " ".join(f"w{i}" for i in range(60)))]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string"), []).collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (True, False), 4: (False, True)}


PAGES = [
    ("<body><nav><a href=1>Home</a></nav><article><h1>T &amp; t</h1><p>One  two<br>three<p>Short.</article><footer>f</footer>", "T & t\nOne two three\nShort."),
    ("<div id=menu><ul><li><a href=1>A</a><li><a href=2>B</a></ul></div><p>Some plain text of a page that has no article at all.</p><p>Another one &eacute; here.", "Some plain text of a page that has no article at all.\nAnother one é here."),
    ("<main><p>Text<script>var a='<p>x</p>'</script> goes on<!-- no --></p><div class='cookie-notice'>Cookies!</div><section id=comments><p>Nice article, thank you for the words.</p></section></main>", "Text goes on"),
    ("<article><form><input><p>Mail</p></form><aside>side</aside><p>a<b>b</b>c &lt;tag&gt;</p></article>", "abc <tag>"),
    ("<title>t</title><article><p>left open <style>p{}", "left open"),
    ("", ""), ("<p></p>", ""), (None, ""),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_pages(page, want):
    assert main_text(page) == want


def test_page_column(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PAGES)], "page_id long, html string")
    got = dict(df.select("page_id", extract_main_text(F.col("html"))).collect())
    assert got == {i: w for i, (_, w) in enumerate(PAGES)}


LONG = "Some words of an article that go on for a while and end here."


@pytest.mark.parametrize("page,want", [
    *[(f"<div><{x}>Menu</div><article><p>{LONG}</p></article>", LONG) for x in ("button", "select", "svg", "video", "audio", "canvas", "datalist")],
    (f"<article><p>{LONG} <button>Share</p><p>{LONG}</article>", f"{LONG}\n{LONG}"),
    (f"<table><tr><td><button>Menu</td></tr></table><article><p>{LONG}</p></article>", LONG),
    (f"<article><svg><path d=''><p>{LONG}</p></article>", LONG),
    (f"<article><p>{LONG}<svg><title>t</svg> Yes.</p></article>", f"{LONG} Yes."),
    (f"<article><p>{LONG}<svg><foreignObject><div>no</div></foreignObject><text>no</text></svg> Yes.</p></article>", f"{LONG} Yes."),
    (f"<article><p>{LONG}<button><div>no</div> no</button> Yes.</p></article>", f"{LONG} Yes."),
    (f"<article><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>1</mn></math> <object data=a>Shown instead</object></p></article>", f"{LONG} x=1 Shown instead"),
    (f"<article><p>{LONG}<template><p>no</p></div></template> Yes.</p></article>", f"{LONG} Yes."),
    (f"<article><p>{LONG}</p><script>open", LONG),
])
def test_elements_left_open(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("page,want", [
    (f'<div class="layout with-sidebar"><article><p>{LONG}</p></article></div>', LONG),
    (f'<div class="content promo-free"><p>{LONG}</p><p>{LONG}</p></div>', f"{LONG}\n{LONG}"),
    (f'<div class="article-share-wrapper"><article><p>{LONG}</p></article></div>', LONG),
    *[(f'<article><p>{LONG}</p><section class="{c}"><p>{LONG}</p></section></article>', f"{LONG}\n{LONG}") for c in ("legal", "follow-up", "side-effects")],
    (f'<article><p>{LONG}</p><div class="share-bar"><a href=1>Post</a></div><div class="article-share"><a href=1>Send this</a></div></article>', LONG),
    (f'<main><p>{LONG}</p><section id="comments"><article><p>{LONG}</p></article></section><article class="comment"><p>{LONG}</p></article></main>', LONG),
    (f'<div>Sections</div><ul><li><a href=1>A</a><li><a href=2>B</a></ul><p>{LONG}</p><p>Short end.</p><ul><li><a href=3>C d</a></ul><div>Made here</div>', f"{LONG}\nShort end."),
])
def test_layouts(page, want):
    assert main_text(page) == want


def test_the_tree_uses_words_and_neighbours():
    def split_on(tree):
        return {FEATURES[tree[0]]} | split_on(tree[2]) | split_on(tree[3]) if isinstance(tree, tuple) else set()

    used = split_on(trained_tree())
    assert {"words", "links"} & used and used & {"words_before", "words_after"} and used & {"links_before", "links_after"}


def test_a_very_long_page():
    body = "".join(f"<p>paragraph {i}</p>" for i in range(20_000))
    assert main_text(f"<article>{body}</article>").count("\n") == 19_999
    assert main_text("<article><p>" + "<" * 50_000 + " a</p></article>").endswith("< a")


PARAGRAPH = "This is a longer paragraph of an article that says a good deal about its subject and goes on for a while, with commas."
MENU, FOOT = '<nav><a href="/">Home</a> <a href="/x">About us</a></nav>', "<footer><p>Copyright someone, all rights reserved, contact us</p></footer>"


@pytest.mark.parametrize("page,text", [
    (f'<body><form id="aspnetForm">{MENU}<div><h1>Title here</h1><p>{PARAGRAPH}</p></div>{FOOT}</form></body>', f"Title here\n{PARAGRAPH}"),
    (f"<form><article><p>{PARAGRAPH}</p></article></form>", PARAGRAPH), ("<body><p>Hello world.</p></body>", "Hello world."),
    (f'<body>{MENU}<article class="widget"><p>{PARAGRAPH}</p></article>{FOOT}</body>', PARAGRAPH), (f'<article class="banner"><p>{PARAGRAPH}</p></article>', PARAGRAPH),
    (f'<article><p class="banner">{PARAGRAPH}</p></article>', PARAGRAPH), (f'<article><div class="widget"><p>{PARAGRAPH}</p></div></article>', PARAGRAPH),
    (f'<article><p>{PARAGRAPH}</p><p class="banner">Buy now and save, only this week, at your favourite shop.</p></article>', PARAGRAPH),
    (f"<aside><article><p>{PARAGRAPH}</p></article></aside>", PARAGRAPH),
    (f"{MENU}{FOOT}", ""), ('<div class="cookie-notice"><p>We use cookies on this site to improve it.</p></div>', ""), ("<form><label>Name</label><input><button>Go</button></form>", ""), (f"{MENU}<aside><p>{PARAGRAPH}</p></aside>", ""),
])
def test_pages_in_which_no_block_is_clear(page, text):
    assert main_text(page) == text
