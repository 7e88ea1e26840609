"""Token counts, quality, html text and toxicity against plain versions and on odd rows."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from finlake.llm import html_text, quality, token_counts, toxicity
from finlake.llm.common import read


@pytest.fixture(scope="module")
def counter():
    import public_tokenizers

    return token_counts.counter(public_tokenizers.path(token_counts.TOKENIZER))


def plain(counter, text):
    return len(counter.tokenizer.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcXY '.-0é́😀\n\t\x0b\x1c  |<>")), max_size=60))
def test_every_prefix_has_its_exact_count(text):
    import public_tokenizers

    own = token_counts.counter(public_tokenizers.path(token_counts.TOKENIZER))
    assert own.counts([text]) == [plain(own, text)]
    table = own.table(text)
    for n in range(len(text) + 1):
        assert own.prefix(text, n, table) == plain(own, text[:n])


def test_special_strings_and_budget(counter):
    text = "one <|endoftext|>two three's"
    assert counter.counts([text]) == [plain(counter, text)]
    cut = counter.fit(text, 3)
    assert plain(counter, text[:cut]) <= 3 < plain(counter, text)


@pytest.mark.parametrize("text", ["中文字符没有空格" * 40, "internationalisation" * 20, "don't they'll<|endoftext|>x", "eJx9" * 60, "e\u0301\u0323a\u0300ß", "...!!!'s" * 9])
def test_prefixes_inside_a_unit(counter, text):
    want = [plain(counter, text[:n]) for n in range(1, len(text) + 1)]
    assert counter.inside(text) == want
    for budget in (0, 1, 7, 20):
        assert counter.fit(text, budget) == max((n for n, x in enumerate(want, 1) if x <= budget), default=0)


def test_recurrence_does_not_encode_again(counter, monkeypatch):
    text = "unbelievablyextraordinary" * 30
    counter.inner.pop(text, None)
    seen = []
    monkeypatch.setattr(counter, "_plain", lambda t: seen.append(t))
    assert len(counter.inside(text)) == len(text) and not seen


def test_token_counts_of_whole_texts(spark, data, odd, counter):
    docs = read(spark, data, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = sorted((str(i), len((t or "").encode()), plain(counter, t or "")) for i, t in docs.collect())
    got = token_counts.token_counts(docs)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert got.where("over_limit <> (n_tokens > 2048)").count() == 0
    tables = token_counts.token_counts(odd, prefixes=True).collect()
    assert all((r.prefix_tokens or [0])[-1] == r.n_tokens for r in tables)
    assert token_counts.token_counts(docs.where("false")).count() == 0


def test_quality_is_learned_from_its_fold_alone(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    got = quality.query(spark, d).cache()
    labels = read(spark, d, "labels").select("doc_id", "quality")
    held = got.join(labels, "doc_id").where("held_out")
    right = held.where("predicted = quality").count() / held.count()
    assert right >= 0.95 and got.count() == read(spark, d, "documents").count()
    assert got.where("score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").count() == 0
    assert got.where("held_out <> (crc32(cast(doc_id as string)) % 5 = 0)").count() == 0
    # labels of the held-out fold change nothing
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    docs = read(spark, d, "documents")
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert (a.table == b.table).all() and (a.out == b.out).all()


def test_quality_folds_to_the_same_score():
    import numpy as np

    model = quality.Model()
    model.out = np.random.default_rng(1).normal(size=model.out.shape).astype(np.float32)
    bag = quality.bag("some words some words words")
    ids, n = np.array(list(bag)), np.array(list(bag.values()), np.float32)
    z = (n / n.sum()) @ model.table[ids] @ model.out + model.bias
    w, bias = model.folded()
    assert abs((z[1] - z[0]) - ((w[ids] * n).sum() / n.sum() + bias)) < 1e-4


def test_classifiers_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 1), (6, 0, None), (None, 1, 1), (7, None, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    none = labels.where("false")
    for lab in (labels, none):
        assert quality.score(odd, quality.train(odd, lab)).count() == odd.count()
        assert toxicity.score(odd, toxicity.train(odd, lab)).count() == odd.count()
    assert {r.score for r in quality.score(odd, quality.train(odd, none)).collect()} == {0.5}
    assert toxicity.score(odd, toxicity.train(odd, none)).where("toxic").count() == 0
    assert quality.score(odd.where("false"), quality.Model()).count() == 0


def test_an_id_that_repeats_is_learned_from_once(spark, docs_of, monkeypatch):
    """Thousands of rows of one id, and a label of 10**9, reach the driver as one row and one more grade."""
    docs = docs_of([(1, f"bad word {k}") for k in range(4000)] + [(2, "good words"), (3, "awful"), (4, None)]).withColumn("_id", F.lit(9)).withColumn("_y", F.lit(8))
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 10**9), (4, 0, 0), (5, 1, 1)], "doc_id bigint, quality int, toxic int")
    sizes = []
    fit = toxicity.Ordinal.fit
    monkeypatch.setattr(toxicity.Ordinal, "fit", lambda self, rows, grade, share: sizes.append((len(rows), self.grades)) or fit(self, rows, grade, share))
    model = toxicity.train(docs, labels)
    assert sizes == [(4, 3)] and toxicity.score(docs, model).count() == docs.count()
    learn = quality.Model.fit
    monkeypatch.setattr(quality.Model, "fit", lambda self, bags, y: sizes.append(len(bags)) or learn(self, bags, y))
    quality.train(docs, labels)
    assert sizes[1] <= 4
    many = spark.range(200).select(F.col("id").alias("doc_id"), F.col("id").alias("toxic"))
    with pytest.raises(ValueError):
        toxicity.train(docs, many)


@pytest.mark.parametrize("column", ["_text", "_id", "severity", "SCORE", "held_out", "c0", "ids", "text_", "_fp", "n_tokens"])
def test_extra_columns_with_clashing_names(spark, docs_of, column):
    from finlake.llm import pii, simhash_dedup, substring_dedup

    docs = docs_of(["one two three four five", None, "six"]).withColumn(column, F.lit("mine"))
    assert token_counts.token_counts(docs).count() == quality.score(docs, quality.Model()).count() == 3
    assert toxicity.score(docs, toxicity.Ordinal()).count() == simhash_dedup.dedup_components(docs).count() == 3
    assert substring_dedup.dedup_passages(docs).count() == pii.find(docs).count() == 3
    kept = toxicity.score(docs, toxicity.Ordinal(), keep_columns=True)
    assert kept.columns[: len(docs.columns)] == docs.columns and {r[0] for r in kept.select(column).collect()} == {"mine"}


def plain_ordinal(rows, grade, share, steps, penalty):
    """The same proximal steps over a dense matrix."""
    import numpy as np

    ids = sorted({i for r in rows for i in r})
    ids = [i for i in ids if sum(i in r for r in rows) >= 3]
    x = np.array([[float(i in r) for i in ids] for r in rows])
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    weight = (share / np.maximum(np.bincount(grade, minlength=len(share)), 1))[grade]
    below = np.cumsum(share)[:-1]
    theta = np.log(below / (1 - below))
    w, s, t = np.zeros(len(ids)), np.full(len(ids), 1e-8), np.full(len(theta), 1e-8)
    for _ in range(steps):
        eta, g, gt = x @ w, np.zeros(len(ids)), np.zeros(len(theta))
        for k, y in enumerate(grade):
            hi = sig(theta[y] - eta[k]) if y < len(theta) else 1.0
            lo = sig(theta[y - 1] - eta[k]) if y else 0.0
            p = max(hi - lo, 1e-12)
            g += weight[k] * (hi * (1 - hi) - lo * (1 - lo)) / p * x[k]
            if y < len(theta):
                gt[y] -= weight[k] * hi * (1 - hi) / p
            if y:
                gt[y - 1] += weight[k] * lo * (1 - lo) / p
        s += g * g
        w = w - 0.5 / np.sqrt(s) * g
        w = np.sign(w) * np.maximum(np.abs(w) - 0.5 / np.sqrt(s) * penalty, 0)
        t += gt**2
        theta = np.maximum.accumulate(theta - 0.5 * gt / np.sqrt(t))
    return {i: v for i, v in zip(ids, w) if v}, theta


def test_ordinal_steps_against_a_dense_version(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(8)
    rows = [np.array(sorted(rng.choice(30, rng.integers(0, 9), replace=False)), np.uint32) for _ in range(60)]
    grade = rng.integers(0, 3, 60)
    share = np.array([0.7, 0.2, 0.1])
    monkeypatch.setattr(toxicity, "STEPS", 25)
    got = toxicity.Ordinal(3).fit(rows, grade, share)
    want, theta = plain_ordinal([set(r.tolist()) for r in rows], grade, share, 25, toxicity.PENALTY)
    assert dict(zip(got.ids.tolist(), got.weights.tolist())) == pytest.approx(want) and got.theta.tolist() == pytest.approx(theta.tolist())


def test_quality_steps_against_a_plain_version(monkeypatch):
    """One pass of gradient descent, feature by feature."""
    import numpy as np

    monkeypatch.setattr(quality, "EPOCHS", 1)
    bags = [(np.array([1, 5, 9], np.uint32), np.array([2, 1, 1], np.float32)), (np.array([5, 7], np.uint32), np.array([1, 3], np.float32)), (np.zeros(0, np.uint32), np.zeros(0, np.float32))]
    labels = [1, 0, 1]
    got, own = quality.Model().fit(bags, labels), quality.Model()
    own.bias[:] = np.log(np.bincount(labels, minlength=2) / 3)
    for step, k in enumerate(np.random.default_rng(quality.SEED).permutation(3)):
        ids, counts = bags[k]
        rate = quality.RATE * (1 - step / 3)
        if not len(ids):
            continue
        part = counts / counts.sum()
        hidden = sum(p * own.table[i] for p, i in zip(part, ids))
        z = [float(hidden @ own.out[:, c] + own.bias[c]) for c in (0, 1)]
        back = [np.exp(z[c]) / (np.exp(z[0]) + np.exp(z[1])) - (c == labels[k]) for c in (0, 1)]
        grad = own.out @ np.array(back)
        for c in (0, 1):
            own.out[:, c] -= rate * hidden * back[c]
            own.bias[c] -= 0.1 * rate * back[c]
        for p, i in zip(part, ids):
            own.table[i] -= rate * 20 * min(p, 0.05) * grad
    assert np.allclose(got.table, own.table, atol=1e-5) and np.allclose(got.out, own.out, atol=1e-5) and np.allclose(got.bias, own.bias, atol=1e-5)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = read(spark, d, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs = read(spark, d, "documents")
    model = toxicity.train(docs, labels.where(~fold))
    got = toxicity.score(docs, model).drop("toxic_label").join(labels.where(fold).select("doc_id", F.col("toxic").alias("y")), "doc_id").collect()
    hit = [r.toxic for r in got if r.y == 1]
    false = [r.toxic for r in got if r.y == 0]
    assert sum(hit) / len(hit) >= 0.85 and sum(false) / len(false) <= 0.015


def test_ordinal_grades():
    import numpy as np

    rng = np.random.default_rng(3)
    rows, grade = [], []
    for _ in range(600):
        k = int(rng.integers(0, 3))
        rows.append(np.array(sorted({*rng.integers(10, 60, 8).tolist(), *([1] if k >= 1 else []), *([2] if k == 2 else [])}), np.uint32))
        grade.append(k)
    m = toxicity.Ordinal(3).fit(rows, np.array(grade), np.array([1 / 3] * 3))
    eta = {k: [sum(dict(zip(m.ids.tolist(), m.weights)).get(int(i), 0) for i in r) for r, g in zip(rows, grade) if g == k] for k in range(3)}
    mean = [float(np.mean(m.severity(np.array(eta[k])))) for k in range(3)]
    assert mean[0] < 0.3 < 0.7 < mean[1] < 1.3 < 1.7 < mean[2] and (np.diff(m.theta) > 0).all()


def test_toxic_stage_keeps_columns(spark, data):
    docs = read(spark, data, "documents").withColumn("toxic", F.lit("mine")).withColumn("severity", F.lit(1)).withColumn("_toxic", F.lit(2)).withColumn("c0", F.lit(3))
    out = toxicity.stage(spark, docs, data)
    assert out.columns == docs.columns and {r[0] for r in out.select("toxic").distinct().collect()} == {"mine"}


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><a href="/">Site name</a></header><nav><ul><li>Home</li><li>About us</li></ul></nav><div class="cookie-notice">We use cookies on this long site, a lot of them, really.</div>
<article><h1>The  title</h1><p>First &eacute;t&eacute; paragraph,
 <b>bold &lt;text&gt;</b> and more words to read.<p>Second one.</p><aside>See also: much more elsewhere</aside><ul><li>item one</li><li>item two</li></ul><form><label>Mail</label><input name="m"></form></article>
<section id="comments"><p>A reader's comment that is rather long and says nothing of use at all.</p></section><footer>&copy; somebody with a very long footer text that goes on and on</footer></body></html>"""


def test_html_main_text():
    assert html_text.main_text(PAGE) == "The title\nFirst été paragraph, bold <text> and more words to read.\nSecond one.\nitem one\nitem two"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p><script>x") == ""
    assert html_text.main_text("just text &amp; no markup") == "just text & no markup"
    bare = "<div><a>Menu</a></div><div>x</div><div>y</div>" + "<p>A paragraph of some length, which is the text.</p>" * 3 + "<div>z</div><div>q</div><div>r</div>"
    assert "paragraph" in html_text.main_text(bare) and "Menu" not in html_text.main_text(bare)


MENU = "".join(f"<div><a>menu item {k:02d}</a></div>" for k in range(30))
PLAIN = MENU.replace("<a>", "").replace("</a>", "")
TEXT = "".join(f"<p>Paragraph {k} of some length, which is the text.</p>" for k in range(5))
BODY = [f"Paragraph {k} of some length, which is the text." for k in range(5)]


@pytest.mark.parametrize(
    "page, want",
    [
        (MENU + TEXT + MENU, BODY),  # no article: the windows alone tell menus from text
        (PLAIN + TEXT + PLAIN, BODY),
        (f'<div class="layout-sidebar-right"><div>{MENU}</div>{TEXT}</div>', BODY),
        (f'<div class="content has-sidebar">{TEXT}</div>', BODY),
        (f'<div class="sidebar-page"><h1>T</h1>{TEXT}</div>', ["T", *BODY]),  # a mark on what holds the page
        (f'<form id="aspnetForm"><h1>T</h1>{TEXT}<input></form>', ["T", *BODY]),
        (f'<article><h1>A</h1><section id="discussion">{TEXT}</section><h2 id="market-share">Share</h2><p>x</p></article>', ["A", *BODY, "Share", "x"]),
        (f"<article><p>A teaser card here.</p></article><div>{TEXT}</div>", ["A teaser card here.", *BODY]),  # the dense block lies outside the mark
        (f'<p>First <span class="ad">buy <span>now</span> cheap</span> and last part.</p>{TEXT}', ["First and last part.", *BODY]),
        (f'<div data-id="ad" data-class="nav">{TEXT}</div>', BODY),
        (f'<article>{TEXT}</article><section class="comments">{TEXT * 5}</section>', BODY),
        (f'<article>{TEXT}</article><div class="cookie-notice">{TEXT}</div><div role="complementary">{TEXT}</div>', BODY),
        (f"<main><ul><li>one</li><li>two</li></ul>{TEXT}<ul><li>three</li></ul></main>{PLAIN}", ["one", "two", *BODY, "three"]),
        ("<div><a>only</a></div><div><a>links</a></div>", ["only", "links"]),
    ],
)
def test_html_surge_and_dive(page, want):
    assert html_text.main_text(f"<html><body>{page}</body></html>").split("\n") == want


def test_html_bounds_against_a_plain_version():
    rng = random.Random(7)
    for _ in range(300):
        w = [rng.choice([0, 0, 0, 3, 8, 30, 200]) for _ in range(rng.randint(0, 30))]
        sums = [sum(w[j] for j in range(len(w)) if abs(j - k) <= html_text.WINDOW) for k in range(len(w))]
        if not any(w):
            assert html_text.bounds(w) is None
            continue
        good = [k for k in range(len(w)) if w[k] >= min(html_text.EDGE, max(w)) and sums[k] >= min(html_text.SURGE, max(sums))]
        assert html_text.bounds(w) == ((good[0], good[-1]) if good else None)


def test_html_windows_cut_lines_on_every_page(spark, data):
    for p in read(spark, data, "pages").collect():
        weights = [x.weight for x in html_text.lines(p.html)]
        first, last = html_text.bounds(weights)
        assert first > 0 and last < len(weights) - 1


def test_html_pages(spark, data):
    pages = read(spark, data, "pages")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for p in pages.collect():
        body = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        words = re.sub(r"<[^>]+>", " ", body)
        import html

        assert got[p.page_id].text.split() == html.unescape(words).split() and got[p.page_id].n_chars == len(got[p.page_id].text)
    rows = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, "<p>hi</p>"), (3, "u", "<p>" * 5000 + "deep")], "page_id bigint, url string, html string")
    assert sorted(r.text for r in html_text.extract(rows).collect()) == ["", "", "deep", "hi"]
    assert html_text.extract(rows.where("false")).count() == 0


def test_html_never_fails():
    rng = random.Random(5)
    for _ in range(200):
        html_text.main_text("".join(rng.choice(["<p>", "</p>", "<", ">", "<!--", "-->", "a ", "&#x41;", "&bad;", '<a href="', "<script>", "</div>", "<article>", "</article>"]) for _ in range(40)))


LONG = "A sentence of the article that says something at some length, and then ends. "


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div>{}</div>"])
def test_html_comments_stay_out_of_short_articles(wrap):
    comments = "".join(f"<p>Reader {k} says a good deal about this and that, at more length than the article itself does.</p>" for k in range(20))
    for block in (f'<div class="comments">{comments}</div>', f'<section id="comments"><article>{comments}</article></section>', f"<form>{comments}</form>", f"<nav>{comments}</nav>"):
        page = f"<html><body>{wrap.format('<h1>Title</h1><p>One short sentence.</p>')}{block}</body></html>"
        assert html_text.main_text(page) == "Title\nOne short sentence."
    assert html_text.main_text(f'<body><div class="comments">{comments}</div></body>') == ""
    assert html_text.main_text(f'<body><div class="sidebar"><p>{LONG}</p></div></body>') == LONG.strip()  # a place, and nothing else is left


def test_html_names_inside_an_article_tell_what_it_is_about():
    kept = ['<p class="share-price">', '<p class="social-policy">', '<section class="related-work">', "<fieldset>", '<p class="ad-hoc">']
    gone = ['<div class="related-posts">', '<div class="share-buttons">', '<div class="comments-area">', '<div class="ad">', '<div class="widget">']
    for tag in (*kept, *gone):
        end = f"</{tag[1:].rstrip('>').split()[0]}>"
        page = f"<article><h1>Title</h1><p>{LONG}</p>{tag}Some words on it.{end}<p>{LONG}</p></article>"
        want = ["Title", LONG.strip(), *(["Some words on it."] if tag in kept else []), LONG.strip()]
        assert html_text.main_text(page) == "\n".join(want), tag
    assert html_text.main_text(f"<body><p>Yes.</p><p>{LONG}</p><p>{LONG}</p></body>").startswith("Yes.\n")
