import html
import random
import re
import time

from corpusgraph.llm import html_text as H

SF = "/root/testdata/sf0.01"
LONG = "This paragraph holds enough plain words to be the article of a page. " * 3


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{body}</body></html>"


def test_what_is_not_the_article_stays_out():
    out = H.main_text(page(
        f"<header>top</header><nav><a href=x>Menu</a></nav><div class='cookie-notice'>{LONG}</div>"
        f"<div id=sidebar>{LONG}</div><article><h1>Head</h1><p>{LONG}<p><b>Bold<br>{LONG}"
        f"<script>var x='</p>';</script><style>p{{}}</style><form>{LONG}</form><div class=ad>{LONG}</div>"
        f"<ul><li>one<li>two</ul></article><section class='comments'>{LONG}</section><footer>&copy;</footer>"))
    text = " ".join(LONG.split())
    assert out == f"Head\n{text}\nBold {text}\none\ntwo"


def test_links_lower_a_nodes_density():
    links = "".join(f"<a href=/{i}>link text number {i} goes here</a> " for i in range(40))
    out = H.main_text(page(f"<div>{links}</div><div><p>{LONG}</p><p>{LONG}</p></div>"))
    assert out == "\n".join([" ".join(LONG.split())] * 2)


def test_references_space_and_damage():
    assert H.main_text(page("<p>a &amp; b&lt;c  &eacute;\n\t&#233;&amp</p>")) == "a & b<c é é&"
    assert H.main_text("<p>cut <b>off</b> he<a hre") == "cut off he"
    assert H.main_text("a < b <!-- never closed") == "a < b"
    assert H.main_text("plain text") == "plain text"
    assert H.main_text("<") == "<"
    for odd in (None, "", "<html>", "</p></div>", "<p>", "<!--x-->", "<script>x"):
        assert H.main_text(odd) == ""
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    assert H.main_text(deep) == "deep"
    began = time.time()
    for inner in ("<div>" * 200_000 + "deep", "<div>" * 100_000 + "</span>" * 100_000 + "deep",
                  "<p><table>" + "<div>" * 100_000 + "<td></td>" * 1000 + "deep",
                  "<li><ul>" + "<b>" * 50_000 + "<i></i></li>" * 50_000 + "deep"):
        assert H.main_text(inner) == "deep"
    assert time.time() - began < 30
    assert H.main_text("<p>" + "word " * 200_000) == " ".join(["word"] * 200_000)


def test_generated_pages_give_the_whole_article(spark):
    got = {r.page_id: r for r in H.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split())
                 for b in re.split(r"</?(?:h1|p|div)[^>]*>", inner)]
        want = "\n".join(p for p in parts if p)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_odd_rows(spark):
    rows = [(1, None, None, "c"), (1, None, None, "c"), (None, "u", "<p>x", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(tuple, H.extract(pages).collect()), key=str) == [
        (1, None, "", 0), (1, None, "", 0), (None, "u", "x", 1)]
    assert H.extract(pages.limit(0)).count() == 0


PARAGRAPH = "<p>" + "plain words of an article " * 19 + "and end.</p>"
WORDS = " ".join(re.sub("<[^>]*>", "", PARAGRAPH).split())
LINKS = "".join(f"<a href=/{i}>Link {i}</a>" for i in range(10))


def test_link_blocks_in_a_wrapper_fall_out():
    for inner in (f"<div>{LINKS}</div><div>{PARAGRAPH * 10}</div>", f"<div>{LINKS}</div>{PARAGRAPH * 10}",
                  f"{LINKS}<div>{PARAGRAPH * 10}</div>", f"<div>{PARAGRAPH * 10}</div><p>{LINKS}</p>"):
        for body in (inner, f"<div id=page>{inner}</div>", f"<div><div>{inner}</div></div>"):
            assert H.main_text(page(body)) == "\n".join([WORDS] * 10)


def test_all_parts_of_an_article_are_kept():
    part = f"<div><h2>Part</h2>{PARAGRAPH * 5}<p>Yes.</p></div>"
    want = "\n".join(["Part", *[WORDS] * 5, "Yes."])
    assert H.main_text(page(part * 2)) == f"{want}\n{want}"
    assert H.main_text(page(f"<h1>Head</h1>{part}<div>{LINKS}</div><div><div>{part}</div></div>")) == \
        f"Head\n{want}\n{want}"
    run = f"<div>{PARAGRAPH * 3}tail <i>in</i> <a href=x>a</a> run</div>"
    assert H.main_text(page(run * 2)) == "\n".join([*[WORDS] * 3, "tail in a run"] * 2)


def test_layout_around_the_article_stays_in():
    for wrap in ("div class='content has-sidebar'", "div class=no-sidebar", "div class=with-header",
                 "div id=search-page", "div class=legal", "form id=aspnetForm", "div class='page sideMenu'"):
        name = wrap.split()[0]
        assert H.main_text(page(f"<{wrap}><div>{PARAGRAPH * 3}</div></{name}><footer>x</footer>")) == \
            "\n".join([WORDS] * 3), wrap
    short = f"<div class=sidebar><article><p>Short.</p></article></div><div class=comments>{PARAGRAPH}</div><footer>{PARAGRAPH}</footer>"
    assert H.main_text(page(short)) == "Short."
    for mark in ("class='site-header'", "id=left-sidebar", "class='col comment-list'", "id=adBox1",
                 "role=complementary", "class=relatedPosts", "class=cookie-notice"):
        assert H.main_text(page(f"<div {mark}>{PARAGRAPH}</div><div>{PARAGRAPH * 3}</div>")) == \
            "\n".join([WORDS] * 3), mark


def test_formulas_stay_in():
    out = H.main_text(page(f"{PARAGRAPH}<p>Then <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p>"))
    assert out == f"{WORDS}\nThen x=1 holds."


POSTS = "".join(f"<div class=post><span>Reader {w}</span><time>May {i}</time><p>I think so too, {w}.</p></div>"
                for i, w in enumerate("one two three four five six seven eight nine ten".split()))


def test_unnamed_comments_stay_out():
    assert H.main_text(page(f"<article>{PARAGRAPH * 2}</article><div class=thread>{POSTS}</div>")) == \
        "\n".join([WORDS] * 2)
    assert H.main_text(page(f"<article><p>Short.</p></article><div>{PARAGRAPH}</div>")) == "Short."
    for body in (f"<div>{PARAGRAPH * 5}</div><div class=x1>{POSTS}</div>", f"<div>{PARAGRAPH * 5}{POSTS}</div>",
                 f"<article>{PARAGRAPH * 5}<section>{POSTS}</section></article>"):
        assert H.main_text(page(body)) == "\n".join([WORDS] * 5)
    # a list of steps is no thread, nor is a page of records alone
    steps = "".join(f"<div><b>Step {i}</b><p>Do it well.</p></div>" for i in range(4))
    assert H.main_text(page(f"<div>{PARAGRAPH * 3}{steps}</div>")).count("Do it well.") == 4
    assert "I think so too, ten." in H.main_text(page(f"<div>{POSTS}</div>"))


def test_a_heading_before_the_lone_article_goes_with_it():
    assert H.main_text(page(f"<p>Other words.</p><h1>Title</h1><div><article>{PARAGRAPH}</article></div><p>More.</p>")) == \
        f"Title\n{WORDS}"
    two = f"<article>{PARAGRAPH * 2}</article>"
    assert H.main_text(page(f"<div>{two}{two}</div>")) == "\n".join([WORDS] * 4)


def test_buttons_in_sentences_stay_in():
    out = H.main_text(page(f"<article><p>Press the <button>Start</button> key to begin.</p><p><button>Share</button></p>{PARAGRAPH}</article>"))
    assert out == f"Press the Start key to begin.\n{WORDS}"


def test_a_second_extractor_agrees_on_generated_shapes():
    """Pages put together from known parts; the wanted text comes from the parts."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    for n in range(150):
        want, inner = [], ""
        for _ in range(rng.randrange(2, 9)):
            words = [word() for _ in range(rng.randrange(30, 90))]
            tag, end = rng.choice([("p", ""), ("p", "</p>"), ("div", "</div>"), ("blockquote", "</blockquote>")])
            bold = rng.randrange(len(words))
            shown = [f"<b>{w}</b>" if i == bold else w for i, w in enumerate(words)]
            inner += f"<{tag}>{rng.choice(['', chr(10)])}" + rng.choice([" ", "\n  "]).join(shown) + end
            want.append(" ".join(words))
        wrap = rng.choice(["article", "div", "main", "section"])
        rest = f"<nav>{LINKS}</nav>", "<aside><p>side words here</p></aside>", "<footer>foot</footer>"
        body = rest[0] + f"<{wrap}>{inner}</{wrap}>" + rest[1] + (f"<div>{LINKS}</div>" if rng.random() < 0.5 else "") + rest[2]
        assert H.main_text(page(body)) == "\n".join(want), (n, body)
