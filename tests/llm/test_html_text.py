"""Main-text extraction on pages of several templates."""

from __future__ import annotations

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from memlake.llm import html_text as H

LONG = "This paragraph of the article holds quite a few plain words so that it reads like prose and not like a menu."
PAGES = {
    "article": (f"<html><head><title>T</title><script>if (a < b) document.write('<p>no</p>');</script><style>p{{}}</style></head><body>"
                f"<nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><header><h1>Site name</h1></header>"
                f"<article><h1>Head &amp; line</h1><p>{LONG}<br>second line<p>Short.</p><!-- <p>gone</p> -->"
                f"<div class=\"ad box\"><p>{LONG}</p></div><p>a&nbsp;b  \n c &lt;d&gt; &#233; &eacute</article>"
                f"<aside><p>{LONG}</p></aside><section id='comments'><article><p>{LONG}</p></article></section>"
                f"<form><p>{LONG}</p><input name=q></form><div class='cookie-notice'>{LONG}</div><div id='userCommentList'>{LONG}</div><footer>&copy; {LONG}</footer></body></html>",
                f"Head & line\n{LONG} second line\nShort.\na b c <d> é é"),
    "plain": (f"<body><div class=menu><a href=1>One</a> <a href=2>Two</a></div><div id=content><p>{LONG}</p><p>{LONG}</p></div>"
              f"<div class=sidebar>{LONG}</div><div><a href=3>Prev</a> <a href=4>Next</a></div>", f"{LONG}\n{LONG}"),
    "broken": (f"</div></p><article><p>{LONG}<b>bold</i></article></article><footer>end", f"{LONG}bold"),
    "none": ("<nav><a href=x>Home</a></nav><script>x", ""), "null": (None, ""), "empty": ("", ""),
}


def test_templates(spark):
    rows = [(i, k, h) for i, (k, (h, _)) in enumerate(PAGES.items())]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("old"))
    out = H.extract_text(df).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.text == PAGES[r.url][1], r.url
    assert H.extract_text(df.limit(0)).count() == 0


def test_real_pages_keep_every_paragraph_of_the_article(spark, sf_check):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_check}/pages.parquet").collect()}
    out = {r.page_id: r for r in H.op2_html_blocks(spark, sf_check).collect()}
    assert set(out) == set(pages)
    for i, page in pages.items():
        body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " " if "br" in body else "", p)).split())
                 for p in re.split(r"</?(?:p|h1)>", body.replace("<b>", "").replace("</b>", "").replace("<br>", " "))]
        assert out[i].text == "\n".join(p for p in parts if p)
        assert out[i].n_chars == len(out[i].text)


def test_very_long_and_deep_page():
    tree = H.grow()
    assert len(H.main_text("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>", tree)) == (len(LONG) + 1) * 20_000 - 1
    assert H.main_text("<div>" * 5000 + LONG, tree) == LONG


def test_tree_reproduces_its_training_table():
    tree = H.grow()
    assert all(H.judge(tree, row[:-1]) == row[-1] for row in H.TRAINING)


ARTICLE = f"<article><h1>Head</h1><p>{LONG}</p></article>"


@pytest.mark.parametrize("page", [
    f"<html><head><title>x</title><meta charset=u><body>{ARTICLE}", f"<head><title>x</title>{ARTICLE}", f"<nav><a href=x>Home</a>{ARTICLE}",
    f"<article><h1>Head</h1><svg class=i /><p>{LONG}</p></article>", f"<article><h1>Head</h1><button>Share<p>{LONG}</p></article>",
    f"<article><h1>Head</h1><svg-icon name=x><p>{LONG}</p></article>", f"<article><h1>Head</h1><iframe src=x /><p>{LONG}</p></article>",
    f"<div class='site has-sidebar'>{ARTICLE}</div>", f"<div class='content-sidebar-wrap'>{ARTICLE}<div class=sidebar>{LONG}</div></div>",
    f"<article class='post category-social comments-open'><h1>Head</h1><p>{LONG}</p></article>", f"<form id=aspnetForm>{ARTICLE}</form>",
    f"<div class='container no-sidebar'>{ARTICLE}</div>", f"<div class=sidebar><article><p>{LONG}</p></article></div>{ARTICLE}",
    f"<article><h1 title='a > b'>Head</h1 ><p data-x=\"<p>\">{LONG}</p></article><div class=related><article>{LONG}</article></div>",
])
def test_frames_and_unclosed_elements_do_not_hide_the_article(page):
    assert H.main_text(page, H.grow()) == f"Head\n{LONG}"


def test_paragraphs_beside_links():
    tree = H.grow()
    link = "<p><a href=x>See the earlier report</a></p>"
    for name in ("article", "div"):
        page = f"<{name}><h1>Head</h1><p>{LONG}</p><p>{LONG}</p>{link}<p>{LONG}</p></{name}>"
        assert H.main_text(page, tree) == "\n".join(["Head", LONG, LONG, "See the earlier report", LONG])
    page = f"<div><p>{LONG}</p><ul><li><a href=x>Ten tricks doctors hate</a><li><a href=y>One more trick to click</a></ul></div>"
    assert H.main_text(page, tree) == LONG


@pytest.mark.parametrize("piece", ["<a ", '<a "', '<a b="', "<p", "<!--", "</", "<title>", "<button>", "<div><p>x", "<nav>", "</p>", "<script/>",
                                   "<a href=x><div>", "<div></p>"])
def test_time_is_linear_in_the_page(piece):
    tree = H.grow()

    def took(size):
        start = time.process_time()
        H.main_text(piece * (size // len(piece)), tree)
        return time.process_time() - start
    took(20_000)
    assert took(400_000) < 40 * max(took(40_000), 0.02)


# A second implementation: tags and text in one pass over a list, zones and pairs by searching it, features by hand.
def plain_text(page, tree):
    page = re.sub(r"<!--.*?-->|<!doctype[^>]*>|<(script|style|title|textarea)\b.*?</\1>", "", page or "", flags=re.S | re.I)
    parts = re.findall(r"</?[a-zA-Z][^<>]*>|[^<]+", page)
    tags = [re.match(r"<(/?)([a-zA-Z0-9]+)", p) for p in parts]
    found, text, links, opened, href = [], "", "", [], False
    for p, tag in [*zip(parts, tags), ("<p>", re.match(r"<(/?)([a-z]+)", "<p>"))]:
        name = tag[2].lower() if tag else None
        if tag is None:
            text, links = text + p, links + (p if href else "")
        elif name == "a":
            href = not tag[1] and "href" in p
            links += " "
        elif name == "br":
            text, links = text + " ", links + " "
        elif name not in H._INLINE:
            words = html.unescape(text).split()
            if words:
                zones = [z for _, z in opened]
                found.append((" ".join(words), len(words), min(1.0, len(html.unescape(links).split()) / len(words)), max(zones, default=0)))
            text = links = ""
            if tag[1]:
                names = [n for n, _ in opened]
                if name in names:
                    del opened[len(names) - 1 - names[::-1].index(name):]
            elif name not in H._VOID:
                if name in ("p", "li") and opened and opened[-1][0] == name:
                    opened.pop()
                named = " ".join(re.findall(r"(?:class|id|role)=[\"']?([^\"'>]*)", p)) if name not in ("html", "body") else ""
                bad = name in H._FURNITURE or name == "head" or H._LAYOUT.search(named) or H._EXTRA.search(named)
                opened.append((name, 2 if bad else int(name in ("article", "main"))))
    edge = ("", 0, 0.0, 0)
    rows = zip([edge, *found], found, [*found[1:], edge])
    return "\n".join(b[0] for a, b, c in rows if H.judge(tree, (b[1], b[2], a[1], a[2], c[1], c[2], b[3])))


def test_real_pages_match_the_second_implementation(spark, sf_check):
    tree = H.grow()
    for r in H.op2_html_blocks(spark, sf_check).join(spark.read.parquet(f"{sf_check}/pages.parquet").select("page_id", "html"), "page_id").collect():
        assert r.text == plain_text(r.html, tree), r.page_id
