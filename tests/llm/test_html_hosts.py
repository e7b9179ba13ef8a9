"""Main text where one page can't tell it: broken markup, deep pages, what a host's pages say together."""

import time

import pytest
from pyspark.sql import functions as F

from lodeweave.llm import html_text

TEXT = "<h1>Head</h1><p>Words of it. And more.</p>"


def alone(html):
    return html_text.Page(html).text([])


def texts(spark, bodies, host="http://host.org/"):
    rows = [(i, f"{host}{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    return [r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).orderBy("page_id").collect()]


def test_links_end_with_their_block():
    assert alone("<body><article><a name=top><h1>Head</h1><p>Text here. More of it.</p></article></body>") == "Head Text here. More of it."
    assert alone("<article><p><a href=x>All of it is a link. Yes.</a></p></article>") == "All of it is a link. Yes."
    assert alone("<nav><a href=x>only</a></nav>") == "only"


def test_quotes_that_do_not_close_end_at_the_tag():
    assert alone('Alpha <a title="x>broken text') == "Alpha broken text"
    assert alone("One <b class='x>two</b> three. <i>Four</i>.") == "One two three. Four."
    assert alone('<p title="a > b">Not cut. Here.</p>') == "Not cut. Here." and alone("Tail <p class=") == "Tail"


def test_hints_need_the_others_to_hold_the_text():
    report = "Prices rose a lot today. They did. Very much so. " * 3
    assert alone(f"<article><p>Some words.</p><div class=share-price-report>{report}</div></article>") == f"Some words. {report.strip()}"
    assert alone(f"<div class=post>{TEXT}</div><div class=site-footer>Rights. Us.</div><div class=main-nav>A. B.</div><div id=gdpr-bar>We do.</div>") == "Head Words of it. And more."
    assert alone(f"<div class=page-header><h1>Head</h1></div><div>{report}</div>").startswith("Head Prices")


@pytest.mark.parametrize("unit", ["<div>word one. ", "<ul><li>word one. ", '<a "', '<a ">"', "</p></x><div>", "<p", "<!--", "&amp;<b>"])
def test_time_grows_with_the_length(unit):
    began = time.process_time()
    page = html_text.Page(unit * (1_000_000 // len(unit)))
    page.text([1, 2])
    page.hinted()
    assert time.process_time() - began < 20


def test_hosts_know_their_footers_and_comments(spark):
    bodies, want = [], []
    for i in range(10):
        story = f"Story {i} goes like this. " * (4 + i) + f"It ends at {i * 37}."
        foot = "<div class=foot><p>All rights reserved. Contact us today. " + "Terms and more terms. " * 3 + "</p></div>"
        talk = f"<div class=post-comments><p>I liked number {i}. Very much.</p></div><ul class=commentlist><li>Me too, {i}. Yes.</li></ul>"
        bodies.append(f"<div class=top><p>The daily paper of all. Est. 1900.</p></div><div class='post p{i}'><h1>Head {i}</h1><p>{story}</p></div>{talk}{foot}")
        want.append(f"Head {i} {story}")
    assert texts(spark, bodies) == want
    # a page of its own host has only its own word for it: the foot stays, the comments go
    one = texts(spark, bodies[:1], "http://other.org/")[0]
    assert want[0] in one and "All rights" in one and "liked" not in one


def test_mirrored_articles_are_no_boilerplate(spark):
    story = "<div class=body><h1>Head</h1><p>" + "A story that many pages have. " * 8 + "</p><div class=note><p>With a note. Of it.</p></div></div>"
    want = "Head " + "A story that many pages have. " * 8 + "With a note. Of it."
    copies = texts(spark, [story] * 8 + ["<div class=body><p>Another one. It is.</p></div>"])
    assert copies == [want] * 8 + ["Another one. It is."]
    in_article = [f"<article><p>Story {i}. {'Much of it. ' * 9}</p><div class=box><p>Written by us. All of it.</p></div></article>" for i in range(6)]
    assert all(t.endswith("Written by us. All of it.") for t in texts(spark, in_article))


def test_rows_of_any_kind(spark):
    html = f"<body>{TEXT}</body>"
    rows = [(None, "http://a.b/", html), (1, None, html), (1, None, html), (2, "http://a.b/", "<div>" * 30000 + "x" * 300000), (3, "", " \n ")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("dropped", F.lit("own"))).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 27), ("1", 27), ("2", 300000), ("3", 0), ("None", 27)]
