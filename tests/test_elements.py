"""Whole elements against a small recursive reader, and rows around positions."""

import random
import time

import pytest
from pyspark.sql import functions as F

from listingmill.sources.elements import attributes, css, cut, element_text, elements, link_to, markup, row_spans


@pytest.fixture()
def found(spark):
    def run(html, tag, attrs=""):
        df = spark.createDataFrame([(html,)], "html string").select(markup(F.col("html")).alias("p"))
        spans = elements(F.col("p"), F.lit(tag), F.lit(attrs))
        return df.select(F.transform(spans, lambda s: cut(F.col("p"), s)).alias("r")).first().r

    return run


def test_nested_blocks_are_whole(found):
    html = '<div class="a x"><div>1<div>2</div></div>3</div>4<div class="b"><div class="a">5</div></div>'
    assert found(html, "div", attributes(css("a"))) == ['<div class="a x"><div>1<div>2</div></div>3', '<div class="a">5']
    assert found(html, "div", attributes(css("x"), css("a"))) == ['<div class="a x"><div>1<div>2</div></div>3']
    assert found("<DIV class=a>1</DIV><div class=ab>2</div><div class='c a-b'>3</div>", "div", attributes(css("a"))) == ["<DIV class=a>1"]
    assert found("<!-- <p>no</p> --><script>if (a<p) x</script><p>yes", "p") == ["<p>yes"]
    assert found("", "div") == [] and found("</div></div><div>x", "div") == ["<div>x"] and found("a<b>c", "") == ["a<b>c"]


def test_elements_without_end_tags(found):
    html = "<table><tr><td>1<td>2<table><tr><td>3</td></tr></table>4</td><tr><td>5</table><td>6"
    assert found(html, "td") == ["<td>1", "<td>2<table><tr><td>3</td></tr></table>4", "<td>5", "<td>6"]
    assert found(html, "tr") == ["<tr><td>1<td>2<table><tr><td>3</td></tr></table>4</td>", "<tr><td>5"]
    assert found("<ul><li>1<ul><li>2</ul><li>3</ul>", "li") == ["<li>1<ul><li>2</ul>", "<li>3"]


def test_random_trees(spark):
    rng = random.Random(5)

    def tree(depth):
        name = rng.choice(("div", "span", "b"))
        inner = "".join(tree(depth - 1) if depth and rng.random() < 0.6 else rng.choice(("t", "x ")) for _ in range(rng.randint(0, 3)))
        return f"<{name} class={rng.choice('kl')}>{inner}</{name}>"

    def brute(html):
        out, at = [], 0
        while (start := html.find("<div class=k>", at)) >= 0:
            depth, at = 0, start
            while True:
                opened, closed = html.find("<div", at + 1), html.find("</div>", at + 1)
                depth, at = (depth + 1, opened) if 0 <= opened < closed else (depth - 1, closed)
                if depth < 0:
                    break
            out.append(html[start:at])
        return out

    pages = ["".join(tree(5) for _ in range(4)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string").withColumn("p", markup(F.col("html")))
    spans = elements(F.col("p"), F.lit("div"), F.lit(attributes(css("k"))))
    got = df.select("i", F.transform(spans, lambda s: cut(F.col("p"), s)).alias("r")).collect()
    assert {r.i: r.r for r in got} == {i: brute(html) for i, html in enumerate(pages)}


def test_a_long_page_takes_linear_time(spark):
    def seconds(n):
        html = "<div class=k><div>x</div></div>" + "<div><p>y</p></div>" * n
        df = spark.createDataFrame([(html,)], "html string").select(markup(F.col("html")).alias("p"))
        start = time.perf_counter()
        assert df.select(F.size(elements(F.col("p"), F.lit("div"), F.lit(attributes(css("k"))))).alias("n")).first().n == 1
        return time.perf_counter() - start

    seconds(100)
    assert seconds(80_000) < 30 * max(seconds(8_000), 0.1)


def test_rows_around_positions(spark):
    html = "<a>0</a><table><tr><td><a>1</a><table><tr><td><a>2</a></td></tr><a>3</a></table><a>4</a><td>d</td></tr><tr><a>5</a></table>"
    pages = spark.createDataFrame([(7, html), (None, html)], "page_id long, html string").withColumn("parts", markup(F.col("html")))
    links = pages.select("page_id", F.explode(elements(F.col("parts"), F.lit("a"), F.lit(""))).alias("s")).select("page_id", "s.a")
    joined = row_spans(pages, links).join(pages, "page_id")
    text = {r.a: r.t for r in joined.select("a", element_text(cut(F.col("parts"), F.col("row"))).alias("t")).collect()}
    assert [text[k] for k in sorted(text)] == [None, "1234d", "2", None, "1234d", "5"]


def test_links_quoted_or_not(spark):
    df = spark.createDataFrame([("<a href=../x/1.php>t</a>",), ("<a class=c href='/x/2.php?a b'>",), ('<a HREF = "x/3.php" id=q>',), ("<a data-href='/x/4'>",)], "h string")
    got = [r.u for r in df.select(F.regexp_extract("h", link_to(r"x/\d"), 1).alias("u")).collect()]
    assert got == ["../x/1.php", "/x/2.php?a b", "x/3.php", ""]
