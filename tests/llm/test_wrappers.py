"""Wrappers: alignment against plain enumeration, acceptance of what was aligned, and article text that stays whole."""

import random
from functools import reduce

import pytest
from pyspark.sql import SparkSession

from ebbtide.llm import html_wrappers as H

PAGES = "page_id long, url string, html string, host int, stream string"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").getOrCreate()


def wrapper(pages):
    return reduce(H.aligned, [H.bare(H.expression(p)[0]) for p in pages])


@pytest.mark.parametrize("pages,want", [
    (["<p>a</p>", "<p>b</p>"], "p(#)"),
    (["<p>a</p>", "<p>a</p>"], 'p(")'),
    (["<h1>t</h1><p>a</p>", "<h1>t</h1>"], 'h1(") p(")?'),
    (["<ul><li>a<li>b<li>c</ul>", "<ul><li>d</ul>"], "ul(li(#)+)"),
    (["<h2>a</h2><p>b</p><h2>c</h2><p>d</p>", "<h2>e</h2><p>f</p>"], "(h2(#) p(#))+"),
    (["<p>x</p><h2>a</h2><p>b</p><p>c</p><h2>d</h2><p>e</p>", "<p>y</p>"], "(p(#)+ h2(#))+? p(#)"),
    (["<div><p>x</p></div><div><h1>t</h1></div>", "<div><h1>u</h1></div>"], 'div(p("))? div(h1(#))'),
])
def test_expressions(pages, want):
    assert H.written_out(wrapper(pages)) == want
    assert all(H.accepts(wrapper(pages), H.expression(p)[0]) for p in pages)


def longest(x, y):
    """The greatest worth of a common subsequence, tried out."""
    if not x or not y:
        return 0
    here = (2 if x[0] == y[0] else 1) + longest(x[1:], y[1:]) if x[0][0] == y[0][0] else 0
    return max(here, longest(x[1:], y), longest(x, y[1:]))


@pytest.mark.parametrize("seed", range(20))
def test_alignment_is_the_best(seed):
    rng = random.Random(seed)
    x, y = ([(rng.choice("abc"), rng.choice("12")) for _ in range(rng.randrange(8))] for _ in range(2))
    for most in (250_000, 0):
        found = H.matches(x, y, most)
        assert all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:])) and all(x[i][0] == y[j][0] for i, j in found)
        if most:
            assert sum(2 if x[i] == y[j] else 1 for i, j in found) == longest(x, y)


def random_page(rng, depth=3):
    def body(d):
        if d == 0:
            return rng.choice(["one", "two", "three", "<b>four</b>"])
        parts = [rng.choice(["<p>%s</p>", "<div class='box'>%s</div>", "<section>%s</section>", "<h2>%s</h2>"]) % body(rng.choice([0, 0, d - 1])) for _ in range(rng.randrange(1, 6))]
        return "".join(parts * rng.choice([1, 1, 2]))

    return f"<html><body><nav>menu</nav>{body(depth)}</body></html>"


@pytest.mark.parametrize("seed", range(8))
def test_wrappers_lose_no_text(seed):
    rng = random.Random(seed)
    pages = [random_page(rng) for _ in range(12)]
    whole = wrapper(pages)

    def data(items):
        return sum(i[4] if i[0] == H.TEXT else data(i[3]) for i in items)

    assert data(whole) == sum(len(t) for p in pages for _, t in H.blocks(p))
    for p in pages:
        items, found = H.expression(p)
        assert sorted(k for i in items for k in i[6]) == list(range(len(found)))


def article(i, extra=""):
    return (
        f"<html><body><div><p>Sign up for the letter of the site</p></div><article><h1>Title {i}</h1><h2>Summary</h2><p>Text {i} of {i * i}</p>"
        f"<h2>References</h2><p>Book {i}</p><p>All rights reserved</p>{extra}</article></body></html>"
    )


@pytest.mark.parametrize("n", [1, 3, 6, 70, 200])
def test_repeated_headings_stay_on_hosts_of_any_size(spark, n):
    rows = [(i, "http://h/%d" % i, article(i), 1, "x") for i in range(n)] + [(1000 + i, "http://h/c", article(0), 1, "x") for i in range(5)]
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    want = lambda i: f"Title {i}\n\nSummary\n\nText {i} of {i * i}\n\nReferences\n\nBook {i}\n\nAll rights reserved"
    assert got == {i: want(i) for i in range(n)} | {1000 + i: want(0) for i in range(5)}
    (one,) = H.wrappers(df, batch=8).collect()
    assert one.pages == n and (n == 1 or one.expression == 'html(body(div(p(")) article(h1(#) (h2(") p(#))+ p("))))' or "article" in one.expression)


def test_constant_text_of_a_plain_container_stays(spark):
    page = lambda i: f"<html><body><div class='top'><p>Sign up here</p></div><div class='post'><h2>Summary</h2><p>Own text number {i} of this long page</p><p>The end of it</p></div></body></html>"
    df = spark.createDataFrame([(i, "http://p/%d" % i, page(i), 1, "x") for i in range(9)], PAGES)
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    assert got == {i: f"Summary\n\nOwn text number {i} of this long page\n\nThe end of it" for i in range(9)}


def test_a_page_without_the_main_node_loses_template_only(spark):
    rows = [(i, "http://h/%d" % i, article(i), 1, "x") for i in range(9)]
    rows.append((50, "http://h/e", "<html><body><div><p>Sign up for the letter of the site</p></div><p>No page here</p></body></html>", 1, "x"))
    rows.append((51, "http://h/f", "<html><body><div><p>Sign up for the letter of the site</p></div></body></html>", 1, "x"))
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[50] == "No page here" and got[51] == "Sign up for the letter of the site" and got[3].startswith("Title 3\n\nSummary")


def test_wrappers_do_not_depend_on_partitions(spark):
    rng = random.Random(9)
    rows = [(i, f"http://{rng.choice('abc')}/", random_page(rng), 1, "x") for i in range(90)] + [(900, None, None, 1, "x"), (901, None, "", 1, "x")]
    df = spark.createDataFrame(rows, PAGES)
    one, two = ({r.host: (r.pages, r.expression) for r in H.wrappers(df.repartition(k), batch=8).collect()} for k in (1, 7))
    assert one == two and set(one) == {"a", "b", "c", ""}
