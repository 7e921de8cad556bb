import random

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import markup as U


def inner(html, selector):
    e = U.Elements(html)
    return [e.text[e.inner[i] : e.end[i]] for i in e.selected(U.parsed(selector))]


NESTED = '<div id="a"><div class="x y">one <div>two</div> three</div><p>four</p></div><div class=x>five</div>'


@pytest.mark.parametrize("html, selector, expected", [
    (NESTED, "#a", ['<div class="x y">one <div>two</div> three</div><p>four</p>']),
    (NESTED, "div div", ["one <div>two</div> three", "two"]),
    (NESTED, ".x", ["one <div>two</div> three", "five"]),
    (NESTED, "div.x.y div", ["two"]),
    (NESTED, "#a p, .x", ["one <div>two</div> three", "four", "five"]),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "ul ul", ["<li>b"]),
    ("<b>x</i></b></b><b>y", "b", ["x</i>", "y"]),
    ("<p>a<br/>b<img src='x.png'></p>", "p img", [""]),
    ("<td data-k='NAV (now)'>12</td><td data-k=\"other\">13</td>", "td[data-k*=NAV]", ["12"]),
    ("<td data-k='NAV (now)'>12</td>", '[data-k="NAV (now)"]', ["12"]),
    ("<a title='a > b'>t</a>", "a[title]", ["t"]),
    ("<script>var t='<p>no</p>'</script><!-- <p>no</p> --><style>p{}</style><p>yes</p>", "p", ["yes"]),
    ("<DIV CLASS='A'>t</Div>", "div.A", ["t"]),
    ("no markup < 3 > 2", "p", []), ("", "p", []), ("<p>", "p", [""]),
    ("<p>a<p>b</p>c</p>", "p", ["a<p>b</p>c", "b"]),
])
def test_selectors(html, selector, expected):
    assert inner(html, selector) == expected


@pytest.mark.parametrize("selector", ["", "p >", "p,,b", "..x", "p:first"])
def test_strange_selectors(selector):
    with pytest.raises(ValueError):
        U.parsed(selector)


def tree(rng, depth=0):
    """Random well-formed markup and its elements as (name, inner) in order."""
    out, found = [], []
    for _ in range(rng.randint(0, 4)):
        if depth < 5 and rng.random() < 0.6:
            name, (said, below) = rng.choice(["div", "p", "b"]), tree(rng, depth + 1)
            found += [(name, said), *below]
            out.append(f"<{name}>{said}</{name}>")
        else:
            out.append(rng.choice(["t", " ", "<br>"]))
            found += [("br", "")] if out[-1] == "<br>" else []
    return "".join(out), found


@pytest.mark.parametrize("seed", range(30))
def test_random_trees(seed):
    html, expected = tree(random.Random(seed))
    e = U.Elements(html)
    assert [(n, e.text[a:b]) for n, a, b in zip(e.names, e.inner, e.end, strict=True)] == expected


def test_columns(spark):
    df = spark.createDataFrame([(1, NESTED), (2, None), (3, "<nav><nav>a</nav>b</nav>c <a href='u&amp;v'>d</a><a>e</a>")], "id int, html string")
    got = {r["id"]: r for r in df.select("id", U.selected_text(F.col("html"), "div.x").alias("t"), U.selected_attribute(F.col("html"), "a", "href").alias("u"), U.first_selected(F.col("html"), ("h1", "p", "nav nav")).alias("f"), U.without_elements(F.col("html"), ("nav", "div.x")).alias("w")).collect()}
    assert got[1]["t"] == ["one two three", "five"] and got[1]["f"] == "four" and got[1]["w"]["html"] == '<div id="a"> <p>four</p></div> '
    assert [tuple(x) for x in got[1]["w"]["removed"]] == [("div.x", 2)]
    assert got[2]["t"] is None and got[2]["u"] is None and got[2]["f"] is None and got[2]["w"]["html"] is None
    assert got[3]["u"] == ["u&v"] and got[3]["w"]["html"] == " c <a href='u&amp;v'>d</a><a>e</a>" and [tuple(x) for x in got[3]["w"]["removed"]] == [("nav", 2)]


def test_many_levels():
    """Levels are running sums: 20,000 of them are no recursion."""
    e = U.Elements("<div>" * 20_000 + "x" + "</div>" * 20_000)
    assert len(e.names) == 20_000 and e.text[e.inner[-1] : e.end[-1]] == "x" and e.outer[0] == len(e.text)
