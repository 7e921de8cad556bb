"""Golden rows for text, HTML, extraction and checks, worked out by hand or by Python twins."""

import re

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import checks as C
from corpusflow.functions import extract as E
from corpusflow.functions import html as H
from corpusflow.functions import text as T

TEXTS = ["", "plain", "aaaaab  b", "no no no no yes", "Éé éé éé éé x", "one. two! three? four.", "a\n\nb\tc", "mail me@x.org or https://a.b/c?d now", "₹1,250.75 and 12.5 %", "x" * 500, "navigation nav NAV", None]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")


def values(df, column):
    return [r[0] for r in df.orderBy("id").select(column.alias("v")).collect()]


def twin(f):
    return [None if t is None else f(t) for t in TEXTS]


def test_squashing_equals_python(texts):
    assert values(texts, T.squash_characters(F.col("t"))) == twin(lambda t: re.sub(r"(.)\1{3,}", r"\1", t))
    assert values(texts, T.squash_words(F.col("t"))) == twin(lambda t: re.sub(r"\b(\w+)(?:\s+\1){2,}\b", r"\1", t))


def test_tokens_and_sentences_equal_python(texts):
    assert values(texts, T.plain_tokens(F.col("t"))) == twin(lambda t: re.sub(r"[^a-z0-9\s]", " ", t.lower()).split())
    assert values(texts, T.query_tokens(F.col("t"))) == twin(lambda t: [w for w in re.sub(r"[^a-z0-9\s%.-]", " ", t.lower()).split() if len(w) >= 3])
    assert values(texts, T.first_sentences(F.col("t"))) == twin(lambda t: " ".join([p.strip() for p in re.split(r"(?<=[.!?])\s+", t.strip()) if p.strip()][:3]))
    assert values(texts, T.token_estimate(F.col("t"))) == [0 if not t else max(1, len(t) // 4) for t in TEXTS]


def test_boundary_cut_equals_python(texts):
    def cut(t, most):
        size = lambda x: 0 if not x else max(1, len(x) // 4)
        if size(t) <= most:
            return t
        for p in T.BOUNDARIES:
            parts = re.split(p, t, maxsplit=1)
            if len(parts) > 1 and size(parts[0]) <= most:
                return parts[0]
        return " ".join(t.split()[:most])

    for most in (1, 2, 4):
        assert values(texts, T.boundary_cut(F.col("t"), most)) == twin(lambda t, m=most: cut(t, m))


def test_abbreviations_are_whole_words(texts):
    assert values(texts, T.expand_abbreviations(F.col("t")))[10] == "navigation net asset value net asset value"
    assert values(texts, T.expand_abbreviations(F.col("t"), whole_words=False))[10].startswith("net asset valueigation")


def test_redaction_and_availability(spark, texts):
    assert values(texts, T.redact(F.col("t")))[7] == "mail [EMAIL] or [URL] now"
    rows = spark.createDataFrame([("Not available",), ("",), (" N/A ",), ("0",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.available(F.col("t"))).collect()] == [False, False, False, True, False]


def test_field_cleaning(spark):
    row = spark.createDataFrame([("  Large-Cap   Fund ", "  1.25%  ", "  ₹500  ", " very  high")], "name string, expense_ratio string, min_sip string, riskometer string")
    got = row.select(*(T.clean_field(c, F.col(c)).alias(c) for c in row.columns)).first()
    assert tuple(got) == ("Large - Cap Fund", "1.25%", "₹500", "Very High")


PAGE = """<html lang="en"><head><title>Alpha Fund - Site</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href="/x">menu</a></nav><!-- note --><h1 class="big" id="h">Alpha Fund</h1>
<p data-testid="nav">NAV: 29 May '26 ₹1,433.27</p><p>Expense ratio 0.79%</p><p>Exit load of 1%, if redeemed</p><p>Min. for SIP ₹100</p><p>Risk: Moderately Low</p><p>Benchmark: Nifty 500 TRI</p><p>25.46 % 3Y annualised &amp; -2.5% 1Y</p>
<p>Fund size (AUM) ₹85,357.92 Cr</p><table><tr><td>Equity</td><td>85.2%</td></tr><tr><td>Debt</td><td>10.5%</td></tr></table></body></html>"""


def test_page(spark):
    page = spark.createDataFrame([(PAGE,)], "h string")
    text = page.select(H.visible_text(F.col("h")).alias("t")).first()["t"]
    assert "menu" not in text and "note" not in text and "var" not in text and "Alpha Fund" in text
    fields = page.select(H.visible_text(F.col("h")).alias("t")).select(*(c.alias(n) for n, c in E.parsed_page(F.col("t")).items())).first()
    assert fields["nav"] == "₹1433.27" and fields["expense_ratio"] == "0.79%" and fields["exit_load"] == "1%" and fields["min_sip"] == "₹100"
    assert fields["riskometer"] == "Moderately Low" and fields["benchmark"].startswith("Nifty 500 TRI") and fields["aum"] == "₹85357.92"
    assert fields["return_3y"] == "25.46%" and fields["return_1y"] == "-2.5%" and fields["return_5y"] is None
    got = page.select(H.heading(F.col("h")), H.attribute(F.col("h"), "html", "lang"), H.by_selector(F.col("h"), "data-testid", "nav"), H.removed_counts(F.col("h")), E.allocation(F.col("h"))).first()
    assert got[0] == "Alpha Fund" and got[1] == "en" and got[2].startswith("NAV: 29 May") and got[3] == "script:1,style:1,nav:1" and got[4] == {"equity": 85.2, "debt": 10.5}
    pruned = page.select(H.pruned_attributes(F.col("h"))).first()[0]
    assert '<a href="/x">' in pruned and "<h1>" in pruned and "data-testid" not in pruned


def test_kept_attributes_stay_whole(spark):
    html = "<a class='x y' title=\"two words\" href=/u data-k disabled>a b=c</a> <!-- x y=z --> 1 < 2 <br/><img ALT='it is' width=3>"
    got = spark.createDataFrame([(html,)], "h string").select(H.pruned_attributes(F.col("h"))).first()[0]
    assert got == "<a title=\"two words\" href=/u>a b=c</a> <!-- x y=z --> 1 < 2 <br/><img ALT='it is'>"


def test_parser_handles_nesting(spark):
    page = spark.createDataFrame([("<div><nav>a<nav>b</nav>c</nav>d &amp; e<script>x</script></div>",), (None,)], "h string")
    assert [r[0] for r in page.select(H.parsed_text("h")).collect()] == ["d & e", None]


def test_no_load_and_order_of_rules(spark):
    rows = spark.createDataFrame([("Exit Load: Nil",), ("no exit load",), ("Exit load 1% but Nil",), ("nothing",)], "t string")
    assert [r[0] for r in rows.select(E.exit_load(F.col("t"))).collect()] == ["Nil", "Nil", "1%", None]


LABELLED = """Fund Name: Alpha Growth
Scheme direct growth in equity
Expense Ratio: 0.79 %
No exit load
Minimum SIP: ₹500
NAV: ₹1,433
Risk level: very high"""


def test_text_rules(spark):
    """First rule that matches and passes its check; line breaks become blanks first, so open-ended rules run to the end."""
    tail = "\nequity: 61.0% debt: 34 % others: 3%\n1Y: 12.5 % 3Y: -300 5 year return: 9"
    df = spark.createDataFrame([(1, LABELLED), (2, "nothing here"), (3, LABELLED.replace("Fund Name: ", "") + tail), (4, None)], "id int, t string")
    a, b, c, d = E.extracted(df, T.tidied(F.col("t"))).orderBy("id").collect()
    assert a["name"].startswith("Alpha Growth Scheme") and a["category"] == "Equity" and a["expense_ratio"] == "0.79%" and a["exit_load"] == "No Exit Load"
    assert a["min_sip"] == "₹500" and a["nav"] == "₹1,433" and a["riskometer"] == "Very High" and a["type"] is None and a["benchmark"] is None
    assert a["validation_status"] == "passed" and a["returns"] == {} and a["extraction_confidence"] == 100.0
    assert b["validation_status"] == "failed" and b["extraction_confidence"] == -55.0 and d["name"] is None
    assert c["name"] is None and c["allocation"] == {"equity": "62.2%", "debt": "34.7%", "others": "3.1%"} and c["returns"] == {"1Y": "12.5%", "5Y": "9%"}


def test_generic_rules_are_off_unless_asked_for(spark):
    df = spark.createDataFrame([("about ₹2,500 or so",)], "t string")
    plain, generic = (df.select(*(c.alias(k) for k, c in E.text_fields(F.col("t"), generic=g).items())).first() for g in (False, True))
    assert plain["expense_ratio"] is None and generic["expense_ratio"] == "2%" and plain["nav"] is None and generic["nav"] == "₹2,500"


def test_field_kinds():
    assert [T.field_kind(n) for n in ("fund_name", "Expense_Ratio", "return_1y", "min_sip", "nav", "category", "text")] == ["title", "percent", "percent", "amount", "amount", "label", "text"]


def test_checks(spark):
    df = spark.createDataFrame([("1.25%", "₹500", "Low", "https://x.org/a", "Fund A", "2024-01-01 12:00:00"), ("9%", "₹5", "Odd", "ftp://x", "x", "1.1.2024"), ("abc", "500", None, None, None, None)], "p string, c string, e string, u string, t string, d string")
    scores = lambda col: [None if r[0] is None else (r[0]["score"], r[0]["failed"], r[0]["warning"]) for r in df.select(col).collect()]
    assert scores(C.percentage(F.col("p"), 0, 5)) == [(100, False, False), (50, True, False), (0, True, False)]
    assert scores(C.currency(F.col("c"), 100, 1000)) == [(100, False, False), (75, False, True), (0, True, False)]
    assert scores(C.url(F.col("u"), ("x.org",)))[:2] == [(100, False, False), (0, True, False)]
    assert scores(C.text(F.col("t"), 3, 100, forbidden=("fund",)))[:2] == [(50, False, True), (0, True, False)]
    assert scores(C.timestamp(F.col("d")))[:2] == [(100, False, False), (0, True, False)]
    maps = spark.createDataFrame([({"1Y": "12.5%", "3Y": "-60%"},), ({},)], "m map<string,string>")
    assert [r[0]["score"] for r in maps.select(C.percentage_map(F.col("m"), ("1Y", "3Y", "5Y"))).collect()] == [75.0, 75.0]
    shares = spark.createDataFrame([({"equity": 85.2, "debt": 10.5, "cash": 4.3},), ({"equity": 60.0},), ({"equity": 97.0},)], "m map<string,double>")
    assert [r[0]["score"] for r in shares.select(C.allocation_map(F.col("m"))).collect()] == [100, 75, 100]
    assert shares.select(C.renormalised(F.col("m"))).collect()[2][0] == {"equity": 100.0}


def test_freshness(spark):
    df = spark.createDataFrame([(1, "2024-01-09"), (2, "2024-01-03"), (3, "2023-12-20"), (4, "2023-01-01"), (5, None)], "id int, d string")
    got = df.orderBy("id").select(C.freshness(F.to_timestamp(F.lit("2024-01-10")), F.to_timestamp("d"))).collect()
    assert [r[0] for r in got] == ["fresh", "recent", "acceptable", "stale", "unknown"]


def test_unicode_forms_and_title_case(spark):
    import unicodedata

    some = ["ﬁne ①", "plain", "", None, "Å", "mid-cap 3rd o'x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "id int, t string")
    assert values(df, T.nfkc(F.col("t"))) == [None if t is None else unicodedata.normalize("NFKC", t) for t in some]
    assert values(df, T.title_case(F.col("t"))) == [None if t is None else t.title() for t in some]
    assert values(df, T.title_words(F.col("t"), ("cap",)))[5] == "Mid-cap 3rd o'x"
