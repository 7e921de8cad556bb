"""HTML columns: visible text, boilerplate, attributes, titles; and a parser-based function for nested or broken markup."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import collapse, strip_noise

#: Elements that are dropped with their content. Fixed values.
BOILERPLATE = ("script", "style", "nav", "header", "footer", "aside", "iframe", "noscript", "meta")
KEPT_ATTRIBUTES = ("href", "src", "alt", "title")
VOID = ("meta",)


def element(tag: str) -> str:
    return rf"(?is)<{tag}\b[^>]*>" if tag in VOID else rf"(?is)<{tag}\b.*?</{tag}>"


def removed_counts(html: Column, tags: tuple[str, ...] = BOILERPLATE) -> Column:
    """Text such as ``script:1,nav:1`` for the elements that are there."""
    counts = F.array(*(F.struct(F.lit(t).alias("tag"), F.regexp_count(html, F.lit(element(t))).alias("n")) for t in tags))
    return F.array_join(F.transform(F.filter(counts, lambda c: c["n"] > 0), lambda c: F.concat_ws(":", c["tag"], c["n"])), ",")


def without_boilerplate(html: Column, tags: tuple[str, ...] = BOILERPLATE) -> Column:
    for t in tags:
        html = F.regexp_replace(html, element(t), " ")
    return html


def without_tags(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")


def visible_text(html: Column, tags: tuple[str, ...] = BOILERPLATE) -> Column:
    """Text outside tags and dropped elements, entities as blanks, white space collapsed."""
    return collapse(F.regexp_replace(without_tags(without_boilerplate(html, tags)), r"&[a-zA-Z0-9#]+;", " "))


#: An attribute's value, and tags with the text between them.
VALUE, PIECES = r"""\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""", r"<[^>]*>|[^<]+|<"


def attribute_pattern(keep: tuple[str, ...] = KEPT_ATTRIBUTES) -> str:
    """Any attribute of a tag; its first group holds those to keep."""
    return rf"(?i)(\s+(?:{'|'.join(keep)}){VALUE})|\s+[a-z_:][-\w:.]*(?:{VALUE})?"


def pruned_attributes(html: Column, keep: tuple[str, ...] = KEPT_ATTRIBUTES) -> Column:
    """Tags without attributes other than the kept ones, whose values stay whole; comments and text stay."""
    pieces = F.regexp_extract_all(html, F.lit(PIECES), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^<[^!]"), F.regexp_replace(p, attribute_pattern(keep), "$1")).otherwise(p)), "")


def first_element(html: Column, tag: str) -> Column:
    return F.nullif(collapse(without_tags(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))), F.lit(""))


def heading(html: Column, default: str = "Untitled") -> Column:
    """First h1 of more than 3 characters, else the title without a site suffix, else a default."""
    h1, title = first_element(html, "h1"), first_element(html, "title")
    return F.coalesce(F.when(F.length(h1) > 3, h1), F.nullif(F.trim(F.regexp_replace(title, r"\s*[-|]\s*[^-|]*$", "")), F.lit("")), title, F.lit(default))


def attribute(html: Column, tag: str, name: str) -> Column:
    return F.nullif(F.regexp_extract(html, rf"""(?is)<{tag}\b[^>]*\b{name}="([^"]*)\"""", 1), F.lit(""))


def by_selector(html: Column, name: str, value: str) -> Column:
    """Text of the first element with this attribute."""
    return F.nullif(collapse(F.regexp_extract(html, rf"""(?is)<[^>]*\b{name}="{value}"[^>]*>([^<]*)""", 1)), F.lit(""))


def first_of(html: Column, selectors: tuple[tuple[str, str], ...]) -> Column:
    """First selector that yields text."""
    return F.coalesce(*(by_selector(html, n, v) for n, v in selectors))


def described(html: Column, classes: tuple[str, ...] = ("fund-description", "description", "about-fund"), least: int = 50) -> Column:
    """Text of the first element whose class holds one of the words, if it has more than ``least`` characters."""
    texts = (collapse(F.regexp_extract(html, rf"""(?is)<[^>]*\bclass="[^"]*{c}[^"]*"[^>]*>([^<]*)""", 1)) for c in classes)
    return F.coalesce(*(F.when(F.length(t) > least, t) for t in texts))


def clean_page(html: Column) -> Column:
    """Struct of original_length, cleaned_length, removed and text."""
    text = strip_noise(visible_text(html))
    return F.struct(F.length(html).alias("original_length"), F.length(text).alias("cleaned_length"), removed_counts(html).alias("removed"), text.alias("text"))


class _Text(HTMLParser):
    def __init__(self, drop: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.drop, self.depth, self.parts = drop, 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.drop and tag not in VOID

    def handle_endtag(self, tag):
        self.depth -= self.depth > 0 and tag in self.drop

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.parts.append(data.strip())


@F.pandas_udf(StringType())
def parsed_text(html: pd.Series) -> pd.Series:
    """Visible text by a tolerant parser; nested elements of one name are dropped as a whole."""

    def one(x):
        if x is None:
            return None
        p = _Text(frozenset(BOILERPLATE))
        p.feed(x)
        p.close()
        return " ".join(" ".join(p.parts).split())

    return html.map(one)
