"""Elements of nested markup: a stream of tags with depths by running sums, elements as spans, selectors as containment of spans.

Scripts, styles and comments are taken out first. Tags of one name open and close levels: the running sum of openings and
closings gives each tag its level, and an opening tag's element ends at the next closing tag of its name and level, which
skips whatever is nested in between. An element that is never closed ends with the text; a closing tag without an opening
one is no element; void and self-closing tags are empty elements.

A selector is ``tag``, ``.class``, ``#id``, ``[name]``, ``[name=value]``, ``[name*=part]`` or several of these without a blank,
after blanks for elements inside others (``article p.lead``), and commas between alternatives.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .html import without_tags
from .text import collapse

#: What is no markup, a tag, one of its attributes, and elements without content. Fixed values.
RAW = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
TAG = r"""<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:"[^"]*"|'[^']*'|[^'">])*)>"""
ATTRIBUTE = r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?"""
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")

SIMPLE = re.compile(r"""([.#]?)([a-zA-Z_][-\w]*)|\[\s*([-\w:]+)\s*(?:(\*?=)\s*"?([^"\]]*)"?)?\s*\]""")
Compound = list[tuple[str, str, str]]  # kind (tag, class, has, equals, holds), name, value


def parsed(selector: str) -> list[list[Compound]]:
    """Alternatives, each a list of compounds from the outermost to the element itself."""
    found = []
    for alternative in re.split(r",(?![^\[]*\])", selector):
        chain = []
        for word in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", alternative):
            parts, at = [], 0
            for m in SIMPLE.finditer(word):
                if m.start() != at:
                    break
                at = m.end()
                sign, name, attribute, relation, value = m.groups()
                if attribute:
                    parts.append(({"=": "equals", "*=": "holds", None: "has"}[relation], attribute.lower(), value or ""))
                else:
                    parts.append({"": ("tag", name.lower(), ""), ".": ("class", "class", name), "#": ("equals", "id", name)}[sign])
            if at != len(word):
                raise ValueError(f"not a selector: {selector}")
            chain.append(parts)
        if not chain:
            raise ValueError(f"not a selector: {selector}")
        found.append(chain)
    return found


class Elements:
    """The elements of one text in the order of their opening tags."""

    def __init__(self, html: str):
        self.text = re.sub(RAW, "", html)
        tags = list(re.finditer(TAG, self.text))
        name = [m[2].lower() for m in tags]
        closing = np.array([bool(m[1]) for m in tags], bool)
        empty = np.array([n in VOID or m[3].endswith("/") for n, m in zip(name, tags, strict=True)], bool) & ~closing
        _, number = np.unique(np.array(name, dtype=object) if name else np.zeros(0, int), return_inverse=True)
        before, behind = (np.array([f(m) for m in tags], np.int64) for f in (re.Match.start, re.Match.end))
        # Levels by running sums within each name; a closing tag has the level that it ends.
        paired = np.flatnonzero(~empty)
        paired = paired[np.argsort(number[paired], kind="stable")]
        step = np.where(closing[paired], -1, 1)
        total = np.cumsum(step)
        first = np.searchsorted(number[paired], number[paired], "left")
        level = total - (total[first] - step[first]) + closing[paired]
        order = np.lexsort((paired, level, number[paired]))
        row, level = paired[order], level[order]
        end, outer = np.full(len(tags), len(self.text)), np.full(len(tags), len(self.text))
        if len(row) > 1:
            follows = (number[row[1:]] == number[row[:-1]]) & (level[1:] == level[:-1]) & closing[row[1:]] & ~closing[row[:-1]]
            opened, closed = row[:-1][follows], row[1:][follows]
            end[opened], outer[opened] = before[closed], behind[closed]
        end[empty] = outer[empty] = behind[empty]
        own = np.flatnonzero(~closing)
        self.tags, self.names = [tags[i] for i in own], [name[i] for i in own]
        self.start, self.inner, self.end, self.outer = before[own], behind[own], end[own], outer[own]
        self.known: dict[int, dict[str, str]] = {}

    def attributes(self, i: int) -> dict[str, str]:
        if i not in self.known:
            found: dict[str, str] = {}
            for m in re.finditer(ATTRIBUTE, self.tags[i][3]):
                found.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
            self.known[i] = found
        return self.known[i]

    def _is(self, i: int, compound: Compound) -> bool:
        for kind, name, value in compound:
            if kind == "tag":
                if self.names[i] != name:
                    return False
                continue
            held = self.attributes(i).get(name)
            if held is None or kind == "class" and value not in held.split() or kind == "equals" and held != value or kind == "holds" and value not in held:
                return False
        return True

    def selected(self, alternatives: list[list[Compound]]) -> np.ndarray:
        """Numbers of the elements, rising."""
        hit = np.zeros(len(self.names), bool)
        for chain in alternatives:
            inside = np.ones(len(self.names), bool)
            for compound in chain:
                held = np.array([bool(inside[i]) and self._is(i, compound) for i in range(len(self.names))], bool)
                # An element is in one of these if the furthest end of those that open before it lies behind its start.
                reach = np.maximum.accumulate(np.where(held, self.end, 0)) if len(held) else self.end
                inside = np.concatenate(([False], reach[:-1] > self.start[1:])) if len(held) else held
            hit |= held
        return np.flatnonzero(hit)


def _lists(found: list[list | None], kind: pa.DataType) -> pa.Array:
    return pa.array(found, pa.list_(kind))


def selected(html: Column, selector: str) -> Column:
    """Array of the inner markup of the elements that a selector names, in order; null for null."""
    alternatives = parsed(selector)

    @F.arrow_udf(ArrayType(StringType()))
    def inner(texts: pa.Array) -> pa.Array:
        found: list[list | None] = []
        for t in texts:
            if (text := t.as_py()) is None:
                found.append(None)
                continue
            e = Elements(text)
            found.append([e.text[e.inner[i] : e.end[i]] for i in e.selected(alternatives)])
        return _lists(found, pa.string())

    return inner(html)


def selected_text(html: Column, selector: str) -> Column:
    """Array of the visible text of the elements."""
    return F.transform(selected(html, selector), lambda x: collapse(without_tags(x)))


def selected_attribute(html: Column, selector: str, name: str) -> Column:
    """Array of an attribute's value of the elements that have it."""
    alternatives, name = parsed(selector), name.lower()

    @F.arrow_udf(ArrayType(StringType()))
    def values(texts: pa.Array) -> pa.Array:
        found: list[list | None] = []
        for t in texts:
            if (text := t.as_py()) is None:
                found.append(None)
                continue
            e = Elements(text)
            found.append([v for i in e.selected(alternatives) if (v := e.attributes(i).get(name)) is not None])
        return _lists(found, pa.string())

    return values(html)


def first_selected(html: Column, selectors: tuple[str, ...]) -> Column:
    """Text of the first selector that yields any: that of its first element with text."""
    return F.coalesce(*(F.get(F.filter(selected_text(html, s), lambda x: x != ""), F.lit(0)) for s in selectors))


REMOVED = StructType([StructField("html", StringType()), StructField("removed", ArrayType(StructType([StructField("selector", StringType()), StructField("n", IntegerType())])))])


def without_elements(html: Column, selectors: tuple[str, ...]) -> Column:
    """Struct of the markup without the elements, each a blank, with whatever is nested in them, and how many elements of each
    selector were there."""
    alternatives = [parsed(s) for s in selectors]

    @F.arrow_udf(REMOVED)
    def cut(texts: pa.Array) -> pa.Array:
        out, removed = [], []
        for t in texts:
            if (text := t.as_py()) is None:
                out.append(None)
                removed.append(None)
                continue
            e = Elements(text)
            each = [e.selected(a) for a in alternatives]
            removed.append([{"selector": s, "n": len(x)} for s, x in zip(selectors, each, strict=True) if len(x)])
            parts, at = [], 0
            for i in sorted(set(np.concatenate(each).tolist()) if each else ()):
                if e.start[i] >= at:
                    parts += [e.text[at : e.start[i]], " "]
                at = max(at, int(e.outer[i]))
            out.append("".join(parts) + e.text[at:])
        kinds = pa.list_(pa.struct([("selector", pa.string()), ("n", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(removed, kinds)], ["html", "removed"])

    return cut(html)
