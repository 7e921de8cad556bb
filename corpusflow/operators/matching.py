"""Many strings or rules against many texts: one linear pass a text, whatever their number.

The strings of one block are put into an automaton that finds all of them while it reads a text once. Strings are counted
before they are sent: up to ``BLOCK_CHARS`` characters are one block; more are dealt to blocks by hash, and the texts are
read once for each block. Texts stay where they are: what is joined or shuffled are the strings found.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

try:
    from re import _constants as K
    from re import _parser as regex_parser
except ImportError:  # before Python 3.11
    import sre_constants as K
    import sre_parse as regex_parser

#: Characters of the strings in one automaton, and rows of a table beside it that are sent to all tasks.
BLOCK_CHARS = 4 << 20
BROADCAST_ROWS = 200_000

_built: dict[str, tuple] = {}


def _automaton(token: str, strings: list[str]) -> tuple:
    """The automaton of a block, built once a worker process; the last few stay."""
    if token not in _built:
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, s in enumerate(strings):
            if s:
                found.add_word(s, i)
        if len(found):
            found.make_automaton()
        while len(_built) > 3:
            _built.pop(next(iter(_built)))
        _built[token] = found, [i for i, s in enumerate(strings) if not s], pa.array(strings, pa.string())
    return _built[token]


def finder(df: DataFrame, strings: list[str]) -> Callable[[Column], Column]:
    """A column function: the array of those of the distinct ``strings`` that a text contains, in their order; null for null.
    The empty string is in every text."""
    sent, token = df.sparkSession.sparkContext.broadcast(strings), uuid.uuid4().hex

    @F.arrow_udf(ArrayType(StringType()))
    def found_in(texts: pa.Array) -> pa.Array:
        automaton, everywhere, names = _automaton(token, sent.value)
        found: list[int] = []
        ends = [0]
        for text in texts:
            t = text.as_py()
            if t is not None:
                found += sorted({*everywhere, *(i for _, i in automaton.iter(t))} if len(automaton) else everywhere)
            ends.append(len(found))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(found, pa.int64())), mask=texts.is_null())

    return found_in


def finders(names: DataFrame, name: str) -> list[Callable[[Column], Column]]:
    """A ``finder`` for each block of the different strings in a column; the driver takes one block at a time."""
    own = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    blocks = math.ceil((own.agg(F.sum(F.length("name") + 1)).first()[0] or 0) / BLOCK_CHARS)
    block = lambda k: own if blocks == 1 else own.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == k)
    return [finder(names, sorted(r[0] for r in block(k).collect())) for k in range(blocks)]


def _all(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    whole = None
    for part in parts:
        whole = part if whole is None else whole.union(part)
    return empty if whole is None else whole


def containing(names: DataFrame, name: str, texts: DataFrame, text: str) -> DataFrame:
    """Names and texts, with all their columns, where the text contains the name as a substring.

    Both tables keep their own columns, so their names must differ. Each text is read once a block of names; the names found
    are joined with their table, which is sent to the tasks if it is small."""
    slim = F.broadcast(names) if names.count() <= BROADCAST_ROWS else names
    parts = [texts.withColumn("_found", F.explode(f(F.col(text)))) for f in finders(names, name)]
    empty = texts.limit(0).withColumn("_found", F.lit(None).cast("string"))
    return _all(parts, empty).join(slim, F.col("_found") == names[name]).select(*names.columns, *texts.columns)


def missing_by_substring(expected: DataFrame, found: DataFrame, name: str, text: str) -> DataFrame:
    """Expected names which no found text contains, whatever the case. Only names that were found are shuffled."""
    names = expected.select(F.lower(name).alias("_expected"))
    parts = [found.select(F.explode(f(F.lower(text))).alias("_expected")) for f in finders(names, "_expected")]
    hits = _all(parts, names.limit(0)).distinct()
    return expected.join(hits, F.lower(expected[name]) == F.col("_expected"), "left_anti")


def required_literal(pattern: str) -> str:
    """The longest lower-case string that every match of a regular expression holds, as far as its top level tells; else empty."""
    if re.search(r"\(\?[a-z]*[uU]", pattern):  # case beyond ASCII is ignored
        return ""
    try:
        tree = regex_parser.parse(pattern)
    except re.error:  # what only Java's syntax has
        return ""

    def runs(items) -> list[str]:
        found, run = [""], ""
        for op, arg in items:
            if op is K.LITERAL and (arg < 128 or chr(arg).lower() == chr(arg).upper()):  # the case of others may hang on their place
                run += chr(arg).lower()
                continue
            found.append(run)
            run = ""
            if op is K.SUBPATTERN:
                found += runs(arg[3])
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] > 0:
                found += runs(arg[2])
        return [*found, run]

    return max(runs(tree), key=len)


def first_rule(rows: DataFrame, id_col: str, text_col: str, rules: DataFrame) -> DataFrame:
    """(id, category) of the first rule that matches a text: rules are rows (category, pattern, priority), priorities unique;
    texts without a match are left out.

    One automaton holds a literal that each rule needs, and a rule's expression is tried on the texts that hold its literal
    (those of rules without a literal on all). Literals and texts are compared in lower case, so expressions may ignore case.
    Rules are sent to the tasks in groups of BROADCAST_ROWS; ids and priorities are shuffled, no texts."""
    slim = rules.select("category", "pattern", "priority", required_of(F.col("pattern")).alias("literal"))
    asked = rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null")
    groups = max(1, math.ceil(slim.count() / BROADCAST_ROWS))
    parts = []
    for k in range(groups):
        some = slim if groups == 1 else slim.where(F.pmod(F.xxhash64("pattern"), F.lit(groups)) == k)
        for found in finders(some, "literal"):
            held = asked.withColumn("_literal", F.explode(found(F.lower("_text"))))
            tried = held.join(F.broadcast(some), F.col("_literal") == F.col("literal")).where(F.regexp_like("_text", "pattern"))
            parts.append(tried.select("_id", "category", "priority"))
    return _all(parts, asked.limit(0).selectExpr("_id", "'' as category", "0 as priority")).groupBy("_id").agg(F.min_by("category", "priority").alias("category")).withColumnRenamed("_id", id_col)


@F.arrow_udf(StringType())
def required_of(patterns: pa.Array) -> pa.Array:
    return pa.array([required_literal(p.as_py() or "") for p in patterns], pa.string())
