"""Secret scans through a trigram inverted index, in DataFrame operations only.

For each rule a Boolean trigram query is derived from its regular expression: a conjunction of clauses, each clause a
disjunction of strings of which one must occur, each string a conjunction of trigrams that cover it. The inverted index
is partitioned by document: a row holds its own part of the posting list of every trigram that some rule asks for, one
flag a list. Intersecting posting lists is then a test within the row, and neither texts nor postings are shuffled. A
text is a candidate of a rule if every clause has a string with all its trigrams, and only candidates are verified by
the regular expression. Rules without a mandatory trigram (a run of hex digits) scan every text. ``inverted`` gives the
same postings as a table (trigram, id), for an index that is kept.

Defined cases: a null text is empty and has no spans; repeated rows give repeated results; an empty table gives an empty
table; a very long text is one row and is scanned whole; only the id and the text column are read (``redact`` passes the
others through, whatever their names). Positions count code points.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

try:
    from re import _constants as K
    from re import _parser as regex_parser
except ImportError:  # before Python 3.11
    import sre_constants as K
    import sre_parse as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose ``group`` has fewer than ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Base rules, then those that this method adds, in the order in which spans of one start are listed. Fixed values.
#: Runs of a minimal length are written with it in place of a filter: a failing run holds no shorter match.
RULES: tuple[Rule, ...] = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE_KINDS = ("assign", "access", "hex")
MOST_STRINGS = 64

Clauses = list[frozenset[str]]


def _walk(tree) -> tuple[set[str] | None, Clauses]:
    """The strings that a sub-expression spells if they are few, else None; and clauses that hold in any case."""
    exact: set[str] | None = {""}
    run: set[str] = {""}
    clauses: Clauses = []

    def stop() -> None:
        nonlocal run, exact
        clauses.append(frozenset(run))
        run, exact = {""}, None

    def join(strings: set[str] | None, inner: Clauses) -> None:
        nonlocal run, exact
        clauses.extend(inner)
        if strings is None or len(strings) * len(run) > MOST_STRINGS:
            stop()
            if strings is not None:
                run = set(strings)
            return
        run = {a + b for a, b in itertools.product(run, strings)}
        if exact is not None:
            exact = set(run)

    for op, arg in tree:
        if op is K.LITERAL:
            join({chr(arg).lower()}, [])
        elif op is K.IN:
            chars = [chr(x) for o, x in arg if o is K.LITERAL]
            join({c.lower() for c in chars} if len(chars) == len(arg) <= 6 else None, [])
        elif op is K.SUBPATTERN:
            join(*_walk(arg[3]))
        elif op is K.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(e is not None for e, _ in parts):
                join(set().union(*(e for e, _ in parts)), [])
            else:
                join(None, [])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, inner = arg
            strings, more = _walk(inner)
            if (low, high) == (0, 1) and strings is not None:
                join({"", *strings}, [])
            elif low == 0:
                join(None, [])
            else:
                join(strings, more)
                stop()
        else:
            join(None, [])
    clauses.append(frozenset(run))
    return exact, clauses


def trigrams(string: str) -> frozenset[str]:
    """Trigrams that cover a string: every third one and the last."""
    return frozenset(string[i : i + 3] for i in {*range(0, len(string) - 2, 3), len(string) - 3} if i >= 0)


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses, each a list of trigram sets of which one must be there as a whole; lower case. Empty: no mandatory trigram."""
    _, clauses = _walk(regex_parser.parse(pattern))
    found = []
    for clause in dict.fromkeys(clauses):
        shortest = {s for s in clause if not any(t != s and t in s for t in clause)}  # the others hold one of these
        sets = {trigrams(s) for s in shortest}
        if frozenset() not in sets:
            found.append(tuple(sorted(sets, key=sorted)))
    return [list(x) for x in dict.fromkeys(found)]


def wanted_trigrams(rules: Sequence[Rule]) -> list[str]:
    return sorted({t for r in rules for clause in trigram_query(r.pattern) for s in clause for t in s})


def posted(low: Column, wanted: Sequence[str]) -> Column:
    """A lower-cased text's part of the posting lists: a flag for each of the wanted trigrams."""
    return F.array(*(F.contains(low, F.lit(t)) for t in wanted)) if wanted else F.array().cast("array<boolean>")


def inverted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The index as a table: (trigram, id) for the trigrams that the rules ask for."""
    wanted = wanted_trigrams(rules)
    low = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    lists = F.arrays_zip(F.array(*map(F.lit, wanted)).alias("trigram"), posted(F.col("low"), wanted).alias("there"))
    return low.select("id", F.explode(lists).alias("p")).where("p.there").select("p.trigram", F.col("id").alias(id_col))


def candidate(lists: Column, wanted: Sequence[str], rule: Rule) -> Column:
    """Whether a text has to be verified for a rule: its Boolean query on the text's posting lists."""
    number = {t: i for i, t in enumerate(wanted)}
    every = F.lit(True)
    for clause in trigram_query(rule.pattern):
        some = F.lit(False)
        for needed in clause:
            one = F.lit(True)
            for t in sorted(needed):
                one &= F.get(lists, F.lit(number[t]))
            some |= one
        every &= some
    return every


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of ints that are not negative: in each step the array is combined with itself moved by 1, 2,
    4 and so on. That takes n log n, where a fold that appends to an array would copy it for each element."""
    n = F.size(values)

    def step(acc: Column, k: Column) -> Column:
        by = F.pow(F.lit(2), k).cast("int")
        return F.zip_with(acc, F.concat(F.array_repeat(F.lit(0), by), F.slice(acc, F.lit(1), n - by)), lambda x, y: F.coalesce(combine(x, y), F.lit(0)))

    return F.when(n < 2, values).otherwise(F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int") - 1), values, step))


SPANS = "array<struct<start:int,number:int,end:int,kind:string>>"


def spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, kind number, end, kind) of a rule's leftmost non-overlapping matches, without failing ones."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    lengths = lambda strings: F.transform(strings, lambda x: F.coalesce(F.length(x), F.lit(0)))
    size, gap = lengths(matches), lengths(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(matches)))
    ends = running(F.zip_with(gap, size, lambda g, s: F.coalesce(g + s, F.lit(0))), lambda x, y: x + y)
    parts = F.arrays_zip(ends.alias("end"), size.alias("size"), lengths(measured).alias("kept"))
    found = F.transform(F.filter(parts, lambda x: x["kept"] >= rule.least), lambda x: F.struct((x["end"] - x["size"]).alias("start"), F.lit(number).alias("number"), x["end"].alias("end"), F.lit(rule.kind).alias("kind")))
    return F.when(text.rlike(rule.pattern), found.cast(SPANS)).otherwise(F.array().cast(SPANS))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scanned(docs: DataFrame, text_col: str, rules: Sequence[Rule], passed: Column) -> DataFrame:
    """(_doc: what is passed, text, found: sorted spans of all rules)."""
    wanted = wanted_trigrams(rules)
    rows = docs.select(passed.alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("_doc", "text", F.lower("text").alias("low")).select("_doc", "text", posted(F.col("low"), wanted).alias("lists"))
    each = [F.when(candidate(F.col("lists"), wanted, rule), spans(F.col("text"), rule, number)).otherwise(F.array().cast(SPANS)) for number, rule in enumerate(rules)]
    return rows.select("_doc", "text", F.array_sort(F.concat(*each)).alias("found"))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row a document: id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = scanned(docs, text_col, rules, F.col(id_col))
    number = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    return rows.select(F.col("_doc").alias(id_col), *map(number, BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


#: A text is cut into blocks of so many characters once, so a piece of it is found without walking through the text.
BLOCK = 512


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """Characters start to end (exclusive) of the text that the blocks make up."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    within = F.substring(F.get(blocks, first), start % BLOCK + 1, end - start)
    head, tail = F.substring(F.get(blocks, first), start % BLOCK + 1, F.lit(BLOCK)), F.substring(F.get(blocks, last), F.lit(1), end - last * BLOCK)
    over = F.concat(head, F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), tail)
    return F.when(end <= start, "").when(first == last, within).otherwise(over)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, mark: str = "[SECRET]", length_col: str | None = "n_chars") -> DataFrame:
    """The documents with each span, overlapping ones as one, replaced by ``mark``; ``length_col`` is brought up to date."""
    rows = scanned(docs, text_col, rules, F.struct("*"))
    rows = rows.withColumn("_blocks", F.when(F.size("found") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))
    upto = running(F.transform("found", lambda s: F.coalesce(s["end"], F.lit(0))), F.greatest)
    rows = rows.withColumn("_upto", F.when(F.size("found") > 0, upto))  # of each span: where it and those before it end
    placed = F.arrays_zip(F.transform("found", lambda s: s["start"]).alias("start"), F.concat(F.array(F.lit(0)), F.slice("_upto", F.lit(1), F.size("found") - 1)).alias("before"))
    apart = F.filter(placed, lambda s: s["start"] >= s["before"])
    pieces = F.transform(apart, lambda s: F.concat(cut(F.col("_blocks"), s["before"], s["start"]), F.lit(mark)))
    done = F.concat(F.array_join(pieces, ""), cut(F.col("_blocks"), F.element_at("_upto", -1), F.length("text")))
    clean = F.when(F.size("found") > 0, done).otherwise(F.col("_doc")[text_col])
    columns = []
    for c, kind in docs.dtypes:
        if c == text_col:
            columns.append(F.col("_clean").alias(c))
        elif c == length_col:
            columns.append(F.when(F.size("found") > 0, F.length("_clean")).otherwise(F.col("_doc")[c]).cast(kind).alias(c))
        else:
            columns.append(F.col("_doc")[c].alias(c))
    return rows.withColumn("_clean", clean).select(*columns)


def _oracle_rule(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT n, '{kind}' AS kind, {number} AS number,
         coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0)::BIGINT AS s,
         coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(hits[1:i], lambda x: length(x))), 0)::BIGINT AS e
  FROM (SELECT n, gaps, hits, kept, unnest(range(1, len(hits) + 1)) AS i FROM
        (SELECT n, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS hits, regexp_extract_all(t, '{p}', {group}) AS kept FROM d))
  WHERE length(kept[i]) >= {least}"""


_ANY_CASE = {w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api", "key")}
_ORACLE_ASSIGN = "({password}|{passwd}|{secret}|{token}|{api}_?{key})".format(**_ANY_CASE) + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ORACLE_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents), f AS ("
    + " UNION ALL ".join(_oracle_rule(r.kind, i, _ORACLE_ASSIGN if r.kind == "assign" else r.pattern, r.group, r.least) for i, r in enumerate(RULES))
    + """),
g AS (SELECT n, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, number) FILTER (kind IN ('assign', 'access', 'hex')) AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, number) AS spans FROM f GROUP BY n)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.n = g.n
"""
)
