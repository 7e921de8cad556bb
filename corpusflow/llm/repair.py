"""Conversation structure repair: the cheapest edits that give every conversation the role pattern ``(s?(ua)+)?``.

Rows of a conversation are taken by (turn, role, text), null turns first. Each row's first fault is ``blank`` (no character
other than blanks), ``duplicate`` (role and text seen earlier) or ``truncated`` (the last such character is no ``.!?``).
Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (the only one for blank and duplicate rows), Insert an empty user or
assistant turn 2; a truncated row that is not deleted adds 1. Of the cheapest edits those win whose initials, in order, are
least in ASCII order.

Method: a weight is one integer. Its high digits are the cost; its low digits, of fixed number, are the audit: one octal
digit an edit (D 1, I 2, K 3, R 4), the first edit highest, 0 behind the end. So the least integer is the least cost and,
among equals, the ASCII-least audit. The edits form a DAG over (row, state of the pattern), and its dynamic program takes
plain minima: putting an edit in front moves the low digits down by one and adds the edit's digit and cost.

Conversations of any length: rows are dealt to runs of RUN rows in global order, and each run gives, for every pair of
states, the least weight between them. Of two audits of equal cost over the same rows and states none begins with the
other (each further letter would cost), so these weights can be put together by a min-plus product, in a tree. What a
conversation's task holds is some bytes a row, no texts. The chosen audit goes back to the runs, where rows are edited.
Only the digest of a repaired conversation, sequential by definition, is formed in one task, as a stream over the texts of
RUN rows at a time.

Defined cases: null roles and texts are one space; repeated rows are duplicates; a null conversation id is one
conversation, ids may have any type; a conversation without rows is not seen by ``repair`` (``repair_report`` can be given
the ids to report); an empty table gives empty tables; very long texts stay within their row; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import ranged
from .scratch import written

RUN = 1024
BLANKS = " \t\n\x0b\x0c\r"
#: Octal digits of the edits, in the ASCII order of their letters.
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER = str.maketrans("1234", "DIKR")
COST = {"D": 3, "I": 2, "K": 0, "R": 2}
#: The pattern as an automaton: start, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ACCEPTED = (START, ASSISTANT)
LEGAL = ("su", "ua", "au")

Weights = list[list[int | None]]  # by first and last state


def digits(rows: int) -> int:
    """Width of the audits of so many rows: up to three edits a row (two inserts before it) and some at the end."""
    return 3 * rows + 3


def _least(*weights: int | None) -> int | None:
    return min((w for w in weights if w is not None), default=None)


def weights_of(rows: list[tuple[str, bool, bool]]) -> Weights:
    """Least weights between all states over rows (role initial, whether it must be deleted, whether it is truncated)."""
    width = digits(len(rows))
    bits, top = 3 * width, 3 * (width - 1)
    low = (1 << bits) - 1

    def ahead(edit: str, weight: int | None, more: int = 0) -> int | None:
        if weight is None:
            return None
        return ((weight >> bits) + COST[edit] + more) << bits | DIGIT[edit] << top | (weight & low) >> 3

    def with_inserts(v: list[int | None]) -> list[int | None]:
        user, assistant = ahead("I", v[USER]), ahead("I", v[ASSISTANT])
        out = [v[START], v[SYSTEM], _least(v[USER], assistant), _least(v[ASSISTANT], user)]
        one = ahead("I", out[USER])
        out[START], out[SYSTEM] = _least(v[START], one), _least(v[SYSTEM], one)
        return out

    table: Weights = [[None] * len(STATES) for _ in STATES]
    for last in STATES:
        v: list[int | None] = [None] * len(STATES)
        v[last] = 0
        v = with_inserts(v)
        for initial, must_go, truncated in reversed(rows):
            chosen = [ahead("D", w) for w in v]
            if not must_go:
                for state in STATES:
                    if (to := NEXT.get((state, initial))) is not None:
                        chosen[state] = _least(chosen[state], ahead("K", v[to], truncated))
                    for role in "ua":
                        if (to := NEXT.get((state, role))) is not None:
                            chosen[state] = _least(chosen[state], ahead("R", v[to], truncated))
            v = with_inserts(chosen)
        for first in STATES:
            table[first][last] = v[first]
    return table


@functools.lru_cache(1 << 16)
def _short(rows: tuple[tuple[str, bool, bool], ...]) -> Weights:
    return weights_of(list(rows))


def joined(a: Weights, width_a: int, b: Weights, width_b: int) -> Weights:
    """Least weights over rows after rows; widths add up. An audit of ``b`` starts where that of ``a`` ends."""
    low_a, low_b, both = (1 << 3 * width_a) - 1, (1 << 3 * width_b) - 1, 3 * (width_a + width_b)

    def put(x: int | None, y: int | None) -> int | None:
        if x is None or y is None:
            return None
        audit = x & low_a
        unused = ((audit & -audit).bit_length() - 1) // 3 if audit else width_a
        return ((x >> 3 * width_a) + (y >> 3 * width_b)) << both | audit << 3 * width_b | (y & low_b) << 3 * unused

    return [[_least(*(put(a[q][m], b[m][r]) for m in STATES)) for r in STATES] for q in STATES]


def whole(parts: list[tuple[Weights, int]]) -> tuple[Weights, int]:
    """All parts joined, neighbours first."""
    while len(parts) > 1:
        pairs = [(joined(*parts[i], *parts[i + 1]), parts[i][1] + parts[i + 1][1]) for i in range(0, len(parts) - 1, 2)]
        parts = pairs + (parts[-1:] if len(parts) % 2 else [])
    return parts[0]


def decision(weights: Weights, width: int) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    best = min(w for w in (weights[START][q] for q in ACCEPTED) if w is not None)
    audit = format(best & ((1 << 3 * width) - 1), f"0{width}o").rstrip("0")
    return best >> 3 * width, audit.translate(LETTER)


def in_order(rows: DataFrame) -> DataFrame:
    """conv, conv_id, turn, role, text, part, at: a written table in global order; conv is never null."""
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    filled = rows.select(conv.alias("conv"), "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return ranged(filled.withColumn("twin", F.monotonically_increasing_id()), "conv", "turn", "role", "text", "twin").drop("twin")


def judged(placed: DataFrame) -> DataFrame:
    """conv, at, run, turn, initial, fault (null for none), without texts. ``run`` numbers RUN rows that follow one another."""
    text = F.col("text")
    last = F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))
    fault = F.when(last == "", "blank").when(~last.isin(*".!?"), "truncated")
    said = F.md5(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"))
    slim = written(placed.select("conv", "at", "part", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), said.alias("said")), "judged")
    first = slim.groupBy("conv", "said").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))  # ``at`` counts from 0 within each part
    run = F.shiftleft(F.col("part").cast("long"), 33) + F.floor(inside / RUN)
    duplicate = F.when((F.col("fault") == "blank") | F.col("first"), F.col("fault")).otherwise("duplicate")
    return slim.join(first, "at", "left").select("conv", "at", run.alias("run"), "turn", "initial", duplicate.alias("fault"))


COUNTED = "conv string, first_at long, n long, turns long, low long, high long, opens string, closes string, blank long, duplicate long, truncated long, illegal long, weights array<binary>"


def summaries(faults: DataFrame) -> DataFrame:
    """COUNTED for each conversation in each run: counts, what is needed at its two ends, and the weights."""
    parts = int(faults.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [x.split()[0] for x in COUNTED.split(", ")]
    columns = ("conv", "run", "at", "turn", "initial", "fault")
    kinds = [pa.string(), *[pa.int64()] * 5, *[pa.string()] * 2, *[pa.int64()] * 4, pa.list_(pa.binary())]

    def summary(rows: list[tuple]) -> tuple:
        conv, _, at, *_ = rows[0]
        turns = [r[3] for r in rows if r[3] is not None]
        initials = [r[4] for r in rows]
        faults = [r[5] for r in rows]
        edits = [(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults, strict=True)]
        table = _short(tuple(edits)) if len(edits) <= 16 else weights_of(edits)
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        flat = [None if w is None else w.to_bytes((w.bit_length() + 7) // 8) for line in table for w in line]
        return (conv, at, len(rows), len(set(turns)), min(turns, default=None), max(turns, default=None), initials[0], initials[-1], *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []

        def table(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            done = []
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if waiting and waiting[-1][:2] != row[:2]:
                    done.append(summary(waiting))
                    waiting = []
                waiting.append(row)
            yield table(done)
        yield table([summary(waiting)] if waiting else [])

    dealt = faults.select(*columns[:3], F.col("turn").cast("long"), *columns[4:]).repartition(parts, "run").sortWithinPartitions("run", "at")
    return written(dealt.mapInArrow(run, COUNTED), "summaries")


DECIDED = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, system boolean, slices array<struct<first_at:long,before:long,letters:string>>"


def decided(summed: DataFrame) -> DataFrame:
    """DECIDED for each conversation: counts, cost, audit, and the audit cut at its runs with the turns put out before each."""
    names = [x.split()[0] for x in COUNTED.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.bool_(), pa.list_(pa.struct([("first_at", pa.int64()), ("before", pa.int64()), ("letters", pa.string())]))]

    def one(conv: str, rows: list[tuple]) -> tuple:
        rows = sorted(rows, key=lambda r: r[1])
        turns, low, high, illegal, end = 0, None, None, 0, None
        for before, r in zip([None, *rows], rows, strict=False):
            if r[4] is not None:
                turns += r[3] - (r[4] == end)  # a turn that goes on from the run before
                low, high, end = r[4] if low is None else low, r[5], r[5]
            illegal += r[11] + (before is not None and before[7] + r[6] not in LEGAL)
        table = [([[None if w is None else int.from_bytes(w) for w in r[12][4 * q : 4 * q + 4]] for q in STATES], digits(r[2])) for r in rows]
        cost, audit = decision(*whole(table))
        slices, at, before = [], 0, 0
        for i, r in enumerate(rows):
            start, left = at, r[2]
            if i == len(rows) - 1:
                at = len(audit)
            while left and at < len(audit):  # inserts behind a run's last row go to the next run
                left -= audit[at] != "I"
                at += 1
            letters = audit[start:at]
            slices.append({"first_at": r[1], "before": before, "letters": letters})
            before += len(letters) - letters.count("D")
        gaps = 0 if low is None else high - low + 1 - turns
        return (conv, gaps, *(sum(r[k] for r in rows) for k in (8, 9, 10)), illegal, cost, audit, before % 2 == 1, slices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], [x.split()[0] for x in DECIDED.split(", ")])

        waiting: list[tuple] = []
        for batch in batches:
            done = []
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if waiting and waiting[-1][0] != row[0]:
                    done.append(one(waiting[0][0], waiting))
                    waiting = []
                waiting.append(row)
            yield table(done)
        yield table([one(waiting[0][0], waiting)] if waiting else [])

    parts = int(summed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(summed.repartition(parts, "conv").sortWithinPartitions("conv").mapInArrow(run, DECIDED), "decided")


EDITED = "at long, before array<string>, edit string, role string, after array<string>"


def edits_of(decisions: DataFrame) -> DataFrame:
    """EDITED for each row: the roles of turns inserted before it, its edit, its new role (null: as it was), and those inserted after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.list_(pa.string()), pa.string(), pa.string(), pa.list_(pa.string()))
        for batch in batches:
            done: list[list] = []
            for at, n, letters, system in zip(*(batch.column(c).to_pylist() for c in ("first_at", "before", "letters", "system")), strict=True):
                inserted: list[str] = []
                for letter in letters:
                    role = "assistant" if (n - system) % 2 else "user"
                    if letter == "I":
                        inserted.append(role)
                    else:
                        done.append([at, inserted, letter, role if letter == "R" else None, []])
                        at, inserted = at + 1, []
                    n += letter != "D"
                if inserted:
                    done[-1][4] = inserted
                if len(done) >= 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], [x.split()[0] for x in EDITED.split(", ")])
                    done = []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], [x.split()[0] for x in EDITED.split(", ")])

    return decisions.select("system", F.explode("slices").alias("s")).select("s.first_at", "s.before", "s.letters", "system").mapInArrow(run, EDITED)


def _turns(placed: DataFrame, edits: DataFrame) -> DataFrame:
    """conv, conv_id, at, and turns: what each row becomes, (edit, role, text) in order; a deleted row gives none of its own."""
    kind = "array<struct<edit:string,role:string,text:string>>"
    insert = lambda roles: F.transform(roles, lambda r: F.struct(F.lit("I").alias("edit"), r.alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("edit") != "D", F.array(F.struct("edit", F.coalesce(F.col("new_role"), F.col("role")).alias("role"), "text"))).otherwise(F.array().cast(kind))
    return placed.join(edits.withColumnRenamed("role", "new_role"), "at").select("conv", "conv_id", "at", F.concat(insert("before"), own, insert("after")).cast(kind).alias("turns"))


def _decisions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    placed = in_order(rows)
    return placed, decided(summaries(judged(placed)))


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, edit (K, R or I), role, text; (at, step) rises in a conversation."""
    placed, decisions = _decisions(rows)
    turns = _turns(placed, edits_of(decisions)).select("conv_id", "at", F.posexplode("turns").alias("step", "t"))
    return turns.select("conv_id", "at", "step", "t.edit", "t.role", "t.text")


def digests(turns: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of conversations with a turn: a stream in order, whose state is one digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            convs, found = [], []
            for conv, said in zip(batch.column("conv").to_pylist(), batch.column("said").to_pylist(), strict=True):
                if state is None or conv != current:
                    if state is not None:
                        convs.append(current)
                        found.append(state.hexdigest())
                    current, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(said.encode())
            yield pa.RecordBatch.from_arrays([pa.array(convs, pa.string()), pa.array(found, pa.string())], ["conv", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([state.hexdigest()])], ["conv", "repaired_sha256"])

    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    said = F.array_join(F.transform("turns", lambda t: F.concat_ws(":", t["role"], t["text"])), "\n")
    filled = turns.where(F.size("turns") > 0).select("conv", "at", said.alias("said"))
    return filled.repartition(parts, "conv").sortWithinPartitions("conv", "at").select("conv", "said").mapInArrow(run, "conv string, repaired_sha256 string")


def repair_report(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conversation of ``rows``, and
    zeros for those of ``ids`` (column conv_id) that have no row."""
    placed, decisions = _decisions(rows)
    hashed = digests(_turns(placed, edits_of(decisions)))
    asked = (rows if ids is None else ids.select("conv_id").union(rows.select("conv_id"))).select("conv_id").distinct()
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    found = asked.withColumn("conv", conv).join(decisions, "conv", "left").join(hashed, "conv", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return found.select("conv_id", *map(number, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damage_of(conv_id: Column, turn: Column) -> Column:
    filled = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return F.crc32(F.concat_ws(":", filled(conv_id), filled(turn))) % 20


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) after the damage that their key decides; nulls are one space.

    0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    kind = F.col("kind")
    hit = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), damage_of(F.col("conv_id"), F.col("turn")).alias("kind")).where("kind <> 0")
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    changed = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return hit.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), copies.alias("copy")).drop("copy")


def damaged_report(conversations: DataFrame) -> DataFrame:
    return repair_report(damaged(conversations), conversations)


def _then(weight: str, cost: str, letters: str) -> str:
    return f"CASE WHEN {weight} IS NOT NULL THEN {{'c': {weight}.c + {cost}, 'a': {weight}.a || '{letters}'}} END"


def _edited(state: int, initial: str, before: list[str]) -> str:
    """Least weight after a row that ends in ``state``, where ``before`` are the weights of the states that lead there."""
    options = [_then(f"w{state}", "3", "D")]
    for weight in before:
        options.append(f"CASE WHEN NOT must AND initial = '{initial}' THEN {_then(weight, 't', 'K')} END")
        if state != SYSTEM:
            options.append(f"CASE WHEN NOT must THEN {_then(weight, '2 + t', 'R')} END")
    return f"list_min([{', '.join(options)}]) AS e{state}"


_EDITED = [_edited(START, "", []), _edited(SYSTEM, "s", ["w0"]), _edited(USER, "u", ["w0", "w1", "w3"]), _edited(ASSISTANT, "a", ["w2"])]
#: Forward in SQL, with costs and letters in place of integers; crc32 is spelled out, as DuckDB has none.
ORACLE_SQL = rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
keyed AS (SELECT coalesce('=' || conv_id, '') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
                                             lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256))) % 20 AS kind FROM conversations, crc),
rows AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM keyed WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen FROM rows),
judged AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS former,
                  CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN seen THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE '' END AS fault FROM placed),
counts AS (SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (former IS NOT NULL AND former || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv),
edits AS (SELECT conv, i, initial, fault IN ('blank', 'duplicate') AS must, (fault = 'truncated')::INT AS t FROM judged),
dp AS (SELECT conv, 0::BIGINT AS i, {{'c': 0, 'a': ''}} AS w0, NULL::STRUCT(c INT, a VARCHAR) AS w1, {{'c': 2, 'a': 'I'}} AS w2, {{'c': 4, 'a': 'II'}} AS w3 FROM counts
       UNION ALL
       SELECT conv, i, e0, e1, list_min([e2, {_then("e0", "2", "I")}, {_then("e1", "2", "I")}, {_then("e3", "2", "I")}]), list_min([e3, {_then("e2", "2", "I")}, {_then("e0", "4", "II")}, {_then("e1", "4", "II")}])
       FROM (SELECT dp.conv, edits.i, {", ".join(_EDITED)} FROM dp JOIN edits ON edits.conv = dp.conv AND edits.i = dp.i + 1)),
best AS (SELECT dp.conv, list_min([w0, w3]) AS w FROM dp JOIN counts ON counts.conv = dp.conv AND counts.n = dp.i),
letters AS (SELECT conv, unnest(range(1, length(w.a) + 1)) AS p, w.a AS audit FROM best),
put AS (SELECT conv, p, audit[p] AS letter, sum((audit[p] <> 'I')::INT) OVER o AS i, sum((audit[p] <> 'D')::INT) OVER o AS n, sum((audit[p] <> 'D')::INT) OVER (PARTITION BY conv) % 2 AS s FROM letters WINDOW o AS (PARTITION BY conv ORDER BY p)),
repaired AS (SELECT put.conv, string_agg(CASE letter WHEN 'K' THEN role ELSE CASE WHEN (n - 1 - s) % 2 = 0 THEN 'user' ELSE 'assistant' END END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS said
             FROM put LEFT JOIN placed ON placed.conv = put.conv AND placed.i = put.i AND letter <> 'I' WHERE letter <> 'D' GROUP BY put.conv)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(w.c, 0)::BIGINT AS cost, coalesce(w.a, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id, '') AS conv FROM conversations) ids LEFT JOIN counts USING (conv) LEFT JOIN best USING (conv) LEFT JOIN repaired USING (conv)
"""
