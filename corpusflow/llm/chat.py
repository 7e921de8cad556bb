"""Chat formatting into a prefix tree: conversations that share initial turns share their tokens.

A turn becomes ``<s>[role]\\n text </s>\\n`` (without the blanks). Control strings inside roles and texts are escaped
reversibly: U+241B becomes U+241B followed by ``e``, and each control string U+241B followed by its own letter.

Every distinct sequence of first turns is a node, named by an additive hash of its (depth, role, text): four sums of 32-bit
parts of MD5, which are running totals over the turns. Nodes without a branching above them form chains with the nodes
that they continue: a chain starts at a root or at a child of a node with two or more children. Trees are emitted depth
first, a node's tokens once, with

* ``start``: the place of its first token in its tree's token sequence,
* ``position``: the position id of that token, the number of tokens of its ancestors,
* ``attends``: the (a, b) intervals of its ancestors in the sequence, one for each chain above and one for the part of
  its own chain before it; a token attends to these and to the tokens of its own node up to itself,
* ``loss_start``, ``loss_end``: the characters of its segment under the loss mask (an assistant's escaped text).

Depth-first order is the order of paths of chain ids, so a chain's start is a running total in that order. All running
totals (depths, node names, nearest chain heads, starts) are taken in range partitions and carried over their parts, so
neither a conversation nor a chain nor a tree of a third of all rows is held by a task. B branchings above a node need
B * B / 2 rows at least, so the lists of them have at most the square root of twice the number of rows.

Only the digests of its turns, which are sequential hashes by definition, see a conversation in one task, and there as a
stream in constant memory. They are formed once for each distinct conversation, however often it is repeated.

Defined cases: null roles and texts are empty; turns are ordered by (turn, role, text), null turns first; repeated rows
are turns of their own; a null conversation id is one conversation, ids may have any type; a very long text is one turn
and is tokenised whole; an empty table gives empty tables; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runs import earlier, earlier_all, ranged
from .scratch import written
from .tokencounts import DEFAULT_RANKS, encoding

ESCAPE = "␛"
#: Control strings of this template and of common others, each with the letter that stands for it after ESCAPE.
CONTROL = {"<s>": "a", "</s>": "b", "[INST]": "c", "[/INST]": "d", "<<SYS>>": "f", "<</SYS>>": "g", "<|im_start|>": "h", "<|im_end|>": "i", "<|endoftext|>": "j"}
OPEN, CLOSE = "<s>", "</s>\n"
ASSISTANT = "assistant"


def escape(text: str) -> str:
    text = text.replace(ESCAPE, ESCAPE + "e")
    for control, letter in CONTROL.items():
        text = text.replace(control, ESCAPE + letter)
    return text


def unescape(text: str) -> str:
    for control, letter in CONTROL.items():
        text = text.replace(ESCAPE + letter, control)
    return text.replace(ESCAPE + "e", ESCAPE)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the character range of its text in it."""
    head = f"{OPEN}[{escape(role)}]\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


PARTS = 4  # of a node's name, 8 hex digits each


def said(rows: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, role, text, part, at) of (conv_id, turn, role, text), in order; conv is never null."""
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    filled = rows.select(conv.alias("conv"), "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Equal turns of one conversation stay apart, so that even they are spread over the range partitions.
    return ranged(filled.withColumn("twin", F.monotonically_increasing_id()), "conv", "turn", "role", "text", "twin").drop("twin")


def turns_of(rows: DataFrame) -> DataFrame:
    """One row a turn: conv, conv_id, part, at, depth, node, parent (the node before it, null at depth 0), role, text."""
    all_said = said(rows)
    content = F.md5(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"))
    slim = all_said.select("conv", "part", "at", content.alias("content"))
    counted = written(earlier(slim, "conv", "depth", F.lit(1)).withColumn("depth", F.coalesce("depth", F.lit(0)).cast("int")), "depths")
    word = F.md5(F.concat_ws("\n", F.col("depth").cast("string"), "content"))
    named = counted.withColumn("own", F.array(*(F.conv(F.substring(word, 8 * k + 1, 8), 16, 10).cast("long") for k in range(PARTS))))
    columns = [f"before{k}" for k in range(PARTS)]
    named = earlier_all(named, "conv", {c: F.col("own")[k] for k, c in enumerate(columns)})
    name = lambda *sums: F.concat(*(F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")) for x in sums))
    node = name(*(F.coalesce(F.col(c), F.lit(0)) + F.col("own")[k] for k, c in enumerate(columns)))
    parent = F.when(F.col("depth") > 0, name(*map(F.col, columns)))
    nodes = named.select("at", "depth", node.alias("node"), parent.alias("parent"))
    return written(all_said.join(nodes, "at"), "turns")


NODES = "node string, parent string, depth int, segment string, loss_start int, loss_end int, text_start int, tokens array<int>, n_tokens long"


def tokenised(turns: DataFrame, ranks_path: str) -> DataFrame:
    """NODES of (node, parent, depth, role, text): segments with their token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = encoding(ranks_path)
        for batch in batches:
            role, text = (batch.column(c).to_pylist() for c in ("role", "text"))
            parts = [segment(r, t) for r, t in zip(role, text, strict=True)]
            loss = [(a, b) if r == ASSISTANT else (0, 0) for r, (_, a, b) in zip(role, parts, strict=True)]
            ids = [enc.encode_ordinary(s) for s, _, _ in parts]
            small = lambda xs: pa.array(xs, pa.int32())
            columns = [pa.array([s for s, _, _ in parts], pa.string()), small([a for a, _ in loss]), small([b for _, b in loss]), small([a for _, a, _ in parts])]
            columns += [pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "parent", "depth")), *columns], [x.split()[0] for x in NODES.split(", ")])

    return turns.select("node", "parent", "depth", "role", "text").mapInArrow(run, NODES)


def nodes_of(turns: DataFrame, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """NODES, once for each distinct sequence of first turns."""
    once = turns.groupBy("node").agg(F.min("at").alias("at")).select("at")
    return written(tokenised(turns.join(once, "at", "left_semi"), ranks_path), "nodes")


def paths_of(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, leaf) of one conversation for each distinct one, and the rows (conv, part, at, depth, node) of these; leaf is the last node."""
    last = written(turns.groupBy("conv").agg(F.max_by("node", "depth").alias("leaf")), "leaves")
    one = written(last.groupBy("leaf").agg(F.min("conv").alias("conv")), "distinct")
    return one, written(turns.select("conv", "part", "at", "depth", "node").join(one.select("conv"), "conv", "left_semi"), "paths")


def chains_of(nodes: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, chain) and (chain, path): a chain's id is its first node, its path the ids of the chains above and its own."""
    inner = nodes.where("depth > 0").select("node", "parent")
    branching = written(inner.groupBy("parent").count().where("count > 1").select("parent"), "branchings")
    heads = written(nodes.where("depth = 0").select("node").union(inner.join(branching, "parent", "left_semi").select("node")), "heads")
    placed = written(paths.join(heads.withColumn("is_head", F.lit(True)), "node", "left"), "heads-on-paths")
    head = F.when(F.col("is_head"), F.struct("at", "node"))
    of = earlier(placed, "conv", "above", head, F.max).select("node", F.when(F.col("is_head"), F.col("node")).otherwise(F.col("above.node")).alias("chain"))
    along = W.partitionBy("conv").orderBy("at")  # the heads of one conversation: few, see above
    ways = placed.where("is_head").withColumn("path", F.array_join(F.collect_list("node").over(along), "/"))
    return of.groupBy("node").agg(F.first("chain").alias("chain")), ways.groupBy(F.col("node").alias("chain")).agg(F.first("path").alias("path"))


def forest_of(nodes: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, chain, root, inside, start, position, n_attends) and (chain, uppers: the intervals of the chains above)."""
    of, ways = chains_of(nodes, paths)
    slim = written(nodes.select("node", "depth", "n_tokens").join(of, "node"), "chained")
    totals = slim.groupBy("chain").agg(F.sum("n_tokens").alias("sum"))
    chains = ranged(ways.join(totals, "chain").withColumn("root", F.substring_index("path", "/", 1)), "path")
    chains = written(earlier(chains, "root", "chain_start", F.col("sum")).select("chain", "path", "root", "sum", F.coalesce("chain_start", F.lit(0)).alias("chain_start")), "chains")
    above = chains.select("chain", F.explode(F.split("path", "/")).alias("upper")).where("upper <> chain")
    spans = chains.select(F.col("chain").alias("upper"), F.col("chain_start").alias("a"), (F.col("chain_start") + F.col("sum")).alias("b"))
    uppers = written(above.join(spans, "upper").groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("uppers")), "uppers")
    above_it = uppers.select("chain", F.size("uppers").alias("n"), F.aggregate("uppers", F.lit(0).cast("long"), lambda t, x: t + x["b"] - x["a"]).alias("upper_tokens"))
    known = written(chains.select("chain", "root", "chain_start").join(above_it, "chain", "left"), "known-chains")
    inside = earlier(ranged(slim, "chain", "depth", "node"), "chain", "inside", F.col("n_tokens")).withColumn("inside", F.coalesce("inside", F.lit(0)))
    placed = written(inside.select("node", "chain", "inside"), "inside").join(known, "chain")
    return placed.select(
        "node", "chain", "root", "inside", (F.col("chain_start") + F.col("inside")).alias("start"), (F.coalesce("upper_tokens", F.lit(0)) + F.col("inside")).alias("position"),
        (F.coalesce("n", F.lit(0)) + (F.col("inside") > 0).cast("int")).cast("long").alias("n_attends"),
    ), uppers


def attended(placed: DataFrame, uppers: DataFrame) -> DataFrame:
    """Rows of ``forest_of`` with ``attends`` in place of what it is made of: the chains above and the own chain before the node."""
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    own = F.when(F.col("inside") > 0, F.array(F.struct((F.col("start") - F.col("inside")).alias("a"), F.col("start").alias("b")))).otherwise(none)
    return placed.join(uppers, "chain", "left").withColumn("attends", F.concat(F.coalesce("uppers", none), own)).drop("uppers", "inside")


def prefix_forest(turns: DataFrame, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """One row a node: NODES, chain, root, start, position, n_attends, attends."""
    nodes = nodes_of(turns, ranks_path)
    placed, uppers = forest_of(nodes, paths_of(turns)[1])
    return nodes.join(attended(written(placed, "placed"), uppers), "node")


READ = "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Turns, digests and lengths of each conversation, from the segments on its path (conv, at, node).

    A task streams its conversations in order; what it keeps is the state of the current one's digests."""
    pieces = paths.select("conv", "at", "node").join(nodes.select("node", "segment", "loss_start", "loss_end", "text_start"), "node")
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ("conv", "segment", "loss_start", "loss_end", "text_start")
    in_order = written(pieces, "pieces").repartition(parts, "conv").sortWithinPartitions("conv", "at").select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done = None, []

        def table() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[]] * 6
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in READ.split(", ")])

        def close() -> None:
            if current is not None:
                conv, n, turns, size, loss, chars = current
                done.append((conv, n, turns.hexdigest(), size, loss.hexdigest(), chars))

        for batch in batches:
            done = []
            for conv, s, a, b, c in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
                if current is None or conv != current[0]:
                    close()
                    current = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, masked = s[len(OPEN) + 1 : c - 2], s[c : -len(CLOSE)], unescape(s[a:b])
                current[1] += 1
                current[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                current[3] += len(masked)
                current[4].update(masked.encode())
                current[5] += len(s)
            yield table()
        done = []
        close()
        yield table()

    return in_order.mapInArrow(run, READ)


def digested(rows: DataFrame, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """One row a conversation, read back from the segments on its path: what a reader of the output gets, without places."""
    turns = turns_of(rows)
    nodes = nodes_of(turns, ranks_path)
    distinct, paths = paths_of(turns)
    return _for_each(turns, written(distinct.join(read_back(paths, nodes), "conv").drop("conv"), "ends"))


def formatted_conversations(rows: DataFrame, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """One row a conversation, read back from the forest, with the place of its last turn in it: its tree, the start and number
    of its tokens in the tree's sequence, their first position id, and the intervals of the ancestors that they attend to."""
    turns = turns_of(rows)
    nodes = nodes_of(turns, ranks_path)
    distinct, paths = paths_of(turns)
    placed, uppers = forest_of(nodes, paths)
    sizes = nodes.select(F.col("node").alias("leaf"), "n_tokens")
    leaves = attended(placed.withColumnRenamed("node", "leaf").join(sizes, "leaf").join(distinct.select("leaf"), "leaf"), uppers)
    where = leaves.select("leaf", F.col("root").alias("tree"), "start", "n_tokens", "position", "n_attends", "attends")
    return _for_each(turns, written(distinct.join(read_back(paths, nodes), "conv").drop("conv").join(where, "leaf"), "ends"))


def _for_each(turns: DataFrame, ends: DataFrame) -> DataFrame:
    """The rows of distinct conversations (by leaf) for each conversation that ends there."""
    convs = written(turns.groupBy("conv").agg(F.max_by("node", "depth").alias("leaf"), F.first("conv_id").alias("conv_id")).select("conv_id", "leaf"), "conversations")
    return convs.join(ends, "leaf").drop("leaf")


#: A conversation of control strings alone, added to those of the table.
PROBE = "</s>[INST] ok [/INST]"


def with_probe(rows: DataFrame) -> DataFrame:
    probe = rows.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(PROBE).alias("text")
    )
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)


_ESCAPED = "replace({0}, '␛', '␛e')"
for _control, _letter in CONTROL.items():
    _ESCAPED = f"replace({_ESCAPED}, '{_control}', '␛{_letter}')"

#: Of ``digested``; token places have no SQL, tests hold them against brute force.
ORACLE_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS depth FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY depth)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY depth) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<s>[' || {_ESCAPED.format("role")} || ']' || chr(10) || {_ESCAPED.format("text")} || '</s>' || chr(10)))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
