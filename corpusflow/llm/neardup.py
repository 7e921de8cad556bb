"""N-gram Jaccard self-join: MinHash LSH forest, then exact verification.

Texts become sets of five-word shingles (a text of fewer words is one shingle). Identical texts are one node. Every node
gets ``trees`` labels of ``depth`` MinHash values; a tree's labels in sort order form a prefix trie, and nodes with a
common prefix of some depth are one run of it. Prefixes start at the full depth and are shortened, all trees together,
until a link at the threshold shares a run with at least the target probability, ``1 - (1 - t**d)**trees``.

In each run every node is first paired with one pivot (the run's least node under the tree's own random order). Pairs
whose sketches agree enough connect nodes to candidate components. Runs whose nodes are then still in several components
are searched whole: every two of their nodes of different components are compared by sketch, in blocks of ``RUN_NODES``,
and those that agree connect their components. So two texts of a run whose sketches agree are always in one component,
whatever the pivot is. Within a small component all pairs are verified exactly, in one task for many components. Of a
component of more than ``BLOCK_WORDS`` words or ``BLOCK_NODES`` texts, the pairs that share a run are counted. Where they
are so few that listing them moves fewer texts than blocks would, as in a long chain of versions, they are listed, those
whose sketches agree are verified, and work grows with the number of pairs. Else, as in a group of near copies, the component
is split into blocks, and each pair of blocks is a task of bounded size that returns counts and a spanning forest, no pairs.

Defined cases: texts that are null or have no words are linked to nothing and are classes of their own; identical texts
share a class and count as one node; repeated rows are copies; an empty table gives an empty table; a very long text is
hashed slice by slice and kept as the hashes of its shingles, 8 bytes each; other columns are not read (``one_of_each``
passes them through, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .components import connected_components
from .scratch import written

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, TARGET_RECALL = 20, 8, 0.9995
#: Sketch agreement at which two nodes of a run are connected; 0.8 is over six standard deviations away.
SKETCH_LEAST = 0.6
BLOCK_WORDS, BLOCK_NODES, BIN_WORDS = 200_000, 1000, 100_000
RUN_NODES, BIN_NODES = 2000, 20_000
#: A component is verified pair by pair if its pairs in common runs number at most so much of its nodes times its blocks: a pair
#: moves two texts, and blocks move each text once for each block.
CHAIN_SHARE = 0.5
#: Shingles that are hashed into sketches at once.
SKETCH_AT_ONCE = 1 << 17

_rng = np.random.default_rng(5)
_ODD = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64)
_TIMES = _rng.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def recall(similarity: float, depth: int, trees: int = TREES) -> float:
    """Probability that two texts of this similarity share a run of this prefix depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(threshold: float = THRESHOLD, target: float = TARGET_RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix that reaches the target recall at the threshold."""
    while depth > 1 and recall(threshold, depth, trees) < target:
        depth -= 1
    return depth


def shingles(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit shingle hashes (with repeats), their text numbers in order, and the number of words of each text."""
    starts, ends, of = ta.words(buf, offs)
    h = ta.hashes(buf, starts, ends)
    n_words = np.bincount(of, minlength=len(offs) - 1)
    at = np.flatnonzero(of[WORDS - 1 :] == of[: len(of) - WORDS + 1]) if len(of) >= WORDS else np.zeros(0, np.int64)
    value = np.zeros(len(at), np.uint64)
    for j in range(WORDS):
        value += h[at + j] * _ODD[j]
    few = np.flatnonzero((n_words > 0) & (n_words < WORDS))
    if len(few):
        first = (np.cumsum(n_words) - n_words)[few]
        whole = n_words[few].astype(np.uint64)
        for j in range(WORDS - 1):
            there = n_words[few] > j
            whole[there] += h[first[there] + j] * _ODD[j]
        value, owner = np.concatenate((value, whole)), np.concatenate((of[at], few))
        order = np.argsort(owner, kind="stable")
        return ta.mix(value[order]), owner[order], n_words
    return ta.mix(value), of[at], n_words


def sketches(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """TREES * DEPTH 16-bit MinHash values of each text, big-endian; zeros for texts without shingles."""
    least = np.full((n, TREES * DEPTH), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(values), SKETCH_AT_ONCE):
        some, whose = values[a : a + SKETCH_AT_ONCE], of[a : a + SKETCH_AT_ONCE]
        first = np.flatnonzero(np.concatenate(([True], whose[1:] != whose[:-1])))
        for p in range(TREES * DEPTH):
            least[whose[first], p] = np.minimum(least[whose[first], p], np.minimum.reduceat((some ^ _XOR[p]) * _TIMES[p], first))
    out = (ta.mix(least) & np.uint64(0xFFFF)).astype(">u2")
    out[np.bincount(of, minlength=n) == 0] = 0
    return out


def text_node(text: Column) -> Column:
    """Key of a text, null for those without a word."""
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(text)))


def signed(texts: DataFrame) -> DataFrame:
    """(node, words, sketch) of (node, text), once for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            new = [not (k in seen or seen.add(k)) for k in batch.column("node").to_pylist()]
            for part in ta.chunks(batch.filter(pa.array(new, pa.bool_())), "text"):
                buf, offs = ta.buffers(part.column("text"))
                values, of, n_words = shingles(buf, offs)
                raw = sketches(values, of, part.num_rows).tobytes()
                width = 2 * TREES * DEPTH
                rows = pa.array([raw[i * width : (i + 1) * width] for i in range(part.num_rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(n_words, pa.int64()), rows], ["node", "words", "sketch"])

    return texts.mapInArrow(run, "node binary, words long, sketch binary").dropDuplicates(["node"])


def runs(signs: DataFrame, depth: int) -> DataFrame:
    """(run, node, pivot) of all runs of two or more nodes."""
    label = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.substring("sketch", t * 2 * DEPTH + 1, 2 * depth)))
    in_run = signs.select("node", F.posexplode(label).alias("tree", "run"))
    ranked = in_run.withColumn("rank", F.xxhash64("node", "tree"))
    pivots = ranked.groupBy("run").agg(F.min(F.struct("rank", "node")).alias("p"), F.count("*").alias("n")).where("n > 1").select("run", F.col("p.node").alias("pivot"))
    # Written, so that the join deals both sides anew and a very large run can be split over tasks.
    return in_run.join(written(pivots, "run-pivots"), "run").select("run", "node", "pivot")


def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sketches agree enough."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, TREES * DEPTH) for c in ("sketch_a", "sketch_b"))
        near = (x == y).mean(axis=1) >= SKETCH_LEAST
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near))


def agreeing(signs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the different pairs (a, b) whose sketches agree enough."""
    of_a = signs.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"))
    of_b = signs.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"))

    return pairs.join(of_a, "a").join(of_b, "b").mapInArrow(close, "a binary, b binary")


def bridges(table: pa.Table) -> pa.Table:
    """(a, b): a spanning forest of the components that agree in one task: whole runs, or one pair of blocks of a run."""
    run, part = (table.column(c).to_numpy() for c in ("run", "part"))
    component = table.column("component").to_pylist()
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, TREES * DEPTH)
    low, high = (table.column(c).to_numpy() for c in ("low", "high"))
    number = {c: n for n, c in enumerate(dict.fromkeys(component))}
    of = np.array([number[c] for c in component])
    names, out_a, out_b = list(number), [], []
    order = np.argsort(run, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], run[order][1:] != run[order][:-1], [True])))
    for c, d in zip(cuts[:-1], cuts[1:], strict=True):
        rows = order[c:d]
        same = low[rows[0]] == high[rows[0]]
        left = rows if same else rows[part[rows] == low[rows[0]]]
        right = rows if same else rows[part[rows] != low[rows[0]]]
        parent = {n: n for n in np.unique(of[rows]).tolist()}
        for k, i in enumerate(left):
            others = right[k + 1 :] if same else right
            others = others[of[others] != of[i]]
            near = others[(sketch[others] == sketch[i]).mean(axis=1) >= SKETCH_LEAST]
            for n in np.unique(of[near]).tolist():
                x, y = find(parent, int(of[i])), find(parent, n)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out_a.append(names[of[i]]), out_b.append(names[n])
    return pa.table([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], ["a", "b"])


def candidates(signs: DataFrame, members: DataFrame) -> DataFrame:
    """(node, component): nodes connected by agreement with any other node of any of their ``runs``."""
    with_pivot = members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    first = written(connected_components(written(agreeing(signs, with_pivot), "pivots")), "first")
    named = written(members.join(first, "node", "left").select("run", "node", F.coalesce("root", "node").alias("component")), "named")
    mark = F.xxhash64("component")
    mixed = named.groupBy("run").agg(F.count("*").alias("n"), F.min(mark).alias("least"), F.max(mark).alias("most")).where("least <> most")
    parts = F.ceil(F.col("n") / RUN_NODES)
    open_runs = written(named.join(written(mixed.select("run", parts.alias("parts")), "mixed-runs"), "run"), "open")
    bins = max(1, open_runs.count() // BIN_NODES)
    placed = open_runs.withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    placed = placed.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
    task = F.when(F.col("parts") > 1, F.concat_ws("-", "run", "low", "high")).otherwise(F.pmod("run", F.lit(bins)).cast("string"))
    rows = placed.join(signs.select("node", "sketch"), "node").select(task.alias("task"), "run", "part", "low", "high", "component", "sketch")
    joined = connected_components(written(rows.groupBy("task").applyInArrow(bridges, "a binary, b binary"), "bridges"))
    wider = joined.select(F.col("node").alias("root"), F.col("root").alias("component"))
    old = first.join(wider, "root", "left").select("node", F.coalesce("component", "root").alias("component"))
    new = joined.join(first, "node", "left_anti").select("node", F.col("root").alias("component"))
    return old.union(new)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sorted sets of shingles, by products of incidence matrices."""
    values = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    new = np.concatenate(([True], values[1:] != values[:-1]))
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    keep = often[column]
    column, row = (np.cumsum(often) - 1)[column[keep]], row[keep]
    total = np.zeros((len(left), len(right)), np.float32)
    step = 2048
    bounds = np.searchsorted(column, np.arange(0, int(often.sum()) + step, step))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        some = np.zeros((len(left) + len(right), step), np.float32)
        some[row[a:b], column[a:b] % step] = 1
        total += some[: len(left)] @ some[len(left) :].T
    return total.astype(np.int64)


def find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def verify(table: pa.Table, threshold: float) -> pa.Table:
    """Link counts and a spanning forest of one task: whole components, or one pair of blocks of a component."""
    share = Fraction(str(threshold))
    nodes, component = table.column("node").to_pylist(), table.column("component").to_pylist()
    block, low, high = (table.column(c).to_pylist() for c in ("block", "low", "high"))
    sets: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(nodes)
    at = 0
    batch = pa.RecordBatch.from_arrays([table.column("text").combine_chunks()], ["text"]) if len(nodes) else None
    for part in ta.chunks(batch, "text") if batch is not None else ():
        values, of, _ = shingles(*ta.buffers(part.column("text")))
        cuts = np.searchsorted(of, np.arange(part.num_rows + 1))
        for i in range(part.num_rows):
            sets[at + i] = np.unique(values[cuts[i] : cuts[i + 1]])
        at += part.num_rows
    members: dict[bytes, list[int]] = {}
    for i, c in enumerate(component):
        members.setdefault(c, []).append(i)
    out_node, out_links, out_root = [], [], []
    for rows in members.values():
        same = low[rows[0]] == high[rows[0]]
        left = rows if same else [i for i in rows if block[i] == low[i]]
        right = rows if same else [i for i in rows if block[i] != low[i]]
        if not left or not right:
            continue
        shared = overlaps([sets[i] for i in left], [sets[i] for i in right])
        size = np.array([len(s) for s in sets], np.int64)
        union = size[left][:, None] + size[right][None, :] - shared
        linked = share.denominator * shared >= share.numerator * union
        if same:
            np.fill_diagonal(linked, False)
        place = {i: n for n, i in enumerate(rows)}
        parent = list(range(len(rows)))
        # One link to each connected part is enough: stop early where all are one.
        for x, i in enumerate(left):
            for y in np.flatnonzero(linked[x]):
                a, b = find(parent, place[i]), find(parent, place[right[y]])
                if a != b:
                    parent[max(a, b)] = min(a, b)
        links = dict.fromkeys(rows, 0)
        for x, i in enumerate(left):
            links[i] += int(linked[x].sum())
        if not same:
            for y, i in enumerate(right):
                links[i] += int(linked[:, y].sum())
        least: dict[int, bytes] = {}
        for i in rows:
            r = find(parent, place[i])
            least[r] = min(least.get(r, nodes[i]), nodes[i])
        for i in rows:
            out_node.append(nodes[i]), out_links.append(links[i]), out_root.append(least[find(parent, place[i])])
    return pa.table([pa.array(out_node, pa.binary()), pa.array(out_links, pa.int64()), pa.array(out_root, pa.binary())], ["node", "links", "root"])


def chains_of(members: DataFrame, large: DataFrame) -> DataFrame:
    """(component) of the large components (node, component, blocks) with few pairs in common runs."""
    grouped = members.select("run", "node").join(large, "node").groupBy("component", "run").agg(F.count("*").alias("n"))
    counted = grouped.groupBy("component").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), F.max("n").alias("most"))
    sizes = large.groupBy("component").agg((F.count("*") * F.first("blocks")).alias("moved"))
    return counted.join(sizes, "component").where((F.col("pairs") <= F.col("moved") * CHAIN_SHARE) & (F.col("most") <= RUN_NODES)).select("component")


def chain_pairs(members: DataFrame, chained: DataFrame) -> DataFrame:
    """(a, b): the pairs of nodes (node, component) that are in one component and in a common run."""
    held = members.select("run", "node").join(chained, "node").groupBy("component", "run").agg(F.sort_array(F.collect_list("node")).alias("nodes")).where(F.size("nodes") > 1)
    each = held.select("nodes", F.posexplode("nodes").alias("i", "a"))
    return each.select("a", F.explode(F.slice("nodes", F.col("i") + 2, F.size("nodes"))).alias("b")).distinct()


def verified(pairs: DataFrame, once: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) that are links; ``once`` has the text of each node."""
    share = Fraction(str(threshold))
    rows = pairs.join(once.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(once.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
            for part in ta.chunks(batch.select([column]), column):
                values, of, _ = shingles(*ta.buffers(part.column(column)))
                cuts = np.searchsorted(of, np.arange(part.num_rows + 1))
                for i in range(part.num_rows):
                    yield np.unique(values[cuts[i] : cuts[i + 1]])

        for batch in batches:
            linked = []
            for x, y in zip(sets(batch, "text_a"), sets(batch, "text_b"), strict=True):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(share.denominator * shared >= share.numerator * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return rows.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def linked_nodes(texts: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """(node, links, root) of the nodes that were candidates; root is the least node of the class."""
    signs = written(signed(texts), "sketches")
    members = written(runs(signs, prefix_depth(threshold, target)), "runs")
    sized = written(candidates(signs, members).join(signs.select("node", "words"), "node"), "components")
    blocks = written(sized.groupBy("component").agg(F.greatest(F.ceil(F.sum("words") / BLOCK_WORDS), F.ceil(F.count("*") / BLOCK_NODES)).alias("blocks")), "blocks")
    once = texts.groupBy("node").agg(F.first("text").alias("text"))
    large = blocks.where("blocks > 1")
    if large.isEmpty():
        return blockwise(sized, blocks, once, threshold)
    in_large = written(sized.join(large, "component").select("node", "component", "blocks"), "large")
    chains = written(chains_of(members, in_large), "chains")
    if chains.isEmpty():
        return blockwise(sized, blocks, once, threshold)
    chained = written(in_large.join(chains, "component", "left_semi").select("node", "component"), "chained")
    pairs = written(agreeing(signs, chain_pairs(members, chained)), "agreeing")
    held = written(once.join(chained.select("node"), "node", "left_semi"), "chained-texts")
    links = written(verified(pairs, held, threshold), "chain-links")
    counts = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("links"))
    along = counts.join(connected_components(links), "node").select("node", "links", "root")
    rest = sized.join(chains, "component", "left_anti"), blocks.join(chains, "component", "left_anti")
    return blockwise(*rest, once, threshold).union(along)


def blockwise(sized: DataFrame, blocks: DataFrame, once: DataFrame, threshold: float) -> DataFrame:
    """``linked_nodes`` by the pairs within each component: whole small components, and pairs of blocks of large ones."""
    some = sized.agg(F.sum("words")).first()[0] or 0
    bins = max(1, some // BIN_WORDS)
    placed = sized.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    other = F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0).cast("long"))))
    placed = placed.withColumn("other", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    task = F.when(F.col("blocks") > 1, F.concat_ws("-", F.hex("component"), "low", "high")).otherwise(F.pmod(F.xxhash64("component"), F.lit(bins)).cast("string"))
    rows = placed.join(once, "node").select(task.alias("task"), "component", "block", "low", "high", "node", "text")
    checked = written(rows.groupBy("task").applyInArrow(lambda t: verify(t, threshold), "node binary, links long, root binary"), "links")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    if blocks.where("blocks > 1").isEmpty():
        roots = checked.select("node", "root")
    else:  # the forests of the block pairs of a component belong together
        roots = connected_components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return links.join(roots, "node", "left").select("node", "links", F.coalesce("root", "node").alias("root"))


def classes(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """(node, links, copies, class_id, keeper): per distinct text with words; keeper is the node with the class's least id."""
    texts = docs.select(text_node(F.col(text_col)).alias("node"), F.col(text_col).alias("text")).where("node is not null")
    linked = linked_nodes(texts, threshold, target)
    per_node = docs.select(F.col(id_col).alias("id"), text_node(F.col(text_col)).alias("node")).where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    whole = per_node.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = written(whole.select("node", "id", "copies", F.coalesce("links", F.lit(0)).alias("links"), "root"), "classes")
    first = whole.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "node")).alias("first"))
    return whole.join(first, "root").select("node", "links", "copies", F.col("first.id").alias("class_id"), F.col("first.node").alias("keeper"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """One row a document: id, class_id (least id of the class), n_links (other texts at the threshold), n_copies (rows with this text)."""
    found = classes(docs, id_col, text_col, threshold, target)
    rows = docs.select(F.col(id_col), text_node(F.col(text_col)).alias("node"))
    worded = rows.where("node is not null").join(found, "node").select(F.col(id_col), "class_id", F.col("links").alias("n_links"), F.col("copies").alias("n_copies"))
    alone = rows.where("node is null").select(F.col(id_col), F.col(id_col).alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return worded.unionByName(alone)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """One document of each class, that with the least id, with all its columns; documents without words all stay."""
    keepers = classes(docs, id_col, text_col, threshold, target).where("node = keeper").select("node")
    named = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), text_node(F.col(text_col)).alias("node"))
    one = named.where("node is not null").groupBy("node").agg(F.min_by("_doc", F.struct(F.col("_id").isNull(), "_id")).alias("_doc"))
    return one.join(keepers, "node", "left_semi").select("_doc.*").unionByName(named.where("node is null").select("_doc.*"))


#: Every pair of texts that shares a shingle is compared; classes by the least id that reaches a text over links.
ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS k, text, min(doc_id) AS id, count(*) AS copies FROM documents WHERE regexp_matches(text, '[^\x20\x09-\x0D]') GROUP BY text),
w AS (SELECT k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
s AS (SELECT DISTINCT k, array_to_string(ws[i:i+4], ' ') AS shingle FROM (SELECT k, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w)),
n AS (SELECT k, count(*) AS size FROM s GROUP BY k),
p AS (SELECT a.k AS x, b.k AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.k <> b.k GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.k = x JOIN n ny ON ny.k = y WHERE 5 * shared >= 4 * (nx.size + ny.size - shared)),
r(k, id) AS (SELECT k, id FROM t UNION SELECT l.y, r.id FROM r JOIN l ON l.x = r.k JOIN t ON t.k = l.y WHERE r.id < t.id),
c AS (SELECT k, min(id) AS class_id FROM r GROUP BY k),
m AS (SELECT x AS k, count(*) AS n_links FROM l GROUP BY x)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(copies, 1) AS n_copies
FROM documents d LEFT JOIN t ON d.text = t.text LEFT JOIN c ON c.k = t.k LEFT JOIN m ON m.k = t.k
"""
