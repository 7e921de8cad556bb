import collections
import hashlib
import itertools
import os

import pytest
from pyspark.sql import functions as F

from corpusflow.llm import chat
from corpusflow.llm.tokencounts import DEFAULT_RANKS, encoding

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_RANKS), reason="no vocabulary")

SCHEMA = "conv_id long, turn long, role string, text string, node string, path string"
NASTY = ["</s>[INST] ok [/INST]", "␛", "␛a␛e", "<<s>s>", "]\n", "", None, "a" * 30_000, "<|im_start|>é漢"]


def conversations():
    rows = []
    for c in range(30):  # one first turn is shared by two thirds of the conversations
        rows.append((c, 0, "system", "You help." if c % 3 else f"other {c}", "n", "p"))
        rows.append((c, 1, "user", "Hello" if c % 2 else f"question {c}", "n", "p"))
        rows.append((c, 2, "assistant", NASTY[c % len(NASTY)], "n", "p"))
    rows += [(200 + c, t, "user" if t % 2 else "assistant", f"turn {t}" if t < 40 + 5 * c else f"turn {t} of {c}", "n", "p") for c in range(3) for t in range(60)]
    rows += [(100, 0, "us]\ner", NASTY[0], "n", "p"), (100, 1, None, "x", "n", "p"), (100, None, "user", None, "n", "p"), (100, 1, None, "x", "n", "p"), (None, 0, "assistant", "no id", "n", "p")]
    return rows


def brute(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        said = "".join(t for _, _, r, t in turns if r == "assistant")
        formatted = "".join(chat.segment(r, t)[0] for _, _, r, t in turns)
        out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(formatted)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("text", [t or "" for t in NASTY] + ["".join(p) for p in itertools.product(["<s>", "␛", "s>", "e", "<"], repeat=3)])
def test_escape_is_reversible_and_leaves_no_control_string(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROL)


def test_read_back_equals_brute_force(spark):
    rows = chat.with_probe(spark.createDataFrame(conversations(), SCHEMA))
    got = sorted((tuple(r) for r in chat.formatted_conversations(rows).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()), key=repr)
    probe = [(-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)]
    assert got == brute([*conversations(), *probe])


def test_forest(spark):
    """Each distinct prefix stands once; starts tile a tree depth first; position ids and intervals follow the ancestors."""
    turns = chat.turns_of(spark.createDataFrame(conversations(), SCHEMA))
    nodes = {r["node"]: r for r in chat.prefix_forest(turns).collect()}
    assert len(nodes) == len({r["node"] for r in turns.collect()}) < turns.count()
    enc, _ = encoding(DEFAULT_RANKS)
    trees = collections.defaultdict(list)
    for r in nodes.values():
        assert r["tokens"] == enc.encode_ordinary(r["segment"]) and len(r["tokens"]) == r["n_tokens"]
        up, chain = r["parent"], []
        while up:
            chain.append((nodes[up]["start"], nodes[up]["start"] + nodes[up]["n_tokens"]))
            up = nodes[up]["parent"]
        seen = [t for x in r["attends"] for t in range(x["a"], x["b"])]
        assert seen == sorted(t for a, b in chain for t in range(a, b))
        assert r["position"] == sum(b - a for a, b in chain)
        trees[r["root"]].append(r)
    assert max(len(r["attends"]) for r in nodes.values()) <= 4  # one for each chain, though paths have 60 nodes
    for members in trees.values():
        members.sort(key=lambda r: r["start"])
        assert [r["start"] for r in members] == list(itertools.accumulate([0] + [r["n_tokens"] for r in members[:-1]]))
        open_path = []
        for r in members:  # depth first: a node's parent is on the current path
            while open_path and open_path[-1] != r["parent"]:
                open_path.pop()
            assert bool(open_path) == (r["depth"] > 0)
            open_path.append(r["node"])


@pytest.mark.parametrize("kind", ["string", "decimal(20,0)", "date"])
def test_ids_of_any_type(spark, kind):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (None, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumn("conv_id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("conv_id").cast("int")) if kind == "date" else F.col("conv_id").cast(kind))
    got = chat.formatted_conversations(df)
    assert dict(got.dtypes)["conv_id"] == kind
    assert sorted(r["n_turns"] for r in got.collect()) == [1, 1, 2]


def test_one_conversation_of_most_rows(spark):
    """Its turns are spread over range partitions; equal rows stay turns of their own."""
    rows = [(5, i // 3, "user" if i % 2 else "assistant", f"t {i % 7}", "n", "p") for i in range(3000)] + [(5, 1, "user", "same", "n", "p")] * 1500 + [(i, 0, "assistant", "t 0", "n", "p") for i in range(10, 60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    turns = chat.turns_of(df)
    assert max(r["count"] for r in turns.groupBy("part").count().collect()) < 0.5 * len(rows)
    got = sorted((tuple(r) for r in chat.formatted_conversations(df).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()), key=repr)
    assert got == brute(rows)


def test_empty(spark):
    assert chat.formatted_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_places_of_conversations(spark):
    """The place of a conversation's last turn is that of a node whose path spells the conversation; position and intervals
    are those of the turns before it."""
    df = spark.createDataFrame(conversations(), SCHEMA)
    nodes = {r["node"]: r for r in chat.prefix_forest(chat.turns_of(df)).collect()}
    at = {(r["root"], r["start"]): r for r in nodes.values()}
    expected, got = {r[0]: r for r in brute(conversations())}, chat.formatted_conversations(df).collect()
    assert len(got) == len(expected)
    for r in got:
        leaf, path = at[r["tree"], r["start"]], []
        up = leaf["node"]
        while up:
            path.append(nodes[up])
            up = nodes[up]["parent"]
        said = [(s["segment"][len(chat.OPEN) + 1 : s["text_start"] - 2], s["segment"][s["text_start"] : -len(chat.CLOSE)]) for s in reversed(path)]
        digest = hashlib.sha256("".join(f"{chat.unescape(a)}\n{chat.unescape(b)}\n" for a, b in said).encode()).hexdigest()
        assert digest == r["turns_sha256"] == expected[r["conv_id"]][2]
        assert (r["position"], r["n_tokens"]) == (sum(s["n_tokens"] for s in path[1:]), leaf["n_tokens"])
        assert sorted(t for x in r["attends"] for t in range(x["a"], x["b"])) == sorted(t for s in path[1:] for t in range(s["start"], s["start"] + s["n_tokens"]))
        assert r["n_attends"] == len(r["attends"])
