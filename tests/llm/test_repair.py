import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpusflow.llm import repair

from .data import collected

SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?")


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = [c for c in text if c not in repair.BLANKS]
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute(rows):
    """Cost, audit and repaired turns of ordered (role, text), by trying all edits with up to three inserts at a place."""
    faults, best = faults_of(rows), None

    def walk(i, cost, audit, out):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and PATTERN.fullmatch("".join(r[:1] if r[:1] in ("s", "u", "a") else "x" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
        if not audit.endswith("III") and cost + 2 <= (best[0] if best else 3 * len(rows)):
            for role in ("user", "assistant"):
                walk(i, cost + 2, audit + "I", [*out, (role, "")])
        if i < len(rows):
            role, text = rows[i]
            walk(i + 1, cost + 3, audit + "D", out)
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                walk(i + 1, cost + more, audit + "K", [*out, (role, text)])
                for new in ("user", "assistant"):
                    walk(i + 1, cost + 2 + more, audit + "R", [*out, (new, text)])

    walk(0, 0, "", [])
    return best


def report(rows):
    """The whole row of one conversation, from (turn, role, text)."""
    rows = sorted((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text) for turn, role, text in rows)
    turns = [t for known, t, _, _ in rows if known]
    said = [(r, t) for _, _, r, t in rows]
    faults = faults_of(said)
    cost, audit, out = brute(said)
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(said, said[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def conversations():
    rng, found = random.Random(5), []
    for c in range(120):
        for _ in range(rng.randint(1, 5)):
            turn = rng.choice([None, *range(-2, 9)])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "ux", None, ""])
            found.append((None if c == 7 else c, turn, role, rng.choice(["Yes.", "No!", "what?\n", "cut off", "", " \t", None, "é。", "Yes. "])))
    return found


def by_conversation(rows):
    found = {}
    for conv, *rest in rows:
        found.setdefault(conv, []).append(rest)
    return found


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("run", [1024, 2])
def test_equals_brute_force(spark, monkeypatch, run):
    """With conversations in one run each, and cut into runs of two rows."""
    monkeypatch.setattr(repair, "RUN", run)
    rows = conversations()
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.repair_report(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == {c: report(x) for c, x in by_conversation(rows).items()}


def test_repaired_rows(spark):
    rows = conversations()
    got = {}
    for r in sorted(repair.repair(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: (r["at"], r["step"])):
        got.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for c, x in by_conversation(rows).items():
        assert hashlib.sha256("\n".join(got.get(c, [])).encode()).hexdigest() == report(x)[-1]
    assert all(PATTERN.fullmatch("".join(s[0] for s in said)) for said in got.values())


@pytest.mark.parametrize("seed", range(6))
def test_weights_join(seed):
    """The weights of all rows are those of their parts, however they are cut; the least one is the cheapest and ASCII-least audit."""
    rng = random.Random(seed)
    rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(40)]
    one = repair.decision(repair.weights_of(rows), repair.digits(40))
    for _ in range(5):
        cuts = sorted(rng.sample(range(1, 40), rng.randint(1, 8)))
        parts = [rows[a:b] for a, b in itertools.pairwise([0, *cuts, 40])]
        assert repair.decision(*repair.whole([(repair.weights_of(p), repair.digits(len(p))) for p in parts])) == one


def test_one_conversation_of_many_rows(spark, monkeypatch):
    """It is cut into runs; the audit fits the rows, its cost is that of its letters, and the roles alternate."""
    monkeypatch.setattr(repair, "RUN", 64)
    rows = [(1, t, ("user", "assistant", "user", "system")[t * 7 % 11 % 4], f"turn {t}" + (".", "", "!")[t % 3]) for t in range(5000)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    got = {r["conv_id"]: r for r in repair.repair_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    audit = got[1]["audit"]
    letters = [c for c in audit if c != "I"]
    truncated = [not x[3].endswith((".", "!")) for x in rows[:5000]]
    assert len(letters) == 5000 and got[1]["cost"] == sum(repair.COST[c] for c in audit) + sum(t and c != "D" for t, c in zip(truncated, letters, strict=True))
    whole = repair.weights_of([(x[2][0], False, t) for x, t in zip(rows[:5000], truncated, strict=True)])
    assert repair.decision(whole, repair.digits(5000)) == (got[1]["cost"], audit)
    assert (got[2]["cost"], got[2]["audit"]) == (0, "KK")


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in range(5)] + [(None, None, None, None), (3, None, "user", "x")]
    expected = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        expected += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert collected(repair.damaged(spark.createDataFrame(rows, SCHEMA))) == sorted(expected, key=repr)


def test_edge_cases(spark):
    none = spark.createDataFrame([], SCHEMA)
    ids = spark.createDataFrame([(1,), (None,), (1,)], "conv_id long")
    assert repair.repair_report(none).count() == 0 and repair.repair(none).count() == 0
    zero = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert collected(repair.repair_report(none, ids)) == sorted([(1, *zero), (None, *zero)], key=repr)
    rows = spark.createDataFrame([(1, 0, "user", "a." * 400_000), (1, 1, "assistant", "x" * 800_000), (None, None, None, None)], SCHEMA)
    extra = rows.withColumns({n: F.lit(7) for n in ("conv", "part", "at", "run", "fault", "first", "said", "twin", "turns", "copy", "kind")})
    assert collected(repair.repair_report(extra)) == collected(repair.repair_report(rows))
    named = rows.withColumn("conv_id", F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    assert {r["conv_id"] for r in repair.damaged_report(named).collect()} == {"c1", None}
