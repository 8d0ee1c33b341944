"""Conversation repair against exhaustive search and a plain loop."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np

from tidewell.llm import repair
from tidewell.session import load

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def searched(rows):
    """(cost, audit, repaired) over all edits with up to two inserted rows at a place."""
    slots = [()] + [(a,) for a in "ua"] + [(a, b) for a in "ua" for b in "ua"]
    names = {"u": "user", "a": "assistant"}
    best = None
    flaws = faults(rows)
    for edits in itertools.product("KDua", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and e != "D" for e, f in zip(edits, flaws)):
            continue
        for filled in itertools.product(slots, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for i, slot in enumerate(filled):
                for x in slot:
                    cost, audit = cost + 5, audit + "I"
                    out.append((names[x], ""))
                if i < len(rows):
                    e = edits[i]
                    audit += e if e in "KD" else "R"
                    cost += {"K": 0, "D": 2}.get(e, 1) + (5 if e != "D" and flaws[i] == "truncated" else 0)
                    if e != "D":
                        out.append((rows[i][0] if e == "K" else names[e], rows[i][1]))
            if GRAMMAR.fullmatch("".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def walked(codes):
    """Cost and audit by a plain memo over rows and states, for longer conversations."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    rest = {0: (0, ""), 1: (10, "II"), 2: (5, "I"), 3: (0, "")}
    want = {0: 2, 1: 2, 2: 3, 3: 2}
    for code in reversed(codes):
        role, fault = "sua-"[code & 3], code >> 2
        now = {}
        for s in range(4):
            options = [(2 + rest[s][0], "D" + rest[s][1])]
            if fault not in (1, 2):
                late = 5 if fault == 3 else 0
                if (s, role) in step:
                    after = rest[step[s, role]]
                    options.append((late + after[0], "K" + after[1]))
                after = rest[want[s]]
                options.append((1 + late + after[0], "R" + after[1]))
            now[s] = min(options)
        for _ in range(3):
            now = {s: min(now[s], (5 + now[want[s]][0], "I" + now[want[s]][1])) for s in range(4)}
        rest = now
    return rest[0]


def expected(table):
    """conv_id -> the contract's values, by plain Python; ``table``: (conv_id, turn, role, text)."""
    groups = {}
    for conv, turn, role, text in table:
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        rows = groups.setdefault(conv, [])
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        rows.extend([(turn, "user" if harm == 4 else role, text)] * {0: 0, 3: 2}.get(harm, 1))
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        said = [(r, t) for _, r, t in rows]
        turns = [t for t, _, _ in rows if t is not None]
        f = faults(said)
        pairs = [(a[0][:1] + b[0][:1]) for a, b in zip(said, said[1:])]
        codes = [{"s": 0, "u": 1, "a": 2}.get(r[:1], 3) + 4 * ["", "blank", "duplicate", "truncated"].index(x) for (r, _), x in zip(said, f)]
        cost, audit = walked(codes)
        repaired, state, at = [], "", 0
        for e in audit:
            want = "assistant" if state.endswith("u") else "user"
            role, text = (want, "") if e == "I" else said[at]
            at += e != "I"
            if e != "D":
                role = want if e == "R" else role
                repaired.append(f"{role}:{text}")
                state += role[:1]
        assert GRAMMAR.fullmatch(state)
        digest = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
    return out


def test_tensors_equal_exhaustive_search():
    draw = random.Random(2)
    texts = ["Hello.", "no end", " ", "Yes!", "Hello."]
    cases = [[(draw.choice(["system", "user", "assistant", "tool"]), draw.choice(texts)) for _ in range(draw.randint(0, 3))] for _ in range(60)]
    codes = [np.array([{"s": 0, "u": 1, "a": 2}.get(r[0], 3) + 4 * ["", "blank", "duplicate", "truncated"].index(f) for (r, _), f in zip(c, faults(c))], dtype=np.uint8) for c in cases]
    found = repair.repair_codes(codes)
    for case, (cost, audit), mine in zip(cases, found, codes):
        best = searched(case)
        assert (cost, audit) == best[:2], case
        assert walked(mine) == (cost, audit)


def test_long_conversations_in_pieces():
    rng = np.random.default_rng(4)
    for length in (repair.PIECE, repair.PIECE + 1, 3 * repair.PIECE, 3 * repair.PIECE + 77):
        codes = (rng.integers(0, 4, length) + 4 * rng.choice(4, length, p=[0.7, 0.1, 0.1, 0.1])).astype(np.uint8)
        assert repair.repair_codes([codes])[0] == walked(codes.tolist())


def check(spark, df):
    out = repair.repair(df)
    assert out.columns == COLUMNS
    found = {r.conv_id: tuple(r)[1:] for r in out.collect()}
    want = expected([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert found.keys() == want.keys()
    for conv, row in want.items():
        assert found[conv] == row, conv


def test_whole_table(spark, small):
    check(spark, load(spark, small, "conversations"))


def test_edges(spark):
    rows = [(None, 1, "user", "Hi."), (None, None, "user", None), (None, 2, None, "x."), (1, None, "assistant", "A."), (1, None, "assistant", "A."), (1, None, "user", "B.")]
    rows += [(2, i, ["user", "assistant"][i % 2], "x" * (i % 5) + ".") for i in range(1500)] + [(c, 0, "user", "Only.") for c in range(10, 80)]
    rows += [(3, 5, "user", "long " * 50_000), (3, 5, "user", "long " * 50_000), (3, -4, "", "?"), (4, 2**40, "system", "\x0b"), (4, 0, "system", "ü. ")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, Audit string")
    check(spark, df.repartition(3))
    assert repair.repair(df.where("false")).count() == 0
