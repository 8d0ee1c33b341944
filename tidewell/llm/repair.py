"""Repair of conversation structure by a time-major tensor DP.

The grammar of role initials is ``(s?(ua)+)?``, with four states. Conversations of one length form a tensor: going back in
time, the cost of every conversation's states is updated at once from the row's edits, all costs are kept, and
the cheapest edits are traced forward, again for all conversations at once. Rows reach the tensors as codes of one
byte; texts are only streamed into hashes. A long conversation is cut into pieces that are a batch of
their own: first each piece's costs between its entry and exit states, then the states at its ends.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import Scratch

START, SYSTEM, USER, ASSISTANT = range(4)
#: Prices of the edits, and what a truncated row costs that isn't deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAR = 1 << 40
#: The state after a row of role s, u, a or another (columns) is kept; -1: not allowed.
KEPT = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
#: The state after the only user or assistant row that may follow, and that role.
WANTED = np.array([USER, USER, ASSISTANT, USER])
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Faults in codes: role + 4 x fault.
BLANK, DUPLICATE, CUT = 1, 2, 3
DROPPED = 255
PIECE, TENSOR_ROWS = 512, 1 << 16
BLANKS = " \t\n\x0b\x0c\r"


def _relaxed(cost: np.ndarray) -> np.ndarray:
    """Costs of states where rows may be inserted: at most three are of use."""
    for _ in range(3):
        cost = np.minimum(cost, INSERT + cost[:, WANTED])
    return cost


def _row_costs(code: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What deleting, keeping and reroling a row costs from each state (conversations x states) on."""
    role, fault = code & 3, code >> 2
    forced = ((fault == BLANK) | (fault == DUPLICATE))[:, None]
    late = np.where(fault == CUT, TRUNCATED, 0)[:, None]
    state = KEPT[:, role].T
    kept = np.where(forced | (state < 0), FAR, KEEP + late + np.take_along_axis(after, np.maximum(state, 0), axis=1))
    return DELETE + after, kept, np.where(forced, FAR, REROLE + late + after[:, WANTED])


def _backward(codes: np.ndarray, terminal: np.ndarray) -> np.ndarray:
    """Costs (time + 1 x conversations x states) of the rest, given those after the last row."""
    costs = np.empty((len(codes) + 1, *terminal.shape), dtype=np.int64)
    costs[-1] = terminal
    for t in range(len(codes) - 1, -1, -1):
        costs[t] = _relaxed(np.minimum.reduce(_row_costs(codes[t], costs[t + 1])))
    return np.minimum(costs, FAR)


def _forward(codes: np.ndarray, costs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, inserts, exit states): the edit of each row and the rows inserted before it; of edits of one cost the first in ASCII."""
    state, each = state.copy(), np.arange(codes.shape[1])
    letters, inserts = np.empty(codes.shape, dtype="S1"), np.zeros(codes.shape, dtype=np.uint8)
    for t, code in enumerate(codes):
        deleted, kept, _ = _row_costs(code, costs[t + 1])
        for _ in range(3):
            here = costs[t][each, state]
            more = (deleted[each, state] != here) & (costs[t][each, WANTED[state]] + INSERT == here)
            inserts[t] += more
            state = np.where(more, WANTED[state], state)
        here = costs[t][each, state]
        is_deleted = deleted[each, state] == here
        is_kept = ~is_deleted & (kept[each, state] == here)
        letters[t] = np.where(is_deleted, b"D", np.where(is_kept, b"K", b"R"))
        state = np.where(is_deleted, state, np.where(is_kept, KEPT[state, code & 3], WANTED[state]))
    return letters, inserts, state


#: Costs after the last row: a conversation may end empty or with an assistant's row.
END = _relaxed(np.array([[0, FAR, FAR, 0]], dtype=np.int64))


def _audit(letters: np.ndarray, inserts: np.ndarray, state: int) -> str:
    tail = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}[int(state)]
    if not inserts.any():
        return letters.tobytes().decode() + "I" * tail
    where = np.repeat(np.arange(len(letters)), inserts)
    return np.insert(letters, where, b"I").tobytes().decode() + "I" * tail


def _long(codes: np.ndarray) -> tuple[int, str]:
    """Cost and audit of one conversation cut into pieces."""
    head = len(codes) % PIECE
    pieces = [codes[:head, None]] * (head > 0) + [codes[head:].reshape(-1, PIECE).T]
    between = []
    for p in pieces:
        exits = np.where(np.eye(4, dtype=bool), 0, FAR)
        costs = _backward(np.repeat(p, 4, axis=1), np.tile(exits, (p.shape[1], 1)))[0].reshape(-1, 4, 4)  # piece, exit, entry
        between.extend(costs)
    after = [END[0]]
    for costs in reversed(between):
        after.append((costs + after[-1][:, None]).min(axis=0))
    cost, after = int(after[-1][START]), after[-2::-1]  # the costs after each piece
    letters, inserts, state, at = [], [], START, 0
    for p in pieces:
        n = p.shape[1]
        costs = _backward(p, np.array(after[at : at + n]))
        exits = [_forward(p, costs, np.full(n, s))[2] for s in range(4)]
        entry = np.empty(n, dtype=int)
        for i in range(n):
            entry[i], state = state, int(exits[state][i])
        found = _forward(p, costs, entry)
        letters.append(found[0].T.ravel())
        inserts.append(found[1].T.ravel())
        at += n
    return cost, _audit(np.concatenate(letters), np.concatenate(inserts), state)


def repair_codes(conversations: list[np.ndarray]) -> list[tuple[int, str]]:
    """Cost and audit of each conversation, given its rows' codes."""
    out: list[tuple[int, str]] = [(0, "")] * len(conversations)
    buckets = defaultdict(list)
    for i, codes in enumerate(conversations):
        buckets[len(codes)].append(i)
    for length, members in buckets.items():
        if length > PIECE:
            for i in members:
                out[i] = _long(conversations[i])
        elif length:
            codes = np.stack([conversations[i] for i in members], axis=1)
            costs = _backward(codes, np.repeat(END, len(members), axis=0))
            letters, inserts, state = _forward(codes, costs, np.full(len(members), START))
            for j, i in enumerate(members):
                out[i] = (int(costs[0, j, START]), _audit(letters[:, j], inserts[:, j], state[j]))
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, tie, dropped): the damage that the contract deals by crc32 of conv_id:turn. Dropped rows
    stay, marked and without text, so that no conversation is lost."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), (F.crc32(F.concat(number("conv_id"), F.lit(":"), number("turn"))) % 20).alias("harm"),
    )
    text = F.when(F.col("harm") <= 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "harm")
    copies = F.when(F.col("harm") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.select("conv_id", "turn", "role", "text", (F.col("harm") == 0).alias("dropped"), F.explode(copies).alias("copy"))
    return rows.select("conv_id", "turn", "role", "text", F.unhex(F.md5("text")).alias("tie"), "dropped")


def _coded(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, code): each conversation's rows together and in order; no texts are moved."""
    bare = F.rtrim("text", F.lit(BLANKS))
    role = F.left("role", F.lit(1))
    rows = rows.select(
        "conv_id", "turn", "role", "tie", "dropped", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3).alias("initial"),
    ).repartition("conv_id")
    seen = Window.partitionBy("conv_id", "dropped", "role", "tie").orderBy(F.asc_nulls_first("turn"))
    rows = rows.withColumn("copy", F.row_number().over(seen))
    fault = F.when(F.col("blank"), BLANK).when(F.col("copy") > 1, DUPLICATE).when(F.col("cut"), CUT).otherwise(0)
    code = F.when(F.col("dropped"), DROPPED).otherwise(F.col("initial") + 4 * fault).cast("short")
    rows = rows.select("conv_id", "turn", "role", "tie", "copy", code.alias("code"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "tie", "copy"]
    return rows.sortWithinPartitions(*order).select("conv_id", "turn", "code")


AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Open:
    """The conversation being read: its codes and the places of its turns."""

    def __init__(self, conv: int | None):
        self.conv, self.codes, self.first, self.last, self.distinct = conv, [], None, None, 0

    def add(self, codes: np.ndarray, turns: np.ndarray) -> None:
        """``turns``: without nulls, ascending."""
        self.codes.append(codes)
        if len(turns):
            self.first = int(turns[0]) if self.first is None else self.first
            self.distinct += int((turns[1:] != turns[:-1]).sum()) + (self.last is None or int(turns[0]) != self.last)
            self.last = int(turns[-1])

    def facts(self) -> tuple[int | None, int, np.ndarray]:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return self.conv, gaps, np.concatenate(self.codes)


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a conversation, from rows that ``_coded`` put in order."""

    def told(done: list[tuple[int | None, int, np.ndarray]]) -> pa.RecordBatch:
        repaired = repair_codes([c for _, _, c in done])
        faults = [np.bincount(c >> 2, minlength=4) for _, _, c in done]
        roles = [c & 3 for _, _, c in done]
        # s u a and others are 0 to 3: of neighbours, su, ua and au are legal.
        illegal = [int((~np.isin(4 * r[:-1] + r[1:], (1, 6, 9))).sum()) for r in roles]
        columns = [[c for c, _, _ in done], [g for _, g, _ in done], *[[int(f[i]) for f in faults] for i in (BLANK, DUPLICATE, CUT)], illegal, [c for c, _ in repaired]]
        arrays = [pa.array(c, pa.int64()) for c in columns] + [pa.array([a for _, a in repaired], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    now, done, rows = None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, turns, codes = (batch.column(i) for i in range(3))
        none = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        no_turn = turns.is_null().to_numpy(zero_copy_only=False)
        turns, codes = turns.fill_null(0).to_numpy(), codes.to_numpy().astype(np.uint8)
        edges = np.flatnonzero((ids[1:] != ids[:-1]) | (none[1:] != none[:-1])) + 1
        for a, b in zip([0, *edges], [*edges, len(ids)]):
            conv = None if none[a] else int(ids[a])
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.facts())
                    rows += len(done[-1][2])
                    if rows >= TENSOR_ROWS:
                        yield told(done)
                        done, rows = [], 0
                now = _Open(conv)
            lives = codes[a:b] != DROPPED
            now.add(codes[a:b][lives], turns[a:b][lives & ~no_turn[a:b]])
    if now is not None:
        done.append(now.facts())
    if done:
        yield told(done)


class _Hash:
    """The digest of a repaired conversation, row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.any = audit, 0, START, hashlib.sha256(), False

    def _say(self, role: str, text: str) -> None:
        self.sha.update((f"\n{role}:{text}" if self.any else f"{role}:{text}").encode())
        self.any = True

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = int(WANTED[self.state])
            self._say(ROLES[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.state = int(WANTED[self.state])
            role = ROLES[self.state]
        elif edit == "K":
            self.state = int(KEPT[self.state, "sua".find(role[:1]) if role else 3])
        if edit != "D":
            self._say(role, text)

    def digest(self) -> str:
        self._inserted()
        return self.sha.hexdigest()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, ..., repaired_sha256) from rows in order, each conversation led by its audit."""
    names = [*[c.split()[0] for c in AUDITS.split(", ")], "repaired_sha256"]

    def told(done: list[list]) -> pa.RecordBatch:
        types = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

    now, facts, done = None, None, []
    for batch in batches:
        heads, roles, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("head", "role", "text"))
        for i in range(batch.num_rows):
            head = heads[i]
            if head.is_valid:
                if now is not None:
                    done.append([*facts, now.digest()])
                facts = list(head.as_py().values())
                now = _Hash(facts[-1])
            else:
                now.row(roles[i].as_py(), texts[i].as_py())
        if done:
            yield told(done)
            done = []
    if now is not None:
        yield told([[*facts, now.digest()]])


def repair(conversations: DataFrame) -> DataFrame:
    """A row per conv_id: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are first damaged (``damaged``). Null roles and texts are one space, so such a text is blank and such a role must be changed; rows
    of a null conv_id are one conversation; null turns come first and don't count for gaps. Rows of one turn
    go by role and then by the MD5 of their text, so equal rows stand together. Other columns take no part. An empty table gives no rows.
    A conversation's codes (one byte a row, and 32 for the costs while it is traced) are held by one task; its
    texts are streamed in order through one, as its digest needs them in order. Audits are
    written once to the shared folder."""
    scratch = Scratch(conversations.sparkSession)
    rows = damaged(conversations)
    audits = scratch.put(_coded(rows).mapInArrow(_audited, AUDITS), "audits")
    names = audits.columns
    heads = audits.select("conv_id", F.struct(*names).alias("head"), *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("tie", "binary"), ("text", "string"))])
    empty = F.lit(None).cast(heads.schema["head"].dataType)
    said = rows.where(~F.col("dropped")).select("conv_id", empty.alias("head"), "turn", "role", "tie", "text")
    order = [F.asc_nulls_first("conv_id"), F.col("head").isNull(), F.asc_nulls_first("turn"), "role", "tie"]
    streamed = heads.union(said).repartition("conv_id").sortWithinPartitions(*order).select("head", "role", "text")
    return streamed.mapInArrow(_hashed, f"{AUDITS}, repaired_sha256 string")
