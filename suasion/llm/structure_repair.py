"""Operator 13 — repair of conversation structure by a persistent audit DP.

A conversation's rows, in the order of their turns, are turned into one whose roles spell
``(s?(ua)+)?`` by the cheapest edits (COSTS): Keep, Rerole, Delete, Insert; blank rows and
repeats of an earlier row must go, truncated rows that stay cost 1.  The audit is the string
of the edits' initials; of equally cheap audits the ASCII-least counts.

The DP walks over the rows with four states (nothing yet, after system, after user, after
assistant).  A state's audit is a node of a tree: an edit, its parent, a rolling hash of the
whole string, and its ancestors 1, 2, 4, … edits back, so all states share their prefixes and
a step makes a handful of nodes.  A tie is settled by the longest common prefix: both nodes
climb, highest power of two first, while their ancestors' hashes differ.  An audit string
determines row and state, so equal prefixes are one node; equal hashes of two nodes are a
collision, and then the strings themselves are compared.  Once all states that can still be
part of a cheapest repair go back to one node, everything before it is decided: it is
emitted and the tree starts anew there, so a task holds the undecided end of one
conversation, however long that is.

``repaired_rows`` gives the rows, ``audits`` one row per conversation.  Rows are shuffled by
conversation and read in order; which rows repeat an earlier one is found by an aggregate
and a join before.

Cases: null roles and texts count as one space; rows of one turn go by role, then text, null
turns first; null conversations are one conversation; rows with ``present`` false only name
their conversation (no rows: zeros, an empty audit, the hash of the empty string); an empty
table gives no rows; other columns are not read; very long texts are held only while their
row is undecided.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suasion.llm.shared import written

COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED_COST = 1
BLANKS = " \t\n\x0b\x0c\r"
MODULUS, BASE = (1 << 61) - 1, 1_000_003
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: state → (initial of the role that may follow → next state); a role put in follows the same way
NEXT = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
GIVEN = {NOTHING: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
LEGAL = {"su", "ua", "au"}
DECIDE_EVERY = 256


class Node:
    """An audit string: its last edit behind the parent's string."""
    __slots__ = ("edit", "depth", "hash", "up")

    def __init__(self, parent: Node | None, edit: str):
        self.edit = edit
        if parent is None:
            self.depth, self.hash, self.up = 0, 0, ()
            return
        self.depth, self.hash = parent.depth + 1, (parent.hash * BASE + ord(edit)) % MODULUS
        up, k = [parent], 0
        while k < len(up[k].up):  # the 2**k-th ancestor's own 2**k-th ancestor
            up.append(up[k].up[k])
            k += 1
        self.up = tuple(up)

    def ancestor(self, depth: int) -> Node:
        node = self
        while node.depth > depth:
            node = node.up[(node.depth - depth).bit_length() - 1]
        return node

    def text(self, below: int = 0) -> str:
        """The edits after the first ``below``."""
        out, node = [], self
        while node.depth > below:
            out.append(node.edit)
            node = node.up[0]
        return "".join(reversed(out))


def split(a: Node, b: Node) -> tuple[Node, Node]:
    """The first nodes in which two strings of one length differ (both the same where they don't)."""
    if a.hash == b.hash:
        return (a, a) if a is b else _split_by_edits(a, b)
    for k in range(len(a.up) - 1, -1, -1):
        if k < len(a.up) and a.up[k].hash != b.up[k].hash:
            a, b = a.up[k], b.up[k]
    x, y = _split_by_edits(a.up[0], b.up[0])  # at once where the parents are one node
    return (a, b) if x is y else (x, y)


def _split_by_edits(a: Node, b: Node) -> tuple[Node, Node]:
    """The same without hashes, for nodes whose hashes are equal: they are one node, or the hashes collided."""
    first = (a, a)
    while a is not b:
        if a.edit != b.edit:
            first = (a, b)
        a, b = a.up[0], b.up[0]
    return first


def less(a: Node, last_a: str, b: Node, last_b: str) -> bool:
    """Whether the string of ``a`` and then ``last_a`` comes before that of ``b`` and ``last_b``."""
    depth = min(a.depth, b.depth)
    x, y = split(a.ancestor(depth), b.ancestor(depth))
    if x is not y and x.edit != y.edit:
        return x.edit < y.edit
    next_a = last_a if a.depth == depth else a.ancestor(depth + 1).edit
    next_b = last_b if b.depth == depth else b.ancestor(depth + 1).edit
    return next_a < next_b if next_a != next_b else a.depth < b.depth


def _before(a: Node, b: Node) -> bool:
    return less(a, "", b, "")


Cell = tuple[int, Node] | None


class Repair:
    """One conversation, row by row; ``emit(edit, role, text)`` gets the decided edits in order."""

    def __init__(self, emit: Callable[[str, str, str], None]):
        self.emit, self.state, self.waiting, self.decide_at = emit, NOTHING, deque(), DECIDE_EVERY
        self.cells: list[Cell] = self._inserted([(0, Node(None, "")), None, None, None])

    def add(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        self.waiting.append((role, text))
        better: dict[int, tuple[int, Node, str]] = {}

        def offer(state: int, cost: int, node: Node, edit: str) -> None:
            held = better.get(state)
            if held is None or cost < held[0] or cost == held[0] and less(node, edit, held[1], held[2]):
                better[state] = cost, node, edit
        for state, cell in enumerate(self.cells):
            if cell is None:
                continue
            cost, node = cell
            offer(state, cost + COSTS["D"], node, "D")
            if not must_go:
                kept = NEXT[state].get(role[:1])
                if kept is not None:
                    offer(kept, cost + COSTS["K"] + TRUNCATED_COST * truncated, node, "K")
                offer(GIVEN[state][1], cost + COSTS["R"] + TRUNCATED_COST * truncated, node, "R")
        self.cells = self._inserted([(better[s][0], Node(better[s][1], better[s][2])) if s in better else None for s in range(4)])
        if len(self.waiting) >= self.decide_at:
            self._decide()
            self.decide_at = max(DECIDE_EVERY, 2 * len(self.waiting))

    def _inserted(self, cells: list[Cell]) -> list[Cell]:
        """With inserts behind: two more come back to the same state, so each state has one or two at most."""
        nothing, system, user, assistant = cells
        user = self._least(self._least(user, nothing), system)
        return [nothing, system, self._least(user, assistant), self._least(assistant, user)]

    @staticmethod
    def _least(cell: Cell, source: Cell) -> Cell:
        """The cheaper of a cell and an insert behind ``source``."""
        if source is None:
            return cell
        cost, node = source[0] + COSTS["I"], source[1]
        if cell is None or cost < cell[0] or cost == cell[0] and _before(Node(node, "I"), cell[1]):
            return cost, Node(node, "I")
        return cell

    def _living(self) -> list[Node]:
        """Nodes of the states that may be part of a cheapest repair.  From `after assistant` everything is
        possible that is from `nothing yet` or `after system`, for 3 more at most (a system row goes);
        from `after user` for 2 more."""
        nothing, system, user, assistant = self.cells
        slack = ((nothing, COSTS["D"]), (system, 0), (user, COSTS["I"]), (assistant, 0))
        return [cell[1] for cell, more in slack if cell and cell[0] <= assistant[0] + more]

    def _decide(self) -> None:
        living = self._living()
        self.cells = [c if c and any(c[1] is n for n in living) else None for c in self.cells]
        top = min(living, key=lambda n: n.depth)
        for node in living:
            other = node.ancestor(min(top.depth, node.depth))
            top = top.ancestor(other.depth)
            x, y = split(top, other)
            if x is not y:
                top = x.up[0]
        if not top.depth:
            return
        self._emit(top.text())
        fresh: dict[int, Node] = {id(top): Node(None, "")}

        def copied(node: Node) -> Node:
            chain = []
            while id(node) not in fresh:
                chain.append(node)
                node = node.up[0]
            new = fresh[id(node)]
            for old in reversed(chain):
                new = fresh[id(old)] = Node(new, old.edit)
            return new
        self.cells = [(c[0], copied(c[1])) if c else None for c in self.cells]

    def _emit(self, edits: str) -> None:
        for edit in edits:
            role, text = ("", "") if edit == "I" else self.waiting.popleft()
            if edit in "RI":
                role, self.state = GIVEN[self.state]
            elif edit == "K":
                self.state = NEXT[self.state][role[:1]]
            self.emit(edit, role, text)

    def end(self) -> int:
        """The cost; everything is emitted."""
        nothing, _, _, assistant = self.cells
        best = assistant
        if nothing and (nothing[0] < assistant[0] or nothing[0] == assistant[0] and _before(nothing[1], assistant[1])):
            best = nothing
        self._emit(best[1].text())
        return best[0]


class _Audit:
    """Faults, counts and the repair of one conversation."""

    def __init__(self, conv, emit: Callable[[str, str, str], None]):
        self.conv, self.edits = conv, []
        self.repair = Repair(lambda *edit: (self.edits.append(edit[0]), emit(*edit)))
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.before = None

    def add(self, turn, role: str, text: str, first) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        repeated = first is not None and first != (turn is not None, turn) or self.before == (turn, role, text)
        if self.before is not None:
            self.illegal += self.before[1][:1] + role[:1] not in LEGAL
        self.before = turn, role, text
        written_out = text.strip(BLANKS)
        blank, repeated = not written_out, bool(written_out) and repeated
        cut = not blank and not repeated and written_out[-1] not in ".!?"
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + repeated, self.truncated + cut
        self.repair.add(role, text, blank or repeated, cut)

    def row(self) -> tuple:
        cost = self.repair.end()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.edits)


AUDITS = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")
REPAIRED = "conv_id long, place long, edit string, role string, text string"
_KIND = {"long": pa.int64(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KIND[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)],
                                      [n for n, _ in fields])


def _in_order(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present, first): conversations whole and in order; ``first`` is the turn
    of a repeated row's first occurrence."""
    twins = rows.where("present").groupBy("conv_id", "role", "h1", "h2").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    twins = written(twins.select(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "h1", "h2")], "first"), "repeated-rows")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("conv_id", "role", "h1", "h2")]
    found = rows.join(twins, (same[0] & same[1]) & (same[2] & same[3]), "left")
    return (found.select("conv_id", "turn", "role", "text", "present", "first").repartition("conv_id")
            .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text"))


def _prepared(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: Column | None) -> DataFrame:
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in (text_col, role_col))
    chosen = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"),
                         text.alias("text"), (F.lit(True) if present is None else present).alias("present"))
    return chosen.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})


def _conversations(batches: Iterator[pa.RecordBatch], start: Callable, end: Callable) -> Iterator:
    """Calls ``start(conv)`` for the machine of each conversation and ``end(machine)`` behind its rows; yields
    after each batch and at the end."""
    now = None
    for batch in batches:
        columns = [c.to_pylist() for c in (*batch.columns[:3], *batch.columns[4:])]
        texts = batch.column(3)
        for i, (conv, turn, role, present, first) in enumerate(zip(*columns, strict=True)):
            if now is None or now.conv != conv:
                if now:
                    end(now)
                now = start(conv)
            if present:
                now.add(turn, role, texts[i].as_py(), first and (first["known"], first["turn"]))
        yield
    if now:
        end(now)
        yield


def audits(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           present: Column | None = None) -> DataFrame:
    """AUDITS, one row per conversation; ``repaired_sha256`` digests the repaired ``role:text`` lines."""
    def run(batches):
        out = []

        def start(conv):
            digest, count = hashlib.sha256(), [0]

            def emit(edit, role, text):
                if edit != "D":
                    digest.update(f"{chr(10) if count[0] else ''}{role}:{text}".encode())
                    count[0] += 1
            machine = _Audit(conv, emit)
            machine.digest = digest
            return machine

        for _ in _conversations(batches, start, lambda m: out.append((*m.row(), m.digest.hexdigest()))):
            if out:
                yield _batch(out, AUDITS)
                out.clear()
    return _in_order(_prepared(rows, conv_col, turn_col, role_col, text_col, present)).mapInArrow(run, AUDITS)


def repaired_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                  present: Column | None = None) -> DataFrame:
    """REPAIRED: the rows of every repaired conversation in order of ``place``, each with the edit that made it."""
    def run(batches):
        out = []

        def start(conv):
            place = iter(range(1 << 62))
            return _Audit(conv, lambda edit, role, text: edit == "D" or out.append((conv, next(place), edit, role, text)))
        for _ in _conversations(batches, start, lambda m: m.row()):
            if out:
                yield _batch(out, REPAIRED)
                out.clear()
    return _in_order(_prepared(rows, conv_col, turn_col, role_col, text_col, present)).mapInArrow(run, REPAIRED)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): rows damaged by ``crc32(conv_id:turn) % 20`` (nulls: one space);
    0 drops a row (``present`` false), 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes
    the user say it."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    code = F.crc32(key) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    coded = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), code.alias("code"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    text = (F.when(F.col("code").isin(0, 1), F.lit("")).when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    role = F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role"))
    changed = coded.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("code") != 0).alias("present"), "code")
    return changed.withColumn("copy", copies).drop("code", "copy")
