"""Cheapest repair of damaged conversations.

A repaired conversation is empty, or an optional system row and one user-assistant pair or more. Four states tell how far a
prefix has come (nothing, system, user, assistant), and from each state an edit leads to one state only. So the edits of a
conversation are paths through nodes (row, state), and a cost pass from the end finds the arcs that lie on cheapest paths.

Among those paths the one whose string of edits is least is found by prefix doubling: nodes are ranked by the least audit of
1, 2, 4, ... edits from there on (the rank of twice the length is that of the pair of a node's rank and the rank of the node
its pointer leads to, and the pointers are doubled), until the longest audit is covered. The doubled pointers mark the
nodes of the least path, and start nodes of equal rank have equal audits, which are spelled out once.

Rows are dealt by ranges of (conversation, turn) and sorted; a task cuts the sorted rows into fragments of one conversation.
Those that lie within a task, nearly all, are solved there, many at once. The others (the first and last of a task, and what
is longer than ``FRAGMENT`` rows) are solved in parallel all the same: a fragment is summed up by sixteen costs, from each
state before it to each state after it, and only these sums of a conversation meet. Costs come back from the end, fragments
rank their paths, and states go forward from the start. The last step alone, a digest over the whole repaired text, which
has to be read in order, streams the fragments of a conversation through one task without holding them.

Defined cases: a null text or role is one space (a blank text; a role that can't be kept), and so is a null id or turn in
the key that decides the damage; null turns come first, a null id is a conversation of its own; rows equal in id and turn
are damaged alike and ordered by role and a hash of the text; repeated rows are duplicates. An empty role can't be kept.
Very long texts are ordinary; an empty table gives an empty result; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import if_small, materialise, small_batches

SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Rows of a conversation that one task looks at together.
FRAGMENT = 4096
#: Rows that a task solves at once, and characters of their texts.
TOGETHER = 16384
TEXTS = 1 << 22

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3
#: States: nothing yet, after a system row, after a user row, after an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 40
#: The state that a user or assistant row leads to, by the state before: a pair is never left open twice.
TURN = np.array([USER, USER, ASSISTANT, USER])
#: By initial (s, u, a, other) and state before: the state after, or -1.
KEPT = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1, -1, -1, -1]])
#: Letters in the order of their codes: nothing, delete, insert, keep, rerole.
LETTERS = " DIKR"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, dropped`` of ``conversations`` rows after damage; dropped rows keep their place."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(or_space("text"), ENDS, "")).otherwise(or_space("text"))
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(or_space("role")).alias("role"), text.alias("text"), (kind == 0).alias("dropped"), kind.alias("kind"))
    return out.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def _coded(damaged: DataFrame) -> DataFrame:
    """The damaged rows with the number of their role's initial and the fault that each has by itself."""
    text, seen = F.col("text"), F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    initial = F.when(F.col("role") == "", 3).otherwise((initial + 3) % 4)
    fault = F.when(F.length(F.btrim(text, F.lit(SPACE))) == 0, BLANK).when(~F.substring(seen, -1, 1).isin(*ENDS), TRUNCATED).otherwise(0)
    return damaged.select(
        "conv_id", "turn", "role", F.when(F.col("dropped"), "").otherwise(text).alias("text"), F.when(F.col("dropped"), -1).otherwise(initial).cast("int").alias("initial"),
        fault.cast("int").alias("fault"), F.xxhash64("role", "text").alias("same"), F.xxhash64(F.lit(1), "text", "role").alias("same_too"),
    )


# ---- paths, many conversations at once ----


class Paths:
    """Costs and least audits of several runs of rows. ``sizes`` are their lengths; ``ends`` the costs from each state after
    the last row on (by default only a whole number of pairs may end there)."""

    def __init__(self, initial: np.ndarray, fault: np.ndarray, sizes: np.ndarray, ends: np.ndarray | None = None) -> None:
        if ends is None:
            ends = np.tile(np.array([0, FAR, FAR, 0]), (len(sizes), 1))
        self.sizes, n = sizes, len(sizes)
        #: Where each run's nodes start: a row of four for each of its rows, and one after the last.
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.rows = np.cumsum(sizes) - sizes
        total = int(sizes.sum()) + n
        self.cost, arcs = np.full((total, 4), FAR), np.zeros((total, 4), np.int64)
        head = np.tile(np.arange(total)[:, None] * 4 + np.arange(4), 1)
        last = self.starts + sizes
        order = np.argsort(-sizes, kind="stable")
        self._inserts(last, np.minimum(ends, FAR), np.zeros((n, 4), np.int64), head[last], arcs, head)
        longest_first = sizes[order]
        for back in range(1, int(sizes.max(initial=0)) + 1):
            runs = order[: np.searchsorted(-longest_first, -back, side="right")]
            at = last[runs] - back
            row = self.rows[runs] + sizes[runs] - back
            after = self.cost[at + 1]
            must_go = (fault[row] == BLANK) | (fault[row] == DUPLICATE)
            short = np.where(fault[row] == TRUNCATED, CUT_SHORT, 0)[:, None]
            kept = KEPT[initial[row]]
            keep = np.where((kept < 0) | must_go[:, None], FAR, KEEP + short + np.take_along_axis(after, np.maximum(kept, 0), 1))
            rerole = np.where(must_go[:, None], FAR, REROLE + short + after[:, TURN])
            choices = np.stack([DELETE + after, keep, rerole])
            best = choices.min(0)
            which = choices.argmin(0)  # of equals the first: delete, keep, rerole
            heads = (at[:, None] + 1) * 4 + np.where(which == 0, np.arange(4), np.where(which == 1, np.maximum(kept, 0), TURN))
            self._inserts(at, best, np.array([1, 3, 4])[which], heads, arcs, head)
        self._rank(arcs.ravel(), head.ravel())

    def _inserts(self, at: np.ndarray, best: np.ndarray, letter: np.ndarray, heads: np.ndarray, arcs: np.ndarray, head: np.ndarray) -> None:
        """Settle the nodes of rows ``at``, whose cheapest edit but for insertions is given."""
        cost = best.copy()
        for state in (USER, ASSISTANT):
            cost[:, state] = np.minimum(best[:, state], INSERT + best[:, TURN[state]])
        for state in (NOTHING, SYSTEM):
            cost[:, state] = np.minimum(best[:, state], INSERT + cost[:, USER])
        inserted = INSERT + cost[:, TURN]
        # An insertion is less than keeping and reroling, and more than deleting.
        insert = (inserted == cost) & ((best > cost) | (letter > 2)) & (cost < FAR)
        self.cost[at] = np.minimum(cost, FAR)
        arcs[at] = np.where(insert, 2, letter)
        head[at] = np.where(insert, at[:, None] * 4 + TURN, heads)

    def _rank(self, arcs: np.ndarray, head: np.ndarray) -> None:
        """Rank the nodes by their least audits of 1, 2, 4, ... edits; keep the pointers of each length."""
        end = arcs == 0
        self.letters, rank, pointer = arcs, arcs.copy(), np.where(end, np.arange(len(arcs)), head)
        self.pointers = []
        while True:
            self.pointers.append(pointer)
            if end[pointer].all():
                break
            rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + rank[pointer], return_inverse=True)[1]
            pointer = pointer[pointer]
        self.ranks = rank

    def audits(self, nodes: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The least audit from each of the nodes to the end of its run, and the state there."""
        out: dict[int, str] = {}
        ranks = self.ranks[nodes]
        __, first, which = np.unique(ranks, return_index=True, return_inverse=True)
        path, start, place = nodes[first], np.arange(len(first)), np.zeros(len(first), np.int64)
        for k, pointer in enumerate(self.pointers):
            path, start, place = np.concatenate([path, pointer[path]]), np.tile(start, 2), np.concatenate([place, place + (1 << k)])
            on = self.letters[path] > 0
            path, start, place = path[on], start[on], place[on]
        order = np.lexsort((place, start))
        letters = np.frombuffer(LETTERS.encode(), np.uint8)[self.letters[path[order]]].tobytes().decode()
        ends = np.cumsum(np.bincount(start, minlength=len(first)))
        out = [letters[s:e] for s, e in zip([0, *ends[:-1]], ends)]
        return [out[w] for w in which], self.pointers[-1][nodes] % 4


def transfer(initial: np.ndarray, fault: np.ndarray) -> np.ndarray:
    """The least costs of a run, from each state before it (rows) to each state after it (columns)."""
    ends = np.where(np.eye(4, dtype=bool), 0, FAR)
    paths = Paths(np.tile(initial, 4), np.tile(fault, 4), np.full(4, len(initial)), ends)
    return paths.cost[paths.starts].T


def repaired(audit: str, roles: list[str], texts: list[str], state: int = NOTHING) -> Iterator[str]:
    """The lines of a repaired conversation, or of a fragment that is entered in ``state``."""
    row = 0
    for letter in audit:
        if letter == "D":
            row += 1
            continue
        if letter == "K":
            state = int(KEPT[_INITIALS.get(roles[row][:1], 3)][state])
            yield f"{roles[row]}:{texts[row]}"
        else:
            state = int(TURN[state])
            yield f"{'user' if state == USER else 'assistant'}:{texts[row] if letter == 'R' else ''}"
        row += letter != "I"


_INITIALS = {"s": 0, "u": 1, "a": 2}
_LEGAL = np.array([[0, 1, 0, 0], [0, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 0]], bool)

_OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RUN = "part int, no int, open boolean, low long, high long, turns long, first int, last int, roles array<string>, texts array<string>, initial binary, fault binary, same array<long>, same_too array<long>"


def _fragments(fragment: int, together: int, schema: pa.Schema):
    """Sorted rows in, a row for each fragment out: solved if it is a whole conversation for certain."""
    columns = ("turn", "role", "text", "initial", "fault", "same", "same_too")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, no, first = TaskContext.get().partitionId(), None, 0, True
        held: list[tuple] = []
        runs: list[tuple] = []
        chars = rows = 0

        def close(is_open: bool) -> None:
            nonlocal no, held
            runs.append((now[0], no, is_open or no > 0, dict(zip(columns, map(list, zip(*held))))))
            no, held = no + 1, []

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist(_solve(runs, part), schema=schema)
            runs.clear()
            return out

        for batch in batches:
            for conv_id, *row in zip(*[batch.column(i).to_pylist() for i in range(len(columns) + 1)]):
                if now is not None and conv_id != now[0]:
                    close(first)
                    first = False
                elif len(held) >= fragment or chars > TEXTS and held:
                    close(True)
                if now is None or conv_id != now[0]:
                    now, no = (conv_id,), 0
                if rows >= together or chars > TEXTS:
                    yield emit()
                    chars = rows = 0
                held.append(tuple(row))
                chars, rows = chars + len(row[2]), rows + 1
        if now is not None:
            close(True)
        yield emit()

    return run


def _solve(runs: list[tuple], part: int) -> list[dict]:
    out, closed = [], []
    for conv_id, no, is_open, held in runs:
        stays = np.array(held["initial"], np.int64) >= 0
        rows = {c: [x for x, s in zip(v, stays) if s] for c, v in held.items()}
        seen: set[tuple] = set()
        for i, key in enumerate(zip(rows["role"], rows["text"])):
            if key in seen and rows["fault"][i] != BLANK:
                rows["fault"][i] = DUPLICATE
            seen.add(key)
        turns = [t for t in rows["turn"] if t is not None]
        row = {"conv_id": conv_id, "part": part, "no": no, "open": is_open, "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns))}
        out.append(row)
        initial = np.array(rows["initial"], np.int64)
        if is_open:
            row |= {"first": rows["initial"][0] if len(initial) else None, "last": rows["initial"][-1] if len(initial) else None, "roles": rows["role"], "texts": rows["text"], "same": rows["same"], "same_too": rows["same_too"]}
            row |= {"initial": initial.astype(np.uint8).tobytes(), "fault": np.array(rows["fault"], np.uint8).tobytes()}
        else:
            closed.append((row, rows, initial))
        row |= _counts(np.array(rows["fault"], np.int64), initial)
        row["gaps"] = row["high"] - row["low"] + 1 - row["turns"] if turns else 0
    if closed:
        sizes = np.array([len(i) for *_, i in closed])
        paths = Paths(np.concatenate([i for *_, i in closed]), np.concatenate([np.array(r["fault"], np.int64) for _, r, _ in closed]), sizes)
        audits, _ = paths.audits(paths.starts * 4)
        for (row, rows, _), audit, cost in zip(closed, audits, paths.cost[paths.starts, NOTHING].tolist()):
            text = "\n".join(repaired(audit, rows["role"], rows["text"]))
            row |= {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}
    return out


def _counts(fault: np.ndarray, initial: np.ndarray) -> dict[str, int]:
    n = np.bincount(fault, minlength=4).tolist()
    return {"blank": n[BLANK], "duplicate": n[DUPLICATE], "truncated": n[TRUNCATED], "illegal": int((~_LEGAL[initial[:-1], initial[1:]]).sum())}


# ---- conversations of several fragments ----


def _later_copies(runs: DataFrame) -> DataFrame:
    """``conv_id, part, no, later``: places of rows that an earlier fragment of the conversation holds as well."""
    rows = runs.select("conv_id", "part", "no", F.posexplode(F.arrays_zip("same", "same_too"))).select("conv_id", "part", "no", "pos", "col.same", "col.same_too")
    firsts = rows.groupBy("conv_id", "same", "same_too").agg(F.min(F.struct("part", "no")).alias("origin"), F.max(F.struct("part", "no")).alias("final"))
    firsts = firsts.filter(F.col("origin") < F.col("final")).drop("final")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.same") == F.col("b.same")) & (F.col("a.same_too") == F.col("b.same_too"))
    hit = rows.alias("a").join(if_small(firsts, 48).alias("b"), same).filter(F.struct("a.part", "a.no") > F.col("origin"))
    return hit.groupBy("a.conv_id", "a.part", "a.no").agg(F.array_agg("a.pos").alias("later"))


def _on_fragment(a: str, b: str) -> Column:
    return F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.part") == F.col(f"{b}.part")) & (F.col(f"{a}.no") == F.col(f"{b}.no"))


def _sums(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                fault, initial = (np.frombuffer(row[c], np.uint8).astype(np.int64) for c in ("fault", "initial"))
                later = np.array(row.pop("later") or [], np.int64)
                fault[later[fault[later] != BLANK]] = DUPLICATE
                out.append(row | _counts(fault, initial) | {"fault": fault.astype(np.uint8).tobytes(), "costs": transfer(initial, fault).ravel().tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _back(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of a conversation's fragments, in order: the costs after each of them."""
    pdf = pdf.sort_values(["part", "no"])
    ends, out = np.array([0, FAR, FAR, 0]), []
    for costs in reversed(pdf["costs"].tolist()):
        out.append(ends.tolist())
        ends = np.minimum((np.array(costs).reshape(4, 4) + ends).min(1), FAR)
    return pdf[["conv_id", "part", "no"]].assign(ends=out[::-1], cost=int(ends[NOTHING]))


def _choices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The least audit of a fragment from each state, and the state that it leads to."""
    for pdf in batches:
        found = []
        for fault, initial, ends in zip(pdf["fault"], pdf["initial"], pdf["ends"]):
            initial = np.frombuffer(initial, np.uint8).astype(np.int64)
            paths = Paths(initial, np.frombuffer(fault, np.uint8).astype(np.int64), np.array([len(initial)]), np.array([list(ends)]))
            audits, states = paths.audits(np.arange(4))
            found.append((audits, states.tolist()))
        yield pdf[["conv_id", "part", "no"]].assign(audits=[a for a, _ in found], leads=[s for _, s in found])


def _ahead(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state in which each fragment of a conversation is entered."""
    pdf, state, out = pdf.sort_values(["part", "no"]), NOTHING, []
    for leads in pdf["leads"]:
        out.append(state)
        state = int(leads[state])
    return pdf[["conv_id", "part", "no"]].assign(state=out)


def _digests(schema: pa.Schema):
    """Lines of fragments, sorted, in; one row for each conversation out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, empty, audit = None, None, True, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"conv_id": now[0], "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema=schema)

        for batch in batches:
            for conv_id, lines, edits in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "lines", "edits")]):
                if now is None or now[0] != conv_id:
                    if now is not None:
                        yield row()
                    now, digest, empty, audit = (conv_id,), hashlib.sha256(), True, []
                audit.append(edits)
                if lines is not None:
                    digest.update(("" if empty else "\n").encode() + lines.encode())
                    empty = False
        if now is not None:
            yield row()

    return run


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = []
        for audits, state, roles, texts in zip(pdf["audits"], pdf["state"], pdf["roles"], pdf["texts"]):
            lines = list(repaired(audits[state], roles, texts, state))
            found.append((audits[state], "\n".join(lines) if lines else None))
        yield pdf[["conv_id", "part", "no"]].assign(edits=[a for a, _ in found], lines=[x for _, x in found])


def _joined(runs: DataFrame, kind: str) -> DataFrame:
    """Results for conversations that lie in several fragments."""
    key = f"conv_id {kind}, part int, no int"
    cut = runs.alias("a").join(_later_copies(runs).alias("b"), _on_fragment("a", "b"), "left").select("a.*", "b.later")
    sums = cut.select("conv_id", "part", "no", "low", "high", "turns", "first", "last", "initial", "fault", "later")
    ddl = f"{key}, low long, high long, turns long, first int, last int, initial binary, fault binary, costs array<long>, blank long, duplicate long, truncated long, illegal long"
    sums = small_batches(sums).mapInArrow(_sums(_arrow(ddl)), ddl)
    sums = materialise(sums, "fragment-sums")
    order = Window.partitionBy("conv_id").orderBy("part", "no")
    # Fragments without rows are passed over: the last one that has rows stands before.
    before = lambda c: F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    pair = F.array(*[F.lit(bool(x)) for x in _LEGAL.ravel()])
    counted = sums.select("conv_id", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "first", before("high").alias("high_before"), before("last").alias("last_before"))
    meet = F.when(F.col("first").isNull() | F.col("last_before").isNull(), 0).when(F.get(pair, F.col("last_before") * 4 + F.col("first")), 0).otherwise(1)
    turns = F.sum(F.col("turns") - F.when(F.col("low") == F.col("high_before"), 1).otherwise(0))
    counted = counted.groupBy("conv_id").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - turns, F.lit(0)).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], (F.sum("illegal") + F.sum(meet)).alias("illegal")
    )
    ends = sums.select("conv_id", "part", "no", "costs").groupBy("conv_id").applyInPandas(_back, f"{key}, ends array<long>, cost long")
    ends = materialise(ends, "fragment-ends")
    chosen = sums.alias("a").join(ends.alias("b"), _on_fragment("a", "b")).select("a.conv_id", "a.part", "a.no", "a.initial", "a.fault", "b.ends")
    chosen = materialise(chosen.mapInPandas(_choices, f"{key}, audits array<string>, leads array<int>"), "fragment-choices")
    states = chosen.select("conv_id", "part", "no", "leads").groupBy("conv_id").applyInPandas(_ahead, f"{key}, state int")
    placed = chosen.alias("a").join(states.alias("b"), _on_fragment("a", "b")).select("a.conv_id", "a.part", "a.no", "a.audits", "b.state")
    lines = runs.alias("a").join(placed.alias("b"), _on_fragment("a", "b")).select("a.conv_id", "a.part", "a.no", "a.roles", "a.texts", "b.audits", "b.state")
    lines = lines.mapInPandas(_lines, f"{key}, edits string, lines string")
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    ddl = f"conv_id {kind}, audit string, repaired_sha256 string"
    digests = lines.mapInArrow(_digests(_arrow(ddl)), ddl)
    costs = ends.select("conv_id", "cost").groupBy("conv_id").agg(F.first("cost").alias("cost"))
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    return counted.alias("a").join(costs.alias("b"), same("a", "b")).join(digests.alias("c"), same("a", "c")).select("a.*", "b.cost", "c.audit", "c.repaired_sha256")


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def repair(damaged: DataFrame, fragment: int = FRAGMENT, together: int = TOGETHER) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of each conversation in
    ``conv_id, turn, role, text, dropped``."""
    rows = _coded(damaged)
    kind = rows.schema["conv_id"].dataType.simpleString()
    dealt = rows.withColumn("salt", F.monotonically_increasing_id() % 1024)
    dealt = dealt.repartitionByRange("conv_id", "turn", "role", "same", "salt").sortWithinPartitions("conv_id", "turn", "role", "same").drop("salt")
    dealt = dealt.select("conv_id", "turn", "role", "text", "initial", "fault", "same", "same_too")
    ddl = f"conv_id {kind}, {_RUN}, {_OUT}"
    runs = materialise(small_batches(dealt).mapInArrow(_fragments(fragment, together, _arrow(ddl)), ddl), "conversation-runs")
    names = ["conv_id", *[c.split()[0] for c in _OUT.split(", ")]]
    whole = runs.filter(~F.col("open")).select(names)
    return whole.unionByName(_joined(runs.filter("open"), kind).select(names))
