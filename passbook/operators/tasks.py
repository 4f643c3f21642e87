"""What a settlement task does with the Arrow batches of its partition."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.sql import types as T

# Tasks carry this module's code with them, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# State of one side of a transfer.
NO_SIDE, OPEN_SIDE, SELF_SIDE, UNKNOWN_SIDE, CLOSED_SIDE, FROZEN_SIDE = range(6)
# Part of an account that is folded whole.
WHOLE = -1
# Legs of a position in fold order. An opening row holds the bounds of a part's first
# balance as money and gap; certain money moves for sure, a deposit if its transfer passes.
OPENING_LEG, CERTAIN_LEG, WITHDRAW_LEG, DEPOSIT_LEG = range(-1, 3)
# What a round says of a withdrawal.
UNDECIDED, ACCEPTED, REJECTED = range(3)
# Rows of a round: a withdrawal, or the end of an account's part.
WITHDRAWAL_ROW, PART_ROW = range(2)

LOWEST, HIGHEST = -(2**63), 2**63 - 1
# Sums of amounts beyond this are made with Python's numbers, which do not wrap.
WIDE = 2.0**61
# With fewer groups than this, the rest of a batch is scanned group by group.
FEW = 24


def within(balance: int) -> int:
    if not LOWEST <= balance <= HIGHEST:
        raise OverflowError("a balance does not fit 64 bits")
    return balance


def bounds_of_legs(leg, money, gap, moves, starts, ends, low, high, pending):
    """Verdict and new gap of each leg; bounds and pending money of each group after them.

    ``low`` and ``high`` bound the balance of a group before its first leg, ``pending`` is
    the certain money since its last undecided withdrawal. A withdrawal that the lower bound
    covers is accepted, one that the upper bound does not cover is rejected; what is left
    widens the bounds: accepted it leaves at least 0, rejected it leaves less than it asked.
    """
    n = len(leg)
    verdict, new_gap = np.zeros(n, np.int8), np.zeros(n, np.int64)
    low, high, pending = (x if isinstance(x, np.ndarray) else np.array(x, object) for x in (low, high, pending))
    first = starts.copy()
    size = ends - starts
    is_w = leg == WITHDRAW_LEG
    reach = np.abs(money.astype(float)) + np.abs(gap.astype(float))
    most = np.add.reduceat(reach, starts) + np.max([np.abs(x.astype(float)) for x in (low, high, pending)], axis=0)
    narrow = most < WIDE
    kind = np.int64 if narrow.all() else object  # wide groups end in Python's numbers
    low, high, pending = (x.astype(kind) for x in (low, high, pending))
    if narrow.any():
        # As long as the lower bound covers all withdrawals, all of them are accepted.
        sure = np.where(leg == CERTAIN_LEG, money, np.where(is_w, gap, 0))
        taken = np.where(is_w & moves, money, 0)
        paid = np.where(leg == DEPOSIT_LEG, money, 0)

        def path(steps: np.ndarray, at_start: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore"):  # wide groups are not read
                total = np.cumsum(steps)
                opens = np.where(narrow, at_start, 0).astype(np.int64)
                return total - np.repeat(total[starts] - steps[starts] - opens, size)

        lower = path(sure - taken + np.minimum(paid, 0), low)
        short = np.flatnonzero(is_w & (lower + taken < money))
        group = np.repeat(np.arange(len(starts)), size)
        stop = ends.copy()
        np.minimum.at(stop, group[short], short)
        stop = np.where(narrow, stop, starts)
        done = np.arange(n) < np.repeat(stop, size)
        verdict[done & is_w] = ACCEPTED
        upper = path(sure - taken + np.maximum(paid, 0), high)
        since = path(sure - taken, pending)
        some = np.flatnonzero(stop > starts)
        at = stop[some] - 1
        low[some], high[some], pending[some] = lower[at], upper[at], since[at]
        first = stop
    active = np.flatnonzero(narrow & (first < ends))
    if len(active) >= FEW:
        _scan_together(leg, money, gap, moves, first, ends, low, high, pending, active, verdict, new_gap)
    for g in np.flatnonzero(first < ends).tolist():
        part = slice(first[g], ends[g])
        a, b, c = int(low[g]), int(high[g]), int(pending[g])
        columns = (x[part].tolist() for x in (leg, money, gap, moves))
        for i, (kind, m, extra, moving) in enumerate(zip(*columns), start=int(first[g])):
            if kind == CERTAIN_LEG:
                a, b, c = a + m, b + m, c + m
            elif kind == DEPOSIT_LEG:
                a, b = (a + m, b) if m < 0 else (a, b + m)
            else:
                a, b, c = a + extra, b + extra, c + extra
                if a > HIGHEST or b < LOWEST:
                    within(a if a > HIGHEST else b)
                if a >= m:
                    verdict[i] = ACCEPTED
                    if moving:
                        a, b, c = a - m, b - m, c - m
                elif b < m:
                    verdict[i] = REJECTED
                else:
                    new_gap[i], c = within(c), 0
                    if moving:
                        a, b = min(a, 0), max(b - m, m - 1)
        low[g], high[g], pending[g] = a, b, c
    return verdict, new_gap, low, high, pending


def _scan_together(leg, money, gap, moves, first, ends, low, high, pending, active, verdict, new_gap) -> None:
    """The scan of many groups at once, a leg of each at a time, until few groups are left."""
    a, b, c = (x[active].astype(np.int64) for x in (low, high, pending))
    at = first[active].copy()
    live = np.arange(len(active))
    while len(live) >= FEW:
        i = at[live]
        kind, m, extra, moving = leg[i], money[i], gap[i], moves[i]
        w = kind == WITHDRAW_LEG
        sure = np.where(kind == CERTAIN_LEG, m, np.where(w, extra, 0))
        paid = np.where(kind == DEPOSIT_LEG, m, 0)
        la, lb, lc = a[live] + sure + np.minimum(paid, 0), b[live] + sure + np.maximum(paid, 0), c[live] + sure
        yes, no = w & (la >= m), w & (lb < m)
        open_ = w & ~yes & ~no
        verdict[i] = np.where(yes, ACCEPTED, np.where(no, REJECTED, UNDECIDED))
        new_gap[i] = np.where(open_, lc, 0)
        out = np.where(yes & moving, m, 0)
        spread = open_ & moving
        a[live] = np.where(spread, np.minimum(la, 0), la - out)
        b[live] = np.where(spread, np.maximum(lb - m, m - 1), lb - out)
        c[live] = np.where(open_, 0, lc - out)
        at[live] += 1
        live = live[at[live] < ends[active[live]]]
    low[active], high[active], pending[active] = a, b, c
    first[active] = at


def fold_partition(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Bound the balances along the legs of sorted (account, part) groups, batch by batch.

    Emits each withdrawal with its verdict and gap, and one row per part of an account that
    is folded in parts: the bounds after it, the money that is pending there, and the
    position of the first withdrawal that is still open in it.
    """
    held = None  # (account, part) left open by the batch before
    state = (0, 0, 0)
    waits = None  # position of the first open withdrawal of the open group

    def part_rows(account, part, low, high, pending, waiting: pa.Array) -> pa.RecordBatch:
        if low.dtype == object:
            low, high = (np.array([max(LOWEST, min(x, HIGHEST)) for x in y], np.int64) for y in (low, high))
            pending = np.array([within(x) for x in pending], np.int64)
        tag = np.full(len(part), PART_ROW, np.int32)
        names = ("tag", "account", "cell", "low", "high", "gap", "first_open")
        return _batch(dict(zip(names, (tag, account, part, low, high, pending, waiting))), len(part), schema)

    def held_row() -> pa.RecordBatch:
        bounds = (np.array([x], object) for x in state)
        return part_rows(np.array([held[0]]), np.array([held[1]], np.int64), *bounds, pa.array([waits], pa.int64()))

    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        account = batch.column(0).to_numpy(zero_copy_only=False)
        part = batch.column(1).to_numpy(zero_copy_only=False)
        leg = batch.column(3).to_numpy(zero_copy_only=False)
        money = batch.column(4).to_numpy(zero_copy_only=False)
        gap = batch.column(5).fill_null(0).to_numpy(zero_copy_only=False)
        dest = batch.column(7).fill_null(NO_SIDE).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate(([True], (account[1:] != account[:-1]) | (part[1:] != part[:-1]))))
        ends = np.append(starts[1:], n)
        resumed = held is not None and held == (account[0], part[0])
        if held is not None and not resumed and held[1] != WHOLE:
            yield held_row()
        fits = not resumed or all(LOWEST <= x <= HIGHEST for x in state)
        low, high, pending = (np.zeros(len(starts), np.int64 if fits else object) for _ in range(3))
        if resumed:
            low[0], high[0], pending[0] = state
        opens = np.flatnonzero(leg[starts] == OPENING_LEG)
        low[opens], high[opens] = money[starts[opens]], gap[starts[opens]]
        opening = leg == OPENING_LEG
        money, gap = np.where(opening, 0, money), np.where(opening, 0, gap)
        leg = np.where(opening, CERTAIN_LEG, leg)
        # A withdrawal that only tests the funds: self transfers and refunded ones.
        moves = ~((dest == SELF_SIDE) | (dest >= CLOSED_SIDE))
        verdict, new_gap, low, high, pending = bounds_of_legs(
            leg, money, gap, moves, starts, ends, low, high, pending
        )
        seq = batch.column(2)
        still = np.flatnonzero((leg == WITHDRAW_LEG) & (verdict == UNDECIDED))
        waiting = np.full(len(starts), -1)  # first open withdrawal of each group, -1 for none
        waiting[np.searchsorted(starts, still[::-1], side="right") - 1] = still[::-1]
        first_open = seq.take(pa.array(waiting, mask=waiting < 0))
        if resumed and waits is not None:
            first_open = pa.concat_arrays([pa.array([waits], pa.int64()), first_open[1:]])
        ended = np.flatnonzero(part[starts[:-1]] != WHOLE)
        if len(ended):
            yield part_rows(
                account[starts[ended]], part[starts[ended]], low[ended], high[ended], pending[ended],
                first_open.take(pa.array(ended)),
            )
        held = (account[starts[-1]], int(part[starts[-1]]))
        state, waits = (int(low[-1]), int(high[-1]), int(pending[-1])), first_open[-1].as_py()
        pick = np.flatnonzero(leg == WITHDRAW_LEG)
        if len(pick):
            taken = batch.take(pa.array(pick))
            yield _batch(
                {
                    "tag": np.full(len(pick), WITHDRAWAL_ROW, np.int32),
                    "account": taken.column(0),
                    "cell": taken.column(8),
                    "seq": taken.column(2),
                    "money": taken.column(4),
                    "gap": new_gap[pick],
                    "to_id": taken.column(6),
                    "dest": taken.column(7),
                    "verdict": verdict[pick].astype(np.int32),
                },
                len(pick),
                schema,
            )
    if held is not None and held[1] != WHOLE:
        yield held_row()


def _batch(columns: dict, n: int, schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for f in schema:
        value = columns.get(f.name)
        if value is None:
            arrays.append(pa.nulls(n, f.type))
        elif isinstance(value, pa.Array):
            arrays.append(value.cast(f.type))
        else:
            arrays.append(pa.array(value, type=f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def run_groups(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Verdicts of the withdrawals of sorted groups, one after the other.

    Columns: group, seq, leg, account, money, gap, then those of ``schema`` that are kept.
    Balances are held for the accounts of one group at a time.
    """
    group, balances = None, {}
    for batch in batches:
        verdicts = []
        rows = zip(*(batch.column(c).to_pylist() for c in ("group", "leg", "account", "money", "gap", "to_id", "dest")))
        for own, leg, account, money, gap, to_id, dest in rows:
            if own != group:
                group, balances = own, {}
            if leg == CERTAIN_LEG:
                balances[account] = balances.get(account, 0) + money
                verdicts.append(UNDECIDED)
                continue
            held = within(balances.get(account, 0) + gap)
            ok = held >= money
            if ok and dest != SELF_SIDE and dest < CLOSED_SIDE:
                held -= money
                if dest == OPEN_SIDE:
                    balances[to_id] = balances.get(to_id, 0) + money
            balances[account] = held
            verdicts.append(ACCEPTED if ok else REJECTED)
        out = batch.append_column("verdict", pa.array(verdicts, pa.int32()))
        yield out.filter(pyarrow.compute.equal(out["leg"], WITHDRAW_LEG)).select(schema.names).cast(schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    kinds = {
        "integer": pa.int32(),
        "long": pa.int64(),
        "string": pa.string(),
        "boolean": pa.bool_(),
    }
    return pa.schema([(f.name, kinds[f.dataType.typeName()]) for f in schema.fields])
