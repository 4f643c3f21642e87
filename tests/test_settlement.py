import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import serial
from passbook.operators import groups, settlement, tasks

TRANSFERS = "seq long, from_id string, to_id string, money long"
ACCOUNTS = "account_id string, status string"
FLAGS = ("status", "reason", "rollback", "withdrawn", "deposited", "refunded")


def settle(spark, transfers, accounts, opening=None, **options):
    start = None
    if opening is not None:
        start = spark.createDataFrame(list(opening.items()), "account_id string, balance long")
    return settlement.settle(
        spark.createDataFrame(transfers, TRANSFERS),
        spark.createDataFrame(list(accounts.items()), ACCOUNTS),
        start,
        **options,
    )


def check(spark, transfers, accounts, opening=None, **options):
    got = settle(spark, transfers, accounts, opening, **options)
    rows = {r["seq"]: tuple(r[f] for f in FLAGS) for r in got.collect()}
    want, balances = serial.run(transfers, accounts, opening)
    assert rows == want
    held = settlement.settled_balances(
        got,
        spark.createDataFrame(list(accounts.items()), ACCOUNTS),
        None
        if opening is None
        else spark.createDataFrame(list(opening.items()), "account_id string, balance long"),
    )
    assert {r["account_id"]: r["balance"] for r in held.collect()} == balances
    return rows


OPEN2 = {"a": "OPEN", "b": "OPEN"}


def test_deposit_then_withdraw(spark):
    rows = check(spark, [(1, None, "a", 100), (2, "a", None, 20)], {"a": "OPEN"})
    assert [r[0] for r in rows.values()] == ["SUCCEEDED", "SUCCEEDED"]


def test_transfer_between_accounts(spark):
    check(spark, [(1, None, "a", 100), (2, "a", "b", 20)], OPEN2)


def test_edges(spark):
    """Exact balance, one too much, unknown and frozen sides, self and empty transfers."""
    accounts = OPEN2 | {"f": "FROZEN", "c": "CLOSED"}
    transfers = [
        (1, None, "a", 100),
        (2, "a", None, 100),
        (3, None, "a", 50),
        (4, "a", "b", 51),
        (5, "a", "nobody", 10),
        (6, "nobody", "a", 10),
        (7, "a", "f", 40),
        (8, "a", "c", 41),
        (9, None, "f", 5),
        (10, "f", "a", 0),
        (11, None, None, 7),
        (12, "a", "a", 40),
        (13, "a", "a", 41),
        (14, None, "nobody", 9),
        (15, "a", None, 0),
        (16, "a", "b", 40),
        (17, "b", "a", 40),
    ]
    rows = check(spark, transfers, accounts)
    assert rows[2][0] == "SUCCEEDED"
    assert rows[4][1] == "From account: not enough funds"
    assert rows[5][0] == "PENDING" and rows[5][3]
    assert rows[7][2] and rows[7][5]
    assert rows[9][0] == "FAILED" and not rows[9][2]
    assert rows[11][0] == "SUCCEEDED"


def test_a_rejection_spreads_along_a_chain(spark):
    names = [f"n{i}" for i in range(8)]
    chain = [(i + 2, names[i], names[i + 1], 10) for i in range(7)]
    check(spark, [(1, None, "n0", 9), *chain], dict.fromkeys(names, "OPEN"))


def random_ledger(seed, n, names, hot=None, negative=False):
    rng = random.Random(seed)
    out = []
    for seq in range(1, n + 1):
        src = rng.choice([None, *names]) if rng.random() < 0.9 else "nobody"
        dst = rng.choice([None, *names]) if rng.random() < 0.9 else "nobody"
        if hot and rng.random() < 0.7:
            if rng.random() < 0.5:
                src = hot
            else:
                dst = hot
        low = -20 if negative else 0
        out.append((seq * 3, src, dst, rng.randint(low, 60)))
    return out


STATUSES = ["OPEN"] * 5 + ["FROZEN", "CLOSED"]


@pytest.mark.parametrize("seed,negative", [(1, False), (2, True)])
def test_random_ledgers(spark, seed, negative):
    names = [f"n{i}" for i in range(12)]
    accounts = {n: STATUSES[i % 7] for i, n in enumerate(names)}
    check(spark, random_ledger(seed, 400, names, negative=negative), accounts, {"n0": 300})


@pytest.mark.parametrize(
    "seed,options,negative",
    [
        (3, {"width": 200, "split_legs": 40, "slice_width": 300}, False),
        (4, {"width": 90, "split_legs": 10, "slice_width": 200, "max_dirty": 0}, True),
        (5, {"width": 200, "slice_width": 150, "max_dirty": 3}, False),
    ],
)
def test_busy_account(spark, seed, options, negative):
    """Most legs touch one account that hovers around zero; it is folded in parts, and
    slices are run in order where rounds go back and forth."""
    names = [f"n{i}" for i in range(10)]
    accounts = dict.fromkeys(names, "OPEN") | {"n9": "FROZEN"}
    ledger = random_ledger(seed, 260, names, hot="n1", negative=negative)
    check(spark, ledger, accounts, {"n1": 50}, **options)


def test_all_accounts_in_parts_equals_none(spark):
    names = [f"n{i}" for i in range(6)]
    ledger = random_ledger(6, 120, names)
    check(spark, ledger, dict.fromkeys(names, "OPEN"), width=100, split_legs=1)


@pytest.fixture
def tables(monkeypatch):
    """The tables that settlement stores, by name."""
    kept, stored = {}, settlement.saved

    def saved(df, path, *args):
        kept[path.rsplit("/", 1)[-1]] = out = stored(df, path, *args)
        return out

    monkeypatch.setattr(settlement, "saved", saved)
    return kept


def waiting_ledger():
    """An account with 300 deposits, 300 withdrawals that they cover and one withdrawal in the
    middle that asks 5 more than there is, and waits for a chain of payers who have nothing."""
    names = ["h", *(f"n{i}" for i in range(8))]
    out = [(1, None, "n0", 9), (2, "n0", None, 5)]
    out += [(10 + i, f"n{i}", f"n{i + 1}" if i < 7 else "h", 5) for i in range(8)]
    for first in (100, 401):
        out += [(first + 2 * i, None, "h", 10) for i in range(150)] + [(first + 2 * i + 1, "h", None, 7) for i in range(150)]
    out.append((400, "h", None, 455))
    return out, dict.fromkeys(names, "OPEN")


def test_rounds_shrink_with_the_open_transfers(spark, tables):
    """Money that is certain in parts without an open withdrawal is not carried from round to
    round, and an account with few legs left is folded whole."""
    transfers, accounts = waiting_ledger()
    rows = check(spark, transfers, accounts, width=4, split_legs=40, max_dirty=0, slice_width=1)
    assert rows[400][0] == "FAILED"
    parts = {n: t.where(F.col("tag") == tasks.PART_ROW).count() for n, t in tables.items() if n.startswith("round-")}
    assert parts.pop("round-00000") > 100
    assert parts and max(parts.values()) == 0


def test_a_given_width_makes_a_bounded_number_of_cells(spark, tables, monkeypatch):
    monkeypatch.setattr(settlement, "MAX_CELLS", 16)
    transfers, accounts = waiting_ledger()
    check(spark, transfers, accounts, width=1, split_legs=40)
    parts = tables["round-00000"].where(F.col("tag") == tasks.PART_ROW).groupBy("account").count()
    assert 1 < parts.agg(F.max("count")).first()[0] <= 16


@pytest.mark.parametrize("seed,negative,max_dirty", [(21, False, 0), (22, True, 5), (23, False, 100_000)])
def test_accounts_that_stay_in_parts(spark, seed, negative, max_dirty):
    """Money that goes past the start of a part is not in the bounds that the part starts from."""
    names = [f"n{i}" for i in range(6)]
    accounts = dict.fromkeys(names, "OPEN") | {"n5": "FROZEN"}
    ledger = random_ledger(seed, 300, names, hot="n1", negative=negative)
    check(spark, ledger, accounts, {"n1": 200, "n2": 90}, width=25, split_legs=6, max_dirty=max_dirty)


def test_ends_of_parts(spark):
    """Parts with and without an open withdrawal: bounds, pending money, first open position."""
    rows = [
        (1, "a", 0, 10, 20, 4, None),
        (1, "a", 1, 12, 25, 3, 15),
        (1, "a", 3, 14, 30, -2, None),
        (1, "a", 4, 16, 35, 0, None),
        (1, "a", 6, 18, 40, 7, 61),
        (1, "a", 8, 20, 45, 1, None),
    ]
    result = spark.createDataFrame(rows, "tag int, account string, cell long, low long, high long, gap long, first_open long")
    ends = settlement._ends(result)
    bounds = {r["cell"]: (r["low"], r["high"]) for r in ends.collect()}
    # Past the start of part 1 go 4, of part 3 the 3 of part 1, of parts 4 and 6 its 3 - 2, of part 8 the 7.
    assert bounds == {0: (None, None), 1: (6, 16), 3: (9, 22), 4: (13, 29), 6: (15, 34), 8: (11, 33)}
    moved = {(r["cell"], r["seq"], r["money"]) for r in settlement._pending(ends).collect()}
    assert moved == {(1, 15, 4), (6, 61, 1)}


def test_turns_grow(spark, tables):
    """One group of 1,500 transfers between poor accounts takes a few turns, not one for each slice."""
    rng = random.Random(5)
    names = [f"n{i}" for i in range(40)]
    out = [(i + 1, None, n, 9) for i, n in enumerate(names)]
    out += [(seq, *rng.sample(names, 2), rng.randint(1, 30)) for seq in range(41, 1541)]
    check(spark, out, dict.fromkeys(names, "OPEN"), slice_width=4)
    assert 2 <= sum(n.endswith("-ran") for n in tables) <= 5


def test_no_transfers(spark):
    assert settle(spark, [], OPEN2).count() == 0


def test_settling_what_settled_changes_nothing(spark):
    """A failed transfer that is delivered again must not pay its destination."""
    transfers = [(1, "a", "b", 10), (2, None, "a", 50)]
    once = check(spark, transfers, OPEN2)
    again = settle(spark, transfers, OPEN2)
    assert {r["seq"]: r["status"] for r in again.collect()} == {k: v[0] for k, v in once.items()}


def test_emitted_events_keep_money_and_keys(spark):
    accounts = {1: "OPEN", 2: "OPEN", 3: "FROZEN"}
    rows = [(1, None, 1, 100), (2, 1, 2, 30), (3, 1, 3, 20), (4, 2, 1, 31), (5, 1, 99, 5)]
    transfers = spark.createDataFrame(rows, "seq long, from_id long, to_id long, money long")
    acc = spark.createDataFrame(list(accounts.items()), "account_id long, status string")
    out = settlement.settle(transfers, acc)
    events = settlement.emitted_events(out)
    kinds = [(r["seq"], r["kind"]) for r in events.orderBy("seq").collect()]
    assert kinds == [
        (10, "TransactionCreated"),
        (12, "MoneyDeposited"),
        (13, "TransactionSucceeded"),
        (20, "TransactionCreated"),
        (21, "MoneyWithdrawn"),
        (22, "MoneyDeposited"),
        (23, "TransactionSucceeded"),
        (30, "TransactionCreated"),
        (31, "MoneyWithdrawn"),
        (32, "TransactionFailed"),
        (34, "MoneyDeposited"),
        (40, "TransactionCreated"),
        (41, "TransactionFailed"),
        (50, "TransactionCreated"),
        (51, "MoneyWithdrawn"),
    ]
    keys = [r[0] for r in events.where("idempotency_key > ''").select("idempotency_key").collect()]
    assert len(keys) == len(set(keys))
    total = settlement.conserve_money(out, settlement.settled_balances(out, acc)).first()
    assert (total["held"], total["stuck"], total["difference"]) == (95, 5, 0)
    assert [r["seq"] for r in settlement.stuck_transfers(out).collect()] == [5]


def test_refund_is_paid_once(spark):
    failed = spark.createDataFrame(
        [(1, "t1", True), (2, "t1", True), (3, "t2", False), (4, "t3", True)],
        "seq long, tx_id string, rollback boolean",
    )
    tx = spark.createDataFrame(
        [("t1", 5, "a"), ("t2", 6, "a"), ("t3", 7, "b")], "id string, money long, from_id string"
    )
    stored = spark.createDataFrame([("t3/rollback",)], "idempotency_key string")
    rows = settlement.refunds(failed, tx, stored).collect()
    assert [(r["aggregate_id"], r["money"], r["idempotency_key"]) for r in rows] == [
        ("a", 5, "t1/rollback")
    ]


def test_unknown_status_is_an_error(spark):
    with pytest.raises(Exception, match="unknown account status"):
        settle(spark, [(1, "a", None, 1)], {"a": "MELTED"}).agg(F.count("*")).collect()


def test_balances_beyond_64_bits_raise(spark):
    """Two deposits of 2**62 and one of 2**63 - 1 do not fit; a wrapped balance would reject the withdrawal."""
    transfers = [(1, None, "a", 2**62), (2, None, "a", 2**62), (3, "a", None, 1)]
    with pytest.raises(Exception, match="64 bits"):
        settle(spark, transfers, {"a": "OPEN"}).collect()


def test_balances_up_to_64_bits(spark):
    check(spark, [(1, None, "a", 2**62), (2, None, "a", 2**62 - 1), (3, "a", None, 2**62)], {"a": "OPEN"})


def test_amounts_beyond_64_bits_that_nobody_can_pay(spark):
    """Three withdrawals of 2**62 from an empty account are rejected; together they do not fit 64 bits."""
    rows = check(spark, [(i, "a", "b", 2**62) for i in (1, 2, 3)], OPEN2)
    assert {r[0] for r in rows.values()} == {"FAILED"}
    check(spark, [(1, None, "a", 2**62), *((i, "a", "b", 2**62) for i in (2, 3, 4)), (5, "b", "a", 2**62)], OPEN2)


def poor_ledger(n, seed=1):
    """Accounts near zero that pay each other, and a chain along which one sum is passed on:
    from exactly zero, in order, until somebody asks for one more."""
    rng = random.Random(seed)
    names, chain = [f"a{i}" for i in range(3000)], [f"c{i}" for i in range(20_000)]
    out = [(i + 1, None, a, rng.randint(0, 40)) for i, a in enumerate(names[:1000])]
    out.append((len(out) + 1, None, "c0", 25))
    passed = 0
    for seq in range(len(out) + 1, n + 1):
        kind = rng.random()
        if kind < 0.3 and passed + 1 < len(chain):
            out.append((seq, chain[passed], chain[passed + 1], 25 if rng.random() < 0.9999 else 26))
            passed += 1
        elif kind < 0.9:
            out.append((seq, rng.choice(names), rng.choice(names), rng.randint(1, 40)))
        else:
            side = (None, rng.choice(names)) if kind < 0.95 else (rng.choice(names), None)
            out.append((seq, *side, rng.randint(1, 30)))
    return out, dict.fromkeys([*names, *chain], "OPEN")


def test_100000_transfers_of_poor_accounts(spark):
    transfers, accounts = poor_ledger(100_000)
    rows = check(spark, transfers, accounts)
    assert sum(r[0] == "FAILED" for r in rows.values()) > 50_000


@pytest.mark.parametrize("options", [{"slice_width": 700}, {"split_legs": 60, "width": 1000, "slice_width": 900}])
def test_large_groups_are_run_in_turns(spark, options):
    transfers, accounts = poor_ledger(4000, seed=2)
    check(spark, transfers, accounts, **options)


def test_connected_groups(spark):
    """A long path, a star, a pair of equal edges and a node with an edge to itself."""
    edges = [(f"p{i:03}", f"p{i + 1:03}") for i in range(150)] + [("s", f"s{i}") for i in range(30)]
    edges += [("x", "y"), ("y", "x"), ("lone", "lone")]
    random.Random(1).shuffle(edges)
    got = dict(tuple(r) for r in groups.connected(spark.createDataFrame(edges, "a string, b string")).collect())
    want = {f"p{i:03}": "p000" for i in range(151)} | {f"s{i}": "s" for i in range(30)} | {"s": "s"}
    assert got == want | {"x": "x", "y": "x", "lone": "lone"}


def test_bounds_agree_leg_by_leg_and_together():
    """Many groups at once and one by one give the same; each verdict holds for the open ones
    passing as well as failing."""
    rng = np.random.default_rng(3)
    n, size = 60, 25
    leg = rng.integers(0, 3, n * size)
    money, gap = rng.integers(-5, 30, n * size), np.where(leg == 1, rng.integers(-9, 9, n * size), 0)
    moves = rng.random(n * size) < 0.9
    starts = np.arange(n) * size
    zero = [0] * n
    together = tasks.bounds_of_legs(leg, money, gap, moves, starts, starts + size, zero, zero, zero)
    for g in range(n):
        part = slice(g * size, g * size + size)
        alone = tasks.bounds_of_legs(
            leg[part], money[part], gap[part], moves[part], np.array([0]), np.array([size]), [0], [0], [0]
        )
        assert all((np.asarray(x)[part] == y).all() for x, y in zip(together[:2], alone[:2], strict=True))
        assert [x[g] for x in together[2:]] == [x[0] for x in alone[2:]]
        for _ in range(20):
            balance = 0
            for k in range(part.start, part.stop):
                if leg[k] == 0:
                    balance += money[k]
                elif leg[k] == 2:
                    balance += money[k] * rng.integers(0, 2)
                else:
                    balance += gap[k]
                    ok = balance >= money[k]
                    assert together[0][k] in (0, 1 if ok else 2)
                    if ok and moves[k]:
                        balance -= money[k]
            assert together[2][g] <= balance <= together[3][g]
