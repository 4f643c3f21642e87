"""Ordered settlement of transfers: reject overdrafts, compensate, complete.

Whether a withdrawal passes depends on every earlier verdict of its account, and a
deposit on the verdict of another account, so no window function gives the answer.
Verdicts are found out of order, from bounds on balances:

* A round turns the open transfers into legs, shuffles them once by account and follows
  a lower and an upper balance along each account. A deposit that is still open moves
  one bound only. A withdrawal that the lower bound covers has passed, one that the
  upper bound does not cover has failed, whatever the open ones will do; such verdicts
  are final. The others stay open, with the certain money since the open withdrawal
  before them as their ``gap``, so a decided transfer is a leg of no later round.
* The first open transfer of all sees exact balances, so each round decides some. With
  few new verdicts, only the accounts that they pay into are folded again.
* An account with more legs than a limit is folded in parts, one per cell of positions,
  so that no task holds more of it than a cell. The bounds at the start of a part come
  from sums over the parts before it, and from where the last round left the part before.
  Certain money at the end of a part goes to the next part where a withdrawal is open, so
  legs become fewer with the open transfers; each round counts them anew, and an account
  with few of them left is folded whole again.
* Accounts that live near zero and pay each other leave chains of transfers that wait for
  each other. When rounds decide little, the open transfers are cut into groups of accounts
  that pay each other, and each group is run in order, all groups side by side; of a group
  with more transfers than ``SLICE`` only the first ones, before the rounds go on. A smaller
  slice than that grows from turn to turn, so turns do not become many with a large group.

Each round writes the verdicts it found and the transfers still open to the shared folder,
which cuts its lineage; a lost executor costs the current round at most.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passbook.functions.ids import account_uuid, idempotency_key, transaction_uuid
from passbook.functions.money import disabled_reason, failure_reason
from passbook.operators.groups import connected
from passbook.operators.joins import lookup
from passbook.operators.tasks import (
    ACCEPTED,
    CERTAIN_LEG,
    CLOSED_SIDE,
    DEPOSIT_LEG,
    FROZEN_SIDE,
    HIGHEST,
    LOWEST,
    NO_SIDE,
    OPEN_SIDE,
    OPENING_LEG,
    PART_ROW,
    SELF_SIDE,
    UNDECIDED,
    UNKNOWN_SIDE,
    WHOLE,
    WITHDRAW_LEG,
    WITHDRAWAL_ROW,
    arrow_schema,
    fold_partition,
    run_groups,
)
from passbook.schema import (
    ACCOUNT,
    CLOSED,
    DEPOSIT,
    FAILED,
    FROZEN,
    OPEN,
    PENDING,
    ROLLBACK,
    SUCCEEDED,
    TRANSACTION,
    WITHDRAW,
)
from passbook.session import saved, shared_dir

# Positions are cut into at most MAX_CELLS cells. An account is folded in parts above
# SPLIT_LEGS legs, or above 1/MAX_HEAVY of all legs, which bounds the number of such
# accounts by MAX_HEAVY: few enough to broadcast. With another limit there may be more of
# them, and how they are joined is left to Spark.
MIN_WIDTH = 1 << 20
MAX_CELLS = 1 << 12
SPLIT_LEGS = 1 << 20
MAX_HEAVY = 10_000
# With no more changed verdicts than this, a round folds only the accounts they pay into,
# which are then few enough to broadcast.
MAX_DIRTY = 100_000
# Transfers of one group that are run in order at a time. A smaller number that is given
# grows to this one, by a factor for each turn.
SLICE = 1 << 20
SLICE_GROWTH = 8

_DISABLED = {CLOSED_SIDE: CLOSED, FROZEN_SIDE: FROZEN}
_LEG_COLUMNS = ("account", "cell", "seq", "leg", "money", "gap", "to_id", "dest")


def _side_state(key: str, status: str) -> Column:
    s = F.col(status)
    return (
        F.when(F.col(key).isNull(), NO_SIDE)
        .when(s.isNull(), UNKNOWN_SIDE)
        .when(s == OPEN, OPEN_SIDE)
        .when(s == CLOSED, CLOSED_SIDE)
        .when(s == FROZEN, FROZEN_SIDE)
        .otherwise(F.raise_error(F.concat(F.lit("unknown account status "), s)))
    )


def classify_transfers(transfers: DataFrame) -> DataFrame:
    """Deposit, withdraw or transfer, by which ids are set; both unset moves nothing."""
    origin, dest = F.col("from_id").isNotNull(), F.col("to_id").isNotNull()
    return transfers.withColumn(
        "type",
        F.when(origin & dest, "transfer")
        .when(origin, "withdraw")
        .when(dest, "deposit")
        .otherwise("nothing"),
    )


def _with_sides(transfers: DataFrame, accounts: DataFrame) -> DataFrame:
    out = transfers.select("seq", "from_id", "to_id", "money")
    for side in ("from", "to"):
        dim = accounts.select(
            F.col("account_id").alias("__acc"), F.col("status").alias(f"{side}_status")
        )
        out = lookup(out, f"{side}_id", "seq", dim, "__acc")
    to_state = F.when(
        (F.col("to_status") == OPEN) & (F.col("from_id") == F.col("to_id")), SELF_SIDE
    ).otherwise(_side_state("to_id", "to_status"))
    return out.select(
        "seq",
        "from_id",
        "to_id",
        "money",
        _side_state("from_id", "from_status").alias("origin"),
        to_state.alias("dest"),
    )


def _legs(open_transfers: DataFrame, certain: DataFrame) -> DataFrame:
    """A withdrawal of each open transfer, the deposit it may make, and certain money."""
    both = f"""inline(array(
        named_struct('account', account, 'leg', {WITHDRAW_LEG}, 'gap', gap, 'to_id', to_id, 'dest', dest),
        if(dest = {OPEN_SIDE},
           named_struct('account', to_id, 'leg', {DEPOSIT_LEG}, 'gap', nullif(gap, gap),
                        'to_id', nullif(to_id, to_id), 'dest', nullif(dest, dest)),
           null)))"""
    own = open_transfers.selectExpr("cell", "seq", "money", both).where("leg IS NOT NULL")
    sure = certain.select("account", "cell", "seq", F.lit(CERTAIN_LEG).alias("leg"), "money")
    return own.unionByName(sure, allowMissingColumns=True).select(*_LEG_COLUMNS)


def _result_schema(key: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("tag", T.IntegerType()),
            T.StructField("account", key),
            T.StructField("cell", T.LongType()),
            T.StructField("seq", T.LongType()),
            T.StructField("money", T.LongType()),
            T.StructField("gap", T.LongType()),
            T.StructField("to_id", key),
            T.StructField("dest", T.IntegerType()),
            T.StructField("verdict", T.IntegerType()),
            T.StructField("low", T.LongType()),
            T.StructField("high", T.LongType()),
            T.StructField("first_open", T.LongType()),
        ]
    )


def _fold(legs: DataFrame, schema: T.StructType) -> DataFrame:
    """One round over legs with their part: withdrawals and ends of parts, told by ``tag``."""
    rows = legs.select("account", "part", "seq", "leg", "money", "gap", "to_id", "dest", "cell")
    arrow = arrow_schema(schema)
    ordered = rows.repartition("account", "part").sortWithinPartitions(
        "account", "part", F.col("leg") != OPENING_LEG, F.col("seq").asc_nulls_first(), "leg"
    )
    return ordered.mapInArrow(partial(fold_partition, schema=arrow), schema)


def _openings(legs: DataFrame, ends: DataFrame | None) -> DataFrame:
    """Bounds of the balance at the start of each part: account, part, money (low), gap (high).

    ``legs`` are those of accounts folded in parts, ``ends`` what ``_ends`` says of the last round.
    Open withdrawals all pass or all fail in the sums; certain and open losses add up to a
    floor, as no withdrawal goes below zero. Sums are decimals, and are cut to 64 bits. A
    window holds one row per part of an account, at most ``MAX_CELLS``.
    """
    wide = T.DecimalType(38, 0)
    money, zero = F.col("money").cast(wide), F.lit(0).cast(wide)
    withdraws = F.col("leg") == WITHDRAW_LEG
    sure = F.when(F.col("leg") == CERTAIN_LEG, money).when(withdraws, F.col("gap").cast(wide)).otherwise(zero)
    paid = F.when(F.col("leg") == DEPOSIT_LEG, money).otherwise(zero)
    still = F.col("dest").isin(SELF_SIDE, *_DISABLED)
    taken = F.when(withdraws & ~still, money).otherwise(zero)
    sums = legs.groupBy("account", "part").agg(
        F.sum(sure + F.least(paid, zero) - F.greatest(taken, zero)).alias("low"),
        F.sum(sure + F.greatest(paid, zero) - F.least(taken, zero)).alias("high"),
        F.sum(F.least(sure, zero) + F.least(paid, zero)).alias("floor"),
    )
    w = Window.partitionBy("account").orderBy("part")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    summed = sums.select(
        "account",
        "part",
        F.greatest(F.sum("low").over(before), F.sum("floor").over(before)).alias("low"),
        F.sum("high").over(before).alias("high"),
    )
    if ends is not None:
        known = ends.select(
            "account",
            F.col("cell").alias("part"),
            F.col("low").alias("known_low"),
            F.col("high").alias("known_high"),
        )
        summed = summed.join(known, ["account", "part"], "left").select(
            "account", "part", F.greatest("low", "known_low").alias("low"), F.least("high", "known_high").alias("high")
        )
    low, high = F.lit(LOWEST).cast(wide), F.lit(HIGHEST).cast(wide)
    return summed.where("low IS NOT NULL").select(
        "account",
        "part",
        F.lit(OPENING_LEG).alias("leg"),
        F.greatest(low, F.least(high, "low")).cast("long").alias("money"),
        F.greatest(low, F.least(high, "high")).cast("long").alias("gap"),
    )


def _ends(result: DataFrame) -> DataFrame:
    """For each part of a round: money that is pending at its end (gap), where that goes, the
    first open withdrawal behind it (next, null where no withdrawal waits for it), and bounds
    of the balance at its start (low, high), without the money that goes past it.

    A window holds one row per part of an account, at most ``MAX_CELLS``.
    """
    wide = T.DecimalType(38, 0)
    w = Window.partitionBy("account").orderBy("cell")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("account").orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    waits = F.col("first_open").isNotNull()
    zero = F.lit(0).cast(wide)
    placed = result.where(F.col("tag") == PART_ROW).select(
        "account",
        "cell",
        "gap",
        waits.alias("waits"),
        F.lag("low").over(w).alias("low"),
        F.lag("high").over(w).alias("high"),
        F.coalesce(F.sum(F.col("gap").cast("decimal(20,0)")).over(before).cast(wide), zero).alias("sum"),
        F.last(F.when(waits, F.struct("cell", F.col("first_open").alias("seq"))), ignorenulls=True).over(behind).alias("next"),
    )
    # What is pending since the last part with an open withdrawal goes past the start of this one.
    past = F.col("sum") - F.coalesce(F.last(F.when(F.col("waits"), F.col("sum")), ignorenulls=True).over(before), zero)
    return placed.select(
        "account",
        "cell",
        "gap",
        "next",
        (F.col("low").cast(wide) - past).cast(wide).alias("low"),
        (F.col("high").cast(wide) - past).cast(wide).alias("high"),
    )


def _pending(ends: DataFrame) -> DataFrame:
    """Pending money of parts as certain money of the next part that waits for it."""
    due = ends.where((F.col("gap") != 0) & F.col("next").isNotNull())
    return due.groupBy("account", "next").agg(F.sum(F.col("gap").cast("decimal(38,0)")).alias("money")).select(
        "account", "next.cell", "next.seq", F.col("money").cast("long").alias("money")
    )


def _run_groups(
    open_transfers: DataFrame, certain: DataFrame, most: int, schema: T.StructType, folder: str
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Run groups of accounts that pay each other in order, side by side.

    Of a group with more than ``most`` transfers only the first ones are run. Returns the
    verdicts, and the open transfers and certain money that are left, None if there are none.
    """
    paid = F.when(F.col("dest") == OPEN_SIDE, F.col("to_id")).otherwise(F.col("account"))
    labels = connected(open_transfers.select(F.col("account").alias("a"), paid.alias("b")))
    of_account = labels.withColumnRenamed("node", "account")
    mine = saved(open_transfers.join(of_account, "account"), f"{folder}-mine")
    sure = saved(certain.join(of_account, "account"), f"{folder}-sure")
    large = mine.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > most)
    large = saved(large, f"{folder}-large")
    later = None
    if not large.isEmpty():
        # The cut of a group is the position below which a power of 1/2 of it stands.
        halves = F.array(*(F.lit(0.5**k) for k in range(1, 41)))
        step = F.ceil(F.log2(F.col("n") / F.lit(most))).cast("int")
        cuts = (
            mine.join(F.broadcast(large), "group")  # a row for each `most` transfers at most
            .groupBy("group")
            .agg(F.element_at(F.percentile_approx("seq", halves, 100_000), F.first(F.greatest(step, F.lit(1)))).alias("cut"))
        )
        cuts = F.broadcast(saved(cuts, f"{folder}-cuts"))
        mine, sure = (x.join(cuts, "group", "left") for x in (mine, sure))
        later = mine.where(F.col("seq") > F.col("cut")).select(*open_transfers.columns)
        kept = sure.where("cut IS NOT NULL").select(*certain.columns)
        first = F.col("cut").isNull() | F.col("seq").isNull() | (F.col("seq") <= F.col("cut"))
        mine, sure = mine.where(first), sure.where(first)
    rows = mine.withColumn("leg", F.lit(WITHDRAW_LEG)).unionByName(
        sure.withColumn("leg", F.lit(CERTAIN_LEG)), allowMissingColumns=True
    )
    ordered = rows.repartition("group").sortWithinPartitions("group", F.col("seq").asc_nulls_first(), "leg")
    names = [*open_transfers.columns, "verdict", *(["cut"] if later is not None else [])]
    kinds = {f.name: f for f in schema.fields} | {"cut": T.StructField("cut", T.LongType())}
    out = T.StructType([kinds[n] for n in names])
    ran = saved(ordered.mapInArrow(partial(run_groups, schema=arrow_schema(out)), out), f"{folder}-ran")
    if later is None:
        return ran, None, None
    again = ran.where("cut IS NOT NULL")
    passed = F.col("verdict") == ACCEPTED
    still = F.col("dest").isin(SELF_SIDE, *_DISABLED)
    own = F.col("gap") - F.when(passed & ~F.coalesce(still, F.lit(False)), F.col("money")).otherwise(0)
    moved = again.select("account", "cell", "seq", own.alias("money"))
    return ran, later, kept.unionByName(moved).unionByName(_paid(again))


def _paid(decided: DataFrame) -> DataFrame:
    """Certain money that accepted transfers bring: account, cell, seq, money."""
    return decided.where((F.col("verdict") == ACCEPTED) & (F.col("dest") == OPEN_SIDE)).select(
        F.col("to_id").alias("account"), "cell", "seq", "money"
    )


def _heavy_accounts(legs: DataFrame, limit: int) -> DataFrame:
    counts = legs.groupBy("account").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > limit).select("account", F.lit(True).alias("heavy"))


def settle(
    transfers: DataFrame,
    accounts: DataFrame,
    opening: DataFrame | None = None,
    width: int | None = None,
    split_legs: int | None = None,
    max_dirty: int = MAX_DIRTY,
    slice_width: int = SLICE,
) -> DataFrame:
    """Outcome of every transfer, as if run one by one in ``seq`` order.

    ``transfers``: seq (long, unique), from_id, to_id (null for no leg), money.
    ``accounts``: account_id, status. ``opening``: account_id, balance before the
    first transfer (0 where missing). ``width`` is the number of positions per cell (more
    where that makes over ``MAX_CELLS`` cells), ``split_legs`` the number of legs above which
    an account is folded in parts, and ``max_dirty`` the number of new verdicts up to which
    only their accounts are folded;
    ``slice_width`` is the number of transfers of a group that are run in order in the first
    turn, where rounds decide little; each further turn runs more, up to ``SLICE``.

    Returns seq, from_id, to_id, money, status, reason, rollback, withdrawn,
    deposited, refunded.
    """
    folder = shared_dir(transfers.sparkSession, "settle")
    sided = saved(_with_sides(transfers, accounts), f"{folder}/sided")
    bounds = sided.agg(
        F.coalesce(F.min("seq"), F.lit(0)).alias("lo"),
        F.coalesce(F.max("seq"), F.lit(0)).alias("hi"),
        (F.count_if(F.col("origin") == OPEN_SIDE) + F.count_if(F.col("dest") == OPEN_SIDE)).alias("legs"),
        F.count_if(F.col("origin") == OPEN_SIDE).alias("tries"),
    ).first()
    lo = bounds["lo"]
    width = max(width or MIN_WIDTH, -(-(bounds["hi"] - lo + 1) // MAX_CELLS))
    last_cell = (bounds["hi"] - lo) // width
    limit = split_legs or max(SPLIT_LEGS, -(-bounds["legs"] // MAX_HEAVY))
    splits = bounds["legs"] > limit and last_cell > 0  # accounts may have more legs than that
    heavy, n_heavy = None, 0  # accounts that this round folds in parts

    def few(x: DataFrame) -> DataFrame:
        return F.broadcast(x) if heavy is None or n_heavy <= MAX_HEAVY else x

    def in_parts(legs: DataFrame, ends: DataFrame | None) -> DataFrame:
        """The legs with their part, and the bounds that parts start from."""
        if heavy is None:
            return legs.withColumn("part", F.lit(WHOLE).cast("long"))
        part = F.expr(f"if(heavy, cell, {WHOLE}L)")
        legs = legs.join(few(heavy), "account", "left").withColumn("part", part)
        openings = _openings(legs.where("heavy"), ends)
        return legs.drop("heavy").unionByName(openings, allowMissingColumns=True)

    def reached(decided: DataFrame) -> DataFrame:
        """Accounts that the decided transfers pay into, and all that were folded in parts."""
        paid = decided.where(F.col("dest") == OPEN_SIDE).select(F.col("to_id").alias("account"))
        if heavy is not None:
            paid = paid.unionByName(heavy.select("account"))
        return few(paid.distinct())

    cell = F.expr(f"(seq - {lo}L) div {width}L").cast("long")
    open_transfers = sided.where(F.col("origin") == OPEN_SIDE).select(
        F.col("from_id").alias("account"),
        cell.alias("cell"),
        "seq",
        "money",
        F.lit(0).cast("long").alias("gap"),
        "to_id",
        "dest",
    )
    certain = sided.where((F.col("origin") == NO_SIDE) & (F.col("dest") == OPEN_SIDE)).select(
        F.col("to_id").alias("account"), cell.alias("cell"), "seq", "money"
    )
    if opening is not None:
        first = opening.select(
            F.col("account_id").alias("account"),
            F.lit(0).cast("long").alias("cell"),
            F.lit(None).cast("long").alias("seq"),
            F.col("balance").alias("money"),
        )
        certain = certain.unionByName(first)
    schema = _result_schema(sided.schema["from_id"].dataType)
    names = open_transfers.columns
    done: list[DataFrame] = []
    left = bounds["tries"]  # open transfers
    dirty = None  # accounts to fold; nothing is new for the others
    ends = None  # what is known of the parts of the last round
    steps = 0

    while left:
        legs = _legs(open_transfers, certain)
        if dirty is not None:
            legs = legs.join(dirty, "account", "left_semi")
        if splits:
            heavy = saved(_heavy_accounts(legs, limit), f"{folder}/heavy-{steps:05d}")
            n_heavy = heavy.count()
            heavy = heavy if n_heavy else None
            splits = n_heavy > 0  # rounds do not make more legs
        folded = _fold(in_parts(legs, ends), schema)
        if dirty is not None:
            others = open_transfers.join(dirty, "account", "left_anti").selectExpr(
                "*", f"{WITHDRAWAL_ROW} AS tag", f"{UNDECIDED} AS verdict"
            )
            folded = folded.unionByName(others, allowMissingColumns=True)
        seen = Observation()
        new = (F.col("tag") == WITHDRAWAL_ROW) & (F.col("verdict") != UNDECIDED)
        result = saved(folded.observe(seen, F.count_if(new).alias("decided")), f"{folder}/round-{steps:05d}")
        decided = result.where(new).select(*names, "verdict")
        found, open_before = seen.get["decided"], left
        done.append(decided)
        left -= found
        steps += 1
        if not left:
            break
        ends = saved(_ends(result), f"{folder}/ends-{steps:05d}") if heavy is not None else None
        open_transfers = result.where((F.col("tag") == WITHDRAWAL_ROW) & (F.col("verdict") == UNDECIDED)).select(*names)
        certain = _paid(decided)
        if ends is not None:
            certain = certain.unionByName(_pending(ends))
        dirty = reached(decided) if found <= max_dirty else None
        if found * 8 > open_before:
            continue
        ran, later, kept = _run_groups(open_transfers, certain, slice_width, schema, f"{folder}/groups-{steps:05d}")
        done.append(ran.select(*names, "verdict"))
        if later is None:
            break
        slice_width = max(slice_width, min(slice_width * SLICE_GROWTH, SLICE))
        left -= ran.count()
        open_transfers, certain, dirty = later, kept, None
        splits = bounds["legs"] > limit and last_cell > 0

    untried = sided.where(F.col("origin") != OPEN_SIDE).withColumn("ok", F.col("origin") == NO_SIDE)
    for part in done:
        tried = part.select(
            "seq",
            F.col("account").alias("from_id"),
            "to_id",
            "money",
            F.lit(OPEN_SIDE).alias("origin"),
            "dest",
            (F.col("verdict") == ACCEPTED).alias("ok"),
        )
        untried = untried.unionByName(tried)
    return _outcomes(untried)


def _outcomes(verdicts: DataFrame) -> DataFrame:
    origin, dest, ok = F.col("origin"), F.col("dest"), F.col("ok")
    disabled = F.create_map(*[F.lit(x) for kv in _DISABLED.items() for x in kv])
    stopped = dest.isin(*_DISABLED)
    has_origin = origin != NO_SIDE
    status = (
        F.when(origin == UNKNOWN_SIDE, PENDING)
        .when(~ok, FAILED)
        .when(dest == UNKNOWN_SIDE, PENDING)
        .when(stopped, FAILED)
        .otherwise(SUCCEEDED)
    )
    reason = (
        F.when(origin == UNKNOWN_SIDE, "")
        .when(origin.isin(*_DISABLED), disabled_reason("From", disabled[origin]))
        .when(~ok, failure_reason("From"))
        .when(stopped, disabled_reason("To", disabled[dest]))
        .otherwise("")
    )
    return verdicts.select(
        "seq",
        "from_id",
        "to_id",
        "money",
        status.alias("status"),
        reason.alias("reason"),
        (ok & stopped & has_origin).alias("rollback"),
        (ok & has_origin).alias("withdrawn"),
        (ok & dest.isin(OPEN_SIDE, SELF_SIDE)).alias("deposited"),
        (ok & stopped & has_origin).alias("refunded"),
    )


def withdrawals(outcomes: DataFrame) -> DataFrame:
    """Withdraw legs with their verdict, from the account that was asked."""
    return outcomes.where(F.col("from_id").isNotNull()).select(
        "seq",
        F.col("from_id").alias("account_id"),
        "money",
        F.col("withdrawn").alias("accepted"),
        F.when(~F.col("withdrawn"), F.col("reason")).otherwise("").alias("reason"),
    )


def deposits(outcomes: DataFrame) -> DataFrame:
    """Deposit legs that were reached (the withdrawal passed, or there was none)."""
    reached = F.col("withdrawn") | F.col("from_id").isNull()
    return outcomes.where(F.col("to_id").isNotNull() & reached).select(
        "seq",
        F.col("to_id").alias("account_id"),
        "money",
        F.col("deposited").alias("accepted"),
        F.when(F.col("status") == FAILED, F.col("reason")).otherwise("").alias("reason"),
    )


def balance_changes(outcomes: DataFrame) -> DataFrame:
    """Net movement per account, combined before the shuffle."""
    out = F.when(
        F.col("withdrawn") & ~F.col("refunded"),
        F.struct(F.col("from_id").alias("account_id"), (-F.col("money")).alias("amount")),
    )
    into = F.when(
        F.col("deposited"),
        F.struct(F.col("to_id").alias("account_id"), F.col("money").alias("amount")),
    )
    return (
        outcomes.select(F.inline(F.array(out, into)))
        .where("account_id IS NOT NULL")
        .groupBy("account_id")
        .agg(F.sum("amount").alias("amount"))
    )


def settled_balances(
    outcomes: DataFrame, accounts: DataFrame, opening: DataFrame | None = None
) -> DataFrame:
    """account_id, status, balance of every account after settlement."""
    moves = balance_changes(outcomes)
    if opening is not None:
        moves = (
            moves.unionByName(opening.select("account_id", F.col("balance").alias("amount")))
            .groupBy("account_id")
            .agg(F.sum("amount").alias("amount"))
        )
    return accounts.join(moves, "account_id", "left").select(
        "account_id", "status", F.coalesce("amount", F.lit(0)).alias("balance")
    )


def emitted_events(outcomes: DataFrame, slots: int = 10, numbered: bool = True) -> DataFrame:
    """The events that settlement appends to the log, with their idempotency keys.

    Position ``seq * slots + n``: 0 created, 1 withdrawn or failed, 2 deposited or
    failed, 3 succeeded, 4 refund. Numeric ids become those of the log; with ``numbered``
    off, accounts have them already, and transfers theirs in ``tx_id``.
    """
    tx = transaction_uuid("seq") if numbered else F.col("tx_id")
    from_acc, to_acc = (account_uuid(c) if numbered else F.col(c) for c in ("from_id", "to_id"))
    status = F.col("status")
    failed_from = (status == FAILED) & ~F.col("withdrawn") & F.col("from_id").isNotNull()
    failed_to = (status == FAILED) & ~failed_from
    empty = F.lit("")

    def event(applies, slot, aggregate, agg_id, kind, key, with_money=False, ends=False, ids=False):
        def only(cond: bool, value: Column, dtype: str) -> Column:
            return (value if cond else F.lit(None)).cast(dtype)

        return F.when(
            applies,
            F.struct(
                (F.col("seq") * slots + slot).alias("seq"),
                agg_id.alias("aggregate_id"),
                F.lit(aggregate).alias("aggregate_kind"),
                F.lit(kind).alias("kind"),
                only(with_money, F.col("money"), "long").alias("money"),
                tx.alias("tx_id"),
                only(ids, from_acc, "string").alias("from_id"),
                only(ids, to_acc, "string").alias("to_id"),
                only(ends, F.col("rollback"), "boolean").alias("rollback"),
                only(ends, F.col("reason"), "string").alias("reason"),
                key.alias("idempotency_key"),
            ),
        )

    events = [
        event(F.lit(True), 0, TRANSACTION, tx, "TransactionCreated", empty, True, ids=True),
        event(
            F.col("withdrawn"), 1, ACCOUNT, from_acc, "MoneyWithdrawn",
            idempotency_key(tx, WITHDRAW), True,
        ),
        event(
            failed_from, 1, TRANSACTION, tx, "TransactionFailed",
            idempotency_key(tx, WITHDRAW), ends=True,
        ),
        event(
            F.col("deposited"), 2, ACCOUNT, to_acc, "MoneyDeposited",
            idempotency_key(tx, DEPOSIT), True,
        ),
        event(
            failed_to, 2, TRANSACTION, tx, "TransactionFailed",
            idempotency_key(tx, DEPOSIT), ends=True,
        ),
        event(status == SUCCEEDED, 3, TRANSACTION, tx, "TransactionSucceeded", empty),
        event(
            F.col("refunded"), 4, ACCOUNT, from_acc, "MoneyDeposited",
            idempotency_key(tx, ROLLBACK), True,
        ),
    ]
    return outcomes.select(F.inline(F.array(*events))).where("seq IS NOT NULL")


def completions(outcomes: DataFrame) -> DataFrame:
    return emitted_events(outcomes.where(F.col("status") == SUCCEEDED)).where(
        F.col("kind") == "TransactionSucceeded"
    )


def failures(outcomes: DataFrame) -> DataFrame:
    return emitted_events(outcomes.where(F.col("status") == FAILED)).where(
        F.col("kind") == "TransactionFailed"
    )


def refunds(failed: DataFrame, transactions: DataFrame, stored: DataFrame) -> DataFrame:
    """Compensation: failures that ask for a rollback give the money back, once.

    ``failed``: seq, tx_id, rollback. ``transactions``: id, money, from_id.
    ``stored``: idempotency keys already in the log.
    """
    due = failed.where("rollback").groupBy("tx_id").agg(F.min("seq").alias("seq"))
    tx = transactions.select(F.col("id").alias("tx_id"), "money", "from_id")
    return (
        due.join(tx.where(F.col("from_id").isNotNull()), "tx_id")
        .withColumn("idempotency_key", idempotency_key("tx_id", ROLLBACK))
        .join(stored.select("idempotency_key"), "idempotency_key", "left_anti")
        .select(
            F.col("from_id").alias("aggregate_id"),
            F.lit("MoneyDeposited").alias("kind"),
            "money",
            "tx_id",
            "idempotency_key",
        )
    )


def stuck_transfers(outcomes: DataFrame) -> DataFrame:
    """Transfers still PENDING whose money left the origin and reached nobody."""
    return outcomes.where(
        (F.col("status") == PENDING) & F.col("withdrawn") & ~F.col("deposited")
    ).select("seq", "from_id", "to_id", "money")


def conserve_money(outcomes: DataFrame, balances: DataFrame) -> DataFrame:
    """One row: balances = outside deposits - outside withdrawals - stuck money."""
    zero = F.lit(0)

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("money"))), zero)

    flows = outcomes.agg(
        total(F.col("from_id").isNull() & F.col("deposited")).alias("deposited"),
        total(F.col("to_id").isNull() & F.col("withdrawn")).alias("withdrawn"),
        total(
            (F.col("status") == PENDING) & F.col("withdrawn") & F.col("to_id").isNotNull()
        ).alias("stuck"),
    )
    held = balances.agg(F.coalesce(F.sum("balance"), zero)).scalar()
    return flows.withColumn("held", held).withColumn(
        "difference", F.col("held") - (F.col("deposited") - F.col("withdrawn") - F.col("stuck"))
    )
