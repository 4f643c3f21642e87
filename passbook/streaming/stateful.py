"""Streams with state of their own: seen positions as runs, a history to start from, timers.

State lives in RocksDB, so it may outgrow the memory of an executor. Its keys are dealt over
the shuffle partitions; an account or topic partition that holds many of the rows is split
into shares or cells, and rows are worked off in Arrow batches, never a group at once. Each
key of state costs calls between Python and the engine, so accounts and transfers are held
in groups, many to a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from passbook.functions.money import signed_money
from passbook.schema import CATCH_UP, OPEN, PROJECTED_KINDS, TERMINAL_KINDS, TRANSACTION_KINDS
from passbook.streaming.batches import BatchTable
from passbook.streaming.projections import DELTA_ROWS, _summed, run_projection

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"

#: Offsets of a cell, whose seen ones are one row of state.
CELL = 1 << 16
#: Shares that the rows of one account are dealt to.
SHARES = 16
#: Accounts of the history in a group, and the fewest groups.
ACCOUNTS, MIN_GROUPS = 1 << 13, 1 << 8
#: Groups of transfers that wait for their end.
GROUPS = 1 << 13

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()


@contextmanager
def on_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


# Redelivery -------------------------------------------------------------------------------


def add_to_runs(starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the sorted, distinct ``offsets`` are in none of the runs [start, end), and the
    runs after them; runs that touch become one."""
    at = np.searchsorted(starts, offsets, side="right") - 1
    new = (at < 0) | (offsets >= ends[np.maximum(at, 0)]) if len(starts) else np.ones(len(offsets), bool)
    first = np.concatenate([starts, offsets[new]])
    last = np.concatenate([ends, offsets[new] + 1])
    order = np.argsort(first, kind="stable")
    first, last = first[order], last[order]
    if len(first):
        opens = np.ones(len(first), bool)
        opens[1:] = first[1:] > last[:-1]
        closes = np.append(opens[1:], True)
        first, last = first[opens], last[closes]
    return new, first, last


class SeenRuns(StatefulProcessor):
    """Passes each offset of a cell once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        runs = T.StructType([T.StructField("starts", T.ArrayType(_L)), T.StructField("ends", T.ArrayType(_L))])
        self.runs = handle.getValueState("runs", runs)

    def handleInputRows(self, key, rows, timerValues):
        starts, ends = self.runs.get() if self.runs.exists() else ([], [])
        starts, ends = np.array(starts, np.int64), np.array(ends, np.int64)
        for batch in rows:
            one = batch.drop_duplicates("offset").sort_values("offset")
            new, starts, ends = add_to_runs(starts, ends, one["offset"].to_numpy(np.int64))
            yield one[new]
        self.runs.update((starts.tolist(), ends.tolist()))

    def close(self) -> None:
        pass


def once(stream: DataFrame, cell: int = CELL) -> DataFrame:
    """Events of a topic (with topic and offset), each once however often it comes.

    The state is one row for each cell of ``cell`` offsets, a single run where all of them came;
    rows of all kinds take part, so that no offset is missing.
    """
    rows = stream.select(
        "topic",
        F.expr(f"`offset` div {cell}").alias("cell"),
        "offset",
        "seq",
        F.col("aggregate_id").alias("id"),
        F.coalesce(signed_money(), F.lit(0)).alias("amount"),
        F.when(F.col("kind") == "AccountCreated", F.col("owner")).alias("owner"),
        F.col("kind").isin(*PROJECTED_KINDS).alias("projected"),
    )
    return rows.groupBy("topic", "cell").transformWithStateInPandas(SeenRuns(), rows.schema, "Append", "None")


def dedup_projection(
    stream: DataFrame, folder: str, name: str = "once", every: str | None = None, cell: int = CELL
) -> StreamingQuery:
    """Sum up a topic that delivers rows more than once; batches write what they add."""
    spark = stream.sparkSession
    table = BatchTable(spark, f"{folder}/{name}", DELTA_ROWS, _summed).create()

    def apply(batch: DataFrame, batch_id: int) -> None:
        sums = batch.where("projected").groupBy("topic", "id").agg(
            F.count("*").alias("events"),
            F.max("seq").alias("sequence"),
            F.sum("amount").alias("amount"),
            F.max("owner").alias("owner"),
        )
        table.write(sums, batch_id)

    with on_rocksdb(spark):
        return run_projection(stream, name, lambda df: once(df, cell), apply, folder, every=every)


# History, then live -----------------------------------------------------------------------

LIVE_ROWS = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (("id", _S), ("share", _L), ("version", _L), ("sequence", _L), ("balance", _L), ("owner", _S))
    ]
)


#: Events of a group, and its accounts column by column.
LIVE_STATE = T.StructType(
    [
        T.StructField("version", _L),
        T.StructField("ids", T.ArrayType(_S)),
        *(T.StructField(name, T.ArrayType(_L)) for name in ("versions", "sequences", "balances")),
        T.StructField("owners", T.ArrayType(_S)),
    ]
)


def _text(value: object) -> str | None:
    """A string of a pandas column, in which null may be a number."""
    return value if isinstance(value, str) else None


class RunningBalance(StatefulProcessor):
    """Adds events to the balances of a group's accounts, in one share, from the history's on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", LIVE_STATE)

    def _held(self) -> dict[str | None, tuple]:
        held = self.state.get()
        return {account: tuple(row) for account, *row in zip(*held[1:], strict=True)} if held else {}

    def _hold(self, accounts: dict[str | None, tuple]) -> None:
        columns = [list(c) for c in zip(*accounts.values(), strict=True)]
        self.state.update((sum(columns[0]), list(accounts), *columns))

    def handleInitialState(self, key, initialState, timerValues):
        if not len(initialState):
            return
        accounts = self._held()
        columns = (initialState[c].tolist() for c in LIVE_ROWS.names if c != "share")
        for account, version, sequence, balance, owner in zip(*columns, strict=True):
            accounts[_text(account)] = (int(version), int(sequence), int(balance), _text(owner))
        self._hold(accounts)

    def handleInputRows(self, key, rows, timerValues):
        accounts, changed = self._held(), {}
        for batch in rows:
            columns = (batch[c].tolist() for c in ("id", "seq", "amount", "owner"))
            for account, seq, amount, owner in zip(*columns, strict=True):
                account, owner = _text(account), _text(owner)
                version, sequence, balance, held = accounts.get(account, (0, 0, 0, None))
                named = changed.get(account)
                if owner is not None:
                    named = owner if named is None else max(named, owner)
                changed[account] = named
                accounts[account] = (version + 1, max(sequence, seq), balance + amount, held)
        for account, named in changed.items():
            if named is not None:
                accounts[account] = (*accounts[account][:3], named)
        self._hold(accounts)
        values = zip(*(accounts[account] for account in changed), strict=True)
        out = dict(zip(("version", "sequence", "balance", "owner"), values, strict=True))
        yield pd.DataFrame({"id": list(changed), "share": key[1]} | out)

    def close(self) -> None:
        pass


def _newest_share(rows: DataFrame) -> DataFrame:
    values = [c for c in rows.columns if c not in ("id", "share", "batch_id")]
    newest = rows.groupBy("id", "share").agg(F.max(F.struct("batch_id", *values)).alias("doc"))
    return newest.select("id", "share", "doc.*")


def catch_up_then_live(
    history: DataFrame, stream: DataFrame, folder: str, name: str = "live", every: str | None = None, shares: int = SHARES
) -> StreamingQuery:
    """Balances from ``history``, a table, and then from the live log behind it.

    The history is folded as a batch and handed to the stream as its first state; it does not
    go through the stream. Live events up to the history's last position are dropped, later
    ones are added, so the feed may overlap the history. A restart goes on from the checkpoint
    and takes the folded history as it was stored by the first start, and so the same groups.
    """
    spark = stream.sparkSession
    table = BatchTable(spark, f"{folder}/{name}", LIVE_ROWS, _newest_share).create()
    start = BatchTable(spark, f"{folder}/{name}-history", LIVE_ROWS)
    if not start._batches():
        applied = history.where(F.col("kind").isin(*PROJECTED_KINDS))
        folded = applied.groupBy(F.col("aggregate_id").alias("id")).agg(
            F.pmod(F.xxhash64("aggregate_id"), F.lit(shares)).alias("share"),
            F.count("*").alias("version"),
            F.max("seq").alias("sequence"),
            F.sum(signed_money()).alias("balance"),
            F.max(F.when(F.col("kind") == "AccountCreated", F.col("owner"))).alias("owner"),
        )
        start.write(folded, 0)
    first = start.read().select(*LIVE_ROWS.names)
    mark, accounts = first.agg(F.max("sequence"), F.count("*")).first()
    group = F.pmod(F.xxhash64("id"), F.lit(max(MIN_GROUPS, -(-accounts // ACCOUNTS)))).alias("group")
    # A null mark, with no history, lets all rows pass.
    live = stream.where(F.col("kind").isin(*PROJECTED_KINDS) & F.coalesce(F.col("seq") > F.lit(mark), F.lit(True)))
    rows = live.select(
        F.col("aggregate_id").alias("id"),
        F.pmod(F.xxhash64("seq"), F.lit(shares)).alias("share"),
        F.coalesce("seq", F.lit(-(2**63))).alias("seq"),
        F.coalesce(signed_money(), F.lit(0)).alias("amount"),
        F.when(F.col("kind") == "AccountCreated", F.col("owner")).alias("owner"),
    )

    begun = first.withColumn("balance", F.coalesce("balance", F.lit(0)))

    def running(df: DataFrame) -> DataFrame:
        return df.select(group, "*").groupBy("group", "share").transformWithStateInPandas(
            RunningBalance(), LIVE_ROWS, "Update", "None", initialState=begun.select(group, "*").groupBy("group", "share")
        )

    with on_rocksdb(spark):
        return run_projection(rows, name, running, table.write, folder, "update", every)


def read_live(spark: SparkSession, folder: str, name: str = "live") -> DataFrame:
    """The documents: history and shares of each account added up."""
    live = _newest_share(BatchTable(spark, f"{folder}/{name}", LIVE_ROWS).read())
    start = BatchTable(spark, f"{folder}/{name}-history", LIVE_ROWS).read().select(*LIVE_ROWS.names)
    untouched = start.join(live.select("id", "share"), ["id", "share"], "left_anti")
    both = live.select(*LIVE_ROWS.names).unionByName(untouched)
    summed = both.groupBy("id").agg(
        F.sum("version").alias("version"),
        F.max("sequence").alias("sequence"),
        F.sum("balance").alias("balance"),
        F.max("owner").alias("owner"),
    )
    return summed.where("owner IS NOT NULL").select(
        "id", "version", "sequence", F.lit(CATCH_UP).alias("kind"), F.lit(OPEN).alias("status"), "balance", "owner"
    )


# Timers -----------------------------------------------------------------------------------

OVERDUE_ROWS = T.StructType([T.StructField("id", _S), T.StructField("since", T.TimestampType())])


#: Transfers of a group column by column, and the timer of the group. ``due`` is null for
#: those that ended or were reported.
WAITING = T.StructType(
    [
        T.StructField("ids", T.ArrayType(_S)),
        T.StructField("since", T.ArrayType(_L)),
        T.StructField("due", T.ArrayType(_L)),
        T.StructField("ended", T.ArrayType(_B)),
        T.StructField("timer", _L),
    ]
)


class Overdue(StatefulProcessor):
    """Reports the transfers of a group that have not ended ``limit_ms`` after they were requested.

    A group has one timer, for the first of its transfers that is due.
    """

    def __init__(self, limit_ms: int, by_event_time: bool) -> None:
        self.limit_ms, self.by_event_time = limit_ms, by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", WAITING)

    def _held(self) -> tuple[dict[str | None, tuple], int | None]:
        held = self.state.get()
        if not held:
            return {}, None
        return {transfer: tuple(row) for transfer, *row in zip(*held[:4], strict=True)}, held[4]

    def _hold(self, transfers: dict[str | None, tuple], timer: int | None) -> None:
        first = min((due for _, due, _ in transfers.values() if due is not None), default=None)
        if first is not None and (timer is None or first < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
            timer = first
        columns = [list(c) for c in zip(*transfers.values(), strict=True)] or [[], [], []]
        self.state.update((list(transfers), *columns, timer))

    def handleInputRows(self, key, rows, timerValues):
        transfers, timer = self._held()
        asked, ended, unseen = {}, set(), (None, None, False)
        for batch in rows:
            columns = (batch[c].tolist() for c in ("id", "at_ms", "ends"))
            for transfer, at, ends in zip(*columns, strict=True):
                transfer = _text(transfer)
                if ends:
                    ended.add(transfer)
                elif pd.notna(at):
                    asked[transfer] = min(asked.get(transfer, at), at)
        now = None if self.by_event_time else timerValues.getCurrentProcessingTimeInMs()
        for transfer, at in asked.items():
            since, _, over = transfers.get(transfer, unseen)
            if since is None:
                since = int(at)
                start = since if self.by_event_time else now
                transfers[transfer] = (since, None if over else start + self.limit_ms, over)
        for transfer in ended:
            transfers[transfer] = (transfers.get(transfer, unseen)[0], None, True)
        self._hold(transfers, timer)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        transfers, _ = self._held()
        if self.by_event_time:
            now = timerValues.getCurrentWatermarkInMs()
        else:
            now = timerValues.getCurrentProcessingTimeInMs()
        # As the engine does with timers, which are up at this time.
        late = {transfer: row[0] for transfer, row in transfers.items() if row[1] is not None and row[1] <= now}
        for transfer, since in late.items():
            transfers[transfer] = (since, None, False)
        self._hold(transfers, None)
        if late:
            yield pd.DataFrame({"id": list(late), "since": pd.to_datetime(list(late.values()), unit="ms", utc=True)})

    def close(self) -> None:
        pass


def overdue_transactions(
    stream: DataFrame,
    folder: str,
    limit_ms: int,
    name: str = "overdue",
    watermark: str | None = "0 seconds",
    every: str | None = None,
    groups: int = GROUPS,
) -> StreamingQuery:
    """Transfers still PENDING ``limit_ms`` after they were requested, each once.

    With ``watermark``, how late rows may come, time is that of the log (``created_at``);
    without one it is the clock, and a transfer is reported while the query runs. State is
    one row for each of ``groups``, which a checkpoint keeps to.
    """
    spark = stream.sparkSession
    table = BatchTable(spark, f"{folder}/{name}", OVERDUE_ROWS).create()
    rows = stream.where(F.col("kind").isin(*TRANSACTION_KINDS)).select(
        F.col("aggregate_id").alias("id"),
        F.col("created_at").cast("timestamp").alias("at"),
        F.unix_millis(F.col("created_at").cast("timestamp")).alias("at_ms"),
        F.col("kind").isin(*TERMINAL_KINDS).alias("ends"),
    )
    if watermark:
        rows = rows.withWatermark("at", watermark)

    def timed(df: DataFrame) -> DataFrame:
        mode = "EventTime" if watermark else "ProcessingTime"
        return df.select(F.pmod(F.xxhash64("id"), F.lit(groups)).alias("group"), "*").groupBy("group").transformWithStateInPandas(
            Overdue(limit_ms, bool(watermark)), OVERDUE_ROWS, "Append", mode
        )

    with on_rocksdb(spark):
        return run_projection(rows, name, timed, table.write, folder, every=every)


def read_overdue(spark: SparkSession, folder: str, name: str = "overdue") -> DataFrame:
    return BatchTable(spark, f"{folder}/{name}", OVERDUE_ROWS).read().drop("batch_id")


# State of a stopped query -----------------------------------------------------------------


def progress(spark: SparkSession, folder: str, name: str, variable: str | None = None) -> DataFrame:
    """What the checkpoint of ``name`` tells: operator, its last batch, and rows of state; for
    an operator with state ``variable``s, of one of them."""
    operators = spark.read.format("state-metadata").load(f"{folder}/checkpoint-{name}")
    kept = operators.groupBy(F.col("operatorName").alias("operator")).agg(F.max("maxBatchId").alias("last_batch"))
    rows = state_rows(spark, folder, name, variable).agg(F.count("*"))
    return kept.withColumn("state_rows", rows.scalar())


def state_rows(spark: SparkSession, folder: str, name: str, variable: str | None = None) -> DataFrame:
    """Keys and values of the state that the checkpoint of ``name`` holds."""
    reader = spark.read.format("statestore")
    if variable:
        reader = reader.option("stateVarName", variable)
    return reader.load(f"{folder}/checkpoint-{name}")
