"""Streams against their batch twins: redelivery, restarts, late rows, the reactor."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import serial
from passbook.operators import folds, sinks
from passbook.plans import streams
from passbook.session import shared_dir
from passbook.sources import files
from passbook.streaming import frontier, reactor, stateful
from passbook.streaming import projections as p
from passbook.streaming.batches import BatchTable

LOG = (
    "seq long, aggregate_id string, aggregate_kind string, kind string, money long, owner string, "
    "created_at timestamp_ntz"
)


def ledger(spark, n=300, keys=8, seed=1):
    rng = random.Random(seed)
    data = [(i, f"a{i}", "AccountCreated", 0, f"o{i}") for i in range(keys)]
    for seq in range(keys, n):
        key = "a0" if rng.random() < 0.4 else f"a{rng.randint(0, keys)}"
        kind = rng.choice(["MoneyDeposited", "MoneyWithdrawn", "OwnerUpdated"])
        data.append((seq, key, kind, rng.randint(0, 9), "w"))
    df = spark.createDataFrame(data, "seq long, aggregate_id string, kind string, money long, owner string")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, seq)")
    return df.withColumn("aggregate_kind", F.lit("Account")).withColumn("created_at", at).select(
        "seq", "aggregate_id", "aggregate_kind", "kind", "money", "owner", "created_at"
    )


def documents(df):
    return sorted((r["id"], r["sequence"], r["balance"], r["owner"]) for r in df.collect())


def feed(spark, folder, part):
    part.coalesce(1).write.mode("append").parquet(f"{folder}/feed")
    return files.stream_table(spark, f"{folder}/feed", part.schema)


def test_projection_equals_batch_after_restarts(spark):
    log = ledger(spark)
    folder = shared_dir(spark, "test")
    for lo in range(0, 300, 100):
        part = log.where((F.col("seq") >= lo) & (F.col("seq") < lo + 100))
        p.until_caught_up(p.balance_projection(feed(spark, folder, part), folder))
        seen = folds.fold_balance_projection(log.where(F.col("seq") < lo + 100))
        assert documents(p.read_projection(spark, folder)) == documents(seen)


def test_redelivery_counts_once_with_and_without_watermark(spark):
    log = ledger(spark)
    want = documents(folds.fold_balance_projection(log))
    # One row arrives a few hundred times more, all others twice.
    copies = log.where("seq = 20").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("n")
    for watermark in (None, "1 hour"):
        folder = shared_dir(spark, "test")
        part = log.unionByName(log).unionByName(copies)
        query = p.balance_projection(
            feed(spark, folder, part), folder, dedup=True, watermark=watermark
        )
        p.until_caught_up(query)
        p.until_caught_up(
            p.balance_projection(
                feed(spark, folder, log.where("seq % 3 = 0")), folder, dedup=True, watermark=watermark
            )
        )
        assert documents(p.read_projection(spark, folder)) == want


def test_marks_drop_late_rows_per_partition(spark):
    log = ledger(spark).withColumn("topic", F.concat(F.lit("t."), F.pmod(F.hash("aggregate_id"), F.lit(2))))
    slow = log.select("topic").distinct().orderBy("topic").first()["topic"]
    folder = shared_dir(spark, "test")
    # The slow partition delivers its first rows after the other one is done.
    first = log.where((F.col("topic") != slow) | (F.col("seq") < 50))
    second = log.where(F.col("topic") == slow).unionByName(first.where("seq % 5 = 0"))
    for part in (first, second):
        p.until_caught_up(p.mark_projection(feed(spark, folder, part), folder))
    assert documents(p.read_marked(spark, folder)) == documents(folds.fold_balance_projection(log))
    assert p.read_marks(spark, folder).count() == 2

    lossy = shared_dir(spark, "test")
    for part in (first, second):
        p.until_caught_up(p.mark_projection(feed(spark, lossy, part), lossy, global_mark=True))
    assert documents(p.read_marked(spark, lossy)) != documents(folds.fold_balance_projection(log))


def test_repeated_batch_replaces_itself(spark):
    log = ledger(spark).withColumn("topic", F.lit("t.1"))
    folder = shared_dir(spark, "test")
    source = feed(spark, folder, log)
    p.until_caught_up(p.mark_projection(source, folder))
    want = documents(p.read_marked(spark, folder))
    p.until_caught_up(p.mark_projection(source, folder, checkpoint="second"))
    assert documents(p.read_marked(spark, folder)) == want


def test_reactor_equals_serial_run(spark):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(6)]
    accounts = dict.fromkeys(names, "OPEN") | {"n5": "FROZEN"}
    transfers = [
        (s, rng.choice([None, "nobody", *names]), rng.choice([None, *names]), rng.randint(0, 50))
        for s in range(1, 241)
    ]
    want, _ = serial.run(transfers, accounts)
    folder = shared_dir(spark, "test")
    acc = spark.createDataFrame(list(accounts.items()), "account_id string, status string")
    all_rows = spark.createDataFrame(transfers, "seq long, from_id string, to_id string, money long")
    for lo in range(0, 240, 60):
        new = all_rows.where((F.col("seq") > lo) & (F.col("seq") <= lo + 60))
        repeats = all_rows.where((F.col("seq") <= lo) & (F.col("seq") > lo - 30))
        stream = feed(spark, folder, new.unionByName(new).unionByName(repeats))
        p.until_caught_up(p.reactor(stream, acc, folder, compact_every=2))
    key = all_rows.schema["from_id"].dataType
    got = {
        r["seq"]: (r["status"], r["reason"], r["rollback"], r["withdrawn"], r["deposited"], r["refunded"])
        for r in p.read_outcomes(spark, folder, key).collect()
    }
    assert got == want


def test_status_keeps_first_terminal_event(spark):
    rows = [
        (1, "t1", "TransactionCreated", None),
        (2, "t1", "TransactionFailed", "From account: not enough funds"),
        (3, "t1", "TransactionSucceeded", None),
        (4, "t2", "TransactionCreated", None),
    ]
    df = spark.createDataFrame(rows, "seq long, aggregate_id string, kind string, reason string")
    folder = shared_dir(spark, "test")
    for part in (df.where("seq <= 2"), df.where("seq > 2")):
        p.until_caught_up(p.transaction_status(feed(spark, folder, part), folder))
    assert sorted(tuple(r) for r in p.read_status(spark, folder).collect()) == [
        ("t1", "FAILED", "From account: not enough funds"),
        ("t2", "PENDING", ""),
    ]


def test_a_batch_reads_the_marks_of_the_one_before_only(spark):
    """Marks of a topic partition that is silent for some batches are carried on."""
    folder = shared_dir(spark, "test-marks")
    log = ledger(spark, 400)
    quiet = log.where("seq % 2 = 0 AND seq < 100").withColumn("topic", F.lit("a.1"))
    busy = log.where("seq % 2 = 1").withColumn("topic", F.lit("b.1"))
    p.until_caught_up(p.mark_projection(feed(spark, folder, quiet), folder))
    for k in range(3):
        part = busy.where(f"seq >= {k * 100} AND seq < {k * 100 + 100}")
        p.until_caught_up(p.mark_projection(feed(spark, folder, part), folder))
    before = {r.id: r.token for r in p.read_marks(spark, folder).collect()}
    assert len(before) == 2
    p.until_caught_up(p.mark_projection(feed(spark, folder, quiet.where("seq < 50")), folder))
    assert {r.id: r.token for r in p.read_marks(spark, folder).collect()} == before
    written = BatchTable(spark, f"{folder}/marks", p.DELTA_ROWS).read()
    last = written.agg(F.max("batch_id")).first()[0]
    assert written.where((F.col("batch_id") == last) & F.col("id").isNull()).count() == 2
    assert written.where((F.col("batch_id") == last) & F.col("id").isNotNull()).isEmpty()


def topic_feed(spark, folder, log, partitions=4, tasks=8):
    """The log in a topic, written by several tasks, as a stream of one file a batch."""
    rows = sinks.numbered(log, "accounts", partitions)
    rows.repartition(tasks, "seq").write.mode("append").parquet(f"{folder}/topic")
    return files.stream_table(spark, f"{folder}/topic", rows.schema, max_files=1)


@pytest.mark.parametrize("width", [7, 1 << 16])
def test_no_event_is_lost_whatever_file_comes_first(spark, width):
    """The log over 8 tasks and 4 topic partitions, a file a batch, then all of it again, then
    with a new checkpoint: the batch fold each time."""
    log = ledger(spark, 400)
    want = documents(folds.fold_balance_projection(log))
    folder = shared_dir(spark, "test")
    for checkpoint in ("one", "one", "two"):
        feed_ = topic_feed(spark, folder, log)
        p.until_caught_up(frontier.frontier_projection(feed_, folder, checkpoint=checkpoint, width=width))
        assert documents(frontier.read_frontier(spark, folder)) == want
    tokens = frontier.read_tokens(spark, folder)
    assert tokens.count() == 4 and tokens.agg(F.sum("frontier")).first()[0] == 400 + 4


def test_rows_wait_for_a_missing_one(spark):
    log = ledger(spark, 60)
    rows = sinks.numbered(log, "accounts", 1)
    folder = shared_dir(spark, "test")
    read = lambda: frontier.read_tokens(spark, folder).first().frontier
    for part, reached in (("offset <> 20", 20), ("offset = 30", 20), ("offset = 20", 61)):
        p.until_caught_up(frontier.frontier_projection(feed(spark, folder, rows.where(part)), folder))
        assert read() == reached
    assert documents(frontier.read_frontier(spark, folder)) == documents(folds.fold_balance_projection(log))


def test_a_lost_checkpoint_counts_nothing_twice(spark):
    """Two batches, then a checkpoint that knows of none: batch 0 holds everything."""
    log = ledger(spark).withColumn("topic", F.lit("t.1"))
    folder = shared_dir(spark, "test")
    for part in (log.where("seq < 150"), log.where("seq >= 150")):
        p.until_caught_up(p.mark_projection(feed(spark, folder, part), folder))
    p.until_caught_up(p.mark_projection(feed(spark, folder, log.limit(0)), folder, checkpoint="second"))
    assert documents(p.read_marked(spark, folder)) == documents(folds.fold_balance_projection(log))


def test_batches_are_merged(spark):
    """With a merge every second batch, readers see the same, and read fewer folders."""
    log = ledger(spark)
    folder = shared_dir(spark, "test")
    table = BatchTable(spark, f"{folder}/plain", p.DELTA_ROWS).create()
    merged = BatchTable(spark, f"{folder}/merged", p.DELTA_ROWS, p._summed, every=2).create()
    rows = log.select(
        F.lit("t.1").alias("topic"), F.col("aggregate_id").alias("id"), F.lit(1).cast("long").alias("events"),
        F.col("seq").alias("sequence"), F.col("money").alias("amount"), "owner",
    )
    for k in range(5):
        for t in (table, merged):
            t.write(rows.where(f"sequence % 5 = {k}"), k)
            t.write(rows.limit(1), k)  # a batch that is repeated stays as it is
    assert merged.read().count() < table.read().count() == 300
    same = [p._summed(t.read().drop("batch_id")).orderBy("topic", "id").collect() for t in (table, merged)]
    assert same[0] == same[1]


def test_forwarded_rows_are_numbered_on_end(spark):
    log = ledger(spark, 200)
    folder = shared_dir(spark, "test")
    for part in (log.where("seq < 80"), log.where("seq >= 80")):
        p.until_caught_up(p.forward(feed(spark, folder, part), "accounts", 3, folder))
    got = p.read_topic(spark, log.schema, "accounts", folder).orderBy("topic", "offset").collect()
    for topic in {r.topic for r in got}:
        mine = [r for r in got if r.topic == topic]
        assert [r.offset for r in mine] == list(range(1, len(mine) + 1))
        assert [r.seq for r in mine] == sorted(r.seq for r in mine)
    assert sorted(r.seq for r in got) == list(range(200))


def test_reactor_emits_what_follows_from_its_messages(spark):
    """Requests in batches with repeats, failures fed back more than once, and a lost checkpoint."""
    rng = random.Random(8)
    names = [f"n{i}" for i in range(6)]
    accounts = dict.fromkeys(names, "OPEN") | {"n5": "FROZEN"}
    transfers = [
        (s * 10, rng.choice([None, "nobody", *names[:5]]), rng.choice([None, "nobody", *names]), rng.randint(0, 50))
        for s in range(1, 121)
    ]
    want, balances = serial.run(transfers, accounts)
    folder = shared_dir(spark, "test")
    acc = spark.createDataFrame(list(accounts.items()), "account_id string, status string")
    rows = [("t.1", s, f"tx{s}", "TransactionCreated", m, a, b, None) for s, a, b, m in transfers]
    schema = "topic string, seq long, aggregate_id string, kind string, money long, from_id string, to_id string, rollback boolean"
    asked = spark.createDataFrame(rows, schema)

    def failures():
        failed = reactor.read_emitted(spark, folder).where("kind = 'TransactionFailed'").withColumn("topic", F.lit("t.1"))
        return spark.createDataFrame(failed.select(*asked.columns).collect(), asked.schema)

    for part in (asked.where("seq <= 600"), asked.where("seq > 400"), failures, failures):
        part = part() if callable(part) else part
        p.until_caught_up(reactor.react(feed(spark, folder, part), acc, folder))
    for _ in range(2):
        events = reactor.read_emitted(spark, folder).collect()
        keys = [r.idempotency_key for r in events if r.idempotency_key]
        assert len(keys) == len(set(keys))
        held = dict.fromkeys(accounts, 0)
        for r in events:
            if r.aggregate_kind == "Account":
                held[r.aggregate_id] += r.money if r.kind == "MoneyDeposited" else -r.money
        assert held == balances
        ended = {r.aggregate_id: (r.kind, r.reason) for r in events if r.kind.startswith("Transaction")}
        assert ended == {
            f"tx{s}": ("TransactionSucceeded", None) if w[0] == "SUCCEEDED" else ("TransactionFailed", w[1])
            for s, w in want.items()
            if w[0] != "PENDING"
        }
        assert sum(r.idempotency_key.endswith("/rollback") for r in events) == sum(w[5] for w in want.values()) > 0
        # All messages again, for a checkpoint that knows of none.
        p.until_caught_up(reactor.react(feed(spark, folder, asked.limit(0)), acc, folder, checkpoint="second"))
    assert [tuple(r) for r in reactor.read_tokens(spark, folder).collect()] == [("t.1/accounts-reactor", "CatchUp:1200")]


def test_runs_of_offsets():
    rng = random.Random(4)
    starts = ends = np.zeros(0, np.int64)
    seen = set()
    for _ in range(60):
        offsets = np.array(sorted(rng.sample(range(300), rng.randint(1, 12))), np.int64)
        new, starts, ends = stateful.add_to_runs(starts, ends, offsets)
        assert [int(x) for x in offsets[new]] == [int(x) for x in offsets if x not in seen]
        seen |= set(offsets.tolist())
        assert {x for a, b in zip(starts, ends, strict=True) for x in range(a, b)} == seen
        assert (starts[1:] > ends[:-1]).all()


def test_state_of_redelivery_stays_flat(spark):
    """20 batches of offsets on end, then all of them again: a row of state a topic partition."""
    log = ledger(spark, 400)
    folder = shared_dir(spark, "test")
    rows = sinks.numbered(log, "accounts", 2)
    rows.repartitionByRange(20, "seq").write.parquet(f"{folder}/topic")
    for _ in range(2):
        stream = files.stream_table(spark, f"{folder}/topic", rows.schema, max_files=1)
        p.until_caught_up(stateful.dedup_projection(stream, folder))
        assert documents(p.read_marked(spark, folder, "once")) == documents(folds.fold_balance_projection(log))
        state = stateful.state_rows(spark, folder, "once", "runs").select("key.*", "value.*").collect()
        assert len(state) == 2 and all(len(r.starts) == 1 for r in state)
        spark.read.parquet(f"{folder}/topic").coalesce(1).write.mode("append").parquet(f"{folder}/topic")
    assert stateful.progress(spark, folder, "once", "runs").first().last_batch >= 20


def test_live_goes_on_from_the_history(spark):
    log = ledger(spark)
    folder = shared_dir(spark, "test")
    history, live = log.where("seq < 150"), log.where("seq >= 100")
    for part in (live.where("seq < 220"), live.where("seq >= 220")):
        p.until_caught_up(stateful.catch_up_then_live(history, feed(spark, folder, part), folder))
    assert documents(stateful.read_live(spark, folder)) == documents(folds.fold_balance_projection(log))
    # The history did not go through the stream: it saw the live rows only, and not the overlap.
    counted = stateful.state_rows(spark, folder, "live", "state").agg(F.sum("value.version")).first()[0]
    assert counted == log.where("kind <> 'OwnerUpdated'").count()
    other = shared_dir(spark, "test")
    p.until_caught_up(stateful.catch_up_then_live(log.limit(0), feed(spark, other, log), other))
    assert documents(stateful.read_live(spark, other)) == documents(folds.fold_balance_projection(log))


def requests(spark, n):
    rows = [(i, f"t{i}", "TransactionCreated") for i in range(n)]
    rows += [(100 + i, f"t{i}", "TransactionSucceeded") for i in range(0, n, 2)]
    log = spark.createDataFrame(rows, "seq long, aggregate_id string, kind string")
    return log.withColumn("created_at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, seq)"))


def test_overdue_by_the_time_of_the_log(spark):
    log = requests(spark, 20)
    folder = shared_dir(spark, "test")
    p.until_caught_up(stateful.overdue_transactions(feed(spark, folder, log), folder, 102_000))
    # The log ends at second 118; t17 and t19 are not 102 seconds old then.
    assert {r.id for r in stateful.read_overdue(spark, folder).collect()} == {f"t{i}" for i in range(1, 16, 2)}


def test_overdue_by_the_clock(spark):
    log = requests(spark, 6)
    folder = shared_dir(spark, "test")
    query = stateful.overdue_transactions(feed(spark, folder, log), folder, 500, watermark=None, every="1 second")
    try:
        until = time.time() + 90
        while stateful.read_overdue(spark, folder).count() < 3 and time.time() < until:
            time.sleep(0.5)
    finally:
        query.stop()
    assert {r.id for r in stateful.read_overdue(spark, folder).collect()} == {"t1", "t3", "t5"}


def test_state_of_live_accounts_is_a_row_a_group(spark, monkeypatch):
    """Accounts of the history, new ones, and rows without an owner, in fewer groups than accounts."""
    monkeypatch.setattr(stateful, "MIN_GROUPS", 2)
    monkeypatch.setattr(stateful, "ACCOUNTS", 40)
    log = ledger(spark, 1500, keys=200)
    folder = shared_dir(spark, "test")
    history = log.where("seq < 100")
    for part in (log.where("seq >= 50 and seq < 700"), log.where("seq >= 700")):
        p.until_caught_up(stateful.catch_up_then_live(history, feed(spark, folder, part), folder, shares=2))
    assert documents(stateful.read_live(spark, folder)) == documents(folds.fold_balance_projection(log))
    state = stateful.state_rows(spark, folder, "live", "state").select("key.*", "value.*").collect()
    assert len(state) <= 6 and sum(r.version for r in state) == log.where("kind <> 'OwnerUpdated'").count()


def test_groups_of_transfers_have_one_timer(spark):
    """Ends and repeats that come later, and transfers due at the watermark and just behind it."""
    rows = [(i, f"t{i}", "TransactionCreated") for i in range(60)]
    rows += [(100, "t0", "TransactionSucceeded"), (100, "t59", "TransactionFailed")]
    later = [(i, f"t{i}", "TransactionSucceeded") for i in range(101, 160)]
    later += [(140, "t50", "TransactionSucceeded"), (150, "t51", "TransactionCreated"), (150, "t0", "TransactionCreated")]
    folder = shared_dir(spark, "test")
    for part, until in ((rows, 11), (later, 60)):
        log = spark.createDataFrame(part, "seq long, aggregate_id string, kind string")
        at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, seq)")
        stream = feed(spark, folder, log.withColumn("created_at", at))
        p.until_caught_up(stateful.overdue_transactions(stream, folder, 90_000, groups=3))
        late = [r.id for r in stateful.read_overdue(spark, folder).collect()]
        ended = {0, 59} | ({50} if until == 60 else set())
        assert sorted(late) == sorted(f"t{i}" for i in range(until) if i not in ended)
    assert stateful.state_rows(spark, folder, "overdue", "state").count() <= 3


def test_a_larger_topic_has_more_files_and_as_many_batches(spark, monkeypatch):
    monkeypatch.setattr(streams, "_topic_files", lambda n, f=streams._topic_files: f(n, 20))
    log = ledger(spark, 400).withColumn("tx_id", F.lit(None).cast("string"))
    folder = shared_dir(spark, "test")
    quarter = streams._published(spark, log, folder)
    topic = spark.read.parquet(f"{folder}/topic")
    assert quarter == 5 and len(topic.inputFiles()) == 20
    assert topic.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < 60
    streams._consumed(spark, folder, quarter)
    assert documents(frontier.read_frontier(spark, folder)) == documents(folds.fold_balance_projection(log))
    batches = BatchTable(spark, f"{folder}/frontier", frontier.ROWS)._batches()
    assert set(batches) == {-1, 0, 1, 2, 3}
