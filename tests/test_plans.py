"""Plans that hold at scale: pruned and filtered scans, no pairing of all rows."""

import pytest
from pyspark.sql import functions as F

from passbook.operators import filters, folds, joins, scans, settlement, views
from passbook.plans import batch
from passbook.session import shared_dir
from passbook.sources import canonical, files


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture(scope="module")
def typed(spark, sf_dir):
    """The decoded log as a stored table."""
    path = shared_dir(spark, "test")
    canonical.typed_log(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


SETTLED = {
    "append_events",
    "complete_transactions",
    "conserve_money",
    "count_tx_by_status",
    "end_to_end_keys",
    "fail_transactions",
    "filter_sufficient_funds",
    "refund_rollbacks",
    "replay_idempotent",
    "settle_deposits",
    "settle_in_parts",
    "settle_transfers",
    "settle_withdrawals",
    "stuck_transfers",
}


@pytest.mark.parametrize("name", sorted(set(batch.QUERIES) - SETTLED))
def test_no_query_pairs_all_rows(spark, sf_dir, name):
    text = plan(batch.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_lookup_reaches_the_scan(typed):
    text = plan(views.account_by_id(typed, batch.POINT_ID))
    assert "EqualTo(aggregate_id" in text
    assert "created_at" not in text.split("ReadSchema:")[1].splitlines()[0]


def test_kind_filter_and_columns_reach_the_scan(typed):
    text = plan(folds.sum_of(typed, "MoneyDeposited", "deposited"))
    assert "EqualTo(kind,MoneyDeposited)" in text
    schema = text.split("ReadSchema:")[1].splitlines()[0]
    assert "money" in schema and "owner" not in schema and "reason" not in schema


def test_kind_is_a_partition_of_the_stored_log(spark, sf_dir):
    path = shared_dir(spark, "test")
    raw = scans.assign_versions(canonical.raw_log(spark, sf_dir))
    raw.withColumn("aggregate_version", F.col("aggregate_version").cast("int")).write.partitionBy(
        "kind"
    ).parquet(path)
    text = plan(filters.of_kinds(files.read_event_log(spark, path)))
    assert "PartitionFilters: [kind#" in text


def test_money_is_summed_before_the_shuffle(typed):
    text = plan(folds.fold_balance_projection(typed))
    assert "partial_sum" in text and "SortAggregate" not in text


def test_rounds_of_settlement_leave_no_lineage(spark, sf_dir):
    out = settlement.settle(
        canonical.transfers(spark, sf_dir), canonical.accounts(spark, sf_dir)
    )
    text = plan(out)
    assert "MapInArrow" not in text and "Exchange" not in text


HOT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def hot_joins(spark):
    before = {k: spark.conf.get(k, None) for k in HOT}
    for k, v in HOT.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def busy_log(spark):
    """60 percent of the money events belong to account 1."""
    n = F.col("id")
    account = F.when(n % 5 < 3, 1).otherwise(n % 400 + 2)
    path = shared_dir(spark, "busy")
    opened = n < 402
    spark.range(40_000).repartition(16).select(
        F.when(opened, n - 1000).otherwise(n).alias("seq"),
        F.when(opened, n).otherwise(account).cast("string").alias("aggregate_id"),
        F.when(opened, "AccountCreated").when(n % 3 == 0, "MoneyWithdrawn").otherwise("MoneyDeposited").alias("kind"),
        F.when(opened, 0).otherwise(n % 100).alias("money"),
        F.when(opened, F.concat(F.lit("owner "), n.cast("string"))).alias("owner"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_a_busy_account_is_split_in_joins(spark, hot_joins):
    log = busy_log(spark)
    balances = folds.fold_balance_projection(log)
    accounts = folds.fold_account_state(log)
    snapshots = folds.snapshot_states(log)
    transfers = log.where("kind = 'MoneyWithdrawn'").select("seq", "money", F.col("aggregate_id").alias("from_id"))
    for frame in (
        joins.event_to_balance(log, balances),
        joins.leg_account(transfers, accounts, "from_id"),
        folds.join_snapshot_tail(log, snapshots),
    ):
        frame.collect()
        assert "skew=true" in plan(frame)


def test_states_save_reading_the_log(spark, sf_dir):
    """The fold from stored states scans the last ranges only."""
    frame = batch.fold_from_snapshot(spark, sf_dir)
    frame.collect()
    text = plan(frame)
    assert "PartitionFilters: [isnotnull(range" in text
    path, width = batch.stored_ranges(spark, sf_dir)
    whole = spark.read.parquet(path)
    tail = files.read_ranges(spark, path, batch.RANGED, width, batch.stored_states(spark, sf_dir)[1])
    assert 0 < tail.count() < whole.count() / 4
    read = [f.select(F.input_file_name()).distinct().count() for f in (tail, whole)]
    assert read[0] < read[1] / 4
