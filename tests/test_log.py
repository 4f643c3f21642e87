"""Codec, running values, folds, joins, sinks and checks on small hand-made logs."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passbook import functions as fn
from passbook.functions import ids as ids_module
from passbook.functions.codec import encode_body
from passbook.functions.containment import contains
from passbook.operators import bloom, checks, filters, folds, joins, scans, sinks, views
from passbook.plans.batch import covered_balance
from passbook.schema import NIL_UUID
from passbook.session import shared_dir
from passbook.sources import canonical, files

TX = "00000000-0000-4000-9000-000000000001"
TYPED = "seq long, aggregate_id string, kind string, money long, owner string"


def rows(df):
    return [tuple(r) for r in df.collect()]


def log(spark, events):
    """events: (seq, id, kind, money or owner)."""
    data = [
        (s, a, k, v if isinstance(v, int) else None, v if isinstance(v, str) else None)
        for s, a, k, v in events
    ]
    return spark.createDataFrame(data, TYPED)


STORY = [
    (1, "a", "AccountCreated", "Ann"),
    (2, "b", "AccountCreated", "Bob"),
    (3, "a", "MoneyDeposited", 100),
    (4, "a", "MoneyWithdrawn", 20),
    (5, "a", "OwnerUpdated", "Anna"),
    (6, "x", "MoneyDeposited", 5),
]


def story(spark):
    return log(spark, STORY).withColumn(
        "money", F.when(F.col("kind") == "AccountCreated", F.lit(0)).otherwise(F.col("money"))
    )


def test_codec_round_trip_and_zero_values(spark):
    bodies = spark.createDataFrame(
        [
            (1, "AccountCreated", '{"id":"%s","owner":"Ann"}' % TX),
            (2, "MoneyWithdrawn", '{"money":7,"TransactionID":"%s"}' % TX),
            (3, "MoneyDeposited", '{"money":7,"transactionID":"%s"}' % TX),
            (4, "TransactionCreated", '{"id":"%s","from":"%s"}' % (TX, NIL_UUID)),
            (5, "TransactionFailed", "{}"),
            (6, "TransactionSucceeded", "{}"),
            (7, "Mystery", "{}"),
            (8, "OwnerUpdated", "not json"),
        ],
        "seq long, kind string, body string",
    )
    got = {r["seq"]: r.asDict() for r in fn.decode_body(bodies).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 8}
    assert got[1]["money"] == 0 and got[1]["owner"] == "Ann" and got[1]["rollback"] is None
    assert got[2]["TransactionID"] == TX
    assert got[3]["TransactionID"] is None  # names are matched with their case
    assert got[4]["from"] is None and got[4]["to"] is None and got[4]["money"] == 0
    assert got[5]["rollback"] is False and got[5]["reason"] == ""
    assert got[8]["owner"] == ""
    encoded = fn.decode_body(bodies).select("seq", encode_body().alias("body"))
    text = dict(rows(encoded))
    assert text[1] == '{"id":"%s","owner":"Ann"}' % TX
    assert text[2] == '{"money":7,"TransactionID":"%s"}' % TX
    assert text[4] == '{"id":"%s","from":"%s","to":"%s"}' % (TX, NIL_UUID, NIL_UUID)
    assert text[5] == "{}" and text[6] == "{}"


def test_custom_kind_and_clash(spark):
    registry = fn.register_kind("Rated", T.StructType([T.StructField("score", T.DoubleType())]))
    df = spark.createDataFrame([("Rated", '{"score":1.5}')], "kind string, body string")
    assert fn.decode_body(df, registry).first()["score"] == 1.5
    with pytest.raises(ValueError):
        fn.register_kind("Bad", T.StructType([T.StructField("money", T.StringType())]))


def test_strict_kinds_raise(spark):
    df = spark.createDataFrame([("Mystery", "Account")], "kind string, aggregate_kind string")
    assert filters.unknown_kinds(df).count() == 1
    with pytest.raises(Exception, match="unknown event 'Mystery' for 'Account'"):
        filters.strict_kinds(df).collect()


def test_folds_of_the_two_models(spark):
    df = story(spark)
    write = folds.fold_account_state(df)
    assert sorted(rows(write)) == [("a", "Anna", 80, "OPEN"), ("b", "Bob", 0, "OPEN")]
    read = folds.fold_balance_projection(df)
    assert sorted((r["id"], r["sequence"], r["balance"], r["owner"]) for r in read.collect()) == [
        ("a", 4, 80, "Ann"),
        ("b", 2, 0, "Bob"),
    ]
    assert rows(joins.reconcile(write, read)) == [("a", "Anna", 80, "Ann", 80)]
    assert [r["aggregate_id"] for r in joins.unknown_account(df, write).collect()] == ["x"]
    assert rows(folds.max_sequence(read.where("false"))) == [("CatchUp", 0)]


@pytest.mark.parametrize("width", [1, 7, 64, 1 << 20])
def test_running_values_of_a_busy_key(spark, width):
    """A third and more of the rows share one key; ranges do not change the result."""
    rng = random.Random(width)
    data = []
    for seq in rng.sample(range(-500, 1500), 600):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randint(0, 20)}"
        note = f"n{seq}" if rng.random() < 0.1 else None
        data.append((key, seq, rng.randint(-5, 9), note))
    df = spark.createDataFrame(data, "key string, seq long, v long, note string")
    got = scans.running(
        df,
        "key",
        "seq",
        [
            scans.Running("total", F.col("v")),
            scans.Running("noted", F.col("note"), "last"),
            scans.Running("before", F.col("v"), "lag"),
        ],
        width,
    ).toPandas()
    want = pd.DataFrame(data, columns=["key", "seq", "v", "note"]).sort_values(["key", "seq"])
    want["total"] = want.groupby("key")["v"].cumsum()
    want["noted"] = want.groupby("key")["note"].ffill()
    want["before"] = want.groupby("key")["v"].shift()
    got = got.sort_values(["key", "seq"]).reset_index(drop=True)[list(want.columns)]
    pd.testing.assert_frame_equal(
        got.astype(object).where(got.notna(), None),
        want.reset_index(drop=True).astype(object).where(want.notna().reset_index(drop=True), None),
        check_dtype=False,
    )


def test_versions_continue_after_stored_ones(spark):
    df = spark.createDataFrame([("a", 10), ("a", 30), ("b", 20)], "aggregate_id string, seq long")
    stored = spark.createDataFrame([("a", 4), ("z", 9)], "aggregate_id string, last_version long")
    got = scans.assign_versions(df, stored, width=8)
    assert sorted(rows(got.select("aggregate_id", "seq", "aggregate_version"))) == [
        ("a", 10, 5),
        ("a", 30, 6),
        ("b", 20, 1),
    ]


def test_snapshot_plus_tail_equals_full_fold(spark):
    rng = random.Random(7)
    events = [(i, f"k{i}", "AccountCreated", f"o{i}") for i in range(4)]
    for seq in range(10, 400):
        key = "k0" if rng.random() < 0.6 else f"k{rng.randint(0, 4)}"
        kind = rng.choice(["MoneyDeposited", "MoneyWithdrawn", "OwnerUpdated"])
        events.append((seq, key, kind, f"w{seq}" if kind == "OwnerUpdated" else rng.randint(0, 9)))
    df = log(spark, events).fillna({"money": 0})
    snapshots = folds.snapshot_states(df, every=7, width=50)
    want = sorted(rows(folds.fold_account_state(df)))
    for width in (1, 50, 1 << 20):
        assert sorted(rows(folds.fold_from_snapshot(df, snapshots, width))) == want
    assert joins.money_events(folds.join_snapshot_tail(df, snapshots)).count() < df.count() / 3


def test_transaction_state_and_first_terminal(spark):
    schema = (
        "seq long, aggregate_id string, tx_id string, kind string, money long, "
        "from_id string, to_id string, reason string"
    )
    df = spark.createDataFrame(
        [
            (1, "t1", "t1", "TransactionCreated", 5, "a", None, None),
            (2, "t1", "t1", "TransactionFailed", None, None, None, "late"),
            (3, "t1", "t1", "TransactionSucceeded", None, None, None, None),
            (4, "t2", "t2", "TransactionCreated", 6, None, "b", None),
        ],
        schema,
    )
    state = folds.fold_transaction_state(df)
    assert sorted(rows(state.select("id", "status", "failure_reason"))) == [
        ("t1", "SUCCEEDED", ""),
        ("t2", "PENDING", ""),
    ]
    assert rows(filters.first_terminal(df)) == [("t1", 2, "TransactionFailed")]


def test_marks_global_and_per_partition(spark):
    df = spark.createDataFrame([("p1", 5), ("p1", 9), ("p2", 3)], "topic string, seq long")
    marks = spark.createDataFrame([("p1", 5), ("p2", 1)], "topic string, mark long")
    assert sorted(rows(filters.above_mark(df, marks, ["topic"]))) == [("p1", 9), ("p2", 3)]
    assert rows(filters.above_mark(df, marks)) == [("p1", 9)]
    assert filters.above_mark(df, marks.where("false")).count() == 3


def test_idempotency_keys(spark):
    df = spark.createDataFrame(
        [(1, "k1"), (2, "k1"), (3, "k2"), (4, ""), (5, ""), (6, None)],
        "seq long, idempotency_key string",
    )
    stored = df.where("seq = 3")
    assert sorted(r["seq"] for r in joins.new_keys(df, stored).collect()) == [1, 4, 5, 6]
    assert rows(checks.duplicate_keys(df)) == [("k1", 2)]


def test_lookup_spreads_missing_keys(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, "q")], "seq long, k string")
    dim = spark.createDataFrame([("a", "OPEN")], "id string, status string")
    assert sorted(rows(joins.lookup(df, "k", "seq", dim, "id"))) == [
        (1, None, None),
        (2, "a", "OPEN"),
        (3, "q", None),
    ]


DOC = "id string, version long, sequence long, kind string, status string, balance long, owner string"


def test_partial_update_to_zero(spark):
    current = spark.createDataFrame([("a", 1, 1, "CatchUp", "OPEN", 50, "Ann")], DOC)
    partial = spark.createDataFrame([("a", 9, 0)], "id string, sequence long, balance long")
    kept = sinks.update_balance_partial(current, partial).first()
    assert (kept["balance"], kept["sequence"], kept["owner"]) == (0, 9, "Ann")
    dropped = sinks.update_balance_partial(current, partial, drop_zero=True).first()
    assert dropped["balance"] == 50


def test_full_index_keeps_highest_sequence(spark):
    old = spark.createDataFrame([("a", 1, 9, "CatchUp", "OPEN", 50, "Ann")], DOC)
    new = spark.createDataFrame([("a", 1, 4, "CatchUp", "OPEN", 0, "Ann")], DOC)
    assert sinks.index_balance_full(old, new).first()["balance"] == 50


def test_checks(spark):
    versions = spark.createDataFrame(
        [("a", 1), ("a", 2), ("a", 2), ("a", 5), ("b", 2)], "aggregate_id string, aggregate_version long"
    )
    assert rows(checks.duplicate_versions(versions)) == [("a", 2, 2)]
    gaps = checks.version_gaps(versions, width=2)
    assert rows(gaps.select("aggregate_id", "previous_version", "aggregate_version")) == [("a", 2, 5)]
    ids = spark.createDataFrame([("s1",)], "id string")
    assert checks.orphan_snapshots(ids, ids.where("false")).count() == 1


def test_search_hits_keep_large_numbers_and_kind(spark):
    big = 2**53 + 1
    text = (
        '{"hits":{"hits":[{"_id":"a","_version":3,"_source":{"sequence":%d,"kind":"CatchUp",'
        '"owner":"Ann"}}]}}' % big
    )
    row = views.search_hits(spark.createDataFrame([(text,)], "response string")).first()
    assert (row["sequence"], row["kind"], row["owner"], row["balance"]) == (big, "CatchUp", "Ann", 0)


def test_commands_from_json(spark):
    path = shared_dir(spark, "test")
    lines = [
        '{"from":"","to":"%s","money":5}' % TX,
        '{"to":"%s"}' % NIL_UUID,
        '{"from":"zzz"}',
        "broken",
    ]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    got = rows(files.read_transfer_commands(spark, path))
    assert got == [
        (None, TX, 5, True),
        (None, None, 0, True),
        ("zzz", None, 0, False),
        (None, None, 0, False),
    ]


def test_token_round_trip(spark):
    df = spark.createDataFrame([("accounts.1", 7), ("accounts.1", 9)], "topic string, seq long")
    token = sinks.resume_tokens(df, "balance")
    assert rows(token) == [(sinks.resume_key("accounts.1", "balance"), "CatchUp:9")]
    kind, sequence = sinks.parse_token(F.col("token"))
    assert rows(token.select(kind, sequence)) == [("CatchUp", 9)]


def test_custom_fold(spark):
    got = folds.fold_custom(
        story(spark),
        "aggregate_id",
        sums={"net": {"MoneyDeposited": F.col("money"), "MoneyWithdrawn": -F.col("money")}},
        latest={"name": {"AccountCreated": F.col("owner"), "OwnerUpdated": F.col("owner")}},
    )
    assert sorted(rows(got)) == [("a", 80, "Anna"), ("b", 0, "Bob"), ("x", 5, None)]


def test_ids_of_large_and_negative_keys_differ(spark):
    keys = [0, 7, 2**48, 2**48 + 1, 2**52, 2**63 - 1, -1, -2]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    for make in (fn.account_uuid, fn.transaction_uuid):
        ids = [r[0] for r in rows.select(make("k")).collect()]
        assert len(set(ids)) == len(keys) and all(len(i) == 36 for i in ids)
        assert rows.where(ids_module.is_canonical_uuid(make("k"))).count() == len(keys)


def test_openings_precede_commands_for_any_key(spark):
    big = spark.createDataFrame([(0, "a"), (10**9, "b"), (10**15, "c")], "c_custkey long, c_name string")
    found = [r.seq for r in canonical.account_openings(big).collect()]
    assert all(s < 0 for s in found) and len(set(found)) == 3


def table_files(path):
    return {str(f.relative_to(path)) for f in path.glob("rows/bucket=*/*.parquet")}


def test_changes_rewrite_the_buckets_they_fall_into(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}/p", f"CatchUp:{i}") for i in range(200)], "id string, token string")
    table = sinks.BucketedTable(spark, str(tmp_path), rows.schema, "id", buckets=16).create()
    sinks.store_tokens(table, rows)
    before = table_files(tmp_path)
    changes = spark.createDataFrame([("k5/p", "CatchUp:900"), ("k6/p", "CatchUp:1"), ("new/p", "CatchUp:7")], rows.schema)
    touched = {f"rows/bucket={r[0]}" for r in changes.select(table.bucket()).collect()}
    sinks.store_tokens(table, changes)
    after = table_files(tmp_path)
    kept = {f for f in before if f.rsplit("/", 1)[0] not in touched}
    assert kept and kept <= after and not (before - kept) & after
    keys = spark.createDataFrame([("k5/p",), ("k6/p",), ("new/p",), ("none/p",)], "id string")
    found = {r.id: r.token for r in sinks.resume_token(table, keys).collect()}
    assert found == {"k5/p": "CatchUp:900", "k6/p": "CatchUp:6", "new/p": "CatchUp:7", "none/p": ""}
    assert table.read().count() == 201


def test_new_rows_are_appended(spark, tmp_path):
    rows = spark.createDataFrame([(f"t{i % 50}", i) for i in range(100)], "tx_id string, seq long")
    table = sinks.BucketedTable(spark, str(tmp_path), rows.schema, "tx_id", buckets=4).create()
    assert {r.inserted for r in sinks.store_new(table, rows.where("seq < 30")).collect()} == {True}
    before = table_files(tmp_path)
    found = {r.tx_id: r.inserted for r in sinks.store_new(table, rows).collect()}
    assert found == {f"t{i}": i >= 30 for i in range(50)} and before < table_files(tmp_path)
    assert {r.tx_id: r.seq for r in table.read().collect()} == {f"t{i}": i for i in range(50)}


def test_two_writers_of_a_bucket(spark, tmp_path):
    """The second one fails while the first is at it, and neither change is lost."""
    rows = spark.createDataFrame([("a/p", "CatchUp:1")], "id string, token string")
    table = sinks.BucketedTable(spark, str(tmp_path), rows.schema, "id", buckets=4).create()
    sinks.store_tokens(table, rows)
    later = spark.createDataFrame([("a/p", "CatchUp:5")], rows.schema)

    def merge(known, new):
        with pytest.raises(sinks.ConcurrentWrite):
            sinks.store_tokens(table, spark.createDataFrame([("a/p", "CatchUp:9")], rows.schema))
        return new

    table.change(later, merge)
    assert [tuple(r) for r in table.read().collect()] == [("a/p", "CatchUp:5")]
    sinks.store_tokens(table, spark.createDataFrame([("a/p", "CatchUp:9")], rows.schema))
    assert [tuple(r) for r in table.read().collect()] == [("a/p", "CatchUp:9")]


def test_changes_of_unknown_ids_are_returned(spark, tmp_path):
    docs = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "id string, sequence long, balance long")
    table = sinks.BucketedTable(spark, str(tmp_path), docs.schema, "id", buckets=4).create()
    sinks.store_documents(table, docs)
    changes = spark.createDataFrame([("a", 15), ("x", 5)], "id string, balance long")
    assert [r.id for r in sinks.store_changes(table, changes).collect()] == ["x"]
    assert sorted(tuple(r) for r in table.read().collect()) == [("a", 1, 15), ("b", 2, 20)]


def test_first_append_leaves_out_repeated_keys(spark, sf_dir):
    """Every seventh row delivered twice, nothing stored yet."""
    raw = canonical.redelivered(canonical.raw_log(spark, sf_dir))
    got = sinks.append_events(raw, None, f"{shared_dir(spark, 'test')}/append")
    keyed = got.where("idempotency_key > ''")
    assert keyed.count() == keyed.select("idempotency_key").distinct().count() > 0


def test_ordered_fold_of_keys_over_many_batches(spark):
    """Batches of a few rows cut through keys; the state goes on from batch to batch."""
    rng = random.Random(2)
    data = [(i, rng.choice(["hot", "hot", "a", "b", "c"]), rng.randint(-9, 8)) for i in range(500)]
    want = {}
    for _, k, amount in data:
        state = want.setdefault(k, [0, 0])
        if amount < 0 and state[0] + amount < 0:
            state[1] += 1
        else:
            state[0] += amount
    df = spark.createDataFrame(data, "seq long, k string, amount long").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = folds.fold_ordered(df, "k", covered_balance, "balance long, refused long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.k: [r.balance, r.refused] for r in got} == want
    assert folds.fold_ordered(df.limit(0), "k", covered_balance, "balance long, refused long").count() == 0


def test_history_that_meets_no_key_is_left_out(spark):
    """A batch of 500 keys against 20,000 stored ones: what passes does not grow with these."""
    stored = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("idempotency_key"))
    batch = spark.range(19_800, 20_300).select(
        F.col("id").alias("seq"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("idempotency_key")
    )
    met = bloom.only_met(stored, batch, "idempotency_key")
    assert 200 <= met.count() < 200 + 20_000 * 0.03
    assert bloom.only_met(stored, batch, "idempotency_key", most_keys=10).count() == 20_000
    assert bloom.only_met(stored, batch.limit(0), "idempotency_key").count() == 0
    for most in (10, 1000):
        assert sorted(r.seq for r in joins.new_keys(batch, stored, most).collect()) == list(range(20_000, 20_300))


def held(value, wanted, top=True):
    """Containment of parsed JSON, by its definition."""
    if isinstance(wanted, dict):
        return isinstance(value, dict) and all(k in value and held(value[k], w, False) for k, w in wanted.items())
    if isinstance(wanted, list):
        return isinstance(value, list) and all(any(held(v, w, False) for v in value) for w in wanted)
    if top and isinstance(value, list):
        return any(held(v, wanted, False) for v in value)
    return type(value) in ((int, float) if type(wanted) in (int, float) else (type(wanted),)) and value == wanted


def test_containment_by_definition(spark):
    draw = random.Random(7)

    def drawn(depth):
        plain = [None, True, False, 1, 0, 2.5, -3, 10**19, 10**25, 1e-7, "1", "a", "", "é'\"\\"]
        kind = draw.randrange(6) if depth else 0
        if kind in (1, 2):
            return {draw.choice(["a", "b", "c d", "it's", "x.y", "z[0]"]): drawn(depth - 1) for _ in range(draw.randrange(4))}
        if kind in (3, 4):
            return [drawn(depth - 1) for _ in range(draw.randrange(4))]
        return draw.choice(plain)

    values = [drawn(3) for _ in range(400)]
    parts = [v[k] for v in values if isinstance(v, dict) for k in v]
    wanted = [drawn(2) for _ in range(12)] + [{"a": {}}, {"a": [1]}, [], {}, [[]], 1.0, {"it's": 1}, *draw.sample(parts, 6)]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string").cache()
    hits = 0
    for w in wanted:
        found = {r.i for r in rows.where(contains("j", w)).select("i").collect()}
        assert found == {i for i, v in enumerate(values) if held(v, w)}, w
        hits += len(found)
    assert hits > 200
    assert rows.select(contains(F.lit("{no json"), {}).alias("x")).distinct().collect() == [Row(x=False)]
    assert rows.select(contains(F.lit(None).cast("string"), {}).alias("x")).distinct().collect() == [Row(x=False)]
    with pytest.raises(ValueError, match="quotes"):
        contains("j", {"it's \"x\"": 1})


def test_rows_that_hold_values_in_two_columns(spark):
    rows = spark.createDataFrame(
        [(1, '{"topic":"a","tags":["x","y"]}', '{"n":1}'), (2, '{"topic":"a","tags":["x"]}', '{"n":1}'), (3, '{"topic":"a","tags":["y","x"]}', None)],
        "i int, labels string, body string",
    )
    assert [r.i for r in filters.holding(rows, labels={"tags": ["y", "x"]}, body={"n": 1}).collect()] == [1]
    assert {r.i for r in filters.holding(rows, labels={"topic": "a"}).collect()} == {1, 2, 3}
