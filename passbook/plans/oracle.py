"""The same results as plain SQL over the test tables, for comparison."""

from __future__ import annotations

# The ledger mapping, word for word as in ``sources.canonical``.
CMD = """
cmd AS (SELECT event_id, ts, user_id u, event_type et, CAST(round(value * 100) AS BIGINT) money,
  CAST(json_extract_string(props, '$.k') AS BIGINT) k FROM events),
tx AS (SELECT event_id seq, ts, money, k, et, CASE WHEN et <> 'view' THEN u END f,
  CASE et WHEN 'view' THEN u WHEN 'click' THEN k WHEN 'error' THEN -1 - k END o
  FROM cmd WHERE et IN ('view', 'purchase', 'click') OR (et = 'error' AND k < 50))"""


def acc(x: str) -> str:
    h = f"lpad(lower(hex(CAST({x} AS BIGINT))), 16, '0')"
    return f"('00000000-' || substr({h}, 1, 4) || '-4000-8000-' || substr({h}, 5))"


def txid(x: str) -> str:
    h = f"lpad(lower(hex(CAST({x} AS BIGINT))), 16, '0')"
    return f"('00000000-' || substr({h}, 1, 4) || '-4000-9000-' || substr({h}, 5))"


NIL = "'00000000-0000-0000-0000-000000000000'"


def _ev(source: str, seq: str, agg: str, agg_kind: str, kind: str, where: str = "true", **f: str) -> str:
    names = {
        "money": "BIGINT",
        "owner": "VARCHAR",
        "tx_id": "VARCHAR",
        "from_id": "VARCHAR",
        "to_id": "VARCHAR",
        "rollback": "BOOLEAN",
        "reason": "VARCHAR",
    }
    fields = ", ".join(f"CAST({f.get(n, 'NULL')} AS {t}) {n}" for n, t in names.items())
    at = "TIMESTAMP '2024-01-01 00:00:00'" if source == "customer" else "ts"
    return (
        f"SELECT {seq} seq, {agg} aggregate_id, '{agg_kind}' aggregate_kind, '{kind}' kind, "
        f"{fields}, {at} created_at FROM {source} WHERE {where}"
    )


_TX = {"tx_id": txid("seq")}
_MOVE = {"tx_id": txid("seq"), "money": "money"}
_PARTS = [
    _ev("customer", "-1 - c_custkey", acc("c_custkey"), "Account", "AccountCreated",
        money="0", owner="c_name"),
    _ev("tx", "seq * 10", txid("seq"), "Transaction", "TransactionCreated",
        money="money", tx_id=txid("seq"), from_id=acc("f"), to_id=acc("o")),
    _ev("tx", "seq * 10 + 1", acc("f"), "Account", "MoneyWithdrawn", "f IS NOT NULL", **_MOVE),
    _ev("tx", "seq * 10 + 2", acc("o"), "Account", "MoneyDeposited", "o IS NOT NULL", **_MOVE),
    _ev("tx", "seq * 10 + 3", txid("seq"), "Transaction", "TransactionSucceeded", "et <> 'error'", **_TX),
    _ev("tx", "seq * 10 + 3", txid("seq"), "Transaction", "TransactionFailed", "et = 'error'",
        tx_id=txid("seq"), rollback="k % 2 = 0", reason="'To account: unknown'"),
    _ev("tx", "seq * 10 + 4", txid("seq"), "Transaction", "TransactionSucceeded",
        "et = 'error' AND k % 10 = 3", **_TX),
    _ev("tx", "seq * 10 + 4", txid("seq"), "Transaction", "TransactionFailed",
        "et <> 'error' AND k % 10 = 3", tx_id=txid("seq"), rollback="false", reason="'late'"),
    _ev("cmd", "event_id * 10", acc("u"), "Account", "OwnerUpdated", "et = 'signup'",
        owner="'Customer#' || lpad(CAST(u AS VARCHAR), 9, '0') || '/' || event_id"),
    _ev("cmd", "event_id * 10", acc("u"), "Account", "LimitRaised", "et = 'error' AND k >= 50",
        money="k"),
]
EV = CMD + ",\nev AS (" + "\nUNION ALL ".join(_PARTS) + ")"

ACCOUNT_KINDS = "('AccountCreated', 'MoneyWithdrawn', 'MoneyDeposited', 'OwnerUpdated')"
PROJECTED = "('AccountCreated', 'MoneyWithdrawn', 'MoneyDeposited')"
MONEY = "('MoneyWithdrawn', 'MoneyDeposited')"
SIGNED = (
    "CASE WHEN kind IN ('AccountCreated', 'MoneyDeposited') THEN money "
    "WHEN kind = 'MoneyWithdrawn' THEN -money ELSE 0 END"
)


def _field(name: str, value: str, zero: str | None, text: bool = True) -> str:
    """One JSON field with its trailing comma, or nothing when it holds the zero value."""
    shown = f"'\"{name}\":\"' || {value} || '\",'" if text else f"'\"{name}\":' || {value} || ','"
    if zero is None:
        return shown
    return f"CASE WHEN coalesce({value}, {zero}) = {zero} THEN '' ELSE {shown} END"


def _body(*fields: str) -> str:
    return "'{' || rtrim(" + " || ".join(fields) + ", ',') || '}'"


_ID = _field("id", "aggregate_id", None)
_MONEY = _field("money", "money", "0", text=False)
_OWNER = _field("owner", "owner", "''")
_TXREF = _field("TransactionID", f"coalesce(tx_id, {NIL})", None)
_FROM = _field("from", f"coalesce(from_id, {NIL})", None)
_TO = _field("to", f"coalesce(to_id, {NIL})", None)
_ROLLBACK = "CASE WHEN rollback THEN '\"rollback\":true,' ELSE '' END"
_REASON = _field("reason", "reason", "''")

BODY = f"""CASE kind WHEN 'AccountCreated' THEN {_body(_ID, _MONEY, _OWNER)}
  WHEN 'MoneyWithdrawn' THEN {_body(_MONEY, _TXREF)}
  WHEN 'MoneyDeposited' THEN {_body(_MONEY, _TXREF)}
  WHEN 'OwnerUpdated' THEN {_body(_OWNER)}
  WHEN 'TransactionCreated' THEN {_body(_ID, _MONEY, _FROM, _TO)}
  WHEN 'TransactionFailed' THEN {_body(_ROLLBACK, _REASON)}
  ELSE '{{}}' END"""
# The same with the fields of each body in key order.
SORTED_BODY = f"""CASE kind WHEN 'AccountCreated' THEN {_body(_ID, _MONEY, _OWNER)}
  WHEN 'MoneyWithdrawn' THEN {_body(_TXREF, _MONEY)}
  WHEN 'MoneyDeposited' THEN {_body(_TXREF, _MONEY)}
  WHEN 'OwnerUpdated' THEN {_body(_OWNER)}
  WHEN 'TransactionCreated' THEN {_body(_FROM, _ID, _MONEY, _TO)}
  WHEN 'TransactionFailed' THEN {_body(_REASON, _ROLLBACK)}
  ELSE '{{}}' END"""
KEY = (
    "CASE kind WHEN 'MoneyWithdrawn' THEN tx_id || '/withdraw' "
    "WHEN 'MoneyDeposited' THEN tx_id || '/deposit' ELSE '' END"
)
TWICE = "(SELECT * FROM {0} UNION ALL SELECT * FROM {0} WHERE seq % 7 = 0)"


def on_log(select: str, extra: str = "") -> str:
    return f"WITH {EV}{',' + extra if extra else ''}\n{select}"


ACC = f"""
acct AS (SELECT aggregate_id id, arg_max(owner, seq) FILTER (owner IS NOT NULL) AS owner,
  CAST(sum({SIGNED}) AS BIGINT) balance, 'OPEN' status
  FROM ev WHERE kind IN {ACCOUNT_KINDS} GROUP BY 1 HAVING count(*) FILTER (kind = 'AccountCreated') > 0)"""
BAL = f"""
bal AS (SELECT aggregate_id id, count(*) AS version, max(seq) AS sequence, 'CatchUp' kind,
  'OPEN' status, CAST(sum({SIGNED}) AS BIGINT) balance, max(owner) AS owner
  FROM ev WHERE kind IN {PROJECTED} GROUP BY 1 HAVING count(*) FILTER (kind = 'AccountCreated') > 0)"""
TXS = """
txs AS (SELECT c.aggregate_id id, c.money, c.from_id, c.to_id,
  CASE e.kind WHEN 'TransactionFailed' THEN 'FAILED' WHEN 'TransactionSucceeded' THEN 'SUCCEEDED'
    ELSE 'PENDING' END status,
  CASE WHEN e.kind = 'TransactionFailed' THEN e.reason ELSE '' END failure_reason
  FROM ev c LEFT JOIN (SELECT aggregate_id, arg_max(kind, seq) AS kind,
      arg_max(coalesce(reason, ''), seq) AS reason FROM ev
      WHERE kind IN ('TransactionFailed', 'TransactionSucceeded') GROUP BY 1) e
    ON c.aggregate_id = e.aggregate_id
  WHERE c.kind = 'TransactionCreated')"""
HIST = f"""
hist AS (SELECT seq, aggregate_id, kind, money,
  row_number() OVER w AS aggregate_version,
  CAST(sum({SIGNED}) OVER w AS BIGINT) AS balance,
  last_value(owner IGNORE NULLS) OVER w AS owner,
  count(*) FILTER (kind = 'AccountCreated') OVER w AS created
  FROM ev WHERE kind IN {ACCOUNT_KINDS}
  WINDOW w AS (PARTITION BY aggregate_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
SNAP = HIST + """,
snap AS (SELECT aggregate_id, seq, aggregate_version, balance, owner FROM hist
  WHERE aggregate_version % 50 = 0 AND created > 0)"""

MIXED = "CASE WHEN {0} % 37 = 5 THEN 'FROZEN' WHEN {0} % 41 = 7 THEN 'CLOSED' ELSE 'OPEN' END"

# One transfer after the other, carrying the balances of all accounts as a list.
SETTLED = f"""WITH RECURSIVE {CMD},
t AS (SELECT row_number() OVER (ORDER BY seq) i, seq, money, f, o,
  {MIXED.format('f')} fs,
  CASE WHEN o < 0 THEN 'UNKNOWN' ELSE {MIXED.format('o')} END os FROM tx),
n AS (SELECT max(greatest(coalesce(f, 0), CASE WHEN o >= 0 THEN o ELSE 0 END)) + 1 m FROM t),
r(i, seq, st, b) AS (
  SELECT 0::BIGINT, NULL::BIGINT, NULL::VARCHAR,
    list_transform(range(m), lambda x: 0::BIGINT) FROM n
  UNION ALL
  SELECT t.i, t.seq, c.st,
    CASE WHEN c.st = 'OK' THEN list_transform(r.b, lambda x, ix:
           x - CASE WHEN ix = t.f + 1 THEN t.money ELSE 0 END
             + CASE WHEN ix = t.o + 1 THEN t.money ELSE 0 END)
         WHEN c.st = 'PENDING' THEN list_transform(r.b, lambda x, ix:
           x - CASE WHEN ix = t.f + 1 THEN t.money ELSE 0 END)
         ELSE r.b END
  FROM r JOIN t ON t.i = r.i + 1, LATERAL (SELECT CASE
    WHEN t.f IS NOT NULL AND t.fs <> 'OPEN' THEN 'F:from'
    WHEN t.f IS NOT NULL AND r.b[t.f + 1] < t.money THEN 'F:funds'
    WHEN t.o IS NOT NULL AND t.os = 'UNKNOWN' THEN 'PENDING'
    WHEN t.o IS NOT NULL AND t.os <> 'OPEN' THEN 'F:to'
    ELSE 'OK' END st) c),
res AS (SELECT t.seq, t.f AS from_id, t.o AS to_id, t.money,
  CASE WHEN st = 'OK' THEN 'SUCCEEDED' WHEN st = 'PENDING' THEN 'PENDING' ELSE 'FAILED' END status,
  CASE st WHEN 'F:from' THEN 'From account: Status: ' || fs || ': transactions disabled'
    WHEN 'F:funds' THEN 'From account: not enough funds'
    WHEN 'F:to' THEN 'To account: Status: ' || os || ': transactions disabled' ELSE '' END reason,
  st = 'F:to' AND f IS NOT NULL AS rollback,
  st IN ('OK', 'PENDING', 'F:to') AND f IS NOT NULL AS withdrawn,
  st = 'OK' AND o IS NOT NULL AS deposited,
  st = 'F:to' AND f IS NOT NULL AS refunded
  FROM r JOIN t USING (seq) WHERE r.i > 0)
"""
_FAILED_SEQ = "seq * 10 + CASE WHEN reason LIKE 'From%' THEN 1 ELSE 2 END"

_FOLD_FROM = "SELECT * FROM bal"
_STREAM_BAL = on_log(_FOLD_FROM, BAL)

PUBLISHED = """SELECT aggregate_id, count(*) AS events, min(seq) AS first_seq, max(seq) AS last_seq,
    CAST(1 AS BIGINT) AS partitions, true AS ordered, true AS dense FROM ev GROUP BY 1"""

ORACLE: dict[str, str] = {
    "scan_event_log": on_log(
        f"""SELECT seq, 'ev-' || seq AS id, aggregate_id,
        row_number() OVER (PARTITION BY aggregate_id ORDER BY seq) AS aggregate_version,
        aggregate_kind, kind, {BODY} AS body, {KEY} AS idempotency_key,
        '{{"topic":"' || lower(aggregate_kind) || '"}}' AS labels,
        strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at FROM ev"""
    ),
    "tail_event_log": on_log(f"SELECT seq, aggregate_id, kind, {BODY} AS body FROM ev"),
    "subscribe_topic": on_log(
        "SELECT seq, 'account.1' AS topic, kind FROM ev WHERE aggregate_kind = 'Account'"
    ),
    "read_account_commands": """SELECT CASE WHEN c_custkey % 50 <> 0 THEN c_name END AS owner,
        c_custkey % 50 = 0 AS malformed FROM customer""",
    "read_transfer_commands": f"""WITH {CMD}
        SELECT {acc('f')} AS from_id,
          CASE WHEN seq % 50 = 0 THEN 'not-an-id' ELSE {acc('o')} END AS to_id,
          money, seq % 50 <> 0 AS valid FROM tx""",
    "scan_balances": _STREAM_BAL,
    "append_events": on_log(
        f"""SELECT seq, aggregate_id, kind, row_number() OVER (PARTITION BY aggregate_id
          ORDER BY kind = 'MoneyWithdrawn', seq) AS aggregate_version
        FROM ev"""
    ),
    "create_if_new": f"WITH {CMD} SELECT {txid('seq')} AS tx_id, seq, money FROM tx WHERE f IS NOT NULL",
    "publish_partitioned": on_log(
        PUBLISHED
    ),
    "stream_forward": on_log(
        PUBLISHED
    ),
    "row_to_json_notify": on_log(
        f"""SELECT '{{"seq":' || seq || ',"aggregate_id":"' || aggregate_id || '","kind":"' || kind ||
        '","body":' || {SORTED_BODY} || ',"labels":{{"topic":"' || lower(aggregate_kind) || '"}}}}'
        AS notification FROM ev"""
    ),
    "index_balance_full": _STREAM_BAL,
    "update_balance_partial": on_log(
        "SELECT id, CAST(1 AS BIGINT) AS version, sequence, kind, status, balance, owner FROM bal", BAL
    ),
    "upsert_resume_token": on_log(
        f"""SELECT 'accounts.1/balance' AS id, 'CatchUp:' || max(seq) AS token FROM ev
        WHERE kind IN {PROJECTED}"""
    ),
    "store_transactions": f"WITH {CMD} SELECT {txid('seq')} AS tx_id, f IS NOT NULL AS inserted FROM tx",
    "store_balances": _STREAM_BAL,
    "store_resume_tokens": on_log(
        """SELECT lower(aggregate_kind) || '.1/balance' AS id, 'CatchUp:' || max(seq) AS token
        FROM ev GROUP BY 1 UNION ALL SELECT 'other.1/balance', ''"""
    ),
    "write_snapshots": on_log("SELECT *, 'ev-' || seq AS id FROM snap", SNAP),
    "filter_aggregate_kind": on_log(
        "SELECT seq, aggregate_id, kind FROM ev WHERE aggregate_kind = 'Account'"
    ),
    "filter_event_kind": on_log(
        "SELECT seq, tx_id, kind FROM ev WHERE kind IN ('TransactionCreated', 'TransactionFailed')"
    ),
    "filter_high_water_mark": on_log(
        f"SELECT seq, kind FROM {TWICE.format('ev')} WHERE seq > (SELECT max(seq) // 2 FROM ev)"
    ),
    "filter_rollback_needed": on_log(
        "SELECT seq, tx_id, reason FROM ev WHERE kind = 'TransactionFailed' AND rollback"
    ),
    "filter_optional_leg": on_log(
        """SELECT seq, from_id, to_id, money, 'from' AS side FROM ev
        WHERE kind = 'TransactionCreated' AND from_id IS NOT NULL
        UNION ALL SELECT seq, from_id, to_id, money, 'to' FROM ev
        WHERE kind = 'TransactionCreated' AND to_id IS NOT NULL"""
    ),
    "route_unknown_kinds": on_log(
        "SELECT seq, aggregate_id, kind FROM ev WHERE kind = 'LimitRaised'"
    ),
    "filter_pending_only": on_log(
        """SELECT tx_id, min(seq) AS seq, arg_min(kind, seq) AS kind FROM ev
        WHERE kind IN ('TransactionFailed', 'TransactionSucceeded') GROUP BY 1"""
    ),
    "filter_open_accounts": f"""WITH {CMD}, s AS (SELECT seq, f AS from_id, {MIXED.format('f')} AS status
        FROM tx WHERE f IS NOT NULL)
        SELECT seq, from_id, status, CASE WHEN status <> 'OPEN' THEN
        'From account: Status: ' || status || ': transactions disabled' END AS reason FROM s""",
    "filter_sufficient_funds": SETTLED
    + "SELECT seq, from_id AS account_id, money FROM res WHERE withdrawn",
    "filter_by_label": on_log(
        "SELECT 'ev-' || seq AS id, kind FROM ev WHERE aggregate_kind = 'Transaction'"
    ),
    "filter_by_containment": on_log(
        f"""SELECT 'ev-' || seq AS id, kind FROM ev WHERE aggregate_kind = 'Transaction'
        AND json_contains(CAST({BODY} AS JSON), '{{"from":"' || {NIL} || '"}}')"""
    ),
    "project_account_view": on_log("SELECT owner, balance, status FROM acct", ACC),
    "project_search_hits": _STREAM_BAL,
    "project_transaction_view": on_log(
        "SELECT id AS tx_id, money, from_id, to_id, status, failure_reason FROM txs", TXS
    ),
    "project_saga_legs": f"""WITH {CMD}
        SELECT {txid('seq')} AS tx_id, money, 0 AS leg, {acc('f')} AS account_id FROM tx WHERE f IS NOT NULL
        UNION ALL SELECT {txid('seq')}, money, 1, {acc('o')} FROM tx WHERE o IS NOT NULL""",
    "join_event_to_balance": on_log(
        f"""SELECT e.seq, e.aggregate_id, e.kind, e.money, b.owner, b.balance AS final_balance
        FROM ev e LEFT JOIN bal b ON e.aggregate_id = b.id WHERE e.kind IN {MONEY}""",
        BAL,
    ),
    "anti_unknown_account": on_log(
        f"""SELECT seq, aggregate_id, kind, money FROM ev WHERE kind IN {MONEY} AND aggregate_id NOT IN
        (SELECT aggregate_id FROM ev WHERE kind = 'AccountCreated')"""
    ),
    "join_failed_to_transaction": on_log(
        """SELECT e.seq, e.tx_id, e.rollback, e.reason, t.money, t.from_id, t.to_id
        FROM ev e JOIN txs t ON e.tx_id = t.id WHERE e.kind = 'TransactionFailed'""",
        TXS,
    ),
    "join_withdraw_leg": on_log(
        """SELECT t.id, t.from_id, t.money, a.owner, a.status FROM txs t
        LEFT JOIN acct a ON t.from_id = a.id WHERE t.from_id IS NOT NULL""",
        TXS + "," + ACC,
    ),
    "join_deposit_leg": on_log(
        """SELECT t.id, t.to_id, t.money, a.owner, a.status FROM txs t
        LEFT JOIN acct a ON t.to_id = a.id WHERE t.to_id IS NOT NULL""",
        TXS + "," + ACC,
    ),
    "anti_idempotency_key": on_log(
        f"""SELECT seq, kind, idempotency_key FROM
          (SELECT seq, kind, {KEY} AS idempotency_key FROM ev WHERE kind = 'MoneyDeposited')
        UNION ALL SELECT seq, kind, '' FROM {TWICE.format('ev')} WHERE kind NOT IN {MONEY}"""
    ),
    "semi_account_exists": f"""WITH {CMD}
        SELECT seq * 10 AS seq, {acc('o')} AS to_id, o IN (SELECT c_custkey FROM customer) AS found
        FROM tx WHERE o IS NOT NULL""",
    "reconcile_write_vs_read": on_log(
        """SELECT a.id, a.owner AS write_owner, a.balance AS write_balance, b.owner AS read_owner,
        b.balance AS read_balance FROM acct a FULL JOIN bal b ON a.id = b.id
        WHERE a.owner IS DISTINCT FROM b.owner OR a.balance IS DISTINCT FROM b.balance""",
        ACC + "," + BAL,
    ),
    "join_events_to_transaction": on_log(
        f"""SELECT e.seq, e.tx_id, e.kind, e.money, t.money AS tx_money, t.from_id, t.to_id
        FROM ev e LEFT JOIN ev t ON e.tx_id = t.aggregate_id AND t.kind = 'TransactionCreated'
        WHERE e.kind IN {MONEY}"""
    ),
    "join_snapshot_tail": on_log(
        """SELECT h.seq, h.aggregate_id, h.kind, s.snapshot_seq FROM hist h
        LEFT JOIN (SELECT aggregate_id, max(seq) AS snapshot_seq FROM snap GROUP BY 1) s
        ON h.aggregate_id = s.aggregate_id WHERE s.snapshot_seq IS NULL OR h.seq > s.snapshot_seq""",
        SNAP,
    ),
    "sum_deposits": on_log(
        """SELECT aggregate_id, CAST(sum(money) AS BIGINT) AS deposited, count(*) AS events FROM ev
        WHERE kind = 'MoneyDeposited' GROUP BY 1"""
    ),
    "sum_withdrawals": on_log(
        """SELECT aggregate_id, CAST(sum(money) AS BIGINT) AS withdrawn, count(*) AS events FROM ev
        WHERE kind = 'MoneyWithdrawn' GROUP BY 1"""
    ),
    "max_sequence": on_log("SELECT 'CatchUp' AS kind, coalesce(max(sequence), 0) AS sequence FROM bal", BAL),
    "aggregate_version": on_log(
        f"""SELECT aggregate_id, count(*) AS last_version FROM ev
        WHERE kind IN {ACCOUNT_KINDS} GROUP BY 1"""
    ),
    "snapshot_states": on_log("SELECT * FROM snap", SNAP),
    "fold_from_snapshot": on_log("SELECT * FROM acct", ACC),
    "fold_from_snapshots": on_log("SELECT * FROM acct", ACC),
    "fold_ordered": on_log(
        f"""SELECT aggregate_id, final AS balance, CAST(moves - taken AS BIGINT) AS refused FROM (
          SELECT aggregate_id, count(*) AS moves,
            list_prepend(0::BIGINT, list({SIGNED} ORDER BY seq)) AS l,
            list_reduce(l, lambda a, x: CASE WHEN x < 0 AND a + x < 0 THEN a ELSE a + x END)::BIGINT AS final,
            list_reduce(list_prepend(0::HUGEINT, list(({SIGNED})::HUGEINT ORDER BY seq)), lambda a, x:
              CASE WHEN x < 0 AND a // 1000000 + x < 0 THEN a ELSE a + x * 1000000 + 1 END) % 1000000 AS taken
          FROM ev WHERE kind IN {MONEY} GROUP BY 1)"""
    ),
    "fold_account_state": on_log("SELECT * FROM acct", ACC),
    "fold_transaction_state": on_log("SELECT * FROM txs", TXS),
    "fold_balance_projection": _STREAM_BAL,
    "check_version_unique": on_log(
        "SELECT aggregate_id, aggregate_version, CAST(2 AS BIGINT) AS copies FROM hist WHERE seq % 7 = 0",
        HIST,
    ),
    "check_idempotency_unique": on_log(
        f"""SELECT idempotency_key, count(*) AS copies FROM
        (SELECT {KEY} AS idempotency_key FROM {TWICE.format('ev')})
        WHERE idempotency_key > '' GROUP BY 1 HAVING count(*) > 1"""
    ),
    "count_tx_by_status": SETTLED
    + "SELECT status, reason AS failure_reason, count(*) AS transactions FROM res GROUP BY 1, 2",
    "check_snapshot_fk": on_log(
        """SELECT 'ev-' || s.seq AS id, s.aggregate_id, s.aggregate_version FROM snap s
        JOIN hist h ON s.seq = h.seq WHERE h.kind = 'MoneyWithdrawn'""",
        SNAP,
    ),
    "assign_versions": on_log("SELECT seq, aggregate_id, aggregate_version FROM hist", HIST),
    "balance_history": on_log(
        "SELECT seq, aggregate_id, aggregate_version, balance FROM hist", HIST
    ),
    "owner_history": on_log("SELECT seq, aggregate_id, owner FROM hist", HIST),
    "check_version_gaps": on_log(
        """SELECT aggregate_id, aggregate_version, previous_version FROM (SELECT aggregate_id,
          aggregate_version, lag(aggregate_version) OVER (PARTITION BY aggregate_id
          ORDER BY aggregate_version) AS previous_version FROM hist WHERE kind <> 'MoneyWithdrawn')
        WHERE aggregate_version <> previous_version + 1""",
        HIST,
    ),
    "list_by_owner": on_log("SELECT * FROM bal ORDER BY owner, id", BAL),
    "list_by_owner_page": on_log("SELECT * FROM bal ORDER BY owner, id LIMIT 10", BAL),
    "top1_by_sequence": on_log("SELECT * FROM bal ORDER BY sequence DESC LIMIT 1", BAL),
    "get_balance_by_id": on_log(
        "SELECT * FROM bal WHERE id = '00000000-0000-4000-8000-000000000007'", BAL
    ),
    "get_account_by_id": on_log(
        """SELECT owner, balance, status FROM acct
        WHERE id = '00000000-0000-4000-8000-000000000007'""",
        ACC,
    ),
    "ordered_replay": on_log(
        f"""SELECT seq, aggregate_id, kind, money, owner FROM ev WHERE kind IN {ACCOUNT_KINDS}
        AND aggregate_id = '00000000-0000-4000-8000-000000000007' ORDER BY seq"""
    ),
    "union_event_kinds": on_log(
        """SELECT seq, kind,
        CASE WHEN kind IN ('AccountCreated', 'TransactionCreated') THEN aggregate_id END AS id, money,
        owner, CASE WHEN kind IN ('MoneyWithdrawn', 'MoneyDeposited') THEN tx_id END AS "TransactionID",
        from_id AS "from", to_id AS "to", rollback, reason FROM ev WHERE kind <> 'LimitRaised'"""
    ),
    "union_history_and_live": on_log("SELECT seq, aggregate_id, kind FROM ev"),
    "quarantine_bad_ids": on_log(
        """SELECT seq, substr(aggregate_id, 2) AS aggregate_id, kind FROM ev
        WHERE trunc(seq / 10) % 50 = 0"""
    ),
    "nil_uuid_to_null": on_log(
        f"""SELECT seq, coalesce(from_id, {NIL}) AS from_id, coalesce(to_id, {NIL}) AS to_id,
        from_id AS origin, to_id AS destination FROM ev WHERE kind = 'TransactionCreated'"""
    ),
    "idempotency_key": on_log(
        """SELECT seq, tx_id || '/withdraw' AS withdraw_key, tx_id || '/deposit' AS deposit_key,
        tx_id || '/rollback' AS rollback_key FROM ev WHERE kind = 'TransactionCreated'"""
    ),
    "failure_reason": f"""WITH a AS (SELECT c_custkey AS account_id, {MIXED.format('c_custkey')} AS status
        FROM customer)
        SELECT account_id, CASE WHEN status = 'OPEN' THEN 'From account: not enough funds'
          ELSE 'From account: Status: ' || status || ': transactions disabled' END AS withdraw_reason,
        CASE WHEN status <> 'OPEN' THEN 'To account: Status: ' || status || ': transactions disabled'
          END AS deposit_reason FROM a""",
    "decode_event_body": on_log(
        """SELECT seq, kind,
        CASE WHEN kind IN ('AccountCreated', 'TransactionCreated') THEN aggregate_id END AS id, money,
        owner, CASE WHEN kind IN ('MoneyWithdrawn', 'MoneyDeposited') THEN tx_id END AS "TransactionID",
        from_id AS "from", to_id AS "to", rollback, reason FROM ev WHERE kind <> 'LimitRaised'"""
    ),
    "encode_event_body": on_log(f"SELECT seq, kind, {BODY} AS body FROM ev"),
    "signed_money": on_log(f"SELECT seq, CAST({SIGNED} AS BIGINT) AS amount FROM ev"),
    "settle_withdrawals": SETTLED
    + """SELECT seq, from_id AS account_id, money, withdrawn AS accepted,
        CASE WHEN withdrawn THEN '' ELSE reason END AS reason FROM res WHERE from_id IS NOT NULL""",
    "settle_deposits": SETTLED
    + """SELECT seq, to_id AS account_id, money, deposited AS accepted,
        CASE WHEN status = 'FAILED' THEN reason ELSE '' END AS reason
        FROM res WHERE to_id IS NOT NULL AND (withdrawn OR from_id IS NULL)""",
    "complete_transactions": SETTLED
    + f"""SELECT seq * 10 + 3 AS seq, {txid('seq')} AS aggregate_id, 'TransactionSucceeded' AS kind
        FROM res WHERE status = 'SUCCEEDED'""",
    "fail_transactions": SETTLED
    + f"""SELECT {_FAILED_SEQ} AS seq, {txid('seq')} AS aggregate_id, 'TransactionFailed' AS kind,
        rollback, reason, {txid('seq')} || CASE WHEN reason LIKE 'From%' THEN '/withdraw'
          ELSE '/deposit' END AS idempotency_key FROM res WHERE status = 'FAILED'""",
    "refund_rollbacks": SETTLED
    + f"""SELECT {acc('from_id')} AS aggregate_id, 'MoneyDeposited' AS kind, money,
        {txid('seq')} AS tx_id, {txid('seq')} || '/rollback' AS idempotency_key
        FROM res WHERE refunded AND seq % 3 <> 0""",
    "settle_transfers": SETTLED + "SELECT * FROM res",
    "settle_in_parts": SETTLED + "SELECT * FROM res",
    "stream_reactor": SETTLED + "SELECT * FROM res",
    "replay_idempotent": SETTLED + "SELECT * FROM res",
    "end_to_end_balances": SETTLED
    + f"""SELECT {acc('c_custkey')} AS id, coalesce(b[c_custkey + 1], 0) AS balance, c_name AS owner
        FROM customer, (SELECT b FROM r WHERE i = (SELECT max(i) FROM r))""",
    "stream_reactor_events": SETTLED
    + f"""SELECT {acc('c_custkey')} AS id, coalesce(b[c_custkey + 1], 0) AS balance, c_name AS owner
        FROM customer, (SELECT b FROM r WHERE i = (SELECT max(i) FROM r))""",
    "end_to_end_reconcile": SETTLED
    + f"""SELECT {acc('c_custkey')} AS id, coalesce(b[c_custkey + 1], 0) AS read_balance, false AS differs
        FROM customer, (SELECT b FROM r WHERE i = (SELECT max(i) FROM r))""",
    "end_to_end_keys": SETTLED
    + f"""SELECT {txid('seq')} || '/withdraw' AS idempotency_key,
          CASE WHEN withdrawn THEN 'MoneyWithdrawn' ELSE 'TransactionFailed' END AS kind,
          CASE WHEN withdrawn THEN {acc('from_id')} ELSE {txid('seq')} END AS aggregate_id
        FROM res WHERE from_id IS NOT NULL
        UNION ALL SELECT {txid('seq')} || '/deposit',
          CASE WHEN deposited THEN 'MoneyDeposited' ELSE 'TransactionFailed' END,
          CASE WHEN deposited THEN {acc('to_id')} ELSE {txid('seq')} END
        FROM res WHERE deposited OR (status = 'FAILED' AND (withdrawn OR from_id IS NULL))
        UNION ALL SELECT {txid('seq')} || '/rollback', 'MoneyDeposited', {acc('from_id')}
        FROM res WHERE refunded""",
    "classify_transfers": f"""WITH {CMD} SELECT seq, CASE WHEN f IS NULL THEN 'deposit'
        WHEN o IS NULL THEN 'withdraw' ELSE 'transfer' END AS type, money FROM tx""",
    "create_accounts": on_log(
        """SELECT seq, aggregate_id, kind, owner, money, CAST(1 AS BIGINT) AS aggregate_version,
        'OPEN' AS status FROM ev WHERE kind = 'AccountCreated'"""
    ),
    "update_owner": on_log(
        f"""SELECT seq, aggregate_id, owner, aggregate_version FROM (SELECT seq, aggregate_id, owner, kind,
          row_number() OVER (PARTITION BY aggregate_id ORDER BY kind = 'OwnerUpdated', seq)
          AS aggregate_version FROM ev WHERE kind IN {ACCOUNT_KINDS}) WHERE kind = 'OwnerUpdated'"""
    ),
    "stuck_transfers": SETTLED
    + "SELECT seq, from_id, to_id, money FROM res WHERE status = 'PENDING' AND withdrawn",
    "conserve_money": SETTLED
    + """, flows AS (SELECT
          CAST(coalesce(sum(money) FILTER (from_id IS NULL AND deposited), 0) AS BIGINT) AS deposited,
          CAST(coalesce(sum(money) FILTER (to_id IS NULL AND withdrawn), 0) AS BIGINT) AS withdrawn,
          CAST(coalesce(sum(money) FILTER (status = 'PENDING' AND withdrawn), 0) AS BIGINT) AS stuck
          FROM res),
        final AS (SELECT CAST(list_sum(b) AS BIGINT) AS held FROM r WHERE i = (SELECT max(i) FROM r))
        SELECT deposited, withdrawn, stuck, held, held - (deposited - withdrawn - stuck) AS difference
        FROM flows, final""",
    "decode_custom_kind": on_log(
        """SELECT seq, kind, CASE WHEN kind = 'LimitRaised' THEN money END AS "limit", owner FROM ev"""
    ),
    "fold_custom": on_log(
        f"""SELECT aggregate_id, CAST(coalesce(sum(money), 0) AS BIGINT) AS turnover,
        count(*) FILTER (kind = 'OwnerUpdated') AS renames,
        arg_max(CASE kind WHEN 'MoneyDeposited' THEN money WHEN 'MoneyWithdrawn' THEN -money END, seq)
          FILTER (kind IN {MONEY}) AS last_movement
        FROM ev WHERE kind IN ('MoneyWithdrawn', 'MoneyDeposited', 'OwnerUpdated') GROUP BY 1"""
    ),
    "stream_balance_projection": _STREAM_BAL,
    "stream_dedup_redelivery": _STREAM_BAL,
    "stream_drop_late": on_log("SELECT id, version, sequence, balance, owner FROM bal", BAL),
    "stream_resume": _STREAM_BAL,
    "stream_catch_up_then_live": _STREAM_BAL,
    "stream_rebuild": _STREAM_BAL,
    "stream_progress": on_log(
        f"""SELECT 'stateStoreSave' AS operator, CAST(1 AS BIGINT) AS last_batch,
        count(DISTINCT aggregate_id) AS state_rows FROM ev WHERE kind IN {PROJECTED}"""
    ),
    "stream_overdue_transactions": on_log(
        """SELECT aggregate_id AS id, strftime(created_at, '%Y-%m-%d %H:%M:%S.%g') AS since
        FROM ev WHERE kind = 'TransactionCreated' AND seq // 10 % 5 = 0 AND created_at + INTERVAL 1 DAY <=
          (SELECT max(created_at) FROM ev WHERE kind = 'TransactionCreated' OR seq // 10 % 5 <> 0
             AND kind IN ('TransactionFailed', 'TransactionSucceeded'))"""
    ),
    "stream_transaction_status": on_log(
        """SELECT c.aggregate_id AS id, CASE e.kind WHEN 'TransactionFailed' THEN 'FAILED'
          WHEN 'TransactionSucceeded' THEN 'SUCCEEDED' ELSE 'PENDING' END AS status,
        CASE WHEN e.kind = 'TransactionFailed' THEN e.reason ELSE '' END AS reason
        FROM ev c LEFT JOIN (SELECT tx_id, arg_min(kind, seq) AS kind,
            arg_min(coalesce(reason, ''), seq) AS reason FROM ev
            WHERE kind IN ('TransactionFailed', 'TransactionSucceeded') GROUP BY 1) e
          ON c.aggregate_id = e.tx_id WHERE c.kind = 'TransactionCreated'"""
    ),
    "stream_atomic_commit": on_log(
        f"""SELECT 'accounts.1/balance' AS id,
        'CatchUp:' || (SELECT max(seq) FROM ev WHERE kind IN {PROJECTED}) AS token,
        CAST(sum(balance) AS BIGINT) AS held, CAST(sum(version) AS BIGINT) AS events FROM bal""",
        BAL,
    ),
    "run_projection": on_log(
        """SELECT aggregate_id, CAST(sum(money) AS BIGINT) AS deposited FROM ev
        WHERE kind = 'MoneyDeposited' GROUP BY 1"""
    ),
}
