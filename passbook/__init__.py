"""Event-ledger analytics on Spark: decode, replay, settle, project, check."""
