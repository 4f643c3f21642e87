"""Transfers run one by one in plain Python: what settlement must equal."""

from __future__ import annotations


def run(transfers, accounts, opening=None):
    """transfers: (seq, from, to, money); accounts: id -> status.

    Returns seq -> (status, reason, rollback, withdrawn, deposited, refunded) and balances.
    """
    balance = {a: 0 for a in accounts} | dict(opening or {})
    out = {}
    for seq, src, dst, money in sorted(transfers):
        if src is not None:
            status = accounts.get(src)
            if status is None:
                out[seq] = ("PENDING", "", False, False, False, False)
                continue
            if status != "OPEN":
                why = f"From account: Status: {status}: transactions disabled"
                out[seq] = ("FAILED", why, False, False, False, False)
                continue
            if balance[src] < money:
                out[seq] = ("FAILED", "From account: not enough funds", False, False, False, False)
                continue
            balance[src] -= money
        taken = src is not None
        if dst is None:
            out[seq] = ("SUCCEEDED", "", False, taken, False, False)
            continue
        status = accounts.get(dst)
        if status is None:
            out[seq] = ("PENDING", "", False, taken, False, False)
            continue
        if status != "OPEN":
            if taken:
                balance[src] += money
            why = f"To account: Status: {status}: transactions disabled"
            out[seq] = ("FAILED", why, taken, taken, False, taken)
            continue
        balance[dst] += money
        out[seq] = ("SUCCEEDED", "", False, taken, True, False)
    return out, balance
