"""Pseudonyms next to a plain Python twin, and as permutations of whole formats."""

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from passbook.llm import pii

KEY = "some key"


def turn(tweak, i, half):
    return hashlib.sha512(f"{KEY}|{tweak}|{i}|{half}".encode()).hexdigest()


def permuted(x, y, a, b, tweak):
    for i in range(8):
        if i % 2 == 0:
            x = (x + int(turn(tweak, i, y)[:14], 16) % a) % a
        else:
            y = (y + int(turn(tweak, i, x)[:14], 16) % b) % b
    return x, y


def moved(text, stream, alphabets):
    out = []
    for i, c in enumerate(text):
        by = int(stream[i % 32 * 4 : i % 32 * 4 + 4], 16)
        new = c
        for alphabet in alphabets:
            if c in alphabet:
                new = alphabet[(alphabet.index(c) + by) % len(alphabet)]
        out.append(new)
    return "".join(out)


def scrambled(text, tweak, alphabets=(pii.DIGITS, pii.LOWER, pii.UPPER)):
    left, right = text[: len(text) // 2], text[len(text) // 2 :]
    for i in range(8):
        if i % 2 == 0:
            right = moved(right, turn(tweak, i, left), alphabets)
        else:
            left = moved(left, turn(tweak, i, right), alphabets)
    return left + right


def plain_day(day, after=0):
    origin = datetime.date(1, 1, 1)
    n = (day - origin).days
    within = n % (270 * 270)
    x, y = divmod(within, 270)
    while True:
        x, y = permuted(x, y, 270, 270, f"date {after}" if after else "date")
        out = origin + datetime.timedelta(days=n - within + x * 270 + y)
        if out.day > after:
            return out


def plain_phone(digits):
    area, exchange, line = int(digits[:3]), int(digits[3:6]), int(digits[6:])
    if area < 200:
        x, y = permuted(area, exchange * 10_000 + line, 200, 10**7, "phone area")
        first = second = 0
    elif exchange < 200:
        x, y = permuted(area - 200, exchange * 10_000 + line, 800, 200 * 10**4, "phone exchange")
        first, second = 200, 0
    else:
        x, y = permuted(area - 200, (exchange - 200) * 10_000 + line, 800, 800 * 10**4, "phone")
        first = second = 200
    return f"{x + first:03}{y // 10_000 + second:03}{y % 10_000:04}"


def found(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "m string").repartition(8)
    return {r.m: r.out for r in rows.select("m", pii.pseudonym(F.col("m"), KEY).alias("out")).collect()}


@pytest.fixture(scope="module")
def days():
    first = datetime.date(1990, 1, 1)
    return [first + datetime.timedelta(days=i) for i in range((datetime.date(2020, 1, 1) - first).days)]


def test_dates_of_all_forms(spark, days):
    """All days of 30 years: distinct values get distinct pseudonyms, equal to the twin's."""
    american = {d.strftime("%m/%d/%Y"): d for d in days}
    european = {d.strftime("%d/%m/%Y"): d for d in days if d.day > 12}
    dotted = {d.strftime("%d.%m.%Y"): d for d in days[::7]}
    iso = {d.isoformat(): d for d in days[::7]}
    got = found(spark, [*american, *european, *dotted, *iso])
    slashed = [got[v] for v in [*american, *european]]
    assert len(set(slashed)) == len(slashed) == len(american) + len(european) > 17_000
    for values, form, after, step in (
        (american, "%m/%d/%Y", 0, 29), (european, "%d/%m/%Y", 12, 29), (dotted, "%d.%m.%Y", 0, 5), (iso, "%Y-%m-%d", 0, 5),
    ):
        for v in list(values)[::step]:
            day = plain_day(values[v], after)
            assert got[v] == day.strftime(form).replace(day.strftime("%Y"), f"{day.year:04}")


def test_phones_valid_and_not(spark):
    digits = [f"{a:03}{e:03}{n:04}" for a in range(150, 250, 3) for e in range(150, 250, 3) for n in (0, 4711)]
    got = found(spark, [f"{d[:3]}-{d[3:6]}-{d[6:]}" for d in digits])
    assert len(set(got.values())) == len(digits)
    for d in digits:
        new = got[f"{d[:3]}-{d[3:6]}-{d[6:]}"].replace("-", "")
        assert new == plain_phone(d)
        assert (new[:3] < "200", new[3:6] < "200" and new[:3] >= "200") == (d[:3] < "200", d[3:6] < "200" and d[:3] >= "200")


def test_credentials_and_addresses(spark):
    secrets = [f"{i:08x}" for i in range(0, 4000, 13)] + [f"tok{i:06}z" for i in range(300)] + [f"{i:07}g" for i in range(300)]
    mails = [f"ann.{i}@mail{i % 7}.example.org" for i in range(200)]
    keys = [f"AKIA{i:016}" for i in range(100)]
    got = found(spark, [*secrets, *mails, *keys])
    assert len(set(got.values())) == len(secrets) + len(mails) + len(keys)
    for v in secrets:
        is_hex = set(v) <= set(pii.HEX)
        want = scrambled(v, "hex", (pii.HEX,)) if is_hex else scrambled(v, "secret")
        while not is_hex and set(want) <= set(pii.HEX):
            want = scrambled(want, "secret")
        assert got[v] == want and (set(got[v]) <= set(pii.HEX)) == is_hex
    for v in mails:
        local, domain = v.split("@")
        rest, top = domain.rsplit(".", 1)
        assert got[v] == f"{scrambled(local, 'mail')}@{scrambled(rest, 'domain')}.{top}"
    assert all(got[v] == "AKIA" + scrambled(v[4:], "access", (pii.DIGITS + pii.UPPER,)) for v in keys)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def test_cards_and_numbers_with_checks(spark):
    bodies = [f"4{i:014}" for i in range(0, 9000, 31)]
    cards = [b + str((10 - luhn(b + "0")) % 10) for b in bodies]
    rows = spark.createDataFrame([(" ".join(cards[i : i + 5]) + " 4111111111111112",) for i in range(0, len(cards), 5)], "text string")
    got = [w for r in pii.pseudonymise(rows, KEY).collect() for w in r.text.split()]
    new = [w for w in got if w != "4111111111111112"]
    assert len(new) == len(set(new)) == len(cards) and not set(new) & set(cards)
    assert all(luhn(w) == 0 and w[0] == "4" and len(w) == 16 for w in new)
    want = {c[0] + scrambled(c[1:-1], "card", (pii.DIGITS,)) for c in cards}
    assert {w[:-1] for w in new} == want
    addresses = [f"10.{i}.{j}.{k}" for i in (7, 77, 177) for j in (8, 88) for k in range(0, 256, 5)]
    numbers = [f"{a:03}-{g:02}-{n:04}" for a in (1, 665, 667, 899) for g in (1, 99) for n in (1, 77, 9999)]
    out = found(spark, [*addresses, *numbers, "000-11-2222", "666-11-2222", "900-11-2222", "300.1.1.1"])
    assert len(set(out.values())) == len(out)
    assert all([len(x) for x in out[v].split(".")] == [len(x) for x in v.split(".")] for v in addresses)
    assert all(out[v] == v for v in ("000-11-2222", "666-11-2222", "900-11-2222", "300.1.1.1"))
