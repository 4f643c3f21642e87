"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Numbers, dates, addresses and credentials are found by one pattern, validated by kind, and
replaced by another value of the same format: two halves take turns in moving each other by
a keyed hash, which permutes all values of a format. Equal values get equal pseudonyms in
every document, different ones different pseudonyms, and checks still hold (Luhn digits, IBAN
check digits, calendar days, dialling codes). What fails its validation is left as it is.

Column expressions only: a text is split at the matches, the matches are mapped, and both are
joined again.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Turns of the permutation, each half being moved in every second one.
ROUNDS = 8

# The formats that are looked for.
BEFORE, BEHIND = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}"
ACCESS_KEY = BEFORE + r"(?:AKIA|ASIA)[0-9A-Z]{16}" + BEHIND
SECRET = (
    r"(?<=(?:[Pp]assword|PASSWORD|[Pp]asswd|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi[_\-]?[Kk]ey|API_KEY)"
    r"[\"']?[ ]?[=:][ ]?[\"']?)[A-Za-z0-9+/_\-]{8,}"
)
#: Lengths of IBANs by country; others are looked for by their form alone.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBANS = tuple(
    rf"(?:{'|'.join(names.split())})[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}"
    + (rf"[ ]?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    for n, names in IBAN_LENGTHS.items()
)
ANY_IBAN = r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?"
IBAN = BEFORE + f"(?:(?:{'|'.join(IBANS)}){BEHIND}|{ANY_IBAN})" + BEHIND
ISO_DATE = BEFORE + r"[0-9]{4}-[0-9]{2}-[0-9]{2}" + BEHIND
SLASH_DATE = BEFORE + r"[0-9]{2}/[0-9]{2}/[0-9]{4}" + BEHIND
DOT_DATE = BEFORE + r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}" + BEHIND
IPV4 = r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])"
SSN = BEFORE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + BEHIND
PHONE = r"(?<![A-Za-z0-9+])(?:\+?1[ .\-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}" + BEHIND
PHONE_ABROAD = r"(?<![A-Za-z0-9+])\+[0-9]{1,3}(?:[ .\-]?\(?[0-9]{2,4}\)?){2,5}" + BEHIND
CARD = BEFORE + r"[0-9](?:[ \-]?[0-9]){12,18}" + BEHIND
#: Formats of cards, the longest first.
CARDS = (
    r"[0-9]{4}(?:[ \-]?[0-9]{4}){3}[ \-]?[0-9]{3}",
    r"[0-9]{4}(?:[ \-]?[0-9]{4}){3}",
    r"[0-9]{4}[ \-]?[0-9]{6}[ \-]?[0-9]{5}",
    r"[0-9]{4}[ \-]?[0-9]{6}[ \-]?[0-9]{4}",
    r"[0-9]{13,19}",
)
KINDS = (EMAIL, ACCESS_KEY, SECRET, IBAN, ISO_DATE, SLASH_DATE, DOT_DATE, IPV4, SSN, PHONE, PHONE_ABROAD)
#: Texts that may hold an IBAN or a card.
LONG_NUMBER = r"(?:[0-9][ \-]?){12}[0-9]|[A-Z]{2}[0-9]{2}[ ]?[A-Z0-9]{4}"
PATTERN = "|".join(KINDS)

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX = "0123456789abcdef"
#: Days are permuted in blocks of this many squared, counted from 0001-01-01; the blocks end in 9980.
DAYS, BLOCKS = 270, 50


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _turn(key: str, tweak: Column, i: Column, half: Column) -> Column:
    """Hex digits that depend on all arguments."""
    return F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string")), 512)


def permuted(x: Column, y: Column, a: int | Column, b: int | Column, key: str, tweak: str | Column) -> Column:
    """struct(x, y) permuted among all pairs with 0 <= x < a and 0 <= y < b."""
    tweak = tweak if isinstance(tweak, Column) else F.lit(tweak)
    a, b = (v if isinstance(v, Column) else F.lit(v) for v in (a, b))

    def amount(i: Column, half: Column, most: Column) -> Column:
        return F.conv(F.substring(_turn(key, tweak, i, half), 1, 14), 16, 10).cast("long") % most

    def turn(state: Column, i: Column) -> Column:
        return F.when(
            i % 2 == 0,
            F.struct(((state.x + amount(i, state.y, a)) % a).alias("x"), state.y.alias("y")),
        ).otherwise(F.struct(state.x.alias("x"), ((state.y + amount(i, state.x, b)) % b).alias("y")))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _moved(text: Column, stream: Column, alphabets: tuple[str, ...]) -> Column:
    """``text`` with each character moved in its alphabet by four hex digits of ``stream``."""

    def moved(drawn: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            by = F.conv(F.substring(drawn, i % 32 * 4 + 1, F.lit(4)), 16, 10).cast("int")
            out = c
            for alphabet in alphabets:
                at = F.instr(F.lit(alphabet), c)
                new = F.substring(F.lit(alphabet), (at - 1 + by) % len(alphabet) + 1, F.lit(1))
                out = F.when(at > 0, new).otherwise(out)
            return out

        return F.array_join(F.transform(F.split(text, ""), one), "")

    return F.when(text == "", text).otherwise(let(stream, moved))


def scrambled(text: Column, key: str, tweak: str, alphabets: tuple[str, ...] = (DIGITS, LOWER, UPPER)) -> Column:
    """``text`` permuted among all texts with characters of the same alphabets in the same places."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(
        F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r")
    )

    def turn(state: Column, i: Column) -> Column:
        return F.when(
            i % 2 == 0,
            F.struct(
                state.l.alias("l"), _moved(state.r, _turn(key, F.lit(tweak), i, state.l), alphabets).alias("r")
            ),
        ).otherwise(
            F.struct(
                _moved(state.l, _turn(key, F.lit(tweak), i, state.r), alphabets).alias("l"), state.r.alias("r")
            )
        )

    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return let(done, lambda s: F.concat(s.l, s.r))


def walked(start: Column, step: Callable[[Column], Column], inside: Callable[[Column], Column], most: int) -> Column:
    """``step`` again and again, from once on, until the value is ``inside``: where ``step``
    permutes a set, this permutes the part of it that is inside. ``most`` steps leave a
    value outside with a chance below 1e-20."""
    return F.aggregate(F.sequence(F.lit(2), F.lit(most)), step(start), lambda s, i: F.when(inside(s), s).otherwise(step(s)))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refilled(form: Column, chars: Column) -> Column:
    """``form`` with its digits and letters replaced by ``chars``, one by one."""

    def filled(new: Column) -> Column:
        return F.aggregate(
            F.split(form, ""),
            F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
            lambda s, c: F.when(
                c.rlike("[A-Za-z0-9]"),
                F.struct(F.concat(s.out, F.substring(new, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at")),
            ).otherwise(F.struct(F.concat(s.out, c).alias("out"), s["at"].alias("at"))),
        ).out

    return let(chars, filled)


def _luhn(digits: Column) -> Column:
    """Sum of digits, every second one from the right, but for the last, doubled."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    each = F.transform(F.split(F.reverse(digits), ""), value)
    return F.aggregate(each, F.lit(0), lambda total, v: total + v)


def _card(m: Column, key: str) -> Column:
    def new(digits: Column) -> Column:
        inner = F.substring(digits, F.lit(2), F.length(digits) - 2)
        body = F.concat(F.substring(digits, 1, 1), scrambled(inner, key, "card", (DIGITS,)))
        return let(body, lambda x: F.concat(x, ((10 - _luhn(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")))

    return let(_digits(m), lambda d: F.when(_luhn(d) % 10 == 0, _refilled(m, new(d))).otherwise(m))


def _mod97(text: Column) -> Column:
    def add(total: Column, c: Column) -> Column:
        value = F.instr(F.lit(DIGITS + UPPER), c) - 1
        return (total * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _iban(m: Column, key: str) -> Column:
    def new(flat: Column) -> Column:
        country, body = F.substring(flat, 1, 2), F.substring(flat, F.lit(5), F.length(flat))

        def checked(x: Column) -> Column:
            check = (98 - _mod97(F.concat(x, country, F.lit("00")))).cast("string")
            return F.concat(country, F.lpad(check, 2, "0"), x)

        valid = _mod97(F.concat(body, F.substring(flat, 1, 4))) == 1
        return F.when(valid, _refilled(m, let(scrambled(body, key, "iban", (DIGITS, UPPER)), checked))).otherwise(m)

    return let(F.regexp_replace(m, " ", ""), new)


def _date(m: Column, form: str, key: str, after: int = 0) -> Column:
    """Null where the match is no day in this form, or none that is permuted.

    With ``after``, the match is one of the days behind that of their month, and its pseudonym
    is another such day: what reads as a day in one order of the fields only stays so.
    """
    origin = F.lit("0001-01-01").cast("date")

    def new(day: Column) -> Column:
        n = F.date_diff(day, origin).cast("long")
        within = n % (DAYS * DAYS)
        there = day.isNotNull() & (n >= 0) & (n < BLOCKS * DAYS * DAYS) & (F.date_format(day, form) == m)

        def at(s: Column) -> Column:
            return F.date_add(origin, (n - within + s.x * DAYS + s.y).cast("int"))

        start = F.struct(F.floor(within / DAYS).cast("long").alias("x"), (within % DAYS).cast("long").alias("y"))

        def step(s: Column) -> Column:
            return permuted(s.x, s.y, DAYS, DAYS, key, "date" if not after else f"date {after}")

        moved = walked(start, step, lambda s: F.dayofmonth(at(s)) > after, 64) if after else step(start)
        return F.when(there, let(moved, lambda s: F.date_format(at(s), form)))

    return let(F.try_to_date(m, form), new)


def _ipv4(m: Column, key: str) -> Column:
    """Each number keeps its count of digits."""

    def new(part: Column) -> Column:
        low = [F.element_at(F.array(*(F.lit(v) for v in (0, 10, 100))), F.length(part[i])) for i in range(4)]
        size = [F.element_at(F.array(*(F.lit(v) for v in (10, 90, 156))), F.length(part[i])) for i in range(4)]
        at = [part[i].cast("int") - low[i] for i in range(4)]
        moved = permuted(
            at[0] * size[1] + at[1], at[2] * size[3] + at[3], size[0] * size[1], size[2] * size[3], key, "ipv4"
        )

        def joined(s: Column) -> Column:
            values = (F.floor(s.x / size[1]), s.x % size[1], F.floor(s.y / size[3]), s.y % size[3])
            return F.concat_ws(".", *((v + b).cast("string") for v, b in zip(values, low, strict=True)))

        valid = F.forall(part, lambda p: (p.cast("int") <= 255) & (p.cast("int").cast("string") == p))
        return F.when(valid, let(moved, joined)).otherwise(m)

    return let(F.split(m, r"\."), new)


def _fields(text: Column, *sizes: int) -> list[Column]:
    """Numbers from consecutive digits."""
    at = [sum(sizes[:i]) + 1 for i in range(len(sizes))]
    return [F.substring(text, a, n).cast("int") for a, n in zip(at, sizes, strict=True)]


def _ssn(m: Column, key: str) -> Column:
    def new(digits: Column) -> Column:
        area, group, serial = _fields(digits, 3, 2, 4)
        valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
        x = area - 1 - F.when(area > 666, 1).otherwise(0)
        moved = permuted(x, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
        out = let(
            moved,
            lambda s: F.concat_ws(
                "-",
                F.lpad((s.x + F.when(s.x >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
                F.lpad((F.floor(s.y / 9999) + 1).cast("string"), 2, "0"),
                F.lpad((s.y % 9999 + 1).cast("string"), 4, "0"),
            ),
        )
        return F.when(valid, out).otherwise(m)

    return let(_digits(m), new)


def _phone(m: Column, key: str) -> Column:
    """North American numbers; the country code stays. Area and exchange stay within 200 to 999;
    numbers that are none of these are permuted by themselves, by which of the two is lower."""

    def new(digits: Column) -> Column:
        area, exchange, line = _fields(F.substring(digits, -10, 10), 3, 3, 4)
        first, second = F.when(area < 200, 0).otherwise(200), F.when((area >= 200) & (exchange >= 200), 200).otherwise(0)
        areas = F.when(area < 200, 200).otherwise(800)
        exchanges = F.when(area < 200, 1000).when(exchange < 200, 200).otherwise(800)
        kind = F.when(area < 200, "phone area").when(exchange < 200, "phone exchange").otherwise("phone")
        moved = permuted(area - first, (exchange - second) * 10000 + line, areas, exchanges * 10000, key, kind)
        out = let(
            moved,
            lambda s: F.concat(
                F.lpad((s.x + first).cast("string"), 3, "0"),
                F.lpad((F.floor(s.y / 10000) + second).cast("string"), 3, "0"),
                F.lpad((s.y % 10000).cast("string"), 4, "0"),
            ),
        )
        return F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), out)

    return _refilled(m, let(_digits(m), new))


def _phone_abroad(m: Column, key: str) -> Column:
    """The country code, up to three digits, stays."""
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return F.concat(code, _refilled(rest, scrambled(_digits(rest), key, "number", (DIGITS,))))


def _email(m: Column, key: str) -> Column:
    """The last label of the domain stays, and equal domains stay equal."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    top = F.substring_index(domain, ".", -1)
    rest = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    return F.concat(
        scrambled(local, key, "mail"), F.lit("@"), scrambled(rest, key, "domain"), F.lit("."), top
    )


def _secret(m: Column, key: str) -> Column:
    """Hex digits stay hex digits, and other texts do not become such."""
    only = "^[0-9a-f]+$"
    other = walked(m, lambda x: scrambled(x, key, "secret"), lambda x: ~x.rlike(only), 64)
    return F.when(m.rlike(only), scrambled(m, key, "hex", (HEX,))).otherwise(other)


def _access_key(m: Column, key: str) -> Column:
    return F.concat(
        F.substring(m, 1, 4), scrambled(F.substring(m, F.lit(5), F.length(m)), key, "access", (DIGITS + UPPER,))
    )


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of PATTERN, or the match if it is not valid."""

    def is_(kind: str) -> Column:
        return m.rlike(rf"\A(?:{kind})\z")

    return (
        F.when(m.contains("@"), _email(m, key))
        .when(is_(ACCESS_KEY), _access_key(m, key))
        .when(is_(IBAN) & ~m.rlike("^[0-9]"), _iban(m, key))
        .when(is_(ISO_DATE), F.coalesce(_date(m, "yyyy-MM-dd", key), m))
        .when(is_(SLASH_DATE), F.coalesce(_date(m, "MM/dd/yyyy", key), _date(m, "dd/MM/yyyy", key, 12), m))
        .when(is_(DOT_DATE), F.coalesce(_date(m, "dd.MM.yyyy", key), m))
        .when(is_(IPV4), _ipv4(m, key))
        .when(is_(SSN), _ssn(m, key))
        .when(is_(PHONE), _phone(m, key))
        .when(is_(PHONE_ABROAD), _phone_abroad(m, key))
        .otherwise(_secret(m, key))
    )


def _starting(*forms: str) -> tuple[str, ...]:
    """Patterns whose first group is what begins at each place, also inside of other matches."""
    return tuple(rf"{BEFORE}(?=({form}){BEHIND})" for form in forms)


def _replaced(state: Column, patterns: tuple[str, ...], new) -> Column:
    """struct(text, free) with ``new`` for what the patterns find in ``free`` and ``new`` changes."""
    found = F.array_distinct(F.concat(*(F.regexp_extract_all(state["free"], F.lit(p), F.lit(1)) for p in patterns)))
    pairs = F.transform(found, lambda c: F.struct(c.alias("old"), new(c).alias("new")))

    def put(s: Column, pair: Column) -> Column:
        there = F.concat(F.lit(BEFORE), pair["old"], F.lit(BEHIND))
        return F.struct(
            F.regexp_replace(s["text"], there, pair["new"]).alias("text"),
            F.regexp_replace(s["free"], there, F.repeat(F.lit("@"), F.length(pair["old"]))).alias("free"),
        )

    return F.aggregate(F.filter(pairs, lambda pair: pair["old"] != pair["new"]), state, put)


def pseudonymised(text: Column, key: str) -> Column:
    """``text`` with a pseudonym for each match; null stays null.

    A match that fails its check stays, and so do its characters in ``free``, where IBANs and
    cards are looked for once more at every place; what is replaced is ``@`` there.
    """
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    new = F.transform(found, lambda m: pseudonym(m, key))

    def joined(matches: Column) -> Column:
        parts = F.zip_with(F.split(text, PATTERN, -1), matches, lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
        return F.array_join(parts, "")

    def again(done: Column) -> Column:
        taken = F.zip_with(found, done, lambda m, n: F.when(m == n, m).otherwise(F.repeat(F.lit("@"), F.length(m))))
        start = F.struct(joined(done).alias("text"), joined(taken).alias("free"))
        ibans = let(start, lambda s: _replaced(s, _starting(*IBANS), lambda c: _iban(c, key)))
        cards = let(ibans, lambda s: _replaced(s, (*_starting(*CARDS), f"({CARD})"), lambda c: _card(c, key)))
        return F.when(text.rlike(LONG_NUMBER), cards["text"]).otherwise(joined(done))

    return F.when(text.rlike(r"[0-9@]|[=:][ ]?[\"']?[A-Za-z]"), let(new, again)).otherwise(text)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with text replaced and all other columns as they are; one row for each row.

    A null text stays null, an empty one empty; rows that repeat get equal texts. Lengths do
    not change, so n_chars stays right.
    """
    return docs.withColumn("text", pseudonymised(F.col("text"), key))


#: The setting that holds the secret of the pseudonyms.
KEY_SETTING = "spark.passbook.pii.key"
_KEYS: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The secret that the session was given as ``spark.passbook.pii.key``. Without one, it is
    drawn for this application: pseudonyms are then linked inside it only, and by nobody else."""
    given = spark.conf.get(KEY_SETTING, None)
    return given or _KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_hex(16))
