"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their format's check are permuted by a keyed
Feistel network within the format: a valid card number stays a valid one of as many digits, a date
stays a date. What fails its check (Luhn digits, numbers that are never given
out, octets over 255, days that don't exist) is left alone. Telephone numbers are
the exception: their shape is all there is to check, so whatever has it is
permuted among the digits. The permutation
depends on the key and the format alone, so equal values keep equal
pseudonyms in every document, and different values different ones. E-mail
addresses and long hexadecimal secrets, which have no bounded domain, get
keyed digests of the same shape.

The keyed function is HMAC-SHA256. The key is a value of a one-row table that
the plan refers to, not a literal: explain, event logs and the user interface
don't show it.

Everything is built from column expressions: texts are split at the matches of
one pattern, only matches are worked on, and the text is joined again.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

ROUNDS = 8
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,126}[A-Za-z]{2,24}"
#: Not after a word for a version: such numbers look alike.
_IP = r"(?<![0-9.])(?=[0-9]{1,3}\.)(?<!\b(?:[Vv]ersion|[Bb]uild|[Rr]elease|[Rr]evision|[Ff]irmware|[Vv])[ :.=]{0,2})(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])(?!\.[0-9])"
_ISO_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
_DAY_DATE = r"(?<![0-9/.])[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}(?![0-9/])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9])"
#: Digits at a stretch, or in groups as they stand on cards: all but the last of 4 to 6 digits, or 6 and the rest.
_CARD = (
    # possessive, and each group sure of the next: a long run is gone along without a step back
    r"(?<![0-9A-Za-z])(?:(?:[0-9]{4,6}[ -](?=[0-9]{1,7}(?![0-9A-Za-z]))){3,}+[0-9]{1,7}|(?:[0-9]{4,6}[ -]){2}[0-9]{4,7}|[0-9]{6}[ -][0-9]{6,13})(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])[0-9]{12,19}(?![0-9A-Za-z])"
)
_SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
#: One pattern; at a place the first alternative that fits wins.
PATTERN = "|".join([_EMAIL, _IP, _ISO_DATE, _DAY_DATE, _SSN, _PHONE, _CARD, _SECRET])
#: Dates that are permuted: days of the years 1900 to 2099.
_FIRST_DAY, _DAYS = "1900-01-01", 73049


def _whole(p: str) -> str:
    return f"^(?:{p})$"


class Key(NamedTuple):
    """The two padded keys of HMAC-SHA256 as columns."""

    inner: Column
    outer: Column

    def digest(self, *parts: Column) -> Column:
        """HMAC of ``parts`` as 64 hexadecimal digits."""
        message = F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")
        return F.sha2(F.concat(self.outer, F.unhex(F.sha2(F.concat(self.inner, message), 256))), 256)


def padded_keys(spark: SparkSession, secret: str) -> tuple[Column, Column]:
    """The padded keys of ``secret`` as scalar subqueries on a one-row table."""
    raw = secret.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    padded = raw.ljust(64, b"\0")
    # a local relation of the JVM: its value isn't part of the plan's text, and no Python or RDD makes it
    values = spark._jvm.java.util.ArrayList()
    values.add(bytes(x ^ 0x36 for x in padded).hex() + bytes(x ^ 0x5C for x in padded).hex())
    one = DataFrame(spark._jsparkSession.createDataset(values, spark._jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)
    return tuple(one.select(F.unhex(F.substring("value", at, 128)).alias("k")).scalar() for at in (1, 129))


def keyed_number(key: Key, *parts: Column) -> Column:
    """60 pseudo-random bits from the key and ``parts``."""
    return F.conv(F.substring(key.digest(*parts), 1, 15), 16, 10).cast("long")


def feistel(value: Column, left: Column, right: Column, key: Key, tweak: Column) -> Column:
    """Keyed permutation of the numbers below ``left * right`` (moduli of the two halves, below 2**31).

    An unbalanced network on (value div right, value mod right): each round
    adds a keyed function of one half to the other, modulo its size.
    """

    def step(state: Column, i: Column) -> Column:
        a, b = state["a"], state["b"]
        even = i % 2 == 0
        mixed = F.when(even, F.pmod(a + keyed_number(key, tweak, i, b) % left, left)).otherwise(F.pmod(b + keyed_number(key, tweak, i, a) % right, right))
        return let(mixed, lambda m: F.struct(F.when(even, m).otherwise(a).alias("a"), F.when(even, b).otherwise(m).alias("b")))

    start = F.struct(F.floor(value / right).cast("long").alias("a"), F.pmod(value, right).cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["a"] * right + s["b"])


def _power10(n: Column) -> Column:
    return F.get(F.array(*[F.lit(10**k) for k in range(11)]), n)


def permuted_digits(digits: Column, key: Key, tweak: Column) -> Column:
    """Keyed permutation of the digit strings of the same length, from 2 to 18 digits."""

    def of(d: Column) -> Column:
        n = F.length(d)
        low = F.floor(n / 2).cast("int")
        left, right = _power10(n - low), _power10(low)
        halves = F.substring(d, F.lit(1), n - low).cast("long"), F.substring(d, n - low + 1, low).cast("long")

        def step(state: Column, i: Column) -> Column:
            a, b = state["a"], state["b"]
            even = i % 2 == 0
            mixed = F.when(even, F.pmod(a + keyed_number(key, tweak, n, i, b) % left, left)).otherwise(F.pmod(b + keyed_number(key, tweak, n, i, a) % right, right))
            return let(mixed, lambda m: F.struct(F.when(even, m).otherwise(a).alias("a"), F.when(even, b).otherwise(m).alias("b")))

        last = lambda s: F.concat(F.lpad(s["a"].cast("string"), n - low, F.lit("0")), F.lpad(s["b"].cast("string"), low, F.lit("0")))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(halves[0].alias("a"), halves[1].alias("b")), step, last)

    return let(digits, of)


def luhn_digit(digits: Column) -> Column:
    """The check digit that makes ``digits`` followed by it pass the Luhn test."""
    doubled = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, F.floor(c.cast("int") * 2 / 10) + (c.cast("int") * 2) % 10).otherwise(c.cast("int")).cast("int"))
    return F.pmod(F.lit(10) - F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10, F.lit(10)).cast("int")


def _laid_out(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced by ``digits`` in turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))
    step = lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substring(digits, s["next"], F.lit(1))).alias("out"), (s["next"] + 1).alias("next"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["next"].alias("next")))
    return F.aggregate(F.split(template, ""), start, step, lambda s: s["out"])


def _card(m: Column, key: Key) -> Column:
    """A number whose last digit is its Luhn digit: the others are permuted and get theirs. Null for any other number."""

    def of(d: Column) -> Column:
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        changed = let(permuted_digits(body, key, F.lit("card")), lambda b: _laid_out(m, F.concat(b, luhn_digit(b).cast("string"))))
        return F.when(F.substring(d, F.length(d), F.lit(1)).cast("int") == luhn_digit(body), changed)

    return let(F.regexp_replace(m, "[^0-9]", ""), of)


#: Groups of a run that are put together before they are added to what comes before them.
_CHUNK = 64


#: Groups that a card number has at most.
_GROUPS = 5


def _grouped_cards(m: Column, key: Key) -> Column:
    """A run of groups of digits: from the left, the longest stretch of 13 to 19 digits (12, if it is the whole run) that is a card number is changed, so one after a year or another number is found.

    What a number becomes depends on its digits alone, however they are
    grouped. Long runs are put together chunk by chunk, as adding each group to
    all text before it would take time in the square of the run.
    """

    def of(groups: Column) -> Column:
        state = lambda text, skip, n: F.struct(text.alias("text"), skip.alias("skip"), n.alias("n"))

        def stretch(i: Column, k: int) -> Column:
            """The ``k`` groups from place i changed, and k; null if they are no card number."""
            # twelve digits are too few to pick out of a longer run, where one stretch in ten passes by chance
            least = F.when(F.size(groups) == k, 12).otherwise(13)
            whole = let(F.array_join(F.slice(groups, i + 1, F.lit(k)), ""), lambda w: F.when(F.length(F.regexp_replace(w, "[^0-9]", "")).between(least, F.lit(19)), _card(w, key)))
            return F.when(i + k <= F.size(groups), let(whole, lambda c: F.when(c.isNotNull(), F.struct(c.alias("text"), F.lit(k).alias("k")))))

        def step(s: Column, i: Column) -> Column:
            found = F.when(s["skip"] == 0, F.coalesce(*[stretch(i, k) for k in range(_GROUPS, 1, -1)]))
            fresh = let(found, lambda c: F.when(c.isNull(), state(F.concat(s["text"], F.get(groups, i)), F.lit(0), s["n"])).otherwise(state(F.concat(s["text"], c["text"]), c["k"] - 1, s["n"] + 1)))
            return F.when(s["skip"] > 0, state(s["text"], s["skip"] - 1, s["n"])).otherwise(fresh)

        def chunk(s: Column, first: Column) -> Column:
            places = F.sequence(first, F.least(first + _CHUNK, F.size(groups)) - 1)
            own = F.aggregate(places, state(F.lit(""), s["skip"], s["n"]), step)
            return let(own, lambda o: state(F.concat(s["text"], o["text"]), o["skip"], o["n"]))

        firsts = F.sequence(F.lit(0), F.size(groups) - 1, F.lit(_CHUNK))
        return F.aggregate(firsts, state(F.lit(""), F.lit(0), F.lit(0)), chunk, lambda s: F.struct(s["text"].alias("text"), s["n"].alias("n")))

    return let(F.regexp_extract_all(m, F.lit("[0-9]+[ -]?"), F.lit(0)), of)


def _ssn(m: Column, key: Key) -> Column:
    """Numbers that can be given out are permuted among themselves; others are null: areas 000, 666 and from 900, group 00, serial 0000."""
    area, group, serial = (F.substring(m, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    number = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    padded = lambda x, n: F.lpad(x.cast("string"), n, F.lit("0"))

    def written(v: Column) -> Column:
        upper = F.floor(v / 9999).cast("long")
        at = F.floor(upper / 99).cast("long")
        return F.concat_ws("-", padded(at + F.when(at >= 665, 2).otherwise(1), 3), padded(upper % 99 + 1, 2), padded(v % 9999 + 1, 4))

    return F.when(valid, let(feistel(number, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, F.lit("ssn")), written))


def _phone(m: Column, key: Key) -> Column:
    """The country code stays."""
    code = F.regexp_extract(m, r"^(\+[0-9]{1,3}[ .-]?)", 1)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return let(F.regexp_replace(rest, "[^0-9]", ""), lambda d: F.concat(code, _laid_out(rest, permuted_digits(d, key, F.lit("phone")))))


def _ip(m: Column, key: Key) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    changed = let(number, lambda v: feistel(v, F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, F.lit("ip")))
    dotted = lambda v: F.concat_ws(".", *[(F.shiftright(v, s).bitwiseAND(255)).cast("string") for s in (24, 16, 8, 0)])
    return F.when(F.exists(octets, lambda x: x > 255), None).otherwise(let(changed, dotted))


def _date(m: Column, day: Column, form: Column, key: Key) -> Column:
    """Cycle-walking: the permutation of a slightly larger domain is applied until a day of the range comes up."""
    ordinal = F.datediff(day, F.lit(_FIRST_DAY).cast("date")).cast("long")
    once = lambda v: feistel(v, F.lit(512).cast("long"), F.lit(256).cast("long"), key, F.lit("date"))
    # half of the larger domain lies in the range, so 64 rounds that all miss do not occur
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(ordinal.alias("v"), F.lit(False).alias("done")), lambda s, _: F.when(s["done"], s).otherwise(let(once(s["v"]), lambda w: F.struct(w.alias("v"), (w < _DAYS).alias("done")))), lambda s: s["v"])
    inside = day.isNotNull() & (ordinal >= 0) & (ordinal < _DAYS)
    return F.when(inside, let(walked, lambda v: F.date_format(F.date_add(F.lit(_FIRST_DAY).cast("date"), v.cast("int")), form) if isinstance(form, str) else form(F.date_add(F.lit(_FIRST_DAY).cast("date"), v.cast("int")))))


def pseudonym(m: Column, key: Key) -> Column:
    """The pseudonym of one match of ``PATTERN`` as text, and n, how many items were found in it; what fails its format's check stays and isn't counted."""
    is_a = lambda p: m.rlike(_whole(p))
    digest = lambda n: F.substring(key.digest(F.lit("mail"), F.lower(m)), 1, n)
    iso = F.try_to_timestamp(m, F.lit("yyyy-MM-dd")).cast("date")
    dots = F.contains(m, F.lit("."))
    written = F.try_to_timestamp(F.translate(m, ".", "/"), F.lit("dd/MM/yyyy")).cast("date")
    as_written = lambda d: F.when(dots, F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy"))
    stretched = F.substring(key.digest(F.lit("secret"), F.lower(m)), F.lit(1), F.length(m))
    one = (
        F.when(F.contains(m, F.lit("@")), F.concat(F.lit("p"), digest(16), F.lit("@mail.invalid")))
        .when(is_a(_IP), _ip(m, key))
        .when(is_a(_ISO_DATE), _date(m, iso, "yyyy-MM-dd", key))
        .when(is_a(_DAY_DATE), _date(m, written, as_written, key))
        .when(is_a(_SSN), _ssn(m, key))
        .when(is_a(_CARD), _card(m, key))
        .when(is_a(_PHONE), _phone(m, key))
        .when(is_a(_SECRET), F.when(m.rlike("[A-F]"), F.upper(stretched)).otherwise(stretched))
    )
    single = let(one, lambda x: F.struct(F.coalesce(x, m).alias("text"), x.isNotNull().cast("int").alias("n")))
    return F.when(is_a(_CARD) & m.rlike("[ -]"), _grouped_cards(m, key)).otherwise(single)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced, and n_found, how many items were.

    No row is moved or gathered: the work is one projection. A null text stays
    null with n_found 0; an empty text stays empty. Repeated rows are treated
    alike. Other columns are carried along; none may be named n_found. An empty
    table gives no rows. An e-mail address has at most 126 labels, as names on
    the net do, and a run of one class of signs, however long, is read in time
    in proportion to it.
    """
    if "n_found" in docs.columns:
        raise ValueError("the input has a column n_found")
    names = [c + "_" * max(len(x) for x in docs.columns) for c in ("inner", "outer", "pii")]
    # subqueries may not stand inside higher-order functions, so they are columns first
    with_key = docs.withColumns(dict(zip(names, padded_keys(docs.sparkSession, key), strict=False)))
    secret, text = Key(F.col(names[0]), F.col(names[1])), F.col(f"`{text_col}`")
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    gaps = F.split(text, PATTERN, -1)
    joined = lambda r, g: F.array_join(F.transform(g, lambda x, i: F.concat(x, F.coalesce(F.get(r, i)["text"], F.lit("")))), "")
    number = lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    replaced = let(F.transform(found, lambda m: pseudonym(m, secret)), lambda r: F.struct(let(gaps, lambda g: joined(r, g)).alias("text"), number(r).alias("n")))
    # most texts have none of it, and one scan for a digit or an @ tells
    pair = F.when(text.rlike(PATTERN), replaced).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("n")))
    done = with_key.withColumn(names[2], pair)
    return done.select(*[F.col(f"{names[2]}.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], F.col(f"{names[2]}.n").alias("n_found"))
