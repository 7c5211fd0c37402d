"""Operator 2, personal data to format-preserving pseudonyms. DataFrame operations only.

What a pattern finds is validated (check digits, octets, calendar, area ranges), taken as digits of mixed radix and put through an
alternating Feistel network over its two halves, keyed, so that each value becomes another of the same format and equal values stay
equal in all documents. Radices by kind: card numbers 10 for all but the check digit, which is worked out anew; account numbers
(IBAN) 10 and 26 after the check digits, worked out anew; phone numbers 10 after the country code; addresses' local parts 26
for letters and 10 for digits, in any case alike; octets 256, groups of long addresses 65536; US social security numbers
898, 99 and 9999; dates 189 and 773, whose product is the number of days in 400 Gregorian years (years 1800 to 2199); secrets
in hexadecimal 10 and 6, others 10 and 26 after their prefix. Every step adds modulo the radix, so the map is a permutation.
Dates with slashes are day first where that is a date; those that are only month first are a class of their own, in which the
permutation of days is walked until it is back in the class.

Edge cases. A null text stays null; what does not validate stays. Matches do not overlap: the earliest wins, then the order of
``PATTERNS``. Texts of any length are rewritten whole. Repeated rows are treated alike. An empty table gives an empty result.
Columns named ``n_replaced`` give way to the result; all others, whatever their names, are carried untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, rest_of

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_HEX4 = "[0-9A-Fa-f]{1,4}"
#: What secrets of well-known services begin with, and what follows.
_KEYS = r"(?:AKIA(?=[0-9A-Z]{16})|gh[pousr]_(?=[0-9A-Za-z]{36})|sk-(?=[0-9A-Za-z]{20})|xox[abprs]-(?=[0-9A-Za-z\-]{10})|AIza(?=[0-9A-Za-z_\-]{35}))"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}",
    "key": rf"(?<![0-9A-Za-z]){_KEYS}[0-9A-Za-z_\-]{{10,80}}",
    "hex": r"(?<![0-9A-Za-z])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])",
    "ip6": rf"(?<![0-9A-Za-z:.])(?:{_HEX4}(?::{_HEX4}){{7}}|(?:{_HEX4}:){{2,6}}(?::{_HEX4}){{1,5}})(?![0-9A-Za-z:])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9\-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3} [0-9]{2} [0-9]{4})(?![0-9\-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .\-]?\(?[0-9]{2,4}\)?(?:[ .\-]?[0-9]{2,4}){2,3}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
}
ANY = "|".join(PATTERNS.values())
#: Cheap to look for, and in any text that has a match that is changed.
SIGN = "[0-9@]|[A-Fa-f]{32}|AKIA|gh[pousr]_|sk-|xox|AIza"
ROUNDS = 8
#: Days of the first and after the last date that is permuted, from 1970-01-01: 1800-01-01 and 2200-01-01.
_FIRST_DAY, _DAYS = -62091, 146097
_DATE_RADIX = (189, 773)


def feistel(values: Column, radices: Column, key: str, tag: Column) -> Column:
    """Each round adds to every digit of one half a number from a keyed hash of the other half, of the round and of the place."""
    left = lambda i: 2 * i < F.size(values)

    def round_(now: Column, r: Column) -> Column:
        mine = lambda i: F.when(r % 2 == 0, left(i)).otherwise(~left(i))
        other = F.array_join(F.transform(now, lambda v, i: F.when(mine(i), F.lit("")).otherwise(v.cast("string"))), ",")
        digest = F.sha2(F.concat_ws("|", F.lit(key), tag, r.cast("string"), other), 512)
        add = lambda d, i: F.conv(F.substring(d, 1 + (i * 8) % 120, F.lit(8)), 16, 10).cast("long")
        return let(digest, lambda d: F.transform(now, lambda v, i: F.when(mine(i), F.pmod(v + add(d, i), F.get(radices, i))).otherwise(v)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, round_)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _permute_chars(text: Column, key: str, tag: str, letters: int) -> Column:
    """Digits become digits; if ``letters`` is 26 or 6, letters become letters of the same case; all else stays."""
    base = lambda c: F.when((c >= "0") & (c <= "9"), F.lit(48)).when(F.lit(letters > 0) & (c >= "a") & (c <= "z"), F.lit(97)).when(F.lit(letters > 0) & (c >= "A") & (c <= "Z"), F.lit(65))
    value = lambda c: F.when(base(c).isNull(), F.lit(0)).otherwise(F.ascii(c) - base(c)).cast("long")
    radix = lambda c: F.when(base(c).isNull(), F.lit(1)).when(base(c) == 48, F.lit(10)).otherwise(F.lit(max(1, letters))).cast("long")
    shape = lambda cs: F.array_join(F.transform(cs, lambda c: F.when(base(c).isNull(), c).otherwise(base(c).cast("string"))), ",")
    back = lambda cs, vs: F.array_join(F.zip_with(cs, vs, lambda c, v: F.when(base(c).isNull(), c).otherwise(F.char(v + base(c)))), "")
    return let(_chars(text), lambda cs: back(cs, feistel(F.transform(cs, value), F.transform(cs, radix), key, F.concat(F.lit(tag), shape(cs)))))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits, in order, replaced, so that a value is the same one however it is set."""
    new = lambda c, i: F.when((c >= "0") & (c <= "9"), F.substring(digits, F.length(_digits(F.substring(form, F.lit(1), i + 1))), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(_chars(form), new), "")


def luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits, the last one weighing 1."""
    n = F.length(digits)
    each = lambda c, i: let(c.cast("int") * F.when((n - 1 - i) % 2 == 1, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x))
    return F.aggregate(F.transform(_chars(digits), each), F.lit(0), lambda a, x: a + x) % 10


def _card(m: Column, key: str) -> Column:
    head = lambda d: _permute_chars(F.substring(d, F.lit(1), F.length(d) - 1), key, "card", 0)
    checked = lambda h: F.concat(h, F.pmod(F.lit(10) - luhn(F.concat(h, F.lit("0"))), F.lit(10)).cast("string"))
    whole = let(_digits(m), lambda d: let(head(d), lambda h: let(checked(h), lambda x: _refill(m, x))))
    return F.when(luhn(_digits(m)) == 0, whole).otherwise(m)


def _moved(day: Column, key: str) -> Column:
    """The permutation of the days of 400 years."""
    a, b = _DATE_RADIX
    return let(feistel(F.array(F.floor(day / b), day % b), F.array(F.lit(a).cast("long"), F.lit(b).cast("long")), key, F.lit("date")), lambda v: F.get(v, 0) * b + F.get(v, 1))


#: Steps of a walk; each stays outside the class with a chance of two in five.
_WALK = 80


def _date(m: Column, key: str) -> Column:
    """By spelling; a date with slashes is month first only where day first is none, and then becomes another of that class."""
    out = m
    day = lambda form: F.unix_date(F.to_date(F.try_to_timestamp(m, F.lit(form)))).cast("long") - _FIRST_DAY
    at = lambda n: F.date_from_unix_date((n + _FIRST_DAY).cast("int"))
    spelled = lambda n, form: let(n, lambda d: F.when(d.between(0, _DAYS - 1), F.date_format(at(_moved(d, key)), form)))
    for pattern, form in ((r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"), (r"^\d{2}\.\d{2}\.\d{4}$", "dd.MM.yyyy")):
        new = spelled(day(form), form)
        out = F.when(m.rlike(pattern), F.coalesce(new, m)).otherwise(out)
    walk = lambda d: F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), F.struct(_moved(d, key).alias("d")), lambda a, _: F.when(F.dayofmonth(at(a["d"])) > 12, a).otherwise(F.struct(_moved(a["d"], key).alias("d"))), lambda a: a["d"])
    other = let(day("MM/dd/yyyy"), lambda d: F.when(d.between(0, _DAYS - 1), let(walk(d), lambda n: F.when(F.dayofmonth(at(n)) > 12, F.date_format(at(n), "MM/dd/yyyy")))))
    return F.when(m.rlike(r"^\d{2}/(?:1[3-9]|[23]\d)/\d{4}$"), F.coalesce(other, m)).otherwise(out)


def _ssn(m: Column, key: str) -> Column:
    n = lambda a, k: F.substring(m, a, k).cast("long")
    area = n(1, 3)
    ok = (area > 0) & (area < 900) & (area != 666) & (n(5, 2) > 0) & (n(8, 4) > 0)
    values = F.array(area - 1 - F.when(area > 666, 1).otherwise(0), n(5, 2) - 1, n(8, 4) - 1)
    moved = feistel(values, F.array(*[F.lit(x).cast("long") for x in (898, 99, 9999)]), key, F.lit("ssn"))
    place = lambda v, w: F.lpad(v.cast("string"), w, "0")
    sign = F.substring(m, 4, 1)
    new = let(moved, lambda v: F.concat(place(F.get(v, 0) + 1 + F.when(F.get(v, 0) >= 665, 1).otherwise(0), 3), sign, place(F.get(v, 1) + 1, 2), sign, place(F.get(v, 2) + 1, 4)))
    return F.when(ok, new).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[^0-9])|^", 0)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    return F.concat(country, let(rest, lambda x: let(_permute_chars(_digits(x), key, "phone", 0), lambda d: _refill(x, d))))


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    return F.array_join(F.transform(feistel(octets, F.array(*[F.lit(256).cast("long")] * 4), key, F.lit("ip")), lambda x: x.cast("string")), ".")


def _ip6(m: Column, key: str) -> Column:
    """Eight groups; what ``::`` leaves out is written out, so that one address is one however it is set."""
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    head, tail = F.substring_index(m, "::", 1), F.when(m.contains("::"), F.substring_index(m, "::", -1)).otherwise("")
    whole = let(groups(head), lambda a: let(groups(tail), lambda b: F.when(F.size(a) + F.size(b) <= 8, F.concat(a, F.array_repeat(F.lit("0"), F.lit(8) - F.size(a) - F.size(b)), b))))
    made = lambda gs: F.transform(feistel(F.transform(gs, lambda g: F.conv(g, 16, 10).cast("long")), F.array_repeat(F.lit(65536).cast("long"), 8), key, F.lit("ip6")), lambda v: F.lower(F.hex(v)))
    return F.coalesce(let(whole, lambda gs: F.when(gs.isNotNull() & m.rlike("[0-9]"), F.array_join(made(gs), ":"))), m)


def iban_rest(country: Column, account: Column) -> Column:
    """What the account and the country, letters as 10 to 35, with check digits 00 leave over modulo 97."""
    step = lambda a, c: F.when(c >= "A", a * 100 + F.ascii(c) - 55).otherwise(a * 10 + F.ascii(c) - 48) % 97
    return F.aggregate(_chars(F.concat(account, country, F.lit("00"))), F.lit(0), lambda a, c: step(a, c).cast("int"))


def _iban(m: Column, key: str) -> Column:
    def of(x: Column) -> Column:
        country, check, account = F.substring(x, 1, 2), F.substring(x, 3, 2), F.substring(x, F.lit(5), F.length(x) - 4)
        checked = lambda a: F.lpad((F.lit(98) - iban_rest(country, a)).cast("string"), 2, "0")
        new = let(_permute_chars(account, key, "iban", 26), lambda a: F.concat(country, checked(a), a))
        return F.when((F.length(x) <= 34) & (checked(account) == check), new)

    spaced = lambda new: F.array_join(F.transform(_chars(m), lambda c, i: F.when(c == " ", c).otherwise(F.substring(new, F.length(F.replace(F.substring(m, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))), "")
    return F.coalesce(let(let(F.replace(m, F.lit(" "), F.lit("")), of), lambda new: F.when(new.isNotNull(), spaced(new))), m)


def _key(m: Column, key: str) -> Column:
    return let(F.regexp_extract(m, f"^{_KEYS}", 0), lambda head: F.concat(head, _permute_chars(F.substring(m, F.length(head) + 1, F.length(m)), key, "key", 26)))


def _email(m: Column, key: str) -> Column:
    """An address is one in any case: its lower-case form is permuted, then set in the case it had."""
    local = F.substring_index(m, "@", 1)
    cased = lambda new: F.array_join(F.zip_with(_chars(local), _chars(new), lambda c, n: F.when((c >= "A") & (c <= "Z"), F.upper(n)).otherwise(n)), "")
    return F.concat(let(_permute_chars(F.lower(local), key, "email", 26), cased), F.lit("@"), F.substring_index(m, "@", -1))


def pseudonym(m: Column, key: str) -> Column:
    """What one match becomes."""
    makers = {"email": _email, "key": _key, "hex": lambda x, k: _permute_chars(x, k, "hex", 6), "ip6": _ip6, "ip": _ip, "date": _date, "iban": _iban, "ssn": _ssn, "phone": _phone, "card": _card}
    inner = lambda p: f"^(?:{p})$"
    return reduce(lambda rest, kind: F.when(m.rlike(inner(PATTERNS[kind])), makers[kind](m, key)).otherwise(rest), reversed(list(PATTERNS)), m)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """Every row of ``docs`` with its ``text`` rewritten and ``n_replaced``, the number of matches that changed."""
    found = F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(0))
    pair = F.when(F.col("text").rlike(SIGN) & F.col("text").rlike(ANY), let(found, lambda ms: F.struct(ms.alias("old"), F.transform(ms, lambda m: pseudonym(m, key)).alias("new"))))
    made = docs.select(rest_of(docs, "text").alias("rest"), "text", pair.alias("pair"))
    whole = F.array_join(F.flatten(F.zip_with(F.split("text", ANY, -1), F.concat(F.col("pair.new"), F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    changed = F.size(F.filter(F.zip_with("pair.old", "pair.new", lambda a, b: a != b), lambda x: x))
    return made.select(
        *[F.col("rest").getField(c).alias(c) for c in docs.columns if c not in ("text", "n_replaced")],
        F.when(F.col("pair").isNull(), F.col("text")).otherwise(whole).alias("text"),
        F.when(F.col("pair").isNull(), 0).otherwise(changed).cast("long").alias("n_replaced"),
    )
