"""Pseudonyms in plain Python, a match at a time."""

from __future__ import annotations

import hashlib
import re
from datetime import date, timedelta

from oreweave.llm import pii

FIRST, DAYS = date(1800, 1, 1), 146097


def feistel(values, radices, key, tag):
    now, n = list(values), len(values)
    for r in range(8):
        mine = [(2 * i < n) == (r % 2 == 0) for i in range(n)]
        other = ",".join("" if m else str(v) for m, v in zip(mine, now, strict=True))
        d = hashlib.sha512(f"{key}|{tag}|{r}|{other}".encode()).hexdigest()
        now = [(v + int(d[i * 8 % 120 :][:8], 16)) % x if m else v for i, (v, x, m) in enumerate(zip(now, radices, mine, strict=True))]
    return now


def chars(text, key, tag, letters):
    def base(c):
        return 48 if "0" <= c <= "9" else 97 if letters and "a" <= c <= "z" else 65 if letters and "A" <= c <= "Z" else None

    bases = [base(c) for c in text]
    values = [0 if b is None else ord(c) - b for c, b in zip(text, bases, strict=True)]
    radices = [1 if b is None else 10 if b == 48 else letters for b in bases]
    shape = ",".join(c if b is None else str(b) for c, b in zip(text, bases, strict=True))
    return "".join(c if b is None else chr(v + b) for c, b, v in zip(text, bases, feistel(values, radices, key, tag + shape), strict=True))


def refill(form, digits):
    left = iter(digits)
    return "".join(next(left) if c in "0123456789" else c for c in form)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10


def moved(day, key):
    a, b = feistel([day // 773, day % 773], [189, 773], key, "date")
    return a * 773 + b


def calendar(y, m, d):
    try:
        n = (date(int(y), int(m), int(d)) - FIRST).days
    except ValueError:
        return None
    return n if 0 <= n < DAYS else None


def of_date(m, key):
    at = lambda n: FIRST + timedelta(n)
    if "-" in m:
        n = calendar(m[:4], m[5:7], m[8:])
        return m if n is None else at(moved(n, key)).strftime("%Y-%m-%d")
    sign = m[2]
    if m[5] != sign:
        return m
    if sign == "/" and int(m[3:5]) > 12:
        n = calendar(m[6:], m[:2], m[3:5])
        while n is not None:
            n = moved(n, key)
            if at(n).day > 12:
                return at(n).strftime("%m/%d/%Y")
        return m
    n = calendar(m[6:], m[3:5], m[:2])
    return m if n is None else at(moved(n, key)).strftime(f"%d{sign}%m{sign}%Y")


def of_card(m, key):
    d = re.sub("[^0-9]", "", m)
    if luhn(d):
        return m
    head = chars(d[:-1], key, "card", 0)
    return refill(m, head + str(-luhn(head + "0") % 10))


def of_phone(m, key):
    head = re.match(r"\+[0-9]{1,3}(?=[^0-9])|", m)[0]
    rest = m[len(head) :]
    return head + refill(rest, chars(re.sub("[^0-9]", "", rest), key, "phone", 0))


def of_ssn(m, key):
    area, group, serial = int(m[:3]), int(m[4:6]), int(m[7:])
    if not (0 < area < 900 and area != 666 and group and serial):
        return m
    a, b, c = feistel([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], key, "ssn")
    return f"{a + 1 + (a >= 665):03}{m[3]}{b + 1:02}{m[3]}{c + 1:04}"


def of_email(m, key):
    local, at, host = m.partition("@")
    new = chars(local.lower(), key, "email", 26)
    return "".join(n.upper() if "A" <= c <= "Z" else n for c, n in zip(local, new, strict=True)) + at + host


def of_ip6(m, key):
    head, double, tail = m.partition("::")
    a, b = [g for g in head.split(":") if g], [g for g in tail.split(":") if g]
    if len(a) + len(b) > 8 or not re.search("[0-9]", m):
        return m
    groups = [int(g, 16) for g in a + ["0"] * (8 - len(a) - len(b)) + b]
    return ":".join(f"{v:x}" for v in feistel(groups, [65536] * 8, key, "ip6"))


def of_iban(m, key):
    x = m.replace(" ", "")
    rest = lambda a: int("".join(str(int(c, 36)) for c in a + x[:2] + "00")) % 97
    if len(x) > 34 or f"{98 - rest(x[4:]):02}" != x[2:4]:
        return m
    account = chars(x[4:], key, "iban", 26)
    new = iter(x[:2] + f"{98 - rest(account):02}" + account)
    return "".join(c if c == " " else next(new) for c in m)


def of_key(m, key):
    head = re.match(pii._KEYS, m)[0]
    return head + chars(m[len(head) :], key, "key", 26)


MAKERS = {"email": of_email, "key": of_key, "hex": lambda m, k: chars(m, k, "hex", 6), "ip6": of_ip6, "ip": lambda m, k: ".".join(map(str, feistel(list(map(int, m.split("."))), [256] * 4, k, "ip"))), "date": of_date, "iban": of_iban, "ssn": of_ssn, "phone": of_phone, "card": of_card}


def pseudonymise(text, key):
    """The text and how many matches changed."""
    changed = 0

    def one(found):
        nonlocal changed
        m = found[0]
        kind = next(k for k, p in pii.PATTERNS.items() if re.fullmatch(p, m, re.A))
        new = MAKERS[kind](m, key)
        changed += new != m
        return new

    if text is None or not re.search(pii.SIGN, text):
        return text, 0
    return re.sub(pii.ANY, one, text, flags=re.A), changed
