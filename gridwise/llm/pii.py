"""PII: format-preserving Feistel pseudonyms.

Card numbers (Luhn), US social security numbers, phone numbers, IPv4 and IPv6 addresses, IBANs (mod 97), e-mail
addresses and calendar dates are found, validated and replaced by another value of the same format: the
value's index among all values of that format goes through a keyed Feistel permutation (walked back into range).
The same value gets the same pseudonym in every document, a valid number stays valid, and restore() with the
key undoes it. Separators, country codes, e-mail domains and letter case stay. Digits that are
not valid as any of these stay as they are. The key is an argument without a default.

Cards are one run of digits, groups of four of which the last may be shorter, or 4-6-5 and 4-6-4; IBANs one run or
groups of four. A phone number is its country code (by the ITU's prefixes; 1 where none is written) and its national
digits, however they are grouped, so that all ways to write one number share a pseudonym. Dates of either order of day and
month are told apart where they can be: 03/04/2020 is the third of April, 03/14/2020 the fourteenth of March and stays
such a date. Letters of an e-mail's local part change within their alphabet; other alphabets than Latin, Greek and
Cyrillic stay. Of an IPv6 address digits become digits and letters letters.

Where matches of several kinds overlap, the first to begin wins, then the kind's order in KINDS. A card number or
an IBAN may be followed by groups that look like more of it (an expiry date, a security code, a short word): its
groups are tried from the fewest on, and the first valid ones are taken. Pseudonyms of longer ones are walked on
until no fewer groups of them are valid, so that restore() finds the same ones. What still comes back wrong is a card
right after a group of four digits that together with its pseudonym happens to be valid (1 of 6,000 composed texts).

Null texts stay null, empty texts empty; a text of any length is read whole, as one string; repeated rows are treated
alike and each keep a row; empty tables give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridwise.llm.common import read

ROUNDS = 10
KINDS = ("email", "iban", "card", "ssn", "date", "ip", "phone")
_FORMS = {
    "email": r"(?<![\w.+-])[^\W_][\w.%+-]*@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}",
    "iban": r"\b[A-Za-z]{2}\d{2}(?:(?P<iban_>[ -]?)[A-Za-z0-9]{4}(?:(?P=iban_)[A-Za-z0-9]{4}){1,6})(?:(?P=iban_)[A-Za-z0-9]{1,3})?\b",
    "card": r"(?<!\d)(?<!\d[.-])(?<!\+)(?:\d{4}(?P<card_>[ .-])\d{4}(?P=card_)\d{4}(?P=card_)\d{1,4}(?:(?P=card_)\d{1,3})?|\d{4}(?P<amex_>[ -])\d{6}(?P=amex_)\d{4,5}|\d{13,19})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])|(?<![\d-])(?<!\d )\d{3} \d{2} \d{4}(?![\d-]| \d)",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)|(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d|\.\d)|(?<![\d+])\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
    r"|(?<![\w.+-])(?:1[.-])?[2-9]\d{2}(?P<phone_>[.-])[2-9]\d{2}(?P=phone_)\d{4}(?![\w-]|\.\d)|(?<![\w.+-])(?<!\d )(?:1 )?[2-9]\d{2} [2-9]\d{2} \d{4}(?![\w-]|\.\d| \d)",
}
_EACH = {kind: re.compile(_FORMS[kind]) for kind in KINDS}
_PATTERN = re.compile("|".join(f"(?:{_FORMS[kind]})" for kind in KINDS))
#: Letters and digits of the kinds whose groups are tried from the fewest on, and what separates groups.
_GROUPED, _BETWEEN = {"card": (13, 19), "iban": (15, 34)}, " .-"
#: Country codes of one and two digits; all others have three. (Fixed values.)
_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


# ---- the permutation -----------------------------------------------------------------------------


def _f(key: bytes, tweak: str, size: int, r: int, x: int, modulus: int) -> int:
    h = hashlib.blake2b(f"{tweak}/{size}/{r}/{x}".encode(), key=key, digest_size=32).digest()
    return int.from_bytes(h, "big") % modulus


def permute(x: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """x's place under a keyed permutation of 0..size-1; back: the inverse."""
    if size < 2:
        return x
    half = max(1, (size - 1).bit_length() + 1 >> 1)
    mod, mask = 1 << half, (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        if back:
            for r in reversed(range(ROUNDS)):
                left, right = right ^ _f(key, tweak, size, r, left, mod), left
        else:
            for r in range(ROUNDS):
                left, right = right, left ^ _f(key, tweak, size, r, right, mod)
        x = left << half | right
        if x < size:
            return x


# ---- formats: each value's index among those of its format, and the value of an index ---------------


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _refill(shape: str, values: str) -> str:
    """shape with its letters and digits replaced by values, in order."""
    it = iter(values)
    return "".join(next(it) if c.isascii() and c.isalnum() else c for c in shape)


def _letters(first: str, last: str, but: str = "") -> str:
    return "".join(chr(c) for c in range(ord(first), ord(last) + 1) if chr(c) not in but)


_ALPHABETS = ("0123456789", _letters("a", "z"), _letters("A", "Z"), _letters("\xdf", "\xff", "\xf7"), _letters("\xc0", "\xde", "\xd7"), _letters("α", "ω"), _letters("Α", "Ω", "\u03a2"), _letters("а", "я"), _letters("А", "Я"))
_CLASS = {c: a for a in _ALPHABETS for c in a}
_HEX = {c: a for a in ("0123456789", "abcdef", "ABCDEF") for c in a}


def _mixed(text: str, key: bytes, tweak: str, back: bool, of: dict[str, str] = _CLASS) -> str:
    """Each digit, small and capital letter becomes another of its class, as one number in mixed radix."""
    classes = [of[c] for c in text]
    x, size = 0, 1
    for c, a in zip(text, classes, strict=True):
        x, size = x * len(a) + a.index(c), size * len(a)
    x, out = permute(x, size, key, tweak, back), []
    for a in reversed(classes):
        x, i = divmod(x, len(a))
        out.append(a[i])
    return "".join(reversed(out))


def _email(value: str, key: bytes, back: bool) -> str | None:
    local, domain = value.split("@")
    it = iter(_mixed("".join(c for c in local if c in _CLASS), key, "email/" + domain.lower(), back))
    return "".join(next(it) if c in _CLASS else c for c in local) + "@" + domain


def ends(kind: str, value: str) -> list[int]:
    """Where a match may end: after each of its groups that makes it long enough, else at its own end."""
    if kind not in _GROUPED:
        return [len(value)]
    least, most = _GROUPED[kind]
    stops = [i for i, c in enumerate(value) if c in _BETWEEN] + [len(value)]
    return [e for e in stops if least <= sum(c not in _BETWEEN for c in value[:e]) <= most]


def _is_card(value: str) -> bool:
    digits = re.sub(r"\D", "", value)
    return luhn_digit(digits[:-1]) == digits[-1]


def _card(value: str, key: bytes, back: bool) -> str | None:
    if not _is_card(value):
        return None
    digits = re.sub(r"\D", "", value)
    n = len(digits) - 1
    while True:
        body = f"{permute(int(digits[:-1]), 10**n, key, 'card', back):0{n}d}"
        digits = body + luhn_digit(body)
        new = _refill(value, digits)
        if not any(_is_card(new[:e]) for e in ends("card", new)[:-1]):
            return new


def _ssn(value: str, key: bytes, back: bool) -> str | None:
    area, group, serial = map(int, re.split("[ -]", value))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(permute(x, 898 * 99 * 9999, key, "ssn", back), 9999)
    area, group = divmod(x, 99)
    return _refill(value, f"{area + 1 + (area >= 665):03d}{group + 1:02d}{serial + 1:04d}")


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _day(value: str, form: str) -> int | None:
    """The number of a date from 1900 to 2099 in a form."""
    try:
        day = datetime.datetime.strptime(value, form).date().toordinal()
    except ValueError:
        return None
    return day if _FIRST <= day <= _LAST else None


def _date(value: str, key: bytes, back: bool) -> str | None:
    if value[4] in "-/":
        form, other = f"%Y{value[4]}%m{value[4]}%d", None
    else:
        form, other = f"%d{value[2]}%m{value[2]}%Y", "%m/%d/%Y" if value[2] == "/" else None
    day = _day(value, form)
    if day is None and other:
        form, other, day = other, form, _day(value, other)
    else:
        other = None
    while day is not None:
        day = _FIRST + permute(day - _FIRST, _LAST - _FIRST + 1, key, "date", back)
        new = datetime.date.fromordinal(day).strftime(form)
        if other is None or _day(new, other) is None:  # the month first only where it can't be read otherwise
            return new
    return None


def _ip(value: str, key: bytes, back: bool) -> str | None:
    if ":" in value:
        if value.count(":") - ("::" in value) > 7:
            return None
        return _refill(value, _mixed(value.replace(":", ""), key, "ip/6", back, _HEX))
    parts = value.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _is_iban(value: str) -> bool:
    plain = re.sub("[ -]", "", value).upper()
    return iban_check(plain[:2], plain[4:]) == plain[2:4]


def _iban(value: str, key: bytes, back: bool) -> str | None:
    if not _is_iban(value):
        return None
    plain = re.sub("[ -]", "", value).upper()
    country, rest = plain[:2], plain[4:]
    while True:
        rest = _mixed(rest, key, "iban/" + country, back)
        new = _refill(value, country + iban_check(country, rest) + rest)
        new = "".join(c.lower() if old.islower() else c for c, old in zip(new, value, strict=True))
        if not any(_is_iban(new[:e]) for e in ends("iban", new)[:-1]):
            return new


def _american(digits: str) -> bool:
    """Area code and exchange do not begin with 0 or 1."""
    return len(digits) == 10 and digits[0] > "1" and digits[3] > "1"


def _phone(value: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", value)
    if value[0] == "+":
        code = next((c for c in _CODES if digits.startswith(c)), digits[:3])
    else:
        code = "1" if len(digits) == 11 else ""
    digits, kept = digits[len(code) :], code
    code = code or "1"
    if code == "1" and _american(digits):
        x = ((int(digits[:3]) - 200) * 800 + int(digits[3:6]) - 200) * 10_000 + int(digits[6:])
        x, line = divmod(permute(x, 800 * 800 * 10_000, key, "phone", back), 10_000)
        area, exchange = divmod(x, 800)
        return _refill(value, f"{kept}{area + 200}{exchange + 200}{line:04d}")
    if not 7 <= len(digits) <= 14:
        return None
    while True:
        digits = f"{permute(int(digits), 10 ** len(digits), key, 'phone/' + code, back):0{len(digits)}d}"
        if code != "1" or not _american(digits):
            return _refill(value, kept + digits)


_REPLACE: dict[str, Callable[[str, bytes, bool], str | None]] = {"email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "date": _date, "ip": _ip, "phone": _phone}


@lru_cache(maxsize=100_000)
def _pseudonym(kind: str, value: str, key: bytes, back: bool) -> str | None:
    return _REPLACE[kind](value, key, back)


def pseudonymise(text: str, key: str, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind."""
    counts: dict[str, int] = {}
    if not re.search("[0-9@]", text):
        return text, counts
    secret, out, at, pos = hashlib.sha256(key.encode()).digest(), [], 0, 0
    while m := _PATTERN.search(text, pos):
        for kind in KINDS:
            found = _EACH[kind].match(text, m.start())
            tried = ((e, _pseudonym(kind, found[0][:e], secret, back)) for e in (ends(kind, found[0]) if found else ()))
            end, new = next((x for x in tried if x[1] is not None), (0, None))
            if new is not None:
                counts[kind] = counts.get(kind, 0) + 1
                out += [text[at : m.start()], new]
                at = pos = m.start() + end
                break
        else:  # valid as none: look again after its first run of letters and digits
            pos = m.start() + max(1, len(re.match(r"[\w+]*", m[0])[0]))
    return "".join([*out, text[at:]]), counts


def restore(text: str, key: str) -> str:
    """The text before pseudonymise() with the same key."""
    return pseudonymise(text, key, back=True)[0]


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """Each row of docs(doc_id, text): doc_id, text with pseudonyms, n_replaced, and a count of each kind."""
    names = ["doc_id", "text", "n_replaced", *(f"n_{k}" for k in KINDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                made = [(t, {}) if t is None else pseudonymise(t, key) for t in part.column(1).to_pylist()]
                counts = [pa.array([c.get(k, 0) for _, c in made], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t for t, _ in made], pa.string()), pa.array([sum(c.values()) for _, c in made], pa.int64()), *counts], names)

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(run, "doc_id long, text string, n_replaced long, " + ", ".join(f"n_{k} long" for k in KINDS))


@lru_cache(maxsize=1)
def _drawn_key() -> str:
    return secrets.token_hex(32)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the key of spark.gridwise.pii.key; where that is unset, with one drawn for this driver."""
    return pseudonymised(read(spark, sf_dir, "documents"), spark.conf.get("spark.gridwise.pii.key", None) or _drawn_key())
