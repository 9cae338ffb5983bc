"""Personal data beside what looks like more of it, against values that are put in one by one."""

import datetime
import random

import pytest

from gridwise.llm import pii

BESIDE = [
    ("4111 1111 1111 1111 12/25", "4111 1111 1111 1111", "card"),
    ("4111111111111111 123", "4111111111111111", "card"),
    ("4111-1111-1111-1111-999", "4111-1111-1111-1111", "card"),
    ("3782 822463 10005 1234", "3782 822463 10005", "card"),
    ("ES91 2100 0418 4502 0005 1332 BIC", "ES91 2100 0418 4502 0005 1332", "iban"),
    ("GB82WEST12345698765432 AB1", "GB82WEST12345698765432", "iban"),
    ("call 555-223-4567 now", "555-223-4567", "phone"),
    ("call 1-555-223-4567.", "1-555-223-4567", "phone"),
    ("at 555.223.4567", "555.223.4567", "phone"),
]


@pytest.mark.parametrize("text,value,kind", BESIDE)
def test_values_beside_more_characters(text, value, kind):
    for key in map(str, range(60)):
        new, counts = pii.pseudonymise(text, key)
        assert counts == {kind: 1} and value not in new and len(new) == len(text)
        before, after = text.split(value)
        assert new.startswith(before) and new.endswith(after)
        assert pii.restore(new, key) == text
        alone = pii.pseudonymise(value, key)[0]
        assert new == before + alone + after  # the same value, the same pseudonym


def test_numbers_that_are_not_valid_stay():
    for text in ("155-223-4567", "555-123-456", "555-223.4567", "x555-223-4567", "555-223-45678", "4111 1111 1111 1112 12/25", "ES92 2100 0418 4502 0005 1332 BIC"):
        assert pii.pseudonymise(text, "k") == (text, {})


def _made(rng, kind):
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "card":
        body = "4" + digits(rng.choice([14, 14, 12, 17]))
        whole = body + pii.luhn_digit(body)
        return whole if rng.random() < 0.5 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))
    if kind == "iban":
        rest = rng.choice(["", "ABCD"]) + digits(18)
        whole = "DE" + pii.iban_check("DE", rest) + rest
        return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if rng.random() < 0.5 else whole
    if kind == "ssn":
        return f"{rng.randrange(1, 600):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10_000):04d}"
    if kind == "date":
        return f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"
    if kind == "ip":
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == "email":
        return f"a{digits(3)}.Bc@host{digits(1)}.example.org"
    return f"{rng.randrange(200, 1000)}-{rng.randrange(200, 1000)}-{digits(4)}"


def test_every_planted_value_goes_and_comes_back():
    """Brute force: texts are built from values and plain words, so what must be found is known."""
    rng = random.Random(3)
    for n in range(300):
        parts = []
        for _ in range(rng.randrange(1, 9)):
            kind = rng.choice(pii.KINDS)
            parts.append((kind, _made(rng, kind)))
        text = "; ".join(f"word {v} end" for _, v in parts)
        want: dict[str, int] = {}
        for kind, _ in parts:
            want[kind] = want.get(kind, 0) + 1
        new, counts = pii.pseudonymise(text, f"key{n}")
        assert counts == want, text
        assert pii.restore(new, f"key{n}") == text
        for (kind, value), now in zip(parts, new.split("; "), strict=True):
            assert now[5:-4] == pii.pseudonymise(value, f"key{n}")[0], kind


def test_key_is_needed():
    with pytest.raises(TypeError):
        pii.pseudonymise("x 10.0.0.1")


def test_long_text_and_other_columns(spark):
    text = "word " * 200_000 + "10.0.0.255"
    rows = spark.createDataFrame([(1, text, 5, "a"), (1, text, 5, "a"), (None, None, None, None)], "doc_id long, text string, n_ip int, n_replaced string")
    got = sorted((r["doc_id"] is None, r["n_replaced"], r["n_ip"], len(r["text"] or "")) for r in pii.pseudonymised(rows, "k").collect())
    assert [g[:3] for g in got] == [(False, 1, 1), (False, 1, 1), (True, 0, 0)] and abs(got[0][3] - len(text)) <= 5


def _day(rng):
    return datetime.date(1950, 1, 1) + datetime.timedelta(rng.randrange(40_000))


def test_neighbouring_dates_stay_dates():
    rng = random.Random(1)
    for n in range(2_000):
        days = [_day(rng) for _ in range(2)]
        text = f"open {days[0]} {days[1]} daily"
        new, counts = pii.pseudonymise(text, f"k{n}")
        assert counts == {"date": 2} and pii.restore(new, f"k{n}") == text
        for old, now in zip(days, new.split()[1:3], strict=True):
            assert now == pii.pseudonymise(str(old), f"k{n}")[0] and datetime.date.fromisoformat(now)


SIDE = {
    "phone": ["(%d) %d-%04d", "+1 %d-%d-%04d", "+1%d%d%04d", "%d %d %04d", "+44 %d %d %04d", "+49%d%d%04d"],
    "date": ["%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d", "%d.%m.%Y"],
    "ip": ["2001:db8::%x:%x", "fe80::%x:2%x", "1:2:3:4:5:6:%x:%x"],
}


def test_composed_texts_come_back():
    """All kinds side by side, in all their forms. At most one of a thousand may differ (see the module)."""
    rng, wrong, n = random.Random(5), 0, 3_000
    for k in range(n):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.choice(pii.KINDS)
            value = _made(rng, kind)
            if rng.random() < 0.4 and kind in SIDE:
                form = rng.choice(SIDE[kind])
                value = _day(rng).strftime(form) if kind == "date" else form % ((rng.randrange(200, 1000), rng.randrange(200, 1000), rng.randrange(10_000)) if kind == "phone" else (rng.randrange(65_536), rng.randrange(4_096)))
            elif rng.random() < 0.3 and kind == "iban":
                value = value.replace(" ", "-").lower()
            parts.append(rng.choice([" ", ", ", "; ", "\n", " and ", "/", ": "]) + value)
        text = "".join(parts)
        wrong += pii.restore(pii.pseudonymise(text, f"k{k}")[0], f"k{k}") != text
    assert wrong <= n // 1000


ONE_NUMBER = ["(212) 555-1234", "(212)555-1234", "212-555-1234", "212.555.1234", "212 555 1234", "+1 212-555-1234", "+12125551234", "+1 (212) 555-1234", "1-212-555-1234", "1 212 555 1234"]


def test_ways_to_write_one_number_share_a_pseudonym():
    digits = lambda t: "".join(c for c in t if c.isdigit())[-10:]
    for key in ("a", "b"):
        made = {pii.pseudonymise(f"call {t} now", key)[0] for t in ONE_NUMBER}
        assert len({digits(m) for m in made}) == 1 and len(made) == len(ONE_NUMBER) and digits(made.pop()) != "2125551234"
        german = [pii.pseudonymise(t, key)[0] for t in ("+49 30 1234567", "+49301234567", "+49-30-123-4567")]
        assert len({digits(g) for g in german}) == 1 and all(g.startswith("+49") for g in german)


@pytest.mark.parametrize("text,kind", [
    ("order-4111111111111111", "card"), ("no.4111111111111111", "card"), ("4111111111111111-", "card"), ("4111.1111.1111.1111", "card"), ("es91-2100-0418-4502-0005-1332", "iban"), ("gb82west12345698765432", "iban"),
    ("01/31/1990", "date"), ("31/01/1990", "date"), ("2020/01/31", "date"), ("123 45 6789", "ssn"), ("2001:0db8:85a3:0000:0000:8a2e:0370:7334", "ip"), ("FE80::1:2A", "ip"), ("jürgen.ölz@example.org", "email"), ("ИВАН.иванов7@example.org", "email"),
])
def test_forms(text, kind):
    for key in map(str, range(40)):
        new, counts = pii.pseudonymise(f"see {text} there", key)
        assert counts == {kind: 1} and len(new) == len(text) + 10 and pii.restore(new, key) == f"see {text} there"
        assert [c.isupper() for c in new] == [c.isupper() for c in f"see {text} there"]


def test_what_is_none_of_these_stays():
    for text in ("at 12:30:45 and 10:20", "1234 5678 9012", "2021-0117", "13/13/2020", "212 555 1234 99", "123 45 6789 0", "a::b", "ratio 3:4:5", "1.2.3.4.5", "in20 ways", "12 345 6789"):
        assert pii.pseudonymise(text, "k") == (text, {}), text
