"""Equal values stay linked whatever their notation, and the table form of the operator."""

import ipaddress
import re

import pytest

from pointloom.llm import pii

KEY = b"key"


def one(text):
    new, found = pii.pseudonymise(text, KEY)
    assert sum(found.values()) == 1, (text, found)
    return new


def numbers(s):
    return tuple(map(int, re.findall(r"\d+", s)))


def test_dates_are_linked_across_notations():
    months = {n.lower(): i % 12 + 1 for names in pii._MONTHS for i, n in enumerate(names)}
    for y, m, d in ((2024, 3, 5), (2024, 3, 25), (1968, 12, 12), (2000, 2, 29)):
        want = numbers(one(f"{y}-{m:02d}-{d:02d}"))
        assert want != (y, m, d)
        for form in ("{y}/{m:02d}/{d:02d}", "{y}.{m}.{d}"):
            assert numbers(one(form.format(y=y, m=m, d=d))) == want
        assert numbers(one(f"{d:02d}.{m:02d}.{y}"))[::-1] == want
        us = numbers(one(f"{m:02d}/{d:02d}/{y}"))
        assert (us[2], us[0], us[1]) == want
        if y >= 2000:
            short = numbers(one(f"{m:02d}/{d:02d}/{y % 100:02d}"))
            assert (2000 + short[2], short[0], short[1]) == want
        for names in (pii._MONTHS[0], pii._MONTHS[2], pii._MONTHS[4]):
            new = re.fullmatch(r"(\d+) (\S+) (\d+)", one(f"{d} {names[m - 1]} {y}"))
            assert (int(new[3]), months[new[2].lower()], int(new[1])) == want


def test_dates_are_permuted():
    days = [f"{y}-{m:02d}-{d:02d}" for y in (1999, 2000, 2001) for m in range(1, 13) for d in range(1, 29)]
    new = [one(x) for x in days]
    assert len(set(new)) == len(days) and not any(a == b for a, b in zip(days, new))


@pytest.mark.parametrize(
    "same",
    [
        ("+353 1 234 5678", "+35312345678", "+353-1-234-5678"),
        ("+44 20 7946 0958", "+442079460958", "+44 (0)20 7946 0958"),
        ("212-555-0187", "(212) 555-0187", "+1 212 555 0187", "1-212-555-0187", "phone: 2125550187"),
        ("+7 495 123 45 67", "+74951234567"),
    ],
)
def test_phone_numbers_are_linked_across_notations(same):
    digits = lambda s: re.sub(r"\D", "", s).removeprefix("440").removeprefix("44")[-10:]
    new = {digits(one(s).replace("(0)", "")) for s in same}
    assert len(new) == 1 and new != {digits(same[0])}


def test_ipv6_addresses_are_linked_and_valid():
    new = {one(s) for s in ("2001:db8::8a2e:370:7334", "2001:0db8:0000:0000:0000:8a2e:0370:7334", "2001:db8:0::8a2e:370:7334")}
    assert len(new) == 1
    assert ipaddress.IPv6Address(new.pop()).compressed.startswith("2001:")
    for t in ("at 12:30:45", "std::map<int>::iterator", "a::b", "::1", "00:1b:44:11:3a:b7"):
        assert pii.pseudonymise(t, KEY) == (t, {})


def test_ten_digits_in_a_row_need_a_word_before_them():
    assert pii.pseudonymise("order 2125550187 shipped", KEY)[1] == {}
    assert pii.pseudonymise("Call me at 2125550187.", KEY)[1] == {"phone": 1}


def test_the_table_form_is_the_text_form(spark):
    rows = [(1, "born 2024-03-05, mail bob@example.com", "x"), (2, "card 4111 1111 1111 1111 and 05.03.2024", None), (3, None, "y"), (4, "", "z"), (None, "born 2024-03-05, mail bob@example.com", "x"), (5, "nothing here", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_date string")
    got = pii.pseudonymise_documents(df, "k").collect()
    raw = __import__("hashlib").blake2b(b"k", digest_size=32).digest()
    for r, (i, t, _) in zip(got, rows, strict=True):
        new, found = (None, {}) if t is None else pii.pseudonymise(t, raw)
        assert (r.doc_id, r.text) == (i, new) and all(r[f"n_{k}"] == found.get(k, 0) for k in pii.KINDS)
    assert got[0].text == got[4].text and got[0].n_date == 1
    assert pii.pseudonymise_documents(df.limit(0), "k").collect() == []
    with pytest.raises(TypeError):
        pii.pseudonymise_documents(df)
