"""Personal values next to other numbers, and dates in words."""

import random

import pytest

from pointloom.llm import pii

KEY = b"k"


@pytest.mark.parametrize(
    ("text", "clear", "kinds"),
    [
        ("212-555-0187 212-555-0199", ("212-555-0187", "212-555-0199"), {"phone": 2}),
        ("212-555-0187 2024", ("212-555-0187",), {"phone": 1}),
        ("12 4111 1111 1111 1111", ("4111 1111 1111 1111",), {"card": 1}),
        ("4111 1111 1111 1111 123", ("4111 1111 1111 1111",), {"card": 1}),
        ("4111111111111111 12/25", ("4111111111111111",), {"card": 1}),
        ("4111111111111111 5500005555555559", ("4111111111111111", "5500005555555559"), {"card": 2}),
        ("ES91 2100 0418 4502 0005 1332 2024", ("ES91 2100 0418 4502 0005 1332",), {"iban": 1}),
        ("ES91 2100 0418 4502 0005 1332 IN", ("ES91 2100 0418 4502 0005 1332",), {"iban": 1}),
        ("+44 20 7946 0958 2024", ("+44 20 7946 0958",), {"phone": 1}),
        ("2024-01-05T10:00", ("2024-01-05",), {"date": 1}),
        ("on 5 January 2024", ("5 January 2024",), {"date": 1}),
        ("on March 3rd, 1999 and 7. Oktober 2011", ("March 3rd, 1999", "7. Oktober 2011"), {"date": 2}),
        ("el 5 de enero de 2024", ("5 de enero de 2024",), {"date": 1}),
        ("on 31/12/99", ("31/12/99",), {"date": 1}),
    ],
)
def test_values_are_found_whatever_stands_next_to_them(text, clear, kinds):
    new, found = pii.pseudonymise(text, KEY)
    assert found == kinds and not any(c in new for c in clear)
    assert pii.pseudonymise(new, KEY)[1] == kinds


def test_rows_of_years_and_versions_stay():
    for t in ("2019 2020 2021 2022", "v 1.2.24 of 10", "99/99/99", "31 February 2024", "May 2024", "1234 5678"):
        assert pii.pseudonymise(t, KEY) == (t, {})


def test_dates_map_one_to_one():
    days = [f"{d:02d}/{m:02d}/{y:02d}" for y in (0, 24, 99) for m in range(1, 13) for d in range(13, 29)]
    assert len({pii.pseudonymise(x, KEY)[0] for x in days}) == len(days)


def test_long_texts_of_numbers_take_linear_time():
    rng = random.Random(4)
    text = " ".join(str(rng.randrange(10 ** rng.randint(1, 6))) for _ in range(20_000))
    assert pii.pseudonymise(text + " 4111 1111 1111 1111", KEY)[1].get("card", 0) >= 1
