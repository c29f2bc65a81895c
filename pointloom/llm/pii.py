"""Operator 5: format-preserving pseudonyms for personal numbers, dates and addresses."""

from __future__ import annotations

import bisect
import calendar
import hashlib
import ipaddress
import math
import re
import secrets
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import give_back

KINDS = ("email", "card", "iban", "ip", "phone", "ssn", "date", "secret")
ROUNDS = 6


class Feistel:
    """A keyed permutation of 0..n-1 without fixed points (n > 1).

    A mixed-radix Feistel network with cycle walking permutes the range (p); the pseudonym of x is p^-1(p(x) + 1),
    which stays in the range, is one-to-one and never x itself.
    """

    def __init__(self, n: int, key: bytes):
        self.n, self.key = n, key
        self.a = math.isqrt(n - 1) + 1
        self.b = -(-n // self.a)
        self.width = (n.bit_length() + 7) // 8 + 1

    def _f(self, r: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(bytes([r]) + x.to_bytes(self.width, "big"), key=self.key, digest_size=self.width + 8).digest(), "big")

    def _once(self, x: int, back: bool) -> int:
        u, v = divmod(x, self.b)
        if not back:
            for r in range(ROUNDS):
                u, v = v, (u + self._f(r, v)) % (self.a if r % 2 == 0 else self.b)
        else:
            for r in reversed(range(ROUNDS)):
                u, v = (v - self._f(r, u)) % (self.a if r % 2 == 0 else self.b), u
        return u * self.b + v

    def _walk(self, x: int, back: bool) -> int:
        x = self._once(x, back)
        while x >= self.n:
            x = self._once(x, back)
        return x

    def pseudonym(self, x: int) -> int:
        return self._walk((self._walk(x, False) + 1) % self.n, True)

    def original(self, x: int) -> int:
        return self._walk((self._walk(x, False) - 1) % self.n, True)


@lru_cache(16_384)
def _permute(kind: str, n: int, x: int, key: bytes) -> int:
    return Feistel(n, hashlib.blake2b(f"{kind}:{n}".encode(), key=key, digest_size=32).digest()).pseudonym(x) if n > 1 else x


_LOWER, _UPPER, _DIGITS, _HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


def _by_class(kind: str, s: str, key: bytes, classes: tuple[str, ...] = (_LOWER, _UPPER, _DIGITS)) -> str:
    """Permutes the characters of ``s`` that belong to a class, each within its class, as one mixed-radix number."""
    at = [(i, next(c for c in classes if ch in c)) for i, ch in enumerate(s) if any(ch in c for c in classes)]
    n, x = 1, 0
    for i, c in at:
        n, x = n * len(c), x * len(c) + c.index(s[i])
    shape = "".join(str(classes.index(c)) for _, c in at)
    x = _permute(f"{kind}{shape}", n, x, key)
    out = list(s)
    for i, c in reversed(at):
        x, d = divmod(x, len(c))
        out[i] = c[d]
    return "".join(out)


def _put(form: str, digits: str) -> str:
    """``form`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c in _DIGITS else c for c in form)


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _card(s: str, key: bytes) -> str | None:
    d = re.sub("[ -]", "", s)
    if not luhn(d) or len(set(d)) == 1:
        return None
    # the leading digit (network) stays, the check digit follows from the others
    body = d[0] + str(_permute(f"card{d[0]}", 10 ** (len(d) - 2), int(d[1:-1]), key)).zfill(len(d) - 2)
    return _put(s, body + next(c for c in _DIGITS if luhn(body + c)))


def _iban_mod(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _iban(s: str, key: bytes) -> str | None:
    flat = s.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _iban_mod(flat) != 1:
        return None
    body = _by_class(f"iban{flat[:2]}", flat[4:], key)
    new = f"{flat[:2]}{98 - _iban_mod(flat[:2] + '00' + body):02d}{body}"
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in s)


def _ip(s: str, key: bytes) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    x = _permute("ip", 1 << 32, sum(int(p) << 24 - 8 * i for i, p in enumerate(parts)), key)
    return ".".join(str(x >> 24 - 8 * i & 255) for i in range(4))


def _ip6(s: str, key: bytes) -> str | None:
    try:
        x = int(ipaddress.IPv6Address(s))
    except ValueError:
        return None
    # the first 16 bits (the kind of address) stay; equal addresses are equal in all spellings
    if x >> 112 == 0 or not re.search("[0-9]", s):
        return None
    new = str(ipaddress.IPv6Address(x >> 112 << 112 | _permute(f"ip6{x >> 112}", 1 << 112, x & (1 << 112) - 1, key)))
    return new.upper() if s != s.lower() else new


def _ssn(s: str, key: bytes) -> str | None:
    a, g, n = int(s[:3]), int(s[4:6]), int(s[7:])
    if a in (0, 666) or a > 899 or not g or not n:
        return None
    x = _permute("ssn", 898 * 99 * 9999, ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + n - 1, key)
    x, n = divmod(x, 9999)
    a, g = divmod(x, 99)
    a += 1 + (a >= 665)
    return f"{a:03d}-{g + 1:02d}-{n + 1:04d}"


#: Country calling codes of two digits; those that begin with 1 or 7 have one digit, all others three.
_TWO_DIGIT_CODES = {"20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"}


def _phone(s: str, key: bytes) -> str | None:
    """Numbers with the same digits are the same number, however they are grouped; a trunk zero in brackets doesn't count."""
    d = re.sub(r"\D", "", s)
    if s[0] == "+" and d[0] != "1":
        n = 1 if d[0] == "7" else 2 if d[:2] in _TWO_DIGIT_CODES else 3
        code, rest = d[:n], d[n:]
        trunk = "0" if "(0)" in s and rest[0] == "0" else ""
        rest = rest[len(trunk) :]
        if not 8 <= len(code) + len(rest) <= 15:
            return None
        return _put(s, code + trunk + str(_permute(f"tel{code}", 10 ** len(rest), int(rest), key)).zfill(len(rest)))
    code, rest = d[:-10], d[-10:]
    if code not in ("", "1") or len(rest) != 10:
        return None
    if rest[0] in "01":
        return None if not code else _put(s, code + str(_permute("tel1", 10**10, int(rest), key)).zfill(10))
    if rest[3] in "01":
        # area codes keep their range, the rest is free
        x = _permute("nanp0", 800 * 10**7, (int(rest[:3]) - 200) * 10**7 + int(rest[3:]), key)
        return _put(s, code + str(200 + x // 10**7) + str(x % 10**7).zfill(7))
    x = _permute("nanp", 800 * 800 * 10**4, ((int(rest[:3]) - 200) * 800 + int(rest[3:6]) - 200) * 10**4 + int(rest[6:]), key)
    x, n = divmod(x, 10**4)
    a, e = divmod(x, 800)
    return _put(s, f"{code}{a + 200}{e + 200}{n:04d}")


@lru_cache(4)
def _calendar(late: bool, century: int) -> tuple[tuple[tuple[int, int, int], ...], dict[tuple[int, int, int], int]]:
    """The dates of a century whose day is over 12, or those whose day could be a month."""
    days = [(y, m, d) for y in range(century, century + 100) for m in range(1, 13) for d in range(1, calendar.monthrange(y, m)[1] + 1) if (d > 12) == late]
    return tuple(days), {x: i for i, x in enumerate(days)}


def _new_date(y: int, m: int, d: int, key: bytes) -> tuple[int, int, int] | None:
    """The pseudonym of a date of 1900 to 2099, the same in all notations.

    It keeps the century, so that it can be written with two digits, and whether the day is over 12, so that it is read in the same order of day and month.
    """
    if not 1900 <= y < 2100:
        return None
    late, century = d > 12, y // 100 * 100
    days, index = _calendar(late, century)
    if (at := index.get((y, m, d))) is None:
        return None
    return days[_permute(f"date{late}{century}", len(days), at, key)]


def _date(s: str, key: bytes) -> str | None:
    if any(c.isalpha() for c in s):
        return _named_date(s, key)
    sep = next(c for c in s if c not in _DIGITS)
    p = s.split(sep)
    short = all(len(x) < 3 for x in p)
    if len(p[0]) == 4:
        order = (0, 1, 2)
    else:
        a, b = int(p[0]), int(p[1])
        # day first where the first number can't be a month, and with dots unless the second can't
        order = (2, 1, 0) if a > 12 or b <= 12 and sep == "." else (2, 0, 1)
    # a year of two digits is one of 2000 to 2099
    y, m, d = (int(p[i]) for i in order)
    if (new := _new_date(y + 2000 * short, m, d, key)) is None:
        return None
    out = [""] * 3
    padded = any(len(x) == 2 and x[0] == "0" for x in p[: 2 if short else 3]) or all(len(x) != 1 for x in p)
    for i, v in zip(order, new, strict=True):
        out[i] = str(v).zfill(2) if padded else str(v)
    if short:
        out[2] = f"{new[0] % 100:02d}"
    return sep.join(out)


#: Names of months by language, in full and short; of a name that several have, the first counts.
_MONTHS = [x.split() for x in (
    "January February March April May June July August September October November December", "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec",
    "Januar Februar M\u00e4rz April Mai Juni Juli August September Oktober November Dezember", "janvier f\u00e9vrier mars avril mai juin juillet ao\u00fbt septembre octobre novembre d\u00e9cembre",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
)]
_MONTH_OF = {n.lower(): (names, i) for names in reversed(_MONTHS) for i, n in enumerate(names)}
_MONTH = "(?:" + "|".join(sorted(map(re.escape, _MONTH_OF), key=len, reverse=True)) + ")"
_NAMED = re.compile(
    rf"(?P<d1>\d{{1,2}})(?P<o1>\.|st|nd|rd|th|er)?(?P<g1>[ ]of[ ]|[ ]de[ ]|[ -])(?P<m1>{_MONTH})\.?(?P<g2>,?[ ]|[ ]de[ ]|[ ]del[ ]|-)(?P<y1>\d{{4}})(?!\w)"
    rf"|(?P<m2>{_MONTH})(?P<g3>\.?[ ])(?P<d2>\d{{1,2}})(?P<o2>st|nd|rd|th)?(?P<g4>,?[ ])(?P<y2>\d{{4}})(?!\w)",
    re.IGNORECASE,
)


def _named_date(s: str, key: bytes) -> str | None:
    m = _NAMED.fullmatch(s)
    k = "1" if m["m1"] else "2"
    names, month = _MONTH_OF[m["m" + k].lower()]
    if (new := _new_date(int(m["y" + k]), month + 1, int(m["d" + k]), key)) is None:
        return None
    y, mo, d = new
    old, name = m["m" + k], names[mo - 1]
    name = name.lower() if old == old.lower() else name.upper() if old == old.upper() else name.capitalize()
    day = str(d).zfill(2) if m["d" + k][0] == "0" else str(d)
    end = m["o" + k] or ""
    if end == "er":
        end = "er" if d == 1 else ""
    elif end and end != ".":
        end = "th" if 10 < d < 14 else {1: "st", 2: "nd", 3: "rd"}.get(d % 10, "th")
    put = {m.start("m" + k): (m.end("m" + k), name), m.start("d" + k): (m.end("o" + k) if m["o" + k] else m.end("d" + k), day + end), m.start("y" + k): (m.end("y" + k), str(y))}
    out, i = [], 0
    while i < len(s):
        if i in put:
            i, new = put[i]
            out.append(new)
        else:
            out.append(s[i])
            i += 1
    return "".join(out)


def _email(s: str, key: bytes) -> str | None:
    local, _, domain = s.rpartition("@")
    if any(c in _LOWER + _UPPER + _DIGITS for c in local):
        return f"{_by_class('email', local, key)}@{domain}"
    return f"{local}@{_by_class('email', domain.split('.')[0], key)}.{domain.partition('.')[2]}"


def _secret(s: str, key: bytes) -> str | None:
    low = s.lower()
    if not (re.search("[0-9]", low) and re.search("[a-f]", low)):
        return None
    return _by_class("secret", s, key, (_HEX,)) if s == low else _by_class("secret", s, key, (_HEX.upper(),)) if s == s.upper() else _by_class("secret", s, key)


#: A place where a value may begin, to the end of its word.
_START = re.compile(r"(?<!\w)[+(]?[0-9]\w*|(?<!\w)[A-Z]{2}[0-9]{2}\w*")
_FORMS = (
    ("ip", re.compile(r"(?<!\d\.)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)", re.ASCII)),
    ("date", re.compile(r"(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?:(?=T\d)|(?!\w|[-/.]\d))", re.ASCII)),
    ("date", re.compile(r"(?<![-/.])(?:\d{1,2}/\d{1,2}/\d{2}|\d{2}([-.])\d{2}\1\d{2})(?:(?=T\d)|(?!\w|[-/.]\d))", re.ASCII)),
    ("ssn", re.compile(r"\d{3}-\d{2}-\d{4}(?![\w]|-\d)", re.ASCII)),
)
_PHONES = re.compile(r"(?:\+1[\ .-]?|1[\ .-])?(?:\(\d{3}\)[\ .-]?|\d{3}[\ .-])\d{3}[\ .-]?\d{4}|\+\d{1,3}[\ .-]?(?:\(?\d{1,4}\)?[\ .-]?){1,4}\d{2,4}|\+1\d{10}", re.ASCII)
#: Ten digits in a row are a phone number only after a word that says so.
_BARE_US = re.compile(r"[2-9][0-9]{2}[2-9][0-9]{6}(?!\w|[-.]\d)")
_CUE = re.compile(r"\b(?:tel|phone|telephone|call|cell|mobile|fax)\W{1,3}(?:(?:me|us|at|no|number|is)\W{1,2}){0,2}\Z", re.IGNORECASE)
_IP6_RUN = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)")
_PHONE_RUN = re.compile(r"\+?\(?\d(?:[ .()-]{0,3}\d){6,18}", re.ASCII)
_CARD_RUN = re.compile(r"\d(?:[ -]?\d){12,18}", re.ASCII)
_IBAN_RUN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}", re.ASCII)
_CARD_LEAD = re.compile(r"4|5[0-8]|6|3[04-9]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)")
_CARD_GROUPS = re.compile(r"\d{13,19}|\d{4}([ -])(?:\d{4}\1){2}\d{1,4}|\d{4}([ -])(?:\d{4}\2){3}\d{1,3}|\d{4}([ -])\d{6}\3\d{4,5}")
#: Lengths of the IBANs of a country.
_IBAN_LENGTHS = dict((x[:2], int(x[2:])) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 "
    "LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20").split())  # fmt: skip


def _ends(text: str, run: re.Match) -> Iterator[int]:
    """Ends of words of a run, the last first."""
    for b in range(run.end(), run.start(), -1):
        if text[b - 1] not in " .-(" and not (b < len(text) and (text[b].isalnum() or text[b] == "_")):
            yield b


def _candidates(text: str, key: bytes) -> Iterator[tuple[int, int, int, str, str]]:
    """(rank, start, minus the end, kind, pseudonym) of all values that pass their checks; they may overlap, and the least rank is the surest.

    Every word that may begin a value is tried, whether or not one before it passed, with every end that a card, IBAN or phone number may have there.
    """
    # a date in words ends with its year, which is found first: names of months are looked for only before it
    for year in _YEAR.finditer(text):
        for m in _NAMED.finditer(text, max(0, year.start() - 32), year.end()):
            if m.end() == year.end() and not (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_")) and (new := _named_date(m[0], key)):
                yield 0, m.start(), -m.end(), "date", new
    if ":" in text:
        for m in _IP6_RUN.finditer(text):
            if len(m[0]) > 5 and len([x for x in m[0].split(":") if x]) > 2 and (new := _ip6(m[0], key)):
                yield 0, m.start(), -m.end(), "ip", new
    for at in _START.finditer(text):
        a, first = at.start(), text[at.start()]
        if first in _DIGITS:
            for kind, form in _FORMS:
                if (m := form.match(text, a)) and (new := _OF[kind](m[0], key)):
                    yield 0, a, -m.end(), kind, new
            if run := _CARD_RUN.match(text, a):
                # other groupings and unknown networks only where they are the whole of their run of digits
                alone = not (a > 1 and text[a - 1] in " -" and text[a - 2] in _DIGITS)
                whole = not re.compile(r"[ -]?\w").match(text, run.end())
                for b in _ends(text, run):
                    s = text[a:b]
                    sure = _CARD_GROUPS.fullmatch(s) and _CARD_LEAD.match(s)
                    if (sure or alone and (whole and b == run.end() or _CARD_GROUPS.fullmatch(s))) and sum(map(str.isdigit, s)) >= 13 and (new := _card(s, key)):
                        yield 0 if sure else 2, a, -b, "card", new
        if first.isalpha():
            if run := _IBAN_RUN.match(text, a):
                for b in _ends(text, run):
                    if new := _iban(text[a:b], key):
                        yield 0 if _IBAN_LENGTHS.get(text[a : a + 2]) == len(text[a:b].replace(" ", "")) else 1, a, -b, "iban", new
        elif (bare := _BARE_US.match(text, a)) and _CUE.search(text[max(0, a - 24) : a]) and (new := _phone(bare[0], key)):
            yield 1, a, -bare.end(), "phone", new
        elif run := _PHONE_RUN.match(text, a):
            for b in _ends(text, run):
                if _PHONES.fullmatch(text, a, b) and (new := _phone(text[a:b], key)):
                    yield 1, a, -b, "phone", new
                    break


def _numbers(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """Values of the text that don't overlap: the surest first, of equal ones the first, and the longest."""
    taken: list[tuple[int, int, str, str]] = []
    for _, a, b, kind, new in sorted(_candidates(text, key)):
        k = bisect.bisect(taken, (a,))
        if (not k or taken[k - 1][1] <= a) and (k == len(taken) or taken[k][0] >= -b):
            taken.insert(k, (a, -b, kind, new))
    return taken


_SECRETS = re.compile(r"(?i:token|secret|passw(?:or)?d|api[_ -]?key|key)(?:[ ]{0,3}[=:][ ]{0,3})[\"']?([0-9A-Fa-f]{24,128})(?![0-9A-Za-z])")
_DIGIT_SEEN = re.compile("[0-9]")
_YEAR = re.compile(r"(?<=[ -])(?:19|20)[0-9]{2}(?!\w)")
_OF = {"card": _card, "iban": _iban, "ip": _ip, "ssn": _ssn, "phone": _phone, "date": _date}


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Places of addresses, found from their @ outwards, so that long runs of letters cost nothing."""
    at = text.find("@")
    while at >= 0:
        a = at
        while a and at - a < 64 and (text[a - 1].isalnum() or text[a - 1] in "._%+-"):
            a -= 1
        while a < at and text[a] in ".-":
            a += 1
        m = re.compile(r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,63}").match(text, at + 1)
        if m and a < at:
            yield a, m.end()
        at = text.find("@", max(at + 1, m.end() if m else 0))


def pseudonymise(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and the number of each kind that was found."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(a, b, "email", new) for a, b in _emails(text) if (new := _email(text[a:b], key))]
    if _DIGIT_SEEN.search(text):
        found += [(*m.span(1), "secret", new) for m in _SECRETS.finditer(text) if (new := _secret(m[1], key))]
        found += _numbers(text, key)
    if not found:
        return text, {}
    out, end, counts = [], 0, {}
    for a, b, kind, new in sorted(found):
        if a >= end:
            out += (text[end:a], new)
            end = b
            counts[kind] = counts.get(kind, 0) + 1
    return "".join([*out, text[end:]]), counts


_own_keys: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The key of the session: spark.pointloom.pseudonym.key, which must be kept secret and gives the same pseudonyms in every run; where it is unset, a random
    one that lives as long as the application."""
    if key := spark.conf.get("spark.pointloom.pseudonym.key", None):
        return key
    return _own_keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def pseudonymise_documents(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and a column n_<kind> (int) for each of KINDS.

    Card numbers (Luhn), IBANs (mod 97), IP addresses, US social security numbers, phone numbers, calendar dates of 1900 to 2099 (in figures, with two-digit years, or with English, German, French or Spanish month names),
    e-mail addresses and hexadecimal secrets after a word such as token are replaced by others of the same form,
    with valid check digits, by a keyed one-to-one map: equal values stay equal in all documents, different ones
    different, and none stays as it is. Dates, phone numbers and IP addresses are mapped by value, so they stay linked across notations. Whoever has ``key`` can undo the map. What fails its check is left alone.

    Null texts stay null, empty ones empty, and all other columns (a null doc_id, too) are kept; columns named n_<kind> are replaced. One pass, no shuffle.
    """
    raw = hashlib.blake2b(key.encode(), digest_size=32).digest()
    names = [f"n_{k}" for k in KINDS]

    @F.arrow_udf(f"struct<text:string,{','.join(f'{n}:int' for n in names)}>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in texts:
            new, counts = [], {k: [] for k in KINDS}
            for x in col:
                x = x.as_py()
                t, c = (None, {}) if x is None else pseudonymise(x.decode("utf-8", "replace"), raw)
                new.append(t)
                for k in KINDS:
                    counts[k].append(c.get(k, 0))
            yield pa.StructArray.from_arrays([pa.array(new, pa.string()), *(pa.array(counts[k], pa.int32()) for k in KINDS)], ["text", *names])
        give_back()

    docs = docs.drop(*names)
    t = docs.withColumn("_pii", of(F.col(text).cast("binary")))
    return t.select(*[F.col("_pii.text").alias(text) if c == text else F.col(c) for c in docs.columns], *[F.col(f"_pii.{n}").alias(n) for n in names])
