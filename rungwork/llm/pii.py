"""Problem 2: personal information inside free text, and keyed pseudonyms in its place."""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwork.session import materialize, spread, table

#: Share of all words from which a word is known to the vocabulary; it holds at most one over it.
KNOWN_SHARE = 5e-7
#: A word is of a place, house or street if this share of its capitalised occurrences follows a word of place.
PLACED = 0.15
#: Share of its occurrences in lower case from which a word is ordinary, and within a sentence from which it is a name.
ORDINARY, INSIDE = 0.6, 0.2
#: Each share is taken as if so many occurrences more without the sign had been seen, so few of them prove little.
DOUBT_PLACED, DOUBT_ORDINARY, DOUBT_INSIDE = 4.0, 1.5, 1.0
#: Distinct words of a partition that are counted before they are passed on.
COUNTED = 500_000

#: Setting with the key of the pseudonyms.
KEY_SETTING = "spark.rungwork.pseudonymKey"
_OWN_KEY = secrets.token_bytes(32)

ORDINARY_WORD, PLACE_WORD, OPENER, NAME_WORD = "o", "f", "s", "n"

_MAIL_DOT = r"(?:\.|\s?[\[(]dot[\])]\s?|\sdot\s)"
_EMAIL = re.compile(
    rf"(?<![\w.+-])[\w+-]+(?:[.][\w+-]+)*@[\w-]+(?:\.[\w-]+)+"
    rf"|(?<![\w.+-])[\w+-]+(?:[.][\w+-]+|\s?[\[(]dot[\])]\s?[\w+-]+)*\s?[\[(]at[\])]\s?[\w-]+(?:{_MAIL_DOT}[\w-]+)+"
    rf"|(?<![\w.+-])[\w+-]+(?:\sdot\s[\w+-]+)*\sat\s[\w-]+(?:\sdot\s[\w-]+)+(?!\s(?:at|dot)\s)",
    re.IGNORECASE,
)
_TYPES = r"street|st|avenue|ave|road|rd|lane|ln|court|ct|place|pl|terrace|ter|row|way|boulevard|blvd|drive|dr|square|sq|close|crescent|alley|parkway|highway"
_STREET = re.compile(
    rf"(?<![\w.,:/$-])\d{{1,5}}[a-z]?,?\s+(?:(?:[nsew]\.|north|south|east|west)\s+)?[^\W\d_][\w'’]*(?:\s+[A-Z][\w'’]*)?\s+(?-i:(?i:{_TYPES}))(?!\w)",
    re.IGNORECASE,
)
_BOX = re.compile(r"(?<!\w)(?:p\.?\s?o\.?|post office)\s+box\s+\d{1,6}(?!\w)", re.IGNORECASE)
#: What may stand before a house number and belongs to it.
_NUMBERED = re.compile(r"(?:(?<!\w)(?:no|nr|number)\.?\s+|#\s?)$", re.IGNORECASE)
_UNIT = re.compile(r"\.?,?\s+(?:apt|apartment|unit|suite|ste|flat|room|#)\.?\s*#?\s?\d{1,5}[a-z]?(?!\w)", re.IGNORECASE)
_PLACE = re.compile(r"\.?,\s+([^\W\d_][\w'’]*(?:\s+[^\W\d_][\w'’]*){0,2})")
_POST = re.compile(r",?\s+\d{5}(?:-\d{4})?(?![\w-])")
_FOREIGN = re.compile(
    r"(?<![\w.,:/$-])\d{1,4}(?:\s?bis)?,?\s+(?i:rue|quai|calle|via|rua|avenida|avenue|boulevard|plaza|piazza|place)\s+(?:(?:de|des|du|del|della|la|le|les|los|las|di|da|do|dos)\s+|[ld]['’])*[A-Z][\w'’]*(?:\s+[A-Z][\w'’]*)?"
)
_ID = re.compile(
    r"(?<![\w/.-])(?:(?P<register>[A-Z]{2}-\d{4}-\d{4,6}-[A-Z])|(?P<file>\d{2}/\d{5,7}/[A-Z])|(?P<tax>\d{3}([- ])\d{2}\4\d{4})|(?P<licence>[A-Z] \d{3} \d{3} \d{2})|(?P<passport>[A-Z]\d{7,8}|[A-Z]{2}\d{7})"
    r"|(?P<insurance>[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D])|(?P<card>\d{4}([- ]?)\d{4}\9\d{4}\9\d{3,4})|(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?))(?![\w/-])",
    re.IGNORECASE,
)
_PHONE = re.compile(
    r"(?<![\w/.$+-])(?:\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?(?:\(\d{1,5}\)|\d{1,5})(?:[ .-]?\d{2,8}){1,5}|(?:1[ .-])?(?:\(\d{3,5}\)[ .-]?\d{3}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})"
    r"|\(0\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|0\d{4} \d{6}|0\d{4} \d{3} \d{3}|0\d{3} \d{6}|0\d{3} \d{3} \d{3,4}|0\d{1,2} \d{4} \d{4}|0\d(?:[ .-]\d\d){4}|\d{3}-\d{4}|\d{10,11})(?![\w/-])"
    r"(?:,?\s*(?:ext\.?|extension|x)\s*\d{1,5}(?!\w))?",
    re.IGNORECASE,
)
_EXTENSION = re.compile(r",?\s*(?:ext\.?|extension|x)\s*\d{1,5}$", re.IGNORECASE)
#: First digits of the country prefixes of one and of two digits; all others have three.
_ONE, _TWO = frozenset("17"), frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: First digits of the prefixes of three.
_THREE = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = "|".join(f"{m[:3]}(?:{m[3:]})?\\.?" if m[3:] else m for m in _MONTHS) + r"|sept\.?"
_DATE = re.compile(
    rf"(?<![\w/.-])(?:(?P<m1>{_MONTH})\s+(?P<d1>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y1>\d{{4}})|(?P<d2>\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?(?P<m2>{_MONTH}),?\s+(?P<y2>\d{{4}})"
    r"|(?P<y3>\d{4})-(?P<m3>\d{2})-(?P<d3>\d{2})|(?P<a4>\d{1,2})(?P<sep>[/.])(?P<b4>\d{1,2})(?P=sep)(?P<y4>\d{4}))(?![\w/-])",
    re.IGNORECASE,
)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_SUFFIX = re.compile(r"['’][sS]$")
_TITLES = frozenset("mr mrs ms miss dr doctor captain capt reverend rev professor prof sergeant sgt lieutenant judge sir madam".split())
#: Answers and calls, which open sentences and also stand within them.
_ANSWERS = ("no", "yes", "oh", "well", "okay", "yeah")
_SHORT = frozenset("mr mrs ms dr capt rev prof sgt".split())


def pii_kinds() -> tuple[str, ...]:
    """Kinds of personal information that are found."""
    return ("name", "email", "phone", "address", "id_number")


def _luhn(digits: str) -> bool:
    each = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in each) % 10 == 0


def _iban(value: str) -> bool:
    plain = value.replace(" ", "").upper()
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def valid_id(value: str) -> bool:
    """Whether a string of an identity number's form is one: ranges, letters and check digits are as issued.

    A tax or social number has no empty group and not the areas 000 and 666; a card number has its Luhn digit, a bank
    account its remainder, an insurance number issued prefix letters and a register number a year of birth or entry.
    """
    m = _ID.fullmatch(value)
    if not m:
        return False
    digits = re.sub(r"\D", "", value)
    if m["tax"]:
        return digits[:3] not in ("000", "666") and digits[3:5] != "00" and digits[5:] != "0000"
    if m["register"]:
        return 1800 <= int(value[3:7]) <= 2099
    if m["insurance"] and not m["passport"]:
        a, b = value[0].upper(), value[1].upper()
        return a not in "DFIQUV" and b not in "DFIOQUV" and a + b not in ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")
    if m["card"]:
        return _luhn(digits)
    return _iban(value) if m["iban"] else True


def phone_parts(value: str) -> tuple[int, int, int] | None:
    """Of the digits of a telephone number, the first and the end of the national number, and of all before an extension.

    Country prefix, trunk zero and extension are no part of the national number. ``None`` if it is no valid number: the
    prefix must be assigned; a number of ten digits without prefix, or with prefix 1, has area and exchange from 2 on;
    one of seven an exchange from 2 on; others begin with the trunk zero and have seven to thirteen digits.
    """
    body = _EXTENSION.sub("", value)
    d = re.sub(r"\D", "", body)
    n = len(d)
    at = 0
    if body.startswith("+"):
        at = 1 if d[:1] in _ONE else 2 if d[:2] in _TWO else 3 if d[:2] in _THREE else 0
        if not at:
            return None
        if d[:at] == "1":
            return (at, n, n) if _north_american(d[1:]) else None
        at += d[at : at + 1] == "0"
        return (at, n, n) if 6 <= n - at <= 12 else None
    if d[:1] == "0":
        return (1, n, n) if 8 <= n <= 12 else None
    if n == 11 and d[0] == "1" and _north_american(d[1:]):
        return 1, n, n
    if n == 10:
        return (0, n, n) if _north_american(d) else None
    return (0, n, n) if n == 7 and d[0] in "23456789" and d[1:3] != "11" else None


def _north_american(d: str) -> bool:
    return len(d) == 10 and d[0] in "23456789" and d[3] in "23456789"


def _month(word: str) -> int:
    return next(i for i, m in enumerate(_MONTHS, 1) if m.startswith(word.lower().rstrip(".")[:3]))


def date_of(m: re.Match) -> tuple[date, bool] | None:
    """The day a matched date names, and whether its day stands first; ``None`` if there is no such day.

    Of two numbers the first is the month unless it can't be, with dots the day unless it can't be.
    """
    try:
        if m["m1"]:
            return date(int(m["y1"]), _month(m["m1"]), int(m["d1"])), False
        if m["m2"]:
            return date(int(m["y2"]), _month(m["m2"]), int(m["d2"])), True
        if m["y3"]:
            return date(int(m["y3"]), int(m["m3"]), int(m["d3"])), False
        a, b, y = int(m["a4"]), int(m["b4"]), int(m["y4"])
        first = b <= 12 if m["sep"] == "." else a > 12
        return (date(y, b, a) if first else date(y, a, b)), first
    except ValueError:
        return None


def _address_end(text: str, at: int, suffixes: frozenset[str]) -> int:
    end = at
    if m := _UNIT.match(text, end):
        end = m.end()
    if m := _PLACE.match(text, end):
        words = list(re.finditer(r"[^\W\d_][\w'’]*", m.group(1)))
        base, stop = m.start(1), None
        for w in words:
            if w.group().lower() in suffixes:
                stop = base + w.end()
                break
        if stop is None:
            titled = []
            for w in words[:2]:
                if not (w.group()[0].isupper() and not w.group().isupper()):
                    break
                titled.append(w)
            post = base + titled[-1].end() if titled else None
            stop = post if post and (_POST.match(text, post) or not text[post:].lstrip()[:1].isalpha() or text[post:].lstrip()[:1].islower()) else None
        if stop:
            end = stop
    if m := _POST.match(text, end):
        end = m.end()
    return end


def _name_spans(text: str, classes: dict[str, str]) -> list[tuple[int, int]]:
    """Spans of names by the classes of their words."""
    toks = []
    for m in _WORD.finditer(text):
        w = m.group()
        end = m.end()
        if s := _SUFFIX.search(w):
            w, end = w[: s.start()], end - len(s.group())
        kind = classes.get(w.lower())
        if kind is None and "-" in w:
            parts = {classes.get(p) for p in w.lower().split("-")}
            kind = NAME_WORD if not parts & {ORDINARY_WORD, PLACE_WORD} else ORDINARY_WORD
        toks.append((m.start(), end, w, kind, s is not None))
    n, spans, i = len(toks), [], 0

    def gap(k: int) -> str:
        return text[toks[k][1] : toks[k + 1][0]] if k + 1 < n else "\0"

    def name(k: int, lower: bool, sure: tuple[str, ...] = ()) -> bool:
        """Whether a word may be of a name; ``sure`` has the classes that don't count against a capitalised one."""
        if k >= n:
            return False
        _, _, w, kind, _ = toks[k]
        if kind in (ORDINARY_WORD, PLACE_WORD, OPENER) and not (kind in sure and w[0].isupper() and w.lower() not in _TITLES) or len(w) < 2:
            return False
        return lower or w[0].isupper()

    def initial(k: int) -> bool:
        return k + 1 < n and len(toks[k][2]) == 1 and toks[k][2].isalpha() and gap(k).startswith(".") and not gap(k).strip(". ")

    while i < n:
        start, end, w, kind, _ = toks[i]
        if w.lower() in _TITLES and i + 1 < n and gap(i).strip(". ") == "" and len(gap(i)) <= 3:
            k, lower = i + 1, w.islower()
            first = k
            while initial(k):
                k += 1
            last = None
            # "the doctor. The box" has a title at the end of a sentence
            told = (ORDINARY_WORD, PLACE_WORD, OPENER) if "." not in gap(i) or w.lower() in _SHORT else ()
            told = (PLACE_WORD,) if k > first else told
            while name(k, lower, told if last is None else ()) and (last is None or (gap(k - 1) == " " and not toks[k - 1][4])):
                last, k = k, k + 1
                if initial(k):
                    k += 1
                if k - first > 4:
                    break
            if last is not None:
                spans.append((toks[first][0], toks[last][1]))
                i = last + 1
                continue
        if initial(i) and (start == 0 or text[start - 1] not in "'’-"):
            k = i
            while initial(k):
                k += 1
            if name(k, w.islower(), (PLACE_WORD,)) and (w.isupper() or toks[k][3] == NAME_WORD or toks[k][3] is None):
                spans.append((start, toks[k][1]))
                i = k + 1
                continue
        known = kind == NAME_WORD
        if name(i, known) and not toks[i][4]:
            lower = w.islower()
            k, last = i + 1, None
            if gap(i) == " ":
                while initial(k) and gap(k - 1) in (" ", ". "):
                    k += 1
                while name(k, lower, (PLACE_WORD,) if k > i + 1 and last is None else ()) and gap(k - 1) in (" ", ". ") and (lower or toks[k][2][0].isupper()):
                    last, k = k, k + 1
                    if toks[last][4] or k - i > 4 or gap(last) != " ":
                        break
            elif gap(i) == ", " and name(i + 1, lower) and (toks[i + 1][3] == NAME_WORD or not lower) and not (gap(i + 1) == " " and name(i + 2, lower)) and (i == 0 or not (name(i - 1, lower) and gap(i - 1) == " ")):
                k, last = i + 2, i + 1
                if initial(k) and gap(i + 1) == " ":
                    last = k
            if last is not None:
                end = toks[last][1]
                spans.append((start, end + 1 if len(toks[last][2]) == 1 else end))
                i = k if k > last else last + 1
                continue
        i += 1
    return spans


_AT, _DOT = re.compile(r"@|[\[(]at[\])]", re.IGNORECASE), re.compile(r"\sat\s[\w-]+\sdot\s", re.IGNORECASE)
_DIGITS, _POST_BOX = re.compile(r"\d+"), re.compile(r"\bbox\s+\d", re.IGNORECASE)
#: Digits of the shortest identity or telephone number, and of the shortest date.
_LEAST_DIGITS, _DATE_DIGITS = 6, 5


_INITIAL = re.compile(r"\b[^\W\d_]\.")


def _may_hold_name(text: str, classes: dict[str, str]) -> bool:
    """Whether a text has a title, an initial or two words in a row that a name may have."""
    if _INITIAL.search(text):
        return True
    before = False
    for w in _WORD.findall(text):
        low = w.lower()
        if low in _TITLES:
            return True
        kind = classes.get(low)
        if kind is None or kind == NAME_WORD:
            # two in a row that may be of a name, of which the first is capital or known as one
            if before:
                return True
            before = kind is not None or w[0].isupper()
        else:
            before = False
    return False


def find(text: str | None, classes: dict[str, str], suffixes: frozenset[str], dates: bool = False) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the personal information in a text, by place; NULL and empty texts hold none.

    ``classes`` has the class of known words, ``suffixes`` the last words of known places. Of overlapping finds the one
    of the kind tried first stays: e-mail, address, identity number, telephone number, with ``dates`` full date, name.
    Numbers of any kind must be valid (:func:`valid_id`, :func:`phone_parts`, :func:`date_of`).
    """
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    masked = text

    def take(kind: str, start: int, end: int) -> None:
        nonlocal masked
        out.append((kind, start, end))
        masked = masked[:start] + "\x01" * (end - start) + masked[end:]

    if _AT.search(text) or _DOT.search(text):
        for m in list(_EMAIL.finditer(masked)):
            take("email", m.start(), m.end())
    n_digits = sum(map(len, _DIGITS.findall(masked)))
    if n_digits:
        for m in list(_STREET.finditer(masked)):
            before = _NUMBERED.search(masked, max(0, m.start() - 10), m.start())
            if "\x01" not in m.group():
                take("address", before.start() if before else m.start(), _address_end(masked, m.end(), suffixes))
        for pattern in (_BOX, _FOREIGN) if _POST_BOX.search(masked) else (_FOREIGN,):
            for m in list(pattern.finditer(masked)):
                if "\x01" not in masked[m.start() : m.end()]:
                    take("address", m.start(), _address_end(masked, m.end(), suffixes))
    if n_digits >= _LEAST_DIGITS:
        for m in list(_ID.finditer(masked)):
            if valid_id(m.group()):
                take("id_number", m.start(), m.end())
        for m in list(_PHONE.finditer(masked)):
            if phone_parts(m.group()):
                take("phone", m.start(), m.end())
    if dates and n_digits >= _DATE_DIGITS:
        for m in list(_DATE.finditer(masked)):
            if date_of(m):
                take("date", m.start(), m.end())
    if _may_hold_name(masked, classes):
        out += [("name", a, b) for a, b in _name_spans(masked, classes)]
    return sorted(out, key=lambda x: x[1])


# --- pseudonyms -----------------------------------------------------------------------------------------------------


def _round(key: bytes, i: int, half: str, length: int, base: int) -> int:
    digest = hmac.new(key, f"{i}|{length}|{base}|{half}".encode(), hashlib.sha256).digest()
    return int.from_bytes(digest[:12], "big") % base**length


def permute_digits(digits: str, key: bytes, rounds: int = 8) -> str:
    """Keyed permutation of the digit strings of one length, by an alternating Feistel network; one to one."""
    if len(digits) < 2:
        return str((int(digits or 0) + _round(key, 0, "", 1, 10)) % 10) if digits else digits
    u = len(digits) // 2
    a, b = digits[:u], digits[u:]
    for i in range(rounds):
        m = len(a)
        c = (int(a) + _round(key, i, b, m, 10)) % 10**m
        a, b = b, str(c).zfill(m)
    return a + b


def restore_digits(digits: str, key: bytes, rounds: int = 8) -> str:
    """Inverse of :func:`permute_digits`."""
    if len(digits) < 2:
        return str((int(digits) - _round(key, 0, "", 1, 10)) % 10) if digits else digits
    u = len(digits) // 2 if rounds % 2 == 0 else len(digits) - len(digits) // 2
    a, b = digits[:u], digits[u:]
    for i in reversed(range(rounds)):
        m = len(b)
        c = (int(b) - _round(key, i, a, m, 10)) % 10**m
        a, b = str(c).zfill(m), a
    return a + b


def permute_date(value: date, key: bytes, first: date = date(1850, 1, 1), days: int = 100_000) -> date:
    """Keyed permutation of the dates of a range; a date outside it is returned as it is."""
    at = (value - first).days
    if not 0 <= at < days:
        return value
    width = len(str(days - 1))
    while True:  # walk the cycle of the larger permutation until it is back in the range
        at = int(permute_digits(str(at).zfill(width), key))
        if at < days:
            return first + timedelta(days=at)


def _walk(digits: str, key: bytes, like: Callable[[str], object]) -> str:
    """Keyed permutation among the digit strings of one length that are ``like`` each other: its cycle is walked on."""
    want, at = like(digits), permute_digits(digits, key)
    while like(at) != want:
        at = permute_digits(at, key)
    return at


def _with_digits(value: str, digits: str) -> str:
    it = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(it), value)


def _phone(value: str, key: bytes) -> str:
    parts = phone_parts(value)
    d = re.sub(r"\D", "", value)
    a, b, _ = parts or (0, len(d), len(d))
    national = _walk(d[a:b], key, lambda x: (_north_american(x), x[:1] == "0", len(x) == 7 and x[1:3] == "11", x[:1] == "1"))
    return _with_digits(value, d[:a] + national + (permute_digits(d[b:], key) if d[b:] else ""))


def _identity(value: str, key: bytes) -> str:
    return _with_digits(value, _walk(re.sub(r"\D", "", value), key, lambda x: valid_id(_with_digits(value, x))))


def _date(value: str, key: bytes) -> str:
    m = _DATE.fullmatch(value)
    if not m or not (read := date_of(m)):
        return value
    new, day_first = permute_date(read[0], key), read[1]

    def number(group: str, n: int) -> tuple[int, int, str]:
        return m.start(group), m.end(group), str(n).zfill(len(m[group]) if m[group][0] == "0" or len(m[group]) == 4 else 1)

    if m["m1"] or m["m2"]:
        i = "1" if m["m1"] else "2"
        old = m["m" + i]
        name = _MONTHS[new.month - 1]
        name = name if len(old.rstrip(".")) > 4 or old.lower() in _MONTHS else name[:3] + "." * old.endswith(".")
        name = name.upper() if old.isupper() else name.title() if old[0].isupper() else name
        parts = [(m.start("m" + i), m.end("m" + i), name), number("d" + i, new.day), number("y" + i, new.year)]
    elif m["y3"]:
        parts = [(0, len(value), new.isoformat())]
    else:
        parts = [number("a4", new.day if day_first else new.month), number("b4", new.month if day_first else new.day), number("y4", new.year)]
    for a, b, t in sorted(parts, reverse=True):
        value = value[:a] + t + value[b:]
    return value


def pseudonym(kind: str, value: str, key: bytes) -> str:
    """Typed placeholder of a value: equal values, written in any way, get equal ones.

    Numbers and dates are permuted among the valid ones of their form and keep their layout. A telephone number's
    country prefix and trunk zero stay, its national number and extension are permuted by themselves, so spellings with
    and without them stay linked. A name, e-mail or address gets a keyed mark of 128 bits.
    """
    own = hmac.new(key, kind.encode(), hashlib.sha256).digest()
    if kind in _PERMUTED:
        return f"<{kind.upper()}:{_PERMUTED[kind](value, own)}>"
    same = " ".join(re.findall(r"\w+", value.lower()))
    return f"<{kind.upper()}:{hmac.new(own, same.encode(), hashlib.sha256).hexdigest()[:32]}>"


_PERMUTED = {"phone": _phone, "id_number": _identity, "date": _date}


def replace(text: str | None, found: list[tuple[str, int, int]], key: bytes) -> str | None:
    """The text with placeholders for what was found."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in found:
        if a < at:
            continue
        out += [text[at:a], pseudonym(kind, text[a:b], key)]
        at = b
    return "".join([*out, text[at:]])


# --- tables ---------------------------------------------------------------------------------------------------------


def records(turns: DataFrame, segments: DataFrame) -> DataFrame:
    """``record_kind, record_id, text`` of turns and segments; a record delivered again counts once.

    Rows with NULL id or NULL text hold nothing and are left out.
    """
    t = turns.select(F.lit("turn").alias("record_kind"), F.col("turn_id").cast("string").alias("record_id"), F.col("raw").alias("text"))
    s = segments.select(F.lit("segment").alias("record_kind"), F.col("segment_id").alias("record_id"), F.col("description").alias("text"))
    return t.unionByName(s).filter(F.col("record_id").isNotNull() & F.col("text").isNotNull())


_PLAIN = re.compile(r"\S*[@\d]\S*")
_PLAIN_SIGN = re.compile(r"[@\d]")
_LETTERS = re.compile(r"[^\W\d_]+")
_SUFFIXES = re.compile(r"['’][sS]\b")
_UPPER = "".join(c for c in map(chr, range(0x250)) if c.isupper())
_LOWER = "".join(c for c in map(chr, range(0x250)) if c.islower())
_MIDDLE = re.compile(rf"(?<=[{_LOWER},;] )[{_UPPER}][^\W\d_]+")
_AFTER = re.compile(rf"\b(?:at|in|near|the) ([{_UPPER}][^\W\d_]+(?: [{_UPPER}][^\W\d_]+){{0,2}})")


def _word_signs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``word, n, low, mid, placed``: occurrences of words, those in lower case, within sentences and after places."""
    seen: dict[str, list[int]] = {}

    def flush() -> pd.DataFrame:
        out = pd.DataFrame([(w, *c) for w, c in seen.items()], columns=["word", "n", "low", "mid", "placed"])
        seen.clear()
        return out.astype({c: "int64" for c in ("n", "low", "mid", "placed")})

    def counts(word: str) -> list[int]:
        return seen.setdefault(word, [0, 0, 0, 0])

    for df in batches:
        forms: Counter[str] = Counter()
        for text in df["text"]:
            plain = _PLAIN.sub(" ", text) if _PLAIN_SIGN.search(text) else text
            plain = _SUFFIXES.sub("", plain) if "'" in plain or "’" in plain else plain
            forms.update(_LETTERS.findall(plain))
            inside = _MIDDLE.findall(plain)
            for w in inside:
                counts(w.lower())[2] += 1
            # a capital after a word of place is one within a sentence
            for run in _AFTER.findall(plain) if inside else ():
                for w in run.split(" "):
                    counts(w.lower())[3] += 1
        for w, n in forms.items():
            if len(w) > 1:
                low = w.lower()
                c = counts(low)
                c[0] += n
                c[1] += n if w == low else 0
        if len(seen) > COUNTED:
            yield flush()
    yield flush()


def word_classes(texts: DataFrame, places: DataFrame) -> dict[str, str]:
    """Classes of the words that hold at least ``KNOWN_SHARE`` of all words, so at most ``1 / KNOWN_SHARE`` of them.

    A word that is often in lower case is ordinary; one often within capitalised words after a word of place ("at",
    "near", "the"), or in the gazetteer ``places`` (``word``), is part of a place; one capitalised only where sentences
    begin opens sentences; others are names. The shares that decide allow for doubt (``DOUBT_*``), so they mean the same
    for rare and common words and in small and large tables. Equal texts count once, so copies make no word common.
    """
    signs = texts.select("text").distinct().mapInPandas(_word_signs, "word string, n long, low long, mid long, placed long")
    stats = materialize(signs.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "low", "mid", "placed")]))
    total = stats.agg(F.sum("n").alias("_total"))
    kept = stats.join(F.broadcast(total)).filter((F.col("n") >= KNOWN_SHARE * F.col("_total")) & (F.col("n") > 0))
    capital = F.col("n") - F.col("low")
    kind = (
        F.when(F.col("low") >= ORDINARY * (F.col("n") + DOUBT_ORDINARY), ORDINARY_WORD)
        # rather in lower case, but too few to tell: it may be a name typed so
        .when(F.col("low") >= ORDINARY * F.col("n"), F.lit(None))
        .when(F.col("word").isin(*_ANSWERS), OPENER)
        .when(F.col("placed") >= PLACED * (capital + DOUBT_PLACED), PLACE_WORD)
        .when(F.col("mid") + DOUBT_INSIDE < INSIDE * capital, OPENER)
        .otherwise(NAME_WORD)
    )
    out = {r["word"]: r["kind"] for r in kept.select("word", kind.alias("kind")).filter("kind is not null").toLocalIterator()}
    for r in places.toLocalIterator():
        if out.get(r["word"]) != ORDINARY_WORD:
            out[r["word"]] = PLACE_WORD
    return out


def gazetteer(segments: DataFrame, interviews: DataFrame) -> tuple[DataFrame, frozenset[str]]:
    """Words of places (``word``), and the last words that end at least one place name in two hundred.

    Words with less than a share of 1e-4 of the place names are left out, so there are at most 10,000 a name's length.
    """
    named = segments.select(F.explode(F.col("geography.term")).alias("p")).unionByName(segments.select(F.col("location").alias("p"))).unionByName(interviews.select(F.col("location").alias("p")))
    named = named.filter(F.col("p").isNotNull()).select(F.filter(F.split(F.regexp_replace(F.lower("p"), r"[^\p{L}]+", " "), " "), lambda w: w != "").alias("ws")).filter(F.size("ws") > 0)
    n = named.agg(F.count(F.lit(1)).alias("_n"))
    words = named.select(F.explode("ws").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(n), F.col("c") >= 1e-4 * F.col("_n")).select("word")
    last = named.groupBy(F.element_at("ws", -1).alias("word")).agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(n), F.col("c") >= 0.005 * F.col("_n"))
    return words, frozenset(r["word"] for r in last.select("word").toLocalIterator())


def occurrences(spark: SparkSession, sf_dir: str, work: Callable, schema: str) -> DataFrame:
    """What ``work(rows, classes, suffixes)`` makes of the rows of :func:`records`, in batches."""
    segments = table(spark, sf_dir, "segments")
    texts = records(table(spark, sf_dir, "turns"), segments)
    words, suffixes = gazetteer(segments, table(spark, sf_dir, "interviews"))
    shared = spark.sparkContext.broadcast((word_classes(texts, words), suffixes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes, ends = shared.value
        for df in batches:
            yield work(df, classes, ends)

    return spread(texts).mapInPandas(run, schema).distinct()


def pseudonymised(spark: SparkSession, sf_dir: str, key: bytes) -> DataFrame:
    """``record_kind, record_id, pii_kind, char_start, char_end, placeholder``: one row per occurrence."""

    def work(df: pd.DataFrame, classes: dict[str, str], suffixes: frozenset[str]) -> pd.DataFrame:
        rows = [(k, i, kind, a, b, pseudonym(kind, t[a:b], key)) for k, i, t in zip(df["record_kind"], df["record_id"], df["text"], strict=True) for kind, a, b in find(t, classes, suffixes, dates=True)]
        return pd.DataFrame(rows, columns=["record_kind", "record_id", "pii_kind", "char_start", "char_end", "placeholder"])

    return occurrences(spark, sf_dir, work, "record_kind string, record_id string, pii_kind string, char_start int, char_end int, placeholder string")


def pseudonym_key(spark: SparkSession) -> bytes:
    """The caller's key, from the setting ``KEY_SETTING``; where it is unset, one drawn at random for this process.

    Only with a key of the caller do values stay linked from one run to the next.
    """
    named = spark.conf.get(KEY_SETTING, "") or ""
    return named.encode() if named else _OWN_KEY


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per occurrence of personal information that gets a placeholder; full dates are no cases here."""
    found = pseudonymised(spark, sf_dir, pseudonym_key(spark))
    return found.filter(F.col("pii_kind").isin(*pii_kinds())).drop("placeholder")


def p2_texts(spark: SparkSession, sf_dir: str, key: bytes | None = None) -> DataFrame:
    """The texts that hold personal information or full dates, with placeholders in their place."""
    key = key or pseudonym_key(spark)

    def work(df: pd.DataFrame, classes: dict[str, str], suffixes: frozenset[str]) -> pd.DataFrame:
        rows = []
        for k, i, t in zip(df["record_kind"], df["record_id"], df["text"], strict=True):
            if found := find(t, classes, suffixes, dates=True):
                rows.append((k, i, len(found), replace(t, found, key)))
        return pd.DataFrame(rows, columns=["record_kind", "record_id", "n_found", "text"])

    return occurrences(spark, sf_dir, work, "record_kind string, record_id string, n_found int, text string")


QUERIES = {"p2_found": p2_found, "p2_texts": p2_texts}
ORACLE: dict[str, str] = {}
