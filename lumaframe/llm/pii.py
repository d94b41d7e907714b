"""Personal data and secrets as format-preserving pseudonyms.

Values are found by pattern and then validated: card numbers by their check digit, IBANs
by theirs, addresses by the range of their parts, dates by the calendar, social security
numbers by the ranges that are given out, phone numbers by their digits and punctuation. What is valid is numbered within all
values of its format, the number is permuted by a keyed Feistel network (cycle walking
keeps it in range), and the value with the new number takes its place: same length, same
separators, valid check digits. Equal values have equal pseudonyms in every document, so
records stay linked; without the key they can't be turned back, with it they can.

Row-local: texts without a digit, an @, an assignment or AKIA never leave the JVM.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches

ROUNDS = 8
#: For tests and examples; a deployment passes its own.
KEY = b"example key, replace"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Permutation:
    """A keyed permutation of 0 .. size - 1 for every size and name, by a balanced Feistel network."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, name: str, size: int, i: int, half: int, bits: int) -> int:
        body = f"{name}/{size}/{i}/{half}".encode()
        need = -(-bits // 8)
        out = b""
        while len(out) < need:
            out += hashlib.blake2b(body + b"/%d" % len(out), key=self.key, digest_size=min(64, max(16, need))).digest()
        return int.from_bytes(out[:need], "big") & ((1 << bits) - 1)

    def _step(self, name: str, size: int, value: int, back: bool) -> int:
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        low = (1 << bits) - 1
        left, right = value >> bits, value & low
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(name, size, i, left, bits), left
            else:
                left, right = right, left ^ self._round(name, size, i, right, bits)
        return left << bits | right

    def __call__(self, name: str, size: int, value: int, back: bool = False) -> int:
        if size < 2:
            return value
        value = self._step(name, size, value, back)
        while value >= size:
            value = self._step(name, size, value, back)
        return value


def luhn(digits: str) -> int:
    """The check digit that follows digits."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 - i % 2)
        total += x - 9 * (x > 9)
    return -total % 10


def _fill(shape: str, chars: str) -> str:
    """shape with its letters and digits replaced by chars in turn."""
    rest = iter(chars)
    return "".join(next(rest) if c.isalnum() else c for c in shape)


_ALPHABETS = {"d": "0123456789", "l": "abcdefghijklmnopqrstuvwxyz", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "h": "0123456789abcdef", "H": "0123456789ABCDEF"}


def _by_class(text: str, permute: Callable[[int, int], int], hexadecimal: bool = False) -> str:
    """text with ASCII letters and digits permuted within their classes, the rest in place."""
    kinds = []
    plain = [c for c in text if c.isascii() and c.isalnum()]
    one = hexadecimal and ("h" if all(c in _ALPHABETS["h"] for c in plain) else "H" if all(c in _ALPHABETS["H"] for c in plain) else "")
    number, size = 0, 1
    for c in plain:
        kind = one or ("d" if c.isdigit() else "l" if c.islower() else "u")
        kinds.append(kind)
        number, size = number * len(_ALPHABETS[kind]) + _ALPHABETS[kind].index(c), size * len(_ALPHABETS[kind])
    number, out = permute(size, number), []
    for kind in reversed(kinds):
        number, at = divmod(number, len(_ALPHABETS[kind]))
        out.append(_ALPHABETS[kind][at])
    rest = iter(reversed(out))
    return "".join(next(rest) if c.isascii() and c.isalnum() else c for c in text)


def card(text: str, permute) -> str | None:
    digits = re.sub(r"\D", "", text)
    if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = f"{permute(10 ** (len(digits) - 2), int(digits[1:-1])):0{len(digits) - 2}d}"
    body = digits[0] + body
    return _fill(text, body + str(luhn(body)))


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def iban(text: str, permute) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    body = _by_class(plain[4:], permute)
    return _fill(text, plain[:2] + f"{98 - _mod97(body + plain[:2] + '00'):02d}" + body)


def address(text: str, permute) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    number = permute(1 << 32, int.from_bytes(bytes(map(int, parts)), "big"))
    return ".".join(map(str, number.to_bytes(4, "big")))


def phone(text: str, permute) -> str | None:
    """An optional country code 1 stays; the ten digits are permuted."""
    head, rest = re.fullmatch(r"(\+?1[ .-]?)?(.*)", text, re.S).groups() if not re.match(r"1\d\d[ .-]", text) else ("", text)
    digits = re.sub(r"\D", "", rest)
    return (head or "") + _fill(rest, f"{permute(10**10, int(digits)):010d}")


def international(text: str, permute) -> str | None:
    """+ and country code stay; the national digits are permuted."""
    head, rest = re.fullmatch(r"(\+\d{1,3})([ .-].*)", text).groups()
    digits = re.sub(r"\D", "", rest)
    if not 7 <= len(digits) <= 12:
        return None
    return head + _fill(rest, f"{permute(10 ** len(digits), int(digits)):0{len(digits)}d}")


def social(text: str, permute) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    number = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rest, serial = divmod(permute(898 * 99 * 9999, number), 9999)
    area, group = divmod(rest, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def date(text: str, permute) -> str | None:
    """Year first, or day first; month first where only that is a date."""
    a, mark, b, _, c = re.fullmatch(r"(\d+)([-/.])(\d+)([-/.])(\d+)", text).groups()
    orders = ("ymd",) if len(a) == 4 else ("dmy", "mdy")
    for order in orders:
        value = dict(zip(order, (a, b, c), strict=True))
        try:
            day = datetime.date(int(value["y"]), int(value["m"]), int(value["d"])).toordinal()
        except ValueError:
            continue
        if FIRST_DAY <= day <= LAST_DAY:
            new = datetime.date.fromordinal(FIRST_DAY + permute(LAST_DAY - FIRST_DAY + 1, day - FIRST_DAY))
            fresh = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
            return mark.join(fresh[k] for k in order)
    return None


def email(text: str, permute) -> str | None:
    """The local part and all labels of the domain but the last two are permuted."""
    local, domain = text.split("@")
    labels = domain.split(".")
    keep = ".".join(labels[-2:])
    moved = _by_class(local + "@" + ".".join(labels[:-2]), permute)
    return f"{moved}{'.' if len(labels) > 2 else ''}{keep}"


def access_key(text: str, permute) -> str | None:
    return text[:4] + _by_class(text[4:], permute)


def secret(text: str, permute) -> str | None:
    head, body = re.fullmatch(r"(.*?[=:]\s*[\"']?)([^\"'\s]+)", text, re.S).groups()
    return head + _by_class(body, permute, hexadecimal=True)


#: Kind, pattern, function. Order decides between patterns that match at the same place.
KINDS = [
    ("secret", r"(?i:(?<![A-Za-z0-9])(?:password|passwd|token|secret|api[_-]?key))\s?[=:]\s?[\"']?[A-Za-z0-9+/_-]{8,}", secret),
    ("access_key", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])", access_key),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9@])", email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])", iban),
    ("date", r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\d/-]|\.\d)", date),
    ("social", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", social),
    ("address", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)", address),
    ("card", r"(?<![\d+])(?:\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)", card),
    ("phone", r"(?<![\d(+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)", phone),
    ("international", r"(?<![\d+])\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\d)", international),
]
_FIND = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern, _ in KINDS))
_MAKE = {name: make for name, _, make in KINDS}


def replace(text: str, permutation: Permutation, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms for valid values, and how many of each kind; back turns them round."""
    count: dict[str, int] = {}
    parts, done = [], 0
    while found := _FIND.search(text, done):
        kind, end = found.lastgroup, found.end()
        for value in _endings(kind, found[0]):
            made = _MAKE[kind](value, lambda size, number: permutation(kind, size, number, back))  # noqa: B023
            if made is not None:
                count[kind] = count.get(kind, 0) + 1
                end = found.start() + len(value)
                break
        parts += [text[done : found.start()], found[0] if made is None else made]
        done = end
    return "".join(parts) + text[done:], count


def _endings(kind: str, value: str) -> list[str]:
    """What a match may stand for, longest first: an IBAN's last groups may be words that follow it."""
    cuts = [i for i, c in enumerate(value) if c == " "] if kind == "iban" else []
    return [value, *[value[:i] for i in reversed(cuts)]]


_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.LongType()), T.StructField("kinds", T.StringType())])


def pseudonymise(df: DataFrame, text: str = "text", key: bytes = KEY) -> DataFrame:
    """df with personal data in text replaced, and n_pii and pii_kinds appended, one output row per input row.

    n_pii counts the values replaced, pii_kinds names their kinds, sorted and joined by
    commas. Values that fail validation stay. A null text stays null with 0 and an empty
    string, and texts without personal data come back unchanged. n_pii and pii_kinds of
    df are replaced; other columns pass through whatever their names.
    """
    small_batches(df.sparkSession)
    permutation = Permutation(key)

    @F.pandas_udf(_RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            if t is None:
                rows.append((None, 0, ""))
            else:
                made, count = replace(t, permutation)
                rows.append((made, sum(count.values()), ",".join(sorted(count))))
        return pd.DataFrame(rows, columns=["text", "n", "kinds"])

    keep = [c for c in df.columns if c not in ("n_pii", "pii_kinds")]
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    may = F.when(F.col(text).rlike("[0-9@=:]|AKIA"), F.col(text))
    rows = df.select(row.alias("row"), F.col(text).alias("old"), run(may).alias("new"))
    columns = [F.coalesce("new.text", "old").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in keep]
    return rows.select(*columns, F.col("new.n").alias("n_pii"), F.col("new.kinds").alias("pii_kinds"))
