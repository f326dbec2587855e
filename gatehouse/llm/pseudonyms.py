"""Personal data: validated numbers, dates and addresses replaced by keyed pseudonyms of the same format.

A value is a number in the domain of its format, and a keyed Feistel network P permutes that domain. The pseudonym of x is
the value that P puts right after x, walking on until it is valid again: a permutation too, and one that leaves no value
as it is where the domain has another. Equal values get equal pseudonyms in every document, different values different
ones, and only the holder of the key can go back.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass
from datetime import date
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, map_rows

ROUNDS = 8
#: Characters that are permuted as one number; longer values go block by block.
BLOCK = 64
#: The key unless a caller brings a secret one of their own, as production must.
KEY = b"gatehouse-pseudonyms"
KINDS = ("email", "phone", "card", "ssn", "iban", "ip", "date")

#: The formats, tried anchored where a digit run or an @ makes one possible.
EMAIL_LOCAL, EMAIL_DOMAIN = re.compile(r"(?<![\w.+%-])[\w.+%-]++\Z"), re.compile(r"@((?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24})(?![\w-])")
NUMBERS = re.compile(
    r"(?<![\w@])(?:"
    r"(?P<date>\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})"
    r"|(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?!\.\d)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})"
    r"|(?P<iban>[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)"
    r"|(?P<card>\d{13,19}|\d{4}(?P<gap>[\x20-])\d{4}(?P=gap)\d{4}(?P=gap)\d{4}|\d{4}[\x20-]\d{6}[\x20-]\d{5})"
    r"|(?P<phone>\+\d{1,3}[\x20.-]?\(\d{3}\)[\x20.-]?\d{3}[\x20.-]\d{4}|\+\d{1,3}[\x20.-]?(?:\(\d{1,4}\)[\x20.-]?)?\d{2,4}(?:[\x20.-]?\d{2,4}){1,4}|\(\d{3}\)\x20?\d{3}[\x20.-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})"
    r")(?!\w)"
)
_DIGIT = re.compile(r"\d")  # in every format of NUMBERS
#: Characters of an IBAN by country, as registered.
IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO EG GT HU LB NI PL SV", 29: "BR PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


class Feistel:
    """A keyed permutation of the numbers below n, by an alternating Feistel network with cycle walking."""

    def __init__(self, key: bytes, tweak: str, n: int) -> None:
        self.n, self.u = n, isqrt(n - 1) + 1
        self.v = -(-n // self.u)
        self._key = hashlib.blake2b(tweak.encode() + n.to_bytes(-(-n.bit_length() // 8), "big"), key=key[:64]).digest()
        self._bytes = -(-max(self.u, self.v).bit_length() // 8) + 8

    def _round(self, k: int, x: int) -> int:
        data = self._key + bytes([k]) + x.to_bytes(self._bytes, "big")
        return int.from_bytes(hashlib.shake_256(data).digest(self._bytes), "big")

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.v)
        for k in range(ROUNDS):
            if k % 2:
                right = (right + self._round(k, left)) % self.v
            else:
                left = (left + self._round(k, right)) % self.u
        return left * self.v + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.v)
        for k in reversed(range(ROUNDS)):
            if k % 2:
                right = (right - self._round(k, left)) % self.v
            else:
                left = (left - self._round(k, right)) % self.u
        return left * self.v + right

    def _within(self, step, x: int) -> int:
        y = step(x)
        while y >= self.n:
            y = step(y)
        return y

    def permute(self, x: int, valid=lambda _: True, by: int = 1) -> int:
        """The next valid value in the keyed order of all values."""
        place = self._within(self._once, x)
        while True:
            place = (place + by) % self.n
            y = self._within(self._back, place)
            if valid(y):
                return y

    def invert(self, y: int, valid=lambda _: True) -> int:
        return self.permute(y, valid, -1)


@lru_cache(maxsize=4096)
def _network(key: bytes, tweak: str, n: int) -> Feistel:
    return Feistel(key, tweak, n)


def luhn_digit(digits: str) -> str:
    """The check digit that makes the digits before it valid."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def iban_remainder(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def iban_ends(match: str) -> list[int]:
    """Where an IBAN may end in a match that may hold the words behind it: at its country's length, else at a word's end, the last first."""
    ends = [k for k in range(len(match), 0, -1) if k == len(match) or match[k] == " "]
    return sorted(ends, key=lambda k: len(match[:k].replace(" ", "")) != IBAN_LENGTHS.get(match[:2]))


def _refill(shape: str, characters: str, ours=str.isalnum) -> str:
    """The shape with its own characters replaced in order and its separators kept."""
    it = iter(characters)
    return "".join(next(it) if ours(c) else c for c in shape)


@lru_cache(maxsize=4096)
def alphabet(c: str) -> str:
    """The characters that may stand for a letter or digit: of ASCII its kind, else of its Unicode category among the 128 code points around it; none for any other."""
    if c.isascii():
        return next((x for x in ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if c in x), "")
    if not c.isalnum():
        return ""
    start, kind = ord(c) & ~127, unicodedata.category(c)
    return "".join(x for x in map(chr, range(start, start + 128)) if unicodedata.category(x) == kind)


@dataclass(frozen=True)
class Pseudonymizer:
    """Finds personal data and replaces it. ``invert`` undoes what the same key did."""

    key: bytes = KEY
    backwards: bool = False

    def _permute(self, tweak: str, n: int, x: int, valid=lambda _: True) -> int:
        network = _network(self.key, tweak, n)
        return (network.invert if self.backwards else network.permute)(x, valid)

    def _characters(self, tweak: str, value: str) -> str:
        """Letters and digits permuted, each within its alphabet, as mixed-radix numbers of a block each; all else stays."""
        places = [(k, a) for k, c in enumerate(value) if (a := alphabet(c))]
        out = list(value)
        for at in range(0, len(places), BLOCK):
            block = places[at : at + BLOCK]
            n, x = 1, 0
            for k, a in block:
                n, x = n * len(a), x * len(a) + a.index(value[k])
            if n < 2:
                continue
            y = self._permute(f"{tweak}:{at}:{''.join(a[0] for _, a in block)}", n, x)
            for k, a in reversed(block):
                y, d = divmod(y, len(a))
                out[k] = a[d]
        return "".join(out)

    def _digits(self, tweak: str, digits: str, valid=lambda _: True) -> str:
        k = len(digits)
        return f"{self._permute(f'{tweak}:{k}', 10**k, int(digits), lambda x: valid(f'{x:0{k}d}')):0{k}d}"

    def email(self, value: str) -> str | None:
        """The local part, and the domain by itself up to its last label, so that one domain stays one."""
        local, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{self._characters('email', local)}@{self._characters('domain', host)}.{top}"

    def card(self, value: str) -> str | None:
        digits = "".join(filter(str.isdigit, value))
        if luhn_digit(digits[:-1]) != digits[-1] or not digits.strip("0"):
            return None
        body = self._digits("card", digits[:-1], lambda x: x.strip("0") != "")
        return _refill(value, body + luhn_digit(body))

    def phone(self, value: str) -> str | None:
        digits = "".join(filter(str.isdigit, value))
        if not 8 <= len(digits) <= 15:
            return None
        kept = len(re.match(r"\+?(\d*)", value)[1]) if value[0] == "+" else 0
        kept = kept if 0 < kept <= 3 else 1 if value[0] == "+" else 0
        return _refill(value, digits[:kept] + self._digits(f"phone:{digits[:kept]}", digits[kept:]))

    def ssn(self, value: str) -> str | None:
        def valid(x: str) -> bool:
            return x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"

        digits = value.replace("-", "")
        return _refill(value, self._digits("ssn", digits, valid)) if valid(digits) else None

    def iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_remainder(plain) != 1:
            return None
        body = self._characters(f"iban:{plain[:2]}", plain[4:])
        check = 98 - iban_remainder(f"{plain[:2]}00{body}")
        return _refill(value, f"{plain[:2]}{check:02d}{body}")

    def ip(self, value: str) -> str | None:
        octets = [int(x) for x in value.split(".")]
        if max(octets) > 255:
            return None
        x = self._permute("ip", 1 << 32, int.from_bytes(bytes(octets), "big"))
        return ".".join(map(str, x.to_bytes(4, "big")))

    def date(self, value: str) -> str | None:
        """The day is permuted, not the text, so one day written two ways stays one day. Day first unless only month first is valid."""
        parts = re.split(r"[-/.]", value)
        orders = ((0, 1, 2),) if len(parts[0]) == 4 else ((2, 1, 0), (2, 0, 1))
        for order in orders:
            try:
                day = date(*(int(parts[k]) for k in order)).toordinal()
            except ValueError:
                continue
            if not FIRST_DAY <= day <= LAST_DAY:
                continue
            new = date.fromordinal(FIRST_DAY + self._permute("date", LAST_DAY - FIRST_DAY + 1, day - FIRST_DAY))
            cells = [""] * 3
            for k, number in zip(order, (new.year, new.month, new.day)):
                cells[k] = f"{number:0{4 if number > 99 else 2}d}"
            return re.sub(r"\d+", lambda _, it=iter(cells): next(it), value)
        return None

    def find(self, text: str) -> list[tuple[int, int, str, str]]:
        """Start, end, kind and pseudonym of what is personal, ascending and apart."""
        found: list[tuple[int, int, str, str]] = []
        at = text.find("@")
        floor = 0
        while at >= 0:
            domain = EMAIL_DOMAIN.match(text, at)
            local = _ending(text, floor, at) if domain else None
            if local and domain:
                start, end = at - len(local[0]), domain.end()
                found.append((start, end, "email", self.email(text[start:end])))
                floor = end
            else:
                floor = at + 1
            at = text.find("@", floor)
        if _DIGIT.search(text):
            starts, ends = [x[0] for x in found], [x[1] for x in found]
            m = NUMBERS.search(text)
            while m:
                kind = next(k for k in KINDS if k != "email" and m[k] is not None)
                new, end = None, m.end()
                for k in iban_ends(m[0]) if kind == "iban" else (len(m[0]),):
                    end = m.start() + k
                    before = bisect_right(starts, end - 1)  # addresses that begin before the end
                    if not before or ends[before - 1] <= m.start():
                        new = getattr(self, kind)(m[0][:k])
                    if new is not None:
                        found.append((m.start(), end, kind, new))
                        break
                m = NUMBERS.search(text, m.start() + 1 if new is None else end)  # what is not valid may hold what is
            found.sort()
        return found

    def replace(self, text: str | None) -> tuple[str | None, list[tuple[int, int, str, str]]]:
        if not text:
            return text, []
        found = self.find(text)
        out, at = [], 0
        for start, end, _, new in found:
            out += (text[at:start], new)
            at = end
        return "".join(out) + text[at:] if found else text, found


def _ending(text: str, floor: int, at: int) -> re.Match | None:
    """The local part of an address that ends here, however long."""
    width = BLOCK
    while True:
        start = max(floor, at - width)
        found = EMAIL_LOCAL.search(text[start:at])
        if found is None or found.start() or start == floor:
            return found
        width *= 4


def pseudonymize_documents(documents: DataFrame, key: bytes = KEY) -> DataFrame:
    """``doc_id, text, n_chars``, a count for each kind, and ``spans`` (kind:start:end in the original's code points).

    One pass without a shuffle. Null texts stay null, texts without personal data stay as they are, repeated
    rows give repeated results, and other columns are ignored.
    """
    names = ", ".join(f"n_{k} long" for k in KINDS)

    def run(rows: dict) -> list:
        done = [Pseudonymizer(key).replace(t) for t in rows["text"]]
        counts = [[sum(x[2] == k for x in found) for _, found in done] for k in KINDS]
        texts = [t for t, _ in done]
        return [rows["doc_id"], texts, [len(t or "") for t in texts], *counts, [",".join(f"{k}:{s}:{e}" for s, e, k, _ in found) for _, found in done]]

    return map_rows(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), f"doc_id long, text string, n_chars long, {names}, spans string", run)


def with_pseudonyms(documents: DataFrame, key: bytes = KEY) -> DataFrame:
    """The documents with personal data replaced in ``text``; ``n_chars`` follows it, all other columns stay.

    Null and empty texts stay as they are, repeated rows give repeated results, and an empty table gives none.
    """
    bound_batches(documents.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        parts = (texts.slice(at, 256).to_pylist() for at in range(0, len(texts), 256))
        return pa.chunked_array([pa.array([Pseudonymizer(key).replace(t)[0] for t in part], pa.string()) for part in parts], pa.string()).combine_chunks()

    out = documents.withColumn("text", F.arrow_udf(run, "string")(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in documents.columns else out
