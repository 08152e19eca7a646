"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Card numbers (Luhn), IBANs (mod 97), IPv4 addresses, phone numbers, US social security numbers,
calendar dates and e-mail addresses are found by pattern and validated. Each value is enciphered
by a keyed Feistel permutation of its own domain (digits of its length, days of the calendar,
octets, letters), walked on until the result is valid again; check digits are recomputed. The
written format stays. As the permutation depends on the key and the kind alone, equal values have
equal pseudonyms in all documents, different values different ones, and ``decipher`` (key known)
gives the value back.

A null text stays null. Repeated rows are treated alike. An empty table gives an empty result.
Columns named like the result's are replaced; all others stay.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlens.llm.common import prepare, table

ROUNDS = 10
#: Key of the registered query; a deployment passes its own secret.
DEMO_KEY = b"training-data-pipeline"


class Permutation:
    """Keyed permutation of 0..size-1: a balanced Feistel network over a x b >= size, walked until
    the value lies inside."""

    def __init__(self, key: bytes, size: int, tweak: str = "", rounds: int = ROUNDS):
        self.size, self.rounds = size, rounds
        self.a = max(1, int(size ** 0.5))
        while self.a * self.a < size:
            self.a += 1
        self.key = hmac.new(key, f"{tweak}|{size}".encode(), hashlib.sha256).digest()

    def _f(self, i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(x.to_bytes(16, "big") + bytes([i]), key=self.key, digest_size=16).digest(), "big") % self.a

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.a)
        for i in range(self.rounds):
            left, right = right, (left + self._f(i, right)) % self.a
        return left * self.a + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.a)
        for i in range(self.rounds - 1, -1, -1):
            left, right = (right - self._f(i, left)) % self.a, left
        return left * self.a + right

    def encipher(self, x: int) -> int:
        x = self._once(x)
        while x >= self.size:
            x = self._once(x)
        return x

    def decipher(self, x: int) -> int:
        x = self._back(x)
        while x >= self.size:
            x = self._back(x)
        return x


def luhn_digit(body: str) -> int:
    """The check digit that follows ``body``."""
    total = 0
    for i, ch in enumerate(reversed(body)):
        v = int(ch) * (2 if i % 2 == 0 else 1)
        total += v - 9 if v > 9 else v
    return -total % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(ch, 36)) for ch in iban[4:] + iban[:4])) % 97


def _refill(template: str, symbols: str, wanted: Callable[[str], bool]) -> str:
    """``template`` with its ``wanted`` characters replaced in order by ``symbols``."""
    it = iter(symbols)
    return "".join(next(it) if wanted(ch) else ch for ch in template)


class Pseudonyms:
    """Enciphers the values of each kind under one key (``back``: deciphers)."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key, back
        self.memory: dict[tuple[str, int], Permutation] = {}

    def _map(self, kind: str, size: int, x: int) -> int:
        p = self.memory.get((kind, size))
        if p is None:
            p = self.memory[kind, size] = Permutation(self.key, size, kind)
        return p.decipher(x) if self.back else p.encipher(x)

    def _digits(self, kind: str, digits: str) -> str:
        return f"{self._map(kind, 10 ** len(digits), int(digits)):0{len(digits)}d}" if digits else ""

    def card(self, value: str) -> str | None:
        d = re.sub(r"\D", "", value)
        if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
            return None
        body = self._digits("card", d[:-1])
        while len(set(body + str(luhn_digit(body)))) == 1:  # stay among valid cards
            body = self._digits("card", body)
        return _refill(value, body + str(luhn_digit(body)), str.isdigit)

    def account(self, value: str) -> str | None:
        """Long numbers without a valid check digit, as they stand (13 to 19 digits)."""
        return self._digits("account", value)

    def iban(self, value: str) -> str | None:
        flat = value.replace(" ", "")
        if not 15 <= len(flat) <= 34 or _mod97(flat) != 1:
            return None
        rest = flat[4:]
        digits = self._digits("iban", "".join(ch for ch in rest if ch.isdigit()))
        letters = "".join(ch for ch in rest if ch.isalpha())
        moved = _letters_to(self._map("ibanletters", 26 ** len(letters), _letters_from(letters)), len(letters)).upper() if letters else ""
        rest = _two(rest, digits, moved)
        check = 98 - _mod97(flat[:2] + "00" + rest)
        return _refill(value, f"{flat[:2]}{check:02d}{rest}", lambda ch: ch != " ")

    def phone(self, value: str) -> str | None:
        d = re.sub(r"\D", "", value)
        lead = len(d) - 10 if len(d) > 10 else 0  # the country code stays
        if value[0] == "+" and not _BRACKETED.fullmatch(value):
            if len(d) < 8:
                return None
            code = re.match(r"\d+", value[1:], re.A)[0]
            lead = len(code) if len(code) <= 3 else _code_length(d)
        return _refill(value, d[:lead] + self._digits("phone", d[lead:]), str.isdigit)

    def ssn(self, value: str) -> str | None:
        def valid(d: str) -> bool:
            return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

        d = value.replace("-", "")
        if not valid(d):
            return None
        d = self._digits("ssn", d)
        while not valid(d):
            d = self._digits("ssn", d)
        return _refill(value, d, str.isdigit)

    def ipv4(self, value: str) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        x = self._map("ipv4", 1 << 32, int.from_bytes(bytes(map(int, parts)), "big"))
        return ".".join(map(str, x.to_bytes(4, "big")))

    def date(self, value: str) -> str | None:
        """A day of 1900 to 2099 becomes another, the same in every written form, which stays. Days are
        permuted within classes of the day itself (day below ten, to twelve, above; month below ten
        or not): so one-digit parts stay of one digit, and what can only be read month first still
        can."""
        m = re.fullmatch(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/.])(\d{1,2})\6(\d{4})", value, re.A)
        if not m:
            return None
        try:
            if m[1]:
                day = datetime.date(int(m[1]), int(m[3]), int(m[4]))
                shape = f"%Y{m[2]}%m{m[2]}%d"
            else:
                first, second, year = int(m[5]), int(m[7]), int(m[8])
                us = second > 12  # month first only where the other reading is no date
                day = datetime.date(year, first if us else second, second if us else first)
                shape = f"%d{m[6]}%m{m[6]}%Y" if not us else f"%m{m[6]}%d{m[6]}%Y"
        except ValueError:
            return None
        base = datetime.date(1900, 1, 1).toordinal()
        size = datetime.date(2100, 1, 1).toordinal() - base
        if not 0 <= day.toordinal() - base < size:
            return None
        def kind(d: datetime.date) -> tuple[bool, bool, bool]:
            return d.day < 10, d.day > 12, d.month < 10

        x = self._map("date", size, day.toordinal() - base)
        while kind(out := datetime.date.fromordinal(base + x)) != kind(day):
            x = self._map("date", size, x)
        new = out.strftime(shape).replace(out.strftime("%Y"), f"{out.year:04d}")
        sep = m[2] or m[6]
        return sep.join(a[-len(b):] for a, b in zip(new.split(sep), value.split(sep), strict=True))

    def email(self, value: str) -> str | None:
        """The local part, letter for letter and digit for digit; the domain stays."""
        local, at, domain = value.partition("@")
        letters = "".join(ch.lower() for ch in local if ch.isascii() and ch.isalpha())
        digits = "".join(ch for ch in local if ch.isascii() and ch.isdigit())
        out_l = _letters_to(self._map("mail", 26 ** len(letters), _letters_from(letters)), len(letters)) if letters else ""
        out_d = self._digits("maildigits" + letters if not self.back else "maildigits" + out_l, digits)
        it_l, it_d, out = iter(out_l), iter(out_d), []
        for ch in local:
            if ch.isascii() and ch.isalpha():
                x = next(it_l)
                out.append(x.upper() if ch.isupper() else x)
            elif ch.isascii() and ch.isdigit():
                out.append(next(it_d))
            else:
                out.append(ch)
        return "".join(out) + at + domain


def _letters_from(s: str) -> int:
    x = 0
    for ch in s.lower():
        x = x * 26 + ord(ch) - 97
    return x


def _letters_to(x: int, n: int) -> str:
    out = []
    for _ in range(n):
        x, r = divmod(x, 26)
        out.append(chr(97 + r))
    return "".join(reversed(out))


def _two(template: str, digits: str, letters: str) -> str:
    d, a = iter(digits), iter(letters)
    return "".join(next(d) if ch.isdigit() else next(a) if ch.isalpha() else ch for ch in template)


#: A number with its area code in brackets: ten digits after the country code.
_BRACKETED = re.compile(r"\+\d{1,3}[ -]?\(\d{3}\)[ -]?\d{3}[ -]\d{4}", re.A)
_TWO_DIGITS = {*"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}


def _code_length(digits: str) -> int:
    """Digits of the country code of an international number."""
    return 1 if digits[0] in "17" else 2 if digits[:2] in _TWO_DIGITS else 3


_DATE_AHEAD = r"(?!\d{4}[-/.]\d{1,2}[-/.]\d|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})"
#: Patterns by kind, in the order in which they claim a stretch of text.
PATTERNS = {
    "email": r"\w[\w.+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<!\d)\+\d{1,3}[ -]?\(\d{3}\)[ -]?\d{3}[ -]\d{4}(?!\d)|(?<![\d.-])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.-])\d{3}-\d{3}-\d{4}(?![\d-])"
             r"|(?<![\w+])\+\d{8,15}(?![\d-]|\.\d)"
             rf"|(?<![\w+])\+\d{{1,3}}(?:[ .-]?\(\d{{1,5}}\)[ .-]?\d{{1,8}}|[ .-]{_DATE_AHEAD}\d{{1,10}})(?:[ .-]{_DATE_AHEAD}\d{{2,8}}){{0,5}}(?!\d|[.-]\d)"
             r"|(?<![\w.+-])\d{3}(?P<sep>[ .])\d{3}(?P=sep)\d{4}(?![\d-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "date": r"(?<![\d./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\d/-]|\.\d)",
    "ipv4": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "card": r"(?<![\d-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d-]|\.\d)|(?<![\d-])\d{4}[ -]\d{6}[ -]\d{5}(?![\d-]|\.\d)|(?<!\d)\d{13,19}(?!\d)",
}
_COMPILED = {k: re.compile(p, re.ASCII if k != "email" else 0) for k, p in PATTERNS.items()}


def find_and_replace(text: str, names: Pseudonyms, long_numbers: bool = True) -> tuple[str, list[tuple[int, int, str]]]:
    """(text with pseudonyms, spans (start, end, kind) in the text as it came)."""
    if not any(ch in text for ch in "0123456789@"):
        return text, []
    found: list[tuple[int, int, str, str]] = []
    for kind, pattern in _COMPILED.items():
        if kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            if any(s < m.end() and m.start() < e for s, e, _, _ in found):
                continue
            new = getattr(names, kind)(m.group())
            if new is None and kind == "card" and long_numbers and m.group().isdigit():
                kind_, new = "account", names.account(m.group())
            else:
                kind_ = kind
            if new is not None:
                found.append((*m.span(), kind_, new))
    found.sort()
    out, done = [], 0
    for s, e, _, new in found:
        out += [text[done:s], new]
        done = e
    return "".join(out) + text[done:], [(s, e, k) for s, e, k, _ in found]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def pseudonymise(df: DataFrame, key: bytes, text_col: str = "text", long_numbers: bool = True) -> DataFrame:
    """``df`` with its text pseudonymised and ``pii_spans`` (start, end, kind; places in the text
    as it came, code points). ``long_numbers``: also numbers of 13 to 19 digits that fail Luhn."""
    prepare(df.sparkSession)
    df = df.drop("pii_spans")
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for b in batches:
            texts, spans = [], []
            for t in b.column(at).to_pylist():
                new, got = (None, []) if t is None else find_and_replace(t, names, long_numbers)
                texts.append(new)
                spans.append([{"start": s, "end": e, "kind": k} for s, e, k in got])
            columns = list(b.columns)
            columns[at] = pa.array(texts, b.column(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, _SPANS)], names=[*b.schema.names, "pii_spans"])

    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())])
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("pii_spans", T.ArrayType(span))]))


def op6_feistel(spark, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for personal data, and what was found where."""
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
    return out.select("doc_id", F.size("pii_spans").cast("long").alias("n_pii"),
                      F.array_join(F.transform("pii_spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
                      "text")
