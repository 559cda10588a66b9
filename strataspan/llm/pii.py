"""Format-preserving pseudonyms for personal data: keyed Feistel permutations inside each value's format."""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from strataspan.llm.common import small_batches

ROUNDS = 8
#: Dates are permuted within these two centuries.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"


def _round(key: bytes, tweak: bytes, i: int, half: int, size: int) -> int:
    data = tweak + i.to_bytes(1, "big") + half.to_bytes((half.bit_length() + 7) // 8 or 1, "big")
    return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=16).digest(), "big") % size


def permute(x: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of 0..size-1 (or its inverse).

    A Feistel network over a * b >= size with the two halves modulo a and b; values beyond the range walk
    the cycle until they fall into it.
    """
    if size < 2:
        return x
    a = int(size**0.5)
    while a * a < size:
        a += 1
    b = -(-size // a)
    while True:
        left, right = divmod(x, b)  # left < a, right < b
        for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2 == 0:
                left = (left + sign * _round(key, tweak, i, right, a)) % a
            else:
                right = (right + sign * _round(key, tweak, i, left, b)) % b
        x = left * b + right
        if x < size:
            return x


def luhn(digits: str) -> bool:
    return _check_digit(digits[:-1]) == int(digits[-1])


def _check_digit(body: str) -> int:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(value: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in value)


def _number(value: str, key: bytes, back: bool, keep: int = 0) -> str:
    """Permute the digits after the first `keep`, leaving the punctuation in place."""
    digits = re.sub(r"\D", "", value)
    head, body = digits[:keep], digits[keep:]
    new = permute(int(body), 10 ** len(body), key, b"n%d" % len(body) + head.encode(), back)
    return _refill(value, head + str(new).zfill(len(body)))


def _card(value: str, key: bytes, back: bool) -> str:
    """The digits before the check digit are permuted and the check digit follows, so the result is valid too."""
    body = re.sub(r"\D", "", value)[:-1]
    new = str(permute(int(body), 10 ** len(body), key, b"c%d" % len(body), back)).zfill(len(body))
    return _refill(value, new + str(_check_digit(new)))


def _address(value: str, key: bytes, back: bool) -> str:
    n = 0
    for part in value.split("."):
        n = n * 256 + int(part)
    n = permute(n, 1 << 32, key, b"ip", back)
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def _address6(value: str, key: bytes, back: bool) -> str:
    """All notations of an address have one pseudonym; turned back, it has the shortest notation."""
    return str(ipaddress.IPv6Address(permute(int(ipaddress.IPv6Address(value)), 1 << 128, key, b"ip6", back)))


def _valid_address6(value: str) -> bool:
    try:
        return ipaddress.IPv6Address(value).packed is not None and sum(c.isalnum() for c in value) > 2
    except ValueError:
        return False


# The names of the months in four languages.
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
#: How dates are written: the parts of each form, in order, what stands between them, and the language of the month.
FORMS = [
    (re.compile(r"(?P<y>\d{4})(?P<s>[-/])(?P<m>\d\d)(?P=s)(?P<d>\d\d)"), "{y:04}{s}{m:02}{s}{d:02}", None),
    (re.compile(r"(?P<d>\d\d)\.(?P<m>\d\d)\.(?P<y>\d{4})"), "{d:02}.{m:02}.{y:04}", None),
    (re.compile(r"(?P<m>0\d|1[0-2])/(?P<d>\d\d)/(?P<y>\d{4})"), "{m:02}/{d:02}/{y:04}", None),
    (re.compile(r"(?P<d>1[3-9]|2\d|3[01])/(?P<m>\d\d)/(?P<y>\d{4})"), "{d:02}/{m:02}/{y:04}", None),
    (re.compile(r"(?P<m>[A-Z][a-z]+) (?P<d>\d{1,2}), (?P<y>\d{4})"), "{m} {d}, {y:04}", "en"),
    (re.compile(r"(?P<d>\d{1,2}) (?P<m>[A-Z][a-z]+) (?P<y>\d{4})"), "{d} {m} {y:04}", "en"),
    (re.compile(r"(?P<d>\d{1,2})\. (?P<m>[A-Z][a-zä]+) (?P<y>\d{4})"), "{d}. {m} {y:04}", "de"),
    (re.compile(r"(?P<d>\d{1,2}) (?P<m>[a-zéû]+) (?P<y>\d{4})"), "{d} {m} {y:04}", "fr"),
    (re.compile(r"(?P<d>\d{1,2}) de (?P<m>[a-z]+) de (?P<y>\d{4})"), "{d} de {m} de {y:04}", "es"),
]


def _read_date(value: str) -> tuple[int, int, str] | None:
    """(form, day number, separator) of a valid date of the two centuries that is written as its form would write it."""
    for i, (pattern, _, names) in enumerate(FORMS):
        m = pattern.fullmatch(value)
        if m and (not names or m["m"] in MONTHS[names]):
            try:
                day = datetime.date(int(m["y"]), MONTHS[names].index(m["m"]) + 1 if names else int(m["m"]), int(m["d"])).toordinal()
            except ValueError:
                continue
            found = i, day, m.groupdict().get("s") or ""
            if FIRST_DAY <= day <= LAST_DAY and _write_date(*found) == value:
                return found
    return None


def _write_date(form: int, day: int, sep: str) -> str:
    d = datetime.date.fromordinal(day)
    _, out, names = FORMS[form]
    return out.format(y=d.year, m=MONTHS[names][d.month - 1] if names else d.month, d=d.day, s=sep)


def _date(value: str, key: bytes, back: bool) -> str:
    """One permutation of days for all forms; days that a form can't write, or another would read, walk on along their cycle."""
    form, day, sep = _read_date(value)
    while True:
        day = permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, b"date", back) + FIRST_DAY
        if _read_date(new := _write_date(form, day, sep)) == (form, day, sep):
            return new


def _shaped(value: str, key: bytes, tweak: bytes, back: bool) -> str:
    """Letters and digits permuted within their shape; capitals are of the shape, so values that differ in case only stay linked."""
    low = value.lower()
    sets = [next((s for s in (DIGITS, LOWER) if c in s), "") for c in low]
    n, size = 0, 1
    for c, s in zip(low, sets, strict=True):
        if s:
            n, size = n * len(s) + s.index(c), size * len(s)
    shape = "".join(s[0] if s else c for c, s in zip(low, sets, strict=True))
    n = permute(n, size, key, tweak + shape.encode(), back)
    out = []
    for c, new, s in zip(reversed(value), reversed(low), reversed(sets), strict=True):
        capital = c != new
        if s:
            n, i = divmod(n, len(s))
            new = s[i]
        out.append(new.upper() if capital else new)
    return "".join(reversed(out))


def _mail(value: str, key: bytes, back: bool) -> str:
    """The local part and each label of the domain but the last are permuted within their shapes of letters and digits."""
    local, _, domain = value.partition("@")
    *labels, top = domain.split(".")
    new = [_shaped(x, key, b"d", back) for x in labels]
    real = ".".join([*(new if back else labels), top]).lower()
    return _shaped(local, key, b"m" + real.encode() + b"@", back) + "@" + ".".join([*new, top])


def _iban_check(country: str, body: str) -> str:
    digits = "".join(str(int(c, 36)) for c in body + country) + "00"
    return f"{98 - int(digits) % 97:02}"


def _iban(value: str, key: bytes, back: bool) -> str:
    """The digits and letters behind the check digits are permuted in their shape, and the check digits follow."""
    plain = value.replace(" ", "")
    body = _shaped(plain[4:].lower(), key, b"iban" + plain[:2].encode(), back).upper()
    it = iter(plain[:2] + _iban_check(plain[:2], body) + body)
    return "".join(c if c == " " else next(it) for c in value)


def _valid_iban(value: str) -> bool:
    plain = value.replace(" ", "")
    return 15 <= len(plain) <= 34 and _iban_check(plain[:2], plain[4:]) == plain[2:4]


def _valid_address(value: str) -> bool:
    parts = value.split(".")
    return all(int(p) < 256 and str(int(p)) == p for p in parts)


def _valid_social(value: str) -> bool:
    return value[:3] not in ("000", "666") and value[0] != "9" and value[4:6] != "00" and value[7:] != "0000"


def _walk(valid: Callable[[str], bool]) -> Callable[[str, bytes, bool], str]:
    """The digits' permutation, repeated until the number is valid again."""

    def alias(value: str, key: bytes, back: bool) -> str:
        while True:
            value = _number(value, key, back)
            if valid(value):
                return value

    return alias


def _plain_phone(value: str) -> bool:
    return value[0] in "23456789"


def _country(value: str) -> int:
    """Digits that stay in front of a telephone number: the country code, two digits where nothing ends it."""
    m = re.match(r"\+(?:(\d{1,3})[ .(-]|\d\d)", value)
    return 0 if not m else len(m[1]) if m[1] else 2


def _phone(value: str, key: bytes, back: bool) -> str:
    return _number(value, key, back, keep=_country(value))


_MONTH = "|".join(dict.fromkeys(m for names in MONTHS.values() for m in names))
#: kind: (pattern, whether a match is valid, the pseudonym); earlier kinds win where matches overlap.
KINDS: dict[str, tuple[str, Callable[[str], bool], Callable[[str, bytes, bool], str]]] = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])", lambda v: True, _mail),
    "ip": (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", _valid_address, _address),
    "ip6": (r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])", _valid_address6, _address6),
    "date": (
        r"(?<![\d/.-])(?:\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4})(?![\d/-])"
        rf"|(?<!\w)(?:\d{{1,2}}\.? (?:de )?(?:{_MONTH}) (?:de )?\d{{4}}|(?:{'|'.join(MONTHS['en'])}) \d{{1,2}}, \d{{4}})(?!\w)",
        lambda v: _read_date(v) is not None,
        _date,
    ),
    "ssn": (r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])", _valid_social, _walk(_valid_social)),
    "iban": (r"(?<!\w)[A-Z]{2}\d\d(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)", _valid_iban, _iban),
    "phone": (r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)", lambda v: True, _phone),
    "international": (r"(?<![\w+])\+\d{1,3}(?:[ .-]?(?:\(\d{1,4}\)|\d{1,7})){1,5}(?!\d)", lambda v: 8 <= sum(map(str.isdigit, v)) <= 15, _phone),
    "card": (r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])", lambda v: luhn(re.sub(r"\D", "", v)), _card),
    "number": (r"(?<![\w.+-])[2-9]\d{9}(?![\w-]|\.\d)", _plain_phone, _walk(_plain_phone)),
}
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, (p, _, _) in KINDS.items()))
_HINT = re.compile(r"[@0-9]")


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with each valid value replaced, and (start, end, kind, pseudonym) of each in the original."""
    if not _HINT.search(text):
        return text, []
    spans, out, at = [], [], 0
    for m in _ANY.finditer(text):
        _, valid, alias = KINDS[m.lastgroup]
        if valid(m[0]):
            new = alias(m[0], key, back)
            spans.append((m.start(), m.end(), m.lastgroup, new))
            out += [text[at : m.start()], new]
            at = m.end()
    return "".join([*out, text[at:]]), spans


SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("alias", pa.string())]))


def pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """Every document's text with validated numbers, addresses and dates replaced by keyed pseudonyms.

    Equal values get equal pseudonyms in every document, of the same format (length, punctuation, letter
    case, checksum, calendar), and the key holder can turn them back. Each row is handled alone.
    Null text stays null with no span; empty text stays empty; other columns are ignored; repeated rows give
    repeated results; an empty table gives no rows. Whoever has the key can undo them, so it has no default.

    Returns doc_id, text, spans (array of start, end: code points of the original; kind, alias).
    """

    if not key:
        raise ValueError("pseudonyms need a secret key")

    def run(batches):
        for batch in batches:
            texts, spans = [], []
            for t in batch.column("text"):
                t = t.as_py()
                new, found = (None, []) if t is None else pseudonymise(t, key)
                texts.append(new)
                spans.append([dict(zip(("start", "end", "kind", "alias"), s, strict=True)) for s in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(spans, SPAN)], ["doc_id", "text", "spans"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, spans array<struct<start:int,end:int,kind:string,alias:string>>")
