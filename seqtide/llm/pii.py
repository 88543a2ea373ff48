"""Personal data: format-preserving pseudonyms by a keyed Feistel network.

Numbers, dates, addresses and secrets are found by their form and validated (card numbers by
the Luhn digit, account numbers by their remainder modulo 97, dates by the calendar, octets
by their range).  A found value is a number in its format's domain; a Feistel network keyed
by (key, kind, format) permutes the domain and walks its cycle until it is back inside, so
the pseudonym has the format, passes the same validation, and equal values get equal
pseudonyms in every document without any table of values.

The key is the caller's: who has it can undo the pseudonyms.  Not covered, and left as they
are: dates outside 1900 to 2099 or with names of months, IPv6 addresses, names of persons and
places, and secrets that no word (password, token, ...) or known prefix announces.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import release, small_batches, texts

ROUNDS = 10
#: Setting that holds the key; its name is one that Spark hides in logs and pages.
KEY_SETTING = "spark.seqtide.pseudonym.secret"
#: Characters of a value that are permuted as one number; longer values go in chunks, each tied to all others.
CHUNK = 64
LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _stream(data: bytes, key: bytes, n: int) -> bytes:
    """n bytes that depend on all of the data and the key."""
    if n <= 64:
        return hashlib.blake2b(data, key=key[:64], digest_size=n).digest()
    seed = hashlib.blake2b(data, key=key[:64]).digest()
    return b"".join(hashlib.blake2b(seed + k.to_bytes(4, "big"), key=key[:64]).digest() for k in range(-(-n // 64)))[:n]


def permute(value: int, domain: int, tweak: bytes, key: bytes) -> int:
    """A keyed permutation of range(domain): Feistel rounds on the least even number of bits, cycle-walked into the domain."""
    if domain < 2:
        return value
    half = max(1, ((domain - 1).bit_length() + 1) // 2)
    mask, size = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for i in range(ROUNDS):
            out = _stream(right.to_bytes(size, "big") + bytes([i]) + tweak, key, size + 8)
            left, right = right, left ^ (int.from_bytes(out, "big") & mask)
        value = left << half | right
        if value < domain:
            return value


def session_key(spark: SparkSession) -> bytes:
    """The key of KEY_SETTING; where it is unset one drawn at random, which lasts as long as the application."""
    given = spark.sparkContext.getConf().get(KEY_SETTING) or spark.conf.get(KEY_SETTING, None)
    if not given:
        given = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, given)
    return hashlib.blake2b(given.encode()).digest()


def _by_class(text: str, kind: bytes, key: bytes, hexa: bool = False) -> str:
    """Letters and digits permuted within their classes; all else stays.

    A chunk is one mixed-radix number.  Of a longer value every chunk is permuted under a digest
    of the chunks before it, and then of those after it, so each character depends on all, no
    two values meet, and the time is linear in the length.
    """
    if len(text) <= CHUNK:
        return _chunk(text, kind, key, hexa)
    parts = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
    for step in (b">", b"<"):
        seen, out = hashlib.blake2b(kind + step, key=key[:64], digest_size=16), []
        for part in parts:
            out.append(_chunk(part, kind + step + seen.digest(), key, hexa))
            seen.update(part.encode())
        parts = out[::-1]
    return "".join(parts)


def _chunk(text: str, kind: bytes, key: bytes, hexa: bool) -> str:
    classes = [(DIGIT + "abcdef") if hexa and c in DIGIT + "abcdef" else DIGIT if c in DIGIT else LOWER if c in LOWER else UPPER if c in UPPER else "" for c in text]
    value, domain = 0, 1
    for c, own in zip(text, classes, strict=True):
        if own:
            value, domain = value * len(own) + own.index(c), domain * len(own)
    shape = "".join({DIGIT: "9", LOWER: "a", UPPER: "A", "": "_"}.get(own, "h") for own in classes)
    value, out = permute(value, domain, kind + shape.encode(), key), []
    for c, own in zip(reversed(text), reversed(classes), strict=True):
        if own:
            value, k = divmod(value, len(own))
            c = own[k]
        out.append(c)
    return "".join(reversed(out))


def _fill(text: str, digits: str) -> str:
    """text with its digits replaced in order; separators stay."""
    it = iter(digits)
    return "".join(next(it) if c in DIGIT else c for c in text)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in DIGIT)


def luhn(digits: str) -> int:
    """The remainder that is 0 for a valid number."""
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10


def _card(text: str, key: bytes) -> str | None:
    d = _digits(text)
    if luhn(d) or len(set(d)) == 1:
        return None
    body = str(permute(int(d[:-1]), 10 ** (len(d) - 1), b"card%d" % len(d), key)).zfill(len(d) - 1)
    return _fill(text, body + str((10 - luhn(body + "0")) % 10))


def _phone(text: str, key: bytes) -> str | None:
    head = re.match(r"\+\d{1,2}(?=[ (.-])|", text)[0]
    d = _digits(text[len(head) :])
    if not 7 <= len(d) <= 13:
        return None
    return head + _fill(text[len(head) :], str(permute(int(d), 10 ** len(d), b"phone%d" % len(d), key)).zfill(len(d)))


def _ipv4(text: str, key: bytes) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255:
        return None
    value = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, b"ipv4", key)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _by_class(plain[4:], b"iban", key)
    new = iter(plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(new) for c in text)


def _ssn(text: str, key: bytes) -> str | None:
    area, group, serial = text.split("-")
    if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
        return None
    areas = [x for x in range(1, 900) if x != 666]
    value = permute((areas.index(int(area)) * 99 + int(group) - 1) * 9999 + int(serial) - 1, len(areas) * 99 * 9999, b"ssn", key)
    rest, s = divmod(value, 9999)
    a, g = divmod(rest, 99)
    return f"{areas[a]:03d}-{g + 1:02d}-{s + 1:04d}"


def _date(year: str, month: str, day: str, form: str, key: bytes) -> str | None:
    try:
        at = datetime.date(int(year), int(month), int(day)).toordinal()
    except ValueError:
        return None
    if not _FIRST <= at <= _LAST:
        return None
    new = datetime.date.fromordinal(_FIRST + permute(at - _FIRST, _LAST - _FIRST + 1, b"date", key))
    return form.format(y=new.year, m=new.month, d=new.day)


def _iso(text: str, key: bytes) -> str | None:
    y, m, d = re.split(r"[-/]", text)
    return _date(y, m, d, "{y:04d}%s{m:02d}%s{d:02d}" % (text[4], text[4]), key)


def _dotted(text: str, key: bytes) -> str | None:
    sep = re.search(r"[./-]", text)[0]
    d, m, y = text.split(sep)
    new = _date(y, m, d, f"{{d:02d}}{sep}{{m:02d}}{sep}{{y:04d}}", key)
    if new is None and sep == "/":  # month first
        return _date(y, d, m, "{m:02d}/{d:02d}/{y:04d}", key)
    return new


def _email(text: str, key: bytes) -> str:
    local, _, domain = text.rpartition("@")
    host, _, top = domain.rpartition(".")
    return _by_class(local, b"local", key) + "@" + _by_class(host, b"host", key) + "." + top


def _secret(text: str, key: bytes) -> str:
    return _by_class(text, b"secret", key, hexa=re.fullmatch(r"[0-9a-f]+", text) is not None)


def _aws(text: str, key: bytes) -> str:
    return text[:4] + _by_class(text[4:], b"aws", key)


#: kind -> (pattern of the value, its pseudonym or None if it fails validation); earlier kinds win.
KINDS: dict[str, tuple[str, Callable[[str, bytes], str | None]]] = {
    # A run of an address's characters is tried once, from its start, and never given back: linear however long it is.
    "email": (r"(?<![A-Za-z0-9._%+-])[._%+-]*+\K[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _email),
    "aws_key": (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", _aws),
    "secret": (r"(?i:\b(?:password|passwd|pwd|secret|token|api_?key)\b\s{0,3}[=:]\s{0,3}[\"']?)\K[^\s\"']{6,}", _secret),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _iban),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _ssn),
    "iso_date": (r"(?<![0-9/-])[0-9]{4}(?:-[0-9]{2}-|/[0-9]{2}/)[0-9]{2}(?![0-9/-])", _iso),
    "date": (r"(?<![0-9./-])[0-9]{2}(?:\.[0-9]{2}\.|/[0-9]{2}/|-[0-9]{2}-)[0-9]{4}(?![0-9/-])", _dotted),
    "ipv4": (r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])", _ipv4),
    "card": (r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])", _card),
    "phone": (r"(?<![0-9(+])(?:\+[0-9]{1,2}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{1,2}(?:[ .-]?[0-9]{2,4}){3,5}(?![0-9])", _phone),
}
#: Every value has one of these characters, or follows one; what lies farther off is not searched.
_TRIGGER = re.compile(r"[0-9@=:]|A[KS]IA")
_BEFORE, _AFTER = 32, 8


def regions(text: str) -> Iterator[tuple[int, int]]:
    """The stretches of the text, ending at white space, that can hold a value."""
    start = end = -1
    for m in _TRIGGER.finditer(text):
        at = m.start()
        if at < end:
            continue
        if start < 0 or at - _BEFORE > end:
            if start >= 0:
                yield start, end
            start = max(end, 0, at - _BEFORE)
            while start > 0 and start > end and not text[start - 1].isspace():
                start -= 1
        end = min(len(text), at + _AFTER)
        while end < len(text) and not text[end].isspace():
            end += 1
    if start >= 0:
        yield start, end


class Pseudonyms:
    """Finds the values in a text and replaces them; the key stays on the cluster."""

    def __init__(self, key: bytes) -> None:
        self.find = regex.compile("|".join(f"(?P<{k}>{p})" for k, (p, _) in KINDS.items())).search
        self.only = {k: regex.compile(p) for k, (p, _) in KINDS.items()}
        self.make = lru_cache(maxsize=50_000)(lambda kind, value: KINDS[kind][1](value, key))

    def _valid(self, m, text: str, end: int) -> tuple[str, str, str] | None:
        """Kind, value and pseudonym at the place of a match: of its kind, or else of a later kind that is valid there."""
        kinds = list(KINDS)
        if (new := self.make(m.lastgroup, m[0])) is not None:
            return m.lastgroup, m[0], new
        for kind in kinds[kinds.index(m.lastgroup) + 1 :]:
            if (x := self.only[kind].match(text, m.start(), end)) and (new := self.make(kind, x[0])) is not None:
                return kind, x[0], new
        return None

    def replace(self, text: str) -> tuple[str, list[dict]]:
        """The new text, and spans (start, end in the old text's code points, kind)."""
        out, spans, at = [], [], 0
        for pos, end in regions(text):
            while m := self.find(text, pos, end):
                found = self._valid(m, text, end)
                if found is None:
                    pos = m.start() + 1
                    while pos < end and text[pos - 1].isalnum() and text[pos].isalnum():
                        pos += 1
                    continue
                kind, value, new = found
                out += [text[at : m.start()], new]
                at = pos = m.start() + len(value)
                spans.append({"start": m.start(), "end": at, "kind": kind})
        return "".join([*out, text[at:]]), spans


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """docs with the text's private values replaced, and pii_spans array<struct<start,end,kind>>.

    Other columns stay (one named pii_spans is replaced).  Null texts stay null with no spans;
    texts without such values stay as they are.  Rows are independent: no shuffle, no state.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    small_batches(docs.sparkSession)
    docs = docs.drop("pii_spans")
    names = [*docs.columns, "pii_spans"]
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))
    schema = T.StructType([*(T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema), T.StructField("pii_spans", span)])
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        names_, pseudonyms = names, Pseudonyms(key)
        for batch in batches:
            out, spans = [], []
            for text in texts(batch, text_col):
                if text is None:
                    out.append(text)
                    spans.append([])
                else:
                    new, found = pseudonyms.replace(text.decode())
                    out.append(new.encode())
                    spans.append(found)
            k = batch.schema.get_field_index(text_col)
            columns = [pa.array(out, pa.binary()).cast(pa.string()) if i == k else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, arrow)], names=names_)

    return docs.mapInArrow(fn, schema)


def summary(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """doc_id, the new text, its spans, and their number; without a key under that of the session."""
    out = pseudonymise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key or session_key(docs.sparkSession))
    return out.select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_pii"), "pii_spans")
