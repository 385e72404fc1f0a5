"""Format-preserving pseudonyms of personal data.

Numbers and dates that pass their checks (Luhn for cards, mod 97 for IBANs, octets of addresses,
calendar dates from 1900 to 2099, ...) are permuted by a keyed Feistel network over exactly the
values of their format, so a pseudonym passes the same checks, equal values stay equal in all
documents, and nothing has to be remembered or shuffled. The key must be given; without it the
permutation can't be undone. Case and separators of the original are kept.

Nulls stay null (counts 0), empty and very long texts are ordinary texts, repeated rows give
repeated rows. Patterns look ahead by a bounded length or never go back, so time is linear in the text's length.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import secrets
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, documents

#: Where a session keeps the key.
KEY_SETTING = "spark.pairlens.pii.key"
ROUNDS = 10
#: Characters of a value that are permuted as one number.
SPAN = 128
KINDS = ("email", "secret", "phone", "iban", "card", "ssn", "ip", "date")
_FIND = regex.compile(
    r"""
    (?P<email>(?<![\w.+%-])[\w.+%-]++@(?:[a-z0-9][a-z0-9-]{0,62}\.){1,8}[a-z]{2,24}(?![\w]))
  | (?:(?<=\btoken\s=\s["'])|(?<=\b(?:token|secret|api_?key|password|passwd)["']?\s?[:=]\s?["']?))(?P<secret>eyj[0-9a-z_-]{13,}+(?:\.[0-9a-z_-]++){1,2}|[0-9a-z_/+-]{16,}+)(?![\w])
  | (?P<phone>(?<![\w])(?:\+?1[\s.-]?)?\(\d{3}\)[\s.-]?\d{3}[ .-]\d{4}(?![\w])|(?<![\w.-])(?:\+?1[\s.-])?\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])
    |(?<![\w.,+-])(?<!\d[ ])(?:1[ ])?[2-9]\d{2}[ ]\d{3}[ ]\d{4}(?![\w-]|[.,]\d|[ ]\d{3})
    |(?<![\w+])(?:\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}|(?:\+(?!1)|00(?=[2-9]\d{0,2}[ .-]))\d(?:[ ]?\(0\)[ ]?|[ ./-]?\(?\d\)?){6,14})(?![\w-]))
  | (?P<iban>(?<![\w])[a-z]{2}\d{2}(?:[ ]?[0-9a-z]{4}){2,7}(?:[ ]?[0-9a-z]{1,4})?(?![\w]))
  | (?P<card>(?<![\w.-])(?:\d{13,19}|\d{4}([ -])\d{4}\g<-1>\d{4}\g<-1>\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-]))
  | (?P<ssn>(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-]))
  | (?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))
  | (?P<date>(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\w/-]))
  | (?<=\b(?:tel|telephone|phone|mobile|cell|fax|call)\b[.:]{0,2}[ ]?)(?P<phone>\(?\d\)?(?:[ ./-]?\(?\d\)?){6,14}(?![\w]|[ ./-]?\d))
    """.replace(r"\g<-1>", r"[ -]"),
    regex.X | regex.I,
)
#: Length of a country's IBANs.
IBAN_LENGTHS = {
    c: n for n, names in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items() for c in names.split()
}
#: Country calling codes of two digits; 1 and 7 have one, all others three.
_TWO = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_EPOCH, _DAYS = datetime.date(1900, 1, 1).toordinal(), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


def permute(x: int, size: int, key: bytes, kind: str) -> int:
    """A keyed permutation of 0..size-1: an unbalanced Feistel network over a grid that just covers
    the range, walked on until it is back inside."""
    a = math.isqrt(max(size - 1, 0)) + 1
    b = -(-size // a)
    wide = max(16, (a.bit_length() + 71) // 8)

    def noise(half: int, step: int, modulus: int) -> int:
        said = b"%s|%d|%d|%d" % (kind.encode(), size, step, half)
        out, block = b"", 0
        while len(out) < wide:
            out += hashlib.blake2b(said, key=key[:64], salt=block.to_bytes(8, "big")).digest()
            block += 1
        return int.from_bytes(out[:wide], "big") % modulus

    while True:
        left, right = divmod(x, b)
        for step in range(0, ROUNDS, 2):
            left = (left + noise(right, step, a)) % a
            right = (right + noise(left, step + 1, b)) % b
        x = left * b + right
        if x < size:
            return x


@lru_cache(4096)
def _alphabet(c: str) -> str:
    """The characters that c is permuted among: digits, a to z, or the letters of its case and run of 128 code points."""
    if "0" <= c <= "9":
        return "0123456789"
    if c.lower() in _LOWER:
        return _LOWER
    if not c.isalpha():
        return ""
    run = map(chr, range(ord(c) & ~127, (ord(c) | 127) + 1))
    return "".join(x for x in run if x.isalpha() and x.lower() not in _LOWER and (x.isupper(), x.islower()) == (c.isupper(), c.islower()))


def _spelled(text: str, key: bytes, kind: str) -> str:
    """Digits for digits and letters for letters of the same alphabet; two texts never become one (but for the case of a to z)."""
    if len(text) > SPAN:  # in turns, each under a key of what stands before it, so time is linear and equal values stay equal
        before, out = hashlib.blake2b(digest_size=16), []
        for i in range(0, len(text), SPAN):
            out.append(_spelled(text[i : i + SPAN], key, f"{kind} {before.hexdigest()}" if i else kind))
            before.update(text[i : i + SPAN].lower().encode())
        return "".join(out)
    x, size, spots, shape = 0, 1, [], []
    for i, c in enumerate(text):
        alphabet = _alphabet(c)
        if alphabet:
            x, size = x * len(alphabet) + alphabet.index(c.lower() if alphabet == _LOWER else c), size * len(alphabet)
            spots.append((i, alphabet))
            shape.append(alphabet[0])
    if not spots:
        return text
    # texts of other alphabets are permuted apart
    x, out = permute(x, size, key, kind if all(a in "0a" for a in shape) else kind + "".join(shape)), list(text)
    for i, alphabet in reversed(spots):
        x, d = divmod(x, len(alphabet))
        out[i] = alphabet[d].upper() if alphabet == _LOWER and text[i].isupper() else alphabet[d]
    return "".join(out)


def _into(digits: str, text: str) -> str:
    """The characters of text's format with these digits and letters."""
    rest = iter(digits)
    return "".join((d.upper() if c.isupper() else d.lower()) if c.isalnum() and (d := next(rest)) else c for c in text)


def luhn(digits: str) -> int:
    """Sum of Luhn's scheme modulo 10; 0 for valid numbers."""
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def _card(text: str, key: bytes) -> str | None:
    digits = "".join(c for c in text if c.isdecimal())
    if not digits.isascii() or luhn(digits) or not 13 <= len(digits) <= 19 or len(set(digits)) == 1:
        return None
    body = str(permute(int(digits[:-1]), 10 ** (len(digits) - 1), key, "card")).zfill(len(digits) - 1)
    return _into(body + str(-luhn(body + "0") % 10), text)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban(text: str, key: bytes) -> str | None:
    """The IBAN at the start of text, without the words behind it that the pattern may have taken in.

    It ends at the end of a word, with the length that its country prescribes; without such a country it is
    the longest that passes.
    """
    ends = [i for i in range(len(text), 0, -1) if i == len(text) or text[i] == " "]
    for end in ends:
        plain = "".join(text[:end].split()).upper()
        if not plain.isascii() or len(plain) != IBAN_LENGTHS.get(plain[:2], len(plain)) or not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
            continue
        body = _spelled(plain[4:], key, "iban " + plain[:2])
        return _into(plain[:2] + str(98 - _mod97(body + plain[:2] + "00")).zfill(2) + body, text[:end])
    return None


def _phone(text: str, key: bytes) -> str | None:
    """The calling code stays, and so does a (0) behind it; the others are permuted by code and length."""
    trunk = text.find("(0)") if text[0] in "+0" else -1
    if trunk >= 0:
        made = _phone(text[:trunk] + text[trunk + 3 :], key)
        return None if made is None else made[:trunk] + "(0)" + made[trunk:]
    digits = "".join(c for c in text if c.isdecimal())
    if not digits.isascii():
        return None
    prefix = 1 if text[0] != "+" and digits[0] == "1" and len(digits) == 11 else 0
    if text[0] == "+" or digits[:2] == "00" and digits[2:3] not in ("", "0"):
        zeros = 0 if text[0] == "+" else 2
        code = 1 if digits[zeros] in "17" else 2 if digits[zeros : zeros + 2] in _TWO else 3
        prefix = zeros + code
    code, rest = digits[:prefix].lstrip("0"), digits[prefix:]
    if not rest or len(code + rest) > 15:
        return None
    kind = "phone" if code in ("", "1") and len(rest) == 10 else f"phone {code} {len(rest)}"
    return _into(digits[:prefix] + str(permute(int(rest), 10 ** len(rest), key, kind)).zfill(len(rest)), text)


def _ssn(text: str, key: bytes) -> str | None:
    a, b, c = map(int, text.split("-"))
    if a in (0, 666) or a >= 900 or not b or not c:
        return None
    x = permute(((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1, 898 * 99 * 9999, key, "ssn")
    x, c = divmod(x, 9999)
    a, b = divmod(x, 99)
    return f"{a + 1 + (a >= 665):03}-{b + 1:02}-{c + 1:04}"


def _ip(text: str, key: bytes) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255:
        return None
    return ".".join(map(str, permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "ip").to_bytes(4, "big")))


def _date(text: str, key: bytes) -> str | None:
    for form in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y", "%m.%d.%Y"):
        try:
            day = datetime.datetime.strptime(text, form).date().toordinal() - _EPOCH
        except ValueError:
            continue
        return datetime.date.fromordinal(_EPOCH + permute(day, _DAYS, key, "date")).strftime(form) if 0 <= day < _DAYS else None
    return None


_MAKE = {
    "email": lambda text, key: _spelled(text[: text.rfind(".")], key, "email") + text[text.rfind(".") :],
    "secret": lambda text, key: _spelled(text, key, "secret") if any(c.isdecimal() for c in text) else None,
    "phone": _phone, "iban": _iban, "card": _card, "ssn": _ssn, "ip": _ip, "date": _date,
}


def pseudonymise(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many values of each kind were found."""
    counts: dict[str, int] = {}
    out, done, at = [], 0, 0
    while m := _FIND.search(text, at):
        kind, value = m.lastgroup, m.group(m.lastgroup)
        made, at = _MAKE[kind](value, key), m.end()
        if kind == "iban":  # what its pattern took in besides may hold other values
            at = m.start() + len(made or value[:4])
        if made is None:
            continue
        counts[kind] = counts.get(kind, 0) + 1
        out += [text[done : m.start()], made]
        done = at
    return "".join(out) + text[done:], counts


def pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with pseudonyms in text (n_chars, if there, follows), and a count ``n_<kind>`` of each kind.

    Columns whose names clash with a count's are replaced by the count.
    """
    bounded_batches(docs.sparkSession)
    names = [f"n_{k}" for k in KINDS]
    keep = [c for c in docs.columns if c not in names]
    fields = [docs.schema[c] for c in keep]
    at = keep.index("text")

    def run(it):
        for batch in it:
            column = batch.column(at).cast(pa.large_string())
            # every kind needs a digit or an @; most texts have neither and go through as they are
            maybe = pc.fill_null(pc.match_substring_regex(column, "[0-9@]"), False).to_pylist()
            out, counts = column.to_pylist(), [[0] * len(maybe) for _ in KINDS]
            for i, m in enumerate(maybe):
                if m:
                    out[i], found = pseudonymise(out[i], key)
                    for k, n in found.items():
                        counts[KINDS.index(k)][i] = n
            columns = [batch.column(keep.index(c)) if c != "text" else pa.array(out, batch.column(at).type) for c in keep]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(c, pa.int64()) for c in counts], keep + names)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{n}` long" for n in names]
    out = docs.select(*(f"`{c}`" for c in keep)).mapInArrow(run, ", ".join(kinds))
    if "n_chars" in keep:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def session_key(spark) -> bytes:
    """The key in the session's settings; where there is none, one drawn at random for this session, which is kept there.

    Such a key is in no source and no other session has it: values stay linked within the session only.
    """
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING).encode()


def op6_pii(spark, sf_dir):
    return pseudonyms(documents(spark, sf_dir).select("doc_id", "text"), session_key(spark))


QUERIES = {"op6_pii": op6_pii}
