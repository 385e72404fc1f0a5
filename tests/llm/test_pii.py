"""Pseudonyms against checks and a permutation written anew here, which call nothing of the module but its operator."""

import hashlib
import math
import re
import time
from collections import defaultdict

import pytest

from pairlens.llm import pii


def network(x, size, key, kind):
    """Feistel rounds over a grid of about sqrt(size) by sqrt(size), repeated until the result is in range."""
    a = math.isqrt(size - 1) + 1
    b = (size + a - 1) // a
    n = max(16, (a.bit_length() + 71) // 8)

    def f(half, step):
        data, i = b"", 0
        while len(data) < n:
            data += hashlib.blake2b(f"{kind}|{size}|{step}|{half}".encode(), key=key, salt=i.to_bytes(8, "big")).digest()
            i += 1
        return int.from_bytes(data[:n], "big")

    while True:
        hi, lo = x // b, x % b
        for step in range(10):
            if step % 2:
                lo = (lo + f(hi, step)) % b
            else:
                hi = (hi + f(lo, step)) % a
        x = hi * b + lo
        if x < size:
            return x


def check_digit(body):
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str((10 - total % 10) % 10)


def remainder97(iban):
    r = 0
    for c in iban[4:] + iban[:4]:
        for d in c if c.isdigit() else str(ord(c) - 55):
            r = (10 * r + int(d)) % 97
    return r


def texts(n):
    """Rows with cards, IBANs, addresses and dates among words, each value in several documents; what fails its check stays."""
    out = []
    for i in range(n):
        body = f"4{i % 40 * 7919 + 123456789012:014d}"[:15]
        card = body + check_digit(body)
        bad = body + str((int(check_digit(body)) + 3) % 10)
        bban = f"37040044{i % 30 * 104729 + 532013000:010d}"
        iban = next(f"DE{k:02d}{bban}" for k in range(2, 99) if remainder97(f"DE{k:02d}{bban}") == 1)
        ip, day = f"10.{i % 7}.{i % 5}.{200 + i % 50}", f"20{i % 30:02d}-0{1 + i % 9}-{10 + i % 18}"
        out.append((i, f"paid by {card} not {bad}; account {iban} from {ip} on {day}.", (card, bad, iban, ip, day)))
    return out


def test_pseudonyms_equal_a_plain_permutation(spark):
    rows, key = texts(120), b"another key"
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["text"] for r in pii.pseudonyms(df, key).collect()}
    seen = defaultdict(set)
    for i, text, (card, bad, iban, ip, day) in rows:
        body = f"{network(int(card[:15]), 10**15, key, 'card'):015d}"
        address = ".".join(map(str, network(int.from_bytes(bytes(map(int, ip.split("."))), "big"), 2**32, key, "ip").to_bytes(4, "big")))
        made = re.fullmatch(r"paid by (\d{16}) not (\d{16}); account (DE\d{20}) from ([\d.]+) on (\d{4}-\d\d-\d\d)\.", got[i]).groups()
        assert made[0] == body + check_digit(body) and made[1] == bad and made[3] == address and remainder97(made[2]) == 1
        # digits of the account, as one number among those of 18 digits
        assert made[2][4:] == f"{network(int(iban[4:]), 10**18, key, 'iban DE'):018d}"
        for value, new in zip((card, iban, ip, day), (made[0], *made[2:]), strict=True):
            seen[value].add(new)
    assert all(len(x) == 1 for x in seen.values()) and len({next(iter(x)) for x in seen.values()}) == len(seen)


@pytest.mark.parametrize("n", [16, 128, 129, 200, 400, 4_000, 10_000])
def test_secrets_of_any_length_go(n):
    value = ("Ab3dEfG7" * n)[:n]
    text = f'api_key = "{value}" and token: {value[::-1]}, then words'
    made, counts = pii.pseudonymise(text, b"k")
    assert counts == {"secret": 2} and value not in made and value[::-1] not in made and len(made) == len(text) and made.endswith(", then words")
    # no run of the value survives, equal values stay equal, others differ
    assert not any(value[i : i + 14] in made for i in range(0, n - 13, 7))
    assert pii.pseudonymise(text, b"k")[0] == made and pii.pseudonymise(text, b"l")[0] != made
    other = value[:-1] + ("8" if value[-1] != "8" else "9")
    assert pii.pseudonymise(f"token: {other}", b"k")[0] != pii.pseudonymise(f"token: {value}", b"k")[0]


def test_signed_web_tokens_and_long_names_go():
    token = "eyJhbGciOiJIUzI1NiJ9." + "eyJzdWIiOiIxMjM0NTY3ODkw" * 9 + ".SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV"
    made, counts = pii.pseudonymise(f"token={token} end", b"k")
    assert counts == {"secret": 1} and not any(p in made for p in token.split(".")) and made.endswith(" end") and len(made) == len(token) + 10
    name = "first.last." * 30 + "x"
    made, counts = pii.pseudonymise(f"mail {name}@example.com now", b"k")
    assert counts == {"email": 1} and name not in made and "example" not in made and made.endswith(".com now")


def test_time_is_linear():
    took = []
    for n in (50_000, 200_000):
        text = "a" * n + " " + "token: " + "b1" * n + " " + "x@" * n + "1." * n
        began = time.perf_counter()
        pii.pseudonymise(text, b"k")
        took.append(time.perf_counter() - began)
    assert took[1] < 9 * took[0] + 0.5


def test_a_session_without_a_key_gets_one_of_its_own(spark):
    spark.conf.unset(pii.KEY_SETTING)
    key = pii.session_key(spark)
    assert len(key) == 64 and pii.session_key(spark) == key
    spark.conf.unset(pii.KEY_SETTING)
    assert pii.session_key(spark) != key
    spark.conf.set(pii.KEY_SETTING, "given")
    assert pii.session_key(spark) == b"given"
    spark.conf.unset(pii.KEY_SETTING)
