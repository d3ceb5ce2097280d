"""Checksum predicates on column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _weighted(text: Column, weights: list[int]) -> Column:
    """Sum of digit times weight over the first len(weights) digits."""
    return sum((F.substring(text, k + 1, 1).try_cast("int") * w for k, w in enumerate(weights)), F.lit(0))


def ahv_valid(value: Column) -> Column:
    """Swiss AHV number: 13 digits from 756 on, the last an EAN-13 check digit."""
    d = digits(value)
    expected = (10 - _weighted(d, [1, 3] * 6) % 10) % 10
    return F.coalesce((F.length(d) == 13) & d.startswith("756") & (expected == F.substring(d, 13, 1).try_cast("int")), F.lit(False))


def uid_valid(value: Column) -> Column:
    """Swiss UID: CHE-ddd.ddd.ddd, modulo 11; a remainder that would need the digit 10 is invalid."""
    d = digits(value)
    check = 11 - _weighted(d, [5, 4, 3, 2, 7, 6, 5, 4]) % 11
    expected = F.when(check == 11, 0).when(check != 10, check)
    return F.coalesce(value.rlike(r"(?i)^CHE-\d{3}\.\d{3}\.\d{3}$") & (expected == F.substring(d, 9, 1).try_cast("int")), F.lit(False))


def luhn_valid(value: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", digits(value)), F.lit(False))


def iban_valid(value: Column) -> Column:
    """ISO 13616: first four characters moved to the end, letters as 10..35, the number modulo 97 is 1. Folded digit by digit."""
    v = F.upper(F.regexp_replace(value, r"\s", ""))
    turned = F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4))
    step = lambda a, c: F.when(c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + c.try_cast("int")) % 97)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)
    return F.coalesce(v.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$") & (rest == 1), F.lit(False))


def ip_valid(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda o: o.try_cast("int") <= 255)


def bare_year_town(value: Column) -> Column:
    """A four-digit code and a town without a street, where the code may as well be a year of 1900-2099."""
    return value.rlike(r"(?iU)^\d{4}\s+\p{L}[\w-]+$") & F.substring(value, 1, 4).try_cast("int").between(1900, 2099)


#: fixed values: the alphabets of two kinds of crypto addresses, and the generators of the second kind's checksum
_BASE58, _BECH32 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz", "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
_GENERATORS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def _letters(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def crypto_valid(value: Column) -> Column:
    """A Bitcoin address: Base58 with four bytes of a double SHA-256 at its end, or Bech32 (or Bech32m) with its checksum."""
    limbs = [f"n{k}" for k in range(5)]  # a number of 25 bytes as five of 40 bits, the last the lowest

    def times(acc: Column, c: Column) -> Column:
        carry, out = F.position(c, F.lit(_BASE58)).cast("long") - 1, {}
        for n in reversed(limbs):
            x = acc[n] * 58 + carry
            out[n], carry = x.bitwiseAND((1 << 40) - 1), F.shiftright(x, 40)
        return F.struct(*(out[n].alias(n) for n in limbs))

    number = F.aggregate(_letters(value), F.struct(*(F.lit(0).cast("long").alias(n) for n in limbs)), times)
    raw = F.concat(*(F.lpad(F.hex(number[n]), 10, "0") for n in limbs))
    digest = F.sha2(F.unhex(F.sha2(F.unhex(F.substring(raw, 1, 42)), 256)), 256)
    base58 = value.rlike(f"^[13][{_BASE58}]{{25,34}}$") & (F.lower(F.substring(raw, 43, 8)) == F.substring(digest, 1, 8))

    def folded(acc: Column, v: Column) -> Column:
        out = F.shiftleft(acc.bitwiseAND(0x1FFFFFF), 5).bitwiseXOR(v)
        for k, g in enumerate(_GENERATORS):
            out = out.bitwiseXOR(F.shiftright(acc, 25 + k).bitwiseAND(1) * g)
        return out

    low = F.lower(value)
    values = F.concat(F.array(*(F.lit(x).cast("long") for x in (3, 3, 0, 2, 3))), F.transform(_letters(F.substring(low, 4, 90)), lambda c: F.position(c, F.lit(_BECH32)).cast("long") - 1))
    bech32 = low.rlike(f"^bc1[{_BECH32}]{{11,71}}$") & F.aggregate(values, F.lit(1).cast("long"), folded).isin(1, 0x2BC830A3)
    return F.coalesce(F.when(low.startswith("bc1"), bech32).otherwise(base58), F.lit(False))


def licence_valid(value: Column) -> Column:
    """A US medical licence: two characters and seven digits, the last checking the six before."""
    d = F.substring(value, 3, 7)
    at = lambda k: F.substring(d, k, 1).try_cast("int")
    return F.coalesce((at(1) + at(3) + at(5) + 2 * (at(2) + at(4) + at(6))) % 10 == at(7), F.lit(False))
