"""Checksum predicates and generators of valid values, as column expressions."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the tax-code check character: the value of each character at odd places (1st, 3rd, ...),
# in the order 0-9, A-Z.
CF_ODD = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]
SYMBOLS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OMOCODE_LETTERS = "LMNPQRSTUV"
OMOCODE_PLACES = (15, 14, 13, 11, 10, 8, 7)  # digit places of the code from the right, counted from 1
MONTH_LETTERS = "ABCDEHLMPRST"


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _symbol(c: Column) -> Column:
    """0-35 for 0-9, A-Z."""
    return F.instr(F.lit(SYMBOLS), c) - 1


def mod97(s: Column) -> Column:
    """The number that s (0-9, A-Z as 10-35) spells, modulo 97."""
    step = lambda acc, c: (acc * F.when(_symbol(c) > 9, 100).otherwise(10) + _symbol(c)) % 97
    return F.aggregate(chars(s), F.lit(0), step)


def iban_ok(s: Column, normalise: bool = True) -> Column:
    c = F.upper(F.regexp_replace(s, r"(?U)[\s.\-]", "")) if normalise else s
    turned = F.concat(F.substring(c, 5, 64), F.substring(c, 1, 4))
    ok = F.length(c).between(15, 34) & c.rlike("^[0-9A-Z]+$")
    return F.coalesce(F.when(ok, mod97(turned) == 1).otherwise(F.lit(False)), F.lit(False))


def _vat_sum(d: Column) -> Column:
    def value(c, i):
        n = F.try_to_number(c, F.lit("9")).cast("int")
        twice = n * 2
        return F.when(i % 2 == 0, n).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(chars(d), value), F.lit(0), lambda a, x: a + x)


def piva_ok(s: Column, normalise: bool = True) -> Column:
    d = digits_of(s) if normalise else s
    ok = d.rlike("^[0-9]{11}$")
    check = (10 - _vat_sum(F.substring(d, 1, 10)) % 10) % 10
    return F.coalesce(F.when(ok, check.cast("string") == F.substring(d, 11, 1)).otherwise(F.lit(False)), F.lit(False))


def _check_letter(body: Column) -> Column:
    odd = F.array(*map(F.lit, CF_ODD))

    def value(c, i):
        k = _symbol(c)
        even = F.when(k > 9, k - 10).otherwise(k)
        return F.when(i % 2 == 0, F.try_element_at(odd, k + 1)).otherwise(F.when(k >= 0, even))

    total = F.aggregate(F.transform(chars(body), value), F.lit(0), lambda a, x: a + x)
    return F.chr(65 + total % 26)


def cf_ok(s: Column, normalise: bool = True) -> Column:
    c = F.upper(F.trim(s)) if normalise else s
    ok = c.rlike("^[0-9A-Z]{16}$")
    return F.coalesce(F.when(ok, _check_letter(F.substring(c, 1, 15)) == F.substring(c, 16, 1)).otherwise(F.lit(False)), F.lit(False))


def luhn_ok(s: Column, normalise: bool = True) -> Column:
    d = digits_of(s) if normalise else s
    return F.coalesce(F.when(F.length(d).between(13, 19), F.call_function("luhn_check", d)).otherwise(F.lit(False)), F.lit(False))


# ------------------------------------------------------------ generators

def vat_number(ten_digits: Column) -> Column:
    """A valid VAT number from its first ten digits."""
    return F.concat(ten_digits, ((10 - _vat_sum(ten_digits) % 10) % 10).cast("string"))


def iban_it(bban22: Column) -> Column:
    """A valid Italian IBAN from bank, branch and account (22 digits)."""
    bban = F.concat(_check_letter(bban22), bban22)
    check = F.lpad((98 - mod97(F.concat(bban, F.lit("IT00")))).cast("string"), 2, "0")
    return F.concat(F.lit("IT"), check, bban)


@functools.cache
def _decomposed() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters whose compatibility decomposition leaves one ASCII letter, those letters, and (character, letters) of the others."""
    one, several = {}, []
    for i in range(0x80, 0x10000):
        if 0xD800 <= i < 0xE000:
            continue
        left = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if c.isascii() and c.isalpha()).upper()
        if len(left) == 1:
            one[chr(i)] = left
        elif left:
            several.append((chr(i), left))
    return "".join(one), "".join(one.values()), tuple(several)


def letters_only(s: Column) -> Column:
    """Upper-case ASCII letters of s after compatibility decomposition (an accent goes, a ligature becomes its letters); letters without one go.

    Characters beyond the basic plane go. Decomposing comes before upper case, so a sharp s goes as well.
    """
    marked, plain, several = _decomposed()
    spelled = F.create_map(*[F.lit(x) for pair in several for x in pair])
    parts = F.transform(chars(s), lambda c: F.coalesce(F.try_element_at(spelled, c), c))
    s = F.when(s.rlike("[" + "".join(c for c, _ in several) + "]"), F.array_join(parts, "")).otherwise(s)
    return F.regexp_replace(F.upper(F.regexp_replace(F.translate(s, marked, plain), "[^A-Za-z]", "")), "[^A-Z]", "")


def _three(s: Column, given: bool) -> Column:
    cons, vow = F.regexp_replace(s, "[AEIOU]", ""), F.regexp_replace(s, "[^AEIOU]", "")
    usual = F.substring(F.concat(cons, vow, F.lit("XXX")), 1, 3)
    if not given:
        return usual
    return F.when(F.length(cons) >= 4, F.concat(F.substring(cons, 1, 1), F.substring(cons, 3, 2))).otherwise(usual)


def tax_code(given: Column, surname: Column, sex: Column, year: Column, month: Column, day: Column, place: Column, omocode: int | Column = 0) -> Column:
    """A valid tax code; place is the cadastral code, omocode the number of digits written as letters, from the right."""
    dd = F.when(sex == "F", day + 40).otherwise(day)
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    body = F.concat(_three(letters_only(surname), False), _three(letters_only(given), True), pad(year % 100), F.substring(F.lit(MONTH_LETTERS), month, F.lit(1)), pad(dd), place)
    if isinstance(omocode, Column) or omocode:
        rank = F.array(*[F.lit(OMOCODE_PLACES.index(i + 1) + 1 if i + 1 in OMOCODE_PLACES else 99) for i in range(15)])
        body = F.array_join(F.transform(chars(body), lambda c, i: F.when(F.get(rank, i) <= omocode, F.translate(c, "0123456789", OMOCODE_LETTERS)).otherwise(c)), "")
    return F.concat(body, _check_letter(body))
