"""Check digits and range checks on matched text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions.text import let

BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"


def _chars(col: Column) -> Column:
    return F.filter(F.split(col, ""), lambda c: c != "")


def luhn_ok(col: Column) -> Column:
    """Luhn check over the digits of a card number, separators ignored."""
    digits = F.transform(_chars(F.reverse(F.regexp_replace(col, "[^0-9]", ""))), lambda c: c.cast("int"))
    weighted = F.transform(
        digits,
        lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2),
    )
    return F.aggregate(weighted, F.lit(0), lambda a, d: a + d) % 10 == 0


def ipv4_ok(col: Column) -> Column:
    return F.forall(F.split(col, r"\."), lambda part: part.cast("int") <= 255)


_HEX = "[0-9A-Fa-f]{1,4}"
#: An address with one `::`, perhaps with an IPv4 address at its end.
IPV6_FORM = f"^(?:{_HEX}(?::{_HEX})*)?::(?:(?:{_HEX}:)*(?:{_HEX}|[0-9]{{1,3}}(?:[.][0-9]{{1,3}}){{3}}))?$"


def short_ipv6_ok(col: Column) -> Column:
    """`::` stands for at least one group of eight; the address names at least one. An IPv4 end counts as two."""
    groups = F.filter(F.split(col, ":"), lambda g: g != "")
    dotted = F.contains(col, F.lit("."))
    named = F.size(groups) + F.when(dotted, 1).otherwise(0)
    tail = F.coalesce(F.element_at(groups, -1), F.lit(""))
    return col.rlike(IPV6_FORM) & named.between(1, 7) & (~dotted | ipv4_ok(tail))


# Public telephone numbering plans. Country codes have one digit in zones 1 and 7, two digits where listed
# here, else three.
TWO_DIGIT_CODES = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 "
    "90 91 92 93 94 95 98"
).split()
# Fewest and most digits behind the country code; any other code takes four and more, fifteen in all at most.
NATIONAL_DIGITS = {
    "1": (10, 10), "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9),
    "34": (9, 9), "36": (8, 9), "39": (6, 11), "40": (9, 9), "41": (9, 9), "43": (4, 13), "44": (7, 10), "45": (8, 8),
    "46": (7, 10), "47": (8, 8), "48": (9, 9), "49": (5, 11), "51": (8, 9), "52": (10, 10), "54": (10, 11), "55": (10, 11),
    "56": (9, 9), "57": (8, 10), "58": (10, 10), "60": (8, 10), "61": (9, 9), "62": (7, 12), "63": (8, 10), "64": (8, 10),
    "65": (8, 8), "66": (8, 9), "81": (9, 10), "82": (8, 11), "84": (9, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10),
    "92": (9, 10), "93": (9, 9), "94": (9, 9), "95": (7, 10), "98": (10, 10), "212": (9, 9), "213": (8, 9), "216": (8, 8),
    "233": (9, 9), "234": (8, 10), "254": (9, 10), "351": (9, 9), "352": (4, 11), "353": (7, 9), "354": (7, 9),
    "358": (5, 12), "359": (7, 9), "370": (8, 8), "371": (8, 8), "372": (7, 8), "380": (9, 9), "385": (8, 9), "386": (8, 8),
    "420": (9, 9), "421": (9, 9), "852": (8, 8), "886": (8, 9), "966": (9, 9), "971": (8, 9), "972": (8, 9),
}


def international_phone_ok(col: Column) -> Column:
    """A number of a known plan: the country code by its zone, then as many digits as the plan has. `(0)` is not dialled."""

    def by_plan(digits: Column) -> Column:
        size = F.when(F.left(digits, F.lit(1)).isin("1", "7"), 1).when(F.left(digits, F.lit(2)).isin(*TWO_DIGIT_CODES), 2).otherwise(3)
        limits = F.create_map(*[x for code, (low, high) in NATIONAL_DIGITS.items() for x in (F.lit(code), F.array(F.lit(low), F.lit(high)))])
        total = F.char_length(digits)
        known = F.coalesce(F.try_element_at(limits, F.left(digits, size)), F.array(F.lit(4), 15 - size))
        return total.between(8, 15) & (total - size).between(known[0], known[1])

    return let(F.regexp_replace(F.replace(col, F.lit("(0)"), F.lit("")), "[^0-9]", ""), by_plan)


def ssn_ok(col: Column) -> Column:
    """Areas 000, 666 and 9xx, group 00 and serial 0000 are never issued."""
    return ~col.rlike("^(?:000|666|9[0-9]{2})|-00-|-0000$")


def iban_ok(col: Column) -> Column:
    """ISO 7064 mod 97-10 over the rearranged number."""
    compact = F.regexp_replace(col, "[^A-Z0-9]", "")
    turned = F.concat(F.substring(compact, 5, 34), F.left(compact, F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(_chars(turned), F.lit(0), step) == 1


def _base58_bytes(col: Column) -> Column:
    """The 25 bytes of a base-58 number as an array of ints, highest first."""

    def add_digit(limbs: Column, c: Column) -> Column:
        digit = F.instr(F.lit(BASE58), c) - 1
        # multiply by 58 from the low end, carrying upwards
        start = F.struct(F.array().cast("array<int>").alias("out"), digit.cast("int").alias("carry"))

        def mul(acc: Column, limb: Column) -> Column:
            total = limb * 58 + acc["carry"]
            return F.struct(
                F.concat(F.array((total % 256).cast("int")), acc["out"]).alias("out"),
                F.floor(total / 256).cast("int").alias("carry"),
            )

        return F.aggregate(F.reverse(limbs), start, mul, lambda acc: acc["out"])

    zeros = F.array_repeat(F.lit(0), 25)
    return F.aggregate(_chars(col), zeros, add_digit)


def _base58check_ok(col: Column) -> Column:
    raw = F.array_join(F.transform(_base58_bytes(col), lambda b: F.lpad(F.hex(b), 2, "0")), "")

    def verify(h: Column) -> Column:
        body = F.unhex(F.substring(h, 1, 42))
        digest = F.sha2(F.unhex(F.sha2(body, 256)), 256)
        return F.upper(F.left(digest, F.lit(8))) == F.substring(h, 43, 8)

    return let(raw, verify)


def _bech32_ok(col: Column) -> Column:
    """Checksum of `bc1…` addresses, both constants of the public specification accepted."""
    prefix = F.array(*[F.lit(v).cast("bigint") for v in (3, 3, 0, 2, 3)])
    data = F.transform(
        _chars(F.substring(F.lower(col), 4, 90)),
        lambda c: (F.instr(F.lit(BECH32), c) - 1).cast("bigint"),
    )

    def step(chk: Column, value: Column) -> Column:
        top = F.shiftright(chk, 25)
        out = F.shiftleft(chk.bitwiseAND(F.lit(0x1FFFFFF)), 5).bitwiseXOR(value)
        for i, gen in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            bit = F.shiftright(top, i).bitwiseAND(F.lit(1).cast("bigint"))
            out = out.bitwiseXOR(bit * F.lit(gen).cast("bigint"))
        return out

    folded = F.aggregate(F.concat(prefix, data), F.lit(1).cast("bigint"), step)
    return folded.isin(1, 0x2BC830A3)


def crypto_ok(col: Column) -> Column:
    return F.when(col.startswith("bc1"), _bech32_ok(col)).otherwise(_base58check_ok(col))
