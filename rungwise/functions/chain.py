"""Hex ids, quantities, evidence digests and resolution payloads as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Id and digest shapes.
HEX32 = r"^0x[0-9a-f]{64}\z"
SHA256 = r"^[0-9a-f]{64}\z"
QUANTITY = r"^0x(0|[1-9a-fA-F][0-9a-fA-F]*)\z"
WORD = 64  # hex digits of one 32-byte word
SAFE_DIGITS = 15  # hex digits that always fit a BIGINT
LIMB = 1_000_000_000
LIMBS = 9  # nine decimal digits each, enough for 256 bits
CHUNK = 7  # hex digits taken at a time: LIMB * 16^7 fits a BIGINT


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def hex_bytes(value: Column | str, length: int) -> Column:
    """Lower-cased 0x hex of exactly ``length`` bytes, or null."""
    value = _col(value)
    shape = rf"^0x[0-9a-fA-F]{{{2 * length}}}\z"
    return F.when(value.rlike(shape), F.lower(value))


def decimal_text(digits: Column) -> Column:
    """Decimal digits of up to 64 hex digits, exactly and at any width."""
    padded = F.lpad(digits, 10 * CHUNK, "0")
    chunks = F.transform(
        F.sequence(F.lit(0), F.lit(9)),
        lambda i: F.conv(F.substring(padded, i * CHUNK + 1, F.lit(CHUNK)), 16, 10).cast("bigint"),
    )

    def shifted(limbs: Column, chunk: Column) -> Column:
        start = F.struct(chunk.alias("carry"), F.array().cast("array<bigint>").alias("out"))

        def step(state: Column, limb: Column) -> Column:
            total = limb * 16**CHUNK + state["carry"]
            carry = F.call_function("div", total, F.lit(LIMB).cast("bigint"))
            return F.struct(carry.alias("carry"), F.concat(state["out"], F.array(total % LIMB)).alias("out"))

        return F.aggregate(limbs, start, step)["out"]

    zero = F.array_repeat(F.lit(0).cast("bigint"), LIMBS)
    limbs = F.aggregate(chunks, zero, shifted)
    text = F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), 9, "0")), "")
    return F.regexp_replace(text, r"^0+(?=\d)", "")


def quantity_text(value: Column | str) -> Column:
    """0x quantity without leading zeros, of up to 64 digits, as decimal text; null if malformed."""
    value = _col(value)
    digits = F.substring(value, F.lit(3), F.length(value))
    small = F.conv(digits, 16, 10)
    text = F.when(F.length(digits) <= SAFE_DIGITS, small).otherwise(decimal_text(digits))
    return F.when(value.rlike(QUANTITY) & (F.length(digits) <= WORD), text)


def quantity(value: Column | str) -> Column:
    """0x quantity without leading zeros to BIGINT; null if malformed or beyond 63 bits.

    ``quantity_text`` has the values beyond.
    """
    return quantity_text(value).try_cast("bigint")


def is_digest(value: Column | str) -> Column:
    return F.coalesce(_col(value).rlike(SHA256), F.lit(False))


def is_hex32(value: Column | str) -> Column:
    return F.coalesce(_col(value).rlike(HEX32), F.lit(False))


def evidence_digest(domain: str, *digests: Column | str) -> Column:
    """SHA-256 over a domain text and the bytes of the digests, in order."""
    parts = [F.unhex(_col(d)) for d in digests]
    return F.sha2(F.concat(F.lit(domain).cast("binary"), *parts), 256)


def _word(digits: Column, index: Column) -> Column:
    return F.substring(digits, (index * WORD + 1).cast("int"), F.lit(WORD))


def _word_number(word: Column) -> Column:
    """Value of a word that counts or points to something, or null beyond 60 bits."""
    zeros = WORD - SAFE_DIGITS
    small = F.substring(word, 1, zeros) == "0" * zeros
    return F.when(small, F.conv(F.substring(word, zeros + 1, WORD), 16, 10).cast("bigint"))


def _word_text(word: Column) -> Column:
    """Value of a word of any width as decimal text."""
    return F.coalesce(_word_number(word).cast("string"), decimal_text(word))


def resolution_payload(data: Column | str) -> Column:
    """``struct<slot_count, payouts>`` of ``(uint, uint[])`` data; null when not canonical.

    Payouts are decimal text, as a word may hold 256 bits.

    The array must start at offset 64, have ``slot_count`` entries and end the data.
    """
    data = _col(data)
    digits = F.lower(F.substring(data, F.lit(3), F.length(data)))
    words = F.length(digits) / WORD
    clean = data.rlike(r"^0x[0-9a-fA-F]*\z") & (F.length(digits) % WORD == 0)

    def number(index: int) -> Column:
        return _word_number(_word(digits, F.lit(index)))

    slots = number(0)
    canonical = (
        clean
        & (words >= 3)
        & slots.between(1, 256)
        & (number(1) == 64)
        & (number(2) == slots)
        & (words == slots + 3)
    )
    # The bounds keep the sequence legal for rows that are rejected anyway.
    last = F.least(F.greatest(F.coalesce(slots, F.lit(1)), F.lit(1)), F.lit(256)) + 2
    payouts = F.transform(
        F.sequence(F.lit(3).cast("bigint"), last.cast("bigint")),
        lambda i: _word_text(_word(digits, i)),
    )
    return F.when(
        F.coalesce(canonical, F.lit(False)),
        F.struct(slots.alias("slot_count"), payouts.alias("payouts")),
    )
