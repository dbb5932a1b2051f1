"""Bit fields of 8-byte payloads as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canlake.schema import EXTENDED_BITS, STANDARD_BITS


def _long(h: Column, at: int) -> Column:
    return F.conv(F.substring(h, at, 8), 16, 10).cast("bigint")


def be64(data: Column) -> Column:
    """The payload as one 64-bit number, first byte highest; missing bytes are zero."""
    h = F.rpad(F.hex(data), 16, "0")
    return F.call_function("shiftleft", _long(h, 1), F.lit(32)).bitwiseOR(_long(h, 9))


def le64(data: Column) -> Column:
    """The payload as one 64-bit number, first byte lowest; missing bytes are zero."""
    h = F.rpad(F.hex(data), 16, "0")
    r = F.concat(*(F.substring(h, 15 - 2 * i, 2) for i in range(8)))
    return F.call_function("shiftleft", _long(r, 1), F.lit(32)).bitwiseOR(_long(r, 9))


def with_words(frames: DataFrame) -> DataFrame:
    """frames with be64 and le64, computed once per frame and not once per signal."""
    return frames.withColumn("be64", be64(F.col("data"))).withColumn("le64", le64(F.col("data")))


def _mask(size: str) -> str:
    return f"(CASE WHEN {size} BETWEEN 1 AND 64 THEN shiftrightunsigned(-1L, 64 - {size}) ELSE 0L END)"


def _place(start: str) -> str:
    """Bits before a big-endian field, counted from the payload's highest bit."""
    return f"(({start} div 8) * 8 + (7 - {start} % 8))"


def extract_raw(start: str = "start_bit", size: str = "size", big_endian: str = "big_endian", be: str = "be64", le: str = "le64") -> Column:
    """The field's bits as an unsigned pattern in a long. Bits outside the payload are 0; sizes other than 1 to 64 give 0."""
    m, p = _mask(size), f"cast({_place(start)} as int)"
    little = f"CASE WHEN {start} >= 64 THEN 0L ELSE shiftrightunsigned({le}, cast({start} as int)) & {m} END"
    big = (
        f"CASE WHEN {p} >= 64 THEN 0L WHEN {p} + {size} <= 64 THEN shiftrightunsigned({be}, 64 - {p} - {size}) & {m} "
        f"WHEN {p} + {size} >= 128 THEN 0L ELSE shiftleft({be}, {p} + {size} - 64) & {m} END"
    )
    return F.expr(f"CASE WHEN {size} NOT BETWEEN 1 AND 64 THEN 0L WHEN {big_endian} THEN {big} ELSE {little} END")


def to_physical(raw: str = "raw", size: str = "size", signed: str = "signed", factor: str = "factor", offset: str = "offset") -> Column:
    """raw * factor + offset; signed fields of 1 to 64 bits are sign extended, unsigned 64-bit patterns above 2^63 count as positive."""
    extended = f"shiftright(shiftleft({raw}, 64 - {size}), 64 - {size})"
    unsigned = f"cast({raw} as double) + CASE WHEN {raw} < 0 THEN 18446744073709551616D ELSE 0D END"
    return F.expr(f"(CASE WHEN {signed} AND {size} BETWEEN 1 AND 64 THEN cast({extended} as double) ELSE {unsigned} END) * {factor} + {offset}")


def _quotient(phys: str, factor: str, offset: str) -> str:
    """(phys - offset) / factor; 0 where that is no number, infinite where only the factor is 0."""
    d = f"({phys} - {offset})"
    return f"nanvl(CASE WHEN {factor} <> 0 THEN {d} / nullif({factor}, 0D) WHEN {d} = 0 THEN 0D ELSE {d} * double('Infinity') END, 0D)"


def _raw(q: str, size: str, signed: str) -> str:
    near = f"rint({q})"
    rounded = f"(CASE WHEN abs({q} - {near}) = 0.5D THEN {q} + signum({q}) * 0.5D ELSE {near} END)"
    v = f"(CASE WHEN {q} >= 9223372036854775807D THEN 9223372036854775807L WHEN {q} <= -9223372036854775808D THEN -9223372036854775807L - 1L ELSE cast({rounded} as bigint) END)"
    half = f"shiftleft(1L, {size} - 1)"
    clamped = f"CASE WHEN {signed} THEN greatest(-{half}, least({half} - 1L, {v})) ELSE greatest(0L, least({_mask(size)}, {v})) END"
    return f"CASE WHEN {size} BETWEEN 1 AND 63 THEN ({clamped}) & {_mask(size)} ELSE {v} END"


def from_physical(phys: str = "phys", size: str = "size", signed: str = "signed", factor: str = "factor", offset: str = "offset") -> Column:
    """round((phys - offset) / factor), half away from zero, clamped to the field's range where it has 1 to 63 bits and
    masked to them; saturating at 64 bits otherwise. NaN gives 0. with_raw() computes the same step by step."""
    return F.expr(_raw(f"({_quotient(phys, factor, offset)})", size, signed))


def with_raw(rows: DataFrame) -> DataFrame:
    """rows(phys and the signal's columns) with raw: step by step, so that each step is computed once."""
    return rows.withColumn("q", F.expr(_quotient("phys", "factor", "offset"))).withColumn("raw", F.expr(_raw("q", "size", "signed"))).drop("q")


def _swapped(x: str) -> str:
    """The 8 bytes of x in the other order."""
    moved = [f"shiftleft({x} & {0xFF << 8 * i}L, {56 - 16 * i})" for i in range(4)]
    moved += [f"(shiftrightunsigned({x}, {16 * i - 56}) & {0xFF << (56 - 8 * i)}L)" for i in range(4, 8)]
    return "(" + " | ".join(moved) + ")"


def _placed(x: str, start: str = "start_bit", size: str = "size", big_endian: str = "big_endian") -> str:
    """The field's bits x at their place in the payload's 64-bit number, first byte highest for big-endian fields, first
    byte lowest for others. Bits past the payload are dropped; sizes other than 1 to 64 give 0."""
    p = f"cast({_place(start)} as int)"
    little = f"CASE WHEN {start} >= 64 THEN 0L ELSE shiftleft({x}, cast({start} as int)) END"
    big = (
        f"CASE WHEN {p} >= 64 THEN 0L WHEN {p} + {size} <= 64 THEN shiftleft({x}, 64 - {p} - {size}) "
        f"WHEN {p} + {size} >= 128 THEN 0L ELSE shiftrightunsigned({x}, {p} + {size} - 64) END"
    )
    return f"(CASE WHEN {size} NOT BETWEEN 1 AND 64 THEN 0L WHEN {big_endian} THEN {big} ELSE {little} END)"


def field_bits(raw: str = "raw", start: str = "start_bit", size: str = "size", big_endian: str = "big_endian") -> tuple[Column, Column]:
    """(mask, bits) of the field in the payload's 64-bit number, first byte highest. Bits past the payload are dropped.
    with_masks() and with_bits() compute the same step by step."""

    def ordered(x: str) -> Column:
        x = _placed(x, start, size, big_endian)
        return F.expr(f"CASE WHEN {big_endian} THEN {x} ELSE {_swapped(x)} END")

    return ordered(_mask(size)), ordered(f"({raw} & {_mask(size)})")


def with_masks(signals: DataFrame) -> DataFrame:
    """signals with mask: the field's bits in the payload's 64-bit number, first byte highest. It depends on the catalogue only."""
    return signals.withColumn("_m", F.expr(_placed(_mask("size")))).withColumn("mask", F.expr(f"CASE WHEN big_endian THEN _m ELSE {_swapped('_m')} END")).drop("_m")


def with_bits(rows: DataFrame) -> DataFrame:
    """rows(raw and the signal's columns) with bits: the raw value at the field's place, first byte highest."""
    return rows.withColumn("_x", F.expr(_placed(f"(raw & {_mask('size')})"))).withColumn("bits", F.expr(f"CASE WHEN big_endian THEN _x ELSE {_swapped('_x')} END")).drop("_x")


def word_to_data(word: Column) -> Column:
    return F.unhex(F.lpad(F.hex(word), 16, "0"))


def render_id(id_: Column, extended: Column) -> Column:
    """Eight hex digits and an x for extended ids, at least three for standard ones."""
    h = F.hex(id_)
    return F.when(extended, F.concat(F.lpad(h, 8, "0"), F.lit("x"))).otherwise(F.when(F.length(h) < 3, F.lpad(h, 3, "0")).otherwise(h))


def render_data(data: Column, dlc: Column) -> Column:
    """The first dlc (8 at most) bytes as two hex digits each, with spaces between."""
    h = F.hex(F.substring(data, F.lit(1), F.least(dlc, F.lit(8))))
    return F.regexp_replace(h, "(..)(?!$)", "$1 ")


def parse_hex_bytes(text: Column) -> Column:
    """1 to 8 hex bytes between white space as an 8-byte payload; NULL where one is no byte or their number is wrong."""
    parts = F.split(F.trim(text), r"\s+")
    good = F.size(parts).between(1, 8) & F.forall(parts, lambda p: p.rlike("^[0-9A-Fa-f]{1,2}$"))
    return F.when(good, F.unhex(F.rpad(F.array_join(F.transform(parts, lambda p: F.lpad(p, 2, "0")), ""), 16, "0")))


def frame_bits(extended: Column, dlc: Column) -> Column:
    return F.when(extended, EXTENDED_BITS).otherwise(STANDARD_BITS) + dlc * 8


def format_value(v: Column) -> Column:
    """Fewer decimals for larger magnitudes: none from 1,000, one from 10, else two, rounded half up as the
    shortest decimal form reads; NULL stays."""
    a = F.abs(v)
    return F.when(a >= 1000, F.format_string("%.0f", v)).when(a >= 10, F.format_string("%.1f", v)).when(v.isNotNull(), F.format_string("%.2f", v))


def gauge(latest: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, F.greatest(F.least((latest - low) / (high - low), F.lit(1.0)), F.lit(0.0))).otherwise(0.0)


def value_range(low: str = "min", high: str = "max", size: str = "size", signed: str = "signed", factor: str = "factor", offset: str = "offset") -> tuple[Column, Column]:
    """The signal's declared range where it has one, else what its bits (48 at most) can hold."""
    bits = f"least({size}, 48)"
    half = f"pow(2D, {bits} - 1)"
    a = f"((CASE WHEN {signed} THEN -{half} ELSE 0D END) * {factor} + {offset})"
    b = f"((CASE WHEN {signed} THEN {half} ELSE pow(2D, {bits}) END - 1D) * {factor} + {offset})"
    own = f"({low} < {high} AND abs({low}) < double('Infinity') AND abs({high}) < double('Infinity'))"
    return F.expr(f"CASE WHEN {own} THEN {low} ELSE {a} END"), F.expr(f"CASE WHEN {own} THEN {high} ELSE {b} END")
