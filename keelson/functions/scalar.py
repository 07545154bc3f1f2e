"""Scalar functions as column expressions; all stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Syllables of generated last names, by digit: fixed values of the order-processing workload.
SYLLABLES = ("BAR", "OUGHT", "ABLE", "PRI", "PRES", "ESE", "ANTI", "CALLY", "ATION", "EING")
PAGE = 4096


def last_name(number: Column) -> Column:
    """Three syllables by the hundreds, tens and ones of a number."""
    table = F.array(*[F.lit(s) for s in SYLLABLES])
    digit = lambda d: F.get(table, F.pmod(F.floor(number / d), F.lit(10)).cast("int"))
    return F.concat(digit(100), digit(10), digit(1))


def nth_column(place: Column, columns: list[Column]) -> Column:
    """The columns' value at a place from 1 on; fails outside it."""
    inside = place.between(1, len(columns))
    return F.when(inside, F.element_at(F.array(*columns), place)).otherwise(F.raise_error(F.lit("no such column")).cast("string"))


def line_amount(quantity: Column, price: Column, *, taxes: list[Column], discount: Column) -> Column:
    """quantity * price * (1 + all taxes) * (1 - discount)."""
    return quantity * price * reduce(lambda a, b: a + b, taxes, F.lit(1)) * (1 - discount)


def brand_flag(*data: Column, mark: str = "ORIGINAL") -> Column:
    """B where every value ends with the mark, else G."""
    return F.when(reduce(lambda a, b: a & b, [F.endswith(d, F.lit(mark)) for d in data]), "B").otherwise("G")


def replenish(stock: Column, ordered: Column) -> Column:
    """What is left after an order: refilled by 91 where fewer than ten would stay (fixed values)."""
    return F.when(stock >= ordered + 10, stock - ordered).otherwise(stock + 91 - ordered)


def audit_entry(c_id: Column, c_d: Column, c_w: Column, d: Column, w: Column, amount: Column, when: Column, *rest: Column) -> Column:
    """The fixed-width note on a payment, before the customer's earlier notes; 500 characters.
    Format and length are fixed values."""
    note = F.format_string("| %4d %2d %4d %2d %4d $%7.2f %d%s%s %s", c_id, c_d, c_w, d, w, amount, when, *rest)
    return F.substring(note, 1, 500)


def history_note(warehouse: Column, district: Column) -> Column:
    return F.concat(warehouse, F.lit("    "), district)


def align_up(value: Column, step: int) -> Column:
    """The least multiple of ``step`` that isn't below a whole number."""
    return (F.floor((value + (step - 1)) / step) * step).cast("long")


def align_down(value: Column, step: int) -> Column:
    return (F.floor(value / step) * step).cast("long")


def is_power_of_two(value: Column) -> Column:
    return (value > 0) & (value.bitwiseAND(value - 1) == 0)


def pack_location(offset: Column, size: Column) -> Column:
    """A location in one number: offset above 15 bits of size. Offsets have 48 bits."""
    return F.shiftleft(offset.cast("long"), 15).bitwiseOR(size.cast("long"))


def unpack_offset(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 15)


def unpack_size(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << 15) - 1))


def block_of(offset: Column, block_bytes: int) -> Column:
    return F.floor(offset / block_bytes).cast("long")


def page_in_block(offset: Column, block_bytes: int) -> Column:
    return F.floor(F.pmod(offset, F.lit(block_bytes)) / PAGE).cast("long")


def pages_of(size: Column) -> Column:
    """Pages that so many bytes fill, in whole-number arithmetic."""
    return F.floor((size + (PAGE - 1)) / PAGE).cast("long")


def fold_int(value: Column) -> Column:
    """Four bytes whose unsigned order is the order of a 32-bit integer."""
    return F.unhex(F.lpad(F.hex(value.cast("long") + F.lit(1 << 31)), 8, "0"))


def fold_long(value: Column) -> Column:
    """Eight bytes whose unsigned order is the order of a 64-bit integer."""
    return F.unhex(F.lpad(F.hex(value.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def fold_text(value: Column) -> Column:
    """A text's bytes and a closing zero byte."""
    return F.concat(value.cast("binary"), F.unhex(F.lit("00")))


def key_head(value: Column) -> Column:
    """The first four bytes of a key, filled up with zero bytes."""
    return F.rpad(F.substring(value.cast("binary"), 1, 4), 4, F.unhex(F.lit("00")))


def shared_prefix(a: Column, b: Column) -> Column:
    """How many leading characters two texts share."""
    places = F.sequence(F.lit(1), F.greatest(F.least(F.char_length(a), F.char_length(b)), F.lit(1)))
    differs = F.filter(places, lambda i: ~F.substring(a, i, F.lit(1)).eqNullSafe(F.substring(b, i, F.lit(1))))
    least = F.least(F.char_length(a), F.char_length(b))
    return F.when(F.size(differs) == 0, least).otherwise(F.array_min(differs) - 1)


def write_amplification(in_place: Column, doublewrite: Column, valid_share: Column, compression: Column) -> Column:
    """Database-level write amplification: 1 or 2 in place, else 1 / (1 - valid) * ratio."""
    moved = F.lit(1.0) / F.nullif(1 - valid_share, F.lit(0.0)) * compression
    return F.when(in_place, F.when(doublewrite, 2.0).otherwise(1.0)).otherwise(moved)


def ratio(part: Column, rest: Column) -> Column:
    """part / (part + rest), NULL where both are 0."""
    return part / F.nullif(part + rest, F.lit(0))


def device_path(text: Column) -> Column:
    return F.regexp_extract(text, r"/dev/nvme\d+", 0)


def nu_rand(a: Column, b: Column, low: int, high: int, constant: int) -> Column:
    """A non-uniform draw on [low, high] from two uniform ones."""
    return F.pmod(a.bitwiseOR(b) + constant, F.lit(high - low + 1)) + low


def scalar_json(text: Column, field: str) -> Column:
    return F.get_json_object(text, f"$.{field}")


def separator(left: Column, right: Column) -> Column:
    """The shortest text that sorts after ``left`` and not after ``right``, for left < right."""
    return F.substring(right, F.lit(1), (shared_prefix(left, right) + 1).cast("int"))
