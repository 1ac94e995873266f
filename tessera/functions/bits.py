"""Byte and number utilities as Column expressions; all of them stay inside generated code and never overflow under ANSI mode."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The multipliers of the 32- and 64-bit hashes.
INT_MULTIPLIER, LONG_MULTIPLIER = -1640531527, -7046029254386353131

_TWO64 = Decimal(1 << 64)


def _long(x: Column | int) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def _shift(direction: str, x: Column, n: Column | int) -> Column:
    """Shifts by a column of places as well as by a number."""
    return F.call_function(direction, x, (n if isinstance(n, Column) else F.lit(n)).cast("int"))


def wrap32(x: Column) -> Column:
    """A BIGINT's low 32 bits as a signed INT."""
    low = x.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


def wrap64(x: Column) -> Column:
    """A DECIMAL integer modulo 2**64 as a signed BIGINT."""
    low = F.pmod(x.cast("decimal(38,0)"), F.lit(_TWO64).cast("decimal(38,0)"))
    return F.when(low >= Decimal(1 << 63), low - _TWO64).otherwise(low).cast("long")


def add32(a: Column, b: Column | int) -> Column:
    return wrap32(_long(a) + _long(b))


def mul32(a: Column, b: Column | int) -> Column:
    return wrap32(_long(a) * _long(b))


def add64(a: Column, b: Column | int) -> Column:
    return wrap64(_long(a).cast("decimal(20,0)") + _long(b).cast("decimal(20,0)"))


def mul64(a: Column, b: Column | int) -> Column:
    return wrap64(_long(a).cast("decimal(19,0)") * _long(b).cast("decimal(19,0)"))


def int_hash(x: Column) -> Column:
    h = mul32(x, INT_MULTIPLIER)
    return h.bitwiseXOR(F.shiftright(h, 16))


def long_hash(x: Column) -> Column:
    h = mul64(x, LONG_MULTIPLIER)
    h = h.bitwiseXOR(F.shiftright(h, 32))
    return wrap32(h.bitwiseXOR(F.shiftright(h, 16)))


def spread_int_hash(x: Column) -> Column:
    """The supplemental shift-and-xor hash of the hash-map containers."""
    h = x.bitwiseXOR(F.shiftrightunsigned(x, 20)).bitwiseXOR(F.shiftrightunsigned(x, 12))
    return h.bitwiseXOR(F.shiftrightunsigned(h, 7)).bitwiseXOR(F.shiftrightunsigned(h, 4))


def spread_long_hash(x: Column) -> Column:
    return spread_int_hash(wrap32(x.bitwiseXOR(F.shiftrightunsigned(x, 32))))


def unsigned(x: Column) -> Column:
    """An INT's bits as a non-negative BIGINT."""
    return _long(x).bitwiseAND(F.lit(0xFFFFFFFF))


def next_pow2(x: Column) -> Column:
    """The least power of two that is at least x, for 1 <= x <= 2**62."""
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(_shift("shiftleft", F.lit(1).cast("long"), F.length(F.bin(x - 1))))


def floor_log2(x: Column) -> Column:
    """The place of the highest one bit of x > 0."""
    return F.length(F.bin(x)) - 1


def round_up(x: Column, to: int) -> Column:
    return round_down(x + (to - 1), to)


def round_down(x: Column, to: int) -> Column:
    """To a multiple nearer to zero, as a remainder takes its sign from x."""
    return x - x % to


def fill_low_bits(n: Column) -> Column:
    """n ones, for 0 <= n <= 64."""
    return F.when(n >= 64, F.lit(-1).cast("long")).when(n == 63, F.lit((1 << 63) - 1)).otherwise(_shift("shiftleft", F.lit(1).cast("long"), n) - 1)


#: Bits that each parity scheme keeps at the low end.
PARITY_BITS = {1: 1, 3: 3, 4: 4, 16: 16}


def _check_bits(x: Column, scheme: int) -> Column:
    if scheme == 16:
        return _long(long_hash(add64(x, 1))).bitwiseAND(F.lit(0xFFFF))
    return _long((F.bit_count(x) + 1) % (1 << PARITY_BITS[scheme]))


def parity_set(x: Column, scheme: int) -> Column:
    """x, whose low bits are 0, with its check bits put there."""
    return x.bitwiseOR(_check_bits(x, scheme))


def parity_ok(x: Column, scheme: int) -> Column:
    mask = (1 << PARITY_BITS[scheme]) - 1
    if scheme == 1:
        return F.bit_count(x) % 2 == 1
    return _check_bits(x.bitwiseAND(F.lit(~mask)), scheme) == x.bitwiseAND(F.lit(mask))


def parity_get(x: Column, scheme: int) -> Column:
    """x without its check bits; NULL where they don't fit (``parity_ok`` tells that from a NULL x)."""
    return F.when(parity_ok(x, scheme), x.bitwiseAND(F.lit(~((1 << PARITY_BITS[scheme]) - 1))))


def pack_recid(x: Column) -> Column:
    return parity_set(F.shiftleft(x, 1), 1)


def unpack_recid(x: Column) -> Column:
    return F.shiftrightunsigned(parity_get(x, 1), 1)


def packed_size(x: Column) -> Column:
    """Bytes of a non-negative number in groups of seven bits."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(x)) / 7)).cast("int")


def pack(x: Column) -> Column:
    """A non-negative number as hex bytes: seven bits each, the highest first, the last one marked by 0x80."""
    groups = F.sequence(packed_size(x) - 1, F.lit(0))
    byte = lambda i: _shift("shiftrightunsigned", x, i * 7).bitwiseAND(F.lit(0x7F)) + F.when(i == 0, 128).otherwise(0)
    return F.array_join(F.transform(groups, lambda i: F.lpad(F.hex(byte(i)), 2, "0")), "")


def unpack(text: Column) -> Column:
    """The number that ``pack`` wrote."""
    places = F.sequence(F.lit(0), (F.length(text) / 2).cast("int") - 1)
    value = lambda i: F.conv(F.substring(text, i * 2 + 1, F.lit(2)), 16, 10).cast("long").bitwiseAND(F.lit(0x7F))
    return F.aggregate(F.transform(places, value), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 7).bitwiseOR(b))


def to_hex(data: Column) -> Column:
    return F.hex(data)


def from_hex(text: Column) -> Column:
    return F.unhex(text)


def six_bytes(x: Column) -> Column:
    """The low 48 bits as 12 hex digits, the highest first."""
    return F.lpad(F.hex(x.bitwiseAND(F.lit((1 << 48) - 1))), 12, "0")


def from_six_bytes(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("long")


def big_endian(x: Column, size: int) -> Column:
    """An integer's two's-complement bytes as hex digits."""
    return F.right(F.lpad(F.hex(_long(x)), 16, "0"), F.lit(2 * size))


def from_big_endian(digits: Column, size: int, signed: bool = True) -> Column:
    """The integer of ``size`` bytes given as hex digits: two's complement, or unsigned as six-byte numbers are stored."""
    plain = F.conv(digits, 16, 10).cast("decimal(20,0)")
    top = Decimal(1 << (8 * size))
    return plain.cast("long") if not signed else F.when(plain >= top / 2, plain - F.lit(top)).otherwise(plain).cast("long")


#: Fixed values of the index slot: where its type, size and page begin.
SLOT_TYPE_SHIFT, SLOT_SIZE_SHIFT = 56, 40


def slot(kind: Column, size: Column, page: Column) -> Column:
    return F.shiftleft(_long(kind), SLOT_TYPE_SHIFT).bitwiseOR(F.shiftleft(_long(size), SLOT_SIZE_SHIFT)).bitwiseOR(_long(page))


def slot_parts(x: Column) -> tuple[Column, Column, Column]:
    return F.shiftrightunsigned(x, SLOT_TYPE_SHIFT).cast("int"), F.shiftrightunsigned(x, SLOT_SIZE_SHIFT).bitwiseAND(F.lit(0xFFFF)).cast("int"), x.bitwiseAND(F.lit((1 << SLOT_SIZE_SHIFT) - 1))


def size_class(n: Column) -> Column:
    """Record sizes are counted in classes of 16 bytes."""
    return round_up(_long(n), 16)


#: Fixed values of linked records: the most bytes of one chunk, and the bytes of a pointer to the next.
MAX_CHUNK, POINTER = 65535, 8


def linked_chunks(n: Column) -> Column:
    """Chunks that a record of n bytes is linked from: up to ``MAX_CHUNK`` bytes one, else each but the last holds a pointer."""
    return (1 + F.when(n > MAX_CHUNK, F.floor((n - 1) / (MAX_CHUNK - POINTER))).otherwise(0)).cast("long")


def header_checksum(value: Column, offset: Column) -> Column:
    """Aggregate: all slots' values and hashes of (value | offset), or-ed together."""
    return F.bit_or(value.bitwiseOR(_long(spread_long_hash(value.bitwiseOR(offset)))))
