"""Lists and packed sorted groups as expressions over ARRAY columns. Positions are 0-based unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.bits import INT_MULTIPLIER, add32, int_hash, long_hash, mul32, wrap32


def _lit(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _checked(ok: Column, value: Column, what: str) -> Column:
    """``value``, or an error where ``ok`` is false; a null list or position gives what the expression gives."""
    return F.when(F.coalesce(~ok, F.lit(False)), F.raise_error(F.lit(f"position out of bounds: {what}"))).otherwise(value)


def in_bounds(a: Column, i: Column | int) -> Column:
    """Whether the list has an element at i."""
    return (_lit(i) >= 0) & (_lit(i) < F.size(a))


def _between(a: Column, start: Column | int, end: Column | int) -> Column:
    return (_lit(start) >= 0) & (_lit(start) <= _lit(end)) & (_lit(end) <= F.size(a))


def get(a: Column, i: Column | int) -> Column:
    """The element at i; an error outside the list."""
    return _checked(in_bounds(a, i), F.get(a, _lit(i)), "get")


def insert(a: Column, i: Column | int, x: Column) -> Column:
    """x put before position i; an error unless 0 <= i <= size."""
    return insert_all(a, i, F.array(x))


def insert_all(a: Column, i: Column | int, b: Column) -> Column:
    """All elements of b put before position i; an error unless 0 <= i <= size."""
    return _checked(_between(a, 0, i), F.concat(F.slice(a, 1, _lit(i)), b, F.slice(a, _lit(i) + 1, F.size(a))), "insert")


def replace(a: Column, i: Column | int, x: Column) -> Column:
    """The list with x at i; an error outside the list."""
    return _checked(in_bounds(a, i), F.transform(a, lambda y, j: F.when(j == _lit(i), x).otherwise(y)), "set")


def replaced(a: Column, i: Column | int, x: Column) -> Column:
    """``list, old``: the list with x at i, and what was there; an error outside the list."""
    return F.struct(replace(a, i, x).alias("list"), get(a, i).alias("old"))


def remove(a: Column, i: Column | int) -> Column:
    """The list without the element at i; an error outside the list."""
    return _checked(in_bounds(a, i), F.concat(F.slice(a, 1, _lit(i)), F.slice(a, _lit(i) + 2, F.size(a))), "remove")


def removed(a: Column, i: Column | int) -> Column:
    """``list, old``: the list without the element at i, and that element; an error outside the list."""
    return F.struct(remove(a, i).alias("list"), get(a, i).alias("old"))


def remove_range(a: Column, start: Column | int, end: Column | int) -> Column:
    """Without [start, end); an error unless 0 <= start <= end <= size."""
    return _checked(_between(a, start, end), F.concat(F.slice(a, 1, _lit(start)), F.slice(a, _lit(end) + 1, F.size(a))), "remove range")


def clear(a: Column) -> Column:
    return F.slice(a, 1, 0)


def is_empty(a: Column) -> Column:
    return F.size(a) == 0


def sub_list(a: Column, start: Column | int, end: Column | int) -> Column:
    """[start, end); an error unless 0 <= start <= end <= size."""
    return _checked(_between(a, start, end), F.slice(a, _lit(start) + 1, _lit(end) - _lit(start)), "sub-list")


def entries(lists: DataFrame, key: str, a: str) -> DataFrame:
    """``key, pos, value``: one row for each element of the list column ``a``, as lists of entries are kept."""
    return lists.select(key, F.posexplode(a).alias("pos", "value"))


def from_entries(rows: DataFrame, key: str) -> DataFrame:
    """``key, a``: the lists of ``entries``, by ``pos``; a list without entries has no row."""
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda e: e["value"]).alias("a"))


def index_of(a: Column, x: Column) -> Column:
    """The first position of x, or -1."""
    return (F.coalesce(F.array_position(a, x), F.lit(0)) - 1).cast("int")


def last_index_of(a: Column, x: Column) -> Column:
    at = F.coalesce(F.array_position(F.reverse(a), x), F.lit(0))
    return F.when(at == 0, -1).otherwise(F.size(a) - at).cast("int")


def list_hash(hashes: Column) -> Column:
    """31 * h + e over the elements' hashes, from 1, in 32 bits."""
    return F.aggregate(hashes, F.lit(1), lambda h, e: wrap32(h.cast("long") * 31 + e))


def search(a: Column, x: Column) -> Column:
    """Position of x in a sorted group, or -(insertion point + 1)."""
    return F.when(F.array_contains(a, x), F.array_position(a, x).cast("int") - 1).otherwise(-(F.size(F.filter(a, lambda y: y < x)) + 1))


def search_by(a: Column, x: Column, key) -> Column:  # noqa: ANN001
    """``search`` in a group that is sorted by ``key``."""
    return search(F.transform(a, key), key(x))


def delete_before(a: Column, i: Column | int) -> Column:
    """The group without the element before place i, i >= 1: groups delete by 1-based places."""
    return remove(a, _lit(i) - 1)


def delta_encode(a: Column) -> Column:
    """The first element and then the ascents of a sorted group."""
    return F.transform(a, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(a, i - 1)))


def _scan(a: Column, zero: Column, step, empty: Column, block: int = 256) -> Column:  # noqa: ANN001
    """``step(state, x)`` over the elements, as (state, result) structs: the array of results.

    Results are gathered in blocks and blocks in a list, so appending copies about ``block`` elements each, not all before.
    """
    at = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / block).cast("int") - 1, F.lit(0)))
    blocks = F.transform(at, lambda i: F.slice(a, i * block + 1, F.lit(block)))

    def one(s: Column, x: Column) -> Column:
        return F.transform(F.array(step(s["state"], x)), lambda r: F.struct(r["state"].alias("state"), F.array_append(s["out"], r["result"]).alias("out")))[0]

    def whole(s: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(s["state"].alias("state"), empty.alias("out")), one)
        return F.transform(F.array(done), lambda d: F.struct(d["state"].alias("state"), F.array_append(s["out"], d["out"]).alias("out")))[0]

    return F.aggregate(blocks, F.struct(zero.alias("state"), F.slice(F.array(empty), 1, 0).alias("out")), whole, lambda s: F.flatten(s["out"]))


def delta_decode(a: Column) -> Column:
    """Running sums, in one pass."""
    add = lambda total, x: F.struct((total + x).alias("state"), (total + x).alias("result"))
    return _scan(a, F.lit(0).cast("long"), add, F.array().cast("array<bigint>"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings."""
    places = F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)))
    differ = F.filter(places, lambda i: (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))) | (F.length(a) < i) | (F.length(b) < i))
    return F.when(F.size(differ) == 0, F.least(F.length(a), F.length(b))).otherwise(F.get(differ, F.lit(0)) - 1).cast("int")


def group_common_prefix(a: Column) -> Column:
    """Length of the prefix that all strings of a group share: that of its least and greatest."""
    return common_prefix(F.array_min(a), F.array_max(a))


def prefix_encode(a: Column) -> Column:
    """A group of strings as the prefix that all of them share, once, and what follows it in each."""
    n = F.coalesce(group_common_prefix(a), F.lit(0))
    prefix = F.coalesce(F.substring(F.array_min(a), F.lit(1), n), F.lit(""))
    return F.struct(prefix.alias("prefix"), F.transform(a, lambda x: F.substring(x, n + 1, F.length(x))).alias("suffixes"))


def prefix_decode(encoded: Column) -> Column:
    """The strings of ``prefix_encode``."""
    return F.transform(encoded["suffixes"], lambda x: F.concat(encoded["prefix"], x))


def array_common_prefix(a: Column, b: Column) -> Column:
    """Number of leading elements that two arrays share; nulls equal each other."""
    n = F.least(F.size(a), F.size(b))
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    return F.when(differ == 0, n).otherwise(F.least(differ - 1, n))


def array_delta_encode(a: Column) -> Column:
    """Each array of a group as how many leading elements it shares with the one before, and the rest of its own."""

    def one(x: Column, i: Column) -> Column:
        shared = F.when(i == 0, F.lit(0)).otherwise(array_common_prefix(x, F.get(a, i - 1)))
        return F.struct(shared.alias("shared"), F.slice(x, shared + 1, F.size(x)).alias("rest"))

    return F.transform(a, one)


def array_delta_decode(encoded: Column) -> Column:
    """The arrays of ``array_delta_encode``, in one pass."""
    rests = F.transform(encoded, lambda x: x["rest"])
    none = F.slice(F.flatten(F.slice(rests, 1, 0)), 1, 0)
    grown = lambda last, x: F.concat(F.slice(last, F.lit(1), x["shared"]), x["rest"])
    step = lambda last, x: F.struct(grown(last, x).alias("state"), grown(last, x).alias("result"))
    return _scan(encoded, none, step, F.slice(rests, 1, 0))


def bytes_prefix_encode(a: Column) -> Column:
    """A group of byte strings as the prefix that all of them share, once, and what follows it in each."""
    shared = common_prefix(F.hex(F.array_min(a)), F.hex(F.array_max(a)))
    n = F.coalesce(F.floor(shared / 2), F.lit(0)).cast("int")
    prefix = F.coalesce(F.substring(F.array_min(a), F.lit(1), n), F.lit(b""))
    return F.struct(prefix.alias("prefix"), F.transform(a, lambda x: F.substring(x, n + 1, F.octet_length(x))).alias("suffixes"))


def bytes_prefix_decode(encoded: Column) -> Column:
    """The byte strings of ``bytes_prefix_encode``."""
    return F.transform(encoded["suffixes"], lambda x: F.concat(encoded["prefix"], x))


def is_unicode(s: Column) -> Column:
    """Whether a string needs more than seven bits for a character."""
    return s.rlike("[^\\x00-\\x7F]")


def fold_hash(hashes: Column, seed: Column | int = 0) -> Column:
    """seed = multiplier * seed + h over elements' hashes, in 32 bits."""
    return F.aggregate(hashes, _lit(seed).cast("int"), lambda s, h: add32(mul32(s, INT_MULTIPLIER), h))


def int_array_hash(a: Column, seed: Column | int = 0) -> Column:
    return fold_hash(F.transform(a, int_hash), seed)


def long_array_hash(a: Column, seed: Column | int = 0) -> Column:
    return fold_hash(F.transform(a, long_hash), seed)


def object_array_hash(hashes: Column, seed: Column | int = 0) -> Column:
    """Arrays of objects add their length to the seed first."""
    return fold_hash(hashes, add32(_lit(seed), F.size(hashes)))


def tuple_hash(hashes: Column, seed: Column | int = 0) -> Column:
    """seed += intHash(h) over the fields."""
    return F.aggregate(hashes, _lit(seed).cast("int"), lambda s, h: add32(s, int_hash(h)))


def string_hash(s: Column) -> Column:
    """(h + unit) * multiplier over the UTF-16 units."""
    text = F.hex(F.encode(s, "UTF-16BE"))
    units = F.sequence(F.lit(0), F.greatest((F.length(text) / 4).cast("int") - 1, F.lit(0)))
    unit = lambda i: F.conv(F.substring(text, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
    folded = F.aggregate(F.transform(units, unit), F.lit(0), lambda h, u: mul32(add32(h, u), INT_MULTIPLIER))
    return F.when(F.length(s) == 0, F.lit(0)).otherwise(folded)


def uuid_hash(msb: Column, lsb: Column) -> Column:
    """The two halves folded to 32 bits."""
    both = msb.bitwiseXOR(lsb)
    return wrap32(F.shiftright(both, 32)).bitwiseXOR(wrap32(both))


def next_value(a: Column, top: int) -> Column:
    """The least array of the same length above this one, or NULL if there is none: the exclusive end of a prefix range.

    The last element below ``top`` is raised by one; those after it, all at ``top``, restart at the lowest value.
    """
    low = 0 if top == 255 else -top - 1
    raised = F.array_max(F.transform(a, lambda x, i: F.when(x < top, i).otherwise(-1)))
    return F.when(raised >= 0, F.transform(a, lambda x, i: F.when(i == raised, x + 1).when(i > raised, F.lit(low)).otherwise(x)))
