"""MinHash near-duplicates through a multi-index Hamming join of b-bit signatures.

A text's set holds its distinct word shingles. Equal sets are collapsed first; one representative of each stands for
all its copies. A representative's signature has ``chunks * width`` symbols of ``SYMBOL_BITS`` bits. Two signatures that
differ in at most ``chunks * (errors + 1) - 1`` symbols agree, by the pigeonhole principle, in some chunk up to ``errors``
symbols. With ``errors`` = 1, each chunk is indexed once for every symbol that may be wrong, by the symbols left; such a
pair therefore meets under at least one key. Candidates are then confirmed on the full sets, which hold a 64-bit hash for
each shingle: two texts are taken to share a shingle when its hashes agree.

Buckets are never expanded into all their pairs:

1. in every bucket, each member meets only the bucket's hub (the member whose keys are the most shared, which in a group
   of edited copies is the original); confirmed links are merged to components;
2. only members of different components still have to meet, where the parity maps of their sets, which bound their overlap from
   above, don't rule a link out. Small buckets pair them. The members of larger mixed buckets are told apart by what their
   sets don't share with their hub's: the symmetric difference, in which a passage that all of them have, which makes such a
   bucket large, doesn't occur (the heaviest hub of a component stands for all of its hubs). A member that the threshold links
   to the hub itself is linked by it. Of any other two linked ones at least one is not linked to the hub, and then their
   differences have so many entries in common that they share one of the rarest entries of either (an exact prefix filter). Two of
   which neither is linked to the hub have the more in common, so fewer entries do for them. An entry's members of one component
   don't meet each other.

A content with many copies, a hub with many near copies and a shingle that many members have are dealt over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import text
from tessera.llm.components import components
from tessera.llm.scratch import materialize, release
from tessera.llm.skew import skew_join

SYMBOL_BITS = 16
#: 64-bit words of a set's parity map.
MAP_WORDS = 8
_U = np.uint64


def _coefficients(n: int) -> np.ndarray:
    """``n`` odd multipliers from a fixed rule."""
    return text.mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def signature(shingles: np.ndarray, symbols: int) -> np.ndarray:
    """The low ``SYMBOL_BITS`` bits of the mixed minimum of each permutation of a non-empty set."""
    a = _coefficients(symbols)
    least = np.full(symbols, np.iinfo(_U).max, _U)
    for i in range(0, len(shingles), 512):  # a bounded block of the symbols x shingles table
        np.minimum(least, (a[:, None] * shingles[None, i : i + 512]).min(1), out=least)
    return (text.mix(least ^ a) & _U((1 << SYMBOL_BITS) - 1)).astype(np.uint16)


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * ``MAP_WORDS`` classes of shingles: whether the set holds an odd number of them.

    The bits in which two maps differ are at most the shingles that only one of the two sets has.
    """
    odd = np.bincount((shingles % _U(64 * MAP_WORDS)).astype(np.int64), minlength=64 * MAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch], k: int, symbols: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = text.column(batch.column(1))
        size, one, two, sigs, maps = [], [], [], [], []
        for shingles in text.shingle_sets(data, at, k):
            size.append(len(shingles))
            one.append(int(np.bitwise_xor.reduce(shingles).astype(np.int64)) if len(shingles) else 0)
            two.append(int(text.mix(shingles).sum(dtype=_U).astype(np.int64)) if len(shingles) else 0)
            sig = signature(shingles, symbols) if len(shingles) else None
            sigs.append(None if sig is None else sig.tobytes())
            maps.append(parity_map(shingles))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sigs, pa.binary()), pa.array(maps, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "set_one", "set_two", "signature", "parity"],
        )


def sketch(docs: DataFrame, k: int = 5, symbols: int = 72) -> DataFrame:
    """``doc_id, n_shingles, set_one, set_two, signature, parity``: size, 128-bit content hash, signature and parity map of every text's set."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(
        lambda batches: _sketched(batches, k, symbols),
        "doc_id long, n_shingles long, set_one long, set_two long, signature binary, parity array<bigint>",
    )


def _keyed(batches: Iterator[pa.RecordBatch], chunks: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows ``key, rep`` from rows ``rep, signature``."""
    salts = _coefficients(chunks * width)
    for batch in batches:
        rep = np.asarray(batch.column(0))
        for i in range(0, len(rep), 2048):
            part = batch.slice(i, 2048)
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(len(part), chunks, width).astype(_U)
            keys = []
            for c in range(chunks):
                for wrong in range(width):
                    h = np.full(len(part), salts[c * width + wrong])
                    for s in range(width):
                        if s != wrong:
                            h = text.mix(h * _U(0xD6E8FEB86659FD93) + sig[:, c, s])
                    keys.append(h.view(np.int64))
            row = np.repeat(np.arange(len(part)), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(np.stack(keys, 1).ravel()), pa.array(rep[i : i + 2048][row])], ["key", "rep"])


def index(reps: DataFrame, chunks: int, width: int) -> DataFrame:
    """The buckets with at least two members: every row of ``reps(doc_id, signature)`` under all its keys, with ``members``."""
    keyed = reps.select("doc_id", "signature").mapInArrow(lambda b: _keyed(b, chunks, width), "key long, rep long")
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    return materialize(keyed.join(shared, "key"), "buckets")


def _near(percent: int, a: str, b: str) -> Column:
    """What two sets of a bucket must fulfil to be linked at all: sizes within the ratio, and no more differing bits of their parity
    maps than the threshold leaves shingles to either of them alone."""
    differ = F.lit(0)
    for i in range(MAP_WORDS):
        differ = differ + F.bit_count(F.get(f"{a}.parity", F.lit(i)).bitwiseXOR(F.get(f"{b}.parity", F.lit(i))))
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (small * 100 >= large * percent) & (differ * (100 + percent) <= (small + large) * (100 - percent))


def _confirmed(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs come with both texts; rows of one hub come in a row, and its set is made once."""
    hub, own = None, np.zeros(0, _U)
    for batch in batches:
        good = []
        hubs = batch.column(2)
        for i, y in enumerate(text.shingle_sets(*text.column(batch.column(3)), k)):
            if hub is None or not hubs[i].equals(hub):
                hub = hubs[i]
                (own,) = text.shingle_sets(*text.column(hubs.slice(i, 1)), k)
            common = len(np.intersect1d(own, y, assume_unique=True))
            good.append(common > 0 and 100 * common >= percent * (len(own) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of the documents in ``ids(doc_id)``. Null ids find nothing; all rows of a repeated id are found."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(materialize(ids, "ids"), "doc_id", "left_semi")


def confirm(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, k: int, percent: int, r: int, symbols: int) -> DataFrame:
    """The ``pairs(a, b)`` within r symbols whose full shingle sets have 100 * intersection >= percent * union.

    A node may stand in many pairs as a: its signature and text go to each of its shares once, and those of b come to them.
    Texts of any length are taken whole; an id with several texts is confirmed by any of them; no pairs give no result.
    """

    def hamming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, symbols) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array((x != y).sum(1) <= r))

    def kept(pairs: DataFrame, table: DataFrame, column: str, check, name: str) -> DataFrame:  # noqa: ANN001
        side = lambda name: table.select(F.col("doc_id").alias(name), F.col(column).alias(f"{column}_{name}"))
        with_b = materialize(skew_join(pairs, side("b"), ["b"]), "pairs")
        both = skew_join(with_b, side("a"), ["a"]).select("a", "b", f"{column}_a", f"{column}_b")
        found = materialize(both.mapInArrow(check, "a long, b long").distinct(), name)
        release(with_b)
        return found

    pairs = materialize(pairs, "pairs")
    close = kept(pairs, sketches, "signature", hamming, "close")
    texts = materialize(texts_of(close.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs), "texts")
    found = kept(close, texts, "text", lambda b: _confirmed(b, k, percent), "confirmed")
    release(pairs, close, texts)
    return found


#: Shingles whose frequency is told to every task, at most; rarer ones count as equally rare.
FREQUENT_SHINGLES = 50_000


def _differing(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come with a member's text and its hub's; rows of one hub come in a row, and its set is made once."""
    hub, base, salt = None, np.zeros(0, _U), _U(0)
    for batch in batches:
        n, near, maps, differ = [], [], [], []
        hubs = batch.column(5)
        for i, own in enumerate(text.shingle_sets(*text.column(batch.column(4)), k)):
            if hub is None or not hubs[i].equals(hub):
                hub = hubs[i]
                (base,) = text.shingle_sets(*text.column(hubs.slice(i, 1)), k)
                salt = text.mix(base).sum(dtype=_U)
            apart = np.setxor1d(own, base, assume_unique=True)
            n.append((len(own), len(base)))
            near.append(len(own) + len(base) > len(apart) and len(apart) * (100 + percent) <= (len(own) + len(base)) * (100 - percent))
            maps.append(parity_map(own))
            differ.append(np.sort(text.mix(apart ^ salt)).view(np.int64))
        size, base_size = (pa.array([x[j] for x in n], pa.int64()) for j in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], size, base_size, pa.array(near, pa.bool_()), pa.array(maps, pa.list_(pa.int64())), pa.array(differ, pa.list_(pa.int64()))],
            ["rep", "hub", "component", "of_hub", "n", "n_hub", "near", "parity", "differ"],
        )


def differences(members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """For ``members(rep, hub, component, of_hub)`` the sizes of both sets, whether the threshold links them, the member's parity map, and as
    ``differ`` the shingles that only one of the two sets has, hashed with all of the hub's.

    Without a hub, that is the whole set. All texts of a repeated id are set against all of its hub's.
    """
    ids = members.select(F.explode(F.array("rep", "hub")).alias("doc_id")).distinct()
    texts = materialize(texts_of(ids, docs), "texts")
    side = lambda name: texts.select(F.col("doc_id").alias(name), F.col("text").alias(f"text_{name}"))
    own = materialize(skew_join(members, side("rep"), ["rep"]), "members")
    both = skew_join(own, side("hub"), ["hub"], "left").select("rep", "hub", "component", "of_hub", "text_rep", "text_hub")
    told = "rep long, hub long, component long, of_hub long, n long, n_hub long, near boolean, parity array<bigint>, differ array<bigint>"
    found = materialize(both.mapInArrow(lambda b: _differing(b, k, percent), told), "differences")
    release(own, texts)
    return found


def _entries(column: pa.Array) -> Iterator[np.ndarray]:
    at, values = np.asarray(column.offsets), np.asarray(column.values).view(_U)
    return (values[i:j] for i, j in zip(at[:-1], at[1:], strict=True))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shingle, n = np.unique(np.concatenate([np.zeros(0, _U), *_entries(batch.column(0))]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(n)], ["shingle", "n"])


def least_common(d: int, n: int, n_hub: int, alone: bool, percent: int) -> int:
    """How many entries the difference of a set, of size n and with d entries, has in common with that of any set linked to it.

    Two differences of d and e entries have (d + e - x) / 2 in common, where x, what the two sets differ by, is at most c (n + m) for
    c = (100 - percent) / (100 + percent). Of all sizes m that the threshold allows, the one next to the hub's asks for the least,
    since e >= abs(m - n_hub). ``alone`` counts only sets that the threshold doesn't link to the hub: e > c (m + n_hub).
    """
    plus, minus = 100 + percent, 100 - percent
    m = min(max(n_hub, -(-n * percent // 100)), 100 * n // max(percent, 1))
    least = -(-((d + abs(m - n_hub)) * plus - minus * (n + m)) // (2 * plus))
    return max(1, least, (d * plus - minus * (n - n_hub)) // (2 * plus) + 1 if alone else 1)


def _prefixes(batches: Iterator[pa.RecordBatch], percent: int, frequent: np.ndarray, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        entry, size, place, row, outer, side = [], [], [], [], [], []
        known = zip(*(batch.column(name).to_pylist() for name in ("n", "n_hub", "near", "component")), strict=True)
        for i, (own, (n, n_hub, near, component)) in enumerate(zip(_entries(batch.column("differ")), known, strict=True)):
            at = np.minimum(np.searchsorted(frequent, own), max(len(frequent) - 1, 0))
            order = np.where(frequent[at] == own, rank[at], -1) if len(frequent) else np.full(len(own), -1)
            own = own[np.lexsort((own, order))].view(np.int64)
            inner, whole = (max(0, len(own) - least_common(len(own), n, n_hub, alone, percent) + 1) for alone in (True, False))
            for out, start, stop in ((False, 0, inner), (True, 0, inner) if near else (True, inner, whole)):
                stop = max(start, stop)
                entry.append(own[start:stop])
                place.append(np.arange(start + 1, stop + 1))
                for column, value in ((size, len(own)), (row, i), (outer, out), (side, int(near) if out else component or 0)):
                    column.append(np.full(stop - start, value, np.int64))
        entry, size, place, row, outer, side = (pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (entry, size, place, row, outer, side))
        told = [batch.column(name).take(row) for name in ("rep", "component", "n", "parity")]
        yield pa.RecordBatch.from_arrays(
            [*told, entry, size, place, outer.cast(pa.bool_()), side], ["rep", "component", "n", "parity", "shingle", "size", "place", "outer", "side"]
        )


def rarest_of(differ: DataFrame, percent: int) -> DataFrame:
    """The rarest entries of each of the ``differences``: as many as one with a set that the threshold links it to can't miss.

    ``place`` orders a difference's entries, ``size`` in number, by how many members have them, then by hash: one order for
    all, as a prefix filter needs. Rows meet those with the same ``shingle`` and ``outer`` and another ``side``, which is their component.
    What a member needs only beside members that are linked to the hub is in ``outer`` rows, whose side tells these from the others. Numbers are told for entries that at least 1 / ``FREQUENT_SHINGLES`` of all members' entries
    are, of which there can't be more than that.
    """
    total = differ.agg(F.sum(F.size("differ"))).first()[0] or 0
    counted = differ.select("differ").mapInArrow(_counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    common = counted.where(F.col("n") >= max(2, -(-total // FREQUENT_SHINGLES))).toPandas().sort_values(["n", "shingle"])
    rank = np.arange(len(common))
    by_hash = np.argsort(common["shingle"].to_numpy(np.int64).view(_U))
    frequent, rank = common["shingle"].to_numpy(np.int64).view(_U)[by_hash], rank[by_hash]
    told = "rep long, component long, n long, parity array<bigint>, shingle long, size long, place long, outer boolean, side long"
    return materialize(differ.mapInArrow(lambda b: _prefixes(b, percent, frequent, rank), told), "rarest")


def rarest(members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``rarest_of`` the whole sets of ``members(rep)``."""
    none = F.lit(None).cast("long")
    return rarest_of(differences(members.select("rep", none.alias("hub"), none.alias("component"), none.alias("of_hub")), docs, k, percent), percent)


def rarest_pairs(rare: DataFrame, percent: int) -> DataFrame:
    """``a, b``: rows of ``rarest`` with an entry in common and different components, as far as sizes, places and parity maps allow a link."""
    entry = ["shingle", "outer"]
    counts = rare.groupBy(*entry, "side").agg(F.count("*").alias("n"))
    most = counts.groupBy(*entry).agg(F.max(F.struct("n", "side")).alias("top"), F.count("*").alias("sides"), F.sum("n").alias("n"))
    most = materialize(most.where("sides > 1").select(*entry, F.col("top.side").alias("most"), "n"), "most")
    mixed = materialize(skew_join(rare, most.drop("n"), entry, counts=most), "shared")
    release(most)
    told = F.struct("rep", "n", "parity", "component", "size", "place", "side")
    fewer, all_of = mixed.where("side <> most").select(*entry, told.alias("x")), mixed.select(*entry, "most", told.alias("y"))
    # A shared entry counts only if what follows it can still make up what the two differences must have in common.
    rest = 1 + F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    enough = (F.col("x.size") + F.col("y.size") - 2 * rest) * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)
    once = (F.col("y.side") == F.col("most")) | (F.col("x.rep") < F.col("y.rep"))
    apart = (F.col("x.side") != F.col("y.side")) & (F.col("x.component") != F.col("y.component"))
    met = skew_join(fewer, all_of, entry).where(apart & once & enough & _near(percent, "x", "y"))
    return met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))


def hubs(buckets: DataFrame) -> DataFrame:
    """``key, hub, weight``: of each bucket's members the one whose buckets hold the most rows, ``weight``, then the smallest id."""
    weight = buckets.groupBy("rep").agg(F.sum("members").alias("weight"))
    weighted = buckets.select("key", "rep").join(weight, "rep")
    hub = weighted.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("top"))
    return hub.select("key", (-F.col("top.minus")).alias("hub"), "top.weight")


def shared_hubs(own: DataFrame, found: DataFrame) -> DataFrame:
    """``key, hub, of_hub`` for written ``hubs``: of all hubs in one component, ``of_hub``, the heaviest stands for each."""
    each = own.select("hub", "weight").distinct().join(found.withColumnRenamed("node", "hub"), "hub", "left")
    each = materialize(each.select("hub", "weight", F.coalesce("component", "hub").alias("of_hub")), "hubs")
    top = each.groupBy("of_hub").agg(F.max(F.struct("weight", (-F.col("hub")).alias("minus"))).alias("top"))
    each = materialize(skew_join(each, top, ["of_hub"]).select("hub", "of_hub", (-F.col("top.minus")).alias("first")), "hubs")
    return skew_join(own, each, ["hub"]).select("key", F.col("first").alias("hub"), "of_hub")


def hub_pairs(buckets: DataFrame) -> DataFrame:
    """Every bucket member with its bucket's hub."""
    # A pair's hub is the same one in all buckets that the two share: the greater one by weight and id.
    return buckets.select("key", "rep").join(hubs(buckets), "key").where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, *, k: int = 5, percent: int = 85, chunks: int = 12, width: int = 6, differ: int | None = None, pair_up_to: int = 64
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    Two texts are linked when their shingle sets have 100 * intersection >= percent * union; component_id is the smallest
    doc_id reachable over links. A null, empty or blank text has an empty set and links with nothing, not even another
    empty one. A row without an id links with nothing, has no component_id and is kept. Ties do not arise (ids decide); rows
    that repeat an id are each returned and count as one node, linked by any of their texts;
    an empty table gives an empty result; further columns are ignored. ``chunks * width`` symbols make the signature and
    ``differ`` of them may differ, or else 2 * chunks - 1; at the defaults a pair at exactly 85 % is beyond that with a
    probability under 1e-4 and any closer one with less. Up to 2 * chunks - 1 a pair surely shares a bucket; a pair at
    exactly 80 % misses all buckets of 12 chunks of 6 with a probability of 3e-6. Buckets of up to ``pair_up_to`` members pair their components directly.
    """
    symbols, r = chunks * width, 2 * chunks - 1 if differ is None else differ
    sketches = materialize(sketch(docs, k, symbols), "sketches")
    full = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    content = ["n_shingles", "set_one", "set_two"]
    groups = full.groupBy(*content).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("signature").alias("signature"), F.first("parity").alias("parity"))
    groups = materialize(groups, "groups")
    member = skew_join(full.select("doc_id", *content), groups.select(*content, "rep"), content, counts=groups)
    member = materialize(member.select("doc_id", "rep").distinct(), "members")
    # An id with several texts may stand for several contents.
    reps = groups.select(F.col("rep").alias("doc_id"), "n_shingles", "signature", "parity")

    buckets = index(reps, chunks, width)
    links = confirm(hub_pairs(buckets), reps, docs, k, percent, r, symbols)
    found = components(links)

    mixed = buckets.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    split = mixed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    mixed = materialize(mixed.join(split, "key"), "mixed")
    sets = reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "parity")
    small = mixed.where(F.col("members") <= pair_up_to).select("key", "rep", "component").join(sets, "rep")
    large = mixed.where(F.col("members") > pair_up_to).select("key", "rep", "component")
    apart = F.col("x.component") != F.col("y.component")
    met = small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & apart & _near(percent, "x", "y"))
    own = materialize(hubs(buckets).join(large.select("key").distinct(), "key"), "hubs")
    large = materialize(skew_join(large, shared_hubs(own, found), ["key"]).select("rep", "hub", "component", "of_hub").distinct(), "large")
    differ = differences(large, docs, k, percent)
    # The sets of these have been compared; signatures had told most of them before.
    to_hub = differ.where("near AND component <> of_hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    pairs = met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).unionByName(rarest_pairs(rarest_of(differ, percent), percent))
    more = materialize(confirm(pairs.distinct(), reps, docs, k, percent, r, symbols).unionByName(to_hub), "more")
    if not more.isEmpty():
        found = components(links.unionByName(more))

    whole = skew_join(member, found.withColumnRenamed("node", "rep"), ["rep"], "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    named = whole.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
