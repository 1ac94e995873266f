"""The store's life cycle: folds against a plain model, allocation, commit and reopen, scalars with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import bits, order
from tessera.functions import collections as c
from tessera.functions.types import codec, codec_for
from tessera.operators.alloc import allocate
from tessera.operators.fold import apply_ops, apply_ops_streamed
from tessera.operators.state import RecordError
from tessera.plans.numbering import numbered
from tessera.plans.store import RecordStore
from tessera.sources.snapshot import commit, export_flat, import_flat, reopen
from tessera.streaming.oplog import run_log

STATE = "recid long, state int, payload long"
OPS = "seq long, recid long, op string, arg long, expected long"


def model(state, ops):
    now, out = {r: (s, p) for r, s, p in state}, []
    for seq, recid, op, arg, expected in sorted(ops):
        life, held = now.get(recid, (0, None))
        if op in ("put", "update", "cas", "preallocate_put") and (arg is None or arg == 9):
            status = "NULL_VALUE" if arg is None else "TOO_LARGE"
        elif op == "preallocate_put":
            status = "OK" if life == 1 else "NOT_PREALLOC"
        elif op in ("put", "preallocate"):
            status = "OK" if life == 0 else "OCCUPIED"
        elif life != 2:
            status = "NOT_FOUND" if life == 0 else "PREALLOC"
        else:
            status = "MISMATCH" if op in ("cas", "cad") and held != expected else "OK"
        after = (life, held)
        if status == "OK":
            after = {"get": after, "delete": (0, None), "cad": (0, None), "preallocate": (1, None)}.get(op, (2, arg))
        now[recid] = after
        out.append((seq, recid, op, status, held, after[1]))
    return sorted((r, *v) for r, v in now.items() if v[0]), out


@pytest.mark.parametrize("seed", range(2))
def test_random_log_equals_model(spark, seed):
    rnd = random.Random(seed)
    names = ["get", "update", "cas", "cad", "delete", "put", "preallocate", "preallocate_put"]
    state = [(r, s := rnd.choice([1, 2]), rnd.randrange(3) if s == 2 else None) for r in range(1, 20)]
    ops = [(i, rnd.randrange(1, 30), rnd.choice(names), rnd.choice([0, 1, 2, None]), rnd.randrange(3)) for i in range(800)]
    end, results = model(state, ops)
    s, o = spark.createDataFrame(state, STATE), spark.createDataFrame(ops, OPS)
    got, rows = apply_ops(s, o)
    assert sorted(map(tuple, got.collect())) == end
    assert sorted(map(tuple, rows.collect())) == results
    streamed = [tuple(r) for r in apply_ops_streamed(s, o).collect()]
    assert sorted(r for r in streamed if r[2] != "end") == results
    assert sorted((r[1], int(r[3]), r[5]) for r in streamed if r[2] == "end" and r[3] != "0") == end


@pytest.mark.parametrize("first_freed", [False, True])
def test_allocation_equals_simulation(spark, first_freed):
    rnd, live, free, top, log, want = random.Random(5), list(range(1, 60)), [], 59, [], []
    for seq in range(100):
        if rnd.random() < 0.5 and live:
            recid = live.pop(rnd.randrange(len(live)))
            free.append(recid)
            log.append((seq, "delete", recid))
        else:
            if free:
                recid = free.pop(0 if first_freed else -1)
            else:
                top += 1
                recid = top
            log.append((seq, "put", None))
        want.append((seq, log[-1][1], recid))
    got = allocate(spark.createDataFrame(log, "seq long, op string, recid long"), 59, first_freed=first_freed)
    assert sorted(map(tuple, got.collect())) == want


def test_a_log_on_one_recid_is_linear(spark):
    import time

    def log(n):
        rows = spark.range(n).select(F.col("id").alias("seq"), F.lit(1).cast("long").alias("recid"), F.lit("cas").alias("op"), (F.col("id") % 7).alias("arg"), (F.col("id") % 5).alias("expected"))
        start = time.time()
        got = apply_ops(spark.createDataFrame([(1, 2, 0)], STATE), rows)[1].agg(F.count("*"), F.count(F.when(F.col("status") == "OK", 1))).first()
        return got, time.time() - start

    log(100)
    small, _ = log(20_000)
    large, seconds = log(400_000)
    assert small[0] == 20_000 and large[0] == 400_000 and large[1] == small[1] == 2 and seconds < 30


def test_not_a_number_and_zeros_compare_as_in_sql(spark):
    nan = float("nan")
    state = spark.createDataFrame([(1, 2, nan), (2, 2, 0.0)], "recid long, state int, payload double")
    ops = spark.createDataFrame([(1, 1, "cas", 1.0, nan), (2, 2, "cas", 2.0, -0.0), (3, 1, "cad", None, 2.0)], "seq long, recid long, op string, arg double, expected double")
    assert [r["status"] for r in apply_ops(state, ops)[1].orderBy("seq").collect()] == ["OK", "OK", "MISMATCH"]
    with pytest.raises(Exception, match="unknown op"):
        apply_ops(state, ops.withColumn("op", F.lit("swap")))[1].collect()


@pytest.mark.parametrize("kind", ["string", "binary", "array<int>", "decimal(30,2)"])
def test_logs_of_other_payloads(spark, kind):
    value = lambda x: F.array(F.lit(x), F.lit(None)).cast(kind) if kind.startswith("array") else F.lit(x).cast("string").cast(kind)
    state = spark.range(1).select(F.lit(1).cast("long").alias("recid"), F.lit(2).alias("state"), value(5).alias("payload"))
    ops = spark.range(1, 3).select(F.col("id").alias("seq"), F.lit(1).cast("long").alias("recid"), F.lit("cas").alias("op"), value(6).alias("arg"), value(5).alias("expected"))
    after, rows = apply_ops(state, ops)
    assert [r["status"] for r in rows.orderBy("seq").collect()] == ["OK", "MISMATCH"]
    assert after.where(F.col("payload").cast("string") == value(6).cast("string")).count() == 1


def test_slices_stay_small_with_an_outlier_and_repeats(spark):
    from tessera.plans.numbering import sliced

    rows = spark.range(20_000).select(F.when(F.col("id") == 7, F.lit(-(1 << 62))).when(F.col("id") == 8, F.lit((1 << 63) - 1)).otherwise(F.col("id")).alias("k"))
    s = sliced(rows, "k", 64)
    assert sum(x["n"] for x in s.slices) == 20_000 and max(x["n"] for x in s.slices) <= 2 * 20_000 // 64
    assert all(a["high"] < b["low"] for a, b in zip(s.slices[:-1], s.slices[1:], strict=True))
    got = [r[0] for r in numbered(rows, "k", "n", 64).orderBy("k").select("n").collect()]
    assert got == list(range(1, 20_001))
    same = spark.createDataFrame([(5,)] * 50 + [(6,)], "k long")
    assert sorted(r["n"] for r in numbered(same, "k", "n", 4).collect()) == list(range(1, 52))


def test_batches_with_repeats_nulls_and_large_values_leave_a_sound_store(spark):
    state = spark.createDataFrame([(1, 2, "a"), (2, 1, None), (3, 2, "c"), (4, 1, None)], "recid long, state int, payload string")
    store = RecordStore(state, 4, max_record_size=3)
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (1, None), (3, "long one"), (2, "p"), (9, "q")], "recid long, new string")
    after, result = store.update(rows)
    assert sorted(map(tuple, result.select("recid", "new", "status").collect()), key=repr) == sorted([(1, "x", "OK"), (1, "y", "OK"), (1, None, "NULL_VALUE"), (3, "long one", "TOO_LARGE"), (2, "p", "PREALLOC"), (9, "q", "NOT_FOUND")], key=repr)
    assert after.verify().isEmpty() and after.get_one(1) == "y" and after.get_one(3) == "c" and after.state.count() == 4
    after, result = store.preallocate_put(spark.createDataFrame([(2, "u"), (2, "v"), (4, None), (1, "w"), (2, "large")], "recid long, new string"))
    assert sorted((r[0], r[1]) for r in result.collect()) == [(1, "NOT_PREALLOC"), (2, "NOT_PREALLOC"), (2, "OK"), (2, "TOO_LARGE"), (4, "NULL_VALUE")]
    assert after.verify().isEmpty() and after.get_one(2) == "v"
    after, given = store.put(spark.createDataFrame([(1, "n"), (2, None), (3, "abcd"), (4, "m")], "k int, v string"), "k", "v")
    assert sorted(map(tuple, given.collect())) == [(1, 5, "OK"), (2, None, "NULL_VALUE"), (3, None, "TOO_LARGE"), (4, 6, "OK")]
    assert after.verify().isEmpty() and after.highest() == 6
    after, result = store.delete(spark.createDataFrame([(1,), (1,), (2,), (8,)], "recid long"))
    assert sorted(map(tuple, result.select("recid", "status").collect())) == [(1, "OK"), (1, "OK"), (2, "PREALLOC"), (8, "NOT_FOUND")]
    again, given = after.put(spark.createDataFrame([(1, "n"), (2, "m")], "k int, v string"), "k", "v")
    assert sorted(r["recid"] for r in given.collect()) == [1, 5] and again.verify().isEmpty() and again.highest() == 5
    changed, result = store.update_atomic(F.col("recid") < 4, lambda x: F.when(x == "a", "aaaa").otherwise(x))
    assert sorted(map(tuple, result.collect())) == [(1, "TOO_LARGE", "a", "a"), (3, "OK", "c", "c")] and changed.verify().isEmpty()
    raised, _ = store.apply(spark.createDataFrame([(1, 20, "put", "z", None), (2, 1, "delete", None, None)], "seq long, recid long, op string, arg string, expected string"))
    assert raised.highest() == 20 and [r[0] for r in raised.freed.collect()] == [1]


def test_summary_raw_and_limits(spark, tmp_path):
    from tessera.sources.snapshot import CommitConflict, _publish, rollback

    state = spark.createDataFrame([(1, 2, "abc"), (3, 1, None)], "recid long, state int, payload string")
    closed = []
    store = RecordStore(state, 4, size_limit=2, on_close=[lambda: closed.append(1)])
    row = store.summary().first().asDict()
    assert row == {"live": 1, "preallocated": 1, "free_recids": 2, "bytes": 3, "class_bytes": 16, "max_recid": 4, "max_record_size": (1 << 31) - 1, "size_limit": 2}
    assert sorted(map(tuple, store.raw().collect())) == [(1, 2, "abc"), (2, 0, None), (3, 1, None), (4, 0, None)]
    path = f"file://{tmp_path}/limited"
    with pytest.raises(ValueError, match="limit"):
        commit(store, path)
    store.size_limit = 3
    assert commit(store, path) == 1
    with pytest.raises(CommitConflict):
        _publish(spark, path, 1, "{}")
    state.write.parquet(f"{path}/snapshot-orphan")
    assert rollback(spark, path) == ["snapshot-orphan"] and rollback(spark, path) == []
    assert reopen(spark, path).size_limit == 3 and reopen(spark, path).get_one(1) == "abc"
    store.close()
    assert closed == [1]


def test_numbers_are_consecutive(spark):
    rows = spark.createDataFrame([(x,) for x in (-5, 7, 1000, 3, 10**12)], "k long")
    assert sorted(map(tuple, numbered(rows, "k", "n").collect())) == [(-5, 1), (3, 2), (7, 3), (1000, 4), (10**12, 5)]
    assert numbered(rows.limit(0), "k", "n").collect() == []


def test_reopen_keeps_records_and_allocates_above_them(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store = RecordStore(spark.createDataFrame([(1, 2, 10), (2, 1, None), (3, 2, 30)], STATE))
    store = store.delete(spark.createDataFrame([(3,)], "recid long"))[0]
    assert commit(store, path) == 1
    again = reopen(spark, path)
    assert sorted(map(tuple, again.state.collect())) == [(1, 2, 10), (2, 1, None)]
    assert again.verify().isEmpty() and [r[0] for r in again.free_recids().collect()] == [3]
    grown, given = again.put(spark.createDataFrame([(0, 99)], "k int, v long"), "k", "v")
    assert [tuple(r) for r in given.collect()] == [(0, 3, "OK")]  # the recid that was freed
    grown, given = grown.put(spark.createDataFrame([(0, 98)], "k int, v long"), "k", "v")
    assert [tuple(r) for r in given.collect()] == [(0, 4, "OK")]
    assert commit(grown, path) == 2 and reopen(spark, path).get_one(3) == 99 and reopen(spark, path).get_one(4) == 98
    assert sorted(r[0] for r in reopen(spark, path, 1).state.select("recid").collect()) == [1, 2]
    with pytest.raises(RecordError, match="PREALLOC"):
        grown.get_one(2)
    with pytest.raises(RecordError, match="NOT_FOUND"):
        grown.get_one(77)


def test_flat_files_round_trip(spark, tmp_path):
    rows = [(1, 2, bytearray(b"aa")), (2, 1, None), (5, 2, bytearray())]
    export_flat(spark.createDataFrame(rows, "recid long, state int, payload binary"), f"file://{tmp_path}/flat")
    back = import_flat(spark.read.parquet(f"file://{tmp_path}/flat"))
    assert sorted(map(tuple, back.collect())) == rows


def test_streamed_log(spark, tmp_path):
    path, log = f"file://{tmp_path}/store", f"file://{tmp_path}/log"
    commit(RecordStore(spark.createDataFrame([(1, 2, 10)], STATE)), path)
    spark.createDataFrame([(1, 1, "cas", 11, 10), (2, 2, "put", 20, None)], OPS).write.parquet(log)
    run_log(spark.readStream.schema(OPS).parquet(log), path, f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(map(tuple, reopen(spark, path).state.collect())) == [(1, 2, 11), (2, 2, 20)]


def test_known_answers(spark):
    def one(column):
        return spark.range(1).select(column).first()[0]

    long = lambda x: F.lit(x).cast("long")
    for x, want in ((0, 1), (2, 2), (0b110, 0b111), (0b1110, 0b1110), (0b1010, 0b1011), (0b11110, 0b11111)):
        assert one(bits.parity_set(long(x), 1)) == want
        assert one(bits.parity_get(long(want), 1)) == x
    assert one(bits.parity_get(long(3), 1)) is None
    for x, want in ((1, 1), (2, 2), (3, 4), (33, 64), (61, 64), (777, 1024)):
        assert one(bits.next_pow2(long(x))) == want
    assert one(bits.unsigned(F.lit(-(1 << 31)))) == 1 << 31
    for x in (0, 1, 127, 128, 16383, 16384, (1 << 62) + 5, (1 << 63) - 1):
        packed = one(bits.pack(long(x)))
        assert one(bits.unpack(F.lit(packed))) == x and one(bits.packed_size(long(x))) == len(packed) // 2
    assert one(bits.add32(F.lit((1 << 31) - 1), 1)) == -(1 << 31) and one(bits.add64(long((1 << 63) - 1), 1)) == -(1 << 63)
    assert one(bits.fill_low_bits(F.lit(63))) == (1 << 63) - 1 and one(bits.fill_low_bits(F.lit(64))) == -1
    assert one(c.string_hash(F.lit("a"))) == one(bits.mul32(F.lit(97), bits.INT_MULTIPLIER)) and one(c.string_hash(F.lit(""))) == 0
    assert one(c.next_value(F.array(F.lit(1), F.lit(255)), 255)) == [2, 0] and one(c.next_value(F.array(F.lit(255)), 255)) is None
    assert one(c.common_prefix(F.lit("abcd"), F.lit("abx"))) == 2 and one(c.common_prefix(F.lit(""), F.lit("x"))) == 0


def test_orders(spark):
    text = spark.createDataFrame([("\U0001f600",), ("",), ("a",)], "s string")
    assert [r[0] for r in text.orderBy(order.utf16_key(F.col("s"))).collect()] == ["a", "\U0001f600", ""]
    arrays = spark.createDataFrame([([1, None],), ([1, 2],), ([1],)], "a array<int>")
    assert [r[0] for r in arrays.orderBy(order.null_last_key(F.col("a"))).collect()] == [[1], [1, 2], [1, None]]
    floats = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (-1.0,)], "x double")
    assert [str(r[0]) for r in floats.orderBy(order.float_key(F.col("x"))).collect()] == ["-1.0", "-0.0", "0.0", "nan"]
    assert codec("uuid").size == 16 and codec_for("bigint").name == "long" and codec_for("nothing") is None


def test_hashes_outside_expressions(spark):
    import struct

    import xxhash

    from tessera.functions.hash32 import double_bits, xxhash32

    rows = spark.createDataFrame([(bytearray(b""), [0.0, -0.0]), (bytearray(b"abc"), [1.5, float("nan")]), (None, None)], "b binary, d array<double>")
    got = rows.select(xxhash32(F.col("b"), 7).alias("h"), double_bits(F.col("d")).alias("x")).collect()
    signed = lambda n: n - (1 << 32) if n >= 1 << 31 else n
    assert [r["h"] for r in got] == [signed(xxhash.xxh32_intdigest(b"", 7)), signed(xxhash.xxh32_intdigest(b"abc", 7)), None]
    assert got[0]["x"] == [0, -(1 << 63)] and got[1]["x"] == [struct.unpack("<q", struct.pack("<d", 1.5))[0], 0x7FF8000000000000] and got[2]["x"] is None


def test_export_and_import(spark, tmp_path):
    from tessera.cli import main

    commit(RecordStore(spark.createDataFrame([(1, 2, 10)], STATE)), f"file://{tmp_path}/a")
    main(["export", "-d", f"file://{tmp_path}/a", "-o", f"file://{tmp_path}/out"])
    main(["import", "-d", f"file://{tmp_path}/b", "-i", f"file://{tmp_path}/out"])
    assert [tuple(r) for r in reopen(spark, f"file://{tmp_path}/b").state.collect()] == [(1, 2, 10)]


def test_positions_outside_a_list_are_errors(spark):
    a = F.array(F.lit(1), F.lit(2))
    one = lambda column: spark.range(1).select(column).first()[0]
    for bad in (c.get(a, 2), c.get(a, -1), c.insert(a, 3, F.lit(0)), c.insert_all(a, -1, a), c.replace(a, 2, F.lit(0)), c.remove(a, 2), c.removed(a, -1)["old"], c.remove_range(a, 1, 3), c.remove_range(a, 2, 1), c.sub_list(a, 0, 3)):
        with pytest.raises(Exception, match="out of bounds"):
            one(bad)
    none = F.lit(None).cast("array<int>")
    assert one(c.insert(a, 2, F.lit(3))) == [1, 2, 3] and one(c.remove(a, 1)) == [1] and one(c.sub_list(a, 2, 2)) == [] and one(c.remove(none, 0)) is None
    assert one(c.removed(a, 1)) == ([1], 2) and one(c.replaced(a, 0, F.lit(9))) == ([9, 2], 1)


def test_long_deltas_decode_in_blocks(spark):
    long = F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda x: (x * x).cast("long"))
    nested = F.transform(F.sequence(F.lit(1), F.lit(700)), lambda x: F.array(F.floor(x / 9), x))
    row = spark.range(1).select(c.delta_decode(c.delta_encode(long)).alias("a"), c.array_delta_decode(c.array_delta_encode(nested)).alias("b"), c.delta_decode(F.array().cast("array<bigint>")).alias("none")).first()
    assert row["a"] == [x * x for x in range(1, 3001)] and row["b"] == [[x // 9, x] for x in range(1, 701)] and row["none"] == []
    groups = [[b"abc", b"abd"], [b"\xff\x00", b"\xff\x0f"], [b""], []]
    rows = spark.createDataFrame([(list(map(bytearray, g)),) for g in groups], "a array<binary>").select("a", c.bytes_prefix_encode(F.col("a")).alias("e")).select("a", "e.prefix", c.bytes_prefix_decode(F.col("e")).alias("back")).collect()
    assert [bytes(r["prefix"]) for r in rows] == [b"ab", b"\xff", b"", b""] and all(r["a"] == r["back"] for r in rows)


def test_prefixes_and_big_endian_come_back(spark):
    texts = [["abc", "abd", "ab"], ["é☃x", "é☃"], ["one"], ["", "a"], []]
    rows = spark.createDataFrame([(t,) for t in texts], "a array<string>").select("a", c.prefix_encode(F.col("a")).alias("e")).select("a", "e.prefix", c.prefix_decode(F.col("e")).alias("back")).collect()
    assert [r["prefix"] for r in rows] == ["ab", "é☃", "one", "", ""] and all(r["a"] == r["back"] for r in rows)
    groups = [[[1, 2, 3], [1, 2, 4], [1, 2], [], [5], [5, None], [5, None, 6]], [[]], []]
    rows = spark.createDataFrame([(g,) for g in groups], "a array<array<int>>").select("a", c.array_delta_encode(F.col("a")).alias("e")).select("a", "e.shared", "e.rest", c.array_delta_decode(F.col("e")).alias("back")).collect()
    assert rows[0]["shared"] == [0, 2, 2, 0, 0, 1, 2] and rows[0]["rest"] == [[1, 2, 3], [4], [], [], [5], [None], [6]]
    assert all(r["a"] == r["back"] for r in rows)
    for size in (4, 6, 8):
        ends = [0, 1, -1, 255, 2 ** (8 * size - 1) - 1, -(2 ** (8 * size - 1))]
        got = spark.createDataFrame([(x,) for x in ends], "x long").select(bits.from_big_endian(bits.big_endian(F.col("x"), size), size)).collect()
        assert [r[0] for r in got] == ends
    assert spark.range(1).select(bits.from_big_endian(F.lit("FFFFFFFFFFFE"), 6, signed=False)).first()[0] == 2**48 - 2
