"""Registered queries over the store's operators, each with the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import bits
from tessera.functions import collections as c
from tessera.functions import order, types
from tessera.functions.hash32 import double_array_hash
from tessera.operators import alloc, atomic
from tessera.operators.fold import apply_ops, apply_ops_streamed
from tessera.operators.state import PREALLOC, as_state
from tessera.plans import keyed
from tessera.plans.store import RecordStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _orders(spark: SparkSession, sf: str) -> RecordStore:
    """Orders as live records: recid is the key plus one, the payload the total price."""
    rows = _read(spark, sf, "orders").select((F.col("o_orderkey") + 1).alias("recid"), F.col("o_totalprice").alias("payload"))
    return RecordStore(as_state(rows, "recid", "payload"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Probes: each event asks for recid event_id * 2, so about half of them miss."""
    return _read(spark, sf, "events").select((F.col("event_id") * 2).alias("recid"), F.col("value").alias("new"))


# --- record store

_STORE = "(SELECT o_orderkey + 1 AS recid, o_totalprice AS payload FROM orders)"
_ASKED = "(SELECT event_id * 2 AS recid, value AS new FROM events)"


@register(f"SELECT recid, payload FROM {_STORE} WHERE recid % 10 <> 0 ORDER BY recid")
def store_get_all_sorted(spark: SparkSession, sf: str) -> DataFrame:
    store = _orders(spark, sf)
    return store.delete(store.state.where("recid % 10 = 0").select("recid"))[0].get_all()


@register(f"SELECT a.recid, CASE WHEN s.recid IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS status, s.payload FROM {_ASKED} a LEFT JOIN {_STORE} s USING (recid)")
def store_multi_get_status(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).get(_asked(spark, sf).select("recid"))


@register("SELECT event_id, (SELECT max(o_orderkey) + 1 FROM orders) + row_number() OVER (ORDER BY event_id) AS recid, 'OK' AS status FROM events")
def store_put(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).put(_read(spark, sf, "events"), "event_id", "value")[1]


@register("SELECT (SELECT max(o_orderkey) + 1 FROM orders) + row_number() OVER (ORDER BY event_id) AS recid, 1 AS state FROM events")
def store_preallocate_bulk(spark: SparkSession, sf: str) -> DataFrame:
    store, _ = _orders(spark, sf).preallocate(_read(spark, sf, "events"), "event_id")
    return store.state.where(F.col("state") == PREALLOC).select("recid", "state")


@register(
    """WITH n AS (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_suppkey) AS recid FROM supplier)
SELECT recid, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS state, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS payload FROM n"""
)
def store_preallocate_put(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "supplier")
    empty = RecordStore(spark.createDataFrame([], "recid long, state int, payload double"), 0)
    store, given = empty.preallocate(rows, "s_suppkey")
    return store.preallocate_put(given.where("s_suppkey % 2 = 0").join(rows, "s_suppkey").select("recid", F.col("s_acctbal").alias("new")))[0].state


@register(f"SELECT s.recid, coalesce(a.new, s.payload) AS payload FROM {_STORE} s LEFT JOIN {_ASKED} a USING (recid)")
def store_update(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).update(_asked(spark, sf))[0].state.select("recid", "payload")


@register(f"SELECT a.recid, CASE WHEN s.recid IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS status, s.payload AS old, a.new FROM {_ASKED} a LEFT JOIN {_STORE} s USING (recid)")
def store_get_and_update(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).update(_asked(spark, sf))[1]


@register("SELECT p_partkey + 1 AS recid, 'OK' AS status, p_size AS old, p_size // 2 * 2 AS new FROM part WHERE p_size % 3 = 0")
def store_update_atomic(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "part").select((F.col("p_partkey") + 1).alias("recid"), F.col("p_size").alias("payload"))
    return RecordStore(as_state(rows, "recid", "payload")).update_atomic(F.col("payload") % 3 == 0, lambda x: x - x % 2)[1]


@register("SELECT o_orderkey + 1 AS recid, CASE WHEN o_orderkey % 3 = 0 THEN 'OK' ELSE 'MISMATCH' END AS status FROM orders")
def store_compare_and_update(spark: SparkSession, sf: str) -> DataFrame:
    store = _orders(spark, sf)
    rows = store.state.select("recid", F.when((F.col("recid") - 1) % 3 == 0, F.col("payload")).otherwise(F.lit(-1.0)).alias("expected"), F.lit(0.0).alias("new"))
    return store.compare_and_update(rows)[1].select("recid", "status")


@register("SELECT o_orderkey + 1 AS recid, o_totalprice AS payload FROM orders WHERE o_orderkey % 3 <> 0")
def store_compare_and_delete(spark: SparkSession, sf: str) -> DataFrame:
    store = _orders(spark, sf)
    rows = store.state.select("recid", F.when((F.col("recid") - 1) % 3 == 0, F.col("payload")).alias("expected"))
    return store.compare_and_delete(rows)[0].state.select("recid", "payload")


@register(f"SELECT s.recid, s.payload FROM {_STORE} s ANTI JOIN {_ASKED} a USING (recid)")
def store_delete(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).delete(_asked(spark, sf).select("recid"))[0].state.select("recid", "payload")


@register(f"SELECT a.recid, CASE WHEN s.recid IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS status, s.payload AS old FROM {_ASKED} a LEFT JOIN {_STORE} s USING (recid)")
def store_get_and_delete(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).delete(_asked(spark, sf).select("recid"))[1]


@register("SELECT count(*) = 0 AS is_empty, max(o_orderkey) + 1 AS max_recid, 0 AS bad_rows FROM orders")
def store_is_empty_max_recid_verify(spark: SparkSession, sf: str) -> DataFrame:
    store = _orders(spark, sf)
    bad = store.verify().agg(F.count("*").cast("int").alias("bad_rows"))
    return store.state.agg((F.count("*") == 0).alias("is_empty"), F.max("recid").alias("max_recid")).select("is_empty", "max_recid", bad.scalar().alias("bad_rows"))


@register("SELECT (n_chars + 15) // 16 * 16 AS size_class, count(*) AS records, CAST(sum((n_chars + 15) // 16 * 16) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def store_stats_size_classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "documents").select((F.col("doc_id") + 1).alias("recid"), F.col("n_chars").alias("payload"))
    return RecordStore(as_state(rows, "recid", "payload")).statistics(F.col("payload"))


@register(f"SELECT s.recid FROM {_STORE} s SEMI JOIN {_ASKED} a USING (recid)")
def store_free_recids(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).delete(_asked(spark, sf).select("recid"))[0].free_recids()


@register(f"SELECT recid, payload FROM {_STORE} WHERE recid % 7 <> 0")
def store_compact_live(spark: SparkSession, sf: str) -> DataFrame:
    store = _orders(spark, sf)
    return store.delete(store.state.where("recid % 7 = 0").select("recid"))[0].compact().state.select("recid", "payload")


@register("SELECT o_orderkey + 1 AS recid, CAST(1 + CASE WHEN n > 65535 THEN (n - 1) // 65527 ELSE 0 END AS BIGINT) AS chunks FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders)")
def store_linked_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that a record of so many bytes is linked from: up to 65535 bytes one, else 8 bytes of each are a pointer."""
    return _orders(spark, sf).state.select("recid", bits.linked_chunks(F.floor("payload")).alias("chunks"))


# Batches that hold nulls, repeats, misses and values over the limit.

_MIXED = "(SELECT CAST(event_id % 700 * 3 AS BIGINT) AS recid, CASE WHEN event_id % 5 <> 0 THEN repeat('v', CAST(event_id % 9 AS INT)) || event_id % 4 END AS new FROM events)"
_NAMES = "(SELECT c_custkey + 1 AS recid, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 2 END AS state, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS payload FROM customer)"
_MOST = 8


def _names(spark: SparkSession, sf: str) -> RecordStore:
    """Customers' segments, every fourth one preallocated only, in a store for records of up to eight bytes."""
    held = F.col("c_custkey") % 4 != 0
    rows = _read(spark, sf, "customer").select((F.col("c_custkey") + 1).alias("recid"), F.when(held, 2).otherwise(1).alias("state"), F.when(held, F.col("c_mktsegment")).alias("payload"))
    return RecordStore(rows, max_record_size=_MOST)


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return _read(spark, sf, "events").select((e % 700 * 3).alias("recid"), F.when(e % 5 != 0, F.concat(F.repeat(F.lit("v"), (e % 9).cast("int")), (e % 4).cast("string"))).alias("new"))


_ASKED_MIXED = f"""m AS (SELECT r.recid, r.new, s.state, s.payload, CASE WHEN s.state = 2 THEN CASE WHEN r.new IS NULL THEN 'NULL_VALUE' WHEN strlen(r.new) > {_MOST} THEN 'TOO_LARGE' ELSE 'OK' END
  WHEN s.state = 1 THEN 'PREALLOC' ELSE 'NOT_FOUND' END AS status FROM {_MIXED} r LEFT JOIN {_NAMES} s USING (recid))"""


@register(f"WITH {_ASKED_MIXED} SELECT recid, status, payload AS old, new FROM m")
def store_update_mixed_results(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).update(_mixed(spark, sf))[1]


@register(f"WITH {_ASKED_MIXED}, w AS (SELECT recid, max(new) AS new FROM m WHERE status = 'OK' GROUP BY recid) SELECT s.recid, s.state, coalesce(w.new, s.payload) AS payload FROM {_NAMES} s LEFT JOIN w USING (recid)")
def store_update_mixed_state(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).update(_mixed(spark, sf))[0].state


_GOOD = f"(SELECT recid, max(new) AS new FROM {_MIXED} WHERE new IS NOT NULL AND strlen(new) <= {_MOST} GROUP BY recid)"


@register(f"SELECT s.recid, CASE WHEN s.state = 1 AND g.new IS NOT NULL THEN 2 ELSE s.state END AS state, CASE WHEN s.state = 1 THEN g.new ELSE s.payload END AS payload FROM {_NAMES} s LEFT JOIN {_GOOD} g USING (recid)")
def store_preallocate_put_mixed(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).preallocate_put(_mixed(spark, sf))[0].state


@register(
    f"""WITH g AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN repeat('v', CAST(event_id % 9 AS INT)) || event_id % 4 END AS v FROM events),
r AS (SELECT event_id, CASE WHEN v IS NULL THEN 'NULL_VALUE' WHEN strlen(v) > {_MOST} THEN 'TOO_LARGE' ELSE 'OK' END AS status FROM g),
n AS (SELECT event_id, status, CASE WHEN status = 'OK' THEN row_number() OVER (PARTITION BY status ORDER BY event_id) END AS n FROM r),
f AS (SELECT recid, row_number() OVER (ORDER BY recid) AS n FROM {_NAMES} WHERE state = 2 AND recid % 10 = 0)
SELECT event_id, CASE WHEN n.n IS NOT NULL THEN coalesce(f.recid, (SELECT max(recid) FROM {_NAMES}) + n.n - (SELECT count(*) FROM f)) END AS recid, status FROM n LEFT JOIN f USING (n)"""
)
def store_put_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth recid is deleted, then values are put: freed recids are taken first, refused values get none."""
    store = _names(spark, sf)
    store = store.delete(store.state.where("recid % 10 = 0").select("recid"))[0]
    e = F.col("event_id")
    rows = _read(spark, sf, "events").select("event_id", F.when(e % 5 != 0, F.concat(F.repeat(F.lit("v"), (e % 9).cast("int")), (e % 4).cast("string"))).alias("v"))
    return store.put(rows, "event_id", "v")[1]


@register(
    f"""WITH s AS (SELECT * FROM {_NAMES} WHERE state = 1 OR recid % 10 <> 0) SELECT count(payload) AS live, CAST(count(*) FILTER (state = 1) AS BIGINT) AS preallocated, (SELECT max(recid) FROM {_NAMES}) - count(*) AS free_recids,
CAST(sum(strlen(payload)) AS BIGINT) AS bytes, CAST(sum((strlen(payload) + 15) // 16 * 16) AS BIGINT) AS class_bytes, (SELECT max(recid) FROM {_NAMES}) AS max_recid, CAST({_MOST} AS BIGINT) AS max_record_size, CAST(NULL AS BIGINT) AS size_limit FROM s"""
)
def store_summary(spark: SparkSession, sf: str) -> DataFrame:
    store = _names(spark, sf)
    return store.delete(store.state.where("recid % 10 = 0").select("recid"))[0].summary()


@register(f"SELECT recid, CASE WHEN state = 2 AND recid % 10 = 0 THEN 0 ELSE state END AS state, CASE WHEN state = 2 AND recid % 10 <> 0 THEN payload END AS payload FROM {_NAMES}")
def store_raw(spark: SparkSession, sf: str) -> DataFrame:
    store = _names(spark, sf)
    return store.delete(store.state.where("recid % 10 = 0").select("recid"))[0].raw()


# --- folds of operation logs

_OP = """CASE event_type WHEN 'signup' THEN 'put' WHEN 'purchase' THEN 'update' WHEN 'click' THEN 'cas' WHEN 'view' THEN 'get' ELSE 'delete' END"""


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """A log from the events of each user; a compare-and-set expects the rounded value of the last purchase modulo 3."""
    return _read(spark, sf, "events").select(
        F.col("event_id").alias("seq"), (F.col("user_id") + 1).alias("recid"), F.expr(_OP).alias("op"), (F.col("event_id") % 3).alias("arg"), (F.col("event_id") % 2).alias("expected")
    )


_FOLD = f"""
WITH RECURSIVE ops AS (SELECT event_id AS seq, user_id + 1 AS recid, {_OP} AS op, event_id % 3 AS arg, event_id % 2 AS expected,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
run(k, seq, recid, op, status, old, state, payload) AS (
  SELECT 0::BIGINT, 0::BIGINT, recid, '', '', NULL::BIGINT, 0, NULL::BIGINT FROM (SELECT DISTINCT recid FROM ops)
  UNION ALL
  SELECT k, seq, recid, op, status, payload,
    CASE WHEN status <> 'OK' THEN state WHEN op IN ('cad', 'delete') THEN 0 WHEN op = 'put' THEN 2 ELSE state END,
    CASE WHEN status <> 'OK' THEN payload WHEN op IN ('cad', 'delete') THEN NULL WHEN op IN ('update', 'cas', 'put') THEN arg ELSE payload END
  FROM (SELECT o.k, o.seq, o.recid, o.op, o.arg, r.state, r.payload,
    CASE WHEN o.op = 'put' THEN CASE WHEN r.state = 0 THEN 'OK' ELSE 'OCCUPIED' END WHEN r.state = 0 THEN 'NOT_FOUND'
      WHEN o.op IN ('cas', 'cad') AND r.payload IS DISTINCT FROM o.expected THEN 'MISMATCH' ELSE 'OK' END AS status
    FROM run r JOIN ops o ON o.recid = r.recid AND o.k = r.k + 1))
"""


@register(_FOLD + "SELECT seq, recid, op, status, old, payload AS new FROM run WHERE k > 0")
def store_cas_fold(spark: SparkSession, sf: str) -> DataFrame:
    empty = spark.createDataFrame([], "recid long, state int, payload long")
    return apply_ops(empty, _log(spark, sf))[1]


@register(_FOLD.replace("WHEN 'click' THEN 'cas'", "WHEN 'click' THEN 'cad'") + "SELECT recid, 2 AS state, last.payload FROM (SELECT recid, max_by(struct_pack(state, payload), k) AS last FROM run GROUP BY recid) WHERE last.state = 2")
def store_cad_fold(spark: SparkSession, sf: str) -> DataFrame:
    empty = spark.createDataFrame([], "recid long, state int, payload long")
    return apply_ops(empty, _log(spark, sf).withColumn("op", F.when(F.col("op") == "cas", "cad").otherwise(F.col("op"))))[0]


@register(_FOLD + "SELECT seq, recid, op, status, old, payload AS new FROM run WHERE k > 0")
def store_cas_fold_streamed(spark: SparkSession, sf: str) -> DataFrame:
    empty = spark.createDataFrame([], "recid long, state int, payload long")
    return apply_ops_streamed(empty, _log(spark, sf)).where("op <> 'end'")


_LIFE = "CASE event_type WHEN 'signup' THEN 'preallocate' WHEN 'purchase' THEN 'preallocate_put' WHEN 'click' THEN 'update' WHEN 'view' THEN 'get' ELSE 'delete' END"


@register(
    f"""
WITH RECURSIVE ops AS (SELECT event_id AS seq, user_id + 1 AS recid, {_LIFE} AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
run(k, seq, recid, op, status, state) AS (
  SELECT 0::BIGINT, 0::BIGINT, recid, '', '', 0 FROM (SELECT DISTINCT recid FROM ops)
  UNION ALL
  SELECT k, seq, recid, op, status, CASE WHEN status <> 'OK' THEN state WHEN op = 'delete' THEN 0 WHEN op = 'preallocate' THEN 1 WHEN op = 'preallocate_put' THEN 2 ELSE state END
  FROM (SELECT o.k, o.seq, o.recid, o.op, r.state, CASE WHEN o.op = 'preallocate_put' THEN CASE WHEN r.state = 1 THEN 'OK' ELSE 'NOT_PREALLOC' END
    WHEN o.op = 'preallocate' THEN CASE WHEN r.state = 0 THEN 'OK' ELSE 'OCCUPIED' END WHEN r.state = 0 THEN 'NOT_FOUND' WHEN r.state = 1 THEN 'PREALLOC' ELSE 'OK' END AS status
    FROM run r JOIN ops o ON o.recid = r.recid AND o.k = r.k + 1))
SELECT seq, recid, op, status FROM run WHERE k > 0"""
)
def store_prealloc_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    ops = _read(spark, sf, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") + 1).alias("recid"), F.expr(_LIFE).alias("op"), F.col("event_id").alias("arg"), F.lit(None).cast("long").alias("expected"))
    return apply_ops(spark.createDataFrame([], "recid long, state int, payload long"), ops)[1].select("seq", "recid", "op", "status")


# --- allocation

_CONTROL = "(SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'put' ELSE 'delete' END AS op, CASE event_type WHEN 'error' THEN event_id + 1 END AS recid FROM events WHERE event_type IN ('signup', 'error'))"
_BALANCE = f"""
WITH l AS (SELECT *, CASE op WHEN 'delete' THEN 1 ELSE -1 END AS d FROM {_CONTROL}), s AS (SELECT *, sum(d) OVER (ORDER BY seq) AS s FROM l),
f AS (SELECT *, s - least(0, min(s) OVER (ORDER BY seq)) AS free FROM s), g AS (SELECT *, op = 'put' AND coalesce(lag(free) OVER (ORDER BY seq), 0) = 0 AS fresh FROM f),
h AS (SELECT *, sum(fresh::INT) OVER (ORDER BY seq) AS nth_fresh FROM g)
"""


def _control(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "events").where(F.col("event_type").isin("signup", "error"))
    return rows.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "put").otherwise("delete").alias("op"), F.when(F.col("event_type") == "error", F.col("event_id") + 1).alias("recid"))


@register(
    _BALANCE
    + """SELECT seq, op, CAST(CASE WHEN op = 'delete' THEN recid WHEN fresh THEN 1000000 + nth_fresh ELSE
  (SELECT x.recid FROM h x WHERE x.op = 'delete' AND x.seq < h.seq AND x.free = h.free + 1 ORDER BY x.seq DESC LIMIT 1) END AS BIGINT) AS recid FROM h"""
)
def store_put_alloc_lifo(spark: SparkSession, sf: str) -> DataFrame:
    return alloc.allocate(_control(spark, sf), 1_000_000)


@register(
    _BALANCE
    + """, d AS (SELECT recid, row_number() OVER (ORDER BY seq) AS n FROM h WHERE op = 'delete'), p AS (SELECT seq, row_number() OVER (ORDER BY seq) AS n FROM h WHERE op = 'put' AND NOT fresh)
SELECT h.seq, h.op, CAST(CASE WHEN h.op = 'delete' THEN h.recid WHEN fresh THEN 1000000 + nth_fresh ELSE d.recid END AS BIGINT) AS recid FROM h LEFT JOIN p USING (seq) LEFT JOIN d USING (n)"""
)
def store_put_alloc_fifo(spark: SparkSession, sf: str) -> DataFrame:
    return alloc.allocate(_control(spark, sf), 1_000_000, first_freed=True)


@register(
    _BALANCE
    + """SELECT seq, CASE op WHEN 'delete' THEN 'push' ELSE 'pop' END AS op, CAST(CASE WHEN op = 'delete' THEN recid WHEN fresh THEN 0 ELSE
  (SELECT x.recid FROM h x WHERE x.op = 'delete' AND x.seq < h.seq AND x.free = h.free + 1 ORDER BY x.seq DESC LIMIT 1) END AS BIGINT) AS value FROM h"""
)
def stack_push_pop(spark: SparkSession, sf: str) -> DataFrame:
    log = _control(spark, sf).select("seq", F.when(F.col("op") == "put", "pop").otherwise("push").alias("op"), F.col("recid").alias("value"))
    return alloc.stack_pops(log)


# --- atomic records


def _deltas(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("name"), ((F.col("event_id") % 7 - 3) * 1_000_000_007).alias("delta"))


_WRAP32 = "CAST(CASE WHEN (({0}) % 4294967296 + 4294967296) % 4294967296 >= 2147483648 THEN (({0}) % 4294967296 + 4294967296) % 4294967296 - 4294967296 ELSE (({0}) % 4294967296 + 4294967296) % 4294967296 END AS INT)"
_SUM = "sum((event_id % 7 - 3) * 1000000007) OVER (PARTITION BY user_id ORDER BY event_id)"


@register(f"SELECT event_id AS seq, user_id AS name, (event_id % 7 - 3) * 1000000007 AS delta, CAST({_SUM} - (event_id % 7 - 3) * 1000000007 AS BIGINT) AS get_and_add, CAST({_SUM} AS BIGINT) AS add_and_get FROM events")
def atomic_long_add(spark: SparkSession, sf: str) -> DataFrame:
    return atomic.running_add(_deltas(spark, sf))


@register(
    f"SELECT seq, name, delta, {_WRAP32.format('s - delta')} AS get_and_add, {_WRAP32.format('s')} AS add_and_get FROM (SELECT event_id AS seq, user_id AS name, (event_id % 7 - 3) * 1000000007 AS delta, {_SUM} AS s FROM events)"
)
def atomic_int_add_wraps(spark: SparkSession, sf: str) -> DataFrame:
    return atomic.running_add(_deltas(spark, sf), bits=32)


@register(
    """SELECT event_id AS seq, user_id AS name, CASE event_type WHEN 'error' THEN -1 ELSE 1 END AS delta, CAST(s - CASE event_type WHEN 'error' THEN -1 ELSE 1 END AS BIGINT) AS get_and_add, CAST(s AS BIGINT) AS add_and_get
FROM (SELECT *, sum(CASE event_type WHEN 'error' THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events)"""
)
def atomic_inc_dec(spark: SparkSession, sf: str) -> DataFrame:
    return atomic.running_add(_read(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("name"), F.when(F.col("event_type") == "error", -1).otherwise(1).alias("delta")))


@register("SELECT event_id AS seq, user_id AS name, event_type AS value, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), '') AS old FROM events")
def atomic_get_and_set(spark: SparkSession, sf: str) -> DataFrame:
    ops = _read(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("name"), F.col("event_type").alias("value"))
    return atomic.get_and_set(ops, atomic.INITIAL["string"])


@register(
    """
WITH RECURSIVE ops AS (SELECT event_id AS seq, user_id AS name, event_id % 3 AS expected, (event_id * 7) % 3 + event_id % 2 AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
run(k, seq, name, swapped, value) AS (SELECT 0::BIGINT, 0::BIGINT, name, false, 0::BIGINT FROM (SELECT DISTINCT name FROM ops) UNION ALL
  SELECT o.k, o.seq, o.name, r.value = o.expected, CASE WHEN r.value = o.expected THEN o.value ELSE r.value END FROM run r JOIN ops o ON o.name = r.name AND o.k = r.k + 1)
SELECT seq, name, swapped, value FROM run WHERE k > 0"""
)
def atomic_cas(spark: SparkSession, sf: str) -> DataFrame:
    ops = _read(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("name"), (F.col("event_id") % 3).alias("expected"), (F.col("event_id") * 7 % 3 + F.col("event_id") % 2).alias("value"))
    return atomic.compare_and_set(ops, 0)[1]


@register(
    f"""SELECT event_id AS recid, CAST((event_id + 128) % 256 - 128 AS TINYINT) AS byte_value, CAST((event_id * 1000 + 32768) % 65536 - 32768 AS SMALLINT) AS short_value, {_WRAP32.format('event_id * 1000003')} AS int_value,
event_id AS long_value, CAST(event_id AS FLOAT) AS float_value, CAST(event_id AS DOUBLE) AS double_value, CAST(event_id AS VARCHAR) AS string_value FROM events"""
)
def atomic_numeric_views(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    views = atomic.numeric_views(e)
    views |= {"short_value": atomic.numeric_views(e * 1000)["short_value"], "int_value": atomic.numeric_views(e * 1000003)["int_value"]}
    return _read(spark, sf, "events").select(e.alias("recid"), *(v.alias(n) for n, v in views.items()))


# --- lists: each conversation's roles and turns; groups: each customer's sorted order keys

_LISTS = "(SELECT conv_id, list(role || turn ORDER BY turn) AS a FROM conversations GROUP BY conv_id)"
_GROUPS = "(SELECT o_custkey, list_sort(list(DISTINCT o_orderkey)) AS a FROM orders GROUP BY o_custkey)"
_TEXT = "array_to_string({}, ',')"


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda x: F.concat(x["role"], x["turn"].cast("string"))).alias("a"))


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderkey")).alias("a"))


def _text(a) -> object:  # noqa: ANN001
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


def _list_query(name: str, make, sql: str) -> None:  # noqa: ANN001
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _lists(spark, sf).select("conv_id", make(F.col("a")).alias("r"))

    QUERIES[name], ORACLES[name] = query, f"SELECT conv_id, {sql} AS r FROM {_LISTS}"


def _group_query(name: str, make, sql: str) -> None:  # noqa: ANN001
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _groups(spark, sf).select("o_custkey", make(F.col("a")).alias("r"))

    QUERIES[name], ORACLES[name] = query, f"SELECT o_custkey, {sql} AS r FROM {_GROUPS}"


_list_query("list_get", lambda a: c.get(a, 0), "a[1]")
_list_query("list_size", lambda a: F.size(a), "CAST(len(a) AS INT)")
_list_query("list_add", lambda a: _text(F.array_append(a, F.lit("x"))), _TEXT.format("list_append(a, 'x')"))
_list_query("list_insert", lambda a: _text(c.insert(a, 1, F.lit("x"))), _TEXT.format("a[:1] || ['x'] || a[2:]"))
_list_query("list_add_all", lambda a: _text(F.concat(a, F.reverse(a))), _TEXT.format("a || list_reverse(a)"))
_list_query("list_add_all_at", lambda a: _text(c.insert_all(a, 1, a)), _TEXT.format("a[:1] || a || a[2:]"))
_list_query("list_remove", lambda a: _text(c.remove(a, 0)), _TEXT.format("a[2:]"))
_list_query("list_remove_range", lambda a: _text(c.remove_range(a, 1, F.least(F.lit(3), F.size(a)))), _TEXT.format("a[:1] || a[4:]"))
_list_query("list_set", lambda a: _text(c.replace(a, 0, F.lit("x"))), _TEXT.format("['x'] || a[2:]"))
_list_query("list_index_of", lambda a: c.index_of(a, F.lit("assistant1")), "CAST(coalesce(list_position(a, 'assistant1'), 0) - 1 AS INT)")
_list_query("list_last_index_of", lambda a: c.last_index_of(a, F.lit("user2")), "CAST(CASE WHEN list_contains(a, 'user2') THEN len(a) - list_position(list_reverse(a), 'user2') ELSE -1 END AS INT)")
_list_query("list_sublist", lambda a: _text(c.sub_list(a, 1, F.least(F.lit(3), F.size(a)))), _TEXT.format("a[2:3]"))
_list_query("list_contains", lambda a: F.array_contains(a, "user2"), "list_contains(a, 'user2')")
_group_query("group_search", lambda a: c.search(a, F.element_at(a, 1) + 500), "CAST(CASE WHEN list_contains(a, a[1] + 500) THEN list_position(a, a[1] + 500) - 1 ELSE -(len(list_filter(a, lambda x: x < a[1] + 500)) + 1) END AS INT)")
_group_query("group_get", lambda a: c.get(a, F.size(a) - 1), "a[len(a)]")
_group_query("group_put", lambda a: _text(c.insert(a, F.size(a), F.lit(7))), _TEXT.format("list_append(a, 7)"))
_group_query("group_update", lambda a: _text(c.replace(a, F.size(a) - 1, F.lit(7))), _TEXT.format("list_append(a[:len(a) - 1], 7)"))
_group_query("group_delete", lambda a: _text(c.delete_before(a, 1)), _TEXT.format("a[2:]"))
_group_query("group_range", lambda a: _text(c.sub_list(a, 1, F.size(a))), _TEXT.format("a[2:]"))
_group_query("group_delta_encode", lambda a: _text(c.delta_encode(a)), _TEXT.format("list_transform(a, lambda x, i: CASE WHEN i = 1 THEN x ELSE x - a[i - 1] END)"))
_group_query("group_delta_decode", lambda a: _text(c.delta_decode(c.delta_encode(a))), _TEXT.format("a"))


@register("SELECT conv_id, posexplode.pos, posexplode.value FROM (SELECT conv_id, unnest(list_transform(a, lambda x, i: {'pos': CAST(i - 1 AS INT), 'value': x})) AS posexplode FROM " + _LISTS + ")")
def list_iterate(spark: SparkSession, sf: str) -> DataFrame:
    return _lists(spark, sf).select("conv_id", F.posexplode("a").alias("pos", "value"))


@register("WITH m AS (SELECT p_brand, min(p_name) AS a, max(p_name) AS b FROM part GROUP BY p_brand) SELECT p_brand, CAST((SELECT count(*) FROM range(1, 201) t(i) WHERE i <= least(length(a), length(b)) AND a[:i] = b[:i]) AS INT) AS prefix FROM m")
def group_common_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "part").groupBy("p_brand").agg(F.collect_set("p_name").alias("a")).select("p_brand", c.group_common_prefix(F.col("a")).alias("prefix"))


@register("SELECT doc_id, regexp_matches(text, '[^\\x00-\\x7F]') AS is_unicode FROM documents")
def group_is_unicode(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").select("doc_id", c.is_unicode(F.col("text")).alias("is_unicode"))


_group_query(
    "group_search_by",
    lambda a: c.search_by(F.reverse(a), F.element_at(a, 1) + 500, lambda x: -x),
    "CAST(CASE WHEN list_contains(a, a[1] + 500) THEN len(a) - list_position(a, a[1] + 500) ELSE -(len(list_filter(a, lambda x: x > a[1] + 500)) + 1) END AS INT)",
)
_group_query("group_size", lambda a: F.size(a), "CAST(len(a) AS INT)")
_group_query("group_next_value", lambda a: _text(c.next_value(F.transform(a, lambda x: x.cast("int")), (1 << 31) - 1)), _TEXT.format("list_append(a[:len(a) - 1], a[len(a)] + 1)"))
_STEP = "CASE WHEN ({0}) % 4294967296 >= 2147483648 THEN ({0}) % 4294967296 - 4294967296 ELSE ({0}) % 4294967296 END"
_group_query(
    "list_hash_code",
    lambda a: c.list_hash(F.transform(a, lambda x: x.cast("int"))),
    "CAST(list_reduce(list_prepend(1::BIGINT, a), lambda h, e: " + _STEP.format("(h * 31 + e + 1099511627776)") + ") AS INT)",
)


_list_query("list_removed_old", lambda a: c.removed(a, F.size(a) - 1)["old"], "a[len(a)]")
_list_query("list_replaced", lambda a: F.concat_ws(";", c.replaced(a, 0, F.lit("x"))["old"], _text(c.replaced(a, 0, F.lit("x"))["list"])), "a[1] || ';x' || CASE WHEN len(a) > 1 THEN ',' || array_to_string(a[2:], ',') ELSE '' END")
_list_query("list_in_bounds", lambda a: F.concat_ws(",", *(c.in_bounds(a, i).cast("string") for i in (-1, 0, 4))), "'false,true,' || CASE WHEN len(a) > 4 THEN 'true' ELSE 'false' END")
_list_query("list_remove_in_bounds", lambda a: F.when(c.in_bounds(a, 4), _text(c.remove(a, 4))), "CASE WHEN len(a) > 4 THEN array_to_string(a[:4] || a[6:], ',') END")
_list_query("list_clear_is_empty", lambda a: c.is_empty(c.clear(a)) & ~c.is_empty(a), "len(a) > 0")


@register(f"SELECT conv_id, array_to_string(a, ',') AS r FROM {_LISTS}")
def list_entries_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Lists as one row for each entry, and back."""
    return c.from_entries(c.entries(_lists(spark, sf), "conv_id", "a"), "conv_id").select("conv_id", _text(F.col("a")).alias("r"))


_PREFIX = "(SELECT p_brand, list_sort(list(DISTINCT p_name)) AS a FROM part GROUP BY p_brand)"
_SHARED = "CAST((SELECT count(*) FROM range(1, 201) t(i) WHERE i <= least(length(a[1]), length(a[len(a)])) AND a[1][:i] = a[len(a)][:i]) AS INT)"


@register(f"SELECT p_brand, a[1][:n] AS prefix, array_to_string(list_transform(a, lambda x: substr(x, n + 1)), ';') AS suffixes, array_to_string(a, ';') AS back FROM (SELECT *, {_SHARED} AS n FROM {_PREFIX})")
def group_prefix_encode(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_name")).alias("a")).select("p_brand", c.prefix_encode(F.col("a")).alias("e"))
    return rows.select("p_brand", "e.prefix", F.array_join("e.suffixes", ";").alias("suffixes"), F.array_join(c.prefix_decode(F.col("e")), ";").alias("back"))


@register(f"SELECT p_brand, hex(encode(a[1][:n])) AS prefix, array_to_string(list_transform(a, lambda x: hex(encode(substr(x, n + 1)))), ';') AS suffixes, array_to_string(a, ';') AS back FROM (SELECT *, {_SHARED} AS n FROM {_PREFIX})")
def group_bytes_prefix_encode(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_name")).alias("a"))
    rows = rows.select("p_brand", c.bytes_prefix_encode(F.transform("a", lambda x: F.encode(x, "UTF-8"))).alias("e"))
    back = F.transform(c.bytes_prefix_decode(F.col("e")), lambda x: F.decode(x, "UTF-8"))
    return rows.select("p_brand", F.hex("e.prefix").alias("prefix"), F.array_join(F.transform("e.suffixes", lambda x: F.hex(x)), ";").alias("suffixes"), F.array_join(back, ";").alias("back"))


_group_query(
    "group_array_delta",
    lambda a: F.concat_ws(
        ";",
        F.array_join(F.transform(c.array_delta_encode(F.transform(a, lambda x: F.array(F.floor(x / 5000), F.floor(x / 500), x))), lambda e: e["shared"].cast("string")), ","),
        F.array_join(F.flatten(c.array_delta_decode(c.array_delta_encode(F.transform(a, lambda x: F.array(F.floor(x / 5000), F.floor(x / 500), x))))).cast("array<string>"), ","),
    ),
    """array_to_string(list_transform(a, lambda x, i: CASE WHEN i = 1 OR x // 5000 <> a[i - 1] // 5000 THEN 0 WHEN x // 500 <> a[i - 1] // 500 THEN 1 ELSE 2 END), ',') || ';' ||
array_to_string(flatten(list_transform(a, lambda x: [x // 5000, x // 500, x])), ',')""",
)


# --- keyed tables: each user's last event against each customer's key


def _keyed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    have = _read(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return have, _read(spark, sf, "events").groupBy(F.col("user_id").alias("k")).agg(F.max("value").alias("v"))


_HAVE = "h AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 = 0), n AS (SELECT user_id AS k, max(value) AS v FROM events GROUP BY 1)"


@register(f"WITH {_HAVE} SELECT k, coalesce(n.v, h.v) AS v FROM h FULL JOIN n USING (k)")
def keyed_put(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.put(*_keyed(spark, sf))


@register(f"WITH {_HAVE} SELECT k, coalesce(h.v, n.v) AS v FROM h FULL JOIN n USING (k)")
def keyed_put_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.put_if_absent(*_keyed(spark, sf))


@register(f"WITH {_HAVE} SELECT k, coalesce(n.v, h.v) AS v FROM h LEFT JOIN n USING (k)")
def keyed_replace(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.replace(*_keyed(spark, sf))


@register(f"WITH {_HAVE} SELECT k, CASE WHEN k % 2 = 0 THEN coalesce(n.v, h.v) ELSE h.v END AS v FROM h LEFT JOIN n USING (k)")
def keyed_replace_if(spark: SparkSession, sf: str) -> DataFrame:
    have, new = _keyed(spark, sf)
    asked = new.join(have.select("k", F.when(F.col("k") % 2 == 0, F.col("v")).otherwise(F.lit(-1.0)).alias("expected")), "k")
    return keyed.replace_if(have, asked)


@register(f"WITH {_HAVE} SELECT k, h.v FROM h ANTI JOIN n USING (k)")
def keyed_remove(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.remove(*_keyed(spark, sf))


@register(f"WITH {_HAVE} SELECT k, h.v FROM h WHERE k % 2 <> 0 OR k NOT IN (SELECT k FROM n)")
def keyed_remove_if(spark: SparkSession, sf: str) -> DataFrame:
    have, new = _keyed(spark, sf)
    asked = have.where("k % 2 = 0").join(new.select("k"), "k", "left_semi").withColumnRenamed("v", "expected")
    return keyed.remove_if(have, asked)


@register(f"WITH {_HAVE} SELECT n.k, h.k IS NOT NULL AS found FROM n LEFT JOIN h USING (k)")
def keyed_contains_key(spark: SparkSession, sf: str) -> DataFrame:
    have, new = _keyed(spark, sf)
    return keyed.contains_key(have, new)


@register(f"WITH {_HAVE} SELECT k, coalesce(n.v, h.v) AS v FROM h FULL JOIN n USING (k)")
def keyed_put_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """All events of a user are put; the greatest value counts."""
    return keyed.put(_keyed(spark, sf)[0], _read(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("value").alias("v")))


# --- hashes, orders, bits

_WRAP64 = "CAST(CASE WHEN (({0}) % 18446744073709551616::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT >= 9223372036854775808::HUGEINT THEN (({0}) % 18446744073709551616::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT - 18446744073709551616::HUGEINT ELSE (({0}) % 18446744073709551616::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT END AS BIGINT)"
_MUL64 = _WRAP64.format("x::HUGEINT * -7046029254386353131")
_MUL32 = _WRAP32.format("x::BIGINT * -1640531527")


@register(f"SELECT recid, xor(h, h >> 16) AS hash FROM (SELECT recid, {_MUL32} AS h FROM (SELECT o_orderkey AS recid, (o_orderkey * 40503 - 30000000)::INT AS x FROM orders))")
def hash_int(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "orders").select(F.col("o_orderkey").alias("recid"), bits.int_hash((F.col("o_orderkey") * 40503 - 30000000).cast("int")).alias("hash"))


@register(f"SELECT recid, {_WRAP32.format('xor(g, g >> 16)')} AS hash FROM (SELECT recid, xor(h, h >> 32) AS g FROM (SELECT recid, {_MUL64} AS h FROM (SELECT o_orderkey AS recid, o_orderkey * 1000003 - 77 AS x FROM orders)))")
def hash_long(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "orders").select(F.col("o_orderkey").alias("recid"), bits.long_hash(F.col("o_orderkey") * 1000003 - 77).alias("hash"))




@register(
    f"""WITH h AS (SELECT l_orderkey, l_linenumber, {_WRAP32.format('l_orderkey::BIGINT * -1640531527')} AS p, {_WRAP32.format('l_linenumber::BIGINT * -1640531527')} AS q FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
g AS (SELECT l_orderkey, l_linenumber, xor(p, p >> 16)::BIGINT AS a, xor(q, q >> 16)::BIGINT AS b FROM h)
SELECT l_orderkey, l_linenumber, {_WRAP32.format('a * -1640531527 + b')} AS array_hash, {_WRAP32.format('a + b')} AS tuple_hash FROM g"""
)
def hash_array_and_tuple(spark: SparkSession, sf: str) -> DataFrame:
    """Array hash of two ints, and the hash of a tuple whose fields hash to themselves."""
    rows = _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    pair = F.array(F.col("l_orderkey").cast("int"), F.col("l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber", c.int_array_hash(pair).alias("array_hash"), c.tuple_hash(pair).alias("tuple_hash"))


@register(f"SELECT p_partkey, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda x: unicode(x)::BIGINT)), lambda h, e: {_WRAP32.format('(h + e) * -1640531527')}::BIGINT) AS INT) AS hash FROM part")
def hash_string(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "part").select("p_partkey", c.string_hash(F.col("p_name")).alias("hash"))


@register(f"SELECT o_orderkey, xor({_WRAP32.format('v >> 32')}, {_WRAP32.format('v')}) AS hash FROM (SELECT o_orderkey, xor(o_orderkey * 1000000007 - 77, o_custkey * -998244353) AS v FROM orders)")
def hash_uuid(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "orders").select("o_orderkey", c.uuid_hash(F.col("o_orderkey") * 1000000007 - 77, F.col("o_custkey") * -998244353).alias("hash"))


_LONG_HASH = f"(SELECT o_orderkey, k, {_WRAP32.format('xor(g, g >> 16)')}::BIGINT AS h FROM (SELECT o_orderkey, k, xor(h, h >> 32) AS g FROM (SELECT o_orderkey, k, {_MUL64} AS h FROM (SELECT o_orderkey, 1 AS k, o_orderkey AS x FROM orders UNION ALL SELECT o_orderkey, 2, o_custkey FROM orders))))"


@register(
    f"""WITH h AS (SELECT o_orderkey, max(h) FILTER (k = 1) AS a, max(h) FILTER (k = 2) AS b FROM {_LONG_HASH} GROUP BY 1)
SELECT o_orderkey, {_WRAP32.format('a * -1640531527 + b')} AS long_array, {_WRAP32.format(f"{_WRAP32.format('(2::BIGINT * -1640531527 + a)')}::BIGINT * -1640531527 + b")} AS object_array FROM h"""
)
def hash_long_and_object_array(spark: SparkSession, sf: str) -> DataFrame:
    pair = F.array("o_orderkey", "o_custkey")
    return _read(spark, sf, "orders").select("o_orderkey", c.long_array_hash(pair).alias("long_array"), c.object_array_hash(F.transform(pair, bits.long_hash)).alias("object_array"))


@register(
    f"""SELECT vec_id, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(embedding, lambda x: {_WRAP32.format('xor(x::DOUBLE::BIT::BIGINT, x::DOUBLE::BIT::BIGINT >> 32)')}::BIGINT)),
  lambda h, e: {_WRAP32.format('h * -1640531527 + e')}::BIGINT) AS INT) AS hash FROM embeddings"""
)
def hash_double_array(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "embeddings").select("vec_id", double_array_hash(F.col("embedding").cast("array<double>")).alias("hash"))


@register("SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY x, z, c_custkey) AS INT) AS n FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN 0 WHEN c_custkey % 5 = 1 THEN 'NaN'::DOUBLE ELSE c_acctbal END AS x, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE 1 END AS z FROM customer)")
def order_float(spark: SparkSession, sf: str) -> DataFrame:
    """Balances, some of them zeros of either sign or not a number, in the order of doubles."""
    k = F.col("c_custkey")
    x = F.when(k % 10 == 0, F.lit(-0.0)).when(k % 5 == 0, F.lit(0.0)).when(k % 5 == 1, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    return _read(spark, sf, "customer").select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(order.float_key(x), k)).alias("n"))


@register("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey % 5 - 2) * 2305843009213693952, o_orderkey * -7) AS INT) AS n FROM orders")
def order_uuid(spark: SparkSession, sf: str) -> DataFrame:
    """Signed halves: half of all first halves are negative."""
    half = (F.col("o_orderkey") % 5 - 2) * (1 << 61)
    return _read(spark, sf, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(order.uuid_key(half, F.col("o_orderkey") * -7))).alias("n"))


@register("SELECT l_linenumber, CAST(count(DISTINCT (CAST(l_quantity AS BIGINT) * CASE WHEN l_orderkey % 2 = 0 THEN 10 ELSE 1 END, l_orderkey % 2)) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def order_decimal(spark: SparkSession, sf: str) -> DataFrame:
    """1.0 and 1 are different decimals."""
    even = F.col("l_orderkey") % 2 == 0
    key = order.decimal_key(F.col("l_quantity").cast("long") * F.when(even, 10).otherwise(1), F.when(even, 1).otherwise(0))
    return _read(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.count_distinct(key).alias("n"))


@register(
    """SELECT o_orderkey, upper(printf('%016x', o_orderkey * 7)) AS long_bytes, upper(printf('%08x', o_custkey)) AS int_bytes, CASE WHEN o_orderkey % 2 = 0 THEN '01' ELSE '00' END AS flag, hex(encode(o_orderpriority)) AS text,
o_orderkey = o_custkey AS same FROM orders"""
)
def types_serialize(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _read(spark, sf, "orders").select(
        k,
        F.hex(types.serialize(k * 7, "long")).alias("long_bytes"),
        F.hex(types.serialize(F.col("o_custkey"), "integer")).alias("int_bytes"),
        F.hex(types.serialize(k % 2 == 0, "boolean")).alias("flag"),
        F.hex(types.serialize(F.col("o_orderpriority"), "string")).alias("text"),
        types.binary_equal(k, F.col("o_custkey"), "long").alias("same"),
    )


@register("SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id) AS n FROM events")
def order_tuple(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "events").select("event_type", "user_id", F.row_number().over(Window.partitionBy("event_type").orderBy(F.struct("user_id", "event_id"))).alias("n"))


@register("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY (event_id % 5 = 0), CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 4 END, event_id) AS INT) AS n FROM events")
def order_null_last(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's arrays (x, id), of which a null x is greatest, in order."""
    x = F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 4)
    key = order.null_last_key(F.array(x, F.col("event_id")))
    return _read(spark, sf, "events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(key)).alias("n"))


_KEY = "(o_orderkey * 4096)"


@register(
    f"""SELECT o_orderkey, {_KEY} | ((bit_count({_KEY}) + 1) % 2) AS p1, {_KEY} | ((bit_count({_KEY}) + 1) % 8) AS p3, {_KEY} | ((bit_count({_KEY}) + 1) % 16) AS p4, {_KEY} AS back, (bit_count({_KEY} | 1) % 2 = 1) AS ok FROM orders"""
)
def bits_parity(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey") * 4096
    return _read(spark, sf, "orders").select(
        "o_orderkey", *(bits.parity_set(key, n).alias(f"p{n}") for n in (1, 3, 4)), bits.parity_get(bits.parity_set(key, 4), 4).alias("back"), bits.parity_ok(key.bitwiseOR(F.lit(1)), 1).alias("ok")
    )


@register(
    f"""SELECT o_orderkey, x | (CASE WHEN h < 0 THEN h + 4294967296 ELSE h END & 65535) AS p16 FROM (SELECT o_orderkey, k AS x, {_WRAP32.format('xor(g, g >> 16)')}::BIGINT AS h FROM
(SELECT o_orderkey, k, xor(h, h >> 32) AS g FROM (SELECT o_orderkey, k, {_MUL64} AS h FROM (SELECT o_orderkey, o_orderkey * 65536 AS k, o_orderkey * 65536 + 1 AS x FROM orders))))"""
)
def bits_parity16(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "orders").select("o_orderkey", bits.parity_set(F.col("o_orderkey") * 65536, 16).alias("p16"))


@register(
    """SELECT o_orderkey, CAST(length(bin(o_orderkey + 1)) - 1 AS INT) AS log2, CASE WHEN o_orderkey < 1 THEN 1::BIGINT ELSE 1::BIGINT << length(bin(o_orderkey)) END AS pow2,
(o_orderkey + 99) // 100 * 100 AS up, o_orderkey - o_orderkey % 100 AS down, (1::BIGINT << (o_orderkey % 60)::INT) - 1 AS low FROM orders"""
)
def bits_pow2_round(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("o_orderkey")
    return _read(spark, sf, "orders").select("o_orderkey", bits.floor_log2(x + 1).alias("log2"), bits.next_pow2(x + 1).alias("pow2"), bits.round_up(x, 100).alias("up"), bits.round_down(x, 100).alias("down"), bits.fill_low_bits(x % 60).alias("low"))


@register(
    """SELECT o_orderkey, CAST(greatest(1, (length(bin(k)) + 6) // 7) AS INT) AS size, upper(array_to_string(list_transform(range(greatest(1, (length(bin(k)) + 6) // 7) - 1, -1, -1),
  lambda i: printf('%02x', ((k >> (i * 7)::INT) & 127) + CASE WHEN i = 0 THEN 128 ELSE 0 END)), '')) AS packed, k AS unpacked FROM (SELECT o_orderkey, o_orderkey * 12345 AS k FROM orders)"""
)
def bits_varint(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") * 12345
    rows = _read(spark, sf, "orders").select("o_orderkey", bits.packed_size(k).alias("size"), bits.pack(k).alias("packed"))
    return rows.withColumn("unpacked", bits.unpack(F.col("packed")))


@register("SELECT o_orderkey, upper(printf('%012x', o_orderkey * 7)) AS six, o_orderkey * 7 AS back, upper(printf('%08x', o_orderkey)) AS int_bytes, upper(hex(o_orderpriority)) AS hexed, o_orderpriority AS unhexed FROM orders")
def bits_hex_six_long(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("o_orderkey")
    rows = _read(spark, sf, "orders").select("o_orderkey", bits.six_bytes(x * 7).alias("six"), bits.big_endian(x, 4).alias("int_bytes"), bits.to_hex(F.col("o_orderpriority")).alias("hexed"))
    return rows.withColumn("back", bits.from_six_bytes(F.col("six"))).withColumn("unhexed", bits.from_hex(F.col("hexed")).cast("string"))


@register(
    """SELECT o_orderkey, (2::BIGINT << 56) | ((o_orderkey % 1000) << 40) | o_orderkey AS slot, 2 AS kind, CAST(o_orderkey % 1000 AS INT) AS size, o_orderkey AS page, (o_orderkey * 2) | ((bit_count(o_orderkey * 2) + 1) % 2) AS recid,
o_orderkey AS unpacked, CASE WHEN o_orderkey % 2 = 0 THEN 4294967295 - o_orderkey ELSE o_orderkey END AS widened FROM orders"""
)
def bits_slots_and_recids(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("o_orderkey")
    rows = _read(spark, sf, "orders").select("o_orderkey", bits.slot(F.lit(2), x % 1000, x).alias("slot"), bits.pack_recid(x).alias("recid"), bits.unsigned(F.when(x % 2 == 0, -1 - x).otherwise(x).cast("int")).alias("widened"))
    kind, size, page = bits.slot_parts(F.col("slot"))
    return rows.select("*", kind.alias("kind"), size.alias("size"), page.alias("page"), bits.unpack_recid(F.col("recid")).alias("unpacked"))


@register(
    """WITH a AS (SELECT x, xor(x, xor(x >> 20, x >> 12)) AS h FROM (SELECT o_orderkey AS x FROM orders)), b AS (SELECT x, xor(h, xor(h >> 7, h >> 4)) AS h FROM a)
SELECT bit_or(x | h) AS checksum FROM b"""
)
def bits_header_checksum(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "orders").agg(bits.header_checksum(F.col("o_orderkey"), F.lit(0).cast("long")).alias("checksum"))


