"""Named queries over the driver's tables, each with DuckDB SQL for the same rows.

Histories come from ``events``: a user is a tuple, its events are operations in the order of
(ts, event_id), and an accepted operation commits at its event_id. Entries named ``ext_`` are
extensions, what Spark gives on top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import keys as K
from palimpsest.functions.types import TYPE_OIDS, TYPES, Field
from palimpsest.operators import versions as V
from palimpsest.operators.catalog import SYSTEM_TABLES
from palimpsest.operators.index import KeyIndex, folded_columns
from palimpsest.plans.registry import once, query, table
from palimpsest.sources import pages
from palimpsest.sources.scratch import scratch

# --- index: lookups, duplicates, uniqueness, deletion ---

ORDER_KEY = [Field("o_orderkey", "BIGINT"), Field("o_orderpriority", "VARCHAR")]
LINE_KEY = [Field("l_orderkey", "BIGINT"), Field("l_linenumber", "INTEGER")]
LINE_COLUMNS = "l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()


@query(
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderkey = 7 AND lower(o_orderpriority) = (SELECT lower(o_orderpriority) FROM orders WHERE o_orderkey = 7)"""
)
def index_point_get(spark, sf_dir):
    """Equality on the whole composite key, then a projection; the number reaches the scan."""
    orders = table(spark, sf_dir, "orders")
    own = orders.where("o_orderkey = 7").select("o_orderpriority").first()
    return KeyIndex(ORDER_KEY).matching(orders, 7, own[0].upper() if own else None).select("o_orderkey", "o_custkey", "o_totalprice")


#: Rows that agree up to the flag are alike in all that a query takes of ``lines``, tids apart.
LINE_ORDER = LINE_COLUMNS[: LINE_COLUMNS.index("l_returnflag") + 1]


@once
def lines(spark, sf_dir) -> DataFrame:
    """Keys, flags and tids of lineitem: rows are numbered in the order of all columns, and stored,
    once. The columns after the flag settle no order that shows and stay unread."""
    keep = ["l_orderkey", "l_linenumber", "l_returnflag"]
    return pages.numbered(table(spark, sf_dir, "lineitem").select(*LINE_ORDER), *LINE_ORDER, scratch=scratch(spark), name="tid", keep=keep)


_LINES = f"(SELECT *, row_number() OVER (ORDER BY {', '.join(c + ' NULLS FIRST' for c in LINE_COLUMNS)}) AS tid FROM lineitem)"


@query(f"SELECT l_orderkey, l_linenumber, tid FROM {_LINES} QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1")
def index_get_duplicates(spark, sf_dir):
    """Every tid of keys that several rows have."""
    entries = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "tid")
    twice = KeyIndex(LINE_KEY).violations(entries)
    return entries.join(twice.drop("owners"), ["l_orderkey", "l_linenumber"], "left_semi")


@query(f"SELECT tid FROM {_LINES} WHERE l_linenumber = 1 AND l_orderkey = (SELECT min(l_orderkey) FROM lineitem WHERE l_linenumber = 1)")
def index_get(spark, sf_dir):
    """The tids of one whole key, through the index."""
    entries = lines(spark, sf_dir)
    return KeyIndex(LINE_KEY).get(entries, entries.where("l_linenumber = 1").agg(F.min("l_orderkey")).first()[0], 1)


@query(f"SELECT l_orderkey, l_linenumber, count(*) AS entries, min(tid) AS first_tid FROM {_LINES} GROUP BY ALL")
def index_insert(spark, sf_dir):
    """Entries of one load after another: those of equal keys accumulate."""
    rows = lines(spark, sf_dir)
    index = KeyIndex(LINE_KEY)
    entries = index.insert(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag <> 'R'"))
    return entries.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("entries"), F.min("tid").alias("first_tid"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS owners FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def index_unique_violations(spark, sf_dir):
    return KeyIndex(LINE_KEY, True).violations(table(spark, sf_dir, "lineitem"))


@query(
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber > 2),
e AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 4)
SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.l_orderkey = c.l_orderkey AND e.l_linenumber = c.l_linenumber)
AND (SELECT count(*) FROM c AS d WHERE d.l_orderkey = c.l_orderkey AND d.l_linenumber = c.l_linenumber) = 1"""
)
def unique_insert_check(spark, sf_dir):
    """Candidates whose key is neither owned nor repeated among them."""
    line = table(spark, sf_dir, "lineitem")
    owned = line.where("l_linenumber <= 4").select("l_orderkey", "l_linenumber")
    new = line.where("l_linenumber > 2").select("l_orderkey", "l_linenumber", "l_quantity")
    return KeyIndex(LINE_KEY, True).insertable(owned, new)


@query(f"SELECT l_orderkey, l_linenumber, tid FROM {_LINES} WHERE NOT (l_returnflag = 'R' AND tid % 2 = 0)")
def index_delete_entry(spark, sf_dir):
    """Deletes single (key, tid) entries; duplicates of their keys stay."""
    entries = lines(spark, sf_dir)
    gone = entries.where("l_returnflag = 'R' and tid % 2 = 0")
    return KeyIndex(LINE_KEY).delete(entries.select("l_orderkey", "l_linenumber", "tid"), gone)


# --- keys ---


@query("SELECT p_partkey, p_size, printf('%08X', p_size::BIGINT + 2147483648) AS k FROM part")
def key_encode_int(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.hex(K.encode_signed(F.col("p_size"), 4)).alias("k"))


@query("SELECT c_custkey, printf('%016X', ((c_custkey - 500)::HUGEINT + 9223372036854775808)::UBIGINT) AS k FROM customer")
def key_encode_bigint(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.hex(K.encode_signed(F.col("c_custkey") - 500, 8)).alias("k"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_totalprice, o_orderkey) AS place FROM orders")
def key_order_equivalence(spark, sf_dir):
    """The places of rows in the order of their key bytes are those by value."""
    fields = [Field("o_custkey", "BIGINT"), Field("o_totalprice", "DOUBLE"), Field("o_orderkey", "BIGINT")]
    keyed = table(spark, sf_dir, "orders").select(K.composite(fields).alias("k"), "o_orderkey")
    return pages.numbered(keyed, "k", scratch=scratch(spark), name="place").select("o_orderkey", "place")


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS place FROM orders")
def index_order(spark, sf_dir):
    """Entries in the index's own order."""
    entries = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("tid"))
    placed = pages.numbered_from(KeyIndex([Field("o_custkey", "BIGINT")]).ordered(entries), scratch=scratch(spark), name="place")[0]
    return placed.drop("tid")


@query("SELECT o_orderkey, printf('%08X', o_custkey) AS k4, printf('%016X', o_custkey) AS k8, printf('%02X', o_orderkey % 256) AS k1 FROM orders")
def key_encode_unsigned(spark, sf_dir):
    c = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.hex(K.encode_unsigned(c, 4)).alias("k4"), F.hex(K.encode_unsigned(c, 8)).alias("k8"), F.hex(K.encode_unsigned(F.col("o_orderkey") % 256, 1)).alias("k1"))


@query("SELECT p_partkey, hex(lower(p_brand)) || '00' AS k, CASE WHEN p_size % 3 = 0 THEN '00' ELSE '01' || hex(lower(p_type)) || '00' END AS nullable_k FROM part")
def key_encode_text(spark, sf_dir):
    """Folded text and its end, and the byte that tells null from not null."""
    kind = F.when(F.col("p_size") % 3 != 0, F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.hex(K.encode_text(F.col("p_brand"))).alias("k"), F.hex(K.encode_nullable(kind, "VARCHAR")).alias("nullable_k"))


@query("SELECT o_orderkey, list_aggregate(list_reverse(regexp_extract_all(printf('%016X', o_orderkey), '..')), 'string_agg', '') AS swapped, list_aggregate(list_reverse(regexp_extract_all(printf('%08X', o_custkey), '..')), 'string_agg', '') AS swapped4 FROM orders")
def byte_swaps(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", K.byte_swap(F.col("o_orderkey"), 8).alias("swapped"), K.byte_swap(F.col("o_custkey"), 4).alias("swapped4"))


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_orderkey::HUGEINT * 1000003 + l_linenumber AS x FROM lineitem),
c AS (SELECT *, xor(x, x >> 33) AS y FROM a),
d AS (SELECT *, (y * 3981806797::HUGEINT + (y * 4283543511::HUGEINT % 4294967296) * 4294967296) % 18446744073709551616::HUGEINT AS z FROM c),
e AS (SELECT *, xor(z, z >> 33) AS y2 FROM d),
f AS (SELECT *, (y2 * 444984403::HUGEINT + (y2 * 3301882366::HUGEINT % 4294967296) * 4294967296) % 18446744073709551616::HUGEINT AS z2 FROM e),
g AS (SELECT *, xor(z2, z2 >> 33) AS m FROM f)
SELECT l_orderkey, l_linenumber, printf('%016X', m::UBIGINT) AS mixed FROM g"""
)
def murmur_mix64(spark, sf_dir):
    """The 64-bit finalizer, bit for bit."""
    x = F.col("l_orderkey") * 1000003 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lpad(F.hex(K.mix64(x)), 16, "0").alias("mixed"))


@query(
    """WITH a AS (SELECT o_orderkey, o_custkey::UBIGINT AS x FROM orders),
b AS (SELECT *, (xor(x, x >> 16)::HUGEINT * 2246822507 % 4294967296)::UBIGINT AS y FROM a),
c AS (SELECT *, (xor(y, y >> 13)::HUGEINT * 3266489909 % 4294967296)::UBIGINT AS z FROM b)
SELECT o_orderkey, xor(z, z >> 16)::BIGINT AS mixed FROM c"""
)
def murmur_mix32(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", K.mix32(F.col("o_custkey")).alias("mixed"))


@query("SELECT o_orderkey, (ceil(o_custkey / 8) * 8)::BIGINT AS up, (floor(o_custkey / 8) * 8)::BIGINT AS down FROM orders")
def alignments(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", K.align_up(F.col("o_custkey"), 8).alias("up"), K.align_down(F.col("o_custkey"), 8).alias("down"))


@query(
    """SELECT * FROM (VALUES ('BOOLEAN', 1, 1), ('TINYINT', 1, 2), ('SMALLINT', 2, 3), ('INTEGER', 4, 4), ('BIGINT', 8, 5), ('UTINYINT', 1, 6), ('USMALLINT', 2, 7),
('UINTEGER', 4, 8), ('UBIGINT', 8, 9), ('DOUBLE', 8, 10), ('VARCHAR', 16, 11), ('VARBINARY', 16, 12)) t(name, width, oid)"""
)
def type_widths(spark, sf_dir):
    return spark.createDataFrame([(t.name, t.width, TYPE_OIDS[t.name]) for t in TYPES.values()], "name string, width int, oid int")


@query("SELECT nfc_normalize(lower(p_type)) AS folded, count(*) AS n FROM part GROUP BY 1")
def text_key_fold(spark, sf_dir):
    folded = folded_columns([Field("p_type", "VARCHAR")])[0]
    return table(spark, sf_dir, "part").groupBy(folded.alias("folded")).agg(F.count("*").alias("n"))


_DOUBLES = "(VALUES (1, '-Infinity'::DOUBLE), (2, -2.5), (3, -0.0), (4, 0.0), (5, 1e-300), (6, 3.56), (7, 'Infinity'::DOUBLE), (8, 'NaN'::DOUBLE)) t(id, x)"


@query(f"SELECT id::BIGINT AS id, dense_rank() OVER (ORDER BY x)::BIGINT AS place FROM {_DOUBLES}")
def double_key_order(spark, sf_dir):
    """Both zeros share a key; NaN comes after infinity."""
    from pyspark.sql import Window

    rows = spark.createDataFrame([(1, float("-inf")), (2, -2.5), (3, -0.0), (4, 0.0), (5, 1e-300), (6, 3.56), (7, float("inf")), (8, float("nan"))], "id long, x double")
    return rows.withColumn("k", K.encode_double(F.col("x"))).select("id", F.dense_rank().over(Window.orderBy("k")).cast("bigint").alias("place"))


@query("SELECT l_orderkey, l_linenumber, (l_orderkey << 32) | l_linenumber AS tid, l_orderkey AS page, l_linenumber::BIGINT AS slot FROM lineitem")
def tid_pack_unpack(spark, sf_dir):
    packed = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", K.pack_tid(F.col("l_orderkey"), F.col("l_linenumber")).alias("tid"))
    key = K.encode_unsigned(F.col("tid"), 8)
    back = K.tid_of_key(key)
    return packed.select("l_orderkey", "l_linenumber", "tid", K.tid_page(back).alias("page"), K.tid_slot(back).alias("slot"))


# --- pages ---

_ORDER_FIELDS = [Field("o_orderkey", "BIGINT"), Field("o_custkey", "BIGINT"), Field("o_orderstatus", "VARCHAR"), Field("o_totalprice", "DOUBLE")]
_PER_PAGE = pages.rows_per_page(pages.row_chunk_bytes(_ORDER_FIELDS))


@query(
    f"""SELECT o_orderkey, ((n - 1) // {_PER_PAGE} + 1)::BIGINT AS page, ((n - 1) % {_PER_PAGE})::BIGINT AS slot
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)"""
)
def fsm_page_assign(spark, sf_dir):
    """The page and slot of each order, inserted in key order."""
    placed = pages.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", scratch=scratch(spark))
    tid = pages.tid_of(F.col("ordinal"), _PER_PAGE)
    return placed.select("o_orderkey", K.tid_page(tid).alias("page"), K.tid_slot(tid).alias("slot"))


@query(
    """WITH t(name, widths) AS (VALUES ('pg_database', [4,16]), ('pg_namespace', [4,16]), ('pg_class', [4,16,4,1,16]), ('pg_attribute', [4,4,16,4,2,1]),
('pg_index', [4,4,1,1,1,1,1,1,1,1]), ('pg_type', [4,16,4,2,1,1]), ('pg_constraint', [4,16,4,1,1,1,1,4,4,4]), ('pg_language', [4,16,1,1,4,4,4]),
('pg_proc', [4,16,4,4,8,8,4,1,1,1,1,1,2,2,4,16,16,16,16,16,16,16]))
SELECT name, list_sum(widths)::BIGINT AS row_bytes, ((8192 - 4 - (list_sum(widths) - len(widths))) * 8 // (1 + 8 * list_sum(widths)))::BIGINT AS max_rows,
(8188 // (ceil(list_reduce([8 + 6 * len(widths)] || widths, lambda a, w: (ceil(a / least(w, 8)) * least(w, 8))::BIGINT + w) / 8) * 8)::BIGINT)::BIGINT AS rows_per_page FROM t"""
)
def pax_capacity(spark, sf_dir):
    made = [(n, pages.page_layout(f).row_bytes, pages.page_layout(f).max_rows, pages.rows_per_page(pages.row_chunk_bytes(f))) for n, f in SYSTEM_TABLES.items()]
    return spark.createDataFrame(made, "name string, row_bytes long, max_rows long, rows_per_page long")


_LINE_FIELDS = [Field("l_orderkey", "BIGINT"), Field("l_linenumber", "INTEGER"), Field("l_quantity", "DOUBLE"), Field("l_returnflag", "VARCHAR")]
_LINES_PER_PAGE = pages.page_layout(_LINE_FIELDS).max_rows


@query(
    f"""SELECT tid, (tid - 1) // {_LINES_PER_PAGE} AS page, (4 + (tid - 1) % {_LINES_PER_PAGE} // 8)::BIGINT AS byte, ((tid - 1) % {_LINES_PER_PAGE} % 8)::BIGINT AS bit
FROM {_LINES} WHERE l_returnflag = 'R'"""
)
def tombstone_bits(spark, sf_dir):
    """Where the tombstone of each returned line lies in its page."""
    place = F.col("tid") - 1
    byte, bit = pages.tombstone(F.pmod(place, F.lit(_LINES_PER_PAGE)))
    return lines(spark, sf_dir).where("l_returnflag = 'R'").select("tid", F.floor(place / _LINES_PER_PAGE).alias("page"), byte.alias("byte"), bit.alias("bit"))


# --- versions ---

_OP = "CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END"
_HISTORY = f"""
ops AS (SELECT event_id, ts, user_id, value, props, {_OP} AS op FROM events),
judged AS (SELECT *, last_value(CASE WHEN op IN ('I', 'D') THEN op END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ops),
log AS (SELECT *, event_id AS commit_ts FROM judged WHERE (op = 'I') <> coalesce(before = 'I', false)),
cut AS (SELECT max(event_id) // 2 AS s FROM events)"""


def operations(spark, sf_dir) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", V.INSERT).when(F.col("event_type") == "error", V.DELETE).otherwise(V.UPDATE)
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", "props", op.alias("op"))


def history(spark, sf_dir) -> tuple[DataFrame, int]:
    """The log of accepted operations, and a stamp in the middle of it."""
    ops = operations(spark, sf_dir)
    kept = V.accepted(ops, "user_id", "ts", "event_id").where("ok")
    # a click changes the value alone, other updates both columns
    both = F.array(F.lit("value"), F.lit("props"))
    log = kept.select(
        F.col("user_id").alias("tid"), "op", F.lit(1).cast("long").alias("seq"), F.col("event_id").alias("txn_id"), F.col("event_id").alias("commit_ts"),
        F.when(F.col("op") == V.DELETE, F.array().cast("array<string>")).when((F.col("op") == V.UPDATE) & (F.col("event_id") % 2 == 0), F.array(F.lit("value"))).otherwise(both).alias("set_cols"),
        F.struct("value", "props").alias("payload"),
    )
    middle = (ops.agg(F.max("event_id")).first()[0] or 0) // 2
    return log, middle


_FOLD = """
seen AS (SELECT * FROM log, cut WHERE commit_ts <= s),
folded AS (SELECT user_id AS tid, arg_max(op, commit_ts) AS head,
  arg_max({'v': value}, commit_ts) FILTER (WHERE op <> 'D') AS value,
  arg_max({'v': props}, commit_ts) FILTER (WHERE op = 'I' OR (op = 'U' AND event_id % 2 = 1)) AS props FROM seen GROUP BY user_id)"""


@query(
    f"""WITH {_HISTORY} SELECT event_type, CASE WHEN (op = 'I') <> coalesce(before = 'I', false) THEN 'ok' WHEN op = 'I' THEN 'insert_live' ELSE 'modify_absent' END AS outcome,
count(*) AS n FROM judged JOIN events USING (event_id) GROUP BY 1, 2"""
)
def dml_outcomes(spark, sf_dir):
    """Operations that are accepted, and those that find the row live or absent."""
    judged = V.accepted(operations(spark, sf_dir), "user_id", "ts", "event_id")
    kind = table(spark, sf_dir, "events").select("event_id", "event_type")
    outcome = F.when(F.col("ok"), "ok").when(F.col("op") == V.INSERT, "insert_live").otherwise("modify_absent")
    return judged.select("event_id", outcome.alias("outcome")).join(kind, "event_id").groupBy("event_type", "outcome").agg(F.count("*").alias("n"))


@query(f"WITH {_HISTORY}, {_FOLD} SELECT tid FROM folded WHERE head <> 'D'")
def snapshot_read_asof(spark, sf_dir):
    log, middle = history(spark, sf_dir)
    return V.fold(log, ["value"], middle).select("tid")


@query(f"WITH {_HISTORY}, {_FOLD} SELECT tid, value.v AS value, props.v AS props FROM folded WHERE head <> 'D'")
def snapshot_delta_merge(spark, sf_dir):
    """Each row's columns at the last operation that set them."""
    log, middle = history(spark, sf_dir)
    return V.fold(log, ["value", "props"], middle)


@query(
    f"""WITH {_HISTORY} SELECT user_id AS tid, CASE WHEN arg_max(op, commit_ts) FILTER (WHERE commit_ts <= s) IS NULL THEN 'NotVisible'
WHEN arg_max(op, commit_ts) FILTER (WHERE commit_ts <= s) = 'D' THEN 'Deleted' ELSE 'Visible' END AS status FROM log, cut GROUP BY user_id"""
)
def snapshot_row_status(spark, sf_dir):
    log, middle = history(spark, sf_dir)
    return V.row_status(log, middle)


@query(f"WITH {_HISTORY} SELECT user_id AS tid, max(commit_ts) AS deleted_at FROM log GROUP BY user_id HAVING arg_max(op, commit_ts) = 'D'")
def delete_tombstone_filter(spark, sf_dir):
    """Tuples whose newest version is a deletion."""
    log, _ = history(spark, sf_dir)
    return V.heads(log).where(F.col("op") == V.DELETE).select("tid", F.col("stamp").alias("deleted_at"))


def own_rows(spark, sf_dir, log: DataFrame, me: int) -> DataFrame:
    """Uncommitted updates of one transaction to every third live user."""
    users = log.where(F.col("tid") % 3 == 0).select("tid").distinct()
    return users.select("tid", F.lit("U").alias("op"), F.lit(1).cast("long").alias("seq"), F.lit(me).cast("long").alias("txn_id"), F.lit(None).cast("long").alias("commit_ts"), F.array(F.lit("value")).alias("set_cols"), F.struct(F.lit(-1.0).alias("value"), F.lit(None).cast("string").alias("props")).alias("payload"))


@query(f"WITH {_HISTORY}, {_FOLD} SELECT tid, CASE WHEN tid % 3 = 0 THEN -1.0 ELSE value.v END AS value, props.v AS props FROM folded WHERE head <> 'D'")
def own_writes_visible(spark, sf_dir):
    """The writer sees its own uncommitted updates of live rows, and nobody else's."""
    log, middle = history(spark, sf_dir)
    me = 1 << 40
    live = V.fold(log, ["value"], middle).select("tid")
    mine = own_rows(spark, sf_dir, log, me).join(live, "tid", "left_semi")
    others = own_rows(spark, sf_dir, log, me + 1)
    return V.fold(log.unionByName(mine).unionByName(others), ["value", "props"], middle, me)


@query(
    f"""WITH {_HISTORY}, heads AS (SELECT user_id AS tid, arg_max(op, event_id) AS op, max(event_id) AS stamp FROM log GROUP BY user_id)
SELECT tid, CASE WHEN tid % 5 = 0 THEN 'open' WHEN tid % 7 = 0 THEN 'own' ELSE 'committed' END AS writer,
CASE WHEN tid % 5 = 0 THEN true WHEN tid % 7 = 0 THEN false ELSE stamp > s END AS conflict FROM heads, cut"""
)
def write_conflicts(spark, sf_dir):
    """For each tuple, whether its newest version keeps a transaction from the middle from
    writing: it is another's and open, its own, or committed before or since."""
    log, middle = history(spark, sf_dir)
    me = 1 << 40
    tid = F.col("tid")
    stamp = F.when(tid % 5 == 0, F.lit(me + 1 + V.OPEN)).when(tid % 7 == 0, F.lit(me + V.OPEN)).otherwise(F.col("stamp"))
    writer = F.when(tid % 5 == 0, "open").when(tid % 7 == 0, "own").otherwise("committed")
    return V.heads(log).select("tid", writer.alias("writer"), V.conflicts(stamp, middle, me).alias("conflict"))


@query(
    f"""WITH {_HISTORY}, heads AS (SELECT user_id AS tid, user_id % 20 AS k, arg_max(op, event_id) AS op, max(event_id) AS stamp FROM log GROUP BY user_id),
verdicts AS (SELECT k, tid, stamp > s + s // 2 AS conflict, op FROM heads, cut)
SELECT k, min(tid) AS tid, arg_min(conflict, tid) AS conflict FROM verdicts WHERE conflict OR op <> 'D' GROUP BY k"""
)
def tid_for_modify(spark, sf_dir):
    """For each key of several owners, the first live tid, and whether one up to it conflicts."""
    log, middle = history(spark, sf_dir)
    owners = V.heads(log).withColumn("k", F.col("tid") % 20)
    return KeyIndex([Field("k", "BIGINT")]).target_for_modify(owners, middle + middle // 2, 1 << 40)


@query(
    """WITH t AS (SELECT o_orderkey AS txn, o_custkey AS k, o_orderkey AS start_ts, o_orderkey + 200 AS end_ts FROM orders)
SELECT a.txn, a.k FROM t a WHERE EXISTS (SELECT 1 FROM t b WHERE b.k = a.k AND b.start_ts < a.start_ts AND b.end_ts > a.start_ts)"""
)
def first_updater_wins(spark, sf_dir):
    """Of transactions that overlap on a key, those that another had written first: the latest
    earlier end of the key tells, without laying the key's rows against each other."""
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("txn"), F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("start_ts"), (F.col("o_orderkey") + 200).alias("end_ts"))
    return V.earlier(t, "k", ["start_ts"], F.col("end_ts"), "max", "before").where("before > start_ts").select("txn", "k")


@query(f"WITH {_HISTORY} SELECT user_id AS tid, arg_max(op, commit_ts) = 'D' AS free FROM log, cut WHERE commit_ts <= s GROUP BY user_id")
def unique_key_free(spark, sf_dir):
    """Whether each key's owner leaves it free for a transaction of the middle."""
    log, middle = history(spark, sf_dir)
    owners = V.heads(log.where(F.col("commit_ts") <= middle))
    return KeyIndex([Field("tid", "BIGINT")], True).key_states(owners, middle, 1 << 40)


@query(f"WITH {_HISTORY} SELECT user_id AS k, user_id + 1000000 AS tid FROM log, cut GROUP BY user_id HAVING arg_max(op, commit_ts) = 'D' AND max(commit_ts) <= max(s) + max(s) // 2")
def insert_unique_rows(spark, sf_dir):
    """New entries for keys whose owner was deleted before the transaction began."""
    log, middle = history(spark, sf_dir)
    start = middle + middle // 2
    owners = V.heads(log).withColumnRenamed("tid", "k")
    index = KeyIndex([Field("k", "BIGINT")], True)
    free = index.key_states(owners, start, 1 << 40).where("free")
    return index.insert_unique(owners, free.select("k", (F.col("k") + 1000000).alias("tid")), start, 1 << 40)


# --- extensions ---


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 199")
def ext_index_range(spark, sf_dir):
    """Range scan of an index; the bounds reach the Parquet scan."""
    entries = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderkey").alias("tid"))
    return KeyIndex([Field("o_orderkey", "BIGINT")]).range(entries, (100,), (199,)).select("o_orderkey", "o_totalprice")


@query(f"WITH {_HISTORY}, {_FOLD} SELECT event_type, count(*) AS n, count(DISTINCT tid) AS users FROM folded JOIN events ON user_id = tid WHERE head <> 'D' GROUP BY event_type")
def ext_snapshot_join_aggregate(spark, sf_dir):
    """A snapshot composes with joins and aggregates."""
    log, middle = history(spark, sf_dir)
    live = V.fold(log, ["value"], middle)
    events = table(spark, sf_dir, "events").select("user_id", "event_type")
    return live.join(events, live.tid == events.user_id).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("tid").alias("users"))
