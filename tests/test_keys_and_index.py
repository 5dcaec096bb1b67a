"""Key encodings, tids, pages and the index contract."""

import math
import random
import struct
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import errors as E
from palimpsest.functions import keys as K
from palimpsest.functions.types import TYPES, Field
from palimpsest.operators import versions as V
from palimpsest.operators.catalog import SYSTEM_TABLES
from palimpsest.operators.index import KeyIndex
from palimpsest.sources import pages
from palimpsest.sources.relation import RelationStore

FIELDS = [Field("kBool", "BOOLEAN"), Field("kInt", "INTEGER"), Field("kStr", "VARCHAR"), Field("kDbl", "DOUBLE")]
SCHEMA = "kBool boolean, kInt int, kStr string, kDbl double, tid long"
BASE = (True, 4, "Jovan123!!", 3.56)
INDEX = KeyIndex(FIELDS)


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA).coalesce(1)


def got(df, *key):
    return [r.tid for r in INDEX.get(df, *key).collect()]


def test_lookups(spark):
    assert got(entries(spark), *BASE) == []
    e = entries(spark, (*BASE, 1000), (False, 7, "Alice", 8.9, 101), (True, 12, "Bob", 1.2, 102), (True, 4, "", 0.0, 42), (True, -(2**31), "x", 1.0, 500), (True, 2**31 - 1, "x", 1.0, 501), (True, 0, "café", 1.0, 77), (True, 1, "STRASSE", 1.0, 78), (*BASE, 3))
    assert got(e, *BASE) == [3, 1000]
    assert got(e, False, 7, "Alice", 8.9) == [101]
    for near in ((False, *BASE[1:]), (True, 5, *BASE[2:]), (True, 4, "Jovan123!?", 3.56), (*BASE[:3], 3.57), (True, 4, "Jovan", 3.56)):
        assert got(e, *near) == []
    assert got(e, True, 4, "", -0.0) == [42]
    assert got(e, True, -(2**31), "x", 1.0) == [500] and got(e, True, 2**31 - 1, "x", 1.0) == [501]
    assert got(e, True, 0, "café", 1.0) == [77]
    assert got(e, True, 1, "straße", 1.0) == [78]


def test_delete_and_reinsert(spark):
    e = entries(spark, (*BASE, 1), (*BASE, 2), (True, 5, "b", 1.0, 3), (True, 6, "c", 1.0, 4))
    left = INDEX.delete(e, entries(spark, (True, 4, "JOVAN123!!", 3.56, 1), (True, 5, "b", 1.0, 99)))
    assert got(left, *BASE) == [2] and got(left, True, 5, "b", 1.0) == [3] and left.count() == 3
    assert got(INDEX.insert(left, entries(spark, (*BASE, 9))), *BASE) == [2, 9]


def test_bulk_and_shared_prefixes(spark):
    made = spark.range(20000).select((F.col("id") % 2 == 0).alias("kBool"), F.col("id").cast("int").alias("kInt"), F.format_string("k_%08d", "id").alias("kStr"), (F.col("id") * 1.5).alias("kDbl"), (F.col("id") + 10000).alias("tid"))
    made = made.orderBy(F.rand(0xD7))
    for i in (0, 7, 19999):
        assert got(made, i % 2 == 0, i, f"k_{i:08d}", i * 1.5) == [10000 + i]
    assert INDEX.violations(made).isEmpty()
    first = INDEX.ordered(made.where("kInt < 50")).collect()
    want = sorted((i % 2 == 0, i) for i in range(50))
    assert [(r.kBool, r.kInt) for r in first] == want


def test_unique_insert_and_targets(spark):
    key = KeyIndex([Field("k", "VARCHAR")], True)
    start, me = 100, 100
    owners = spark.createDataFrame([("live", 1, "I", 50), ("gone", 2, "D", 50), ("late", 3, "D", 150), ("mine", 4, "D", me + V.OPEN), ("open", 5, "I", 7 + V.OPEN), ("opendel", 6, "D", 7 + V.OPEN), ("base", 7, None, None), ("two", 8, "D", 50), ("two", 9, "I", 60)], "k string, tid long, op string, stamp long")
    for k, free in (("gone", True), ("mine", True), ("new", True), ("live", False), ("LIVE", False), ("late", False), ("open", False), ("opendel", False), ("base", False), ("two", False)):
        c = spark.createDataFrame([(k, 99)], "k string, tid long")
        if free:
            key.insert_unique(owners, c, start, me)
        else:
            with pytest.raises(E.UniqueViolation):
                key.insert_unique(owners, c, start, me)
    with pytest.raises(E.UniqueViolation):
        key.insert_unique(owners, spark.createDataFrame([("a", 1), ("A", 2)], "k string, tid long"), start, me)
    assert key.pick_for_modify(owners, start, me, "live") == 1
    assert key.pick_for_modify(owners, start, me, "base") == 7
    assert key.pick_for_modify(owners, start, me, "two") == 9
    assert key.pick_for_modify(owners, start, me, "gone") is None
    assert key.pick_for_modify(owners, start, me, "absent") is None
    with pytest.raises(E.WriteConflict):
        key.pick_for_modify(owners, start, me, "open")


def test_encodings_sort_like_values(spark):
    rng = random.Random(3)
    ints = [-(2**63), -(2**31), -1, 0, 1, 2**31 - 1, 2**63 - 1] + [rng.randrange(-(2**63), 2**63) for _ in range(50)]
    rows = spark.createDataFrame([(i,) for i in ints], "x long").select("x", K.encode_signed(F.col("x"), 8).alias("k")).orderBy("k").collect()
    assert [r.x for r in rows] == sorted(ints)
    small = spark.createDataFrame([(i,) for i in (-(2**31), -5, 0, 9, 2**31 - 1)], "x int").select(F.hex(K.encode_signed(F.col("x"), 4)).alias("k")).collect()
    assert [r.k for r in small] == ["00000000", "7FFFFFFB", "80000000", "80000009", "FFFFFFFF"]
    big = spark.createDataFrame([("0",), ("18446744073709551615",), ("9223372036854775808",)], "s string").select(F.hex(K.encode(F.col("s").cast("decimal(20,0)"), "UBIGINT")).alias("k")).collect()
    assert [r.k for r in big] == ["0" * 16, "F" * 16, "8" + "0" * 15]
    texts = ["a", "ab", "", "B", "b", "Straße", "strasse", "café", "café"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", K.encode_text(F.col("t")).alias("k")).collect()
    assert {r.t: bytes(r.k) for r in rows} == {t: K.fold_text(t).encode() + b"\x00" for t in texts}
    nulls = spark.createDataFrame([(1,), (None,), (-1,)], "x int").orderBy(K.encode_nullable(F.col("x"), "INTEGER")).collect()
    assert [r.x for r in nulls] == [None, -1, 1]


@settings(max_examples=300, deadline=None)
@given(st.floats(), st.floats())
def test_double_key_order(a, b):
    ka, kb = K.double_key(a), K.double_key(b)
    if math.isnan(a) or math.isnan(b):
        assert (ka == kb) == (math.isnan(a) and math.isnan(b)) and (ka > kb or not math.isnan(a) or math.isnan(b))
    else:
        assert (ka < kb) == (a < b) and (ka == kb) == (a == b)
        assert len(ka) == 8 and struct.calcsize(">d") == 8


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_fold_is_canonical(s):
    assert K.fold_text(unicodedata.normalize("NFC", s)) == K.fold_text(unicodedata.normalize("NFD", s))
    assert K.fold_text(K.fold_text(s)) == unicodedata.normalize("NFD", K.fold_text(s).casefold())


def plain_mix(x, bits):
    a, b, c, f, g = (33, 33, 33, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53) if bits == 64 else (16, 13, 16, 0x85EBCA6B, 0xC2B2AE35)
    m = (1 << bits) - 1
    x &= m
    x = (x ^ x >> a) * f & m
    x = (x ^ x >> b) * g & m
    return x ^ x >> c


def test_scalars(spark):
    r = spark.createDataFrame([(3, 9)], "p long, s long").select(K.pack_tid(F.col("p"), F.col("s")).alias("t")).select("t", K.tid_page(F.col("t")).alias("p"), K.tid_slot(F.col("t")).alias("s"), K.tid_of_key(K.encode_unsigned(F.col("t"), 8)).alias("b"), K.byte_swap(F.lit(0x0102), 2).alias("w")).first()
    assert tuple(r) == ((3 << 32) | 9, 3, 9, (3 << 32) | 9, "0201")
    assert K.key_size(FIELDS) == 1 + 4 + 52 + 8 + 8
    assert (K.align_up(5, 4), K.align_down(7, 4)) == (8, 4)
    xs = [0, 1, 2, -1, 1 << 62, -(1 << 63), 12345678901234567]
    got = spark.createDataFrame([(x,) for x in xs], "x long").select("x", K.mix64(F.col("x")).alias("m"), K.mix32(F.col("x")).alias("n")).collect()
    assert [(r.m % (1 << 64), r.n) for r in got] == [(plain_mix(r.x, 64), plain_mix(r.x, 32)) for r in got]
    assert next(r.n for r in got if r.x == 1) == 0x514E28B7
    assert sum(t.width for t in TYPES.values()) == 1 + 15 + 15 + 8 + 32


def test_pages_of_system_tables():
    want = {"pg_database": (20, 405, 40, 204), "pg_namespace": (20, 405, 40, 204), "pg_class": (41, 198, 88, 93), "pg_attribute": (31, 262, 80, 102), "pg_index": (16, 507, 88, 93), "pg_type": (28, 290, 72, 113), "pg_constraint": (40, 203, 112, 73), "pg_language": (34, 239, 88, 93), "pg_proc": (173, 46, 320, 25)}
    for name, fields in SYSTEM_TABLES.items():
        layout, chunk = pages.page_layout(fields), pages.row_chunk_bytes(fields)
        assert (layout.row_bytes, layout.max_rows, chunk, pages.rows_per_page(chunk)) == want[name]
        assert layout.column_offsets[-1] + layout.max_rows * TYPES[fields[-1].type].width <= pages.PAGE_BYTES


def test_numbered_without_one_task(spark, tmp_path):
    def write(df):
        df.write.mode("overwrite").parquet(str(tmp_path / "n"))
        return spark.read.parquet(str(tmp_path / "n"))

    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(5)
    assert all(r.x + 1 == r.ordinal for r in pages.numbered(df, "x", scratch=write).collect())


def test_relation_store(spark, tmp_path):
    store = RelationStore(spark, str(tmp_path / "r"))
    df = spark.range(3)
    assert store.list() == [] and not store.exists("a")
    store.create("a", df.schema)
    with pytest.raises(E.DuplicateTable):
        store.create("a", df.schema)
    store.extend("a", df)
    assert store.open("a").count() == 3 and store.list() == ["a"]
    store.drop("a")
    for f in (lambda: store.open("a"), lambda: store.drop("a"), lambda: store.extend("a", df)):
        with pytest.raises(E.UndefinedTable):
            f()


def test_stream_of_a_log(spark, tmp_path):
    from palimpsest.operators.table import VersionedTable
    from palimpsest.operators.transactions import Engine
    from palimpsest.streaming.tail import tail

    engine = Engine(spark, str(tmp_path))
    t = VersionedTable(engine, "kv", [Field("k", "INTEGER")])
    with engine.begin() as txn:
        t.insert(txn, spark.createDataFrame([(1,), (2,)], "k int"))
    q = tail(t).writeStream.format("memory").queryName("tailed").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.k for r in spark.sql("select payload.k from tailed").collect()) == [1, 2]


def test_ranges_equal_key_bytes(spark):
    """Bounds by columns pick what bounds by encoded bytes pick, nulls and NaN included."""
    fields = [Field("a", "DOUBLE", 0, True), Field("b", "VARCHAR", 0, True), Field("c", "INTEGER")]
    values = [(a, b, c) for a in (None, -1.5, -0.0, 0.0, 2.0, float("nan")) for b in (None, "", "a", "A", "é", "b") for c in (-1, 3)]
    entries = spark.createDataFrame([(*v, i) for i, v in enumerate(values)], "a double, b string, c int, tid long")
    keyed = {r.tid: bytes(r.k) for r in entries.select("tid", K.composite(fields).alias("k")).collect()}
    index = KeyIndex(fields)
    for low, high in [(5, 40), (0, 71), (30, 30), (13, 12), (66, 70)]:
        got = [r.tid for r in index.range(entries, values[low], values[high]).collect()]
        assert sorted(got) == sorted(t for t, k in keyed.items() if keyed[low] <= k <= keyed[high])
        assert [keyed[t] for t in got] == sorted(keyed[t] for t in got)
    assert [r.tid for r in index.ordered(entries).collect()] == sorted(keyed, key=lambda t: (keyed[t], t))


def test_bounds_reach_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id as k", "id as tid", "'x' as other").write.parquet(f"{tmp_path}/e")
    found = KeyIndex([Field("k", "BIGINT")]).range(spark.read.parquet(f"{tmp_path}/e").select("k", "tid"), (5,), (9,))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,5)" in plan and "LessThanOrEqual(k,9)" in plan and "other" not in plan and "Python" not in plan
    assert [r.k for r in found.collect()] == [5, 6, 7, 8, 9]
