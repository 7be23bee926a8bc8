"""Queries over the test tables, each with SQL that gives the same rows. Every one really encodes and decodes."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .custom import CustomType, as_text
from .errors import ContainerError, SchemaError
from .functions import avro_to_json, decode_avro, decode_json, decode_many, decode_soe, encode_avro, encode_json, encode_soe, evolve, is_soe, json_to_avro, read_versions, soe_fingerprint, soe_payload, try_decode_avro
from .functions import logical as L
from .functions.codec import decode_errors, rabin64
from .functions.sql import register_schema
from .plans.mapping import schema_for, schema_from_struct
from .plans.resolve import compatibility_table
from .plans.schema import PRIMITIVES, Registry, build, parse
from .sources import append_file, metadata, read_ocf, write_ocf
from .sources.container import register_codec

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def record(name: str, *fields: tuple) -> str:
    """The JSON of a record; a field is (name, type) or (name, type, attributes)."""
    return json.dumps({"type": "record", "name": name, "fields": [{"name": f[0], "type": f[1]} | (f[2] if len(f) > 2 else {}) for f in fields]})


def trip(df: DataFrame, schema: str, reader: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """df's rows encoded and decoded again, as the reader has them."""
    raw = df.select(encode_avro(F.struct(*df.columns), schema).alias("b"))
    return raw.select(decode_avro("b", schema, reader, columns).alias("v")).select("v.*")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, which driver and executors share; where it is unset, a temporary one on one machine,
    an error on a cluster."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ContainerError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/rowweave/{name}-{uuid.uuid4().hex}"


cents = lambda c: F.round(F.col(c) * 100).cast("long")
NULLABLE = lambda t: ["null", t]

# round trips

LINEITEM = record("Lineitem", ("l_orderkey", "long"), ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_quantity", "double"), ("price_cents", "long"), ("l_shipdate", NULLABLE({"type": "long", "logicalType": "local-timestamp-micros"})))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS revenue_cents, count(*) AS n FROM lineitem GROUP BY ALL")
def rt_lineitem_revenue(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_quantity", cents("l_extendedprice").alias("price_cents"), "l_shipdate")
    out = trip(df, LINEITEM, columns=["l_returnflag", "l_linestatus", "l_quantity", "price_cents"])
    return out.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"), F.sum("price_cents").alias("revenue_cents"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) AS o_us, o_orderpriority FROM orders")
def rt_orders_full(spark, d):
    df = table(spark, d, "orders")
    out = trip(df, schema_from_struct(df.schema, "Orders"))
    return out.withColumn("o_us", L.timestamp_to_micros("o_orderdate")).drop("o_orderdate").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_us", "o_orderpriority")


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def rt_nullable_labels(spark, d):
    df = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return trip(df, record("L", ("doc_id", "long"), ("quality", NULLABLE("int")), ("toxic", NULLABLE("int"))))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS t FROM events")
def rt_nullsecond_union(spark, d):
    df = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("t"))
    return trip(df, record("E", ("event_id", "long"), ("t", ["string", "null"])))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id END AS n, CASE WHEN event_id % 3 = 1 THEN event_type END AS s, CASE WHEN event_id % 3 = 2 THEN value END AS x FROM events")
def rt_multi_union(spark, d):
    k = F.col("event_id") % 3
    u = F.struct(F.when(k == 0, F.col("user_id")).alias("member0"), F.when(k == 1, F.col("event_type")).alias("member1"), F.when(k == 2, F.col("value")).alias("member2"))
    out = trip(table(spark, d, "events").select("event_id", u.alias("u")), record("E", ("event_id", "long"), ("u", ["long", "null", "string", "double"])))
    return out.select("event_id", F.col("u.member0").alias("n"), F.col("u.member1").alias("s"), F.col("u.member2").alias("x"))


@query("SELECT vec_id, len(embedding) AS n, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[len(embedding)] AS DOUBLE) AS last, label FROM embeddings")
def rt_array_embeddings(spark, d):
    out = trip(table(spark, d, "embeddings"), record("V", ("vec_id", "long"), ("embedding", {"type": "array", "items": "float"}), ("label", "int")))
    return out.select("vec_id", F.size("embedding").cast("long").alias("n"), F.col("embedding")[0].cast("double").alias("first"), F.element_at("embedding", -1).cast("double").alias("last"), "label")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def rt_map_event_counts(spark, d):
    df = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return trip(df, record("U", ("user_id", "long"), ("m", {"type": "map", "values": "long"}))).select("user_id", F.explode("m").alias("event_type", "n"))


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def rt_nested_orders(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("lines"))
    df = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "lines")
    line = json.loads(record("Line", ("l_linenumber", "int"), ("l_quantity", "double")))
    out = trip(df, record("O", ("o_orderkey", "long"), ("lines", {"type": "array", "items": line})))
    return out.select("o_orderkey", F.inline("lines"))


EVENT_TYPES = ["signup", "purchase", "view", "click", "error"]
EVENT_ENUM = {"type": "enum", "name": "Kind", "symbols": EVENT_TYPES}


@query("SELECT event_id, event_type, list_position(['signup','purchase','view','click','error'], event_type) - 1 AS ordinal FROM events")
def rt_enum_event_type(spark, d):
    schema = record("E", ("event_id", "long"), ("event_type", EVENT_ENUM))
    df = table(spark, d, "events").select("event_id", "event_type")
    raw = df.select(encode_avro(F.struct("*"), schema).alias("b"))
    out = raw.select(decode_avro("b", schema).alias("v"), decode_avro("b", record("E", ("event_id", "long"), ("event_type", "int")), columns=["event_type"]).alias("o"))  # an enum is written as an int
    return out.select("v.event_id", "v.event_type", F.col("o.event_type").alias("ordinal"))


@query("SELECT doc_id, md5(text) AS h FROM documents")
def rt_fixed_md5(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.unhex(F.md5("text")).alias("h"))
    return trip(df, record("D", ("doc_id", "long"), ("h", {"type": "fixed", "name": "MD5", "size": 16}))).select("doc_id", F.lower(F.hex("h")).alias("h"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n, md5(text) AS h FROM documents")
def rt_utf8_documents(spark, d):
    out = trip(table(spark, d, "documents").select("doc_id", "text"), record("D", ("doc_id", "long"), ("text", "string")))
    return out.select("doc_id", F.octet_length("text").cast("long").alias("n"), F.md5("text").alias("h"))


@query("SELECT page_id, CAST(strlen(html) AS BIGINT) AS n, md5(html) AS h FROM pages")
def rt_bytes_pages(spark, d):
    out = trip(table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("html")), record("P", ("page_id", "long"), ("html", "bytes")))
    return out.select("page_id", F.octet_length("html").cast("long").alias("n"), F.md5("html").alias("h"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def rt_customer(spark, d):
    df = table(spark, d, "customer")
    return trip(df, schema_from_struct(df.schema, "Customer"))


@query("SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def rt_conversations(spark, d):
    turn = json.loads(record("Turn", ("turn", "long"), ("role", "string"), ("text", "string")))
    df = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    out = trip(df, record("C", ("conv_id", "long"), ("turns", {"type": "array", "items": turn})))
    return out.select("conv_id", F.size("turns").cast("long").alias("turns"), F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + F.length(t["text"])).alias("chars"))


# numbers and sizes

_Z = "CASE WHEN k >= 0 THEN 2 * k ELSE -2 * k - 1 END"
_LEN = " ".join(f"WHEN z < {1 << 7 * n} THEN {n}" for n in range(1, 9))


@query(f"SELECT CAST(CASE {_LEN} ELSE 9 END AS INTEGER) AS n_bytes, count(*) AS n FROM (SELECT {_Z} AS z FROM (SELECT o_orderkey - 5000 AS k FROM orders)) GROUP BY ALL")
def varint_len_hist(spark, d):
    k = table(spark, d, "orders").select((F.col("o_orderkey") - 5000).alias("k"))
    return k.select(F.octet_length(encode_avro("k", '"long"')).alias("n_bytes")).groupBy("n_bytes").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, (o_orderkey - 5000) * 977 AS k, true AS same FROM orders")
def decode_varint_hex(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") - 5000) * 977).alias("k"))
    raw = df.select("o_orderkey", encode_avro("k", '"long"').alias("b"), L.varint("k").alias("native"))
    return raw.select("o_orderkey", decode_avro("native", '"long"').alias("k"), (F.col("b") == F.col("native")).alias("same"))


@query(f"SELECT l_returnflag, CAST(sum(1 + 1 + 8 + CASE {_LEN} ELSE 9 END) AS BIGINT) AS n_bytes FROM (SELECT l_returnflag, 2 * l_orderkey AS z FROM lineitem) GROUP BY ALL")
def encoded_size_by_flag(spark, d):
    schema = record("L", ("l_orderkey", "long"), ("l_returnflag", "string"), ("l_quantity", "double"))
    df = table(spark, d, "lineitem").select("l_returnflag", F.octet_length(encode_avro(F.struct("l_orderkey", "l_returnflag", "l_quantity"), schema)).alias("n"))
    return df.groupBy("l_returnflag").agg(F.sum("n").cast("long").alias("n_bytes"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def skip_projection(spark, d):
    df = table(spark, d, "orders")
    return trip(df, schema_from_struct(df.schema, "Orders"), columns=["o_orderpriority"]).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_orderkey")
def decode_many_explode(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", encode_avro("l_linenumber", '"int"').alias("b"))
    df = df.groupBy("l_orderkey").agg(F.unhex(F.array_join(F.collect_list(F.hex("b")), "")).alias("b"))
    out = df.select("l_orderkey", F.explode(decode_many("b", '"int"')).alias("x"))
    return out.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("x").cast("long").alias("s"))


@query("SELECT event_id, event_id % 5 <> 0 AS good FROM events")
def try_decode_bad(spark, d):
    schema = record("E", ("event_id", "long"), ("event_type", "string"))
    raw = table(spark, d, "events").select("event_id", encode_avro(F.struct("event_id", "event_type"), schema).alias("b"))
    raw = raw.withColumn("b", F.when(F.col("event_id") % 5 == 0, F.substring("b", 1, 2)).otherwise(F.col("b")))
    return raw.select("event_id", try_decode_avro("b", schema).isNotNull().alias("good"))


# evolution

_W = record("User", ("user_id", "long"), ("event_type", "string"), ("value", "double"))


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value")


@query("SELECT user_id, event_type, value, 'none' AS region FROM events")
def resolve_add_default(spark, d):
    return trip(_events(spark, d).drop("event_id"), _W, record("User", ("user_id", "long"), ("event_type", "string"), ("value", "double"), ("region", "string", {"default": "none"})))


@query("SELECT value, user_id FROM events")
def resolve_drop_reorder(spark, d):
    return trip(_events(spark, d).drop("event_id"), _W, record("User", ("value", "double"), ("user_id", "long")))


@query("SELECT user_id AS uid, event_type AS kind FROM events")
def resolve_rename_alias(spark, d):
    return trip(_events(spark, d).drop("event_id"), _W, record("User", ("uid", "long", {"aliases": ["user_id"]}), ("kind", "string", {"aliases": ["event_type"]})))


@query("SELECT user_id, CAST(NULL AS VARCHAR) AS note FROM events")
def resolve_nullable_default(spark, d):
    return trip(_events(spark, d).drop("event_id"), _W, record("User", ("user_id", "long"), ("note", NULLABLE("string"))))


def _promotion(name: str, written: str, wanted: str, sql: str, value=lambda: F.col("event_id").cast("int"), shown=lambda c: c):
    def run(spark, d):
        df = table(spark, d, "events").select("event_id", value().alias("x"))
        out = trip(df, record("P", ("event_id", "long"), ("x", written)), record("P", ("event_id", "long"), ("x", wanted)))
        return out.select("event_id", shown(F.col("x")).alias("x"))

    run.__name__ = name
    query(f"SELECT event_id, {sql} AS x FROM events")(run)


_promotion("resolve_promote_int_long", "int", "long", "CAST(event_id AS BIGINT)")
_promotion("resolve_promote_int_float", "int", "float", "CAST(CAST(event_id AS FLOAT) AS DOUBLE)", shown=lambda c: c.cast("double"))
_promotion("resolve_promote_int_double", "int", "double", "CAST(event_id AS DOUBLE)")
_promotion("resolve_promote_long_float", "long", "float", "CAST(CAST(event_id * 1000003 AS FLOAT) AS DOUBLE)", lambda: F.col("event_id") * 1000003, lambda c: c.cast("double"))
_promotion("resolve_promote_long_double", "long", "double", "CAST(event_id * 1000003 AS DOUBLE)", lambda: F.col("event_id") * 1000003)
_promotion("resolve_promote_float_double", "float", "double", "CAST(CAST(value AS FLOAT) AS DOUBLE)", lambda: F.col("value").cast("float"))
_promotion("resolve_promote_string_bytes", "string", "bytes", "hex(encode(event_type))", lambda: F.col("event_type"), F.hex)
_promotion("resolve_promote_bytes_string", "bytes", "string", "event_type", lambda: F.encode("event_type", "UTF-8"))


@query("SELECT event_id, CASE WHEN event_type IN ('error', 'click') THEN 'view' ELSE event_type END AS event_type FROM events")
def resolve_enum_default(spark, d):
    fewer = {"type": "enum", "name": "Kind", "symbols": ["view", "signup", "purchase"], "default": "view"}
    return trip(_events(spark, d).select("event_id", "event_type"), record("E", ("event_id", "long"), ("event_type", EVENT_ENUM)), record("E", ("event_id", "long"), ("event_type", fewer)))


@query("SELECT user_id, CAST(sum(event_id) AS DOUBLE) AS s, count(*) AS n FROM events GROUP BY user_id")
def resolve_array_items(spark, d):
    df = table(spark, d, "events").groupBy("user_id").agg(F.collect_list("event_id").alias("a"))
    out = trip(df, record("A", ("user_id", "long"), ("a", {"type": "array", "items": "long"})), record("A", ("user_id", "long"), ("a", {"type": "array", "items": "double"})))
    return out.select("user_id", F.aggregate("a", F.lit(0.0), lambda x, y: x + y).alias("s"), F.size("a").cast("long").alias("n"))


@query("SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def resolve_map_values(spark, d):
    df = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("int").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    m = lambda v: record("M", ("user_id", "long"), ("m", {"type": "map", "values": v}))
    return trip(df, m("int"), m("long")).select("user_id", F.explode("m").alias("event_type", "n"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS INTEGER) END AS small, CASE WHEN event_id % 2 <> 0 THEN event_id * 4000000000 END AS large FROM events")
def rt_union_by_value(spark, d):
    """A plain column in a union: each value takes the first branch that it fits."""
    df = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_id")).otherwise(F.col("event_id") * 4000000000).alias("u"))
    return trip(df, record("E", ("event_id", "long"), ("u", ["null", "int", "string", "long"]))).select("event_id", F.col("u.member0").alias("small"), F.col("u.member2").alias("large"))


@query("SELECT event_id, event_id % 1000 AS n, CAST(NULL AS DOUBLE) AS x FROM events")
def resolve_union_reader(spark, d):
    df = table(spark, d, "events").select("event_id", (F.col("event_id") % 1000).cast("int").alias("u"))
    out = trip(df, record("E", ("event_id", "long"), ("u", "int")), record("E", ("event_id", "long"), ("u", ["long", "double"])))
    return out.select("event_id", F.col("u.member0").alias("n"), F.col("u.member1").alias("x"))


@query("SELECT event_id, CAST(event_id % 1000 AS DOUBLE) + CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 0 END AS x FROM events")
def resolve_union_writer(spark, d):
    n, even = (F.col("event_id") % 1000).cast("int"), F.col("event_id") % 2 == 0
    u = F.struct(F.when(~even, n).alias("member0"), F.when(even, (n + 0.5).cast("float")).alias("member1"))
    df = table(spark, d, "events").select("event_id", u.alias("u"))
    return trip(df, record("E", ("event_id", "long"), ("u", ["int", "float"])), record("E", ("event_id", "long"), ("u", "double"))).withColumnRenamed("u", "x")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id END AS x FROM events")
def resolve_union_both(spark, d):
    df = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("int")).alias("x"))
    return trip(df, record("E", ("event_id", "long"), ("x", ["null", "int"])), record("E", ("event_id", "long"), ("x", ["long", "null"])))


_DEEP_W = record("A", ("id", "long"), ("b", json.loads(record("B", ("gone", "string"), ("old", "int"), ("c", {"type": "array", "items": json.loads(record("C", ("x", "int"), ("drop", "double")))})))))
_DEEP_R = record("A", ("b", json.loads(record("B", ("c", {"type": "array", "items": json.loads(record("C", ("y", "string", {"default": "new"}), ("x", "long")))}), ("fresh", "long", {"aliases": ["old"]})))), ("id", "long"))


def _deep(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.struct(F.col("event_type").alias("gone"), (F.col("user_id") % 100).cast("int").alias("old"), F.array(F.struct((F.col("event_id") % 7).cast("int").alias("x"), F.col("value").alias("drop"))).alias("c")).alias("b"),
    )


@query("SELECT event_id AS id, user_id % 100 AS fresh, event_id % 7 AS x, 'new' AS y FROM events")
def resolve_nested_3level(spark, d):
    return trip(_deep(spark, d), _DEEP_W, _DEEP_R).select("id", "b.fresh", F.inline("b.c")).select("id", "fresh", "x", "y")


@query("SELECT CAST(0 AS BIGINT) AS differing, count(*) AS n FROM events")
def resolve_df_vs_codec(spark, d):
    df = _deep(spark, d)
    raw = df.select(F.struct("*").alias("w"), encode_avro(F.struct("*"), _DEEP_W).alias("b"))
    out = raw.select(decode_avro("b", _DEEP_W, _DEEP_R).alias("a"), evolve("w", _DEEP_W, _DEEP_R).alias("e"))
    return out.agg(F.sum((~F.col("a").eqNullSafe(F.col("e"))).cast("long")).alias("differing"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id AS uid, CAST(event_id AS DOUBLE) AS n, 'none' AS region FROM events")
def evolve_projection(spark, d):
    w, r = record("E", ("event_id", "long"), ("user_id", "long")), record("E", ("uid", "long", {"aliases": ["user_id"]}), ("n", "double", {"aliases": ["event_id"]}), ("region", "string", {"default": "none"}))
    return table(spark, d, "events").select(evolve(F.struct("event_id", "user_id"), w, r).alias("v")).select("v.*")


_KINDS = list(PRIMITIVES)


@query("SELECT w AS writer, r AS reader, w = r OR (w, r) IN (('int','long'),('int','float'),('int','double'),('long','float'),('long','double'),('float','double'),('string','bytes'),('bytes','string')) AS ok FROM (SELECT unnest(['null','boolean','int','long','float','double','bytes','string']) AS w), (SELECT unnest(['null','boolean','int','long','float','double','bytes','string']) AS r)")
def compat_matrix(spark, d):
    return compatibility_table(spark, {k: parse(k) for k in _KINDS}).select("writer", "reader", F.col("compatible").alias("ok"))


# fingerprints

_FORMS = {"int": '{"type":"int","logicalType":"date"}', "rec": '{"type":"record","name":"R","namespace":"a.b","doc":"x","fields":[{"name":"f","type":["null","string"],"default":null}]}', "enum": '{"type":"enum","name":"E","symbols":["A","B"],"default":"A"}'}
_CANON = {"int": '"int"', "rec": '{"name":"a.b.R","type":"record","fields":[{"name":"f","type":["null","string"]}]}', "enum": '{"name":"E","type":"enum","symbols":["A","B"]}'}
_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in _CANON.items())


@query(f"SELECT k, v AS canonical FROM (VALUES {_VALUES}) t(k, v)")
def canonical_forms(spark, d):
    return spark.createDataFrame([(k, parse(v).canonical()) for k, v in _FORMS.items()], "k string, canonical string")


@query(f"SELECT k, sha256(v) AS h FROM (VALUES {_VALUES}) t(k, v)")
def fingerprints_sha256(spark, d):
    return spark.createDataFrame([(k, parse(v).fingerprint("sha256").hex()) for k, v in _FORMS.items()], "k string, h string")


#: Fingerprints of the primitive types.
_RABIN = {
    "null": "63dd24e7cc258f8a",
    "boolean": "9f42fc78a4d4f764",
    "int": "7275d51a3f395c8f",
    "long": "d054e14493f41db7",
    "float": "4d7c02cb3ea8d790",
    "double": "8e7535c032ab957e",
    "bytes": "4fc016dac3201965",
    "string": "8f014872634503c7",
}


@query("SELECT k, h, h AS of_column FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _RABIN.items()) + ") t(k, h)")
def fingerprints_rabin(spark, d):
    df = spark.createDataFrame([(k, parse(k).fingerprint().hex(), parse(k).canonical()) for k in _RABIN], "k string, h string, c string")
    return df.select("k", "h", F.lower(F.hex(rabin64("c"))).alias("of_column"))


# container files


def _ocf_roundtrip(codec: str):
    def run(spark, d):
        path = scratch(spark, f"ocf-{codec}")
        write_ocf(table(spark, d, "lineitem"), path, codec=codec)
        out = read_ocf(spark, path, columns=["l_returnflag", "l_quantity", "l_linenumber"])
        return out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"), F.sum("l_linenumber").alias("lines"))

    run.__name__ = f"ocf_roundtrip_{codec}"
    query("SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY ALL")(run)


for _codec in ("null", "deflate", "snappy", "zstandard"):
    _ocf_roundtrip(_codec)


@query("SELECT o_orderkey AS id, o_totalprice AS price, 'web' AS channel FROM orders")
def ocf_evolve_read(spark, d):
    path = scratch(spark, "ocf-evolve")
    write_ocf(table(spark, d, "orders"), path)
    return read_ocf(spark, path, record("Row", ("id", ["null", "long"], {"aliases": ["o_orderkey"]}), ("price", ["null", "double"], {"aliases": ["o_totalprice"]}), ("channel", "string", {"default": "web"})))


@query("SELECT o_orderkey, o_custkey FROM orders")
def ocf_pruned_read(spark, d):
    path = scratch(spark, "ocf-pruned")
    write_ocf(table(spark, d, "orders"), path, codec="zstandard")
    return read_ocf(spark, path, columns=["o_orderkey", "o_custkey"])


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'none' END AS status FROM orders")
def ocf_multi_version(spark, d):
    path, o = scratch(spark, "ocf-versions"), table(spark, d, "orders")
    v1 = record("O", ("o_orderkey", "long"))
    v2 = record("O", ("o_orderkey", "long"), ("o_orderstatus", "string"))
    write_ocf(o.where("o_orderkey % 2 <> 0").select("o_orderkey"), path, "append", v1)
    write_ocf(o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus"), path, "append", v2)
    reader = record("O", ("k", "long", {"aliases": ["o_orderkey"]}), ("status", "string", {"aliases": ["o_orderstatus"], "default": "none"}))
    return read_ocf(spark, path, reader_schema_fn=lambda header: reader)


@query("SELECT 'deflate' AS codec, count(*) AS n, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS blocks, 'orders' AS origin, '000102030405060708090a0b0c0d0e0f' AS sync FROM orders")
def ocf_metadata(spark, d):
    path = scratch(spark, "ocf-meta")
    write_ocf(table(spark, d, "orders").coalesce(1), path, codec="deflate", blockCount=1000, blockBytes=1 << 30, syncMarker="000102030405060708090a0b0c0d0e0f", **{"meta.origin": "orders"})
    m = metadata(spark, path)
    return m.groupBy("codec", F.col("meta")["origin"].alias("origin"), "sync").agg(F.sum("rows").alias("n"), F.sum("blocks").alias("blocks")).select("codec", "n", "blocks", "origin", "sync")


@query("SELECT count(*) AS n, CAST(sum(r_regionkey) AS BIGINT) AS s FROM (SELECT r_regionkey FROM region UNION ALL SELECT n_nationkey FROM nation)")
def ocf_append(spark, d):
    path = scratch(spark, "ocf-append")
    write_ocf(table(spark, d, "region").select(F.col("r_regionkey").alias("k")), path)
    write_ocf(table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), path, "append")
    return read_ocf(spark, path).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("s"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def ocf_pre_encoded(spark, d):
    path, schema = scratch(spark, "ocf-raw"), record("E", ("event_id", "long"), ("event_type", "string"))
    raw = table(spark, d, "events").select(encode_avro(F.struct("event_id", "event_type"), schema).alias("b"))
    write_ocf(raw, path, schema=schema, preEncoded="true", codec="snappy")
    return read_ocf(spark, path, columns=["event_type"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY ALL")
def ocf_stream(spark, d):
    """A folder of container files as a stream that is written to container files again."""
    source, sink, marks = scratch(spark, "ocf-in"), scratch(spark, "ocf-out"), scratch(spark, "ocf-marks")
    write_ocf(table(spark, d, "events").select("event_id", "event_type", "user_id").repartition(4), source)
    q = spark.readStream.format("ocf").load(source).writeStream.format("ocf").option("checkpointLocation", marks).trigger(availableNow=True).start(sink)
    q.awaitTermination()
    return read_ocf(spark, sink).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))


# messages

_V1, _V2 = record("Ev", ("event_id", "long"), ("kind", "string")), record("Ev", ("event_id", "long"), ("kind", "string"), ("value", "double"))
_VR = record("Ev", ("event_id", "long"), ("kind", "string"), ("value", "double", {"default": -1.0}))


def _messages(spark, d):
    e = table(spark, d, "events").withColumn("kind", F.col("event_type"))
    return e.where("event_id % 2 = 0").select(encode_soe(F.struct("event_id", "kind"), _V1).alias("m")).unionByName(e.where("event_id % 2 <> 0").select(encode_soe(F.struct("event_id", "kind", "value"), _V2).alias("m")))


@query("SELECT event_id, event_type AS kind, value FROM events")
def soe_roundtrip(spark, d):
    e = table(spark, d, "events").select(encode_soe(F.struct("event_id", F.col("event_type").alias("kind"), "value"), _V2).alias("m"))
    return e.select(decode_soe("m", _V2).alias("v")).select("v.*")


@query("SELECT CAST(count(DISTINCT event_id % 2) AS BIGINT) AS schemas, count(*) AS n, true AS known FROM events")
def soe_fingerprint_split(spark, d):
    known = [F.lit(bytearray(parse(s).fingerprint()[::-1])) for s in (_V1, _V2)]
    m = _messages(spark, d).select(soe_fingerprint("m").alias("f"), soe_payload("m").alias("p"))
    return m.agg(F.count_distinct("f").alias("schemas"), F.count("p").alias("n"), F.bool_and(F.col("f").isin(*known)).alias("known"))


@query("SELECT event_id, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN -1.0 ELSE value END AS value FROM events")
def soe_dispatch_versions(spark, d):
    return read_versions(_messages(spark, d), "m", [_V1, _V2], _VR).select("value.*")


@query("SELECT count(*) FILTER (WHERE event_id % 10 <> 0) AS good, count(*) FILTER (WHERE event_id % 10 = 0) AS bad FROM events")
def soe_reject_bad(spark, d):
    e = table(spark, d, "events").select("event_id", encode_soe(F.struct("event_id", F.col("event_type").alias("kind")), _V1).alias("m"))
    e = e.select(F.when(F.col("event_id") % 10 == 0, F.concat(F.unhex(F.lit("C302")), F.substring("m", 3, 1000))).otherwise(F.col("m")).alias("m"))
    return e.select(is_soe("m", _V1).cast("long").alias("ok")).agg(F.sum("ok").alias("good"), F.sum(1 - F.col("ok")).alias("bad"))


# logical types


@query("SELECT event_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms, epoch_us(ts) AS us, epoch_us(ts) * 1000 AS ns FROM events")
def ts_units(spark, d):
    long = lambda t: {"type": "long", "logicalType": t}
    df = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ms"), F.col("ts").cast("timestamp").alias("us"), F.col("ts").cast("timestamp").alias("ns"))
    schema = record("T", ("event_id", "long"), ("ms", long("timestamp-millis")), ("us", long("timestamp-micros")), ("ns", long("timestamp-nanos")))
    plain = record("T", ("event_id", "long"), ("ms", "long"), ("us", "long"), ("ns", "long"))
    return trip(df, schema, plain)


@query("SELECT event_id, epoch_us(ts) AS us FROM events")
def local_ts_micros(spark, d):
    df = table(spark, d, "events").select("event_id", "ts")
    out = trip(df, record("T", ("event_id", "long"), ("ts", {"type": "long", "logicalType": "local-timestamp-micros"})))
    return out.select("event_id", L.timestamp_to_micros("ts").alias("us"))


@query("SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate - INTERVAL 60 YEAR AS DATE)) AS INTEGER) AS before FROM orders")
def date_days(spark, d):
    date = {"type": "int", "logicalType": "date"}
    df = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("days"), F.to_date(F.col("o_orderdate") - F.expr("INTERVAL 60 YEAR")).alias("before"))
    return trip(df, record("D", ("o_orderkey", "long"), ("days", date), ("before", date)), record("D", ("o_orderkey", "long"), ("days", "int"), ("before", "int")))


@query("SELECT event_id, CAST(epoch_us(ts) % 86400000000 AS BIGINT) AS us, CAST(epoch_us(ts) % 86400000000 // 1000 AS INTEGER) AS ms FROM events")
def time_of_day(spark, d):
    df = table(spark, d, "events").select("event_id", L.micros_to_interval(L.micros_of_day("ts")).alias("us"), L.micros_to_interval(L.micros_of_day("ts")).alias("ms"))
    schema = record("T", ("event_id", "long"), ("us", {"type": "long", "logicalType": "time-micros"}), ("ms", {"type": "int", "logicalType": "time-millis"}))
    return trip(df, schema, record("T", ("event_id", "long"), ("us", "long"), ("ms", "int")))


@query("SELECT o_orderkey, CAST(floor(o_totalprice::DECIMAL(18,2) * 10) AS BIGINT) AS tenths, CAST(floor(-(o_totalprice::DECIMAL(18,2)) * 10) AS BIGINT) AS negative FROM orders")
def decimal_floor(spark, d):
    """Numbers with more digits than the scale are rounded down."""
    v = F.col("o_totalprice").cast("decimal(18,2)")
    df = table(spark, d, "orders").select("o_orderkey", v.alias("tenths"), (-v).alias("negative"))
    dec = {"type": "bytes", "logicalType": "decimal", "precision": 18, "scale": 1}
    out = trip(df, record("D", ("o_orderkey", "long"), ("tenths", dec), ("negative", dec)))
    return out.select("o_orderkey", (F.col("tenths") * 10).cast("long").alias("tenths"), (F.col("negative") * 10).cast("long").alias("negative"))


@query("SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS v, true AS same FROM orders")
def decimal_bytes(spark, d):
    v = (F.round(F.col("o_totalprice") * 100) / 100).cast("decimal(18,2)")
    df = table(spark, d, "orders").select("o_orderkey", v.alias("v"))
    schema = record("D", ("o_orderkey", "long"), ("v", {"type": "bytes", "logicalType": "decimal", "precision": 18, "scale": 2}))
    raw = df.select("o_orderkey", encode_avro(F.struct("*"), schema).alias("b"), L.decimal_to_bytes("v", 2).alias("native"))
    out = raw.select("o_orderkey", decode_avro("b", schema, columns=["v"]).alias("x"), decode_avro("b", record("D", ("o_orderkey", "long"), ("v", "bytes")), columns=["v"]).alias("y"), "native")
    return out.select("o_orderkey", (F.col("x.v") * 100).cast("long").alias("v"), (F.col("y.v") == F.col("native")).alias("same"))


@query("SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS v, true AS same FROM customer")
def decimal_fixed(spark, d):
    v = (F.round(F.col("c_acctbal") * 100) / 100).cast("decimal(18,2)")
    df = table(spark, d, "customer").select("c_custkey", v.alias("v"))
    schema = record("D", ("v", {"type": "fixed", "name": "F", "size": 8, "logicalType": "decimal", "precision": 18, "scale": 2}))
    raw = df.select("c_custkey", encode_avro(F.struct("v"), schema).alias("b"), L.decimal_to_fixed("v", 2, 8).alias("native"))
    return raw.select("c_custkey", (decode_avro("b", schema)["v"] * 100).cast("long").alias("v"), (F.col("b") == F.col("native")).alias("same"))


@query("SELECT o_orderkey, CAST(o_orderkey + 1 AS VARCHAR) || '000000000000000000000000000000' AS v FROM orders")
def decimal_38(spark, d):
    v = F.concat((F.col("o_orderkey") + 1).cast("string"), F.lit("0" * 30)).cast("decimal(38,0)")
    df = table(spark, d, "orders").select("o_orderkey", v.alias("v"))
    out = trip(df, record("D", ("o_orderkey", "long"), ("v", {"type": "bytes", "logicalType": "decimal", "precision": 38, "scale": 0})))
    return out.select("o_orderkey", F.col("v").cast("string").alias("v"))


@query("SELECT doc_id, CAST(CAST(md5(text) AS UUID) AS VARCHAR) AS u, true AS same FROM documents")
def uuid_fixed(spark, d):
    df = table(spark, d, "documents").select("doc_id", L.bytes_to_uuid(F.unhex(F.md5("text"))).alias("u"))
    schema = record("U", ("u", {"type": "fixed", "name": "Id", "size": 16, "logicalType": "uuid"}))
    raw = df.select("doc_id", encode_avro(F.struct("u"), schema).alias("b"), L.uuid_to_bytes("u").alias("native"))
    return raw.select("doc_id", decode_avro("b", schema)["u"].alias("u"), (F.col("b") == F.col("native")).alias("same"))


@query("""SELECT k, CASE WHEN t = 'P' THEN 'P0D' ELSE t END AS iso FROM (SELECT k, 'P' || CASE WHEN m // 12 > 0 THEN (m // 12)::VARCHAR || 'Y' ELSE '' END || CASE WHEN m % 12 > 0 THEN (m % 12)::VARCHAR || 'M' ELSE '' END
  || CASE WHEN dd > 0 THEN dd::VARCHAR || 'D' ELSE '' END || CASE WHEN s > 0 THEN 'T' || CASE WHEN s // 60 > 0 THEN (s // 60)::VARCHAR || 'M' ELSE '' END || CASE WHEN s % 60 > 0 THEN (s % 60)::VARCHAR || 'S' ELSE '' END ELSE '' END AS t
  FROM (SELECT event_id AS k, event_id % 30 AS m, event_id % 4 AS dd, event_id % 3600 AS s FROM events))""")
def duration_iso(spark, d):
    parts = F.struct((F.col("event_id") % 30).alias("months"), (F.col("event_id") % 4).alias("days"), (F.col("event_id") % 3600 * 1000).alias("millis"))
    df = table(spark, d, "events").select(F.col("event_id").alias("k"), parts.alias("v"))
    out = trip(df, record("D", ("k", "long"), ("v", {"type": "fixed", "name": "Dur", "size": 12, "logicalType": "duration"})))
    return out.select("k", L.duration_to_iso("v").alias("iso"))


# JSON


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_decode_props(spark, d):
    out = table(spark, d, "events").select("event_id", decode_json("props", record("P", ("k", "int"))).alias("v"))
    return out.select("event_id", "v.k")


@query("""SELECT event_id, '{"event_id":' || event_id || ',"kind":"' || event_type || '","user":' || CASE WHEN event_id % 2 = 0 THEN user_id::VARCHAR ELSE 'null' END || '}' AS j FROM events""")
def json_encode_events(spark, d):
    df = table(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("user"))
    return df.select("event_id", encode_json(F.struct("*"), record("E", ("event_id", "long"), ("kind", EVENT_ENUM), ("user", NULLABLE("long")))).alias("j"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"u":{"long":' || user_id || '}}' ELSE '{"u":null}' END AS j FROM events""")
def json_tagged_union(spark, d):
    df = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("u"))
    schema = record("E", ("u", NULLABLE("long")))
    j = df.select("event_id", encode_json(F.struct("u"), schema, tagged=True).alias("j"))
    return j.select("event_id", encode_json(decode_json("j", schema), schema, tagged=True).alias("j"))


@query("""SELECT event_id, '{"t":{"long.timestamp-micros":' || epoch_us(ts) || '}}' AS j FROM events""")
def json_tagged_logical(spark, d):
    df = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    return df.select("event_id", encode_json(F.struct("t"), record("E", ("t", NULLABLE({"type": "long", "logicalType": "timestamp-micros"}))), tagged=True, tag_logical=True).alias("j"))


@query(r"""SELECT event_id, '{"b":"\u00FF' || event_type || '\u0000"}' AS j FROM events""")
def json_bytes_latin1(spark, d):
    schema = record("E", ("b", "bytes"))
    df = table(spark, d, "events").select("event_id", F.concat(F.unhex(F.lit("FF")), F.encode("event_type", "UTF-8"), F.unhex(F.lit("00"))).alias("b"))
    j = df.select("event_id", encode_json(F.struct("b"), schema).alias("j"))
    return j.select("event_id", encode_json(decode_json("j", schema), schema).alias("j"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"x":"NaN"}' WHEN 1 THEN '{"x":"Infinity"}' WHEN 2 THEN '{"x":"-Infinity"}' ELSE '{"x":' || event_id || '.5}' END AS j,
  CASE event_id % 4 WHEN 0 THEN '{"x":null}' WHEN 1 THEN '{"x":1e999}' WHEN 2 THEN '{"x":-1e999}' ELSE '{"x":' || event_id || '.5}' END AS l FROM events""")
def json_special_floats(spark, d):
    k, schema = F.col("event_id") % 4, record("E", ("x", "double"))
    x = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(float("-inf"))).otherwise(F.col("event_id") + 0.5)
    j = table(spark, d, "events").select("event_id", encode_json(F.struct(x.alias("x")), schema).alias("j"))
    return j.select("event_id", "j", encode_json(decode_json("j", schema), schema, linkedin_floats=True).alias("l"))


@query("""SELECT event_id, '{"id":' || event_id || ',"next":{"id":' || user_id || ',"next":null}}' AS j FROM events""")
def json_recursive(spark, d):
    """A recursive value from JSON to bytes and back."""
    schema = record("N", ("id", "long"), ("next", NULLABLE("N")))
    j = F.concat(F.lit('{"id":'), "event_id", F.lit(',"next":{"N":{"id":'), "user_id", F.lit(',"next":null}}}'))
    raw = table(spark, d, "events").select("event_id", json_to_avro(j, schema).alias("b"))
    return raw.select("event_id", avro_to_json("b", schema).alias("j"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id % 3 END AS n, CASE WHEN event_id % 2 <> 0 THEN event_type END AS s FROM events")
def omit_zeros(spark, d):
    schema = record("Z", ("event_id", "long"), ("n", NULLABLE("long"), {"omitzero": True}), ("s", NULLABLE("string"), {"omitzero": True}))
    df = table(spark, d, "events").select("event_id", (F.col("event_id") % 3).alias("n"), F.when(F.col("event_id") % 2 != 0, F.col("event_type")).otherwise("").alias("s"))
    return trip(df, schema)


@query("SELECT doc_id, md5(text) AS h, lang FROM documents")
def json_roundtrip(spark, d):
    df = table(spark, d, "documents").select("doc_id", "text", "lang")
    schema = schema_from_struct(df.schema, "Doc")
    j = df.select(encode_json(F.struct("*"), schema, tagged=True).alias("j"))
    return j.select(decode_json("j", schema).alias("v")).select("v.doc_id", F.md5("v.text").alias("h"), "v.lang")


# custom types and inference


@query("SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) // 100 AS units, CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS cents FROM orders")
def custom_type_money(spark, d):
    money = CustomType("money", "long", lambda c, n: c["units"] * 100 + c["cents"], lambda c, n: F.struct(F.floor(c / 100).alias("units"), (c % 100).alias("cents")))
    schema = parse(record("Order", ("o_orderkey", "long"), ("price", {"type": "long", "logicalType": "money"})), keep_logical={"money"})
    total = cents("o_totalprice")
    df = table(spark, d, "orders").select("o_orderkey", F.struct(F.floor(total / 100).alias("units"), (total % 100).alias("cents")).alias("price"))
    raw = df.select(encode_avro(F.struct("*"), schema, (money,)).alias("b"))
    return raw.select(decode_avro("b", schema, custom=(money,)).alias("v")).select("v.o_orderkey", "v.price.units", "v.price.cents")


@query("SELECT event_id, user_id * 2 AS twice, event_id AS once FROM events")
def custom_props_double(spark, d):
    double = CustomType(kind="long", decode=lambda c, n: c * n.props["factor"], when=lambda n: "factor" in n.props)
    schema = record("E", ("event_id", "long"), ("twice", {"type": "long", "factor": 2}), ("once", "long"))
    raw = table(spark, d, "events").select(encode_avro(F.struct("event_id", F.col("user_id").alias("twice"), F.col("event_id").alias("once")), schema).alias("b"))
    return raw.select(decode_avro("b", schema, custom=(double,)).alias("v")).select("v.*")


@query("SELECT event_id, epoch_us(ts) AS ts FROM events")
def raw_logical(spark, d):
    schema = record("E", ("event_id", "long"), ("ts", {"type": "long", "logicalType": "local-timestamp-micros"}))
    raw = table(spark, d, "events").select(encode_avro(F.struct("event_id", "ts"), schema).alias("b"))
    return raw.select(decode_avro("b", schema, raw=frozenset({"local-timestamp-micros"})).alias("v")).select("v.*")


@query("""SELECT * FROM (VALUES ('region', '{"name":"region","type":"record","fields":[{"name":"r_regionkey","type":["null","int"]},{"name":"r_name","type":["null","string"]}]}'),
  ('labels', '{"name":"labels","type":"record","fields":[{"name":"doc_id","type":["null","long"]},{"name":"quality","type":["null","int"]},{"name":"toxic","type":["null","int"]}]}')) t(name, canonical)""")
def infer_schema_struct(spark, d):
    return spark.createDataFrame([(n, schema_from_struct(table(spark, d, n).schema, n).canonical()) for n in ("region", "labels")], "name string, canonical string")


# what is refused, filled in and passed over


def _sql_values(rows: list[tuple], *names: str) -> str:
    """SQL of these rows of texts and booleans."""
    show = lambda v: "CAST(NULL AS VARCHAR)" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({', '.join(names)})"


def _parses(schema) -> bool:
    try:
        parse(schema)
        return True
    except SchemaError:
        return False


@query("SELECT o_orderkey, o_orderstatus AS status, 7 AS level, 'open' AS note, CAST(NULL AS DOUBLE) AS rate FROM orders")
def encode_missing_defaults(spark, d):
    """Fields that the rows lack are written with the default of the schema."""
    df = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    schema = record("O", ("o_orderkey", "long"), ("status", "string"), ("level", "int", {"default": 7}), ("note", "string", {"default": "open"}), ("rate", NULLABLE("double"), {"default": None}))
    return trip(df, schema)


@query("SELECT event_id, CAST(user_id AS INTEGER) AS a, CAST(event_id AS DOUBLE) AS b, event_type AS c, CAST(user_id AS BIGINT) AS d FROM events")
def encode_coercions(spark, d):
    """Numbers of another kind that hold without loss: whole doubles as int, longs as double, decimals as long, bytes as text."""
    df = table(spark, d, "events").select("event_id", F.col("user_id").cast("double").alias("a"), F.col("event_id").alias("b"), F.encode("event_type", "UTF-8").alias("c"), F.col("user_id").cast("decimal(20,0)").alias("d"))
    return trip(df, record("C", ("event_id", "long"), ("a", "int"), ("b", "double"), ("c", "string"), ("d", "long")))


@query("SELECT event_id, event_id % 2 = 0 AS fits, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS INTEGER) END AS n FROM events")
def decode_narrowing(spark, d):
    """Longs as ints: numbers beyond the smaller type are refused, not cut."""
    df = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_id")).otherwise(F.col("event_id") + (1 << 40)).alias("n"))
    raw = df.select("event_id", encode_avro("n", '"long"').alias("b"))
    return raw.select("event_id", try_decode_avro("b", '"int"').alias("n")).select("event_id", F.col("n").isNotNull().alias("fits"), "n")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'inner.x' WHEN 1 THEN 'inner.y' END AS path FROM events")
def errors_with_path(spark, d):
    """Where bytes that end too early fail."""
    inner = {"type": "record", "name": "In", "fields": [{"name": "x", "type": "boolean"}, {"name": "y", "type": "long"}]}
    schema = record("E", ("inner", inner))
    df = table(spark, d, "events").select("event_id", encode_avro(F.struct(F.struct(F.lit(True).alias("x"), F.col("user_id").alias("y")).alias("inner")), schema).alias("b"))
    k = F.col("event_id") % 3
    df = df.withColumn("b", F.when(k == 0, F.substring("b", 1, 0)).when(k == 1, F.substring("b", 1, 1)).otherwise(F.col("b")))
    return df.select("event_id", F.split(decode_errors("b", schema), ": ")[0].alias("path"))


@query("SELECT event_id, epoch_us(ts) AS us, epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS day, true AS refused FROM events")
def time_text(spark, d):
    """Timestamps from RFC 3339 text with an offset, from dates alone, and text that is neither."""
    text, day = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.date_format("ts", "yyyy-MM-dd")
    df = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")).select("event_id", L.text_to_timestamp(text).alias("us"), L.text_to_timestamp(day).alias("day"), L.text_to_timestamp(F.concat(F.lit("x"), day)).alias("no"))
    return df.select("event_id", L.timestamp_to_micros("us").alias("us"), L.timestamp_to_micros("day").alias("day"), F.col("no").isNull().alias("refused"))


@query("SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS v, true AS none FROM customer")
def decimal_of_bytes(spark, d):
    """Two's complement bytes of any length, and none, as decimals."""
    v = (F.round(F.col("c_acctbal") * 100) / 100).cast("decimal(18,2)")
    df = table(spark, d, "customer").select("c_custkey", L.decimal_to_bytes(v, 2).alias("b"))
    return df.select("c_custkey", (L.decimal_from_bytes("b", 2) * 100).cast("long").alias("v"), (L.decimal_from_bytes(F.substring("b", 1, 0), 2) == 0).alias("none"))


#: (logical type, attributes of its base, whether it may stand there)
_BASES = [
    ("date", {"type": "int"}, True),
    ("date", {"type": "long"}, False),
    ("time-millis", {"type": "int"}, True),
    ("time-micros", {"type": "long"}, True),
    ("time-micros", {"type": "int"}, False),
    ("timestamp-millis", {"type": "long"}, True),
    ("timestamp-nanos", {"type": "string"}, False),
    ("local-timestamp-micros", {"type": "long"}, True),
    ("uuid", {"type": "string"}, True),
    ("uuid", {"type": "fixed", "name": "F", "size": 16}, True),
    ("uuid", {"type": "fixed", "name": "F", "size": 12}, False),
    ("duration", {"type": "fixed", "name": "F", "size": 12}, True),
    ("duration", {"type": "bytes"}, False),
    ("decimal", {"type": "bytes", "precision": 4, "scale": 2}, True),
]


@query(_sql_values([(name, json.dumps(base), ok) for name, base, ok in _BASES], "logical", "base", "ok"))
def logical_bases(spark, d):
    return spark.createDataFrame([(n, json.dumps(b), _parses(b | {"logicalType": n})) for n, b, _ in _BASES], "logical string, base string, ok boolean")


# schemas: parsing, names, defaults, trees, registry

_TREE = record(
    "Order",
    ("id", "long", {"doc": "key"}),
    ("state", {"type": "enum", "name": "State", "symbols": ["OPEN", "SHUT"], "default": "OPEN"}, {"default": "SHUT"}),
    ("lines", {"type": "array", "items": {"type": "record", "name": "Line", "namespace": "shop.parts", "fields": [{"name": "sku", "type": {"type": "fixed", "name": "Sku", "size": 8}}, {"name": "also", "type": ["null", "Sku"], "default": None}]}}),
    ("tags", {"type": "map", "values": "string"}, {"default": {}}),
)
_TREE_ROWS = [
    ("id", "long", "long", None),
    ("state", "enum", "shop.State", '"SHUT"'),
    ("lines", "array", "array", None),
    ("lines.sku", "fixed", "shop.parts.Sku", None),
    ("lines.also", "union", "union", "null"),
    ("tags", "map", "map", "{}"),
]


def _in_shop() -> dict:
    return json.loads(_TREE) | {"namespace": "shop"}


@query(_sql_values(_TREE_ROWS, "path", "kind", "name", "preset"))
def schema_fields(spark, d):
    """The fields of a schema with full names and defaults, from its tree."""
    schema, found = parse(_in_shop()), []

    def visit(node, path):
        node = schema.of(node)
        for f in node.fields:
            at, of = [*path, f.name], schema.of(f.type)
            found.append((".".join(at), of.kind, of.label(), json.dumps(f.default) if f.has_default else None))
            visit(of.items or of, at)

    visit(schema.root, [])
    return spark.createDataFrame(found, "path string, kind string, name string, preset string")


#: Schemas and whether they are ones.
_TEXTS = [
    ("plain", "long", True),
    ("object", {"type": "long"}, True),
    ("unknown type", "decimal64", False),
    ("union in a union", ["null", ["int"]], False),
    ("same branch twice", ["string", "string"], False),
    ("two enums of different names", [{"type": "enum", "name": "A", "symbols": ["X"]}, {"type": "enum", "name": "B", "symbols": ["X"]}], True),
    ("symbol twice", {"type": "enum", "name": "A", "symbols": ["X", "X"]}, False),
    ("enum default that is no symbol", {"type": "enum", "name": "A", "symbols": ["X"], "default": "Y"}, False),
    ("map without values", {"type": "map"}, False),
    ("fixed without size", {"type": "fixed", "name": "A"}, False),
    ("field twice", json.loads(record("A", ("x", "int"), ("x", "long"))), False),
    ("default of another type", json.loads(record("A", ("x", "int", {"default": "1"}))), False),
    ("default of a later branch", json.loads(record("A", ("x", ["null", "int"], {"default": 1}))), True),
    ("record within itself", json.loads(record("A", ("next", ["null", "A"]))), True),
    ("name that begins with a digit", json.loads(record("1A", ("x", "int"))), False),
]


@query(_sql_values([(k, ok) for k, _, ok in _TEXTS], "k", "ok"))
def schema_rules(spark, d):
    return spark.createDataFrame([(k, _parses(json.dumps(v))) for k, v, _ in _TEXTS], "k string, ok boolean")


_TREE_CANON = (
    '{"name":"shop.Order","type":"record","fields":[{"name":"id","type":"long"},{"name":"state","type":{"name":"shop.State","type":"enum","symbols":["OPEN","SHUT"]}},'
    '{"name":"lines","type":{"type":"array","items":{"name":"shop.parts.Line","type":"record","fields":[{"name":"sku","type":{"name":"shop.parts.Sku","type":"fixed","size":8}},'
    '{"name":"also","type":["null","shop.parts.Sku"]}]}}},{"name":"tags","type":{"type":"map","values":"string"}}]}'
)


@query(_sql_values([("parsed", _TREE_CANON), ("built", _TREE_CANON), ("again", _TREE_CANON)], "k", "canonical"))
def schema_built(spark, d):
    """A schema from its text, from its tree, and from the text that it is written as."""
    schema = parse(_in_shop())
    return spark.createDataFrame([("parsed", schema.canonical()), ("built", build(schema.root).canonical()), ("again", parse(schema.to_json()).canonical())], "k string, canonical string")


@query(_sql_values([("known", "geo.Place,geo.Point", True), ("unknown", "", False), ("defined anew", "", False), ("same again", "geo.Point", True)], "k", "names", "ok"))
def registry_names(spark, d):
    """Schemas that refer to types of schemas before them."""
    registry = Registry()
    point = {"type": "record", "name": "geo.Point", "fields": [{"name": "x", "type": "double"}, {"name": "y", "type": "double"}]}
    registry.parse(json.dumps(point))
    tries = {
        "known": {"type": "record", "name": "geo.Place", "fields": [{"name": "at", "type": "Point"}]},
        "unknown": {"type": "record", "name": "geo.Road", "fields": [{"name": "along", "type": {"type": "array", "items": "Segment"}}]},
        "defined anew": {"type": "record", "name": "geo.Point", "fields": []},
        "same again": point,
    }
    found = []
    for k, v in tries.items():
        try:
            found.append((k, ",".join(sorted(registry.parse(json.dumps(v, indent=1)).named)), True))
        except SchemaError:
            found.append((k, "", False))
    return spark.createDataFrame(found, "k string, names string, ok boolean")


@dataclasses.dataclass
class _Stamp:
    price: float
    status: str = dataclasses.field(metadata={"avro": "name=o_orderstatus"})


@dataclasses.dataclass
class _Placed:
    o_orderkey: int
    stamp: _Stamp = dataclasses.field(metadata={"avro": "inline"})
    hidden: int = dataclasses.field(metadata={"avro": "-"})
    comment: str | None = None


@query("SELECT o_orderkey, o_totalprice AS price, o_orderstatus, CAST(NULL AS VARCHAR) AS comment FROM orders")
def schema_for_dataclass(spark, d):
    """Rows by the schema of a dataclass: renamed, left out and inlined fields, and a default."""
    df = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), "o_orderstatus", F.lit(1).alias("hidden"))
    return trip(df, schema_for(_Placed).to_json())


# JSON that is read leniently


@query("SELECT event_id, CAST(event_id AS INTEGER) AS n, CAST(user_id AS DOUBLE) AS x FROM events")
def json_numbers(spark, d):
    """Whole numbers with a fraction of zero or an exponent are ints; ints are doubles."""
    j = F.concat(F.lit('{"n":'), "event_id", F.when(F.col("event_id") % 2 == 0, ".0").otherwise("e0"), F.lit(',"x":'), "user_id", F.lit("}"))
    out = table(spark, d, "events").select("event_id", decode_json(j, record("N", ("n", "int"), ("x", "double"))).alias("v"))
    return out.select("event_id", "v.n", "v.x")


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id END AS id, CASE WHEN event_id % 3 <> 0 THEN 'none' END AS note FROM events")
def json_unknown_and_missing(spark, d):
    """Unknown keys are passed over, missing ones take their default; without one the text is refused."""
    j = F.concat(F.lit('{"more":{"a":[1,{"b":"}"}]},'), F.when(F.col("event_id") % 3 == 0, '"no":').otherwise('"id":'), "event_id", F.lit("}"))
    schema = record("U", ("id", "long"), ("note", "string", {"default": "none"}))
    return table(spark, d, "events").select("event_id", decode_json(j, schema, "permissive").alias("v")).select("event_id", "v.id", "v.note")


# more of custom types, files and table functions


@query("SELECT event_id, CAST(event_id AS DOUBLE) / 2 AS half, event_id * 10 AS ten FROM events")
def custom_on_resolved(spark, d):
    """Conversions of the reader's types after the evolution, and the first of several that doesn't pass."""
    halved = CustomType("halved", "double", decode=lambda c, n: c / 2)
    passing, ten, never = (CustomType("scaled", "long", decode=f) for f in (lambda c, n: None, lambda c, n: c * 10, lambda c, n: c * 99))
    writer = record("E", ("event_id", "long"), ("h", "int"), ("t", "int"))
    fields = [{"name": "event_id", "type": "long"}, {"name": "half", "aliases": ["h"], "type": {"type": "double", "logicalType": "halved"}}, {"name": "ten", "aliases": ["t"], "type": {"type": "long", "logicalType": "scaled"}}]
    reader = parse({"type": "record", "name": "E", "fields": fields}, keep_logical={"halved", "scaled"})
    n = F.col("event_id").cast("int")
    raw = table(spark, d, "events").select(encode_avro(F.struct("event_id", n.alias("h"), n.alias("t")), writer).alias("b"))
    return raw.select(decode_avro("b", writer, reader, custom=(halved, passing, ten, never)).alias("v")).select("v.*")


@query("SELECT event_id, user_id % 256 AS a, event_id % 256 AS b, (user_id % 256) || '.' || (event_id % 256) AS text FROM events")
def custom_text_form(spark, d):
    """Values with a text form are strings in the bytes."""
    pair = as_text("pair", lambda c: F.concat_ws(".", c["a"], c["b"]), lambda c: F.struct(F.split_part(c, F.lit("."), F.lit(1)).cast("long").alias("a"), F.split_part(c, F.lit("."), F.lit(2)).cast("long").alias("b")))
    schema = parse(record("E", ("event_id", "long"), ("p", {"type": "string", "logicalType": "pair"})), keep_logical={"pair"})
    value = F.struct((F.col("user_id") % 256).alias("a"), (F.col("event_id") % 256).alias("b")).alias("p")
    raw = table(spark, d, "events").select(encode_avro(F.struct("event_id", value), schema, (pair,)).alias("b"))
    out = raw.select(decode_avro("b", schema, custom=(pair,)).alias("v"), decode_avro("b", record("E", ("event_id", "long"), ("p", "string"))).alias("w"))
    return out.select("v.event_id", "v.p.a", "v.p.b", F.col("w.p").alias("text"))


@query("SELECT l_orderkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_orderkey")
def sql_table_function(spark, d):
    """All values in each row's bytes, as a table function of SQL."""
    register_schema(spark, "query_line", '"int"')
    df = table(spark, d, "lineitem").select("l_orderkey", encode_avro("l_linenumber", '"int"').alias("b"))
    packed = df.groupBy("l_orderkey").agg(F.unhex(F.array_join(F.collect_list(F.hex("b")), "")).alias("b"))
    out = spark.sql("SELECT l_orderkey, value FROM {t}, LATERAL rows_query_line(b)", t=packed)
    return out.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("long").alias("s"))


@query("SELECT count(*) AS n, true AS within FROM orders")
def ocf_block_limit(spark, d):
    """Blocks of at most so many bytes, read with just that limit."""
    path = scratch(spark, "ocf-limit")
    write_ocf(table(spark, d, "orders"), path, blockBytes=4096)
    of = metadata(spark, path).agg(F.bool_and(F.col("bytes") <= F.col("blocks") * 8192).alias("within"))
    return read_ocf(spark, path, maxBlockBytes=8192).agg(F.count("o_orderkey").alias("n")).crossJoin(of)


@query("SELECT o_orderkey, o_custkey * 3 AS thrice FROM orders")
def ocf_custom_read(spark, d):
    """A conversion that is attached to a property, applied to the columns of files."""
    path = scratch(spark, "ocf-custom")
    times = CustomType(kind="long", decode=lambda c, n: c * n.props["times"], when=lambda n: "times" in n.props)
    df = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("thrice"))
    write_ocf(df, path, schema=record("O", ("o_orderkey", "long"), ("thrice", {"type": "long", "times": 3})), codec="deflate")
    return read_ocf(spark, path, custom=(times,))


@query("SELECT CAST(r_regionkey AS BIGINT) AS k FROM region UNION ALL SELECT CAST(n_nationkey AS BIGINT) FROM nation")
def ocf_append_file(spark, d):
    """Rows added to a file that is there, with its schema, codec and marker."""
    path, schema = scratch(spark, "ocf-file"), record("K", ("k", "long"))
    write_ocf(table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("k")).coalesce(1), path, schema=schema, codec="snappy")
    more = table(spark, d, "nation").select(encode_avro(F.struct(F.col("n_nationkey").cast("long").alias("k")), schema).alias("b"))
    append_file(metadata(spark, path).first().path, [bytes(r.b) for r in more.collect()])
    return read_ocf(spark, path)


@query("""SELECT '{"name":"O","type":"record","fields":[{"name":"o_orderkey","type":"long"}]}' AS schema, count(*) AS n FROM orders""")
def ocf_header_schema(spark, d):
    """The canonical form in the header of the file, for rows of a schema with more to it."""
    path = scratch(spark, "ocf-header")
    write_ocf(table(spark, d, "orders").select("o_orderkey").coalesce(1), path, schema=record("O", ("o_orderkey", "long", {"doc": "key", "aliases": ["id"]})), schemaMode="canonical")
    return metadata(spark, path).groupBy("schema").agg(F.sum("rows").alias("n"))


@query("SELECT 'mirror' AS codec, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders")
def ocf_custom_codec(spark, d):
    """Blocks packed by a codec that is no built-in one."""
    register_codec("mirror", lambda b: b[::-1], lambda b: b[::-1])
    path = scratch(spark, "ocf-mirror")
    write_ocf(table(spark, d, "orders").select("o_orderkey", "o_custkey"), path, codec="mirror")
    name = metadata(spark, path).groupBy("codec").agg(F.sum("rows").alias("n"))
    return name.crossJoin(read_ocf(spark, path).agg(F.sum("o_custkey").alias("s")))
