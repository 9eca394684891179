"""Queries over a store that is filled from the sample tables, over validation and over JSON answers, with the SQL that each is held against."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .api import Engine
from .errors import EngineError
from .operators.validate import document_id, validate_document
from .plans.compile import to_json_rows
from .schema import ID, parse_schema
from .staging import shared_dir
from .warehouse import SCHEMA, query, sample_state


def _engine(spark) -> Engine:
    return Engine(spark, SCHEMA, f"{shared_dir(spark).rstrip('/')}/fernweave-store-{uuid.uuid4().hex}")


def _geography(spark, sf_dir) -> Engine:
    """Regions and nations, inserted document by document and row by row; their ids are those of the tables plus one."""
    e = _engine(spark)
    for r in sorted(spark.read.parquet(f"{sf_dir}/region.parquet").collect(), key=lambda r: r.r_regionkey):
        e.execute("Region", "insert", {"name": r.r_name})
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").coalesce(1)
    e.model("Nation").insert_rows(nations.select(F.col("n_name").alias("name"), (F.col("n_regionkey") + 1).cast("bigint").alias("region")))
    return e


@query("SELECT CAST(to_json({'id': CAST(n_nationkey AS BIGINT), 'name': n_name, 'region': {'id': CAST(r_regionkey AS BIGINT), 'name': r_name}}) AS VARCHAR) AS json FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_json_rows(spark, sf_dir):
    return to_json_rows(sample_state(spark, sf_dir, "Nation", "Region"), "Nation", {"id": True, "name": True, "region": True})


@query("SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, n_name AS nation, (SELECT CAST(count(*) AS BIGINT) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 7")
def q_find_by_id(spark, sf_dir):
    found = Engine(spark, SCHEMA, state=sample_state(spark, sf_dir)).model("Customer").find_by_id(7, {"id": True, "name": True, "nation": {"name": True}, "orders": {"id": True}})
    return found.select("id", "name", F.col("nation.name").alias("nation"), F.size("orders").cast("bigint").alias("n_orders"))


@query("SELECT r_name AS name, CAST(count(*) AS BIGINT) AS n_nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def q_request_body(spark, sf_dir):
    """An action by name with a body, and JSON documents as its answer."""
    answer = Engine(spark, SCHEMA, state=sample_state(spark, sf_dir)).execute("Region", "findMany", {"name": True, "nations": {}})
    return spark.createDataFrame([(d["name"], len(d["nations"])) for d in answer if all(n == {} for n in d["nations"])], "name string, n_nations long")


@query("SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS name, CAST(n_regionkey + 1 AS BIGINT) AS region_id, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def s_insert(spark, sf_dir):
    found = _geography(spark, sf_dir).model("Nation").find_many({"id": True, "name": True, "region": True})
    return found.select("id", "name", F.col("region.id").alias("region_id"), F.col("region.name").alias("region"))


@query("SELECT c_name AS name, c_acctbal AS balance, (SELECT CAST(count(*) AS BIGINT) FROM customer) AS highest, true AS numbered FROM customer")
def s_insert_rows(spark, sf_dir):
    """A batch gets ids without gaps, whatever its partitions."""
    e = _engine(spark)
    e.model("Customer").insert_rows(spark.read.parquet(f"{sf_dir}/customer.parquet").repartition(5).select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")))
    found = e.model("Customer").find_many({"id": True, "name": True, "balance": True})
    ids = found.agg(F.max(ID).alias("highest"), ((F.min(ID) == 1) & (F.max(ID) == F.count_distinct(ID)) & (F.count("*") == F.max(ID))).alias("numbered")).first()
    return found.select("name", "balance", F.lit(ids["highest"]).cast("bigint").alias("highest"), F.lit(ids["numbered"]).alias("numbered"))


@query("SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, CASE WHEN n_nationkey < 10 THEN NULL WHEN n_nationkey = 20 THEN 'renamed' ELSE n_name END AS name, CASE WHEN n_nationkey = 20 THEN NULL WHEN n_nationkey % 2 = 0 AND n_nationkey < 10 THEN 2 ELSE CAST(n_regionkey + 1 AS BIGINT) END AS region_id FROM nation")
def s_update(spark, sf_dir):
    """Patches of a batch and of a document: what is absent is kept, null clears."""
    e = _geography(spark, sf_dir)
    even = F.col(ID) % 2 == 1  # ids are one above the keys
    e.model("Nation").update_rows(spark.range(1, 11).select(ID, F.lit(None).cast("string").alias("name"), F.lit(True).alias("name__set"), F.lit(2).cast("bigint").alias("region"), even.alias("region__set")))
    e.execute("Nation", "update", {"id": 21, "name": "renamed", "region": None})
    found = e.model("Nation").find_many({"id": True, "name": True, "region": {"id": True}})
    return found.select("id", "name", F.col("region.id").alias("region_id"))


@query("SELECT r_name AS name, CAST(count(n_nationkey) AS BIGINT) AS n_nations FROM region LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) n ON n_regionkey = r_regionkey WHERE r_regionkey <> 4 GROUP BY 1")
def s_delete(spark, sf_dir):
    e = _geography(spark, sf_dir)
    e.model("Nation").delete_rows(spark.range(1, 26).where((F.col(ID) - 1) % 3 == 0))
    e.execute("Region", "delete", {"id": 5})
    return e.model("Region").find_many({"name": True, "nations": {"id": True}}).select("name", F.size("nations").cast("bigint").alias("n_nations"))


@query("SELECT * FROM (VALUES ('before', 25::BIGINT, 5::BIGINT), ('after', 24::BIGINT, 5::BIGINT)) v(moment, n_nations, n_regions)")
def s_versions(spark, sf_dir):
    """A reader of an older version sees what was there then."""
    e = _geography(spark, sf_dir)
    before = e.state(e.store.manifest().version)
    e.execute("Nation", "delete", {"id": 1})
    counted = [s.tables[m].agg(F.lit(at).alias("moment"), F.count("*").alias("n"), F.lit(m).alias("m")) for at, s in (("before", before), ("after", e.state())) for m in ("Nation", "Region")]
    rows = counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])
    n = lambda m: F.max(F.when(F.col("m") == m, F.col("n")))
    return rows.groupBy("moment").agg(n("Nation").alias("n_nations"), n("Region").alias("n_regions"))


@query("SELECT s, CAST(p AS BIGINT) AS p FROM (VALUES ('s1', 2), ('s2', 1), ('s2', 2), ('s3', 3)) v(s, p)")
def s_connect(spark, sf_dir):
    """Lists of references given on insert, replaced from either end, and read from the other."""
    e = _engine(spark)
    for name in ("s1", "s2", "s3"):
        e.execute("Supplier", "insert", {"name": name})
    for ids in ([1, 2], [2, 1], []):
        e.execute("Part", "insert", {"suppliers": [{"id": i} for i in ids]})
    e.execute("Part", "update", {"id": 1, "suppliers": [{"id": 2}, {"id": 2}]})
    e.execute("Supplier", "update", {"id": 3, "parts": [{"id": 3}]})
    found = e.model("Supplier").find_many({"name": True, "parts": {"id": True}})
    return found.select(F.col("name").alias("s"), F.explode("parts.id").alias("p"))


@query("SELECT CAST(c AS BIGINT) AS id, CAST(t AS BIGINT) AS turn, role, text FROM (VALUES (1, 1, 'a', 'x'), (1, 2, 'new', NULL), (1, 9, 'c', 'y'), (1, 10, 'd', NULL), (2, 3, 'b', NULL)) v(c, t, role, text)")
def s_struct_list(spark, sf_dir):
    """Items get ids of their own, an item with an id takes the place of the one that has it."""
    e = _engine(spark)
    e.execute("Conversation", "insert", {"turns": [{"role": "a", "text": "x"}, {"role": "b", "text": "z"}]})
    e.execute("Conversation", "insert", {"turns": [{"role": "b"}]})
    for item in ({"id": 2, "role": "new"}, {"id": 9, "role": "c", "text": "y"}, {"role": "d"}):
        e.execute("Conversation", "update", {"id": 1, "turns": [item]})
    found = e.model("Conversation").find_many({"id": True, "turns": {"id": True, "role": True, "text": True}})
    return found.select(ID, F.explode("turns").alias("t")).select(ID, F.col("t.id").alias("turn"), "t.role", "t.text")


_CHECKED = """
model Box {
  name  String
  n     Int
  u     UInt
  f     Float
  at    DateTime
  ok    Bool
  tags  String[]
  up    Box
  in    Box[]   @derived(Box.up)
  next  Box[]
  lid   Lid
  items Item[]
}
struct Lid {
  size  Int
  of    Box
}
struct Item {
  code  String
}
"""
#: Bodies of an insert, with what comes of each.
OUTCOMES = [
    ([], "NotAnObject"), ({}, "EmptyObject"), ({"nope": 1}, "EmptyObject"), ({"name": 1}, "TypeMismatch name"), ({"n": 1.5}, "TypeMismatch n"), ({"n": True}, "TypeMismatch n"), ({"n": 1 << 63}, "TypeMismatch n"), ({"u": -1}, "TypeMismatch u"),
    ({"f": 1e300}, "TypeMismatch f"), ({"at": "2025-01-01"}, "TypeMismatch at"), ({"at": "2025-01-01T00:00:00Z"}, "ok"), ({"ok": 0}, "TypeMismatch ok"), ({"tags": "x"}, "TypeMismatch tags"), ({"tags": [None]}, "ok"), ({"up": 1}, "TypeMismatch up"),
    ({"up": {"id": 1}}, "ok up:Box:1"), ({"in": []}, "DerivedFieldReadOnly"), ({"next": None}, "TypeMismatch next"), ({"next": [{"id": 2}, {"id": 2}]}, "ok next:Box:2"), ({"next": [{"id": 1}, {}]}, "TypeMismatch next[1]"), ({"lid": 3}, "NotAnObject"),
    ({"lid": {"size": "x"}}, "TypeMismatch lid.size"), ({"lid": {"of": {"id": 4}}}, "ok lid.of:Box:4"), ({"lid": None}, "ok"), ({"items": None}, "TypeMismatch items"), ({"items": [{"code": "a"}]}, "ok"), ({"name": None}, "ok"),
]


def _outcome(body: object) -> str:
    schema = parse_schema(_CHECKED)
    try:
        found = validate_document(schema, schema.model("Box"), body)
    except EngineError as e:
        return " ".join([type(e).__name__, *([e.field] if hasattr(e, "field") else [])])
    return " ".join(["ok", *(":".join(map(str, k)) for k in found.keys)])


@query("SELECT CAST(c AS BIGINT) AS c, outcome FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, (_, x) in enumerate(OUTCOMES)) + ") v(c, outcome)")
def v_outcomes(spark, sf_dir):
    """What the rules make of one body after another."""
    return spark.createDataFrame([(i, _outcome(body)) for i, (body, _) in enumerate(OUTCOMES)], "c long, outcome string")


@query("SELECT CAST(c AS BIGINT) AS c, outcome FROM (VALUES (0, '0'), (1, 'IdRequired'), (2, 'IdRequired'), (3, 'IdRequired'), (4, '7')) v(c, outcome)")
def v_document_id(spark, sf_dir):
    def outcome(body: object) -> str:
        try:
            return str(document_id(body))
        except EngineError as e:
            return type(e).__name__

    return spark.createDataFrame([(i, outcome(b)) for i, b in enumerate(({"id": 0}, {}, {"id": -1}, {"id": "1"}, {"id": 7, "name": "x"}))], "c long, outcome string")


@query("SELECT * FROM (VALUES ('Nation', 'region', 6::BIGINT)) v(model, field, id)")
def v_key_of_an_insert(spark, sf_dir):
    """A reference to a row that isn't there refuses the document that holds it, and nothing is written."""
    from .errors import ForeignKeyViolation

    e, rows = _geography(spark, sf_dir), []
    version = e.store.manifest().version
    try:
        e.execute("Nation", "insert", {"name": "x", "region": {"id": 6}})
    except ForeignKeyViolation as error:
        rows = [("Nation", error.field, error.id)] if e.store.manifest().version == version else []
    return spark.createDataFrame(rows, "model string, field string, id long")
