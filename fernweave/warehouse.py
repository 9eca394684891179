"""The sample tables as models, and the queries over them with the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import mutate
from .operators.validate import foreign_key_violations
from .plans.compile import State, find_many
from .schema import ID, parse_schema
from .sources.binding import Binding, bind, instant
from .staging import checkpointed

SCHEMA = """
model Region {
  name        String
  nations     Nation[]    @derived(Nation.region)
}
model Nation {
  name        String
  region      Region
  customers   Customer[]  @derived(Customer.nation)
  suppliers   Supplier[]  @derived(Supplier.nation)
}
model Customer {
  name        String
  balance     Double
  segment     String
  nation      Nation
  orders      Order[]     @derived(Order.customer)
  events      Event[]     @derived(Event.user)
}
model Supplier {
  name        String
  balance     Double
  nation      Nation
  lines       Line[]      @derived(Line.supplier)
  parts       Part[]      @derived(Part.suppliers)
}
model Part {
  name        String
  brand       String
  kind        String
  size        Int
  price       Double
  lines       Line[]      @derived(Line.part)
  suppliers   Supplier[]
}
model Order {
  status      String
  totalPrice  Double
  orderDate   DateTime
  priority    String
  customer    Customer
  lines       Line[]      @derived(Line.order)
}
model Line {
  number      Int
  quantity    Double
  price       Double
  discount    Double
  tax         Double
  returnFlag  String
  lineStatus  String
  shipDate    DateTime
  order       Order
  part        Part
  supplier    Supplier
}
model Event {
  ts          DateTime
  kind        String
  value       Double
  props       Props
  user        Customer
}
struct Props {
  k           Int
}
model Document {
  text        String
  lang        String
  source      String
  charCount   Int
  label       Label
}
struct Label {
  quality     Int
  toxic       Int
}
model Conversation {
  turns       Turn[]
}
struct Turn {
  role        String
  text        String
}
model Embedding {
  label       Int
  vector      Float[]
}
model Page {
  url         String
  html        String
}
model Benchmark {
  text        String
}
"""


def sample_state(spark: SparkSession, sf_dir: str, *models: str) -> State:
    """The sample tables bound to the models; only those in ``models`` if any are named, the others are empty.

    A line's id is a hash of what tells lines apart, as the table has no key of its own.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    wanted = lambda name: not models or name in models
    line_id = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").bitwiseAND((1 << 63) - 1)
    bindings: dict[str, Callable[[], Binding]] = {
        "Region": lambda: Binding(read("region"), {ID: "r_regionkey", "name": "r_name"}),
        "Nation": lambda: Binding(read("nation"), {ID: "n_nationkey", "name": "n_name", "region": "n_regionkey"}),
        "Customer": lambda: Binding(read("customer"), {ID: "c_custkey", "name": "c_name", "balance": "c_acctbal", "segment": "c_mktsegment", "nation": "c_nationkey"}),
        "Supplier": lambda: Binding(read("supplier"), {ID: "s_suppkey", "name": "s_name", "balance": "s_acctbal", "nation": "s_nationkey"}),
        "Part": lambda: Binding(read("part"), {ID: "p_partkey", "name": "p_name", "brand": "p_brand", "kind": "p_type", "size": "p_size", "price": "p_retailprice"}),
        "Order": lambda: Binding(read("orders"), {ID: "o_orderkey", "status": "o_orderstatus", "totalPrice": "o_totalprice", "orderDate": instant("o_orderdate"), "priority": "o_orderpriority", "customer": "o_custkey"}),
        "Line": lambda: Binding(
            read("lineitem"),
            {ID: line_id, "number": "l_linenumber", "quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "returnFlag": "l_returnflag", "lineStatus": "l_linestatus", "shipDate": instant("l_shipdate"), "order": "l_orderkey", "part": "l_partkey", "supplier": "l_suppkey"},
        ),
        "Event": lambda: Binding(read("events"), {ID: "event_id", "ts": instant("ts"), "kind": "event_type", "value": "value", "props": F.from_json("props", "k long"), "user": "user_id"}),
        "Document": lambda: Binding(
            read("documents").join(read("labels").select(F.col("doc_id").alias("of"), F.struct("quality", "toxic").alias("label")), F.col("doc_id") == F.col("of"), "left"),
            {ID: "doc_id", "text": "text", "lang": "lang", "source": "source", "charCount": "n_chars", "label": "label"},
        ),
        "Conversation": lambda: Binding(read("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").alias(ID), "role", "text"))).alias("turns")), {ID: "conv_id", "turns": "turns"}),
        "Embedding": lambda: Binding(read("embeddings"), {ID: "vec_id", "label": "label", "vector": "embedding"}),
        "Page": lambda: Binding(read("pages"), {ID: "page_id", "url": "url", "html": "html"}),
        "Benchmark": lambda: Binding(read("benchmark"), {ID: "item_id", "text": "text"}),
    }
    edges = {"Part.suppliers": read("lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))} if wanted("Part") else {}
    return bind(spark, parse_schema(SCHEMA), {k: make() for k, make in bindings.items() if wanted(k)}, edges)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


@query("SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region")
def q_scan_all(spark, sf_dir):
    return find_many(sample_state(spark, sf_dir, "Region"), "Region", True)


@query("SELECT p_partkey AS id, p_name AS name, p_retailprice AS price FROM part")
def q_project(spark, sf_dir):
    return find_many(sample_state(spark, sf_dir, "Part"), "Part", {"id": True, "name": True, "price": True})


@query("SELECT p_name AS name FROM part")
def q_project_no_id(spark, sf_dir):
    return find_many(sample_state(spark, sf_dir, "Part"), "Part", {"name": True, "brand": False, "nope": True})


@query("SELECT o_orderkey AS id, CAST(epoch_us(o_orderdate) // 1000 AS BIGINT) AS order_date FROM orders")
def q_datetime(spark, sf_dir):
    return find_many(sample_state(spark, sf_dir, "Order"), "Order", {"id": True, "orderDate": True}).select("id", F.col("orderDate").alias("order_date"))


@query("SELECT event_id AS id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts FROM events")
def q_datetime_us(spark, sf_dir):
    return find_many(sample_state(spark, sf_dir, "Event"), "Event", {"id": True, "ts": True})


@query("SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS number, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_returnflag AS return_flag, l_linestatus AS line_status, CAST(epoch_us(l_shipdate) // 1000 AS BIGINT) AS ship_date FROM lineitem")
def q_scan_lines(spark, sf_dir):
    fields = ["number", "quantity", "price", "discount", "tax", "returnFlag", "lineStatus", "shipDate"]
    out = find_many(sample_state(spark, sf_dir, "Line", "Order"), "Line", dict.fromkeys(fields, True) | {"order": {"id": True}})
    return out.select(F.col("order.id").alias("order_id"), "number", "quantity", "price", "discount", "tax", F.col("returnFlag").alias("return_flag"), F.col("lineStatus").alias("line_status"), F.col("shipDate").alias("ship_date"))


@query("SELECT o_orderkey AS id, o_totalprice AS total_price, c_name AS customer_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def q_to_one(spark, sf_dir):
    out = find_many(sample_state(spark, sf_dir, "Order", "Customer"), "Order", {"id": True, "totalPrice": True, "customer": {"name": True}})
    return out.select("id", F.col("totalPrice").alias("total_price"), F.col("customer.name").alias("customer_name"))


@query("SELECT c_custkey AS id, n_name AS nation, CAST(r_regionkey AS BIGINT) AS region_id, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def q_to_one_chain(spark, sf_dir):
    out = find_many(sample_state(spark, sf_dir, "Customer", "Nation", "Region"), "Customer", {"id": True, "nation": {"name": True, "region": True}})
    return out.select("id", F.col("nation.name").alias("nation"), F.col("nation.region.id").alias("region_id"), F.col("nation.region.name").alias("region"))


@query("SELECT c_custkey AS id, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS pos, o_orderkey AS order_id FROM customer JOIN orders ON o_custkey = c_custkey")
def q_reverse(spark, sf_dir):
    out = find_many(sample_state(spark, sf_dir, "Customer", "Order"), "Customer", {"id": True, "orders": {"id": True}})
    return out.select("id", F.posexplode("orders").alias("pos", "o")).select("id", F.col("pos").cast("bigint").alias("pos"), F.col("o.id").alias("order_id"))


@query("SELECT o_orderkey AS id, CAST(count(l_orderkey) AS BIGINT) AS n_lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def q_reverse_empty(spark, sf_dir):
    out = find_many(sample_state(spark, sf_dir, "Order", "Line"), "Order", {"id": True, "lines": {"id": True}})
    return out.select("id", F.size("lines").cast("bigint").alias("n_lines"))


@query("SELECT CAST(r_regionkey AS BIGINT) AS region_id, CAST(n_nationkey AS BIGINT) AS nation_id, c_custkey AS customer_id, CAST(count(o_orderkey) AS BIGINT) AS n_orders FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def q_nested3(spark, sf_dir):
    select = {"id": True, "nations": {"id": True, "customers": {"id": True, "orders": {"id": True}}}}
    out = find_many(sample_state(spark, sf_dir, "Region", "Nation", "Customer", "Order"), "Region", select)
    out = out.select(F.col("id").alias("region_id"), F.explode("nations").alias("n")).select("region_id", F.col("n.id").alias("nation_id"), F.explode("n.customers").alias("c"))
    return out.select("region_id", "nation_id", F.col("c.id").alias("customer_id"), F.size("c.orders").cast("bigint").alias("n_orders"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, (SELECT CAST(count(*) AS BIGINT) FROM customer WHERE c_nationkey = n_nationkey) AS n_customers, (SELECT CAST(count(*) AS BIGINT) FROM supplier WHERE s_nationkey = n_nationkey) AS n_suppliers FROM nation")
def q_siblings(spark, sf_dir):
    out = find_many(sample_state(spark, sf_dir, "Nation", "Customer", "Supplier"), "Nation", {"id": True, "customers": {"id": True}, "suppliers": {"id": True}})
    return out.select("id", F.size("customers").cast("bigint").alias("n_customers"), F.size("suppliers").cast("bigint").alias("n_suppliers"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, c_custkey AS customer_id, CAST(c_nationkey AS BIGINT) AS back_id FROM nation JOIN customer ON c_nationkey = n_nationkey")
def q_cycle(spark, sf_dir):
    out = find_many(sample_state(spark, sf_dir, "Nation", "Customer"), "Nation", {"id": True, "customers": {"id": True, "nation": {"id": True}}})
    return out.select("id", F.explode("customers").alias("c")).select("id", F.col("c.id").alias("customer_id"), F.col("c.nation.id").alias("back_id"))


@query("SELECT d.doc_id AS id, CAST(l.quality AS BIGINT) AS quality, CAST(l.toxic AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def q_struct_one(spark, sf_dir):
    return find_many(sample_state(spark, sf_dir, "Document"), "Document", {"id": True, "label": True}).select("id", "label.quality", "label.toxic")


@query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, c_name AS user_name FROM events LEFT JOIN customer ON user_id = c_custkey")
def q_struct_json(spark, sf_dir):
    out = find_many(sample_state(spark, sf_dir, "Event", "Customer"), "Event", {"id": True, "props": True, "user": {"name": True}})
    return out.select("id", F.col("props.k").alias("k"), F.col("user.name").alias("user_name"))


@query("SELECT conv_id AS id, turn AS turn_id, role FROM conversations")
def q_struct_list(spark, sf_dir):
    out = find_many(sample_state(spark, sf_dir, "Conversation"), "Conversation", {"id": True, "turns": {"id": True, "role": True}})
    return out.select("id", F.explode("turns").alias("t")).select("id", F.col("t.id").alias("turn_id"), F.col("t.role").alias("role"))


@query("SELECT DISTINCT l_partkey AS id, l_suppkey AS supplier_id FROM lineitem")
def q_edges_forward(spark, sf_dir):
    out = find_many(sample_state(spark, sf_dir, "Part", "Supplier"), "Part", {"id": True, "suppliers": {"id": True}})
    return out.select("id", F.explode("suppliers").alias("s")).select("id", F.col("s.id").alias("supplier_id"))


@query("SELECT s_suppkey AS id, CAST(count(DISTINCT l_partkey) AS BIGINT) AS n_parts FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1")
def q_edges_inverse(spark, sf_dir):
    out = find_many(sample_state(spark, sf_dir, "Part", "Supplier"), "Supplier", {"id": True, "parts": {"id": True}})
    return out.select("id", F.size("parts").cast("bigint").alias("n_parts"))


@query("SELECT l_orderkey AS id, p_name AS part, s_name AS supplier FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def q_join_model(spark, sf_dir):
    out = find_many(sample_state(spark, sf_dir, "Order", "Line", "Part", "Supplier"), "Order", {"id": True, "lines": {"part": {"name": True}, "supplier": {"name": True}}})
    return out.select("id", F.explode("lines").alias("l")).select("id", F.col("l.part.name").alias("part"), F.col("l.supplier.name").alias("supplier"))


@query("SELECT c_custkey AS id, c_acctbal AS balance, CAST(count(o_orderkey) AS BIGINT) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9000 GROUP BY ALL ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def q_where_top(spark, sf_dir):
    """Condition, order and limit on the root: an addition to plain projections."""
    out = find_many(sample_state(spark, sf_dir, "Customer", "Order"), "Customer", {"id": True, "balance": True, "orders": {"id": True}}, where=F.col("balance") > 9000, order_by=["-balance"], limit=20)
    return out.select("id", "balance", F.size("orders").cast("bigint").alias("n_orders"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey % 7 AS BIGINT) AS region FROM nation WHERE n_nationkey % 7 NOT IN (SELECT r_regionkey FROM region)")
def q_fk_violations(spark, sf_dir):
    state = sample_state(spark, sf_dir, "Region", "Nation")
    return foreign_key_violations(state, state.tables["Nation"].select(ID, (F.col(ID) % 7).alias("region")), "region", "Region")


@query("SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region UNION ALL SELECT 1 + (SELECT CAST(max(r_regionkey) AS BIGINT) FROM region), 'ATLANTIS'")
def m_insert(spark, sf_dir):
    state = sample_state(spark, sf_dir, "Region")
    after = state.tables["Region"].agg(F.max(ID)).first()[0]
    new = mutate.number_rows(spark.range(1).select(F.lit("ATLANTIS").alias("name")), after)
    return find_many(mutate.insert(state, "Region", new), "Region", True)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS balance FROM customer")
def m_patch(spark, sf_dir):
    state = sample_state(spark, sf_dir, "Customer")
    even, third = F.col(ID) % 2 == 0, F.col(ID) % 3 == 0
    patches = state.tables["Customer"].where(even | third).select(ID, F.lit(None).cast("string").alias("name"), even.alias("name__set"), F.lit(0.0).alias("balance"), third.alias("balance__set"))
    return find_many(mutate.patch(state, "Customer", patches), "Customer", {"id": True, "name": True, "balance": True})


@query("SELECT CAST(x AS BIGINT) AS id FROM range(1490, 1510) t(x) WHERE x NOT IN (SELECT c_custkey FROM customer)")
def m_patch_missing(spark, sf_dir):
    return mutate.missing(sample_state(spark, sf_dir, "Customer"), "Customer", spark.range(1490, 1510))


def _without_tenths(spark, sf_dir, *models):
    state = sample_state(spark, sf_dir, *models)
    return mutate.delete(state, "Customer", state.tables["Customer"].where(F.col(ID) % 10 == 0))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 10 <> 0")
def m_delete(spark, sf_dir):
    return find_many(_without_tenths(spark, sf_dir, "Customer"), "Customer", {"id": True, "name": True})


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS customer_id FROM orders")
def m_delete_dangling(spark, sf_dir):
    return find_many(_without_tenths(spark, sf_dir, "Customer", "Order"), "Order", {"id": True, "customer": {"id": True}}).select("id", F.col("customer.id").alias("customer_id"))


@query("SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(count(n_nationkey) AS BIGINT) AS n FROM region LEFT JOIN (SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN 1 ELSE n_regionkey END AS k FROM nation) ON k = r_regionkey GROUP BY 1")
def m_reparent(spark, sf_dir):
    state = sample_state(spark, sf_dir, "Region", "Nation")
    patches = spark.range(1).select(ID, F.lit(1).cast("bigint").alias("region"), F.lit(True).alias("region__set"))
    out = find_many(mutate.patch(state, "Nation", patches), "Region", {"id": True, "nations": {"id": True}})
    return out.select("id", F.size("nations").cast("bigint").alias("n"))


@query("SELECT DISTINCT l_suppkey AS supplier_id, l_partkey AS part_id FROM lineitem WHERE l_partkey <> 1 UNION SELECT s, 1 FROM (VALUES (2::BIGINT),(3::BIGINT)) v(s)")
def m_connect_replace(spark, sf_dir):
    state = sample_state(spark, sf_dir, "Part", "Supplier")
    owner, pairs = spark.range(1, 2), spark.range(2, 4).select(F.lit(1).cast("bigint").alias("owner"), F.col("id").alias("other"))
    out = find_many(mutate.replace_edges(state, "Part.suppliers", owner, pairs), "Supplier", {"id": True, "parts": {"id": True}})
    return out.select(F.col("id").alias("supplier_id"), F.explode("parts").alias("p")).select("supplier_id", F.col("p.id").alias("part_id"))


def _turns(state: State, *fields: str) -> DataFrame:
    out = find_many(state, "Conversation", {"id": True, "turns": dict.fromkeys(("id", *fields), True)}).select("id", F.explode("turns").alias("t"))
    return out.select("id", F.col("t.id").alias("turn_id"), *(F.col(f"t.{f}").alias(f) for f in fields))


@query("SELECT conv_id AS id, turn AS turn_id, CASE WHEN turn = 0 THEN 'edited' ELSE role END AS role, CASE WHEN turn = 0 THEN NULL ELSE text END AS text FROM conversations")
def m_struct_upsert(spark, sf_dir):
    state = sample_state(spark, sf_dir, "Conversation")
    item = F.struct(F.lit(0).cast("bigint").alias(ID), F.lit("edited").alias("role"), F.lit(None).cast("string").alias("text"))
    return _turns(mutate.upsert_items(state, "Conversation", "turns", state.tables["Conversation"].select(ID, F.array(item).alias("items"))), "role", "text")


@query("SELECT conv_id AS id, turn AS turn_id, role FROM conversations UNION ALL SELECT conv_id, (SELECT max(turn) FROM conversations) + row_number() OVER (ORDER BY conv_id), 'note' FROM (SELECT DISTINCT conv_id FROM conversations)")
def m_struct_append(spark, sf_dir):
    state = sample_state(spark, sf_dir, "Conversation")
    table = state.tables["Conversation"]
    highest = table.select(F.explode("turns.id").alias("t")).agg(F.max("t")).first()[0]
    numbered = mutate.number_rows(checkpointed(table.select(F.col(ID).alias("of")).orderBy("of")), highest, "item")
    item = F.struct(F.col("item").alias(ID), F.lit("note").alias("role"), F.lit(None).cast("string").alias("text"))
    return _turns(mutate.upsert_items(state, "Conversation", "turns", numbered.select(F.col("of").alias(ID), F.array(item).alias("items"))), "role")


@query("SELECT conv_id AS id, CAST(count(*) FILTER (conv_id % 2 <> 0) AS BIGINT) AS n_turns FROM conversations GROUP BY 1")
def m_struct_clear(spark, sf_dir):
    state = sample_state(spark, sf_dir, "Conversation")
    table = state.tables["Conversation"]
    requests = table.where(F.col(ID) % 2 == 0).select(ID, F.array().cast(table.schema["turns"].dataType).alias("items"))
    out = find_many(mutate.upsert_items(state, "Conversation", "turns", requests), "Conversation", {"id": True, "turns": {"id": True}})
    return out.select("id", F.size("turns").cast("bigint").alias("n_turns"))


@query("SELECT d.doc_id AS id, CASE WHEN d.doc_id % 2 <> 0 THEN CAST(l.quality AS BIGINT) END AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def m_struct_null(spark, sf_dir):
    state = sample_state(spark, sf_dir, "Document")
    table = state.tables["Document"]
    patches = table.where(F.col(ID) % 2 == 0).select(ID, F.lit(None).cast(table.schema["label"].dataType).alias("label"), F.lit(True).alias("label__set"))
    return find_many(mutate.patch(state, "Document", patches), "Document", {"id": True, "label": {"quality": True}}).select("id", "label.quality")


@query("SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NULL AND d.doc_id % 2 = 0 THEN 9 WHEN d.doc_id % 2 = 0 THEN 9 ELSE CAST(l.quality AS BIGINT) END AS quality, CAST(l.toxic AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def m_struct_patch(spark, sf_dir):
    """A field of an embedded struct is set, the other is kept; a struct that wasn't there is made."""
    state = sample_state(spark, sf_dir, "Document")
    patches = state.tables["Document"].where(F.col(ID) % 2 == 0).select(
        ID, F.struct(F.lit(9).cast("bigint").alias("quality"), F.lit(None).cast("bigint").alias("toxic")).alias("label"), F.lit(True).alias("label__set"), F.struct(F.lit(True).alias("quality")).alias("label__fields")
    )
    return find_many(mutate.patch(state, "Document", patches), "Document", {"id": True, "label": True}).select("id", "label.quality", "label.toxic")


#: Customers with their nation, region, orders, lines and parts, in one plan.
FLAGSHIP = {"id": True, "name": True, "nation": {"name": True, "region": True}, "orders": {"id": True, "totalPrice": True, "lines": {"quantity": True, "part": {"name": True}}}}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_many(sample_state(spark, sf_dir, "Customer", "Nation", "Region", "Order", "Line", "Part"), "Customer", FLAGSHIP)


@query("SELECT c_custkey AS id, n_name AS nation, r_name AS region, o_orderkey AS order_id, o_totalprice AS total_price, l_quantity AS quantity, p_name AS part FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey")
def q_flagship(spark, sf_dir):
    out = flagship(spark, sf_dir).select("id", F.col("nation.name").alias("nation"), F.col("nation.region.name").alias("region"), F.explode("orders").alias("o"))
    out = out.select("id", "nation", "region", F.col("o.id").alias("order_id"), F.col("o.totalPrice").alias("total_price"), F.explode("o.lines").alias("l"))
    return out.select("id", "nation", "region", "order_id", "total_price", F.col("l.quantity").alias("quantity"), F.col("l.part.name").alias("part"))
