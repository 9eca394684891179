"""Every query with SQL against DuckDB, plan checks, and random projections against a small interpreter."""

import random
import re

import duckdb
import pytest

import fernweave.stored  # noqa: F401  adds its queries
from fernweave.plans.compile import State, find_many, to_json_rows
from fernweave.schema import parse_schema
from fernweave.warehouse import ORACLES, QUERIES, flagship

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents labels conversations".split():
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    want = sql.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    key = lambda row: [(x is None, x if x is not None else 0) for x in row]
    assert sorted(map(tuple, df.select(*columns).collect()), key=key) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)


def test_flagship_reads_what_it_needs(spark):
    plan = flagship(spark, SF)._jdf.queryExecution().executedPlan().toString()
    for table, columns in {"l_quantity": {"l_orderkey", "l_partkey", "l_quantity", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate"}, "o_totalprice": {"o_orderkey", "o_custkey", "o_totalprice"}, "c_name": {"c_custkey", "c_name", "c_nationkey"}}.items():
        scan = next(s for s in re.findall(r"FileScan parquet \[([^\]]*)\]", plan) if table in s)
        assert {c.split("#")[0] for c in scan.split(",")} <= columns
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_condition_reaches_the_scan(spark):
    from fernweave.warehouse import sample_state

    df = find_many(sample_state(spark, SF, "Customer", "Order"), "Customer", {"orders": {"id": True}}, where="id = 5")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_custkey,5)" in plan and "EqualTo(o_custkey,5)" in plan


def test_condition_reaches_targets(spark):
    """Targets of a key and of a list are read for the rows that are left alone: their tables are joined to the keys that these name."""
    from fernweave.warehouse import sample_state

    state = sample_state(spark, SF, "Customer", "Order", "Part", "Supplier")
    for model, select, key in (("Order", {"customer": {"name": True}}, "c_custkey"), ("Part", {"suppliers": {"name": True}}, "s_suppkey")):
        plan = find_many(state, model, select, where="id = 5")._jdf.queryExecution().optimizedPlan().toString()
        semi = [line for line in plan.splitlines() if "LeftSemi" in line]
        assert any(re.search(rf"{key}#\d+L? = n\d+_in", line) for line in semi)
    order = find_many(state, "Order", {"id": True, "customer": {"id": True}}, where="id % 100 = 3").collect()
    assert order and all(r.customer is not None for r in order)


SCHEMA = """
model A {
  x   Int
  b   B
  bs  B[]
  as  A[]
  s   S
  l   S[]
}
model B {
  y   String
  a   A
  of  A[]  @derived(A.b)
  in  A[]  @derived(A.bs)
}
struct S {
  n   Int
  b   B
}
"""


def _interpret(schema, data, edges, block, row, body):
    out = {}
    boolean = isinstance(body, bool)
    if boolean or body.get("id") is True:
        out["id"] = row["id"]
    for f in block.fields:
        primitive = f.kind == "primitive"
        if boolean and not primitive or not boolean and (f.name not in body or body[f.name] is False):
            continue
        if primitive:
            out[f.name] = row[f.name]
            continue
        sub, target = body[f.name], schema.block(f)
        go = lambda r, t=target, s=sub: _interpret(schema, data, edges, t, r, s)
        if f.kind == "struct":
            value = row[f.name] and go(row[f.name] | {"id": row["id"]})
            if value and sub is True:
                value.pop("id")
        elif f.kind == "struct_list":
            value = [go(i) for i in sorted(row[f.name] or [], key=lambda i: i["id"])]
        elif f.kind == "ref":
            value = go(data[f.type][row[f.name]]) if row[f.name] in data[f.type] else None
        else:
            if f.derived and schema.models[f.derived[0]][f.derived[1]].kind == "ref":
                ids = [i for i, r in data[f.type].items() if r[f.derived[1]] == row["id"]]
            elif f.derived:
                ids = [s for s, d in edges[".".join(f.derived)] if d == row["id"]]
            else:
                ids = [d for s, d in edges[f"{block.name}.{f.name}"] if s == row["id"]]
            value = [go(data[f.type][i]) for i in sorted(ids) if i in data[f.type]]
        out[f.name] = value
    return out


def _random_select(rng, schema, block, depth):
    if depth == 0 or rng.random() < 0.15:
        return True
    out = {"id": True} if rng.random() < 0.6 else {}
    for f in block.fields:
        if rng.random() < 0.5:
            out[f.name] = rng.choice([True, 1, False]) if f.kind == "primitive" else _random_select(rng, schema, schema.block(f), depth - 1)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_random_projections(spark, seed):
    import json

    rng, schema = random.Random(seed), parse_schema(SCHEMA)
    maybe = lambda x: x if rng.random() < 0.8 else None
    s = lambda: {"n": maybe(rng.randrange(9)), "b": maybe(rng.randrange(7))}
    data = {
        "A": {i: {"id": i, "x": maybe(i * 10), "b": maybe(rng.randrange(7)), "s": maybe(s()), "l": maybe([{"id": j} | s() for j in rng.sample(range(9), rng.randrange(4))])} for i in range(8)},
        "B": {i: {"id": i, "y": maybe(f"y{i}"), "a": maybe(rng.randrange(10))} for i in range(6)},
    }
    edges = {"A.bs": sorted({(rng.randrange(8), rng.randrange(7)) for _ in range(12)}), "A.as": sorted({(rng.randrange(8), rng.randrange(9)) for _ in range(9)})}
    frame = lambda m: spark.createDataFrame([tuple(tuple(v.values()) if isinstance(v, dict) else [tuple(i.values()) for i in v] if isinstance(v, list) else v for v in r.values()) for r in data[m].values()], schema.struct_type(schema.models[m]))
    state = State(schema, {m: frame(m) for m in data}, {k: spark.createDataFrame(v, "src long, dst long") for k, v in edges.items()})
    for model in data:
        body = _random_select(rng, schema, schema.models[model], 3)
        got = [json.loads(r[0]) for r in to_json_rows(state, model, body).collect()]
        assert got == [_interpret(schema, data, edges, schema.models[model], r, body) for r in data[model].values()], body
