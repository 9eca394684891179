"""Changes to documents, each a function from a state and a frame of requests to the next state.  Nothing is written here.

Requests come as frames, so that a batch of any size costs one plan.  All joins are on ids; none sends a table that grows with
the data to every executor unless Spark itself finds it small.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RestrictedDelete
from ..plans.compile import State
from ..schema import ID

#: Bits of monotonically_increasing_id() that number the rows of a partition.
_ROW_BITS = 33


def number_rows(rows: DataFrame, after: int, name: str = ID) -> DataFrame:
    """``rows`` with ids ``after`` + 1, + 2, ... and no gaps.

    Only the row counts of partitions are gathered; no row moves.  ``rows`` must give the same partitions when it is run
    again: a table that was read, or a checkpoint.
    """
    placed = rows.withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", _ROW_BITS)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    joined = placed.withColumn("__of", part).join(F.broadcast(starts), F.col("__of") == F.col("__part"))
    return joined.withColumn(name, F.lit(after + 1) + F.col("__before") + F.col("__at").bitwiseAND((1 << _ROW_BITS) - 1)).drop("__at", "__of", "__part", "__before")


def _shaped(state: State, model: str, rows: DataFrame) -> DataFrame:
    """All columns of the model's table, null where ``rows`` has none."""
    table = state.tables[model]
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema))


def insert(state: State, model: str, rows: DataFrame) -> State:
    """Add ``rows``, which have ids that the table lacks."""
    return state.changed({model: state.tables[model].unionByName(_shaped(state, model, rows))})


def missing(state: State, model: str, ids: DataFrame) -> DataFrame:
    """Those of ``ids`` that the model has no row of."""
    return ids.select(ID).join(state.tables[model].select(ID), ID, "left_anti")


def _patched(path: Column, old: str, kind, sets: dict[str, Column], new: Column) -> Column:
    """An embedded struct with the named fields replaced, the others kept; all of them null where there was none."""
    return F.struct(*((F.when(sets[f.name], new[f.name]).otherwise(path[f.name]) if f.name in sets else path[f.name]).alias(f.name) for f in kind.fields))


def patch(state: State, model: str, patches: DataFrame) -> State:
    """Set fields of rows by id.  For a field ``f``, ``patches`` has ``f`` and the boolean ``f__set``, which tells a null that is
    to be stored from a field that is to be kept.  A to-one struct is replaced as a whole, or, if there is also a struct of
    booleans ``f__fields``, field by field; a null removes it.  Ids occur once; those without a row do nothing.
    """
    table = state.tables[model]
    fields = [c.removesuffix("__set") for c in patches.columns if c.endswith("__set")]
    names = {c: f"__p_{c}" for c in patches.columns if c != ID}
    joined = table.join(patches.withColumnsRenamed(names | {ID: "__p"}), F.col(ID) == F.col("__p"), "left")
    out = []
    for column in table.schema:
        old = F.col(column.name)
        if column.name not in fields:
            out.append(old)
            continue
        new = F.col(f"__p_{column.name}").cast(column.dataType)
        if f"{column.name}__fields" in names:
            mask = F.col(f"__p_{column.name}__fields")
            sets = {f.name: F.coalesce(mask[f.name], F.lit(False)) for f in patches.schema[f"{column.name}__fields"].dataType.fields}
            new = F.when(new.isNotNull(), _patched(old, column.name, column.dataType, sets, new))
        out.append(F.when(F.coalesce(F.col(f"__p_{column.name}__set"), F.lit(False)), new).otherwise(old).alias(column.name))
    return state.changed({model: joined.select(*out)})


def _tagged(n: int, item: Column) -> Column:
    return F.struct(item[ID].alias(ID), F.lit(n).alias("new"), item.alias("item"))


def upsert_items(state: State, model: str, name: str, requests: DataFrame) -> State:
    """Struct list ``name``: ``requests`` has id and ``items``, whose ids are all given.  An item with the id of an old one
    takes its place as a whole, others are added, and an empty array clears the list.  A null array does nothing.
    """
    table = state.tables[model]
    kind = table.schema[name].dataType
    joined = table.join(requests.select(F.col(ID).alias("__p"), F.col("items").cast(kind).alias("__items")), F.col(ID) == F.col("__p"), "left")
    old, new = F.coalesce(F.col(name), F.array().cast(kind)), F.col("__items")
    # sorted by id, an old item before the new one that takes its place
    tagged = [F.transform(x, partial(_tagged, n)) for n, x in enumerate((old, new))]
    by_id = lambda a, b: F.when((a[ID] < b[ID]) | ((a[ID] == b[ID]) & (a["new"] < b["new"])), -1).when((a[ID] == b[ID]) & (a["new"] == b["new"]), 0).otherwise(1)
    last = lambda s: F.filter(s, lambda x, i: (i + 1 == F.size(s)) | (s[F.least(i + 1, F.size(s) - 1)][ID] != x[ID]))
    merged = F.transform(F.array(F.array_sort(F.concat(*tagged), by_id)), last)[0]
    value = F.when(new.isNull(), F.col(name)).when(F.size(new) == 0, F.array().cast(kind)).otherwise(F.transform(merged, lambda x: x["item"]))
    return state.changed({model: joined.select(*(value.alias(name) if c == name else F.col(c) for c in table.columns))})


def replace_edges(state: State, edge_set: str, owners: DataFrame, pairs: DataFrame, backwards: bool = False) -> State:
    """The edges of each id in ``owners`` become those that ``pairs`` (owner, other) has of it; both directions see it, since
    there is one table.  ``backwards``: owners are the ``dst`` side.  Repeated pairs count once.
    """
    own, other = ("dst", "src") if backwards else ("src", "dst")
    edges = state.edges[edge_set]
    kept = edges.join(owners.select(F.col(ID).alias(own)), own, "left_anti").select("src", "dst")
    new = pairs.select(F.col("owner").alias(own), F.col("other").alias(other)).select("src", "dst").distinct()
    return state.changed(edges={edge_set: kept.unionByName(new)})


def delete(state: State, model: str, ids: DataFrame, on_delete: str = "detach") -> State:
    """Rows go with their structs and edges.  Keys that refer to them stay and read as null; with ``on_delete`` 'restrict', keys and
    lists of other rows that refer to them forbid it.  Ids without a row do nothing."""
    gone = ids.select(F.col(ID).alias("__gone")).distinct()
    if on_delete == "restrict":
        for other in state.schema.models.values():
            for path, f in state.schema.foreign_keys(other):
                if f.type != model:
                    continue
                head, _, tail = path.partition(".")
                key = F.explode(F.col(head)[tail]) if tail and other[head].kind == "struct_list" else F.col(path)
                rows = state.tables[other.name] if other.name != model else state.tables[model].join(gone, F.col(ID) == F.col("__gone"), "left_anti")
                if rows.select(key.alias("__key")).join(gone, F.col("__key") == F.col("__gone"), "left_semi").head(1):
                    raise RestrictedDelete(f"{other.name}.{path} refers to it")
        for name, f in state.schema.edge_sets().items():
            if f.type != model or name not in state.edges:
                continue
            held = state.edges[name].join(gone, F.col("dst") == F.col("__gone"), "left_semi")
            if name.partition(".")[0] == model:  # lists that go themselves forbid nothing
                held = held.join(gone, F.col("src") == F.col("__gone"), "left_anti")
            if held.head(1):
                raise RestrictedDelete(f"{name} refers to it")
    tables = {model: state.tables[model].join(gone, F.col(ID) == F.col("__gone"), "left_anti")}
    edges = {}
    for name, f in state.schema.edge_sets().items():
        table = state.edges.get(name)
        if table is None:
            continue
        for side, of in (("src", name.partition(".")[0]), ("dst", f.type)):
            if of == model:
                table = edges[name] = table.join(gone, F.col(side) == F.col("__gone"), "left_anti")
    return state.changed(tables, edges)
