"""From a projection tree to one DataFrame plan.

Every node of the tree becomes a frame of its key, the columns that its parent joins on, and a struct of what was asked for.
Only those columns are read.  To-one relations are left outer joins; to-many relations are grouped by the parent's key into
arrays ordered by child id before they are joined, each by itself, so that siblings don't multiply.  Join strategies are
left to Spark, which sees the sizes.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import emit
from ..schema import ID, Block, Field, Schema
from .select import Select, parse_select


@dataclass
class State:
    """One consistent version: a frame for each model, and one of (src, dst) for each edge set, named ``Model.field``."""

    schema: Schema
    tables: dict[str, DataFrame]
    edges: dict[str, DataFrame] = field(default_factory=dict)

    def changed(self, tables: dict[str, DataFrame] | None = None, edges: dict[str, DataFrame] | None = None) -> State:
        return State(self.schema, self.tables | (tables or {}), self.edges | (edges or {}))


@dataclass
class _Node:
    df: DataFrame
    key: str
    out: str
    carried: dict[str, str]


def _emitted(f: Field, value: Column) -> Column:
    return emit(f.type, value) if f.kind == "primitive" else F.transform(value, lambda x: emit(f.type, x))


class _Compiler:
    def __init__(self, state: State) -> None:
        self.state, self.schema, self._numbers = state, state.schema, itertools.count()

    def node(self, base: DataFrame, block: Block, select: Select, carry: tuple[str, ...] = (), within: tuple[str, DataFrame] | None = None, narrowed: bool = False) -> _Node:
        """``within``: a column of ``base``, and a frame of the only values that it is needed for; ``narrowed``: ``base`` is a
        part of its table, so that it pays to read children for its rows alone."""
        prefix = f"n{next(self._numbers)}_"
        own = {f.name for f in block.fields if f.stored and (f.name in select.primitives or f.name in select.includes)}
        names = dict.fromkeys([ID, *carry, *(f.name for f in block.fields if f.name in own), *([within[0]] if within else [])])
        df = base.select(*(F.col(c).alias(prefix + c) for c in names))
        if within:
            df = df.join(within[1].withColumnRenamed(within[1].columns[0], f"{prefix}in"), F.col(prefix + within[0]) == F.col(f"{prefix}in"), "left_semi")
            narrowed = True
        values: dict[str, Column] = {}
        keep = df if narrowed else None  # the rows that children are needed for
        for name, sub in select.includes.items():
            f = block[name]
            df, values[name] = self.include(df, block, f, sub, prefix, keep)
        parts = [F.col(prefix + ID).alias(ID)] if select.id else []
        for f in block.fields:
            if f.name in select.primitives:
                value = F.col(prefix + f.name)
                parts.append(_emitted(f, value).alias(f.name))
            elif f.name in values:
                parts.append(values[f.name].alias(f.name))
        out = F.struct(*parts) if parts else F.expr("named_struct()")
        df = df.select(F.col(prefix + ID), *(F.col(prefix + c) for c in carry if c != ID), out.alias(f"{prefix}out"))
        return _Node(df, prefix + ID, f"{prefix}out", {c: prefix + c for c in carry if c != ID} | {ID: prefix + ID})

    def include(self, df: DataFrame, block: Block, f: Field, sub: Select, prefix: str, keep: DataFrame | None) -> tuple[DataFrame, Column]:
        key = prefix + ID
        if f.kind.startswith("struct"):
            return self._embedded(df, f, sub, prefix)
        target, table = self.schema.block(f), self.state.tables[f.type]
        parents = keep.select(key).distinct() if keep is not None else None
        if f.kind == "ref" and f.derived is None:
            named = keep.select(F.col(prefix + f.name)).distinct() if keep is not None else None
            child = self.node(table, target, sub, within=(ID, named) if named is not None else None)
            df = df.join(child.df, F.col(prefix + f.name) == F.col(child.key), "left")
            return df, F.when(F.col(child.key).isNotNull(), F.col(child.out))
        edges = self.schema.edges_of(block, f) if f.kind == "ref_list" else None
        if edges is None:
            fk = f.derived[1]
            child = self.node(table.where(F.col(fk).isNotNull()), target, sub, carry=(fk,), within=(fk, parents) if parents is not None else None)
            rows, owner = child.df, child.carried[fk]
        else:
            src, dst = ("dst", "src") if edges[1] else ("src", "dst")
            e = f"{prefix}{f.name}_"
            rows = self.state.edges[edges[0]].select(F.col(src).alias(f"{e}src"), F.col(dst).alias(f"{e}dst"))
            if parents is not None:
                rows = rows.join(parents.withColumnRenamed(key, f"{e}in"), F.col(f"{e}src") == F.col(f"{e}in"), "left_semi")
            child = self.node(table, target, sub, within=(ID, rows.select(f"{e}dst").distinct()) if parents is not None else None)
            rows, owner = rows.join(child.df, F.col(f"{e}dst") == F.col(child.key)), f"{e}src"
        if f.kind == "ref":  # the inverse of a key, to one: the child of least id
            grouped = rows.groupBy(F.col(owner).alias(f"{prefix}{f.name}_of")).agg(F.min_by(child.out, child.key).alias(f"{prefix}{f.name}"))
            return df.join(grouped, F.col(key) == F.col(f"{prefix}{f.name}_of"), "left"), F.col(f"{prefix}{f.name}")
        return self._list(df, rows, owner, child, key, f"{prefix}{f.name}")

    @staticmethod
    def _list(df: DataFrame, rows: DataFrame, owner: str, child: _Node, key: str, name: str) -> tuple[DataFrame, Column]:
        items = F.sort_array(F.collect_list(F.struct(F.col(child.key).alias("k"), F.col(child.out).alias("v"))))
        grouped = rows.groupBy(F.col(owner).alias(f"{name}_of")).agg(F.transform(items, lambda x: x["v"]).alias(f"{name}_list"))
        return df.join(grouped, F.col(key) == F.col(f"{name}_of"), "left"), F.coalesce(F.col(f"{name}_list"), F.array().cast(grouped.schema[f"{name}_list"].dataType))

    def _embedded(self, df: DataFrame, f: Field, sub: Select, prefix: str) -> tuple[DataFrame, Column]:
        block, key, column = self.schema.block(f), prefix + ID, F.col(prefix + f.name)
        many = f.kind == "struct_list"

        def within(item: Column, id_: Column) -> Column:
            parts = [id_.alias(ID)] if sub.id else []
            for x in block.fields:
                if x.name in sub.primitives:
                    value = item[x.name]
                    parts.append(_emitted(x, value).alias(x.name))
            return F.struct(*parts) if parts else F.expr("named_struct()")

        if not sub.includes:  # nothing to join
            if many:
                ordered = F.array_sort(column, lambda a, b: F.when(a[ID] < b[ID], -1).when(a[ID] > b[ID], 1).otherwise(0))
                made = F.transform(ordered, lambda x: within(x, x[ID]))
                return df, F.coalesce(made, F.array().cast(df.select(made.alias("x")).schema["x"].dataType))
            return df, F.when(column.isNotNull(), within(column, F.col(key)))
        if many:
            items = df.select(F.col(key).alias("__of"), F.explode(column).alias("x")).select("__of", "x.*")
            child = self.node(items, block, sub, carry=("__of",))
            return self._list(df, child.df, child.carried["__of"], child, key, prefix + f.name)
        items = df.where(column.isNotNull()).select(F.col(key).alias(ID), *(column[x.name].alias(x.name) for x in block.fields))
        child = self.node(items, block, sub)
        df = df.join(child.df, F.col(key) == F.col(child.key), "left")
        return df, F.when(F.col(child.key).isNotNull(), F.col(child.out))


def find_many(state: State, model: str, select: object = True, *, where: Column | str | None = None, order_by: list[str] | None = None, limit: int | None = None, strict: bool = False) -> DataFrame:
    """Rows of ``model`` as the projection ``select`` asks, in no order unless ``order_by`` is given.

    ``where``, ``order_by`` and ``limit`` go beyond plain projections: conditions and orders over the model's own stored
    columns, a minus before a name for descending.  With a condition or a limit, children are read only for the rows that are left.
    """
    block = state.schema.model(model)
    tree = parse_select(state.schema, block, select, strict)
    base = state.tables[model]
    if where is not None:
        base = base.where(where)
    names, down = [c.removeprefix("-") for c in order_by or []], [c.startswith("-") for c in order_by or []]
    if limit is not None:
        base = base.orderBy(*(F.col(c).desc() if d else F.col(c) for c, d in zip([*names, ID], [*down, False], strict=True))).limit(limit)
    node = _Compiler(state).node(base, block, tree, carry=tuple(names), narrowed=where is not None or limit is not None)
    df = node.df
    if names:
        df = df.orderBy(*(F.col(node.carried[c]).desc() if d else F.col(node.carried[c]) for c, d in zip(names, down, strict=True)))
    found = df.schema[node.out].dataType.fieldNames()
    return df.select(f"{node.out}.*") if found else df.select(F.col(node.out).alias("document"))


def to_json_rows(state: State, model: str, select: object = True, **options) -> DataFrame:
    """One column ``json``, ordered by id unless told otherwise: the documents with their nulls."""
    block = state.schema.model(model)
    tree = parse_select(state.schema, block, select, options.pop("strict", False))
    node = _Compiler(state).node(state.tables[model], block, tree)
    return node.df.orderBy(node.key).select(F.to_json(F.col(node.out), {"ignoreNullFields": "false"}).alias("json"))
