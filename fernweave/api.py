"""The engine: collections of a schema, kept in a store or bound to tables.

    engine = Engine(spark, schema_text, path)
    engine.model("User").insert({"name": "Alice"})
    engine.model("Post").find_many({"title": True, "author": True})

Single documents are JSON values and checked rule by rule; batches are frames and checked by joins.  In both, a change is one
new version of the store, or none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ConcurrentModification, EngineError, ForeignKeyViolation, ItemNotFound, UnknownModel
from .functions import incoming_type, store
from .operators import mutate
from .operators.validate import Document, document_id, row_violations, unsigned_id, validate_document
from .plans.compile import State, find_many, to_json_rows
from .schema import ID, Block, Field, Schema, parse_schema
from .sources.store import Manifest, Segment, Store

#: Times that a change is tried again when another writer was first.
RETRIES = 5


@dataclass
class _Change:
    """What a change adds to a manifest, and what it answers."""

    segments: dict[str, list[Segment]]
    high_water: dict[str, int]
    answer: object


class Engine:
    def __init__(self, spark: SparkSession, schema: str | Schema, path: str | None = None, state: State | None = None) -> None:
        """``path``: folder of the store.  ``state`` instead: bound tables, which can be read only."""
        self.spark, self.schema = spark, parse_schema(schema) if isinstance(schema, str) else schema
        if (path is None) == (state is None):
            raise EngineError("either a folder or a state of bound tables is needed")
        self.store = Store(spark, path, self.schema) if path is not None else None
        self._bound = state

    def state(self, version: int | None = None) -> State:
        """A consistent version of all collections, by default the newest."""
        return self._bound if self.store is None else self.store.state(self.store.manifest(version))

    def model(self, name: str) -> Collection:
        return Collection(self, self.schema.model(name))

    def execute(self, model: str, action: str, body: object = True) -> object:
        """An action by name: ``insert``, ``update`` and ``delete`` answer ``{"id": n}``, ``findMany`` a list of documents."""
        collection = self.model(model)
        match action:
            case "insert":
                return {ID: collection.insert(body)}
            case "findMany":
                return [json.loads(r[0]) for r in to_json_rows(self.state(), model, body).collect()]
            case "update":
                return {ID: collection.update(body)}
            case "delete":
                return {ID: collection.delete(document_id(body))}
        raise UnknownModel(f"{model}/{action}")

    def compact(self, *names: str) -> None:
        """Rewrite tables and edge sets, by default all, as one segment each, in files that are sorted by id."""
        def build(manifest: Manifest) -> _Change:
            many = {n: x for n, x in manifest.segments.items() if len(x) > 1 and (not names or n in names)}
            rows = {n: self.store.frame(manifest, n) for n in many}
            return _Change({n: self.store.write(n, df.repartitionByRange(df.columns[0]).sortWithinPartitions(*df.columns[: 1 + ("." in n)])) for n, df in rows.items()}, {}, None)

        self._commit(build)

    def _commit(self, build: Callable[[Manifest], _Change], once: tuple[str, int] | None = None) -> object:
        """``once``: a stream and the number of its batch; None is answered if that has been added already."""
        if self.store is None:
            raise EngineError("bound tables are read only")
        for left in range(RETRIES, -1, -1):
            manifest = self.store.manifest()
            if once and manifest.applied.get(once[0], -1) >= once[1]:
                return None
            change = build(manifest)
            try:
                self.store.commit(manifest.changed(change.segments, change.high_water, dict([once]) if once else None))
                return change.answer
            except ConcurrentModification:
                if not left:
                    raise
        raise AssertionError


class Collection:
    """One model of an engine."""

    def __init__(self, engine: Engine, block: Block) -> None:
        self.engine, self.block, self.name = engine, block, block.name

    # ---- reading

    def find_many(self, select: object = True, **options) -> DataFrame:
        """See :func:`fernweave.plans.find_many`."""
        return find_many(self.engine.state(), self.name, select, **options)

    def find_by_id(self, id_: int, select: object = True) -> DataFrame:
        return self.find_many(select, where=F.col(ID) == id_)

    # ---- single documents

    def insert(self, body: object) -> int:
        """Check and add a document; its new id."""
        document = validate_document(self.engine.schema, self.block, body)
        return self.engine._commit(lambda manifest: self._insert(manifest, document))

    def update(self, body: object) -> int:
        """Change the fields that the document names, and leave the others."""
        id_ = document_id(body)
        document = validate_document(self.engine.schema, self.block, body)
        return self.engine._commit(lambda manifest: self._update(manifest, id_, document))

    def delete(self, id_: int, on_delete: str = "detach") -> int:
        if unsigned_id(id_) is None:
            raise ItemNotFound(id_)
        return self.engine._commit(lambda manifest: self._delete(manifest, self.engine.spark.createDataFrame([(id_,)], "id long"), id_, on_delete))

    # ---- batches

    def insert_rows(self, rows: DataFrame, once: tuple[str, int] | None = None) -> DataFrame | None:
        """Add rows shaped like the model's table, without ids; the rows that were added, with theirs.

        ``once``: the name of a stream and the number of its batch; a batch that has been added is not added again."""
        return self.engine._commit(lambda manifest: self._insert_rows(manifest, rows), once)

    def update_rows(self, patches: DataFrame) -> int:
        """Apply patches as :func:`fernweave.operators.mutate.patch` takes them; their number."""
        return self.engine._commit(lambda manifest: self._update_rows(manifest, patches))

    def delete_rows(self, ids: DataFrame, on_delete: str = "detach") -> None:
        self.engine._commit(lambda manifest: self._delete(manifest, ids.select(F.col(ID).cast("bigint").alias(ID)), None, on_delete))

    # ---- building changes

    @property
    def _store(self) -> Store:
        return self.engine.store

    def _check_keys(self, manifest: Manifest, document: Document) -> None:
        """The document's references, of which there are as many as it names."""
        wanted: dict[str, set[int]] = {}
        for _, model, id_ in document.keys:
            wanted.setdefault(model, set()).add(id_)
        found = {m: {r[0] for r in self._store.frame(manifest, m, min(ids), max(ids)).where(F.col(ID).isin(*ids)).select(ID).collect()} for m, ids in wanted.items()}
        for path, model, id_ in document.keys:
            if id_ not in found[model]:
                raise ForeignKeyViolation(path, id_)

    def _items(self, manifest: Manifest, document: Document, high_water: dict[str, int]) -> dict[str, list[dict]]:
        """Struct list items with ids: those given, and new ones above all that were."""
        out = {}
        for name, items in document.items.items():
            counter = f"{self.name}.{name}"
            high, done = manifest.high_water.get(counter, 0), {}
            for item in items:
                if ID in item:
                    high = max(high, item[ID])
                else:
                    high += 1
                    item = item | {ID: high}
                done[item[ID]] = item
            high_water[counter] = high
            out[name] = [done[k] for k in sorted(done)]
        return out

    def _insert(self, manifest: Manifest, document: Document) -> _Change:
        self._check_keys(manifest, document)
        id_ = manifest.high_water.get(self.name, 0) + 1
        high_water = {self.name: id_}
        row = document.values | document.structs | self._items(manifest, document, high_water) | {ID: id_}
        row |= {f.name: [] for f in self.block.of_kind("struct_list") if f.name not in row}
        segments = {self.name: [*manifest.segments.get(self.name, []), *self._store.write(self.name, self._frame([row]))]}
        for name, ids in document.edges.items():
            edge_set, backwards = self.engine.schema.edges_of(self.block, self.block[name])
            if ids:
                pairs = self.engine.spark.createDataFrame([(x, id_) if backwards else (id_, x) for x in ids], "src long, dst long")
                segments[edge_set] = [*manifest.segments.get(edge_set, []), *self._store.write(edge_set, pairs)]
        return _Change(segments, high_water, id_)

    def _update(self, manifest: Manifest, id_: int, document: Document) -> _Change:
        self._check_keys(manifest, document)
        if not self._store.frame(manifest, self.name, id_, id_).where(F.col(ID) == id_).head(1):
            raise ItemNotFound(id_)
        high_water: dict[str, int] = {}
        items = self._items(manifest, document, high_water)
        row = {ID: id_} | document.values | document.structs
        patches = self._frame([row])
        sets = {k: F.lit(True).alias(f"{k}__set") for k in document.values | document.structs}
        masks = [F.struct(*(F.lit(True).alias(x) for x in value)).alias(f"{k}__fields") for k, value in document.structs.items() if value]
        patches = patches.select(ID, *(x for k in sets for x in (F.col(k), sets[k])), *masks)

        def change(state: State) -> State:
            if sets:
                state = mutate.patch(state, self.name, patches)
            for name, new in items.items():
                requests = self._frame([{ID: id_, name: new}]).select(ID, F.col(name).alias("items"))
                state = mutate.upsert_items(state, self.name, name, requests)
            return state

        segments = self._rewritten(manifest, self._holding(manifest, self.name, id_), change) if sets or items else {}
        owner = self.engine.spark.createDataFrame([(id_,)], "id long")
        for name, ids in document.edges.items():
            edge_set, backwards = self.engine.schema.edges_of(self.block, self.block[name])
            old = manifest.segments.get(edge_set, [])
            touched = old if backwards else self._holding(manifest, edge_set, id_)  # segments know the range of their src
            state = State(self.engine.schema, {}, {edge_set: self._store.frame(Manifest(segments={edge_set: touched}), edge_set)})
            pairs = self.engine.spark.createDataFrame([(id_, x) for x in ids], "owner long, other long")
            new = self._store.write(edge_set, mutate.replace_edges(state, edge_set, owner, pairs, backwards).edges[edge_set])
            segments[edge_set] = [*(s for s in old if s not in touched), *new]
        return _Change(segments, high_water, id_)

    @staticmethod
    def _holding(manifest: Manifest, name: str, ids: int | DataFrame) -> list[Segment]:
        """The segments that may hold an id, or some of a frame's.  Of a frame only the numbers of the ranges between the segments'
        ends that it hits are gathered, so there are at most twice as many as segments."""
        segments = manifest.segments.get(name, [])
        if isinstance(ids, int):
            return [s for s in segments if s.low <= ids <= s.high]
        ends = sorted({x for s in segments for x in (s.low, s.high + 1)})
        if not ends:
            return []
        number = F.size(F.filter(F.array(*map(F.lit, ends)), lambda x: x <= F.col(ID)))
        hit = {ends[r[0] - 1] for r in ids.select(number.alias("n")).distinct().collect() if r[0]}
        return [s for s in segments if any(s.low <= x <= s.high for x in hit)]

    def _rewritten(self, manifest: Manifest, touched: list[Segment], change: Callable[[State], State]) -> dict[str, list[Segment]]:
        """Segments of this model after a change to rows of those that are ``touched``."""
        kept = [s for s in manifest.segments.get(self.name, []) if s not in touched]
        part = State(self.engine.schema, {self.name: self._store.frame(Manifest(segments={self.name: touched}), self.name)})
        return {self.name: [*kept, *self._store.write(self.name, change(part).tables[self.name])]}

    def _insert_rows(self, manifest: Manifest, rows: DataFrame) -> _Change:
        state, after = self._store.state(manifest), manifest.high_water.get(self.name, 0)
        shaped = mutate._shaped(state, self.name, rows.drop(ID).withColumn(ID, F.lit(None).cast("bigint"))).drop(ID)
        place = f"data/staged/{self.name}-{uuid.uuid4().hex}"
        shaped.write.parquet(f"{self._store.path}/{place}")  # so that the partitions, and with them the ids, stay as they are
        staged = self.engine.spark.read.schema(shaped.schema).parquet(f"{self._store.path}/{place}")
        numbered = mutate.number_rows(staged, after).select(*state.tables[self.name].columns)
        self._reject(state, numbered)
        new = self._store.write(self.name, numbered)
        high_water = {self.name: max([after, *(s.high for s in new)])}
        for f in self.block.of_kind("struct_list"):
            most = numbered.select(F.explode(f.name).alias("x")).agg(F.max("x.id")).first()[0]
            high_water[f"{self.name}.{f.name}"] = max(manifest.high_water.get(f"{self.name}.{f.name}", 0), most or 0)
        self._store.remove(place)
        frame = self._store.frame(Manifest(segments={self.name: new}), self.name)
        return _Change({self.name: [*manifest.segments.get(self.name, []), *new]}, high_water, frame)

    def _reject(self, state: State, rows: DataFrame) -> None:
        if bad := row_violations(state, self.name, rows).head(1):
            raise ForeignKeyViolation(bad[0]["field"], bad[0]["target"])

    def _update_rows(self, manifest: Manifest, patches: DataFrame) -> _Change:
        state = self._store.state(manifest)
        if absent := mutate.missing(state, self.name, patches).head(1):
            raise ItemNotFound(absent[0][0])
        self._reject(state, patches)
        n, touched = patches.count(), self._holding(manifest, self.name, patches)
        return _Change(self._rewritten(manifest, touched, lambda s: mutate.patch(s, self.name, patches)) if n else {}, {}, n)

    def _delete(self, manifest: Manifest, ids: DataFrame, only: int | None, on_delete: str) -> _Change:
        state = self._store.state(manifest)
        if only is not None and not self._store.frame(manifest, self.name, only, only).where(F.col(ID) == only).head(1):
            raise ItemNotFound(only)
        new = mutate.delete(state, self.name, ids, on_delete)
        touched = self._holding(manifest, self.name, ids if only is None else only)
        segments = self._rewritten(manifest, touched, lambda s: State(s.schema, mutate.delete(s, self.name, ids).tables)) if touched else {}
        if not touched:
            return _Change({}, {}, only)
        for name, edges in new.edges.items():
            if edges is not state.edges[name] and manifest.segments.get(name):
                segments[name] = self._store.write(name, edges)
        return _Change(segments, {}, only)

    # ---- frames of documents

    def _frame(self, rows: list[dict]) -> DataFrame:
        """The model's table with these rows; absent fields are null."""
        schema, block = self.engine.schema, self.block

        def raw(f: Field) -> T.DataType:
            match f.kind:
                case "primitive":
                    return incoming_type(f.type)
                case "primitive_list":
                    return T.ArrayType(incoming_type(f.type))
                case "ref":
                    return T.LongType()
            inner = [T.StructField(ID, T.LongType())] * (f.kind == "struct_list") + [T.StructField(x.name, raw(x)) for x in schema.block(f).fields]
            return T.ArrayType(T.StructType(inner)) if f.kind == "struct_list" else T.StructType(inner)

        def value(f: Field, x: object) -> object:
            if x is None or f.kind in ("primitive", "primitive_list", "ref"):
                return x
            if f.kind == "struct":
                return tuple(x.get(y.name) for y in schema.block(f).fields)
            return [(i[ID], *(i.get(y.name) for y in schema.block(f).fields)) for i in x]

        def stored(f: Field, x: Column) -> Column:
            match f.kind:
                case "primitive":
                    return store(f.type, x)
                case "primitive_list":
                    return F.transform(x, lambda y: store(f.type, y))
                case "struct":
                    return F.when(x.isNotNull(), F.struct(*(stored(y, x[y.name]).alias(y.name) for y in schema.block(f).fields)))
                case "struct_list":
                    return F.transform(x, lambda i: F.struct(i[ID].alias(ID), *(stored(y, i[y.name]).alias(y.name) for y in schema.block(f).fields)))
            return x

        fields = [f for f in block.fields if f.stored]
        kinds = T.StructType([T.StructField(ID, T.LongType()), *(T.StructField(f.name, raw(f)) for f in fields)])
        data = [(r[ID], *(value(f, r.get(f.name)) for f in fields)) for r in rows]
        df = self.engine.spark.createDataFrame(data, kinds)
        return df.select(ID, *(stored(f, F.col(f.name)).alias(f.name) for f in fields))

