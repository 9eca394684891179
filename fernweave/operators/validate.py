"""Checks of documents: the rules for one JSON document, and foreign keys of whole frames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DerivedFieldReadOnly, EmptyObject, IdRequired, NotAnObject, TypeMismatch
from ..functions import coerce
from ..plans.compile import State
from ..schema import ID, Block, Schema

_MOST_ID = (1 << 63) - 1


@dataclass
class Document:
    """A validated document.  ``values``: columns of the model's table that it names, None where it says null; struct lists
    and reference lists stand apart.  ``keys``: (field path, model, id) of every reference."""

    values: dict[str, object] = field(default_factory=dict)
    structs: dict[str, dict[str, object] | None] = field(default_factory=dict)
    items: dict[str, list[dict[str, object]]] = field(default_factory=dict)
    edges: dict[str, list[int]] = field(default_factory=dict)
    keys: list[tuple[str, str, int]] = field(default_factory=list)


def unsigned_id(value: object) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) and 0 <= value <= _MOST_ID else None


def document_id(body: object) -> int:
    """The id that an update or delete needs."""
    if not isinstance(body, dict) or (found := unsigned_id(body.get(ID))) is None:
        raise IdRequired(f"{ID} has to be an unsigned integer")
    return found


def _reference(value: object, path: str) -> int:
    if not isinstance(value, dict) or (found := unsigned_id(value.get(ID))) is None:
        raise TypeMismatch(path, "object with an unsigned id")
    return found


def _plain(schema: Schema, block: Block, body: object, path: str, keys: list[tuple[str, str, int]]) -> dict[str, object]:
    """Primitives, lists of them and references to one row, of a model or struct."""
    if not isinstance(body, dict):
        raise NotAnObject(path or block.name)
    out: dict[str, object] = {}
    for f in block.fields:
        if f.name not in body:
            continue
        value, at = body[f.name], f"{path}.{f.name}" if path else f.name
        if f.kind == "ref" and f.derived:
            raise DerivedFieldReadOnly(at)
        if f.kind not in ("primitive", "primitive_list", "ref"):
            continue
        if value is None:
            out[f.name] = None
        elif f.kind == "primitive":
            out[f.name] = coerce(f.type, value, at)
        elif f.kind == "ref":
            out[f.name] = _reference(value, at)
            keys.append((at, f.type, out[f.name]))
        else:
            if not isinstance(value, list):
                raise TypeMismatch(at, f"list of {f.type}")
            out[f.name] = [None if x is None else coerce(f.type, x, f"{at}[{i}]") for i, x in enumerate(value)]
    return out


def validate_document(schema: Schema, block: Block, body: object) -> Document:
    """Check and take apart one document.  Absent fields stay absent; unknown ones and the id are passed over."""
    out = Document()
    out.values = _plain(schema, block, body, "", out.keys)
    for f in block.of_kind("struct", "struct_list", "ref_list"):
        if f.name not in body:
            continue
        value = body[f.name]
        if f.kind == "struct":
            out.structs[f.name] = None if value is None else _plain(schema, schema.block(f), value, f.name, out.keys)
            continue
        if not isinstance(value, list):
            raise TypeMismatch(f.name, "list")
        if f.kind == "ref_list":
            if schema.edges_of(block, f) is None:
                raise DerivedFieldReadOnly(f.name)
            out.edges[f.name] = list(dict.fromkeys(_reference(x, f"{f.name}[{i}]") for i, x in enumerate(value)))
            out.keys += [(f.name, f.type, x) for x in out.edges[f.name]]
            continue
        out.items[f.name] = []
        for i, x in enumerate(value):
            item = _plain(schema, schema.block(f), x, f"{f.name}[{i}]", out.keys)
            if ID in x:
                if (given := unsigned_id(x[ID])) is None:
                    raise TypeMismatch(f"{f.name}[{i}].{ID}", "unsigned id")
                item[ID] = given
            out.items[f.name].append(item)
    if not (out.values or out.structs or out.items or out.edges):
        raise EmptyObject(block.name)
    return out


def foreign_key_violations(state: State, candidates: DataFrame, column: str, target: str, key: str = ID) -> DataFrame:
    """Rows (``key``, ``column``) of ``candidates`` that refer to no row of ``target``; null references are none."""
    ids = state.tables[target].select(F.col(ID).alias("__target"))
    return candidates.select(key, column).where(F.col(column).isNotNull()).join(ids, F.col(column) == F.col("__target"), "left_anti")


def row_violations(state: State, model: str, rows: DataFrame) -> DataFrame:
    """(id, field, target) of all references of ``rows``, shaped like the model's table, that lead nowhere.

    Each key costs an anti join against the ids of its model, which reads one column of it.
    """
    block = state.schema.model(model)
    out = None
    for path, f in state.schema.foreign_keys(block):
        head, _, tail = path.partition(".")
        if head not in rows.columns:
            continue
        many = tail and block[head].kind == "struct_list"
        keys = rows.select(ID, F.explode(F.col(head)[tail]).alias("target")) if many else rows.select(ID, F.col(path).alias("target"))
        bad = foreign_key_violations(state, keys, "target", f.type).select(ID, F.lit(path).alias("field"), "target")
        out = bad if out is None else out.unionByName(bad)
    return out if out is not None else rows.sparkSession.createDataFrame([], "id long, field string, target long")
