"""The schema language: models, embedded structs, references and derived fields.

    model Post {
      title     String
      createdAt DateTime?
      author    User
      images    File[]
    }

A block ends at a line that is one closing brace.  A field is a name, a type and at most one attribute, on one line.  Types
may be declared later than they are used.  ``@index`` has no effect, unknown attributes and text between blocks are skipped.
Every model has an ``id`` that isn't declared.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from .errors import SchemaError, UnknownModel
from .functions import PRIMITIVES

ID = "id"


@dataclass(frozen=True)
class Field:
    """``kind``: primitive, primitive_list, struct, struct_list, ref or ref_list; ``type``: what it is one, or a list, of."""

    name: str
    kind: str
    type: str
    nullable: bool = False
    derived: tuple[str, str] | None = None  # (model, field) on the other side

    @property
    def stored(self) -> bool:
        """Whether the model's own table has a column for it."""
        return self.derived is None and self.kind != "ref_list"


@dataclass(frozen=True)
class Block:
    """A model or a struct."""

    name: str
    fields: tuple[Field, ...]

    def __getitem__(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(name)

    def of_kind(self, *kinds: str) -> list[Field]:
        return [f for f in self.fields if f.kind in kinds]


@dataclass
class Schema:
    models: dict[str, Block] = field(default_factory=dict)
    structs: dict[str, Block] = field(default_factory=dict)

    def model(self, name: str) -> Block:
        if name not in self.models:
            raise UnknownModel(name)
        return self.models[name]

    def block(self, f: Field) -> Block:
        """What a reference or struct field leads to."""
        return (self.structs if f.kind.startswith("struct") else self.models)[f.type]

    def edge_sets(self) -> dict[str, Field]:
        """Stored edge tables, ``Model.field``: those lists of references that aren't derived."""
        return {f"{m.name}.{f.name}": f for m in self.models.values() for f in m.of_kind("ref_list") if f.derived is None}

    def edges_of(self, model: Block, f: Field) -> tuple[str, bool] | None:
        """The edge table behind a list of references, and whether this field reads it backwards; None if a key is behind it."""
        if f.derived is None:
            return f"{model.name}.{f.name}", False
        return (f"{f.derived[0]}.{f.derived[1]}", True) if self.models[f.derived[0]][f.derived[1]].kind == "ref_list" else None

    def foreign_keys(self, model: Block) -> list[tuple[str, Field]]:
        """Stored keys of a model's rows as (column path, field); keys in struct lists have the path of the list."""
        out = [(f.name, f) for f in model.of_kind("ref") if f.stored]
        for f in model.of_kind("struct", "struct_list"):
            out += [(f"{f.name}.{x.name}", x) for x in self.block(f).of_kind("ref")]
        return out

    def struct_type(self, block: Block, with_id: bool = True) -> T.StructType:
        """Columns of a model's table, or of an embedded struct."""
        fields = [T.StructField(ID, T.LongType())] if with_id else []
        for f in block.fields:
            if f.stored:
                fields.append(T.StructField(f.name, self.column_type(f)))
        return T.StructType(fields)

    def column_type(self, f: Field) -> T.DataType:
        match f.kind:
            case "primitive":
                return PRIMITIVES[f.type]
            case "primitive_list":
                return T.ArrayType(PRIMITIVES[f.type])
            case "struct":
                return self.struct_type(self.block(f), with_id=False)
            case "struct_list":
                return T.ArrayType(self.struct_type(self.block(f)))
        return T.LongType()


def _parse_field(line: str) -> Field:
    before, _, attribute = line.partition("@")
    parts = before.split()
    if len(parts) != 2:
        raise SchemaError(f"a field is a name and a type: {line.strip()!r}")
    name, kind = parts
    derived = None
    attribute = attribute.strip()
    if attribute.startswith("derived(") and attribute.endswith(")"):
        model, dot, other = attribute[len("derived(") : -1].partition(".")
        if not dot:
            raise SchemaError(f"derived(Model.field) expected: {line.strip()!r}")
        derived = (model.strip(), other.strip())
    nullable = kind.endswith("?")
    return Field(name, "", kind.removesuffix("?"), nullable, derived)


def parse_schema(text: str) -> Schema:
    """Parse and resolve; SchemaError names what can't be."""
    raw: dict[tuple[str, str], list[Field]] = {}
    lines = iter(text.splitlines())
    for line in lines:
        head = line.split()
        if len(head) < 2 or head[0] not in ("model", "struct"):
            continue
        name, fields = head[1].removesuffix("{"), []
        for inner in lines:
            if inner.strip() == "}":
                break
            if inner.strip():
                fields.append(_parse_field(inner))
        else:
            raise SchemaError(f"{name}: no closing brace")
        raw[head[0], name] = fields
    kinds = {name: what for what, name in raw}

    def resolved(block: str, f: Field) -> Field:
        base, many = f.type.removesuffix("[]"), f.type.endswith("[]")
        if base in PRIMITIVES:
            kind = "primitive"
        elif base in kinds:
            kind = {"model": "ref", "struct": "struct"}[kinds[base]]
        else:
            raise SchemaError(f"{block}.{f.name}: unknown type {base}")
        return replace(f, kind=kind + "_list" * many, type=base)

    out = Schema()
    for (what, name), fields in raw.items():
        block = Block(name, tuple(resolved(name, f) for f in fields))
        if len({f.name for f in fields}) < len(fields) or any(f.name == ID for f in fields):
            raise SchemaError(f"{name}: field names must differ, and {ID} is implied")
        (out.models if what == "model" else out.structs)[name] = block
    for block in out.structs.values():
        if bad := [f.name for f in block.fields if f.kind not in ("primitive", "primitive_list", "ref") or f.derived]:
            raise SchemaError(f"{block.name}.{bad[0]}: a struct holds primitives and references to one row")
    for model in out.models.values():
        for f in model.fields:
            if f.derived is None:
                continue
            other = out.models.get(f.derived[0])
            back = next((x for x in other.fields if x.name == f.derived[1]), None) if other else None
            if not f.kind.startswith("ref") or back is None or not back.kind.startswith("ref") or back.derived or f.type != f.derived[0] or back.type != model.name:
                raise SchemaError(f"{model.name}.{f.name}: {'.'.join(f.derived)} doesn't refer back to it")
            if f.kind == "ref" and back.kind == "ref_list":
                raise SchemaError(f"{model.name}.{f.name}: a list derives from a list")
    return out
