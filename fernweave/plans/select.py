"""Nested projections: a JSON tree of booleans and objects names the fields and relations wanted."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import UnknownField
from ..schema import ID, Block, Schema


@dataclass
class Select:
    """Whether the id is wanted, the primitive fields, and a tree for each relation or struct."""

    id: bool = False
    primitives: list[str] = field(default_factory=list)
    includes: dict[str, Select] = field(default_factory=dict)


def parse_select(schema: Schema, block: Block, body: object, strict: bool = False) -> Select:
    """A boolean selects the id and all primitives but no relation.  In an object, every value but ``false`` selects its
    field, the id needs ``true``, and unknown names are ignored unless ``strict``.  Anything else selects nothing.
    """
    if isinstance(body, bool):
        return Select(True, [f.name for f in block.of_kind("primitive", "primitive_list")])
    out = Select()
    if not isinstance(body, dict):
        return out
    if strict and (unknown := [k for k in body if k != ID and k not in {f.name for f in block.fields}]):
        raise UnknownField(f"{block.name}.{unknown[0]}")
    out.id = body.get(ID) is True
    for f in block.fields:
        if f.name not in body or body[f.name] is False:
            continue
        value = body[f.name]
        if f.kind.startswith("primitive"):
            out.primitives.append(f.name)
            continue
        sub = parse_select(schema, schema.block(f), value, strict)
        if f.kind == "struct" and value is True:
            sub.id = False  # it would be the id of the row around it
        out.includes[f.name] = sub
    return out
