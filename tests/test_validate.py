from decimal import Decimal

import pytest

from fernweave.errors import DerivedFieldReadOnly, EmptyObject, IdRequired, NotAnObject, TypeMismatch
from fernweave.functions import coerce
from fernweave.operators.validate import document_id, validate_document
from fernweave.schema import parse_schema

SCHEMA = parse_schema("""
model Plant {
  label    String
  height   Int
  parent   Plant
  shoots   Plant[]  @derived(Plant.parent)
  near     Plant[]
  care     Care
  grafts   Graft[]
  marks    String[]
}
struct Care {
  soil   String
  after  Plant
}
struct Graft {
  code  String
  year  Int
}
""")
PLANT = SCHEMA.model("Plant")


def test_accepted():
    body = {"marks": ["x", None], "grafts": [{"code": "a"}, {"id": 4, "year": 1}], "near": [{"id": 3}, {"id": 3}], "care": {"soil": "x", "after": {"id": 2}}, "label": "A", "height": 30, "parent": {"id": 1}, "nope": 1, "id": 50}
    got = validate_document(SCHEMA, PLANT, body)
    assert got.values == {"label": "A", "height": 30, "parent": 1, "marks": ["x", None]}
    assert got.structs == {"care": {"soil": "x", "after": 2}} and got.edges == {"near": [3]} and got.items == {"grafts": [{"code": "a"}, {"id": 4, "year": 1}]}
    assert got.keys == [("parent", "Plant", 1), ("near", "Plant", 3), ("care.after", "Plant", 2)]  # in the order of the fields
    assert validate_document(SCHEMA, PLANT, {"label": ""}).values == {"label": ""}
    assert validate_document(SCHEMA, PLANT, {"label": None, "care": None}).structs == {"care": None}


@pytest.mark.parametrize("body, error", [
    ([1], NotAnObject), ("x", NotAnObject), (None, NotAnObject), ({}, EmptyObject), ({"nope": 1}, EmptyObject), ({"label": 5}, TypeMismatch), ({"height": 1.0}, TypeMismatch), ({"height": "1"}, TypeMismatch),
    ({"height": 1e3}, TypeMismatch), ({"height": True}, TypeMismatch), ({"height": 9223372036854775808}, TypeMismatch), ({"parent": 7}, TypeMismatch), ({"parent": {}}, TypeMismatch), ({"parent": {"id": -1}}, TypeMismatch),
    ({"near": None}, TypeMismatch), ({"grafts": None}, TypeMismatch), ({"near": [1]}, TypeMismatch), ({"grafts": [1]}, NotAnObject), ({"care": 3}, NotAnObject), ({"care": {"soil": 3}}, TypeMismatch), ({"shoots": []}, DerivedFieldReadOnly),
    ({"grafts": [{"id": "x"}]}, TypeMismatch), ({"marks": "x"}, TypeMismatch),
])
def test_rejected(body, error):
    with pytest.raises(error):
        validate_document(SCHEMA, PLANT, body)


def test_error_names_the_place():
    with pytest.raises(TypeMismatch) as e:
        validate_document(SCHEMA, PLANT, {"near": [{"id": 1}, {"id": None}]})
    assert e.value.field == "near[1]"


@pytest.mark.parametrize("kind, value, want", [
    ("UInt", 18446744073709551615, Decimal(18446744073709551615)), ("Float", 0.1, 0.10000000149011612), ("Float", 3, 3.0), ("Double", 0.1, 0.1), ("Double", 10**20, 1e20), ("DateTime", 1762920137150, 1762920137150),
    ("DateTime", "2025-11-12T07:02:17.150+03:00", 1762920137150), ("DateTime", "2025-11-12T07:02:17.150999Z", 1762930937150), ("DateTime", "1969-12-31T23:59:59.999Z", -1), ("DateTime", "2025-11-12T07:02:17Z", 1762930937000), ("Bool", False, False),
])
def test_coerced(kind, value, want):
    assert coerce(kind, value, "f") == want


@pytest.mark.parametrize("kind, value", [
    ("UInt", -1), ("UInt", 1 << 64), ("Float", 1e300), ("Float", 10**400), ("Double", "1"), ("Double", True), ("Bool", 1), ("DateTime", "2025-11-12"), ("DateTime", "2025-11-12T07:02:17"), ("DateTime", True), ("DateTime", 1.5),
    ("DateTime", "2025-13-12T07:02:17Z"), ("DateTime", 1 << 62), ("Double", float("nan")),
])
def test_not_coerced(kind, value):
    with pytest.raises(TypeMismatch):
        coerce(kind, value, "f")


def test_document_id():
    assert document_id({"id": 0}) == 0
    for body in ({}, {"id": "1"}, {"id": -1}, {"id": True}, 5):
        with pytest.raises(IdRequired):
            document_id(body)
