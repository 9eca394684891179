import pytest

from fernweave.errors import SchemaError, UnknownModel
from fernweave.schema import parse_schema

LIBRARY = """
model Author {
  name    String
  books   Book[]   @derived(Book.authors)
  drafts  Draft[]  @derived(Draft.owner)
}
model Book {
  title    String?
  authors  Author[]
}
model Draft {
  title  String @index
  owner  Author
  meta   Meta
  notes  Meta[]
  tags   String[]
}
enum Ignored {
  A
}
struct Meta {
  n     Int
  by    Author
}
"""


def test_kinds_and_relations():
    schema = parse_schema(LIBRARY)
    assert list(schema.models) == ["Author", "Book", "Draft"] and list(schema.structs) == ["Meta"]
    draft = schema.model("Draft")
    assert [(f.name, f.kind, f.type) for f in draft.fields] == [("title", "primitive", "String"), ("owner", "ref", "Author"), ("meta", "struct", "Meta"), ("notes", "struct_list", "Meta"), ("tags", "primitive_list", "String")]
    assert schema.model("Book")["title"].nullable and not draft["title"].nullable
    assert list(schema.edge_sets()) == ["Book.authors"]
    author = schema.model("Author")
    assert schema.edges_of(author, author["books"]) == ("Book.authors", True)
    assert schema.edges_of(author, author["drafts"]) is None
    assert [p for p, _ in schema.foreign_keys(draft)] == ["owner", "meta.by", "notes.by"]


def test_table_types():
    schema = parse_schema(LIBRARY)
    assert schema.struct_type(schema.model("Draft")).simpleString() == "struct<id:bigint,title:string,owner:bigint,meta:struct<n:bigint,by:bigint>,notes:array<struct<id:bigint,n:bigint,by:bigint>>,tags:array<string>>"
    assert schema.struct_type(schema.model("Author")).simpleString() == "struct<id:bigint,name:string>"
    assert schema.struct_type(schema.model("Book")).fieldNames() == ["id", "title"]


@pytest.mark.parametrize("text", [
    "model A {\n x Nope\n}", "model A {\n x\n}", "model A {\n x String\n", "model A {\n x B[] @derived(B.y)\n}\nmodel B {\n y String\n}", "model A {\n id Int\n}", "model A {\n x Int\n x Int\n}",
    "model A {\n b B @derived(B.as)\n}\nmodel B {\n as A[]\n}", "struct S {\n t T\n}\nstruct T {\n n Int\n}",
])
def test_errors(text):
    with pytest.raises(SchemaError):
        parse_schema(text)


def test_unknown_model_and_empty_blocks():
    schema = parse_schema("model A {\n}\nmodel B {\n}\nmodel C {\n a A @sorted\n}")
    assert [len(m.fields) for m in schema.models.values()] == [0, 0, 1]
    with pytest.raises(UnknownModel):
        schema.model("D")
