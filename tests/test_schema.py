import pytest

from sparquill.errors import SchemaError
from sparquill.schema import complete, load, parse, resolve
from sparquill.schema.language import render
from sparquill.schema.validate import faults

TEXT = """
datasource db { provider = "parquet" url = "parquet:/data" }
enum Role { USER ADMIN @map("admin") }
/// People
model User {
  id    Int    @id @default(autoincrement())
  email String @unique @db.VarChar(100)
  role  Role   @default(USER)
  meta  Json?
  made  DateTime @default(now()) @map("CREATED")
  posts Post[]
  @@index([email])
  @@map("users")
}
// a comment
model Post { /* another */
  id       BigInt @id
  title    String @default("a \\"b\\"")
  authorId Int
  author   User @relation("wrote", fields: [authorId], references: [id], onDelete: Cascade)
}
"""


def test_parse():
    s = parse(TEXT)
    user = s.model("User")
    assert user.db_name == "users" and user.doc == "People"
    assert [f.kind for f in user.fields] == ["scalar", "scalar", "enum", "scalar", "scalar", "object"]
    assert user.field("email").native == ("VarChar", (100,))
    assert user.field("id").default.function == "autoincrement" and user.field("role").default.value == "USER"
    assert user.field("made").db_name == "CREATED" and user.field("meta").optional
    assert s.enum("Role").columns == {"ADMIN": "admin"}
    post = s.model("Post")
    assert post.field("title").default.value == 'a "b"'
    assert post.field("author").relation.on_delete == "Cascade"


def test_round_trip():
    s = parse(TEXT)
    assert parse(render(s)) == s


@pytest.mark.parametrize("text", ["model A {", "model A { id Int @nope }", "table A {}", "model A { id Int @id ; }", "model A { @@nope([a]) }"])
def test_unreadable(text):
    with pytest.raises(SchemaError):
        parse(text)


def test_all_faults_at_once():
    s = parse("model A { a Int a Nope b B @relation(fields: [x], references: [id]) } model B { id Int @id } model B { id Int @id } enum E { }")
    found = faults(s)
    assert len(found) == 6
    with pytest.raises(SchemaError) as e:
        load("model A { a Int }")
    assert e.value.faults == ("model A has no key",)


def test_complete_adds_the_other_end_once():
    s = complete(parse("model User { id Int @id } model Post { id Int @id userId Int user User @relation(fields: [userId], references: [id]) }"))
    assert s.model("User").field("posts").is_list
    assert complete(s) == s
    assert resolve(s, s.model("User"), "posts").other == ("userId",)


def test_complete_adds_references():
    s = complete(parse("model User { id Int @id posts Post[] } model Post { id Int @id }"))
    join = resolve(s, s.model("Post"), "user")
    assert (join.own, join.other, join.owns) == (("userId",), ("id",), True)
