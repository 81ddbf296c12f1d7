"""Semantics on small tables with nulls, and writes."""

import pytest
from pyspark.sql import functions as F

from sparquill.client import Client
from sparquill.errors import QueryValidationError, RecordNotFoundError, UniqueConstraintError

SCHEMA = """
model User {
  id     Int     @id @default(autoincrement())
  email  String  @unique
  age    Int?
  meta   Json?
  posts  Post[]
}
model Post {
  id       Int    @id @default(autoincrement())
  title    String
  score    Int?   @default(7)
  authorId Int?
  author   User?  @relation(fields: [authorId], references: [id], onDelete: Cascade)
}
model Order {
  tenantId Int
  id       Int
  total    Int
  items    Item[]
  @@id([tenantId, id])
}
model Item {
  tenantId Int
  sku      String
  orderId  Int
  order    Order @relation(fields: [tenantId, orderId], references: [tenantId, id])
  @@id([tenantId, sku])
}
"""


@pytest.fixture
def db(spark):
    make = spark.createDataFrame
    return Client(
        spark,
        SCHEMA,
        {
            "User": make([(1, "a@x", 30, '{"plan":"pro"}'), (2, "b@x", None, None), (3, "C@x", 50, "{}")], "id int, email string, age int, meta string"),
            "Post": make([(10, "one", 1, 1), (11, "two", None, 1), (12, "three", 5, 2), (13, "lost", 2, None)], "id int, title string, score int, authorId int"),
            "Order": make([(1, 10, 100), (1, 11, 200), (2, 10, 300)], "tenantId int, id int, total int"),
            "Item": make([(1, "A", 10), (1, "B", 10), (1, "C", 11), (2, "D", 10)], "tenantId int, sku string, orderId int"),
        },
    )


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    "where, want",
    [
        ({"age": {"not": 30}}, [3]),
        ({"age": None}, [2]),
        ({"age": {"not": None}}, [1, 3]),
        ({"NOT": {"age": {"gt": 40}}}, [1]),
        ({"age": {"notIn": [30, None]}}, []),
        ({"age": {"notIn": []}}, [1, 2, 3]),
        ({"OR": []}, [1, 2, 3]),
        ({"OR": [{}, {"id": 1}]}, [1]),
        ({"email": {"equals": "c@X", "mode": "insensitive"}}, [3]),
        ({"email": {"not": {"equals": "A@X"}, "mode": "insensitive"}}, [2, 3]),
        ({"email": {"not": {"mode": "insensitive"}}}, [1, 2, 3]),
        ({"meta": {"equals": {"plan": "pro"}}}, [1]),
        ({"meta": {"not": None}}, [1, 3]),
        ({"meta": {"plan": "pro"}}, [1]),
        ({"posts": {"some": {}}}, [1, 2]),
        ({"posts": {"none": {"score": {"gt": 3}}}}, [1, 3]),
        ({"posts": {"every": {"score": {"gt": 3}}}}, [2, 3]),
        ({"posts": {"every": {}}}, [3]),
        ({"posts": {}}, [1, 2, 3]),
        ({"OR": [{"posts": {"some": {"title": "three"}}}, {"id": 3}]}, [2, 3]),
    ],
)
def test_where(db, where, want):
    assert ids(db.user.find_many(where=where)) == want


def test_every_ignores_children_where_it_is_null(db):
    assert ids(db.user.find_many(where={"posts": {"every": {"score": 1}}})) == [1, 3]


@pytest.mark.parametrize("where, want", [({"author": {"is": None}}, [13]), ({"author": {"isNot": {"id": 1}}}, [12, 13]), ({"author": {"isNot": None}}, [10, 11, 12]), ({"author": {"age": 30}}, [10, 11])])
def test_to_one(db, where, want):
    assert ids(db.post.find_many(where=where)) == want


def test_null_shorthand_means_that_one_exists(db):
    with pytest.warns(UserWarning):
        assert ids(db.post.find_many(where={"author": None})) == [10, 11, 12]


@pytest.mark.parametrize("args", [{"where": {"nope": 1}}, {"where": {"age": {"near": 1}}}, {"where": {"meta": {"path": ["a"], "equals": 1}}}, {"select": {"id": True}, "include": {"posts": True}}, {"orderBy": {"posts": "asc"}}, {"distinct": ["nope"]}])
def test_invalid(db, args):
    with pytest.raises(QueryValidationError):
        db.user.find_many(args)


def test_include(db):
    rows = {r["id"]: r for r in db.user.find_many(include={"posts": {"orderBy": {"id": "desc"}, "take": 1}, "_count": True}).collect()}
    assert [[p["id"] for p in rows[k]["posts"]] for k in (1, 2, 3)] == [[11], [12], []]
    assert [rows[k]["_count"]["posts"] for k in (1, 2, 3)] == [2, 1, 0]


def test_include_composite(db):
    rows = db.order.find_many(include={"items": True}, orderBy=[{"tenantId": "asc"}, {"id": "asc"}]).collect()
    assert [[i["sku"] for i in r["items"]] for r in rows] == [["A", "B"], ["C"], ["D"]]


def test_order_has_nulls_first(db):
    assert [r["id"] for r in db.user.find_many(orderBy={"age": "asc"}).collect()] == [2, 1, 3]
    assert [r["id"] for r in db.user.find_many(orderBy={"age": "desc"}).collect()] == [3, 1, 2]


def test_aggregate_needs_an_operator(db):
    with pytest.raises(QueryValidationError):
        db.user.aggregate()
    with pytest.raises(QueryValidationError):
        db.user.group_by(by=[])


def test_throwing(db):
    assert db.user.find_unique_or_throw(where={"id": 1})["email"] == "a@x"
    with pytest.raises(RecordNotFoundError):
        db.user.find_first_or_throw(where={"id": 99})


def test_create_nested_and_defaults(db):
    row = db.user.create(data={"email": "d@x", "posts": {"create": [{"title": "new"}]}}, include={"posts": True}).first()
    assert row["id"] == 4 and [(p["id"], p["score"]) for p in row["posts"]] == [(14, 7)]
    assert db.post.create(data={"title": "t", "score": None, "author": {"connect": {"email": "b@x"}}}).first()["authorId"] == 2
    made = db.post.create(data={"title": "t", "author": {"connectOrCreate": {"where": {"email": "z@x"}, "create": {"email": "z@x"}}}}).first()
    assert made["authorId"] == 5
    with pytest.raises(RecordNotFoundError):
        db.post.create(data={"title": "t", "author": {"connect": {"id": 77}}})
    with pytest.raises(UniqueConstraintError):
        db.user.create(data={"email": "a@x"})


def test_update(db):
    assert db.post.update(where={"id": 12}, data={"score": {"divide": 2}}).first()["score"] == 2
    assert db.post.update_many(where={"score": {"gt": 100}}, data={"title": "x"}) == 0
    assert db.post.update_many(where={"score": {"not": 2}}, data={"title": "x"}) == 1  # null is not chosen
    assert sorted(r["title"] for r in db.post.find_many().collect()) == ["lost", "three", "two", "x"]
    with pytest.raises(QueryValidationError):
        db.post.update_many(data={"title": {"increment": 1}})
    with pytest.raises(RecordNotFoundError):
        db.post.update(where={"id": 99}, data={"title": "x"})


def test_children(db):
    db.user.update(where={"id": 3}, data={"posts": {"connect": [{"id": 13}], "disconnect": [{"id": 12}]}})
    owners = {r["id"]: r["authorId"] for r in db.post.find_many().collect()}
    assert owners == {10: 1, 11: 1, 12: None, 13: 3}
    db.user.update(where={"id": 1}, data={"posts": {"set": [{"id": 12}]}})
    owners = {r["id"]: r["authorId"] for r in db.post.find_many().collect()}
    assert owners == {10: None, 11: None, 12: 1, 13: 3}


def test_delete_keeps_nulls_and_cascades(db):
    assert db.post.delete_many(where={"score": {"gt": 1}}) == 2
    assert ids(db.post.find_many()) == [10, 11]
    db.user.delete(where={"id": 1})
    assert ids(db.user.find_many()) == [2, 3] and db.post.count().first()[0] == 0


def test_transaction_is_all_or_nothing(db):
    def work(tx):
        tx.user.delete_many(where={"id": 1})
        assert ids(tx.user.find_many()) == [2, 3]
        raise RuntimeError

    with pytest.raises(RuntimeError):
        db.transaction(work)
    assert ids(db.user.find_many()) == [1, 2, 3]
    db.transaction([lambda tx: tx.user.delete_many(where={"id": 1}), lambda tx: tx.user.delete_many(where={"id": 2})])
    assert ids(db.user.find_many()) == [3]


def test_save(db, tmp_path, spark):
    db.user.delete_many(where={"id": 1})
    db.save(str(tmp_path))
    assert ids(Client(spark, SCHEMA, f"parquet:{tmp_path}").user.find_many()) == [2, 3]


def test_extensions(db):
    seen = []
    more = db.extend(
        result={"User": {"domain": {"needs": ["email"], "compute": lambda c: F.substring_index(c["email"], "@", -1)}}},
        model={"$allModels": {"total": lambda self: self.count().first()[0]}},
        query={"User": {"findMany": lambda p: seen.append("hook") or p["query"]({**p["args"], "take": 1})}},
        client={"hello": lambda self: "hi"},
    )
    more.use(lambda params, go: seen.append(params["action"]) or go(params))
    more.on("query", lambda e: seen.append(e["model"]))
    row = more.user.find_many(select={"id": True, "domain": True}, orderBy={"id": "asc"}).collect()
    assert [(r["id"], r["domain"]) for r in row] == [(1, "x")] and seen == ["hook", "findMany", "User"]
    assert more.post.total() == 4 and more.hello() == "hi"
    with pytest.raises(AttributeError):
        db.hello()


def test_traverse(db):
    assert ids(db.user.traverse({"id": 1}, "posts", {"where": {"score": 1}})) == [10]
    assert ids(db.post.traverse({"id": 12}, "author")) == [2]


def test_raw(db):
    assert db.query_raw("SELECT count(*) AS n FROM Post WHERE score > ?", 1).first()["n"] == 2
