"""Operands of any width, kinds and zones; JSON in and out; introspection; names that helper columns could take."""

import json
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sparquill.client import Client
from sparquill.errors import QueryValidationError, UniqueConstraintError
from sparquill.functions.json_rows import json_rows, typed_data, typed_where
from sparquill.schema import load, parse
from sparquill.schema.introspect import Reference, catalog_tables, introspect, introspect_catalog
from sparquill.schema.language import render

SCHEMA = """
model Thing {
  id    Int @id
  n     Int?
  big   BigInt?
  real  Float?
  dec   Decimal? @db.Decimal(10, 2)
  at    DateTime?
  raw   Bytes?
  flag  Boolean?
  code  String? @unique
  parts Part[]
}
model Part {
  _k0    Int @id
  _at    Int
  _rank  Int
  _rows  Int?
  thing  Thing? @relation(fields: [thingId], references: [id])
  thingId Int?
}
"""
ROWS = [(1, 7, 2**53 + 1, 0.5, Decimal("1.10"), datetime(2020, 1, 1, 12), b"\x00a", True, "a"), (2, 25, 5, 7.0, Decimal("2.00"), datetime(2020, 1, 2), None, False, "b"), (3, None, None, None, None, None, None, None, None)]
PARTS = [(10, 55, 3, 1, 1), (11, 54, 3, 2, 1), (12, 53, 4, 3, 2), (13, 1, 1, 1, None)]


@pytest.fixture
def db(spark):
    things = spark.createDataFrame(ROWS, "id int, n int, big long, real double, dec decimal(10,2), at timestamp_ntz, raw binary, flag boolean, code string")
    parts = spark.createDataFrame(PARTS, "_k0 int, _at int, _rank int, _rows int, thingId int")
    return Client(spark, SCHEMA, {"Thing": things, "Part": parts})


@pytest.mark.parametrize(
    "where, want",
    [
        ({"n": 7.5}, []),
        ({"n": 7.0}, [1]),
        ({"n": {"lt": 25.5}}, [1, 2]),
        ({"n": {"lt": 3_000_000_000}}, [1, 2]),
        ({"n": {"gt": -(10**40)}}, [1, 2]),
        ({"n": {"gte": 24.999}}, [2]),
        ({"n": {"not": 7.5}}, [1, 2]),
        ({"n": {"in": [7, 7.5, 10**12]}}, [1]),
        ({"n": {"lt": float("inf")}}, [1, 2]),
        ({"big": 2**53 + 1}, [1]),
        ({"big": float(2**53)}, []),
        ({"big": {"gt": 5.5}}, [1]),
        ({"real": 7}, [2]),
        ({"dec": Decimal("1.1")}, [1]),
        ({"dec": "1.10"}, [1]),
        ({"dec": {"gt": 1.105}}, [2]),
        ({"at": datetime(2020, 1, 1, 14, tzinfo=timezone(timedelta(hours=2)))}, [1]),
        ({"at": "2020-01-01T12:00:00Z"}, [1]),
        ({"at": {"gte": datetime(2020, 1, 2).date()}}, [2]),
        ({"raw": b"\x00a"}, [1]),
    ],
)
def test_operands(db, where, want):
    assert sorted(r["id"] for r in db.thing.find_many(where=where).collect()) == want


@pytest.mark.parametrize("where", [{"n": "7"}, {"n": True}, {"code": 5}, {"flag": 1}, {"at": "soon"}, {"dec": "x"}, {"real": "1"}, {"raw": "a"}])
def test_wrong_kinds(db, where):
    with pytest.raises(QueryValidationError):
        db.thing.find_many(where=where)


def test_wide_values_in_having_and_cursor(db):
    assert db.thing.group_by(by=["n"], having={"n": {"lt": 7.5}}).count() == 1
    assert db.thing.group_by(by=["id"], having={"n": {"_max": {"gt": 24.5}}}).count() == 1
    assert [r["id"] for r in db.thing.find_many(cursor={"n": 7.5}).collect()] == [2]


def test_helper_columns(db):
    out = {r["id"]: r["parts"] for r in db.thing.find_many(include={"parts": {"orderBy": {"_at": "desc"}, "take": 5}}).collect()}
    assert [(p["_k0"], p["_at"], p["_rank"], p["_rows"]) for p in out[1]] == [(10, 55, 3, 1), (11, 54, 3, 2)] and out[3] == []
    out = {r["id"]: [p["_at"] for p in r["parts"]] for r in db.thing.find_many(include={"parts": {"orderBy": {"_at": "asc"}}}).collect()}
    assert out == {1: [54, 55], 2: [53], 3: []}
    rows = db.part.find_many(distinct=["_rank"], orderBy={"_at": "asc"}, include={"thing": True}).collect()
    assert sorted((r["_rank"], r["_at"], r["thing"] and r["thing"]["id"]) for r in rows) == [(1, 1, None), (3, 54, 1), (4, 53, 2)]
    assert sorted((r["id"], r["_count"]["parts"]) for r in db.thing.find_many(include={"_count": True}).collect()) == [(1, 2), (2, 1), (3, 0)]
    db.thing.delete(where={"id": 1})
    assert db.part.count().first()["count"] == 4


def test_plans(db):
    plan = db.part.find_many(include={"thing": True})._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan
    plan = db.thing.find_many(include={"parts": {"orderBy": {"_at": "desc"}}})._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "isnotnull(thingId" in plan


def test_inserts(db):
    import time

    began = time.perf_counter()
    assert db.part.create_many(data=[{"_k0": 1000 + k, "_at": k, "_rank": 0} for k in range(10_000)]) == 10_000
    assert time.perf_counter() - began < 10 and db.part.count().first()["count"] == 10_004
    for data in ([{"id": 1}], [{"id": 9}, {"id": 9}], [{"id": 9, "code": "a"}], [{"id": 8, "code": "z"}, {"id": 9, "code": "z"}]):
        with pytest.raises(UniqueConstraintError):
            db.thing.create_many(data=data)
    assert db.thing.create_many(data=[{"id": 1}, {"id": 8, "code": "b"}, {"id": 9, "code": "z"}, {"id": 10, "code": "z"}, {"id": 11}, {"id": 11}], skipDuplicates=True) == 2
    with pytest.raises(QueryValidationError):
        db.thing.create(data={"id": 20, "n": 7.5})
    with pytest.raises(QueryValidationError):
        db.thing.update_many(data={"n": 2**31})
    row = db.thing.create(data={"id": 30, "dec": "1.005", "at": "2021-01-01T01:00:00+01:00", "raw": b"x", "real": 1}).first()
    assert (row["dec"], row["at"], bytes(row["raw"]), row["real"]) == (Decimal("1.00"), datetime(2021, 1, 1), b"x", 1.0)


def test_update_is_one_pass(db):
    assert db.thing.update_many(where={"parts": {"some": {"_at": {"gt": 53}}}}, data={"n": {"increment": 1}, "code": "new"}) == 1
    assert [(r["id"], r["n"], r["code"]) for r in db.thing.find_many(orderBy={"id": "asc"}).collect()] == [(1, 8, "new"), (2, 25, "b"), (3, None, None)]


def test_json_out(db):
    rows = [json.loads(r["value"]) for r in json_rows(db.thing.find_many(orderBy={"id": "asc"}, include={"parts": {"select": {"_at": True}}})).collect()]
    assert rows[0] == {"id": 1, "n": 7, "big": str(2**53 + 1), "real": 0.5, "dec": 1.10, "at": "2020-01-01T12:00:00.000Z", "raw": {"$type": "bytes", "base64": "AGE="}, "flag": True, "code": "a", "parts": [{"_at": 55}, {"_at": 54}]}
    assert rows[2]["raw"] is None and rows[2]["at"] is None and rows[2]["parts"] == []


def test_json_in(db):
    schema = load(SCHEMA)
    thing = schema.model("Thing")
    where = typed_where(schema, thing, {"AND": [{"big": "9007199254740993"}, {"NOT": {"n": {"in": ["1", "2"]}}}], "raw": {"equals": {"$type": "bytes", "base64": "AGE="}}, "at": {"lte": "2020-01-01T12:00:00.000Z"}, "parts": {"some": {"_at": {"gt": "53"}}}, "odd": "x"})
    assert where.pop("odd") == "x" and where["raw"] == {"equals": b"\x00a"}
    assert [r["id"] for r in db.thing.find_many(where=where).collect()] == [1]
    data = typed_data(schema, thing, {"id": "40", "big": "12", "flag": "true", "n": {"increment": "2"}, "parts": {"create": [{"_k0": "70"}], "connect": {"_k0": "71"}}})
    assert data == {"id": 40, "big": 12, "flag": True, "n": {"increment": 2}, "parts": {"create": [{"_k0": 70}], "connect": {"_k0": 71}}}
    with pytest.raises(QueryValidationError):
        typed_data(schema, thing, {"id": "4x"})


def test_introspection(spark):
    def table(ddl):
        return spark.createDataFrame([], ddl)

    tables = {"USERS": table("USER_ID int, EMAIL string, BALANCE decimal(10,2), BORN date"), "blog_post": table("id bigint, author_id int, editor_id int, tags array<string>, at timestamp_ntz"), "VOTES": table("post_id bigint, user_id int, n smallint")}
    refs = [Reference("blog_post", ("author_id",), "USERS", ("USER_ID",)), Reference("blog_post", ("editor_id",), "USERS", ("USER_ID",)), Reference("VOTES", ("post_id",), "blog_post", ("id",))]
    found = introspect(tables, keys={"USERS": ["USER_ID"], "blog_post": ["id"], "VOTES": ["post_id", "user_id"]}, uniques={"USERS": [["EMAIL"]]}, references=refs)
    user, post, votes = found.models
    assert (user.name, user.db_name, user.id_fields, user.field("email").unique, user.field("balance").native) == ("Users", "USERS", ("userId",), True, ("Decimal", (10, 2)))
    assert post.field("tags").type == "Json" and post.field("users").relation.fields == ("authorId",) and post.field("users2").relation.fields == ("editorId",)
    assert votes.id_fields == ("postId", "userId") and not votes.field("postId").optional
    text = render(found)
    assert render(load(text)) == text and parse(text).model("BlogPost").db_name == "blog_post"
    db = Client(spark, found, {**{k: v for k, v in tables.items()}, "USERS": spark.createDataFrame([(1, "a@x", Decimal(1), None)], tables["USERS"].schema), "blog_post": spark.createDataFrame([(5, 1, None, ["x"], None)], tables["blog_post"].schema)})
    assert db.blogPost.find_many(include={"users": True}).first()["users"]["email"] == "a@x"
    spark.range(3).createOrReplaceTempView("introspected")
    assert introspect_catalog(spark).model("Introspected").field("id").type == "BigInt"
    assert Row(table="introspected", column="id", type="bigint", nullable=False, position=0) in catalog_tables(spark).collect()
    spark.catalog.dropTempView("introspected")


def test_raw(db, spark):
    spark.range(2).createOrReplaceTempView("thing")
    assert db.query_raw(["SELECT id FROM thing WHERE n > ", " AND id < ", ""], 7, 10).first()["id"] == 2
    assert spark.table("thing").columns == ["id"] and spark.table("thing").count() == 2
    spark.catalog.dropTempView("thing")
    with pytest.raises(QueryValidationError):
        db.query_raw(["a", "b"])
    with pytest.raises(QueryValidationError, match="update_many"):
        db.execute_raw("DELETE FROM thing")


def test_follow(db):
    assert sorted(r["_k0"] for r in db.thing.follow({"id": 1}).parts().rows().collect()) == [10, 11]
    rows = db.part.follow({"_at": {"gt": 50}}).thing().parts({"_at": {"lt": 55}}).rows(orderBy={"_at": "asc"}, take=1, select={"_at": True})
    assert [r["_at"] for r in rows.collect()] == [53]
    with pytest.raises(AttributeError):
        db.part.follow({}).nothing()


def test_listener_gets_plans_when_asked(db):
    heard = []
    db.on("query", heard.append)
    db.thing.find_many(where={"n": 7})
    assert "Filter" in heard[0]["plan"]() and heard[0]["model"] == "Thing"


def test_defaults_and_stamps(spark):
    db = Client(spark, 'model A {\n id Int @id @default(autoincrement())\n u String @default(uuid())\n c String @default(cuid())\n at DateTime @default(now())\n up DateTime @updatedAt\n s String @default("x")\n}', {"A": spark.createDataFrame([], "id int, u string, c string, at timestamp_ntz, up timestamp_ntz, s string")})
    first, second = (db.a.create(data={}).first() for _ in range(2))
    assert (first["id"], second["id"], first["s"]) == (1, 2, "x") and first["u"] != second["u"] and first["c"][0] == "c" and first["at"] is not None
    assert db.a.update(where={"id": 1}, data={"s": "y"}).first()["up"] >= first["up"]
    assert db.a.update(where={"id": 2}, data={}).first()["up"] == second["up"]
    assert db.a.find_many().select(F.count_distinct("c").alias("n")).first()["n"] == 2


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv", "table"])
def test_sources(spark, tmp_path, kind):
    rows = spark.createDataFrame([(1, "x", 0.5), (2, None, 1.5)], "id int, name string, v double")
    schema = "model Row {\n id Int @id\n name String?\n v Float\n @@map(\"kept_rows\")\n}"
    if kind == "table":
        rows.createOrReplaceTempView("kept_rows")
        db = Client(spark, schema, "table:")
    else:
        rows.write.format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(f"{tmp_path}/kept_rows.{kind}")
        db = Client(spark, schema, f"{kind}:{tmp_path}", **({"inferSchema": "true"} if kind == "csv" else {}))
    assert [(r["id"], r["name"], r["v"]) for r in db.row.find_many(where={"v": {"gte": 0.5}}, orderBy={"id": "asc"}).collect()] == [(1, "x", 0.5), (2, None, 1.5)]
    if kind == "table":
        spark.catalog.dropTempView("kept_rows")
