"""One query per operator, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..client import Client
from ..functions.json_rows import json_rows, typed_data, typed_where
from ..schema import load
from .star import SCHEMA

_SCHEMA = load(SCHEMA)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_O = "o_orderkey AS orderkey, o_custkey AS custkey, o_orderstatus AS orderstatus, o_totalprice AS totalprice, o_orderdate AS orderdate, o_orderpriority AS orderpriority"
_C = "c_custkey AS custkey, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS mktsegment"
_P = "p_partkey AS partkey, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size, p_retailprice AS retailprice"
_E = "event_id, ts, user_id, event_type, value, props"
_S = "s_suppkey AS suppkey, s_name AS name, s_nationkey AS nationkey, s_acctbal AS acctbal"


def client(spark: SparkSession, sf_dir: str) -> Client:
    return Client(spark, _SCHEMA, f"parquet:{sf_dir}" if ":" not in sf_dir else lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def query(sql: str):
    """Register a function of a client as the query of its name."""

    def add(make: Callable[[Client], DataFrame]):
        QUERIES[make.__name__] = lambda spark, sf_dir: make(client(spark, sf_dir))
        ORACLE_SQL[make.__name__] = sql
        return make

    return add


def filters(name: str, model: str, where: dict, sql: str, shown: str) -> None:
    table = _SCHEMA.model(model).db_name
    QUERIES[name] = lambda spark, sf_dir: client(spark, sf_dir)[model].find_many(where=where)
    ORACLE_SQL[name] = f"SELECT {shown} FROM {table} WHERE {sql}"


# Predicates.
filters("where_equals", "Order", {"orderstatus": "O"}, "o_orderstatus = 'O'", _O)
filters("where_equals_operator", "Part", {"size": {"equals": 7}}, "p_size = 7", _P)
filters("where_is_null", "Customer", {"name": None}, "c_name IS NULL", _C)
filters("where_not", "Order", {"orderstatus": {"not": "F"}}, "o_orderstatus <> 'F'", _O)
filters("where_not_null", "Order", {"orderpriority": {"not": None}}, "o_orderpriority IS NOT NULL", _O)
filters("where_not_filter", "Part", {"size": {"not": {"gte": 10, "lt": 40}}}, "NOT (p_size >= 10 AND p_size < 40)", _P)
filters("where_in", "Customer", {"mktsegment": {"in": ["BUILDING", "MACHINERY"]}}, "c_mktsegment IN ('BUILDING', 'MACHINERY')", _C)
filters("where_not_in", "Customer", {"mktsegment": {"notIn": ["BUILDING", "MACHINERY"]}}, "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')", _C)
filters("where_in_empty", "Customer", {"custkey": {"in": []}}, "1 = 0", _C)
filters("where_not_in_empty", "Supplier", {"suppkey": {"notIn": []}}, "1 = 1", _S)
filters("where_not_in_null", "Supplier", {"suppkey": {"notIn": [1, None]}}, "s_suppkey NOT IN (1, NULL)", _S)
filters("where_range", "Order", {"totalprice": {"gte": 100000, "lt": 200000}}, "o_totalprice >= 100000 AND o_totalprice < 200000", _O)
filters("where_datetime", "Order", {"orderdate": {"gte": datetime(1995, 1, 1), "lt": datetime(1996, 1, 1)}}, "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'", _O)
filters("where_zone", "Order", {"orderdate": {"lt": datetime(1995, 1, 1, 2, tzinfo=timezone(timedelta(hours=2)))}}, "o_orderdate < TIMESTAMP '1995-01-01'", _O)
filters("where_fraction_of_int", "Part", {"size": {"lt": 25.5, "not": 7.5}}, "p_size < 25.5 AND p_size <> 7.5", _P)
filters("where_beyond_int", "Part", {"size": {"lt": 3_000_000_000}, "NOT": {"size": 2.5}}, "p_size < 3000000000 AND NOT (p_size = 2.5)", _P)
filters("where_contains", "Part", {"name": {"contains": "d wid"}}, "contains(p_name, 'd wid')", _P)
filters("where_contains_literal", "Part", {"name": {"contains": "_1%"}}, "contains(p_name, '_1%')", _P)
filters("where_starts_with", "Part", {"brand": {"startsWith": "Brand#1"}}, "starts_with(p_brand, 'Brand#1')", _P)
filters("where_ends_with", "Part", {"brand": {"endsWith": "3"}}, "ends_with(p_brand, '3')", _P)
filters("where_insensitive", "Customer", {"mktsegment": {"contains": "bUiL", "mode": "insensitive"}}, "contains(upper(c_mktsegment), 'BUIL')", _C)
filters("where_insensitive_in", "Customer", {"mktsegment": {"in": ["building", "Machinery"], "mode": "insensitive"}}, "upper(c_mktsegment) IN ('BUILDING', 'MACHINERY')", _C)
filters("where_mode_alone", "Supplier", {"name": {"mode": "insensitive"}}, "1 = 1", _S)
filters("where_and_or_not", "Order", {"AND": [{"orderstatus": "O"}, {"OR": [{"totalprice": {"gt": 300000}}, {"orderpriority": {"startsWith": "1"}}]}], "NOT": {"custkey": {"lt": 100}}}, "o_orderstatus = 'O' AND (o_totalprice > 300000 OR o_orderpriority LIKE '1%') AND NOT (o_custkey < 100)", _O)
filters("where_or_empty", "Supplier", {"OR": []}, "1 = 1", _S)
filters("where_or_empty_member", "Supplier", {"OR": [{}, {"suppkey": 1}]}, "s_suppkey = 1", _S)
filters("where_not_list", "Order", {"NOT": [{"orderstatus": "O"}, {"totalprice": {"gt": 50000}}]}, "NOT (o_orderstatus = 'O' AND o_totalprice > 50000)", _O)
filters("json_equals", "Event", {"props": {"equals": '{"k": 69}'}}, "props = '{\"k\": 69}'", _E)
filters("json_not", "Event", {"props": {"not": '{"k": 69}'}}, "props <> '{\"k\": 69}'", _E)
filters("json_object_equals", "Event", {"props": {"equals": {"k": 69}}}, "props = '{\"k\":69}'", _E)
filters("json_string_contains", "Event", {"props": {"string_contains": ": 7"}}, "contains(props, ': 7')", _E)
filters("json_string_starts_with", "Event", {"props": {"string_starts_with": '{"k": 1'}}, "starts_with(props, '{\"k\": 1')", _E)
filters("json_string_ends_with", "Event", {"props": {"string_ends_with": "0}"}}, "ends_with(props, '0}')", _E)

# Relations: semi, anti and existence joins.
_LINES = "SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey"
_DOC = "doc_id, lang, source, n_chars"
filters("rel_some", "Order", {"lines": {"some": {"quantity": {"gt": 45}}}}, f"EXISTS ({_LINES} AND l_quantity > 45)", _O)
filters("rel_some_any", "Order", {"lines": {"some": {}}}, f"EXISTS ({_LINES})", _O)
filters("rel_none", "Order", {"lines": {"none": {"quantity": {"gt": 45}}}}, f"NOT EXISTS ({_LINES} AND l_quantity > 45)", _O)
filters("rel_none_any", "Order", {"lines": {"none": {}}}, f"NOT EXISTS ({_LINES})", _O)
filters("rel_every", "Order", {"lines": {"every": {"quantity": {"gt": 10}}}}, f"NOT EXISTS ({_LINES} AND NOT (l_quantity > 10))", _O)
filters("rel_every_empty", "Order", {"lines": {"every": {}}}, f"NOT EXISTS ({_LINES})", _O)
filters("rel_is", "Customer", {"nation": {"is": {"name": {"startsWith": "N"}}}}, "EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_name LIKE 'N%')", _C)
filters("rel_is_shorthand", "Customer", {"nation": {"regionkey": 2}}, "EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 2)", _C)
filters("rel_is_not", "Document", {"label": {"isNot": {"quality": 1}}}, "NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND quality = 1)", _DOC)
filters("rel_is_null", "Document", {"label": {"is": None}}, "NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)", _DOC)
filters("rel_is_not_null", "Document", {"label": {"isNot": None}}, "EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)", _DOC)
filters("rel_null_shorthand", "Document", {"label": None}, "EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)", _DOC)
filters("rel_without_quantifier", "Order", {"lines": {"quantity": 5}, "orderstatus": "P"}, "o_orderstatus = 'P'", _O)
filters("rel_quantifiers", "Order", {"lines": {"some": {"returnflag": "R"}, "none": {"returnflag": "A"}}}, f"EXISTS ({_LINES} AND l_returnflag = 'R') AND NOT EXISTS ({_LINES} AND l_returnflag = 'A')", _O)
filters("rel_nested", "Region", {"nations": {"some": {"customers": {"some": {"orders": {"some": {"totalprice": {"gt": 490000}}}}}}}}, "EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000)))", "r_regionkey AS regionkey, r_name AS name")
filters("rel_under_or", "Customer", {"OR": [{"acctbal": {"lt": 0}}, {"events": {"some": {"value": {"gt": 90}}}}]}, "c_acctbal < 0 OR EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND value > 90)", _C)
filters("rel_under_not", "Customer", {"NOT": {"events": {"some": {}}}}, "NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)", _C)


# Projection, order, pages.
@query("SELECT o_orderkey AS orderkey, o_totalprice AS totalprice FROM orders WHERE o_totalprice > 400000")
def select_fields(db):
    return db.order.find_many(where={"totalprice": {"gt": 400000}}, select={"orderkey": True, "totalprice": True, "custkey": False})


@query("SELECT c_custkey AS custkey, c_nationkey AS nationkey, c_mktsegment AS mktsegment FROM customer")
def omit_fields(db):
    return db.customer.find_many(omit={"name": True, "acctbal": True})


@query("SELECT o_orderkey AS orderkey, o_totalprice AS totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 200000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def order_take_skip(db):
    return db.order.find_many(where={"orderstatus": "O", "totalprice": {"gte": 200000}}, select={"orderkey": True, "totalprice": True}, orderBy=[{"totalprice": "desc"}, {"orderkey": "asc"}], take=20, skip=10)


@query("SELECT o_orderkey AS orderkey FROM orders WHERE 1 = 0")
def take_none(db):
    return db.order.find_many(select={"orderkey": True}, take=0)


@query("SELECT o_orderkey AS orderkey, o_totalprice AS totalprice FROM orders WHERE o_orderkey >= 500 ORDER BY o_orderkey LIMIT 50")
def cursor_single(db):
    return db.order.find_many(cursor={"orderkey": 500}, take=50, select={"orderkey": True, "totalprice": True})


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id < 20 OR (conv_id = 20 AND turn >= 1) ORDER BY conv_id DESC, turn LIMIT 30")
def cursor_composite(db):
    return db.message.find_many(cursor={"conv_id": 20, "turn": 1}, orderBy=[{"conv_id": "desc"}, {"turn": "asc"}], take=30, select={"conv_id": True, "turn": True, "role": True})


@query("SELECT o_custkey AS custkey, o_orderkey AS orderkey, o_totalprice AS totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def distinct_on(db):
    return db.order.find_many(distinct=["custkey"], orderBy=[{"totalprice": "desc"}], select={"custkey": True, "orderkey": True, "totalprice": True})


@query("SELECT * FROM (SELECT o_custkey AS custkey, o_orderkey AS orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_custkey, o_orderkey) = 1) ORDER BY custkey LIMIT 10 OFFSET 5")
def distinct_paginated(db):
    return db.order.find_many(distinct=["custkey"], orderBy=[{"custkey": "asc"}], select={"custkey": True, "orderkey": True}, take=10, skip=5)


@query("SELECT p_partkey AS partkey, p_brand AS brand, p_type AS type FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) = 1")
def distinct_by_key(db):
    return db.part.find_many(distinct=["brand", "type"], select={"partkey": True, "brand": True, "type": True})


@query("SELECT o_orderkey AS orderkey, o_totalprice AS totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def find_first(db):
    return db.order.find_first(orderBy=[{"totalprice": "desc"}, {"orderkey": "asc"}], select={"orderkey": True, "totalprice": True})


@query(f"SELECT {_C} FROM customer WHERE c_custkey = 7")
def find_unique(db):
    return db.customer.find_unique(where={"custkey": 7})


# Aggregates.
@query("SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'P'")
def count_rows(db):
    return db.order.count(where={"orderstatus": "P"})


@query("SELECT count(*) AS count FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'O' LIMIT 100 OFFSET 20)")
def count_paged(db):
    return db.order.count(where={"orderstatus": "O"}, take=100, skip=20)


@query("SELECT count(*) AS _count_all, count(p_brand) AS _count_brand FROM part WHERE p_size > 25")
def count_select(db):
    return db.part.count(where={"size": {"gt": 25}}, select={"_all": True, "brand": True})


@query("SELECT count(*) AS _count_all, CAST(sum(p_size) AS BIGINT) AS _sum_size, avg(p_size) AS _avg_size, min(p_name) AS _min_name, max(p_retailprice) AS _max_retailprice FROM part WHERE p_size >= 10")
def aggregate_all(db):
    return db.part.aggregate(where={"size": {"gte": 10}}, _count=True, _sum={"size": True}, _avg={"size": True}, _min={"name": True}, _max={"retailprice": True})


@query("SELECT p_brand AS brand, count(*) AS _count_all, CAST(sum(p_size) AS BIGINT) AS _sum_size, max(p_retailprice) AS _max_retailprice FROM part GROUP BY p_brand")
def group_by(db):
    return db.part.group_by(by=["brand"], _count=True, _sum={"size": True}, _max={"retailprice": True})


@query("SELECT p_brand AS brand, p_type AS type, count(*) AS _count_all FROM part GROUP BY p_brand, p_type HAVING sum(p_size) > 30 AND count(p_partkey) >= 2")
def group_by_having_aggregate(db):
    return db.part.group_by(by=["brand", "type"], _count={"_all": True}, having={"size": {"_sum": {"gt": 30}}, "_count": {"partkey": {"gte": 2}}})


@query("SELECT o_orderstatus AS orderstatus, count(*) AS _count_all FROM orders GROUP BY o_orderstatus HAVING o_orderstatus IN ('O', 'F')")
def group_by_having_column(db):
    return db.order.group_by(by=["orderstatus"], _count=True, having={"orderstatus": {"in": ["O", "F"]}})


@query("SELECT o_custkey AS custkey, max(o_totalprice) AS _max_totalprice FROM orders GROUP BY o_custkey HAVING (count(*) > 12 OR max(o_totalprice) > 490000) AND NOT (min(o_totalprice) < 2000)")
def group_by_having_composed(db):
    return db.order.group_by(by=["custkey"], _max={"totalprice": True}, having={"OR": [{"_count": {"_all": {"gt": 12}}}, {"totalprice": {"_max": {"gt": 490000}}}], "NOT": {"totalprice": {"_min": {"lt": 2000}}}})


@query("SELECT count(*) AS _count_all, CAST(sum(p_size) AS BIGINT) AS _sum_size FROM part WHERE p_size < 30")
def aggregate_without_page(db):
    return db.part.aggregate(where={"size": {"lt": 30}}, _count=True, _sum={"size": True}, orderBy={"size": "asc"}, take=3, skip=2)


@query("SELECT p_brand AS brand, count(*) AS _count_all FROM part GROUP BY p_brand ORDER BY p_brand DESC")
def group_by_ordered(db):
    return db.part.group_by(by=["brand"], _count=True, orderBy={"brand": "desc"})


@query("SELECT p_brand AS brand, p_size AS size, count(*) AS _count_all FROM part GROUP BY p_brand, p_size HAVING count(*) <= 3 AND count(*) <> 2 OR p_size = 7 AND min(p_partkey) = max(p_partkey)")
def group_by_having_comparisons(db):
    single = {"OR": [{"AND": [{"_count": {"_all": {"lte": 3, "not": 2}}}]}, {"size": 7, "_count": {"partkey": {"equals": 1}}}]}
    return db.part.group_by(by=["brand", "size"], _count=True, having=single)


@query("SELECT DISTINCT p_brand AS brand, p_size AS size FROM part")
def group_by_no_aggregate(db):
    return db.part.group_by(by=["brand", "size"])


@query("SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, count(*) AS _count_all, round(sum(l_quantity), 2) AS sum_quantity, round(avg(l_discount), 6) AS avg_discount, round(sum(l_extendedprice), 0) AS sum_price FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(db):
    out = db.lineItem.group_by(by=["returnflag", "linestatus"], where={"shipdate": {"lte": datetime(1998, 9, 2)}}, _count=True, _sum={"quantity": True, "extendedprice": True}, _avg={"discount": True})
    return out.select("returnflag", "linestatus", "_count_all", F.round("_sum_quantity", 2).alias("sum_quantity"), F.round("_avg_discount", 6).alias("avg_discount"), F.round("_sum_extendedprice", 0).alias("sum_price"))


# Related rows, flattened for comparison.
@query("SELECT n_nationkey AS nationkey, s_suppkey AS suppkey, s_acctbal AS acctbal FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def include_to_many(db):
    return db.nation.find_many(include={"suppliers": True}).select("nationkey", F.explode("suppliers").alias("s")).select("nationkey", "s.suppkey", "s.acctbal")


@query("SELECT c_custkey AS custkey, n_name AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def include_to_one(db):
    return db.customer.find_many(include={"nation": True}).select("custkey", F.col("nation.name").alias("nation"))


@query("SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def include_to_one_optional(db):
    return db.document.find_many(include={"label": True}).select("doc_id", F.col("label.quality").alias("quality"))


@query("SELECT r_name AS region, n_name AS nation, s_suppkey AS suppkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 0")
def include_nested(db):
    out = db.region.find_many(select={"name": True, "nations": {"select": {"name": True, "suppliers": {"where": {"acctbal": {"gt": 0}}, "select": {"suppkey": True}}}}})
    return out.select(F.col("name").alias("region"), F.explode("nations").alias("n")).select("region", F.col("n.name").alias("nation"), F.explode("n.suppliers").alias("s")).select("region", "nation", "s.suppkey")


@query("SELECT custkey, at, orderkey, totalprice FROM (SELECT c_custkey AS custkey, o_orderkey AS orderkey, o_totalprice AS totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) - 2 AS \"at\" FROM customer JOIN orders ON o_custkey = c_custkey) WHERE \"at\" BETWEEN 0 AND 2".replace("custkey, at,", 'custkey, CAST("at" AS INT) AS "at",'))
def include_take_per_parent(db):
    out = db.customer.find_many(include={"orders": {"orderBy": {"totalprice": "desc"}, "take": 3, "skip": 1}})
    return out.select("custkey", F.posexplode("orders").alias("at", "o")).select("custkey", "at", "o.orderkey", "o.totalprice")


@query("SELECT c_custkey AS custkey, o_orderstatus AS orderstatus, o_orderkey AS orderkey FROM customer JOIN orders ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) = 1")
def include_distinct(db):
    out = db.customer.find_many(include={"orders": {"distinct": ["orderstatus"], "orderBy": {"totalprice": "desc"}}})
    return out.select("custkey", F.explode("orders").alias("o")).select("custkey", "o.orderstatus", "o.orderkey")


@query("SELECT custkey, CAST(place AS INT) AS place, orderkey FROM (SELECT c_custkey AS custkey, o_orderkey AS orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey) - 1 AS place FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'O')")
def include_ordered(db):
    out = db.customer.find_many(include={"orders": {"where": {"orderstatus": "O"}, "orderBy": [{"orderpriority": "desc"}, {"totalprice": "asc"}]}})
    return out.select("custkey", F.posexplode("orders").alias("place", "o")).select("custkey", "place", "o.orderkey")


@query("SELECT o_orderkey AS orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 20) AS n FROM orders")
def relation_count(db):
    return db.order.find_many(include={"_count": {"select": {"lines": {"where": {"quantity": {"gt": 20}}}}}}).select("orderkey", F.col("_count.lines").alias("n"))


@query(f"SELECT {_O} FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey = 11) AND o_totalprice > 1000")
def fluent_traverse(db):
    return db.customer.traverse({"custkey": 11}, "orders", {"where": {"totalprice": {"gt": 1000}}})


@query("SELECT l_orderkey AS orderkey, l_quantity AS quantity FROM lineitem WHERE l_quantity > 48 AND EXISTS (SELECT 1 FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = l_orderkey AND c_nationkey = 3 AND o_orderstatus = 'O')")
def follow_chain(db):
    return db.nation.follow({"nationkey": 3}).customers().orders({"orderstatus": "O"}).lines({"quantity": {"gt": 48}}).rows(select={"orderkey": True, "quantity": True})


# The table after a write.
@query("SELECT p_partkey AS partkey, CASE WHEN p_brand = 'Brand#11' THEN p_size + 5 ELSE p_size END AS size, CASE WHEN p_brand = 'Brand#11' THEN p_retailprice * 2 ELSE p_retailprice END AS retailprice FROM part")
def update_increment(db):
    db.part.update_many(where={"brand": "Brand#11"}, data={"size": {"increment": 5}, "retailprice": {"multiply": 2}})
    return db.part.find_many(select={"partkey": True, "size": True, "retailprice": True})


@query("SELECT c_custkey AS custkey, CASE WHEN NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey) THEN 'IDLE' ELSE c_mktsegment END AS mktsegment FROM customer")
def update_by_relation(db):
    db.customer.update_many(where={"events": {"none": {}}}, data={"mktsegment": {"set": "IDLE"}})
    return db.customer.find_many(select={"custkey": True, "mktsegment": True})


@query("SELECT o_orderkey AS orderkey, o_orderstatus AS orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 100000)")
def delete_many(db):
    db.order.delete_many(where={"orderstatus": "F", "totalprice": {"lt": 100000}})
    return db.order.find_many(select={"orderkey": True, "orderstatus": True})


@query("SELECT r_regionkey AS regionkey, r_name AS name FROM region UNION ALL VALUES (100, 'NORTH'), (101, 'SOUTH')")
def create_many(db):
    db.region.create_many(data=[{"regionkey": 100, "name": "NORTH"}, {"regionkey": 0, "name": "AGAIN"}, {"regionkey": 101, "name": "SOUTH"}], skipDuplicates=True)
    return db.region.find_many()


@query("SELECT r_regionkey AS regionkey, CASE WHEN r_regionkey = 2 THEN 'CHANGED' ELSE r_name END AS name FROM region UNION ALL VALUES (50, 'NEW')")
def upsert(db):
    for key in (2, 50):
        db.region.upsert(where={"regionkey": key}, create={"regionkey": key, "name": "NEW"}, update={"name": "CHANGED"})
    return db.region.find_many()


@query("SELECT n_nationkey AS nationkey, n_name AS name, n_regionkey AS regionkey FROM nation UNION ALL VALUES (90, 'ATLANTIS', 77), (91, 'LEMURIA', 77)")
def create_nested(db):
    db.region.create(data={"regionkey": 77, "name": "OCEAN", "nations": {"create": [{"nationkey": 90, "name": "ATLANTIS"}, {"nationkey": 91, "name": "LEMURIA"}]}})
    return db.nation.find_many()


@query("SELECT c_custkey AS custkey, CASE WHEN c_custkey = 5 THEN 'ONE' ELSE c_mktsegment END AS mktsegment, CASE WHEN c_custkey = 5 THEN c_acctbal - 10 ELSE c_acctbal END AS acctbal FROM customer")
def update_one(db):
    db.customer.update(where={"custkey": 5}, data={"mktsegment": "ONE", "acctbal": {"decrement": 10}})
    db.customer.update(where={"custkey": 6}, data={})
    return db.customer.find_many(select={"custkey": True, "mktsegment": True, "acctbal": True})


@query("SELECT p_partkey AS partkey, p_size // 4 - 1 AS size, p_retailprice / 8 AS retailprice FROM part")
def update_decrement_divide(db):
    db.part.update_many(data={"size": {"divide": 4}, "retailprice": {"divide": 8}})
    db.part.update_many(data={"size": {"decrement": 1}})
    return db.part.find_many(select={"partkey": True, "size": True, "retailprice": True})


@query("SELECT c_custkey AS custkey FROM customer WHERE c_custkey <> 9")
def delete_one(db):
    db.customer.delete(where={"custkey": 9})
    return db.customer.find_many(select={"custkey": True})


def _with_action(db: Client, action: str) -> Client:
    """The same tables, with what happens to orders when their customer goes."""
    text = SCHEMA.replace("fields: [custkey], references: [custkey])", f"fields: [custkey], references: [custkey], onDelete: {action})")
    return Client(db.spark, load(text), db.source.read)


@query("SELECT o_orderkey AS orderkey FROM orders WHERE o_custkey >= 100")
def delete_cascade(db):
    db = _with_action(db, "Cascade")
    db.customer.delete_many(where={"custkey": {"lt": 100}})
    return db.order.find_many(select={"orderkey": True})


@query("SELECT o_orderkey AS orderkey, CASE WHEN o_custkey >= 100 THEN o_custkey END AS custkey FROM orders")
def delete_set_null(db):
    db = _with_action(db, "SetNull")
    db.customer.delete_many(where={"custkey": {"lt": 100}})
    return db.order.find_many(select={"orderkey": True, "custkey": True})


@query("SELECT p_partkey AS partkey, CASE WHEN p_size > 3 THEN p_brand END AS brand FROM part ORDER BY CASE WHEN p_size > 3 THEN p_brand END NULLS FIRST, p_partkey LIMIT 40")
def order_nulls_first(db):
    db.part.update_many(where={"size": {"lte": 3}}, data={"brand": None})
    return db.part.find_many(orderBy=[{"brand": "asc"}, {"partkey": "asc"}], take=40, select={"partkey": True, "brand": True})


@query("SELECT n_nationkey AS nationkey, CASE WHEN n_nationkey IN (3, 4) THEN 0 WHEN n_regionkey = 0 AND n_nationkey = 5 THEN NULL ELSE n_regionkey END AS regionkey FROM nation WHERE n_nationkey <> 6 UNION ALL VALUES (60, 0), (61, 0)")
def nested_children(db):
    """Of one region's nations: create, connect, disconnect, delete, connectOrCreate."""
    db.region.update(where={"regionkey": 0}, data={"nations": {"create": {"nationkey": 60, "name": "A"}, "connect": [{"nationkey": 3}], "disconnect": {"nationkey": 5, "regionkey": 0}, "delete": [{"nationkey": 6}], "connectOrCreate": [{"where": {"nationkey": 4}, "create": {"nationkey": 4, "name": "B"}}, {"where": {"nationkey": 61}, "create": {"nationkey": 61, "name": "C"}}]}})
    return db.nation.find_many(select={"nationkey": True, "regionkey": True})


@query("SELECT s_suppkey AS suppkey, CASE WHEN s_suppkey = 1 THEN 24 ELSE s_nationkey END AS nationkey FROM supplier UNION ALL VALUES (9001, 91)")
def nested_owner(db):
    """The owning side: connect, and create with the row."""
    db.supplier.update(where={"suppkey": 1}, data={"nation": {"connect": {"nationkey": 24}}})
    db.supplier.create(data={"suppkey": 9001, "name": "NEW", "acctbal": 1.5, "nation": {"create": {"nationkey": 91, "name": "N", "regionkey": 0}}})
    return db.supplier.find_many(select={"suppkey": True, "nationkey": True})


# JSON out and in.
@query("""SELECT '{"custkey":"' || c_custkey || '","mktsegment":"' || c_mktsegment || '","nation":{"name":"' || n_name || '"}}' AS value FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def json_output(db):
    return json_rows(db.customer.find_many(select={"custkey": True, "mktsegment": True, "nation": {"select": {"name": True}}}))


@query(f"SELECT {_O} FROM orders WHERE o_custkey IN (7, 11) AND NOT (o_orderdate < TIMESTAMP '1994-01-01') OR o_orderkey = 1")
def json_arguments(db):
    text = {"OR": [{"custkey": {"in": ["7", "11"]}, "NOT": {"orderdate": {"lt": "1994-01-01T00:00:00.000Z"}}}, {"orderkey": "1"}]}
    return db.order.find_many(where=typed_where(db.schema, db.schema.model("Order"), text))


@query("SELECT r_regionkey AS regionkey, r_name AS name FROM region UNION ALL SELECT 70, 'JSON'")
def json_data(db):
    db.region.create(data=typed_data(db.schema, db.schema.model("Region"), {"regionkey": "70", "name": "JSON"}))
    return db.region.find_many()


# Extension and raw SQL.
@query("SELECT c_custkey AS custkey, upper(c_name) || '/' || c_mktsegment AS label FROM customer")
def computed_field(db):
    more = db.extend(result={"Customer": {"label": {"needs": ["name", "mktsegment"], "compute": lambda c: F.concat(F.upper(c["name"]), F.lit("/"), c["mktsegment"])}}})
    return more.customer.find_many(select={"custkey": True, "label": True}).select("custkey", "label")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 250000 GROUP BY o_orderstatus")
def raw_sql(db):
    return db.query_raw("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > ? GROUP BY o_orderstatus", 250000)


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def raw_template(db):
    return db.query_raw(["SELECT c_custkey FROM customer WHERE c_acctbal > ", " AND c_mktsegment = ", ""], 5000, "BUILDING")


@query("SELECT c_mktsegment AS mktsegment, count(*) AS _count_all, round(avg(c_acctbal), 6) AS avg_acctbal FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) AND EXISTS (SELECT 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = c_nationkey AND r_name IN ('ASIA', 'EUROPE')) GROUP BY c_mktsegment HAVING avg(c_acctbal) > 1000")
def segments_of_large_orders(db):
    return flagship(db)


def flagship(db: Client) -> DataFrame:
    """Segments of customers with a large order whose nation is in one of two regions."""
    where = {"orders": {"some": {"totalprice": {"gt": 450000}}}, "nation": {"is": {"region": {"is": {"name": {"in": ["ASIA", "EUROPE"]}}}}}}
    out = db.customer.group_by(by=["mktsegment"], where=where, _count=True, _avg={"acctbal": True}, having={"acctbal": {"_avg": {"gt": 1000}}})
    return out.select("mktsegment", "_count_all", F.round("_avg_acctbal", 6).alias("avg_acctbal"))
