import pytest

from sparquill.errors import QueryValidationError
from sparquill.plans.queries import client
from sparquill.streaming import find_in_stream


def test_filter_and_select(spark, sf_dir, tmp_path):
    db = client(spark, sf_dir)
    table = spark.read.parquet(f"{sf_dir}/orders.parquet")
    table.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    where = {"totalprice": {"gt": 300000}, "customer": {"is": {"mktsegment": "BUILDING"}}}
    out = find_in_stream(db, "Order", stream, where, {"orderkey": True})
    query = out.writeStream.format("memory").queryName("found").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/at").start()
    query.awaitTermination()
    want = db.order.find_many(where=where, select={"orderkey": True})
    assert sorted(r[0] for r in spark.table("found").collect()) == sorted(r[0] for r in want.collect()) != []
    with pytest.raises(QueryValidationError):
        find_in_stream(db, "Order", stream, select={"lines": True})
