"""Values that leave the 16 bits of the payload's first field."""

import duckdb
import pytest
from pyspark.sql import functions as F

from canlake.plans import catalog
from test_queries import values

NAMED = """
asc_render
asc_scan
decode_subscribed
encode_batch
encode_unknown
extract_raw
from_physical
to_physical
trace_named
pack_raw
scope_bus
scope_manual
""".split()


@pytest.fixture(scope="module")
def large(spark, sf, tmp_path_factory):
    """Events of which every fifth has a value of 655.36 or more."""
    folder = str(tmp_path_factory.mktemp("large"))
    more = F.when(F.col("event_id") % 5 == 0, F.col("value") + 655.36 * (1 + F.col("event_id") % 7)).otherwise(F.col("value"))
    spark.read.parquet(f"{sf}/events.parquet").withColumn("value", more).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", NAMED)
def test_query_equals_its_sql_beyond_16_bits(spark, large, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{large}/events.parquet/*.parquet'")
    assert values(catalog.queries()[name](spark, large).toPandas()) == values(con.execute(catalog.oracle_sql()[name]).df())
