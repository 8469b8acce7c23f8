import duckdb
import pytest

from recollect.llm.queries import ORACLES, QUERIES


def test_the_method_stands_first():
    names = list(QUERIES)
    assert names.index("p5_method") < names.index("p5_found") and names.index("p6_method") < names.index("p6_found")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_runs_on_the_smallest_tables(spark, data, name):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    assert rows
    if name in ORACLES:
        import glob
        import os

        c = duckdb.connect()
        for p in glob.glob(f"{data}/*.parquet"):
            c.execute(f"create view \"{os.path.basename(p)[:-8]}\" as select * from '{p}'")
        r = c.sql(ORACLES[name])
        want = sorted(map(str, r.select(*sorted(df.columns)).fetchall()))
        assert sorted(str(tuple(x[k] for k in sorted(df.columns))) for x in rows) == want


def test_columns():
    from pyspark.sql import SparkSession

    s = SparkSession.getActiveSession()
    d = "/root/testdata/sf0.001"
    want = {
        "p1_found": "rel:string,row_key:string,kind:string", "p2_found": "fact_id:bigint", "p3_found": "query_id:bigint,id:string", "p4_found": "rel:string,row_key:string,field:string", "p5_found": "session_id:string",
        "p6_found": "rel:string,row_key:string", "p8_ids": "doc_id:bigint,ids:array<int>", "p10_found": "doc_id:bigint",
    }
    for name, columns in want.items():
        assert QUERIES[name](s, d).schema.simpleString() == f"struct<{columns}>", name
