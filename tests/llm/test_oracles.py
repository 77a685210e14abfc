from pathlib import Path

import duckdb
import pytest

from rivulet.llm import queries

DATA = "/root/testdata/sf0.001"


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want


def test_contract_columns(spark):
    from pyspark.sql import functions as F

    for name, mod, rest in (("op1_quality", 5, 0), ("op10_toxicity", 4, 2)):
        df = queries.queries()[name](spark, DATA)
        assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
        held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(mod)) == rest
        assert df.where((F.col("held_out") != held) | (F.col("predicted") != (F.col("score") >= 0.3).cast("int")) | ~F.col("score").between(0, 1)).isEmpty()
        assert df.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    df = queries.queries()["op5_langid"](spark, DATA)
    assert df.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
