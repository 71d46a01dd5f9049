"""The registered corpus queries against their SQL; the others against brute force or planted rows."""

import pytest

from gridcast.llm.queries import QUERIES, SQL
from tests.oracle_check import compare, views

SF = "/root/testdata/sf0.001"
TABLES = {n: f"{SF}/{n}.parquet" for n in ("documents", "pages", "conversations", "labels", "benchmark", "embeddings")}


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(SQL) < set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    verdict, rows = compare(QUERIES[name](spark, SF), views(SF), SQL[name])
    assert verdict == "ok" and rows > 0, verdict


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for table, path in TABLES.items():
        spark.read.parquet(path).limit(0).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == (1 if name == "op7_chat_format" else 0)
