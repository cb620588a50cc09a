"""Every query of the catalogue against its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from readloom.plans import catalogue, file_queries  # noqa: F401


@pytest.fixture(scope="module")
def tables(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def rows(values):
    def plain(v):
        return None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 8) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(map(plain, r)) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, tables, name):
    frame = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    expected = tables.sql(catalogue.SQL[name])
    assert sorted(expected.columns) == columns
    got = rows(frame.select(*columns).collect())
    order = [expected.columns.index(c) for c in columns]
    assert got == rows([r[i] for i in order] for r in expected.fetchall())


#: Reads (event_id, user_id) whose error probability lies so near the middle between two texts of six digits that the last bit of their confidence decides.
DELICATE = (
    (393507, 1188), (396691, 552), (419278, 670), (612813, 411), (798908, 1394), (932317, 816), (987084, 224), (1015978, 439), (1060980, 321), (1130109, 1333),
    (1450905, 623), (1958757, 1371), (2096225, 80), (2217690, 1110), (2301748, 464), (2317254, 63), (2595465, 1345), (3049604, 1082), (3119406, 400), (3165230, 42),
    (3234348, 1233), (3363123, 1189), (3370071, 545), (3704154, 564), (4086837, 1158), (4384063, 1144), (4743473, 102), (5485019, 1395), (5923190, 319),
)


def both_ways(spark, folder, name):
    """The rows of a query over the delicate reads, and those of its SQL."""
    spark.createDataFrame(DELICATE, "event_id long, user_id long").coalesce(1).write.parquet(f"{folder}/events.parquet")
    connection = duckdb.connect()
    connection.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    frame = catalogue.QUERIES[name](spark, str(folder))
    return sorted(map(tuple, frame.collect())), sorted(connection.sql(f"select {', '.join(frame.columns)} from ({catalogue.SQL[name]})").fetchall())


def test_annotations_round_as_in_sql(spark, tmp_path):
    got, expected = both_ways(spark, tmp_path, "sam_tags")
    assert len(got) == len(DELICATE) and got == expected


def test_sam_lines_round_as_in_sql(spark, tmp_path):
    got, expected = both_ways(spark, tmp_path, "sam_text")
    assert len(got) == 2 * len(DELICATE) and got == expected


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 17
