"""Queries whose SQL takes one alternation, or one pattern after another, where an address stands before a long number."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from shinglemill.plans import registry
from tests.test_oracles import rows

TEXTS = ["Pf 99.114.106.61 4080166431094600 Erauver.", "hnof.70@mail0.example.com 38.211.12.42 4366089147969128 ly", "99.114.106.61", "+1 (853) 555-7168 th. 38.253.197.126 4880761348116108", "", None]


@pytest.mark.parametrize("name", ["linkage_mask", "linkage_raw", "release_alias_collapsed", "release_drop", "release_mask", "release_type", "span_alignment", "span_resolve"])
def test_address_before_number(spark, tmp_path, name):
    import duckdb

    pq.write_table(pa.table({"doc_id": pa.array(range(len(TEXTS)), pa.int64()), "text": TEXTS}), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT doc_id, coalesce(text, '') AS text FROM '{tmp_path}/documents.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    cursor = con.execute(registry.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cursor.description], cursor.fetchall())
