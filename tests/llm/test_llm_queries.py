"""The pN_ queries on the smallest tables; those with SQL against DuckDB."""

from pathlib import Path

import duckdb
import pytest

from granthika.llm.queries import QUERIES
from granthika.llm.sql import SQL

COLUMNS = {
    "p1_found": "pkey bigint, start_char bigint", "p2_found": "tbl string, key_a bigint, key_b bigint", "p3_found": "tbl string, keep_key bigint, dup_key bigint", "p4_found": "tbl string, rec_id bigint",
    "p6_found": "tbl string, rec_id bigint, match_id string", "p7_found": "pkey bigint, en_start bigint, tr_start bigint", "p10_found": "doc_id bigint",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rows = sorted(tuple(str(v) for v in r) for r in df.collect())
    assert rows
    if name in COLUMNS:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
        assert len(rows) == len(set(rows))
    if name in SQL:
        c = duckdb.connect()
        for f in Path(sf).glob("*.parquet"):
            c.execute(f"create view {f.stem} as select * from '{f}'")
        r = c.execute(SQL[name])
        at = [[d[0] for d in r.description].index(x) for x in df.columns]
        assert rows == sorted(tuple(str(x[i]) for i in at) for x in r.fetchall())
