"""Copy the tables with a third of the rows of each moved to one key, to rehearse hot keys.

usage: python tools/make_skewed.py SOURCE TARGET   (TARGET: a new, empty folder)
"""

from __future__ import annotations

import sys

import duckdb

TABLES = {
    "lineitem": "SELECT * REPLACE (CASE WHEN l_suppkey % 3 = 0 THEN 7 ELSE l_partkey END AS l_partkey, "
    "CASE WHEN l_linenumber % 3 = 0 THEN 5 ELSE l_orderkey END AS l_orderkey) FROM src",
    "orders": "SELECT * REPLACE (CASE WHEN hash(o_orderkey) % 3 = 0 THEN 9 ELSE o_custkey END AS o_custkey) FROM src",
    "events": "SELECT * REPLACE (CASE WHEN hash(event_id) % 3 = 0 THEN 3 ELSE user_id END AS user_id) FROM src",
    "part": "SELECT * REPLACE (CASE WHEN hash(p_partkey) % 3 = 0 THEN 'red gear' ELSE p_name END AS p_name, "
    "CASE WHEN hash(p_partkey) % 3 = 0 THEN 'Brand#3' ELSE p_brand END AS p_brand) FROM src",
    "conversations": "SELECT * REPLACE (CASE WHEN conv_id % 3 = 0 THEN 1 ELSE conv_id END AS conv_id, "
    "CASE WHEN conv_id % 3 = 0 THEN conv_id * 100 + turn + 1000 ELSE turn END AS turn) FROM src",
    "pages": "SELECT * REPLACE (CASE WHEN page_id % 3 = 0 THEN 'https://one.example.com/en/' || page_id ELSE url END AS url) FROM src",
    "documents": "SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN 'src1' ELSE source END AS source) FROM src",
}
SAME = ["region", "nation", "customer", "supplier", "embeddings", "benchmark", "labels"]


def main(source: str, target: str) -> None:
    con = duckdb.connect()
    for name in [*TABLES, *SAME]:
        sql = TABLES.get(name, "SELECT * FROM src").replace("FROM src", f"FROM '{source}/{name}.parquet'")
        con.execute(f"COPY ({sql}) TO '{target}/{name}.parquet' (FORMAT parquet)")


if __name__ == "__main__":
    main(*sys.argv[1:3])
