"""Text queries against their SQL in DuckDB: on the smallest tables and on rows made for the hard cases."""

import random

import duckdb
import pytest

from seqharvest.llm import license_scan, queries, sql

DATA = "/root/testdata/sf0.001"


def made(seed):
    """Texts of licence words, personal data, recurring templates and odd characters."""
    rng = random.Random(seed)
    data = ["mail a.b@c.de", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "+1 (310) 555-4510", "IBAN GB82 WEST 1234 5698 7654 32", "GB83 WEST 1234 5698 7654 32", "token = " + "a1" * 20, "b2" * 20, "c3" * 90 + " password", "é😀", "\t", "", "  "]
    notes = [*license_scan.TEMPLATES.values(), "MIT license", "GNU General Public License", "apache license, apache license"]
    lines = ["Error in module disk while reading block from {}", "Page {} of 10", "The quick brown {} jumps over dogs today", "Read more about our many offers"]
    fill = ["alpha", "beta", "gamma", "7", "x9", "delta"]
    rows = [(1, None), (2, ""), (3, " \n\n ")]
    for i in range(4, 60):
        kinds = [rng.choice([rng.choice(lines).format(rng.choice(fill)), rng.choice(notes), " ".join(rng.choice(data) for _ in range(4)), "own " + " ".join(rng.choice(fill) for _ in range(5))]) for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(kinds)))
    return rows


def compare(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        path = folder if t == "documents" else DATA
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet{'/*.parquet' if folder != DATA and t == 'documents' else ''}')")
    found = con.sql(sql.SQL[name])
    got = queries.queries()[name](spark, folder)
    at = [found.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[k] for k in at) for r in found.fetchall()), name


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_smallest_tables(spark, name):
    compare(spark, name, DATA)


@pytest.mark.parametrize("name", ["op1_line_dedup", "op8_license_scan", "op10_pii"])
def test_made_rows(spark, name, tmp_path):
    spark.createDataFrame(made(11), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    compare(spark, name, str(tmp_path))
