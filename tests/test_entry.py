"""The driver's contract, and that everything but the training-data operators works without them."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parents[1]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["city", "stars"] and df.count() > 0


def test_oracles_are_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_training_data_operators(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), len(e.oracle_sql()) > 40)"], cwd=tmp_path / "r", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert said.returncode == 0, said.stderr
    assert said.stdout.split()[1:] == ["False", "True"]


CHEAP = ["review_count", "reviews_in_year", "top10_users", "top10_cities", "partition_item_counts", "baskets_min_size", "frequent_pairs", "son_frequent", "fpgrowth_itemsets", "document_classes", "jaccard_lsh_pairs", "item_cf", "user_cf", "cluster_summaries", "mahalanobis_assign", "bloom_fpr", "fm_estimate_windows", "exact_distinct_windows", "reservoir_sample", "top_tags_tiers", "stream_bloom", "stream_reservoir"]


@pytest.mark.parametrize("name", CHEAP)
def test_against_duckdb(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    df = entry.queries()[name](spark, sf)
    rel = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(df.columns)
    flat = lambda rows: sorted(str([round(r[c], 6) if isinstance(r[c], float) else r[c] for c in sorted(columns)]) for r in rows)
    assert flat(r.asDict() for r in df.collect()) == flat(dict(zip(columns, r, strict=True)) for r in rel.fetchall())
