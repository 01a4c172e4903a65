import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lodestone.llm import queries, simhash
from lodestone.scratch import Scratch


def test_stages(spark, sf):
    docs, scratch = spark.read.parquet(f"{sf}/documents.parquet"), Scratch(spark, "t")
    names, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.save(stage(spark, docs, sf))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == names
            counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(docs.columns)


def test_stages_take_odd_rows(spark, sf):
    text = "The thing that was there is of the and to be with this and it was there by the other one."
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, text, "en", "s", len(text)), (3, text, "en", "s", len(text)), (None, text, "en", "s", len(text))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = docs.selectExpr("*", "1 as _score", "'x' as _kept", "2 as _gone", "3 as _again", "'y' as other0", "4 as c0", "5 as _doc")
    for table in (docs, clash, clash.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, sf)
            out.collect()
            if stage is not corpus_pipeline.pack:
                assert out.columns == table.columns
    kept = corpus_pipeline.drop_copies(spark, clash, sf).collect()
    assert sorted(r.doc_id or -1 for r in kept) == [-1, 1, 3]
    lines = {(r.doc_id, r.text): (r.n_chars, r._kept) for r in corpus_pipeline.drop_lines(spark, clash, sf).collect()}
    assert lines == {(1, None): (None, "x"), (2, ""): (0, "x"), (3, text): (len(text), "x"), (None, text): (len(text), "x")}
    assert corpus_pipeline.drop_leaks(spark, clash, sf).count() == len(rows)


def test_a_link_that_stands_behind_failed_edges_is_found(spark):
    """Three texts: two of them are similar enough, each of them nearer in bits to a third that is not."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**9)}"
    found = 0
    for _ in range(3):
        a = [word() for _ in range(200)]
        b, c = list(a), list(a)
        for at in range(3, 200, 50):
            c[at] = word()
        for at in range(10, 200, 25):
            b[at] = word()
        shingles = [{tuple(t[k : k + 5]) for k in range(196)} for t in (a, b, c)]
        sim = lambda x, y: len(shingles[x] & shingles[y]) / len(shingles[x] | shingles[y])
        rows = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))], "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows).collect()}
        assert (got[2] == 1) <= (sim(0, 1) >= 0.8 or (sim(1, 2) >= 0.8 and sim(0, 2) >= 0.8))
        assert sim(0, 1) < 0.8 <= sim(0, 2)
        found += got[3] == 1
    assert found == 3


def test_ten_operators_and_the_pipeline_are_registered():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_duckdb(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    df = queries.QUERIES[name](spark, sf)
    rel = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str([r[c] for c in sorted(columns)]) for r in df.collect()) == sorted(str([dict(zip(columns, r, strict=True))[c] for c in sorted(columns)]) for r in rel.fetchall())
