import hashlib

import public_tokenizers
import pytest

import __spark_entry__
import corpus_pipeline


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10


def test_stages_on_the_table(spark, table):
    docs = table("documents").cache()
    at, before = docs, docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, before, "").cache()
        rows, old = at.collect(), before.collect()
        if name != "tokens":
            assert at.columns == docs.columns
        ids, old_ids = [r.doc_id for r in rows], [r.doc_id for r in old]
        if name == "language":
            assert set(ids) == {r.doc_id for r in old if any(c.isalpha() for c in r.text or "")}
        elif name == "near_duplicates":
            assert len(set(ids)) == len(ids) and set(ids) < set(old_ids)
            texts = {r.doc_id: r.text for r in rows}
            assert len(set(texts.values())) == len(texts)
        elif name == "private_data":
            assert sorted(ids) == sorted(old_ids) and not any("@" in r.text and "<EMAIL>" not in r.text and ".com" in r.text for r in rows)
        elif name == "mixture":
            assert set(ids) <= set(old_ids) and max(map(ids.count, set(ids))) <= 3
        else:
            decoded = {r.doc_id: r.decoded_sha256 for r in rows}
            assert decoded == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in old}
        before = at


def test_run_is_its_stages(spark, tmp_path, table):
    docs = table("documents").limit(60)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, at.collect()))


@pytest.mark.parametrize("name", ["edge", "none"])
def test_edges(spark, request, name):
    at = docs = request.getfixturevalue(name)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, "")
        assert k == 4 or at.columns == docs.columns
    assert bool(at.collect()) == (name == "edge")


def test_sql_matches(spark, tmp_path):
    """The queries that have SQL, against DuckDB on the smallest tables."""
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("op5_warc", "op6_bitsliced"):
        got = __spark_entry__.queries()[name](spark, sf)
        columns = sorted(got.columns)
        want = con.sql(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
        assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want))
    assert public_tokenizers.path(corpus_pipeline.VOCABULARY)


def test_a_failed_query_leaves_no_tables(spark, tmp_path):
    from millrace.llm import queries
    from millrace.llm.runtime import Scratch, scratches, shared_dir

    left = lambda: {p.name for p in __import__("pathlib").Path(shared_dir(spark).removeprefix("file://")).iterdir()}
    spark.createDataFrame([(1, "a b c")], "doc_id long, words string").write.parquet(str(tmp_path / "documents.parquet"))
    before = left()
    for name in ("op1_simhash", "op3_substring", "op10_mix"):
        with pytest.raises(Exception, match="text"):
            queries.QUERIES[name](spark, str(tmp_path))
    with pytest.raises(ZeroDivisionError), scratches(keep_results=True):
        Scratch(spark, "broken").save(spark.range(3), "t")
        1 / 0  # noqa: B018
    assert left() == before
    with scratches(keep_results=True):
        kept = Scratch(spark, "kept")
        assert kept.save(spark.range(3), "t").count() == 3
    assert len(left() - before) == 1
    kept.drop()
