"""Every registered query against its SQL, and that those without SQL run."""

from __future__ import annotations

import pytest
from compare import assert_same, duck

from quillgraph.plans import ORACLE, QUERIES




@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLE)))
def test_same_as_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir).toPandas(), duck(ORACLE[name], sf_dir))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()  # all columns of all rows


def test_markup_follows_the_whole_text(spark, tmp_path):
    long = "word " * 200 + "also zebrafish"
    spark.createDataFrame([(1, long + " $z^2$", "en", "s", len(long))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).toPandas()
    assert "zebrafish" in set(run("discovery_terms").term) and "zebrafish" in run("clean_text").text[0] and "zebrafish" in run("snippet").snippet[0]
    assert list(run("math_spans").sort_values("start").latex.str.strip()) == ["z^2", "x_{1}", "y^2"]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
