import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from quillspan.plans import catalogue

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def rounded(rows, names, order):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted((tuple(round(r[names.index(c)], 5) + 0.0 if isinstance(r[names.index(c)], float) else r[names.index(c)] for c in order) for r in rows), key=key)


@pytest.mark.parametrize("name", ["q_keep_last", "q_equity_summary", "q_stream_bars", "q_news_priority_union", "q_keywords", "q_axis_entropy", "q_grounding", "q_stratified_split", "q_runs", "q_cache_lookup", "q_knn_cosine", "q_similarity_report", "q_duplicate_guard"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    df = catalogue.QUERIES[name](spark, SMALL)
    order = sorted(df.columns)
    cur = con.execute(catalogue.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == order
    assert rounded(df.collect(), df.columns, order) == rounded(cur.fetchall(), names, order)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.queries()["p1_found"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_chosen():
    assert list(catalogue.chosen(["q_runs"])) == ["q_runs"]
    with pytest.raises(KeyError):
        catalogue.chosen(["q_runs", "q_none"])


def test_observed(spark):
    from pyspark.sql import functions as F

    from quillspan.shared import observed

    df, seen = observed(spark.range(7), "seven", n=F.count("*"), top=F.max("id"))
    assert df.count() == 7 and seen.get == {"n": 7, "top": 6}


def test_entry_without_llm():
    """Without the optional subpackage the core's queries are all there."""
    code = "import sys; sys.modules['quillspan.llm'] = None\nimport __spark_entry__ as e; q = e.queries(); print(len(q), all(not n.startswith('p') or n == 'p1_found' for n in q), set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == len(catalogue.QUERIES) and out[1:] == ["True", "True"]


def test_core_without_llm():
    code = "import sys; sys.modules['quillspan.llm'] = None\nfrom quillspan.plans import catalogue; import quillspan.streaming.live, quillspan.sources.files; print(len(catalogue.QUERIES))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) > 50
