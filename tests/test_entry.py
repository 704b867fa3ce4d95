import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from rankfold.plans import catalogue, oracles

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "/root/testdata/sf0.001"
#: The other exact quantiles differ by column and method only, which test_exact varies.
SOME_EXACT = ("exact_q50_price", "exact_ties_discount", "exact_dd_signed_acctbal", "exact_radix_acctbal", "exact_trunc_value")


def test_every_query_of_the_catalogue_has_sql():
    assert set(oracles.oracle_sql()) == set(catalogue.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_text_operators(tmp_path):
    for name in ("rankfold", "__spark_entry__.py"):
        source = os.path.join(REPO, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    (tmp_path / "corpus_pipeline.py").write_text("raise ImportError('the pipeline needs the text operators')")
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(catalogue.QUERIES))] * 2


def test_missing_libraries_of_the_text_operators_leave_the_rest(tmp_path):
    shutil.copy(os.path.join(REPO, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(REPO, "rankfold"), tmp_path / "rankfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    os.makedirs(tmp_path / "rankfold" / "llm")
    (tmp_path / "rankfold" / "llm" / "__init__.py").write_text("import nothing_of_this_name")
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0 and "nothing_of_this_name" in done.stderr
    assert done.stdout.split() == [str(len(catalogue.QUERIES))] * 2
    (tmp_path / "rankfold" / "llm" / "__init__.py").write_text("1 / 0")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode != 0 and "ZeroDivisionError" in done.stderr


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in sorted(catalogue.QUERIES) if n not in catalogue.EXACT or n in SOME_EXACT])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    spark.catalog.clearCache()
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{TABLES}/{f}')")
    got = catalogue.QUERIES[name](spark, TABLES)
    want = con.execute(oracles.oracle_sql()[name]).fetchall()
    columns = [d[0] for d in con.description]
    assert sorted(columns) == sorted(got.columns)
    shown = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert shown(got.select(*columns).collect()) == shown(want)


def test_arith_progressions_reads_every_part(spark, tmp_path):
    parts = [(k, (k * k) % 50 + 1) for k in range(0, 3000, 11)] + [(None, 3), (5000, None)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    values = {size + 60 * (key % 7) for key, size in parts if key is not None and size is not None}
    want = []
    for start in values:
        for diff in range(1, 61):
            if start - diff not in values:
                length = next(n for n in range(1, len(values) + 2) if start + n * diff not in values)
                if length >= 4:
                    want.append((start, diff, length))
    got = catalogue.QUERIES["arith_progressions"](spark, str(tmp_path))
    assert sorted(map(tuple, got.select("start", "diff", "length").collect())) == sorted(want) and want
