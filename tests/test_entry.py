"""The entry points, with and without the optional subpackage; every registered query against its DuckDB twin."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SF = "/root/testdata/sf0.001"
import __spark_entry__  # noqa: E402
from sievelake.plans import catalogue  # noqa: E402



def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["lang", "n", "contaminated"] and df.count() > 0


def test_oracles_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in catalogue.ORACLE_SQL:
        out = duck.execute(catalogue.ORACLE_SQL[name])
        at = [d[0] for d in out.description]
        assert sorted(at) == columns
        assert got == sorted((tuple(plain(r[at.index(c)]) for c in columns) for r in out.fetchall()), key=repr)


@pytest.mark.parametrize("pipeline", [False, True])
def test_imports_without_the_optional_subpackage(tmp_path, pipeline):
    """Without the folder, and with or without the pipeline that needs it."""
    import shutil

    shutil.copytree(ROOT / "sievelake", tmp_path / "sievelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and (ROOT / "corpus_pipeline.py").exists() else [])]:
        shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_errors_inside_optional_modules_show(tmp_path):
    import shutil

    shutil.copytree(ROOT / "sievelake", tmp_path / "sievelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module_at_all")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode != 0 and "no_such_module_at_all" in done.stderr
