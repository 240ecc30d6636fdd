"""Every registered query against its DuckDB twin on the smallest tables."""

import math

import duckdb
import pytest

from florilege.plans.catalogue import oracle_sql, queries

TABLES = "part documents orders lineitem pages events".split()
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.fixture(scope="module", autouse=True)
def shared_reports():
    """One persisted set of reports for the many queries over them; freshness_verdict makes its own."""
    from florilege.plans import queries as q

    made, own = {}, q._reports

    def reports(fx):
        if fx.dir not in made:
            made[fx.dir] = own(fx).persist()
        return made[fx.dir]

    q._reports = reports
    yield
    q._reports = own


def plain(v):
    return round(v, 8) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=str)
    if name not in ORACLES:
        assert got
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert got == sorted(([plain(r[names.index(c)]) for c in cols] for r in found.fetchall()), key=str)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_entry_works_without_the_llm_folders(tmp_path, data):
    """The other queries must load when the subpackage and the pipeline are gone."""
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "florilege", tmp_path / "florilege", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    # a broken dependency of the library itself is not passed over
    (tmp_path / "broken").mkdir()
    shutil.copytree(tmp_path / "florilege", tmp_path / "broken/florilege")
    shutil.copy(root / "__spark_entry__.py", tmp_path / "broken")
    (tmp_path / "broken/corpus_pipeline.py").write_text("import a_module_that_is_not_there")
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "broken", env=os.environ | {"PYTHONPATH": str(tmp_path / "broken")}, timeout=60, capture_output=True).returncode
    code = "import __spark_entry__ as e; q = e.queries(); assert 'freshness_verdict' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=60)
