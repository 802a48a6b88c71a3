import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quillfold import registry, registry_forms, registry_live, registry_queues, registry_report, registry_review  # noqa: F401  the others register their queries in the first

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def norm(rows):
    return sorted(tuple("null" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf, duck):
    got = registry.QUERIES[name](spark, sf)
    if name not in registry.ORACLES:
        assert got.count() > 0
        return
    want = duck.sql(registry.ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert norm(tuple(r[c] for c in order) for r in got.collect()) == norm(want.select(", ".join(f'"{c}"' for c in order)).fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_library_works_without_the_corpus_part(tmp_path):
    """The rest imports and registers its queries when that subpackage and the pipeline are gone."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name.startswith('quillfold.llm'):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.corpus is None and e.corpus_pipeline is None and 'latest_wins' in e.queries()
assert not any(k.startswith('op') and k[2].isdigit() for k in e.queries()) and 'pipeline' not in e.oracle_sql()
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').config('spark.sql.session.timeZone', 'UTC').getOrCreate()
assert e.entry(spark).count() > 0 and e.queries()['fuzzy_best_match'](spark, e.SMALLEST).count() > 0
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
