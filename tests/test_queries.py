"""Every registered query of the engine against its SQL."""

import pytest
from oracle import same

from loomscan import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, small_dir, name):
    assert same(queries.QUERIES[name](spark, small_dir), queries.ORACLE_SQL[name], small_dir) > 0


def test_entry_works_without_the_llm_folder():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    blocked = "import sys, importlib.abc\nclass Gone(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path=None, target=None):\n        if name.startswith('loomscan.llm') or name == 'corpus_pipeline':\n            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\nsys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\nassert 'tensor_decode_f32' in e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries())\nassert set(e.oracle_sql()) <= set(e.queries())\n"
    subprocess.run([sys.executable, "-c", blocked], cwd=root, check=True, timeout=120)
