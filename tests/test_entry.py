"""The driver's entry stands without the training-data subpackage and what it needs."""

import subprocess
import sys

ROOT = __file__.rpartition("/tests/")[0]


def names(setup: str) -> list[str]:
    code = f"import sys; sys.path.insert(0, {ROOT!r})\n{setup}\nimport __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()) > 0)"
    return subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()


def test_without_a_dependency_of_the_subpackage():
    n, ops, pipeline, sql = names("sys.modules['xxhash'] = None")
    assert int(n) > 90 and (ops, pipeline, sql) == ("False", "False", "True")


def test_without_the_pipeline_module():
    n, _, pipeline, sql = names("sys.modules['corpus_pipeline'] = None")
    assert int(n) > 90 and (pipeline, sql) == ("False", "True")


def test_without_the_subpackage():
    n, ops, pipeline, sql = names("sys.modules['tessera.llm'] = None")
    assert int(n) > 90 and (ops, pipeline, sql) == ("False", "False", "True")
