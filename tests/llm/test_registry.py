import ast
import pathlib
import re

import loomframe
from loomframe.llm import registry

ROOT = pathlib.Path(loomframe.__file__).parent


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_nothing_else_imports_the_subpackage():
    for path in ROOT.rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), path


def test_sql(spark):
    from tests.differential import oracle, same

    sf = "/root/testdata/sf0.001"
    for name, sql in registry.ORACLES.items():
        assert not same(registry.QUERIES[name](spark, sf).toPandas(), oracle(sf, sql))
