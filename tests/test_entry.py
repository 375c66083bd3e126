"""The entry points, with and without the optional corpus part."""

import pathlib
import re
import subprocess
import sys

ROOT = pathlib.Path(__file__).parent.parent

WITHOUT = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "tidewake.llm") or name.startswith("tidewake.llm."):
            raise ImportError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
names = set(e.queries())
assert names and not any(n.startswith("op") or n == "pipeline" for n in names)
assert set(e.oracle_sql()) <= names
"""


def test_entry_imports_without_the_corpus_part():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True)


def test_nothing_else_imports_the_corpus_part():
    for path in (ROOT / "tidewake").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"tidewake\.llm|tidewake import llm", path.read_text()), path


def test_flagship(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns[:2] == ["user_id", "device_id"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
