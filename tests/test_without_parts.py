"""The rest imports, registers its queries and runs without the training-data operators and their pipeline."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = """
import __spark_entry__ as e
found, sql = e.queries(), e.oracle_sql()
assert set(sql) <= set(found) and "doc_hashes" in found, found
assert not any(x.startswith("op") or x == "pipeline" for x in found), found
import pkgutil, importlib, loomtext
for x in pkgutil.walk_packages(loomtext.__path__, "loomtext."):
    importlib.import_module(x.name)
print("whole", len(found))
"""


@pytest.mark.parametrize("gone", [["loomtext/llm", "tests/llm"], ["loomtext/llm", "tests/llm", "corpus_pipeline.py"]])
def test_rest_stands_alone(tmp_path, gone):
    root = tmp_path / "copy"
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json"))
    for name in gone:
        at = root / name
        if at.is_dir():
            shutil.rmtree(at)
        elif at.exists():
            at.unlink()
    env = os.environ | {"PYTHONPATH": str(root), "PYTHONDONTWRITEBYTECODE": "1"}
    run = subprocess.run([sys.executable, "-c", SAYS], cwd=root, env=env, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0 and "whole" in run.stdout, run.stderr
    collected = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests", "--deselect", "tests/test_without_parts.py"], cwd=root, env=env, capture_output=True, text=True, timeout=120)
    assert collected.returncode == 0, collected.stdout


def test_broken_part_is_an_error(tmp_path):
    """An import error inside a part isn't taken for its absence."""
    root = tmp_path / "copy"
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json"))
    if not (root / "loomtext/llm").exists():
        pytest.skip("the part is absent")
    (root / "loomtext/llm/common.py").write_text("import no_such_module_anywhere\n")
    run = subprocess.run([sys.executable, "-c", SAYS], cwd=root, env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True, text=True, timeout=120)
    assert run.returncode != 0 and "no_such_module_anywhere" in run.stderr
