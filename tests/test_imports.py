"""The rest of the package works without the parts that can be removed."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_llm(tmp_path):
    for name in ("voxloom", "__spark_entry__.py", "bench.py"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy)(f"{ROOT}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "voxloom/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k[:2] == 'op' and k[2].isdigit() or k == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_llm():
    for folder, _, files in os.walk(f"{ROOT}/voxloom"):
        if f"{os.sep}llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                assert "voxloom.llm" not in open(os.path.join(folder, f)).read()


def test_queries_without_the_vocabulary_package(tmp_path):
    """Where the package of the public vocabularies is absent, the queries are all there."""
    (tmp_path / "public_tokenizers.py").write_text("raise ModuleNotFoundError('absent', name='public_tokenizers')")
    code = "import __spark_entry__ as e; from voxloom.plans import catalog; q = e.queries(); assert set(catalog.QUERIES) <= set(q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join([str(tmp_path), ROOT])})


def test_tests_without_llm(tmp_path):
    """Without the removable parts the other tests are collected, and some of them pass."""
    for name in ("voxloom", "tests"):
        shutil.copytree(f"{ROOT}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(f"{ROOT}/{name}", tmp_path / name)
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    run = lambda *args: subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *args], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert " error" not in (found := run("--collect-only", "tests")).stdout and found.returncode == 0, found.stdout[-2000:]
    assert run("tests/test_golden.py", "tests/test_volume_source.py::test_pushdown").returncode == 0
