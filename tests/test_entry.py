import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_core_queries_without_the_training_data_operators(tmp_path):
    """The subpackage may be gone, or leave its byte code only; the other queries are still there."""
    shutil.copytree(f"{ROOT}/readloom", tmp_path / "readloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and set(q) == set(e.oracle_sql()), q"
    for left in (None, "readloom/llm/__pycache__"):
        if left:
            (tmp_path / left).mkdir(parents=True)
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=False)
        assert done.returncode == 0, done.stderr
