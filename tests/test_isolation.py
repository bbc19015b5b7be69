"""Without the training-data operators the rest imports and answers, the pipeline's file being there or not."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'topk_block' in q and set(s) <= set(q); assert not any(x.startswith('op') and x[2].isdigit() or x == 'pipeline' for x in q), sorted(q)"


@pytest.mark.parametrize("pipeline", [True, False])
def test_rest_works_alone(tmp_path, pipeline):
    for name in ("kinloom", "tests"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py", *["corpus_pipeline.py"] * pipeline):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    run = lambda *a: subprocess.run([sys.executable, *a], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    asked = run("-c", ASK)
    assert asked.returncode == 0, asked.stderr
    collected = run("-m", "pytest", "tests", "-q", "--collect-only")
    assert collected.returncode == 0, collected.stdout + collected.stderr
