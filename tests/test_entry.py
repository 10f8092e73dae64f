import ast
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from glyphmill.streaming import sampler

ROOT = Path(__file__).parents[1]
SMALL = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_does_not_import_the_llm_part():
    for p in (ROOT / "glyphmill").rglob("*.py"):
        if "llm" not in p.parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any("llm" in n for n in names), p


def test_imports_need_no_session():
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], cwd=ROOT, check=True, timeout=120)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["stream_windows", "stream_deltas", "stream_dedupe"])
def test_streams(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0


def test_unseen_is_a_stream_operator(spark):
    stream = sampler.event_stream(spark, SMALL)
    out = sampler.run_now(sampler.unseen(stream, ["event_type", "user_id"]), "append")
    assert 0 < out.count() <= 1000
