import pathlib
import re
import subprocess
import sys

ROOT = pathlib.Path(__file__).parent.parent


def test_core_does_not_use_the_training_data_package():
    for p in (ROOT / "papyrine").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"papyrine\.llm|from \.llm|import llm", p.read_text()), p


def test_entry_works_without_it():
    code = "import sys; sys.modules['papyrine.llm'] = None\nimport importlib.util as u; f = u.find_spec\nu.find_spec = lambda n, *a: None if n.startswith('papyrine.llm') else f(n, *a)\nimport __spark_entry__ as e; q = e.queries(); assert q and not any(n[0] == 'p' and n[1:2].isdigit() for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_local_checkpoints_are_not_used():
    word = "local" + "Checkpoint"
    for p in ROOT.rglob("*.py"):
        assert word not in p.read_text(), p


def test_entry(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
