"""The registered queries without what the optional subpackage needs."""

import subprocess
import sys
from pathlib import Path

from workload.queries import ALL

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
sys.modules[sys.argv[1]] = None
import __spark_entry__
print(*sorted(__spark_entry__.queries()))
"""


def names_without(module):
    out = subprocess.run([sys.executable, "-c", CODE, module], cwd=ROOT, capture_output=True, text=True, check=True)
    return out.stdout.split()


def test_queries_without_an_import_of_the_optional_subpackage():
    for module in ("ahocorasick", "corpus_pipeline", "trialflow.llm"):
        assert names_without(module) == sorted(ALL), module
