"""The driver contract without the text operators."""

import subprocess
import sys

CODE = """
import sys
sys.modules['lumenarc.llm'] = None
import __spark_entry__ as e
assert e.llm is None and set(e.queries()) == set(e.oracle_sql()) | {'fnv_signature'} and 'dup_groups_by_content' in e.queries()
"""


def test_entry_imports_without_llm():
    subprocess.run([sys.executable, "-c", CODE], check=True)
