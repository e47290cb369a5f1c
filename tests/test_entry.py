"""The driver contract without the parts that may be missing, and the guard of stage tables."""

import subprocess
import sys
from pathlib import Path

import pytest

from quarryline import catalog, session

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("missing", ["public_tokenizers", "xxhash", "quarryline.llm", "corpus_pipeline"])
def test_queries_without_a_module(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(sorted(e.queries())); e.oracle_sql()"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    names = eval(out.strip().splitlines()[-1])  # noqa: S307
    assert set(catalog.QUERIES) <= set(names)


class Cluster:
    """As much of a session as the guard asks for."""

    master, conf = "spark://somewhere:7077", {}
    sparkSession = sparkContext = property(lambda self: self)

    def getCheckpointDir(self):
        return None


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.settle(Cluster())
