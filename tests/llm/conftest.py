import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import pytest  # noqa: E402
from tests_prose import AWKWARD, prose  # noqa: E402

from weftgraph.session import prepare  # noqa: E402


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows with null and repeated ids, repeated rows, and extra columns named like those of operators."""
    prepare(spark)
    rows = [(i, t, None, "s", i, "k", 1) for i, t in enumerate(AWKWARD)]
    rows += [rows[4], (None, prose(60, 3), None, None, None, "k", 2), (None, prose(60, 3), None, None, None, "k", 2), (4, "another text of the same id " * 5, "en", "s", 1, "k", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _th string, _id int").cache()


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
