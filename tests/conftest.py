import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

KEY = "test-key"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from veilwork.session import session
    s = session("local[4]", "tests", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("work"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def texts(spark):
    """A function from a list of texts to a one-identity document table."""
    def make(*values, identity="user1"):
        rows = [(i, identity, "USER_ID", v) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "doc_id long, identity string, identity_type string, text string")
    return make


@pytest.fixture(scope="session")
def anonymized(texts):
    """A function from texts to their anonymised rows, in order."""
    from veilwork.operators.anonymize import anonymize

    def run(*values):
        return sorted(anonymize(texts(*values), KEY).collect(), key=lambda r: r.doc_id)
    return run
