import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from kerbline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    """Tiny inputs: compiling stages costs more than it saves, and few partitions are enough."""
    session = local_session(8, "kerbline-tests")
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture
def rows(spark):
    """Frame from tuples and a schema text."""
    return lambda data, schema: spark.createDataFrame(data, schema)
