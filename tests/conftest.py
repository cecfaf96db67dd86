import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cinderlog.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lines(spark):
    """Build a lines table: ``lines(text, ...)`` or ``lines({file: [text, ...]})``."""

    def build(*texts):
        files = texts[0] if texts and isinstance(texts[0], dict) else {"f.log": list(texts)}
        rows, n = [], 0
        for name, content in files.items():
            for text in content:
                rows.append((n, name, text))
                n += 1
        return spark.createDataFrame(rows, "line_id long, source_file string, value string")

    return build
