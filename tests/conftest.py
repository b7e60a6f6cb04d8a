import json
import os
import tempfile

import pytest
from pyspark.sql import SparkSession

from cvegrid.session import prepare


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture
def land(tmp_path):
    """Write text files into a landing folder, in order of arrival."""
    def write(folder: str, **files) -> str:
        target = tmp_path / folder
        target.mkdir(parents=True, exist_ok=True)
        for i, (name, content) in enumerate(files.items()):
            path = target / name.replace("__", ".")
            path.write_text(content if isinstance(content, str) else json.dumps(content))
            os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
        return str(target)
    return write
