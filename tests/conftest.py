import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from citegraph.session import build_session  # noqa: E402

SMALL = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    # The tables here are tiny: compiling each plan would take longer than running it.
    session = build_session(
        "tests", f"local[{os.environ.get('TEST_CPUS', '8')}]",
        **{"spark.sql.shuffle.partitions": "4", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not SMALL.exists():
        pytest.skip("test tables are not here")
    return str(SMALL)
