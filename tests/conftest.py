import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    """Hundreds of tiny jobs: quick compilation matters more than fast code here."""
    from tabloom.session import local_session

    session = local_session(
        "tests",
        cpus=4,
        **{
            "spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1",
            "spark.sql.codegen.wholeStage": "false",
            "spark.sql.shuffle.partitions": "3",
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
