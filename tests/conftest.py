import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from attestra.session import local_session

    # Interpreted execution: on a few hundred rows, compiling each plan costs more than running it.
    s = local_session("4", "tests", **{
        "spark.sql.shuffle.partitions": "2", "spark.driver.memory": "6g",
        "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
