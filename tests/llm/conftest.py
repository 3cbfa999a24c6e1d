import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def rows():
    from fixtures import awkward_texts

    return awkward_texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from fixtures import frame

    return frame(spark, rows).cache()
