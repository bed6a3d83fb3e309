import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpuslens.tables import session


@pytest.fixture(scope="session")
def spark():
    made = session(cores=4, shuffle_partitions=4, memory="4g")
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
