import os

os.environ.setdefault("PYTHONHASHSEED", "0")

import pytest
from millrace.session import builder


@pytest.fixture(scope="session")
def spark():
    s = builder("tests").master("local[4]").config("spark.driver.memory", "3g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    yield s
