import os

import pytest

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables absent")
    return lambda name: spark.read.parquet(f"{SF_DIR}/{name}.parquet")


@pytest.fixture(scope="session")
def texts(tables):
    return {r["doc_id"]: r["text"] for r in tables("documents").collect()}
