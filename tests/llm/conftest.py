import pytest
from plain import awkward
from tallyhound.llm.common import table

@pytest.fixture(scope="session")
def docs(spark, sf):
    return table(spark, sf, "documents").cache()


@pytest.fixture(scope="session")
def odd(spark):
    return awkward(spark).cache()


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark, sf):
    return table(spark, sf, "labels")
