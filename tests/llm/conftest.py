import pytest

from ratelab.scratch import Scratch


@pytest.fixture
def scratch(spark):
    with Scratch(spark) as made:
        yield made
