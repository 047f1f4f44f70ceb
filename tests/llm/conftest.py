import pytest

from tests.llm import fixtures


@pytest.fixture(scope="session")
def hard(tmp_path_factory):
    """A folder of small tables with hard cases."""
    return fixtures.write(str(tmp_path_factory.mktemp("hard")))


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return fixtures.write(str(tmp_path_factory.mktemp("empty")), empty=True)
