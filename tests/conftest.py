import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from larder.session import local_session, remove_run_folder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4)
    yield session
    remove_run_folder(session)
