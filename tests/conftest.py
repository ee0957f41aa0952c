import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def scratch():
    return tempfile.mkdtemp(prefix="latentrec-tests-", dir="/tmp")


@pytest.fixture(scope="session")
def spark(scratch):
    from latentrec.session import local_session

    s = local_session(os.path.join(scratch, "ckpt"), cores=8, shuffle_partitions=8, app="latentrec-tests")
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_local(scratch):
    return tempfile.mkdtemp(prefix="case-", dir=scratch)
