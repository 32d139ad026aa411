import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from logweave.session import get_spark
    s = get_spark(app="logweave-tests", cores=4, shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="logweave-test-ckpt-")})
    yield s
    s.stop()


def rows(df, key):
    return {r[key]: r.asDict() for r in df.collect()}
