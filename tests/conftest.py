import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tracegauge.session import local_session

    os.environ.setdefault("TRACEGAUGE_SHUFFLE", "4")
    return local_session("4", "tracegauge-tests", os.environ.get("TEST_SCRATCH", tempfile.mkdtemp(prefix="tracegauge-tests-")))


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip(f"no test tables at {SF_DIR}")
    return SF_DIR


@pytest.fixture
def make_spans(spark):
    """Typed spans from dictionaries; columns left out are NULL."""
    from tracegauge.sources.attributes import SPAN_SCHEMA

    def make(rows):
        return spark.createDataFrame([tuple(r.get(f.name) for f in SPAN_SCHEMA) for r in rows], SPAN_SCHEMA)

    return make
