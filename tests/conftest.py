import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from cabledger.session import build_session
    session = build_session("tests", spark__sql__shuffle__partitions="4",
                            spark__checkpoint__dir=tempfile.mkdtemp(prefix="cabledger-tests-"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from cabledger.sources.star import star_tables
    return star_tables(spark, SF_DIR)


@pytest.fixture(scope="session")
def duck_con():
    from checks.compare import duck
    return duck(SF_DIR)


@pytest.fixture
def frame(spark):
    """Rows of a declared table, given as dicts; columns left out are NULL."""
    from cabledger import schema

    def make(rows, table=None, ddl=None):
        ddl = ddl or schema.COLUMNS[table]
        names = [f.split()[0] for f in _fields(ddl)]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)
    return make


def _fields(ddl):
    from pyspark.sql.types import StructType
    return [f"{f.name} x" for f in StructType.fromDDL(ddl).fields]
