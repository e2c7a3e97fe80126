import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lattica.session import local_session

    session = local_session(8, "lattica-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def weekly(spark):
    from lattica.plans.panel import weekly_panel
    from lattica.session import settle

    return settle(weekly_panel(spark, SF))


def rows(df, *order):
    found = [r.asDict() for r in df.collect()]
    return sorted(found, key=lambda r: tuple(str(r[c]) for c in order)) if order else found
