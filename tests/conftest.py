import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from wattloom.session import checkpoint_dir, local_session

    session = local_session(8, "tests")
    checkpoint_dir(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def minutes(spark):
    """Frame of one or more series of one-minute readings: minutes({"a": [1, 2, None]})."""
    import datetime as dt

    def make(series, step=60, start=dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)):
        rows = [
            (key, start + dt.timedelta(seconds=step * i), None if v is None else float(v))
            for key, values in series.items()
            for i, v in enumerate(values)
        ]
        return spark.createDataFrame(rows, "entity_id string, ts timestamp, value double")

    return make


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]
