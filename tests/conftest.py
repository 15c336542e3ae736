import pytest

from dwellgrid.session import build_session, drop_stages


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": "6g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("stages"))},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_stages(session)
    session.stop()


@pytest.fixture
def tiny_groups(spark):
    """Forces the path for hot keys: any group above three rows is spread over chunks."""
    spark.conf.set("dwellgrid.maxGroupRows", "3")
    yield spark
    spark.conf.unset("dwellgrid.maxGroupRows")
