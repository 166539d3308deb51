import pytest
from candlewick.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("tests", "local[4]", **{"spark_sql_shuffle_partitions": "4", "spark_ui_enabled": "false", "spark_checkpoint_dir": str(tmp_path_factory.mktemp("checkpoint")), "spark_driver_memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
