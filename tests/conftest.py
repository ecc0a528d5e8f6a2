import datetime as dt

import pytest
from pyspark.sql import SparkSession

from editlore.session import prepare


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
    )
    session = prepare(builder.getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


START = dt.datetime(2022, 1, 1, tzinfo=dt.timezone.utc)


def day(n: float) -> dt.datetime:
    return START + dt.timedelta(days=n)


CHANGE = dict(
    entity_id=1, property_id=1, value_id="v", entity_label="entity", property_label="property", action="UPDATE", change_target="",
    label="", change_type="", is_reverted=0, reversion=0, reversion_timestamp=None, new_datatype="quantity", old_datatype="quantity",
    new_value='"1"', old_value="{}", new_value_label=None, old_value_label=None, user_type="human", user_id=1, username="user1",
    comment=None)
CHANGE_DDL = (
    "revision_id bigint, timestamp timestamp, entity_id bigint, property_id bigint, value_id string, entity_label string, "
    "property_label string, action string, change_target string, label string, change_type string, is_reverted int, reversion int, "
    "reversion_timestamp timestamp, new_datatype string, old_datatype string, new_value string, old_value string, "
    "new_value_label string, old_value_label string, user_type string, user_id bigint, username string, comment string")


def changes(spark, *rows: dict):
    """Change rows with defaults; ``at`` is the day, the revision id follows the position."""
    names = [part.split()[0] for part in CHANGE_DDL.split(", ")]
    data = []
    for i, row in enumerate(rows):
        row = dict(row)
        full = CHANGE | {"revision_id": i + 1, "timestamp": day(row.pop("at", i))} | row
        data.append(tuple(full[n] for n in names))
    return spark.createDataFrame(data, CHANGE_DDL)


def values(df, column: str, order: str = "revision_id") -> list:
    return [r[column] for r in df.orderBy(order).collect()]
