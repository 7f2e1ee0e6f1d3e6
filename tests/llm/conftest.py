import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


#: Null, empty, blank and odd texts that every operator has to take.
ODD = [None, "", " ", "\n\n", "a", "Hi there", "  two  spaces\tand\x1ctabs\r\n", "naïve Ünïcode 😀 text\nwith lines\n", "x" * 3000, "the same line\n" * 40]


@pytest.fixture
def write(spark, tmp_path):
    """Writes rows as a table's Parquet file, and gives the folder."""

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(2).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put
