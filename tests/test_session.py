import pytest

from tablewright.session import work_folder


class Conf:
    def __init__(self, **values):
        self.values = {k.replace("_", "."): v for k, v in values.items()}

    def get(self, key, default=None):
        return self.values.get(key, default)


class Session:
    def __init__(self, **values):
        self.conf = Conf(**values)


def test_shared_folder_is_used():
    folder = work_folder(Session(spark_checkpoint_dir="hdfs://names/checkpoints", spark_master="yarn"))
    assert folder.startswith("hdfs://names/checkpoints/tablewright-")
    assert folder != work_folder(Session(spark_checkpoint_dir="hdfs://names/checkpoints", spark_master="yarn"))


def test_no_machine_folder_on_a_cluster():
    with pytest.raises(ValueError):
        work_folder(Session(spark_master="spark://host:7077"))


def test_local_session_may_go_without():
    assert "tablewright-" in work_folder(Session(spark_master="local[4]"))


def test_old_work_folders_are_removed(spark, tmp_path):
    from tablewright.session import SharedFolder, clean_work

    assert clean_work(spark) == []
    session = Session(spark_checkpoint_dir=str(tmp_path))
    session._jvm, session._jsparkSession = spark._jvm, spark._jsparkSession
    spark.range(3).write.parquet(work_folder(session))
    (tmp_path / "other").mkdir()
    assert clean_work(session) == []
    assert len(clean_work(session, grace=-1.0)) == 1 and [p.name for p in tmp_path.iterdir()] == ["other"]
    folder = SharedFolder(spark, str(tmp_path))
    assert folder.create("a") and not folder.create("a") and set(folder.names()) == {"a", "other"} and folder.names("none") == {}


def test_only_small_stored_tables_are_dealt_out(spark, data):
    from tablewright.session import is_scan, spread

    stored = spark.read.parquet(f"{data}/orders.parquet")
    assert is_scan(stored.where("o_orderkey > 3").select("o_orderkey")) and not is_scan(stored.groupBy("o_custkey").count())
    cores = spark.sparkContext.defaultParallelism
    assert spread(stored).rdd.getNumPartitions() == cores
    made = spark.range(100, numPartitions=2)
    assert spread(made) is made
