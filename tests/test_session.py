import os


def test_checkpoint_dir_comes_from_the_session(spark):
    from spanflow.session import checkpoint_dir
    d = checkpoint_dir(spark)
    assert d and d == spark.sparkContext.getCheckpointDir()      # set once, then read back
    assert checkpoint_dir(spark) == d


def test_reliable_checkpoint_cuts_lineage(spark):
    from spanflow.session import checkpoint_dir
    checkpoint_dir(spark)
    df = spark.range(100).selectExpr("id", "id * 2 AS x").checkpoint()
    assert df.count() == 100
    path = spark.sparkContext.getCheckpointDir().replace("file:", "")
    assert os.path.isdir(path)
