"""Settings of a session."""

from quarryline.session import BATCH_BYTES, BATCH_SETTING, bound_batches


def test_bound_is_set_where_the_session_has_none(spark):
    before = spark.conf.get(BATCH_SETTING)
    try:
        spark.conf.unset(BATCH_SETTING)
        bound_batches(spark)
        assert spark.conf.get(BATCH_SETTING).rstrip("b") == str(BATCH_BYTES)
        spark.conf.set(BATCH_SETTING, "1m")
        bound_batches(spark)
        assert spark.conf.get(BATCH_SETTING) == "1m"
    finally:
        spark.conf.set(BATCH_SETTING, before)
