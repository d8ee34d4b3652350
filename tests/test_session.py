from trolley.session import scale_settings


def test_scale_settings_bounds():
    big = scale_settings(100 * 1024 ** 4, 4000)
    assert int(big["spark.sql.shuffle.partitions"]) == 100_000
    small = scale_settings(10 * 1024 ** 2, 8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
