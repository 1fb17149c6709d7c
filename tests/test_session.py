from inocula.session import DEFAULT_CONF, cluster_conf

TB = 1024**4


def test_cluster_conf_scales_and_caps_shuffle_partitions():
    big = cluster_conf(100 * TB, executors=1000)
    assert int(big["spark.sql.shuffle.partitions"]) == 200_000  # capped
    small = cluster_conf(10 * 1024**3, executors=10)
    assert int(small["spark.sql.shuffle.partitions"]) == 3 * 10 * 4  # at least three per core
    mid = cluster_conf(10 * TB, executors=100)
    assert int(mid["spark.sql.shuffle.partitions"]) == 10 * TB // (512 * 1024**2)
    assert big["spark.sql.adaptive.enabled"] == "true"
    assert big["spark.sql.adaptive.forceOptimizeSkewedJoin"] == "true"
    assert "spark.checkpoint.dir" not in big  # the cluster's shared folder is never overridden


def test_defaults_keep_the_ui_off_and_pages_small():
    assert DEFAULT_CONF["spark.ui.enabled"] == "false"
    assert DEFAULT_CONF["spark.buffer.pageSize"] == "8m"


def test_command_line_parameters():
    import pytest

    from inocula.__main__ import _params

    p = _params(["event_date=2021-05-10", "event_workday=2", "facilities=A,B", "ill_staff=S7"])
    assert (p.event_date, p.event_workday, p.facilities, p.ill_staff) == ("2021-05-10", 2, ("A", "B"), "S7")
    with pytest.raises(SystemExit):
        _params(["no_such_parameter=1"])
