"""The catalogue runner (``python -m clickspark``)."""

from clickspark.__main__ import main


def test_list_and_unknown(capsys):
    assert main(["list"]) == 0
    out = capsys.readouterr().out
    assert "country_share" in out and "sql-twin" in out and "rows-only" in out
    assert main(["run", "no_such_query"]) == 2


def test_run_one_query(spark, capsys):
    assert main(["run", "device_pivot", "--sf", "/root/testdata/sf0.001", "--rows", "2"]) == 0
    assert "desktop" in capsys.readouterr().out
