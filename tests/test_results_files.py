"""A results file in many parts: the last row of a match is that of the last part, and no task has all rows."""

from conftest import DATA

from touchline.plans.registry import QUERIES
from touchline.sources import feeds


def test_the_last_row_of_the_last_part_stays(spark, tmp_path):
    head = "date,home_team,away_team,home_score,away_score,tournament,neutral\n"
    for part, pad in ((0, 10), (1, 3000), (2, 200)):  # the largest in the middle: readers take the largest first
        more = "".join(f"2024-01-0{1 + part},x{k},y,1,1,t,true\n" for k in range(pad))
        (tmp_path / f"part-0000{part}.csv").write_text(head + f"2024-01-01,a,b,{part},0,t,true\n" + more)
    got = feeds.results_file(spark, f"{tmp_path}-none", str(tmp_path))
    assert [r["home_score"] for r in got.filter("home_team = 'a'").collect()] == [2]


def test_the_file_is_written_by_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = QUERIES["s04_results_file"](spark, DATA)
        assert len(got.inputFiles()) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
