"""Input files by header: types, order of the file, rejected lines."""

import pytest

from transitio.operators import sequences as SQ
from transitio.sources import io as IO

BATTERY = "date,extra,user,battery:battery_std_level:morning," + ",".join(f"battery:battery_mean_level:{e}" for e in ("evening", "night", "morning", "afternoon"))


def _write(tmp_path, name, lines):
    (tmp_path / name).write_text("\n".join(lines) + "\n")
    return str(tmp_path / name)


def test_columns_by_name_and_rejected_lines(spark, tmp_path):
    path = _write(tmp_path, "b.csv", [BATTERY, "2024-01-02,x,7,1.5,40,10,20,30", "2024-01-02,y,7,,41,11,21,31",
                                      "2024-01-03,z,seven,1,1,1,1,1", "2024-01-04,short,7", "not a date,x,7,1,1,1,1,1",
                                      '2024-01-05,"a, ""quoted"" one",8,0,1,2,3,4'])
    good, bad = IO.load_input(spark, path, "battery", str(tmp_path / "out"))
    rows = good.orderBy("file_order").collect()
    assert [(r.user, str(r.date), r.battery_night, r.battery_afternoon, r.battery_std_morning) for r in rows] == [
        (7, "2024-01-02", 10.0, 30.0, 1.5), (7, "2024-01-02", 11.0, 31.0, None), (8, "2024-01-05", 2.0, 4.0, 0.0)]
    assert sorted(r.line for r in bad.collect()) == ["2024-01-03,z,seven,1,1,1,1,1", "2024-01-04,short,7", "not a date,x,7,1,1,1,1,1"]
    first = SQ.first_of_day(good).where("user = 7").collect()
    assert len(first) == 1 and first[0].battery_night == 10.0


def test_applications_of_any_category(spark, tmp_path):
    path = _write(tmp_path, "a.csv", ["user,date,application:duration:social media:night,application:duration:games:evening", "1,2024-01-01,5,6"])
    good, bad = IO.load_input(spark, path, "apps", str(tmp_path / "out"))
    r = good.first()
    assert (r["app_social media_night"], r["app_games_evening"]) == (5.0, 6.0) and bad.count() == 0


def test_absent_column_and_empty_file(spark, tmp_path):
    with pytest.raises(ValueError, match="PHQ9"):
        IO.load_input(spark, _write(tmp_path, "p.csv", ["user,date,idx", "1,2024-01-01,2"]), "phq", str(tmp_path / "o1"))
    good, bad = IO.load_input(spark, _write(tmp_path, "q.csv", ["user,date,idx,PHQ9"]), "phq", str(tmp_path / "o2"))
    assert good.count() == 0 and bad.count() == 0


def test_survey_keeps_the_first_row_of_a_user(spark, tmp_path):
    path = _write(tmp_path, "s.csv", ["bg_age,user,group,bg_sex", "40,1,patient,1", "41,1,mmm-control,0", "30,2,patient,0"])
    good, _ = IO.load_input(spark, path, "survey", str(tmp_path / "out"))
    assert sorted((r.user, r.bg_age) for r in SQ.dedupe_survey(good).collect()) == [(1, 40), (2, 30)]
