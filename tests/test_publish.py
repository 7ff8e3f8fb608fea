import pytest

from rowgate import commit_log, drop_former, publish_validation, published
from rowgate.plans import runner
from rowgate.plans.publish import NothingPublished

RULES = [("v", "int", "at least 5")]


def frame(spark, n):
    return spark.range(n).selectExpr("id", "CAST(id AS INT) AS v")


def counts(spark, base):
    p = published(spark, base)
    got = (p.valid(spark).count(), p.invalid(spark).count())
    assert got == (p.valid_count, p.invalid_count)
    return p.run_id, *got


def test_a_run_that_dies_between_its_writes_leaves_the_former_pair(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "t")
    with pytest.raises(NothingPublished):
        published(spark, base)
    first = publish_validation(frame(spark, 10), RULES, base, "one")
    assert counts(spark, base) == ("one", 5, 5) and first.summary == [("v_at_least_5_0_ok", 5, 50.0)]
    real, written = runner.write_frame, []

    def dies(df, path, *args, **kw):
        if path.endswith("/invalid"):
            raise OSError("executor lost")
        written.append(path)
        real(df, path, *args, **kw)
    with monkeypatch.context() as m:
        m.setattr(runner, "write_frame", dies)
        with pytest.raises(OSError):
            publish_validation(frame(spark, 100), RULES, base, "two")
    assert len(written) == 1 and counts(spark, base) == ("one", 5, 5)  # half of "two" is there, unseen
    publish_validation(frame(spark, 100), RULES, base, "two")
    assert counts(spark, base) == ("two", 95, 5)


def test_a_repeated_run_id_changes_nothing(spark, tmp_path):
    base = str(tmp_path / "t")
    one = publish_validation(frame(spark, 10), RULES, base, "run 1/é")
    two = publish_validation(frame(spark, 20), RULES, base, "2")
    again = publish_validation(frame(spark, 50), [], base, "run 1/é")
    assert again == one and counts(spark, base) == ("2", 15, 5) and commit_log(spark, base).count() == 2
    assert published(spark, base, "run 1/é").valid(spark).count() == 5 and (one.number, two.number) == (1, 2)
    with pytest.raises(ValueError):
        publish_validation(frame(spark, 1), RULES, base, "")


def test_a_number_taken_by_another_run(spark, tmp_path, monkeypatch):
    """Two runs that commit at the same time get two numbers."""
    from rowgate.plans import publish

    base = str(tmp_path / "t")
    publish_validation(frame(spark, 10), RULES, base, "one")
    real, stale = publish.commit_log, []

    def late(s, b):
        log = real(s, b)
        if not stale:
            stale.append(1)
            return log.where("number < 0")  # as seen before "one" was there
        return log
    with monkeypatch.context() as m:
        record = {"run_id": "two", "format": "parquet", "valid_path": "v", "invalid_path": "i", "valid_count": 0, "invalid_count": 0,
                  "summary": [], "refused": []}
        m.setattr(publish, "commit_log", late)
        assert publish._commit(spark, base, record).number == 2
    assert commit_log(spark, base).count() == 2


def test_former_runs_are_dropped_when_asked(spark, tmp_path):
    base = str(tmp_path / "t")
    runs = [publish_validation(frame(spark, n), RULES, base, str(n)) for n in (6, 7, 8)]
    assert drop_former(spark, base, keep=2) == 1
    assert published(spark, base, "7").valid(spark).count() == 2 and counts(spark, base) == ("8", 3, 5)
    with pytest.raises(Exception):
        runs[0].valid(spark).count()
    assert publish_validation(frame(spark, 6), RULES, base, "6").number == 1  # still known as committed
