"""What runs settle is removed, and nothing else."""

import glob
import os
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from postsieve import session, use_checkpoint_dir
from postsieve.plans.daily import daily
from postsieve.plans.search import recommended, search
from postsieve.sources.raw_csv import read_digest
from tests.test_commands import NOW, frames, make


def folder_of(spark):
    return f"{use_checkpoint_dir(spark)}/postsieve".removeprefix("file:")


def files(folder):
    return {f for f in glob.glob(f"{folder}/**", recursive=True) if os.path.isfile(f)}


def test_nothing_but_outputs_is_left_after_a_run(spark, tmp_path):
    pages, sightings, scores = frames(spark, *make())
    root = folder_of(spark)
    before = files(root)
    with daily(pages, sightings, NOW, "engineer", "USA", yoe=2, scores=scores) as run:
        assert files(root) > before
        target = run.write(str(tmp_path), as_digest=True)
    assert files(root) == before
    assert read_digest(spark, target).count() > 0 and os.listdir(tmp_path / "quarantine")
    # by text, which settles more, and for many pages
    profile = spark.sql("SELECT 'python' AS profile")
    with daily(pages, sightings, NOW, "engineer", "USA", yoe=2, profile=profile) as run:
        assert run.settled().digest().count() > 0
    with search(pages, sightings, NOW, "", "USA", "1M", page_count=50, scores=scores) as run:
        assert run.records().count() > 0
    assert files(root) == before


def test_a_run_that_fails_leaves_nothing(spark, tmp_path):
    pages, sightings, scores = frames(spark, *make(n_sightings=100))
    root = folder_of(spark)
    before = files(root)
    broken = scores.withColumn("match_score", F.raise_error(F.lit("no score")).cast("double"))
    with pytest.raises(Exception, match="no score"):
        recommended(pages, scores=broken)
    assert files(root) == before
    with pytest.raises(ZeroDivisionError):
        with recommended(pages, scores=scores) as run:
            run.records().collect()
            raise ZeroDivisionError
    assert files(root) == before
    with pytest.raises(ValueError):
        session.remove_folder(spark, str(tmp_path))


def test_rows_of_an_open_run_can_be_read_again(spark):
    pages, sightings, scores = frames(spark, *make(n_sightings=100))
    run = recommended(pages, scores=scores)
    records = run.records()
    assert records.count() == records.count() == 25
    run.close()
    run.close()


def test_abandoned_runs_are_removed_by_age_and_owner(spark, tmp_path):
    root = folder_of(spark)
    own, other = session.open_folder(spark), session.open_folder(spark)
    fs, path = session._file_system(spark, f"{other}/_owner")
    out = fs.create(path)
    out.writeUTF("application-of-yesterday")
    out.close()
    names = [f.rsplit("/", 1)[1] for f in (own, other)]
    assert not set(names) & set(session.remove_scratch(spark, abandoned_for=timedelta(days=1)))
    removed = session.remove_scratch(spark, abandoned_for=timedelta(seconds=-60))
    assert names[1] in removed and names[0] not in removed
    assert os.path.isdir(f"{root}/{names[0]}")
    session.remove_folder(spark, own)
    assert not os.path.isdir(f"{root}/{names[0]}")
