"""Exports of one file per item, scanned from files with their paths."""

import csv

from forklore import schemas
from forklore.sources import exports


def write(path, schema, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="") as out:
        made = csv.writer(out)
        made.writerow(schema.names)
        made.writerows([["" if v is None else v for v in row] for row in rows])


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_commits_of_requests(spark, tmp_path):
    made = {
        ("o.r", 7): [("a1", "ann", "a@x", "Ann, B"), ("b2", "bob", "b@x", 'Bob "B"')],
        ("o.r", 12): [("a1", "ann", "a@x", "Ann, B"), ("", "none", "", "")],
        ("my_o.x_y", 7): [(f"c{i}", "cy", "c@x", "Cy") for i in range(60)],
    }
    for (project, pr), commits in made.items():
        write(tmp_path / f"get_pr_commits.{project}_{pr}.csv", schemas.PR_COMMITS, [
            (i, login, email, name, "2020-01-01T00:00:00Z", "", f'line "1"\nline 2 of {sha}', "", sha)
            for i, (sha, login, email, name) in enumerate(commits)
        ])
    raw = exports.read_csv(spark, str(tmp_path), schemas.PR_COMMITS)
    commits, pairs, counts = exports.pr_commits(raw)
    assert rows(pairs) == {(p, str(n), c[0]) for (p, n), cs in made.items() for c in cs if c[0]}
    assert rows(counts) == {("o.r", "7", 2), ("o.r", "12", 1), ("my_o.x_y", "7", 60)}
    assert rows(commits) == {
        (p, c[0], c[1], c[2], c[3], "2020-01-01T00:00:00Z") for (p, _), cs in made.items() for c in cs if c[0]
    }
    assert exports.pr_commits(raw, exports.PUBLISHED_MAX_COMMITS)[1].count() == 3
    # many small files share a task
    assert raw.rdd.getNumPartitions() <= 3


def test_files_of_commits(spark, tmp_path):
    for sha, changes in {"0a1b": [("a.py", 3, 1, "modified"), ("b, c.py", 0, 9, "removed")], "ff00": [("d\ne", 1, 0, "added")]}.items():
        write(tmp_path / f"get_commit_changedFile.o.r_{sha}.csv", schemas.CHANGED_FILES, [
            (i, added, added + removed, removed, name, status) for i, (name, added, removed, status) in enumerate(changes)
        ])
    got = exports.changed_files(exports.read_csv(spark, str(tmp_path), schemas.CHANGED_FILES))
    assert rows(got) == {
        ("o.r", "0a1b", 1, "a.py", 3, 1, False), ("o.r", "0a1b", 2, "b, c.py", 0, 9, True), ("o.r", "ff00", 1, "d\ne", 1, 0, False),
    }
