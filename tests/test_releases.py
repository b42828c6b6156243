"""Releases: a run that dies leaves the one before it in use."""

import pytest

from touchline.plans import weekly
from touchline.sources import releases


def staged(folder, value):
    folder.mkdir()
    (folder / "metrics.json").write_text(f'{{"v": {value}}}')
    (folder / "model").mkdir()
    (folder / "model" / "part").write_text(str(value))
    return folder.as_uri()


def test_publish_and_a_run_that_dies(spark, tmp_path, monkeypatch):
    root = (tmp_path / "live").as_uri()
    assert releases.current(spark, root) is None and releases.versions(spark, root) == []
    first = releases.publish(spark, staged(tmp_path / "a", 1), root, "2026-01")
    assert releases.current(spark, root) == first and weekly.production_metrics(spark, f"{first}/metrics.json") == {"v": 1}
    second = staged(tmp_path / "b", 2)
    whole = releases.copy_tree

    def dies(s, source, target):
        whole(s, f"{source}/metrics.json", f"{target}/metrics.json")
        raise KeyboardInterrupt

    monkeypatch.setattr(releases, "copy_tree", dies)
    with pytest.raises(KeyboardInterrupt):
        releases.publish(spark, second, root, "2026-02")
    assert releases.current(spark, root) == first and weekly.production_metrics(spark, f"{first}/metrics.json") == {"v": 1}
    assert releases.versions(spark, root) == ["2026-01", "2026-02"]
    monkeypatch.setattr(releases, "copy_tree", whole)
    place = releases.publish(spark, second, root, "2026-02")
    assert releases.current(spark, root) == place and (tmp_path / "live" / "2026-02" / "model" / "part").read_text() == "2"
    with pytest.raises(FileExistsError):
        releases.publish(spark, second, root, "2026-02")
    releases.point(spark, root, "2026-01")
    assert releases.current(spark, root) == first
    for bad in ("", "a/b", "CURRENT"):
        with pytest.raises(ValueError):
            releases.publish(spark, second, root, bad)


def test_production_metrics_of_the_release(spark, tmp_path):
    root = (tmp_path / "live").as_uri()
    assert weekly.released_metrics(spark, root) == {}
    releases.publish(spark, staged(tmp_path / "a", 5), root, "1")
    assert weekly.released_metrics(spark, root) == {"v": 5}
    assert weekly.production_metrics(spark, f"{root}/none.json") == {}
