"""All jobs in a row on one small world, through the command line entry."""

import json
import random

import pytest

import crowdlens.__main__ as command
from crowdlens.plans import metrics_store
from crowdlens.streaming.scorer import landed

WORDS = {"Bars": "beer cocktail bartender", "Spas": "massage towel relax", "Gyms": "weights trainer squat"}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    rng = random.Random(21)
    folder = tmp_path_factory.mktemp("jobs")
    (folder / "raw").mkdir()
    kinds = list(WORDS)
    businesses = [{"business_id": f"b{i}", "name": f"n{i}", "state": "AZ", "is_open": 1, "categories": f"Food, {kinds[i % 3]}"} for i in range(60)]
    reviews, users = [], []
    for u in range(40):
        users.append({"user_id": f"u{u}", "yelping_since": "2012-01-01 00:00:00", "friends": "a, b", "elite": "", "review_count": 9,
                      "average_stars": 3.5, "useful": 1, "fans": u})
        for i in range(10):
            b = rng.randrange(60)
            text = " ".join(rng.choices(WORDS[kinds[b % 3]].split(), k=5) + rng.choices("really good place came again".split(), k=8))
            reviews.append({"review_id": f"r{u}-{i}", "user_id": f"u{u}", "business_id": f"b{b}", "stars": float(rng.randrange(1, 6)),
                            "text": text, "date": f"201{4 + i % 5}-0{1 + i % 9}-11 08:00:00"})
    for name, rows in {"business": businesses, "review": reviews, "user": users}.items():
        (folder / "raw" / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
    return folder


def run(root, job, *more, **paths):
    named = [part for name, path in paths.items() for part in (f"--{name}", str(root / path))]
    command.main([job, *named, *more])


def test_all_jobs(spark, root, capsys):
    settings = {"select_k": "40", "svd_dims": "4", "min_df": "2"}
    for name, value in settings.items():
        spark.conf.set(f"spark.crowdlens.{name}", value)
    try:
        run(root, "ingest", "--only", "business", "review", "user", raw="raw", out="tables")
        run(root, "features", tables="tables", out="features")
        run(root, "queue", "--top", "9", tables="tables", out="queue")
        run(root, "parity", out="queue")
        run(root, "baselines", "--arms", "linear_tfidf", features="features", out="models")
        run(root, "replay", "--limit", "30", features="features", target="messages")
        run(root, "stream", model="models/text_model", out="scored", checkpoint="ckpt", path="messages")
        run(root, "land", "--dry-run", source="tables/review", target="lake")
        run(root, "land", source="tables/review", target="lake")
    finally:
        for name in settings:
            spark.conf.unset(f"spark.crowdlens.{name}")
    assert spark.read.option("header", True).csv(str(root / "queue/review_queue_top")).count() == 9
    report = metrics_store.latest(spark, str(root / "models/baseline_metrics")).head()
    assert report.arm == "linear_tfidf" and report.macro_average_precision > 0.9
    scored = landed(spark, str(root / "scored/scored"))
    assert scored.count() == 30 and all(r.e2e_ms > 0 for r in scored.collect())
    assert spark.read.parquet(str(root / "lake")).count() == 400
    assert "year=2014" in capsys.readouterr().out


def test_metrics_versions(spark, tmp_path):
    path = str(tmp_path / "metrics")
    assert metrics_store.latest(spark, path) is None
    metrics_store.record(spark.createDataFrame([("a", 1.0), ("b", 1.0)], "arm string, v double"), path)
    merged = metrics_store.record(spark.createDataFrame([("b", 2.0)], "arm string, v double"), path)
    assert {tuple(r) for r in merged.collect()} == {("a", 1.0), ("b", 2.0)}
    assert spark.read.parquet(path).count() == 4
