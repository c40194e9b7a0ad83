import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdlens.operators import parity, scaler, scoring, signals, validation
from crowdlens.params import SHRUNK_SIGNALS, SIGNALS, QueueParams
from crowdlens.plans.review_queue import run, score_all_accounts

START = dt.date(2015, 1, 1)


@pytest.fixture(scope="module")
def world(spark):
    """300 ordinary authors, and 5 that post 20 equal 5-star reviews on the day they joined."""
    rng = random.Random(7)
    reviews, users = [], []
    for author in range(300):
        joined = START - dt.timedelta(days=rng.randrange(30, 2000))
        users.append((f"u{author}", dt.datetime.combine(joined, dt.time()), 0, 0, 1, 0))
        for i in range(rng.randrange(3, 15)):
            day = START + dt.timedelta(days=rng.randrange(1000))
            reviews.append((f"u{author}", f"b{rng.randrange(40)}", float(rng.randrange(1, 6)), day, 100, author * 1000 + i))
    for spammer in range(5):
        day = START + dt.timedelta(days=100 * spammer)
        users.append((f"spam{spammer}", dt.datetime.combine(day, dt.time()), 0, 0, 1, 0))
        reviews += [(f"spam{spammer}", f"b{i}", 5.0, day, 30, -spammer) for i in range(20)]
    schema = "user_id string, business_id string, stars double, review_date date, text_len int, text_hash long"
    user_schema = "user_id string, yelping_since_ts timestamp, fans long, useful long, friend_count int, elite_years int"
    return spark.createDataFrame(reviews, schema), spark.createDataFrame(users, user_schema)


PARAMS = QueueParams(hot_rows=50, salts=4)


def test_planted_spammers_fill_the_top(world):
    reviews, users = world
    scored = score_all_accounts(reviews, users, PARAMS)
    top = scoring.review_queue_top(scored.accounts, 5).collect()
    assert {row.user_id for row in top} == {f"spam{i}" for i in range(5)}


def test_hot_businesses_do_not_change_the_signals(world):
    reviews, users = world
    split = signals.reviewer_signals(reviews, users, PARAMS)
    plain = signals.reviewer_signals(reviews, users, QueueParams())
    rounded = [F.round(name, 9).alias(name) for name in SIGNALS]
    assert split.select("user_id", *rounded).exceptAll(plain.select("user_id", *rounded)).count() == 0


def test_signals_against_plain_python(world):
    reviews, users = world
    rows = [r.asDict() for r in reviews.collect()]
    mean = {}
    for b in {r["business_id"] for r in rows}:
        stars = [r["stars"] for r in rows if r["business_id"] == b]
        if len(stars) >= 10:
            mean[b] = sum(stars) / len(stars)
    joined = {r.user_id: r.yelping_since_ts.date() for r in users.collect()}
    for got in signals.reviewer_signals(reviews, users, PARAMS).collect():
        own = [r for r in rows if r["user_id"] == got.user_id]
        days = [r["review_date"] for r in own]
        hashes = [r["text_hash"] for r in own]
        gaps = [abs(r["stars"] - mean[r["business_id"]]) for r in own if r["business_id"] in mean]
        assert got.n_reviews == len(own) >= 3
        assert got.burstiness == pytest.approx(max(days.count(d) for d in days) / len(set(days)))
        assert got.duplication == pytest.approx(sum(hashes.count(h) > 1 for h in hashes) / len(own))
        assert got.rating_extremity == pytest.approx(sum(r["stars"] in (1.0, 5.0) for r in own) / len(own))
        assert got.deviation == pytest.approx(sum(gaps) / len(gaps) if gaps else 0.0)
        assert got.days_to_first_review == (min(days) - joined[got.user_id]).days


@pytest.mark.parametrize("days, expected", [
    (None, 1.442695), (-730, 1.442695), (0, 1.442695), (365, 1 / np.log(367)),
])
def test_precocity(one, days, expected):
    assert one(signals.precocity(F.lit(days).cast("int"))) == pytest.approx(expected, abs=1e-6)


def test_null_stars_text_and_user(spark):
    day = dt.date(2020, 5, 1)
    rows = [("a", "b", None, day, 5, 42)] * 3 + [("a", "b", 5.0, day, 5, 42)] + [(None, "b", 1.0, day, 5, 1)]
    reviews = spark.createDataFrame(
        rows, "user_id string, business_id string, stars double, review_date date, text_len int, text_hash long")
    users = spark.createDataFrame([], "user_id string, yelping_since_ts timestamp")
    got = signals.reviewer_signals(reviews, users, QueueParams()).collect()
    assert [(r.user_id, r.n_reviews, r.rating_extremity, r.duplication, r.deviation) for r in got] == [("a", 4, 0.25, 1.0, 0.0)]
    assert got[0].precocity_imputed and got[0].precocity == pytest.approx(1.442695, abs=1e-6)


def test_texts_without_fingerprint_can_be_unique(spark):
    rows = spark.createDataFrame([("a", None), ("a", None), ("a", 7), ("a", 7)], "user_id string, text_hash long")
    assert signals.duplication(rows).head().duplicate_reviews == 4
    assert signals.duplication(rows, null_is_unique=True).head().duplicate_reviews == 2


@pytest.mark.parametrize("n, x, expected", [(3, 2 / 3, 0.153846), (200, 0.665, 0.633333)])
def test_shrink(spark, n, x, expected):
    row = spark.createDataFrame([(n, x)], "n_reviews int, duplication double")
    got = scaler.shrink_signals(row, {"duplication": 0.0}, 10.0, ["duplication"]).head()
    assert got.s_duplication == pytest.approx(expected, abs=1e-6)
    assert min(x, 0.0) <= got.s_duplication <= max(x, 0.0)


def test_rank_normalise_equals_search_in_sorted_breakpoints(spark):
    rng = np.random.default_rng(5)
    points = sorted([0.0] * 600 + list(rng.random(401)))
    values = [*rng.choice(points, 300), *rng.random(300), -1.0, 2.0, 0.0, float("nan"), None]
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: r.z_s for r in scoring.rank_normalise(df, {"s": "v"}, {"s": points}).collect()}
    from statistics import NormalDist
    for i, v in enumerate(values):
        if v is None:
            assert got[i] is None
            continue
        share = np.searchsorted(points, v, side="right") / 1001
        assert got[i] == pytest.approx(NormalDist().inv_cdf(min(max(share, 0.5 / 1001), 1 - 0.5 / 1001)), abs=1e-12)
    assert got[600] == pytest.approx(-3.2908, abs=1e-4) and got[601] == pytest.approx(3.2908, abs=1e-4)


def test_clip_never_binds_with_1001_breakpoints(world):
    accounts = score_all_accounts(*world, PARAMS).accounts
    widest = accounts.agg(*[F.max(F.abs(F.col(f"z_{name}"))).alias(name) for name in SIGNALS]).head()
    assert max(widest) < 3.2909


def test_sketch_and_exact_breakpoints_agree(world):
    reviews, users = world
    found = signals.reviewer_signals(reviews, users, PARAMS).persist()
    columns = {name: name for name in SIGNALS}
    exact = {(r.signal, r.idx): r.value for r in scaler.cdf_breakpoints(found, columns, 101, exact=True).collect()}
    sketch = {(r.signal, r.idx): r.value for r in scaler.cdf_breakpoints(found, columns, 101).collect()}
    assert exact.keys() == sketch.keys() and len(exact) == 505
    assert all(sketch[key] == pytest.approx(value) for key, value in exact.items())


def test_scaler_round_trip_and_version(spark, world, tmp_path):
    fitted = score_all_accounts(*world, PARAMS).scaler
    fitted.save(spark, str(tmp_path / "scaler"))
    loaded = scaler.Scaler.load(spark, str(tmp_path / "scaler"))
    assert loaded == fitted and loaded.model_version == fitted.model_version
    assert scaler.Scaler.from_table(fitted.to_table(spark)) == fitted


def test_incomplete_scalers_are_refused(spark):
    prior = {name: 0.1 for name in SHRUNK_SIGNALS}
    points = {name: [0.0, 1.0] for name in SIGNALS}
    scaler.Scaler(prior_mean=prior, cdf_breakpoints=points).validate()
    for broken in (
        scaler.Scaler(prior_mean=prior, cdf_breakpoints={**points, "precocity": []}),
        scaler.Scaler(prior_mean={**prior, "deviation": None}, cdf_breakpoints=points),
        scaler.Scaler(prior_mean=prior, method="robust_z", median=prior, scale={name: 0.0 for name in SIGNALS}),
        scaler.Scaler(prior_mean=prior, cdf_breakpoints=points, method="other"),
    ):
        with pytest.raises(scaler.IncompleteScaler):
            broken.validate()
        with pytest.raises(scaler.IncompleteScaler):
            scoring.score_signals(spark.range(1), broken)


def test_robust_scaler_refuses_a_signal_that_is_mostly_zero(world):
    found = signals.reviewer_signals(*world, PARAMS)
    with pytest.raises(scaler.IncompleteScaler):
        scaler.fit_robust_scaler(found.withColumns({"duplication": F.lit(0.0), "precocity": F.lit(1.0)}), PARAMS)


def test_validation_rejects_instead_of_defaulting(spark):
    fields = "id int, n_reviews int, " + ", ".join(f"{name} double" for name in SIGNALS)
    good = (5, 0.1, 0.2, 0.3, 0.4, 0.5)
    rows = [(1, *good), (2, None, *good[1:]), (3, 0, *good[1:]), (4, 5, None, *good[2:]),
            (5, 5, 0.1, 1.2, *good[3:]), (6, 5, 0.1, 0.2, 0.3, float("nan"), 0.5), (7, 5, -0.1, *good[2:])]
    valid, rejected = validation.validate_signals(spark.createDataFrame(rows, fields))
    assert [r.id for r in valid.collect()] == [1]
    found = {r.id: [e.pointer for e in r.errors] for r in rejected.collect()}
    assert found == {2: ["/n_reviews"], 3: ["/n_reviews"], 4: ["/burstiness"], 5: ["/duplication"],
                     6: ["/deviation"], 7: ["/burstiness"]}


def test_null_inputs_give_null_scores(spark, world):
    fitted = score_all_accounts(*world, PARAMS).scaler
    row = spark.createDataFrame([("a", 5, None, 0.0, 0.0, 0.0, 1.0)],
                                "user_id string, n_reviews int, " + ", ".join(f"{name} double" for name in SIGNALS))
    got = scoring.score_accounts(row, fitted).head()
    assert got.component_burstiness is None and got.anomaly_score is None and got.queue_score is None


def test_parity_names_the_component(spark):
    fields = "user_id string, anomaly_score double, a double, b double"
    batch = spark.createDataFrame([("x", 3.0, 1.0, 2.0), ("y", 3.0, 1.0, 2.0), ("z", None, 1.0, 2.0), ("m", 1.0, 1.0, 0.0)], fields)
    served = spark.createDataFrame([("x", 3.00001, 1.0, 2.00001), ("y", 4.0, 1.1, 2.9), ("z", 1.0, 1.0, 2.0), ("s", 1.0, 1.0, 0.0)], fields)
    compared = {r.user_id: (r.status, r.suspect) for r in parity.compare_scores(batch, served, components=["a", "b"]).collect()}
    assert compared == {"x": ("ok", None), "y": ("mismatch", "b"), "z": ("skipped", None),
                        "m": ("missing_in_served", None), "s": ("missing_in_batch", None)}
    assert parity.scoring_parity(batch, served, components=["a", "b"]).count() == 3


def test_queue_job_writes_accounts_scaler_and_csv(spark, world, tmp_path):
    reviews, users = world
    reviews.write.parquet(str(tmp_path / "review"))
    users.write.parquet(str(tmp_path / "user"))
    run(spark, str(tmp_path / "review"), str(tmp_path / "user"), str(tmp_path / "out"), PARAMS, top=7)
    csv = spark.read.option("header", True).csv(str(tmp_path / "out/review_queue_top"))
    assert csv.count() == 7 and csv.columns[:2] == ["user_id", "n_reviews"]
    accounts = spark.read.parquet(str(tmp_path / "out/reviewer_anomaly"))
    served = scoring.score_accounts(accounts, scaler.Scaler.load(spark, str(tmp_path / "out/anomaly_scaler")))
    batch = accounts.withColumnsRenamed({f"z_{name}": f"component_{name}" for name in SIGNALS})
    components = [f"component_{name}" for name in SIGNALS]
    assert parity.scoring_parity(batch, served, components=components).count() == 0


def test_no_python_and_no_cross_join_in_the_scoring_plan(world):
    plan = score_all_accounts(*world, PARAMS).accounts._jdf.queryExecution().executedPlan().toString()
    history = signals.reviewer_signals(*world, PARAMS)._jdf.queryExecution().executedPlan().toString()
    for text in (plan, history):
        for word in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert word not in text
