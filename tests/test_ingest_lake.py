import json

import pytest
from pyspark.sql import functions as F

from crowdlens.operators.signals import reviews_in_window
from crowdlens.plans import labelled_table
from crowdlens.params import LabelParams
from crowdlens.sources import lake, raw
from crowdlens.sources.schemas import SCHEMAS


@pytest.fixture(scope="module")
def lines(tmp_path_factory):
    """Raw files of all five entities, with a broken line, a record without id and a bad time."""
    root = tmp_path_factory.mktemp("raw")
    records = {
        "business": [{"business_id": f"b{i}", "name": "n", "stars": 4.5, "is_open": i % 2, "categories": "Bars, Food , Cafes" if i % 2 else None,
                      "attributes": {"WiFi": "free", "Parking": {"lot": True}, "Nothing": None}} for i in range(20)],
        "review": [{"review_id": f"r{i}", "user_id": f"u{i % 7}", "business_id": f"b{i % 20}", "stars": 1.0 + i % 5,
                    "text": "a rather long review text, number %d, with enough letters" % i,
                    "date": f"{2017 + i % 3}-05-0{1 + i % 9} 10:00:00"} for i in range(90)],
        "user": [{"user_id": f"u{i}", "friends": "None" if i else "a, b", "elite": "" if i else "2010,2011",
                  "yelping_since": "2015-01-01 00:00:00", "review_count": 3, "average_stars": 3.0} for i in range(7)],
        "checkin": [{"business_id": "b0", "date": "2015-01-01 00:00:00, 2015-01-02 00:00:00"}, {"business_id": "b1", "date": ""}],
        "tip": [{"user_id": "u0", "business_id": "b0", "text": "t", "date": "2016-02-03 04:05:06", "compliment_count": 1}],
    }
    records["review"][5]["date"] = "bad"
    paths = {}
    for entity, rows in records.items():
        text = "\n".join(json.dumps(row) for row in rows)
        if entity == "review":
            text += '\n{bad\n{"text": "no id"}\n'
        (root / f"{entity}.json").write_text(text)
        paths[entity] = str(root / f"{entity}.json")
    return paths


@pytest.fixture(scope="module")
def tables(spark, lines, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    return out, {result.entity: result for result in raw.ingest(spark, lines, out)}


def test_every_row_lands_or_is_quarantined(tables):
    _, results = tables
    counts = {e: (r.rows_in, r.rows_written, r.rows_quarantined) for e, r in results.items()}
    assert counts == {"business": (20, 20, 0), "review": (92, 90, 2), "user": (7, 7, 0), "checkin": (2, 2, 0), "tip": (1, 1, 0)}


def test_quarantine_keeps_the_text(spark, tables):
    found = {r["_corrupt"] for r in spark.read.parquet(tables[0] + "/_quarantine/review").collect()}
    assert "{bad" in found


def test_bad_time_is_null_not_an_error(spark, tables):
    row = spark.read.parquet(tables[0] + "/review").where("review_id = 'r5'").head()
    assert row.ts is None and row.review_date is None and row.year is None


def test_transformed_columns(spark, tables):
    out, _ = tables
    business = {r.business_id: r for r in spark.read.parquet(out + "/business").collect()}
    assert business["b1"].category_list == ["Bars", "Food", "Cafes"] and business["b1"].is_open is True
    assert business["b0"].category_list == [] and business["b0"].n_categories == 0
    assert json.loads(business["b0"].attributes["Parking"]) == {"lot": True} and business["b0"].attributes["Nothing"] is None
    user = {r.user_id: (r.friend_count, r.elite_years) for r in spark.read.parquet(out + "/user").collect()}
    assert user["u0"] == (2, 2) and user["u1"] == (0, 0)
    assert {r.business_id: r.checkin_count for r in spark.read.parquet(out + "/checkin").collect()} == {"b0": 2, "b1": 0}
    tip = spark.read.parquet(out + "/tip").head()
    assert str(tip.tip_date) == "2016-02-03" and "date" not in tip.asDict()
    dropped = {"friends", "elite", "yelping_since"}
    assert not dropped & set(spark.read.parquet(out + "/user").columns)


def test_subset_unknown_and_missing_input(spark, lines, tmp_path):
    assert [r.entity for r in raw.ingest(spark, lines, str(tmp_path), ["tip"])] == ["tip"]
    with pytest.raises(ValueError):
        raw.ingest(spark, lines, str(tmp_path), ["photo"])
    with pytest.raises(raw.MissingInput):
        raw.read_raw(spark, "tip", str(tmp_path / "absent.json"))


def test_schemas():
    assert [f.name for f in SCHEMAS["tip"].fields] == ["user_id", "business_id", "text", "date", "compliment_count"]
    assert not SCHEMAS["review"]["review_id"].nullable and SCHEMAS["review"]["text"].nullable
    assert len(SCHEMAS["user"].fields) == 22 and len(SCHEMAS["business"].fields) == 14


def test_filters_reach_the_partitions_and_the_scan(spark, tables):
    review = spark.read.parquet(tables[0] + "/review")
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    by_year = plan(lake.reviews_of_year(review, 2018))
    assert "PartitionFilters: [isnotnull(year" in by_year and "text:" not in by_year
    window = plan(reviews_in_window(review, "2018-01-01", "2019-01-01").select("user_id", "stars"))
    assert "year" in window.split("PartitionFilters: [")[1].split("]")[0]
    assert "IsNotNull(user_id)" in window and "ReadSchema: struct<user_id:string,stars:double,review_date:date>" in window
    assert lake.reviews_of_year(review, 2018).head().reviews == 30
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_landing_keeps_partitions_and_tables_see_them(spark, tables, tmp_path):
    target = str(tmp_path / "lake/review")
    lake.land(spark, tables[0] + "/review", target)
    manifest = {r.partition: r.files for r in lake.landing_manifest(spark, target).collect()}
    assert {"year=2017", "year=2018", "year=2019"} <= set(manifest) and all(n >= 1 for n in manifest.values())
    lake.register_table(spark, "landed_review_test", target, ["year"])
    try:
        assert spark.table("landed_review_test").where("year = 2018").count() == 30
    finally:
        spark.sql("DROP TABLE landed_review_test")


def test_dynamic_overwrite_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    lake.write_parquet(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), path, ["p"])
    lake.write_parquet(spark.createDataFrame([(3, "b")], "v int, p string"), path, ["p"], only_these_partitions=True)
    assert {(r.v, r.p) for r in spark.read.parquet(path).collect()} == {(1, "a"), (3, "b")}


def test_labelled_table_job(spark, tables, tmp_path):
    summary = labelled_table.run(spark, tables[0], str(tmp_path), LabelParams(top_k=2, stoplist=("Food",))).collect()
    assert {r.split for r in summary} <= {"train", "test"} and sum(r.rows for r in summary) == 45
    one_side = spark.read.parquet(str(tmp_path / "review_labeled")).where(F.col("split") == "train")
    assert "PartitionFilters: [isnotnull(split" in one_side._jdf.queryExecution().executedPlan().toString()
    assert spark.read.parquet(str(tmp_path / "category_vocab")).count() == 2


def test_blank_lines_are_no_records_and_old_quarantines_go(spark, tmp_path):
    path, out = tmp_path / "tip.json", str(tmp_path / "out")
    good = '{"user_id": "u", "business_id": "b", "text": "t", "date": "2019-01-01 00:00:00", "compliment_count": 1}'
    path.write_text(f"{good}\n{{bad\n")
    assert raw.ingest_entity(spark, "tip", str(path), out).rows_quarantined == 1
    path.write_text(f"{good}\n\t\t\n  \n\n")
    result = raw.ingest_entity(spark, "tip", str(path), out)
    assert (result.rows_in, result.rows_written, result.rows_quarantined) == (1, 1, 0)
    assert spark.read.schema("raw string").parquet(f"{out}/_quarantine/tip").count() == 0


def test_tables_without_a_year_land_as_well(spark, tables, tmp_path):
    lake.land(spark, tables[0] + "/user", str(tmp_path / "user"))
    assert spark.read.parquet(str(tmp_path / "user")).count() == 7
