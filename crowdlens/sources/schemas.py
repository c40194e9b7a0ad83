"""Declared schemas of the raw records. Inference would cost a pass and vary with the data read first."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

STRING, LONG, INT, DOUBLE = StringType(), LongType(), IntegerType(), DoubleType()
TEXT_MAP = MapType(STRING, STRING)

# Field names, types and field order of the five raw entities. The first id of a keyed
# entity is declared non-null; the JSON reader does not enforce that, see `sources.raw.read_raw`.
SCHEMAS = {
    "business": StructType([
        StructField("business_id", STRING, nullable=False),
        StructField("name", STRING),
        StructField("address", STRING),
        StructField("city", STRING),
        StructField("state", STRING),
        StructField("postal_code", STRING),
        StructField("latitude", DOUBLE),
        StructField("longitude", DOUBLE),
        StructField("stars", DOUBLE),
        StructField("review_count", LONG),
        StructField("is_open", INT),
        StructField("attributes", TEXT_MAP),
        StructField("categories", STRING),
        StructField("hours", TEXT_MAP),
    ]),
    "review": StructType([
        StructField("review_id", STRING, nullable=False),
        StructField("user_id", STRING),
        StructField("business_id", STRING),
        StructField("stars", DOUBLE),
        StructField("useful", LONG),
        StructField("funny", LONG),
        StructField("cool", LONG),
        StructField("text", STRING),
        StructField("date", STRING),
    ]),
    "user": StructType([
        StructField("user_id", STRING, nullable=False),
        StructField("name", STRING),
        StructField("review_count", LONG),
        StructField("yelping_since", STRING),
        StructField("friends", STRING),
        StructField("useful", LONG),
        StructField("funny", LONG),
        StructField("cool", LONG),
        StructField("fans", LONG),
        StructField("elite", STRING),
        StructField("average_stars", DOUBLE),
        StructField("compliment_hot", LONG),
        StructField("compliment_more", LONG),
        StructField("compliment_profile", LONG),
        StructField("compliment_cute", LONG),
        StructField("compliment_list", LONG),
        StructField("compliment_note", LONG),
        StructField("compliment_plain", LONG),
        StructField("compliment_cool", LONG),
        StructField("compliment_funny", LONG),
        StructField("compliment_writer", LONG),
        StructField("compliment_photos", LONG),
    ]),
    "checkin": StructType([
        StructField("business_id", STRING, nullable=False),
        StructField("date", STRING),
    ]),
    "tip": StructType([
        StructField("user_id", STRING),
        StructField("business_id", STRING),
        StructField("text", STRING),
        StructField("date", STRING),
        StructField("compliment_count", LONG),
    ]),
}

# The id a record cannot do without, where it has one.
PRIMARY_ID = {"business": "business_id", "review": "review_id", "user": "user_id", "checkin": "business_id", "tip": None}

# Fields of a review event.
EVENT_SCHEMA = StructType([
    StructField("review_id", STRING),
    StructField("business_id", STRING),
    StructField("user_id", STRING),
    StructField("text", STRING),
    StructField("stars", DOUBLE),
    StructField("produced_at_ms", DOUBLE),
])
