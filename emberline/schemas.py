"""Schemas of the archive files and of the tables derived from them."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names and types of the post archive.
COMMENT = T.StructType([
    T.StructField("author", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("created_utc", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("link_id", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("subreddit_id", T.StringType()),
    T.StructField("parent_id", T.StringType()),
])
SUBMISSION = T.StructType([
    T.StructField("author", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("selftext", T.StringType()),
    T.StructField("created_utc", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("subreddit_id", T.StringType()),
])
POST_COLUMNS = COMMENT.fieldNames()

# Archive folder of each kind of post.
KIND_FOLDER = {"RC": "comments", "RS": "submissions"}

# Position of the used columns among the 27 columns of a news file.
NEWS_WIDTH = 27
NEWS_POSITIONS = {
    "DATE": 1,
    "SourceCommonName": 3,
    "DocumentIdentifier": 4,
    "Themes": 7,
    "V2Themes": 8,
    "V2Locations": 10,
}
NEWS_COLUMNS = list(NEWS_POSITIONS)

# Names of classes, attributes, feature groups and periods.
CLASSES = ["activism", "action", "discussion", "skeptic"]
ATTRIBUTES = ["age", "gender", "partisan", "affluence"]
NEWS_CLASSES = ["climate", "climate_action", "natural_disaster"]
PERIODS = ["short", "medium", "long"]
CONTROL = [
    "avg_comments_per_thread",
    "n_submissions_author_week",
    "n_active_days_author_week",
    "n_comments_author_week",
    "n_different_subreddits",
]
NORM_NEWS = ["norm_climate", "norm_climate_action", "norm_natural_disaster"]
QUARTILE_FLAGS = {
    "age": ("sociodemo_young", "sociodemo_old"),
    "gender": ("sociodemo_male", "sociodemo_female"),
    "partisan": ("sociodemo_left", "sociodemo_right"),
    "affluence": ("sociodemo_poor", "sociodemo_rich"),
}

# The four ways two posts can meet: (key of the active post, key of the other post).
PAIRINGS = {
    "sibling": ("parent_id", "parent_id"),
    "thread": ("link_id", "link_id"),
    "replied_to_me": ("parent_id", "id"),
    "i_replied": ("id", "parent_id"),
}
INTERACTION = [f"n_{what}_{p}" for what in ("pairs", "active_authors") for p in PAIRINGS]
