"""The catalog's row, its enumerations and defaults."""

from __future__ import annotations

from pyspark.sql import types as T

# Names and order of the enumerations, the default transitions and thresholds.
STATES = ("Pending", "Stored", "Indexed", "Audited", "Available", "Archived", "Expired", "Deleted", "Purged")
TRIGGERS = ("Put", "Index", "Audit", "Publish", "Archive", "Restore", "Expire", "Delete", "Purge")
TIERS = ("Hot", "Warm", "Cold", "Archive")
TRANSITIONS = (
    ("Put", "Pending", "Stored"),
    ("Index", "Stored", "Indexed"),
    ("Audit", "Indexed", "Audited"),
    ("Publish", "Audited", "Available"),
    ("Archive", "Available", "Archived"),
    ("Restore", "Archived", "Available"),
    ("Expire", "Available", "Expired"),
    ("Delete", "Available", "Deleted"),
    ("Delete", "Archived", "Deleted"),
    ("Purge", "Deleted", "Purged"),
    ("Purge", "Expired", "Purged"),
)
THRESHOLDS = {"Warning": 0.70, "Critical": 0.85, "Full": 0.95}
DEFAULT_NAMESPACE = "default"

#: An attribute keeps its kind: string, bool, long or double; one member holds the value.
ATTRIBUTE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("s", T.StringType()),
        T.StructField("b", T.BooleanType()),
        T.StructField("l", T.LongType()),
        T.StructField("d", T.DoubleType()),
    ]
)
ENTRY = T.StructType(
    [
        T.StructField("content_hash", T.StringType(), False),
        T.StructField("namespace_id", T.StringType(), False),
        T.StructField("object_key", T.StringType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("attributes", T.MapType(T.StringType(), ATTRIBUTE)),
        T.StructField("tier", T.StringType(), False),
        T.StructField("size_bytes", T.LongType(), False),
        T.StructField("content_type", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType(), False),
        T.StructField("modified_at", T.TimestampNTZType(), False),
        T.StructField("state", T.StringType(), False),
    ]
)
