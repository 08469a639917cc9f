"""What the files of a separated recording hold, told from their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of a name that tell what a stem holds, the first kind that fits counting; between words stands anything but letters and digits.
NO_VOCALS = r"(^|_)(no|non|without)_vocals?(_|$)|no_vocal"
KINDS = {"accompaniment": ["instrumental", "accompaniment", "karaoke", "music", "inst"], "vocals": ["vocals", "vocal", "voice", "acapella", "acappella"], "drums": ["drum", "drums", "percussion"], "bass": ["bass"], "other": ["other", "others"]}


def stem_kind(path: Column) -> Column:
    """Accompaniment, vocals, drums, bass or other by the words of a file's name without folder and ending; null if none tells."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    words = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_|_$", "")
    said = F.split(words, "_")
    kind = F.when(words.rlike(NO_VOCALS), "accompaniment")
    for k, names in KINDS.items():
        kind = kind.when(F.arrays_overlap(said, F.array(*map(F.lit, names))), k)
    return kind


def stem_map(files: DataFrame, key: str) -> DataFrame:
    """For each key and kind the first path by name; where one of just two files holds the vocals and none the accompaniment, the other is that too.

    files: key, path. One aggregation of a row for each kind, so no list of files is gathered.
    """
    told = files.where("path IS NOT NULL").select(key, "path", stem_kind(F.col("path")).alias("kind"))
    first = {k: F.min(F.when(F.col("kind") == k, F.col("path"))).alias(f"__{k}") for k in KINDS}
    g = told.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.min("path").alias("__first"), F.max("path").alias("__last"), *first.values())
    rest = F.when((F.col("__n") == 2) & F.col("__vocals").isNotNull() & (F.col("__first") != F.col("__last")), F.when(F.col("__first") == F.col("__vocals"), F.col("__last")).otherwise(F.col("__first")))
    g = g.withColumn("__accompaniment", F.coalesce("__accompaniment", rest))
    return g.select(key, F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"__{k}").alias("path")) for k in KINDS))).alias("x")).select(key, "x.*").where("path IS NOT NULL")
