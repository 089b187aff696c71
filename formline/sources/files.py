"""Readers: drifting season CSVs, nested JSON, and the tables built from them."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from formline.operators.clean import conform, first_rows


def header_groups(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """The files under the paths by their header line; files without a line are left out.

    One job reads them as text and keeps the first line of each, and the driver gets a line and a name a file.
    """
    text = spark.read.option("recursiveFileLookup", "true").text(list(paths))
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("i"))
    firsts = rows.where("start = 0").groupBy("file").agg(F.min_by("value", "i").alias("header"))  # a task reads a file's lines in order
    groups: dict[str, list[str]] = {}
    for r in firsts.orderBy("file").collect():
        groups.setdefault(r.header, []).append(r.file)
    return groups


def _plain(path: str) -> str:
    """A path without its scheme and trailing slashes, percent signs decoded."""
    return re.sub(r"^[a-z0-9]+:/*", "/", unquote(path)).rstrip("/")


def season_csvs(spark: SparkSession, paths: Mapping[str, str], schema: StructType, renames: Mapping[str, str] = {}) -> DataFrame:
    """One frame over seasons whose files differ in columns, conformed, with the ``season`` of each row; a path is a file or a folder.

    Files are grouped by their header line and each group is read by one scan, so the plan grows with the number of
    different headers, not of files.  Without any file that has a header the frame is empty.
    """
    roots = {_plain(p): s for s, p in paths.items()}
    frames = []
    for files in header_groups(spark, list(paths.values())).values():
        seasons = []
        for f in files:
            at = _plain(f)
            while at not in roots and "/" in at:
                at = at.rsplit("/", 1)[0]
            seasons.append((f, roots[at]))
        names = spark.createDataFrame(seasons, "_file string, season string")
        rows = spark.read.csv([unquote(f) for f in files], header=True).withColumn("_file", F.col("_metadata.file_path"))
        frames.append(conform(rows.join(F.broadcast(names), "_file"), StructType([*schema.fields, StructField("season", StringType())]), renames))  # one row a file
    if not frames:
        return spark.createDataFrame([], StructType([*schema.fields, StructField("season", StringType())]))
    return reduce(lambda a, b: a.unionByName(b), frames)


def nested_rows(df: DataFrame, array: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per element of an array of structs, its fields beside the kept columns."""
    return df.select(*keep, F.explode(array).alias("_e")).select(*keep, "_e.*")


def json_table(spark: SparkSession, path: str, schema: StructType | str, array: str, keep: Sequence[str] = (), lines: bool = False) -> DataFrame:
    """Rows of a nested array in JSON files: one document a file, or one a line."""
    return nested_rows(spark.read.json(path, schema=schema, multiLine=not lines), array, keep)


def match_rows(matches: DataFrame, leagues: DataFrame, first_season: int = 2018) -> DataFrame:
    """(uid, match_id, season, home, away, league, ...): seasons from ``first_season`` on, the last row of a match wins,
    the league is the home team's, else the away team's, else 'unknown'."""
    kept = first_rows(matches.where(F.col("season") >= first_season), ["uid", "match_id"], ["seq"], last=True)
    home, away = (leagues.select(F.col("team").alias(c), F.col("league").alias(f"_{c}")) for c in ("home", "away"))
    return kept.join(home, "home", "left").join(away, "away", "left").withColumn("league", F.coalesce("_home", "_away", F.lit("unknown"))).drop("_home", "_away")


def team_leagues(players: DataFrame, teams: str = "team_title", league: str = "league", seq: str = "seq") -> DataFrame:
    """(team, league) from comma-separated team lists; the latest in ``seq`` wins."""
    one = players.select(F.explode(F.split(teams, ",")).alias("team"), league, seq)
    return one.groupBy(F.trim("team").alias("team")).agg(F.max_by(league, seq).alias("league"))


def with_known_season(df: DataFrame, seasons: DataFrame, name: str = "season_name") -> tuple[DataFrame, DataFrame]:
    """(rows with their season id, rows of seasons nobody knows)."""
    return df.join(seasons.select(F.col("name").alias(name), F.col("id").alias("season_id")), name), df.join(seasons.select(F.col("name").alias(name)), name, "left_anti")


def rating_history(df: DataFrame, cut: str) -> DataFrame:
    """Rating intervals that end at or after the cut, dates parsed leniently."""
    d = lambda c: F.expr(f"try_cast({c} as date)")
    return df.withColumns({"valid_from": d("valid_from"), "valid_to": d("valid_to")}).where(F.col("valid_to") >= F.lit(cut).cast("date"))
