"""Stored versions of documents: names, lists, picks, time travel, retention, conflicts.

A file may have a large share of all versions, so groups by file are always reduced (latest,
count, first n) before anything is gathered, and running values go through time buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.ranking import attach, cap, match, running, top_n

# Form of a version file name, and of the time in it.
VERSION_NAME = r"^(\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}-\d{3}Z)-(.+)$"
TOKEN_PARTS = r"^(\d{4}-\d{2}-\d{2})T(\d{2})-(\d{2})-(\d{2})-(\d{3})Z$"


def token_time(token: Column) -> Column:
    """UTC time of a version token."""
    iso = F.regexp_replace(token, TOKEN_PARTS, "$1T$2:$3:$4.$5")
    return iso.try_cast("timestamp_ntz")


def shown_time(token: Column) -> Column:
    """Seoul time of a version token; a token that is no time is shown as it is."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Seoul"), token_time(token))
    return F.coalesce(F.date_format(local, "yyyy. MM. dd. HH:mm:ss"), token)


def parse_version_name(files: DataFrame) -> DataFrame:
    """Adds ``token``, ``base_name``, ``ts`` (UTC) and ``shown``; other file names are skipped."""
    token = F.regexp_extract("filename", VERSION_NAME, 1)
    return (
        files.filter(F.col("filename").rlike(VERSION_NAME))
        .withColumns({"token": token, "base_name": F.regexp_extract("filename", VERSION_NAME, 2)})
        .withColumns({"ts": token_time(F.col("token")), "shown": shown_time(F.col("token"))})
    )


def _newest() -> list[Column]:
    return [F.desc("mtime"), F.desc("token")]


def _newest_buckets() -> dict[str, Column]:
    """Days and minutes backwards; a version without a time comes last."""
    back = F.coalesce(-F.unix_micros(F.col("mtime").cast("timestamp")), F.lit((1 << 63) - 1))
    minute = 60_000_000
    return {"_day": F.floor(back / (1440 * minute)), "_minute": F.floor(back / minute)}


def list_versions(versions: DataFrame, path: str | None = None, k: int | None = None) -> DataFrame:
    """Versions of one file, or of all files together, newest first, with the true total.

    With ``k`` only the first ``k``. Without, ranks are counted per day and minute and carried over,
    so the versions never meet in one task.
    """
    if path is not None:
        versions = versions.filter(F.col("base_name") == path.rsplit("/", 1)[-1])
    if k is None:
        return cap(versions, [], _newest(), None, _newest_buckets())
    top = top_n(versions, [], _newest(), k)
    # The total travels as one more row, so k + 1 rows meet in the last step.
    total = versions.agg(F.count("*").alias("total")).withColumn("rank", F.lit(0))
    both = top.unionByName(total, allowMissingColumns=True).withColumn(
        "total", F.max("total").over(Window.partitionBy())
    )
    return both.filter("rank > 0").withColumn("truncated", F.col("total") > k)


def versions_per_file(versions: DataFrame, k: int | None = None) -> DataFrame:
    """Versions of every file, newest first, with the true total of each."""
    return cap(versions, ["base_name"], _newest(), k, _newest_buckets())


def pick_version(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """The version each request means: exact name, else the newest that ends so, else the newest.

    ``versions``: filename, full_path, base_name, token, mtime;
    ``requests``: request_id, base_name, requested (null or blank = newest).
    """
    asked = requests.withColumn("requested", F.nullif(F.trim("requested"), F.lit("")))
    newest = F.max(F.struct("mtime", "token", "filename"))
    exact = versions.select("base_name", F.col("filename").alias("requested"), F.lit(True).alias("_exact"))
    # Candidates are cut to the suffix lengths asked for, so that the match is an equi-join on
    # rows reduced to one per distinct suffix.
    lengths = asked.filter("requested IS NOT NULL").select(
        "base_name", F.length("requested").alias("_n")
    ).distinct()
    suffixes = (
        versions.join(lengths, "base_name")
        .withColumn("requested", F.expr("right(full_path, _n)"))
        .groupBy("base_name", "requested")
        .agg(newest.alias("s"), F.count("*").alias("s_count"))
    )
    latest = versions.groupBy("base_name").agg(newest.alias("l"), F.count("*").alias("l_count"))
    named = asked.join(exact, ["base_name", "requested"], "left").join(
        suffixes, ["base_name", "requested"], "left"
    )
    joined = attach(named, latest, ["base_name"], "left")
    by_suffix = F.col("_exact").isNull() & F.col("s").isNotNull()
    by_age = F.col("requested").isNull() & F.col("l").isNotNull()
    return joined.select(
        "request_id",
        "base_name",
        F.when(F.col("_exact"), F.col("requested"))
        .when(by_suffix, F.col("s.filename"))
        .when(by_age, F.col("l.filename"))
        .alias("filename"),
        F.when(F.col("_exact"), "exact")
        .when(by_suffix, "suffix")
        .when(by_age, "newest")
        .otherwise("not_found")
        .alias("picked_by"),
        (by_suffix & (F.col("s_count") > 1)).alias("ambiguous"),
        (by_age & (F.col("l_count") > 1)).alias("auto_selected"),
    )


def time_buckets(time: str) -> dict[str, Column]:
    """Days and minutes: a busy file is spread over minutes, its days over one small window."""
    return {"_day": F.date_trunc("day", time), "_minute": F.date_trunc("minute", time)}


def pick_as_of(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """Newest version at or before each request's time.

    ``versions``: filename, base_name, token, mtime; ``requests``: request_id, base_name, as_of.
    Versions and requests are merged in time order per (file, time bucket); the newest version
    before the bucket is carried in.
    """
    v = versions.select(
        "base_name",
        F.col("mtime").alias("at"),
        F.lit(0).alias("_kind"),
        F.lit(None).cast("bigint").alias("request_id"),
        F.struct("mtime", "token", "filename").alias("v"),
    )
    r = requests.select(
        "base_name",
        F.col("as_of").alias("at"),
        F.lit(1).alias("_kind"),
        F.col("request_id").cast("bigint").alias("request_id"),
        F.lit(None).cast(v.schema["v"].dataType).alias("v"),
    )
    merged = running(
        v.unionByName(r),
        ["base_name"],
        ["at", "_kind"],
        time_buckets("at"),
        maxes={"newest": F.col("v")},
    )
    return merged.filter("_kind = 1").select(
        "request_id", "base_name", F.col("at").alias("as_of"), F.col("newest.filename").alias("filename")
    )


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]+$", "")


def timeline(versions: DataFrame, sidecars: DataFrame, folder: str, k: int | None = None) -> DataFrame:
    """Versions, or the newest ``k``, whose recorded source lies in ``folder``; unrecorded ones are left out.

    ``sidecars``: filename, source_path, summary.
    """
    here = sidecars.filter(folder_of(F.col("source_path")) == folder).select("filename", "summary")
    found = versions.join(here, "filename")
    return found if k is None else found.orderBy(*_newest()).limit(k)


def timelines(versions: DataFrame, sidecars: DataFrame, k: int | None = None) -> DataFrame:
    """The timeline of every folder at once."""
    placed = sidecars.filter("source_path IS NOT NULL").select(
        "filename", "summary", folder_of(F.col("source_path")).alias("folder")
    )
    return cap(versions.join(placed, "filename"), ["folder"], _newest(), k, _newest_buckets())


def retention(versions: DataFrame, now: Column, max_age_days: int = 30) -> DataFrame:
    """Marks versions strictly older than the cutoff."""
    cutoff = now - F.expr(f"interval {int(max_age_days)} days")
    return versions.withColumn("expired", F.col("mtime") < cutoff)


def retention_counts(marked: DataFrame) -> DataFrame:
    """A version without a time is kept."""
    gone = F.coalesce("expired", F.lit(False))
    return marked.agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept"))


def sidecar_deletions(marked: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Metadata that goes with the expired versions."""
    return sidecars.join(marked.filter("expired").select("filename"), "filename", "left_semi")


def assign_version_ts(new: DataFrame, taken: DataFrame, bucket_ms: int = 10_000) -> DataFrame:
    """A millisecond of its own for every new version of a name, the next free one if taken.

    ``new``: name, seq, ms, served in order of (ms, seq); ``taken``: name, ms. Slots are counted in
    free slots: a version wants the first free slot at or after its time, gets at least one more
    than the version before it, and the result is counted back to milliseconds.
    """

    def buckets(slot: str) -> dict[str, Column]:
        return {
            "_coarse": F.floor(F.col(slot) / (bucket_ms * 1000)),
            "_fine": F.floor(F.col(slot) / bucket_ms),
        }

    used = taken.select("name", "ms").distinct()
    rows = used.select("name", "ms", F.lit(0).alias("_new"), F.lit(None).cast("bigint").alias("seq"))
    asks = new.select("name", "ms", F.lit(1).alias("_new"), F.col("seq").cast("bigint").alias("seq"))
    # A taken slot at the wanted time is not before it: new rows come first at equal times.
    counted = running(
        rows.unionByName(asks).withColumn("_first", 1 - F.col("_new")),
        ["name"],
        ["ms", "_first", "seq"],
        buckets("ms"),
        sums={"_taken": 1 - F.col("_new"), "_rank": F.col("_new")},
    )
    wants = counted.filter("_new = 1").withColumn("_want", F.col("ms") - F.col("_taken"))
    placed = running(
        wants,
        ["name"],
        ["ms", "seq"],
        buckets("ms"),
        maxes={"_base": F.col("_want") - F.col("_rank")},
    ).withColumn("_slot", F.col("_base") + F.col("_rank"))
    # A taken slot t with j taken before it has t - j free slots before it.
    walls = counted.filter("_new = 0").select(
        "name",
        (F.col("ms") - F.col("_taken") + 1).alias("_slot"),
        F.lit(0).alias("_new"),
        F.lit(None).cast("bigint").alias("seq"),
        F.col("ms"),
    )
    back = running(
        walls.unionByName(placed.select("name", "_slot", "_new", "seq", "ms")),
        ["name"],
        ["_slot", "_new", "ms"],
        buckets("_slot"),
        sums={"_walls": 1 - F.col("_new")},
    )
    return back.filter("_new = 1").select(
        "name", "seq", "ms", (F.col("_slot") + F.col("_walls")).cast("bigint").alias("assigned_ms")
    )


def lost_updates(proposals: DataFrame, files: DataFrame) -> DataFrame:
    """Proposals whose source or distinct target changed after they were made.

    ``proposals``: id, source_path, source_ms, target_path, target_ms; ``files``: path, ms.
    A baseline that is null is not checked; a difference of up to 1 ms is none.
    """
    now = lambda side: files.select(
        F.col("path").alias(f"{side}_path"), F.col("ms").alias(f"_{side}_now")
    )
    joined = proposals.join(now("source"), "source_path", "left").join(
        now("target"), "target_path", "left"
    )

    def conflict(side: str) -> Column:
        gone = F.col(f"_{side}_now").isNull()
        moved = F.abs(F.col(f"_{side}_now") - F.col(f"{side}_ms")) > 1
        return F.col(f"{side}_ms").isNotNull() & F.col("source_path").isNotNull() & (gone | moved)

    distinct_target = F.col("source_path").isNotNull() & (F.col("target_path") != F.col("source_path"))
    return joined.select(
        "id",
        F.when(conflict("source"), F.when(F.col("_source_now").isNull(), "source_missing").otherwise("source_changed"))
        .when(
            distinct_target & conflict("target"),
            F.when(F.col("_target_now").isNull(), "target_missing").otherwise("target_changed"),
        )
        .otherwise("ok")
        .alias("status"),
    )


def restore_results(current: DataFrame, picks: DataFrame, versions: DataFrame) -> DataFrame:
    """Rows of (path, filename, status), one per different pick.

    status: ok, unknown_path, unknown_version, or chosen_twice where a path is asked to become several
    versions; none of these is restored then.
    """
    asked = picks.select("path", "filename").distinct()
    many = asked.groupBy("path").agg((F.count("*") > 1).alias("_many"))
    paths = current.select("path", F.lit(True).alias("_path")).distinct()
    names = versions.select("filename", F.lit(True).alias("_version")).distinct()
    found = match(match(match(asked, many, ["path"]), paths, ["path"], "left"), names, ["filename"], "left")
    return found.select(
        "path",
        "filename",
        F.when(F.col("_many"), "chosen_twice")
        .when(F.col("_path").isNull(), "unknown_path")
        .when(F.col("_version").isNull(), "unknown_version")
        .otherwise("ok")
        .alias("status"),
    )


def restore(current: DataFrame, picks: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen versions become current; what they replace is added to the versions.

    ``current``: path, content; ``picks``: path, filename; ``versions``: filename, content.
    Returns (current after, new versions: path, content). A path with several different picks stays
    as it is; ``restore_results`` says what became of each pick.
    """
    asked = picks.groupBy("path").agg(F.min("filename").alias("filename"), F.max("filename").alias("_last")).filter("filename = _last")
    chosen = asked.join(
        versions.select("filename", F.struct("content").alias("_restored")), "filename"
    ).select("path", "_restored")
    joined = current.join(chosen, "path", "left")
    found = F.col("_restored").isNotNull()
    after = joined.select("path", F.when(found, F.col("_restored.content")).otherwise(F.col("content")).alias("content"))
    saved = joined.filter(found).select("path", "content")
    return after, saved


def previous_versions(versions: DataFrame) -> DataFrame:
    """Each version beside the one before it of the same file."""
    out = running(
        versions,
        ["base_name"],
        ["mtime", "token"],
        time_buckets("mtime"),
        maxes={"_prev": F.struct("mtime", "token", "filename")},
        inclusive=False,
    )
    return out.withColumn("previous", F.col("_prev.filename")).drop("_prev")
