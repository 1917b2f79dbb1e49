"""Protocol builders: sources to splits, windows, manifests and locks, as batch jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.errors import AuditError
from ..operators import digests, sets, validate
from ..operators import intervals as iv
from ..operators import windows as wn


@dataclass(frozen=True)
class ProtocolSettings:
    window: int = 512
    validation_fraction: float = 0.2
    seed: int = 41
    longest_event: int | None = None
    calibration_groups: int = 1
    least_normal: int = 8

    def __post_init__(self):
        if self.window < 32 or not 0 < self.validation_fraction < 1 or self.calibration_groups < 0:
            raise AuditError("protocol settings out of range")


def with_groups(sources: DataFrame) -> DataFrame:
    """Sources (file_name, signal, labels, training_end, ...) with prefix_digest, source_group_id (equal prefixes are one
    group), n_samples and prefix_positive."""
    rows = digests.prefix_digests(sources, "signal", "training_end")
    positive = F.size(F.filter(F.slice("labels", 1, F.col("training_end").cast("int")), lambda x: x > 0))
    return rows.withColumn("source_group_id", F.substring("prefix_digest", 1, 16)).withColumn("n_samples", F.size("signal").cast("long")).withColumn("prefix_positive", positive)


def source_samples(sources: DataFrame) -> DataFrame:
    return wn.unpack(sources, ["file_name"], ["signal", "labels"], "t").select("file_name", F.col("t").cast("long").alias("t"), F.col("signal").alias("value"), (F.col("labels") > 0).alias("label"))


def source_events(sources: DataFrame) -> DataFrame:
    """(file_name, event_index, start, end) of labelled events."""
    return iv.numbered(iv.islands(source_samples(sources), ["file_name"], F.col("label")), ["file_name"])


def cut_windows(sources: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    """starts (file_name, window_start, ...) with signal and labels of the window, cut from the packed series."""
    both = starts.join(sources.select("file_name", F.col("signal").alias("__s"), F.col("labels").alias("__l")), "file_name")
    at = (F.col("window_start") + 1).cast("int")
    return both.withColumn("signal", F.slice("__s", at, length)).withColumn("labels", F.slice("__l", at, length)).drop("__s", "__l")


def primary_protocol(sources: DataFrame, evaluation: DataFrame, tuning: DataFrame, settings: ProtocolSettings) -> tuple[DataFrame, DataFrame]:
    """(windows, manifest): group-level splits, an event window for each event, a normal window for each group.

    Refused if a declared normal prefix holds a positive label or a group falls into two splits.
    """
    rows = validate.official_split(with_groups(sources), evaluation, tuning)
    validate.require_empty(rows.where("prefix_positive > 0").select("file_name"), "positive label in a normal prefix")
    split = sets.assign_splits(rows, settings.validation_fraction, settings.seed)
    placed = rows.join(split, "source_group_id")
    validate.require_empty(sets.split_overlaps(placed, "source_group_id", "split"), "group in two splits")
    sizes = placed.select("file_name", F.col("n_samples").alias("n"))
    events = wn.event_windows(source_events(sources), sizes, ["file_name"], settings.window, settings.longest_event)
    about = events.select("file_name", F.lit("event").alias("kind"), "event_index", "window_start")
    normal = wn.normal_prefix_windows(placed, "source_group_id", "file_name", "prefix_digest", "training_end", settings.window)
    about = about.unionByName(normal.select("file_name", F.lit("normal").alias("kind"), F.lit(None).cast("int").alias("event_index"), "window_start"))
    windows = cut_windows(placed, about, settings.window).join(placed.select("file_name", "source_group_id", "split"), "file_name")
    windows = windows.withColumn("window_id", F.concat_ws(":", "file_name", "kind", F.coalesce("event_index", F.lit(-1))))
    manifest = source_manifest(placed, source_events(sources), settings.longest_event)
    return windows, manifest


def source_manifest(sources: DataFrame, events: DataFrame, longest: int | None) -> DataFrame:
    """A row for each file with its events and how many are eligible or excluded."""
    limit = 2**62 if longest is None else longest
    long = F.count_if(F.col("end") - F.col("start") > limit)
    per = events.groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("events"), (F.count("*") - long).alias("eligible_events"), long.alias("excluded_events"))
    keep = [c for c in ("file_name", "source_group_id", "split", "official_split", "domain_key", "n_samples", "prefix_digest") if c in sources.columns]
    return sources.select(*keep).join(per, "file_name", "left").na.fill(0, ["eligible_events", "excluded_events"])


def confirmation_protocol(sources: DataFrame, prior: DataFrame, settings: ProtocolSettings) -> dict[str, DataFrame]:
    """sources with domain_key and official_split -> windows, groups with their partition, exclusions and a summary.

    Groups are quarantined by rule; the first calibration_groups of each domain by hash calibrate, the others
    confirm; calibration gives normal windows only. Partitions never share a group.
    """
    rows = with_groups(sources)
    verdict = validate.quarantine(rows, prior, settings.window)
    domains = rows.select("source_group_id", "domain_key").distinct()
    usable = verdict.where("reason is null").select("source_group_id").join(domains, "source_group_id")
    calibrate = sets.top_by_hash(usable, "source_group_id", settings.calibration_groups, settings.seed, ["domain_key"]).select("domain_key", "source_group_id", F.lit("calibration").alias("partition"))
    confirm = sets.except_keys(usable, calibrate, ["domain_key", "source_group_id"]).withColumn("partition", F.lit("confirmation"))
    groups = calibrate.unionByName(confirm.select("domain_key", "source_group_id", "partition"))
    sets.require_disjoint(groups.where("partition = 'calibration'"), groups.where("partition = 'confirmation'"), ["source_group_id"], "partitions")
    placed = rows.join(groups, ["domain_key", "source_group_id"])
    sizes = placed.select("file_name", F.col("n_samples").alias("n"))
    events = source_events(placed.where("partition = 'confirmation'"))
    kept = events if settings.longest_event is None else validate.split_by_length(events, settings.longest_event)[0]
    event_w = wn.event_windows(kept, sizes, ["file_name"], settings.window).select("file_name", F.lit("event").alias("kind"), "event_index", "window_start")
    normal = wn.normal_prefix_windows(placed, "source_group_id", "file_name", "prefix_digest", "training_end", settings.window).select("file_name", F.lit("normal").alias("kind"), F.lit(None).cast("int").alias("event_index"), "window_start")
    windows = cut_windows(placed, event_w.unionByName(normal), settings.window).join(placed.select("file_name", "domain_key", "source_group_id", "partition"), "file_name")
    exclusions = verdict.where("reason is not null").select("source_group_id", "reason", "members")
    if settings.longest_event is not None:
        long = validate.split_by_length(events, settings.longest_event)[1]
        exclusions = exclusions.unionByName(long.select("file_name", "reason").join(placed.select("file_name", "source_group_id"), "file_name").select("source_group_id", "reason", F.array("file_name").alias("members")))
    summary = windows.rollup("domain_key").agg(F.count("*").alias("windows"), F.count_distinct("source_group_id").alias("groups"), F.count_if(F.col("kind") == "event").alias("event_windows"))
    return {"windows": windows, "groups": groups, "exclusions": exclusions, "summary": summary}


def lock(tables: dict[str, DataFrame]) -> dict[str, str]:
    """The digest of each table of a protocol."""
    return {name: digests.table_digest(df).first()["digest"] for name, df in sorted(tables.items())}


def verify_lock(tables: dict[str, DataFrame], expected: dict[str, str]) -> None:
    found = lock(tables)
    if found != expected:
        raise AuditError(f"protocol differs from its lock in {sorted(k for k in found.keys() | expected.keys() if found.get(k) != expected.get(k))}")


