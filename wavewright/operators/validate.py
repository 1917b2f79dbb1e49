"""Validation, predicates and parsing. Checks raise AuditError from one small aggregate; they never alter rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bad
from ..functions.errors import AuditError

#: Least samples of a series for each kind of use.
LEAST_SAMPLES = {"metric": 1, "series": 2, "signal": 8, "hybrid": 32}
#: Spellings of labels, in lower case.
FALSE_LABELS = ("", "0", "false", "normal", "no")
TRUE_LABELS = ("1", "true", "anomaly", "anomalous", "yes")


def series_report(df: DataFrame, keys: list[str], value: str = "value", label: str | None = None, order: str = "t") -> DataFrame:
    """(keys, n, n_bad, n_distinct_t, deviation, n_odd_labels): what the validators look at, in one aggregation."""
    odd = F.count_if(F.col(label).isNull() | ~F.col(label).cast("double").isin(0.0, 1.0)) if label else F.lit(0)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(bad(F.col(value))).alias("n_bad"), F.count_distinct(order).alias("n_distinct_t"), F.stddev_pop(value).alias("deviation"), odd.alias("n_odd_labels"))


def invalid_series(df: DataFrame, keys: list[str], kind: str = "series", value: str = "value", label: str | None = None, constant_ok: bool = True, order: str = "t") -> DataFrame:
    """Series that must be rejected, with the first reason."""
    r = series_report(df, keys, value, label, order)
    reason = (
        F.when(F.col("n") < LEAST_SAMPLES[kind], "too_short")
        .when(F.col("n_bad") > 0, "not_finite")
        .when(F.col("n_distinct_t") != F.col("n"), "duplicate_time")
        .when(F.col("n_odd_labels") > 0, "labels_not_binary")
    )
    if not constant_ok:
        reason = reason.when(F.col("deviation") < 1e-10, "constant")
    return r.withColumn("reason", reason).where("reason is not null")


def require_valid(df: DataFrame, keys: list[str], kind: str = "series", **options) -> DataFrame:
    """df, or AuditError naming one invalid series."""
    found = invalid_series(df, keys, kind, **options).first()
    if found is not None:
        raise AuditError(f"invalid series {[found[k] for k in keys]}: {found['reason']}")
    return df


def require_empty(df: DataFrame, what: str) -> None:
    found = df.first()
    if found is not None:
        raise AuditError(f"{what}: {found.asDict()}")


def require_schema(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df, or AuditError if a column is missing or of another type."""
    kinds = dict(df.dtypes)
    wrong = {c: kinds.get(c) for c, k in columns.items() if kinds.get(c) != k}
    if wrong:
        raise AuditError(f"schema differs: {wrong}")
    return df


def require_unique(df: DataFrame, keys: list[str], what: str = "keys") -> DataFrame:
    require_empty(df.groupBy(*keys).count().where("count > 1"), f"duplicate {what}")
    return df


def paired(left: DataFrame, right: DataFrame, keys: list[str], order: str = "t") -> DataFrame:
    """Equi-join on (keys, t); AuditError unless both sides have the same samples."""
    on = [*keys, order]
    require_empty(left.select(*on).exceptAll(right.select(*on)).union(right.select(*on).exceptAll(left.select(*on))), "unpaired sample")
    return left.join(right, on)


def crosses(score: Column, threshold: Column | float) -> Column:
    """Detection: at or above the threshold."""
    return score >= threshold


def parse_label(text: Column) -> Column:
    """Known spellings, else any number other than zero; null if it is neither."""
    low = F.lower(F.trim(text))
    return F.when(low.isin(*FALSE_LABELS), False).when(low.isin(*TRUE_LABELS), True).otherwise(text.try_cast("double") != 0)


def parse_time(text: Column, ordinal: Column) -> tuple[Column, Column]:
    """(number, raw): a whole number where the text is one, else null with the text kept; the ordinal if blank."""
    number, blank = text.try_cast("double"), F.coalesce(F.trim(text) == "", F.lit(True))
    whole = F.when(number == F.floor(number), number.cast("long"))
    return F.when(blank, ordinal.cast("long")).otherwise(whole), F.when(~blank & number.isNull(), text)


#: Fixed value: {number}_{collection}_id_{n}_{domain}_tr_{n}_1st_{n}.csv
FILE_NAME = r"^(\d+)_(.+)_id_(\d+)_(.+)_tr_(\d+)_1st_(\d+)\.csv$"


def parse_file_name(df: DataFrame, name: str = "file_name") -> DataFrame:
    """Fields of archive file names; names of another form are left out."""
    part = lambda i: F.regexp_extract(name, FILE_NAME, i)
    return df.where(F.col(name).rlike(FILE_NAME)).select(
        "*", part(1).alias("global_id"), part(2).alias("source_collection"), part(3).cast("int").alias("source_id"), part(4).alias("domain"),
        part(5).cast("long").alias("training_end"), part(6).cast("long").alias("first_anomaly"),
    )


def in_domain(sources: DataFrame, specs: DataFrame) -> DataFrame:
    """Sources with the domain_key of the spec of their collection and domain; a spec without a domain takes the
    whole collection. specs are few: (domain_key, source_collection, domain)."""
    s = specs.select("domain_key", F.col("source_collection").alias("__c"), F.col("domain").alias("__d"))
    return sources.join(s, (F.col("source_collection") == F.col("__c")) & (F.col("__d").isNull() | (F.col("domain") == F.col("__d")))).drop("__c", "__d")


def official_split(sources: DataFrame, evaluation: DataFrame, tuning: DataFrame, name: str = "file_name") -> DataFrame:
    """Sources with their official split: evaluation, tuning or unlisted."""
    listed = evaluation.select(name).distinct().withColumn("__e", F.lit(True))
    tuned = tuning.select(name).distinct().withColumn("__t", F.lit(True))
    split = F.when(F.col("__e"), "evaluation").when(F.col("__t"), "tuning").otherwise("unlisted")
    return sources.join(listed, name, "left").join(tuned, name, "left").withColumn("official_split", split).drop("__e", "__t")


def quarantine(sources: DataFrame, prior: DataFrame, window: int, group: str = "source_group_id") -> DataFrame:
    """(group, reason, members): reasons for which a group must not be used, joined by semicolons in a fixed order;
    null for usable groups.

    sources: group, file_name, official_split, prefix_positive, n_samples, training_end, prefix_digest.
    """
    seen = prior.select("prefix_digest").distinct().withColumn("__seen", F.lit(True))
    rows = sources.join(seen, "prefix_digest", "left")
    facts = rows.groupBy(group).agg(
        F.bool_or(F.col("official_split") != "evaluation").alias("a"), F.bool_or(F.col("prefix_positive") > 0).alias("b"),
        F.bool_or((F.col("n_samples") < window) | (F.col("training_end") < window)).alias("c"), F.bool_or(F.coalesce("__seen", F.lit(False))).alias("d"),
        F.array_sort(F.collect_set("file_name")).alias("members"),
    )
    names = {"a": "group_not_exclusively_official_evaluation", "b": "declared_normal_prefix_contains_positive_labels", "c": "insufficient_samples_for_fixed_window", "d": "exact_normal_prefix_seen_in_prior_protocol"}
    reason = F.concat_ws(";", *(F.when(F.col(c), n) for c, n in names.items()))
    return facts.select(group, F.when(reason != "", reason).alias("reason"), "members")


def split_by_length(events: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded with a reason) events by duration."""
    n = F.col("end") - F.col("start")
    return events.where(n <= longest), events.where(n > longest).withColumn("reason", F.lit("event_longer_than_limit"))


def eligibility(requests: DataFrame, certified: DataFrame) -> DataFrame:
    """Requests (request_id, origin, case_id, signal_digest, length) with (eligible, mode, reason): the first rule
    that fails decides. certified: (case_id, signal_digest, length) as ``known_digest`` and ``known_length``."""
    known = certified.select("case_id", F.col("signal_digest").alias("known_digest"), F.col("length").alias("known_length"))
    reason = (
        F.when(F.col("origin") == "upload", "uploaded_signal")
        .when(F.col("known_digest").isNull(), "case_not_certified")
        .when(F.col("signal_digest") != F.col("known_digest"), "signal_differs")
        .when(F.col("length") != F.col("known_length"), "length_differs")
    )
    out = requests.join(known, "case_id", "left").withColumn("reason", reason)
    return out.withColumn("eligible", F.col("reason").isNull()).withColumn("mode", F.when(F.col("reason").isNull(), "automatic").otherwise("review_only")).drop("known_digest", "known_length")


def safe_name(text: Column) -> Column:
    """Whether a case id is a plain name: no separators, no parent folders."""
    return text.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$") & ~text.contains("..")


def condition_row(conditions: DataFrame, family: str, severity: float, replicate: int, tolerance: float = 1e-7) -> DataFrame:
    """The one condition asked for; family none or severity 0 is the identity row. AuditError unless it is one."""
    if family == "none" or severity == 0:
        found = conditions.where("identity")
    else:
        found = conditions.where(~F.col("identity") & (F.col("family") == family) & (F.abs(F.col("severity") - severity) <= tolerance) & (F.col("replicate") == replicate))
    if found.limit(2).count() != 1:
        raise AuditError(f"no single condition ({family}, {severity}, {replicate})")
    return found


def require_thresholds(witnesses: DataFrame, records: DataFrame) -> DataFrame:
    """Witnesses with their frozen thresholds; AuditError if one has none for its model and warm-up."""
    on = ["domain", "witness_id", "model_sha256", "context_left"]
    require_empty(witnesses.join(records, on, "left_anti"), "witness without a frozen threshold")
    return witnesses.join(records, on)
