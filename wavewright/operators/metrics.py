"""Metrics as grouped aggregates. Zero denominators give 0 in the demo metrics and null in the published ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import in_order
from . import intervals as iv


def rmse(x: str, y: str) -> Column:
    return F.sqrt(F.avg(F.pow(F.col(x) - F.col(y), 2)))


def mae(x: str, y: str) -> Column:
    return F.avg(F.abs(F.col(x) - F.col(y)))


def snr_db(reference: str, candidate: str) -> Column:
    """10 log10 of signal over error power; +inf without error, tested before -inf without signal."""
    power, error = F.avg(F.pow(F.col(reference), 2)), F.avg(F.pow(F.col(reference) - F.col(candidate), 2))
    return F.when(error == 0, float("inf")).when(power == 0, float("-inf")).otherwise(10 * F.log10(power / error))


def with_differences(df: DataFrame, keys: list[str], columns: list[str], order: str = "t") -> DataFrame:
    """Columns d_<c>: the step from the sample before, null on the first."""
    w = in_order(keys, order)
    return df.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(w) for c in columns})


def signal_metrics(df: DataFrame, keys: list[str], reference: str, noisy: str, candidate: str, order: str = "t") -> DataFrame:
    """(keys, rmse, mae, derivative_rmse, snr_db, input_snr_db, snr_improvement_db) in one aggregation."""
    d = with_differences(df, keys, [reference, candidate], order)
    out = d.groupBy(*keys).agg(
        rmse(reference, candidate).alias("rmse"), mae(reference, candidate).alias("mae"), rmse(f"d_{reference}", f"d_{candidate}").alias("derivative_rmse"),
        snr_db(reference, candidate).alias("snr_db"), snr_db(reference, noisy).alias("input_snr_db"),
    )
    return out.withColumn("snr_improvement_db", F.col("snr_db") - F.col("input_snr_db"))


def event_hits(df: DataFrame, events: DataFrame, keys: list[str], flags: dict[str, Column], order: str = "t") -> DataFrame:
    """Events (keys, start, end) with, for each name, whether the flag holds anywhere inside. An event is looked up
    sample by sample through an equi-join, so its length and not the series bounds its share of the work."""
    points = events.select(*keys, "start", "end", F.explode(F.expr("sequence(start, end - 1)")).alias(order))
    marks = df.select(*keys, order, *(F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()))
    return points.join(marks, [*keys, order], "left").groupBy(*keys, "start", "end").agg(*(F.coalesce(F.bool_or(n), F.lit(False)).alias(n) for n in flags))


def own_events(df: DataFrame, keys: list[str], event: Column, flags: dict[str, Column], order: str = "t") -> DataFrame:
    """The runs of samples with ``event`` and, for each name, whether the flag holds anywhere inside: (keys, is_event,
    flags). What lies outside of runs is one more row of each key, so that keys without events stay. Runs are numbered
    by a window over the keys and gathered by the same keys: one scan and one shuffle, and no join."""
    rows = df.select(*keys, order, F.coalesce(event, F.lit(False)).alias("is_event"), *(F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()))
    seen = F.sum(F.col("is_event").cast("long")).over(in_order(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    run = F.when(F.col("is_event"), F.col(order) - seen).alias("__run")
    return rows.select(*keys, run, "is_event", *flags).groupBy(*keys, "__run", "is_event").agg(*(F.bool_or(n).alias(n) for n in flags)).drop("__run")


def all_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct()


def _ratio(top: Column, bottom: Column, none: float | None = None) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(none).cast("double"))


def event_recall(df: DataFrame, keys: list[str], label: Column, predicted: Column, order: str = "t") -> DataFrame:
    """(keys, event_recall): share of labelled events with a prediction inside; 0 without events."""
    found = own_events(df, keys, label, {"hit": predicted}, order).groupBy(*keys).agg(F.avg(F.when(F.col("is_event"), F.col("hit").cast("double"))).alias("event_recall"))
    return found.na.fill(0.0, ["event_recall"])


def erasure_rate(df: DataFrame, keys: list[str], label: Column, before: Column, after: Column, order: str = "t") -> DataFrame:
    """(keys, erasure): of labelled events hit before, the share not hit after; 0 if none was."""
    hit = F.col("is_event") & F.col("b")
    lost = _ratio(F.count_if(hit & ~F.col("a")), F.count_if(hit), 0.0)
    return own_events(df, keys, label, {"b": before, "a": after}, order).groupBy(*keys).agg(lost.alias("erasure"))


def false_event_rate(df: DataFrame, keys: list[str], label: Column, before: Column, after: Column, order: str = "t", none: float | None = 0.0) -> DataFrame:
    """(keys, false_event_rate): of events predicted after, the share that meets neither a label nor a prediction
    before."""
    rate = _ratio(F.count_if(F.col("is_event") & ~F.col("known")), F.count_if("is_event"), none)
    return own_events(df, keys, after, {"known": label | before}, order).groupBy(*keys).agg(rate.alias("false_event_rate"))


def average_precision(df: DataFrame, keys: list[str], truth: str, score: str) -> DataFrame:
    """(keys, ap): average precision with tied scores as one threshold and weighted truth. Samples are first summed
    by score, so ties and repeats shrink before the window."""
    by_score = df.groupBy(*keys, score).agg(F.sum(F.col(truth).cast("double")).alias("__p"), F.count("*").alias("__n"))
    w = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    curve = by_score.withColumn("__tp", F.sum("__p").over(w)).withColumn("__k", F.sum("__n").over(w))
    area = F.sum(F.col("__p") * F.col("__tp") / F.col("__k"))
    total = F.sum("__p")
    return curve.groupBy(*keys).agg(F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), area / total))).otherwise(0.0).alias("ap"))


def tolerance_steps(longest: int, steps: int) -> list[int]:
    """Rounded (half to even), distinct tolerances evenly spread over 0..longest."""
    count = min(steps, longest + 1)
    return sorted({round(longest * k / (count - 1)) if count > 1 else 0 for k in range(count)})


def vus_approximation(df: DataFrame, keys: list[str], label: str, score: str, longest: int, steps: int = 6, order: str = "t") -> DataFrame:
    """(keys, tolerance, ap) for each tolerance; vus is their mean."""
    parts = [iv.soft_labels(df, keys, F.col(label), tol, order).select(*keys, F.lit(tol).alias("tolerance"), "soft", score) for tol in tolerance_steps(longest, steps)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return average_precision(out, [*keys, "tolerance"], "soft", score)


def mean_over_tolerances(aps: DataFrame, keys: list[str]) -> DataFrame:
    return aps.groupBy(*keys).agg(F.avg("ap").alias("vus"))


def vus_pr(df: DataFrame, keys: list[str], label: str, score: str, max_buffer: int, thresholds: int = 250, order: str = "t") -> DataFrame:
    """(keys, vus_pr, n_buffers): range-aware area under precision and recall, averaged over buffers 0..max_buffer.

    Sums over thresholds are cumulative: each sample counts from the first threshold that it reaches, so the
    work is buffers x samples, never buffers x thresholds x samples. Keys without labels, or with labels only,
    give no row.
    """
    kb, kbt = [*keys, "__buffer"], [*keys, "__buffer", "__k"]
    down = Window.partitionBy(*keys).orderBy(F.desc("__s"), order)
    base = df.select(*keys, order, F.coalesce(F.col(label).cast("int"), F.lit(0)).alias("__l"), F.col(score).alias("__s"))
    ranked = base.withColumn("__r", F.row_number().over(down) - 1)
    sizes = base.groupBy(*keys).agg(F.count("*").alias("__n"), F.sum("__l").alias("__p")).where("__p > 0 and __p < __n")
    steps = sizes.select(*keys, "__n", "__p", F.explode(F.expr(f"sequence(0, {thresholds - 1})")).alias("__k"))
    steps = steps.withColumn("__r", F.floor(F.col("__k") * ((F.col("__n") - 1) / (thresholds - 1))).cast("int"))
    at = steps.join(ranked.select(*keys, "__r", "__s"), [*keys, "__r"]).select(*keys, "__k", "__s", "__p")
    # the first threshold, in descending order, that each sample reaches: the least one at or below its score
    levels = at.groupBy(*keys, "__s").agg(F.min("__k").alias("__k"))
    both = base.select(*keys, order, "__l", "__s").unionByName(levels, allowMissingColumns=True)
    below = F.min("__k").over(Window.partitionBy(*keys).orderBy(F.desc("__s")).rangeBetween(Window.currentRow, Window.unboundedFollowing))
    reach = both.withColumn("__k", below).where(F.col(order).isNotNull()).select(*keys, order, "__l", "__k")

    events = iv.islands(base, keys, F.col("__l") == 1, order)
    every = F.explode(F.expr(f"sequence(0, {max_buffer})")).alias("__buffer")
    samples = reach.join(sizes.select(*keys), keys).select(*keys, order, "__l", "__k", every)
    if max_buffer >= 2:
        near = iv.distances(events, keys, max_buffer // 2, order)
        near = near.withColumn("__buffer", F.explode(F.expr(f"sequence(2 * distance, {max_buffer})")))
        ramp = near.groupBy(*kb, order).agg(F.sum(F.sqrt(1.0 - F.col("distance") / F.col("__buffer"))).alias("__ramp"))
        samples = samples.join(ramp, [*kb, order], "left")
    else:
        samples = samples.withColumn("__ramp", F.lit(0.0))
    samples = samples.withColumn("__e", F.least(F.lit(1.0), F.col("__l") + F.coalesce("__ramp", F.lit(0.0))))
    mass = samples.groupBy(*kbt).agg(F.sum("__e").alias("__tp"), F.sum(F.when(F.col("__l") == 0, F.col("__e")).otherwise(0.0)).alias("__wide"), F.count("*").alias("__pred"))

    wide = events.select(*keys, "start", "end", every)
    half = F.expr("__buffer div 2")
    extents = iv.merge(wide.select(*kb, (F.col("start") - half).alias("start"), (F.col("end") + half).alias("end")), kb, gap=-1)
    points = extents.select(*kb, "start", F.explode(F.expr("sequence(start, end - 1)")).alias(order))
    met = points.join(reach.select(*keys, order, "__k"), [*keys, order]).groupBy(*kb, "start").agg(F.min("__k").alias("__k")).groupBy(*kbt).agg(F.count("*").alias("__hit"))
    counts = extents.groupBy(*kb).agg(F.count("*").alias("__events"))

    grid = at.select(*keys, "__k", "__p").join(counts, keys).join(mass, kbt, "left").join(met, kbt, "left").na.fill(0)
    upto = Window.partitionBy(*kb).orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    run = grid.select(*kbt, "__p", "__events", *(F.sum(c).over(upto).alias(c) for c in ("__tp", "__wide", "__pred", "__hit")))
    recall = F.least(F.lit(1.0), F.col("__tp") / ((2 * F.col("__p") + F.col("__wide")) / 2.0))
    run = run.withColumn("__tpr", recall * F.col("__hit") / F.col("__events"))
    step = F.col("__tpr") - F.coalesce(F.lag("__tpr").over(Window.partitionBy(*kb).orderBy("__k")), F.lit(0.0))
    areas = run.withColumn("__a", step * F.col("__tp") / F.col("__pred")).groupBy(*kb).agg(F.sum("__a").alias("__area"))
    return areas.groupBy(*keys).agg(F.avg("__area").alias("vus_pr"), F.count("*").alias("n_buffers"))


def event_decisions(df: DataFrame, keys: list[str], label: Column, reference: Column, observation: Column, candidate: Column, order: str = "t") -> DataFrame:
    """(keys, labelled_events, retained, reference_detectable, erased, observation_detectable, recovered,
    recovery_eligible, false_generated, predicted, retention, erasure, recovery, false_generation); null rates
    where nothing is eligible."""
    hits = own_events(df, keys, label, {"r": reference, "o": observation, "c": candidate}, order)
    r, o, c = (F.col("is_event") & F.col(x) for x in "roc")
    own = hits.groupBy(*keys).agg(
        F.count_if("is_event").alias("labelled_events"), F.count_if(r & c).alias("retained"), F.count_if(r).alias("reference_detectable"), F.count_if(o & ~c).alias("erased"),
        F.count_if(o).alias("observation_detectable"), F.count_if(r & ~o & c).alias("recovered"), F.count_if(r & ~o).alias("recovery_eligible"),
    )
    made = own_events(df, keys, candidate, {"known": label | observation}, order)
    made = made.groupBy(*keys).agg(F.count_if(F.col("is_event") & ~F.col("known")).alias("false_generated"), F.count_if("is_event").alias("predicted"))
    out = own.join(made, keys)
    rates = {"retention": ("retained", "reference_detectable"), "erasure": ("erased", "observation_detectable"), "recovery": ("recovered", "recovery_eligible"), "false_generation": ("false_generated", "predicted")}
    return out.withColumns({n: _ratio(F.col(a), F.col(b)) for n, (a, b) in rates.items()})


def median_event_length(df: DataFrame, keys: list[str], label: Column, order: str = "t") -> DataFrame:
    events = iv.islands(df, keys, label, order).withColumn("__n", F.col("end") - F.col("start"))
    return events.groupBy(*keys).agg(F.expr("percentile(__n, 0.5)").cast("int").alias("median_length"))


def os_nrmse(df: DataFrame, keys: list[str], reference: str, output: str, label: Column, scale: str = "scale") -> DataFrame:
    """(keys, os_nrmse, anomaly_os_nrmse, native_rmse): error over the observation's scale; null over no labels."""
    e = F.pow(F.col(output).cast("double") - F.col(reference), 2)
    native = F.sqrt(F.avg(e))
    return df.groupBy(*keys).agg((native / F.first(scale)).alias("os_nrmse"), (F.sqrt(F.avg(F.when(label, e))) / F.first(scale)).alias("anomaly_os_nrmse"), native.alias("native_rmse"))


def waveform_metrics(df: DataFrame, keys: list[str], reference: str, observation: str, output: str, label: Column, scale: str = "scale") -> DataFrame:
    """os_nrmse's columns with mean_abs_correction and finite."""
    ok = ~(F.col(output).isNull() | F.isnan(output) | (F.abs(F.col(output)) == float("inf")))
    more = df.groupBy(*keys).agg(F.avg(F.abs(F.col(output) - F.col(observation))).alias("mean_abs_correction"), F.bool_and(ok).alias("finite"))
    return os_nrmse(df, keys, reference, output, label, scale).join(more, keys)


def hierarchical_mean(df: DataFrame, levels: list[str], value: str, keep: list[str] | None = None) -> DataFrame:
    """Equal-weight means from the last level up: rows, then each level in turn: (keep, mean)."""
    keep = keep or []
    out = df.select(*keep, *levels, F.col(value).alias("mean"))
    for i in range(len(levels), -1, -1):
        out = out.groupBy(*keep, *levels[:i]).agg(F.avg("mean").alias("mean"))
    return out


def pooled_evidence(rows: DataFrame, by: str, kept: str, eligible: str, none_for: str | None = None) -> DataFrame:
    """Counts summed over all rows and the retained percentage; null where nothing is eligible and for the method
    that is the baseline."""
    out = rows.groupBy(by).agg(F.sum(kept).alias("retained"), F.sum(eligible).alias("eligible"))
    rate = F.when(F.col("eligible") > 0, 100.0 * F.col("retained") / F.col("eligible"))
    return out.withColumn("retained_percent", rate if none_for is None else F.when(F.col(by) != none_for, rate))


def detector_counts(df: DataFrame, keys: list[str], target: Column, observed: Column, output: Column, tolerance: int = 8, order: str = "t") -> DataFrame:
    """Counts of one detector on one condition (inferred semantics): whether the target event is detectable in the
    observation and in the output, whether it was erased, and the output's runs that do not meet the observation's
    runs widened by the tolerance: (keys, observation_detectable, output_detectable, erased, output_only)."""
    rows = iv.dilate(df.withColumn("__o", observed).withColumn("__p", output), keys, F.col("__o"), tolerance, "__w", order)
    own = rows.groupBy(*keys).agg(F.bool_or(target & F.col("__o")).alias("__od"), F.bool_or(target & F.col("__p")).alias("__pd"))
    runs = event_hits(rows, iv.islands(rows, keys, F.col("__p"), order), keys, {"near": F.col("__w")}, order)
    extra = runs.groupBy(*keys).agg(F.count_if(~F.col("near")).alias("output_only"))
    out = own.join(extra, keys, "left").na.fill(0, ["output_only"])
    o, p = F.coalesce("__od", F.lit(False)), F.coalesce("__pd", F.lit(False))
    return out.select(*keys, o.cast("int").alias("observation_detectable"), p.cast("int").alias("output_detectable"), (o & ~p).cast("int").alias("erased"), "output_only")


def intervention_cost(df: DataFrame, keys: list[str], observation: str, candidate: str, output: str, beta: str) -> DataFrame:
    o, c, y, b = (F.col(x).cast("double") for x in (observation, candidate, output, beta))
    whole, left = F.sum(F.pow(o - c, 2)), F.sum(F.pow(y - c, 2))
    energy = F.when(whole <= 2.220446049250313e-16, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), left / whole)))
    return df.groupBy(*keys).agg(
        F.avg((b > 0).cast("double")).alias("retained_sample_fraction"), energy.alias("retained_energy_fraction"), F.avg(b).alias("mean_weight"), F.max(b).alias("max_weight")
    )


def routing_fractions(df: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    w = F.col(weight)
    share = lambda c: F.avg(c.cast("double"))
    return df.groupBy(*keys).agg(share(w == 1).alias("repair_fraction"), share((w > 0) & (w < 1)).alias("halo_fraction"), share(w == 0).alias("classical_fraction"), F.avg(w).alias("mean_weight"))


def interval_summary(df: DataFrame, keys: list[str], active: Column, value: str, cues: dict[str, str], order: str = "t", more: dict[str, Column] | None = None) -> DataFrame:
    """Runs of active samples with peak, mean, the cue whose mean is largest (the first of equals), and further
    aggregates."""
    run = F.col(order) - F.row_number().over(in_order(keys, order))
    on = df.where(active).withColumn("__run", run)
    means = {n: F.avg(c) for n, c in cues.items()}
    out = on.groupBy(*keys, "__run").agg(
        F.min(order).alias("start"), (F.max(order) + 1).alias("end"), F.max(value).alias("peak"), F.avg(value).alias("mean"), *(m.alias(f"__m_{i}") for i, m in enumerate(means.values())), *(c.alias(n) for n, c in (more or {}).items())
    )
    top = F.greatest(*(F.col(f"__m_{i}") for i in range(len(cues))))
    dominant = F.coalesce(*(F.when(F.col(f"__m_{i}") >= top, F.lit(n)) for i, n in enumerate(cues)))
    return out.withColumn("dominant_cue", dominant).drop("__run", *(f"__m_{i}" for i in range(len(cues))))


def selection_mean(df: DataFrame, keys: list[str], first: int, last: int, value: str = "value", order: str = "t") -> DataFrame:
    """Mean over an inclusive selection."""
    return df.where(F.col(order).between(first, last)).groupBy(*keys).agg(F.avg(value).alias("mean"))


def extent(df: DataFrame, keys: list[str], value: str = "value", margin: float = 0.08) -> DataFrame:
    """Display range: least and largest value, each moved outward by a share of their distance (1 if they are equal)."""
    span = F.max(value) - F.min(value)
    pad = F.when(span == 0, 1.0).otherwise(span) * margin
    return df.groupBy(*keys).agg((F.min(value) - pad).alias("low"), (F.max(value) + pad).alias("high"))


def bucket_max(df: DataFrame, keys: list[str], step: int, value: str = "value", order: str = "t") -> DataFrame:
    return df.groupBy(*keys, F.floor(F.col(order) / step).alias("bucket")).agg(F.max(value).alias("peak"))


def stride(df: DataFrame, step: int, order: str = "t") -> DataFrame:
    return df.where(F.col(order) % step == 0)


def grid_argmin(df: DataFrame, score: str, ties: list[str], by: list[str] | None = None) -> DataFrame:
    """The configuration of least score, ties by the other columns in turn."""
    key = F.struct(score, *ties)
    best = df.groupBy(*(by or [])).agg(F.min(key).alias("b"))
    return best.select(*(by or []), "b.*")


def group_balanced(df: DataFrame, group: str, value: str, keep: list[str] | None = None) -> DataFrame:
    return hierarchical_mean(df, [group], value, keep)


def score_bundle(df: DataFrame, keys: list[str], label: str, before: str, after: str, threshold: float | None, order: str = "t") -> DataFrame:
    """Average precision before and after and, only where a threshold is known, erasure and false events."""
    out = average_precision(df, keys, label, before).withColumnRenamed("ap", "ap_before").join(average_precision(df, keys, label, after).withColumnRenamed("ap", "ap_after"), keys)
    if threshold is None:
        return out.withColumn("erasure", F.lit(None).cast("double")).withColumn("false_event_rate", F.lit(None).cast("double"))
    b, a = F.col(before) >= threshold, F.col(after) >= threshold
    return out.join(erasure_rate(df, keys, F.col(label), b, a, order), keys).join(false_event_rate(df, keys, F.col(label), b, a, order), keys)


def demo_bundle(df: DataFrame, keys: list[str], label: str, reference: str, noisy: str, candidate: str, before: str, after: str, threshold: float, order: str = "t") -> DataFrame:
    """Signal metrics and score metrics side by side."""
    return signal_metrics(df, keys, reference, noisy, candidate, order).join(score_bundle(df, keys, label, before, after, threshold, order), keys)


def rollup_counts(df: DataFrame, by: str, counts: dict[str, Column]) -> DataFrame:
    """Counts for each value and in total (null)."""
    return df.rollup(by).agg(*(c.alias(n) for n, c in counts.items()))
