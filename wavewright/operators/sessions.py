"""Editing sessions as event-sourced tables: actions in revision order, folded to a current signal.

A revert takes back the newest edit that still stands, so what stands at the end follows from counting, without
replaying signals: an edit is taken back if, after it, reverts outnumber edits at some point. The last standing
edit on a sample, or the baseline, is the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import in_order
from ..functions.errors import AuditError
from ..functions.kernels import array_hash, json_hash
from .controller import Controller


def standing_edits(actions: DataFrame, keys: list[str]) -> DataFrame:
    """Edits that no revert took back: actions (keys, revision, action, ...) without reverts."""
    step = F.when(F.col("action") == "revert", -1).otherwise(1)
    w = in_order(keys, "revision")
    height = F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))
    later = F.min("__h").over(w.rowsBetween(1, Window.unboundedFollowing))
    out = actions.withColumn("__s", step).withColumn("__h", height).withColumn("__later", later)
    return out.where("action <> 'revert' and coalesce(__later, __h) >= __h").drop("__s", "__h", "__later")


def current_signal(samples: DataFrame, actions: DataFrame, keys: list[str], order: str = "t") -> DataFrame:
    """Samples (observation, candidate, baseline) with ``current`` after the standing edits.

    protect takes the observation, accept_candidate the candidate, blend their mix, restore_automatic the baseline
    everywhere. Edits mix observation and candidate, never what an earlier edit left.
    """
    edits = standing_edits(actions, keys).select(*keys, "revision", "action", "start", "end", "beta")
    points = edits.withColumn(order, F.explode(F.expr("sequence(start, end - 1)")))
    last = points.groupBy(*keys, order).agg(F.max_by(F.struct("action", "beta"), "revision").alias("__e"))
    o, c, b = F.col("observation"), F.col("candidate"), F.col("__e.beta")
    new = F.when(F.col("__e.action") == "protect", o).when(F.col("__e.action") == "accept_candidate", c).when(F.col("__e.action") == "blend", b * o + (1 - b) * c)
    return samples.join(last, [*keys, order], "left").withColumn("current", F.coalesce(new, F.col("baseline"))).drop("__e")


def stale_actions(actions: DataFrame, keys: list[str]) -> DataFrame:
    """Actions whose expected revision is not the number of actions before them."""
    now = F.row_number().over(in_order(keys, "revision")) - 1
    return actions.withColumn("__now", now).where(F.col("expected_revision").isNotNull() & (F.col("expected_revision") != F.col("__now"))).drop("__now")


def clamp_actions(actions: DataFrame, length: str = "n") -> DataFrame:
    """Live form: intervals are held inside the window."""
    start = F.greatest(F.lit(0), F.least(F.col("start"), F.col(length) - 1))
    return actions.withColumn("start", start).withColumn("end", F.greatest(F.col("start") + 1, F.least(F.col("end"), F.col(length))))


def invalid_actions(actions: DataFrame, length: str = "n") -> DataFrame:
    """Replay form: intervals and weights that must be refused."""
    beta = (F.col("action") == "blend") & (F.col("beta").isNull() | F.isnan("beta") | ~F.col("beta").between(0, 1))
    return actions.where(~((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col(length))) | beta)


class Session:
    """One window's edits with revision checks and hash-chained records."""

    ACTIONS = ("accept_candidate", "protect", "blend", "restore_automatic")

    def __init__(self, observation, candidate, baseline, controller: Controller | None = None):
        self.observation, self.candidate, self.baseline = (np.asarray(x, np.float32) for x in (observation, candidate, baseline))
        if not self.observation.shape == self.candidate.shape == self.baseline.shape:
            raise AuditError("session signals have one length")
        self.controller, self.current = controller, self.baseline.copy()
        self.states: list[np.ndarray] = []
        self.records: list[dict] = []
        self.revision = 0

    def _at(self, expected: int | None) -> None:
        if expected is not None and int(expected) != self.revision:
            raise AuditError(f"stale revision: expected {expected}, current {self.revision}")

    def _record(self, action: str, start: int, end: int, beta: float | None, before: np.ndarray) -> str:
        self.revision += 1
        status = "unchecked" if self.controller is None else "passed" if self.controller.verify(self.observation, self.current).passed else "overridden"
        body = {"revision": self.revision, "action": action, "start": start, "end": end, "beta": beta, "before": array_hash(before), "after": array_hash(self.current), "status": status, "previous": self.records[-1]["hash"] if self.records else "0" * 64}
        self.records.append({**body, "hash": json_hash(body)})
        return status

    def apply(self, action: str, start: int | None = None, end: int | None = None, beta: float = 0.5, expected: int | None = None) -> str:
        self._at(expected)
        a, b = (0 if start is None else int(start)), (self.current.size if end is None else int(end))
        if action not in self.ACTIONS or not 0 <= a < b <= self.current.size or (action == "blend" and not 0 <= beta <= 1):
            raise AuditError("unknown action, or interval or weight out of range")
        before, new = self.current, self.current.copy()
        if action == "restore_automatic":
            new, a, b = self.baseline.copy(), 0, new.size
        else:
            w = {"accept_candidate": 0.0, "protect": 1.0, "blend": beta}[action]
            new[a:b] = self.observation[a:b] if w == 1.0 else self.candidate[a:b] if w == 0.0 else w * self.observation[a:b] + (1 - w) * self.candidate[a:b]
        self.states.append(before)
        self.current = new
        return self._record(action, a, b, float(beta) if action == "blend" else None, before)

    def revert(self, expected: int | None = None) -> str:
        self._at(expected)
        if not self.states:
            raise AuditError("nothing to revert")
        before, self.current = self.current, self.states.pop()
        return self._record("revert", 0, self.current.size, None, before)


def chain_actions(actions: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, n_actions, chain): SHA-256 chain over the rows of a key in revision order, by a fold inside the JVM."""
    rows = F.array_sort(F.collect_list(F.struct("revision", *columns)))
    body = lambda x: F.concat_ws("|", *(F.coalesce(x[c].cast("string"), F.lit("")) for c in ["revision", *columns]))
    fold = F.aggregate("__r", F.repeat(F.lit("0"), 64), lambda acc, x: F.sha2(F.concat_ws("|", acc, body(x)), 256))
    return actions.groupBy(*keys).agg(rows.alias("__r")).select(*keys, F.size("__r").cast("long").alias("n_actions"), fold.alias("chain"))


def replay(df: DataFrame, keys: list[str], actions: DataFrame, signals: str = "observation,candidate,baseline") -> DataFrame:
    """Packed signals and their actions through Session, one key a time: (keys, current, records, last_hash)."""
    kinds = dict(df.dtypes)
    names = signals.split(",")

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, r in left.iterrows():
            s = Session(*(r[n] for n in names))
            for _, a in right.sort_values("revision").iterrows():
                if a["action"] == "revert":
                    s.revert()
                else:
                    s.apply(a["action"], a["start"], a["end"], 0.5 if a["beta"] is None or np.isnan(a["beta"]) else float(a["beta"]))
            rows.append([*key, s.current, len(s.records), s.records[-1]["hash"] if s.records else "0" * 64])
        return pd.DataFrame(rows, columns=[*keys, "current", "records", "last_hash"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", current array<float>, records int, last_hash string"
    return df.groupBy(*keys).cogroup(actions.groupBy(*keys)).applyInPandas(run, schema)
