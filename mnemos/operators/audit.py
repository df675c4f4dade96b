"""Audit events of governance: rows of each kind become events of one shape, and rows that can't be events say why."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Closed vocabularies of audited fields.
SURFACES = ("write", "retrieval", "export", "retention", "deletion")
DENIALS = ("POLICY_DENIED_BY_HOOK", "POLICY_REQUIRED_FIELDS_MISSING", "POLICY_NAMESPACE_FORBIDDEN", "POLICY_RETENTION_EXPIRED", "POLICY_QUOTA_EXCEEDED", "POLICY_TRUST_THRESHOLD_NOT_MET")
SIGNALS = ("explicit_user_correction", "validation_passed", "validation_failed", "retrieval_used", "retrieval_ignored")
ACTIONS = ("ttl_active_elapsed", "ttl_cooling_elapsed", "promotion_applied", "archived", "deleted", "no_transition")
DELIVERIES = ("pending", "succeeded", "failed", "abandoned")


@dataclass(frozen=True)
class Shape:
    """How rows of a kind are events. target: the column with the target's id; target_kind: its kind, or the column that has it if it is one; said: columns that
    the details always have; may: those they have if they aren't null; needs: columns that may not be null or empty; of: columns with a closed vocabulary;
    least: whole numbers and the least that each may be."""

    event: str
    target: str | None
    target_kind: str
    said: tuple[str, ...]
    may: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    of: tuple[tuple[str, tuple[str, ...]], ...] = ()
    least: tuple[tuple[str, int], ...] = ()
    texts: str | None = None


_COUNTS = tuple(f"{k}_count" for k in ("record", "relation", "candidate", "block", "document"))
SHAPES = {
    "write_attempt": Shape("memory.write_attempt", "target_id", "target_kind", ("payload_kind", "source_owner", "trust_mode", "namespace"), ("idempotency_key",), ("namespace", "payload_kind", "source_owner", "target_kind")),
    "write_accepted": Shape("memory.write_accepted", "target_id", "target_kind", ("payload_kind", "source_owner", "namespace"), (), ("namespace", "payload_kind", "source_owner", "target_kind", "target_id")),
    "retrieval": Shape("memory.retrieval", None, "retrieval", ("source_owner", "selected_ids", "omitted_count", "namespace"), ("retrieval_mode",), ("namespace", "source_owner"), (), (("omitted_count", 0),), "selected_ids"),
    "export": Shape("memory.export", "bundle_id", "bundle", ("source_owner", "namespace", *_COUNTS), (), ("namespace", "source_owner"), (), tuple((c, 0) for c in _COUNTS)),
    "policy_denial": Shape("memory.policy_denial", "target_id", "target_kind", ("surface", "reason_code", "policy_id", "source_owner", "namespace"), (), ("namespace", "policy_id", "source_owner", "target_kind"), (("surface", SURFACES), ("reason_code", DENIALS))),
    "lifecycle_action": Shape("memory.lifecycle_action", "record_id", "record", ("action", "policy_id", "from_phase", "to_phase", "namespace"), ("job_id",), ("namespace", "record_id", "policy_id", "from_phase", "to_phase"), (("action", ACTIONS),)),
    "webhook_delivery_attempt": Shape("memory.webhook_delivery_attempt", "webhook_id", "webhook", ("delivery_id", "status", "attempt", "target_url_host"), ("response_status_code",), ("webhook_id", "delivery_id", "target_url_host"), (("status", DELIVERIES),), (("attempt", 1),)),
    "quality_eval_signal": Shape("memory.quality_eval_signal", "record_id", "record", ("signal_kind", "source_owner", "namespace"), (), ("namespace", "record_id", "source_owner"), (("signal_kind", SIGNALS),)),
    "retrieval_explanation": Shape("memory.retrieval_explanation", "record_id", "record", ("structural_score", "matched_filters", "graph_path_ids", "namespace"), ("embedding_score", "retrieval_mode"), ("namespace", "record_id", "structural_score"), (), (), "matched_filters"),
}


def refusal(shape: Shape) -> Column:
    """Why a row is no event of its kind, in the order of what is asked; null if it is one."""
    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    rules = [(empty(c), F.lit(f"{c} is required")) for c in shape.needs]
    rules += [(~F.coalesce(F.col(c).isin(*values), F.lit(False)), F.concat(F.lit(f"unknown {c}: "), F.coalesce(F.col(c), F.lit("null")))) for c, values in shape.of]
    rules += [(~F.coalesce(F.col(c) >= n, F.lit(False)), F.lit(f"{c} must be at least {n}")) for c, n in shape.least]
    if shape.texts:
        rules.append((F.coalesce(F.exists(shape.texts, lambda x: x.isNull() | (x == "")), F.lit(True)), F.lit(f"{shape.texts} must be texts that aren't empty")))
    out = F.lit(None).cast("string")
    for test, text in reversed(rules):
        out = F.when(test, text).otherwise(out)
    return out


def events(rows: DataFrame, kind: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(event_id, timestamp, event_type, target_kind, target_id, session_id, details) of the rows that are events of a kind, and the other rows with why not (refusal).

    details is JSON with its keys in order. rows has the columns of the kind's shape and may have session_id and more_details (a map of texts, which wins over equal keys).
    The id is a hash of what the event says, so a replay gives the same event; equal rows are one event.
    """
    if kind not in SHAPES:
        raise ValueError(f"unknown kind {kind!r}")
    s = SHAPES[kind]
    judged = rows.withColumn("refusal", refusal(s))
    own = {c: F.col(c) for c in sorted({*s.said, *(c for c in s.may if c in rows.columns)})}
    details = F.to_json(F.struct(*(v.alias(c) for c, v in own.items())))
    if "more_details" in rows.columns:
        entries = lambda m: F.map_filter(F.from_json(m, "map<string,string>"), lambda k, v: ~F.coalesce(F.map_contains_key("more_details", k), F.lit(False)))
        details = F.when(F.col("more_details").isNull(), details).otherwise(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(entries(details), F.col("more_details")))))))
    target_kind = F.col(s.target_kind) if s.target_kind in rows.columns else F.lit(s.target_kind)
    target = F.col(s.target).cast("string") if s.target else F.lit(None).cast("string")
    session = F.col("session_id") if "session_id" in rows.columns else F.lit(None).cast("string")
    made = judged.where("refusal is null").select(at.alias("timestamp"), F.lit(s.event).alias("event_type"), target_kind.alias("target_kind"), target.alias("target_id"), session.alias("session_id"), details.alias("details"))
    said = F.to_json(F.struct("timestamp", "event_type", "target_kind", "target_id", "session_id", "details"))
    return made.select(F.sha2(said.cast("binary"), 256).alias("event_id"), "*").dropDuplicates(["event_id"]), judged.where("refusal is not null")
