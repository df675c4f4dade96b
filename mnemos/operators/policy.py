"""Lifecycle, privacy, access and ontology decisions, each a chain of conditions over a table."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemos.functions.columns import duration_seconds, in_namespace
from mnemos.functions.shared import spread


def first_of(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise)
    for test, name in reversed(rules):
        out = F.when(F.coalesce(test, F.lit(False)), F.lit(name)).otherwise(out)
    return out


# Lifecycle


def promotion(kind: str, now: Column, **given) -> Column:
    """One promotion predicate over a record."""
    if kind == "access_count_above_threshold":
        return F.col("access_count") > given["threshold"]
    if kind == "tier_transition_count_above_threshold":
        return F.col("tier_transition_count") > given["threshold"]
    if kind == "event_time_within_window":
        return now.cast("double") - F.coalesce("event_time", "created_at").cast("double") <= duration_seconds(given["window"])
    if kind == "namespace_dimension_match":
        return in_namespace({given["dimension"]: given["value"]})
    raise ValueError(f"unknown predicate {kind!r}")


def lifecycle(records: DataFrame, now: Column, ttl_active: str | None, ttl_cooling: str | None, promotions: list[tuple[str, Column]] = ()) -> DataFrame:
    """records (with phase) and next_phase, transition_reason, matched_predicate and next_evaluation (seconds since 1970).

    archived and superseded stay. active turns to cooling, or archived without a cooling time, at the end of its
    time. cooling turns back to active on the first promotion that matches, else to archived at the end of both times.
    """
    active = duration_seconds(ttl_active) if ttl_active else None
    both = active + duration_seconds(ttl_cooling) if ttl_active and ttl_cooling else None
    age = now.cast("double") - F.col("updated_at").cast("double")
    phase = F.col("phase")
    ends = (phase == "active") & (age >= active if active is not None else F.lit(False))
    matched = first_of([(test, kind) for kind, test in promotions])
    cooling = phase == "cooling"
    over = cooling & matched.isNull() & (age >= both if both is not None else F.lit(False))
    reason = first_of([(ends, "ttl_active_elapsed"), (cooling & matched.isNotNull(), "promotion_predicate_matched"), (over, "ttl_cooling_elapsed")], "no_transition")
    then = F.when(ends, "cooling" if ttl_cooling else "archived").when(cooling & matched.isNotNull(), "active").when(over, "archived").otherwise(phase)
    start = F.col("updated_at").cast("double").cast("long")
    later = F.when((phase == "active") & ~ends, start + active if active is not None else F.lit(None).cast("long")).when(cooling & matched.isNull() & ~over, start + both if both is not None else F.lit(None).cast("long"))
    return records.withColumns({"next_phase": then, "transition_reason": reason, "matched_predicate": F.when(cooling, matched), "next_evaluation": later})


# Privacy


def retrieval_reason() -> Column:
    """Why a record is left out of retrieval, by visibility (retrieval_visibility) and then a hook's verdict (hook_denied); null if it stays."""
    return first_of([(F.col("retrieval_visibility") == "hidden", "hidden_by_visibility"), (F.col("retrieval_visibility") == "audit_only", "audit_only"), (F.col("hook_denied"), "denied_by_policy_hook")])


def redacted(df: DataFrame, when: Column, columns: list[str], mark: str = "[redacted]") -> DataFrame:
    return df.withColumns({c: F.when(when, F.lit(mark)).otherwise(F.col(c)) for c in columns})


def retrieval_filtered(records: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records that stay, with `columns` redacted where the visibility says so; (id, reason) of those left out)."""
    marked = records.withColumn("_reason", retrieval_reason())
    kept = redacted(marked.where(F.col("_reason").isNull()), F.coalesce(F.col("retrieval_visibility") == "redacted", F.lit(False)), columns)
    return kept.drop("_reason"), marked.where(F.col("_reason").isNotNull()).select("id", F.col("_reason").alias("reason"))


def exported(records: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records whose export isn't hidden, and the edges both of whose ends are."""
    kept = records.where(F.coalesce(F.col("export_visibility") != "hidden", F.lit(True)))
    ids = kept.select("id")
    return kept, edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")


def retention_outcome() -> Column:
    """erase, tombstone, redact_and_retain, hide or retain: the strongest that a record's wishes ask for."""
    return first_of([(F.col("erase"), "erase"), (F.col("tombstone"), "tombstone"), (F.col("redact"), "redact_and_retain"), (F.col("hide"), "hide")], "retain")


# Access


def intersected(a: Column, b: Column) -> Column:
    """What both lists allow. A null list allows all, an empty one nothing."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.array_sort(F.array_intersect(a, b)))


def access(requests: DataFrame, now: Column) -> DataFrame:
    """requests with allowed, reason and the least of the result limits.

    A request row holds its grant: grant_id, status, starts_at, ends_at, actor, granted_actor, operation,
    operations[], depth, max_depth, namespaces[], granted_namespaces[], constraint_namespaces[] (null: unrestricted, empty:
    nothing), mode, limits[]. Denials come in a fixed order; what can't be decided is denied.
    """
    space = intersected(intersected(F.col("constraint_namespaces"), F.col("granted_namespaces")), F.col("namespaces"))
    rules = [
        (F.col("mode") == "deny_all", "constraint_denied"),
        (F.size("constraint_namespaces") == 0, "constraint_denied"),
        (F.col("grant_id").isNull(), "grant_required"),
        (F.col("status") != "active", "grant_inactive"),
        (F.col("starts_at") > now, "grant_not_yet_active"),
        (F.col("ends_at") <= now, "grant_expired"),
        (~F.col("actor").eqNullSafe(F.col("granted_actor")), "binding_mismatch"),
        (~F.coalesce(F.array_contains("operations", F.col("operation")), F.lit(False)), "operation_denied"),
        (F.coalesce(F.col("depth") > F.col("max_depth"), F.lit(True)), "depth_exceeded"),
        (F.coalesce(F.size(space) == 0, F.lit(False)), "namespace_denied"),
    ]
    return requests.withColumn("reason", first_of(rules, "allowed")).withColumns({"allowed": F.col("reason") == "allowed", "max_results": F.when(F.col("reason") == "allowed", F.array_min("limits"))})


def role_decision(requests: DataFrame, bindings: DataFrame, permissions: dict[str, list[str]]) -> DataFrame:
    """requests (request_id, workspace, actor, action) with role and allowed: the first binding (by position) of workspace and actor decides."""
    w = Window.partitionBy("workspace", "actor").orderBy("position")
    first = bindings.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("workspace", "actor", "role")
    may = reduce(lambda a, b: a | b, ((F.col("role") == r) & F.col("action").isin(a) for r, a in permissions.items()), F.lit(False))
    return requests.join(first, ["workspace", "actor"], "left").withColumn("allowed", F.coalesce(may, F.lit(False)))


# Ontology


def ontology_violations(rows: DataFrame, types: DataFrame, properties: DataFrame) -> DataFrame:
    """(id, violations) of rows (id, category, properties map<string, string>) that break an ontology: types (category) and
    properties (category, name, kind, required), two small tables."""
    p = properties.groupBy("category").agg(F.collect_list(F.struct("name", "kind", "required")).alias("_p"))
    t = types.select("category", F.lit(True).alias("_known")).join(p, "category", "left")
    value = lambda x: F.col("properties")[x["name"]]
    wrong = lambda x: (
        F.when(value(x).isNull(), F.when(x["required"], F.concat(F.lit("missing:"), x["name"])))
        .when((x["kind"] == "int") & ~value(x).rlike(r"^-?\d+$"), F.concat(F.lit("type:"), x["name"]))
        .when((x["kind"] == "number") & value(x).try_cast("double").isNull(), F.concat(F.lit("type:"), x["name"]))
        .when((x["kind"] == "bool") & ~value(x).isin("true", "false"), F.concat(F.lit("type:"), x["name"]))
        .when((x["kind"] == "datetime") & F.try_to_timestamp(value(x)).isNull(), F.concat(F.lit("type:"), x["name"]))
    )
    found = F.array_compact(F.concat(F.array(F.when(F.col("_known").isNull(), F.lit("undeclared_category"))), F.transform(F.coalesce("_p", F.array().cast(t.schema["_p"].dataType)), wrong)))
    return rows.join(spread(t), "category", "left").select("id", F.array_sort(found).alias("violations")).where(F.size("violations") > 0)


def publish_plan(records: DataFrame, most: int) -> DataFrame:
    """(id, place): records whose export isn't hidden, by title and id, up to a cap."""
    kept = records.where(F.coalesce(F.col("export_visibility") != "hidden", F.lit(True))).orderBy("title", "id").limit(most)
    return kept.select("id", F.row_number().over(Window.orderBy("title", "id")).alias("place"))  # of `most` rows


# Hooks, gateway and audit


def hook_decision(requests: DataFrame, hooks: list[tuple[str, Column]]) -> DataFrame:
    """requests with action, policy_id and reason_code: hooks (policy id, Column with the reason to deny, null to allow) go from left to right and
    the first that denies decides; if none does, the request is allowed."""
    policy = first_of([(reason.isNotNull(), name) for name, reason in hooks])
    reason = F.coalesce(*(r for _, r in hooks), F.lit(None).cast("string"))
    return requests.withColumns({"policy_id": F.coalesce(policy, F.lit("<aggregate>")), "reason_code": reason, "action": F.when(policy.isNotNull(), "deny").otherwise("allow")})


def behind_gateway(table: DataFrame, decisions: DataFrame, actor: str, operation: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """What an actor may read of a table with a namespace, under its decisions (actor, operation, allowed, reason, namespaces: null for all, max_results),
    and an audit row of the access. Without an allowing decision nothing is read; several decisions add up."""
    mine = decisions.where((F.col("actor") == actor) & (F.col("operation") == operation))
    go = mine.where("allowed")
    spaces = go.select(F.explode_outer("namespaces").alias("_ns")).distinct()
    seen = table.join(spread(spaces), F.col("_ns").isNull() | (F.col("namespace") == F.col("_ns")), "left_semi")
    row = mine.agg(F.coalesce(F.max("allowed"), F.lit(False)).alias("allowed"), F.max("max_results").alias("max_results"), F.min(F.when(~F.col("allowed"), F.col("reason"))).alias("reason"))
    audit = row.select(F.lit(actor).alias("actor"), F.lit(operation).alias("operation"), F.when(F.col("allowed"), "memory.access.allowed").otherwise("memory.access.denied").alias("event_type"), F.when(~F.col("allowed"), F.coalesce("reason", F.lit("grant_required"))).alias("reason"), at.alias("recorded_at"))
    most = row.first()["max_results"]
    return (seen.orderBy("id").limit(most) if most is not None else seen), audit


def audit_events(rows: DataFrame, event_type: Column, target: Column, at: Column, details: list[str]) -> DataFrame:
    """(event_id, event_type, target_id, recorded_at, details): an event of each row, its id a hash of what it says, so that a replay writes the same."""
    said = F.to_json(F.struct(*sorted(details)))
    return rows.select(F.sha2(F.concat_ws("|", event_type, target, at.cast("string"), said).cast("binary"), 256).alias("event_id"), event_type.alias("event_type"), target.alias("target_id"), at.alias("recorded_at"), said.alias("details"))


def retained(records: DataFrame, now: Column, columns: list[str]) -> DataFrame:
    """records after their retention outcome: erased ones are gone, tombstones are closed and emptied, redacted ones emptied, hidden ones hidden."""
    kept = records.withColumn("_o", retention_outcome()).where("_o <> 'erase'")
    kept = redacted(kept, F.col("_o").isin("tombstone", "redact_and_retain"), columns)
    return kept.withColumns({"valid_to": F.when(F.col("_o") == "tombstone", now).otherwise(F.col("valid_to")), "retrieval_visibility": F.when(F.col("_o") == "hide", "hidden").otherwise(F.col("retrieval_visibility"))}).drop("_o")


def profile_plan(fields: DataFrame, mappings: DataFrame) -> DataFrame:
    """(field, target, diagnostic) of fields under a pack's mappings (source_field, target_field, lossy, required): unknown_field, lossy_field,
    required_missing or null."""
    m = mappings.select(F.col("source_field").alias("field"), F.col("target_field").alias("target"), "lossy", "required", F.lit(True).alias("_m"))
    j = fields.select("field", F.lit(True).alias("_f")).join(m, "field", "full")
    rules = [(F.col("_m").isNull(), "unknown_field"), (F.col("_f").isNull() & F.col("required"), "required_missing"), (F.col("_f") & F.col("lossy"), "lossy_field")]
    return j.withColumn("diagnostic", first_of(rules)).where(F.col("_f").isNotNull() | F.col("diagnostic").isNotNull()).select("field", F.when(F.col("_f"), F.col("target")).alias("target"), "diagnostic")


def default_policy_id(namespace: Column) -> Column:
    """The id of the policy that a namespace has if it has none of its own."""
    return F.concat(F.lit("default:"), F.translate(namespace, "|", ","))


def template_plan(forms: DataFrame, fields: DataFrame) -> DataFrame:
    """(form_id, problems) of filled forms (form_id, template, values map<string, string>) against fields (template, name, required, choices array, null: any):
    missing:name, choice:name and unknown:name, sorted; no problems: the form can become a record."""
    spec = fields.groupBy("template").agg(F.collect_list(F.struct("name", "required", "choices")).alias("_s"))
    have = lambda x: F.col("values")[x["name"]]
    wrong = lambda x: F.when(F.coalesce(have(x), F.lit("")) == "", F.when(x["required"], F.concat(F.lit("missing:"), x["name"]))).when(~F.array_contains(x["choices"], have(x)), F.concat(F.lit("choice:"), x["name"]))
    names = F.transform("_s", lambda x: x["name"])
    more = F.transform(F.array_except(F.map_keys("values"), names), lambda k: F.concat(F.lit("unknown:"), k))
    found = F.array_sort(F.array_compact(F.concat(F.transform("_s", wrong), more)))
    return forms.join(spread(spec), "template", "left").select("form_id", F.when(F.col("_s").isNull(), F.array(F.lit("unknown_template"))).otherwise(found).alias("problems"))


def template_applied(forms: DataFrame, fields: DataFrame, defaults: dict[str, str], at: Column) -> tuple[DataFrame, DataFrame]:
    """Records (id, type, title, properties, created_at) of the forms that have no problems, and the plan of the others (form_id, problems).

    A field's default stands where a form says nothing; the title is the value of the field `title`, or else of the template's first field by name. The id is a hash of template and form,
    so a form that is applied again gives the same record.
    """
    said = F.map_filter(F.coalesce("values", F.create_map().cast("map<string,string>")), lambda k, v: F.coalesce(v, F.lit("")) != "")
    default = F.map_filter(F.create_map(*(F.lit(x) for kv in sorted(defaults.items()) for x in kv)).cast("map<string,string>"), lambda k, v: ~F.coalesce(F.map_contains_key(said, k), F.lit(False)))
    own = F.transform(F.filter(F.map_entries(default), lambda e: F.array_contains("_names", e["key"])), lambda e: e)
    spec = fields.groupBy("template").agg(F.array_sort(F.collect_set("name")).alias("_names"))
    filled = forms.join(spread(spec), "template", "left").withColumn("values", F.map_concat(said, F.map_from_entries(F.coalesce(own, F.array().cast("array<struct<key:string,value:string>>")))))
    plan = template_plan(filled.select("form_id", "template", "values"), fields)
    good = filled.join(plan.where(F.size("problems") == 0).select("form_id"), "form_id", "left_semi")
    title = F.coalesce(F.col("values")["title"], F.col("values")[F.get("_names", F.lit(0))])
    records = good.select(F.sha2(F.concat_ws("|", "template", F.col("form_id").cast("string")).cast("binary"), 256).alias("id"), F.col("template").alias("type"), title.alias("title"), F.col("values").alias("properties"), at.alias("created_at"))
    return records, plan.where(F.size("problems") > 0)


#: The field of a record's meta that holds its privacy policy.
PRIVACY_FIELD = "privacy"


def privacy_of(meta: Column) -> Column:
    """struct<retrieval_visibility, export_visibility, erase> of a record's meta (JSON); visible and kept where it says nothing."""
    at = lambda k: F.get_json_object(meta, f"$.{PRIVACY_FIELD}.{k}")
    return F.struct(F.coalesce(at("retrieval"), F.lit("visible")).alias("retrieval_visibility"), F.coalesce(at("export"), F.lit("visible")).alias("export_visibility"), (F.coalesce(at("erase"), F.lit("false")) == "true").alias("erase"))


def with_privacy(meta: Column, retrieval: Column, export: Column) -> Column:
    """A record's meta with this policy in the place of the one it had; its other fields as texts."""
    rest = F.map_filter(F.coalesce(F.from_json(meta, "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: k != PRIVACY_FIELD)
    policy = F.to_json(F.struct(retrieval.alias("retrieval"), export.alias("export")))
    return F.to_json(F.map_concat(rest, F.create_map(F.lit(PRIVACY_FIELD), policy)))


def scratch_namespace(namespace: Column, actor: Column, task: Column) -> Column:
    """The child namespace in which a delegate may write."""
    return F.concat_ws("|", namespace, F.concat(F.lit("agent_id="), actor), F.concat(F.lit("session_id=delegated:"), task))


def review_requests(changes: DataFrame, roles: list[str]) -> DataFrame:
    """(request_id, target_id, requested_by, status) of changes (target_id, actor, role) whose role may only propose."""
    asked = changes.where(~F.col("role").isin(roles))
    return asked.select(F.sha2(F.concat_ws("|", "target_id", "actor").cast("binary"), 256).alias("request_id"), "target_id", F.col("actor").alias("requested_by"), F.lit("open").alias("status")).distinct()


def validated(rows: DataFrame, ontologies: DataFrame, types: DataFrame, properties: DataFrame) -> DataFrame:
    """(id, violations) of rows (id, ontology_id, version, category, properties) under the ontology each names: unknown_ontology first of all."""
    known = ontologies.select("ontology_id", "version", F.lit(True).alias("_o"))
    j = rows.join(spread(known), ["ontology_id", "version"], "left")
    lost = j.where("_o is null").select("id", F.array(F.lit("unknown_ontology")).alias("violations"))
    return lost.unionByName(ontology_violations(j.where("_o").select("id", "category", "properties"), types, properties))
