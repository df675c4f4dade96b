"""Access decisions: constraints folded in their order, then one grant, then what is asked for.

Lists of selectors narrow each other. A null list allows all and an empty one nothing, from the first constraint to the answer, so narrowing never widens.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemos.functions.columns import NAMESPACE_IDS
from mnemos.operators.policy import first_of, intersected

#: What a grant is bound to.
BINDINGS = ("audience", "subject_agent_id", "parent_run_id", "child_run_id", "trace_parent_id")
_LISTS = ("workspace_ids", "record_types", "operations")


def schemas(ids: tuple = NAMESPACE_IDS) -> tuple[str, str]:
    """The types of constraints (an array) and of a grant (a struct), with selectors of these ids."""
    selectors = f"array<struct<{', '.join(f'{i}: string' for i in ids)}>>"
    lists = f"namespaces: {selectors}, workspace_ids: array<string>, record_types: array<string>, operations: array<string>, max_results: int, max_context_tokens: int"
    bindings = ", ".join(f"{b}: string" for b in BINDINGS)
    return f"array<struct<mode: string, {lists}>>", f"struct<grant_id: string, state: string, issued_at: timestamp, expires_at: timestamp, {bindings}, max_depth: int, can_reshare: boolean, {lists}>"


def met_selectors(a: Column, b: Column, ids: tuple = NAMESPACE_IDS) -> Column:
    """The selectors that two lists allow together: compatible pairs merged, in order, without repeats. A null id allows any; a null list allows all."""
    fits = lambda x, y: reduce(lambda p, q: p & q, (x[i].isNull() | y[i].isNull() | (x[i] == y[i]) for i in ids))
    both = lambda x, y: F.struct(*(F.coalesce(x[i], y[i]).alias(i) for i in ids))
    pairs = F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: fits(x, y)), lambda y: both(x, y))))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.array_sort(F.array_distinct(pairs)))


def folded(constraints: Column, ids: tuple = NAMESPACE_IDS) -> Column:
    """struct<denied, namespaces, workspace_ids, record_types, operations, max_results, max_context_tokens> of constraints in their order.

    deny_all denies, unconstrained_trusted adds nothing; any other constraint must name selectors, and denies where it leaves nothing of a list.
    """
    kinds = {"namespaces": f"array<struct<{', '.join(f'{i}: string' for i in ids)}>>", **dict.fromkeys(_LISTS, "array<string>"), "max_results": "int", "max_context_tokens": "int"}
    start = F.struct(F.lit(False).alias("denied"), *(F.lit(None).cast(t).alias(k) for k, t in kinds.items()))
    none = lambda x: F.coalesce(F.size(x) == 0, F.lit(False))

    def step(acc: Column, x: Column) -> Column:
        now = {"namespaces": met_selectors(acc["namespaces"], x["namespaces"], ids), **{k: intersected(acc[k], x[k]) for k in _LISTS}, **{k: F.least(acc[k], x[k]) for k in ("max_results", "max_context_tokens")}}
        trusted = x["mode"].eqNullSafe("unconstrained_trusted")
        denied = x["mode"].eqNullSafe("deny_all") | (~trusted & (x["namespaces"].isNull() | none(x["namespaces"]) | reduce(lambda p, q: p | q, (none(now[k]) for k in ("namespaces", *_LISTS)))))
        keep = acc["denied"] | trusted
        return F.struct((acc["denied"] | denied).alias("denied"), *(F.when(keep, acc[k]).otherwise(v).alias(k) for k, v in now.items()))

    return F.aggregate(F.coalesce(constraints, F.array().cast(schemas(ids)[0])), start, step)


def decided(requests: DataFrame, now: Column, ids: tuple = NAMESPACE_IDS) -> DataFrame:
    """(request_id, allowed, reason, namespaces, workspace_ids, record_types, max_results, max_context_tokens) of requests.

    A request: request_id, constraints and grant (of the types in `schemas`), delegated, host_max_results, host_max_context_tokens, the BINDINGS of its context, operation,
    namespaces, workspace_ids, record_types, depth, reshare, grant_id, max_results, max_context_tokens. Refusals come in this order: the constraints; for delegated
    requests a grant that is missing, inactive, not yet active, expired, another one's or bound to another context, the operation, the depth, sharing on; then selectors,
    workspaces and record types of which nothing is left; then operations that constraints and grant leave. A request that isn't delegated is trusted once constraints
    allow it, but gets no selector that they don't have.
    """
    c, g = F.col("_c"), F.col("grant")
    d = requests.withColumn("_c", folded(F.col("constraints"), ids))
    by_grant = lambda k, meet: F.when(F.col("delegated"), meet(c[k], g[k])).otherwise(c[k])
    selectors = lambda a, b: met_selectors(a, b, ids)
    left = {"namespaces": selectors(by_grant("namespaces", selectors), F.col("namespaces")), **{k: intersected(by_grant(k, intersected), F.col(k)) for k in ("workspace_ids", "record_types")}}
    d = d.withColumns({f"_{k}": v for k, v in left.items()}).withColumn("_operations", by_grant("operations", intersected))
    delegated = F.coalesce(F.col("delegated"), F.lit(False))
    unbound = reduce(lambda p, q: p | q, (F.col(b).isNull() | ~F.col(b).eqNullSafe(g[b]) for b in BINDINGS))
    empty = lambda k: F.coalesce(F.size(k) == 0, F.lit(False))
    not_in = lambda k: k.isNotNull() & ~F.coalesce(F.array_contains(k, F.col("operation")), F.lit(False))
    rules = [
        (c["denied"], "constraint_denied"),
        (delegated & g.isNull(), "grant_required"),
        (delegated & ~g["state"].eqNullSafe("active"), "grant_inactive"),
        (delegated & F.coalesce(now < g["issued_at"], F.lit(True)), "grant_not_yet_active"),
        (delegated & F.coalesce(now >= g["expires_at"], F.lit(True)), "grant_expired"),
        (delegated & (~F.col("grant_id").eqNullSafe(g["grant_id"]) | unbound), "grant_mismatch"),
        (delegated & ~F.coalesce(F.array_contains(g["operations"], F.col("operation")), F.lit(False)), "operation_denied"),
        (delegated & F.coalesce(F.col("depth") > g["max_depth"], F.lit(True)), "depth_exceeded"),
        (delegated & F.coalesce(F.col("reshare"), F.lit(False)) & ~F.coalesce(g["can_reshare"], F.lit(False)), "reshare_denied"),
        (delegated & (F.col("_namespaces").isNull() | empty("_namespaces")), "selector_denied"),
        (delegated & F.col("workspace_ids").isNotNull() & empty("_workspace_ids"), "workspace_denied"),
        (delegated & F.col("record_types").isNotNull() & empty("_record_types"), "record_type_denied"),
        (not_in(F.col("_operations")), "operation_denied"),
    ]
    d = d.withColumn("reason", F.coalesce(first_of(rules), F.when(delegated, "allowed").otherwise("trusted_local"))).withColumn("allowed", F.col("reason").isin("allowed", "trusted_local"))
    least = lambda k: F.when(F.col("allowed"), F.least(F.col(k), F.col(f"host_{k}"), c[k], F.when(delegated, g[k]))).alias(k)
    return d.select("request_id", "allowed", "reason", *(F.when(F.col("allowed"), F.col(f"_{k}")).alias(k) for k in ("namespaces", "workspace_ids", "record_types")), least("max_results"), least("max_context_tokens"))
