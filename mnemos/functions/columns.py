"""Column expressions: namespaces, time, ids, text and vectors."""

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The eight ids of a namespace.
NAMESPACE_IDS = ("tenant_id", "org_id", "user_id", "agent_id", "session_id", "conversation_id", "project_id", "graph_id")
#: The namespace id that a scope's kind stands for.
SCOPE_IDS = {"session": "session_id", "agent": "agent_id", "project": "project_id", "global": "graph_id"}



# Namespaces


def in_namespace(wanted: dict[str, str], prefix: str = "") -> Column:
    """Every id that is set in `wanted` equals the row's; a row's null never does."""
    return reduce(lambda a, b: a & b, (F.coalesce(F.col(prefix + k) == v, F.lit(False)) for k, v in wanted.items()), F.lit(True))


def in_any_namespace(wanted: list[dict[str, str]] | None, prefix: str = "") -> Column:
    """At least one of the namespaces matches; no list, or an empty one, matches all."""
    return reduce(lambda a, b: a | b, (in_namespace(w, prefix) for w in wanted)) if wanted else F.lit(True)


def namespace_key(ids: tuple = NAMESPACE_IDS) -> Column:
    """`id=value` pairs joined by |, ids in alphabetical order, those that are null left out."""
    return F.concat_ws("|", *(F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}="), F.col(k))) for k in sorted(ids)))


def scope_namespace(scope: Column) -> dict[str, Column]:
    """The namespace ids that a scope `kind:value` implies."""
    kind, value = F.substring_index(scope, ":", 1), F.expr("substring(scope, instr(scope, ':') + 1)")
    return {i: F.when(kind == k, value) for k, i in SCOPE_IDS.items()}


# Time


def start_of(event_time="event_time", created_at="created_at") -> Column:
    return F.coalesce(F.col(event_time), F.col(created_at))


def open_at(end: Column, t: Column) -> Column:
    return end.isNull() | (t < end)


def valid_at(t: Column) -> Column:
    """The row's validity [event_time or created_at, valid_to) contains t."""
    return (start_of() <= t) & open_at(F.col("valid_to"), t)


def believed_at(t: Column) -> Column:
    return (F.col("created_at") <= t) & open_at(F.col("valid_to"), t)


def effective_during(a: Column, b: Column) -> Column:
    """The row's validity overlaps [a, b); nothing overlaps an empty window."""
    return (a < b) & open_at(F.col("valid_to"), a) & (start_of() < b)


def current_at(now: Column) -> Column:
    return F.col("valid_to").isNull() | (F.col("valid_to") > now)


_PARTS = (("Y", 365 * 86400), ("M", 30 * 86400), ("W", 7 * 86400), ("D", 86400))
_CLOCK = (("H", 3600), ("M", 60), ("S", 1))


def duration_seconds(text: str) -> int:
    """Seconds of an ISO duration of whole numbers; a year is 365 days and a month 30. Raises ValueError for others and for zero."""
    days, _, clock = text.removeprefix("P").partition("T")
    total = 0
    for part, units in ((days, dict(_PARTS)), (clock, dict(_CLOCK))):
        found = re.findall(r"(\d+)([A-Z])", part)
        if "".join(n + u for n, u in found) != part or [u for _, u in found] != [u for u in units if u in {x for _, x in found}]:
            raise ValueError(f"not a duration: {text!r}")
        total += sum(int(n) * units[u] for n, u in found)
    if not text.startswith("P") or not total:
        raise ValueError(f"not a duration: {text!r}")
    return total


def decay(updated_at: Column, now: Column, half_life_days: float) -> Column:
    """0.5 to the power of the age in half-lives; 1 for the future, 0 for no time."""
    days = F.greatest(F.lit(0.0), (now.cast("double") - updated_at.cast("double")) / 86400.0)
    return F.coalesce(F.pow(F.lit(0.5), days / F.lit(float(half_life_days))), F.lit(0.0))


# Ids


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5) of a text in a namespace UUID."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.element_at(F.array(*(F.lit(x) for x in "89ab")), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


# Text


def slug(heading: Column) -> Column:
    """Lower case, nothing but letters, digits, spaces and hyphens; then no spaces at the ends, and each run of spaces one hyphen."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(heading), "[^a-z0-9 -]", "")), " +", "-")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def haystack(*parts: Column) -> Column:
    """The parts that aren't empty, a line each, in lower case."""
    return F.lower(F.concat_ws("\n", *(F.nullif(p, F.lit("")) for p in parts)))


def contains_text(hay: Column, query: str) -> Column:
    """A substring search without case; a blank query finds all."""
    return hay.contains(query.strip().lower()) if query.strip() else F.lit(True)


def shortened(text: Column, tokens: Column, budget: Column) -> Column:
    """A text cut to the share of its estimated tokens that a budget leaves, without spaces at its end; whole if it fits."""
    share = F.floor(F.length(text) * F.greatest(F.lit(0), budget) / F.greatest(F.lit(1), tokens)).cast("int")
    return F.when(tokens <= budget, text).otherwise(F.rtrim(F.substring(text, F.lit(1), share)))


def iso_time(text: Column) -> Column:
    """The time that an ISO text names, with Z, an offset or none (UTC then, if the session's zone is UTC); null for other texts."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "[zZ]$", "+00:00"))


# Places in texts

#: Sums are made in blocks of so many sizes, so that long lists cost in proportion to their length.
BLOCK = 256


def let(value: Column, of) -> Column:
    """of(value), with the value worked out once however often `of` uses it, also within other lambdas."""
    return F.transform(F.array(value), of)[0]


def running(sizes: Column) -> Column:
    """array<bigint>: the sums of an array's values up to each of them."""
    nothing = F.array().cast("array<bigint>")

    def summed(block: Column) -> Column:
        step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["sums"], F.array(acc["sum"] + x)).alias("sums"))
        return F.aggregate(block, F.struct(F.lit(0).cast("bigint").alias("sum"), nothing.alias("sums")), step)

    def joined(blocks: Column) -> Column:
        before = summed(F.transform(blocks, lambda b: b["sum"]))["sums"]
        return F.flatten(F.zip_with(blocks, before, lambda b, end: F.transform(b["sums"], lambda x: x + end - b["sum"])))

    last = lambda s: F.call_function("div", F.size(s) - 1, F.lit(BLOCK)).cast("int")
    blocks = lambda s: F.transform(F.sequence(F.lit(0), last(s)), lambda b: summed(F.slice(s, b * BLOCK + 1, BLOCK)))
    return let(F.transform(sizes, lambda x: x.cast("bigint")), lambda s: let(blocks(s), joined))


def places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of the leftmost matches that don't overlap; places count characters from 0, the end is exclusive.

    The text is cut at the matches once, and their places are running sums over what lies between. Null for a null text.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column) -> Column:
        sizes = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(m)), m, lambda a, b: F.length(a) + F.length(b))
        return F.zip_with(m, running(sizes), lambda x, end: F.struct((end - F.length(x)).alias("start"), end.alias("end"), x.alias("match")))

    nothing = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    return let(matches, lambda m: F.when(F.size(m) > 0, placed(m)).when(m.isNotNull(), nothing))


# Vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, metric: str) -> Column:
    """cosine, l2 (the negative distance) or dot. Raises at run time for vectors of different sizes, and for zero vectors under cosine."""
    if metric == "dot":
        score = dot(a, b)
    elif metric == "l2":
        score = -F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    elif metric == "cosine":
        size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
        score = F.when(size == 0, F.raise_error(F.lit("cosine of a zero vector")).cast("double")).otherwise(dot(a, b) / size)
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different sizes")).cast("double")).otherwise(score)
