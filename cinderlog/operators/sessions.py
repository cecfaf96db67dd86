"""Sessions and journeys.

A session ends where one client is silent for longer than the gap. Two requests in the same time slot no
wider than the gap are never apart by more than the gap, so a session can only break between slots.
Records are therefore first combined per client and slot (before the shuffle), and only these slot rows
are put in time order: their number depends on the time span, not on how many requests a client sent. A
client that owns a third of all rows is no heavier than the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fields import FUNNEL_STAGES, STAGES, Fields, journey_stage
from ..functions.text import contains_any
from ..session import through_table
from .context import AnalysisContext
from .grouping import BUCKETS, OFTEN, Keys, join_dealt, join_on, ratio, with_totals

# Words that mark a login path, and statuses that mark a refused request.
LOGIN_WORDS = ("login", "auth", "signin")
REFUSED = (401, 403)


def visits(records: DataFrame, keys: Keys = []) -> DataFrame:
    """Requests that can belong to a session, with the defaults a session request has."""
    f = Fields(records)
    path = F.coalesce(f.filled("path"), F.lit("/"))
    return (
        records.where(~f.is_bad())
        .select(
            *keys,
            F.col("line_id"),
            f.client_ip().alias("client_ip"),
            f.timestamp().alias("time"),
            f.method().alias("method"),
            path.alias("path"),
            f.status_or_200().alias("status_code"),
            f.session_size().alias("size"),
        )
        .where(F.col("time").isNotNull())
    )


def is_login_path(path: Column) -> Column:
    return contains_any(F.lower(path), LOGIN_WORDS)


def is_failed_login(method: Column, path: Column, status: Column) -> Column:
    """Refused anywhere, or an error answer to a POST on a login path."""
    return status.isin(*REFUSED) | ((method == "POST") & is_login_path(path) & (status >= 400))


def _marked_visits(records: DataFrame, keys: Keys) -> DataFrame:
    """Visits with everything a session sums up, each worked out once per request."""
    login = F.col("_login")
    post = F.col("method") == "POST"
    return (
        visits(records, keys)
        .withColumns({"_login": is_login_path(F.col("path")), "_stage": journey_stage(F.col("path"))})
        .withColumns({
            "refused": F.col("status_code").isin(*REFUSED).cast("bigint"),
            "login_posts": (post & login).cast("bigint"),
            "failed_logins": (F.col("status_code").isin(*REFUSED) | (post & login & (F.col("status_code") >= 400))).cast("bigint"),
            **{f"saw_{s.lower()}": (F.col("_stage") == s).cast("int") for s in FUNNEL_STAGES},
        })
        .drop("_login", "_stage")
    )


#: Lines of a block of a busy second.
_LINES = 1 << 14
_ADDED = ("failed_logins", "login_posts", "refused")
_SEEN = tuple(f"saw_{s.lower()}" for s in FUNNEL_STAGES)


def slot_of(time: Column, seconds: int) -> Column:
    """Number of the stretch of ``seconds`` that a time is in."""
    return F.floor(F.unix_micros(time) / (seconds * 1_000_000)).cast("bigint")


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1_000_000.0


def session_slots(records: DataFrame, keys: Keys = [], gap: int = 1800) -> DataFrame:
    """Named clients' requests per client and slot, numbered with the session they belong to."""
    slots = (
        _marked_visits(records, keys)
        .where(F.col("client_ip") != "-")
        .withColumn("slot", slot_of(F.col("time"), gap))
        .groupBy(*keys, "client_ip", "slot")
        .agg(
            F.min("time").alias("start_time"), F.max("time").alias("end_time"),
            F.count(F.lit(1)).alias("request_count"),
            *[F.sum(n).alias(n) for n in _ADDED], *[F.max(n).alias(n) for n in _SEEN],
        )
    )
    return number_sessions(slots, keys, gap)


def number_sessions(slots: DataFrame, keys: Keys, gap: int) -> DataFrame:
    """Add ``session_index`` to slots of clients, which have ``start_time`` and ``end_time``."""
    w = Window.partitionBy(*keys, "client_ip").orderBy("slot")
    before = F.lag("end_time").over(w)
    opens = F.when(before.isNotNull() & (_seconds(F.col("start_time"), before) > gap), 1).otherwise(0)
    return slots.withColumn("_opens", opens).withColumn(
        "session_index", F.sum("_opens").over(w).cast("bigint")
    ).drop("_opens")


def _session_id(ip: Column, index: Column) -> Column:
    return F.concat_ws("_", F.lit("session"), F.replace(ip, F.lit("."), F.lit("_")), index.cast("string"))


def session_table(
    records: DataFrame, keys: Keys = [], ctx: AnalysisContext = AnalysisContext(), slots: DataFrame | None = None
) -> DataFrame:
    """One row per session: id, client, start, end, duration and counts.

    Requests of unnamed clients (``-``) are sessions of their own, named after their line. ``slots`` is
    ``session_slots`` where the caller has it already.
    """
    named = (
        (session_slots(records, keys, ctx.session_gap_seconds) if slots is None else slots)
        .groupBy(*keys, "client_ip", "session_index")
        .agg(
            F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
            F.sum("request_count").alias("request_count"),
            *[F.sum(n).alias(n) for n in _ADDED], *[F.max(n).alias(n) for n in _SEEN],
        )
        .withColumn("session_id", _session_id(F.col("client_ip"), F.col("session_index")))
    )
    single = _marked_visits(records, keys).where(F.col("client_ip") == "-")
    unnamed = single.select(
        *keys,
        "client_ip",
        F.lit(0).cast("bigint").alias("session_index"),
        F.col("time").alias("start_time"),
        F.col("time").alias("end_time"),
        F.lit(1).cast("bigint").alias("request_count"),
        *_ADDED,
        *_SEEN,
        F.concat(F.lit("session_anon_"), F.col("line_id").cast("string")).alias("session_id"),
    )
    return named.unionByName(unnamed).withColumn(
        "duration_seconds", _seconds(F.col("end_time"), F.col("start_time"))
    )


def session_paths(
    records: DataFrame, keys: Keys = [], ctx: AnalysisContext = AnalysisContext(), slots: DataFrame | None = None
) -> DataFrame:
    """Distinct paths per named session. Paths are made distinct per slot first, so slots stay small."""
    gap = ctx.session_gap_seconds
    seen = (
        visits(records, keys)
        .where(F.col("client_ip") != "-")
        .select(*keys, "client_ip", slot_of(F.col("time"), gap).alias("slot"), "path")
        .distinct()
    )
    slots = session_slots(records, keys, gap) if slots is None else slots
    numbered = slots.select(*keys, "client_ip", "slot", "session_index")
    return (
        join_on(seen, numbered, [*keys, "client_ip", "slot"])
        .groupBy(*keys, "client_ip", "session_index")
        .agg(F.count_distinct("path").alias("distinct_paths"))
    )


def sessions_with_paths(records: DataFrame, keys: Keys = [], ctx: AnalysisContext = AnalysisContext()) -> DataFrame:
    """``session_table`` with ``distinct_paths``; an unnamed request has one path."""
    # Written: two jobs read the numbered slots, which are few and costly to number.
    slots = through_table(session_slots(records, keys, ctx.session_gap_seconds), "slots")
    table = session_table(records, keys, ctx, slots)
    # Unnamed requests stay out of the join: all of them share one address.
    named = join_on(
        table.where(F.col("client_ip") != "-"), session_paths(records, keys, ctx, slots), [*keys, "client_ip", "session_index"]
    )
    return named.unionByName(table.where(F.col("client_ip") == "-").withColumn("distinct_paths", F.lit(1).cast("bigint")))


def session_requests(records: DataFrame, keys: Keys = [], ctx: AnalysisContext = AnalysisContext()) -> DataFrame:
    """Every request with its session and stage: the long form of a session's request list."""
    gap = ctx.session_gap_seconds
    rows = visits(records, keys).withColumn("journey_stage", journey_stage(F.col("path")))
    # Read for the sizes of the slots and for their numbers.
    numbered = through_table(
        session_slots(records, keys, gap).select(*keys, "client_ip", "slot", "session_index", "request_count"), "slots"
    )
    columns = [*keys, "line_id", "client_ip", "time", "method", "path", "status_code", "size", "journey_stage"]
    named = (
        join_dealt(
            rows.where(F.col("client_ip") != "-").withColumn("slot", slot_of(F.col("time"), gap)),
            numbered, [*keys, "client_ip", "slot"], F.col("request_count"),
        )
        .select(*columns, _session_id(F.col("client_ip"), F.col("session_index")).alias("session_id"))
    )
    unnamed = rows.where(F.col("client_ip") == "-").select(
        *columns, F.concat(F.lit("session_anon_"), F.col("line_id").cast("string")).alias("session_id")
    )
    return named.unionByName(unnamed)


# -- measures over sessions ------------------------------------------------------------------------


def is_bot(ctx: AnalysisContext) -> Column:
    n, d = F.col("request_count"), F.col("duration_seconds")
    fast = (d > ctx.bot_min_seconds) & (n / (d / 60.0) > ctx.bot_requests_per_minute)
    return (n > ctx.bot_requests) | F.coalesce(F.when(d > 0, fast), F.lit(False))


def session_metrics(sessions: DataFrame, keys: Keys = [], ctx: AnalysisContext = AnalysisContext()) -> DataFrame:
    """Durations, bounce rate, pages and requests per session and behaviour counts, two decimals."""
    total = F.count(F.lit(1))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 2)
    return sessions.groupBy(*keys).agg(
        total.alias("active_sessions_count"),
        mean("duration_seconds").alias("average_session_duration_seconds"),
        F.round(F.coalesce(F.max("duration_seconds"), F.lit(0.0)), 2).alias("longest_session_duration_seconds"),
        F.round(F.when(total > 0, F.count_if(F.col("request_count") == 1) / total * 100.0).otherwise(0.0), 2)
        .alias("bounce_rate"),
        mean("distinct_paths").alias("pages_per_session"),
        mean("request_count").alias("requests_per_session"),
        F.count_if(is_bot(ctx)).alias("possible_bot_count"),
        F.count_if(F.col("failed_logins") > ctx.failed_logins).alias("credential_stuffing_count"),
        F.count_if(F.col("distinct_paths") > ctx.distinct_paths).alias("endpoint_enumeration_count"),
    )


def session_rollup(sessions: DataFrame, keys: Keys = [], ctx: AnalysisContext = AnalysisContext()) -> DataFrame:
    """Session measures, funnel reach and failed-login measures from one reading of the sessions.

    Sessions are first combined per client, so the counts of clients are plain sums, however many there are.
    """
    is_named = F.col("client_ip") != "-"
    failures = F.col("failed_logins")
    clients = sessions.groupBy(*keys, "client_ip").agg(
        F.count(F.lit(1)).alias("_sessions"),
        F.sum("duration_seconds").alias("_duration"),
        F.max("duration_seconds").alias("_longest"),
        F.count_if(F.col("request_count") == 1).alias("_bounces"),
        F.sum("distinct_paths").alias("_pages"),
        F.sum("request_count").alias("_requests"),
        F.count_if(is_bot(ctx)).alias("_bots"),
        F.count_if(failures > ctx.failed_logins).alias("_stuffing"),
        F.count_if(F.col("distinct_paths") > ctx.distinct_paths).alias("_enumerating"),
        *[F.sum(seen).alias(seen) for seen in _SEEN],
        F.sum(failures).alias("_failures"),
        F.sum("login_posts").alias("_posts"),
    )
    total = F.sum("_sessions")
    named_sum = lambda c: F.coalesce(F.sum(F.when(is_named, F.col(c))), F.lit(0))
    return clients.groupBy(*keys).agg(
        total.alias("active_sessions_count"),
        F.round(F.coalesce(F.sum("_duration") / total, F.lit(0.0)), 2).alias("average_session_duration_seconds"),
        F.round(F.coalesce(F.max("_longest"), F.lit(0.0)), 2).alias("longest_session_duration_seconds"),
        F.round(F.coalesce(F.sum("_bounces") / total * 100.0, F.lit(0.0)), 2).alias("bounce_rate"),
        F.round(F.coalesce(F.sum("_pages") / total, F.lit(0.0)), 2).alias("pages_per_session"),
        F.round(F.coalesce(F.sum("_requests") / total, F.lit(0.0)), 2).alias("requests_per_session"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (
            ("_bots", "possible_bot_count"), ("_stuffing", "credential_stuffing_count"),
            ("_enumerating", "endpoint_enumeration_count"))],
        *[F.coalesce(F.sum(seen), F.lit(0)).alias(seen) for seen in _SEEN],
        F.round(ratio(named_sum("_failures"), named_sum("_posts")) * 100.0, 2).alias("failure_ratio"),
        F.count_if(is_named & (F.col("_stuffing") > 0)).alias("lockout_candidates_count"),
        F.count_if(is_named & (F.col("_failures") > 0)).alias("failing_ip_count"),
    )


def bot_sessions(sessions: DataFrame, ctx: AnalysisContext = AnalysisContext()) -> DataFrame:
    return sessions.where(is_bot(ctx))


def credential_stuffing_sessions(sessions: DataFrame, ctx: AnalysisContext = AnalysisContext()) -> DataFrame:
    return sessions.where(F.col("failed_logins") > ctx.failed_logins)


def endpoint_enumeration_sessions(sessions: DataFrame, ctx: AnalysisContext = AnalysisContext()) -> DataFrame:
    return sessions.where(F.col("distinct_paths") > ctx.distinct_paths)


def session_alerts(sessions: DataFrame, ctx: AnalysisContext = AnalysisContext()) -> DataFrame:
    """Sessions with a risk flag: many requests, many refusals, many paths."""
    return sessions.withColumns({
        "bot_risk": F.col("request_count") > ctx.bot_requests,
        "stuffing_risk": F.col("refused") > ctx.failed_logins,
        "enumeration_risk": F.col("distinct_paths") > ctx.distinct_paths,
    }).where(F.col("bot_risk") | F.col("stuffing_risk") | F.col("enumeration_risk"))


def recent_sessions(sessions: DataFrame, n: int) -> DataFrame:
    """Newest sessions by start."""
    return sessions.orderBy(F.desc("start_time"), "session_id").limit(n)


# -- journeys ----------------------------------------------------------------------------------------


def stage_counts(records: DataFrame, keys: Keys = []) -> DataFrame:
    """Session requests per stage, zeros kept."""
    rows = visits(records, keys).select(*keys, journey_stage(F.col("path")).alias("_stage"))
    wide = rows.groupBy(*keys).agg(*[F.count_if(F.col("_stage") == s).alias(s) for s in STAGES])
    pairs = [F.struct(F.lit(s).alias("stage"), F.col(s).alias("requests")) for s in STAGES]
    return wide.select(*keys, F.inline(F.array(*pairs)))


def funnel_reach(sessions: DataFrame, keys: Keys = []) -> DataFrame:
    """Sessions that touched each funnel stage, in any order, zeros kept."""
    wide = sessions.groupBy(*keys).agg(
        *[F.coalesce(F.sum(f"saw_{s.lower()}"), F.lit(0)).alias(s) for s in FUNNEL_STAGES]
    )
    pairs = [
        F.struct(F.lit(i + 1).alias("position"), F.lit(s).alias("stage"), F.col(s).alias("sessions"))
        for i, s in enumerate(FUNNEL_STAGES)
    ]
    return wide.select(*keys, F.inline(F.array(*pairs)))


def funnel_conversion(sessions: DataFrame, keys: Keys = []) -> DataFrame:
    """Reach of each stage in percent of the fullest stage and of the first."""
    reach = funnel_reach(sessions, keys)
    most = reach.groupBy(*keys).agg(
        F.greatest(F.max("sessions"), F.lit(1)).alias("_most"),
        F.max(F.when(F.col("position") == 1, F.col("sessions"))).alias("_first"),
    )
    joined = with_totals(reach, most, keys)
    return joined.select(
        *keys, "stage", "sessions",
        (F.col("sessions") / F.col("_most") * 100.0).alias("pct_of_fullest"),
        F.when(F.col("_first") > 0, F.col("sessions") / F.col("_first") * 100.0).otherwise(0.0).alias("pct_of_landing"),
    )


def _stretch(hot: Column) -> list[Column]:
    """Stretch of a slot that a request is in, in the order of time and line: one for all of a slot that is not ``hot``.

    Hot slots are cut by hundredths of a second; requests dated to whole seconds, which come first in theirs, by blocks of lines as well.
    """
    micros = F.unix_micros("time")
    block = F.when(micros % 1_000_000 == 0, F.floor(F.col("line_id") / _LINES)).otherwise(F.lit((1 << 62)))
    zero = F.lit(0).cast("bigint")
    return [
        F.when(hot, F.floor(micros / 10_000)).otherwise(zero).cast("bigint").alias("_at"),
        F.when(hot, block).otherwise(zero).cast("bigint").alias("_block"),
    ]


def _chained(edges: DataFrame, w) -> DataFrame:
    """Add to stretches in order whether their first step goes on with the last one before (``_joins``), and the steps before them."""
    joins = F.coalesce((F.lag("_last").over(w) == F.col("_first")).cast("int"), F.lit(0))
    edges = edges.withColumn("_joins", joins).withColumn("_own", F.col("_steps") - F.col("_joins"))
    return edges.withColumn("_before", F.sum("_own").over(w) - F.col("_own"))


def journey_steps(
    records: DataFrame, keys: Keys = [], ctx: AnalysisContext = AnalysisContext(), slot_seconds: int = 60, often: int = OFTEN
) -> DataFrame:
    """Stages in visiting order with repeats collapsed: one row per step, ``step`` from 1 in each session.

    Rows are ordered within short slots of one client, and a slot with more than ``often`` rows within short stretches of it. Stretches are
    joined end to end through one row each (first stage, last stage, steps), then slots in the same way, so no task has to order a whole
    session, nor a busy minute. ``slot_seconds`` must not exceed the session gap.
    """
    if slot_seconds > ctx.session_gap_seconds:
        raise ValueError("slot_seconds must not exceed the session gap")
    rows = visits(records, keys).withColumn("stage", journey_stage(F.col("path")))
    part = [*keys, "client_ip", "slot"]
    named = rows.where(F.col("client_ip") != "-").withColumn("slot", slot_of(F.col("time"), slot_seconds))
    named = named.select(*part, "time", "line_id", "stage").withColumn("_bucket", F.pmod(F.xxhash64(*part), F.lit(BUCKETS)))
    # At most BUCKETS numbers: buckets of slots that hold many rows.
    busy = F.broadcast(named.groupBy("_bucket").count().where(F.col("count") > often).select("_bucket", F.lit(True).alias("_hot")))
    named = named.join(busy, "_bucket", "left")
    named = named.select(*part, "time", "line_id", "stage", *_stretch(F.coalesce("_hot", F.lit(False))))
    stretch = [*part, "_at", "_block"]
    inside = Window.partitionBy(*stretch).orderBy("time", "line_id")
    previous = F.lag("stage").over(inside)
    marked = (
        named.withColumn("_starts", F.when(previous.isNull() | (previous != F.col("stage")), 1).otherwise(0))
        .withColumn("_nth", F.sum("_starts").over(inside))
        .withColumn("_end", F.max("time").over(Window.partitionBy(*stretch)))
        .where(F.col("_starts") == 1)
        .drop("_starts")
    )
    # Only rows that start a step are left. They are read twice below; written, the log is ordered once.
    starts = through_table(marked, "steps")
    order = F.struct("time", "line_id")
    stretches = _chained(
        starts.groupBy(*stretch).agg(
            F.min("time").alias("start_time"), F.max("_end").alias("end_time"),
            F.min_by("stage", order).alias("_first"), F.max_by("stage", order).alias("_last"),
            F.count(F.lit(1)).alias("_steps"),
        ),
        Window.partitionBy(*part).orderBy("_at", "_block"),
    )
    stretches = through_table(stretches, "stretches")
    place = F.struct("_at", "_block")
    slots = number_sessions(
        stretches.groupBy(*part).agg(
            F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
            F.min_by("_first", place).alias("_first"), F.max_by("_last", place).alias("_last"), F.sum("_own").alias("_steps"),
        ),
        keys, ctx.session_gap_seconds,
    )
    slots = _chained(slots, Window.partitionBy(*keys, "client_ip", "session_index").orderBy("slot"))
    slots = slots.select(*part, "session_index", "_steps", F.col("_joins").alias("_slot_joins"), F.col("_before").alias("_slot_before"))
    placed = join_on(stretches.select(*stretch, "_joins", "_before"), slots.drop("_steps"), part)
    nth = F.col("_before") + F.col("_nth") - F.col("_joins")
    steps = (
        join_on(starts.select(*stretch, "_nth", "stage"), placed, stretch)
        .where((F.col("_nth") > F.col("_joins")) & (nth > F.col("_slot_joins")))
        .select(
            *keys, "client_ip",
            _session_id(F.col("client_ip"), F.col("session_index")).alias("session_id"),
            (F.col("_slot_before") + nth - F.col("_slot_joins")).cast("bigint").alias("step"),
            "stage",
        )
    )
    unnamed = rows.where(F.col("client_ip") == "-").select(
        *keys, "client_ip",
        F.concat(F.lit("session_anon_"), F.col("line_id").cast("string")).alias("session_id"),
        F.lit(1).cast("bigint").alias("step"), "stage",
    )
    return steps.unionByName(unnamed)
