"""Security signatures and per-client indicators."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fields import Fields
from ..functions.text import WHITESPACE, contains_any, url_decode_lenient
from .context import AnalysisContext
from .grouping import Keys, ranked_per_key, ratio

#: White space in signatures: beyond ASCII, too.
_BLANK = f"[{WHITESPACE}]"

# Payload signatures by class, probe paths, automation agents, tools and watched targets.
_PATTERNS = {
    "sqli": r"(?iu)union\s+select|union\s+all\s+select|or\s+1\s*=\s*1|or\s+'1'\s*=\s*'1'",
    "xss": r"(?iu)<script|javascript:|onerror\s*=|onload\s*=",
    "traversal": r"(?iu)\.\./|\.\.\\|%2e%2e",
    "rce": r"(?iu)\$\{jndi:|cmd\s*=|powershell|base64",
}
SIGNATURES = {name: pattern.replace(r"\s", _BLANK) for name, pattern in _PATTERNS.items()}
PROBE_PATHS = (
    r"(?iu)\.env|\.git|wp-admin|wp-login\.php|config\.php|backup\.zip|phpinfo|cgi-bin|setup\.php|admin/config"
)
# Words without which a signature cannot match (lower case): one of the groups, every word of it.
_NEEDED = {
    "sqli": (("union",), ("or", "=")),
    "xss": (("<script",), ("javascript:",), ("onerror",), ("onload",)),
    "traversal": (("../",), ("..\\",), ("%2e%2e",)),
    "rce": (("${jndi:",), ("cmd", "="), ("powershell",), ("base64",)),
}
_NEEDED_IN_PROBE = tuple((word,) for word in (
    ".env", ".git", "wp-admin", "wp-login.php", "config.php", "backup.zip", "phpinfo", "cgi-bin", "setup.php", "admin/config",
))
AUTOMATION_AGENTS = ("headlesschrome", "phantomjs", "puppeteer", "selenium", "playwright")
WATCHED_TARGETS = ("/wp-admin", "/.env", "/.git", "/api/v1/auth/login", "/config.php", "backup.zip")
TOOLS = ("Nikto", "Playwright (headless)", "Go-http-client", "curl")


def _gated(text: Column, lower: Column, ascii_only: Column, pattern: str, needed: tuple[tuple[str, ...], ...]) -> Column:
    """``text.rlike(pattern)``, the pattern run only where the words it needs are there.

    Case folding beyond ASCII is left to the pattern: such text always runs it.
    """
    possible = reduce(or_, [reduce(and_, [F.contains(lower, F.lit(w)) for w in group]) for group in needed])
    return F.when(ascii_only & ~possible, F.lit(False)).otherwise(text.rlike(pattern))


def security_signals(records: DataFrame, keys: Keys = [], also: dict[str, Column] | None = None) -> DataFrame:
    """Records that parsed, with one boolean per signature and indicator. The payload is decoded once."""
    f = Fields(records)
    path = F.coalesce(f.text("path"), F.lit(""))
    payload = url_decode_lenient(
        F.concat_ws(" ", path, F.coalesce(f.text("query_string"), F.lit("")), F.coalesce(f.text("raw"), F.lit("")))
    )
    agent = F.coalesce(f.text("user_agent"), F.lit(""))
    rows = records.where(~f.is_bad()).select(
        *keys,
        *[c.alias(n) for n, c in (also or {}).items()],
        f.client_ip().alias("client_ip"),
        path.alias("path"),
        f.status_or_200().alias("status_code"),
        agent.alias("_agent"),
        payload.alias("_payload"),
    ).withColumns({
        "_lower": F.lower("_payload"),
        "_ascii": F.octet_length("_payload") == F.char_length("_payload"),
        "_lower_path": F.lower("path"),
        "_ascii_path": F.octet_length("path") == F.char_length("path"),
    })
    no_agent = (F.col("_agent") == "") | (F.col("_agent") == "-")
    return rows.withColumns({
        **{
            name: _gated(F.col("_payload"), F.col("_lower"), F.col("_ascii"), pattern, _NEEDED[name])
            for name, pattern in SIGNATURES.items()
        },
        "probe": _gated(F.col("path"), F.col("_lower_path"), F.col("_ascii_path"), PROBE_PATHS, _NEEDED_IN_PROBE),
        "not_found": F.col("status_code") == 404,
        "no_agent": no_agent,
        "headless": ~no_agent & contains_any(F.lower("_agent"), AUTOMATION_AGENTS),
    }).drop("_payload", "_lower", "_ascii", "_lower_path", "_ascii_path")


def injection_counts(records: DataFrame, keys: Keys = []) -> DataFrame:
    """Records per signature class; one record may count in several."""
    return security_signals(records, keys).groupBy(*keys).agg(
        F.count_if("sqli").alias("sql_injection_count"),
        F.count_if("xss").alias("xss_injection_count"),
        F.count_if("traversal").alias("path_traversal_count"),
        F.count_if("rce").alias("rce_cmd_injection_count"),
    )


def injection_hits(records: DataFrame, keys: Keys = []) -> DataFrame:
    """Records that carry a signature, one row per class."""
    signals = security_signals(records, keys, {"line_id": F.col("line_id")})
    classes = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in SIGNATURES]))
    return signals.select(
        *keys, "line_id", "client_ip", "path", F.explode(classes).alias("signature")
    )


def scanner_hits(records: DataFrame, keys: Keys = []) -> DataFrame:
    """Probe requests per client, unnamed clients included."""
    f = Fields(records)
    return (
        records.where(~f.is_bad() & f.text("path").rlike(PROBE_PATHS))
        .groupBy(*keys, f.client_ip().alias("client_ip"))
        .agg(F.count(F.lit(1)).alias("hits"))
    )


def top_scanners(records: DataFrame, keys: Keys = [], n: int = 5) -> DataFrame:
    return ranked_per_key(scanner_hits(records, keys), keys, [F.desc("hits"), F.asc("client_ip")], n)


def distinct_endpoints_per_ip(records: DataFrame, keys: Keys = [], approx: bool = False) -> DataFrame:
    """Distinct raw paths per named client; ``approx`` keeps a fixed-size sketch per client instead."""
    f = Fields(records)
    count = F.approx_count_distinct if approx else F.count_distinct
    return (
        records.where(~f.is_bad())
        .select(*keys, f.client_ip().alias("client_ip"), F.coalesce(f.text("path"), F.lit("")).alias("path"))
        .where(F.col("client_ip") != "-")
        .groupBy(*keys, "client_ip").agg(count(F.col("path")).alias("distinct_endpoints"))
    )


def error_404_ratio(records: DataFrame, keys: Keys = []) -> DataFrame:
    """404 answers in percent of all records, bad lines included."""
    f = Fields(records)
    missing = F.count_if(~f.is_bad() & (f.status_or_200() == 404))
    return records.groupBy(*keys).agg(
        F.round(ratio(missing, F.count(F.lit(1))) * 100.0, 2).alias("error_404_ratio")
    )


def bot_user_agents(records: DataFrame, keys: Keys = []) -> DataFrame:
    return security_signals(records, keys).groupBy(*keys).agg(
        F.count_if("no_agent").alias("missing_user_agent_count"),
        F.count_if("headless").alias("headless_fingerprints_count"),
    )


# -- over sessions -----------------------------------------------------------------------------------


def named(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("client_ip") != "-")


def failed_logins_per_ip(sessions: DataFrame, keys: Keys = []) -> DataFrame:
    """Failed logins per named client, clients without any left out."""
    return (
        named(sessions).groupBy(*keys, "client_ip").agg(F.sum("failed_logins").alias("failed_logins"))
        .where(F.col("failed_logins") > 0)
    )


def lockout_candidates(sessions: DataFrame, keys: Keys = [], ctx: AnalysisContext = AnalysisContext()) -> DataFrame:
    """Clients with too many failures within one session."""
    return named(sessions).where(F.col("failed_logins") > ctx.failed_logins).select(*keys, "client_ip").distinct()


def login_failure_ratio(sessions: DataFrame, keys: Keys = []) -> DataFrame:
    """Failures in percent of login POSTs, over named clients; refusals elsewhere can push it past 100."""
    in_scope = F.col("client_ip") != "-"
    failures = F.coalesce(F.sum(F.when(in_scope, F.col("failed_logins"))), F.lit(0))
    logins = F.coalesce(F.sum(F.when(in_scope, F.col("login_posts"))), F.lit(0))
    return sessions.groupBy(*keys).agg(F.round(ratio(failures, logins) * 100.0, 2).alias("failure_ratio"))


def requests_per_minute_per_ip(sessions: DataFrame, keys: Keys = []) -> DataFrame:
    """Fastest session of each named client; durations below three seconds count as three."""
    minutes = F.greatest(F.col("duration_seconds") / 60.0, F.lit(0.05))
    return named(sessions).groupBy(*keys, "client_ip").agg(
        F.round(F.max(F.col("request_count") / minutes), 2).alias("requests_per_minute")
    )


# -- profiles ----------------------------------------------------------------------------------------

# Threat labels.
THREAT_LABELS = {
    "critical": "Critical Security Alert",
    "scanning": "High Scanning Activity",
    "bot": "Suspicious Bot Behavior",
    "low": "Low Risk Profile",
}


def threat_level(metrics: DataFrame) -> Column:
    """Label from the wide metric columns (see ``metrics_wide``)."""
    m = lambda name: F.coalesce(F.col(f"`{name}`"), F.lit(0.0))
    prefix = "security.injection_metrics."
    injections = (
        m(prefix + "sql_injection_count") + m(prefix + "xss_injection_count")
        + m(prefix + "path_traversal_count") + m(prefix + "rce_cmd_injection_count")
    )
    return (
        F.when((injections > 0) | (m("security.brute_force.lockout_candidates_count") > 0), THREAT_LABELS["critical"])
        .when(
            (m("security.scanner_metrics.scanner_hits_count") > 0) | (m("security.enumeration.error_404_ratio") > 15),
            THREAT_LABELS["scanning"],
        )
        .when(
            (m("security.bot_metrics.headless_fingerprints_count") > 0) | (m("security.brute_force.failure_ratio") > 20),
            THREAT_LABELS["bot"],
        )
        .otherwise(THREAT_LABELS["low"])
    )


def tool_flags(agent: Column) -> dict[str, Column]:
    """Tool name to test on the user agent."""
    return {
        "Nikto": F.contains(agent, F.lit("Nikto")),
        "Playwright (headless)": contains_any(agent, ("Playwright", "Headless")),
        "Go-http-client": F.contains(agent, F.lit("Go-http-client")),
        "curl": F.contains(F.lower(agent), F.lit("curl")),
    }


def suspected_tools(records: DataFrame, keys: Keys = []) -> DataFrame:
    """Tools seen per client, long form."""
    f = Fields(records)
    agent = F.coalesce(f.text("user_agent"), F.lit(""))
    tools = F.array_compact(F.array(*[F.when(test, F.lit(t)) for t, test in tool_flags(agent).items()]))
    return (
        records.select(*keys, f.client_ip().alias("client_ip"), F.explode(tools).alias("tool")).distinct()
    )


def observed_targets(records: DataFrame, keys: Keys = []) -> DataFrame:
    """Watched paths that were requested, with counts."""
    return (
        records.where(Fields(records).text("path").isin(*WATCHED_TARGETS))
        .groupBy(*keys, F.col("path").alias("target")).agg(F.count(F.lit(1)).alias("requests"))
    )


