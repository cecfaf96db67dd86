"""Field lookup by alias over canonical columns, loose columns and the ``attrs`` map."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .text import WHITESPACE, blank_to_null, strip
from .times import normalize_timestamp

# Field aliases, first match wins.
LATENCY_ALIASES = (
    "latency", "duration", "response_time", "request_time", "time_taken", "latency_ms", "duration_ms",
)
REQUEST_SIZE_ALIASES = ("request_length", "request_size", "body_bytes_received")
RESPONSE_SIZE_ALIASES = ("size", "bytes_sent", "body_bytes_sent", "response_size")
CLIENT_IP_ALIASES = ("source_ip", "client_ip", "ip", "remote_addr")


def safe_int(col: Column) -> Column:
    """Whole number from text: spaces and quotes dropped, anything else NULL."""
    return F.btrim(strip(col.cast("string")), F.lit("\"'")).try_cast("bigint")


class Fields:
    """Columns of one record table, looked up by name.

    A name is a column of the table, else a key of its ``attrs`` map, else NULL.
    """

    def __init__(self, df: DataFrame):
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.has_attrs = isinstance(self.types.get("attrs"), T.MapType)

    def has(self, name: str) -> bool:
        return name in self.types

    def text(self, name: str) -> Column:
        """The value as text."""
        if name in self.types:
            return F.col(f"`{name}`").cast("string")
        if self.has_attrs:
            return F.col("attrs")[name]
        return F.lit(None).cast("string")

    def filled(self, name: str) -> Column:
        """The value as text, ``''`` read as absent."""
        return blank_to_null(self.text(name))

    def first_filled(self, *names: str) -> Column:
        return F.coalesce(*[self.filled(n) for n in names])

    def present(self, name: str) -> Column:
        """Whether the record carries the key."""
        if name in self.types:
            return F.col(f"`{name}`").isNotNull()
        if self.has_attrs:
            return F.coalesce(F.map_contains_key("attrs", F.lit(name)), F.lit(False))
        return F.lit(False)

    def number(self, names: tuple[str, ...] | list[str]) -> Column:
        """First of the aliases that reads as a number."""
        return F.coalesce(*[self._double(n) for n in names])

    def _double(self, name: str) -> Column:
        if isinstance(self.types.get(name), T.NumericType):
            return F.col(f"`{name}`").cast("double")
        return strip(self.text(name)).try_cast("double")

    def integer(self, name: str) -> Column:
        """Whole number, or NULL for anything that does not read as one."""
        if isinstance(self.types.get(name), T.NumericType):
            return F.col(f"`{name}`").cast("bigint")
        return safe_int(self.text(name))

    # -- derived fields --------------------------------------------------------------------------

    def is_bad(self) -> Column:
        if "parse_error" in self.types:
            return F.coalesce(F.col("parse_error"), F.lit(False))
        return F.lit(False)

    def client_ip(self) -> Column:
        return F.coalesce(self.first_filled(*CLIENT_IP_ALIASES), F.lit("-"))

    def listed_ip(self) -> Column:
        """Address as the distribution counts see it: two aliases only, ``-`` dropped."""
        ip = self.first_filled("source_ip", "ip")
        return F.when(ip != "-", ip)

    def endpoint(self) -> Column:
        """Path or request target, else the process name, else ``unknown``."""
        target = strip(self.first_filled("path", "request_path", "request"))
        words = F.split(target, rf"[{WHITESPACE}]+")
        named = F.when(
            blank_to_null(target).isNotNull(), F.coalesce(F.get(words, F.lit(1)), F.get(words, F.lit(0)))
        )
        process = self.first_filled("process", "service", "app")
        return F.coalesce(named, strip(process), F.lit("unknown"))

    def timestamp(self) -> Column:
        if isinstance(self.types.get("timestamp"), T.TimestampType):
            return F.col("timestamp")
        if isinstance(self.types.get("timestamp"), T.TimestampNTZType):
            return F.col("timestamp").cast("timestamp")
        return normalize_timestamp(self.text("timestamp"))

    def status(self) -> Column:
        """``status_code``, else ``status``; the second is read only where the first is absent."""
        return F.when(self.text("status_code").isNotNull(), self.integer("status_code")).otherwise(
            self.integer("status")
        )

    def status_or_200(self) -> Column:
        code = self.integer("status_code")
        return F.when(code != 0, code).otherwise(F.lit(200))

    def method(self) -> Column:
        return F.upper(F.coalesce(self.filled("method"), F.lit("GET")))

    def level(self) -> Column:
        return normalize_level(self.text("level"))

    def latency(self) -> Column:
        return self.number(LATENCY_ALIASES)

    def request_size(self) -> Column:
        return self.number(REQUEST_SIZE_ALIASES).cast("bigint")

    def response_size(self) -> Column:
        return self.number(RESPONSE_SIZE_ALIASES).cast("bigint")

    def session_size(self) -> Column:
        size = self.integer("size")
        return F.coalesce(F.when(size != 0, size), self.integer("bytes_sent"), F.lit(0))

    def volume(self) -> Column:
        """Bytes one record adds to the traffic volume.

        The size fields are read as a chain that skips empty and zero values, so a lone zero ``size``
        falls through to the length of the raw text, while a zero in the last field counts as zero.
        """
        def skipped(name: str) -> Column:
            text = self.filled(name)
            return F.when(~F.coalesce(text.try_cast("double") == 0, F.lit(False)) | self._is_text(name), text)

        chain = F.coalesce(skipped("size"), skipped("bytes_sent"), self.text("body_bytes_sent"))
        return F.when(chain.isNotNull(), F.coalesce(safe_int(chain), F.lit(0))).otherwise(
            F.coalesce(F.char_length(self.text("raw")), F.char_length(self.text("message")), F.lit(0))
        ).cast("bigint")

    def _is_text(self, name: str) -> Column:
        # Only a number can be a falsy zero; the text "0" is kept.
        return F.lit(isinstance(self.types.get(name), T.StringType))


# Levels that count as errors.
ERROR_LEVELS = ("ERROR", "CRITICAL", "FATAL", "SEVERE")


def normalize_level(col: Column) -> Column:
    """Upper-case, trimmed level; ``''`` gives NULL."""
    return F.when(col != "", strip(F.upper(col)))


def is_error_level(level: Column) -> Column:
    return F.coalesce(level.isin(*ERROR_LEVELS), F.lit(False))


# Severities from most to least severe.
SEVERITIES = ("critical", "high", "medium", "low", "info")


def severity_rank(col: Column) -> Column:
    """0 for critical up to 4 for info, 5 for anything else."""
    ranked = F.lit(len(SEVERITIES))
    for rank, name in reversed(list(enumerate(SEVERITIES))):
        ranked = F.when(F.lower(col) == name, F.lit(rank)).otherwise(ranked)
    return ranked


# Patterns that collapse identifiers in paths to a template.
PATH_TEMPLATES = ((r"^/api/v1/tasks/[^/]+$", "/api/v1/tasks/{task_id}"),)


def template_path(col: Column, templates: tuple[tuple[str, str], ...] = PATH_TEMPLATES) -> Column:
    """Path with its identifiers replaced, which bounds the number of distinct endpoints."""
    out = col
    for pattern, replacement in reversed(templates):
        out = F.when(col.rlike(pattern), F.lit(replacement)).otherwise(out)
    return out


# Visitor stages in funnel order, and the rest.
FUNNEL_STAGES = ("Landing", "Products", "Product", "Cart", "Checkout")
STAGES = FUNNEL_STAGES + ("Other",)
# The pages of each stage, by their whole path, how it starts, or how it ends.
STAGE_PAGES = (
    ("Landing", "is", ("", "/home", "/index.html", "/index.htm", "/index")),
    ("Products", "starts", ("/products", "/catalog", "/category", "/search")),
    ("Product", "starts", ("/product", "/item", "/details")),
    ("Cart", "ends", ("/cart", "/shopping-cart")),
    ("Checkout", "starts", ("/checkout", "/pay", "/billing", "/purchase")),
)


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def journey_stage(path: Column) -> Column:
    """Stage of a visit that a path belongs to: the first one that has such a page."""
    page = F.rtrim(F.substring_index(F.lower(path), "?", 1), F.lit("/"))
    tests = {"is": lambda w: page == w, "starts": lambda w: F.startswith(page, F.lit(w)), "ends": lambda w: F.endswith(page, F.lit(w))}
    out = F.lit(STAGES[-1])
    for stage, how, words in reversed(STAGE_PAGES):
        out = F.when(_any(map(tests[how], words)), stage).otherwise(out)
    return out


def record_id(fields: Fields, line_no: Column) -> Column:
    """Stable identifier: time, address, line number and a 31-multiplier hash of the raw text."""
    raw = F.coalesce(fields.text("raw"), F.lit(""))
    # Signed 32-bit wrap after every step, as the textbook string hash does.
    step = lambda acc, ch: ((acc * 31 + F.ascii(ch) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648
    # ascii() gives the code point of the character.
    hashed = F.aggregate(F.split(raw, ""), F.lit(0).cast("bigint"), step)
    stamp = F.coalesce(F.date_format(fields.timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
    ip = F.coalesce(fields.first_filled("client_ip", "source_ip", "ip"), F.lit(""))
    return F.concat_ws("_", stamp, ip, line_no.cast("string"), F.abs(hashed).cast("string"))
