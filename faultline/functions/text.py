"""Text normalization, field extraction and metric-name rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(c: Column) -> Column:
    """Lower case without URLs, mail addresses and punctuation; accents stay."""
    text = F.lower(F.coalesce(c, F.lit("")))
    # What is blanked out, in this order. A mail address can only begin where a run without blanks does, and is sought nowhere else, as
    # that is quadratic in the run. What is left between other characters is joined by single blanks.
    for pattern in (r"http\S+|www\S+", r"(?<!\S)\S+@\S+"):
        text = F.regexp_replace(text, pattern, " ")
    return F.concat_ws(" ", F.regexp_extract_all(text, F.lit("[a-zA-ZÀ-ÿ0-9]+"), F.lit(0)))


def normalize_text(c: Column) -> Column:
    """Form used to find equal texts: lower, single blanks, no edge punctuation."""
    flat = F.regexp_replace(F.trim(F.lower(F.coalesce(c, F.lit("")))), r"\s+", " ")
    return F.regexp_replace(flat, r"^[ .,!?;:]+|[ .,!?;:]+$", "")


def combine_text(*columns: str) -> Column:
    """Non-empty parts joined by a blank."""
    return F.concat_ws(" ", *[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns])


# Field names of a stored ticket document.
FIELDS = {"type": "Type", "queue": "Queue", "priority": "Priority", "language": "Language", "historical_solution": "Historical solution"}


def parse_document(c: Column) -> dict[str, Column]:
    """Fields of a 'Key: value' document; missing and empty ones are null."""
    return {
        name: F.nullif(F.trim(F.regexp_extract(c, rf"(?i){label}:\s*(.+?)(?=\n|$)", 1)), F.lit(""))
        for name, label in FIELDS.items()
    }


# Metric types by file-name part, first match wins.
METRIC_TYPES = [
    (["docker_cpu_total_norm_pct"], "docker_cpu_total_norm_pct"),
    (["docker_memory_usage_pct"], "docker_memory_usage_pct"),
    (["docker_memory_usage_total"], "docker_memory_usage_total"),
    (["docker_memory_stats_active_anon"], "docker_memory_stats_active_anon"),
    (["docker_cpu"], "docker_cpu"),
    (["docker_memory"], "docker_memory"),
    (["system_cpu"], "system_cpu"),
    (["system_memory"], "system_memory"),
    (["system_load"], "system_load"),
    (["load"], "load"),
    (["network", "net_"], "network"),
    (["disk", "diskio", "io_"], "disk_io"),
    (["filesystem"], "filesystem"),
    (["cpu"], "cpu"),
    (["memory"], "memory"),
]
METRIC_GROUPS = [
    (["network"], "network"),
    (["diskio"], "disk_io"),
    (["docker_cpu", "system_cpu", "_cpu_"], "cpu"),
    (["docker_memory", "system_memory"], "memory"),
    (["load"], "load"),
    (["filesystem"], "filesystem"),
]


def first_part(name: Column, rules: list[tuple[list[str], str]], otherwise: str | None) -> Column:
    """Result of the first rule with a part contained in the lower-cased name."""
    text, out = F.lower(name), F.lit(otherwise)
    for parts, result in reversed(rules):
        hit = F.lit(False)
        for part in parts:
            hit = hit | text.contains(part)
        out = F.when(hit, F.lit(result)).otherwise(out)
    return out


def metric_scope(name: Column) -> Column:
    return first_part(name, [(["docker_"], "docker"), (["system_"], "system")], "service")


def metric_period(name: Column) -> Column:
    found = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2}_\d{4}-\d{2}-\d{2})", 1)
    return F.when(found == "", "unknown").otherwise(F.concat(F.substring(found, 1, 10), F.lit("__"), F.substring(found, 12, 10)))


def safe_metric_name(name: Column) -> Column:
    """Metric id of a file name: no extension, period or (for service metrics) address."""
    stem = F.regexp_replace(F.lower(name), r"\.csv$", "")
    stem = F.regexp_replace(stem, r"_\d{4}-\d{2}-\d{2}_\d{4}-\d{2}-\d{2}$", "")
    stem = F.when(stem.startswith("system_"), stem).otherwise(F.regexp_replace(stem, r"(?:\d{1,3}\.){3}\d{1,3}", ""))
    return F.regexp_replace(F.regexp_replace(stem, r"[^a-zA-Z0-9]+", "_"), r"^_+|_+$", "")

# English words that carry no topic, in the order of Spark's own list.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t
can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've
we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't
cannot could here's how's let's ought that's there's what's when's where's who's why's would
""".split()
