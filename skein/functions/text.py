"""Short texts for people: snippets, sizes, durations, slugs and settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def snippet(text: Column, longest: int = 260) -> Column:
    """White space collapsed and trimmed; longer texts are cut and get three dots."""
    flat = F.btrim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > longest, F.concat(F.left(flat, F.lit(longest)), F.lit("..."))).otherwise(flat)


def human_bytes(n: Column) -> Column:
    """``500 B``, ``1.0 KB``, ``1.0 MB``; a dash for nothing."""
    return (
        F.when(n.isNull() | (n == 0), "—")
        .when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(F.format_string("%.1f", n / 1024.0), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", n / (1024.0 * 1024)), F.lit(" MB")))
    )


def duration_label(ms: Column) -> Column:
    """Milliseconds as ``999ms``, ``1.0s`` or ``1.0m``."""
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60000, F.concat(F.format_string("%.1f", ms / 1000.0), F.lit("s")))
        .otherwise(F.concat(F.format_string("%.1f", ms / 60000.0), F.lit("m")))
    )


def slug(full_name: Column) -> Column:
    """Every slash as a dash."""
    return F.replace(full_name, F.lit("/"), F.lit("-"))


def first_slash_slug(full_name: Column) -> Column:
    """Only the first slash as a dash, as a client that replaces once sees it."""
    return F.regexp_replace(full_name, r"^([^/]*)/", r"$1-")


def lines(text: Column) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x)), lambda x: x != "")


def inject_token(url: Column, token: Column) -> Column:
    """An https address with ``oauth2:token@`` before the host; without a token as it was."""
    return F.when(token.isNull() | (token == ""), url).otherwise(F.regexp_replace(url, r"^(https?://)(?:[^/@]*@)?", F.concat(F.lit("$1oauth2:"), F.replace(token, F.lit("$"), F.lit(r"\$")), F.lit("@"))))


def tool_group(name: Column) -> Column:
    """memory, repo, job or other, by prefix."""
    return F.when(name.startswith("memory_"), "memory").when(name.startswith("repo_"), "repo").when(name.startswith("job_"), "job").otherwise("other")


def isoformat(column: Column) -> Column:
    """A time as ISO 8601; the fraction has six digits and is left out where it is zero."""
    whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(column, "SSSSSS") == "000000", whole).otherwise(F.concat(whole, F.date_format(column, ".SSSSSS")))
