"""Expressions over records of a completion service: errors, keys, delays, prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import RETRYABLE_CODES

REDACTED = "[redacted]"
#: Shapes of keys and tokens.
SECRET_SHAPES = (r"sk-[A-Za-z0-9_-]{8,}", r"(?i)bearer\s+[A-Za-z0-9._~+/=-]{8,}", r"\b\d{6,}:[A-Za-z0-9_-]{20,}")


def scrubbed(text: Column | str, secrets: tuple[str, ...] = ()) -> Column:
    out = F.col(text) if isinstance(text, str) else text
    for secret in secrets:
        if len(secret) >= 8:
            out = F.replace(out, F.lit(secret), F.lit(REDACTED))
    for shape in SECRET_SHAPES:
        out = F.regexp_replace(out, shape, REDACTED)
    return out


def status_code(message: Column | str) -> Column:
    """The HTTP status that an error text names, or null."""
    m = F.col(message) if isinstance(message, str) else message
    shapes = (r"(?i)error code:\s*(\d+)", r"(?i)http/\d(?:\.\d)?\s+(\d+)", r"(?i)['\"]http_code['\"]:\s*['\"](\d+)['\"]")
    return F.coalesce(*(F.when(m.rlike(s), F.regexp_extract(m, s, 1).cast("int")) for s in shapes))


def is_rate_limit(message: Column | str, status: Column | None = None) -> Column:
    m = F.lower(F.col(message) if isinstance(message, str) else message)
    said = m.rlike(r"(?<!\d)429(?!\d)|rate_limit|rate limit|too many requests")
    return said | (F.coalesce(status, F.lit(0)) == 429 if status is not None else F.lit(False))


def is_retryable(message: Column | str) -> Column:
    m = F.col(message) if isinstance(message, str) else message
    code = F.coalesce(status_code(m), F.lit(0))
    return code.isin(*RETRYABLE_CODES) | F.lower(m).rlike("timeout|temporar|connection|service unavailable|server error|unknown status code")


def key_unusable(message: Column | str) -> Column:
    """401 to 403, a 400 about money, or a 429 that names a quota."""
    m = F.col(message) if isinstance(message, str) else message
    code, low = F.coalesce(status_code(m), F.lit(0)), F.lower(m)
    return code.isin(401, 402, 403) | ((code == 400) & low.rlike("credit balance|billing|usage limit")) | ((code == 429) & low.rlike("quota|billing"))


def error_class(message: Column | str) -> Column:
    m = F.col(message) if isinstance(message, str) else message
    return F.when(m.isNull(), None).when(key_unusable(m), "key_unusable").when(is_rate_limit(m), "rate_limit").when(is_retryable(m), "transient").otherwise("fatal")


def retry_delay(message: Column | str, attempt: Column | str, *, base: float = 12.0, most: float = 90.0) -> Column:
    """Seconds to wait: what the error asks for and one more, or base * 2 ** attempt; never over `most`."""
    m = F.coalesce(F.col(message) if isinstance(message, str) else message, F.lit(""))
    a = F.col(attempt) if isinstance(attempt, str) else attempt
    shapes = (r"(?i)retry after ([0-9]+(?:\.[0-9]+)?)s", r"(?i)try again in ([0-9]+(?:\.[0-9]+)?)s", r"(?i)after ([0-9]+(?:\.[0-9]+)?) seconds?")
    asked = F.coalesce(*(F.when(m.rlike(s), F.regexp_extract(m, s, 1).cast("double") + 1) for s in shapes))
    return F.least(F.coalesce(asked, base * F.pow(F.lit(2.0), a)), F.lit(most))


def provider_of_key(key: Column | str, override: Column | None = None) -> Column:
    """By the shape of the key, the first rule that holds; an override wins."""
    k = F.col(key) if isinstance(key, str) else key
    shape = (
        F.when(k.startswith("sk-ant-"), "claude")
        .when(k.rlike("^sk-(?:proj|svcacct|admin)-"), "openai")
        .when(k.rlike("^sk-[0-9a-fA-F]{32}$"), "deepseek")
        .when(k.startswith("sk-"), "openai")
    )
    return shape if override is None else F.coalesce(F.nullif(F.lower(F.trim(override)), F.lit("")), shape)


def usage_cost(hit: Column, miss: Column, write: Column, output: Column, *, prices: dict[str, str]) -> Column:
    """Cost in dollars, exact to ten places. prices: dollars for a million of hit, miss, (write,) output.

    Without a price for writes they are billed as misses, of which they are a part.
    """
    money = {k: F.lit(v).cast("decimal(12,4)") for k, v in prices.items()}
    whole = [F.greatest(F.coalesce(x, F.lit(0)).cast("long"), F.lit(0).cast("long")).cast("decimal(14,0)") for x in (hit, miss, write, output)]
    if "write" in prices:
        plain = F.greatest(whole[1] - whole[2], F.lit(0).cast("decimal(15,0)"))
        total = whole[0] * money["hit"] + plain * money["miss"] + whole[2] * money["write"] + whole[3] * money["output"]
    else:
        total = whole[0] * money["hit"] + whole[1] * money["miss"] + whole[3] * money["output"]
    return (total / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(20,10)")


FAILURES = {
    # Marks of each class of failure, in the order they are looked for.
    "keys_dead": ("all llm key slots unusable",),
    "interrupted": ("interrupted", "service stopped", "restart"),
    "internal": ("internal error", "worker crashed"),
    "all_source": ("every page kept its source", "all pages fell back"),
    "unparsable": (
        "failed to open", "cannot open", "filedataerror", "no objects found", "broken document", "not a pdf", "epub contains no xhtml",
        "file is not a zip file", "epub mimetype", "archive member", "archive path",
    ),
}


def failure_class(message: Column | str) -> Column:
    """The first class of failure whose mark the message holds; null if none."""
    m = F.lower(F.coalesce(F.col(message) if isinstance(message, str) else message, F.lit("")))
    out = None
    for name, marks in FAILURES.items():
        held = m.rlike("|".join(x.replace(".", r"\.") for x in marks))
        out = F.when(held, name) if out is None else out.when(held, name)
    return out
