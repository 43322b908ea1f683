"""Column expressions on offer texts, money, dates, keys and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(c: Column) -> Column:
    """Lower case, other than letters and digits to single underscores, none at the ends; empty gives unknown."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", "unknown").otherwise(s)


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def offer_id(brand: Column, title: Column, strip: bool = True) -> Column:
    """The id of an offer for messages (strip) and in the app (no strip): brand and title, 100 characters at most."""
    s = F.regexp_replace(F.lower(F.concat_ws("_", brand, title)), "[^a-z0-9]+", "_")
    return F.substring(F.regexp_replace(s, "^_+|_+$", "") if strip else s, 1, 100)


def number(c: Column, pattern: str) -> Column:
    """The number in the pattern's first group, null where there is none."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1), F.lit("")).cast("double")


def percent(c: Column) -> Column:
    return number(c, r"(\d+(?:\.\d+)?)\s*%")


def dollars(c: Column) -> Column:
    return number(c, r"\$\s*(\d+(?:\.\d+)?)")


def rounded(c: Column | str, places: int) -> Column:
    """c to so many decimal places, halves away from zero, by its product in doubles: 56.449999999999996 * 10 is 564.5, so
    it gives 56.5, where Spark's round goes by the decimal text and gives 56.4."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 10.0**places, 0) / 10.0**places


#: The accepted forms of dates, each with what a text of that form must hold.
DATE_FORMATS = {
    "yyyy-MM-dd'T'HH:mm:ss": "%-%t%:%:%", "yyyy-MM-dd'T'HH:mm:ss'Z'": "%-%t%:%:%z", "yyyy-MM-dd": "%-%-%", "MM/dd/yyyy": "%/%/%",
    "MMMM d, yyyy": "% %, %", "MMM d, yyyy": "% %, %", "d MMMM yyyy": "% % %", "MMM. d, yyyy": "%. %, %",
}


def any_date(c: Column) -> Column:
    """A date written in any accepted form; null for others. A text is parsed by the forms only that it may have, as a parse
    that fails costs many times one that does not."""
    text = F.trim(c)
    return F.coalesce(*(F.when(F.lower(text).like(shape), F.to_date(F.try_to_timestamp(text, F.lit(f)))) for f, shape in DATE_FORMATS.items()))


def iso_date(c: Column) -> Column:
    """The text as an ISO date if it is a date in another form; ISO times and other texts stay."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T"), c).otherwise(F.coalesce(F.date_format(any_date(c), "yyyy-MM-dd"), c))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1))


def public_url(url: Column) -> Column:
    """Whether the URL is plain http(s) to a named host: no spaces, user, odd port, bare or numeric host."""
    host = host_of(url)
    port = F.regexp_extract(url, r"^https?://[^/?#:]+:(\d*)(?:[/?#]|$)", 1)
    allowed = (port == "") | (port == F.when(url.startswith("https"), "443").otherwise("80"))
    shaped = url.rlike(r"^https?://[^/?#@\s\\:]+(:\d*)?([/?#][^\s\\]*)?$")
    named = host.rlike(r"^([a-z0-9]|[a-z0-9][a-z0-9-]*[a-z0-9])(\.([a-z0-9]|[a-z0-9][a-z0-9-]*[a-z0-9]))+$") & ~host.rlike(r"^[0-9.]+$")
    return F.coalesce(shaped & named & allowed, F.lit(False))


def matches_domain(url: Column, domain: Column) -> Column:
    """Whether a public URL's host is the domain or below it; a leading www. of either does not matter."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"^www\.", "")
    host, name = bare(host_of(url)), bare(domain)
    good = public_url(F.concat(F.lit("https://"), domain)) & ~domain.rlike("[/?#]")
    return F.coalesce(public_url(url) & good & ((host == name) | host.endswith(F.concat(F.lit("."), name))), F.lit(False))


def offer_text(*columns: Column) -> Column:
    """The given texts, without empty ones, joined by spaces."""
    return F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in columns))
