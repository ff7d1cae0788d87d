"""Slugs, paths and addresses of topics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens.functions.text import SPACE_CLASS


def slugify(col: Column) -> Column:
    """Title to slug: Turkish letters to ASCII, spaces to ``-``, everything else dropped."""
    text = F.translate(F.lower(col), "ığüşöç", "igusoc")
    text = F.regexp_replace(text, rf"[^a-z0-9{SPACE_CLASS}-]", "")
    return F.regexp_replace(text, f"[{SPACE_CLASS}]+", "-")


def url_path(col: Column) -> Column:
    """Path part of an address or of a site-relative link."""
    no_host = F.regexp_replace(col, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    return F.regexp_replace(no_host, r"(?s)[?#].*$", "")


def id_from_slug(col: Column) -> Column:
    """Number after the last ``--`` of the path; null when there is none."""
    last = F.element_at(F.split(url_path(col), "--"), -1)
    return F.regexp_extract(last, r"^\s*(\d+)", 1).try_cast("bigint")


def title_from_slug(col: Column) -> Column:
    return F.replace(F.substring_index(col, "--", 1), F.lit("-"), F.lit(" "))


def strip_base_url(col: Column, base_url: str) -> Column:
    """Drop the site prefix and the leading slash."""
    base = base_url.rstrip("/")
    local = F.when(F.startswith(col, F.lit(base)), F.substr(col, F.lit(len(base) + 1))).otherwise(col)
    return F.regexp_replace(local, "^/", "")


def absolute_url(col: Column, base_url: str) -> Column:
    return F.concat(F.lit(base_url.rstrip("/")), col)


def query_param(col: Column, name: str) -> Column:
    """Raw value of a query parameter; null when missing or empty."""
    return F.nullif(F.regexp_extract(col, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def split_query(col: Column, marker: str = "/") -> Column:
    """``struct(slug, query)`` of the part behind the last ``marker`` of the path."""
    parts = F.split(F.regexp_replace(col, r"(?s)#.*$", ""), r"\?", 2)
    return F.struct(
        F.substring_index(parts[0], marker, -1).alias("slug"),
        F.nullif(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.lit("")).alias("query"),
    )


def encode_component(col: Column) -> Column:
    """Percent-encoding of one path component (space is ``%20``, not ``+``)."""
    text = F.url_encode(col)
    for escape, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        text = F.replace(text, F.lit(escape), F.lit(char))
    return text


def listing_path(url: Column, channel_param: str = "kanal", page_param: str = "p",
                 default: str = "gundem") -> Column:
    """Listing a request address asks for: a channel or the general agenda, with its page."""
    channel = F.try_url_decode(query_param(url, channel_param))
    page = query_param(url, page_param)
    listing = F.coalesce(F.concat(F.lit(f"{channel_param}/"), encode_component(channel)), F.lit(default))
    return F.concat(listing, F.coalesce(F.concat(F.lit(f"?{page_param}="), page), F.lit("")))


def page_number(url: Column, page_param: str = "p") -> Column:
    return F.coalesce(query_param(url, page_param).try_cast("int"), F.lit(1))
