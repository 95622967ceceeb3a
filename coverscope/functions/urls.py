"""URLs: canonical form, domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = "fbclid gclid mc_cid mc_eid ref_src s_cid".split()
_SPLIT = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:@]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _SPLIT, group)


def canonical_url(url: Column) -> Column:
    """A URL without fragment, tracking parameters, default port and trailing slashes, its host in lower case and its parameters in order.

    null for what is no absolute URL with a host. Escapes stay as they are written.
    """
    url = F.trim(url)
    scheme, user, host, port = F.lower(_part(url, 1)), _part(url, 2), F.lower(_part(url, 3)), _part(url, 4)
    path = F.when(_part(url, 5) == "", "/").otherwise(_part(url, 5))
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(_part(url, 6), "&"), lambda p: (p != "") & ~key(p).startswith("utm_") & ~key(p).isin(*TRACKING))
    # Sorted by name; those of one name keep their order.
    numbered = F.array_sort(F.transform(kept, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p"))))
    query = F.array_join(F.transform(numbered, lambda s: s["p"]), "&")
    default = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80")) | (port == "")
    whole = F.concat(
        scheme, F.lit("://"), F.when(user == "", "").otherwise(F.concat(user, F.lit("@"))), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))
    )
    return F.when(url.rlike(_SPLIT) & (host != ""), whole)


def domain(url: Column) -> Column:
    """The host in lower case without "www."; null where there is none."""
    return F.nullif(F.regexp_replace(F.lower(_part(F.trim(url), 3)), r"^www\.", ""), F.lit(""))


def normalized_domain(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"^www\.", "")


def is_http_url(url: Column) -> Column:
    """Whether it can be read as an http or https URL with a host."""
    return F.coalesce(url.rlike(r"^(?i:https?)://[^\s/?#]+") & ~url.rlike(r"\s"), F.lit(False))
