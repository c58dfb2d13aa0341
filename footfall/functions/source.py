"""Referrer, channel and campaign rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall import fixed_values as fv
from footfall.functions.text import blank, clean_text, let, literals

# scheme, host, port and path of a URL with an authority part
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d{0,5}))?(?=[/?#]|$)([^?#]*)"


def _url_part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def url_host(url: Column) -> Column:
    """Lower-case host; '' for relative or malformed URLs."""
    port = _url_part(url, 3)  # at most five digits, which compare as the numbers do; a failing cast would cost an exception a row
    too_high = F.coalesce((F.length(port) == 5) & (port > "65535"), F.lit(False))
    return F.when(~too_high, F.lower(_url_part(url, 2))).otherwise(F.lit(""))


def referrer_domain(url: Column) -> Column:
    return F.coalesce(url_host(url), F.lit(""))


def sanitize_referrer(url: Column) -> Column:
    """Scheme, host and path without query or fragment; '' when there is no host."""
    scheme, path = _url_part(url, 1), _url_part(url, 4)
    host = referrer_domain(url)
    return F.when(
        ~blank(host),
        F.concat(
            F.when(scheme != "", F.concat(scheme, F.lit("://"))).otherwise(F.lit("https://")),
            host,
            F.when(path != "", path).otherwise(F.lit("/")),
        ),
    ).otherwise(F.lit(""))


def is_self_referral(url: Column, site_host: str) -> Column:
    domain = referrer_domain(url)
    return (domain != "") & (domain == site_host.lower())


def _host_pattern(domains: Sequence[str]) -> str:
    """Matches each host itself and its sub-domains."""
    return "(?:^|\\.)(?:" + "|".join(d.replace(".", "\\.") for d in domains) + ")$"


def is_spam_domain(domain: Column, spam: Sequence[str] = tuple(fv.SPAM_DOMAINS)) -> Column:
    """The domain or one of its parents is listed."""
    if not spam:
        return F.lit(False)
    return F.coalesce(F.lower(domain).rlike(_host_pattern([d.lower() for d in spam])), F.lit(False))


_RULES = [("Organic Search", *rule) for rule in fv.SEARCH_ENGINES.items()]
_RULES += [("Social Media", *rule) for rule in fv.SOCIAL_PLATFORMS.items()]


def domain_rule(domain: Column) -> Column:
    """Number of the first rule a domain meets: 1 for none given, then each listed part, webmail, other."""
    number = F.when(blank(domain), 1)
    for i, (_, part, _) in enumerate(_RULES):
        number = number.when(domain.contains(part), i + 2)
    return number.when(domain.rlike(_host_pattern(fv.EMAIL_DOMAINS)), len(_RULES) + 2).otherwise(len(_RULES) + 3)


def rule_channel(number: Column) -> Column:
    return F.element_at(literals(["Direct", *[r[0] for r in _RULES], "Email", "Referral"]), number)


def rule_name(number: Column, domain: Column) -> Column:
    """Name of the engine or platform; any other source is named after its domain."""
    return F.when(number <= len(_RULES) + 1, F.element_at(literals(["", *[r[2] for r in _RULES], "", ""]), number)).otherwise(domain)


def domain_class(domain: Column) -> Column:
    """struct(channel, name) of a domain."""
    return let(
        domain_rule(domain),
        lambda n: F.struct(rule_channel(n).alias("channel"), rule_name(n, domain).alias("name")),
    )


def utm_medium_channel(medium: Column) -> Column:
    """Channel named by a campaign medium; NULL when the medium is unknown."""
    table = F.create_map(*[F.lit(x) for pair in fv.UTM_MEDIUM_CHANNELS.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(medium)))


def classify_channel(domain: Column, medium: Column | None = None) -> Column:
    """struct(channel, name): the medium decides if it is known, else ordered domain rules."""
    if medium is None:
        return domain_class(domain)
    paid = F.when(~blank(medium), utm_medium_channel(medium))
    by_medium = F.struct(paid.alias("channel"), F.lit("").alias("name"))
    return F.when(paid.isNotNull(), by_medium).otherwise(domain_class(domain))


def _plain_keys(query: Column) -> Column:
    """The query's campaign parts with their keys decoded: only for the rare query with coded keys."""
    parts = F.transform(
        F.split(query, "&"),
        lambda s: F.struct(
            F.translate(_decoded(F.substring_index(s, "=", 1)), ". ", "__").alias("key"),
            F.when(s.contains("="), F.regexp_replace(s, "^[^=]*=", "")).otherwise(F.lit("")).alias("value"),
        ),
    )
    ours = F.filter(parts, lambda p: p["key"].isin(fv.UTM_KEYS))
    return F.array_join(F.transform(ours, lambda p: F.concat_ws("=", p["key"], p["value"])), "&")


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def extract_utm(query: Column) -> Column:
    """map of the campaign keys in a query string: decoded, blanks dropped, last duplicate wins."""
    coded = query.rlike(r"(?:^|&)[^=&]*[%+. ]")
    found = lambda plain, key: F.when(plain.contains(f"{key}="), F.regexp_extract(plain, f"^(?:.*&)?{key}=([^&]*)", 1))
    raws = lambda plain: F.array(*[found(plain, key) for key in fv.UTM_KEYS])
    clean = lambda raw: F.when(~blank(raw), let(_decoded(raw), lambda v: F.when(~blank(v), clean_text(v))))
    values = F.transform(let(F.when(coded, _plain_keys(query)).otherwise(query), raws), clean)
    tagged = F.map_filter(F.map_from_arrays(literals(fv.UTM_KEYS), values), lambda _, v: F.coalesce(v, F.lit("")) != "")
    # most hits carry no tag: they skip all of the above
    return F.when(query.contains("utm") | coded, tagged).otherwise(F.expr("cast(map() as map<string,string>)"))


def resolve_uri(page_url: Column, resource_type: Column, resource_id: Column) -> Column:
    """The page path, or ``/<type>/<id>`` when the hit carries none."""
    given = F.when(~blank(page_url), page_url)
    made = F.concat(
        F.lit("/"), F.coalesce(resource_type, F.lit("post")), F.lit("/"),
        F.coalesce(resource_id, F.lit(0)).cast("string"),
    )
    return F.coalesce(given, made)


def uri_hash(uri: Column) -> Column:
    return F.crc32(uri.cast("binary"))
