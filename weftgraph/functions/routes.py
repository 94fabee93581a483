"""Route and URL expressions. Plain columns: no UDF, no join."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The spelling of route parameters and their placeholder.
PLACEHOLDER = "{_param_}"
PARAMETER_FORMS = (r"<[^>]+>", r"\{[^{}]+\}", r"\$\{[^{}]+\}", r":[a-zA-Z0-9_\-]+")
ENDPOINT_PARAMETER = r"^(\{[^}]+\}|:[a-zA-Z0-9_]+|<.*>|\*)$"
CONSUMER_PARAMETER = r"^(\{[^}]+\}|:[a-zA-Z0-9_]+|<.*>|\*|\$\{[^}]+\})$"
PLAIN_SEGMENT = r"^[a-zA-Z0-9_\-\.]+$"
CONSUMED_PATH = r"(/(?:api/)?(?:v[0-9]+/)?(?:api/)?[a-zA-Z0-9_\-/{}:]+)"


# White space that ``strip`` removes from both ends.
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"
# Optional host, optional /api, one slash, then the path without end slashes.
PATH_OF = r"(?s)^(?:https?://[^/]+)?(?:/?api(?=/))?/?(.*?)/*\z"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE_SPACE))


def normalize_route(route: Column) -> Column:
    """Path of a route or URL: no query, no host, no ``/api``, no end slash.

    One regular expression per route: this runs on every consumer.
    """
    return F.concat(F.lit("/"), F.regexp_extract(strip(F.substring_index(route, "?", 1)), PATH_OF, 1))


def canonical_route(route: Column) -> Column:
    path = normalize_route(route)
    for form in PARAMETER_FORMS:
        path = F.regexp_replace(path, form, PLACEHOLDER)
    return path


def _trimmed(segment: Column) -> Column:
    return F.trim(segment)


def route_segments(route: Column) -> Column:
    """Trimmed, non-empty path segments, case kept."""
    return F.filter(F.transform(F.split(route, "/"), _trimmed), lambda s: s != "")


def is_wildcard(segment: Column) -> Column:
    return (
        segment.startswith(":")
        | (segment.startswith("{") & segment.endswith("}"))
        | (segment.startswith("<") & segment.endswith(">"))
        | (segment == "*")
    )


def route_mask(route: Column) -> Column:
    """One digit per segment, ``1`` for a parameter.

    Ordered as text, masks are in depth-first order with the literal branch
    tried before the parameter branch.
    """
    return F.array_join(F.transform(route_segments(route), lambda s: F.when(is_wildcard(s), "1").otherwise("0")), "")


def masked_key(segments: Column, mask: Column) -> Column:
    """Lower-cased segments with the masked ones replaced by ``*``."""
    digits = F.split(mask, "")
    return F.array_join(
        F.zip_with(segments, digits, lambda s, d: F.when(d == "1", F.lit("*")).otherwise(F.lower(s))), "/")


def route_key(route: Column) -> Column:
    return F.array_join(
        F.transform(route_segments(route), lambda s: F.when(is_wildcard(s), F.lit("*")).otherwise(F.lower(s))), "/")


def route_matches(endpoint: Column, consumer: Column) -> Column:
    """Whether two routes are equal, or equal up to parameters, by segment."""
    a, b = normalize_route(endpoint), normalize_route(consumer)
    pa = F.filter(F.split(a, "/"), lambda s: s != "")
    pb = F.filter(F.split(b, "/"), lambda s: s != "")

    def same(x: Column, y: Column) -> Column:
        ep, co = x.rlike(ENDPOINT_PARAMETER), y.rlike(CONSUMER_PARAMETER)
        return (x == y) | (ep & co) | (ep & y.rlike(PLAIN_SEGMENT)) | (co & x.rlike(PLAIN_SEGMENT))

    by_segment = (F.size(pa) == F.size(pb)) & F.forall(F.zip_with(pa, pb, same), lambda m: F.coalesce(m, F.lit(False)))
    filled = (F.coalesce(endpoint, F.lit("")) != "") & (F.coalesce(consumer, F.lit("")) != "")
    return filled & ((a == b) | (canonical_route(endpoint) == canonical_route(consumer)) | by_segment)


def url_host(url: Column) -> Column:
    """Lower-cased ``host[:port]``, or null when the URL has no scheme."""
    host = F.lower(F.regexp_extract(url, r"^https?://([^/]+)", 1))
    return F.when(host != "", host)


def consumed_route(url: Column) -> Column:
    """The path a client call asks for, cut at the first foreign character."""
    path = strip(F.substring_index(F.regexp_replace(url, r"^https?://[^/]+", ""), "?", 1))
    found = F.regexp_extract(path, CONSUMED_PATH, 1)
    return F.when(found != "", found).otherwise(path)


def is_asset(path: Column, endings: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for ending in endings:
        hit = hit | path.endswith(ending)
    return hit


def repo_name(url_or_path: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(strip(url_or_path), "/+$", ""), r"\.git$", "")
    return F.regexp_replace(F.element_at(F.split(clean, r"[/:\\]"), -1), r"[^a-zA-Z0-9_\-.]", "_")


def classify_source_url(url: Column, host: str = "github.com/") -> Column:
    """Struct ``(kind, value)``: a single repository's clone URL, or an owner."""
    raw = F.regexp_replace(strip(url), "/+$", "")
    hosted = raw.contains(host)
    rest = F.regexp_replace(F.substring_index(raw, host, -1), "^/+|/+$", "")
    parts = F.split(rest, "/")
    single = hosted & (F.size(parts) == 2) & ~F.element_at(parts, 1).isin("orgs", "users")
    clone = F.concat(F.lit("https://" + host), F.element_at(parts, 1), F.lit("/"),
                     F.replace(F.try_element_at(parts, F.lit(2)), F.lit(".git"), F.lit("")), F.lit(".git"))
    owner = F.when(hosted, F.substring_index(F.regexp_replace(F.substring_index(raw, host, -1), "^(?:orgs|users)/", ""), "/", 1)).otherwise(raw)
    owner = F.regexp_replace(owner, r"[^a-zA-Z0-9_\-]", "")
    return F.struct(
        F.when(single, F.lit("repo")).when(owner == "", F.lit("none")).otherwise(F.lit("owner")).alias("kind"),
        F.when(single, clone).otherwise(owner).alias("value"))
