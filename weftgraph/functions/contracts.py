"""Endpoint and client-call attributes of a symbol, as column expressions.

Each function returns a struct column. ``block`` is the symbol's text,
``line`` its first line and ``above`` the lines just before it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weftgraph.functions import routes as r
from weftgraph.functions.let import let
from weftgraph.operators import rules as p


def _get(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def endpoint(route: Column, method: Column) -> Column:
    """Null unless there is a route."""
    return F.when(F.coalesce(route, F.lit("")) != "", F.struct(route.alias("endpoint_route"), method.alias("http_method")))


def python_endpoint(decorators: Column) -> Column:
    """Of the decorators that name a route, the last one."""
    def of(dec: Column) -> Column:
        by_verb = endpoint(_get(dec, p.PY_VERB_ROUTE, 2), F.upper(_get(dec, p.PY_VERB_ROUTE, 1)))
        first_method = _get(_get(dec, p.PY_PLAIN_ROUTE, 2), r"""['"]([a-zA-Z]+)['"]""", 1)
        plain = endpoint(_get(dec, p.PY_PLAIN_ROUTE, 1), _filled(F.upper(first_method)))
        return F.coalesce(by_verb, plain)

    found = F.filter(F.transform(decorators, of), lambda e: e.isNotNull())
    route = F.try_element_at(found, F.lit(-1))
    # the method is the last one named; a bare route keeps an earlier method
    named = F.filter(F.transform(found, lambda e: e["http_method"]), lambda m: m.isNotNull())
    return endpoint(route["endpoint_route"], F.coalesce(F.try_element_at(named, F.lit(-1)), F.lit("GET")))


def ts_endpoint(line: Column, above: Column, name: Column, path: Column) -> Column:
    express = endpoint(_get(line, p.TS_EXPRESS, 2), F.upper(_get(line, p.TS_EXPRESS, 1)))
    low = F.lower(path)
    is_handler = F.upper(name).isin("GET", "POST", "PUT", "DELETE", "PATCH") & (low.contains("api") | low.contains("route"))
    bare = path
    for ending in ("/route.ts", "/route.js", ".ts", ".js"):
        bare = F.replace(bare, F.lit(ending), F.lit(""))
    at = F.instr(bare, "api/")
    file_route = F.concat(F.lit("/"), F.when(at > 0, F.substring(bare, at, F.length(bare))).otherwise(bare))
    handler = F.when(is_handler, endpoint(file_route, F.upper(name)))
    nest = F.when(~is_handler, endpoint(_get(above, p.TS_NEST, 2), F.upper(_get(above, p.TS_NEST, 1))))
    return F.coalesce(express, handler, nest)


def go_endpoint(block: Column, above: Column) -> Column:
    swagger = endpoint(_get(above, p.GO_SWAGGER, 1), F.upper(_get(above, p.GO_SWAGGER, 2)))
    router = endpoint(_get(block, p.GO_ROUTER, 2), F.upper(_get(block, p.GO_ROUTER, 1)))
    return F.coalesce(swagger, router, endpoint(_get(block, p.GO_HANDLE, 1), F.lit("GET")))


def java_endpoint(above: Column, class_above: Column) -> Column:
    prefix = F.regexp_replace(_get(F.coalesce(class_above, F.lit("")), p.SPRING_CLASS, 1), "/+$", "")
    raw = _get(above, p.SPRING_METHOD, 2)
    verb = F.upper(F.replace(_get(above, p.SPRING_METHOD, 1), F.lit("Mapping"), F.lit("")))
    route = F.concat(prefix, F.lit("/"), F.regexp_replace(raw, "^/+", ""))
    return F.when(raw != "", endpoint(route, F.when(verb == "REQUEST", "GET").otherwise(verb)))


def rust_endpoint(above: Column) -> Column:
    return endpoint(_get(above, p.ACTIX, 2), F.upper(_get(above, p.ACTIX, 1)))


def csharp_endpoint(above: Column) -> Column:
    verb = _get(above, p.ASPNET, 1)
    route = F.coalesce(_filled(_get(above, p.ASPNET, 2)), F.lit("/"))
    return F.when(verb != "", endpoint(route, F.when(verb == "Route", "GET").otherwise(F.upper(F.replace(verb, F.lit("Http"), F.lit(""))))))


def generic_endpoint(line: Column) -> Column:
    return endpoint(_get(line, p.GENERIC_ROUTE, 1), F.coalesce(_filled(F.upper(_get(line, p.ANY_VERB, 1))), F.lit("GET")))


def consumer(route: Column, method: Column, base: Column, keep: Column) -> Column:
    return F.struct(
        F.when(keep, route).alias("consumes_endpoint"), F.when(keep, F.upper(method)).alias("consumes_http_method"),
        base.alias("target_base_url"))


def _is_url(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://") | url.startswith("/")


def _routed(url: Column, method: Column, assets: tuple[str, ...]) -> Column:
    return let(url, lambda u: F.when(_is_url(u), let(r.consumed_route(u), lambda route: consumer(
        route, method, r.url_host(u), (route != "") & (route != "/") & ~r.is_asset(route, assets)))))


def _first(text: Column, pattern: str, groups: tuple[int, ...]) -> Column:
    return F.coalesce(*[_filled(_get(text, pattern, g)) for g in groups])


def python_consumer(block: Column) -> Column:
    return let(_get(block, p.PY_CLIENT, 0), lambda call: _routed(
        _first(call, p.PY_CLIENT, (2, 4, 6)), _first(call, p.PY_CLIENT, (1, 3, 5)), p.PY_ASSETS))


def ts_consumer(block: Column) -> Column:
    def of(call: Column) -> Column:
        method = F.coalesce(_first(call, p.TS_CLIENT, (1, 2, 3, 4)), F.lit("GET"))
        for verb in ("GET", "PUT", "DELETE", "POST"):
            said = block.contains(f'method: "{verb}"') | block.contains(f"method: '{verb}'")
            if verb == "POST":
                said = said | block.contains("method: `POST`")
            method = F.when(said, verb).otherwise(method)
        return _routed(_get(call, p.TS_CLIENT, 5), method, p.TS_ASSETS)

    return let(_get(block, p.TS_CLIENT, 0), of)


def go_consumer(block: Column) -> Column:
    def call(url: Column, method: Column) -> Column:
        path = r.strip(F.substring_index(F.regexp_replace(url, r"^https?://[^/]+", ""), "?", 1))
        return F.when(_is_url(url), consumer(path, method, r.url_host(url), (path != "") & (path != "/")))

    def pick(x: Column) -> Column:
        direct, request, client = x["direct"], x["request"], x["client"]
        return (
            F.when(direct != "", call(_get(direct, p.GO_GET_POST, 1), F.when(direct.contains("Post"), "POST").otherwise("GET")))
            .when(request != "", call(_get(request, p.GO_REQUEST, 2), _get(request, p.GO_REQUEST, 1)))
            .when(client != "", call(_get(client, p.GO_CLIENT, 2), _get(client, p.GO_CLIENT, 1))))

    return let(F.struct(
        _get(block, p.GO_GET_POST, 0).alias("direct"), _get(block, p.GO_REQUEST, 0).alias("request"),
        _get(block, p.GO_CLIENT, 0).alias("client")), pick)


def plain_consumer(block: Column, lang: str) -> Column:
    """Languages whose calls keep the URL's path as it is written."""
    def of(call: Column) -> Column:
        verb, url = _get(call, p.PLAIN_CLIENTS[lang], 1), _get(call, p.PLAIN_CLIENTS[lang], 2)
        if lang == "php":
            verb = F.when(F.lower(verb) == "request", "GET").otherwise(verb)
        elif lang == "csharp":
            verb = F.replace(verb, F.lit("Async"), F.lit(""))
        elif lang == "generic":
            verb = F.coalesce(_filled(_get(block, p.ANY_VERB, 1)), F.lit("GET"))
        return let(url, lambda u: F.when((u != "") & ~r.is_asset(F.lower(u), p.PLAIN_ASSETS), plain(u, verb)))

    def plain(url: Column, verb: Column) -> Column:
        absolute = url.contains("://")
        after = _get(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
        path = F.coalesce(_filled(F.regexp_replace(after, ";[^/]*$", "")), F.lit("/"))
        host = _filled(F.lower(_get(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)))
        return consumer(F.when(absolute, path).otherwise(url), verb, F.when(absolute, host), F.lit(True))

    return let(_get(block, p.PLAIN_CLIENTS[lang], 0), of)
