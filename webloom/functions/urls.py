"""URL handling as column expressions: canonical form, resolution, host keys, shards.

No Python runs per row. The expressions are kept as SQL text and applied as one lambda each: they can
be nested inside array transforms, and the driver hands them over in one call instead of building
them node by node.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.text import SPACE

# Already canonical: lower-case host, plain segments that do not start with a dot, no query.
_PLAIN = r"^https?://[a-z0-9.-]+/(?:[A-Za-z0-9_~-][A-Za-z0-9_.~-]*(?:/(?!/)|\z))*\z"
# Characters a host may hold; other ASCII characters make the URL unreadable.
_HOST = r"^(?:[A-Za-z0-9\-_.~!$&\x27()*+,;=:\[\]<>\x22]|[^\x00-\x7F]|%[89A-Fa-f][0-9A-Fa-f])*\z"
# Characters a path may hold without being encoded again.
_PATH_AS_IS = r"^[A-Za-z0-9\-_.~!$&\x27()*+,;=:@\[\]/%]*\z"
# Escapes that form encoding produces and a path keeps as plain characters.
_PATH_PLAIN = {
    "%7E": "~", "%24": "$", "%26": "&", "%2B": "+", "%2C": ",",
    "%2F": "/", "%3A": ":", "%3B": ";", "%3D": "=", "%40": "@",
}


def let(value: str, name: str, body: str) -> str:
    """SQL text that computes a value once and uses it under a name.

    element_at keeps its result type, while an array index works it out again for every row by
    walking all the lambdas below; with nested bindings that walk would cost more than the work.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def apply_sql(value: Column, lambda_text: str) -> Column:
    """Value of a one-argument SQL lambda for a column."""
    return F.element_at(F.call_function("transform", F.array(value), F.expr(lambda_text)), 1)


def trim_sql(s: str) -> str:
    return f"regexp_replace({s}, r'^{SPACE}+|{SPACE}+$', '')"


def split_sql(raw: str) -> str:
    """STRUCT<ok, scheme, opaque, rooted, user, host, path, query, force> of a trimmed URL."""
    split = rf"""
        named_struct(
            'ok', NOT s rlike r'^:|[\x00-\x1F\x7F]' AND NOT (scheme = '' AND hier rlike r'^[^/]*:')
                AND NOT host rlike r'^[^\[].*:[^:]*[^0-9:][^:]*\z' AND host rlike r'{_HOST}'
                AND NOT path rlike r'%(?![0-9A-Fa-f]{{2}})' AND NOT user rlike r'%(?![0-9A-Fa-f]{{2}})',
            'scheme', scheme, 'opaque', if(opaque, hier, ''), 'rooted', rooted, 'user', user, 'host', host,
            'path', path, 'query', regexp_extract(rest, r'(?s)\?(.*)\z', 1), 'force', rest rlike r'^[^?]*\?\z')"""
    path = r"if(opaque, '', if(rooted, regexp_replace(hier, r'^//[^/]*', ''), hier))"
    split = let(path, "path", split)
    split = let(r"regexp_replace(auth, r'^.*@', '')", "host", split)
    split = let(r"regexp_extract(auth, r'^(.*)@', 1)", "user", split)
    split = let(r"if(rooted, regexp_extract(hier, r'^//([^/]*)', 1), '')", "auth", split)
    split = let("startswith(hier, '//') AND (scheme != '' OR NOT startswith(hier, '///'))", "rooted", split)
    split = let("scheme != '' AND NOT startswith(hier, '/')", "opaque", split)
    split = let("substring_index(rest, '?', 1)", "hier", split)
    split = let("if(scheme != '', substring(s, length(scheme) + 2), s)", "rest", split)
    split = let(r"lower(regexp_extract(s, r'^([A-Za-z][A-Za-z0-9+.-]*):', 1))", "scheme", split)
    return let(f"substring_index({raw}, '#', 1)", "s", split)


def _decode_path(path: str) -> str:
    return f"if(contains({path}, '%'), try_url_decode(replace({path}, '+', '%2B')), {path})"


def _encode_path(path: str) -> str:
    out = f"replace(replace(url_encode({path}), '+', '%20'), '*', '%2A')"
    for code, char in _PATH_PLAIN.items():
        out = f"replace({out}, '{code}', '{char}')"
    return out


def _encode_query(s: str) -> str:
    return f"replace(replace(url_encode({s}), '*', '%2A'), '%7E', '~')"


def _clean_path(path: str) -> str:
    """Shortest equivalent path: no empty, '.' or resolvable '..' segments; a trailing slash stays."""
    rooted = f"startswith({path}, '/')"
    stack = f"""aggregate(split({path}, '/'), cast(array() AS array<string>), (st, seg) -> CASE
        WHEN seg = '' OR seg = '.' THEN st
        WHEN seg != '..' THEN concat(st, array(seg))
        WHEN size(st) > 0 AND try_element_at(st, -1) != '..' THEN slice(st, 1, greatest(size(st) - 1, 0))
        WHEN {rooted} THEN st ELSE concat(st, array(seg)) END)"""
    joined = f"if({rooted}, concat('/', array_join(segs, '/')), if(size(segs) = 0, '.', array_join(segs, '/')))"
    slashed = f"if(endswith({path}, '/') AND NOT endswith(clean, '/'), concat(clean, '/'), clean)"
    text = let(stack, "segs", let(joined, "clean", slashed))
    messy = rf"{path} rlike r'//|(?:^|/)\.\.?(?:/|\z)'"
    return f"CASE WHEN {path} = '' THEN '/' WHEN {messy} THEN {text} ELSE {path} END"


def _sorted_query(query: str) -> str:
    pairs = f"""filter(transform(filter(split({query}, '&'), seg -> seg != '' AND NOT contains(seg, ';')),
        seg -> named_struct('k', try_url_decode(substring_index(seg, '=', 1)),
                            'v', try_url_decode(regexp_extract(seg, r'(?s)=(.*)', 1)))),
        kv -> kv.k IS NOT NULL AND kv.v IS NOT NULL)"""
    text = f"transform(array_sort({pairs}), kv -> concat({_encode_query('kv.k')}, '=', {_encode_query('kv.v')}))"
    return f"if({query} = '', '', array_join({text}, '&'))"


def canonical_sql(raw: str) -> str:
    path = let(
        _decode_path("u.path"),
        "dec",
        let(
            _clean_path("dec"),
            "cln",
            f"if(dec = cln AND u.path rlike r'{_PATH_AS_IS}', u.path, {_encode_path('cln')})",
        ),
    )
    host = let("lower(u.host)", "h", r"if(h rlike r'[^\x00-\x7F]', url_encode(h), h)")
    user = "if(u.user != '', concat(u.user, '@'), '')"
    body = f"if(u.opaque != '', u.opaque, concat(if(u.rooted, '//', ''), {user}, {host}, {path}))"
    query = let(_sorted_query("u.query"), "q", "if(u.force OR q != '', concat('?', q), '')")
    text = f"concat(if(u.scheme != '', concat(u.scheme, ':'), ''), {body}, {query})"
    full = let(split_sql("url"), "u", f"if(u.ok, coalesce({text}, url), url)")
    return let(trim_sql(raw), "url", f"CASE WHEN url = '' OR url rlike r'{_PLAIN}' THEN url ELSE {full} END")


def resolve_sql(base: str, href: str) -> str:
    # A reference that ends in a dot segment names a folder.
    folder = r"if(j0 rlike r'(?:^|/)\.\.?\z', concat(j0, '/'), j0)"
    joined = let(
        r"""CASE WHEN r.path = '' THEN b.path WHEN startswith(r.path, '/') THEN r.path
                 ELSE concat(regexp_replace(b.path, r'[^/]*\z', ''), r.path) END""",
        "j0",
        let(folder, "j1", "if(startswith(j1, '/') OR b.host = '', j1, concat('/', j1))"),
    )
    query = let(
        "if(r.query != '' OR r.force OR r.path != '', r.query, b.query)",
        "q0",
        "if(q0 != '' OR r.force, concat('?', q0), '')",
    )
    onto = f"""concat(if(b.scheme != '', concat(b.scheme, ':'), ''),
        if(b.rooted, concat('//', if(b.user != '', concat(b.user, '@'), ''), b.host), ''), {joined}, {query})"""
    target = f"""CASE WHEN base = '' OR NOT b.ok OR r.scheme != '' THEN ref
        WHEN r.host != '' THEN concat(b.scheme, ':', ref) ELSE {onto} END"""
    url = let(
        split_sql("ref"),
        "r",
        f"if(r.ok, {let(split_sql('base'), 'b', let(target, 'target', canonical_sql('target')))}, '')",
    )
    skip = "ref = '' OR startswith(ref, '#') OR startswith(ref, 'javascript:') OR startswith(ref, 'mailto:')"
    return let(trim_sql(href), "ref", let(base, "base", f"CASE WHEN {skip} THEN '' ELSE {url} END"))


def is_http_sql(raw: str) -> str:
    return let(split_sql(trim_sql(raw)), "w", "w.ok AND w.scheme IN ('http', 'https')")


_HOST_NAME = r"if(u.ok, lower(regexp_replace(regexp_replace(u.host, r':[0-9]*\z', ''), r'^\[|\]\z', '')), '')"


def host_sql(raw: str) -> str:
    return let(split_sql(trim_sql(raw)), "u", _HOST_NAME)


_OR_ROOT = "if(dec = '', '/', dec)"
_CANONICAL = f"x -> {canonical_sql('x')}"
_RESOLVE = f"x -> {resolve_sql('x.base', 'x.href')}"
_IS_HTTP = f"x -> {is_http_sql('x')}"
_HOST_OF = f"x -> {host_sql('x')}"
_PATH_OF = f"x -> {let(split_sql(trim_sql('x')), 'u', let(_decode_path('u.path'), 'dec', _OR_ROOT))}"
_ROBOTS = "x -> " + let(
    split_sql("x"),
    "u",
    f"if({_HOST_NAME} = '', '', concat(u.scheme, '://', u.host, '/robots.txt'))",
)


def canonical_url(raw: Column) -> Column:
    """Canonical form of a URL (F1); text that is not a URL comes back unchanged."""
    return apply_sql(raw, _CANONICAL)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute canonical URL of a link on a page (F2); '' for what cannot be followed."""
    return apply_sql(F.struct(base.alias("base"), href.alias("href")), _RESOLVE)


def is_http(raw: Column) -> Column:
    """True for readable http and https URLs."""
    return apply_sql(raw, _IS_HTTP)


def host_of(raw: Column) -> Column:
    """Lower-case host without port, '' when there is none."""
    return apply_sql(raw, _HOST_OF)


def domain_key(raw: Column) -> Column:
    return F.coalesce(F.nullif(host_of(raw), F.lit("")), F.lit("unknown"))


def same_host(a: Column, b: Column) -> Column:
    return (host_of(a) != "") & (host_of(a) == host_of(b))


def path_of(raw: Column) -> Column:
    """Decoded path, '/' when empty: what robots rules are matched against."""
    return apply_sql(raw, _PATH_OF)


def robots_url(page: Column) -> Column:
    """Where the robots file of a page's site lives."""
    return apply_sql(page, _ROBOTS)
