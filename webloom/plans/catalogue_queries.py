"""Queries over sources, catalogue and scalar functions (S, P, F, T1, T7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import clock, text, urls
from webloom.functions.hashing import affinity_shard
from webloom.operators import catalogue as cat
from webloom.operators.extract import cap_body
from webloom.operators.ordered import previous_row
from webloom.plans.registry import query
from webloom.plans.views import with_tables
from webloom.sources import tables as src

# Sources --------------------------------------------------------------------------------------


@query("s1_page_scan", "SELECT page_id, url, least(strlen(html), 4194304) AS body_bytes FROM pages", body_bytes="INTEGER")
def page_scan(t):
    return t.pages.select("page_id", "url", F.octet_length(cap_body(F.col("html"))).alias("body_bytes"))


@query(
    "s2_catalogue_scan",
    with_tables("rules", "tasks", "audit")
    + """SELECT 'rule' AS kind, id, name FROM rules UNION ALL SELECT 'task', id, name FROM tasks
         UNION ALL SELECT 'audit', id, action FROM audit""",
)
def catalogue_scan(t):
    rows = [
        t.rules.select(F.lit("rule").alias("kind"), "id", "name"),
        t.tasks.select(F.lit("task").alias("kind"), "id", "name"),
        t.audit.select(F.lit("audit").alias("kind"), "id", F.col("action").alias("name")),
    ]
    return rows[0].union(rows[1]).union(rows[2])


def _fields_json():
    return F.when(F.col("p_partkey") % 5 == 0, "").otherwise(
        F.concat(
            F.lit('[{"name":"title","kind":"css","expr":"'), F.col("p_name"),
            F.lit('","attr":"text"},{"name":"b","kind":"xpath","expr":"//'), F.col("p_type"), F.lit('"}]'),
        )
    )


@query(
    "s3_decode_json",
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 2 END AS n_fields,
              CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS first_expr,
              CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE '//' || p_type END AS second_expr, 'rule' AS kind
       FROM part
       UNION ALL
       SELECT event_id, len(json_keys(props)), json_extract_string(props, '$.k'), NULL, 'event' FROM events""",
    n_fields="INTEGER",
)
def decode_json(t):
    f = src.decode_fields(_fields_json())
    rules = t.part.select(
        F.col("p_partkey").alias("id"),
        F.size(f).alias("n_fields"),
        F.get(f, F.lit(0))["expr"].alias("first_expr"),
        F.get(f, F.lit(1))["expr"].alias("second_expr"),
        F.lit("rule").alias("kind"),
    )
    m = src.decode_map(F.col("props"))
    events = t.events.select(
        F.col("event_id").alias("id"), F.size(m), F.element_at(m, "k"), F.lit(None).cast("string"), F.lit("event")
    )
    return rules.union(events)


@query(
    "s4_encode_json",
    """SELECT p_partkey AS id,
              CASE WHEN p_partkey % 4 = 0 THEN '[]'
                   ELSE '[{"name":"' || p_name || '","kind":"css","expr":"' || p_type || '"' ||
                        CASE WHEN p_partkey % 4 = 1 THEN '' ELSE ',"attr":"href"' END || '}]' END AS fields,
              CASE WHEN p_partkey % 4 = 0 THEN '[]' ELSE '["' || p_name || '","' || p_brand || '"]' END AS seeds,
              CASE WHEN p_partkey % 4 = 0 THEN '{}' ELSE '{"' || p_type || '":"' || CAST(p_size AS VARCHAR) || '"}' END
                  AS stats
       FROM part""",
)
def encode_json(t):
    some = F.col("p_partkey") % 4 != 0
    field = F.struct(
        F.col("p_name").alias("name"), F.lit("css").alias("kind"), F.col("p_type").alias("expr"),
        F.when(F.col("p_partkey") % 4 == 1, "").otherwise("href").alias("attr"),
    )
    return t.part.select(
        F.col("p_partkey").alias("id"),
        src.encode_fields(F.when(some, F.array(field))).alias("fields"),
        src.encode_strings(F.when(some, F.array("p_name", "p_brand"))).alias("seeds"),
        src.encode_map(F.when(some, F.create_map("p_type", F.col("p_size").cast("string")))).alias("stats"),
    )


@query(
    "s7_job_messages",
    with_tables("jobs")
    + """SELECT CAST(id AS VARCHAR) AS id, task_id, task_id AS rule_id, CAST(1 AS INT) AS rule_version,
                'http://h/' || CAST(id AS VARCHAR) AS url, CAST(0 AS INT) AS depth, CAST(priority AS INT) AS priority,
                CAST(attempt AS INT) AS attempt, enqueued_at FROM jobs""",
)
def job_messages(t):
    """Jobs through their JSON message and back."""
    jobs = t.jobs.select(
        F.col("id").cast("string").alias("id"), "task_id", F.col("task_id").alias("rule_id"),
        F.lit(1).alias("rule_version"), F.concat(F.lit("http://h/"), F.col("id").cast("string")).alias("url"),
        F.lit(0).alias("depth"), "priority", "attempt", "enqueued_at",
    )
    return src.decode_jobs(src.encode_jobs(jobs))


# Projections and filters ----------------------------------------------------------------------


@query(
    "p1_formatted_views",
    with_tables("audit", "crawl_results")
    + """SELECT id, detail, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, 'audit' AS kind FROM audit
         UNION ALL SELECT id, url, strftime(created_at, '%Y-%m-%d %H:%M:%S'), 'result' FROM crawl_results""",
)
def formatted_views(t):
    audit = t.audit.select("id", "detail", "created_at", F.lit("audit").alias("kind"))
    results = t.crawl_results.select("id", "url", "created_at", F.lit("result").alias("kind"))
    return cat.with_formatted_times(audit.union(results), "created_at")


@query(
    "p2_keyword_search",
    with_tables("rules") + "SELECT id, name, start_url FROM rules WHERE name ILIKE '%Ed W_d%' OR start_url ILIKE '%Ed W_d%'",
)
def keyword_search(t):
    return cat.keyword_search(t.rules, " Ed W_d ").select("id", "name", "start_url")


@query(
    "p3_equality_filters",
    with_tables("tasks", "audit", "crawl_results")
    + """SELECT 'task' AS kind, id FROM tasks WHERE status = 'running'
         UNION ALL SELECT 'result', id FROM crawl_results WHERE task_id = 7
         UNION ALL SELECT 'audit', id FROM audit WHERE action = 'robots_disabled'
         UNION ALL SELECT 'any_audit', id FROM audit""",
)
def equality_filters(t):
    frames = {
        "task": cat.equals_or_all(t.tasks, "status", "running"),
        "result": cat.equals_or_all(t.crawl_results, "task_id", 7),
        "audit": cat.equals_or_all(t.audit, "action", "robots_disabled"),
        "any_audit": cat.equals_or_all(t.audit, "action", ""),
    }
    parts = [df.select(F.lit(k).alias("kind"), "id") for k, df in frames.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def _url_variants():
    bare = F.regexp_replace("url", "^https?:", "")
    return F.array("url", F.upper("url"), F.concat(F.lit("ftp:"), bare), bare, F.concat(F.lit(" "), F.col("url")))


_VARIANTS = """SELECT page_id, unnest([url, upper(url), 'ftp:' || regexp_replace(url, '^https?:', ''),
                      regexp_replace(url, '^https?:', ''), ' ' || url]) AS raw FROM pages"""


@query("p4_http_urls", f"SELECT page_id, raw FROM ({_VARIANTS}) WHERE regexp_matches(lower(trim(raw)), '^https?:')")
def http_urls(t):
    raw = t.pages.select("page_id", F.explode(_url_variants()).alias("raw"))
    return raw.filter(urls.is_http(F.col("raw")))


@query(
    "p5_fail_predicate",
    with_tables("fetch_log")
    + "SELECT fetch_id, status >= 400 AS fail, status IN (429, 403) AS blocked FROM fetch_log",
)
def fail_predicate(t):
    s = F.col("status")
    return t.fetch_log.select("fetch_id", text.failed(s).alias("fail"), text.blocked(s).alias("blocked"))


@query(
    "p6_retryable",
    with_tables("fetch_log")
    + "SELECT fetch_id, fetch_id % 17 = 0 OR status IN (429, 502, 503, 504) AS retry FROM fetch_log",
)
def retryable(t):
    error = F.when(F.col("fetch_id") % 17 == 0, "timeout")
    return t.fetch_log.select("fetch_id", text.retryable(F.col("status"), error).alias("retry"))


# In the first 256 bytes: what stands before the mark, and the mark, fit into them.
_MARKED = " OR ".join(
    f"contains(lower(body), '{m}') AND strlen(split_part(lower(body), '{m}', 1)) + {len(m)} <= 256"
    for m in ("<html", "<!doctype")
)


@query(
    "p7_looks_like_html",
    f"""SELECT id, kind, id % 3 = 0 OR {_MARKED} AS is_html FROM (
           SELECT page_id AS id, 'page' AS kind, html AS body FROM pages
           UNION ALL SELECT page_id, 'late', repeat('é', page_id % 256) || html FROM pages
           UNION ALL SELECT doc_id, 'document', text FROM documents)""",
)
def looks_like_html(t):
    page, html = F.col("page_id"), F.col("html")
    late = F.concat(F.repeat(F.lit("é"), (page % 256).cast("int")), html)
    rows = (
        t.pages.select(page.alias("id"), F.lit("page").alias("kind"), html.alias("body"))
        .union(t.pages.select(page, F.lit("late"), late))
        .union(t.documents.select("doc_id", F.lit("document"), "text"))
    )
    kind = F.when(F.col("id") % 3 == 0, "Text/HTML; charset=utf-8").otherwise("text/plain")
    return rows.select("id", "kind", text.looks_like_html(F.col("body"), kind).alias("is_html"))


def _part_fields():
    def field(name, kind, expr, attr):
        return F.struct(name.alias("name"), kind.alias("kind"), expr.alias("expr"), attr.alias("attr"))

    k = F.col("p_partkey")
    first = field(F.concat(F.lit(" "), F.col("p_name")), F.lit(" CSS "), F.lit(".t"), F.lit(""))
    second = field(
        F.when(k % 3 == 0, "  ").otherwise("b"),
        F.when(k % 5 == 0, "json").otherwise("regex"),
        F.when(k % 7 == 0, "").otherwise(F.col("p_type")),
        F.lit("href"),
    )
    return F.array(first, second)


_SECOND_BAD = "p_partkey % 3 = 0 OR p_partkey % 5 = 0 OR p_partkey % 7 = 0"


@query(
    "p8_usable_fields",
    f"""SELECT p_partkey AS id, CASE WHEN {_SECOND_BAD} THEN 1 ELSE 2 END AS n_fields,
               trim(p_name) || '|css|.t|text' ||
               CASE WHEN {_SECOND_BAD} THEN '' ELSE ',b|regex|' || p_type || '|href' END AS fields FROM part""",
)
def usable_fields(t):
    f = cat.usable_fields(_part_fields())
    flat = F.array_join(F.transform(f, lambda x: F.concat_ws("|", x["name"], x["kind"], x["expr"], x["attr"])), ",")
    return t.part.select(F.col("p_partkey").alias("id"), F.size(f).alias("n_fields"), flat.alias("fields"))


@query(
    "p9_rule_problems",
    """SELECT p_partkey AS id, concat_ws(';', CASE WHEN p_partkey % 11 = 0 THEN 'no name' END,
              CASE WHEN p_partkey % 13 = 0 THEN 'no start address' END,
              CASE WHEN p_partkey % 3 = 0 THEN 'at 1: field without a name'
                   WHEN p_partkey % 7 = 0 THEN 'at 1: field without an expression'
                   WHEN p_partkey % 5 = 0 THEN 'at 1: unknown kind of field' END,
              CASE WHEN p_size <= 5 THEN 'rate is not positive' END) AS problems FROM part""",
)
def rule_problems(t):
    k = F.col("p_partkey")
    rules = t.part.select(
        k.alias("id"),
        F.when(k % 11 == 0, "  ").otherwise(F.col("p_name")).alias("name"),
        F.when(k % 13 == 0, "").otherwise(F.col("p_brand")).alias("start_url"),
        (F.col("p_size") - 5.0).alias("qps"),
        _part_fields().alias("fields"),
    )
    return rules.select("id", F.array_join(cat.rule_problems(), ";").alias("problems"))


@query(
    "p10_task_input",
    """SELECT c_custkey AS id, c_name AS name, CAST(greatest(c_custkey % 4 - 1, 1) AS INT) AS max_depth,
              CAST(CASE WHEN c_custkey % 3 < 1 THEN 2 ELSE c_custkey % 3 END AS INT) AS concurrency,
              CASE WHEN c_custkey % 6 = 0 THEN ''
                   WHEN c_mktsegment = 'BUILDING' THEN 'http://BUILDING,b'
                   ELSE 'http://' || c_mktsegment || ',b' END AS seeds,
              CASE WHEN c_nationkey = 0 THEN 'no rule chosen' WHEN c_custkey % 6 = 0 THEN 'no seeds'
                   ELSE '' END AS problem
       FROM customer""",
)
def task_input(t):
    seg = F.concat(F.lit(" http://"), F.col("c_mktsegment"), F.lit(" "))
    seeds = F.when(F.col("c_custkey") % 6 == 0, F.array(F.lit(" "), F.lit(""))).otherwise(
        F.array(seg, F.lit("b"), F.lit(""), F.trim(seg), F.lit(" b"))
    )
    raw = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit(" "), F.col("c_name"), F.lit("\t")).alias("name"),
        F.col("c_nationkey").alias("rule_id"),
        seeds.alias("seed_urls"),
        (F.col("c_custkey") % 4 - 1).cast("int").alias("max_depth"),
        (F.col("c_custkey") % 3).cast("int").alias("concurrency"),
    )
    return cat.normalize_task(raw).select(
        "id", "name", "max_depth", "concurrency", F.array_join("seed_urls", ",").alias("seeds"),
        cat.task_problem().alias("problem"),
    )


@query(
    "p11_rule_patches",
    """WITH p AS (SELECT event_id AS seq, event_id % 150 AS id, event_type, user_id, value
                  FROM events),
            m AS (SELECT id, count(*) AS n, arg_max('n' || CAST(user_id AS VARCHAR), seq) FILTER (event_type = 'view') AS name,
                         arg_max('u' || CAST(user_id AS VARCHAR), seq) FILTER (event_type IN ('click', 'view')) AS start_url,
                         arg_max(value, seq) FILTER (event_type = 'error') AS qps FROM p GROUP BY id)
       SELECT p_partkey AS id, coalesce(m.name, p_name) AS name, coalesce(m.start_url, p_brand) AS start_url,
              coalesce(m.qps, p_size / 10.0) AS qps, CAST(1 + coalesce(n, 0) AS INT) AS version
       FROM part LEFT JOIN m ON m.id = p_partkey""",
)
def rule_patches(t):
    fields_type = "array<struct<name:string,kind:string,expr:string,attr:string>>"
    rules = t.rules.select(
        "id", "name", "start_url", F.lit("").alias("item_selector"), F.lit("").alias("link_selector"),
        F.array().cast(fields_type).alias("fields"), F.lit(True).alias("respect_robots"), "qps",
        F.lit(1).alias("version"),
    )
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    patches = t.events.select(
        (F.col("event_id") % 150).alias("id"),
        F.col("event_id").alias("seq"),
        F.when(kind == "view", F.concat(F.lit(" n"), user)).otherwise(" ").alias("name"),
        F.when(kind.isin("click", "view"), F.concat(F.lit("u"), user)).otherwise("").alias("start_url"),
        F.lit("").alias("item_selector"),
        F.lit("").alias("link_selector"),
        F.lit(None).cast(fields_type).alias("fields"),
        F.lit(None).cast("boolean").alias("respect_robots"),
        F.when(kind == "error", F.col("value")).alias("qps"),
    )
    return cat.apply_patches(rules, patches).select("id", "name", "start_url", "qps", "version")


@query(
    "p15_eligibility",
    with_tables("tasks")
    + """SELECT id, status, status IN ('created', 'paused') AS can_start, status = 'running' AS can_pause,
                status IN ('created', 'running', 'paused') AS can_cancel, status = 'running' AS active,
                status IN ('succeeded', 'failed', 'cancelled') AS terminal FROM tasks""",
)
def eligibility(t):
    return cat.eligibility(t.tasks).select("id", "status", "can_start", "can_pause", "can_cancel", "active", "terminal")


@query(
    "j10_transition_violations",
    with_tables(
        "task_events",
        h="SELECT *, lag(status) OVER (PARTITION BY task_id ORDER BY us, id) AS prev_status FROM task_events",
        ok="""SELECT * FROM (VALUES ('created', 'running'), ('created', 'cancelled'), ('running', 'paused'),
              ('running', 'succeeded'), ('running', 'failed'), ('running', 'cancelled'), ('paused', 'running'),
              ('paused', 'cancelled')) v(a, b)""",
    )
    + """SELECT id, task_id, prev_status, status FROM h WHERE prev_status IS NOT NULL AND prev_status <> status
         AND NOT EXISTS (SELECT 1 FROM ok WHERE a = prev_status AND b = status)""",
)
def transition_violations(t):
    return cat.transition_violations(status_history(t)).select("id", "task_id", "prev_status", "status")


@query(
    "w7_status_history",
    with_tables("task_events")
    + "SELECT id, task_id, status, lag(status) OVER (PARTITION BY task_id ORDER BY us, id) AS prev_status FROM task_events",
)
def status_history(t):
    return previous_row(
        t.task_events.select("id", "task_id", "us", "status"), ["task_id"], ["us", "id"], {"prev_status": "status"}
    ).select("id", "task_id", "status", "prev_status")


@query(
    "w13_compliance_changes",
    """WITH v AS (SELECT p_partkey % 97 AS id, p_partkey // 97 + 1 AS version, p_size % 3 <> 0 AS respect FROM part)
       SELECT id, version, 'robots_disabled' AS action
       FROM (SELECT *, coalesce(lag(respect) OVER (PARTITION BY id ORDER BY version), true) AS was FROM v)
       WHERE was AND NOT respect""",
)
def compliance_changes(t):
    from webloom.operators.telemetry import compliance_changes as changes

    versions = t.part.select(
        (F.col("p_partkey") % 97).alias("id"),
        (F.floor(F.col("p_partkey") / 97) + 1).alias("version"),
        (F.col("p_size") % 3 != 0).alias("respect_robots"),
    )
    return changes(versions)


# Paging ---------------------------------------------------------------------------------------


@query(
    "t1_result_page",
    with_tables("crawl_results")
    + "SELECT id, task_id FROM crawl_results WHERE task_id = 3 ORDER BY id DESC LIMIT 200 OFFSET 200",
)
def result_page(t):
    rows = cat.equals_or_all(t.crawl_results.select("id", "task_id"), "task_id", 3)
    return cat.page_of(rows, page=2, size=500)


@query(
    "t7_latest_audit",
    with_tables("audit") + "SELECT id, action, detail FROM audit WHERE action = 'robots_disabled' ORDER BY id DESC LIMIT 50",
)
def latest_audit(t):
    return cat.latest_audit(t.audit, "robots_disabled").select("id", "action", "detail")


@query(
    "a4_listing_totals",
    with_tables("crawl_results", "rules", "tasks")
    + """SELECT 'results' AS listing, count(*) AS total FROM crawl_results WHERE task_id = 3
         UNION ALL SELECT 'rules', count(*) FROM rules WHERE name ILIKE '%ring%' OR start_url ILIKE '%ring%'
         UNION ALL SELECT 'tasks', count(*) FROM tasks WHERE status = 'paused'""",
)
def listing_totals(t):
    frames = {
        "results": cat.equals_or_all(t.crawl_results, "task_id", 3),
        "rules": cat.keyword_search(t.rules, "ring"),
        "tasks": cat.equals_or_all(t.tasks, "status", "paused"),
    }
    parts = [cat.row_count(df).select(F.lit(k).alias("listing"), "total") for k, df in frames.items()]
    return parts[0].union(parts[1]).union(parts[2])


# Scalar functions -----------------------------------------------------------------------------

_RAW_URLS = """SELECT page_id, k, canonical, CASE k
        WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^http', 'HTTP')
        WHEN 2 THEN regexp_replace(url, '^(https?://[^/]+)/', '\\1/x/.././/')
        WHEN 3 THEN '  ' || canonical || '#a?b#c' END AS raw
    FROM page_parts, (VALUES (0), (1), (2), (3)) v(k)"""


@query(
    "f1_canonical_url",
    with_tables("page_parts", r=_RAW_URLS) + "SELECT page_id, k, raw, canonical AS url FROM r",
)
def canonical_url(t):
    """Four spellings of every page URL come down to one."""
    url = F.col("url")
    bare = F.regexp_replace(url, "#.*$", "")
    forms = F.array(
        url,
        F.regexp_replace(url, "^http", "HTTP"),
        F.regexp_replace(url, "^(https?://[^/]+)/", "$1/x/.././/"),
        F.concat(F.lit("  "), bare, F.lit("#a?b#c")),
    )
    raw = t.pages.select("page_id", F.posexplode(forms).alias("k", "raw"))
    return raw.select("page_id", "k", "raw", urls.canonical_url(F.col("raw")).alias("url"))


_REFS = """SELECT page_id, canonical, site, rtrim(regexp_extract(path, '^(.*/)'), '') AS folder, k, CASE k
        WHEN 0 THEN '/a/' || CAST(page_id AS VARCHAR) WHEN 1 THEN 'b.html?z=1&y=2' WHEN 2 THEN '../c'
        WHEN 3 THEN '#top' WHEN 4 THEN 'javascript:x()' WHEN 5 THEN '//Other.example/q' WHEN 6 THEN 'mailto:a@b'
        WHEN 7 THEN 'HTTP://Full.example' END AS href
    FROM page_parts, (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) v(k)"""


@query(
    "f2_resolve_url",
    with_tables("page_parts", r=_REFS)
    + """SELECT page_id, k, CASE k WHEN 0 THEN site || href WHEN 1 THEN site || folder || 'b.html?y=2&z=1'
                WHEN 2 THEN site || regexp_replace(folder, '[^/]+/$', '') || 'c'
                WHEN 5 THEN regexp_extract(site, '^https?:') || '//other.example/q'
                WHEN 7 THEN 'http://full.example/' ELSE '' END AS link FROM r""",
)
def resolve_url(t):
    refs = F.array(
        F.concat(F.lit("/a/"), F.col("page_id").cast("string")),
        *[F.lit(v) for v in ("b.html?z=1&y=2", "../c", "#top", "javascript:x()", "//Other.example/q", "mailto:a@b",
                             "HTTP://Full.example")],
    )
    rows = t.pages.select("page_id", "url", F.posexplode(refs).alias("k", "href"))
    return rows.select("page_id", "k", urls.resolve_url(F.col("url"), F.col("href")).alias("link"))


@query(
    "f3_host_keys",
    with_tables("page_parts")
    + """SELECT page_id, lower(host) AS host, CASE WHEN page_id % 5 = 0 THEN 'unknown' ELSE lower(host) END AS domain,
                page_id % 5 <> 0 AS same FROM page_parts""",
)
def host_keys(t):
    url = F.regexp_replace(F.upper("url"), "^(HTTPS?://[^/]+)", "$1:8080")
    maybe = F.when(F.col("page_id") % 5 == 0, "/relative").otherwise(F.col("url"))
    return t.pages.select(
        "page_id",
        urls.host_of(url).alias("host"),
        urls.domain_key(maybe).alias("domain"),
        urls.same_host(url, maybe).alias("same"),
    )


@query(
    "f4_affinity_shard",
    with_tables("page_parts")
    + """SELECT page_id, CAST(list_reduce([2166136261::UBIGINT] || list_transform(string_split(lower(host), ''),
                    lambda c: ascii(c)::UBIGINT),
                    lambda h, b: (xor(h, b) * 16777619::UBIGINT) & 4294967295::UBIGINT) % 7 AS BIGINT) AS shard
         FROM page_parts""",
)
def affinity(t):
    return t.pages.select("page_id", affinity_shard(urls.host_of(F.col("url")), 7).alias("shard"))


@query(
    "f6_normalize_text",
    """SELECT doc_id, md5(regexp_replace(regexp_replace(text, '^[\\s\\v]+|[\\s\\v]+$', '', 'g'), '\\s+', ' ', 'g')) AS norm_md5,
              CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'x y' END AS first_value
       FROM documents""",
)
def normalize_text(t):
    first = text.first_non_empty(F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("  "), F.lit(" x  y "))
    return t.documents.select(
        "doc_id", F.md5(text.normalize_text(F.col("text"))).alias("norm_md5"), first.alias("first_value")
    )


@query(
    "f7_parse_price",
    """SELECT l_orderkey, l_linenumber, l_extendedprice,
              CASE l_linenumber WHEN 5 THEN 'v' ELSE 'p' END AS form,
              CASE WHEN l_linenumber = 4 THEN '1' ELSE CASE WHEN l_linenumber > 4 THEN '.' ELSE '' END || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.5' END AS amount,
              CASE l_linenumber WHEN 1 THEN 'CNY' WHEN 2 THEN 'USD' WHEN 3 THEN 'EUR' WHEN 4 THEN 'GBP' ELSE '' END
                  AS currency
       FROM lineitem""",
)
def parse_price(t):
    n = F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(".5"))
    line = F.col("l_linenumber")
    raw = (
        F.when(line == 1, F.concat(F.lit("now ¥ "), n))
        .when(line == 2, F.concat(F.lit("$"), n, F.lit(" only")))
        .when(line == 3, F.concat(F.lit("€  "), n))
        .when(line == 4, F.lit("£1,299"))
        .otherwise(F.concat(F.lit("ca. "), n, F.lit(" pcs")))
    )
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        F.when(line == 5, "v").otherwise("p").alias("form"),
        text.price_amount(raw).alias("amount"),
        text.price_currency(raw).alias("currency"),
    )


@query(
    "f8_clock",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS wall,
              CAST(floor(epoch(ts)) AS BIGINT) - 28800 AS unix_s,
              strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day,
              strftime(date_trunc('second', ts) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS parsed_zoned,
              strftime(ts + INTERVAL 90 SECOND, '%Y-%m-%d %H:%M:%S') AS later
       FROM events""",
)
def wall_clock(t):
    ts = F.col("ts")
    zoned = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return t.events.select(
        "event_id",
        clock.format_wall(clock.parse_time(clock.format_wall(ts))).alias("wall"),
        clock.to_unix(ts).alias("unix_s"),
        clock.format_wall(clock.start_of_day(ts)).alias("day"),
        clock.format_wall(clock.parse_time(zoned)).alias("parsed_zoned"),
        clock.format_wall(clock.add_seconds(ts, F.lit(90))).alias("later"),
    )


@query(
    "f9_f10_tones",
    """SELECT event_id, CASE WHEN pct > 10 THEN 'bad' WHEN pct > 5 THEN 'warn' ELSE 'ok' END AS tone,
              floor(value * 10 + 0.5) / 10 AS r1, floor(value * 1000 + 0.5) / 1000 AS r3
       FROM (SELECT event_id, value, CASE WHEN value <= 1 THEN value * 100 ELSE value END AS pct FROM events)""",
)
def tones(t):
    v = F.col("value")
    return t.events.select(
        "event_id", text.fail_tone(v).alias("tone"), text.round_half_up(v, 1).alias("r1"),
        text.round_half_up(v, 3).alias("r3"),
    )


@query(
    "f11_backoff",
    """SELECT event_id, least((CASE WHEN user_id % 3 = 0 THEN 200.0 ELSE user_id END)
                  * pow(2, greatest(0, least(6, event_id % 10 - 1))), 8000.0) AS wait_ms FROM events""",
)
def backoff(t):
    base = F.when(F.col("user_id") % 3 == 0, -1).otherwise(F.col("user_id"))
    return t.events.select("event_id", text.backoff_ms(F.col("event_id") % 10 - 1, base).alias("wait_ms"))


@query(
    "f12_f13_selectors",
    """SELECT p_partkey AS id, regexp_matches(p_type, '^[A-Za-z_-][A-Za-z0-9_-]*$') AS safe_type,
              regexp_matches(p_brand, '^[A-Za-z_-][A-Za-z0-9_-]*$') AS safe_brand,
              CASE p_partkey % 4 WHEN 0 THEN '//*[@id=''' || p_type || ''']'
                  WHEN 1 THEN '//*[contains(concat('' '', normalize-space(@class), '' ''), '' ' || p_type || ' '')]'
                  WHEN 2 THEN '//#' || p_brand ELSE '//' || p_type END AS xpath
       FROM part""",
)
def selector_helpers(t):
    k = F.col("p_partkey") % 4
    css = F.concat(
        F.when(k == 0, "#").when(k == 1, " .").when(k == 2, "#").otherwise(""),
        F.when(k == 2, F.col("p_brand")).otherwise(F.col("p_type")),
    )
    return t.part.select(
        F.col("p_partkey").alias("id"),
        text.is_safe_ident(F.col("p_type")).alias("safe_type"),
        text.is_safe_ident(F.col("p_brand")).alias("safe_brand"),
        text.css_to_xpath(css).alias("xpath"),
    )


@query(
    "f14_robots_url",
    with_tables("page_parts")
    + """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '' ELSE site || '/robots.txt' END AS robots FROM page_parts""",
)
def robots_location(t):
    page = F.when(F.col("page_id") % 4 == 0, "/local").otherwise(F.col("url"))
    return t.pages.select("page_id", urls.robots_url(page).alias("robots"))


@query(
    "f15_clip_box",
    """WITH b AS (SELECT event_id, value * 4 - 100 AS x, value * 3 - 50 AS y, value * 8 AS w, value * 5 AS h FROM events),
            c AS (SELECT event_id, greatest(x, 0) AS x, greatest(y, 0) AS y, w + least(x, 0) AS w, h + least(y, 0) AS h FROM b)
       SELECT event_id, round(x, 6) AS x, round(y, 6) AS y,
              round(greatest(CASE WHEN x + w > 1440 THEN 1440 - x ELSE w END, 0), 6) AS w,
              round(greatest(CASE WHEN y + h > 900 THEN 900 - y ELSE h END, 0), 6) AS h FROM c""",
)
def clip_box(t):
    v = F.col("value")
    box = text.clip_box(v * 4 - 100, v * 3 - 50, v * 8, v * 5, 1440.0, 900.0)
    clipped = t.events.select("event_id", box.alias("b"))
    return clipped.select("event_id", *[F.round(F.col(f"b.{c}"), 6).alias(c) for c in "xywh"])


@query(
    "f16_json_counters",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(0 AS BIGINT) AS missing,
              CAST(json_extract_string(props, '$.k') AS BIGINT) + user_id AS k_added, user_id AS fresh_added
       FROM events""",
)
def json_counters(t):
    m = src.decode_map(F.col("props"))
    return t.events.select(
        "event_id",
        text.json_long(m, "k").alias("k"),
        text.json_long(m, "none").alias("missing"),
        text.json_long(text.json_add(m, "k", F.col("user_id")), "k").alias("k_added"),
        text.json_long(text.json_add(m, "new", F.col("user_id")), "new").alias("fresh_added"),
    )


@query(
    "f17_candidate_score",
    """WITH c AS (SELECT p_partkey AS id, p_size % 4 AS hits, CASE WHEN p_size % 2 = 0 THEN 'css' ELSE 'xpath' END AS kind,
                  CASE p_partkey % 6 WHEN 0 THEN '#a' WHEN 1 THEN '[data-x=''1'']' WHEN 2 THEN 'div.t'
                       WHEN 3 THEN 'input[name=''q'']' WHEN 4 THEN 'li:nth-child(2)' ELSE 'b.c > i:nth-child(1)' END AS expr
                  FROM part)
       SELECT id, round(greatest(0.05, least(1.0,
              CASE WHEN starts_with(expr, '#') OR contains(expr, '[@id=') THEN 0.98 WHEN contains(expr, 'data-') THEN 0.93
                   WHEN contains(expr, '.') AND NOT contains(expr, 'nth-child') THEN 0.82
                   WHEN contains(expr, '[') THEN 0.7 ELSE 0.45 END
              + CASE WHEN hits = 1 THEN 0.05 WHEN hits > 1 THEN -0.15 ELSE 0 END
              - CASE WHEN kind = 'xpath' THEN 0.04 ELSE 0 END)), 6) AS score FROM c""",
    score="DOUBLE",
)
def candidate_score(t):
    k = F.col("p_partkey") % 6
    expr = F.lit("b.c > i:nth-child(1)")
    forms = ["#a", "[data-x='1']", "div.t", "input[name='q']", "li:nth-child(2)"]
    for i, form in enumerate(forms):
        expr = F.when(k == i, form).otherwise(expr)
    kind = F.when(F.col("p_size") % 2 == 0, "css").otherwise("xpath")
    return t.part.select(
        F.col("p_partkey").alias("id"),
        F.round(text.candidate_score(kind, expr, F.col("p_size") % 4), 6).alias("score"),
    )
