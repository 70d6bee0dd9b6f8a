"""Catalogue of rules, tasks, results and audit rows: views, filters, checks, paging, patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.clock import format_wall
from webloom.functions.text import trim_space

PAGE_SIZE, MAX_PAGE_SIZE = 20, 200
# The kinds a field may have.
KINDS = ("xpath", "css", "regex")
# Allowed status changes of a task.
TRANSITIONS = (
    ("created", "running"),
    ("created", "cancelled"),
    ("running", "paused"),
    ("running", "succeeded"),
    ("running", "failed"),
    ("running", "cancelled"),
    ("paused", "running"),
    ("paused", "cancelled"),
)


def with_formatted_times(df: DataFrame, *cols: str) -> DataFrame:
    """Output view of a row: its times as text."""
    return df.withColumns({c: format_wall(F.col(c)) for c in cols})


def keyword_search(rules: DataFrame, keyword: str) -> DataFrame:
    """Case-insensitive substring of name or start URL; % and _ stay wildcards."""
    word = keyword.strip(" \t\r\n")
    if not word:
        return rules
    pattern = f"%{word}%"
    return rules.filter(F.col("name").ilike(pattern) | F.col("start_url").ilike(pattern))


def equals_or_all(df: DataFrame, column: str, value: str | int) -> DataFrame:
    """Equality filter; '' and 0 mean no filter."""
    return df if value in ("", 0) else df.filter(F.col(column) == value)


def page_of(df: DataFrame, page: int = 1, size: int = PAGE_SIZE, order: str = "id") -> DataFrame:
    """One page, newest first (T1). Planned as a top-k, so only page * size rows leave a task."""
    page = max(page, 1)
    size = PAGE_SIZE if size < 1 else min(size, MAX_PAGE_SIZE)
    return df.orderBy(F.desc(order)).offset((page - 1) * size).limit(size)


def page_after(df: DataFrame, last_id: int | None, size: int = PAGE_SIZE, order: str = "id") -> DataFrame:
    """The page that follows a given id: deep paging without an offset."""
    size = PAGE_SIZE if size < 1 else min(size, MAX_PAGE_SIZE)
    rest = df if last_id is None else df.filter(F.col(order) < last_id)
    return rest.orderBy(F.desc(order)).limit(size)


def row_count(df: DataFrame) -> DataFrame:
    """Total of a listing (A4)."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def latest_audit(audit: DataFrame, action: str = "", limit: int = 50) -> DataFrame:
    """Newest audit rows of an action."""
    return equals_or_all(audit, "action", action).orderBy(F.desc("id")).limit(limit if limit > 0 else 50)


# Fields and rules -----------------------------------------------------------------------------


def normalize_field(f: Column) -> Column:
    attr = trim_space(F.coalesce(f["attr"], F.lit("")))
    return F.struct(
        trim_space(f["name"]).alias("name"),
        F.lower(trim_space(f["kind"])).alias("kind"),
        trim_space(f["expr"]).alias("expr"),
        F.when(attr == "", "text").otherwise(attr).alias("attr"),
    )


def field_problem(f: Column) -> Column:
    """Why a normalised field cannot be used; '' when it can."""
    return (
        F.when(f["name"] == "", "field without a name")
        .when(f["expr"] == "", "field without an expression")
        .when(~f["kind"].isin(*KINDS), "unknown kind of field")
        .otherwise("")
    )


def usable_fields(fields: Column) -> Column:
    """Normalised fields without the unusable ones."""
    return F.filter(F.transform(fields, normalize_field), lambda f: field_problem(f) == "")


def rule_problems(fields: Column | None = None) -> Column:
    """ARRAY of everything wrong with a rule row, in checking order."""
    fields = F.col("fields") if fields is None else fields
    per_field = F.filter(
        F.transform(
            F.transform(fields, normalize_field),
            lambda f, i: F.when(
                field_problem(f) != "", F.concat(F.lit("at "), i.cast("string"), F.lit(": "), field_problem(f))
            ),
        ),
        lambda e: e.isNotNull(),
    )
    head = F.array_compact(
        F.array(
            F.when(trim_space(F.col("name")) == "", "no name"),
            F.when(trim_space(F.col("start_url")) == "", "no start address"),
        )
    )
    return F.concat(head, per_field, F.array_compact(F.array(F.when(F.col("qps") <= 0, "rate is not positive"))))


def apply_patches(rules: DataFrame, patches: DataFrame) -> DataFrame:
    """Rules after their patches, oldest first; blank and NULL keep the old value.

    Every column takes its newest patched value on its own, so one aggregation per rule replaces the
    replay of the patches; each patch raises the version by one. ``patches``: id, seq, name,
    start_url, item_selector, link_selector, fields, respect_robots, qps.
    """
    def newest(value: Column, keep: Column) -> Column:
        return F.max_by(value, F.when(keep, F.col("seq")))

    text = {c: trim_space(F.col(c)) for c in ("name", "start_url")}
    sel = ("item_selector", "link_selector")
    plain = ("fields", "respect_robots", "qps")
    merged = patches.groupBy("id").agg(
        *[newest(v, v != "").alias(f"_{c}") for c, v in text.items()],
        *[newest(trim_space(F.col(c)), F.col(c) != "").alias(f"_{c}") for c in sel],
        *[newest(F.col(c), F.col(c).isNotNull()).alias(f"_{c}") for c in plain],
        F.count(F.lit(1)).cast("int").alias("_n"),
    )
    out = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in (*text, *sel, "respect_robots", "qps")}
    out["fields"] = F.coalesce(F.transform("_fields", normalize_field), F.col("fields"))
    out["version"] = F.col("version") + F.coalesce("_n", F.lit(0))
    return rules.join(merged, "id", "left").withColumns(out).select(*rules.columns)


# Tasks ----------------------------------------------------------------------------------------


def normalize_task(tasks: DataFrame) -> DataFrame:
    """Trimmed name, depth of at least 1, concurrency of at least 1 (else 2), distinct seeds (P10)."""
    seeds = F.filter(F.transform("seed_urls", trim_space), lambda s: s != "")
    return tasks.withColumns(
        {
            "name": trim_space(F.col("name")),
            "max_depth": F.greatest(F.col("max_depth"), F.lit(1)),
            "concurrency": F.when(F.col("concurrency") < 1, 2).otherwise(F.col("concurrency")),
            "seed_urls": F.array_distinct(seeds),
        }
    )


def task_problem() -> Column:
    """First failed check of a normalised task row, '' when it passes (P10)."""
    return (
        F.when(F.col("name") == "", "no name")
        .when(F.coalesce(F.col("rule_id"), F.lit(0)) <= 0, "no rule chosen")
        .when(F.size("seed_urls") == 0, "no seeds")
        .otherwise("")
    )


def eligibility(tasks: DataFrame) -> DataFrame:
    """What may be done with each task, by status."""
    s = F.col("status")
    return tasks.withColumns(
        {
            "can_start": s.isin("created", "paused"),
            "can_pause": s == "running",
            "can_cancel": s.isin("created", "running", "paused"),
            "active": s == "running",
            "terminal": s.isin("succeeded", "failed", "cancelled"),
        }
    )


def transition_allowed(old: Column, new: Column) -> Column:
    """Whether a status change is in the fixed list: eight literals, no join."""
    return F.struct(old, new).isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in TRANSITIONS])


def sources_for(status: str) -> list[str]:
    return [a for a, b in TRANSITIONS if b == status]


def transition_violations(history: DataFrame) -> DataFrame:
    """Status changes that are not allowed; the first status of a task is not a change.

    ``history`` carries prev_status next to status, as previous_row leaves it (W7).
    """
    changed = F.col("prev_status").isNotNull() & (F.col("prev_status") != F.col("status"))
    return history.filter(changed & ~transition_allowed(F.col("prev_status"), F.col("status")))
