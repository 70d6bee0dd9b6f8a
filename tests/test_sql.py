from webloom.functions.sql import register_functions


def test_sql_functions(spark, library):
    register_functions(spark)
    library.createOrReplaceTempView("library_pages")
    row = spark.sql(
        "SELECT canonical_url('HTTP://A/b/../c?y=1&x=2#z') AS c, resolve_url('http://a/b/', '../d') AS r, "
        "is_http('ftp://x') AS h, host_of('http://A:80/') AS host"
    ).first()
    assert tuple(row) == ("http://a/c?x=2&y=1", "http://a/d", False, "a")
    tags = spark.sql(
        "SELECT n.tag, count(*) AS c FROM (SELECT explode(shred_page(html).nodes) AS n FROM library_pages WHERE page_id = 1) "
        "GROUP BY n.tag"
    )
    assert {r.tag: r.c for r in tags.collect()}["li"] == 9
    links = spark.sql(
        "SELECT DISTINCT resolve_url(url, n.attrs['href']) AS link FROM "
        "(SELECT url, explode(shred_page(html).nodes) AS n FROM library_pages) WHERE n.tag = 'a' AND n.attrs['class'] = 'entry'"
    )
    assert links.count() == 10
