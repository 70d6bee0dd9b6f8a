from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from webloom.session import build_session  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def reading_list(n: int = 9) -> str:
    works = "".join(
        f"""<li class="work" id="w-{i}"><cite>Study {i}</cite> <span class="who">Author {i}</span>
        <span class="year">{1950 + i}</span><q>Notes on {i}</q><a class="entry" rel="bookmark" href="/works/w-{i}.html">record</a></li>"""
        for i in range(1, n + 1)
    )
    return f"""<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Reading list</title></head><body>
        <div class="sheet"><h1>Reading list</h1><p class="intro">Sorted by year. <a href="/">Home</a></p>
        <ol class="works">{works}</ol><footer>Nine works in all</footer></div></body></html>"""


def record(i: int) -> str:
    return f"""<html><body><div class="record" id="w-{i}"><h2>Study {i}</h2><dl><dt>Author</dt><dd class="who">Author {i}</dd>
        <dt>Year</dt><dd class="year">{1950 + i}</dd></dl><a class="entry" href="/works/index.html">list</a></div></body></html>"""


@pytest.fixture(scope="session")
def library(spark):
    """A reading list and the records of its nine works."""
    rows = [(1, "http://library.test/works/index.html", reading_list())]
    rows += [(i + 1, f"http://library.test/works/w-{i}.html", record(i)) for i in range(1, 10)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")
