"""Paged lists: stop rules against a reader that walks, and an API that counts what it is asked for."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from serialloom.operators import paging
from serialloom.sources import api

LINKS = "novel_id bigint, page bigint, pos bigint, number bigint, title string, url string"


def scanned(pages, max_pages, needed):
    """pages: {page: [(pos, number)]}."""
    found, page = {}, 1
    while pages.get(page):
        before = len(found)
        for pos, n in sorted(pages[page]):
            found.setdefault(n, (page, pos))
        if (needed is not None and len(found) >= needed) or len(found) == before or page >= max_pages:
            break
        page += 1
    return {(n, *at) for n, at in found.items()}


@pytest.mark.parametrize(("max_pages", "needed"), [(500, None), (3, None), (500, 7), (500, 0)])
def test_a_scan_stops_where_a_walk_does(spark, max_pages, needed):
    rng = random.Random(max_pages + (needed or 0))
    books = {}
    for i in range(60):
        pages = {p: [(k, rng.randint(1, 5 * rng.randint(1, p))) for k in range(rng.randint(1, 5))] for p in range(1, rng.randint(2, 9))}
        for p in rng.sample(sorted(pages), k=rng.choice([0, 0, 1])):
            del pages[p]
        books[i] = pages
    links = spark.createDataFrame([(i, p, k, n, "t", "u") for i, pages in books.items() for p, x in pages.items() for k, n in x], LINKS).repartition(5)
    got = {}
    for r in paging.paged_scan(links, max_pages, needed).collect():
        got.setdefault(r.novel_id, set()).add((r.number, r.page, r.pos))
    assert got == {i: x for i, pages in books.items() if (x := scanned(pages, max_pages, needed))}


def test_newest_first_numbers_from_the_oldest(spark):
    rng = random.Random(4)
    books, totals, want, window = {}, {}, {}, {}
    for i in range(60):
        full = rng.randint(1, 4)
        sizes = [full] * rng.randint(1, 5) + [rng.randint(0, full)] + [full]
        total = rng.choice([None, 0, sum(sizes), rng.randint(1, 25)])
        books[i], totals[i] = sizes, total
        taken = []
        for p, size in enumerate(sizes, 1):
            if not size:
                break
            taken += [(p, k) for k in range(size)]
            if (total and len(taken) >= total) or size < sizes[0]:
                break
        want[i] = {(p, k, len(taken) - at) for at, (p, k) in enumerate(taken)}
        start = (total or 0) - sizes[0] + 1 if (total or 0) >= sizes[0] else 1
        window[i] = {(k, start + sizes[0] - 1 - k) for k in range(sizes[0])}
    links = spark.createDataFrame([(i, p, k, "x") for i, sizes in books.items() for p, size in enumerate(sizes, 1) for k in range(size)], "novel_id bigint, page bigint, pos bigint, title string").repartition(5)
    known = spark.createDataFrame([(i, t) for i, t in totals.items() if t != 0], "novel_id bigint, total bigint")
    got, newest = {}, {}
    for r in paging.newest_first(links, known).collect():
        got.setdefault(r.novel_id, set()).add((r.page, r.pos, r.number))
    for r in paging.newest_window(links, known).collect():
        newest.setdefault(r.novel_id, set()).add((r.pos, r.number))
    assert got == want and newest == window
    # where the total is right, the window's numbers are those of the whole list
    for i, sizes in books.items():
        if totals[i] == len(want[i]):
            assert newest[i] == {(k, n) for p, k, n in got[i] if p == 1}
    capped = paging.newest_first(links, known, max_pages=1)
    assert {r.page for r in capped.collect()} == {1}


@pytest.fixture
def site():
    """An API of two lists. Its counter holds every page that was asked for."""
    books = {"long": [{"number": n, "title": f"Chapter {n}: T{n}"} for n in range(1, 24)], "odd one": [{"number": n, "title": "x"} for n in (1, 2.5, 2, 2, 3, None, 4, 4.0, 5)], "none": []}
    asked, failures = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            at = urlsplit(self.path)
            q = {k: v[0] for k, v in parse_qs(at.query).items()}
            key = at.path.rsplit("/", 1)[1].replace("%20", " ")
            asked.append((key, q["order"], int(q["offset"]), int(q["limit"])))
            if failures:
                self.send_response(failures.pop())
                self.end_headers()
                return
            if key not in books:
                self.send_response(404)
                self.end_headers()
                return
            items = books[key][:: -1 if q["order"] == "desc" else 1]
            page = items[int(q["offset"]) : int(q["offset"]) + min(int(q["limit"]), 6)]  # it gives out six at most
            body = json.dumps({"items": page, "total": len(items)}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/list/{{key}}?order={{order}}&limit={{limit}}&offset={{offset}}", asked, failures
    server.shutdown()


def numbers(pages):
    from pyspark.sql import functions as F

    found = paging.arrived(api.entries(pages).select(F.lit(1).alias("novel_id"), "number", "offset", "pos", "title", "key"))
    return sorted(r.number for r in found.collect())


def test_a_whole_list_is_read_by_offsets(spark, site):
    url, asked, _ = site
    pages = api.read_lists(spark, url, ["long"], limit=10)
    assert pages.rdd.getNumPartitions() == 4  # the pages are of six, whatever was asked for
    asked.clear()
    got = pages.collect()
    assert sorted((r.ord, r.offset, r.n_items) for r in got) == [("asc", 0, 6), ("asc", 6, 6), ("asc", 12, 6), ("asc", 18, 5)]
    assert sorted({a[2] for a in asked}) == [0, 6, 12, 18]
    assert numbers(pages) == list(range(1, 24))


def test_only_the_pages_that_are_needed_are_asked_for(spark, site):
    url, asked, _ = site
    got = api.read_lists(spark, url, ["long"], limit=6, needed=8).collect()
    assert [(r.ord, r.offset) for r in got] == [("desc", 0), ("desc", 6)]
    assert asked == [("long", "desc", 0, 6), ("long", "desc", 6, 6)]
    asked.clear()
    # items without a usable number do not count, and do not shift offsets: 5, 4, 4 (again) and 3 are in the first three pages of two
    got = api.read_lists(spark, url, ["odd one"], limit=2, needed=4).collect()
    assert [r.offset for r in got] == [0, 2, 4] and len(asked) == 3
    asked.clear()
    newest = api.read_lists(spark, url, ["long"], window=4)
    assert numbers(newest) == [20, 21, 22, 23] and asked == [("long", "desc", 0, 4)]


def test_numbers_that_are_none_are_dropped_and_the_first_of_equal_ones_stays(spark, site):
    url, _, _ = site
    assert numbers(api.read_lists(spark, url, ["odd one", "none", "gone"], limit=4)) == [1, 2, 3, 4, 5]


def test_a_filter_on_the_key_reaches_the_source(spark, site):
    url, asked, _ = site
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = api.read_lists(spark, url, ["long", "odd one"], window=3).filter("key = 'odd one'").collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert [r.key for r in got] == ["odd one"] and {a[0] for a in asked} == {"odd one"}


def test_states_that_pass_are_tried_again(spark, site):
    url, asked, failures = site
    failures += [503, 429]
    assert api.read_page(url, "long", "asc", 3, 0).total == 23 and len(asked) == 3
    failures.append(403)
    with pytest.raises(Exception, match="403"):
        api.read_page(url, "long", "asc", 3, 0)
