from datetime import date

from compare import difference
from fixtures import clashing, plain

from effortlens.llm import url_lists
from effortlens.llm.queries import CHECKS, QUERIES

CAPTURE, ENTRY = "page_id long, url string, fetched_at date", "pattern string, action string, listed_at date"


def day(n):
    return date(2024, 1, n)


URLS = ["http://a.b.example.com/x?q=1", "https://user:pw@B.Example.com:8080", "http://example.com/", "http://other.org/path/y#z", "ftp://example.com./x",
        "no url", "", None, "http://", "http://com", "HTTP://A.b.EXAMPLE.com/X"]
ENTRIES = [
    ("example.com", "block", 3), ("example.com", "remove", 9), ("example.com", "block", 20), ("b.example.com", "allow", 5), ("b.example.com", "block", 7),
    ("b.example.com", "allow", 7), ("a.b.example.com/x", "allow", 8), ("a.b.example.com/x", "other", 12), ("com", "block", 15), ("com", None, 18),
    ("other.org/path/y", "block", 2), ("other.org/path/y", "block", 2), (None, "block", 2), ("example.com", "allow", None), ("OTHER.org", "block", 10),
]


def brute(captures, entries):
    out = []
    for page, url, at in captures:
        verdict = ("none", None)
        rest = (url or "").partition("://")[2]
        host = rest.split("#")[0].split("?")[0].split("/")[0].rpartition("@")[2].split(":")[0].lower().rstrip(".")
        if host and at:
            path = rest.split("#")[0].split("?")[0].partition("/")
            labels = host.split(".")
            names = [".".join(labels[i:]) for i in reversed(range(len(labels)))] + [(host + (path[1] + path[2] or "/")).lower()]
            for name in names:
                past = [(day(n), {"block": 2, "allow": 1}.get(a, 0)) for p, a, n in entries if p and n and p.lower() == name and day(n) <= at]
                if past and (state := max(past)[1]):
                    verdict = (["allow", "block"][state - 1], name)
        out.append((page, url, at, *verdict))
    return out


def test_equals_judging_one_by_one(spark):
    rows = [(i * 100 + n, u, day(n)) for i, u in enumerate(URLS) for n in range(1, 26)] + [(9000, URLS[0], None), (None, URLS[0], day(9)), (3, URLS[0], day(3)), (3, URLS[0], day(3))]
    captures = spark.createDataFrame(rows, CAPTURE)
    entries = spark.createDataFrame([(p, a, n and day(n)) for p, a, n in ENTRIES], ENTRY)
    wanted = brute(rows, ENTRIES)
    assert {w[3] for w in wanted} == {"none", "allow", "block"}
    assert plain(url_lists.judge(captures, entries).collect()) == plain(wanted)
    extra = clashing(captures), clashing(entries)
    assert plain(url_lists.judge(*extra).collect()) == plain(wanted)
    none = spark.createDataFrame([], ENTRY)
    assert {r["verdict"] for r in url_lists.judge(captures, none).collect()} == {"none"}
    assert url_lists.judge(spark.createDataFrame([], CAPTURE), entries).collect() == []


def test_query_equals_its_sql(spark, sf_dir):
    name = "op10_temporal_url_lists"
    assert difference(QUERIES[name](spark, sf_dir), sf_dir, CHECKS[name]) is None
