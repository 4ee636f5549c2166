from datetime import date, datetime

from pyspark.sql import functions as F

from tessera.llm import urls as U

from .helpers import clashing

LIST = [
    ("bad.example.com", "2024-02-01", "block"), ("bad.example.com", "2024-03-01", "remove"), ("bad.example.com", "2024-05-01", "block"),
    ("example.org", "2024-01-01", "block"), ("good.example.org", "2024-01-01", "allow"), ("good.example.org/x", "2024-01-15", "block"),
    ("tie.example", "2024-01-01", "allow"), ("tie.example", "2024-01-01", "block"), (None, "2024-01-01", "block"), ("n.example", None, "block"), ("odd.example", "2024-01-01", "maybe"), (" UP.example ", "2024-01-01", "BLOCK"),
]


def entries(spark, rows=LIST):
    return spark.createDataFrame([(k, d and date.fromisoformat(d), a) for k, d, a in rows], "key string, listed_on date, action string")


def host_and_keys(url):
    """The keys by plain string work."""
    if url is None:
        return []
    rest = url.strip().lower()
    rest = rest.split("://", 1)[-1] if "://" in rest.split("/")[0] + "//" else rest
    rest = rest.split("?")[0].split("#")[0]
    authority, _, path = rest.partition("/")
    host = authority.split("@")[-1].split(":")[0].rstrip(".")
    if not host:
        return []
    labels, parts = host.split("."), [p for p in path.split("/") if p]
    return [".".join(labels[k:]) for k in range(len(labels))] + [f"{host}/" + "/".join(parts[: k + 1]) for k in range(len(parts))]


def brute(url, at):
    """The decisive (key, action) as of a time."""
    if at is None:
        return None
    best = None
    for key in host_and_keys(url):
        held = [(d, ("remove", "allow", "block").index(a.lower()), a.lower()) for k, d, a in LIST if k and d and a.lower() in ("remove", "allow", "block") and k.strip().lower() == key and datetime.fromisoformat(d) <= at]
        if held and max(held)[2] != "remove":
            best = max(best or (0, "", ""), (len(key), key, max(held)[2]))
    return best and best[1:]


URLS = [
    "http://bad.example.com/", "https://sub.bad.example.com:8080/a?b#c", "http://notbad.example.com", "HTTPS://U:P@Good.Example.ORG./y", "http://good.example.org//x/z", "http://good.example.org/xx", "other.example.org/x",
    "http://tie.example", "n.example", "odd.example/", "http://up.example/a", "", "   ", "not a url", "http:///path", "?q", None,
]
TIMES = ["2024-01-01 00:00:00", "2024-01-31 23:59:59", "2024-02-01 00:00:00", "2024-02-29 12:00:00", "2024-03-01 00:00:00", "2024-06-01 00:00:00", "2023-12-31 23:59:59", None]


def captures(spark):
    rows = [(k, u, t and datetime.fromisoformat(t)) for k, (u, t) in enumerate((u, t) for u in URLS for t in TIMES)]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, fetched_at timestamp")


def test_keys(spark):
    frame = spark.createDataFrame([(u,) for u in URLS], "url string").withColumn("k", U.keys(F.col("url")))
    for r in frame.collect():
        assert r.k == host_and_keys(r.url), r.url


def test_as_of_against_brute_force(spark):
    rows, frame = captures(spark)
    found = {r.page_id: r for r in U.verdicts(frame, entries(spark), "page_id", "url", "fetched_at").collect()}
    assert len(found) == len(rows)
    for k, u, t in rows:
        best = brute(u, t)
        assert ((found[k].entry, found[k].action) if best else None) == best, (u, t)
        assert found[k].blocked == bool(best and best[1] == "block")
        assert not best or found[k].listed_from <= t


def test_a_list_beyond_the_broadcast_bound(spark, monkeypatch):
    _, frame = captures(spark)
    few = sorted(map(str, U.verdicts(frame, entries(spark), "page_id", "url", "fetched_at").collect()))
    monkeypatch.setattr(U, "BROADCAST_ENTRIES", 0)
    for share in (1e-4, 0.0):
        monkeypatch.setattr(U, "HOT_SHARE", share)
        assert sorted(map(str, U.verdicts(frame, entries(spark), "page_id", "url", "fetched_at").collect())) == few
    many = frame.crossJoin(spark.range(200).select((F.col("id") * 1000).alias("k"))).withColumn("page_id", F.col("page_id") + F.col("k")).drop("k")
    assert U.verdicts(many, entries(spark), "page_id", "url", "fetched_at").where("blocked").count() == 200 * sum("blocked=True" in r for r in few)


def test_intervals_follow_each_other(spark):
    rows = sorted(U.intervals(entries(spark)).where("key = 'bad.example.com'").collect(), key=lambda r: r.valid_from)
    assert [r.action for r in rows] == ["block", "remove", "block"]
    assert [a.valid_to for a in rows[:-1]] == [b.valid_from for b in rows[1:]] and rows[-1].valid_to is None


def test_filter_and_odd_tables(spark):
    _, frame = captures(spark)
    doubled = clashing(frame.unionByName(frame).unionByName(spark.createDataFrame([(None, "http://bad.example.com", datetime(2024, 2, 2))], frame.schema)))
    judged = U.verdicts(doubled, entries(spark), "page_id", "url", "fetched_at")
    assert judged.count() == frame.count() + 1 and judged.where("page_id is null and blocked").count() == 1
    kept = U.allowed_pages(doubled, entries(spark))
    assert kept.columns == doubled.columns
    assert kept.count() == 2 * judged.where("not blocked and page_id is not null").count()
    assert U.verdicts(doubled, entries(spark, []), "page_id", "url", "fetched_at").where("blocked").count() == 0
    assert U.verdicts(doubled.where("false"), entries(spark), "page_id", "url", "fetched_at").count() == 0
    long = spark.createDataFrame([(1, "http://bad.example.com/" + "a/" * 3000, datetime(2024, 2, 2))], frame.schema)
    assert U.verdicts(long, entries(spark), "page_id", "url", "fetched_at").first().blocked
