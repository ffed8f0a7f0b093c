import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provend.llm import revisits as s

SCHEMA = ("record_id string, type string, url string, date timestamp, status int, "
          "fields array<struct<name:string,value:string>>, slice string, at long, latest string")
T0 = dt.datetime(2024, 1, 1)


def row(rid, kind, url, hour, status, **fields):
    f = [(k.replace("_", "-"), v) for k, v in fields.items()]
    return (rid, kind, url, None if hour is None else T0 + dt.timedelta(hours=hour), status, f, "s", 1, "l")


def brute(rows):
    out = {}
    for r in rows:
        rid, kind, url, date, status, fields = r[:6]
        own = dict(fields)
        if kind == "response" and status == 200:
            out[rid] = ("full", rid, own)
            continue
        if not (kind == "revisit" and status == 304):
            out[rid] = ("other", None, own)
            continue
        before = [x for x in rows if x[1] == "response" and x[4] == 200 and x[2] is not None and x[2] == url
                  and x[3] is not None and date is not None and x[3] < date]
        if not before:
            out[rid] = ("missing", None, own)
            continue
        base = max(before, key=lambda x: (x[3], x[0]))
        old = dict(base[5])
        bare = lambda t: t[2:] if t.startswith("W/") else t
        if "etag" in own and "etag" in old:
            ok = bare(own["etag"]) == bare(old["etag"])
        elif "last-modified" in own and "last-modified" in old:
            ok = own["last-modified"] == old["last-modified"]
        else:
            ok = "etag" not in own and "last-modified" not in own
        if not ok:
            out[rid] = ("changed", None, own)
            continue
        hop = [x.strip() for x in own.get("connection", "").lower().split(",")]
        new = {k: v for k, v in own.items() if k not in s.NOT_MERGED and k not in hop}
        out[rid] = ("resolved", base[0], old | new)
    return out


def check(spark, rows, **options):
    got = {r["record_id"]: (r["outcome"], r["resolved_id"], {x["name"]: x["value"] for x in r["headers"]})
           for r in s.resolve(spark.createDataFrame(rows, SCHEMA), **options).collect()}
    assert got == brute(rows)


FIELDS = st.fixed_dictionaries({}, optional={
    "etag": st.sampled_from(['"a"', 'W/"a"', '"b"']), "last_modified": st.sampled_from(["d1", "d2"]),
    "content_length": st.just("5"), "cache_control": st.sampled_from(["x", "y"]), "connection": st.just("close, X-Hop"),
    "x_hop": st.just("1")})
RECORDS = st.lists(st.tuples(st.sampled_from(["response", "revisit", "request"]), st.sampled_from(["h/a", "h/b", None]),
                             st.sampled_from([None, 0, 1, 7, 7, 13, 100]), st.sampled_from([200, 304, None]), FIELDS), max_size=14)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(records=RECORDS)
def test_random_histories(spark, records):
    check(spark, [row(f"r{i:02d}", k, u, h, c, **f) for i, (k, u, h, c, f) in enumerate(records)])


def test_hot_url_over_many_slices(spark):
    rows = [row(f"r{i:04d}", "response" if i % 40 == 5 else "revisit", "h/hot", i, 200 if i % 40 == 5 else 304, etag='"a"')
            for i in range(300)]
    check(spark, rows, slice_seconds=3 * 3600)


def test_canonical_url(spark):
    cases = {"HTTP://WWW.Example.com:80/a/?b=2&utm_source=x&a=1#f": "example.com/a?a=1&b=2", "https://e.org": "e.org",
             "e.org/x//": "e.org/x", "http://m.e.org/?ref=q": "m.e.org", "": None, None: None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "u string, want string")
    assert df.where(~s.canonical_url(F.col("u")).eqNullSafe(F.col("want"))).count() == 0


def test_parsing_and_bodies(spark):
    pages = spark.createDataFrame([(1, "http://e.org/a", "<p>x</p>\r\n\r\ny", 5), (4, "http://e.org/b", "", 5), (5, None, None, 5)],
                                  "page_id long, url string, html string, visit int")
    records = s.parse_records(s.captures(pages))
    body = {(r["record_id"]): r["body"] for r in records.collect()}
    assert body["<urn:page:1:0>"].startswith("<p>x</p>\r\n\r\ny")
    out = s.with_bodies(s.resolve(records), records)
    got = {r["record_id"]: (r["outcome"], r["body"]) for r in out.collect()}
    assert got["<urn:page:1:3>"] == ("resolved", body["<urn:page:1:0>"])
    assert got["<urn:page:4:3>"][0] == "changed" and len(got) == 12
    broken = spark.createDataFrame([("nonsense",), (None,), ("",)], "record string")
    assert all(r["outcome"] == "other" for r in s.resolve(s.parse_records(broken)).collect())


def test_empty(spark):
    assert s.resolve(spark.createDataFrame([], SCHEMA)).count() == 0
