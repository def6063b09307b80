import base64
import collections
import gzip
import hashlib
import zlib

import pytest

from reqloom.llm import url_filter, warc

URLS = [
    "http://a.example.com/en/7x", "https://example.com/en/1", "http://COM/en/", "http://notcom/en/", "http://x.com:80/en/", "http://x.net/de/8", "http://example.net/de/8/9?q#f",
    "http://y.example.net/de/88", "http://x.org/es/", "http://x.org/ES/", "no scheme", None, "", "://", "http://", "http://x.com?/en/", "http://x.com#/en/", "http://É.com/en/", "ftp://u@com/en/", "http://com/en", "x://a..com/en/",
]


def judged(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def pages(spark, urls):
    return spark.createDataFrame([(i if u else None, u, None, "x", "y") for i, u in enumerate(urls)], "page_id bigint, url string, html string, key string, verdict string")


def test_urls(spark):
    rules = spark.createDataFrame([*url_filter.RULES, (None, "a", "/"), ("block", None, "/")], "verdict string, host string, path string")
    found = url_filter.filter_urls(pages(spark, URLS * 2).repartition(3), rules)
    want = collections.Counter((i if u else None, *judged(u, url_filter.RULES)) for i, u in enumerate(URLS * 2))
    assert collections.Counter(map(tuple, found.collect())) == want
    assert url_filter.filter_urls(pages(spark, []), rules).count() == 0
    assert url_filter.filter_urls(pages(spark, URLS), rules.limit(0)).where("rule is not null or verdict <> 'allow'").count() == 0


def test_registered_rules_say_what_the_contract_says(spark):
    """The contract's list word by word, and a url under each rule."""
    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert [f"{verdict} {host}{path}" for verdict, host, path in url_filter.RULES] == contract.split(", ")
    urls = ["http://x.com/en/1", "http://example.com/en/7", "http://x.net/de/1", "http://example.net/de/8", "http://x.org/es/1", "http://x.net/fr/"]
    rules = spark.createDataFrame(list(url_filter.RULES), "verdict string, host string, path string")
    found = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages(spark, urls), rules).collect()}
    assert [found[i] for i in range(6)] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), (None, "allow")]


def test_cascade_has_levels_and_is_exact(spark, monkeypatch):
    """With tiny filters many levels are needed; membership over the universe stays exact."""
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 2)
    monkeypatch.setattr(url_filter, "HASHES", 1)
    import pyarrow as pa

    universe = [f"k{i}" for i in range(2000)]
    listed = spark.createDataFrame([(k,) for k in universe[::5]], "key string")
    every = spark.createDataFrame([(k,) for k in universe], "key string")

    def taken(level):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([k for k in b.column(0).to_pylist() if k in level], pa.string())], ["key"])

        return every.mapInArrow(run, "key string")

    cascade = url_filter.build_cascade(listed, taken, 400)
    assert len(cascade.levels) > 3
    assert [k for k in universe if k in cascade] == universe[::5]


def test_a_long_list_is_split(spark, monkeypatch):
    """With filters of a few keys the list falls into parts; verdicts stay those of brute force."""
    monkeypatch.setattr(url_filter, "MAX_FILTER_BYTES", 16)
    listed = [*url_filter.RULES, *(("block" if i % 3 else "allow", f"h{i}.com", "/en/" if i % 2 else "/") for i in range(24))]
    urls = [*URLS, *(f"http://w.h{i}.com/en/x{'y' * (4000 * (i == 7))}" for i in range(30))]
    rules = spark.createDataFrame(listed, "verdict string, host string, path string")
    parts = []
    split = url_filter.cascades_by_part
    monkeypatch.setattr(url_filter, "cascades_by_part", lambda *a: (parts.append(x[1]) or x for x in split(*a)))
    found = url_filter.filter_urls(pages(spark, urls), rules)
    want = collections.Counter((i if u else None, *judged(u, listed)) for i, u in enumerate(urls))
    assert collections.Counter(map(tuple, found.collect())) == want
    assert max(parts) > 1


def round_trips(rows):
    last = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if i is not None:
            last[data] = max(i, last.get(data, i))
    for i, _, html in rows:
        data = (html or "").encode()
        response = data not in last or i == last[data]
        yield i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else last[data]


ROWS = [(1, "http://a/é b\r\nX: y", "<p>\r\n\r\nWARC/1.1\r\n</p>"), (2, None, None), (3, "http://c", ""), (4, "http://d", "same"), (9, "http://e", "same"), (5, "http://f", "é" * 50_000), (None, "http://g", "same"), (None, "http://h", "alone"), (9, "http://e", "same")]


@pytest.mark.parametrize("broadcast", [warc.BROADCAST_ROWS, -1])
def test_round_trip(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    df = spark.createDataFrame([(*r, "x", "y") for r in ROWS], "page_id bigint, url string, html string, digest string, path string").repartition(3)
    assert collections.Counter(map(tuple, warc.round_trip(df).collect())) == collections.Counter(round_trips(ROWS))
    assert warc.round_trip(df.limit(0)).count() == 0


def test_normaliser(tmp_path):
    data = [warc.record(i, u, (h or "").encode(), None, False) for i, u, h in ROWS]
    (tmp_path / "in.warc.gz").write_bytes(gzip.compress(b"".join(data[:4])) + gzip.compress(b"".join(data[4:])))
    assert warc.normalise_file(f"file://{tmp_path}/in.warc.gz", f"file://{tmp_path}/out.warc.gz") == len(data)
    import json

    whole = (tmp_path / "out.warc.gz").read_bytes()
    index = [json.loads(x) for x in (tmp_path / "out.warc.gz.idx").read_text().splitlines()]
    assert [zlib.decompress(whole[x["offset"] : x["offset"] + x["length"]], 31) for x in index] == data
    assert gzip.decompress(whole) == b"".join(data)
    broken = bytearray(data[0])
    broken[-10] ^= 1
    with pytest.raises(ValueError):
        warc.parse_record(bytes(broken))
    with pytest.raises(ValueError):
        list(warc.records(iter([data[0][:-3]])))


def test_cut_and_dirty_archives_are_errors(tmp_path):
    """A stream cut anywhere, even at a record's end, one without its trailer, and bytes after the last member."""
    data = [warc.record(i, f"http://{i}", b"x" * (1000 * i), None, False) for i in range(1, 4)]
    deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
    cut = deflate.compress(data[0] + data[1]) + deflate.flush(zlib.Z_FULL_FLUSH)  # inflates to two whole records
    whole = gzip.compress(b"".join(data))
    bad = {"cut": cut, "no trailer": whole[:-8], "half a trailer": whole[:-3], "half": whole[: len(whole) // 2], "garbage": whole + b"garbage", "zeros": whole + b"\0" * 9, "second cut": whole + whole[:-1]}
    for name, content in bad.items():
        (tmp_path / "bad.warc.gz").write_bytes(content)
        with pytest.raises(ValueError):
            warc.normalise_file(f"file://{tmp_path}/bad.warc.gz", f"file://{tmp_path}/out.warc.gz")
            raise AssertionError(name)
    (tmp_path / "good.warc.gz").write_bytes(whole + whole)
    assert warc.normalise_file(f"file://{tmp_path}/good.warc.gz", f"file://{tmp_path}/out.warc.gz") == 6
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    assert warc.normalise_file(f"file://{tmp_path}/empty.warc.gz", f"file://{tmp_path}/out.warc.gz") == 0


def test_a_task_for_each_archive(spark, tmp_path):
    rows = spark.range(0, 40, 1, 5).selectExpr("id as page_id", "cast(id as string) as url", "repeat('y', 100) as html")
    archives = warc.write_archives(rows, f"file://{tmp_path}/a")
    assert archives.agg({"n": "sum"}).first()[0] == 40
    assert warc._one_each(archives, ["path", "n"]).rdd.getNumPartitions() == archives.count() == 5
    with pytest.raises(Exception, match="were written"):
        warc.normalise_archives(archives.selectExpr("path", "n + 1 as n")).count()
