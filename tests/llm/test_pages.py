"""WARC archives and URL filters."""

import gzip
import re
from collections import Counter

import pytest

from sieveline.llm import urlfilter, warc
from sieveline.session import shared_folder
from tests.llm.conftest import prose

PAGES = [
    (5, "http://a.com/", prose(1, 50)), (3, "http://b.com/x y\r\nz", prose(1, 50)), (9, None, prose(1, 50)), (3, "http://b.com/", prose(1, 50)),
    (None, "u", prose(1, 50)), (None, "u", "only\r\n\r\nhere"), (7, "http://é/", None), (6, "", ""), (8, "v", prose(2, 20000)), (1, "w", "ß𝔸"),
]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return df.selectExpr("*", "'clash' as digest", "1 as shard", "'x' as record").repartition(3)


def expected_records():
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out, answered = Counter(), set()
    for i, _, h in PAGES:
        h = h or ""
        if h in first and (i != first[h] or h in answered):
            kind, refers = "revisit", first[h]
        else:
            kind, refers = "response", None
            answered.add(h) if h in first else None
        out[i, len(h.encode()), warc.payload_digest(h.encode()), kind, refers] += 1
    return out


def test_archives(pages, spark):
    found = Counter(map(tuple, warc.archive_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    assert found == expected_records()
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_small_payloads_are_responses(pages, spark):
    folder = shared_folder(spark, "warc")
    manifest = warc.write_archives(pages, folder, min_bytes=1)
    read = warc.read_archives(spark, manifest, folder)
    assert read.where("payload_bytes = 0 and record_type = 'revisit'").count() == 0
    payloads = Counter(r["html"] for r in read.where("record_type = 'response'").collect())
    assert set(payloads) == {h or "" for *_, h in PAGES}


def test_archives_repeat_byte_for_byte_and_roll(pages, spark):
    contents = []
    for n in (1, 4):
        folder = shared_folder(spark, "warc")
        files = warc.write_archives(pages.repartition(n), folder, file_bytes=1000, shards=3).collect()
        contents.append({r["name"]: open(f"{folder}/{r['name']}", "rb").read() for r in files})
        assert all(len(contents[-1][r["name"]]) == r["bytes"] for r in files)
    assert contents[0] == contents[1] and len(contents[0]) > 2
    ids = []
    for name in sorted(contents[0]):
        ids += [int(x) for x in re.findall(rb"\r\nPage-Id: (\d+)", gzip.decompress(contents[0][name]))]
    assert ids == sorted(ids)


def test_broken_payload_is_found():
    record = gzip.decompress(warc.page_record("response", 1, "u", warc.payload_digest(b"abc"), 3, b"abc", None))
    assert warc.parse_record(record)[2] == b"abc"
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"abc", b"abd"))


URLS = [
    "http://www.Example.com/en/x", "http://m.example.com/en/x?a=/es/", "http://example.com/EN/x", "http://x.com", "https://n.net/es/1", "https://n.net/fr/",
    "https://n.net/fr", "https://net/fr/", "ftp://notnet/fr/", "http://spam-farm.example.org/a", "http://spam-farm.net/es/", "http://a.org/casino/1",
    "http://a.org/casinos/1", "http://a.org/?casino", None, "", "no scheme.com/", "a://b://c.com/", "http://a.com?x/en/", "http://A.COM#/", "http://Ä.com/en/",
    "http://example.com/en/", "http://example.com/en", "http://a.com:80/",
]
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def judged(url):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    _, mark, rest = (url or "").partition("://")
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate(low)
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    words = re.split(r"[^a-z0-9]+", (host + path).lower())
    labels = re.search(r"(^|\.)(spam|link)-farm\.", host)
    other = bool(labels or {"casino", "porn", "viagra", "xxx"} & set(words))
    verdict = best[2] if best else "block" if other else "allow"
    return host, path, best and best[0] + best[1], verdict


def test_url_filter(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0]), (1, URLS[1])]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'clash' as token", "1 as rank", "'h' as host")
    rules = urlfilter.rule_table(spark, urlfilter.HOST_RULES + urlfilter.PATTERN_RULES)
    found = Counter(map(tuple, urlfilter.judge(df, rules).select("page_id", "host", "path", "rule", "verdict").collect()))
    assert found == Counter((i, *judged(u)) for i, u in rows)
    assert urlfilter.judge(df.limit(0), rules).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    rules = urlfilter.rule_table(spark, (urlfilter.host_rule("example.com", "/en/", "block"), urlfilter.word_rule("xxx")))
    tokens = spark.createDataFrame([("example",)] * 3 + [("com",)] * 5 + [("en",)] * 2, "token string")
    assert {r["rule"]: r["token"] for r in urlfilter.indexed(rules, tokens).collect()} == {"example.com/en/": "en", "xxx": "xxx"}


def test_a_path_that_ends_inside_a_word():
    rule = urlfilter.host_rule("a.com", "/eng", "block")
    assert rule[3] == ["a", "com"] and re.search(rule[2], "x.a.com/english/")
