import hashlib

import pytest
from pyspark.sql import functions as F

from cloakwork.llm import warc
from cloakwork.llm.common import new_path
from cloakwork.llm.urlfilter import RULES, rule_tokens, url_filter


def judge(url, rules):
    rest = (url or "").split("://", 1)
    if len(rest) < 2:
        return "", "", None, "allow"
    host = rest[1]
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[1][len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    v, rule = min(fits, key=lambda x: (-len(x[1]), x[0] != "block", x[1]))
    return host, path, rule, v


URLS = [
    "http://example.org/es/x", "https://www.EXAMPLE.org/en/123?q=1", "http://notexample.org/es/", "http://a.com/de/1#t", "http://a.com/fr", "http://a.com/fr/", "http://org", "http://org/", "http://x.org?y", "ftp://é.ORG/", "no scheme", "", None,
    "http://example.org/en/", "http://b.example.org/en/1", "x://y://example.org/es/", "http://com/de/", "http://a.b.com/de/fr/", "http://example.org./es/", "http://example.org:80/es/", "http://a.com/fr/", "http://u.com\n/de/",
]


@pytest.mark.parametrize("most", [100_000, 0])
def test_url_rules_equal_plain_ones(spark, most):
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(URLS)] + [(None, URLS[0], "r")], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter(df, broadcast_rules=most).collect()}
    assert got.pop(None) == judge(URLS[0], RULES)
    assert got == {i: judge(u, RULES) for i, u in enumerate(URLS)}
    more = [*RULES, ("block", "y", "/a+b/(c"), ("allow", "example.org", "/es/"), ("block", "EXAMPLE.org", "/es/deep/")]
    deep = spark.createDataFrame([(1, "http://y/a+b/(cd"), (2, "http://q.example.org/es/deep/z"), (3, "http://y/aab/c")], "page_id long, url string")
    low = [(v, h.lower(), p) for v, h, p in more]
    assert {r["page_id"]: r["verdict"] for r in url_filter(deep, more, broadcast_rules=most).collect()} == {r.page_id: judge(r.url, low)[3] for r in deep.collect()}
    assert url_filter(df.limit(0), broadcast_rules=most).count() == 0


def test_rule_tokens_are_whole_words():
    assert rule_tokens("example.org", "/en/1") == ["en", "example", "org"]
    assert rule_tokens("com", "/de/") == ["com", "de"]


PAGES = [(1, "http://a/", "x" * 200), (2, "http://b/ c", "x" * 200), (3, None, "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""), (7, "u", "é\r\n\r\nWARC/1.1\r\n" * 30), (0, "u", "é\r\n\r\nWARC/1.1\r\n" * 30), (None, "u", "x" * 200), (8, "u", "\0" * 150)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r for r in warc.warc_round_trip(df).collect()}
    assert len(got) == len(PAGES)
    for i, _, html in PAGES:
        raw = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items() if r["record_type"] == "revisit"} == {2: ("revisit", 1), 7: ("revisit", 0)}
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def members():
    texts = [b"alpha" * 50, b"beta" * 50, b"gamma" * 50]
    return [warc.member(warc.record("response", i, t, hashlib.sha256(t).hexdigest(), len(t))) for i, t in enumerate(texts)]


def kinds(raw):
    return [(k, a, b, x.get("id")) for k, a, b, x in warc.salvage(raw)]


def test_salvage_of_damaged_members():
    a, b, c = members()
    assert kinds(a + b + c) == [("record", 0, len(a), 0), ("record", len(a), len(a + b), 1), ("record", len(a + b), len(a + b + c), 2)]
    bad = bytearray(b)
    bad[len(b) // 2] ^= 255
    found = kinds(a + bytes(bad) + c)
    assert [(k, i) for k, _, _, i in found] == [("record", 0), ("gap", None), ("record", 2)] and found[1][1:3] == (len(a), len(a + b))
    found = kinds(b"junk" + a + b[: len(b) // 2])
    assert [(k, x, y) for k, x, y, _ in found] == [("gap", 0, 4), ("record", 4, 4 + len(a)), ("gap", 4 + len(a), 4 + len(a) + len(b) // 2)]
    assert kinds(b"") == [] and kinds(b"\x1f\x8b\x08") == [("gap", 0, 3, None)]


def test_salvage_inside_members():
    a, b, c = (warc.record("response", i, t, hashlib.sha256(t).hexdigest(), len(t)) for i, t in enumerate((b"alpha" * 50, b"beta" * 50, b"gamma" * 50)))
    wrong = b.replace(b"betabeta", b"bettbeta", 1)
    other = warc.member(a)
    raw = warc.member(a + wrong + c) + other
    found = list(warc.salvage(raw))
    assert [(k, x.get("id")) for k, _, _, x in found] == [("record", 0), ("record", 2), ("gap", None), ("record", 0)]
    gap = found[2][3]
    assert (gap["why"], gap["inner_first"], gap["inner_end"]) == ("damaged record in a member", len(a), len(a + wrong))
    # a member that ends too early gives the records before
    import random

    rng = random.Random(1)
    noise = bytes(rng.randrange(256) for _ in range(60_000))
    long = warc.record("response", 9, noise, hashlib.sha256(noise).hexdigest(), len(noise))
    whole = warc.member(a + c + long)
    for cut in (whole[: len(whole) // 2], whole[:30_000] + b"\xff" * 40 + whole[30_040:]):
        found = list(warc.salvage(cut + other))
        assert [x["id"] for k, _, _, x in found if k == "record"] == [0, 2, 0]
        assert any(k == "gap" and x["why"] == "damaged member" for k, _, _, x in found)


def test_salvage_searches_an_archive_once(monkeypatch):
    searches = []

    class Counted(warc._Next):
        def after(self, at):
            before, out = self.at, super().after(at)
            if self.at != before:
                searches.append(self.at - max(before, at, 0))
            return out

    monkeypatch.setattr(warc, "_Next", Counted)
    raw = b"\x1f\x8b\x08" * 3000 + b"z" * 100_000 + members()[0]
    found = list(warc.salvage(raw))
    assert [k for k, *_ in found] == ["gap", "record"] and sum(searches) < 4 * len(raw)


def test_pages_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://org-x.com/a", "x" * 120, "k", 5), (2, "http://org/a", "x" * 120, "k", 6)], "page_id long, url string, html string, HOST string, `digest` int")
    rules = [("block", "org", "")]
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter(df, rules).collect()} == {1: (None, "allow"), 2: ("org", "block")}
    assert {r["page_id"]: r["refers_to"] for r in warc.warc_round_trip(df).collect()} == {1: None, 2: 1}


def test_long_urls_and_payloads(spark):
    df = spark.createDataFrame([(1, "http://example.org/es/" + "a/" * 500_000, "é" * 3_000_000)], "page_id long, url string, html string")
    row = url_filter(df).first()
    assert (row["verdict"], len(row["path"])) == ("block", 1_000_004)
    assert warc.warc_round_trip(df).first()["payload_bytes"] == 6_000_000


def test_salvage_of_plain_records():
    t = b"WARC/1.0\r\nnot a record" * 5
    good = warc.record("response", 5, t, hashlib.sha256(t).hexdigest(), len(t))
    wrong = good.replace(b"not a record", b"not a recorD")
    found = kinds(good + wrong + good + members()[0])
    assert [k for k, *_ in found] == ["record", "gap", "record", "record"] and found[1][1] == len(good)
    # every byte is in a record or in a gap, once
    for raw in (good + wrong + good, wrong, good[:-3], b"x" + good):
        spans = sorted((a, b) for k, a, b, _ in kinds(raw))
        assert spans[0][0] == 0 and spans[-1][1] == len(raw) and all(p[1] == q[0] for p, q in zip(spans, spans[1:], strict=False))


def test_large_member_ends_with_zero():
    raw = bytes(range(256)) * (1 << 16) + b"x" * 77
    m = warc.member(raw)
    assert m[-1] == 0
    import gzip

    assert gzip.decompress(m) == raw


def test_reader_logs_gaps(spark):
    path = new_path(spark, "gaps")
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    warc.write_warc(df, path)
    broken = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").first()[0]
    where = path.removeprefix("file://")
    import os

    for f in os.listdir(where):
        if f.startswith(("part-", ".part-")):
            os.remove(f"{where}/{f}")
    with open(f"{where}/part-0.warc.gz", "wb") as f:
        f.write(broken[:10] + b"!!" + broken[12:])
    rows = warc.read_warc(spark, path).collect()
    assert sum(r["kind"] == "gap" for r in rows) == 1 and sum(r["kind"] == "record" for r in rows) == len(PAGES) - 1
    assert [r["why"] for r in rows if r["kind"] == "gap"] == ["damaged member"]
    assert spark.createDataFrame(rows[:1], warc.RECORDS).select(F.col("kind")).count() == 1
