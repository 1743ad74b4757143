"""WARC round trips and reassembly; the url filter against a plain walk."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kilowatt.llm import queries, urls, warc
from kilowatt.llm.shared import shared_folder

PAGES = "page_id long, url string, html string"


def _folder(spark, name):
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _round_trip(spark, rows, schema=PAGES):
    df = spark.createDataFrame(rows, schema).withColumn("digest", F.lit(1)).withColumn("first", F.lit("x"))
    path = _folder(spark, "warc")
    warc.write_archives(df, path)
    return path, warc.read_archives(spark, path)


def test_round_trip_and_revisits(spark):
    long = "Ünïcode 日本 🙂 " * 4000
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n" * 3
    rows = [(5, "http://a/x", long), (3, "http://b/ y\r\nz", long), (9, None, long), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (6, "u", ""),
            (7, "u", tricky), (8, "u", tricky), (None, "u", tricky), (10, "u", "x" * 99), (11, "u", "x" * 99), (12, "u", "x" * 100), (13, "u", "x" * 100),
            (14, "u", "y" * 200_000), (14, "u", "y" * 200_000)]
    path, records = _round_trip(spark, rows)
    got = warc.captures(records).collect()
    assert len(got) == len(rows)
    first = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, page), page)
    want = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        response = len(data) < 100 or first[html] == page
        want[(None if page is None else str(page), len(data), hashlib.sha256(data).hexdigest(), "response" if response else "revisit",
              None if response else str(first[html]))] += 1
    assert Counter((r["page"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert all(r["valid"] for r in records.collect())
    numbers = defaultdict(set)
    for r in warc.scan(spark, path, segments=True).collect():
        assert len(r["block"]) <= warc.SEGMENT_BYTES
        numbers[r["record_id"]].add(r["number"])
    assert len(numbers) == 2 and all(n == set(range(1, len(n) + 1)) and len(n) > 5 for n in numbers.values())


def test_missing_and_short_segments_are_told(spark):
    path, _ = _round_trip(spark, [(1, "u", "z" * 50_000), (2, "u", "w" * 40_000), (3, "u", "fine")])
    text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    parts = [p.rstrip("\r\n") + "\r\n" for p in re.split(r"(?=WARC/1\.1\r\n)", text) if p]
    lost = [p for p in parts if "WARC-Segment-Number: 2\r\n" in p and "WARC-Segment-Origin-ID: <urn:page:1:" in p]
    assert len(lost) == 1
    broken = _folder(spark, "broken")
    spark.createDataFrame([(p,) for p in parts if p not in lost], "value string").write.option("lineSep", "\r\n").text(broken)
    got = {r["record_id"].split(":")[2]: (r["valid"], r["payload"] and len(r["payload"])) for r in warc.read_archives(spark, broken).collect()}
    assert got == {"1": (False, None), "2": (True, 40_000), "3": (True, 4)}


def test_segments_in_any_order_and_file(spark):
    """Continuations before their first segment, and in other files."""
    path, _ = _round_trip(spark, [(1, "u", "é" * 30_000), (2, "u", "x" * 90_000)])
    text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    parts = [p.rstrip("\r\n") + "\r\n" for p in re.split(r"(?=WARC/1\.1\r\n)", text) if p]
    mixed = _folder(spark, "mixed")
    spark.createDataFrame([(p,) for p in reversed(parts)], "value string").repartition(4).write.option("lineSep", "\r\n").text(mixed)
    got = {r["record_id"].split(":")[2]: bytes(r["payload"]).decode() for r in warc.read_archives(spark, mixed).collect()}
    assert got == {"1": "é" * 30_000, "2": "x" * 90_000}


def test_a_member_for_each_record():
    import gzip

    records = [r + "\r\n" for r in warc._records("1", "u", "x" * 40_000, "0" * 64, None)]
    plain = list(warc.parse("".join(records).encode()))
    assert len(plain) == 3 and plain == list(warc.parse(b"".join(gzip.compress(r.encode()) for r in records)))


def test_chunked_framing():
    for size in (0, 1, warc.CHUNK_BYTES, warc.CHUNK_BYTES + 1, 3 * warc.CHUNK_BYTES - 1):
        data = ("é" * size).encode()
        assert warc.unchunked(warc.chunked(data)) == data
    assert warc.unchunked(b"5;name=value\r\nhello\r\n0\r\nTrailer: x\r\n\r\n") == b"hello"
    assert warc.unchunked(b"5\r\nhel") is None and warc.unchunked(b"zz\r\nhello\r\n0\r\n\r\n") is None
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\nContent-Type: a\r\n\r\nplain") == b"plain"


def test_no_pages(spark):
    path, records = _round_trip(spark, [])
    assert records.count() == 0


def test_warc_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: r for r in queries.op5_warc(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        data = (r["html"] or "").encode()
        assert (got[r["page_id"]]["payload_bytes"], got[r["page_id"]]["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())


# ------------------------------------------------------------ url filter

def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def _rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def _brute(pages):
    """The same walk with plain dictionaries."""
    rows = []
    for page, url in pages:
        host, path = _parts(url)
        rule, verdict = _rule(host, path)
        segs = tuple("{id}" if re.fullmatch(r"[0-9a-fA-F-]{16,}", s) else re.sub(r"[0-9]+", "#", s) for s in re.sub(r"^/", "", path).split("/"))
        rows.append((page, host, path, rule, verdict, segs))
    template = {(h, s): "" for _, h, _, _, _, s in rows}
    count = Counter((h, s) for _, h, _, _, _, s in rows)
    for level in range(min(max((len(s) for _, s in template), default=0), urls.DEPTH)):
        follow = defaultdict(Counter)
        for (h, s), t in template.items():
            if level < len(s):
                follow[(h, t, s[level])]["/".join(s[level + 1:level + 1 + urls.DEPTH])] += count[(h, s)]
        children = defaultdict(dict)
        for (h, t, seg), tails in follow.items():
            children[(h, t)][seg] = tails
        names = {}
        for node, segs in children.items():
            pages_of = {s: sum(c.values()) for s, c in segs.items()}
            wild = len(segs) >= urls.WILD_SEGMENTS and sum(pages_of.values()) < urls.WILD_PAGES * len(segs)
            profile = {}
            for s, tails in segs.items():
                share = sorted((t, int(4 * n / pages_of[s] + 0.5)) for t, n in tails.items())
                profile[s] = repr([x for x in share if x[1] > 0]) if pages_of[s] >= urls.MERGE_PAGES else "=" + s
            for s in segs:
                names[(*node, s)] = "*" if wild else min(o for o in segs if profile[o] == profile[s])
        template = {(h, s): f"{t}/{names[(h, t, s[level])]}" if level < len(s) else t for (h, s), t in template.items()}
    template = {(h, s): t + "/**" if len(s) > urls.DEPTH else t for (h, s), t in template.items()}
    ruled = [r for r in rows if r[4]]
    blocked, labelled = Counter(), Counter()
    for _, h, _, _, v, s in ruled:
        blocked[(h, template[(h, s)])] += v == "block"
        labelled[(h, template[(h, s)])] += 1
    out = []
    for page, h, p, rule, v, s in rows:
        key = (h, template[(h, s)])
        purity = (blocked[key] + urls.PRIOR_PAGES / 2) / (labelled[key] + urls.PRIOR_PAGES)
        out.append((page, h, p, rule, v or ("block" if purity >= urls.REJECT else "allow")))
    return Counter(out)


def _made():
    pages = [(None, None), (None, "no scheme"), (1, "http://"), (2, "HTTP://EXAMPLE.com"), (3, "x://Www.Example.COM/en/?q#f"), (4, "http://a.net/es/1"), (4, "http://a.net/es/1"),
             (5, "http://net/fr/"), (6, "http://bnet/fr/"), (7, "://h?x"), (8, "a://b.org//c//d?e://f/"), (9, "http://É.ORG/Ä/9"), (10, "http://a.net/fr"), (11, "http://xample.com/en/")]
    n = 100
    for host in ("one.net", "two.net", "three.org"):
        for lang in ("en", "es", "fr", "de"):
            for k in range(14):
                pages.append((n, f"http://{host}/{lang}/{'item' if k % 2 else 'post'}/{n}.html"))
                n += 1
        for k in range(20):
            pages.append((n, f"http://{host}/u/name{chr(97 + k)}x/{n}/a/b/c/d/e/f"))
            n += 1
    return pages


@pytest.mark.parametrize("pages", [_made(), []])
def test_verdicts_are_those_of_a_plain_walk(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("id", F.lit(1)).withColumn("n", F.lit(1))
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df).collect())
    assert got == _brute(pages)


def test_a_host_of_blocked_templates_is_rejected_where_no_rule_reaches(spark):
    got = {(r["host"], r["path"].split("/")[1]): r["verdict"] for r in urls.judge(spark.createDataFrame(_made(), "page_id long, url string")).collect() if r["rule"] is None and "html" in r["path"]}
    assert got[("one.net", "en")] == "block" and got[("three.org", "en")] == "allow"


def _templates(spark, paths):
    """The template of each (host, path), of pages given as {(host, path): number}."""
    rows = [(h, p, p.strip("/").split("/"), n) for (h, p), n in paths.items()]
    return {(r["host"], r["shape"]): r["template"] for r in urls.templates(spark.createDataFrame(rows, "host string, shape string, segs array<string>, n long")).collect()}


WORDS = [f"{a}{b}" for a in "bcdfghjklmnprstvwz" for b in ("an", "el", "il", "on", "ur")]


def test_branches_with_many_rare_followers_are_merged(spark):
    """Word slugs, each language with its own 14: none of them has a share of an eighth."""
    langs = ("en", "es", "fr", "de")
    pages = [(14 * k + i, f"http://slugs.net/{lang}/{lang}{WORDS[i]}/page") for k, lang in enumerate(langs) for i in range(14)]
    got = {r["path"]: (r["rule"], r["verdict"], r["template"]) for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert {v for p, v in got.items() if p[:4] in ("/en/", "/de/")} == {(None, "block", "/de/*/page")}
    # followers that differ only further down, in places where no segment is variable
    paths = {("h", f"{top}/{a}/{b}/{c}"): 1 for top in ("x", "y") for a in "abc" for b in "def" for c in "ghi"}
    assert set(_templates(spark, paths | {("h", "z/q"): 20}).values()) == {"/x/a/d/g", "/z/q"}


def test_a_variable_segment_is_one_also_for_a_branch_with_many_rare_followers(spark):
    paths = {("h", f"{w}/end"): 1 for w in WORDS[:30]} | {("h", f"big/{w}"): 1 for w in WORDS[:12]}
    assert {t[:3] for t in _templates(spark, paths).values()} == {"/*/"}


@pytest.mark.parametrize("times", [1, 50])
def test_neither_a_hot_segment_nor_more_pages_end_a_wildcard(spark, times):
    hot = {("hot", w): 1 for w in WORDS} | {("hot", "front"): 2 * len(WORDS)}
    several = {("several", f"{w}/end"): 2 + i % 6 for i, w in enumerate(WORDS)}
    fixed = {("fixed", f"{a}/{w}/{a}"): 1 for a in "abc" for w in WORDS[:20]}
    got = _templates(spark, {k: times * n for k, n in (hot | several | fixed).items()})
    assert {(h, t) for (h, _), t in got.items()} == {("hot", "/*"), ("several", "/*/end")} | {("fixed", f"/{a}/*/{a}") for a in "abc"}


def test_url_query(spark):
    sf = "/root/testdata/sf0.1"
    pages = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()]
    df = queries.op7_url_filter(spark, sf)
    assert "Python" not in df._jdf.queryExecution().toString()
    assert Counter(tuple(r) for r in df.collect()) == _brute(pages)
