import gzip
import io
import json
import struct
import zipfile

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumine.llm import urlfilter as uf
from vellumine.llm import zipwarc as zw

DATA = "/root/testdata/sf0.001"


def test_filter_equals_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    want = sorted((i, u, b, tuple(r)) for i, u, b, r in c.execute(uf.filter_sql()).fetchall())
    got = sorted((r.page_id, r.url, r.blocked, tuple(r.rules)) for r in uf.filtered(spark.read.parquet(f"{DATA}/pages.parquet")).collect())
    assert got == want and any(b for _, _, b, _ in got) and not all(b for _, _, b, _ in got)


RULES = ["||ads.example.com^", "@@||ads.example.com/ok", "|https://x.org/a*b|", "/track[0-9]{2}/", "&id=", "banner", "^end^", "||example.com^", ".gif|", "", None, "@@", "banner"]
URLS = {
    "https://ads.example.com/1": {0, 7}, "https://ads.example.com/ok/1": {0, 1, 7}, "http://my.ads.example.com:80/": {0, 7}, "http://adsxexample.com/": set(), "http://notads.example.com/": {7}, "https://x.org/a-zz-b": {2}, "https://x.org/a-zz-bc": set(),
    "http://q.net/track12": {3}, "http://q.net/?a=1&id=2": {4}, "http://q.net/mybannerad": {5}, "http://q.net/BANNER": {5}, "http://q.net/end": {6}, "http://q.net/endx": set(), "http://q.net/x.gif": {8}, "http://q.net/x.gif?": set(), "": set(),
    "http://q.net/?u=http://ads.example.com/": set(),
}


def test_rule_language(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(98, None), (None, "http://q.net/banner"), (99, "http://q.net/banner")], "page_id long, url string")
    got = {(r.page_id, r.url): (set(r.rules), r.blocked) for r in uf.filtered(df, RULES).collect()}
    for i, (u, rules) in enumerate(URLS.items()):
        assert got[(i, u)] == (rules, bool(rules) and 1 not in rules), u
    assert got[(98, None)] == (set(), False) and got[(None, "http://q.net/banner")][1] and got[(99, "http://q.net/banner")][1]
    assert uf.filtered(df.limit(0), RULES).count() == 0 and not any(r.blocked for r in uf.filtered(df, []).collect())


def test_case_is_ignored_in_expressions_too(spark):
    rules = ["/[A-Z]{3}Banner/", "/^https?:\\/\\/X\\.org\\/\\D+$/", "@@/OK[0-9]/"]
    urls = ["http://q.net/ABCBanner", "http://q.net/abcbanner", "http://q.net/abBanner", "HTTPS://x.ORG/Path", "https://x.org/1", "http://q.net/xyzbanner/ok5", "http://q.net/" + "a" * 200_000 + "ABCBANNER"]
    df = spark.createDataFrame([(i, u, "x", True, [1]) for i, u in enumerate(urls)], "page_id long, url string, low string, blocked boolean, rules array<int>")
    assert [r.rules for r in uf.filtered(df, rules).orderBy("page_id").collect()] == [[0], [0], [], [1], [], [0, 2], [0]]
    c = duckdb.connect()
    c.execute("CREATE TABLE pages AS SELECT * FROM (VALUES " + ", ".join(f"({i}, '{u}')" for i, u in enumerate(urls)) + ") t(page_id, url)")
    assert [r[3] for r in sorted(c.execute(uf.filter_sql(rules)).fetchall())] == [[0], [0], [], [1], [], [0, 2], [0]]


def test_tokens_are_whole():
    assert uf.literal_tokens("||ads.example.com^") == ["ads", "com", "example"]
    assert uf.literal_tokens("banner") == [] and uf.literal_tokens("/banner*ad/") == [] or uf.literal_tokens("/banner*ad/") == []
    assert uf.literal_tokens("/[0-9]+x/") == []


def pages(spark):
    return spark.createDataFrame([(1, None, "x"), (None, "http://a/\nb%0A", None), (3, "", "é" * 300_000), (3, "", ""), (3, "", ""), (4, "http://u", "\r\n\r\nWARC/1.1\r\n")], "page_id long, url string, html string")


def test_round_trip(spark):
    for df in (pages(spark), spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html"), pages(spark).limit(0)):
        key = lambda r: str(tuple(r))[:300]
        assert sorted(zw.round_trip(df).collect(), key=key) == sorted(df.collect(), key=key)


def archive(method=zipfile.ZIP_STORED, index=True, comment=b"", zip64=False, n=5):
    out, lines, data = io.BytesIO(), [], b""
    for k in range(n):
        packed = gzip.compress(zw.make_record(k, f"http://h/{k}", b"body %d" % k))
        lines.append("key 2024 " + json.dumps({"filename": "a.warc.gz", "offset": str(len(data)), "length": str(len(packed))}))
        data += packed
    with zipfile.ZipFile(out, "w", method) as z:
        with z.open("archive/a.warc.gz", "w", force_zip64=zip64) as f:
            f.write(data)
        if index:
            z.writestr("indexes/index.cdx.gz", gzip.compress("\n".join(lines).encode()))
        z.writestr("datapackage.json", "{}")
        z.comment = comment
    return out.getvalue()


def read(raw):
    return lambda at, n: raw[at : at + n]


@pytest.mark.parametrize("options", [{}, {"index": False}, {"comment": b"PK\x05\x06 tricky"}, {"zip64": True}, {"n": 0}, {"n": 0, "index": False}])
def test_directory_and_records(options):
    raw = archive(**options)
    names = [m[0] for m in zw.directory(read(raw), len(raw))]
    assert names == ["archive/a.warc.gz", *(["indexes/index.cdx.gz"] if options.get("index", True) else []), "datapackage.json"]
    bodies = [zw.parse_record(gzip.decompress(raw[at : at + n]))[1] for _, kind, at, n in zw.located(read(raw), len(raw)) if kind == "gzip"]
    assert bodies == [b"body %d" % k for k in range(options.get("n", 5))]


def test_zip64_end_record_and_extra_fields():
    raw = archive()
    plain = zw.directory(read(raw), len(raw))
    end = raw.rfind(b"PK\x05\x06")
    count, length, start = struct.unpack_from("<HII", raw, end + 10)
    central, body, p = raw[start : start + length], b"", 0
    for _ in range(count):  # all sizes and offsets move to ZIP64 fields
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", central, p + 20)
        header = struct.unpack_from("<I", central, p + 42)[0]
        name = central[p + 46 : p + 46 + n_name]
        extra = struct.pack("<HHI", 0x9999, 4, 7) + struct.pack("<HHQQQ", 1, 24, full, packed, header)
        body += central[p : p + 20] + struct.pack("<IIHHH", 0xFFFFFFFF, 0xFFFFFFFF, n_name, len(extra), 0) + central[p + 34 : p + 42] + struct.pack("<I", 0xFFFFFFFF) + name + extra
        p += 46 + n_name + n_extra + n_comment
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, len(body), start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, start + len(body), 1)
    last = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    big = raw[:start] + body + end64 + locator + last
    assert zw.directory(read(big), len(big)) == plain
    assert len(list(zw.located(read(big), len(big)))) == 5


def test_damage_raises_value_error():
    good = archive(index=False)
    for bad in (b"", b"not a zip", good[:-30], good.replace(b"PK\x01\x02", b"PK\x01\x03"), good.replace(b"PK\x03\x04", b"PK\x03\x05"), good.replace(b"\x1f\x8b\x08", b"\x1f\x8b\x09")):
        with pytest.raises(ValueError):
            list(zw.located(read(bad), len(bad)))
    outside = io.BytesIO()
    with zipfile.ZipFile(outside, "w") as z:
        z.writestr("archive/a.warc", zw.make_record(1, "u", b"x"))
        z.writestr("indexes/index.cdxj", 'key 2024 {"filename": "a.warc", "offset": "5", "length": "100000"}')
    with pytest.raises(ValueError):
        list(zw.located(read(outside.getvalue()), len(outside.getvalue())))
    for bad in (b"WARC/1.1\r\nWARC-Type: resource\r\n\r\nbody", b"WARC/1.1\r\nContent-Length: x\r\n\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nbody", b"no record"):
        with pytest.raises(ValueError):
            zw.parse_record(bad)
    for pieces in ([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nbody"], [gzip.compress(b"WARC/1.1\r\n")[:-3]], [b"x"]):
        with pytest.raises(ValueError):
            list(zw.streamed(iter(pieces)))


def test_other_layouts_come_back_whole(spark, tmp_path):
    """Archives made by zipfile: plain, gzipped and compressed members, partial and no indexes, all record types."""
    message = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n"
    packed = gzip.compress(b"<p>hello</p>")
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in (packed[:7], packed[7:])) + b"0\r\n\r\n"

    def record(kind, k, body):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Date: 2020-0{k % 9 + 1}-01T00:00:00Z\r\nX-Own: v{k}\r\nContent-Length: {len(body)}\r\n\r\n"
        return head.encode() + body + b"\r\n\r\n"

    kinds = [("warcinfo", b"software: x\r\n\r\n"), ("request", b"GET / HTTP/1.1\r\n\r\n"), ("response", message + chunked), ("resource", b"\r\n\r\nWARC/1.0\r\n" * 3), ("metadata", b""), ("response", b"HTTP/1.1 200 OK\r\n\r\nplain"), ("resource", b"y" * 3_000_000)]
    want = {"warcinfo": b"software: x\r\n\r\n"}
    paths = []
    for name, gzipped, method, indexed in (("a", False, zipfile.ZIP_STORED, 0), ("b", True, zipfile.ZIP_STORED, 3), ("c", False, zipfile.ZIP_DEFLATED, 0), ("d", True, zipfile.ZIP_DEFLATED, 0), ("e", False, zipfile.ZIP_STORED, 2)):
        parts = [record(t, k, b) for k, (t, b) in enumerate(kinds)]
        parts = [gzip.compress(x) for x in parts] if gzipped else parts
        offsets = [sum(map(len, parts[:k])) for k in range(len(parts))]
        member = "data.warc.gz" if gzipped else "data.warc"
        with zipfile.ZipFile(tmp_path / f"{name}.wacz", "w", method) as z:
            z.writestr("archive/" + member, b"".join(parts))
            z.writestr("archive/empty.warc", b"")
            if indexed:
                z.writestr("indexes/index.cdxj", "\n".join("k 2020 " + json.dumps({"filename": member, "offset": str(offsets[k]), "length": str(len(parts[k]))}) for k in range(1, len(parts), indexed)))
        paths.append(f"{tmp_path}/{name}.wacz")
    rows = zw.read_archives(spark, paths).collect()
    want = sorted((k, t, f"2020-0{k % 9 + 1}-01T00:00:00Z", f"v{k}", b"<p>hello</p>" if k == 2 else b"plain" if k == 5 else b) for k, (t, b) in enumerate(kinds))
    for path in paths:
        assert sorted((int(r.id), r.type, r.date, r.headers["x-own"], bytes(r.body)) for r in rows if r.path == path) == want, path


def test_records_are_read_by_many_tasks(spark):
    pages_ = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    paths = zw.write_archives(pages_, zw.new_path(spark, "wacz"))
    assert zw.read_archives(spark, paths).rdd.getNumPartitions() > 1


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300), st.one_of(st.none(), st.integers()), st.text(alphabet=st.characters(exclude_categories=["Cs", "Cc", "Z"]), max_size=20))
def test_record_round_trip(body, page_id, url):
    headers, got = zw.parse_record(zw.make_record(page_id, url, body))
    assert got == body and headers["warc-record-id"] == f"<urn:page:{'' if page_id is None else page_id}>"
