import base64
import gzip
import hashlib
import io
import time
import zlib

import pyarrow as pa
import zstandard

from folioflow.llm.warc import _whole, decompressed, derivatives, derived, get, page_responses, page_text, parsed, read_files, records, response, serialised, write_files

SCHEMA = "page_id long, url string, html string, record string, headers string"
PAGES = [
    (1, "http://a.example/x", "<!DOCTYPE html><html lang='fr'><head><title>A &amp; B</title><style>p{}</style><script>var t='</p>';</script></head><body><p>One<b>two</b><br>three<!-- no --> <a href=\"/l?a=1&amp;b\">link</a></p><p>a < b</p>"),
    (2, None, None),
    (3, "http://b.example/", ""),
    (4, "http://c.example/", "no markup\r\n\r\nat all é \U0001f600"),
    (5, "http://d.example/", "<p title='a>b'>x</p><script>never closed"),
    (None, "http://e.example/\nInjected: yes", "<p>null id"),
    (1, "http://a.example/x", "<p>again"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def sha1(b):
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_text():
    text, about, links = page_text(PAGES[0][2])
    assert text == "Onetwo\nthree link\na < b" and about == {"title": "A & B", "language": "fr"} and links == ["/l?a=1&b"]
    assert page_text("<p title='a>b'>x</p><script>never")[0] == "x"
    assert page_text("<!-- open")[0] == page_text("<p")[0] == ""
    assert page_text("a <b c='unclosed>d</b>")[0] == "a d"
    assert page_text("İ<script>x</script>y")[0] in ("İ", "İy")


def test_text_after_a_script_whatever_lower_case_does_to_the_length():
    page = "<html lang='tr'><head><STYLE>p{}</Style><script>var t='İ';</SCRIPT><title>İstanbul</title><meta name='description' content='İl'></head><body>bir<svg>x</svg> iki <a href='/l'>üç</a>"
    for markup in (page, page.replace("İ", "I")):
        text, about, links = page_text(markup)
        assert text == "bir iki üç" and links == ["/l"]
        assert about == {"title": "İstanbul", "language": "tr", "description": "İl"} or "İ" not in markup
    assert page_text("İ<script>x</script>y")[0] == "İy"


def test_links_between_records(spark):
    got = derivatives(page_responses(pages(spark))).collect()
    assert len(got) == 2 * len(PAGES)
    made = {}
    bodies = {sha1((html or "").encode()): (html or "").encode() for _, _, html in PAGES}
    for r in page_responses(pages(spark)).collect():
        (headers, block), = parsed(bytes(r.record))
        body = bodies[get(headers, "WARC-Payload-Digest")]
        assert block.endswith(body) and get(headers, "WARC-Payload-Digest") == sha1(body) and get(headers, "WARC-Block-Digest") == sha1(block)
        made[get(headers, "WARC-Record-ID"), get(headers, "WARC-Payload-Digest")] = headers
    ids = {r.record_id for r in got}
    for r in got:
        source = made[r.refers_to, r.source_payload_digest]
        own = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in r.headers.split("\r\n") if x)
        assert own["WARC-Refers-To-Target-URI"] == get(source, "WARC-Target-URI") == r.target_uri and "Injected" not in own
        assert own["WARC-Refers-To-Date"] == get(source, "WARC-Date") and own["WARC-Source-Block-Digest"] == get(source, "WARC-Block-Digest")
        assert r.block_digest == sha1(r.block.encode()) and r.content_length == len(r.block.encode())
        assert own["WARC-Concurrent-To"] in ids - {r.record_id}
    texts = {(r.page_id, r.record_type): r.block for r in got if r.page_id not in (1,)}
    assert texts[2, "conversion"] == texts[3, "conversion"] == "" and texts[4, "conversion"] == "no markup\nat all é \U0001f600"
    meta = next(r.block for r in got if r.record_type == "metadata" and "A & B" in r.block)
    for line in ("title: A & B", "language: fr", "http-status: HTTP/1.1 200 OK", "outlink: /l?a=1&b", "source-warc-type: response"):
        assert line in meta.split("\r\n")


def test_wrong_digest_is_kept_and_noted():
    raw = response("1", "http://x", b"<p>x", "2024-01-01T00:00:00Z").replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:AAAA")
    (headers, block), = parsed(raw)
    for own, own_block in derived(headers, block):
        assert get(own, "WARC-Source-Payload-Digest") == get(headers, "WARC-Payload-Digest")
        assert get(own, "WARC-Type") != "metadata" or b"digest-mismatch: WARC-Payload-Digest" in own_block


def test_files_round_trip(spark, tmp_path):
    got = derivatives(page_responses(pages(spark)))
    files = write_files(got, f"file://{tmp_path}/out").collect()
    assert sum(f.records for f in files) == 2 * len(PAGES)
    back = [next(parsed(bytes(r.record))) for r in read_files(spark, f"file://{tmp_path}/out").collect()]
    assert sorted((get(h, "WARC-Record-ID"), b.decode()) for h, b in back) == sorted((r.record_id, r.block) for r in got.collect())
    again = derivatives(read_files(spark, f"file://{tmp_path}/out").selectExpr("1L as page_id", "record"))
    assert again.count() == 0  # none is a response


def test_cut_and_foreign_records():
    raw = serialised([("WARC-Type", "warcinfo"), ("X", "1")], b"abc") + response("1", "u", b"x", "d")
    assert [get(h, "WARC-Type") for h, _ in parsed(raw)] == ["warcinfo", "response"]
    assert [get(h, "WARC-Type") for h, _ in parsed(raw[:-20])] == ["warcinfo"]
    assert list(parsed(b"WARC/1.1\r\nContent-Length: x\r\n\r\n")) == list(parsed(b"")) == []
    (headers, own), = derived([("WARC-Type", "response"), ("Content-Type", "image/png")], b"\xff\x00<p>a")
    assert get(headers, "WARC-Type") == "metadata" and not get(headers, "WARC-Concurrent-To") and b"note-conversion: none of image/png" in own


def http(body, *headers):
    return [("WARC-Type", "response"), ("WARC-Record-ID", "<r>"), ("Content-Type", "application/http; msgtype=response")], ("HTTP/1.1 200 OK\r\n" + "".join(f"{h}\r\n" for h in headers) + "\r\n").encode() + body


def chunked(body, size=7):
    return b"".join(b"%x;a=b\r\n%s\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)) + b"0\r\nX: y\r\n\r\n"


def test_bodies_are_taken_out_of_their_codings():
    page = "<title>Ü</title><p>hello wörld".encode()
    deflated = zlib.compressobj(6, zlib.DEFLATED, -15)
    codings = {"gzip": gzip.compress(page), "x-gzip": gzip.compress(page[:9]) + gzip.compress(page[9:]), "deflate": zlib.compress(page), "DEFLATE": deflated.compress(page) + deflated.flush(), "zstd": zstandard.compress(page), "identity": page}
    for coding, body in codings.items():
        for sent, more in ((body, []), (chunked(body), ["Transfer-Encoding: chunked"])):
            headers, block = http(sent, "Content-Type: text/html", f"Content-Encoding: {coding}", *more)
            (_, meta), (_, text) = derived(headers, block)
            assert text == "hello wörld".encode() and "title: Ü".encode() in meta and b"note-" not in meta, coding
    headers, block = http(page, "Content-Type: text/html", "Transfer-Encoding: chunked", "Content-Encoding: gzip")
    (_, meta), (_, text) = derived(headers, block)  # says what it isn't
    assert text == "hello wörld".encode() and b"note-transfer-encoding" in meta and b"note-content-encoding" in meta
    for coding, body in (("br", b"\x0b\x02\x80"), ("gzip", gzip.compress(page)[:-12]), ("deflate", b"no"), ("zstd", b"no")):
        headers, block = http(body, "Content-Type: text/html", f"Content-Encoding: {coding}")
        (own, meta), = derived(headers, block)
        assert get(own, "WARC-Type") == "metadata" and f"note-content-encoding: {coding} could not be undone".encode() in meta
    assert decompressed(gzip.compress(b"0" * 5_000_000), "gzip", 4_000_000) is None and decompressed(zlib.compress(b"0" * 5_000_000), "deflate", 4_000_000) is None


def test_only_text_is_converted():
    for kind, kept in (("text/html", True), ("text/plain", True), ("application/json", True), ("image/svg+xml", True), ("image/png", False), ("application/pdf; x=1", False), ("", True)):
        headers, block = http(b"a", *([f"Content-Type: {kind}"] if kind else []))
        assert len(derived(headers, block)) == 1 + kept, kind
    headers, block = http('<meta charset="latin-1"><p>\u00e9'.encode("latin-1"), "Content-Type: text/html")
    assert derived(headers, block)[1][1] == "é".encode()


def test_damaged_records_are_passed_over_and_told():
    one, two, three = (response(str(i), f"http://{i}", b"<p>%d" % i, "d") for i in (1, 2, 3))
    broken = two.replace(b"Content-Length: ", b"Content-Length: x", 1) if two.index(b"Content-Length: ") < two.index(b"HTTP/1.1") else two
    for middle in (broken, two.replace(b"WARC/1.1\r\n", b"WARC/1.1\r\nContent-Length: 99999999\r\n"), two.replace(b"WARC/1.1\r\n", b"WARC/1.1\r\nContent-Length: 3\r\n"), b"rubbish\r\n" * 50, two[: two.index(b"WARC-Payload")], two[:-30] + b"\r\n"):
        got = list(records(io.BytesIO(one + middle + three)))
        assert [get(h, "WARC-Target-URI") for _, h, _ in got] == ["http://1", "http://3"] and got[0][0] == 0 < got[1][0]
    got = list(records(io.BytesIO(one + b"rubbish" * 9)))
    assert [s for s, *_ in got] == [0, 63] and got[1][1:] == ([], b"")


def test_files_are_read_as_streams(spark, tmp_path, monkeypatch):
    """A huge record, small ones, a damaged member, and a file that isn't compressed."""
    raws = [response(str(i), f"http://{i}", b"<p>%d " % i * (3_000_000 if i == 1 else 1), "d") for i in range(6)]
    members = [gzip.compress(r) for r in raws]
    members[3] = members[3][:40] + b"\x00\xff" * 20 + members[3][80:]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    (tmp_path / "b.warc").write_bytes(b"".join(raws))
    got = read_files(spark, f"file://{tmp_path}").collect()
    uris = lambda name: [get(next(parsed(bytes(r.record)))[0], "WARC-Target-URI") for r in got if r.path.endswith(name) and r.record is not None]
    assert uris("b.warc") == [f"http://{i}" for i in range(6)] and uris("a.warc.gz") == [f"http://{i}" for i in (0, 1, 2, 4, 5)]
    assert all(bytes(r.record) in raws for r in got if r.record is not None)
    whole = list(_whole([pa.RecordBatch.from_pydict({"path": ["p"], "content": [b"".join(members)]})]))
    assert sum(b.num_rows - b.column("record").null_count for b in whole) == 5


def test_repeated_pages_have_ids_of_their_own(spark):
    rows = [(1, "u", "<p>x"), (1, "u", "<p>x"), (1, "u", "<p>y"), (None, None, None), (None, None, None), (2, "u", "<p>x")]
    for most in (0, 10):
        got = derivatives(page_responses(pages(spark, rows), most_broadcast=most)).collect()
        assert len({r.record_id for r in got}) == len(got) == 12 and len({r.refers_to for r in got}) == 6


def test_reading_is_linear():
    for bad in ("<!--" * 200_000, "<a " * 200_000, "<script>" * 200_000, "<" * 500_000, "<p a='" * 100_000, "&" * 500_000):
        start = time.time()
        page_text(bad)
        assert time.time() - start < 5, bad[:20]


def test_empty(spark):
    assert derivatives(page_responses(pages(spark, []))).collect() == []
