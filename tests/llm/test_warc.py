"""Round trips, and damage of which everything else must survive."""

import base64
import gzip
import hashlib
import random

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from mercato.llm import warc as op

SCHEMA = "page_id long, url string, html string, size int, Digest string"


def record(i, body, extra="", digest=None):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    named = digest or "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:r:{i}>\r\nWARC-Page-ID: {i}\r\n{extra}" \
           f"WARC-Block-Digest: {named}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def bodies(n=30):
    rng = random.Random(8)
    return [rng.randbytes(rng.randint(0, 3000)) for _ in range(n)]


def ids(data):
    found = list(op.salvage(data))
    spans = [(s, e) for kind, s, e, *_ in found if kind == "gap"]
    return [int(r.headers["warc-page-id"]) for kind, _, _, r, _ in found if kind == "record"], spans


@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress], ids=["plain", "members"])
def test_intact(pack):
    assert ids(b"".join(pack(record(i, b)) for i, b in enumerate(bodies()))) == (list(range(30)), [])


@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress], ids=["plain", "members"])
@pytest.mark.parametrize("seed", range(40))
def test_one_damaged_place_costs_one_record(pack, seed):
    rng = random.Random(seed)
    parts = [pack(record(i, b)) for i, b in enumerate(bodies())]
    hit = rng.randrange(30)
    part = bytearray(parts[hit])
    kind = rng.choice(["flip", "cut", "junk", "drop"])
    # Headers in front of the digest are covered by no check but their form.
    at = rng.randrange(part.index(b"WARC-Block") if pack is not gzip.compress else 0, len(part) - 4)
    if kind == "flip":
        part[at] ^= 0xFF
    elif kind == "cut":
        del part[at : at + rng.randint(1, 40)]
    elif kind == "junk":
        part[at:at] = rng.randbytes(50)
    else:
        part = part[: len(part) // 2]
    parts[hit] = bytes(part)
    data = b"".join(parts)
    found, gaps = ids(data)
    assert set(range(30)) - set(found) <= {hit} and sorted(found) == found
    start = sum(map(len, parts[:hit]))
    assert all(start <= s < e <= start + len(parts[hit]) for s, e in gaps)
    if hit not in found:
        assert gaps


@pytest.mark.parametrize("mark", ["\x85", "\u2028", "\u2029"])
def test_only_line_ends_end_a_header(mark):
    found = list(op.salvage(record(1, b"x", f"WARC-Target-URI: http://h/a{mark}b{mark}\r\n")))
    assert [f[0] for f in found] == ["record"] and found[0][3].headers["warc-target-uri"] == f"http://h/a{mark}b{mark}"


def test_round_trip_of_odd_urls(spark):
    rows = [(i, f"http://h/{c}/{c}", "page", 0, "") for i, c in enumerate("\x85\u2028\u2029\x0b\x1c a")]
    assert sorted(r["page_id"] for r in op.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()) == list(range(len(rows)))


def test_bytes_are_records_or_gaps():
    parts = [record(i, b) for i, b in enumerate(bodies(6))]
    data = b"noise at the start" + parts[0] + b"\x1f\x8b\x08 no member" + parts[1] + gzip.compress(parts[2]) + parts[3][:-30]
    found = sorted((s, e) for _, s, e, *_ in op.salvage(data))
    assert found[0][0] == 0 and found[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(found, found[1:]))
    assert ids(data)[0] == [0, 1, 2]


def test_a_record_inside_a_payload_is_not_one():
    inner = record(99, b"inner")
    outer = record(1, b"see:\r\n" + inner, digest="sha1:" + "0" * 40)
    assert ids(record(0, b"a") + outer + record(2, b"b")) == ([0, 2], [(len(record(0, b"a")), len(record(0, b"a") + outer))])


def test_whole_file_in_one_member():
    assert ids(gzip.compress(b"".join(record(i, b) for i, b in enumerate(bodies(5)))))[0] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("data", [b"", b"\r\n", b"WARC/1.0\r\n", b"WARC/1.0\r\nA: b\r\n\r\n", b"\x1f\x8b\x08", bytes(1000)])
def test_hopeless_files(data):
    assert ids(data)[0] == []


def test_read_files(spark, tmp_path):
    parts = [record(i, b) for i, b in enumerate(bodies(9))]
    (tmp_path / "a.warc").write_bytes(b"".join(parts[:3]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, parts[3:6])) + b"tail")
    (tmp_path / "c.warc").write_bytes(b"XX" + b"".join(parts[6:]))
    (tmp_path / "d.warc").write_bytes(b"")
    rows = op.read_warc(spark, str(tmp_path)).collect()
    found = {int(r["page"]): r for r in rows if r["kind"] == "record"}
    assert sorted(found) == list(range(9))
    for i, body in enumerate(bodies(9)):
        assert found[i]["payload"] == body and found[i]["payload_digest"] == hashlib.sha1(body).hexdigest()
    gaps = sorted((r["path"].rpartition("/")[2], r["length"], r["reason"]) for r in rows if r["kind"] == "gap")
    assert gaps == [("b.warc.gz", 4, "no version line"), ("c.warc", 2, "no version line")]


def pages():
    rng = random.Random(1)
    long = "<p>" + "ü😀 x" * 400
    texts = [long, long, long + " ", "short", "short", "", None, "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 80, "\r\n\r\n" * 300, "x" * 200_000, "x" * 999, "x" * 1000, "x" * 1000]
    rows = [(i, f"http://h.example/{i} \n", t, i, "z") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(None, None, long, None, None), (1, "u", long, 0, ""), (3, "http://a", "short", 0, "")]


def test_round_trip(spark):
    rows = pages()
    found = op.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    first = {}
    for page, _, html, *_ in rows:
        if page is not None:
            first[html or ""] = max(page, first.get(html or "", -1))
    expected = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        again = len(data) >= 1000 and page != first[html or ""]
        expected.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_payloads_come_back(spark, tmp_path):
    rows = pages()
    path = op.write_warc(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "w"), file_bytes=50_000)
    found = op.read_warc(spark, path, pattern="part-*")
    assert found.where("kind = 'gap'").count() == 0
    got = sorted(r["payload"] for r in found.where("record_type = 'response'").collect())
    kept = {(r[2] or "").encode() for r in rows}
    assert set(got) == kept


def test_empty(spark):
    assert op.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_same_as_sql(spark, sf_dir):
    name = "op2_warc_salvage"
    _, problem = compare(spark, connect(sf_dir), entry.queries()[name], entry.oracle_sql()[name], sf_dir)
    assert not problem
