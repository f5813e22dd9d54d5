"""Archives of any layout: read whole, or an error, and never without an end."""

import gzip
import io
import random
import struct
import zlib

import pytest

from tracegraph.llm import warc
from tracegraph.llm.warc import WarcReader, _Gzip, _Plain, member, record

SIZES = (0, 5, 700, 40_000, 300_000)
RECORDS = [record("response", f"urn:{i}", f"u{i}", "D", random.Random(i).randbytes(n), n) for i, n in enumerate(SIZES)]


def read(raw, payload=True, wanted=None, tmp=None):
    path = tmp / "a.warc.gz"
    path.write_bytes(raw)
    reader = WarcReader(str(path), payload)
    reader.wanted = wanted or []
    (part,) = reader.partitions()
    return [row for b in reader.read(part) for row in b.to_pylist()]


LAYOUTS = {
    "plain": b"".join(RECORDS),
    "own": b"".join(map(member, RECORDS)),
    "one a member": b"".join(map(gzip.compress, RECORDS)),
    "all in one": gzip.compress(b"".join(RECORDS)),
    "all in one of ours": member(b"".join(RECORDS)),
    "two a member of ours": member(b"".join(RECORDS[:2])) + member(b"".join(RECORDS[2:4])) + member(RECORDS[4]),
    "empty last": b"".join(map(gzip.compress, RECORDS)) + gzip.compress(b""),
    "empty first and between": gzip.compress(b"") + b"".join(gzip.compress(r) + member(b"") for r in RECORDS),
    "zeros": b"".join(gzip.compress(r) + b"\0" * k for k, r in zip((0, 1, 512, 20_000, 3), RECORDS, strict=True)),
    "cut anywhere": b"".join(gzip.compress(b"".join(RECORDS)[k : k + 9_001]) for k in range(0, sum(map(len, RECORDS)), 9_001)),
    "cut anywhere, of ours": b"".join(member(b"".join(RECORDS)[k : k + 9_001]) for k in range(0, sum(map(len, RECORDS)), 9_001)),
    "no line ends at the end": gzip.compress(b"".join(RECORDS)[:-4]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_every_layout_is_read_whole(name, tmp_path):
    raw = LAYOUTS[name]
    got = read(raw, tmp=tmp_path)
    assert [(r["record_id"], r["payload_bytes"], r["payload"]) for r in got] == [(f"urn:{i}", n, random.Random(i).randbytes(n)) for i, n in enumerate(SIZES)]
    assert [(r["record_id"], r["payload_bytes"], r["payload"]) for r in read(raw, False, tmp=tmp_path)] == [(f"urn:{i}", n, None) for i, n in enumerate(SIZES)]
    some = read(raw, wanted=[("record_id", "in", ("urn:1", "urn:4"))], tmp=tmp_path)
    assert [(r["record_id"], len(r["payload"])) for r in some] == [("urn:1", 5), ("urn:4", 300_000)]


@pytest.mark.parametrize("name", LAYOUTS)
@pytest.mark.parametrize("payload", [True, False])
def test_a_short_archive_is_an_error(name, payload, tmp_path):
    raw = LAYOUTS[name].rstrip(b"\0")
    if name == "empty last":
        raw = raw[: -len(gzip.compress(b""))]
    if name.startswith("empty first"):
        raw = raw[: -len(member(b""))]
    for cut in (5, 30, 1000, 100_000):
        if name != "plain" or cut > 5:  # only line ends are lost
            with pytest.raises(ValueError, match="archive"):
                read(raw[:-cut], payload, tmp=tmp_path)


def test_other_bytes_are_an_error(tmp_path):
    for raw in (gzip.compress(RECORDS[1]) + b"junk", gzip.compress(b"junk"), RECORDS[1] + b"junk", b"\x1f\x8b" + b"\0" * 40, gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nabc")):
        with pytest.raises((ValueError, zlib.error)):
            read(raw, tmp=tmp_path)
    short = record("response", "urn:1", "u", "D", b"abc", 3)
    with pytest.raises(ValueError, match="inside a record"):  # shorter than its Content-Length
        read(gzip.compress(short[:-6]), tmp=tmp_path)
    assert read(b"", tmp=tmp_path) == [] and read(gzip.compress(b""), tmp=tmp_path) == []


def test_a_false_length_does_not_go_on_for_ever(tmp_path):
    good = member(RECORDS[3])
    for total in (0, 10, len(good) - 3, len(good) + 9, 1 << 31):
        with pytest.raises((ValueError, zlib.error)):
            read(good[:16] + struct.pack("<I", total) + good[20:] + member(b"junk"), False, tmp=tmp_path)


def test_unwanted_payloads_are_not_inflated():
    class Counted(io.BytesIO):
        got = 0

        def read(self, n=-1):
            out = super().read(n)
            self.got += len(out)
            return out

    big = record("response", "urn:big", "u", "D", random.Random(0).randbytes(3_000_000), 3_000_000)
    for raw, source in ((member(big) * 4, _Gzip), (big * 4, _Plain)):
        f = Counted(raw)
        s, n = source(f), 0
        while (head := s.headers()) is not None:
            s.skip(int(warc.parse_headers(head)["content-length"]))
            n += 1
        assert n == 4 and f.got < 200_000


def test_a_block_without_http_headers(tmp_path):
    r = record("response", "urn:1", "u", "D", b"abc", 3)
    at = r.index(b"HTTP/1.1")
    body = b"no headers here"
    head = r[:at].decode().split("\r\n")
    head = "\r\n".join(f"Content-Length: {len(body)}" if x.startswith("Content-Length") else x for x in head).encode()
    got = read(gzip.compress(head + body + b"\r\n\r\n"), tmp=tmp_path)
    assert [(x["payload_bytes"], x["payload"]) for x in got] == [(len(body), body)]
