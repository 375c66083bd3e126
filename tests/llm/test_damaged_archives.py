"""Archives with damage: what is lost is told, and nothing else is lost."""

import base64
import gzip
import hashlib
import pathlib
import random

import pytest

from tidewake.llm import warc
from tidewake.llm.common import new_path

HEAD = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"


def record(k, block=None, length=None, **fields):
    block = HEAD + warc.chunked(b"body %d" % k) if block is None else block
    known = {"WARC-Type": "response", "WARC-Record-ID": f"<r:{k}>", "Content-Length": str(len(block)) if length is None else length} | {n.replace("_", "-"): v for n, v in fields.items()}
    return b"WARC/1.1\r\n" + b"".join(f"{n}: {v}\r\n".encode() for n, v in known.items() if v is not False) + b"\r\n" + block + b"\r\n\r\n"


def read(spark, *archives):
    path = pathlib.Path(new_path(spark, "warc"))
    path.mkdir(parents=True)
    for k, data in enumerate(archives):
        (path / f"part-{k}").write_bytes(data)
    return warc.read_warc(spark, str(path)).collect()


def whole(rows):
    return sorted(bytes(r["payload"]) for r in rows if r["complete"])


BAD = [
    (record(1, length=False), "states no length"),
    (record(1, length="12x"), "states no length"),
    (record(1, length="-5"), "states no length"),
    (record(1, length="5"), "cut or longer"),
    (record(1, length="100000"), "cut or longer"),
    (record(1, block=HEAD + b"zz\r\nabc\r\n0\r\n\r\n"), "chunked framing: a chunk's size is no number"),
    (record(1, block=HEAD + b"-1\r\nabc\r\n0\r\n\r\n"), "chunked framing: a chunk's size is no number"),
    (record(1, block=HEAD + b"5\r\nabc"), "chunked framing"),
    (record(1, WARC_Record_ID=False), "no id or no type"),
    (record(1, WARC_Type=False), "no id or no type"),
    (record(1, WARC_Segment_Number="one"), "is no number"),
    (b"junk that is no record\r\n\r\n", "no record begins"),
    (record(1, block=b"")[:-4], "cut or longer"),
]


@pytest.mark.parametrize("compressed", [False, True])
def test_a_damaged_record_costs_no_other(spark, compressed):
    kept = [b"body 0", b"body 2", b"body 3"]
    pack = gzip.compress if compressed else bytes
    got = read(spark, *(b"".join(map(pack, (record(0), bad, record(2), record(3)))) for bad, _ in BAD))
    assert whole(got) == sorted(kept * len(BAD))
    lost = [r for r in got if not r["complete"]]
    assert len(lost) == len(BAD) and all(r["payload"] is None for r in lost)
    for _, reason in BAD:
        assert any(reason in r["problem"] for r in lost), reason


def test_each_damage_alone(spark):
    for bad, reason in BAD:
        last = list(warc.parse_archive(record(0) + bad, strict=False))
        assert last[0][1] == HEAD + warc.chunked(b"body 0") and len(last) == 2
        if "chunked" not in reason and "id" not in reason and "number" not in reason:
            assert reason in last[1][0][warc.PROBLEM]


def test_damaged_gzip_members(spark):
    rng = random.Random(1)
    bodies = [rng.randbytes(3000) for _ in range(6)]
    members = [gzip.compress(record(k, block=HEAD + warc.chunked(b))) for k, b in enumerate(bodies)]
    torn = bytearray(members[2])
    torn[len(torn) // 2 : len(torn) // 2 + 40] = b"\0" * 40
    got = read(spark, b"".join([*members[:2], bytes(torn), *members[3:]]), b"".join(members)[:-500], b"".join(members[:3]) + members[3][:700] + b"".join(members[4:]))
    assert whole(got) == sorted([*bodies[:2], *bodies[3:], *bodies[:5], *bodies[:3], *bodies[4:]])
    assert all(r["problem"] and r["payload"] is None for r in got if not r["complete"]) and any(not r["complete"] for r in got)


def test_any_cut_keeps_the_records_before_it(spark):
    """Cut at every byte, an archive gives the records that are whole, and one damaged row at most."""
    plain = b"".join(record(k) for k in range(3))
    ends = [len(record(0)), 2 * len(record(0)), 3 * len(record(0))]
    for cut in range(1, len(plain)):
        rows = list(warc.parse_archive(iter([plain[:cut][k : k + 7] for k in range(0, cut, 7)]), strict=False))
        sound = [b for f, b in rows if warc.PROBLEM not in f]
        assert len(sound) == sum(e <= cut for e in ends) and len(rows) - len(sound) == (cut not in ends), cut
    packed = b"".join(gzip.compress(record(k)) for k in range(3))
    for cut in range(3, len(packed), 5):
        rows = list(warc.parse_archive(warc.inflated(packed[:cut], 11, strict=False), strict=False))
        assert len(rows) - sum(warc.PROBLEM not in f for f, _ in rows) <= 1


def test_digests_are_verified(spark):
    own = hashlib.sha1(b"body 1").digest()
    stated = {"hex": "sha1:" + own.hex(), "upper": "SHA1:" + own.hex().upper(), "base32": "sha1:" + base64.b32encode(own).decode(), "other": "md5:00", "none": False, "wrong": "sha1:" + "0" * 40}
    got = read(spark, b"".join(record(1, WARC_Payload_Digest=v, WARC_Target_URI=k) for k, v in stated.items()))
    assert {r["uri"]: r["complete"] for r in got} == {k: k != "wrong" for k in stated}
    wrong = next(r for r in got if r["uri"] == "wrong")
    assert bytes(wrong["payload"]) == b"body 1" and "differs" in wrong["problem"]


def test_a_damaged_segment_spoils_its_record_alone(spark):
    block = HEAD + warc.chunked(b"z" * 500, 100)
    parts = [warc.zlib.decompress(p + b"\0", 31) for p in warc._records("<r:9>", "u", "response", None, "00", block, 150)]
    hurt = parts[1].replace(b"Content-Length: 150", b"Content-Length: 9999")
    got = read(spark, b"".join([record(0), parts[0], hurt, *parts[2:], record(2)]))
    assert whole(got) == [b"body 0", b"body 2"]
    assert [(r["record_id"], r["payload"]) for r in got if not r["complete"]] == [("<r:9>", None)]
