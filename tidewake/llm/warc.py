"""WARC archives: writing with segments and revisits, and reading with segment reassembly.

Records longer than a segment are written as a first record and continuation records. Reading
parses each archive by its records' lengths, groups segments by origin identifier, orders them by
segment number, verifies numbers and total length, and decodes chunked transfer framing. An
archive file that is written here holds a bounded number of records of bounded length, each a
gzip member of its own; a file is inflated and parsed piece by piece. Damage costs the records it
lies in: reading goes on at the next gzip member or record and says what is wrong with each.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import new_path

SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE, REVISIT_BYTES = 32_768, 8_192, 4_096, 1_000
PROBLEM = "problem:"  # no header line can have this name
DATE = "2020-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        parts += (b"%x\r\n" % len(piece), piece, b"\r\n")
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload in a chunked body; extensions and trailers are skipped, a cut body is an error."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunked body ends within a size line")
        number = body[at:line].split(b";")[0].strip(b" \t")
        if not number or number.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("a chunk's size is no number")
        size = int(number, 16)
        if size == 0:
            return b"".join(parts)
        at = line + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("chunk is shorter than its size")
        parts.append(body[line + 2 : at])
        at += 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member without its last byte, which is 0 and which the text sink adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    out = deflate.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + deflate.flush()
    if out[-1]:
        raise ValueError("a record of 16 MiB or more must be segmented")
    return out[:-1]


def _records(record_id: str, uri: str, kind: str, refers: str | None, digest: str, block: bytes, segment: int) -> Iterator[bytes]:
    uri = "".join(c for c in uri if c not in "\r\n")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers is not None:
        fields += [("WARC-Refers-To", refers), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(pieces) < 2:
        yield _record(fields, block)
        return
    yield _record([*fields, ("WARC-Segment-Number", "1")], pieces[0])
    for n, piece in enumerate(pieces[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{record_id[:-1]}/{n}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", str(n))]
        yield _record(more + [("WARC-Segment-Total-Length", str(len(block)))] * (n == len(pieces)), piece)


def decisions(pages: DataFrame, key: str, payload: Column, least: int = REVISIT_BYTES) -> DataFrame:
    """(key, digest, refers_to, repeated) of the pages that are no plain response.

    refers_to: the largest key with the same payload of ``least`` bytes or more, if it is another.
    repeated: several rows have the key and the payload.
    """
    light = pages.select(F.col(key).alias("k"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    pairs = light.groupBy("digest", "n", "k").agg(F.count(F.lit(1)).alias("copies"))
    top = light.where(F.col("n") >= least).groupBy("digest", "n").agg(F.max("k").alias("top"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    found = pairs.join(top, ["digest", "n"], "left").select("k", "digest", F.when(F.col("k").isNull() | (F.col("k") < F.col("top")), F.col("top")).alias("refers_to"), (F.col("copies") > 1).alias("repeated"))
    return found.where("repeated or refers_to is not null")


def write_warc(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", html: str = "html", segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write an archive record for each row: its html as a chunked HTTP response, or a revisit.

    Each record is a gzip member of its own, and records above ``segment_bytes`` (below 16 MiB) are
    segmented. A null html is an empty payload and a null key the smallest of its group. Of equal
    payloads of at least 1000 bytes the largest key's rows are responses and others revisit it. An
    empty table writes archives without records; other columns are ignored. Record ids are made
    of the key and the digest, which a revisit names; rows that repeat both get a row number
    besides, so that each has an id of its own.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("k"), F.coalesce(F.col(uri), F.lit("")).alias("uri"), F.sha1(payload).alias("digest"), payload.alias("payload"))
    decided = rows.alias("a").join(decisions(pages, key, payload).alias("b"), F.col("a.k").eqNullSafe(F.col("b.k")) & (F.col("a.digest") == F.col("b.digest")), "left").select("a.*", "b.refers_to", F.when(F.col("b.repeated"), F.monotonically_increasing_id()).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for k, address, digest, body, refers, row in zip(*(batch.column(i) for i in range(6)), strict=True):
                body, refers, digest = body.as_py(), refers.as_py(), digest.as_py()
                record_id = f"<urn:page:{'null' if k.as_py() is None else k.as_py()};sha1={digest}{'' if row.as_py() is None else f';row={row.as_py()}'}>"
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                if refers is None:
                    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(body)
                else:
                    block = head + b"Content-Length: %d\r\n\r\n" % len(body)
                for r in _records(record_id, address.as_py(), "response" if refers is None else "revisit", None if refers is None else f"<urn:page:{refers};sha1={digest}>", digest, block, segment_bytes):
                    out.append(r)
                    held += len(r)
                if held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    lines = decided.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    # the separator is the last byte of each member, so that a file is its members and nothing else
    lines.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", records_per_file).text(path)


def inflated(raw: bytes, step: int = 1 << 16, strict: bool = True) -> Iterator[bytes | None]:
    """An archive's bytes in pieces: all gzip members in turn, or the bytes themselves if it is not compressed.

    A damaged member is an error; if not ``strict``, it gives what could be read of it and then None,
    and reading goes on at the next member that can be told by its first bytes.
    """
    view, at = memoryview(raw), 0
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    lost = False  # within a damaged stretch, where a member's first bytes may be there by chance
    while at < len(view):
        member, begin, gave = zlib.decompressobj(31), at, False
        try:
            while not member.eof:
                if at >= len(view):
                    raise ValueError("the archive ends within a gzip member")
                given = view[at : at + step]
                piece = member.decompress(given)
                gave = gave or bool(piece)
                yield piece
                at += len(given) - len(member.unused_data)
            lost = False
        except (ValueError, zlib.error):
            if strict:
                raise
            if gave or not lost:
                yield None
            lost, at = True, raw.find(b"\x1f\x8b\x08", begin + 1)
            if at < 0:
                return


def parse_archive(pieces: Iterator[bytes | None] | bytes, strict: bool = True) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of an archive given in pieces, by the lengths they state.

    No more than a record and a piece is held at a time. A record that is cut, states no length or
    another than it has, and bytes that begin no record, are errors. If not ``strict``, such a record
    has what there is of it and a field ``PROBLEM``; reading goes on after the next empty line that a
    record's first bytes follow, or at the next gzip member.
    """
    source, data, done, broken = iter([pieces] if isinstance(pieces, bytes) else pieces), bytearray(), 0, False

    def more() -> bool:
        nonlocal broken
        if not broken:
            for piece in source:
                if piece:
                    data.extend(piece)
                    return True
                if piece is None:
                    broken = True  # nothing that is held goes on beyond this
                    return False
        return False

    def header() -> tuple[dict[str, str], int, str | None]:
        """(fields, where the block begins, what is wrong) of the record that the data begin with."""
        if data[:5] != b"WARC/":
            return {}, 0, "no record begins"
        seen = 0
        while (end := data.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(data)
            if not more():
                return {}, 0, "a record ends within its header"
        lines = bytes(data[:end]).decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = fields.get("content-length", "")
        return fields, end + 4, None if size.isascii() and size.isdigit() else "a record states no length"

    def rest_of(start: int) -> int:
        """Where what comes before the next record ends: at an empty line that a record's first bytes follow, or with the data."""
        while (found := data.find(b"\r\n\r\nWARC/", start)) < 0:
            start = max(start, len(data) - 8)
            if not more():
                return len(data)
        return found

    while True:
        while len(data) < 5 and more():
            pass
        if not data and not broken:
            return
        if not data:
            if strict:
                raise ValueError(f"damage at byte {done}")
            yield {PROBLEM: f"damage at byte {done}"}, b""
            broken = False
            continue
        fields, start, wrong = header()
        stop = start
        if wrong is None:
            stop += int(fields["content-length"])
            while len(data) < stop + 4 and more():
                pass
            if data[stop : stop + 4] != b"\r\n\r\n":
                wrong = "a record is cut or longer than it states"
        if wrong is None:
            yield fields, bytes(data[start:stop])
        elif strict:
            raise ValueError(f"{wrong} at byte {done}")
        else:
            stop = rest_of(max(0, start - 4))  # the empty line after the header may be the one before the next record
            block = bytes(data[start:stop])
            if fields or block.strip():
                yield {**fields, PROBLEM: f"{wrong} at byte {done}"}, block
            stop = max(start, stop)
        taken = min(len(data), stop + 4 if start <= stop and data[stop : stop + 4] == b"\r\n\r\n" else stop)
        del data[:taken]
        done += taken
        broken = broken and bool(data)


def digest_of(stated: str, payload: bytes) -> bool | None:
    """Whether the payload has the SHA-1 digest that its record states, in hex or base 32; None where it states none that is known."""
    kind, _, value = stated.rpartition(":")
    if kind.lower() not in ("sha1", "") or len(value) not in (32, 40):
        return None
    own = hashlib.sha1(payload).digest()
    return value.lower() == own.hex() if len(value) == 40 else value.upper() == base64.b32encode(own).decode()


def _number(fields: dict[str, str], name: str) -> int | None:
    """A field's number from 0 up; None if it is absent, and a ValueError for anything else."""
    value = fields.get(name)
    if value is not None and not (value.isascii() and value.isdigit() and len(value) < 19):
        raise ValueError(f"{name} is no number")
    return None if value is None else int(value)


def _row(fields: dict[str, str], block: bytes) -> tuple:
    """A record as a row of ``RECORDS``; one without an id, or whose segment number is none, stands alone."""
    problem, number, total = fields.get(PROBLEM), None, None
    try:
        number, total = _number(fields, "warc-segment-number"), _number(fields, "warc-segment-total-length")
        number = number if number is None or number < 1 << 31 else 0
    except ValueError as wrong:
        problem = problem or str(wrong)
    own = fields.get("warc-record-id")
    record_id, kind = fields.get("warc-segment-origin-id", own), fields.get("warc-type")
    if problem is None and (record_id is None or kind is None):
        problem = "the record has no id or no type"
    if record_id is None:
        number = None
    return record_id, kind, fields.get("warc-target-uri"), fields.get("warc-refers-to"), fields.get("warc-payload-digest", ""), number, total, block, problem


RECORDS = {"record_id": pa.string(), "type": pa.string(), "uri": pa.string(), "refers_to": pa.string(), "digest": pa.string(), "segment": pa.int32(), "total": pa.int64(), "block": pa.binary(), "problem": pa.string()}
MISPLACED = "a segment is missing or repeated, or the total length differs"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per logical record: record_id, type, uri, refers_to, digest, complete, payload, payload_bytes, problem.

    Segments are put together; ``complete`` is false, ``problem`` says why and the payload is null
    where a segment is missing or repeated, the total length differs, a record is cut, states no
    length, id or type, its gzip member is damaged or its chunked framing is. A payload that differs
    from the digest which its record states (SHA-1, hex or base 32) is not complete either, but is
    given. One damaged record costs no other, except that a record without a usable length ends where
    an empty line and a record's first bytes follow. ``digest`` is the stated one without its
    algorithm. A revisit has no payload of its own; its payload_bytes are those its HTTP header
    states. Archives may be plain or gzip files of any number of members; those without records give
    no rows.
    """
    names, types = list(RECORDS), list(RECORDS.values())
    files = spark.read.format("binaryFile").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out, held = [], 0
                for fields, block in parse_archive(inflated(content.as_py(), strict=False), strict=False):
                    out.append(_row(fields, block))
                    held += len(block)
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names)
                        out, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names)

    records = files.mapInArrow(parse, "record_id string, type string, uri string, refers_to string, digest string, segment int, total long, block binary, problem string")
    whole = records.where("segment is null").select("record_id", "type", "uri", "refers_to", "digest", F.array("block").alias("blocks"), "problem")
    first = lambda c: F.min(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    grouped = records.where("segment is not null").groupBy("record_id").agg(*map(first, ("type", "uri", "refers_to", "digest")), F.min("problem").alias("problem"), F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"]))
    numbers = F.transform("parts", lambda x: x["segment"])
    sound = F.coalesce((size == F.col("total")) & (numbers == F.sequence(F.lit(1), F.size("parts"))), F.lit(False))
    parts = grouped.select("record_id", "type", "uri", "refers_to", "digest", F.transform("parts", lambda x: x["block"]).alias("blocks"), F.coalesce("problem", F.when(~sound, MISPLACED)).alias("problem"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                digests, payloads, sizes, problems = [], [], [], []
                for kind, stated, blocks, problem in zip(some.column(1), some.column(4), some.column(5), some.column(6), strict=True):
                    problem, stated = problem.as_py(), stated.as_py() or ""
                    head, _, body = b"".join(blocks.as_py()).partition(b"\r\n\r\n")
                    fields = {a.strip().lower(): b.strip() for a, _, b in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
                    payload, length = None, fields.get(b"content-length", b"")
                    if problem is None and kind.as_py() == "response":
                        try:
                            payload = dechunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
                        except ValueError as wrong:
                            problem = f"chunked framing: {wrong}"
                        else:
                            problem = "the payload differs from its digest" if digest_of(stated, payload) is False else None
                    digests.append(stated.rpartition(":")[2])
                    payloads.append(payload)
                    sizes.append(len(payload) if payload is not None else int(length) if length.isdigit() and len(length) < 19 else None)
                    problems.append(problem)
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(4)), pa.array(digests, pa.string()), pa.array([x is None for x in problems]), pa.array(payloads, pa.binary()), pa.array(sizes, pa.int64()), pa.array(problems, pa.string())], ["record_id", "type", "uri", "refers_to", "digest", "complete", "payload", "payload_bytes", "problem"])

    return whole.unionByName(parts).mapInArrow(decode, "record_id string, type string, uri string, refers_to string, digest string, complete boolean, payload binary, payload_bytes long, problem string")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive record of each page, written and read back; digests of responses are those of the payloads read.

    A record of these archives that is not complete fails the job.
    """
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+);', 1) as bigint)")
    return read_warc(spark, path).select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        F.when(~F.col("complete"), F.raise_error(F.concat_ws(": ", "record_id", "problem"))).otherwise(F.coalesce(F.sha1("payload"), F.col("digest"))).alias("payload_digest"),
        F.col("type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )


OP2_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND (page_id < top OR (page_id IS NULL AND top IS NOT NULL)) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND (page_id < top OR (page_id IS NULL AND top IS NOT NULL)) THEN top END AS refers_to
FROM w
"""
