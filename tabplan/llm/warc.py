"""WARC: archives written with Spark's own writers, read back, and revisits resolved by payload digest."""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rows, apart, ensure_checkpoint_dir, materialize, slices, small

# Fixed values of the WARC 1.1 specification and of RFC 4648.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

#: A gzip member without content. Spark's text writer puts it after each record's member, and by it the reader
#: parts the records of a file without holding the file; to other readers it is nothing.
NOTHING = bytes.fromhex("1f8b0801000000000003") + b"\x03\x00" + bytes(8)
#: The files' ending. Readers of archives tell by a file's first bytes that it is compressed, but Spark would undo
#: ".gz" as a whole and lose the bounds between members.
ENDING = ".warc"
WRITER_OPTIONS = {"lineSep": NOTHING.decode("latin-1"), "encoding": "ISO-8859-1"}
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32(hexadecimal: Column) -> Column:
    """Base32 of a SHA-1 in hexadecimal: 40 digits, so 32 letters without padding."""
    letters = []
    for k in range(0, 40, 5):
        number = F.conv(F.substring(hexadecimal, k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def payload_digest(payload: Column) -> Column:
    # bound by a lambda, so that the digest is made once and not for each letter
    return F.transform(F.array(F.sha1(payload)), base32)[0]


def resolve(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(key, digest, several, refers_to, refers_uri, refers_date) of those keys and digests that revisit another record or stand in several.

    headers are (key, url, date, digest, payload_bytes). Of the records that share a digest
    and have at least `least_bytes`, that of the largest key is the response, and the others
    revisit it; smaller ones are responses all. Only headers are shuffled: a digest's largest
    key comes from sums on the map side, and goes back by a join that adaptive execution can
    split for a digest of very many records. Records without a key are responses; of a key
    that repeats with one payload, all are responses or none.
    """
    pairs = materialize(headers.where("key is not null").groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"), F.max("payload_bytes").alias("payload_bytes"), F.max(F.struct("url", "date")).alias("at")))
    large = pairs.where(F.col("payload_bytes") >= least_bytes)
    originals = apart(large.groupBy("digest").agg(F.max(F.struct("key", "at")).alias("o"), F.count(F.lit(1)).alias("keys")).where("keys > 1").drop("keys"))
    revisits = (F.col("payload_bytes") >= least_bytes) & (F.col("key") < F.col("o.key"))
    of_revisits = lambda c: F.when(revisits, F.col(c))
    found = pairs.join(originals, "digest", "left").select("key", "digest", (F.col("n") > 1).alias("several"), of_revisits("o.key").alias("refers_to"), of_revisits("o.at.url").alias("refers_uri"), of_revisits("o.at.date").alias("refers_date"))
    return found.where("several or refers_to is not null")


def urn(key: int | None, digest: str, several: bool) -> str:
    """A record's id: made of its key and digest, which revisits know, but by chance where these don't tell it from others."""
    return f"<urn:uuid:{uuid.uuid4() if key is None or several else uuid.uuid5(NAMESPACE, f'record/{key}/{digest}')}>"


def one_line(text: str | None) -> str:
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


def member(fields: dict[str, str | None], block: bytes) -> bytes:
    """A WARC record as a gzip member; fields without a value are left out."""
    lines = [VERSION, *(f"{n}: {v}" for n, v in fields.items() if v is not None), f"Content-Length: {len(block)}", "", ""]
    whole = CRLF.join(lines).encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


def _members(rows: DataFrame, date: str) -> DataFrame:
    """The column `value`: a gzip member for each row, and one of a warcinfo record before the first of each task, whose rows make a file."""
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, first = Rows(pa.schema([("value", pa.binary())])), True
        about = f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'file/{run_id}/{TaskContext.get().partitionId()}')}>"
        for part in slices(batches, 64):
            for r in part.to_pylist():
                if first:
                    info = member({"WARC-Type": "warcinfo", "WARC-Record-ID": about, "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"software: tabplan\r\nformat: WARC File Format 1.1\r\n")
                    out.add((info,), len(info))
                    first = False
                key, original, several = r["key"], r["refers_to"], bool(r["several"])
                revisit = original is not None
                head = f"{HTTP_HEAD}Content-Length: {r['payload_bytes']}{CRLF}{CRLF}".encode()
                fields = {
                    "WARC-Type": "revisit" if revisit else "response",
                    "WARC-Record-ID": urn(key, r["digest"], several),
                    "WARC-Warcinfo-ID": about,
                    "WARC-Date": r["date"] or date,
                    "WARC-Target-URI": one_line(r["url"]),
                    "WARC-Payload-Digest": f"sha1:{r['digest']}",
                    "X-Record-Key": None if key is None else str(key),
                    "Content-Type": "application/http; msgtype=response",
                }
                if revisit:
                    named = None if r["original_several"] else urn(original, r["digest"], False)
                    fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": named, "WARC-Refers-To-Target-URI": one_line(r["refers_uri"]), "WARC-Refers-To-Date": r["refers_date"] or date, "X-Refers-To-Key": str(original)}
                made = member(fields, head + (b"" if revisit else r["payload"]))
                if out.add((made,), len(made)):
                    yield from out.flush()
        yield from out.flush()

    return rows.mapInArrow(run, "value binary")


def write_archives(rows: DataFrame, folder: str, date: str | None = None) -> None:
    """Archives of a gzip member for each record, a file for each task; `date` is the capture's where a row has none, now if not given.

    rows are (key, url, date, payload, payload_bytes, digest, several, refers_to, refers_uri,
    refers_date, original_several). A revisit has the HTTP headers and no payload, and names
    its original's record, address and date and, in an extension field, its key. Line ends
    inside a URL become %0D and %0A.
    """
    spark = rows.sparkSession
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    # as text only in name: the bytes of the members go to the file as they are
    _members(rows, date).select(F.col("value").cast("string").alias("value")).write.options(**WRITER_OPTIONS, compression="none").text(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.listStatus(path):  # a file for each task
        name = found.getPath().getName()
        if name.endswith(".txt"):
            files.rename(found.getPath(), spark._jvm.org.apache.hadoop.fs.Path(path, name.removesuffix(".txt") + ENDING))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, names in lower case, and block of each record of an archive; ValueError if it is broken off."""
    at = 0
    while at < len(data):
        if data.startswith(b"\r\n", at):
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        at = end + 4 + size
        if at > len(data):
            raise ValueError("the last record is broken off")
        yield fields, data[end + 4 : at]


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record but those on the file itself: key, url, date, record_type, record_id, refers_to_id, refers_to, refers_uri, refers_date, digest, payload, intact.

    Files are read as streams, a record at a time, and large ones by several tasks. intact
    says whether a response's payload has the digest of its header. Archives without records,
    or none, give no rows; a broken archive fails the read.
    """
    texts = ["url", "date", "record_type", "record_id", "refers_to_id", "refers_uri", "refers_date", "digest"]
    schema = pa.schema([("key", pa.int64()), ("refers_to", pa.int64()), *((n, pa.string()) for n in texts), ("payload", pa.binary()), ("intact", pa.bool_())])
    names = ["warc-target-uri", "warc-date", "warc-type", "warc-record-id", "warc-refers-to", "warc-refers-to-target-uri", "warc-refers-to-date"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if x else None
        out = Rows(schema)
        for part in slices(batches, 64):
            for raw in part.column(0).to_pylist():
                for fields, block in parse(zlib.decompress(raw, 31)):
                    if fields.get("warc-type") == "warcinfo":
                        continue
                    digest = fields.get("warc-payload-digest", "").rpartition(":")[2]
                    payload = block.partition(b"\r\n\r\n")[2] if fields.get("warc-type") == "response" else None
                    intact = None if payload is None else b32encode(hashlib.sha1(payload).digest()).decode() == digest
                    if out.add((number(fields.get("x-record-key")), number(fields.get("x-refers-to-key")), *map(fields.get, names), digest, payload, intact), len(payload or b"") + 256):
                        yield from out.flush()
        yield from out.flush()

    members = spark.read.options(**WRITER_OPTIONS, pathGlobFilter=f"*{ENDING}").schema("value string").text(folder)
    return members.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, "key long, refers_to long, " + ", ".join(f"{n} string" for n in texts) + ", payload binary, intact boolean")


def with_originals(read: DataFrame) -> DataFrame:
    """Every record of an archive with payload_bytes: of its own payload, or of the response that it revisits.

    Only headers are shuffled, by the key and digest of the record that holds the payload; a
    revisit without its original gets null.
    """
    heads = materialize(read.select("key", "url", "record_type", "record_id", "refers_to", "digest", "intact", F.octet_length("payload").cast("long").alias("own_bytes")))
    asked = heads.where("record_type = 'revisit'").select(F.col("refers_to").alias("key"), "digest").distinct()
    originals = apart(heads.where("record_type = 'response'").join(apart(asked), ["key", "digest"], "left_semi").groupBy(F.col("key").alias("o_key"), F.col("digest").alias("o_digest")).agg(F.max("own_bytes").alias("original_bytes")))
    responses = heads.where("record_type <> 'revisit'").withColumn("payload_bytes", F.col("own_bytes"))
    revisits = heads.where("record_type = 'revisit'").join(originals, (F.col("refers_to") == F.col("o_key")) & (F.col("digest") == F.col("o_digest")), "left").withColumn("payload_bytes", F.col("original_bytes"))
    wanted = ["key", "url", "record_type", "record_id", "refers_to", "digest", "payload_bytes", "intact"]
    return responses.select(*wanted).unionByName(revisits.select(*wanted))


def deduplicate(rows: DataFrame, least_bytes: int = 0, folder: str | None = None, date: str | None = None) -> str:
    """Write rows (key, url, payload) as archives in which each payload is held once; returns their folder.

    A column `date` of rows, a text as WARC-Date wants it, tells when a record was captured.
    Payloads are hashed where they are read; resolve() sees headers alone, and only what it
    finds comes back to the rows. Null payloads count as empty. Record ids are unique, also
    where keys are null or repeat; a revisit of a record that shares key and payload with
    others names it by key, address and date alone.
    """
    folder = folder or f"{ensure_checkpoint_dir(rows.sparkSession)}/warc-{uuid.uuid4().hex}"
    captured = F.col("date").cast("string") if "date" in (c.lower() for c in rows.columns) else F.lit(None).cast("string")
    whole = rows.select(F.col("key").cast("long").alias("key"), F.col("url").cast("string").alias("url"), captured.alias("date"), F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"))
    size = F.octet_length("payload").cast("long").alias("payload_bytes")
    notes = materialize(resolve(materialize(whole.select("key", "url", "date", payload_digest(F.col("payload")).alias("digest"), size)), least_bytes))
    of_originals = notes.where("several").select(F.col("key").alias("o_key"), F.col("digest").alias("o_digest"), F.lit(True).alias("original_several"))
    notes = materialize(notes.join(apart(of_originals), (F.col("refers_to") == F.col("o_key")) & (F.col("digest") == F.col("o_digest")), "left").drop("o_key", "o_digest").withColumnsRenamed({"key": "k", "digest": "d"}))
    hashed = whole.select("*", payload_digest(F.col("payload")).alias("digest"), size)
    known = hashed.join(small(notes), (F.col("key") == F.col("k")) & (F.col("digest") == F.col("d")), "left")
    write_archives(known.drop("k", "d"), folder, date)
    return folder


def revisit_archives(rows: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """(key, url, record_type, record_id, refers_to, digest, payload_bytes, intact) of rows (key, url, payload), read back from deduplicated archives.

    One row per row, repeated ones too; an empty table gives an empty one. Other columns of
    rows, but for `date`, play no part. The archives stay in `folder`, or in the cluster's shared one.
    """
    written = deduplicate(rows, least_bytes, folder)
    return with_originals(read_archives(rows.sparkSession, written))
