"""WARC archives with a two-level capture index.

Writing: tasks write gzip-per-record WARC 1.1 files into the shared folder. Of records with equal payloads the one of
the smallest page id is a `response`, the others are `revisit` records that name it. Indexing: captures are sorted by
reversed-host URL key, time and page id; each index shard is a file of gzip blocks of sorted lines and a sparse directory
with the first key, offset and length of each block. Lookup: binary search over the shards' first keys, then in
the directory, one range read of a block, binary search in its lines, one range read of the record.
Reading back: archives are parsed record by record; a revisit's payload is that of its response, found by the index.

Files come from tasks; each appears under its name when it is whole, and only files named in the materialised lists are read, so
what a failed attempt leaves behind is never seen.

Edge cases: a null payload is empty; a null or empty URL is written as urn:page:<page id>; equal empty payloads are equal like any
other; rows that repeat the smallest page id are responses as well; a null page id is a revisit of the group's smallest
id, or a response if the group has no id; empty tables give no file and no row; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import json
import re
import uuid
import zlib
from collections import OrderedDict
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encode_text, materialise, shared_path, spread
from .files import TaskFile, open_input, read_range

DATE = "2024-01-01T00:00:00Z"  # the tables carry no capture time
ROLL_BYTES = 1 << 30  # an archive ends after this size
INDEX_BLOCK = 1000  # captures in a compressed block
INDEX_SHARDS = 64  # bounds the list of shards, which every lookup task holds
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "url_key string, page_id long, uri string, offset long, length long, record_type string, digest string, payload_bytes long"
SPACE = uuid.UUID("5a7d1b0e-3a0b-4d5e-9a53-0d9c1d1f0a11")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def safe_uri(url, page_id) -> str:
    """URL that fits a header line: blanks and control characters are percent-encoded."""
    if not isinstance(url, str) or not url:
        return f"urn:page:{'' if page_id is None else page_id}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)


def url_key(url: str) -> str:
    """Reversed-host sort key: http://User@Blog.Example.com:80/a?b#c -> com,example,blog)/a?b"""
    m = re.match(r"(?i)([a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)", url)
    if not m:
        return url.split("#")[0].lower()
    scheme, host, port, rest = m[1].lower(), m[2].lower().rstrip("."), m[3], m[4] or "/"
    host = ",".join(reversed(host.split(".")))
    port = f":{port}" if port and (scheme, port) not in (("http", "80"), ("https", "443")) else ""
    return f"{host}{port}){rest if rest.startswith('/') else '/' + rest}"


def capture_key(url: str, date: str, page_id) -> str:
    """Unique, sortable: URL key, time, page id."""
    return f"{url_key(url)} {re.sub('[^0-9]', '', date)} {'-' if page_id is None else f'{page_id + (1 << 63):020d}'}"


def record(page_id, url: str, payload: bytes, digest: str, refers_to, ref_url, date: str = DATE) -> bytes:
    """One gzip member."""
    def rid(i):
        return f"<urn:uuid:{uuid.uuid5(SPACE, f'{i} {digest}')}>"

    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", rid(page_id)), ("WARC-Date", date), ("WARC-Target-URI", url),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Page-ID", "" if page_id is None else page_id), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", rid(refers_to)), ("WARC-Refers-To-Target-URI", ref_url), ("WARC-Refers-To-Date", date),
                   ("WARC-Refers-To-Page-ID", refers_to), ("WARC-Truncated", "length")]
        body = head
    else:
        body = head + payload
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(body))])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + body + b"\r\n\r\n") + z.flush()


def parse(raw: bytes) -> tuple[dict, bytes]:
    """(header fields, payload) of an unpacked record; the payload is what follows the HTTP head."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def records(uri: str, step: int = 1 << 20):
    """(offset, fields, payload) of each record of an archive, read as a stream."""
    with open_input(uri) as f:
        size, at, begin = f.size(), 0, 0
        z, out, data = zlib.decompressobj(31), io.BytesIO(), b""
        while True:
            if not data:
                if at >= size:
                    break
                data = f.read(min(step, size - at))
                at += len(data)
            out.write(z.decompress(data))
            data = z.unused_data if z.eof else b""
            if z.eof:
                yield begin, *parse(out.getvalue())
                begin = at - len(data)
                z, out = zlib.decompressobj(31), io.BytesIO()
        if out.getvalue():
            raise ValueError(f"{uri} ends inside a record")


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record for each row; (url_key, page_id, uri, offset, length, record_type, digest, payload_bytes) of each."""
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                    F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).alias("payload"))
    src = src.withColumn("hash", F.concat_ws("-", F.sha1(F.col("payload").cast("binary")), F.octet_length("payload")))
    groups = (src.groupBy("hash").agg(F.min("page_id").alias("low"), F.min_by("url", "page_id").alias("low_url"), F.count("*").alias("n"))
              .where("n > 1").select("hash", "low", "low_url"))
    groups = materialise(groups, "warc-groups")
    # The groups are a written table, so a payload that a third of the pages share is a skewed join that AQE splits.
    met = src.join(groups, "hash", "left").select("page_id", "url", "payload", "low", "low_url")

    def run(batches):
        out, part = None, TaskContext.get().partitionId()
        for pdf in batches:
            rows = []
            for page, url, payload, low, low_url in pdf.astype({"page_id": "Int64", "low": "Int64"}).itertuples(index=False):
                page, low = (None if x is pd.NA else int(x) for x in (page, low))
                data, target = encode_text(payload), safe_uri(url, page)
                digest = base32_sha1(data)
                refers = None if low is None or page == low else low
                packed = record(page, target, data, digest, refers, safe_uri(low_url, low))
                if out is None:
                    out = TaskFile(folder, f"part-{part:06d}", ".warc.gz")
                    uri = out.uri
                rows.append((capture_key(target, DATE, page), page, uri, out.write(packed), len(packed), "response" if refers is None else "revisit", digest, len(data)))
                if out.size >= ROLL_BYTES:
                    out.close()
                    out = None
            yield _frame(rows)
        if out is not None:
            out.close()

    return materialise(met.mapInPandas(run, CAPTURES), "warc-captures")


def _frame(rows) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in CAPTURES.split(", ")])
    return out.astype({"page_id": "Int64"})


def build_index(captures: DataFrame, folder: str, shards: int = INDEX_SHARDS, block: int = INDEX_BLOCK) -> DataFrame:
    """Writes the sorted capture index; (first_key, index_uri, directory_uri) of each shard."""
    ranged = captures.select("url_key", "page_id", "uri", "offset", "length").repartitionByRange(shards, "url_key", "uri", "offset").sortWithinPartitions("url_key", "uri", "offset")

    def run(batches):
        index, lines, directory, part = None, [], [], TaskContext.get().partitionId()

        def flush():
            keys = lines[0][0]
            data = zlib.compressobj(6, zlib.DEFLATED, 31)
            packed = data.compress("".join(f"{k}\t{v}\n" for k, v in lines).encode("utf-8", "surrogatepass")) + data.flush()
            directory.append((keys, index.write(packed), len(packed)))
            lines.clear()

        for pdf in batches:
            for key, _, uri, offset, length in pdf.itertuples(index=False):
                if index is None:
                    index = TaskFile(folder, f"index-{part:06d}", ".cdx.gz")
                lines.append((key.replace("\t", "%09").replace("\n", "%0A"), json.dumps([uri, offset, length])))
                if len(lines) == block:
                    flush()
        if index is not None:
            if lines:
                flush()
            index.close()
            sparse = TaskFile(folder, f"index-{part:06d}", ".dir")
            sparse.write("".join(f"{k}\t{o}\t{n}\n" for k, o, n in directory).encode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"first_key": [directory[0][0]], "index_uri": [index.uri], "directory_uri": [sparse.close()]})

    return materialise(ranged.mapInPandas(run, "first_key string, index_uri string, directory_uri string"), "warc-index")


class CaptureIndex:
    """Lookups in a capture index; keeps the directories, blocks and open files that it used last."""

    def __init__(self, shards: list[tuple[str, str, str]], keep: int = 32):
        self.shards = sorted(shards)
        self.firsts = [s[0] for s in self.shards]
        self.kept: OrderedDict = OrderedDict()
        self.keep = keep

    def _cached(self, key, make):
        if key in self.kept:
            self.kept.move_to_end(key)
        else:
            self.kept[key] = make()
            if len(self.kept) > self.keep:
                self.kept.popitem(last=False)
        return self.kept[key]

    def _directory(self, i: int):
        def make():
            with open_input(self.shards[i][2]) as f:
                rows = [line.split("\t") for line in f.read().decode("utf-8", "surrogatepass").split("\n")[:-1]]
            return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]

        return self._cached(("d", i), make)

    def _block(self, i: int, j: int) -> list[list[str]]:
        def make():
            offset, length = self._directory(i)[1][j]
            raw = zlib.decompress(read_range(self._open(self.shards[i][1]), offset, length), 31)
            return [line.split("\t", 1) for line in raw.decode("utf-8", "surrogatepass").split("\n")[:-1]]

        return self._cached(("b", i, j), make)

    def _open(self, uri: str):
        return self._cached(("f", uri), lambda: open_input(uri))

    def find(self, prefix: str):
        """(key, uri, offset, length) of all captures whose key starts with the prefix."""
        i = max(bisect.bisect_left(self.firsts, prefix) - 1, 0)
        first = True
        for i in range(i, len(self.shards)):
            keys, _ = self._directory(i)
            j = max(bisect.bisect_left(keys, prefix) - 1, 0) if first else 0
            first = False
            for j in range(j, len(keys)):
                lines = self._block(i, j)
                for k in range(bisect.bisect_left(lines, prefix, key=lambda x: x[0]), len(lines)):
                    if not lines[k][0].startswith(prefix):
                        return
                    yield lines[k][0], *json.loads(lines[k][1])

    def read(self, uri: str, offset: int, length: int) -> tuple[dict, bytes]:
        """The record at a place, by one range read."""
        return parse(zlib.decompress(read_range(self._open(uri), offset, length), 31))


def shard_list(index: DataFrame) -> list[tuple[str, str, str]]:
    """At most INDEX_SHARDS rows."""
    return [tuple(r) for r in index.select("first_key", "index_uri", "directory_uri").collect()]


def look_up(urls: DataFrame, index: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, page_id, record_type, payload) of every capture of the given URLs; a revisit has no payload of its own."""
    shards = shard_list(index)
    src = urls.select(F.col(f"`{url_col}`").cast("string").alias("url")).where("url is not null").distinct()

    def run(batches):
        caps = CaptureIndex(shards)
        for pdf in batches:
            rows = []
            for url in pdf["url"]:
                for _, uri, offset, length in caps.find(url_key(safe_uri(url, None)) + " "):
                    fields, payload = caps.read(uri, offset, length)
                    page = fields["WARC-Page-ID"]
                    rows.append((url, int(page) if page else None, fields["WARC-Type"], payload if fields["WARC-Type"] == "response" else None))
            yield pd.DataFrame(rows, columns=["url", "page_id", "record_type", "payload"]).astype({"page_id": "Int64"})

    return src.mapInPandas(run, "url string, page_id long, record_type string, payload binary")


def read_archives(captures: DataFrame, index: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest) of every record, from the archives alone.

    Size and digest are those of the full payload that was read; for a revisit that of its response, found by the index.
    """
    shards = shard_list(index)
    files = spread(captures.select("uri").distinct(), "uri")

    def run(batches):
        caps, known = CaptureIndex(shards), OrderedDict()

        def response(fields):
            key = capture_key(fields["WARC-Refers-To-Target-URI"], fields["WARC-Refers-To-Date"], int(fields["WARC-Refers-To-Page-ID"]))
            if key not in known:
                found = [x for x in caps.find(key) if x[0] == key]
                if not found:
                    raise ValueError(f"no capture {key}")
                payload = caps.read(*found[0][1:])[1]
                known[key] = (len(payload), base32_sha1(payload))
                if len(known) > 10_000:
                    known.popitem(last=False)
            return known[key]

        for pdf in batches:
            for uri in pdf["uri"]:
                rows = []
                for _, fields, payload in records(uri):
                    page, kind = fields["WARC-Page-ID"], fields["WARC-Type"]
                    n, digest = (len(payload), base32_sha1(payload)) if kind == "response" else response(fields)
                    if fields["WARC-Payload-Digest"] != f"sha1:{digest}":
                        raise ValueError(f"{uri}: the payload of page {page} has another digest")
                    rows.append((int(page) if page else None, fields["WARC-Target-URI"], kind, int(fields["WARC-Refers-To-Page-ID"]) if kind == "revisit" else None, n, digest))
                    if len(rows) == 10_000:
                        yield _read_frame(rows)
                        rows = []
                yield _read_frame(rows)

    return files.mapInPandas(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string")


def _read_frame(rows) -> pd.DataFrame:
    return (pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"])
            .astype({"page_id": "Int64", "refers_to": "Int64"}))


def archive_round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None) -> DataFrame:
    """Writes df to archives, indexes them and reads them back."""
    folder = folder or shared_path(df.sparkSession, "warc")
    captures = write_archives(df, folder + "/archive", id_col, url_col, payload_col)
    return read_archives(captures, build_index(captures, folder + "/index"))
