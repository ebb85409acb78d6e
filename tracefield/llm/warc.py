"""WARC archives of pages, and their index as an external merge of sorted runs.

Tasks write records (one gzip member each) to archives of bounded size; a
payload that occurs again is a revisit of the capture with the largest id.
Indexing reads the archives back, one at a time: the captures of one archive,
sorted by URL key and time, are one run. Samples of all runs give splitters;
runs are cut at these into segments, which alone are shuffled, and each range
is merged from its segments by a loser tree. Ranges follow each other in order,
so the index is the ordered capture history of every URL.

Archives are named by attempt; only those that finished tasks report count.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefield.llm.common import continued, partitions
from tracefield.llm.learn import MAX_BROADCAST
from tracefield.llm.token_files import open_uri
from tracefield.session import checkpoint, work_dir

#: an archive, and so a run of the index, ends after this many records or compressed bytes
MAX_RECORDS, MAX_BYTES = 1 << 16, 1 << 28
#: every so many entries of a run are sampled for the splitters
SAMPLE = 64
#: index entries that one merge task holds (about), and ranges at most; more ranges' worth of rows make ranges longer
RANGE_ROWS, MAX_RANGES = 200_000, 4096
READ = 1 << 20

ENTRY = [
    ("url_key", "string"), ("captured", "long"), ("archive", "string"), ("offset", "long"), ("length", "long"), ("url", "string"),
    ("page_id", "string"), ("payload_bytes", "long"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "string"),
]
KEY = ["url_key", "captured", "archive", "offset"]
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def url_key(url: str | None) -> str:
    """Sort key of a URL: host from the top-level domain down, then port, path and query; no scheme, user or fragment."""
    if not url:
        return ""
    rest = url.partition("#")[0].partition("://")[2] or url
    at = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, _, port = rest[:at].rpartition("@")[2].lower().partition(":")
    port = "" if port in ("", "80", "443") else ":" + port
    return ",".join(reversed(host.split("."))) + port + ")" + (rest[at:] if rest[at : at + 1] == "/" else "/" + rest[at:])


def capture_id(page_id: str | None, digest: str) -> str:
    """Record id; ``-`` stands for a null page id."""
    return f"<urn:capture:{'-' if page_id is None else page_id}:{digest}>"


def page_of(record_id: str) -> str | None:
    page = record_id[len("<urn:capture:") : -1].rpartition(":")[0]
    return None if page == "-" else page


def record(page_id: str | None, url: str | None, html: str | None, seconds: int | None, digest: bytes, refers_to: str | None) -> bytes:
    """One WARC record; a revisit (``refers_to`` given) keeps the HTTP head, with the payload's length, and no payload."""
    payload = (html or "").encode()
    name = base64.b32encode(digest).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", capture_id(page_id, name)),
        ("WARC-Date", datetime.fromtimestamp(seconds or 0, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Payload-Digest", f"sha1:{name}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", capture_id(refers_to, name)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    block = head + payload if refers_to is None else head
    fields.append(("Content-Length", len(block)))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record: url, captured, page_id, payload_bytes, payload_digest, record_type, refers_to, payload.

    The payload of a response is checked against its digest.
    """
    at = raw.index(b"\r\n\r\n")
    lines = raw[:at].decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = raw[at + 4 : at + 4 + int(fields["Content-Length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != int(http["Content-Length"]) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']} does not fit its digest")
    return {
        "url": fields.get("WARC-Target-URI"), "captured": int(datetime.fromisoformat(fields["WARC-Date"]).timestamp()), "page_id": page_of(fields["WARC-Record-ID"]),
        "payload_bytes": int(http["Content-Length"]), "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": None if response else page_of(fields["WARC-Refers-To"]), "payload": payload if response else None,
    }


def members(file) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed length, content) of each gzip member of an open file, one at a time."""
    offset, data = 0, b""
    while True:
        data = data or file.read(READ)
        if not data:
            return
        unpack, content, size = zlib.decompressobj(31), [], 0
        while True:
            content.append(unpack.decompress(data))
            size += len(data) - len(unpack.unused_data)
            data = unpack.unused_data
            if unpack.eof:
                break
            data = file.read(READ)
            if not data:
                raise ValueError("archive ends within a record")
        yield offset, size, b"".join(content)
        offset += size


def revisits(ids: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, digest, best) of the captures that revisit another: equal payloads, not the largest page_id.

    Payloads held by over rows / (4 * partitions) captures are fewer than 4 *
    partitions, so they may be broadcast; no other is a hot key of the join.
    """
    known = F.col("page_id")
    groups = ids.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max(known).alias("best"), F.min(known).alias("least"), F.count(known).alias("some"), F.count(F.lit(1)).alias("n"))
    groups = checkpoint(groups.filter("best is not null and (least <> best or some < n)").select("digest", "best", "n"))
    limit = max(1, ids.count() // (4 * partitions(ids.sparkSession)))
    ids = ids.select("page_id", "digest")
    marked = ids.join(F.broadcast(groups.filter(F.col("n") > limit).drop("n")), "digest", "left")
    light = marked.filter("best is null").drop("best").join(groups.filter(F.col("n") <= limit).drop("n"), "digest")
    both = marked.filter("best is not null").unionByName(light)
    return checkpoint(both.filter("page_id is null or page_id < best").distinct())


def write_archives(pages: DataFrame, folder: str, captured: Column | None = None, min_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); the manifest (archive, records, bytes) of what counts.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with
    the largest page_id is the response, the others are revisits of it; rows
    that share that page_id and payload are responses each; null ids are less
    than all others, and responses if no other has their payload. Null html is
    an empty payload, a null url is left out. ``captured``: capture time, the
    epoch if null. Other columns are ignored; an empty table writes nothing.
    """
    target = folder.rstrip("/")
    digest = F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    seconds = F.lit(0).cast("long") if captured is None else F.unix_seconds(captured)
    ids = checkpoint(pages.select("page_id", digest.alias("digest"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes")))
    again = revisits(ids, min_bytes).select(F.col("digest").alias("_digest"), F.col("page_id").alias("_page"), "best")
    again = F.broadcast(again) if again.count() <= MAX_BROADCAST else again
    rows = pages.select("page_id", "url", "html", seconds.alias("seconds"), digest.alias("digest"))
    rows = rows.join(again, (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_page")), "left")
    text = lambda c: F.col(c).cast("string").alias(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None

        def close() -> pa.RecordBatch:
            out["file"].close()
            return pa.RecordBatch.from_arrays([pa.array([out["path"]]), pa.array([out["records"]], pa.int64()), pa.array([out["bytes"]], pa.int64())], ["archive", "records", "bytes"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    path = f"{target}/capture-{uuid.uuid4().hex}.warc.gz"
                    out = {"path": path, "file": open_uri(path, "w"), "records": 0, "bytes": 0}
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = pack.compress(record(*row)) + pack.flush()
                out["file"].write(raw)
                out["records"] += 1
                out["bytes"] += len(raw)
                if out["records"] >= MAX_RECORDS or out["bytes"] >= MAX_BYTES:
                    yield close()
                    out = None
        if out:
            yield close()

    rows = rows.select(text("page_id"), "url", "html", "seconds", "digest", text("best"))
    return checkpoint(rows.mapInArrow(run, "archive string, records long, bytes long"))


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Captures of archives, read whole and in order within each: the columns of ENTRY and, if asked for, the payload."""
    names = [n for n, _ in ENTRY] + (["payload"] if payloads else [])
    kinds = [_ARROW[t] for _, t in ENTRY] + ([pa.binary()] if payloads else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column("archive").to_pylist():
                with open_uri(archive, "r") as file:
                    rows, size = [], 0
                    for offset, length, raw in members(file):
                        got = parse(raw)
                        rows.append(got | {"url_key": url_key(got["url"]), "archive": archive, "offset": offset, "length": length})
                        size += len(raw) if payloads else 256
                        if size > READ:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    schema = ", ".join(f"`{n}` {t}" for n, t in ENTRY) + (", payload binary" if payloads else "")
    return _by_archive(manifest).mapInArrow(run, schema)


def _by_archive(manifest: DataFrame) -> DataFrame:
    return manifest.select("archive").repartition(max(1, 2 * manifest.sparkSession.sparkContext.defaultParallelism), "archive")


class LoserTree:
    """K-way merge of sorted streams: each inner node keeps the loser of its match, the root the winner.

    ``keys`` holds each stream's next key, None if it is exhausted. A step
    replays only the matches on the winner's way up.
    """

    def __init__(self, keys: list):
        self.keys, self.n = keys, len(keys)
        self.loser = [-1] * self.n
        self.winner = -1
        for i in range(self.n):
            self._play(i, True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return x is not None and (y is None or x < y)

    def _play(self, stream: int, building: bool = False):
        winner, node = stream, (stream + self.n) // 2
        while node > 0:
            other = self.loser[node]
            if other < 0 and building:
                self.loser[node] = winner
                return
            if self._beats(other, winner):
                self.loser[node], winner = winner, other
            node //= 2
        self.winner = winner

    def replace(self, key):
        """The winner's stream went on to ``key`` (None: it is exhausted)."""
        self.keys[self.winner] = key
        self._play(self.winner)


def merge(segments: list[list]) -> Iterator[tuple[int, int]]:
    """(segment, place in it) of all keys of sorted segments in global order."""
    if not segments:
        return
    at = [0] * len(segments)
    tree = LoserTree([s[0] if s else None for s in segments])
    while tree.keys[tree.winner] is not None:
        w = tree.winner
        yield w, at[w]
        at[w] += 1
        tree.replace(segments[w][at[w]] if at[w] < len(segments[w]) else None)


def sorted_runs(manifest: DataFrame) -> DataFrame:
    """ENTRY and ``seq``: the captures of each archive in order of KEY, one run per archive (MAX_RECORDS rows at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [n for n, _ in ENTRY]
        for b in batches:
            for archive in b.column("archive").to_pylist():
                rows = []
                with open_uri(archive, "r") as file:
                    for offset, length, raw in members(file):
                        got = parse(raw)
                        got.pop("payload")
                        rows.append(got | {"url_key": url_key(got["url"]), "archive": archive, "offset": offset, "length": length})
                rows.sort(key=lambda r: (r["url_key"], r["captured"], r["archive"], r["offset"]))
                columns = [pa.array([r[n] for r in rows], _ARROW[t]) for n, t in ENTRY]
                whole = pa.RecordBatch.from_arrays([*columns, pa.array(range(len(rows)), pa.int64())], [*names, "seq"])
                for i in range(0, len(whole), 8192):
                    yield whole.slice(i, 8192)

    return checkpoint(_by_archive(manifest).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in ENTRY) + ", seq long"))


def splitters(runs: DataFrame) -> list[tuple]:
    """Keys that cut the runs into ranges of about RANGE_ROWS entries, MAX_RANGES at most, from every SAMPLE-th entry of each run."""
    ranges = min(MAX_RANGES, -(-runs.count() // RANGE_ROWS))
    if ranges < 2:
        return []
    samples = runs.filter(F.col("seq") % SAMPLE == 0).select(*KEY).repartitionByRange(ranges, *KEY)
    lows = samples.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*KEY)).alias("low")).collect()
    return sorted(tuple(r["low"]) for r in lows)[1:]


def merged_index(manifest: DataFrame) -> DataFrame:
    """ENTRY with ``range``, ``position`` (order within the range) and ``nth`` (capture of its URL key, from 0).

    Ordered by (range, position) it is sorted by KEY as a whole.
    """
    runs = sorted_runs(manifest)
    cuts = splitters(runs)
    names = [n for n, _ in ENTRY]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments: rows of one run and range that follow each other, as lists."""
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in KEY), strict=True))
            place = np.fromiter((bisect_right(cuts, k) for k in keys), np.int32, len(keys))
            seq = b.column("seq").to_numpy()
            archive = b.column("archive").dictionary_encode().indices.to_numpy()
            new = np.ones(len(keys), bool)
            new[1:] = (place[1:] != place[:-1]) | (archive[1:] != archive[:-1]) | (seq[1:] != seq[:-1] + 1)
            starts = np.flatnonzero(new)
            offsets = pa.array(np.append(starts, len(keys)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, b.column(n)) for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(place[starts]), *lists], ["range", *names])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches]
        if not tables:
            return
        table = pa.concat_tables(tables).combine_chunks()
        for number in sorted(set(table.column("range").to_pylist())):
            part = table.filter(pc.equal(table.column("range"), number)).combine_chunks()
            flat = pa.table([part.column(n).combine_chunks().flatten() for n in names], names=names)
            sizes = pc.list_value_length(part.column("url_key")).to_pylist()
            keys = list(zip(*(flat.column(k).to_pylist() for k in KEY), strict=True))
            ends = np.cumsum([0, *sizes]).tolist()
            segments = [keys[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]
            order = [ends[s] + i for s, i in merge(segments)]
            out = flat.take(pa.array(order, pa.int64()))
            nth, now, n = [], None, 0
            for k in order:
                n = n + 1 if keys[k][0] == now else 0
                now = keys[k][0]
                nth.append(n)
            out = out.append_column("range", pa.array([number] * len(order), pa.int32())).append_column("position", pa.array(range(len(order)), pa.int64())).append_column("nth", pa.array(nth, pa.int64()))
            yield from out.to_batches(8192)

    lists = ", ".join(f"`{n}` array<{t}>" for n, t in ENTRY)
    segments = runs.mapInArrow(cut, f"range int, {lists}").repartitionById(len(cuts) + 1, F.col("range"))
    schema = ", ".join(f"`{n}` {t}" for n, t in ENTRY) + ", range int, position long, nth long"
    return continued(checkpoint(segments.mapInArrow(join, schema)), "url_key", "range", "nth")


def history(index: DataFrame, url: str) -> DataFrame:
    """Captures of one URL, oldest first; files of the index without its key are pruned by their statistics."""
    return index.filter(F.col("url_key") == url_key(url)).orderBy("nth")


def capture_folder(spark) -> str:
    """A new folder on the shared storage."""
    return f"{work_dir(spark)}/captures-{uuid.uuid4().hex}"
