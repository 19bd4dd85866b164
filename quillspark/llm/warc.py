"""WARC archives of pages, and one capture index merged from sorted runs."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from .common import pieces, stored

INDEX = pa.schema([("url_key", pa.string()), ("captured", pa.string()), ("page", pa.string()),
                   ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
                   ("record_type", pa.string())])
INDEX_DDL = ("url_key string, captured string, page string, archive string, offset long, "
             "length long, record_type string")
GROUP_ROWS = 512  # rows of a run that a merge holds at a time


def url_key(url: str | None) -> str:
    """Host reversed and comma-separated, then path and query in lower case: equal for a page's
    spellings. Scheme, ``www.``, default ports and the fragment are left out; null is empty."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return (url or "").strip().lower()
    turned = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{turned}){parts.path.rstrip('/') or '/'}{query}".lower()


def record(kind: str, page: str, url: str | None, when: str, payload: bytes, digest: bytes,
           refers_to: str | None) -> bytes:
    """One record, uncompressed. A revisit holds the HTTP header alone, as WARC 1.1 allows."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
            b"Content-Length: %d\r\n\r\n" % len(payload))
    body = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {when}",
             "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or ""),
             "WARC-Payload-Digest: sha1:" + base64.b32encode(digest).decode()]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


@lru_cache(maxsize=8)
def _store(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(folder)


@dataclass(frozen=True)
class Archives:
    folder: str
    manifest: DataFrame  # archive, run, records, keys: one row per archive


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", date_col: str | None = None, least: int = 1000) -> Archives:
    """A record per row, one archive and one sorted index run per task, in the shared folder.

    Of payloads that are equal and have ``least`` bytes or more, the row with the largest id is
    a response and the others revisit it; smaller ones are responses all. Null html is an empty
    payload, null url an empty URI; of repeated rows with the largest id each is a response; a
    null id never is the largest. Without ``date_col`` (a timestamp) a capture is
    dated by its id, in seconds. Files carry a fresh name per attempt and only those that the
    stored manifest names count, so a lost executor leaves at most an unread file.
    """
    folder = scratch_dir(pages.sparkSession, "llm-warc")
    when = F.date_format(F.col(date_col) if date_col else F.timestamp_seconds(
        F.coalesce(F.pmod(F.col(id_col).cast("long"), F.lit(1 << 31)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), when.alias("when"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html"))
    heads = stored(rows.where(F.col("n") >= least).groupBy("sha", "n")
                   .agg(F.max("id").alias("head"), F.count("*").alias("_c")).where("_c > 1").drop("_c"), "warc-heads")
    # Both sides of this join are plain shuffles, so Spark can split a payload that very many share.
    joined = rows.where(F.col("n") >= least).join(heads, ["sha", "n"], "left").select(*rows.columns, "head")
    kind = rows.schema["id"].dataType.simpleString()
    joined = joined.unionAll(rows.where(F.col("n") < least).withColumn("head", F.lit(None).cast(kind)))
    revisit = F.col("head").isNotNull() & ~F.col("id").eqNullSafe(F.col("head"))
    out = joined.select(F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("page"), "url", "when", "html", "sha",
                        F.when(revisit, F.col("head").cast("string")).alias("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        name, at, index, sink = uuid.uuid4().hex, 0, [], None
        for batch in pieces(batches, "html"):
            if sink is None:
                store.create_dir(root, recursive=True)
                sink = store.open_output_stream(f"{root}/{name}.warc.gz", compression=None)
            for r in batch.to_pylist():
                kind = "response" if r["head"] is None else "revisit"
                raw = record(kind, r["page"], r["url"], r["when"], r["html"].encode(), bytes.fromhex(r["sha"]), r["head"])
                packer = zlib.compressobj(3, wbits=31)
                member = packer.compress(raw) + packer.flush()
                sink.write(member)
                index.append((url_key(r["url"]), r["when"], r["page"], f"{name}.warc.gz", at, len(member), kind))
                at += len(member)
        if sink is None:
            return
        sink.close()
        index.sort()
        table = pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*index), INDEX)], schema=INDEX)
        with store.open_output_stream(f"{root}/{name}.run") as f:
            pq.write_table(table, f, row_group_size=GROUP_ROWS)
        keys = [index[len(index) * k // 16][0] for k in range(16)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{name}.warc.gz"]), pa.array([f"{name}.run"]), pa.array([len(index)]), pa.array([keys])],
            ["archive", "run", "records", "keys"])

    manifest = out.mapInArrow(run, "archive string, run string, records long, keys array<string>")
    return Archives(folder, stored(manifest, "warc-manifest"))


class LoserTree:
    """K-way merge: inner nodes keep the loser of their match, so each step replays one path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.head = [next(r, None) for r in runs]
        self.tree = [-1] * self.k
        for leaf in range(self.k):
            self._replay(leaf)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a's head goes first; a finished run loses, a tie goes to the earlier run."""
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _replay(self, leaf: int) -> None:
        node, winner = (leaf + self.k) // 2, leaf
        while node > 0:
            if self.tree[node] == -1:
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.head[self.tree[0]] is not None:
            top = self.tree[0]
            yield self.head[top]
            self.head[top] = next(self.runs[top], None)
            self._replay(top)


def _slice(folder: str, files: list[str], low: str | None, high: str | None) -> Iterator[tuple]:
    """Rows of one run with low <= url_key < high, a row group in memory at a time."""
    store, root = _store(folder)
    for name in files:
        with store.open_input_file(f"{root}/{name}") as f:
            run = pq.ParquetFile(f)
            for g in range(run.num_row_groups):
                stats = run.metadata.row_group(g).column(0).statistics
                if stats is not None and stats.has_min_max and (
                        (high is not None and stats.min >= high) or (low is not None and stats.max < low)):
                    continue
                columns = [c.to_pylist() for c in run.read_row_group(g).columns]
                yield from (r for r in zip(*columns)
                            if (low is None or r[0] >= low) and (high is None or r[0] < high))


def merge_index(spark: SparkSession, archives: Archives, fan_in: int = 64,
                range_rows: int = 50_000) -> DataFrame:
    """All captures in one order: (range_no, seq, the index columns).

    Ordered by (range_no, seq) the rows are sorted by URL key, then time, then page. Each task
    merges one range of keys from up to ``fan_in`` runs with a loser tree and holds one row group
    per run; more runs are first merged to fewer, in passes. Only the manifest (a row with 16
    sample keys per archive) comes to the driver.
    """
    listed = archives.manifest.select("run", "records", "keys").orderBy("run").collect()
    folder, runs = archives.folder, [[r["run"]] for r in listed]
    samples = sorted(k for r in listed for k in r["keys"])
    n = max(1, min(len(samples), -(-sum(r["records"] for r in listed) // range_rows), 10_000))
    n = max(n, min(len(samples) or 1, spark.sparkContext.defaultParallelism))
    inner = sorted({samples[len(samples) * k // n] for k in range(1, n)})
    cuts = [None, *inner, None]

    def merged(group: list[list[str]], part: int) -> Iterator[tuple]:
        return iter(LoserTree([_slice(folder, files, cuts[part], cuts[part + 1]) for files in group]))

    ranges = len(cuts) - 1
    while len(runs) > fan_in:
        groups = [runs[a:a + fan_in] for a in range(0, len(runs), fan_in)]

        def one_pass(batches: Iterator[pa.RecordBatch], groups=groups) -> Iterator[pa.RecordBatch]:
            store, root = _store(folder)
            for batch in batches:
                for task in batch.column(0).to_pylist():
                    g, part = divmod(task, ranges)
                    name = f"{uuid.uuid4().hex}.run"
                    with store.open_output_stream(f"{root}/{name}") as f, pq.ParquetWriter(f, INDEX) as w:
                        for rows in _chunks(merged(groups[g], part), GROUP_ROWS):
                            w.write_batch(_batch(rows))
                    yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([part]), pa.array([name])], ["g", "part", "run"])

        tasks = len(groups) * ranges
        done = stored(spark.range(0, tasks, 1, tasks).mapInArrow(one_pass, "g long, part long, run string"), "warc-pass")
        runs = [[] for _ in groups]
        for r in done.orderBy("g", "part").collect():
            runs[r["g"]].append(r["run"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                seq = 0
                for rows in _chunks(merged(runs, part), 4096):
                    out = _batch(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(rows), pa.int64()), pa.array(range(seq, seq + len(rows)), pa.int64()), *out.columns],
                        ["range_no", "seq", *INDEX.names])
                    seq += len(rows)

    return spark.range(0, ranges, 1, ranges).mapInArrow(last, f"range_no long, seq long, {INDEX_DDL}")


def _chunks(rows: Iterator[tuple], n: int) -> Iterator[list[tuple]]:
    out: list[tuple] = []
    for r in rows:
        out.append(r)
        if len(out) == n:
            yield out
            out = []
    if out:
        yield out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), INDEX)], schema=INDEX)


def members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of an archive, one in memory at a time."""
    start, rest = 0, b""
    while True:
        rest = rest or stream.read(chunk)
        if not rest:
            return
        unpack, out, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not rest:
                raise ValueError(f"archive ends inside the record at {start}")
            out.append(unpack.decompress(rest))
            used += len(rest) - len(unpack.unused_data)
            rest = unpack.unused_data if unpack.eof else stream.read(chunk)
        yield start, b"".join(out)
        start += used


def parse(raw: bytes) -> dict:
    """Header fields and payload of one record; raises if the payload's digest is another."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = block[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    named = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == "response" and (hashlib.sha1(payload).digest() != named or len(payload) != size):
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    page = {k: fields[k][len("<urn:page:"):-1] if k in fields else None for k in ("WARC-Record-ID", "WARC-Refers-To")}
    return {"page": page["WARC-Record-ID"], "url": fields["WARC-Target-URI"], "captured": fields["WARC-Date"],
            "record_type": fields["WARC-Type"], "refers_to": page["WARC-Refers-To"],
            "payload_digest": named.hex(), "payload_bytes": size, "payload": payload}


def read_archives(spark: SparkSession, archives: Archives, payload: bool = False) -> DataFrame:
    """A row per record: archive, offset, page, url, captured, record_type, refers_to,
    payload_digest, payload_bytes, and the payload if asked. Each archive is streamed once."""
    names = [r["archive"] for r in archives.manifest.select("archive").orderBy("archive").collect()]
    folder, n = archives.folder, max(1, len(names))
    kinds = {"archive": pa.string(), "offset": pa.int64(), "page": pa.string(), "url": pa.string(), "captured": pa.string(),
             "record_type": pa.string(), "refers_to": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64()}
    if payload:
        kinds["payload"] = pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for name in [names[i] for i in batch.column(0).to_pylist() if i < len(names)]:
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    found = ((name, at, parse(raw)) for at, raw in members(f))
                    for rows in _chunks(({"archive": a, "offset": o, **r} for a, o, r in found), 200 if payload else 4096):
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))

    ddl = ", ".join(f"{k} {'long' if t == pa.int64() else t}" for k, t in kinds.items())
    return spark.range(0, n, 1, n).mapInArrow(run, ddl)


def capture_history(pages: DataFrame, **options) -> DataFrame:
    """Archives written, their index merged, every record read back and joined to its entry.

    One row per page: the index columns in global order (range_no, seq), with the payload's
    digest and size and the page revisited, as the archives have them.
    """
    spark = pages.sparkSession
    archives = write_archives(pages, **options)
    history = merge_index(spark, archives)
    read = read_archives(spark, archives).select("archive", "offset", "payload_digest", "payload_bytes", "refers_to")
    # Both sides come from one row per task, so their sizes are unknown to the planner: without
    # the hint it would broadcast a whole index.
    return history.hint("merge").join(read, ["archive", "offset"])
