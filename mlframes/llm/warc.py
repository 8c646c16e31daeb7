"""Web archives: a deterministic sharded writer with manifests, and the reader of what it wrote."""

import gzip
import hashlib
import posixpath
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mlframes.llm.common import column, saved, text_column
from mlframes.plans.storage import shared_path

#: Compressed bytes at which a file ends, bytes of payload that a shard has about, and the least number of shards.
FILE_BYTES, SHARD_BYTES, LEAST_SHARDS = 64 << 20, 1 << 30, 256
#: Payloads shorter than this are written out again rather than referred to.
LEAST_REVISIT = 100
#: Date of every record: archives of equal input are equal.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}')}>"


def one_line(text: str | None) -> str:
    """A header's value: control characters and white space escaped."""
    return quote(text or "", safe="".join(chr(c) for c in range(33, 127) if chr(c) != "%") + "%")


def record(page: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit has the headers of its answer but no payload."""
    digest = hashlib.sha256(payload).hexdigest()
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    if refers_to is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, digest)}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {one_line(url)}", "Content-Type: application/http; msgtype=response",
            f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-Payload-Digest: sha256:{digest}",
            f"Page-ID: {page}", f"Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def filesystem(uri: str):
    """(file system, path) of a folder that every executor reaches."""
    from pyarrow.fs import FileSystem, LocalFileSystem
    if "://" in uri or uri.startswith("file:"):
        return FileSystem.from_uri(uri)
    return LocalFileSystem(), uri


def _write(root: str, file_bytes: int):
    """Roll files from sorted rows: marks that name what a page's payload refers to stand before the page itself. Files go to temporary names; the rows say what is where."""
    def run(batches):
        fs, base = filesystem(root)
        folder = posixpath.join(base, "_temporary")
        fs.create_dir(folder, recursive=True)
        state = {"shard": None, "number": 0, "sink": None}

        def close():
            if state["sink"] is None:
                return []
            state["sink"].close()
            row = [state["temporary"], f"pages-{state['shard']:08d}-{state['number']:05d}.warc.gz", state["size"], state["records"], state["sum"].hexdigest()]
            state["sink"] = None
            state["number"] += 1
            return [row]

        def rows():
            here, known = None, {}
            for batch in batches:
                for shard, page, url, html, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(6))):
                    if page != here:
                        here, known = page, {}
                    if digest is not None:  # a mark: what this page's payload of that digest refers to
                        known[digest] = refers
                        continue
                    if shard != state["shard"]:
                        yield from close()
                        state.update(shard=shard, number=0)
                    payload = html.encode("utf-8", "surrogatepass")
                    own = hashlib.sha256(payload).hexdigest() if len(payload) >= LEAST_REVISIT else None
                    data = record(page, url, payload, known.get(own))
                    if own is not None:
                        known.setdefault(own, page)
                    if state["sink"] is not None and state["size"] + len(data) > file_bytes:
                        yield from close()
                    if state["sink"] is None:
                        name = posixpath.join(folder, uuid.uuid4().hex)
                        state.update(sink=fs.open_output_stream(name, compression=None), temporary=name, size=0, records=0, sum=hashlib.sha256())
                    state["sink"].write(data)
                    state["sum"].update(data)
                    state["size"] += len(data)
                    state["records"] += 1
            yield from close()
        for row in rows():
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names="temporary file bytes records sha256".split())
    return run


def _commit(root: str):
    """Give files their names. A repeated task finds them named already."""
    def run(batches):
        from pyarrow.fs import FileType
        fs, base = filesystem(root)
        for batch in batches:
            for temporary, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = posixpath.join(base, name)
                if fs.get_file_info(temporary).type == FileType.File:
                    fs.move(temporary, target)
                elif fs.get_file_info(target).type != FileType.File:
                    raise FileNotFoundError(target)
            yield batch.select(["file", "bytes", "records", "sha256"])
    return run


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """Write one record per row under ``root`` and return the manifest (file, bytes, records, sha256).

    A shard is a range of ids as wide as ``shard_bytes`` of payload need, the same for equal tables whatever their
    partitions; its records are sorted by id and rolled into files of ``file_bytes`` compressed bytes. Of equal
    payloads of ``LEAST_REVISIT`` bytes or more the smallest id (then url) is the response and the others revisit it.
    What a page refers to comes to it as a row sorted before it, so payloads are shuffled once.

    Files are written under temporary names; the list of those whose task succeeded is saved, they are renamed, and the
    manifest, written last, names the archive's files. A lost task leaves a temporary file that no manifest names.

    A null html is an empty payload and a null url an empty one. Equal rows are a record each. A null id is refused.
    """
    rows = pages.select(column(id_col).cast("long").alias("page"), column(url_col).cast("string").alias("url"),
                        text_column(html_col).alias("html"))
    size = F.octet_length("html")
    bounds = rows.select(F.min("page"), F.max("page"), F.sum(size.cast("long")), F.count(F.when(F.col("page").isNull(), 1))).first()
    if bounds[3]:
        raise ValueError("a page has no id")
    low, high, total = (bounds[0] or 0), (bounds[1] or 0), (bounds[2] or 0)
    width = max(1, -(-(high - low + 1) // max(least_shards, -(-total // shard_bytes))))
    digests = rows.where(size >= LEAST_REVISIT).select("page", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    digests = saved(digests, "digests")
    repeated = digests.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1")
    marks = digests.join(repeated, "digest").where("page <> first").select("page", "digest", F.col("first").alias("refers")).distinct()
    both = marks.unionByName(rows, allowMissingColumns=True)
    shard = F.expr(f"(cast(page as decimal(38)) - cast('{low}' as decimal(38))) div cast('{width}' as decimal(38))")
    dealt = (both.withColumn("shard", shard).repartitionByRange("shard")
             .sortWithinPartitions("shard", "page", F.col("digest").desc(), "url", "html"))
    schema = "temporary string, file string, bytes long, records long, sha256 string"
    staged = saved(dealt.select("shard", "page", "url", "html", "digest", "refers").mapInArrow(_write(root, file_bytes), schema), "staged")
    named = staged.mapInArrow(_commit(root), "file string, bytes long, records long, sha256 string")
    named.write.parquet(posixpath.join(root, "manifest"))
    return pages.sparkSession.read.schema(named.schema).parquet(posixpath.join(root, "manifest"))


def members(stream, step: int = 1 << 20):
    """The gzip members of a stream, decompressed one by one."""
    unzip, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(step)
        rest = b""
        if not data:
            if any(parts):
                raise ValueError("the archive ends within a record")
            return
        parts.append(unzip.decompress(data))
        if unzip.eof:
            rest = unzip.unused_data
            yield b"".join(parts)
            unzip, parts = zlib.decompressobj(31), []


def parse(data: bytes) -> tuple[dict, bytes]:
    """Headers and block of a record, both checked against its length and digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    headers = {name.lower(): value for name, _, value in (x.partition(": ") for x in lines)}
    block = rest[:int(headers["content-length"])]
    if version != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n" or len(block) != int(headers["content-length"]):
        raise ValueError("not a record")
    if headers["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError(f"block digest of {headers['warc-record-id']}")
    return headers, block


def read_archives(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to) of the records in the files that the
    manifest names. Digests and lengths are computed from what a response holds, and checked against its headers; a
    revisit's are its headers'."""
    schema = ("page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, "
              "refers_to long")

    def rows(fs, base, name):
        with fs.open_input_stream(posixpath.join(base, name), compression=None) as stream:
            for data in members(stream):
                headers, block = parse(data)
                kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
                length, refers, payload = int(headers["payload-length"]), headers.get("refers-to-page-id"), None
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, length):
                        raise ValueError(f"payload of {headers['warc-record-id']}")
                yield (int(headers["page-id"]), headers["warc-target-uri"], kind, payload, length, digest, int(refers) if refers else None)

    types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        fs, base = filesystem(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(fs, base, name):
                    held.append(row)
                    size += len(row[3] or b"") + 200
                    if size > 8 << 20:
                        yield table(held)
                        held, size = [], 0
                if held:
                    yield table(held)

    def table(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=[x.split()[0] for x in schema.split(", ")])

    files = max(1, min(manifest.count(), 10_000))
    return manifest.select("file").repartition(files, "file").mapInArrow(run, schema)


def archive_report(pages: DataFrame, **options) -> DataFrame:
    """Write the pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    root = shared_path(spark, "archive")
    back = read_archives(spark, root, write_archives(pages, root, **options))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
