"""WARC archives: writing, and reading by boundary-chain verification.

Archives are written by Spark's own text writer, so a file appears only when
its task commits, in any file system Spark knows.  They are read back in byte
ranges: a task splits its range at the version line and emits, for every such
candidate, the offset its Content-Length leads to.  Version lines also occur
inside payloads; only candidates reachable from a file's start are records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchkeep.llm.common import shared_path, store

# Fixed values of the format.
VERSION = "WARC/1.0\r\n"
BLANK, END = "\r\n\r\n", "\r\n\r\n"
DIGITS32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """SHA-1 in base 32: every 5 hexadecimal digits are 4 digits of base 32."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), DIGITS32, BASE32)


def _header(name: str, value: Column) -> Column:
    """One header line; absent if the value is null.  Line ends in values are escaped."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def write_archives(pages: DataFrame, path: str, smallest: int = 0) -> None:
    """One record per row of ``pages`` (page_id, url, html).

    Of the pages whose payloads are equal and at least ``smallest`` bytes, that
    with the largest page_id is the response; the others are revisits without a
    payload that name it.  Repeated rows of that page_id are all responses.  A
    null html is an empty payload; rows with a null page_id are responses; an
    empty table makes an archive without records; other columns are not read.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
        F.octet_length(payload).alias("bytes"), sha1_base32(payload.cast("binary")).alias("digest"),
    )
    # Digests combine before the shuffle.  Those of several pages are a table of
    # their own: its size is then known, and where it is small no payload is
    # shuffled; else adaptive execution splits a hot digest in the join.
    newest = rows.where(F.col("bytes") >= smallest).groupBy("digest", "bytes").agg(
        F.max("page_id").alias("original"), F.min("page_id").alias("least"))
    newest = store(newest.where("least < original").drop("least"), "warc-copies")
    joined = rows.join(newest, ["digest", "bytes"], "left")
    revisit = F.col("page_id") < F.col("original")
    identity = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        F.lit(VERSION),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", identity(F.coalesce(F.col("page_id").cast("string"), F.lit("null")))),
        _header("Content-Length", F.octet_length(body)),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Payload-Length", F.col("bytes")),
        _header("WARC-Refers-To", F.when(revisit, identity(F.col("original")))),
        _header("WARC-Target-URI", F.col("url")),
        F.lit("\r\n"), body,
    )
    joined.select(record.alias("value")).write.option("lineSep", END).text(path)


def version_pieces(spark, path: str) -> DataFrame:
    """What follows every version line: (file, block, order, length, header, content, body, bytes, digest).

    ``content`` is the stated length, ``bytes`` and ``digest`` are those of the
    payload as far as this piece holds it.  The text reader keeps bytes as they
    are and reads a file in byte ranges, in order.
    """
    pieces = spark.read.option("lineSep", VERSION).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("order"), F.octet_length("value").cast("long").alias("length"),
        F.substring_index("value", BLANK, 1).alias("header"), F.col("value").cast("binary").alias("raw"),
    )
    head_bytes = F.octet_length("header") + len(BLANK)
    complete = F.octet_length("header") < F.col("length")
    stated = F.regexp_extract("header", r"(?:^|\r\n)(?i:Content-Length): *([0-9]{1,18})(?:\r\n|$)", 1)
    body = F.when(complete, F.substring("raw", head_bytes + 1, F.octet_length("raw")))
    pieces = pieces.select(
        "file", "block", "order", "length", "header", F.when(complete & (stated != ""), stated.cast("long")).alias("content"), body.alias("body"))
    # A stated length may exceed what a position can be; no piece is that long.
    held = F.substring("body", F.lit(1), F.least(F.col("content"), F.octet_length("body")).cast("int"))
    return store(pieces.withColumn("bytes", F.octet_length(held).cast("long")).withColumn("digest", sha1_base32(held)), "warc-pieces")


def candidates(pieces: DataFrame) -> DataFrame:
    """Every version line of the archives: (file, block, order, offset, successor); no payload is moved."""
    width = len(VERSION)
    pieces = pieces.select("file", "block", "order", "length", "content", F.octet_length("header").alias("header_bytes"))
    within = Window.partitionBy("file", "block").orderBy("order")
    sums = pieces.groupBy("file", "block").agg(F.sum(F.col("length") + width).alias("total"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select("file", "block", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("begin"))
    # The piece before the first version line is no candidate; in an archive it is empty.
    until = F.sum(F.col("length") + width).over(within) - F.col("length") - width
    placed = pieces.withColumn("until", until).join(begins, ["file", "block"])
    offset = F.col("begin") + F.col("until") - width
    return placed.select(
        "file", "block", "order", offset.alias("offset"),
        (offset + width + F.col("header_bytes") + len(BLANK) + F.col("content") + len(END)).alias("successor"),
    ).where("offset >= 0")


def reachable(found: DataFrame) -> DataFrame:
    """(file, offset) of the candidates on the chain from each file's start.

    Neighbours whose successor is simply the next candidate form runs.  Runs
    are cut where another candidate's successor lands, so each is entered only
    at its head, and pointer jumping works on heads: it doubles its stride
    every round until no head is added.
    """
    nearby = Window.partitionBy("file", "block").orderBy("offset")
    linked = found.select("file", "block", "offset", "successor").withColumn(
        "next", F.lead("offset").over(nearby)).withColumn("previous", F.lag("successor").over(nearby))
    linked = store(linked.withColumn("jumps", ~F.coalesce(F.col("successor") == F.col("next"), F.lit(False))), "warc-links")
    landings = linked.where("jumps").select("file", F.col("successor").alias("offset"), F.lit(True).alias("landing")).distinct()
    marked = linked.join(landings, ["file", "offset"], "left")
    head = F.coalesce(F.col("landing"), F.lit(False)) | ~F.coalesce(F.col("previous") == F.col("offset"), F.lit(False))
    runs = store(marked.select(
        "file", "block", "offset", "successor",
        F.max(F.when(head, F.col("offset"))).over(nearby.rowsBetween(Window.unboundedPreceding, 0)).alias("head"),
    ), "warc-runs")
    jumps = runs.groupBy("file", "head").agg(F.max_by("successor", "offset").alias("to"))
    reached, rounds = jumps.where("head = 0").select("file", "head"), 0
    # One row per run, so a handful per block.
    count = reached.count()
    while True:
        ahead = reached.join(jumps, ["file", "head"]).select("file", F.col("to").alias("head"))
        ahead = ahead.join(jumps.select("file", "head"), ["file", "head"], "left_semi")
        reached = store(reached.unionByName(ahead).distinct(), "warc-reached")
        now = reached.count()
        if now == count:
            break
        count, rounds = now, rounds + 1
        far = jumps.select("file", F.col("head").alias("to"), F.col("to").alias("further"))
        jumps = store(jumps.join(far, ["file", "to"], "left").select("file", "head", F.col("further").alias("to")), "warc-jumps")
    return runs.join(reached, ["file", "head"], "left_semi").select("file", "offset", "successor")


def read_archives(spark, path: str) -> DataFrame:
    """(file, offset, header, payload as binary, bytes, digest) of every record of the archives.

    A version line inside a payload is a candidate that no chain reaches; its
    bytes are put back into the record around it.  Null successors (no header
    or no length) end a chain.  A folder without records gives no rows.  Who
    asks for lengths and digests only moves the payloads of divided records
    alone, and those of the others stay where they are.
    """
    pieces = version_pieces(spark, path)
    found = store(candidates(pieces), "warc-candidates")
    # The pieces of one file in order: a file is bounded by its writer.
    chain = reachable(found).select("file", "offset", F.lit(True).alias("real"))
    order = Window.partitionBy("file").orderBy("offset")
    light = found.select("file", "block", "order", "offset").join(chain, ["file", "offset"], "left").select(
        "*", F.max(F.when(F.col("real"), F.col("offset"))).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("owner"),
        F.lead("offset").over(order).alias("next"), F.lead("real").over(order).alias("next_real"))
    divided = F.col("real").isNull() | (F.col("next").isNotNull() & F.col("next_real").isNull())
    light = store(light.where("owner is not null").select("file", "block", "order", "offset", "owner", divided.alias("divided")), "warc-owners")
    # A table of its own: its size is then known, and where it is small the bodies need no shuffle.
    pieces_of_divided = store(light.where("divided"), "warc-divided")

    place = ["file", "block", "order"]
    held = F.substring("body", F.lit(1), F.least(F.col("content"), F.octet_length("body")).cast("int"))
    whole = pieces.select(*place, "header", held.alias("payload"), "bytes", "digest").join(light.where("not divided"), place).select(
        "file", "offset", "header", "payload", "bytes", "digest")
    parts = pieces.select(*place, "header", "content", F.col("body").cast("string").alias("body")).join(pieces_of_divided, place)
    parts = parts.groupBy("file", F.col("owner").alias("offset")).agg(
        F.sort_array(F.collect_list(F.struct("offset", "header", "content", "body"))).alias("parts"))
    # Strings are bytes here: joined, never decoded.
    text = F.array_join(F.transform("parts", lambda p, i: F.concat(
        F.when(i == 0, F.lit("")).otherwise(F.concat(F.lit(VERSION), p["header"])),
        F.coalesce(F.concat(F.when(i == 0, F.lit("")).otherwise(F.lit(BLANK)), p["body"]), F.lit("")))), "")
    content = F.col("parts")[0]["content"]
    joined = parts.select("file", "offset", F.col("parts")[0]["header"].alias("header"), content.alias("content"), text.cast("binary").alias("text"))
    payload = F.substring("text", F.lit(1), F.least(F.col("content"), F.octet_length("text")).cast("int"))
    joined = joined.select("file", "offset", "header", payload.alias("payload"))
    return whole.unionByName(joined.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", sha1_base32(F.col("payload"))))


def field(name: str) -> Column:
    """The value of a header line, null if absent."""
    value = F.regexp_extract("header", rf"(?:^|\r\n)(?i:{name}): *([^\r\n]*)", 1)
    return F.when(value != "", value)


def digest_rows(records: DataFrame) -> DataFrame:
    """One row per record: what the page's payload is, taken from the archive.

    Length and digest of a response come from its payload bytes; those of a
    revisit come from the response it refers to.
    """
    number = lambda name: F.regexp_extract(field(name), r"<urn:page:(-?[0-9]+)>", 1)
    long = lambda c: F.when(c != "", c.cast("long"))
    rows = store(records.select(
        long(number("WARC-Record-ID")).alias("page_id"), F.col("bytes").alias("own_bytes"),
        F.col("digest").alias("own_digest"), field("WARC-Type").alias("record_type"),
        long(number("WARC-Refers-To")).alias("refers_to"), field("WARC-Target-URI").alias("url"),
        (F.concat(F.lit("sha1:"), F.col("digest")) == field("WARC-Payload-Digest")).alias("intact"),
    ), "warc-records")
    origins = rows.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to")).agg(
        F.max("own_bytes").alias("full_bytes"), F.max("own_digest").alias("full_digest"))
    joined = rows.join(origins, "refers_to", "left")
    revisit = F.col("record_type") == "revisit"
    return joined.select(
        "page_id", F.when(revisit, F.col("full_bytes")).otherwise(F.col("own_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("full_digest")).otherwise(F.col("own_digest")).alias("payload_digest"),
        "record_type", "refers_to", "url",
    )


def round_trip(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """Write an archive of ``pages`` to the shared folder, read it back, one row per page."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, smallest)
    return digest_rows(read_archives(spark, path))
