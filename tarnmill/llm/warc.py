"""WARC archives: write pages as records, read archives back by verified chains of records.

A reader that looks for the magic of a record finds it inside payloads too. Archives are read as text that the magic
separates, so plain archives are split into byte ranges that tasks read on their own, and compressed ones stream through
one task each. Every such place is a candidate: its task tells where it lies and where its successor has to begin.
Pointer jumping from each file's start keeps the places that are reached, and rejects magic inside payloads: within a
byte range over arrays, then between the ranges of a file by joins, in a logarithmic number of rounds. Payloads are
digested where they are read; only those that hold magic themselves are put together again from their pieces.

Defined results: a null html is an empty payload; a null page_id writes an empty id and reads back as null, and never
becomes the record that others refer to; of rows that share both the smallest page_id and the payload the one read first
is the response and the others revisit it; where no row of a payload has a page_id all are responses; line ends in a url
are percent-encoded; a null url writes no target; an empty table gives no archive and no rows; other columns are ignored.
A chain ends where a record's end is not the next one's start; what follows is not read. Records of all versions 1.x are
read, also side by side; a file that doesn't begin with one is an error that names it. A record and a line of text have
to fit a row of 2 GB. Rows have to come in one order each time they are read, as those of files do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnmill.llm.common import forget, materialise

#: Fixed values of the format.
MAGIC, VERSION, END = b"WARC/1.", b"1\r\n", b"\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
RECORDS_A_FILE = 2000
#: An error names so many files at most.
NAMED = 10
#: Copies of a payload are spread over so many keys, so that no task gets them all.
SALTS = 32


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 5 hexadecimal digits are 4 letters."""
    digest = F.sha1(payload)
    fives = [F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*(F.substring(F.lit(BASE32), F.shiftright(x, s).bitwiseAND(31) + 1, F.lit(1)) for x in fives for s in (15, 10, 5, 0)))


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, n, digest, and refers_to: the id of the response of equal payload that a revisit refers to."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("n", F.octet_length("html").cast("long"))
    pages = pages.withColumn("same", F.sha2(F.col("html").cast("binary"), 256)).withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    pages = pages.withColumn("row", F.monotonically_increasing_id())
    # Equal payloads meet as digests; only groups of two and more come back, once for each salt.
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("first")
    first = pages.where(F.col("n") >= least_bytes).groupBy("same").agg(least, F.count("*").alias("copies")).where("copies > 1 and first is not null")
    first = first.select("same", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pages = pages.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    joined = pages.join(first, ["same", "salt"], "left")
    return joined.withColumn("refers_to", F.when(F.col("first.row") != F.col("row"), F.col("first.page_id"))).drop("same", "salt", "first", "row")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, records_a_file: int = RECORDS_A_FILE, compression: str = "gzip") -> None:
    """One record for each row, through Spark's own committer: a record is a line, and the format's end of a record,
    two line ends, is the separator of lines."""
    p = plan_records(pages, least_bytes)
    whole = F.col("refers_to").isNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record = F.concat(
        F.lit((MAGIC + VERSION).decode()), line("WARC-Type", F.when(whole, "response").otherwise("revisit")), line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), F.coalesce(line("WARC-Refers-To", urn(F.col("refers_to"))), F.lit("")),
        line("X-Payload-Length", F.col("n").cast("string")), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(whole, F.col("n")).otherwise(0).cast("string")), F.lit("\r\n"), F.when(whole, F.col("html")).otherwise(""),
    )
    p.select(record.alias("value")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", records_a_file).option("compression", compression).text(path)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """The pieces between magic: file, part (the byte range's start), row (in order of place), value."""
    lines = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("value"))


def candidates(pieces: DataFrame) -> DataFrame:
    """Every piece: file, part, row, size with the magic after it, and if it can be a record (else null): head (its
    header's bytes with the empty line), length (of its payload), whole (whether it has all of it) and the fields. Only
    headers and digests go on."""
    value = F.col("value")
    header = F.substring_index(value.cast("string"), END.decode(), 1)
    # The rest of a version stands first, whichever it is.
    is_header = (F.octet_length(header) + 4 <= F.octet_length(value)) & header.rlike(r"\A[0-9]+\r\n")
    field = lambda name: F.nullif(F.regexp_extract("header", rf"(?im)^{name}:[ \t]*([^\r\n]*)\r?$", 1), F.lit(""))
    d = pieces.select("file", "part", "row", (F.octet_length(value) + len(MAGIC)).cast("long").alias("size"), F.when(is_header, header).alias("header"), "value")
    d = d.withColumn("head", F.when(F.col("header").isNotNull(), F.octet_length("header") + 4).cast("long")).withColumn("length", F.expr("try_cast(regexp_extract(header, '(?im)^content-length:[ \\\\t]*([0-9]+)[ \\\\t]*\\\\r?$', 1) as bigint)"))
    ends = F.col("head") + F.col("length")
    whole = F.coalesce(F.substring(value, (ends + 1).cast("int"), F.lit(4)) == F.lit(END), F.lit(False))
    d = d.withColumn("whole", whole)
    payload = F.when(F.col("whole"), F.expr("substring(value, cast(head + 1 as int), cast(length as int))"))
    return d.select("file", "part", "row", "size", "head", "length", "whole", field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("id"), field("WARC-Target-URI").alias("url"), field("WARC-Payload-Digest").alias("told_digest"), field("WARC-Refers-To").alias("to"), field("X-Payload-Length").cast("long").alias("told_bytes"), base32_sha1(payload).alias("digest"))


def placed(found: DataFrame) -> DataFrame:
    """at (the offset of the magic before a piece) and after (where the next record has to begin) of all candidates.
    Places are summed up within byte ranges, then the ranges of a file, which are few."""
    within = found.withColumn("own", F.sum("size").over(Window.partitionBy("file", "part").orderBy("row")) - F.col("size"))
    ranges = found.groupBy("file", "part").agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy("file").orderBy("part")
    ranges = ranges.withColumn("before", F.sum("bytes").over(before) - F.col("bytes")).withColumn("file_bytes", F.sum("bytes").over(Window.partitionBy("file")) - len(MAGIC))
    start = F.col("before") + F.col("own")
    d = within.join(ranges.drop("bytes"), ["file", "part"]).withColumn("at", start - len(MAGIC))
    return d.withColumn("after", start + F.col("head") + F.col("length") + len(END)).drop("before", "own")


def jumps(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Where chains from each offset leave a range, or end: each round doubles the length of all jumps. An offset that
    is no candidate of the range stays as it is; one that can't be a record gives -1."""
    to = after.copy()
    for _ in range(len(at).bit_length() + 1):
        k = np.minimum(np.searchsorted(at, to), max(len(at) - 1, 0))
        on = at[k] == to
        if not on.any():
            break
        # Doubling: those that land on a candidate go on as that one does.
        to = np.where(on, to[k], to)
    return to


def chain(at: np.ndarray, after: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Which candidates of a range the chains from some offsets reach."""
    n = len(at)
    k = np.searchsorted(at, after)
    jump = np.append(np.where((k < n) & (at[np.minimum(k, n - 1)] == after), k, n), n)
    reached = np.zeros(n + 1, bool)
    reached[:n] = np.isin(at, entry)
    for _ in range(n.bit_length() + 1):
        reached[jump[reached]] = True
        jump = jump[jump]
    return reached[:n]


def verified(found: DataFrame) -> DataFrame:
    """The candidates that the chains from their files' starts reach, and that end where one begins or the file ends."""
    edges = found.where("after is not null and at >= 0")

    def leave(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        at, after = np.asarray(t["at"]), np.asarray(t["after"])
        return pa.table({"file": t["file"], "at": at, "to": jumps(at, after)})

    ranges = found.groupBy("file").agg(F.count_distinct("part").alias("n")).agg(F.max("n")).first()[0] or 1
    reached = edges.where("at = 0").select("file", "at")
    if ranges > 1:
        step = materialise(edges.select("file", "part", "at", "after").groupBy("file", "part").applyInArrow(leave, "file string, at long, to long"), "jumps")
        reached = materialise(reached, "reached")
        for _ in range(int(ranges).bit_length()):
            # What is reached so far, and what lies as many ranges on; then all jumps are twice as long.
            on = step.join(reached, ["file", "at"]).select("file", F.col("to").alias("at"))
            more = materialise(reached.unionByName(on).distinct(), "reached")
            twice = materialise(step.join(step.select("file", F.col("at").alias("to"), F.col("to").alias("then")), ["file", "to"], "left").select("file", "at", F.coalesce("then", "to").alias("to")), "jumps")
            forget(reached), forget(step)
            reached, step = more, twice
    entries = found.select("file", "part", "at").where("after is not null and at >= 0").join(reached, ["file", "at"]).groupBy("file", "part").agg(F.collect_set("at").alias("entries")).withColumnsRenamed({"file": "in_file", "part": "in_part"})

    def follow(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("at")
        if not right.num_rows or not left.num_rows:
            return left.slice(0, 0)
        return left.filter(pa.array(chain(np.asarray(left["at"]), np.asarray(left["after"]), np.array(right["entries"][0].as_py()))))

    kept = edges.groupBy("file", "part").cogroup(entries.groupBy("in_file", "in_part")).applyInArrow(follow, edges.schema)
    # The last of a chain may point at nothing: then it is cut off, and no record.
    starts = edges.select("file", F.col("at").alias("after"), F.lit(True).alias("goes_on"))
    return kept.join(starts, ["file", "after"], "left").where("goes_on or after = file_bytes").drop("goes_on")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each verified record; a revisit has the length and digest of the payload that it refers to. payload
    only if asked for."""
    pieces = chunks(spark, path)
    found = materialise(placed(candidates(pieces)), "candidates")
    begun = F.max(F.when(F.col("at") == 0, F.col("after").isNotNull()))
    others = [r.file for r in found.groupBy("file").agg(begun.alias("fine")).where("not coalesce(fine, false)").select("file").limit(NAMED).collect()]
    if others:
        raise ValueError(f"these begin with no record of WARC/1.x (at most {NAMED} are named): {', '.join(sorted(others))}")
    records = materialise(verified(found), "records")
    key = ["file", "part", "row"]
    # Payloads that go over several pieces: each piece goes to the record before it.
    cut = records.where(~F.col("whole")).select("file", F.col("at").alias("start"), F.col("after").alias("stop"), "head", "length")
    inside = found.select(*key, "at").join(cut, "file").where("at >= start and at < stop").select(*key, "at", "start", "head", "length")
    joined = pieces.join(inside, key).groupBy("file", "start", "head", "length").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("all"))
    body = F.expr(f"substring(aggregate(all, X'', (a, x) -> if(a = X'' AND x.at = start, x.value, concat(a, X'{MAGIC.hex()}', x.value))), cast(head + 1 as int), cast(length as int))")
    put = joined.select("file", F.col("start").alias("at"), body.alias("body"))
    if payloads:
        one = pieces.join(records.where("whole").select(*key, "at", "head", "length"), key).select("file", "at", F.expr("substring(value, cast(head + 1 as int), cast(length as int))").alias("body"))
        put = put.unionByName(one)
    put = put.withColumn("put_digest", base32_sha1(F.col("body")))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
    again = F.col("record_type") == "revisit"
    r = records.join(put, ["file", "at"], "left").select(
        "file", F.col("at").alias("offset"), "record_type", number("id").alias("page_id"), "url", F.when(again, F.coalesce("told_bytes", F.lit(0))).otherwise(F.col("length")).cast("long").alias("payload_bytes"),
        F.when(again, F.regexp_replace("told_digest", "^sha1:", "")).otherwise(F.coalesce("put_digest", "digest")).alias("payload_digest"), number("to").alias("refers_to"), *([F.col("body").alias("payload")] if payloads else []),
    )
    return r
