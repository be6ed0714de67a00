"""Secret scans with multipart credential linking, in DataFrame operations only.

Strong candidates (assignments, access keys, long hexadecimal runs) are reported wherever they stand. Weak ones are
parts that mean nothing alone: identifiers of an account, tokens that look random, endpoints. They are reported only
where complementary parts meet in a scope, which reaches SCOPE code points around a part. There are three roles:

* identifiers: identifier, access (an access key's id says who, not how);
* secrets: assign, token, and hex, which may as well be a checksum;
* endpoints: endpoint.

A token is reported with an identifier or an endpoint; an identifier with a secret; an endpoint with an assignment or a
token, or with hex where an identifier is in its scope as well. That is an interval join of parts within a document; as
intervals have one length, the nearest part of each role before and after decides it, so it is one window over a
document's parts in order, linear in their number.

Defined results: a null or empty text has no spans; rows with equal ids are scanned each; weak parts that overlap a
strong span are part of it and aren't reported; other columns are ignored by scan() and kept by redact(), whatever their
names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnmill.llm.common import free_name

SCOPE = 160
#: Fixed patterns of the strong kinds, in the order in which spans of one start are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: Weak parts: identifiers, endpoints, random-looking tokens.
IDENTIFIER = r"""\b(?i:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}+"""
ENDPOINT = r"""\b(?i:https?|ftps?|ssh|jdbc:[a-z]++|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]++|\b(?i:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:-]{3,}+"""
RANDOM = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+"
KINDS = ["assign", "access", "hex", "identifier", "endpoint", "token"]
PATTERNS = dict(zip(KINDS, [ASSIGN, ACCESS, HEX, IDENTIFIER, ENDPOINT, RANDOM]))
STRONG = 3
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

PART = "array<struct<kind:int,i:int,gap:int,size:int,good:boolean>>"


def found(text: Column, kind: int) -> Column:
    """The matches of a kind in order: how many code points lie before each since the last one, and its length."""
    pattern = F.lit(PATTERNS[KINDS[kind]])
    good = F.transform(F.regexp_extract_all(text, pattern, F.lit(2)), lambda v: F.length(v) >= 6) if kind == 0 else F.lit(None)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, PATTERNS[KINDS[kind]], -1)
    fine = (lambda i: F.element_at(good, i + 1)) if kind == 0 else (lambda i: F.lit(True))
    parts = F.transform(matches, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(F.element_at(gaps, i + 1)).alias("gap"), F.length(m).alias("size"), fine(i).alias("good")))
    return F.when(text.rlike(PATTERNS[KINDS[kind]]), parts.cast(PART)).otherwise(F.array().cast(PART))


def spans(docs: DataFrame, *keys: str, scope: int = SCOPE) -> DataFrame:
    """row, the keys, kind, first, last (end exclusive) and reported, for each part of each text; a row without parts
    has one row of nulls. One shuffle, of parts alone."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = docs.select(F.monotonically_increasing_id().alias("row"), *keys, F.concat(*(found(text, k) for k in range(len(KINDS)))).alias("parts"))
    # Where no match is good, all rows would be dropped below: such a text has no parts.
    some = F.when(F.exists("parts", lambda x: x["good"].isNull() | x["good"]), F.col("parts"))
    p = parts.select("row", *keys, F.explode_outer(some).alias("p")).select("row", *keys, "p.*")
    # Where a part starts: all gaps up to it and all earlier parts of its kind.
    own = Window.partitionBy("row", "kind").orderBy("i")
    p = p.withColumn("last", (F.sum(F.col("gap") + F.col("size")).over(own)).cast("long")).withColumn("first", F.col("last") - F.col("size"))
    p = p.where("good is null or good").repartition("row")
    order = Window.partitionBy("row").orderBy("first", "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    kind, first, last = F.col("kind"), F.col("first"), F.col("last")

    def near(which: Column) -> Column:
        """Whether a part of a sort lies within the scope; of all before it the furthest end counts."""
        return (F.coalesce(F.max(F.when(which, last)).over(before), F.lit(-scope - 1)) >= first - scope) | (F.coalesce(F.min(F.when(which, first)).over(after), last + scope + 1) <= last + scope)

    strong = kind < STRONG
    inside = (F.coalesce(F.max(F.when(strong, last)).over(before), F.lit(0)) > first) | (F.coalesce(F.min(F.when(strong, first)).over(after), last) < last)
    identifier, endpoint, sure, maybe = kind.isin(1, 3), kind == 4, kind.isin(0, 5), kind == 2
    p = p.withColumn("weak_in_strong", ~strong & inside)
    linked = F.when(kind == 5, near(identifier | endpoint)).when(kind == 3, near(sure | maybe)).otherwise(near(sure) | (near(maybe) & near(identifier)))
    return p.withColumn("reported", kind.isNotNull() & (strong | (~F.col("weak_in_strong") & linked)))


def scan(docs: DataFrame, key: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """For each row: key, n_assign, n_access, n_hex, n_linked, base_sha256, and its spans as text and as an array."""
    s = spans(docs, key, scope=scope)
    one = F.struct("first", "kind", F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1), "first", "last").alias("text"), "last")
    grouped = s.groupBy("row", key).agg(F.sort_array(F.collect_list(F.when(F.col("reported"), one))).alias("all"))
    count = lambda k: F.size(F.filter("all", lambda x: x["kind"] == k)).cast("long")
    text = lambda a: F.array_join(F.transform(a, lambda x: x["text"]), ",")
    base = F.filter("all", lambda x: x["kind"] < STRONG)
    return grouped.select(
        key, *(count(k).alias(f"n_{KINDS[k]}") for k in range(STRONG)), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("all")).alias("spans"),
        F.size(F.filter("all", lambda x: x["kind"] >= STRONG)).cast("long").alias("n_linked"), F.transform("all", lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), x["kind"].alias("kind"))).alias("places"),
    )


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs with every reported span of its text replaced by its kind in brackets; all rows and columns stay. Only
    texts that hold a candidate are shuffled."""
    names = docs.columns
    key, found = free_name(docs, "key"), free_name(docs, "places")
    maybe = F.coalesce(F.col("text").rlike(ANY), F.lit(False))
    marked = docs.where(maybe).withColumn(key, F.struct(F.col("doc_id").cast("string"), F.xxhash64("text"), F.length("text")))
    places = scan(marked.select(F.col(key).alias("id"), "text"), "id", scope).where(F.size("places") > 0).select(F.col("id").alias(key), F.col("places").alias(found)).dropDuplicates([key])
    text = F.col("text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["first"] - acc["at"], F.lit(0)).cast("int"))
        mark = F.concat(F.lit("["), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["last"]).alias("at"), F.when(s["first"] >= acc["at"], F.concat(acc["out"], kept, mark)).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    redacted = marked.join(places, key, "left").withColumn("text", F.when(F.col(found).isNull(), text).otherwise(clean))
    return docs.where(~maybe).unionByName(redacted.select(*(F.col(f"`{n}`") for n in names)))
