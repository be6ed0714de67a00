"""The queries of this subpackage, each over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.llm import audit, bpe, ctph, ctw, decontaminate, jaccard, langid, merkle, packing, pii, secrets, toxicity, warc
from tarnmill.llm.common import WORD, fold, new_path, table


#: The key of this query's surrogates; a deployment passes its own secret.
PII_KEY = "test tables"
#: The id that ends a document in a sequence.
END = 1


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts of the strong kinds, their digest, and all spans with linked weak parts."""
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("places")


def op2_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """BPE ids and round trip of every document, as digests."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode_documents(docs, vocabulary))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingles are alike by nine tenths."""
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 90)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds."""
    return decontaminate.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op5_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document, by token frequencies and by context trees."""
    return ctw.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record, and what reading the archives back gives."""
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.predict(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for personal data, and what was put in."""
    return pii.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.predict(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op10_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return ctph.fingerprint_neighbours(table(spark, sf_dir, "documents"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How five filters act on each other, by source, order and step."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every document's ids in pieces, packed into sequences of 2,048."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary, END)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of every document under one root, checked where half of the texts have lost their line ends."""
    docs = table(spark, sf_dir, "documents")
    found = F.when(fold("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.digests(merkle.manifest(docs, found))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_bpe": op2_bpe,
    "op3_jaccard": op3_jaccard,
    "op4_decontaminate": op4_decontaminate,
    "op5_ctw": op5_ctw,
    "op6_warc": op6_warc,
    "op7_langid": op7_langid,
    "op8_pii": op8_pii,
    "op9_toxicity": op9_toxicity,
    "op10_ctph": op10_ctph,
    "op11_audit": op11_audit,
    "op12_packing": op12_packing,
    "op13_merkle": op13_merkle,
}

def in_sql(pattern: str) -> str:
    """A pattern as SQL text; possessive repeats, which the other engine lacks, give the same matches there as plain ones."""
    return "'" + pattern.replace("'", "''").replace("}+", "}").replace("++", "+") + "'"


def secret_parts(kind: int) -> str:
    """The parts of a kind as SQL: where each starts follows from the gaps and matches before it."""
    name = secrets.KINDS[kind]
    pattern = in_sql("[A-Za-z0-9+/_-]{20,}" if name == "token" else secrets.PATTERNS[name])
    good = {"assign": "length(v) >= 6", "token": "regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Z]') and regexp_matches(m, '[a-z]')"}.get(name, "true")
    rows = f"select doc_id, unnest(regexp_extract_all(text, {pattern})) as m, unnest(regexp_extract_all(text, {pattern}, {2 if kind == 0 else 0})) as v, unnest(string_split_regex(text, {pattern})) as gap, unnest(range(1, len(string_split_regex(text, {pattern})) + 1)) as i from d"
    return f"select doc_id, {kind} as kind, last - length(m) as first, last from (select *, sum(length(gap) + length(m)) over (partition by doc_id order by i) as last from ({rows}) where m is not null) where {good}"


def near(which: str) -> str:
    return f"(coalesce(max(case when {which} then last end) over before, -{secrets.SCOPE} - 1) >= first - {secrets.SCOPE} or coalesce(min(case when {which} then first end) over after, last + {secrets.SCOPE} + 1) <= last + {secrets.SCOPE})"


SECRETS = f"""with d as (select doc_id, coalesce(text, '') as text from documents), p as ({" union all ".join(secret_parts(k) for k in range(len(secrets.KINDS)))}),
n as (select *, coalesce(max(case when kind < 3 then last end) over before, 0) > first or coalesce(min(case when kind < 3 then first end) over after, last) < last as inside,
  case kind when 5 then {near("kind in (1, 3, 4)")} when 3 then {near("kind in (0, 2, 5)")} else {near("kind in (0, 5)")} or ({near("kind = 2")} and {near("kind in (1, 3)")}) end as linked
  from p window before as (partition by doc_id order by first, kind rows between unbounded preceding and 1 preceding), after as (partition by doc_id order by first, kind rows between 1 following and unbounded following)),
r as (select *, [{", ".join(f"'{k}'" for k in secrets.KINDS)}][kind + 1] || ':' || first || ':' || last as t from n where kind < 3 or (not inside and linked))
select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, sha256(coalesce(string_agg(t, ',' order by first, kind) filter (kind < 3), '')) as base_sha256, coalesce(string_agg(t, ',' order by first, kind) filter (t is not null), '') as spans, count(*) filter (kind >= 3) as n_linked from d left join r using (doc_id) group by doc_id"""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COPIES = f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) end as s from w),
g as (select doc_id, len(s) as n, unnest(s) as g from s),
e as (select a.doc_id as u, b.doc_id as v from g a join g b using (g) where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id having 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
r as (select doc_id as node, doc_id as root from documents union select e.v, r.root from r join e on r.node = e.u), m as (select node, min(root) as least from r group by node)
select doc_id, cast(len(s) as bigint) as n_shingles, least as component_id from s join m on node = doc_id"""

FIVE = "cast('0x' || s[(i // 4) * 5 + 1:(i // 4) * 5 + 5] as bigint)"
PAGES = f"""with p as (select page_id, coalesce(html, '') as h from pages), f as (select page_id, h, min(page_id) over (partition by h) as first, sha1(h) as s from p)
select page_id, cast(strlen(h) as bigint) as payload_bytes, array_to_string(list_transform(range(32), lambda i: '{warc.BASE32}'[cast(({FIVE} >> (15 - 5 * (i % 4))) & 31 as int) + 1]), '') as payload_digest,
case when first is null or page_id is not distinct from first then 'response' else 'revisit' end as record_type, case when page_id is distinct from first then first end as refers_to from f"""

#: Documents with the bits of the filters that each fails, then all orders of the filters, step by step.
MASKS = f"""f as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
g as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
m as (select part, case when len(w) < {audit.LEAST_WORDS} then 1 else 0 end + case when 100 * len(list_distinct(w)) < {audit.DISTINCT_PCT} * len(w) then 2 else 0 end + case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {audit.CAPITALS_PCT} * length(text) then 4 else 0 end
  + case when regexp_matches(text, '{audit.MARKS}') then 8 else 0 end + case when coalesce(f.doc_id > min(f.doc_id) over (partition by text), false) then 16 else 0 end as mask, coalesce(good, false) as good, coalesce(toxic, false) as toxic from f left join g on f.doc_id = g.doc_id)"""
AUDIT = f"""with {MASKS}, c as (select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m group by part, mask),
l(c, b) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)), o as (select p.c || q.c || r.c || s.c || t.c as filter_order, [p.b, q.b, r.b, s.b, t.b] as bs from l p, l q, l r, l s, l t where p.b | q.b | r.b | s.b | t.b = 31),
s as (select filter_order, i as step, bs[i] as bit, list_sum(bs[1:i - 1])::int as before from o, range(1, 6) r(i)),
x as (select part, filter_order, step, bit, sum(n) filter (mask & (bit | coalesce(before, 0)) = 0) as kept, sum(n) filter (mask & bit > 0 and mask & coalesce(before, 0) = 0) as removed, sum(n) filter (mask & bit > 0 and mask & coalesce(before, 0) > 0) as redundant, sum(n) filter (mask = bit) as unique_fails,
  sum(good) filter (mask & bit > 0 and mask & coalesce(before, 0) = 0) as good_lost, sum(toxic) filter (mask & bit > 0 and mask & coalesce(before, 0) = 0) as toxic_lost from c, s group by all)
select part, filter_order, cast(step as int) as step, {", ".join(f"cast(coalesce({c}, 0) as bigint) as {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))}, cast(coalesce(sum(removed) over (partition by part, bit), 0) as bigint) as shapley from x"""


def hashed(text: str) -> str:
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)) + "))"


def crc32_sql(c: str) -> str:
    """The bit-by-bit CRC of an ASCII text, lowest bit of each byte first."""
    bits = f"flatten(list_transform(range(1, length({c}) + 1), lambda i: list_transform(range(8), lambda b: (ascii({c}[i]) >> b) & 1)))"
    return f"xor(list_reduce({bits}, lambda a, b: case when (a & 1) <> b then xor(a >> 1, {0xEDB88320}) else a >> 1 end, {0xFFFFFFFF}::bigint), {0xFFFFFFFF}::bigint)"


def tree_sql(name: str, base: str) -> str:
    """The levels of trees (t, i, h, n) one above the other, as CTE name (t, level, i, h, n), the root's last."""
    return f"{name} as (select t, 0 as level, i, h, n from {base} union all select t, level + 1, i // 3, sha256(string_agg(h, '' order by i)), any_value((n + 2) // 3) from {name} where n > 1 group by t, level, i // 3)"


def proof_sql(name: str, levels: str, nodes: str) -> str:
    """What stands before and after the path of each node at every level, as CTE name (t, i0, level, pre, post)."""
    return f"""{name} as (select b.t, b.i as i0, l.level, coalesce(string_agg(s.h, '' order by s.i) filter (s.i < b.i // l.w), '') as pre, coalesce(string_agg(s.h, '' order by s.i) filter (s.i > b.i // l.w), '') as post
  from {nodes} b join (select distinct t, level, n, cast(pow(3, level) as bigint) as w from {levels} where n > 1) l on l.t = b.t join {levels} s on s.t = b.t and s.level = l.level and s.i // 3 = b.i // l.w // 3 group by b.t, b.i, l.level)"""


MERKLE = f"""with recursive d as (select doc_id, source, coalesce('=' || source, '') as t, {hashed("text")} as h, case when {crc32_sql("coalesce(doc_id::varchar, '')")} % 2 = 0 then {hashed("replace(text, chr(10), '')")} else {hashed("text")} end as found from documents),
b as (select *, row_number() over (partition by t order by doc_id nulls first, h) - 1 as i, count(*) over (partition by t) as n from d), {tree_sql("k", "b")}, r as (select t as name, '' as t, h, row_number() over (order by t) - 1 as i, count(*) over () as n from k where n = 1), {tree_sql("u", "r")},
{proof_sql("p", "k", "b")}, {proof_sql("q", "u", "r")},
a as (select b.t, b.i, any_value(b.doc_id) as doc_id, any_value(b.h) as leaf, any_value(b.found) as found, any_value(r.h) as subroot, (select h from u where n = 1) as root, list(struct_pack(pre := e.pre, post := e.post) order by e.place) filter (e.place is not null) as e
  from b join r on r.name = b.t left join (select t, i0, level as place, pre, post from p union all select r.name, b2.i, 1000 + q.level, pre, post from q join r on r.i = q.i0 join b b2 on b2.t = r.name) e on e.t = b.t and e.i0 = b.i group by b.t, b.i),
z as (select *, list_reduce(list_prepend(found, list_transform(coalesce(e, []), lambda s: s.pre || '|' || s.post)), lambda x, s: sha256(split_part(s, '|', 1) || x || split_part(s, '|', 2))) as folded_root from a)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(coalesce(e, []), lambda s: s.pre || s.post), '')) as proof_sha256, folded_root, folded_root = root as verified from z"""

#: The others have no SQL: merges of byte pairs, greedy tilings, context trees, profiles of letter runs, keyed surrogates that
#: are tried again, automata, piecewise hashes. Tests hold them against brute force.
ORACLES: dict[str, str] = {"op1_secrets": SECRETS, "op3_jaccard": COPIES, "op6_warc": PAGES, "op11_audit": AUDIT, "op13_merkle": MERKLE}
