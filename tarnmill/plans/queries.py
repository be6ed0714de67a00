"""The engine's own queries over the test tables, and the SQL that gives the same rows.

The tables' texts hold no fences, fillers or tool calls, so queries build such inputs from them, and so does the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnmill.functions import compress, dom, rewrite, text, tokens, tools
from tarnmill.operators import adapters, history, memory
from tarnmill.plans import catalog
from tarnmill.plans.bodies import minify
from tarnmill.plans.once import count_once, minify_once, minify_tools_once
from tarnmill.plans.optimize import Config, cumulative, optimize
from tarnmill.streaming import response, usage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("request_id"), F.col("turn").cast("int").alias("msg_idx"), "role", "text")


TOK = "case when coalesce(length(text), 0) = 0 then 0 else greatest(1, length(text) // 4) end + 4"
MSGS = f"m as (select cast(conv_id as varchar) request_id, cast(turn as int) msg_idx, role, text, cast({TOK} as bigint) tok from conversations)"


@query(f"with {MSGS} select request_id, msg_idx, tok from m")
def token_count_by_message(spark, sf_dir):
    return tokens.per_message(turns(spark, sf_dir)).select("request_id", "msg_idx", "tok")


@query(f"with {MSGS} select request_id, cast(sum(tok) as bigint) as tok, count(*) as n from m group by all")
def token_count_by_conversation(spark, sf_dir):
    return tokens.per_message(turns(spark, sf_dir)).groupBy("request_id").agg(F.sum("tok").alias("tok"), F.count("*").alias("n"))


PREFIX = "p as (select *, cast(coalesce(sum(tok) over (partition by request_id order by msg_idx rows between unbounded preceding and 1 preceding), 0) as bigint) as prefix, cast(sum(tok) over (partition by request_id) as bigint) as total, count(*) over (partition by request_id) as n, row_number() over (partition by request_id order by msg_idx) - 1 as place from m)"


@query(f"with {MSGS}, {PREFIX} select request_id, msg_idx, prefix, total, n from p")
def token_prefix_sums(spark, sf_dir):
    return tokens.prefix_sums(tokens.per_message(turns(spark, sf_dir))).select("request_id", "msg_idx", "prefix", "total", "n")


BUDGET, KEEP = 400, 2
#: Ends of pairs by place: a use of `a` or `b`, then its result two places on.
EVENTS = "e as (select request_id, msg_idx, case when msg_idx % 4 < 2 then 'tool_use' else 'tool_result' end as type, request_id || '-' || (msg_idx // 4) || '-' || (msg_idx % 2) as tool_id from m)"
PAIRS = "x as (select *, lag(type) over w as before, lag(msg_idx) over w as use_idx from e window w as (partition by request_id, tool_id order by msg_idx)), pairs as (select request_id, tool_id, use_idx, msg_idx as res_idx from x where type = 'tool_result' and before = 'tool_use')"
DROP = """g as (select request_id, max(n) as n, max(total) as total, min(place) filter (valid and place >= 1 and place <= n - {keep} and total - prefix <= {budget}) as least, max(place) filter (valid and place >= 1 and place <= n - {keep}) as most from v group by request_id),
d as (select request_id, n, total, case when total <= {budget} or n <= {keep} then 0 else coalesce(least, most, 0) end as dropped from g)
select d.request_id, d.n, d.total, cast(dropped as bigint) as dropped, d.total - prefix as tokens_after from d join v on d.request_id = v.request_id and v.place = d.dropped"""


def tool_events(spark, sf_dir):
    i = F.col("msg_idx")
    t = turns(spark, sf_dir)
    return t.select("request_id", "msg_idx", F.lit(0).alias("blk_idx"), F.when(i % 4 < 2, "tool_use").otherwise("tool_result").alias("type"), F.concat_ws("-", "request_id", F.floor(i / 4).cast("string"), (i % 2).cast("string")).alias("tool_id"))


@query(f"with {MSGS}, {PREFIX}, v as (select *, true as valid from p), {DROP.format(keep=KEEP, budget=BUDGET)}")
def budget_drop(spark, sf_dir):
    return history.budget_report(tokens.per_message(turns(spark, sf_dir)), BUDGET, KEEP)


@query(f"with {MSGS}, {EVENTS}, {PAIRS} select * from pairs")
def pair_match(spark, sf_dir):
    return history.pairs(tool_events(spark, sf_dir))


VALID = "v as (select *, not exists (select 1 from pairs q where q.request_id = p.request_id and p.msg_idx > q.use_idx and p.msg_idx <= q.res_idx) as valid from p)"


@query(f"with {MSGS}, {EVENTS}, {PAIRS}, {PREFIX}, {VALID} select request_id, msg_idx, valid from v")
def valid_drop_points(spark, sf_dir):
    return history.drop_points(turns(spark, sf_dir), history.pairs(tool_events(spark, sf_dir))).select("request_id", "msg_idx", "valid")


@query(f"with {MSGS}, {EVENTS}, {PAIRS}, {PREFIX}, {VALID}, {DROP.format(keep=KEEP, budget=BUDGET)}")
def budget_drop_pair_safe(spark, sf_dir):
    return history.budget_report(tokens.per_message(turns(spark, sf_dir)), BUDGET, KEEP, history.pairs(tool_events(spark, sf_dir)))


@query("with d as (select *, count(*) over w as c, max(doc_id) over w as last from documents where text is not null window w as (partition by lang, text)) select doc_id, length(text) >= 200 and c > 1 and doc_id < last as stubbed, sha256(case when length(text) >= 200 and c > 1 and doc_id < last then '[identical to a later tool_result; omitted ' || length(text) || ' chars]' else text end) as content from d")
def dedup_stub(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("text is not null").select(F.col("lang").alias("request_id"), F.col("doc_id").alias("msg_idx"), F.lit(0).alias("blk_idx"), F.col("text").alias("tr_text"))
    return history.dedup_documents(d, "tr_text", "msg_idx", "request_id").select(F.col("msg_idx").alias("doc_id"), "stubbed", F.sha2(F.col("tr_text").cast("binary"), 256).alias("content"))


CUT = "regexp_extract(left(text, 240), '(?s)^(.{40,}?[.!?。！？])\\s', 1)"
DISTILL = f"trim(case when {CUT} <> '' then {CUT} else rtrim(left(text, 240), E' \\n\\t\\r') end, E' \\n\\t\\r') || chr(10) || chr(10) || '[distilled from ' || length(text) || ' chars]'"


@query(f"with {MSGS}, {PREFIX} select request_id, msg_idx, place < n - 2 and length(text) > 360 as distilled, case when place < n - 2 and length(text) > 360 then {DISTILL} else text end as text from p")
def distill_old_turns(spark, sf_dir):
    return history.distill_old(turns(spark, sf_dir), keep_last=2).select("request_id", "msg_idx", "distilled", "text")


def messy(c: Column) -> Column:
    return F.concat(F.lit("  Actually, I think "), c, F.lit("!!!! \n\n\n\n\nit  seems \t fine   \n\n\ndone...  \n"))


MESSY = "'  Actually, I think ' || text || E'!!!! \\n\\n\\n\\n\\nit  seems \\t fine   \\n\\n\\ndone...  \\n'"
BLANKS = "regexp_replace(regexp_replace({0}, '\\n{{3,}}', E'\\n\\n', 'g'), '(?m)[ \\t]+$', '', 'g')"
SQL_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def over_documents(name: str, f: Callable[[Column], Column], expression: str) -> None:
    def run(spark, sf_dir):
        return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", f(F.col("text")).alias("text"))

    QUERIES[name] = run
    ORACLES[name] = f"select doc_id, {expression} as text from documents where text is not null"


over_documents("minify_whitespace", lambda c: text.minify_text(messy(c)), f"regexp_replace({BLANKS.format(MESSY)}, '^\\n+|\\n+$', '', 'g')")
LOW = MESSY
for _p in (rf"(?i)\b(?:{text.HEDGES})\b", r"[!?.]{3,}", r"\n{4,}", r"^\s+|\s+$"):
    LOW = f"regexp_replace({LOW}, '{_p}', '', 'g')"
over_documents("strip_low_value", lambda c: text.strip_low_value(messy(c)), SQL_STRIP.format(LOW))
COLLAPSE = "regexp_replace(regexp_replace({0}, '\\n{{3,}}', E'\\n\\n', 'g'), '[ \\t]{{2,}}', ' ', 'g')"
over_documents("collapse_whitespace", lambda c: text.collapse_whitespace(messy(c)), SQL_STRIP.format(COLLAPSE.format(MESSY)))
FENCED = "```py\nx = 1\n\n\n\ny  =  2   \n```\n"
over_documents(
    "minify_fenced", lambda c: text.minify_text(F.concat(messy(c), F.lit(FENCED), messy(c))),
    f"regexp_replace({BLANKS.format(MESSY)} || E'{FENCED.replace(chr(10), chr(92) + 'n')}' || {BLANKS.format(MESSY)}, '^\\n+|\\n+$', '', 'g')",
)
over_documents(
    "fence_segments", lambda c: F.concat_ws("|", *(F.element_at(F.transform(text.segments(F.concat(messy(c), F.lit(FENCED), c)), lambda s: F.concat(s["fence"].cast("string"), F.length(s["text"]).cast("string"))), k) for k in (1, 2, 3))),
    f"'false' || length({MESSY}) || '|true{len(FENCED)}|false' || length(text)",
)
SENT = "string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
over_documents("truncate_verbose", lambda c: text.truncate_verbose(c), f"case when length(text) <= 500 then text when len({SENT}) <= 3 then left(text, 500) || '...' else {SENT}[1] || ' ' || {SENT}[2] || ' ... ' || {SENT}[len({SENT})] end")
over_documents("minify_prompt", lambda c: rewrite.minify_prompt(messy(c)), f"regexp_replace({SQL_STRIP.format(f"regexp_replace({MESSY}, '\\s+', ' ', 'g')")}, '[,;:!?]{{2,}}', '', 'g')")
BANNERS = "=====\n=====\nRules\n-----\n-----\n-----\nend\n====="
SYS = f"'  Basically ' || text || E'\\n{BANNERS.replace(chr(10), chr(92) + 'n')}'"
SYSLOW = SYS
for _p in (rf"(?i)\b(?:{text.HEDGES})\b", r"[!?.]{3,}", r"\n{4,}", r"^\s+|\s+$"):
    SYSLOW = f"regexp_replace({SYSLOW}, '{_p}', '', 'g')"
SYSLINES = f"string_split({SQL_STRIP.format(COLLAPSE.format(SQL_STRIP.format(SYSLOW)))}, chr(10))"
over_documents(
    "system_minify", lambda c: text.minify_system(F.concat(F.lit("  Basically "), c, F.lit("\n" + BANNERS))),
    f"{SQL_STRIP.format(f"array_to_string(list_transform(list_filter(list_transform(range(1, len({SYSLINES}) + 1), lambda i: {{'a': {SYSLINES}[i], 'b': case when i > 1 then {SYSLINES}[i - 1] end}}), lambda s: not (regexp_matches(trim(s.a), '{text.BANNER}') and s.a is not distinct from s.b)), lambda s: s.a), chr(10))")}",
)
ORACLES["system_minify"] = f"with l as (select doc_id, {SYSLINES} as l from documents where text is not null), u as (select doc_id, unnest(l) as a, generate_subscripts(l, 1) as i from l), k as (select *, lag(a) over (partition by doc_id order by i) as b from u) select doc_id, {SQL_STRIP.format('''string_agg(a, chr(10) order by i)''')} as text from k where not (regexp_matches(trim(a), '{text.BANNER}') and a is not distinct from b) group by doc_id"

HINTED = {0: " security breach", 1: " osint scan", 2: " revenue forecast", 3: " refactor the code", 4: " audit of policy", 5: ""}


def hinted(c: Column) -> Column:
    return F.concat(c, F.create_map(*(F.lit(x) for p in HINTED.items() for x in p))[(F.col("doc_id") % 6).cast("int")])


HINTED_SQL = "lower(text || case doc_id % 6 " + " ".join(f"when {k} then '{v}'" for k, v in HINTED.items()) + " end)"
SCORES = ", ".join(f"{' + '.join(f'cast(contains(t, {chr(39)}{w}{chr(39)}) as int)' for w in words)} as {d}" for d, words in rewrite.DOMAINS.items())
DOMAIN_SQL = f"with t as (select doc_id, {HINTED_SQL} as t from documents where text is not null), s as (select doc_id, {SCORES} from t), b as (select *, greatest({', '.join(rewrite.DOMAINS)}) as best from s), c as (select doc_id, case when best = 0 then 'general' {' '.join(f'when {d} = best then {chr(39)}{d}{chr(39)}' for d in rewrite.DOMAINS)} end as domain from b)"


@query(f"{DOMAIN_SQL} select doc_id, domain from c")
def classify_domain(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", rewrite.classify_domain(hinted(F.col("text"))).alias("domain"))


HINT_SQL = " ".join(f"when '{d}' then '{h}'" for d, h in rewrite.HINTS.items())


@query(f"{DOMAIN_SQL} select doc_id, 'Role: auditor. Style: terse. Domain (' || domain || '): ' || case domain {HINT_SQL} end || ' Rules: a; b {rewrite.ENDING}' as system from c")
def build_system(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", rewrite.build_system(rewrite.classify_domain(hinted(F.col("text"))), "auditor", rules=("a", "b")).alias("system"))


def prompts(spark, sf_dir):
    return turns(spark, sf_dir).where("text is not null").select("request_id", "msg_idx", F.concat(F.lit("Can you please help me with this ?? "), "text", F.lit("\nthank you, in order to fix the the code.")).alias("prompt"))


def phrases_out(c: str) -> str:
    for phrase in rewrite.FILLER:
        c = f"regexp_replace({c}, '(?i)\\b{phrase.replace(chr(39), chr(39) * 2)}\\b', '', 'g')"
    return f"regexp_replace({c}, '\\.{{3,}}', ' ', 'g')"


def fragments_out(c: str) -> str:
    for pattern in (r"\s+,", r",\s*,", r"\s+\.", r"\?{2,}", r"!{2,}"):
        c = f"regexp_replace({c}, '{pattern}', ' ', 'g')"
    return c


def ended_sql(c: str) -> str:
    return f"case when {c} <> '' and not regexp_matches({c}, '[.!?]$') then {c} || '.' else {c} end"


def sentences_sql(c: str) -> str:
    return f"string_split(regexp_replace(regexp_replace({c}, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1))"


#: A word, blanks and the same word again become one blank: each token is put to those before it, or takes two of them along.
REPEATED = "list_reduce(list_transform(regexp_extract_all(x, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+'), lambda t: [t]), lambda a, t: case when len(a) >= 2 and regexp_full_match(a[-1], '\\s+') and a[-2] = t[1] and regexp_full_match(t[1], '[\\p{L}\\p{N}_]+') then a[1:len(a) - 2] || [' '] else a || t end)"
KEY = SQL_STRIP.format("regexp_replace(regexp_replace(lower(t), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')")
REFRAMED = f"""q as (select cast(conv_id as varchar) as request_id, cast(turn as int) as msg_idx, 'Can you please help me with this ?? ' || text || E'\\nthank you, in order to fix the the code.' as c from conversations where text is not null),
r0 as (select *, {phrases_out("c")} as x from q), r1 as (select * replace (array_to_string({REPEATED}, '') as x) from r0), r2 as (select * replace ({fragments_out("x")} as x) from r1),
r3 as (select *, {sentences_sql("x")} as ss from r2), r4 as (select *, list_transform(ss, lambda t: {KEY}) as ks from r3),
r5 as (select request_id, msg_idx, c, {SQL_STRIP.format("regexp_replace(array_to_string(list_transform(list_filter(range(1, len(ss) + 1), lambda i: ks[i] <> '' and list_position(ks, ks[i]) = i), lambda i: " + SQL_STRIP.format("ss[i]") + "), ' '), '\\s+', ' ', 'g')")} as x from r4),
r as (select request_id, msg_idx, c, {ended_sql("(upper(x[1]) || x[2:])")} as r from r5)"""


def shrunk(source: str, most: int) -> str:
    """CTEs that end in k (request_id, msg_idx, c, out), from a CTE of request_id, msg_idx, c."""
    words = lambda c: f"regexp_extract_all(lower({c}), '[a-z0-9]+')"
    return f"""k0 as (select *, list_filter({words("c")}, lambda w: length(w) > 3) as asked, list_filter(list_transform({sentences_sql("r")}, lambda t: {SQL_STRIP.format("t")}), lambda t: t <> '') as f1, list_filter(list_transform({sentences_sql("c")}, lambda t: {SQL_STRIP.format("t")}), lambda t: t <> '') as f2 from {source}),
k1 as (select *, case when len(f1) > 0 then f1 else f2 end as f from k0), k2 as (select request_id, msg_idx, asked, unnest(f) as t, generate_subscripts(f, 1) as i from k1),
k3 as (select *, len(list_filter({words("t")}, lambda w: list_contains(asked, w))) * 2 + len({words("t")}) as score, len(string_split(regexp_replace(t, '\\s+', ' ', 'g'), ' ')) as n from k2),
k4 as (select *, row_number() over w as rank, sum(n) over w as used from k3 window w as (partition by request_id, msg_idx order by score desc, i rows between unbounded preceding and current row)),
k5 as (select request_id, msg_idx, string_agg(t, ' ' order by i) as t from k4 where rank = 1 or used <= {most} group by all),
k as (select k1.request_id, k1.msg_idx, c, case when c = '' or k5.t is null then c else {ended_sql(SQL_STRIP.format("k5.t"))} end as out from k1 left join k5 using (request_id, msg_idx))"""


def over_prompts(name: str, f: Callable[[Column], Column], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: prompts(spark, sf_dir).select("request_id", "msg_idx", f(F.col("prompt")).alias("out"))
    ORACLES[name] = sql


over_prompts("reframe", rewrite.reframe, f"with {REFRAMED} select request_id, msg_idx, r as out from r")
for _mode, _most in rewrite.BUDGETS.items():
    over_prompts(f"shrink_{_mode}", lambda c, m=_mode: rewrite.shrink(c, m), f"with {REFRAMED}, {shrunk('r', _most)} select request_id, msg_idx, out from k")

FRAME_SCORES = ", ".join(f"{' + '.join(f'cast(contains(lower(p), {chr(39)}{w}{chr(39)}) as int)' for w in words)} as {d}" for d, words in rewrite.DOMAINS.items())


@query(
    f"""with {REFRAMED}, z0 as (select request_id, msg_idx, c as p, r as c from r), z1 as (select request_id, msg_idx, p, {phrases_out("c")} as x, c from z0), z2 as (select * replace (array_to_string({REPEATED}, '') as x) from z1), z3 as (select * replace ({fragments_out("x")} as x) from z2),
z4 as (select *, {sentences_sql("x")} as ss from z3), z5 as (select *, list_transform(ss, lambda t: {KEY}) as ks from z4),
z6 as (select *, {SQL_STRIP.format("regexp_replace(array_to_string(list_transform(list_filter(range(1, len(ss) + 1), lambda i: ks[i] <> '' and list_position(ks, ks[i]) = i), lambda i: " + SQL_STRIP.format("ss[i]") + "), ' '), '\\s+', ' ', 'g')")} as y from z5),
z as (select request_id, msg_idx, c, {ended_sql("(upper(y[1]) || y[2:])")} as r from z6), {shrunk("z", rewrite.BUDGETS["balanced"])},
s as (select request_id, msg_idx, {FRAME_SCORES} from z0), b as (select *, greatest({', '.join(rewrite.DOMAINS)}) as best from s), d as (select *, case when best = 0 then 'general' {' '.join(f'when {d} = best then {chr(39)}{d}{chr(39)}' for d in rewrite.DOMAINS)} end as domain from b)
select request_id, msg_idx, regexp_replace({SQL_STRIP.format("regexp_replace(out, '\\s+', ' ', 'g')")}, '[,;:!?]{{2,}}', '', 'g') as tight, 'Role: generalist. Style: terse. Domain (' || domain || '): ' || case domain {HINT_SQL} end || ' {rewrite.ENDING}' as system, domain from k join d using (request_id, msg_idx)"""
)
def frame(spark, sf_dir):
    return prompts(spark, sf_dir).select("request_id", "msg_idx", rewrite.frame(F.col("prompt")).alias("f")).select("request_id", "msg_idx", "f.*")


def event_lines(spark, sf_dir):
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), "event_type", F.lit(" "), F.col("event_id").cast("string"))
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("t"))


LINES = "t as (select user_id, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type || ' ' || event_id, chr(10) order by event_id) as t, list(strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type || ' ' || event_id order by event_id) as l from events group by user_id)"


@query(f"with {LINES}, b as (select user_id, t, case when len(l) >= 20 and length(t) >= 200 then 'log ' || len(l) || ' lines:' || chr(10) || array_to_string(l[1:5], chr(10)) || chr(10) || '...' || chr(10) || array_to_string(l[len(l) - 4:], chr(10)) end as body from t) select user_id, '[compressed] ' || strlen(t) || 'B -> ' || strlen(body) || 'B; ' || body as out from b")
def compress_log(spark, sf_dir):
    t = event_lines(spark, sf_dir)
    return t.select("user_id", F.when(F.length("t") >= compress.LEAST, compress.wrap(F.col("t"), compress.log(F.col("t")))).alias("out"))


@query("with t as (select p_size, list('-rw-r--r-- 1 u g ' || p_size || ' Jan 1 12:00 ' || replace(p_name, ' ', '_') order by p_partkey) as l, list(replace(p_name, ' ', '_') order by p_partkey) as names from part group by p_size), b as (select p_size, array_to_string(l, chr(10)) as t, case when len(l) >= 8 then 'dir listing: ' || array_to_string(names[1:60], ', ') || case when len(names) > 60 then ' ... (+' || (len(names) - 60) || ' more)' else '' end end as body from t) select p_size, case when length(t) >= 200 then '[compressed] ' || strlen(t) || 'B -> ' || strlen(body) || 'B; ' || body end as out from b")
def compress_listing(spark, sf_dir):
    line = F.concat(F.lit("-rw-r--r-- 1 u g "), F.col("p_size").cast("string"), F.lit(" Jan 1 12:00 "), F.replace("p_name", F.lit(" "), F.lit("_")))
    t = read(spark, sf_dir, "part").groupBy("p_size").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    return t.select("p_size", compress.compress_text(F.col("t")).alias("out"))


CODE = "import os\n\n# comment\n// other\n#!keep\ndef f(x):\n    return x\n\nclass A:\n    pass\nif x:\n    y = 1   \n"
CODE_SQL = "E'" + CODE.replace("\n", "\\n") + "' || replace(text, chr(13), ' ')"


@query(f"with t as (select doc_id, {CODE_SQL} as t from documents where text is not null), u as (select doc_id, t, unnest(string_split(regexp_replace(t, '\\n$', ''), chr(10))) as a, generate_subscripts(string_split(regexp_replace(t, '\\n$', ''), chr(10)), 1) as i from t), k as (select *, row_number() over (partition by doc_id order by i) as r from u where trim(a, E' \\t\\n\\r\\f') <> '' and (not regexp_matches(ltrim(a), '^(//|#)') or regexp_matches(ltrim(a), '^(#!|#pragma)'))), b as (select doc_id, any_value(t) as t, 'source:' || chr(10) || string_agg(left(regexp_replace(a, '\\s+$', ''), 160), chr(10) order by i) as body from k where r <= 60 group by doc_id) select doc_id, case when length(t) >= 200 then '[compressed] ' || strlen(t) || 'B -> ' || strlen(body) || 'B; ' || body end as out from b")
def compress_source(spark, sf_dir):
    t = F.concat(F.lit(CODE), F.replace("text", F.lit("\r"), F.lit(" ")))
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.when(F.length(t) >= compress.LEAST, compress.wrap(t, compress.source(t))).alias("out"))


@query("with t as (select user_id, E'[\\n' || string_agg('        {\"id\":    ' || event_id || ',    \"type\":    \"' || event_type || '\"}', E',\\n' order by event_id) || E'\\n]' as t, '[' || string_agg('{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}', ',' order by event_id) || ']' as c from events group by user_id) select user_id, case when length(t) >= 200 and length(c) < 0.85 * length(t) then '[compressed] ' || strlen(t) || 'B -> ' || strlen('json: ' || left(c, 4000)) || 'B; json: ' || left(c, 4000) end as out from t")
def compress_json(spark, sf_dir):
    row = F.concat(F.lit('        {"id":    '), F.col("event_id").cast("string"), F.lit(',    "type":    "'), "event_type", F.lit('"}'))
    t = read(spark, sf_dir, "events").groupBy("user_id").agg(F.concat(F.lit("[\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", row.alias("r")))), lambda x: x["r"]), ",\n"), F.lit("\n]")).alias("t"))
    return t.withColumn("j", compress.compact_json("t")).select("user_id", compress.compress_text(F.col("t"), F.col("j")).alias("out"))


REPORT = "'commit ' || doc_id || E'\\nAuthor: a\\nDate: d\\n\\n+' || replace(regexp_replace(replace(text, chr(13), ' '), '\\n$', ''), chr(10), E'\\n+')"


@query(f"with t as (select doc_id, {REPORT} as t from documents where text is not null), l as (select doc_id, t, list_transform(list_filter(string_split(t, chr(10)), lambda x: x <> ''), lambda x: case when x[1] = '+' then left({SQL_STRIP.format('x')}, 120) else x end) as l from t), b as (select doc_id, t, 'git: ' || array_to_string(l[1:60], ' | ') as body from l) select doc_id, case when length(t) >= 200 then '[compressed] ' || strlen(t) || 'B -> ' || strlen(body) || 'B; ' || body end as out from b")
def compress_git(spark, sf_dir):
    lines = F.replace(F.regexp_replace(F.replace("text", F.lit("\r"), F.lit(" ")), r"\n\z", ""), F.lit("\n"), F.lit("\n+"))
    t = F.concat(F.lit("commit "), F.col("doc_id").cast("string"), F.lit("\nAuthor: a\nDate: d\n\n+"), lines)
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", compress.compress_text(t).alias("out"))


def dom_sql(c: str) -> str:
    for tag in dom.TAGS:
        for p in (f"(?is)<{tag}[^>]*>.*?</{tag}>", f"(?i)<{tag}[^>]*/>", f"(?i)<{tag}[^>]*>"):
            c = f"regexp_replace({c}, '{p}', '', 'g')"
    for part in dom.PARTS:
        c = f"regexp_replace({c}, '(?is)<{part}[^>]*>.*?</{part}>', '', 'g')"
    c = f"regexp_replace({c}, '(?is)<div[^>]*class=\"[^\"]*(?:{'|'.join(dom.CLASSES)})[^\"]*\"[^>]*>.*?</div>', '', 'g')"
    c = f"regexp_replace({c}, '\\s+(?:data|aria)-[a-zA-Z_-]+=\"[^\"]*\"', '', 'g')"
    for name in dom.ATTRIBUTES:
        c = f"regexp_replace({c}, '\\s+{name}=\"[^\"]*\"', '', 'g')"
    for tags, new in ((dom.BREAKS, "chr(10)"), (dom.SPACES, "' '")):
        for tag in tags:
            c = f"regexp_replace({c}, '(?i)</?{tag}[^>]*>', {new}, 'g')"
    for e, x in dom.ENTITIES.items():
        c = f"replace({c}, '{e}', '{x}')"
    return SQL_STRIP.format(COLLAPSE.format(c))


#: The tables' pages have no element of the class names that go, so each gets one.
ASIDE = '<div id="x" class="left sidebar-2">to go <b>too</b></div> <p class="plain">stays</p> '


@query(f"with p as (select page_id, {dom_sql(f"('{ASIDE}' || html)")} as t from pages where html is not null) select page_id, case when length(t) > 8000 then left(t, 4000) || E'\\n... [truncated] ...\\n' || right(t, 2000) else t end as t from p")
def html_prune(spark, sf_dir):
    return read(spark, sf_dir, "pages").where("html is not null").select("page_id", dom.prune(F.concat(F.lit(ASIDE), "html")).alias("t"))


@query("select page_id, length(html) > 4096 and regexp_matches(html, '(?i)<(?:html|!doctype|body|div|script)\\b') as gate from pages where html is not null")
def html_gate(spark, sf_dir):
    return read(spark, sf_dir, "pages").where("html is not null").select("page_id", dom.looks_like_page(F.col("html")).alias("gate"))


RETRIEVE = "w as (select item_id as query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) as word from benchmark), v as (select conv_id * 100 + turn as entry_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) as word from conversations)"


@query(f"with {RETRIEVE}, s as (select query_id, entry_id, count(*) as score from w join v using (word) group by all), r as (select *, row_number() over (partition by query_id order by score desc, entry_id) as rank from s) select query_id, entry_id, score, rank from r where rank <= 10")
def retrieve_topk(spark, sf_dir):
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    e = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("entry_id"), F.col("text").alias("content"))
    return memory.retrieve(q, e)


def entries(spark, sf_dir):
    return read(spark, sf_dir, "conversations").where("text is not null").select((F.col("conv_id") % 10).alias("ctx_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("entry_idx"), "role", F.col("text").alias("content"))


VERBOSE = "case when length(text) <= 200 then text when len({0}) <= 3 then left(text, 200) || '...' else {0}[1] || ' ' || {0}[2] || ' ... ' || {0}[len({0})] end".format(SENT)


@query(f"""with e as (select conv_id % 10 as ctx_id, conv_id * 100 + turn as entry_idx, role, text, {VERBOSE} as short from conversations where text is not null),
o as (select *, row_number() over (partition by ctx_id order by entry_idx) as place, count(*) over (partition by ctx_id) as n from e),
s as (select *, case when lag(role) over (partition by ctx_id order by entry_idx) = role then 1 else 0 end as same from o where place <= n - 20),
i as (select *, sum(same) over (partition by ctx_id order by entry_idx) as island from s),
p as (select *, (row_number() over (partition by ctx_id, island order by entry_idx) - 1) // 2 as pair from i),
g as (select ctx_id, min(entry_idx) as entry_idx, list(role order by entry_idx) as r, list(short order by entry_idx) as c from p group by ctx_id, island, pair)
select ctx_id, entry_idx, 'summary' as role, case when len(r) = 1 then '[' || r[1] || ': ' || left(c[1], 150) || '...]' else '[' || r[1] || ': ' || left(c[1], 100) || '... → ' || r[2] || ': ' || left(c[2], 100) || '...]' end as content from g
union all select ctx_id, entry_idx, role, text from o where place > n - 20""")
def summarize_turns(spark, sf_dir):
    return memory.summarize(entries(spark, sf_dir))


def plain_sql(c: str) -> str:
    """Without phrases of low value and runs of white space."""
    for pattern in (rf"(?i)\b(?:{text.HEDGES})\b", r"[!?.]{3,}", r"\n{4,}"):
        c = f"regexp_replace({c}, '{pattern}', '', 'g')"
    return SQL_STRIP.format(COLLAPSE.format(SQL_STRIP.format(c)))


NOTE = "case when length(text) > 300 then left(text, 300) || '...' else text end"


@query(f"""with sm as ({ORACLES["summarize_turns"]}),
c0 as (select doc_id % 10 as ctx_id, lang as category, doc_id as entry_idx, coalesce('source: ' || source || chr(10), '') || 'note: ' || (select {NOTE} from (select coalesce(documents.text, '') as text)) as raw from documents),
c1 as (select ctx_id, row_number() over (partition by ctx_id order by category nulls first, entry_idx) as pos, nullif({plain_sql("raw")}, '') as line from c0),
w1 as (select ctx_id, entry_idx as pos, role, {plain_sql("coalesce(content, '')")} as line from sm),
l as (select 0 as warm, ctx_id, pos, line, 2 as sep from c1 where line is not null union all select 1, ctx_id, pos, coalesce(role, 'user') || ': ' || line, 1 from w1 where line <> ''),
j as (select warm, ctx_id, string_agg(line, E'\\n\\n' order by pos) as t from (select * from l where warm = 0) group by all union all select warm, ctx_id, string_agg(line, E'\\n' order by pos) as t from (select * from l where warm = 1) group by all),
x as (select ctx_id, count(*) as cold_before from c0 group by all), y as (select conv_id % 10 as ctx_id, count(*) as warm_before from conversations where text is not null group by all),
t0 as (select coalesce(x.ctx_id, y.ctx_id) as ctx_id, coalesce(cold_before, 0) as cold_before, coalesce(warm_before, 0) as warm_before from x full join y on x.ctx_id = y.ctx_id),
t1 as (select t0.*, coalesce(c.t, '') as c, coalesce(w.t, '') as w from t0 left join (select * from j where warm = 0) c on c.ctx_id = t0.ctx_id left join (select * from j where warm = 1) w on w.ctx_id = t0.ctx_id),
t2 as (select *, greatest(1, length(c) // 4) as ct, greatest(1, length(w) // 4) as wt from t1),
t3 as (select *, ct + wt as before, cast(floor(2000 * (wt / (ct + wt))) as bigint) as ws, 2000 - cast(floor(2000 * (wt / (ct + wt))) as bigint) as cs from t2),
s as (select l.*, sum(greatest(1, length(line) // 4)) over o as used, row_number() over o as nth from l window o as (partition by warm, ctx_id order by pos rows between unbounded preceding and current row)),
k as (select s.*, nth = 1 or used <= case warm when 1 then ws else cs end as keep from s join t3 using (ctx_id)),
kc as (select ctx_id, string_agg(line, E'\\n\\n' order by pos) filter (keep) as cc, count(*) filter (keep) as ck from k where warm = 0 group by all),
kw as (select ctx_id, string_agg(line, E'\\n' order by pos) filter (keep) as wc, count(*) filter (keep) as wk, count(*) as wl from k where warm = 1 group by all),
u as (select t3.*, cc, ck, wc, wk, wl from t3 left join kc using (ctx_id) left join kw using (ctx_id)),
v as (select *, case when before > 2000 and ct > cs and cc is not null then cc || case when cold_before - ck > 0 then chr(10) || '... (' || (cold_before - ck) || ' more entries truncated)' else '' end else c end as cold_text, case when before > 2000 and wt > ws and wc is not null then wc || case when wl - wk > 0 then chr(10) || '... (' || (wl - wk) || ' more entries truncated)' else '' end else w end as warm_text from u)
select ctx_id, cold_text, warm_text, concat_ws(E'\\n\\n', case when cold_text <> '' then '<cold_memory>' || chr(10) || cold_text || chr(10) || '</cold_memory>' end, case when warm_text <> '' then '<recent_context>' || chr(10) || warm_text || chr(10) || '</recent_context>' end) as block, cold_before, warm_before, coalesce(wl, 0) as warm_after, before as tokens_before, greatest(1, length(cold_text) // 4) + greatest(1, length(warm_text) // 4) as tokens_after from v""")
def prune_context(spark, sf_dir):
    kv = F.array(F.struct(F.lit("id").alias("k"), F.col("doc_id").cast("string").alias("v")), F.struct(F.lit("source").alias("k"), F.col("source").alias("v")), F.struct(F.lit("note").alias("k"), F.coalesce("text", F.lit("")).alias("v")))
    cold = read(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("ctx_id"), F.col("lang").alias("category"), F.col("doc_id").alias("entry_idx"), kv.alias("kv"), F.lit(None).cast("string").alias("value"))
    return memory.prune_context(cold, entries(spark, sf_dir))


def flat_messages(spark, sf_dir):
    """Conversations as flat roles: every fourth turn is a tool's, assistants call tools."""
    t = turns(spark, sf_dir)
    role = F.when(F.col("msg_idx") % 4 == 3, "tool").otherwise(F.col("role"))
    calls = F.when(role == "assistant", F.concat(F.lit('[{"id":"c'), F.col("msg_idx").cast("string"), F.lit('","function":{"name":"f","arguments":"{\\"k\\":1}"}}]')))
    return t.select("request_id", "msg_idx", role.alias("role"), F.lit("str").alias("kind"), F.coalesce("text", F.lit("")).alias("content"), calls.alias("tool_calls"), F.concat(F.lit("c"), (F.col("msg_idx") - 1).cast("string")).alias("tool_call_id"), F.lit(None).cast("string").alias("raw_json"))


FLAT = "f as (select cast(conv_id as varchar) as request_id, cast(turn as int) as msg_idx, case when turn % 4 = 3 then 'tool' else role end as role, coalesce(text, '') as text from conversations), h as (select *, case when role = 'tool' and lag(role) over (partition by request_id order by msg_idx) = 'tool' then 0 else 1 end as start from f where role <> 'system'), c as (select request_id, role, text, msg_idx as old, cast(sum(start) over (partition by request_id order by msg_idx) - 1 as int) as msg_idx from h), b as (select request_id, msg_idx, cast(row_number() over (partition by request_id, msg_idx order by old) - 1 as int) as blk_idx, 'user' as role, 'tool_result' as type, text, 'c' || (old - 1) as tool_id from c where role = 'tool' union all select request_id, msg_idx, 0, 'assistant', 'text', text, null from c where role = 'assistant' and text <> '' union all select request_id, msg_idx, 1, 'assistant', 'tool_use', null, 'c' || old from c where role = 'assistant' union all select request_id, msg_idx, -1, 'user', 'str', text, null from c where role = 'user')"


@query(f"with {FLAT} select request_id, msg_idx, cast(blk_idx as int) as blk_idx, role, type, text, tool_id from b")
def adapters_to_canonical(spark, sf_dir):
    blocks, _ = adapters.to_canonical(flat_messages(spark, sf_dir))
    return blocks.select("request_id", "msg_idx", "blk_idx", "role", "type", F.coalesce("text", "tr_text").alias("text"), "tool_id")


@query("with m as (select cast(conv_id as varchar) as request_id, turn, case when turn % 4 = 3 then 'tool' else role end as role, coalesce(text, '') as text from conversations), s as (select request_id, -1 as turn, 'system' as role, string_agg(text, chr(10) || chr(10) order by turn) as content, 0 as n_calls from m where role = 'system' and text <> '' group by request_id), a as (select request_id, turn, role, case when role = 'assistant' and text = '' then null else text end as content, case when role = 'assistant' then 1 else 0 end as n_calls from m where role <> 'system' union all select * from s) select request_id, cast(row_number() over (partition by request_id order by turn) - 1 as int) as msg_idx, role, content, cast(n_calls as int) as n_calls from a")
def adapters_from_canonical(spark, sf_dir):
    blocks, systems = adapters.to_canonical(flat_messages(spark, sf_dir))
    return adapters.from_canonical(blocks, systems).select("request_id", "msg_idx", "role", "content", F.coalesce(F.size("tool_calls"), F.lit(0)).alias("n_calls"))


@query("select event_id, case when event_id % 3 = 0 then 0 else event_id % 100 end as prompt, case when event_id % 3 = 0 then 0 else user_id end as completion from events")
def usage_extract(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    body = F.when(F.col("event_id") % 3 == 0, F.lit("event: ping\ndata: {}\n")).otherwise(F.concat(F.lit('event: x\ndata: {"usage":{}}\ndata: {"usage":{"prompt_tokens":'), (F.col("event_id") % 100).cast("string"), F.lit(',"completion_tokens":'), F.col("user_id").cast("string"), F.lit("}}\ndata: [DONE]\n")))
    return e.select("event_id", response.usage(body).alias("u")).select("event_id", "u.prompt", "u.completion")


@query("select count(*) as runs, cast(sum(event_id) as bigint) as tokens_in, cast(sum(event_id - event_id % 7) as bigint) as tokens_out, cast(sum(event_id % 7) as bigint) as saved, round(sum(event_id % 7) / sum(event_id), 4) as ratio from events")
def stats_rollup(spark, sf_dir):
    return cumulative(read(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("event_id").alias("tokens_in"), (F.col("event_id") - F.col("event_id") % 7).alias("tokens_out")))


@query("select event_id, cast(sum(event_id % 7) over (partition by user_id order by event_id rows between 59 preceding and current row) as bigint) as saved_last_60 from events")
def last_60(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-59, 0)
    return read(spark, sf_dir, "events").select("event_id", F.sum(F.col("event_id") % 7).over(w).alias("saved_last_60"))


@query("select event_id as request_id, greatest(t1, 0) as read_s, greatest(t2 - t1, 0) as optimize_s, greatest(t3 - t2, 0) as first_byte_s, greatest(t4 - t3, 0) as stream_s, greatest(t4, 0) as total_s from (select event_id, value as t1, value + user_id as t2, user_id * 2.5e0 as t3, value * 3e0 as t4 from events)")
def latency(spark, sf_dir):
    v, u = F.col("value"), F.col("user_id")
    e = read(spark, sf_dir, "events")
    return response.latencies(e.select(F.col("event_id").alias("request_id"), F.lit(0.0).alias("t0"), v.alias("t1"), (v + u).alias("t2"), (u * 2.5).alias("t3"), (v * 3.0).alias("t4")))


@query("select count(*) as requests, cast(sum(event_id % 100) as bigint) as prompt, cast(sum(user_id) as bigint) as completion, sum(user_id) / cast(sum(event_id % 8) * 0.125e0 as double) as tokens_per_s, max_by(user_id / ((event_id % 8) * 0.125e0), event_id) filter (event_id % 8 > 0 and user_id > 0) as last_tokens_per_s from events")
def usage_totals(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return response.totals(e.select(F.col("event_id").alias("seq"), (F.col("event_id") % 100).alias("prompt"), F.col("user_id").alias("completion"), ((F.col("event_id") % 8) * 0.125).alias("elapsed_s")))


#: Code points of a text in a frame, and of the wire in a chunk, which cuts frames anywhere.
PIECE, CHUNK = 50, 333


def cut(c: Column, size: int) -> Column:
    """A text in pieces of a fixed size; an empty one is one empty piece."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(c) - 1, F.lit(0)) / size).cast("int")), lambda i: F.substring(c, i * size + 1, F.lit(size)))


@query("select cast(conv_id as varchar) || '-' || turn as stream_id, cast(length(text) + 3 as bigint) as n_chars, sha256(text || 'STO') as text from conversations where text is not null")
def stream_filter(spark, sf_dir):
    t = turns(spark, sf_dir).where("text is not null")
    pieces = F.concat(F.array(F.lit("Su"), F.lit("re!\n")), cut(F.col("text"), PIECE), F.array(F.lit("STO"), F.lit("P it")))
    wire = F.array_join(F.transform(pieces, lambda p: F.concat(F.lit("data: "), F.to_json(F.struct(F.struct(p.alias("text")).alias("delta"))), F.lit("\n\n"))), "")
    streams = t.select(F.concat_ws("-", "request_id", F.col("msg_idx").cast("string")).alias("stream_id"), wire.alias("wire"))
    chunks = streams.select("stream_id", F.posexplode(cut(F.col("wire"), CHUNK)).alias("seq", "chunk")).withColumn("seq", F.col("seq").cast("long"))
    sent = response.filter_chunks(chunks, response.Levers(stops=("STOP",))).withColumn("text", F.get_json_object(F.substring("frame", 7, 1 << 30), "$.delta.text"))
    whole = sent.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part", "text"))), lambda x: x["text"]), "").alias("text"))
    return whole.select("stream_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text"))


#: A model for each brand of part, sized by that brand's parts: memory, weights, bytes of cache a token, trained context.
MODEL_SQL = "brands as (select cast(regexp_replace(p_brand, '[^0-9]', '', 'g') as bigint) as model_id, p_brand as name, max(p_size) as most, count(*) as n, min(p_partkey) as first from part group by p_brand), m as (select model_id, name, case model_id % 3 when 0 then 4e0 when 1 then 8e0 else 16e0 end as vram_gb, cast(most * (1 + n % 3) as double) / 16 as size_gb, 4096 * (1 + first % 20) as kv_bytes, 65536 * (1 + n % 4) as native_ctx from brands)"


def brand_models(spark, sf_dir) -> DataFrame:
    b = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.max("p_size").alias("most"), F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    b = b.withColumn("model_id", F.regexp_replace("name", "[^0-9]", "").cast("long"))
    tier = F.when(F.col("model_id") % 3 == 0, 4.0).when(F.col("model_id") % 3 == 1, 8.0).otherwise(16.0)
    size = (F.col("most") * (1 + F.col("n") % 3)).cast("double") / 16
    return b.select("model_id", "name", tier.alias("vram_gb"), size.alias("size_gb"), (4096 * (1 + F.col("first") % 20)).alias("kv_bytes"), (65536 * (1 + F.col("n") % 4)).alias("native_ctx"))


SIZED = f"{MODEL_SQL}, k as (select unnest({catalog.CONTEXTS}) as ctx), u as (select unnest({catalog.BATCHES}) as ub), w as (select *, size_gb * 1.05 as w, vram_gb - size_gb * 1.05 - (0.4 + {{free}}) as free from m), f as (select model_id, max_by(struct_pack(ctx := ctx, ub := ub), ctx::bigint * 10000 + ub) as best from w, k, u where ctx <= native_ctx and ctx::double * kv_bytes / 1073741824.0 + ub * 0.00084 <= free group by model_id), r as (select w.*, case when free > 0 then coalesce(best.ctx, 16384) else 8192 end as ctx, case when free > 0 then coalesce(best.ub, 512) else 512 end as ub, free > 0 as offload from w left join f using (model_id))"


@query(f"with {SIZED.format(free=1.0)} select model_id, cast(ctx as int) as ctx, cast(ub as int) as ub, offload from r")
def recommend(spark, sf_dir):
    return catalog.recommend(brand_models(spark, sf_dir)).select("model_id", "ctx", "ub", "offload")


@query(f"with {MODEL_SQL} select model_id, name, cast(vram_gb as double) as vram_gb from m where vram_gb = 8")
def presets(spark, sf_dir):
    return brand_models(spark, sf_dir).where("vram_gb = 8").select("model_id", "name", "vram_gb")


@query(f"with {MODEL_SQL} select cast(vram_gb as double) as tier_gb, string_agg(name, ',' order by model_id) as names from m group by all")
def presets_by_tier(spark, sf_dir):
    return catalog.presets_by_tier(brand_models(spark, sf_dir)).select("tier_gb", F.array_join("names", ",").alias("names"))


@query(f"with {SIZED.format(free=1.0)} select model_id, 'llama-server -m ' || name || ' -c ' || ctx || ' -ngl 999 -fa on -ctk q4_0 -ctv q4_0 -np 1 -b 2048 -ub ' || ub || ' --alias tarnmill --host 127.0.0.1 --port 8080 --kv-unified' || case when offload then '' else ' --no-kv-offload' end as command from r")
def server_commands(spark, sf_dir):
    return catalog.recommend(brand_models(spark, sf_dir)).select("model_id", catalog.server_command(F.col("name")).alias("command"))


@query(f"with {SIZED.format(free=0.3)}, e as (select *, cast(floor(ctx / (1 - 85.4 / 100)) as bigint) as effective_ctx from r), b as (select *, row_number() over (partition by vram_gb order by effective_ctx desc, model_id) as n from e) select vram_gb as tier_gb, model_id, effective_ctx from b where n = 1")
def context_presets(spark, sf_dir):
    sized = catalog.recommend(brand_models(spark, sf_dir), 0.3).withColumn("effective_ctx", catalog.effective_context(F.col("ctx"), F.lit(85.4))).withColumn("tier_gb", F.col("vram_gb"))
    return catalog.best_for_tier(sized).select("tier_gb", "model_id", "effective_ctx")


WHAT = "'Use this tool to find parts. ' || repeat(p_name, 12) || E'\\n\\n\\n\\n```sh\\na\\n```\\nmore\\n```sh\\nb\\n```\\n'"


@query(f"""select p_partkey, p_name as name, case when length({WHAT}) >= 200 then {SQL_STRIP.format("repeat(p_name, 12)")} || E'\\n\\n```sh\\na\\n```\\nmore' else {WHAT} end as description, '{{"type":"object","properties":{{"a":{{"type":"string"}}}}}}' as schema_json from part""")
def tool_minify(spark, sf_dir):
    t = read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.concat(F.lit("Use this tool to find parts. "), F.repeat("p_name", F.lit(12)), F.lit("\n\n\n\n```sh\na\n```\nmore\n```sh\nb\n```\n")).alias("description"), F.lit('{"type":"object","title":"T","properties":{"a":{"type":"string","examples":["x"]}},"$comment":"c"}').alias("schema_json"), "p_partkey")
    return tools.minify_tools(t)


def conversation_blocks(spark, sf_dir):
    none = F.lit(None).cast("string")
    return turns(spark, sf_dir).select("request_id", "msg_idx", F.lit(-1).alias("blk_idx"), "role", F.lit("str").alias("type"), "text", *(none.alias(c) for c in ("tool_id", "tool_name", "input_json", "tr_text", "tr_json", "raw_json", "msg_json")))


EST = "case when length({0}) = 0 then 0 else greatest(1, length({0}) // 4) end"
SLIM = "regexp_replace({0}, '^\\n+|\\n+$', '', 'g')".format(BLANKS.format("text"))


@query(f"""with {MSGS}, a as (select request_id, msg_idx, tok, {SLIM} as text, row_number() over (partition by request_id order by msg_idx) - 1 as place, count(*) over (partition by request_id) as n from m),
s as (select request_id, msg_idx, tok as tok_in, place, n, case when n >= 2 and place < n - 2 and length(text) > 360 then {DISTILL} else text end as text, n >= 2 and place < n - 2 and length(text) > 360 as old from a),
t as (select *, cast({TOK} as bigint) as tok from s), p as (select *, cast(coalesce(sum(tok) over (partition by request_id order by msg_idx rows between unbounded preceding and 1 preceding), 0) as bigint) as prefix, cast(sum(tok) over (partition by request_id) as bigint) as total from t), v as (select *, true as valid from p),
g as (select request_id, max(n) as n, max(total) as total, cast(sum(tok_in) as bigint) as tokens_in, count(*) filter (old) as distill_count, min(place) filter (place >= 1 and place <= n - 2 and total - prefix <= 400) as least, max(place) filter (place >= 1 and place <= n - 2) as most from v group by request_id),
d as (select *, case when total <= 400 or n <= 2 then 0 else coalesce(least, most, 0) end as dropped from g)
select d.request_id, tokens_in, d.total - prefix as tokens_out, distill_count, cast(dropped as bigint) as budget_dropped from d join v on d.request_id = v.request_id and v.place = d.dropped""")
def optimize_requests(spark, sf_dir):
    stats = optimize(conversation_blocks(spark, sf_dir), Config(token_budget=BUDGET, keep_last=KEEP)).stats
    return stats.select("request_id", "tokens_in", "tokens_out", "distill_count", "budget_dropped")


#: Every conversation as a body in three formats, each of them twice.
FORMATS = {"anthropic": "/v1/messages", "openai": "/v1/chat/completions", "ollama": "/api/chat"}


def conversation_bodies(spark, sf_dir) -> DataFrame:
    message = F.struct("msg_idx", "role", F.coalesce("text", F.lit("")).alias("content"))
    b = turns(spark, sf_dir).groupBy("request_id").agg(F.array_sort(F.collect_list(message)).alias("m"))
    body = F.to_json(F.named_struct(F.lit("model"), F.lit("any"), F.lit("messages"), F.transform("m", lambda x: F.named_struct(F.lit("role"), x["role"], F.lit("content"), x["content"]))))
    paths = F.array(*(F.named_struct(F.lit("fmt"), F.lit(f), F.lit("path"), F.lit(p), F.lit("copy"), F.lit(c)) for f, p in FORMATS.items() for c in (0, 1)))
    return b.select("request_id", body.alias("body"), F.explode(paths).alias("x")).select(F.concat_ws("-", "request_id", "x.fmt", F.col("x.copy").cast("string")).alias("request_id"), "body", "x.path")


@query(f"""with src as (select cast(conv_id as varchar) as conv, cast(turn as int) as i, role, coalesce(text, '') as text from conversations), f(fmt, flat) as (values ('anthropic', false), ('openai', true), ('ollama', true)),
r as (select conv || '-' || fmt as rid, flat, i, role, text from src, f), y as (select rid, string_agg(text, E'\\n\\n' order by i) filter (text <> '') as said from r where flat and role = 'system' group by rid),
z as (select distinct r.rid, coalesce(said, '') as said, case when said is null then '' else {plain_sql("said")} end as told from r left join y on r.rid = y.rid),
m as (select rid, text as was, place, n, case when n >= 2 then {SLIM} else text end as text from (select *, row_number() over (partition by rid order by i) - 1 as place, count(*) over (partition by rid) as n from r where not flat or (role <> 'system' and not (role = 'assistant' and text = '')))),
d as (select *, n >= 2 and place < n - 2 and length(text) > 360 as old, case when n >= 2 and place < n - 2 and length(text) > 360 then {DISTILL} else text end as now from m),
t as (select *, 4 + {EST.format("was")} as tok_in, 4 + {EST.format("now")} as tok from d), p as (select *, coalesce(sum(tok) over (partition by rid order by place rows between unbounded preceding and 1 preceding), 0) as prefix from t),
g as (select z.rid, any_value(told) as told, coalesce(max(n), 0) as n, coalesce(sum(tok_in), 0) + any_value({EST.format("said")}) as tokens_in, coalesce(sum(tok), 0) + any_value({EST.format("told")}) as total, count(*) filter (was <> text) as messages_minified, count(*) filter (old) as distill_count from z left join p on z.rid = p.rid group by z.rid),
l as (select g.rid, min(place) filter (place >= 1 and place <= g.n - 2 and total - prefix <= {BUDGET}) as least, max(place) filter (place >= 1 and place <= g.n - 2) as most from g left join p on g.rid = p.rid group by g.rid),
k as (select g.*, case when total <= {BUDGET} or n <= 2 then 0 else coalesce(least, most, 0) end as gone from g join l using (rid)),
o as (select k.rid, any_value(tokens_in) as tokens_in, coalesce(sum(tok) filter (place >= gone), 0) + any_value({EST.format("told")}) as tokens_out, any_value(messages_minified) as messages_minified, any_value(distill_count) as distill_count, any_value(gone) as budget_dropped,
  count(*) filter (place >= gone) + any_value(case when told <> '' then 1 else 0 end) as n_messages, sha256(any_value(case when told <> '' then told || chr(1) else '' end) || coalesce(string_agg(now || chr(1), '' order by place) filter (place >= gone), '')) as texts from k left join p on k.rid = p.rid group by k.rid)
select rid || '-' || c as request_id, {", ".join(f"cast({c} as bigint) as {c}" for c in ("tokens_in", "tokens_out", "messages_minified", "distill_count", "budget_dropped", "n_messages"))}, texts from o, (values (0), (1)) v(c)""")
def minify_bodies(spark, sf_dir):
    return told(minify(conversation_bodies(spark, sf_dir), Config(token_budget=BUDGET, keep_last=KEEP)))


@query(ORACLES["minify_bodies"])
def minify_bodies_once(spark, sf_dir):
    return told(minify_once(conversation_bodies(spark, sf_dir), Config(token_budget=BUDGET, keep_last=KEEP)))


def told(done: DataFrame) -> DataFrame:
    """Counts of minified bodies, and a digest of their texts."""
    said = F.from_json("body", "messages array<struct<role:string,content:string>>")["messages"]
    texts = F.sha2(F.array_join(F.transform(said, lambda x: F.concat(x["content"], F.lit("\u0001"))), "").cast("binary"), 256)
    return done.select("request_id", "tokens_in", "tokens_out", "messages_minified", "distill_count", "budget_dropped", F.size(said).cast("long").alias("n_messages"), texts.alias("texts"))


#: Requests with pairs: of three messages of a conversation in a row the second uses a tool, the third has its result, which
#: is the same long text in all of a conversation.
ROWS = "repeat('a row of the result ', 20) || request_id"


def paired_tables(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy("msg_idx")) - 1)
    third = F.col("place") % 3
    none = F.lit(None).cast("string")
    call = F.concat(F.lit("c"), (F.col("place") - F.when(third == 2, 1).otherwise(0)).cast("string"))
    blocks = t.select(
        "request_id", "msg_idx", F.when(third == 0, -1).otherwise(0).alias("blk_idx"), F.when(third == 1, "assistant").otherwise("user").alias("role"), F.when(third == 0, "str").when(third == 1, "tool_use").otherwise("tool_result").alias("type"), F.when(third == 0, F.coalesce("text", F.lit(""))).alias("text"),
        F.when(third > 0, call).alias("tool_id"), F.when(third == 1, "f").alias("tool_name"), F.when(third == 1, F.concat(F.lit('{"k":'), F.col("place").cast("string"), F.lit("}"))).alias("input_json"),
        F.when(third == 2, F.concat(F.repeat(F.lit("a row of the result "), F.lit(20)), "request_id")).alias("tr_text"), none.alias("tr_json"), none.alias("raw_json"), none.alias("msg_json"),
    )
    one = t.select("request_id").distinct()
    systems = one.select("request_id", F.lit(-1).alias("blk_idx"), F.concat(F.lit("Basically be brief.\n\n\n\nServe "), "request_id").alias("text"), none.alias("raw_json"))
    tool = one.select("request_id", F.lit(0).alias("tool_idx"), F.lit("f").alias("name"), F.lit("short").alias("description"), F.lit('{"type":"object","title":"F"}').alias("schema_json"), F.lit('{"name":"f","description":"short","input_schema":{"type":"object","title":"F"}}').alias("raw_json"))
    return blocks, systems, tool


@query(f"""with m as (select cast(conv_id as varchar) as request_id, cast(turn as int) as msg_idx, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn) - 1 as place, count(*) over (partition by conv_id) as n from conversations),
b as (select *, place % 3 as third, {ROWS} as res, max(case when place % 3 = 2 then place end) over (partition by request_id) as last_res, {SLIM} as slim from m),
s as (select *, third = 0 and n >= 2 and place < n - 2 and length(slim) > 360 as old, third = 2 and place < last_res as stub from b),
u as (select *, case when old then (select {DISTILL.replace("text", "s2.slim")} from (select s.slim) s2) else slim end as now from s),
t as (select *, 4 + case third when 0 then {EST.format("text")} when 1 then 1 + 0 * place else {EST.format("res")} end as tok_in,
  4 + case third when 0 then case when n >= 2 then {EST.format("now")} else {EST.format("text")} end when 1 then greatest(1, length('{{"k":' || place || '}}') // 4) else case when stub then length('[identical to a later tool_result; omitted ' || length(res) || ' chars]') // 4 else {EST.format("res")} end end as tok from u),
w as (select *, greatest(1, length('{{"k":' || place || '}}') // 4) + 4 as use_tok from t),
x as (select *, case third when 1 then use_tok else tok_in end as tok_before, length('Basically be brief.' || E'\\n\\n\\n\\n' || 'Serve ' || request_id) // 4 + 1 + 29 // 4 + 8 as fixed_in, length('be brief.Serve ' || request_id) // 4 + 1 + 17 // 4 + 8 as fixed_out from w),
p as (select *, cast(coalesce(sum(tok) over (partition by request_id order by msg_idx rows between unbounded preceding and 1 preceding), 0) as bigint) as prefix, cast(sum(tok) over (partition by request_id) as bigint) + fixed_out as total from x),
g as (select request_id, max(n) as n, max(total) as total, cast(sum(tok_before) + max(fixed_in) as bigint) as tokens_in, count(*) filter (old) as distill_count, count(*) filter (stub) as dedup_count, min(place) filter (third <> 2 and place >= 1 and place <= n - 2 and total - prefix <= 400) as least, max(place) filter (third <> 2 and place >= 1 and place <= n - 2) as most from p group by request_id),
d as (select *, case when total <= 400 or n <= 2 then 0 else coalesce(least, most, 0) end as dropped from g)
select d.request_id, d.tokens_in, d.total - p.prefix as tokens_out, cast(1 as bigint) as tools_minified, true as system_minified, dedup_count, distill_count, cast(dropped as bigint) as budget_dropped from d join p on d.request_id = p.request_id and p.place = d.dropped""")
def optimize_with_tools(spark, sf_dir):
    blocks, systems, tool = paired_tables(spark, sf_dir)
    stats = optimize(blocks, Config(token_budget=BUDGET, keep_last=KEEP), systems, tool).stats
    return stats.select("request_id", "tokens_in", "tokens_out", "tools_minified", "system_minified", "dedup_count", "distill_count", "budget_dropped")


#: Each line of an order as a request with one of a few tools.
USE = "'Use this tool to ship line ' || l_linenumber || '. ' || repeat('Status ' || l_linestatus || l_returnflag || '. ', 30)"


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, trim(repeat('Status ' || l_linestatus || l_returnflag || '. ', 30)) as description, '{"type":"object","n":' || l_linenumber || '}' as schema_json from lineitem""")
def tools_once(spark, sf_dir):
    schema = F.concat(F.lit('{"type":"object","title":"T","n":'), F.col("l_linenumber").cast("string"), F.lit("}"))
    t = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("ship").alias("name"), F.expr(USE).alias("description"), schema.alias("schema_json"))
    return minify_tools_once(t).drop("name")


@query(f"select doc_id, cast(case when text is null then 0 else {EST.format('text')} end as bigint) as tokens from documents")
def token_count_once(spark, sf_dir):
    return count_once(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", tokens.estimate, "tokens").drop("text")


def event_runs(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("ts", F.col("event_id").alias("run_id"), "user_id", "event_type", F.col("event_id").alias("tokens_in"), (F.col("event_id") - F.col("event_id") % 7).alias("tokens_out"))


RUN_SUMS = "count(*) as runs, cast(sum(event_id) as bigint) as tokens_in, cast(sum(event_id - event_id % 7) as bigint) as tokens_out, cast(sum(event_id % 7) as bigint) as saved, case when sum(event_id) > 0 then round(sum(event_id % 7) / sum(event_id), 4) else 0e0 end as ratio"


@query(f"select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, event_type, {RUN_SUMS} from events group by all")
def usage_windows(spark, sf_dir):
    hours = usage.windows(event_runs(spark, sf_dir), "1 hour", "10 minutes", ("event_type",))
    return hours.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query(f"select user_id, {RUN_SUMS} from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n <= 60 group by user_id")
def last_runs(spark, sf_dir):
    return usage.last_runs(event_runs(spark, sf_dir), "user_id")
