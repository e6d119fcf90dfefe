"""The queries of this subpackage: each applies one operator to its whole table and shapes the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import ann, byte_bpe, decontaminate, html_text, license_scan, merkle, ngram_join, prefix_trie, quality, substring_dedup, token_files, toxicity, url_filter
from tidewright.llm.common import shared_folder, table


def rank_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_bpe.round_trip(table(spark, sf_dir, "documents"), rank_file())
    return out.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), quality.CUT)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), count_verbatim=True)


def digits(text: Column) -> Column:
    """A number that a text's MD5 gives, the same in any engine."""
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("int")


def dated_list(captures: DataFrame) -> DataFrame:
    """A list of hosts, domains and paths with the days on which they come and go, derived from the captures' own URLs."""
    key = captures.select(F.explode(url_filter.keys(F.col("url"))).alias("key")).distinct().withColumn("c", digits(F.col("key")))
    day = lambda n: F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(n)
    dated = lambda n, action, kind: F.struct(day(n).alias("at"), F.lit(action).alias("action"), F.lit(kind).alias("kind"))
    c = F.col("c")
    deny = F.when(c % 5 == 0, F.array(dated(c % 300, "add", "deny"), dated(c % 300 + 20 + c % 90, "remove", "deny")))
    again = F.when(c % 10 == 0, F.array(dated(c % 300 + 150, "add", "deny")))
    allow = F.when(c % 7 == 0, F.array(dated(c % 200, "add", "allow")))
    none = F.array().cast("array<struct<at:timestamp_ntz,action:string,kind:string>>")
    return key.select("key", F.inline(F.concat(*(F.coalesce(x, none) for x in (deny, again, allow)))))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures without a time of their own get one from their URL and id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(digits(F.col("url")) % 366, F.lit(0), F.lit(0), (F.col("page_id") % 86400).cast("decimal(18,6)"))
    captures = pages.withColumn("fetched_at", at)
    return url_filter.evaluate(captures, dated_list(captures))


ORACLE_OP5 = r"""
with c as (
  select distinct page_id, url,
    timestamp '2024-01-01' + to_days(cast(cast('0x' || substr(md5(url), 1, 6) as integer) % 366 as integer)) + to_seconds(cast(page_id % 86400 as integer)) as fetched_at,
    regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '^www\.|\.$', '', 'g') as host,
    regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) as segment
  from pages),
p as (select *, string_split(host, '.') as labels from c),
ck as (
  select distinct page_id, url, fetched_at, key from (
    select page_id, url, fetched_at, array_to_string(labels[i:], '.') as key
    from p, unnest(range(1, greatest(2, cast(len(labels) as integer)))) as t(i) where host <> ''
    union all
    select page_id, url, fetched_at, host || '/' || segment from p where host <> '' and segment <> '')),
k as (select distinct key, cast('0x' || substr(md5(key), 1, 6) as integer) as c from ck),
e as (
  select key, 'deny' as kind, c % 300 as d, 1 as listed from k where c % 5 = 0
  union all select key, 'deny', c % 300 + 20 + c % 90, 0 from k where c % 5 = 0
  union all select key, 'deny', c % 300 + 150, 1 from k where c % 10 = 0
  union all select key, 'allow', c % 200, 1 from k where c % 7 = 0),
ev as (select key, kind, timestamp '2024-01-01' + to_days(cast(d as integer)) as at, max(listed) as listed from e group by all),
latest as (
  select ck.*, ev.kind, ev.listed, row_number() over (partition by ck.page_id, ck.url, ck.fetched_at, ck.key, ev.kind order by ev.at desc) as rn
  from ck join ev on ck.key = ev.key and ev.at <= ck.fetched_at),
active as (
  select *, count(*) over (partition by page_id, url, fetched_at) as n,
    row_number() over (partition by page_id, url, fetched_at order by length(key) desc, case kind when 'allow' then 1 else 0 end desc, key desc) as best
  from latest where rn = 1 and listed = 1)
select c.page_id, c.url, c.fetched_at, cast(coalesce(a.n, 0) as bigint) as n_active, a.key as deciding_key, a.kind as deciding_kind, coalesce(a.kind = 'deny', false) as blocked
from c left join active a on c.page_id is not distinct from a.page_id and c.url = a.url and c.fetched_at = a.fetched_at and a.best = 1
"""


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_OP8 = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
g as (select doc_id, i, hash(array_to_string(words[i:i + 12], ' ')) as h, md5(array_to_string(words[i:i + 12], ' ')) as m
  from w, unnest(range(1, cast(len(words) as integer) - 11)) as t(i)),
f as (select h, m, min(doc_id) as first_doc from g group by h, m),
r as (select g.doc_id, list_distinct(flatten(list(range(g.i, g.i + 13)))) as gone from g join f using (h, m) where f.first_doc < g.doc_id group by g.doc_id)
select w.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
  sha256(coalesce(array_to_string(case when gone is null then words else list_filter(words, lambda x, i: not list_contains(gone, i)) end, ' '), '')) as kept_sha256
from w left join r on w.doc_id = r.doc_id
"""


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"))


ORACLE_OP9 = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '') as words from documents where doc_id is not null),
g as (select distinct doc_id, array_to_string(words[i:i + 4], chr(1)) as gram from w, unnest(range(1, greatest(2, cast(len(words) as integer) - 3))) as t(i) where len(words) > 0),
n as (select doc_id, count(*) as size, md5(array_to_string(list_sort(list(gram)), chr(2))) as digest from g group by doc_id),
pair as (select a.doc_id as u, b.doc_id as v, count(*) as common from g a join g b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2),
link as (select u, v from pair join n a on a.doc_id = u join n b on b.doc_id = v where common >= 0.8 * (a.size + b.size - common)),
edge as (select u, v from link union all select v, u from link),
reach as (select u, v from edge union select r.u, e.v from reach r join edge e on e.u = r.v),
class as (select u as doc_id, least(u, min(v)) as class_id from reach group by u)
select w.doc_id, coalesce(class_id, w.doc_id) as class_id, coalesce(min(w.doc_id) over (partition by digest, case when digest is null then w.doc_id end), w.doc_id) as copy_of, cast(coalesce(k.links, 0) as bigint) as n_links
from w left join n on n.doc_id = w.doc_id left join class c on c.doc_id = w.doc_id left join (select u as doc_id, count(*) as links from edge group by u) k on k.doc_id = w.doc_id
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), toxicity.CUT)


def crc32(of: str) -> str:
    """SQL for the unsigned CRC-32 of an integer's decimal digits, bit by bit."""
    bits = f"flatten(list_transform(string_split(cast({of} as varchar), ''), lambda ch: [cast(ascii(ch) as bigint), 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce({bits}, lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1)), cast(4294967295 as bigint)), cast(4294967295 as bigint))"


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that are tampered with have their text's A-Z in lower case."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"text": text})


ENCODED = "coalesce(strlen({0}) || ':' || {0}, '-')"
ORACLE_OP11 = f"""
with recursive d as (
  select doc_id, lang, {" || ".join(ENCODED.format(f"cast({c} as varchar)") for c in ("doc_id", "source", "lang", "n_chars"))} as head, text,
    case when {crc32("doc_id")} % 3 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as claimed
  from documents),
leaf as (
  select doc_id, lang, sha256(head || {ENCODED.format("text")}) as digest, sha256(head || {ENCODED.format("claimed")}) as other,
    row_number() over (partition by lang order by doc_id nulls first) - 1 as idx, count(*) over (partition by lang) as n
  from d),
low(lang, level, idx, digest, n) as (
  select lang, 0, idx, digest, n from leaf
  union all
  select lang, level + 1, idx // 8, sha256(string_agg(digest, '' order by idx)), (any_value(n) + 7) // 8 from low where n > 1 group by lang, level, idx // 8),
sub as (select lang, digest, row_number() over (order by lang nulls first) - 1 as idx, count(*) over () as n from low where n = 1),
high(level, idx, digest, n) as (
  select 0, idx, digest, n from sub
  union all
  select level + 1, idx // 8, sha256(string_agg(digest, '' order by idx)), (any_value(n) + 7) // 8 from high where n > 1 group by level, idx // 8),
root as (select digest as root from high where n = 1),
run as (
  select 0 as part, lang, level, idx // 8 as run, list(digest order by idx) as ds from low where n > 1 group by lang, level, idx // 8
  union all
  select 1, null, level, idx // 8, list(digest order by idx) from high where n > 1 group by level, idx // 8),
last as (select 0 as part, lang, max(level) as levels from low group by lang),
fold(doc_id, leaf, lang, part, level, idx, top, digest, proof) as (
  select l.doc_id, l.digest, l.lang, 0, 0, l.idx, s.idx, other, '' from leaf l join sub s on l.lang is not distinct from s.lang
  union all
  select f.doc_id, f.leaf, f.lang, case when t.levels is not null then 1 else f.part end, case when t.levels is not null then 0 else f.level + 1 end,
    case when t.levels is not null then f.top else f.idx // 8 end, f.top,
    case when t.levels is not null then f.digest else sha256(array_to_string(r.ds[1:f.idx % 8], '') || f.digest || array_to_string(r.ds[f.idx % 8 + 2:], '')) end,
    case when t.levels is not null then f.proof else f.proof || array_to_string(r.ds[1:f.idx % 8], '') || array_to_string(r.ds[f.idx % 8 + 2:], '') end
  from fold f left join last t on f.part = 0 and f.lang is not distinct from t.lang and f.level = t.levels
    left join run r on t.levels is null and r.part = f.part and r.level = f.level and r.run = f.idx // 8 and (f.part = 1 or r.lang is not distinct from f.lang)
  where t.levels is not null or r.ds is not null)
select doc_id, leaf, s.digest as subroot, root, sha256(proof) as proof_sha256, f.digest as folded_root, f.digest = root as verified
from fold f join sub s on f.lang is not distinct from s.lang cross join root
where f.part = 1 and f.level = (select max(level) from high)
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation c begins with the first turns of conversation c - c % 5, as many as the CRC-32 of c modulo 9."""
    turns = prefix_trie.turns_of(table(spark, sf_dir, "conversations"))
    c = F.col("conv_id")
    return prefix_trie.trie(prefix_trie.rebuilt(turns, c - c % 5, F.crc32(c.cast("string")) % 9, 8))


ORACLE_OP12 = f"""
with o as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos
  from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 5 as base, {crc32("conv_id")} % 9 as h from (select distinct conv_id from o)),
r as (
  select c.conv_id, o.pos, 0 as own, o.role, o.text from c join o on o.conv_id = c.base and o.pos <= c.h
  union all
  select c.conv_id, o.pos, 1, o.role, o.text from c join o on o.conv_id = c.conv_id and o.pos > c.h),
t as (
  select conv_id, 0 as d, '' as step, 0 as bytes from c
  union all
  select conv_id, row_number() over (partition by conv_id order by own, pos), sha256(strlen(role) || ':' || role || text), strlen(text) from r),
p as (select conv_id, d, bytes, sha256(string_agg(step, '' ) over (partition by conv_id order by d)) as node from t),
l as (select *, lag(node) over (partition by conv_id order by d) as parent, lead(node) over (partition by conv_id order by d) is null as ends from p),
n as (
  select node, d, min(conv_id) as conv_id, any_value(parent) as parent, count(*) as n_convs, any_value(bytes) as bytes,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from l group by node, d),
k as (select parent as node, d - 1 as d, count(*) as n_children from n where parent is not null group by parent, d),
m as (select n.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * bytes as saved, case when n_children is null then 1 else 0 end as leaf from n left join k using (node, d)),
s as (select p.node, p.d, sum(m.saved) as saved_tokens, sum(m.leaf) as n_leaves from m join p on p.conv_id = m.conv_id and p.d <= m.d group by p.node, p.d)
select m.conv_id, cast(m.d as bigint) as depth, q.conv_id as parent_conv_id, m.n_convs, m.n_children, cast(s.n_leaves as bigint) as n_leaves, cast(s.saved_tokens as bigint) as saved_tokens, m.ends_sha256
from m join s using (node, d) left join m q on q.node = m.parent and q.d = m.d - 1
"""


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.encode(table(spark, sf_dir, "documents"), folder, rank_file("word_bpe_49k.json"))
    return token_files.rows_of(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_html_text": op2_html_text,
    "op3_quality": op3_quality,
    "op4_decontaminate": op4_decontaminate,
    "op5_url_filter": op5_url_filter,
    "op6_ann": op6_ann,
    "op7_license_scan": op7_license_scan,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_files": op13_token_files,
}
ORACLES: dict[str, str] = {"op5_url_filter": ORACLE_OP5, "op8_substring_dedup": ORACLE_OP8, "op9_ngram_join": ORACLE_OP9, "op11_merkle_manifest": ORACLE_OP11, "op12_prefix_trie": ORACLE_OP12}
