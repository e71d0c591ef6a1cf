"""The registered queries of this subpackage, with SQL where SQL gives the same rows in reasonable time."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.llm import bpe, decontamination, divergence, host_rules, lm, ngram_join, packing, runs, substring, token_counts, token_files, toxicity, warc
from cohortlake.llm.common import frame_of, short_batches

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        def run(spark, sf_dir):
            short_batches(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return keep


@register("op1_byte_bpe")
def byte_bpe(spark, sf_dir):
    return bpe.digests(frame_of(spark, sf_dir, "documents"))


@register("op2_ngram_join")
def ngram(spark, sf_dir):
    return ngram_join.join(frame_of(spark, sf_dir, "documents"))[1].select("doc_id", "n_shingles", "component_id", "class_id")


@register("op3_substring_dedup")
def substring_dedup(spark, sf_dir):
    return substring.digests(frame_of(spark, sf_dir, "documents"))


@register("op4_toxicity")
def toxic(spark, sf_dir):
    return toxicity.held_out(frame_of(spark, sf_dir, "documents"), frame_of(spark, sf_dir, "labels"))


@register("op5_decontamination")
def decontaminate(spark, sf_dir):
    return decontamination.contamination(frame_of(spark, sf_dir, "documents"), frame_of(spark, sf_dir, "benchmark"))


REVISITS_SQL = r"""
with c as (select page_id * 3 + k as record_id, url, page_id + k * 604800 as fetched, k, html, case when k < 2 then md5(html) end as etag, 'lm ' || length(html) as lm,
                  regexp_replace(regexp_replace(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '#.*$', '') as bare from pages, (select unnest([0, 1, 2]) as k)),
d as (select *, split_part(bare, '?', 1) as place, case when contains(bare, '?') then substr(bare, length(split_part(bare, '?', 1)) + 2) else '' end as given from c),
e as (select *, list_sort(list_filter(string_split(given, '&'), lambda p: p <> '' and not regexp_matches(lower(p), '^(utm_[a-z]+|ref|fbclid|gclid|session(id)?)='))) as kept from d),
f as (select *, regexp_replace(regexp_replace(regexp_replace(lower(split_part(place, '/', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '^www[.]', '')
             || regexp_replace(substr(place, length(split_part(place, '/', 1)) + 1), '/+$', '') || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as key from e),
j as (select r.record_id, r.key, r.k, r.fetched, r.etag, r.lm, t.record_id as target_id, t.fetched as t_fetched, t.etag as t_etag, t.lm as t_lm, t.html as t_html,
             row_number() over (partition by r.record_id order by t.fetched desc, t.record_id desc) as n
      from f r left join f t on t.key = r.key and t.k = 0 and (t.fetched < r.fetched or (t.fetched = r.fetched and t.record_id < r.record_id)) where r.k > 0),
s as (select *, case when target_id is null then 'orphan' when etag is not null and t_etag is not null then case when etag = t_etag then 'resolved' else 'mismatch' end
                     when lm is not null and t_lm is not null then case when lm = t_lm then 'resolved' else 'mismatch' end else 'unverified' end as status from j where n = 1)
select record_id, key as canonical_url, status, target_id, fetched - t_fetched as age,
       case when status = 'resolved' then 'content-type=text/html;date=day ' || k || ';server=s0' end as headers, case when status = 'resolved' then md5(t_html) end as body_md5 from s
"""


@register("op6_revisits", REVISITS_SQL)
def revisits(spark, sf_dir):
    found = warc.resolve(warc.captures_of(frame_of(spark, sf_dir, "pages")))
    headers = F.array_join(F.sort_array(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.select("record_id", "canonical_url", "status", "target_id", "age", headers.alias("headers"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


@register("op7_token_files")
def token_file(spark, sf_dir):
    return token_files.read(token_files.write(frame_of(spark, sf_dir, "documents")))


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
HOST_RULES_SQL = rf"""
with w as (select doc_id, source, {WORDS} as words, coalesce(text, '') as t from documents),
m as (select doc_id, source, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines, words from w),
g as (select doc_id, i, count(*) over (partition by doc_id, gram) as n from (
        select doc_id, unnest(range(1, len(words) - 1)) as i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as gram from m where len(words) >= 3)),
r as (select doc_id, count(distinct j) as n_repeat_words from (select doc_id, i + unnest([0, 1, 2]) as j from g where n > 1) group by doc_id),
b as (select m.doc_id, source, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
             coalesce(n_repeat_words, 0) as n_repeat_words from m left join r on m.doc_id = r.doc_id),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b),
h as (select source, count(*) as documents, sum(base_failed::int) as failures, sum(base_failed::int) / count(*) as rate from f where source is not null group by source),
p as (select avg(rate) as mu, var_pop(rate) as v from h),
q as (select case when v > 0 and v < mu * (1 - mu) then mu * (mu * (1 - mu) / v - 1) else 1 end as a,
             case when v > 0 and v < mu * (1 - mu) then (1 - mu) * (mu * (1 - mu) / v - 1) else 1 end as b from p),
bad as (select source from h, q where (failures + a) / (documents + a + b) > 0.5)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
       n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and (source is null or source not in (select source from bad)) as kept from f
"""


@register("op8_host_rules", HOST_RULES_SQL)
def host_rule(spark, sf_dir):
    return host_rules.judge(frame_of(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op10_lm_scoring")
def language_model(spark, sf_dir):
    return lm.score(frame_of(spark, sf_dir, "documents"))


@register("op9_token_counts")
def token_count(spark, sf_dir):
    return token_counts.count_tokens(frame_of(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")


@register("op11_periodic_runs")
def periodic_runs(spark, sf_dir):
    return runs.digests(frame_of(spark, sf_dir, "documents"))


@register("op12_packing")
def pack(spark, sf_dir):
    return packing.digests(frame_of(spark, sf_dir, "documents"))


DIVERGENCE_SQL = r"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
o as (select id, lang, source, unnest(terms) as term from d),
k as (select lang, term, count(*)::hugeint as n from o group by all having count(distinct id) >= 10),
c as (select lang, source, term, count(*)::hugeint as n from o semi join k using (lang, term) group by all),
l as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from k group by all),
g as (select lang, source, coalesce(any_value(v), 0) as v, coalesce(sum(c.n), 0)::hugeint as total
      from (select distinct lang, source from d) left join l using (lang) left join c using (lang, source) group by all),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.total + 2 * g.v) as p,
             1 + 1000000000 * (k.n + 2) // (l.total + 2 * l.v) as q
      from g join k using (lang) join l using (lang) left join c using (lang, source, term)),
f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
      from p a join p b on a.lang = b.lang and a.term = b.term and a.source != b.source group by all),
r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
      from g a join g b on a.lang = b.lang and a.source != b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
      union all select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from p where n > 0 and p > q),
s as (select *, row_number() over (partition by lang, source, part order by value desc, item)::integer as rank from r)
select * from s where part = 'pair' or rank <= 10
"""


@register("op13_source_divergence", DIVERGENCE_SQL)
def source_divergence(spark, sf_dir):
    return divergence.audit(frame_of(spark, sf_dir, "documents"))
