"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvern.llm import checks, cutoff, digest, leaks, mixing, overlaps, pii, spans, splits
from kvern.sources.tables import table as t

QUERIES = {
    "p1_found": lambda s, d: pii.occurrences(t(s, d, "manifest"), t(s, d, "verdicts"), t(s, d, "navneliste")).select("felt", "rad_id", "art", "start_pos"),
    "p1_masked": lambda s, d: pii.masked(t(s, d, "manifest"), t(s, d, "verdicts"), t(s, d, "navneliste")),
    "p2_found": lambda s, d: splits.related_documents(t(s, d, "labels"), t(s, d, "metadata")),
    "p2_splits": lambda s, d: splits.grouped_splits(t(s, d, "labels"), t(s, d, "metadata")),
    "p2_report": lambda s, d: splits.split_report(splits.grouped_splits(t(s, d, "labels"), t(s, d, "metadata"))),
    "p3_found": lambda s, d: overlaps.found_pairs(t(s, d, "labels"), t(s, d, "splittliste"), t(s, d, "manifest")),
    "p3_report": lambda s, d: overlaps.overlap_report(t(s, d, "labels"), t(s, d, "splittliste"), t(s, d, "manifest")),
    "p4_percentiles": lambda s, d: digest.percentiles(t(s, d, "labels")),
    "p4_day_digests": lambda s, d: digest.day_digests(digest.sizes(t(s, d, "labels")), ["type", "felt", "dag"]),
    "p5_found": lambda s, d: cutoff.kept_records(t(s, d, "resultat"), t(s, d, "kuttmaal")),
    "p5_cutoffs": lambda s, d: cutoff.cutoffs(t(s, d, "resultat"), t(s, d, "kuttmaal"))[0],
    "p6_found": lambda s, d: leaks.leaked_items(t(s, d, "documents"), t(s, d, "eval_items")).select("doc_id", "item_id"),
    "p6_report": lambda s, d: leaks.leak_report(t(s, d, "documents"), t(s, d, "eval_items")),
    "p6_cleaned": lambda s, d: leaks.without_leaks(t(s, d, "documents"), t(s, d, "eval_items")),
    "p7_mixture": lambda s, d: mixing.mixed_records(t(s, d, "documents"), t(s, d, "blandingsmaal")),
    "p7_shares": lambda s, d: mixing.mixed_shares(t(s, d, "documents"), t(s, d, "blandingsmaal")),
    "p8_found": lambda s, d: spans.shared_pairs(t(s, d, "documents")),
    "p8_shared": lambda s, d: spans.shared_portion(t(s, d, "documents")),
    # what holds for every result, as rows that SQL can give too
    "p1_check": lambda s, d: checks.masked_texts(t(s, d, "manifest"), t(s, d, "verdicts"), t(s, d, "navneliste")),
    "p2_check": lambda s, d: checks.split_rows(t(s, d, "labels"), t(s, d, "metadata")),
    "p4_check": lambda s, d: digest.percentiles(t(s, d, "labels")).groupBy("type", "felt", "n").agg(F.bool_and("within").alias("within"), F.count(F.lit(1)).alias("quantiles")),
    "p4_days": lambda s, d: digest.day_digests(digest.sizes(t(s, d, "labels")), ["type", "felt", "dag"]).select("type", "felt", F.col("dag").cast("string").alias("dag"), "n", "low", "high"),
    "p6_check": lambda s, d: checks.cleaned_texts(t(s, d, "documents"), t(s, d, "eval_items")),
    "p7_check": lambda s, d: checks.mixed_sources(t(s, d, "documents"), t(s, d, "blandingsmaal")),
}

_SCORED = """
targets as (
    select distinct lower(trim(kilde)) as kilde, trim(poengfelt) as poengfelt, cast(maal_andel as double) as maal_andel
    from kuttmaal where nullif(trim(kilde), '') is not null and poengfelt is not null and maal_andel is not null
),
long as (
    select pred_id, lower(trim(kilde)) as kilde, 'yolo_conf' as poengfelt, yolo_conf as score from resultat
    union all
    select pred_id, lower(trim(kilde)), 'paddle_rec_score', paddle_rec_score from resultat
),
scored as (
    select pred_id, kilde, poengfelt, max(score) as score from long
    where pred_id is not null and score is not null and not isnan(score) and score between 0 and 1
    group by all
),
ranked as (
    select t.maal_andel, s.kilde, s.poengfelt, s.score, count(*) over (partition by s.kilde, s.poengfelt, t.maal_andel) as n_scored,
           count(*) over (partition by s.kilde, s.poengfelt, t.maal_andel order by s.score desc range between unbounded preceding and current row) as upto
    from scored s join targets t on s.kilde = t.kilde and s.poengfelt = t.poengfelt
),
cut as (
    select kilde, poengfelt, maal_andel, max(score) as cutoff, any_value(n_scored) as n_scored, min(upto) as n_kept
    from ranked where upto >= maal_andel * n_scored group by kilde, poengfelt, maal_andel
)
"""

def _doc(c: str) -> str:
    return f"try_cast(nullif(regexp_extract(trim(string_split(trim({c}), '/')[-1]), '^0*([0-9]+)', 1), '') as bigint)"


def _num(c: str) -> str:
    n = f"try_cast(replace(trim({c}), ',', '.') as double)"
    return f"(case when isnan({n}) or isinf({n}) then null else {n} end)"


_WORDS = r"regexp_extract_all(lower(regexp_replace(text, '-\r?\n', '', 'g')), '[\p{L}\p{N}]+')"

_OVERLAPS = f"""
with b0 as (select {_doc('fil_revisjon_id')} as doc, cast({_num('sidetall')} as int) as page, {_num('x')} as x, {_num('y')} as y, {_num('width')} as w, {_num('height')} as h from labels),
box as (
    select distinct doc, page, round(case when w < 0 then x + w else x end, 4) as x, round(case when h < 0 then y + h else y end, 4) as y, round(abs(w), 4) as w, round(abs(h), 4) as h
    from b0 where doc is not null and page is not null and x is not null and y is not null and round(abs(w), 4) > 0 and round(abs(h), 4) > 0
),
n as (select doc, count(*) as n from box group by 1 having count(*) >= 5),
member as (
    select distinct {_doc('fil')} as doc, lower(trim(splitt)) as splitt from splittliste where lower(trim(splitt)) in ('train', 'val', 'test') and {_doc('fil')} is not null
    union select distinct {_doc('fil')}, 'pilot' from manifest where {_doc('fil')} is not null
),
e as (select distinct doc from member where splitt <> 'train'), t as (select doc from member where splitt = 'train'),
hit as (
    select a.doc as de, b.doc as dt, struct_pack(p := a.page, x := a.x, y := a.y, w := a.w, h := a.h) as be, struct_pack(p := b.page, x := b.x, y := b.y, w := b.w, h := b.h) as bt
    from (select * from box where doc in (select doc from e) and doc in (select doc from n)) a join (select * from box where doc in (select doc from t) and doc in (select doc from n)) b
    on a.page = b.page and a.doc <> b.doc and abs(a.x - b.x) <= 2.000001 and abs(a.y - b.y) <= 2.000001 and abs(a.w - b.w) <= 2.000001 and abs(a.h - b.h) <= 2.000001
),
near as (select de, dt from (select de, dt, count(distinct be) as ke, count(distinct bt) as kt from hit group by all) join n ne on ne.doc = de join n nt on nt.doc = dt where ke >= 0.6 * ne.n - 1e-9 and kt >= 0.6 * nt.n - 1e-9)"""

ORACLE = {
    "p3_found": f"""{_OVERLAPS}
select distinct least(de, dt) as dok_a, greatest(de, dt) as dok_b, splitt from near join member on member.doc = de and splitt <> 'train'
union select doc, doc, splitt from member where splitt <> 'train' and doc in (select doc from t)
""",
    "p3_report": f"""{_OVERLAPS},
place as (select distinct {_doc('fil')} as doc, lower(trim(splitt)) as splitt, trim(uttrekk) as uttrekk from splittliste where lower(trim(splitt)) in ('val', 'test') union select doc, 'pilot', null from member where splitt = 'pilot')
select splitt, uttrekk, count(distinct doc) as n_documents, count(distinct case when doc in (select doc from t) then doc end) as n_same, count(distinct case when doc in (select de from near) then doc end) as n_near from place where doc is not null group by all
""",
    "p6_found": f"""
with d as (select doc_id, {_WORDS} as a from documents where doc_id is not null and text is not null), i as (select item_id, {_WORDS} as a from eval_items where item_id is not null and text is not null),
dg as (select doc_id, array_to_string(a[k:k + 15], ' ') as g from (select *, unnest(generate_series(1, len(a) - 15)) as k from d where len(a) >= 16)),
ig as (select item_id, array_to_string(a[k:k + 15], ' ') as g from (select *, unnest(generate_series(1, len(a) - 15)) as k from i where len(a) >= 16))
select distinct doc_id, item_id from dg join ig using (g)
""",
    "p6_report": f"""
with d as (select distinct doc_id, text as x, {_WORDS} as a from documents where doc_id is not null and text is not null), i as (select distinct item_id, {_WORDS} as a from eval_items where item_id is not null and text is not null),
dg as (select doc_id, x, k, array_to_string(a[k:k + 15], ' ') as g from (select *, unnest(generate_series(1, len(a) - 15)) as k from d where len(a) >= 16)),
ig as (select item_id, a as y, k, array_to_string(a[k:k + 15], ' ') as g from (select *, unnest(generate_series(1, len(a) - 15)) as k from i where len(a) >= 16)),
h as (select distinct doc_id, x, item_id, y, dg.k as kd, ig.k as ki from dg join ig using (g)),
n as (select *, kd - row_number() over (partition by doc_id, x, item_id, y, kd - ki order by kd) as run from h),
r as (select doc_id, item_id, max(k) as longest from (select doc_id, item_id, count(*) + 15 as k from n group by doc_id, x, item_id, y, kd - ki, run) group by all)
select r.item_id, sett, count(*) as n_documents, max(longest) as longest from r join (select distinct item_id, sett from eval_items) e on e.item_id = r.item_id group by r.item_id, sett
""",
    "p8_shared": """
with recursive base as (select distinct doc_id, text, md5(text) as h, length(text) as n from documents where length(text) >= 300 and doc_id is not null),
g as (select doc_id, h, n, k, md5_number(substring(text, k, 300)) as m from (select *, unnest(generate_series(1, n - 299)) as k from base)),
common as (select m from g group by m having count(distinct doc_id) > 1),
w as (select * from g where m in (select m from common)),
cov as (select doc_id, n, sum(least(300, coalesce(k - prev, 300))) as shared_chars from (select *, lag(k) over (partition by doc_id order by k) as prev from (select distinct doc_id, n, k from w)) group by all),
e as (select distinct a.doc_id as x, b.doc_id as y, b.h as hy, a.h = b.h as same from w a join w b on a.m = b.m and a.doc_id <> b.doc_id),
links as (select x as doc_id, count(distinct case when not same then hy end) + max(case when same then 1 else 0 end) as n_links from e group by x),
reach(a, b) as (select x, y from e union select r.a, e.y from reach r join e on r.b = e.x),
root as (select a as doc_id, least(a, min(b)) as gruppe from reach group by a)
select c.doc_id, c.n as n_chars, c.shared_chars, c.shared_chars / c.n as shared_part, l.n_links, r.gruppe, c.doc_id = r.gruppe as keep from cov c join links l on c.doc_id = l.doc_id join root r on c.doc_id = r.doc_id
""",
    "p1_check": """
with f as (select 'ocr_tekst' as felt, nr as id, ocr_tekst as x from manifest union select 'raatekst', verdict_id, raatekst from verdicts union select 'begrunnelse', verdict_id, begrunnelse from verdicts)
select felt, count(*) as n, count(*) filter (x is null) as n_null, 0 as n_broken, 0 as n_numbers_left from f group by felt
""",
    "p2_check": "select count(*) as n_rows, 0 as n_split_groups, 3 as n_splits, true as near from labels",
    "p4_check": f"""
with v as (select coalesce(nullif(upper(trim(type)), ''), '(none)') as type, unnest(['width', 'height']) as felt, unnest([abs({_num('width')}), abs({_num('height')})]) as value from labels)
select type, felt, count(*) as n, true as within, 7 as quantiles from v where value > 0 group by all
""",
    "p4_days": f"""
with v as (select coalesce(nullif(upper(trim(type)), ''), '(none)') as type, cast(cast(timezone('UTC', lastet) as date) as varchar) as dag, unnest(['width', 'height']) as felt, unnest([abs({_num('width')}), abs({_num('height')})]) as value from labels)
select type, felt, dag, count(*) as n, min(value) as low, max(value) as high from v where value > 0 group by all
""",
    "p6_check": f"""
with d as (select doc_id, {_WORDS} as a from documents where doc_id is not null and text is not null), i as (select item_id, {_WORDS} as a from eval_items where item_id is not null and text is not null),
dg as (select doc_id, array_to_string(a[k:k + 15], ' ') as g from (select *, unnest(generate_series(1, len(a) - 15)) as k from d where len(a) >= 16)),
ig as (select array_to_string(a[k:k + 15], ' ') as g from (select *, unnest(generate_series(1, len(a) - 15)) as k from i where len(a) >= 16))
select count(distinct doc_id) as n_documents, count(distinct doc_id) as n_rows, 0 as n_left, 0 as n_broken from dg where g in (select g from ig)
""",
    "p7_check": """
with s as (select distinct replace(lower(trim(source)), '-', '_') as source from documents where length(text) > 0 and doc_id is not null)
select distinct replace(lower(trim(source)), '-', '_') as source, true as near, true as capped from blandingsmaal where maal_andel > 0 and maks_gjentak >= 1 and replace(lower(trim(source)), '-', '_') in (select source from s)
""",
    "p8_found": """
with g as (select distinct doc_id, substring(text, k, 300) as s from (select doc_id, text, unnest(generate_series(1, length(text) - 299)) as k from documents where length(text) >= 300 and doc_id is not null)),
h as (select doc_id, md5_number(s) as m from g)
select distinct a.doc_id as doc_a, b.doc_id as doc_b from h a join h b on a.m = b.m and a.doc_id < b.doc_id
""",
    "p2_found": r"""
with recursive
m as (
    select try_cast(nullif(regexp_extract(trim(string_split(trim(fil_revisjon_id), '/')[-1]), '^0*([0-9]+)', 1), '') as bigint) as doc,
           try_cast(nullif(regexp_extract(trim(string_split(trim(forrige_revisjon_id), '/')[-1]), '^0*([0-9]+)', 1), '') as bigint) as prev,
           embetenummer as e, dokument_aar as y, nullif(dokumentnummer, 0) as n
    from metadata
),
firsts as (select e, y, n, min(doc) as lo from m where doc is not null and e is not null and y is not null and n is not null group by e, y, n),
half as (
    select m.doc as a, f.lo as b from m join firsts f on m.e = f.e and m.y = f.y and m.n = f.n where m.doc <> f.lo
    union
    select m.doc, m.prev from m where m.doc <> m.prev and m.prev in (select doc from m)
),
edge as (select a, b from half union select b, a from half),
reach(a, b) as (select a, b from edge union select r.a, e.b from reach r join edge e on r.b = e.a)
select a as dok_nr, min(b) as gruppe from reach
where a in (select try_cast(nullif(regexp_extract(trim(string_split(trim(fil_revisjon_id), '/')[-1]), '^0*([0-9]+)', 1), '') as bigint) from labels)
group by a
""",
    "p5_found": f"with {_SCORED} select distinct s.pred_id from scored s join cut c on s.kilde = c.kilde and s.poengfelt = c.poengfelt and s.score >= c.cutoff",
    "p5_cutoffs": f"with {_SCORED} select t.kilde, t.poengfelt, t.maal_andel, c.cutoff, coalesce(c.n_scored, 0) as n_scored, coalesce(c.n_kept, 0) as n_kept from targets t left join cut c using (kilde, poengfelt, maal_andel)",
}
