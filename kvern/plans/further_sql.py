"""SQL of the further queries, and of the folds over events, texts and answers."""

from __future__ import annotations

from kvern.plans.oracle import ANY, GATED, JUDGED, LABELS, MANIFEST, MATCH, META, ORACLE, PRED, RULES, SHAPE, _AXIS_ROWS, _SCAN, _SIDES, _check, _mod11, config_rows, doc, hits, measured, num, production_rows, removed

PT = "(300 / 72)"
SIZE = f"size as (select doc_no, side, arg_min(bilde_bredde, pred_id) / {PT} as pw, arg_min(bilde_hoyde, pred_id) / {PT} as ph from pred group by all)"


def place(x0: str, y0: str, x1: str, y1: str, w: str, h: str) -> str:
    return f"case when {x0} >= -1 and {y0} >= -1 and {x1} <= {w} + 1 and {y1} <= {h} + 1 then 'inside' when {x1} <= 0 or {y1} <= 0 or {x0} >= {w} or {y0} >= {h} then 'outside' else 'partial' end"


_NOISE_GONE = f"{config_rows([(k, k, c) for k, c in ANY.items()])}, gone as (select distinct p.pred_id from cls p join cfg c on c.kilde = p.kilde where {removed('c', 'p')}), lostt as (select label_id from edge group by 1 having bool_and(pred_id in (select pred_id from gone)))"

# ----- answers

_TRIM = r"'^\s+|\s+$', '', 'g'"
_OMITTED = "the model omitted the «svar» field — the rest of the JSON came"


def _said(name: str, none: str) -> str:
    return f"case when json_type(j, '$.{name}') = 'NULL' then '{none}' else coalesce(regexp_replace(json_extract_string(j, '$.{name}'), {_TRIM}), '') end"


def answers(table: str) -> str:
    """CTEs that end with ans: the columns of table and what is read from its column raw."""
    checks = ", ".join(f"case when j is null then '' else substring(replace({_said(f, '')}, chr(10), ' '), 1, 300) end as {f}" for f in ("linjen", "sifre_paa_linjen", "dato_gyldig", "holdepunkt"))
    return f"""
c1 as (select *, regexp_replace(coalesce(raw, ''), {_TRIM}) as s from {table}),
c2 as (select *, case when starts_with(s, '```') then regexp_replace(regexp_replace(s, '^```[a-zA-Z]*\\s*|\\s*```$', '', 'g'), {_TRIM}) else s end as c from c1),
c3 as (select *, regexp_extract(c, '(?s)(\\{{.*?\\}})', 1) as o, lower(regexp_extract(c, '(?i)\\b(ja|nei)\\b', 1)) as w from c2),
c4 as (select *, case when case when json_valid(c) then json_type(c) end = 'OBJECT' then c when case when json_valid(o) then json_type(o) end = 'OBJECT' then o end as j from c3),
c5 as (select *, lower({_said('svar', 'none')}) as a from c4),
ans as (
    select * exclude (s, c, o, w, j, a), case when s = '' then 'ja' when j is not null then (case when a = 'nei' then 'nei' else 'ja' end) when w <> '' then w else 'ja' end as svar_,
           case when j is null then '' else {_said('tall', 'None')} end as tall_, case when s = '' then '' when j is null then substring(c, 1, 120) else {_said('begrunnelse', 'None')} end as begrunnelse_,
           case when s = '' then 'empty answer' when j is null then (case when w <> '' then 'not JSON, read by keyword' else 'unparsable answer' end) when a in ('ja', 'nei') then '' when a = '' then '{_OMITTED}' else 'unknown answer ''' || a || '''' end as feil_, {checks}
    from c5
)"""


_RAW = "rawt as (select distinct verdict_id, raatekst as raw from verdicts)"
_NOTE = f"case feil_ when 'not JSON, read by keyword' then 'answer was not JSON' when 'unparsable answer' then 'answer unreadable' when 'empty answer' then 'answer empty' when '{_OMITTED}' then 'no «svar» field' else 'unparsed' end"
_SHOWN = "coalesce(utsnitt, '') || case when coalesce(ocr_tekst, '') <> '' then '\"' || replace(replace(replace(ocr_tekst, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n') || '\"' else '' end"
_ITEMS = f"{MANIFEST}, items as (select m.nr, m.klasse, case when {_SHOWN} <> '' then substring(sha256({_SHOWN}), 1, 24) end as key from man m join (select nr, min(utsnitt) as utsnitt from manifest where nr is not null group by 1) u on m.nr = u.nr)"
_CACHE = f"""{_ITEMS}, news as (select distinct i.key, v.raatekst as raw from verdicts v join items i on v.nr = i.nr where v.raatekst is not null and i.key is not null), {answers('news')},
cache as (select key, min(raw) as raw, any_value(svar_) as any_svar from ans where feil_ = '' group by key)"""

# ----- texts laid out on the grid: a digit's place is its place in the raw line

_GRID = """
raw0 as (select nr, ocr_tekst as x from manifest where nr is not null and ocr_tekst is not null qualify row_number() over (partition by nr order by nr) = 1),
raw1 as (select nr, unnest(string_split(x, chr(10))) as raw, unnest(generate_series(0, len(string_split(x, chr(10))) - 1)) as line from raw0),
gl as (select nr as doc, line, raw, trim(regexp_replace(raw, ' +', ' ', 'g'), ' ') as text, row_number() over (partition by nr order by line) - 1 as line_no, row_number() over (order by nr, line) as id from raw1 where trim(raw, ' ') <> '')"""
_DIGITS = "length(regexp_replace(translate(text, 'oOsSlIbB', '00551166'), '[^0-9]', '', 'g'))"
_GRID_SCAN = f"{_GRID}, t as (select id as nr, text as ocr_tekst from gl), {_SCAN}"
_RP = "list_filter(generate_series(1, length(raw)), lambda i: regexp_matches(substring(translate(raw, 'oOsSlIbB', '00551166'), i, 1), '[0-9]'))"
_PAIRS = [j for j in range(1, 11) if j not in (2, 4, 6)]

# ----- the folds over events

_BREAKER = """with recursive e as (select user_id % 16 as endpoint, epoch_us(ts) / 1e6 as s, event_type <> 'error' as ok, row_number() over (partition by user_id % 16 order by ts, event_id) as r from events),
f(endpoint, r, failures, until, calls, failed, refused) as (
    select distinct endpoint, 0::bigint, 0, 0.0::double, 0::bigint, 0::bigint, 0::bigint from e
    union all
    select e.endpoint, e.r, case when e.s < f.until then f.failures when e.ok then 0 when f.failures + 1 >= 5 then 0 else f.failures + 1 end, case when e.s >= f.until and not e.ok and f.failures + 1 >= 5 then e.s + 30 else f.until end,
           f.calls + 1, f.failed + case when e.s >= f.until and not e.ok then 1 else 0 end, f.refused + case when e.s < f.until then 1 else 0 end
    from f join e on e.endpoint = f.endpoint and e.r = f.r + 1
) select endpoint, calls, failed, refused from f qualify row_number() over (partition by endpoint order by r desc) = 1"""
_BATCH = """with recursive e as (select user_id % 8 as worker, event_id, event_type <> 'error' as ok, row_number() over (partition by user_id % 8 order by event_id) as r from events),
f(worker, r, event_id, size, next_size, good, doubling) as (
    select distinct worker, 0::bigint, null::bigint, 12, 12, 0, true from e
    union all
    select worker, r, event_id, sz, case when ok then sz else greatest(1, sz // 2) end, case when ok then (case when sz <> old then 0 else g end) + 1 else -4 end, doubling and ok
    from (select e.worker, e.r, e.event_id, e.ok, f.next_size as old, f.good as g, f.doubling,
                 case when f.next_size < 12 and f.good >= (case when f.doubling then 1 else 2 end) then (case when f.doubling then least(12, f.next_size * 2) else f.next_size + 1 end) else f.next_size end as sz
          from f join e on e.worker = f.worker and e.r = f.r + 1)
) select worker, event_id as order, size from f where r > 0"""


def _poisson(keys: str) -> str:
    """CTEs up to bound(k, upper) for the numbers k of a query."""
    return f"""
ks as ({keys}),
bis(k, i, lo, hi) as (
    select k, 0, 0.0::double, k + 10.0 * sqrt(k + 1) + 10 from ks union all
    select k, i + 1, case when p > 0.05 then mid else lo end, case when p > 0.05 then hi else mid end
    from (select k, i, lo, hi, (lo + hi) / 2 as mid, list_sum(list_transform(generate_series(0, k), lambda x: exp(x * ln((lo + hi) / 2) - (lo + hi) / 2 - lgamma(x + 1)))) as p from bis where i < 70)
),
bound as (select k, hi as upper from bis where i = 70)"""


def _reasons() -> str:
    """CTE why(config_id, pred_id, reason): the reasons of cfg x pred, the first number of each as N."""
    on = lambda f: f"coalesce(c.{f}, 0) <> 0"
    has = lambda f: f"coalesce(p.{f}, 0) <> 0"
    z = lambda f: f"coalesce(p.{f}, 0)"
    shapes = ", ".join(f"case when coalesce(p.{m} {sign} c.{n}, false) then '{n.replace('_', ' ')} broken by N' end" for n, (m, sign) in SHAPE.items())
    return f"""why0 as (
    select c.config_id, p.pred_id, case
        when coalesce(c.without_text_conf is not null and p.har_tokens = 0 and (p.conf is null or p.conf < c.without_text_conf), false) then 'no text and low confidence'
        when {on('reject_decimal_gap')} and {has('har_desimal_luke')} then 'decimal in a gap of the window' when coalesce(p.maks_luke >= c.max_gap, false) then 'wide gap in the window'
        when {z('har_tokens')} = 0 then null when coalesce(p.conf >= c.ocr_conf_exempt, false) then null
        when c.rec_veto is not null and (p.rec_min is null or p.rec_min < c.rec_veto) then null when c.line_veto is not null and (p.rec_min_linje is null or p.rec_min_linje < c.line_veto) then null
        when coalesce({z('n_siffer')} < c.min_digits, false) then 'digits N' when coalesce({z('n_bokstaver')} > c.max_letters, false) then 'letters N' when coalesce({z('siffer_run')} < c.min_digits_run, false) then 'digit run N'
        when {on('require_fnr_candidate')} and not {has('har_fnr_kandidat')} then 'no candidate on the line' when {on('reject_decimal')} and {has('har_desimal_naer')} then 'decimal inside the number'
        when {on('reject_00_run')} and {has('har_00_run')} then 'run starts with N' when {on('reject_orgnr')} and {has('har_orgnr')} then 'organisation number in the box'
        when {on('reject_org_ord')} and {has('har_org_ord')} and (c.reject_org_ord < 2 or not {has('har_fnr_kandidat')}) then 'company word near the box'
        when {on('reject_run_6_10')} and coalesce(p.lang_run between 6 and (case when c.reject_run_6_10 = 1 then 10 else c.reject_run_6_10 end), false) then 'run of N' end as said,
        coalesce(p.areal_px < c.min_area_px, false) as small, coalesce(p.conf >= c.conf_threshold, false) as gated, list_filter([{shapes}], lambda r: r is not null) as shapes
    from pred p join cfg c on (c.kilde is null or c.kilde = p.kilde)
),
why as (select config_id, pred_id, unnest(case when said is not null then [said] when small then ['area Npx2'] when gated then [] else shapes end) as reason from why0)"""


_PAGED = f"{PRED}, {SIZE}, paged as (select doc_no, count(*) as pages from size group by 1)"
_PB = f"""{PRED}, {SIZE}, pb as (
    select doc_no, side, case when pw > ph then 90 else 0 end as rotate, least(pw, ph) as mw, greatest(pw, ph) as mh, case when doc_no % 7 = 0 then 10.0 else 0.0 end as cut, pw - 2 * (case when doc_no % 7 = 0 then 10.0 else 0.0 end) as vw, ph - 2 * (case when doc_no % 7 = 0 then 10.0 else 0.0 end) as vh from size)"""
_WHO = "case when ml then (case when status = '' then 'ML unprocessed' else 'ML' end) else 'manual' end"


def _placed(flip: bool) -> str:
    y = lambda h: (f"({h} - l.y1)", f"({h} - l.y0)") if flip else ("l.y0", "l.y1")
    at = lambda w, h: place("l.x0", y(h)[0], "l.x1", y(h)[1], w, h)
    return f"""with {_PB}, {LABELS} select case when mw is null then 'none' else 'rotate ' || rotate || case when cut > 0 then ' + cropbox' else '' end end as page, {_WHO} as who,
case when mw is null then 'no such page' else {at('mw', 'mh')} end as stage, case when mw is null then '' else {at('vw', 'vh')} end as model, count(*) as n from lab l left join pb on l.doc_no = pb.doc_no and l.side = pb.side group by all"""


def _take(name: str, source: str, take: str, seed: int) -> str:
    """CTE name(doc_no, decade, taken): per decade the first round_even(size * take / all) by hash."""
    return f"""{name} as (select doc_no, decade, row_number() over (partition by decade order by md5(concat_ws('|', doc_no, '{seed}'))) <= round_even(count(*) over (partition by decade) * cast({take} as double) / count(*) over (), 0) as taken from {source})"""


def _seed(n: int) -> str:
    return f"""h{n} as (select doc_no from docs qualify row_number() over (order by md5(concat_ws('|', doc_no, '{n}'))) <= greatest(1, round_even((select count(*) from docs) * 0.3, 0))),
hc{n} as materialized (select * from cls where doc_no in (select doc_no from h{n})), he{n} as (select * from edge where pred_id in (select pred_id from hc{n})), ht{n} as (select * from truth where doc_no in (select doc_no from h{n})),
g{n} as (select * from (with {hits(f'hc{n}')}, {measured(f'hc{n}', f'he{n}', f'ht{n}')} select config_id from m where net > 0))"""


_FORM = "(cast(substring(d, 1, 2) as int) between 1 and 31 or cast(substring(d, 1, 2) as int) between 41 and 71) and cast(substring(d, 3, 2) as int) between 1 and 12"
_CAPTION = r"(regexp_matches(x, '(?i)(f\s*[øo]dsels\s*n|pers\s*[.\s]*n|p\s*\.\s*nr|f\s*\.\s*nr|fnr|personnummer)') and regexp_matches(x, '(^|[^0-9])[0-9]{5}([^0-9]|$)'))"


def _guarded(columns: tuple[str, ...]) -> str:
    """CTEs up to safe(nr): the rows of man with a candidate or a caption in any of the readings."""
    texts = " union all ".join(f"select nr, {c} as x from man where {c} is not null" for c in columns)
    return f"""rd as ({texts}), rt as (select row_number() over () as id, nr, x, translate(x, 'oOsSlIbB', '00551166') as f from rd),
rp as (select id, nr, x, f, list_filter(generate_series(1, length(f)), lambda i: regexp_matches(substring(f, i, 1), '[0-9]')) as pos from rt),
rw as (select nr, list_aggregate(list_transform(generate_series(i, i + 10), lambda j: substring(f, pos[j], 1)), 'string_agg', '') as d, list_transform(generate_series(i, i + 9), lambda j: substring(x, pos[j] + 1, pos[j + 1] - pos[j] - 1)) as gaps from (select *, unnest(generate_series(1, len(pos) - 10)) as i from rp where len(pos) >= 11)),
safe as (select nr from rw where len(list_filter(gaps, lambda g: not regexp_full_match(g, '[ .,_-]{{0,2}}'))) = 0 and len(list_filter(gaps, lambda g: length(g) > 0)) <= 3 and {_FORM} union select nr from rd where {_CAPTION})"""


_READ_RESULT = "res as (select * from (select distinct on (pred_id) * from resultat where pred_id is not null) where side is not null and x0 is not null and y0 is not null and x1 is not null and y1 is not null)"

ORACLE |= {
    "label_row_texts": f"with {PRED} select pred_id, cast(doc_no as varchar) as fil_revisjon_id, cast(side as varchar) as sidetall, {', '.join(f'printf(chr(37) || {chr(39)}.2f{chr(39)}, {e}) as {n}' for n, e in (('x', f'least(x0, x1) / {PT}'), ('y', f'least(y0, y1) / {PT}'), ('width', f'abs(x1 / {PT} - x0 / {PT})'), ('height', f'abs(y1 / {PT} - y0 / {PT})')))} from pred",
    "label_row_texts_bottom": f"with {PRED} select pred_id, printf('%.2f', bilde_hoyde / {PT} - greatest(y0, y1) / {PT}) as y, printf('%.2f', abs(y1 / {PT} - y0 / {PT})) as height from pred",
    "labels_from_below": f"with {PRED}, {LABELS}, {SIZE} select label_id, round(x0 / pw, 6) as x0, round((ph - y1) / ph, 6) as y0, round(x1 / pw, 6) as x1, round((ph - y0) / ph, 6) as y1 from lab l join size s on l.doc_no = s.doc_no and l.side = s.side",
    "prefilters": f"with {PRED} select pred_id from pred where abs(x1 - x0) / {PT} <= 80 and not (kilde = 'yolo' and coalesce(conf < 0.4, false))",
    "before_after": f"""with {MATCH}, kept as (select * from scoped where abs(x1 - x0) / {PT} <= 40), kp as (select * from pairs where pred_id in (select pred_id from kept)),
kb as (select t.label_id, t.norm_area as truth_area, b.pred_id, coalesce(b.overlap, 0.0) as overlap, coalesce(b.cov_area, 0.0) >= 0.32 as hit from truth t left join (select * from kp qualify row_number() over (partition by label_id order by overlap desc, pred_id) = 1) b using (label_id)),
ev as (select 1 as k, count(*) filter (hit) as hit, round(count(*) filter (hit) / count(*), 6) as recall, (select count(*) from scoped) as pred, (select count(*) from scoped) - count(distinct case when hit then pred_id end) as surplus, round(sum(overlap) / sum(truth_area), 6) as overlap from best
       union all select 2, count(*) filter (hit), round(count(*) filter (hit) / count(*), 6), (select count(*) from kept), (select count(*) from kept) - count(distinct case when hit then pred_id end), round(sum(overlap) / sum(truth_area), 6) from kb),
l as (select k, unnest(['hit', 'recall', 'pred', 'surplus', 'overlap']) as measure, unnest([hit::double, recall, pred::double, surplus::double, overlap]) as v from ev)
select measure, max(v) filter (k = 1) as before, max(v) filter (k = 2) as after, round(max(v) filter (k = 2) - max(v) filter (k = 1), 6) as change from l group by measure""",
    "preflight": f"with {PRED}, r as (select count(*) as n, count(*) filter (coalesce(har_tokens, 0) <> 0) as n_features, count(maks_luke) as n_window, count(*) filter ((kilde = 'yolo' and short_side < 7) or (kilde = 'paddle' and (short_side < 7 or long_side < 20 or elongation > 6))) as below from pred) select *, below > 0 as raw from r",
    "labelled_pages": f"with {LABELS} select doc_no, string_agg(side, ',' order by side) as pages from (select distinct doc_no, side from lab) group by doc_no",
    "drawn_pages": f"with {MATCH}, n as (select doc_no, min(navn) as navn from scoped group by 1) select navn, side from scoped union select n.navn, t.side from truth t join n using (doc_no)",
    "truth_lists": f"with {MATCH}, k as (select label_id, count(*) as k from edge group by 1), h as (select pred_id, string_agg(label_id, ';' order by label_id) as label_ids, min(k) as dekkere from edge join k using (label_id) group by 1) select pred_id, coalesce(label_ids, '') as label_ids, coalesce(dekkere, 0) as dekkere from cls left join h using (pred_id)",
    "page_severity": f"""with {MATCH}, {_NOISE_GONE},
kinds as (select pred_id, doc_no, side, case when klasse = 'BOM' then 'surplus' when pred_id in (select pred_id from edge where label_id in (select label_id from lostt)) then 'critical' else 'redundant' end as kind from cls where pred_id in (select pred_id from gone)),
p as (select doc_no, side, count(*) filter (kind = 'critical') as critical, count(*) filter (kind = 'redundant') as redundant, count(*) filter (kind = 'surplus') as surplus from kinds group by all), l as (select doc_no, side, count(distinct label_id) as n_lost from truth where label_id in (select label_id from lostt) group by all)
select p.doc_no, p.side, coalesce(n_lost, 0) as n_lost, critical, redundant, surplus from p left join l on p.doc_no = l.doc_no and p.side = l.side order by coalesce(n_lost, 0) desc, critical desc, surplus desc, p.doc_no, p.side limit 25""",
    "uncovered_order": f"""with {MATCH}, r as (select b.label_id, b.doc_no, b.side, l.y0, l.x0, case when b.cov < 0.32 then 'udekket' else 'daarlig_dekket' end as gruppe from best b join lab l using (label_id) where b.cov < 0.999999)
select label_id, gruppe, row_number() over (order by case gruppe when 'udekket' then 0 else 1 end, doc_no, side, y0, x0, label_id) as nr from r""",
    "discarded_lookup": f"""with {MATCH}, {_NOISE_GONE}, tk as (select t.doc_no, t.side, round(l.x0 * 10, 0) as kx, round(l.y0 * 10, 0) as ky, t.label_id, t.label_id in (select label_id from lostt) as lost from truth t join lab l using (label_id)),
h as (select doc_no, side, kx, ky, arg_max(lost, label_id) as lost from tk group by all), odd as (select *, round(x0 * 10, 0) as kx, round(y0 * 10, 0) as ky from lab where (x1 - x0) < 2 * (y1 - y0))
select o.label_id, case when lost is null then 'outside' when lost then 'coverage lost' else 'still covered' end as state from odd o left join h on o.doc_no = h.doc_no and o.side = h.side and o.kx = h.kx and o.ky = h.ky""",
    "sent_evaluation": f"""with {MATCH}, sent as (select distinct {doc('fil')} as doc_no from splittliste where lower(trim(splitt)) = 'test' and {doc('fil')} is not null), b as (select * from best where doc_no in (select doc_no from sent))
select count(*) as truth, count(*) filter (hit) as hit, (select count(*) from scoped where doc_no in (select doc_no from sent) and pred_id not in (select pred_id from b where hit)) as surplus from b""",
    "scope_sizes": f"with {PRED}, {LABELS} select 'labelled' as scope, count(distinct doc_no) as docs, count(*) as boxes from pred where doc_no in (select doc_no from lab where status <> 'REJECTED') union all select 'all', count(distinct doc_no), count(*) from pred",
    "zero_area_tally": f"with {LABELS} select case when doc_no is null or side is null then 'no page' when x is null or y is null or wd is null or hg is null then 'no box' when wd = 0 or hg = 0 then 'no area' when status = 'REJECTED' then 'rejected' else 'kept' end as reason, count(*) as n from lab0 group by 1",
    "live_summary": f"with {PRED} select coalesce(kilde, 'SUM') as kilde, count(distinct doc_no) as docs, count(*) as boxes from pred group by rollup (kilde) having count(*) > 0",
    "profile_shares": "select event_type as name, count(*) as n, round(count(*) / (select count(*) from events), 6) as share from events group by 1 order by n desc, name limit 3",
    "constrained_sweep": f"with {MATCH}, {_AXIS_ROWS}, {hits()}, {measured()} select config_id, lost, ov_rm, net from m where lost <= 2 and (lost = 0 or ov_per_lost > 5)",
    "seed_shortlist": f"with {MATCH}, {config_rows(production_rows())}, docs as (select distinct doc_no from cls), {_seed(1)}, {_seed(2)}, {_seed(3)} select config_id, count(*) as seeds from (select * from g1 union all select * from g2 union all select * from g3) group by 1",
    "rejected_shapes": f"""with {LABELS}, s as (select status, x1 - x0 as w, y1 - y0 as h from lab), m as (select status, w * h * (300 / 72) * (300 / 72) as px, greatest(w / h, h / w) as e, least(w, h) as k from s),
r as (select status, unnest(case when px < 965 then ['area Npx2'] else list_filter([case when e < 1.44 then 'min elongation broken by N' end, case when e > 9 then 'max elongation broken by N' end, case when k < 6 then 'min short side broken by N' end], lambda x: x is not null) end) as reason from m)
select reason, status, count(*) as n, round(count(*) / (select count(*) from s where s.status = r.status), 6) as share from r group by reason, status""",
    "page_census": f"""with {_PB}, d as (select doc_no, bool_or(rotate in (90, 270)) as turned, bool_or(cut > 0) as crop from pb group by 1)
select 'rotate ' || rotate as what, count(*) as n, round(count(*) / (select count(*) from pb), 6) as share from pb group by rotate
union all select 'pages with crop box', count(*) filter (cut > 0), round(count(*) filter (cut > 0) / count(*), 6) from pb
union all select 'documents turned', count(*) filter (turned), round(count(*) filter (turned) / count(*), 6) from d union all select 'documents with crop box', count(*) filter (crop), round(count(*) filter (crop) / count(*), 6) from d""",
    "placement_census": _placed(False),
    "placement_census_bottom": _placed(True),
    "burned_labels": f"with {LABELS} select {_WHO} as who, status, count(*) as n from lab where not ml or status in ('ACCEPTED', 'MOVED') group by all",
    "answer_keys": f"with {_ITEMS} select nr, key, substring(sha256('{{\"max_tokens\": 150, \"mode\": \"crop\", \"model\": \"m\", \"prompt\": \"p\", \"temperature\": 0.0, \"templates\": \"\", \"thinking\": null}}'), 1, 16) as version from items",
    "answer_lookup": f"""with {_CACHE}, best_ as (select a.key, a.svar_ from ans a join cache c on a.key = c.key and a.raw = c.raw) select i.nr, coalesce(min(b.svar_), 'ja') as svar, case when min(b.svar_) is null then 'miss' else 'hit' end as note from items i left join best_ b on i.key = b.key group by i.nr""",
    "unreadable_answers": f"with {_RAW}, {answers('rawt')} select verdict_id, {_NOTE} as note from ans where feil_ <> ''",
    "answer_parse": f"with {_RAW}, {answers('rawt')} select verdict_id, svar_ as svar, tall_ as tall, begrunnelse_ as begrunnelse, feil_ as feil, linjen, sifre_paa_linjen, dato_gyldig, holdepunkt from ans",
    "answer_outcome": f"with {_RAW}, {answers('rawt')} select svar_ as svar, feil_ as feil, count(*) as n from ans group by all",
    "files_answers": f"with {_CACHE} select key, length(raw) as n from cache",
    "verdict_counters": f"""with {JUDGED}, j as (select kilde, svar = 'nei' as dropped, case when feil = '' then 'hit' else 'call failed' end as note from judged), b as (select * from j union all select 'SUM', dropped, note from j)
select kilde, count(*) as judged, count(*) filter (dropped) as dropped, count(*) filter (note = 'hit') as hits, case when count(*) filter (note <> 'hit') > 0 then 'call failed=' || count(*) filter (note <> 'hit') else '' end as not_cached from b group by kilde""",
    "failed_documents": f"with {JUDGED} select doc_no, count(*) filter (feil <> '') as failed, count(*) as judged from judged group by doc_no having count(*) filter (feil <> '') > 0",
    "undecided_rows": f"with {MANIFEST}, {_guarded(('ocr_linje', 'ocr_blokk'))} select nr from man where nr not in (select nr from safe)",
    "final_removal": f"with {JUDGED}, {_guarded(('linje_', 'ocr_linje', 'ocr_tekst')).replace('linje_ as x from man where linje_', 'linjen as x from judged where linjen')} select nr, not (svar = 'nei' and nr not in (select nr from safe) and kilde = 'yolo') as kept from judged",
    "rule_baselines": f"""with {MANIFEST}, {_guarded(('ocr_linje',)).replace(f' union select nr from rd where {_CAPTION}', '')}, b as (select nr, nr not in (select nr from safe) as none, regexp_matches(coalesce(ocr_tekst, ''), '[0-9][.,][0-9]') as dec from man)
select nr, case when none then 'nei' else 'ja' end as fnr_kandidat, case when dec then 'nei' else 'ja' end as desimal, case when none and dec then 'nei' else 'ja' end as begge from b""",
    "short_errors": r"select distinct verdict_id, substring(regexp_replace(string_split(trim(regexp_replace(feil, '\s+', ' ', 'g')), 'Error Message Summary')[-1], '^[ :-]+|[ :-]+$', '', 'g'), 1, 200) as short, regexp_matches(feil, 'Out of memory|ResourceExhausted|OutOfMemory|CUDA out of memory') as memory from verdicts where feil is not null",
    "review_table": f"""with {JUDGED}, v as (select j.*, b.begrunnelse from judged j join (select * from verdicts where nr is not null qualify row_number() over (partition by nr order by case when coalesce(feil, '') = '' then 0 else 1 end, kjort, verdict_id) = 1) b on j.nr = b.nr),
m as (select *, case when svar = (case when gruppe = 'BOM' then 'nei' else 'ja' end) then '✅' when gruppe = 'BOM' then '🟡' else '❌' end as riktig from v)
select nr, riktig, klasse, svar, '| ' || nr || ' | ' || riktig || ' | ' || replace(klasse, '|', '/') || ' | ' || svar || ' | ' || replace(coalesce(begrunnelse, ''), '|', '/') || ' |' as linje from m""",
    "verdict_marks": f"with {JUDGED} select case when gruppe = 'BOM' and svar = 'ja' then 'missed' when gruppe <> 'BOM' and svar = 'nei' then 'lost' else 'right' end as mark, klasse, count(*) as n from judged group by all",
    "synced_classes": f"with {JUDGED} select nr, case when nr % 3 <> 0 and nr % 5 = 0 then 'TREFF' else klasse end as klasse from judged",
    "files_judgements": f"with {JUDGED} select nr, case when svar = (case when gruppe = 'BOM' then 'nei' else 'ja' end) then '✅' when gruppe = 'BOM' then '🟡' else '❌' end as riktig, klasse, svar, (select count(*) from judged) as lines from judged",
    "holdout_pools": f"""with {LABELS}, {META}, dm as (select doc_no, coalesce(cast(decade as varchar), 'ukjent') as decade, doc_no in (select doc_no from lab) as l from meta), fr as (select * from dm where l), ng as (select * from dm where not l),
{_take('held', 'fr', 'round_even((select count(*) from fr) * 0.2::double, 0)', 42)}, {_take('n1', 'ng', 'least(40, (select count(*) from ng))', 43)}, rs as (select doc_no, decade from n1 where not taken), {_take('n2', 'rs', 'least(60, (select count(*) from rs))', 44)}
select doc_no, case when taken then 'holdout' else 'train' end as pool from held union all select doc_no, 'holdout negative' from n1 where taken union all select doc_no, 'train negative' from n2 where taken""",
    "split_with_negatives": f"""with {_PAGED}, {LABELS}, d as (select doc_no, pages, row_number() over (order by md5(concat_ws('|', doc_no, '42'))) as r from paged where doc_no in (select doc_no from lab)),
f as (select *, coalesce(sum(pages) over (order by r rows between unbounded preceding and 1 preceding), 0) as filled, sum(pages) over () as total from d),
pos as (select doc_no, pages, case when filled < total * 0.8::double then 'train' when filled < total * (0.8::double + 0.1::double) then 'val' else 'test' end as split from f),
ng as (select doc_no, pages, sum(pages) over (order by md5(concat_ws('|', doc_no, '42')) rows between unbounded preceding and current row) as upto from paged where doc_no not in (select doc_no from lab)),
tg as (select trunc(coalesce(sum(pages) filter (split = 'train'), 0) * 0.1::double) as t1, trunc(coalesce(sum(pages) filter (split = 'val'), 0) * 0.1::double) as t2, trunc(coalesce(sum(pages) filter (split = 'test'), 0) * 0.1::double) as t3 from pos),
e1 as (select case when t1 = 0 then 0 else coalesce((select min(upto) from ng where upto >= t1), (select max(upto) from ng), 0) end as e from tg), e2 as (select case when t2 = 0 then (select e from e1) else coalesce((select min(upto) from ng where upto >= t2 + (select e from e1)), (select max(upto) from ng), 0) end as e from tg),
e3 as (select case when t3 = 0 then (select e from e2) else coalesce((select min(upto) from ng where upto >= t3 + (select e from e2)), (select max(upto) from ng), 0) end as e from tg)
select doc_no, pages as weight, split from pos union all select doc_no, pages, case when upto <= (select e from e1) then 'train' when upto <= (select e from e2) then 'val' else 'test' end from ng where upto <= (select e from e3)""",
    "split_by_code": f"""with {_PAGED}, {META}, d as (select doc_no, pages as weight from paged join meta using (doc_no) where len(list_filter(codes, lambda c: starts_with(c, 'HJ_'))) > 0 and year between 1950 and 2020),
f as (select *, coalesce(sum(weight) over (order by md5(concat_ws('|', doc_no, '42')) rows between unbounded preceding and 1 preceding), 0) as filled, sum(weight) over () as total from d)
select doc_no, weight, case when filled < total * 0.8::double then 'train' when filled < total * (0.8::double + 0.1::double) then 'val' else 'test' end as split from f""",
    "pages_without_labels": f"with {PRED}, {LABELS} select distinct doc_no, side from pred where (doc_no, side) not in (select (doc_no, side) from lab)",
    "first_pages": f"with {_PAGED} select doc_no, pages as weight from paged qualify coalesce(sum(pages) over (order by doc_no rows between unbounded preceding and 1 preceding), 0) < 100",
    "hard_union": f"with {JUDGED} select {doc('fil')} as doc_no from splittliste where lower(trim(splitt)) = 'val' and {doc('fil')} is not null union select * from (select doc_no from judged where doc_no is not null and ((gruppe = 'BOM' and svar = 'ja') or (gruppe = 'DEKKENDE' and svar = 'nei')) group by 1 order by count(*) desc, doc_no limit 20)",
    "chosen_files": "select distinct trim(fil) as fil from splittliste where contains(string_split(trim(fil), '/')[-1], '102') or contains(string_split(trim(fil), '/')[-1], '33.pdf')",
    "batch_sizes": _BATCH,
    "breaker_replay": _BREAKER,
    "progress": "with h as (select epoch_us(date_trunc('hour', ts)) as hour, count(*) as k from events group by 1) select hour, sum(k) over (order by hour) as done, round(sum(k) over (order by hour) / sum(k) over (), 6) as share from h",
    "files_results": f"with {_READ_RESULT} select navn, side, count(*) as n, round(sum(x0), 3) as x0, count(case when not isnan(yolo_conf) then 1 when yolo_conf is not null then 1 end) as with_conf, count(maks_luke) as with_window from res group by all",
    "files_result_pages": f"with {_READ_RESULT} select navn, side, count(*) as n, round(min(y0), 4) as first from res where navn is not null group by all",
    "files_id_lists": f"with {PRED}, {LABELS} select 'retracted' as list, count(*) as n, max(label_id) as highest from lab where md5(label_id) like '0%' union all select 'processed', count(distinct doc_no), cast(max(doc_no) as varchar) from pred",
    "files_added": f"with {_SIDES}, w as (select doc_no, side, round(x0, 2) as x0, round(y0, 2) as y0, round(x1 - x0, 2) as wd, round(y1 - y0, 2) as hg from added) select distinct doc_no, side, x0, y0, round(x0 + wd, 2) as x1, round(y0 + hg, 2) as y1 from w where wd > 0 and hg > 0",
    "files_sent": f"with {PRED} select doc_no, side, count(*) as n, round(sum(round(least(x0, x1) / {PT}, 2)), 2) as x0 from pred group by all",
    "files_box_list": f"with {MANIFEST}, l as (select * from man where nr % 4 = 0 and x0 is not null and doc_no is not null and side is not null) select distinct m.nr from man m join l on m.doc_no = l.doc_no and m.side = l.side where {' and '.join(f'abs(m.{c} - l.{c} - 1.5) <= 3' for c in ('x0', 'y0', 'x1', 'y1'))}",
    "files_label_files": f"with {PRED}, {LABELS} select doc_no, side, cast(count(*) as int) as n_lines from lab where (doc_no, side) in (select (doc_no, side) from pred) group by all",
    "files_code_lists": f"with {META} select code, count(distinct doc_no) as n from (select unnest(codes) as code, doc_no from meta) group by 1",
    "files_manifest": f"with {MANIFEST}, f as (select count(*) filter (klasse <> 'BOM') / count(*) filter (klasse <> 'BOM' and nr % 2 = 0) as f from man) select klasse, count(*) as n, round(case when klasse = 'BOM' then 1.0 else (select f from f) end, 6) as factor from man where klasse = 'BOM' or nr % 2 = 0 group by klasse",
    "files_run": f"""with {MATCH}, o as (select count(*) as truth, count(*) filter (hit) as hit, (select count(*) from scoped) as pred, (select count(*) from scoped) - count(distinct case when hit then pred_id end) as surplus from best)
select 'Overall' as section, unnest(['truth', 'hit', 'pred', 'surplus']) as key, unnest([truth::varchar, hit::varchar, pred::varchar, surplus::varchar]) as value from o
union all select 'Details', 'pages', cast(count(*) as varchar) from (select doc_no, side from best group by all having count(*) filter (not hit) > 0) union all select 'Log', 'folder', 'x'""",
    "queue_replace": f"with {PRED} select doc_no, cast(case doc_no % 3 when 1 then 0 when 2 then least(2, count(*)) else count(*) end as int) as n from pred where kilde = 'yolo' group by doc_no",
    "png_headers": "select navn, side, cast(min(bilde_bredde) as int) as width, cast(min(bilde_hoyde) as int) as height from resultat where navn is not null and side is not null group by all having min(bilde_bredde) is not null and min(bilde_hoyde) is not null",
    "poisson_bounds": f"with recursive {JUDGED}, {_poisson('''select distinct k from (select doc_no, count(*) as k from judged where svar = 'nei' group by 1)''')} select k, round(upper, 4) as upper from bound",
    "verdict_bound": f"""with recursive {JUDGED}, j as (select count(*) filter (gruppe = 'DEKKENDE') as n_dek, count(*) filter (gruppe = 'DEKKENDE' and svar = 'nei') as n_dek_nei from judged), {_poisson('select n_dek_nei as k from j')}
select n_dek_nei, round(upper * ((select count(*) from man where gruppe = 'DEKKENDE') / n_dek), 4) as loss_upper from j join bound on k = n_dek_nei""",
    "rule_reasons_histogram": f"with {PRED}, {config_rows(production_rows())}, {_reasons()} select reason, count(*) as n from why group by reason",
    "detector_only": f"""with {PRED}, a as (select *, round(conf, 3) as c3 from pred where conf is not null) select pred_id, 'yolo' as kilde, c3 as conf from a
where areal_px >= 965 and short_side >= 7 and long_side >= 20 and elongation <= 6 and (c3 >= 0.5 or (elongation between 1.44 and 9 and short_side >= 6))""",
    "lines_from_tokens": f"with {_GRID} select doc, 1 as page, cast(line_no as int) as line_no, text, cast(len(string_split(text, ' ')) as int) as n_tokens, cast({_DIGITS} as int) as n_digits from gl",
    "marked_lines": f"with {_GRID_SCAN} select g.doc, 1 as page, cast(line_no + 1 as int) as line_no, g.text, cast(coalesce(len(c.picked), 0) as int) as n, cast(coalesce(len(c.picked), 0) as int) as valid from gl g left join chosen c on c.nr = g.id",
    "redaction_boxes": f"""with {_GRID_SCAN}, picked as (select nr as id, unnest(picked) as i from chosen),
b as (select g.doc, g.line, g.line_no, w.gaps, list_transform(generate_series(0, 10), lambda k: (list_filter(generate_series(1, length(g.raw)), lambda q: regexp_matches(substring(translate(g.raw, 'oOsSlIbB', '00551166'), q, 1), '[0-9]')))[p.i + k] - 1) as r from picked p join gl g on g.id = p.id join windows w on w.nr = p.id and w.i = p.i)
select doc, 1 as page, cast(line_no as int) as line_no, floor(greatest((28.0 * (r[6] + 1) + 28.0 * r[7]) / 2 - 9.8, 28.0 * r[6] + 14)) as x0, floor(line * 60 + 25 - 42.0) as y0, ceil(28.0 * (r[11] + 1) + 9.8) as x1, ceil(line * 60 + 25 + 42.0) as y1, true as mod11, 0.99 as rec,
round(greatest(0, {', '.join(f'r[{j + 1}] - r[{j}] - 1' for j in _PAIRS)})::double, 2) as maks_luke, case when {' or '.join(f"regexp_matches(gaps[{j}], '[.,]')" for j in _PAIRS)} then 1.0 else 0.0 end as har_desimal_luke from b""",
    "secret_scan": f"""with x as (select 'text' as place, doc_id as rad_id, text as x from documents union all select distinct 'ocr_tekst', nr, ocr_tekst from manifest), ln as (select place, rad_id, unnest(string_split(x, chr(10))) as t, unnest(generate_series(1, len(string_split(x, chr(10))))) as line from x where x is not null),
h as (select place, rad_id, line, t, unnest(generate_series(1, length(t))) as col from ln where not contains(t, 'fnr-ok') and regexp_matches(t, '[0-9]{{2}}[ .-]?[0-9]{{2}}[ .-]?[0-9]{{2}}[ .-]?[0-9]{{5}}')),
k as (select place, rad_id, line, col, regexp_replace(regexp_extract(substring(t, col, 14), '^[0-9]{{2}}[ .-]?[0-9]{{2}}[ .-]?[0-9]{{2}}[ .-]?[0-9]{{5}}'), '[^0-9]', '', 'g') as d from h
      where (col = 1 or not regexp_matches(substring(t, col - 1, 1), '[0-9]')) and regexp_matches(substring(t, col, 15), '^[0-9]{{2}}[ .-]?[0-9]{{2}}[ .-]?[0-9]{{2}}[ .-]?[0-9]{{5}}($|[^0-9])')),
p as (select *, cast(substring(d, 1, 2) as int) as dd, cast(substring(d, 3, 2) as int) as mm, cast(substring(d, 5, 2) as int) as yy, cast(substring(d, 7, 3) as int) as s from k where length(d) = 11 and {_mod11('d')}),
q as (select *, case when dd between 41 and 71 then dd - 40 else dd end as day, case when mm between 81 and 92 then mm - 80 when mm between 41 and 52 then mm - 40 else mm end as month, case when s <= 499 then 1900 + yy when s <= 749 and yy >= 54 then 1800 + yy when yy <= 39 then 2000 + yy when s >= 900 then 1900 + yy end as year from p)
select place, rad_id, cast(line as int) as line, cast(col as int) as column, case when mm between 81 and 92 then 'synthetic' when mm between 41 and 52 then 'h-nummer' when dd between 41 and 71 then 'd-nummer' else 'fnr' end as kind from q where try_cast(printf('%04d-%02d-%02d', year, month, day) as date) is not null""",
}
ORACLE["files_ranking"] = f"select cut, conf, miss, over from ({ORACLE['rank_models']})"
