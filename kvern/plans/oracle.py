"""The same results in plain SQL over the same tables, for every query that SQL can express."""

from __future__ import annotations

from itertools import product

# Everything below is written from the rules themselves and imports nothing of the code under test, so that a wrong constant there shows.

# The features of a box, the shape parameters (measure, comparison that rejects), all parameters.
FEATURES = (
    "har_tokens", "n_siffer", "n_bokstaver", "rec_min", "rec_median", "rec_min_linje", "n_siffer_linje", "siffer_run", "har_fnr_kandidat", "har_desimal_naer", "har_00_run", "har_orgnr",
    "har_org_ord", "lang_run", "maks_luke", "har_desimal_luke",
)
SHAPE = {
    "min_elongation": ("elongation", "<"), "max_elongation": ("elongation", ">"), "max_height": ("h", ">"), "min_height": ("h", "<"), "max_width": ("w", ">"), "min_width": ("w", "<"), "min_short_side": ("short_side", "<"),
    "max_short_side": ("short_side", ">"), "min_long_side": ("long_side", "<"), "max_long_side": ("long_side", ">"), "max_area": ("area", ">"),
}
PARAMETERS = (
    *SHAPE, "min_area_px", "conf_threshold", "min_digits", "max_letters", "min_digits_run", "require_fnr_candidate", "reject_decimal", "rec_veto", "ocr_conf_exempt", "reject_00_run", "reject_orgnr", "reject_org_ord", "line_veto",
    "reject_run_6_10", "without_text_conf", "max_gap", "reject_decimal_gap",
)
# What production removes, by name: source and parameters.
_NOISE = {"min_area_px": 965, "min_short_side": 7.0, "min_long_side": 20.0, "max_elongation": 6.0}
RULES = {
    "decimal": ("yolo", {"reject_decimal": 1, "rec_veto": 0.98, "ocr_conf_exempt": 0.6}),
    "decimal_low_tier": ("yolo", {"reject_decimal": 1, "rec_veto": 0.95, "ocr_conf_exempt": 0.4}),
    "line_evidence": ("yolo", {"reject_run_6_10": 8, "reject_orgnr": 1, "line_veto": 0.99, "ocr_conf_exempt": 0.5}),
    "window": ("paddle", {"max_gap": 6.5, "reject_decimal_gap": 1}),
    "coordinates": ("yolo", {"require_fnr_candidate": 1, "reject_decimal": 1}),
    "sectioning_yolo": ("yolo", {"max_short_side": 40.0, "max_long_side": 80.0, "min_digits": 6, "rec_veto": 0.98, "ocr_conf_exempt": 0.5}),
    "sectioning_paddle": ("paddle", {"min_elongation": 3.0, "max_short_side": 40.0, "max_long_side": 80.0}),
}
ANY = {"yolo": _NOISE, "paddle": _NOISE, "yolo_vertikal": {"min_area_px": 965, "min_long_side": 30.0}, "begge": {"min_area_px": 965}}
GATED = {"min_elongation": 1.44, "max_elongation": 9.0, "min_short_side": 6.0, "conf_threshold": 0.5}

def doc(c: str) -> str:
    return f"try_cast(nullif(regexp_extract(trim(string_split(trim({c}), '/')[-1]), '^0*([0-9]+)', 1), '') as bigint)"


def num(c: str) -> str:
    n = f"try_cast(replace(trim({c}), ',', '.') as double)"
    return f"(case when isnan({n}) or isinf({n}) then null else {n} end)"


def known(c: str) -> str:
    return f"(case when not isnan({c}) then {c} end)"


PRED = f"""
pred0 as (
    select *, {doc('navn')} as doc_no, abs(x1 - x0) / (300 / 72) as w, abs(y1 - y0) / (300 / 72) as h
    from (select distinct on (pred_id) * from resultat where pred_id is not null)
),
pred as (
    select pred_id, navn, doc_no, side, bilde_bredde, bilde_hoyde, x0, y0, x1, y1, w, h,
           x0 / bilde_bredde as nx0, y0 / bilde_hoyde as ny0, x1 / bilde_bredde as nx1, y1 / bilde_hoyde as ny1,
           greatest(0.0, x1 / bilde_bredde - x0 / bilde_bredde) * greatest(0.0, y1 / bilde_hoyde - y0 / bilde_hoyde) as norm_area,
           greatest(w / h, 1.0 / (w / h)) as elongation, least(w, h) as short_side, greatest(w, h) as long_side, w * h as area, abs(x1 - x0) * abs(y1 - y0) as areal_px,
           coalesce(nullif(lower(trim(kilde)), ''), 'unknown') as kilde, {known('yolo_conf')} as conf, {known('paddle_rec_score')} as rec,
           {', '.join(f'{known(f)} as {f}' for f in FEATURES)}
    from pred0 where doc_no is not null and side is not null and w > 0 and h > 0 and bilde_bredde > 0 and bilde_hoyde > 0
)"""

LABELS = f"""
lab0 as (
    select id as label_id, {doc('fil_revisjon_id')} as doc_no, cast({num('sidetall')} as int) as side, {num('x')} as x, {num('y')} as y, {num('width')} as wd, {num('height')} as hg,
           coalesce(nullif(upper(trim(type)), ''), '(empty)') as type, coalesce(nullif(upper(trim(ml_status)), ''), '') as status, coalesce(lower(trim(ml_generated)) = 'true', false) as ml, coalesce(versjon, 1) as versjon
    from labels where id is not null
    qualify row_number() over (partition by id order by coalesce(versjon, 1) desc, lastet desc nulls last) = 1
),
lab as (
    select label_id, doc_no, side, least(x, x + wd) as x0, least(y, y + hg) as y0, greatest(x, x + wd) as x1, greatest(y, y + hg) as y1, type, status, ml, versjon
    from lab0 where doc_no is not null and side is not null and greatest(x, x + wd) > least(x, x + wd) and greatest(y, y + hg) > least(y, y + hg)
)"""

MATCH = f"""{PRED}, {LABELS},
size as (select doc_no, side, arg_min(bilde_bredde, pred_id) / (300 / 72) as pw, arg_min(bilde_hoyde, pred_id) / (300 / 72) as ph from pred group by all),
scoped as (select * from pred where doc_no in (select doc_no from lab where status <> 'REJECTED')),
truth as (
    select l.label_id, l.doc_no, l.side, l.type, l.status, l.x0 / coalesce(pw, 595.0) as nx0, l.y0 / coalesce(ph, 842.0) as ny0, l.x1 / coalesce(pw, 595.0) as nx1, l.y1 / coalesce(ph, 842.0) as ny1,
           (l.x1 - l.x0) >= (l.y1 - l.y0) as horizontal,
           greatest(0.0, l.x1 / coalesce(pw, 595.0) - l.x0 / coalesce(pw, 595.0)) * greatest(0.0, l.y1 / coalesce(ph, 842.0) - l.y0 / coalesce(ph, 842.0)) as norm_area
    from lab l left join size s on l.doc_no = s.doc_no and l.side = s.side
    where l.status <> 'REJECTED' and l.doc_no in (select doc_no from pred)
),
pairs as materialized (
    select pred_id, label_id, pred_area, truth_area, ox * oy as overlap, ox * oy / truth_area as cov_area,
           case when pred_area > 0 then ox * oy / pred_area else 0.0 end as cov_pred, ox * oy / (truth_area + pred_area - ox * oy) as iou,
           case when horizontal then (case when th > 0 then oy / th else 0.0 end) else (case when tw > 0 then ox / tw else 0.0 end) end as cov_short,
           case when horizontal then (case when tw > 0 then ox / tw else 0.0 end) else (case when th > 0 then oy / th else 0.0 end) end as cov_long,
           case when horizontal then (case when th > 0 then dy / th else 9.9 end) else (case when tw > 0 then dx / tw else 9.9 end) end as center_short
    from (
        select p.pred_id, t.label_id, p.norm_area as pred_area, t.norm_area as truth_area, t.horizontal,
               least(p.nx1, t.nx1) - greatest(p.nx0, t.nx0) as ox, least(p.ny1, t.ny1) - greatest(p.ny0, t.ny0) as oy, t.nx1 - t.nx0 as tw, t.ny1 - t.ny0 as th,
               abs((p.nx0 + p.nx1) / 2 - (t.nx0 + t.nx1) / 2) as dx, abs((p.ny0 + p.ny1) / 2 - (t.ny0 + t.ny1) / 2) as dy
        from scoped p join truth t on p.doc_no = t.doc_no and p.side = t.side where t.norm_area > 0
    ) where ox > 0 and oy > 0
),
edge as materialized (select pred_id, label_id, truth_area from pairs where cov_area >= 0.32),
cls as materialized (
    select p.*, coalesce(n_covers, 0) as n_covers, case when n_covers is null then 'BOM' when p.norm_area > 3.0 * covered then 'SLURV' else 'TREFF' end as klasse
    from scoped p left join (select pred_id, count(*) as n_covers, sum(truth_area) as covered from edge group by 1) e using (pred_id)
),
cover as (select t.*, coalesce(n, 0) as n_coverers from truth t left join (select label_id, count(*) as n from edge group by 1) using (label_id)),
best as materialized (
    select t.label_id, t.doc_no, t.side, t.type, t.norm_area as truth_area, b.pred_id, p.kilde, p.conf, coalesce(b.overlap, 0.0) as overlap, coalesce(b.cov_area, 0.0) as cov, coalesce(b.cov_area, 0.0) >= 0.32 as hit
    from truth t left join (select * from pairs qualify row_number() over (partition by label_id order by overlap desc, pred_id) = 1) b using (label_id) left join scoped p on b.pred_id = p.pred_id
)"""

META = f"""
meta as (
    select doc_no, list_sort(list_distinct(list_filter(list_transform(string_split(coalesce(rettsstiftelsestyper, ''), ','), lambda c: upper(trim(string_split(c, ' - ')[1]))), lambda c: c <> ''))) as codes,
           coalesce(lower(trim(er_elektronisk_tinglyst)) in ('true', 't', '1'), false) as electronic, dokument_aar as year, cast(floor(dokument_aar / 10) * 10 as int) as decade,
           coalesce(lower(trim(ml_behandlet)) in ('true', 't', '1'), false) as processed
    from (select *, {doc('fil_revisjon_id')} as doc_no from metadata)
    where doc_no is not null qualify row_number() over (partition by doc_no order by lastet desc nulls last, fil_revisjon_id, rettsstiftelsestyper) = 1
)"""

MANIFEST = f"""
man as (
    select nr, coalesce(doc_no, {doc('fil')}) as doc_no, side, coalesce(nullif(upper(trim(klasse)), ''), '(EMPTY)') as klasse, case when upper(trim(klasse)) = 'BOM' then 'BOM' else 'DEKKENDE' end as gruppe,
           coalesce(nullif(lower(trim(kilde)), ''), 'unknown') as kilde, label_id, dekkere, x0, y0, x1, y1, {known('conf')} as conf, ocr_tekst, ocr_linje, ocr_blokk
    from (select distinct on (nr) * from manifest where nr is not null)
)"""

JUDGED = f"""{MANIFEST},
judged as (
    select m.*, case when lower(trim(v.svar)) = 'nei' then 'nei' else 'ja' end as svar, coalesce(v.feil, '') as feil, v.linjen
    from man m join (select * from verdicts where nr is not null qualify row_number() over (partition by nr order by case when coalesce(feil, '') = '' then 0 else 1 end, kjort, verdict_id) = 1) v on m.nr = v.nr
)"""


def removed(c: str, p: str) -> str:
    """The rule engine as a SQL condition; c and p are the aliases of config and box."""
    on = lambda a, f: f"coalesce({a}.{f}, 0) <> 0"
    z = lambda f: f"coalesce({p}.{f}, 0)"
    shape = " or ".join(f"coalesce({p}.{m} {sign} {c}.{name}, false)" for name, (m, sign) in SHAPE.items())
    return f"""(
    case when coalesce({c}.without_text_conf is not null and {p}.har_tokens = 0 and ({p}.conf is null or {p}.conf < {c}.without_text_conf), false) then true
         when {on(c, 'reject_decimal_gap')} and {on(p, 'har_desimal_luke')} then true
         when coalesce({p}.maks_luke >= {c}.max_gap, false) then true
         when {z('har_tokens')} = 0 then false
         when coalesce({p}.conf >= {c}.ocr_conf_exempt, false) then false
         when {c}.rec_veto is not null and ({p}.rec_min is null or {p}.rec_min < {c}.rec_veto) then false
         when {c}.line_veto is not null and ({p}.rec_min_linje is null or {p}.rec_min_linje < {c}.line_veto) then false
         else coalesce({z('n_siffer')} < {c}.min_digits, false) or coalesce({z('n_bokstaver')} > {c}.max_letters, false) or coalesce({z('siffer_run')} < {c}.min_digits_run, false)
              or ({on(c, 'require_fnr_candidate')} and {z('har_fnr_kandidat')} = 0) or ({on(c, 'reject_decimal')} and {on(p, 'har_desimal_naer')})
              or ({on(c, 'reject_00_run')} and {on(p, 'har_00_run')}) or ({on(c, 'reject_orgnr')} and {on(p, 'har_orgnr')})
              or ({on(c, 'reject_org_ord')} and {on(p, 'har_org_ord')} and ({c}.reject_org_ord < 2 or {z('har_fnr_kandidat')} = 0))
              or ({on(c, 'reject_run_6_10')} and coalesce({p}.lang_run between 6 and (case when {c}.reject_run_6_10 = 1 then 10 else {c}.reject_run_6_10 end), false)) end
    or coalesce({p}.areal_px < {c}.min_area_px, false)
    or (not coalesce({p}.conf >= {c}.conf_threshold, false) and ({shape})))"""


def config_rows(rows: list[tuple[str, str | None, dict]], name: str = "cfg") -> str:
    """A CTE of configs: config_id, kilde and the parameters."""
    values = ",\n".join("(" + ", ".join([f"'{i}'", "null" if k is None else f"'{k}'", *(repr(float(c[p])) if c.get(p) is not None else "null" for p in PARAMETERS)]) + ")" for i, k, c in rows)
    cols = ", ".join(f"cast({p} as double) as {p}" for p in PARAMETERS)
    return f"{name} as (select config_id, cast(kilde as varchar) as kilde, {cols} from (values {values}) v(config_id, kilde, {', '.join(PARAMETERS)}))"


def measured(boxes: str = "cls", edges: str = "edge", truth: str = "truth") -> str:
    """CTEs on top of hit(config_id, pred_id), each removed box of each config; ends with m. ids(config_id) names all configs."""
    return f"""
b as (select h.config_id, c.pred_id, c.klasse, c.area from hit h join {boxes} c on h.pred_id = c.pred_id),
total as (select (select count(*) from {boxes}) as n_pred, (select count(*) from {boxes} where klasse = 'BOM') as n_bom, (select count(distinct label_id) from {edges}) as covered_before, (select count(*) from {truth}) as n_truth),
gone as (select h.config_id, e.label_id, count(*) as k from hit h join {edges} e on h.pred_id = e.pred_id group by all),
lost as (select g.config_id, g.label_id from gone g join (select label_id, count(*) as k from {edges} group by 1) t on g.label_id = t.label_id and g.k = t.k),
crit as (select config_id, count(distinct pred_id) as critical_rm from (select h.config_id, h.pred_id from hit h join {edges} e on h.pred_id = e.pred_id join lost l on l.config_id = h.config_id and l.label_id = e.label_id) group by 1),
per as (
    select config_id, count(*) as n_rm, count(*) filter (klasse = 'BOM') as ov_rm, count(*) filter (klasse = 'SLURV') as oversize_rm, count(*) filter (klasse <> 'BOM') as covering_rm,
           sum(area) as area_rm, sum(case when klasse = 'BOM' then area else 0 end) as ov_area_rm from b group by 1
),
m0 as (
    select i.config_id, coalesce(n_rm, 0) as n_rm, coalesce(ov_rm, 0) as ov_rm, coalesce(oversize_rm, 0) as oversize_rm, coalesce(covering_rm, 0) as covering_rm, coalesce(l.lost, 0) as lost, coalesce(critical_rm, 0) as critical_rm,
           coalesce(area_rm, 0) as area_rm, coalesce(ov_area_rm, 0) as ov_area_rm, total.*
    from ids i left join per using (config_id) left join (select config_id, count(*) as lost from lost group by 1) l using (config_id) left join crit using (config_id) cross join total
),
m as (
    select config_id, lost, round(case when covered_before > 0 then lost * 100.0 / covered_before else 0 end, 4) as lost_pct, ov_rm, round(case when n_bom > 0 then ov_rm * 100.0 / n_bom else 0 end, 4) as ov_pct,
           covering_rm - critical_rm as red_rm, critical_rm, oversize_rm, n_rm, round(area_rm, 2) as area_rm, round(ov_area_rm, 2) as ov_area_rm, covered_before - lost as covered_after,
           round(case when n_truth > 0 then (covered_before - lost) * 100.0 / n_truth else 0 end, 4) as recall_after,
           round(case when n_pred > n_rm then (n_pred - n_bom - covering_rm) * 100.0 / (n_pred - n_rm) else 0 end, 4) as prec_after,
           n_pred - n_bom - covering_rm as correct_after, (n_pred - n_rm) - (n_pred - n_bom - covering_rm) as ov_after, cast(ov_rm - 5.0 * lost as double) as net, round(case when lost > 0 then ov_rm / lost end, 6) as ov_per_lost
    from m0
)"""


def hits(boxes: str = "cls") -> str:
    return f"ids as (select distinct config_id from cfg), hit as materialized (select c.config_id, p.pred_id from {boxes} p join cfg c on (c.kilde is null or c.kilde = p.kilde) where {removed('c', 'p')})"


def production_rows() -> list[tuple[str, str | None, dict]]:
    return [(n, k, c) for n, (k, c) in RULES.items()] + [("any " + k, k, c) for k, c in ANY.items()] + [("gated", None, GATED)]


_PRODUCTION = config_rows(production_rows())


# The grids that are swept (family, source, axes).
_GRIDS = (
    ("geometry", None, {"min_elongation": (None, 1.1, 1.2, 1.3, 1.4, 1.5, 1.7, 2.0, 2.5, 3.0), "max_height": (None, 40, 50, 60, 80), "max_width": (None, 80, 100, 120, 150), "conf_threshold": (None, 0.5)}),
    ("digits", None, {"min_digits": (None, 2, 3, 5, 8, 11), "min_digits_run": (None, 6, 7, 9, 11), "reject_decimal": (None, 1), "rec_veto": (None, 0.80, 0.90, 0.95, 0.98)}),
    ("candidate", None, {"min_digits_run": (None, 6, 7, 9, 11), "require_fnr_candidate": (None, 1), "reject_decimal": (None, 1), "rec_veto": (None, 0.80, 0.90, 0.95, 0.98)}),
    ("line", None, {"require_fnr_candidate": (None, 1), "reject_run_6_10": (None, 9, 10), "line_veto": (None, 0.99, 0.995, 0.999, 0.9999), "ocr_conf_exempt": (None, 0.5, 0.6)}),
    ("orgnr", None, {"reject_00_run": (None, 1), "reject_orgnr": (None, 1), "reject_org_ord": (None, 1, 2), "rec_veto": (None, 0.90, 0.95, 0.98)}),
    ("org line", None, {"reject_00_run": (None, 1), "reject_orgnr": (None, 1), "line_veto": (None, 0.99, 0.999), "ocr_conf_exempt": (None, 0.5)}),
    ("few digits", None, {"min_digits": (None, 4, 5, 6), "rec_veto": (None, 0.95, 0.98), "line_veto": (None, 0.99), "ocr_conf_exempt": (None, 0.5, 0.6)}),
    ("exempt", None, {"reject_decimal": (None, 1), "rec_veto": (None, 0.90, 0.95, 0.98), "ocr_conf_exempt": (None, 0.40, 0.45, 0.50, 0.60, 0.70)}),
    ("window", "paddle", {"reject_decimal_gap": (None, 1), "max_gap": (None, 1.5, 2, 3, 4, 6, 8)}),
    ("noise", None, {"min_short_side": (None, 4, 5, 6, 7), "min_long_side": (None, 15, 20, 25, 30), "max_elongation": (None, 6, 8, 10, 12, 15), "conf_threshold": (None, 0.5)}),
)


def _swept(names: tuple[str, ...] | None = None) -> list[tuple[str, str | None, dict]]:
    """Each parameter set of the grids once per source, under the first family that has it."""
    out: dict = {}
    for family, kilde, axes in _GRIDS:
        if names and family not in names:
            continue
        for values in product(*axes.values()):
            on = {k: v for k, v in zip(axes, values) if v is not None}
            out.setdefault((kilde, *sorted(on.items())), (family + "".join(f" {k}={v:g}" for k, v in on.items()), kilde, on))
    return list(out.values())


_PLAIN = ", ".join(PARAMETERS)
#: The shared grids, and those of geometry and noise for each source of the data; a source without confidences has no gate.
_SWEEP = f"""{config_rows(_swept(), 'shared')}, {config_rows(_swept(('geometry',)), 'own1')}, {config_rows(_swept(('noise',)), 'own2')},
src as (select kilde, count(conf) > 0 as has_conf from cls group by 1),
own as (select 'geometry [' || s.kilde || ']' || substring(config_id, 9) as config_id, s.kilde, {_PLAIN}, 1 as turn from own1 cross join src s where has_conf or conf_threshold is null
        union all select 'noise [' || s.kilde || ']' || substring(config_id, 6), s.kilde, {_PLAIN}, 2 from own2 cross join src s where has_conf or conf_threshold is null),
cfg as (select * exclude (turn) from (select *, 0 as turn from shared union all select * from own) qualify row_number() over (partition by kilde, {_PLAIN} order by turn) = 1)"""
_SWEPT = f"with {MATCH}, {_SWEEP}, {hits()}, {measured()}"


def _operating() -> str:
    sources = ("begge", "paddle", "yolo", "yolo_vertikal")
    groups = {name: [RULES[name]] for name in ("decimal", "decimal_low_tier", "line_evidence", "window")}
    groups["dimensions"] = [(s, ANY[s]) for s in sources] + [(s, GATED) for s in sources]
    rows = [(g, k, c) for g, members in groups.items() for k, c in members]
    sets = ", ".join(f"('{name}', '{g}')" for name, members in [(n, [n]) for n in groups] + [("all", list(groups))] + [(f"without {n}", [x for x in groups if x != n]) for n in groups] for g in members)
    return f"""with {MATCH}, {config_rows(rows)},
one as materialized (select distinct c.config_id as grp, p.pred_id from cls p join cfg c on c.kilde = p.kilde where {removed('c', 'p')}),
sets as (select * from (values {sets}) v(config_id, grp)), ids as (select distinct config_id from sets),
hit as materialized (select distinct s.config_id, o.pred_id from sets s join one o on s.grp = o.grp), {measured()}"""


_POINT = _operating()
_HOLDOUT = """
docs as (select distinct doc_no from cls),
held as (select doc_no from docs qualify row_number() over (order by md5(concat_ws('|', doc_no, '42'))) <= greatest(1, round_even((select count(*) from docs) * 0.3, 0))),
hcls as materialized (select * from cls where doc_no in (select doc_no from held)), hedge as (select * from edge where pred_id in (select pred_id from hcls)), htruth as (select * from truth where doc_no in (select doc_no from held)),
rcls as materialized (select * from cls where doc_no not in (select doc_no from held)), redge as (select * from edge where pred_id in (select pred_id from rcls)), rtruth as (select * from truth where doc_no not in (select doc_no from held) and doc_no in (select doc_no from docs))"""

_SIDES = f"""{LABELS}, {MANIFEST},
retracted as (select label_id from lab where md5(label_id) like '0%'),
noted as (select doc_no, side, least(x0, x1) / (300 / 72) as x0, least(y0, y1) / (300 / 72) as y0, greatest(x0, x1) / (300 / 72) as x1, greatest(y0, y1) / (300 / 72) as y1 from man where klasse = 'BOM' and nr % 7 = 0 and doc_no is not null and side is not null),
added as (
    select distinct 'mangler-' || substring(sha256(concat_ws('|', doc_no, side, printf('%.2f', x0), printf('%.2f', y0), printf('%.2f', x1 - x0), printf('%.2f', y1 - y0))), 1, 12) as label_id, doc_no, side, x0, y0, x1, y1
    from noted where x1 > x0 and y1 > y0
)"""


def same(a: str, b: str) -> str:
    one = lambda p, q: f"(({p}.x0 + {p}.x1) / 2 between {q}.x0 and {q}.x1 and ({p}.y0 + {p}.y1) / 2 between {q}.y0 and {q}.y1)"
    return f"({one(a, b)} or {one(b, a)})"


_POLICY = f"""with {_SIDES},
file as (select l.label_id, doc_no, side, x0, y0, x1, y1, 'file' as origin, case when status = 'REJECTED' then 'excluded REJECTED' when label_id in (select label_id from retracted) then 'retracted' else 'kept' end as outcome from lab l),
extra as (
    select a.label_id, a.doc_no, a.side, 'added' as origin, case when a.label_id in (select label_id from retracted) then 'retracted' when exists (select 1 from file f where f.outcome = 'kept' and f.doc_no = a.doc_no and f.side = a.side and {same('a', 'f')}) then 'present' else 'kept' end as outcome
    from added a
),
decided as (select label_id, doc_no, side, origin, outcome from file union all select * from extra)"""

_TEXT = "t as (select distinct nr, ocr_tekst from manifest where ocr_tekst is not null)"
_SHAPES = ("elongation", "short_side", "long_side", "area")
_QS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _percentile_rows() -> str:
    return "\nunion all\n".join(f"select kilde, klasse, count(*) as n, '{m}' as measure, {q} as q, round(quantile_cont({m}, {q}), 6) as value from cls group by kilde, klasse having count(*) >= 20" for m in _SHAPES for q in _QS)


def _check(d: str, weights) -> str:
    return "(" + " + ".join(f"cast(substring({d}, {i + 1}, 1) as int) * {w}" for i, w in enumerate(weights)) + ")"


def _mod11(d: str) -> str:
    first, second = _check(d, (3, 7, 6, 1, 8, 9, 4, 5, 2)), _check(d, (5, 4, 3, 2, 7, 6, 5, 4, 3, 2))
    return f"((11 - {first} % 11) % 11 = cast(substring({d}, 10, 1) as int) and (11 - {second} % 11) % 11 = cast(substring({d}, 11, 1) as int))"


#: The sliding scan as a fold over digit positions: state is (next position, hits).
_SCAN = f"""
folded as (select nr, ocr_tekst, translate(ocr_tekst, 'oOsSlIbB', '00551166') as f from t where regexp_matches(ocr_tekst, '[0-9oOsSlIbB](?:[ .,_-]{{0,2}}[0-9oOsSlIbB]){{10}}')),
placed as (select nr, ocr_tekst, f, list_filter(generate_series(1, length(f)), lambda i: regexp_matches(substring(f, i, 1), '[0-9]')) as pos from folded),
windows as (
    select nr, i, pos[i] as st, pos[i + 10] as en, list_aggregate(list_transform(generate_series(i, i + 10), lambda j: substring(f, pos[j], 1)), 'string_agg', '') as d,
           list_transform(generate_series(i, i + 9), lambda j: substring(ocr_tekst, pos[j] + 1, pos[j + 1] - pos[j] - 1)) as gaps
    from (select *, unnest(generate_series(1, len(pos) - 10)) as i from placed where len(pos) >= 11)
),
good as (
    select nr, i, st, en, d from windows
    where len(list_filter(gaps, lambda g: not regexp_full_match(g, '[ .,_-]{{0,2}}'))) = 0 and len(list_filter(gaps, lambda g: length(g) > 0)) <= 3
      and (cast(substring(d, 1, 2) as int) between 1 and 31 or cast(substring(d, 1, 2) as int) between 41 and 71) and cast(substring(d, 3, 2) as int) between 1 and 12 and {_mod11('d')}
),
chosen as (
    select nr, list_filter(list_reduce(list_prepend([0::bigint], list_transform(list_sort(list(i)), lambda x: [x])), lambda a, x: case when a[-1] = 0 or x[1] >= a[-1] + 11 then list_concat(a, x) else a end), lambda v: v > 0) as picked from good group by nr
)"""

SINGLE = "with {} select * from {}"

ORACLE = {
    "match_summary": f"""with {MATCH}
select coalesce(kilde, 'SUM') as kilde, count(*) as n, count(*) filter (klasse = 'TREFF') as treff, count(*) filter (klasse = 'SLURV') as slurv, count(*) filter (klasse = 'BOM') as bom, round(count(*) filter (klasse = 'BOM') * 100.0 / count(*), 4) as bom_pct
from cls group by rollup (kilde) having count(*) > 0""",
    "match_pairs_metrics": f"with {MATCH} select pred_id, label_id, {', '.join(f'round({c}, 6) as {c}' for c in ('cov_area', 'cov_pred', 'iou', 'cov_short', 'cov_long', 'center_short'))} from pairs",
    "truth_coverage": f"with {MATCH} select label_id, doc_no, side, type, n_coverers from cover",
    "best_match_details": f"with {MATCH} select label_id, doc_no, side, type, pred_id, round(cov, 6) as cov, hit, case when hit then kilde else '' end as kilde from best",
    "eval_overall": f"""with {MATCH} select count(*) as truth, count(*) filter (hit) as hit, round(count(*) filter (hit) / count(*), 6) as recall, round(sum(overlap) / sum(truth_area), 6) as overlap, (select count(*) from scoped) as pred,
(select count(*) from scoped) - count(distinct case when hit then pred_id end) as surplus from best""",
    "eval_per_type": f"with {MATCH} select type, count(*) as truth, count(*) filter (hit) as hit, round(count(*) filter (hit) / count(*), 6) as recall from best group by type",
    "eval_per_source": f"with {MATCH} select kilde, count(*) as n, count(*) filter (used) as hit, count(*) - count(*) filter (used) as surplus from (select kilde, pred_id in (select pred_id from best where hit) as used from scoped) group by kilde",
    "eval_miss_pages": f"with {MATCH} select doc_no, side, count(*) filter (not hit) as missed, count(*) as total from best group by doc_no, side having count(*) filter (not hit) > 0",
    "run_stats": f"""with {MATCH} select round(avg(round(cov * 100, 1)), 4) as cov_mean, round(quantile_cont(round(cov * 100, 1), 0.5), 4) as cov_median, round(avg(round(cov * 100, 1)) filter (hit), 4) as cov_mean_hit, count(distinct doc_no) as docs, count(distinct (doc_no, side)) as pages,
round(1 - ((select count(*) from scoped) - count(distinct case when hit then pred_id end)) / (select count(*) from scoped), 6) as precision from best""",
    "worst_files": f"with {MATCH} select doc_no, count(*) filter (not hit) as missed, count(*) as total from best group by doc_no having count(*) filter (not hit) > 0 order by missed desc, total desc, doc_no desc limit 15",
    "threshold_curve": f"""with {MATCH} select threshold, (select count(distinct label_id) from pairs where cov_area >= threshold) as covered, (select count(*) from scoped) - (select count(distinct pred_id) from pairs where cov_area >= threshold) as bom
from (values (0.15::double), (0.25), (0.32), (0.4), (0.5), (0.7), (0.9)) v(threshold)""",
    "criterion_diff_truth": f"with {MATCH} select label_id in (select label_id from pairs where cov_area >= 0.32) as covered_a, label_id in (select label_id from pairs where iou >= 0.2) as covered_b, count(*) as n from truth group by all",
    "criterion_diff_class": f"""with {MATCH}, other as (
    select p.pred_id, case when n is null then 'BOM' when p.norm_area > 3.0 * covered then 'SLURV' else 'TREFF' end as klasse_b
    from scoped p left join (select pred_id, count(*) as n, sum(truth_area) as covered from pairs where iou >= 0.2 group by 1) e using (pred_id))
select klasse as klasse_a, klasse_b, count(*) as n from cls join other using (pred_id) group by all""",
    "rule_verdicts": f"with {PRED}, {_PRODUCTION} select c.config_id, p.pred_id from pred p join cfg c on (c.kilde is null or c.kilde = p.kilde) where {removed('c', 'p')}",
    "measure_configs": f"with {MATCH}, {_PRODUCTION}, {hits()}, {measured()} select * from m",
    "sweep_single": f"{_SWEPT} select config_id, lost, ov_rm, n_rm, red_rm, critical_rm, net, recall_after, prec_after from m",
    "operating_point": f"{_POINT} select config_id, lost, ov_rm, n_rm, net, case when n_rm = 0 then 'no effect' when lost = 0 then 'free' when ov_per_lost >= 5 then 'pays' else 'DOES NOT PAY' end as verdict from m",
    "leave_one_out": f"""{_POINT} select substring(r.config_id, 9) as rule, a.ov_rm - r.ov_rm as d_ov_rm, a.lost - r.lost as d_lost, round(case when a.lost > r.lost then (a.ov_rm - r.ov_rm) / (a.lost - r.lost) end, 6) as ratio
from m r cross join (select * from m where config_id = 'all') a where r.config_id like 'without %'""",
    "holdout_measure": f"with {MATCH}, {_HOLDOUT}, {_PRODUCTION}, {hits('hcls')}, {measured('hcls', 'hedge', 'htruth')} select config_id, lost, ov_rm, n_rm, covered_after, recall_after, net from m",
    "derived_limits": f"""with {MATCH} select kilde, count(*) as n, {', '.join(f"round(quantile_cont({m}, {q}), 2) as {s}_{m}" for m in ('elongation', 'short_side', 'long_side') for s, q in (('min', 0.01), ('max', 0.99)))}, round(quantile_cont(areal_px, 0.01), 0) as min_area_px
from cls where klasse <> 'BOM' group by kilde having count(*) >= 100""",
    "shape_percentiles": f"with {MATCH} {_percentile_rows()}",
    "index_percentiles": f"""with {PRED}, s as (select kilde, list_sort(list(areal_px)) as v, count(*) as n from pred group by kilde)
select kilde, n, {', '.join(f"v[cast(least(floor(n * {p} / 100), n - 1) as bigint) + 1] as a{p}, v[cast(floor((n - 1) * {p} / 100) as bigint) + 1] as b{p}" for p in (5, 25, 50, 75, 95))}, v[n // 2 + 1] as upper_median from s""",
    "removal_kinds": f"""with {MATCH}, {config_rows([(n, k, c) for n, (k, c) in RULES.items()])}, gone as (select distinct p.pred_id from cls p join cfg c on c.kilde = p.kilde where {removed('c', 'p')}),
lost as (select label_id from edge group by 1 having bool_and(pred_id in (select pred_id from gone)))
select pred_id, doc_no, side, case when klasse = 'BOM' then 'surplus' when pred_id in (select pred_id from edge where label_id in (select label_id from lost)) then 'critical' else 'redundant' end as kind from cls where pred_id in (select pred_id from gone)""",
    "page_triage": f"""with {MATCH}, pages as (select doc_no, side, count(*) as n, min(case kilde when 'begge' then 0 when 'yolo' then 1 when 'paddle' then 2 else 9 end) as prio from cls where klasse = 'BOM' group by all)
select doc_no, side, n, prio, row_number() over (order by prio, n desc, doc_no, side) as rank from pages""",
    "band_review": f"with {MATCH} select label_id, pred_id, round(cov_area, 6) as value, label_id not in (select label_id from pairs where cov_area >= 0.4) as tips from pairs where cov_area >= 0.25 and cov_area < 0.4",
    "label_policy": f"{_POLICY} select * from decided",
    "label_policy_tally": f"{_POLICY} select origin, outcome, count(*) as n from decided group by all",
    "reclassify": f"""with {_SIDES},
ids as (select nr, unnest(list_filter(list_transform(string_split(coalesce(label_id, ''), ';'), lambda i: trim(i)), lambda i: i <> '')) as id from man where klasse <> 'BOM'),
void as (select nr from ids group by nr having bool_and(id in (select label_id from retracted))),
first as (select *, case when nr in (select nr from void) then 'BOM' else klasse end as k1 from man),
live as (select label_id, doc_no, side, x0 * (300 / 72) as x0, y0 * (300 / 72) as y0, x1 * (300 / 72) as x1, y1 * (300 / 72) as y1 from added where label_id not in (select label_id from retracted)),
found as (select m.nr, string_agg(distinct a.label_id, ';' order by a.label_id) as ids from first m join live a on m.doc_no = a.doc_no and m.side = a.side and {same('m', 'a')} where m.k1 = 'BOM' group by m.nr)
select m.nr, klasse as before, case when f.ids is not null then 'TREFF' else k1 end as after, coalesce(f.ids, label_id) as label_id from first m left join found f on m.nr = f.nr where klasse <> case when f.ids is not null then 'TREFF' else k1 end""",
    "label_stats": f"""with {LABELS}, s as (
    select coalesce(type, 'SUM') as type, count(*) filter (ml and status = 'ACCEPTED') as tp, count(*) filter (ml and status = 'REJECTED') as fp, count(*) filter (ml and status = 'MOVED') as moved, count(*) filter (not ml) as fn,
           count(*) filter (ml and status not in ('ACCEPTED', 'REJECTED', 'MOVED')) as unresolved from lab group by rollup (type))
select *, round(case when tp + fn + moved > 0 then tp / (tp + fn + moved) else 0 end, 6) as recall, round(case when tp + fp + moved > 0 then 1 - fp / (tp + fp + moved) else 0 end, 6) as precision from s""",
    "boxes_per_doc_distribution": f"with {LABELS} select n_boxes, count(*) as n_docs from (select doc_no, count(*) as n_boxes from lab group by 1) group by 1",
    "page_share": f"""with {LABELS}, per as (select doc_no, count(*) as k from lab group by 1)
select count(*) as n, (select count(*) from per) as docs, round(count(*) filter (side = 1) / count(*), 6) as page1_share, round(count(*) filter (side between 1 and 3) / count(*), 6) as page123_share, max(side) as highest_page,
(select list_sort(list(k))[count(*) // 2 + 1] from per) as upper_median, (select max(k) from per) as most, (select doc_no from per order by k desc, doc_no limit 1) as most_doc from lab""",
    "status_crosstab": f"with {LABELS} select case when ml then 'ml' else 'manual' end as who, case when status = '' then '(empty)' else status end as status, count(*) as n from lab group by all",
    "position_density": f"with {LABELS} select cast(floor((x0 + x1) / 2 * 30 / 595.0) as int) as bx, cast(floor((y0 + y1) / 2 * 30 / 842.0) as int) as by, count(*) as n from lab group by all",
    "label_sizes": f"with {LABELS} select type, count(*) as n, round(sum(x1 - x0), 2) as w_sum, round(avg(x1 - x0), 4) as w_mean, round(stddev_samp(x1 - x0), 4) as w_std, round(min(x1 - x0), 4) as w_min, round(max(x1 - x0), 4) as w_max from lab group by type",
    "largest_labels": f"with {LABELS} select label_id, doc_no, side, round((x1 - x0) * (y1 - y0), 4) as area from lab order by area desc, label_id limit 15",
    "latest_version": f"with {LABELS} select label_id, doc_no, versjon from lab qualify versjon = max(versjon) over (partition by doc_no)",
    "page_placement": f"""with {PRED}, {LABELS}, size as (select doc_no, side, arg_min(bilde_bredde, pred_id) / (300 / 72) as pw, arg_min(bilde_hoyde, pred_id) / (300 / 72) as ph from pred group by all)
select case when pw is null then 'no page' when x0 >= -1 and y0 >= -1 and x1 <= pw + 1 and y1 <= ph + 1 then 'inside' when x1 <= 0 or y1 <= 0 or x0 >= pw or y0 >= ph then 'outside' else 'partial' end as place, case when ml then 'ml' else 'manual' end as who, status, count(*) as n
from lab l left join size s on l.doc_no = s.doc_no and l.side = s.side group by all""",
    "covering_label": f"""with {LABELS}, {MANIFEST}, mm as (select nr, doc_no, side, least(x0, x1) / (300 / 72) as x0, least(y0, y1) / (300 / 72) as y0, greatest(x0, x1) / (300 / 72) as x1, greatest(y0, y1) / (300 / 72) as y1 from man where side is not null)
select nr, min(label_id) as label_id from mm m join lab l on m.doc_no = l.doc_no and m.side = l.side
where (case when least(l.x1, m.x1) > greatest(l.x0, m.x0) and least(l.y1, m.y1) > greatest(l.y0, m.y0) then (least(l.x1, m.x1) - greatest(l.x0, m.x0)) * (least(l.y1, m.y1) - greatest(l.y0, m.y0)) else 0 end) / ((l.x1 - l.x0) * (l.y1 - l.y0)) >= 0.1 group by nr having count(*) = 1""",
    "band_join": f"with {PRED}, {MANIFEST} select nr, pred_id from man m join pred p on m.doc_no = p.doc_no and m.side = p.side where abs(m.x0 - p.x0) <= 3 and abs(m.y0 - p.y0) <= 3 and abs(m.x1 - p.x1) <= 3 and abs(m.y1 - p.y1) <= 3",
    "label_files": f"""with {PRED}, {LABELS}, size as (select doc_no, side, arg_min(bilde_bredde, pred_id) / (300 / 72) as pw, arg_min(bilde_hoyde, pred_id) / (300 / 72) as ph from pred group by all),
c as (select l.doc_no, l.side, l.y0, l.x0, {', '.join(f"least(1.0, greatest(0.0, l.{v} / {p})) as {n}" for v, p, n in (('x0', 'pw', 'a'), ('y0', 'ph', 'b'), ('x1', 'pw', 'c'), ('y1', 'ph', 'd')))} from lab l join size s on l.doc_no = s.doc_no and l.side = s.side),
t as (select doc_no, side, y0, x0, printf('0 %.6f %.6f %.6f %.6f', (a + c) / 2, (b + d) / 2, c - a, d - b) as line from c) select doc_no, side, string_agg(line, chr(10) order by y0, x0, line) as content from t group by all""",
    "turned_boxes": f"""with {LABELS}, t as (select *, side % 4 as q from lab) select label_id,
round(case q when 0 then x0 when 1 then 842.0 - y1 when 2 then 595.0 - x1 else y0 end, 4) as x0, round(case q when 0 then y0 when 1 then x0 when 2 then 842.0 - y1 else 595.0 - x1 end, 4) as y0,
round(case q when 0 then x1 when 1 then 842.0 - y0 when 2 then 595.0 - x0 else y1 end, 4) as x1, round(case q when 0 then y1 when 1 then x1 when 2 then 842.0 - y0 else 595.0 - x0 end, 4) as y1, true as same from t""",
    "crop_plan": f"""with {MANIFEST}, c as (select nr, x0, y0, x1, y1, greatest(0.0, trunc(x0 - 300)) as a, greatest(0.0, trunc(y0 - 60)) as b, 2480.0::double as d, least(3508.0::double, trunc(y1 + 60)) as e from man where x0 is not null),
f as (select *, case when d - a > 768 then 768.0::double / (d - a) else 1.0::double end as f, case when d - a > 768 then 768.0::double else d - a end as w, case when d - a > 768 then greatest(1.0, trunc((e - b) * (768.0::double / (d - a)))) else e - b end as h from c),
g as (select *, greatest(3, round_even(w / 400, 0)) + 2 as pad from f),
m as (select *, greatest(0.0, (x0 - a) * f - pad) as p, greatest(0.0, (y0 - b) * f - pad) as q, least(w - 1, (x1 - a) * f + pad) as r, least(h - 1, (y1 - b) * f + pad) as s from g),
o as (select *, case when x1 <= 0 or y1 <= 0 or x0 >= 2480 or y0 >= 3508 then 'outside' when d <= a or e <= b then 'empty' when r <= p or s <= q then 'marker' end as reason from m)
select nr, reason, {', '.join(f"case when reason is null then round({e}, 3) end as {n}" for n, e in (('cx0', 'a'), ('cy0', 'b'), ('cx1', 'd'), ('cy1', 'e'), ('mx0', 'p'), ('my0', 'q'), ('mx1', 'r'), ('my1', 's')))}, case when reason is null then round(f, 6) end as factor from o""",
    "code_density": f"""with {MATCH}, {META},
pp as (select doc_no, count(*) filter (klasse = 'TREFF') as hit, count(*) filter (klasse = 'BOM') as bom, count(*) filter (klasse = 'BOM' and kilde = 'begge') as bom_begge, count(*) filter (klasse = 'BOM' and kilde = 'yolo') as bom_yolo, count(*) filter (klasse = 'BOM' and kilde = 'paddle') as bom_paddle from cls group by 1),
tt as (select doc_no, count(*) as truth, count(*) filter (n_coverers = 0) as lost from cover group by 1),
dd as (select coalesce(pp.doc_no, tt.doc_no) as doc_no, 1 as ran, * exclude (doc_no) from pp full join tt on pp.doc_no = tt.doc_no),
coded as (select unnest(codes) as code, doc_no from meta),
rows_ as (select code, ran, truth, hit, lost, bom, bom_begge, bom_yolo, bom_paddle from coded left join dd on coded.doc_no = dd.doc_no union all select '(none)', ran, truth, hit, lost, bom, bom_begge, bom_yolo, bom_paddle from dd where doc_no not in (select doc_no from meta))
select code, count(*) as docs, {', '.join(f'cast(coalesce(sum({c}), 0) as bigint) as {c}' for c in ('ran', 'truth', 'hit', 'lost', 'bom', 'bom_begge', 'bom_yolo', 'bom_paddle'))} from rows_ group by code""",
    "electronic_density": f"with {MATCH}, {META}, per as (select doc_no, count(*) as truth, count(*) filter (n_coverers = 0) as lost from cover group by 1) select electronic, count(*) as docs, cast(sum(truth) as bigint) as truth, cast(sum(lost) as bigint) as lost from meta join per using (doc_no) group by 1",
    "documents_per_year": f"""with {LABELS}, {META}, per as (select doc_no, count(*) as boxes, count(distinct side) as pages from lab group by 1)
select year, count(*) as docs, count(boxes) as labelled, cast(coalesce(sum(boxes), 0) as bigint) as boxes, cast(coalesce(sum(pages), 0) as bigint) as pages from meta left join per using (doc_no) group by year""",
    "unreviewed_documents": f"with {PRED}, {LABELS}, {META} select distinct doc_no from pred where doc_no not in (select doc_no from lab) and doc_no not in (select doc_no from meta where processed)",
    "profile_free_documents": f"with {PRED}, {META} select distinct doc_no from pred where doc_no not in (select doc_no from meta where list_has_any(codes, ['SR_JOU', 'AH_JOU', 'KA_MOB', 'KA_GRE', 'TR_MAS', 'SR_SKN', 'JS_JSA', 'FR_REG', 'SR_UTS', 'SE_SEK']))",
    "code_descriptions": f"""with p as (select {doc('fil_revisjon_id')} as doc_no, unnest(string_split(rettsstiftelsestyper, ',')) as part from metadata),
q as (select doc_no, upper(trim(string_split(part, ' - ')[1])) as code, trim(substring(part, instr(part, ' - ') + 3)) as description from p where instr(part, ' - ') > 0 and doc_no is not null)
select code, arg_min(description, (doc_no, description)) as description from q where code <> '' group by code""",
    "split_overlap": f"with s as (select {doc('fil')} as doc_no, lower(trim(splitt)) as splitt from splittliste) select distinct doc_no from s where doc_no is not null and splitt = 'train' and doc_no in (select doc_no from s where splitt in ('val', 'test'))",
    "split_sizes": f"select lower(trim(splitt)) as splitt, count(*) as n, count(distinct {doc('fil')}) as docs from splittliste where {doc('fil')} is not null group by 1",
    "verdict_join": f"with {JUDGED} select nr, klasse, gruppe, kilde, svar, feil from judged",
    "verdict_confusion": f"with {JUDGED} select coalesce(klasse, 'SUM') as klasse, count(*) filter (svar = 'ja') as ja, count(*) filter (svar = 'nei') as nei, count(*) as n from judged group by rollup (klasse) having count(*) > 0",
    "verdict_split": f"""with {JUDGED}, s as (select coalesce(nullif(trim(kilde), ''), '(empty)') as value, count(*) filter (gruppe = 'BOM' and svar = 'nei') as bom_nei, count(*) filter (gruppe = 'BOM') as bom, count(*) filter (gruppe = 'DEKKENDE' and svar = 'nei') as dek_nei, count(*) filter (gruppe = 'DEKKENDE') as dek from judged group by 1)
select *, round(case when bom > 0 then bom_nei / bom else 0 end, 6) as bom_share, round(case when dek > 0 then dek_nei / dek else 0 end, 6) as dek_share from s""",
    "verdict_tally": f"""with {JUDGED}, j as (select count(*) filter (gruppe = 'BOM') as n_bom, count(*) filter (gruppe = 'BOM' and svar = 'nei') as n_bom_nei, count(*) filter (gruppe = 'DEKKENDE') as n_dek, count(*) filter (gruppe = 'DEKKENDE' and svar = 'nei') as n_dek_nei from judged),
f as (select j.*, (select count(*) from man where gruppe = 'BOM') / n_bom as bf, (select count(*) from man where gruppe = 'DEKKENDE') / n_dek as df from j)
select n_bom, n_bom_nei, n_dek, n_dek_nei, round(bf, 6) as bom_factor, round(df, 6) as dek_factor, round(n_bom_nei * bf, 4) as gain, round(n_dek_nei * df, 4) as loss from f""",
    "verdict_skew": f"""with {JUDGED}, a as (select count(*) as n, round(count(*) filter (gruppe = 'BOM') / count(*), 6) as judged_bom from judged), b as (select count(*) as n_all, round(count(*) filter (gruppe = 'BOM') / count(*), 6) as manifest_bom from man)
select *, n > 0 and n < 0.9 * n_all and manifest_bom > 0 and abs(judged_bom - manifest_bom) > 0.15 as skewed from a, b""",
    "hard_documents": f"with {JUDGED} select doc_no, count(*) as wrong from judged where doc_no is not null and ((gruppe = 'BOM' and svar = 'ja') or (gruppe = 'DEKKENDE' and svar = 'nei')) group by 1 order by wrong desc, doc_no limit 20",
    "verdict_retry": "select distinct nr from manifest where nr is not null and nr not in (select nr from verdicts where nr is not null and nullif(trim(svar), '') is not null and coalesce(feil, '') = '')",
    "verdict_subset": f"with {JUDGED} select nr from judged where conf >= 0.5 and svar = 'nei' and kilde <> 'paddle'",
    "asymmetric_sample": f"""with {MATCH}, c as (select pred_id, klasse, (select count(*) from cls where klasse <> 'BOM') as n from cls where klasse <> 'BOM' order by md5(concat_ws('|', pred_id, '42')) limit 200)
select pred_id, klasse, 1.0::double as factor from cls where klasse = 'BOM' union all select pred_id, klasse, round(n / least(n, 200), 6) from c""",
    "hash_slice": "select distinct navn from resultat where (('0x' || md5(navn))::uhugeint % 100) < 20",
    "stratified_holdout": f"""with {META} select doc_no, coalesce(cast(decade as varchar), 'ukjent') as stratum,
row_number() over (partition by decade order by md5(concat_ws('|', doc_no, '42'))) <= round_even(count(*) over (partition by decade) * 0.2, 0) as holdout from meta""",
    "quota_split": f"""with {LABELS}, d as (select doc_no, count(distinct side) as weight from lab group by 1),
f as (select *, coalesce(sum(weight) over (order by md5(concat_ws('|', doc_no, '42')) rows between unbounded preceding and 1 preceding), 0) as filled, sum(weight) over () as total from d)
select doc_no, weight, case when filled < total * 0.8::double then 'train' when filled < total * (0.8::double + 0.1::double) then 'val' else 'test' end as split from f""",
    "capped_groups": f"""with {LABELS}, {META}, d as (select doc_no, count(distinct side) as weight from lab group by 1)
select doc_no, coalesce(cast(decade as varchar), 'ukjent') as grp, weight from d join meta using (doc_no) qualify coalesce(sum(weight) over (partition by decade order by md5(concat_ws('|', doc_no, '42')) rows between unbounded preceding and 1 preceding), 0) < 25""",
    "random_documents": f"with {PRED} select doc_no from (select distinct doc_no from pred where kilde = 'yolo') order by md5(concat_ws('|', doc_no, '42')), doc_no limit 25",
    "fnr_scan": f"""with {_TEXT}, {_SCAN} select c.nr, cast(g.st - 1 as int) as start, cast(g.en as int) as stop, sha256(g.d) as digest from (select nr, unnest(picked) as i from chosen) c join good g on g.nr = c.nr and g.i = c.i""",
    "orgnr_scan": f"""with {_TEXT}, r as (select nr, unnest(list_transform(regexp_extract_all(ocr_tekst, '[0-9](?:[ .,_-]{{0,2}}[0-9])*'), lambda x: regexp_replace(x, '[^0-9]', '', 'g'))) as d from t)
select nr, cast(count(*) as int) as n from r where length(d) = 9 and d[1] in ('8', '9') and case when length(d) = 9 then (11 - {_check('d', (3, 2, 7, 6, 5, 4, 3, 2))} % 11) % 11 = cast(substring(d, 9, 1) as int) else false end group by nr""",
    "digit_runs": f"""with {_TEXT}, r as (select nr, ocr_tekst, list_transform(regexp_extract_all(ocr_tekst, '[0-9](?:[ .,_-]{{0,2}}[0-9])*'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) as k, list_transform(regexp_extract_all(ocr_tekst, '[0-9]+'), lambda x: length(x)) as p from t)
select nr, cast(len(k) as int) as n, cast(coalesce(list_max(k), 0) as int) as longest, cast(coalesce(list_max(p), 0) as int) as plain from r""",
    "decimal_flags": rf"""with {_TEXT} select nr, regexp_matches(ocr_tekst, '[0-9][.,][0-9]') as dec,
regexp_matches(ocr_tekst, '\b(AS|ASA|ANS|KS|NUF|IKS|BBL|BRL)\b|(?i:borettslag|boligbyggelag|sameie|stiftelse|forening|kommune|sparebank|bank|forsikring|org\.?\s*nr|organisasjonsn|foretak)') as org from t""",
    "fnr_guard": rf"""with {MANIFEST}, c as (select nr, unnest([coalesce(ocr_tekst, ''), coalesce(ocr_linje, '')]) as x from man)
select nr, bool_or(regexp_matches(x, '(?i)(f\s*[øo]dsels\s*n|pers\s*[.\s]*n|p\s*\.\s*nr|f\s*\.\s*nr|fnr|personnummer)') and regexp_matches(x, '(^|[^0-9])[0-9]{{5}}([^0-9]|$)')) as protected from c group by nr""",
    "content_keys": "select doc_id, substring(sha256(text), 1, 24) as key from documents where text is not null",
    "throughput_window": """with per as (select user_id % 4 as worker, epoch_us(ts) // 1000000 as sec, count(*) as k from events group by all), p as (select worker, sec, sum(k) over (partition by worker order by sec) as docs from per),
b as (select worker, sec, docs, coalesce(max(sec) over old, min(sec) over sofar) as t0, coalesce(max(docs) over old, min(docs) over sofar) as d0 from p
      window old as (partition by worker order by sec range between unbounded preceding and 3600 preceding), sofar as (partition by worker order by sec))
select worker, sec, cast(docs as bigint) as docs, round(case when sec > t0 then (docs - d0) / (sec - t0) end, 6) as per_second from b""",
    "events_tumbling": "select epoch_us(time_bucket(interval '1 hour', ts)) as window_start, event_type, count(*) as n, round(sum(value), 4) as value from events group by all",
    "events_session": """with g as (select *, case when ts > lag(ts) over (partition by user_id order by ts) + interval '30 minutes' then 1 else 0 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts) as k from g)
select epoch_us(min(ts)) as session_start, epoch_us(max(ts) + interval '30 minutes') as session_end, user_id, count(*) as n from s group by user_id, k""",
    "events_first_seen": "select distinct event_id, event_type from events",
    "resume_documents": f"with {PRED}, {LABELS} select distinct doc_no from pred where doc_no not in (select doc_no from lab)",
    "confidence_sweep": f"""with {MATCH},
top as (select e.label_id, max(coalesce(p.conf, 1.0)) as v from edge e join cls p using (pred_id) group by 1), bom as (select coalesce(conf, 1.0) as v from cls where klasse = 'BOM'),
cuts as (select distinct round(v, 4) as conf from (select v from top union all select v from bom) where round(v, 4) >= 0 union select 0.5),
n as (select conf, row_number() over (order by conf) - 1 as r, count(*) over () as k from cuts),
kept as (select conf from n where k <= 400 or conf = 0.5 or r in (select cast(floor(i * (k / 400.0::double)) as bigint) from generate_series(0, 399) g(i))),
s as (select conf, (select count(*) from truth) - (select count(*) from top where v >= conf) as miss, (select count(*) from bom where v >= conf) as over from kept)
select conf, miss, over, cast(5.0 * miss + over as double) as total from s""",
}

ORACLE["rank_models"] = ORACLE["confidence_sweep"].rsplit("select conf, miss, over", 1)[0].rstrip() + """,
p as (select conf, miss, over, cast(5.0 * miss + over as double) as total from s)
select * from (select *, 'best' as cut from p order by total, miss, conf limit 1) union all select *, 'standard' from p where conf = 0.5"""

_UNGATED = {k: v for k, v in GATED.items() if k != "conf_threshold"}
_PROFILED = [(n, k, c) for n, (k, c) in RULES.items()] + [("any " + k, k, c) for k, c in ANY.items()] + [(f"gated {k}", k, _UNGATED if k == "paddle" else GATED) for k in ("begge", "paddle", "yolo", "yolo_vertikal", "unknown")]
_REC = (None, 0.80, 0.90, 0.95, 0.98)
# The one-parameter sweeps (name, varied parameter, values, parameters beside it).
_AXES = (
    ("min_elongation", "min_elongation", (1.1, 1.5, 1.7, 2.0, 2.5, 3.0, 3.5, 4.0), {}), ("max_height", "max_height", (25, 30, 35, 40, 45, 50, 60, 80, 100), {}), ("max_width", "max_width", (60, 80, 100, 120, 150, 200, 250), {}),
    ("conf_threshold", "conf_threshold", (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), {"min_elongation": 1.5, "max_height": 50, "max_width": 120}), ("min_area_px", "min_area_px", (500, 700, 965, 1200, 1600, 2200, 3000), {}),
    ("min_short_side", "min_short_side", (3, 4, 5, 6, 7, 8, 10), {}), ("min_long_side", "min_long_side", (10, 15, 20, 25, 30, 40, 50), {}), ("max_elongation", "max_elongation", (6, 8, 10, 12, 15, 20, 30, 50), {}),
    ("min_digits", "min_digits", (2, 3, 4, 5, 6, 8, 11), {}), ("max_letters", "max_letters", (0, 1, 2, 3), {}), ("min_digits_run", "min_digits_run", (6, 7, 8, 9, 10, 11), {}),
    ("min_digits + rec_veto", "rec_veto", _REC, {"min_digits": 2}), ("require_fnr_candidate + rec_veto", "rec_veto", _REC, {"require_fnr_candidate": 1}), ("reject_decimal + rec_veto", "rec_veto", _REC, {"reject_decimal": 1}),
    ("reject_decimal + ocr_conf_exempt", "ocr_conf_exempt", (None, 0.40, 0.45, 0.50, 0.60, 0.70), {"reject_decimal": 1, "rec_veto": 0.98}), ("reject_00_run + rec_veto", "rec_veto", _REC, {"reject_00_run": 1}),
    ("reject_orgnr + rec_veto", "rec_veto", _REC, {"reject_orgnr": 1}), ("reject_org_ord 1 + rec_veto", "rec_veto", _REC, {"reject_org_ord": 1}), ("reject_org_ord 2 + rec_veto", "rec_veto", _REC, {"reject_org_ord": 2}),
    ("require_fnr_candidate + line_veto", "line_veto", (None, 0.95, 0.98, 0.99, 0.995, 0.999, 0.9999), {"require_fnr_candidate": 1, "rec_veto": 0.98}), ("reject_run_6_10", "reject_run_6_10", (None, 8, 9, 10), {"rec_veto": 0.98, "line_veto": 0.99}),
    ("reject_run_6_10 9 + line_veto", "line_veto", (None, 0.98, 0.99, 0.995, 0.999, 0.9999), {"reject_run_6_10": 9, "rec_veto": 0.98}), ("without_text_conf", "without_text_conf", (None, 0.45, 0.50, 0.60, 0.70, 0.80), {}),
    ("max_gap", "max_gap", (1.5, 2, 3, 4, 6, 8, 12), {}), ("reject_decimal_gap", "reject_decimal_gap", (1,), {}), ("reject_decimal_gap + max_gap", "max_gap", (None, 1.5, 2, 3, 4, 6), {"reject_decimal_gap": 1}),
)
_AXIS_ROWS = config_rows([(f"{n}={'off' if v is None else f'{v:g}'}", None, beside | ({} if v is None else {varied: v})) for n, varied, values, beside in _AXES for v in values])
_COORDINATES = "['SR_JOU', 'AH_JOU', 'KA_MOB', 'KA_GRE', 'TR_MAS', 'SR_SKN', 'JS_JSA', 'FR_REG', 'SR_UTS']"

ORACLE |= {
    "profile_rules": f"""with {PRED}, {META}, {config_rows(_PROFILED)},
pp as (select p.*, coalesce(list_has_any(codes, {_COORDINATES}), false) as co, coalesce(list_contains(codes, 'SE_SEK'), false) as se from pred p left join meta m on p.doc_no = m.doc_no),
gone as (select distinct p.pred_id from pp p join cfg c on (c.kilde is null or c.kilde = p.kilde) and (c.config_id <> 'coordinates' or p.co) and (c.config_id not like 'sectioning%' or p.se) where {removed('c', 'p')})
select kilde, count(*) as n, count(*) filter (pred_id in (select pred_id from gone)) as gone from pp group by kilde""",
    "one_parameter_sweeps": f"with {MATCH}, {_AXIS_ROWS}, {hits()}, {measured()} select config_id, lost, ov_rm, n_rm, net from m",
    "lost_truth": f"""with {MATCH}, {config_rows([(k, k, c) for k, c in ANY.items()])}, gone as (select distinct p.pred_id from cls p join cfg c on c.kilde = p.kilde where {removed('c', 'p')}),
lost as (select label_id from edge group by 1 having bool_and(pred_id in (select pred_id from gone))) select label_id, pred_id from edge where label_id in (select label_id from lost)""",
    "coverage_review": f"with {MATCH} select label_id, doc_no, side, case when cov <= 0 then 'uncovered' when cov < 0.32 then 'poorly covered' else 'ok' end as state from best",
    "error_documents": f"with {LABELS}, s as (select doc_no, string_agg(distinct case when status = '' then '(empty)' else status end, ',' order by case when status = '' then '(empty)' else status end) as states from lab group by 1) select * from s where states <> 'ACCEPTED'",
    "manual_slice": f"with {LABELS}, {META} select coalesce(cast(decade as varchar), 'ukjent') as decade, count(*) as n, count(*) filter (status in ('MANUAL', 'MOVED') or not ml) as manual from lab left join meta using (doc_no) group by 1",
    "thin_pages": f"with {PRED}, {LABELS}, n as (select doc_no, side, count(*) as n from lab group by all) select p.doc_no, p.side, coalesce(n, 0) as n from (select distinct doc_no, side from pred) p left join n on p.doc_no = n.doc_no and p.side = n.side where coalesce(n, 0) < 3",
    "page_orientation": f"with {PRED}, s as (select arg_min(bilde_bredde, pred_id) > arg_min(bilde_hoyde, pred_id) as lying from pred group by doc_no, side) select lying, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from s group by lying",
    "numbered_boxes": f"with {PRED} select pred_id, row_number() over (order by navn, side, y0, x0, kilde, pred_id) as nr from pred",
    "chosen_documents": f"with {META} select doc_no from meta where year between 1960 and 1990 and len(list_filter(codes, lambda c: regexp_matches(c, '^(HJ|PA)_'))) > 0",
    "rounded_join": f"with {PRED}, {MANIFEST} select nr, pred_id from man m join pred p on m.doc_no = p.doc_no and m.side = p.side and {' and '.join(f'round(m.{c} * 10, 0) = round(p.{c} * 10, 0)' for c in ('x0', 'y0', 'x1', 'y1'))} where m.klasse = 'BOM'",
    "time_shares": """with s as (select coalesce(nullif(lower(trim(kilde)), ''), 'unknown') as kilde, round(sum(sekunder), 2) as seconds from (select distinct on (verdict_id) * from verdicts) where sekunder is not null and not isnan(sekunder) group by 1)
select kilde, seconds, round(seconds / sum(seconds) over (), 4) as share from s""",
    "event_last_step": "with t as (select distinct user_id, epoch_us(ts) / 1e6 as t from events), l as (select user_id, t, lag(t) over (partition by user_id order by t) as prev from t) select user_id, round(coalesce(arg_max(t, t) - arg_max_null(prev, t), max(t)), 3) as seconds from l group by 1",
    "listed_pages": f"select {doc('fil')} as doc, try_cast(regexp_extract(fil, '_(?:side|p)([0-9]+)\\.[A-Za-z]+$', 1) as int) as page, count(*) as n from splittliste group by all",
}
