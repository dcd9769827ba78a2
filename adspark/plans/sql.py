"""Pieces of DuckDB SQL shared by the checks of the registered queries."""

from __future__ import annotations

from adspark.functions import text as T

_CONJ = T.CONJUNCTIONS


def norm(x: str) -> str:
    """normalize_text without lookaheads: elisions before conjunctions are rewritten or shielded first."""
    x = f"nfc_normalize(coalesce({x}, ''))"
    x = rf"regexp_replace({x}, '(\p{{L}})[⸗¬-]\s*\n\s*((?:{_CONJ})(?:[^\p{{L}}\p{{N}}_]|$))', '\1- \2', 'g')"
    x = rf"regexp_replace({x}, '(\p{{L}})[⸗¬-]\s*\n\s*([{T.LOWER}])', '\1\2', 'g')"
    x = rf"regexp_replace({x}, '(\p{{L}})[⸗¬-]\s*\n\s*', '\1-', 'g')"
    x = rf"regexp_replace({x}, '(\p{{L}})([⸗¬-]) +((?:{_CONJ})(?:[^\p{{L}}\p{{N}}_]|$))', '\1\2' || chr(1) || ' \3', 'g')"
    x = rf"regexp_replace({x}, '(\p{{L}})[⸗¬-] +([{T.LOWER}])', '\1\2', 'g')"
    to = T.TO.replace("'", "''")
    x = f"replace(translate(replace({x}, chr(1), ''), '{T.FROM}', '{to}'), 'ẞ', 'SS')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


fold_query = T.fold_query


def fold(x: str, normalized: bool = False) -> str:
    x = x if normalized else norm(x)
    x = f"translate(replace(lower({x}), 'ß', 'ss'), '{T.ACCENTS[0]}', '{T.ACCENTS[1]}')"
    x = f"replace(replace({x}, 'ck', 'k'), 'th', 't')"
    return f"replace(regexp_replace({x}, 'c([eiy])', 'z\\1', 'g'), 'c', 'k')"


def key(x: str, enumerations: bool = True) -> str:
    x = rf"regexp_replace(lower({norm(x)}), '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g')"
    if enumerations:
        x = rf"regexp_replace({x}, '^(?:[0-9]+[.)]?|[a-z]\))\s+', '')"
    return rf"regexp_replace({x}, '\s+', ' ', 'g')"


def snippet(text: str, start: str, end: str, width: int) -> str:
    left = f"substr({text}, greatest({start} - {width}, 0) + 1, {start} - greatest({start} - {width}, 0))"
    return f"'…' || {norm(left)} || ' [' || {norm(f'substr({text}, {start} + 1, {end} - {start})')} || '] ' || {norm(f'substr({text}, {end} + 1, {width})')} || '…'"


def tokens(x: str, normalized: bool = False) -> str:
    stop = ", ".join(f"'{s}'" for s in sorted({T.fold_query(s) for s in T.SEARCH_STOP}))
    w = f"regexp_extract_all({fold(x, normalized)}, '[a-z0-9]+')"
    kept = f"list_filter({w}, lambda w: length(w) >= 2 and w not in ({stop}))"
    return f"list_transform({kept}, lambda w: case when length(w) > 5 then regexp_replace(w, '(?:{T.ENDINGS})$', '') else w end)"


def joined(x: str) -> str:
    """A list as text, its elements sorted."""
    return f"array_to_string(list_sort(list(distinct {x}) filter (where {x} is not null)), ';')"


ADS = "a as (select * from ads qualify row_number() over (partition by ad_id order by loaded_at) = 1)"
TEXTS = "t as (select * from ad_text qualify row_number() over (partition by ad_id order by ad_id) = 1)"
DUPS = "d as (select * from ad_dups qualify row_number() over (partition by ad_id order by ad_id) = 1)"
SAL = "s as (select * from ad_salary qualify row_number() over (partition by ad_id, span_start order by ad_id) = 1)"

POSITIONS = f"""
pd as (select "key", any_value(entries) as entries, any_value(confidence) as confidence, bool_or(is_position) as is_position from position_dict
  where (form_id, "key") in (select (min(form_id), "key") from position_dict where "key" is not null group by "key") group by "key"),
mentions as (
  select ad_id, newspaper, year, 'span' as source, p.start as span_start, p.end as span_end, p.text as surface from (select ad_id, newspaper, year, unnest(positions) as p from a)
  union all select ad_id, newspaper, year, 'heading', null, null, heading_text from a where heading_text is not null),
ap as (select ad_id, newspaper, year, source, span_start, span_end, surface, "key", e.term, e.lemma, e.modern, e.gender_form, e.category
  from (select m.*, pd."key", unnest(pd.entries) as e from mentions m join pd on pd."key" = {key('m.surface')} where pd.is_position))
"""

REQUIREMENTS = f"""
rd as (select "key", any_value(tags) as tags, bool_or(is_informative) as is_informative from requirement_dict
  where (req_id, "key") in (select (min(req_id), "key") from requirement_dict where "key" is not null group by "key") group by "key"),
phrases as (select ad_id, newspaper, year, text, c as "column", s.start as span_start, s.end as span_end, s.text as phrase from (
  {' union all '.join(f"select ad_id, newspaper, year, text, '{c}' as c, unnest({c}) as s from a" for c in ('activity', 'attitude_towards_work', 'background', 'interpersonal', 'job_specific', 'language'))})),
ar as (select ad_id, newspaper, year, "column", span_start, span_end, phrase, t.dimension, t."group", t.value, t.detail, t.in_vocab from (
  select p.*, unnest(rd.tags) as t from phrases p join rd on rd."key" = p."column" || ':' || {key('p.phrase', False)} where rd.is_informative and p.ad_id not in (select ad_id from ad_text where flag_death_register and ad_id is not null)) where coalesce(t.verified, true))
"""

PAY = """
units as (select ad_id, coalesce(currency, '') as c, coalesce(standard, '') as st, coalesce(period, '') as pe, count(*) as n, min(amount_min) as lo, max(coalesce(amount_max, amount_min)) as hi
  from s where amount_min is not null and component in ('gehalt', 'lohn', 'remuneration', 'taggeld') group by all),
pay as (select ad_id, lo as pay_min, hi as pay_max, nullif(c, '') as pay_currency, nullif(st, '') as pay_standard, nullif(pe, '') as pay_period, n as pay_amounts
  from units qualify row_number() over (partition by ad_id order by n desc, c, st, pe) = 1)
"""


def benefit_columns() -> str:
    from adspark.operators.pay import BENEFIT_PATTERNS

    out = []
    for b, rx in BENEFIT_PATTERNS.items():
        # RE2 has no lookahead: the words it excludes are taken out of the text first.
        x = "replace(p, 'quartiergeld', '')" if b == "wohnung" else "replace(p, 'kosten', '')" if b == "kost" else "p"
        rx = rx.replace("(?!geld)", "").replace("(?!en)", "")
        out.append(f"bool_or(regexp_matches({x}, '{rx}')) as benefit_{b}")
    return ", ".join(out)


BENEFITS = f"""
ben as (select ad_id, {benefit_columns()} from (
  select ad_id, lower({norm('x.text')}) as p from (select ad_id, unnest(list_concat(verpflegung, unspecific_salary)) as x from a where ad_id not in (select ad_id from ad_text where flag_death_register and ad_id is not null))
  union all select ad_id, lower(component) from ad_salary where component is not null and ad_id is not null) group by ad_id)
"""

CLEAN = f"""
with {ADS}, {TEXTS}, {DUPS}, {SAL}, {POSITIONS}, {REQUIREMENTS}, {PAY}, {BENEFITS},
pos as (select ad_id, list_sort(list(distinct term) filter (where term is not null)) as position_terms, list_sort(list(distinct lemma) filter (where lemma is not null)) as position_lemmas,
  list_sort(list(distinct modern) filter (where modern is not null)) as position_modern, list_sort(list(distinct category) filter (where category is not null)) as position_categories,
  case when bool_and(gender_form = 'f') then 'f' when bool_and(gender_form = 'm') then 'm' when bool_or(gender_form = 'f') and bool_or(gender_form = 'm') then 'mixed' when bool_and(gender_form in ('m/f', 'n')) then 'neutral' end as position_gender
  from ap group by ad_id),
req as (select ad_id, list_sort(list(distinct dimension || ':' || value) filter (where value is not null and dimension is not null)) as requirement_tags, list_sort(list(distinct dimension) filter (where dimension is not null)) as requirement_dimensions, count(distinct (dimension, "group", value, detail, in_vocab)) as n_requirements from ar group by ad_id),
clean as (
  select a.ad_id, a.newspaper, a.year, a.date, a.decade, a.page, a.label, a.text, t.text_norm, t.lang, t.n_flags, t.flag_pc_repetition, t.flag_pc_expanded, t.flag_pc_unsupported, t.flag_too_short, t.flag_death_register,
    d.dup_cluster_id, d.dup_cluster_size, d.is_canonical, d.run_first_date, d.run_last_date,
    not t.flag_death_register and a.label <> 'heading' as searchable,
    not t.flag_death_register and a.label <> 'heading' and d.is_canonical and not t.flag_pc_unsupported as countable,
    case when t.flag_pc_unsupported then 'text not supported by the scan' when t.flag_pc_repetition then 'text repeated by the correction' when t.flag_too_short then 'very short text' end as quality_warning,
    position_terms, position_lemmas, position_modern, position_categories, position_gender, requirement_tags, requirement_dimensions, coalesce(n_requirements, 0) as n_requirements,
    pay_min, pay_max, pay_currency, pay_standard, pay_period, coalesce(pay_amounts, 0) as pay_amounts,
    {', '.join(f'coalesce(benefit_{b}, false) as benefit_{b}' for b in ('wohnung', 'kost', 'kleidung', 'heizung', 'licht', 'deputat', 'quartiergeld', 'zulagen'))}
  from a join t using (ad_id) join d using (ad_id) left join pos using (ad_id) left join req using (ad_id) left join pay using (ad_id) left join ben using (ad_id))
"""
