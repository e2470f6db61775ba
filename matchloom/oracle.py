"""DuckDB SQL of the linkage queries, put together from common table expressions."""

from __future__ import annotations

from matchloom.operators.features import FEATURES

K, MAX_DF, FALLBACK_DF, THRESHOLD = 5, 3, 30, 0.35


# The tables are stated here once more, not imported, so that a wrong entry in the engine shows.
# Legal-form variants and their canonical tokens.
LEGAL_FORMS = {
    "private": "pvt", "pvt": "pvt", "pte": "pvt", "limited": "ltd", "ltd": "ltd", "corporation": "corp", "corp": "corp",
    "incorporated": "inc", "inc": "inc", "company": "co", "co": "co", "cie": "co", "llc": "llc", "llp": "llp", "plc": "plc", "lp": "lp",
    "sarl": "sarl", "sas": "sas", "sasu": "sasu", "eurl": "eurl", "sa": "sa", "gmbh": "gmbh", "ag": "ag", "bv": "bv",
}
LEGAL_TOKENS = sorted(set(LEGAL_FORMS.values()))
# Name stop words.
NAME_STOPWORDS = ["the", "and", "of", "dba", "et", "le", "la", "les", "de", "du", "des"]
# Address words and their abbreviations.
ADDRESS_ABBREVIATIONS = {
    "road": "rd", "street": "st", "avenue": "ave", "av": "ave", "boulevard": "blvd", "bd": "blvd", "drive": "dr", "lane": "ln",
    "court": "ct", "place": "pl", "square": "sq", "highway": "hwy", "parkway": "pkwy", "suite": "ste", "floor": "fl", "building": "bldg",
    "apartment": "apt", "number": "no", "north": "n", "south": "s", "east": "e", "west": "w", "sector": "sec", "opposite": "opp",
    "nagar": "ngr", "saint": "st",
}


def _fold(x: str) -> str:
    return f"trim(regexp_replace(replace(replace(replace(lower(strip_accents(coalesce({x}, ''))), '&', ' and '), '''', ''), '’', ''), '[^a-z0-9]+', ' ', 'g'))"


def _words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def _mapped(x: str, table: dict[str, str]) -> str:
    cases = " ".join(f"when '{a}' then '{b}'" for a, b in table.items())
    return f"list_transform({_words(x)}, lambda w: case w {cases} else w end)"


def _joined(x: str) -> str:
    return f"coalesce(array_to_string({x}, ' '), '')"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_ER = """
er as (
  select concat('S', cast(1 + doc_id % 3 as varchar), '-', lpad(cast(doc_id as varchar), 6, '0')) entity_id,
         trim(concat(array_to_string(t[1:6], ' '), ' ', case doc_id % 5 when 0 then 'Private Limited' when 1 then 'Pvt. Ltd.' when 2 then 'Corporation' when 3 then 'Corp' else '' end)) business_name,
         concat(cast(10 + doc_id % 90 as varchar), ' ', array_to_string(t[7:9], ' '),
                case doc_id % 4 when 0 then ' Road' when 1 then ' Rd.' when 2 then ' Street' else ' Avenue' end,
                case when doc_id % 7 = 0 then '' else concat(', ', cast(10000 + (n_chars * 37) % 90000 as varchar)) end) business_address,
         lang country, doc_id % 3 = 0 is_ref
  from (select *, string_split_regex(trim(text), '\\s+') t from documents)
)"""


def _records(source: str) -> str:
    core = _joined(f"list_filter({_words('name_norm')}, lambda t: not list_contains({_list([*LEGAL_TOKENS, *NAME_STOPWORDS])}, t))")
    codes = lambda p: f"list_sort(list_distinct(regexp_extract_all(business_address, '{p}')))"
    w, a = _words("name_core"), _words("addr_norm")
    pairs = lambda x: f"list_transform(range(1, len({x})), lambda k: {x}[k] || ' ' || {x}[k + 1])"
    return f"""
norm as (
  select entity_id, is_ref, country, {_fold('country')} country_norm, {_joined(_mapped(_fold('business_name'), LEGAL_FORMS))} name_norm,
         {_joined(_mapped(_fold('business_address'), ADDRESS_ABBREVIATIONS))} addr_norm, {codes('\\b\\d{5,6}\\b')} postcodes, {codes('\\d+')} numbers
  from {source}
), rec as (select *, case when {core} <> '' then {core} else name_norm end name_core from norm),
wordy as (select *, {w} cw, {a} aw from rec),
keyed as (
  select *, list_distinct(cw) core, list_distinct({pairs('cw')}) core_bi,
         case when len(cw) > 1 then [array_to_string(list_transform(cw, lambda t: t[1]), '')] else [] end acronym,
         list_distinct(aw) addr, list_distinct({pairs('aw')}) addr_bi,
         list_distinct(flatten(list_transform(postcodes, lambda p: list_transform(cw, lambda t: '#' || p || ' ' || t[1:4])))) geo,
         postcodes postcode, numbers number, list_distinct(list_filter({_words('name_norm')}, lambda t: list_contains({_list(LEGAL_TOKENS)}, t))) legal, cw[1] first
  from wordy
)"""


def _weights(name: str, keys: str) -> str:
    return f"""
{name}_rows as (select entity_id id, is_ref, unnest(list_distinct({keys})) token from keyed),
{name}_df as (select token, count(*) df, count(*) filter (not is_ref) df_pool from {name}_rows group by token),
{name}_raw as (select id, is_ref, token, df, df_pool, ln((1.0 + (select count(*) from keyed)) / (1.0 + df)) + 1 v from {name}_rows join {name}_df using (token)),
{name} as (select id, is_ref, token, df, df_pool, v, v / sqrt(sum(v * v) over (partition by id)) w from {name}_raw)"""


_NAME_W = _weights("name_w", "list_concat(core, core_bi)")
_ADDR_W = _weights("addr_w", "list_concat(list_concat(addr, addr_bi), geo)")
_ADDR_C = _weights("addr_c", "list_concat(addr, addr_bi)")
_BASE = _ER + "," + _records("er")


def _channel(w: str, k: int = K, max_df: int = MAX_DF, fallback: int = FALLBACK_DF) -> str:
    return f"""
{w}_left as (
  select id, token, w, df_pool, df_pool between 1 and {max_df} kept, min(df_pool) filter (df_pool >= 1) over (partition by id) rarest,
         max(case when df_pool between 1 and {max_df} then 1 else 0 end) over (partition by id) has_key
  from {w} where is_ref
), {w}_used as (select * from {w}_left where kept or (has_key = 0 and df_pool >= 1 and df_pool = rarest and df_pool <= {fallback})),{_ranked(w, k)}"""


def _all_keys(w: str, k: int = K) -> str:
    return f"""
{w}_used as (select * from {w} where is_ref),{_ranked(w, k)}"""


def _ranked(w: str, k: int) -> str:
    return f"""
{w}_sim as (select l.id i, r.id j, sum(l.w * r.w) sim from {w}_used l join {w} r using (token) where not r.is_ref group by 1, 2),
{w}_top as (select * from (select i, j, cast(row_number() over (partition by i order by round(sim, 9) desc, j) as integer) rank, sim from {w}_sim) where rank <= {k})"""


def _with(*parts: str) -> str:
    return "with " + ",".join(parts)


_CAND = ",".join([_BASE, _NAME_W, _ADDR_W, _channel("name_w"), _channel("addr_w")]) + ", cand as (select i, j from name_w_top union select i, j from addr_w_top)"
_COS = _CAND + "," + _ADDR_C + """,
name_dot as (select i, j, sum(a.w * b.w) s from cand join name_w a on a.id = i join name_w b on b.id = j and a.token = b.token group by 1, 2),
addr_dot as (select i, j, sum(a.w * b.w) s from cand join addr_c a on a.id = i join addr_c b on b.id = j and a.token = b.token group by 1, 2),
cos as (select i, j, coalesce(round(n.s, 6), 0.0) name_tfidf, coalesce(round(d.s, 6), 0.0) addr_tfidf from cand left join name_dot n using (i, j) left join addr_dot d using (i, j))"""
_GOLD = ", gold as (select a.entity_id i, b.entity_id j from rec a join rec b using (name_core) where a.is_ref and not b.is_ref and name_core <> '')"
_SCORED = _COS + _GOLD + """,
scored as (select i, j, round((name_tfidf + addr_tfidf) / 2, 7) prob from cos),
owner as (select i, j, prob from (select *, row_number() over (partition by j order by prob desc, i) nth from scored) where nth = 1)"""
_COUNTS = """,
ent as (
  select entity_id, any_value(country) country, count(distinct p.j) pred_n, count(distinct case when g.j is not null then p.j end) tp
  from (select entity_id, country from rec where is_ref) e left join (select i, j from scored where prob >= """ + str(THRESHOLD) + """) p on p.i = entity_id left join gold g on g.i = p.i and g.j = p.j group by 1
), gn as (select i, count(distinct j) gold_n from gold group by 1),
cnt as (select entity_id, country, pred_n, tp, coalesce(gold_n, 0) gold_n from ent left join gn on i = entity_id),
pr as (select *, case when pred_n > 0 then tp / pred_n when gold_n = 0 then 1.0 else 0.0 end "precision", case when gold_n > 0 then tp / gold_n else 1.0 end recall from cnt),
es as (select *, case when pred_n = 0 and gold_n = 0 then 1.0 when tp = 0 then 0.0 else 1.25 * "precision" * recall / (0.25 * "precision" + recall) end f05 from pr)"""

FOLD_TEXT = f"select doc_id, {_fold('text')} folded from documents"
NORMALIZE = _with(_BASE) + " select entity_id, country, country_norm, name_norm, name_core, addr_norm from rec"
ADDRESS_CODES = _with(_BASE) + f" select entity_id, {_joined('postcodes')} postcodes, {_joined('numbers')} numbers from rec"
KEY_SETS = _with(_BASE) + " " + " union all ".join(f"select entity_id, '{k}' kind, unnest({k}) token from keyed" for k in ("core", "core_bi", "acronym", "addr", "addr_bi", "geo", "postcode", "number", "legal"))
DOCUMENT_FREQUENCY = _with(_BASE, _NAME_W) + " select token, df, df_pool, round(any_value(v), 6) idf from name_w group by 1, 2, 3"
WEIGHTS = _with(_BASE, _NAME_W) + " select id, token, round(w, 6) w from name_w"


def top_k(w: str) -> str:
    return _with(_BASE, _NAME_W if w == "name_w" else _ADDR_W, _channel(w)) + f" select i, j, rank, round(sim, 6) sim from {w}_top"


_PARTS = """
er as (
  select concat(case when p_partkey % 40 = 0 then 'S1-' else 'S2-' end, lpad(cast(p_partkey as varchar), 6, '0')) entity_id, p_name business_name, '' business_address, '' country, p_partkey % 40 = 0 is_ref from part
)"""
PART_FALLBACK = _with(_PARTS, _records("er"), _NAME_W, _channel("name_w", 3, 20, 400)) + " select i, j, rank, round(sim, 6) sim from name_w_top"
CANDIDATES = "with " + _CAND + " select i, j from cand"
CANDIDATE_LISTS = "with " + _CAND + " select entity_id source1_entity_id, coalesce(string_agg(j, ',' order by j), '') candidate_entity_ids from rec left join cand on i = entity_id where is_ref group by 1"
COSINES = "with " + _COS + " select i, j, name_tfidf, addr_tfidf from cos"
CONTEXT = "with " + _COS + """
select i, j, cast(rank() over (partition by i order by name_tfidf desc) as integer) name_rank, cast(rank() over (partition by i order by addr_tfidf desc) as integer) addr_rank,
  round(max(name_tfidf) over (partition by i) - name_tfidf, 6) name_gap, round(max(addr_tfidf) over (partition by i) - addr_tfidf, 6) addr_gap,
  count(*) over (partition by i) n_candidates, cast(rank() over (partition by j order by round(name_tfidf + addr_tfidf, 6) desc) as integer) reverse_rank
from cos"""


def _jaccard(k: str) -> str:
    inter = f"len(list_intersect(a.{k}, b.{k}))"
    return f"case when len(a.{k}) + len(b.{k}) - {inter} > 0 then round({inter} / (len(a.{k}) + len(b.{k}) - {inter}), 6) end"


def _tri(k: str) -> str:
    return f"case when len(a.{k}) > 0 and len(b.{k}) > 0 then cast(list_has_any(a.{k}, b.{k}) as double) end"


SET_FEATURES = "with " + _CAND + f"""
select i, j, {_jaccard('core')} core_token_jaccard, coalesce(cast(a.first = b.first as double), 0.0) first_token_match,
  cast(list_has_any(a.acronym, b.core) or list_has_any(b.acronym, a.core) as double) acronym_match, {_tri('legal')} legal_form_match,
  round(abs(length(a.name_core) - length(b.name_core)) / greatest(length(a.name_core), length(b.name_core), 1), 6) name_len_diff,
  {_jaccard('addr')} addr_token_jaccard, {_tri('postcode')} postcode_match, {_jaccard('number')} number_jaccard,
  cast(a.country_norm = b.country_norm as double) same_country, cast(starts_with(j, 'S3-') as double) is_source3
from cand join keyed a on a.entity_id = i join keyed b on b.entity_id = j"""
JARO_WINKLER = "with " + _CAND + """
select i, j, case when a.name_core = b.name_core then 1.0 when a.name_core = '' or b.name_core = '' then 0.0 else round(jaro_winkler_similarity(a.name_core, b.name_core), 6) end core_jaro_winkler
from cand join rec a on a.entity_id = i join rec b on b.entity_id = j"""


def _masks(x: str, y: str) -> str:
    """For each character of list y: the places in list x that hold it, as bits."""
    return f"list_transform({y}, lambda c: coalesce(list_sum(list_transform(range(1, len({x}) + 1), lambda k: case when {x}[k] = c then 1::hugeint << (k - 1)::hugeint else 0::hugeint end)), 0::hugeint))"


def _common(n: str, masks: str) -> str:
    """Longest common subsequence of a string of n characters and one given by masks: its zero bits after the row recurrence."""
    full = f"((1::hugeint << ({n})::hugeint) - 1)"
    return f"({n} - bit_count(list_reduce(list_prepend({full}, {masks}), lambda r, h: ((r + (r & h)) | (r - (r & h))) & {full})))"


def _chars(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, ''), lambda t: t <> '')"


#: Scores of distinct string pairs (a, b) of table ``sp``; strings of up to 120 characters fit a row of bits.
_STRING_SCORES = f"""
sw as (
  select a, b, {_chars('a')} ca, {_chars('b')} cb, list_sort(list_distinct({_words('a')})) wa, list_sort(list_distinct({_words('b')})) wb from sp
), sx as (
  select *, {_joined("list_filter(wa, lambda t: list_contains(wb, t))")} both_, {_joined("list_filter(wa, lambda t: not list_contains(wb, t))")} x, {_joined("list_filter(wb, lambda t: not list_contains(wa, t))")} y from sw
), sm as (
  select *, {_chars('x')} cx, {_chars('y')} cy, {_masks('ca', 'cb')} ab, {_masks('cb', 'ca')} ba from sx
), sc as (
  select *, {_masks('cx', 'cy')} xy, length(both_) s, case when both_ <> '' then 1 else 0 end gap from sm
), sp_scores as (
  select a, b, case when a = '' and b = '' then 1.0 else 2.0 * {_common('len(ca)', 'ab')} / (len(ca) + len(cb)) end ratio,
    case when len(wa) = 0 or len(wb) = 0 then 0.0 when both_ <> '' and (x = '' or y = '') then 1.0 else greatest(
      1 - (len(cx) + len(cy) - 2 * {_common('len(cx)', 'xy')}) / (2.0 * (s + gap) + len(cx) + len(cy)),
      case when both_ <> '' then greatest(1 - (gap + len(cx)) / (2.0 * s + gap + len(cx)), 1 - (gap + len(cy)) / (2.0 * s + gap + len(cy))) else 0 end) end token_set,
    case when a = '' or b = '' then case when a = b then 1.0 else 0.0 end else greatest(
      case when len(ca) <= len(cb) then list_max(list_transform(range(1, len(ca) + len(cb)), lambda e: 2.0 * {_common('len(ca)', 'ab[greatest(e - len(ca), 0) + 1:least(e, len(cb))]')} / (len(ca) + least(e, len(cb)) - greatest(e - len(ca), 0)))) else 0 end,
      case when len(cb) <= len(ca) then list_max(list_transform(range(1, len(ca) + len(cb)), lambda e: 2.0 * {_common('len(cb)', 'ba[greatest(e - len(cb), 0) + 1:least(e, len(ca))]')} / (len(cb) + least(e, len(ca)) - greatest(e - len(cb), 0)))) else 0 end) end partial
  from sc
)"""
_STRING_CTES = """cp as (select i, j, a.name_norm an, b.name_norm bn, a.name_core ac, b.name_core bc, a.addr_norm aa, b.addr_norm ba from cand join rec a on a.entity_id = i join rec b on b.entity_id = j),
sp as (select an a, bn b from cp union select ac, bc from cp union select aa, ba from cp),""" + _STRING_SCORES + """,
strings as (
  select i, j, round(n.ratio, 6) name_ratio, round(n.token_set, 6) name_token_set, round(n.partial, 6) name_partial, round(c.ratio, 6) core_ratio, round(c.token_set, 6) core_token_set,
    case when ac = bc then 1.0 when ac = '' or bc = '' then 0.0 else round(jaro_winkler_similarity(ac, bc), 6) end core_jaro_winkler, round(d.token_set, 6) addr_token_set, round(d.partial, 6) addr_partial
  from cp join sp_scores n on n.a = an and n.b = bn join sp_scores c on c.a = ac and c.b = bc join sp_scores d on d.a = aa and d.b = ba
)"""
STRING_RATIOS = "with " + _CAND + ", " + _STRING_CTES + " select * from strings"
_CONTEXT_SELECT, _SET_SELECT = CONTEXT.removeprefix("with " + _COS), SET_FEATURES.removeprefix("with " + _CAND)
PAIR_FEATURES = "with " + _COS + f", ctx as ({_CONTEXT_SELECT}), setf as ({_SET_SELECT}), " + _STRING_CTES + f"""
select i, j, {', '.join(f'cast({f} as double) {f}' for f in FEATURES)} from cos join ctx using (i, j) join setf using (i, j) join strings using (i, j)"""
EXCLUSIVITY = "with " + _BASE + _GOLD + """, owned as (select 'all' gold, j, count(*) n from gold group by j union all select 'one_owner', j, 1 from gold group by j)
select gold, coalesce(max(n), 1) <= 1 exclusive, count(*) filter (n > 1) shared from owned group by 1"""
BEST_OWNER = "with " + _SCORED + " select i, j, prob from owner"
SELECT = "with " + _SCORED + f" select i, j, prob, false exclusive from scored where prob >= {THRESHOLD} union all select i, j, prob, true from owner where prob >= {THRESHOLD}"
MATCH_LISTS = "with " + _SCORED + f" select entity_id source1_entity_id, coalesce(string_agg(j, ',' order by j), '') matched_entity_ids from rec left join (select * from owner where prob >= {THRESHOLD}) on i = entity_id where is_ref group by 1"
ENTITY_SCORES = "with " + _SCORED + _COUNTS + ' select entity_id, pred_n, tp, gold_n, round(f05, 6) f05, round("precision", 6) "precision", round(recall, 6) recall from es'


def macro(by: str = "") -> str:
    return "with " + _SCORED + _COUNTS + f' select {by + ", " if by else ""}round(avg(f05), 6) f05, round(avg("precision"), 6) "precision", round(avg(recall), 6) recall, count(*) entities from es' + (f" group by {by}" if by else "")


_SWEPT = "with " + _SCORED + """,
th as (select k / 100 threshold from range(5, 96) r(k)), gn as (select i, count(distinct j) gold_n from gold group by 1),
ents as (select entity_id, coalesce(gold_n, 0) gold_n from rec left join gn on i = entity_id where is_ref),
pt as (select threshold, s.i, count(*) pred_n, count(g.j) tp from th join scored s on s.prob >= threshold left join (select distinct i, j from gold) g on g.i = s.i and g.j = s.j group by 1, 2),
swept as (
  select t.threshold, round(avg(case when coalesce(pred_n, 0) = 0 and gold_n = 0 then 1.0 when coalesce(tp, 0) = 0 then 0.0 else 1.25 * (tp / pred_n) * (tp / gold_n) / (0.25 * (tp / pred_n) + tp / gold_n) end), 6) f05
  from th t cross join ents e left join pt on pt.threshold = t.threshold and pt.i = e.entity_id group by 1
)"""
SWEEP = _SWEPT + " select threshold, f05 from swept"
SWEEP_EXCLUSIVE = SWEEP.replace("join scored s on", "join owner s on")
#: The sweep without the bounds on the frequency of keys.
_SWEPT_ALL_KEYS = _SWEPT.replace(_channel("name_w"), _all_keys("name_w")).replace(_channel("addr_w"), _all_keys("addr_w"))
BEST_THRESHOLD = _SWEPT_ALL_KEYS + " select threshold, f05 from swept order by f05 desc, threshold desc limit 1"
BLOCKING_SCORES = "with " + _CAND + _GOLD + """, t as (
  select (select count(*) from cand) n, (select count(*) from gold) gold, (select count(*) from cand join gold using (i, j)) found, (select count(*) from rec where is_ref) e, (select count(*) from rec where not is_ref) p
) select n candidate_pairs, round(case when gold > 0 then found / gold else 1.0 end, 6) pair_completeness, round(1 - n / greatest(e * p, 1), 6) reduction_ratio, round(n / greatest(e, 1), 6) mean_candidates_per_entity from t"""
VALUE_COUNTS = "select lang country, count(*) entities from documents where doc_id % 3 = 0 group by 1"
SPLIT = "with " + _ER + """, ids as (select entity_id from er where is_ref),
chosen as (select entity_id from ids order by md5('43:' || entity_id), entity_id limit 200),
held as (select entity_id from chosen order by md5('42:' || entity_id), entity_id limit (select cast(round_even(count(*) * 0.2, 0) as bigint) from chosen))
select entity_id, case when entity_id in (select entity_id from held) then 'val' else 'train' end part from chosen"""
SOURCES = "with " + _ER + """, n as (select *, cast(substr(entity_id, 2, 1) as integer) source from er)
select entity_id, replace(business_name, chr(9), ' ') business_name, replace(business_address, chr(9), ' ') business_address, country, source, row_number() over (partition by source order by entity_id) - 1 place from n"""
SINGLETONS = "with " + _SCORED + f" select count(*) filter (n = 0) singletons, cast(sum(n) as bigint) matched_pairs from (select entity_id, count(j) n from rec left join (select * from owner where prob >= {THRESHOLD}) on i = entity_id where is_ref group by 1)"
LABELS = "with " + _CAND + _GOLD + " select i, j, case when g.j is null then 0 else 1 end label from cand left join gold g using (i, j)"
ISSUES = """
with ids as (select doc_id, concat('S', cast(1 + doc_id % 3 as varchar), '-', lpad(cast(doc_id as varchar), 6, '0')) id, doc_id % 3 = 0 is_ref from documents),
lists as (select doc_id, id s1_id, concat('S2-', lpad(cast(doc_id + 1 as varchar), 6, '0'), ',', 'S3-', lpad(cast(doc_id + 2 as varchar), 6, '0')) cell from ids where is_ref),
m0 as (select doc_id, case when doc_id % 45 = 0 then 'S1-x' else s1_id end s1_id, case when doc_id % 42 = 0 then 'S2-999999' when doc_id % 78 = 0 then concat(cell, ',', cell) else cell end cell from lists where doc_id % 30 <> 0),
m as (select 'matching_results.tsv' file, s1_id, cell from m0 union all select 'matching_results.tsv', s1_id, cell from m0 where doc_id % 66 = 0),
c as (select 'candidate_pairs.tsv' file, s1_id, case when doc_id % 54 = 0 then '' else cell end cell from lists),
b as (select * from m union all select * from c), l as (select *, list_filter(string_split(cell, ','), lambda x: x <> '') ids from b), x as (select file, s1_id, unnest(ids) id from l)
select 'duplicate source1_entity_id' "rule", file, s1_id, '' example from b group by file, s1_id having count(*) > 1
union all select 'missing source1_entity_id', f.file, i.id, '' from (select distinct file from b) f cross join ids i where i.is_ref and not exists (select 1 from b where b.file = f.file and b.s1_id = i.id)
union all select distinct 'unknown source1_entity_id', file, s1_id, '' from b where s1_id not in (select id from ids where is_ref)
union all select distinct 'duplicate ids in list', file, s1_id, '' from l where len(ids) <> len(list_distinct(ids))
union all select 'ids not in pool', file, s1_id, min(id) from x where id not in (select id from ids where not is_ref) group by file, s1_id
union all select 'matched ids missing from candidates', 'candidate_pairs.tsv', s1_id, min(id) from (select s1_id, id from x where file like 'm%' except select s1_id, id from x where file like 'c%') group by s1_id"""
