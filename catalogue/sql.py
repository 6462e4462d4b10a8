"""The same derived tables, and shared steps, as SQL for DuckDB. ``query`` adds the ones a statement names."""

from __future__ import annotations

import re

CODE = "lpad(cast((({0})*37)%100000 as varchar),5,'0')"
VALID_CODE = "'([0-9]+x*X*)'"


def code(expr: str) -> str:
    return CODE.format(expr)


def parse(text: str) -> str:
    """Distinct padded codes written in a text, as a list."""
    found = f"regexp_extract_all(replace(replace({text},'-9',''),'4+',''),'[0-9]+x*X*')"
    return f"list_distinct(list_transform({found}, lambda c: case when length(c)<5 then lpad(c,5,'0') else c end))"


def stem(token: str) -> str:
    return f"rtrim({token},'xX')"


def cleaned(source: str, cols: str = "unique_id") -> str:
    """Valid codes meant by the tokens of ``source (cols, token)``, at every level."""
    return f"""select {cols}, digits, value from (
        select {cols}, d, substr({stem('token')},1,case when d=0 then 2 else d end) as k
        from ({source}), (select unnest([0,1,2,3,4,5]) as d) where regexp_full_match({stem('token')},'[0-9]+'))
        join lookup on digits=d and prefix=k group by all"""


def set_text(value: str, where: str = "") -> str:
    """A group's distinct codes as one sorted text, empty when there are none."""
    flt = f" filter (where {where})" if where else ""
    return f"coalesce(string_agg(distinct {value}, ';' order by {value}){flt},'')"


def share(part: str, whole: str) -> str:
    return f"case when ({whole})=0 then 0.0::double else cast({part} as double)/cast({whole} as double) end"


def big(expr: str) -> str:
    return f"cast({expr} as bigint)"


def bigcount(cond: str) -> str:
    return f"cast(count(*) filter (where {cond}) as bigint)"


def _model(name: str, pairs: list[tuple[str, str]]) -> str:
    rows = " union all ".join(
        f"select unique_id, {i} as pos, {c} as code, {s} as likelihood from coded where {c} is not null" for i, (c, s) in enumerate(pairs)
    )
    return f"select '{name}' as method, * from ({rows})"


STEPS = {
    "hierarchy": f"""select chr(65 + cast(substr(code,1,2) as int) % 21) as section, code
        from (select {code('p_partkey')} as code from part)""",
    "valid": """select distinct section as code from hierarchy
        union select distinct substr(code,1,k) from hierarchy, (select unnest([1,2,3,4,5]) as k)""",
    "levels": """select n as digits, substr(code,1,n) as key, substr(code,1,n) as value
        from hierarchy, (select unnest([1,2,3,4,5]) as n) group by 1,2,3
        union all select 0, substr(code,1,2), section from hierarchy group by 1,2,3""",
    "coded": f"""select unique_id,
        case when qty>=49 then '-9' when qty<=2 then '4+' when d1<2e-2 then concat(substr(h1,1,3),'xx')
             when d1<4e-2 then cast(cast(h1 as int) as varchar) else h1 end as sic_ind_occ1,
        h2 as sic_ind_occ2, h3 as sic_ind_occ3, case when d1>=5e-2 then l1 end as initial_code,
        l1 as m1, l2 as m2, l5 as m3, l3, l4, l6, l7, d1*10 as s1, d2*10 as s2, d5*10 as s3,
        d3*10 as t3, d4*10 as t4, d6*10 as t6, d7*10 as t7
        from (select l_orderkey as unique_id, max(l_quantity) filter (where l_linenumber=1) as qty,
        {', '.join(f"{code(f'max(l_partkey) filter (where l_linenumber={n})')} as h{n}, {code(f'min(l_partkey) filter (where l_linenumber={n})')} as l{n}, max(l_discount) filter (where l_linenumber={n}) as d{n}" for n in range(1, 8))}
        from lineitem group by 1)""",
    "clerical_text": """select unique_id, concat_ws(';', sic_ind_occ1, sic_ind_occ2, sic_ind_occ3) as sic_ind_occ from coded""",
    "side": """select unique_id, concat_ws(';', m1, m2, m3, '99x') as sic_ind_occ from coded where sic_ind_occ1='4+'
        union all select -unique_id-1, concat_ws(';', m1, m2, m3, '99x') from coded where sic_ind_occ1='-9'""",
    "overridden_text": """select coalesce(c.unique_id, s.unique_id) as unique_id, coalesce(s.sic_ind_occ, c.sic_ind_occ) as sic_ind_occ
        from clerical_text c full join side s on c.unique_id=s.unique_id""",
    "first_round_text": "select unique_id, concat_ws(';', m1, sic_ind_occ2, l4) as sic_ind_occ from coded",
    "candidates": """select unique_id, pos, code, likelihood from (
        select unique_id, 0 as pos, m1 as code, s1 as likelihood from coded union all select unique_id, 1, m2, s2 from coded
        union all select unique_id, 2, m3, s3 from coded) where code is not null""",
    "method_candidates": " union all ".join([
        _model("m_a", [("m1", "s1"), ("m2", "s2"), ("m3", "s3")]),
        _model("m_b", [("m2", "s2"), ("l4", "t4"), ("l6", "t6")]),
        _model("m_c", [("l3", "t3"), ("m3", "s3"), ("l7", "t7")]),
    ]),
    "lookup": """select digits, substr(key,1,k) as prefix, value from levels, (select unnest([1,2,3,4,5]) as k)
        where k<=length(key) group by all""",
    # Human codes at every level: one row per record, level and code.
    "clerical_codes": cleaned(f"select unique_id, unnest({parse('sic_ind_occ')}) as token from clerical_text"),
    "overridden_codes": cleaned(f"select unique_id, unnest({parse('sic_ind_occ')}) as token from overridden_text"),
    "first_round_codes": cleaned(f"select unique_id, unnest({parse('sic_ind_occ')}) as token from first_round_text"),
    "initial_codes": cleaned(f"select unique_id, unnest({parse('initial_code')}) as token from coded"),
    "final_codes": cleaned(f"select unique_id, unnest({parse("concat_ws(';', m1, m2)")}) as token from coded"),
    # Best score of each valid candidate code, per level.
    "scored_codes": """select unique_id, digits, value, max(likelihood) as score from (
        select unique_id, likelihood, d, substr(code,1,case when d=0 then 2 else d end) as k
        from candidates, (select unnest([0,1,2,3,4,5]) as d)) join lookup on digits=d and prefix=k group by all""",
    "method_scored_codes": """select method, unique_id, digits, value, max(likelihood) as score from (
        select method, unique_id, likelihood, d, substr(code,1,case when d=0 then 2 else d end) as k
        from method_candidates, (select unnest([0,1,2,3,4,5]) as d)) join lookup on digits=d and prefix=k group by all""",
    "search_price": f"""select l_orderkey as unique_id, min(l_extendedprice/100000) as distance, {code('l_partkey')} as code
        from lineitem group by 1,3""",
    "search_quantity": f"""select l_orderkey as unique_id, min(l_quantity/50 + l_tax) as distance, {code('l_partkey')} as code
        from lineitem group by 1,3""",
    "search": "select 'price' as method, * from search_price union all select 'quantity', * from search_quantity",
    "messy": f"""select l_orderkey, l_partkey, l_linenumber, l_quantity, case
        when l_quantity>=49 then '-9' when l_quantity<=2 then '4+' when l_quantity=3 then 'nan' when l_quantity=4 then ''
        when l_quantity=5 then '14+' when l_quantity=6 then concat('[',code,', ',substr(code,1,2),'xXx]')
        when l_linenumber=1 then concat(substr(code,1,3),'xx') when l_linenumber=2 then cast(cast(code as int) as varchar)
        when l_linenumber=3 then concat(cast(cast(code as int) as varchar),'.0') when l_linenumber=4 then concat(code,'7')
        when l_linenumber=5 then concat(code,';',substr(code,1,1),'xxxx') when l_linenumber=6 then concat('-',substr(code,4,2))
        else code end as text from (select *, {code('l_partkey')} as code from lineitem)""",
    "repeated": f"""select user_id as unique_id, {code('(user_id%12)*101')} as "CC_1",
        case when value<20 then {code('(event_id%3+40)*101')} end as "CC_2", {code('(user_id%7+event_id%2+5)*101')} as "SA_1",
        case when value>250 then {code('(event_id%3+40)*101')} end as "SA_2",
        value as "SA_score_1", case when event_type='error' then null else value/7 end as "SA_score_2" from events""",
    "padded": """select unique_id, m1, m2, m3, s1, s2, s3,
        case when sic_ind_occ1 in ('4+','-9') then sic_ind_occ1 when regexp_full_match(sic_ind_occ1,'[0-9]{1,5}') then lpad(sic_ind_occ1,5,'0')
        else sic_ind_occ1 end as c1, sic_ind_occ2 as c2, sic_ind_occ3 as c3,
        case when s1>5e-1 then 'TRUE' when s1>2e-1 then 'False' end as unamb from coded""",
    "aligned": """select *, greatest(s1,s2,s3) as max_score,
        list_has_any(list_filter([m1,m2,m3], lambda x: x is not null), list_filter([c1,c2,c3], lambda x: x is not null)) as is_correct,
        list_has_any(list_transform(list_filter([m1,m2,m3], lambda x: x is not null), lambda x: substr(x,1,2)),
                     list_transform(list_filter([c1,c2,c3], lambda x: x is not null), lambda x: substr(x,1,2))) as is_correct_2_digit
        from padded""",
    "flagged": """select *, coalesce(sic_ind_occ1='-9',false) as not_codeable, coalesce(sic_ind_occ1='4+',false) as four_or_more,
        case when regexp_matches(sic_ind_occ1,'^[0-9]{2}') then substr(sic_ind_occ1,1,2) else '' end as division,
        case when sic_ind_occ1='-9' then 0 when sic_ind_occ1='4+' then 4 else
          (sic_ind_occ1 is not null)::int+(sic_ind_occ2 is not null)::int+(sic_ind_occ3 is not null)::int end as num_answers,
        coalesce(regexp_full_match(sic_ind_occ1,'[0-9]{5}'),false) as match5,
        coalesce(length(sic_ind_occ1)=5 and regexp_full_match(sic_ind_occ1,'[0-9xX]*') and length(regexp_replace(sic_ind_occ1,'[xX]','','g'))=3,false) as match3,
        coalesce(length(sic_ind_occ1)=5 and regexp_full_match(sic_ind_occ1,'[0-9xX]*') and length(regexp_replace(sic_ind_occ1,'[xX]','','g'))=2,false) as match2
        from coded""",
}


EMPTY = "[]::varchar[]"


def human_sets(codes: str = "clerical_codes", ids: str = "select unique_id from coded", levels: str = "0,1,2,3,4,5") -> str:
    """``(unique_id, digits, codes)`` with an empty list where a record has no valid code."""
    return f"""select b.unique_id, b.digits, coalesce(c.codes, {EMPTY}) as codes
        from (select unique_id, digits from ({ids}), (select unnest([{levels}]) as digits)) b
        left join (select unique_id, digits, list(value order by value) as codes from {codes} group by 1,2) c
        on b.unique_id=c.unique_id and b.digits=c.digits"""


def pruned_sets(scored: str, threshold: str, keys: str = "unique_id") -> str:
    reached = f"score>={threshold}"
    return f"""select {keys}, digits, case when count(*) filter (where {reached})=1 then list(value) filter (where {reached})
        else list(value order by value) end as codes from {scored} group by {keys}, digits"""


def model_sets(threshold: str = "0.0::double", levels: str = "0,1,2,3,4,5") -> str:
    """First choice, or pruned candidates where that is empty."""
    return f"""select i.unique_id, i.digits, case when len(i.codes)>0 then i.codes else coalesce(a.codes, {EMPTY}) end as codes
        from ({human_sets('initial_codes', levels=levels)}) i left join ({pruned_sets('scored_codes', threshold)}) a
        on i.unique_id=a.unique_id and i.digits=a.digits"""


def final_sets() -> str:
    return f"""select i.unique_id, i.digits, case when len(i.codes)>0 then i.codes else f.codes end as codes
        from ({human_sets('initial_codes')}) i join ({human_sets('final_codes')}) f on i.unique_id=f.unique_id and i.digits=f.digits"""


def joined(digits: str = "3", threshold: str = "0.0::double", truth: str | None = None, final: bool = False) -> str:
    """Human set ``t`` and model set ``m`` (and final set ``f``) of each record at one level."""
    f_col, f_join = "", ""
    if final:
        f_col, f_join = ", f.codes as f", f" join ({final_sets()}) f on f.unique_id=m.unique_id and f.digits=m.digits"
    return f"""select m.unique_id, m.digits, t.codes as t, m.codes as m{f_col}
        from ({model_sets(threshold)}) m join ({truth or human_sets()}) t on t.unique_id=m.unique_id and t.digits=m.digits{f_join}
        where m.digits in ({digits})"""


def accuracy_columns(prefix: str, m: str = "m", t: str = "t", total: str = "total") -> tuple[list[str], list[str]]:
    """Counts to aggregate and metrics to compute from them, for one model column."""
    both, over = f"len({t})=1 and len({m})=1", f"list_has_any({t},{m})"
    p = prefix
    counts = [
        f"{bigcount(both)} as {p}unambiguous_records",
        f"{bigcount(f'{both} and {over}')} as {p}matches_oo", f"{bigcount(f'len({t})=1 and {over}')} as {p}matches_om",
        f"{bigcount(f'len({m})=1 and {over}')} as {p}matches_mo", f"{bigcount(over)} as {p}matches_mm",
        f"{bigcount(f'len({t})=1')} as {p}single_t", f"{bigcount(f'len({m})=1')} as {p}single_m",
    ]
    metrics = [
        f"{total} as {p}total_records", f"{p}unambiguous_records",
        *[f"{p}matches_{k}" for k in ("oo", "om", "mo", "mm")],
        f"{share(f'{p}matches_oo', total)} as {p}accuracy_oo_total", f"{share(f'{p}matches_mm', total)} as {p}accuracy_mm_total",
        f"{share(f'{p}matches_oo', f'{p}unambiguous_records')} as {p}accuracy_oo_unambiguous",
        f"{share(f'{p}matches_om', f'{p}single_t')} as {p}accuracy_om_unambiguous",
        f"{share(f'{p}matches_mo', f'{p}single_m')} as {p}accuracy_mo_unambiguous",
    ]
    return counts, metrics


def ambiguity_columns(model: str = "len(m)<>1", truth: str = "len(t)<>1", p: str = "ambiguity_") -> tuple[list[str], list[str]]:
    counts = [
        f"{bigcount(f'({model}) and ({truth})')} as {p}TP", f"{bigcount(f'({model}) and not ({truth})')} as {p}FP",
        f"{bigcount(f'not ({model}) and ({truth})')} as {p}FN", f"{bigcount(f'not ({model}) and not ({truth})')} as {p}TN",
    ]
    precision, recall = share(f"{p}TP", f"{p}TP+{p}FP"), share(f"{p}TP", f"{p}TP+{p}FN")
    metrics = [
        f"{precision} as {p}precision", f"{recall} as {p}recall",
        f"case when {precision}+{recall}=0 then 0.0::double else 2*({precision}*{recall})/({precision}+{recall}) end as {p}f1",
        f"{share(f'{p}TP+{p}TN', 'total')} as {p}accuracy", f"{p}TP", f"{p}FP", f"{p}FN", f"{p}TN",
    ]
    return counts, metrics


def codability_columns(initial: str, final: str | None, p: str = "codability_") -> tuple[list[str], list[str]]:
    counts = [f"{bigcount(f'not ({initial})')} as {p}initial_codable_count"]
    if final:
        counts.append(f"{bigcount(f'not ({final})')} as {p}final_codable_count")
        last = [
            f"{share(f'{p}final_codable_count', 'total')} as {p}final_codable_prop",
            f"{share(f'{p}final_codable_count-{p}initial_codable_count', 'total')} as {p}codability_improvement_prop",
            f"{p}final_codable_count",
        ]
    else:
        last = [
            f"null::double as {p}final_codable_prop", f"null::double as {p}codability_improvement_prop",
            f"null::bigint as {p}final_codable_count",
        ]
    return counts, [f"{share(f'{p}initial_codable_count', 'total')} as {p}initial_codable_prop", f"{p}initial_codable_count", *last]


def metrics_over(source: str, by: str = "", final: bool = False) -> str:
    """All metrics of ``source (by, t, m[, f])`` as plain columns."""
    parts = [
        ambiguity_columns(),
        codability_columns("len(m)<>1", "len(f)<>1" if final else None),
        accuracy_columns("initial_"),
    ]
    if final:
        parts.append(accuracy_columns("final_", "f"))
    counts = ", ".join(c for cs, _ in parts for c in cs)
    metrics = ", ".join(c for _, ms in parts for c in ms)
    if not final:
        names = ["total_records", "unambiguous_records", "matches_oo", "matches_om", "matches_mo", "matches_mm"]
        shares = ["oo_total", "mm_total", "oo_unambiguous", "om_unambiguous", "mo_unambiguous"]
        metrics += "".join(f", null::bigint as final_{n}" for n in names) + "".join(f", null::double as final_accuracy_{n}" for n in shares)
    lead = f"{by}, " if by else ""
    group = f" group by {by}" if by else ""
    return f"select {lead}{metrics} from (select {lead}{counts}, cast(count(*) as bigint) as total from ({source}){group})"


def query(select: str) -> str:
    """``select`` preceded by the steps it mentions, directly or through other steps."""
    wanted: list[str] = []

    def need(text: str, inside: tuple[str, ...]) -> None:
        for name in STEPS:
            if name not in wanted and name not in inside and re.search(rf"\b{name}\b", text):
                need(STEPS[name], (*inside, name))
                if name not in wanted:
                    wanted.append(name)

    need(select, ())
    steps = ", ".join(f"{name} as ({STEPS[name]})" for name in wanted)
    return f"with {steps} {select}" if steps else select
