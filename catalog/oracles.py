"""DuckDB SQL for the queries: the same results by other means.

Patterns are RE2 here, so word boundaries are spelled out with Unicode classes.
The texts below repeat the rules' fixed values in that dialect.
"""

from __future__ import annotations

import re

from catalog import inputs as I
from catalog.queries import P, REPLAY

MESSAGE_CHARS = 4000
TITLE_HINTS = (
    "praktikum praktikant praktikantin werkstudent werkstudentin internship intern trainee hiwi shk hilfskraft studentische student "
    "abschlussarbeit masterarbeit bachelorarbeit thesis ki ai nlp llm mlops devops python"
).split() + [
    "working student", "research assistant", "machine learning", "deep learning", "data science", "data scientist",
    "künstliche intelligenz", "computer vision", "data engineer", "data analyst",
]
LB, RB = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
SEP = r"[\s\-_/]+"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def kw_core(kw: str) -> str:
    return SEP.join(re.escape(p).replace(r"\ ", " ") for p in re.split(SEP, kw.strip().lower()) if p)


def kw_re(kws) -> str:
    return "(?i)(?:" + "|".join(
        (LB if k[0].isalnum() else "") + kw_core(k) + (RB if k[-1].isalnum() else "") for k in kws
    ) + ")"


def has(expr: str, *kws: str) -> str:
    return f"regexp_matches({expr}, {lit(kw_re(kws))})" if kws else "false"


def rx(expr: str, pattern: str) -> str:
    pattern = pattern.replace("<", LB).replace(">", RB)
    return f"regexp_matches({expr}, {lit('(?is)' + pattern)})"


def hits(expr: str, kws) -> str:
    cases = ", ".join(f"case when {has(expr, k)} then {lit(k)} end" for k in dict.fromkeys(kws))
    return f"list_filter([{cases}], lambda x: x is not null)"


def unescaped(expr: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        expr = f"replace({expr}, {lit(a)}, {lit(b)})"
    return expr


def squeeze(expr: str) -> str:
    return rf"trim(regexp_replace({expr}, '\s+', ' ', 'g'))"


def strip(expr: str) -> str:
    return rf"regexp_replace(regexp_replace({expr}, '^\s+', ''), '\s+$', '')"


def quote(expr: str, kw: str, w: int) -> str:
    """First keyword match by position: text before it, itself, text after it."""
    core, left, right = kw_core(kw), (LB if kw[0].isalnum() else ""), (RB if kw[-1].isalnum() else "")
    pat = lit(f"(?is)^(.*?{left})({core}){right}")
    head = f"regexp_extract({expr}, {pat}, 1)"
    word = f"regexp_extract({expr}, {pat}, 2)"
    rest = f"substr({expr}, length({head}) + length({word}) + 1, {w})"
    return squeeze(f"case when {has(expr, kw)} then right({head}, {w}) || {word} || {rest} else '' end")


POST = f"post as ({I.POSTINGS})"
BLOB = "(title || ' ' || description)"

GERMAN_OK = (
    r"german\s*(is\s*)?(optional|a\s*plus|nice\s*to\s*have|not\s*required)|"
    r"deutsch\s*(von\s*vorteil|wünschenswert|optional|nicht\s*erforderlich)|"
    r"(no|kein)\s*(german|deutsch)\s*(required|nötig|erforderlich)|english\s*(only|speaking|working\s*language)"
)
GERMAN_STRONG = (
    r"verhandlungssicher|flie[sß]end\s*(in\s*)?(deutsch|german)|deutsch\s*(muttersprach|native)|"
    r"sehr\s*gute\s*Deutschkenntnisse"
)
GERMAN_LEVELS = (
    (r"(german|deutsch)\s*(level|kenntnisse|skills)?\s*:?\s*(B1|B2|C1|C2)", 3),
    (r"(mindestens|at\s*least|min\.?)\s*(B1|B2|C1|C2)", 2),
    (r"Deutschkenntnisse\s*(mindestens\s*)?(B1|B2|C1|C2)", 2),
)


def german(expr: str, level: str) -> str:
    order = ["A1", "A2", "B1", "B2", "C1", "C2"]
    limit = order.index(level) if level in order else 1
    above = ", ".join(lit(x) for x in order[limit + 1:]) or "'-'"
    named = " or ".join(f"upper(regexp_extract({expr}, {lit('(?i)' + p)}, {g})) in ({above})" for p, g in GERMAN_LEVELS)
    return f"(not {rx(expr, GERMAN_OK)} and ({rx(expr, GERMAN_STRONG)} or {named}))"


ROLES = (
    ("internship", r"<intern(ship|s)?>"),
    ("praktikum", r"<praktikum>|<praktikant[\p{L}\p{N}_]*>"),
    ("werkstudent", r"<werkstudent[\p{L}\p{N}_]*>|<working\s*student>"),
    ("research assistant", r"<research\s*assistant>"),
    ("studentische hilfskraft", r"studentische\s*hilfskraft"),
    ("hiwi", r"<hiwi>|<hi-wi>"),
    ("shk", r"<shk>"),
)
NL = "(title || chr(10) || description)"
ROLE = (
    "case " + " ".join(f"when {rx(NL, p)} then {lit(label)}" for label, p in ROLES) + " "
    + " ".join(f"when contains(lower({NL}), {lit(c)}) then {lit(c)}" for c in P.role_types) + " else '' end"
)
LANGUAGE = f"""case
 when {rx(NL, r"working\s*language\s*:?\s*english|english\s*(speaking|required|preferred)|fluent\s*english|business\s*english|language\s*:?\s*english|english\s*is\s*(the\s*)?(main|working)|jobs?\s*in\s*english")} then 'en'
 when {rx(NL, r"deutsch\s*(als\s*)?(arbeitssprache|erforderlich)|verhandlungssicher|flie[sß]end\s*deutsch|deutschkenntnisse\s*(mindestens\s*)?(b2|c1|c2)|german\s*(at\s*least\s*)?(b2|c1|c2)|native\s*(german|deutsch)")} then 'de'
 when {has(NL, "the", "and", "with", "you", "will", "team")} and not {has(NL, "und", "mit", "wir", "sie", "gesucht")} then 'en'
 when {has(NL, "und", "mit", "wir", "gesucht", "kenntnisse")} then 'de' else 'unknown' end"""

DET = f"det as (select *, {ROLE} as role_type, {LANGUAGE} as language from post)"
CANON = "'https://' || company || '.example.com/jobs/' || cast(seq - seq % 40 + seq % 20 as string) || '?id=' || cast(seq - seq % 40 + seq % 20 as string)"
NORM = f"""uniq as (select seq, title, company, location, source, {CANON} as url, {strip('description')} as description, posted_date
  from post qualify row_number() over (partition by {CANON} order by seq) = 1),
 norm as (select *, {ROLE} as role_type, {LANGUAGE} as language from uniq)"""


def parse(expr: str) -> str:
    head = f"substr({expr}, 1, 10)"
    tries = ", ".join(f"try_strptime({head}, {lit(f)})" for f in ("%Y-%m-%d", "%d.%m.%Y", "%Y/%m/%d"))
    return f"(case when {head} = trim({head}) then coalesce({tries}) end)::date"


def age(expr: str, as_of: str) -> str:
    d = parse(expr)
    return f"case when {d} is not null then greatest(0, date_diff('day', {d}, date {lit(as_of)})) end"


def flags(policy=P, as_of: str = I.AS_OF) -> dict[str, str]:
    place = "(location || ' ' || description)"
    return {
        "senior": rx("title", r"<(senior|sr\.?|lead|principal|staff|head\s+of|director|manager|architect|chief|vp|expert|teamleiter|abteilungsleiter)>"),
        "role": f"(role_type = '' and not {has(BLOB, *policy.role_types)})",
        "domain": f"(not {has(BLOB, *policy.domains)})",
        "location": f"""(case when {rx(place, r"<(us\s*only|usa\s*only|united\s*states\s*only|uk\s*only|india\s*only|canada\s*only|must\s*be\s*(located|based)\s*in\s*the\s*(us|usa|uk|india))>")} then true
           when {has(place, *policy.locations)} then false
           when {rx(place, r"<(remote|homeoffice|home\s*office|hybrid|telearbeit)>")} and {has(place, "germany", "deutschland", "europe", "eu")} then false
           else not (source like 'arbeitsagentur%' or source like 'custom:%') end)""",
        "freshness": f"coalesce({age('posted_date', as_of)} > {policy.freshness_days}, false)",
        "exclude": has(BLOB, *policy.exclude_words),
        "german": german(BLOB, policy.german_max_level),
        "must_have": f"(not {has(BLOB, *policy.must_have_any)})" if policy.must_have_any else "false",
        "thin": f"(source like 'custom:%' and length(description) < {policy.min_description_chars})",
    }


def reason(policy=P, as_of: str = I.AS_OF) -> str:
    return "case " + " ".join(f"when {c} then {lit(g)}" for g, c in flags(policy, as_of).items()) + " end"


def dropoff(policy) -> str:
    gates = list(flags(policy))
    return (
        f"with {POST}, {DET}, r as (select {reason(policy)} as reason from det) select count(*) as input, "
        + ", ".join(f"count(*) filter (reason = {lit(g)}) as {g}" for g in gates)
        + ", count(*) filter (reason is null) as passed from r"
    )


def scored(source: str, as_of: str = I.AS_OF, sim: str | None = None, tag: str = "") -> str:
    """CTEs ending in ``scored``: components, points and score of the rows of a CTE."""
    w = P.weights
    semantic = "0.0::double" if sim is None else f"greatest(0.0, least(1.0, ({sim} - {w.sim_floor}) / ({w.sim_ceil} - {w.sim_floor})))"
    ws = 0.0 if sim is None else w.semantic
    total = ws + w.role + w.domain + w.recency + w.language
    a = age("posted_date", as_of)
    return f"""hit{tag} as (select *, {hits('title', P.role_types)} as rt, {hits('description', P.role_types)} as rb,
   {hits('title', P.domains)} as dt, {hits('description', P.domains)} as db,
   (language = 'en' or {has(BLOB, 'english')}) as english, {german(BLOB, P.german_max_level)} as german,
   {has(BLOB, *P.exclude_words)} as excluded, {a} as age from {source}),
 mix{tag} as (select *, dt || list_filter(db, lambda x: not list_contains(dt, x)) as dh,
   case when len(rt) > 0 then rt when len(rb) > 0 then rb when role_type <> '' then [role_type] else [] end as rh from hit{tag}),
 comp{tag} as (select *, {semantic} as semantic,
   case when len(rt) > 0 then 1.0 when len(rb) > 0 then 0.5 when role_type <> '' then 0.4 else 0.0 end::double as role,
   (case when len(dh) = 0 then 0.0 else least(1.0, (case when len(dt) > 0 then 0.7 else 0.25 end)::double + least(0.3::double, 0.1::double * len(dh))) end)::double as domain,
   (case when age is null then 0.5 else greatest(0.0::double, 1.0::double - age / {float(P.freshness_days)}::double) end)::double as recency,
   (case when english then 1.0 when language = 'de' then 0.2 else 0.5 end)::double as language_fit from mix{tag}),
 scored{tag} as (select *, round(greatest(0.0, least(100.0,
   100.0::double * (semantic * {ws}::double + role * {w.role}::double + domain * {w.domain}::double + recency * {w.recency}::double + language_fit * {w.language}::double) / {total}::double
   - case when german then {w.german_penalty} else 0 end::double - case when excluded then {w.exclude_penalty} else 0 end::double)), 1) as fit_score from comp{tag})"""


DOT = "(title || '. ' || description)"


def reason_text() -> str:
    def part(label, q, bare):
        return f"case when {q} <> '' then '{label}: «' || {q} || '»' else {bare} end"

    role_kws = list(dict.fromkeys([*P.role_types, *[r for r, _ in ROLES]]))
    role_q = "(case " + " ".join(f"when rh[1] = {lit(k)} then {quote(DOT, k, 20)}" for k in role_kws) + " else '' end)"
    dom_q = "(case " + " ".join(f"when dh[1] = {lit(k)} then {quote(DOT, k, 25)}" for k in P.domains) + " else '' end)"
    line = f"replace({DOT}, chr(10), ' ')"
    en_q = strip(f"regexp_extract({line}, {lit(EN)}, 0)")
    de_q = strip(f"regexp_extract({line}, {lit(DE)}, 0)")
    w = P.weights
    pts = [("role", f"role * {w.role}"), ("domain", f"domain * {w.domain}"), ("recency", f"recency * {w.recency}"), ("language", f"language_fit * {w.language}")]
    shown = ", ".join(f"case when {e} <> 0 then '{n}=' || cast(round_even({e}, 0)::bigint as string) end" for n, e in pts)
    return f"""left(concat_ws(' · ',
      case when len(rh) > 0 then {part('Role', role_q, "'Role: ' || rh[1]")} end,
      case when len(dh) > 0 then {part('Domain', dom_q, "'Domain: ' || array_to_string(dh[1:3], ', ')")} end,
      case when english then {part('English', en_q, "'English working language detected'")} end,
      case when german then {part('German bar (penalty)', de_q, "'German above A2 required'")} end,
      '[' || concat_ws(' ', {shown}) || ']'), 400)"""


EN = r"(?is).{0,40}(english|working\s*language).{0,40}"
DE = r"(?is).{0,30}(verhandlungssicher|flie[sß]end|deutschkenntnisse|german\s*(b2|c1|c2)).{0,30}"


# History

PAY = "title, company, location, source, description, posted_date"


def day_slice(name: str, day: int) -> str:
    return f"""{name} as (select {CANON} as url, title, company, location, source, description, posted_date, cast(seq % 101 as double) as fit_score, seq
  from post where {I.DAYS[day]} qualify row_number() over (partition by {CANON} order by seq) = 1)"""


def merged(name: str, old: str, new: str, as_of: str) -> str:
    take = "(n.url is not null and coalesce(h.status, '') not in ('applied', 'dismissed'))"
    cols = ", ".join(f"case when {take} then n.{c} else h.{c} end as {c}" for c in ("title", "location", "source", "fit_score"))
    return f"""{name} as (select coalesce(h.url, n.url) as url, {cols}, coalesce(h.first_seen, date {lit(as_of)}) as first_seen,
   case when {take} then date {lit(as_of)} else h.last_seen end as last_seen, case when {take} then 'new' else h.status end as status,
   case when n.url is null then 'untouched' when h.status in ('applied', 'dismissed') then 'skipped_handled' when h.url is null then 'inserted'
     when h.status = 'expired' then 'reopened' else 'updated' end as action
  from {old} h full outer join {new} n on h.url = n.url)"""


FIRST = f"""{POST}, {day_slice('s2', 0)}, {day_slice('s3', 1)},
 h1 as (select s.url, title, location, source, fit_score, date '2024-01-10' as first_seen, date '2024-01-10' as last_seen,
   case when l.toxic = 1 then 'dismissed' else 'new' end as status
  from s2 s left join labels l on l.doc_id = s.seq)"""
SECOND = f"{FIRST}, {merged('h2', 'h1', 's3', '2024-01-11')}"
SHOW = "url, title, fit_score, cast(first_seen as string) as first_seen, cast(last_seen as string) as last_seen, status"
STALE = "status = 'new' and coalesce(last_seen, first_seen) < date {d} - {n}"


def expired(name: str, old: str, days: int, as_of: str) -> str:
    return f"""{name} as (select * replace (case when status = 'new' and coalesce(last_seen, first_seen) < date {lit(as_of)} - {days} then 'expired' else status end as status) from {old})"""


def old_expired(days: int, as_of: str) -> str:
    return f"(status = 'expired' and coalesce(last_seen, first_seen) < date {lit(as_of)} - {days})"


def replay() -> str:
    ctes, rows, old = [POST], [], "h0"
    ctes.append("""h0 as (select ''::varchar as url, ''::varchar as title, ''::varchar as location, ''::varchar as source, 0.0::double as fit_score,
      date '2024-01-01' as first_seen, date '2024-01-01' as last_seen, ''::varchar as status where false)""")
    for i, (as_of, day) in enumerate(REPLAY, start=1):
        ctes.append(day_slice(f"n{i}", day) if day is not None else day_slice(f"n{i}", 0).replace("where", "where false and"))
        ctes.append(merged(f"m{i}", old, f"n{i}", as_of))
        ctes.append(expired(f"e{i}", f"m{i}", 21, as_of))
        gone = old_expired(180, as_of)
        if i == 1:
            ctes.append(f"""k1 as (select e.* exclude (action) replace (case when l.toxic = 1 then 'dismissed' else e.status end as status)
              from e1 e join n1 n on n.url = e.url left join labels l on l.doc_id = n.seq)""")
        else:
            ctes.append(f"k{i} as (select * exclude (action) from e{i} where not coalesce({gone}, false))")
        acts = ", ".join(f"count(*) filter (action = '{a}') as {a}" for a in ("inserted", "updated", "reopened", "skipped_handled"))
        rows.append(f"""select {i}::bigint as day, {acts},
          (select count(*) from m{i} where status = 'new' and coalesce(last_seen, first_seen) < date {lit(as_of)} - 21) as expired,
          (select count(*) from e{i} where {gone}) as pruned, (select count(*) from e{i} where not coalesce({gone}, false)) as rows_after from m{i}""")
        old = f"k{i}"
    return "with " + ",\n ".join(ctes) + "\n" + "\nunion all ".join(rows)


# Publication

OPEN = f"""{POST}, {DET}, {scored('det')},
 open as (select * exclude (url), url || '&n=' || cast(seq as string) as url, date {lit(I.AS_OF)} - cast(seq % 4 as int) as first_seen,
   (seq % 4 = 0) as is_new from scored)"""
BAND = "case when fit_score >= 80 then 'strong' when fit_score >= 65 then 'good' when fit_score >= 50 then 'worth a look' else '' end"


def esc(expr: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        expr = f"replace({expr}, {lit(a)}, {lit(b)})"
    return expr


WHOLE = "cast(round_even(fit_score, 0)::bigint as string)"
LINE = (
    "chr(10) || cast(rk as string) || '. ' || case when is_new then '🆕 ' else '' end || '<b>' || " + WHOLE
    + " || '</b> · <a href=\"' || " + esc("url") + " || '\">' || " + esc("left(title, 90)") + " || '</a>' || chr(10) || '    ' || "
    + esc("left(company, 50)") + " || ' — ' || " + esc("left(location, 40)")
)
ROW = (
    "'<tr><td align=''right''><b>' || " + WHOLE + " || '</b></td><td>' || case when is_new then 'NEW ' else '' end || '<a href=\"' || "
    + esc("url") + " || '\">' || " + esc("left(title, 110)") + " || '</a></td><td>' || " + esc("left(company, 60)") + " || '</td><td>' || "
    + esc("left(location, 40)") + " || '</td></tr>'"
)
HEAD = """case when new_count > 0 then cast(new_count as string) || ' new internship match(es) today · ' || cast(total_open as string) || ' open in total'
  else 'No new matches today · ' || cast(total_open as string) || ' still open' end"""


def digest(key: str, top_n: int) -> str:
    part = f"partition by {key}" if key else ""
    keyed = f"{key}, " if key else ""
    group = f"group by {key}" if key else ""
    return f"""with {OPEN}, picked as (select * from (select *, row_number() over ({part} order by is_new desc, fit_score desc, url) as rk from open) where rk <= {top_n}),
 body as (select {keyed} string_agg({LINE}, chr(10) order by rk) as lines, string_agg({ROW}, '' order by rk) as trs from picked {group}),
 cnt as (select {keyed} count(*) as total_open, count(*) filter (is_new) as new_count from open {group}),
 txt as (select {keyed} total_open, new_count, {HEAD} as headline, lines, trs from cnt {f'join body using ({key})' if key else 'join body on true'}),
 msg as (select *, '<b>' || {esc('headline')} || '</b>' || chr(10) || lines as full_text from txt),
 cutm as (select *, case when length(full_text) > {MESSAGE_CHARS} then regexp_extract(left(full_text, {MESSAGE_CHARS}), '(?s)^(.*)\\n', 1) || chr(10) || '…' else full_text end as message from msg)"""


# Sources

def non_empty(expr: str) -> str:
    return f"nullif(nullif(nullif({expr}, ''), '{{}}'), '[]')"


def js(col: str, *keys: str) -> str:
    return "coalesce(" + ", ".join(non_empty(f"json_extract_string({col}, '$.{k}')") for k in keys) + ", null)"


def js_text(value: str, key: str) -> str:
    return f"case when {value} like '{{%' then {non_empty(f'''json_extract_string({value}, '$.{key}')''')} else {value} end"


ITEMS = f"""pg as ({I.AGENCY_PAGES}),
 lists as (select page, coalesce(nullif(json_extract(body, '$.ergebnisliste'), '[]'), nullif(json_extract(body, '$.stellenangebote'), '[]'), json_extract(body, '$.jobs')) as l from pg),
 its as (select page, pos, json_extract(l, '$[' || cast(pos as string) || ']') as i from (select page, l, unnest(range(json_array_length(l)::bigint)) as pos from lists)),
 fld as (select page, pos, i, {js('i', 'referenznummer', 'refnr', 'hashId')} as refnr,
   trim(coalesce({js('i', 'stellenangebotsTitel', 'titel', 'beruf', 'hauptberuf')}, '')) as title,
   {js('i', 'firma', 'arbeitgeber')} as c0, {js('i', 'arbeitsort', 'ort')} as o0,
   nullif(concat_ws(', ', nullif(json_extract_string(i, '$.stellenlokationen[0].adresse.ort'), ''), nullif(json_extract_string(i, '$.stellenlokationen[0].adresse.region'), ''), nullif(json_extract_string(i, '$.stellenlokationen[0].adresse.land'), '')), '') as adr,
   coalesce({js('i', 'datumErsteVeroeffentlichung', 'aktuelleVeroeffentlichungsdatum', 'aenderungsdatum')}, json_extract_string(i, '$.veroeffentlichungszeitraum.von')) as posted from its),
 items as (select page, pos, refnr, title, {js_text('c0', 'name')} as company, coalesce(adr, {js_text('o0', 'ort')}, 'Berlin') as location, posted
   from fld where refnr is not null qualify row_number() over (partition by refnr order by page, pos) = 1),
 hinted as (select * from items where {has('title', *TITLE_HINTS)})"""

BOARD = f"""b as ({I.BOARD}), br as (select *, trim(coalesce(nullif(job_url, ''), job_url_direct)) as url,
   case when lower(trim(city)) in ('nan', '') then null else trim(city) end as ci, case when lower(trim(state)) in ('nan', '') then null else trim(state) end as st,
   case when lower(trim(country)) in ('nan', '') then null else trim(country) end as co from b where lower(coalesce(site, '')) <> 'linkedin'),
 board as (select seq, trim(title) as title, company, coalesce(nullif(concat_ws(', ', ci, st, co), ''), location, 'Berlin') as location, 'jobspy:' || coalesce(site, 'unknown') as source, url,
   case when date_posted in ('NaT', 'None') then null else substr(date_posted, 1, 10) end as posted_date, description
   from br where url <> '' qualify row_number() over (partition by url order by seq) = 1)"""

ROLE_HINT = r"internship|praktikum|praktikant|werkstudent|working\s*student|research\s*assistant|hilfskraft|hiwi|<shk>|student\s*job|trainee|werkvertrag"
DOMAIN_HINT = r"machine\s*learning|deep\s*learning|data\s*science|computer\s*vision|<nlp>|<llm>|generative\s*ai|mlops|devops|artificial\s*intelligence|<ki>|<ai>|data\s*analys|data\s*engineer"


def relevant(text: str, path: str) -> str:
    return f"({rx(text, ROLE_HINT)} or {rx(text, DOMAIN_HINT)} or contains(lower({path}), '/job'))"


ABS_LINK, REL_LINK = r"\[([^\]]{8,180})\]\((https?://[^)\s]+)\)", r"\[([^\]]{8,180})\]\((/[^)\s]+)\)"


def md_side(pattern: str, start: str) -> str:
    t, u = f"regexp_extract_all(md, {lit(pattern)}, 1)", f"regexp_extract_all(md, {lit(pattern)}, 2)"
    return f"select page_id, site, url as page_url, {start} + unnest(range(len({t})::bigint)) as pos, unnest({t}) as title, unnest({u}) as path from md"


MD = f"""md as ({I.LISTING_MARKDOWN}),
 raw as ({md_side(ABS_LINK, '0')} union all {md_side(REL_LINK, f'len(regexp_extract_all(md, {lit(ABS_LINK)}, 1))')}),
 lnk as (select page_id, pos, site, page_url, trim(title) as title, path, case when path like 'http%' then path when path like '//%' then regexp_extract(page_url, '^([^/]+)//', 1) || path
   else regexp_extract(page_url, '^([^/]+//[^/?#]*)', 1) || path end as url from raw),
 links as (select * from lnk where {relevant("(title || ' ' || url)", 'path')})"""

# Posting-like anchors of the listing pages: the cards ahead of the page, and the page's own.
HTML = f"""hp as ({I.FLAT_PAGES}),
 anc as (select page_id, site, url as page_url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) as href,
   unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) as t from hp where site in ('site0', 'site1')),
 fit as (select *, case when t = 'Apply here now' then 'Apply here now for this data science role' else t end as title,
   case when href like 'http%' then href else regexp_extract(page_url, '^([^/]+//[^/?#]*)', 1) || href end as url from anc
   where length(t) >= 8 and href not like 'mailto:%'),
 flat as (select page_id, site, title, url, page_url, case when site = 'site0' and title = 'Machine learning internship' then 'Firm ' || cast(page_id % 7 as string) else '' end as company,
   case when site = 'site0' and title = 'Machine learning internship' then 'Berlin' else '' end as location, title as snippet from fit where {relevant("(title || ' ' || href)", 'href')}),
 near_pg as (select page_id, 'site' || cast(page_id % 3 as string) as site, url as page_url, page_id % 5 as k, page_id % 3 = 0 as near, cast(page_id as string) as n,
   regexp_extract(url, '^([^/]+//[^/?#]*)', 1) as org, regexp_extract(url, '^[^/]+//[^/?#]*([^?#]*)', 1) as pth from pages where page_id % 3 < 2),
 deep as (select page_id, site, page_url, 'Apply here now Nested ' || n || ' data science role' as title, org || '/p/' || n as url, case when near then 'Nested ' || n else '' end as company, '' as location from near_pg where k = 0
  union all select page_id, site, page_url, 'Machine learning internship', org || '/y/' || n, case when near then 'Firm ' || cast(page_id % 7 as string) else '' end, case when near then 'Berlin' else '' end from near_pg where k = 1
  union all select page_id, site, page_url, 'Offene Stelle Kühl & Söhne Köln Praktikum', org || coalesce(nullif(regexp_extract(pth, '^(.*/)[^/]*/[^/]*$', 1), ''), '/') || 'q/r?x=' || n,
    case when near then 'Kühl & Söhne Köln Praktikum' else '' end, case when near then 'Köln' else '' end from near_pg where k = 3
  union all select page_id, site, page_url, 'Apply here now shk ' || n, org || '/t/' || n, '', '' from near_pg where k = 4),
 plinks as (select page_id, site, title, url, page_url, company, location, snippet from flat union all select page_id, site, title, url, page_url, company, location, title from deep)"""

STREAK = """lg as (select user_id, ts, event_id, event_type <> 'error' as ok from events),
 isl as (select *, sum(case when ok then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from lg),
 stk as (select *, sum(case when ok then 0 else 1 end) over (partition by user_id, island order by ts, event_id rows unbounded preceding)::bigint as streak from isl),
 trp as (select *, max(streak) over (partition by user_id order by ts, event_id rows unbounded preceding) >= 3 as tripped from stk)"""
STREAK_ROWS = f"with {STREAK} select event_id, user_id, streak, tripped from trp"

URL_PARTS = r"'^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$'"
TRACKING = "(?i)^(utm_\\w+|gclid|fbclid|msclkid|mc_[ce]id|ref|referrer|source|src|campaign|trk|trkCampaign|origin|from|sessionid|_ga)$"
FORM = "replace(replace({}, '%20', '+'), '%7E', '~')"

# Deduplication: all pairs of a block by word sets; the edit form by a dynamic
# program over the few pairs that Levenshtein distance leaves open; then the
# sequential rule, one record per step.
GREEDY_STEPS = r"""
 fp as (select *, substr(split_part(trim(regexp_replace(lower(company), '[^a-z0-9 ]+', '', 'g')), ' ', 1), 1, 6) as block,
   list_sort(list_distinct(string_split_regex(trim(lower(company || ' | ' || title || ' | ' || location)), '\s+'))) as w from near),
 prs as (select a.seq as x, b.seq as y, list_sort(list_intersect(a.w, b.w)) as i, list_filter(a.w, lambda t: not list_contains(b.w, t)) as p,
   list_filter(b.w, lambda t: not list_contains(a.w, t)) as q from fp a join fp b on a.block = b.block and a.seq < b.seq),
 txt as (select x, y, array_to_string(p, ' ') as a, array_to_string(q, ' ') as b, length(array_to_string(i, ' ')) as s from prs),
 len as (select *, length(a) as la, length(b) as lb, s + 1 + length(a) as wa, s + 1 + length(b) as wb from txt),
 cls as (select *, case when la = 0 or lb = 0 or 100 - 100 * (1 + la) / (s + wa) >= 90 or 100 - 100 * (1 + lb) / (s + wb) >= 90
   or 2 * levenshtein(a, b) <= 0.1 * (wa + wb) then 'yes' when levenshtein(a, b) > 0.1 * (wa + wb) then 'no' else 'open' end as verdict from len),
 cand as materialized (select * from cls where verdict = 'open'),
 cell(x, y, i, j, v) as (select x, y, 0, unnest(range(0, lb + 1)), 0 from cand union all
   select x, y, i + 1, j, max(c) over (partition by x, y order by j) from (select r.x, r.y, r.i, r.j,
     case when r.j > 0 and substr(k.a, r.i + 1, 1) = substr(k.b, r.j, 1) then lag(r.v) over (partition by r.x, r.y order by r.j) + 1 else r.v end as c
     from cell r join cand k on k.x = r.x and k.y = r.y where r.i < k.la)),
 edge as materialized (select x, y from cls where verdict = 'yes' union all select k.x, k.y from cand k join cell c on c.x = k.x and c.y = k.y and c.i = k.la and c.j = k.lb
   where 100 - 100 * (k.la + k.lb - 2 * c.v) / (k.wa + k.wb) >= 90),
 node as materialized (select row_number() over (order by n.seq) as k, n.seq, coalesce(list(e.x) filter (e.x is not null), []) as nb
   from near n left join edge e on e.y = n.seq group by n.seq),
 walk(k, led) as (select 0::bigint, []::bigint[] union all
   select w.k + 1, case when list_has_any(n.nb, w.led) then w.led else list_append(w.led, n.seq) end from walk w join node n on n.k = w.k + 1),
 led as (select unnest(led) as l from (select led from walk order by k desc limit 1)),
 grp as (select l as seq, l as leader_seq from led union all select y, min(x) from edge join led on l = x where y not in (select l from led) group by y)"""
GREEDY = f"with recursive near as ({I.NEAR}),{GREEDY_STEPS}"

DAY = f"""with recursive {POST}, {NORM}, near as (select seq, company, title, location, description, posted_date from norm),{GREEDY_STEPS},
      kept as (select g.leader_seq as seq, n.* exclude (seq) from norm n join grp g using (seq)
        qualify row_number() over (partition by g.leader_seq order by length(n.description) desc, (n.posted_date is null), n.seq) = 1),
      g as (select * from kept where {reason()} is null), {scored('g', tag='_d')}, r as (select *, row_number() over (order by fit_score desc, seq) as rk from scored_d),
      a as (select seq from r where fit_score >= 55 and rk <= 50),
      b as (select seq from r where seq not in (select seq from a) and fit_score >= 50 order by rk limit greatest(0, 15 - (select count(*) from a))),"""

LETTERS = ", ".join(f"(length(t) - length(replace(t, '{c}', '')))::double as {c}" for c in "aeiou")
ENCODED = f"""with {POST}, {DET}, tx as (select *, title || chr(10) || company || chr(10) || location || chr(10) || description as t from det), ct as (select *, {LETTERS} from tx),
      v as (select *, case when a + e + i + o + u = 0 then 0.0 else 0.5 * (a + e + i + o) / sqrt(a * a + e * e + i * i + o * o + u * u) end as sim from ct)"""
RECHECK = f"""with {POST}, {DET}, o as (select * exclude (url), url || '&n=' || cast(seq as string) as url, date {lit(I.AS_OF)} - cast(seq % 4 as int) as first_seen from det), {scored('o', '2024-01-12')},
      v as (select *, {reason(P, '2024-01-12')} as why, seq % 10 = 0 as applied from scored), k as (select *, not applied and why is null and fit_score >= 50 as kept from v)"""
RECHECKED = f"""{RECHECK}
      select url, title, case when kept then fit_score else cast(seq % 101 as double) end as fit_score, cast(first_seen as string) as first_seen,
        case when kept then '2024-01-12' else cast(first_seen as string) end as last_seen, case when applied then 'applied' when kept then 'new' else 'dismissed' end as status, not kept as old_reason from k"""

ORACLES: dict[str, str] = {
    "text_keywords": f"""with {POST} select seq, {has(BLOB, 'ai')} as has_ai, {has(BLOB, *P.must_have_any)} as has_any,
      array_to_string({hits(BLOB, (*P.domains, *P.must_have_any, 'e-mail', '5+ years'))}, ',') as hits, array_to_string({hits('location', P.locations)}, ',') as places from post""",
    "text_quotes": f"""with {POST} select seq, {quote(BLOB, 'ai', 30)} as quote_ai, {quote(BLOB, 'deep learning', 12)} as quote_dl,
      {strip(f"regexp_extract(replace({BLOB}, chr(10), ' '), {lit(EN)}, 0)")} as english, {strip(f"regexp_extract(replace({BLOB}, chr(10), ' '), {lit(DE)}, 0)")} as german from post""",
    "text_dates": f"with d as ({I.DATES}) select seq, cast({parse('raw')} as string) as posted_on, {age('raw', I.AS_OF)}::bigint as age from d",
    "clean_title": rf"""with t as ({I.TITLES}) select seq, trim(regexp_replace(regexp_replace(trim(raw, ' -–—|·' || chr(9) || chr(10)), '\s+', ' ', 'g'),
      '(?i)\s*[-–—|·]\s*(apply\s*now|jetzt\s*bewerben|mehr\s*erfahren|read\s*more|details?|view\s*job)\s*$', '')) as title from t""",
    "canonical_url": f"""with u as ({I.URLS}), s as (select page_id, trim(raw) as raw, regexp_matches(trim(raw), {URL_PARTS}) as ok from u),
      q as (select *, case when ok then regexp_replace(regexp_extract(raw, {URL_PARTS}, 3), '/+$', '') end as path,
        list_filter(list_transform(list_filter(string_split(regexp_extract(raw, {URL_PARTS}, 4), '&'), lambda p: contains(p, '=')),
          lambda p: [url_decode(replace(split_part(p, '=', 1), '+', ' ')), url_decode(replace(substr(p, strpos(p, '=') + 1), '+', ' '))]),
          lambda x: x[2] <> '' and not regexp_matches(x[1], {lit(TRACKING)})) as kept from s)
      select page_id, case when not ok then raw else lower(regexp_extract(raw, {URL_PARTS}, 1)) || '://' || regexp_replace(lower(regexp_extract(raw, {URL_PARTS}, 2)), '^www\\.', '')
        || case when path = '' then '/' else path end || case when len(kept) > 0 then '?' || array_to_string(list_transform(kept, lambda x: {FORM.format('url_encode(x[1])')} || '=' || {FORM.format('url_encode(x[2])')}), '&') else '' end end as url from q""",
    "role_and_language": f"""with {POST}, both_ as (select seq, title, description from post union all select doc_id + 1000000000, '', text from documents)
      select seq, {ROLE} as role_type, {LANGUAGE} as language from both_""",
    "normalize_postings": f"with {POST}, {NORM} select seq, title, company, location, source, url, role_type, language, substr(posted_date, 1, 10) as posted_date, length(description) as chars from norm",
    "dedup_features": f"""with n as ({I.NEAR}) select seq, substr(split_part(trim(regexp_replace(lower(location), '[^a-z0-9 ]+', '', 'g')), ' ', 1), 1, 6) as block,
      trim(lower(company || ' | ' || title || ' | ' || location)) as fingerprint from n""",
    "dedup_leaders": GREEDY + " select seq, leader_seq from grp",
    "dedup_kept": GREEDY + """ select g.leader_seq as seq, title, location, length(description) as chars, posted_date from near join grp g using (seq)
      qualify row_number() over (partition by g.leader_seq order by length(description) desc, (posted_date is null), seq) = 1""",
    "dedup_richest_copy": f"""with n as ({I.NEAR}), g as (select *, min(seq) over (partition by title) as leader_seq from n)
      select seq, leader_seq from g qualify row_number() over (partition by leader_seq order by length(description) desc, (posted_date is null), seq) = 1""",
    "gate_flags": f"with {POST}, {DET} select seq, " + ", ".join(f"{c} as {g}" for g, c in flags().items()) + " from det",
    "gate_reasons": f"with {POST}, {DET} select seq, coalesce({reason()}, 'passed') as reason from det",
    "gate_dropoff": dropoff(P),
    "gate_survivors": f"with {POST}, {NORM} select seq, title, url from norm where {reason()} is null",
    "gate_german_level": f"with {POST} select seq, " + ", ".join(f"{german(BLOB, m)} as over_{m.lower()}" for m in ("A2", "B1", "C1", "C2", "none")) + " from post",
    "gate_empty_lists": dropoff(P.but(domains=(), must_have_any=(), role_types=(), exclude_words=())),
    "rank_semantic": """with p as (select embedding::double[] as v from embeddings where vec_id = 0), s as (select vec_id, list_inner_product(embedding::double[], (select v from p)) as sim from embeddings)
      select vec_id, round(sim, 6) as sim, round(greatest(0.0, least(1.0, (sim - 0.15) / (0.6 - 0.15))), 6) as semantic, 1.0::double as self from s""",
    "rank_encoded": f"""{ENCODED}, {scored('v', sim='sim')} select seq, round(sim, 6) as sim, round(semantic, 6) as semantic from scored""",
    "rank_components": f"with {POST}, {DET}, {scored('det')} select seq, round(role, 6) as role, round(domain, 6) as domain, round(recency, 6) as recency, round(language_fit, 6) as language_fit from scored",
    "rank_scores": f"with {POST}, {DET}, {scored('det')} select seq, fit_score from scored",
    "rank_scores_with_vectors": f"""with {POST}, {DET}, v as (select d.*, coalesce(list_inner_product(e.embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 0.0) as sim
      from det d left join embeddings e on e.vec_id = d.seq), {scored('v', sim='sim')} select seq, fit_score from scored""",
    "rank_reasons": f"with {POST}, {DET}, {scored('det')} select seq, {reason_text()} as fit_reason from scored",
    "rank_spread": f"""with {POST}, {DET}, {scored('det')}, o as (select list(fit_score order by fit_score desc) as l from scored) select l[1] as top, l[len(l) // 2 + 1] as median, l[len(l)] as bottom from o""",
    "rank_select": f"""with {POST}, {NORM}, g as (select * from norm where {reason()} is null), {scored('g')}, r as (select *, row_number() over (order by fit_score desc, seq) as rk from scored),
      a as (select * from r where fit_score >= 55 and rk <= 50), b as (select * from r where seq not in (select seq from a) and fit_score >= 50 order by rk limit greatest(0, 15 - (select count(*) from a)))
      select seq, fit_score from a union all select seq, fit_score from b""",
    "rank_select_by_company": f"""with {POST}, {DET}, {scored('det')}, r as (select *, row_number() over (partition by company order by fit_score desc, seq) as rk from scored),
      a as (select * from r where fit_score >= 80 and rk <= 5), c as (select company, count(*) as n from a group by company),
      b as (select r.* from r left join c using (company) where fit_score >= 40 and not (r.fit_score >= 80 and r.rk <= 5) and coalesce(n, 0) < 8
        qualify row_number() over (partition by r.company order by r.rk) <= 8 - coalesce(n, 0))
      select company, seq, fit_score from a union all select company, seq, fit_score from b""",
    "store_merge": f"with {SECOND} select {SHOW}, action from h2",
    "store_merge_small": f"with {SECOND}, {day_slice('s6', 3)}, {merged('h3', 'h2', 's6', '2024-01-14')} select {SHOW}, action from h3",
    "store_actions": f"with {SECOND}, a as (select unnest(['inserted', 'updated', 'reopened', 'skipped_handled']) as action) select a.action, count(h2.url) as n from a left join h2 on h2.action = a.action group by a.action",
    "store_expire": f"with {SECOND}, {expired('x', 'h2', 21, '2024-02-01')} select {SHOW} from x",
    "store_prune": f"with {SECOND}, {expired('x', 'h2', 21, '2024-02-10')} select {SHOW} from x where not {old_expired(30, '2024-02-10')}",
    "store_set_status": f"with {SECOND}, {day_slice('s5', 2)} select h2.url, h2.title, h2.fit_score, cast(first_seen as string) as first_seen, cast(last_seen as string) as last_seen, case when s5.url is not null then 'applied' else status end as status from h2 left join s5 on s5.url = h2.url",
    "store_list_active": f"with {SECOND} select {SHOW}, source, location from h2 where status = 'new' and source ilike '%AGENTUR%' and location ilike '%köln%' and first_seen = date '2024-01-11' and fit_score >= 30 order by fit_score desc, url limit 40",
    "store_list_by_score": f"with {SECOND} select {SHOW}, source, location from h2 where status = 'new' and fit_score >= 60 order by fit_score desc, url limit 25",
    "store_list_clustered": f"with {SECOND} select {SHOW}, source, location from h2 where status = 'new' and fit_score >= 60 order by fit_score desc, url limit 25",
    "store_list_by_place": f"with {SECOND} select {SHOW}, source, location from h2 where status = 'new' and source ilike '%indeed%' and location ilike '%M_nchen%'",
    "store_counts": f"with {SECOND} select count(*) filter (status = 'new') as total_open, count(*) filter (status = 'new' and first_seen = date '2024-01-11') as new_today from h2",
    "store_last_run": "select (select cast(ts as string) from events where event_type = 'error' order by event_id desc limit 1) as run_ts union all select 'never'",
    "store_upgrade": f"with {SECOND} select url, title, fit_score, cast(first_seen as string) as first_seen, cast(first_seen as string) as last_seen, status from h2",
    "store_replay": replay(),
    "sheet_all_open": f"""with {OPEN} select case when is_new then 'NEW' else '' end as new, fit_score, title, company, location, source, language, coalesce(posted_date, '') as posted_date,
      {age('posted_date', I.AS_OF)}::bigint as age_days, url as apply_link, {BAND} as band from open""",
    "sheet_new_today": f"with {OPEN} select 'NEW' as new, fit_score, title, url as apply_link from open where is_new",
    "sheet_dated": f"""with {OPEN}, s as (select *, 'All Open' as sheet from open union all select *, 'New Today' from open where is_new)
      select {lit(I.AS_OF)} as run_date, sheet, {BAND} as band, count(*) as n, round(sum(fit_score), 1) as total from s group by all""",
    "keep_newest": f"with {POST} select seq, posted_date as run_date from post where posted_date is not null qualify dense_rank() over (order by posted_date desc) <= 5",
    "digest_pick": f"with {OPEN} select row_number() over (order by is_new desc, fit_score desc, url) as rk, seq, fit_score from open qualify rk <= 10",
    "digest_message": digest("", 40) + f""" select total_open, new_count, headline, 'Internships: ' || cast(new_count as string) || ' new today' as subject, message,
      '<p><b>' || {esc('headline')} || '</b></p><table cellpadding=''6'' cellspacing=''0'' border=''0''><tr><th align=''right''>Fit</th><th align=''left''>Role</th><th align=''left''>Company</th><th align=''left''>Location</th></tr>'
      || trs || '</table><p style=''color:#666;font-size:12px''>Full sheet: a&amp;b.parquet</p>' as html from cutm""",
    "digest_by_company": digest("company", 3) + " select company, total_open, new_count, headline, message from cutm where new_count > 0",
    "recheck_report": f"""with {POST}, {DET}, o as (select * exclude (url), url || '&n=' || cast(seq as string) as url from det where seq % 10 <> 0), {scored('o', '2024-01-12')},
      v as (select *, {reason(P, '2024-01-12')} as why from scored)
      select url, title, cast(seq % 101 as double) as old_score, case when why is null then printf('%.1f', fit_score) else 'filtered out' end as new_score from v where why is not null or fit_score < 50""",
    "recheck_history": RECHECKED,
    "recheck_store": RECHECKED,
    "recheck_published": f"""{RECHECK}, sheet as (select unnest(['All Open', 'New Today']) as sheet)
      select '2024-01-12' as run_date, sheet, title, url as apply_link, fit_score from k cross join sheet
      where kept and (sheet = 'All Open' or first_seen = date '2024-01-12')""",
    "board_rows": f"with {BOARD} select title, company, location, source, url, posted_date, length(description) as chars from board",
    "agency_items": f"with {ITEMS} select page, refnr, title, coalesce(company, '') as company, location, substr(posted, 1, 10) as posted from items",
    "agency_postings": f"""with {ITEMS}, det as ({I.AGENCY_DETAILS})
      select title, coalesce(company, case when d.body is null then '' else coalesce(json_extract_string(d.body, '$.firma'), json_extract_string(d.body, '$.arbeitgeber.name')) end) as company, location, 'arbeitsagentur' as source,
        coalesce(nullif(json_extract_string(d.body, '$.externeUrl'), ''), nullif(json_extract_string(d.body, '$.url'), ''), 'https://www.arbeitsagentur.de/jobsuche/jobdetail/' || c.refnr) as url,
        coalesce(json_extract_string(d.body, '$.stellenangebotsBeschreibung'), json_extract_string(d.body, '$.beschreibung.text'), '') as description,
        substr(coalesce(json_extract_string(d.body, '$.aktuelleVeroeffentlichungsdatum'), posted), 1, 10) as posted_date from hinted c left join det d using (refnr)""",
    "agency_cap": f"""with {ITEMS}, n as (select page, count(*) as n from hinted group by page), c as (select *, sum(n) over (order by page rows between unbounded preceding and 1 preceding) as before from n)
      select page, n from c where coalesce(before, 0) < 100""",
    "page_links": f"with {HTML} select page_id, site, title, url, company, location, snippet from plinks",
    "page_own_links": f"""with op as ({I.OWN_PAGES}), an as (select page_id, url as page_url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) as href,
        unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) as t from op),
      tx as (select page_id, page_url, {unescaped('href')} as href, {squeeze(unescaped('t'))} as title from an)
      select page_id, title, regexp_extract(page_url, '^([^/]+//[^/?#]*)', 1) || href as url from tx
      where length(title) >= 8 and regexp_matches(title || ' ' || lower(href), '(?i)(tion|ment|heit)|(ciónes|erth)')""",
    "normalize_odd": rf"""with o as ({I.ODD}), c as (select seq, trim(regexp_replace(trim(coalesce(title, ''), ' -–—|·' || chr(9) || chr(10)), '\s+', ' ', 'g')) as title,
        coalesce(nullif({squeeze("coalesce(company, '')")}, ''), 'Unknown') as company, coalesce(nullif({squeeze("coalesce(location, '')")}, ''), 'Germany') as location,
        trim(url) as url, substr(posted_date, 1, 10) as posted_date from o)
      select * from c where title <> '' and url <> ''""",
    "rank_nothing": "select 0::bigint as chosen, count(*) as postings from documents",
    "markdown_links": f"with {MD} select page_id, pos, site, title, url, title as snippet from links",
    "listing_postings": f"""with {MD} select title, site as company, 'Germany' as location, 'custom:' || site as source, url, title as description from links
      where rtrim(url, '/') <> rtrim(page_url, '/') qualify row_number() over (partition by site, url order by page_id, pos) = 1""",
    "source_counts": f"""with {BOARD}, {ITEMS}, {HTML}
      select 'jobspy' as source, count(*) as n from board union all select 'arbeitsagentur', count(*) from hinted
      union all select 'custom', count(distinct (site, url)) from plinks where rtrim(url, '/') <> rtrim(page_url, '/')""",
    "failure_streaks": STREAK_ROWS,
    "failure_streak_state": f"with {STREAK} select user_id, arg_max(streak, (ts, event_id)) as streak, bool_or(tripped) as tripped from trp group by user_id",
    "failure_streak_stream": STREAK_ROWS,
    "daily_run_summary": f"""{DAY}
      k as (select count(*) as n from (select seq from a union all select seq from b))
      select {lit(I.AS_OF)} as run_date, (select count(*) from post) as raw, (select count(*) from norm) as normalized, (select count(*) from kept) as deduped,
        (select count(*) from g) as filtered, n as ranked, n as inserted, 0::bigint as updated, 0::bigint as reopened, 0::bigint as skipped_handled,
        0::bigint as expired, 0::bigint as pruned, n as new_today, n as total_open from k""",
    "incremental_history": f"""{DAY}
      c as (select seq from a union all select seq from b)
      select url, title, fit_score, {lit(I.AS_OF)} as first_seen, {lit(I.AS_OF)} as last_seen, 'new' as status from r join c using (seq)""",
    "run_log": f"""{DAY}
      k as (select count(*) as n from (select seq from a union all select seq from b))
      select {lit(I.AS_OF)} as run_date, {lit(I.AS_OF)} as last_run, (select count(*) from post) as raw, (select count(*) from norm) as normalized, (select count(*) from kept) as deduped,
        (select count(*) from g) as filtered, n as ranked, n as inserted, 0::bigint as updated, 0::bigint as reopened, 0::bigint as skipped_handled,
        0::bigint as expired, 0::bigint as pruned, n as new_today, n as total_open from k""",
    "run_published": f"""{DAY}
      c as (select seq from a union all select seq from b), sheet as (select unnest(['All Open', 'New Today']) as sheet)
      select {lit(I.AS_OF)} as run_date, sheet, title, url as apply_link, fit_score from r join c using (seq) cross join sheet""",
}

ORACLES["store_delta_replay"] = ORACLES["store_replay"]
