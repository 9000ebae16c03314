"""What queries of this subpackage should return, in DuckDB's SQL, where SQL can tell it."""

from __future__ import annotations

from itertools import permutations

from graphloom.llm import pii, urls

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = urls.UPPER, urls.LOWER

MIXING = rf"""
with s as (select doc_id, source, text, cast(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as bigint) as size from documents),
p as (select source, cast(sum(size) as bigint) as source_size from s group by source),
w as (select source, source_size, cast([3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as double) as weight, 2.0::double * source_size as cap from p),
l as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level,
  row_number() over (order by cap / weight, source nulls last) as place from w),
f as (select arg_min(level, place) filter (level * weight <= cap) as water from l),
t as (select source, source_size, case when water is null then cap else least(cap, water * weight) end as target from l, f),
r as (select s.doc_id, s.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end as rate, cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), 'null:' || md5(coalesce(text, '')))), 1, 13) as bigint) / 4503599627370496.0::double as u
  from s join t on s.source is not distinct from t.source),
c as (select *, cast(floor(rate) as bigint) + cast(u < rate - floor(rate) as bigint) as copies from r)
select doc_id, size, source_size, target, copies, size * copies as taken from c
"""

TOP_K = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as f from embeddings where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.f, c.f) as bigint) as score from v q join v c on q.vec_id <> c.vec_id and len(q.f) = len(c.f) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
"""

NEAR = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end)) as x from w),
n as (select doc_id, count(*) as n from s group by doc_id),
k as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by all),
l as (select k.a, k.b from k join n x on k.a = x.doc_id join n y on k.b = y.doc_id where 100 * c >= 80 * (x.n + y.n - c)),
r as (select doc_id, doc_id as other from w union select r.doc_id, l.b from r join l on r.other = l.a)
select w.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.other) as component_id, w.doc_id = min(r.other) as kept from w join r on w.doc_id = r.doc_id left join n on w.doc_id = n.doc_id group by w.doc_id
"""


def _sum(parts: str, upto: str) -> str:
    return f"coalesce(list_sum(list_transform({parts}[1:{upto}], lambda z: length(z))), 0)"


def _spans(kind: str, order: int, pattern: str, check: str) -> str:
    """Spans of one kind: parts between matches and the matches give offsets."""
    return (
        f"select doc_id, text, unnest(list_filter(list_transform(hits, lambda h, i: {{'s': cast({_sum('parts', 'i')} + {_sum('hits', '(i - 1)')} as bigint), 'o': {order}, 'k': '{kind}', 'v': h}}), lambda q: {check})) as q "
        f"from (select doc_id, text, regexp_extract_all(text, '{pattern}') as hits, string_split_regex(text, '{pattern}') as parts from t)"
    )


_DIGITS = "regexp_replace(q.v, '[^0-9]', '', 'g')"
_PART = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda d, j: case when j % 2 = 1 then d::int when d::int > 4 then d::int * 2 - 9 else d::int * 2 end)) % 10 = 0"
_PLAIN = "replace(q.v, ' ', '')"
_MOD = f"list_reduce(list_prepend(0::hugeint, list_transform(string_split(substr({_PLAIN}, 5) || substr({_PLAIN}, 1, 4), ''), lambda c: case when c between '0' and '9' then ascii(c) - 48 else ascii(c) - 55 end::hugeint)), lambda a, c: case when c > 9 then (a * 100 + c) % 97 else (a * 10 + c) % 97 end) = 1 and length({_PLAIN}) between 15 and 34"
_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", rf"regexp_full_match(q.v, '{_PART}\.{_PART}\.{_PART}\.{_PART}')"),
    ("card", r"[0-9](?:[ -]?[0-9])+", f"length({_DIGITS}) between 14 and 19 and {_LUHN}"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) between 10 and 15"),
    ("iban", r"\b[A-Z][A-Z][0-9][0-9](?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)\b", _MOD),
)
_TEXT = "k || ':' || s || ':' || (s + length(v))"
PII = (
    "with t as (select doc_id, coalesce(text, '') as text from documents), a as (" + " union all ".join(_spans(k, i, p, c) for i, (k, p, c) in enumerate(_KINDS)) + "), "
    "b as (select doc_id, q.s as s, q.o as o, q.k as k, q.v as v, "
    f"translate(substr(text, greatest(q.s - {pii.WINDOW}, 0) + 1, q.s - greatest(q.s - {pii.WINDOW}, 0)) || ' ' || substr(text, q.s + length(q.v) + 1, {pii.WINDOW}), '{UPPER}', '{LOWER}') as around from a), "
    f"c as (select *, least(10, case when k in ('card', 'iban') then 9 else 6 end + case {' '.join(f"when k = '{k}' and regexp_matches(around, '{pii._near(w)}') then 3" for k, w in pii.NEAR.items())} else 0 end - case when regexp_matches(around, '{pii._near(pii.AGAINST)}') then 1 else 0 end) / 10.0 as score from b), "
    f"g as (select doc_id, count(*) filter (k = 'email') as n_email, count(*) filter (k = 'ip') as n_ip, count(*) filter (k = 'card') as n_card, count(*) filter (k = 'phone') as n_phone, string_agg({_TEXT}, ',' order by s, o) filter (o < 4) as base, string_agg({_TEXT}, ',' order by s, o) as spans, string_agg(printf('%.1f', score), ',' order by s, o) as scores from c group by doc_id) "
    "select t.doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(scores, '') as scores from t left join g on t.doc_id = g.doc_id"
)


def url_filter() -> str:
    """The levels of the template tree, one after another; paths of `pages` have no more than DEPTH levels that differ."""
    above = lambda bad, seen, rate: f"({bad} + {urls.PRIOR}::double * {rate}) / ({seen} + {urls.PRIOR}::double)"
    fits = [(f"(host = '{h}' or host like '%.{h}') and starts_with(path, '{p}')", h + p, act) for act, h, p in sorted(urls.RULES, key=lambda r: (-len(r[1] + r[2]), r))]
    rule = "case " + " ".join(f"when {c} then '{r}'" for c, r, _ in fits) + " end"
    action = "case " + " ".join(f"when {c} then '{a}'" for c, _, a in fits) + " end"
    ctes = [
        "u as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) end as rest from pages)",
        rf"h as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u)",
        rf"m as (select *, {rule} as rule, {action} as action, regexp_replace(regexp_replace(path, '\b[0-9a-f]{{8,}}\b', '<h>', 'g'), '[0-9]+', '<n>', 'g') as masked from h)",
        "c as (select host, masked, count(*) as n, count(action) as seen, count(*) filter (action = 'block') as bad, list_filter(string_split(masked, '/'), lambda s: s <> '') as parts from m group by host, masked)",
        "hs as (select host, array_to_string(string_split(host, '.')[-2:], '.') as domain, sum(seen) as seen, sum(bad) as bad from c group by host)",
        "ds as (select domain, string_split(domain, '.')[-1] as top, sum(seen) as seen, sum(bad) as bad from hs group by domain)",
        "ts as (select top, sum(seen) as seen, sum(bad) as bad from ds group by top)",
        f"tr as (select top, {above('bad', 'seen', '0.5::double')} as rate from ts)",
        f"dr as (select domain, {above('ds.bad', 'ds.seen', 'tr.rate')} as rate from ds join tr on ds.top = tr.top)",
        f"hr as (select host, dr.rate as prior, {above('hs.bad', 'hs.seen', 'dr.rate')} as rate from hs join dr on hs.domain = dr.domain)",
        "t0 as (select c.*, '' as prefix, hr.prior, hr.rate from c join hr on c.host = hr.host)",
    ]
    for k in range(urls.DEPTH):
        ctes += [
            f"b{k} as (select host, prefix, parts[{k + 1}] as part, sum(n) as n, sum(seen) as seen, sum(bad) as bad from t{k} where len(parts) > {k} group by all)",
            f"q{k} as (select *, count(*) over w as p_parts, sum(n) over w as p_n, sum(seen) over w as p_seen, sum(bad) over w / sum(seen) over w as rate from b{k} window w as (partition by host, prefix))",
            f"g{k} as (select host, prefix, part, seen, bad, case when p_parts >= {urls.MANY} and n < {urls.SMALL}::double * p_n then '*' when p_parts > 1 and p_seen > 0 and (seen = 0 or abs(bad / seen - rate) <= {urls.NEAR} * sqrt(rate * (1 - rate) / seen)) then '~' else part end as named from q{k})",
            f"n{k} as (select *, sum(seen) over w as node_seen, sum(bad) over w as node_bad from g{k} window w as (partition by host, prefix, named))",
            f"t{k + 1} as (select t.host, t.masked, t.n, t.seen, t.bad, t.parts, t.prefix || coalesce('/' || g.named, '') as prefix, case when g.named is null then t.prior else t.rate end as prior, case when g.named is null then t.rate else {above('g.node_bad', 'g.node_seen', 't.rate')} end as rate from t{k} t left join n{k} g on t.host = g.host and t.prefix = g.prefix and t.parts[{k + 1}] = g.part)",
        ]
    ctes += [
        f"e as (select *, prefix || case when len(parts) > {urls.DEPTH} then '/**' else '' end as template from t{urls.DEPTH})",
        f"f as (select host, template, {above('sum(bad)', 'sum(seen)', 'any_value(prior)')} as purity from e group by all)",
    ]
    last = f"select m.page_id, m.host, m.path, m.rule, coalesce(m.action, case when f.purity >= {urls.LEAST}::double then 'block' else 'allow' end) as verdict, e.template, f.purity from m join e on m.host = e.host and m.masked = e.masked join f on e.host = f.host and e.template = f.template"
    return "with " + ",\n".join(ctes) + "\n" + last


_ORDERS = ", ".join("('" + "".join(p) + "')" for p in permutations("ABCDE"))
FILTERS = rf"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '{WORD}') as w, min(doc_id) over (partition by text) as least from d),
f as (select doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] as fails from w),
l as (select doc_id, coalesce(max(cast(quality = 1 as int)), 0) as good, coalesce(max(cast(toxic = 1 as int)), 0) as toxic from labels where doc_id is not null group by doc_id),
j as (select f.part, f.fails, count(*) as n, sum(coalesce(l.good, 0)) as good, sum(coalesce(l.toxic, 0)) as toxic from f left join l on f.doc_id = l.doc_id group by all),
o as (select unnest([1, 2, 3, 4, 5]) as step, o as filter_order from (values {_ORDERS}) t(o)),
s as (select j.*, filter_order, step, list_transform(string_split(filter_order, ''), lambda x: fails[ascii(x) - 64]) as in_order from j, o),
m as (select *, in_order[step] as hit, list_contains(in_order[1:step - 1], true) as early from s),
r as (select part, filter_order, step, sum(n) filter (not hit and not early) as kept, sum(n) filter (hit and not early) as removed, sum(n) filter (hit and early) as redundant,
  sum(n) filter (hit and len(list_filter(fails, lambda x: x)) = 1) as unique_fails, sum(good) filter (hit and not early) as good_lost, sum(toxic) filter (hit and not early) as toxic_lost from m group by all),
z as (select *, sum(coalesce(removed, 0)) over (partition by part, filter_order[step:step]) as shapley from r)
select part, filter_order, step, {', '.join(f'cast(coalesce({c}, 0) as bigint) as {c}' for c in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost', 'shapley'))} from z
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": MIXING, "op3_pii": PII, "op4_top_k": TOP_K, "op6_url_filter": url_filter(), "op9_near_duplicates": NEAR, "op13_filter_audit": FILTERS}
