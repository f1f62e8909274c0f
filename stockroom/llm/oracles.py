"""DuckDB twins of the queries that SQL can express over whole tables.

The others (parsing, tokenising, fitted models, 64-bit XXH64 fingerprints,
byte windows) are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from stockroom.llm.mixing import BUDGET_PERCENT, DOMAINS, LEVELS, MAX_EPOCHS, PASSES, SEED, WEIGHTS
from stockroom.llm.quality_rules import KEEP_BITS, MAX_REPEAT_PERCENT, MIN_GROUP, MIN_WORDS, RATES, SPREADS, WINDOW
from stockroom.llm.ranked_search import TOP
from stockroom.llm.winnowing import WINDOW as GRAM_WINDOW

_SPACE = "[\\x20\\x09-\\x0D]+"

_RATE_SQL = {
    "symbol_rate": "coalesce(n_symbols * 1000 // nullif(word_chars, 0), 0)",
    "dup_line_rate": "coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0)",
    "repeat_rate": "coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0)",
    "upper_rate": "coalesce(n_upper * 1000 // nullif(word_chars, 0), 0)",
    "word_length": "coalesce(word_chars * 1000 // nullif(n_words, 0), 0)",
}


def _fence(name: str, keys: str) -> str:
    by = f"{keys}, " if keys else ""
    part = f"partition by {by}rate"
    floors = " ".join(f"when '{r}' then {f}" for r, f in RATES.items())
    return f"""
{name}_m as (select {by}rate, edge, count(*) n from edges group by all),
{name}_r as (select *, sum(n) over ({part}) total, sum(n) over ({part} order by edge) upto from {name}_m),
{name} as (select {by}rate, max(total) total,
  greatest(min(edge) filter (upto * 100 >= total * 50)
    + {SPREADS} * (min(edge) filter (upto * 100 >= total * 75) - min(edge) filter (upto * 100 >= total * 50)),
    case rate {floors} end) fence from {name}_r group by {by}rate)"""


OP5 = f"""
with t as (select row_number() over () rid, doc_id, lang, source, coalesce(text, '') t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '{_SPACE}'), lambda x: x <> '') w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) lines from t),
win as (select rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') s from
  (select rid, w, unnest(range(1, len(w) - {WINDOW - 2})) i from w where len(w) >= {WINDOW})),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, s) c from win) where c > 1),
covered as (select rid, count(distinct i + k) n from twice, (select unnest(range({WINDOW})) k) group by rid),
m as (select w.rid, doc_id, lang, source, len(w)::bigint n_words, len(array_to_string(w, ''))::bigint word_chars,
  len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, len(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint n_upper,
  len(lines)::bigint n_lines, (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines, coalesce(c.n, 0)::bigint n_repeat_words
  from w left join covered c on w.rid = c.rid),
r as (select *, {', '.join(f'{s} {r}' for r, s in _RATE_SQL.items())},
  n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words base_failed from m),
long as (select lang, source, unnest([{', '.join(f"'{r}'" for r in RATES)}]) rate, unnest([{', '.join(RATES)}]) v from r where not base_failed),
edges as (select *, v - v % (1::bigint << greatest(len(bin(v)) - {KEEP_BITS}, 0)::int) edge from long),
{_fence('g', 'lang, source')},{_fence('l', 'lang')},{_fence('a', '')},
above as (select r.rid, bool_or(case x.rate {' '.join(f"when '{q}' then r.{q}" for q in RATES)} end > x.fence) above from r
  join (select g.lang, g.source, g.rate, case when g.total >= {MIN_GROUP} then g.fence when l.total >= {MIN_GROUP} then l.fence else a.fence end fence
    from g join l on g.lang is not distinct from l.lang and g.rate = l.rate join a on a.rate = g.rate) x
  on r.lang is not distinct from x.lang and r.source is not distinct from x.source group by r.rid)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce(above, false) kept from r left join above using (rid)
"""

# CRC-32 of an ASCII text s, bit by bit (the reflected polynomial is a fixed value).
_STEP = "xor(a, b & 255)"
_CRC32 = f"""xor(list_reduce([4294967295::ubigint] || flatten(list_transform(range(length(s)::bigint),
  lambda i: [ascii(s[i + 1]), 0, 0, 0, 0, 0, 0, 0]))::ubigint[],
  lambda a, b: case when {_STEP} & 1 = 1 then xor({_STEP} >> 1, 3988292384::ubigint) else {_STEP} >> 1 end), 4294967295::ubigint)"""


def _deal(name: str, above: str | None, depth: int) -> str:
    """One tree level of the budget: a child is full if filling it, and all that
    need less per weight, costs no more than the budget at that level."""
    parent, level = LEVELS[:depth], LEVELS[depth]
    keys = ", ".join([*parent, level])
    by = ", ".join(parent) or "1"
    weight = " ".join(f"when {level} = '{node}' then {w}" for (lv, node), w in sorted(WEIGHTS.items()) if lv == level)
    match = " and ".join(f"c.{k} is not distinct from u.{k}" for k in parent)
    source = f"join {above} u on {match}" if above else "cross join (select budget from total) u"
    return f"""
{name}_c as (select {keys}, sum(tokens) * {MAX_EPOCHS} capacity, {f"case {weight} else 1 end" if weight else "1"} w from leaf group by all),
{name}_u as (select c.*, u.budget above from {name}_c c {source}),
{name}_o as (select *, coalesce(sum(capacity) over (part order by capacity / w, {level} nulls first
    rows between unbounded preceding and 1 preceding), 0) used,
  sum(w) over (part order by capacity / w, {level} nulls first rows between current row and unbounded following) open
  from {name}_u window part as (partition by {by})),
{name}_f as (select *, capacity * open + used * w <= above * w filled from {name}_o),
{name}_r as (select *, above - coalesce(sum(capacity) filter (filled) over (partition by {by}), 0) rest,
  sum(w) filter (not filled) over (partition by {by}) open_w from {name}_f),
{name} as (select {keys}, case when filled then capacity else least(rest * w // open_w, capacity) end budget from {name}_r)"""


def _passes() -> str:
    """Selections by the budgets g0, g1, ...: after each, what the leaves below
    a parent left over goes to the one whose next document needs least."""
    out = []
    levels = [LEVELS[:depth] for depth in range(len(LEVELS) - 1, -1, -1) for _ in range(PASSES)]
    for k, parent in enumerate([*levels, None]):
        out.append(f"""
s{k} as (select *, sum(tokens) over (partition by domain, lang, source order by place) upto from
  (select d.*, whole, rest, ('0x' || substr(md5('{SEED}|' || whole::varchar || '|' || identity), 1, 15))::bigint place from d
   join (select *, budget // tokens whole, budget % tokens rest from g{k}) p
     on d.domain = p.domain and d.lang is not distinct from p.lang and d.source is not distinct from p.source)),""")
        if parent is None:
            continue
        by = ", ".join(parent) or "1"
        out.append(f"""
r{k} as (select x.domain, x.lang, x.source, g.tokens, whole * g.tokens + part spent, rest - part + extra unspent,
    case when whole < {MAX_EPOCHS} then beyond - part end needs
  from (select domain, lang, source, max(whole) whole, max(rest) rest, coalesce(max(upto) filter (upto <= rest), 0) part,
          min(upto) filter (upto > rest) beyond from s{k} group by all) x
  join g{k} g on g.domain = x.domain and g.lang is not distinct from x.lang and g.source is not distinct from x.source),
p{k} as (select *, sum(unspent) over (partition by {by}) pool from r{k}),
c{k} as (select *, case when needs <= pool then row_number() over (partition by {by}, needs <= pool
    order by needs, domain nulls first, lang nulls first, source nulls first) end = 1 chosen from p{k}),
g{k + 1} as (select domain, lang, source, tokens,
    case when chosen then least(spent + pool, tokens * {MAX_EPOCHS}) else spent end budget,
    case when chosen then greatest(spent + pool - tokens * {MAX_EPOCHS}, 0)
         when bool_or(coalesce(chosen, false)) over (partition by {by}) then 0 else unspent end extra from c{k}),""")
    return "".join(out)


OP6 = f"""
with d as (select doc_id, 'domain' || ({_CRC32} % {DOMAINS})::varchar as domain, lang, source,
  greatest(len(list_filter(regexp_split_to_array(t, '{_SPACE}'), lambda x: x <> '')), 1)::bigint tokens,
  coalesce(doc_id::varchar, '') || '|' || md5(t) identity
  from (select *, coalesce(text, '') t, coalesce(source, '') s from documents)),
leaf as (select domain, lang, source, sum(tokens) tokens from d group by all),
total as (select sum(tokens) * {BUDGET_PERCENT} // 100 budget from leaf),
{_deal('b0', None, 0)},{_deal('b1', 'b0', 1)},{_deal('b2', 'b1', 2)},
g0 as (select l.*, b.budget, 0 extra from leaf l join b2 b
  on l.domain = b.domain and l.lang is not distinct from b.lang and l.source is not distinct from b.source),
{_passes()}
upto as (select * from s{len(LEVELS) * PASSES})
select doc_id, domain, lang, source, tokens, (whole + case when upto <= rest then 1 else 0 end)::int copies
from upto where whole > 0 or upto <= rest
"""

_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_GROUPS = " || ".join(
    f"substr('{_DIGITS}', ((v[{i}] >> {s}) & 31)::int + 1, 1)" for i in range(1, 9) for s in (15, 10, 5, 0))

OP7 = f"""
with p as (select page_id, coalesce(html, '') h from pages),
d as (select *, sha1(h) s, octet_length(encode(h))::bigint payload_bytes, max(page_id) over (partition by h) best from p),
v as (select *, [('0x' || substr(s, 1 + 5 * k, 5))::bigint for k in range(8)] v from d)
select page_id, payload_bytes, {_GROUPS} payload_digest,
  case when page_id = best then 'response' else 'revisit' end record_type,
  case when page_id <> best then best end refers_to from v
"""

OP9 = """
with recursive v as (select vec_id, embedding::double[] e from embeddings
  where embedding is not null and len(embedding) > 0 and list_count(embedding) = len(embedding)),
u as (select vec_id, e, sqrt(list_dot_product(e, e)) n from v where list_dot_product(e, e) > 0 and isfinite(list_dot_product(e, e))),
links as (select a.vec_id a, b.vec_id b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
root as (select a vec_id, min(b) component_id from reach group by a),
deg as (select a vec_id, count(*) n from links group by a)
select vec_id, coalesce(n, 0)::bigint n_links, component_id, vec_id = component_id kept
from root left join deg using (vec_id)
"""

# Lower-cased words of ASCII letters, digits and characters beyond ASCII.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP12 = f"""
with i as (select coalesce(item_id::varchar, '') item, {_FOLDED} w from benchmark),
win as (select distinct item, n, array_to_string(w[k:k + n - 1], ' ') s from
  (select item, w, least(len(w), {GRAM_WINDOW}) n, unnest(range(1, greatest(len(w) - {GRAM_WINDOW - 1}, 1) + 1)) k from i where len(w) > 0)),
d as (select row_number() over () rid, doc_id, {_FOLDED} w from documents),
spots as (select rid, k, n, array_to_string(w[k:k + n - 1], ' ') s from
  (select rid, w, n, unnest(range(1, len(w) - n + 2)) k from d, (select distinct n from win) where len(w) >= n)),
hits as (select rid, k, n, item from spots join win using (n, s)),
covered as (select rid, count(distinct j) n_hit from (select rid, unnest(range(k, k + n)) j from (select distinct rid, k, n from hits)) group by rid),
named as (select rid, count(*) n_items, string_agg(item, ',' order by item) ids from (select distinct rid, item from hits) group by rid)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join covered using (rid) left join named using (rid)
"""

OP13 = f"""
with d as (select row_number() over () rid, doc_id, {_FOLDED} w from documents),
tf as (select rid, doc_id, term, count(*) tf from (select rid, doc_id, unnest(w) term from d) group by all),
g as (select count(*)::bigint n_docs, sum(len(w))::bigint n_terms from d where len(w) > 0),
m as (select rid, 100 - 90 + (90 * len(w)::bigint * n_docs) // n_terms m from d, g where len(w) > 0),
wt as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint wt from tf, g group by term, n_docs),
q as (select distinct item_id, unnest({_FOLDED}) term from benchmark),
s as (select item_id, rid, doc_id, sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score
  from q join wt using (term) join tf using (term) join m using (rid) group by all)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int rank, doc_id, score from s where score > 0
qualify rank <= {TOP}
"""

ORACLES: dict[str, str] = {"op12_winnowing": OP12, "op13_ranked_search": OP13, "op5_quality_rules": OP5, "op6_mix_sources": OP6, "op7_warc_archive": OP7, "op9_embedding_links": OP9}
