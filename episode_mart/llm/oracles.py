"""The same results in SQL over the given tables, where SQL can say them."""

from __future__ import annotations

from episode_mart.llm import chats

_SAYS = "</s>[INST] ok [/INST]"


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in chats.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_MARKS = len(chats.START) + len(chats.SEP) + len(chats.END) + 1

ORACLES = {
    "op5_ngram_jaccard": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select doc_id, unnest(case when len(ws) >= 3 then list_distinct(list_transform(range(1, len(ws) - 1),
      lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id),
links as (
  select a, b from pairs join n na on na.doc_id = a join n nb on nb.doc_id = b
  where 100 * c >= 90 * (na.n + nb.n - c)),
near as (select a, b from links union all select b, a from links),
reach as (
  select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join near l on l.a = r.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(r.b) as component_id
from documents d join reach r on r.a = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id, n.n""",
    "op9_chat_format": f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{_SAYS}' union all select -7, 1, '{chats.LOSS_ROLE}', '{_SAYS}'),
c as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
    coalesce(string_agg(case when role = '{chats.LOSS_ROLE}' then text end, '' order by turn, role, text), '') as learned,
    cast(sum(length({_escaped("role")}) + length({_escaped("text")}) + {_MARKS}) as bigint) as formatted_chars
  from t group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(learned) as loss_chars,
  sha256(learned) as loss_sha256, formatted_chars from c""",
    "op12_hard_negatives": """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda c: floor(256 * c::double)) as x
  from embeddings where label is not null and embedding is not null
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as own, list_inner_product(a.x, b.x)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (
  select anchor_id, id as positive_id, score as positive_score from scored where own
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, positive_id, positive_score, s.id as negative_id, s.score as negative_score,
  row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id)::int as rank
from p join scored s on s.anchor_id = p.anchor_id and not s.own
  and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score
qualify rank <= 5""",
    "op13_url_filter": r"""
with u as (
  select page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages)
select page_id, host, path, r.rule, coalesce(r.verdict, 'allow') as verdict
from u left join (values ('example.net', '/en/', 'example.net/en/', 'allow'), ('net', '/', 'net/', 'block'),
  ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')) r(h, p, rule, verdict)
  on (host = h or suffix(host, '.' || h)) and prefix(path, p)
qualify row_number() over (partition by page_id order by length(r.rule) desc) = 1""",
}
