"""The registered queries of these operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import op1_packing, op2_toxicity, op3_secrets, op4_licenses, op5_simhash, op6_embeddings, op7_substrings, op8_language, op9_topk, op10_mixing
from tessera.ship import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict:
    def docs(s, d):
        return _table(s, d, "documents")

    return {
        "op1_packing": lambda s, d: op1_packing.pack(docs(s, d)),
        "op2_toxicity": lambda s, d: op2_toxicity.toxicity(docs(s, d), _table(s, d, "labels")),
        "op3_secrets": lambda s, d: op3_secrets.secrets(docs(s, d)),
        "op4_licenses": lambda s, d: op4_licenses.licenses(docs(s, d)),
        "op5_simhash": lambda s, d: op5_simhash.simhash(docs(s, d)),
        "op6_embeddings": lambda s, d: op6_embeddings.near_vectors(_table(s, d, "embeddings")),
        "op7_substrings": lambda s, d: op7_substrings.dedup(docs(s, d)),
        "op8_language": lambda s, d: op8_language.language(docs(s, d)),
        "op9_topk": lambda s, d: op9_topk.top_k(_table(s, d, "embeddings")),
        "op10_mixing": lambda s, d: op10_mixing.mixed(docs(s, d)),
    }


def _spans(kind: str, order: int) -> str:
    """Rows (doc_id, start, rank, kind, stop) of one rule: matches, and the gaps between them, by position."""
    pattern, least, group = op3_secrets.RULES[kind]
    quoted = pattern.replace("'", "''")
    plain = quoted
    for i, open_ in enumerate(["((?i:", "([A-Za"]) if group else ():
        plain = plain.replace(open_, "(?:(?i:" if i == 0 else "(?:[A-Za")
    measured = f"regexp_extract_all(t, '{quoted}', {group})" if group else "w"
    lists = f"select doc_id, regexp_extract_all(t, '({plain})', 1) as w, regexp_split_to_array(t, '{plain}') as g, t from texts where regexp_matches(t, '{plain}')"
    at = "(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0))::BIGINT"
    return f"""select doc_id, start, {order} as rank, '{kind}' as kind, start + n as stop from (
      select doc_id, {at} as start, length(w[i]) as n, length(q[i]) as m
      from (select doc_id, w, g, {measured} as q, unnest(range(1, len(w) + 1)) as i from ({lists}))) where m >= {least}"""


def _secrets_sql() -> str:
    parts = " union all ".join(_spans(k, i) for i, k in enumerate(op3_secrets.RULES))
    line = "string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank)"
    base = "filter (where rank < 3)"
    counts = ", ".join(f"coalesce(count(*) filter (where kind = '{k}'), 0) as n_{k}" for k in op3_secrets.BASE)
    return f"""with texts as (select doc_id, coalesce(text, '') as t from documents), spans as ({parts}),
    found as (select doc_id, {counts}, coalesce({line} {base}, '') as base, coalesce({line}, '') as spans from spans group by doc_id)
    select d.doc_id, coalesce(n_assign, 0)::BIGINT as n_assign, coalesce(n_access, 0)::BIGINT as n_access, coalesce(n_hex, 0)::BIGINT as n_hex,
      sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from documents d left join found using (doc_id)"""


def _licenses_sql() -> str:
    t = op4_licenses.THRESHOLD
    rows = ", ".join(f"('{k}', {len(op4_licenses.words_of(v)) - 1}, [{', '.join(chr(39) + g + chr(39) for g in op4_licenses.bigrams_of(v))}])" for k, v in op4_licenses.TEMPLATES.items())
    normal = r"trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'))"
    return f"""with templates(name, l, own) as (values {rows}),
    listed as (select name, unnest(own) as g from templates),
    words as (select row_number() over () as r, doc_id, string_split({normal}, ' ') as w from documents),
    grams as (select r, doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]) as gs from words),
    each as (select r, unnest(gs) as g, unnest(range(1, len(gs) + 1)) as i from grams),
    hits as (select r, name, i, g from each join listed using (g)),
    held as (select r, name from hits join templates using (name) group by r, name, len(own) having count(distinct g) >= {t} / (2 - {t}) * len(own)),
    windows as (select h.r, h.name, h.i, list_distinct(gs[h.i:h.i+l-1]) as w, own from hits h join held using (r, name) join templates using (name) join grams using (r)),
    scores as (select r, name, i, 2.0::DOUBLE * len(list_intersect(w, own)) / (len(w) + len(own)) as dice from windows),
    best as (select r, arg_min(name, (-dice, name, i)) as name, max(dice) as dice, arg_min(i, (-dice, name, i)) as i, count(distinct split_part(name, ':', 1)) as n from scores where dice >= {t} group by r)
    select doc_id, split_part(name, ':', 1) as license, coalesce(round(dice, 6), 0.0)::DOUBLE as dice, coalesce(i - 1, -1)::BIGINT as start_word, coalesce(n, 0)::BIGINT as n_licenses from grams left join best using (r)"""


EMBEDDINGS_SQL = f"""with recursive v as (select vec_id, label, embedding::DOUBLE[] as e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) as n from embeddings
    where embedding is not null and label is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
  l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and a.n > 0 and b.n > 0
    where list_inner_product(a.e, b.e) / (a.n * b.n) >= {op6_embeddings.THRESHOLD}),
  reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join l on r.b = l.a),
  c as (select a as vec_id, min(b) as component_id from reach group by a),
  n as (select a as vec_id, count(*) as n_links from l group by a)
  select c.vec_id, coalesce(n_links, 0)::BIGINT as n_links, component_id, c.vec_id = component_id as kept from c left join n using (vec_id)"""

SUBSTRINGS_SQL = r"""with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
  s as (select doc_id, w, unnest(range(1, len(w) - 48)) as i from w where len(w) >= 50),
  g as (select doc_id, i, array_to_string(w[i:i+49], ' ') as g from s),
  f as (select g, min(doc_id) as first from g group by g having count(distinct doc_id) > 1),
  hit as (select distinct doc_id, i from g join f using (g) where first < doc_id),
  gone as (select distinct doc_id, k from (select doc_id, unnest(range(i, i + 50)) as k from hit)),
  lost as (select doc_id, list(k) as ks from gone group by doc_id)
  select w.doc_id, len(w)::BIGINT as n_words, coalesce(len(ks), 0)::BIGINT as n_removed,
    sha256(array_to_string(case when ks is null then w else list_filter(w, lambda x, i: not list_contains(ks, i)) end, ' ')) as kept_sha256
  from w left join lost using (doc_id)"""

TOPK_SQL = """with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) as e from embeddings
    where embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
  s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
  r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::INTEGER as rank from s)
  select query_id, rank, vec_id, score from r where rank <= 20"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_secrets": _secrets_sql(),
        "op4_licenses": _licenses_sql(),
        "op6_embeddings": EMBEDDINGS_SQL,
        "op7_substrings": SUBSTRINGS_SQL,
        "op9_topk": TOPK_SQL,
    }
