"""SQL for DuckDB that states the results of the queries of this subpackage."""

from __future__ import annotations

from churnloom.llm.mixing import DIMENSIONS, NULL, TEMPERING, TOPIC_RULES

ROUNDS = 20


def mixing_sql(documents: str = "documents", columns: str = "", rounds: int = ROUNDS) -> str:
    """Raking unrolled into one step for each dimension and round; ``columns`` to return too."""
    rules = " ".join(f"when regexp_matches(coalesce(text, ''), '{p}') then '{n}'" for n, p in TOPIC_RULES)
    steps = [
        f"""marked as materialized (
  select *, coalesce(cast(source as varchar), '{NULL}') as mix_source,
    coalesce(cast(lang as varchar), '{NULL}') as mix_lang,
    case {rules} else 'prose' end as mix_topic,
    cast(greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+'))) as bigint) as mix_tokens
  from {documents}),
cells as materialized (
  select mix_source as source, mix_lang as lang, mix_topic as topic, cast(sum(mix_tokens) as double) as tokens
  from marked group by all)"""
    ]
    for d, power in TEMPERING:
        steps.append(f"""share_{d} as materialized (
  select {d}, p / sum(p) over () as share from
  (select {d}, pow(sum(tokens), {power}) as p from cells group by {d}))""")
        steps.append(f"{d}_0 as materialized (select {d}, 1.0::double as f from share_{d})")
    last = dict.fromkeys(DIMENSIONS, 0)
    for r in range(1, rounds + 1):
        for d in DIMENSIONS:
            a, b = (x for x in DIMENSIONS if x != d)
            steps.append(f"""{d}_{r} as materialized (
  select {d}, any_value(share) / sum(tokens * x.f * y.f) as f from cells
  join share_{d} using ({d}) join {a}_{last[a]} x using ({a}) join {b}_{last[b]} y using ({b}) group by {d})""")
            last[d] = r
    steps.append(f"""weighted as materialized (
  select source, lang, topic, x.f * y.f * z.f * (select sum(tokens) from cells) as w from cells
  join source_{rounds} x using (source) join lang_{rounds} y using (lang) join topic_{rounds} z using (topic))""")
    steps.append("""chances as materialized (
  select source as s, lang as l, topic as t, w, w / max(w) over () as p from weighted)""")
    chosen = columns or "doc_id, mix_source, mix_lang, mix_topic, mix_tokens"
    return f"""with {', '.join(steps)}
select {chosen}, round(w, 6) as weight, round(p, 6) as probability
from marked join chances on mix_source = s and mix_lang = l and mix_topic = t
where cast('0x' || substr(md5(concat_ws('|', coalesce(cast(doc_id as varchar), '{NULL}'), 42)), 1, 12) as bigint)
  / 281474976710656.0 < p"""


MIXING_SQL = mixing_sql()
