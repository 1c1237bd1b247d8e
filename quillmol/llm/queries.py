"""One query for each operator, with production parameters on whole tables, and SQL where it can say the same."""

from __future__ import annotations

from quillmol.llm import chat, html, langid, media, mixing, ngram_join, packing, pii, quality, sharding


def _read(spark, sf_dir: str, table: str):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_preference_pairs(spark, sf_dir):
    return chat.preference_pairs(chat.neighbour_pairs(_read(spark, sf_dir, "conversations")))


def op2_vector_best_fit(spark, sf_dir):
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op3_block_mixture(spark, sf_dir):
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_rendezvous(spark, sf_dir):
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op5_token_combinations(spark, sf_dir):
    return ngram_join.jaccard_classes(_read(spark, sf_dir, "documents"))


def op6_avi_media(spark, sf_dir):
    return media.media_digest(_read(spark, sf_dir, "documents"))


def op7_boosted_nodes(spark, sf_dir):
    return html.main_text(_read(spark, sf_dir, "pages"))


def op8_candidate_boosting(spark, sf_dir):
    return pii.find_private(_read(spark, sf_dir, "documents"))


def op9_rule_ledger(spark, sf_dir):
    out = quality.quality(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_hyperdimensional(spark, sf_dir):
    return langid.identify(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_preference_pairs, op2_vector_best_fit, op3_block_mixture, op4_rendezvous, op5_token_combinations, op6_avi_media, op7_boosted_nodes, op8_candidate_boosting, op9_rule_ledger, op10_hyperdimensional)}

ORACLE_SQL = {
    "op1_preference_pairs": """
with t as (select conv_id // 2 as pair_id, (conv_id % 2)::int as side, coalesce(role, '') as role, coalesce(text, '') as body,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i from conversations where conv_id is not null),
sizes as (select pair_id, count(*) filter (side = 0) as n0, count(*) filter (side = 1) as n1 from t group by 1),
diff as (select a.pair_id, min(a.i) as i from t a join t b on a.pair_id = b.pair_id and a.i = b.i and a.side = 0 and b.side = 1
    where a.role <> b.role or a.body <> b.body group by 1),
k as (select s.pair_id, n0, n1, coalesce(d.i - 1, least(n0, n1)) as k from sizes s left join diff d on s.pair_id = d.pair_id),
r as (select t.pair_id, side, i, k, '<|' || role || '|>' || chr(10) || body || '<|end|>' || chr(10) as shown,
    case when role = 'assistant' then '0:' || (length(role) + 5) || ',1:' || (length(body) + 8) else '0:' || (length(role) + 5 + length(body) + 8) end as runs
    from t join k on t.pair_id = k.pair_id)
select k.pair_id, k.k as n_prompt_turns, n0 - k.k as n_chosen_turns, n1 - k.k as n_rejected_turns,
    coalesce(string_agg(shown, '' order by i) filter (side = 0 and i <= r.k), '') as prompt,
    coalesce(string_agg(shown, '' order by i) filter (side = 0 and i > r.k), '') as chosen,
    coalesce(string_agg(shown, '' order by i) filter (side = 1 and i > r.k), '') as rejected,
    coalesce(string_agg(runs, ',' order by i) filter (side = 0 and i > r.k), '') as chosen_mask,
    coalesce(string_agg(runs, ',' order by i) filter (side = 1 and i > r.k), '') as rejected_mask
from k join r on k.pair_id = r.pair_id group by all""",
    "op9_rule_ledger": r"""
with d as (select doc_id, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as win from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d)),
twice as (select doc_id, unnest(range(i, i + 8)) as p from (select doc_id, i, count(*) over (partition by doc_id, win) as n from g) where n > 1),
rep as (select doc_id, count(distinct p) as n_repeat_words from twice group by 1),
lines as (select doc_id, unnest(string_split(body, chr(10))) as line from d),
dup as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
m as (select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_lines, 0) as n_lines, coalesce(n_repeat_words, 0) as n_repeat_words
    from d left join dup on d.doc_id = dup.doc_id left join rep on d.doc_id = rep.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or 100 * n_symbols > 20 * word_chars or (n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines)
    or (n_words >= 20 and (word_chars < 2 * n_words or word_chars > 20 * n_words))) as kept from m""",
}
