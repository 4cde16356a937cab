"""Queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from fathomline.llm import fill_middle, forest, language, lexicon, license_sql, licenses, packing, periodic, simhash, sitetree, suffixes, toxicity, vafile, wavelet

QUERIES: dict[str, Callable] = {
    "op1_main_text": sitetree.op1_main_text,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_language": language.op3_language,
    "language_of_pages": language.language_of_pages,
    "op4_licenses": licenses.op4_licenses,
    "op5_near_duplicates": forest.op5_near_duplicates,
    "op6_word_bpe": lexicon.op6_word_bpe,
    "op7_token_output": wavelet.op7_token_output,
    "token_occurrences": wavelet.token_occurrences_of_end,
    "op8_packing": packing.op8_packing,
    "op9_simhash": simhash.op9_simhash,
    "op10_top_k": vafile.op10_top_k,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_fill_in_middle": fill_middle.op12_fill_in_middle,
    "op13_repeated_passages": suffixes.op13_repeated_passages,
}
#: The other operators train, hash, tokenize or parse; the tests hold them against brute force instead.
ORACLE_SQL: dict[str, str] = {
    "op4_licenses": license_sql.SQL,
    "op5_near_duplicates": """
        WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
        reach(id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.id, l.b FROM reach JOIN l ON l.a = reach.r)
        SELECT id AS vec_id, (SELECT count(*) FROM l WHERE l.a = id) AS n_links, min(r) AS component_id, id = min(r) AS kept FROM reach GROUP BY id""",
    "op10_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS i FROM embeddings WHERE embedding IS NOT NULL),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(range(1, len(q.i) + 1), lambda k: q.i[k] * v.i[k]))::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op12_fill_in_middle": fill_middle.SQL,
}
