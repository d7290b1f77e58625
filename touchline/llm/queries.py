"""The corpus operators as queries over whole tables, and their SQL where DuckDB can express it."""

from __future__ import annotations

from touchline.llm.chat import op1_chat
from touchline.llm.fingerprints import op3_fingerprints
from touchline.llm.langid import op6_language_id
from touchline.llm.mixing import op7_mixing
from touchline.llm.packing import op5_packing
from touchline.llm.pages import op4_html
from touchline.llm.simhash import op10_simhash
from touchline.llm.suffixes import op2_suffix_array
from touchline.llm.toxicity import op8_toxicity
from touchline.llm.vectors import op9_embeddings

QUERIES = {
    "op1_chat": op1_chat,
    "op2_suffix_array": op2_suffix_array,
    "op3_fingerprints": op3_fingerprints,
    "op4_html": op4_html,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_embeddings": op9_embeddings,
    "op10_simhash": op10_simhash,
}

ORACLE_SQL = {
    "op9_embeddings": """
        WITH RECURSIVE good AS (
            SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
              AND len([x for x in embedding if x <> 0]) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.9
        ), reach(a, b) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
        )
        SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, min(r.b) AS component_id,
               e.vec_id = min(r.b) AS kept
        FROM embeddings e JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id
    """,
}
