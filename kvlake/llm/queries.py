"""The training-data queries: one opN_<name> for each operator, over its whole table."""

from kvlake.llm.bpe import op2_bpe
from kvlake.llm.embedding_dedup import op9_embedding_dedup
from kvlake.llm.html_text import op5_html_text
from kvlake.llm.jaccard_join import op8_jaccard_join
from kvlake.llm.language import op4_language
from kvlake.llm.packing import op10_packing
from kvlake.llm.pii import op6_pii
from kvlake.llm.quality import op3_quality
from kvlake.llm.sharding import op1_sharding
from kvlake.llm.winnowing import op7_fingerprints

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_bpe": op2_bpe,
    "op3_quality": op3_quality,
    "op4_language": op4_language,
    "op5_html_text": op5_html_text,
    "op6_pii": op6_pii,
    "op7_fingerprints": op7_fingerprints,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_packing": op10_packing,
}

_REACH = """reach(id, root) AS (SELECT id, id FROM nodes UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.root)"""

#: The joins, word for word; the other operators can't be said in SQL, and tests hold them against brute force instead.
ORACLE_SQL: dict[str, str] = {
    "op8_jaccard_join": r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
 sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
 shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * same >= 90 * (x.n + y.n - same)),
 nodes AS (SELECT doc_id AS id FROM documents), """
    + _REACH
    + """ SELECT id AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id FROM reach LEFT JOIN sizes ON doc_id = id GROUP BY id""",
    "op9_embedding_dedup": """WITH RECURSIVE vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.95),
 degrees AS (SELECT a, count(*) AS n FROM links GROUP BY 1), nodes AS (SELECT vec_id AS id FROM embeddings), """
    + _REACH
    + """ SELECT id AS vec_id, coalesce(any_value(n), 0) AS n_links, min(root) AS component_id, id = min(root) AS kept FROM reach LEFT JOIN degrees ON a = id GROUP BY id""",
}
