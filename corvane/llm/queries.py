"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from .chat_format import chat_query
from .common import table
from .embedding_dedup import near_duplicates
from .exact_dedup import exact_dedup
from .line_dedup import line_query
from .mixing import mix_query
from .ngram_join import ngram_jaccard_join
from .packing import pack_query
from .secret_scan import secret_query
from .sharding import shard_query
from .toxicity import toxicity_query


def queries() -> dict:
    docs = lambda s, d: table(s, d, "documents")
    return {
        "op1_itq_embedding_dedup": lambda s, d: near_duplicates(table(s, d, "embeddings")),
        "op2_counterfactual_toxicity": lambda s, d: toxicity_query(docs(s, d), table(s, d, "labels")),
        "op3_patricia_exact_dedup": lambda s, d: exact_dedup(docs(s, d)),
        "op4_mincost_flow_mixing": lambda s, d: mix_query(docs(s, d)),
        "op5_minhash_line_dedup": lambda s, d: line_query(docs(s, d)),
        "op6_parity_sketch_join": lambda s, d: ngram_jaccard_join(docs(s, d)),
        "op7_grammar_chat_format": lambda s, d: chat_query(table(s, d, "conversations")),
        "op8_ownership_secret_scan": lambda s, d: secret_query(docs(s, d)),
        "op9_karmarkar_karp_packing": lambda s, d: pack_query(docs(s, d)),
        "op10_feistel_sharding": lambda s, d: shard_query(docs(s, d)),
    }


_OP3 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body, length(coalesce(text, '')) AS points FROM documents),
g AS (SELECT body, arg_min(doc_id, (-points, doc_id)) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.body) AS text_sha256
FROM n JOIN g ON n.body = g.body
"""

_OP7 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|'))) AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Least ids reachable over links: labels spread until nothing changes.
_REACH = """
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT id, id FROM nodes),
reach(id, other) AS (SELECT a, b FROM e UNION SELECT r.id, e.b FROM reach r JOIN e ON r.other = e.a),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
"""

_OP6 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT i.a, i.b FROM i JOIN n p ON p.doc_id = i.a JOIN n q ON q.doc_id = i.b WHERE 100 * k >= 75 * (p.n + q.n - k)),
nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN comp c ON c.id = d.doc_id
"""

_OP1 = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH},
k AS (SELECT a AS id, count(*) AS n FROM (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) GROUP BY a)
SELECT v.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v LEFT JOIN k ON k.id = v.vec_id JOIN comp c ON c.id = v.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_itq_embedding_dedup": _OP1, "op3_patricia_exact_dedup": _OP3, "op6_parity_sketch_join": _OP6, "op7_grammar_chat_format": _OP7}
