"""The queries of this package, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import pipeline
from .decontaminate import OP2_SQL, op2_decontaminate
from .embedding_dedup import op8_embeddings
from .html_text import op5_html
from .katz import op1_katz
from .ngram_join import op7_jaccard
from .packing import op3_packing
from .quality import op4_quality
from .quotes import op10_quotes
from .substring_dedup import op9_substrings
from .warc import op6_warc

Query = Callable[[SparkSession, str], DataFrame]

OP6_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, url, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to, url
FROM f
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = """
     r AS (SELECT id, id AS c FROM n UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.c),
     k AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
"""
OP7_SQL = f"""
WITH RECURSIVE
     w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS t FROM documents),
     g AS (SELECT doc_id, CASE WHEN len(t) >= 4 THEN list_distinct(list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' '))) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END AS s FROM w),
     n AS (SELECT doc_id AS id, len(s) AS z FROM g),
     e AS (SELECT doc_id AS id, unnest(s) AS x FROM g),
     h AS (SELECT x, count(*) AS c FROM e GROUP BY x HAVING count(*) > 1),
     f AS (SELECT id, x FROM e JOIN h USING (x)),
     p AS (SELECT u.id AS a, v.id AS b, count(*) AS c FROM f u JOIN f v ON u.x = v.x AND u.id <> v.id GROUP BY ALL),
     l AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * c >= 85 * (x.z + y.z - c)),
     {_REACH}
SELECT n.id AS doc_id, z AS n_shingles, component_id FROM n JOIN k USING (id)
"""
OP8_SQL = f"""
WITH RECURSIVE
     n AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
     l AS (SELECT x.id AS a, y.id AS b FROM n x JOIN n y ON x.id <> y.id WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
     {_REACH}
SELECT n.id AS vec_id, (SELECT count(*) FROM l WHERE l.a = n.id) AS n_links, component_id, n.id = component_id AS kept FROM n JOIN k USING (id)
"""


def queries() -> dict[str, Query]:
    return {
        "op1_katz": op1_katz,
        "op2_decontaminate": op2_decontaminate,
        "op3_packing": op3_packing,
        "op4_quality": op4_quality,
        "op5_html": op5_html,
        "op6_warc": op6_warc,
        "op7_jaccard": op7_jaccard,
        "op8_embeddings": op8_embeddings,
        "op9_substrings": op9_substrings,
        "op10_quotes": op10_quotes,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2_SQL, "op6_warc": OP6_SQL, "op7_jaccard": OP7_SQL, "op8_embeddings": OP8_SQL}
