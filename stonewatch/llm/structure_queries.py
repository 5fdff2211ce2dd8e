"""Registered queries over whole texts, conversations and the dataset as a tree."""

from __future__ import annotations

from stonewatch.llm import conversation_repair, merkle, repeats
from stonewatch.llm.common import table
from stonewatch.llm.registry import query

#: CRC-32 of a text's bytes (ASCII), bit by bit.
_CRC = """
    list_reduce([4294967295] || list_transform(range(1, len({0}) + 1), lambda i: CAST(ascii({0}[i]) AS BIGINT)),
      lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))
"""


@query(
    "op12_merkle_manifest",
    f"""
    WITH RECURSIVE
         e AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, '') AS tree,
                      coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
                        || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                        || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text,
                      CASE WHEN xor({_CRC.format("CAST(doc_id AS VARCHAR)")}, 4294967295) % 2 = 0
                           THEN replace(text, chr(10), '') ELSE text END AS forged
               FROM documents),
         leaf AS (SELECT rid, doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
                         sha256(head || coalesce(strlen(forged) || ':' || forged, '-')) AS claim FROM e),
         place AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i,
                          count(*) OVER (PARTITION BY tree) AS n FROM leaf),
         low AS (SELECT 0 AS l, tree, i, n, h FROM place
                 UNION ALL
                 SELECT l + 1, tree, i // 3, (min(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM low
                 WHERE n > 1 GROUP BY l, tree, i // 3),
         sub AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
         up AS (SELECT 0 AS l, i, n, h FROM sub
                UNION ALL
                SELECT l + 1, i // 3, (min(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM up
                WHERE n > 1 GROUP BY l, i // 3),
         walk AS (SELECT rid, tree, 0 AS l, i, n, claim AS node, '' AS met FROM place
                  UNION ALL
                  SELECT w.rid, w.tree, w.l + 1, w.i // 3, (min(w.n) + 2) // 3,
                         sha256(string_agg(CASE WHEN x.i = w.i THEN w.node ELSE x.h END, '' ORDER BY x.i)),
                         w.met || coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i <> w.i), '')
                  FROM walk w JOIN low x ON x.l = w.l AND x.tree = w.tree AND x.i // 3 = w.i // 3
                  WHERE w.n > 1 GROUP BY w.rid, w.tree, w.l, w.i, w.met),
         climb AS (SELECT w.rid, 0 AS l, s.i, s.n, w.node, w.met FROM walk w JOIN sub s USING (tree) WHERE w.n = 1
                   UNION ALL
                   SELECT w.rid, w.l + 1, w.i // 3, (min(w.n) + 2) // 3,
                          sha256(string_agg(CASE WHEN x.i = w.i THEN w.node ELSE x.h END, '' ORDER BY x.i)),
                          w.met || coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i <> w.i), '')
                   FROM climb w JOIN up x ON x.l = w.l AND x.i // 3 = w.i // 3
                   WHERE w.n > 1 GROUP BY w.rid, w.l, w.i, w.met),
         top AS (SELECT h FROM up WHERE n = 1)
    SELECT p.doc_id, p.h AS leaf, s.h AS subroot, top.h AS root, sha256(c.met) AS proof_sha256,
           c.node AS folded_root, c.node = top.h AS verified
    FROM place p JOIN sub s USING (tree) JOIN climb c ON c.rid = p.rid AND c.n = 1 CROSS JOIN top
    """,
)
def op12_merkle_manifest(spark, sf_dir):
    return merkle.verified_manifest(table(spark, sf_dir, "documents"))


@query(
    "op13_repeated_passages",
    """
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
         part AS (SELECT rid, low, substr(h, 2 * low + 1, 1310) AS h
                  FROM (SELECT rid, h, unnest(range(0, len(h) // 2 - 399, 256)) AS low FROM d WHERE len(h) >= 800)),
         w AS (SELECT rid, low + p AS p, md5(substr(h, 2 * p + 1, 800)) AS name
               FROM (SELECT rid, low, h, unnest(range(0, least(256, len(h) // 2 - 399))) AS p FROM part)),
         twice AS (SELECT name FROM w GROUP BY name HAVING count(*) > 1),
         hit AS (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS before FROM w JOIN twice USING (name)),
         run AS (SELECT rid, p, sum(CASE WHEN before IS NULL OR p > before + 400 THEN 1 ELSE 0 END)
                                  OVER (PARTITION BY rid ORDER BY p) AS k FROM hit),
         span AS (SELECT rid, k, min(p) AS a, max(p) + 400 AS b FROM run GROUP BY rid, k),
         rest AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS from_, h
                  FROM span JOIN d USING (rid)),
         kept AS (SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed,
                         string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a)
                           || substr(any_value(h), 2 * max(b) + 1) AS h FROM rest GROUP BY rid)
    SELECT doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
           coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
    FROM d LEFT JOIN kept USING (rid)
    """,
)
def op13_repeated_passages(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@query("op11_conversation_repair")
def op11_conversation_repair(spark, sf_dir):
    return conversation_repair.repair_digests(conversation_repair.damaged(table(spark, sf_dir, "conversations")))
