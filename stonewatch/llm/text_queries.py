"""Registered queries over documents and pages, with SQL where it can express them."""

from __future__ import annotations


from stonewatch.llm import exact_dedup, html_extract, minhash, mixing, packing, quality, secrets, token_counts, toxicity, url_filter
from stonewatch.llm.common import table
from stonewatch.llm.registry import query

#: The white-space class as DuckDB's regular expressions take it.
SQL_SPACE = r"[\x20\x09-\x0D]+"


@query(
    "op1_exact_dedup",
    rf"""
    WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{SQL_SPACE}', ' ', 'g')) AS text_sha256
               FROM documents),
         g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
    """,
)
def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op2_quality_rules",
    rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t
               FROM documents),
         w AS (SELECT rid, list_filter(regexp_split_to_array(t, '{SQL_SPACE}'), lambda x: x <> '') AS ws FROM d),
         win AS (SELECT rid, i, ws[i:i + 4] AS win FROM (
                   SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
         twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
         rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY rid),
         raw AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
         lines AS (SELECT rid, line, lower(trim(regexp_replace(line, '{SQL_SPACE}', ' ', 'g'))) AS norm,
                          len(list_filter(regexp_split_to_array(line, '{SQL_SPACE}'), lambda x: x <> '')) AS words
                   FROM raw),
         own AS (SELECT rid, count(*) - count(DISTINCT line) AS dups FROM lines WHERE words > 0 GROUP BY rid),
         hosts AS (SELECT host, count(DISTINCT t) AS host_docs FROM d GROUP BY host),
         freq AS (SELECT host, norm FROM lines JOIN d USING (rid) JOIN hosts USING (host) WHERE words > 0
                  GROUP BY host, norm, host_docs
                  HAVING count(DISTINCT t) > 20 AND count(DISTINCT t) * 100 > host_docs * 10),
         gone AS (SELECT rid, sum(words) AS n FROM lines JOIN d USING (rid) JOIN freq USING (host, norm)
                  WHERE words > 0 GROUP BY rid),
         m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
                      CAST(length(regexp_replace(t, '{SQL_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
                      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                      coalesce(own.dups, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
                      CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
               FROM d JOIN w USING (rid) LEFT JOIN own USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid))
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
             AND (n_words - removed_words) * 100 >= n_words * 30 AS kept
    FROM m
    """,
)
def op2_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))


#: Host, path, verdict of the rules.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


@query(
    "op5_url_filter",
    rf"""
    WITH rules(rhost, rpath, rverdict) AS (VALUES {_RULE_ROWS}),
         u AS (SELECT row_number() OVER () AS rid, page_id,
                      CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
               FROM pages),
         p AS (SELECT rid, page_id,
                      translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
                      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
         fits AS (SELECT rid, rhost || rpath AS rule, rverdict,
                         row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC, rhost || rpath DESC) AS k
                  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
    SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict
    FROM p LEFT JOIN (SELECT * FROM fits WHERE k = 1) f USING (rid)
    """,
)
def op5_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


@query("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query("op9_packing")
def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op3_mixing")
def op3_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op8_secret_scan")
def op8_secret_scan(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op10_html_extraction")
def op10_html_extraction(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query(
    "op7_minhash_dedup",
    rf"""
    WITH RECURSIVE
         w AS (SELECT doc_id, list_filter(regexp_split_to_array(
                 translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '{SQL_SPACE}'),
                 lambda x: x <> '') AS ws FROM documents),
         s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN ws ELSE
                 list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh
               FROM w WHERE len(ws) > 0),
         n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
         p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id
               GROUP BY 1, 2),
         e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
               WHERE 100 * c >= 80 * (x.n + y.n - c)),
         ends AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
         r AS (SELECT doc_id AS node, doc_id AS met FROM documents
               UNION SELECT r.node, ends.b FROM r JOIN ends ON ends.a = r.met),
         c AS (SELECT node AS doc_id, min(met) AS component_id FROM r GROUP BY 1)
    SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM documents JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
)
def op7_minhash_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))
