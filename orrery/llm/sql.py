"""DuckDB SQL for the queries that SQL can express."""

DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + 7], ' ') AS win, least(len(w), 8) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS s FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes)
), m AS (SELECT DISTINCT doc_id, s, dw.n, dw.win, item_id FROM dw JOIN iw USING (win)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

URL_FILTER = r"""
WITH RECURSIVE u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), x AS (
  SELECT *, array_to_string(list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
           lambda s: CASE WHEN regexp_full_match(s, '[0-9]+(\.[a-z]{2,5})?') OR regexp_full_match(s, '[0-9a-fA-F]{8,}')
                          THEN '*' || regexp_extract(s, '(\.[a-z]{2,5})?$', 1) ELSE s END), '/') AS lex,
         CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM h
), p AS (
  SELECT page_id, host, path, lex, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said FROM x
), r(host, lex, bad, lab, tpl, k, done) AS (
  SELECT host, lex, count(*) FILTER (said = 'block'), count(said), '', 0, false FROM p GROUP BY host, lex
  UNION ALL (
    WITH n AS (
      SELECT host, lex, bad, lab, tpl, k, CASE WHEN lex = '' THEN [] ELSE string_split(lex, '/') END AS seg,
             sum(bad) OVER w AS nb, sum(lab) OVER w AS nl, count(*) OVER w AS nr
      FROM r WHERE NOT done WINDOW w AS (PARTITION BY host, tpl)
    ), o AS (SELECT *, nb > 0 AND nb < nl AND nr > 1 AND len(seg) > k AS cuts FROM n),
    c AS (SELECT host, tpl, seg[k + 1] AS child, sum(bad) AS b, sum(lab) AS l FROM o WHERE cuts GROUP BY ALL),
    a AS (
      SELECT host, tpl, b, l, m, CASE WHEN l > 0 AND (coalesce(l0, 0) = 0 OR abs(b / l - b0 / l0) > 2.0::DOUBLE * sqrt((b + b0) / (l + l0) * (1 - (b + b0) / (l + l0)) * (1.0::DOUBLE / l + 1.0::DOUBLE / l0))) THEN 1 ELSE 0 END AS parts
      FROM (SELECT *, lag(b) OVER v AS b0, lag(l) OVER v AS l0 FROM (SELECT host, tpl, b, l, count(*) AS m FROM c GROUP BY ALL)
            WINDOW v AS (PARTITION BY host, tpl ORDER BY l > 0, CASE WHEN l > 0 THEN b / l END NULLS FIRST, l))
    ), g AS (
      SELECT host, tpl, b, l, grp, sum(m) OVER (PARTITION BY host, tpl, grp) AS members
      FROM (SELECT *, CAST(sum(parts) OVER (PARTITION BY host, tpl ORDER BY l > 0, CASE WHEN l > 0 THEN b / l END NULLS FIRST, l ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM a)
    ), t AS (SELECT c.host, c.tpl, child, CASE WHEN members = 1 THEN child ELSE '{' || grp || '}' END AS name FROM c JOIN g ON c.host = g.host AND c.tpl = g.tpl AND c.b = g.b AND c.l = g.l)
    SELECT host, lex, bad, lab, CASE WHEN len(seg) <= k THEN tpl WHEN nb > 0 AND nb < nl THEN tpl || '/' || array_to_string(seg[k + 1:], '/') ELSE tpl || '/**' END, k, true FROM o WHERE NOT cuts
    UNION ALL
    SELECT o.host, lex, bad, lab, o.tpl || '/' || name, k + 1, false FROM o JOIN t ON o.host = t.host AND o.tpl = t.tpl AND seg[k + 1] = child WHERE cuts
  )
), e AS (SELECT * FROM r WHERE done),
share AS (SELECT coalesce(sum(bad) / nullif(sum(lab), 0), 0) AS share FROM e),
hp AS (SELECT host, (sum(bad) + 4.0 * (SELECT share FROM share)) / (sum(lab) + 4.0) AS hp FROM e GROUP BY host),
tp AS (SELECT host, tpl, sum(bad) AS tb, sum(lab) AS tl FROM e GROUP BY ALL),
j AS (SELECT host, tpl, (tb + 4.0 * hp) / (tl + 4.0) AS purity FROM tp JOIN hp USING (host))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       host || tpl AS template, round(CAST(purity AS DOUBLE), 9) AS purity
FROM p JOIN e USING (host, lex) JOIN j USING (host, tpl)
"""
