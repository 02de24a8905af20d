"""DuckDB SQL for those training-data queries that SQL can express."""

from __future__ import annotations

from waymark.llm import line_dedup, url_filter

_LOWER = f"translate(%s, '{url_filter.UPPER}', '{url_filter.LOWER}')"


def _host(url: str) -> str:
    return _LOWER % f"regexp_extract({_rest(url)}, '^[^/?#]*', 0)"


def _path(url: str) -> str:
    return f"regexp_extract({_rest(url)}, '^[^/?#]*([^?#]*)', 1)"


def _rest(url: str) -> str:
    return f"(CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END)"


def op4_url_filter(pages: str = "pages") -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)
    mass, damping = url_filter.MASS, url_filter.DAMPING
    rounds = "".join(
        f""",
r{k} AS MATERIALIZED (SELECT kind, host, sum(rank)::BIGINT AS rank FROM (
  SELECT kind, host, rank // 100 * {100 - damping} AS rank FROM r0
  UNION ALL SELECT w.kind, w.dst, rank // 100 * {damping} // degree FROM ways w JOIN r{k - 1} r ON w.kind = r.kind AND w.src = r.host)
  GROUP BY kind, host)"""
        for k in range(1, url_filter.ROUNDS + 1)
    )
    link = r"""(?i)href\s*=\s*["'']?\s*([a-z][a-z0-9+.-]*://[^/?#"''\s>]+)"""
    return f"""
WITH rules(v, h, p) AS (VALUES {rules}),
p AS (SELECT page_id, {_host("url")} AS host, {_path("url")} AS path, html FROM {pages}),
fit AS (SELECT page_id, v, h || p AS rule,
    row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, v DESC, h, p) AS n
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p)),
ruled AS MATERIALIZED (SELECT p.page_id, host, path, rule, v FROM p LEFT JOIN fit ON p.page_id = fit.page_id AND n = 1),
found AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS url FROM p),
links AS (SELECT DISTINCT src, {_host("url")} AS dst FROM found),
hosts AS (SELECT DISTINCT host FROM (SELECT host FROM p UNION ALL SELECT dst FROM links) WHERE host <> ''),
labels AS (SELECT host, string_split(host, '.') AS l FROM hosts),
cut AS (SELECT host, l, unnest(range(2, len(l) - {url_filter.LEAST_LABELS} + 2)) AS k FROM labels),
above AS (SELECT host, k, array_to_string(l[k:], '.') AS high FROM cut),
ties AS (SELECT host AS low, arg_min(high, k) AS high FROM above WHERE high IN (SELECT host FROM hosts) GROUP BY host),
edges AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM links UNION ALL SELECT low, high FROM ties UNION ALL SELECT high, low FROM ties)
  WHERE src <> '' AND dst <> '' AND src <> dst),
both_ways AS (SELECT 'trust' AS kind, src, dst FROM edges UNION ALL SELECT 'distrust', dst, src FROM edges),
ways AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY kind, src) AS degree FROM both_ways),
shares AS (SELECT host, count(*) AS n, 1000 * count(*) FILTER (v = 'allow') AS a, 1000 * count(*) FILTER (v = 'block') AS b
  FROM ruled WHERE host <> '' GROUP BY host),
seeded AS (SELECT * FROM (SELECT 'trust' AS kind, host, a // n AS weight FROM shares UNION ALL SELECT 'distrust', host, b // n FROM shares)
  WHERE weight > 0),
r0 AS MATERIALIZED (SELECT kind, host, (weight * ({mass} // sum(weight) OVER (PARTITION BY kind)))::BIGINT AS rank FROM seeded){rounds},
ranks AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0)::BIGINT AS trust,
  coalesce(sum(rank) FILTER (kind = 'distrust'), 0)::BIGINT AS distrust FROM r{url_filter.ROUNDS} GROUP BY host)
SELECT page_id, ruled.host, path, rule,
  coalesce(v, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM ruled LEFT JOIN ranks ON ruled.host = ranks.host"""


#: Pages of a few hosts that link to each other, some along a chain; hosts above and below each other.
LINK_PAGES = """(SELECT c_custkey AS page_id, concat('http://', CASE WHEN c_custkey % 3 = 0 THEN 'sub.' ELSE '' END, 'h', c_custkey % 53, '.', CASE c_custkey % 4 WHEN 0 THEN 'com' WHEN 1 THEN 'net' ELSE 'io' END,
    CASE WHEN c_custkey % 5 = 0 THEN '/en/' ELSE '/de/' END, c_custkey) AS url,
  concat('<a href="http://h', (c_custkey * 7) % 61, '.io/x">a</a> <A HREF = ''HTTPS://H', (c_custkey % 53) + 1, '.IO''><a href=/local>', CASE WHEN c_custkey % 6 = 0 THEN '<a href="http://sub.h3.com?q">' ELSE '' END) AS html
  FROM customer)"""


def op6_decontaminate() -> str:
    words = f"regexp_extract_all({_LOWER % 'text'}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH items AS (SELECT item_id::VARCHAR AS item, {words} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
docs AS (SELECT doc_id, coalesce({words}, []) AS w FROM documents),
sized AS (SELECT item, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
spots AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM sized))),
found AS (SELECT doc_id, item, n, i FROM spots JOIN windows USING (n, gram)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


def op10_line_dedup() -> str:
    d = line_dedup
    return f"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i, len(l) AS n FROM split),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h, len(regexp_extract_all(line, '{d.WORD}')) AS w FROM lines),
ends AS (SELECT *, i = n - 1 OR (h + {d.FACTOR} * coalesce(lag(h) OVER s, 0)) % {d.DIVISOR} = 0 AS is_end
  FROM hashed WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT *, coalesce(sum(is_end::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
  FROM ends),
chunks AS (SELECT doc_id, min(i) AS i, max(i) + 1 AS j FROM numbered GROUP BY doc_id, k HAVING count(*) >= {d.MIN_LINES}),
sums AS (SELECT doc_id, i, w, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM hashed),
least AS (
  SELECT a.doc_id, a.i, min(b.i) + 1 AS j FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.upto > a.upto - a.w + {d.WORDS} WHERE a.w > 0 GROUP BY ALL
  UNION SELECT b.doc_id, max(a.i) AS i, b.i + 1 AS j FROM sums b JOIN sums a ON a.doc_id = b.doc_id AND a.w > 0 AND b.upto > a.upto - a.w + {d.WORDS}
    AND a.i <= b.i WHERE b.w > 0 GROUP BY b.doc_id, b.i),
spans AS (SELECT doc_id, i, j, array_to_string(l[i + 1:j], chr(10)) AS passage
  FROM (SELECT * FROM chunks UNION SELECT * FROM least) JOIN split USING (doc_id)),
firsts AS (SELECT passage, min((doc_id, i)) AS first FROM spans GROUP BY passage HAVING count(*) > 1),
gone AS (SELECT doc_id, i, j FROM spans JOIN firsts USING (passage) WHERE (doc_id, i) <> first),
lost AS (SELECT DISTINCT doc_id, unnest(range(i, j)) AS i FROM gone),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS lines FROM lines ANTI JOIN lost USING (doc_id, i) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS passages FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
  coalesce(len(s.l), 0)::BIGINT AS lines_before, coalesce(k.lines, 0) AS lines_after, coalesce(r.passages, 0) AS passages_removed
FROM documents d LEFT JOIN split s USING (doc_id) LEFT JOIN kept k USING (doc_id) LEFT JOIN removed r USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_url_filter": op4_url_filter(),
        "url_filter_of_links": op4_url_filter(LINK_PAGES),
        "op6_decontaminate": op6_decontaminate(),
        "op10_line_dedup": op10_line_dedup(),
    }
