"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .secret_index import BASE, RULES
from .url_equiv import RULES as URL_RULES


def _spans(k: int, pattern: str, group: int, least: int) -> str:
    whole = f"'(?s)(.*?)({pattern})'".replace("[\"']", "[\"'']").replace("\\x20", " ")
    value = "m" if group == 0 else "v"
    return f"""s{k} AS (SELECT rid, list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'s': (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT, 'k': {k}, 'n': length(m[i])::BIGINT, 'v': length({value}[i])::BIGINT}}), lambda z: z.v >= {least}) AS x
 FROM (SELECT rid, regexp_extract_all(t, {whole}, 1) AS g, regexp_extract_all(t, {whole}, 2) AS m, regexp_extract_all(t, {whole}, {2 + group}) AS v FROM d))"""


def _op5() -> str:
    parts = ",\n".join(_spans(k, r.pattern, *r.length) for k, r in enumerate(RULES))
    names = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    text = f"lambda z: {names}[z.k + 1] || ':' || z.s || ':' || (z.s + z.n)"
    joins = " ".join(f"JOIN s{k} USING (rid)" for k in range(len(RULES)))
    every = lambda n: "list_sort(" + "flatten([" + ", ".join(f"s{k}.x" for k in range(n)) + "]))"
    counts = ", ".join(f"len(s{k}.x)::BIGINT AS n_{r.kind}" for k, r in enumerate(BASE))
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{parts}
SELECT doc_id, {counts}, sha256(array_to_string(list_transform({every(len(BASE))}, {text}), ',')) AS base_sha256, array_to_string(list_transform({every(len(RULES))}, {text}), ',') AS spans FROM d {joins}"""


def _op9() -> str:
    ordered = sorted(URL_RULES, key=lambda r: -len(r[0]) - len(r[1]))
    fits = [f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')" for h, p, _ in ordered]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (h, p, _) in zip(fits, ordered, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(fits, ordered, strict=True))
    host = "translate(regexp_extract({}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "regexp_extract({}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    node = f"regexp_extract(split_part({{0}}, '#', 1), '(?s)^(.*?://)', 1) || {host.format("split_part({0}, '#', 1)")} || regexp_replace(split_part({{0}}, '#', 1), '(?s)^.*?://[^/?#]*', '')"
    link = r"""(?is)<link\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)[^>]*\brel\s*=\s*[\"']?canonical\b|<link\b[^>]*?\brel\s*=\s*[\"']?canonical\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)""".replace("\\\"'", "\"''").replace("[\"']", "[\"'']")
    return f"""WITH RECURSIVE p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
l AS (SELECT url, regexp_extract(html, '{link}', 1) || regexp_extract(html, '{link}', 2) AS t FROM p WHERE contains(lower(html), 'canonical')),
r AS (SELECT url, CASE WHEN t LIKE '//%' THEN regexp_extract(url, '^(.*?:)//', 1) || t WHEN t LIKE '/%' THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || t ELSE t END AS t FROM l WHERE t LIKE '/%' OR t ILIKE 'http%://%'),
e AS (SELECT {node.format('url')} AS a, {node.format('t')} AS b FROM r), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
seed AS (SELECT a AS node, {host.format('a')} AS host, {path.format('a')} AS path FROM both_ways),
bad AS (SELECT node FROM (SELECT node, CASE {verdict} END AS v FROM seed) WHERE v = 'block' UNION SELECT b FROM bad JOIN both_ways ON a = node),
j AS (SELECT page_id, {host.format('url')} AS host, {path.format('url')} AS path, {node.format('url')} AS node FROM p)
SELECT page_id, host, path, CASE {rule} END AS rule, coalesce(CASE {verdict} END, CASE WHEN node IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM j"""


OP1 = r"""WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1) AS h FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(h, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'), ' +', ' ', 'g'))) AS x FROM a)
SELECT page_id, url, array_to_string(list_filter(x, lambda y: y != ''), chr(10) || chr(10)) AS text, length(array_to_string(list_filter(x, lambda y: y != ''), chr(10) || chr(10)))::BIGINT AS n_chars FROM b"""

OP2 = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id != b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
c AS (SELECT vec_id, vec_id AS root FROM v UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.vec_id), m AS (SELECT vec_id, min(root) AS component_id FROM c GROUP BY 1)
SELECT m.vec_id, (SELECT count(*) FROM l WHERE l.a = m.vec_id) AS n_links, component_id, m.vec_id = component_id AS kept FROM m"""

SQL = {"op1_html": OP1, "op2_vectors": OP2, "op5_secrets": _op5(), "op9_urls": _op9()}
