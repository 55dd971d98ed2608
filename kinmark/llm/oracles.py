"""DuckDB SQL for the training-data queries that SQL can express.

The others need functions or loops that SQL lacks (checksums, XXH64, a trained model, merge rounds, a
permutation's cycle walk); the tests hold them against brute force.
"""

from __future__ import annotations

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _extra(x: str, chars: tuple[str, ...]) -> str:
    """Length of a text in which each of ``chars`` takes one character more."""
    return f"length({x})" + "".join(f" + length({x}) - length(replace({x}, {c}, ''))" for c in chars)


_ESCAPED = ("'\\'", "'<'", "'['")
CHAT = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, lag(r) OVER w IS DISTINCT FROM r AS opens, lead(r) OVER w IS DISTINCT FROM r AS closes FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_extra("x", _ESCAPED)}
    + CASE WHEN opens THEN CASE WHEN r = 'assistant' THEN 3 ELSE 6 END + {_extra("r", (*_ESCAPED, "chr(10)"))} + 1 ELSE 3 END
    + CASE WHEN closes THEN CASE WHEN r = 'assistant' THEN 4 ELSE 7 END ELSE 0 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id"""


def _node(url: str) -> str:
    host = f"translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), {_AZ})"
    return f"CASE WHEN {host} <> '' THEN {host} || regexp_replace(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1), '/$', '') END"


_ATTRIBUTE = r"""[^\s"''>/=]+\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)"""


def _attribute(name: str) -> str:
    """Value of an attribute of ``tag``, from the list of the tag's attributes."""
    raw = rf"list_filter(regexp_extract_all(tag, '{_ATTRIBUTE}'), lambda a: lower(regexp_extract(a, '^[^\s=]+')) = '{name}')[1]"
    value = rf"regexp_replace({raw}, '^[^=]*=\s*', '')"
    return f"CASE WHEN left({value}, 1) IN (chr(34), chr(39)) THEN substr({value}, 2, length({value}) - 2) ELSE {value} END"


def url_filter(rules) -> str:
    fits = "\n  UNION ALL ".join(
        f"SELECT '{r.host}' AS rule_host, '{r.path}' AS rule_path, '{r.verdict}' AS rule_verdict" for r in rules
    )
    best = """(SELECT rule_host || rule_path || '=' || rule_verdict FROM rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host))
    AND starts_with(path, rule_path) ORDER BY length(rule_host || rule_path) DESC, rule_verdict LIMIT 1)"""
    return rf"""
WITH RECURSIVE rules AS ({fits}),
p AS (SELECT page_id, url, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {_AZ}), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
tags AS (SELECT url, host, path, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM p),
named AS (SELECT *, lower({_attribute("rel")}) AS rel, lower({_attribute("http-equiv")}) AS equiv, {_attribute("href")} AS href, {_attribute("content")} AS content FROM tags),
found AS (SELECT url, host, path, href AS t FROM named WHERE regexp_matches(tag, '(?i)^<link') AND list_contains(regexp_split_to_array(rel, '\s+'), 'canonical')
  UNION ALL SELECT url, host, path, regexp_replace(regexp_extract(content, '(?is)[;,]\s*url\s*=\s*(.+)$', 1), '^["'']|["'']\s*$', '', 'g') FROM named
  WHERE regexp_matches(tag, '(?i)^<meta') AND equiv = 'refresh'),
clean AS (SELECT url, host, path, regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme, replace(trim(t), '&amp;', '&') AS t FROM found),
links AS (SELECT {_node("url")} AS a, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN scheme || ':' || t
  WHEN starts_with(t, '/') THEN scheme || '://' || host || t WHEN t <> '' THEN scheme || '://' || host || regexp_replace(path, '[^/]*$', '') || t END AS t FROM clean),
edges AS (SELECT a, {_node("t")} AS b FROM links),
sym AS (SELECT a, b FROM edges WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM edges WHERE a IS NOT NULL AND b IS NOT NULL),
reach AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
n AS (SELECT b, regexp_extract(b, '(?s)^([^/?]*)', 1) AS host, regexp_extract(b, '(?s)^[^/?]*([^?]*)', 1) AS path FROM (SELECT DISTINCT b FROM reach)),
m AS (SELECT b, {best} AS hit FROM n),
alias AS (SELECT a, min(split_part(hit, '=', 2)) AS verdict FROM reach JOIN m USING (b) WHERE hit IS NOT NULL GROUP BY a),
j AS (SELECT p.*, {best} AS hit, {_node("url")} AS node FROM p)
SELECT page_id, host, path, split_part(hit, '=', 1) AS rule, coalesce(split_part(hit, '=', 2), alias.verdict, 'allow') AS verdict,
  CASE WHEN hit IS NOT NULL THEN 'rule' WHEN alias.verdict IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by
FROM j LEFT JOIN alias ON alias.a = j.node"""


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
DECONTAMINATION = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
items AS (SELECT item_id, w, least(13, len(w)) AS l FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, l, array_to_string(w[k:k + l - 1], ' ') AS s FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM items)),
d AS (SELECT row_number() OVER () AS rn, doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT rn, l, k, array_to_string(w[k:k + l - 1], ' ') AS s FROM (SELECT rn, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM d, (SELECT DISTINCT l FROM items) WHERE len(w) >= l)),
found AS (SELECT rn, k, places.l, item_id FROM places JOIN windows ON places.l = windows.l AND places.s = windows.s),
hit AS (SELECT rn, count(DISTINCT q) AS n_hit FROM (SELECT rn, unnest(range(k, k + l)) AS q FROM found) GROUP BY rn),
its AS (SELECT rn, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rn, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rn) LEFT JOIN its USING (rn)"""
