"""Statements in DuckDB SQL of what each registered query returns, written from the definitions."""

from __future__ import annotations

from kinmark.functions.fixed_values import ADDR_STOPWORDS, FEATURE_NAMES, LEGAL_STOPWORDS, NOT_IN_28, STREET_ABBREVIATIONS
from kinmark.params import BACKGROUND, DEFAULT, TIGHT, TINY, LinkParams


def _norm(x: str) -> str:
    s = f"trim(coalesce({x}, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"
    t = f"lower(regexp_replace(strip_accents(CASE WHEN lower({s}) IN ('nan', 'none', 'null', '') THEN '' ELSE {s} END), '[^\\x00-\\x7F]', '', 'g'))"
    t = f"replace(replace(replace({t}, '&', ' and '), '+', ' plus '), '@', ' at ')"
    t = rf"regexp_replace({t}, '\b(\d+)(?:st|nd|rd|th)\b', '\1', 'g')"
    return f"trim(regexp_replace({t}, '[^a-z0-9]+', ' ', 'g'))"


def _words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in sorted(values)) + "]"


_ABBR = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in STREET_ABBREVIATIONS.items()) + "}"
_DIGITS = "regexp_full_match(w, '[0-9]+')"

DOCUMENTS = """SELECT CASE CAST(substr(source, 4) AS INT) % 3 WHEN 0 THEN 'S1' WHEN 1 THEN 'S2' ELSE 'S3' END AS role,
  doc_id AS ordinal, split_part(text, chr(10), 1) AS bn, substr(text, length(split_part(text, chr(10), 1)) + 2) AS ba, lang AS country FROM documents"""
UNKNOWNS = DOCUMENTS.replace("lang AS country", "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS country")
PAGES = r"""SELECT CASE page_id % 3 WHEN 0 THEN 'S1' WHEN 1 THEN 'S2' ELSE 'S3' END AS role, page_id AS ordinal,
  regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS bn, url AS ba, regexp_extract(html, '(?i)<html[^>]*\blang="([^"]*)"', 1) AS country FROM pages"""
PARTS = """SELECT CASE p_partkey % 3 WHEN 0 THEN 'S1' WHEN 1 THEN 'S2' ELSE 'S3' END AS role, p_partkey AS ordinal,
  p_name AS bn, p_size || ' ' || p_type || ' ' || p_brand AS ba, 'US' AS country FROM part"""


def base(source: str = DOCUMENTS, raw: bool = False) -> str:
    """Common tables up to ``e``: prepared entities with word and token lists."""
    name, address = ("bn", "ba") if raw else ("n", "a")
    tokens = f"""
n1 AS (SELECT *, {_words(_norm(name))} AS bw, {_words(_norm(address))} AS baw, {_words(_norm("n"))} AS nw, {_words(_norm("a"))} AS aw FROM e1),
n2 AS (SELECT *, {_kept("baw")} AS bclean, {_kept("aw")} AS clean, array_to_string(bw, '') AS bare FROM n1),
e AS (SELECT *, {_name_tokens("bw")} AS bnt, {_name_tokens("nw")} AS nt, {_address_tokens("bclean")} AS bat, {_address_tokens("clean")} AS adt,
  CASE WHEN bare = '' THEN []::VARCHAR[] WHEN length(bare) < 4 THEN ['ng_' || bare]
    ELSE list_transform(range(1, length(bare) - 2), lambda i: 'ng_' || substr(bare, i, 4)) END AS ng FROM n2)"""
    return f"""WITH e0 AS ({source}),
e00 AS (SELECT role, role || '-' || ordinal AS entity_id, ordinal, bn, ba, {_norm("bn")} AS n, {_norm("ba")} AS pa, upper({_norm("country")}) AS c0 FROM e0),
e1 AS (SELECT *, CASE WHEN c0 = '' THEN 'UNKNOWN' ELSE c0 END AS c,
  array_to_string(list_transform({_words("pa")}, lambda w: coalesce(({_ABBR})[w], w)), ' ') AS a FROM e00),{tokens}"""


def _kept(x: str) -> str:
    return f"""list_filter(list_transform({x}, lambda w: CASE WHEN {_DIGITS} THEN ltrim(w, '0')
    WHEN length(w) >= 3 AND NOT list_contains({_list(ADDR_STOPWORDS)}, w) THEN w ELSE '' END), lambda w: w <> '')"""


def _name_tokens(x: str) -> str:
    plain = f"list_transform(list_filter({x}, lambda w: length(w) >= 2 AND NOT list_contains({_list(LEGAL_STOPWORDS)}, w)), lambda w: 'n_' || w)"
    short = f"array_to_string(list_filter({x}, lambda w: length(w) <= 2), '')"
    acr = f"CASE WHEN len({x}) >= 2 AND length({short}) >= 2 AND NOT list_contains({_list(LEGAL_STOPWORDS)}, {short}) THEN ['n_acr_' || {short}] ELSE []::VARCHAR[] END"
    longest = f"list_filter({x}, lambda w: length(w) = list_max(list_transform({x}, lambda z: length(z))))[1]"
    return f"CASE WHEN len({x}) > 0 AND len({plain}) + len({acr}) = 0 THEN ['n_' || {longest}] ELSE list_concat({plain}, {acr}) END"


def _address_tokens(x: str) -> str:
    return f"""list_concat(list_transform({x}, lambda w: CASE WHEN {_DIGITS} THEN 'num_' || w ELSE 'w_' || w END),
    CASE WHEN len({x}) >= 2 THEN list_transform(range(1, len({x})), lambda i: 'sh_' || {x}[i] || '_' || {x}[i + 1]) ELSE []::VARCHAR[] END)"""


KIND = "CASE WHEN token LIKE 'ng\\_%' ESCAPE '\\' THEN 'ngram' WHEN token LIKE 'n\\_%' ESCAPE '\\' THEN 'name' WHEN token LIKE 'num\\_%' ESCAPE '\\' THEN 'num' WHEN token LIKE 'sh\\_%' ESCAPE '\\' THEN 'shingle' ELSE 'word' END"


def blocking(params: LinkParams, kinds: tuple[str, ...] | None = None, part: str | None = None) -> str:
    """Common tables up to ``cand (s1_id, cand_id)``."""
    part = part or ("'ALL'" if params.partitioning == "none" else "c")
    only = f"WHERE {KIND} IN ({', '.join(repr(k) for k in kinds)})" if kinds else ""
    fixed = f"WHERE c IN ({', '.join(repr(x) for x in params.countries)})" if params.partitioning == "fixed" else ""
    cap = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in params.caps().items()) + " END"
    grams = ", ng" if params.use_ngrams else ""
    take = f"QUALIFY row_number() OVER (PARTITION BY r.part, r.s1_id ORDER BY p.role, p.ordinal, p.entity_id) <= {params.fallback_limit}" if params.fallback_limit else ""
    fall = f" UNION SELECT s1_id, cand_id FROM (SELECT r.s1_id, p.entity_id AS cand_id FROM rarest r JOIN post p USING (part, token) {take})" if params.fallback else ""
    no_self = "WHERE s1_id <> cand_id" if params.exclude_self else ""
    return f"""
parted AS (SELECT *, {part} AS part FROM e {fixed}),
tok0 AS (SELECT part, role, ordinal, entity_id, unnest(list_distinct(flatten([bnt, bat{grams}]))) AS token FROM parted),
tok AS (SELECT *, {KIND} AS kind FROM tok0 {only}),
post AS (SELECT * FROM tok WHERE role <> 'S1'),
cnt AS (SELECT part, token, kind, count(*) AS post_count FROM post GROUP BY ALL),
direct AS (SELECT DISTINCT q.part, q.entity_id AS s1_id, p.entity_id AS cand_id FROM tok q JOIN cnt USING (part, token) JOIN post p USING (part, token)
  WHERE q.role = 'S1' AND cnt.post_count <= {cap.replace("kind ", "cnt.kind ")}),
alone AS (SELECT q.part, q.entity_id AS s1_id, cnt.post_count, q.token FROM tok q JOIN cnt USING (part, token) WHERE q.role = 'S1'
  AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.part = q.part AND d.s1_id = q.entity_id)),
rarest AS (SELECT part, s1_id, token FROM alone QUALIFY row_number() OVER (PARTITION BY part, s1_id ORDER BY post_count, token) = 1),
cand AS (SELECT DISTINCT s1_id, cand_id FROM (SELECT s1_id, cand_id FROM direct{fall}) {no_self})"""


def ranked(n: int) -> str:
    return f"""
weighed AS (SELECT s1_id, cand_id, 2 * len(list_intersect(x.bnt, y.bnt)) + len(list_intersect(x.bat, y.bat)) AS weight
  FROM cand JOIN e x ON x.entity_id = s1_id JOIN e y ON y.entity_id = cand_id),
top AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY weight DESC, cand_id) AS rank FROM weighed QUALIFY rank <= {n})"""


def counter_ranked(params: LinkParams, n: int, repeated: bool) -> str:
    lists = "flatten([bnt, bat, ng])" if repeated else "list_distinct(flatten([bnt, bat, ng]))"
    cap = "CASE cnt.kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in params.caps().items()) + " END"
    return f"""
probe AS (SELECT part, entity_id AS s1_id, token, count(*) AS times FROM (SELECT part, entity_id, unnest({lists}) AS token FROM parted WHERE role = 'S1') GROUP BY ALL),
weighed AS (SELECT s1_id, p.entity_id AS cand_id, CAST(sum(times * CASE cnt.kind WHEN 'name' THEN 2 ELSE 1 END) AS BIGINT) AS weight
  FROM probe JOIN cnt USING (part, token) JOIN post p USING (part, token) WHERE cnt.post_count <= {cap} GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY weight DESC, cand_id) AS rank FROM weighed QUALIFY rank <= {n})"""


def _jac(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


def _con(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / least(len(list_distinct({a})), len(list_distinct({b}))) END"


def _grams(x: str, n: int) -> str:
    return f"CASE WHEN {x} = '' THEN []::VARCHAR[] WHEN length({x}) < {n} THEN [{x}] ELSE list_transform(range(1, length({x}) - {n - 2}), lambda i: substr({x}, i, {n})) END"


def _edit(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) = 0 AND length({b}) = 0 THEN 1.0 ELSE 1.0 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END"


def _sorted(x: str) -> str:
    return f"array_to_string(list_sort({_words(x)}), ' ')"


def _jw(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1.0 ELSE jaro_winkler_similarity({a}, {b}) END"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 0.0 ELSE least(length({a}), length({b})) / greatest(length({a}), length({b})) END"


def _of(x: str, prefix: str) -> str:
    return f"list_filter({x}, lambda t: starts_with(t, '{prefix}'))"


def _flag(x: str) -> str:
    return f"CASE WHEN {x} THEN 1.0 ELSE 0.0 END"


def soundex_sql(x: str) -> str:
    """First letter, then the digit of every later letter that has one and does not repeat its neighbour's."""
    digit = "CASE WHEN contains('BFPV', {0}) THEN '1' WHEN contains('CGJKQSXZ', {0}) THEN '2' WHEN contains('DT', {0}) THEN '3' WHEN {0} = 'L' THEN '4' WHEN contains('MN', {0}) THEN '5' WHEN {0} = 'R' THEN '6' ELSE '' END"
    here, before = digit.format(f"upper(substr({x}, i, 1))"), digit.format(f"upper(substr({x}, i - 1, 1))")
    tail = f"array_to_string(list_transform(range(2, length({x}) + 1), lambda i: CASE WHEN {here} = {before} THEN '' ELSE {here} END), '')"
    return f"CASE WHEN {x} = '' THEN '' ELSE rpad(left(CASE WHEN left({x}, 1) = '0' THEN '' ELSE upper(left({x}, 1)) END || {tail}, 4), 4, '0') END"


_FEATURES = {
    "name_exact_match": _flag("n1 <> '' AND n1 = n2"),
    "name_jaccard": _jac("N1_", "N2_"),
    "name_containment": _con("N1_", "N2_"),
    "name_ngram_jaccard_3": _jac(f"({_grams('n1', 3)})", f"({_grams('n2', 3)})"),
    "name_ngram_jaccard_4": _jac(f"({_grams('n1', 4)})", f"({_grams('n2', 4)})"),
    "name_edit_sim": _edit("n1", "n2"),
    "name_token_sort_sim": _edit(_sorted("n1"), _sorted("n2")),
    "name_jaro_winkler": "jw",
    "name_lcs_ratio": "CASE WHEN n1 = '' OR n2 = '' THEN 0.0 ELSE 2.0 * lcs / (length(n1) + length(n2)) END",
    "name_len_ratio": _ratio("n1", "n2"),
    "name_acronym_match": _flag(f"len(list_intersect({_of('N1_', 'n_acr_')}, {_of('N2_', 'n_acr_')})) > 0"),
    "name_prefix_match": _flag("n1 <> '' AND n2 <> '' AND (starts_with(n1, substr(n2, 1, 4)) OR starts_with(n2, substr(n1, 1, 4)))"),
    "name_soundex_match": _flag(f"n1 <> '' AND n2 <> '' AND {soundex_sql('string_split(n1, chr(32))[1]')} = {soundex_sql('string_split(n2, chr(32))[1]')}"),
    "addr_null": _flag("a2 = ''"),
    "addr_exact_match": _flag("a1 <> '' AND a1 = a2"),
    "addr_jaccard": _jac("A1_", "A2_"),
    "addr_containment": _con("A1_", "A2_"),
    "addr_word_jaccard": _jac(_of("A1_", "w_"), _of("A2_", "w_")),
    "addr_word_containment": _con(_of("A1_", "w_"), _of("A2_", "w_")),
    "addr_edit_sim": f"CASE WHEN a1 = '' OR a2 = '' THEN 0.0 ELSE {_edit('a1', 'a2')} END",
    "addr_jaro_winkler": "ajw",
    "addr_house_num_match": "CASE WHEN len(h1) = 0 AND len(h2) = 0 THEN 0.5 WHEN len(list_intersect(h1, h2)) > 0 THEN 1.0 ELSE 0.0 END",
    "addr_house_num_conflict": _flag("len(h1) > 0 AND len(h2) > 0 AND len(list_intersect(h1, h2)) = 0"),
    "addr_house_num_overlap_count": "CAST(len(list_intersect(h1, h2)) AS DOUBLE)",
    "addr_shingle_overlap_count": f"CAST(len(list_intersect({_of('A1_', 'sh_')}, {_of('A2_', 'sh_')})) AS DOUBLE)",
    "addr_len_ratio": _ratio("a1", "a2"),
    "name_in_addr_cross_match": _flag("len(list_filter(string_split(n1, ' '), lambda w: length(w) >= 4 AND contains(a2, w))) > 0"),
    "addr_in_name_cross_match": _flag("len(list_filter(string_split(a1, ' '), lambda w: length(w) >= 4 AND contains(n2, w))) > 0"),
    "joint_name_addr_sim": "CASE WHEN a2 <> '' THEN (jw + ajw) / 2 ELSE jw END",
    "harmonic_mean_jw": "CASE WHEN a2 <> '' AND jw + ajw > 0 THEN 2 * jw * ajw / (jw + ajw) ELSE jw END",
    "shared_tokens_total_count": "CAST(len(list_intersect(N1_, N2_)) + len(list_intersect(A1_, A2_)) AS DOUBLE)",
    "country_match": _flag("c1 = c2 OR c1 = 'UNKNOWN' OR c2 = 'UNKNOWN'"),
    "is_source3": _flag("starts_with(cand_id, 'S3-')"),
    "name_len_diff": "CAST(abs(length(n1) - length(n2)) AS DOUBLE)",
}

PAIRS = f"""
pair0 AS (SELECT t.*, x.n AS n1, y.n AS n2, x.a AS a1, y.a AS a2, x.c AS c1, y.c AS c2, list_distinct(x.nt) AS N1_, list_distinct(y.nt) AS N2_,
  list_distinct(x.adt) AS A1_, list_distinct(y.adt) AS A2_ FROM top t JOIN e x ON x.entity_id = t.s1_id JOIN e y ON y.entity_id = t.cand_id),
pair AS (SELECT *, {_jw("n1", "n2")} AS jw, CASE WHEN a1 = '' OR a2 = '' THEN 0.0 ELSE {_jw("a1", "a2")} END AS ajw,
  {_of("A1_", "num_")} AS h1, {_of("A2_", "num_")} AS h2 FROM pair0)"""

#: The common subsequence by its table, one diagonal of it per step: ``a`` is the last diagonal, ``b`` the one before, and
#: element i + 1 belongs to the first i letters of the first name.
LCS = """,
names AS (SELECT DISTINCT n1, n2 FROM pair0),
steps(n1, n2, d, a, b) AS (SELECT n1, n2, 0, list_transform(range(0, length(n1) + 1), lambda i: 0), list_transform(range(0, length(n1) + 1), lambda i: 0) FROM names
  UNION ALL SELECT n1, n2, d + 1, list_transform(range(0, length(n1) + 1), lambda i: CASE WHEN i = 0 OR i > d THEN 0
    ELSE greatest(a[i], a[i + 1], b[i] + CASE WHEN substr(n1, i, 1) = substr(n2, d + 1 - i, 1) THEN 1 ELSE 0 END) END), a
  FROM steps WHERE d < length(n1) + length(n2)),
common AS (SELECT n1, n2, a[length(n1) + 1] AS lcs FROM steps WHERE d = length(n1) + length(n2)),
pairs AS (SELECT * FROM pair JOIN common USING (n1, n2))"""


def features(names, source: str = PAGES, n: int = 60, params: LinkParams = DEFAULT) -> str:
    columns = ", ".join(f"round(CAST({_FEATURES[f]} AS DOUBLE), 9) AS {f}" for f in names)
    lcs, pairs = (LCS, "pairs") if "name_lcs_ratio" in names else ("", "pair")
    sql = f"{base(source)},{blocking(params)},{ranked(n)},{PAIRS}{lcs} SELECT s1_id, cand_id, {columns} FROM {pairs}"
    return sql.replace("WITH ", "WITH RECURSIVE ", 1) if lcs else sql


def scored(n: int = 60) -> str:
    return f"""{base(PAGES)},{blocking(DEFAULT)},{ranked(n)},{PAIRS},
scored AS (SELECT s1_id, cand_id, rank, round({_FEATURES["joint_name_addr_sim"]}, 9) AS prob, {_FEATURES["addr_house_num_conflict"]} AS conflict, round(jw, 9) AS name_jw FROM pair),
truth AS (SELECT x.entity_id AS s1_id, list_sort(coalesce(list(y.entity_id) FILTER (WHERE y.entity_id IS NOT NULL), [])) AS matches
  FROM e x LEFT JOIN e y ON y.role <> 'S1' AND y.n = x.n AND y.country0 = x.country0 WHERE x.role = 'S1' GROUP BY 1)""".replace("y.country0 = x.country0", "y.c = x.c")


_CHOICE = "row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id)"
RULES = {
    "decide_tau_delta_k": f"""SELECT s1_id, cand_id, prob FROM (SELECT *, max(prob) OVER (PARTITION BY s1_id) AS best FROM scored)
  WHERE prob >= 0.75 AND prob >= best - 0.05 QUALIFY {_CHOICE} <= 7""",
    "decide_threshold_only": "SELECT s1_id, cand_id, prob FROM scored WHERE prob >= 0.7",
    "decide_threshold_topk": f"SELECT s1_id, cand_id, prob FROM scored WHERE prob >= 0.7 QUALIFY {_CHOICE} <= 5",
    "decide_rank_order_topk": "SELECT s1_id, cand_id, prob FROM scored WHERE prob >= 0.7 QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY rank, cand_id) <= 4",
    "decide_conflict_filter": f"""SELECT s1_id, cand_id, prob FROM (SELECT *, max(prob) OVER (PARTITION BY s1_id) AS best FROM scored)
  WHERE prob >= 0.7 AND prob >= best - 0.05 AND conflict <> 1 QUALIFY {_CHOICE} <= 6""",
    "decide_min_name_jw": f"SELECT s1_id, cand_id, prob FROM scored WHERE prob >= 0.7 AND name_jw >= 0.8 QUALIFY {_CHOICE} <= 5",
    "decide_source_partition": """SELECT s1_id, cand_id, prob FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, starts_with(cand_id, 'S3-') ORDER BY prob DESC, cand_id) AS rn
  FROM scored WHERE prob >= 0.7) WHERE rn <= 2 AND (rn = 1 OR prob >= 0.98)""",
}

PREDICTED = f"""
accepted AS ({RULES["decide_threshold_topk"]}),
pred AS (SELECT t.s1_id, t.matches, list_sort(coalesce(list(a.cand_id) FILTER (WHERE a.cand_id IS NOT NULL), [])) AS ids
  FROM truth t LEFT JOIN accepted a USING (s1_id) GROUP BY ALL)"""


def _f05(p: str, t: str) -> str:
    k = f"len(list_intersect({p}, {t}))"
    return f"""CASE WHEN len({t}) = 0 THEN CASE WHEN len({p}) = 0 THEN 1.0 ELSE 0.0 END WHEN len({p}) = 0 OR {k} = 0 THEN 0.0
  ELSE 1.25 * ({k} / len({p})) * ({k} / len({t})) / (0.25 * ({k} / len({p})) + {k} / len({t})) END"""


def grid(thresholds, margins, ks) -> str:
    points = ", ".join(
        f"({i}, {t}, {'NULL' if m is None else m}, {'NULL' if k is None else k})"
        for i, (t, m, k) in enumerate((t, m, k) for t in thresholds for m in margins for k in ks)
    )
    return f"""{scored()},
grid(point, threshold, margin, k) AS (VALUES {points}),
ordered AS (SELECT *, {_CHOICE} AS rn, max(prob) OVER (PARTITION BY s1_id) AS best FROM scored),
chosen AS (SELECT g.point, o.s1_id, list(o.cand_id) AS ids FROM grid g JOIN ordered o ON o.prob >= g.threshold AND (g.margin IS NULL OR o.prob >= o.best - g.margin)
  AND (g.k IS NULL OR o.rn <= g.k) GROUP BY ALL),
each AS (SELECT g.point, g.threshold, g.margin, g.k, t.s1_id, coalesce(c.ids, []) AS ids, t.matches FROM grid g CROSS JOIN truth t LEFT JOIN chosen c ON c.point = g.point AND c.s1_id = t.s1_id)
SELECT CAST(point AS INTEGER) AS point, CAST(threshold AS DOUBLE) AS threshold, CAST(margin AS DOUBLE) AS margin, CAST(k AS INTEGER) AS k, round(avg({_f05("ids", "matches")}), 9) AS macro_f05
FROM each GROUP BY ALL ORDER BY 5 DESC, 1 LIMIT 1"""


def oracle_sql() -> dict[str, str]:
    from kinmark.operators.decide import KS, RULE_MARGINS, THRESHOLDS

    unknown_part = "unnest(list_distinct([c, 'UNKNOWN']))"
    sets = {
        "feat_name_sets": ("name_exact_match", "name_jaccard", "name_containment", "name_ngram_jaccard_3", "name_ngram_jaccard_4", "name_acronym_match", "name_prefix_match", "name_soundex_match", "name_len_ratio"),
        "feat_name_edit": ("name_edit_sim", "name_token_sort_sim"),
        "feat_name_jw": ("name_jaro_winkler", "joint_name_addr_sim", "harmonic_mean_jw"),
        "feat_addr_sets": ("addr_null", "addr_exact_match", "addr_jaccard", "addr_containment", "addr_word_jaccard", "addr_word_containment", "addr_edit_sim", "addr_jaro_winkler", "addr_shingle_overlap_count", "addr_len_ratio"),
        "feat_lcs": ("name_lcs_ratio",),
        "feat_cross": ("name_in_addr_cross_match", "addr_in_name_cross_match", "shared_tokens_total_count", "country_match", "is_source3"),
    }
    out = {
        "norm_text": f"{base()} SELECT entity_id, n AS name, pa AS address FROM e",
        "norm_address": f"{base()} SELECT entity_id, a AS address FROM e",
        "norm_country": f"{base(UNKNOWNS)} SELECT entity_id, c AS country FROM e",
        "country_partitions": f"{base(UNKNOWNS)} SELECT DISTINCT c AS country FROM e",
        "name_tokens": f"{base()} SELECT entity_id, array_to_string(nt, ' ') AS tokens FROM e",
        "address_tokens": f"{base()} SELECT entity_id, array_to_string(adt, ' ') AS tokens FROM e",
        "address_shingles": f"{base(PARTS)} SELECT entity_id, array_to_string({_of('adt', 'sh_')}, ' ') AS shingles FROM e",
        "name_ngrams": f"{base()} SELECT entity_id, array_to_string(ng, ' ') AS ngrams FROM e",
        "soundex_codes": f"{base()} SELECT entity_id, {soundex_sql('string_split(n, chr(32))[1]')} AS code FROM e",
        "token_counts": f"{base()},{blocking(DEFAULT)} SELECT part, token, post_count FROM cnt",
        "capped_tokens": f"{base()},{blocking(TIGHT)} SELECT part, token, post_count FROM cnt WHERE post_count <= CASE kind WHEN 'name' THEN 20 WHEN 'word' THEN 15 WHEN 'ngram' THEN 10 ELSE 40 END",
        "candidates_union": f"{base()},{blocking(DEFAULT)} SELECT s1_id, cand_id FROM cand",
        "candidates_capped": f"{base()},{blocking(TIGHT)} SELECT s1_id, cand_id FROM cand",
        "candidates_fallback": f"{base()},{blocking(TINY)} SELECT s1_id, cand_id FROM cand",
        "candidates_fallback_first8": f"{base()},{blocking(TINY.with_(fallback_limit=8))} SELECT s1_id, cand_id FROM cand",
        "candidates_raw_addr": f"{base(raw=True)},{blocking(TIGHT)} SELECT s1_id, cand_id FROM cand",
        "candidates_unknown_pass": f"{base(UNKNOWNS)},{blocking(TIGHT, part=unknown_part)} SELECT s1_id, cand_id FROM cand",
        "candidates_fixed_countries": f"{base()},{blocking(TIGHT.with_(partitioning='fixed', countries=('FR', 'EN')))} SELECT s1_id, cand_id FROM cand",
        "candidates_no_partition": f"{base()},{blocking(TIGHT.with_(partitioning='none'))} SELECT s1_id, cand_id FROM cand",
        "rank_overlap_top60": f"{base()},{blocking(DEFAULT)},{ranked(60)} SELECT s1_id, cand_id, CAST(weight AS INTEGER) AS weight, CAST(rank AS INTEGER) AS rank FROM top",
        "rank_counter_list_top50": f"{base()},{blocking(TIGHT)},{counter_ranked(TIGHT, 50, True)} SELECT s1_id, cand_id, weight, CAST(rank AS INTEGER) AS rank FROM top",
        "rank_counter_set_top8": f"{base()},{blocking(TIGHT)},{counter_ranked(TIGHT, 8, False)} SELECT s1_id, cand_id, weight, CAST(rank AS INTEGER) AS rank FROM top",
        "feat_house_numbers": features(("addr_house_num_match", "addr_house_num_conflict", "addr_house_num_overlap_count"), PARTS, 20, TIGHT),
        "features_33": features(FEATURE_NAMES),
        "features_28": features([f for f in FEATURE_NAMES if f not in NOT_IN_28]),
        "macro_f05": f"{scored()},{PREDICTED} SELECT round(coalesce(avg({_f05('ids', 'matches')}), 0.0), 9) AS macro_f05 FROM pred",
        "f05_per_entity": f"{scored()},{PREDICTED} SELECT s1_id, round({_f05('ids', 'matches')}, 9) AS f05 FROM pred",
        "matching_results": f"{scored()},{PREDICTED} SELECT s1_id AS source1_entity_id, array_to_string(ids, ',') AS matched_entity_ids FROM pred",
        "candidate_pairs_tsv": f"{base()},{blocking(TINY)} SELECT x.entity_id AS source1_entity_id, coalesce(array_to_string(list_sort(list(cand_id) FILTER (WHERE cand_id IS NOT NULL)), ','), '') AS candidate_entity_ids FROM e x LEFT JOIN cand ON s1_id = x.entity_id WHERE x.role = 'S1' GROUP BY 1",
        "candidate_pairs_ranked": f"{base()},{blocking(TINY)},{ranked(60)} SELECT x.entity_id AS source1_entity_id, coalesce(array_to_string(list(cand_id ORDER BY rank) FILTER (WHERE cand_id IS NOT NULL), ','), '') AS candidate_entity_ids FROM e x LEFT JOIN top ON s1_id = x.entity_id WHERE x.role = 'S1' GROUP BY 1",
        "ground_truth": f"{scored()} SELECT s1_id, array_to_string(matches, ',') AS matches FROM truth",
        "pair_metrics": f"""{scored()},{PREDICTED},
s AS (SELECT sum(len(list_intersect(ids, matches))) AS tp, sum(len(ids)) AS p, sum(len(matches)) AS t, count(*) FILTER (WHERE len(matches) = 0) AS single,
  count(*) FILTER (WHERE len(matches) = 0 AND len(ids) = 0) AS ok FROM pred)
SELECT CASE WHEN p > 0 THEN tp / p ELSE 1.0 END AS pair_precision, CASE WHEN t > 0 THEN tp / t ELSE 0.0 END AS pair_recall, CASE WHEN single > 0 THEN ok / single ELSE 1.0 END AS singleton_accuracy FROM s""",
        "grid_threshold": grid(THRESHOLDS, [None], KS),
        "grid_decision": grid((0.70, 0.75, 0.80, 0.85, 0.90, 0.95), RULE_MARGINS, KS),
    }
    for kinds, name in (((("name",)), "block_name"), (("word", "num", "shingle"), "block_addr"), (("ngram",), "block_ngram")):
        params = TIGHT.with_(fallback=False)
        out[name] = f"{base()},{blocking(params, kinds)} SELECT s1_id, cand_id FROM cand"
    # the statements so far have small caps; those of the default caps take their names
    lines = "array_to_string(list(cand_id ORDER BY {}) FILTER (WHERE cand_id IS NOT NULL), ',')"
    for end, names in (
        ("_tight", (
            "block_name", "block_addr", "block_ngram", "capped_tokens", "candidates_raw_addr", "candidates_unknown_pass",
            "candidates_fixed_countries", "candidates_no_partition", "rank_counter_list_top50", "rank_counter_set_top8",
        )),
        ("_tiny", ("candidate_pairs_tsv", "candidate_pairs_ranked")),
    ):
        out |= {name + end: out.pop(name) for name in names}
    cand, top = "SELECT s1_id, cand_id FROM cand", "SELECT s1_id, cand_id, weight, CAST(rank AS INTEGER) AS rank FROM top"
    for kinds, name in ((("name",), "block_name"), (("word", "num", "shingle"), "block_addr"), (("ngram",), "block_ngram")):
        out[name] = f"{base()},{blocking(DEFAULT, kinds)} {cand}"
    limit = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in DEFAULT.caps().items()) + " END"
    out |= {
        "capped_tokens": f"{base()},{blocking(DEFAULT)} SELECT part, token, post_count FROM cnt WHERE post_count <= {limit}",
        "candidates_raw_addr": f"{base(raw=True)},{blocking(DEFAULT)} {cand}",
        "candidates_unknown_pass": f"{base(UNKNOWNS)},{blocking(DEFAULT, part=unknown_part)} {cand}",
        "candidates_fixed_countries": f"{base()},{blocking(DEFAULT.with_(partitioning='fixed', countries=('FR', 'EN')))} {cand}",
        "candidates_no_partition": f"{base()},{blocking(DEFAULT.with_(partitioning='none'))} {cand}",
        "rank_counter_list_top50": f"{base()},{blocking(DEFAULT)},{counter_ranked(DEFAULT, 50, True)} {top}",
        "rank_counter_set_top8": f"{base()},{blocking(DEFAULT)},{counter_ranked(DEFAULT, 8, False)} {top}",
        "candidate_pairs_tsv": f"{base()},{blocking(DEFAULT)} SELECT x.entity_id AS source1_entity_id, coalesce({lines.format('cand_id')}, '') AS candidate_entity_ids FROM e x LEFT JOIN cand ON s1_id = x.entity_id WHERE x.role = 'S1' GROUP BY 1",
        "candidate_pairs_ranked": f"{base()},{blocking(DEFAULT)},{ranked(60)} SELECT x.entity_id AS source1_entity_id, coalesce({lines.format('rank')}, '') AS candidate_entity_ids FROM e x LEFT JOIN top ON s1_id = x.entity_id WHERE x.role = 'S1' GROUP BY 1",
    }
    for name, columns in sets.items():
        out[name] = features(columns)
    from kinmark.operators.features import BASELINE_20

    out["features_20"] = features(BASELINE_20)
    for name, sql in RULES.items():
        out[name] = f"{scored()} {sql}"
    out["blocking_metrics"] = f"""{scored()},
per AS (SELECT t.s1_id, len(t.matches) AS m, coalesce(n, 0) AS n, coalesce(kept, 0) AS kept FROM truth t
  LEFT JOIN (SELECT s1_id, count(*) AS n FROM cand GROUP BY 1) USING (s1_id)
  LEFT JOIN (SELECT c.s1_id, count(*) AS kept FROM cand c JOIN truth u ON u.s1_id = c.s1_id AND list_contains(u.matches, c.cand_id) GROUP BY 1) USING (s1_id))
SELECT CAST(count(*) AS DOUBLE) AS num_s1, CAST(sum(m) AS DOUBLE) AS total_true_matches, CAST(sum(kept) AS DOUBLE) AS retained_true_matches, CAST(sum(n) AS DOUBLE) AS total_candidates,
  avg(n) AS avg_candidates, CAST(median(n) AS DOUBLE) AS median_candidates, CAST(min(n) AS DOUBLE) AS min_candidates, CAST(max(n) AS DOUBLE) AS max_candidates,
  sum(kept) / sum(m) AS blocking_recall, 100 * (sum(kept) / sum(m)) AS blocking_recall_pct FROM per"""
    out["search_space_reduction"] = f"""{base()},{blocking(TIGHT)}, k AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM cand),
s AS (SELECT count(*) FILTER (WHERE role = 'S1') AS a, count(*) FILTER (WHERE role <> 'S1') AS b FROM e)
SELECT n AS candidates, 100.0 * (1.0 - n / (CAST(a AS DOUBLE) * CAST(b AS DOUBLE))) AS reduction_pct, n / 100000.0 AS candidate_growth, CAST(0.95 AS DOUBLE) - CAST(0.9 AS DOUBLE) AS recall_change FROM k, s"""
    out["background_scan"] = f"""{scored()}, named AS (SELECT DISTINCT unnest(matches) AS id FROM truth),
t AS (SELECT entity_id, ordinal, entity_id IN (SELECT id FROM named) AS wanted FROM e WHERE role <> 'S1')
SELECT entity_id FROM t WHERE wanted UNION ALL
SELECT entity_id FROM (SELECT entity_id FROM t WHERE NOT wanted ORDER BY ordinal, entity_id LIMIT {BACKGROUND})"""
    out["training_pairs"] = f"""{scored()},
cut AS (SELECT s1_id, matches FROM (SELECT t.*, row_number() OVER (ORDER BY e.ordinal) AS rn, count(*) OVER () AS n FROM truth t JOIN e ON e.entity_id = t.s1_id) WHERE rn <= CAST(floor(n * (CAST(1 AS DOUBLE) - CAST(0.3 AS DOUBLE))) AS BIGINT)),
true_pairs AS (SELECT s1_id, unnest(matches) AS cand_id FROM cut)
SELECT s1_id, cand_id, CAST(1 AS INTEGER) AS label FROM true_pairs UNION ALL
SELECT s1_id, cand_id, CAST(0 AS INTEGER) FROM (SELECT t.s1_id, t.cand_id, t.rank FROM top t JOIN cut USING (s1_id) ANTI JOIN true_pairs p ON p.s1_id = t.s1_id AND p.cand_id = t.cand_id
  QUALIFY row_number() OVER (PARTITION BY t.s1_id ORDER BY t.rank, t.cand_id) <= 10)"""
    out["verify_output"] = f"""{base()}, ids AS (SELECT entity_id AS id FROM e WHERE role = 'S1'),
written AS (SELECT id FROM ids WHERE CAST(substr(id, 4) AS BIGINT) % 10 <> 3 UNION ALL SELECT id FROM ids WHERE CAST(substr(id, 4) AS BIGINT) % 10 = 4 UNION ALL SELECT 'S1-x'),
n AS (SELECT id, count(*) AS k FROM written GROUP BY 1)
SELECT (SELECT count(*) FROM ids) AS expected_rows, (SELECT count(*) FROM written) AS output_rows, (SELECT count(*) FROM ids WHERE id NOT IN (SELECT id FROM written)) AS missing_ids,
  CAST((SELECT coalesce(sum(k - 1), 0) FROM n WHERE k > 1) AS BIGINT) AS duplicate_rows, (SELECT count(*) FROM n WHERE id NOT IN (SELECT id FROM ids)) AS unexpected_ids"""
    return out
