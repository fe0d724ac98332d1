"""SQL counterparts of :mod:`groundline.plans.queries`, written for DuckDB on the same tables."""

from __future__ import annotations

from groundline.dictionaries import (
    CONTENTS_MARKERS,
    DEFAULT_DICTIONARY,
    DOCUMENT_WORDS,
    INDICATORS,
    STOPWORDS,
)

FOLD = ("áÁéÉíÍóÓúÚüÜABCDEFGHIJKLMNOPQRSTUVWXYZ", "aaeeiioouuuuabcdefghijklmnopqrstuvwxyz")
INDEX_NUMBER = (r"(?i)\b(?:\d{1,3}(?:[.,''\s’]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?)"
                r"(?:%|[xXmMkK]|MM|mm)?\b")
RAW_NUMBER = r"\b\d[\d.,''’]*[xXmMkK%]?\b"
MONEY = (r"(?i)(us\s*\$|usd|pen|s\s*/\.?|\$)\s*\.?\s*(\d[\d.,''’]*)"
         r"(?:\s*(mil millones|billones|billón|billon|millones|millón|millon|million|miles|mil|billion))?")
PERCENT = r"(?i)(\d[\d.,''’]*)\s*(?:%|percent|por ciento)"


def sql_list(items) -> str:
    return "[" + ",".join("'" + str(i).replace("'", "''") + "'" for i in items) + "]"


def norm(x):
    return f"translate({x}, '{FOLD[0]}', '{FOLD[1]}')"


def words(x):
    return (f"list_filter(regexp_extract_all({norm(x)}, '[a-záéíóúüñÑ0-9.%/ſK]+'), "
            f"lambda t: strlen(t) >= 2 AND NOT list_contains({sql_list(STOPWORDS)}, t))")


def analysed(x):
    return f"regexp_extract_all(lower({norm(x)}), '[\\p{{L}}\\p{{N}}]+')"


def strip(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def digits(x):
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def raw(x):
    return (f"list_distinct(list_filter(list_transform(regexp_extract_all({x}, '{RAW_NUMBER}'), "
            f"lambda t: {digits('t')}), lambda t: t <> ''))")


def year_list(x):
    return f"list_distinct(regexp_extract_all({x}, '\\b(?:19|20|21)\\d{{2}}\\b'))"


def money(x):
    group = lambda i: f"regexp_extract(r, '{MONEY}', {i})"
    cur = f"regexp_replace(lower({group(1)}), '\\s', '', 'g')"
    factor = (f"CASE lower({group(3)}) WHEN '' THEN 1 WHEN 'mil millones' THEN 1000000000 "
              "WHEN 'billion' THEN 1000000000 WHEN 'miles' THEN 1000 WHEN 'mil' THEN 1000 "
              "WHEN 'millones' THEN 1000000 WHEN 'millón' THEN 1000000 WHEN 'millon' THEN 1000000 "
              "WHEN 'million' THEN 1000000 ELSE 1000000000000 END")
    return (f"list_transform(regexp_extract_all({x}, '{MONEY}'), lambda r: {{"
            f"'currency': CASE WHEN {cur} IN ('$', 'us$', 'usd') THEN 'usd' ELSE 'pen' END, "
            f"'base': {digits(group(2))}, "
            f"'value': CAST(CAST({digits(group(2))} AS HUGEINT) * {factor} AS VARCHAR), 'raw': r}})")


def percent(x):
    return (f"list_transform(regexp_extract_all({x}, '{PERCENT}'), lambda r: {{"
            f"'canon': '%|' || {digits('r')}, 'base': {digits('r')}, 'raw': r}})")


def key(m):
    return f"{m}.currency || '|' || {m}.value"


# ------------------------------------------------------------------------------ rankers

DOCS = "SELECT CAST(doc_id AS VARCHAR) AS child_id, text AS content, source AS issuer_key FROM documents"
PLAIN = "NULL::VARCHAR"
BY_SOURCE = "'src' || CAST(item_id % 20 AS VARCHAR)"
MATCH = "(issuer_filter IS NULL OR contains(issuer_key, issuer_filter) OR contains(issuer_filter, issuer_key))"


def chunk_tables(chunks: str) -> str:
    return f"""
chunks AS ({chunks}),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM chunks),
tf AS (SELECT child_id, issuer_key, term, count(*) AS tf
       FROM (SELECT child_id, issuer_key, unnest({words('content')}) AS term FROM chunks) GROUP BY ALL),
voc AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf,
               ln(((SELECT n FROM n) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY term)"""


WEIGHTS = f"""
w AS (SELECT child_id, issuer_key, term,
             tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY child_id)) AS weight
      FROM tf JOIN voc USING (term)),
atf AS (SELECT child_id, issuer_key, term, dl, count(*) AS tf
        FROM (SELECT child_id, issuer_key, len(l) AS dl, unnest(l) AS term
              FROM (SELECT child_id, issuer_key, {analysed('content')} AS l FROM chunks)) GROUP BY ALL),
avoc AS (SELECT term, ln(1 + ((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf
         FROM atf GROUP BY term),
avgdl AS (SELECT sum(tf) / (SELECT n FROM n) AS a FROM atf),
bw AS (SELECT child_id, issuer_key, term,
              idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT a FROM avgdl))) AS weight
       FROM atf JOIN avoc USING (term))"""


def occurrence_tables(issuer_filter: str, boosted: bool) -> str:
    qtf = ("CASE WHEN max(CASE WHEN place <= 3 AND idf > 3 THEN 1 ELSE 0 END) "
           "OVER (PARTITION BY query_id, token) = 1 THEN 3 ELSE 1 END") if boosted else "1"
    return f"""
asked AS (SELECT item_id AS query_id, text AS question, {issuer_filter} AS issuer_filter FROM benchmark),
occ AS (SELECT query_id, issuer_filter, pos, ws[pos + 1] AS token
        FROM (SELECT *, unnest(range(len(ws))) AS pos
              FROM (SELECT query_id, issuer_filter, {words('question')} AS ws FROM asked))),
placed AS (SELECT occ.*, coalesce(idf, 0) AS idf,
                  row_number() OVER (PARTITION BY query_id ORDER BY coalesce(idf, 0) DESC, pos) AS place
           FROM occ LEFT JOIN voc ON token = term),
weighed AS (SELECT query_id, issuer_filter, pos, token, idf, {qtf} AS qtf FROM placed)"""


LISTS = f"""
qt AS (SELECT query_id, issuer_filter, token AS term, sum(qtf) AS tf FROM weighed GROUP BY ALL),
qw AS (SELECT query_id, issuer_filter, term,
              tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY query_id)) AS qw
       FROM qt JOIN voc USING (term)),
ts AS (SELECT query_id, issuer_filter, child_id, issuer_key, round(sum(qw * weight), 9) AS score
       FROM qw JOIN w USING (term) GROUP BY ALL),
tl AS (SELECT query_id, child_id, score,
              row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS rank
       FROM ts WHERE {MATCH} AND score > 0 QUALIFY rank <= 25),
bq AS (SELECT query_id, issuer_filter, term, sum(qtf) AS qw
       FROM (SELECT query_id, issuer_filter, qtf, unnest({analysed('token')}) AS term FROM weighed) GROUP BY ALL),
bs AS (SELECT query_id, issuer_filter, child_id, issuer_key, round(sum(qw * weight), 9) AS score
       FROM bq JOIN bw USING (term) GROUP BY ALL),
wide AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS wide_rank
         FROM bs QUALIFY wide_rank <= 100),
bl AS (SELECT query_id, child_id, score, row_number() OVER (PARTITION BY query_id ORDER BY wide_rank) AS rank
       FROM wide WHERE {MATCH} QUALIFY rank <= 25),
rrf AS (SELECT query_id, child_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score
        FROM (SELECT query_id, child_id, rank FROM tl UNION ALL SELECT query_id, child_id, rank FROM bl)
        GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS rank
          FROM rrf QUALIFY rank <= 30)"""


def lists(chunks=DOCS, issuer_filter=PLAIN, boosted=False) -> str:
    return ",".join(["WITH " + chunk_tables(chunks), WEIGHTS, occurrence_tables(issuer_filter, boosted), LISTS])


RANKED = "SELECT query_id, rank, child_id, round(score, 6) AS score FROM "

ORACLES: dict[str, str] = {
    "tokenize_counts": f"""SELECT doc_id, len(l) AS n_tokens, len(list_distinct(l)) AS n_distinct
        FROM (SELECT doc_id, {words('text')} AS l FROM documents)""",
    "analysed_counts": f"""SELECT doc_id, len(l) AS n_terms, len(list_distinct(l)) AS n_distinct
        FROM (SELECT doc_id, {analysed('text')} AS l FROM documents)""",
    "doc_frequency_idf": f"WITH {chunk_tables(DOCS)} SELECT term, df, cf, round(idf, 6) AS idf FROM voc",
    "tfidf_norms": f"""WITH {chunk_tables(DOCS)}
        SELECT child_id, count(*) AS n_terms, round(sqrt(sum(tf * idf * tf * idf)), 6) AS norm
        FROM tf JOIN voc USING (term) GROUP BY child_id""",
    "tfidf_topk": lists() + RANKED + "tl",
    "tfidf_prefilter_issuer": lists(issuer_filter=BY_SOURCE) + RANKED + "tl",
    "bm25_topk": lists() + RANKED + "bl",
    "bm25_postfilter_issuer": lists(issuer_filter=BY_SOURCE) + RANKED + "bl",
    "rrf_fusion": lists() + RANKED + "fused",
    "rrf_maxnorm_multi": lists() + """,
        unit AS (SELECT query_id // 4 AS query_id, child_id,
                        score / max(score) OVER (PARTITION BY query_id) AS s FROM fused),
        total AS (SELECT query_id, child_id, round(sum(s), 9) AS score FROM unit GROUP BY ALL),
        best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS rank
                 FROM total QUALIFY rank <= 30) """ + RANKED + "best",
    "anchor_idf_boost": f"""WITH {chunk_tables(DOCS)}, {occurrence_tables(PLAIN, True)}
        SELECT query_id, CAST(pos AS BIGINT) AS pos, token, round(idf, 6) AS idf, CAST(qtf AS BIGINT) AS qtf
        FROM weighed""",
}

ORACLES["bm25_saved_index"] = ORACLES["bm25_topk"]
NAMED = "text || ' src' || CAST(item_id % 20 AS VARCHAR)"
ORACLES["bm25_two_fields"] = f"""WITH {chunk_tables(DOCS)}, atf AS (
    SELECT 'content' AS field, child_id, issuer_key, term, dl, count(*) AS tf
    FROM (SELECT child_id, issuer_key, len(l) AS dl, unnest(l) AS term
          FROM (SELECT child_id, issuer_key, {analysed('content')} AS l FROM chunks)) GROUP BY ALL
    UNION ALL SELECT 'indicator', child_id, issuer_key, issuer_key, 1, 1 FROM chunks WHERE issuer_key IS NOT NULL),
avoc AS (SELECT field, term, ln(1 + ((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM atf GROUP BY ALL),
avgdl AS (SELECT field, sum(tf) / (SELECT n FROM n) AS a FROM atf GROUP BY field),
bw AS (SELECT child_id, issuer_key, term, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)) AS weight
       FROM atf JOIN avoc USING (field, term) JOIN avgdl USING (field)),
asked AS (SELECT item_id AS query_id, {words(NAMED)} AS ws FROM benchmark),
bq AS (SELECT query_id, term, count(*) AS qw FROM (SELECT query_id, unnest({analysed('token')}) AS term
       FROM (SELECT query_id, unnest(ws) AS token FROM asked)) GROUP BY ALL),
must AS (SELECT query_id, {analysed('ws[1]')}[1] AS must FROM asked WHERE len(ws) > 0),
bs AS (SELECT query_id, child_id, round(sum(qw * weight), 9) AS score FROM bq JOIN bw USING (term) LEFT JOIN must USING (query_id)
       GROUP BY query_id, child_id HAVING bool_or(must IS NULL OR term = must)),
bl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS rank FROM bs QUALIFY rank <= 25)
SELECT query_id, rank, child_id, round(score, 6) AS score FROM bl"""

# ------------------------------------------------------------------------------ vectors

CENTROIDS = """WITH parts AS (SELECT label, unnest(range(len(embedding))) AS i, embedding FROM embeddings),
mean AS (SELECT label, i, avg(CAST(embedding[i + 1] AS DOUBLE)) AS x FROM parts GROUP BY ALL),
cent AS (SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY i) AS c FROM mean GROUP BY label),
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"""
COSINE = "list_dot_product(c, e) / (sqrt(list_dot_product(c, c)) * sqrt(list_dot_product(e, e)))"


def vector_sql(where: str) -> str:
    return f"""{CENTROIDS},
sims AS (SELECT query_id, CAST(vec_id AS VARCHAR) AS child_id, round({COSINE}, 9) AS score
         FROM cent, v WHERE {where}),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS rank
         FROM sims WHERE score > 0 QUALIFY rank <= 25) {RANKED} best"""


LABEL = "'label' || CAST(label AS VARCHAR)"
WANTED = "'label' || CAST(query_id AS VARCHAR)"
ORACLES |= {
    "vector_cosine_topk": vector_sql("true"),
    "vector_label_filter": vector_sql(f"(contains({LABEL}, {WANTED}) OR contains({WANTED}, {LABEL}))"),
    "vector_neighbour_cosine": f"""{CENTROIDS} SELECT vec_id, round({COSINE}, 6) AS cosine
        FROM v JOIN cent ON label = query_id""",
    "embedding_integrity": """SELECT count(*) AS n_vectors, count(DISTINCT vec_id) AS n_keys,
        min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim,
        min(len(embedding)) = max(len(embedding)) AS aligned FROM embeddings""",
}

# ------------------------------------------------------------------------------ numbers


def located(pages: str) -> str:
    """CTEs ending in ``loc(number, document, page, snippet)``; ``pages`` gives document, page, text."""
    number = strip("regexp_replace(tok, 'S/|[,. %$’''xXmMkKbB]', '', 'g')")
    return f"""pg AS ({pages}),
cut AS (SELECT document, page, text, string_split_regex(text, '{INDEX_NUMBER}') AS gaps,
               regexp_extract_all(text, '{INDEX_NUMBER}') AS toks FROM pg WHERE regexp_matches(text, '[0-9]')),
hit AS (SELECT document, page, text, i, toks[i] AS tok,
               list_sum(list_transform(gaps[1:i], lambda g: length(g)))
               + coalesce(list_sum(list_transform(toks[1:i - 1], lambda g: length(g))), 0) AS spot
        FROM (SELECT *, unnest(range(1, len(toks) + 1)) AS i FROM cut)),
norm AS (SELECT {number} AS number, document, page, i,
                {strip("replace(substr(text, CAST(greatest(spot - 60, 0) AS BIGINT) + 1, "
                       "CAST(spot + length(tok) + 60 - greatest(spot - 60, 0) AS BIGINT)), chr(10), ' ')")} AS snippet
         FROM hit),
loc AS (SELECT number, document, page, arg_min(snippet, i) AS snippet FROM norm
        WHERE regexp_matches(number, '^[0-9]+$') GROUP BY ALL)"""


PAGES = "SELECT source AS document, doc_id AS page, text FROM documents"
SAID = """s AS (SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS priority,
  'Contrato de ' || year(o_orderdate) || ': US$ ' || CAST(floor(o_totalprice) AS BIGINT) || ' millones, alza de '
    || o_custkey % 50 || '.5%; anticipo S/ ' || o_orderkey % 97 || ' mil.' AS context,
  'En ' || year(o_orderdate) || ' se pactaron ' || CASE WHEN o_orderstatus = 'P' THEN 'S/. ' ELSE 'US$ ' END
    || (CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)
    || ' millones, un ' || o_custkey % 50 || '.5 por ciento mas, con $' || o_orderkey % 97 || ' y '
    || o_orderkey % 97 || ' lotes de 3.25% cada uno.' AS response,
  'Cuanto se pacto en ' || year(o_orderdate) || '?' AS question FROM orders)"""
VERDICT = f"""{SAID},
facts AS (SELECT *, list_distinct(list_concat({raw('context')}, {raw('question')}, {year_list('context')},
                 {year_list('question')}, {sql_list(range(11))})) AS allowed,
          list_concat({money('context')}, {money('question')}) AS amoney,
          list_transform(list_concat({percent('context')}, {percent('question')}), lambda p: p.canon) AS apct,
          {raw('response')} AS said, {money('response')} AS rmoney, {percent('response')} AS rpct FROM s),
judged AS (SELECT *,
  list_filter(rmoney, lambda m: CASE WHEN len(list_filter(amoney, lambda a: a.currency = m.currency)) > 0
     THEN len(list_filter(amoney, lambda a: a.currency = m.currency AND a.value = m.value)) > 0
     ELSE list_contains(allowed, m.base) END) AS good_money,
  list_filter(rpct, lambda p: list_contains(apct, p.canon) OR list_contains(allowed, p.base)) AS good_pct
  FROM facts),
v AS (SELECT *, list_filter(rmoney, lambda m: NOT list_contains(good_money, m)) AS bad_money,
  list_filter(rpct, lambda p: NOT list_contains(good_pct, p)) AS bad_pct,
  list_filter(said, lambda x: NOT list_contains(allowed, x)
     AND NOT list_contains(list_transform(good_money, lambda m: m.base), x)
     AND NOT list_contains(list_transform(good_pct, lambda p: p.base), x)) AS bad_numbers FROM judged)"""
VALID = "len(bad_numbers) + len(bad_money) + len(bad_pct) = 0"
NOTE = "~~ [⚠️ Cifra no verificada en fuentes]"


def doc_list(column: str, expression: str) -> str:
    return f"array_to_string(list_sort({expression}), ',') AS {column}"


INDEX_SET = (f"list_distinct(list_filter(list_transform(regexp_extract_all(text, '{INDEX_NUMBER}'), lambda tok: "
             + strip("regexp_replace(tok, 'S/|[,. %$’''xXmMkKbB]', '', 'g')")
             + "), lambda x: regexp_matches(x, '^[0-9]+$')))")


def strike_sql() -> str:
    """Phrases become single characters, numbers are struck between them, phrases come back."""
    phrases = "list_concat(list_transform(bad_money, lambda m: m.raw), list_transform(bad_pct, lambda p: p.raw))"
    text, back = "response", "body"
    for i in range(1, 6):
        text = f"replace({text}, coalesce(ph[{i}], chr(57999)), chr({58000 + i}))"
        back = f"replace({back}, chr({58000 + i}), '~~' || coalesce(ph[{i}], '') || '{NOTE}')"
    return f"""WITH {VERDICT}, ph AS (SELECT o_orderkey, response, bad_numbers, {phrases} AS ph FROM v),
marked AS (SELECT o_orderkey, ph, bad_numbers, {text} AS t FROM ph),
parts AS (SELECT o_orderkey, ph, bad_numbers, string_split_regex(t, '{RAW_NUMBER}') AS g,
                 regexp_extract_all(t, '{RAW_NUMBER}') AS k FROM marked),
built AS (SELECT o_orderkey, ph, array_to_string(list_transform(range(1, len(g) + 1), lambda i:
   g[i] || CASE WHEN i > len(k) THEN '' WHEN list_contains(bad_numbers, {digits('k[i]')})
   THEN '~~' || k[i] || '{NOTE}' ELSE k[i] END), '') AS body FROM parts)
SELECT o_orderkey, {back} AS clean FROM built"""


CORRECTIONS = f"""WITH {VERDICT},
{located("SELECT 'contratos_' || priority AS document, o_orderkey AS page, context AS text FROM s")},
m AS (SELECT o_orderkey, i - 1 AS ord, bad_money[i] AS m
      FROM (SELECT *, unnest(range(1, len(bad_money) + 1)) AS i FROM v)),
looked AS (SELECT o_orderkey, ord, m, 0 AS prio, m.value AS number FROM m
           UNION ALL SELECT o_orderkey, ord, m, 1, m.base FROM m),
alts AS (SELECT number, document, page, snippet, i AS pos, l[i] AS a
         FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT *, {money('snippet')} AS l FROM loc))),
swapped AS (SELECT o_orderkey, ord, a, document, page, snippet FROM looked JOIN alts USING (number)
            WHERE a.value = m.value AND a.currency <> m.currency
            QUALIFY row_number() OVER (PARTITION BY o_orderkey, ord ORDER BY prio, document, page, pos) = 1),
first AS (SELECT number, document, page, snippet FROM loc
          QUALIFY row_number() OVER (PARTITION BY number ORDER BY document, page) = 1),
placed AS (SELECT o_orderkey, ord, document, page, snippet FROM looked JOIN first USING (number)
           QUALIFY row_number() OVER (PARTITION BY o_orderkey, ord ORDER BY prio) = 1),
c1 AS (SELECT m.o_orderkey, 0 AS g, m.ord,
         CASE WHEN w.document IS NOT NULL THEN 'Moneda' WHEN p.document IS NOT NULL THEN 'Representacion'
              ELSE 'NoEspecificado' END AS kind, {key('m.m')} AS hallucinated,
         CASE WHEN w.document IS NOT NULL THEN {key('w.a')} ELSE p.snippet END AS suggested_value,
         CASE WHEN w.document IS NOT NULL THEN w.document || ' pág. ' || w.page
              ELSE p.document || ' pág. ' || p.page END AS source,
         coalesce(w.snippet, p.snippet) AS snippet
       FROM m LEFT JOIN swapped w USING (o_orderkey, ord) LEFT JOIN placed p USING (o_orderkey, ord)),
nums AS (SELECT o_orderkey, context, i AS ord, l[i] AS number FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i
         FROM (SELECT *, list_sort(bad_numbers) AS l FROM v))),
c2 AS (SELECT o_orderkey, 1 AS g, ord, CASE WHEN here OR document IS NOT NULL THEN 'EnCorpus'
              ELSE 'NoEspecificado' END AS kind, number AS hallucinated, NULL AS suggested_value,
              CASE WHEN NOT here THEN document || ' pág. ' || page END AS source,
              CASE WHEN NOT here THEN snippet END AS snippet
       FROM (SELECT nums.*, document, page, snippet, list_contains({raw('context')}, number) AS here
             FROM nums LEFT JOIN first USING (number))),
c3 AS (SELECT o_orderkey, 2 AS g, i AS ord, 'NoEspecificado' AS kind, bad_pct[i].canon AS hallucinated,
              NULL AS suggested_value, NULL AS source, bad_pct[i].raw AS snippet
       FROM (SELECT *, unnest(range(1, len(bad_pct) + 1)) AS i FROM v))
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY g, ord) - 1 AS ord, kind, hallucinated,
       suggested_value, source, snippet
FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3)"""

ATTRIBUTION = """WITH r AS (SELECT o_orderkey, n_name AS issuer,
    CASE WHEN o_orderpriority LIKE '1%' THEN 'ventas' ELSE 'utilidad_neta' END AS indicator,
    CAST(floor(o_totalprice / 1000) AS BIGINT) AS k, o_orderstatus AS st
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
known AS (SELECT n_name AS issuer, indicator, k * 1000 AS value, bool_or(st = 'P') AS in_segment
          FROM r JOIN nation ON contains(lower(issuer), lower(n_name)) GROUP BY ALL),
lone AS (SELECT issuer, indicator, count(*) AS n, min(value) AS value FROM known GROUP BY ALL),
said AS (SELECT *, CASE WHEN st = 'F' THEN k * 7 ELSE k END * 1000 AS value FROM r)
SELECT o_orderkey, said.indicator, said.issuer, 'usd' AS claimed_currency,
       CAST(said.value AS VARCHAR) AS claimed_value,
       CASE WHEN lone.n = 1 THEN 'usd|' || lone.value END AS correct_value,
       coalesce(known.in_segment, false) AS segment_qualifier, known.value IS NULL AS is_misattribution
FROM said LEFT JOIN known ON said.issuer = known.issuer AND said.indicator = known.indicator
       AND said.value = known.value
     LEFT JOIN lone ON said.issuer = lone.issuer AND said.indicator = lone.indicator
WHERE known.value IS NULL OR known.in_segment"""

ORACLES |= {
    "number_locations": f"WITH {located(PAGES)} SELECT number, document, page, snippet FROM loc",
    "number_first_location": f"""WITH {located(PAGES)} SELECT number, document, page, snippet FROM loc
        QUALIFY row_number() OVER (PARTITION BY number ORDER BY document, page) = 1""",
    "index_numbers": f"SELECT doc_id, {doc_list('numbers', INDEX_SET)} FROM documents",
    "raw_numbers": f"SELECT doc_id, {doc_list('numbers', raw('text'))} FROM documents",
    "years": f"""SELECT doc_id, {doc_list('years', year_list('text'))},
        len(list_filter({raw('text')}, lambda x: length(x) = 4 AND x[1:2] IN ('19', '20', '21'))) AS year_like
        FROM documents""",
    "money_phrases": f"""WITH {SAID} SELECT o_orderkey, i - 1 AS pos, l[i].currency AS currency,
        l[i].base AS base_digits, l[i].value AS value, l[i].raw AS raw_text
        FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT o_orderkey, {money('response')} AS l FROM s))""",
    "percent_phrases": f"""WITH {SAID} SELECT o_orderkey, i - 1 AS pos, l[i].canon AS canon,
        l[i].base AS base_digits, l[i].raw AS raw_text
        FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT o_orderkey, {percent('response')} AS l FROM s))""",
    "grounding_verdict": f"""WITH {VERDICT} SELECT o_orderkey, {VALID} AS is_valid, {doc_list('allowed', 'allowed')},
        {doc_list('said', 'said')}, {doc_list('bad_numbers', 'bad_numbers')},
        array_to_string(list_transform(bad_money, lambda m: {key('m')}), ',') AS bad_money,
        array_to_string(list_transform(bad_pct, lambda p: p.canon), ',') AS bad_percent FROM v""",
    "grounding_by_priority": f"""WITH {VERDICT} SELECT priority, count(*) AS answers,
        CAST(sum(CASE WHEN {VALID} THEN 1 ELSE 0 END) AS BIGINT) AS valid,
        CAST(sum(len(bad_numbers)) AS BIGINT) AS bad_numbers, CAST(sum(len(bad_money)) AS BIGINT) AS bad_money,
        CAST(sum(len(bad_pct)) AS BIGINT) AS bad_percent FROM v GROUP BY priority""",
    "allowed_money_by_currency": f"""WITH {SAID}, a AS (SELECT unnest({money('context')}) AS m FROM s)
        SELECT m.currency AS currency, count(DISTINCT m.value) AS n_values, min(m.value) AS low, max(m.value) AS high
        FROM a GROUP BY m.currency""",
    "hallucinated_set": f"WITH {VERDICT} SELECT o_orderkey, unnest(bad_numbers) AS number FROM v",
    "corrections_by_kind": CORRECTIONS,
    "sanitize_text": strike_sql(),
    "sanitize_digits": f"""WITH {VERDICT} SELECT o_orderkey, list_reduce(
        list_concat([response], list_sort(bad_numbers)),
        lambda acc, x: replace(acc, x, '~~' || x || '{NOTE}')) AS clean FROM v""",
    "attribution_findings": ATTRIBUTION,
}

# ------------------------------------------------------------------------------ chunks and tables


def windows(size: int, overlap: int, base: str = "documents", tag: str = "") -> str:
    """Recursive cut of base(doc_id, source, text) ending in ``piece<tag>(doc_id, source, c_idx, content)``."""
    ends = " ".join(
        f"WHEN strpos(reverse(w), {mark}) > 0 THEN start + length(w) - strpos(reverse(w), {mark}) + 1"
        for mark in ("chr(10) || chr(10)", "chr(10)", "' .'", "' '"))

    def step(rows: str) -> str:
        return f"""SELECT doc_id, source, text, n, start, CASE WHEN start + {size} >= n THEN n {ends}
            ELSE start + {size} END AS stop
            FROM (SELECT *, substr(text, start + 1, {size}) AS w FROM ({rows}))"""

    first = step(f"SELECT doc_id, source, text, length(text) AS n, 0::BIGINT AS start FROM {base}")
    following = step(f"""SELECT doc_id, source, text, n,
        CASE WHEN stop > start + {overlap} THEN stop - {overlap} ELSE stop END AS start FROM win{tag} WHERE stop < n""")
    body = strip("substr(text, start + 1, stop - start)")
    return f"""win{tag} AS ({first} UNION ALL {following}),
piece{tag} AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS c_idx, content
          FROM (SELECT doc_id, source, start, CASE WHEN n <= {size} THEN text ELSE {body} END AS content, n FROM win{tag})
          WHERE n <= {size} OR content <> '')"""


LINES_OF = ("list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda l: "
            + strip("l") + "), lambda l: l <> '')")
TOC_PATTERN = "|".join(CONTENTS_MARKERS)
TOC = f"""len(l) >= 3 AND (len(list_filter(k, lambda x: regexp_matches({norm('x')}, '{TOC_PATTERN}'))) > 0
    OR (len(k) / len(l) >= 0.6 AND length(text) < 800 AND length({digits('text')}) < 10))"""
ASKED = """d AS (SELECT documents.*, benchmark.text AS question FROM documents
    JOIN benchmark ON item_id = doc_id % (SELECT count(*) FROM benchmark))"""


def overlap(asked: str, content: str) -> str:
    return (f"len(list_filter(string_split_regex({content}, '[.\\n]'), lambda f: regexp_matches(f, '[0-9]') "
            f"AND list_has_any({words('f')}, {asked})))")


ORACLES |= {
    "parent_windows": "WITH RECURSIVE " + windows(2000, 200)
    + " SELECT source || '_p' || doc_id || '_parent_' || c_idx AS parent_id, c_idx AS p_idx, content FROM piece",
    "recursive_chunks": "WITH RECURSIVE " + windows(400, 50) + " SELECT doc_id, c_idx, content FROM piece",
    "pipe_table_rows": """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, r) - 1 AS row_no,
        'Orden ' || l_orderkey || chr(10) || '| Parte | Cantidad | Estado |' || chr(10) || '|---|---|---|' || chr(10)
            || r AS content, CAST(l_partkey AS VARCHAR) AS label
        FROM (SELECT *, '| ' || l_partkey || ' | ' || CAST(floor(l_quantity) AS BIGINT) || ' | ' || l_returnflag
              || ' |' AS r FROM lineitem)""",
    "toc_flag": f"""SELECT doc_id, {TOC} AS is_toc FROM (SELECT doc_id, text, l,
        list_filter(l, lambda x: x[1] IN ('|', '#')) AS k
        FROM (SELECT doc_id, text, {LINES_OF} AS l FROM documents))""",
    "overlap_score": f"WITH {ASKED} SELECT doc_id, {overlap('a', 'text')} AS overlap "
    f"FROM (SELECT *, {words('question')} AS a FROM d)",
}

# ------------------------------------------------------------------------------ pages

LINE_CHUNKS = """SELECT doc_id || '_' || (i - 1) AS child_id, l[i] AS content,
    'grupo' || length(source) AS issuer_key, doc_id
    FROM (SELECT doc_id, source, l, unnest(range(1, len(l) + 1)) AS i
          FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)) WHERE l[i] <> ''"""
PARENTS = f"""pa AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS parent_id, source AS document, doc_id // 60 AS page,
    'grupo ' || length(source) AS issuer, text AS content, {TOC} AS is_toc
    FROM (SELECT *, list_filter(l, lambda x: x[1] IN ('|', '#')) AS k
          FROM (SELECT *, {LINES_OF} AS l FROM documents)))"""
HITS = f"""{lists(LINE_CHUNKS, boosted=True)}, {PARENTS},
hit AS (SELECT fused.query_id, fused.child_id, fused.score, fused.rank, pa.*
        FROM fused JOIN chunks USING (child_id) JOIN pa ON pa.doc_id = chunks.doc_id),
ph AS (SELECT query_id, parent_id, document, page, issuer,
              max(CASE WHEN is_toc THEN score * 0.1 ELSE score END) AS score,
              array_to_string(list(child_id ORDER BY rank), ',') AS matched FROM hit GROUP BY ALL),
pg AS (SELECT query_id, document, page, issuer, max(score) AS score FROM ph GROUP BY ALL),
best AS (SELECT * FROM pg QUALIFY row_number() OVER (
         PARTITION BY query_id, issuer ORDER BY score DESC, document, page) = 1),
near AS (SELECT best.query_id, best.document, pa.page, pa.issuer, pa.parent_id, pa.doc_id,
                abs(pa.page - best.page) AS distance, best.score * (1 - 0.1 * abs(pa.page - best.page)) AS score
         FROM best JOIN pa ON pa.document = best.document AND pa.issuer = best.issuer
              AND abs(pa.page - best.page) BETWEEN 1 AND 3
         WHERE NOT EXISTS (SELECT 1 FROM pg WHERE pg.query_id = best.query_id AND pg.document = pa.document
                           AND pg.page = pa.page)),
sib AS (SELECT pg.query_id, pg.document, pg.page, pg.issuer, pa.parent_id, pa.doc_id, pg.score,
               CASE WHEN best.page IS NOT NULL
                    AND row_number() OVER (PARTITION BY pg.query_id, pg.document, pg.page ORDER BY pa.doc_id) = 1
                    THEN 0 ELSE 1 END AS tier
        FROM pg JOIN pa USING (document, page, issuer)
             LEFT JOIN best ON best.query_id = pg.query_id AND best.document = pg.document AND best.page = pg.page),
tiers AS (SELECT * FROM sib UNION ALL
          SELECT query_id, document, page, issuer, parent_id, doc_id, score, 2 AS tier FROM near
          QUALIFY row_number() OVER (PARTITION BY query_id, issuer ORDER BY distance, page, doc_id) <= 2)"""
BLOCKS = f"""{HITS},
blk AS (SELECT t.query_id, t.document, t.page, t.issuer, max(t.score) AS score, min(tier) AS tier,
               array_to_string(list(pa.content ORDER BY tier, t.doc_id), chr(10) || chr(10)) AS content,
               array_to_string(list(t.parent_id ORDER BY tier, t.doc_id), ',') AS child_ids,
               coalesce(array_to_string(list(ph.matched ORDER BY tier, t.doc_id)
                        FILTER (ph.matched IS NOT NULL), ','), '') AS matched
        FROM tiers t JOIN pa USING (doc_id)
             LEFT JOIN ph ON ph.query_id = t.query_id AND ph.parent_id = t.parent_id
        GROUP BY t.query_id, t.document, t.page, t.issuer),
scored AS (SELECT blk.*, {overlap('a', 'content')} AS overlap
           FROM blk JOIN (SELECT query_id, {words('question')} AS a FROM asked) USING (query_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id
               ORDER BY overlap DESC, score DESC, tier, document, page) AS rank FROM scored QUALIFY rank <= 8)
SELECT query_id, rank, document || '_p' || page AS block_id, issuer, round(score, 6) AS score, overlap, content,
       child_ids, matched, issuer || '_memoria_2025 (pág. ' || page || ')' AS citation FROM top"""
MONEY_EVIDENCE = r"billion|million|millones|millon|mil\b|us\$|s/|\d{4,}"

ORACLES |= {
    "parent_max_score": f"{HITS} SELECT query_id, parent_id, document, page, round(score, 6) AS score, matched FROM ph",
    "sibling_expand": f"{HITS} SELECT query_id, document, page, parent_id, round(score, 6) AS score FROM sib",
    "best_per_issuer": f"{HITS} SELECT query_id, issuer, document, page, round(score, 6) AS score FROM best",
    "neighbor_band_join": f"{HITS} SELECT query_id, document, page, parent_id, distance, round(score, 6) AS score "
    "FROM near",
    "tiered_parents": f"{HITS} SELECT query_id, parent_id, CAST(tier AS BIGINT) AS tier, round(score, 6) AS score "
    "FROM tiers",
    "page_rehydrate": BLOCKS,
    "hybrid_retrieve": BLOCKS,
    "page_must_filter": f"""{HITS},
        must AS (SELECT query_id, ({words('question')})[1] AS anchor FROM asked),
        texts AS (SELECT document, page, string_agg({norm('chunks.content')}, ' ') AS t
                  FROM chunks JOIN pa ON pa.doc_id = chunks.doc_id GROUP BY ALL)
        SELECT query_id, child_id, anchor AS held, regexp_matches(t, '{MONEY_EVIDENCE}') AS money
        FROM hit JOIN must USING (query_id) JOIN texts USING (document, page) WHERE contains(t, anchor)""",
}

# ------------------------------------------------------------------------------ questions


def has_any(text: str, names) -> str:
    return f"regexp_matches({text}, '(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])({'|'.join(names)})($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])')"


SPECS = {"spanish_text": ("los", "del"), "english": ("the", "and", "that"), "french": ("les", "que"),
         "german": ("und", "der")}
IN_DICTIONARY_ORDER = ("english", "french", "german", "spanish_text")
FIRST = "CASE " + " ".join(f"WHEN {has_any('text', SPECS[c])} THEN '{c}'" for c in IN_DICTIONARY_ORDER) + " END"
MATCHED = "list_filter([" + ", ".join(
    f"CASE WHEN {has_any('text', names)} THEN '{canon}' END" for canon, names in SPECS.items()
) + "], lambda x: x IS NOT NULL)[1:3]"
SYNONYMS = "list_concat(" + ", ".join(
    f"CASE WHEN list_contains(m, '{canon}') THEN [{', '.join(f'text || {chr(39)} ({n}){chr(39)}' for n in names[:2])}] "
    "ELSE [] END" for canon, names in SPECS.items()) + ")"
ENGLISH = ("list_filter([CASE WHEN contains(lower(text), 'that') THEN 'which' END, "
           "CASE WHEN contains(lower(text), 'und') THEN 'and' END, "
           "CASE WHEN contains(lower(text), 'ción') THEN 'tion' END], lambda x: x IS NOT NULL)")
ASPECTS = ("list_filter([CASE WHEN contains(lower(text), 'the') THEN text || ': detalle de articles, nouns' END, "
           "CASE WHEN contains(lower(text), 'que') THEN text || ': detalle de relative clauses' END], "
           "lambda x: x IS NOT NULL)")
ISSUERS = {"english": ("and", "the"), "french": ("les", "ment"), "german": ("und", "sch")}
FOUND = "list_filter([" + ", ".join(
    "{'at': coalesce(" + ", ".join(f"nullif(strpos(lower(text), '{n}'), 0)" for n in names)
    + f"), 'o': {i}, 'canon': '{canon}'}}" for i, (canon, names) in enumerate(ISSUERS.items())
) + "], lambda s: s.at IS NOT NULL)"
CLAUSES = f"""c AS (SELECT item_id, i - 1 AS pos, l[i] AS clause FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i
    FROM (SELECT item_id, list_filter(list_transform(string_split_regex(text, '[,;\\n¿?.]| y '), lambda x: {strip('x')}),
          lambda x: x <> '') AS l FROM benchmark)))"""
PREAMBLE = (f"len(list_filter({words('replace(' + norm('clause') + ', ' + chr(39) + 'the' + chr(39) + ', ' + chr(39) * 2 + ')')}, "
            f"lambda t: NOT list_contains({sql_list(DOCUMENT_WORDS)}, t))) <= 1")
NAMES = ("list_filter(list_transform(list_filter(string_split_regex(clause, '\\s+')[2:], "
         "lambda t: regexp_matches(t, '^\\p{Lu}')), lambda t: "
         + norm("regexp_replace(t, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')")
         + "), lambda t: t <> '' AND t <> 'the')")

ORACLES |= {
    "indicator_match": f"SELECT doc_id, {FIRST} AS indicator, array_to_string({MATCHED}, ',') AS matched FROM documents",
    "query_expansion": f"""WITH v AS (SELECT item_id, list_concat([text], {SYNONYMS},
            CASE WHEN len(e) > 0 THEN [text || ' ' || array_to_string(e, ' ')] ELSE [] END, {ASPECTS})[1:5] AS l
            FROM (SELECT item_id, {strip('text')} AS text, {MATCHED} AS m, {ENGLISH} AS e FROM benchmark))
        SELECT item_id, i - 1 AS vid, l[i] AS variant FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM v)""",
    "issuer_detect": f"""SELECT item_id, array_to_string(list_transform(list_sort({FOUND}), lambda s: s.canon), ',')
        AS issuers FROM benchmark""",
    "issuer_match": """SELECT s_suppkey, a AS issuer_key, f AS filter_key,
        contains(a, p) OR contains(p, a) AS prefix_match, contains(a, f) OR contains(f, a) AS nation_match
        FROM (SELECT s_suppkey, regexp_replace(lower(s_name), '[_\\- ]', '', 'g') AS a,
              regexp_replace(lower(substr(s_name, 1, 9)), '[_\\- ]', '', 'g') AS p,
              regexp_replace(lower(substr(s_name, 1, 10) || substr(n_name, 1, 1)), '[_\\- ]', '', 'g') AS f
              FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "clause_split": f"""WITH {CLAUSES} SELECT item_id, pos, clause, {PREAMBLE} AS preamble,
        array_to_string(list_transform(list_filter(range(1, len(n) + 1), lambda i: list_position(n, n[i]) = i),
        lambda i: n[i]), ',') AS anchors FROM (SELECT *, {NAMES} AS n FROM c)""",
    "strip_think": f"""SELECT conv_id, turn, {strip("regexp_replace(regexp_replace(regexp_replace(regexp_replace("
        "CASE WHEN role = 'user' THEN '<think>' ELSE '' END || text || '</think>' || chr(10) "
        "|| '<Reasoning>x</reasoning >' || text || '<thought>y' || chr(10) || '</thought> ', "
        "'(?is)<think>.*?</think[[:space:]]*>', '', 'g'), '(?is)<thought>.*?</thought[[:space:]]*>', '', 'g'), "
        "'(?is)<reasoning>.*?</reasoning[[:space:]]*>', '', 'g'), '(?is)^.*?</think[[:space:]]*>', '')")} AS answer
        FROM conversations""",
    "catalog_coalesce": """WITH f AS (SELECT *, url LIKE 'https%' AS named, 2000 + page_id % 26 AS y FROM pages)
        SELECT CASE WHEN named THEN 'Emisor' || page_id || '_memoria_anual_' || y || '.md'
                    ELSE 'informe-' || y || '_' || page_id || '.md' END AS document,
          CASE WHEN contains(url, '?') THEN 'Catalogo' WHEN named THEN 'Emisor' || page_id ELSE 'informe' END AS issuer,
          CASE WHEN contains(url, '?') THEN 'reporte' WHEN named THEN 'memoria anual' ELSE 'memoria' END AS doc_type,
          CASE WHEN contains(url, '?') THEN '2024' ELSE CAST(y AS VARCHAR) END AS year,
          CASE WHEN contains(url, '?') THEN url WHEN named THEN 'Emisor' || page_id || ' memoria anual ' || y
               ELSE 'informe-' || y || ' ' || page_id END AS title FROM f""",
    "markdown_page_split": f"SELECT conv_id, turn + 1 AS page, {strip('text')} AS text FROM conversations "
    f"WHERE {strip('text')} <> ''",
    "sha256_manifest": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "prompt_context": f"""WITH {ASKED} SELECT doc_id, '--- DOCUMENTOS Y CONTEXTO FUENTE ---' || chr(10) || chr(10)
        || '### FUENTE [1]' || chr(10) || 'DOCUMENTO: ' || source || chr(10) || 'CONTENIDO:' || chr(10)
        || '[fragmento relevante: ' || string_split(text, chr(10))[1] || ']' || chr(10) || text || chr(10) || chr(10)
        || '------------------------------------' || chr(10) || chr(10) || 'PREGUNTA DEL ANALISTA: ' || question
        || chr(10) || chr(10) || 'RESPUESTA EJECUTIVA (con citas y cifras verificadas):' AS prompt FROM d""",
}

# ------------------------------------------------------------------------------ sentences

# chr(1) marks a cut and chr(2) a full stop that doesn't cut. Neighbouring matches overlap, hence the second turn.
_KEPT = "regexp_replace(text, '([sS]/)[.]', '\\1' || chr(2), 'g')"
for _ in range(2):
    _KEPT = f"regexp_replace({_KEPT}, '([0-9sS])[.]([0-9])', '\\1' || chr(2) || '\\2', 'g')"
_CUT = f"replace(regexp_replace({_KEPT}, '([.?!\n\r])', '\\1' || chr(1), 'g'), chr(2), '.')"
ORACLES["answer_sentences"] = f"""WITH cut AS (
    SELECT conv_id, turn, list_filter(list_transform(string_split({_CUT}, chr(1)), lambda s: {strip('s')}), lambda s: s <> '') AS ps
    FROM conversations),
piece AS (SELECT conv_id, turn, i, ps[i] AS piece FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM cut)),
numbered AS (SELECT *, sum(CASE WHEN i = 1 OR regexp_matches(piece, '\\p{{L}}') THEN 1 ELSE 0 END)
    OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS pos FROM piece)
SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, string_agg(piece, ' ' ORDER BY i) AS sentence
FROM numbered GROUP BY conv_id, turn, pos"""

# ------------------------------------------------------------------------------ two chunk levels, sub-queries

# The documents hold no pipe tables, so all children are prose.
NAMED_INDICATOR = "CASE " + " ".join(f"WHEN {has_any('content', names)} THEN '{canon}'" for canon, names in INDICATORS) + " END"
ORACLES["two_level_chunks"] = f"""WITH RECURSIVE {windows(2000, 200)},
parent AS (SELECT source || '_p' || doc_id || '_parent_' || c_idx AS doc_id, source, content AS text FROM piece),
{windows(400, 50, "parent", "_c")}
SELECT doc_id || '_child_' || c_idx AS child_id, doc_id AS parent_id, content, false AS is_table, {NAMED_INDICATOR} AS indicator FROM piece_c"""

_ACCENTED = {"a": "áÁ", "e": "éÉ", "i": "íÍ", "o": "óÓ", "u": "úÚüÜ"}
_OPENING = "^" + "".join(
    "(?:" + "".join(f"[{ch}{ch.upper()}{_ACCENTED.get(ch, '')}]" if ch.isalpha() else ch for ch in prefix) + "\\s*)?"
    for prefix in DEFAULT_DICTIONARY.segment_prefixes)
_OWNED = "map {" + ", ".join(f"'{canon}': {sql_list(names)}" for canon, names in ISSUERS.items()) + "}"


def anchors_of(clause: str) -> str:
    """Capitalised words but the first, folded, that are neither the issuer nor a word of its names; each once."""
    tokens = (f"list_filter(list_transform(list_filter(string_split_regex({strip(clause)}, '\\s+')[2:], "
              f"lambda t: regexp_matches(t, '^\\p{{Lu}}')), lambda t: "
              + norm("regexp_replace(t, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')")
              + "), lambda t: t <> '' AND t <> issuer AND NOT list_contains(owned[issuer], t))")
    return f"(SELECT list_filter(l, lambda x, i: list_position(l, x) = i) FROM (SELECT {tokens} AS l))"


_PREAMBLE = (f"len(list_filter({words('replace(' + norm('x') + ', issuer, ' + chr(39) * 2 + ')')}, "
             f"lambda t: NOT list_contains({sql_list(DOCUMENT_WORDS)}, t))) <= 1")
_CUTS = lambda marks: (f"list_filter(list_transform(string_split_regex(q, '{marks}'), lambda x: {strip('x')}), "  # noqa: E731
                       "lambda x: x <> '')")
ORACLES["question_subqueries"] = f"""WITH asked AS (
    SELECT item_id AS query_id, text AS q, {_OWNED} AS owned, list_transform(list_sort({FOUND}), lambda s: s.canon) AS issuers FROM benchmark),
single AS (SELECT query_id, q, owned, issuers[1] AS issuer, unnest(range(1, len(l) + 1)) AS i, l FROM (
    SELECT *, {_CUTS("[,;\\n¿?.]| y ")} AS l FROM asked WHERE len(issuers) = 1)),
kept AS (SELECT query_id, q, owned, issuer, i, l[i] AS x FROM single),
clause AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS sid, x AS text, issuer, owned FROM kept WHERE NOT ({_PREAMBLE})),
several AS (SELECT query_id, q, owned, issuers[i] AS issuer, i - 1 AS sid FROM (
    SELECT *, unnest(range(1, len(issuers) + 1)) AS i FROM asked WHERE len(issuers) > 1)),
segment AS (SELECT query_id, sid, regexp_replace(coalesce(
    list_filter({_CUTS("[,;\\n¿?]| y ")}, lambda s: len(list_filter(owned[issuer], lambda n: contains({norm('s')}, n))) > 0)[1],
    {strip('q')}), '{_OPENING}', '') AS text, issuer, owned FROM several),
named AS (SELECT query_id, sid, text, issuer, {anchors_of('text')} AS must FROM (SELECT * FROM clause UNION ALL SELECT * FROM segment)),
subs AS (
    SELECT query_id, sid, true AS multi, text, issuer, must FROM named
    UNION ALL SELECT query_id, 0, len(issuers) > 0, q, issuers[1], [] FROM asked
    WHERE len(issuers) = 0 OR (len(issuers) = 1 AND query_id NOT IN (SELECT query_id FROM clause))),
whole AS (SELECT query_id, flatten(list(must ORDER BY sid)) AS every, count(DISTINCT issuer) = 1 AS alone FROM subs GROUP BY query_id)
SELECT query_id, sid, multi, text, issuer AS issuer_filter, array_to_string(must, ',') AS must,
    CASE WHEN multi AND alone THEN array_to_string(list_filter(every, lambda a: NOT list_contains(must, a)), ',') ELSE '' END AS boost
FROM subs JOIN whole USING (query_id)"""


# Nested loops on purpose: every alias against every text, every name against every name.
_FIRST_TWO = r"regexp_extract(lower(text), '^([a-z]+ [a-z]+)(?:[^\p{L}\p{M}\p{N}_]|$)', 1)"
ORACLES["dictionary_matches"] = rf"""WITH names AS (
    SELECT {_FIRST_TWO} AS alias, source AS canon FROM documents UNION ALL SELECT {_FIRST_TWO}, 'benchmark' FROM benchmark),
entries AS (SELECT alias, min(canon) AS canon FROM names WHERE alias <> '' GROUP BY alias),
marked AS (SELECT doc_id, regexp_replace(lower(text), '([\p{{L}}\p{{N}}\p{{M}}_]+)', '<\1>', 'g') AS t FROM documents),
hits AS (SELECT doc_id, alias, canon FROM marked JOIN entries ON contains(t, '<' || replace(alias, ' ', '> <') || '>'))
SELECT doc_id, count(*) AS n_aliases, arg_min(canon, (length(alias), alias)) AS first_canon,
    arg_min(alias, (length(alias), alias)) AS first_alias FROM hits GROUP BY doc_id"""
ORACLES["contained_names"] = """WITH written AS (
    SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'Supplier#' || lpad(c_custkey::VARCHAR, 9, '0') || ' ' || n_name
        ELSE lpad(c_custkey::VARCHAR, 7, '0') END AS w FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT s_suppkey, count(w) FILTER (contains(w, s_name) AND w <> s_name) AS n_holding,
    count(w) FILTER (contains(s_name, w) AND w <> s_name) AS n_inside, min(w) AS first_written
FROM supplier LEFT JOIN written ON contains(w, s_name) OR contains(s_name, w) GROUP BY s_suppkey"""
