"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from chainloom.llm import divergence, licenses, mixing

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_UPPER.lower()}') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, line, pos, r.key IS NOT NULL AND k.doc_id <> r.keeper AS lost FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""



def _canonical(text: str) -> str:
    text = f"regexp_replace(lower(coalesce({text}, '')), '{licenses.COPYRIGHT}', '', 'g')"
    text = f"regexp_replace({text}, '{licenses.NOT_WORDS}', ' ', 'g')"
    for other, one in licenses.SPELLINGS:
        text = f"replace({text}, '{other}', '{one}')"
    return f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LICENSES = f"""
WITH known AS (
  SELECT digest, min(license_id) AS license_id
  FROM (SELECT col0 AS license_id, sha256(array_to_string({_canonical("col1")}, ' ')) AS digest
        FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in licenses.known_texts())}))
  GROUP BY digest),
d AS (SELECT doc_id, {_canonical("text")} AS ls FROM documents),
whole AS (SELECT doc_id, min(license_id) AS license_id FROM d JOIN known ON digest = sha256(array_to_string(ls, ' ')) WHERE len(ls) > 0 GROUP BY doc_id),
notice AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
           FROM (SELECT doc_id, unnest(ls) AS line FROM d) JOIN known ON digest = sha256(line) GROUP BY doc_id)
SELECT d.doc_id, license_id, coalesce(notices, '') AS notices FROM d LEFT JOIN whole USING (doc_id) LEFT JOIN notice USING (doc_id)
"""


#: Rounds of the recursion; the fit has settled before on the test tables.
_SWEEPS = 60


def mixing_sql(table: str = "documents", flatten: float = 0.7, budget: float = 0.6) -> str:
    """The rows of mixing.mix as common table expressions, ending in mixed(doc_id, ..., p, sampled)."""
    noise = " OR ".join(f"contains(t, '{x}')" for x in ("%%%", "&&&", "$$$", "***", "###"))
    digits = " + ".join(f"(instr('0123456789abcdef', substr(h, {k + 1}, 1)) - 1) * {16 ** (7 - k)}::BIGINT" for k in range(8))
    steps = [
        f"mix_d AS (SELECT *, coalesce(text, '') AS t, md5(coalesce(doc_id::VARCHAR, ':' || text, '') || ':mix') AS h FROM {table})",
        f"""mix_e AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
            CASE WHEN contains(t, ' | ') THEN 'table' WHEN {noise} THEN 'noise' WHEN length(t) < 400 THEN 'note'
                 WHEN length(t) > 20000 THEN 'book' ELSE 'prose' END AS topic,
            greatest(1, len(regexp_extract_all(t, '{mixing.WORD}'))) AS tokens, ({digits}) / {2**32}.0::DOUBLE AS draw FROM mix_d)""",
        "mix_0 AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM mix_e GROUP BY ALL)",
    ]
    margins, swept = list(mixing.MARGINS), "r"
    for m in margins:
        steps += [
            f"mix_{m} AS (SELECT {m}, sum(tokens) AS have, pow(sum(tokens), {flatten}) AS share FROM mix_0 GROUP BY {m})",
            f"""mix_{m}_rate AS (SELECT *, have / share AS lasts, ({budget} * sum(have) OVER () - coalesce(sum(have) OVER (ORDER BY have / share, {m} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(share) OVER (ORDER BY have / share, {m} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM mix_{m})""",
            f"mix_{m}_to AS (SELECT {m}, least(have, share * (SELECT rate FROM mix_{m}_rate WHERE rate <= lasts ORDER BY lasts, {m} LIMIT 1)) AS to_{m} FROM mix_{m})",
        ]
        swept = f"(SELECT * REPLACE (least(tokens, expected * to_{m} / sum(expected) OVER (PARTITION BY {m})) AS expected) FROM {swept})"
    start = "mix_0 " + " ".join(f"JOIN mix_{m}_to USING ({m})" for m in margins)
    columns = ", ".join([*margins, "tokens", *(f"to_{m}" for m in margins)])
    steps += [
        f"""r AS (SELECT 0 AS round, {columns}, {budget} * tokens AS expected FROM {start}
            UNION ALL SELECT round + 1, {columns}, expected FROM {swept} WHERE round < {_SWEEPS})""",
        f"""mixed AS (SELECT doc_id, e.source, e.lang, topic, e.tokens, least(1.0, expected / c.tokens) AS p, draw < least(1.0, expected / c.tokens) AS sampled
        FROM mix_e e JOIN (SELECT * FROM r WHERE round = {_SWEEPS}) c USING (source, lang, topic))""",
    ]
    return ",\n".join(steps)


MIXING = f"""
WITH RECURSIVE {mixing_sql()}
SELECT doc_id, source, lang, topic, tokens, round(p, 6) AS probability, sampled FROM mixed
"""

_SHARE = "(1 + (1000000000::HUGEINT * ({count} + 2)) // ({total} + 2 * v))"
_DIVERGENCE = "((p - q) * (p - q) // (p + q))"

DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '{divergence.TERM}')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
vs AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
held AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
sized AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN held USING (lang, source) GROUP BY ALL),
full_p AS (SELECT lang, source, term, coalesce(n, 0) AS n, {_SHARE.format(count="coalesce(n, 0)", total="total")} AS p
  FROM sized JOIN vs USING (lang) JOIN kept USING (lang) LEFT JOIN held USING (lang, source, term)),
lang_p AS (SELECT lang, term, {_SHARE.format(count="n", total="total")} AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM held GROUP BY ALL) JOIN (SELECT lang, sum(total)::HUGEINT AS total FROM sized GROUP BY lang) USING (lang) JOIN vs USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum({_DIVERGENCE}) AS f FROM full_p x JOIN (SELECT lang, source, term, p AS q FROM full_p) y
    ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, {_DIVERGENCE}::BIGINT AS value FROM full_p JOIN lang_p USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pair
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms) WHERE rank <= 10
"""

ORACLE: dict[str, str] = {"op3_mixing": MIXING, "op5_licenses": LICENSES, "op7_line_dedup": LINE_DEDUP, "op13_divergence": DIVERGENCE}
