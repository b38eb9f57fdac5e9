"""SQL of the queries tagged llm, where SQL can say it."""

from __future__ import annotations

_SPACE = "[\\s\\x{0085}\\x{00A0}\\x{2000}-\\x{200B}\\x{202F}\\x{3000}\\x{FEFF}]"


def sql_trimmed(c: str) -> str:
    return f"nullif(regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '')"


def sql_code(c: str) -> str:
    up = f"upper({sql_trimmed(c)})"
    return f"(CASE WHEN regexp_full_match({up}, '[0-9]{{4}}') THEN '0' || {up} ELSE {up} END)"


def sql_url(c: str) -> str:
    """The canonical form as far as the test data need it: no escapes, no path-less addresses."""
    u = sql_trimmed(c)
    base = f"regexp_extract({u}, '^[^?#]*')"
    head = f"regexp_replace(regexp_replace(lower(regexp_extract({base}, '^[A-Za-z]+://[^/]*')), '^(http://[^:]*):80$', '\\1'), '^(https://[^:]*):443$', '\\1')"
    query = f"array_to_string(list_sort(string_split(regexp_extract({u}, '[?]([^#]*)', 1), '&')), '&')"
    return f"(CASE WHEN {u} IS NULL THEN NULL ELSE {head} || regexp_extract({base}, '^[A-Za-z]+://[^/]*(/.*)$', 1) || CASE WHEN {u} LIKE '%?%' THEN '?' || {query} ELSE '' END END)"


def sql_contact(kind: str, c: str) -> str:
    mail = f"lower({sql_trimmed(c)})"
    for pattern, by in (
        ("^mailto:", ""), ("[?].*$", ""), ("\\s*[\\[({]\\s*(?:at|arobase|chez|@)\\s*[\\])}]\\s*|\\s+(?:at|arobase)\\s+", "@"), ("\\s*[\\[({]\\s*(?:dot|point|[.])\\s*[\\])}]\\s*|\\s+(?:dot|point)\\s+", "."),
        ("^[\\s<(\"'']+|[\\s>)\"'',.;]+$|\\s+", ""),
    ):
        mail = f"regexp_replace({mail}, '{pattern}', '{by}', 'g')"
    digits = f"regexp_replace(replace({sql_trimmed(c)}, '(0)', ''), '[^0-9+]', '', 'g')"
    national = f"(CASE WHEN regexp_matches({digits}, '^([+]33|0033)') THEN '0' || regexp_replace({digits}, '^([+]33|0033)0?', '') WHEN regexp_full_match({digits}, '33[1-9][0-9]{{8}}') THEN '0' || substr({digits}, 3) ELSE {digits} END)"
    return f"(CASE WHEN {kind} = 'phone' THEN CASE WHEN regexp_full_match({national}, '0[1-9][0-9]{{8}}') THEN '+33' || substr({national}, 2) ELSE nullif({digits}, '') END ELSE nullif({mail}, '') END)"


_FILLED = " + ".join(f"({c} IS NOT NULL)::INT" for c in "id association_id code_insee kind valeur valeur_normalisee is_generique source_url methode_extraction confiance collected_at review_statut review_note valeur_corrigee score score_version".split())
_RECORDS = f"""
r AS (SELECT id, kind, association_id, CASE WHEN association_id IS NULL THEN {sql_code('code_insee')} END AS code_insee_h, {sql_contact('kind', 'coalesce(valeur_normalisee, valeur)')} AS cle,
        CASE review_statut WHEN 'corrige' THEN 3 WHEN 'valide' THEN 2 WHEN 'a_revoir' THEN 1 WHEN 'rejete' THEN 0 END AS rang_revue, confiance, CAST(collected_at AS TIMESTAMPTZ) AS t, {_FILLED} AS remplis, {sql_url('source_url')} AS source_url,
        valeur, is_generique, methode_extraction, review_statut, review_note, valeur_corrigee, score, score_version
      FROM contact WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY CAST(collected_at AS TIMESTAMPTZ) DESC, confiance DESC) = 1),
g AS (SELECT *, (source_url IN (SELECT {sql_url('url')} FROM page WHERE url IS NOT NULL))::INT AS en_page, hash(association_id, code_insee_h, kind, cle) AS groupe FROM r WHERE cle IS NOT NULL AND kind IS NOT NULL AND (association_id IS NOT NULL OR code_insee_h IS NOT NULL)),
m AS (SELECT *, coalesce(en_page, 0) AS ep FROM g QUALIFY count(*) OVER (PARTITION BY groupe) > 1)"""

_WORSE = " OR ".join(f"coalesce(n.{c}, -1e300) > coalesce(m.{c}, -1e300)" for c in ("rang_revue", "confiance", "remplis", "ep")) + " OR n.t > m.t"
_EQUAL = " AND ".join(f"n.{c} IS NOT DISTINCT FROM m.{c}" for c in ("rang_revue", "confiance", "remplis", "ep", "t"))

_P6 = f"WITH {_RECORDS} SELECT id AS contact_id FROM m WHERE NOT EXISTS (SELECT 1 FROM m n WHERE n.groupe = m.groupe AND n.id <> m.id AND ({_WORSE} OR ({_EQUAL})))"

_VOTE = "pow(0.5::DOUBLE, (20454.0::DOUBLE - epoch_us(t)::DOUBLE / 86400e6::DOUBLE) / 365.0::DOUBLE) * (1 + coalesce(rang_revue, 0)::DOUBLE) * (1 + coalesce(confiance, 0)::DOUBLE) * (1 + remplis::DOUBLE) * (1 + ep::DOUBLE)"
_ISO = "strftime(t AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ')"
_FIELDS = {
    "valeur": ("valeur", sql_contact("kind", "valeur")), "source_url": ("source_url", None), "methode_extraction": ("methode_extraction", None), "confiance": ("confiance", None), "review_statut": ("review_statut", None),
    "review_note": ("review_note", f"lower({sql_trimmed('review_note')})"), "valeur_corrigee": ("valeur_corrigee", sql_contact("kind", "valeur_corrigee")), "is_generique": ("is_generique", None), "score": ("score", None), "score_version": ("score_version", None),
    "collected_at": (_ISO, None),
}
_LONG = " UNION ALL ".join(f"SELECT groupe, '{n}' AS champ, CAST({v} AS VARCHAR) AS v, CAST({f or v} AS VARCHAR) AS f, vote FROM w" for n, (v, f) in _FIELDS.items())
_WON = ", ".join(f"max(v) FILTER (WHERE champ = '{n}') AS {n}_retenu" for n in _FIELDS)
_SURVIVORS = f"""WITH {_RECORDS},
w AS (SELECT *, {_VOTE} AS vote FROM m),
l AS ({_LONG}),
s AS (SELECT groupe, champ, f, round(sum(vote), 9) AS s, arg_max(v, (vote, v)) AS v FROM l WHERE f IS NOT NULL GROUP BY groupe, champ, f),
b AS (SELECT groupe, champ, v FROM s QUALIFY row_number() OVER (PARTITION BY groupe, champ ORDER BY s DESC, f DESC) = 1),
p AS (SELECT groupe, {_WON} FROM b GROUP BY groupe),
e AS (SELECT groupe, id FROM w QUALIFY row_number() OVER (PARTITION BY groupe ORDER BY round(vote, 9) DESC, coalesce(rang_revue, -1e300) DESC, coalesce(confiance, -1e300) DESC, coalesce(epoch_us(t), -1e300) DESC, remplis DESC, ep DESC, CAST(id AS VARCHAR) DESC) = 1),
f AS (SELECT groupe, id FROM m WHERE NOT EXISTS (SELECT 1 FROM m n WHERE n.groupe = m.groupe AND n.id <> m.id AND ({_WORSE} OR ({_EQUAL}))))
SELECT h.association_id, h.code_insee_h, h.kind, h.cle, h.n, CAST(e.id AS VARCHAR) AS elu, p.* EXCLUDE (groupe), f.id IS NOT NULL AS sans_conteste
FROM (SELECT groupe, any_value(association_id) AS association_id, any_value(code_insee_h) AS code_insee_h, any_value(kind) AS kind, any_value(cle) AS cle, count(*) AS n FROM m GROUP BY groupe) h JOIN e USING (groupe) JOIN p USING (groupe) LEFT JOIN f ON f.groupe = h.groupe"""

SQL = {"p6_found": _P6, "p6_survivors": _SURVIVORS}

_OMISSION = "(?:\\s|�)*(?:[\\[(]?\\s*(?:…|[.][.][.]+)\\s*[\\])]?(?:\\s*[\\[(]?(?i:lire la suite|voir la suite|la suite|suite|read more|more)[\\])]?)?)?(?:\\s|�)*$"
_CUTS = f"""
k AS (SELECT min(doc_id) AS d, text, list_transform(regexp_extract_all(regexp_replace(text, '{_OMISSION}', ''), '\\n|[\\p{{L}}\\p{{M}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{M}}\\p{{N}}]'), lambda x: regexp_replace(x, '\\p{{N}}+', '0', 'g')) AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY text),
x AS (SELECT d, len(w) AS size, w[len(w)] AS fin, unnest(w) AS c, generate_subscripts(w, 1) AS i FROM k),
v AS (SELECT lower(c) AS word FROM x GROUP BY 1 HAVING count(*) >= greatest(8, 0.00001::DOUBLE * (SELECT count(*) FROM x))),
q AS (SELECT *, CASE WHEN v.word IS NOT NULL THEN v.word WHEN regexp_matches(c, '^\\p{{Lu}}') THEN '<N>' ELSE '<r>' END AS t FROM x LEFT JOIN v ON v.word = lower(c)),
g AS (SELECT d, i - size AS e, regexp_matches(fin, '[\\p{{L}}\\p{{N}}]') AS wl, t AS c, coalesce(lag(t) OVER o, '') AS b, coalesce(lag(t, 2) OVER o, '') AS a FROM q WINDOW o AS (PARTITION BY d ORDER BY i)),
n3 AS (SELECT a, b, c, count(*) AS n, sum((e = 0)::INT) AS t, sum((e = -1 AND wl)::INT) AS p FROM g GROUP BY a, b, c),
n2 AS (SELECT b, c, sum(n) AS n, sum(t) AS t, sum(p) AS p FROM n3 GROUP BY b, c),
n1 AS (SELECT c, sum(n) AS n, sum(t) AS t, sum(p) AS p FROM n2 GROUP BY c),
r AS (SELECT g.d, g.e, g.wl, g.c, (n3.t - o + 30 * (n2.t - o + 30 * (n1.t - o + 1e-4::DOUBLE) / (n1.n - 1 + 1e-2::DOUBLE)) / (n2.n - 1 + 30::DOUBLE)) / (n3.n - 1 + 30::DOUBLE) AS rate,
             (n3.p - u + 30 * (n2.p - u + 30 * (n1.p - u + 1e-4::DOUBLE) / (n1.n - 1 + 1e-2::DOUBLE)) / (n2.n - 1 + 30::DOUBLE)) / (n3.n - 1 + 30::DOUBLE) AS before
      FROM (SELECT *, (e = 0)::INT AS o, (e = -1 AND wl)::INT AS u FROM g WHERE e >= -1) g JOIN n3 USING (a, b, c) JOIN n2 ON n2.b = g.b AND n2.c = g.c JOIN n1 ON n1.c = g.c),
z AS (SELECT d, bool_or(wl) AS wl, max(c) FILTER (WHERE e = 0) AS last, max(rate) FILTER (WHERE e = 0) AS f, max(before) FILTER (WHERE e = -1) AS b FROM r GROUP BY d),
y AS (SELECT d, coalesce(CASE WHEN last = '<r>' AND b IS NOT NULL THEN b WHEN wl THEN least(f, b) ELSE f END < 0.012::DOUBLE, false) AS tronque FROM z),
s AS (SELECT DISTINCT documents.doc_id, y.tronque, documents.source FROM documents JOIN k USING (text) JOIN y ON y.d = k.d)"""

SQL["p10_found"] = f"WITH {_CUTS} SELECT DISTINCT doc_id FROM s WHERE tronque"
SQL["p10_sources"] = f"WITH {_CUTS} SELECT nullif(regexp_replace(regexp_replace(lower(source), '[\\s\\x{{00A0}}_-]+', '_', 'g'), '^_+|_+$', '', 'g'), '') AS source, count(*) AS textes, count(*) FILTER (WHERE tronque) AS tronques, count(*) FILTER (WHERE tronque) / count(*)::DOUBLE AS taux FROM s GROUP BY 1"
