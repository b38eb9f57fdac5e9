"""Texts cut off before their end, by word trigrams inside texts and at their ends. Pure SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regesta.session import materialise

#: A mark of omission with the words that may follow it; it is taken off before the end of a text is looked at.
OMISSION = r"(?:\\s|�)*(?:[\\[(]?\\s*(?:…|\\.\\.\\.+)\\s*[\\])]?(?:\\s*[\\[(]?(?i:lire la suite|voir la suite|la suite|suite|read more|more)[\\])]?)?)?(?:\\s|�)*$"

# equal texts count once; doc_id is that of the first of them
_TOKENS = """
SELECT doc_id, h1, h2, transform(regexp_extract_all(regexp_replace(text, '@omission', ''), '(\\\\n|[\\\\p{{L}}\\\\p{{M}}\\\\p{{N}}]+|[^\\\\s\\\\p{{L}}\\\\p{{M}}\\\\p{{N}}])', 1),
                         x -> regexp_replace(x, '\\\\p{{N}}+', '0')) AS w
FROM (SELECT min(doc_id) AS doc_id, xxhash64(text) AS h1, hash(text) AS h2, text FROM {docs} WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY text)"""

_COPIES = "SELECT DISTINCT doc_id, xxhash64(text) AS h1, hash(text) AS h2 FROM {docs} WHERE text IS NOT NULL AND doc_id IS NOT NULL"

_VOCABULARY = """
SELECT word FROM (SELECT lower(x) AS word, count(*) AS n FROM {tokens} LATERAL VIEW explode(w) AS x GROUP BY lower(x))
WHERE n >= greatest(@least, @share * (SELECT sum(size(w)) FROM {tokens}))"""

# each position of a text with its trigram; a word outside the vocabulary counts by its kind only
_TRIGRAMS = """
SELECT doc_id, i - size AS at_end, last RLIKE '[\\\\p{{L}}\\\\p{{N}}]' AS word_last,
       CASE WHEN a = '' THEN '' WHEN va.word IS NOT NULL THEN va.word WHEN a RLIKE '^\\\\p{{Lu}}' THEN '<N>' ELSE '<r>' END AS a,
       CASE WHEN b = '' THEN '' WHEN vb.word IS NOT NULL THEN vb.word WHEN b RLIKE '^\\\\p{{Lu}}' THEN '<N>' ELSE '<r>' END AS b,
       CASE WHEN vc.word IS NOT NULL THEN vc.word WHEN c RLIKE '^\\\\p{{Lu}}' THEN '<N>' ELSE '<r>' END AS c
FROM (SELECT doc_id, w[size(w) - 1] AS last, size(w) AS size, i + 1 AS i, CASE WHEN i < 2 THEN '' ELSE w[i - 2] END AS a, CASE WHEN i < 1 THEN '' ELSE w[i - 1] END AS b, w[i] AS c FROM {tokens} LATERAL VIEW explode(@places) AS i WHERE size(w) > 0)
LEFT JOIN {vocabulary} AS va ON va.word = lower(a) LEFT JOIN {vocabulary} AS vb ON vb.word = lower(b) LEFT JOIN {vocabulary} AS vc ON vc.word = lower(c)"""

#: All places of a text, and its last two.
_ALL, _LAST = "sequence(0, greatest(size(w) - 1, 0))", "slice(sequence(greatest(size(w) - 2, 0), greatest(size(w) - 1, 0)), 1, 2)"

_COUNTS = "SELECT a, b, c, count(*) AS n, count_if(at_end = 0) AS t, count_if(at_end = -1 AND word_last) AS p FROM {trigrams} GROUP BY a, b, c"
_BIGRAMS = "SELECT b, c, sum(n) AS n, sum(t) AS t, sum(p) AS p FROM {counts} GROUP BY b, c"
_UNIGRAMS = "SELECT c, sum(n) AS n, sum(t) AS t, sum(p) AS p FROM {bigrams} GROUP BY c"

# how often what stands at the end of a text (or, where that is no known word, just before it) stands there at all;
# each rate leans on that of the shorter context, and the text itself is not counted
_ENDS = """
SELECT doc_id, max(word_last) AS word_last, max(CASE WHEN at_end = 0 THEN c END) AS last, max(CASE WHEN at_end = 0 THEN rate END) AS final_rate, max(CASE WHEN at_end = 0 THEN inside END) AS inside,
       max(CASE WHEN at_end = -1 THEN before_rate END) AS before_rate
FROM (
  SELECT doc_id, word_last, at_end, c, n3 - 1 AS inside,
         (t3 - own + @weight * (t2 - own + @weight * (t1 - own + 1e-4) / (n1 - 1 + 1e-2)) / (n2 - 1 + @weight)) / (n3 - 1 + @weight) AS rate,
         (p3 - pen + @weight * (p2 - pen + @weight * (p1 - pen + 1e-4) / (n1 - 1 + 1e-2)) / (n2 - 1 + @weight)) / (n3 - 1 + @weight) AS before_rate
  FROM (SELECT e.doc_id, e.word_last, e.at_end, e.c, CAST(e.at_end = 0 AS INT) AS own, CAST(e.at_end = -1 AND e.word_last AS INT) AS pen, c3.n AS n3, c3.t AS t3, c3.p AS p3, c2.n AS n2, c2.t AS t2, c2.p AS p2, c1.n AS n1, c1.t AS t1, c1.p AS p1
        FROM {trigrams} AS e
        JOIN {counts} AS c3 ON c3.a = e.a AND c3.b = e.b AND c3.c = e.c JOIN {bigrams} AS c2 ON c2.b = e.b AND c2.c = e.c JOIN {unigrams} AS c1 ON c1.c = e.c))
GROUP BY doc_id"""

_VERDICT = """
SELECT doc_id, last, inside, final_rate, before_rate,
       coalesce(CASE WHEN last = '<r>' AND before_rate IS NOT NULL THEN before_rate WHEN word_last THEN least(final_rate, before_rate) ELSE final_rate END < @threshold, false) AS tronque
FROM {ends}"""


def truncated(docs: DataFrame, *, threshold: float = 0.012, weight: float = 30.0, least: int = 8, share: float = 1e-5) -> DataFrame:
    """For each text: does it end where texts of this corpus do not end?

    docs: doc_id, text. Every text is split into words, numbers (all alike), punctuation marks and line ends; a mark
    of omission at the very end is left out. Words seen at least `least` times and in a share of the tokens (so at most
    1/share of them: the bound of their broadcast) keep their form, all others count as an unknown name or unknown word.
    Over all positions of all texts, trigrams are counted inside and at ends. The rate at which a text's final trigram is
    final leans, with a weight, on that of its final bigram, and this on that of its final token: frequent inside and almost never
    final means cut. If the last token is a word it may be half of one: then the trigram before it counts as well, by how often
    one last word follows it, and for an unknown word it alone. Equal texts count once and share their verdict.

    Result: doc_id, last, inside (other places of the final trigram), final_rate, before_rate, tronque. A null or empty text has no end
    and is not in the result; a text of one token is judged by that token. Empty table: no rows.
    """
    spark = docs.sparkSession
    tokens = materialise(spark.sql(_TOKENS.replace("@omission", OMISSION), docs=docs.select("doc_id", "text")), "tokens")
    vocabulary = spark.sql(_VOCABULARY.replace("@least", str(least)).replace("@share", repr(share)), tokens=tokens).hint("broadcast")
    trigrams, finals = (spark.sql(_TRIGRAMS.replace("@places", places), tokens=tokens, vocabulary=vocabulary) for places in (_ALL, _LAST))
    counts = materialise(spark.sql(_COUNTS, trigrams=trigrams), "trigrams")
    bigrams = spark.sql(_BIGRAMS, counts=counts)
    unigrams = spark.sql(_UNIGRAMS, bigrams=bigrams)
    ends = spark.sql(_ENDS.replace("@weight", repr(weight)), trigrams=finals, counts=counts, bigrams=bigrams, unigrams=unigrams)
    verdicts = spark.sql(_VERDICT.replace("@threshold", repr(threshold)), ends=ends)
    firsts = tokens.select(F.col("doc_id").alias("first"), "h1", "h2")
    copies = spark.sql(_COPIES, docs=docs.select("doc_id", "text"))
    return spark.sql(
        """SELECT c.doc_id, v.last, v.inside, v.final_rate, v.before_rate, v.tronque
           FROM {copies} AS c JOIN {firsts} AS f ON f.h1 = c.h1 AND f.h2 = c.h2 JOIN {verdicts} AS v ON v.doc_id = f.first""",
        copies=copies, firsts=firsts, verdicts=verdicts,
    )


def truncation_by_source(verdicts: DataFrame, docs: DataFrame) -> DataFrame:
    """How often each source cuts its texts: source, textes, tronques, taux. docs: doc_id, source (null is a source of its own)."""
    return docs.sparkSession.sql(
        """SELECT source, count(*) AS textes, count_if(tronque) AS tronques, count_if(tronque) / count(*) AS taux
           FROM {docs} AS d JOIN {verdicts} AS v ON v.doc_id = d.doc_id GROUP BY source""",
        docs=docs, verdicts=verdicts,
    )
