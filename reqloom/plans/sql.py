"""DuckDB SQL that says what the queries return; common parts first."""

from __future__ import annotations

from reqloom.functions.text import CATEGORY_PATTERNS, LANGUAGE_WORDS
from reqloom.operators.sentiment import NEGATIVE, POSITIVE
from reqloom.operators.terms import STOP_WORDS

#: RE2 has no look-ahead; this says the same.
_NO_LOOKAHEAD = ("galaxy (?!book)", "galaxy (?:$|[^b]|b(?:$|[^o])|bo(?:$|[^o])|boo(?:$|[^k]))")
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def cleaned(split: str) -> str:
    """Runs of three or more collapsed to two in a list of characters, then white space."""
    kept = f"list_filter({split}, lambda x, i: NOT (x <> chr(10) AND i > 2 AND {split}[i - 1] = x AND {split}[i - 2] = x))"
    return f"trim(regexp_replace(array_to_string({kept}, ''), '{SPACE}', ' ', 'g'))"


WORDS = "list_filter(string_split(message, ' '), lambda w: w <> '')"

CLEAN = f"""
src AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS post_id, text, lang, source, string_split(text, '') AS l
  FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS copy FROM documents WHERE text IS NOT NULL AND regexp_replace(text, '{SPACE}', '', 'g') <> '')
  WHERE copy = 1
),
clean AS (SELECT doc_id, post_id, text, lang, source, {cleaned("l")} AS message FROM src)"""

CORPUS = f"""{CLEAN},
corpus AS (SELECT * FROM clean WHERE lang = 'en' AND length(message) >= 500 AND len({WORDS}) >= 100)"""

SENTENCES = rf"""{CORPUS},
split AS (
  SELECT *, list_filter(list_transform(string_split(regexp_replace(message, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '') AS a
  FROM corpus
),
pieces AS (SELECT *, unnest(range(len(a))) AS sent_idx FROM split),
flat AS (
  SELECT post_id || '_' || sent_idx AS sent_id, post_id, source, source AS product_category, sent_idx, a[sent_idx + 1] AS sentence,
         array_to_string(a[greatest(sent_idx, 1) : least(sent_idx + 2, len(a))], ' ') AS context
  FROM pieces
),
sent AS (
  SELECT *, len(list_filter(string_split(sentence, ' '), lambda w: w <> '')) AS n_words, count(*) OVER (PARTITION BY sentence) > 1 AS is_dup_exact
  FROM flat
),
usable AS (SELECT * FROM sent WHERE n_words >= 5 AND NOT is_dup_exact)"""


def tokens(text: str, stops=()) -> str:
    found = rf"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{2,}}'))"
    return f"list_filter({found}, lambda x: NOT list_contains({listed(stops)}, x))" if stops else found


TERMS = f"""{SENTENCES},
words AS (SELECT sent_id, unnest({tokens("sentence", STOP_WORDS)}) AS term FROM usable),
tf AS (SELECT sent_id, term, count(*) AS tf FROM words GROUP BY ALL)"""

VOCABULARY = f"""{TERMS},
counted AS (
  SELECT term, count(*) AS df, sum(tf) AS tf FROM tf GROUP BY term
  HAVING count(*) >= 20 AND count(*) <= 0.5 * (SELECT count(*) FROM usable)
),
vocab AS (
  SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, df, CAST(tf AS BIGINT) AS tf
  FROM (SELECT * FROM counted ORDER BY tf DESC, term LIMIT 12000)
)"""


def _bytes(first: int, last: int, least: int) -> str:
    part = "CAST(CAST('0x' || substr(md5(sent_id), {}, 2) AS INT) AS DOUBLE)"
    each = (part.format(2 * i + 1) for i in range(first, last))
    return "[" + ", ".join(f"CASE WHEN {p} < {least} THEN 0.0 ELSE {p} END" for p in each) + "]"


def _dominant(w: str) -> str:
    return f"CASE WHEN list_sum({w}) > 0 THEN list_position({w}, list_max({w})) - 1 ELSE -1 END"


WEIGHED = f"""{SENTENCES},
raw AS (SELECT *, {_bytes(0, 4, 100)} AS g, {_bytes(4, 7, 120)} AS l FROM usable),
weighed AS (
  SELECT * EXCLUDE (g, l), {_dominant("g")} AS topic_id, {_dominant("l")} AS local_topic_id,
         CASE WHEN list_sum(g) > 0 THEN list_max(g) / list_sum(g) ELSE 0.0 END AS topic_weight,
         CASE WHEN list_sum(l) > 0 THEN list_max(l) / list_sum(l) ELSE 0.0 END AS local_topic_weight
  FROM raw
)"""

EVIDENCE = rf"""{WEIGHED},
cued AS (
  SELECT *, topic_weight * local_topic_weight AS topic_score,
         CAST(regexp_matches(sentence, '\bthis\b', 'i') AS INT) + CAST(regexp_matches(sentence, '\bfor the\b', 'i') AS INT) AS n_ask,
         CAST(regexp_matches(sentence, '\bwas\b', 'i') AS INT) + CAST(regexp_matches(sentence, '\bnot\b', 'i') AS INT) + CAST(regexp_matches(sentence, '\bwhich\w*\b', 'i') AS INT) AS n_moan
  FROM weighed WHERE topic_id IN (0, 2, 3)
),
evidence AS (
  SELECT *, topic_id AS global_topic_id, n_ask + n_moan > 0 AS lex_hit, n_ask + n_moan AS lex_n,
         CASE WHEN n_ask > 0 THEN 'pedido' WHEN n_moan > 0 THEN 'queixa' ELSE 'outro' END AS intent_hint
  FROM cued
)"""

_TIE = "md5('42:' || sent_id), sent_id"
RANKED = f"""{EVIDENCE},
ranked AS (
  SELECT 'topico' AS ranking, row_number() OVER (ORDER BY topic_score DESC, {_TIE}) AS rank, sent_id FROM evidence
  UNION ALL SELECT 'lexical', row_number() OVER (ORDER BY lex_hit DESC, lex_n DESC, {_TIE}), sent_id FROM evidence
  UNION ALL SELECT 'topico_lexical', row_number() OVER (ORDER BY lex_hit DESC, lex_n DESC, topic_score DESC, {_TIE}), sent_id FROM evidence
  UNION ALL SELECT 'aleatoria', row_number() OVER (ORDER BY {_TIE}), sent_id FROM evidence
)"""

SAMPLED = f"""{RANKED},
top AS (
  SELECT sent_id, min_by(ranking, CASE ranking WHEN 'topico' THEN 0 WHEN 'lexical' THEN 1 ELSE 2 END) AS selection_source
  FROM ranked WHERE ranking <> 'aleatoria' AND rank <= 50 GROUP BY sent_id
),
drawn AS (
  SELECT sent_id, 'aleatoria' AS selection_source FROM ranked
  WHERE ranking = 'aleatoria' AND sent_id NOT IN (SELECT sent_id FROM top) ORDER BY rank LIMIT 100
),
review AS (
  SELECT *, row_number() OVER (ORDER BY md5('43:' || sent_id), sent_id) AS review_id
  FROM (SELECT * FROM top UNION ALL SELECT * FROM drawn)
),
ranks AS (
  SELECT sent_id, max(rank) FILTER (ranking = 'aleatoria') AS rank_aleatoria, max(rank) FILTER (ranking = 'lexical') AS rank_lexical,
         max(rank) FILTER (ranking = 'topico') AS rank_topico, max(rank) FILTER (ranking = 'topico_lexical') AS rank_topico_lexical
  FROM ranked GROUP BY sent_id
),
origin AS (SELECT review_id, selection_source, evidence.*, ranks.* EXCLUDE (sent_id) FROM review JOIN evidence USING (sent_id) JOIN ranks USING (sent_id)),
labelled AS (
  SELECT *, CASE WHEN b < 100 THEN 'sim' WHEN b < 200 THEN 'nao' ELSE 'incerto' END AS requirement_candidate,
         row_number() OVER (PARTITION BY selection_source ORDER BY review_id) AS k
  FROM (SELECT *, CAST('0x' || substr(md5(sent_id), 15, 2) AS INT) AS b FROM origin)
)"""

_POS = f"len(list_filter(t, lambda x: list_contains({listed(POSITIVE)}, x)))"
_NEG = f"len(list_filter(t, lambda x: list_contains({listed(NEGATIVE)}, x)))"


def sentiment(of: str, text: str = "sentence") -> str:
    """CTEs ``felt``: the rows of ``of`` with label and raw scores."""
    return f"""
cues AS (SELECT *, {tokens(text)} AS t FROM {of}),
counted_cues AS (SELECT * EXCLUDE (t), {_POS} AS np, {_NEG} AS nn FROM cues),
felt AS (
  SELECT * EXCLUDE (np, nn), (2 * np + 0.5) / (2.0 + 2 * np + 2 * nn) AS p, 1.0 / (2.0 + 2 * np + 2 * nn) AS u, (2 * nn + 0.5) / (2.0 + 2 * np + 2 * nn) AS n,
         CASE WHEN round((2 * np + 0.5) / (2.0 + 2 * np + 2 * nn), 4) >= round(greatest(1.0, 2 * nn + 0.5) / (2.0 + 2 * np + 2 * nn), 4) THEN 'Positiva'
              WHEN 1.0 >= 2 * nn + 0.5 THEN 'Neutra' ELSE 'Negativa' END AS sentiment
  FROM counted_cues
)"""


def category(title: str) -> str:
    """The product category of a lower-cased title; letters that aren't ASCII count as letters at word ends."""
    plain = f"regexp_replace(lower({title}), '[^\\x00-\\x7F]', 'q', 'g')"
    cases = "\n".join(f"WHEN regexp_matches({plain}, {quoted(p.replace(*_NO_LOOKAHEAD))}) THEN {quoted(c)}" for c, p in CATEGORY_PATTERNS)
    return f"CASE {cases} ELSE 'other' END"


def language(words: str) -> str:
    votes = {name: f"len(list_filter({words}, lambda w: list_contains({listed(own)}, w)))" for name, own in LANGUAGE_WORDS.items()}
    best = f"greatest({', '.join(votes.values())})"
    cases = " ".join(f"WHEN {n} = {best} THEN {quoted(name)}" for name, n in votes.items())
    return f"CASE WHEN len({words}) < 5 OR {best} = 0 THEN NULL {cases} END"
