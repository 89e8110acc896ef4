"""DuckDB SQL for the queries that SQL can express. Trained models, SimHash, parsing and tokenizers are beyond it."""

from __future__ import annotations

from math import ceil

from rastrel.llm.license_scan import CONTAINMENT, PHRASES, TEMPLATES, block_span, words_of
from rastrel.llm.quality_rules import STOP_WORDS

_WORDS = r"""w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0d]+'), lambda x: x <> '') AS ws FROM documents)"""

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_SUBSTRING = f"""WITH {_WORDS},
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
fd AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM win),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM fd WHERE f < doc_id),
gone AS (SELECT doc_id, list(p) AS ps FROM cov GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256 FROM w LEFT JOIN gone USING (doc_id)"""
_RULES = rf"""WITH {_WORDS},
b AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  length(t) - length(replace(t, '!', '')) AS shouts, list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '[ \x09-\x0d]', '', 'g')) > 0) AS ls,
  len(list_filter(ws, lambda x: lower(rtrim(x, '.,;:')) IN ({_STOPS}))) AS stops FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS rep FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY 1),
m AS (SELECT b.*, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep, 0) AS n_repeat_words FROM b LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(word_chars / n_words BETWEEN 2 AND 16 AND n_symbols / n_words <= 0.1 AND shouts / n_words <= 0.1 AND stops / n_words >= 0.02
    AND n_dup_lines / nullif(len(ls), 0) <= 0.5, TRUE) AS kept FROM f"""
_CHAT = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + length(role) + length(text) + len(regexp_extract_all(text, '\\|###|</turn>'))) AS BIGINT) AS formatted_chars FROM t GROUP BY 1"""


def _license() -> str:
    wanted, sizes, wider = [], [], []
    split = [(label, words_of(text), {w.decode() for w in words_of(names)}) for label, text, names in TEMPLATES]
    sets = [{w.decode() for w in words} for _, words, _ in split]
    for k, (label, words, names) in enumerate(split):
        wanted += [f"({k}, '{w}', {w in names})" for w in sorted(sets[k])]
        sizes.append(f"({k}, '{label}', {len(sets[k])}, {ceil(CONTAINMENT * len(sets[k]) - 1e-9)}, {block_span(len(words))}, {len(names)})")
        wider += [f"({k}, {o})" for o in range(len(sets)) if sets[k] < sets[o]]
    places = " UNION ALL ".join(
        f"SELECT doc_id, unnest(list_filter(range(len(ws)), lambda p: ws[p + 1:p + {len(phrase.split())}] = {phrase.split()})) AS p, '{label}' AS label FROM w" for phrase, label in PHRASES
    )
    return rf"""WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS ws FROM documents),
pl AS MATERIALIZED ({places}),
ba AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word FROM pl GROUP BY 1),
tp AS (SELECT * FROM (VALUES {", ".join(wanted)}) v(t, word, named)),
tn AS (SELECT * FROM (VALUES {", ".join(sizes)}) v(t, label, n, need, span, n_named)),
wi AS (SELECT * FROM (VALUES {", ".join(wider)}) v(t, o)),
po AS MATERIALIZED (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM w),
hi AS MATERIALIZED (SELECT doc_id, t, word, named, p FROM po JOIN tp USING (word)),
ca AS (SELECT doc_id, t FROM hi JOIN tn USING (t) GROUP BY doc_id, t, need, n_named HAVING count(DISTINCT word) >= need AND count(DISTINCT word) FILTER (named) = n_named),
ch AS MATERIALIZED (SELECT hi.* FROM hi JOIN ca USING (doc_id, t)),
bl AS (SELECT a.doc_id, a.t, a.p AS first, max(b.p) AS last, count(DISTINCT b.word) AS c, count(DISTINCT b.word) FILTER (b.named) AS cn
  FROM ch a JOIN tn USING (t) JOIN ch b ON b.doc_id = a.doc_id AND b.t = a.t AND b.p BETWEEN a.p AND a.p + span - 1 GROUP BY ALL),
mb AS MATERIALIZED (SELECT doc_id, t, label, first, last, c / n AS share FROM bl JOIN tn USING (t) WHERE c >= need AND cn = n_named),
ma AS (SELECT doc_id, label, max(share) AS share FROM mb WHERE NOT EXISTS (SELECT 1 FROM wi JOIN mb x ON x.t = wi.o
  WHERE wi.t = mb.t AND x.doc_id = mb.doc_id AND x.first <= mb.last AND mb.first <= x.last) GROUP BY ALL),
la AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM pl UNION ALL SELECT doc_id, label FROM ma) GROUP BY 1),
lb AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM pl GROUP BY 1),
sc AS (SELECT doc_id, max(share) AS share FROM ma GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(share, 0) END AS DOUBLE) AS score
FROM w LEFT JOIN ba USING (doc_id) LEFT JOIN la USING (doc_id) LEFT JOIN lb USING (doc_id) LEFT JOIN sc USING (doc_id)"""


SQL = {"op1_substring_dedup": _SUBSTRING, "op4_chat_format": _CHAT, "op5_quality_rules": _RULES, "op10_license_scan": _license()}
