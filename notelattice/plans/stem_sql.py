"""The stemmer of the text index restated in DuckDB SQL, a table expression for each of its steps."""

from __future__ import annotations

from notelattice.functions import stem as rules

V = "[aeiouy]"
C = "[^aeiouy]"
SHORT = f"({C}{V}[^aeiouywxY]|^{V}{C})$"


def _text(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _longest(endings) -> str:
    """The longest of these endings that w has, or an empty text."""
    cases = " ".join(f"WHEN ends_with(w, '{e}') THEN '{e}'" for e in sorted(endings, key=lambda e: (-len(e), e)))
    return f"CASE {cases} ELSE '' END"


def _map(table: dict[str, str]) -> str:
    return "CASE e " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _step(name: str, source: str, endings, then: str) -> str:
    """A step that finds the longest ending e, with b before it, and puts a new w."""
    return f"""{name} AS (SELECT word, done, r1, r2, CASE WHEN done THEN w ELSE {then} END AS w FROM
 (SELECT *, substr(w, 1, length(w) - length(e)) AS b FROM (SELECT *, {_longest(endings)} AS e FROM {source})))"""


def stem_ctes(words: str) -> str:
    """stems (word, stem) of the rows of a query with a column `word`."""
    irregular = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.IRREGULAR.items())
    undouble = f"CASE WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e' WHEN substr(b, -2) IN ({_text(rules.DOUBLES)}) THEN substr(b, 1, length(b) - 1) WHEN length(b) <= r1 AND regexp_matches(b, '{SHORT}') THEN b || 'e' ELSE b END"
    return f"""s0 AS (SELECT word, length(word) < 3 OR word IN ({_text(rules.IRREGULAR)}) AS done, CASE word {irregular} ELSE CASE WHEN length(word) < 3 THEN word ELSE regexp_replace(CASE WHEN word[1] = 'y' THEN 'Y' || substr(word, 2) ELSE word END, '({V})y', '\\1Y', 'g') END END AS w FROM {words}),
s1 AS (SELECT *, CASE WHEN regexp_matches(w, '^({'|'.join(rules.WHOLE_PREFIXES)})') THEN length(regexp_extract(w, '^({'|'.join(rules.WHOLE_PREFIXES)})'))
 WHEN regexp_matches(w, '{V}{C}') THEN length(regexp_extract(w, '^.*?{V}{C}')) ELSE length(w) END AS r1 FROM s0),
s2 AS (SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), '{V}{C}') THEN r1 + length(regexp_extract(substr(w, r1 + 1), '^.*?{V}{C}')) ELSE length(w) END AS r2 FROM s1),
{_step('s3', 's2', ('sses', 'ied', 'ies', 'us', 'ss', 's'), f"CASE WHEN e = 'sses' THEN b || 'ss' WHEN e IN ('ied', 'ies') THEN b || CASE WHEN length(b) > 1 THEN 'i' ELSE 'ie' END WHEN e = 's' AND regexp_matches(substr(b, 1, length(b) - 1), '{V}') THEN b ELSE w END")},
s4 AS (SELECT word, done OR w IN ({_text(rules.KEPT_AFTER_PLURALS)}) AS done, r1, r2, w FROM s3),
{_step('s5', 's4', ('eed', 'eedly', 'ed', 'edly', 'ing', 'ingly'), f"CASE WHEN e = '' THEN w WHEN e IN ('eed', 'eedly') THEN CASE WHEN length(b) >= r1 THEN b || 'ee' ELSE w END WHEN regexp_matches(b, '{V}') THEN {undouble} ELSE w END")},
s6 AS (SELECT word, done, r1, r2, CASE WHEN NOT done AND length(w) > 2 AND regexp_matches(w, '{C}[yY]$') THEN substr(w, 1, length(w) - 1) || 'i' ELSE w END AS w FROM s5),
{_step('s7', 's6', rules.DERIVED, f"CASE WHEN e = '' OR length(b) < r1 OR e = 'ogi' AND NOT ends_with(b, 'l') OR e = 'li' AND NOT regexp_matches(b, '[{rules.BEFORE_LI}]$') THEN w ELSE b || {_map(rules.DERIVED)} END")},
{_step('s8', 's7', rules.REDUCED, f"CASE WHEN e = '' OR length(b) < r1 OR e = 'ative' AND length(b) < r2 THEN w ELSE b || {_map(rules.REDUCED)} END")},
{_step('s9', 's8', rules.DROPPED, "CASE WHEN e = '' OR length(b) < r2 OR e = 'ion' AND NOT regexp_matches(b, '[st]$') THEN w ELSE b END")},
{_step('s10', 's9', ('e', 'll'), f"CASE WHEN e = 'e' AND (length(w) > r2 OR length(w) > r1 AND NOT regexp_matches(b, '{SHORT}')) THEN b WHEN e = 'll' AND length(w) > r2 THEN b || 'l' ELSE w END")},
stems AS (SELECT word, CASE WHEN done AND length(word) < 3 THEN word ELSE replace(w, 'Y', 'y') END AS stem FROM s10)"""
