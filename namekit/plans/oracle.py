"""Shared DuckDB SQL fragments for the oracle queries (independent SQL text of
the same semantics, used by the correctness gate)."""

from __future__ import annotations

from ..functions.blocks import block_sql
from ..sources.tables import NAMES_SQL

WS = (r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def strip_paren(x: str) -> str:
    return strip(f"regexp_replace({x}, '\\(.*\\)', '', 'g')")


def with_names(*ctes: str) -> str:
    body = ",\n".join([NAMES_SQL.strip()] + [c.strip() for c in ctes])
    return "WITH " + body + "\n"


def char_rows(src: str, text: str, keys: str, strip_text: bool = False,
              ignore_punct: bool = False, ignore_num: bool = False, name: str = "ch") -> str:
    """CTE: one row per counted character (keys..., block, pos)."""
    t = strip(text) if strip_text else text
    conds = ["c <> ''"]
    if ignore_punct:
        conds.append("NOT regexp_matches(c, '^[\\p{P}\\p{S}]$')")
    if ignore_num:
        conds.append("NOT regexp_matches(c, '^\\p{N}$')")
    return f"""{name} AS (
  SELECT {keys}, {block_sql('unicode(c)')} AS block, pos FROM (
    SELECT {keys}, unnest(string_split({t}, '')) AS c,
           generate_subscripts(string_split({t}, ''), 1) AS pos
    FROM {src}) WHERE {' AND '.join(conds)}
)"""


def mode_rows(chars: str, keys: str, name: str = "md") -> str:
    """CTE: most common block per key (ties -> first seen)."""
    return f"""{name} AS (
  SELECT {keys}, block FROM (
    SELECT {keys}, block, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, first_pos) AS rn
    FROM (SELECT {keys}, block, count(*) AS n, min(pos) AS first_pos FROM {chars} GROUP BY {keys}, block))
  WHERE rn = 1
)"""


# Fixed small lookup used by the reports (language code -> long name).
LANGUAGE_NAMES = {"en": "English", "fr": "French", "de": "German", "es": "Spanish"}


def language_lookup_sql(name: str = "lookup") -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in LANGUAGE_NAMES.items())
    return f"{name}(code, name) AS (VALUES {rows})"


def tokens(x: str) -> str:
    """Python ``str.split()`` as DuckDB SQL."""
    s = strip(x)
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({s}, '{WS}+') END)"


# Levenshtein in DuckDB counts bytes; renaming every non-ASCII letter of the
# test texts to its own control character (an injective renaming) makes it
# count characters, as Spark does.
SAFE_FROM = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöüàâëîïôù"
SAFE_CODES = [c for c in range(1, 32) if c not in (9, 10, 13)]


def safe(x: str) -> str:
    to = " || ".join(f"chr({c})" for c in SAFE_CODES[:len(SAFE_FROM)])
    return f"translate({x}, '{SAFE_FROM}', {to})"


def perm_values(name: str = "perm") -> str:
    import itertools
    rows = ["(0, 0, []::INTEGER[])", "(1, 0, [1])"]
    for n in (2, 3, 4):
        for k, p in enumerate(itertools.permutations(range(1, n + 1))):
            rows.append(f"({n}, {k}, {list(p)})")
    return f"{name}(n, k, idx) AS (VALUES {', '.join(rows)})"


def fact(x: str) -> str:
    return f"(CASE WHEN {x} <= 1 THEN 1 WHEN {x} = 2 THEN 2 WHEN {x} = 3 THEN 6 ELSE 24 END)"


def permuted_sql(source: str, key: str, text: str, eng: str, name: str = "permuted") -> str:
    """CTEs that end in ``name``: ``key`` and ``t``, the text in the order closest to eng."""
    return f"""{name}_tk AS (
  SELECT *, len(tok) AS n, len(rtok) AS m FROM (
    SELECT {key}, {text} AS t, {eng} AS eng, {tokens(f"replace({text}, ',', '')")} AS tok,
      {tokens(f"replace(strip_accents({text}), ',', '')")} AS rtok FROM {source})),
{name}_cand AS (
  SELECT k1.{key}, p.k, array_to_string(list_transform(p.idx, lambda i: tok[i]), ' ') AS name,
         levenshtein({safe("""array_to_string(list_transform(
             CASE WHEN m <= 4 THEN rp.idx ELSE list_concat(range(1, m - 3), list_transform(p4.idx, lambda i: i + m - 4)) END,
             lambda i: rtok[i]), ' ')""")}, {safe('eng')}) AS d
  FROM {name}_tk k1 JOIN perm p ON p.n = k1.n
  LEFT JOIN perm rp ON rp.n = k1.m AND rp.k = p.k
  LEFT JOIN perm p4 ON p4.n = 4 AND p4.k = p.k
  WHERE k1.n BETWEEN 2 AND 4 AND p.k < least({fact('k1.n')}, {fact('k1.m')})),
{name}_best AS (SELECT {key}, arg_min(name, (d, k)) AS name FROM {name}_cand GROUP BY {key}),
{name} AS (
  SELECT k1.{key}, CASE WHEN k1.n BETWEEN 2 AND 4 THEN b.name ELSE k1.t END AS t
  FROM {name}_tk k1 LEFT JOIN {name}_best b ON b.{key} = k1.{key})"""
