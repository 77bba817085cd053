"""DuckDB SQL fragments used by the oracle queries.

These mirror the Spark column functions in SQL so that each registered Spark
plan has an independent statement of the same result.  RE2 (DuckDB) lacks
``\\x0b`` in ``\\s`` and spells code point escapes ``\\x{..}``; otherwise the
character classes are the same fixed values as in ``functions/text.py``.
"""

from __future__ import annotations

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
WORDS_AND_SYMBOLS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}]"
# The published rules of the 13a tokenizer.
REGEXP_STAGE = [
    (r"([{-~\[-`!-&(-+:-@/])", r" \1 "),
    (r"([^0-9])([.,])", r"\1 \2 "),
    (r"([.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
]
V13A_REPLACEMENTS = [
    ("<skipped>", ""),
    ("-' || chr(10) || '", ""),
    ("' || chr(10) || '", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
]


def ws_split(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda tk: tk <> '')"


def re_stage(x: str) -> str:
    out = x
    for pat, rep in REGEXP_STAGE:
        out = f"regexp_replace({out}, '{pat}', '{rep}', 'g')"
    return out


def tok_re(x: str) -> str:
    return ws_split(re_stage(x))


def tok_13a(x: str) -> str:
    out = x
    for a, b in V13A_REPLACEMENTS:
        out = f"replace({out}, '{a}', '{b}')"
    return tok_re(f"(' ' || {out} || ' ')")


def tok_t1(x: str) -> str:
    return f"regexp_extract_all({x}, '{WORDS_AND_SYMBOLS}')"


def tok_chars(x: str) -> str:
    return f"regexp_extract_all({x}, '(?s).')"


TOKENIZERS = {"13a": tok_13a, "re": tok_re, "none": tok_chars, "words_and_symbols": tok_t1, "whitespace": ws_split}


def grams_cte(seg: str, keys: str, max_order: int) -> str:
    """Rows (keys, n, g) for all n-grams of orders 1..max_order of list column t."""
    return (
        f"SELECT {keys}, n, unnest(list_transform(range(1, len(t) - n + 2), "
        f"lambda i: array_to_string(t[i:i + n - 1], ' '))) AS g "
        f"FROM {seg}, (SELECT unnest(range(1, {max_order + 1})) AS n) o"
    )


def bleu_ctes(
    ctes: str,
    preds: str,
    refs: str,
    tokenizer: str = "13a",
    group_cols: list[str] | None = None,
    max_order: int = 4,
    smooth: bool = False,
    weight: int = 1,
) -> str:
    """CTE list (without WITH) ending in ``fin``: one row per group with
    ``pairs, tl, rl, m1.., p1.., prec1.., ratio, geo, bp``.
    ``preds(id, groups.., pred)``, ``refs(id, ref_no, ref)``."""
    tok = TOKENIZERS[tokenizer]
    g = list(group_cols or [])
    gsel = "".join(f"{c}, " for c in g)
    gby = ("GROUP BY " + ", ".join(g)) if g else ""
    N = max_order
    sums = ",\n    ".join(
        f"sum(least(coalesce(pc, 0), coalesce(rc, 0))) FILTER (WHERE n = {k}) AS m{k}, "
        f"sum(coalesce(pc, 0)) FILTER (WHERE n = {k}) AS p{k}"
        for k in range(1, N + 1)
    )
    comp_sums = ", ".join(f"coalesce(sum(m{k}), 0) AS m{k}, coalesce(sum(p{k}), 0) AS p{k}" for k in range(1, N + 1))
    w = float(weight)
    if smooth:
        precs = [f"(m{k} * {w} + 1.0) / (p{k} * {w} + 1.0)" for k in range(1, N + 1)]
    else:
        precs = [f"CASE WHEN p{k} > 0 THEN (m{k} * {w}) / (p{k} * {w}) ELSE 0.0 END" for k in range(1, N + 1)]
    prec_sel = ", ".join(f"{p} AS prec{k}" for k, p in enumerate(precs, 1))
    log_sum = "0.0"
    for k in range(1, N + 1):
        log_sum = f"({log_sum} + (1.0 / {N}) * ln(prec{k}))"
    least_prec = "least(" + ", ".join(f"prec{k}" for k in range(1, N + 1)) + ")" if N > 1 else "prec1"
    return f"""{ctes},
seg AS (SELECT id, -1 AS side, {tok('pred')} AS t FROM {preds}
        UNION ALL SELECT id, ref_no AS side, {tok('ref')} AS t FROM {refs}),
grams AS ({grams_cte('seg', 'id, side', N)}),
segcnt AS (SELECT id, side, n, g, count(*) AS c FROM grams GROUP BY id, side, n, g),
merged AS (SELECT id, n, g, max(c) FILTER (WHERE side < 0) AS pc, max(c) FILTER (WHERE side >= 0) AS rc
           FROM segcnt GROUP BY id, n, g),
lens AS (SELECT id, max(len(t)) FILTER (WHERE side < 0) AS tl, min(len(t)) FILTER (WHERE side >= 0) AS rl
         FROM seg GROUP BY id),
per_id AS (SELECT id,
    {sums}
  FROM merged GROUP BY id),
ok AS (SELECT {gsel}l.id, l.tl, l.rl FROM lens l JOIN {preds} p ON p.id = l.id
       WHERE l.tl IS NOT NULL AND l.rl IS NOT NULL),
comp AS (SELECT {gsel}count(*) AS pairs, sum(tl) AS tl, sum(rl) AS rl, {comp_sums}
         FROM ok LEFT JOIN per_id USING (id) {gby}),
prec AS (SELECT *, {prec_sel}, (tl * {w}) / nullif(rl * {w}, 0) AS ratio FROM comp),
fin AS (SELECT *, CASE WHEN {least_prec} > 0 THEN exp({log_sum}) ELSE 0.0 END AS geo,
               CASE WHEN ratio > 1.0 THEN 1.0 ELSE exp(1.0 - 1.0 / nullif(ratio, 0)) END AS bp FROM prec)"""


def bleu_select(group_cols: list[str] | None = None, max_order: int = 4, weight: int = 1, extra_select: str = "") -> str:
    gsel = "".join(f"{c}, " for c in (group_cols or []))
    N = max_order
    return f"""SELECT {gsel}round(geo * bp, 6) AS bleu_score,
       {", ".join(f"round(prec{k}, 6) AS precision_{k}" for k in range(1, N + 1))},
       round(bp, 6) AS brevity_penalty, round(ratio, 6) AS length_ratio,
       CAST(tl * {int(weight)} AS BIGINT) AS translation_length, CAST(rl * {int(weight)} AS BIGINT) AS reference_length,
       CAST(pairs AS BIGINT) AS pairs{extra_select}
FROM fin"""


def bleu_sql(
    ctes: str,
    preds: str,
    refs: str,
    tokenizer: str = "13a",
    group_cols: list[str] | None = None,
    max_order: int = 4,
    smooth: bool = False,
    weight: int = 1,
    extra_select: str = "",
) -> str:
    """Full BLEU statement, output columns as ``fmt_bleu`` on the Spark side."""
    body = bleu_ctes(ctes, preds, refs, tokenizer, group_cols, max_order, smooth, weight)
    return f"WITH {body}\n" + bleu_select(group_cols, max_order, weight, extra_select)
