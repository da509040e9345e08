"""Equivalent SQL for the correctness check (DuckDB dialect).

The same definitions written relationally — unnest + window + group by where the
Spark side uses array expressions — so each oracle is an independent formulation of
the operator, sharing only the hash contract and the fixed values.
"""

from __future__ import annotations

from icx.functions.scripts import CLASS_POINTS, LATIN, language_name
from icx.functions.text import WS_RUN
from icx.operators.prompts import RANDOM_INSTRUCTIONS, GENERIC_INSTRUCTION

POS_RADIX = 2147483648


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def u60(seed: int, tag: str, *keys: str) -> str:
    args = ", ".join([lit(str(seed)), lit(tag), *keys])
    return f"(('0x' || substr(md5(concat_ws('|', {args})), 1, 15))::BIGINT)"


PRIME = 2147483647


def pos_u32(seed: int, tag: str, pos: str, *keys: str) -> str:
    hx = f"md5(concat_ws('|', {', '.join([lit(str(seed)), lit(tag), *keys])}))"
    a, b, c = (f"((('0x' || substr({hx}, {i}, 8))::BIGINT) % {PRIME})" for i in (1, 9, 17))
    p = f"(({pos})::BIGINT)"
    return f"((({a} * {p} + {b}) % {PRIME} * {p} + {c}) % {PRIME})"


def rank_key(seed: int, tag: str, pos: str, *keys: str) -> str:
    return f"({pos_u32(seed, tag, pos, *keys)} * {POS_RADIX} + ({pos})::BIGINT)"


def kmax(n: str, rate: float, at_least_one: bool = True) -> str:
    k = f"trunc(({n})::DOUBLE * {float(rate)!r}::DOUBLE)::BIGINT"
    return f"greatest(1, {k})" if at_least_one else k


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, {lit(WS_RUN)}), lambda x: x <> '')"


def strip(text: str) -> str:
    return f"regexp_replace({text}, {lit('^' + WS_RUN + '|' + WS_RUN + '$')}, '', 'g')"


def in_class(cp: str, pclass: int = LATIN) -> str:
    return f"({cp} IN ({', '.join(str(c) for c in CLASS_POINTS[pclass])}))"


# ---- fixtures ------------------------------------------------------------------------

def turn_pairs(first_role: str, second_role: str) -> str:
    return f"""SELECT a.conv_id * 1048576 + a.turn AS row_id, a.text AS src, b.text AS tgt,
       CASE WHEN a.conv_id % 4 = 0 THEN 'test' ELSE 'dev' END AS split
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
WHERE a.role = '{first_role}' AND b.role = '{second_role}'"""


PAIRS = turn_pairs("user", "assistant")
AUX_PAIRS = turn_pairs("assistant", "user")
TRIPLES = f"""SELECT sp.row_id AS sp_id, pt.row_id AS pt_id, sp.src AS src, sp.tgt AS "pivot", pt.tgt AS tgt
FROM ({PAIRS}) sp JOIN ({AUX_PAIRS}) pt ON sp.tgt = pt.src"""
_CODES = ("ar arb_Arab bg bul_Cyrl bn ben_Beng cs ces_Latn da dan_Latn de deu_Latn el ell_Grek en eng_Latn es spa_Latn fi fin_Latn "
          "fr fra_Latn gu guj_Gujr he heb_Hebr hi hin_Deva hu hun_Latn id ind_Latn it ita_Latn ja jpn_Jpan kn kan_Knda ko kor_Hang "
          "ml mal_Mlym mr mar_Deva nl nld_Latn pa pan_Guru pl pol_Latn pt por_Latn ro ron_Latn ru rus_Cyrl si sin_Sinh sv swe_Latn "
          "ta tam_Taml te tel_Telu th tha_Thai tr tur_Latn uk ukr_Cyrl ur urd_Arab vi vie_Latn zh zho_Hans").split()
LANG_CODE = ("CASE coalesce(lang, 'und') " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(_CODES[::2], _CODES[1::2]))
             + " ELSE CASE WHEN regexp_matches(lang, '^[a-z]{3}_[A-Z][a-z]{3}$') THEN lang ELSE coalesce(lang, 'und') || '_Zyyy' END END")
LINES = f"SELECT doc_id AS row_id, text, lang, {LANG_CODE} AS code FROM documents"


# ---- demonstrations -------------------------------------------------------------------

def demos_cte(test_sql: str, dev_sql: str, k: int, seed: int, cols=("src", "tgt")) -> str:
    """CTE list ending in `demos(row_id, demo_pos, demo_idx, d_<col>...)`."""
    ctes = [
        f"test AS ({test_sql})",
        f"dev AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS idx, {', '.join(cols)} FROM ({dev_sql}))",
        "n AS (SELECT count(*) AS d FROM dev)",
        "s0 AS (SELECT row_id, []::BIGINT[] AS s FROM test)",
    ]
    for m in range(k):
        t = f"{u60(seed, 'demo', 'row_id', 'j')} % (j + 1)"
        ctes.append(
            f"s{m + 1} AS (SELECT row_id, CASE WHEN list_contains(s, t) THEN list_append(s, j) "
            f"ELSE list_append(s, t) END AS s FROM (SELECT row_id, s, j, {t} AS t FROM "
            f"(SELECT row_id, s, (n.d - {k} + {m})::BIGINT AS j FROM s{m}, n)))"
        )
    ctes.append(f"picked AS (SELECT row_id, unnest(s) AS v FROM s{k})")
    ctes.append(
        f"ordered AS (SELECT row_id, v, (row_number() OVER (PARTITION BY row_id ORDER BY "
        f"{u60(seed, 'demo_order', 'row_id', 'v')}, v) - 1)::INTEGER AS demo_pos FROM picked)"
    )
    dcols = ", ".join(f"dev.{c} AS d_{c}" for c in cols)
    ctes.append(
        f"demos AS (SELECT o.row_id, o.demo_pos, o.v AS demo_idx, {dcols} FROM ordered o JOIN dev ON dev.idx = o.v)"
    )
    return "WITH " + ",\n".join(ctes)


def instruction_sql(kind: str, s: str, t: str, chat: bool, seed: int, key: str = "t.row_id") -> str | None:
    end = ".\n\n" if chat else ":\n\n"
    if kind == "standard":
        return lit(f"Translate this from {s} into {t}{end}")
    if kind == "generic":
        return lit(GENERIC_INSTRUCTION)
    if kind == "random":
        arr = "[" + ", ".join(lit(x) for x in RANDOM_INSTRUCTIONS) + "]"
        return f"{arr}[({u60(seed, 'instruction', key)} % {len(RANDOM_INSTRUCTIONS)}) + 1]"
    if kind == "contrastive":
        return lit(f"Translate this from {t} into {s}" + (".\n\n" if chat else " :\n\n"))
    if kind == "no_instruct":
        return None if chat else "''"
    raise ValueError(kind)


def few_shot_text(test_sql: str, dev_sql: str, k: int, seed: int, src_lang: str, tgt_lang: str,
                  kind: str = "standard", demo_label: str | None = None, instr: str | None = None) -> str:
    s, t = language_name(src_lang), language_name(tgt_lang)
    dl = demo_label or s
    instr = instr if instr is not None else instruction_sql(kind, s, t, False, seed)
    block = (
        f"CASE WHEN bool_and(d_src IS NOT NULL AND d_tgt IS NOT NULL) THEN string_agg({lit(dl + ': ')} || d_src || {lit(chr(10) + t + ': ')} || d_tgt || {lit(chr(10) * 2)}, '' "
        f"ORDER BY demo_pos) END"
    )
    return demos_cte(test_sql, dev_sql, k, seed) + f""",
blocks AS (SELECT row_id, {block} AS block FROM demos GROUP BY row_id)
SELECT t.row_id, {instr} || CASE WHEN b.row_id IS NULL THEN '' ELSE b.block END || {lit(s + ': ')} || t.src || {lit(chr(10) + t + ': ')} AS prompt,
       t.tgt AS reference
FROM test t LEFT JOIN blocks b ON b.row_id = t.row_id"""


def few_shot_chat(test_sql: str, dev_sql: str, k: int, seed: int, src_lang: str, tgt_lang: str,
                  kind: str = "standard", demo_label: str | None = None, system: str | None = "",
                  ) -> str:
    """Exploded chat messages (row_id, msg_idx, role, content)."""
    s, t = language_name(src_lang), language_name(tgt_lang)
    dl = demo_label or s
    sys_sql = instruction_sql(kind, s, t, True, seed) if system == "" else system
    has_sys = 1 if sys_sql is not None else 0
    parts = []
    if has_sys:
        parts.append(f"SELECT t.row_id, 0 AS msg_idx, 'system' AS role, {sys_sql} AS content FROM test t")
    parts.append(
        f"SELECT row_id, {has_sys} + 2 * demo_pos AS msg_idx, 'user' AS role, "
        f"{lit(dl + ': ')} || d_src || {lit(chr(10) + t + ': ')} AS content FROM demos"
    )
    parts.append(
        f"SELECT row_id, {has_sys} + 2 * demo_pos + 1 AS msg_idx, 'assistant' AS role, "
        f"d_tgt || {lit(chr(10) * 2)} AS content FROM demos"
    )
    parts.append(
        f"SELECT t.row_id, {has_sys} + 2 * {k} AS msg_idx, 'user' AS role, "
        f"{lit(s + ': ')} || t.src || {lit(chr(10) + t + ': ')} AS content FROM test t"
    )
    body = "\nUNION ALL\n".join(parts)
    return demos_cte(test_sql, dev_sql, k, seed) + f""",
lacking AS (SELECT row_id FROM demos WHERE d_src IS NULL OR d_tgt IS NULL UNION SELECT row_id FROM test WHERE src IS NULL)
SELECT row_id, msg_idx::INTEGER AS msg_idx, role, content FROM ({body}) t WHERE row_id NOT IN (SELECT row_id FROM lacking)"""


# ---- perturbations (relational twins: unnest + window + string_agg) ---------------------

from icx.functions.scripts import ARABIC, INDIC, SCRIPT_RANGES, class_regex, mark_pool, punct_class_of, span_pool  # noqa: E402


def per_script(code: str, build) -> str:
    """CASE over the script suffix of a lang_Script column; build(script, pclass) -> SQL."""
    parts = [f"WHEN split_part({code}, '_', 2) = '{s}' THEN {build(s, punct_class_of('x_' + s))}" for s in SCRIPT_RANGES]
    fallback = (
        f"CASE WHEN {code} LIKE '%Arab' THEN {build('', ARABIC)} "
        f"WHEN {code} LIKE '%Latn' OR {code} LIKE '%Cyrl' THEN {build('', LATIN)} ELSE {build('', INDIC)} END"
    )
    return "(CASE " + " ".join(parts) + f" ELSE {fallback} END)"


def pclass_sql(code: str) -> str:
    return f"(CASE WHEN {code} LIKE '%Arab' THEN {ARABIC} WHEN {code} LIKE '%Latn' OR {code} LIKE '%Cyrl' THEN {LATIN} ELSE {INDIC} END)"


def in_class_by(cp: str, pclass: str) -> str:
    return (f"(CASE {pclass} WHEN {LATIN} THEN {in_class(cp, LATIN)} WHEN {INDIC} THEN {in_class(cp, INDIC)} "
            f"ELSE {in_class(cp, ARABIC)} END)")


def word_has_punct(w: str, pclass: str) -> str:
    return (f"(CASE {pclass} WHEN {LATIN} THEN regexp_matches({w}, {lit(class_regex(LATIN))}) "
            f"WHEN {INDIC} THEN regexp_matches({w}, {lit(class_regex(INDIC))}) "
            f"ELSE regexp_matches({w}, {lit(class_regex(ARABIC))}) END)")


def _base(src_sql: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    return f"""base AS (SELECT {k}, text, code FROM ({src_sql})),
tok AS (SELECT {k}, unnest(W) AS w, unnest(range(len(W))) AS i, len(W) AS n
        FROM (SELECT {k}, {words('text')} AS W FROM base))"""


def _chars_base(src_sql: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    return f"""base AS (SELECT {k}, text, code FROM ({src_sql})),
ch AS (SELECT {k}, code, unnest(C) AS c, unnest(range(len(C))) AS i
       FROM (SELECT {k}, code, CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split(text, '') END AS C FROM base))"""


def _finish(keys: list[str], agg_cte: str, unchanged_when: str | None = None) -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"a.{x} = b.{x}" for x in keys)
    cond = f"CASE WHEN a.o IS NULL{(' OR ' + unchanged_when) if unchanged_when else ''} THEN b.text ELSE a.o END"
    return f"SELECT {', '.join('b.' + x for x in keys)}, {cond} AS perturbed FROM base b LEFT JOIN {agg_cte} a ON {on}"


def ptb_sql(attack: str, src_sql: str, keys: list[str], rate: float, seed: int) -> str:
    """SQL twin of perturb(attack) for rows (keys..., text, code)."""
    K = ", ".join(keys)
    part = f"PARTITION BY {K}"
    usingk = ", ".join(keys)
    if attack == "word_duplication":
        return f"""WITH {_base(src_sql, keys)},
s AS (SELECT *, row_number() OVER ({part} ORDER BY {rank_key(seed, 'dup', 'i', *keys)}) <= {kmax('n', rate)} AS sel FROM tok),
agg AS (SELECT {K}, string_agg(CASE WHEN sel THEN w || ' ' || w ELSE w END, ' ' ORDER BY i) AS o FROM s GROUP BY {K})
{_finish(keys, 'agg')}"""
    if attack == "word_order":
        return f"""WITH {_base(src_sql, keys)},
s AS (SELECT *, row_number() OVER ({part} ORDER BY {rank_key(seed, 'order_slot', 'i', *keys)}) AS m FROM tok),
sel AS (SELECT {K}, i, m FROM s WHERE m <= {kmax('n', rate)}),
src AS (SELECT {K}, i AS p, row_number() OVER ({part} ORDER BY {rank_key(seed, 'order_src', 'i', *keys)}) AS m FROM sel),
srt AS (SELECT {K}, i AS q, row_number() OVER ({part} ORDER BY i) AS m, row_number() OVER ({part} ORDER BY i DESC) AS mr FROM sel),
pr AS (SELECT sel.*, src.p, a.q AS q_sorted, b.q AS q_rev
       FROM sel JOIN src USING ({usingk}, m) JOIN srt a USING ({usingk}, m) JOIN srt b ON {' AND '.join(f'b.{x} = sel.{x}' for x in keys)} AND b.mr = sel.m),
fl AS (SELECT {K}, bool_and(p = i) AS ident, bool_and(q_sorted = i) AS sorted_ident FROM pr GROUP BY {K}),
mp AS (SELECT {K}, i AS t, CASE WHEN NOT ident THEN p WHEN NOT sorted_ident THEN q_sorted ELSE q_rev END AS s
       FROM pr JOIN fl USING ({usingk})
       UNION ALL SELECT {K}, i AS t, i AS s FROM s WHERE m > {kmax('n', rate)}),
agg AS (SELECT {K}, string_agg(tok.w, ' ' ORDER BY mp.t) AS o FROM mp JOIN tok USING ({usingk}) WHERE tok.i = mp.s GROUP BY {K})
{_finish(keys, 'agg')}"""
    if attack == "ocr":
        cut = f"({pos_u32(seed, 'ocr_cut', 'i', *keys)} % (length(w) - 1) + 1)"
        return f"""WITH {_base(src_sql, keys)},
s AS (SELECT *, row_number() OVER ({part} ORDER BY {rank_key(seed, 'ocr', 'i', *keys)}) <= {kmax('n', rate)} AS sel,
             (i < n - 1 AND {pos_u32(seed, 'ocr_op', 'i', *keys)} % 2 = 0) AS fuse FROM tok),
agg AS (SELECT {K}, string_agg(
          CASE WHEN sel AND NOT fuse AND length(w) >= 2 THEN substr(w, 1, {cut}) || ' ' || substr(w, {cut} + 1) ELSE w END
          || CASE WHEN i = n - 1 OR (sel AND fuse) THEN '' ELSE ' ' END, '' ORDER BY i) AS o FROM s GROUP BY {K})
{_finish(keys, 'agg')}"""
    if attack == "punctuation_drop_attack":
        return f"""WITH {_chars_base(src_sql, keys)},
p AS (SELECT *, {in_class_by('unicode(c)', pclass_sql('code'))} AS isp FROM ch),
cnt AS (SELECT {K}, count(*) FILTER (WHERE isp) AS m FROM p GROUP BY {K}),
rk AS (SELECT {K}, i, row_number() OVER ({part} ORDER BY {rank_key(seed, 'pdrop', 'i', *keys)}) AS r FROM p WHERE isp),
dr AS (SELECT {K}, i FROM rk JOIN cnt USING ({usingk}) WHERE r <= {kmax('m', rate)}),
agg AS (SELECT {K}, string_agg(CASE WHEN dr.i IS NULL THEN p.c ELSE '' END, '' ORDER BY p.i) AS o
        FROM p LEFT JOIN dr USING ({usingk}, i) GROUP BY {K})
{_finish(keys, 'agg')}"""
    if attack == "punctuation_add_attack":
        marks = per_script("code", lambda s, c: "[" + ", ".join(lit(m) for m in mark_pool(s, c)) + "]")
        return f"""WITH {_base(src_sql, keys)},
t2 AS (SELECT tok.*, base.code, NOT {word_has_punct('w', pclass_sql('base.code'))} AS cand FROM tok JOIN base USING ({usingk})),
cnt AS (SELECT {K}, count(*) FILTER (WHERE cand) AS c FROM t2 GROUP BY {K}),
rk AS (SELECT {K}, w, row_number() OVER ({part} ORDER BY {rank_key(seed, 'padd', 'i', *keys)}) AS r FROM t2 WHERE cand),
v AS (SELECT DISTINCT {K}, w FROM rk JOIN cnt USING ({usingk}) WHERE r <= {kmax('c', rate)}),
mk AS (SELECT t2.*, v.w IS NOT NULL AS marked, {marks} AS M FROM t2 LEFT JOIN v USING ({usingk}, w)),
agg AS (SELECT {K}, string_agg(CASE WHEN marked THEN w || M[{pos_u32(seed, 'mark', 'i', *keys)} % len(M) + 1] ELSE w END,
                                ' ' ORDER BY i) AS o FROM mk GROUP BY {K})
SELECT {', '.join('b.' + x for x in keys)}, CASE WHEN coalesce(cnt.c, 0) = 0 OR a.o IS NULL THEN b.text ELSE a.o END AS perturbed
FROM base b LEFT JOIN agg a USING ({usingk}) LEFT JOIN cnt USING ({usingk})"""
    if attack == "span_noise":
        lo = per_script("code", lambda s, c: str(SCRIPT_RANGES.get(s, (0, 0))[0]))
        hi = per_script("code", lambda s, c: str(SCRIPT_RANGES.get(s, (0, 0))[1]))
        pool = per_script("code", lambda s, c: "[" + ", ".join(str(x) for x in span_pool(s, c)) + "]::INTEGER[]")
        return f"""WITH {_chars_base(src_sql, keys)},
e AS (SELECT *, unicode(c) AS cp, {lo} AS lo, {hi} AS hi FROM ch),
e2 AS (SELECT *, (cp >= lo AND cp < hi AND NOT {in_class_by('cp', pclass_sql('code'))}) AS elig FROM e),
cnt AS (SELECT {K}, {kmax('count(*) FILTER (WHERE elig)', rate, False)} AS b FROM e2 GROUP BY {K}),
rk AS (SELECT {K}, i, {pos_u32(seed, 'span_len', 'i', *keys)} % 3 + 1 AS l,
              row_number() OVER ({part} ORDER BY {rank_key(seed, 'span', 'i', *keys)}) AS o FROM e2 WHERE elig),
cum AS (SELECT *, coalesce(sum(l) OVER ({part} ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rk),
kept AS (SELECT {K}, i, least(l, b - before) AS kl FROM cum JOIN cnt USING ({usingk}) WHERE before < b),
lk AS (SELECT e2.*, coalesce(kept.kl, 0) AS kl FROM e2 LEFT JOIN kept USING ({usingk}, i)),
lg AS (SELECT *, coalesce(lag(kl, 1) OVER ({part} ORDER BY i), 0) AS kl1, coalesce(lag(kl, 2) OVER ({part} ORDER BY i), 0) AS kl2 FROM lk),
agg AS (SELECT {K}, string_agg(CASE WHEN kl > 0 THEN
                  CASE WHEN {pos_u32(seed, 'span_op', 'i', *keys)} % 2 = 1
                       THEN chr(({pool})[{pos_u32(seed, 'span_rep', 'i', *keys)} % len({pool}) + 1]) ELSE '' END
                WHEN kl1 >= 2 OR kl2 >= 3 THEN '' ELSE c END, '' ORDER BY i) AS o FROM lg GROUP BY {K})
{_finish(keys, 'agg')}"""
    raise NotImplementedError(attack)


# ---- pivot study ---------------------------------------------------------------------

PV = '"pivot"'  # quoted: PIVOT is a keyword in DuckDB


def misaligned_cte(key: str, seed: int) -> str:
    tag = "misaligned_" + key.strip('"')
    return f"""tr AS ({TRIPLES}),
ix AS (SELECT *, row_number() OVER (ORDER BY md5({key}), sp_id, pt_id) - 1 AS idx FROM tr),
n AS (SELECT count(*) AS d FROM ix),
bl AS (SELECT {key} AS bkey, min(idx) AS start, count(*) AS cnt FROM ix GROUP BY {key}),
dr AS (SELECT ix.*, bl.start, bl.cnt,
              CASE WHEN n.d - bl.cnt > 0 THEN {u60(seed, tag, 'ix.sp_id', 'ix.pt_id')} % (n.d - bl.cnt) END AS r
       FROM ix JOIN bl ON bl.bkey = ix.{key} CROSS JOIN n),
dj AS (SELECT dr.*, CASE WHEN r < start THEN r ELSE r + cnt END AS j FROM dr),
mis AS (SELECT dj.sp_id, dj.pt_id, dj.src, dj.{PV}, dj.tgt, o.src AS j_src, o.{PV} AS j_pivot, o.tgt AS j_tgt
        FROM dj LEFT JOIN ix o ON o.idx = dj.j)"""


def pivot_texts_sql(variant: str, seed: int) -> str:
    if variant == "I":
        return f"WITH v AS (SELECT sp_id, pt_id, src, {PV}, tgt FROM ({TRIPLES}))"
    if variant == "II":
        return "WITH " + misaligned_cte(PV, seed) + f",\nv AS (SELECT sp_id, pt_id, src, j_pivot AS {PV}, tgt FROM mis)"
    piv = "j_pivot" if variant == "III" else PV
    return "WITH " + misaligned_cte("src", seed) + f",\nv AS (SELECT sp_id, pt_id, src, {piv} AS {PV}, j_tgt AS tgt FROM mis)"


def pivot_text_sql(variant: str, seed: int, src_lang: str, pivot_lang: str, tgt_lang: str) -> str:
    s, p, t = (language_name(x) for x in (src_lang, pivot_lang, tgt_lang))
    nl = chr(10)
    body = (
        f"{lit(f'Translate this from {s} into {p}:{nl}{nl}{s}: ')} || src || {lit(f'{nl}{p}: ')} || {PV} || "
        f"{lit(f'{nl}{nl}Translate this from {p} into {t}:{nl}{nl}{p}: ')} || {PV} || {lit(f'{nl}{t}: ')} || tgt || "
        f"{lit(f'{nl}{nl}Translate this from {s} into {t}:{nl}{nl}{s}: ')} || src || {lit(f'{nl}{t}: ')}"
    )
    return pivot_texts_sql(variant, seed) + f"\nSELECT sp_id, pt_id, {body} AS prompt FROM v"


def pivot_chat_sql(variant: str, seed: int, src_lang: str, pivot_lang: str, tgt_lang: str) -> str:
    from icx.operators.prompts import PIVOT_FINAL_SUFFIX

    s, p, t = (language_name(x) for x in (src_lang, pivot_lang, tgt_lang))
    nl = chr(10)
    msgs = [
        ("user", f"{lit(f'Translate this from {s} into {p}:{nl}{nl}{s}: ')} || src || {lit(f'{nl}{p}: ')}"),
        ("assistant", f"{PV} || {lit(nl + nl)}"),
        ("user", f"{lit(f'Translate this from {p} into {t}:{nl}{nl}{p}: ')} || {PV} || {lit(f'{nl}{t}: ')}"),
        ("assistant", f"tgt || {lit(nl + nl)}"),
        ("user", f"{lit(f'Translate this from {s} into {t}{PIVOT_FINAL_SUFFIX}{s}: ')} || src || {lit(f'{nl}{t}: ')}"),
    ]
    parts = [f"SELECT sp_id, pt_id, {i} AS msg_idx, '{r}' AS role, {c} AS content FROM v" for i, (r, c) in enumerate(msgs)]
    return (pivot_texts_sql(variant, seed) + "\nSELECT sp_id, pt_id, msg_idx::INTEGER AS msg_idx, role, content FROM ("
            + "\nUNION ALL\n".join(parts) + ")")


# ---- generation data path and metrics --------------------------------------------------

def clean_sql(raw: str, prompt: str) -> str:
    return f"split_part({strip(f'substring({raw}, length({prompt}) + 1)')}, chr(10), 1)"


_13A = r"[\x{7B}-\x{7E}\x{5B}-\x{60}\x{20}-\x{26}\x{28}-\x{2B}\x{3A}-\x{40}\x{2F}]"


def tok13a(t: str) -> str:
    x = f"replace(replace(replace({t}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    x = f"(' ' || {x} || ' ')"
    x = f"regexp_replace({x}, {lit('(' + _13A + ')')}, ' \\1 ', 'g')"
    x = f"regexp_replace({x}, '([^0-9])([\\.,])', '\\1 \\2 ', 'g')"
    x = f"regexp_replace({x}, '([\\.,])([^0-9])', ' \\1 \\2', 'g')"
    x = f"regexp_replace({x}, '([0-9])(-)', '\\1 \\2 ', 'g')"
    return words(x)


_PUNCT_ALL = ", ".join(str(ord(c)) for c in __import__("string").punctuation)


def chrf_words_sql(t: str) -> str:
    w = "w"
    split = (f"CASE WHEN length({w}) = 1 THEN [{w}] "
             f"WHEN unicode(right({w}, 1)) IN ({_PUNCT_ALL}) THEN [left({w}, length({w}) - 1), right({w}, 1)] "
             f"WHEN unicode(left({w}, 1)) IN ({_PUNCT_ALL}) THEN [left({w}, 1), substr({w}, 2)] ELSE [{w}] END")
    return f"flatten(list_transform({words(t)}, lambda w: {split}))"


def metrics_sql(seg_sql: str, keys: list[str], tokenizer: str = "13a", long: bool = False) -> str:
    """SQL twin of metrics.score / ngram_stats over rows (keys..., hypothesis, reference)."""
    K = ", ".join(keys)
    bt = {"whitespace": words, "13a": tok13a}[tokenizer]
    nows = lambda t: f"regexp_replace({t}, {lit(WS_RUN)}, '', 'g')"
    chars = lambda t: f"CASE WHEN {nows(t)} = '' THEN []::VARCHAR[] ELSE string_split({nows(t)}, '') END"
    gram_sel = []
    for metric, orders, hcol, rcol, sep in (("bleu", 4, "hw", "rw", " "), ("chr", 6, "hc", "rc", ""),
                                            ("word", 2, "hp", "rp", " ")):
        for n in range(1, orders + 1):
            for side, col in (("h", hcol), ("r", rcol)):
                g = f"list_transform(range(1, len({col}) - {n} + 2), lambda i: array_to_string({col}[i:i + {n - 1}], '{sep}'))"
                gram_sel.append(f"SELECT {K}, seg_id, '{metric}' AS metric, {n} AS ord, '{side}' AS side, unnest({g}) AS g FROM tk")
    grams = "\nUNION ALL\n".join(gram_sel)
    body = f"""WITH seg AS (SELECT {K}, row_number() OVER () AS seg_id, coalesce(hypothesis, '') AS hyp, coalesce(reference, '') AS ref FROM ({seg_sql})),
tk AS (SELECT {K}, seg_id, {bt('hyp')} AS hw, {bt('ref')} AS rw, {chars('hyp')} AS hc, {chars('ref')} AS rc,
              {chrf_words_sql('hyp')} AS hp, {chrf_words_sql('ref')} AS rp FROM seg),
lens AS (SELECT {K}, sum(len(hw)) AS sys_len, sum(len(rw)) AS ref_len FROM tk GROUP BY {K}),
gr AS ({grams}),
cnt AS (SELECT {K}, seg_id, metric, ord, g, count(*) FILTER (WHERE side = 'h') AS hc, count(*) FILTER (WHERE side = 'r') AS rc
        FROM gr GROUP BY {K}, seg_id, metric, ord, g),
per AS (SELECT {K}, seg_id, metric, ord, sum(hc) AS h, sum(rc) AS r, sum(least(hc, rc)) AS m FROM cnt GROUP BY {K}, seg_id, metric, ord),
st AS (SELECT {K}, metric, ord,
              sum(CASE WHEN metric = 'bleu' OR r > 0 THEN h ELSE 0 END)::BIGINT AS n_hyp,
              sum(r)::BIGINT AS n_ref, sum(m)::BIGINT AS n_match FROM per GROUP BY {K}, metric, ord),
runs AS (SELECT DISTINCT {K} FROM seg),
grid AS (SELECT runs.*, mo.metric, mo.ord FROM runs CROSS JOIN (VALUES {', '.join(f"('bleu', {n})" for n in range(1, 5))},
         {', '.join(f"('chr', {n})" for n in range(1, 7))}, ('word', 1), ('word', 2)) mo(metric, ord)),
full_st AS (SELECT grid.*, coalesce(st.n_hyp, 0) AS n_hyp, coalesce(st.n_ref, 0) AS n_ref, coalesce(st.n_match, 0) AS n_match
            FROM grid LEFT JOIN st USING ({K}, metric, ord))"""
    if long:
        return body + f"""
SELECT {K}, metric, ord::INTEGER AS ord, n_hyp, n_ref, n_match FROM full_st"""
    piv = []
    for n in range(1, 5):
        piv.append(f"max(CASE WHEN metric = 'bleu' AND ord = {n} THEN n_match END)::DOUBLE AS c{n}")
        piv.append(f"max(CASE WHEN metric = 'bleu' AND ord = {n} THEN n_hyp END)::DOUBLE AS t{n}")
    for name, orders in (("chr", 6), ("word", 2)):
        for n in range(1, orders + 1):
            for x in ("hyp", "ref", "match"):
                piv.append(f"max(CASE WHEN metric = '{name}' AND ord = {n} THEN n_{x} END)::DOUBLE AS {name}_{x}_{n}")
    z = []
    acc = "0"
    logs = []
    for n in range(1, 5):
        acc = f"({acc} + CASE WHEN c{n} = 0 THEN 1 ELSE 0 END)"
        logs.append(f"ln(CASE WHEN c{n} > 0 THEN 100.0 * c{n} / t{n} ELSE 100.0 / (pow(2.0, {acc}) * t{n}) END)")
    bleu = (f"CASE WHEN c1 + c2 + c3 + c4 = 0 OR t4 = 0 THEN 0.0 ELSE "
            f"(CASE WHEN sl < rl THEN (CASE WHEN sl > 0 THEN exp(1 - rl / sl) ELSE 0.0 END) ELSE 1.0 END) * "
            f"exp(({' + '.join(logs)}) / 4) END")

    def chrf(word_order: int) -> str:
        orders = [("chr", n) for n in range(1, 7)] + [("word", n) for n in range(1, word_order + 1)]
        ok = lambda nm, n: f"({nm}_hyp_{n} > 0 AND {nm}_ref_{n} > 0)"
        p = " + ".join(f"CASE WHEN {ok(nm, n)} THEN {nm}_match_{n} / {nm}_hyp_{n} ELSE 0 END" for nm, n in orders)
        r = " + ".join(f"CASE WHEN {ok(nm, n)} THEN {nm}_match_{n} / {nm}_ref_{n} ELSE 0 END" for nm, n in orders)
        e = " + ".join(f"CASE WHEN {ok(nm, n)} THEN 1 ELSE 0 END" for nm, n in orders)
        P, R = f"(({p}) / ({e}))", f"(({r}) / ({e}))"
        return (f"CASE WHEN ({e}) = 0 THEN 0.0 WHEN {P} + {R} > 0 THEN 100.0 * 5.0 * {P} * {R} / (4.0 * {P} + {R}) "
                f"ELSE 0.0 END")

    return body + f""",
wide AS (SELECT {K}, {', '.join(piv)} FROM full_st GROUP BY {K}),
w2 AS (SELECT wide.*, lens.sys_len::DOUBLE AS sl, lens.ref_len::DOUBLE AS rl FROM wide JOIN lens USING ({K}))
SELECT {K}, round({bleu}, 6) AS bleu, round({chrf(0)}, 6) AS chrf, round({chrf(2)}, 6) AS chrf_pp FROM w2"""
