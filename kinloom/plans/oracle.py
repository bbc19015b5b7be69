"""The catalogue in SQL, for engines with list functions; one prelude for all."""

from __future__ import annotations

from kinloom.functions.vocabulary import ADDRESS_LONG, ADDRESS_SHORT, LEGAL, LEGAL_SUFFIXES

from .queries import ADDRESS_WORDS, BUDGETS, CFG, CURVE, GRAM_LIMITS, LIMITS, SCORED, THRESHOLDS


def n1(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(strip_accents(replace(lower(coalesce({x}, '')), 'ß', 'ss')), '\p{{P}}', ' ', 'g'), '\s+', ' ', 'g'))"


def mapped(x: str, table: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items())
    return f"list_transform(list_filter(string_split({x}, ' '), lambda t: t <> ''), lambda t: CASE t {cases} ELSE t END)"


def joined(x: str, by: str = " ") -> str:
    return f"coalesce(array_to_string({x}, '{by}'), '')"


def tokens(x: str) -> str:
    return rf"list_distinct(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'))"


def grams(x: str) -> str:
    letters = rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}]')"
    return f"list_transform([{letters}], lambda l: list_distinct(list_transform(range(1, len(l) - 1), lambda i: l[i] || l[i + 1] || l[i + 2])))[1]"


def digits(x: str) -> str:
    return rf"list_distinct(regexp_extract_all({x}, '\p{{Nd}}+'))"


def jac(a: str, b: str) -> str:
    both = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {both} = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / {both} END"


SUFFIXES = ", ".join(f"'{x}'" for x in LEGAL_SUFFIXES)
W = CFG.weights

PARTS = {
    "d": rf"""SELECT doc_id, lang AS country, substr(source, 4)::INT % 3 + 1 AS src, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w, string_split({n1("text")}, ' ') AS nw FROM documents""",
    "r": """SELECT 'S' || src || '-' || doc_id AS entity_id, src, country, array_to_string(w[1:6], ' ') AS business_name, coalesce(array_to_string(w[7:], ' '), '') AS business_address,
        array_to_string(list_slice(nw, greatest(len(nw) - 11, 1), len(nw)), ' ') AS tail FROM d""",
    "n": f"SELECT *, {n1('business_name')} AS old_name, {n1('business_address')} AS old_address FROM r",
    "e": f"""SELECT *, {joined(f"list_sort(list_distinct(list_filter({mapped('old_name', LEGAL)}, lambda t: t NOT IN ({SUFFIXES}))))")} AS core_name,
        {joined(f"list_sort(list_distinct({mapped('old_address', ADDRESS_SHORT)}))")} AS strong_address FROM n""",
    "k": f"""SELECT * FROM (SELECT src, entity_id, country, 'exact' AS kind, old_name AS key FROM e UNION ALL SELECT src, entity_id, country, 'core', core_name FROM e
        UNION ALL SELECT src, entity_id, country, 'addr', strong_address FROM e UNION ALL SELECT src, entity_id, country, 'ntok', unnest({tokens("old_name")}) FROM e
        UNION ALL SELECT src, entity_id, country, 'atok', unnest({tokens("old_address")}) FROM e UNION ALL SELECT src, entity_id, country, 'ngram', unnest({grams("core_name")}) FROM e
        UNION ALL SELECT src, entity_id, country, 'agram', unnest({grams("strong_address")}) FROM e) WHERE key <> '' AND country IS NOT NULL""",
    "s1": "SELECT * FROM e WHERE src = 1",
    "t": "SELECT * FROM e WHERE src > 1",
    "df": "SELECT kind, country, key, count(*)::BIGINT AS df FROM k WHERE src > 1 GROUP BY ALL",
    "ok": f"SELECT * FROM df WHERE kind IN ('ntok', 'atok') AND df <= {CFG.token_max_df} OR kind IN ('ngram', 'agram') AND df <= {CFG.gram_max_df}",
    "rk": "SELECT k.entity_id AS sid, k.kind, k.country, k.key, ok.df, row_number() OVER (PARTITION BY k.entity_id, k.kind ORDER BY ok.df, k.key) AS rank FROM k JOIN ok USING (kind, country, key) WHERE k.src = 1",
    "wk": f"""SELECT entity_id AS sid, kind, country, key, CASE kind WHEN 'exact' THEN {W.exact} WHEN 'core' THEN {W.core} ELSE {W.addr} END::DOUBLE AS weight, 0 AS rank FROM k WHERE src = 1 AND kind IN ('exact', 'core', 'addr')
        UNION ALL SELECT sid, kind, country, key, CASE kind WHEN 'ntok' THEN {W.ntok} WHEN 'atok' THEN {W.atok} WHEN 'ngram' THEN {W.ngram} ELSE {W.agram} END::DOUBLE / (1.0::DOUBLE + sqrt(df)), CASE WHEN kind IN ('ntok', 'atok') THEN 0 ELSE rank END FROM rk""",
    "m": "SELECT wk.sid, k.entity_id AS tid, kind, key, weight, rank FROM wk JOIN k USING (kind, country, key) WHERE k.src > 1",
    "p": "SELECT s.entity_id AS sid, t.entity_id AS tid FROM r s JOIN r t USING (tail) WHERE s.src = 1 AND t.src > 1",
    "c": "SELECT sid, tid, round(sum(weight), 6) AS block_score FROM m WHERE rank <= 1 GROUP BY sid, tid",
    "top": f"SELECT *, row_number() OVER (PARTITION BY sid ORDER BY block_score DESC, tid DESC) AS rnk FROM c QUALIFY rnk <= {CFG.top_k}",
    "pt": """SELECT p.sid, p.tid, s.country AS sc, t.country AS tc, s.old_name AS sn, t.old_name AS tn, s.old_address AS sa, t.old_address AS ta, s.core_name AS s_core, t.core_name AS t_core, s.strong_address AS s_strong, t.strong_address AS t_strong
        FROM p LEFT JOIN s1 s ON s.entity_id = p.sid LEFT JOIN t ON t.entity_id = p.tid""",
    "ct": "SELECT top.*, s.old_name AS sn, s.old_address AS sa, t.old_name AS tn, t.old_address AS ta FROM top JOIN s1 s ON s.entity_id = sid JOIN t ON t.entity_id = tid",
    "sc": f"SELECT sid, tid, rnk, round(({jac(tokens('sn'), tokens('tn'))}) * 0.4::DOUBLE + ({jac(tokens('sa'), tokens('ta'))}) * 0.6::DOUBLE, 6) AS score FROM ct",
    "xm": "SELECT DISTINCT sid, tid FROM m WHERE kind = 'exact'",
    "xo": "SELECT s1.entity_id AS sid, (SELECT count(*) FROM p WHERE p.sid = s1.entity_id)::BIGINT AS n_true, (SELECT count(*) FROM p JOIN xm USING (sid, tid) WHERE p.sid = s1.entity_id)::BIGINT AS tp FROM s1",
    "g": "SELECT s1.entity_id AS sid, (SELECT count(*) FROM p WHERE p.sid = s1.entity_id)::BIGINT AS n_true FROM s1",
    "sh": "SELECT p.sid, p.tid, a.kind, a.country, a.key FROM p JOIN k a ON a.entity_id = p.sid JOIN k b ON b.entity_id = p.tid AND a.kind = b.kind AND a.country = b.country AND a.key = b.key",
    "th": "SELECT unnest([" + ", ".join(f"{t}::DOUBLE" for t in THRESHOLDS) + "]) AS threshold",
    "sw": """SELECT threshold, g.sid, g.n_true, count(sc.tid)::BIGINT AS n_pred, count(p.tid)::BIGINT AS tp FROM g CROSS JOIN th LEFT JOIN sc ON sc.sid = g.sid AND sc.score >= threshold
        LEFT JOIN p ON p.sid = sc.sid AND p.tid = sc.tid GROUP BY ALL""",
    "v2": f"SELECT DISTINCT sid, tid FROM sh LEFT JOIN df USING (kind, country, key) WHERE kind = 'exact' OR kind IN ('ntok', 'atok') AND df.df <= {CFG.token_max_df}",
}
F05 = "CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN n_true = 0 OR n_pred = 0 OR tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_pred::DOUBLE) * (tp / n_true::DOUBLE) / (0.25 * (tp / n_pred::DOUBLE) + tp / n_true::DOUBLE) END::DOUBLE"
MACRO = f"""round(avg({F05}), 6) AS macro_f05, sum(tp)::BIGINT AS tp, (sum(n_pred) - sum(tp))::BIGINT AS fp, sum(n_pred)::BIGINT AS predictions,
    round(coalesce(sum(tp)::DOUBLE / nullif(sum(n_pred), 0), 0), 6) AS precision, round(coalesce(sum(tp)::DOUBLE / nullif(sum(n_true), 0), 0), 6) AS recall, sum(CASE WHEN n_true = 0 THEN n_pred ELSE 0 END)::BIGINT AS singleton_fp"""


def query(body: str) -> str:
    import re

    need: set[str] = set()

    def walk(sql: str) -> None:
        for name in PARTS:
            if name not in need and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
                need.add(name)
                walk(PARTS[name])

    walk(body)
    return "WITH " + ", ".join(f"{x} AS MATERIALIZED ({PARTS[x]})" for x in PARTS if x in need) + (", " + body.removeprefix("WITH ") if body.startswith("WITH ") else " " + body)


def _df(kind: str) -> str:
    return f"SELECT country, key, df FROM df WHERE kind = '{kind}'"


def _block(*kinds: str, k: int = 1) -> str:
    return f"SELECT sid, tid, round(sum(weight), 6) AS block_score FROM m WHERE rank <= {k} AND kind IN ({', '.join(repr(x) for x in kinds)}) GROUP BY sid, tid"


def _union(*kinds: str) -> str:
    return f"SELECT DISTINCT sid, tid FROM m WHERE rank <= 1 AND kind IN ({', '.join(repr(x) for x in kinds)})"


def _recall(hits: str) -> str:
    return f"SELECT count(*)::BIGINT AS true_pairs, count(h.sid)::BIGINT AS found, round(coalesce(count(h.sid)::DOUBLE / nullif(count(*), 0), 0), 6) AS recall FROM p LEFT JOIN ({hits}) h USING (sid, tid)"


def _curve(low: str) -> str:
    ts = ", ".join(map(str, CURVE))
    return f"""SELECT threshold::BIGINT AS threshold, count(CASE WHEN df <= threshold THEN 1 END)::BIGINT AS recovered, count(*)::BIGINT AS n_pairs, round(coalesce(count(CASE WHEN df <= threshold THEN 1 END)::DOUBLE / nullif(count(*), 0), 0), 6) AS coverage
        FROM ({low}) CROSS JOIN (SELECT unnest([{ts}]) AS threshold) GROUP BY threshold"""


def _low(kind: str) -> str:
    return f"SELECT p.sid, p.tid, q.df FROM p LEFT JOIN (SELECT sid, tid, min(df.df) AS df FROM sh JOIN df USING (kind, country, key) WHERE kind = '{kind}' GROUP BY sid, tid) q USING (sid, tid)"


def _overlap(a: str, b: str) -> str:
    x, y = tokens(a), tokens(b)
    return f"""SELECT count(*)::BIGINT AS n_pairs, sum((s >= 1)::INT)::BIGINT AS shared_1, sum((s >= 2)::INT)::BIGINT AS shared_2, sum((j >= 0.25)::INT)::BIGINT AS jaccard_25, sum((j >= 0.5)::INT)::BIGINT AS jaccard_50, sum((j >= 0.75)::INT)::BIGINT AS jaccard_75, round(avg(j), 6) AS avg_jaccard
        FROM (SELECT len(list_intersect({x}, {y})) AS s, {jac(x, y)} AS j FROM pt)"""


def _thresholds(pairs: str) -> str:
    ts = ", ".join(map(str, LIMITS))
    return f"""SELECT threshold::BIGINT AS threshold, count(q.tid)::BIGINT AS candidates, count(DISTINCT q.sid)::BIGINT AS s1_with_candidates, count(p.tid)::BIGINT AS found,
        round(count(q.tid) / (SELECT count(*) FROM s1)::DOUBLE, 6) AS avg_candidates, round(coalesce(count(p.tid)::DOUBLE / nullif((SELECT count(*) FROM p), 0), 0), 6) AS recall
        FROM (SELECT unnest([{ts}]) AS threshold) LEFT JOIN (SELECT sid, tid, min(df) AS df FROM ({pairs}) GROUP BY sid, tid) q ON q.df <= threshold LEFT JOIN p ON p.sid = q.sid AND p.tid = q.tid GROUP BY threshold"""


def _met(kinds: str) -> str:
    return f"SELECT a.entity_id AS sid, b.entity_id AS tid, df.df FROM k a JOIN df USING (kind, country, key) JOIN k b USING (kind, country, key) WHERE a.src = 1 AND b.src > 1 AND a.kind IN ({kinds}) AND df.df <= {max(LIMITS)}"


def _at(p: float) -> str:
    return f"list_sort(list(n))[least(floor(count(*) * {p}::DOUBLE), count(*) - 1)::INT + 1]::BIGINT"


_per = "SELECT s1.entity_id AS sid, count(top.tid)::BIGINT AS n FROM s1 LEFT JOIN top ON top.sid = s1.entity_id GROUP BY s1.entity_id"

def _bound(kind: str) -> str:
    per = f"SELECT s1.entity_id AS sid, coalesce(sum(rk.df), 0)::BIGINT AS n FROM s1 LEFT JOIN (SELECT * FROM rk WHERE kind = '{kind}') rk ON rk.sid = s1.entity_id GROUP BY s1.entity_id"
    return f"SELECT count(*)::BIGINT AS records, round(sum(n)::DOUBLE / count(*), 6) AS avg_bound, {_at(0.95)} AS p95, {_at(0.99)} AS p99 FROM ({per})"


#: Bits of one of the two numbers that hold a row of the bit-parallel longest common subsequence: texts of up to 200 characters on one side.
LIMB = 100
FULL = f"{(1 << LIMB) - 1}::HUGEINT"


def _characters(x: str) -> str:
    return f"regexp_extract_all({x}, '(?s).')"


def _bits(c: str, first: int) -> str:
    """The places of character c in the list ca, as bits from place `first`."""
    return f"coalesce(list_sum(list_transform(range(1, least({LIMB}, len(ca) - {first}) + 1), lambda i: CASE WHEN ca[i + {first}] = {c} THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END)), 0)::HUGEINT"


def _common(masks: str) -> str:
    """Length of the longest common subsequence of ca with the characters whose masks are given."""
    low = f"(acc.lo + (acc.lo & x.lo))"
    step = f"{{lo: ({low} & {FULL}) | (acc.lo - (acc.lo & x.lo)), hi: ((acc.hi + (acc.hi & x.hi) + ({low} >> {LIMB})) & {FULL}) | (acc.hi - (acc.hi & x.hi))}}"
    row = f"list_reduce({masks}, lambda acc, x: {step}, {{lo: {FULL}, hi: {FULL}}})"
    left = lambda part, n: f"bit_count(r.{part} & ((1::HUGEINT << ({n})::INT) - 1))"
    return f"list_transform([{row}], lambda r: len(ca) - {left('lo', f'least(len(ca), {LIMB})')} - {left('hi', f'greatest(len(ca) - {LIMB}, 0)')})[1]"


def _sorted(x: str) -> str:
    return joined(f"list_sort({x})")


def fuzzy(base: str, wratio: bool = False) -> str:
    """The rows of `base` (sn, tn, sa, ta among its columns) with n_set, n_sort, n_ratio and a_..., doubles; and n_wratio, a_wratio."""
    words = lambda x: f"list_filter(string_split({x}, ' '), lambda t: t <> '')"
    parts = f"""b AS MATERIALIZED ({base}),
        f AS MATERIALIZED (SELECT x, y, {words("x")} AS wx, {words("y")} AS wy FROM (SELECT sn AS x, tn AS y FROM b UNION SELECT sa, ta FROM b)),
        v AS MATERIALIZED (SELECT x, y, {_sorted("wx")} AS sx, {_sorted("wy")} AS sy, {_sorted("list_distinct(list_filter(wx, lambda t: list_contains(wy, t)))")} AS z,
            {_sorted("list_distinct(list_filter(wx, lambda t: NOT list_contains(wy, t)))")} AS ox, {_sorted("list_distinct(list_filter(wy, lambda t: NOT list_contains(wx, t)))")} AS oy FROM f),
        q AS MATERIALIZED (SELECT a, b FROM (SELECT x AS a, y AS b FROM v UNION SELECT sx, sy FROM v UNION SELECT ox, oy FROM v) WHERE a <> '' AND b <> ''),
        l AS MATERIALIZED (SELECT a, b, {_common("masks")} AS n FROM (SELECT a, b, ca, list_transform({_characters("b")}, lambda c: {{lo: {_bits("c", 0)}, hi: {_bits("c", LIMB)}}}) AS masks FROM (SELECT a, b, {_characters("a")} AS ca FROM q))),
        u AS MATERIALIZED (SELECT v.*, length(x) AS nx, length(y) AS ny, length(z) AS nz, length(ox) AS nox, length(oy) AS noy, coalesce(l1.n, 0) AS c1, coalesce(l2.n, 0) AS c2, coalesce(l3.n, 0) AS c3
            FROM v LEFT JOIN l l1 ON l1.a = x AND l1.b = y LEFT JOIN l l2 ON l2.a = sx AND l2.b = sy LEFT JOIN l l3 ON l3.a = ox AND l3.b = oy),
        o AS MATERIALIZED (SELECT u.*, CASE WHEN nx + ny = 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * c1 / (nx + ny) END AS ratio, CASE WHEN length(sx) + length(sy) = 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * c2 / (length(sx) + length(sy)) END AS sort,
            CASE WHEN nz + nox = 0 OR nz + noy = 0 THEN 0.0::DOUBLE WHEN nz > 0 AND (nox = 0 OR noy = 0) THEN 100.0::DOUBLE
              ELSE 100.0::DOUBLE * greatest(1 - (nox + noy - 2 * c3)::DOUBLE / (2 * (nz + (nz > 0)::INT) + nox + noy),
                CASE WHEN nz > 0 THEN greatest(1 - (1 + nox)::DOUBLE / (2 * nz + 1 + nox), 1 - (1 + noy)::DOUBLE / (2 * nz + 1 + noy)) ELSE 0 END) END AS st FROM u)"""
    wide = ""
    if wratio:
        window = f"""list_max(list_transform(range(1 - len(ca), len(cb)), lambda k: list_transform([masks[greatest(k, 0) + 1 : least(len(cb), k + len(ca))]], lambda w: 200.0::DOUBLE * ({_common("w")}) / (len(ca) + len(w)))[1]))"""
        far = "FROM o WHERE nx > 0 AND ny > 0 AND greatest(nx, ny)::DOUBLE / least(nx, ny) >= 1.5"
        parts += f""",
        pq AS MATERIALIZED (SELECT a, b FROM (SELECT x AS a, y AS b {far} UNION SELECT sx, sy {far} UNION SELECT ox, oy {far} AND z = '') WHERE a <> '' AND b <> ''),
        po AS MATERIALIZED (SELECT a, b, a AS p, b AS q FROM pq WHERE length(a) <= length(b) UNION ALL SELECT a, b, b, a FROM pq WHERE length(a) >= length(b)),
        pm AS MATERIALIZED (SELECT a, b, ca, cb, list_transform(cb, lambda c: {{lo: {_bits("c", 0)}, hi: {_bits("c", LIMB)}}}) AS masks FROM (SELECT a, b, {_characters("p")} AS ca, {_characters("q")} AS cb FROM po)),
        pr AS MATERIALIZED (SELECT a, b, max({window}) AS r FROM pm GROUP BY a, b)"""
        scale = "(CASE WHEN greatest(nx, ny)::DOUBLE / least(nx, ny) <= 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END)"
        wide = f""", CASE WHEN nx = 0 OR ny = 0 THEN 0.0::DOUBLE WHEN greatest(nx, ny)::DOUBLE / least(nx, ny) < 1.5 THEN greatest(ratio, 0.95::DOUBLE * greatest(sort, st))
            ELSE greatest(ratio, {scale} * p1.r, 0.95::DOUBLE * {scale} * CASE WHEN z <> '' THEN 100.0::DOUBLE ELSE greatest(p2.r, p3.r) END) END AS wratio
            FROM o LEFT JOIN pr p1 ON p1.a = x AND p1.b = y LEFT JOIN pr p2 ON p2.a = sx AND p2.b = sy LEFT JOIN pr p3 ON p3.a = ox AND p3.b = oy"""
    parts += f", fz AS MATERIALIZED (SELECT x, y, ratio, sort, st{wide or ' FROM o'})"
    both = "".join(f", {side}.{c} AS {side}_{name}" for side in ("n", "a") for c, name in (("st", "set"), ("sort", "sort"), ("ratio", "ratio"), *((("wratio", "wratio"),) if wratio else ())))
    return f"(WITH {parts} SELECT b.*{both} FROM b JOIN fz n ON n.x = sn AND n.y = tn JOIN fz a ON a.x = sa AND a.y = ta)"


def _texts(pairs: str) -> str:
    return f"SELECT c.*, s.old_name AS sn, s.old_address AS sa, coalesce(t.old_name, '') AS tn, coalesce(t.old_address, '') AS ta FROM ({pairs}) c JOIN s1 s ON s.entity_id = c.sid LEFT JOIN t ON t.entity_id = c.tid"


def _linear(pairs: str) -> str:
    """The pairs with name_score, address_score and match."""
    return f"(SELECT *, name_score * {CFG.name_weight}::DOUBLE + address_score * {CFG.address_weight}::DOUBLE AS match FROM (SELECT *, n_set::REAL::DOUBLE / 100 AS name_score, a_set::REAL::DOUBLE / 100 AS address_score FROM {fuzzy(_texts(pairs))}))"


def _length_ratio(a: str, b: str) -> str:
    return f"least(length({a}), length({b})) / (greatest(length({a}), length({b})) + 1e-5)"


def _digit_jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({digits(a)}) = 0 AND len({digits(b)}) = 0 THEN -1.0::DOUBLE ELSE {jac(digits(a), digits(b))} END"


_order = "md5('42|' || sid)"
_COMBINED = """SELECT s1.entity_id AS source1_entity_id, coalesce(string_agg(sc.tid, ',' ORDER BY rnk), '') AS candidate_entity_ids, coalesce(string_agg(sc.tid, ',' ORDER BY rnk) FILTER (sc.score >= 0.5), '') AS matched_entity_ids
    FROM s1 LEFT JOIN sc ON sc.sid = s1.entity_id GROUP BY s1.entity_id"""
_SPLIT = f"SELECT sid FROM (SELECT sid, row_number() OVER (PARTITION BY s1.country, n_true ORDER BY {_order}, sid) AS place, count(*) OVER (PARTITION BY s1.country, n_true) AS size FROM g JOIN s1 ON s1.entity_id = g.sid) WHERE place <= round_even(size * 0.2::DOUBLE, 0)"
_SCORES = {"n_set": "n_set", "n_sort": "n_sort", "n_ratio": "n_ratio", "a_set": "a_set", "a_sort": "a_sort", "a_ratio": "a_ratio", "len_n": _length_ratio("sn", "tn"), "len_a": _length_ratio("sa", "ta"), "block_score": "block_score"}
_SCORES |= {"n_wratio": "n_wratio", "a_wratio": "a_wratio", "n_digit": _digit_jaccard("sn", "tn"), "a_digit": _digit_jaccard("sa", "ta")}
_TOP = "SELECT sid, tid, block_score, rnk FROM top"
_MISSED = "SELECT p.sid, p.tid FROM p LEFT JOIN v2 USING (sid, tid) WHERE v2.sid IS NULL"
_AT = ", ".join(f"sum(({c}::REAL >= {t})::INT)::BIGINT AS {c}_{t}" for c in ("n_set", "n_ratio", "a_set", "a_ratio") for t in (60, 80, 90))
_T = f"{CFG.linear_threshold}::DOUBLE"

BODIES = {
    "norm_text": "SELECT entity_id, old_name, old_address FROM n",
    "norm_ascii": "SELECT entity_id, trim(regexp_replace(strip_accents(lower(business_name)), '[^a-z0-9]+', ' ', 'g')) AS name FROM r",
    "norm_tokens": f"SELECT entity_id, {joined(f'list_sort({tokens("old_name")})')} AS name_tokens, {joined(f'list_sort({tokens("old_address")})')} AS address_tokens FROM n",
    "norm_raw_tokens": f"SELECT entity_id, {joined(f'list_sort({tokens("replace(lower(business_name), chr(223), chr(115) || chr(115))")})')} AS name_tokens FROM r",
    "norm_strong_name": f"SELECT entity_id, {joined(mapped('old_name', LEGAL))} AS strong_name FROM n",
    "norm_core_name": "SELECT entity_id, core_name FROM e",
    "norm_strong_address": f"SELECT entity_id, strong_address, {joined(f'list_sort(list_distinct({mapped("old_address", ADDRESS_LONG)}))')} AS strong_address_long FROM e",
    "norm_char3grams": f"SELECT entity_id, {joined(f'list_sort({grams("core_name")})')} AS name_grams, {joined(f'list_sort({grams("strong_address")})')} AS address_grams FROM e",
    "norm_digits": f"SELECT entity_id, {joined(f"list_sort({digits("old_name || ' ' || old_address")})")} AS digits FROM n",
    "df_name_tokens": _df("ntok"), "df_addr_tokens": _df("atok"), "df_name_grams": _df("ngram"), "df_addr_grams": _df("agram"),
    "df_global_tokens": "SELECT key, sum(df)::BIGINT AS df FROM df WHERE kind = 'ntok' GROUP BY key",
    "df_vocab_restricted": "SELECT kind, country, key, df FROM df WHERE kind IN ('ntok', 'atok') AND (kind, country, key) IN (SELECT (kind, country, key) FROM k WHERE src = 1)",
    "top_tokens_by_country": "SELECT country, key, df, row_number() OVER (PARTITION BY country ORDER BY df DESC, key)::BIGINT AS rank FROM df WHERE kind = 'ntok' QUALIFY rank <= 30",
    "top_tokens": "SELECT key, sum(df)::BIGINT AS df FROM df WHERE kind = 'ntok' GROUP BY key ORDER BY df DESC, key LIMIT 30",
    "distinct_keys": "SELECT kind, count(*)::BIGINT AS n_keys FROM df GROUP BY kind",
    "block_exact_name": _block("exact"), "block_core_name": _block("core"), "block_strong_addr": _block("addr"), "block_rare_name_tok": _block("ntok"), "block_rare_addr_tok": _block("atok"),
    "block_name_gram_top1": _block("ngram"), "block_addr_gram_top1": _block("agram"), "block_name_gram_top3": _block("ngram", k=3), "block_addr_gram_top3": _block("agram", k=3),
    "block_union_v1": _union("exact", "atok"), "block_union_v2": _union("exact", "atok", "ntok"), "block_scored": "SELECT sid, tid, block_score FROM c",
    "topk_block": "SELECT s1.entity_id AS source1_entity_id, coalesce(string_agg(top.tid, ',' ORDER BY rnk), '') AS candidate_entity_ids FROM s1 LEFT JOIN top ON top.sid = s1.entity_id GROUP BY s1.entity_id",
    "topk_budgets": f"SELECT budget::BIGINT AS budget, count(*)::BIGINT AS candidates, count(DISTINCT sid)::BIGINT AS s1_with_candidates FROM top JOIN (SELECT unnest([{', '.join(map(str, BUDGETS))}]) AS budget) ON rnk <= budget GROUP BY budget",
    "cand_stats": f"SELECT sum(n)::BIGINT AS candidates, sum((n > 0)::INT)::BIGINT AS s1_with_candidates, round(sum(n)::DOUBLE / count(*), 6) AS avg_candidates, {_at(0.95)} AS p95, {_at(0.99)} AS p99 FROM ({_per})",
    "pairs_exploded": "SELECT DISTINCT sid, tid FROM p",
    "match_count_dist": "SELECT n_true AS n_matches, count(*)::BIGINT AS records, CASE n_true WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE '>1' END AS bucket, round(count(*)::DOUBLE / (SELECT count(*) FROM g), 6) AS share FROM g GROUP BY n_true",
    "target_multiplicity": "SELECT n_s1, count(*)::BIGINT AS targets FROM (SELECT tid, count(*)::BIGINT AS n_s1 FROM (SELECT DISTINCT sid, tid FROM p) GROUP BY tid) GROUP BY n_s1",
    "dup_ids": "SELECT count(*)::BIGINT AS n_ids, coalesce(sum(CASE WHEN n > 1 THEN n END), 0)::BIGINT AS n_rows_of_repeated, coalesce(sum(n - 1), 0)::BIGINT AS surplus FROM (SELECT count(*) AS n FROM r GROUP BY entity_id)",
    "data_profile": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*)::BIGINT AS n_rows, (count(*) - count({c}))::BIGINT AS n_null, count(DISTINCT {c})::BIGINT AS n_distinct FROM r" for c in ("entity_id", "business_name", "business_address", "country")),
    "country_counts": "SELECT country, count(*)::BIGINT AS n FROM r GROUP BY country",
    "source_counts": "SELECT src::BIGINT AS src, count(*)::BIGINT AS n FROM r GROUP BY src",
    "recall_exact": _recall("SELECT sid, tid FROM xm"),
    "oracle_recall": _recall("SELECT sid, tid FROM top"),
    "recall_by_matchcount": "SELECT n_true, count(*)::BIGINT AS records, sum(n_true)::BIGINT AS true_pairs, sum(tp)::BIGINT AS found, round(avg(CASE WHEN n_true = 0 THEN 1.0 ELSE tp / n_true::DOUBLE END), 6) AS recall FROM xo GROUP BY n_true",
    "recall_all_some_zero": "SELECT sum((tp = n_true)::INT)::BIGINT AS all_found, sum((tp > 0 AND tp < n_true)::INT)::BIGINT AS some_found, sum((tp = 0 AND n_true > 0)::INT)::BIGINT AS none_found FROM xo",
    "combined_blocker_thresholds": _thresholds("SELECT sid, tid, 0 AS df FROM xm UNION ALL " + _met("'ntok', 'atok'")),
    "candidate_counts_by_threshold": "SELECT threshold, candidates, s1_with_candidates, avg_candidates FROM (" + _thresholds(_met("'ntok'")) + ")",
    "addr_candidate_counts": "SELECT threshold, candidates, s1_with_candidates, avg_candidates FROM (" + _thresholds(_met("'atok'")) + ")",
    "matches_lookup": "SELECT DISTINCT p.sid, p.tid, r.business_name, r.business_address, r.country FROM p JOIN r ON r.entity_id = p.tid WHERE p.sid = (SELECT min(sid) FROM p)",
    "rare_coverage_curve": _curve(_low("ntok")), "rare_addr_coverage_curve": _curve(_low("atok")),
    "rarest_describe": "SELECT count(df)::BIGINT AS n, round(avg(df), 6) AS mean, round(stddev_samp(df), 6) AS std, min(df)::BIGINT AS min, max(df)::BIGINT AS max, " + ", ".join(f"round(quantile_cont(df::DOUBLE, {q}), 6) AS {x}" for q, x in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"))) + f" FROM ({_low('ntok')})",
    "missed_name_signal": _curve(f"SELECT q.* FROM ({_low('ntok')}) q WHERE (q.sid, q.tid) NOT IN (SELECT (sid, tid) FROM xm)"),
    "overlap_name": _overlap("sn", "tn"), "overlap_addr": _overlap("sa", "ta"),
    "miss_categories": """SELECT category, count(*)::BIGINT AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM pt), 2) AS percent FROM (SELECT CASE WHEN sc = tc AND sn = tn THEN 'BOTH_SAME' WHEN sc = tc THEN 'COUNTRY_SAME_NAME_DIFFERENT' WHEN sn = tn THEN 'COUNTRY_DIFFERENT_NAME_SAME' ELSE 'BOTH_DIFFER' END AS category FROM pt) GROUP BY category""",
    "address_signal": "SELECT count(*)::BIGINT AS n_pairs, sum((sa = ta)::INT)::BIGINT AS same_address, sum((sn <> tn)::INT)::BIGINT AS name_differs, sum((sn <> tn AND sa = ta)::INT)::BIGINT AS name_differs_same_address, round(avg((sa = ta)::INT), 6) AS rate FROM pt",
    "strong_norm_recovery": """SELECT count(*)::BIGINT AS n_pairs, sum(f::INT)::BIGINT AS full_name, sum(c::INT)::BIGINT AS core_name, sum(a::INT)::BIGINT AS strong_address, sum((f OR c OR a)::INT)::BIGINT AS any_strong, sum(b::INT)::BIGINT AS blocked_v2, sum(((f OR c OR a) AND NOT b)::INT)::BIGINT AS gained
        FROM (SELECT sc = tc AND sn = tn AS f, sc = tc AND s_core = t_core AND s_core <> '' AS c, sc = tc AND s_strong = t_strong AND s_strong <> '' AS a, v2.sid IS NOT NULL AS b FROM pt LEFT JOIN v2 USING (sid, tid))""",
    "gram_ceiling": "SELECT " + ", ".join(f"sum(({c} >= {i})::INT)::BIGINT AS {x}_{i}" for c, x in (("a", "name"), ("b", "address")) for i in (1, 2, 3)) + " FROM (SELECT sid, tid, sum((kind = 'ngram')::INT) AS a, sum((kind = 'agram')::INT) AS b FROM sh JOIN ok USING (kind, country, key) WHERE kind IN ('ngram', 'agram') GROUP BY sid, tid)",
    "topk_gram_ceiling": "SELECT k AS k, count(q.rank)::BIGINT AS recovered FROM (SELECT unnest([1, 2, 3])::BIGINT AS k) LEFT JOIN (SELECT sh.sid, sh.tid, min(rk.rank) AS rank FROM sh JOIN rk USING (sid, kind, country, key) WHERE kind IN ('ngram', 'agram') GROUP BY sh.sid, sh.tid) q ON q.rank <= k GROUP BY k",
    "posting_upper_bound": _bound("ngram"), "addr_posting_upper_bound": _bound("agram"),
    "digit_jaccard_feat": f"""SELECT sid, tid, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN -1.0::DOUBLE ELSE {jac("x", "y")} END, 6) AS digit_jaccard FROM (SELECT sid, tid, {digits("sn || ' ' || sa")} AS x, {digits("tn || ' ' || ta")} AS y FROM ct)""",
    "len_ratio_feat": "SELECT sid, tid, " + ", ".join(f"round(least(length({a}), length({b})) / (greatest(length({a}), length({b})) + 1e-5), 6) AS {x}" for a, b, x in (("sn", "tn", "len_n"), ("sa", "ta", "len_a"))) + " FROM ct",
    "eval_macro_f05": f"SELECT {MACRO} FROM (SELECT * FROM sw WHERE threshold = 0.5)",
    "threshold_sweep": f"SELECT threshold, {MACRO} FROM sw GROUP BY threshold",
    "best_threshold": f"SELECT threshold, macro_f05 FROM (SELECT threshold, {MACRO} FROM sw GROUP BY threshold) ORDER BY macro_f05 DESC, threshold LIMIT 1",
    "matched_output": "SELECT s1.entity_id AS source1_entity_id, coalesce(string_agg(q.tid, ',' ORDER BY rnk), '') AS matched_entity_ids FROM s1 LEFT JOIN (SELECT * FROM sc WHERE score >= 0.5) q ON q.sid = s1.entity_id GROUP BY s1.entity_id",
    "topk_by_match": "SELECT sid, tid, match_q, row_number() OVER (PARTITION BY sid ORDER BY match_q DESC, tid DESC)::BIGINT AS rnk FROM (SELECT sid, tid, least(greatest(round_even(score * 1000, 0), 0), 1000)::BIGINT AS match_q FROM sc) QUALIFY rnk <= 5",
    "score_histogram": "SELECT round_even(score * 20, 0) / 20 AS bin, p.sid IS NOT NULL AS is_true, count(*)::BIGINT AS n FROM sc LEFT JOIN p USING (sid, tid) GROUP BY ALL",
    "class_balance": "SELECT (p.sid IS NOT NULL)::INT::DOUBLE AS label, count(*)::BIGINT AS n FROM top LEFT JOIN p USING (sid, tid) GROUP BY ALL",
    "split_stratified": f"SELECT sid, country, n_matches FROM (SELECT sid, s1.country, n_true AS n_matches, row_number() OVER (PARTITION BY s1.country, n_true ORDER BY {_order}, sid) AS place, count(*) OVER (PARTITION BY s1.country, n_true) AS size FROM g JOIN s1 ON s1.entity_id = g.sid) WHERE place <= round_even(size * 0.2::DOUBLE, 0)",
    "sample_rows": "SELECT entity_id FROM r ORDER BY md5('42|' || entity_id), entity_id LIMIT 50",
    "scan_full": "SELECT entity_id, business_name, business_address, country, src::BIGINT AS src FROM r",
    "pending_rows": "SELECT entity_id FROM s1 WHERE country IS DISTINCT FROM 'en'",
    "combined_output": _COMBINED, "resumed_output": _COMBINED,
    "output_totals": f"SELECT count(*)::BIGINT AS records, sum(len(list_filter(string_split(candidate_entity_ids, ','), lambda x: x <> '')))::BIGINT AS candidates, sum(len(list_filter(string_split(matched_entity_ids, ','), lambda x: x <> '')))::BIGINT AS matches FROM ({_COMBINED})",
    "validation_rows": f"SELECT entity_id, country FROM s1 WHERE entity_id IN ({_SPLIT})",
    "training_rows": f"SELECT entity_id, country FROM s1 WHERE entity_id NOT IN ({_SPLIT})",
    "retained_targets": "SELECT entity_id, old_name FROM t WHERE entity_id IN (SELECT tid FROM top)",
    "quantised_matches": "SELECT sid, tid, match_q FROM (SELECT sid, tid, least(greatest(round_even(score * 1000, 0), 0), 1000)::BIGINT AS match_q FROM sc) WHERE match_q >= 500",
    "gram_ceiling_grid": f"""SELECT max_df, k, count(DISTINCT q.sid || '|' || q.tid)::BIGINT AS recovered FROM (SELECT unnest([{', '.join(map(str, GRAM_LIMITS))}])::BIGINT AS max_df) CROSS JOIN (SELECT unnest([1, 2, 3])::BIGINT AS k)
        LEFT JOIN (SELECT sh.sid, sh.tid, g.df, g.rank FROM sh JOIN (SELECT k.entity_id AS sid, k.kind, k.country, k.key, df.df, row_number() OVER (PARTITION BY k.entity_id, k.kind ORDER BY df.df, k.key) AS rank
          FROM k JOIN df USING (kind, country, key) WHERE k.src = 1 AND kind IN ('ngram', 'agram') AND df.df <= {max(GRAM_LIMITS)}) g USING (sid, kind, country, key)) q ON q.df <= max_df AND q.rank <= k GROUP BY max_df, k""",
    "fuzzy_features13": f"SELECT sid, tid, rnk::INT AS rnk, {', '.join(f'({x})::REAL AS {c}' for c, x in _SCORES.items())} FROM {fuzzy(_texts(_TOP), wratio=True)}",
    "linear_match_v2": f"SELECT sid, tid, name_score, address_score, match FROM {_linear(_block('exact', 'ntok', 'atok'))} WHERE match >= {_T}",
    "match_v4_topk": f"""SELECT sid, tid, match_q, block_score, row_number() OVER (PARTITION BY sid ORDER BY match_q DESC, block_score DESC, tid DESC)::INT AS rnk
        FROM (SELECT sid, tid, block_score, least(greatest(round_even(match * 1000, 0), 0), 1000)::INT AS match_q FROM {_linear('SELECT * FROM c')}) QUALIFY rnk <= {CFG.top_k}""",
    "fuzzy_ceiling": f"SELECT count(*)::BIGINT AS missed, {_AT}, sum((greatest(n_set::REAL, a_set::REAL, n_ratio::REAL, a_ratio::REAL) >= 80)::INT)::BIGINT AS any_80 FROM {fuzzy(_texts(_MISSED))}",
    "error_examples": f"""WITH scored AS MATERIALIZED (SELECT sid, tid, match, p2.sid IS NOT NULL AS is_true FROM {_linear(_TOP)} LEFT JOIN (SELECT DISTINCT sid, tid FROM p) p2 USING (sid, tid))
        (SELECT 'missed' AS error, sid, tid, NULL::DOUBLE AS match FROM (SELECT DISTINCT sid, tid FROM p) WHERE (sid, tid) NOT IN (SELECT (sid, tid) FROM scored) ORDER BY sid, tid LIMIT 30) UNION ALL
        (SELECT 'low_true', sid, tid, match FROM scored WHERE is_true AND match < {_T} ORDER BY match, sid, tid LIMIT 30) UNION ALL
        (SELECT 'false', sid, tid, match FROM scored WHERE NOT is_true AND match >= {_T} ORDER BY match DESC, sid, tid LIMIT 30)""",
}


def oracle_sql() -> dict[str, str]:
    return {name: query(body).replace("w[7:]", f"w[7:{6 + ADDRESS_WORDS}]") if name in SCORED else query(body) for name, body in BODIES.items()}
