"""SQL twins (DuckDB) of the training-data queries that SQL can express, over whole tables."""

from __future__ import annotations

import re

from . import line_dedup, neardup, ngram_join, pii, quality_rules, secrets

_DOCS = "d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)"


def _spans(kinds: dict[str, str]) -> str:
    """CTE ``s``: (r, kind, k, i, m, st, en) of every match of each kind's pattern, offsets in code points."""
    parts = " UNION ALL ".join(
        f"SELECT r, t, '{kind}' AS kind, {k} AS k, regexp_extract_all(t, $p${p}$p$) AS ms, string_split_regex(t, $p${p}$p$) AS ps FROM d"
        for k, (kind, p) in enumerate(kinds.items())
    )
    return f"""f AS ({parts}), g AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM f),
    h AS (SELECT r, t, kind, k, i, ps, ms[i] AS m, list_sum(list_transform(ps[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS st FROM g),
    s AS (SELECT *, st + length(m) AS en FROM h)"""


def _tags(where: str, order: str) -> str:
    return f"coalesce(string_agg(kind || ':' || st::BIGINT || ':' || en::BIGINT, ',' ORDER BY {order}) FILTER (WHERE {where}), '')"


def _pii() -> str:
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": pii.IBAN,
        "ssn": pii.SSN,
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    at = f"substr({digits}, length({digits}) - i2 + 1, 1)::INT"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i2: CASE WHEN i2 % 2 = 1 THEN {at} WHEN {at} * 2 > 9 THEN {at} * 2 - 9 ELSE {at} * 2 END)) % 10 = 0"
    turned = "(substr(m, 5) || substr(m, 1, 4))"
    code = "CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END"
    mod97 = f"list_reduce(list_prepend(0, list_transform(string_split({turned}, ''), lambda c: {code})), lambda a, x: (a * (CASE WHEN x > 9 THEN 100 ELSE 10 END) + x) % 97) = 1"
    context = " ".join(f"WHEN kind = '{k}' THEN regexp_matches(before, $p${p}$p$) OR regexp_matches(behind, $p${p}$p$)" for k, p in pii.CONTEXT.items())
    return f"""WITH {_DOCS}, {_spans(kinds)},
    ok AS (SELECT *, substr(t, (greatest(st - {pii.CONTEXT_CHARS}, 0) + 1)::BIGINT, (st - greatest(st - {pii.CONTEXT_CHARS}, 0))::BIGINT) AS before, substr(ps[i + 1], 1, {pii.CONTEXT_CHARS}) AS behind FROM s WHERE CASE kind
        WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') > '255'))) = 0
        WHEN 'card' THEN length({digits}) BETWEEN 16 AND 19 AND {luhn}
        WHEN 'phone' THEN length({digits}) BETWEEN 8 AND 15
        WHEN 'iban' THEN {mod97} ELSE true END),
    scored AS (SELECT *, CASE {context} END AS ctx FROM ok),
    kept AS (SELECT * FROM scored WHERE kind != 'ssn' OR ctx),
    a AS (SELECT r, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in kinds)},
        count(*) FILTER (WHERE kind IN ('card', 'iban') OR (kind != 'ssn' AND ctx)) AS n_strong,
        {_tags('k < 4', 'k, st')} AS base, {_tags('true', 'k, st')} AS spans FROM kept GROUP BY r)
    SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in kinds)}, coalesce(n_strong, 0) AS n_strong,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)"""


def _secrets() -> str:
    either = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    assign = rf"""(?:{either})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
    kinds = {"assign": assign, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]{24,}", "entropy": secrets.CANDIDATE}
    group = rf"""regexp_extract(m, $p$^(?:{either})["']?\x20*[:=]\x20*["']?(.*)$p$, 1)"""
    allow = " OR ".join(f"regexp_matches(m, $p${p}$p$)" for p in (rule.replace("++", "+") for rule in secrets.ALLOW))  # RE2 has no possessive forms
    table = "[" + ", ".join(map(str, secrets.CLOGC)) + "]"
    w = secrets.WINDOW
    least = f"""(SELECT r, st, min(total) AS best FROM (
        SELECT r, st, j, sum(({table})[n + 1]) AS total FROM (
            SELECT r, st, j, c, count(*) AS n FROM (
                SELECT r, st, j, unnest(string_split(substr(m, j, {w}), '')) AS c FROM (
                    SELECT r, st, m, unnest(range(1, length(m) - {w} + 2)) AS j FROM maybe)) GROUP BY ALL) GROUP BY ALL) GROUP BY ALL)"""
    return f"""WITH {_DOCS}, {_spans(kinds)},
    maybe AS (SELECT * FROM s WHERE kind = 'entropy' AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT ({allow})),
    strong AS (SELECT maybe.* FROM maybe JOIN {least} x USING (r, st)
        WHERE best <= CASE WHEN regexp_matches(m, '^[0-9a-fA-F]+$') THEN {secrets.BOUND['hex']} ELSE {secrets.BOUND['base64']} END),
    kept AS (SELECT * FROM s WHERE (kind = 'assign' AND length({group}) >= 6) OR (kind = 'access' AND length(m) >= 20) OR kind = 'hex'
        UNION ALL SELECT * FROM strong),
    a AS (SELECT r, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in kinds)},
        {_tags('k < 3', 'st, k')} AS base, {_tags('true', 'st, k')} AS spans FROM kept GROUP BY r)
    SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in kinds)},
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)"""


def _lines() -> str:
    return f"""WITH {_DOCS.replace("doc_id,", "doc_id, coalesce(source, '') AS site,")},
    l AS (SELECT r, doc_id, site, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i, unnest(string_split(t, chr(10))) AS raw FROM d),
    x AS (SELECT *, trim(raw, ' ') AS line FROM l),
    bad AS (SELECT line, min(doc_id) AS first_id FROM x WHERE line != '' GROUP BY line HAVING count(DISTINCT site) >= {line_dedup.MIN_SITES}),
    y AS (SELECT x.*, bad.line IS NOT NULL AND doc_id IS DISTINCT FROM first_id AS gone FROM x LEFT JOIN bad USING (line)),
    a AS (SELECT r, count(*) FILTER (WHERE line != '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
        coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM y GROUP BY r)
    SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM d JOIN a USING (r)"""


def _warc() -> str:
    sextet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    five = "('0x' || substr(hexed, 1 + 5 * i, 5))::BIGINT"
    chars = " || ".join(f"substr('{sextet}', (({five} // {32 ** k}) % 32 + 1)::BIGINT, 1)" for k in (3, 2, 1, 0))
    return f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hexed FROM pages),
    q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 8), lambda i: {chars}), '') AS payload_digest,
        CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != top THEN top END AS refers_to FROM q"""


def _rules() -> str:
    rules = quality_rules.RULES
    value = lambda v: re.sub(r" / (\w+)", r" / nullif(\1, 0)", v)
    grid = " UNION ALL ".join(
        f"SELECT stratum, quality, {r} AS rule, {c} AS cutoff, coalesce({value(v)} {'>' if large else '<'} {c}, false) AND NOT base_failed AS rej FROM labelled"
        for r, (_, v, large, cuts) in enumerate(rules)
        for c in cuts
    )
    alpha = quality_rules.ALPHA / len(rules)
    n_cuts = sum(len(rule[3]) for rule in rules)
    term = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha!r}) + (n - i) * ln(1 - {alpha!r}))"
    failed = ", ".join(
        f"CASE WHEN coalesce({value(v)} {'>' if large else '<'} (SELECT cutoff FROM chosen c WHERE c.stratum = own.stratum AND rule = {r}), false) THEN '{name}' END"
        for r, (name, v, large, _) in enumerate(rules)
    )
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
    win AS (SELECT r, i, count(*) OVER (PARTITION BY r, tri) AS n FROM (
        SELECT r, i, ws[i:i+2] AS tri FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))),
    rep AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM win WHERE n > 1) GROUP BY r),
    ln AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
    own AS (SELECT r, doc_id, stratum, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_upper,
        len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        len(ws) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(ws) AS base_failed
        FROM d JOIN w USING (r) JOIN ln USING (r) LEFT JOIN rep USING (r)),
    truth AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
    labelled AS (SELECT own.*, quality FROM own JOIN truth USING (doc_id)),
    grid AS ({grid}),
    counts AS (SELECT stratum, rule, cutoff, count(*) FILTER (WHERE quality = 1) AS n, count(*) FILTER (WHERE quality = 1 AND rej) AS k,
        count(*) FILTER (WHERE rej) AS gone FROM grid GROUP BY ALL),
    tested AS (SELECT *, (SELECT sum({term}) FROM (SELECT unnest(range(0, k + 1)) AS i)) AS p FROM counts WHERE n > 0 AND k < {alpha!r} * n),
    safe AS (SELECT * FROM tested WHERE p <= {quality_rules.DELTA!r} / (greatest(1, (SELECT count(*) FROM (SELECT DISTINCT stratum FROM labelled))) * {n_cuts}) AND gone > 0),
    chosen AS (SELECT stratum, rule, arg_max(cutoff, gone * 1000000 + 999999 - cutoff) AS cutoff FROM safe GROUP BY ALL),
    v AS (SELECT *, list_filter([{failed}], lambda x: x IS NOT NULL) AS failed FROM own)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(failed) = 0 AS kept,
        array_to_string(failed, ',') AS failed_rules FROM v"""


def _near(n: int, percent: int, columns: str) -> str:
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT r, doc_id, array_to_string(w[i:i+{n - 1}], ' ') AS g FROM (
        SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - {n - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
    z AS (SELECT r, doc_id, count(*) AS n FROM s GROUP BY ALL),
    o AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
    e AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM o JOIN z x ON o.a = x.r JOIN z y ON o.b = y.r WHERE 100 * k >= {percent} * (x.n + y.n - k)),
    u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a),
    c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id{columns} FROM d LEFT JOIN z USING (r, doc_id) JOIN c USING (doc_id)"""


def _contamination() -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH b AS (SELECT item_id, {words} AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (
        SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
    d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
    dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
        SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
    h AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
    a AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM h GROUP BY r),
    c AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN a USING (r) LEFT JOIN c USING (r)"""


def _audit() -> str:
    w = "regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')"
    letters = "'A', 'B', 'C', 'D', 'E'"
    orders = " || ".join(f"x{i}.l" for i in range(5))
    tables = ", ".join(f"l x{i}" for i in range(5))
    apart = " AND ".join(f"x{i}.l != x{j}.l" for i in range(5) for j in range(i))
    total = lambda value, where: f"coalesce(sum({value}) FILTER (WHERE {where}), 0)::BIGINT"
    mine, gone = "contains(f, letter)", "len(list_filter(string_split(f, ''), lambda x: x != '' AND contains(before, x))) > 0"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    x AS (SELECT d.*, {w} AS w FROM d),
    y AS (SELECT r, doc_id, part, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN EXISTS (SELECT 1 FROM d e WHERE e.t = x.t AND e.doc_id < x.doc_id) THEN 'E' ELSE '' END AS f FROM x),
    z AS (SELECT part, f, EXISTS (SELECT 1 FROM labels b WHERE b.doc_id = y.doc_id AND b.quality = 1) AS good,
        EXISTS (SELECT 1 FROM labels b WHERE b.doc_id = y.doc_id AND b.toxic = 1) AS toxic FROM y),
    c AS (SELECT part, f, good, toxic, count(*) AS n FROM z GROUP BY ALL),
    l AS (SELECT unnest([{letters}]) AS l),
    o AS (SELECT {orders} AS filter_order FROM {tables} WHERE {apart}),
    s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before
        FROM (SELECT DISTINCT part FROM c), o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
    a AS (SELECT part, filter_order, step, letter, {total('n', f'NOT {mine} AND NOT {gone}')} AS kept, {total('n', f'{mine} AND NOT {gone}')} AS removed,
        {total('n', f'{mine} AND {gone}')} AS redundant, {total('n', 'f = letter')} AS unique_fails,
        {total('n', f'good AND {mine} AND NOT {gone}')} AS good_lost, {total('n', f'toxic AND {mine} AND NOT {gone}')} AS toxic_lost FROM s JOIN c USING (part) GROUP BY ALL)
    SELECT * EXCLUDE (letter), sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM a"""


def _merkle() -> str:
    told = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda n: "sha256(" + " || ".join(told(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
    byte = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"
    digits = "list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, b: {byte}), 4294967295::BIGINT)"
    # Every tree's levels: parents of runs of two until one node remains.
    tree = lambda name, leaves: f"""{name} AS (SELECT tree, 0 AS level, pos, node, n FROM {leaves} UNION ALL
        SELECT tree, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), ((n + 1) // 2)::BIGINT FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 2, n)"""  # noqa: E731
    path = lambda name, nodes: f"""{name} AS (SELECT tree, pos AS row_pos, 0 AS level, pos, n FROM {nodes} WHERE level = 0 UNION ALL
        SELECT tree, row_pos, level + 1, pos // 2, ((n + 1) // 2)::BIGINT FROM {name} WHERE n > 1)"""  # noqa: E731
    flank = lambda w, t: f"""SELECT w.tree, w.row_pos, w.level, CASE WHEN w.pos % 2 = 1 THEN q.node ELSE '' END AS l, CASE WHEN w.pos % 2 = 0 THEN coalesce(q.node, '') ELSE '' END AS r
        FROM {w} w LEFT JOIN {t} q ON q.tree = w.tree AND q.level = w.level AND q.pos = xor(w.pos, 1::BIGINT) WHERE w.n > 1"""  # noqa: E731
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('1' || lang, '0') AS tree, {leaf('n_chars')} AS node,
        CASE WHEN {crc} % 7 = 0 THEN {leaf('(n_chars + 1)')} ELSE {leaf('n_chars')} END AS changed FROM documents),
    e AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
    {tree('t', 'e')}, sub AS (SELECT '' AS tree, tree AS lang_tree, node, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
    {tree('u', 'sub')}, {path('wt', 't')}, {path('wu', 'u')},
    ft AS ({flank('wt', 't')}), fu AS ({flank('wu', 'u')}),
    up AS (SELECT sub.lang_tree AS tree, sub.node AS subroot, list({{'l': l, 'r': r}} ORDER BY level) FILTER (WHERE l IS NOT NULL) AS p FROM sub LEFT JOIN fu ON fu.row_pos = sub.pos GROUP BY ALL),
    own AS (SELECT e.tree, e.pos, list({{'l': l, 'r': r}} ORDER BY level) FILTER (WHERE l IS NOT NULL) AS p FROM e LEFT JOIN ft ON ft.tree = e.tree AND ft.row_pos = e.pos GROUP BY ALL),
    a AS (SELECT e.doc_id, e.node AS leaf, subroot, (SELECT node FROM u WHERE n = 1) AS root, changed, list_concat(coalesce(own.p, []), coalesce(up.p, [])) AS p
        FROM e JOIN own USING (tree, pos) JOIN up USING (tree)),
    b AS (SELECT *, sha256(array_to_string(list_transform(p, lambda x: x.l || x.r), '')) AS proof_sha256,
        CASE WHEN len(p) = 0 THEN changed ELSE list_reduce(list_prepend(changed, list_transform(p, lambda x: x.l || '|' || x.r)),
            lambda acc, x: sha256(split_part(x, '|', 1) || acc || split_part(x, '|', 2))) END AS folded_root FROM a)
    SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM b"""


ORACLES: dict[str, str] = {
    "op2_pii": _pii(),
    "op4_line_dedup": _lines(),
    "op5_warc": _warc(),
    "op6_quality_rules": _rules(),
    "op8_near_dedup": _near(neardup.SHINGLE, neardup.PERCENT, ", doc_id = component_id AS kept"),
    "op9_secrets": _secrets(),
    "op10_decontamination": _contamination(),
    "op11_filter_audit": _audit(),
    "op12_merkle_manifest": _merkle(),
    "op13_ngram_join": _near(ngram_join.SHINGLE, ngram_join.PERCENT, ""),
}
