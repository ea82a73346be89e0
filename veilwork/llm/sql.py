"""SQL equivalents of the operators that SQL can express, for DuckDB."""

from __future__ import annotations

from veilwork.llm import mixing

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(digest: str) -> str:
    """Forty hex digits as base32: five of them are four characters."""
    value = f"('0x' || substr({digest}, g * 5 + 1, 5))::BIGINT"
    four = " || ".join(f"substr('{_BASE32}', (({value} >> {s}) & 31)::INT + 1, 1)" for s in (15, 10, 5, 0))
    return f"array_to_string(list_transform(range(0, 8), lambda g: {four}), '')"


WARC = f"""SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {_base32('sha1(h)')} AS payload_digest,
 CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
 FROM (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS f FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _between(rows: str, pattern: str) -> str:
    """doc_id, a, b, v of what stands between the matches of a pattern in the texts v of rows (doc_id, a, v)."""
    p, size = _quoted(pattern), "lambda x: length(x)"
    return f"""SELECT doc_id, a, a + length(v) AS b, v FROM (
     SELECT doc_id, a + coalesce(list_sum(list_transform(g[1:i - 1], {size})), 0)::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], {size})), 0)::BIGINT AS a, g[i] AS v
     FROM (SELECT *, unnest(range(1, len(g) + 1)) AS i FROM (SELECT doc_id, a, string_split_regex(v, {p}) AS g, regexp_extract_all(v, {p}) AS m FROM ({rows}))))"""


def _matches(pattern: str, group: int) -> str:
    """doc_id, a, b, v (the match), w (its group) of all matches, from the texts between them."""
    p = _quoted(pattern)
    size = "lambda x: length(x)"
    return f"""SELECT doc_id, a, a + length(v) AS b, v, w FROM (
     SELECT doc_id, coalesce(list_sum(list_transform(g[1:i], {size})), 0) + coalesce(list_sum(list_transform(m[1:i - 1], {size})), 0) AS a, m[i] AS v, n[i] AS w
     FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {group}) AS n,
      string_split_regex(text, {p}) AS g FROM documents WHERE regexp_matches(text, {p}))))"""


#: Base kinds as the contract gives them (pattern, group, fewest characters), and classes of the method: (pattern, window, bits of entropy).
_KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": ("AKIA[A-Z0-9]+", 0, 18),
    "hex": ("[0-9a-f]+", 0, 16),
}
_CLASSES = {
    "entropy_hex": ("[0-9A-Fa-f]{20,}", 20, 3.2),
    "entropy_base64": ("[A-Za-z0-9+/_-]{24,}", 24, 4.05),
    "entropy_lower": ("[a-z0-9]{20,}", 20, 3.65),
    "entropy_upper": ("[A-Z0-9]{20,}", 20, 3.65),
}
_ALLOWED = (
    "^[A-Za-z]+([-_/][A-Za-z]+)*$",
    "^[0-9]+([-_/][0-9]+)*$",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
_ALLOWED_PARTS = "(?i)(^|[-_/+])(example|sample|dummy|placeholder)([-_/+](example|sample|dummy|placeholder))*([-_/+]|$)"


def _secrets() -> str:
    base = " UNION ALL ".join(
        f"SELECT doc_id, a, {k} AS kind, b FROM ({_matches(pattern, group)}) WHERE length(w) >= {least}" for k, (pattern, group, least) in enumerate(_KINDS.values())
    )
    outside = "NOT EXISTS (SELECT 1 FROM base z WHERE z.doc_id = q.doc_id AND z.a <= q.a AND q.b <= z.b)"
    allowed = " OR ".join(f"regexp_matches(v, {_quoted(p)})" for p in _ALLOWED)
    parts = []
    for k, (pattern, window, bits) in enumerate(_CLASSES.values()):
        # the entropy in bits is log2(window) less the sum of c * log2(c) over the window's characters, by window; the sum in millionths
        total = f"list_sum(list_transform(map_values(list_histogram(string_split(substr(v, i::INT + 1, {window}), ''))), lambda n: round(1e6 * n * log2(n))::BIGINT))"
        most = f"floor(1e6 * {window} * (log2({window}) - {bits}))"
        parts.append(f"""SELECT doc_id, a + min(i) AS a, {len(_KINDS) + k} AS kind, a + max(i) + {window} AS b FROM (
         SELECT *, sum(CASE WHEN i > before + {window} OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, a ORDER BY i) AS run FROM (
          SELECT *, lag(i) OVER (PARTITION BY doc_id, a ORDER BY i) AS before FROM (
           SELECT doc_id, a, v, unnest(range(0, length(v) - {window} + 1)) AS i FROM ({_between(_matches(pattern, 0), _ALLOWED_PARTS)}) q WHERE {outside} AND length(v) >= {window} AND NOT ({allowed}))
          WHERE {total} <= {most})) GROUP BY doc_id, a, run""")
    names = "[" + ", ".join(map(_quoted, (*_KINDS, *_CLASSES))) + "]"
    listed = f"string_agg({names}[kind + 1] || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, kind, b)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {k}) AS n_{name}" for k, name in enumerate(_KINDS))
    return f"""WITH base AS MATERIALIZED ({base}),
     added AS (SELECT doc_id, a, kind, b FROM ({" UNION ALL ".join(parts)}) q WHERE {outside}),
     x AS (SELECT doc_id, {counts}, {listed} AS l FROM base GROUP BY doc_id),
     y AS (SELECT doc_id, {listed} AS l FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY doc_id)
     SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _KINDS)}, sha256(coalesce(x.l, '')) AS base_sha256, coalesce(y.l, '') AS spans
     FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN y ON y.doc_id = d.doc_id"""


SECRETS = _secrets()


def _mixed(repetition: float) -> str:
    key = lambda *parts: f"md5('{mixing.SEED}|' || " + " || '|' || ".join(parts) + ")"
    upto = "ROWS UNBOUNDED PRECEDING"
    return rf"""WITH RECURSIVE docs AS MATERIALIZED (
      SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
       ('0x' || substr({key("doc_id")}, 1, 8))::BIGINT % (SELECT greatest({mixing.BLOCKS}, ceil(count(*) / {mixing.BLOCK_ROWS}.0))::BIGINT FROM documents) AS block FROM documents),
     src AS MATERIALIZED (SELECT source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE / (SELECT sum(n_tokens) FROM docs) AS p FROM docs GROUP BY source),
     ends AS (SELECT min(p) AS least, max(p) AS most FROM src WHERE tokens > 0),
     b AS (SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high UNION ALL
      SELECT i + 1, CASE WHEN keeps THEN low ELSE mid END, CASE WHEN keeps THEN mid ELSE high END FROM (
       SELECT *, (low + high) / 2 AS mid, pow(least, (low + high) / 2 - 1) / pow(most, (low + high) / 2 - 1) <= {repetition} * (1 + 1e-12) AS keeps FROM b, ends)
      WHERE i < {mixing.LEVELS * mixing.PASSES}),
     e AS (SELECT CASE WHEN pow(least, -1.0) / pow(most, -1.0) <= {repetition} * (1 + 1e-12) THEN 0.0
      ELSE least(1.0, ceil((SELECT max_by(high, i) FROM b) * 1e6 - 1e-3) / 1e6) END AS a FROM ends),
     w AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(p, a) / (SELECT sum(pow(p, a)) FROM src, e WHERE tokens > 0) ELSE 0 END AS weight,
      CASE WHEN tokens > 0 THEN greatest(floor(pow(p, a - 1) / (SELECT min(pow(p, a - 1)) FROM src, e WHERE tokens > 0) * tokens + 0.5)::BIGINT, tokens) ELSE 0 END AS target FROM src, e),
     plan AS (SELECT *, CASE WHEN tokens > 0 THEN target // tokens ELSE 1 END AS epochs, CASE WHEN tokens > 0 THEN target % tokens ELSE 0 END AS rest FROM w),
     bl AS (SELECT source, block, sum(n_tokens) AS t FROM docs GROUP BY 1, 2),
     bo AS (SELECT *, sum(t) OVER o AS upto, row_number() OVER o AS block_rank FROM bl JOIN plan USING (source)
      WINDOW o AS (PARTITION BY source ORDER BY {key("epochs", "source", "block")}, block {upto})),
     dr AS (SELECT docs.doc_id, docs.source, docs.n_tokens, docs.block, block_rank, weight, epochs, rest > 0 AND upto <= rest AS whole, greatest(rest - upto + t, 0) AS room,
      sum(docs.n_tokens) OVER (PARTITION BY docs.source, docs.block ORDER BY {key("epochs", "docs.doc_id")}, docs.n_tokens {upto}) AS mine
      FROM docs JOIN bo ON bo.source = docs.source AND bo.block = docs.block)
     SELECT doc_id, source, n_tokens, unnest(range(0, epochs + CASE WHEN whole OR room > 0 AND mine <= room THEN 1 ELSE 0 END)) AS epoch, block, block_rank, round(weight, 9) AS weight FROM dr"""


MIXED = _mixed(2.0)

# bytes as hex digits: byte i is the two characters from 2 i + 1 on
REPEATS = """WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
 w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
 g AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM w) WHERE m < doc_id),
 r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
  SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM g)) GROUP BY doc_id, run),
 p AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM r),
 k AS (SELECT doc_id, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS gone, count(*) AS spans FROM p JOIN d USING (doc_id) GROUP BY doc_id)
 SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
 sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"


def _crc32(text: str) -> str:
    """CRC-32 of a text by a table in column crc, byte by byte."""
    own = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({own}, lambda s, b: xor(s >> 8, crc[(xor(s, b) & 255) + 1]), 4294967295), 4294967295)"


IMPORTANCE = f"""WITH t AS MATERIALIZED (SELECT {_CRC_TABLE} AS crc),
 d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_LETTERS}') AS words FROM documents),
 w AS MATERIALIZED (SELECT doc_id, unnest(words) AS w FROM d),
 g AS MATERIALIZED (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_LETTERS}')) AS w FROM benchmark),
 b AS MATERIALIZED (SELECT w, {_crc32("w")} % 10000 AS b FROM (SELECT w FROM w UNION SELECT w FROM g), t),
 s AS (SELECT b, count(*) AS n FROM w JOIN b USING (w) GROUP BY b), u AS (SELECT b, count(*) AS n FROM g JOIN b USING (w) GROUP BY b),
 k AS MATERIALIZED (SELECT x.b, floor(1000 * ln((coalesce(u.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM w) + 10000)::DOUBLE
  / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM g) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT DISTINCT b FROM b) x LEFT JOIN s ON s.b = x.b LEFT JOIN u ON u.b = x.b),
 o AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM w JOIN b USING (w) JOIN k USING (b) GROUP BY doc_id),
 z AS MATERIALIZED (SELECT d.doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296))))::BIGINT AS score
  FROM d LEFT JOIN o ON o.doc_id = d.doc_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM z)
 SELECT doc_id, n_features, n_features AS n_words, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM r"""

PERIODS = f"""WITH t AS MATERIALIZED (SELECT {_CRC_TABLE} AS crc),
 d AS MATERIALIZED (SELECT doc_id, {_crc32("doc_id::VARCHAR")} AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS v FROM documents, t),
 e AS MATERIALIZED (SELECT doc_id, v, len(v) AS n, h % 10 = 0 AS made, h // 10 AS g FROM d),
 m AS MATERIALIZED (SELECT doc_id, n, CASE WHEN made AND n > 0 THEN list_transform(range(n), lambda i: v[CASE WHEN i < g % n THEN i
  ELSE g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) END + 1]) ELSE v END AS v FROM e),
 w AS MATERIALIZED (SELECT doc_id, n, v[i + 1] AS w, i FROM (SELECT *, unnest(range(n)) AS i FROM m)),
 p AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.w = b.w AND a.i < b.i WHERE 2 * (b.i - a.i) <= a.n),
 s AS (SELECT doc_id, q, min(i) AS a, max(i) + 1 AS b FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM p) GROUP BY doc_id, q, k),
 r AS MATERIALIZED (SELECT doc_id, a, len, min(q) AS q FROM (SELECT doc_id, a, b - a + q AS len, q FROM s) WHERE len >= 12 AND len >= 2 * q GROUP BY doc_id, a, len),
 x AS (SELECT doc_id, count(*) AS n_runs, string_agg(a || ',' || len || ',' || q || chr(10), '' ORDER BY a, q) AS lines,
  first(a ORDER BY len DESC, a, q) AS "start", first(len ORDER BY len DESC, a, q) AS length, first(q ORDER BY len DESC, a, q) AS period FROM r GROUP BY doc_id),
 z AS (SELECT DISTINCT w.doc_id, w.i FROM w JOIN r ON r.doc_id = w.doc_id AND w.i >= r.a + r.q AND w.i < r.a + r.len),
 c AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS kept FROM w LEFT JOIN z ON z.doc_id = w.doc_id AND z.i = w.i WHERE z.i IS NULL GROUP BY w.doc_id)
 SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, "start", length, period, 1000 * length // period AS exponent_milli,
 sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
 FROM d LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id"""

#: Written out again, so that the SQL does not read what it checks: base phrases, function words, and notices (label, text, phrases).
_PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
_COMMON = "a all and any are as at be by for has in into is it no of on or that the this to use which will with without you"
_NOTICES = (
    ("agpl-3", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3", "gnu affero general public license"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("artistic-2", "distributed under the terms of the artistic license 2 0", "artistic license 2"),
    ("boost-1", "distributed under the boost software license version 1 0", "boost software license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms", "following conditions"),
    ("bsd", "use of this source code is governed by a bsd style license", "bsd style license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "attribution noncommercial 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "attribution sharealike 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work cc0 1 0 universal", "cc0 1 0"),
    ("epl-2", "are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "gnu general public license", "version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license", "version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "free of charge", "permission is hereby granted"),
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "spdx license identifier mit", "license identifier mit"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", "express or implied warranty"),
)


def _licenses() -> str:
    notices = ", ".join(f"({k}, '{n[0]}', string_split('{n[1]}', ' '))" for k, n in enumerate(_NOTICES))
    keys = ", ".join(f"({k}, ' {phrase} ')" for k, n in enumerate(_NOTICES) for phrase in n[2:])
    phrases = ", ".join(f"('{label}', string_split('{phrase}', ' '))" for label, phrase in _PHRASES)
    common = ", ".join(f"'{w}'" for w in _COMMON.split())
    listed = "list_aggregate(list_sort(list_distinct({})), 'string_agg', ',')"
    return f"""WITH n(t, label, ws) AS (VALUES {notices}), k(t, key) AS (VALUES {keys}), f(label, ps) AS (VALUES {phrases}),
     tw AS MATERIALIZED (SELECT t, label, ws, unnest(range(len(ws))) AS p, unnest(ws) AS w FROM n),
     idf AS (SELECT w, round(1000 * ln({len(_NOTICES) + 1}.0 / count(DISTINCT t)))::BIGINT AS v FROM tw GROUP BY w),
     ix AS MATERIALIZED (SELECT t, label, len(ws) AS size, p, w, v FROM tw JOIN idf USING (w) WHERE w NOT IN ({common}) QUALIFY row_number() OVER (PARTITION BY t ORDER BY v DESC, p) <= 8),
     total AS (SELECT t, sum(v) AS v FROM ix GROUP BY t),
     d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_LETTERS}') AS ws FROM documents),
     w AS MATERIALIZED (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM d),
     b AS MATERIALIZED (SELECT doc_id, i, label FROM w JOIN f ON ps[1] = w JOIN d USING (doc_id) WHERE ws[i + 1:i + len(ps)] = ps),
     o AS (SELECT doc_id, t, label, size, p, v, i - p AS o FROM w JOIN ix USING (w)),
     r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, t ORDER BY o) AS run FROM (
      SELECT *, CASE WHEN o <= lag(o) OVER (PARTITION BY doc_id, t ORDER BY o) + 3 THEN 0 ELSE 1 END AS fresh FROM o)),
     g AS (SELECT doc_id, t, label, size, run, min(low) AS low, max(high) AS high, sum(v) AS v FROM (
      SELECT doc_id, t, label, size, run, p, v, min(o) AS low, max(o) AS high FROM r GROUP BY doc_id, t, label, size, run, p, v) GROUP BY doc_id, t, label, size, run),
     s AS (SELECT doc_id, g.t, label, g.v::DOUBLE / total.v AS score, ' ' || array_to_string(ws[greatest(low - 3, 0) + 1:least(high + size + 3, len(ws))], ' ') || ' ' AS shown
      FROM g JOIN total ON total.t = g.t JOIN d USING (doc_id) WHERE g.v::DOUBLE / total.v >= 0.6),
     h AS (SELECT doc_id, label, score FROM s WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.t = s.t AND NOT contains(s.shown, k.key))),
     x AS (SELECT doc_id, count(*) AS n_base, min(i) AS a, max(i) AS z, list(label) AS labels FROM b GROUP BY doc_id),
     y AS (SELECT doc_id, max(score) AS score, list(label) AS labels FROM h GROUP BY doc_id)
     SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, a AS first_word, z AS last_word, coalesce({listed.format("x.labels")}, '') AS base_labels,
     coalesce({listed.format("list_concat(coalesce(x.labels, []), coalesce(y.labels, []))")}, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0) END::DOUBLE AS score
     FROM d LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN y ON y.doc_id = d.doc_id"""


LICENSES = _licenses()
