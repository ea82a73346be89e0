"""SQL equivalents of the registered queries, for DuckDB.

They restate results with other means where there are any: joins for folds,
windows for aggregates. Its regular expressions have no lookaround, so phone and
social security numbers have no equivalent here; tests hold those rules.
"""

from __future__ import annotations

from veilwork import fixtures as X
from veilwork.functions.rules import CATEGORY_WORDS, OTHER_CATEGORY

#: Rules in the dialect of the oracle; its classes are ASCII's.
PATTERNS = {
    "EMAIL": r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b",
    "CREDIT_CARD": r"\b(?:\d[ -]*?){13,19}\b",
    "IP_ADDRESS": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "IBAN": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "URL": r"\bhttps?://[^\s<>\"']+\b",
}
ORACLES: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def luhn(value: str) -> str:
    """Sum of digits, every second from the right doubled; their number from 13 to 19."""
    digits = rf"regexp_replace({value}, '\D', '', 'g')"
    doubled = "lambda c, i: CASE WHEN i % 2 = 0 THEN CASE WHEN c::INT * 2 > 9 THEN c::INT * 2 - 9 ELSE c::INT * 2 END ELSE c::INT END"
    total = f"list_sum(list_transform(list_reverse(string_split({digits}, '')), {doubled}))"
    return f"(length({digits}) BETWEEN 13 AND 19 AND {total} % 10 = 0)"


def spans(kind: str, source: str, key: str, text: str, pattern: str = "") -> str:
    """key, start, end, type, value of the matches of a rule: offsets are sums of the lengths of all before."""
    p = quoted(pattern or PATTERNS[kind])
    length = "lambda x: length(x)"
    before = f"coalesce(list_sum(list_transform(g[1:i], {length})), 0) + coalesce(list_sum(list_transform(m[1:i - 1], {length})), 0)"
    good = f"WHERE {luhn('value')}" if kind == "CREDIT_CARD" else ""
    return f"""SELECT {key}, start::BIGINT AS "start", (start + length(value))::BIGINT AS "end", '{kind}' AS type, value FROM (
      SELECT {key}, {before} AS start, m[i] AS value FROM (
        SELECT {key}, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
          SELECT {key}, regexp_extract_all({text}, {p}) AS m, string_split_regex({text}, {p}) AS g FROM {source}
          WHERE regexp_matches({text}, {p})))) {good}"""


def with_ord(sql: str, key: str) -> str:
    return f'SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY "start", "end") - 1 AS ord, "start", "end", type, value FROM ({sql})'


def all_spans(source: str, key: str, text: str, kinds=tuple(PATTERNS)) -> str:
    return " UNION ALL ".join(f"({spans(k, source, key, text)})" for k in kinds)


TEXTS = f"(SELECT doc_id::BIGINT AS doc_id, text FROM (VALUES {X.TEXTS}) AS t(doc_id, text))"
BOTH = f"(SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id, text FROM {TEXTS})"
DOC_SPANS = all_spans("documents", "doc_id", "text")

for name, kind, source, key, text in (
    ("detect_email", "EMAIL", "documents", "doc_id", "text"),
    ("detect_ip", "IP_ADDRESS", "documents", "doc_id", "text"),
    ("detect_card_luhn", "CREDIT_CARD", "documents", "doc_id", "text"),
    ("detect_url", "URL", "pages", "page_id", "url"),
    ("detect_iban", "IBAN", BOTH, "doc_id", "text"),
):
    ORACLES[name] = with_ord(spans(kind, source, key, text), key)
ORACLES["detect_entity_filter_alias"] = with_ord(all_spans("documents", "doc_id", "text", ("EMAIL", "IP_ADDRESS")), "doc_id")
ORACLES["detect_unknown_types_only"] = with_ord(spans("EMAIL", "(SELECT * FROM documents WHERE false)", "doc_id", "text"), "doc_id")
ORACLES["detect_all_spans"] = DOC_SPANS
ORACLES["detect_all_pages"] = all_spans("pages", "page_id", "html")
ORACLES["detect_all_conversations"] = all_spans("(SELECT conv_id || '/' || turn AS id, text FROM conversations)", "id", "text")
ORACLES["multi_pass_detect"] = with_ord(DOC_SPANS, "doc_id")
for by in ("lang", "source"):
    ORACLES[f"detect_counts_by_{by}"] = f"SELECT d.{by}, s.type, count(*) AS n FROM ({DOC_SPANS}) s JOIN documents d USING (doc_id) GROUP BY ALL"
LISTED = """string_agg("start" || '-' || "end" || ':' || type, ' ' ORDER BY "start")"""
ORACLES["detect_view"] = f"""SELECT d.doc_id, d.text, coalesce(n, 0) AS n_spans, coalesce(l, '') AS spans FROM documents d LEFT JOIN
 (SELECT doc_id, count(*) AS n, {LISTED} AS l FROM ({DOC_SPANS}) GROUP BY doc_id) s USING (doc_id)"""


CLEANED = "replace(replace(trim(lower(label)), ' ', '_'), '-', '_')"
#: Types and categories of labels, written out here so that the tables under test are held to something.
MODEL_TYPES = """
 ('account_number', 'CREDIT_CARD'), ('api_key', 'URL'), ('bank_routing_number', 'CREDIT_CARD'),
 ('certificate_license_number', 'URL'), ('credit_card_number', 'CREDIT_CARD'), ('credit_debit_card', 'CREDIT_CARD'),
 ('cvv', 'CREDIT_CARD'), ('device_identifier', 'URL'), ('email', 'EMAIL'), ('employee_id', 'URL'),
 ('fax_number', 'PHONE_E164'), ('health_plan_beneficiary_number', 'SSN_US'), ('ipv4', 'IP_ADDRESS'),
 ('ipv6', 'IP_ADDRESS'), ('mac_address', 'URL'), ('medical_record_number', 'SSN_US'), ('passport_number', 'URL'),
 ('phone_number', 'PHONE_E164'), ('social_security_number', 'SSN_US'), ('ssn', 'SSN_US'), ('tax_id', 'SSN_US'),
 ('url', 'URL'), ('iban', 'IBAN'), ('account_id', 'URL'), ('username', 'EMAIL'), ('driver''s_license_number', 'URL'),
 ('license_number', 'URL'), ('first_name', 'PERSON'), ('last_name', 'PERSON'), ('name', 'PERSON'),
 ('date_of_birth', 'PERSON'), ('age', 'PERSON'), ('gender', 'PERSON'), ('occupation', 'URL'), ('address', 'URL'),
 ('city', 'URL'), ('state', 'URL'), ('zipcode', 'URL'), ('postcode', 'URL'), ('street_address', 'URL'), ('date', 'URL'),
 ('time', 'URL'), ('company_name', 'URL'), ('organization', 'URL')
"""
DATASET_TYPES = """
 ('EMAIL', 'EMAIL'), ('PHONENUMBER', 'PHONE_E164'), ('PHONEIMEI', 'PHONE_E164'), ('CREDITCARDNUMBER', 'CREDIT_CARD'),
 ('CREDITCARDISSUER', 'CREDIT_CARD'), ('CREDITCARDCVV', 'CREDIT_CARD'), ('IBAN', 'IBAN'),
 ('ACCOUNTNUMBER', 'CREDIT_CARD'), ('ACCOUNTNAME', 'CREDIT_CARD'), ('SSN', 'SSN_US'), ('VEHICLEVIN', 'URL'),
 ('VEHICLEVRM', 'URL'), ('TAXNUM', 'SSN_US'), ('DRIVERLICENSENUM', 'URL'), ('PASSPORT', 'URL'), ('IDCARDNUM', 'SSN_US'),
 ('IPV4', 'IP_ADDRESS'), ('IPV6', 'IP_ADDRESS'), ('IP', 'IP_ADDRESS'), ('URL', 'URL'), ('USERNAME', 'EMAIL'),
 ('BITCOINADDRESS', 'IBAN'), ('ETHEREUMADDRESS', 'IBAN'), ('LITECOINADDRESS', 'IBAN'), ('SWIFT', 'IBAN'),
 ('BIC', 'IBAN'), ('FIRSTNAME', 'PERSON'), ('LASTNAME', 'PERSON'), ('MIDDLENAME', 'PERSON'), ('PREFIX', 'PERSON'),
 ('AGE', 'PERSON'), ('GENDER', 'PERSON'), ('SEX', 'PERSON'), ('HEIGHT', 'PERSON'), ('EYECOLOR', 'PERSON'),
 ('ZODIACSIGN', 'PERSON'), ('DOB', 'PERSON'), ('DATE', 'URL'), ('MASKEDNUMBER', 'PERSON'), ('BUILDINGNUMBER', 'URL'),
 ('STREET', 'URL'), ('CITY', 'URL'), ('COUNTY', 'URL'), ('STATE', 'URL'), ('ZIPCODE', 'URL'),
 ('NEARBYGPSCOORDINATE', 'IP_ADDRESS'), ('COUNTRY', 'URL'), ('COMPANYNAME', 'URL'), ('JOBTITLE', 'URL'),
 ('JOBTYPE', 'URL'), ('JOBAREA', 'URL'), ('EMPLOYEEID', 'URL'), ('SECONDARYADDRESS', 'URL'), ('ORDINALDIRECTION', 'URL'),
 ('TIME', 'URL'), ('PASSWORD', 'URL'), ('USERAGENT', 'URL'), ('CURRENCY', 'URL'), ('CURRENCYCODE', 'URL'),
 ('CURRENCYNAME', 'URL'), ('CURRENCYSYMBOL', 'URL'), ('AMOUNT', 'URL')
"""


ORACLES["sanitize_labels"] = f"""SELECT l.label, coalesce(t.type, 'URL') AS type FROM (VALUES {X.LABELS}) AS l(label)
 LEFT JOIN (VALUES {MODEL_TYPES}) AS t(label, type) ON t.label = {CLEANED.replace('label', 'l.label')}"""
ORACLES["dataset_labels"] = f"SELECT label, type FROM (VALUES {DATASET_TYPES}, ('UNHEARDOF', 'UNHEARDOF')) AS t(label, type)"
_words = " ".join(
    f"WHEN regexp_matches(lower(text), {quoted('|'.join(words))}) THEN '{kind}'" for kind, words in CATEGORY_WORDS
)
ORACLES["classify_documents"] = f"SELECT doc_id, CASE {_words} ELSE '{OTHER_CATEGORY}' END AS category FROM {BOTH}"
CATEGORY_TYPES = """
 ('MEDICALRECORDNUMBER', 'medical'), ('HEALTHPLANID', 'medical'), ('BLOODTYPE', 'medical'),
 ('BIOMETRICIDENTIFIER', 'medical'), ('SSN', 'government'), ('VEHICLEVIN', 'government'), ('VEHICLEVRM', 'government'),
 ('DRIVERLICENSENUM', 'government'), ('TAXNUM', 'financial'), ('IBAN', 'financial'), ('CREDITCARDNUMBER', 'financial'),
 ('CREDITCARDISSUER', 'financial'), ('CREDITCARDCVV', 'financial'), ('ACCOUNTNUMBER', 'financial'),
 ('ACCOUNTNAME', 'financial'), ('BITCOINADDRESS', 'financial'), ('ETHEREUMADDRESS', 'financial'),
 ('LITECOINADDRESS', 'financial'), ('BIC', 'financial'), ('PIN', 'financial')
"""
ORACLES["classify_labelled"] = f"SELECT label, category FROM (VALUES {CATEGORY_TYPES}) AS t(label, category)"
ORACLES["normalize_texts"] = r"""SELECT doc_id, sha256(regexp_replace(replace(text, chr(13) || chr(10), chr(10)),
 '^[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1c-\x1f\x0b]+|[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1c-\x1f\x0b]+$', '', 'g')) AS digest FROM documents"""

# -- span algebra ------------------------------------------------------------------------------------------------------

ORACLES["validate_offsets"] = f"""SELECT case_id::BIGINT AS case_id, "start"::BIGINT AS "start", "end"::BIGINT AS "end"
 FROM (VALUES {X.OFFSETS}) AS t(case_id, ord, "start", "end") WHERE "start" >= 0 AND "end" > "start" AND "end" <= 11"""
# the fold, step by step: what is kept so far is a list
ORACLES["dedupe_overlaps"] = f"""WITH RECURSIVE s AS (
 SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY "start", "start" - "end", -confidence, ord) AS i,
  {{'a': "start", 'b': "end", 't': type, 'c': confidence}} AS x FROM (VALUES {X.SPANS}) AS t(case_id, ord, "start", "end", type, confidence)),
 f AS (SELECT case_id, 1 AS i, [x] AS kept FROM s WHERE i = 1 UNION ALL
  SELECT s.case_id, s.i, CASE WHEN len(list_filter(kept, lambda k: k.a < s.x.b AND s.x.a < k.b AND k.c >= s.x.c)) > 0 THEN kept
   ELSE list_append(list_filter(kept, lambda k: NOT (k.a < s.x.b AND s.x.a < k.b)), s.x) END FROM f JOIN s ON s.case_id = f.case_id AND s.i = f.i + 1)
 SELECT case_id::BIGINT AS case_id, (SELECT string_agg(k.a || '-' || k.b || ':' || k.t, ' ' ORDER BY k.a) FROM (SELECT unnest(kept) AS k)) AS kept
 FROM f WHERE (case_id, i) IN (SELECT case_id, max(i) FROM f GROUP BY case_id)"""
_sides = f'(VALUES {X.SIDES}) AS t(doc_id, side, "start", "end", confidence)'
ORACLES["fuse_consensus"] = ORACLES["fuse_by_anti_join"] = f"""SELECT doc_id::BIGINT AS doc_id, "start"::BIGINT AS "start", "end"::BIGINT AS "end", side
 FROM {_sides} WHERE side = 'rule' OR confidence >= 0.5 AND NOT EXISTS (SELECT 1 FROM {_sides.replace(" AS t(", " AS r(")}
 WHERE r.side = 'rule' AND r.doc_id = t.doc_id AND r."start" < t."end" AND t."start" < r."end")"""
_origin = "(-1, 0), (0, 0), (1, 0), (2, 0), (3, 0), (4, 5), (5, 6), (6, 7), (7, 8), (8, 9), (9, 10), (10, 10), (11, 10), (12, 10)"
ORACLES["apply_and_remap"] = f"SELECT place::BIGINT AS place, origin::BIGINT AS origin, '[P1] and [P2]' AS text FROM (VALUES {_origin}) AS t(place, origin)"
ORACLES["split_newlines"] = """WITH l AS (SELECT doc_id, i, parts[i] AS part, coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x) + 1)), 0) AS pos
 FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord, pos::BIGINT AS "start", (pos + length(part))::BIGINT AS "end" FROM l WHERE part <> ''"""
ORACLES["normalize_annotations"] = f"""SELECT doc_id, "start"::BIGINT AS "start", "end"::BIGINT AS "end", category FROM (
 VALUES {X.ANNOTATIONS}) AS t(doc_id, "start", "end", category) WHERE doc_id <> 'multiline_invoice' UNION ALL
 VALUES ('multiline_invoice', 15, 16, 'contextual'), ('multiline_invoice', 17, 37, 'contextual')"""


def runs(side: str) -> str:
    """Islands of covered characters: each character on its own, neighbours then counted together."""
    chars = f"""SELECT DISTINCT s.doc_id, c FROM (VALUES {X.INTERVALS}) AS s(doc_id, side, a, b) JOIN (VALUES {X.LENGTHS}) AS l(doc_id, n) USING (doc_id),
     range(0, 64) AS r(c) WHERE side = '{side}' AND c >= a AND c < b AND c < n"""
    return f"""SELECT doc_id, min(c) AS a, max(c) + 1 AS b FROM (SELECT doc_id, c, c - row_number() OVER (PARTITION BY doc_id ORDER BY c) AS g FROM ({chars})) GROUP BY doc_id, g"""


def _islands(chars: str) -> str:
    return f"""SELECT doc_id::BIGINT AS doc_id, min(c)::BIGINT AS "start", (max(c) + 1)::BIGINT AS "end" FROM (
     SELECT doc_id, c, c - row_number() OVER (PARTITION BY doc_id ORDER BY c) AS g FROM ({chars})) GROUP BY doc_id, g"""


def _chars(side: str) -> str:
    return f"(SELECT doc_id, c FROM ({runs(side)}) AS q, range(0, 64) AS r(c) WHERE c >= a AND c < b)"


ORACLES["interval_union"] = _islands(_chars("prediction"))
_every = f"SELECT doc_id, c FROM (VALUES {X.LENGTHS}) AS l(doc_id, n), range(0, 64) AS r(c) WHERE c < n"
ORACLES["interval_gaps"] = _islands(f"SELECT * FROM ({_every}) EXCEPT SELECT * FROM {_chars('support')}")
# prediction runs keep their borders where support parts them; touching runs have been merged before
ORACLES["false_positive_runs"] = _islands(f"SELECT * FROM {_chars('prediction')} EXCEPT SELECT * FROM {_chars('support')}")
ORACLES["span_coverage"] = f"""SELECT doc_id::BIGINT AS doc_id, a || '-' || b AS span_id, a::BIGINT AS "start", b::BIGINT AS "end",
 (SELECT count(*) FROM {_chars('prediction')} AS p WHERE p.doc_id = s.doc_id AND p.c >= a AND p.c < b) / (b - a) AS coverage
 FROM (VALUES {X.INTERVALS}) AS s(doc_id, side, a, b) WHERE side = 'support'"""
ORACLES["touched_spans"] = f"""SELECT doc_id::BIGINT AS doc_id, a::BIGINT AS "start", b::BIGINT AS "end" FROM (VALUES {X.INTERVALS}) AS s(doc_id, side, a, b)
 WHERE side = 'support' AND EXISTS (SELECT 1 FROM (VALUES {X.INTERVALS}) AS p(doc_id, side, c, d) WHERE p.side = 'prediction' AND p.doc_id = s.doc_id AND c < b AND a < d AND c < d)"""
ORACLES["document_interval_union"] = f"""WITH w AS (SELECT doc_id, greatest(0, "start" - 40) AS a, least(length(text), "end" + 40) AS b FROM ({DOC_SPANS}) JOIN documents USING (doc_id)),
 m AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
 g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m)
 SELECT doc_id, min(a)::BIGINT AS "start", max(b)::BIGINT AS "end" FROM g GROUP BY doc_id, k"""

# -- strategies --------------------------------------------------------------------------------------------------------


def replaced(source: str, key: str, text: str, found: str, replacement: str) -> str:
    """Texts with the spans of found (disjoint) replaced: pieces and replacements in turn."""
    return f"""WITH f AS (SELECT *, {replacement} AS repl, lag("end", 1, 0) OVER (PARTITION BY {key} ORDER BY "start") AS prev FROM ({found})),
     j AS (SELECT f.{key}, string_agg(substr({text}, prev::INT + 1, ("start" - prev)::INT) || repl, '' ORDER BY "start") AS head, max("end") AS last, count(*) AS n
       FROM f JOIN {source} AS d USING ({key}) GROUP BY f.{key})
     SELECT {key}, coalesce(n, 0) AS n_spans, CASE WHEN n IS NULL THEN {text} ELSE head || substr({text}, last::INT + 1) END AS redacted
     FROM {source} AS d LEFT JOIN j USING ({key})"""


#: Patterns of the demonstration rules whose spans are compared with the rules'.
_DEMO = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "URL": r"\bhttps?://[^\s<>\"']+",
    "PHONE_E164": r"(?:\+?\d{1,3}[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b",
}


def _demo_spans() -> str:
    parts = []
    for kind, pattern in _DEMO.items():
        parts.append(f"""SELECT doc_id, '{kind}' || '-' || "start" || '-' || "end" AS span_id, "start", "end" FROM ({spans(kind, "documents", "doc_id", "text", pattern)})""")
    return " UNION ALL ".join(parts)


def _merged(rows: str) -> str:
    """Disjoint runs of rows (doc_id, a, b), cut to the documents; what touches is one."""
    return f"""SELECT doc_id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a, b) AS k FROM (
     SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM (
     SELECT doc_id, greatest(0, least(a, length(text))) AS a, greatest(0, least(b, length(text))) AS b FROM ({rows}) JOIN documents USING (doc_id)) WHERE a < b)) GROUP BY doc_id, k"""


_sides = f"""r AS MATERIALIZED (SELECT doc_id, "start" - 40 AS a, "end" + 40 AS b FROM ({DOC_SPANS})), d AS MATERIALIZED ({_demo_spans()}),
 ru AS MATERIALIZED ({_merged("SELECT * FROM r")}), du AS MATERIALIZED ({_merged('SELECT doc_id, "start" - 60 AS a, "end" + 60 AS b FROM d')}),
 rg AS MATERIALIZED (SELECT doc_id, p AS a, a AS b FROM (SELECT doc_id, a, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a, b) AS p
  FROM (SELECT doc_id, a, b FROM ru UNION ALL SELECT doc_id, length(text), length(text) FROM documents)) WHERE p < a)"""
_hits = "EXISTS (SELECT 1 FROM r WHERE r.doc_id = d.doc_id AND r.a < d.\"end\" AND d.\"start\" < r.b)"
_judged = f"""(SELECT type, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE g IS NULL) AS fp, count(*) FILTER (WHERE p IS NULL) AS fn FROM
 (SELECT DISTINCT doc_id, "start", "end", type, true AS g FROM ({DOC_SPANS})) FULL JOIN
 (SELECT DISTINCT doc_id, "start", "end", split_part(span_id, '-', 1) AS type, true AS p FROM ({_demo_spans()})) USING (doc_id, "start", "end", type) GROUP BY type)"""
ORACLES["eval_documents"] = f"SELECT * FROM {_judged}"
ORACLES["eval_documents_prf1"] = f"""WITH c AS (SELECT coalesce(type, 'OVERALL') AS type, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM {_judged} GROUP BY ROLLUP (type)),
 s AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c)
 SELECT type, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1 FROM s"""
_words = spans("X", "(SELECT conv_id || '/' || turn AS id, text FROM conversations)", "id", "text", "[A-Za-z0-9]+")
ORACLES["bio_conversations"] = f"""WITH w AS (SELECT *, CASE WHEN regexp_matches(value, '^[A-Z]') THEN 'NAME' WHEN regexp_matches(value, '^[0-9]') THEN 'NUM' END AS kind,
  regexp_matches(value, '^[A-Z]') AND length(value) % 2 = 0 AS fresh FROM ({_words})),
 m AS (SELECT *, sum(CASE WHEN fresh OR kind IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY "start") AS k FROM (
  SELECT *, lag(kind) OVER (PARTITION BY id ORDER BY "start") AS before FROM w))
 SELECT id, min("start") AS "start", max("end") AS "end", kind AS type FROM m WHERE kind IS NOT NULL GROUP BY id, k, kind"""
ORACLES["model_output_documents"] = """SELECT doc_id, (instr(text, value) - 1)::BIGINT AS "start", (instr(text, value) - 1 + length(value))::BIGINT AS "end", type, confidence::DOUBLE AS confidence
 FROM documents, (VALUES ('PERSON', 'Anna', 0.9), ('WORD', 'the', 0.8), ('PLACE', 'no such place', 0.7), ('MARK', '@', 0.6)) AS a(type, value, confidence) WHERE instr(text, value) > 0"""
ORACLES["audit_retention_events"] = """SELECT event_id, CASE WHEN event_type = 'error' THEN 'at ' || event_id ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts FROM events
 WHERE event_type = 'error' OR date_trunc('second', ts) >= TIMESTAMP '2024-01-10'"""
ORACLES["document_interval_gaps"] = f'WITH {_sides} SELECT doc_id, a::BIGINT AS "start", b::BIGINT AS "end" FROM rg'
ORACLES["document_interval_difference"] = f"""WITH {_sides} SELECT du.doc_id, greatest(du.a, rg.a)::BIGINT AS "start", least(du.b, rg.b)::BIGINT AS "end"
 FROM du JOIN rg ON du.doc_id = rg.doc_id AND du.a < rg.b AND rg.a < du.b"""
ORACLES["document_span_coverage"] = f"""WITH {_sides} SELECT w.doc_id, span_id, s::BIGINT AS "start", e::BIGINT AS "end",
 round(sum(CASE WHEN ru.a IS NULL THEN 0 ELSE greatest(0, least(e, ru.b) - greatest(s, ru.a)) END)::DOUBLE / (e - s), 9) AS coverage
 FROM (SELECT doc_id, span_id, "start" - 60 AS s, "end" + 60 AS e FROM d) w LEFT JOIN ru ON ru.doc_id = w.doc_id GROUP BY w.doc_id, span_id, s, e"""
ORACLES["document_touched_spans"] = f'WITH {_sides} SELECT doc_id, span_id, "start", "end" FROM d WHERE {_hits}'
ORACLES["document_fused_spans"] = f"""WITH {_sides} SELECT doc_id, a::BIGINT AS "start", b::BIGINT AS "end", 'rule' AS side FROM r
 UNION ALL SELECT doc_id, "start", "end", 'demo' FROM d WHERE NOT {_hits}"""
_plain = replaced("documents", "doc_id", "text", DOC_SPANS, "'[REDACTED]'")
ORACLES["redact_plain"] = _plain
ORACLES["exact_dup_cache"] = f"SELECT doc_id, sha256(redacted) AS redacted_sha256 FROM ({_plain})"
_pages = replaced("pages", "page_id", "html", all_spans("pages", "page_id", "html", ("EMAIL", "IP_ADDRESS")), "'[REDACTED]'")
ORACLES["redact_pages"] = f"SELECT page_id, sha256(redacted) AS redacted_sha256, n_spans FROM ({_pages})"
_mail = spans("EMAIL", "documents", "doc_id", "text")
_masked = replaced("documents", "doc_id", "text", _mail, "'<EMAIL:' || right(value, 4) || '>'")
ORACLES["apply_mask"] = f"SELECT doc_id, redacted AS masked FROM ({_masked})"


def hmac(message: str, key: str = "pepper") -> str:
    raw = key.encode().ljust(64, b"\0")
    pad = lambda x: "'" + "".join(f"\\x{b ^ x:02X}" for b in raw) + "'::BLOB"
    return f"sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode({message}))))"


_hashed = replaced("documents", "doc_id", "text", _mail, f"'[HASH:' || substr({hmac('value')}, 1, 8) || ']'")
ORACLES["apply_hash_hmac"] = f"SELECT doc_id, redacted AS hashed FROM ({_hashed})"
ORACLES["entity_hashes"] = f'SELECT doc_id, "start", substr({hmac("value")}, 1, 8) AS tag FROM ({DOC_SPANS})'
ORACLES["format_last4"] = f"""SELECT doc_id, "start", '[' || type || ' ' || right(value, 4) || ' ' || value || ' {{nope}}]' AS shown FROM ({DOC_SPANS})"""

_found = f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY \"start\") - 1 AS i FROM ({all_spans('documents', 'doc_id', 'text', ('EMAIL', 'IBAN', 'CREDIT_CARD', 'IP_ADDRESS'))})"
_deid = replaced("documents", "doc_id", "text", _found, "'[' || type || '_' || lpad(i::VARCHAR, 4, '0') || ']'")
_relex = f"""SELECT doc_id, string_agg(value || '=' || p, ' ' ORDER BY value || '=' || p) AS relex FROM (
  SELECT doc_id, value, '[' || arg_max(type, i) || '_' || lpad(max(i)::VARCHAR, 4, '0') || ']' AS p FROM ({_found}) GROUP BY doc_id, value) GROUP BY doc_id"""
_policy = f"""SELECT doc_id, redacted, coalesce(l, '') AS spans, coalesce(relex, '') AS relex FROM ({_deid}) LEFT JOIN
 (SELECT doc_id, {LISTED} AS l FROM ({_found}) GROUP BY doc_id) USING (doc_id) LEFT JOIN ({_relex}) USING (doc_id)"""
# cards are gone before the later fields look for them
ORACLES["redact_policy_default"] = ORACLES["redact_policy_strict"] = _policy
_cards = spans("CREDIT_CARD", "documents", "doc_id", "text")
_minimal = replaced("documents", "doc_id", "text", _cards, "'[CC-' || right(value, 4) || ']'")
ORACLES["redact_policy_minimal"] = f"""SELECT doc_id, redacted, coalesce(l, '') AS spans, '' AS relex FROM ({_minimal}) LEFT JOIN
 (SELECT doc_id, {LISTED} AS l FROM ({_cards}) GROUP BY doc_id) USING (doc_id)"""
_ids = replaced(TEXTS, "doc_id", "text", spans("CREDIT_CARD", TEXTS, "doc_id", "text"), "'[ID]'")
ORACLES["card_policy_stage_order"] = f"""SELECT doc_id, redacted, coalesce(l, '') AS spans, '' AS relex FROM ({_ids}) LEFT JOIN
 (SELECT doc_id, {LISTED} AS l FROM ({spans("CREDIT_CARD", TEXTS, "doc_id", "text")}) GROUP BY doc_id) USING (doc_id)"""
ORACLES["mask_and_hash_policies_do_nothing"] = f"SELECT doc_id, text AS redacted, '' AS spans, '' AS relex FROM {TEXTS}"
ORACLES["policy_listing"] = """SELECT * FROM (VALUES ('default', '1.0.0', 'free_text,structured_ids,payment_cards,gender'),
 ('minimal', '1.0.0', 'ssn,credit_cards,ibans'), ('strict', '1.0.0', 'free_text,structured_ids,payment_cards')) AS t(name, version, fields)"""
_first = f"""SELECT *, min("start") OVER (PARTITION BY doc_id, type, value) AS first FROM ({DOC_SPANS})"""
_numbers = f"""SELECT *, '[' || type || '_' || lpad((dense_rank() OVER (PARTITION BY doc_id, type ORDER BY first))::VARCHAR, 4, '0') || ']' AS placeholder FROM ({_first})"""
_relexed = replaced("documents", "doc_id", "text", _numbers, "placeholder")
ORACLES["relex_placeholders"] = f"SELECT doc_id, redacted AS relexed FROM ({_relexed})"
ORACLES["relex_numbers"] = f"""SELECT DISTINCT doc_id, type, value, placeholder, placeholder || '-' || substr(sha256('s1|' || placeholder), 1, 4) AS signed FROM ({_numbers})"""
_typed = f"""SELECT *, '[' || type || '_' || lpad((row_number() OVER (PARTITION BY doc_id, type ORDER BY "start"))::VARCHAR, 4, '0') || ']' AS p FROM ({DOC_SPANS})"""
ORACLES["pipeline_typed_placeholders"] = f"""SELECT doc_id, {hmac('text')} AS digest, sha256(redacted) AS redacted_sha256, n_spans
 FROM ({replaced('documents', 'doc_id', 'text', _typed, 'p')}) JOIN documents USING (doc_id)"""
ORACLES["batch_redact"] = f"""SELECT (doc_id // 10)::BIGINT AS request_id, count(*) AS items, sum(length(text))::BIGINT AS text_chars, sum(coalesce(n, 0))::BIGINT AS n_spans
 FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({DOC_SPANS}) GROUP BY doc_id) USING (doc_id) GROUP BY 1"""
def chunked(chars: int, most_bytes: int) -> str:
    """doc_id, chunk_ix, chunk: the longest head of what is left of a text within both budgets, again and again."""
    head = f"list_filter(range(1, {chars + 1}), lambda j: strlen(substr(rest, 1, j::INT)) <= {most_bytes})"
    return f"""SELECT doc_id, ix::BIGINT AS chunk_ix, chunk FROM (WITH RECURSIVE c AS (
     SELECT doc_id, -1 AS ix, '' AS chunk, coalesce(text, '') AS rest FROM documents UNION ALL
     SELECT doc_id, ix + 1, substr(rest, 1, k::INT), substr(rest, k::INT + 1) FROM (
      SELECT *, CASE WHEN strlen(substr(rest, 1, {chars})) <= {most_bytes} THEN {chars} ELSE greatest(1, len({head})) END AS k FROM c WHERE rest <> ''))
     SELECT * FROM c WHERE ix >= 0)"""


_chunks = chunked(500, 520)
ORACLES["chunk_text"] = ORACLES["chunk_ascii_text"] = _chunks
ORACLES["sse_stream"] = ORACLES["sse_stream_all"] = f"""SELECT doc_id, chunk_ix AS event_ix, 'data: {{"chunk_ix":' || chunk_ix || '}}' || chr(10) || chr(10) AS line FROM ({_chunks}) UNION ALL
 SELECT doc_id, max(chunk_ix) + 1, 'data: [DONE]' || chr(10) || chr(10) FROM ({_chunks}) GROUP BY doc_id"""

# -- audit and evaluation ----------------------------------------------------------------------------------------------

ORACLES["audit_summary"] = f"""SELECT type, count(*) AS count, round(avg(confidence::DOUBLE), 3) AS confidence_avg
 FROM (VALUES {X.SPANS}) AS t(case_id, ord, "start", "end", type, confidence) GROUP BY type"""
ORACLES["audit_summary_documents"] = f"SELECT source, type, count(*) AS count, 1.0::DOUBLE AS confidence_avg FROM ({DOC_SPANS}) JOIN documents USING (doc_id) GROUP BY ALL"
ORACLES["audit_retention"] = f"""SELECT id::BIGINT AS id, ts, policy FROM (VALUES {X.AUDIT}) AS t(id, ts, policy)
 WHERE try_cast(ts AS TIMESTAMPTZ) IS NULL OR try_cast(ts AS TIMESTAMPTZ) >= TIMESTAMPTZ '2024-02-01 00:00:00+00'"""
ORACLES["audit_last_n"] = "SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100"
ORACLES["audit_last_n_per_user"] = "SELECT event_id, ts, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3"
_gold = f'(VALUES {X.GOLD}) AS g(doc_id, "start", "end", type)'
# what the rules find in the texts, told apart from the rules
_hits = f"""(SELECT * FROM {_gold} UNION ALL VALUES (7, 4, 15, 'SSN_US'), (8, 7, 27, 'EMAIL'), (8, 58, 74, 'CREDIT_CARD'), (9, 5, 18, 'PHONE_E164'), (9, 22, 38, 'PHONE_E164')) AS f(doc_id, "start", "end", type)"""
_outcomes = f"""SELECT coalesce(g.type, f.type) AS type, count(*) FILTER (WHERE g.doc_id IS NOT NULL AND f.doc_id IS NOT NULL) AS tp,
 count(*) FILTER (WHERE g.doc_id IS NULL) AS fp, count(*) FILTER (WHERE f.doc_id IS NULL) AS fn
 FROM {_gold} FULL JOIN {_hits} ON g.doc_id = f.doc_id AND g."start" = f."start" AND g."end" = f."end" AND g.type = f.type GROUP BY 1"""
ORACLES["eval_outcomes"] = _outcomes
_scored = f"""SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM (
 SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM (
 SELECT coalesce(type, 'OVERALL') AS type, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM ({_outcomes}) GROUP BY ROLLUP (type)))"""
ORACLES["eval_prf1"] = _scored
ORACLES["eval_table"] = f"SELECT type, printf('%-12s %6.3f %6.3f %6.3f', type, precision, recall, f1) AS line FROM ({_scored})"
ORACLES["labels_by_pii"] = f"""SELECT quality, toxic, count(*) AS n, count(*) FILTER (WHERE d.doc_id IN (SELECT doc_id FROM ({DOC_SPANS}))) AS n_pii
 FROM documents d JOIN labels USING (doc_id) GROUP BY ALL"""
ORACLES["unlabelled_documents"] = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
_columns = "(doc_id, n, d, n_mandatory, n_contextual, n_fp, skipped, r)"
_rows = {
    "rules": [("email_alice", 1, 1, 1, 0, 0, 0), ("email_john", 0, 0, 0, 0, 0, 1), ("email_phone", 0, 1, 1, 0, 0, 0),
              ("multiline_invoice", 0, 0, 0, 0, 0, 1), ("note_over_redact", 0, 0, 0, 0, 0, 2), ("vehicle_record", 0, 2, 2, 0, 0, 1)],
}
_rows["empty"] = [("email_alice", 0, 1, 1, 0, 0, 0), *_rows["rules"][1:]]
for name, rows in _rows.items():
    listed = ", ".join(str((*r, r[1] / r[2] if r[2] else 0.0)) for r in rows)
    ORACLES[f"rscore_per_doc_{name}"] = f"SELECT doc_id, n::DOUBLE AS n, d::DOUBLE AS d, n_mandatory::BIGINT AS n_mandatory, n_contextual::BIGINT AS n_contextual, n_fp::BIGINT AS n_fp, skipped::BIGINT AS skipped, r::DOUBLE AS r FROM (VALUES {listed}) AS t{_columns}"
ORACLES["rscore_report"] = """SELECT category, round(mean::DOUBLE, 9) AS mean, p20::DOUBLE AS p20, p50::DOUBLE AS p50, n::BIGINT AS n FROM (VALUES
 (NULL, 1 / 6, 0, 0, 6), ('emails', 1 / 3, 0, 0, 3), ('financial', 0, 0, 0, 1), ('operations', 0, 0, 0, 2)) AS t(category, mean, p20, p50, n)"""
# p20 of emails interpolates between zeros


def scored(source: str, key: str, text: str, digits: int = 9) -> str:
    """Scores of texts: a stack machine by delimiters, edges between spans followed to the end, joins for all that overlaps."""
    pattern = {"red": "[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", "yel": "[A-Z][a-z]*|[0-9]+", "pred": "[A-M][a-z]+ [a-z]+|[5-9]+|[N-P][a-z]+[^A-Z0-9@]{1,40}[A-Z]"}
    found = ", ".join(f"""{n} AS MATERIALIZED (SELECT id, "start"::INT AS a, "end"::INT AS b FROM ({spans('X', 't', 'id', 'text', p)}))""" for n, p in pattern.items())

    def merged(name: str, of: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM (
          SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ({of}))) GROUP BY id, k)"""

    numbers = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {c}" for k, c in (("m", "n_mandatory"), ("c", "n_contextual"), ("f", "n_fp"), ("s", "skipped")))
    return rf"""WITH RECURSIVE t AS MATERIALIZED (SELECT {key} AS id, coalesce({text}, '') AS text FROM {source}), {found},
 s AS (SELECT *, 0 AS k FROM red UNION ALL SELECT *, 1 FROM yel),
 nb AS MATERIALIZED (SELECT s.*, row_number() OVER w AS i, lead(k) OVER w AS nk, substr(text, b, 1) AS tail, substr(text, a + 1, b - a) AS piece,
  CASE WHEN lead(a) OVER w - b BETWEEN 1 AND 2 THEN substr(text, b + 1, lead(a) OVER w - b) WHEN lead(a) OVER w - b > 2 THEN substr(text, b + 1, 1) || '...' ELSE '' END AS z,
  substr(text, lead(a) OVER w + 1, lead(b) OVER w - lead(a) OVER w) AS follows
  FROM s JOIN t USING (id) WINDOW w AS (PARTITION BY id ORDER BY a, b, k)),
 con AS MATERIALIZED (SELECT *, CASE WHEN nk IS NULL THEN 0 WHEN z[1] = ' ' AND tail IN (')', ']', '}}', '>') THEN 1
  WHEN length(z) = 1 AND NOT regexp_matches(z, '[\\/@\[\]{{}}()<>"''`A-Za-z0-9]') THEN 2 WHEN z = '/' AND regexp_full_match(piece || follows, '[0-9]+') THEN 1
  WHEN regexp_full_match(z, '[)\]}}>][ \t]') THEN 1 ELSE 0 END AS how FROM nb),
 dl AS MATERIALIZED (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) AS j, pos, c FROM (
  SELECT id, unnest(range(length(text)))::INT AS pos, unnest(string_split(text, '')) AS c FROM t) WHERE regexp_matches(c, '[\[\](){{}}<>"''`]')),
 st(id, j, places, cs, o, e, oc, ec) AS (SELECT id, 0::BIGINT, []::INT[], []::VARCHAR[], NULL::INT, NULL::INT, NULL::VARCHAR, NULL::VARCHAR FROM t UNION ALL
  SELECT id, j, CASE step WHEN 'push' THEN list_append(places, pos) WHEN 'stay' THEN places ELSE places[:-2] END, CASE step WHEN 'push' THEN list_append(cs, c) WHEN 'stay' THEN cs ELSE cs[:-2] END,
   CASE step WHEN 'pair' THEN places[-1] END, pos, cs[-1], c
  FROM (SELECT st.id, dl.j, places, cs, pos, c, CASE WHEN c IN ('"', '''', '`') AND cs[-1] = c THEN 'pair' WHEN c IN ('"', '''', '`', '(', '[', '{{', '<') THEN 'push'
   WHEN len(cs) = 0 THEN 'stay' WHEN cs[-1] || c IN ('()', '[]', '{{}}', '<>') THEN 'pair' ELSE 'drop' END AS step FROM st JOIN dl ON dl.id = st.id AND dl.j = st.j + 1)),
 pairs AS MATERIALIZED (SELECT id, o, e, oc, ec FROM st WHERE o IS NOT NULL AND EXISTS (FROM yel y WHERE y.id = st.id AND y.a < e + 1 AND y.b > o)
  AND NOT EXISTS (FROM red r WHERE r.id = st.id AND r.a >= o AND r.b <= e + 1)),
 marks AS MATERIALIZED (SELECT id, unnest(CASE WHEN z[1] = ' ' AND tail IN (')', ']', '}}', '>') THEN [tail, ' '] ELSE string_split(z, '') END) AS m FROM con WHERE how > 0
  UNION SELECT id, oc FROM pairs UNION SELECT id, ec FROM pairs),
 near AS (SELECT id, i AS x, i + 1 AS y FROM con WHERE nk = k AND how > 1 - k),
 y AS MATERIALIZED (SELECT id, i, a, b, piece FROM nb WHERE k = 1),
 inner_ AS (SELECT p.id, o, y.i, min(y.i) OVER (PARTITION BY p.id, o) AS f FROM pairs p JOIN y ON y.id = p.id AND y.a >= o AND y.b <= e + 1),
 both_ AS MATERIALIZED (SELECT id, x, y FROM near UNION SELECT id, y, x FROM near),
 edges AS MATERIALIZED (SELECT * FROM both_ UNION SELECT id, i, f FROM inner_ UNION SELECT id, f, i FROM inner_),
 reach(id, i, r) AS (SELECT id, i, i FROM nb UNION SELECT h.id, h.i, e.y FROM reach h JOIN edges e ON e.id = h.id AND e.x = h.r),
 ent AS MATERIALIZED (SELECT id, i, min(r) AS g FROM reach GROUP BY id, i),
 held AS (SELECT p.id, p.o, p.e, min(y.i) AS x FROM (SELECT id, o, e, unnest([o, e]) AS pos FROM pairs) p JOIN y ON y.id = p.id AND y.a <= pos AND y.b > pos GROUP BY p.id, p.o, p.e, pos),
 steps AS MATERIALIZED (SELECT * FROM both_ UNION SELECT h.id, h.x, y.i FROM held h JOIN y ON y.id = h.id AND y.a >= o AND y.b <= e),
 hit(id, i) AS (SELECT y.id, y.i FROM y JOIN pred p ON p.id = y.id AND p.a < y.b AND y.a < p.b UNION SELECT h.id, e.y FROM hit h JOIN steps e ON e.id = h.id AND e.x = h.i),
 {merged('pr', 'SELECT * FROM pred')}, {merged('su', 'SELECT id, a, b FROM s')},
 cov AS MATERIALIZED (SELECT n.id, n.i, n.k, n.piece, sum(CASE WHEN p.a IS NULL THEN 0 ELSE least(n.b, p.b) - greatest(n.a, p.a) END) / (n.b - n.a) AS c
  FROM nb n LEFT JOIN pr p ON p.id = n.id AND p.a < n.b AND p.b > n.a GROUP BY n.id, n.i, n.k, n.piece, n.a, n.b),
 grp AS (SELECT cov.id, k, g, count(*) AS size, min(piece) AS piece, avg(c) AS whole, avg(c) FILTER (WHERE hit.i IS NOT NULL) AS share
  FROM cov JOIN ent USING (id, i) LEFT JOIN hit ON hit.id = cov.id AND hit.i = cov.i GROUP BY cov.id, k, g),
 own AS (SELECT *, bool_or(k = 0) OVER (PARTITION BY id) AS has FROM grp),
 ctx AS (SELECT id, CASE WHEN share IS NULL THEN 's' ELSE 'c' END AS kind, CASE WHEN share IS NULL OR has THEN 0 ELSE share END AS n,
  CASE WHEN share IS NULL THEN 0 WHEN has THEN 1 - share ELSE 1 END AS d FROM own WHERE k = 1 AND (size > 1 OR (id, piece) NOT IN (SELECT (id, m) FROM marks))),
 ga AS MATERIALIZED (SELECT id, lag(b, 1, 0) OVER (PARTITION BY id ORDER BY a) AS a, a AS b FROM (SELECT * FROM su UNION ALL SELECT id, length(text), length(text) FROM t)),
 fp AS (SELECT ga.id, 'f' AS kind, 0.0 AS n, CASE WHEN pr.a <= ga.a AND ga.b <= pr.b AND ga.b - ga.a >= 3 THEN 2.0 ELSE 1.0 END AS d FROM ga JOIN pr ON pr.id = ga.id AND pr.a < ga.b AND pr.b > ga.a AND ga.a < ga.b),
 terms AS (SELECT id, 'm' AS kind, whole::DOUBLE AS n, 1::DOUBLE AS d FROM own WHERE k = 0 UNION ALL SELECT id, kind, n, d FROM ctx UNION ALL SELECT id, kind, n, d FROM fp),
 sums AS (SELECT t.id, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(d), 0)::DOUBLE AS d, {numbers} FROM t LEFT JOIN terms USING (id) GROUP BY t.id)
 SELECT id AS doc_id, round(n, {digits}) AS n, round(d, {digits}) AS d, n_mandatory, n_contextual, n_fp, skipped, round(CASE WHEN d > 0 THEN n / d ELSE 0 END, {digits}) AS r FROM sums"""


ORACLES["rscore_pages"] = scored("pages", "page_id", "html")
ORACLES["rscore_texts"] = scored("documents", "doc_id", "text")
ORACLES["rscore_report_sources"] = f"""WITH j AS (SELECT d.source, s.r FROM ({scored('documents', 'doc_id', 'text', 15)}) s JOIN documents d USING (doc_id))
 SELECT NULL AS category, round(avg(r), 9) AS mean, round(quantile_cont(r, 0.2), 9) AS p20, round(quantile_cont(r, 0.5), 9) AS p50, count(*) AS n FROM j
 UNION ALL SELECT source, round(avg(r), 9), round(quantile_cont(r, 0.2), 9), round(quantile_cont(r, 0.5), 9), count(*) FROM j WHERE source <> '' GROUP BY source"""
ORACLES["corpus_structures"] = """SELECT category, CASE WHEN category IN ('code', 'files', 'logs', 'terminal') THEN 'structured' ELSE 'unstructured' END AS structure
 FROM (VALUES ('emails'), ('medical'), ('legal'), ('academic'), ('financial'), ('government'), ('operations'), ('code'), ('files'), ('logs'), ('terminal')) AS t(category)"""
ORACLES["template_rows"] = """SELECT id::BIGINT AS id, ['User bob logged in from 10.1.1.1', 'export KEY=abc', 'see a@b.org'][id % 3 + 1] AS text,
 ['5-8 24-32', '11-14', '4-11'][id % 3 + 1] AS spans FROM range(0, 10) AS t(id)"""
ORACLES["quota_sample"] = "SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5"
ORACLES["first_rows"] = "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50"

_ratings = f"(SELECT unit_id, kind, redacted FROM (VALUES {X.RATINGS}) AS t(unit_id, kind, rater, redacted))"


def _units(source: str) -> str:
    return f"(SELECT kind, unit_id, count(*) AS m, count(*) FILTER (WHERE redacted) AS k FROM {source} GROUP BY kind, unit_id)"


ORACLES["agreement_pairwise"] = f"SELECT round(coalesce(avg(k * (m - k) / (m * (m - 1) / 2)) FILTER (WHERE m >= 2), 0), 9) AS disagreement FROM {_units(_ratings)}"


def _kinds(source: str) -> str:
    return f"""SELECT kind, (count(*) FILTER (WHERE m >= 2))::DOUBLE AS n_qualifying, round(coalesce(avg(k * (m - k) / (m * (m - 1) / 2)) FILTER (WHERE m >= 2), 0), 9) AS disagreement,
     round(coalesce(avg(k / m) FILTER (WHERE m >= 2), 0), 9) AS redaction_rate FROM {_units(source)} GROUP BY kind"""


def _alpha(source: str, by: str) -> str:
    return f"""SELECT {by} round(CASE WHEN n < 2 THEN {'0.0' if by else '1.0'} WHEN n1 = 0 OR n1 = n THEN 1.0
     ELSE 1 - (s / n) / (2.0 * (n - n1) * n1 / (n * (n - 1))) END, 9)::DOUBLE AS alpha
     FROM (SELECT {by} sum(m) AS n, sum(k) AS n1, coalesce(sum(2 * k * (m - k) / nullif(m - 1, 0)) FILTER (WHERE m >= 2), 0) AS s FROM {_units(source)} {"GROUP BY kind" if by else ""})"""


ORACLES["agreement_by_kind"] = _kinds(_ratings)
ORACLES["alpha_global"] = _alpha(_ratings, "")
ORACLES["alpha_by_kind"] = _alpha(_ratings, "kind,")
ORACLES["alpha_pooled_gaps"] = _alpha(f"(SELECT unit_id, CASE WHEN kind LIKE 'gap_%' THEN 'gap' ELSE kind END AS kind, redacted FROM {_ratings})", "kind,")
ORACLES["disagreement_report"] = f"""SELECT (SELECT count(*) FROM {_units(_ratings)} WHERE m >= 2) AS n_qualifying_units, (SELECT count(*) FROM {_ratings} WHERE redacted) AS n_redact_votes,
 (SELECT count(*) FROM {_ratings} WHERE NOT redacted) AS n_no_redact_votes, ({_alpha(_ratings, '')}) AS global_alpha"""
_events = "(SELECT date_trunc('hour', ts)::VARCHAR AS unit_id, event_type AS kind, value > 50 AS redacted FROM events)"
_hours = "(SELECT date_trunc('hour', ts)::VARCHAR AS unit_id, 'hour' AS kind, value > 50 AS redacted FROM events)"
ORACLES["disagreement_of_events"] = f"""SELECT (SELECT count(*) FROM {_units(_hours)} WHERE m >= 2) AS n_qualifying_units, (SELECT count(*) FROM {_hours} WHERE redacted) AS n_redact_votes,
 (SELECT count(*) FROM {_hours} WHERE NOT redacted) AS n_no_redact_votes, ({_alpha(_hours, '')}) AS global_alpha"""
ORACLES["agreement_of_events"] = f"SELECT * FROM ({_kinds(_events)}) JOIN ({_alpha(_events, 'kind,')}) USING (kind)"
_p, _z = "(k / n)", 1.96
_half = f"{_z} / (1 + {_z * _z} / n) * sqrt({_p} * (1 - {_p}) / n + {_z * _z} / (4.0 * n * n))"
_centre = f"({_p} + {_z * _z} / (2.0 * n)) / (1 + {_z * _z} / n)"
ORACLES["wilson_of_labels"] = f"""SELECT lang, k, n, round(greatest(0.0, {_centre} - {_half}), 9) AS low, round(least(1.0, {_centre} + {_half}), 9) AS high
 FROM (SELECT lang, count(*) FILTER (WHERE toxic = 1) AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang)"""
ORACLES["average_ranks"] = "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS rank FROM part"

# -- operations --------------------------------------------------------------------------------------------------------

_place = """SELECT event_id, user_id, (epoch_us(ts) // 1000000)::BIGINT AS e, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // ({s} * 1000000::BIGINT) ORDER BY ts, event_id) AS place FROM events"""
ORACLES["rate_limit_minute"] = f"""SELECT event_id, user_id, place, place <= 1 AS accepted, CASE WHEN place > 1 THEN greatest(1, (e // 60 + 1) * 60 - e) END AS retry_after FROM ({_place.format(s=60)})"""
ORACLES["rate_limit_day_report"] = f"SELECT e // 86400 * 86400 AS window_start, count(*) AS requests, count(*) FILTER (WHERE place > 2) AS rejected FROM ({_place.format(s=86400)}) GROUP BY 1"
ORACLES["owner_tokens"] = "SELECT DISTINCT user_id, substr(sha256(user_id::VARCHAR), 1, 32) AS owner FROM events"
ORACLES["scope_check"] = "SELECT id::BIGINT AS id, allowed FROM (VALUES (1, true), (2, false), (3, false), (4, true)) AS t(id, allowed)"
ORACLES["request_checks"] = f"""SELECT id::BIGINT AS id, CASE WHEN regexp_full_match(given, '[A-Za-z0-9._:-]+') THEN given ELSE 'generated' END AS request_id,
 (CASE WHEN has_policy AND has_types OR staged AND (has_policy OR has_types) OR chars < 1 THEN 422 WHEN chars > 100000 THEN 413 ELSE 200 END)::BIGINT AS status
 FROM (VALUES {X.CALLERS}) AS t(id, given, chars, has_policy, has_types, staged)"""
ORACLES["oversized_documents"] = """SELECT (CASE WHEN length(text) < 1 THEN 422 WHEN length(text) > 100000 OR length(text) * 100 > 1000000 THEN 413 ELSE 200 END)::BIGINT AS status,
 count(*) AS n FROM documents GROUP BY 1"""
ORACLES["status_counts"] = "SELECT event_type, count(*) AS n FROM events GROUP BY 1"
_bounds = "(1.0), (2.5), (5.0), (10.0), (25.0), (50.0), (100.0), (250.0)"
ORACLES["latency_histogram"] = f"""SELECT event_type, printf('%.1f', b::DOUBLE) AS le, count(*) FILTER (WHERE value <= b) AS n FROM events, (VALUES {_bounds}) AS t(b) GROUP BY event_type, b
 UNION ALL SELECT event_type, '+Inf', count(value) FROM events GROUP BY 1"""
_q = ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{int(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99))
ORACLES["latency_percentiles"] = f"SELECT event_type, {_q}, round(avg(value), 6) AS mean, round(max(value), 6) AS most FROM events GROUP BY 1"


def _exclusive(p: float) -> str:
    low = f"greatest(1, least(floor({p} * (len(v) + 1))::INT, len(v) - 1))"
    return f"round(v[{low}] + ({p} * (len(v) + 1) - {low}) * (v[{low} + 1] - v[{low}]), 6)"


ORACLES["exclusive_quantiles"] = f"SELECT day, {_exclusive(0.95)} AS p95, {_exclusive(0.99)} AS p99 FROM (SELECT ts::DATE::VARCHAR AS day, list(value ORDER BY value) AS v FROM events GROUP BY 1)"
ORACLES["error_ratio_sliding"] = """SELECT w AS window_start, count(*) FILTER (WHERE event_type = 'error') AS errors, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 9) AS ratio,
 count(*) FILTER (WHERE event_type = 'error') / count(*) > 0.01 AS alert FROM (
 SELECT event_type, unnest([(epoch_us(ts) // 1000000)::BIGINT // 10800 * 10800, (epoch_us(ts) // 1000000)::BIGINT // 10800 * 10800 - 10800]) AS w FROM events) GROUP BY w"""
ORACLES["increase_alerts"] = "SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n, count(*) > 60 AS alert FROM events GROUP BY 1, 2"
ORACLES["heartbeat_sessions"] = """WITH f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 4 * 3600000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM f)
 SELECT user_id, session, min(ts) AS start, max(ts) AS stop, count(*) AS beats FROM g GROUP BY 1, 2"""
ORACLES["worker_capacity"] = f"""SELECT sum(greatest(0, active::INT))::BIGINT AS active, sum(greatest(0, most::INT))::BIGINT AS most FROM (VALUES {X.WORKERS}) AS t(worker, active, most)
 WHERE try_cast(active AS INT) IS NOT NULL AND try_cast(most AS INT) IS NOT NULL"""
ORACLES["job_state_replay"] = """SELECT job_id, status, applied::BIGINT AS applied FROM (VALUES ('a', 'done', 3), ('b', 'cancelled', 2), ('c', 'running', 2), ('d', 'none', 0), ('e', 'failed', 2))
 AS t(job_id, status, applied)"""
ORACLES["jobs_in_flight"] = "SELECT coalesce(o_custkey, -1) AS owner, count(*) FILTER (WHERE o_orderstatus = 'O') AS in_flight FROM orders GROUP BY ROLLUP (o_custkey)"
ORACLES["oldest_open"] = "SELECT o_orderdate AS oldest, o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1"
ORACLES["stale_jobs"] = "SELECT job_id, 'failed' AS status, 'job lease expired' AS error FROM (VALUES ('a'), ('c')) AS t(job_id)"
ORACLES["retry_backoff"] = "SELECT t AS try, CASE WHEN t < 5 THEN least(60.0, pow(2.0, t - 1))::DOUBLE END AS delay, t >= 5 AS dead_letter FROM range(1, 9) AS r(t)"
_outcome = """CASE WHEN row_number() OVER w = 1 THEN 'acquired' WHEN fingerprint = first_value(fingerprint) OVER w THEN 'replayed' ELSE 'conflict' END AS outcome"""
_w = "WINDOW w AS (PARTITION BY key ORDER BY seq)"
ORACLES["idempotent_replay"] = f"SELECT key, seq::BIGINT AS seq, fingerprint, {_outcome} FROM (VALUES {X.REQUESTS}) AS t(key, seq, fingerprint) {_w}"
ORACLES["idempotent_events"] = f"""SELECT outcome, count(*) AS n FROM (SELECT {_outcome} FROM (SELECT user_id || '/' || date_trunc('minute', ts) AS key, event_id AS seq, event_type AS fingerprint FROM events) {_w}) GROUP BY 1"""
ORACLES["breaker_replay"] = """SELECT model, seq::BIGINT AS seq, allowed, state, failures::BIGINT AS failures FROM (VALUES
 ('m', 1, true, 'closed', 0), ('m', 2, true, 'closed', 1), ('m', 3, true, 'closed', 2), ('m', 4, true, 'open', 3), ('m', 5, false, 'open', 3), ('m', 6, false, 'open', 3),
 ('m', 7, true, 'open', 4), ('m', 8, false, 'open', 4), ('m', 9, true, 'closed', 0), ('m', 10, true, 'closed', 1), ('n', 1, true, 'closed', 1), ('n', 2, true, 'closed', 0))
 AS t(model, seq, allowed, state, failures)"""
ORACLES["job_admission"] = """SELECT seq::BIGINT AS seq, owner, admitted FROM (VALUES (1, 'x', true), (2, 'x', true), (3, 'x', false), (4, 'y', true), (5, 'y', true), (7, 'y', false), (9, 'z', true), (10, 'x', false))
 AS t(seq, owner, admitted)"""
ORACLES["saturation_signals"] = """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) / 20 > 0.9 AS pool, count(DISTINCT user_id) > 10 AS queue, count(*) = 0 AS no_workers FROM events GROUP BY 1"""
ORACLES["status_table"] = "SELECT * FROM (VALUES ('verified', 2::BIGINT), ('partial', 1), ('planned', 1)) AS t(status, n)"
ORACLES["model_manifest"] = "SELECT * FROM (VALUES ('small', 'main', 'abc123'), ('large', 'v2', 'def456')) AS t(name, revision, digest)"

# -- records -----------------------------------------------------------------------------------------------------------

_escaped = "replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't'), chr(13), chr(92) || 'r')"
ORACLES["cache_keys"] = f"""SELECT doc_id, sha256('{{"cache_version": 2, "detector": "", "entity_types": ["EMAIL"], "mode": "legacy", "model_revision": "", "policy": {{}}, "salt": "pepper", "text": "'
 || {_escaped} || '"}}') AS key FROM documents"""
ORACLES["request_fingerprints"] = f"""SELECT doc_id, sha256('{{"entity_types":[],"policy":{{}},"text":"' || {_escaped} || '","use_pipeline":true}}') AS fingerprint FROM {TEXTS}"""
ORACLES["sealed_events"] = f"SELECT id::BIGINT AS id, true AS intact, false AS changed, false AS other_key FROM (VALUES {X.AUDIT}) AS t(id, ts, policy)"
ORACLES["cache_envelopes"] = """SELECT id::BIGINT AS id, response FROM (VALUES (1, '{"a":1}'), (2, NULL), (3, NULL), (4, NULL), (5, NULL), (6, NULL)) AS t(id, response)"""
ORACLES["encrypted_payloads"] = "SELECT conv_id, turn, true AS same, true AS lost FROM conversations"

# -- inline cases ------------------------------------------------------------------------------------------------------

_fixture_rows = """(1, 12, 29, 'EMAIL'), (1, 33, 48, 'PHONE_E164'), (2, 5, 24, 'CREDIT_CARD'), (3, 10, 18, 'IP_ADDRESS'), (5, 6, 34, 'URL'), (6, 12, 34, 'IBAN'),
 (7, 4, 15, 'SSN_US'), (8, 7, 27, 'EMAIL'), (8, 58, 74, 'CREDIT_CARD'), (9, 5, 18, 'PHONE_E164'), (9, 22, 38, 'PHONE_E164')"""
FIXTURE_SPANS = f"""SELECT f.doc_id::BIGINT AS doc_id, "start"::BIGINT AS "start", "end"::BIGINT AS "end", type, substr(text, "start" + 1, "end" - "start") AS value
 FROM (VALUES {_fixture_rows}) AS f(doc_id, "start", "end", type) JOIN {TEXTS} t ON t.doc_id = f.doc_id"""
ORACLES["detect_fixture_texts"] = with_ord(FIXTURE_SPANS, "doc_id")
# documents have neither: their phone numbers have parentheses, which the rule does not take
for name, kind in (("detect_phone", "PHONE_E164"), ("detect_ssn", "SSN_US")):
    ORACLES[name] = with_ord(f"SELECT * REPLACE (-doc_id AS doc_id) FROM ({FIXTURE_SPANS}) WHERE type = '{kind}'", "doc_id")
_listed = f"(SELECT doc_id, {LISTED} AS l FROM ({{0}}) GROUP BY doc_id)"


def _on_fixture(found: str, replacement: str, relex: str = "''") -> str:
    done = replaced(TEXTS, "doc_id", "text", found, replacement)
    return f"SELECT doc_id, redacted, coalesce(l, '') AS spans, coalesce({relex}, '') AS relex FROM ({done}) LEFT JOIN {_listed.format(found)} USING (doc_id)"


ORACLES["redact_plain_fixture"] = f"SELECT doc_id, redacted, spans FROM ({_on_fixture(FIXTURE_SPANS, quoted('[REDACTED]'))})"
_free = f"""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start") - 1 AS i FROM ({FIXTURE_SPANS}) WHERE type <> 'URL'"""
_new = "CASE type WHEN 'SSN_US' THEN '[ID]' ELSE '[' || type || '_' || lpad(i::VARCHAR, 4, '0') || ']' END"
_map = f"(SELECT string_agg(value || '=' || {_new}, ' ' ORDER BY value) FROM ({_free}) m WHERE m.doc_id = x.doc_id AND type <> 'SSN_US')"
ORACLES["redact_policy_default_fixture"] = ORACLES["redact_policy_strict_fixture"] = f"SELECT doc_id, redacted, spans, coalesce({_map}, '') AS relex FROM ({_on_fixture(_free, _new)}) x"
_some = f"SELECT * FROM ({FIXTURE_SPANS}) WHERE type IN ('SSN_US', 'CREDIT_CARD', 'IBAN')"
ORACLES["redact_policy_minimal_fixture"] = _on_fixture(_some, "CASE type WHEN 'SSN_US' THEN '[SSN]' WHEN 'IBAN' THEN '[IBAN]' ELSE '[CC-' || right(value, 4) || ']' END")
ORACLES["model_output_spans"] = """SELECT doc_id::BIGINT AS doc_id, ord::BIGINT AS ord, a::BIGINT AS "start", b::BIGINT AS "end", type, value, confidence::DOUBLE AS confidence FROM (VALUES
 (1, 0, 0, 5, 'PERSON', 'Alice', 0.9), (1, 1, 10, 13, 'PERSON', 'Bob', 0.8), (2, 0, 3, 7, 'CITY', 'Rome', 1.0)) AS t(doc_id, ord, a, b, type, value, confidence)"""
ORACLES["bio_decode"] = """SELECT doc_id::BIGINT AS doc_id, ord::BIGINT AS ord, a::BIGINT AS "start", b::BIGINT AS "end", type, 0.9::DOUBLE AS confidence FROM (VALUES
 (1, 0, 0, 9, 'PER'), (1, 1, 13, 17, 'LOC'), (1, 2, 18, 22, 'LOC'), (1, 3, 23, 27, 'PER')) AS t(doc_id, ord, a, b, type)"""
ORACLES["rscore_per_doc_predictions"] = """SELECT doc_id, round(n::DOUBLE, 9) AS n, d::DOUBLE AS d, m::BIGINT AS n_mandatory, c::BIGINT AS n_contextual, 0::BIGINT AS n_fp, s::BIGINT AS skipped, round((n / d)::DOUBLE, 9) AS r
 FROM (VALUES ('vehicle_record', 2.0::DOUBLE, 2, 2, 0, 1), ('email_alice', 10 / 17, 1, 1, 0, 0), ('email_john', 4 / 11, 1, 0, 1, 0), ('note_over_redact', 5 / 10, 1, 0, 1, 1),
 ('multiline_invoice', (8 / 20) / 2, 1, 0, 1, 0), ('email_phone', 9 / 13, 1, 1, 0, 0)) AS t(doc_id, n, d, m, c, s)"""

# -- service logs ------------------------------------------------------------------------------------------------------

ORACLES["dead_letters"] = """SELECT 1::BIGINT AS schema_version, job_id, error, tries::BIGINT AS attempts, recorded::BIGINT AS recorded_at FROM (
 VALUES ('c', 'undecodable payload', 1, 30), ('b', 'timeout', 5, 50), ('e', 'undecodable payload', 2, 70)) AS t(job_id, error, tries, recorded)"""
ORACLES["idempotency_leases"] = """SELECT key, seq::BIGINT AS seq, outcome FROM (VALUES ('k', 1, 'acquired'), ('k', 2, 'in_progress'), ('k', 3, 'lost'),
 ('k', 4, 'published'), ('k', 5, 'completed'), ('k', 6, 'conflict'), ('l', 1, 'acquired'), ('l', 2, 'released'), ('l', 3, 'acquired'),
 ('l', 4, 'lost'), ('l', 5, 'acquired'), ('l', 6, 'published'), ('l', 7, 'acquired')) AS t(key, seq, outcome)"""
ORACLES["shared_breaker"] = """SELECT model, seq::BIGINT AS seq, allowed, state FROM (VALUES ('m', 1, true, 'closed'), ('m', 2, NULL, 'closed'), ('m', 3, NULL, 'closed'),
 ('m', 4, NULL, 'open'), ('m', 5, false, 'open'), ('m', 6, true, 'open'), ('m', 7, false, 'open'), ('m', 8, NULL, 'open'), ('m', 9, false, 'open'),
 ('m', 10, true, 'open'), ('m', 11, NULL, 'closed'), ('m', 12, true, 'closed')) AS t(model, seq, allowed, state)"""
ORACLES["bucket_quantiles"] = """WITH b AS (SELECT unnest([1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 'inf'::DOUBLE]) AS le),
 h AS (SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM events, b GROUP BY ALL),
 w AS (SELECT *, lag(n, 1, 0) OVER o AS below, lag(le, 1, 0.0) OVER o AS low, max(n) OVER (PARTITION BY event_type) AS total FROM h WINDOW o AS (PARTITION BY event_type ORDER BY le)),
 f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS i FROM w WHERE n >= 0.99 * total)
 SELECT event_type, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (0.99 * total - below) / (n - below) END, 6) AS p99 FROM f WHERE i = 1"""
ORACLES["streams_completed"] = """SELECT id::BIGINT AS id, done FROM (VALUES (1, true), (2, false), (3, false), (4, true), (5, false), (6, false), (7, true)) AS t(id, done)"""
ORACLES["benchmark_texts"] = """SELECT doc_id, mode, sha256(text || CASE WHEN mode = 'cache-cold' THEN ' request-' || doc_id ELSE '' END) AS digest
 FROM documents, (VALUES ('cache-hot'), ('cache-cold')) AS m(mode)"""
ORACLES["pipeline_latency"] = "SELECT * FROM (VALUES (1::BIGINT, 6.5::DOUBLE), (2, 0.0), (3, 4.25)) AS t(id, total_ms)"
ORACLES["policy_versions"] = "SELECT * FROM (VALUES ('own', '7'), ('own without version', '0.0.0'), ('types', 'default'), ('default', '1.0.0')) AS t(request, version)"
ORACLES["converted_corpus"] = """SELECT doc_id, spans FROM (VALUES ('c_1', '0-5:PERSON 9-12:EMAIL'), ('c_6', '1-2:URL')) AS t(doc_id, spans)"""
