"""Small inline tables for rules and cases that the driver's tables do not have.

Each is the text of a VALUES list that Spark and DuckDB read alike.
"""

from __future__ import annotations

#: doc_id, text: one or more hits of every rule, near misses, and characters outside of the basic plane.
TEXTS = """
 (1, 'Reach me at alice@example.com or +1 415-555-2671'),
 (2, 'Card 4532 0151 1283 0366 expires next year'),
 (3, 'Server at 10.0.0.1 went down at midnight'),
 (4, 'Pure free text with no PII whatsoever'),
 (5, 'Visit https://example.com/path?x=1 for the docs'),
 (6, 'His IBAN is GB00FAKE00000000000000 says the bank'),
 (7, 'SSN 123-45-6789 is good, 000-45-6789 and 123-00-6789 are not'),
 (8, '😀 mail bob@mail.example.org, card 4532015112830367 fails, 4532015112830366 holds 😀'),
 (9, 'Call +442071838750 or +49-301-2345-678 now'),
 (10, '')
"""

#: The expected spans of the first six texts: doc_id, start, end, type.
GOLD = """
 (1, 12, 29, 'EMAIL'), (1, 33, 48, 'PHONE_E164'), (2, 5, 24, 'CREDIT_CARD'), (3, 10, 18, 'IP_ADDRESS'),
 (5, 6, 34, 'URL'), (6, 12, 34, 'IBAN')
"""

#: case, ord, start, end, type, confidence: overlapping and chained spans.
SPANS = """
 (1, 0, 0, 10, 'A', 0.5), (1, 1, 2, 8, 'B', 0.9),
 (2, 0, 0, 10, 'A', 0.9), (2, 1, 2, 8, 'B', 0.5),
 (3, 0, 0, 5, 'A', 0.7), (3, 1, 0, 5, 'B', 0.7),
 (4, 0, 0, 4, 'A', 0.5), (4, 1, 3, 8, 'B', 0.6), (4, 2, 7, 12, 'C', 0.7),
 (5, 0, 0, 4, 'A', 0.5), (5, 1, 4, 8, 'B', 0.5),
 (6, 0, 9, 12, 'A', 1.0), (6, 1, 0, 3, 'B', 0.1), (6, 2, 2, 10, 'C', 0.5)
"""

#: case, ord, start, end: spans against the text 'hello world'.
OFFSETS = "(1, 0, 0, 5), (1, 1, -1, 3), (1, 2, 5, 5), (1, 3, 6, 12), (1, 4, 8, 7)"

#: doc_id, side, start, end, confidence: rule and model spans.
SIDES = """
 (1, 'rule', 0, 5, 1.0), (1, 'model', 2, 7, 0.9), (2, 'model', 0, 5, 0.7), (3, 'model', 0, 5, 0.4),
 (4, 'rule', 0, 5, 1.0), (4, 'model', 5, 9, 0.5), (4, 'model', 20, 29, 0.8), (5, 'rule', 3, 9, 1.0)
"""

#: doc_id, length: texts of interval cases; and their spans by side.
LENGTHS = "(1, 20), (2, 14), (3, 0), (4, 10), (5, 62)"
INTERVALS = """
 (1, 'prediction', 0, 5), (1, 'prediction', 5, 9), (1, 'prediction', 12, 30), (1, 'support', 2, 4), (1, 'support', 8, 14),
 (2, 'prediction', 0, 5), (2, 'prediction', 5, 8), (2, 'support', 5, 8),
 (3, 'prediction', 0, 5), (4, 'support', 0, 10), (4, 'prediction', 3, 3), (4, 'prediction', -4, 2),
 (5, 'prediction', 0, 62), (5, 'support', 9, 28), (5, 'support', 29, 48), (5, 'support', 56, 62)
"""

#: doc_id, category, text, and the spans and predictions of the scoring corpus.
CORPUS = """
 ('vehicle_record', 'operations', 'Vehicle: "5N1AT2MK4FC824170" "2015 Nissan Rogue" plate= 321ABC'),
 ('email_alice', 'emails', 'Reach me at alice@example.com tomorrow please'),
 ('email_john', 'emails', 'His name is John M. Doe and he lives in Springfield.'),
 ('note_over_redact', 'operations', 'Note from 2024-01-15: meeting at 1600 Pennsylvania Ave NW'),
 ('multiline_invoice', 'financial', concat('See the attached', chr(10), 'invoice #INV-2026-001 for the breakdown')),
 ('email_phone', 'emails', 'Call me at (415) 555-2671 between 9 and 5')
"""
ANNOTATIONS = """
 ('vehicle_record', 9, 10, 'contextual'), ('vehicle_record', 10, 27, 'mandatory'), ('vehicle_record', 27, 28, 'contextual'),
 ('vehicle_record', 29, 48, 'contextual'), ('vehicle_record', 56, 62, 'mandatory'), ('email_alice', 12, 29, 'mandatory'),
 ('email_john', 12, 23, 'contextual'), ('note_over_redact', 10, 20, 'contextual'), ('note_over_redact', 33, 53, 'contextual'),
 ('multiline_invoice', 15, 37, 'contextual'), ('email_phone', 11, 24, 'mandatory')
"""
PREDICTIONS = """
 ('vehicle_record', 10, 27), ('vehicle_record', 56, 62), ('email_alice', 12, 22), ('email_john', 12, 16),
 ('note_over_redact', 10, 15), ('multiline_invoice', 17, 25), ('email_phone', 11, 20)
"""

#: unit_id, kind, and the votes of four raters.
_VOTES = {
    "u1": ("gap_a", "0000"), "u2": ("gap_b", "0000"), "u3": ("yellow", "1010"), "u4": ("red", "1111"), "u5": ("yellow", "0101"),
    "u6": ("gap_a", "0000"), "u7": ("yellow", "1010"), "u8": ("gap_a", "0000"), "u9": ("gap_b", "1100"), "u10": ("red", "1100"),
}
RATINGS = ", ".join(
    f"('{u}', '{kind}', 'user{i}', {'true' if v == '1' else 'false'})" for u, (kind, votes) in _VOTES.items() for i, v in enumerate(votes, 1)
)

#: job_id, seq, event.
JOBS = """
 ('a', 1, 'submit'), ('a', 2, 'claim'), ('a', 3, 'done'), ('a', 4, 'failed'), ('b', 1, 'submit'), ('b', 2, 'cancel'),
 ('b', 3, 'claim'), ('c', 1, 'submit'), ('c', 2, 'claim'), ('c', 3, 'cancel'), ('d', 1, 'claim'), ('e', 1, 'submit'), ('e', 2, 'failed')
"""

#: model, seq, at, ok: calls through a breaker.
CALLS = """
 ('m', 1, 0.0, true), ('m', 2, 1.0, false), ('m', 3, 2.0, false), ('m', 4, 3.0, false), ('m', 5, 4.0, true), ('m', 6, 7.9, true),
 ('m', 7, 8.0, false), ('m', 8, 9.0, true), ('m', 9, 13.0, true), ('m', 10, 14.0, false), ('n', 1, 0.0, false), ('n', 2, 1.0, true)
"""

#: seq, owner, change: job requests and ends.
ADMISSIONS = """
 (1, 'x', 1), (2, 'x', 1), (3, 'x', 1), (4, 'y', 1), (5, 'y', 1), (6, 'x', -1), (7, 'y', 1), (8, 'z', -1), (9, 'z', 1), (10, 'x', 1)
"""

#: key, seq, fingerprint.
REQUESTS = "('k', 1, 'f'), ('k', 2, 'f'), ('k', 3, 'g'), ('l', 4, 'f'), ('m', 5, 'h'), ('m', 6, 'h')"

#: Audit lines: id, ts, policy.
AUDIT = """
 (1, '2024-01-01T00:00:00+00:00', 'a'), (2, '2024-02-01T10:00:00+00:00', 'b'), (3, 'not-json', 'c'), (4, '2024-01-31T23:59:59+00:00', 'd')
"""

#: worker, active, most: heartbeats as they are stored.
WORKERS = "('w1', '3', '10'), ('w2', 'bad', '10'), ('w3', '-2', '8'), ('w4', '4', '-1')"

#: label of a model.
LABELS = "('email'), (' Phone-Number '), ('SSN'), ('first name'), ('unknown thing'), (''), ('credit_debit_card'), ('IPV6')"

#: requests: id, given id, chars, has a policy, has types, is staged.
CALLERS = """
 (1, 'ok-id_1.2:3', 10, false, false, false), (2, 'bad id', 0, false, false, false), (3, null, 100001, true, false, false),
 (4, '', 5, true, true, false), (5, 'x', 5, false, true, true)
"""

#: A Markdown table, line by line; and a manifest.
STATUS_LINES = """
 ('# Readiness'), ('| Requirement | Status | Evidence |'), ('| --- | --- | --- |'), ('| redaction | verified | tests |'),
 ('| scaling | partial | notes |'), ('| audit | verified | tests |'), ('| gpu | planned | none |'), ('| broken | row |')
"""
MANIFEST_LINES = "('# name revision digest'), ('small main abc123'), ('large v2 def456'), (''), ('too few')"

#: id, body: event streams. JSON lines that are no objects, and lines of other kinds, end nothing.
STREAMS = r"""
 (1, 'data: {"chunk_ix":0}\n\ndata: [DONE]\n\n'), (2, 'data: {"chunk_ix":0}\n\n'), (3, 'data: {"error":"timeout"}\n\ndata: [DONE]\n\n'),
 (4, 'data: oops\ndata: ["error"]\n  data: [DONE]  \ndata: {"error":1}'), (5, ''), (6, 'event: [DONE]'), (7, 'data: {"a":"error"}\r\ndata: [DONE]\r\n')
"""

#: job_id, tries, ok, decoded, error, at: tries of jobs.
TRIES = """
 ('a', 1, false, true, 'timeout', 10), ('a', 2, true, true, null, 20), ('b', 4, false, true, 'timeout', 40), ('b', 5, false, true, 'timeout', 50),
 ('c', 1, false, false, 'undecodable payload', 30), ('d', 5, false, true, 'refused', 5), ('e', 2, false, false, 'undecodable payload', 70)
"""

#: key, seq, at, event, fingerprint, token: what callers ask of idempotency leases that end after 100.
LEASES = """
 ('k', 1, 0, 'reserve', 'f', 't1'), ('k', 2, 10, 'reserve', 'f', 't2'), ('k', 3, 20, 'complete', 'f', 't2'), ('k', 4, 30, 'complete', 'f', 't1'),
 ('k', 5, 40, 'reserve', 'f', 't3'), ('k', 6, 50, 'reserve', 'g', 't4'), ('l', 1, 0, 'reserve', 'f', 't1'), ('l', 2, 5, 'release', 'f', 't1'),
 ('l', 3, 6, 'reserve', 'f', 't2'), ('l', 4, 200, 'complete', 'f', 't2'), ('l', 5, 210, 'reserve', 'f', 't3'), ('l', 6, 220, 'complete', 'f', 't3'),
 ('l', 7, 400, 'reserve', 'g', 't4')
"""

#: model, seq, at, event, probe: a breaker that replicas share.
PROBES = """
 ('m', 1, 0D, 'allow', false), ('m', 2, 1D, 'failure', false), ('m', 3, 2D, 'failure', false), ('m', 4, 3D, 'failure', false), ('m', 5, 4D, 'allow', false),
 ('m', 6, 8D, 'allow', false), ('m', 7, 9D, 'allow', false), ('m', 8, 9.5D, 'failure', true), ('m', 9, 10D, 'allow', false), ('m', 10, 14.5D, 'allow', false),
 ('m', 11, 15D, 'success', true), ('m', 12, 16D, 'allow', false)
"""

#: id, language, source_text, privacy_mask: rows of a corpus to convert.
MASKED = """
 (1, 'en', 'Alice has a@b in mail', array(named_struct('start', 9, 'end', 12, 'label', 'EMAIL'), named_struct('start', 0, 'end', 5, 'label', 'FIRSTNAME'))),
 (2, 'de', 'Nichts', array(named_struct('start', 0, 'end', 2, 'label', 'EMAIL'))), (3, 'en', 'None here', array()), (4, 'en', ' \\r\\n ', array(named_struct('start', 0, 'end', 1, 'label', 'EMAIL'))),
 (1, 'en', 'Once more', array(named_struct('start', 0, 'end', 2, 'label', 'EMAIL'))), (6, 'en', 'Odd label', array(named_struct('start', 1, 'end', 2, 'label', 'STRANGE')))
"""
