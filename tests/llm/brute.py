"""Plain restatements of the contracts, to hold the operators against."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash


def media(text):
    raw = (text or "").encode()
    payload = raw.ljust(max(1, math.ceil(len(raw) / 192)) * 192, b" ")
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])


def removed(texts, size=50):
    """doc_id: (n_bytes, n_removed, n_spans, kept_sha256) by comparing all strings of size bytes."""
    first = {}
    for doc_id in sorted(texts):
        raw = texts[doc_id]
        for i in range(len(raw) - size + 1):
            first.setdefault(raw[i : i + size], doc_id)
    out = {}
    for doc_id, raw in texts.items():
        gone = bytearray(len(raw))
        for i in range(len(raw) - size + 1):
            if first[raw[i : i + size]] < doc_id:
                gone[i : i + size] = b"\1" * size
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[doc_id] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def base_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = sum(x in lines[:i] for i, x in enumerate(lines))
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), failed


def base_secrets(text):
    text = text or ""
    kinds = (
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18),
        ("hex", r"[0-9a-f]+", 0, 16),
    )
    spans = []
    for k, (name, pattern, group, least) in enumerate(kinds):
        spans += [(m.start(), k, m.end(), name) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
    spans.sort()
    listed = ",".join(f"{n}:{a}:{b}" for a, _, b, n in spans)
    count = Counter(s[1] for s in spans)
    return count[0], count[1], count[2], hashlib.sha256(listed.encode()).hexdigest()


def entropy_runs(candidate, window, bits):
    """Merged windows whose entropy, counted anew for each, reaches bits."""
    runs = []
    for i in range(len(candidate) - window + 1):
        counts = Counter(candidate[i : i + window]).values()
        if math.log2(window) - sum(c * math.log2(c) for c in counts) / window >= bits:
            if runs and runs[-1][1] >= i:
                runs[-1][1] = i + window
            else:
                runs.append([i, i + window])
    return [tuple(r) for r in runs]


def warc_rows(pages):
    """page_id: (payload_bytes, digest, type, refers_to)."""
    firsts = {}
    for page_id, html in pages:
        key = html or ""
        firsts[key] = min(firsts.get(key, page_id), page_id)
    out = {}
    for page_id, html in pages:
        raw = (html or "").encode()
        first = firsts[html or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out[page_id] = (len(raw), digest, "response" if first == page_id else "revisit", None if first == page_id else first)
    return out


def simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def components(fps, radius=4):
    """doc_id: smallest doc_id reachable; fps: doc_id to fingerprint."""
    up = {d: d for d in fps}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def unigram_base(texts):
    """doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)."""
    tokens = {d: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    counts = Counter(t for d, ts in tokens.items() if not held[d] for t in ts)
    n, v = sum(counts.values()), len(counts)
    out = {}
    for d, ts in tokens.items():
        score = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts)
        out[d] = (held[d], len(ts), sum(counts[t] > 0 for t in ts), n, score)
    return out


def groups(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out


def periodic_runs(words):
    """(start, length, period) of all runs by comparing every word with that at every distance, and the words kept."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            first = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            if i - first + q >= max(12, 2 * q):
                found.setdefault((first, i + q), q)
            i += 1
    runs = sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return runs, [w for i, w in enumerate(words) if i not in gone]


def made_periodic(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def lowered_words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def importance(documents, target, least_words=20, percent=10, seed=2024, buckets=10_000, longest=1):
    """doc_id: (n_features, weight, score, rank) of (doc_id, text) rows with distinct ids."""

    def runs(text):
        words = lowered_words(text)
        return [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    ours, theirs = Counter(b for _, t in documents for b in runs(t)), Counter(b for t in target for b in runs(t))
    s_all, t_all = sum(ours.values()) + buckets, sum(theirs.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((theirs[b] + 1) * s_all / ((ours[b] + 1) * t_all)))
    out, able = {}, []
    for doc_id, text in documents:
        own = runs(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, own))
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[doc_id] = [len(own), weight, score, None]
        if len(lowered_words(text)) >= least_words:
            able.append(doc_id)
    able.sort(key=lambda i: (-out[i][2], i is None, i or 0))
    for place, doc_id in enumerate(able[: percent * len(able) // 100]):
        out[doc_id][3] = place + 1
    return {i: tuple(v) for i, v in out.items()}
