"""Plain versions of the operators' results, written from their definitions alone, for small tables."""

import hashlib
import re
from collections import Counter

import xxhash
from tokenizers import Tokenizer

SPACE = r"[^\x20\x09-\x0D]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha(line):
    return hashlib.sha256(line.encode()).hexdigest()


def tokens(vocabulary, text):
    return Tokenizer.from_file(vocabulary).encode(text or "", add_special_tokens=False).ids


def secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [("assign", *m.span())] * (len(m[2]) >= 12)
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def rules(text):
    text = text or ""
    words = re.findall(SPACE, text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            hit |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def private(text):
    text, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        out += [("card", *m.span())] * (14 <= len(digits) <= 19 and luhn(digits))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))


def private_more(text, iban, account):
    """Web addresses, and numbers after a cue's word; ``iban`` and ``account`` match what may follow the word."""
    out = []
    for m in re.finditer(r"(?:https?|ftp)://([^\s<>\"'{}|\\^`]+)", text):
        end = m.start(1) + len(m[1].rstrip(".,;:!?)]"))
        out += [("url", m.start(), end)] * (end > m.start(1))
    cues = "iban IBAN Iban account Account ACCOUNT ssn SSN passport Passport konto Konto compte Compte cuenta Cuenta"
    for m in re.finditer(f"(?:{'|'.join(cues.split())})[A-Za-z]{{0,16}}", text):
        if number := iban(text, m.end()):
            digits = "".join(str(int(c, 36)) for c in (number[1][4:] + number[1][:4]).replace(" ", ""))
            out += [("iban", *number.span(1))] * (15 <= len(number[1].replace(" ", "")) <= 34 and int(digits) % 97 == 1)
        elif number := account(text, m.end()):
            out.append(("account", *number.span(1)))
    return sorted(out)


def license_labels(text, rules):
    """Labels and score of all rules, ungated; a detection goes if one that outranks it contains it."""
    words = " ".join(re.findall(WORD, lower(text or "")))
    found = [(r.priority, m.start(), m.end(), r) for r in rules for m in r.pattern.finditer(f" {words} ")]
    found.sort(key=lambda d: (-d[0], d[1] - d[2], d[1]))
    kept = []
    for d in found:
        if not any(k[1] <= d[1] and d[2] <= k[2] for k in kept):
            kept.append(d)
    left = 1.0
    for d in kept:
        left *= 1 - d[3].weight
    return ",".join(sorted({d[3].label for d in kept} | {d[3].label for d in found if d[3].base})), 1 - left


def simhash(text):
    words = re.findall(SPACE, lower(text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(rows):
    """[(doc_id, fingerprint)] to doc_id's smallest reachable id, by fingerprint."""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for doc_id, f in rows:
        if doc_id is not None:
            least[find(f)] = min(doc_id, least.get(find(f), doc_id))
    return {f: least.get(find(f)) for f in prints}


def licenses(text):
    words = re.findall(WORD, lower(text or ""))
    base = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    places = [(i, label) for label, p in base.items() for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def contamination(text, items):
    """items: [(item_id, text)]"""
    words = re.findall(WORD, lower(text or ""))
    hit, found = set(), set()
    for name, item in items:
        w = re.findall(WORD, lower(item or ""))
        n = min(13, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(name))
    return len(words), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(words)
