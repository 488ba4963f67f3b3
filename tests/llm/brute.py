"""Plain restatements of the contracts, for tables of a few dozen texts."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text: str | None, width: int = 5) -> frozenset:
    words = WORD.findall((text or "").translate(UPPER))
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def near_components(rows: list[tuple], percent: int) -> list[tuple]:
    """(doc_id, n_shingles, component_id) per row."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for k, b in enumerate(sets):
                shared = len(a & b)
                if a and b and 100 * shared >= percent * (len(a) + len(b) - shared) and label[i] != label[k]:
                    label[i] = label[k] = min(label[i], label[k])
                    changed = True
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        least[c] = i if least.get(c) is None else least[c] if i is None else min(least[c], i)
    return [(i, len(s), least[c]) for (i, _), s, c in zip(rows, sets, label, strict=True)]


def without_repeats(rows: list[tuple], length: int = 100) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of rows in the order of their positions."""
    seen, out = set(), []
    for i, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            own = raw[s : s + length]
            if own in seen:
                gone[s : s + length] = [True] * length
            seen.add(own)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return out


def luhn(digits: str) -> bool:
    doubled = [int(d) if k % 2 == 0 else sum(map(int, str(2 * int(d)))) for k, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def digest(found: list[tuple], kinds: list[str]) -> str:
    return hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found)).encode()).hexdigest()


def personal(text: str | None) -> tuple:
    text, kinds = text or "", ["email", "ip", "card", "phone"]
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return *(sum(f[1] == k for f in found) for k in range(4)), digest(found, kinds)


def either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def secret(text: str | None) -> tuple:
    text, kinds = text or "", ["assign", "access", "hex"]
    names = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
    assign = re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)
    found = [(m.start(), 0, m.end()) for m in assign if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return *(sum(f[1] == k for f in found) for k in range(3)), digest(found, kinds)


def best_dice(text: str | None, templates: dict[str, str], threshold: float) -> tuple | None:
    """(license, dice, first word, words) over all passages."""
    split = lambda t: re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", t.translate(UPPER)).split(" ")
    words = [w for w in split(text or "") if w]
    best = None
    for rank, (name, template) in enumerate(templates.items()):
        other = [w for w in split(template) if w]
        aim = Counter(zip(other, other[1:], strict=False))
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                own = Counter(zip(words[i:j], words[i + 1 : j], strict=False))
                dice = 2 * sum((own & aim).values()) / (sum(own.values()) + sum(aim.values()))
                if dice >= threshold and (best is None or (-dice, rank, i, j - i) < best[0]):
                    best = (-dice, rank, i, j - i), (name, dice, i, j - i)
    return best and best[1]


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def spelling_groups(rows: list[tuple], least_length: int = 7, factor: int = 10, every: int = 31) -> list[tuple]:
    """(word, form, root, n, n_near, form_n) over rows (doc_id, text)."""
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: best[w] if best[w] and n[best[w]] >= factor * n[w] else None for w in n}

    def root(w: str) -> str:
        return w if form[w] is None else root(form[w])

    return [(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n]
