"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict

import public_tokenizers
import tiktoken
import xxhash

SPACE = " \t\n\x0b\x0c\r"


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def low(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def warc(pages):
    firsts, out = {}, set()
    for i, _, html in sorted(pages):
        firsts.setdefault(html or "", i)
    for i, _, html in pages:
        raw = (html or "").encode()
        first = firsts[html or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.add((i, len(raw), digest, "response" if i == first else "revisit", None if i == first else first))
    return out


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text: str, width: int) -> list[str]:
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    return [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def fingerprint(text: str, width: int) -> int:
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, width)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(docs, width, reach):
    fp = {i: fingerprint(t, width) for i, t in docs}
    by = defaultdict(list)
    for i, f in fp.items():
        by[f].append(i)
    points = list(by)
    linked = [(min(by[a]), min(by[b])) for k, a in enumerate(points) for b in points[:k] if (a ^ b).bit_count() <= reach]
    linked += [(i, min(g)) for g in by.values() for i in g]
    found = components(fp, linked)
    return {(i, f"{fp[i]:016x}", found[i]) for i in fp}


def urls(pages, rules):
    out = set()
    for i, url, _ in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = low(host)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.name), default=None)
        out.add((i, host, path, rule and rule.name, rule and ("allow" if rule.allow else "block")))
    return out


def luhn(digits: str) -> bool:
    total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def pii(text: str):
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            found.append(("card", m))
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return [(k, m.start(), m.end()) for k, m in found]


def secrets(text: str):
    found = []
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, m.end(), "assign") for m in re.finditer(pattern, text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, e, k in sorted(found)]


def spans(found) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def lines(docs, least=20, times=3):
    key = lambda line: low(line.strip(SPACE))
    holders = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    common = {k: max(v) for k, v in holders.items() if len(k) >= least and len(v) >= times}
    out = {}
    for i, t in docs:
        rows = (t or "").split("\n")
        out[i] = (len(rows), [x for x in rows if common.get(key(x), i) == i])
    return out
