"""Plain single-process versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

SPACE_WORDS = re.compile("[^\x20\x09-\x0d]+")
ALNUM_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def op1(docs, items):
    phrases = defaultdict(set)
    for item, text in items:
        w = ALNUM_WORDS.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - 12)) if w else ():
            phrases[tuple(w[i : i + 13])].add(item)
    by_len = defaultdict(dict)
    for p, who in phrases.items():
        by_len[len(p)][p] = who
    out = []
    for doc, text in docs:
        w = ALNUM_WORDS.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n, table in by_len.items():
            for i in range(len(w) - n + 1):
                if (who := table.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= who
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def op7(docs):
    out = []
    for doc, text in docs:
        w = SPACE_WORDS.findall(text or "")
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        rep = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        lines = Counter(x for x in (text or "").split("\n") if SPACE_WORDS.search(x))
        out.append((doc, len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), sum(v - 1 for v in lines.values()), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)))
    return out


def op4(docs):
    sets = {}
    for doc, text in docs:
        w = SPACE_WORDS.findall((text or "").translate(LOWER))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    common = Counter()
    for v in holders.values():
        for i, a in enumerate(v):
            for b in v[i + 1 :]:
                common[a, b] += 1
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for (a, b), c in common.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            links[a] += 1
            links[b] += 1
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return [(d, len(s), root(d)) for d, s in sets.items()]


def op5(docs, width=100):
    seen, out = set(), []
    for doc, text in sorted(docs, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            s = b[i : i + width]
            if s in seen:
                gone[i : i + width] = b"\1" * width
            else:
                seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


def op9(docs, width=50):
    seen, out = set(), []
    for doc, text in sorted(docs, key=lambda r: r[0]):
        w = SPACE_WORDS.findall(text or "")
        gone, own = set(), set()
        for i in range(len(w) - width + 1):
            s = tuple(w[i : i + width])
            own.add(s)
            if s in seen:
                gone |= set(range(i, i + width))
        seen |= own
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def _luhn(v):
    total = 0
    for i, c in enumerate(reversed(v)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and _luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 15),
}


def op2(docs):
    out = []
    for doc, text in docs:
        found = {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m[0])] for k, (p, ok) in PII.items()}
        out.append((doc, *(len(found[k]) for k in PII), sha(",".join(f"{k}:{s}:{e}" for k in PII for s, e in found[k]))))
    return out


def _encoders():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def _token_bytes(a, b):
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    return lambda i: bytes(letter[c] for c in a.id_to_token(i)), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()


def op11(docs):
    a, b = _encoders()
    a.encode_special_tokens = True
    bytes_a, bytes_b = _token_bytes(a, b)
    rows, count = [], Counter()
    for doc, text in docs:
        x, y = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        parts = [bytes_a(i) for i in x], [bytes_b(i) for i in y]
        if b"".join(parts[0]) != b"".join(parts[1]) or b"".join(parts[0]) != f" {text or ''}".encode():
            x, y, parts = [], [], ([], [])
        ends = []
        for p in parts:
            at = 0
            ends.append([at := at + len(t) for t in p])
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, lo = [], 0
        for hi in both:
            groups.append(tuple([i for i, e in zip(ids, own, strict=True) if lo < e <= hi] for ids, own in zip((x, y), ends, strict=True)))
            lo = hi
        links = [(g[0][-1], g[1][-1]) for g in groups]
        count.update(links)
        rows.append((doc, x, y, groups, links))
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    out = []
    for doc, x, y, groups, links in rows:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((doc, len(x), len(y), len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), sha(text) if x else ""))
    return out


def op12_pieces(docs, capacity=2048):
    import struct
    import zlib

    a, _ = _encoders()
    out = []
    for doc, text in docs:
        ids = [*a.encode(text or "", add_special_tokens=False).ids, 0]
        sizes = [len(ids)] if len(ids) <= capacity else ([len(ids) % capacity] if len(ids) % capacity else []) + [capacity] * (len(ids) // capacity)
        lo = 0
        for k, n in enumerate(sizes):
            out.append((doc, k, lo, n, zlib.crc32(struct.pack(f"<{n}I", *ids[lo : lo + n]))))
            lo += n
    return out


def op13(docs):
    import zlib

    count = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}

    def near(x, y):
        if abs(len(x) - len(y)) > 1 or x == y:
            return False
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y, strict=True)) == 1
        x, y = sorted((x, y), key=len)
        return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))

    close = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, vs in close.items():
        if vs and words[best := min(vs, key=lambda v: (-words[v], v))] >= 10 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(close[w]), form.get(w), words.get(form.get(w)), root))
    return out
