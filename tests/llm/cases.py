"""Small tables for the tests of the document operators, and brute-force forms of their contracts."""

import hashlib
import struct
import zlib

import public_tokenizers
import xxhash
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, fp string, score double, _source string, `group` string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


def docs(spark, texts, ids=None, sources=None):
    """Documents with columns whose names the operators use inside."""
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[k], None if t is None else len(t), k, "fp", 0.5, None, "g") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    """Nulls, empty and very long texts, repeated rows and ties."""
    texts = [None, "", " ", "One two three four", "one TWO three four", "One two three four", LONG, LONG + " end", "é ß ́x", "a  b\n\nc", None, "x"]
    ids = [0, 1, 2, 3, 4, 3, 5, 6, 7, 8, None, None]
    return docs(spark, texts, ids, ["a", None, "b", "a", "a", "a", "b", None, "c", "c", "d", "d"])


def encoded(name, text):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def simhash(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def components(pairs):
    """Smallest id reachable from each (id, fingerprint)."""
    label = list(range(len(pairs)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 3:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    groups = {}
    for i, (d, _) in enumerate(pairs):
        groups.setdefault(find(i), []).append(d)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(pairs))]


def repeats(rows, window=13):
    """n_words, n_removed and hash of what is left, for (doc_id, text) rows."""
    key = lambda d: (d is not None, d or 0)
    first = {}
    for d, t in sorted(rows, key=lambda r: key(r[0])):
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), key(d))
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < key(d):
                gone[i:i + window] = [True] * window
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def merkle(rows, fanout=8):
    """The rows of op11 for (doc_id, source, lang, n_chars, text) rows, by plain lists."""
    H = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def leaf(r):
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(nodes):
        """Root and, for each node, its [(place, siblings)]."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                run = nodes[i - i % fanout: i - i % fanout + fanout]
                paths[k].append((i % fanout, run[:i % fanout] + run[i % fanout + 1:]))
            nodes = [H("".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)]
            at = [i // fanout for i in at]
        return nodes[0], paths

    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for v in langs:
        mine = sorted(by_lang[v], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[v] = (mine, *tree([leaf(r) for r in mine]))
    if not langs:
        return []
    root, tops = tree([trees[v][1] for v in langs])
    out = []
    for v, top in zip(langs, tops):
        mine, sub, paths = trees[v]
        for r, path in zip(mine, paths):
            path = path + top
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            d = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if changed else leaf(r)
            for place, siblings in path:
                d = H("".join(siblings[:place]) + d + "".join(siblings[place:]))
            out.append((r[0], leaf(r), sub, root, H("".join("".join(s) for _, s in path)), d, d == root))
    return out


def trie(rows):
    """The rows of op12 for (conv_id, turn, role, text) rows, by plain dictionaries."""
    def content(role, text):
        role, text = role or "", text or ""
        return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text

    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, *content(role, text)))
    convs = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    nodes = {}
    for c in convs:
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        seq = (convs.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] if h else []) + convs[c][h:]  # the remainder has the sign of c, as in SQL
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append((c, d == len(seq)))
    big = 2**63 - 1
    least = lambda members: min(big if c is None else c for c, _ in members)
    name = lambda c: None if c == big else c
    value = {k: (len(m) - 1) * (len(k[-1][1].encode().split()) if k else 0) for k, m in nodes.items()}
    out = []
    for k, m in nodes.items():
        below = [u for u in nodes if u[:len(k)] == k]
        children = [u for u in below if len(u) == len(k) + 1]
        inner = {u[:-1] for u in below if len(u) > len(k)} | {u[:i] for u in below for i in range(len(k), len(u))}
        ends = ",".join(map(str, sorted(c for c, e in m if e and c is not None)))
        out.append((name(least(m)), len(k), name(least(nodes[k[:-1]])) if k else None, len(m), len(children), sum(u not in inner for u in below),
                    sum(value[u] for u in below), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def shingle_set(text, words=5):
    found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(b" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()


def similar_pairs(rows, least=0.8):
    """Pairs of doc_ids whose sets of five-word shingles are similar, through every shingle that texts share."""
    sets = {d: shingle_set(t) for d, t in rows}
    where = {}
    for d, s in sets.items():
        for x in s or (None,):
            where.setdefault(x, []).append(d)
    seen, out = set(), []
    for ids in where.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                x, y = sets[a], sets[b]
                if (b, a) not in seen and min(len(x), len(y)) >= least * max(len(x), len(y)):
                    seen.add((b, a))
                    if len(x & y) >= least * len(x | y):
                        out.append((b, a))
    return out
