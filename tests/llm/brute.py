"""Plain versions of the operators, over Python lists."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repetition(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]

    def covered(n, again):
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        often, seen, inside = Counter(grams), set(), set()
        for i, g in enumerate(grams):
            if often[g] > 1 and (not again or g in seen):
                inside.update(range(i, i + n))
            seen.add(g)
        return inside

    repeat = len(covered(8, False))
    failed = len(words) < 20 or 100 * repeat > 30 * len(words)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeat, "base_failed": failed,
            **{f"dup_{n}gram_chars": sum(len(words[i]) for i in covered(n, True)) for n in range(5, 11)}}


def shared_lines(rows, least=20, docs=3):
    """doc_id -> (n_lines, n_dropped, text)"""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    at = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            at[key(line)].add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < least or len(at[key(x)]) < docs or d == max(at[key(x)])]
        out[d] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def near_copies(rows, size, percent):
    """doc_id -> (n_shingles, component_id)"""
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    of = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and of[a] != of[b]:
                    low, high = sorted((of[a], of[b]))
                    of = {d: low if c == high else c for d, c in of.items()}
    return {d: (len(sets[d]), of[d]) for d in sets}


def targets(sizes, weights=(5, 2, 1), most=3):
    """source -> target; ``sizes`` has the sources in order."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    fixed = {}
    while True:
        free = [s for s in sizes if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / total for s in free}
        fixed |= {s: most * sizes[s] for s in over}


def top(vectors, k, every):
    """[(query_id, rank, vec_id, score)]"""
    out = []
    for q, x in vectors.items():
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), v) for v, y in vectors.items() if v != q)[:k]
            out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(scored)]
    return sorted(out)


def interleaved(rows, shards, seed):
    """[(doc_id, shard, slot)] from (doc_id, text, source) rows."""
    strata = defaultdict(list)
    for d, t, s in rows:
        crc = zlib.crc32((t or "").encode())
        mix = int(hashlib.md5(f"{seed}:{d}:{crc}".encode()).hexdigest()[:15], 16)
        strata["1" if s is None else "0" + s].append((mix, d, crc))
    order = []
    for s, members in strata.items():
        order += [((2 * r + 1) / (2 * len(members)), s, *m) for r, m in enumerate(sorted(members))]
    place = {row[3]: i for i, row in enumerate(sorted(order))}
    first = {}
    for i in range(len(order)):
        first.setdefault(i * shards // len(order), i)
    return sorted((d, i * shards // len(order), i - first[i * shards // len(order)]) for d, i in place.items())


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def variants(counts, ratio=10):
    """word -> (form, root, n_near, form_n)"""
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, len(near[w]), None if form[w] is None else counts[form[w]])
    return out


def vocabulary(rows, letters=7, least=2):
    words = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            words[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    return {w: n for w, n in words.items() if len(w) >= letters and n >= least}


def alignment(rows):
    """[(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha)] by both libraries, text by text."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    stand = {chr(x): x for x in (*range(33, 127), *range(161, 173), *range(174, 256))}
    stand |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if chr(x) not in stand)}
    docs, links = [], Counter()
    for d, t in rows:
        groups, pairs, n = [], [], (0, 0)
        if t:
            e = a.encode(" " + t, add_special_tokens=False)
            one = [(i, bytes(stand[c] for c in a.id_to_token(i))) for i in e.ids]
            two = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode())
                   for i, p in ((i, b.id_to_piece(i)) for i in b.encode(t))]
            want = (" " + t).encode()
            if b"".join(x for _, x in one) == want == b"".join(x for _, x in two):
                n = len(one), len(two)
                ends = []
                for side in (one, two):
                    at, where = 0, {}
                    for k, (_, x) in enumerate(side):
                        at += len(x)
                        where[at] = k
                    ends.append(where)
                i = j = 0
                for at in sorted(ends[0].keys() & ends[1].keys()):
                    i2, j2 = ends[0][at] + 1, ends[1][at] + 1
                    groups.append(",".join(str(x) for x, _ in one[i:i2]) + "|" + ",".join(str(x) for x, _ in two[j:j2]))
                    pairs.append((one[i2 - 1][0], two[j2 - 1][0]))
                    i, j = i2, j2
        links.update(pairs)
        docs.append((d, n, len(groups), pairs, sha(";".join(groups)) if groups else ""))
    top = Counter()
    for (x, y), k in links.items():
        top[y] = max(top[y], k)
    return [(d, *n, g, len(pairs), sum(links[p] == top[p[1]] for p in pairs), sum(links[p] for p in pairs), s)
            for d, n, g, pairs, s in docs]
