"""The operators' results by the plainest means, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def crc(numbers):
    return zlib.crc32(np.array(numbers, "<u4").tobytes())


def streams(docs, end):
    """(doc_id, start, n, crc) in order of id, then text."""
    out, start = [], 0
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or "")):
        x = [*ids(text), end]
        out.append((doc_id, start, len(x), crc(x)))
        start += len(x)
    return out


def pieces(docs, end, capacity):
    out = []
    for doc_id, text in docs:
        x = [*ids(text), end]
        out += [(doc_id, k, i, len(x[i:i + capacity]), crc(x[i:i + capacity])) for k, i in enumerate(range(0, len(x), capacity))]
    return out


def encoded(docs):
    out = []
    for doc_id, text in docs:
        x = ids(text)
        out.append((doc_id, len(x), sha(" ".join(map(str, x))), sha(TOKENIZER.decode(x, skip_special_tokens=False))))
    return out


def repeats(docs, length):
    """(doc_id, bytes, removed, spans, sha of the rest) and the bytes that stay."""
    texts = [(d, (t or "").encode()) for d, t in docs]
    times = Counter(b[i:i + length] for _, b in texts for i in range(len(b) - length + 1))
    out, rest = [], []
    for d, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if times[b[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), int(gone.sum()), spans, sha(kept)))
        rest.append(kept)
    return out, rest


def shingles(text):
    w = WORDS((text or "").encode().lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(docs):
    """(n_shingles, component) of each row; links at 80 % of the union."""
    sets = [shingles(t) for _, t in docs]
    label = list(range(len(docs)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                label[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        groups[find(i)].append(d)
    smallest = {g: min((d for d in m if d is not None), default=None) for g, m in groups.items()}
    return [(d, len(sets[i]), smallest[find(i)] if sets[i] else d) for i, (d, _) in enumerate(docs)]
