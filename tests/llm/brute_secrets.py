"""Row-at-a-time version of the secret scan."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from memlake.llm import secrets as S


def base(text):
    out = []
    for rank, (kind, pattern, group, least) in enumerate(S.BASE):
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m.group(group)) >= least:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def allowed(token):
    return any(re.search(p, token) for p in S.ALLOW)


def runs(token):
    """(start, run, least): the token, and the runs of a narrower class in it that are candidates by themselves."""
    which = next(i for i, (_, chars, _) in enumerate(S.CLASSES) if re.fullmatch(chars, token))
    yield 0, token, S.CLASSES[which][2]
    for _, chars, least in S.CLASSES[:which]:
        for m in re.finditer(chars, token):
            run = m.group()
            if len(run) >= S.WINDOW and re.search("[A-Za-z]", run) and re.search("[0-9]", run) and not allowed(run):
                yield m.start(), run, least


def entropy(text):
    out = []
    for m in re.finditer(S.CANDIDATE, text):
        if allowed(m.group()):
            continue
        windows = []
        for at, run, least in runs(m.group()):
            for i in range(S.WINDOW, len(run) + 1):
                counts = Counter(run[i - S.WINDOW:i])
                h = -sum(c / S.WINDOW * math.log2(c / S.WINDOW) for c in counts.values())
                if h >= least - 1e-9:
                    windows.append((at + i - S.WINDOW, at + i))
        spans = []
        for a, b in sorted(windows):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        out += [(m.start() + a, len(S.BASE), m.start() + b, "entropy") for a, b in spans]
    return out


def scan(text):
    text = text or ""
    found = base(text)
    extra = [e for e in entropy(text) if not any(b[0] <= e[0] and e[2] <= b[2] for b in found)]
    text_of = lambda spans: ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
    n = Counter(k for *_, k in found)
    return (n["assign"], n["access"], n["hex"], hashlib.sha256(text_of(found).encode()).hexdigest(),
            text_of(found + extra))
