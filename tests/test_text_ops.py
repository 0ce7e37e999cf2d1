"""Chunking, local embedding and fuzzy names against small brute-force models."""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import functions as F

from memlake.config import EMBED_EXTRA_LETTERS
from memlake.functions.embed import with_embedding
from memlake.operators import documents as D
from memlake.operators import projects as P

JS_WS = "\t\n\x0b\x0c\r \xa0 " + "".join(chr(c) for c in range(0x2000, 0x200B)) + "    　﻿"


def model_chunk(text, size, sep):
    """chunkText as the service defines it (empty chunks dropped, as ours)."""
    if len(text) <= size:
        out = [text]
    else:
        out, cur = [], ""
        for p in re.split(sep, text):
            if len(cur) + len(p) + 2 > size and len(cur) > 0:
                out.append(cur.strip(JS_WS))
                cur = ""
            cur += ("\n\n" if cur else "") + p
        if cur.strip(JS_WS):
            out.append(cur.strip(JS_WS))
    return [c for c in out if c != ""]


def test_chunking_matches_model(spark):
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", " ", "  ", "delta"]
    texts = []
    for i in range(80):
        paras = ["".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(1, 12))]
        texts.append((i, rnd.choice(["\n\n", "\n\n\n", "\n"]).join(paras)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for size, sep in ((200, r"\n\n+"), (120, r"\n+"), (2000, r"\n\n+")):
        got = {}
        for r in D.chunk_documents(df, size=size, separator=sep).collect():
            got.setdefault(r["doc_id"], []).append((r["chunk_index"], r["chunk"], r["n_chunks"]))
        for i, t in texts:
            exp = model_chunk(t, size, sep.replace(r"\n", "\n"))
            rows = sorted(got.get(i, []))
            assert [c for _, c, _ in rows] == exp
            assert all(n == len(exp) for _, _, n in rows)


TOKEN = re.compile("[a-z" + EMBED_EXTRA_LETTERS + "0-9]{2,}")


def model_embed(text, dim=128):
    """localEmbed, written plainly."""
    vec = [0.0] * dim
    for tok in TOKEN.findall(text.lower()):
        h = 0
        for ch in tok:
            h = (h * 31 + ord(ch)) % dim
        vec[h] += 1
        for a, b in zip(tok, tok[1:]):
            vec[(ord(a) * 31 + ord(b)) % dim] += 0.5
    n = math.sqrt(sum(v * v for v in vec))
    return [v / n for v in vec] if n > 0 else vec


def test_embedding_both_paths_match_model(spark):
    texts = ["Cơ sở dữ liệu và PostgreSQL database", "", "a b c", "Façade naïve Übung — 42 x9",
             "JWT auth tokens tokens tokens", "ĐƯỜNG phố 123abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    sql = {r["id"]: r["emb"] for r in with_embedding(df, "t", method="sql").collect()}
    vec = {r["id"]: r["emb"] for r in with_embedding(df, "t", method="vectorized").collect()}
    for i, t in enumerate(texts):
        exp = model_embed(t)
        assert max(abs(a - b) for a, b in zip(sql[i], exp)) < 1e-12
        assert max(abs(a - b) for a, b in zip(vec[i], exp)) < 1e-12


def test_resolve_levels(spark):
    names = spark.createDataFrame([("src1", 50), ("Life is Game", 10), ("Prodweaver", 5), ("CRM", 3)], "name string, cnt long")
    inc = spark.createDataFrame([("src1",), ("SRC1",), ("life-is-game",), ("Prodweave",), ("Crypto",), ("  ",),
                                 (" src1 ",), ("brandnew",)], "incoming string")
    got = {r["incoming"]: (r["resolved"], r["corrected"], r["strategy"]) for r in P.resolve(inc, names).collect()}
    assert got["src1"] == ("src1", False, "exact")
    assert got["SRC1"] == ("src1", True, "case-insensitive")
    assert got["life-is-game"] == ("Life is Game", True, "normalized")
    assert got["Prodweave"] == ("Prodweaver", True, "levenshtein")
    assert got["Crypto"] == ("Crypto", False, None)
    assert got["  "] == ("  ", False, None)
    assert got[" src1 "] == ("src1", False, "exact")
    assert got["brandnew"] == ("brandnew", False, None)


def test_resolve_ties_go_to_larger_project(spark):
    names = spark.createDataFrame([("srca", 1), ("srcb", 9)], "name string, cnt long")
    inc = spark.createDataFrame([("srcc",)], "incoming string")
    assert P.resolve(inc, names).first()["resolved"] == "srcb"


def test_chunk_summary_and_essence(spark):
    df = spark.createDataFrame([("/x/y/file.md", "p", "line one\nline two " + "z" * 200)], "path string, project string, content string")
    r = D.ingest_files(df, 1_700_000_000, size=2000, embed=False).first()
    assert r["summary_text"].endswith("...") and "\n" not in r["summary_text"]
    assert r["essence_text"].startswith("[file.md:1/1] line one line two")
    assert r["tags"] == ["document", "rag", "file.md"]
    assert F is not None


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        cur = [i] + [0] * len(b)
        for j in range(1, len(b) + 1):
            cur[j] = prev[j - 1] if a[i - 1] == b[j - 1] else 1 + min(prev[j], cur[j - 1], prev[j - 1])
        prev = cur
    return prev[len(b)]


def model_resolve(incoming, names):
    """resolveProjectName, names scanned by count desc then name."""
    t = incoming.strip(JS_WS)
    if not t:
        return incoming, False, None
    order = [n for n, _ in sorted(names, key=lambda x: (-x[1], x[0]))]
    if t in order:
        return t, False, "exact"
    for n in order:
        if n.lower() == t.lower():
            return n, True, "case-insensitive"
    norm = lambda x: re.sub(r"[-_.\s]+", "", x.lower())
    for n in order:
        if norm(n) == norm(t):
            return n, True, "normalized"
    best, bd = None, 10 ** 9
    for n in order:
        dd = _lev(t.lower(), n.lower())
        if dd < bd:
            best, bd = n, dd
    md = 1 if len(t) <= 4 else 2 if len(t) <= 10 else 3
    if 0 < bd <= md:
        return best, True, "levenshtein"
    return t, False, None


def test_resolve_matches_brute_force(spark):
    rnd = random.Random(11)
    alpha = "abcde"
    names = {}
    while len(names) < 60:
        names["".join(rnd.choice(alpha) for _ in range(rnd.randint(2, 14)))] = rnd.randint(1, 9)
    names = list(names.items())
    inc = set()
    for n, _ in names[:40]:
        s = list(n)
        for _ in range(rnd.randint(1, 4)):
            op = rnd.choice("ids")
            pos = rnd.randrange(len(s) + 1)
            if op == "i":
                s.insert(pos, rnd.choice(alpha))
            elif op == "d" and s and pos < len(s):
                del s[pos]
            elif s and pos < len(s):
                s[pos] = rnd.choice(alpha)
        inc.add("".join(s) or "a")
    inc |= {"".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 12))) for _ in range(40)}
    ndf = spark.createDataFrame(names, "name string, cnt long")
    idf = spark.createDataFrame([(x,) for x in sorted(inc)], "incoming string")
    got = {r["incoming"]: (r["resolved"], r["corrected"], r["strategy"]) for r in P.resolve(idf, ndf).collect()}
    for x in inc:
        assert got[x] == model_resolve(x, names), x


def test_document_folder_source(spark):
    from memlake.sources import files as FS
    from memlake.streaming.jobs import work_dir
    root = work_dir(spark, "unit-docs")
    rows = [("/a/one.MD", "first\n\nsecond"), ("/a/two.Txt", "two"), ("/b/three.markdown", "3"),
            ("/b/four.pdf", "%PDF"), ("/b/five", "no ext"), ("/six.md", "é ü ñ")]
    FS.write_text_files(spark.createDataFrame(rows, "path string, content string"), root)
    got = {r["path"]: r["content"] for r in FS.read_documents(spark, root).collect()}
    assert got == {"/a/one.MD": "first\n\nsecond", "/a/two.Txt": "two", "/b/three.markdown": "3", "/six.md": "é ü ñ"}
    rej = {r["path"]: r["reason"] for r in FS.document_rejects(spark, root).collect()}
    assert set(rej) == {"/b/four.pdf", "/b/five"}
    assert rej["/b/four.pdf"].startswith("Unsupported file type: .pdf")


def test_chunk_size_property(spark):
    """Every chunk fits the size unless it is one paragraph longer than the size."""
    rnd = random.Random(5)
    texts = [(i, "\n".join("x" * rnd.randint(1, 300) for _ in range(rnd.randint(1, 40)))) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for r in D.chunk_documents(df, size=250, separator=r"\n+").collect():
        c = r["chunk"]
        assert len(c) <= 250 or "\n" not in c
