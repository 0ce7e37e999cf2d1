"""Local hash-bucket text embedding as row-local SQL expressions.

Per text: lower-case; tokens are maximal runs (length >= 2) of a-z, the Vietnamese letters
and 0-9; each token adds 1 to bucket h = fold(h * 31 + code) mod 128 over its chars, and
each adjacent char pair (c1, c2) adds 0.5 to bucket (c1 * 31 + c2) mod 128; the vector is
L2-normalised (no tokens -> zero vector).

Everything runs inside one projection: bucket entries are built with higher-order
functions, sorted, and run-length folded into at most 128 (bucket, weight) pairs. No
explode, no shuffle - the work is embarrassingly parallel over rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.config import EMBED_DIM, EMBED_EXTRA_LETTERS

TOKEN_PATTERN = "[a-z" + EMBED_EXTRA_LETTERS + "0-9]{2,}"


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def embed_entries_sql(text_sql: str, dim: int = EMBED_DIM) -> str:
    """SQL for array<struct<b:int,w:double>>: unnormalised bucket weights, one per bucket."""
    toks = f"regexp_extract_all(lower({text_sql}), {_sql_str(TOKEN_PATTERN)}, 0)"
    codes = f"transform({toks}, t -> transform(split(t, ''), c -> ascii(c)))"
    entries = (
        f"flatten(transform({codes}, cs -> concat("
        f"array(named_struct('b', aggregate(cs, 0, (h, c) -> (h * 31 + c) % {dim}), 'w', 1.0D)), "
        f"transform(sequence(1, size(cs) - 1), i -> named_struct('b', (cs[i - 1] * 31 + cs[i]) % {dim}, 'w', 0.5D)))))"
    )
    # run-length fold over entries sorted by bucket -> one (b, w) per distinct bucket
    rle = (
        f"aggregate(sort_array({entries}), "
        f"named_struct('out', cast(array() as array<struct<b:int,w:double>>), 'b', -1, 'w', 0.0D), "
        f"(acc, e) -> if(e.b = acc.b, named_struct('out', acc.out, 'b', acc.b, 'w', acc.w + e.w), "
        f"named_struct('out', if(acc.b >= 0, array_append(acc.out, named_struct('b', acc.b, 'w', acc.w)), acc.out), "
        f"'b', e.b, 'w', e.w)), "
        f"acc -> if(acc.b >= 0, array_append(acc.out, named_struct('b', acc.b, 'w', acc.w)), acc.out))"
    )
    return rle


def memory_embed_text() -> Column:
    """Text a stored memory is embedded from: summary, essence and tags, space-joined."""
    return F.concat_ws(" ", "summary_text", "essence_text", F.array_join("tags", " "))


_LET_IDS = iter(range(1, 1 << 30))


def let(value_sql: str, body) -> str:
    """Bind an expression once: `body(v)` may use `v` many times (also inside lambdas)
    without the optimizer re-inlining the expression at every use."""
    v = f"v{next(_LET_IDS)}__"
    return f"element_at(transform(array({value_sql}), {v} -> {body(v)}), 1)"


def normalized_sql(raw_sql: str) -> str:
    """L2-normalised entries (zero-norm stays empty)."""
    return let(raw_sql, lambda r: let(f"sqrt(aggregate({r}, 0.0D, (a, e) -> a + e.w * e.w))",
                                      lambda n: f"transform({r}, e -> named_struct('b', e.b, 'w', e.w / {n}))"))


def dense_sql(sparse_sql: str, dim: int = EMBED_DIM, as_float: bool = True) -> str:
    """Dense array of size `dim` from sparse entries (one map built per row)."""
    cast = (lambda x: f"cast({x} as float)") if as_float else (lambda x: x)
    return let(f"map_from_entries(transform({sparse_sql}, e -> struct(e.b, e.w)))",
               lambda m: f"transform(sequence(0, {dim - 1}), i -> {cast(f'coalesce(element_at({m}, i), 0.0D)')})")


def with_embedding(df, text_col: str, out: str = "emb", keep_dense: bool = True, as_float: bool = False,
                   method: str = "vectorized"):
    """Add sparse normalised entries `<out>_sparse` and (optionally) dense `<out>`.

    method="vectorized" (default): Arrow-batched numpy kernel, one call per batch of rows.
    method="sql": the same definition as JVM higher-order functions. Both give identical
    vectors; at sf0.1 (55k chunks, 25M chars) the SQL form took 51 s and the vectorised
    one 9 s on local[8], because interpreted lambdas cost microseconds per character.
    """
    if method == "vectorized":
        df = with_embedding_vectorized(df, text_col, out, as_float)
        return df if keep_dense else df.drop(out)
    df = df.withColumn(f"{out}_sparse", F.expr(normalized_sql(embed_entries_sql(f"`{text_col}`"))))
    if keep_dense:
        df = df.withColumn(out, F.expr(dense_sql(f"`{out}_sparse`", as_float=as_float)))
    return df


# --- vectorised kernel (Arrow batches, numpy inside the task) -----------------------------

#: Characters that are embedded together, about.
EMBED_BATCH_CHARS = 1 << 19


def embed_batch_numpy(texts, dim: int = EMBED_DIM) -> np.ndarray:
    """Dense normalised vectors of many texts (same definition as embed_entries_sql): one code buffer, and one
    count over (text, bucket) for the tokens and one for their character pairs."""
    found = [_TOKEN_RE.findall(t.lower()) if t else [] for t in texts]
    toks = [t for f in found for t in f]
    n = len(found)
    if not toks:
        return np.zeros((n, dim))
    lens = np.fromiter(map(len, toks), dtype=np.int64, count=len(toks))
    owner = np.repeat(np.arange(n), [len(f) for f in found])
    codes = np.frombuffer("".join(toks).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    ends = np.cumsum(lens)
    starts = ends - lens
    # fold(h * 31 + c) over a token is the sum of c_k * 31^(L-1-k), taken modulo dim throughout
    powers = np.empty(int(lens.max()), np.int64)
    powers[0] = 1 % dim
    for j in range(1, len(powers)):
        powers[j] = powers[j - 1] * 31 % dim
    expo = np.repeat(ends, lens) - 1 - np.arange(codes.size)
    h = np.add.reduceat(codes % dim * powers[expo], starts) % dim
    out = np.bincount(owner * dim + h, minlength=n * dim).astype(np.float64)
    # adjacent pairs inside a token: drop the pair that starts at each token's last char
    pair_ok = np.ones(codes.size - 1, dtype=bool)
    pair_ok[(ends - 1)[:-1]] = False
    pairs = ((codes[:-1] * 31 + codes[1:]) % dim + np.repeat(owner, lens)[:-1] * dim)[pair_ok]
    out += 0.5 * np.bincount(pairs, minlength=n * dim)
    out = out.reshape(n, dim)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def embed_dense_numpy(text: str, dim: int = EMBED_DIM) -> np.ndarray:
    return embed_batch_numpy([text], dim)[0]


_TOKEN_RE = re.compile(TOKEN_PATTERN)


def embed_dense_udf(dim: int = EMBED_DIM):
    """pandas UDF: text -> dense array<double>(dim), a batch of texts at a time."""
    @F.pandas_udf("array<double>")
    def _embed(texts: pd.Series) -> pd.Series:
        out, held, size = [], [], 0
        for t in texts:
            held.append(t)
            size += len(t or "")
            if size >= EMBED_BATCH_CHARS:
                out.extend(embed_batch_numpy(held, dim))
                held, size = [], 0
        return pd.Series(out + list(embed_batch_numpy(held, dim)) if held else out)

    return _embed


def with_embedding_vectorized(df, text_col: str, out: str = "emb", as_float: bool = False, dim: int = EMBED_DIM):
    """Same columns as with_embedding, computed by the Arrow-batched numpy kernel."""
    df = df.withColumn(out, embed_dense_udf(dim)(F.col(text_col)))
    df = df.withColumn(f"{out}_sparse", F.expr(
        f"filter(transform(`{out}`, (x, i) -> named_struct('b', i, 'w', x)), e -> e.w <> 0.0D)"))
    if as_float:
        df = df.withColumn(out, F.col(out).cast("array<float>"))
    return df
