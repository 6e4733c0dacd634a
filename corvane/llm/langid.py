"""Language identification as a mixture: each document's language shares by expectation-maximisation.

A language is a distribution over character trigrams, hashed to 2**BITS; letters are in lower case, everything else is one
blank, and trigrams have a letter in the middle. The counts come from all labelled documents outside the held-out fold and
are combined in each task; the model is 2**BITS numbers for each language, of which there are MOST_LANGUAGES at most.

Of a document, EM over all languages gives shares, until no share moves by more than TOLERANCE. Then sets of the languages with the largest shares are compared by
penalised likelihood, each with shares of its own: a further language must raise the log-likelihood by PENALTY times the log of
the number of trigrams. The predicted language is that with the largest share in the best set.

Cases. A text that is null or has no letter is `und`, with score 0; so is every text if nothing can be learned. Rows without
a language or id teach nothing; rows that repeat an id teach, and are identified, each. Equal shares go to the first language in
order. A very long text is taken in blocks of characters. Extra columns are ignored or kept, by the function. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import held_out, staged

BITS, SMOOTHING, MOST_LANGUAGES = 16, 0.1, 128
LEAST_SHARE, PENALTY = 0.02, 4.0
#: EM ends where no share moves further; its steps are bounded in case two languages are alike.
TOLERANCE, STEPS = 1e-4, 1000
UNKNOWN = "und"
TOO_MANY = f"more than {MOST_LANGUAGES} languages; the model is sent whole"
#: Characters taken at once.
BLOCK = 1 << 20


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """For each code point its letter in lower case, or 0."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()
            out[cp] = ord(low[0]) if len(low) == 1 else cp
    return out


def trigrams(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct hashed trigrams, in order, and their counts; None if there is no letter."""
    found, text = [], text or ""
    counts = np.zeros(1 << bits, np.int64) if len(text) >= 1 << (bits - 2) else None
    for at in range(0, len(text), BLOCK):
        part = text[max(0, at - 1) : at + BLOCK + 1]
        c = folded()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
        c = np.concatenate(([np.uint32(0)] if at == 0 else [], c, [np.uint32(0)] if at + BLOCK >= len(text) else [])).astype(np.uint32)
        inner = c[1:-1] != 0
        if not inner.any():
            continue
        x = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
        x = ((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits)
        if counts is None:
            found.append(x[inner])
        else:
            counts += np.bincount(x[inner], minlength=1 << bits)
    if counts is None:
        return np.unique(np.concatenate(found), return_counts=True) if found else None
    at = np.flatnonzero(counts)
    return (at, counts[at]) if len(at) else None


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and the probability of each trigram (rows) in each of them (columns)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(1 << BITS, np.int64))
        for b in batches:
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                c = trigrams(t.as_py())
                if c is not None:
                    found[lang][c[0]] += c[1]
                    if len(found) > MOST_LANGUAGES:
                        raise ValueError(TOO_MANY)
        for lang, c in found.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at])], ["lang", "gram", "n"])

    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    taught = slim.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    grams = staged(taught.mapInArrow(count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    langs = sorted(r["lang"] for r in grams.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(TOO_MANY)
    n = np.full((1 << BITS, len(langs)), SMOOTHING)
    if langs:
        numbered = grams.select(F.col("gram"), (F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1).cast("int").alias("lang"), "n").toPandas()
        n[numbered["gram"].to_numpy(np.int64), numbered["lang"].to_numpy(np.int64)] += numbered["n"].to_numpy(float)
    return langs, n / n.sum(axis=0) if len(langs) else n


def shares(p: np.ndarray, c: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Mixture shares by EM from equal ones, and the log-likelihood. p: probability by trigram and language; c: counts."""
    theta, total = np.full(p.shape[1], 1 / p.shape[1]), c.sum()
    if p.shape[1] > 1:
        for _ in range(steps):
            last, theta = theta, theta * ((c / (p @ theta)) @ p) / total
            if np.abs(theta - last).max() <= TOLERANCE:
                break
    return theta, float(c @ np.log(p @ theta))


def languages_of(text: str | None, p: np.ndarray) -> list[tuple[int, float]]:
    """(language, share) of the chosen set, largest share first; empty if unknown."""
    counts = trigrams(text) if p.shape[1] else None
    if counts is None:
        return []
    c, q = counts[1].astype(float), p[counts[0]]
    all_shares, _ = shares(q, c)
    order = np.argsort(-all_shares, kind="stable")
    best, best_value = [], -np.inf
    for k in range(1, len(order) + 1):
        if k > 1 and all_shares[order[k - 1]] < LEAST_SHARE:
            break
        theta, value = shares(q[:, order[:k]], c)
        value -= PENALTY * (k - 1) * np.log(c.sum() + 1)
        if value <= best_value:
            break
        # Alone, a language has what EM over all of them gives it.
        best, best_value = [(int(i), float(x)) for i, x in zip(order, theta if k > 1 else all_shares[order[:1]], strict=False)], value
    return sorted(best, key=lambda x: (-x[1], x[0]))


def identified(df: DataFrame, learned: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """`doc`: the row of df as a struct, whatever its columns are named, lang_pred, score, languages, shares."""
    sent = df.sparkSession.sparkContext.broadcast(learned)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, p = sent.value
        for b in batches:
            found = [languages_of(t.as_py(), p) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc"),
                    pa.array([langs[f[0][0]] if f else UNKNOWN for f in found], pa.string()),
                    pa.array([min(1.0, f[0][1]) if f else 0.0 for f in found], pa.float64()),
                    pa.array([[langs[i] for i, _ in f] for f in found], pa.list_(pa.string())),
                    pa.array([[x for _, x in f] for f in found], pa.list_(pa.float64())),
                ],
                ["doc", "lang_pred", "score", "languages", "shares"],
            )

    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("doc"), df[text_col].alias("text"))
    return rows.mapInArrow(each, f"doc {rows.schema['doc'].dataType.simpleString()}, lang_pred string, score double, languages array<string>, shares array<double>")


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages, shares for each row of df."""
    out = identified(df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")), learn(df, id_col, text_col, lang_col))
    return out.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score", "languages", "shares")


def with_language(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """df without the rows whose language is unknown; all its columns as they were."""
    return identified(df, learn(df, id_col, text_col, lang_col), text_col).filter(F.col("lang_pred") != UNKNOWN).select("doc.*")
