"""Token counts with a whole-token shortcut.

Offline, the vocabulary of a sentencepiece model is searched once: if no piece holds a space
mark behind another character, no merge crosses from a word into the next one, so a text may
be cut before each run of space marks and the parts counted alone; the same holds around a
line feed that occurs in no piece. Every vocabulary string that the library encodes alone as
one token goes into a table. Counting then looks pre-tokens up in that table and gives only
the rest to the library's merges, remembering their counts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded_batches, table

MARK = "▁"
PRETOKENS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
REMEMBERED = 500_000  # counts of merged pre-tokens a task keeps; it starts anew beyond


def whole_tokens(model_file: str) -> list[str] | None:
    """Pre-tokens that encode alone as one token, or None where the model does not allow
    cuts (a piece crosses a cut, line feeds or spaces are not kept as they are)."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    crosses = any(re.search(f"[^{MARK}]{MARK}", p) or "\n" in p for p in pieces)
    kept = ([len(sp.encode(t)) for t in ("\n", "\n\n", "a ", "a")] ==
            [2, 3, len(sp.encode("a")) + 1, len(sp.encode("a"))]) and sp.encode("  a") != sp.encode(" a")
    if crosses or not kept:
        return None
    marked, bare = [p for p in pieces if p.startswith(MARK) and p != MARK], [p for p in pieces if not p.startswith(MARK)]
    return ([MARK] + [p for p, ids in zip(marked, sp.encode([p[1:] for p in marked]), strict=True) if len(ids) == 1]
            + [p for p, ids in zip(bare, sp.encode(["\n" + p for p in bare]), strict=True) if len(ids) == 3])


def counter(model_file: str, whole: list[str] | None):
    """Function from a text to its number of tokens; None counts as empty."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    if whole is None:
        return lambda text: len(sp.encode(text)) if text else 0
    ones = dict.fromkeys(whole, 1)
    known = dict(ones)

    def count(text: str | None) -> int:
        nonlocal known
        if not text:
            return 0
        found = PRETOKENS.findall(MARK + text.replace(" ", MARK))
        rest = list({w for w in found if w not in known})
        if rest:
            if len(known) > len(ones) + REMEMBERED:
                known = dict(ones)
                rest = list({w for w in found if w not in known})
            # a line feed before a bare pre-token adds the mark and the line feed: two tokens
            ids = sp.encode([w[1:] if w[0] == MARK else "\n" + w for w in rest], num_threads=1)
            known.update((w, len(i) - 2 * (w[0] != MARK)) for w, i in zip(rest, ids, strict=True))
        return sum(map(known.__getitem__, found)) + text.count("\n")
    return count


def count_tokens(docs: DataFrame, model_file: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` with a long column ``into``: the number of tokens of the whole text, as the
    library counts it without begin, end or special tokens. Null and empty texts count 0.
    An existing column of that name is replaced; repeated rows stay; no row, no result."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(whole_tokens(model_file))  # at most the vocabulary

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(model_file, shared.value)
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")
    return docs.withColumn(into, tokens(F.col(text)))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return (count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
            .select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens",
                    (F.col("n_tokens") > 4096).alias("over_limit")))
