"""Text aggregates: word count (AGG1-3) and token statistics (FEA4-5).

Words are produced by built-in split expressions and one ``explode``;
counting is ``groupBy(word).count()``, which combines map-side, so a word
holding a third of all occurrences still sends one row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilowatt.functions.text import java_tokens, lines, words


def word_count(df: DataFrame, text: str = "value", multiline_text: bool = False) -> DataFrame:
    """(word, count) over all lines. ``multiline_text``: the column holds
    whole texts with line breaks (documents), not single lines."""
    if multiline_text:
        # lines first, then words: two plain explodes keep the split
        # expressions in generated code (a lambda over the lines would not)
        df, text = df.select(F.explode(lines(text)).alias("__line")), "__line"
    return df.select(F.explode(words(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def terms_with_bigrams(tokens) -> "Column":
    """Tokens plus adjacent pairs joined by one space (two-word phrases)."""
    n = F.size(tokens)
    pairs = F.when(
        n > 1,
        F.zip_with(F.slice(tokens, 1, n - 1), F.slice(tokens, 2, n - 1), lambda a, b: F.concat_ws(" ", a, b)),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(tokens, pairs)


def term_rows(df: DataFrame, group: str, text: str = "text") -> DataFrame:
    """(group, __term): every occurrence of a word or two-word phrase, the rows
    that :func:`terms_with_bigrams` explodes to. The tokens are a column of their
    own, so a text is split once, and no lambda runs over them."""
    tokens = df.select(group, java_tokens(text).alias("__tokens"))
    after = F.slice("__tokens", 2, F.greatest(F.size("__tokens"), F.lit(1)))
    pairs = tokens.select(group, F.explode(F.arrays_zip(F.col("__tokens").alias("word"), after.alias("next"))).alias("__pair"))
    word, following = F.col("__pair.word"), F.col("__pair.next")
    phrase = F.array(word, F.concat_ws(" ", word, following))
    return pairs.select(group, F.explode(F.when(following.isNotNull(), phrase).otherwise(F.array(word))).alias("__term"))


def counted_terms(df: DataFrame, group: str, text: str = "text") -> DataFrame:
    """(group, __term, __n): occurrences of words and two-word phrases (the
    rows of :func:`term_rows`), counted within each Arrow batch. A term may come
    once per batch, so sum them; no state and no shuffle, so a stream may use it
    before its one aggregation. A text is split once, and a phrase is a pair of
    numbers until it is counted."""
    tokens = df.select(group, java_tokens(text).alias("__tokens")).where(F.size("__tokens") > 0)
    kind = df.schema[group].dataType.simpleString()
    return tokens.mapInArrow(_counted, f"`{group}` {kind}, __term string, __n long")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        names = [batch.schema.field(0).name, "__term", "__n"]
        groups = batch.column(0).dictionary_encode(null_encoding="encode")
        lengths = np.diff(batch.column(1).offsets.to_numpy())
        words = batch.column(1).flatten().dictionary_encode()
        code, known = words.indices.to_numpy().astype(np.int64), words.dictionary
        doc = np.repeat(np.arange(len(lengths)), lengths)
        group = groups.indices.to_numpy()[doc].astype(np.int64)
        adjacent = doc[1:] == doc[:-1]
        pair = code[:-1][adjacent] * len(known) + code[1:][adjacent]
        for owner, term, phrase in ((group, code, False), (group[1:][adjacent], pair, True)):
            if not len(term):
                continue
            order = np.lexsort((term, owner))
            owner, term = owner[order], term[order]
            first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])))
            n, owner, term = np.diff(np.append(first, len(term))), owner[first], term[first]
            if phrase:
                texts = pc.binary_join_element_wise(known.take(pa.array(term // len(known))), known.take(pa.array(term % len(known))), " ")
            else:
                texts = known.take(pa.array(term))
            yield pa.RecordBatch.from_arrays([groups.dictionary.take(pa.array(owner)), texts, pa.array(n, pa.int64())], names=names)


def lexicon_totals(
    df: DataFrame, lexicon: DataFrame, group: str, text: str = "text", term: str = "term", score: str = "score",
) -> DataFrame:
    """(group, n_docs, total_score, n_hits): lexicon scores of the words and
    two-word phrases of each group's texts, one row per group.

    Texts are tokenized once (lower-case, whitespace), and occurrences are
    counted per (group, term) before the join, so what is shuffled is one row
    per (group, term) and task, however often a word occurs, and a common word
    meets the lexicon once per group. Rows with a null text are documents
    without a hit.
    """
    counted = term_rows(df, group, text).groupBy(group, "__term").agg(F.count(F.lit(1)).alias("__n"))
    lex = lexicon.select(F.col(term).alias("__term"), F.col(score).cast("long").alias("__score"))
    hits = counted.join(lex, "__term").select(
        group, F.lit(0).cast("long").alias("__doc"), (F.col("__score") * F.col("__n")).alias("__score"), F.col("__n").alias("__hit"))
    docs = df.select(group, F.lit(1).cast("long").alias("__doc"), F.lit(0).cast("long").alias("__score"), F.lit(0).cast("long").alias("__hit"))
    return hits.unionByName(docs).groupBy(group).agg(
        F.sum("__doc").alias("n_docs"), F.sum("__score").alias("total_score"), F.sum("__hit").alias("n_hits"))
