"""Grouping of spelling variants: a rare-first prefix filter over positional bigrams.

Words are counted in Arrow batches (a batch sends one row a distinct word).  Two words are
near if they differ by one inserted, deleted or replaced code point.  One such edit destroys
at most two bigrams of either word, so of the three bigrams of a word that come first in one
global order (rarest first, then by the bigram, then by position) at least one is among the
first three of every near word, as the same bigram at the same place or, in the longer word,
one place further.  That holds with repeated bigrams too: were the match pushed out of the
other word's three, the three would hold the same bigram at the same place.  So only three
bigrams a word are joined, on (bigram, position, length); candidates are verified inside the
join, and pairs are never written before they are verified.

Order by frequency means the number of words of the vocabulary that hold the bigram; equal
numbers are told apart by the bigram, so all words use one order.

Hot keys: words are combined before the shuffle; joins on bigrams, and on forms that many
variants share, spread hot keys over tasks (``skew.spread_join``).

Defined results: null and empty texts hold no words; texts are read whole; ids enter as the
text of the number (null: empty); repeated rows count each; ties of frequency go to the word
first in code-point order; an empty vocabulary gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.scratch import Scratch
from marketloom.llm.skew import spread_join

PREFIX = 3  # one edit destroys two bigrams at most
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_FLUSH = 200_000  # distinct words a task holds


def count_words(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int | None = 199, least_length: int = 6) -> DataFrame:
    """(word, n): occurrences of the runs of letters, A-Z lowered, of at least ``least_length`` code points.

    With ``noise``, a run whose crc32 of ``<id>:<run>`` is divisible by it loses one code point.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = re.compile("[a-zÀ-ÿ]+")
        counts: Counter[str] = Counter()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                data = text.as_py()
                if not data:
                    continue
                found = Counter(letters.findall(data.encode().translate(_LOWER).decode()))
                if noise is None:
                    counts.update({w: n for w, n in found.items() if len(w) >= least_length})
                    continue
                start = zlib.crc32(f"{doc.as_py() or ''}:".encode())
                for word, n in found.items():
                    if len(word) < least_length:
                        continue  # a deletion only shortens it
                    h = zlib.crc32(word.encode(), start)
                    if h % noise == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    counts[word] += n
            if len(counts) >= _FLUSH:
                yield made()
                counts.clear()
        if counts:
            yield made()

    rows = documents.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _bigrams(word: Column) -> Column:
    """Structs (gram, pos) of a word of at least two code points."""
    return F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.struct(F.substring(word, i, F.lit(2)).alias("gram"), i.alias("pos")))


def prefixes(words: DataFrame) -> DataFrame:
    """(word, length, gram, pos): the first ``PREFIX`` bigrams of each word in the global order."""
    grams = words.select("word", F.length("word").alias("length"), F.inline(_bigrams(F.col("word"))))
    frequency = grams.groupBy("gram").agg(F.count_distinct("word").alias("words"))  # at most one row for two letters
    ranked = spread_join(grams, frequency, "gram", counts=frequency.withColumnRenamed("words", "n"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("words", "gram", "pos"))), 1, PREFIX)
    return ranked.groupBy("word", "length").agg(first.alias("first")).select("word", "length", F.inline("first")).drop("words")


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, near), both ways: all pairs of ``words`` (distinct, of at least four code points) one edit apart."""
    first = scratch.save(prefixes(words), "prefixes")
    # the shorter word of a pair asks: the same place at its own length, the same and the next one at a length more
    at = lambda step, more: F.struct((F.col("pos") + step).alias("pos"), (F.col("length") + more).alias("length"))
    asked = first.select(F.col("word").alias("short"), F.col("length").alias("own"), "gram", F.inline(F.array(at(0, 0), at(0, 1), at(1, 1))))
    met = spread_join(asked, first, ["gram", "pos", "length"])
    ordered = (F.col("own") < F.col("length")) | (F.col("short") < F.col("word"))
    linked = met.filter(ordered & (F.levenshtein("short", "word", 1) == 1)).select("short", "word").distinct()
    linked = scratch.save(linked, "links")
    return linked.select("word", F.col("short").alias("near")).union(linked.select(F.col("short").alias("word"), F.col("word").alias("near")))


def group_variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n, root for each word of ``words`` (word, n).

    The form is the near word of largest n, if that is at least ``factor`` times the word's
    own; the root is the last of a chain of forms, which grow by ``factor`` and so are few.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.save(words.select("word", "n"), "words")
    near = near_words(words, scratch)
    of = spread_join(near, words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = of.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    taken = -F.col("best.minus") >= factor * F.col("n")
    named = scratch.save(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.minus")).alias("form_n")), "forms")
    forms = named.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("at"))
    done, r = None, 0
    while not forms.isEmpty():  # each round follows twice as many forms
        r += 1
        further = forms.select(F.col("word").alias("at"), F.col("at").alias("further"))
        moved = spread_join(forms, further, "at", "left")
        forms = scratch.save(moved.select("word", F.coalesce("further", "at").alias("at"), F.col("further").isNotNull().alias("moved")), f"roots-{r}")
        if forms.filter("moved").isEmpty():
            done = forms
            break
        forms = forms.drop("moved")
    out = named if done is None else named.join(done.select("word", F.col("at").alias("last")), "word", "left")
    root = F.col("word") if done is None else F.coalesce("last", "word")
    return out.select("word", "form", root.alias("root"), "n", "n_near", "form_n")
