"""Spelling variants: words that one edit parts, found by their rarest bigrams, and the spelling that each goes by."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandbook.llm.common import checkpointed, either_way

#: Bigrams that a word is found by. One edit destroys at most two of a word's, so that one of any three is left in the other word.
PREFIX = 3
#: Places of the third bigram that are taken.
AGAIN = 5
#: Pieces of a word, one of which an edit falls into.
PIECES = 4


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, word): a row for each maximal run of the letters A-Z, a-z and U+00C0 to U+00FF in ``text``, with A-Z alone in lower case.

    Null texts have none. Rows that repeat count each; other columns are not read.
    """
    folded = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return docs.select("doc_id", F.explode(F.regexp_extract_all(folded, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("word"))


def counted(words: DataFrame, least_chars: int, least_n: int) -> DataFrame:
    """(word, n): words of at least ``least_chars`` code points that occur at least ``least_n`` times; summed before they are shuffled."""
    return words.filter(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


def rare_bigrams(words: DataFrame) -> DataFrame:
    """(word, n, chars, gram, pos): of each word its three rarest bigrams with their places.

    The global order is the frequency of the bigram wherever it stands, then the
    bigram: an edit moves what follows it by one place, and a bigram must keep its
    rank when it moves. Where the third one occurs again in the word, its first five
    places are taken: an edit makes at most two new bigrams, so that the one left of
    one word's three is among the first five of its kind in the other word.
    """
    letters = words.select("word", "n", F.length("word").alias("chars"), F.split("word", "").alias("letters"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chars") - 2), lambda i: F.concat(F.get("letters", i), F.get("letters", i + 1)))
    grams = letters.select("word", "n", "chars", F.posexplode(pairs).alias("pos", "gram"))
    often = checkpointed(grams.groupBy("gram").agg(F.count("*").alias("often")))
    ordered = grams.join(either_way(often), "gram").groupBy("word", "n", "chars").agg(F.sort_array(F.collect_list(F.struct("often", "gram", "pos"))).alias("ordered"))
    last, first = F.get("ordered", F.lit(PREFIX - 1)), F.slice("ordered", 1, PREFIX - 1 + AGAIN)
    rarer = F.size(F.filter(first, lambda g: F.struct(g["often"], g["gram"]) < F.struct(last["often"], last["gram"])))
    kept = F.filter(first, lambda g, i: (F.struct(g["often"], g["gram"]) <= F.struct(last["often"], last["gram"])) & (i < rarer + AGAIN))
    return ordered.select("word", "n", "chars", F.explode(kept).alias("g")).select("word", "n", "chars", "g.gram", "g.pos")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words that exactly one inserted, deleted or replaced code point parts, once.

    Words meet where they share one of their rarest bigrams at places that one edit
    explains: the same place, or, in the longer of two words, the next if the edit
    lies before. So that the list of a frequent bigram is no single group, it is
    split by what the edit leaves alone: it falls into one of four pieces (of the
    shorter word's length), and what stands before and behind that piece is the same
    in both. What meets is verified letter by letter, the piece by its edit distance.
    """
    held = checkpointed(rare_bigrams(words))

    def span(shorter: Column, piece: Column | int) -> tuple[Column, Column]:
        """Where a piece begins and ends, from 0."""
        piece = F.lit(piece) if isinstance(piece, int) else piece
        return F.floor(shorter * piece / PIECES).cast("int"), F.floor(shorter * (piece + 1) / PIECES).cast("int")

    def keys(longer: bool) -> DataFrame:
        """A row for each list that a word is in, as the shorter (or an equally long) word of a pair or as the longer one."""
        shorter, out = F.col("chars") - int(longer), []
        for piece in range(PIECES):
            begin, end = span(shorter, piece)
            sides = F.substring("word", F.lit(1), begin), F.substring("word", end + 1 + int(longer), shorter - end)
            row = lambda place, p=piece, own=sides: F.struct(F.xxhash64("gram", shorter, place, F.lit(p), *own).alias("key"), F.lit(p).alias("piece"))  # noqa: B023, E731
            if longer:  # a bigram that stands before the piece has not moved, one behind it has
                out += [F.when(F.col("pos") <= end, row(F.col("pos"))), F.when(F.col("pos") + 2 > begin, row(F.col("pos") - 1))]
            else:
                out.append(row(F.col("pos")))
        return held.select("word", "n", F.explode(F.array_compact(F.array(*out))).alias("k")).select("k.key", "k.piece", "word", "n", F.lit(int(longer)).alias("more"))

    short = keys(False)
    other = short.unionByName(keys(True))
    a, b, more = F.col("a"), F.col("b"), F.col("more")
    met = short.select("key", F.col("piece"), F.col("word").alias("a"), F.col("n").alias("a_n")).join(other.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "more"), "key")
    begin, end = span(F.length(a), F.col("piece"))
    same = (F.substring(a, F.lit(1), begin) == F.substring(b, F.lit(1), begin)) & (F.substring(a, end + 1, F.length(a)) == F.substring(b, end + 1 + more, F.length(b)))
    edited = F.levenshtein(F.substring(a, begin + 1, end - begin), F.substring(b, begin + 1, end - begin + more)) == 1
    fits = ((more == 1) & (F.length(b) == F.length(a) + 1)) | ((more == 0) & (F.length(b) == F.length(a)) & (a < b))
    return met.filter(fits & same & edited).select("a", "a_n", "b", "b_n").distinct()


def with_roots(formed: DataFrame, rounds: int) -> DataFrame:
    """(word, root): the end of each word's chain of forms; the part of a chain that is known doubles with each round."""
    links = checkpointed(formed.filter("form is not null").select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = checkpointed(links.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return links


def variants(words: DataFrame, least_chars: int = 6, least_n: int = 5, ratio: int = 5) -> DataFrame:
    """What each word of ``words`` (word, a row for each occurrence) is a variant of: ``word, form, root, n, n_near, form_n``.

    Words are the distinct ones of at least ``least_chars`` code points that occur
    ``least_n`` times or more. ``n_near`` counts the words that one edit parts from
    it; ``form`` is the most frequent of these (ties: the smallest in code-point
    order), if it is at least ``ratio`` times as frequent as the word, else null, as
    is its frequency ``form_n``. ``root`` follows the forms to the last, which is the
    word itself where there is no form. As frequencies grow by ``ratio`` with each
    step, chains are short and have no circles.

    Null words count for nothing. Empty tables give no rows; other columns are not read.
    """
    if least_chars < PREFIX + 1 or ratio < 2:
        raise ValueError("words need at least 4 code points, and forms at least twice the frequency")
    known = checkpointed(counted(words, least_chars, least_n))
    pairs = near_pairs(known)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    wins = F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False))
    formed = checkpointed(known.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(wins, F.col("best.near")).alias("form"), F.when(wins, -F.col("best.less")).alias("form_n")))
    most = known.agg(F.max("n")).first()[0] or least_n
    steps = max(1, math.ceil(math.log(max(most / max(least_n, 1), 1), ratio)) + 1)
    roots = with_roots(formed, math.ceil(math.log2(steps)))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
