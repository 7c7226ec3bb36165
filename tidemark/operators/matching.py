"""Joins of texts on containment and on likeness, by keys that lose no match: no pair is formed without one.

Likeness here is 200 * LCS / (length a + length b), so strings alike at `least` differ in at most
d = (|a| + |b|) (100 - least) / 100 inserted and deleted characters. Cut into d + 1 pieces, one piece of `a` stands
unchanged in `b`, and not far from its place: its key is its number, both lengths and its letters, which meets the few
substrings of `b` that can be it, and only what meets is compared.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fuzzy
from tidemark.functions import text as tx


def _inner(words: Column) -> tuple[Column, Column]:
    """Number of inner words that make a key (three at most), and the key."""
    n = F.least(F.size(words) - 2, F.lit(3))
    return n, F.array_join(F.slice(words, 2, n), " ")


def _grams(words: Column, n: int) -> Column:
    """Distinct runs of n neighbours. The words are asked for once a place in a run, not once a run."""
    size = F.greatest(F.size(words) - n + 1, F.lit(0))
    out = F.slice(words, F.lit(1), size)
    for i in range(1, n):
        out = F.zip_with(out, F.slice(words, F.lit(i + 1), size), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(out)


def substrings(text: Column, n: int) -> Column:
    """Distinct substrings of n characters."""
    at = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(n))))


def contained(items: DataFrame, item: str, docs: DataFrame, text: str, key: str) -> DataFrame:
    """Rows of items joined with the rows of docs whose text contains the item, letter for letter.

    An item of three words or more is sought by its inner words, which stand whole in any text that contains it;
    a shorter one by its first three characters. Texts don't travel with their many keys: `key` names their rows
    (a repeated one names all its rows), and each text is joined back for the candidates it has. Empty and null items
    are contained in nothing.
    """
    words = F.split(item, " ")
    n, inner = _inner(words)
    short = F.least(F.length(item), F.lit(3))
    keyed = items.filter(F.length(item) > 0).withColumn("_kind", F.when(n >= 1, n).otherwise(-short)).withColumn("_key", F.when(n >= 1, inner).otherwise(F.substring(item, F.lit(1), short)))
    kinds = sorted(r[0] for r in keyed.select("_kind").distinct().collect())  # of -3 to 3
    if not kinds:
        return items.limit(0).crossJoin(docs.limit(0))
    def keys(k: int) -> Column:
        runs = _grams(F.split(text, " "), k) if k > 0 else substrings(F.col(text), -k)
        return F.transform(runs, lambda x: F.struct(F.lit(k).alias("_kind"), x.alias("_key")))

    found = docs.select(key, F.explode(F.concat(*map(keys, kinds))).alias("_k")).select(key, "_k.*")
    met = found.join(keyed, ["_kind", "_key"]).select(*items.columns, key).distinct()
    return met.join(docs, key).filter(F.contains(F.col(text), F.col(item))).select(*items.columns, *docs.columns)


def edits(length: int, least: float) -> int:
    """Characters that a string alike at `least` to one of that length may differ in."""
    return int(2 * length * (100 - least) / least + 1e-9)


def pieces(text: Column, least: float) -> Column:
    """The pieces of which one stands unchanged in every text that is alike."""
    n = F.floor(F.length(text) * (2 * (100 - least) / least) + 1e-9).cast("int") + 1
    cut = lambda i: F.floor(i * F.length(text) / n).cast("int")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, cut(i) + 1, cut(i + 1) - cut(i))))


def piece_lengths(least: float, lengths: Iterable[int]) -> list[int]:
    """Lengths that pieces of texts of these lengths have."""
    out = set()
    for n in lengths:
        k = edits(n, least) + 1
        out |= {n // k, -(-n // k)}
    return sorted(out)


#: From here on a piece has a character at least.
LEAST_LIKENESS = 70
#: Characters that two texts to compare may differ in: their keys grow with the square of it.
MOST_EDITS = 32


def _edits(n: Column, m: Column, least: float) -> Column:
    """Edits between texts of n and m characters alike at `least`; an error if they are too many to look for."""
    d = F.floor((n + m) * ((100 - least) / 100) + 1e-9).cast("int")
    return F.when(d > MOST_EDITS, F.raise_error(F.lit(f"texts that differ in over {MOST_EDITS} characters are too long for alike()")).cast("int")).otherwise(d)


def piece_keys(text: Column, least: float) -> Column:
    """Keys of the text's pieces, for each length that a text alike at `least` can have: struct(n, m, i, piece)."""
    n = F.length(text)

    def of(m: Column) -> Column:
        d = _edits(n, m, least)
        cut = lambda i: F.floor(i * n / (d + 1)).cast("int")
        piece = lambda i: F.struct(n.alias("n"), m.alias("m"), i.alias("i"), F.substring(text, cut(i) + 1, cut(i + 1) - cut(i)).alias("piece"))
        return F.transform(F.sequence(F.lit(0), d), piece)

    return F.flatten(F.transform(F.sequence(*_lengths(n, least)), of))


def stretch_keys(text: Column, least: float) -> Column:
    """The same keys of every substring of the text that a piece of a text alike to it can be.

    Of the pieces that stand unchanged, one has no more edits before it than its number and no more behind it than
    pieces follow, so it is shifted by no more either way.
    """
    m = F.length(text)

    def of(n: Column) -> Column:
        d = _edits(n, m, least)
        cut = lambda i: F.floor(i * n / (d + 1)).cast("int")

        def places(i: Column) -> Column:
            lo, hi = F.greatest(-i, m - n - (d - i), -cut(i)), F.least(i, m - n + (d - i), m - cut(i + 1))
            shifts = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
            return F.transform(shifts, lambda s: F.struct(n.alias("n"), m.alias("m"), i.alias("i"), F.substring(text, cut(i) + s + 1, cut(i + 1) - cut(i)).alias("piece")))

        return F.flatten(F.transform(F.sequence(F.lit(0), d), places))

    return F.flatten(F.transform(F.sequence(*_lengths(m, least)), of))


def _lengths(n: Column, least: float) -> tuple[Column, Column]:
    """Least and greatest length of a text alike at `least` to one of n characters."""
    return F.greatest(F.lit(1), F.ceil(n * (least / (200 - least)) - 1e-9).cast("int")), F.floor(n * ((200 - least) / least) + 1e-9).cast("int")


def meeting(x: DataFrame, y: DataFrame, least: float, score: str) -> DataFrame:
    """a, b: pairs of the texts a of x and b of y that share a key (by its hash), some more than once."""
    order = lambda c: F.col(c) if score == "ratio" else F.array_join(F.array_sort(F.array_distinct(F.split(c, " +"))), " ")
    hashed = lambda keys: F.transform(keys, lambda k: F.xxhash64(k["n"], k["m"], k["i"], k["piece"]))
    a = x.select("a", order("a").alias("t")).select("a", F.explode(hashed(piece_keys(F.col("t"), least))).alias("k"))
    b = y.select("b", order("b").alias("t")).select("b", F.explode(F.array_distinct(hashed(stretch_keys(F.col("t"), least)))).alias("k"))
    met = a.join(b, "k").select("a", "b")
    if score == "token_set":
        words = lambda df, c: df.select(c, F.explode(F.array_distinct(F.split(c, " +"))).alias("w"))
        met = met.unionByName(words(x, "a").join(words(y, "b"), "w").select("a", "b"))
    return met


def alike(left: DataFrame, a: str, right: DataFrame, b: str, least: float, score: str = "ratio") -> DataFrame:
    """Pairs (a, b, score) of the distinct texts of two tables that are alike at `least` (70 or more).

    score: `ratio`; or `token_set`, for which texts that share a token meet by it, and others by the pieces of
    their sorted tokens. Empty and null texts are alike to nothing. Pieces are short where texts may differ much: from
    85 on they have three letters or more. Texts that may differ in more than MOST_EDITS characters are an error.
    """
    if least < LEAST_LIKENESS:
        raise ValueError("texts less alike have no common piece")
    x, y = left.select(F.col(a).alias("a")).filter("a <> ''").distinct(), right.select(F.col(b).alias("b")).filter("b <> ''").distinct()
    f = {"ratio": fuzzy.ratio, "token_set": fuzzy.token_set_ratio}[score]
    met = meeting(x, y, least, score).distinct()
    return met.withColumn("score", fuzzy.column(f, F.col("a"), F.col("b"))).filter(F.col("score") >= least)


def token_jaccard(left: DataFrame, a: str, right: DataFrame, b: str, least: float) -> DataFrame:
    """Pairs (a, b, jaccard) of the distinct texts of two tables whose sets of content tokens are alike at `least` (over 0).

    Of sets that are alike, each has one of its rarest tokens in the other: all but as many as they must share, and
    one more. Texts without content tokens are alike to nothing.
    """
    x, y = left.select(F.col(a).alias("text")).distinct(), right.select(F.col(b).alias("text")).distinct()
    every = x.unionByName(y).distinct().select("text", F.array_distinct(tx.content_tokens(F.col("text"))).alias("tokens")).filter(F.size("tokens") > 0)
    each = every.select("text", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("often"))
    ranked = each.join(often, "token").groupBy("text", "n").agg(F.array_sort(F.collect_list(F.struct("often", "token")))["token"].alias("tokens"))
    ranked = ranked.withColumn("first", F.slice("tokens", F.lit(1), F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9).cast("int") + 1))
    side = lambda df, c: df.join(ranked, "text").select(F.col("text").alias(c), F.col("tokens").alias(f"tokens_{c}"), F.col("n").alias(f"n_{c}"), F.explode("first").alias("key"))
    met = side(x, "a").join(side(y, "b"), "key").filter(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least - 1e-9).drop("key").dropDuplicates(["a", "b"])
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return met.select("a", "b", (both / (F.col("n_a") + F.col("n_b") - both)).alias("jaccard")).filter(F.col("jaccard") >= least)


def holding(needles: DataFrame, needle: str, hays: DataFrame, hay: str, least: float) -> DataFrame:
    """Pairs (needle, hay, score) of the distinct texts of two tables where fuzzy.contains_ratio reaches `least` and the hay lacks no number of the needle."""
    x, y = needles.select(F.col(needle).alias("needle")).filter("needle <> ''").distinct(), hays.select(F.col(hay).alias("hay")).filter("hay <> ''").distinct()
    bare = tx.despace(F.col("needle"))
    keys = F.array_distinct(F.concat(F.transform(pieces(F.col("needle"), least), tx.despace), pieces(bare, least)))
    sizes = [r.n for r in x.select(F.explode(F.array(F.length("needle"), F.length(bare))).alias("n")).filter("n > 0").distinct().collect()]  # as many as there are lengths of needles
    longest = max(piece_lengths(least, sizes), default=0)
    lengths = range(1, longest + 1)  # white space is gone from some pieces
    parts = F.flatten(F.array(F.array().cast("array<string>"), *(substrings(tx.despace(F.col("hay")), n) for n in lengths)))
    met = x.select("needle", F.explode(keys).alias("k")).join(y.select("hay", F.explode(parts).alias("k")), "k").select("needle", "hay").distinct()
    met = met.filter(~tx.digits_missing(F.col("needle"), F.col("hay")))
    return met.withColumn("score", fuzzy.column(fuzzy.contains_ratio, F.col("needle"), F.col("hay")).cast("int")).filter(F.col("score") >= least)
