"""Ranked search over several fields with typos, for many queries at once.

``build`` writes an index to the shared folder: postings (term, field, id, tf, dl), the vocabulary with the number of rows a term
has in each field, and for each term the keys of its thirds, by which terms within two edits of a word are found
without comparing all. ``rank`` weighs the terms first, joins them with the postings once, and deals what is found by row: all that follows is
added up where the row lies.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import words
from tidewell.session import Scratch

#: Words of a query that count, from which length typos are allowed, how many, and what a row with all words in one field gains.
MOST_WORDS, FUZZY_LENGTH, EDITS, ALL_WORDS = 16, 6, 2, 3.0
#: Rows up to which terms or words asked for are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Pairs of a row and a query that a task adds up.
PAIRS = 1_000_000
#: BM25.
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Field:
    """A field's words, its boost, and whether it takes no typos (names of places)."""

    words: Column
    boost: float
    exact: bool = False


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    vocabulary: DataFrame
    neighbours: DataFrame
    fields: dict[str, tuple[float, bool]]
    rows: int
    lengths: dict[str, float]


def _keys(word: Column, asking: bool) -> Column:
    """What a term and a word within two edits of it, of the same first letter, have in common. Two edits leave one of the three parts of the term's letters
    after the first as it is; in the word it stands up to two places off."""
    rest, n = F.substr(word, F.lit(2)), F.length(word) - 1
    keys = []
    for d in range(-EDITS, EDITS + 1) if asking else (0,):
        length = n + d
        for i in range(3):
            start, end = F.floor(length * i / 3).cast("int"), F.floor(length * (i + 1) / 3).cast("int")
            for shift in range(-EDITS, EDITS + 1) if asking else (0,):
                at = start + shift
                part = F.concat_ws("|", F.left(word, F.lit(1)), length.cast("string"), F.lit(str(i)), F.substr(rest, at + 1, end - start))
                keys.append(F.when((length > 0) & (at >= 0) & (at + end - start <= n), part))
    return F.array_distinct(F.array_compact(F.array(*keys)))


def build(rows: DataFrame, id_column: str, fields: dict[str, Field], scratch: Scratch) -> Index:
    """The index of ``rows``; an id is a row. Null fields have no words."""
    none = F.array().cast("array<string>")
    each = F.array(*[F.struct(F.lit(name).alias("field"), F.coalesce(f.words, none).alias("words")) for name, f in fields.items()])
    # Counts of a row's words need no more than the row: rows are dealt by id, and what comes of them stays there.
    dealt = rows.select(F.col(id_column).alias("id"), each.alias("each")).repartition("id")
    flat = dealt.select("id", F.explode("each").alias("f")).select("id", "f.field", F.size("f.words").alias("dl"), F.explode("f.words").alias("term"))
    postings = flat.groupBy("term", "field", "id", "dl").agg(F.count("*").alias("tf"))
    postings = scratch.put(postings, "postings")
    vocabulary = scratch.put(postings.groupBy("term", "field").agg(F.count("*").alias("df")), "vocabulary")
    terms = vocabulary.where(F.length("term") >= FUZZY_LENGTH - EDITS).select("term").distinct()
    neighbours = scratch.put(terms.select("term", F.explode(_keys(F.col("term"), False)).alias("key")), "neighbours")
    sizes = rows.agg(F.count("*").alias("n"), *[F.avg(F.size(F.coalesce(f.words, none)).cast("double")).alias(name) for name, f in fields.items()]).first()
    lengths = {name: float(sizes[name] or 0.0) for name in fields}
    return Index(postings, vocabulary, neighbours, {n: (f.boost, f.exact) for n, f in fields.items()}, int(sizes["n"]), lengths)


def asked_words(asked: DataFrame) -> DataFrame:
    """(query, need, token): the words of each query (query, text) that count, and how many they are."""
    tokens = F.slice(F.array_distinct(words(F.col("text"))), 1, MOST_WORDS)
    return asked.select("query", tokens.alias("t")).select("query", F.size("t").alias("need"), F.explode("t").alias("token"))


def variants(index: Index, tokens: DataFrame) -> DataFrame:
    """(token, term, edits, factor): the terms of the vocabulary that stand for each of ``tokens`` (token, distinct)."""
    exact = tokens.join(index.vocabulary.select(F.col("term").alias("token")).distinct(), "token", "left_semi")
    exact = exact.select("token", F.col("token").alias("term"), F.lit(0).alias("edits"))
    loose = tokens.select("token").where(F.length("token") >= FUZZY_LENGTH)
    met = loose.select("token", F.explode(_keys(F.col("token"), True)).alias("key")).join(index.neighbours, "key").select("token", "term")
    met = met.where("term <> token").distinct().withColumn("edits", F.levenshtein("token", "term", EDITS)).where("edits >= 0")
    return exact.unionByName(met).withColumn("factor", 1 - F.col("edits") / F.least(F.length("token"), F.length("term")))


def expand(index: Index, asked: DataFrame, scratch: Scratch) -> DataFrame:
    """(query, need, token, term, edits, factor): the terms of the vocabulary that stand for each word; ``asked``: (query, text)."""
    flat = scratch.put(asked_words(asked), "tokens")
    return scratch.put(flat.join(variants(index, flat.select("token").distinct()), "token"), "expanded")


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def rank(index: Index, asked: DataFrame, scratch: Scratch, share: float = 1.0, most: int = 50_000) -> DataFrame:
    """(query, rank, id, score) of at most ``most`` rows a query, the best first, ties to the smaller id.

    Of a query's text the first 16 distinct words count. A row must hold at least ``share`` of them in some field: the word itself, or, for words of
    six letters or more and in fields that take typos, a word of the same first letter within two edits (insertions, deletions, changes). A word is worth
    its best field: boost x BM25 x (1 - edits / length). A row with all words, unchanged, in one field gains three times that field's sum.
    Queries without words, or with too many unknown ones, have no rows.

    A row's words are told by number, whatever queries ask for them, before they meet the queries; what is shuffled grows with the postings of
    the words asked for, not with the queries."""
    flat = scratch.put(asked_words(asked), "tokens")
    tokens = scratch.put(flat.select("token").distinct().withColumn("word", F.monotonically_increasing_id()), "words")
    boosts = F.create_map(*[F.lit(x) for n, (b, _) in index.fields.items() for x in (n, b)])
    lengths = F.create_map(*[F.lit(x) for n, v in index.lengths.items() for x in (n, v)])
    open_fields = [n for n, (_, exact) in index.fields.items() if not exact]
    weighed = variants(index, tokens.select("token")).join(tokens, "token").join(index.vocabulary, "term")
    weighed = weighed.where((F.col("edits") == 0) | F.col("field").isin(open_fields))
    idf = F.log(1 + (index.rows - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.element_at(boosts, F.col("field")) * F.col("factor") * idf
    weighed = scratch.put(weighed.select("term", "field", "word", (F.col("edits") == 0).alias("exact"), weight.alias("weight")), "weighed")
    norm = K1 * (1 - B + B * F.col("dl") / F.element_at(lengths, F.col("field")))
    worth = F.col("weight") * (F.col("tf") * (K1 + 1) / (F.col("tf") + norm))
    met = index.postings.join(_small(weighed), ["term", "field"]).select("id", "word", "field", "exact", worth.alias("worth"))
    queries = flat.select("query").distinct().count()
    parts = max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), -(-index.rows * queries // PAIRS))
    whole = [F.max(F.when(F.col("exact") & (F.col("field") == n), F.col("worth"))).alias(f"whole{i}") for i, n in enumerate(index.fields)]
    by_word = met.repartition(parts, "id").groupBy("id", "word").agg(F.max("worth").alias("best"), *whole)
    wanted = scratch.put(flat.join(tokens, "token").select("query", "need", "word"), "wanted")
    sums = [x for i in range(len(whole)) for x in (F.count(f"whole{i}").alias(f"n{i}"), F.sum(f"whole{i}").alias(f"sum{i}"))]
    found = by_word.join(_small(wanted), "word").groupBy("id", "query", "need").agg(F.count("*").alias("n"), F.sum("best").alias("sum"), *sums)
    bonus = F.greatest(F.lit(0.0), *[F.when(F.col(f"n{i}") == F.col("need"), F.col(f"sum{i}")) for i in range(len(whole))])
    found = found.where(F.col("n") >= F.ceil(F.col("need") * share - F.lit(1e-9)))
    score = F.floor((F.col("sum") + ALL_WORDS * bonus) * 10000 + 0.5) / 10000
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.select("query", "id", score.alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query", "rank", "id", "score")
