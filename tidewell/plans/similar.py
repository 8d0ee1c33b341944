"""Near hashes, pair similarity, clone scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.text import words
from tidewell.operators.nearhash import linked_rows, near_pairs, prefix_pairs
from tidewell.plans.registry import query
from tidewell.session import load


_HALF = "('0x' || substr({0}.h, {1}, 8))::BIGINT"
_BITS = " + ".join(f"bit_count(xor({_HALF.format('a', i)}, {_HALF.format('b', i)}))::INTEGER" for i in (1, 9))


_SIGNS = """s AS (SELECT vec_id, substr(md5(CAST(label AS VARCHAR)), 1, 8) || array_to_string(list_transform(range(8), lambda i: format('{:x}', CASE WHEN embedding[8*i+1] + embedding[8*i+2] > 0 THEN 8 ELSE 0 END
      + CASE WHEN embedding[8*i+3] + embedding[8*i+4] > 0 THEN 4 ELSE 0 END + CASE WHEN embedding[8*i+5] + embedding[8*i+6] > 0 THEN 2 ELSE 0 END + CASE WHEN embedding[8*i+7] + embedding[8*i+8] > 0 THEN 1 ELSE 0 END)), '') AS h FROM embeddings)"""


def _signs(spark, sf_dir):
    """A hash of 16 digits: half of the label, half the signs of the sums of neighbouring components, all 64 of them."""
    x = F.col("embedding")
    bit = lambda i, j: F.when(F.element_at(x, 8 * i + 2 * j + 1) + F.element_at(x, 8 * i + 2 * j + 2) > 0, 8 >> j).otherwise(0)
    digits = [F.lower(F.hex(sum(bit(i, j) for j in range(4)).cast("int"))) for i in range(8)]
    return load(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.substring(F.md5(F.col("label").cast("string")), 1, 8), *digits).alias("hash"))


@query(
    f"""WITH {_SIGNS}, c AS (SELECT h, min(vec_id) AS id FROM s GROUP BY h), p AS (SELECT a.id AS a, b.id AS b, {_BITS} AS bits FROM c a JOIN c b ON a.id < b.id)
    SELECT a, b, bits FROM p WHERE bits <= 7"""
)
def hamming_band_join(spark, sf_dir):
    """Pairs of classes of equal 64-bit hashes within seven bits, met by shared bands; ``hamming_band_members`` has the membership."""
    return near_pairs(_signs(spark, sf_dir), "vec_id", "hash")


@query(
    f"""WITH {_SIGNS}, p AS (SELECT a.vec_id AS id, a.h, count(*) - 1 AS links FROM s a JOIN s b ON {_BITS} <= 7 GROUP BY a.vec_id, a.h)
    SELECT p.id, min(s.vec_id) AS class_id, p.links FROM p JOIN s ON s.h = p.h GROUP BY p.id, p.links"""
)
def hamming_band_members(spark, sf_dir):
    """Every vector that has a hash, with the class of its hash and its links within seven bits."""
    hashed = _signs(spark, sf_dir).where("hash IS NOT NULL")
    return linked_rows(hashed, "vec_id", "hash", near_pairs(hashed, "vec_id", "hash"))


@query(
    """WITH t AS (SELECT p_name, min(p_partkey) AS id, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part GROUP BY p_name)
    SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.id < b.id
    WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE >= 0.3 AND len(list_intersect(a.w, b.w)) > 0"""
)
def title_jaccard_pairs(spark, sf_dir):
    """Pairs of titles, by their smallest ids, whose words overlap by three tenths, met over the rarer of their words; ``title_jaccard_members`` has
    the membership."""
    titles = load(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    return prefix_pairs(titles.select("id", F.array_distinct(words(F.col("p_name"))).alias("w")), 0.3)


@query(
    """WITH r AS (SELECT p_partkey AS id, p_name, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part), t AS (SELECT p_name, any_value(w) AS w, min(id) AS class_id, count(*) AS n FROM r GROUP BY p_name),
    l AS (SELECT a.p_name, a.class_id, sum(b.n) - 1 AS links FROM t a JOIN t b ON len(list_intersect(a.w, b.w)) > 0 AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE >= 0.3 GROUP BY ALL)
    SELECT r.id, l.class_id, CAST(l.links AS BIGINT) AS links FROM r JOIN l USING (p_name)"""
)
def title_jaccard_members(spark, sf_dir):
    """Every row with the class of its title and its links, equal titles among them."""
    return linked_rows(load(spark, sf_dir, "part"), "p_partkey", "p_name", title_jaccard_pairs(spark, sf_dir))


_PAIRS = """WITH k AS (SELECT doc_id, source, lang, n_chars, md5(regexp_replace(lower(trim(text, E' \\t\\n\\r')), '\\s+', ' ', 'g')) AS h FROM documents),
p AS (SELECT f.doc_id AS original, c.doc_id AS copy, f.source = c.source AS same_source, f.lang = c.lang AS same_lang, f.n_chars = c.n_chars AS same_size
  FROM k c JOIN (SELECT h, min(doc_id) AS first FROM k GROUP BY h) m USING (h) JOIN k f ON f.doc_id = m.first WHERE c.doc_id <> m.first)
"""


def _copies(spark, sf_dir):
    from tidewell.functions.keys import content_key

    k = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", content_key(F.col("text")).alias("h"))
    first = k.groupBy("h").agg(F.min_by(F.struct("doc_id", "source", "lang", "n_chars"), "doc_id").alias("f"))
    p = k.join(first, "h").where(F.col("doc_id") != F.col("f.doc_id"))
    same = {c: F.col(c).eqNullSafe(F.col(f"f.{c}")) for c in ("source", "lang", "n_chars")}
    return p.select(
        F.col("f.doc_id").alias("original"), F.col("doc_id").alias("copy"), same["source"].alias("same_source"),
        same["lang"].alias("same_lang"), same["n_chars"].alias("same_size"),
    )


@query(_PAIRS + "SELECT original, copy, least(100, 35 + CASE WHEN same_size THEN 5 ELSE 0 END + CASE WHEN same_lang THEN 10 ELSE 0 END + CASE WHEN NOT same_source THEN 20 ELSE 0 END) AS score FROM p")
def clone_score(spark, sf_dir):
    """Clone score of each copy against the first of its text: a base and additions, at most 100."""
    plus = lambda c, n: F.when(c, n).otherwise(0)
    total = F.lit(35) + plus(F.col("same_size"), 5) + plus(F.col("same_lang"), 10) + plus(~F.col("same_source"), 20)
    return _copies(spark, sf_dir).select("original", "copy", F.least(F.lit(100), total).alias("score"))


@query(_PAIRS + "SELECT original, copy, CASE WHEN same_source THEN 'repost' WHEN same_size THEN 'cross_post' WHEN same_lang THEN 'likely_derived' ELSE 'undetermined' END AS relation FROM p")
def lineage_relation(spark, sf_dir):
    """How each copy relates to the first of its text."""
    relation = F.when(F.col("same_source"), "repost").when(F.col("same_size"), "cross_post").when(F.col("same_lang"), "likely_derived")
    return _copies(spark, sf_dir).select("original", "copy", relation.otherwise("undetermined").alias("relation"))


@query(_PAIRS + "SELECT original, count(*) AS claimants, bool_or(NOT same_source) AS elsewhere FROM p GROUP BY original HAVING count(*) >= 3")
def concurrent_claimants(spark, sf_dir):
    """Texts with at least three copies of a first one."""
    out = _copies(spark, sf_dir).groupBy("original").agg(F.count("*").alias("claimants"), F.bool_or(~F.col("same_source")).alias("elsewhere"))
    return out.where("claimants >= 3")
