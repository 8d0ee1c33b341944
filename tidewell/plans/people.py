"""Vacancies, candidates, employers and owners."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions.keys import LEGAL_FORMS, RANKS, role_key
from tidewell.operators.components import connected_components
from tidewell.plans.registry import query
from tidewell.plans.stats import _d
from tidewell.plans.tables import d4
from tidewell.session import load

JOBS = """WITH jobs AS (
  SELECT o_orderkey AS id, c_mktsegment AS profession, n_name AS geo, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS salary, o_orderdate AS posted_at,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 12 END AS years, o_orderkey % 10 = 0 AS no_experience
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""


def jobs(spark, sf_dir):
    """orders as vacancies; see JOBS for the same in SQL."""
    orders, customer, nation = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("o_orderkey")
    return rows.select(
        k.alias("id"),
        F.col("c_mktsegment").alias("profession"),
        F.col("n_name").alias("geo"),
        F.when(k % 3 != 0, F.col("o_totalprice")).alias("salary"),
        F.col("o_orderdate").alias("posted_at"),
        F.when(k % 7 != 0, k % 12).alias("years"),
        (k % 10 == 0).alias("no_experience"),
    )


@query(
    JOBS
    + f"""SELECT profession, count(*) AS n, count(salary) AS paid, {_d("median(salary)")} AS median, {_d("min(salary)")} AS lowest, {_d("max(salary)")} AS highest FROM jobs GROUP BY profession"""
)
def vacancy_salary_stats(spark, sf_dir):
    """Salary statistics by profession."""
    out = jobs(spark, sf_dir).groupBy("profession").agg(
        F.count("*").alias("n"), F.count("salary").alias("paid"), F.percentile("salary", F.lit(0.5)).alias("median"),
        F.min("salary").alias("lowest"), F.max("salary").alias("highest"),
    )
    return out.select("profession", "n", "paid", d4("median"), d4("lowest"), d4("highest"))


@query(
    JOBS
    + """SELECT profession, geo, n, CAST(rn AS INTEGER) AS place FROM (SELECT profession, geo, n, row_number() OVER (PARTITION BY profession ORDER BY n DESC, geo) AS rn FROM
    (SELECT profession, geo, count(*) AS n FROM jobs GROUP BY ALL)) WHERE rn <= 6"""
)
def profession_geo_top6(spark, sf_dir):
    """The six places with most vacancies of each profession."""
    counts = jobs(spark, sf_dir).groupBy("profession", "geo").agg(F.count("*").alias("n"))
    w = Window.partitionBy("profession").orderBy(F.desc("n"), "geo")
    return counts.withColumn("place", F.row_number().over(w)).where("place <= 6")


@query(
    JOBS
    + """SELECT id, profession, posted_at FROM (SELECT *, row_number() OVER (PARTITION BY CAST(posted_at AS DATE), geo, profession ORDER BY id DESC) AS rn FROM jobs WHERE salary IS NOT NULL)
    WHERE rn <= 3 ORDER BY posted_at DESC, id DESC LIMIT 750"""
)
def salary_trend_sample(spark, sf_dir):
    """Stratified sample: three of each day, place and profession, the newest 750 of them."""
    w = Window.partitionBy(F.to_date("posted_at"), "geo", "profession").orderBy(F.desc("id"))
    rows = jobs(spark, sf_dir).where("salary IS NOT NULL").withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    return rows.orderBy(F.desc("posted_at"), F.desc("id")).limit(750).select("id", "profession", "posted_at")


@query(
    JOBS
    + """SELECT count(*) FILTER (WHERE no_experience) AS none, count(*) FILTER (WHERE NOT no_experience AND years <= 1) AS upto1, count(*) FILTER (WHERE NOT no_experience AND years > 1 AND years <= 3) AS upto3,
    count(*) FILTER (WHERE years > 3 AND years <= 6) AS upto6, count(*) FILTER (WHERE years > 6) AS more, count(*) FILTER (WHERE years IS NULL) AS unknown FROM jobs"""
)
def experience_brackets(spark, sf_dir):
    """Experience brackets, in which a row may count twice (the upper ones ignore the flag)."""
    y, none = F.col("years"), F.col("no_experience")
    return jobs(spark, sf_dir).agg(
        F.count_if(none).alias("none"), F.count_if(~none & (y <= 1)).alias("upto1"), F.count_if(~none & (y > 1) & (y <= 3)).alias("upto3"),
        F.count_if((y > 3) & (y <= 6)).alias("upto6"), F.count_if(y > 6).alias("more"), F.count_if(y.isNull()).alias("unknown"),
    )


@query("SELECT CASE WHEN p_size < 10 THEN '<10' WHEN p_size < 20 THEN '10-19' WHEN p_size < 35 THEN '20-34' ELSE '35+' END AS bucket, count(*) AS n FROM part GROUP BY ALL")
def candidate_age_buckets(spark, sf_dir):
    """Counts by bucket of a number."""
    s = F.col("p_size")
    bucket = F.when(s < 10, "<10").when(s < 20, "10-19").when(s < 35, "20-34").otherwise("35+")
    return load(spark, sf_dir, "part").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query(
    """SELECT l_suppkey AS employer, count(DISTINCT l_partkey) AS roles, count(*) AS postings, max(l_shipdate) AS last_posted FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) >= 2"""
)
def employers_min_roles(spark, sf_dir):
    """Employers with at least two different roles."""
    out = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("employer")).agg(
        F.countDistinct("l_partkey").alias("roles"), F.count("*").alias("postings"), F.max("l_shipdate").alias("last_posted")
    )
    return out.where("roles >= 2")


@query(
    """SELECT owner, flag AS commonest, n FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY n DESC, flag) AS rn
    FROM (SELECT l_suppkey AS owner, l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE rn = 1"""
)
def owners_mode(spark, sf_dir):
    """The commonest value of each owner; ties to the smaller value."""
    counts = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("owner"), F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))
    best = counts.groupBy("owner").agg(F.min(F.struct((-F.col("n")).alias("n"), "flag")).alias("b"))
    return best.select("owner", F.col("b.flag").alias("commonest"), (-F.col("b.n")).alias("n"))


@query(
    """SELECT l_suppkey AS employer, arg_max(l_partkey, (l_shipdate, l_orderkey, l_linenumber)) AS newest, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_suppkey"""
)
def employer_newest(spark, sf_dir):
    """The newest posting's role and the ordered list of an employer's flags."""
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("employer")).agg(
        F.max_by("l_partkey", order).alias("newest"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags")
    )


#: Postings of one role that are written in several ways.
_COMPANY = "CASE p_partkey % 4 WHEN 0 THEN upper(p_brand) || ', LLC.' WHEN 1 THEN p_brand || ' GmbH' WHEN 2 THEN 'ООО \"' || p_brand || '\"' ELSE p_brand END"
_TITLE = "CASE p_partkey % 5 WHEN 0 THEN 'Senior ' || p_name WHEN 1 THEN p_name || ' (remote, C++)' WHEN 2 THEN p_name || ' full-time' WHEN 3 THEN p_name || ', стажёр' ELSE p_name END"


def _told(sql: str, dropped: str, kept: str = "") -> str:
    """without_words in DuckDB, which knows no lookaround: words are set apart by two blanks first."""
    apart = f"regexp_replace({sql}, '[^\\p{{L}}\\p{{N}}{kept}]+', '  ', 'g')"
    bare = f"regexp_replace(' ' || {apart} || ' ', ' ({dropped}) ', '  ', 'g')" if dropped else apart
    return f"trim(regexp_replace({bare}, ' +', ' ', 'g'))"


_FORMS = "|".join(LEGAL_FORMS)
_TERMS = "|".join(r for r in RANKS if "[-" not in r)
_TIMES = "regexp_replace(regexp_replace(lower({0}), '\\([^)]*\\)', ' ', 'g'), '(full|part)[- ]?time', ' ', 'g')"
_ROLE = f"""sha256(upper(p_type) || chr(0) || {_told(f"lower({_COMPANY})", _FORMS)} || chr(0) || {_told(_TIMES.format(_TITLE), _TERMS, "+#")} || chr(0) || CAST(p_size AS VARCHAR))"""


def _roles(spark, sf_dir):
    key = role_key(F.col("p_type"), F.expr(_COMPANY), F.expr(_TITLE), F.col("p_size").cast("string"))
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), key.alias("role_key"))


@query(f"SELECT p_partkey AS id, {_ROLE} AS role_key FROM part")
def job_cluster_key(spark, sf_dir):
    """The role's key of every posting."""
    return _roles(spark, sf_dir)


@query(f"SELECT {_ROLE} AS role_key, count(*) AS postings, min(p_partkey) AS first_id FROM part GROUP BY ALL")
def cluster_recount(spark, sf_dir):
    """Counters of every cluster."""
    return _roles(spark, sf_dir).groupBy("role_key").agg(F.count("*").alias("postings"), F.min("id").alias("first_id"))


@query(
    """WITH RECURSIVE n AS (SELECT DISTINCT c_custkey AS id, 'b' || CAST(CAST(round(c_acctbal * 100) AS BIGINT) // 1000 AS VARCHAR) AS k FROM customer
      UNION SELECT c_custkey, 'n' || CAST(c_custkey // 3 AS VARCHAR) || '-' || CAST(c_nationkey AS VARCHAR) FROM customer),
    e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM n a JOIN n b ON a.k = b.k),
    r(id, root) USING KEY (id) AS (SELECT id, id FROM (SELECT DISTINCT id FROM n) UNION SELECT e.b, min(r.root) FROM r JOIN e ON e.a = r.id JOIN recurring.r old ON old.id = e.b
      WHERE r.root < old.root GROUP BY e.b)
    SELECT id, root AS group_id FROM r"""
)
def candidate_groups(spark, sf_dir):
    """Groups of candidates over strong identifiers: rows and identifiers are the two sides
    of a graph, whose components are the groups."""
    c = load(spark, sf_dir, "customer")
    one = F.concat(F.lit("b"), F.expr("cast(round(c_acctbal * 100) as bigint) div 1000").cast("string"))
    two = F.concat(F.lit("n"), F.expr("c_custkey div 3").cast("string"), F.lit("-"), F.col("c_nationkey").cast("string"))
    ids = c.select(F.col("c_custkey").alias("id"), F.explode(F.array(one, two)).alias("k")).distinct()
    hubs = ids.groupBy("k").agg(F.min("id").alias("hub"))
    edges = ids.join(hubs, "k").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    found = connected_components(edges)
    alone = c.select(F.col("c_custkey").alias("id")).join(found, F.col("id") == F.col("node"), "left")
    return alone.select("id", F.coalesce("component", "id").alias("group_id"))


@query(
    """SELECT doc_id FROM (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id) WHERE good <> bad"""
)
def registry_signal_exclusive(spark, sf_dir):
    """Rows with exactly one of two signals."""
    sides = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("bad"))
    return sides.where("good <> bad").select("doc_id")


@query("SELECT l_partkey AS identifier, count(DISTINCT l_suppkey) AS owners FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 2")
def shared_identifiers(spark, sf_dir):
    """Identifiers that belong to several owners."""
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("identifier")).agg(F.countDistinct("l_suppkey").alias("owners")).where("owners >= 2")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphan_keys(spark, sf_dir):
    """Keys that nothing refers to."""
    used = load(spark, sf_dir, "orders").select("o_custkey")
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(used, F.col("id") == F.col("o_custkey"), "left_anti")


@query(
    """WITH s AS (SELECT lang, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END)::DOUBLE AS k, count(*)::DOUBLE AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang)
    SELECT lang, CAST(n AS BIGINT) AS n, CAST(CAST((k/n + 3.8416/(2*n)) / (1 + 3.8416/n) - 1.96*sqrt(k/n*(1-k/n)/n + 3.8416/(4*n*n))/(1 + 3.8416/n) AS DECIMAL(20,4)) AS DOUBLE) AS low,
    CAST(CAST((k/n + 3.8416/(2*n)) / (1 + 3.8416/n) + 1.96*sqrt(k/n*(1-k/n)/n + 3.8416/(4*n*n))/(1 + 3.8416/n) AS DECIMAL(20,4)) AS DOUBLE) AS high FROM s"""
)
def wilson_interval(spark, sf_dir):
    """Share of positives by language with its Wilson interval."""
    from tidewell.operators.scores import wilson

    labels, docs = load(spark, sf_dir, "labels"), load(spark, sf_dir, "documents").select("doc_id", "lang")
    s = labels.join(docs, "doc_id").groupBy("lang").agg(F.count_if(F.col("toxic") == 1).cast("double").alias("k"), F.count("*").cast("double").alias("m"))
    low, high = wilson(F.col("k"), F.col("m"))
    return s.select("lang", F.col("m").cast("long").alias("n"), low.alias("low"), high.alias("high")).select("lang", "n", d4("low"), d4("high"))


@query(
    """WITH p AS (SELECT l.quality = 1 AS truth, length(d.text) >= 400 AS said FROM labels l JOIN documents d USING (doc_id)),
    c AS (SELECT count(*) FILTER (WHERE truth AND said) AS tp, count(*) FILTER (WHERE NOT truth AND said) AS fp, count(*) FILTER (WHERE truth AND NOT said) AS fn FROM p)
    SELECT tp, fp, fn, CAST(CAST(tp / (tp + fp)::DOUBLE AS DECIMAL(20,4)) AS DOUBLE) AS precision_share, CAST(CAST(tp / (tp + fn)::DOUBLE AS DECIMAL(20,4)) AS DOUBLE) AS recall_share FROM c"""
)
def precision_recall(spark, sf_dir):
    """Agreement of a rule with reviewed labels."""
    labels, docs = load(spark, sf_dir, "labels"), load(spark, sf_dir, "documents").select("doc_id", "text")
    truth, said = F.col("quality") == 1, F.length("text") >= 400
    c = labels.join(docs, "doc_id").agg(F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"))
    tp = F.col("tp").cast("double")
    c = c.select("tp", "fp", "fn", (tp / (F.col("tp") + F.col("fp"))).alias("precision_share"), (tp / (F.col("tp") + F.col("fn"))).alias("recall_share"))
    return c.select("tp", "fp", "fn", d4("precision_share"), d4("recall_share"))
