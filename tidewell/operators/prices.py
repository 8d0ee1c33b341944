"""The listing's own price among the amounts of its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.quantiles import prefix_sums

#: Words that speak for a price and for a side payment, where a clause ends, how far the words may stand before and after, how
#: near a currency has to be, and what each is worth.
PRICE_CUE = r"(?iu)(?:цена|ціна|стоимост|вартість|аренд|оренд|ставка|price|pret|chirie|narx|нарх|ижара|в месяц|за месяц|на месяц|/мес|/міс|per month|lunar)"
EXTRA_CUE = (
    r"(?iu)(?:залог|депозит|deposit|заклад|гарант|комисси|комісі|коммунал|комунал|парков|паркінг|паркинг|parcare|предоплат|аванс|страховк|garantie|taxa|avans)"
)
CLAUSE_END = r"[.,;!?+|\n]"
BEFORE, AFTER, TOUCHING = 40, 25, 3
PRICE, EXTRA, CURRENCY = 2, -3, 1
#: An amount: groups of three digits, or digits, and a word for thousands; the currencies that make it one.
_BLANK = "[   .,]"
AMOUNT = rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:[1-9]\d{{0,2}}(?:{_BLANK}\d{{3}})+(?!\d)(?:[.,]\d{{1,2}}(?!\d))?|\d+(?:[.,]\d{{1,2}}(?!\d))?)(?:\s?(?:к|k|тыс\.?|тис\.?)(?![\p{{L}}\p{{N}}]))?"
MONEY = r"(?iu)(?:[$€₴£₸]|(?<!\p{L})(?:usd|eur|uah|грн|сум|сўм|so.m|lei|руб|тенге)(?!\p{L}))"


def parsed(piece: Column) -> Column:
    """'27 400', '9 тис', '4,150', '12,5' as numbers; null if it is none."""
    trimmed = F.trim(piece)
    number = F.trim(F.regexp_replace(trimmed, r"(?iu)(к|k|тыс\.?|тис\.?)$", ""))
    grouped = rf"^[1-9]\d{{0,2}}(?:{_BLANK}\d{{3}})+(?:[.,]\d{{1,2}})?$"
    tail = F.regexp_extract(number, r"[.,](\d{1,2})$", 1)
    head = F.regexp_replace(F.when(tail != "", F.regexp_replace(number, r"[.,]\d{1,2}$", "")).otherwise(number), _BLANK, "")
    of_groups = F.expr("1.0D") * head.try_cast("double") + F.when(tail != "", F.concat(F.lit("0."), tail).try_cast("double")).otherwise(0.0)
    value = F.when(number.rlike(grouped), of_groups).otherwise(F.replace(number, F.lit(","), F.lit(".")).try_cast("double"))
    return value * F.when(number != trimmed, 1000).otherwise(1)


def _spans(rows: DataFrame, text: str, kept: list[str], patterns: dict[str, str]) -> DataFrame:
    """Arrays of (start, stop, piece) of each pattern's hits, in code points from 0."""
    out = rows.select(*kept, *[c for n, p in patterns.items() for c in (F.split(text, p, -1).alias(f"g_{n}"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"h_{n}"))])
    steps = {n: F.zip_with(F.slice(f"g_{n}", 1, F.size(f"h_{n}")), f"h_{n}", lambda g, h: (F.length(g) + F.length(h)).cast("long")) for n in patterns}
    out = out.select(*kept, *[f"h_{n}" for n in patterns], *[s.alias(f"s_{n}") for n, s in steps.items()])
    out = out.select(*kept, *[f"h_{n}" for n in patterns], *[prefix_sums(F.col(f"s_{n}")).alias(f"e_{n}") for n in patterns])
    made = {n: F.zip_with(f"e_{n}", f"h_{n}", lambda e, h: F.struct((e - F.length(h)).cast("int").alias("start"), e.cast("int").alias("stop"), h.alias("piece"))) for n in patterns}
    return out.select(*kept, *[m.alias(n) for n, m in made.items()])


def own_price(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``price`` (start, stop, piece, amount, score): of the amounts that stand next to a currency the best by the words around it, the
    earliest of equals; null if there is none. The words count up to the end of the clause on either side."""
    kept = rows.columns
    own = rows.withColumn("t_", F.coalesce(F.col(text).cast("string"), F.lit("")))
    found = _spans(own, "t_", [*kept, "t_"], {"amounts": AMOUNT, "money": MONEY})
    near = lambda a: F.exists("money", lambda m: (m["start"] - a["stop"]).between(0, TOUCHING) | (a["start"] - m["stop"]).between(0, TOUCHING))
    found = found.withColumn("amounts", F.filter("amounts", near))

    def score(a: Column) -> Column:
        begin = F.greatest(F.lit(0), a["start"] - BEFORE)
        before = F.element_at(F.split(F.substr(F.col("t_"), begin + 1, a["start"] - begin), CLAUSE_END, -1), -1)
        after = F.element_at(F.split(F.substr(F.col("t_"), a["stop"] + 1, F.lit(AFTER)), CLAUSE_END, -1), 1)
        either = lambda cue: before.rlike(cue) | after.rlike(cue)
        return F.when(either(PRICE_CUE), PRICE).otherwise(0) + F.when(either(EXTRA_CUE), EXTRA).otherwise(0) + CURRENCY

    scored = F.transform("amounts", lambda a: F.struct((-score(a)).alias("cost"), a["start"].alias("start"), a["stop"].alias("stop"), a["piece"].alias("piece")))
    best = found.select(*kept, F.array_min(scored).alias("b"))
    told = F.struct(F.col("b.start").alias("start"), F.col("b.stop").alias("stop"), F.col("b.piece").alias("piece"), parsed(F.col("b.piece")).alias("amount"), (-F.col("b.cost")).alias("score"))
    return best.select(*kept, F.when(F.col("b").isNotNull(), told).alias("price"))
