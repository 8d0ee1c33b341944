"""Payment signals in texts: phrases that count only near others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.quantiles import prefix_sums

#: How many characters on either side of a phrase its context may stand in.
WINDOW = 90
#: The phrases of each kind, as beginnings of words ('sensitive': as whole words).
PHRASES = {
    "payment": (
        "prepay", "pre-pay", "deposit", "transfer", "send (?:the )?money", "pay(?:ment)?", "предоплат", "аванс", "задат", "залог", "переве(?:д|ст)",
        "скин(?:ь|уть) (?:на карту|деньги)", "оплат", "oldindan to.lov", "to.lov", "zakalat", "avans", "pul o.tkaz", "o.tkazib", "передоплат", "завдат",
    ),
    "before_viewing": (
        "before (?:the )?(?:viewing|showing|visit)", "without (?:a )?(?:viewing|visit)", "to (?:reserve|hold|book) (?:the )?(?:flat|apartment|room)", "sight unseen",
        "до просмотра", "без просмотра", "для брони", "чтобы (?:забронировать|закрепить)", "бронь", "до показа", "ko.rishdan oldin", "ko.rmasdan", "bron qilish", "bron uchun",
        "до перегляду", "без перегляду",
    ),
    "identity": (
        "passport", "id (?:card )?(?:photo|scan)", "photo of (?:your )?id", "driver.?s licen", "паспорт", "фото (?:паспорта|документ)", "скан (?:паспорта|документа)", "id.?карт", "pasport",
        "hujjat (?:rasmi|nusxa)",
    ),
    "viewing_stage": (
        "before (?:the )?(?:viewing|showing|visit|meeting)", "first send", "send (?:me )?(?:a )?(?:photo|scan)", "до просмотра", "до встречи", "сначала (?:отправ|скин|пришл)", "пришлите",
        "скиньте", "ko.rishdan oldin", "uchrashuvdan oldin", "avval yubor",
    ),
    "sensitive": (
        "card number", "cvv", "cvc", "sms code", "code from (?:the )?sms", "one.time code", "номер карты", "код из смс", "смс.?код", "cvv.?код", "karta raqam", "sms kod",
    ),
    "viewing_fee": (
        "viewing fee", "fee (?:for|to) (?:view|see)", "pay (?:to|for) (?:the )?viewing", "application fee", "оплата (?:за )?просмотр", "плата за (?:просмотр|показ)", "платный просмотр", "за показ",
        "ko.rish uchun to.lov", "ko.rish pulli",
    ),
    "credit_check": (
        "credit (?:check|report|score)", "background check (?:fee|site|link)", "кредитн(?:ая|ую|ой) (?:истори|проверк)", "проверк[аиу] кредитн", "kredit tarix",
    ),
    "pressure": (
        "urgent", "only today", "today only", "many (?:people|applicants|interested)", "someone else will", "last chance", "срочно", "только сегодня", "много желающих", "другие желающие", "уйдёт",
        "уйдет", "последний шанс", "shoshilinch", "faqat bugun", "xohlovchilar ko.p", "терміново", "тільки сьогодні",
    ),
}
LINK = r"(?i)https?://|(?<![\p{L}\p{N}])www\."
#: A reason, the phrase that it hangs on, what must stand near (any of them), and whether the phrase is whole words. Of one
#: reason's rules the first that finds something tells the place.
RULES = (
    ("payment_before_verification", "payment", ("before_viewing",), False),
    ("payment_pressure", "payment", ("pressure",), False),
    ("premature_identity_data_request", "sensitive", (), True),
    ("premature_identity_data_request", "identity", ("viewing_stage",), False),
    ("third_party_credit_check_risk", "credit_check", ("payment", "link"), False),
    ("viewing_fee_requested", "viewing_fee", (), False),
)


def pattern(name: str, whole: bool = False) -> str:
    """The phrases of a kind at the beginning of a word, in any case."""
    end = r"(?![\p{L}\p{N}])" if whole else ""
    return r"(?iu)(?<![\p{L}\p{N}])(?:" + "|".join(PHRASES[name]) + ")" + end


def _around(text: Column, start: Column, stop: Column) -> Column:
    begin = F.greatest(F.lit(0), start - WINDOW)
    return F.substr(text, (begin + 1).cast("int"), (stop + WINDOW - begin).cast("int"))


def findings(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` by finding: all columns but ``text``, then (reason, at): a reason once a row, ``at`` where its first phrase stands, in code points from 0.
    Null and empty texts have none. All runs where the row lies."""
    kept = [c for c in rows.columns if c != text]
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = rows.select(*kept, own.alias("t_"))
    names = sorted({(a, whole) for _, a, _, whole in RULES})
    cols = [c for a, whole in names for c in (F.split("t_", pattern(a, whole), -1).alias(f"g_{a}"), F.regexp_extract_all("t_", F.lit(pattern(a, whole)), F.lit(0)).alias(f"h_{a}"))]
    base = base.select(*kept, "t_", *cols)
    steps = [F.zip_with(F.slice(f"g_{a}", 1, F.size(f"h_{a}")), f"h_{a}", lambda g, h: (F.length(g) + F.length(h)).cast("long")).alias(f"s_{a}") for a, _ in names]
    base = base.select(*kept, "t_", *[f"h_{a}" for a, _ in names], *steps)
    base = base.select(*kept, "t_", *[f"h_{a}" for a, _ in names], *[prefix_sums(F.col(f"s_{a}")).alias(f"e_{a}") for a, _ in names])
    met = []
    for reason, anchor, contexts, _ in RULES:
        spans = F.zip_with(f"e_{anchor}", f"h_{anchor}", lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("stop")))

        def near(s: Column, contexts: tuple[str, ...] = contexts) -> Column:
            around = _around(F.col("t_"), s["start"], s["stop"])
            tests = [around.rlike(LINK if c == "link" else pattern(c)) for c in contexts]
            return tests[0] if len(tests) == 1 else tests[0] | tests[1]

        hits = F.filter(spans, lambda s: near(s)) if contexts else spans
        met.append(F.when(F.size(hits) > 0, F.struct(F.lit(reason).alias("reason"), F.element_at(hits, 1)["start"].alias("at"))))
    out = base.select(*kept, F.array_compact(F.array(*met)).alias("found"))
    # A reason with two rules: the first that found something. It stands earlier in the row's own array.
    first = F.filter("found", lambda f, i: ~F.exists(F.slice("found", F.lit(1), i), lambda g: g["reason"] == f["reason"]))
    return out.select(*kept, F.inline(first))
