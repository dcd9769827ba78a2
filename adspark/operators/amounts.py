"""Amounts of pay read from spans of ads by rules: sums, ranges, units, standards, what they pay for and how often.

Everything is one projection of regular expressions in the JVM; nothing is shuffled and no row is looked at in Python. A span
is read together with a window of the ad around it: what follows it decides unit and standard, what stands before and behind
decides component and period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adspark.functions.text import normalize_text
from adspark.functions.unicode import nfc
from adspark.operators.units import SWITCH

# The spellings of numbers, units, standards and keywords that the rules must read, in lower case.
NUMBER = r"\d{1,3}(?:\.\d{3})+|\d+(?:[.,]\d{1,2}|\s?½)?"
UNTIL = r"\s*(?:—|–|-|bis)\s*"
CURRENCIES = [("fl", r"fl\b\.?|flor\b\.?|gulden|gld\.?"), ("K", r"kronen|krone|k\b\.?"), ("S", r"schilling|s\b\.?"), ("RM", r"reichsmark|rm\b\.?"), ("M", r"mark|mk\b\.?"), ("Fr", r"francs|franken|fr\b\.?")]
PARTS = r"kr\b\.?|kreuzer|h\b\.?|heller|gr\b\.?|groschen|pf\b\.?|rpf\b\.?"
OEW = r"ö\.?\s*w|öst\w*\.?\s*w|oe\.?\s*w|[56]\.\s*w\b|österr\w*\.?\s*währ"
CM = r"[ce]\.\s*m\b|[ce]m\b|conv\w*\.?\s*m|conventionsm"
NO_MONEY = r"g\b|gramm|dekagramm|decagramm|dkg|kg|kilo|pfd|pfund|liter|hectol|hektol|raummeter|klafter|metzen|joch|prozent|procent|perc|pct|p\.\s*ct|%|stunden|std\b|tage\b|wochen\b|monate\b|jahre\b|classe|klasse"
COMPONENTS = [
    ("kaution", r"[ck]aution|erlag|sicherstellung"), ("quartiergeld", r"[qo]uar?t[\w-]{0,2}ergeld|wohnungsgeld|quartierbeitrag|zinsbeitrag|möbelzins|mietzins"),
    ("zulage", r"zulage|adjut|triennal|quinquennal|pauschal|subvention|relutum|livreegeld|kostgeld"), ("taggeld", r"taggeld|diurn|diäten(?!\s*-?\s*[ck]lass)"),
    ("pension", r"pension|ruhegenu|ruhegehalt|provision\w* für witwen"), ("remuneration", r"remuner|honorar|substitutionsgebühr|entlohnung|entschädigung|gage"),
    ("lohn", r"lohn|löhnung"), ("gehalt", r"gehalt|bestallung|bezüge|jahresbezug|gehaltsbezug|besoldung|salär|dotation|einkommen"),
]
PERIODS = [
    ("jahr", r"jährl|jahres|jahrl|per jahr|pro jahr|p\.\s*a\.|pro anno|per anno"), ("monat", r"monatl|monats|per monat|pro monat|mtl\."), ("woche", r"wöchentl|wochenlohn|per woche|pro woche"),
    ("tag", r"täglich|taggeld|tagelohn|taglohn|per tag|pro tag|diurn|diäten(?!\s*-?\s*[ck]lass)"), ("stunde", r"stündlich|per stunde|pro stunde|stundenlohn"),
]
YEARLY = ("gehalt", "zulage", "quartiergeld", "pension", "remuneration")
BETWEEN = r"und\b|oder\b|resp\.|bzw\.|beziehungsweise\b|eventuell\b|event\.|je\b|bis\b"
LEAD_IN = r"(?:(?:von|mit|per|pr\.|zu|à|je|circa|ca\.|etwa)\s+)*"
BEFORE, AFTER, PERIOD_BEFORE, PERIOD_AFTER, LIST_REACH, MOST_PARTS = 80, 60, 45, 30, 25, 100

UNIT = "|".join(f"(?:{rx})" for _, rx in CURRENCIES)
SUM = rf"({NUMBER})(?:\s*[—–-](?!\s*\d))?"  # "160—" is 160
UNIT_FIRST = rf"(?U)^\W*(?:von\s+|mit\s+)?({UNIT})\s*{SUM}(?:{UNTIL}{SUM})?"
SUM_FIRST = rf"(?U)^\W*{LEAD_IN}{SUM}(?:{UNTIL}{SUM})?"


def group(text: Column, pattern: str, n: int = 1) -> Column:
    """A group of the first match, NULL where nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def rest(text: Column, pattern: str) -> Column:
    return F.substr(text, F.length(F.regexp_extract(text, pattern, 0)) + 1)


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator, which the optimizer does not merge into what is built on them: they are computed once."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def number(s: Column) -> Column:
    """1.200 is twelve hundred, a comma marks the fraction, ½ adds a half."""
    thousands = s.rlike(r"^\d{1,3}(\.\d{3})+$")
    plain = F.when(thousands, F.replace(s, F.lit("."), F.lit(""))).otherwise(F.replace(s, F.lit(","), F.lit(".")))
    return F.when(s.endswith("½"), F.coalesce(F.regexp_replace(s, r"\s?½", "").try_cast("double"), F.lit(0.0)) + 0.5).otherwise(plain.try_cast("double"))


def currency(token: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, rx in reversed(CURRENCIES):
        out = F.when(F.trim(token).rlike(rf"(?U)^(?:{rx})$"), code).otherwise(out)
    return out


def standard(after: Column, day: Column, of: Column) -> tuple[Column, Column]:
    """Standard of Gulden and whether it is stated right after the sum or follows from the date; `of`: whether it is asked for."""
    part = rf"(?U)^\W*(?:\d+\s*(?:{PARTS})\s*)?"
    stated = F.when(after.rlike(f"{part}(?:{OEW})"), "öW").when(after.rlike(f"{part}(?:{CM})"), "CM")
    dated = F.when(day < F.lit(SWITCH).cast("date"), "CM").when(day.isNotNull(), "öW")
    return F.when(of, F.coalesce(stated, dated)), F.when(of, F.when(stated.isNotNull(), "stated").when(dated.isNotNull(), "date"))


def parse_amount(df: DataFrame, text: str, before: str, day: str) -> DataFrame:
    """Adds amount_min, amount_max, currency, standard and standard_source of the amount at the start of a text.

    `text` is the span and what follows it, `before` what stands in front, where a currency may be written first. NULL, empty
    and unreadable texts give NULLs, as do parts of 100 and more ("400 h"): those are misread units.
    """
    t, b = F.lower(normalize_text(F.col(text))), F.lower(normalize_text(F.col(before)))
    d = stage(stage(df, _t=t, _ahead=b), _first=F.col("_t").rlike(UNIT_FIRST))
    pick = lambda a, b_: F.when(F.col("_first"), group(F.col("_t"), UNIT_FIRST, a)).otherwise(group(F.col("_t"), SUM_FIRST, b_))
    d = stage(d, _lo=pick(2, 1), _hi=pick(3, 2), _behind=F.when(F.col("_first"), rest(F.col("_t"), UNIT_FIRST)).otherwise(rest(F.col("_t"), SUM_FIRST)))
    follows, part = rf"(?U)^\s*({UNIT})", rf"(?U)^\s*({PARTS})"
    d = stage(d, _after=F.when(~F.col("_first"), group(F.col("_behind"), follows)))
    d = stage(d, _part=F.when(~F.col("_first") & F.col("_after").isNull(), group(F.col("_behind"), part)))
    listed = group(F.substring(F.col("_behind"), 1, LIST_REACH), rf"(?U)\d\s*({UNIT})")
    ahead = group(F.col("_ahead"), rf"(?U)(?:^|[\s(])({UNIT})\s*$")
    token = F.when(F.col("_first"), group(F.col("_t"), UNIT_FIRST, 1)).otherwise(F.coalesce("_after", listed, ahead))
    d = stage(d, _token=token)
    code = F.when(F.col("_part").isNotNull(), F.when(F.col("_part").startswith("h"), "K").otherwise("fl")).otherwise(currency(F.col("_token")))
    left = F.when(F.col("_part").isNotNull(), rest(F.col("_behind"), part)).when(F.col("_after").isNotNull(), rest(F.col("_behind"), follows)).otherwise(F.col("_behind"))
    d = stage(d, _code=code, _rest=left)
    std, source = standard(F.col("_rest"), F.col(day), F.col("_code") == "fl")
    d = stage(d, _std=std, _source=source)
    per = F.when(F.col("_std") == "CM", 60.0).otherwise(100.0)
    lo, hi = number(F.col("_lo")), number(F.coalesce("_hi", "_lo"))
    small = F.when(F.col("_hi").isNull() & F.col("_code").isNotNull(), group(F.col("_rest"), rf"(?U)^\s*,?\s*(\d{{1,2}})\s*(?:{PARTS})").try_cast("double"))
    whole = F.when(F.col("_part").isNotNull(), lo / per).otherwise(lo + F.coalesce(small / per, F.lit(0.0)))
    upper = F.when(F.col("_part").isNotNull(), hi / per).otherwise(F.when(F.col("_hi").isNull(), whole).otherwise(hi))
    d = stage(d, _ok=F.col("_lo").isNotNull() & ~(F.col("_part").isNotNull() & (hi >= MOST_PARTS)))
    kept = {"amount_min": whole, "amount_max": upper, "currency": F.col("_code"), "standard": F.col("_std"), "standard_source": F.col("_source")}
    d = stage(d.drop(*kept), **{c: F.when(F.col("_ok"), v) for c, v in kept.items()})
    return d.drop("_t", "_ahead", "_first", "_lo", "_hi", "_behind", "_after", "_part", "_token", "_code", "_rest", "_std", "_source", "_ok")


def is_fragment(span: Column, before: Column) -> Column:
    """Whether a span is only the part of a sum whose main unit stands right before it."""
    return span.rlike(rf"(?U)^\W*\d+\s*(?:{PARTS})\W*$") & before.rlike(rf"(?U)\d\s*(?:{UNIT})\W*$")


def is_not_money(text: Column) -> Column:
    """Whether a text begins with a quantity of something else."""
    return text.rlike(rf"(?U)^\W*(?:von\s+|je\s+)?(?:{NUMBER})\s*(?:{NO_MONEY})")


def nearest(keywords: list[tuple[str, str]], before: Column, after: Column, closed: Column) -> Column:
    """The keyword an amount belongs to.

    One right behind it wins, unless the span is closed by a comma; else the one whose word begins closest before it, or the
    first one behind it if only further amounts of a list stand between and it is closer still. Of equals the earlier listed.
    """
    behind = rf"(?U)^[\s.]{{0,3}}(?:(?:{UNIT})[\s.]*)?(?:\d+\s*(?:{PARTS})[\s.]*)?(?:(?:{OEW}|{CM})[\s.]*)?(?:(?:jährl|monatl|wöchentl|täglich)\w*[\s.]*)?"
    between = rf"(?U)^(?:[\s\d.,—–-]|(?:{UNIT}|{PARTS}|{OEW}|{CM})|{BETWEEN})*$"
    direct = F.coalesce(*[F.when(~closed & after.rlike(rf"{behind}[\w-]*?(?:{rx})"), name) for name, rx in keywords])
    places = []
    for i, (name, rx) in enumerate(keywords):
        begin = F.length(F.regexp_extract(before, rf"(?U)^((?:.*[ -])?)[^ -]*?(?:{rx})", 1))
        places.append(F.when(before.rlike(f"(?U){rx}"), F.struct((F.length(before) - begin).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("n"))))
    for i, (name, rx) in enumerate(keywords, len(keywords)):
        gap = F.regexp_extract(after, rf"(?U)^(.*?)[\w-]*?(?:{rx})", 1)
        places.append(F.when(gap.rlike(r"\d") & gap.rlike(between), F.struct(F.length(gap).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("n"))))
    return F.coalesce(direct, F.array_min(F.array_compact(F.array(*places)))["n"])


def classify(df: DataFrame, before: str, after: str, span: str) -> DataFrame:
    """Adds component, period and period_source from the normalized text around an amount."""
    closed = F.col(span).rlike(r"[,;]\s*$")
    d = stage(df.drop("component", "period", "period_source"), _b4=F.lower(F.col(before)), _af=F.lower(F.col(after)), _closed=closed)
    b, a = F.col("_b4"), F.col("_af")
    near = F.when(F.length(b) > PERIOD_BEFORE, F.substr(b, F.length(b) - PERIOD_BEFORE + 1)).otherwise(b)
    d = stage(d, component=nearest(COMPONENTS, b, a, F.col("_closed")), _near=near, _nigh=F.substring(a, 1, PERIOD_AFTER))
    told = nearest(PERIODS, F.col("_near"), F.col("_nigh"), F.col("_closed"))
    d = stage(d, _told=F.coalesce(told, F.when(F.col("component") == "taggeld", "tag")))
    bail = F.coalesce(F.col("component") == "kaution", F.lit(False))
    assumed = F.col("_told").isNull() & F.col("component").isin(*YEARLY)
    d = stage(d, period=F.when(~bail, F.coalesce("_told", F.when(assumed, "jahr"))))
    return d.withColumn("period_source", F.when(F.col("period").isNotNull(), F.when(F.col("_told").isNotNull(), "stated").otherwise("assumed"))).drop("_b4", "_af", "_closed", "_near", "_nigh", "_told")


def parse_spans(spans: DataFrame) -> DataFrame:
    """One row per span (ad_id, newspaper, year, date, text, start, end, phrase): amount, component, period, parsed_by.

    `parsed_by` is 'rules', 'fragment', 'not_money' or NULL where the rules cannot read the span. `snippet` shows the span in
    its surroundings, for an annotator. Spans of NULL texts are unread. Extra columns are dropped; repeated rows stay repeated.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    begin = F.greatest(F.col("start") - BEFORE, F.lit(0))
    d = spans.select("ad_id", "newspaper", "year", "date", "start", "end", "phrase", nfc(F.substr(t, begin + 1, F.col("start") - begin)).alias("_b"), nfc(F.substr(t, F.col("start") + 1, F.col("end") - F.col("start"))).alias("_s0"), nfc(F.substr(t, F.col("end") + 1, F.lit(AFTER))).alias("_a"))
    d = stage(d.withColumnsRenamed({"_b": "_b0", "_a": "_a0"}), _b=normalize_text(F.col("_b0")), _s1=normalize_text(F.col("_s0")), _a=normalize_text(F.col("_a0")))
    lead = group(F.col("_b"), r"(\d+)\s*$")
    split = lead.isNotNull() & F.lower("_s1").rlike(rf"(?U)^\W*(?:{UNIT})\s*\d+\s*(?:{PARTS})")
    d = stage(d, _s=F.when(split, F.concat(lead, F.lit(" "), F.col("_s1"))).otherwise(F.col("_s1")))
    d = stage(d, _all=F.concat("_s", F.lit(" "), "_a"), _frag=is_fragment(F.lower("_s"), F.lower("_b")))
    d = stage(d, _other=~F.col("_frag") & is_not_money(F.lower("_all")))
    d = classify(parse_amount(d, "_all", "_b", "date"), "_b", "_a", "_s")
    ok = ~F.col("_frag") & ~F.col("_other") & F.col("_s").rlike(r"\d") & F.col("amount_min").isNotNull() & F.col("currency").isNotNull()
    d = stage(d, _ok=F.coalesce(ok, F.lit(False)))
    read = {c: F.when(F.col("_ok"), F.col(c)) for c in ("amount_min", "amount_max", "currency", "standard", "standard_source")}
    by = F.when(F.col("_ok"), "rules").when(F.col("_frag"), "fragment").when(F.col("_other"), "not_money")
    left = F.when(F.length("_b") > 50, F.substr(F.col("_b"), F.length("_b") - 49)).otherwise(F.col("_b"))
    snippet = F.concat(F.lit("…"), left, F.lit(" ["), "_s", F.lit("] "), F.substring("_a", 1, 40), F.lit("…"))
    d = d.withColumns(read | {"parsed_by": by, "snippet": snippet})
    return d.select("ad_id", "newspaper", "year", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "phrase", "amount_min", "amount_max", "currency", "standard", "standard_source", "component", "period", "period_source", "parsed_by", "snippet")


def salary_spans(ads: DataFrame) -> DataFrame:
    """The salary spans of every ad (delivered twice: once), as parse_spans takes them."""
    a = ads.select("ad_id", "newspaper", "year", "date", "text", "salary").dropDuplicates(["ad_id"])
    return a.select("ad_id", "newspaper", "year", "date", "text", F.explode("salary").alias("s")).select("ad_id", "newspaper", "year", "date", "text", "s.start", "s.end", F.col("s.text").alias("phrase"))


def apply_readings(rows: DataFrame, readings: DataFrame, reader: str = "llm") -> DataFrame:
    """Amounts that an annotator read from snippets (snippet, amount_min, amount_max, currency), for rows the rules left.

    The dictionary of snippets may be large: Spark chooses the join.
    """
    r = readings.dropDuplicates(["snippet"]).select("snippet", *[F.col(c).alias(f"_{c}") for c in ("amount_min", "amount_max", "currency")])
    d = rows.join(r, "snippet", "left").withColumn("_new", F.col("parsed_by").isNull() & F.col("_amount_min").isNotNull())
    d = d.withColumns({c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("amount_min", "amount_max", "currency")})
    return d.withColumn("parsed_by", F.when(F.col("_new"), reader).otherwise(F.col("parsed_by"))).drop("_new", "_amount_min", "_amount_max", "_currency")
