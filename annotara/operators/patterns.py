"""Patterns of reference parts: ordered rewrites to token patterns, frequencies, example selection."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stored

MONTHS = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
PLACES = "London|Toronto|Ottawa|Montreal|Montréal|Vancouver|New\\s+York|Chicago|Oxford|Cambridge|Totonto"

#: The rewrites of each part, in order.  All are applied with (?U), so that classes, word ends and
#: cases of letters are Unicode's.
FRAGMENT = [
    (r"\bsections?\b|\bss\.", "SECTION"), (r"s\.", "SECTION"), (r"\bsubsections?\b", "SUBSECTION"), (r"\bparagraphs?\b|\bpara\.", "PARA"),
    (r"\bsubparagraphs?\b", "SUBPARA"), (r"\barticles?\b|\barts?\.", "ARTICLE"), (r"\brules?\b", "RULE"), (r"\bparts?\b", "PART"),
    (r"\bschedules?\b|\bsched\.", "SCHEDULE"), (r"\bschs\.", "SCHEDULE"), (r"\bpp\.", "PP"), (r"\bp\.", "P"), (r"\bparas\.", "PARAS"),
    (r"\bpara\.", "PARA"), (r"\bparagraph", "PARA"), (r"\bfootnote", "FOOTNOTE"), (r"\bpages", "PAGES"), (r"\bpage", "PAGE"),
    (r"\bet seq\.?", "ETSEQ"), (r"\bthrough\b|\bto\b", "TO"), (r"\band\b", "AND"), (r",", " , "), (r"\b[ivx]+\b", "ROMAN"),
    (r"\(([a-z]+)\)", "(ALPHA)"), (r"(\d+)\((\d+)\)\(([^)]+)\)", "NUM(PAREN)(PAREN)"), (r"(\d+)\((\d+)\)", "NUM(PAREN)"),
    (r"(\d+)\.(\d+)\(([^)]+)\)", "NUM.NUM(PAREN)"), (r"(\d+)\.(\d+)", "NUM.NUM"), (r"NUM\s*-\s*NUM", "RANGE"), (r"NUM\s*TO\s*NUM", "RANGE"),
    (r"\d+", "NUM"),
]
DECISION_CITATION = [
    (r"[\r\n]+", " "), (r"[ \t]{2,}", " "), (r"\(\s*\d+(?:st|nd|rd|d|th)\s*\)", "(ORDINAL)"), (r"\b\d{3}-\d{2}-\d{6,9}-\d{3,4}\b", "DOCKET"),
    (r"\b\d{1,2}\s+" + MONTHS + r"\s+\d{4}\b", "DATE"), (r"\b" + MONTHS + r"\s+\d{1,2},\s+\d{4}\b", "DATE"),
    (r"\[\s*(19|20)\d{2}\s*\]", "YEAR"), (r"\(\s*(19|20)\d{2}\s*\)\s*,", "YEAR ,"),
    (r"\b(CanLII|[A-Z]{2,4}(?:CA|CS|SC|QB|KB|HCJ|PC)?)\s+(\d+)\b", "TRIBUNAL NUM"), (r"\b(19|20)\d{2}\b", "YEAR"),
    (r"(?i)\bno?\.\s*\d+", "NO NUM"),
    (r"\(\s*(?:[A-Z][a-zA-Z.]*\.(?:\s*[A-Z][a-zA-Z.]*\.?)*|(?:Gen\.|H\.C\.J\.|Cir\.|Div\.)[\w\s.]*|Canada\s+PC|[A-Z]{2,5})\s*\)", "(COURT)"),
    (r"\b(?:[A-Z](?:\.[A-Z]){1,5}\.?|[A-Z][a-z]+\.(?:\s*[A-Z](?:\.[A-Z]+)*\.?)|App\.\s*Cas\.|[A-Z]+\s+[A-Z][a-z]+\.)\b", "REPORTER"),
    (r"\b(Hull|Ont|Que|Alta|Man|Sask|Montréal|Montreal)\b\.?", "PLACE"), (r"\b\d+\b", "NUM"),
]
LEGISLATION_CITATION = [
    (r"\b\d{1,2}-\d{1,2}\s+(?:Elizabeth|George|Victoria|Edward|William|Anne|James|Mary|Henry)\s+(?:I{1,3}|IV|V|VI|VII|VIII|IX|X|XI)", "REGNALE_YEAR"),
    (r"\b(19|20)\d{2}-\d{2}\b", "YEAR_RANGE"), (r"\bD-\d{4}-\d{3,6}\b", "DECISION_ID"), (r"\bG\.O\.[A-Z]\.\b", "GAZETTE"),
    (r"\b\d{4}\.[IVXLCDM]+\.\d+[A-Z]?\b", "GAZETTE_REF"), (r"\bSOR/\d{2,4}-\d{1,4}\b", "SOR_REG"),
    (r"\bc\.\s*(?:[A-Z][\-‑‒–]?\d+(?:\.\d+)?|\d+)\b", "CHAPTER"), (r"(?i)\bchapter\s+(?:[A-Z][\-‑‒–]?\d+(?:\.\d+)?|\d+)\b", "CHAPTER"),
    (r"\(\s*(19|20)\d{2}\s*\)", "YEAR"), (r"\b\d{1,2}\s+" + MONTHS + r"\s+\d{4}\b", "DATE"), (r"\b(19|20)\d{2}\b", "YEAR"),
    (r"\b\d+(?:st|nd|rd|th)\s+Sess\.", "SESSION"), (r"\b\d+(?:st|nd|rd|th)\s+Leg\.", "LEGISLATURE"), (r"\bBill\s+[A-Z0-9-]+\b", "BILL"),
    (r"\bNo\.\s*\d+\b", "NO_NUM"), (r"\b(?:Que\.|Ont\.|B\.C\.|Alta\.|Man\.|Sask\.|P\.E\.I\.)\s*(?:Q\.B\.|K\.B\.|C\.A\.|H\.C\.|H\.C\.J\.)\b", "REPORTER"),
    (r"\b[A-Z](?:\.[A-Z]){1,4}\.?\b", "ABBREV"), (r"\b[A-Z][a-zA-Z']+(?:\s+[A-Z][a-zA-Z']+)?\s+J\.?\b", "JUDGE"),
    (r"\b(Hull|Ottawa|Toronto|Montreal|Québec|Vancouver|Canada|Ontario|Quebec)\b", "PLACE"),
    (r"\s*,\s*", " , "), (r"\s*\(\s*", " ( "), (r"\s*\)\s*", " ) "), (r"\b\d+\b", "NUM"),
]
SECONDARY_SOURCE = [
    (r"[\r\n]+", " "), (r"[ \t]{2,}", " "), (r"(?i)on\s*line\s*:\s*\S+", "URL"), (r"https?://\S+", "URL"),
    (r"\(\s*\d+(?:st|nd|rd|d|th)\s*\)", " ORDINAL "),
    (r"(?i)\(?\s*\d*\s*(?:st|nd|rd|th)?\s*ed(?:ition)?\.?\s*(?:(?:19|20)\d{2})?\s*\)?", " EDITION "),
    (r"(?i)\b(?:Revised\s+)?(?:Second|Third|Fourth|Fifth|Sixth|Seventh|Eighth|Ninth|Tenth|First|College)\s+Edition\b", " EDITION "),
    (r"(?i)\(?\s*(?:" + PLACES + r"|Portland|Kingston|St\.?\s*Paul|Markham|The\s+Hague)(?:\s*,\s*[A-Z][a-z]+\.?)?\s*:\s*[^,]{2,60}?,\s*(?:19|20)\d{2}\s*\)?", " PUB_INFO "),
    (r"\b\d+\s*:\s*\d+\b", " VOL_ISSUE "), (r"\(?\s*(19|20)\d{2}\s*\)?", " YEAR "), (r"(?<!\w)(\d+)([A-Za-z])", "$1 $2"), (r"([A-Za-z]\.)(\d)", "$1 $2"),
    (
        r"(?i)\b(?:Wash\.?\s*&\s*Lee\s+L\.?\s*Rev\.?|Can\.?\s+Y\.?B\.?\s+Int'?l\s+Law|Indigenous\s+Law\s+Journal|Osgoode\s+Hall\s+L\.?\s*J\.?"
        r"|(?:McGill|Dalhousie|Columbia|Colum\.?)\s+L\.?\s*(?:J\.|Rev\.?)|Queen'?s\s+L\.?\s*J\.?|Can\.?\s+Bar\s+Rev\.?|Can\.?\s+Bus\.?\s+L\.?\s*J\.?"
        r"|S\.C\.L\.R\.|U\.N\.B\.L\.J\.|U\.T\.L\.J\.|U\.B\.C\.?\s*L\.?\s*Rev\.?|C\.J\.A\.L\.P\.|C\.L\.E\.L\.J\.|R\.?\s*du\s+B\.|Alta\.?\s+L\.?\s*R\.?"
        r"|Is\.?\s*L\.?\s*R\.?|Mod\.?\s+L\.?\s*Rev\.?|Rev\.?\s+Const\.?\s+Stud\.?|Sask\.?\s+L\.?\s*Rev\.?|Mich\.?\s+L\.?\s*Rev\.?|Adv\.?\s+(?:Q\.?|J\.?)"
        r"|Labour|[A-Z][a-z]+\.?\s+L\.?\s+(?:J\.|Rev\.?))\b",
        " JOURNAL_ABBREV ",
    ),
    (
        r"(?i)(?:NAME)(?:\s*,\s*NAME|\s+and\s+NAME)*(?=\s*,\s*eds?\b)".replace("NAME", r"(?:[A-Z][a-z]+(?:\s+[A-Z]\.)?(?:\s+[A-Z][a-z]+)?|(?:[A-Z]\.\s*)+[A-Z][a-z]+)"),
        " AUTHOR_LIST ",
    ),
    (r"(?i)\beds?\.(?=,|\s|$)", " ED_MARKER "), (r"(ED_MARKER\s*,\s*)([A-Za-zÀ-ÿ][^,]*?)(?=\s*(?:YEAR|EDITION|PUB_INFO))", "$1BOOK_TITLE "),
    (r"(?i)\b(?:" + PLACES + r")\b", " PUB_PLACE "),
    (r"(?i)\b(?:Macmillan|Emond|Thomson\s+Reuters|LexisNexis|Irwin\s+Law|Carswell|Butterworths?|Oxford\s+University\s+Press|OUP|Cambridge\s+University\s+Press|Hart|Kluwer)\b", " PUBLISHER "),
    (r"(?i)\bLaw\s+Reform\s+Commission\s+of\s+\w+\b", " INSTITUTION "), (r"(?i)\bSupreme\s+Court(?:\s+(?:Law\s+)?of\s+Canada)?\b", " INSTITUTION "),
    (r"(?i)\bvol(?:ume)?\.?\s*\d*", " VOLUME "), (r"(?i)\bissue\b", " ISSUE "), (r"\b" + MONTHS + r"\b", " MONTH "),
    (r"\b[A-Z](?:\.[A-Za-z]){1,6}\.?\b", " ABBREV "), (r"\b\d+\b", " NUM "), (r"\s*,\s*", " , "), (r"\s*:\s*", " : "), (r"\s*\(\s*", " ( "), (r"\s*\)\s*", " ) "),
]
DECISION_TITLE = [
    (r"[\r\n]+", " "), (r"[ \t]{2,}", " "), (r"([A-Za-zÀ-ÿ])(v\.|c\.)([A-Za-zÀ-ÿ])", "$1 $2 $3"), (r"\(\s*(19|20)\d{2}\s*\)", "YEAR"),
    (r"\bv\.", "V"), (r"\bc\.", "V"), (r"\s*;\s*", " CASE_SEP "), (r"\(", " ( "), (r"\)", " ) "),
]
STRUCTURAL = ("V", "YEAR", "CASE_SEP", "(", ")")
RULES = {"fragment": FRAGMENT, "decision_citation": DECISION_CITATION, "legislation_citation": LEGISLATION_CITATION, "secondary_source": SECONDARY_SOURCE, "decision_title": DECISION_TITLE}


def _split(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def rewritten(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, new in rules:
        text = F.regexp_replace(text, F.lit("(?U)" + pattern), F.lit(new))
    return text


def pattern(text: Column, part: str) -> Column:
    """Tokens of a part's text after its rewrites; runs of plain words of a title are one PARTY."""
    text = F.lower(F.trim(text)) if part == "fragment" else F.trim(text)
    tokens = _split(rewritten(text, RULES[part]))
    if part != "decision_title":
        return tokens
    stripped = F.transform(tokens, lambda t: F.when(t.isin(*STRUCTURAL), t).otherwise(F.when(F.regexp_replace(t, r"^[,.]+|[,.]+$", "") != "", F.lit("PARTY"))))
    return without_runs(F.filter(stripped, lambda t: t.isNotNull()), "PARTY")


def without_runs(tokens: Column, of: str | None = None) -> Column:
    """Repeats of a token right behind itself go (only of one token, if it is named)."""

    def keep(t: Column, i: Column) -> Column:
        same = (i > 0) & (F.get(tokens, i - 1) == t)
        return ~(same & (t == of)) if of else ~same

    return F.filter(tokens, keep)


def frequencies(rows: DataFrame) -> DataFrame:
    """rows (key, pattern as text, seq) -> key, pattern, n, score (percent of the key), rank; equal scores
    in the order of first sight."""
    n = rows.groupBy("key", "pattern").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    all_of = Window.partitionBy("key")
    scored = n.withColumn("score", F.round(F.col("n") * 100.0 / F.sum("n").over(all_of), 2))
    return scored.withColumn("rank", F.row_number().over(all_of.orderBy(F.col("score").desc(), "first"))).select("key", "pattern", "n", "score", "rank")


def greedy(items: DataFrame, weights: DataFrame, n: int) -> DataFrame:
    """n examples by greatest added weight; items (example, item), weights (item, weight; others weigh 0).
    Equal gains go to the lowest example; steps stop when nothing is gained.

    Each step is one aggregation over uncovered items; only the chosen example's id comes to the driver.
    """
    spark = items.sparkSession
    left = stored(items.distinct().join(weights, "item").select("example", "item", "weight"), "greedy")
    chosen: list[tuple[int, int, float]] = []
    for step in range(1, n + 1):
        best = left.groupBy("example").agg(F.round(F.sum("weight"), 6).alias("gain")).orderBy(F.col("gain").desc(), "example").first()
        if best is None or best["gain"] <= 0:
            break
        chosen.append((step, best["example"], best["gain"]))
        covered = left.where(F.col("example") == best["example"]).select("item").distinct()
        left = stored(left.join(covered, "item", "left_anti"), "greedy")
    return spark.createDataFrame(chosen, f"step long, example {items.schema['example'].dataType.simpleString()}, gain double")


def lazy_greedy(items: dict[int, set[str]], weights: dict[str, float], n: int) -> list[tuple[int, float]]:
    """The same choice over sets in memory: a stale gain is an upper bound, so most are never renewed."""
    covered: set[str] = set()
    heap = [(-round(sum(weights.get(i, 0.0) for i in own), 6), e, 0) for e, own in items.items()]
    heapq.heapify(heap)
    out: list[tuple[int, float]] = []
    while heap and len(out) < n:
        gain, e, at = heapq.heappop(heap)
        if at == len(out):
            if gain >= 0:
                break
            out.append((e, -gain))
            covered |= items[e]
        else:
            heapq.heappush(heap, (-round(sum(weights.get(i, 0.0) for i in items[e] - covered), 6), e, len(out)))
    return out


def coverage_curve(items: DataFrame, weights: DataFrame) -> DataFrame:
    """items (step, item) -> step, covered: the running sum of the weights of items first seen at each step."""
    first = items.groupBy("item").agg(F.min("step").alias("step")).join(weights, "item")
    gained = items.select("step").distinct().join(first.groupBy("step").agg(F.sum("weight").alias("gain")), "step", "left").na.fill(0.0, ["gain"])
    return running_sum(gained, "step", "gain").select("step", F.round("sum", 6).alias("covered"))


def running_sum(rows: DataFrame, order: str, value: str, width: int = 4096) -> DataFrame:
    """order, sum: the sum of value up to each row of a whole-numbered order.  Rows are summed within
    stretches of the order, and the stretches' totals, a row each, give where they begin."""
    cut = rows.withColumn("__part", F.floor(F.col(order) / width))
    totals = cut.groupBy("__part").agg(F.sum(value).alias("__total"))
    begins = totals.select("__part", (F.sum("__total").over(Window.orderBy("__part")) - F.col("__total")).alias("__before"))
    inside = F.sum(value).over(Window.partitionBy("__part").orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("__inside", inside).join(begins, "__part").select(order, (F.col("__before") + F.col("__inside")).alias("sum"))


def hashed_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash: a sample that other engines can repeat."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)
