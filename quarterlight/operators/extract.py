"""Field extraction by ordered cascades, as native expressions.

The filing cascades look for keywords, not for patterns: a line is cut at its numbers, a document at its
colons, once for all fields, and what stands before the cut is tested for each keyword by plain string
search.  ``by_line`` and ``by_document`` also take a catalog of any patterns, one regex each.

The cascades work page by page.  A match has a place in the document, so the first match of each
(document, field) is a hash aggregate, and no document's text is ever put together."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import FIELDS
from . import paging

# Keywords of the line cascade, in the order in which they are tried.
LINE_KEYWORDS = {
    "net_revenue": ["營業收入", r"4000[^\d]*營業收入", "營收"],
    "gross_profit": ["營業毛利", r"5900[^\d]*營業毛利", "毛利"],
    "operating_income": ["營業利益", r"6900[^\d]*營業利益", "營業淨利"],
    "net_income": ["本期淨利", r"8200[^\d]*本期淨利", "稅後淨利", "淨利"],
    "eps": ["每股盈餘", "基本每股盈餘"],
    "cash_and_equivalents": ["現金及約當現金", "現金及銀行存款"],
    "accounts_receivable": ["應收帳款", "應收帳款－淨額", "應收票據及帳款"],
    "inventory": ["存貨", "存貨－淨額", r"存\s*貨"],
    "total_assets": ["資產總額", "資產合計", "資產總計"],
    "total_liabilities": ["負債總額", "負債合計", "負債總計"],
    "equity": ["權益總額", "權益合計", "權益總計"],
}
# Labels of the document and table cascades; amounts follow a colon.
LABELS = {
    "net_revenue": ["營業收入[淨額]*", "淨?營收", "營收", "Net Revenue"],
    "gross_profit": [r"營業毛利\(損\)", "毛利", "Gross Profit"],
    "operating_income": [r"營業利益\(損失\)", "營業利益", "Operating Income"],
    "net_income": [r"本期淨利\(損\)", "淨利", "Net Income"],
    "eps": ["基本每股盈餘", "每股盈餘", "EPS", "Earnings per Share"],
    "total_assets": ["資產總額", "資產總計", "Total Assets"],
    "total_equity": ["股東權益總額", "權益總計", "Total Equity"],
}


#: More than any field has patterns.
PATTERNS = 1 << 10
#: Letters that count as others when case is ignored.
FOLDED = ("ſıİK", "siik")


@dataclass(frozen=True)
class Catalog:
    """Ordered patterns by field, each with the value as its first group."""

    patterns: dict[str, list[str]]


@dataclass(frozen=True)
class Keyword:
    """A field's n-th keyword.  ``text`` stands before the number, with ``code`` as the number before it, if there is one;
    ``spaced``: white space may stand between its letters; ``decimal``: the number has decimals."""

    field: str
    n: int
    text: str
    code: str = ""
    spaced: bool = False
    decimal: bool = False


@dataclass(frozen=True)
class Label:
    """A field's n-th label.  ``text`` ends before the colon, but for letters of ``tail``; ``bracketed``: the number
    may stand in parentheses; ``decimal``: points belong to the number, else commas."""

    field: str
    n: int
    text: str
    tail: str = ""
    bracketed: bool = False
    decimal: bool = False


def line_keywords() -> list[Keyword]:
    out = []
    for f, ks in LINE_KEYWORDS.items():
        for i, k in enumerate(ks):
            code, _, text = k.rpartition(r"[^\d]*")
            out.append(Keyword(f, i, text.replace(r"\s*", ""), code, r"\s*" in text, f == "eps"))
    return out


def labels(catalog: dict[str, list[str]] = LABELS) -> list[Label]:
    out = []
    for f, xs in catalog.items():
        for i, x in enumerate(xs):
            text, _, tail = x.partition("[")
            # A letter that may be missing at the front changes nothing.
            text = re.sub(r"^.\?", "", text).replace("\\", "")
            out.append(Label(f, i, text, tail.removesuffix("]*"), text.endswith(")"), f == "eps"))
    return out


def plausible(value: Column, name: Column) -> Column:
    """eps from 0.01 to 100, the other fields from 1,000 to 999,999,999,999, unknown fields above 0."""
    return F.when(name == "eps", value.between(0.01, 100)).when(name.isin(*FIELDS), value.between(1000, 999_999_999_999)).otherwise(value > 0)


def lines_of(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    return texts.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def pattern_hits(lines: DataFrame, keys: list[str], catalog: Catalog) -> DataFrame:
    """(keys, line_no, field, pattern_no, hit) of a catalog of patterns: each is tried on each line."""
    lines = lines.withColumn("line", T.strip(F.col("line")))
    tries = [F.struct(F.lit(f).alias("field"), F.lit(i).alias("pattern_no"), F.regexp_extract("line", p, 1).alias("hit")) for f, ps in catalog.patterns.items() for i, p in enumerate(ps)]
    return lines.select(*keys, "line_no", F.explode(F.filter(F.array(*tries), lambda t: t["hit"] != "")).alias("t")).select(*keys, "line_no", "t.*")


def pattern_of(k: Keyword) -> str:
    """The regex that the keyword stands for."""
    text = (r"\s*" if k.spaced else "").join(map(re.escape, k.text))
    return T.unicode_pattern((k.code + r"[^\d]*" if k.code else "") + text + r"[^\d]*" + (r"([0-9]+\.[0-9]{1,3})" if k.decimal else "([0-9,]+)"))


def least(texts: list[str]) -> list[str]:
    """Those that hold no other."""
    ordered = sorted(set(texts), key=len)
    return [t for i, t in enumerate(ordered) if not any(x in t for x in ordered[:i])]


def literals(items: list[dict]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in x.items()]) for x in items])


def keyword_hits(lines: DataFrame, keys: list[str], keywords: list[Keyword]) -> DataFrame:
    """(keys, line_no, field, pattern_no, hit).  Lines without any keyword go first, by string search alone.  One
    alternation of the shortest keywords finds which there are, and only those that hold one of them are looked at: the
    number is what one more regex finds behind the keyword's first occurrence.  Keywords with a code or
    spaces, and those that occur again behind an occurrence without number, are left to their own regex."""
    stem = lambda k: k.text[:1] if k.spaced else k.text
    short = least([stem(k) for k in keywords])
    lines = lines.filter(functools.reduce(Column.__or__, [F.contains("line", F.lit(t)) for t in short]))
    found = F.array_distinct(F.regexp_extract_all("line", F.lit("|".join(map(re.escape, sorted(short, key=len, reverse=True)))), F.lit(0)))
    lines = lines.select(*keys, "line_no", "line", F.explode(found).alias("short"))
    those = F.create_map(*[x for t in short for x in (F.lit(t), literals([{"field": k.field, "pattern_no": k.n, "text": stem(k), "code": k.code, "own": bool(k.code or k.spaced), "decimal": k.decimal, "pattern": pattern_of(k)} for k in keywords if next(u for u in short if u in stem(k)) == t]))])
    tries = lines.select(*keys, "line_no", "line", F.explode(F.element_at(those, F.col("short"))).alias("k")).select(*keys, "line_no", "line", "k.*")
    at = F.position("text", "line")
    tries = once(tries, "rest", F.when((at > 0) & F.contains("line", "code"), F.substring("line", at + F.length("text"), F.length("line")))).filter("rest is not null")
    tries = once(tries, "number", F.when(F.col("own"), F.lit("")).otherwise(F.regexp_extract("rest", r"(?U)\A[^\d]*+([0-9][0-9,.]*)", 1)))
    units = F.substring_index("number", ".", 1)
    behind = F.left(F.substring_index(F.substring_index(F.substring("number", F.length(units) + 2, F.length("number")), ".", 1), ",", 1), F.lit(3))
    tries = once(tries, "first", F.when(~F.col("decimal"), units).when(~F.contains(units, F.lit(",")) & (behind != ""), F.concat(units, F.lit("."), behind)).otherwise(""))
    again = F.col("own") | ((F.col("first") == "") & F.contains("rest", "text"))
    tries = once(tries, "hit", F.when(again, F.expr("regexp_extract(line, pattern, 1)")).otherwise(F.col("first")))
    return tries.select(*keys, "line_no", "field", "pattern_no", "hit").filter("hit <> ''")


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is computed here and once: an optimiser moves and copies projections, not generators."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def first_hits(hits: DataFrame, accept, parse) -> DataFrame:
    """(doc_id, field, value, line_no, pattern_no): the first of the hits, by line and then pattern, that parses and is accepted."""
    values = hits.select("doc_id", "line_no", "field", "pattern_no", parse(F.col("hit")).alias("value"))
    good = values.filter(F.col("value").isNotNull() & accept(F.col("value"), F.col("field")))
    # The place as one number: buffers of fixed width are aggregated by hash, without sorts.
    good = good.withColumn("place", F.col("line_no").cast("long") * PATTERNS + F.col("pattern_no"))
    first = good.groupBy("doc_id", "field").agg(F.min_by("value", "place").alias("value"), F.min("place").alias("place"))
    return first.select("doc_id", "field", "value", F.floor(F.col("place") / PATTERNS).cast("int").alias("line_no"), (F.col("place") % PATTERNS).cast("int").alias("pattern_no"))


def hits_in(lines: DataFrame, keys: list[str], catalog) -> DataFrame:
    return pattern_hits(lines, keys, catalog) if isinstance(catalog, Catalog) else keyword_hits(lines, keys, catalog)


def by_line(docs: DataFrame, catalog, doc_id: str = "doc_id", text: str = "text", at_least: int = 100, accept=plausible, parse=T.number) -> DataFrame:
    """(doc_id, field, value, line_no, pattern_no) of whole texts, by a list of keywords or a catalog of patterns.  Texts of
    fewer than ``at_least`` characters give no rows."""
    docs = docs.filter(F.length(text) >= at_least).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return first_hits(hits_in(lines_of(docs, ["doc_id"], "text"), ["doc_id"], catalog), accept, parse)


def by_page(pages: DataFrame, catalog, at_least: int = 100, accept=plausible, parse=T.number) -> DataFrame:
    """``by_line`` of documents in pages (doc_id, page_no, text), as if their pages were joined under headings: the first match wins across pages, and
    line numbers are the document's.  Only hits and one narrow row for each page are shuffled."""
    pages = paging.filled(pages)
    keys = ["doc_id", "page_no"]
    hits = hits_in(lines_of(pages, keys, "text"), keys, catalog)
    starts = paging.first_lines(pages, at_least)
    placed = hits.join(starts, keys).withColumn("line_no", F.col("first_line") + F.col("line_no"))
    return first_hits(placed, accept, parse)


def with_source(found: DataFrame, confidence: float, source: str) -> DataFrame:
    return found.select("doc_id", "field", "value", F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))


def smart_fields(docs: DataFrame, at_least: int = 100, **how) -> DataFrame:
    """The line cascade on text layers: at least 100 characters, confidence 1."""
    return with_source(by_line(docs, line_keywords(), at_least=at_least, **how), 1.0, "text")


def ocr_fields(docs: DataFrame, at_least: int = 50, **how) -> DataFrame:
    """The line cascade on recognised text: at least 50 characters, confidence 0.7."""
    return with_source(by_line(docs, line_keywords(), at_least=at_least, **how), 0.7, "ocr")


def cascade(text: Column, patterns: list[str], parse=T.number) -> Column:
    """The first pattern whose first hit parses; later hits of a pattern are not tried."""
    return functools.reduce(lambda a, b: F.coalesce(a, b), [parse(F.regexp_extract(text, p, 1)) for p in patterns])


def by_document(docs: DataFrame, catalog: Catalog | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, field, value) of the document cascade, by the labels or a catalog of patterns."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if catalog is None:
        return first_labels(label_hits(docs.withColumn("page_no", F.lit(0))))
    values = F.array(*[F.struct(F.lit(f).alias("field"), cascade(F.col("text"), ps).alias("value")) for f, ps in catalog.patterns.items()])
    return docs.select("doc_id", F.explode(values).alias("v")).select("doc_id", "v.*").filter("value is not null")


def by_labelled_page(pages: DataFrame) -> DataFrame:
    """``by_document`` of documents in pages (doc_id, page_no, text).  No label is cut by the end of a page, as pages are joined under headings."""
    return first_labels(label_hits(paging.filled(pages)))


def label_hits(pages: DataFrame) -> DataFrame:
    """(doc_id, place, field, n, value): numbers behind a label and a colon.  The text is cut at its colons; the labels
    are compared with the ends of the parts, and only parts that follow a label are read for a number."""
    parts = pages.select("doc_id", "page_no", F.split("text", "[：:]", -1).alias("parts"))
    sites = F.transform("parts", lambda head, i: F.struct(head.alias("head"), F.get("parts", i + 1).alias("rest")))
    sites = parts.select("doc_id", "page_no", F.posexplode(sites).alias("site", "s")).filter("s.rest is not null")
    sites = sites.select("doc_id", "page_no", "site", F.rtrim("s.head", F.lit(T.WHITE_SPACE)).alias("head"), F.col("s.rest").alias("rest"))
    known = labels()
    longest = max(len(x.text) for x in known)
    sites = sites.withColumn("end", F.lower(F.translate(F.right("head", F.lit(longest)), *FOLDED)))
    last = sorted({x.text[-1].lower() for x in known} | set("".join(x.tail for x in known)))
    sites = sites.filter(F.right("end", F.lit(1)).isin(*last))
    # Of the few parts that end like a label, each label's own row.
    named = sites.select("*", F.explode(literals([{"field": x.field, "n": x.n, "label": x.text.lower(), "tail": x.tail, "bracketed": x.bracketed, "decimal": x.decimal} for x in known])).alias("x")).select("doc_id", "page_no", "site", "head", "rest", "end", "x.*")
    named = named.filter(F.endswith(F.when(F.col("tail") == "", F.col("end")).otherwise(F.rtrim("head", "tail")), "label"))
    hits = once(named, "number", F.regexp_extract("rest", r"(?U)^\s*(\(?[\d,.]+)", 1)).filter("number <> ''")
    bare = F.ltrim("number", F.lit("("))
    amount = F.when(F.col("decimal"), F.substring_index(bare, ",", 1)).otherwise(F.substring_index(bare, ".", 1))
    hits = hits.withColumn("amount", amount).filter((F.col("bracketed") | ~F.startswith("number", F.lit("("))) & (F.col("amount") != ""))
    return hits.select("doc_id", F.shiftleft(F.col("page_no").cast("long"), 32).bitwiseOR(F.col("site").cast("long")).alias("place"), "field", "n", T.number(F.col("amount")).alias("value"))


def first_labels(hits: DataFrame) -> DataFrame:
    """(doc_id, field, value): the first label whose first hit parses; later hits of a label are not tried."""
    most = max(x.n for x in labels()) + 1
    mine = lambda i, c: F.when(F.col("n") == i, F.col(c))
    firsts = hits.groupBy("doc_id", "field").agg(*[F.min_by("value", mine(i, "place")).alias(f"v{i}") for i in range(most)])
    return firsts.select("doc_id", "field", F.coalesce(*[F.col(f"v{i}") for i in range(most)]).alias("value")).filter("value is not null")


def last_match(rows: DataFrame, order: list[str], value: str = "value") -> DataFrame:
    """(doc_id, field, value): later rows win, by up to three whole numbers from 0 to 2^31."""
    place = functools.reduce(lambda a, b: a * F.lit(10**10).cast("decimal(11,0)") + b, [F.col(c).cast("decimal(10,0)") for c in order]).cast("decimal(38,0)")
    return rows.groupBy("doc_id", "field").agg(F.max_by(value, place).alias("value"))


def by_table(tables: DataFrame, catalog: dict[str, list[str]] = LABELS) -> DataFrame:
    """(doc_id, field, value) of table rows: the first cell names the field, the first cell to
    its right that is all digits (without commas and parentheses) is the value; later rows win."""
    rows = tables.filter((F.size("headers") > 0) & (F.size("rows") > 0)).select("doc_id", "page", "table_index", F.posexplode("rows").alias("row_no", "cells")).filter(F.size("cells") > 0)
    plain = F.transform(F.slice("cells", F.lit(2), F.size("cells")), lambda c: F.trim(T.unbracketed(c)))
    first = F.get(F.filter(plain, lambda c: F.coalesce(c.rlike(r"(?U)^\d+\z"), F.lit(False))), F.lit(0))
    # White space doesn't keep a label from being found, and letters that may follow it don't matter.
    rows = rows.select("doc_id", "page", "table_index", "row_no", F.lower(F.translate(F.element_at("cells", 1), *FOLDED)).alias("cell"), T.number(first).alias("value")).filter("value is not null")
    named = rows.select("*", F.explode(literals([{"field": x.field, "label": x.text.lower()} for x in labels(catalog)])).alias("x")).filter(F.contains("cell", "x.label"))
    return last_match(named.select("doc_id", "page", "table_index", "row_no", "x.field", "value"), ["page", "table_index", "row_no"])


def combined(text_fields: DataFrame, table_fields: DataFrame) -> DataFrame:
    """Table values override text values; zeros go."""
    both = text_fields.select("doc_id", "field", F.col("value").alias("t")).join(table_fields.select("doc_id", "field", F.col("value").alias("u")), ["doc_id", "field"], "full")
    return both.select("doc_id", "field", F.coalesce("u", "t").alias("value")).filter("value <> 0")


def field_summary(found: DataFrame, docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, n_found, missing) for every document."""
    got = found.groupBy("doc_id").agg(F.collect_set("field").alias("got"))
    every = F.array(*map(F.lit, fields))
    have = F.array_intersect(every, F.coalesce("got", F.array().cast("array<string>")))
    return docs.select("doc_id").join(got, "doc_id", "left").select("doc_id", F.size(have).cast("long").alias("n_found"), F.array_except(every, have).alias("missing"))


def extraction_summary(found: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row for each document with values (doc_id, field, value, confidence, source):
    fields_found, total_possible_fields, field_confidence, field_source (maps of all found fields, known or
    not) and missing_fields."""
    every = F.array(*map(F.lit, fields))
    listed = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("field", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("source", F.lit("text")).alias("source")))).alias("f"))
    return listed.select(
        "doc_id", F.size(F.array_intersect(F.col("f.field"), every)).cast("long").alias("fields_found"), F.lit(len(fields)).cast("long").alias("total_possible_fields"),
        F.map_from_arrays("f.field", "f.confidence").alias("field_confidence"), F.map_from_arrays("f.field", "f.source").alias("field_source"), F.array_except(every, F.col("f.field")).alias("missing_fields"),
    )


def document_links(pages: DataFrame, target: str, suffix: str = ".pdf") -> DataFrame:
    """(page_id, position, url, text, size, filename): links to ``target``, by address or by its stem
    (the name without ``suffix``) in the text."""
    stem = target.replace(suffix, "")
    rows = pages.select("page_id", F.posexplode(T.links(F.col("html"), suffix)).alias("position", "a")).select("page_id", "position", "a.*")
    return rows.filter(F.contains("url", F.lit(target)) | F.contains("text", F.lit(stem))).withColumn("filename", F.lit(target))


def first_links(links: DataFrame) -> DataFrame:
    """Each page's first link, the one that is downloaded."""
    first = links.groupBy("page_id").agg(F.min("position").alias("position"))
    return links.join(first, ["page_id", "position"], "left_semi")
