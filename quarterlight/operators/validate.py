"""The rule engine: rules compile to one pass of Column expressions.

A column with companions _raw (its JSON text) and _type (its JSON type by its Python name) is
judged by these, as ``readers.reports`` gives them for report_year.

Records are judged in map form, for a key with a null differs from no key:
stock_code, company_name, report_year, report_season, the four sections and metadata as maps."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import KEY_FIGURES, METADATA_KEYS


@dataclass(frozen=True)
class Rule:
    """kind: required, type, range or format; ``column`` may be "map.key"."""

    column: str
    kind: str
    message: str
    severity: str = "error"
    parameters: dict = field(default_factory=dict)


# The rules and their messages, in order.
RULES = (
    Rule("stock_code", "required", "股票代碼為必要欄位"),
    Rule("stock_code", "format", "股票代碼應為4位數字", parameters={"pattern": r"(?U)^\d{4}\n?\z"}),
    Rule("company_name", "required", "公司名稱為必要欄位"),
    Rule("report_year", "type", "報告年度應為整數", parameters={"type": "int"}),
    Rule("report_year", "range", "報告年度應在合理範圍內(2000-2030)", parameters={"min": 2000, "max": 2030}),
    Rule("report_season", "format", "報告季度應為Q1-Q4格式", parameters={"pattern": r"^Q[1-4]\n?\z"}),
    Rule("financials", "required", "財務數據欄位為必要", "warning"),
    Rule("income_statement", "required", "損益表數據為必要", "warning"),
    Rule("balance_sheet", "required", "資產負債表數據為必要", "warning"),
    Rule("metadata.file_size", "range", "檔案大小異常", "warning", {"min": 10000, "max": 50000000}),
)
# Messages of the checks that are not rules.
MISSING = "缺少重要財務數據: "
UNBALANCED = "資產負債表不平衡：資產 ≠ 負債 + 權益"
GROSS_ABOVE_REVENUE = "毛利不應大於營收"
OPERATING_ABOVE_GROSS = "營業利益不應大於毛利"
SMALL_FILE = "PDF檔案過小，可能不完整"
SUGGEST_CODE = "檢查股票代碼格式，應為4位數字"
SUGGEST_FIGURES = "建議重新處理PDF以提取更完整的財務數據"
SUGGEST_EMPTY = "財務數據為空，建議：1) 檢查PDF是否為掃描版 2) 啟用OCR處理 3) 手動驗證數據提取"
SUGGEST_LARGE = "PDF檔案較大，建議檢查是否包含不必要的圖片或內容"
SUGGEST_SMALL = "PDF檔案較小，可能內容不完整"
RULE_FAILED = "驗證規則執行錯誤"
TOLERANCE = 0.01


def value_of(df: DataFrame, column: str) -> tuple[Column, str]:
    """A rule's value and its type's name."""
    if "." in column:
        head, key = column.split(".", 1)
        if df.schema[head].dataType.typeName() == "map":
            return F.try_element_at(F.col(head), F.lit(key)), "string"
    return F.col(column), df.schema[column].dataType.typeName() if column in df.columns else df.select(column).schema[0].dataType.typeName()


def message_of(df: DataFrame, rule: Rule) -> Column:
    """The rule's message where it is broken, else null."""
    value, kind = value_of(df, rule.column)
    p, text = rule.parameters, F.lit(rule.message)
    said = lambda what: F.concat(text, F.lit(f" ({what}: "), value.cast("string"), F.lit(")"))
    if rule.kind == "required":
        out = F.when(value.isNull(), text)
        return out.when(F.size(value) == 0, F.concat(text, F.lit(" (欄位為空)"))) if kind in ("map", "array") else out
    typed = F.col(f"{rule.column}_type") if f"{rule.column}_type" in df.columns else None
    if typed is not None and rule.kind in ("type", "range"):
        value = F.col(f"{rule.column}_raw")
    if rule.kind == "type" and typed is not None:
        fits = {"int": ("int", "bool"), "str": ("str",), "float": ("float",)}[p["type"]]
        return F.when(typed.isNotNull() & ~typed.isin(*fits), F.concat(text, F.lit(" (實際類型: "), typed, F.lit(")")))
    if rule.kind == "type":
        whole = {"int": ("integer", "long", "short", "byte"), "str": ("string",), "float": ("double", "float")}[p["type"]]
        return F.lit(None).cast("string") if kind in whole else F.when(value.isNotNull(), F.concat(text, F.lit(f" (實際類型: {kind})")))
    if rule.kind == "range":
        number = value.try_cast("double")
        out = F.when(value.isNotNull() & number.isNull(), F.lit(RULE_FAILED))
        if typed is not None:
            number = F.when(typed == "bool", (value == "true").cast("double")).otherwise(number)
            value = F.when(typed == "bool", F.initcap(value)).otherwise(value)
            out = F.when(typed.isin("str", "dict", "list"), F.concat(F.lit(f"{RULE_FAILED}: '<' not supported between instances of '"), typed, F.lit("' and 'int'")))
        if "min" in p:
            out = out.when(number < p["min"], said("值太小"))
        return out.when(number > p["max"], said("值太大")) if "max" in p else out
    if rule.kind == "format":
        return F.when(~value.cast("string").rlike(p["pattern"]), said("格式不符"))
    raise ValueError(f"unknown kind of rule: {rule.kind}")


def messages(df: DataFrame, rules, severity: str, more: tuple[Column, ...] = ()) -> Column:
    return F.array_compact(F.array(F.lit(None).cast("string"), *[message_of(df, r) for r in rules if r.severity == severity], *more))


def figure(name: str) -> Column:
    return F.try_element_at(F.coalesce("financials", F.create_map().cast("map<string,string>")), F.lit(name)).try_cast("double")


def balance_message(assets: Column, liabilities: Column, equity: Column) -> Column:
    """Where assets differ from liabilities + equity by more than 1 % of assets; negative or zero assets never."""
    return F.when(assets.isNotNull() & liabilities.isNotNull() & equity.isNotNull() & (assets != 0) & (F.try_divide(F.abs(assets - (liabilities + equity)), assets) > TOLERANCE), F.lit(UNBALANCED))


def quality_score(errors: Column, warnings: Column, figures: Column, keys: Column) -> Column:
    """100 - 20 an error - 5 a warning + 20 * figures / 7 + 10 * keys / 5, within 0 and 100."""
    raw = F.lit(100.0) - errors * 20 - warnings * 5 + figures.cast("double") / len(KEY_FIGURES) * 20 + keys.cast("double") / len(METADATA_KEYS) * 10
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))


def validated(records: DataFrame, rules=RULES) -> DataFrame:
    """``records`` with is_valid, errors, warnings, suggestions and score; one pass, no shuffle."""
    missing = F.array_join(F.array_compact(F.array(*[F.when(figure(f).isNull(), F.lit(f)) for f in KEY_FIGURES])), ", ")
    assets, liabilities, equity = (figure(f) for f in ("total_assets", "total_liabilities", "equity"))
    # Zero assets stop the checks after the balance, too.
    goes_on = ~F.coalesce(liabilities.isNotNull() & equity.isNotNull() & (assets == 0), F.lit(False))
    above = lambda a, b, m: F.when(goes_on & (figure(a) != 0) & (figure(b) != 0) & (figure(a) > figure(b)), F.lit(m))
    size, created = F.try_element_at("metadata", F.lit("file_size")).try_cast("double"), T.iso_year(F.try_element_at("metadata", F.lit("created_at")))
    year = F.col("report_year").try_cast("int")
    apart = F.when((year != 0) & (F.abs(created - year) > 2), F.concat(F.lit("報告年度("), year.cast("string"), F.lit(")與建立時間("), created.cast("string"), F.lit(")差距過大")))
    out = records.withColumns({
        "errors": messages(records, rules, "error", (balance_message(assets, liabilities, equity), above("gross_profit", "net_revenue", GROSS_ABOVE_REVENUE), above("operating_income", "gross_profit", OPERATING_ABOVE_GROSS))),
        "warnings": messages(records, rules, "warning", (F.when(missing != "", F.concat(F.lit(MISSING), missing)), apart, F.when(F.coalesce(size, F.lit(0.0)) < 10000, F.lit(SMALL_FILE)))),
    })
    figures = sum((figure(f).isNotNull().cast("int") for f in KEY_FIGURES), F.lit(0))
    keys = sum((F.coalesce(F.map_contains_key("metadata", k), F.lit(False)).cast("int") for k in METADATA_KEYS), F.lit(0))
    says = lambda c, word: F.exists(c, lambda m: F.contains(m, F.lit(word)))
    size0 = F.coalesce(size, F.lit(0.0))
    return out.withColumns({
        "is_valid": F.size("errors") == 0,
        "suggestions": F.array_compact(F.array(
            F.when(says("errors", "股票代碼"), F.lit(SUGGEST_CODE)), F.when(says("warnings", "財務數據"), F.lit(SUGGEST_FIGURES)),
            F.when(F.coalesce(F.size("financials"), F.lit(0)) <= 0, F.lit(SUGGEST_EMPTY)),
            F.when(size0 > 20_000_000, F.lit(SUGGEST_LARGE)).when(size0 < 100_000, F.lit(SUGGEST_SMALL)),
        )),
        "score": quality_score(F.size("errors"), F.size("warnings"), figures, keys),
    })


def summary_metrics() -> list[Column]:
    """What a summary needs of judged records, as aggregates; a record that could not be read scores 0."""
    score = F.coalesce(F.col("score"), F.lit(0.0)).cast("decimal(20,6)")
    return [F.count("*").alias("total"), F.count_if("is_valid").alias("valid"), F.count_if(F.size("warnings") > 0).alias("with_warnings"), F.count_if(F.size("errors") > 0).alias("with_errors"), F.coalesce(F.sum(score), F.lit(0).cast("decimal(30,6)")).alias("scores")]


def summary_of(metrics: DataFrame) -> DataFrame:
    mean = F.coalesce(F.try_divide(F.col("scores").cast("double"), F.col("total").cast("double")), F.lit(0.0)).alias("average_score")
    return metrics.select("total", "valid", "with_warnings", "with_errors", mean)


def quality_summary(judged: DataFrame) -> DataFrame:
    """One row: totals and the mean score over all records."""
    return summary_of(judged.agg(*summary_metrics()))


def common_issues(judged: DataFrame) -> DataFrame:
    """(issue, n): messages up to their first parenthesis."""
    return judged.select(F.explode(F.concat("errors", "warnings")).alias("m")).groupBy(T.message_prefix(F.col("m")).alias("issue")).agg(F.count("*").alias("n"))


def report_errors(code: Column, name: Column, year: Column, season: Column, this_year: int) -> Column:
    """Errors of a bare record: code and name filled, year from 2000 to next year, season Q1 to Q4."""
    return F.array_compact(F.array(
        F.when(F.coalesce(code, F.lit("")) == "", F.lit("stock_code")), F.when(F.coalesce(name, F.lit("")) == "", F.lit("company_name")),
        F.when(~F.coalesce(year.between(2000, this_year + 1), F.lit(False)), F.lit("report_year")), F.when(~F.coalesce(season.isin("Q1", "Q2", "Q3", "Q4"), F.lit(False)), F.lit("report_season")),
    ))
