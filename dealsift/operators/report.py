"""The daily report text and its hash."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from dealsift.functions import labels
from dealsift.functions.text import blank_to_null
from dealsift.operators.lifecycle import report_eligible


def _or_unknown(value: Column, fallback: str = "unknown") -> Column:
    return F.coalesce(blank_to_null(value), F.lit(fallback))


def listing_lines() -> Column:
    """Six lines about one listing."""
    c = F.col
    cost = F.coalesce(F.nullif(c("current_total_cost"), F.lit(0.0)), F.nullif(c("total_price"), F.lit(0.0)))
    price = F.coalesce(labels.money(cost), F.lit("价格 unknown"))
    unit = F.coalesce(
        F.concat(labels.money(F.nullif(c("cost_per_unit"), F.lit(0.0)), 2), F.lit("/unit")), F.lit("单件成本 unknown"))
    place = _or_unknown(F.concat_ws(", ", blank_to_null(c("location_city")), blank_to_null(c("location_state"))), "地点 unknown")
    risk = _or_unknown(F.array_join(F.slice("recommendation_reasons", 1, 4), ", "), "needs_manual_review")
    amount = F.coalesce(F.nullif(c("quantity"), F.lit(0).cast("bigint")).cast("string"), F.lit("unknown"))

    def whole(value: Column) -> Column:
        return F.format_number(value, 0)

    return F.concat_ws(
        "\n",
        F.concat(c("position").cast("string"), F.lit(". ["), c("category"), F.lit("] "), F.substring(c("title"), 1, 96)),
        F.concat(F.lit("   型号: "), _or_unknown(c("model"), "型号 unknown"), F.lit(" | 数量: "), amount, F.lit(" | 总价: "), price, F.lit(" | "), unit),
        F.concat(F.lit("   地点: "), place, F.lit(" | 剩余时间: "), _or_unknown(c("time_remaining")), F.lit(" | 完整度: "), c("component_completeness")),
        F.concat(F.lit("   状态: "), c("listing_status"), F.lit(" | 建议: "), c("recommendation"), F.lit(" | 风险: "), risk),
        F.concat(F.lit("   分数: "), whole(c("opportunity_score")), F.lit("/100 | 风险分: "), whole(c("risk_score")), F.lit("/100 | 来源: "), c("source_name")),
        F.concat(F.lit("   链接: "), c("source_url")),
    )


def top_listings(listings: DataFrame, as_of, order: list[str], top: int = 8) -> DataFrame:
    """The best report-eligible listings with their position."""
    best = report_eligible(listings, as_of).orderBy(
        F.desc("opportunity_score"), F.asc("risk_score"), *order).limit(top)
    # the window sees at most ``top`` rows
    place = Window.orderBy(F.desc("opportunity_score"), F.asc("risk_score"), *order)
    return best.withColumn("position", F.row_number().over(place))


def report_lines(listings: DataFrame, as_of, order: list[str], header: list[str] = (), top: int = 8) -> DataFrame:
    """One row: the report message and its hash."""
    blocks = top_listings(listings, as_of, order, top).select("position", listing_lines().alias("lines"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "lines")))
    body = blocks.agg(F.array_join(F.transform(ordered, lambda b: b["lines"]), "\n").alias("_body"))
    lead = "\n".join([*header, "Top重点机会:"])
    message = F.concat(
        F.lit(lead + "\n"), F.coalesce(blank_to_null(F.col("_body")), F.lit("本轮没有发现当前有效的具体硬件机会。")),
        F.lit("\n\n说明: 公开搜索发现结果需要人工核查；系统不会自动购买、出价、联系卖家或判断最终可采购性。"))
    return body.select(message.alias("message")).withColumn("message_hash", F.sha2("message", 256))


def message_hash(message: Column) -> Column:
    return F.sha2(message, 256)
