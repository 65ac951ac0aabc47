"""Labels, signals and the display blocks built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.schemas import BLOCK

# Label threshold, signals, colours and trend arrows.
BULLISH_FROM = 150.0
SIGNALS = {"Bullish": "STRONG BUY", "Bearish": "SELL"}
DEFAULT_SIGNAL = "HOLD"
COLORS = {"Bullish": "green", "Bearish": "red", "Neutral": "gray"}
DEFAULT_COLOR = "blue"
TRENDS = {"Bullish": "up", "Bearish": "down"}
DEFAULT_TREND = "none"
LINE_COLORS = {"green": "#10b981"}
DEFAULT_LINE_COLOR = "#f43f5e"
CHART_TITLE = "ข้อมูลราคาจริงของ {} แบบ Raw Display"
BLOCK_TYPES = ("markdown", "metric", "table", "chart", "embed")
FULL_WIDTH = 12


def _lookup(values: dict[str, str], key: Column, default: str) -> Column:
    out = None
    for name, value in values.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out.otherwise(default)


def price_label(average: Column, bullish_from: float = BULLISH_FROM) -> Column:
    return F.when(average >= bullish_from, "Bullish").otherwise("Bearish")


def signal(label: Column) -> Column:
    return _lookup(SIGNALS, label, DEFAULT_SIGNAL)


def color(label: Column) -> Column:
    return _lookup(COLORS, label, DEFAULT_COLOR)


def trend(label: Column) -> Column:
    return _lookup(TRENDS, label, DEFAULT_TREND)


def short_id(*parts: Column) -> Column:
    """Eight hex digits that depend only on what the block shows."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 8)


def dashboard_blocks(ticker: Column, label: Column, data: Column, key: Column) -> Column:
    """A metric block with the signal and a chart block with the price series."""
    ui_color = color(label)
    line = F.struct(
        F.lit("price").alias("dataKey"),
        F.lit("Price (USD)").alias("name"),
        _lookup(LINE_COLORS, ui_color, DEFAULT_LINE_COLOR).alias("color"),
    )
    config = F.struct(F.lit("time").alias("xAxisKey"), F.array(line).alias("lines"))
    metric = {
        "id": F.concat(F.lit("metric-1-"), short_id(key, ticker, F.lit("metric"))),
        "type": F.lit("metric"),
        "colSpan": F.lit(4),
        "label": F.concat(ticker, F.lit(" Signal")),
        "value": signal(label),
        "color": ui_color,
        "trend": trend(label),
    }
    before, after = CHART_TITLE.split("{}")
    chart = {
        "id": F.concat(F.lit("chart-1-"), short_id(key, ticker, F.lit("chart"))),
        "type": F.lit("chart"),
        "colSpan": F.lit(FULL_WIDTH),
        "title": F.concat(F.lit(before), ticker, F.lit(after)),
        "subType": F.lit("area"),
        "config": config,
        "data": data,
    }
    return F.array(*[_block(fields) for fields in (metric, chart)])


def _block(fields: dict[str, Column]) -> Column:
    """One block of the common type; fields the block has not are null."""
    return F.struct(
        *[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in BLOCK.fields]
    )


def layout(blocks: Column) -> Column:
    """Blocks of known types, each with a width from 1 to 12 (12 when absent or outside)."""
    known = F.filter(blocks, lambda b: b["type"].isin(*BLOCK_TYPES))
    return F.transform(
        known,
        lambda b: b.withField("colSpan", F.when(b["colSpan"].between(1, FULL_WIDTH), b["colSpan"]).otherwise(FULL_WIDTH)),
    )


def table_columns(columns: Column, rows_json: Column) -> Column:
    """Given columns, else the first row's keys with upper-case labels; null without rows."""
    first = F.get_json_object(rows_json, "$[0]")
    found = F.transform(F.json_object_keys(first), lambda k: F.struct(k.alias("key"), F.upper(k).alias("label")))
    return F.when(first.isNotNull(), F.coalesce(columns, found))


def confidence_text(score: Column) -> Column:
    return F.format_string("%.0f%%", score * 100)


def card(ticker: Column, label: Column, confidence: Column, summary: Column, content: Column) -> Column:
    """What an insight card shows, with its fallbacks."""
    return F.struct(
        F.coalesce(F.nullif(ticker, F.lit("")), F.lit("N/A")).alias("ticker"),
        label.alias("label"),
        confidence_text(confidence).alias("confidence"),
        F.coalesce(F.nullif(summary, F.lit("")), content).alias("text"),
    )
