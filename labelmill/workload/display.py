"""Registered queries: rendering, formatting, JSON in and out."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.functions.scores import percent
from labelmill.functions.text import bar, class_line, cut, fixed
from labelmill.operators import scoring
from labelmill.sources import requests
from labelmill.workload.base import nb_sql, samples, table
from labelmill.workload.curation import LANGUAGES
from labelmill.workload.model import _nb


def render_lines(spark, sf):
    """The printed form of every test prediction, with descriptions."""
    p, _, predicted = _nb(spark, sf)
    return scoring.render(predicted, "id", p.classes, LANGUAGES)


def json_response(spark, sf):
    predicted = _nb(spark, sf, "source")[2]
    return predicted.select("id", requests.short_response().alias("response"))


def json_full_response(spark, sf):
    predicted = _nb(spark, sf)[2]
    return predicted.select("id", requests.full_response().alias("response"))


def json_request(spark, sf):
    """Good requests from documents; events lack the field, labels put a number into it."""
    good = samples(spark, sf).select(F.lit("document").alias("kind"), "id", F.to_json(F.struct("text")).alias("value"))
    absent = table(spark, sf, "events").select(F.lit("event"), "event_id", "props")
    number = table(spark, sf, "labels").select(
        F.lit("label"), "doc_id", F.to_json(F.struct(F.col("quality").alias("text")))
    )
    parsed = requests.with_request_text(good.union(absent).union(number))
    taken = requests.accepted(parsed).select("kind", "id", "text", F.lit(True).alias("accepted"))
    refused = requests.rejected(parsed).select("kind", "id", F.lit(None).cast("string").alias("text"), F.lit(False))
    return taken.union(refused)


def _discounts(spark, sf):
    items = table(spark, sf, "lineitem")
    return items.select("l_orderkey", "l_linenumber", "l_returnflag", "l_discount", percent(F.col("l_discount")).alias("pct"))


def text_bar(spark, sf):
    return _discounts(spark, sf).select(
        "l_orderkey", "l_linenumber", bar(F.col("pct") * 9).alias("bar"), class_line(F.col("l_returnflag"), F.col("pct")).alias("line")
    )


def fixed_decimals(spark, sf):
    return _discounts(spark, sf).select(
        "l_orderkey", "l_linenumber", fixed(F.col("l_discount"), 4).alias("four"), fixed(F.col("pct"), 2).alias("two")
    )


def cut_text(spark, sf):
    return samples(spark, sf).select("id", cut(F.col("text")).alias("shown"))


def _bar_sql(pct: str) -> str:
    return f"repeat('█', CAST(floor(({pct}) / 5) AS INTEGER)) || repeat('░', 20 - CAST(floor(({pct}) / 5) AS INTEGER))"


QUERIES = {
    "render_lines": (
        render_lines,
        f"""WITH {nb_sql()},
            ranked AS (
              SELECT id, class_name, pct, row_number() OVER (PARTITION BY id ORDER BY pct DESC, class_id) AS rk
              FROM (SELECT *, round_even(p * 100, 2) AS pct FROM probs))
            SELECT id, CAST(0 AS INTEGER) AS line_no, 'Category   : ' || prediction AS line FROM best
            UNION ALL SELECT id, 1, printf('Confidence : %.2f%%', confidence) FROM best
            UNION ALL SELECT id, 2, CASE prediction WHEN 'de' THEN 'German' WHEN 'en' THEN 'English'
                                    WHEN 'es' THEN 'Spanish' WHEN 'fr' THEN 'French' END FROM best
            UNION ALL SELECT id, CAST(rk + 2 AS INTEGER), printf('%-15s %s %6.2f%%', class_name, {_bar_sql('pct')}, pct) FROM ranked""",
    ),
    "json_response": (
        json_response,
        f"""WITH {nb_sql('source')}
            SELECT id, CAST(to_json({{'prediction': prediction, 'confidence': confidence}}) AS VARCHAR) AS response FROM best""",
    ),
    "json_full_response": (
        json_full_response,
        f"""WITH {nb_sql()},
            maps AS (SELECT id, '{{' || string_agg('"' || class_name || '":' || CAST(round_even(p * 100, 2) AS VARCHAR), ',' ORDER BY class_id) || '}}' AS m
                     FROM probs GROUP BY id)
            SELECT b.id, '{{"prediction":"' || prediction || '","confidence":' || CAST(confidence AS VARCHAR) ||
                   ',"all_probabilities":' || m || '}}' AS response FROM best b JOIN maps ON maps.id = b.id""",
    ),
    "json_request": (
        json_request,
        """SELECT 'document' AS kind, doc_id AS id, text, true AS accepted FROM documents
           UNION ALL SELECT 'event', event_id, NULL, false FROM events
           UNION ALL SELECT 'label', doc_id, NULL, false FROM labels""",
    ),
    "text_bar": (
        text_bar,
        f"""SELECT l_orderkey, l_linenumber, {_bar_sql('pct * 9')} AS bar,
                   printf('%-15s %s %6.2f%%', l_returnflag, {_bar_sql('pct')}, pct) AS line
            FROM (SELECT *, round_even(l_discount * 100, 2) AS pct FROM lineitem)""",
    ),
    "fixed_decimals": (
        fixed_decimals,
        """SELECT l_orderkey, l_linenumber, printf('%.4f', l_discount) AS four, printf('%.2f', round_even(l_discount * 100, 2)) AS two
           FROM lineitem""",
    ),
    "cut_text": (
        cut_text,
        """SELECT doc_id AS id, CASE WHEN length(text) > 120 THEN substring(text, 1, 120) || '...' ELSE text END AS shown
           FROM documents""",
    ),
}
